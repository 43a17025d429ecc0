"""Exact repeats between documents, found with merged Burrows-Wheeler transforms.

A byte goes when a ``length``-byte string that covers it also starts in a document with a smaller id.

A transform of all text at once would be one structure as large as the corpus, so the work is first
cut into pieces that tasks can hold, without losing a match:

0. *Chunks.* Documents are written once, some four megabytes of text at a time; what is found later names a chunk and a row of it,
   so neither ids nor other columns are joined and texts are never shuffled. A text that a document
   with a smaller id has as a whole (by a 128-bit digest) is covered as a whole and takes no further part.
1. *Anchors.* In each window of ``length - k + 1`` k-grams, the one with the least hash is an anchor. Equal
   windows have equal anchors, so a repeat of ``length`` bytes always carries the same anchor at the same
   place. The context of an anchor (up to ``length - k`` bytes before, ``length`` from it on) holds
   every window it can stand for.
2. *Semi-join.* Anchor hashes are dealt by range; what comes back for a chunk is one bit for each, set if
   another document has it too. Nothing is broadcast.
3. *Merge.* Contexts of the marked anchors are dealt by anchor, as bytes. Equal ones belong to their smallest document; the
   rest of them are covered. Where an anchor has several contexts, each is a shard with a transform of its own, and
   the transforms are merged by refining their interleave, symbol by symbol, ``length`` times: then
   suffixes are in order by their first ``length`` bytes, and rows whose common prefix reaches
   ``length`` form the repeated intervals. No suffix of the merged set is compared or sorted again.
4. Where more than ``_CHUNK`` documents hold an anchor (the edge of a passage that many documents hold, each after
   other text), contexts are cut into their windows, dealt by digest: equal ones meet, whatever their anchor has.

Chunks pre-aggregate: of equal contexts in a chunk only the smallest document's is sent on, so a
passage in a third of all documents costs one row for each chunk.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import text as tx
from .session import buckets_for, fresh_dir, released, written

LENGTH, GRAM = 50, 22
#: Bytes of text in a chunk, and in what a task looks for anchors in at once. A chunk sends a row to each bucket, so larger ones send fewer.
STORED_BYTES, CHUNK_BYTES = 1 << 22, 1 << 18
_HELD = 1 << 18
#: Contexts merged at once (more only where one anchor has more); anchors of more than _CHUNK documents are compared by windows.
_MERGED, _CHUNK = 1 << 10, 1 << 12


class Anchors:
    """Of a slice of texts: row, position, k-gram hash and context bounds of every anchor."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, k: int):
        n, w = len(data), length - k + 1
        if n < length:
            self.pos = self.row = self.lo = self.hi = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            return
        prefix = tx.prefix_hash(data)
        _, down = tx.powers(n + 1)
        grams = (prefix[k:] - prefix[: n - k + 1]) * down[: n - k + 1]
        grams ^= grams >> np.uint64(29)
        grams *= tx.WORD_CODE[5]
        grams ^= grams >> np.uint64(32)
        low = np.uint64((1 << max(22, int(n).bit_length())) - 1)
        best, span = (grams & ~low) | np.arange(n - k + 1, dtype=np.uint64), 1
        while span * 2 <= w:
            best = np.minimum(best[:-span], best[span:])
            span *= 2
        best = np.minimum(best[: n - length + 1], best[w - span : w - span + n - length + 1])
        sizes = np.diff(offsets)
        row = np.repeat(np.arange(len(sizes)), sizes)
        inside = np.flatnonzero(np.repeat(offsets[1:] - length, sizes)[: n - length + 1] >= np.arange(n - length + 1))
        at = (best[inside] & low).astype(np.int64)
        # a run of windows with one anchor ends where the anchor changes, or the windows leave a text
        edge = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (np.diff(inside) != 1)])) if len(at) else at
        self.pos = at[edge]
        self.row = row[self.pos]
        self.hash = grams[self.pos]
        self.lo = inside[edge]
        self.hi = inside[np.concatenate([edge[1:], [len(at)]]) - 1] + length if len(at) else at


# -- chunks -----------------------------------------------------------------------------------------


def _free(docs: DataFrame, name: str) -> str:
    """``name``, or one like it that is no column of ``docs``, case aside."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(docs: DataFrame, length: int) -> DataFrame:
    """(chunk, path, at, size, skip): where the chunks of ``docs`` are, and their rows that are whole copies.

    A chunk holds all columns of some rows of ``docs`` and, last, doc_id as a long. A task that runs again writes a new
    file; only those of the attempt that ended well are named.
    """
    spark = docs.sparkSession
    folder, place = fresh_dir(spark, "chunks"), docs.columns.index("text")

    def digest(text: bytes | None) -> bytes | None:
        return hashlib.blake2b(text, digest_size=16).digest() if text and len(text) >= length else None

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        part, at, out, rows = TaskContext.get().partitionId(), 0, None, []
        name = f"part-{part:06d}-{uuid.uuid4().hex[:8]}.chunks"
        for batch in batches:
            for a, b, data, offsets in tx.slices(batch.column(place), STORED_BYTES):
                out = out or fs.open_output_stream(f"{path}/{name}")
                piece, sink, raw = batch.slice(a, b - a), pa.BufferOutputStream(), data.tobytes()
                with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as ipc:
                    ipc.write_batch(piece)
                blob = sink.getvalue()
                out.write(blob)
                rows.append(((part << 32) + len(rows), f"{folder}/{name}", at, blob.size, piece.column(piece.num_columns - 1).to_pylist(), [digest(raw[i:j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]))
                at += blob.size
        if out:
            out.close()
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["chunk", "path", "at", "size", "ids", "digests"])

    named = docs.withColumn("text", F.col("text").cast("string")).withColumn(_free(docs, "id"), F.col("doc_id").cast("long"))
    chunks = written(named.mapInArrow(released(store), "chunk long, path string, at long, size long, ids array<long>, digests array<binary>"), "chunks")
    rows = chunks.select("chunk", F.posexplode(F.arrays_zip("ids", "digests")).alias("row", "x")).select("chunk", "row", F.col("x.ids").alias("id"), F.col("x.digests").alias("digest")).where("id is not null and digest is not null")
    first = rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    copies = rows.hint("merge").join(first, "digest").where("id > first").groupBy("chunk").agg(F.sort_array(F.collect_list("row")).alias("skip"))  # no longer than a chunk
    return written(chunks.drop("ids", "digests").join(copies, "chunk", "left"), "work")


def _load(path: str, at: int, size: int) -> pa.RecordBatch:
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as file:
        return pa.ipc.open_stream(pa.py_buffer(file.read_at(size, at))).read_next_batch()


def _loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.RecordBatch]]:
    for batch in batches:
        for row in batch.to_pylist():
            yield row, _load(row["path"], row["at"], row["size"])


class Chunk:
    """The anchors of a chunk, the distinct hashes that it asks about, and how many of its documents hold each (at most ``_CHUNK + 1``)."""

    def __init__(self, piece: pa.RecordBatch, skip: list[int] | None, length: int, k: int):
        place = piece.schema.get_field_index("text")
        ids = piece.column(piece.num_columns - 1)
        self.data, offsets = tx.buffers(piece.column(place))
        self.begin = offsets[:-1]
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        out = np.asarray(ids.is_null())
        out[skip or []] = True
        found = []
        # long texts are looked through in parts, whose windows don't overlap
        a, rows = 0, len(offsets) - 1
        while a < rows:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK_BYTES, "right")) - 1)
            for start in range(int(offsets[a]), max(int(offsets[a]) + 1, int(offsets[b]) - length + 1), CHUNK_BYTES if b == a + 1 else 1 << 62):
                end = min(int(offsets[b]), start + CHUNK_BYTES + length - 1) if b == a + 1 else int(offsets[b])
                inner = np.array([0, end - start]) if b == a + 1 else offsets[a : b + 1] - start
                f = Anchors(self.data[start:end], inner, length, k)
                found.append((f.pos + start, f.row + a, f.hash, f.lo + start, f.hi + start))
            a = b
        pos, row, h, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 5
        keep = ~out[row]
        self.pos, self.row, self.lo, self.hi = pos[keep], row[keep], lo[keep], hi[keep]
        self.key = tx.mix(h[keep].astype(np.uint64)) >> np.uint64(24)  # 40 bits; anchors have low hashes, which would deal unevenly
        doc = self.ids[self.row]
        order = np.lexsort((doc, self.key))
        h, d = self.key[order], doc[order]
        held = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])[: len(h)]
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
        self.asked = h[new]
        self.held = np.minimum(np.add.reduceat(held, new, dtype=np.int64), _CHUNK + 1) if len(h) else new


def _edges(asked: np.ndarray, n: int) -> np.ndarray:
    """Where each of the ``n`` buckets begins in sorted 40-bit hashes; buckets are ranges."""
    return np.searchsorted(asked, np.array([_floor(i, n) for i in range(n + 1)], np.uint64))


def _floor(bucket: int, n: int) -> int:
    return -(-(bucket << 40) // n)


def _squeezed(*columns: np.ndarray) -> bytes:
    """Columns of integers of one length, byte by byte, so that they compress."""
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _restored(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    widths = [np.dtype(k).itemsize for k in kinds]
    m, at, out = len(raw) // sum(widths), 0, []
    for k, w in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, m * w, at).reshape(w, m).T).view(k)[:, 0])
        at += m * w
    return out


# -- ranges -----------------------------------------------------------------------------------------


def _merge_runs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges sorted and joined where they touch."""
    if not len(a):
        return a, b
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    return a[new], b[np.concatenate([new[1:], [True]])]


def _ranges(chunk: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, bytes]]:
    """(chunk, squeezed row, start, end) of byte ranges, joined within each row where they touch."""
    if not len(chunk):
        return []
    order = np.lexsort((a, row, chunk))
    chunk, row, a, b = chunk[order], row[order], a[order], b[order]
    new = np.concatenate([[True], (chunk[1:] != chunk[:-1]) | (row[1:] != row[:-1])])
    # lift each row above the ends of those before it, so that one pass joins the ranges of all
    lift = np.cumsum(new) * (int(b.max()) + 2)
    x, y = _merge_runs(a + lift, b + lift)
    at = np.searchsorted(a + lift, x)
    chunk, row, x, y = chunk[at], row[at], x - lift[at], y - lift[at]
    edge = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1], [True]])).tolist()
    return [(int(chunk[i]), _squeezed(row[i:j].astype("<i4"), x[i:j].astype("<i8"), y[i:j].astype("<i8"))) for i, j in zip(edge[:-1], edge[1:], strict=True)]


def _windows(rows: list[tuple[bytes, int, int, int]], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(half of the digest, other half, doc_id, row, start) of all windows of contexts, some ``_HELD`` at a time."""
    digests, docs, texts, starts = [], [], [], []
    for i, (s, d, row, lo) in enumerate(rows, 1):
        m = len(s) - length + 1
        digests += [hashlib.blake2b(s[j : j + length], digest_size=16).digest() for j in range(m)]
        docs += [d] * m
        texts += [row] * m
        starts += range(lo, lo + m)
        if digests and (len(digests) >= _HELD or i == len(rows)):
            x, y = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2).T
            yield np.ascontiguousarray(x), np.ascontiguousarray(y), np.array(docs), np.array(texts), np.array(starts)
            digests, docs, texts, starts = [], [], [], []


def _gathered(data: np.ndarray, lo: np.ndarray, size: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """The bytes of contexts as rows of one matrix, 0 behind the end of each."""
    out = np.zeros((len(lo), len(wide)), np.uint8)
    for i in range(0, len(lo), 4096):
        at = lo[i : i + 4096, None] + wide
        np.minimum(at, len(data) - 1, out=at)
        part = data[at]
        part[wide >= size[i : i + 4096, None]] = 0
        out[i : i + 4096] = part
    return out


def _row_hashes(text: np.ndarray) -> np.ndarray:
    """A hash of each row of a matrix whose width is a multiple of eight bytes."""
    out = np.zeros(len(text), np.uint64)
    for column in text.view(np.uint64).T:
        out = tx.mix(out * tx.WORD_CODE[0] + column)
    return out


def _covered_later(d: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by keys and doc, and which rows of it have equal keys in a smaller document."""
    order = np.lexsort((d, *keys))
    d, keys = d[order], [x[order] for x in keys]
    new = np.ones(len(d), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in keys], axis=0)
    return order, d > d[new][np.cumsum(new) - 1]


# -- Burrows-Wheeler transforms of many short strings ------------------------------------------------


def shard_bwts(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The transforms of shards of one string each, one after the other.

    (symbol, row of the preceding suffix, string, offset) of each row. Symbols are byte + 1 and 0 before the
    first; the row of an end stands first in its shard.
    """
    lens = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
    n, at = int(lens.sum()), np.cumsum(lens)
    joined = np.frombuffer(b"".join(strings), np.uint8)
    text = np.ones(n, bool)
    text[at - 1] = False
    flat = np.zeros(n + 8, np.uint8 if not len(joined) or joined.max() < 255 else np.uint16)
    flat[:n][text] = joined + flat.dtype.type(1)
    string = np.repeat(np.arange(len(strings)), lens)
    wide = flat.astype(np.uint64)
    key = string.astype(np.uint64) << np.uint64(45)
    for j in range(5):
        key |= wide[j : n + j] << np.uint64(9 * (4 - j))
    order = np.argsort(key)
    ranked = key[order]
    alike = np.concatenate([[False], ranked[1:] == ranked[:-1], [False]])
    tied = np.flatnonzero(alike[:-1] | alike[1:])
    if len(tied):  # suffixes of one string that share five symbols
        begin = at - lens
        place = order[tied].tolist()
        place.sort(key=lambda i: (string[i], strings[string[i]][i - begin[string[i]] :]))
        order[tied] = place
    row = np.empty(n + 1, np.int32)
    row[order] = np.arange(n, dtype=np.int32)
    row[-1] = 0
    offset = order - (at - lens)[string[order]]
    symbol = np.where(offset == 0, 0, flat[order - 1]).astype(flat.dtype)
    return symbol, row[order - 1], string[order], offset


def merge_bwts(symbols: np.ndarray, back: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of rows of the merged transform that agree in their first ``depth`` symbols.

    Returns (row, block) of blocks with two rows and more, in merged order. In each round the interleave,
    right for h symbols, is read once: every row's symbol sends the row before it in its string to that
    symbol's next free place, which makes the interleave right for h + 1. Where symbol or block changes, h
    is the common prefix with the row above. A row alone in its block can't share more, nor can the rows
    before it in its string, so it leaves the interleave.
    """
    rows, block = np.arange(len(symbols), dtype=np.int32), np.zeros(len(symbols), np.int32)
    for _ in range(depth):
        symbol = symbols[rows]
        order = np.argsort(symbol, kind="stable")
        order = order[np.count_nonzero(symbol == 0) :]
        symbol, block, rows = symbol[order], block[order], back[rows[order]]
        new = np.ones(len(rows) + 1, bool)
        new[1:-1] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        some = ~(new[:-1] & new[1:])
        block = np.cumsum(new[:-1], dtype=np.int32)[some]
        rows = rows[some]
    return rows, block


def repeated_windows(strings: list[bytes], owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of every ``length``-byte window that a string of a smaller owner also holds."""
    symbols, back, string, offset = shard_bwts(strings)
    rows, block = merge_bwts(symbols, back, length)
    string, offset = string[rows], offset[rows]
    least = np.full(int(block[-1]) + 1 if len(block) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, block, owner[string])
    hit = least[block] < owner[string]
    return string[hit], offset[hit]


# -- the passes -------------------------------------------------------------------------------------


def _tasks(docs: DataFrame) -> int:
    return buckets_for(docs) // 2


def _marked(work: DataFrame, length: int, k: int, n: int, tasks: int) -> DataFrame:
    """``work`` with marks: for each bucket that has any, a bit for each hash that the chunk asks about."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, piece in _loaded(batches):
            c = Chunk(piece, row["skip"], length, k)
            asked, held, edge = c.asked, c.held.astype("<u4"), _edges(c.asked, n)
            some = np.flatnonzero(np.diff(edge)).tolist()
            data = [_squeezed(np.diff(asked[edge[i] : edge[i + 1]], prepend=np.uint64(_floor(i, n))), held[edge[i] : edge[i + 1]]) for i in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([row["chunk"]] * len(some), pa.int64()), pa.array(data, pa.binary())], ["bucket", "chunk", "data"])

    def answer(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        each, held = zip(*(_restored(x, "<u8", "<u4") for x in part["data"]), strict=True)
        each = [np.cumsum(x) + np.uint64(_floor(int(key[0]), n)) for x in each]
        edge = np.concatenate([[0], np.cumsum([len(x) for x in each])])
        asked = np.concatenate(each)
        order = np.argsort(asked, kind="stable")
        new = np.concatenate([[True], asked[order][1:] != asked[order][:-1]])
        total = np.add.reduceat(np.concatenate(held)[order], np.flatnonzero(new), dtype=np.int64)
        docs = np.empty(len(asked), np.int64)
        docs[order] = total[np.cumsum(new) - 1]
        out = []
        for chunk, i, j in zip(part["chunk"].tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if (docs[i:j] > 1).any():
                many = docs[i:j] > _CHUNK
                out.append((chunk, int(key[0]), np.packbits(docs[i:j] > 1).tobytes(), np.packbits(many).tobytes() if many.any() else None))
        return pd.DataFrame(out, columns=["chunk", "bucket", "some", "many"])

    asked = work.repartition(tasks).mapInArrow(released(ask), "bucket int, chunk long, data binary")
    marks = asked.groupBy("bucket").applyInPandas(answer, "chunk long, bucket int, some binary, many binary")
    marks = marks.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "some", "many")).alias("marks"))  # a bit for each anchor of a chunk
    return written(work.join(marks, "chunk"), "marked")


def _found(work: DataFrame, length: int, k: int, n: int, tasks: int) -> DataFrame:
    """(chunk, data): squeezed byte ranges of rows that repeat a smaller document."""

    def packed(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["kind", "bucket", "chunk", "data"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for told, piece in _loaded(batches):
            c, chunk = Chunk(piece, told["skip"], length, k), told["chunk"]
            edge, some, many = _edges(c.asked, n), np.zeros(len(c.asked), bool), np.zeros(len(c.asked), bool)
            for m in told["marks"]:
                i, j = edge[m["bucket"]], edge[m["bucket"] + 1]
                some[i:j] = np.unpackbits(np.frombuffer(m["some"], np.uint8), count=j - i)
                if m["many"]:
                    many[i:j] = np.unpackbits(np.frombuffer(m["many"], np.uint8), count=j - i)
            at = np.searchsorted(c.asked, c.key)
            keep = np.flatnonzero(some[at])
            many = many[at[keep]]
            key, row, lo, size, pos = c.key[keep], c.row[keep], c.lo[keep], (c.hi - c.lo)[keep], (c.pos - c.lo)[keep]
            doc = c.ids[row]
            # equal contexts of the chunk: found by a hash, settled by their bytes
            wide = np.arange(-(-(2 * length - k) // 8) * 8)
            text = _gathered(c.data, lo, size, wide)
            order = np.lexsort((doc, pos, size, _row_hashes(text), key))
            key, row, lo, size, pos, doc, many, text = (x[order] for x in (key, row, lo, size, pos, doc, many, text))
            eight = text.view(np.uint64)
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (size[1:] != size[:-1]) | (pos[1:] != pos[:-1]) | (eight[1:] != eight[:-1]).any(axis=1)
            done = doc > doc[new][np.cumsum(new) - 1] if len(key) else new
            begin = lo - c.begin[row]
            yield packed([(1, chunk % n, *x) for x in _ranges(np.full(done.sum(), chunk), row[done], begin[done], (begin + size)[done])])
            hot = [(bytes(text[i, : size[i]]), int(doc[i]), int(row[i]), int(begin[i])) for i in np.flatnonzero(many & ~done).tolist()]
            for x, y, d, r, b in _windows(hot, length):
                order, later = _covered_later(d, y, x)
                x, y, d, r, b = (v[order] for v in (x, y, d, r, b))
                yield packed([(1, chunk % n, *v) for v in _ranges(np.full(later.sum(), chunk), r[later], b[later], b[later] + length)])
                rest = ~later
                edge = np.searchsorted(x[rest] >> np.uint64(24), np.array([_floor(i, n) for i in range(n + 1)], np.uint64))
                yield packed([(4, i, chunk, _squeezed(*(np.ascontiguousarray(v[rest][p:q]) for v in (x, y, d, r, b)))) for i, (p, q) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)) if p < q])
            rest = ~many & ~done
            edge = _edges(key[rest], n).tolist()
            text, size, doc, row, begin, pos = (x[rest] for x in (text, size, doc, row, begin, pos))
            inside = wide < size[:, None]
            out = []
            for i, (p, q) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
                if p < q:
                    columns = _squeezed(doc[p:q].astype("<i8"), row[p:q].astype("<i4"), begin[p:q].astype("<i8"), size[p:q].astype("<u2"), pos[p:q].astype("<u2"))
                    out.append((3, i, chunk, len(columns).to_bytes(4, "little") + columns + press.compress(text[p:q][inside[p:q]].tobytes())))
            yield packed(out)

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        out = list(part.loc[part["kind"] == 1, ["chunk", "data"]].itertuples(index=False, name=None))
        if len(cut := part[part["kind"] == 4]):
            each = [_restored(x, "<u8", "<u8", "<i8", "<i8", "<i8") for x in cut["data"]]
            x, y, d, row, start = (np.concatenate(v) for v in zip(*each, strict=True))
            chunk = np.repeat(cut["chunk"].to_numpy(np.int64), [len(v[0]) for v in each])
            order, later = _covered_later(d, y, x)
            at = order[later]
            out += _ranges(chunk[at], row[at], start[at], start[at] + length)
        part = part[part["kind"] == 3]
        if len(part):
            out += _merged(part)
        return pd.DataFrame(out, columns=["chunk", "data"])

    def _merged(part: pd.DataFrame) -> list[tuple[int, bytes]]:
        each, contexts, unpack = [], [], zstandard.ZstdDecompressor().decompress
        for data in part["data"]:
            m = int.from_bytes(data[:4], "little")
            each.append(_restored(data[4 : 4 + m], "<i8", "<i4", "<i8", "<u2", "<u2"))
            raw, at = unpack(data[4 + m :]), np.concatenate([[0], np.cumsum(each[-1][3].astype(np.int64))]).tolist()
            contexts += [raw[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
        doc, row, begin, size, pos = (np.concatenate(v) for v in zip(*each, strict=True))
        chunk = np.repeat(part["chunk"].to_numpy(np.int64), [len(v[0]) for v in each])
        size, pos = size.astype(np.int64), pos.astype(np.int64)
        code, strings = pd.factorize(np.array([*contexts, None], object)[:-1])
        owner = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(owner, code, doc)
        first = doc == owner[code]
        found = [(chunk[~first], row[~first], begin[~first], (begin + size)[~first])]
        # only anchors with several contexts are merged
        anchor = np.empty(len(strings), np.int64)
        anchor[code] = pos
        gram, _ = pd.factorize(np.array([*(s[p : p + k] for s, p in zip(strings, anchor.tolist(), strict=True)), None], object)[:-1])
        several = np.flatnonzero(np.bincount(gram)[gram] > 1)
        several = several[np.argsort(gram[several], kind="stable")]
        new = np.flatnonzero(np.concatenate([[True], gram[several][1:] != gram[several][:-1]]))
        at, hits = 0, []
        while at < len(several):  # whole anchors
            i = np.searchsorted(new, at + _MERGED, "right") - 1
            to = int(new[i]) if new[i] > at else int(new[i + 1]) if i + 1 < len(new) else len(several)
            to = len(several) if len(several) - at <= _MERGED else to
            own = several[at:to]
            s, o = repeated_windows([strings[i] for i in own.tolist()], owner[own], length)
            hits.append((own[s], o))
            at = to
        if hits:
            s, o = (np.concatenate(v) for v in zip(*hits, strict=True))
            held = pd.DataFrame({"s": code[first], "chunk": chunk[first], "row": row[first], "begin": begin[first]})
            met = pd.DataFrame({"s": s, "o": o}).merge(held, on="s")
            start = (met["begin"] + met["o"]).to_numpy(np.int64)
            found.append((met["chunk"].to_numpy(np.int64), met["row"].to_numpy(np.int64), start, start + length))
        return _ranges(*(np.concatenate(v) for v in zip(*found, strict=True)))

    extracted = _marked(work, length, k, n, tasks).repartition(tasks).mapInArrow(released(extract), "kind int, bucket int, chunk long, data binary")
    return extracted.groupBy("bucket").applyInPandas(merge, "chunk long, data binary")


def _cut(docs: DataFrame, length: int) -> DataFrame:
    """(path, at, size, skip, ranges): the chunks of ``docs`` with all that is found in them."""
    work, n, tasks = stored(docs, length), 3 * buckets_for(docs), _tasks(docs)  # a bucket is a group that a task holds
    k = max(1, GRAM * length // LENGTH)
    ranges = _found(work, length, k, n, tasks).groupBy("chunk").agg(F.collect_list("data").alias("ranges"))  # no longer than a chunk's text
    return work.join(ranges, "chunk", "left").select("path", "at", "size", "skip", "ranges").repartition(tasks)


def _each(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[bytes | None, list[tuple[int, int]]]]]]:
    """Chunks, and for each of their rows the text and the ranges that go."""
    for told, piece in _loaded(batches):
        column = piece.column(piece.schema.get_field_index("text"))
        texts = [x.encode() if x is not None else None for x in column.to_pylist()]
        runs: list[list[tuple[int, int]]] = [[] for _ in texts]
        each = [_restored(x, "<i4", "<i8", "<i8") for x in told["ranges"] or []]
        if each:
            row, a, b = (np.concatenate(v) for v in zip(*each, strict=True))
            order = np.argsort(row, kind="stable")
            row, a, b = row[order], a[order], b[order]
            edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1], [True]])).tolist()
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                runs[row[i]] = list(zip(*(x.tolist() for x in _merge_runs(a[i:j], b[i:j])), strict=True))
        for i in told["skip"] or []:
            runs[i] = [(0, len(texts[i]))]
        yield piece, list(zip(texts, runs, strict=True))


def _kept(raw: bytes, runs: list[tuple[int, int]]) -> list[bytes]:
    pieces, at = [], 0
    for a, b in runs:
        pieces.append(raw[at:a])
        at = b
    return [*pieces, raw[at:]]


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs(doc_id, text)`` to (doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans array<struct<a, b>>).

    Texts are UTF-8 bytes of any length; null is empty. A byte is removed when a ``length``-byte string that covers it also
    starts in a document with a smaller doc_id; strings are judged on the input. Texts shorter than
    ``length`` lose nothing. Rows that repeat a doc_id don't repeat each other; each is judged by its own text.
    Rows with a null doc_id lose nothing and take nothing from others. An empty table gives no rows. Further
    columns are not read.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, rows in _each(batches, length):
            out = []
            for raw, runs in rows:
                digest = hashlib.sha256()
                for x in _kept(raw or b"", runs):
                    digest.update(x)
                out.append((len(raw or b""), sum(b - a for a, b in runs), len(runs), digest.hexdigest(), [{"a": a, "b": b} for a, b in runs]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
            yield pa.RecordBatch.from_arrays([piece.column(piece.num_columns - 1), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return _cut(docs.select("doc_id", "text"), length).mapInArrow(released(cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a:long,b:long>>")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` without the repeated bytes of ``text``; documents of which nothing is left go.

    Keeps the columns of ``docs``, whatever their names. Where a removed range begins or ends inside a character, the rest of
    that character goes too. Documents that lose nothing stay as they are, empty and null texts too. What is
    removed is as in ``repeats``. An empty table stays empty.
    """
    order, kinds = docs.columns, dict(docs.withColumn("text", F.col("text").cast("string")).dtypes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, rows in _each(batches, length):
            texts = [raw if not runs else b"".join(x.decode("utf-8", "ignore").encode() for x in _kept(raw, runs)) for raw, runs in rows]
            keep = [not runs or bool(x.strip()) for x, (_, runs) in zip(texts, rows, strict=True)]
            place = piece.schema.get_field_index("text")
            texts = pa.array([None if x is None else x.decode() for x in texts], pa.string())
            columns = [texts if i == place else c for i, c in enumerate(piece.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, piece.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))

    return _cut(docs, length).mapInArrow(released(cut), ", ".join(f"`{c}` {kinds[c]}" for c in order))
