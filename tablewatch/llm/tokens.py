"""Token ids as files: a zstandard dictionary for all, one frame for each document, and an offset index.

A shard is ``MAGIC``, the bytes of an id (2 or 4), the SHA-256 of the dictionary, the frames, then the index
(doc_id, frame offset, frame size, ids; one int64 row each, null ids flagged) and a footer. Short documents are
read alone: index, one frame, dictionary.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import text as tx
from .session import buckets_for, fresh_dir, written

MAGIC = b"TWIDS001"
_FOOTER = struct.Struct("<qqq8s")
#: A shard is closed once its frames reach this size.
SHARD_BYTES = 32 << 20
DICTIONARY_BYTES, SAMPLE_DOCUMENTS, SAMPLE_IDS = 64 << 10, 1000, 4096
_CACHE = 500_000

# -- encoding ---------------------------------------------------------------------------------------

_SPACE, _LETTER, _DIGIT, _OTHER, _UNUSUAL = range(5)


def _classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character: white space, letter, digit, other.

    Only characters up to U+024F and common punctuation are told apart; the rest is unusual.
    """
    table = np.full(256, _UNUSUAL, np.uint8)
    table[0x21:0x7F] = _OTHER
    table[[0x09, 0x0A, 0x0D, 0x20]] = _SPACE
    table[0x30:0x3A] = _DIGIT
    table[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)]] = _LETTER
    out = table[data]
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        byte, second, third = padded[lead], padded[lead + 1], padded[lead + 2]
        kind = out[lead]
        latin = byte == 0xC2
        kind[latin] = np.where(np.isin(second, [0xAA, 0xB5, 0xBA]), _LETTER, np.where((second <= 0xA0) | np.isin(second, [0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]), _UNUSUAL, _OTHER))[latin]
        kind[(byte == 0xC3) & ((second == 0x97) | (second == 0xB7))] = _OTHER
        kind[(byte == 0xC4) & (second == 0xB0)] = _UNUSUAL
        wide = (byte == 0xE2) & (((second == 0x80) & (third >= 0x90) & (third <= 0xA7)) | ((second == 0x82) & (third == 0xAC)))
        kind[wide] = _OTHER
        out[lead] = kind
        out[lead + 1] = kind
        out[lead[wide] + 2] = kind[wide]
    return out


class Encoder:
    """Whole texts to ids by the tokenizers library.

    A tokenizer works on each piece that its pre-tokenizer cuts on its own. So texts of usual characters are
    cut in bulk, by the pre-tokenizer's rules on byte classes; each piece is encoded when it first comes
    and kept in a cache of bounded size. Texts with other characters, or with a special token's string, and
    tokenizers with another pre-tokenizer are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec.get("pre_tokenizer") or {}
        self.special = [t["content"].encode() for t in spec.get("added_tokens", ())]
        self.kind = None
        if cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not spec.get("normalizer"):
            self.kind, self.separator = "byte", self.tokenizer.encode("\n", add_special_tokens=False).ids
        elif [x.get("type") for x in cut.get("pretokenizers", ())] == ["Split", "ByteLevel"] and [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", ())] == ["NFC", "Replace", "Lowercase"] and spec["model"].get("end_of_word_suffix"):
            self.kind, suffix = "word", spec["model"]["end_of_word_suffix"]
            self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.last[[i for x, i in self.tokenizer.get_vocab().items() if x.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.edge, self.ids, self.n_ids = np.zeros(1, np.int64), np.zeros(1 << 16, np.uint32), 0

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of single pieces and how many each has; encoded together where their ends can be told."""
        if self.kind == "word":
            ids = self._whole([" ".join(texts)])[0]
            ends = np.flatnonzero(self.last[ids]) + 1
        else:
            ids = self._whole(["\n".join([*texts, ""])])[0]
            ends = np.flatnonzero(ids == self.separator[0]) + 1
        if len(ends) != len(texts) or (len(ends) and ends[-1] != len(ids)):
            parts = self._whole(texts)
            return np.concatenate(parts), np.array([len(x) for x in parts])
        size = np.diff(ends, prepend=0)
        return (ids, size) if self.kind == "word" else (ids[ids != self.separator[0]], size - 1)

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        blank = np.fromiter(map(str.isspace, texts), bool, len(texts))
        order = np.argsort(blank, kind="stable")  # white space is encoded piece by piece
        texts, joint = [texts[i] for i in order.tolist()], int(np.count_nonzero(~blank))
        found = [self._new(texts[at : min(at + 2048, joint)]) for at in range(0, joint, 2048)]
        found += [(x, np.array([len(x)])) for x in self._whole(texts[joint:])]
        flat, size = (np.concatenate(x) for x in zip(*found, strict=True))
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        slots = np.empty(len(order), np.int64)
        slots[order] = np.arange(len(self.edge) - 1, len(self.edge) - 1 + len(order))
        self.edge = np.concatenate([self.edge, self.n_ids + np.cumsum(size)])
        self.n_ids += len(flat)
        at = np.searchsorted(self.keys, hashes)
        self.keys, self.slots = np.insert(self.keys, at, hashes), np.insert(self.slots, at, slots)

    def _cuts(self, data: np.ndarray, low: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Where pieces begin, for texts that are not empty."""
        n, space = len(data), kind == _SPACE
        blank = data == 0x20
        begin = np.zeros(n + 1, bool)
        begin[offsets] = True
        cut = begin[:n].copy()
        same = np.zeros(n, bool)
        same[1:] = kind[1:] == kind[:-1]
        cut |= ~same
        if self.kind == "word":
            cut |= (kind == _DIGIT)
        else:
            after = np.zeros(n, bool)  # a blank goes with what follows it
            after[1:] = blank[:-1] & ~begin[1:n]
            cut &= ~(after & ~space) | begin[:n]
            last = space.copy()  # the last of several white spaces stands apart, unless it ends the text
            last[:-1] &= ~space[1:]
            last &= ~begin[1:]
            cut |= last
        quote = np.flatnonzero((data == 0x27) & cut)
        if len(quote):
            row_end = offsets[np.searchsorted(offsets, quote, "right")]
            padded = np.concatenate([low, np.zeros(2, np.uint8)])
            one, two = padded[quote + 1], padded[quote + 2]
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & (quote + 1 < row_end)
            pair = (((one == 0x72) | (one == 0x76)) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
            pair &= quote + 2 < row_end
            for at, size in ((quote[short], 2), (quote[pair & ~short], 3)):
                cut[at + 1] = False
                cut[at[at + size < n] + size] = True
        return np.flatnonzero(cut)

    def _bulk(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin) of texts that are not empty and have usual characters."""
        low = data
        if self.kind == "word":
            table = np.arange(256, dtype=np.uint8)
            table[65:91] += 32
            low = table[data]
        start = self._cuts(data, low, offsets, kind)
        end = np.append(start[1:], len(data))
        if self.kind == "word":
            said = kind[start] != _SPACE
            start, end = start[said], end[said]
        hashes, first, which = np.unique(tx.span_hash(tx.prefix_hash(low), start, end), return_index=True, return_inverse=True)
        if len(self.keys) > _CACHE:
            self.clear()
        at = np.searchsorted(self.keys, hashes)
        fresh = np.ones(len(hashes), bool)
        fresh[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] != hashes[at < len(self.keys)]
        if fresh.any():
            raw, new = low.tobytes(), first[fresh]
            self._learn(hashes[fresh], [raw[i:j].decode() for i, j in zip(start[new].tolist(), end[new].tolist(), strict=True)])
            at = np.searchsorted(self.keys, hashes)
        slot = self.slots[at][which]
        size = self.edge[slot + 1] - self.edge[slot]
        edge = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.edge[slot] - edge[:-1], size) + np.arange(edge[-1])]
        return ids, edge[np.searchsorted(start, offsets)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Little-endian 32-bit ids of each UTF-8 text."""
        n, sizes = len(offsets) - 1, np.diff(offsets)
        whole = np.full(n, self.kind is None)
        kind = _classes(data) if self.kind else np.zeros(len(data), np.uint8)
        odd = np.flatnonzero(kind == _UNUSUAL)
        whole[np.searchsorted(offsets, odd, "right") - 1] = True
        raw = data.tobytes()
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                whole[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(s, at + 1)
        out = [b""] * n
        some = np.flatnonzero(~whole & (sizes > 0))
        if len(some):
            keep = np.repeat(~whole, sizes)
            ids, edge = self._bulk(data[keep] if whole.any() else data, np.concatenate([[0], np.cumsum(sizes[some])]), kind[keep] if whole.any() else kind)
            packed, edge = ids.astype("<u4").tobytes(), (4 * edge).tolist()
            for i, a, b in zip(some.tolist(), edge[:-1], edge[1:], strict=True):
                out[i] = packed[a:b]
        for i in np.flatnonzero(whole & (sizes > 0)).tolist():
            out[i] = self._whole([raw[offsets[i] : offsets[i + 1]].decode()])[0].astype("<u4").tobytes()
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    if path not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(batch: pa.RecordBatch, path: str) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, ids of each row) for runs of rows; null counts as empty."""
    for first, _, data, offsets in tx.slices(batch.column("text")):
        yield first, encoder(path).encode(data, offsets)


# -- files ------------------------------------------------------------------------------------------


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def dictionary_of(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or the samples' end where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return (b"".join(samples)[-size:] or b"\0" * 8).ljust(8, b"\0")


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(raw)


class ShardWriter:
    def __init__(self, folder: str, name: str, width: int, dictionary: bytes):
        self.fs, path = _open(folder)
        self.uri, self.path, self.part = f"{folder}/{name}", f"{path}/{name}", f"{path}/.{name}.part"
        self.dtype = "<u2" if width == 2 else "<u4"
        self.press = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(dictionary))
        self.fs.create_dir(path, recursive=True)
        self.out = self.fs.open_output_stream(self.part)
        self.at = self.out.write(MAGIC + struct.pack("<q", width) + hashlib.sha256(dictionary).digest())
        self.at = len(MAGIC) + 8 + 32
        self.index: list[tuple[int, int, int, int, int]] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        array = np.frombuffer(ids, "<u4").astype(self.dtype)
        frame = self.press.compress(array.tobytes())
        self.out.write(frame)
        self.index.append((doc_id or 0, doc_id is None, self.at, len(frame), len(array)))
        self.at += len(frame)
        self.tokens += len(array)

    def close(self) -> tuple[str, int, int]:
        """(path, documents, ids). The file takes its name only when it is whole."""
        self.out.write(np.array(self.index, "<i8").reshape(-1, 5).tobytes() + _FOOTER.pack(self.at, len(self.index), self.tokens, MAGIC))
        self.out.close()
        self.fs.move(self.part, self.path)
        return self.uri, len(self.index), self.tokens


class ShardReader:
    def __init__(self, uri: str, dictionary: bytes):
        fs, path = _open(uri)
        self.file = fs.open_input_file(path)
        head = self.file.read_at(len(MAGIC) + 40, 0)
        start, n, self.tokens, end = _FOOTER.unpack(self.file.read_at(_FOOTER.size, self.file.size() - _FOOTER.size))
        if head[:8] != MAGIC or end != MAGIC:
            raise ValueError(f"{uri} is no shard of token ids")
        if head[16:48] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} was written with another dictionary")
        self.dtype = "<u2" if struct.unpack("<q", head[8:16])[0] == 2 else "<u4"
        self.index = np.frombuffer(self.file.read_at(n * 40, start), "<i8").reshape(-1, 5)
        self.press = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def __len__(self) -> int:
        return len(self.index)

    def __getitem__(self, i: int) -> tuple[int | None, np.ndarray]:
        doc_id, null, at, size, n = self.index[i].tolist()
        raw = self.press.decompress(self.file.read_at(size, at), max_output_size=max(1, n * int(self.dtype[-1])))
        return None if null else doc_id, np.frombuffer(raw, self.dtype)

    def document(self, doc_id: int) -> np.ndarray:
        """The ids of one document, from its own frame."""
        return self[int(np.flatnonzero((self.index[:, 0] == doc_id) & (self.index[:, 1] == 0))[0])][1]


def sample_ids(docs: DataFrame, path: str, end_id: int, documents: int = SAMPLE_DOCUMENTS) -> list[bytes]:
    """Serialized ids of about ``documents`` documents spread by a hash of doc_id; 4096 ids of each at most.

    Only the dictionary depends on them, not what is written with it.
    """
    every = max(1, docs.count() // documents)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows in encoded(batch, path):
                yield pa.RecordBatch.from_arrays([pa.array([x[: 4 * SAMPLE_IDS] for x in rows], pa.binary())], ["ids"])

    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select(F.col("text").cast("string"))
    return [r.ids for r in chosen.limit(2 * documents).mapInArrow(ids, "ids binary").collect()]


def write_ids(docs: DataFrame, path: str, end_id: int, folder: str | None = None) -> tuple[DataFrame, bytes]:
    """Write ``docs(doc_id, text)`` as shards in ascending doc_id order; returns (manifest, dictionary).

    manifest: (path, part, file, documents, tokens, start), start being the ids in all shards before. The
    tokenizer of file ``path`` encodes whole texts (null: empty), ``end_id`` closes each document. A null
    doc_id stands first; repeated ids keep a row each. An empty table gives an empty manifest. Further
    columns are not read. A task that runs again writes a new file; only those of the attempt that
    ended well are in the manifest.
    """
    spark = docs.sparkSession
    folder = folder or fresh_dir(spark, "token-ids")
    end, width = np.array([end_id], "<u4").tobytes(), 2 if max(encoder(path).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    dtype = "<u2" if width == 2 else "<u4"
    samples = [np.frombuffer(x, "<u4").astype(dtype).tobytes() for x in sample_ids(docs, path, end_id)]
    dictionary = dictionary_of([x for x in samples if len(x) > 64])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, files, shard = TaskContext.get().partitionId(), [], None
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for first, rows in encoded(batch, path):
                for i, x in enumerate(rows):
                    shard = shard or ShardWriter(folder, f"part-{part:06d}-{len(files):04d}-{uuid.uuid4().hex[:8]}.ids", width, dictionary)
                    shard.add(names[first + i], x + end)
                    if shard.at >= SHARD_BYTES:
                        files.append(shard.close())
                        shard = None
        if shard:
            files.append(shard.close())
        if files:
            paths, docs, tokens = zip(*files, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array([part] * len(files), pa.int32()), pa.array(range(len(files)), pa.int32()), pa.array(docs, pa.int64()), pa.array(tokens, pa.int64())], ["path", "part", "file", "documents", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = rows.repartitionByRange(buckets_for(rows), "doc_id").sortWithinPartitions("doc_id")
    manifest = written(ordered.mapInArrow(write, "path string, part int, file int, documents long, tokens long"), "manifest")
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long"))), dictionary


def read_ids(manifest: DataFrame, dictionary: bytes, with_ids: bool = False) -> DataFrame:
    """Shards back to (doc_id, start, n_tokens, ids_crc32) and, if asked for, ids array<int>."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard = ShardReader(uri, dictionary)
                for a in range(0, len(shard), 1000):
                    out = []
                    for i in range(a, min(a + 1000, len(shard))):
                        doc_id, ids = shard[i]
                        out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.astype(np.int32) if with_ids else None))
                        start += len(ids)
                    columns = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    spark: SparkSession = manifest.sparkSession
    rows = manifest.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")
    return rows if with_ids else rows.drop("ids")
