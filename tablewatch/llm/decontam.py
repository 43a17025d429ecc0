"""Benchmark decontamination: a broadcast set of test n-grams, scanned for in every training window."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import text as tx
from .session import released, written

#: A slice of the benchmark holds at most so many bytes of text; longer benchmarks are scanned for slice by slice.
SLICE_BYTES = 16 << 20


class Windows:
    """The windows of one slice of the benchmark: by length, sorted hashes with where each window stands, in flat arrays.

    Lowered words are kept in one buffer, a NUL between them (no word holds one), so a window is a run of its bytes.
    """

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        said, start, end, owner, hashes, first, at = [], [], [], [], [], [0], 0
        for a, _, data, offsets in tx.slices(pa.array([t for _, t in items], pa.string())):
            h, s, e, f = tx.word_hashes(data, offsets, tx.ALNUM)
            # each word behind the one before it, whatever stood between them
            sizes = e - s
            to = np.cumsum(sizes + 1) - sizes - 1
            flat = np.zeros(int((sizes + 1).sum()), np.uint8)
            inside = np.repeat(to - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(s) else s
            flat[inside] = tx.ALNUM[data][np.repeat(s - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())] if len(s) else s
            said.append(flat)
            start.append(to + at)
            end.append(to + sizes + at)
            owner.append(a + np.repeat(np.arange(len(f) - 1), np.diff(f)))
            hashes.append(h)
            first += (f[1:] + first[-1]).tolist()
            at += len(flat)
        self.ids, self.text, self.by_width = [str(i) for i, _ in items], b"".join(x.tobytes() for x in said), {}
        if not said:
            return
        start, end, owner, hashes = (np.concatenate(x) for x in (start, end, owner, hashes))
        lengths = np.diff(first)
        for n in np.unique(np.minimum(lengths[lengths > 0], width)).tolist():
            at = np.arange(len(hashes) - n + 1)
            at = at[(owner[at] == owner[at + n - 1]) & (np.minimum(lengths[owner[at]], width) == n)]
            keys = tx.window_hashes(hashes, n)[at]
            order = np.argsort(keys, kind="stable")
            keys, at = keys[order], at[order]
            gate = np.zeros(1 << 20, bool)
            gate[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.by_width[n] = (keys, gate, start[at], end[at + n - 1], owner[at].astype(np.int32))

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]], set[str], list[tuple[int, int]]]]:
        """For each text: words, hit runs of words, the items met, hit runs as byte spans."""
        h, start, end, first = tx.word_hashes(data, offsets, tx.ALNUM)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        raw = None
        runs: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[int]] = {}
        for n, (keys, gate, begin, stop, owner) in self.by_width.items():
            w = tx.window_hashes(h, n)
            at = np.flatnonzero(gate[(w & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = at[doc[at] == doc[at + n - 1]]
            low, high = np.searchsorted(keys, w[at]), np.searchsorted(keys, w[at], "right")
            some = low < high
            for i, p, q in zip(at[some].tolist(), low[some].tolist(), high[some].tolist(), strict=True):
                raw = raw or tx.ALNUM[data].tobytes()
                said = b"\0".join(raw[a:b] for a, b in zip(start[i : i + n].tolist(), end[i : i + n].tolist(), strict=True))
                met = {int(owner[k]) for k in range(p, q) if self.text[begin[k] : stop[k]] == said}
                if met:
                    runs.setdefault(int(doc[i]), []).append((i, i + n))
                    items.setdefault(int(doc[i]), set()).update(met)
        for d in range(len(offsets) - 1):
            joined = _union(runs.get(d, []))
            base = int(first[d])
            yield int(first[d + 1]) - base, [(a - base, b - base) for a, b in joined], {self.ids[k] for k in items.get(d, ())}, [(int(start[a] - offsets[d]), int(end[b - 1] - offsets[d])) for a, b in joined]


def _slices(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark in lists of at most ``limit`` bytes of text (or one item), read one partition at a time."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("i is not null").toLocalIterator():
        n = len(row.t.encode()) if row.t else 0
        if held and size + n > limit:
            yield held
            held, size = [], 0
        held.append((row.i, row.t))
        size += n
    yield held


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: What is found in a row: its words, hit runs of words, items met, hit runs as byte spans.
_FOUND = [pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.list_(pa.string()), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))]


def _scanned(docs: DataFrame, benchmark: DataFrame, width: int, slice_bytes: int, finish: Callable, kinds: str) -> DataFrame:
    """What ``finish`` makes of each run of rows and of what all slices of the benchmark together hit in them.

    finish(rows, words, runs, items, spans) -> record batch of ``kinds``. Rows are scanned for one slice at a time; between slices
    they are written, so that one slice at a time is broadcast. The last scan finishes.
    """
    spark, n_columns, place = docs.sparkSession, len(docs.columns), docs.columns.index("text")
    # what was found travels behind the columns of docs, under names that these don't have
    free = [_free(docs, x) for x in ("words", "runs", "items", "spans")]
    between = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), *(f"`{c}` {t}" for c, t in zip(free, ("long", "array<struct<a:long,b:long>>", "array<string>", "array<struct<a:long,b:long>>"), strict=True))])
    out, held = docs, None

    def scanned(rows: DataFrame, items: list[tuple[str, str | None]], last: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(Windows(items, width))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, data, offsets in tx.slices(batch.column(place)):
                    part = batch.slice(a, b - a)
                    n, runs, items, spans = (list(x) for x in zip(*shared.value.scan(data, offsets), strict=True))
                    if batch.num_columns > n_columns:  # what earlier slices found
                        pairs = lambda i: [[(s["a"], s["b"]) for s in x] for x in part.column(n_columns + i).to_pylist()]
                        runs = [_union(x + y) for x, y in zip(runs, pairs(1), strict=True)]
                        spans = [_union(x + y) for x, y in zip(spans, pairs(3), strict=True)]
                        items = [x | set(y) for x, y in zip(items, part.column(n_columns + 2).to_pylist(), strict=True)]
                    columns = part.columns[:n_columns]
                    if last:
                        yield finish(columns, n, runs, [sorted(x) for x in items], spans)
                    else:
                        struct = lambda xs: [[{"a": i, "b": j} for i, j in x] for x in xs]
                        found = [pa.array(x, k) for x, k in zip((n, struct(runs), [sorted(x) for x in items], struct(spans)), _FOUND, strict=True)]
                        yield pa.RecordBatch.from_arrays([*columns, *found], [*batch.schema.names[:n_columns], *free])

        found = rows.mapInArrow(released(scan), kinds if last else between)
        if not last:
            found = written(found, "scanned")
            shared.destroy()
        return found

    for items in _slices(benchmark, slice_bytes):
        if held is not None:
            out = scanned(out, held, last=False)
        held = items
    return scanned(out, held, last=True)


def _free(docs: DataFrame, name: str) -> str:
    """``name``, or one like it that is no column of ``docs``, case aside."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``docs(doc_id, text)`` and ``benchmark(item_id, text)`` to one row for each row of ``docs``:
    (doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text, spans array<struct<a, b>>).

    Words are runs of ASCII digits and letters (A-Z lowered) and of anything outside ASCII. A window is
    ``width`` consecutive words of an item, or all of an item with fewer. Words inside any occurrence of
    a window are hit; spans are the hit runs as UTF-8 byte ranges of the text, ends excluded. Texts may be of any length.

    What is broadcast holds at most ``slice_bytes`` of benchmark text, and some five times that in all; a longer benchmark takes one
    scan for each slice, with the rows written between, so hits of all slices add up. Null and empty texts have no
    words. Items without words, or with a null item_id, are in no document; repeated items count once
    for each distinct id. A null doc_id is carried along, repeated rows are judged alike. An empty table of documents gives no
    rows, an empty benchmark no hits. Further columns are not read.
    """

    def finish(columns: list[pa.Array], n: list, runs: list, items: list, spans: list) -> pa.RecordBatch:
        hit = [sum(b - a for a, b in r) for r in runs]
        digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        told = [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digests, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())]
        return pa.RecordBatch.from_arrays([columns[0], *told, columns[1], pa.array([[{"a": a, "b": b} for a, b in x] for x in spans], _FOUND[3])], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "text", "spans"])

    kinds = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, text string, spans array<struct<a:long,b:long>>"
    return _scanned(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), benchmark, width, slice_bytes, finish, kinds)


def cut_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    if not spans:
        return text
    raw, out, at = text.encode(), [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]]).decode("utf-8", "ignore")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, drop_share: float = 0.5) -> DataFrame:
    """``docs`` with hit spans cut out of ``text``; documents with a ``drop_share`` of their words hit go.

    Keeps the columns of ``docs``, whatever their names. Documents without a hit stay as they are, null and empty texts too. doc_id
    need not be unique, nor be there: hits are found and cut row by row, on the whole text and for all of the benchmark at once,
    however many slices it takes. An empty table stays empty, an empty benchmark changes nothing.
    """
    rows = docs.withColumn("text", F.col("text").cast("string"))
    place, names = docs.columns.index("text"), docs.columns

    def finish(columns: list[pa.Array], n: list, runs: list, items: list, spans: list) -> pa.RecordBatch:
        hit = [sum(b - a for a, b in r) for r in runs]
        keep = [not h or h < drop_share * m for h, m in zip(hit, n, strict=True)]
        cut = columns[place]
        if any(hit):
            cut = pa.array([cut_spans(text, x) for text, x in zip(cut.to_pylist(), spans, strict=True)], pa.string())
        columns = [cut if i == place else c for i, c in enumerate(columns)]
        return pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    return _scanned(rows, benchmark, width, SLICE_BYTES, finish, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes))
