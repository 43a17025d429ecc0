"""Best-fit packing of documents into sequences, planned on the counts of lengths.

Lengths are whole numbers up to the capacity, so a plan for the counts of each length is a plan for all
pieces, and no larger for more of them. Pieces above a third of the capacity go two to a sequence at most:
each, from the longest on, is matched with the longest that still fits. Shorter pieces, the longest
first, then go to the sequence with the smallest gap that holds them. A piece finds its place by its rank
among the pieces of its length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .session import released, written
from .tokens import encoded


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, first sequence, pieces in each, offset) and the number of sequences.

    A row holds the pieces of one length from its first rank on: so many in each of the sequences from the
    first on. There are at most a few rows for each length.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, sequences)
    left, used, total = dict(counts), dict.fromkeys(counts, 0), 0

    def place(length: int, first: int, bins: int, each: int, offset: int) -> None:
        rows.append((length, used[length], first, each, offset))
        used[length] += bins * each
        left[length] -= bins * each

    def leave(gap: int, first: int, bins: int) -> None:
        if gap and bins:
            gaps.setdefault(gap, []).append((first, bins))

    large = sorted(x for x in counts if 3 * x > capacity)
    while large:
        length = large[-1]
        if not left[length]:
            large.pop()
            continue
        k = bisect.bisect_right(large, capacity - length)
        while k and not left[large[k - 1]]:
            k -= 1
        mate = large[k - 1] if k else 0
        if mate == length:
            bins, each = (left[length] // 2, 2) if left[length] > 1 else (1, 1)
        else:
            bins, each = min(left[length], left[mate]) if mate else left[length], 1
        place(length, total, bins, each, 0)
        if mate and mate != length:
            place(mate, total, bins, 1, length)
        leave(capacity - length * each - (mate if mate != length else 0), total, bins)
        total += bins
    for length in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        fitting = sorted(g for g in gaps if g >= length)
        for gap in fitting:
            while left[length] and gaps.get(gap):
                first, bins = gaps[gap].pop()
                each = gap // length
                full = min(bins, left[length] // each)
                if full:
                    place(length, first, full, each, capacity - gap)
                    leave(gap - each * length, first, full)
                first, bins = first + full, bins - full
                if bins and left[length]:
                    rest = left[length]
                    place(length, first, 1, rest, capacity - gap)
                    leave(gap - rest * length, first, 1)
                    first, bins = first + 1, bins - 1
                leave(gap, first, bins)
                if not left[length]:
                    break
        each = capacity // length
        if bins := left[length] // each:
            place(length, total, bins, each, 0)
            leave(capacity - each * length, total, bins)
            total += bins
        if rest := left[length]:
            place(length, total, 1, rest, 0)
            leave(capacity - rest * length, total, 1)
            total += 1
    return np.array(sorted(rows), np.int64).reshape(-1, 5), total


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids binary): ids of each document and ``end_id``, cut at ``capacity``."""
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for first, texts in encoded(batch, path):
                rows = []
                for i, ids in enumerate(texts):
                    ids += end
                    rows += [(names[first + i], at // step, at // 4, min(step, len(ids) - at) // 4, zlib.crc32(part := ids[at : at + step]), part) for at in range(0, len(ids), step)]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(cut), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """``items`` (a table that reads the same each time) with sequence_id and offset added.

    Needs length (1 to ``capacity``; other rows go to an error) and doc_id, piece, which order equal lengths.
    Counts of lengths, at most ``capacity`` of them, are all that the driver sees.
    """
    counts = {int(r.length): r.n for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 0 < x <= capacity for x in counts):
        raise ValueError(f"lengths must be 1 to {capacity}")
    rows, _ = plan(counts, capacity)
    share = max(64, sum(counts.values()) // 100_000)
    dealt = items.withColumn("_share", F.pmod(F.hash("doc_id", "piece"), F.lit(share)))
    before = dealt.groupBy("length", "_share").agg(F.count("*").alias("n"))
    before = before.select("length", "_share", (F.sum("n").over(Window.partitionBy("length").orderBy("_share")) - F.col("n")).alias("_before"))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_share").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before, ["length", "_share"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_share", "_before")
    columns = [c for c in items.columns]
    kinds = dict(items.dtypes)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = rows[:, 0] << 48 | rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "_rank"))
            at = rows[np.searchsorted(key, length << 48 | rank, "right") - 1]
            sequence, place = np.divmod(rank - at[:, 1], at[:, 3])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(at[:, 2] + sequence), pa.array(at[:, 4] + place * length)], [*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(released(settle), ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` to one row for each piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A document is the ids of its whole text (null: empty) and ``end_id``; only longer ones than ``capacity`` are
    cut. ``with_ids`` adds the piece's ids (little-endian, 32 bits). Null and repeated doc_ids
    are packed like others; ties of all columns may change places. An empty table gives no rows. Further
    columns are not read.
    """
    cut = pieces(docs, path, end_id, capacity)
    return pack(written(cut if with_ids else cut.drop("ids"), "pieces"), capacity)
