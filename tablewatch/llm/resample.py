"""Importance resampling towards a target: n-gram features hashed into buckets, and a draw without replacement.

A feature's bucket is its CRC-32. CRCs are linear: that of two strings in a row is that of the first, carried on over
as many zero bytes as the second has, xor that of the second. So every word's CRC is computed once, and those of longer runs follow from
a few table lookups for whole batches. Corpus and target are counted by bucket; what the driver sees are the buckets.

Scores are written once. The cutoff of the draw is found by bisection on numbers: each step counts, over the written scores, how
many rows lie at or below some thresholds, first of the score, then of the doc_id among rows tied there. Nothing is sorted but
the rows drawn, which are range-partitioned for their ranks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import text as tx
from .session import written

BUCKETS, LONGEST, LEAST_WORDS, PERCENT = 10_000, 3, 20, 5
#: Thresholds that one count job tries.
TRIED = 15

_BYTE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _BYTE = np.where(_BYTE & 1, (_BYTE >> 1) ^ np.uint32(0xEDB88320), _BYTE >> 1).astype(np.uint32)


def _carry(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


def _zeros() -> np.ndarray:
    """[n, k, b]: byte b at place k of a CRC, after n zero bytes, for n below 256."""
    out = np.empty((256, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(1, 256):
        out[n] = _BYTE[out[n - 1] & 255] ^ (out[n - 1] >> 8)
    return out


_ZEROS = _zeros()
_FLAT = _ZEROS.reshape(-1)
#: After 256 zero bytes, 512, 1024 and so on.
_FAR = [_BYTE[_ZEROS[255] & 255] ^ (_ZEROS[255] >> 8)]


def after_zeros(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC registers after ``n`` zero bytes each."""
    at = (n & 255) << 10
    out = _FLAT[at + (crc & 255)] ^ _FLAT[at + 256 + (crc >> 8 & 255)] ^ _FLAT[at + 512 + (crc >> 16 & 255)] ^ _FLAT[at + 768 + (crc >> 24)]
    left, k = n >> 8, 0
    while left.any():
        if k == len(_FAR):
            _FAR.append(_carry(_FAR[-1], _FAR[-1]))
        odd = np.flatnonzero(left & 1)
        out[odd] = _carry(_FAR[k], out[odd])
        left, k = left >> 1, k + 1
    return out


def word_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of the bytes of each [start, end)."""
    size = end - start
    order = np.argsort(size, kind="stable")
    size, at = size[order], start[order]
    few = int(np.searchsorted(size, 64, "right"))
    crc, out = np.full(few, 0xFFFFFFFF, np.uint32), np.empty(len(order), np.uint32)
    for j in range(int(size[few - 1]) if few else 0):
        i = int(np.searchsorted(size[:few], j, "right"))
        crc[i:] = _BYTE[(crc[i:] ^ data[at[i:few] + j]) & 255] ^ (crc[i:] >> 8)
    out[order[:few]] = ~crc
    for i in range(few, len(order)):
        out[order[i]] = zlib.crc32(data[at[i] : at[i] + size[i]])
    return out


def _runs(data: np.ndarray, offsets: np.ndarray, longest: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """First word of each text (n + 1 values), and for each length the words where a run begins and the runs' CRCs."""
    start, end, first = tx.words(data, offsets, tx.separator_mask(tx.ALNUM))
    crc = word_crcs(tx.ALNUM[data], start, end)
    last = np.repeat(first[1:], np.diff(first))  # the word after the text's last
    step = end - start + 1
    spaced = after_zeros(np.full(len(crc), zlib.crc32(b" "), np.uint32), end - start) ^ crc
    found, run = [(np.arange(len(crc)), crc)], crc
    for n in range(1, longest):
        at = np.arange(max(0, len(crc) - n))
        run = after_zeros(run[: len(at)], step[n:]) ^ spaced[n:]
        whole = at + n < last[: len(at)]
        found.append((at[whole], run[whole]))
    return first, found


def bucket_counts(docs: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """How many runs of 1 to ``longest`` words of all texts fall in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in tx.slices(batch.column(0)):
                for _, crc in _runs(data, offsets, longest)[1]:
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "n"])

    rows = docs.select(F.col("text").cast("string")).where("text is not null").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in rows.collect():  # at most ``buckets`` rows
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of how much more frequent the target has each bucket than the corpus), each count one higher."""
    of, to = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1) * of / ((s + 1) * to))) for s, t in zip(corpus.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """``docs(doc_id, text, ...)`` with n_words, n_features and weight, the sum of the gains of a text's runs of words; other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # as long as there are buckets
    columns = docs.columns

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = shared.value
        for batch in batches:
            for a, b, data, offsets in tx.slices(batch.column("text")):
                first, runs = _runs(data, offsets, longest)
                own = np.zeros(first[-1] + 1, np.int64)  # of the runs that begin before each word
                for at, crc in runs:
                    own[at + 1] += value[crc % np.uint32(len(value))]
                whole, n = np.cumsum(own), np.diff(first)
                features = sum(np.maximum(n - k, 0) for k in range(longest))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in columns), pa.array(n), pa.array(features), pa.array(np.diff(whole[first]))], [*columns, "n_words", "n_features", "weight"])

    kinds = ", ".join([*(f"`{c}` {k}" for c, k in docs.dtypes), "n_words long, n_features long, weight long"])
    return docs.mapInArrow(weigh, kinds)


def kth(rows: DataFrame, keys: list[str], k: int) -> list[int]:
    """The ``k``-th smallest (from 1) of the tuples of ``keys``, which are longs, of a written table with ``k`` rows at least.

    Column by column, thresholds are tried by exact counts over the rows that tie in the columns before, until one value is left.
    """
    found: list[int] = []
    for key in keys:
        low, high = rows.agg(F.min(key), F.max(key)).first()
        below = 0  # rows under low
        while low < high:
            step = max(1, -(-(high - low) // (TRIED + 1)))
            tried = list(range(low + step - 1, high, step))
            counts = rows.where(F.col(key).between(low, high)).agg(*[F.count_if(F.col(key) <= t) for t in tried]).first()
            i = next((i for i, n in enumerate(counts) if below + n >= k), len(tried))
            if i < len(tried):
                high = tried[i]
            if i:
                low, below = tried[i - 1] + 1, below + counts[i - 1]
        found.append(low)
        k -= below
        rows = rows.where(F.col(key) == low)
    return found


def _up_to(keys: list[str], limit: list[int]) -> Column:
    """Whether the tuple of ``keys`` is at most ``limit``."""
    out = F.col(keys[-1]) <= limit[-1]
    for key, value in zip(keys[-2::-1], limit[-2::-1], strict=True):
        out = (F.col(key) < value) | ((F.col(key) == value) & out)
    return out


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with rank from 1 in the order of ``keys``: partitions by range, sorted, and counted before they are numbered."""
    placed = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "in-order")
    part = F.shiftright("_at", 33).alias("_part")
    counts = placed.groupBy(part).agg(F.count("*").alias("_n"))  # a row for each partition
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    joined = placed.withColumn("_part", part).join(F.broadcast(before), "_part")
    return joined.withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_before", "_at")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: str = "42", with_text: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` drawn towards ``target(text)``: (doc_id, n_features, weight, score, rank), one row for each row.

    Words are runs of digits, letters and anything outside ASCII, with A-Z lowered. weight: see ``weighed``. score adds Gumbel noise that
    the doc_id decides, so the highest scores are a draw without replacement. Of the rows with a doc_id and
    ``least_words`` words, floor(``percent`` * rows / 100) are drawn; rank counts them from the highest score (ties: the smaller doc_id, then the
    fewer features), and is null for the others. ``with_text`` adds text.

    Null and empty texts have no features and weight 0. Rows without a doc_id have no score, are never drawn and not counted. Rows that
    repeat a doc_id are drawn one by one; equal rows take the ranks that they share in any order. Texts may be of any
    length. An empty table gives no rows; an empty target counts nothing. Further columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    rows = weighed(docs, gain, longest).withColumn("score", F.col("weight") + noise)
    # the last key tells rows apart that tie in all others, so that a third of all rows may tie
    rows = rows.withColumns({"rank": F.lit(None).cast("long"), "_loss": -F.col("score"), "_row": F.monotonically_increasing_id()})
    rows = written(rows if with_text else rows.drop("text"), "scores")
    keys = ["_loss", "doc_id", "n_features", "_row"]
    may = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    drawn = percent * rows.where(may).count() // 100
    if drawn:
        chosen = may & _up_to(keys, kth(rows.where(may).select(*keys), keys, drawn))
        rows = ranked(rows.where(chosen).drop("rank"), keys).unionByName(rows.where(~F.coalesce(chosen, F.lit(False))))
    return rows.select("doc_id", "n_features", "weight", "score", "rank", *(["text"] if with_text else []))
