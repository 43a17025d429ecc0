"""Nearest neighbours by a block matrix join over int8 tiles, with bounds that keep the result exact.

Each vector is a scale times int8 numbers plus a remainder of known length. The product of two tiles of
int8 numbers tells every inner product up to |scaled x| |rest y| + |rest x| |y|. A candidate is recomputed in
double precision only where its upper bound reaches the k-th lower bound of its query. Queries meet
candidates in pairs of blocks, so neither side has to fit in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .session import written

QUERY_BLOCK, CANDIDATE_BLOCK = 512, 4096
#: Candidate blocks whose heaps meet first; what is left of them meets then.
MERGED = 64


def _usable(vector: str) -> Column:
    """Neither null nor zero, and all components finite."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0)


def _quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 numbers, scale, length of the scaled numbers and of the remainder (a little more, for rounding)."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1  # the least numbers have no 127th part
    q = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    near = q * scale[:, None]
    return q, scale, np.sqrt((near * near).sum(axis=1)) * (1 + 1e-9), np.sqrt(((x - near) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-300


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(dim, block, ids, data): about ``size`` vectors in a row, as int64 ids and float64 components."""
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"))
    dealt = rows.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / size)))

    def gather(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id", kind="stable")
        return pd.DataFrame({"dim": part["dim"].iloc[:1], "block": part["block"].iloc[:1], "ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "data": [np.stack(part["vector"].to_numpy()).astype(np.float64).tobytes()]})

    return dealt.groupBy("dim", "block").applyInPandas(gather, "dim int, block long, ids binary, data binary")


def tile(query: tuple[np.ndarray, np.ndarray], candidate: tuple[np.ndarray, np.ndarray], k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """For each query its ``k`` best (minus score, vec_id) in one tile."""
    (qi, x), (ci, y) = query, candidate
    xq, xs, xn, xr = _quantise(x)
    yq, ys, yn, yr = _quantise(y)
    # sums of at most 127 * 127 * dim stay exact in float64; BLAS has no int8 product
    wide = np.float32 if x.shape[1] <= 1000 else np.float64
    near = (xq.astype(wide) @ yq.astype(wide).T).astype(np.float64) * xs[:, None] * ys
    slack = xn[:, None] * yr + xr[:, None] * (yn + yr)
    slack += 1e-9 * (xn + xr)[:, None] * (yn + yr)
    low, high = near - slack, near + slack
    own = qi[:, None] == ci
    low[own] = high[own] = -np.inf
    least = np.partition(low, -k, axis=1)[:, -k] if len(ci) >= k else np.full(len(qi), -np.inf)
    for i in range(len(qi)):
        at = np.flatnonzero((high[i] >= least[i]) & ~own[i])
        score = np.add.accumulate(y[at] * x[i], axis=1)[:, -1] if len(at) else np.zeros(0)  # left to right
        if len(at) > k:
            top = np.lexsort((ci[at], -score))[:k]
            at, score = at[top], score[top]
        if len(at):
            yield int(qi[i]), list(zip((-score).tolist(), ci[at].tolist(), strict=True))


def nearest(vectors: DataFrame, k: int = 20, query: Column | None = None, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """``vectors(vec_id, vector)``: the ``k`` largest inner products of each query row with all other rows.

    Returns (query_id, rank from 1, vec_id, score), ties to the smaller vec_id; all candidates where there
    are fewer than ``k``. Queries are rows for which ``query`` holds (all by default). Rows with a
    null vec_id, and vectors that are null, zero, or hold null or non-finite components, take no part.
    Vectors of different lengths are not compared. A repeated vec_id counts once (the least vector by
    order). An empty table gives no rows. Further columns are not read.
    """
    kind = vectors.select(F.col("vec_id").cast("long"), F.col("vector").cast("array<double>"))
    rows = kind.where("vec_id is not null").where(_usable("vector")).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = written(rows.withColumn("dim", F.size("vector")), "vectors")
    candidates = written(_blocks(rows, candidate_block), "blocks")
    queries = _blocks(rows.where(query) if query is not None else rows, query_block).select("dim", F.col("block").alias("query_block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    # one row for each pair of blocks, dealt out by the pair
    many = candidates.groupBy("dim").agg(F.count("*").alias("many"))
    asked = queries.join(many, "dim").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)))
    pairs = asked.join(candidates, ["dim", "block"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].as_py() for c in ("dim", "query_block", "part", "q_ids", "q_data", "ids", "data")}
                sides = [(np.frombuffer(row[a], np.int64), np.frombuffer(row[b], np.float64).reshape(-1, row["dim"])) for a, b in (("q_ids", "q_data"), ("ids", "data"))]
                flat = [(q, v, s) for q, best in tile(*sides, k) for s, v in best]
                columns = [np.array(c, t).tobytes() for c, t in zip(zip(*flat, strict=True) if flat else ((), (), ()), (np.int64, np.int64, np.float64), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([row["dim"]], pa.int32()), pa.array([row["query_block"]], pa.int64()), pa.array([row["part"]], pa.int64()), *(pa.array([c], pa.binary()) for c in columns)], ["dim", "query_block", "part", "q", "v", "s"])

    kinds = "dim int, query_block long, part long, q binary, v binary, s binary"
    found = pairs.withColumn("part", F.floor(F.col("block") / MERGED)).select("dim", "query_block", "part", "q_ids", "q_data", "ids", "data").mapInArrow(search, kinds)

    def best_of(parts: Iterator[pd.DataFrame]) -> dict[int, list[tuple[float, int]]]:
        """Heaps of (score, minus vec_id) for each query, the worst on top."""
        best: dict[int, list[tuple[float, int]]] = {}
        for part in parts:
            for q, v, s in zip(part["q"], part["v"], part["s"], strict=True):
                for i, x in zip(np.frombuffer(q, np.int64).tolist(), zip(np.frombuffer(s).tolist(), np.frombuffer(v, np.int64).tolist(), strict=True), strict=True):
                    heap, item = best.setdefault(i, []), (-x[0], -x[1])
                    if len(heap) < k:
                        heapq.heappush(heap, item)
                    elif item > heap[0]:
                        heapq.heapreplace(heap, item)
        return best

    def gather(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat = [(i, -v, -s) for i, heap in best_of(parts).items() for s, v in heap]
        q, v, s = (np.array(c, t).tobytes() for c, t in zip(zip(*flat, strict=True) if flat else ((), (), ()), (np.int64, np.int64, np.float64), strict=True))
        yield pd.DataFrame([(*key, q, v, s)], columns=["dim", "query_block", "part", "q", "v", "s"])

    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = [(i, rank, -v, s) for i, heap in best_of(parts).items() for rank, (s, v) in enumerate(sorted(heap, reverse=True), 1)]
        yield pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])

    found = found.groupBy("dim", "query_block", "part").applyInPandas(gather, kinds)
    return found.groupBy("dim", "query_block").applyInPandas(merge, "query_id long, rank int, vec_id long, score double")
