"""Codes of vectors by parts (product quantisation) in whole numbers, so that every machine finds the same.

Vectors become integers and are cut into equal parts; each part position has its own codebook. Distances need inner
products of integers, which BLAS offers for floating point only. So integers are split into limbs short enough that every
product of limbs, summed over a part, stays at or below 2**53: such products are exact in float64 whatever order they are summed in. They
are shifted and added up in 64-bit integers (in Python's where those would not do), and the first least distance wins.

A round is one pass over the vectors: tasks sum the parts of each entry, and what is collected has the size of the codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .session import written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors with a component of this size have no code: sums of their integers might not fit 38 digits.
LARGEST = 2.0**54
#: Into so many shares the rows of one group are dealt before they are summed.
SHARES = 1024


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float64 arrays with x = sum of limb[i] << (bits * i) and no limb beyond 2**bits; the last carries the sign."""
    out, top = [], int(np.abs(x).max(initial=0))
    while top >> bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x, top = x >> bits, top >> bits
    return [*out, x.astype(np.float64)]


def products(x: np.ndarray, y: np.ndarray, kind: type = np.int64) -> np.ndarray:
    """Inner products of all rows of two int64 arrays, exact if they fit ``kind`` (object: Python's integers)."""
    bits = (53 - max(1, x.shape[1] - 1).bit_length()) // 2
    out = np.zeros((len(x), len(y)), kind)
    right = limbs(y, bits)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(right):
            out += (a @ b.T).astype(np.int64).astype(kind) << bits * (i + j)
    return out


def _kind(width: int, largest: int) -> type:
    return np.int64 if width * largest * largest < 2**63 else object


def assign(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the nearest entries of ``book`` for each row of ``x``, and the squared distance."""
    kind = _kind(x.shape[1], int(np.abs(x).max(initial=0)) + int(np.abs(book).max(initial=0)))
    far = (book.astype(kind) ** 2).sum(axis=1) - 2 * products(x, book, kind)
    code = far.argmin(axis=1)
    return code, (x.astype(kind) ** 2).sum(axis=1) + far[np.arange(len(x)), code]


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value), as int64; ``scale`` is a power of two, so nothing is rounded."""
    return np.floor(values * scale).astype(np.int64)


class Codebooks(NamedTuple):
    entries: np.ndarray  # part, entry, place
    scale: int

    @property
    def size(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    @property
    def digest(self) -> str:
        """SHA-256 of all components by part, entry and place, as decimal numbers between commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _kept(vectors: DataFrame) -> DataFrame:
    """Vectors as doubles, without those that are null or hold null or non-finite components; fits: whether they can have a code."""
    x, limit = F.col("vector").cast("array<double>"), F.lit(float("inf"))
    rows = vectors.withColumn("vector", x).where("vector is not null")
    rows = rows.where(F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < limit)))
    return rows.withColumn("fits", F.forall("vector", lambda v: F.abs(v) < LARGEST))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _sums(rows: DataFrame, books: Codebooks) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) to the number of its parts and their sum: as many numbers as the codebooks hold."""
    parts, many, width = books.entries.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, many), np.int64), np.zeros((parts, many, width), object)
        for batch in batches:
            x = integers(_matrix(batch.column(0), books.size), books.scale).reshape(-1, parts, width)
            kind = _kind(len(x), int(np.abs(x).max(initial=0)) + 1)
            for p in range(parts):
                code, _ = assign(x[:, p], books.entries[p])
                chosen = (np.arange(many)[:, None] == code).astype(np.int64)
                count[p] += chosen.sum(axis=1)
                total[p] += products(chosen, np.ascontiguousarray(x[:, p].T), kind).astype(object)
        p, e = np.nonzero(count)
        sums = [[Decimal(v) for v in row] for row in total[p, e].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e], pa.int64()), pa.array(sums, pa.list_(pa.decimal128(38, 0)))], ["part", "entry", "n", "sums"])

    found = rows.select("vector").mapInArrow(add, "part int, entry int, n long, sums array<decimal(38,0)>")
    found = found.select("part", "entry", "n", F.posexplode("sums").alias("place", "x")).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    gathered = found.groupBy("part", "entry").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("place", "x"))).alias("sums")).collect()
    return {(r.part, r.entry): (r.n, [int(s.x) for s in r.sums]) for r in gathered}


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of ``vectors(vec_id, vector)``; null if no vector can have a code.

    They start as the parts of the ``entries`` smallest vec_ids (null last, ties by the vector). Each of the ``rounds``
    assigns all vectors and replaces each entry by floor(sum / count) of its parts; an entry without parts stays.
    The vectors that count have the most common length that ``parts`` divides (the shorter, if two are as common).
    """
    rows = _kept(vectors.select(F.col("vec_id").cast("long"), "vector")).where("fits")
    sizes = rows.groupBy(F.size("vector").alias("n")).count().where((F.col("n") > 0) & (F.col("n") % parts == 0))
    common = sizes.orderBy(F.desc("count"), "n").first()
    if common is None:
        return None
    rows = rows.where(F.size("vector") == common.n)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    start = integers(np.array([r.vector for r in first]), scale).reshape(len(first), parts, -1)
    books = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)), scale)
    for _ in range(rounds):
        new = books.entries.copy()
        for (p, e), (n, sums) in _sums(rows, books).items():
            new[p, e] = [s // n for s in sums]
        books = Codebooks(new, scale)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """All columns of ``vectors`` (vector among them) but vector, then code and error.

    code: indexes of the nearest entries in the order of parts, two hex digits each. error: the sum of their squared
    distances. Vectors that are null or hold null or non-finite components are dropped. Those of another length than
    the codebooks', or with a component of 2**54 or more, have neither code nor error; an error that does not fit a long is null.
    """
    parts, _, width = books.entries.shape
    others = [c for c in vectors.columns if c != "vector"]
    rows = _kept(vectors).withColumn("fits", F.col("fits") & (F.size("vector") == books.size))
    hexes = np.array([f"{i:02x}" for i in range(books.entries.shape[1])])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = batch.column("fits").to_numpy(zero_copy_only=False)
            names, errors = np.full(len(batch), None, object), np.full(len(batch), None, object)
            x = integers(_matrix(batch.column("vector").filter(batch.column("fits")), books.size), books.scale).reshape(-1, parts, width)
            total, digits = np.zeros(len(x), object), []
            for p in range(parts):
                nearest, distance = assign(x[:, p], books.entries[p])
                total += distance.astype(object)
                digits.append(hexes[nearest])
            names[fits] = list(map("".join, zip(*digits, strict=True)))
            errors[fits] = [t if t < 2**63 else None for t in total.tolist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(names, pa.string()), pa.array(errors, pa.int64())], [*others, "code", "error"])

    kinds = ", ".join([*(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in others), "code string, error long"])
    return rows.select(*others, "vector", "fits").mapInArrow(code, kinds)


def summed(rows: DataFrame, group: str, value: str, spread: str, name: str) -> DataFrame:
    """``rows`` (a table that reads the same each time) with the sum of ``value`` over each ``group``, nulls together.

    A group's rows are dealt into shares by ``spread``, summed there, and the sums of its shares added up, so the
    rows of a large group neither meet in one task nor come back to one.
    """
    dealt = rows.withColumn("_share", F.pmod(F.xxhash64(spread), F.lit(SHARES)))
    parts = dealt.groupBy(F.col(group).alias("_group"), F.col("_share").alias("_part")).agg(F.sum(F.col(value).cast("decimal(38,0)")).alias("_sum"))
    whole = parts.withColumn(name, F.expr("try_cast(sum(_sum) over (partition by _group) as long)")).drop("_sum")
    return dealt.join(whole, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_share") == F.col("_part"))).drop("_share", "_group", "_part")


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """``vectors(vec_id, vector, label)`` to (vec_id, code, error, label_error, codebooks_sha256), one row for each that is kept.

    Codebooks and codes are those of ``train`` and ``encode``; label_error sums error over equal labels (nulls
    together, rows without an error count as nothing; null where it does not fit a long). Repeated rows are kept and
    count as often as they stand there; a null vec_id is kept and comes last. With fewer vectors than ``entries``
    the codebooks are as small. An empty table gives no rows. Further columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), "vector", "label")
    books = train(rows, parts, entries, rounds, scale)
    if books is None:  # no vector can be cut in parts
        coded, digest = _kept(rows).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), hashlib.sha256(b"").hexdigest()
    else:
        coded, digest = encode(rows, books), books.digest
    coded = summed(written(coded, "codes"), "label", "error", "vec_id", "label_error")
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
