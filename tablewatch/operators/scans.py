"""Ranks, running sums and the values before, of keys of any size.

A window puts all rows of a key in one task. Here rows are range-partitioned by key and order, so that a large key takes
many partitions; a window runs over each key's part of a partition, and what the parts before it amount to is carried in from a second scan,
over one row for each part of the keys that partitions share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.staging import counted, staged


def scan(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, lags: dict[str, Column] | None = None, firsts: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with new columns, for each key (nulls are a key like others) in the ascending order of the columns ``order``.

    ``sums``: running sums up to and with each row (nulls count as 0). ``lags``: the value of the row before, null for the first. ``firsts``: the
    value of the key's first row. Rows that tie in ``order`` take any order.
    """
    sums, lags, firsts = sums or {}, lags or {}, firsts or {}
    named = {f"_in_{n}": F.coalesce(e, F.lit(0)) if n in sums else e for n, e in (sums | lags | firsts).items()}
    whole = {"_key": F.struct(*keys) if keys else F.lit(0), "_order": F.struct(*order)}  # told again from what is staged
    cut = rows.withColumns(named).repartitionByRange(whole["_key"], *order)
    cut = staged(cut.withColumn("_part", F.spark_partition_id()), "scan").withColumns(whole)

    own = Window.partitionBy("_key", "_part").orderBy("_order")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns({n: F.sum(f"_in_{n}").over(upto) for n in sums} | {n: F.lag(f"_in_{n}").over(own) for n in lags} | {n: F.first(f"_in_{n}").over(upto) for n in firsts} | {"_begins": F.row_number().over(own) == 1})
    # a key lies in several parts only if it begins or ends them, so at most two keys of a part need what others amount to
    ends = cut.groupBy("_part").agg(F.array_distinct(F.array(F.min("_key"), F.max("_key"))).alias("_ends")).select("_part", F.explode("_ends").alias("_key"))
    split = ends.groupBy("_key").agg(F.count("*").alias("_parts")).where("_parts > 1").select("_key")
    last = lambda n: F.max_by(F.struct(F.col(f"_in_{n}").alias("v")), "_order").alias(f"_of_{n}")
    first = lambda n: F.min_by(F.struct(F.col(f"_in_{n}").alias("v")), "_order").alias(f"_of_{n}")
    parts = cut.join(F.broadcast(split), "_key", "left_semi").groupBy("_key", "_part").agg(F.count("*").alias("_rows"), *[F.sum(f"_in_{n}").alias(f"_of_{n}") for n in sums], *map(last, lags), *map(first, firsts))
    of = Window.partitionBy("_key").orderBy("_part")
    carried = {f"_of_{n}": F.sum(f"_of_{n}").over(of.rowsBetween(Window.unboundedPreceding, -1)) for n in sums}
    carried |= {f"_of_{n}": F.lag(f"_of_{n}").over(of) for n in lags} | {f"_of_{n}": F.first(f"_of_{n}").over(of) for n in firsts}
    met = local.join(F.broadcast(parts.withColumns(carried).drop("_rows")), ["_key", "_part"], "left")
    met = met.withColumns({n: F.col(n) + F.coalesce(f"_of_{n}", F.lit(0)) for n in sums} | {n: F.when(F.col("_begins"), F.col(f"_of_{n}.v")).otherwise(F.col(n)) for n in lags} | {n: F.when(F.col(f"_of_{n}").isNull(), F.col(n)).otherwise(F.col(f"_of_{n}.v")) for n in firsts})
    return met.select(*rows.columns, *sums, *lags, *firsts)


def apart(side: DataFrame) -> DataFrame:
    """``side`` of a join that must not be broadcast: Spark would judge its size by its compressed files, and they hold many times as much."""
    return side.hint("merge")


#: A side of so many rows is broadcast; beyond that, the rows of a key that has more than CROWDED go to so many places.
BROADCAST, CROWDED, PLACES = 200_000, 1_000_000, 32


def few(side: DataFrame) -> bool:
    return counted(side) <= BROADCAST


def met(rows: DataFrame, side: DataFrame, keys: list[str], spread: str | None, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner, left, left_semi or left_anti) with ``side``, a table that has a row for each key, without bringing a crowded key's rows together.

    A counted, small side is broadcast. A larger one is merged; only the rows of crowded keys, which are few, are dealt by ``spread`` among ``PLACES``
    places, each with a copy of the key's row. Without ``spread`` no key of ``rows`` is crowded.
    """
    if few(side):
        return rows.join(F.broadcast(side), keys, how)
    if not spread:
        return rows.join(apart(side), keys, how)
    crowded = staged(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > CROWDED).select(*keys, F.lit(True).alias("_crowded")), "crowded")
    if crowded.isEmpty():
        return rows.join(apart(side), keys, how)
    place = lambda df, many, one: df.join(F.broadcast(crowded), keys, "left").withColumn("_place", F.when(F.col("_crowded"), many).otherwise(one)).drop("_crowded")
    dealt = place(rows, F.pmod(F.xxhash64(spread), F.lit(PLACES)).cast("int"), F.lit(0))
    copied = place(side, F.sequence(F.lit(0), F.lit(PLACES - 1)), F.array(F.lit(0))).withColumn("_place", F.explode("_place"))
    return dealt.join(apart(copied), [*keys, "_place"], how).drop("_place")


def dense_index(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with their place within the key, from 0 without gaps."""
    return scan(rows, keys, order, sums={name: F.lit(1).cast("long")}).withColumn(name, F.col(name) - 1)


def sequence_gaps(rows: DataFrame, key: str, order: str) -> DataFrame:
    """``rows`` with the numbers of ``order`` that were left out right before each of a key, 0 for its first."""
    return scan(rows, [key], [order], lags={"_before": F.col(order)}).withColumn("gap", F.greatest(F.lit(0), F.coalesce(F.col(order) - F.col("_before") - 1, F.lit(0)))).drop("_before")
