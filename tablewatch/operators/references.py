"""References between tables: what they point to, and why some don't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .values import walk


def resolve(edges: DataFrame, tables: DataFrame, rows: DataFrame) -> DataFrame:
    """``edges`` (…, target_table, target_row) with status and candidates.

    ``tables(table_path)`` and ``rows(table_path, row_name)`` are counted first, so that a name that comes
    twice makes an edge ambiguous rather than two edges. Names match by case.
    """
    paths = tables.groupBy("table_path").agg(F.count("*").alias("_tables")).withColumnRenamed("table_path", "_path")
    names = rows.groupBy("table_path", "row_name").agg(F.count("*").alias("_rows")).select(F.col("table_path").alias("_rpath"), F.col("row_name").alias("_rname"), "_rows")
    met = edges.join(paths, edges.target_table == F.col("_path"), "left").join(names, (F.col("target_table") == F.col("_rpath")) & (F.col("target_row") == F.col("_rname")), "left")
    status = (
        F.when(F.col("target_table").isNull(), "unassigned")
        .when(F.col("_tables").isNull(), "missing_table")
        .when(F.col("_tables") > 1, "ambiguous_table")
        .when(F.col("_rows").isNull(), "missing_row")
        .when(F.col("_rows") > 1, "ambiguous_row")
        .otherwise("resolved")
    )
    candidates = F.when(status == "ambiguous_table", F.col("_tables")).when(status.isin("ambiguous_row", "resolved"), F.col("_rows")).otherwise(F.lit(0).cast("long"))
    return met.withColumn("candidates", candidates).withColumn("status", status).drop("_path", "_tables", "_rpath", "_rname", "_rows")


def diagnostics(edges: DataFrame) -> DataFrame:
    """(source_row, code, message) of every edge that isn't resolved: what it names, and in how many places that is found."""
    target = F.concat(F.coalesce("target_table", F.lit("no table")), F.lit("/"), F.coalesce("target_row", F.lit("no row")))
    message = F.concat(F.col("source_row"), F.lit(" -> "), target, F.lit(" ("), F.col("candidates").cast("string"), F.lit(" found)"))
    return edges.where("status <> 'resolved'").select("source_row", F.concat(F.lit("reference_"), "status").alias("code"), message.alias("message"))


def report(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("reference_count"), F.count_if(F.col("status") == "resolved").alias("resolved_count"), F.count_if(F.col("status") != "resolved").alias("issue_count"))


def nested_references(documents: DataFrame, depth: int = 64) -> DataFrame:
    """(source_row, value_path, target_table, target_row): objects with a table and a row, at any depth.

    ``documents(source_row, document)`` hold JSON; a null or broken one has none. ``depth`` bounds the levels, not the rows.
    """
    found = walk(documents.select("source_row", F.try_parse_json("document").alias("json")), "json", depth, leaves=False)
    told = found.where("kind = 'object'").selectExpr("source_row", "value_path", "try_variant_get(v, '$.table', 'string') AS target_table", "try_variant_get(v, '$.row', 'string') AS target_row")
    return told.where("target_row is not null")


def joined_view(source: DataFrame, edges: DataFrame, target: DataFrame, source_table: str | None = None, snapshots: DataFrame | None = None) -> DataFrame:
    """Source rows with their target's columns; rows without one stay, with the reason.

    ``source(source_row, …)``, ``edges(source_row, status, target_row)``, ``target(target_row, …)`` with unique names. Where
    ``snapshots(table_path)`` are given, ``source_table`` must be one of them exactly once; if it isn't, all rows
    are without a target, for the reason source_table_missing or source_table_ambiguous.
    """
    view = source.join(edges.select("source_row", "status", "target_row"), "source_row", "left")
    problem = F.lit(None).cast("string")
    if snapshots is not None:
        held = snapshots.where(F.col("table_path") == source_table).agg(F.count("*").alias("_snapshots"))
        view = view.join(F.broadcast(held), F.lit(True))  # the count is one row
        problem = F.when(F.col("_snapshots") == 0, "source_table_missing").when(F.col("_snapshots") > 1, "source_table_ambiguous")
    view = view.withColumn("_problem", problem)
    found = target.withColumnRenamed("target_row", "_target")
    view = view.join(found, (F.col("target_row") == F.col("_target")) & (F.col("status") == "resolved") & F.col("_problem").isNull(), "left").drop("_target")
    reason = F.coalesce("_problem", F.when(F.col("status").isNull(), "not_reference").when(F.col("status") != "resolved", F.col("status")))
    return view.withColumn("reason", reason).drop("_problem", "_snapshots")


def reference_fields(schema: DataFrame, cells: DataFrame) -> DataFrame:
    """(field): names of reference fields, of the schema (field, value_kind) and of cells (field, target_table) that hold one."""
    said = schema.where("value_kind = 'row_reference'").select("field")
    return said.union(cells.where("target_table is not null").select("field")).distinct()


def referenced_tables(edges: DataFrame) -> DataFrame:
    return edges.where("target_table is not null").select("target_table").distinct()


def combined_matrix(source: DataFrame, target: DataFrame, source_key: str, target_key: str, visible: dict[str, list[str]] | None = None) -> DataFrame:
    """Source and target columns side by side, each named ``source_x`` or ``target_x``; ``visible`` names those to show."""
    sides = {"source": source, "target": target}
    named = {k: df.select([F.col(c).alias(f"{k}_{c}") for c in df.columns]) for k, df in sides.items()}
    both = named["source"].join(named["target"], F.col(f"source_{source_key}") == F.col(f"target_{target_key}"), "left")
    shown = visible or {k: df.columns for k, df in sides.items()}
    return both.select([f"{k}_{c}" for k in sides for c in shown.get(k, [])])


def lookup_or_fail(left: DataFrame, right: DataFrame, key: str, code: str) -> DataFrame:
    """``left`` with ``right``'s columns; a row without a match stays, with an error code."""
    marked = right.withColumn("_found", F.lit(True))
    return left.join(marked, key, "left").withColumn("error_code", F.when(F.col("_found").isNull(), F.lit(code))).drop("_found")


def composite(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of ordered parents laid over each other: the last parent that has a name wins."""
    together = None
    for rank, part in enumerate(parts):
        ranked = part.withColumn("_rank", F.lit(rank))
        together = ranked if together is None else together.unionByName(ranked)
    columns = [c for c in together.columns if c != "_rank"]
    won = together.groupBy(key).agg(F.max_by(F.struct(*columns), "_rank").alias("won"))
    return won.select("won.*")


def differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def merge_catalogs(saved: DataFrame, live: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row for each path: live values first, authorities that have it, and the fields that differ."""
    s, v = saved.alias("s"), live.alias("v")
    both = F.col(f"s.{key}").isNotNull() & F.col(f"v.{key}").isNotNull()
    authorities = F.concat_ws(",", F.when(F.col(f"v.{key}").isNotNull(), "live"), F.when(F.col(f"s.{key}").isNotNull(), "saved"))
    diverging = F.concat_ws(",", *[F.when(both & differs(F.col(f"s.{f}"), F.col(f"v.{f}")), F.lit(f)) for f in fields])
    values = [F.when(F.col(f"v.{key}").isNotNull(), F.col(f"v.{f}")).otherwise(F.col(f"s.{f}")).alias(f) for f in fields]
    return s.join(v, F.col(f"s.{key}") == F.col(f"v.{key}"), "full").select(F.coalesce(f"v.{key}", f"s.{key}").alias(key), *values, authorities.alias("authorities"), diverging.alias("divergence"))


def parity_report(saved: DataFrame, live: DataFrame, key: str, fields: list[str], fingerprint: str, schema: str) -> DataFrame:
    """One row: paths that one side lacks, that diverge in ``fields``, whose fingerprints differ or that lack a schema.

    Schema gaps don't count against the status, all else does. Fingerprints are compared where both sides have one.
    """
    s, v = saved.alias("s"), live.alias("v")
    both = F.col(f"s.{key}").isNotNull() & F.col(f"v.{key}").isNotNull()
    side = lambda x, c: F.col(f"{x}.{c}")
    apart = F.lit(False)
    for f in fields:
        apart = apart | differs(side("s", f), side("v", f))
    prints = both & side("s", fingerprint).isNotNull() & side("v", fingerprint).isNotNull()
    gap = (side("s", key).isNotNull() & (side("s", schema) != "available")) | (side("v", key).isNotNull() & (side("v", schema) != "available"))
    counts = s.join(v, side("s", key) == side("v", key), "full").agg(
        F.count_if(side("s", key).isNull()).alias("missing_saved"),
        F.count_if(side("v", key).isNull()).alias("missing_live"),
        F.count_if(both & apart).alias("diverged"),
        F.count_if(prints & (side("s", fingerprint) != side("v", fingerprint))).alias("fingerprint_mismatches"),
        F.count_if(gap).alias("schema_gaps"),
    )
    bad = F.col("missing_saved") + F.col("missing_live") + F.col("diverged") + F.col("fingerprint_mismatches")
    return counts.withColumn("status", F.when(bad > 0, "failed").otherwise("passed"))


def session_drift(saved: DataFrame, current: DataFrame, key: str, place: str, bounds: list[str], review_set: str, tolerance: float = 1.0) -> DataFrame:
    """(key, reasons, resumable): why what a session saved no longer fits; without a reason it can be resumed."""
    s, n = saved.alias("s"), current.alias("n")
    gone = F.col(f"n.{key}").isNull()
    moved = F.lit(False)
    for b in bounds:
        moved = moved | (F.abs(F.col(f"s.{b}") - F.col(f"n.{b}")) > tolerance)
    changed = lambda c: differs(F.col(f"s.{c}"), F.col(f"n.{c}"))
    reasons = F.array_compact(F.array(F.when(gone, "actor_missing"), F.when(~gone & changed(place), "map_changed"), F.when(~gone & moved, "bounds_changed"), F.when(~gone & changed(review_set), "review_set_changed")))
    return s.join(n, F.col(f"s.{key}") == F.col(f"n.{key}"), "left").select(F.col(f"s.{key}").alias(key), F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("resumable"))
