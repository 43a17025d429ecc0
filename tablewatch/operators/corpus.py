"""The texts of inspected assets, with where they stand, who they are and whether they can be edited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..sources.staging import staged

_PLACE = ["package_file", "object_path", "location", "row", "capability"]


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", path, kind)


def _starts(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries of string tables as texts, properties of table rows and objects)."""
    assets = documents.select("package_file", F.explode(F.try_variant_get(F.try_parse_json("json"), "$.assets", "array<variant>")).alias("v"))
    assets = assets.select("package_file", _get("$.object_path").alias("object_path"), _get("$.kind").alias("kind"), "v")
    none = F.lit(None).cast("string")
    entries = assets.where("kind = 'StringTable'").select("package_file", "object_path", _get("$.string_table_namespace").alias("namespace"), F.explode(_get("$.string_table_entries", "array<variant>")).alias("v"))
    key = _get("$.key")
    told = entries.select("package_file", "object_path", F.lit("string_table_entry").alias("location"), none.alias("row"), F.lit("source_editable").alias("capability"), key.alias("path"), _get("$.source").alias("text"), F.lit("base").alias("history"), "namespace", key.alias("key"))
    rows = assets.where("kind in ('DataTable', 'CompositeDataTable')").select("package_file", "object_path", F.explode(_get("$.rows", "array<variant>")).alias("v"))
    cells = rows.select("package_file", "object_path", F.lit("data_table_cell").alias("location"), _get("$.name").alias("row"), F.lit("source_editable").alias("capability"), F.explode(_get("$.properties", "array<variant>")).alias("v"))
    own = assets.where("kind = 'UObject'").select("package_file", "object_path", F.lit("asset_property").alias("location"), none.alias("row"), F.lit("read_only").alias("capability"), F.explode(_get("$.properties", "array<variant>")).alias("v"))
    return told, cells.union(own).select(*_PLACE, _get("$.name").alias("path"), "v")


def text_corpus(documents: DataFrame, depth: int = 64) -> DataFrame:
    """``documents(package_file, json)`` of inspections to their texts: (id, package_file, object_path, location, row, path, text, status, namespace, key, reason, capability).

    Entries of string tables and cells of data tables can be edited in their source, properties of other objects only read. Properties
    are gone into through structs, arrays, sets and maps. A text with a base history and a key is resolved to its namespace and key,
    any other is unresolved, as culture_invariant (no history) or for its missing_key. ids tell texts apart by place. A null or broken document has
    none; a level is written once, and values below ``depth`` levels are an error.
    """
    found, level = _starts(documents)
    kind = _get("$.value_kind")
    listed = F.transform(_get("$.values", "array<variant>"), lambda x, i: F.struct(F.concat(F.lit("["), i.cast("string"), F.lit("]")).alias("step"), x.alias("v")))
    pairs = F.flatten(F.transform(_get("$.entries", "array<variant>"), lambda e, i: F.array(*[F.struct(F.concat(F.lit("{"), i.cast("string"), F.lit("}." + part)).alias("step"), F.try_variant_get(e, f"$.{part}", "variant").alias("v")) for part in ("key", "value")])))
    members = F.transform(_get("$.properties", "array<variant>"), lambda p: F.struct(F.concat(F.lit("."), F.try_variant_get(p, "$.name", "string")).alias("step"), p.alias("v")))
    inner = F.when(kind.isin("array", "set"), listed).when(kind == "map", pairs).when(kind == "struct", members)
    for _ in range(depth + 1):
        seen = Observation()
        level = staged(level.withColumn("kind", kind).where("kind in ('text', 'array', 'set', 'map', 'struct')").observe(seen, F.count_if(F.col("kind") != "text").alias("inner")), "values")
        texts = level.where("kind = 'text'").select(*_PLACE, "path", _get("$.value").alias("text"), _get("$.history").alias("history"), _get("$.namespace").alias("namespace"), _get("$.key").alias("key"))
        found = found.unionByName(texts)
        if not seen.get.get("inner"):
            break
        level = level.where("kind <> 'text'").select(*_PLACE, "path", F.explode(inner).alias("e")).where("e.v is not null").select(*_PLACE, F.concat("path", "e.step").alias("path"), F.col("e.v").alias("v"))
    else:
        raise ValueError(f"there are values below {depth} levels")
    resolved = (F.col("history") == "base") & (F.length("key") > 0)
    resolved = F.coalesce(resolved, F.lit(False))
    place = F.when(F.col("location") == "string_table_entry", F.concat(F.lit("entry:"), "path")).when(F.col("location") == "data_table_cell", F.concat(F.lit("row:"), "row", F.lit(":property:"), "path")).otherwise(F.concat(F.lit("property:"), "path"))
    return found.select(
        F.concat(F.lit("occurrence:"), "object_path", F.lit(":"), place, F.lit(":"), "package_file").alias("id"),
        "package_file", "object_path", "location", "row", "path", "text",
        F.when(resolved, "resolved").otherwise("unresolved").alias("status"),
        F.when(resolved, F.col("namespace")).alias("namespace"), F.when(resolved, F.col("key")).alias("key"),
        F.when(~resolved, F.when(F.col("history") == "none", "culture_invariant").otherwise("missing_key")).alias("reason"),
        "capability",
    )
