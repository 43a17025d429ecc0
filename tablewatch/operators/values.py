"""Recursive values: one walk over JSON variants, and what is told of a value by its type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from ..sources.staging import staged


def walk(rows: DataFrame, value: str, depth: int = 64, objects_only: bool = False, leaves: bool = True) -> DataFrame:
    """Every value inside the variant column ``value``: ``rows``' other columns, value_path, key (of an object's value), kind (object, array, leaf) and v.

    A level is written once and the next one comes from it, so each costs one job however deep others go; the number of rows is not
    bounded. A row with values below ``depth`` levels is an error. With ``objects_only`` arrays are not gone into, without ``leaves``
    values that hold no others are left out as they are met. Keys that are no plain names stand in brackets and quotes in a path.
    """
    rest = [c for c in rows.columns if c != value]
    holds = "kind = 'object'" if objects_only else "kind <> 'leaf'"
    name = F.col("_key")
    quoted = F.concat(F.lit('["'), F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"]'))
    step = F.when(name.isNull(), F.concat(F.lit("["), F.col("_pos").cast("string"), F.lit("]"))).when(name.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.concat(F.lit("."), name)).otherwise(quoted)
    no_key = F.lit(None).cast("string")
    # whether there is an object or an array at all: what it holds is not read
    kind = F.when(F.try_variant_get("v", "$", "struct<>").isNotNull(), "object").when(F.try_variant_get("v", "$", "array<struct<>>").isNotNull(), "array").otherwise("leaf")
    level, found = rows.where(F.col(value).isNotNull()).select(*rest, F.lit("$").alias("value_path"), no_key.alias("key"), F.col(value).alias("v")), None
    for _ in range(depth + 1):
        seen = Observation()
        told = level.select(*rest, "value_path", "key", kind.alias("kind"), "v").where("true" if leaves else "kind <> 'leaf'")
        told = staged(told.observe(seen, F.count_if(F.expr(holds)).alias("inner")), "level")
        found = told if found is None else found.unionByName(told)
        if not seen.get.get("inner"):
            return found
        outer = told.where(holds).select(*rest, "value_path", F.col("v").alias("_outer"))
        opened = outer.lateralJoin(outer.sparkSession.tvf.variant_explode(F.col("_outer").outer()).withColumnsRenamed({"pos": "_pos", "key": "_key", "value": "_inner"}))
        level = opened.select(*rest, F.concat("value_path", step).alias("value_path"), name.alias("key"), F.col("_inner").alias("v"))
    raise ValueError(f"there are values below {depth} levels")


def format_value(value: Column, kind: T.DataType) -> Column:
    """Any value as one line: True and False, None, ``[a, b]``, ``{name: a}``, and table -> row of a reference."""
    if isinstance(kind, T.BooleanType):
        text = F.when(value, "True").otherwise("False")
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: format_value(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.MapType):
        pairs = F.transform(F.array_sort(F.map_entries(value)), lambda e: F.concat(format_value(e["key"], kind.keyType), F.lit(": "), format_value(e["value"], kind.valueType)))
        text = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    elif isinstance(kind, T.StructType) and kind.names == ["table_path", "row_name"]:
        text = F.concat(F.coalesce(value["table_path"], F.lit("None")), F.lit(" -> "), F.coalesce(value["row_name"], F.lit("None")))
    elif isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f"{f.name}: "), format_value(value[f.name], f.dataType)) for f in kind.fields]
        text = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    else:
        text = value.cast("string")
    return F.when(value.isNull(), "None").otherwise(text)


def value_summary(value: Column, kind: T.DataType) -> Column:
    """How much a value holds: items of an array, entries of a map, fields of a struct; else the name of its kind."""
    if isinstance(kind, T.ArrayType):
        text = F.concat(F.size(value).cast("string"), F.lit(" items"))
    elif isinstance(kind, T.MapType):
        text = F.concat(F.size(value).cast("string"), F.lit(" entries"))
    elif isinstance(kind, T.StructType):
        text = F.lit(f"{len(kind)} fields")
    else:
        text = F.lit(kind.simpleString())
    return F.when(value.isNull(), "None").otherwise(text)


_PLAIN = {"int": r"^-?(0|[1-9][0-9]*)$", "uint": r"^(0|[1-9][0-9]*)$", "guid": r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"}


def text_fits(text: Column, kind: str) -> Column:
    """Whether a text can stand for an int, uint or guid."""
    return text.rlike(_PLAIN[kind])


def compatible(value: Column, described: dict) -> Column:
    """Whether a variant fits what is described: {"kind": ..., "options"|"element"|"key"|"value"|"fields": ...}.

    bool, number, string, int, uint, guid, enum (of options), row_reference (anything), array and set (of element),
    map (an array of {key, value} objects) and struct (fields: name -> (description, required)). A null never fits.
    """
    kind = described["kind"]
    if kind == "row_reference":
        return F.lit(True)
    text = F.try_variant_get(value, "$", "string")
    shape = F.schema_of_variant(value)
    if kind in _PLAIN:
        fits = text.rlike(_PLAIN[kind]) & ~shape.rlike("^(OBJECT|ARRAY|BOOLEAN)")
    elif kind == "enum":
        fits = (shape == "STRING") & text.isin(*described["options"])
    elif kind == "bool":
        fits = shape == "BOOLEAN"
    elif kind == "string":
        fits = shape == "STRING"
    elif kind == "number":
        fits = shape.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    elif kind in ("array", "set", "map"):
        items = F.try_variant_get(value, "$", "array<variant>")
        if kind == "map":
            each = lambda e: compatible(F.try_variant_get(e, "$.key", "variant"), described["key"]) & compatible(F.try_variant_get(e, "$.value", "variant"), described["value"])
        else:
            each = lambda e: compatible(e, described["element"])
        fits = shape.startswith("ARRAY") & F.forall(items, lambda e: F.coalesce(each(e), F.lit(False)))
    elif kind == "struct":
        fits = shape.startswith("OBJECT")
        for name, (inner, required) in described["fields"].items():
            held = F.try_variant_get(value, f"$.{name}", "variant")
            fits = fits & F.when(held.isNull(), F.lit(not required)).otherwise(compatible(held, inner))
    else:
        raise ValueError(f"unknown kind: {kind}")
    return F.coalesce(fits, F.lit(False))
