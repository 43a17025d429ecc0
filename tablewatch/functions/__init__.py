"""Column functions: names, keys, verdicts and rendered values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def instance_key(class_name: Column, path: Column) -> Column:
    """Class and leaf of a path: what the last dot follows (so no PersistentLevel), without the prefix of a play session."""
    leaf = F.element_at(F.split(path, r"\."), -1)
    return F.concat(class_name, F.lit(":"), F.regexp_replace(leaf, r"^UEDPIE_[0-9]+_", ""))


def max_abs_delta(*pairs: tuple[Column, Column]) -> Column:
    deltas = [F.abs(a - b) for a, b in pairs]
    return deltas[0] if len(deltas) == 1 else F.greatest(*deltas)


def framing_verdict(projectable: Column, inside: Column, margin: Column, requested: Column) -> Column:
    """The first problem of a framing: not projectable, outside, partial, margin too small; else ok."""
    return F.when(~projectable, "unprojectable").when(inside == 0, "outside").when(inside < 1, "partial").when(margin < requested, "margin_too_small").otherwise("ok")


def parse_edit(text: Column, kind: str, options: list[str] | None = None, read_only: Column | None = None) -> Column:
    """A typed value, or why there is none: read_only, missing, not_parseable or not_an_option."""
    value = text.try_cast(kind)
    status = F.when(text.isNull(), "missing").when(value.isNull(), "not_parseable")
    if options is not None:
        status = status.when(~text.isin(options), "not_an_option")
    if read_only is not None:
        status = F.when(F.coalesce(read_only, F.lit(False)), "read_only").otherwise(status.otherwise("ok"))
    else:
        status = status.otherwise("ok")
    return F.struct(F.when(status == "ok", value).alias("value"), status.alias("status"))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
