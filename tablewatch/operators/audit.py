"""Rules over records, and what they find: evidence, predicates, findings, distributions, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.staging import staged
from .scans import met, scan
from .values import format_value


def evidence(value: Column, source: str, reason: Column | str = "not_serialized") -> Column:
    """A value with its source, or the reason for its absence; absence is data, not a null."""
    said = value.isNotNull()
    why = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(F.when(said, "available").otherwise("unavailable").alias("status"), F.when(said, F.lit(source)).alias("source"), value.alias("value"), F.when(~said, why).alias("reason"))


def json_evidence(document: Column, name: str, kind: str) -> Column:
    """Evidence of a top-level JSON field: wrong kind, absent field and absent document are told apart."""
    raw = F.get_json_object(document, f"$.{name}")
    value = raw.try_cast(kind)
    reason = F.when(document.isNull(), "missing_source").when(raw.isNull(), "not_serialized").otherwise("wrong_value_kind")
    return evidence(value, f"properties.{name}", reason)


def power_of_two(x: Column) -> Column:
    return (x > 0) & (x.bitwiseAND(x - 1) == 0)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


#: kind -> does a record break the rule? Rules of another kind are an error.
RULE_KINDS = {
    "power_of_two": lambda: ~(power_of_two(F.col("width")) & power_of_two(F.col("height"))),
    "group_maximum": lambda: (F.col("record_group") == F.col("rule_group")) & (F.greatest("width", "height") > F.col("maximum")),
}


def scan_rules(rules: DataFrame) -> DataFrame:
    """``rules`` (rule_id, kind, severity, rule_group, maximum), or an error that names unknown kinds."""
    unknown = F.col("kind").isNull() | ~F.col("kind").isin(*RULE_KINDS)
    return rules.where(F.when(unknown, F.raise_error(F.concat(F.lit("unknown rule kind: "), F.coalesce("kind", F.lit("null")))).cast("boolean")).otherwise(True))


def evaluate_rules(records: DataFrame, rules: DataFrame) -> DataFrame:
    """One row for each record (object_path, record_group, width, height) and rule it breaks.

    Records without both dimensions are skipped. Rules of a group meet its records by an equi-join, so that a long rule table
    is no product with them; a rule without a group is only paired with the records that break it.
    """
    checked = scan_rules(rules)
    whole = records.where("width is not null and height is not null")
    grouped = whole.join(checked.where("kind = 'group_maximum'"), F.col("record_group") == F.col("rule_group")).where(RULE_KINDS["group_maximum"]())
    odd = whole.where(RULE_KINDS["power_of_two"]()).withColumn("_kind", F.lit("power_of_two"))
    single = odd.join(checked.where("kind = 'power_of_two'"), F.col("_kind") == F.col("kind"))
    columns = ["object_path", "rule_id", "severity"]
    return grouped.select(columns).unionByName(single.select(columns))


def finding_order(findings: DataFrame) -> DataFrame:
    """All findings: errors before warnings, then by rule and path."""
    return findings.orderBy(severity_rank(F.col("severity")), "rule_id", "object_path")


def search(rows: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows that hold every word of ``query`` somewhere in ``columns``, case aside; all rows for a query without words."""
    text = F.lower(F.concat_ws("\n", *columns))
    for term in query.lower().split():
        rows = rows.where(text.contains(term))
    return rows


def with_capability(units: DataFrame, occurrences: DataFrame, key: str, capability: str) -> DataFrame:
    """Units of which any occurrence (key, capability) has the capability."""
    return units.join(occurrences.where(F.col("capability") == capability), key, "left_semi")


def row_filter(rows: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows of which any column, as it is shown, holds ``query``, case aside."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    shown = F.array(*[F.lower(format_value(F.col(c), kinds[c])) for c in columns])
    return rows.where(F.exists(shown, lambda v: v.contains(query.lower())))


def entity_filter(entities: DataFrame, name: str, kind: str, query: str, hidden: list[str]) -> DataFrame:
    """Entities whose class isn't hidden, and whose name or class holds ``query``, case aside."""
    said = F.lower(name).contains(query.lower()) | F.lower(kind).contains(query.lower())
    return entities.where(~F.col(kind).isin(hidden) & said)


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 0).when(severity == "warning", 1).otherwise(2)


def category_distribution(df: DataFrame, column: str, missing: str = "Unavailable") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("key")).agg(F.count("*").alias("n"))


def bucket_key(x: Column) -> Column:
    return F.when(x.isNull(), "unavailable").when(x <= 256, "<=256").when(x <= 512, "257-512").when(x <= 1024, "513-1024").otherwise(">1024")


def bucket_rank(key: Column) -> Column:
    return F.when(key == "<=256", 0).when(key == "257-512", 1).when(key == "513-1024", 2).when(key == ">1024", 3).otherwise(4)


def bucket_distribution(df: DataFrame, value: Column) -> DataFrame:
    """Counts of the buckets that occur, with the rank that orders them."""
    counts = df.groupBy(bucket_key(value).alias("bucket")).agg(F.count("*").alias("n"))
    return counts.withColumn("bucket_rank", bucket_rank(F.col("bucket")))


def coverage(df: DataFrame, status: str = "status") -> DataFrame:
    """How much was discovered, inspected, partial and failed; partial as soon as anything is."""
    n = lambda value: F.count_if(F.col(status) == value)
    counts = df.agg(F.count("*").alias("discovered"), F.count_if(F.col(status) != "failed").alias("inspected"), n("partial").alias("partial"), n("failed").alias("failed"))
    return counts.withColumn("coverage", F.when((F.col("partial") > 0) | (F.col("failed") > 0), "partial").otherwise("complete"))


def guard_limit(df: DataFrame, maximum: int) -> DataFrame:
    """``df``, or an error if it has more than ``maximum`` rows; no more than one above that are counted."""
    if df.limit(maximum + 1).count() > maximum:
        raise ValueError(f"more than {maximum} rows")
    return df


def latency_distribution(df: DataFrame, key: str, value: str) -> DataFrame:
    """Count, mean, least, greatest and nearest-rank percentiles of each key; nulls aside.

    Equal values of a key are counted first. Its distinct values are then range-partitioned by key and value, at edges that follow the
    values' distribution, so a key with most of the rows takes many tasks however its values are spread; running counts over them tell the ranks.
    """
    rows = df.where(F.col(value).isNotNull()).groupBy(F.struct(F.col(key).alias("v")).alias("k"), F.col(value).alias("x")).agg(F.count("*").alias("c"))
    rows = scan(rows, ["k"], ["x"], sums={"upto": F.col("c")})
    whole = staged(rows.groupBy("k").agg(F.sum("c").alias("n"), (F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("mean"), F.min("x").alias("least"), F.max("x").alias("most")), "keys")
    at = lambda q, name: F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * q), F.col("x"))).alias(name)
    found = met(rows, whole.select("k", "n"), ["k"], "x").groupBy("k").agg(at(0.5, "p50"), at(0.95, "p95"))
    return whole.join(found, "k").select(F.col("k.v").alias(key), *[c for c in whole.columns if c != "k"], "p50", "p95")


def metrics(df: DataFrame, key: str, value: Column, bounds: list[float], covered: Column) -> DataFrame:
    """Of each key: how often ``value`` was told, its total, its counts at or below each bound, and the share that is ``covered``, from 0 to 1."""
    told = [F.count(value).alias("n"), F.sum(value).alias("total"), *[F.count_if(value <= b).alias(f"le_{b:g}") for b in bounds]]
    gauge = F.least(F.greatest(F.count_if(covered) / F.count("*"), F.lit(0.0)), F.lit(1.0))
    return df.groupBy(key).agg(*told, gauge.alias("coverage"))
