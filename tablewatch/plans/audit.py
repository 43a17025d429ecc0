"""Audit queries: evidence, predicates, findings, distributions, coverage, order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .. import sources as src
from ..functions import clamp, framing_verdict, instance_key, max_abs_delta, parse_edit
from ..operators import audit as a, values as vals
from ..operators.scans import dense_index
from ..sources import artifact_hash, quarantine_split, scan_snapshots
from ..sources.staging import shared_folder
from .common import table

RULES = [("dimensions.power_of_two", "power_of_two", "warning", None, None), ("dimensions.small_max_30", "group_maximum", "error", "SMALL PLATED TIN", 30), ("dimensions.max_40", "group_maximum", "error", "ECONOMY", 40)]
_RULES_SQL = "(VALUES ('dimensions.power_of_two','power_of_two','warning',NULL,NULL), ('dimensions.small_max_30','group_maximum','error','SMALL PLATED TIN',30), ('dimensions.max_40','group_maximum','error','ECONOMY',40)) r(rule_id, kind, severity, rule_group, maximum)"
_RECORDS_SQL = "SELECT 'part/' || CAST(p_partkey AS VARCHAR) AS object_path, p_type AS record_group, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_size END AS width, p_size AS height FROM part"
_FINDINGS_SQL = f"""SELECT object_path, rule_id, severity FROM ({_RECORDS_SQL}) p, {_RULES_SQL} WHERE width IS NOT NULL AND height IS NOT NULL AND (
  (kind = 'power_of_two' AND NOT (width > 0 AND (width & (width - 1)) = 0)) OR (kind = 'group_maximum' AND record_group = rule_group AND greatest(width, height) > maximum))"""


def records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("object_path"), F.col("p_type").alias("record_group"), F.when(F.col("p_partkey") % 10 != 0, F.col("p_size")).alias("width"), F.col("p_size").alias("height"))


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_id string, kind string, severity string, rule_group string, maximum int")


def findings(spark: SparkSession, d: str) -> DataFrame:
    return a.evaluate_rules(records(spark, d), rules(spark))


def _evidence(s, d):
    e = table(s, d, "events").select("event_id", a.json_evidence(F.col("props"), "k", "int").alias("k"), a.json_evidence(F.col("props"), "absent", "int").alias("absent"))
    return e.select("event_id", F.col("k.status").alias("k_status"), F.col("k.value").alias("k_value"), F.col("k.reason").alias("k_reason"), F.col("absent.reason").alias("absent_reason"))


def _quarantine(s, d):
    planted = table(s, d, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props")).alias("props"))
    good, bad = quarantine_split(planted, "props")
    return good.select("event_id", F.lit("loaded").alias("outcome")).unionByName(bad.select("event_id", F.lit("quarantined").alias("outcome")))


def _incremental(s, d):
    now = table(s, d, "part").where("p_partkey % 17 <> 0").select("p_partkey", "p_size", "p_name")
    before = table(s, d, "part").where("p_partkey % 13 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 10 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"), "p_name")
    return src.incremental_catalog(before, now, "p_partkey", ["p_size", "p_name"], F.col("p_partkey") % 29 == 0)


_INCREMENTAL = """SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN 'deleted' WHEN p_partkey % 29 = 0 THEN 'failed' WHEN p_partkey % 13 = 0 THEN 'added' WHEN p_partkey % 10 = 0 THEN 'changed' ELSE 'hit' END AS outcome
FROM part WHERE NOT (p_partkey % 17 = 0 AND p_partkey % 13 = 0)"""


def _documents(s, d):
    """An inspection for each order, as JSON: its lines are assets, their kinds follow the return flag."""
    kind = F.when(F.col("l_returnflag") == "A", "DataTable").when(F.col("l_returnflag") == "N", "CompositeDataTable").otherwise("StringTable")
    asset = F.struct(F.concat_ws("/", F.lit("order"), "l_orderkey", "l_linenumber").alias("path"), kind.alias("kind"))
    assets = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(asset).alias("assets"))
    return table(s, d, "orders").join(assets, "o_orderkey", "left").select("o_orderkey", F.to_json(F.struct(F.lit(7).alias("schema_version"), F.when(F.col("o_orderstatus") == "P", "partial").otherwise("ok").alias("status"), "assets")).alias("document"))


def _inspected(s, d):
    return src.inspections(_documents(s, d), "document")


def _run(s, d):
    """Orders written as a run and read back."""
    path = f"{shared_folder(s)}/runs-{uuid.uuid4().hex}"
    src.write_run(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), path, "first")
    return src.read_runs(s, path).drop("run_id")


def _listed(s, d):
    """Pages written as files by their id's last digit, then found again by suffix; the files of every digit are there."""
    path = f"{shared_folder(s)}/pages-{uuid.uuid4().hex}"
    table(s, d, "pages").select((F.col("page_id") % 10).alias("digit"), "url").where("url is not null").write.partitionBy("digit").text(path)
    found = src.discover_files(s, path, ".TXT")
    return found.groupBy(F.regexp_extract("path", "digit=([0-9]+)", 1).cast("long").alias("digit")).agg((F.sum("length") > 0).alias("has_bytes"))


def _scanned(s, d):
    """The same inspections, written as files and scanned."""
    path = f"{shared_folder(s)}/inspections-{uuid.uuid4().hex}"
    _documents(s, d).select("document").write.text(path)
    return src.scan_inspections(s, path).select("status", F.size("assets").alias("n_assets"), F.size("decode_errors").alias("n_errors"))


def _types(s, d):
    """Order lines as nested values, checked against what is described of them."""
    line = F.struct(F.col("l_returnflag").alias("flag"), F.when(F.col("l_linenumber") != 7, F.col("l_quantity").cast("int")).alias("count"), F.col("l_partkey").alias("part"))
    docs = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(line).alias("lines"))).alias("json"))
    described = {"kind": "struct", "fields": {"lines": ({"kind": "array", "element": {"kind": "struct", "fields": {"flag": ({"kind": "enum", "options": ["A", "N"]}, True), "count": ({"kind": "uint"}, True), "part": ({"kind": "row_reference"}, False)}}}, True)}}
    return docs.select("l_orderkey", vals.compatible(F.parse_json("json"), described).alias("compatible"))


def _shown(s, d):
    v = F.struct((F.col("p_size") > 25).alias("large"), F.array("p_brand", "p_type").alias("names"), F.struct(F.lit("part").alias("table_path"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_name")).alias("row_name")).alias("ref"))
    rows = table(s, d, "part").select("p_partkey", v.alias("v"))
    return rows.select("p_partkey", vals.format_value(F.col("v"), rows.schema["v"].dataType).alias("shown"))


def _summaries(s, d):
    e = table(s, d, "embeddings")
    rows = e.select("vec_id", "embedding", F.struct("vec_id", "label").alias("pair"), F.create_map(F.lit("label"), F.col("label")).alias("named"))
    kind = lambda c: vals.value_summary(F.col(c), rows.schema[c].dataType).alias(c)
    return rows.select(F.col("vec_id").alias("id"), *[kind(c) for c in ("embedding", "pair", "named", "vec_id")])


def _searches(s, d):
    docs = table(s, d, "documents").select("doc_id", "text", "source", "lang")
    found = [a.search(docs, q, ["text", "source", "lang"]).select(F.lit(q).alias("query"), "doc_id") for q in ("The  SRC1", "the zz9 absent", "")]
    return found[0].union(found[1]).union(found[2])


_HAYSTACK = "lower(concat_ws(chr(10), text, source, lang))"


def _snapshots(s, d):
    new = table(s, d, "customer").select(F.col("c_name").alias("path"), F.lit("editor").alias("producer"))
    old = table(s, d, "supplier").select(F.col("s_name").alias("path"))
    return scan_snapshots(new, old)


def _coverage(s, d):
    docs = table(s, d, "documents").select("doc_id").join(table(s, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", "left")
    return a.coverage(docs.select(F.when(F.col("quality").isNull(), "failed").when(F.col("quality") == 0, "partial").otherwise("ok").alias("status")))


def _verdict(s, d):
    v = table(s, d, "events").where("value is not null")
    return v.select("event_id", framing_verdict(F.col("event_id") % 11 != 0, F.when(F.col("event_id") % 7 == 0, 0.0).when(F.col("event_id") % 5 == 0, 0.5).otherwise(1.0), clamp(F.col("value") / 100, 0.0, 1.0), F.lit(0.1)).alias("verdict"))


QUERIES = {
    "rule_evaluation": (findings, _FINDINGS_SQL),
    "scan_rules": (lambda s, d: a.scan_rules(rules(s)).join(table(s, d, "part").groupBy(F.col("p_type").alias("rule_group")).agg(F.count("*").alias("n_records")), "rule_group", "left").select("rule_id", "kind", "n_records"), f"SELECT rule_id, kind, n AS n_records FROM {_RULES_SQL} LEFT JOIN (SELECT p_type, count(*) n FROM part GROUP BY 1) ON p_type = rule_group"),
    "scan_limit_guard": (lambda s, d: a.guard_limit(table(s, d, "orders"), 10_000_000).select("o_orderkey"), "SELECT o_orderkey FROM orders"),
    "finding_order": (lambda s, d: a.finding_order(findings(s, d)).withColumn("severity_rank", a.severity_rank(F.col("severity"))), f"SELECT *, CAST(CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS INTEGER) AS severity_rank FROM ({_FINDINGS_SQL}) ORDER BY severity_rank, rule_id, object_path"),
    "findings_only": (lambda s, d: records(s, d).join(findings(s, d), "object_path", "left_semi").where(F.col("object_path").contains("1")).select("object_path"), f"SELECT object_path FROM ({_RECORDS_SQL}) WHERE object_path IN (SELECT object_path FROM ({_FINDINGS_SQL})) AND contains(object_path, '1')"),
    "record_projection": (lambda s, d: records(s, d).select("object_path", "record_group", (F.col("width").isNotNull() & F.col("height").isNotNull()).alias("has_dimensions"), F.greatest("width", "height").alias("largest")), f"SELECT object_path, record_group, width IS NOT NULL AND height IS NOT NULL AS has_dimensions, greatest(width, height) AS largest FROM ({_RECORDS_SQL})"),
    "asset_class_filter": (lambda s, d: table(s, d, "part").where(F.col("p_type") == "ECONOMY").select("p_partkey"), "SELECT p_partkey FROM part WHERE p_type = 'ECONOMY'"),
    "power_of_two": (lambda s, d: table(s, d, "part").select("p_partkey", a.power_of_two(F.col("p_size")).alias("ok")), "SELECT p_partkey, p_size > 0 AND (p_size & (p_size - 1)) = 0 AS ok FROM part"),
    "finite_guard": (lambda s, d: table(s, d, "events").where(a.finite(F.col("value"))).select("event_id"), "SELECT event_id FROM events WHERE value IS NOT NULL AND isfinite(value)"),
    "evidence_extract": (_evidence, """WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k, props FROM events)
SELECT event_id, CASE WHEN TRY_CAST(k AS INTEGER) IS NOT NULL THEN 'available' ELSE 'unavailable' END AS k_status, TRY_CAST(k AS INTEGER) AS k_value,
CASE WHEN TRY_CAST(k AS INTEGER) IS NOT NULL THEN NULL WHEN props IS NULL THEN 'missing_source' WHEN k IS NULL THEN 'not_serialized' ELSE 'wrong_value_kind' END AS k_reason,
CASE WHEN props IS NULL THEN 'missing_source' ELSE 'not_serialized' END AS absent_reason FROM e"""),
    "parse_edit": (lambda s, d: table(s, d, "events").select("event_id", parse_edit(F.get_json_object("props", "$.k"), "int", [str(i) for i in range(50)], F.col("event_type") == "signup").alias("e")).select("event_id", "e.value", "e.status"), "SELECT event_id, CASE WHEN status = 'ok' THEN k END AS value, status FROM (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CASE WHEN event_type = 'signup' THEN 'read_only' WHEN json_extract_string(props, '$.k') IS NULL THEN 'missing' WHEN TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) IS NULL THEN 'not_parseable' WHEN TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) NOT BETWEEN 0 AND 49 THEN 'not_an_option' ELSE 'ok' END AS status FROM events)"),
    "category_distribution": (lambda s, d: a.category_distribution(table(s, d, "part"), "p_type"), "SELECT coalesce(p_type, 'Unavailable') AS key, count(*) AS n FROM part GROUP BY 1"),
    "bucket_distribution": (lambda s, d: a.bucket_distribution(table(s, d, "orders"), F.col("o_totalprice")), "SELECT *, CAST(CASE bucket WHEN '<=256' THEN 0 WHEN '257-512' THEN 1 WHEN '513-1024' THEN 2 WHEN '>1024' THEN 3 ELSE 4 END AS INTEGER) AS bucket_rank FROM (SELECT CASE WHEN o_totalprice IS NULL THEN 'unavailable' WHEN o_totalprice <= 256 THEN '<=256' WHEN o_totalprice <= 512 THEN '257-512' WHEN o_totalprice <= 1024 THEN '513-1024' ELSE '>1024' END AS bucket, count(*) AS n FROM orders GROUP BY 1)"),
    "bucket_drilldown": (lambda s, d: table(s, d, "orders").where(a.bucket_key(F.col("o_totalprice")) == "513-1024").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_totalprice > 512 AND o_totalprice <= 1024"),
    "scan_coverage": (_coverage, "WITH l AS (SELECT doc_id, max(quality) q FROM labels GROUP BY 1), s AS (SELECT CASE WHEN q IS NULL THEN 'failed' WHEN q = 0 THEN 'partial' ELSE 'ok' END AS status FROM documents LEFT JOIN l USING (doc_id)) SELECT count(*) AS discovered, count(*) FILTER (status <> 'failed') AS inspected, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'failed') AS failed, CASE WHEN count(*) FILTER (status <> 'ok') > 0 THEN 'partial' ELSE 'complete' END AS coverage FROM s"),
    "latency_distribution": (lambda s, d: a.latency_distribution(table(s, d, "events"), "event_type", "value").withColumn("mean", F.round("mean", 6)), "SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1"),
    "metric_histogram": (lambda s, d: a.metrics(table(s, d, "events"), "event_type", F.col("value"), [10, 25, 50, 100], F.col("event_id") % 4 != 0).withColumn("total", F.round("total", 4)), "SELECT event_type, count(value) AS n, round(sum(value), 4) AS total, count(*) FILTER (value <= 10) AS le_10, count(*) FILTER (value <= 25) AS le_25, count(*) FILTER (value <= 50) AS le_50, count(*) FILTER (value <= 100) AS le_100, count(*) FILTER (event_id % 4 <> 0) / count(*) AS coverage FROM events GROUP BY 1"),
    "class_counts": (lambda s, d: table(s, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")), "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1"),
    "failure_counts": (lambda s, d: table(s, d, "events").groupBy(F.col("event_type").alias("code")).agg(F.count("*").alias("n")).withColumn("retry_safe", F.col("code") != "error"), "SELECT event_type AS code, count(*) AS n, event_type <> 'error' AS retry_safe FROM events GROUP BY 1"),
    "diagnostic_limit": (lambda s, d: table(s, d, "events").where("event_type = 'error'").orderBy("event_id").limit(100).select("event_id", "event_type"), "SELECT event_id, event_type FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 100"),
    "latest_runs": (lambda s, d: table(s, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "o_orderdate"), "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey"),
    "latest_session": (lambda s, d: table(s, d, "orders").where("o_orderstatus in ('O', 'P')").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(1).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P') ORDER BY o_orderdate DESC, o_orderkey LIMIT 1"),
    "session_list": (lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("updated_at")), "SELECT o_custkey, max(o_orderdate) AS updated_at FROM orders GROUP BY 1"),
    "text_search": (_searches, f"SELECT 'The  SRC1' AS query, doc_id FROM documents WHERE contains({_HAYSTACK}, 'the') AND contains({_HAYSTACK}, 'src1') UNION ALL SELECT 'the zz9 absent', doc_id FROM documents WHERE contains({_HAYSTACK}, 'the') AND contains({_HAYSTACK}, 'zz9') AND contains({_HAYSTACK}, 'absent') UNION ALL SELECT '', doc_id FROM documents"),
    "capability_filter": (lambda s, d: a.with_capability(table(s, d, "documents").select("doc_id", "source"), table(s, d, "labels").select("doc_id", F.when(F.col("toxic") == 0, "editable").otherwise("read_only").alias("capability")), "doc_id", "editable"), "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)"),
    "row_filter": (lambda s, d: a.row_filter(table(s, d, "part"), "12", ["p_name", "p_brand", "p_type", "p_size"]).select("p_partkey"), "SELECT p_partkey FROM part WHERE contains(lower(p_name), '12') OR contains(lower(p_brand), '12') OR contains(lower(p_type), '12') OR contains(CAST(p_size AS VARCHAR), '12')"),
    "entity_filter": (lambda s, d: a.entity_filter(table(s, d, "customer"), "c_name", "c_mktsegment", "1", ["BUILDING", "MACHINERY"]).select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND (contains(lower(c_name), '1') OR contains(lower(c_mktsegment), '1'))"),
    "artifact_hash": (lambda s, d: table(s, d, "documents").select("doc_id", artifact_hash(F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")), "SELECT doc_id, 'sha256:' || sha256(text) AS digest, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents"),
    "scan_snapshots": (_snapshots, "SELECT c_name AS path, 'editor' AS producer, 'current' AS classification FROM customer UNION ALL SELECT s_name, NULL, 'legacy_read_only' FROM supplier"),
    "quarantine_split": (_quarantine, "SELECT event_id, CASE WHEN props IS NOT NULL AND event_id % 9 <> 0 THEN 'loaded' ELSE 'quarantined' END AS outcome FROM events"),
    "incremental_catalog": (_incremental, _INCREMENTAL),
    "file_discovery": (lambda s, d: src.with_suffix(table(s, d, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("path")), "path", "1").select("page_id", "path"), r"SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages WHERE ends_with(lower(regexp_replace(url, '[?#].*$', '')), '1')"),
    "session_migration": (lambda s, d: src.migrate_sessions(table(s, d, "orders").where("o_custkey % 2 = 0").select("o_orderkey", F.lit(1).alias("version")), table(s, d, "orders").where("o_custkey % 2 <> 0").join(table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_linenumber").alias("save_receipts")), "o_orderkey", "left").select("o_orderkey", F.lit(2).alias("version"), "save_receipts")).select("o_orderkey", "migrated", "version", F.size("save_receipts").alias("n_receipts")), "SELECT o_orderkey, o_custkey % 2 = 0 AS migrated, CAST(2 AS INTEGER) AS version, CAST(CASE WHEN o_custkey % 2 = 0 THEN 0 ELSE (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) END AS INTEGER) AS n_receipts FROM orders"),
    "table_descriptors": (lambda s, d: src.table_descriptors(_inspected(s, d)), "SELECT 'order/' || l_orderkey || '/' || l_linenumber AS table_path, CASE l_returnflag WHEN 'A' THEN 'DataTable' ELSE 'CompositeDataTable' END AS kind, CASE o_orderstatus WHEN 'P' THEN 'partial' ELSE 'complete' END AS completeness FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag IN ('A', 'N')"),
    "type_compatibility": (_types, "SELECT l_orderkey, bool_and(l_returnflag IN ('A', 'N') AND l_linenumber <> 7 AND l_quantity >= 0) AS compatible FROM lineitem GROUP BY 1"),
    "instance_key": (lambda s, d: table(s, d, "customer").select("c_custkey", instance_key(F.col("c_mktsegment"), F.concat(F.lit("/Game/UEDPIE_0_Map.Map:PersistentLevel."), F.when(F.col("c_custkey") % 2 == 0, F.lit("UEDPIE_12_")).otherwise(""), "c_name")).alias("key")), "SELECT c_custkey, c_mktsegment || ':' || c_name AS key FROM customer"),
    "drift_check": (lambda s, d: table(s, d, "customer").select("c_custkey", (max_abs_delta((F.col("c_acctbal"), F.floor("c_acctbal"))) > 0.5).alias("drifted")), "SELECT c_custkey, abs(c_acctbal - floor(c_acctbal)) > 0.5 AS drifted FROM customer"),
    "framing_verdict": (_verdict, "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'unprojectable' WHEN event_id % 7 = 0 THEN 'outside' WHEN event_id % 5 = 0 THEN 'partial' WHEN least(greatest(value / 100, 0.0), 1.0) < 0.1 THEN 'margin_too_small' ELSE 'ok' END AS verdict FROM events WHERE value IS NOT NULL"),
    "dense_index": (lambda s, d: dense_index(table(s, d, "events").select("event_id", "event_type"), ["event_type"], ["event_id"], "stream_index"), "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS stream_index FROM events"),
    "value_summary": (_summaries, "SELECT vec_id AS id, CAST(len(embedding) AS VARCHAR) || ' items' AS embedding, '2 fields' AS pair, '1 entries' AS named, 'bigint' AS vec_id FROM embeddings"),
    "format_value": (_shown, "SELECT p_partkey, '{large: ' || CASE WHEN p_size > 25 THEN 'True' ELSE 'False' END || ', names: [' || p_brand || ', ' || p_type || '], ref: part -> ' || CASE WHEN p_partkey % 7 <> 0 THEN p_name ELSE 'None' END || '}' AS shown FROM part"),
    "catalog_report": (lambda s, d: src.catalog_report(_incremental(s, d)), f"SELECT count(*) FILTER (outcome = 'hit') AS hit, count(*) FILTER (outcome = 'changed') AS changed, count(*) FILTER (outcome = 'added') AS added, count(*) FILTER (outcome = 'deleted') AS deleted, count(*) FILTER (outcome = 'failed') AS failed FROM ({_INCREMENTAL})"),
    "scan_inspections": (lambda s, d: _inspected(s, d).select("o_orderkey", "status", F.size("assets").alias("n_assets"), F.size("decode_errors").alias("n_errors")), "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'partial' ELSE 'ok' END AS status, CAST(count(l_orderkey) AS INTEGER) AS n_assets, CAST(0 AS INTEGER) AS n_errors FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2"),
    "scan_inspection_files": (_scanned, "SELECT CASE WHEN o_orderstatus = 'P' THEN 'partial' ELSE 'ok' END AS status, CAST(count(l_orderkey) AS INTEGER) AS n_assets, CAST(0 AS INTEGER) AS n_errors FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, 1"),
    "file_listing": (_listed, "SELECT page_id % 10 AS digit, true AS has_bytes FROM pages WHERE url IS NOT NULL GROUP BY 1"),
    "run_sink": (_run, "SELECT o_orderkey, o_orderstatus FROM orders"),
}
