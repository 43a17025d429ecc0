"""Queries on texts, inputs, cells, sessions and apply decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import audit as a, changes as c, corpus as co, folds as fo, review as v, values as vals
from ..operators.scans import apart
from ..sources.staging import staged
from .changes import _COMMANDS, _commands
from .common import table


def _occurrences(s: SparkSession, d: str) -> DataFrame:
    """Texts of documents and pages, each as one JSON value with texts at several depths."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("entry"), F.to_json(F.struct("lang", F.struct("text", "source").alias("body"), F.array("source", "lang").alias("tags"), F.struct(F.col("lang").alias("raw")).alias("undecoded"), "n_chars")).alias("json"))
    pages = table(s, d, "pages").select(F.col("page_id").alias("entry"), F.to_json(F.struct(F.array(F.struct("url")).alias("links"))).alias("json"))
    found = v.text_occurrences(docs, "documents", "table_cell").unionByName(v.text_occurrences(pages, "pages", "asset", F.when(F.col("entry") % 2 == 0, "read_only").otherwise("editable")))
    return found.withColumn("n_bytes", F.octet_length("text").cast("long")).drop("text")


_OCCURRENCES = " UNION ALL ".join(f"SELECT 'documents' AS package, 'table_cell' AS location, CAST(doc_id AS VARCHAR) AS entry, '{path}' AS value_path, 'editable' AS capability, CAST(strlen({column}) AS BIGINT) AS n_bytes FROM documents WHERE {column} IS NOT NULL" for path, column in (("$.lang", "lang"), ("$.body.text", "text"), ("$.body.source", "source"), ("$.tags[0]", "source"), ("$.tags[1]", "lang"))) + """
 UNION ALL SELECT 'pages', 'asset', CAST(page_id AS VARCHAR), '$.links[0].url', CASE WHEN page_id % 2 = 0 THEN 'read_only' ELSE 'editable' END, CAST(strlen(url) AS BIGINT) FROM pages WHERE url IS NOT NULL"""


def _diagnostics(s: SparkSession, d: str) -> DataFrame:
    return v.coded(table(s, d, "labels"), "doc_id", (F.col("quality").isNull(), "failed"), (F.col("quality") == 0, "partially_decoded"), (F.col("toxic") == 1, "unsupported"))


_DIAGNOSTICS = "SELECT doc_id, 'failed' AS code FROM labels WHERE quality IS NULL UNION ALL SELECT doc_id, 'partially_decoded' FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 'unsupported' FROM labels WHERE toxic = 1"


def _gaps(s: SparkSession, d: str) -> DataFrame:
    """Events as nested values, some of which stayed raw; those in a list aren't looked for."""
    raw = lambda text: F.struct(text.alias("raw"))
    json = F.when(F.col("event_type") == "error", F.to_json(F.struct(raw(F.col("props")).alias("a")))).when(F.col("event_type") == "click", F.to_json(F.struct(F.struct(raw(F.lit("00")).alias("b"), F.col("value").alias("c")).alias("a")))).when(F.col("event_type") == "signup", F.to_json(F.struct(F.array(raw(F.lit("00"))).alias("list")))).otherwise(F.col("props"))
    return v.decode_gaps(table(s, d, "events").select(F.col("event_id").alias("entry"), json.alias("json")))


def _classes(s: SparkSession, d: str) -> DataFrame:
    """Snapshots of customers' orders, and which are partial: those with an order that is unsupported."""
    rows = table(s, d, "orders").select("o_custkey", F.concat(F.lit("row:"), F.col("o_orderkey").cast("string")).alias("row_id"), (F.col("o_orderstatus") == "P").alias("unsupported"))
    return v.snapshot_projection(rows, "o_custkey", "unsupported").select("o_custkey", "row_id", "completeness")


def _mappings(s: SparkSession, d: str) -> DataFrame:
    turns = table(s, d, "conversations").where("turn is not null")
    new = turns.where("role = 'user' and conv_id % 2 = 0").select("conv_id", "turn")
    return v.mapping_rows(new, turns.select("conv_id", "turn"), "conv_id", "turn").withColumnRenamed("turn", "value")


_MAPPINGS = """WITH n AS (SELECT conv_id FROM conversations WHERE role = 'user' AND conv_id % 2 = 0 AND turn IS NOT NULL GROUP BY 1),
t AS (SELECT c.conv_id, turn, CASE WHEN n.conv_id IS NULL THEN 'legacy' ELSE 'container' END AS origin FROM conversations c LEFT JOIN n ON n.conv_id = c.conv_id WHERE turn IS NOT NULL AND (n.conv_id IS NULL OR role = 'user'))
SELECT conv_id, origin, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, turn AS value FROM t"""


def _actions(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "customer").select("c_custkey", a.evidence(F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")), "name").alias("e"), a.evidence(F.col("c_mktsegment"), "segment").alias("t"))
    return e.select("c_custkey", F.col("e.status").alias("description_status"), F.col("e.reason").alias("description_reason"), F.col("t.value").alias("value_type"))


def _cells(s: SparkSession, d: str) -> DataFrame:
    return v.cells(table(s, d, "part"), "p_partkey", ["p_name", "p_brand", "p_size"])


def _lookup(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    refs = rows.select("l_orderkey", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber") + 1).alias("target"))
    return v.local_lookup(refs, rows, "l_orderkey", "target", "l_linenumber", "l_returnflag")


def _invert(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_linenumber") % 3 == 0, "add").when(F.col("l_linenumber") % 3 == 1, "remove").otherwise("set_cell")
    log = table(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("seq"), kind.alias("kind"), F.col("l_returnflag").alias("old_value"), F.col("l_linestatus").alias("new_value"))
    return v.invert(log, "kind", "seq", "old_value", "new_value")


def _intents(s: SparkSession, d: str) -> DataFrame:
    """Order lines as intents on parts, which are tables by brand."""
    at = Window.partitionBy("p_brand").orderBy("p_partkey")
    rows = table(s, d, "part").select(F.col("p_brand").alias("table_path"), (F.row_number().over(at) - 1).alias("row_index"), F.col("p_partkey").alias("row_id"), F.col("p_name").alias("row_name"))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("add", "duplicate", "remove", "rename", "swap")]), F.col("l_linenumber") % 5 + 1)
    name = F.when(F.col("l_quantity") == 7, "None").when(F.col("l_quantity") < 5, F.upper("p_name")).otherwise(F.concat(F.lit("New "), F.col("l_orderkey").cast("string")))
    lines = table(s, d, "lineitem").join(table(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("table_path"), "p_name"), F.col("l_suppkey") == F.col("k"))
    intents = lines.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("intent_id")).agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "table_path", kind.alias("kind"), F.when(F.col("l_quantity") % 3 == 0, F.col("l_partkey")).otherwise(F.col("l_suppkey")).alias("row_id"), name.alias("row_name"), F.when(F.col("l_quantity") > 40, (F.col("l_quantity") - 20).cast("int")).alias("at_index"))).alias("x")).select("intent_id", "x.*")
    return c.row_intents(intents, rows)


_INTENTS = """WITH r AS (SELECT p_brand AS t, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, p_partkey AS k, p_name AS n, count(*) OVER (PARTITION BY p_brand) AS size FROM part),
x AS (SELECT l_orderkey * 10 + l_linenumber AS intent_id, l_orderkey, l_linenumber % 5 AS a, arg_min(l_suppkey, (l_partkey, l_suppkey, l_quantity)) AS s, arg_min(l_quantity, (l_partkey, l_suppkey, l_quantity)) AS q, min(l_partkey) AS p FROM lineitem JOIN part ON p_partkey = l_suppkey GROUP BY 1, 2, 3),
y AS (SELECT intent_id, a, t, size, CASE WHEN q % 3 = 0 THEN p ELSE s END AS k, CASE WHEN q = 7 THEN 'None' WHEN q < 5 THEN upper(n) ELSE 'New ' || l_orderkey END AS name, CASE WHEN q > 40 THEN CAST(q - 20 AS INTEGER) END AS place FROM x JOIN r ON r.k = s),
z AS (SELECT y.*, r.i, r.n AS old, EXISTS (SELECT 1 FROM r o WHERE o.t = y.t AND lower(o.n) = lower(y.name) AND (y.a <> 3 OR o.k <> y.k)) AS taken, CASE a WHEN 0 THEN coalesce(place, size) WHEN 1 THEN coalesce(place, r.i + 1) WHEN 2 THEN r.i END AS spot FROM y LEFT JOIN (SELECT t, i, k, n FROM r) r ON r.t = y.t AND r.k = y.k),
u AS (SELECT *, CASE WHEN a = 4 THEN 'unknown_intent' WHEN a <> 0 AND i IS NULL THEN 'row_not_found' WHEN a <> 2 AND lower(name) = 'none' THEN 'invalid_row_name' WHEN a <> 2 AND taken THEN 'duplicate_row_name' WHEN a < 2 AND spot > size THEN 'invalid_row_order' ELSE 'accepted' END AS status FROM z)
SELECT intent_id, status, CASE WHEN status = 'accepted' THEN spot END AS place, CASE WHEN status = 'accepted' AND a <> 0 THEN old END AS old_name FROM u"""


def _reorders(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "orders").select(F.col("o_custkey").alias("table_path"), F.col("o_orderkey").alias("row_id"))
    asked = rows.select(F.col("table_path").alias("intent_id"), "table_path", F.when((F.col("row_id") % 40 == 0) | (F.col("table_path") % 7 == 0), F.col("row_id") + 1).otherwise(F.col("row_id")).alias("row_id"))
    return c.reorder_intents(asked, rows)


def _defaults(s: SparkSession, d: str) -> DataFrame:
    """Rows wanted for orders' customers, in tables named by segment; parts' types are the fields of their brands' schemas."""
    schema = table(s, d, "part").groupBy(F.substring("p_brand", -1, 1).alias("table_path"), F.col("p_type").alias("field")).agg(F.min("p_name").alias("default_value"), (F.max("p_size") > 40).alias("known"))
    wanted = table(s, d, "orders").select((F.col("o_custkey") % 8).cast("string").alias("table_path"), F.col("o_orderkey").alias("row_id"), F.concat(F.lit("Row "), F.col("o_orderkey").cast("string")).alias("row_name"))
    return c.default_rows(wanted, schema).select("row_id", "status", F.array_join(F.transform("fields", lambda f: F.concat(f["field"], F.lit("="), f["value"])), ",").alias("fields"))


_DEFAULTS = """WITH s AS (SELECT right(p_brand, 1) AS t, p_type AS field, min(p_name) AS v, max(p_size) > 40 AS known FROM part GROUP BY 1, 2),
t AS (SELECT t, bool_and(known) AS known, string_agg(field || '=' || v, ',' ORDER BY field) AS fields FROM s GROUP BY 1)
SELECT o_orderkey AS row_id, CASE WHEN coalesce(known, false) THEN 'created' ELSE 'unsupported_add' END AS status, CASE WHEN known THEN fields END AS fields FROM orders LEFT JOIN t ON t = CAST(o_custkey % 8 AS VARCHAR)"""


def _validation(s: SparkSession, d: str) -> DataFrame:
    """Names, required fields and types of part, with the severity of each."""
    p = table(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 == 0, "None").otherwise(F.col("p_name")).alias("name"), F.when(F.col("p_partkey") % 15 != 0, F.col("p_brand")).alias("brand"), F.when(F.col("p_partkey") % 21 == 0, "x").otherwise(F.col("p_size").cast("string")).alias("size"))
    found = v.coded(p, "p_partkey", (c.row_name_problem(F.col("name")).isNotNull(), "invalid_row_name"), (F.col("brand").isNull(), "missing_required_field"), (~vals.text_fits(F.col("size"), "int"), "incompatible_value"), (F.col("p_partkey") % 25 == 0, "undescribed_field"))
    return found.withColumn("severity", F.when(F.col("code") == "undescribed_field", "warning").otherwise("error"))


_VALIDATION = """SELECT p_partkey, code, CASE WHEN code = 'undescribed_field' THEN 'warning' ELSE 'error' END AS severity FROM (
SELECT p_partkey, 'invalid_row_name' AS code FROM part WHERE p_partkey % 10 = 0 OR p_name IS NULL OR p_name = '' OR lower(p_name) = 'none'
UNION ALL SELECT p_partkey, 'missing_required_field' FROM part WHERE p_partkey % 15 = 0 OR p_brand IS NULL
UNION ALL SELECT p_partkey, 'incompatible_value' FROM part WHERE p_partkey % 21 = 0 UNION ALL SELECT p_partkey, 'undescribed_field' FROM part WHERE p_partkey % 25 = 0)"""


def _accept(s: SparkSession, d: str) -> DataFrame:
    """Parts by type as sessions and brand as tables: some committed copies differ, some tables weren't committed."""
    part = table(s, d, "part").withColumn("path", F.concat_ws("|", "p_type", "p_brand"))
    prints = lambda rows: c.table_fingerprint(rows, "path", "p_partkey", ["p_size"])
    session = F.substring_index("path", "|", 1).alias("session")
    base = prints(part.withColumn("p_size", F.lit(0))).withColumnRenamed("fingerprint", "base")
    counts = part.groupBy("path").agg(F.count("*").alias("commands"))
    drafted = prints(part).join(base, "path").join(counts, "path").select(session, "path", "fingerprint", "base", "commands")
    changed = part.withColumn("p_size", F.when((F.col("p_partkey") % 50 == 0) & (F.length("p_type") % 2 == 0), F.col("p_size") + 1).otherwise(F.col("p_size")))
    committed = prints(changed).select(session, "path", "fingerprint").where("session <> 'PROMO' or not endswith(path, '1')")
    done = v.apply_accept(drafted, committed, "session", "path", "fingerprint")
    return done.join(drafted.select("path", "fingerprint", F.col("base").alias("was")), "path").select("session", "path", "outcome", "clears", (F.col("base_fingerprint") == F.col("fingerprint")).alias("rebased"), (F.col("base_fingerprint") == F.col("was")).alias("kept"))


_ACCEPT = """WITH t AS (SELECT p_type AS session, p_type || '|' || p_brand AS path, count(*) AS n, bool_or(p_partkey % 50 = 0 AND length(p_type) % 2 = 0) AS differs, p_type = 'PROMO' AND ends_with(p_brand, '1') AS gone, bool_and(p_size = 0) AS same FROM part GROUP BY p_type, p_brand),
o AS (SELECT *, CASE WHEN bool_or(gone) OVER (PARTITION BY session) THEN 'snapshot_set_mismatch' WHEN bool_or(differs) OVER (PARTITION BY session) THEN 'fingerprint_mismatch' ELSE 'committed' END AS outcome FROM t)
SELECT session, path, outcome, CASE WHEN outcome = 'committed' THEN n ELSE 0 END AS clears, outcome = 'committed' OR same AS rebased, outcome <> 'committed' OR same AS kept FROM o"""


def _transaction(s: SparkSession, d: str) -> DataFrame:
    """Orders as operations on the tables of their lines' parts, each line a command; some parts are composite, gone or changed, some lines expect another size."""
    part = table(s, d, "part")
    known = part.where("p_size <> 50").select(F.col("p_partkey").cast("string").alias("table_path"), F.when(F.col("p_size") == 49, "changed").otherwise(F.col("p_name")).alias("fingerprint"), (F.col("p_size") == 48).alias("composite"))
    rows = part.select(F.col("p_partkey").cast("string").alias("table_path"), F.lit(0).alias("row_index"), F.lit("row").alias("row_id"), F.col("p_name").alias("row_name"), F.create_map(F.lit("size"), F.col("p_size").cast("string")).alias("fields"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines = table(s, d, "lineitem").withColumn("seq", F.row_number().over(order)).join(apart(part.select("p_partkey", "p_name", "p_size")), F.col("l_partkey") == F.col("p_partkey"), "left")
    lines = staged(lines.select("l_orderkey", "l_partkey", "seq", "l_quantity", "p_name", "p_size"), "lines").withColumn("table_path", F.col("l_partkey").cast("string"))
    steps = lines.select("l_orderkey", "table_path", F.col("p_name").alias("expected"))
    size = F.when(F.col("l_quantity") == 13, "another").otherwise(F.col("p_size").cast("string"))
    commands = lines.select("l_orderkey", "table_path", "seq", F.lit("set_cell").alias("kind"), F.lit("row").alias("row_id"), F.lit("size").alias("field"), size.alias("old_value"), F.col("l_quantity").cast("int").cast("string").alias("new_value"))
    outcomes, after = fo.run_transactions(steps, known, rows, commands, "l_orderkey")
    sizes = after.groupBy("l_orderkey").agg(F.sum(F.col("fields")["size"].cast("long")).alias("sizes"))
    return outcomes.join(apart(sizes), "l_orderkey", "left")


_TRANSACTION = """WITH l AS (SELECT l_orderkey, l_partkey, l_quantity, count(*) OVER (PARTITION BY l_orderkey, l_partkey) AS times, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS seq FROM lineitem),
r AS (SELECT l_orderkey, min(CASE WHEN times > 1 THEN 1 WHEN p_partkey IS NULL OR p_size = 50 THEN 2 WHEN p_size = 48 THEN 3 WHEN p_size = 49 THEN 4 END) AS k, min(seq) FILTER (l_quantity = 13) AS c,
  CAST(sum(p_size) AS BIGINT) AS before, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS after FROM l LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT l_orderkey, CASE WHEN k IS NOT NULL THEN 'rejected' WHEN c IS NOT NULL THEN 'rolled_back' ELSE 'committed' END AS outcome,
 CASE k WHEN 1 THEN 'duplicate_table' WHEN 2 THEN 'table_not_found' WHEN 3 THEN 'read_only_table' WHEN 4 THEN 'fingerprint_mismatch' ELSE CASE WHEN c IS NOT NULL THEN 'command_failed' END END AS code,
 CASE WHEN k IS NULL THEN c END AS command, CASE WHEN k IS NULL THEN CASE WHEN c IS NULL THEN after ELSE before END END AS sizes FROM r"""


def _corpus(s: SparkSession, d: str) -> DataFrame:
    """Documents as entries of string tables, as texts in arrays of table cells, and as texts in structs of objects."""
    said = lambda **more: F.struct(F.lit("text").alias("value_kind"), F.col("text").alias("value"), *[v_.alias(k) for k, v_ in more.items()])
    path = F.concat(F.lit("/Game/"), F.col("doc_id").cast("string"))
    key = F.col("doc_id").cast("string")
    entry = F.struct(path.alias("object_path"), F.lit("StringTable").alias("kind"), F.col("source").alias("string_table_namespace"), F.array(F.struct(key.alias("key"), F.col("text").alias("source"))).alias("string_table_entries"))
    listed = F.struct(F.lit("Titles").alias("name"), F.lit("array").alias("value_kind"), F.array(said(history=F.lit("base"), namespace=F.col("source"), key=F.coalesce("lang", F.lit("")))).alias("values"))
    cell = F.struct(path.alias("object_path"), F.lit("DataTable").alias("kind"), F.array(F.struct(F.lit("r").alias("name"), F.array(listed).alias("properties"))).alias("rows"))
    inner = F.struct(F.lit("T").alias("name"), F.lit("text").alias("value_kind"), F.col("text").alias("value"), F.lit("none").alias("history"))
    own = F.struct(path.alias("object_path"), F.lit("UObject").alias("kind"), F.array(F.struct(F.lit("S").alias("name"), F.lit("struct").alias("value_kind"), F.array(inner).alias("properties"))).alias("properties"))
    asset = F.when(F.col("doc_id") % 3 == 0, F.to_json(entry)).when(F.col("doc_id") % 3 == 1, F.to_json(cell)).otherwise(F.to_json(own))
    docs = table(s, d, "documents").where("text is not null").select(F.concat(F.lit("file-"), key).alias("package_file"), F.concat(F.lit('{"assets": ['), asset, F.lit("]}")).alias("json"))
    return co.text_corpus(docs).withColumn("n_bytes", F.octet_length("text").cast("long")).drop("text")


_CORPUS = """SELECT 'occurrence:/Game/' || doc_id || CASE doc_id % 3 WHEN 0 THEN ':entry:' || doc_id WHEN 1 THEN ':row:r:property:Titles[0]' ELSE ':property:S.T' END || ':file-' || doc_id AS id, 'file-' || doc_id AS package_file, '/Game/' || doc_id AS object_path,
 CASE doc_id % 3 WHEN 0 THEN 'string_table_entry' WHEN 1 THEN 'data_table_cell' ELSE 'asset_property' END AS location, CASE WHEN doc_id % 3 = 1 THEN 'r' END AS row, CASE doc_id % 3 WHEN 0 THEN CAST(doc_id AS VARCHAR) WHEN 1 THEN 'Titles[0]' ELSE 'S.T' END AS path,
 CASE WHEN doc_id % 3 = 0 OR (doc_id % 3 = 1 AND lang <> '') THEN 'resolved' ELSE 'unresolved' END AS status, CASE WHEN doc_id % 3 = 0 OR (doc_id % 3 = 1 AND lang <> '') THEN source END AS namespace,
 CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) WHEN doc_id % 3 = 1 AND lang <> '' THEN lang END AS key, CASE WHEN doc_id % 3 = 2 THEN 'culture_invariant' WHEN doc_id % 3 = 1 AND coalesce(lang, '') = '' THEN 'missing_key' END AS reason,
 CASE WHEN doc_id % 3 = 2 THEN 'read_only' ELSE 'source_editable' END AS capability, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents WHERE text IS NOT NULL"""


def _plan(s: SparkSession, d: str) -> DataFrame:
    log, pointers = _commands(s, d)
    prints = table(s, d, "events").groupBy("user_id", "event_type").agg(F.min("props").alias("fingerprint"))
    return v.apply_plan(log, pointers, prints, "user_id", "event_type", "place", "props", 4, 40, 400)


_PLAN = f"""WITH {_COMMANDS}, t AS (SELECT user_id, event_type, count(*) AS commands, sum(strlen(props)) AS b FROM c WHERE place < pointer GROUP BY 1, 2),
w AS (SELECT user_id, count(*) AS t, sum(commands) AS n, sum(b) AS b FROM t GROUP BY 1)
SELECT t.user_id, t.event_type, t.commands, (SELECT min(props) FROM events e WHERE e.user_id = t.user_id AND e.event_type = t.event_type) AS expected_fingerprint, CASE WHEN w.t > 4 THEN 'too_many_tables' WHEN w.n > 40 THEN 'too_many_commands' WHEN w.b > 400 THEN 'payload_too_large' END AS problem FROM t JOIN w USING (user_id)"""


def _undo(s: SparkSession, d: str) -> DataFrame:
    log, pointers = _commands(s, d)
    return v.undo_redo(log, pointers, "user_id", "place", "event_type")


_UNDO = f"""WITH {_COMMANDS}, n AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY place) IS DISTINCT FROM event_type AS fresh FROM c), r AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY place) AS run FROM n),
g AS (SELECT user_id, any_value(pointer) AS pointer, min(place) AS a, max(place) AS b FROM r GROUP BY user_id, run)
SELECT user_id, pointer, CAST(coalesce(max(a) FILTER (a < pointer), any_value(pointer)) AS BIGINT) AS undone, CAST(coalesce(min(b + 1) FILTER (b >= pointer), any_value(pointer)) AS BIGINT) AS redone FROM g GROUP BY 1, 2"""


def _reconcile(s: SparkSession, d: str) -> DataFrame:
    pending = table(s, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", F.col("o_orderkey").alias("operation"))
    results = table(s, d, "lineitem").where("l_orderkey % 3 <> 0").select(F.col("l_orderkey").alias("operation"), F.col("l_linestatus").alias("result"))
    return v.reconcile(pending, results, "operation", "result").select("o_orderkey", "outcome")


def _retry(s: SparkSession, d: str) -> DataFrame:
    receipts = table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.when(F.col("o_orderstatus") == "F", "failed").otherwise("saved").alias("status"), (F.col("o_orderkey") % 2 == 0).alias("safe"))
    return v.save_retry(table(s, d, "customer").select("c_custkey"), receipts, "c_custkey", "o_orderkey", "status", "safe")


def _health(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return v.health(e, "user_id", (F.col("event_type") == "error") & (F.col("event_id") % 5 == 0), F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("slow_"), "event_type")))


def _selection(s: SparkSession, d: str) -> DataFrame:
    wanted = table(s, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return v.plan_selection(wanted, table(s, d, "part").where("p_partkey % 7 <> 0"), "p_partkey")


_KIND = "CASE WHEN event_id % 29 = 0 THEN 'catalog' WHEN event_id % 23 = 0 THEN 'polling' WHEN event_id % 19 = 0 THEN 'reset' WHEN event_id % 17 = 0 THEN 'unavailable' ELSE 'batch' END"

QUERIES = {
    "text_occurrences": (_occurrences, _OCCURRENCES),
    "text_corpus": (_corpus, _CORPUS),
    "text_units": (lambda s, d: v.text_units(table(s, d, "documents").withColumn("lang", F.when(F.col("doc_id") % 9 != 0, F.concat("lang", F.lit(": x")))), "source", "lang", "doc_id", "text").select("unit_id", "occurrences", F.array_join("entries", ",").alias("entries"), F.array_join("sources", ",").alias("sources"), "state"), "SELECT unit_id, count(*) AS occurrences, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS entries, coalesce(string_agg(DISTINCT sha256(text), ',' ORDER BY sha256(text)), '') AS sources, CASE WHEN count(DISTINCT text) <= 1 THEN 'consistent' ELSE 'conflicting' END AS state FROM (SELECT CASE WHEN source IS NOT NULL AND lang IS NOT NULL AND doc_id % 9 <> 0 THEN source || ':' || lang || '%3A%20x' ELSE 'entry:' || CAST(doc_id AS VARCHAR) END AS unit_id, text, doc_id FROM documents) GROUP BY 1"),
    "text_unit_states": (lambda s, d: v.unit_states(v.unit_entries(table(s, d, "documents").withColumn("lang", F.when(F.col("doc_id") % 9 != 0, F.concat("lang", F.lit(": x")))), "source", "lang", "doc_id", "text")), "SELECT unit_id, CAST(count(*) AS BIGINT) AS occurrences, count(DISTINCT text) AS texts, min(doc_id) AS first_entry, max(doc_id) AS last_entry, CASE WHEN count(DISTINCT text) <= 1 THEN 'consistent' ELSE 'conflicting' END AS state FROM (SELECT CASE WHEN source IS NOT NULL AND lang IS NOT NULL AND doc_id % 9 <> 0 THEN source || ':' || lang || '%3A%20x' ELSE 'entry:' || CAST(doc_id AS VARCHAR) END AS unit_id, text, doc_id FROM documents) GROUP BY 1"),
    "text_diagnostics": (_diagnostics, _DIAGNOSTICS),
    "unit_diagnostics": (lambda s, d: _diagnostics(s, d).join(table(s, d, "documents").where("lang = 'en'").select("doc_id"), "doc_id", "left_semi"), f"SELECT doc_id, code FROM ({_DIAGNOSTICS}) WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"),
    "input_report": (lambda s, d: v.input_report(table(s, d, "events"), "user_id", F.col("event_type") == "click", F.col("event_id") % 20 == 0), "SELECT user_id, count(*) AS entries, count(*) FILTER (event_type = 'click') AS relevant, count(*) FILTER (event_id % 20 = 0) AS diagnostics, CASE WHEN count(*) FILTER (event_id % 20 = 0) > 0 OR count(*) FILTER (event_type = 'click') = 0 THEN 'partial' ELSE 'complete' END AS status FROM events GROUP BY 1"),
    "source_kind": (lambda s, d: v.source_kind(table(s, d, "conversations"), "conv_id", "role"), "SELECT conv_id, CASE WHEN min(role) <> max(role) THEN 'MULTI-SOURCE' ELSE min(role) END AS kind FROM conversations GROUP BY 1"),
    "decode_gaps": (_gaps, "SELECT event_id AS entry, CASE event_type WHEN 'error' THEN '$.a' ELSE '$.a.b' END AS value_path FROM events WHERE event_type = 'click' OR (event_type = 'error' AND props IS NOT NULL)"),
    "mapping_projection": (_mappings, _MAPPINGS),
    "action_projection": (_actions, "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 AND c_name IS NOT NULL THEN 'available' ELSE 'unavailable' END AS description_status, CASE WHEN c_custkey % 5 <> 0 AND c_name IS NOT NULL THEN NULL ELSE 'not_serialized' END AS description_reason, c_mktsegment AS value_type FROM customer"),
    "snapshot_projection": (_classes, "SELECT o_custkey, 'row:' || o_orderkey AS row_id, CASE WHEN bool_or(o_orderstatus = 'P') OVER (PARTITION BY o_custkey) THEN 'partial' ELSE 'complete' END AS completeness FROM orders"),
    "cells_pivot": (lambda s, d: v.pivot_cells(_cells(s, d).where("not (field = 'p_brand' and p_partkey % 4 = 0)"), "p_partkey", ["p_name", "p_brand", "p_size"]), "SELECT p_partkey, p_name, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS p_brand, CAST(p_size AS VARCHAR) AS p_size FROM part"),
    "infer_columns": (lambda s, d: v.infer_columns(_cells(s, d)), "SELECT 'p_name' AS field, 'string' AS type_name, 0 AS field_index FROM part HAVING count(p_name) > 0 UNION ALL SELECT 'p_brand', 'string', 1 FROM part HAVING count(p_brand) > 0 UNION ALL SELECT 'p_size', 'int', 2 FROM part HAVING count(p_size) > 0"),
    "materialize_entities": (lambda s, d: table(s, d, "customer").select("c_custkey", "c_name").join(table(s, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("last_order"), F.max_by("o_orderstatus", "o_orderkey").alias("status")), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "last_order", "status"), "SELECT c_custkey, c_name, max(o_orderkey) AS last_order, arg_max(o_orderstatus, o_orderkey) AS status FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2"),
    "local_class_lookup": (_lookup, "SELECT l.l_orderkey, l.l_linenumber + 1 AS target, t.k AS target_class FROM lineitem l LEFT JOIN (SELECT l_orderkey AS o, l_linenumber AS n, min(l_returnflag) AS k FROM lineitem GROUP BY 1, 2) t ON t.o = l.l_orderkey AND t.n = l.l_linenumber + 1 WHERE l.l_linenumber % 3 <> 0"),
    "identity_remap": (lambda s, d: v.identity_remap(table(s, d, "supplier").unionByName(table(s, d, "supplier").withColumn("s_suppkey", -F.col("s_suppkey"))), table(s, d, "supplier").where("s_suppkey % 4 <> 0"), "s_suppkey", "s_nationkey"), "WITH now AS (SELECT * FROM supplier WHERE s_suppkey % 4 <> 0), f AS (SELECT s_nationkey, min(s_suppkey) AS low FROM now GROUP BY 1), s AS (SELECT s_suppkey, s_nationkey FROM supplier UNION ALL SELECT -s_suppkey, s_nationkey FROM supplier) SELECT s.s_suppkey, CASE WHEN s.s_suppkey > 0 AND s.s_suppkey % 4 <> 0 THEN s.s_suppkey ELSE low END AS current_id FROM s LEFT JOIN f USING (s_nationkey)"),
    "undo_redo": (_undo, _UNDO),
    "row_intents": (_intents, _INTENTS),
    "default_rows": (_defaults, _DEFAULTS),
    "invert_commands": (_invert, "SELECT l_orderkey, -CAST(l_linenumber AS BIGINT) AS seq, CASE l_linenumber % 3 WHEN 0 THEN 'remove' WHEN 1 THEN 'add' ELSE 'set_cell' END AS kind, l_linestatus AS old_value, l_returnflag AS new_value FROM lineitem"),
    "table_validation": (_validation, _VALIDATION),
    "validation_summary": (lambda s, d: v.validation_summary(_validation(s, d), "severity"), f"SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') = 0 AS valid FROM ({_VALIDATION})"),
    "session_summary": (lambda s, d: v.session_summary(table(s, d, "events"), "user_id", "event_type", table(s, d, "events").where("event_type = 'purchase' and value > 100").select("user_id")), "SELECT user_id, count(*) AS commands, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tables, coalesce(bool_or(event_type = 'purchase' AND value > 100), false) AS needs_save FROM events GROUP BY 1"),
    "apply_plan": (_plan, _PLAN),
    "apply_accept": (_accept, _ACCEPT),
    "apply_transaction": (_transaction, _TRANSACTION),
    "reconcile_pending": (_reconcile, "SELECT o_orderkey, coalesce((SELECT max(l_linestatus) FROM lineitem WHERE l_orderkey = o_orderkey AND l_orderkey % 3 <> 0), 'operation_unknown') AS outcome FROM orders WHERE o_orderstatus = 'P'"),
    "save_retry_set": (_retry, "SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS st, max(o_orderkey) AS k FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE k IS NULL OR st <> 'F' OR k % 2 = 0"),
    "health_rollup": (_health, "SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND event_id % 5 = 0) THEN 'unhealthy' WHEN bool_or(event_id % 7 = 0) THEN 'degraded' ELSE 'healthy' END AS health, coalesce(string_agg(DISTINCT 'slow_' || event_type, ',' ORDER BY 'slow_' || event_type) FILTER (event_id % 7 = 0), '') AS reasons FROM events GROUP BY 1"),
    "plan_selection": (_selection, "SELECT l_partkey AS p_partkey, CASE WHEN l_partkey % 7 = 0 OR l_partkey NOT IN (SELECT p_partkey FROM part) THEN 'missing' WHEN count(*) > 1 THEN 'duplicate' END AS problem FROM lineitem GROUP BY 1"),
    "observation_events": (lambda s, d: v.observation_events(table(s, d, "events").select("user_id", "event_id", F.expr(_KIND).alias("kind")), "user_id", "event_id", "kind"), f"SELECT user_id, event_id, CASE kind WHEN 'catalog' THEN 'connecting' WHEN 'batch' THEN 'live' WHEN 'reset' THEN 'stale' WHEN 'polling' THEN 'polling_fallback' ELSE 'unavailable' END AS health, coalesce(last_value(CASE WHEN kind IN ('catalog', 'polling', 'batch') THEN kind END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) = 'batch', false) AS has_sample FROM (SELECT user_id, event_id, {_KIND} AS kind FROM events)"),
    "reorder_intents": (_reorders, "SELECT o_custkey AS intent_id, CASE WHEN bool_or(o_orderkey % 40 = 0 OR o_custkey % 7 = 0) THEN 'invalid_row_order' ELSE 'accepted' END AS status FROM orders GROUP BY 1"),
}
