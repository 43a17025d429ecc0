"""Queries on references, catalogs, edits, windows, sets, space and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .. import streaming as st
from ..operators import changes as c, folds as fo, references as r, scans as sc, spatial as sp
from ..sources.staging import staged
from .common import table


# -- references: orders to customers, of which every seventh is missing and every eleventh comes twice


def _customers(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "customer").where("c_custkey % 7 <> 0").select(F.lit("customer").alias("table_path"), F.col("c_custkey").cast("string").alias("row_name"))
    return rows.unionByName(rows.where("cast(row_name as long) % 11 = 0"))


def edges(s: SparkSession, d: str) -> DataFrame:
    path = F.when(F.col("o_orderkey") % 13 == 0, None).when(F.col("o_orderkey") % 17 == 0, "absent").otherwise("customer")
    refs = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("source_row"), path.alias("target_table"), F.col("o_custkey").cast("string").alias("target_row"))
    tables = _customers(s, d).select("table_path").distinct()
    return r.resolve(refs, tables, _customers(s, d))


_EDGES = """SELECT source_row, target_table, target_row,
 CASE WHEN target_table IS NULL THEN 'unassigned' WHEN target_table = 'absent' THEN 'missing_table' WHEN n IS NULL THEN 'missing_row' WHEN n > 1 THEN 'ambiguous_row' ELSE 'resolved' END AS status,
 CAST(CASE WHEN target_table = 'customer' AND n IS NOT NULL THEN n ELSE 0 END AS BIGINT) AS candidates
 FROM (SELECT CAST(o_orderkey AS VARCHAR) AS source_row, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 'absent' ELSE 'customer' END AS target_table, CAST(o_custkey AS VARCHAR) AS target_row FROM orders) e
 LEFT JOIN (SELECT CAST(c_custkey AS VARCHAR) AS name, CASE WHEN c_custkey % 11 = 0 THEN 2 ELSE 1 END AS n FROM customer WHERE c_custkey % 7 <> 0) t ON t.name = e.target_row"""


def view(s: SparkSession, d: str, snapshots: int = 1) -> DataFrame:
    """Orders with their customers' names, from ``snapshots`` snapshots of orders."""
    source = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("source_row"))
    targets = table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("target_row"), "c_name")
    one = table(s, d, "orders").select(F.lit("orders").alias("table_path")).distinct()
    held = one.where("false") if not snapshots else one if snapshots == 1 else one.union(one)
    refs = edges(s, d).where("cast(source_row as long) % 5 <> 0")
    return r.joined_view(source, refs, targets, "orders", held).select("source_row", "c_name", "reason")


_VIEW = f"""SELECT o.source_row, CASE WHEN e.status = 'resolved' THEN c_name END AS c_name, CASE WHEN e.status IS NULL THEN 'not_reference' WHEN e.status <> 'resolved' THEN e.status END AS reason
FROM (SELECT CAST(o_orderkey AS VARCHAR) AS source_row, o_custkey FROM orders) o LEFT JOIN (SELECT * FROM ({_EDGES}) WHERE CAST(source_row AS BIGINT) % 5 <> 0) e USING (source_row) LEFT JOIN customer ON c_custkey = o_custkey"""


def _views(s: SparkSession, d: str) -> DataFrame:
    told = [view(s, d, n).select(F.lit(n).alias("snapshots"), "*") for n in (0, 1, 2)]
    return told[0].union(told[1]).union(told[2])


_VIEWS = f"""SELECT CAST(1 AS INTEGER) AS snapshots, * FROM ({_VIEW}) UNION ALL SELECT CAST(0 AS INTEGER), CAST(o_orderkey AS VARCHAR), NULL, 'source_table_missing' FROM orders
UNION ALL SELECT CAST(2 AS INTEGER), CAST(o_orderkey AS VARCHAR), NULL, 'source_table_ambiguous' FROM orders"""


def _nested(s: SparkSession, d: str) -> DataFrame:
    lines = F.sort_array(F.collect_list(F.struct(F.struct(F.lit("part").alias("table"), F.col("l_partkey").cast("string").alias("row")).alias("ref"))))
    docs = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(lines.alias("lines"))).alias("document"))
    return r.nested_references(docs.select(F.col("l_orderkey").cast("string").alias("source_row"), "document"))


def _reference_fields(s: SparkSession, d: str) -> DataFrame:
    schema = table(s, d, "lineitem").select(F.explode(F.array(F.struct(F.lit("l_partkey").alias("field"), F.lit("row_reference").alias("value_kind")), F.struct(F.lit("l_tax").alias("field"), F.lit("double").alias("value_kind"))))).select("col.*").distinct()
    cells = table(s, d, "lineitem").select(F.lit("l_suppkey").alias("field"), F.when(F.col("l_quantity") > 10, "supplier").alias("target_table"))
    return r.reference_fields(schema, cells)


# -- catalogs and changed copies


def _indexed(rows: DataFrame) -> DataFrame:
    """Orders as tables of their customers, in order of their keys."""
    return rows.withColumn("row_index", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1)


def _mutated(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    base = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey")
    kept = base.where("o_orderkey % 19 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus"))).withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 31 == 0, "renamed").otherwise(F.col("o_orderpriority")))
    added = base.where("o_orderkey % 23 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000)
    return _indexed(base), _indexed(kept.unionByName(added))


_BOTH = """b AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
w AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM (
  SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 31 = 0 THEN 'renamed' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 19 <> 0
  UNION ALL SELECT o_custkey, o_orderkey + 1000000000, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 23 = 0))"""
_DIFF = f"""WITH {_BOTH}
SELECT o_custkey, 'row_removed' AS kind, o_orderkey AS row_id, NULL AS field, o_orderpriority AS before, NULL AS after FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM w)
UNION ALL SELECT o_custkey, 'row_added', o_orderkey, NULL, NULL, o_orderpriority FROM w WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)
UNION ALL SELECT b.o_custkey, 'row_renamed', o_orderkey, NULL, b.o_orderpriority, w.o_orderpriority FROM b JOIN w USING (o_orderkey) WHERE b.o_orderpriority IS DISTINCT FROM w.o_orderpriority
UNION ALL SELECT b.o_custkey, 'cell_changed', o_orderkey, 'o_orderstatus', b.o_orderstatus, w.o_orderstatus FROM b JOIN w USING (o_orderkey) WHERE b.o_orderstatus IS DISTINCT FROM w.o_orderstatus
UNION ALL SELECT coalesce(x.o_custkey, y.o_custkey), 'rows_reordered', NULL, NULL, NULL, NULL FROM (SELECT o_custkey, list(o_orderkey ORDER BY i) AS l FROM b GROUP BY 1) x FULL JOIN (SELECT o_custkey, list(o_orderkey ORDER BY i) AS l FROM w GROUP BY 1) y ON x.o_custkey = y.o_custkey WHERE x.l IS DISTINCT FROM y.l"""
_DIRTY = f"""SELECT o_custkey, row_id FROM ({_DIFF}) WHERE kind <> 'rows_reordered' UNION SELECT o_custkey, o_orderkey FROM (WITH {_BOTH} SELECT * FROM w) WHERE o_custkey IN (SELECT o_custkey FROM ({_DIFF}) WHERE kind = 'rows_reordered')"""


def diff(s: SparkSession, d: str) -> DataFrame:
    base, work = _mutated(s, d)
    return c.table_diff(base, work, "o_custkey", "o_orderkey", "row_index", "o_orderpriority", ["o_orderstatus"])


def _review(s: SparkSession, d: str) -> DataFrame:
    base, work = _mutated(s, d)
    said = work.where("o_orderstatus in ('X', 'P')").select("o_custkey", F.when(F.col("o_orderstatus") == "P", "error").otherwise("warning").alias("severity"))
    return c.session_review(base, work, said, "o_custkey", "o_orderkey", "row_index", "o_orderpriority", ["o_orderstatus"])


_REVIEW = f"""WITH {_BOTH}, t AS (SELECT o_custkey FROM b UNION SELECT o_custkey FROM w), d AS ({_DIFF}), x AS (SELECT o_custkey, count(*) AS n FROM ({_DIRTY}) GROUP BY 1)
SELECT o_custkey, changes, dirty_cells, coalesce(x.n, 0) AS dirty_rows, errors, warnings, errors = 0 AS valid FROM (
  SELECT t.o_custkey, count(d.kind) AS changes, count(*) FILTER (d.kind = 'cell_changed') AS dirty_cells FROM t LEFT JOIN d ON d.o_custkey = t.o_custkey GROUP BY 1) c
JOIN (SELECT t.o_custkey, count(*) FILTER (w.o_orderstatus = 'P') AS errors, count(*) FILTER (w.o_orderstatus = 'X') AS warnings FROM t LEFT JOIN w ON w.o_custkey = t.o_custkey GROUP BY 1) e USING (o_custkey) LEFT JOIN x USING (o_custkey)"""


def _parity(s: SparkSession, d: str) -> DataFrame:
    side = lambda rows, live: rows.select("p_partkey", "p_type", F.when(F.col("p_size") > 10, F.sha2(F.when((F.col("p_size") == 40) & F.lit(live), "other").otherwise(F.col("p_name")), 256)).alias("print"), F.when(F.col("p_size") % 9 == 0, "unavailable").otherwise("available").alias("schema"))
    saved, live = table(s, d, "part").where("p_partkey % 9 <> 0"), table(s, d, "part").where("p_partkey % 8 <> 0")
    changed = live.withColumn("p_type", F.when(F.col("p_size") == 7, "live").otherwise(F.col("p_type")))
    return r.parity_report(side(saved, False), side(changed, True), "p_partkey", ["p_type"], "print", "schema")


_PARITY = """SELECT *, CASE WHEN missing_saved + missing_live + diverged + fingerprint_mismatches > 0 THEN 'failed' ELSE 'passed' END AS status FROM (
SELECT count(*) FILTER (p_partkey % 9 = 0 AND p_partkey % 8 <> 0) AS missing_saved, count(*) FILTER (p_partkey % 8 = 0 AND p_partkey % 9 <> 0) AS missing_live,
 count(*) FILTER (p_partkey % 9 <> 0 AND p_partkey % 8 <> 0 AND p_size = 7) AS diverged, count(*) FILTER (p_partkey % 9 <> 0 AND p_partkey % 8 <> 0 AND p_size = 40 AND p_name <> 'other') AS fingerprint_mismatches,
 count(*) FILTER ((p_partkey % 9 <> 0 OR p_partkey % 8 <> 0) AND p_size % 9 = 0) AS schema_gaps FROM part)"""


def catalogs(s: SparkSession, d: str) -> DataFrame:
    saved = table(s, d, "part").where("p_partkey % 9 <> 0").select("p_partkey", "p_brand", "p_type")
    live = table(s, d, "part").where("p_partkey % 8 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, "live").otherwise(F.col("p_brand")).alias("p_brand"), "p_type")
    return r.merge_catalogs(saved, live, "p_partkey", ["p_brand", "p_type"])


_CATALOGS = """SELECT p_partkey, CASE WHEN p_partkey % 8 <> 0 AND p_partkey % 5 = 0 THEN 'live' ELSE p_brand END AS p_brand, p_type,
 CASE WHEN p_partkey % 8 = 0 THEN 'saved' WHEN p_partkey % 9 = 0 THEN 'live' ELSE 'live,saved' END AS authorities,
 CASE WHEN p_partkey % 8 <> 0 AND p_partkey % 9 <> 0 AND p_partkey % 5 = 0 AND p_brand <> 'live' THEN 'p_brand' ELSE '' END AS divergence
 FROM part WHERE NOT (p_partkey % 8 = 0 AND p_partkey % 9 = 0)"""


def _fold(s: SparkSession, d: str) -> DataFrame:
    path = F.concat_ws("/", "p_brand", "p_type")
    base = table(s, d, "part").select(path.alias("table_path"), F.col("p_partkey").alias("row_id"), F.col("p_size").cast("long").alias("value"))
    log = table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("row_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")).agg(F.max("l_quantity").cast("long").alias("new_value"))
    log = log.join(base, "row_id").withColumn("old_value", F.coalesce(F.lag("new_value").over(Window.partitionBy("row_id").orderBy("seq")), F.col("value")))
    log = log.withColumn("old_value", F.when(F.col("row_id") % 97 == 0, -1).otherwise(F.col("old_value"))).drop("value")
    return c.fold_set_cell(base, log)


_FOLD = """WITH l AS (SELECT l_partkey AS row_id, arg_max(CAST(l_quantity AS BIGINT), (l_orderkey * 10 + l_linenumber, CAST(l_quantity AS BIGINT))) AS v FROM lineitem GROUP BY 1),
p AS (SELECT p_brand || '/' || p_type AS table_path, p_partkey AS row_id, CAST(p_size AS BIGINT) AS size, v FROM part LEFT JOIN l ON row_id = p_partkey),
t AS (SELECT table_path, NOT bool_or(v IS NOT NULL AND row_id % 97 = 0) AS valid FROM p GROUP BY 1)
SELECT table_path, row_id, CASE WHEN valid AND v IS NOT NULL THEN v ELSE size END AS value, valid FROM p JOIN t USING (table_path)"""


def _fold_rows(s: SparkSession, d: str) -> DataFrame:
    """Orders as tables of their customers: the first row is renamed, one is put before it, it is removed; every third table is turned round."""
    key = F.col("o_orderkey").cast("string")
    rows = staged(_indexed(table(s, d, "orders").select("o_custkey", "o_orderkey")), "orders").select(F.col("o_custkey").cast("string").alias("table_path"), F.col("row_index").cast("long").alias("row_index"), key.alias("row_id"), F.concat(F.lit("Order "), key).alias("row_name"))
    first = rows.where("row_index = 0")
    none = F.lit(None).cast("string")
    order = F.lit(None).cast("array<string>")
    command = lambda df, seq, kind, row, name, old, at, before=order, after=order: df.select("table_path", F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), row.alias("row_id"), name.alias("row_name"), old.alias("old_name"), F.lit(at).cast("long").alias("at_index"), before.alias("old_order"), after.alias("new_order"))
    new = F.concat(F.lit("n"), "table_path")
    wrong = F.when(F.col("table_path").cast("long") % 10 == 0, "another").otherwise(F.col("row_name"))
    log = command(first, 1, "rename", F.col("row_id"), F.lit("Renamed"), wrong, 0).unionByName(command(first, 2, "add", new, F.lit("Added"), none, 0)).unionByName(command(first, 3, "remove", F.col("row_id"), none, none, 1))
    ids = rows.where("cast(table_path as long) % 3 = 0").groupBy("table_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "row_id"))), lambda x: x["row_id"]).alias("ids"))
    now = F.concat(F.array(new), F.slice("ids", F.lit(2), F.size("ids")))
    log = log.unionByName(command(ids, 4, "reorder", none, none, none, 0, now, F.reverse(now)))
    return fo.fold_rows(rows, log)


_FOLD_ROWS = """WITH r AS (SELECT CAST(o_custkey AS VARCHAR) AS table_path, o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT table_path, CASE WHEN o_custkey % 10 <> 0 AND o_custkey % 3 = 0 THEN n - 1 - i ELSE i END AS row_index,
 CASE WHEN i = 0 AND o_custkey % 10 <> 0 THEN 'n' || table_path ELSE CAST(o_orderkey AS VARCHAR) END AS row_id,
 CASE WHEN i = 0 AND o_custkey % 10 <> 0 THEN 'Added' ELSE 'Order ' || o_orderkey END AS row_name, CASE WHEN o_custkey % 10 = 0 THEN 'rename_rejected:1' END AS error FROM r"""


def _fold_table(s: SparkSession, d: str) -> DataFrame:
    """Lines as tables of their parts, with one log for rows and cells: a row is renamed, then its quantity is changed under its id, then another
    row is put before it with cells of its own, of which one is changed; the last row goes. Every seventh table expects a quantity that
    isn't there, every eleventh gives a name that two rows have and only one has given up."""
    line = F.concat_ws("-", "l_orderkey", "l_linenumber", "again")
    rows = table(s, d, "lineitem").withColumn("again", F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")))
    rows = rows.select(F.col("l_partkey").alias("p"), "l_orderkey", "l_linenumber", "again", "l_returnflag", F.col("l_quantity").cast("int").alias("quantity"), "l_linestatus")
    placed = Window.partitionBy("p").orderBy("l_orderkey", "l_linenumber", "again")
    rows = staged(rows.withColumn("row_index", F.row_number().over(placed) - 1).withColumn("n", F.count("*").over(Window.partitionBy("p"))), "lines")
    rows = rows.select("p", "row_index", "n", F.col("p").cast("string").alias("table_path"), line.alias("row_id"), F.concat(F.lit("of "), F.col("l_returnflag")).alias("row_name"), F.create_map(F.lit("quantity"), F.col("quantity").cast("string"), F.lit("status"), F.col("l_linestatus")).alias("fields"))
    first, last = rows.where("row_index = 0"), rows.where("row_index = n - 1")
    none, new = F.lit(None).cast("string"), F.concat(F.lit("new/"), "table_path")
    command = lambda df, seq, kind, row, name=none, old=none, at=None, field=none, before=none, after=none, fields=None: df.select("table_path", F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), row.alias("row_id"), name.alias("row_name"), old.alias("old_name"), (F.lit(None) if at is None else at).cast("long").alias("at_index"), field.alias("field"), before.alias("old_value"), after.alias("new_value"), (F.lit(None) if fields is None else fields).cast("map<string,string>").alias("fields"))
    held = F.when(F.col("p") % 7 == 0, "none").otherwise(F.col("fields")["quantity"])
    name = F.when(F.col("p") % 11 == 0, F.col("row_name")).otherwise(F.lit("added"))
    log = command(first, 1, "rename", F.col("row_id"), F.lit("first"), F.col("row_name"))
    log = log.unionByName(command(first, 2, "set_cell", F.col("row_id"), field=F.lit("quantity"), before=held, after=F.lit("-1")))
    log = log.unionByName(command(first, 3, "add", new, name, at=F.lit(0), fields=F.create_map(F.lit("quantity"), F.lit("0"))))
    log = log.unionByName(command(first, 4, "set_cell", new, field=F.lit("quantity"), before=F.lit("0"), after=F.lit("5")))
    log = log.unionByName(command(last.where("n > 1"), 5, "remove", F.col("row_id"), at=F.col("n")))
    done = fo.fold_table(rows.select("table_path", "row_index", "row_id", "row_name", "fields"), log)
    return done.select("table_path", "row_index", "row_id", "row_name", F.col("fields")["quantity"].alias("quantity"), F.try_element_at("fields", F.lit("status")).alias("status"), "error")


_FOLD_TABLE = """WITH k AS (SELECT l_partkey AS p, l_orderkey, l_linenumber, l_quantity, l_linestatus, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS again FROM lineitem),
r AS (SELECT p, CAST(p AS VARCHAR) AS t, l_orderkey || '-' || l_linenumber || '-' || again AS row_id, 'of ' || l_returnflag AS row_name, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS quantity, l_linestatus AS status,
  row_number() OVER (PARTITION BY p ORDER BY l_orderkey, l_linenumber, again) - 1 AS i, count(*) OVER (PARTITION BY p) AS n FROM k),
e AS (SELECT p, CASE WHEN p % 7 = 0 THEN 'set_cell_rejected:2' WHEN p % 11 = 0 AND count(*) FILTER (row_name = f) > 1 THEN 'add_rejected:3' END AS error
  FROM (SELECT *, first_value(row_name) OVER (PARTITION BY p ORDER BY i) AS f FROM r) GROUP BY p)
SELECT t AS table_path, CAST(i AS BIGINT) AS row_index, row_id, row_name, quantity, status, error FROM r JOIN e USING (p) WHERE error IS NOT NULL
UNION ALL SELECT t, CAST(i + 1 AS BIGINT), row_id, CASE WHEN i = 0 THEN 'first' ELSE row_name END, CASE WHEN i = 0 THEN '-1' ELSE quantity END, status, NULL FROM r JOIN e USING (p) WHERE error IS NULL AND (n = 1 OR i < n - 1)
UNION ALL SELECT t, CAST(0 AS BIGINT), 'new/' || t, CASE WHEN p % 11 = 0 THEN row_name ELSE 'added' END, '5', NULL, NULL FROM r JOIN e USING (p) WHERE error IS NULL AND i = 0"""


def _fingerprints(s: SparkSession, d: str) -> DataFrame:
    part = table(s, d, "part").withColumn("tags", F.array("p_type", "p_name"))
    header = part.groupBy(F.col("p_brand").alias("table_path")).agg(F.lit("DataTable").alias("kind"), F.countDistinct("p_type").alias("types"))
    return c.table_fingerprint(part.withColumnRenamed("p_brand", "table_path"), "table_path", "p_partkey", ["p_name", "p_size", "tags"], ["tags"], header)


_FINGERPRINTS = """WITH h AS (SELECT p_brand AS table_path, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, sha256(coalesce('=' || p_name, 'null') || '|' || coalesce('=' || CAST(p_size AS VARCHAR), 'null') || '|=[' || array_to_string(list_sort(['=' || p_type, '=' || p_name]), ',') || ']') AS h FROM part),
g AS (SELECT table_path, i // 10000 AS g, sha256(string_agg(h, '' ORDER BY i)) AS h FROM h GROUP BY 1, 2),
f AS (SELECT table_path, CASE WHEN count(*) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY g)) END AS fingerprint FROM g GROUP BY 1)
SELECT table_path, sha256('=DataTable|=' || count(DISTINCT p_type) || '|' || any_value(fingerprint)) AS fingerprint FROM h JOIN f USING (table_path) GROUP BY 1"""


def _edits(s: SparkSession, d: str) -> DataFrame:
    """Order lines as cell edits of parts: sizes, read-only names and colours that parts don't have."""
    field = F.when(F.col("l_linenumber") == 2, "p_name").when(F.col("l_linenumber") == 3, "p_color").otherwise("p_size")
    value = F.when(F.col("l_quantity") > 45, F.col("l_quantity").cast("string")).otherwise(F.col("l_quantity").cast("int").cast("string"))
    edits = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("row_id"), field.alias("field"), value.alias("value"))
    rows = table(s, d, "part").where("p_size <> 1").select(F.col("p_partkey").alias("row_id"))
    none = F.lit(None).cast("array<string>")
    schema = table(s, d, "part").select(F.explode(F.array(F.struct(F.lit("p_size").alias("field"), F.lit("uint").alias("kind"), none.alias("options"), F.lit(False).alias("read_only")), F.struct(F.lit("p_name").alias("field"), F.lit("string").alias("kind"), none.alias("options"), F.lit(True).alias("read_only"))))).select("col.*").distinct()
    return c.bulk_edit_validation(edits, rows, schema, "l_orderkey").select("l_orderkey", "l_linenumber", "row_id", "code", "accepted")


_EDITS = """SELECT l_orderkey, l_linenumber, row_id, code, bool_and(code IS NULL) OVER (PARTITION BY l_orderkey) AS accepted FROM (
SELECT l_orderkey, l_linenumber, l_partkey AS row_id, CASE WHEN l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <> 1) THEN 'row_not_found' WHEN l_linenumber = 3 THEN 'missing_field' WHEN l_linenumber = 2 THEN 'unsupported_edit' WHEN l_quantity > 45 THEN 'incompatible_value' END AS code FROM lineitem)"""


def _operations(s: SparkSession, d: str) -> DataFrame:
    ops = table(s, d, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").alias("operation_id"), F.col("event_type").alias("digest"))
    return c.idempotent(ops, "operation_id", "event_id", "digest", "user_id", 20).select("event_id", "outcome", "retained")


_OPERATIONS = """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type AS digest, json_extract_string(props, '$.k') AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, '' AS outcome, CAST([] AS STRUCT(id VARCHAR, digest VARCHAR)[]) AS kept FROM (SELECT DISTINCT user_id FROM e)
 UNION ALL
 SELECT user_id, n, event_id, outcome, CASE WHEN outcome = 'first' THEN (kept || [{'id': id, 'digest': digest}])[-20:] ELSE kept END
 FROM (SELECT f.user_id, e.n, e.event_id, e.id, e.digest, kept, CASE WHEN coalesce(e.id, '') = '' THEN 'invalid_request' WHEN NOT list_contains([x.id FOR x IN kept], e.id) THEN 'first'
   WHEN list_contains(kept, {'id': e.id, 'digest': e.digest}) THEN 'replayed' ELSE 'operation_id_collision' END AS outcome FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1))
SELECT event_id, outcome, outcome = 'first' AND count(*) FILTER (outcome = 'first') OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 20 AS retained FROM f WHERE n > 0"""


def _commands(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events as the command logs of their users, and pointers behind half of each."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    log = table(s, d, "events").select("user_id", place.alias("place"), F.col("event_id").alias("command"), "event_type", "props")
    return log, log.groupBy("user_id").agg(F.floor(F.count("*") / 2).alias("pointer"))


_COMMANDS = "c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, event_id AS command, event_type, props, count(*) OVER (PARTITION BY user_id) // 2 AS pointer FROM events)"


def _append(s: SparkSession, d: str) -> DataFrame:
    log, pointers = _commands(s, d)
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    added = table(s, d, "events").where("event_type = 'purchase' and user_id % 4 <> 0").select("user_id", order.alias("place"), (F.col("event_id") + 10**9).alias("command"))
    return c.append_group(log, pointers, added, "user_id")


_APPEND = f"""WITH {_COMMANDS}, a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, event_id + 1000000000 AS command FROM events WHERE event_type = 'purchase' AND user_id % 4 <> 0)
SELECT user_id, place, command FROM c WHERE place < pointer OR user_id NOT IN (SELECT user_id FROM a) UNION ALL SELECT a.user_id, a.place + pointer, a.command FROM a JOIN (SELECT DISTINCT user_id, pointer FROM c) p USING (user_id)"""


def _states(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*[F.count_if(F.col("l_returnflag") == f).alias(n) for f, n in (("A", "pointer"), ("N", "awaiting"), ("R", "receipts"))])
    kind = F.when(F.col("o_orderstatus") == "P", F.when(F.col("o_orderpriority") < "3", "apply").otherwise("save"))
    sessions = table(s, d, "orders").join(lines, "o_orderkey", "left").na.fill(0).select("o_orderkey", kind.alias("pending_kind"), F.when(F.col("o_totalprice") > 200_000, "indeterminate").otherwise("sent").alias("pending_status"), "pointer", "awaiting", "receipts")
    return c.pipeline_state(sessions).select("o_orderkey", "state", "can_apply")


_STATES = """SELECT o_orderkey, state, state = 'draft' AND a > 0 AS can_apply FROM (
SELECT o_orderkey, a, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 200000 THEN 'indeterminate' WHEN o_orderstatus = 'P' AND o_orderpriority < '3' THEN 'applying' WHEN o_orderstatus = 'P' THEN 'saving' WHEN a > 0 THEN 'draft' WHEN n > 0 THEN 'applied' WHEN r > 0 THEN 'saved' ELSE 'draft' END AS state
FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL))"""


def _observed(s: SparkSession, d: str) -> DataFrame:
    """Events as what is seen of their users' feeds: catalogs, resets, losses, polling, and batches of two indices."""
    kind = F.when(F.col("event_type") == "signup", "catalog").when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), "reset").when((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0), "unavailable").when((F.col("event_type") == "purchase") & (F.col("event_id") % 5 == 0), "polling").otherwise("transforms")
    k = F.get_json_object("props", "$.k").cast("int")
    return table(s, d, "events").select(F.col("user_id").alias("feed"), F.col("event_id").alias("arrival"), kind.alias("kind"), F.when(F.col("event_id") % 11 == 0, "other").otherwise("one").alias("session"), F.floor(F.col("event_id") / 2000).alias("revision"), (k % 7).cast("long").alias("seq"), F.lit(10).alias("entries"), F.array((k % 12).cast("int"), (F.col("event_id") % 5).cast("int")).alias("indices"))


_OBSERVED = """WITH RECURSIVE e AS (SELECT user_id AS feed, event_id AS arrival, CASE WHEN event_type = 'signup' THEN 'catalog' WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'reset' WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'unavailable' WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN 'polling' ELSE 'transforms' END AS kind,
 CASE WHEN event_id % 11 = 0 THEN 'other' ELSE 'one' END AS session, event_id // 2000 AS revision, CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 AS seq, CAST(json_extract_string(props, '$.k') AS INTEGER) % 12 AS i, event_id % 5 AS j, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (SELECT feed, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS arrival, 'accepted' AS outcome, 'connecting' AS status, '' AS session, CAST(-1 AS BIGINT) AS revision, 0 AS last, false AS has, false AS gap FROM (SELECT DISTINCT feed FROM e)
 UNION ALL
 SELECT feed, n, arrival, outcome, CASE WHEN kind = 'catalog' THEN 'live' WHEN kind = 'reset' THEN CASE WHEN has THEN 'stale' ELSE 'unavailable' END WHEN kind = 'unavailable' THEN 'unavailable' WHEN kind = 'polling' THEN 'polling_fallback' WHEN outcome = 'accepted' THEN 'live' ELSE status END,
  CASE WHEN kind = 'catalog' THEN own ELSE session END, CASE WHEN kind = 'catalog' THEN rev ELSE revision END, CASE WHEN kind = 'catalog' THEN 0 WHEN kind = 'transforms' AND outcome = 'accepted' THEN seq ELSE last END, CASE WHEN kind = 'catalog' THEN true WHEN kind = 'polling' THEN false ELSE has END,
  kind = 'transforms' AND outcome = 'accepted' AND status = 'live' AND seq > last + 1
 FROM (SELECT f.feed, e.n, e.arrival, e.kind, e.session AS own, e.revision AS rev, e.seq, f.status, f.session, f.revision, f.last, f.has,
   CASE WHEN e.kind <> 'transforms' THEN 'accepted' WHEN f.status NOT IN ('live', 'stale') THEN 'no_catalog' WHEN e.session <> f.session THEN 'wrong_session' WHEN e.revision <> f.revision THEN 'wrong_revision' WHEN e.seq < f.last THEN 'regressing_sequence' WHEN e.seq = f.last AND f.status = 'live' THEN 'duplicate_sequence' WHEN e.i >= 10 THEN 'out_of_range_index' WHEN e.i = e.j THEN 'duplicate_index' ELSE 'accepted' END AS outcome
   FROM f JOIN e ON e.feed = f.feed AND e.n = f.n + 1))
SELECT feed, arrival, outcome, status, gap FROM f WHERE n > 0"""

def _world(s: SparkSession, d: str) -> DataFrame:
    """The same feeds with what their batches say: transforms by the event's value, replacements by its id."""
    x = table(s, d, "events").select(F.col("user_id").alias("feed"), F.col("event_id").alias("arrival"), (F.col("event_id") % 50).alias("replacements"), F.array(*[F.struct((F.col("value") + i).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")) for i in (0, 1)]).alias("transforms"))
    world = st.observed_world(_observed(s, d).join(x, ["feed", "arrival"]))
    return world.select("feed", "status", "rejected", "gaps", "replacements", F.explode_outer("transforms").alias("t")).select("feed", "status", "rejected", "gaps", "replacements", "t.index", "t.x")


_WORLD = f"""WITH o AS ({_OBSERVED}), e AS (SELECT o.*, event_type, event_id, value, CASE WHEN event_type = 'signup' THEN 'catalog' WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'reset' WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'unavailable' WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN 'polling' ELSE 'transforms' END AS kind,
 CAST(json_extract_string(props, '$.k') AS INTEGER) % 12 AS i, CAST(event_id % 5 AS INTEGER) AS j FROM o JOIN events ON user_id = feed AND event_id = arrival),
f AS (SELECT feed, arg_max(status, arrival) AS status, max(arrival) FILTER (kind IN ('catalog', 'polling')) AS since, arg_max(kind, arrival) FILTER (kind IN ('catalog', 'polling')) = 'catalog' AS has FROM e GROUP BY feed),
s AS (SELECT e.* FROM e JOIN f ON e.feed = f.feed AND has AND arrival > since AND kind = 'transforms' AND outcome <> 'no_catalog'),
n AS (SELECT feed, count(*) FILTER (outcome <> 'accepted') AS rejected, count(*) FILTER (gap) AS gaps, coalesce(max(event_id % 50) FILTER (outcome = 'accepted'), 0) AS replacements FROM s GROUP BY feed),
t AS (SELECT feed, index, arg_max(x, arrival) AS x FROM (SELECT feed, arrival, i AS index, value AS x FROM s WHERE outcome = 'accepted' UNION ALL SELECT feed, arrival, j, value + 1 FROM s WHERE outcome = 'accepted') GROUP BY feed, index)
SELECT f.feed, f.status, CASE WHEN has THEN coalesce(rejected, 0) END AS rejected, CASE WHEN has THEN coalesce(gaps, 0) END AS gaps, CASE WHEN has THEN coalesce(replacements, 0) END AS replacements, index, x FROM f LEFT JOIN n ON n.feed = f.feed LEFT JOIN t ON t.feed = f.feed"""

_TOLERANCE = """WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE value IS NOT NULL),
f AS (SELECT user_id, event_id, n, value, value AS last, true AS emitted FROM e WHERE n = 1
 UNION ALL SELECT e.user_id, e.event_id, e.n, e.value, CASE WHEN abs(e.value - f.last) > 20.0 THEN e.value ELSE f.last END, abs(e.value - f.last) > 20.0 FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, event_id, value FROM f WHERE emitted"""


def _packet_stream(s: SparkSession, d: str) -> DataFrame:
    """Events gathered into packets of a user's hundred ids, and out of them again."""
    record = F.struct((F.col("event_id") % 100).cast("int").alias("index"), F.col("value").alias("x"), (-F.col("value")).alias("y"))
    packets = table(s, d, "events").groupBy(F.col("user_id").alias("feed"), F.floor(F.col("event_id") / 100).alias("seq")).agg(F.collect_list(record).alias("records"))
    return st.packet_records(packets)


def _points(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


_POINTS = "SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings"


def _packets(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_id", F.when(F.col("event_id") % 17 == 0, 2).otherwise(1).alias("version"), F.when(F.col("event_id") % 19 == 0, 20000).otherwise(F.col("event_id") % 100).alias("n_records"), "value")
    return st.packet_validation(e.withColumn("n_bytes", F.col("n_records") * 48 + F.when(F.col("event_id") % 23 == 0, 1).otherwise(0))).select("event_id", "malformed")


def _composite(s: SparkSession, d: str) -> DataFrame:
    base = table(s, d, "part").where("p_partkey % 4 <> 0").select("p_partkey", "p_brand")
    over = table(s, d, "part").where("p_partkey % 3 = 0").select("p_partkey", F.lit("override").alias("p_brand"))
    return r.composite([base, over], "p_partkey")


def _drift(s: SparkSession, d: str) -> DataFrame:
    saved = table(s, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    now = table(s, d, "customer").where("c_custkey % 6 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, "MOVED").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), (F.col("c_acctbal") + F.col("c_custkey") % 3).alias("c_acctbal"), F.when(F.col("c_nationkey") == 7, 99).otherwise(F.col("c_nationkey")).alias("c_nationkey"))
    return r.session_drift(saved, now, "c_custkey", "c_mktsegment", ["c_acctbal"], "c_nationkey", 1.5)


def _subjects(s: SparkSession, d: str) -> DataFrame:
    x = lambda i: F.col("embedding")[i].cast("double")
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), x(0).alias("x"), x(1).alias("y"), x(2).alias("z"), (x(3) * 100).alias("ex"), F.abs(x(4) * 100).alias("ey"), F.abs(x(5) * 100).alias("ez"), (x(6) * 180).alias("yaw"))


_FRAMING = """WITH e AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) * 100 AS ex, abs(CAST(embedding[5] AS DOUBLE) * 100) AS ey, abs(CAST(embedding[6] AS DOUBLE) * 100) AS ez, CAST(embedding[7] AS DOUBLE) * 180 AS yaw FROM embeddings),
p(preset, scale, up, turn, world) AS (VALUES ('context_three_quarter', 1.8, 0.5, 42.0, false), ('facade_front', 1.25, 0.08, 0.0, false), ('cardinal_north', 1.45, 0.18, 90.0, true), ('cardinal_east', 1.45, 0.18, 0.0, true), ('cardinal_south', 1.45, 0.18, -90.0, true), ('cardinal_west', 1.45, 0.18, 180.0, true)),
q AS (SELECT *, greatest(1.0, sqrt(ex * ex + ey * ey + ez * ez)) / sin(radians(30.0)) / 0.8 * CAST(scale AS DOUBLE) AS distance, radians(CASE WHEN world THEN CAST(turn AS DOUBLE) ELSE yaw + CAST(turn AS DOUBLE) END) AS a, ez * CAST(up AS DOUBLE) AS dz FROM e, p WHERE ex >= 0)
SELECT id, preset, round(distance, 4) AS distance, round(x + cos(a) * distance, 4) AS cx, round(y + sin(a) * distance, 4) AS cy, round(z + dz, 4) AS cz, round(degrees(atan2(-dz, distance)), 4) AS pitch FROM q"""


_w = lambda *k: Window.partitionBy(*k)

QUERIES = {
    "resolve_references": (edges, _EDGES),
    "reference_diagnostics": (lambda s, d: r.diagnostics(edges(s, d)).select("source_row", "code", "message"), f"SELECT source_row, 'reference_' || status AS code, source_row || ' -> ' || coalesce(target_table, 'no table') || '/' || coalesce(target_row, 'no row') || ' (' || candidates || ' found)' AS message FROM ({_EDGES}) WHERE status <> 'resolved'"),
    "reference_report": (lambda s, d: r.report(edges(s, d)), f"SELECT count(*) AS reference_count, count(*) FILTER (status = 'resolved') AS resolved_count, count(*) FILTER (status <> 'resolved') AS issue_count FROM ({_EDGES})"),
    "nested_references": (_nested, "SELECT CAST(l_orderkey AS VARCHAR) AS source_row, '$.lines[' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_partkey AS VARCHAR)) - 1) || '].ref' AS value_path, 'part' AS target_table, CAST(l_partkey AS VARCHAR) AS target_row FROM lineitem"),
    "joined_view": (_views, _VIEWS),
    "joined_view_summary": (lambda s, d: view(s, d).agg(F.count("*").alias("row_count"), F.count_if(F.col("reason").isNull()).alias("resolved_count"), F.count("reason").alias("unresolved_count")), f"SELECT count(*) AS row_count, count(*) FILTER (reason IS NULL) AS resolved_count, count(reason) AS unresolved_count FROM ({_VIEW})"),
    "referenced_tables": (lambda s, d: r.referenced_tables(edges(s, d)), f"SELECT DISTINCT target_table FROM ({_EDGES}) WHERE target_table IS NOT NULL"),
    "combined_matrix": (lambda s, d: r.combined_matrix(table(s, d, "orders"), table(s, d, "customer"), "o_custkey", "c_custkey", {"source": ["o_orderkey", "o_orderstatus"], "target": ["c_name"]}), 'SELECT o_orderkey AS source_o_orderkey, o_orderstatus AS source_o_orderstatus, c_name AS target_c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey'),
    "lookup_or_fail": (lambda s, d: r.lookup_or_fail(table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), table(s, d, "customer").where("c_custkey % 4 <> 0").select("c_custkey", "c_name"), "c_custkey", "profile_missing").select("o_orderkey", "c_name", "error_code"), "SELECT o_orderkey, c_name, CASE WHEN c_name IS NULL THEN 'profile_missing' END AS error_code FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) ON o_custkey = c_custkey"),
    "composite_override": (_composite, "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'override' ELSE p_brand END AS p_brand FROM part WHERE p_partkey % 4 <> 0 OR p_partkey % 3 = 0"),
    "session_drift": (_drift, "SELECT c_custkey, reasons, reasons = '' AS resumable FROM (SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'actor_missing' ELSE concat_ws(',', CASE WHEN c_custkey % 5 = 0 AND c_mktsegment <> 'MOVED' THEN 'map_changed' END, CASE WHEN c_custkey % 3 > 1.5 THEN 'bounds_changed' END, CASE WHEN c_nationkey = 7 THEN 'review_set_changed' END) END AS reasons FROM customer)"),
    "catalog_merge": (catalogs, _CATALOGS),
    "catalog_divergence": (lambda s, d: catalogs(s, d).where("divergence <> ''").select("p_partkey", "divergence"), f"SELECT p_partkey, divergence FROM ({_CATALOGS}) WHERE divergence <> ''"),
    "parity_report": (_parity, _PARITY),
    "table_fingerprint": (_fingerprints, _FINGERPRINTS),
    "table_diff": (diff, _DIFF),
    "dirty_sets": (lambda s, d: c.dirty_rows(diff(s, d), _mutated(s, d)[1], "o_custkey", "o_orderkey"), _DIRTY),
    "session_review": (_review, _REVIEW),
    "fold_set_cell": (_fold, _FOLD),
    "fold_rows": (_fold_rows, _FOLD_ROWS),
    "fold_table": (_fold_table, _FOLD_TABLE),
    "bulk_edit_validation": (_edits, _EDITS),
    "idempotent_operations": (_operations, _OPERATIONS),
    "append_group": (_append, _APPEND),
    "command_groups": (lambda s, d: c.command_groups(*_commands(s, d), "user_id", "place", "event_type", "props"), f"WITH {_COMMANDS} SELECT user_id, event_type, count(*) AS commands, CAST(min(place) AS INTEGER) AS start, arg_min(props, place) AS first_table, count(DISTINCT props) AS tables, min(place) < any_value(pointer) AS active FROM c GROUP BY 1, 2"),
    "pipeline_state": (_states, _STATES),
    "run_summary": (lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") != "F").alias("ok"), F.count_if(F.col("o_orderstatus") == "F").alias("failed")).withColumn("status", F.when(F.col("failed") == 0, "completed").when(F.col("ok") == 0, "failed").otherwise("completed_with_failures")), "SELECT *, CASE WHEN failed = 0 THEN 'completed' WHEN ok = 0 THEN 'failed' ELSE 'completed_with_failures' END AS status FROM (SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'F') AS ok, count(*) FILTER (o_orderstatus = 'F') AS failed FROM orders GROUP BY 1)"),
    "duplicate_names": (lambda s, d: c.duplicate_names(table(s, d, "events").select("event_id", "event_type", F.col("user_id")), "user_id", "event_type", "event_id").select("event_id", "first_name"), "SELECT event_id, first_name FROM (SELECT event_id, row_number() OVER w AS n, first_value(event_type) OVER w AS first_name FROM events WINDOW w AS (PARTITION BY user_id, lower(event_type) ORDER BY event_id)) WHERE n > 1"),
    "row_name_check": (lambda s, d: table(s, d, "part").select("p_partkey", c.row_name_problem(F.when(F.col("p_partkey") % 10 == 0, "None").otherwise(F.col("p_name"))).alias("problem")), "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'reserved' WHEN p_name IS NULL OR p_name = '' THEN 'empty' WHEN lower(p_name) = 'none' THEN 'reserved' END AS problem FROM part"),
    "latest_receipt": (lambda s, d: st.latest_state(table(s, d, "events"), "user_id", "event_id", "event_type"), "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1"),
    "sequence_gaps": (lambda s, d: sc.sequence_gaps(table(s, d, "events").select("event_id", "user_id"), "user_id", "event_id").select("event_id", F.col("gap").alias("missing")), "SELECT event_id, greatest(0, coalesce(event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - 1, 0)) AS missing FROM events"),
    "exact_change_filter": (lambda s, d: c.exact_changes(table(s, d, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id", "event_type").select("event_id"), "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER w AS p, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE n = 1 OR p IS DISTINCT FROM event_type"),
    "tolerance_change_filter": (lambda s, d: c.tolerance_filter(table(s, d, "events"), "user_id", "event_id", "value", 20.0), _TOLERANCE),
    "exact_set_match": (lambda s, d: c.exact_set_match(table(s, d, "orders").select(F.col("o_custkey").alias("key")), table(s, d, "customer").select(F.col("c_custkey").alias("key")), "key"), "WITH l AS (SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT c_custkey AS key, count(*) AS m FROM customer GROUP BY 1) SELECT * FROM (SELECT key, CASE WHEN m IS NULL THEN 'missing' WHEN n IS NULL THEN 'unexpected' WHEN n > 1 OR m > 1 THEN 'duplicate' END AS problem FROM l FULL JOIN r USING (key)) WHERE problem IS NOT NULL"),
    "permutation_check": (lambda s, d: c.permutation_check(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") == 1, 0).otherwise(F.col("l_linenumber")).alias("new")), "l_orderkey", "l_linenumber", "new"), "SELECT l_orderkey, list_sort(list(l_linenumber)) = list_sort(list(CASE WHEN l_quantity = 1 THEN 0 ELSE l_linenumber END)) AS permutation FROM lineitem GROUP BY 1"),
    "distinct_tables": (lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.min("event_id").alias("first_seen")), "SELECT event_type, min(event_id) AS first_seen FROM events GROUP BY 1"),
    "merge_paths": (lambda s, d: c.merge_paths(table(s, d, "orders").where("o_orderstatus = 'P'").select("o_custkey"), table(s, d, "orders").where("o_orderstatus = 'F'").select("o_custkey")), "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus IN ('P', 'F')"),
    "observation_state": (lambda s, d: st.observation_state(_observed(s, d)), _OBSERVED),
    "observed_world": (_world, _WORLD),
    "packet_validation": (_packets, "SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'version' WHEN event_id % 19 = 0 THEN 'record_count' WHEN event_id % 23 = 0 THEN 'length' WHEN value IS NULL OR NOT isfinite(value) THEN 'not_finite' END AS malformed FROM events"),
    "latest_state": (lambda s, d: st.latest_state(table(s, d, "events"), "user_id", "event_id", "value"), "SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1"),
    "coalesce_updates": (lambda s, d: st.coalesce_updates(table(s, d, "events").withColumn("delivery", F.floor(F.col("event_id") / 100)).withColumn("feed", F.col("user_id") % 3), "feed", "delivery", "user_id", "event_id", "value", (F.col("event_type") == "signup") & (F.col("event_id") % 4 == 0)), "WITH e AS (SELECT user_id % 3 AS feed, event_id // 100 AS delivery, user_id, event_id, value, event_type = 'signup' AND event_id % 4 = 0 AS c FROM events), m AS (SELECT feed, delivery, max(event_id) FILTER (c) AS m FROM e GROUP BY 1, 2) SELECT feed, delivery, user_id, arg_max(value, event_id) AS value, count(*) - 1 AS replaced FROM e JOIN m USING (feed, delivery) WHERE NOT c AND (m IS NULL OR event_id > m) GROUP BY 1, 2, 3"),
    "keep_latest_n": (lambda s, d: st.keep_latest(table(s, d, "events").select("event_id", "user_id"), "user_id", "event_id", 3).select("event_id", "dropped"), "SELECT event_id, greatest(total - 3, 0) AS dropped FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n, count(*) OVER (PARTITION BY user_id) AS total FROM events) WHERE n <= 3"),
    "consecutive_rejects": (lambda s, d: st.consecutive_rejects(table(s, d, "events").select("user_id", "event_id", (F.col("event_type") != "view").alias("rejected")), "user_id", "event_id", "rejected", 8), "WITH e AS (SELECT user_id, event_id, event_type <> 'view' AS rejected, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type <> 'view' ORDER BY event_id) AS g FROM events), g AS (SELECT *, row_number() OVER (PARTITION BY user_id, rejected, g ORDER BY event_id) AS n FROM e) SELECT user_id, CAST(coalesce(max(n) FILTER (rejected), 0) AS INTEGER) AS longest, min(event_id) FILTER (rejected AND n = 8) AS tripped_at FROM g GROUP BY 1"),
    "stream_metrics": (lambda s, d: st.stream_metrics(table(s, d, "events").select("user_id", "event_id", (F.col("event_id") % 7).alias("records"), "event_type", (F.col("event_id") % 50).alias("counter")), "user_id", "event_id", "records", "event_type", "counter"), "SELECT user_id, count(*) AS packets, CAST(sum(96 + 48 * (event_id % 7)) AS BIGINT) AS bytes, CAST(sum(event_id % 7) AS BIGINT) AS sampled, count(*) FILTER (n = 1 OR event_type IS DISTINCT FROM t) AS changed, CAST(sum(greatest(0, event_id % 50 - coalesce(p, 0))) AS BIGINT) AS replacements, CAST(sum(greatest(0, coalesce(event_id - e - 1, 0))) AS BIGINT) AS gaps FROM (SELECT *, lag(event_type) OVER w AS t, lag(event_id) OVER w AS e, row_number() OVER w AS n, max(event_id % 50) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) GROUP BY 1"),
    "sample_age": (lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.greatest(F.lit(0), F.lit(2_000_000_000) - F.unix_timestamp(F.max("ts").cast("timestamp"))).alias("age")), "SELECT user_id, greatest(0, 2000000000 - CAST(floor(epoch(max(ts))) AS BIGINT)) AS age FROM events GROUP BY 1"),
    "spatial_bounds": (lambda s, d: sp.bounds(_points(s, d)), f"SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM ({_POINTS})"),
    "planar_projection": (lambda s, d: sp.planar_projection(_points(s, d)).select("id", F.round("px", 6).alias("px"), F.round("py", 6).alias("py")), f"WITH p AS ({_POINTS}), b AS (SELECT min(x) a, max(x) b, min(y) c, max(y) d, greatest(1.0, max(x) - min(x), max(y) - min(y)) * 1.16 AS side FROM p) SELECT id, round(((x - (a + b) / 2) / side + 0.5) * 100, 6) AS px, round(100 - ((y - (c + d) / 2) / side + 0.5) * 100, 6) AS py FROM p, b"),
    "nearest_entity": (lambda s, d: sp.nearest_entity(_points(s, d).where("id % 20 = 0").withColumnRenamed("id", "query_id"), _points(s, d), 0.05, but_itself=True), f"WITH p AS ({_POINTS}), m AS (SELECT q.id AS query_id, p.id, (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) AS d FROM p q JOIN p ON q.id % 20 = 0 AND p.id <> q.id) SELECT query_id, arg_min(id, (d, id)) AS id FROM m WHERE d <= 0.05 * 0.05 GROUP BY 1"),
    "framing_candidates": (lambda s, d: sp.framing_candidates(_subjects(s, d)).select("id", "preset", *[F.round(c_, 4).alias(c_) for c_ in ("distance", "cx", "cy", "cz", "pitch")]), _FRAMING),
    "reference_fields": (_reference_fields, "SELECT 'l_partkey' AS field FROM lineitem HAVING count(*) > 0 UNION ALL SELECT 'l_suppkey' FROM lineitem HAVING count(*) FILTER (l_quantity > 10) > 0"),
    "stream_source": (_packet_stream, "SELECT user_id AS feed, event_id // 100 AS seq, CAST(event_id % 100 AS INTEGER) AS index, value AS x, -value AS y FROM events"),
}
