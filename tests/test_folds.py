"""The parallel fold against a plain one, and scans against windows."""

import glob
import hashlib
import random
import time

import pytest
from pyspark.sql import Window, functions as F

from tablewatch.operators import audit, changes, folds, review, scans, values
from tablewatch.plans import changes as plans
from tablewatch.sources import staging

COLUMNS = "table_path string, seq long, kind string, row_id string, row_name string, old_name string, at_index long, field string, old_value string, new_value string, fields map<string,string>, old_order array<string>, new_order array<string>"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def plain_fold(base, log):
    """(rows, error) of one table: the commands one after the other on a list."""
    rows = [dict(r) for r in base]
    for c in log:
        at = next((i for i, r in enumerate(rows) if r["row_id"] == c["row_id"]), None)
        row = rows[at] if at is not None else None
        if c["kind"] == "set_cell":
            fits = row is not None and c["field"] in row["fields"] and row["fields"][c["field"]] == c["old_value"]
            if fits:
                rows[at] = row | {"fields": row["fields"] | {c["field"]: c["new_value"]}}
        elif c["kind"] == "add":
            fits = row is None and all(r["row_name"] != c["row_name"] for r in rows) and 0 <= c["at_index"] <= len(rows)
            if fits:
                rows.insert(c["at_index"], {"row_id": c["row_id"], "row_name": c["row_name"], "fields": c["fields"]})
        elif c["kind"] == "remove":
            fits = row is not None and at == c["at_index"]
            if fits:
                del rows[at]
        elif c["kind"] == "rename":
            fits = row is not None and row["row_name"] == c["old_name"] and all(r["row_name"] != c["row_name"] for r in rows)
            if fits:
                rows[at] = row | {"row_name": c["row_name"]}
        elif c["kind"] == "reorder":
            ids = [r["row_id"] for r in rows]
            fits = ids == c["old_order"] and sorted(ids) == sorted(c["new_order"])
            if fits:
                rows = [next(r for r in rows if r["row_id"] == i) for i in c["new_order"]]
        else:
            fits = False
        if not fits:
            return base, f"{c['kind']}_rejected:{c['seq']}"
    return rows, None


def random_log(rng, base, n, slip):
    """A log that fits, but for a chance of ``slip`` at each command."""
    rows, log = [dict(r) for r in base], []
    for seq in range(1, n + 1):
        kind = rng.choices(["set_cell", "add", "remove", "rename", "reorder"], [6, 6, 5, 3, 0.4])[0]
        if not rows and kind != "add":
            kind = "add"
        c = dict.fromkeys(NAMES) | {"seq": seq * 10, "kind": kind}
        at = rng.randrange(len(rows)) if rows else 0
        if kind == "add":
            again = [i for i in "abcdefghij" if all(r["row_id"] != i for r in rows)]
            c |= {"row_id": rng.choice(again) if again and rng.random() < 0.4 else f"n{seq}", "row_name": f"name {seq}", "at_index": rng.randint(0, len(rows)), "fields": {"x": str(rng.randrange(5)), "y": None} if rng.random() < 0.8 else {}}
        elif kind == "reorder":
            ids = [r["row_id"] for r in rows]
            c |= {"old_order": ids, "new_order": rng.sample(ids, len(ids))}
        else:
            row = rows[at]
            c |= {"row_id": row["row_id"]}
            if kind == "set_cell" and not row["fields"]:
                continue
            if kind == "set_cell":
                field = rng.choice(list(row["fields"]))
                c |= {"field": field, "old_value": row["fields"][field], "new_value": rng.choice(["1", "2", None, ""])}
            elif kind == "remove":
                c |= {"at_index": at}
            else:
                c |= {"old_name": row["row_name"], "row_name": rng.choice([f"re {seq}", "dup"])}
        if rng.random() < slip:
            what = rng.choice(["row_id", "at_index", "old_name", "row_name", "old_value", "field", "old_order", "new_order", "kind"])
            c[what] = {"at_index": rng.choice([-1, 0, len(rows), len(rows) + 1]), "old_order": ["a"], "new_order": ["a", "a"], "kind": "unknown"}.get(what, rng.choice(["a", "dup", "zzz"]))
        new, error = plain_fold(rows, [c])
        log.append(c)
        if error is None:
            rows = new
        elif rng.random() < 0.7:
            log.pop()
    return log


@pytest.mark.parametrize(("run", "composed", "range_"), [(4, 2, 3), (512, 8, 256)])
def test_fold_equals_a_plain_one_on_random_logs(spark, monkeypatch, run, composed, range_):
    monkeypatch.setattr(folds, "RUN", run)
    monkeypatch.setattr(folds, "COMPOSED", composed)
    monkeypatch.setattr(folds, "RANGE", range_)
    rng, tables, logs, expected = random.Random(run), [], [], []
    for t in range(60):
        base = [{"row_id": i, "row_name": rng.choice([f"of {i}", "dup", "twin"]), "fields": {"x": "0", "y": None}} for i in rng.sample("abcdefghij", rng.choice([0, 1, 4, 10]))]
        log = random_log(rng, base, rng.choice([0, 1, 5, 40, 120]), rng.choice([0, 0, 0.02, 0.1]))
        rows, error = plain_fold(base, log)
        tables += [(f"t{t}", i, r["row_id"], r["row_name"], r["fields"]) for i, r in enumerate(base)]
        logs += [tuple(c[n] if n != "table_path" else f"t{t}" for n in NAMES) for c in log]
        expected += [(f"t{t}", i, r["row_id"], r["row_name"], sorted(r["fields"].items()), error) for i, r in enumerate(rows)]
    table = spark.createDataFrame(tables, "table_path string, row_index long, row_id string, row_name string, fields map<string,string>")
    found = folds.fold_table(table, spark.createDataFrame(rng.sample(logs, len(logs)), COLUMNS))
    assert sorted(map(repr, expected)) == sorted(repr((r.table_path, r.row_index, r.row_id, r.row_name, sorted(r.fields.items()), r.error)) for r in found.collect())
    assert {e[5] is None for e in expected} == {True, False}


def test_rename_then_edit_by_stable_identity(spark):
    base = spark.createDataFrame([("t", 0, "row:Alpha", "Alpha", {"Count": "1"})], "table_path string, row_index long, row_id string, row_name string, fields map<string,string>")
    log = spark.createDataFrame([("t", 1, "rename", "row:Alpha", "Beta", "Alpha", None, None, None), ("t", 2, "set_cell", "row:Alpha", None, None, "Count", "1", "2")], "table_path string, seq long, kind string, row_id string, row_name string, old_name string, field string, old_value string, new_value string")
    assert [tuple(r) for r in folds.fold_table(base, log).collect()] == [("t", 0, "row:Alpha", "Beta", {"Count": "2"}, None)]


def test_names_are_counted(spark):
    """Of two rows with a name, one that gives it up leaves it taken."""
    base = spark.createDataFrame([("t", 0, "a", "A"), ("t", 1, "b", "A"), ("t", 2, "c", "C")], "table_path string, row_index long, row_id string, row_name string")
    log = spark.createDataFrame([("t", 1, "rename", "a", "B", "A"), ("t", 2, "rename", "c", "A", "C")], "table_path string, seq long, kind string, row_id string, row_name string, old_name string")
    assert {r.error for r in folds.fold_rows(base, log).collect()} == {"rename_rejected:2"}


def test_a_table_of_a_million_rows_takes_many_tasks(spark):
    n = 1_000_000
    rows = spark.range(n).select(F.lit("t").alias("table_path"), F.col("id").alias("row_index"), F.concat(F.lit("r"), "id").alias("row_id"), F.concat(F.lit("name "), "id").alias("row_name"))
    # every 500th row goes (each removal shifts the next), and a new one is put at its place
    gone = spark.range(0, n, 500).select(F.col("id").alias("place"))
    removed = gone.select(F.lit("t").alias("table_path"), (F.col("place") * 2).alias("seq"), F.lit("remove").alias("kind"), F.concat(F.lit("r"), "place").alias("row_id"), F.lit(None).cast("string").alias("row_name"), F.col("place").alias("at_index"))
    added = gone.select(F.lit("t").alias("table_path"), (F.col("place") * 2 + 1).alias("seq"), F.lit("add").alias("kind"), F.concat(F.lit("n"), "place").alias("row_id"), F.concat(F.lit("new "), "place").alias("row_name"), F.col("place").alias("at_index"))
    small = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "256k", "spark.sql.files.openCostInBytes": "1k", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        done = folds.fold_rows(rows, removed.union(added)).withColumn("task", F.spark_partition_id())
        told = done.groupBy("task").agg(F.count("*").alias("n"), F.count_if(F.col("row_id").startswith("n")).alias("new"), F.count_if(F.col("error").isNotNull()).alias("bad"), F.count_if(F.substring("row_id", 2, 9).cast("long") != F.col("row_index")).alias("moved")).collect()
    finally:
        for k in small:
            spark.conf.unset(k)
    assert sum(r.n for r in told) == n and sum(r.new for r in told) == n // 500
    assert sum(r.bad + r.moved for r in told) == 0
    assert max(r.n for r in told if r.n) < n / 2


def test_scans_equal_windows(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", None, "a", "b"]), i, rng.choice([None, 1, 2, 3])) for i in range(2000)]
    table = spark.createDataFrame(rows, "k string, i long, v int").repartition(7).withColumn("_part", F.lit("mine")).drop("_part")
    w = Window.partitionBy("k").orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    expected = table.withColumns({"s": F.sum(F.coalesce("v", F.lit(0))).over(upto), "l": F.lag("v").over(w), "f": F.first("v").over(upto)})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = scans.scan(table, ["k"], ["i"], sums={"s": F.col("v")}, lags={"l": F.col("v")}, firsts={"f": F.col("v")})
        assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, map(tuple, expected.collect())))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.at for r in scans.dense_index(table.where("k = 'hot'"), ["k"], ["i"], "at").orderBy("i").collect()] == list(range(table.where("k = 'hot'").count()))
    assert scans.scan(table.limit(0), ["k"], ["i"], sums={"s": F.col("v")}).count() == 0


@pytest.mark.parametrize("most", [0, 1000])
def test_a_key_of_most_rows_is_met_where_its_rows_are(spark, monkeypatch, most):
    monkeypatch.setattr(scans, "BROADCAST", most)
    rows = spark.createDataFrame([("hot", str(i)) for i in range(50)] + [("a", "x"), ("b", "y")], "k string, r string")
    side = spark.createDataFrame([("hot", 1), ("b", 2)], "k string, v int")
    count = lambda how: scans.met(rows, side, ["k"], "r", how).count()
    assert [count(how) for how in ("inner", "left", "left_semi", "left_anti")] == [51, 52, 51, 1]


def test_an_evicted_operation_runs_again(spark):
    rng = random.Random(6)
    rows = [(f"s{i % 3}", i, rng.choice([*"abcdefg", "", None]), rng.choice("xy")) for i in range(400)] + [("hot", 1000 + i, i_, "d") for i, i_ in enumerate("abca")]
    table = spark.createDataFrame(rows, "server string, seq long, id string, digest string").repartition(4)
    found = {r.seq: (r.outcome, r.retained) for r in changes.idempotent(table, "id", "seq", "digest", "server", keep=2).collect()}
    assert [found[1000 + i] for i in range(4)] == [("first", False), ("first", False), ("first", True), ("first", True)]
    kept, ran, expected = {}, {}, {}
    for server, seq, i, digest in rows:
        ring = kept.setdefault(server, [])
        old = next((d for k, d, _ in ring if k == i), None)
        expected[seq] = "invalid_request" if not i else "first" if old is None else "replayed" if old == digest else "operation_id_collision"
        if expected[seq] == "first":
            ring.append((i, digest, seq))
            del ring[:-2]
    ran = {seq for ring in kept.values() for _, _, seq in ring}
    assert found == {seq: (outcome, seq in ran) for seq, outcome in expected.items()}


def test_fingerprints_are_trees_over_places(spark):
    rng = random.Random(9)
    rows = [("t", i, str(i % 7)) for i in {rng.randrange(-(2**62), 2**62) for _ in range(130)}] + [("one", 5, "x")]

    def prints(rows, partitions, children):
        table = spark.createDataFrame(rows, "t string, i long, v string").repartition(partitions)
        return {r.t: r.fingerprint for r in changes.table_fingerprint(table, "t", "i", ["v"], children=children).collect()}

    def plain(values, children):
        level = [hashlib.sha256(f"={v}".encode()).hexdigest() for v in values]
        while True:
            level = [hashlib.sha256("".join(level[a : a + children]).encode()).hexdigest() for a in range(0, len(level), children)]
            if len(level) == 1:
                return level[0]

    for children in (3, 11, 1000):
        expected = {"t": plain([v for _, _, v in sorted(r for r in rows if r[0] == "t")], children), "one": plain(["x"], children)}
        assert prints(rows, 1, children) == prints(rows[::-1], 9, children) == expected
    assert prints([r for r in rows if r[0] == "one"], 1, 3)["one"] == plain(["x"], 3)  # other tables don't matter


def test_percentiles_of_one_heavy_key(spark):
    rng = random.Random(3)
    values = [round(rng.lognormvariate(0, 3), 3) for _ in range(3000)]
    rows = [("hot", v) for v in values] + [("a", 1.0), ("a", 1.0), ("a", 2.0), (None, 4.0), ("b", None)]
    found = {r.k: r for r in audit.latency_distribution(spark.createDataFrame(rows, "k string, v double").repartition(3), "k", "v").collect()}
    ordered = sorted(values)
    assert (found["hot"].n, found["hot"].p50, found["hot"].p95, found["hot"].least, found["hot"].most) == (3000, ordered[1499], ordered[2849], ordered[0], ordered[-1])
    assert (found["a"].p50, found["a"].p95, found[None].p50) == (1.0, 2.0, 4.0) and set(found) == {"hot", "a", None}


def test_the_walk_of_a_deep_row(spark):
    deep = "1"
    for i in range(30):
        deep = f'{{"a": {deep}}}' if i % 2 else f"[{deep}]"
    df = spark.createDataFrame([(1, deep), (2, '{"notes.raw": "text", "raw": "gone", "x": {"raw": "gone too"}, "y": ["in", {"q\\"": "said"}]}'), (3, None)], "entry int, json string").selectExpr("entry", "try_parse_json(json) AS v0")
    found = values.walk(df, "v0").collect()
    assert max(r.value_path.count("[") + r.value_path.count(".") for r in found if r.entry == 1) == 30
    assert {r.value_path for r in found if r.entry == 2 and r.kind == "leaf"} == {'$["notes.raw"]', "$.raw", "$.x.raw", "$.y[0]", '$.y[1]["q\\""]'}
    with pytest.raises(ValueError, match="below 29 levels"):
        values.walk(df, "v0", depth=29)
    texts = review.text_occurrences(spark.createDataFrame([(2, '{"notes.raw": "text", "raw": "gone", "x": ["in"]}')], "entry int, json string"), "p", "cell")
    assert sorted((r.value_path, r.text) for r in texts.collect()) == [("$.x[0]", "in"), ('$["notes.raw"]', "text")]
    gaps = review.decode_gaps(spark.createDataFrame([(1, '{"a": {"raw": "x"}, "b": {"raw": "x", "more": 1}, "c": {"raw": 5}}')], "entry int, json string"))
    assert sorted(r.value_path for r in gaps.collect()) == ["$.a", "$.c"]


def test_large_sides_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(scans, "BROADCAST", 0)
    rows = spark.range(100).selectExpr("id % 7 as k", "id")
    found = scans.met(rows, spark.range(5).selectExpr("id as k"), ["k"], "id", "left_semi")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == rows.where("k < 5").count()


def test_scan_carries_only_what_partitions_share(spark, monkeypatch):
    rows = spark.range(4000).selectExpr("if(id < 2000, 0, id) as k", "id")
    held = []
    monkeypatch.setattr(scans.F, "broadcast", lambda df, f=F.broadcast: held.append(df) or f(df))
    found = scans.scan(rows, ["k"], ["id"], sums={"n": F.lit(1).cast("long")}, lags={"before": F.col("id")}, firsts={"first": F.col("id")})
    w = Window.partitionBy("k").orderBy("id")
    plain = rows.withColumns({"n": F.row_number().over(w), "before": F.lag("id").over(w), "first": F.first("id").over(w)})
    assert sorted(found.collect(), key=str) == sorted(plain.selectExpr("k", "id", "cast(n as long) as n", "before", "first").collect(), key=str)
    assert held and all(df.count() < 50 for df in held)


def test_pieces_of_many_lists_are_written_in_linear_time():
    rows = ((str(i), 0, 0, None, [0], [1], [-1], [None], [], [], []) for i in range(60_000))
    began = time.process_time()
    assert sum(b.num_rows for b in folds._batches(rows)) == 60_000
    assert time.process_time() - began < 10


def test_known_tables_are_not_broadcast(spark):
    steps = spark.createDataFrame([(1, "a", "x", None), (2, "b", "y", None)], "operation long, table_path string, expected string, failure string")
    known = spark.createDataFrame([("a", "x", False)], "table_path string, fingerprint string, composite boolean")
    found = review.apply_transaction(steps, known, "operation")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == [(1, "committed", None), (2, "rejected", "table_not_found")]


def test_a_staged_table_frees_its_shuffle_files(spark):
    folder = spark.sparkContext.getConf().get("spark.local.dir")
    files = lambda: set(glob.glob(f"{folder}/**/shuffle_*.data", recursive=True))
    before = files()
    told = staging.staged(spark.range(200_000).groupBy((F.col("id") % 100_000).alias("k")).agg(F.sum("id").alias("s")), "sums")
    until = time.monotonic() + 20
    while files() - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not files() - before
    assert told.count() == 100_000 and spark.conf.get(staging.FREED, None) is None


def test_only_crowded_keys_are_copied(spark, monkeypatch):
    monkeypatch.setattr(scans, "BROADCAST", 0)
    rows = spark.createDataFrame([("hot", str(i)) for i in range(50)] + [("a", "x"), ("b", "y")], "k string, r string")
    side = spark.createDataFrame([("hot", 1), ("b", 2)], "k string, v int")
    met = lambda how: scans.met(rows, side, ["k"], "r", how)
    kinds = ("inner", "left", "left_semi", "left_anti")
    assert all("Generate" not in met(how)._jdf.queryExecution().executedPlan().toString() for how in kinds)
    monkeypatch.setattr(scans, "CROWDED", 10)
    assert "Generate" in met("inner")._jdf.queryExecution().executedPlan().toString()
    assert [met(how).count() for how in kinds] == [51, 52, 51, 1]


@pytest.mark.parametrize("most", [0, 200_000])
def test_transactions_equal_plain_ones_on_random_logs(spark, monkeypatch, most):
    monkeypatch.setattr(scans, "BROADCAST", most)
    rng = random.Random(11 + most)
    base = {f"t{t}": [{"row_id": i, "row_name": rng.choice([f"of {i}", "dup"]), "fields": {"x": "0", "y": None}} for i in rng.sample("abcdefghij", rng.choice([0, 0, 1, 4, 9]))] for t in range(8)}
    known = {t: ("print" + t, i == 7) for i, t in enumerate(base) if i != 6}
    steps, logs, outcomes, left = [], [], [], []
    for op in range(70):
        named = rng.sample(sorted(base)[: 8 if rng.random() < 0.2 else 6], rng.choice([1, 2, 3]))
        expected = [(t, "other" if rng.random() < 0.05 else "print" + t) for t in named] + ([(named[0], "print" + named[0])] if rng.random() < 0.05 else [])
        steps += [(op, t, e) for t, e in expected]
        each = {t: random_log(rng, base[t], rng.choice([0, 1, 4, 12]), rng.choice([0, 0, 0.05])) for t in named}
        if rng.random() < 0.1:
            each["t5" if "t5" not in named else "t4"] = random_log(rng, [], 1, 0)
        order = [t for t, log in each.items() for _ in log]
        rng.shuffle(order)
        turns, log = {t: iter(x) for t, x in each.items()}, []
        for seq, t in enumerate(order):
            log.append((t, next(turns[t]) | {"seq": seq}))
        logs += [(op, *[t if n == "table_path" else c[n] for n in NAMES]) for t, c in log]
        ranks = [1 for t, _ in expected if [x for x, _ in expected].count(t) > 1] + [2 for t, _ in expected if t not in known] + [3 for t, _ in expected if t in known and known[t][1]] + [4 for t, e in expected if t in known and e != known[t][0]]
        if ranks:
            outcomes.append((op, "rejected", ["duplicate_table", "table_not_found", "read_only_table", "fingerprint_mismatch"][min(ranks) - 1], None))
            continue
        tables, failed = {t: base[t] for t in named}, None
        for t, c in log:
            error = "outside"
            if t in tables:
                tables[t], error = plain_fold(tables[t], [c])
            if error:
                tables, failed = {t: base[t] for t in named}, c["seq"]
                break
        outcomes.append((op, "committed", None, None) if failed is None else (op, "rolled_back", "command_failed", failed))
        left += [(op, t, i, r["row_id"], r["row_name"], sorted(r["fields"].items())) for t, rows in tables.items() for i, r in enumerate(rows)]
    rows = spark.createDataFrame([(t, i, r["row_id"], r["row_name"], r["fields"]) for t, rows in base.items() for i, r in enumerate(rows)], "table_path string, row_index long, row_id string, row_name string, fields map<string,string>")
    found, after = folds.run_transactions(
        spark.createDataFrame(steps, "operation long, table_path string, expected string"),
        spark.createDataFrame([(t, *v) for t, v in known.items()], "table_path string, fingerprint string, composite boolean"),
        rows, spark.createDataFrame(rng.sample(logs, len(logs)), "operation long, " + COLUMNS), "operation",
    )
    assert sorted(tuple(r) for r in found.select("operation", "outcome", "code", "command").collect()) == outcomes
    assert sorted(map(repr, left)) == sorted(repr((r.operation, r.table_path, r.row_index, r.row_id, r.row_name, sorted(r.fields.items()))) for r in after.collect())
    assert {o[1] for o in outcomes} == {"rejected", "committed", "rolled_back"} and len({o[2] for o in outcomes}) == 6


@pytest.mark.parametrize("query", [plans._fold_table, plans._fold_rows])
def test_tables_of_a_fold_are_read_once(spark, monkeypatch, query):
    """Each command of the log is told from rows that are staged, so that only a reorder's lists are dealt out again."""
    held = []
    for name in ("fold_table", "fold_rows"):
        monkeypatch.setattr(plans.fo, name, lambda rows, log: held.append((rows, log)) or rows.withColumn("error", F.lit(None)))
    query(spark, "/root/testdata/sf0.001")
    rows, log = held[0]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(rows) and "Exchange" not in plan(log.where("kind <> 'reorder'"))
