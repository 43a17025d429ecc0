import pytest
from pyspark.sql import functions as F

from tablewatch import sources, streaming
from tablewatch.operators import audit, changes, folds, references, review, values


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_rules_find_what_breaks_them(spark):
    records = spark.createDataFrame([("World_256", "World", 256, 256), ("UI_1024x512", "UI", 1024, 512), ("Odd_300x180", "Effects", 300, 180), ("Unknown", "UI", None, 5)], "object_path string, record_group string, width int, height int")
    rules = spark.createDataFrame([("pow2", "power_of_two", "warning", None, None), ("ui_512", "group_maximum", "error", "UI", 512)], "rule_id string, kind string, severity string, rule_group string, maximum int")
    assert rows(audit.evaluate_rules(records, rules)) == [("Odd_300x180", "pow2", "warning"), ("UI_1024x512", "ui_512", "error")]


def test_reference_statuses(spark):
    edges = spark.createDataFrame([("a", "T", "x"), ("b", "T", "twice"), ("c", "T", "no"), ("d", "no", "x"), ("e", None, "x"), ("f", "D", "x")], "source_row string, target_table string, target_row string")
    tables = spark.createDataFrame([("T",), ("D",), ("D",)], "table_path string")
    names = spark.createDataFrame([("T", "x"), ("T", "twice"), ("T", "twice")], "table_path string, row_name string")
    found = {r.source_row: r.status for r in references.resolve(edges, tables, names).collect()}
    assert found == {"a": "resolved", "b": "ambiguous_row", "c": "missing_row", "d": "missing_table", "e": "unassigned", "f": "ambiguous_table"}


def test_fold_rejects_the_table_of_a_wrong_old_value(spark):
    base = spark.createDataFrame([("t", 1, "a"), ("t", 2, "b"), ("u", 1, "c"), ("v", 1, "d")], "table_path string, row_id long, value string")
    log = spark.createDataFrame([("t", 1, 1, "a", "x"), ("t", 1, 2, "x", "y"), ("u", 1, 1, "wrong", "z"), ("v", 9, 1, "d", "z")], "table_path string, row_id long, seq long, old_value string, new_value string")
    assert rows(changes.fold_set_cell(base, log)) == [("t", 1, "y", True), ("t", 2, "b", True), ("u", 1, "c", False), ("v", 1, "d", False)]


def test_tolerance_compares_with_the_last_emitted(spark):
    samples = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.6), (1, 3, 1.2), (1, 4, 1.3)], "k long, s long, v double")
    assert [r[1] for r in rows(changes.tolerance_filter(samples, "k", "s", "v", 1.0))] == [1, 3]


SEEN = [  # arrival, kind, session, revision, seq, entries, indices; then outcome, status, gap
    (1, "transforms", "s", 1, 1, None, [0], "no_catalog", "connecting", False),
    (2, "reset", None, None, None, None, None, "accepted", "unavailable", False),
    (3, "catalog", "s", 1, None, 3, None, "accepted", "live", False),
    (4, "transforms", "s", 1, 0, None, [0], "duplicate_sequence", "live", False),
    (5, "transforms", "s", 1, 1, None, [0, 2], "accepted", "live", False),
    (6, "transforms", "other", 1, 2, None, [0], "wrong_session", "live", False),
    (7, "transforms", "s", 2, 2, None, [0], "wrong_revision", "live", False),
    (8, "transforms", "s", 1, 4, None, [3], "out_of_range_index", "live", False),
    (9, "transforms", "s", 1, 4, None, [1, 1], "duplicate_index", "live", False),
    (10, "transforms", "s", 1, 4, None, [], "accepted", "live", True),
    (11, "transforms", "s", 1, 3, None, [0], "regressing_sequence", "live", False),
    (12, "reset", None, None, None, None, None, "accepted", "stale", False),
    (13, "transforms", "s", 1, 3, None, [0], "regressing_sequence", "stale", False),
    (14, "transforms", "s", 1, 4, None, [0], "accepted", "live", False),
    (15, "transforms", "s", 1, 4, None, [0], "duplicate_sequence", "live", False),
    (16, "unavailable", None, None, None, None, None, "accepted", "unavailable", False),
    (17, "transforms", "s", 1, 9, None, [0], "no_catalog", "unavailable", False),
    (18, "reset", None, None, None, None, None, "accepted", "stale", False),
    (19, "transforms", "s", 1, 9, None, [0], "accepted", "live", False),
    (20, "polling", None, None, None, None, None, "accepted", "polling_fallback", False),
    (21, "reset", None, None, None, None, None, "accepted", "unavailable", False),
    (22, "catalog", "s", 2, None, 1, None, "accepted", "live", False),
    (23, "transforms", "s", 2, 2, None, [0], "accepted", "live", True),
]


def test_observation_scenarios_and_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(f, *x[:7]) for f in (1, 2) for x in SEEN if f == 1 or x[0] != 12], streaming.EVENT)
    found = rows(streaming.observation_state(events))
    assert [r[1:] for r in found if r[0] == 1] == [(x[0], *x[7:]) for x in SEEN]
    assert next(r for r in found if r[:2] == (2, 14))[2] == "duplicate_sequence"
    for part, (low, high) in enumerate(((0, 9), (9, 99))):  # the second trigger goes on from the state of the first
        events.where(f"arrival > {low} and arrival <= {high}").write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(streaming.EVENT).json(str(tmp_path / "in"))
        query = streaming.observe_stream(stream).writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start(str(tmp_path / "out"))
        query.awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == found


def test_packets_and_trips_as_streams(spark, tmp_path):
    packets = spark.createDataFrame([(1, 1, "s", 1, 1, [(0, 1.0, 2.0), (1, 3.0, 4.0)]), (1, 2, "s", 1, 2, [])], streaming.PACKET)
    packets.write.json(str(tmp_path / "packets"))
    records = streaming.packet_records(streaming.read_packets(spark, str(tmp_path / "packets")))
    records.writeStream.format("memory").queryName("records").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck1")).start().awaitTermination(120)
    assert rows(spark.table("records")) == rows(streaming.packet_records(packets)) == [(1, 1, "s", 1, 1, 0, 1.0, 2.0), (1, 1, "s", 1, 1, 1, 3.0, 4.0)]
    said = [(1, i, i not in (4, 9)) for i in range(1, 13)] + [(2, 1, False)]
    events = spark.createDataFrame(said, "feed long, arrival long, rejected boolean")
    assert rows(streaming.consecutive_rejects(events, "feed", "arrival", "rejected", 3)) == [(1, 4, 3), (2, 0, None)]
    events.write.parquet(str(tmp_path / "rejects"))
    stream = streaming.trip_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "rejects")), 3)
    stream.writeStream.format("memory").queryName("trips").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck2")).start().awaitTermination(120)
    assert rows(spark.table("trips")) == [(1, 3), (1, 7), (1, 12)]


def test_fold_rows(spark):
    base = spark.createDataFrame([(t, i, f"r{i}", n) for t in "tuvw" for i, n in enumerate("AB")], "table_path string, row_index long, row_id string, row_name string")
    schema = "table_path string, seq long, kind string, row_id string, row_name string, old_name string, at_index long, old_order array<string>, new_order array<string>"
    add = ("t", 2, "add", "r2", "D", None, 1, None, None)
    log = [("t", 1, "rename", "r0", "C", "A", 0, None, None), add, ("t", 3, "remove", "r1", None, None, 2, None, None), ("t", 4, "reorder", None, None, None, None, ["r0", "r2"], ["r2", "r0"])]
    log += [("u", 1, "rename", "r0", "B", "A", 0, None, None), ("v", 1, "reorder", None, None, None, None, ["r0", "r1"], ["r0", "r0"])]
    found = rows(folds.fold_rows(base, spark.createDataFrame(log, schema)))
    kept = lambda t, error=None: [(t, i, f"r{i}", n, error) for i, n in enumerate("AB")]
    assert found == [("t", 0, "r2", "D", None), ("t", 1, "r0", "C", None), *kept("u", "rename_rejected:1"), *kept("v", "reorder_rejected:1"), *kept("w")]


def test_rows_by_place_in_many_pieces():
    base = [str(i) for i in range(1500)]
    plain, runs, log = list(base), [], []
    for i in range(3000):
        place = i * 7919 % (len(plain) + 1)
        log.append((2 * i, "add", f"n{i}", place))
        plain.insert(place, f"n{i}")
        if i % 3 == 0:
            place = i * 31 % len(plain)
            log.append((2 * i + 1, "remove", plain.pop(place), place))
    size = len(base)
    for a in range(0, len(log), 100):
        runs.append(folds.Pieces.of_run(size, log[a : a + 100]))
        size += sum(1 if k == "add" else -1 for _, k, _, _ in log[a : a + 100])
    pairs = [x.then(y) for x, y in zip(runs[::2], runs[1::2], strict=True)]
    whole = pairs[0]
    for p in pairs[1:]:
        whole = whole.then(p)
    assert whole.failed is None and all(base[place] == row for _, place, row in whole.claims)
    assert [x for start, n, birth, row in whole.parts for x in ([row] if birth >= 0 else base[start : start + n])] == plain


def test_diff_marks_tables_whose_rows_moved(spark):
    schema = "t string, id long, i long, name string, v string"
    base = spark.createDataFrame([("a", 1, 0, "x", "p"), ("a", 2, 1, "y", None), ("b", 3, 0, "z", "q"), ("c", 4, 0, "w", "q")], schema)
    work = spark.createDataFrame([("a", 2, 0, "y", None), ("a", 1, 1, "x2", "p"), ("b", 3, 0, "z", "r"), ("c", 4, 0, "w", "q")], schema)
    found = changes.table_diff(base, work, "t", "id", "i", "name", ["v"])
    assert rows(found.na.fill("-").na.fill(0)) == [("a", "row_renamed", 1, "-", "x", "x2"), ("a", "rows_reordered", 0, "-", "-", "-"), ("b", "cell_changed", 3, "v", "q", "r")]
    assert rows(changes.dirty_rows(found, work, "t", "id")) == [("a", 1), ("a", 2), ("b", 3)]


def test_fingerprints_ignore_the_order_of_sets_and_maps_only(spark):
    def print_of(tags, size, names, kind):
        df = spark.createDataFrame([("t", 0, tags, size, names)], "table_path string, i long, tags array<string>, size map<string,int>, names array<string>")
        head = spark.createDataFrame([("t", kind)], "table_path string, kind string")
        return changes.table_fingerprint(df, "table_path", "i", ["tags", "size", "names"], ["tags"], head).first().fingerprint

    one = print_of(["a", "b"], {"x": 1, "y": 2}, ["m", "n"], "DataTable")
    assert one == print_of(["b", "a"], {"y": 2, "x": 1}, ["m", "n"], "DataTable")
    assert len({one, print_of(["a", "b"], {"x": 1, "y": 2}, ["n", "m"], "DataTable"), print_of(["a", "b"], {"x": 1, "y": 2}, ["m", "n"], "Composite"), print_of(["a", None], {"x": 1, "y": 2}, ["m", "n"], "DataTable")}) == 4


def test_values_of_described_types(spark):
    described = {"kind": "map", "key": {"kind": "enum", "options": ["a"]}, "value": {"kind": "struct", "fields": {"n": ({"kind": "int"}, True), "s": ({"kind": "set", "element": {"kind": "string"}}, False)}}}
    said = ['[{"key": "a", "value": {"n": "-3", "s": ["x"]}}]', '[{"key": "a", "value": {"n": 3}}]', "[]", '[{"key": "b", "value": {"n": "3"}}]', '[{"key": "a", "value": {}}]', '[{"key": "a", "value": {"n": "01"}}]', '[{"key": "a", "value": {"n": "1", "s": [1]}}]', '{"key": "a"}', "null"]
    df = spark.createDataFrame(list(enumerate(said)), "i int, json string").selectExpr("i", "parse_json(json) AS v")
    assert [r[1] for r in rows(df.select("i", values.compatible(F.col("v"), described)))] == [True] * 3 + [False] * 6


def test_walk_goes_through_objects_or_arrays_too(spark):
    df = spark.createDataFrame([(1, '{"a": {"raw": "x"}, "l": [{"raw": "y"}], "n": null}'), (2, "broken"), (3, None)], "entry int, json string")
    assert rows(review.decode_gaps(df)) == [(1, "$.a")]
    paths = {r.value_path for r in values.walk(df.selectExpr("entry", "try_parse_json(json) AS v0"), "v0").collect()}
    assert paths == {"$", "$.a", "$.a.raw", "$.l", "$.l[0]", "$.l[0].raw", "$.n"}
    assert rows(review.decode_gaps(df.limit(0))) == []


def test_percentiles_by_nearest_rank(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(1, 21)] + [("b", 5.0)] * 3 + [("c", None)], "k string, v double")
    assert rows(audit.latency_distribution(df, "k", "v")) == [("a", 20, 10.5, 1.0, 20.0, 10.0, 19.0), ("b", 3, 5.0, 5.0, 5.0, 5.0, 5.0)]


def test_search_needs_all_words_anywhere(spark):
    df = spark.createDataFrame([(1, "Hello there", "UI"), (2, "hello", None), (3, None, None)], "id int, text string, place string")
    ids = lambda q: [r.id for r in audit.search(df, q, ["text", "place"]).orderBy("id").collect()]
    assert (ids("hello UI"), ids("  "), ids("HELLO"), ids("missing")) == ([1], [1, 2, 3], [1, 2], [])


def test_a_run_is_written_once(spark, tmp_path):
    path = sources.write_run(spark.range(3), str(tmp_path), "r1")
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="run r1 exists"):
        sources.write_run(spark.range(5), str(tmp_path), "r1")
    assert spark.read.parquet(path).count() == 3


def test_inspections_of_another_version_fail(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"schema_version": 7, "status": "partial", "assets": [{"path": "p", "kind": "DataTable"}]}\n')
    read = sources.scan_inspections(spark, str(tmp_path))
    assert [(r.status, len(r.assets), r.decode_errors) for r in read.collect()] == [("partial", 1, [])]
    assert rows(sources.table_descriptors(read)) == [("p", "DataTable", "partial")]
    (tmp_path / "b.json").write_text('{"schema_version": 6}\n')
    with pytest.raises(Exception, match="schema_version must be 7"):
        sources.scan_inspections(spark, str(tmp_path)).collect()


def test_undo_and_redo_move_by_runs_of_a_group(spark):
    log = spark.createDataFrame([(s, i, g) for s in (1, 2, 3) for i, g in enumerate("aabba")], "s int, place int, g string")
    at = spark.createDataFrame([(1, 4), (2, 0), (3, 5)], "s int, pointer int")
    assert rows(review.undo_redo(log, at, "s", "place", "g")) == [(1, 4, 2, 5), (2, 0, 0, 2), (3, 5, 4, 5)]


def test_nested_references_have_no_row_limit(spark):
    said = '{"a": [{"table": "t", "row": "x"}, {"b": {"table": "t", "row": "y", "c": {"row": 7}}}], "row": null, "s": "{[["}'
    docs = spark.createDataFrame([(str(i), said) for i in range(50)] + [("none", None), ("flat", "3")], "source_row string, document string")
    expected = [("$.a[0]", "t", "x"), ("$.a[1].b", "t", "y"), ("$.a[1].b.c", None, "7")]
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        found = references.nested_references(docs).collect()
        assert sorted(map(tuple, found), key=str) == sorted(((str(i), *x) for i in range(50) for x in expected), key=str)
        with pytest.raises(ValueError, match="below 2 levels"):
            references.nested_references(docs, depth=2)
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_levels_are_opened_without_copies_of_what_they_hold(spark, monkeypatch):
    plans, staged = [], values.staged
    monkeypatch.setattr(values, "staged", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or staged(df, name))
    rows = spark.createDataFrame([("a", 7, '{"x": [[], {"y z": {}}, 3]}')], "entry string, pos int, json string")
    found = values.walk(rows.selectExpr("entry", "pos", "try_parse_json(json) AS v0"), "v0", leaves=False).collect()
    assert sorted((r.pos, r.value_path, r.kind) for r in found) == [(7, "$", "object"), (7, "$.x", "array"), (7, "$.x[0]", "array"), (7, "$.x[1]", "object"), (7, '$.x[1]["y z"]', "object")]
    assert len(plans) == 5 and all("variant_explode" in x for x in plans[1:])
    assert not any(x in p for p in plans for x in ("MapType(StringType,VariantType", "map<string,variant>", "ArrayType(VariantType", "array<variant>", "Join"))
