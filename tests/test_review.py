from pyspark.sql import functions as F

from tablewatch.operators import review as v


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_units_keep_unresolved_rows_apart(spark):
    df = spark.createDataFrame([(1, "a", "x y", "t"), (2, "a", "x y", "u"), (3, None, "x", "t"), (4, None, "x", "t"), (5, "b", "x", None)], "id int, ns string, name string, text string")
    found = v.text_units(df, "ns", "name", "id", "text").select("unit_id", "occurrences", "entries", F.size("sources"), "state")
    assert rows(found) == [("a:x%20y", 2, [1, 2], 2, "conflicting"), ("b:x", 1, [5], 0, "consistent"), ("entry:3", 1, [3], 1, "consistent"), ("entry:4", 1, [4], 1, "consistent")]
    assert rows(v.text_units(df.limit(0), "ns", "name", "id", "text")) == []


def test_remap_keeps_present_ids(spark):
    saved = spark.createDataFrame([(1, "k"), (2, "k"), (3, None)], "id int, instance string")
    now = spark.createDataFrame([(2, "k"), (7, "k")], "id int, instance string")
    assert rows(v.identity_remap(saved, now, "id", "instance")) == [(1, 2), (2, 2), (3, None)]


def test_accept_needs_the_same_tables(spark):
    drafted = spark.createDataFrame([("s", "a", "1", "0", 3), ("t", "a", "1", "0", 1), ("u", "a", None, "0", 2)], "session string, path string, print string, base string, commands long")
    committed = spark.createDataFrame([("s", "a", "1"), ("t", "a", "1"), ("t", "b", "1"), ("u", "a", None)], "session string, path string, print string")
    assert rows(v.apply_accept(drafted, committed, "session", "path", "print")) == [("s", "a", "committed", "1", 3), ("t", "a", "snapshot_set_mismatch", "0", 0), ("u", "a", "fingerprint_mismatch", "0", 0)]


def test_mapping_falls_back_where_the_container_is_empty(spark):
    df = spark.createDataFrame([(1, [5], [6, 7]), (2, [], [6]), (3, None, None)], "id int, new array<int>, old array<int>")
    assert rows(v.mapping_projection(df, "id", "new", "old")) == [(1, "container", 0, 5), (2, "legacy", 0, 6)]


def test_events_keep_or_drop_the_sample(spark):
    kinds = ["catalog", "batch", "reset", "unavailable", "polling", "unavailable"]
    df = spark.createDataFrame([(1, i, k) for i, k in enumerate(kinds)], "feed int, seq int, kind string")
    found = v.observation_events(df, "feed", "seq", "kind").orderBy("seq").select("has_sample")
    assert [r[0] for r in found.collect()] == [False, True, True, True, False, False]


def test_codes_of_null_tests(spark):
    df = spark.createDataFrame([(1, None), (2, 0)], "id int, q int")
    assert rows(v.coded(df, "id", (F.col("q").isNull(), "failed"), (F.col("q") == 0, "partial"))) == [(1, "failed"), (2, "partial")]
