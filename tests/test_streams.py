"""Streams with typed state against their batch twins, over two triggers; runs that are whole or not there."""

import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tablewatch import sources, streaming
from tablewatch.operators import changes
from tablewatch.streaming import stateful


def two_triggers(spark, tmp_path, rows, make, order, mode="append"):
    """All that a stream tells, the second half of ``rows`` after a restart."""
    stateful.use_state_store(spark)
    rows.write.parquet(str(tmp_path / "all"))
    held = spark.read.parquet(str(tmp_path / "all"))
    middle = held.agg(F.expr(f"percentile_disc(0.5) within group (order by {order})")).first()[0]
    told = []
    for half in (F.col(order) <= middle, F.col(order) > middle):
        held.where(half).write.mode("append").parquet(str(tmp_path / "in"))
        stream = make(spark.readStream.schema(held.schema).parquet(str(tmp_path / "in")))
        query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: told.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None
    return told


def test_world_as_a_stream_and_a_batch(spark, tmp_path):
    rng, rows = random.Random(1), []
    for arrival in range(300):
        kind = rng.choices(["transforms", "catalog", "reset", "unavailable", "polling"], [40, 3, 2, 1, 1])[0]
        indices = [rng.randrange(-1 if rng.random() < 0.02 else 0, 9 if rng.random() < 0.1 else 8) for _ in range(rng.randint(0, 2))]
        rows.append((rng.randrange(4), arrival, kind, "s" if rng.random() < 0.95 else "t", 1, arrival // 9 + rng.randrange(3), 8, indices, rng.randrange(9), [(float(arrival), float(i), 0.5) for i in indices]))
    events = spark.createDataFrame(rows, streaming.WORLD)
    plain = {}
    for feed, _, kind, session, revision, seq, entries, indices, replacements, transforms in rows:
        machine, known = plain.setdefault(feed, (streaming.Feed(), {}))
        outcome, _ = machine.take(kind, session, revision, seq, entries, indices, replacements)
        if kind in ("catalog", "polling"):
            known.clear()
        elif kind == "transforms" and outcome == "accepted":
            known.update(zip(indices, transforms, strict=True))
    expected = {f: (m.status, *((m.rejected, m.gaps, m.replacements) if m.has else (None,) * 3), [(i, *t) for i, t in sorted(k.items())]) for f, (m, k) in plain.items()}
    state = lambda r: (r.status, r.rejected, r.gaps, r.replacements, [tuple(t) for t in r.transforms])
    assert {r.feed: state(r) for r in streaming.observed_world(events).collect()} == expected
    told = two_triggers(spark, tmp_path, events, stateful.world_stream, "arrival", "update")
    assert len(told) > len(expected)
    assert {r.feed: state(r) for r in sorted(told, key=lambda r: r.arrival)} == expected


def test_the_largest_packets_are_judged_in_time(spark):
    """16,384 indices, the most that the protocol allows: linear, and right about the first bad one."""
    n = 16_384
    base = spark.createDataFrame([(f, 0, "catalog", "s", 1, None, n, None) for f in range(3)], streaming.EVENT)
    indices = F.when(F.col("id") == 6, F.concat(F.sequence(F.lit(0), F.lit(n - 2)), F.array(F.lit(5)))).when(F.col("id") == 7, F.concat(F.sequence(F.lit(0), F.lit(n - 2)), F.array(F.lit(n)))).otherwise(F.shuffle(F.sequence(F.lit(0), F.lit(n - 1))))
    packets = spark.range(8).select(F.lit(1).cast("long").alias("feed"), (F.col("id") + 1).alias("arrival"), F.lit("transforms").alias("kind"), F.lit("s").alias("session"), F.lit(1).cast("long").alias("revision"), (F.col("id") + 1).alias("seq"), F.lit(None).cast("int").alias("entries"), indices.alias("indices"))
    found = [r.outcome for r in streaming.observation_state(base.unionByName(packets)).where("feed = 1").orderBy("arrival").collect()]
    assert found == ["accepted"] * 7 + ["duplicate_index", "out_of_range_index"]


def test_operations_as_a_stream(spark, tmp_path):
    rng = random.Random(2)
    rows = spark.createDataFrame([(f"s{i % 2}", i, rng.choice([*"abcde", None]), rng.choice("xy")) for i in range(120)], "server string, seq long, id string, digest string")
    told = two_triggers(spark, tmp_path, rows, lambda s: stateful.idempotent_stream(s, keep=3), "seq")
    assert {(r.server, r.seq): r.outcome for r in told} == {(r.server, r.seq): r.outcome for r in changes.idempotent(rows, "id", "seq", "digest", "server", keep=3).collect()}


def test_bounded_buffers_as_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, i, str(i)) for i in range(50)] + [(9, 1, None)], "key long, seq long, value string")
    told = two_triggers(spark, tmp_path, rows, lambda s: stateful.keep_latest_stream(s, 4), "seq", "update")
    last = {r.key: r for r in told}
    batch = {}
    for r in streaming.keep_latest(rows, "key", "seq", 4).collect():
        batch.setdefault(r.key, []).append((r.seq, r.value, r.dropped))
    assert {k: [(s, v, r.dropped) for s, v in zip(r.seqs, r["values"], strict=True)] for k, r in last.items()} == {k: sorted(v) for k, v in batch.items()}


def test_metrics_as_a_stream(spark, tmp_path):
    rng, seq, rows = random.Random(3), 0, []
    for i in range(80):
        seq += rng.choice([1, 1, 2, 5])
        rows.append((i % 3, seq, rng.randrange(5), rng.choice(["a", "b", None]), (i * 3) % 40))
    packets = spark.createDataFrame(rows, "feed long, seq long, records long, value string, counter long")
    told = two_triggers(spark, tmp_path, packets, stateful.metrics_stream, "seq", "update")
    batch = streaming.stream_metrics(packets, "feed", "seq", "records", "value", "counter").select(*packets.columns[:1], "packets", "bytes", "sampled", "changed", "replacements", "gaps")
    assert {r.feed: tuple(r) for r in told} == {r.feed: tuple(r) for r in batch.collect()}


def test_coalescing_as_a_stream(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i % 2, i // 20, rng.randrange(5), i, float(i), rng.random() < 0.05) for i in range(200)]
    end = [(f, 99, 0, 1000 + f, 0.0, False) for f in (0, 1)]  # begins a delivery, so that those before it are told
    events = spark.createDataFrame(rows + end, "feed long, delivery long, key long, seq long, value double, catalog boolean")
    told = two_triggers(spark, tmp_path, events, stateful.coalesce_stream, "seq")
    batch = streaming.coalesce_updates(events, "feed", "delivery", "key", "seq", "value", F.col("catalog")).where("delivery < 99")
    assert sorted(map(tuple, told)) == sorted(map(tuple, batch.select("feed", "delivery", "key", "value", "replaced").collect()))


def test_runs_are_whole_or_not_there(spark, tmp_path):
    path = str(tmp_path / "runs")
    good = spark.range(10)
    fails = good.withColumn("x", F.when(F.col("id") == 9, F.raise_error(F.lit("late"))).otherwise("fine"))
    sources.write_run(good, path, "first")
    with pytest.raises(PySparkException):
        sources.write_run(fails, path, "second")
    assert sorted(x for x in os.listdir(path) if not x.endswith(".crc")) == ["run_id=first"]
    sources.write_run(good.limit(3), path, "second")  # its id is free
    with pytest.raises(FileExistsError):
        sources.write_run(good, path, "second")
    left = str(tmp_path / "runs" / ".staging-third-0")
    good.write.parquet(left)  # a driver that died
    assert {r.run_id: r["count"] for r in sources.read_runs(spark, path).groupBy("run_id").count().collect()} == {"first": 10, "second": 3}
    assert sources.discard_staging(spark, path, "third") == 1 and not os.path.exists(left)


def test_files_are_listed_by_suffix_and_read_once(spark, tmp_path):
    doc = '{"schema_version": 7, "status": "ok", "assets": [{"path": "a", "kind": "DataTable"}]}'
    for i, name in enumerate(("a.json", "b.JSON", "c.txt")):
        (tmp_path / "in" / str(i)).mkdir(parents=True)
        (tmp_path / "in" / str(i) / name).write_text(doc)
    assert [r.path.rsplit("/", 1)[1] for r in sources.discover_files(spark, str(tmp_path / "in"), ".json").collect()] == ["a.json", "b.JSON"]
    told = []
    for n in (3, 4):
        if n == 4:
            (tmp_path / "in" / "0" / "d.json").write_text(doc)
        query = sources.watch_inspections(spark, str(tmp_path / "in" / "*")).writeStream.foreachBatch(lambda df, _: told.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert len(told) == n
