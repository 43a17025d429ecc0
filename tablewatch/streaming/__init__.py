"""Sequence-checked streams: the batch twin as windows, the stream as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.scans import met
from ..sources.staging import staged

PACKET = "feed long, arrival long, session string, revision long, seq long, records array<struct<index:int,x:double,y:double>>"
#: What is observed of a feed: catalogs (with entries), transforms, resets, unavailable and polling.
EVENT = "feed long, arrival long, kind string, session string, revision long, seq long, entries int, indices array<int>"
#: Events with what a batch says: its producer's count of replacements, and a transform for each index.
WORLD = EVENT + ", replacements long, transforms array<struct<x:double,y:double,z:double>>"
OUTCOME = "feed long, arrival long, outcome string, status string, gap boolean"


def read_packets(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Packets (JSON, ``PACKET``) as they arrive below ``path``; so many files at once, whatever has piled up."""
    return spark.readStream.schema(PACKET).option("maxFilesPerTrigger", files_per_trigger).json(path)


def packet_records(packets: DataFrame) -> DataFrame:
    """One row for each record of a packet, in batch or stream; a packet without records gives none."""
    rest = [c for c in packets.columns if c != "records"]
    return packets.select(*rest, F.explode("records").alias("_r")).select(*rest, "_r.*")


def _index_problem() -> Column:
    """What is wrong with a batch's indices, the first in order: beyond the catalog's entries, or twice in it. Linear but for a sort of those that repeat."""
    outside = F.array_position(F.transform("indices", lambda x: (x < 0) | (x >= F.col("_entries"))), F.lit(True))
    placed = F.array_sort(F.transform("indices", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    n = F.size("indices")
    again = F.array_min(F.zip_with(F.slice(placed, F.lit(1), n - 1), F.slice(placed, F.lit(2), n - 1), lambda a, b: F.when(a["x"] == b["x"], b["i"] + 1)))
    again = F.when(F.size(F.array_distinct("indices")) < n, again)
    return F.when((outside > 0) & (again.isNull() | (outside <= again)), "out_of_range_index").when(again.isNotNull(), "duplicate_index")


def observation_state(events: DataFrame) -> DataFrame:
    """``events`` (``EVENT``) with outcome, status after the event and gap, in order of arrival within each feed.

    A catalog makes a feed live, with its session, revision, number of entries and sequence 0. A reset makes it stale where there
    is a catalog, else unavailable; unavailable keeps the catalog for a later reset, polling drops it. A batch of transforms is
    taken whole or not at all: no_catalog unless live or stale, wrong_session, wrong_revision, regressing_sequence,
    duplicate_sequence (while live), out_of_range_index, duplicate_index, else accepted. gap: an accepted batch of a live
    feed leaves sequences out. One that is empty only advances the sequence.

    Batches that pass all but the sequence check are the only ones that can be accepted, and those among them that aren't are
    below the highest so far: so the highest of all of them is the last accepted, which makes each step a window.
    """
    feed = Window.partitionBy("feed").orderBy("arrival")
    upto, before = feed.rowsBetween(Window.unboundedPreceding, 0), feed.rowsBetween(Window.unboundedPreceding, -1)
    kind = F.col("kind")
    rows = events.withColumn("_epoch", F.count_if(kind == "catalog").over(upto)).withColumn("_part", F.count_if(kind != "transforms").over(upto))
    rows = rows.withColumn("_has", F.last(F.when(kind.isin("catalog", "polling"), kind == "catalog"), ignorenulls=True).over(upto))
    rows = rows.withColumn("_mode", F.last(F.when(kind != "transforms", kind), ignorenulls=True).over(upto))
    catalog = F.when(kind == "catalog", F.struct("session", "revision", "entries"))
    rows = rows.withColumn("_catalog", F.last(catalog, ignorenulls=True).over(upto)).withColumn("_entries", F.col("_catalog.entries"))
    has = F.coalesce(F.col("_has"), F.lit(False))
    begun = F.when(F.col("_mode") == "catalog", "live").when(F.col("_mode") == "polling", "polling_fallback").when(has & (F.col("_mode") == "reset"), "stale").when(F.col("_mode").isNull(), "connecting").otherwise("unavailable")
    rows = rows.withColumn("_begun", begun).withColumn("_problem", _index_problem())
    open_ = F.col("_begun").isin("live", "stale") & (kind == "transforms")
    valid = open_ & F.col("session").eqNullSafe(F.col("_catalog.session")) & F.col("revision").eqNullSafe(F.col("_catalog.revision")) & F.col("_problem").isNull()
    rows = rows.withColumn("_seq", F.when(valid, F.col("seq")))
    epoch = Window.partitionBy("feed", "_epoch").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    part = Window.partitionBy("feed", "_part").orderBy("arrival")
    rows = rows.withColumn("_last", F.greatest(F.lit(0).cast("long"), F.coalesce(F.max("_seq").over(epoch), F.lit(0))))
    # live again as soon as a batch since the reset has reached what was last before it
    rows = rows.withColumn("_floor", F.first("_last").over(part.rowsBetween(Window.unboundedPreceding, 0)))
    reached = lambda w: F.coalesce(F.max("_seq").over(w) >= F.col("_floor"), F.lit(False))
    rows = rows.withColumn("_live", (F.col("_begun") == "live") | reached(part.rowsBetween(Window.unboundedPreceding, -1)))
    outcome = (
        F.when(kind != "transforms", "accepted")
        .when(~F.col("_begun").isin("live", "stale"), "no_catalog")
        .when(~F.col("session").eqNullSafe(F.col("_catalog.session")), "wrong_session")
        .when(~F.col("revision").eqNullSafe(F.col("_catalog.revision")), "wrong_revision")
        .when(F.col("seq") < F.col("_last"), "regressing_sequence")
        .when((F.col("seq") == F.col("_last")) & F.col("_live"), "duplicate_sequence")
        .otherwise(F.coalesce("_problem", F.lit("accepted")))
    )
    rows = rows.withColumn("outcome", outcome)
    taken = (kind == "transforms") & (F.col("outcome") == "accepted")
    status = F.when((F.col("_begun") == "stale") & (F.col("_live") | taken), "live").otherwise(F.col("_begun"))
    gap = taken & F.col("_live") & (F.col("seq") > F.col("_last") + 1)
    return rows.select("feed", "arrival", "outcome", status.alias("status"), F.coalesce(gap, F.lit(False)).alias("gap"))


def _index_outcome(indices: np.ndarray, entries: int) -> str:
    """What the first bad index of a batch is, or accepted."""
    _, first = np.unique(indices, return_index=True)
    outside = np.flatnonzero((indices < 0) | (indices >= entries))
    again = np.setdiff1d(np.arange(len(indices)), first)
    bad = min(outside[0] if len(outside) else len(indices), again[0] if len(again) else len(indices))
    if bad == len(indices):
        return "accepted"
    return "out_of_range_index" if bad in outside else "duplicate_index"


class Feed:
    """What is known of a feed, event by event."""

    FIELDS = "status string, session string, revision long, entries int, last long, has boolean, rejected long, gaps long, replacements long"

    def __init__(self, status: str = "connecting", session: str | None = None, revision: int | None = None, entries: int = 0, last: int = 0, has: bool = False, rejected: int = 0, gaps: int = 0, replacements: int = 0):
        self.status, self.session, self.revision, self.entries, self.last, self.has = status, session, revision, entries, last, has
        self.rejected, self.gaps, self.replacements = rejected, gaps, replacements

    def state(self) -> tuple:
        return (self.status, self.session, self.revision, self.entries, self.last, self.has, self.rejected, self.gaps, self.replacements)

    def take(self, kind: str, session: str | None, revision: int | None, seq: int | None, entries: int | None, indices: list[int] | None, replacements: int | None = None) -> tuple[str, bool]:
        """The outcome of an event, and whether it left sequences out."""
        outcome, gap = "accepted", False
        if kind == "catalog":
            self.__init__("live", session, int(revision), int(entries), 0, True)  # pandas holds numbers next to nulls as floats
        elif kind == "reset":
            self.status = "stale" if self.has else "unavailable"
        elif kind == "unavailable":
            self.status = "unavailable"
        elif kind == "polling":
            self.status, self.has = "polling_fallback", False
        elif self.status not in ("live", "stale"):
            return "no_catalog", False
        else:
            if session != self.session:
                outcome = "wrong_session"
            elif revision != self.revision:
                outcome = "wrong_revision"
            elif seq < self.last:
                outcome = "regressing_sequence"
            elif seq == self.last and self.status == "live":
                outcome = "duplicate_sequence"
            else:
                outcome = _index_outcome(np.asarray([] if indices is None else indices), self.entries)
            if outcome == "accepted":
                gap, self.status, self.last = self.status == "live" and seq > self.last + 1, "live", int(seq)
                self.gaps += gap
                self.replacements = max(self.replacements, replacements or 0)
            else:
                self.rejected += 1
        return outcome, gap


def observe_stream(events: DataFrame) -> DataFrame:
    """The same over a stream: status, catalog and last sequence of each feed are its state; the events of a trigger are taken by arrival."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        feed, out = Feed(*state.get) if state.exists else Feed(), []
        rows = pd.concat(list(parts)).sort_values("arrival", kind="stable")
        for arrival, *event in zip(*[rows[c].tolist() for c in ("arrival", "kind", "session", "revision", "seq", "entries", "indices")], strict=True):
            outcome, gap = feed.take(*event)
            out.append((key[0], arrival, outcome, feed.status, gap))
        state.update(feed.state())
        yield pd.DataFrame(out, columns=["feed", "arrival", "outcome", "status", "gap"])

    return events.groupBy("feed").applyInPandasWithState(step, OUTCOME, Feed.FIELDS, "append", GroupStateTimeout.NoTimeout)


def observed_world(events: DataFrame) -> DataFrame:
    """``events`` (``WORLD``) to what is known of each feed in the end: (feed, status, rejected, gaps, replacements, transforms).

    The numbers count since the last catalog: batches rejected while there was one, gaps, and the most replacements that an accepted
    batch told. transforms: the last that an accepted batch gave of each index since then, in order; at most as many as the catalog has
    entries. A feed that has no catalog (any more) has none, and null for numbers.
    """
    told = observation_state(events.drop("replacements", "transforms"))
    both = events.select("feed", "arrival", "kind", "indices", "replacements", "transforms").join(told, ["feed", "arrival"])
    turn = F.when(F.col("kind").isin("catalog", "polling"), F.struct("arrival", "kind"))
    ends = staged(both.groupBy("feed").agg(F.max_by("status", "arrival").alias("status"), F.max(turn).alias("turn")), "feeds")
    begun = ends.where("turn.kind = 'catalog'").select("feed", F.col("turn.arrival").alias("since"))
    since = met(both.drop("status"), begun, ["feed"], "arrival").where("arrival > since and kind = 'transforms' and outcome <> 'no_catalog'")
    taken = F.col("outcome") == "accepted"
    numbers = since.groupBy("feed").agg(F.count_if(~taken).alias("rejected"), F.count_if("gap").alias("gaps"), F.max(F.when(taken, F.greatest(F.lit(0), F.col("replacements")))).alias("replacements"))
    numbers = begun.join(numbers, "feed", "left").select("feed", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("rejected", "gaps", "replacements")])
    each = since.where(taken).select("feed", "arrival", F.explode(F.arrays_zip("indices", "transforms")).alias("t"))
    last = each.groupBy("feed", F.col("t.indices").alias("index")).agg(F.max_by("t.transforms", "arrival").alias("t"))
    lists = last.groupBy("feed").agg(F.array_sort(F.collect_list(F.struct("index", "t.x", "t.y", "t.z"))).alias("transforms"))
    found = ends.drop("turn").join(numbers, "feed", "left").join(lists, "feed", "left")
    return found.withColumn("transforms", F.coalesce("transforms", F.expr(f"cast(array() as {dict(lists.dtypes)['transforms']})")))


def packet_validation(packets: DataFrame, maximum_records: int = 16_384) -> DataFrame:
    """``packets(version, n_records, n_bytes, value)`` with the reason why one is malformed, or null."""
    value = F.col("value")
    return packets.withColumn(
        "malformed",
        F.when(F.col("version") != 1, "version")
        .when((F.col("n_records") < 0) | (F.col("n_records") > maximum_records), "record_count")
        .when(F.col("n_bytes") != F.col("n_records") * 48, "length")
        .when(value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), "not_finite"),
    )


def latest_state(events: DataFrame, key: str, seq: str, *values: str) -> DataFrame:
    """The last values of each key; works on streams in update mode too."""
    return events.groupBy(key).agg(F.max_by(F.struct(seq, *values), seq).alias("last")).select(key, "last.*")


def coalesce_updates(events: DataFrame, feed: str, delivery: str, key: str, seq: str, value: str, catalog: Column | None = None) -> DataFrame:
    """Of each delivery of a feed only the last value of each key, and how many it replaces.

    Where ``catalog`` holds, a new catalog came: what was pending before it in its delivery is discarded, it is no update itself.
    """
    if catalog is not None:
        told = events.withColumn("_catalog", F.coalesce(catalog, F.lit(False)))
        latest = told.where("_catalog").groupBy(feed, delivery).agg(F.max(seq).alias("_latest"))
        events = told.where("not _catalog").join(latest, [feed, delivery], "left").where(F.col("_latest").isNull() | (F.col(seq) > F.col("_latest"))).drop("_catalog", "_latest")
    return events.groupBy(feed, delivery, key).agg(F.max_by(value, seq).alias(value), (F.count("*") - 1).alias("replaced"))


def keep_latest(events: DataFrame, key: str, seq: str, n: int) -> DataFrame:
    """A bounded buffer for each key: its last ``n``, and how many were dropped for them."""
    w = Window.partitionBy(key).orderBy(F.desc(seq))
    total = F.count("*").over(Window.partitionBy(key))
    return events.select("*", F.row_number().over(w).alias("_n"), F.greatest(total - n, F.lit(0)).alias("dropped")).where(F.col("_n") <= n).drop("_n")


def consecutive_rejects(events: DataFrame, key: str, seq: str, rejected: str, limit: int = 64) -> DataFrame:
    """(key, longest, tripped_at): the longest run of rejects without an accept between, and where one first reached ``limit``."""
    w = Window.partitionBy(key).orderBy(seq)
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy(key, rejected).orderBy(seq))
    runs = events.select(key, seq, rejected, island.alias("island")).where(F.col(rejected))
    run = runs.withColumn("n", F.row_number().over(Window.partitionBy(key, "island").orderBy(seq)))
    found = run.groupBy(key).agg(F.max("n").alias("longest"), F.min(F.when(F.col("n") == limit, F.col(seq))).alias("tripped_at"))
    return events.select(key).distinct().join(found, key, "left").select(key, F.coalesce("longest", F.lit(0)).alias("longest"), "tripped_at")


def trip_stream(events: DataFrame, limit: int = 64) -> DataFrame:
    """``events(feed, arrival, rejected)`` as a stream to (feed, arrival) of each reject that makes a run of ``limit``; an accept starts anew."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, out = state.get[0] if state.exists else 0, []
        rows = pd.concat(list(parts)).sort_values("arrival", kind="stable")
        for arrival, rejected in zip(rows["arrival"].tolist(), rows["rejected"].tolist(), strict=True):
            n = n + 1 if rejected else 0
            if n == limit:
                out.append((key[0], arrival))
        state.update((n,))
        yield pd.DataFrame(out, columns=["feed", "arrival"])

    return events.groupBy("feed").applyInPandasWithState(step, "feed long, arrival long", "n long", "append", GroupStateTimeout.NoTimeout)


def stream_metrics(packets: DataFrame, key: str, seq: str, records: str, value: str, counter: str) -> DataFrame:
    """Of each feed: packets, bytes (96, and 48 a record), records sampled, packets whose ``value`` changed, growth of a
    ``counter`` that may restart, and sequences left out."""
    feed = Window.partitionBy(key).orderBy(seq)
    before = F.max(counter).over(feed.rowsBetween(Window.unboundedPreceding, -1))
    rows = packets.select(
        key,
        F.col(records).alias("_n"),
        F.greatest(F.lit(0), F.col(counter) - F.coalesce(before, F.lit(0))).alias("_grown"),
        (F.row_number().over(feed) == 1) | ~F.lag(value).over(feed).eqNullSafe(F.col(value)),
        F.greatest(F.lit(0), F.coalesce(F.col(seq) - F.lag(seq).over(feed) - 1, F.lit(0))).alias("_gap"),
    ).toDF(key, "_n", "_grown", "_changed", "_gap")
    return rows.groupBy(key).agg(F.count("*").alias("packets"), F.sum(96 + 48 * F.col("_n")).alias("bytes"), F.sum("_n").alias("sampled"), F.count_if("_changed").alias("changed"), F.sum("_grown").alias("replacements"), F.sum("_gap").alias("gaps"))
