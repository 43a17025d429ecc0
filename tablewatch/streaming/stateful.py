"""Streams whose state is typed values, lists and maps of a key, each the twin of a batch operator.

They need the RocksDB state store (``use_state_store``). Rows of a trigger are taken in order within their key; what a key keeps is
bounded by its operator: a catalog's entries, the last n, the keys of one delivery. A state that is not touched for ``expiry`` goes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.changes import Results
from . import Feed

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SNAPSHOT = "feed long, arrival long, status string, rejected long, gaps long, replacements long, transforms array<struct<index:int,x:double,y:double,z:double>>"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def _ms(expiry: timedelta | None) -> int | None:
    return int(expiry.total_seconds() * 1000) if expiry else None


def _mode(expiry: timedelta | None) -> str:
    return "ProcessingTime" if expiry else "None"


class World(StatefulProcessor):
    """A feed's machine as a value, the last transform of each entity as a map that expires entity by entity."""

    def __init__(self, expiry: timedelta | None):
        self.expiry = _ms(expiry)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.feed = handle.getValueState("feed", Feed.FIELDS)
        self.transforms = handle.getMapState("transforms", "index int", "x double, y double, z double", self.expiry)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timer_values: Any) -> Iterator[Row]:
        feed, changed, arrival = Feed(*self.feed.get()) if self.feed.exists() else Feed(), {}, None
        for r in sorted(rows, key=lambda r: r.arrival):
            outcome, _ = feed.take(r.kind, r.session, r.revision, r.seq, r.entries, r.indices, r.replacements)
            arrival = r.arrival
            if r.kind in ("catalog", "polling"):  # what was known is of another catalog
                changed = {}
                self.transforms.clear()
            elif r.kind == "transforms" and outcome == "accepted":
                changed.update(zip(r.indices or [], r.transforms or [], strict=True))
        for index, t in changed.items():
            self.transforms.updateValue((index,), (t["x"], t["y"], t["z"]))
        self.feed.update(feed.state())
        known = sorted((k[0], *v) for k, v in self.transforms.iterator()) if self.transforms.exists() else []
        numbers = (feed.rejected, feed.gaps, feed.replacements) if feed.has else (None, None, None)
        yield Row(feed=key[0], arrival=arrival, status=feed.status, rejected=numbers[0], gaps=numbers[1], replacements=numbers[2], transforms=[{"index": i, "x": x, "y": y, "z": z} for i, x, y, z in known])

    def close(self) -> None:
        pass


def world_stream(events: DataFrame, expiry: timedelta | None = None) -> DataFrame:
    """``events`` (``WORLD``) as a stream to ``SNAPSHOT``: after each trigger, what is known of every feed that it touched.

    The last snapshot of a feed is what ``observed_world`` finds. With ``expiry``, entities not heard of for so long are forgotten.
    """
    return events.groupBy("feed").transformWithState(World(expiry), SNAPSHOT, "Update", _mode(expiry))


class Fold(StatefulProcessor):
    """One value for each key: ``step(state, row)`` gives the next state and rows to tell, ``told(key, state)`` those to tell after a trigger."""

    def __init__(self, fields: str, order: str, start: tuple, step: Callable[[tuple, Row], tuple[tuple, list[Row]]], told: Callable[[Any, tuple], list[Row]] | None, expiry: timedelta | None):
        self.fields, self.order, self.start, self.step, self.told, self.expiry = fields, order, start, step, told, _ms(expiry)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", self.fields, self.expiry)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timer_values: Any) -> Iterator[Row]:
        state = tuple(self.value.get()) if self.value.exists() else self.start
        for r in sorted(rows, key=lambda r: r[self.order]):
            state, out = self.step(state, r)
            yield from out
        self.value.update(state)
        if self.told:
            yield from self.told(key, state)

    def close(self) -> None:
        pass


def idempotent_stream(operations: DataFrame, keep: int = 128, expiry: timedelta | None = None) -> DataFrame:
    """``operations(server, seq, id, digest)`` as a stream to (server, seq, outcome), each told once; see ``idempotent``."""

    def step(state: tuple, r: Row) -> tuple[tuple, list[Row]]:
        results = Results(keep, zip(*state, strict=True))
        outcome = results.outcome(r.id, r.digest)
        return (list(results.held), list(results.held.values())), [Row(server=r.server, seq=r.seq, outcome=outcome)]

    fold = Fold("ids array<string>, digests array<string>", "seq", ([], []), step, None, expiry)
    return operations.groupBy("server").transformWithState(fold, "server string, seq long, outcome string", "Append", _mode(expiry))


def keep_latest_stream(events: DataFrame, n: int, expiry: timedelta | None = None) -> DataFrame:
    """``events(key, seq, value)`` as a stream to (key, seqs, values, dropped): after each trigger the last ``n`` of every key it touched, and how many were dropped; see ``keep_latest``.

    Rows may arrive late: a seq below those kept counts as dropped.
    """

    def step(state: tuple, r: Row) -> tuple[tuple, list[Row]]:
        seqs, values, dropped = state
        held = sorted([*zip(seqs, values, strict=True), (r.seq, r.value)], key=lambda x: x[0])
        dropped += max(0, len(held) - n)
        held = held[-n:]
        return ([s for s, _ in held], [v for _, v in held], dropped), []

    def told(key: Any, state: tuple) -> list[Row]:
        return [Row(key=key[0], seqs=list(state[0]), values=list(state[1]), dropped=state[2])]

    fold = Fold("seqs array<long>, values array<string>, dropped long", "seq", ([], [], 0), step, told, expiry)
    return events.groupBy("key").transformWithState(fold, "key long, seqs array<long>, values array<string>, dropped long", "Update", _mode(expiry))


def metrics_stream(packets: DataFrame, expiry: timedelta | None = None) -> DataFrame:
    """``packets(feed, seq, records, value, counter)`` as a stream to the running totals of ``stream_metrics``, after each trigger."""
    names = ["packets", "bytes", "sampled", "changed", "replacements", "gaps"]

    def step(state: tuple, r: Row) -> tuple[tuple, list[Row]]:
        packets_, size, sampled, changed, grown, gaps, seq, value, counter = state
        first = packets_ == 0
        changed += first or value != r.value
        grown += max(0, r.counter - (counter or 0))
        gaps += 0 if first else max(0, r.seq - seq - 1)
        return (packets_ + 1, size + 96 + 48 * r.records, sampled + r.records, changed, grown, gaps, r.seq, r.value, r.counter if counter is None else max(counter, r.counter)), []

    def told(key: Any, state: tuple) -> list[Row]:
        return [Row(feed=key[0], **dict(zip(names, state[:6], strict=True)))]

    fold = Fold(", ".join([*(f"{n} long" for n in names), "seq long, value string, counter long"]), "seq", (0, 0, 0, 0, 0, 0, None, None, None), step, told, expiry)
    return packets.groupBy("feed").transformWithState(fold, "feed long, " + ", ".join(f"{n} long" for n in names), "Update", _mode(expiry))


class Pending(StatefulProcessor):
    """The updates of a feed's delivery that is under way, by key; told when the next one begins."""

    def __init__(self, expiry: timedelta | None):
        self.expiry = _ms(expiry)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.delivery = handle.getValueState("delivery", "delivery long", self.expiry)
        self.values = handle.getMapState("values", "key long", "value double, replaced long", self.expiry)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timer_values: Any) -> Iterator[Row]:
        at = self.delivery.get()[0] if self.delivery.exists() else None
        held = {k[0]: tuple(v) for k, v in self.values.iterator()} if self.values.exists() else {}
        for r in sorted(rows, key=lambda r: r.seq):
            if r.delivery != at:
                for k, (value, replaced) in held.items():
                    yield Row(feed=key[0], delivery=at, key=k, value=value, replaced=replaced)
                at, held = r.delivery, {}
            if r.catalog:  # what was pending is of another catalog
                held = {}
            else:
                held[r.key] = (r.value, held[r.key][1] + 1 if r.key in held else 0)
        self.delivery.update((at,))
        self.values.clear()
        for k, v in held.items():
            self.values.updateValue((k,), v)

    def close(self) -> None:
        pass


def coalesce_stream(events: DataFrame, expiry: timedelta | None = None) -> DataFrame:
    """``events(feed, delivery, key, seq, value, catalog)`` as a stream to (feed, delivery, key, value, replaced); see ``coalesce_updates``.

    A delivery is told, with only the last value of each key, as soon as the feed's next one begins; deliveries follow one another in order of seq.
    """
    return events.withColumn("catalog", F.coalesce("catalog", F.lit(False))).groupBy("feed").transformWithState(Pending(expiry), "feed long, delivery long, key long, value double, replaced long", "Append", _mode(expiry))
