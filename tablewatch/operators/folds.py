"""Tables after a log of commands on their cells and rows, folded in parallel within a table too.

A fold stops at the first command that does not fit; all before it did. So each check may take for granted that what came before was done, and
the least number that fails any check is where the fold stops. That lets every check look at its own part of the log:

- whether a row is there, and under which name: the commands on that row;
- whether a name is free: those that gave or freed that name (counted, for a base may hold a name several times);
- whether a cell still has its old value: those on that cell, and those that put its row there or took it away;
- whether a place is right: an order-statistics fold. Adding and removing at places turns one list into another, and is told by
  ranges of the list before and rows born since. Such *pieces* compose, whatever rows they are applied to, so a log is cut into runs that
  become pieces in any task, and neighbours are composed until one is left for a table. A removal that finds a row of the list before
  its run is a *claim* on that place; composing carries it back until it meets a birth, or the base. A reorder starts anew
  from the list that it says, once the list before it is found to be the one it recorded.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.staging import staged
from .review import apply_transaction
from .scans import apart, few, met, scan

#: Commands of a run, runs that are composed at once, and rows of a range that meet their pieces.
RUN, COMPOSED, RANGE = 512, 8, 256

COMMANDS = {
    "seq": "long", "kind": "string", "row_id": "string", "row_name": "string", "old_name": "string", "at_index": "long", "field": "string", "old_value": "string",
    "new_value": "string", "fields": "map<string,string>", "old_order": "array<string>", "new_order": "array<string>",
}
_TABLE, _LIST = ["table_path"], ["table_path", "epoch"]
_PIECES = "table_path string, epoch long, node long, failed long, starts array<long>, sizes array<long>, births array<long>, names array<string>, claim_seqs array<long>, claim_places array<long>, claim_rows array<string>"
_PIECE_NAMES = [x.split()[0] for x in _PIECES.split(", ")]


class Pieces:
    """How a list comes from another: [start, size, birth, row], where birth is the number of the command that made the row, or -1 for a range of the list before.

    ``failed``: the first command that could not be done; ``claims``: (seq, place in the list before, row that must stand there).
    """

    def __init__(self, failed: int | None, parts: list[list], claims: list[tuple[int, int, str]]):
        self.failed, self.parts, self.claims = failed, parts, claims

    @classmethod
    def of_run(cls, size: int, commands: Iterable[tuple[int, str, str, int]]) -> Pieces:
        """The pieces of (seq, kind, row, place), in order, on a list of ``size``."""
        out = cls(None, [[0, size, -1, None]] if size > 0 else [], [])
        for seq, kind, row, place in commands:
            if place is None or not 0 <= place < size + (kind == "add"):
                out.failed = seq
                break
            i, left = 0, place
            while i < len(out.parts) and left >= out.parts[i][1]:
                left -= out.parts[i][1]
                i += 1
            if kind == "add":
                if left:
                    out._split(i, left)
                    i += 1
                out.parts.insert(i, [0, 1, seq, row])
                size += 1
                continue
            start, _, birth, held = out.parts[i]
            if birth < 0:
                out.claims.append((seq, start + left, row))
            elif held != row:
                out.failed = seq
                break
            if left:
                out._split(i, left)
                i += 1
            if out.parts[i][1] > 1:
                out._split(i, 1)
            del out.parts[i]
            size -= 1
        return out

    def _split(self, i: int, at: int) -> None:
        start, size, birth, row = self.parts[i]
        self.parts[i : i + 1] = [[start, at, birth, row], [start + at, size - at, birth, row]]

    def then(self, later: Pieces) -> Pieces:
        """Both, one after the other; what comes after a failure doesn't count."""
        if self.failed is not None:
            return self
        ends = list(accumulate(p[1] for p in self.parts))
        failed, claims, parts = later.failed, list(self.claims), []
        for seq, place, row in later.claims:
            i = bisect_right(ends, place)
            start, size, birth, held = self.parts[i]
            if birth < 0:
                claims.append((seq, start + place - (ends[i] - size), row))
            elif held != row:
                failed = seq if failed is None else min(failed, seq)
        for start, size, birth, row in later.parts if failed is None else []:
            if birth >= 0:
                parts.append([start, size, birth, row])
                continue
            i, at, left = bisect_right(ends, start), start, size
            while left:
                s, n, b, r = self.parts[i]
                inside = at - (ends[i] - n)
                m = min(left, n - inside)
                parts.append([s + inside, m, b, r])
                i, at, left = i + 1, at + m, left - m
        return Pieces(failed, parts, claims)

    def row(self) -> tuple:
        return (self.failed, *([p[k] for p in self.parts] for k in range(4)), *([c[k] for c in self.claims] for k in range(3)))

    @classmethod
    def of_row(cls, row: dict) -> Pieces:
        return cls(row["failed"], [list(p) for p in zip(row["starts"], row["sizes"], row["births"], row["names"], strict=True)], list(zip(row["claim_seqs"], row["claim_places"], row["claim_rows"], strict=True)))


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows that come in order, by key."""
    rows = (row for batch in batches for row in batch.to_pylist())
    return groupby(rows, key=lambda r: tuple(r[k] for k in keys))


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), *[pa.int64()] * 3, *[pa.list_(pa.int64())] * 3, pa.list_(pa.string()), *[pa.list_(pa.int64())] * 2, pa.list_(pa.string())]
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[4]) + len(row[8]) + 1
        if size > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], _PIECE_NAMES)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], _PIECE_NAMES)


def _composed(shifts: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pieces of each list: ``shifts(table_path, epoch, seq, kind, row_id, at_index)`` on ``sizes(table_path, epoch, size)``."""
    numbered = scan(shifts, _LIST, ["seq"], sums={"n": F.lit(1).cast("long")}).withColumn("node", F.floor((F.col("n") - 1) / RUN)).drop("n")
    change = F.sum(F.when(F.col("kind") == "add", 1).otherwise(-1)).alias("change")
    runs = numbered.groupBy(*_LIST, "node").agg(change).join(apart(sizes), _LIST)
    before = F.sum("change").over(Window.partitionBy(*_LIST).orderBy("node").rowsBetween(Window.unboundedPreceding, -1))  # a row for each run
    runs = runs.select(*_LIST, "node", (F.col("size") + F.coalesce(before, F.lit(0))).alias("size"))
    keys = [*_LIST, "node"]
    ready = numbered.join(apart(runs), keys).repartition(*keys).sortWithinPartitions(*keys, "seq")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for key, rows in _grouped(batches, keys):
                first = next(rows)
                each = ((r["seq"], r["kind"], r["row_id"], r["at_index"]) for r in (first, *rows))
                yield (*key, *Pieces.of_run(first["size"], each).row())

        yield from _batches(made())

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for key, rows in _grouped(batches, [*_LIST, "above"]):
                whole = Pieces.of_row(next(rows))
                for row in rows:
                    whole = whole.then(Pieces.of_row(row))
                yield (*key, *whole.row())

        yield from _batches(made())

    level = staged(ready.mapInArrow(build, _PIECES), "runs")
    most = level.agg(F.max("node")).first()[0]
    while most:  # a level of the tree for each factor of COMPOSED
        above = level.withColumn("above", F.floor(F.col("node") / COMPOSED)).repartition(*_LIST, "above").sortWithinPartitions(*_LIST, "above", "node")
        level, most = staged(above.mapInArrow(compose, _PIECES), "composed"), most // COMPOSED
    return level.drop("node")


def _placed(lists: DataFrame, pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``lists`` with _left, the place that a row has after ``pieces``, and _claim, a removal that expected another row there; (table_path, epoch,
    row_index, row_id) of rows born). Lists without pieces are as they were; claims on places without a row have no row_id."""
    each = pieces.select(*_LIST, F.posexplode(F.arrays_zip("starts", "sizes", "births", "names")).alias("k", "p"))
    each = scan(each.select(*_LIST, "k", "p.*"), _LIST, ["k"], sums={"end": F.col("sizes")}).withColumn("begin", F.col("end") - F.col("sizes"))
    born = each.where("births >= 0").select(*_LIST, F.col("begin").alias("row_index"), F.col("names").alias("row_id"))
    # pieces and rows meet by ranges of places, so that a long list is spread; a place that was claimed is in no piece that is left
    none = F.lit(None)
    old = each.where("births < 0").select(*_LIST, F.explode(F.sequence(F.floor(F.col("starts") / RANGE), F.floor((F.col("starts") + F.col("sizes") - 1) / RANGE))).alias("range"), "starts", "sizes", "begin", none.cast("long").alias("seq"), none.cast("string").alias("claimed"))
    claims = pieces.select(*_LIST, F.explode(F.arrays_zip("claim_seqs", "claim_places", "claim_rows")).alias("c"))
    claims = claims.select(*_LIST, F.floor(F.col("c.claim_places") / RANGE).alias("range"), F.col("c.claim_places").alias("starts"), F.lit(1).cast("long").alias("sizes"), none.cast("long").alias("begin"), F.col("c.claim_seqs").alias("seq"), F.col("c.claim_rows").alias("claimed"))
    sides = old.unionByName(claims).withColumnsRenamed({"table_path": "_t", "epoch": "_e", "range": "_r"})
    still = None
    if few(pieces):  # lists without pieces stay where they are
        having = F.broadcast(pieces.select(*_LIST))
        lists, still = lists.join(having, _LIST, "left_semi"), lists.join(having, _LIST, "left_anti")
    rows = lists.withColumn("range", F.floor(F.col("row_index") / RANGE))
    inside = (F.col("table_path") == F.col("_t")) & (F.col("epoch") == F.col("_e")) & (F.col("range") == F.col("_r")) & (F.col("row_index") >= F.col("starts")) & (F.col("row_index") < F.col("starts") + F.col("sizes"))
    left = F.when(F.col("starts").isNull(), F.col("row_index")).otherwise(F.col("begin") + F.col("row_index") - F.col("starts"))
    claim = F.when(~F.col("row_id").eqNullSafe(F.col("claimed")), F.col("seq"))
    rest = [c for c in lists.columns if c not in _LIST]
    told = rows.join(apart(sides), inside, "full").where("row_index is not null or seq is not null")
    told = told.select(F.coalesce("table_path", "_t").alias("table_path"), F.coalesce("epoch", "_e").alias("epoch"), *rest, left.alias("_left"), claim.alias("_claim"))
    return told if still is None else told.unionByName(still.withColumns({"_left": F.col("row_index"), "_claim": F.lit(None).cast("long")})), born


def _order_problems(rows: DataFrame, log: DataFrame) -> tuple[DataFrame | None, DataFrame, DataFrame | None, DataFrame | None]:
    """((table_path, seq) of commands at wrong places, ``rows`` with _left, their place if they kept one, (table_path, _left, row_id) of rows born
    since, and of the rows of lists that a reorder began). What no command can have made is None."""
    moves = log.where("kind in ('add', 'remove', 'reorder')")
    if moves.isEmpty():
        return None, rows.withColumn("_left", F.col("row_index")), None, None
    turn = F.when(F.col("kind") == "reorder", 1).otherwise(0).cast("long")
    moves = staged(scan(moves.select("table_path", "seq", "kind", "row_id", "at_index", "old_order", "new_order"), _TABLE, ["seq"], sums={"epoch": turn}), "moves")
    turns = moves.where("kind = 'reorder'")
    listed = lambda c: turns.select("table_path", "epoch", "seq", F.posexplode(c).alias("row_index", "row_id")).withColumn("row_index", F.col("row_index").cast("long"))
    turned = not turns.isEmpty()
    lists = rows.withColumn("epoch", F.lit(0).cast("long"))
    if turned:
        lists = lists.unionByName(listed("new_order").drop("seq"), allowMissingColumns=True)
    shifts = moves.where("kind <> 'reorder'").drop("old_order", "new_order")
    lengths = lists.groupBy(*_LIST).agg(F.count("*").alias("size"))
    sizes = shifts.select(*_LIST).distinct().join(apart(lengths), _LIST, "left").na.fill(0, ["size"])
    pieces = staged(_composed(shifts, sizes), "pieces")
    bad = pieces.where("failed is not null").select("table_path", F.col("failed").alias("seq"))

    told, born = _placed(lists, pieces)
    result = staged(told, "lists")
    bad = bad.union(result.where("_claim is not null").select("table_path", F.col("_claim").alias("seq")))
    result = result.where("row_index is not null").drop("_claim")
    base = result.where("epoch = 0").select(*rows.columns, "_left")
    born = born.withColumnRenamed("row_index", "_left")
    if not turned:
        return bad, base, born.drop("epoch"), None

    # what a reorder recorded must be the list that it meets, and hold the ids that it leaves
    born = staged(born, "born")
    ended = result.where("_left is not null").select(*_LIST, "_left", "row_id").unionByName(born)
    found = ended.select("table_path", (F.col("epoch") + 1).alias("epoch"), F.col("_left").alias("row_index"), "row_id", F.lit(1).alias("found"))
    if few(turns):
        found = found.join(F.broadcast(turns.select(*_LIST)), _LIST, "left_semi")
    said = listed("old_order").drop("seq").withColumn("said", F.lit(1))
    moved = found.join(apart(said), [*_LIST, "row_index", "row_id"], "full").where("found is null or said is null").select(*_LIST)
    count = lambda c, n: listed(c).select(*_LIST, "row_id", F.lit(n).alias("n"))
    other = count("old_order", 1).union(count("new_order", -1)).groupBy(*_LIST, "row_id").agg(F.sum("n").alias("n")).where("n <> 0").select(*_LIST)
    unsaid = turns.where("old_order is null or new_order is null").select(*_LIST)
    bad = bad.union(turns.join(apart(moved.union(other).union(unsaid).distinct()), _LIST).select("table_path", "seq"))
    # the list after the last reorder
    final = staged(turns.groupBy("table_path").agg(F.max("epoch").alias("_last")), "last-turns")
    base = met(base, final, _TABLE, "row_id", "left").withColumn("_left", F.when(F.col("_last").isNull(), F.col("_left"))).drop("_last")
    early = met(born.where("epoch = 0"), final, _TABLE, "row_id", "left_anti").drop("epoch")
    begun = met(ended, final, _TABLE, "row_id").where("epoch = _last").select("table_path", "_left", "row_id")
    return bad, base, early, begun


def _row_problems(rows: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((table_path, seq) of commands on rows that are not there, or are, or go by another name, and on cells that are not there, or have another
    value than the recorded one; names as they come and go). ``rows``: those that a command names."""
    row, kind, seq = ["table_path", "row_id"], F.col("kind"), F.col("seq")
    base = rows.select(*row, F.lit(None).cast("long").alias("seq"), F.lit("base").alias("kind"), "row_name", "fields")
    on_rows = log.where("kind <> 'reorder'").select(*row, "seq", "kind", "row_name", "fields", "old_name", "field", "old_value", "new_value")
    told = base.unionByName(on_rows, allowMissingColumns=True).repartition(*row)
    # all windows are over parts of a row's commands, so that these are dealt once
    sets = kind == "set_cell"
    of_cell = Window.partitionBy(*row, F.when(sets, F.col("field"))).orderBy(F.asc_nulls_first("seq"))
    told = told.withColumn("set", F.lag(F.when(sets, F.struct("seq", "new_value"))).over(of_cell))
    w = Window.partitionBy(*row).orderBy(F.asc_nulls_first("seq"))
    last = lambda kinds, value: F.last(F.when(kind.isin(*kinds), value), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    named = last(["base", "add", "rename"], F.struct("row_name"))
    state = last(["base", "add", "remove"], F.struct("seq", F.when(kind != "remove", F.col("fields")).alias("fields")))
    told = told.withColumns({"there": F.coalesce(F.lag(kind != "remove").over(w), F.lit(False)), "was": named["row_name"], "state": state}).where("seq is not null")
    since = F.col("set").isNotNull() & (F.col("state.seq").isNull() | (F.col("set.seq") > F.col("state.seq")))
    held = since | F.coalesce(F.map_contains_key("state.fields", F.col("field")), F.lit(False))
    value = F.when(since, F.col("set.new_value")).otherwise(F.try_element_at("state.fields", F.col("field")))
    wrong = F.when(kind == "add", F.col("there")).when(kind == "rename", ~F.col("there") | ~F.col("was").eqNullSafe(F.col("old_name"))).when(kind == "remove", ~F.col("there"))
    wrong = wrong.when(sets, ~F.col("there") | ~held | ~value.eqNullSafe(F.col("old_value"))).otherwise(True)
    told = told.select("table_path", "seq", "kind", "row_name", "was", wrong.alias("wrong")).where("wrong or kind in ('add', 'remove', 'rename')")
    told = staged(told, "on-rows")
    gives = told.where("kind in ('add', 'rename')").select("table_path", F.col("row_name").alias("name"), "seq", F.lit(1).alias("change"))
    frees = told.where("kind in ('remove', 'rename')").select("table_path", F.col("was").alias("name"), "seq", F.lit(-1).alias("change"))
    return told.where("wrong").select("table_path", "seq"), gives.union(frees)


def _name_problems(rows: DataFrame, changes: DataFrame) -> DataFrame | None:
    """(table_path, seq) of commands that give a name which a row has."""
    gives = changes.where("change > 0")
    if gives.isEmpty():
        return None
    asked = gives.select(F.col("table_path").alias("_t"), F.col("name").alias("_n")).distinct()
    same = F.col("table_path").eqNullSafe(F.col("_t")) & F.col("name").eqNullSafe(F.col("_n"))
    base = rows.groupBy("table_path", F.col("row_name").alias("name")).agg(F.count("*").cast("int").alias("change")).withColumn("seq", F.lit(None).cast("long"))
    events = base.select("table_path", "name", "seq", "change").unionByName(changes).join(apart(asked), same, "left_semi")
    # a command that frees the name it gives still meets it
    w = Window.partitionBy("table_path", "name").orderBy(F.asc_nulls_first("seq"), F.desc("change")).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("held", F.coalesce(F.sum("change").over(w), F.lit(0))).where("seq is not null and change > 0 and held > 0").select("table_path", "seq")


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)


def _commands(commands: DataFrame, own: list[str]) -> DataFrame:
    return commands.select("table_path", *[_column(commands, c, k) for c, k in COMMANDS.items()], *own)


def _said(log: DataFrame, own: list[str]) -> DataFrame:
    """What the log says of a row: the fields it was last added with, its last name, and the cells set since."""
    row, kind = ["table_path", "row_id"], F.col("kind")
    adds = F.when(kind == "add", F.col("seq"))
    named = log.where("kind not in ('set_cell', 'reorder')").groupBy(*row).agg(F.max(adds).alias("_since"), F.max_by("fields", adds).alias("_added"), F.max_by(F.struct("row_name"), F.when(kind.isin("add", "rename"), F.col("seq"))).alias("_named"), *[F.first(c).alias(f"_own_{c}") for c in own])
    # a row's cells are brought together once, as many as it has fields
    sets = log.where("kind = 'set_cell'").select(*row, "field", "seq", "new_value").repartition(*row)
    cells = sets.groupBy(*row, "field").agg(F.max("seq").alias("at"), F.max_by(F.struct("new_value"), "seq")["new_value"].alias("value")).groupBy(*row).agg(F.collect_list(F.struct("field", "value", "at")).alias("_cells"))
    since = F.filter("_cells", lambda c: F.col("_since").isNull() | (c["at"] > F.col("_since")))
    values = F.map_from_entries(F.transform(since, lambda c: F.struct(c["field"], c["value"])))
    return named.join(apart(cells), row, "full").withColumn("_set", F.when(F.size("_cells") > 0, values)).drop("_cells").withColumn("_told", F.lit(True))


def _now() -> Column:
    """Name and fields of a row after what is said of it."""
    fields = F.when(F.col("_since").isNotNull(), F.col("_added")).otherwise(F.col("fields"))
    whole = F.when(F.col("_set").isNull(), fields).otherwise(F.map_concat(F.map_filter(fields, lambda k, _: ~F.map_contains_key("_set", k)), "_set"))
    return F.struct(F.coalesce("_named", F.struct("row_name"))["row_name"].alias("row_name"), whole.alias("fields"))


def _folded(rows: DataFrame, log: DataFrame, own: list[str]) -> tuple[DataFrame, DataFrame]:
    """((table_path, row_id, row_index, row_name, fields, _left, _now, *own), (table_path, seq, kind, *own) of the commands that end their tables' folds).

    ``rows`` as in ``fold_table``, ``log`` a staged table of ``COMMANDS``; both hold ``own``, columns that a table_path decides. row_index, row_name and fields are those of
    the base, null if the row was born since; _left is the place after all commands, null if the row went; _now are name and fields after all commands,
    null if none is on the row.
    """
    row = ["table_path", "row_id"]
    said = _said(log, own)
    told = rows.join(apart(said), row, "left").withColumn("_now", F.when(F.col("_told"), _now()))
    told = staged(told.select("table_path", "row_id", "row_index", "row_name", "fields", *own, "_now"), "rows")

    on_rows, names = _row_problems(told.where("_now is not null"), log)
    places, state, born, begun = _order_problems(told, log)
    bad = reduce(DataFrame.union, [x for x in (on_rows, places, _name_problems(told, names)) if x is not None])
    first = staged(bad.groupBy("table_path").agg(F.min("seq").alias("seq")), "first")
    ends = met(log.select("table_path", "seq", "kind", *own), first, ["table_path", "seq"], None)
    errors = staged(ends.groupBy("table_path").agg(F.first("seq").alias("seq"), F.min("kind").alias("kind"), *[F.first(c).alias(c) for c in own]), "errors")

    kinds = dict(told.dtypes)
    null = lambda c: F.lit(None).cast(kinds[c])
    if born is not None:
        begins = said.where("_since is not null").withColumns({"row_name": null("row_name"), "fields": null("fields")}).select(*row, _now().alias("_now"), *[F.col(f"_own_{c}").alias(c) for c in own])
        state = state.unionByName(born.join(apart(begins), row), allowMissingColumns=True)
    if begun is not None:  # rows of a list that a reorder began are those of the base, or born
        is_ = F.coalesce("_now", F.when(F.col("_told"), _now()), F.struct("row_name", "fields"))
        of = begun.join(apart(told.drop("row_index")), row, "left").join(apart(said), row, "left")
        state = state.unionByName(of.select(*row, "_left", is_.alias("_now"), *[F.coalesce(c, f"_own_{c}").alias(c) for c in own]), allowMissingColumns=True)
    return state, errors


def _at_last(state: DataFrame, back: Column) -> DataFrame:
    """``state`` with row_index, row_name and fields as of the base where ``back``, else as of the end."""
    now = lambda c: F.when(~back & F.col("_now").isNotNull(), F.col(f"_now.{c}")).otherwise(F.col(c)).alias(c)
    rest = [c for c in state.columns if c not in ("row_index", "row_name", "fields", "_left", "_now")]
    return state.select(*rest, F.when(back, F.col("row_index")).otherwise(F.col("_left")).alias("row_index"), now("row_name"), now("fields")).where("row_index is not null")


def fold_table(rows: DataFrame, commands: DataFrame) -> DataFrame:
    """Tables after their commands: (table_path, row_index, row_id, row_name, fields, error).

    ``rows(table_path, row_index, row_id, row_name, fields map<string,string>)``, with indexes from 0 and ids that no table repeats.
    ``commands(table_path, seq, kind, ...)``, each table's in order of seq: set_cell (row_id, field, old_value, new_value: the row and its field must
    be there, with the old value), add (row_id, row_name, at_index, fields: place within bounds, new id and name), remove (row_id, at_index: it
    must stand there), rename (row_id, old_name, row_name: the old name must match, no row may have the new one) and reorder (old_order, new_order: the one must be
    the order, the other hold the same ids). Columns that no command needs may be left out. The first command that doesn't
    fit ends its table's fold with an error, kind_rejected:seq; the rows are then those of the base. A table without rows may be added to; a table without
    commands stays as it is.
    """
    rows = rows.select("table_path", F.col("row_index").cast("long"), "row_id", "row_name", _column(rows, "fields", "map<string,string>"))
    log = staged(_commands(commands, []), "commands")
    edited, rest, kept = log.select("table_path").distinct(), None, ["table_path", "row_index", "row_id", "row_name", "fields", "error"]
    if few(edited):  # tables without commands stay where they are
        told = staged(rows.join(F.broadcast(edited.withColumn("_edited", F.lit(True))), _TABLE, "left"), "tables")
        rows, rest = told.where("_edited").drop("_edited"), told.where("_edited is null").withColumn("error", F.lit(None).cast("string"))
    state, errors = _folded(rows, log, [])
    errors = errors.select("table_path", F.concat("kind", F.lit("_rejected:"), F.col("seq").cast("string")).alias("error"))
    done = _at_last(met(state, errors, _TABLE, "row_id", "left"), F.col("error").isNotNull()).select(*kept)
    return done if rest is None else done.unionByName(rest.select(*kept))


def fold_rows(rows: DataFrame, commands: DataFrame) -> DataFrame:
    """The same for tables whose cells don't matter: (table_path, row_index, row_id, row_name, error)."""
    return fold_table(rows.select("table_path", "row_index", "row_id", "row_name"), commands).drop("fields")


def run_transactions(steps: DataFrame, tables: DataFrame, rows: DataFrame, commands: DataFrame, operation: str) -> tuple[DataFrame, DataFrame]:
    """((operation, outcome, code, command), (operation, table_path, row_index, row_id, row_name, fields)) of operations that run their commands.

    ``steps(operation, table_path, expected)`` name an operation's tables, ``tables`` what is known of them (see ``apply_transaction``), ``rows`` are
    the tables' rows and ``commands(operation, table_path, seq, kind, ...)`` what the operation does to them (see ``fold_table``). An operation that passes
    the checks runs its commands in order of seq, each on its table. The first that fails (command), or is on a table that the operation doesn't name,
    rolls all its tables back; else they are committed. Rows are those that a committed or rolled back operation leaves; each
    operation begins with the tables as they are given.
    """
    checked = staged(apply_transaction(steps.withColumn("failure", F.lit(None).cast("string")), tables, operation), "checked")
    passed = checked.where("outcome = 'committed'").select(operation)
    key = F.concat_ws("\x01", F.col(operation).cast("string"), "table_path")
    # no table comes twice in an operation that passed
    plan = staged(steps.select(operation, "table_path").join(apart(passed), operation), "operations")
    run = _commands(commands, [operation]).join(apart(plan.withColumn("_run", F.lit(True))), [operation, "table_path"], "left")
    ours = lambda c: F.when(F.col("_run"), c)
    run = staged(run.select(ours(key).alias("table_path"), operation, "seq", *[ours(F.col(c)).alias(c) for c in COMMANDS if c != "seq"]), "commands")
    mine = rows.join(apart(plan), "table_path").select(key.alias("table_path"), F.col("row_index").cast("long").alias("row_index"), "row_id", "row_name", _column(rows, "fields", "map<string,string>"), operation)
    state, errors = _folded(mine, run.where("table_path is not null"), [operation])
    outside = run.where("table_path is null").groupBy(operation).agg(F.min("seq").alias("command")).join(apart(passed), operation)
    failed = errors.select(operation, F.col("seq").alias("command"))
    first = staged(failed.unionByName(outside).groupBy(operation).agg(F.min("command").alias("command")), "failed")
    told = met(checked, first, [operation], None, "left")
    back = F.col("command").isNotNull()
    outcomes = told.select(operation, F.when(back, "rolled_back").otherwise(F.col("outcome")).alias("outcome"), F.when(back, "command_failed").otherwise(F.col("code")).alias("code"), "command")
    after = _at_last(met(state, first, [operation], "row_id", "left"), F.col("command").isNotNull())
    path = F.substr("table_path", F.length(F.col(operation).cast("string")) + 2)
    return outcomes, after.select(operation, path.alias("table_path"), "row_index", "row_id", "row_name", "fields")
