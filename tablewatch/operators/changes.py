"""Edits as data: fingerprints, differences, folds over command logs, validation and apply decisions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..sources.staging import staged
from .scans import dense_index, scan
from .values import text_fits


def canonical(value: Column, kind: T.DataType, unordered: bool = False) -> Column:
    """One string for a value of any kind: nulls and empty strings stay apart, maps (and ``unordered`` arrays) lose their order."""
    mark = lambda x, k: F.coalesce(F.concat(F.lit("="), canonical(x, k)), F.lit("null"))
    if isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda x: mark(x, kind.elementType))
        return F.concat(F.lit("["), F.array_join(F.array_sort(items) if unordered else items, ","), F.lit("]"))
    if isinstance(kind, T.MapType):
        items = F.transform(F.map_entries(value), lambda e: F.concat(mark(e["key"], kind.keyType), F.lit(":"), mark(e["value"], kind.valueType)))
        return F.concat(F.lit("{"), F.array_join(F.array_sort(items), ","), F.lit("}"))
    if isinstance(kind, T.StructType):
        return F.concat(F.lit("("), F.concat_ws(",", *[mark(value[f.name], f.dataType) for f in kind.fields]), F.lit(")"))
    return value.cast("string")


#: Children of a node in a table's tree of hashes.
CHILDREN = 10_000


def table_fingerprint(rows: DataFrame, table: str, order: str, columns: list[str], sets: list[str] | None = None, header: DataFrame | None = None, children: int = CHILDREN) -> DataFrame:
    """(table, fingerprint): the hash of what ``header`` (table, ...) says of it and of its rows' hashes in row order.

    What isn't in ``columns`` doesn't count, nor does the order within ``sets`` and maps. Rows are hashed one by one, and are then the leaves of
    a tree: a node hashes the hashes of ``children`` in a row, by their places and not by values of ``order``; levels follow until a table
    has one node. So no string grows with the table, and the hash tells nothing of how rows were partitioned. Rows that
    tie in ``order`` are taken by their hashes.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    each = [F.coalesce(F.concat(F.lit("="), canonical(F.col(c), kinds[c], c in (sets or []))), F.lit("null")) for c in columns]
    leaves = rows.select(table, F.col(order).alias("_order"), F.sha2(F.concat_ws("|", *each), 256).alias("h"))
    level = dense_index(leaves, [table], ["_order", "h"], "_at").select(table, "_at", "h")
    most = None
    while most is None or most > 1:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "h"))), lambda x: x["h"]), "")
        alone = (F.count("*") == 1) & (F.max("_at") == 0) & F.lit(most is not None)  # a table that has its one node already
        level = level.groupBy(table, F.floor(F.col("_at") / children).alias("_up")).agg(F.when(alone, F.min("h")).otherwise(F.sha2(joined, 256)).alias("h")).withColumnRenamed("_up", "_at")
        level = staged(level, "nodes")
        most = (level.agg(F.max("_at")).first()[0] or 0) + 1
    found = level.select(table, F.col("h").alias("fingerprint"))
    if header is None:
        return found
    said = [f for f in header.schema.fields if f.name != table]
    about = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), canonical(F.col(f.name), f.dataType)), F.lit("null")) for f in said])
    return header.join(found, table, "left").select(table, F.sha2(F.concat_ws("|", about, F.coalesce("fingerprint", F.lit(""))), 256).alias("fingerprint"))


def table_diff(base: DataFrame, working: DataFrame, table: str, key: str, order: str, name: str, fields: list[str]) -> DataFrame:
    """(table, kind, row_id, field, before, after) of tables: rows removed, added, renamed, and cells changed on both sides.

    ``order`` counts a table's rows from 0 on each side. A table whose list of row ids differs at all, also by rows added or
    removed, has one rows_reordered besides.
    """
    b, w = base.alias("b"), working.alias("w")
    at = lambda side, c: F.col(f"{side}.{c}")
    both = b.join(w, (at("b", table) == at("w", table)) & (at("b", key) == at("w", key)), "full")
    gone, new = at("w", key).isNull(), at("b", key).isNull()
    changes = [(gone, "row_removed", None, at("b", name), F.lit(None)), (new, "row_added", None, F.lit(None), at("w", name))]
    for f in [name, *fields]:
        changes.append((~gone & ~new & ~at("b", f).eqNullSafe(at("w", f)), "row_renamed" if f == name else "cell_changed", None if f == name else f, at("b", f), at("w", f)))
    said = [F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(field).cast("string").alias("field"), before.cast("string").alias("before"), after.cast("string").alias("after"))) for test, kind, field, before, after in changes]
    rows = both.select(F.coalesce(at("b", table), at("w", table)).alias(table), F.coalesce(at("b", key), at("w", key)).alias("row_id"), (~at("b", order).eqNullSafe(at("w", order))).alias("_moved"), F.array_compact(F.array(*said)).alias("_said"))
    each = rows.select(table, "row_id", F.explode("_said").alias("c")).select(table, "c.kind", "row_id", "c.field", "c.before", "c.after")
    moved = rows.groupBy(table).agg(F.bool_or("_moved").alias("_moved")).where("_moved")
    none = F.lit(None).cast("string")
    return each.unionByName(moved.select(table, F.lit("rows_reordered").alias("kind"), none.cast(dict(each.dtypes)["row_id"]).alias("row_id"), none.alias("field"), none.alias("before"), none.alias("after")))


def dirty_rows(changes: DataFrame, working: DataFrame, table: str, key: str) -> DataFrame:
    """(table, row_id): rows that a change names, and every row of a table that was reordered."""
    named = changes.where("kind <> 'rows_reordered'").select(table, "row_id")
    moved = working.join(changes.where("kind = 'rows_reordered'").select(table), table, "left_semi").select(table, F.col(key).alias("row_id"))
    return named.union(moved).distinct()


def session_review(base: DataFrame, working: DataFrame, diagnostics: DataFrame, table: str, key: str, order: str, name: str, fields: list[str]) -> DataFrame:
    """One row for each table: its changes, dirty cells and rows, errors and warnings, and whether it is valid.

    ``diagnostics(table, severity)``: what validation says of the working tables.
    """
    changes = table_diff(base, working, table, key, order, name, fields)
    told = changes.groupBy(table).agg(F.count("*").alias("changes"), F.count_if(F.col("kind") == "cell_changed").alias("dirty_cells"))
    rows = dirty_rows(changes, working, table, key).groupBy(table).agg(F.count("*").alias("dirty_rows"))
    found = diagnostics.groupBy(table).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    every = base.select(table).union(working.select(table)).distinct()
    for part in (told, rows, found):
        every = every.join(part, table, "left")
    every = every.na.fill(0, ["changes", "dirty_cells", "dirty_rows", "errors", "warnings"])
    return every.withColumn("valid", F.col("errors") == 0)


def fold_set_cell(base: DataFrame, commands: DataFrame) -> DataFrame:
    """``base(table_path, row_id, value)`` after ``commands(table_path, row_id, seq, old_value, new_value)``, with valid.

    Each command's row must exist, and its old value must be the value so far; a table of which one command doesn't fit
    isn't folded: all its rows keep their base values.
    """
    log = Window.partitionBy("table_path", "row_id").orderBy("seq")
    keys = ["table_path", "row_id"]
    held = base.select(*keys, "value", F.lit(True).alias("_held"))
    checked = commands.join(held, keys, "left").withColumn("ok", F.col("_held").isNotNull() & F.coalesce(F.lag("new_value").over(log), F.col("value")).eqNullSafe(F.col("old_value")))
    last = checked.groupBy(*keys).agg(F.max_by("new_value", "seq").alias("_new"), F.bool_and("ok").alias("_ok"))
    tables = last.groupBy("table_path").agg(F.bool_and("_ok").alias("_fits"))
    rows = base.join(tables, "table_path", "left").join(last.drop("_ok").withColumn("_set", F.lit(True)), keys, "left")
    value = F.when(F.col("_fits") & F.col("_set"), F.col("_new")).otherwise(F.col("value"))
    return rows.select(*keys, value.alias("value"), F.coalesce("_fits", F.lit(True)).alias("valid"))


def duplicate_names(rows: DataFrame, table: str, name: str, order: str) -> DataFrame:
    """Rows whose name, case aside, came before in the table, each with the first such name."""
    told = scan(rows.withColumn("_name", F.lower(name)), [table, "_name"], [order], sums={"_n": F.lit(1)}, firsts={"first_name": F.col(name)})
    return told.where("_n > 1").drop("_n", "_name")


def exact_changes(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose ``value`` is another than that of the row before in their key, nulls being values; the first always is."""
    told = scan(rows, [key], [order], sums={"_n": F.lit(1)}, lags={"_was": F.col(value)})
    return told.where((F.col("_n") == 1) | ~F.col("_was").eqNullSafe(F.col(value))).drop("_n", "_was")


def row_name_problem(name: Column) -> Column:
    return F.when(name.isNull() | (name == ""), "empty").when(F.lower(name) == "none", "reserved").when(F.instr(name, "\0") > 0, "nul")


def groups_all_or_nothing(checked: DataFrame, group: str, code: str) -> DataFrame:
    """(group, n, n_errors, accepted): a group is taken only if none of its rows has an error code."""
    return checked.groupBy(group).agg(F.count("*").alias("n"), F.count(code).alias("n_errors"), F.bool_and(F.col(code).isNull()).alias("accepted"))


def fits(value: Column, kind: Column, options: Column) -> Column:
    """Whether a text fits the kind that a schema row says: int, uint, guid, bool, enum (of options) or string."""
    plain = F.lit(False)
    for k in ("int", "uint", "guid"):
        plain = F.when(kind == k, text_fits(value, k)).otherwise(plain)
    plain = F.when(kind == "bool", value.isin("true", "false")).when(kind == "enum", F.array_contains(options, value)).when(kind == "string", True).otherwise(plain)
    return F.coalesce(plain, F.lit(False))


def bulk_edit_validation(edits: DataFrame, rows: DataFrame, schema: DataFrame, group: str) -> DataFrame:
    """``edits(group, row_id, field, value)`` with the code of what is wrong, and whether their group is taken.

    ``rows(row_id)`` are those that exist, ``schema(field, kind, options array<string>, read_only)`` describes the fields. In this
    order: row_not_found, missing_field, unsupported_edit, incompatible_value. One bad edit rejects its whole group.
    """
    here = rows.select("row_id").distinct().withColumn("_row", F.lit(True))
    met = edits.join(here, "row_id", "left").join(schema.select("field", "kind", "options", "read_only"), "field", "left")
    code = F.when(F.col("_row").isNull(), "row_not_found").when(F.col("kind").isNull(), "missing_field").when(F.col("read_only"), "unsupported_edit").when(~fits(F.col("value"), F.col("kind"), F.col("options")), "incompatible_value")
    coded = met.withColumn("code", code).drop("_row", "kind", "options", "read_only")
    return coded.join(groups_all_or_nothing(coded, group, "code").select(group, "accepted"), group)


def row_intents(intents: DataFrame, rows: DataFrame) -> DataFrame:
    """``intents(intent_id, table_path, kind, row_id, row_name, at_index)`` with status, the place that is meant, and the old name.

    ``rows(table_path, row_index, row_id, row_name)``. add and duplicate need a valid name that no row has, case aside, and a place
    within the table (the end, or behind the source, where none is given); duplicate, remove and rename need their row. Statuses:
    unknown_intent, row_not_found, invalid_row_name, duplicate_row_name, invalid_row_order, accepted.
    """
    sizes = rows.groupBy("table_path").agg(F.count("*").alias("_n"))
    own = rows.select("table_path", "row_id", F.col("row_index").alias("_index"), F.col("row_name").alias("_old"))
    names = rows.groupBy("table_path", F.lower("row_name").alias("_name")).agg(F.min("row_id").alias("_low"), F.max("row_id").alias("_high"))
    met = intents.join(sizes, "table_path", "left").join(own, ["table_path", "row_id"], "left").withColumn("_name", F.lower("row_name")).join(names, ["table_path", "_name"], "left")
    kind, makes = F.col("kind"), F.col("kind").isin("add", "duplicate")
    held = F.col("_low").isNotNull() & (makes | ~((F.col("_low") == F.col("row_id")) & (F.col("_high") == F.col("row_id"))))
    size = F.coalesce("_n", F.lit(0))
    place = F.when(kind == "add", F.coalesce("at_index", size)).when(kind == "duplicate", F.coalesce("at_index", F.col("_index") + 1)).when(kind == "remove", F.col("_index"))
    named = makes | (kind == "rename")
    status = (
        F.when(~kind.isin("add", "duplicate", "remove", "rename"), "unknown_intent")
        .when((kind != "add") & F.col("_index").isNull(), "row_not_found")
        .when(named & row_name_problem(F.col("row_name")).isNotNull(), "invalid_row_name")
        .when(named & held, "duplicate_row_name")
        .when(makes & ((place < 0) | (place > size)), "invalid_row_order")
        .otherwise("accepted")
    )
    done = met.withColumn("status", status)
    return done.select("intent_id", "status", F.when(F.col("status") == "accepted", place).alias("place"), F.when((F.col("status") == "accepted") & (kind != "add"), F.col("_old")).alias("old_name"))


def reorder_intents(intents: DataFrame, rows: DataFrame) -> DataFrame:
    """``intents(intent_id, table_path, row_id)``, a row for each id of a new order: (intent_id, status).

    accepted if the ids are those of the table's rows, each once; else invalid_row_order.
    """
    asked = intents.groupBy("intent_id", "table_path", "row_id").agg(F.count("*").alias("_times"))
    of = intents.select("intent_id", "table_path").distinct()
    wanted = of.join(rows.select("table_path", "row_id"), "table_path").withColumn("_there", F.lit(True))
    both = asked.join(wanted, ["intent_id", "table_path", "row_id"], "full")
    right = (F.coalesce("_times", F.lit(0)) == 1) & F.col("_there").isNotNull()
    return both.groupBy("intent_id").agg(F.when(F.bool_and(right), "accepted").otherwise("invalid_row_order").alias("status"))


def default_rows(wanted: DataFrame, schema: DataFrame) -> DataFrame:
    """``wanted(table_path, row_id, row_name)`` with status and fields array<struct<field, value>>, in order of the schema's fields.

    ``schema(table_path, field, known, default_value)``. A row is made only where the table has a schema and every default is known;
    else it is unsupported_add, without fields.
    """
    fields = F.array_sort(F.collect_list(F.struct("field", F.col("default_value").alias("value"))))
    per_table = schema.groupBy("table_path").agg(F.bool_and("known").alias("_known"), fields.alias("_fields"))  # as many as a table has fields
    met = wanted.join(per_table, "table_path", "left")
    made = F.coalesce("_known", F.lit(False))
    return met.select("table_path", "row_id", "row_name", F.when(made, "created").otherwise("unsupported_add").alias("status"), F.when(made, F.col("_fields")).alias("fields"))


def append_group(log: DataFrame, pointers: DataFrame, added: DataFrame, session: str) -> DataFrame:
    """``log(session, place, command)`` after one group ``added(session, place, command)``: what was undone is cut off, the group stands after the pointer.

    ``pointers(session, pointer)``; places count from 0. A session without an addition stays as it is, undone commands too.
    """
    some = added.select(session).distinct().withColumn("_some", F.lit(True))
    at = pointers.select(session, "pointer").join(some, session, "left")
    kept = log.join(at, session).where(F.col("_some").isNull() | (F.col("place") < F.col("pointer"))).select(session, "place", "command")
    new = added.join(pointers.select(session, "pointer"), session).select(session, (F.col("pointer") + F.col("place")).alias("place"), "command")
    return kept.unionByName(new)


#: What becomes of an operation without an id, one that runs, one whose result is told again, and one whose id was used for something else.
INVALID, FIRST, REPLAYED, COLLISION = "invalid_request", "first", "replayed", "operation_id_collision"


class Results:
    """The last ``keep`` results of a server, by operation id, the oldest first."""

    def __init__(self, keep: int, held: list[tuple[str, str]] = ()):
        self.keep, self.held = keep, dict(held)

    def outcome(self, key: str | None, digest: str | None) -> str:
        if not key:
            return INVALID
        if key in self.held:
            return REPLAYED if self.held[key] == digest else COLLISION
        self.held[key] = digest
        if len(self.held) > self.keep:
            del self.held[next(iter(self.held))]
        return FIRST


def idempotent(operations: DataFrame, key: str, seq: str, digest: str, server: str, keep: int = 128) -> DataFrame:
    """Each operation with its outcome, in order of ``seq`` at its ``server``, and whether the result of one that ran is still kept in the end.

    A server keeps its last ``keep`` results. An id that is kept is replayed (same digest) or an operation_id_collision; any other runs as a
    first, one whose result was evicted too. Without an id, or with an empty one, it is an invalid_request. Servers follow one another in sorted
    partitions; of each no more than ``keep`` results are held.
    """
    columns = operations.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, results = None, Results(keep)
        for batch in batches:
            told = []
            for s, k, d in zip(*(batch.column(c).to_pylist() for c in (server, key, digest)), strict=True):
                if at != (s,):
                    at, results = (s,), Results(keep)
                told.append(results.outcome(k, d))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told, pa.string())], [*columns, "outcome"])

    kinds = ", ".join([*(f"`{c}` {k}" for c, k in operations.dtypes), "outcome string"])
    told = operations.repartition(server).sortWithinPartitions(server, seq).mapInArrow(run, kinds)
    ran = F.col("outcome") == FIRST
    later = scan(told.withColumn("_back", -F.col(seq)), [server], ["_back"], sums={"_later": ran.cast("long")})
    return later.withColumn("retained", ran & (F.col("_later") <= keep)).drop("_back", "_later")


def pipeline_state(sessions: DataFrame) -> DataFrame:
    """``sessions(…, pending_kind, pending_status, pointer, awaiting, receipts)`` with state and can_apply.

    A pending apply or save is indeterminate, applying or saving; else active commands make a draft; else tables that await saving
    make it applied; else receipts make it saved; else it is an empty draft.
    """
    pending = F.col("pending_kind").isin("apply", "save")
    state = (
        F.when(pending & (F.col("pending_status") == "indeterminate"), "indeterminate")
        .when(F.col("pending_kind") == "apply", "applying")
        .when(F.col("pending_kind") == "save", "saving")
        .when(F.col("pointer") > 0, "draft")
        .when(F.col("awaiting") > 0, "applied")
        .when(F.col("receipts") > 0, "saved")
        .otherwise("draft")
    )
    return sessions.withColumn("state", state).withColumn("can_apply", (F.col("state") == "draft") & (F.col("pointer") > 0))


def exact_set_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, problem) of every value that keeps two lists from being the same set without repeats: missing, unexpected or duplicate."""
    count = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    both = count(left, "_l").join(count(right, "_r"), key, "full")
    problem = F.when(F.col("_r").isNull(), "missing").when(F.col("_l").isNull(), "unexpected").when((F.col("_l") > 1) | (F.col("_r") > 1), "duplicate")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def tolerance_filter(samples: DataFrame, key: str, seq: str, value: str, tolerance: float) -> DataFrame:
    """Samples that moved more than ``tolerance`` from the last one *emitted*; the first always is.

    Keys are folded one after the other in a sorted partition, so a long one is never held whole.
    """
    schema = f"{key} long, {seq} long, {value} double"

    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = None, 0.0
        for part in parts:
            keep = []
            for k, v in zip(part[key].tolist(), part[value].tolist(), strict=True):
                moved = k != at or abs(v - last) > tolerance
                if moved:
                    at, last = k, v
                keep.append(moved)
            yield part[keep]

    rows = samples.select(F.col(key).cast("long"), F.col(seq).cast("long"), F.col(value).cast("double")).where(F.col(value).isNotNull())
    return rows.repartition(key).sortWithinPartitions(key, seq).mapInPandas(emit, schema)


def permutation_check(rows: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, permutation): whether the values of ``new`` are those of ``old``, each as often; counted, so no list is held."""
    signed = rows.select(key, F.inline(F.array(F.struct(F.col(old).alias("_v"), F.lit(1).alias("_c")), F.struct(F.col(new).alias("_v"), F.lit(-1).alias("_c")))))
    return signed.groupBy(key, "_v").agg(F.sum("_c").alias("_c")).groupBy(key).agg(F.bool_and(F.col("_c") == 0).alias("permutation"))


def merge_paths(awaiting: DataFrame, applied: DataFrame) -> DataFrame:
    """The distinct rows of both."""
    return awaiting.union(applied).distinct()


def command_groups(commands: DataFrame, pointers: DataFrame, session: str, place: str, group: str, table: str) -> DataFrame:
    """(session, group, commands, start, first_table, tables, active): a group is active if it begins before its session's pointer."""
    told = commands.groupBy(session, group).agg(F.count("*").alias("commands"), F.min(place).alias("start"), F.min_by(table, place).alias("first_table"), F.countDistinct(table).alias("tables"))
    return told.join(pointers.select(session, "pointer"), session).select(session, group, "commands", "start", "first_table", "tables", (F.col("start") < F.col("pointer")).alias("active"))
