"""Texts, inputs, sessions and apply decisions as tables of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scans import apart
from .values import walk


def text_occurrences(documents: DataFrame, package: str, location: str, capability: Column | None = None) -> DataFrame:
    """(package, location, value_path, text, capability): the texts inside JSON documents, at any depth.

    ``documents(entry, json)``: a string is a text; an object's string under ``raw`` stayed undecoded and is none. What ``capability``
    says of an entry holds for its texts (default: editable).
    """
    rows = documents.select(F.col("entry").cast("string").alias("entry"), (capability if capability is not None else F.lit("editable")).alias("capability"), F.try_parse_json("json").alias("v0"))
    said = walk(rows, "v0").where("kind = 'leaf' and schema_of_variant(v) = 'STRING' and not (key <=> 'raw')")
    return said.select(F.lit(package).alias("package"), F.lit(location).alias("location"), "entry", "value_path", F.expr("variant_get(v, '$', 'string')").alias("text"), "capability")


def decode_gaps(documents: DataFrame) -> DataFrame:
    """(entry, value_path): objects of JSON ``documents(entry, json)`` that hold only ``raw``, found through objects but not through arrays."""
    found = walk(documents.select("entry", F.try_parse_json("json").alias("v0")), "v0", objects_only=True, leaves=False)
    return found.where("kind = 'object' and try_variant_get(v, '$.raw', 'string') is not null and size(try_variant_get(v, '$', 'map<string,variant>')) = 1").select("entry", "value_path")


def unit_key(namespace: Column, name: Column) -> Column:
    """The key of a text unit: both parts URI-encoded, so that no separator of theirs is taken for ours."""
    part = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.concat(part(namespace), F.lit(":"), part(name))


def _unit(namespace: str, name: str, entry: str) -> Column:
    resolved = F.col(namespace).isNotNull() & F.col(name).isNotNull()
    return F.when(resolved, unit_key(F.col(namespace), F.col(name))).otherwise(F.concat(F.lit("entry:"), F.col(entry).cast("string")))


def unit_entries(rows: DataFrame, namespace: str, name: str, entry: str, text: str) -> DataFrame:
    """(unit_id, entry, digest): a row for each entry of a unit, for units that may hold a fixed share of all entries."""
    return rows.select(_unit(namespace, name, entry).alias("unit_id"), F.col(entry).alias("entry"), F.sha2(F.col(text), 256).alias("digest"))


def unit_states(entries: DataFrame) -> DataFrame:
    """``unit_entries`` to (unit_id, occurrences, texts, first_entry, last_entry, state): counts and two examples, so no unit is held whole."""
    each = entries.groupBy("unit_id", "digest").agg(F.count("*").alias("n"), F.min("entry").alias("low"), F.max("entry").alias("high"))
    units = each.groupBy("unit_id").agg(F.sum("n").alias("occurrences"), F.count("digest").alias("texts"), F.min("low").alias("first_entry"), F.max("high").alias("last_entry"))
    return units.withColumn("state", F.when(F.col("texts") <= 1, "consistent").otherwise("conflicting"))


def text_units(rows: DataFrame, namespace: str, name: str, entry: str, text: str) -> DataFrame:
    """(unit_id, occurrences, entries, sources, state): by namespace and name; a row without either is a unit of its own.

    entries are those that hold the unit, in order; sources the digests of its distinct texts, in order, so that a unit of many
    long texts stays small. A unit with one text (or none) is consistent, else conflicting.
    """
    resolved = F.col(namespace).isNotNull() & F.col(name).isNotNull()
    unit = F.when(resolved, unit_key(F.col(namespace), F.col(name))).otherwise(F.concat(F.lit("entry:"), F.col(entry).cast("string")))
    units = rows.select(unit.alias("unit_id"), F.col(entry).alias("_entry"), F.sha2(F.col(text), 256).alias("_digest")).groupBy("unit_id").agg(F.count("*").alias("occurrences"), F.sort_array(F.collect_list("_entry")).alias("entries"), F.sort_array(F.collect_set("_digest")).alias("sources"))
    return units.withColumn("state", F.when(F.size("sources") <= 1, "consistent").otherwise("conflicting"))


def coded(rows: DataFrame, key: str, *codes: tuple[Column, str]) -> DataFrame:
    """(key, code): one row for each test that holds; a null test doesn't."""
    said = F.array_compact(F.array(*[F.when(test, F.lit(code)) for test, code in codes]))
    return rows.select(key, F.explode(said).alias("code"))


def source_kind(rows: DataFrame, unit: str, location: str) -> DataFrame:
    several = F.min(location) != F.max(location)
    return rows.groupBy(unit).agg(F.when(several, "MULTI-SOURCE").otherwise(F.min(location)).alias("kind"))


def input_report(rows: DataFrame, package: str, relevant: Column, broken: Column) -> DataFrame:
    """Entries of each package, those of a relevant class, and whether it is partial: any diagnostic makes it so."""
    counts = rows.groupBy(package).agg(F.count("*").alias("entries"), F.count_if(relevant).alias("relevant"), F.count_if(broken).alias("diagnostics"))
    return counts.withColumn("status", F.when((F.col("diagnostics") > 0) | (F.col("relevant") == 0), "partial").otherwise("complete"))


def mapping_projection(rows: DataFrame, key: str, preferred: str, legacy: str) -> DataFrame:
    """(key, pos, value, origin): entries of the new container, of the old one where the new one is empty."""
    new = F.coalesce(F.size(preferred), F.lit(0)) > 0
    chosen = rows.select(key, F.when(new, "container").otherwise("legacy").alias("origin"), F.when(new, F.col(preferred)).otherwise(F.col(legacy)).alias("_list"))
    return chosen.select(key, "origin", F.posexplode("_list").alias("pos", "value"))


def mapping_rows(preferred: DataFrame, legacy: DataFrame, key: str, order: str) -> DataFrame:
    """The same where containers are rows (key, order): those of ``preferred``, of ``legacy`` for keys that it hasn't; no list is gathered."""
    place = (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).alias("pos")
    new = preferred.select(key, order, F.lit("container").alias("origin"), place)
    old = legacy.join(preferred.select(key).distinct(), key, "left_anti").select(key, order, F.lit("legacy").alias("origin"), place)
    return new.unionByName(old)


def snapshot_projection(rows: DataFrame, table: str, unsupported: str) -> DataFrame:
    """``rows`` with completeness: all of a table are partial if any of its values is unsupported."""
    status = rows.groupBy(table).agg(F.when(F.bool_or(F.coalesce(F.col(unsupported), F.lit(False))), "partial").otherwise("complete").alias("completeness"))
    return rows.join(status, table)


def cells(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, field_index, value): a table in long form, values as text."""
    kinds = dict(rows.dtypes)
    each = [F.struct(F.lit(f).alias("field"), F.lit(i).alias("field_index"), F.lit(kinds[f]).alias("type_name"), F.col(f).cast("string").alias("value")) for i, f in enumerate(fields)]
    return rows.select(key, F.explode(F.array(*each)).alias("c")).select(key, "c.*")


def pivot_cells(long: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Back to one row for each key; fields are named, so no pass over the data finds them."""
    return long.groupBy(key).pivot("field", fields).agg(F.first("value"))


def infer_columns(long: DataFrame) -> DataFrame:
    """(field, type_name, field_index) as first seen, from cells that have a value."""
    return long.where("value is not null").groupBy("field").agg(F.min_by("type_name", "field_index").alias("type_name"), F.min("field_index").alias("field_index"))


def local_lookup(refs: DataFrame, rows: DataFrame, package: str, target: str, path: str, kind: str) -> DataFrame:
    """``refs`` with the class of what they name in their own package; unknown ones stay without, null ones go."""
    found = rows.groupBy(F.col(package).alias("_p"), F.col(path).alias("_t")).agg(F.min(kind).alias("target_class"))
    return refs.where(F.col(target).isNotNull()).join(found, (F.col(package) == F.col("_p")) & (F.col(target) == F.col("_t")), "left").drop("_p", "_t")


def identity_remap(saved: DataFrame, current: DataFrame, key: str, instance: str) -> DataFrame:
    """(key, current_id): the id if it is still there, else the first with the same instance key, else null."""
    here = current.select(F.col(key).alias("_here")).distinct()
    first = current.groupBy(F.col(instance).alias("_instance")).agg(F.min(key).alias("_first"))
    met = saved.join(here, F.col(key) == F.col("_here"), "left").join(first, F.col(instance) == F.col("_instance"), "left")
    return met.select(key, F.coalesce("_here", "_first").alias("current_id"))


def undo_redo(commands: DataFrame, pointers: DataFrame, session: str, place: str, group: str) -> DataFrame:
    """(session, pointer, undone, redone): where the pointer goes when the group before it is taken back, and when the one behind it is done again.

    ``commands`` count their ``place`` from 0; a group is a run of equal ``group`` without others between. At the start undo stays,
    at the end redo does.
    """
    order = Window.partitionBy(session).orderBy(place)
    changes = commands.withColumn("_new", F.when(F.lag(group).over(order).eqNullSafe(F.col(group)) & (F.col(place) > 0), 0).otherwise(1))
    runs = changes.withColumn("_run", F.sum("_new").over(order)).groupBy(session, "_run").agg(F.min(place).alias("_from"), F.max(place).alias("_to"))
    ends = runs.join(pointers.select(session, "pointer"), session)
    # within a run the pointer may stand too: only the part on its side moves
    undone = F.max(F.when(F.col("_from") < F.col("pointer"), F.col("_from")))
    redone = F.min(F.when(F.col("_to") >= F.col("pointer"), F.col("_to") + 1))
    found = ends.groupBy(session, "pointer").agg(undone.alias("undone"), redone.alias("redone"))
    return found.select(session, "pointer", F.coalesce("undone", "pointer").alias("undone"), F.coalesce("redone", "pointer").alias("redone"))


_INVERSE = {"add": "remove", "remove": "add"}


def invert(commands: DataFrame, kind: str, seq: str, old: str, new: str) -> DataFrame:
    """Each command's inverse: values swapped, adding and removing exchanged, in reverse order."""
    swapped = F.when(F.col(kind) == "add", _INVERSE["add"]).when(F.col(kind) == "remove", _INVERSE["remove"]).otherwise(F.col(kind))
    rest = [c for c in commands.columns if c not in (kind, seq, old, new)]
    return commands.select(*rest, (-F.col(seq)).alias(seq), swapped.alias(kind), F.col(new).alias(old), F.col(old).alias(new))


def validation_summary(found: DataFrame, severity: str) -> DataFrame:
    errors = F.count_if(F.col(severity) == "error")
    return found.agg(errors.alias("errors"), F.count_if(F.col(severity) == "warning").alias("warnings"), (errors == 0).alias("valid"))


def session_summary(commands: DataFrame, session: str, table: str, awaiting: DataFrame) -> DataFrame:
    """(session, commands, tables, needs_save): sessions of ``awaiting(session)`` need saving."""
    told = commands.groupBy(session).agg(F.count("*").alias("commands"), F.array_join(F.sort_array(F.collect_set(table)), ",").alias("tables"))
    waits = awaiting.select(session).distinct().withColumn("_waits", F.lit(True))
    return told.join(waits, session, "left").select(session, "commands", "tables", F.col("_waits").isNotNull().alias("needs_save"))


def apply_plan(commands: DataFrame, pointers: DataFrame, prints: DataFrame, session: str, table: str, place: str, payload: str, tables: int = 16, most: int = 1024, size: int = 1 << 20) -> DataFrame:
    """(session, table, commands, expected_fingerprint, problem): what each session would apply, table by table.

    Only commands before its pointer count. ``prints(session, table, fingerprint)`` are those the drafts began from. problem is
    the first limit that the session breaks, for all its tables: too_many_tables, too_many_commands, payload_too_large.
    """
    active = commands.join(pointers.select(session, "pointer"), session).where(F.col(place) < F.col("pointer"))
    per_table = active.groupBy(session, table).agg(F.count("*").alias("commands"), F.sum(F.octet_length(payload)).alias("_bytes"))
    whole = per_table.groupBy(session).agg(F.count("*").alias("_tables"), F.sum("commands").alias("_commands"), F.sum("_bytes").alias("_size"))
    problem = F.when(F.col("_tables") > tables, "too_many_tables").when(F.col("_commands") > most, "too_many_commands").when(F.col("_size") > size, "payload_too_large")
    plan = per_table.join(whole.select(session, problem.alias("problem")), session).join(prints.select(session, table, F.col("fingerprint").alias("expected_fingerprint")), [session, table], "left")
    return plan.select(session, table, "commands", "expected_fingerprint", "problem")


def apply_accept(drafted: DataFrame, committed: DataFrame, session: str, table: str, fingerprint: str) -> DataFrame:
    """(session, table, outcome, base_fingerprint, clears): what becomes of each drafted table.

    ``drafted(session, table, fingerprint, base, commands)``. A session is committed if its tables are those committed and every
    fingerprint is the drafted one: then its base is rebased and its commands are cleared. Else it is snapshot_set_mismatch or
    fingerprint_mismatch, base and commands stay.
    """
    d = drafted.select(F.col(session).alias("ds"), F.col(table).alias("dt"), F.col(fingerprint).alias("df"), "base", "commands")
    c = committed.select(F.col(session).alias("cs"), F.col(table).alias("ct"), F.col(fingerprint).alias("cf"))
    both = d.join(c, (F.col("ds") == F.col("cs")) & (F.col("dt") == F.col("ct")), "full").withColumn("_s", F.coalesce("ds", "cs"))
    same = F.coalesce(F.col("df") == F.col("cf"), F.lit(False))
    told = both.groupBy("_s").agg(F.when(F.count_if(F.col("ds").isNull() | F.col("cs").isNull()) > 0, "snapshot_set_mismatch").when(F.bool_and(same), "committed").otherwise("fingerprint_mismatch").alias("outcome"))
    done = d.join(told, F.col("ds") == F.col("_s"))
    ok = F.col("outcome") == "committed"
    return done.select(F.col("ds").alias(session), F.col("dt").alias(table), "outcome", F.when(ok, F.col("df")).otherwise(F.col("base")).alias("base_fingerprint"), F.when(ok, F.col("commands")).otherwise(F.lit(0)).alias("clears"))


def apply_transaction(steps: DataFrame, tables: DataFrame, operation: str) -> DataFrame:
    """(operation, outcome, code): rejected by any check, rolled back by any command that fails, else committed.

    ``steps(operation, table_path, expected, failure)``, one for each table of an operation; ``tables(table_path, fingerprint,
    composite)`` as they are. code is the first of duplicate_table, table_not_found, read_only_table and fingerprint_mismatch
    that any step has, or command_failed.
    """
    known = tables.select("table_path", "fingerprint", "composite").withColumn("_known", F.lit(True))
    rank = F.when(F.col("_known").isNull(), 2).when(F.col("composite"), 3).when(~F.col("expected").eqNullSafe(F.col("fingerprint")), 4).when(F.col("failure").isNotNull(), 5)
    # names are met before steps are counted, so that these are dealt again without them
    met = steps.join(apart(known), "table_path", "left").select(operation, "table_path", rank.alias("_rank"))
    each = met.groupBy(operation, "table_path").agg(F.count("*").alias("_times"), F.min("_rank").alias("_rank"))
    worst = each.groupBy(operation).agg(F.min(F.when(F.col("_times") > 1, 1).otherwise(F.col("_rank"))).alias("_rank"))
    names = ["duplicate_table", "table_not_found", "read_only_table", "fingerprint_mismatch", "command_failed"]
    code = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_rank"))
    outcome = F.when(F.col("_rank").isNull(), "committed").when(F.col("_rank") == 5, "rolled_back").otherwise("rejected")
    return worst.select(operation, outcome.alias("outcome"), F.when(F.col("_rank").isNotNull(), code).alias("code"))


def reconcile(pending: DataFrame, results: DataFrame, operation: str, outcome: str) -> DataFrame:
    """``pending`` with the outcome that the log has for its operation, or operation_unknown."""
    known = results.groupBy(F.col(operation).alias("_op")).agg(F.max(outcome).alias("_outcome"))
    return pending.join(known, F.col(operation) == F.col("_op"), "left").withColumn("outcome", F.coalesce("_outcome", F.lit("operation_unknown"))).drop("_op", "_outcome")


def save_retry(awaiting: DataFrame, receipts: DataFrame, key: str, seq: str, status: str, safe: str) -> DataFrame:
    """Awaiting rows whose last receipt is absent, saved or safe to retry."""
    last = receipts.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(F.col(status).alias("status"), F.col(safe).alias("safe")), seq).alias("_last"))
    met = awaiting.join(last, F.col(key) == F.col("_k"), "left")
    return met.where(F.col("_last").isNull() | (F.col("_last.status") == "saved") | F.col("_last.safe")).drop("_k", "_last")


def health(rows: DataFrame, key: str, fatal: Column, reason: Column) -> DataFrame:
    """(key, health, reasons): unhealthy by any fatal row, degraded by any other reason."""
    found = rows.groupBy(key).agg(F.bool_or(F.coalesce(fatal, F.lit(False))).alias("_fatal"), F.array_join(F.sort_array(F.collect_set(reason)), ",").alias("reasons"))
    return found.select(key, F.when(F.col("_fatal"), "unhealthy").when(F.col("reasons") != "", "degraded").otherwise("healthy").alias("health"), "reasons")


def plan_selection(requested: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, problem): requested ids, with duplicate or missing where they can't be taken."""
    wanted = requested.groupBy(key).agg(F.count("*").alias("_n"))
    there = known.select(F.col(key).alias("_known")).distinct()
    return wanted.join(there, F.col(key) == F.col("_known"), "left").select(key, F.when(F.col("_known").isNull(), "missing").when(F.col("_n") > 1, "duplicate").alias("problem"))


def observation_events(events: DataFrame, feed: str, seq: str, kind: str) -> DataFrame:
    """(feed, seq, health, has_sample) after each event; the kinds are catalog, batch, reset, unavailable and polling.

    A catalog clears health and sample, reset makes it stale and unavailable keeps the sample; polling drops it.
    """
    before = Window.partitionBy(feed).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    health_ = F.when(F.col(kind) == "catalog", "connecting").when(F.col(kind) == "batch", "live").when(F.col(kind) == "reset", "stale").when(F.col(kind) == "polling", "polling_fallback").otherwise("unavailable")
    last = F.last(F.when(F.col(kind).isin("catalog", "polling", "batch"), F.col(kind)), ignorenulls=True).over(before)
    return events.select(feed, seq, health_.alias("health"), F.coalesce(last == "batch", F.lit(False)).alias("has_sample"))
