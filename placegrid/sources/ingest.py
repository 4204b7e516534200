"""Decisions, Bronze rows and batch life cycle (S-6 to S-16, S-22, S-23)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from placegrid.operators import gates

# Provenance every Bronze row carries.
PROVENANCE = ("source_id", "period", "delivery_version", "source_file", "source_sha256", "schema_version", "batch_id",
              "run_id", "ingested_at_utc")
# Batch statuses an interrupted load may be picked up from.
RETRYABLE = ("validating", "loading", "failed")


def choose_action(found: DataFrame, batches: DataFrame, rerun: bool = False, key: str = "sha256") -> DataFrame:
    """S-6: load, skip, rerun or retry, from what is remembered about the same bytes."""
    known = F.col("batch_status")
    action = (F.when(known.isNull() | (known == "blocked"), "load")
              .when(known == "succeeded", "rerun" if rerun else "skip")
              .when(known.isin(*RETRYABLE), "retry").otherwise("skip"))
    remembered = batches.select(key, F.col("status").alias("batch_status"))
    return found.join(remembered, key, "left").withColumn("action", action)


def load_type(deliveries: DataFrame, succeeded: DataFrame, source: str = "source_id", period: str = "period",
              version: str = "delivery_version") -> DataFrame:
    """S-7: revision, initial, backfill or incremental, against the periods already loaded for the source."""
    latest = succeeded.groupBy(source).agg(F.max(period).alias("_latest"))
    kind = (F.when(F.col(version) > 1, "revision").when(F.col("_latest").isNull(), "initial")
            .when(F.col(period) < F.col("_latest"), "backfill").otherwise("incremental"))
    return deliveries.join(latest, source, "left").withColumn("load_type", kind).drop("_latest")


def load_type_for_years(deliveries: DataFrame, succeeded: DataFrame, source: str = "source_id", years: str = "years",
                        version: str = "delivery_version") -> DataFrame:
    """S-7: the same by sets of years; overlapping years are a revision."""
    loaded = succeeded.select(source, F.explode(years).alias("_y")).groupBy(source).agg(
        F.collect_set("_y").alias("_loaded"), F.max("_y").alias("_latest"))
    kind = (F.when((F.col(version) > 1) | F.coalesce(F.arrays_overlap(years, "_loaded"), F.lit(False)), "revision")
            .when(F.col("_latest").isNull(), "initial").when(F.array_max(years) < F.col("_latest"), "backfill")
            .otherwise("incremental"))
    return deliveries.join(loaded, source, "left").withColumn("load_type", kind).drop("_loaded", "_latest")


def file_decision(found: DataFrame, approved: DataFrame, key: str = "sha256", name: str = "file_name") -> DataFrame:
    """S-23: accepted, blocked (unregistered, or the approved name with other bytes) or skipped (a repackaged copy)."""
    by_bytes = approved.select(key, F.col(name).alias("_approved_name"))
    by_name = approved.select(name, F.col(key).alias("_approved_bytes"))
    joined = found.join(by_bytes, key, "left").join(by_name, name, "left")
    same_name = F.col("_approved_name") == F.col(name)
    return joined.withColumn(
        "decision", F.when(same_name, "accepted").when(F.col("_approved_name").isNotNull(), "skipped: repackaged copy")
        .when(F.col("_approved_bytes").isNotNull(), "blocked: checksum mismatch").otherwise("blocked: unregistered")
    ).drop("_approved_name", "_approved_bytes")


def row_checks(df: DataFrame, identifier: str, pattern: str, required: Sequence[str], expected_rows: int) -> DataFrame:
    """S-8: the checks before a load. Contents and identifiers are counted first, then summed, so no global distinct."""
    columns = [c for c in df.columns]
    ids = df.groupBy(identifier).agg(F.count("*").alias("_n"))
    blank = F.trim(F.coalesce(F.col(identifier).cast("string"), F.lit(""))) == ""
    bad = ~blank & ~F.col(identifier).cast("string").rlike(f"^(?:{pattern})$")
    total = lambda w: F.coalesce(F.sum(F.when(w, F.col("_n"))), F.lit(0))
    contents = df.groupBy(*columns).agg(F.count("*").alias("_n"))
    missing = [c for c in required if c not in columns]
    zero = lambda a: a == 0
    return gates.all_checks(
        gates.run_checks(ids, [
            gates.Check("row_count_nonzero", F.coalesce(F.sum("_n"), F.lit(0)), lambda a: a > 0, "> 0"),
            gates.Check("row_count_matches_approved", F.coalesce(F.sum("_n"), F.lit(0)), lambda a: a == expected_rows, str(expected_rows)),
            gates.Check("required_columns_present", F.coalesce(F.max(F.lit(len(missing))), F.lit(len(missing))), zero, "0"),
            gates.Check(f"{identifier}_not_blank", total(blank), zero, "0"),
            gates.Check(f"{identifier}_format", total(bad), zero, "0", True),
            gates.Check(f"{identifier}_unique_in_file", F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)), zero, "0", True)]),
        gates.run_checks(contents, [
            gates.Check("duplicate_rows_in_file", F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)), zero, "0", True)]))


def known_issues(df: DataFrame, issues: Mapping[str, tuple[Column, int]]) -> DataFrame:
    """S-9: profiled publisher quirks counted in one pass and compared with the expected count, WARN only."""
    return gates.run_checks(df, [
        gates.Check(f"known_issue/{n}", F.count_if(F.coalesce(hit, F.lit(False))), lambda a, e=e: a == e, str(e), True)
        for n, (hit, e) in issues.items()])


def geometry_checks(df: DataFrame, geometry: str, reference_date: str, crs: str, allowed=("Polygon", "MultiPolygon")) -> DataFrame:
    """S-10: geometry present and of an allowed type, one reference date, WGS84, no byte-order mark."""
    kind = F.get_json_object(geometry, "$.type")
    return gates.run_checks(df, [
        gates.zero("geometry_not_null", F.col(geometry).isNull()),
        gates.zero("geometry_type_allowed", F.col(geometry).isNotNull() & ~F.coalesce(kind.isin(*allowed), F.lit(False))),
        gates.Check("single_reference_date", F.when(F.min(reference_date) == F.max(reference_date), 1).otherwise(2), lambda a: a == 1, "1"),
        gates.zero("crs_is_wgs84", ~F.col(crs).isin("urn:ogc:def:crs:OGC:1.3:CRS84", "EPSG:4326")),
        gates.zero("no_byte_order_mark", F.coalesce(F.col(geometry).startswith("\ufeff"), F.lit(False)))])


def bronze_rows(df: DataFrame, columns: Sequence[str], provenance: Mapping[str, Column]) -> DataFrame:
    """S-11: the union of all versions' columns plus provenance; absent columns are NULL, blanks stay ''."""
    from placegrid.sources.contract import conform

    keep = [c for c in ("source_row_number",) if c in df.columns and c not in columns]
    rows = conform(df, [*columns, *keep])
    return rows.withColumns(dict(provenance))


def insert_only(existing: DataFrame, incoming: DataFrame, key: Sequence[str] = ("source_sha256", "source_row_number")) -> DataFrame:
    """S-12: the incoming rows whose identity is not stored yet; appending them twice adds nothing."""
    return incoming.dropDuplicates(list(key)).join(existing.select(*key), list(key), "left_anti")


def reconcile_load(loaded: DataFrame, expected: DataFrame, by: Sequence[str], row: str = "source_row_number",
                   provenance: Sequence[str] = ()) -> DataFrame:
    """S-15: per batch the rows, distinct row numbers, span and provenance against what was expected."""
    missing = F.lit(False)
    for c in provenance:
        missing = missing | F.col(c).isNull()
    rows = loaded.groupBy(*by, row).agg(F.count("*").alias("_n"), F.count_if(missing).alias("_m"))
    found = rows.groupBy(*by).agg(
        F.sum("_n").cast("bigint").alias("rows"), F.count("*").alias("distinct_rows"), F.min(row).alias("first_row"),
        F.max(row).alias("last_row"), F.sum("_m").cast("bigint").alias("provenance_missing"))
    joined = found.join(expected, list(by), "full_outer")
    ok = ((F.col("rows") == F.col("expected_rows")) & (F.col("rows") == F.col("distinct_rows"))
          & (F.col("last_row") - F.col("first_row") + 1 == F.col("rows")) & (F.col("provenance_missing") == 0))
    return joined.withColumn("status", F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL"))


def batch_state(batches: DataFrame, checks: DataFrame, reconciled: DataFrame, batch: str = "batch_id") -> DataFrame:
    """S-16: blocked when a check failed before loading, failed when it does not reconcile, else succeeded."""
    before = checks.groupBy(batch).agg(F.bool_or(F.col("status") == "FAIL").alias("_blocked"))
    after = reconciled.select(batch, (F.col("status") == "PASS").alias("_ok"))
    return (batches.join(before, batch, "left").join(after, batch, "left")
            .withColumn("status", F.when(F.coalesce("_blocked", F.lit(False)), "blocked").when(F.col("_ok").isNull(), "loading")
                        .when(F.col("_ok"), "succeeded").otherwise("failed")).drop("_blocked", "_ok"))


# The states of a batch and the event that leads from one to another. Anything else is refused.
BATCH_STATES = ("new", "validating", "loading", "succeeded", "failed", "blocked")
BATCH_STEPS = {
    ("new", "start"): "validating", ("validating", "start"): "validating", ("loading", "start"): "validating", ("failed", "start"): "validating",
    ("blocked", "start"): "validating", ("succeeded", "rerun"): "validating", ("validating", "block"): "blocked", ("validating", "load"): "loading",
    ("validating", "fail"): "failed", ("loading", "fail"): "failed", ("loading", "succeed"): "succeeded",
}
_TOLD = "struct<first:string,status:string,attempts:bigint,refused:bigint>"


def batch_life_cycle(events: DataFrame, before: DataFrame | None = None, batch: str = "batch_id", number: str = "event_number",
                     event: str = "event", block: int = 100_000) -> DataFrame:
    """S-16: status, attempts and refused events of every batch of an append-only log, in the order of ``number``.

    An event that the state does not allow is refused: it changes nothing and is counted. Each (re)start is an attempt.
    ``before`` is an earlier result of this function, from which the fold goes on with later events. What a run of
    events does to every possible state is itself a step, and steps can be put together in any grouping: so runs of
    ``block`` log numbers are folded apart, and then one row for each run. A missing or unknown event is refused; events with one
    number go by name.
    """
    steps = F.create_map(*[F.lit(x) for (state, name), to in BATCH_STEPS.items() for x in (f"{state}/{name}", to)])
    told = lambda first, status, attempts, refused: F.struct(
        first.alias("first"), status.alias("status"), attempts.alias("attempts"), refused.alias("refused")).cast(_TOLD)
    start = F.array(*[told(F.lit(s), F.lit(s), F.lit(0), F.lit(0)) for s in BATCH_STATES])

    def after(acc, e):
        def moved(x):
            to = F.try_element_at(steps, F.concat(x["status"], F.lit("/"), F.coalesce(e, F.lit(""))))
            opened = (to.isNotNull() & e.isin("start", "rerun")).cast("bigint")
            return told(x["first"], F.coalesce(to, x["status"]), x["attempts"] + opened, x["refused"] + to.isNull().cast("bigint"))
        return F.transform(acc, moved)

    runs = events.groupBy(F.col(batch).alias("_batch"), F.floor(F.col(number) / block).alias("_run")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), F.col(event).alias("e")))).alias("_events"))
    runs = runs.select("_batch", "_run", F.aggregate(F.transform("_events", lambda x: x["e"]), start, after).alias("_steps"))
    known = before.select(F.col(batch).alias("_batch"), told(F.lit("new"), F.col("status"), F.col("attempts"), F.col("refused")).alias("_known")) if before is not None else None
    whole = runs.groupBy("_batch").agg(F.array_sort(F.collect_list(F.struct("_run", "_steps"))).alias("_runs"))
    whole = whole.join(known, "_batch", "full_outer") if known is not None else whole.withColumn("_known", F.lit(None).cast(_TOLD))

    def then(acc, run):
        x = F.filter(run["_steps"], lambda s: s["first"] == acc["status"])[0]
        return told(acc["first"], x["status"], acc["attempts"] + x["attempts"], acc["refused"] + x["refused"])

    fresh = told(F.lit("new"), F.lit("new"), F.lit(0), F.lit(0))
    end = F.aggregate(F.coalesce("_runs", F.array().cast("array<struct<_run:bigint,_steps:array<" + _TOLD + ">>>")), F.coalesce("_known", fresh), then)
    return whole.select(F.col("_batch").alias(batch), end.alias("_end")).select(batch, "_end.status", "_end.attempts", "_end.refused")


def reconcile_summary(rows: DataFrame, summary: DataFrame, level: str, value: str) -> DataFrame:
    """S-22: units and totals per level beside the publisher's own summary, WARN only."""
    counted = rows.groupBy(level).agg(F.count("*").alias("units"), F.sum(value).alias("total"))
    joined = counted.join(summary, level, "full_outer")
    same = F.col("units").eqNullSafe(F.col("published_units")) & F.col("total").eqNullSafe(F.col("published_total"))
    return joined.withColumn("status", F.when(same, "PASS").otherwise("WARN"))


def orphan_rows(rows: DataFrame, code: str, parent: Column) -> DataFrame:
    """S-22: rows whose derived parent code is not in the list."""
    known = rows.select(F.col(code).alias("_parent")).distinct()
    return rows.withColumn("_parent", parent).join(known, "_parent", "left_anti").drop("_parent")
