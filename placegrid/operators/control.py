"""Run ledger, batches and monitoring queries (S-13, S-14, S-17, Q-26 to Q-36)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from placegrid.session import literal_table
from placegrid.operators.scale import tie_ranked_first


def upsert(existing: DataFrame, incoming: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """S-13/Q-26: incoming keys set only the named columns; unknown keys are added."""
    unknown = [c for c in incoming.columns if c not in existing.columns]
    if unknown:
        raise ValueError(f"columns the table does not have: {unknown}")
    e, i = existing.withColumn("_e", F.lit(True)).alias("e"), incoming.withColumn("_i", F.lit(True)).alias("i")
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"i.{k}")) for k in key]
    out = []
    for c in existing.columns:
        if c in key:
            out.append(F.when(F.col("e._e").isNotNull(), F.col(f"e.{c}")).otherwise(F.col(f"i.{c}")).alias(c))
        elif c in columns:
            out.append(F.when(F.col("i._i").isNotNull(), F.col(f"i.{c}")).otherwise(F.col(f"e.{c}")).alias(c))
        elif c in incoming.columns:
            out.append(F.when(F.col("e._e").isNull(), F.col(f"i.{c}")).otherwise(F.col(f"e.{c}")).alias(c))
        else:
            out.append(F.col(f"e.{c}").alias(c))
    return e.join(i, same, "full_outer").select(*out)


def append_rows(log: DataFrame, rows: DataFrame) -> DataFrame:
    """S-14: unnamed columns are NULL, unknown ones are refused."""
    unknown = [c for c in rows.columns if c not in log.columns]
    if unknown:
        raise ValueError(f"columns the log does not have: {unknown}")
    return log.unionByName(rows, allowMissingColumns=True)


def current_batches(batches: DataFrame, source: str = "source_id", period: Sequence[str] = ("period", "dataset"),
                    version: str = "delivery_version", status: str = "status") -> DataFrame:
    """S-17: the highest succeeded version per source and period, by aggregate rather than a sort per key."""
    rows = batches.filter(F.col(status) == "succeeded").withColumn("_period", F.coalesce(*[F.col(p) for p in period]))
    others = [c for c in batches.columns if c not in (source, version)]
    top = rows.groupBy(source, "_period").agg(F.max(F.struct(version, *others)).alias("_top"))
    return top.select(source, "_top.*").select(*batches.columns)


def newest_results(results: DataFrame, key: Sequence[str], ts: str) -> DataFrame:
    """Q-31: the newest result of each check, ties kept."""
    return tie_ranked_first(results, key, ts)


def without_superseded(results: DataFrame, batches: DataFrame, current: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Q-31: results of batches a newer version replaced are dropped; each row says what its batch is."""
    known = batches.select(batch, F.col("status").alias("batch_status")).join(
        current.select(batch, F.lit(True).alias("_current")), batch, "left")
    joined = results.join(known, batch, "left")
    is_current = F.coalesce("_current", F.lit(False))
    state = (F.when(F.col(batch).isNull(), "not batch-scoped").when(F.col("batch_status").isNull(), "not in batches")
             .when(is_current, "current delivery").otherwise(F.concat(F.lit("batch "), F.col("batch_status"))))
    return (joined.withColumn("batch_state", state)
            .filter(~F.coalesce((F.col("batch_status") == "succeeded") & ~is_current, F.lit(False)))
            .drop("_current", "batch_status"))


def lane_status(lanes: Sequence[str], ledger: DataFrame, lane: str = "lane", status: str = "status") -> DataFrame:
    """Q-27: one check per expected lane; a lane that never ran fails as 'not run'."""
    spark = ledger.sparkSession
    expected = literal_table(spark, [(x,) for x in lanes], f"`{lane}` string")
    seen = ledger.groupBy(lane).agg(F.bool_and(F.col(status) == "succeeded").alias("_ok"),
                                    F.max(F.when(F.col(status) != "succeeded", F.col(status))).alias("_bad"))
    joined = F.broadcast(expected).join(seen, lane, "left")
    return joined.select(F.concat(F.lit("lane/"), F.col(lane)).alias("check_name"),
                         F.when(F.coalesce("_ok", F.lit(False)), "PASS").otherwise("FAIL").alias("status"),
                         F.lit("succeeded").alias("expected"),
                         F.when(F.col("_ok").isNull(), "not run").when(F.col("_ok"), "succeeded").otherwise(F.col("_bad")).alias("actual"))


def freshness(limits: DataFrame, current: DataFrame, as_of: Column, source: str = "source_id", ts: str = "succeeded_at",
              days: str = "max_age_days") -> DataFrame:
    """Q-28: WARN when the latest success is older than the source's limit, or there is none."""
    latest = current.groupBy(source).agg(F.max(ts).alias("last_succeeded"))
    fresh = F.col("last_succeeded") >= as_of - F.make_dt_interval(F.col(days))
    return limits.join(latest, source, "left").select(
        source, F.when(F.coalesce(fresh, F.lit(False)), "PASS").otherwise("WARN").alias("status"),
        F.concat(F.lit("succeeded within "), F.col(days).cast("string"), F.lit(" days")).alias("expected"),
        F.coalesce(F.concat(F.lit("last succeeded "), F.col("last_succeeded").cast("date").cast("string")),
                   F.lit("no succeeded batch")).alias("actual"))


def failures_of_latest_run(results: DataFrame, run: str = "run_id", ts: str = "checked_at") -> DataFrame:
    """Q-29: FAIL rows of the newest run, with how many there are on every row."""
    newest = results.agg(F.max_by(run, ts)).scalar()
    failed = results.filter((F.col(run) == newest) & (F.col("status") == "FAIL"))
    return failed.withColumn("failures", failed.agg(F.count("*")).scalar())


def stale_sources(results: DataFrame, check: str, source: str = "source_id", run: str = "run_id", ts: str = "checked_at") -> DataFrame:
    """Q-29/Q-35: sources that were stale in the latest run that checked them, newest result each."""
    of_check = results.filter(F.col("check_name") == check)
    newest = of_check.agg(F.max_by(run, ts)).scalar()
    return tie_ranked_first(of_check.filter(F.col(run) == newest), [source], ts)


def classify_checks(results: DataFrame, catalog: DataFrame, qualifier: str, check: str = "check_name",
                    unclassified: str = "Unclassified") -> DataFrame:
    """Q-30: attribute by exact name, else without its qualifier, else by the longest name family.

    The catalog is configuration; distinct names are classified once, families by the prefixes a name has, so
    every step is an equi-join.
    """
    names = results.select(F.col(check).alias("_name")).distinct().withColumn(
        "_bare", F.regexp_replace("_name", qualifier, ""))
    lookup = catalog.select("match_kind", "check_key", "attribute")
    exact = lookup.filter(F.col("match_kind") == "name").select(F.col("check_key").alias("_name"), F.col("attribute").alias("_exact"))
    bare = exact.select(F.col("_name").alias("_bare"), F.col("_exact").alias("_by_bare"))
    family = lookup.filter(F.col("match_kind") == "family").select(F.col("check_key").alias("_prefix"), F.col("attribute").alias("_family"))
    prefixes = (names.select("_name", F.explode(F.sequence(F.lit(1), F.length("_name"))).alias("_n"))
                .select("_name", F.substring(F.col("_name"), F.lit(1), F.col("_n")).alias("_prefix"), "_n")
                .join(family, "_prefix").groupBy("_name").agg(
                    F.max_by("_family", "_n").alias("_family"), F.max_by("_prefix", "_n").alias("_prefix")))
    known = names.join(exact, "_name", "left").join(bare, "_bare", "left").join(prefixes, "_name", "left").select(
        F.col("_name").alias(check),
        F.coalesce("_exact", "_by_bare", "_family", F.lit(unclassified)).alias("quality_attribute"),
        F.when(F.col("_exact").isNotNull(), "listed").when(F.col("_by_bare").isNotNull(), "listed, with a qualifier")
        .when(F.col("_family").isNotNull(), F.concat(F.lit("name family "), F.col("_prefix")))
        .otherwise("not in the catalog").alias("classification_basis"))
    return results.join(known, check, "left")


def history(results: DataFrame, ts: str, first_day: str, last_day: str) -> DataFrame:
    """Q-32: half-open range on the raw timestamp, so files outside it are skipped."""
    return results.filter((F.col(ts) >= F.lit(first_day).cast("timestamp_ntz"))
                          & (F.col(ts) < F.date_add(F.lit(last_day).cast("date"), 1).cast("timestamp_ntz")))


def daily_trend(results: DataFrame, ts: str, first_day: str, last_day: str, layers: Sequence[str],
                statuses: Sequence[str], layer: str = "layer", status: str = "status") -> DataFrame:
    """Q-33: every day, layer and status of the window with its count, 0 where nothing happened."""
    counts = history(results, ts, first_day, last_day).groupBy(
        F.col(ts).cast("date").alias("day"), layer, status).agg(F.count("*").alias("_n"))
    day = F.explode(F.sequence(F.lit(first_day).cast("date"), F.lit(last_day).cast("date")))
    known = literal_table(results.sparkSession, [(x,) for x in layers], f"`{layer}` string")
    grid = (known.union(counts.select(layer)).distinct().withColumn("day", day)
            .withColumn(status, F.explode(F.array(*[F.lit(s) for s in statuses]))))
    return grid.join(counts, ["day", layer, status], "left").select(
        "day", layer, status, F.coalesce("_n", F.lit(0)).cast("bigint").alias("result_events"))


def run_rollup(runs: DataFrame, results: DataFrame, key: Sequence[str]) -> DataFrame:
    """Q-34: one row per job run from its steps and its newest check results; both sides are aggregated first."""
    job = F.coalesce("job_run_id", "run_id")
    late = F.coalesce("finished_at", "started_at")
    steps = runs.withColumn("_job", job).groupBy("_job").agg(
        F.min("started_at").alias("started_at"),
        F.when(F.count_if(F.col("finished_at").isNull()) == 0, F.max("finished_at")).alias("finished_at"),
        F.count("*").alias("steps"), F.count_if(F.col("status") == "failed").alias("failed_steps"),
        F.count_if(F.col("status") == "running").alias("unfinished_steps"),
        F.array_join(F.sort_array(F.collect_set("code_revision")), ", ").alias("code_revisions"),
        F.max_by("error_message", F.struct(late.alias("at"), F.col("run_id").alias("id"))).alias("last_error"))
    jobs = runs.select("run_id", job.alias("_j")).distinct()
    keyed = results.join(jobs, "run_id", "left").withColumn("_job", F.coalesce("_j", "run_id")).drop("_j")
    newest = tie_ranked_first(keyed, ["_job", *key], "checked_at").groupBy("_job").agg(
        *[F.count_if(F.col("check_status") == s).alias(f"{s.lower()}_results") for s in ("PASS", "WARN", "FAIL")],
        F.min("checked_at").alias("_first"))
    joined = steps.withColumn("_ran", F.lit(True)).join(newest, "_job", "full_outer")
    failed = (F.col("failed_steps") > 0) | (F.col("fail_results") > 0)
    return joined.select(
        F.col("_job").alias("run_id"),
        F.when(failed, "failed").when(F.col("unfinished_steps") > 0, "running or interrupted")
        .when(F.col("_ran").isNull(), "no step row").otherwise("succeeded").alias("run_status"),
        F.coalesce("started_at", "_first").alias("run_started_at"), F.col("finished_at").alias("run_finished_at"),
        F.try_divide(F.expr("timestampdiff(SECOND, started_at, finished_at)").cast("double"), F.lit(60.0)).alias("duration_minutes"),
        "steps", "failed_steps", "code_revisions", "last_error",
        *[F.coalesce(f"{s}_results", F.lit(0)).cast("bigint").alias(f"{s}_results") for s in ("pass", "warn", "fail")])


def pass_rates(results: DataFrame, attribute: str = "quality_attribute", kind: str = "check_kind") -> DataFrame:
    """Q-36: share of passing tests per attribute; NULL, not 0, where there is no test."""
    test = F.col(kind) == "test"
    return results.groupBy(attribute).agg(
        F.count("*").alias("results"), F.count_if(test).alias("tests"),
        F.count_if(test & (F.col("status") == "PASS")).alias("passed")).withColumn(
        "pass_rate", F.try_divide(F.col("passed").cast("double"), F.when(F.col("tests") > 0, F.col("tests"))))
