"""Checks that decide whether a candidate is published (Q-1 to Q-25).

A check is one row: ``check_name, status (PASS | WARN | FAIL), expected, actual``. All checks over one table are a
single aggregate, so a gate costs one pass however many checks it holds; only check rows reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from placegrid import rules


class GateFailed(RuntimeError):
    pass


@dataclass(frozen=True)
class Check:
    """``actual`` is an aggregate; ``passes`` says when it is fine; ``warn_only`` never blocks."""

    name: str
    actual: Column
    passes: Callable[[Column], Column]
    expected: str
    warn_only: bool = False


def zero(name: str, bad: Column, warn_only: bool = False) -> Check:
    """No row may satisfy ``bad`` (an unknown verdict counts as bad)."""
    return Check(name, F.count_if(F.coalesce(bad, F.lit(True))), lambda a: a == 0, "0", warn_only)


def rule_holds(name: str, rule: Column, warn_only: bool = False) -> Check:
    """Q-5: every row satisfies ``rule``."""
    return Check(name, F.count_if(~F.coalesce(rule, F.lit(False))), lambda a: a == 0, "0", warn_only)


def equals(name: str, actual: Column, expected: int, warn_only: bool = False) -> Check:
    return Check(name, actual, lambda a: a == expected, str(expected), warn_only)


def at_least(name: str, actual: Column, floor: float, warn_only: bool = False) -> Check:
    return Check(name, actual, lambda a: a >= floor, f">= {floor:g}", warn_only)


def counter(name: str, hit: Column) -> Check:
    """Q-12: informational, always PASS."""
    return Check(name, F.count_if(F.coalesce(hit, F.lit(False))), lambda a: F.lit(True), "recorded")


def status_of(passes: Column, warn_only: bool) -> Column:
    return F.when(F.coalesce(passes, F.lit(False)), "PASS").otherwise("WARN" if warn_only else "FAIL")


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Q-1: all checks in one aggregate, as rows."""
    summary = df.agg(*[c.actual.alias(f"a{i}") for i, c in enumerate(checks)])
    packs = F.array(*[F.struct(
        F.lit(c.name).alias("check_name"), status_of(c.passes(F.col(f"a{i}")), c.warn_only).alias("status"),
        F.lit(c.expected).alias("expected"), F.col(f"a{i}").cast("string").alias("actual")) for i, c in enumerate(checks)])
    return summary.select(F.inline(packs))


def all_checks(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def key_checks(df: DataFrame, key: Sequence[str], name: str = "key") -> DataFrame:
    """Q-3: unique and not null; keys are counted before they are compared."""
    nulls = F.lit(False)
    for k in key:
        nulls = nulls | F.col(k).isNull()
    groups = df.groupBy(*key).agg(F.count("*").alias("_n"))
    return run_checks(groups, [
        Check(f"{name}_unique", F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n") - 1)), F.lit(0)), lambda a: a == 0, "0"),
        Check(f"{name}_not_null", F.coalesce(F.sum(F.when(nulls, F.col("_n"))), F.lit(0)), lambda a: a == 0, "0")])


def foreign_key(df: DataFrame, column: str, parent: DataFrame, parent_key: str, name: str, nulls_allowed: bool = False) -> DataFrame:
    """Q-4: rows without a parent row; a NULL key has none unless ``nulls_allowed``.

    Rows are counted per key before the join, so only one row per key meets the parent table.
    """
    keys = df.groupBy(F.col(column).alias("_k")).agg(F.count("*").alias("_n"))
    if nulls_allowed:
        keys = keys.filter(F.col("_k").isNotNull())
    orphans = keys.join(parent.select(F.col(parent_key).alias("_k")), "_k", "left_anti")
    return run_checks(orphans, [Check(name, F.coalesce(F.sum("_n"), F.lit(0)), lambda a: a == 0, "0")])


def rows_reconcile(name: str, *parts: DataFrame, whole: DataFrame) -> DataFrame:
    """Q-2: the parts' rows add up to the source's rows."""
    tagged = whole.select(F.lit(0).alias("_p"))
    for part in parts:
        tagged = tagged.unionByName(part.select(F.lit(1).alias("_p")))
    return run_checks(tagged, [Check(
        name, F.count_if(F.col("_p") == 1) - F.count_if(F.col("_p") == 0), lambda a: a == 0, "0")])


def compare_rows(candidate: DataFrame, recomputed: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Q-6: rows only one side has and null-safe differences per column, from one full outer join."""
    left, right = candidate.withColumn("_in", F.lit(True)).alias("c"), recomputed.withColumn("_in", F.lit(True)).alias("r")
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    both = F.col("c._in").isNotNull() & F.col("r._in").isNotNull()
    checks = [zero("rows_missing", F.col("c._in").isNull()), zero("rows_extra", F.col("r._in").isNull())]
    checks += [zero(f"{c}_matches", both & ~F.col(f"c.{c}").eqNullSafe(F.col(f"r.{c}"))) for c in columns]
    return run_checks(left.join(right, same, "full_outer"), checks)


def same_bag(a: DataFrame, b: DataFrame, columns: Sequence[str], name: str = "same_rows") -> DataFrame:
    """Q-7: equal as bags, both directions in one aggregate: the row counts of each content must cancel out."""
    signed = a.select(*columns, F.lit(1).alias("_s")).unionByName(b.select(*columns, F.lit(-1).alias("_s")))
    off = signed.groupBy(*columns).agg(F.sum("_s").alias("_d")).filter(F.col("_d") != 0)
    return run_checks(off, [Check(name, F.coalesce(F.sum(F.abs("_d")), F.lit(0)), lambda x: x == 0, "0")])


def totals_reconcile(a: DataFrame, b: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Q-8: grouped sums of both tables agree, a missing group included."""
    signed = a.select(*by, F.col(value).alias("_v"), F.lit(1).alias("_s")).unionByName(
        b.select(*by, F.col(value).alias("_v"), F.lit(-1).alias("_s")))
    groups = signed.groupBy(*by).agg(
        F.sum(F.when(F.col("_s") == 1, F.col("_v"))).alias("_a"), F.sum(F.when(F.col("_s") == -1, F.col("_v"))).alias("_b"))
    return run_checks(groups, [zero(name, ~F.col("_a").eqNullSafe(F.col("_b")))])


def quarantine_rate(classified: DataFrame, reasons: str, listed: Sequence[str],
                    fail_percent: float = rules.QUARANTINE_FAIL_PERCENT) -> DataFrame:
    """Q-10: WARN above 0, FAIL above ``fail_percent``; one informational row per reason."""
    summary = classified.agg(
        F.count("*").alias("n"), F.count_if(F.size(reasons) > 0).alias("bad"),
        *[F.count_if(F.array_contains(reasons, r)).alias(f"r{i}") for i, r in enumerate(listed)])
    rate = F.coalesce(F.try_divide(100.0 * F.col("bad").cast("double"), F.col("n")), F.lit(0.0))
    status = F.when(rate > fail_percent, "FAIL").when(F.col("bad") > 0, "WARN").otherwise("PASS")
    packs = [F.struct(F.lit("quarantine_rate").alias("check_name"), status.alias("status"),
                      F.lit(f"<= {fail_percent:g}%").alias("expected"), F.col("bad").cast("string").alias("actual"))]
    packs += [F.struct(F.lit(f"quarantine_reason/{r}").alias("check_name"),
                       F.when(F.col(f"r{i}") > 0, "WARN").otherwise("PASS").alias("status"),
                       F.lit("0").alias("expected"), F.col(f"r{i}").cast("string").alias("actual")) for i, r in enumerate(listed)]
    return summary.select(F.inline(F.array(*packs)))


def grouped_checks(df: DataFrame, by: Sequence[str], prefix: str, bad: Column) -> DataFrame:
    """Q-23: one check per group, named ``prefix/<group values>``."""
    groups = df.groupBy(*by).agg(F.count_if(F.coalesce(bad, F.lit(True))).alias("_bad"))
    return groups.select(F.concat_ws("/", F.lit(prefix), *[F.col(c).cast("string") for c in by]).alias("check_name"),
                         status_of(F.col("_bad") == 0, False).alias("status"), F.lit("0").alias("expected"),
                         F.col("_bad").cast("string").alias("actual"))


def match_rate_checks(df: DataFrame, by: Sequence[str], floor: float = 99.0, status: str = "match_status") -> DataFrame:
    """Q-15: FAIL below the floor, per group."""
    groups = df.groupBy(*by).agg(F.count("*").alias("_n"), F.count_if(F.col(status) == "matched").alias("_m"))
    rate = F.round(100.0 * F.col("_m").cast("double") / F.col("_n"), 4)
    return groups.select(F.concat_ws("/", F.lit("match_rate"), *[F.col(c).cast("string") for c in by]).alias("check_name"),
                         status_of(rate >= floor, False).alias("status"), F.lit(f">= {floor:g}%").alias("expected"),
                         rate.cast("string").alias("actual"))


def profile_drift(counts: DataFrame, reviewed: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Q-14/Q-15: counts that left the reviewed profile, WARN only."""
    a, b = counts.alias("a"), reviewed.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    off = a.join(b, same, "full_outer").filter(~F.col(f"a.{value}").eqNullSafe(F.col(f"b.{value}")))
    return run_checks(off, [Check(name, F.count("*"), lambda x: x == 0, "0", warn_only=True)])


def one_to_one(matched: DataFrame, target: str, name: str = "target_taken_once") -> DataFrame:
    """Q-16: no target code is matched twice."""
    twice = matched.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("_n")).filter("_n > 1")
    return run_checks(twice, [Check(name, F.count("*"), lambda a: a == 0, "0")])


def tree_closes(nodes: DataFrame, by: Sequence[str], pos: str, parent: str, value: str) -> DataFrame:
    """Q-17: children add up to their parent, every parent exists, one root."""
    sums = nodes.filter(F.col(parent).isNotNull()).groupBy(*by, parent).agg(F.sum(value).alias("_children"))
    joined = nodes.select(*by, F.col(pos).alias(parent), F.col(value).alias("_own"), F.lit(True).alias("_here")).join(
        sums, [*by, parent], "full_outer")
    per_tree = nodes.groupBy(*by).agg(F.count_if(F.col(parent).isNull()).alias("_roots"))
    return all_checks(
        run_checks(joined, [zero("children_sum_to_parent", F.col("_children").isNotNull() & F.col("_here").isNotNull()
                                 & (F.col("_children") != F.col("_own"))), zero("parent_exists", F.col("_here").isNull())]),
        run_checks(per_tree, [zero("one_root", F.col("_roots") != 1)]))


def arithmetic_holds(df: DataFrame, name: str, value: Column, recomputed: Column, tolerance: float = 1e-9) -> DataFrame:
    """Q-18: a published ratio equals its parts within tolerance, NULL together."""
    off = F.when(value.isNull() | recomputed.isNull(), ~(value.isNull() & recomputed.isNull())).otherwise(
        F.abs(value - recomputed) > tolerance)
    return run_checks(df, [zero(name, off)])


def upstream_succeeded(rows: DataFrame, ledger: DataFrame, run: str = "run_id") -> DataFrame:
    """Q-22: every run the rows come from is a succeeded build."""
    bad = rows.select(run).distinct().join(ledger.filter(F.col("status") == "succeeded").select(run), run, "left_anti")
    return run_checks(bad, [Check("upstream_runs_succeeded", F.count("*"), lambda a: a == 0, "0")])


def adds_no_rows(before: DataFrame, after: DataFrame, name: str = "join_adds_no_rows") -> DataFrame:
    """Q-21."""
    return rows_reconcile(name, after, whole=before)


def left_join_adds_no_rows(left: DataFrame, right: DataFrame, left_key: str, right_key: str, name: str = "join_adds_no_rows") -> DataFrame:
    """Q-21 before the join is run: the rows that a left join would add, from the row counts of each key."""
    lefts = left.groupBy(F.col(left_key).alias("_k")).agg(F.count("*").alias("_left"))
    rights = right.groupBy(F.col(right_key).alias("_k")).agg(F.count("*").alias("_right"))
    added = F.col("_left") * (F.coalesce(F.col("_right"), F.lit(1)) - 1)
    return run_checks(lefts.join(rights, "_k", "left"), [Check(name, F.coalesce(F.sum(added), F.lit(0)), lambda a: a == 0, "0")])


def lineage_checks(df: DataFrame, columns: Sequence[str], run_id: str, run: str = "run_id", built: str = "cleaned_at_utc") -> DataFrame:
    """Q-13: no lineage column is NULL, all rows are of this run, one timestamp."""
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    return run_checks(df, [zero("lineage_complete", missing), zero("built_by_this_run", ~F.col(run).eqNullSafe(F.lit(run_id))),
                           Check("one_timestamp", F.when(F.min(built) == F.max(built), 1).otherwise(2), lambda a: a == 1, "1")])


def stamp_checks(checks: DataFrame, **columns) -> DataFrame:
    """The identifying columns of recorded results."""
    return checks.withColumns({k: F.lit(v) for k, v in columns.items()})


def record_and_raise(checks: DataFrame, ledger_path: str | None = None, named: int = 100) -> list:
    """Q-25: append the results, then fail if this execution wrote a FAIL.

    The message names the first ``named`` failures and says how many more there are.
    """
    from placegrid.session import materialize

    checks = materialize(checks)
    if ledger_path:
        checks.write.mode("append").parquet(ledger_path)
    failures = checks.filter(F.col("status") == "FAIL")
    failed = failures.orderBy("check_name").limit(named).collect()
    if failed:
        more = failures.count() - len(failed)
        raise GateFailed("; ".join(f"{r['check_name']}: expected {r['expected']}, got {r['actual']}" for r in failed)
                         + (f"; and {more} more" if more else ""))
    return failed


def values_preserved(before: DataFrame, after: DataFrame, key: Sequence[str], pairs: Mapping[str, str]) -> DataFrame:
    """Q-9: blanks stay NULL, zeros stay 0, text is unchanged (``{after column: before column}``); a row that only one
    side has is not preserved."""
    left, right = after.withColumn("_in", F.lit(True)).alias("a"), before.withColumn("_in", F.lit(True)).alias("b")
    joined = left.join(right, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key], "full_outer")
    lost = F.col("a._in").isNull() | F.col("b._in").isNull()
    return run_checks(joined, [zero(f"{a}_preserved", lost | ~F.col(f"a.{a}").eqNullSafe(F.col(f"b.{b}"))) for a, b in pairs.items()])


def batches_reconcile(rows: DataFrame, batches: DataFrame, name: str = "succeeded_batches_reconcile", content: str = "source_sha256",
                      status: str = "status", source_rows: str = "source_rows", expected_rows: str = "expected_rows") -> DataFrame:
    """Q-24: every succeeded batch has as many rows as its file had, and the file as many as were expected.

    Rows are counted per file before they meet the batches; a count that is missing on either side is a mismatch.
    """
    counted = rows.groupBy(F.col(content).alias("_content")).agg(F.count(F.lit(1)).alias("_n"))
    met = batches.where(F.col(status) == "succeeded").join(counted, F.col(content).eqNullSafe(F.col("_content")), "left")
    right = F.coalesce((F.col("_n") == F.col(source_rows)) & (F.col(source_rows) == F.col(expected_rows)), F.lit(False))
    wrong = met.agg(F.count_if(~right).alias("_wrong"))
    return wrong.select(F.lit(name).alias("check_name"), F.when(F.col("_wrong") == 0, "PASS").otherwise("FAIL").alias("status"),
                        F.lit("0").alias("expected"), F.col("_wrong").cast("string").alias("actual"))
