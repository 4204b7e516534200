"""Profiles of a table and comparisons between tables and periods (P-1 to P-17)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from placegrid.operators.quantiles import exact_quantiles


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """P-1: per column rows, filled, distinct, zeros and minimum and maximum as text.

    All columns are counted as (column, value) pairs first; equal values combine before the shuffle, so neither a
    wide table nor a constant column becomes one task's work.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    values = df.select(F.inline(pairs)).groupBy("column_name", "value").agg(F.count("*").alias("_n"))
    filled = F.col("value").isNotNull() & (F.col("value") != "")
    number = F.col("value").try_cast("double")
    count = lambda w: F.coalesce(F.sum(F.when(w, F.col("_n"))), F.lit(0)).cast("bigint")
    kind = F.when(F.count_if(filled) == 0, "empty").when(F.count_if(filled & number.isNull()) == 0, "number").otherwise("text")
    return values.groupBy("column_name").agg(
        F.sum("_n").cast("bigint").alias("rows"), count(filled).alias("filled"), F.count_if(filled).alias("distinct_values"),
        count(filled & (number == 0)).alias("zeros"), kind.alias("kind"), F.min(number).alias("min_number"), F.max(number).alias("max_number"))


def column_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """P-1: exact medians of several numeric columns at once."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns])
    return exact_quantiles(df.select(F.inline(pairs)), ["column_name"], "value", {"median": 0.5})


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """P-1: the k most frequent values, ties by value; a bounded top-k, not a sort of the table."""
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("rows")).orderBy(
        F.col("rows").desc(), F.col("value").asc_nulls_last()).limit(k)


def key_profile(df: DataFrame, key: str, pattern: str, length: int) -> DataFrame:
    """P-2: blank, malformed, wrong length and repeated keys, and fully repeated rows."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    keys = df.groupBy(text.alias("_k")).agg(F.count("*").alias("_n"))
    filled = F.col("_k") != ""
    total = lambda w, v="_n": F.coalesce(F.sum(F.when(w, F.col(v))), F.lit(0)).cast("bigint")
    per_key = keys.agg(total(F.lit(True)).alias("rows"), total(~filled).alias("blank"), total(filled & ~F.col("_k").rlike(pattern)).alias("malformed"),
                       total(filled & (F.length("_k") != length)).alias("wrong_length"), F.count_if(filled & (F.col("_n") > 1)).alias("repeated_keys"))
    extra = df.groupBy(*df.columns).agg((F.count("*") - 1).alias("_x")).agg(F.coalesce(F.sum("_x"), F.lit(0)).cast("bigint")).scalar()
    return per_key.withColumn("repeated_rows", extra)


def count_checks(df: DataFrame, columns: Sequence[str], offered: Column | None = None) -> DataFrame:
    """P-3: cells that are not whole numbers, negative, or filled where nothing is offered."""
    pack = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns])
    rows = df.select((F.lit(True) if offered is None else offered).alias("_on"), F.inline(pack))
    v = F.col("v")
    return rows.groupBy("column_name").agg(
        F.count_if(v.isNotNull() & (v != "") & ~v.rlike("^-?[0-9]+$")).alias("not_whole"),
        F.count_if(F.coalesce(v.startswith("-"), F.lit(False))).alias("negative"),
        F.count_if(~F.col("_on") & v.isNotNull() & (v != "")).alias("filled_not_offered"))


def totals_by(df: DataFrame, value: Column, categories: Sequence[str]) -> DataFrame:
    """P-4: the grand total and totals per category value; one scan, each row once per category."""
    packs = F.array(F.struct(F.lit("all").alias("category"), F.lit("all").alias("member")),
                    *[F.struct(F.lit(c).alias("category"), F.col(c).cast("string").alias("member")) for c in categories])
    return df.select(value.alias("_v"), F.inline(packs)).groupBy("category", "member").agg(
        F.count("*").alias("rows"), F.sum("_v").alias("total"))


def schema_diff(before: Sequence[str], after: Sequence[str]) -> dict[str, object]:
    """P-5: columns added and removed, and whether the kept ones changed order."""
    kept_before, kept_after = [c for c in before if c in after], [c for c in after if c in before]
    return {"added": [c for c in after if c not in before], "removed": [c for c in before if c not in after],
            "reordered": kept_before != kept_after}


def label_inventory(df: DataFrame, period: Column, columns: Sequence[str]) -> DataFrame:
    """P-6: every label of every column per period."""
    packs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("label")) for c in columns])
    return df.select(period.alias("period"), F.inline(packs)).groupBy("period", "column_name", "label").agg(F.count("*").alias("rows"))


def label_drift(before: DataFrame, after: DataFrame, key: str, label: str) -> DataFrame:
    """P-7: cross-tabulation of a label on the keys both periods have (one row per key on each side)."""
    return before.select(key, F.col(label).alias("label_before")).join(after.select(key, F.col(label).alias("label_after")), key).groupBy(
        "label_before", "label_after").agg(F.count("*").alias("keys"))


def roster(df: DataFrame, key: str, period: Column, periods: Sequence[int]) -> DataFrame:
    """P-8: per key where it appears: kept, dropped, new, returned (skipped a period between), over ordered periods."""
    first, last = periods[0], periods[-1]
    seen = df.groupBy(key).agg(*[F.bool_or(period == p).alias(f"_s{p}") for p in periods])
    at = lambda p: F.col(f"_s{p}")
    middle = F.lit(True)
    for p in periods[1:-1]:
        middle = middle & at(p)
    gone_between = F.lit(False) if len(periods) < 3 else ~middle
    return seen.withColumn("roster", F.when(at(first) & at(last) & gone_between, "returned").when(at(first) & at(last), "kept")
                           .when(at(first), "dropped").when(at(last), "new").otherwise("between")).drop(*[f"_s{p}" for p in periods])


def place_changes(before: DataFrame, after: DataFrame, key: str, place: str, normalized: str) -> DataFrame:
    """P-9: same, spelling only, or another place, on kept keys."""
    b = before.select(key, F.col(place).alias("_b"), F.col(normalized).alias("_nb"))
    a = after.select(key, F.col(place).alias("_a"), F.col(normalized).alias("_na"))
    return b.join(a, key).groupBy(F.when(F.col("_b").eqNullSafe(F.col("_a")), "same").when(F.col("_nb").eqNullSafe(F.col("_na")), "spelling only")
                                  .otherwise("another place").alias("change")).agg(F.count("*").alias("keys"))


def match_stability(before: DataFrame, after: DataFrame, key: str, code: str = "code") -> DataFrame:
    """P-10: same code, different code, or matched on one side only."""
    b, a = before.select(key, F.col(code).alias("_b")), after.select(key, F.col(code).alias("_a"))
    state = (F.when(F.col("_b") == F.col("_a"), "same").when(F.col("_b").isNotNull() & F.col("_a").isNotNull(), "different")
             .when(F.col("_b").isNotNull(), "only before").when(F.col("_a").isNotNull(), "only after").otherwise("neither"))
    return b.join(a, key, "full_outer").groupBy(state.alias("stability")).agg(F.count("*").alias("keys"))


def blank_patterns(df: DataFrame, groups: Mapping[str, Sequence[str]], offered: Mapping[str, Column]) -> DataFrame:
    """P-11: rows where all cells of a group are blank, and those blank while offered."""
    packs = F.array(*[F.struct(F.lit(g).alias("group_name"), F.coalesce(*[F.col(c) for c in cols]).isNull().alias("_blank"),
                               F.coalesce(offered[g], F.lit(False)).alias("_on")) for g, cols in groups.items()])
    return df.select(F.inline(packs)).groupBy("group_name").agg(
        F.count_if("_blank").alias("all_blank"), F.count_if(F.col("_blank") & F.col("_on")).alias("blank_while_offered"))


def coverage_matrix(entities: DataFrame, others: Mapping[str, DataFrame], place: str) -> DataFrame:
    """P-12: entities in places the other sources have no value for."""
    per_place = entities.groupBy(place).agg(F.count("*").alias("_n"))
    for name, other in others.items():
        per_place = per_place.join(other.select(place).distinct().withColumn(f"_{name}", F.lit(True)), place, "left")
    packs = F.array(*[F.struct(F.lit(n).alias("other_source"), F.col(f"_{n}").isNull().alias("_gap")) for n in others])
    return per_place.select("_n", F.inline(packs)).groupBy("other_source").agg(
        F.coalesce(F.sum(F.when(F.col("_gap"), F.col("_n"))), F.lit(0)).cast("bigint").alias("entities_without"), F.count_if("_gap").alias("places_without"))


def code_against_name(df: DataFrame, by_code: str, by_name: str) -> DataFrame:
    """P-13: agree, differ, or only one piece of evidence."""
    c, n = F.col(by_code), F.col(by_name)
    state = F.when(c == n, "agree").when(c.isNotNull() & n.isNotNull(), "differ").when(c.isNotNull(), "code only").when(n.isNotNull(), "name only").otherwise("neither")
    return df.groupBy(state.alias("evidence")).agg(F.count("*").alias("rows"))


def dependency(df: DataFrame, label: str, determined: Sequence[str]) -> DataFrame:
    """P-14: labels and how many combinations each goes with; 1 means the label determines them."""
    return df.groupBy(label, *determined).agg(F.lit(1).alias("_x")).groupBy(label).agg(F.count("*").alias("combinations"))


def geometry_inventory(df: DataFrame, geometry: str, shape_id: str) -> DataFrame:
    """P-15: shapes per type: how many, valid ones, repeated ids."""
    from placegrid.functions import geo
    from placegrid.operators import validity

    ids = df.groupBy(shape_id).agg(F.count("*").alias("_copies"))
    rows = validity.with_validity(df.withColumn("_type", geo.geometry_type(geometry)), geometry, "_valid").join(ids, shape_id)
    return rows.groupBy(F.col("_type").alias("geometry_type")).agg(
        F.count("*").alias("shapes"), F.count_if("_valid").alias("valid"), F.count_if(F.col("_copies") > 1).alias("repeated_ids"))


def recomputed_totals(df: DataFrame, first: Sequence[str], second: Sequence[str], value: Column) -> DataFrame:
    """P-16: the same grand total by two aggregation paths."""
    path = lambda keys: df.groupBy(*keys).agg(F.sum(value).alias("_s")).agg(F.sum("_s")).scalar()
    return df.sparkSession.range(1).select(path(first).alias("by_first"), path(second).alias("by_second"))


def place_list_gaps(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """P-17: places only one list has, and values that differ where both have one."""
    left, right = a.select(key, F.col(value).alias("value_a"), F.lit(True).alias("_a")), b.select(key, F.col(value).alias("value_b"), F.lit(True).alias("_b"))
    state = (F.when(F.col("_b").isNull(), "only in first").when(F.col("_a").isNull(), "only in second")
             .when(F.col("value_a").eqNullSafe(F.col("value_b")), "same value").otherwise("value differs"))
    return left.join(right, key, "full_outer").select(key, "value_a", "value_b", state.alias("state"))
