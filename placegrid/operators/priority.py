"""Priority categories, their order, and the run without suspected outliers (A-9 to A-15)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from placegrid import rules
from placegrid.operators.metrics import (LEVEL_MEASURES, PLACE_COLUMNS, coverage_gated, level_passes, percent, ratio,
                                         regular_places, screen_status, with_references, zero_filled)
from placegrid.operators.quantiles import exact_quantiles
from placegrid.operators.scale import position_in_order


def category(pressures: Column, growing: Column, fully_assessed: Column) -> Column:
    """A-9: a known pressure always counts; unknown growth never raises a category."""
    grows = F.coalesce(growing, F.lit(False))
    first, second, third, monitor, none, review = rules.PRIORITY_CATEGORIES
    return (F.when((pressures == 0) & (growing.isNull() | ~fully_assessed), review)
            .when((pressures == 2) & grows, first)
            .when((pressures == 2) | ((pressures == 1) & grows), second)
            .when(pressures == 1, third).when(grows, monitor).otherwise(none))


def category_order(col: Column) -> Column:
    expr = None
    for i, label in enumerate(rules.PRIORITY_CATEGORIES, 1):
        expr = F.when(col == label, i) if expr is None else expr.when(col == label, i)
    return expr


def rank_places(df: DataFrame, name: str, columns: Mapping[str, str] | None = None, code: str = "place_code") -> DataFrame:
    """A-10: category order, then seven tie-breakers with spelled-out null order; a total order."""
    c = {k: k for k in ("priority_category", "pressure_count", "affected_learners", "room_affected_learners",
                        "pressured_level_count", "public_change", "public_change_pct")} | dict(columns or {})
    order = [category_order(F.col(c["priority_category"])).asc()]
    order += [F.col(c[k]).desc_nulls_last() for k in ("pressure_count", "affected_learners", "room_affected_learners",
                                                      "pressured_level_count", "public_change", "public_change_pct")]
    return position_in_order(df, [*order, F.col(code).asc()], name)


def classify(df: DataFrame) -> DataFrame:
    """Flags, pressure count, affected learners and category from the answers' columns."""
    flag = lambda condition: F.when(F.coalesce(condition, F.lit(False)), 1).otherwise(0)
    flagged = df.withColumns({
        "room_flag": flag(F.col("room_assessed") & (F.col("room_affected_count") > 0)),
        "teacher_flag": flag(F.col("pressured_level_count") > 0)})
    full = F.coalesce(F.col("room_assessed"), F.lit(False)) & F.coalesce(F.col("teacher_assessed"), F.lit(False))
    return flagged.withColumns({
        "pressure_count": F.col("room_flag") + F.col("teacher_flag"),
        "affected_learners": F.greatest(F.coalesce("room_affected_learners", F.lit(0)),
                                        F.coalesce("teacher_affected_learners", F.lit(0))),
        "priority_category": category(F.col("room_flag") + F.col("teacher_flag"), F.col("is_growing"), full)})


def priority_matrix(places: DataFrame, provision: DataFrame, screen: DataFrame, levels: DataFrame, trend: DataFrame,
                    gap_period: str) -> DataFrame:
    """A-9/A-10: one row per regular place with its signals, category and order."""
    a1 = provision.select("place_code", F.col("learners_per_school"), F.col("coverage_pct").alias("provision_coverage_pct"),
                          F.col("is_assessed").alias("provision_assessed"), F.col("public_enrollment"))
    a2 = screen.select("place_code", "learners_per_room", F.col("learner_coverage_pct").alias("room_coverage_pct"),
                       F.col("is_assessed").alias("room_assessed"), F.col("congested_count").alias("room_affected_count"),
                       F.col("congested_learners").alias("room_affected_learners"),
                       F.col("congested_share_pct").alias("room_affected_share_pct"))
    a3 = levels.select("place_code", F.col("is_assessed").alias("teacher_assessed"),
                       F.col("benchmark_status").alias("teacher_status"), "pressured_level_count",
                       F.col("pressured_learners").alias("teacher_affected_learners"))
    # latest period and gap period of the trend in one pass over it
    latest, gap = F.col("period") == F.col("latest_period"), F.col("period") == gap_period
    pick = lambda when, c: F.max(F.when(when, F.col(c)))
    a4 = trend.filter((F.col("period") == F.col("latest_period")) | gap).groupBy("place_code").agg(
        pick(latest, "first_public").alias("first_public"), pick(latest, "latest_public").alias("latest_public"),
        pick(latest, "public_change").alias("public_change"),
        (100 * pick(latest, "public_change_share")).alias("public_change_pct"),
        pick(latest, "public_trend").alias("public_trend"), pick(latest, "endpoints_complete").alias("endpoints_complete"),
        pick(latest, "is_geography_comparable").alias("is_geography_comparable"),
        pick(gap, "population_gap").alias("population_gap"), (100 * pick(gap, "gap_share")).alias("gap_pct"),
        pick(gap, "school_age_population").alias("_gap_population"), F.count_if(latest).alias("_trend_rows"))
    joined = (regular_places(places).join(a1, "place_code", "left").join(a2, "place_code", "left")
              .join(a3, "place_code", "left").join(a4, "place_code", "left"))
    comparable = F.coalesce("is_geography_comparable", F.lit(False))
    joined = joined.withColumns({
        "is_growing": F.when(comparable & F.col("public_trend").isNotNull(), F.col("public_trend") == "increasing"),
        "growth_not_assessed_reason": F.when(F.coalesce("_trend_rows", F.lit(0)) == 0, "no enrollment trend row")
        .when(comparable & F.col("public_trend").isNotNull(), F.lit(None).cast("string"))
        .when(~comparable & F.col("_gap_population").isNull(), "no census population row")
        .when(~comparable, "boundary changed between censuses")
        .when(~F.coalesce("endpoints_complete", F.lit(False)), "public enrollment incomplete in first or latest period")
        .otherwise("no public enrollment in first period")}).drop("_gap_population", "_trend_rows")
    return rank_places(classify(joined), "priority_order")


def tukey_fences(df: DataFrame, by: Sequence[str], value: str, factor: float = rules.FENCE_FACTOR,
                 min_group: int = rules.FENCE_MIN_GROUP) -> DataFrame:
    """A-11: exact quartiles and outer fences per group; no fence for a group under ``min_group``."""
    q = exact_quantiles(df, by, value, {"q1": 0.25, "q3": 0.75}).withColumnRenamed("n", "fence_group_size")
    spread = F.col("q3") - F.col("q1")
    enough = F.col("fence_group_size") >= min_group
    return q.withColumns({"iqr": spread, "lower_fence": F.when(enough, F.col("q1") - factor * spread),
                          "upper_fence": F.when(enough, F.col("q3") + factor * spread)})


def flag_outliers(df: DataFrame, by: Sequence[str], value: str, one_sided: Column, **fence) -> DataFrame:
    """A-11: above or below the fences; a one-sided measure is only suspected when above."""
    joined = df.join(tukey_fences(df, by, value, **fence), list(by))
    above = F.coalesce(F.col(value) > F.col("upper_fence"), F.lit(False))
    below = F.coalesce(F.col(value) < F.col("lower_fence"), F.lit(False))
    return joined.withColumns({"is_above": above, "is_below": below,
                               "is_suspected": above | (below & ~one_sided)})


def entity_ratios(places: DataFrame, fact: DataFrame, rooms: DataFrame, teachers: DataFrame, period: str,
                  annex: str) -> DataFrame:
    """The ratio population of the two screens: rooms per entity, teachers per entity and level."""
    from placegrid.operators.metrics import entity_rollup, in_scope

    scoped = in_scope(fact, period)
    kinds = regular_places(places).select("place_code", "place_type")
    entities = entity_rollup(scoped, annex=annex)
    room = (entities.filter(F.col("is_active") & (F.col("incomplete_levels") == 0))
            .join(rooms.filter((F.col("period") == period) & (F.col("rooms") > 0)).select("entity_id", "rooms"), "entity_id")
            .select("entity_id", "place_code", F.lit("room").alias("measure"), F.lit("ALL").alias("level_code"),
                    F.col("complete_learners").alias("learners"), F.col("rooms").cast("bigint").alias("denominator")))
    alive = entities.filter(F.col("is_active") | F.col("is_blank")).select("entity_id").distinct()
    staff = teachers.filter((F.col("period") == period) & (F.col("teacher_count") > 0)).select("entity_id", "level_code", "teacher_count")
    teacher = (scoped.filter(F.col("is_offered") & F.col("learner_count").isNotNull()).join(alive, "entity_id", "left_semi")
               .join(staff, ["entity_id", "level_code"])
               .select("entity_id", "place_code", F.lit("teacher").alias("measure"), "level_code",
                       F.col("learner_count").alias("learners"), F.col("teacher_count").cast("bigint").alias("denominator")))
    return (room.unionByName(teacher).join(kinds, "place_code")
            .withColumn("ratio", F.col("learners").cast("double") / F.col("denominator")))


def outlier_flags(places: DataFrame, fact: DataFrame, rooms: DataFrame, teachers: DataFrame, period: str,
                  annex: str, min_group: int = rules.FENCE_MIN_GROUP) -> DataFrame:
    """A-11 over both screens; room ratios are one-sided, teacher ratios two-sided."""
    ratios = entity_ratios(places, fact, rooms, teachers, period, annex)
    return flag_outliers(ratios, ["measure", "level_code", "place_type"], "ratio", F.col("measure") == "room",
                         min_group=min_group)


def affected_entities(flags: DataFrame) -> DataFrame:
    """A-15: learners behind the flags, each entity once: its total, else its flagged parts."""
    hit, room = F.col("is_suspected"), F.col("measure") == "room"
    per_entity = flags.filter(hit).groupBy("place_code", "entity_id").agg(
        F.coalesce(F.max(F.when(room, F.col("learners"))), F.sum(F.when(~room, F.col("learners")))).alias("learners"),
        F.count_if(room).alias("rooms"), F.count_if(~room).alias("levels"))
    return per_entity.groupBy("place_code").agg(
        F.count("*").alias("outlier_count"), F.sum("learners").cast("bigint").alias("outlier_learners"),
        F.sum("rooms").cast("bigint").alias("room_outlier_count"), F.sum("levels").cast("bigint").alias("teacher_outlier_count"))


def sensitivity(matrix: DataFrame, screen: DataFrame, levels: DataFrame, flags: DataFrame, references: Mapping[str, float],
                room_screen: float = rules.ROOM_SCREEN, threshold: float = rules.COVERAGE_THRESHOLD) -> DataFrame:
    """A-12/A-13: the ratios, gates, flags, category and order again without suspected outliers, and what changed.

    Excluded entities leave numerator and denominator but stay in the coverage denominator. New columns end in
    ``_b``.
    """
    kept = flags.filter(~F.col("is_suspected"))
    above = F.col("ratio") >= room_screen
    rooms_b = kept.filter(F.col("measure") == "room").groupBy("place_code").agg(
        F.count("*").alias("ratio_count_b"), F.sum("learners").alias("eligible_b"), F.sum("denominator").alias("rooms_b"),
        F.count_if(above).alias("congested_b"), F.sum(F.when(above, F.col("learners")).otherwise(0)).alias("congested_learners_b"))
    numbers = ["ratio_count_b", "eligible_b", "rooms_b", "congested_b", "congested_learners_b"]
    room = zero_filled(screen.select("place_code", "public_enrollment", "active_count").join(rooms_b, "place_code", "left"), numbers)
    room = room.select(
        "place_code", "ratio_count_b", F.col("eligible_b").alias("room_eligible_b"), F.col("rooms_b").alias("reported_rooms_b"),
        ratio(F.col("eligible_b"), F.col("rooms_b")).alias("learners_per_room_b"),
        percent(F.col("eligible_b"), F.col("public_enrollment")).alias("room_coverage_pct_b"),
        F.col("congested_b").alias("room_affected_count_b"), F.col("congested_learners_b").alias("room_affected_learners_b"),
        percent(F.col("congested_learners_b"), F.col("public_enrollment")).alias("room_affected_share_pct_b"),
        F.coalesce((F.col("active_count") > 0) & (F.col("eligible_b") > 0)
                   & (percent(F.col("eligible_b"), F.col("public_enrollment")) >= threshold), F.lit(False)).alias("room_assessed_b"))
    staff_b = kept.filter(F.col("measure") == "teacher").groupBy("place_code", "level_code").agg(
        F.sum("learners").alias("_learners"), F.sum("denominator").alias("_teachers"))
    packs = F.array(*[F.struct(
        F.lit(v).alias("level_code"), F.col(f"{v.lower()}_offered_count").alias("offered_count"),
        F.col(f"{v.lower()}_public_enrollment").alias("public_enrollment"),
        F.col(f"{v.lower()}_zero_annex_learners").alias("zero_annex_learners"),
        F.col(f"{v.lower()}_learner_coverage_pct").alias("published_coverage_pct")) for v in references])
    again = levels.select("place_code", F.explode(packs).alias("_l")).select("place_code", "_l.*").join(
        staff_b, ["place_code", "level_code"], "left")
    again = again.withColumns({
        "eligible_learners": F.coalesce("_learners", F.lit(0)) + F.coalesce("zero_annex_learners", F.lit(0)),
        "teacher_count": F.coalesce("_teachers", F.lit(0))}).withColumns({
        "learners_per_teacher": ratio(F.col("eligible_learners"), F.col("teacher_count")),
        "learner_coverage_pct": percent(F.col("eligible_learners"), F.col("public_enrollment"))})
    again = with_references(again.withColumn("passes_gate", level_passes(threshold)), references)
    hit, offered = F.col("benchmark_status") == "above reference", F.col("offered_count") > 0
    wide = [F.max(F.when(F.col("level_code") == v, F.col(m))).alias(f"{v.lower()}_{m}_b") for v in references
            for m in ("eligible_learners", "teacher_count", "learners_per_teacher", "learner_coverage_pct", "passes_gate",
                      "benchmark_status")]
    teacher = again.groupBy("place_code").agg(
        ((F.count_if(offered) > 0) & (F.count_if(offered & ~F.col("passes_gate")) == 0)).alias("teacher_assessed_b"),
        F.count_if(hit).alias("pressured_level_count_b"),
        F.sum(F.when(hit, F.col("eligible_learners")).otherwise(0)).cast("bigint").alias("teacher_affected_learners_b"),
        F.min(F.when(offered, F.col("published_coverage_pct"))).alias("lowest_coverage_pct"),
        F.min(F.when(offered, F.col("learner_coverage_pct"))).alias("lowest_coverage_pct_b"), *wide)
    joined = (matrix.join(affected_entities(flags), "place_code", "left").join(room, "place_code", "left")
              .join(teacher, "place_code", "left"))
    joined = zero_filled(joined, ["outlier_count", "outlier_learners", "room_outlier_count", "teacher_outlier_count",
                                  "pressured_level_count_b"])
    flag = lambda condition: F.when(F.coalesce(condition, F.lit(False)), 1).otherwise(0)
    assessed_b = lambda c: F.coalesce(F.col(c), F.lit(False))
    joined = joined.withColumns({
        "room_assessed_b": assessed_b("room_assessed_b"), "teacher_assessed_b": assessed_b("teacher_assessed_b"),
        "room_flag_b": flag(F.col("room_assessed_b") & (F.col("room_affected_count_b") > 0)),
        "teacher_flag_b": flag(F.col("pressured_level_count_b") > 0)}).withColumns({
        "pressure_count_b": F.col("room_flag_b") + F.col("teacher_flag_b"),
        "affected_learners_b": F.greatest(F.coalesce("room_affected_learners_b", F.lit(0)),
                                          F.coalesce("teacher_affected_learners_b", F.lit(0))),
        "priority_category_b": category(F.col("room_flag_b") + F.col("teacher_flag_b"), F.col("is_growing"),
                                        F.col("room_assessed_b") & F.col("teacher_assessed_b"))})
    ranked = rank_places(joined, "priority_order_b", {
        "priority_category": "priority_category_b", "pressure_count": "pressure_count_b",
        "affected_learners": "affected_learners_b", "room_affected_learners": "room_affected_learners_b",
        "pressured_level_count": "pressured_level_count_b"})
    return ranked.withColumns(changes()).withColumn("sensitivity_status", sensitivity_status())


def changes() -> dict[str, Column]:
    before, after = F.col("affected_learners"), F.col("affected_learners_b")
    lost = lambda a, b: F.coalesce(F.col(a), F.lit(False)) & ~F.col(b)
    return {
        "room_flag_changed": F.col("room_flag") != F.col("room_flag_b"),
        "teacher_flag_changed": F.col("teacher_flag") != F.col("teacher_flag_b"),
        "category_changed": F.col("priority_category") != F.col("priority_category_b"),
        "coverage_gate_changed": lost("room_assessed", "room_assessed_b") | lost("teacher_assessed", "teacher_assessed_b"),
        "affected_changed": F.when(before > 0, F.abs(after - before) > rules.MAGNITUDE_CHANGE * before).otherwise(after > 0)}


def sensitivity_status() -> Column:
    """A-13: the most serious change first."""
    none, by_category, by_flag, by_gate, by_size, stable = rules.SENSITIVITY_STATUSES
    return (F.when(F.col("outlier_count") == 0, none).when(F.col("category_changed"), by_category)
            .when(F.col("room_flag_changed") | F.col("teacher_flag_changed"), by_flag)
            .when(F.col("coverage_gate_changed"), by_gate).when(F.col("affected_changed"), by_size).otherwise(stable))


SCENARIO_COLUMNS = ("priority_category", "priority_order", "room_flag", "teacher_flag", "pressure_count", "affected_learners",
                    "learners_per_room", "room_coverage_pct", "room_assessed", "room_affected_count",
                    "room_affected_learners", "room_affected_share_pct", "teacher_assessed", "pressured_level_count",
                    "teacher_affected_learners")


def scenarios(sensitivity_rows: DataFrame, keep: Sequence[str] = ("outlier_count", "sensitivity_status", "coverage_gate_changed")) -> DataFrame:
    """A-14: both scenarios as rows of the same columns."""
    published = F.struct(F.lit("published").alias("scenario"), *[F.col(c).alias(c) for c in SCENARIO_COLUMNS])
    types = {f.name: f.dataType for f in sensitivity_rows.schema.fields}
    cast = F.struct(F.lit("without suspected outliers").alias("scenario"),
                    *[F.col(f"{c}_b").cast(types[c]).alias(c) for c in SCENARIO_COLUMNS])
    return sensitivity_rows.select("place_code", *keep, F.explode(F.array(published, cast)).alias("_s")).select(
        "place_code", "_s.*", *keep)
