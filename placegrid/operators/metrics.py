"""Ratios per place behind a coverage gate (A-1 to A-5).

Facts use the package's column names: ``entity_id, period, level_code, place_code, sector, match_status,
annex_status, is_offered, learner_count``; ``plans.names`` maps other names onto them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from placegrid import rules

PLACE_COLUMNS = ("place_code", "place_name", "place_type", "province_code", "province_name", "region_code", "region_name")
ANNEX = "Annex/Extension School"


def ratio(part: Column, whole: Column) -> Column:
    """NULL, never an error, when the denominator is 0 or unknown."""
    return F.try_divide(part.cast("double"), F.when(whole != 0, whole))


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(F.lit(100.0) * part, F.when(whole != 0, whole))


def regular_places(places: DataFrame) -> DataFrame:
    return places.filter(F.col("member_type") == "regular").select(*PLACE_COLUMNS)


def in_scope(fact: DataFrame, period: str, sector: str = "Public") -> DataFrame:
    """Matched rows of one period and sector: literal filters, so they reach the scan."""
    return fact.filter((F.col("period") == period) & (F.col("sector") == sector) & (F.col("match_status") == "matched"))


def entity_rollup(fact: DataFrame, by: Sequence[str] = ("entity_id", "place_code"), annex: str = ANNEX) -> DataFrame:
    """A-1: active, incomplete, blank and complete total of each entity, from its levels.

    Active: an offered level with learners. Incomplete: an offered level without a count. Blank: offers something,
    and every offered count is missing.
    """
    offered, known = F.col("is_offered"), F.col("learner_count").isNotNull()
    return fact.groupBy(*by).agg(
        F.coalesce(F.bool_or(offered & (F.col("learner_count") > 0)), F.lit(False)).alias("is_active"),
        F.count_if(offered & ~known).alias("incomplete_levels"),
        ((F.count_if(offered) > 0) & (F.count_if(offered & known) == 0)).alias("is_blank"),
        F.coalesce(F.bool_or(F.col("annex_status") == annex), F.lit(False)).alias("is_annex"),
        F.sum(F.when(offered & known, F.col("learner_count")).otherwise(0)).cast("bigint").alias("complete_learners"),
    )


def first_reason(cases: Sequence[tuple[Column, str]]) -> Column:
    """The first reason that holds, NULL when none does."""
    expr = None
    for condition, text in cases:
        condition = F.coalesce(condition, F.lit(False))
        expr = F.when(condition, text) if expr is None else expr.when(condition, text)
    return expr


def coverage_gated(df: DataFrame, reasons: Sequence[tuple[Column, str]], prefix: str = "") -> DataFrame:
    """A-2: ``not_assessed_reason`` from ordered rules; ``is_assessed`` when none applies."""
    return (df.withColumn(f"{prefix}not_assessed_reason", first_reason(reasons))
            .withColumn(f"{prefix}is_assessed", F.col(f"{prefix}not_assessed_reason").isNull()))


def zero_filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in columns})


def school_age(population: DataFrame, ages: tuple[int, int] = rules.SCHOOL_AGES) -> DataFrame:
    return population.filter(F.col("sex").isin("male", "female") & F.col("age").between(*ages))


def provision(places: DataFrame, fact: DataFrame, population: DataFrame, period: str, population_year: int,
              threshold: float = rules.COVERAGE_THRESHOLD, annex: str = ANNEX) -> DataFrame:
    """A-3: learners, and school-age residents, per active entity of each place."""
    active, complete = F.col("is_active"), F.col("incomplete_levels") == 0
    counts = entity_rollup(in_scope(fact, period), annex=annex).groupBy("place_code").agg(
        F.count_if(active).alias("active_count"),
        F.count_if(active & F.col("is_annex")).alias("annex_count"),
        F.count_if(active & complete).alias("complete_count"),
        F.count_if(active & ~complete).alias("incomplete_count"),
        F.count_if(F.col("is_blank")).alias("blank_count"),
        F.sum(F.when(active & complete, F.col("complete_learners")).otherwise(0)).alias("public_enrollment"))
    residents = (school_age(population).filter(
        (F.col("reference_year") == population_year) & (F.col("match_status") == "matched"))
        .groupBy("place_code").agg(F.sum("population").cast("bigint").alias("school_age_population")))
    joined = regular_places(places).join(counts, "place_code", "left").join(residents, "place_code", "left")
    measured = zero_filled(joined, ["active_count", "annex_count", "complete_count", "incomplete_count", "blank_count",
                                    "public_enrollment"]).withColumns({
        "period": F.lit(period),
        "learners_per_school": ratio(F.col("public_enrollment"), F.col("complete_count")),
        "residents_per_school": ratio(F.col("school_age_population"), F.col("active_count")),
        "coverage_pct": percent(F.col("complete_count"), F.col("active_count") + F.col("blank_count"))})
    return coverage_gated(measured, [
        (F.col("active_count") == 0, rules.NO_ACTIVE), (F.col("learners_per_school").isNull(), rules.NO_COMPLETE),
        (F.col("coverage_pct") < threshold, rules.LOW_COVERAGE)])


def capacity_screen(places: DataFrame, fact: DataFrame, rooms: DataFrame, period: str, screen: float = rules.ROOM_SCREEN,
                    threshold: float = rules.COVERAGE_THRESHOLD) -> DataFrame:
    """A-4: entities at or above ``screen`` learners per room, and their learners' share, per place."""
    capacity = rooms.filter(F.col("period") == period).select("entity_id", "rooms")
    active, complete = F.col("is_active"), F.col("incomplete_levels") == 0
    learners, n_rooms = F.col("complete_learners"), F.col("rooms")
    usable = F.coalesce(active & complete & (n_rooms > 0), F.lit(False))
    above = F.coalesce(usable & (ratio(learners, n_rooms) >= screen), F.lit(False))

    def total(condition: Column, value: Column) -> Column:
        return F.sum(F.when(condition, value).otherwise(0))

    counts = entity_rollup(in_scope(fact, period)).join(capacity, "entity_id", "left").groupBy("place_code").agg(
        F.count_if(active).alias("active_count"),
        F.count_if(active & (n_rooms > 0)).alias("usable_room_count"),
        F.count_if(usable).alias("ratio_count"),
        F.count_if(active & ~complete).alias("incomplete_count"),
        F.count_if(F.col("is_blank")).alias("blank_count"),
        F.count_if(active & n_rooms.isNull()).alias("missing_room_count"),
        F.count_if(active & (n_rooms == 0)).alias("zero_room_count"),
        total(active & complete, learners).alias("public_enrollment"),
        total(usable, learners).alias("eligible_learners"),
        total(usable, n_rooms).alias("reported_rooms"),
        F.count_if(above).alias("congested_count"),
        total(above, learners).alias("congested_learners"))
    numbers = [c for c in counts.columns if c != "place_code"]
    measured = zero_filled(regular_places(places).join(counts, "place_code", "left"), numbers).withColumns({
        "period": F.lit(period),
        "learners_per_room": ratio(F.col("eligible_learners"), F.col("reported_rooms")),
        "congested_share_pct": percent(F.col("congested_learners"), F.col("public_enrollment")),
        "school_coverage_pct": percent(F.col("ratio_count"), F.col("active_count") + F.col("blank_count")),
        "learner_coverage_pct": percent(F.col("eligible_learners"), F.col("public_enrollment"))})
    gated = coverage_gated(measured, [
        (F.col("active_count") == 0, rules.NO_ACTIVE), (F.col("learners_per_room").isNull(), rules.NO_ROOMS),
        (F.col("learner_coverage_pct") < threshold, rules.LOW_LEARNER_COVERAGE)])
    return gated.withColumn("benchmark_status", screen_status(F.col("is_assessed"), F.col("congested_count")))


def screen_status(assessed: Column, congested: Column) -> Column:
    return (F.when(~assessed, "not assessed").when(congested > 0, "reported congestion identified")
            .otherwise("no reported congestion identified"))


def level_grid(places: DataFrame, fact: DataFrame, teachers: DataFrame, period: str, levels: Sequence[str],
               threshold: float = rules.COVERAGE_THRESHOLD, annex: str = ANNEX) -> DataFrame:
    """A-5, long form: one row per place and level, with its own gate.

    An annex level with zero teachers keeps its learners in the numerator and adds nothing to the denominator.
    """
    scoped = in_scope(fact, period)
    alive = entity_rollup(scoped, by=("entity_id",)).filter(F.col("is_active") | F.col("is_blank")).select("entity_id")
    staff = teachers.filter(F.col("period") == period).select("entity_id", "level_code", "teacher_count")
    learners, staffed = F.col("learner_count"), F.col("teacher_count")
    usable = F.coalesce((staffed > 0) & learners.isNotNull(), F.lit(False))
    zero_annex = F.coalesce((F.col("annex_status") == annex) & (staffed == 0) & learners.isNotNull(), F.lit(False))

    def total(condition: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))

    counts = (scoped.filter("is_offered").join(alive, "entity_id", "left_semi")
              .join(staff, ["entity_id", "level_code"], "left")
              .groupBy("place_code", "level_code").agg(
        F.count("*").alias("offered_count"),
        F.count_if(learners.isNull()).alias("incomplete_count"),
        F.count_if(usable).alias("usable_count"),
        F.count_if(zero_annex).alias("zero_annex_count"),
        total(zero_annex, learners).alias("zero_annex_learners"),
        F.coalesce(F.sum(learners), F.lit(0)).alias("public_enrollment"),
        total(usable | zero_annex, learners).alias("eligible_learners"),
        total(usable, staffed).alias("teacher_count")))
    numbers = [c for c in counts.columns if c not in ("place_code", "level_code")]
    grid = regular_places(places).withColumn("level_code", F.explode(F.array(*[F.lit(v) for v in levels])))
    measured = zero_filled(grid.join(counts, ["place_code", "level_code"], "left"), numbers).withColumns({
        "learners_per_teacher": ratio(F.col("eligible_learners"), F.col("teacher_count")),
        "school_coverage_pct": percent(F.col("usable_count"), F.col("offered_count")),
        "learner_coverage_pct": percent(F.col("eligible_learners"), F.col("public_enrollment"))})
    return measured.withColumn("passes_gate", level_passes(threshold))


def level_passes(threshold: float = rules.COVERAGE_THRESHOLD) -> Column:
    return F.coalesce((F.col("offered_count") > 0) & F.col("learners_per_teacher").isNotNull()
                      & (F.col("learner_coverage_pct") >= threshold), F.lit(False))


LEVEL_MEASURES = ("offered_count", "incomplete_count", "usable_count", "zero_annex_count", "zero_annex_learners",
                  "public_enrollment", "eligible_learners", "teacher_count", "learners_per_teacher",
                  "school_coverage_pct", "learner_coverage_pct", "passes_gate", "benchmark_status")


def reference_status(ratio_col: Column, offered: Column, passes: Column, reference: Column | float) -> Column:
    """Exclusive threshold: a level exactly at its reference is not above it."""
    return (F.when(offered == 0, "not applicable").when(~passes, "not assessed")
            .when(ratio_col > reference, "above reference").otherwise("at or below reference"))


def with_references(grid: DataFrame, references: Mapping[str, float]) -> DataFrame:
    table = F.create_map(*[F.lit(x) for item in references.items() for x in item])
    return grid.withColumn("reference", F.try_element_at(table, "level_code")).withColumn(
        "benchmark_status", reference_status(F.col("learners_per_teacher"), F.col("offered_count"),
                                             F.col("passes_gate"), F.col("reference")))


def level_pressure(places: DataFrame, fact: DataFrame, teachers: DataFrame, period: str,
                   references: Mapping[str, float] = rules.TEACHER_REFERENCES,
                   threshold: float = rules.COVERAGE_THRESHOLD, annex: str = ANNEX) -> DataFrame:
    """A-5: the levels side by side. Assessed only when all offered levels pass; a level above its reference signals
    even when another offered level fails its gate."""
    grid = with_references(level_grid(places, fact, teachers, period, list(references), threshold, annex), references)
    above = F.col("benchmark_status") == "above reference"
    summary = [
        F.count_if(F.col("offered_count") > 0).alias("offered_level_count"),
        F.count_if((F.col("offered_count") > 0) & F.col("passes_gate")).alias("passing_level_count"),
        F.count_if(above).alias("pressured_level_count"),
        F.sum(F.when(above, F.col("eligible_learners")).otherwise(0)).cast("bigint").alias("pressured_learners")]
    wide = [F.max(F.when(F.col("level_code") == level, F.col(m))).alias(f"{level.lower()}_{m}")
            for level in references for m in LEVEL_MEASURES]
    out = grid.groupBy(*PLACE_COLUMNS).agg(*summary, *wide).withColumn("period", F.lit(period))
    offered, passing = F.col("offered_level_count"), F.col("passing_level_count")
    return coverage_gated(out, [(offered == 0, rules.NO_LEVEL), (passing < offered, rules.LOW_LEVEL_COVERAGE)]).withColumn(
        "benchmark_status", F.when(offered == 0, "not assessed")
        .when(F.col("pressured_level_count") > 0, "pressure signal identified")
        .when(passing < offered, "not fully assessed").otherwise("no pressure signal identified"))
