"""Enrollment over time beside census population (A-6 to A-8)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from placegrid import rules
from placegrid.operators.metrics import ratio, school_age

SECTORS = ("Public", "Private", "SUC/LUC")


def entity_totals(fact: DataFrame, sectors: Sequence[str] = SECTORS) -> DataFrame:
    """One total per entity and period; NULL when an offered level, or the flag itself, is unknown."""
    unknown = F.col("is_offered").isNull() | (F.col("is_offered") & F.col("learner_count").isNull())
    return fact.filter(F.col("sector").isin(*sectors)).groupBy("period", "entity_id", "place_code", "sector").agg(
        F.when(F.count_if(unknown) == 0, F.sum(F.when(F.col("is_offered"), F.col("learner_count")).otherwise(0)))
        .alias("learners"))


def direction(latest, first):
    return F.when(latest > first, "increasing").when(latest < first, "decreasing").otherwise("no change")


def enrollment_trend(fact: DataFrame, population: DataFrame, censuses: Mapping[str, int],
                     sectors: Sequence[str] = SECTORS) -> DataFrame:
    """A-6/A-7/A-8: a dense place x period grid with adjacent-year and first-to-latest change.

    ``censuses`` pairs a period with the census year whose population it is compared with. The periods are one
    scalar array exploded per place; the windows run over a place's periods only.
    """
    public = F.col("sector") == "Public"
    known = F.col("learners").isNotNull()
    enrollment = entity_totals(fact, sectors).groupBy("period", "place_code").agg(
        F.coalesce(F.sum("learners"), F.lit(0)).cast("bigint").alias("all_enrollment"),
        F.coalesce(F.sum(F.when(public, F.col("learners"))), F.lit(0)).cast("bigint").alias("public_enrollment"),
        F.count_if(known).alias("counted"), F.count_if(~known).alias("incomplete"),
        F.count_if(public & known).alias("public_counted"), F.count_if(public & ~known).alias("public_incomplete"))
    residents = (school_age(population).filter(F.col("reference_year").isin(*censuses.values()))
                 .groupBy("place_code", F.col("reference_year").alias("census_year")).agg(
        F.sum("population").cast("bigint").alias("school_age_population"),
        F.bool_and("is_geography_comparable").alias("_comparable")))
    periods = fact.agg(F.sort_array(F.collect_set("period"))).scalar()
    grid = (enrollment.select("place_code").union(residents.select("place_code")).distinct()
            .withColumn("_periods", periods).withColumn("period", F.explode("_periods"))
            .withColumn("first_period", F.element_at("_periods", 1))
            .withColumn("latest_period", F.element_at("_periods", -1)).drop("_periods")
            .join(enrollment, ["place_code", "period"], "left"))
    counts = ["all_enrollment", "public_enrollment", "counted", "incomplete", "public_counted", "public_incomplete"]
    grid = grid.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in counts}).withColumn(
        "start_year", F.substring("period", 1, 4).cast("int"))
    year = Window.partitionBy("place_code").orderBy("start_year")
    whole = Window.partitionBy("place_code")

    def at(column: str, bound: str):
        return F.max(F.when(F.col("period") == F.col(bound), F.col(column))).over(whole)

    grid = grid.withColumns({
        "previous_enrollment": F.when(F.lag("start_year").over(year) == F.col("start_year") - 1,
                                      F.lag("all_enrollment").over(year)),
        "first_enrollment": at("all_enrollment", "first_period"), "latest_enrollment": at("all_enrollment", "latest_period"),
        "first_public": at("public_enrollment", "first_period"), "latest_public": at("public_enrollment", "latest_period"),
        "endpoints_complete": (at("public_counted", "first_period") > 0) & (at("public_incomplete", "first_period") == 0)
        & (at("public_counted", "latest_period") > 0) & (at("public_incomplete", "latest_period") == 0)})
    regular = ~F.col("place_code").isin(rules.UNKNOWN, rules.EXCLUDED)
    pairs = F.create_map(*[F.lit(x) for item in censuses.items() for x in item])
    comparable = residents.groupBy("place_code").agg(F.bool_and("_comparable").alias("_comparable"))
    gap = F.col("school_age_population") - F.col("all_enrollment")
    return (
        grid.withColumn("census_year", F.try_element_at(pairs, "period"))
        .join(residents.drop("_comparable"), ["place_code", "census_year"], "left")
        .join(comparable, "place_code", "left")
        .withColumns({
            "member_type": F.when(F.col("place_code") == rules.UNKNOWN, "unknown")
            .when(F.col("place_code") == rules.EXCLUDED, "excluded").otherwise("regular"),
            "public_share": ratio(F.col("public_enrollment"), F.col("all_enrollment")),
            "change_from_previous": F.col("all_enrollment") - F.col("previous_enrollment"),
            "change_share_from_previous": ratio(F.col("all_enrollment") - F.col("previous_enrollment"), F.col("previous_enrollment")),
            "change_first_to_latest": F.col("latest_enrollment") - F.col("first_enrollment"),
            "change_share_first_to_latest": ratio(F.col("latest_enrollment") - F.col("first_enrollment"), F.col("first_enrollment")),
            "enrollment_trend": F.when(regular, direction(F.col("latest_enrollment"), F.col("first_enrollment"))),
            "public_change": F.col("latest_public") - F.col("first_public"),
            "public_change_share": ratio(F.col("latest_public") - F.col("first_public"), F.col("first_public")),
            "public_trend": F.when(regular & F.col("endpoints_complete") & (F.col("first_public") != 0),
                                   direction(F.col("latest_public"), F.col("first_public"))),
            "population_gap": gap, "gap_share": ratio(gap, F.col("school_age_population")),
            "census_context": F.when(F.col("census_year").isNull(), "not available: no census in this period")
            .when(F.col("school_age_population").isNull(), "not available: no census population for this member")
            .otherwise("available"),
            "is_geography_comparable": F.coalesce(regular & F.col("_comparable"), F.lit(False))})
        .drop("_comparable"))
