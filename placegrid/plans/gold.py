"""The star schema from the cleaned and matched tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from placegrid.functions import text
from placegrid.operators import modelling
from placegrid.rules import EXCLUDED, UNKNOWN
from placegrid.session import literal_table

SEXES = ("male", "female")
# Strands of the two senior grades, and the cells added in later years.
STRANDS = ("abm", "arts", "gas", "humss", "maritime", "sports", "stem", "tvl")


def enrollment_levels() -> dict[str, tuple[str, list]]:
    """The cells of each level, by rule; a later cell carries the first year it applies to."""
    both = lambda *names: [f"{n}_{s}" for n in names for s in SEXES]
    start = F.substring("period", 1, 4).cast("int")
    senior = both(*[f"g{g}_{s}" for g in (11, 12) for s in STRANDS])
    senior += [(c, start >= 2024) for c in both("g11_unique", "g12_unique")] + [(c, start >= 2025) for c in both("g11_sshs_acad", "g11_sshs_techpro")]
    return {"ES": ("offers_es", both("kinder", "g1", "g2", "g3", "g4", "g5", "g6", "esng")), "JHS": ("offers_jhs", both("g7", "g8", "g9", "g10", "jhsng")), "SHS": ("offers_shs", senior)}


def fact_enrollment(enrollment: DataFrame, entity_map: DataFrame) -> DataFrame:
    """(school, year, level): strict sums of the cells and the place keys, technical members where there is no match."""
    rows = modelling.melt_levels(enrollment, ["entity_id", "period", "sector", "annex_status"], enrollment_levels())
    at = lambda level: F.max(F.when(F.col("geographic_level") == level, F.struct("psgc_code", "match_status"))).alias(f"_{level}")
    geography = entity_map.groupBy("period", "entity_id").agg(at("city_mun"), at("bgy"))
    city, low = F.col("_city_mun"), F.col("_bgy")
    geography = geography.select("period", "entity_id", city.match_status.alias("match_status"),
                                 modelling.status_to_key(city.match_status, city.psgc_code).alias("place_code"),
                                 modelling.status_to_child_key(city.match_status, city.psgc_code, low.match_status, low.psgc_code).alias("barangay_psgc_code"))
    return rows.join(geography, ["period", "entity_id"], "left")


def fact_rooms(facilities: DataFrame) -> DataFrame:
    """(school, year): lenient sums of the reported rooms of public schools."""
    parts = {"rooms": [f"{v}_classrooms_instructional" for v in ("es", "jhs", "shs")]}
    parts |= {c: [f"{v}_{c}" for v in ("es", "hs")] for c in ("temporary_learning_spaces", "classes_using_temporary_learning_spaces", "makeshift_rooms", "classes_using_makeshift_rooms")}
    return facilities.filter(F.col("sector") == "Public").select("entity_id", "period", *[text.lenient_sum(cols).alias(n) for n, cols in parts.items()])


def fact_teachers(personnel: DataFrame, columns: Mapping[str, Mapping[str, Sequence[str]]]) -> DataFrame:
    """(school, year, level): lenient sums of the listed positions (``{level: {measure: columns}}``), one scan."""
    packs = F.array(*[F.struct(F.lit(level).alias("level_code"), *[text.lenient_sum(cols).alias(m) for m, cols in measures.items()]) for level, measures in columns.items()])
    return personnel.filter(F.col("sector") == "Public").select("entity_id", "period", F.inline(packs))


def dim_entity(enrollment: DataFrame) -> DataFrame:
    return modelling.latest_value(enrollment, ["entity_id"], "entity_name", "period")


def dim_period(enrollment: DataFrame) -> DataFrame:
    return modelling.distinct_dimension(enrollment, ["period"], {"start_year": F.substring("period", 1, 4).cast("int")})


def dim_level(spark: SparkSession) -> DataFrame:
    # The three education levels.
    return literal_table(spark, [("ES", "Elementary", 1), ("JHS", "Junior High School", 2), ("SHS", "Senior High School", 3)], "level_code string, level_name string, level_order int")


def master(units: DataFrame) -> DataFrame:
    return units.filter("is_master_reference")


def dim_place(units: DataFrame, boundary_map: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Cities and municipalities with their parents' names and land area, plus the technical members."""
    release = modelling.latest_release(boundary_map, "valid_on").filter(F.col("match_status") == "matched")
    area = release.join(boundaries.select("adm3_pcode", "valid_on", "area_sqkm"), ["adm3_pcode", "valid_on"]).select("psgc_code", F.col("area_sqkm").cast("decimal(18,4)").alias("land_area_sqkm"))
    named = modelling.with_parent_names(master(units), "psgc_code", "name", {"province_name": "province_code", "region_name": "region_code"})
    regular = named.filter(F.col("geographic_level").isin("City", "Mun")).join(area, "psgc_code", "left").select(
        F.col("psgc_code").alias("place_code"), F.col("name").alias("place_name"), F.when(F.col("geographic_level") == "City", "city").otherwise("municipality").alias("place_type"),
        "province_code", "province_name", "region_code", "region_name", "city_class", "income_class", "land_area_sqkm")
    return modelling.with_technical_members(regular, "place_code", "place_name", {
        UNKNOWN: ("Unknown city or municipality", "unknown"), EXCLUDED: ("Excluded from city or municipality analysis", "excluded")})


def dim_sub_place(units: DataFrame) -> DataFrame:
    """Barangays under their city (a district's barangays under its city), one unknown per city, technical members."""
    from placegrid.plans.integration import unit_keys

    rows = unit_keys(master(units))
    regular = rows.filter(F.col("geographic_level") == "Bgy").select(
        F.col("psgc_code").alias("barangay_psgc_code"), F.col("name").alias("barangay_name"), F.col("city_roll").alias("place_code"), "urban_rural")
    cities = rows.filter(F.col("geographic_level").isin("City", "Mun")).select(F.col("psgc_code").alias("place_code"))
    listed = modelling.with_unknown_children(regular, cities, "barangay_psgc_code", "barangay_name", "place_code")
    technical = literal_table(units.sparkSession, [(UNKNOWN, "Unknown barangay", UNKNOWN, "unknown"), (EXCLUDED, "Excluded from barangay analysis", EXCLUDED, "excluded")],
                              "barangay_psgc_code string, barangay_name string, place_code string, member_type string")
    return listed.unionByName(technical, allowMissingColumns=True)


def dim_place_poverty(places: DataFrame, estimates: DataFrame, year: int) -> DataFrame:
    """Each regular place with its estimate of the year, or the reason it has none."""
    of_year = estimates.filter((F.col("estimate_year") == year) & (F.col("match_status") == "matched"))
    members = places.filter(F.col("member_type") == "regular").select("place_code")
    districts = of_year.filter(F.col("geographic_level") == "sub_mun").select(text.ancestor_code("psgc_code", 5, 10).alias("place_code")).distinct().withColumn("_districts", F.lit(True))
    values = of_year.filter(F.col("geographic_level") == "city_mun").select(F.col("psgc_code").alias("place_code"), "poverty_incidence", "ci90_lower_limit", "ci90_upper_limit", "coefficient_of_variation", "estimate_status")
    joined = members.join(values, "place_code", "left").join(districts, "place_code", "left").withColumn("poverty_status", F.coalesce("estimate_status", F.lit("not_in_source")))
    missing = F.col("poverty_status") == "not_in_source"
    return joined.withColumns({
        "estimate_year": F.lit(year), "cv_over_20": F.col("coefficient_of_variation") > 20,
        "status_reason": F.when(F.col("poverty_status") == "no_estimate", "no estimate published").when(missing & F.col("_districts").isNotNull(), "only district estimates, which are not combined")
        .when(missing, "not in the city and municipal estimates")}).drop("estimate_status", "_districts")


def dim_location(boundary_status: DataFrame) -> DataFrame:
    return boundary_status.select("entity_id", "longitude", "latitude", "coordinate_flag", "place_code", "shape_id", "boundary_status")


def fact_population(places: DataFrame, units: DataFrame, year: int) -> DataFrame:
    """Published population per regular place, or why it is missing."""
    members = places.filter(F.col("member_type") == "regular").select("place_code")
    values = master(units).filter(F.col("geographic_level").isin("City", "Mun")).select(
        F.col("psgc_code").alias("place_code"), F.col("population").cast("bigint").alias("population"), "population_null_reason")
    out = modelling.left_with_status(members, values, ["place_code"], "estimate_status", [(F.col("population_null_reason").isNotNull(), "missing")])
    return out.withColumn("reference_year", F.lit(year))


def fact_school_age(census: DataFrame, census_map: DataFrame, changed: DataFrame, years: int = 2) -> DataFrame:
    """(place, year, age, sex) sums of matched places, the others summed into the technical members."""
    rows = census.filter((F.col("level") == "city_municipality") & (F.col("population_concept") == "total") & F.col("sex").isin(*SEXES))
    rows = rows.join(census_map.select("census_year", "place_name", "parent_name", "psgc_code", "match_status", "review_status"), ["census_year", "place_name", "parent_name"])
    code = F.when(F.col("match_status") == "matched", F.col("psgc_code")).when(F.col("review_status") == "reviewed", EXCLUDED).otherwise(UNKNOWN)
    placed = rows.select(code.alias("place_code"), F.col("census_year").alias("reference_year"), "age", "sex", "population", "match_status")
    summed = modelling.sum_into_members(placed, ["place_code", "reference_year", "age", "sex"], "population", "match_status")
    return modelling.comparable_members(summed, "place_code", "reference_year", years, changed)


def fact_availability(periods: DataFrame, deliveries: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Every period with every source, and whether that source has data for it."""
    wanted = periods.select("period").withColumn("source_id", F.explode(F.array(*[F.lit(s) for s in sources])))
    seen = deliveries.select("period", "source_id").distinct().withColumn("has_data", F.lit(True))
    return wanted.join(seen, ["period", "source_id"], "left").withColumn("has_data", F.coalesce("has_data", F.lit(False)))
