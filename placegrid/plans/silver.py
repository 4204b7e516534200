"""Cleaning plans for the nine published sources: Bronze text in, (clean, quarantine) out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from placegrid.functions import geo, text
from placegrid.operators import cleaning, hierarchy, reshape, spatial, validity

# Wrongly decoded letters of the published files.
REPAIRS = (("Ã‘", "Ñ"), ("Ã±", "ñ"))
# Box the country's coordinates must fall in (west, south, east, north).
COUNTRY_BOX = (116.0, 4.0, 127.0, 21.5)
COORDINATE_PATTERN = "^-?[0-9]+([.][0-9]+)?([eE]-?[0-9]+)?$"


@dataclass(frozen=True)
class DeliverySpec:
    """What each column of a wide delivery is (enrollment, facilities and personnel files)."""

    identifier: str
    period: str
    pattern: str = "^[0-9]{6}$"
    free_text: Sequence[str] = ()
    text: Sequence[str] = ()
    categories: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    booleans: Mapping[str, tuple[Sequence[str], Sequence[str]]] = field(default_factory=dict)
    placeholders: Mapping[str, Sequence[str]] = field(default_factory=dict)
    counts: Sequence[str] = ()
    integral: bool = False
    maximum: int = 10_000
    caps: Mapping[str, int] = field(default_factory=dict)
    flagged_labels: Mapping[str, str] = field(default_factory=dict)
    offered: Mapping[str, Sequence[str]] = field(default_factory=dict)
    scope: Column | None = None
    totals: Mapping[str, Sequence[str]] = field(default_factory=dict)


def clean_delivery(bronze: DataFrame, current: DataFrame, spec: DeliverySpec) -> tuple[DataFrame, DataFrame]:
    """One row per identifier and period; every count typed or NULL, every label mapped or NULL, reasons for the rest.

    The 60 to 300 count columns are judged inside one row with array functions, so the plan stays one projection.
    """
    rows = cleaning.only_current(bronze, current)
    rows = cleaning.with_copies(rows, [spec.period, spec.identifier])
    ident = F.coalesce(F.col(spec.identifier), F.lit(""))
    raw = F.array(*[F.coalesce(F.col(c), F.lit("")) for c in spec.counts]) if spec.counts else F.array().cast("array<string>")
    whole = text.integral_decimal if spec.integral else text.strict_int
    negative = F.exists(raw, lambda x: x.rlike("^-[0-9]+([.]0+)?$"))
    malformed = F.exists(raw, lambda x: (x != "") & ~x.rlike("^-[0-9]+([.]0+)?$") & whole(x).isNull())
    large = F.exists(raw, lambda x: F.coalesce(whole(x) > spec.maximum, F.lit(False)))
    reasons = {
        f"{spec.identifier}_blank": ident == "", f"{spec.identifier}_malformed": (ident != "") & ~ident.rlike(spec.pattern),
        f"{spec.identifier}_duplicated": (ident != "") & (F.col("key_rows") > 1),
        "count_negative": negative, "count_not_whole_number": malformed, "count_above_plausible_max": large}
    if spec.scope is not None:
        reasons["measure_outside_scope"] = ~spec.scope & text.any_filled(list(spec.counts))
    for flag, cells in spec.offered.items():
        if flag in spec.booleans:
            reasons[f"{flag}_measure_not_offered"] = text.map_boolean(text.clean_text(flag), *spec.booleans[flag]).eqNullSafe(F.lit(False)) & text.any_above(cells, 0)
    rows = cleaning.with_reasons(rows, reasons).drop("key_rows")
    out = {f"{c}_possibly_truncated": text.at_length_cap(c, cap) for c, cap in spec.caps.items()}
    out |= {c: text.clean_text(text.repair_text(c, REPAIRS)) for c in spec.free_text}
    out |= {c: text.clean_text(c) for c in spec.text}
    out |= {c: text.placeholder_to_null(text.clean_text(c), values) for c, values in spec.placeholders.items()}
    out |= {c: text.map_label(text.clean_text(c), labels) for c, labels in spec.categories.items()}
    out |= {c: text.map_boolean(text.clean_text(c), *labels) for c, labels in spec.booleans.items()}
    out |= {c: whole(F.col(c)) for c in spec.counts}
    typed = rows.withColumns(out)
    flagged = F.lit(False)
    for c, label in spec.flagged_labels.items():
        flagged = flagged | F.coalesce(F.col(c) == label, F.lit(False))
    extra = {"is_flagged": flagged}
    if spec.counts:
        extra["count_status"] = text.count_status(list(spec.counts), spec.scope)
    extra |= {f"{c}_differs": text.total_differs(parts, c) for c, parts in spec.totals.items()}
    return cleaning.split_clean(typed.withColumns(extra))


# Labels of the place-code list.
LEVELS = {x: x for x in ("Reg", "Prov", "City", "Mun", "SubMun", "Bgy")}
CITY_CLASSES = {x: x for x in ("HUC", "ICC", "CC")}
INCOME_CLASSES = {"1st": "1st", "2nd": "2nd", "3rd": "3rd", "4th": "4th", "5th": "5th", "2nd*": "2nd", "3rd*": "3rd", "4th*": "4th"}
INCOME_RETAINED = {k: k.endswith("*") for k in INCOME_CLASSES}


def clean_place_codes(bronze: DataFrame, current: DataFrame, master_period: str) -> tuple[DataFrame, DataFrame]:
    """The master list of places, one row per code and quarter, parents derived from positions."""
    rows = cleaning.with_copies(cleaning.only_current(bronze, current), ["batch_id", "psgc_code"])
    n = {c: text.clean_text(c) for c in ("name", "old_names", "geographic_level", "city_class", "urban_rural", "status", "income_classification")}
    rows = rows.withColumns({f"n_{c}": e for c, e in n.items()} | {"correspondence_code": F.nullif("correspondence_code", F.lit(""))})
    parent = (F.col("n_geographic_level") == "Prov") | F.col("n_geographic_level").isNull()
    rows = cleaning.with_known_parent(rows, "psgc_code", 5, 10, parent, "province_code", by=["batch_id"])
    code, valid = F.coalesce(F.col("psgc_code"), F.lit("")), F.col("psgc_code").rlike("^[0-9]{10}$")
    population = text.strict_int("population")
    rows = cleaning.with_reasons(rows, {
        "psgc_code_blank": code == "", "psgc_code_malformed": (code != "") & ~valid, "psgc_code_duplicated": valid & (F.col("key_rows") > 1),
        "correspondence_code_malformed": ~F.col("correspondence_code").rlike("^[0-9]{9}$"),
        "population_uncastable": (F.col("population") != "") & population.isNull() & (F.col("population") != "#N/A")})
    rows = rows.withColumns({
        "is_master_reference": F.coalesce(F.col("publication_period") == master_period, F.lit(False)),
        "geographic_level": text.map_label("n_geographic_level", LEVELS), "level_blank": F.col("n_geographic_level").isNull(),
        "region_code": F.when(valid, text.ancestor_code("psgc_code", 2, 10)),
        "city_municipality_code": F.when(valid & (F.col("n_geographic_level") == "Bgy"), text.ancestor_code("psgc_code", 7, 10)),
        "name": F.col("n_name"), "old_names": F.col("n_old_names"), "city_class": text.map_label("n_city_class", CITY_CLASSES),
        "income_class": text.map_label("n_income_classification", INCOME_CLASSES),
        "income_class_retained": text.map_label("n_income_classification", INCOME_RETAINED),
        "income_class_null_reason": F.when(F.col("n_income_classification") == "-", "not_classified"),
        "urban_rural_null_reason": F.when(F.col("n_urban_rural") == "-", "unknown"), "urban_rural": text.map_label("n_urban_rural", {"U": "U", "R": "R"}),
        "status": text.map_label("n_status", {"Capital": "Capital", "Pob.": "Pob."}),
        "population_null_reason": text.map_label("population", {"#N/A": "publisher_na", "": "blank"}), "population": population})
    return cleaning.split_clean(rows.drop("key_rows", "income_classification", *[f"n_{c}" for c in n]))


# The five measures of a poverty estimate, as published and as kept.
ESTIMATE_MEASURES = {
    "poverty_incidence": "Poverty Incidence", "coefficient_of_variation": "Coefficient of Variation", "standard_error": "Standard Error",
    "ci90_lower_limit": "90% Confidence Interval Lower Limit", "ci90_upper_limit": "90% Confidence Interval Upper Limit"}


def clean_estimates(bronze: DataFrame, current: DataFrame, years: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Poverty estimates: banner region carried down, one row per unit and year, measures typed, consistency flagged."""
    rows = cleaning.only_current(bronze, current).filter(F.col("source_row_kind").isin("unit", "region_banner"))
    rows = rows.withColumn("_label", text.clean_text("Region/Province"))
    rows = reshape.carry_banner(rows, ["batch_id", "source_sheet"], "source_row_number", F.col("source_row_kind") == "region_banner", "_label", "region")
    rows = rows.filter(F.col("source_row_kind") == "unit").withColumnsRenamed({"PSGC ID": "psgc_id_published"}).withColumn(
        "municipality", text.clean_text("Municipality/City"))
    keep = ["batch_id", "source_sheet", "source_row_number", "psgc_id_published", "region", "municipality"]
    long = reshape.periods_to_rows(rows, keep, "estimate_year", {
        y: {m: f"{label} {y}" for m, label in ESTIMATE_MEASURES.items()} for y in years}, covered=F.col("estimate_years_covered"))
    long = long.withColumn("psgc_id", text.pad_code("psgc_id_published", (5, 6)))
    long = cleaning.with_copies(long, ["estimate_year", "psgc_id"])
    uncastable = F.lit(False)
    for m in ESTIMATE_MEASURES:
        uncastable = uncastable | F.coalesce((F.col(m) != "") & text.strict_double(m).isNull(), F.lit(False))
    long = long.withColumn("_bad", uncastable).withColumns({m: text.strict_double(m) for m in ESTIMATE_MEASURES})
    p, cv, se, low, high = (F.col(m) for m in ESTIMATE_MEASURES)
    ident = F.coalesce(F.col("psgc_id_published"), F.lit(""))
    long = cleaning.with_reasons(long, {
        "psgc_id_blank": ident == "", "psgc_id_malformed": (ident != "") & F.col("psgc_id").isNull(),
        "psgc_id_duplicated": F.col("psgc_id").isNotNull() & (F.col("key_rows") > 1), "measure_uncastable": F.col("_bad"),
        "incidence_out_of_range": (p < 0) | (p > 100), "cv_negative": cv < 0, "se_negative": se < 0,
        "ci_inconsistent": F.coalesce(low > high, F.lit(False)) | F.coalesce(p < low, F.lit(False)) | F.coalesce(p > high, F.lit(False))})
    long = long.withColumns({
        "estimate_year": F.col("estimate_year").cast("int"), "correspondence_code": F.concat("psgc_id", F.lit("000")),
        "estimate_status": text.estimate_status(list(ESTIMATE_MEASURES)), "cv_over_20": F.coalesce(cv > 20, F.lit(False)),
        "se_cv_inconsistent": text.error_disagrees(p, cv, se), "lower_limit_not_positive": F.coalesce(low <= 0, F.lit(False))})
    return cleaning.split_clean(long.drop("_bad", "key_rows"))


def clean_boundaries(bronze: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boundary features: dates and decimals exact, code hierarchy, geometry parsed and valid, center inside."""
    rows = cleaning.with_copies(cleaning.only_current(bronze, current), ["batch_id", "adm3_pcode"])
    shape = geo.rings("geometry")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    dates = {c: text.strict_date(c) for c in ("valid_on", "valid_to")}
    area = text.strict_decimal("area_sqkm", 20, 14)
    center = {c: text.strict_decimal(c, 18, 14) for c in ("center_lat", "center_lon")}
    kind = geo.geometry_type("geometry")
    code = F.coalesce(F.col("adm3_pcode"), F.lit(""))
    rows = cleaning.with_reasons(rows.withColumn("_shape", shape), {
        "adm3_pcode_blank": code == "", "adm3_pcode_malformed": (code != "") & ~code.rlike("^PH[0-9]{7}$"),
        "adm3_pcode_duplicated": (code != "") & (F.col("key_rows") > 1),
        "valid_on_uncastable": ~blank("valid_on") & dates["valid_on"].isNull(), "valid_to_uncastable": ~blank("valid_to") & dates["valid_to"].isNull(),
        "area_uncastable": ~blank("area_sqkm") & area.isNull(), "area_not_positive": area <= 0,
        "center_uncastable": (~blank("center_lat") & center["center_lat"].isNull()) | (~blank("center_lon") & center["center_lon"].isNull()),
        "geometry_unparseable": kind.isNull() | (kind.isin("Polygon", "MultiPolygon") & F.col("_shape").isNull()),
        "geometry_empty": F.size("_shape") == 0, "geometry_wrong_type": ~kind.isin("Polygon", "MultiPolygon")})
    rows = rows.withColumns({
        **dates, "area_sqkm": area, **center,
        "hierarchy_consistent": F.coalesce(F.col("adm2_pcode").rlike("^PH[0-9]{5}$") & F.col("adm1_pcode").rlike("^PH[0-9]{2}$"), F.lit(False))
        & F.coalesce(F.col("adm3_pcode").startswith(F.col("adm2_pcode")) & F.col("adm2_pcode").startswith(F.col("adm1_pcode")), F.lit(False))})
    rows = validity.with_validity(rows, "geometry", "geometry_is_valid")
    key = ["batch_id", "source_row_number"]
    ident = F.concat_ws("/", *key)
    points = rows.select(*key, ident.alias("place_code"), F.col("center_lon").cast("double").alias("longitude"), F.col("center_lat").cast("double").alias("latitude"))
    points = points.withColumn("coordinate_flag", F.when(F.col("longitude").isNull() | F.col("latitude").isNull(), "missing"))
    shapes = rows.filter(F.col("_shape").isNotNull()).select(ident.alias("place_code"), ident.alias("shape_id"), "geometry")
    inside = spatial.boundary_status(points, shapes, key).select(*key, (F.col("boundary_status") == "inside").alias("center_inside_geometry"))
    return cleaning.split_clean(rows.drop("_shape", "key_rows").join(inside, key))


def clean_report(bronze: DataFrame, current: DataFrame, content: Sequence[str], scope: Mapping[str, Column] | None = None,
                 moved: tuple[str, str, str, str] = ("19066", "09066", "1900000000", "0900000000")) -> tuple[DataFrame, DataFrame]:
    """Report sheets with place codes and coordinates: padded codes, units moved to another region, copies and conflicts.

    ``scope`` adds out-of-scope reasons (wrong year, wrong sector). ``moved`` is old and new province prefix and region.
    """
    rows = cleaning.only_current(bronze, current).filter(F.col("source_row_kind") == "unit")
    rows = cleaning.with_versions(rows, ["school_year", "school_id"], content, "source_row_number")
    why = {"#N/A": "source_na", "": "not_in_workbook"}
    codes = ("psgc_region", "psgc_province", "psgc_city_municipality", "psgc_barangay")
    padded = {c: text.pad_code(c, (9, 10)) for c in codes}
    reasons = {f"{c}_null_reason": F.when(padded[c].isNull(), F.coalesce(text.map_label(c, why), F.when(F.col(c).isNull(), "not_in_workbook"), F.lit("unrecognized")))
               for c in codes[2:]}
    number = lambda c: F.when(F.col(c).rlike(COORDINATE_PATTERN), F.col(c).try_cast("double"))
    rows = rows.withColumns({**reasons, "longitude_published": F.col("longitude"), "latitude_published": F.col("latitude")}).withColumns(
        {**padded, "longitude": number("longitude"), "latitude": number("latitude")})
    old, new, old_region, new_region = moved
    recoded = text.has_prefix("psgc_province", old)
    # the region follows its province; every other code moves by its own prefix
    rows = rows.withColumn("psgc_recoded", recoded).withColumns({
        "psgc_region": F.when(F.col("psgc_recoded") & (F.col("psgc_region") == old_region), new_region).otherwise(F.col("psgc_region")),
        **{c: F.when(F.col("psgc_recoded"), text.recode_prefix(c, old, new)).otherwise(F.col(c)) for c in codes[1:]}})
    rows = rows.withColumns({
        "barangay_outside_city": F.coalesce(F.substring("psgc_barangay", 1, 7) != F.substring("psgc_city_municipality", 1, 7), F.lit(False)),
        "coordinate_flag": text.coordinate_flag("longitude", "latitude", COUNTRY_BOX, "outside_philippines")})
    rows = cleaning.with_reasons(rows, {"school_id_malformed": ~F.coalesce(F.col("school_id"), F.lit("")).rlike("^[0-9]{6}$"),
                                        **cleaning.duplicate_rules(), **(scope or {})})
    return cleaning.split_clean(rows.drop("key_rows", "key_versions", "is_first_copy"))


# The ages and groups of a census sheet.
CENSUS_AGES = range(5, 25)
CENSUS_GROUPS = {"both": "both_sexes", "male": "male", "female": "female"}
GROUP_ROWS = {"both": "sex_total", "male": "sex_male", "female": "sex_female"}


def census_cells(bronze: DataFrame, current: DataFrame) -> DataFrame:
    """Both census layouts as one row per place, sex and age, numbered by place in sheet order."""
    rows = cleaning.only_current(bronze, current).filter(F.col("source_row_kind").isin("place", *GROUP_ROWS.values()))
    by = ["batch_id", "source_sheet"]
    rows = reshape.sections_with_head(rows, by, "source_row_number", F.col("source_row_kind") == "place", {"place_label": "label", "place_row_number": "source_row_number"})
    wide = {(sex, age): f"{column}_age_{age}" for sex, column in CENSUS_GROUPS.items() for age in CENSUS_AGES}
    keep = [*by, "section", "place_label", "place_row_number", "census_year", "schema_version"]
    first = reshape.cells_to_rows(rows.filter((F.col("schema_version") == "v1") & (F.col("source_row_kind") == "place")), keep, wide, ["sex", "age"], "population_published")
    sex = F.lit(None).cast("string")
    for name, kind in GROUP_ROWS.items():
        sex = F.when(F.col("source_row_kind") == kind, name).otherwise(sex)
    second = rows.filter((F.col("schema_version") == "v2") & F.col("source_row_kind").isin(*GROUP_ROWS.values())).withColumn("sex", sex)
    second = reshape.cells_to_rows(second, [*keep, "sex"], {(age,): f"age_{age}" for age in CENSUS_AGES}, ["age"], "population_published")
    cells = first.unionByName(second).withColumnRenamed("section", "place_pos")
    raw = F.coalesce(F.col("population_published"), F.lit(""))
    cells = cleaning.with_reasons(cells, {"population_blank": raw == "", "population_negative": raw.rlike("^-[0-9]+$"),
                                          "population_not_whole_number": (raw != "") & ~raw.rlike("^-[0-9]+$") & text.strict_int(raw).isNull()})
    concept = F.when(F.col("source_sheet").endswith("Total Pop"), "total").when(F.col("source_sheet").endswith("Household Pop"), "household")
    return cells.withColumns({"population": text.strict_int("population_published"), "population_concept": concept, "census_year": F.col("census_year").cast("int")})


def clean_census(bronze: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """School-age population with the place tree found from the counts themselves."""
    by = ["batch_id", "source_sheet"]
    cells = census_cells(bronze, current)
    names = [f"m_{sex}_{age}" for sex in CENSUS_GROUPS for age in CENSUS_AGES]
    places = cells.groupBy(*by, "place_pos").agg(F.max("place_label").alias("place_label"), *[
        F.max(F.when((F.col("sex") == sex) & (F.col("age") == age), F.col("population"))).cast("bigint").alias(f"m_{sex}_{age}")
        for sex in CENSUS_GROUPS for age in CENSUS_AGES])
    places = places.withColumn("place_name", text.bare_name(text.clean_text("place_label")))
    spans = hierarchy.close_spans(hierarchy.spans_from_sums(places, by, "place_pos", names), by)
    label = text.clean_text("place_label")
    tree = hierarchy.tree_from_spans(places.select(*by, "place_pos", "place_label", "place_name"), spans, by, "place_pos", "place_name").withColumns({
        "footnote": text.footnote(label), "old_name": text.old_names(label), "is_capital": text.is_capital(label)}).drop("place_label")
    return cleaning.split_clean(cells.join(tree, [*by, "place_pos"], "left"))
