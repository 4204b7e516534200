"""Cleaning and model plans on small made-up deliveries."""

import pytest
from pyspark.sql import functions as F

from helpers import by_key, rows
from placegrid.operators import hierarchy
from placegrid.plans import gold, integration, silver
from test_matching import UNIT, unit
from test_scale import census


@pytest.fixture
def current(table):
    return table([("b1",)], "batch_id string")


def test_delivery(table, current):
    cells = ["g1", "g2"]
    spec = silver.DeliverySpec("school_id", "school_year", free_text=["school_name"], categories={"sector": {"Public": "Public", "PSO": "PSO"}},
                               booleans={"offers_es": (["True"], ["False"])}, counts=cells, caps={"barangay": 5}, flagged_labels={"sector": "PSO"})
    data = [("100001", " PiÃ±as\t School ", "Public", "True", "abcde", "1", ""), ("100002", "B", "PSO", "False", "abc", "0", "0"), ("100002", "B", "PSO", "False", "abc", "0", "0"),
            ("12", "C", "Public", "True", "", "3", "4"), ("100003", "D", "Public", "True", "", "-1", "99999"), ("100004", "E", "Odd", "True", "", "1.5", "2"), ("100005", "F", "Public", "", "", "", "")]
    raw = table([("2023-24", *d, "b1", i) for i, d in enumerate(data)] + [("2023-24", "100009", "old", "Public", "True", "", "1", "1", "b0", 99)],
                "school_year string, school_id string, school_name string, sector string, offers_es string, barangay string, g1 string, g2 string, batch_id string, source_row_number long")
    clean, quarantine = silver.clean_delivery(raw, current, spec)
    got = by_key(clean, "school_id")
    assert set(got) == {"100001", "100005"}
    a = got["100001"]
    assert (a["school_name"], a["offers_es"], a["g1"], a["g2"], a["count_status"], a["barangay_possibly_truncated"], a["is_flagged"]) == ("Piñas School", True, 1, None, "has_learners", True, False)
    assert got["100005"]["count_status"] == "no_counts" and got["100005"]["offers_es"] is None
    bad = {(r["school_id"], tuple(r["quarantine_reasons"])) for r in quarantine.collect()}
    assert bad == {("100002", ("school_id_duplicated",)), ("12", ("school_id_malformed",)), ("100003", ("count_negative", "count_above_plausible_max")), ("100004", ("count_not_whole_number",))}
    assert clean.count() + quarantine.count() == 7


def test_place_codes(table, current):
    columns = ("psgc_code", "name", "correspondence_code", "geographic_level", "old_names", "city_class", "income_classification", "urban_rural", "population", "status")
    data = [("0100000000", "Region I", "010000000", "Reg", "", "", "", "", "5", ""), ("0102800000", "Ilocos", "012800000", "Prov", "", "", "2nd*", "-", "#N/A", ""),
            ("0102801000", " Adams ", "012801000", "Mun", "Old A", "", "-", "", "", ""), ("0102801001", "Sub", "012801001", "Bgy", "", "", "", "R", "0", "Pob."),
            ("0199901000", "Loose", "", "City", "", "CC", "1st", "", "7", ""), ("12", "Bad", "", "Mun", "", "", "", "", "x", ""), ("0102801000", "Adams", "", "Mun", "", "", "", "", "1", "")]
    raw = table([("2026-Q2", *d, "b1") for d in data], "publication_period string, " + ", ".join(f"{c} string" for c in columns) + ", batch_id string")
    clean, quarantine = silver.clean_place_codes(raw, current, "2026-Q2")
    got = by_key(clean, "psgc_code")
    assert set(got) == {"0100000000", "0102800000", "0102801001", "0199901000"}
    assert (got["0102801001"]["province_code"], got["0102801001"]["city_municipality_code"], got["0102801001"]["region_code"]) == ("0102800000", "0102801000", "0100000000")
    assert got["0199901000"]["province_code"] is None and got["0199901000"]["city_class"] == "CC"
    p = got["0102800000"]
    assert (p["income_class"], p["income_class_retained"], p["urban_rural"], p["urban_rural_null_reason"], p["population"], p["population_null_reason"]) == ("2nd", True, None, "unknown", None, "publisher_na")
    assert got["0102801001"]["population"] == 0 and got["0102801001"]["status"] == "Pob."
    assert {(r["psgc_code"], tuple(r["quarantine_reasons"])) for r in quarantine.collect()} == {("12", ("psgc_code_malformed", "population_uncastable")), ("0102801000", ("psgc_code_duplicated",))}


def test_estimates(table, current):
    measures = [f"{m} {y}" for y in ("2018", "2021") for m in silver.ESTIMATE_MEASURES.values()]
    schema = "source_row_kind string, `PSGC ID` string, `Region/Province` string, `Municipality/City` string, " + ", ".join(f"`{m}` string" for m in measures)
    schema += ", estimate_years_covered string, source_sheet string, source_row_number long, batch_id string"
    blank = [""] * 10
    data = [("region_banner", "", "Region I ", "", *blank), ("unit", "12801", "", "Adams", "20.0", "10", "2.0", "15", "25", *[""] * 5), ("region_banner", "", "Region II", "", *blank),
            ("unit", "21501", "", "Aparri", "20", "30", "9", "0", "40", "200", "1", "2", "3", "4"), ("unit", "9", "", "Bad", "1", "", "", "", "", *[""] * 5)]
    raw = table([(*d, "2018,2021", "S", i, "b1") for i, d in enumerate(data)], schema)
    clean, quarantine = silver.clean_estimates(raw, current, ["2018", "2021"])
    got = {(r["psgc_id"], r["estimate_year"]): r for r in clean.collect()}
    assert set(got) == {("012801", 2018), ("012801", 2021), ("021501", 2018)}
    a, b = got["012801", 2018], got["021501", 2018]
    assert (a["region"], a["estimate_status"], a["correspondence_code"], a["se_cv_inconsistent"], a["cv_over_20"]) == ("Region I", "estimated", "012801000", False, False)
    assert (b["region"], b["cv_over_20"], b["se_cv_inconsistent"], b["lower_limit_not_positive"]) == ("Region II", True, True, True)
    assert got["012801", 2021]["estimate_status"] == "no_estimate"
    assert sorted((r["psgc_id_published"], r["estimate_year"], tuple(r["quarantine_reasons"])) for r in quarantine.collect()) == [
        ("21501", 2021, ("incidence_out_of_range", "ci_inconsistent")), ("9", 2018, ("psgc_id_malformed",)), ("9", 2021, ("psgc_id_malformed",))]


def test_boundaries(table, current):
    schema = "adm3_pcode string, adm2_pcode string, adm1_pcode string, valid_on string, valid_to string, area_sqkm string, center_lat string, center_lon string, geometry string, batch_id string, source_row_number long"
    good = '{"type": "Polygon", "coordinates": [[[0,0],[2,0],[2,2],[0,2],[0,0]]]}'
    raw = table([("PH0102801", "PH01028", "PH01", "2025-02-13", "", "4.2500", "1.0", "1.0", good, "b1", 1), ("PH0102802", "PH01029", "PH01", "2025-02-13", "", "4", "5.0", "1.0", good, "b1", 2),
                 ("XX", "PH01028", "PH01", "13/02", "", "-4", "1", "1", '{"type": "Point", "coordinates": [1,1]}', "b1", 3), ("PH0102803", "PH01028", "PH01", "", "", "1", "a", "1", "nonsense", "b1", 4)], schema)
    clean, quarantine = silver.clean_boundaries(raw, current)
    got = by_key(clean, "adm3_pcode")
    assert {k: (v["geometry_is_valid"], v["hierarchy_consistent"], v["center_inside_geometry"]) for k, v in got.items()} == {"PH0102801": (True, True, True), "PH0102802": (True, False, False)}
    assert {(r["adm3_pcode"], tuple(r["quarantine_reasons"])) for r in quarantine.collect()} == {
        ("XX", ("adm3_pcode_malformed", "valid_on_uncastable", "area_not_positive", "geometry_wrong_type")), ("PH0102803", ("center_uncastable", "geometry_unparseable"))}


def test_report(table, current):
    schema = ("school_year string, school_id string, psgc_region string, psgc_province string, psgc_city_municipality string, psgc_barangay string, longitude string, latitude string, "
              "source_row_kind string, batch_id string, source_row_number long")
    data = [("100001", "100000000", "102800000", "102801000", "102801001", "120.5", "18.0"), ("100002", "1900000000", "1906600000", "1906601000", "#N/A", "0", "0"),
            ("100003", "100000000", "102800000", "102801000", "102802001", "", "18"), ("100003", "100000000", "102800000", "102801000", "102802001", "", "18"),
            ("100004", "", "", "", "", "1", "1"), ("100004", "", "", "", "", "2", "2"), ("x", "", "", "", "", "", "")]
    raw = table([("2023-24", *d, "unit", "b1", i) for i, d in enumerate(data)], schema)
    content = ["psgc_barangay", "longitude", "latitude"]
    clean, quarantine = silver.clean_report(raw, current, content, {"out_of_scope_year": F.col("school_year") != "2023-24"})
    got = by_key(clean, "school_id")
    assert set(got) == {"100001", "100002", "100003"}
    assert (got["100001"]["psgc_region"], got["100001"]["psgc_barangay"], got["100001"]["coordinate_flag"], got["100001"]["barangay_outside_city"]) == ("0100000000", "0102801001", None, False)
    b = got["100002"]
    assert (b["psgc_region"], b["psgc_province"], b["psgc_city_municipality"], b["psgc_recoded"], b["psgc_barangay"], b["psgc_barangay_null_reason"], b["coordinate_flag"]) == (
        "0900000000", "0906600000", "0906601000", True, None, "source_na", "zero")
    assert got["100003"]["barangay_outside_city"] and got["100003"]["coordinate_flag"] == "missing"
    assert sorted((r["school_id"], tuple(r["quarantine_reasons"])) for r in quarantine.collect()) == [
        ("100003", ("key_identical_copy",)), ("100004", ("key_conflicting",)), ("100004", ("key_conflicting",)), ("x", ("school_id_malformed",))]


def test_census_both_layouts(spark, table, current):
    """The same made-up tree published wide (one row per place) and long (a row per sex) gives the same levels."""
    ages, groups = list(silver.CENSUS_AGES), list(silver.CENSUS_GROUPS)
    counts = {r["name"]: [r[f"m{i % 12}"] * (i + 1) for i in range(60)] for r in census(spark).collect()}
    order = [r["name"] for r in census(spark).orderBy("pos").collect()]
    wide_names = [f"{silver.CENSUS_GROUPS[g]}_age_{a}" for g in groups for a in ages]
    long_names = [f"age_{a}" for a in ages]
    schema = "source_row_kind string, label string, " + ", ".join(f"{c} string" for c in wide_names + long_names) + ", schema_version string, source_sheet string, source_row_number long, census_year string, batch_id string"
    data, n = [], 0
    for name in order:
        n += 1
        data.append(("place", f"{name} (Capital) 1/" if name == "a" else name, *map(str, counts[name]), *[None] * 20, "v1", "2020 Total Pop", n, "2020", "b1"))
    n = 0
    for name in order:
        n += 1
        data.append(("place", name, *[None] * 80, "v2", "2024 Total Pop", n, "2024", "b1"))
        for g, kind in silver.GROUP_ROWS.items():
            n += 1
            at = groups.index(g) * 20
            data.append((kind, g, *[None] * 60, *map(str, counts[name][at:at + 20]), "v2", "2024 Total Pop", n, "2024", "b1"))
    clean, quarantine = silver.clean_census(table(data, schema), current)
    assert quarantine.count() == 0 and clean.count() == 2 * len(order) * 60
    levels = {r["census_year"]: r["s"] for r in clean.groupBy("census_year").agg(F.sort_array(F.collect_set(F.struct("place_name", "level", "province_name"))).alias("s")).collect()}
    assert levels[2020] == levels[2024]
    named = {r["place_name"]: r["level"] for r in levels[2020]}
    assert named["C"] == "country" and named["R2"] == "region" and named["P1"] == "province" and named["A"] == "city_municipality"
    a = clean.filter("place_name = 'A' and census_year = 2020").first()
    assert (a["is_capital"], a["footnote"], a["province_name"]) == (True, "1/", "P1")


def test_enrollment_fact(table):
    levels = gold.enrollment_levels()
    assert {k: len(c) for k, (_, c) in levels.items()} == {"ES": 16, "JHS": 10, "SHS": 40}
    cells = [c if isinstance(c, str) else c[0] for _, cs in levels.values() for c in cs]

    def row(sid, period, offers, fill, blank=()):
        return (sid, period, "Public", "Mother school", *offers, *[None if c in blank or (fill == "old" and ("unique" in c or "sshs" in c)) else 1 for c in cells])

    enrollment = table([row("1", "2023-24", (True, True, True), "old"), row("2", "2025-26", (True, False, True), "new", blank=("g1_male", "g11_sshs_acad_male")), row("3", "2023-24", (True, None, False), "old")],
                       "entity_id string, period string, sector string, annex_status string, offers_es boolean, offers_jhs boolean, offers_shs boolean, " + ", ".join(f"{c} int" for c in cells))
    places = table([("1", "2023-24", "city_mun", "C1", "matched"), ("1", "2023-24", "bgy", None, "unmatched"), ("2", "2025-26", "city_mun", None, "ambiguous"), ("2", "2025-26", "bgy", None, "ambiguous"),
                    ("3", "2023-24", "city_mun", None, "excluded"), ("3", "2023-24", "bgy", None, "excluded")], "entity_id string, period string, geographic_level string, psgc_code string, match_status string")
    got = {(r["entity_id"], r["level_code"]): (r["learner_count"], r["applicable_cells"], r["null_cells"], r["place_code"], r["barangay_psgc_code"]) for r in gold.fact_enrollment(enrollment, places).collect()}
    assert got["1", "ES"] == (16, 16, 0, "C1", "C1-UNKNOWN") and got["1", "SHS"][:3] == (32, 32, 0)
    assert got["2", "ES"] == (None, 16, 1, "UNKNOWN", "UNKNOWN") and got["2", "JHS"][0] == 0 and got["2", "SHS"][:3] == (None, 40, 1)
    assert got["3", "JHS"][0] is None and got["3", "SHS"][0] == 0 and got["3", "ES"][3:] == ("EXCLUDED", "EXCLUDED")


def test_dimensions(spark, table):
    units = table([unit("0100000000", "Region I", "Reg"), unit("0102800000", "Ilocos", "Prov"), unit("0102801000", "Adams", "Mun", "0102800000", population=9), unit("1380600000", "Manila", "City"),
                   unit("1380601000", "Tondo", "SubMun"), unit("1380601001", "B1", "Bgy", city="1380601000"), unit("0102801001", "B2", "Bgy", "0102800000", city="0102801000")], UNIT)
    areas = table([("PH1", "2025", "0102801000", "matched"), ("PH1", "2023", "0102801000", "matched")], "adm3_pcode string, valid_on string, psgc_code string, match_status string")
    shapes = table([("PH1", "2025", 12.5), ("PH1", "2023", 99.0)], "adm3_pcode string, valid_on string, area_sqkm double")
    places = gold.dim_place(units, areas, shapes)
    got = by_key(places, "place_code")
    assert set(got) == {"0102801000", "1380600000", "UNKNOWN", "EXCLUDED"}
    assert (got["0102801000"]["province_name"], got["0102801000"]["region_name"], float(got["0102801000"]["land_area_sqkm"])) == ("Ilocos", "Region I", 12.5)
    subs = {r["barangay_psgc_code"]: r["place_code"] for r in gold.dim_sub_place(units).collect()}
    assert subs == {"1380601001": "1380600000", "0102801001": "0102801000", "0102801000-UNKNOWN": "0102801000", "1380600000-UNKNOWN": "1380600000", "UNKNOWN": "UNKNOWN", "EXCLUDED": "EXCLUDED"}
    estimates = table([(2023, "0102801000", "city_mun", "matched", 20.0, 1.0, 2.0, 25.0, "estimated"), (2023, "1380601000", "sub_mun", "matched", 5.0, 1.0, 2.0, 5.0, "estimated")],
                      "estimate_year int, psgc_code string, geographic_level string, match_status string, poverty_incidence double, ci90_lower_limit double, ci90_upper_limit double, coefficient_of_variation double, estimate_status string")
    poverty = by_key(gold.dim_place_poverty(places, estimates, 2023), "place_code")
    assert poverty["0102801000"]["cv_over_20"] is True and poverty["1380600000"]["status_reason"].startswith("only district")
    people = by_key(gold.fact_population(places, units, 2024), "place_code")
    assert people["0102801000"]["population"] == 9 and set(people) == {"0102801000", "1380600000"}
    assert gold.dim_level(spark).count() == 3
    periods = gold.dim_period(table([("2023-24",), ("2024-25",), ("2023-24",)], "period string"))
    grid = gold.fact_availability(periods, table([("2023-24", "enrollment")], "period string, source_id string"), ["enrollment", "rooms"])
    assert rows(grid.filter("has_data"), "period", "source_id") == [("2023-24", "enrollment")] and grid.count() == 4


def test_school_age_fact(table):
    census_rows = table([(2020, "A", "P", 5, "male", "total", "city_municipality", 10), (2024, "A", "P", 5, "male", "total", "city_municipality", 12), (2024, "B", "P", 5, "male", "total", "city_municipality", 1),
                         (2024, "X", "P", 5, "male", "total", "city_municipality", 2), (2024, "Y", "P", 5, "male", "total", "city_municipality", 3), (2024, "A", "P", 5, "both", "total", "city_municipality", 99)],
                        "census_year int, place_name string, parent_name string, age int, sex string, population_concept string, level string, population int")
    maps = table([(2020, "A", "P", "C1", "matched", "rule"), (2024, "A", "P", "C1", "matched", "rule"), (2024, "B", "P", "C2", "matched", "rule"), (2024, "X", "P", None, "unmatched", "reviewed"),
                  (2024, "Y", "P", None, "ambiguous", "pending")], "census_year int, place_name string, parent_name string, psgc_code string, match_status string, review_status string")
    got = {(r["place_code"], r["reference_year"]): (r["population"], r["is_geography_comparable"]) for r in gold.fact_school_age(census_rows, maps, table([("C9",)], "place_code string")).collect()}
    assert got == {("C1", 2020): (10, True), ("C1", 2024): (12, True), ("C2", 2024): (1, False), ("EXCLUDED", 2024): (2, False), ("UNKNOWN", 2024): (3, False)}


def test_rooms_and_teachers(table):
    fac = table([("1", "2023-24", "Public", 2, None, 1, None, None), ("2", "2023-24", "Private", 9, 9, 9, 1, 1), ("3", "2023-24", "Public", None, None, None, 0, None)],
                "entity_id string, period string, sector string, es_classrooms_instructional int, jhs_classrooms_instructional int, shs_classrooms_instructional int, es_makeshift_rooms int, hs_makeshift_rooms int")
    extra = [f"{v}_{c}" for v in ("es", "hs") for c in ("temporary_learning_spaces", "classes_using_temporary_learning_spaces", "classes_using_makeshift_rooms")]
    got = by_key(gold.fact_rooms(fac.withColumns({c: F.lit(None).cast("int") for c in extra})), "entity_id")
    assert set(got) == {"1", "3"} and got["1"]["rooms"] == 3 and got["3"]["rooms"] is None and got["3"]["makeshift_rooms"] == 0
    people = table([("1", "2023-24", "Public", 1, 2, None)], "entity_id string, period string, sector string, es_t1 int, es_t2 int, jhs_t1 int")
    staff = gold.fact_teachers(people, {"ES": {"teacher_count": ["es_t1", "es_t2"]}, "JHS": {"teacher_count": ["jhs_t1"]}})
    assert rows(staff, "level_code", "teacher_count") == [("ES", 3), ("JHS", None)]


def test_boundary_plan_reads_only_the_locations_periods(table):
    locations = table([("2023-24", "1", 0.5, 0.5, None), ("2023-24", "2", 5.0, 5.0, None)], "period string, entity_id string, longitude double, latitude double, coordinate_flag string")
    maps = table([("1", p, "city_mun", "C1", "matched") for p in ("2020-21", "2023-24")] + [("2", "2023-24", "city_mun", "C1", "matched")], "entity_id string, period string, geographic_level string, psgc_code string, match_status string")
    square = '{"type": "Polygon", "coordinates": [[[0,0],[1,0],[1,1],[0,1],[0,0]]]}'
    shapes = table([("PH1", "2025", square, True), ("PH1", "2020", square.replace("1", "9"), True)], "adm3_pcode string, valid_on string, geometry string, geometry_is_valid boolean")
    known = table([("PH1", "2025", "C1", "matched"), ("PH1", "2020", "C1", "matched")], "adm3_pcode string, valid_on string, psgc_code string, match_status string")
    assert rows(integration.map_entity_boundary(locations, maps, known, shapes), "entity_id", "boundary_status") == [("1", "inside"), ("2", "outside")]
    annexes = integration.map_annexes(table([("1", "2023-24", "Annex"), ("2", "2023-24", "Mother")], "entity_id string, period string, annex_status string"), "Annex")
    assert rows(annexes, "entity_id", "match_status") == [("1", "unmatched")]
