"""Matching rules: order, ambiguity, never a lost record."""

import pytest
from pyspark.sql import functions as F

from helpers import by_key, rows
from placegrid.operators import matching, spatial
from placegrid.plans import integration

UNIT = ("psgc_code string, name string, old_names string, geographic_level string, level_blank boolean, region_code string, province_code string, "
        "city_municipality_code string, correspondence_code string, is_master_reference boolean, urban_rural string, population int, population_null_reason string, city_class string, income_class string")


def unit(code, name, level, province=None, city=None, old=None, corr=None, population=None):
    return (code, name, old, level, level is None, code[:2] + "00000000", province, city, corr, True, "U" if level == "Bgy" else None, population, None, None, None)


@pytest.fixture
def units(table):
    return table([
        unit("0100000000", "Region I", "Reg"), unit("0102800000", "Ilocos Norte", "Prov", "0102800000"), unit("0103300000", "La Union", "Prov", "0103300000"),
        unit("0102801000", "Adams", "Mun", "0102800000", corr="012801000"), unit("0102805000", "City of Batac", "City", "0102800000", old="Old Batac", corr="012805000", population=55),
        unit("0103301000", "Adams", "Mun", "0103300000", corr="013301000"), unit("0103302000", "San Juan", "Mun", "0103300000"), unit("0103303000", "San Juan (Capital)", "Mun", "0103300000"),
        unit("1300000000", "National Capital Region", "Reg"), unit("1380600000", "City of Manila", "City"), unit("1380601000", "Tondo I/II", "SubMun"),
        unit("1380601001", "Barangay 1", "Bgy", city="1380601000"), unit("0102805001", "Quiling Sur", "Bgy", "0102800000", city="0102805000"),
        unit("0102805002", "Very Long Name Of A Barangay In The North", "Bgy", "0102800000", city="0102805000"), unit("0102801001", "Quiling Sur", "Bgy", "0102800000", city="0102801000")], UNIT)


def test_city_names(units, table):
    names = table([("ILOCOS NORTE", "ADAMS"), ("LA UNION", "ADAMS"), ("LA UNION", "SAN JUAN"), ("ILOCOS NORTE", "BATAC CITY"), ("ILOCOS NORTE", "OLD BATAC"), ("NOWHERE", "BATAC CITY"),
                   ("NOWHERE", "ADAMS"), ("NCR FIRST DISTRICT", "TONDO"), ("NCR FIRST DISTRICT", "CITY OF MANILA"), ("ILOCOS NORTE", None)], "province string, municipality string")
    aliases = table([("TONDO", "1380601000", "reviewed")], "name string, psgc_code string, reason string")
    got = {(r["province"], r["municipality"]): (r["name_city_code"], r["name_city_method"], r["name_city_hits"])
           for r in integration.match_city_names(names, integration.unit_keys(units), aliases, {"NCR": "1300000000"}).collect()}
    assert got["ILOCOS NORTE", "ADAMS"] == ("0102801000", "name_exact", 1) and got["LA UNION", "ADAMS"] == ("0103301000", "name_exact", 1)
    assert got["LA UNION", "SAN JUAN"] == (None, None, 2)
    assert got["ILOCOS NORTE", "BATAC CITY"][:2] == ("0102805000", "name_exact") and got["ILOCOS NORTE", "OLD BATAC"][:2] == ("0102805000", "name_old")
    assert got["NOWHERE", "BATAC CITY"][0] == "0102805000" and got["NOWHERE", "ADAMS"][0] is None
    assert got["NCR FIRST DISTRICT", "TONDO"][:2] == ("1380601000", "reviewed_alias") and got["NCR FIRST DISTRICT", "CITY OF MANILA"][0] == "1380600000"
    assert len(got) == 10


def test_school_map_decides_both_levels(units, table):
    enrollment = table([("1", "2023-24", "ILOCOS NORTE", "BATAC CITY", "QUILING SUR", False), ("2", "2023-24", "ILOCOS NORTE", "BATAC CITY", "VERY LONG NAME OF A BARAN", True),
                        ("3", "2023-24", "ILOCOS NORTE", "ADAMS", None, False), ("4", "2023-24", "NOWHERE", "NOTHING", "X", False), ("5", "2023-24", "LA UNION", "ADAMS", "QUILING SUR", False)],
                       "entity_id string, period string, province string, municipality string, barangay string, barangay_possibly_truncated boolean")
    crosswalk = table([("1", "0102805000", "0102805001"), ("3", "0103301000", None), ("5", "0102801000", "0102801001")], "entity_id string, code_city string, code_bgy string")
    aliases = table([], "name string, psgc_code string, reason string")
    out = integration.map_entities(enrollment, crosswalk, units, aliases, {"NCR": "1300000000"}, F.col("entity_id") == "9")
    got = {(r["entity_id"], r["geographic_level"]): (r["psgc_code"], r["match_status"], r["reason"]) for r in out.collect()}
    assert len(got) == 10
    assert got["1", "city_mun"] == ("0102805000", "matched", "code and name agree") and got["1", "bgy"][:2] == ("0102805001", "matched")
    assert got["2", "city_mun"] == ("0102805000", "matched", "name only") and got["2", "bgy"][:2] == ("0102805002", "matched")
    assert got["3", "city_mun"] == (None, "ambiguous", "code and name differ") and got["3", "bgy"][:2] == (None, "ambiguous")
    assert got["4", "city_mun"][:2] == (None, "unmatched") and got["4", "bgy"][:2] == (None, "unmatched")
    # code and name differ, but the barangay's own name supports the code
    assert got["5", "city_mun"] == ("0102801000", "matched", "code, supported by the lower level") and got["5", "bgy"][:2] == ("0102801001", "matched")


def test_estimates_match_by_code_only(units, table):
    estimates = table([(2023, "012805", "012805000", "BATAC CITY"), (2023, "999999", "999999000", "ADAMS")], "estimate_year int, psgc_id string, correspondence_code string, municipality string")
    got = by_key(integration.map_estimates(estimates, units), "psgc_id")
    assert (got["012805"]["psgc_code"], got["012805"]["match_status"], got["012805"]["geographic_level"], got["012805"]["names_agree"]) == ("0102805000", "matched", "city_mun", True)
    assert got["999999"]["match_status"] == "unmatched"


def test_boundaries(units, table):
    features = table([("PH0102805", "PH01028", "City of Batac", "2025-02-13"), ("PH0102899", "PH01028", "Adams", "2025-02-13"), ("PH0103301", "PH01033", "Renamed", "2025-02-13"),
                      ("PH0103377", "PH01033", "San Juan", "2025-02-13"), ("PH0999999", "PH09999", "Nothing", "2025-02-13")], "adm3_pcode string, adm2_pcode string, adm3_name string, valid_on string")
    overrides = table([("PH0999999", "2025-02-13", None, "reviewed_none")], "adm3_pcode string, valid_on string, reviewed_code string, reviewed_method string")
    got = by_key(integration.map_boundaries(features, units, overrides), "adm3_pcode")
    assert (got["PH0102805"]["psgc_code"], got["PH0102805"]["match_method"], got["PH0102805"]["review_status"]) == ("0102805000", "code", "rule")
    assert (got["PH0102899"]["psgc_code"], got["PH0102899"]["match_method"]) == ("0102801000", "name_exact")
    assert (got["PH0103301"]["psgc_code"], got["PH0103301"]["match_status"]) == (None, "ambiguous")  # the code names a unit, the names differ
    assert got["PH0103377"]["match_status"] == "ambiguous" and got["PH0999999"]["review_status"] == "reviewed" and got["PH0999999"]["match_status"] == "unmatched"


def test_census_places(units, table):
    places = table([(2020, "ADAMS", "ILOCOS NORTE", "ILOCOS NORTE", "REGION I"), (2020, "ADAMS", "LA UNION", "LA UNION", "REGION I"), (2020, "CITY OF MANILA", "NCR", None, "NCR"),
                    (2020, "ELSEWHERE", "LA UNION", "LA UNION", "REGION I")], "census_year int, place_name string, parent_name string, province_name string, region_name string")
    regions = table([(2020, "REGION I", "01"), (2020, "NCR", "13")], "census_year int, region_name string, region2 string")
    aliases = table([], "census_year int, province_name string, psgc_code string")
    overrides = table([(2020, "ELSEWHERE", "LA UNION", "0103302000", "renamed")], "census_year int, place_name string, parent_name string, reviewed_code string, reason string")
    got = {(r["place_name"], r["parent_name"]): (r["psgc_code"], r["match_status"], r["review_status"]) for r in integration.map_census_places(places, units, regions, aliases, overrides).collect()}
    assert got == {("ADAMS", "ILOCOS NORTE"): ("0102801000", "matched", "rule"), ("ADAMS", "LA UNION"): ("0103301000", "matched", "rule"),
                   ("CITY OF MANILA", "NCR"): ("1380600000", "matched", "rule"), ("ELSEWHERE", "LA UNION"): ("0103302000", "matched", "reviewed")}


def test_a_shared_name_is_counted_once_per_code(table):
    units = table([(f"U{i}", "p", "SAME") for i in range(500)] + [("V1", "q", "SAME")], "code string, scope string, k_exact string")
    records = table([(i, "p" if i % 2 else "q", "SAME") for i in range(50)], "id int, scope string, k_exact string")
    ladder = (("exact", "k_exact", "k_exact", 1),)
    reference = matching.reference_keys(units, "code", ["scope"], ladder)
    assert reference.count() == 2
    got = matching.resolve(records, ["id"], reference, ["scope"], ladder=ladder)
    assert rows(got.groupBy("match_status", "code").count()) == [("ambiguous", None, 25), ("matched", "V1", 25)]


def square(x, hole=False):
    outer = f"[[{x},0],[{x + 1},0],[{x + 1},1],[{x},1],[{x},0]]"
    inner = f",[[{x + .4},0.4],[{x + .6},0.4],[{x + .6},0.6],[{x + .4},0.6],[{x + .4},0.4]]" if hole else ""
    return f'{{"type": "Polygon", "coordinates": [{outer}{inner}]}}'


@pytest.mark.parametrize("band", [0.07, 0.5, 10.0])
def test_points(table, band):
    multi = '{"type": "MultiPolygon", "coordinates": [[[[5,0],[6,0],[6,1],[5,1],[5,0]]], [[[8,0],[9,0],[9,1],[8,1],[8,0]]]]}'
    shapes = table([("A", "a", square(0)), ("B", "b1", square(2)), ("B", "b2", square(3, hole=True)), ("M", "m", multi)], "place_code string, shape_id string, geometry string")
    points = table([(1, "A", 0.5, 0.5, None), (2, "A", 1.5, 0.5, None), (3, "A", 0.0, 0.5, None), (4, "A", 0.5, 1.0, None), (5, "A", 0.0, 0.0, None), (6, "A", None, None, "missing"),
                    (7, None, 0.5, 0.5, None), (8, "Z", 0.5, 0.5, None), (9, "B", 3.2, 0.2, None), (10, "B", 3.5, 0.5, None), (11, "M", 8.5, 0.5, None), (12, "M", 7.0, 0.5, None), (13, "B", 3.4, 0.5, None)],
                   "id int, place_code string, longitude double, latitude double, coordinate_flag string")
    got = {k: v["boundary_status"] for k, v in by_key(spatial.boundary_status(points, shapes, ["id"], band_height=band), "id").items()}
    assert got == {1: "inside", 2: "outside", 3: "outside", 4: "outside", 5: "outside", 6: "no_usable_point", 7: "no_matched_city", 8: "no_boundary", 9: "inside", 10: "outside",
                   11: "inside", 12: "outside", 13: "outside"}


def test_nearby_uses_every_neighbouring_cell(table):
    points = table([(i, 10 + dx * 0.03, 5 + dy * 0.03) for i, (dx, dy) in enumerate([(0, 0), (1, 1), (-1, 1), (1.01, 0), (0.5, -0.99), (0, 2)])], "id int, longitude double, latitude double")
    got = spatial.nearby(points, points.filter("id = 0"), "id", 0.0300001)
    assert rows(got, "id") == [(0,), (1,), (2,), (4,)]


def test_cut_off_names_of_any_length(spark):
    import random

    rng = random.Random(6)
    names = ["".join(rng.choice("ABÑ ") for _ in range(rng.choice([1, 2, 3, 5, 80]))) for _ in range(300)]
    units = [(f"c{k}", n, f"p{k % 3}") for k, n in enumerate(names)] + [("x", None, "p0"), ("y", "A" * 90, None)]
    cuts = [(k, n[:rng.randint(0, len(n))] if k % 5 else n, f"p{rng.randint(0, 3)}") for k, n in enumerate(names)] + [(900, None, "p0"), (901, "A", None), (902, "A" * 80, "p1")]
    units.append(("long", "A" * 80 + "B", "p1"))
    got = {r["id"]: (r["hits"], r["code"]) for r in matching.prefix_match(
        spark.createDataFrame(cuts, "id int, cut string, parent string"), ["id"], "cut", spark.createDataFrame(units, "code string, name string, parent string"), "name", "code", "parent").collect()}
    want = {}
    for k, cut, parent in cuts:
        codes = {c for c, n, p in units if None not in (cut, n, parent) and p == parent and n.startswith(cut)}
        if codes:
            want[k] = len(codes), codes.pop() if len(codes) == 1 else None
    assert got == want and got[902] == (1, "long") and any(h == 1 for h, _ in want.values())
