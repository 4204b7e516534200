"""The answers against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from helpers import by_key, rows
from placegrid import rules
from placegrid.operators import metrics, priority, trend
from placegrid.plans import analytics

ANNEX = metrics.ANNEX
FACT = "entity_id string, period string, level_code string, place_code string, sector string, match_status string, annex_status string, is_offered boolean, learner_count bigint"
PLACE = "place_code string, place_name string, place_type string, province_code string, province_name string, region_code string, region_name string, member_type string"
POP = "place_code string, reference_year int, age int, sex string, population bigint, match_status string, is_geography_comparable boolean"


def school(sid, place, es=None, jhs=None, shs=None, period="2023-24", sector="Public", annex="Mother school"):
    """One row per level; a level given as 'blank' is offered without a count."""
    return [(sid, period, level, place, sector, "matched", annex, n is not None, None if n == "blank" else (n or 0))
            for level, n in (("ES", es), ("JHS", jhs), ("SHS", shs))]


@pytest.fixture
def places(table):
    return table([("C1", "Alpha", "city", "P1", "Prov", "R1", "Reg (R)", "regular"), ("M1", "Beta", "municipality", "P1", "Prov", "R1", "Reg (R)", "regular"),
                  ("M2", "Gamma", "municipality", None, None, "R1", "Reg (R)", "regular"), ("UNKNOWN", "Unknown", None, None, None, None, None, "unknown")], PLACE)


def test_provision(table, places):
    fact = table(school("a", "C1", es=100) + school("b", "C1", es=50, jhs=30) + school("c", "C1", es="blank") + school("d", "M1", es=0), FACT)
    population = table([("C1", 2024, a, s, 10, "matched", True) for a in (4, 5, 17, 18) for s in ("male", "female", "both")], POP)
    got = by_key(metrics.provision(places, fact, population, "2023-24", 2024), "place_code")
    assert set(got) == {"C1", "M1", "M2"}
    c1 = got["C1"]
    assert (c1["active_count"], c1["complete_count"], c1["blank_count"], c1["public_enrollment"]) == (2, 2, 1, 180)
    assert (c1["learners_per_school"], c1["school_age_population"], c1["residents_per_school"]) == (90.0, 40, 20.0)
    assert c1["coverage_pct"] == pytest.approx(200 / 3) and c1["not_assessed_reason"] == rules.LOW_COVERAGE
    assert got["M1"]["not_assessed_reason"] == rules.NO_ACTIVE and got["M2"]["is_assessed"] is False


def test_room_screen_is_inclusive_and_weighted_by_learners(table, places):
    fact = table(school("a", "C1", es=100) + school("b", "C1", es=99) + school("c", "C1", es=10) + school("d", "M1", es=100) + school("e", "M1", es=1), FACT)
    rooms = table([("a", "2023-24", 2), ("b", "2023-24", 2), ("c", "2023-24", 0), ("d", "2023-24", 4)], "entity_id string, period string, rooms bigint")
    got = by_key(metrics.capacity_screen(places, fact, rooms, "2023-24"), "place_code")
    c1 = got["C1"]
    assert (c1["congested_count"], c1["congested_learners"], c1["ratio_count"], c1["zero_room_count"]) == (1, 100, 2, 1)
    assert c1["learners_per_room"] == 199 / 4 and c1["learner_coverage_pct"] == pytest.approx(100 * 199 / 209)
    assert c1["is_assessed"] and c1["benchmark_status"] == "reported congestion identified"
    assert got["M1"]["learner_coverage_pct"] == pytest.approx(100 * 100 / 101) and got["M1"]["missing_room_count"] == 1
    assert got["M1"]["benchmark_status"] == "no reported congestion identified" and got["M2"]["benchmark_status"] == "not assessed"


def test_level_thresholds_are_exclusive_and_a_failed_level_hides_no_signal(table, places):
    fact = table(school("a", "C1", es=35, jhs=37) + school("x", "C1", shs="blank") + school("n", "M1", es=70) + school("m", "M1", es=5, annex=ANNEX), FACT)
    teachers = table([("a", "2023-24", "ES", 1), ("a", "2023-24", "JHS", 1), ("n", "2023-24", "ES", 2), ("m", "2023-24", "ES", 0)],
                     "entity_id string, period string, level_code string, teacher_count bigint")
    got = by_key(metrics.level_pressure(places, fact, teachers, "2023-24"), "place_code")
    c1, m1 = got["C1"], got["M1"]
    assert c1["es_benchmark_status"] == "at or below reference" and c1["jhs_benchmark_status"] == "above reference"
    assert c1["shs_benchmark_status"] == "not assessed" and c1["is_assessed"] is False
    assert c1["benchmark_status"] == "pressure signal identified" and c1["not_assessed_reason"] == rules.LOW_LEVEL_COVERAGE
    assert (m1["es_zero_annex_count"], m1["es_eligible_learners"], m1["es_teacher_count"]) == (1, 75, 2)
    assert m1["es_learners_per_teacher"] == 37.5 and m1["es_benchmark_status"] == "above reference"
    assert got["M2"]["not_assessed_reason"] == rules.NO_LEVEL and got["M2"]["benchmark_status"] == "not assessed"


def test_trend(table):
    fact = table(school("a", "C1", es=100, period="2020-21") + school("a", "C1", es=120, period="2021-22") + school("a", "C1", es=150, period="2023-24")
                 + school("p", "C1", es=40, period="2020-21", sector="Private") + school("o", "C1", es=999, period="2020-21", sector="PSO")
                 + school("b", "M1", es="blank", period="2020-21") + school("b", "M1", es=10, period="2023-24")
                 + school("u", "UNKNOWN", es=7, period="2021-22"), FACT)
    population = table([("C1", 2020, 5, "male", 500, "matched", True), ("M9", 2020, 6, "female", 30, "matched", False)], POP)
    got = {(r["place_code"], r["period"]): r for r in trend.enrollment_trend(fact, population, {"2020-21": 2020}).collect()}
    assert len(got) == 4 * 3
    c = got["C1", "2021-22"]
    assert (c["all_enrollment"], c["change_from_previous"], c["first_public"], c["latest_public"], c["public_trend"]) == (120, -20, 100, 150, "increasing")
    assert got["C1", "2023-24"]["change_from_previous"] is None  # 2022-23 is missing, so the years are not adjacent
    assert got["C1", "2020-21"]["population_gap"] == 360 and got["C1", "2020-21"]["census_context"] == "available"
    assert got["C1", "2021-22"]["census_context"].startswith("not available: no census")
    assert got["M1", "2023-24"]["endpoints_complete"] is False and got["M1", "2023-24"]["public_trend"] is None
    assert got["UNKNOWN", "2021-22"]["enrollment_trend"] is None and got["UNKNOWN", "2021-22"]["member_type"] == "unknown"
    assert got["M9", "2020-21"]["all_enrollment"] == 0 and got["M9", "2020-21"]["is_geography_comparable"] is False


@pytest.mark.parametrize("pressures, growing, full, want", [
    (2, True, True, "Priority 1"), (2, None, False, "Priority 2"), (2, False, True, "Priority 2"), (1, True, True, "Priority 2"), (1, None, True, "Priority 3"),
    (1, False, False, "Priority 3"), (0, True, True, "Monitor"), (0, False, True, "No current pressure identified"), (0, None, True, "Data review"), (0, True, False, "Data review")])
def test_category_rule(table, pressures, growing, full, want):
    df = table([(pressures, growing, full)], "p int, g boolean, f boolean")
    assert df.select(priority.category(F.col("p"), F.col("g"), F.col("f"))).first()[0] == want


def test_rank_breaks_ties_in_the_stated_order(table):
    schema = "place_code string, priority_category string, pressure_count int, affected_learners bigint, room_affected_learners bigint, pressured_level_count bigint, public_change bigint, public_change_pct double"
    df = table([("D", "Priority 2", 1, 5, 5, 1, None, None), ("C", "Priority 2", 1, 5, 5, 1, 3, 1.0), ("B", "Priority 2", 1, 5, 5, 1, 3, 1.0),
                ("A", "Data review", 0, 0, 0, 0, 9, 9.0), ("E", "Priority 1", 2, 1, 1, 0, 0, 0.0), ("F", "Priority 2", 2, 1, 1, 0, 0, 0.0)], schema)
    assert [r["place_code"] for r in priority.rank_places(df, "o").orderBy("o").collect()] == ["E", "F", "B", "C", "D", "A"]


def test_fences(table):
    data = [("g", float(v)) for v in range(10, 21)] + [("g", 400.0), ("small", 1.0), ("small", 900.0)]
    got = rows(priority.flag_outliers(table(data, "k string, v double"), ["k"], "v", F.lit(True)).filter("is_suspected"), "k", "v")
    assert got == [("g", 400.0)]


def test_sensitivity_statuses(table):
    base = dict(outlier_count=1, category_changed=False, room_flag_changed=False, teacher_flag_changed=False, coverage_gate_changed=False, affected_changed=False)
    cases = [(dict(outlier_count=0, category_changed=True), "No suspected outliers"), (dict(category_changed=True, room_flag_changed=True), "Priority-sensitive"),
             (dict(teacher_flag_changed=True, coverage_gate_changed=True), "Classification-sensitive"), (dict(coverage_gate_changed=True, affected_changed=True), "Coverage-sensitive"),
             (dict(affected_changed=True), "Magnitude-sensitive"), ({}, "Stable")]
    df = table([tuple((base | c).values()) for c, _ in cases], ", ".join(f"{k} {'int' if k == 'outlier_count' else 'boolean'}" for k in base))
    assert [r[0] for r in df.select(priority.sensitivity_status()).collect()] == [w for _, w in cases]


def test_whole_chain_with_published_names(table, places):
    """One extreme school makes the place congested; without it the pressure is gone."""
    published = {"entity_id": "school_id", "period": "school_year", "level_code": "education_level_code", "place_code": "city_mun_psgc_code", "match_status": "psgc_match_status"}
    steady = [r for i in range(12) for y, n in (("2020-21", 90 + i), ("2023-24", 100 + i), ("2024-25", 100), ("2025-26", 110 + i)) for r in school(f"s{i}", "C1", es=n, period=y)]
    odd = [r for y in ("2020-21", "2023-24", "2025-26") for r in school("odd", "C1", es=400, period=y)]
    fact = table(steady + odd, FACT).withColumnsRenamed(published)
    rooms = table([(f"s{i}", "2023-24", 4) for i in range(12)] + [("odd", "2023-24", 1)], "school_id string, school_year string, instructional_classrooms_total bigint")
    teachers = table([(f"s{i}", "2023-24", "ES", 5) for i in range(12)] + [("odd", "2023-24", "ES", 18)], "school_id string, school_year string, education_level_code string, teacher_count bigint")
    population = table([("C1", y, 6, "male", 900, "matched", True) for y in (2020, 2024)], POP)
    out = analytics.answer(places, fact, population, rooms, teachers)
    m = by_key(out["matrix"], "place_code")
    assert m["C1"]["priority_category"] == "Priority 2" and m["C1"]["is_growing"] is True and m["C1"]["affected_learners"] == 400
    assert m["M1"]["priority_category"] == "Data review"
    s = by_key(out["sensitivity"], "place_code")["C1"]
    assert (s["outlier_count"], s["outlier_learners"], s["room_flag"], s["room_flag_b"]) == (1, 400, 1, 0)
    # the school's 400 learners stay in the coverage denominator, so the gate fails without it
    assert s["room_assessed_b"] is False and s["priority_category_b"] == "Data review" and s["sensitivity_status"] == "Priority-sensitive"
    assert rows(out["scenarios"].filter("place_code = 'C1'"), "scenario", "priority_category") == [("published", "Priority 2"), ("without suspected outliers", "Data review")]
    from helpers import statuses
    assert set(statuses(analytics.gate_matrix(out["matrix"], places)).values()) == {"PASS"}
