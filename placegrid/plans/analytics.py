"""The answers chain: provision, rooms, teachers, trend, then category, outliers, sensitivity and scenarios."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from placegrid import rules
from placegrid.operators import gates, metrics, priority, trend
from placegrid.plans.names import to_package
from placegrid.session import materialize

# The published analysis year, its population year, the census pairs and the gap year.
PERIOD, POPULATION_YEAR, GAP_PERIOD = "2023-24", 2024, "2024-25"
CENSUSES = {"2020-21": 2020, "2024-25": 2024}


def answer(places: DataFrame, fact: DataFrame, population: DataFrame, rooms: DataFrame, teachers: DataFrame, period: str = PERIOD,
           population_year: int = POPULATION_YEAR, censuses: Mapping[str, int] = CENSUSES, gap_period: str = GAP_PERIOD,
           references: Mapping[str, float] = rules.TEACHER_REFERENCES, screen: float = rules.ROOM_SCREEN,
           annex: str = metrics.ANNEX) -> dict[str, DataFrame]:
    """Every table of the chain by name. Each is written once and read by the next, as a published table would be."""
    places, fact, population, rooms, teachers = map(to_package, (places, fact, population, rooms, teachers))
    out = {
        "provision": metrics.provision(places, fact, population, period, population_year, annex=annex),
        "screen": metrics.capacity_screen(places, fact, rooms, period, screen),
        "levels": metrics.level_pressure(places, fact, teachers, period, references, annex=annex),
        "trend": trend.enrollment_trend(fact, population, censuses),
        "flags": priority.outlier_flags(places, fact, rooms, teachers, period, annex),
    }
    out = {name: materialize(df) for name, df in out.items()}
    out["matrix"] = materialize(priority.priority_matrix(places, *[out[t] for t in ("provision", "screen", "levels", "trend")], gap_period))
    out["sensitivity"] = materialize(priority.sensitivity(*[out[t] for t in ("matrix", "screen", "levels", "flags")], references, screen))
    out["scenarios"] = priority.scenarios(out["sensitivity"])
    return out


def gate_matrix(matrix: DataFrame, places: DataFrame) -> DataFrame:
    """The checks a matrix must pass before it is published."""
    known = F.col("priority_category").isin(*rules.PRIORITY_CATEGORIES)
    return gates.all_checks(
        gates.rows_reconcile("one_row_per_place", matrix, whole=metrics.regular_places(to_package(places))),
        gates.key_checks(matrix, ["place_code"]), gates.key_checks(matrix, ["priority_order"], "order"),
        gates.foreign_key(matrix, "place_code", to_package(places), "place_code", "place_resolves"),
        gates.run_checks(matrix, [
            gates.rule_holds("category_known", known),
            gates.rule_holds("pressure_count_adds_up", F.col("pressure_count") == F.col("room_flag") + F.col("teacher_flag")),
            gates.rule_holds("affected_is_greatest", F.col("affected_learners") == F.greatest(
                F.coalesce("room_affected_learners", F.lit(0)), F.coalesce("teacher_affected_learners", F.lit(0))))]))
