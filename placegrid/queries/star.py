"""A planning star derived from the test tables, for the analytics and serving queries.

Customers play the reporting entities, nations the places, order years the periods and order priorities the levels.
Quantities are learner counts; line counts by return flag and status are rooms and teachers. The SQL text beside
each builder says the same thing for the check engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from placegrid import rules
from placegrid.operators import metrics, modelling, priority, serving, trend
from placegrid.session import literal_table, scratch_path

PERIOD, POPULATION_YEAR = "1998", 2000
CENSUSES = {"1996": 1996, "2000": 2000}
REFERENCES = {"ES": 53.0, "JHS": 54.0, "SHS": 56.0}
SCREEN = 130.0
ANNEX = "annex"
LEVELS = ("ES", "JHS", "SHS")
CHANGED_PLACES = ("P03", "P17")
PRIORITIES = {"es_a": "1-URGENT", "es_b": "2-HIGH", "jhs_a": "3-MEDIUM", "jhs_b": "4-NOT SPECIFIED", "shs_a": "5-LOW"}


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


_TABLES: dict[tuple, str] = {}


def published(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A star table written once per application to the shared folder, as the published layer would hold it."""
    key = (spark.sparkContext.applicationId, str(sf), name)
    if key not in _TABLES:
        path = scratch_path(spark, f"star-{name}")
        BUILDERS[name](spark, sf).write.parquet(path)
        _TABLES[key] = path
    return spark.read.parquet(_TABLES[key])


def order_facts(spark, sf):
    lines = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("qty"),
        F.count_if((F.col("l_discount") == 0) & (F.col("l_tax") == 0)).alias("blanks"),
        F.count_if(F.col("l_returnflag") != "R").alias("rooms"), F.count_if(F.col("l_linestatus") == "O").alias("staff"))
    orders = read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("entity_id"),
                                              F.year("o_orderdate").cast("string").alias("period"), F.col("o_orderpriority").alias("priority"))
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey).drop("l_orderkey", "o_orderkey")


def wide_cells(spark, sf):
    """One row per entity and period with its cells; a cell with an unreported line is NULL."""
    cell = {}
    for name, p in PRIORITIES.items():
        here = F.col("priority") == p
        cell[name] = F.when(F.sum(F.when(here, F.col("blanks")).otherwise(0)) == 0, F.sum(F.when(here, F.col("qty")).otherwise(0)))
    offers = {"offers_es": ("1-URGENT", "2-HIGH"), "offers_jhs": ("3-MEDIUM", "4-NOT SPECIFIED"), "offers_shs": ("5-LOW",)}
    low = F.col("priority") == "5-LOW"
    return published(spark, sf, "order_facts").groupBy("entity_id", "period").agg(
        *[c.alias(n) for n, c in cell.items()],
        F.sum(F.when(low, F.col("rooms")).otherwise(0)).alias("shs_new"),
        *[F.bool_or(F.col("priority").isin(*p)).alias(n) for n, p in offers.items()])


def entities(spark, sf):
    balance = F.col("c_acctbal")
    status = F.when(balance < -900, "unmatched").when(balance > 9900, "excluded").otherwise("matched")
    code = F.concat(F.lit("P"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"))
    return read(spark, sf, "customer").select(
        F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("entity_name"), status.alias("match_status"),
        modelling.status_to_key(status, code).alias("place_code"),
        F.when(F.col("c_mktsegment") == "FURNITURE", "Private").when(F.col("c_mktsegment") == "HOUSEHOLD", "SUC/LUC").otherwise("Public").alias("sector"),
        F.when(balance < 0, ANNEX).otherwise("main").alias("annex_status"))


def melted(spark, sf):
    return modelling.melt_levels(wide_cells(spark, sf), ["entity_id", "period"], {
        "ES": ("offers_es", ["es_a", "es_b"]), "JHS": ("offers_jhs", ["jhs_a", "jhs_b"]),
        "SHS": ("offers_shs", ["shs_a", ("shs_new", F.col("period") >= "1999")])})


def fact(spark, sf):
    return melted(spark, sf).join(entities(spark, sf).drop("entity_name"), "entity_id")


def rooms(spark, sf):
    return published(spark, sf, "order_facts").groupBy("entity_id", "period").agg(
        F.when(F.sum("blanks") == 0, F.sum("rooms")).alias("rooms"))


def teachers(spark, sf):
    level = F.when(F.col("priority").isin("1-URGENT", "2-HIGH"), "ES").when(F.col("priority").isin("3-MEDIUM", "4-NOT SPECIFIED"), "JHS").otherwise("SHS")
    return published(spark, sf, "order_facts").groupBy("entity_id", "period", level.alias("level_code")).agg(F.sum("staff").alias("teacher_count"))


def places(spark, sf):
    nation, region = read(spark, sf, "nation"), read(spark, sf, "region")
    code = lambda p, c: F.concat(F.lit(p), F.lpad(F.col(c).cast("string"), 2, "0"))
    regular = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        code("P", "n_nationkey").alias("place_code"), F.col("n_name").alias("place_name"),
        F.when(F.col("n_nationkey") % 2 == 0, "city").otherwise("municipality").alias("place_type"),
        F.when(F.col("n_nationkey") >= 5, code("V", "n_regionkey")).alias("province_code"),
        F.when(F.col("n_nationkey") >= 5, F.concat(F.lit("Province "), F.col("r_name"))).alias("province_name"),
        code("R", "r_regionkey").alias("region_code"), F.concat("r_name", F.lit(" ("), F.substring("r_name", 1, 2), F.lit(")")).alias("region_name"))
    return modelling.with_technical_members(regular, "place_code", "place_name")


def population_cells(spark, sf):
    return read(spark, sf, "orders").filter(F.year("o_orderdate").isin(*CENSUSES.values())).select(
        F.col("o_custkey").alias("entity_id"), F.year("o_orderdate").alias("reference_year"),
        (4 + F.col("o_orderkey") % 15).cast("int").alias("age"),
        F.when(F.col("o_orderstatus") == "F", "female").when(F.col("o_orderstatus") == "O", "male").otherwise("both").alias("sex"),
        F.floor(F.col("o_totalprice") / 10000).alias("population"))


def population(spark, sf):
    placed = population_cells(spark, sf).join(entities(spark, sf).select("entity_id", "place_code", "match_status"), "entity_id")
    summed = modelling.sum_into_members(placed, ["place_code", "reference_year", "age", "sex"], "population", "match_status")
    changed = literal_table(spark, [(p,) for p in CHANGED_PLACES], "place_code string")
    return modelling.comparable_members(summed, "place_code", "reference_year", 2, changed)


def _p(name):
    return lambda spark, sf: published(spark, sf, name)


def provision(spark, sf):
    return metrics.provision(published(spark, sf, "places"), published(spark, sf, "fact"), published(spark, sf, "population"), PERIOD, POPULATION_YEAR, annex=ANNEX)


def screen(spark, sf):
    return metrics.capacity_screen(published(spark, sf, "places"), published(spark, sf, "fact"), published(spark, sf, "rooms"), PERIOD, SCREEN)


def levels(spark, sf):
    return metrics.level_pressure(published(spark, sf, "places"), published(spark, sf, "fact"), published(spark, sf, "teachers"), PERIOD, REFERENCES, annex=ANNEX)


def trends(spark, sf):
    return trend.enrollment_trend(published(spark, sf, "fact"), published(spark, sf, "population"), CENSUSES)


def matrix(spark, sf):
    return priority.priority_matrix(published(spark, sf, "places"), *[published(spark, sf, t) for t in ("provision", "screen", "levels", "trend")], gap_period="2000")


def flags(spark, sf):
    return priority.outlier_flags(*[published(spark, sf, t) for t in ("places", "fact", "rooms", "teachers")], PERIOD, ANNEX)


def sensitivity(spark, sf):
    return priority.sensitivity(*[published(spark, sf, t) for t in ("matrix", "screen", "levels", "flags")], REFERENCES, SCREEN)


def evidence(spark, sf):
    return serving.evidence(*[published(spark, sf, t) for t in ("matrix", "places", "screen", "levels")])


def worklist(spark, sf):
    names = entities(spark, sf).select("entity_id", "entity_name")
    return serving.worklist(*[published(spark, sf, t) for t in ("fact", "rooms", "teachers", "flags")], names, PERIOD, "1995", "2001", LEVELS, SCREEN, ANNEX)


BUILDERS = {"order_facts": order_facts, "fact": fact, "rooms": rooms, "teachers": teachers, "places": places, "population": population, "provision": provision,
            "screen": screen, "levels": levels, "trend": trends, "matrix": matrix, "flags": flags, "sensitivity": sensitivity,
            "scenarios": lambda s, d: priority.scenarios(published(s, d, "sensitivity")), "evidence": evidence, "worklist": worklist}

# ------------------------------------------------------------------------------------------------- check SQL

SQL: dict[str, tuple[tuple[str, ...], str]] = {}


def _sql(name: str, needs: tuple[str, ...], text: str) -> None:
    SQL[name] = (needs, text.strip())


def with_star(needs: tuple[str, ...], body: str) -> str:
    """``body`` with the derivations it needs in front, each once, in order."""
    order: list[str] = []

    def visit(name):
        if name not in order:
            for n in SQL[name][0]:
                visit(n)
            order.append(name)

    for n in needs:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS (\n{SQL[n][1]}\n)" for n in order) + "\n" + body.strip()


_sql("order_facts", (), """
SELECT o.o_custkey AS entity_id, CAST(year(o.o_orderdate) AS VARCHAR) AS period, o.o_orderpriority AS priority,
       l.qty, l.blanks, l.rooms, l.staff
FROM orders o JOIN (
  SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty,
         count(*) FILTER (WHERE l_discount = 0 AND l_tax = 0) AS blanks,
         count(*) FILTER (WHERE l_returnflag <> 'R') AS rooms, count(*) FILTER (WHERE l_linestatus = 'O') AS staff
  FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey""")

_cells = ",\n".join(
    f"CASE WHEN coalesce(sum(blanks) FILTER (WHERE priority = '{p}'), 0) = 0 THEN CAST(coalesce(sum(qty) FILTER (WHERE priority = '{p}'), 0) AS BIGINT) END AS {n}"
    for n, p in PRIORITIES.items())
_sql("wide_cells", ("order_facts",), f"""
SELECT entity_id, period, {_cells},
       CAST(coalesce(sum(rooms) FILTER (WHERE priority = '5-LOW'), 0) AS BIGINT) AS shs_new,
       bool_or(priority IN ('1-URGENT', '2-HIGH')) AS offers_es,
       bool_or(priority IN ('3-MEDIUM', '4-NOT SPECIFIED')) AS offers_jhs, bool_or(priority = '5-LOW') AS offers_shs
FROM order_facts GROUP BY entity_id, period""")

_sql("entities", (), f"""
SELECT c_custkey AS entity_id, c_name AS entity_name,
       CASE WHEN c_acctbal < -900 THEN 'unmatched' WHEN c_acctbal > 9900 THEN 'excluded' ELSE 'matched' END AS match_status,
       CASE WHEN c_acctbal < -900 THEN 'UNKNOWN' WHEN c_acctbal > 9900 THEN 'EXCLUDED'
            ELSE 'P' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') END AS place_code,
       CASE c_mktsegment WHEN 'FURNITURE' THEN 'Private' WHEN 'HOUSEHOLD' THEN 'SUC/LUC' ELSE 'Public' END AS sector,
       CASE WHEN c_acctbal < 0 THEN '{ANNEX}' ELSE 'main' END AS annex_status
FROM customer""")

_sql("melted", ("wide_cells",), """
SELECT entity_id, period, level_code, is_offered, CAST(applicable_cells AS INTEGER) AS applicable_cells,
       CAST(null_cells AS INTEGER) AS null_cells, CAST(published_cell_sum AS BIGINT) AS published_cell_sum,
       CAST(CASE WHEN is_offered IS NULL THEN NULL WHEN NOT is_offered THEN 0 WHEN null_cells = 0 THEN published_cell_sum END AS BIGINT) AS learner_count
FROM (
  SELECT entity_id, period, 'ES' AS level_code, offers_es AS is_offered, 2 AS applicable_cells,
         CAST(es_a IS NULL AS INT) + CAST(es_b IS NULL AS INT) AS null_cells, coalesce(es_a, 0) + coalesce(es_b, 0) AS published_cell_sum FROM wide_cells
  UNION ALL
  SELECT entity_id, period, 'JHS', offers_jhs, 2, CAST(jhs_a IS NULL AS INT) + CAST(jhs_b IS NULL AS INT), coalesce(jhs_a, 0) + coalesce(jhs_b, 0) FROM wide_cells
  UNION ALL
  SELECT entity_id, period, 'SHS', offers_shs, CASE WHEN period >= '1999' THEN 2 ELSE 1 END,
         CAST(shs_a IS NULL AS INT) + CASE WHEN period >= '1999' AND shs_new IS NULL THEN 1 ELSE 0 END,
         coalesce(shs_a, 0) + CASE WHEN period >= '1999' THEN coalesce(shs_new, 0) ELSE 0 END FROM wide_cells)""")

_sql("fact", ("melted", "entities"), """
SELECT m.*, e.match_status, e.place_code, e.sector, e.annex_status FROM melted m JOIN entities e USING (entity_id)""")

_sql("rooms", ("order_facts",), """
SELECT entity_id, period, CASE WHEN sum(blanks) = 0 THEN CAST(sum(rooms) AS BIGINT) END AS rooms FROM order_facts GROUP BY entity_id, period""")

_sql("teachers", ("order_facts",), """
SELECT entity_id, period, CASE WHEN priority IN ('1-URGENT', '2-HIGH') THEN 'ES' WHEN priority IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN 'JHS' ELSE 'SHS' END AS level_code,
       CAST(sum(staff) AS BIGINT) AS teacher_count
FROM order_facts GROUP BY 1, 2, 3""")

_sql("places", (), """
SELECT 'P' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS place_code, n_name AS place_name,
       CASE WHEN n_nationkey % 2 = 0 THEN 'city' ELSE 'municipality' END AS place_type,
       CASE WHEN n_nationkey >= 5 THEN 'V' || lpad(CAST(n_regionkey AS VARCHAR), 2, '0') END AS province_code,
       CASE WHEN n_nationkey >= 5 THEN 'Province ' || r_name END AS province_name,
       'R' || lpad(CAST(r_regionkey AS VARCHAR), 2, '0') AS region_code, r_name || ' (' || left(r_name, 2) || ')' AS region_name,
       'regular' AS member_type
FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'UNKNOWN', 'Unknown', NULL, NULL, NULL, NULL, NULL, 'unknown'
UNION ALL SELECT 'EXCLUDED', 'Excluded from analysis', NULL, NULL, NULL, NULL, NULL, 'excluded'""")

_sql("lgu", ("places",), "SELECT * EXCLUDE (member_type) FROM places WHERE member_type = 'regular'")

_sql("population_summed", ("entities",), """
SELECT e.place_code, CAST(year(o_orderdate) AS INTEGER) AS reference_year, CAST(4 + o_orderkey % 15 AS INTEGER) AS age,
       CASE o_orderstatus WHEN 'F' THEN 'female' WHEN 'O' THEN 'male' ELSE 'both' END AS sex,
       CAST(sum(CAST(floor(o_totalprice / 10000) AS BIGINT)) AS BIGINT) AS population, min(e.match_status) AS match_status
FROM orders o JOIN entities e ON e.entity_id = o.o_custkey
WHERE year(o_orderdate) IN (1996, 2000) GROUP BY 1, 2, 3, 4""")

_sql("population", ("population_summed",), """
SELECT s.*, coalesce(s.place_code NOT IN ('P03', 'P17') AND b.place_code IS NOT NULL, false) AS is_geography_comparable
FROM population_summed s LEFT JOIN (
  SELECT place_code FROM population_summed WHERE place_code NOT IN ('UNKNOWN', 'EXCLUDED')
  GROUP BY place_code HAVING count(DISTINCT reference_year) = 2) b USING (place_code)""")

def first_label(cases: dict[str, str], otherwise: str = "NULL") -> str:
    """A CASE over labels in order of precedence. The labels are fixed values of the results."""
    return "CASE " + " ".join(f"WHEN {condition} THEN {label!r}" for label, condition in cases.items()) + f" ELSE {otherwise} END"


def every_label(cases: dict[str, str], between: str) -> str:
    """The labels of all conditions that hold, joined; empty where none does."""
    return f"concat_ws({between!r}, {', '.join(f'if({c}, {t!r}, NULL)' for t, c in cases.items())})"


def rule_table(name: str, columns: str, rows) -> str:
    """A small rule table for a FROM clause."""
    value = lambda v: "NULL" if v is None else repr(v) if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)}) {name}({columns})"


_sql("public_levels", ("fact",), f"""
SELECT entity_id, place_code, level_code, annex_status = '{ANNEX}' AS annex, coalesce(is_offered, false) AS offered, if(is_offered, learner_count, NULL) AS counted
FROM fact WHERE period = '{PERIOD}' AND sector = 'Public' AND match_status = 'matched'""")

_sql("rollup", ("public_levels",), """
SELECT entity_id, place_code, most > 0 AS is_active, offers - known AS incomplete_levels, known = 0 AND offers > 0 AS is_blank, is_annex, complete_learners
FROM (
  SELECT entity_id, place_code, bool_or(annex) AS is_annex, coalesce(max(counted), 0) AS most, count(counted) AS known, count_if(offered)::BIGINT AS offers,
         coalesce(sum(counted), 0)::BIGINT AS complete_learners
  FROM public_levels GROUP BY entity_id, place_code)""")

# Every reporting entity in one of three states; the measures of a place are parts and wholes made of these counts.
_sql("entity_states", ("rollup",), """
SELECT place_code, is_annex, if(is_blank, 'blank', if(incomplete_levels > 0, 'incomplete', 'complete')) AS state, complete_learners AS learners
FROM rollup WHERE is_active OR is_blank""")

_sql("state_counts", ("lgu", "entity_states"), """
SELECT place_code, coalesce(map_extract_value(n, 'complete'), 0) AS complete_count, coalesce(map_extract_value(n, 'incomplete'), 0) AS incomplete_count,
       coalesce(map_extract_value(n, 'blank'), 0) AS blank_count, coalesce(annexes, 0)::BIGINT AS annex_count, coalesce(map_extract_value(total, 'complete'), 0) AS public_enrollment
FROM lgu LEFT JOIN (
  SELECT place_code, map_from_entries(list((state, n))) AS n, map_from_entries(list((state, total))) AS total, sum(annexes) AS annexes
  FROM (SELECT place_code, state, count(*) AS n, sum(learners)::BIGINT AS total, count_if(is_annex AND state <> 'blank') AS annexes FROM entity_states GROUP BY place_code, state)
  GROUP BY place_code) USING (place_code)""")

_sql("school_age", ("population",), f"""
SELECT place_code, sum(population)::BIGINT AS school_age_population
FROM population SEMI JOIN {rule_table('counted', 'sex, match_status', [('male', 'matched'), ('female', 'matched')])} USING (sex, match_status)
WHERE reference_year = {POPULATION_YEAR} AND age BETWEEN 5 AND 17 GROUP BY place_code""")

_sql("provision_measures", ("state_counts", "school_age"), """
SELECT place_code, measure, part / nullif(whole, 0) AS value FROM (
  SELECT place_code, 'learners' AS measure, public_enrollment::DOUBLE AS part, complete_count AS whole FROM state_counts
  UNION ALL SELECT place_code, 'coverage', 100.0::DOUBLE * complete_count, complete_count + incomplete_count + blank_count FROM state_counts
  UNION ALL SELECT place_code, 'residents', school_age_population::DOUBLE, complete_count + incomplete_count FROM state_counts JOIN school_age USING (place_code))""")

_per_measure = ", ".join(f"any_value(value) FILTER (measure = '{m}') AS {m}" for m in ("learners", "coverage", "residents"))
_why_not = first_label({"no active public school": "active_count = 0", "no school with complete enrollment": "learners_per_school IS NULL", "coverage below 90%": "coverage_pct < 90"})
_sql("provision", ("lgu", "state_counts", "school_age", "provision_measures"), f"""
SELECT *, not_assessed_reason IS NULL AS is_assessed FROM (
  SELECT *, {_why_not} AS not_assessed_reason FROM (
    SELECT lgu.*, '{PERIOD}' AS period, c.* EXCLUDE (place_code), c.complete_count + c.incomplete_count AS active_count, a.school_age_population,
           m.learners AS learners_per_school, m.residents AS residents_per_school, m.coverage AS coverage_pct
    FROM (SELECT place_code, {_per_measure} FROM provision_measures GROUP BY place_code) m
    JOIN lgu USING (place_code) JOIN state_counts c USING (place_code) LEFT JOIN school_age a USING (place_code)))""")

# Learners against rooms (an entity as a whole) and against teachers (an entity's level). A suspected figure has no ratio in
# the scenario that leaves suspects out; everything else is the same statement for both scenarios.
_sql("units", ("public_levels", "rollup", "capacity", "suspects"), """
SELECT scenario, measure, level_code, place_code, active, learners, denominator, annexed, if(scenario = 'kept' AND suspected, NULL, learners::DOUBLE / nullif(denominator, 0)) AS ratio
FROM (
  SELECT u.*, denominator, measure = 'teacher' AND annex AND denominator = 0 AND learners IS NOT NULL AS annexed, suspects.entity_id IS NOT NULL AS suspected
  FROM (
    SELECT 'room' AS measure, 'ALL' AS level_code, entity_id, place_code, is_annex AS annex, is_active AS active, if(is_active AND incomplete_levels = 0, complete_learners, NULL) AS learners
    FROM rollup WHERE is_active OR is_blank
    UNION ALL
    SELECT 'teacher', level_code, entity_id, place_code, annex, true, counted FROM public_levels SEMI JOIN (FROM rollup WHERE is_active OR is_blank) reporting USING (entity_id) WHERE offered) u
  LEFT JOIN capacity USING (entity_id, measure, level_code) LEFT JOIN suspects USING (entity_id, measure, level_code)),
  (VALUES ('all'), ('kept')) s(scenario)""")

_over = f"ratio >= {SCREEN}"
_sql("unit_sums", ("units",), f"""
SELECT scenario, measure, level_code, place_code, count_if(active)::BIGINT AS members, count_if(NOT active)::BIGINT AS blanks, count_if(active AND learners IS NULL)::BIGINT AS silent,
       count_if(active AND denominator > 0)::BIGINT AS able, count_if(active AND denominator = 0)::BIGINT AS at_zero, count_if(active AND denominator IS NULL)::BIGINT AS unstated,
       coalesce(sum(learners), 0)::BIGINT AS learners, count(ratio) AS rated, coalesce(sum(if(ratio IS NULL, 0, learners)), 0)::BIGINT AS rated_learners,
       coalesce(sum(if(ratio IS NULL, 0, denominator)), 0)::BIGINT AS rated_capacity, count_if(annexed)::BIGINT AS annexes, coalesce(sum(if(annexed, learners, 0)), 0)::BIGINT AS annexed_learners,
       count_if({_over})::BIGINT AS over, coalesce(sum(if({_over}, learners, 0)), 0)::BIGINT AS over_learners
FROM units GROUP BY ALL""")

_none = ("members", "blanks", "silent", "able", "at_zero", "unstated", "learners", "rated", "rated_learners", "rated_capacity", "annexes", "annexed_learners", "over", "over_learners")
_zero = lambda table: ", ".join(f"coalesce({table}.{c}, 0) AS {c}" for c in _none)
_share = lambda part, whole: f"100.0::DOUBLE * {part} / nullif({whole}, 0)"
_sql("room_sums", ("lgu", "unit_sums"), f"""
SELECT lgu.place_code, s.scenario, {_zero('u')} FROM lgu CROSS JOIN (VALUES ('all'), ('kept')) s(scenario)
LEFT JOIN (FROM unit_sums WHERE measure = 'room') u ON (u.place_code, u.scenario) = (lgu.place_code, s.scenario)""")

_no_room = first_label({"no active public school": "active_count = 0", "no usable classroom denominator": "learners_per_room IS NULL", "learner coverage below 90%": "learner_coverage_pct < 90"})
_sql("screen", ("lgu", "room_sums"), f"""
SELECT lgu.*, '{PERIOD}' AS period, told.* EXCLUDE (place_code), not_assessed_reason IS NULL AS is_assessed,
       {first_label({'not assessed': 'not_assessed_reason IS NOT NULL', 'reported congestion identified': 'congested_count > 0'}, "'no reported congestion identified'")} AS benchmark_status
FROM lgu JOIN (
  SELECT *, {_no_room} AS not_assessed_reason FROM (
    SELECT place_code, over AS congested_count, over_learners AS congested_learners, rated AS ratio_count, rated_learners AS eligible_learners, rated_capacity AS reported_rooms,
           learners AS public_enrollment, members AS active_count, blanks AS blank_count, silent AS incomplete_count, able AS usable_room_count, at_zero AS zero_room_count,
           unstated AS missing_room_count, rated_learners::DOUBLE / nullif(rated_capacity, 0) AS learners_per_room, {_share('over_learners', 'learners')} AS congested_share_pct,
           {_share('rated_learners', 'learners')} AS learner_coverage_pct, {_share('rated', 'members + blanks')} AS school_coverage_pct
    FROM room_sums WHERE scenario = 'all')) told USING (place_code)""")

_at_level = first_label({"not applicable": "offered_count = 0", "not assessed": "NOT passes_gate", "above reference": "learners_per_teacher > reference"}, "'at or below reference'")
_sql("level_results", ("lgu", "unit_sums"), f"""
SELECT *, {_at_level} AS benchmark_status FROM (
  SELECT *, coalesce(least(offered_count, 1) = 1 AND learner_coverage_pct >= 90 AND learners_per_teacher >= 0, false) AS passes_gate FROM (
    SELECT place_code, scenario, r.level_code, r.reference, members AS offered_count, silent AS incomplete_count, rated AS usable_count, annexes AS zero_annex_count,
           annexed_learners AS zero_annex_learners, learners AS public_enrollment, rated_learners + annexed_learners AS eligible_learners, rated_capacity AS teacher_count,
           (rated_learners + annexed_learners)::DOUBLE / nullif(rated_capacity, 0) AS learners_per_teacher, {_share('rated', 'members')} AS school_coverage_pct,
           {_share('(rated_learners + annexed_learners)', 'learners')} AS learner_coverage_pct
    FROM (
      SELECT lgu.place_code, s.scenario, r.level_code, r.reference, {_zero('u')}
      FROM lgu, (VALUES ('all'), ('kept')) s(scenario), {rule_table('r', 'level_code, reference', [(k, v) for k, v in REFERENCES.items()])}
      LEFT JOIN (FROM unit_sums WHERE measure = 'teacher') u ON (u.place_code, u.scenario, u.level_code) = (lgu.place_code, s.scenario, r.level_code)) r))""")

_sql("level_status", ("lgu", "level_results"), "SELECT lgu.*, r.* EXCLUDE (place_code, scenario) REPLACE (reference::DOUBLE AS reference) FROM level_results r JOIN lgu USING (place_code) WHERE scenario = 'all'")
_sql("level_grid", ("level_status",), "SELECT * EXCLUDE (benchmark_status) FROM level_status")

_measures = ("offered_count", "incomplete_count", "usable_count", "zero_annex_count", "zero_annex_learners", "public_enrollment", "eligible_learners",
             "teacher_count", "learners_per_teacher", "school_coverage_pct", "learner_coverage_pct", "passes_gate", "benchmark_status")
_by_level = lambda measures, after="": ", ".join(f"any_value({m}) FILTER (level_code = '{v}') AS {v.lower()}_{m}{after}" for v in LEVELS for m in measures)
_sql("level_counts", ("level_results",), """
SELECT place_code, scenario, count_if(benchmark_status <> 'not applicable')::BIGINT AS offered, count_if(passes_gate)::BIGINT AS passing, count_if(benchmark_status = 'above reference')::BIGINT AS above,
       coalesce(sum(if(benchmark_status = 'above reference', eligible_learners, 0)), 0)::BIGINT AS above_learners,
       min(if(benchmark_status = 'not applicable', NULL, learner_coverage_pct)) AS lowest
FROM level_results GROUP BY place_code, scenario""")

_sql("levels", ("lgu", "level_results", "level_counts"), f"""
SELECT lgu.*, '{PERIOD}' AS period, offered AS offered_level_count, passing AS passing_level_count, above AS pressured_level_count, above_learners AS pressured_learners, w.* EXCLUDE (place_code),
       {first_label({'no active public school level': 'offered = 0', 'an offered level is below 90% learner coverage': 'passing < offered'})} AS not_assessed_reason, offered > 0 AND passing = offered AS is_assessed,
       {first_label({'not assessed': 'offered = 0', 'pressure signal identified': 'above > 0', 'not fully assessed': 'passing < offered'}, "'no pressure signal identified'")} AS benchmark_status
FROM lgu JOIN level_counts c USING (place_code)
JOIN (SELECT place_code, {_by_level(_measures)} FROM level_results WHERE scenario = 'all' GROUP BY place_code) w USING (place_code)
WHERE scenario = 'all'""")

# Learners of an entity in a year, counted once for all and once more where it is public.
_sql("scope_years", ("fact",), """
SELECT scope, place_code, period, coalesce(sum(learners), 0)::BIGINT AS total, count(learners) AS known, count(*) - count(learners) AS unknown
FROM (
  SELECT entity_id, place_code, period, unnest(if(sector = 'Public', ['whole', 'public'], ['whole'])) AS scope,
         if(count_if(is_offered IS NULL) + count_if(is_offered AND learner_count IS NULL) = 0, sum(if(is_offered, learner_count, 0)), NULL) AS learners
  FROM fact GROUP BY entity_id, place_code, period, sector)
GROUP BY scope, place_code, period""")

_sql("census", ("population",), """
SELECT place_code, reference_year, sum(population)::BIGINT AS school_age_population, bool_and(is_geography_comparable) AS comparable
FROM population WHERE age BETWEEN 5 AND 17 AND sex <> 'both' GROUP BY place_code, reference_year""")

# Every place in every period; its first and last period and the year before are read along the row of its periods.
_sql("periods", ("scope_years", "census"), """
SELECT *, if(lag(year) OVER along = year - 1, lag(all_enrollment) OVER along, NULL) AS previous_enrollment,
       arg_min(row_of, period) OVER whole AS head, arg_max(row_of, period) OVER whole AS tail
FROM (
  SELECT *, struct_pack(at := period, all_learners := all_enrollment, public_learners := public_enrollment, complete := public_counted > 0 AND public_incomplete = 0) AS row_of
  FROM (
    SELECT place_code, period, left(period, 4)::INTEGER AS year, coalesce(w.total, 0) AS all_enrollment, coalesce(w.known, 0) AS counted, coalesce(w.unknown, 0) AS incomplete,
           coalesce(p.total, 0) AS public_enrollment, coalesce(p.known, 0) AS public_counted, coalesce(p.unknown, 0) AS public_incomplete
    FROM (SELECT place_code, unnest((SELECT list(DISTINCT period) FROM scope_years)) AS period FROM (SELECT place_code FROM scope_years UNION SELECT place_code FROM census))
    LEFT JOIN (FROM scope_years WHERE scope = 'whole') w USING (place_code, period)
    LEFT JOIN (FROM scope_years WHERE scope = 'public') p USING (place_code, period)))
WINDOW whole AS (PARTITION BY place_code ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), along AS (PARTITION BY place_code ORDER BY period)""")

_change = lambda new, old, name: f"{new} - {old} AS {name.format('change')}, ({new} - {old})::DOUBLE / nullif({old}, 0) AS {name.format('change_share')}"
_way = lambda new, old: f"list_extract(['decreasing', 'no change', 'increasing'], 2 + sign({new} - {old})::INTEGER)"
_sql("trend", ("periods", "census"), f"""
SELECT t.* EXCLUDE (year, head, tail, row_of, is_place), year AS start_year, census_years.y AS census_year, head['at'] AS first_period, tail['at'] AS latest_period,
       head.all_learners AS first_enrollment, tail.all_learners AS latest_enrollment, head.public_learners AS first_public, tail.public_learners AS latest_public,
       head.complete AND tail.complete AS endpoints_complete, public_enrollment::DOUBLE / nullif(all_enrollment, 0) AS public_share,
       {_change('all_enrollment', 'previous_enrollment', '{}_from_previous')}, {_change('tail.all_learners', 'head.all_learners', '{}_first_to_latest')},
       {_change('tail.public_learners', 'head.public_learners', 'public_{}')},
       if(is_place, {_way('tail.all_learners', 'head.all_learners')}, NULL) AS enrollment_trend,
       if(is_place AND head.complete AND tail.complete AND head.public_learners <> 0, {_way('tail.public_learners', 'head.public_learners')}, NULL) AS public_trend,
       if(is_place, 'regular', lower(t.place_code)) AS member_type, is_place AND coalesce(both_comparable, false) AS is_geography_comparable, school_age_population,
       school_age_population - all_enrollment AS population_gap, (school_age_population - all_enrollment)::DOUBLE / nullif(school_age_population, 0) AS gap_share,
       {first_label({'not available: no census in this period': 'census_years.y IS NULL', 'not available: no census population for this member': 'school_age_population IS NULL'}, "'available'")} AS census_context
FROM (SELECT *, place_code NOT IN ('UNKNOWN', 'EXCLUDED') AS is_place FROM periods) t
LEFT JOIN {rule_table('census_years', 'period, y', sorted(CENSUSES.items()))} USING (period)
LEFT JOIN census ON census.place_code = t.place_code AND census.reference_year = census_years.y
LEFT JOIN (SELECT place_code AS of_place, bool_and(comparable) AS both_comparable FROM census GROUP BY place_code) ON of_place = t.place_code""")

# The category by the number of pressures and the state of growth.
_CATEGORIES = [(2, "up", "Priority 1"), (2, "flat", "Priority 2"), (2, "unknown", "Priority 2"), (1, "up", "Priority 2"), (1, "flat", "Priority 3"), (1, "unknown", "Priority 3"),
               (0, "up", "Monitor"), (0, "flat", "No current pressure identified"), (0, "unknown", "Data review")]
_URGENCY = [(label, i) for i, label in enumerate(rules.PRIORITY_CATEGORIES, 1)]


def _classified(facts: str, after: str = "") -> str:
    """``facts`` (pressures, growth, all assessed) with category, and its place in the order of all; columns end in ``after``.

    Without a pressure, a place that is not assessed in full counts as one whose growth is not known.
    """
    n, c, a = f"pressure_count{after}", f"priority_category{after}", f"affected_learners{after}"
    falling = ", ".join(f"-{v}" for v in (n, a, f"room_affected_learners{after}", f"pressured_level_count{after}", "public_change", "public_change_pct"))
    return f"""
SELECT f.* EXCLUDE (fully), k.{c}, count(*) OVER (ORDER BY row(u.urgency, {falling}, place_code)) AS priority_order{after}
FROM ({facts}) f
JOIN {rule_table('k', f'pressures, growth, {c}', _CATEGORIES)} ON k.pressures = f.{n}
  AND k.growth = if(f.{n} = 0 AND NOT f.fully OR f.is_growing IS NULL, 'unknown', if(f.is_growing, 'up', 'flat'))
JOIN {rule_table('u', 'label, urgency', _URGENCY)} ON u.label = k.{c}"""


# Growth of a place, and the first thing that keeps it from being known.
_sql("growth", ("lgu", "trend"), f"""
SELECT place_code, ends.* EXCLUDE (place_code), gaps.* EXCLUDE (place_code), if(is_geography_comparable, public_trend = 'increasing', NULL) AS is_growing,
       {first_label({'no enrollment trend row': 'ends.place_code IS NULL', 'no census population row': 'NOT coalesce(is_geography_comparable, false) AND residents IS NULL',
                'boundary changed between censuses': 'NOT coalesce(is_geography_comparable, false)', 'public enrollment incomplete in first or latest period': 'NOT coalesce(endpoints_complete, false)',
                'no public enrollment in first period': 'public_trend IS NULL'})} AS growth_not_assessed_reason
FROM lgu LEFT JOIN (
  SELECT place_code, first_public, latest_public, public_change, 100 * public_change_share AS public_change_pct, public_trend, endpoints_complete, is_geography_comparable
  FROM trend WHERE period = latest_period) ends USING (place_code)
LEFT JOIN (SELECT place_code, school_age_population AS residents, population_gap, 100 * gap_share AS gap_pct FROM trend WHERE period = '2000') gaps USING (place_code)""")

_sql("matrix_inputs", ("provision", "screen", "levels", "growth"), """
SELECT growth.* EXCLUDE (residents),
       provision.* EXCLUDE (place_code, period, active_count, annex_count, complete_count, incomplete_count, blank_count, school_age_population, residents_per_school, coverage_pct, is_assessed, not_assessed_reason),
       provision.coverage_pct AS provision_coverage_pct, provision.is_assessed AS provision_assessed,
       room.* EXCLUDE (place_code), teacher.* EXCLUDE (place_code)
FROM growth JOIN provision USING (place_code)
JOIN (SELECT place_code, learners_per_room, learner_coverage_pct AS room_coverage_pct, is_assessed AS room_assessed, congested_count AS room_affected_count,
             congested_learners AS room_affected_learners, congested_share_pct AS room_affected_share_pct, (benchmark_status = 'reported congestion identified')::INT AS room_flag
      FROM screen) room USING (place_code)
JOIN (SELECT place_code, is_assessed AS teacher_assessed, benchmark_status AS teacher_status, pressured_level_count, pressured_learners AS teacher_affected_learners,
             (pressured_level_count > 0)::INT AS teacher_flag FROM levels) teacher USING (place_code)""")

_sql("matrix", ("matrix_inputs",), _classified("""
SELECT *, room_flag + teacher_flag AS pressure_count, list_max([room_affected_learners, teacher_affected_learners, 0]) AS affected_learners,
       room_assessed AND teacher_assessed AS fully FROM matrix_inputs"""))

# Learners (part) by level and over all levels of every entity, against rooms (all levels) and teachers (whole).
_sql("capacity", ("rooms", "teachers"), f"""
SELECT entity_id, 'room' AS measure, 'ALL' AS level_code, rooms AS denominator FROM rooms WHERE period = '{PERIOD}'
UNION ALL SELECT entity_id, 'teacher', level_code, teacher_count FROM teachers WHERE period = '{PERIOD}'""")

_sql("ratios", ("public_levels", "rollup", "capacity", "lgu"), """
SELECT entity_id, place_code, measure, level_code, learners, denominator, place_type, learners::DOUBLE / denominator AS ratio
FROM (
  SELECT entity_id, place_code, coalesce(level_code, 'ALL') AS level_code, if(count(*) = count(counted), sum(counted), NULL)::BIGINT AS learners
  FROM public_levels SEMI JOIN (FROM rollup WHERE is_active OR is_blank) reporting USING (entity_id)
  WHERE offered GROUP BY GROUPING SETS ((entity_id, place_code, level_code), (entity_id, place_code)))
JOIN capacity USING (entity_id, level_code) JOIN lgu USING (place_code)
WHERE denominator > 0 AND learners IS NOT NULL""")

_sql("fences", ("ratios",), """
SELECT measure, level_code, place_type, n AS fence_group_size, q1, q3, q3 - q1 AS iqr, CASE WHEN n >= 10 THEN q1 - 3.0::DOUBLE * (q3 - q1) END AS lower_fence,
       CASE WHEN n >= 10 THEN q3 + 3.0::DOUBLE * (q3 - q1) END AS upper_fence
FROM (SELECT measure, level_code, place_type, count(*) AS n, quantile_cont(ratio, 0.25) AS q1, quantile_cont(ratio, 0.75) AS q3 FROM ratios GROUP BY 1, 2, 3)""")

# The side of the fences a ratio lies on, and the sides that are suspect for a measure.
_SUSPECT_SIDES = [("room", 1), ("teacher", 1), ("teacher", -1)]
_sql("flags", ("ratios", "fences"), f"""
SELECT sided.* EXCLUDE (side), side > 0 AS is_above, side < 0 AS is_below, suspect.side IS NOT NULL AS is_suspected
FROM (SELECT *, coalesce((ratio > upper_fence)::INT - (ratio < lower_fence)::INT, 0) AS side FROM ratios JOIN fences USING (measure, level_code, place_type)) sided
LEFT JOIN {rule_table('suspect', 'measure, side', _SUSPECT_SIDES)} USING (measure, side)""")

_sql("suspects", ("flags",), "SELECT entity_id, measure, level_code FROM flags WHERE is_suspected")

_sql("affected", ("flags",), """
SELECT place_code, count(*) AS outlier_count, CAST(sum(learners) AS BIGINT) AS outlier_learners, CAST(sum(rooms) AS BIGINT) AS room_outlier_count,
       CAST(sum(levels) AS BIGINT) AS teacher_outlier_count
FROM (SELECT place_code, entity_id, coalesce(max(learners) FILTER (WHERE measure = 'room'), sum(learners) FILTER (WHERE measure = 'teacher')) AS learners,
             count(*) FILTER (WHERE measure = 'room') AS rooms, count(*) FILTER (WHERE measure = 'teacher') AS levels
      FROM flags WHERE is_suspected GROUP BY place_code, entity_id) GROUP BY place_code""")

# The figures of the scenario without suspects stand beside the published ones, under names that end in _b.
_lb = ("eligible_learners", "teacher_count", "learners_per_teacher", "learner_coverage_pct", "passes_gate", "benchmark_status")
_sql("second", ("room_sums", "level_results", "level_counts"), f"""
SELECT room.*, teacher.* EXCLUDE (place_code), lowest_coverage_pct, wide.* EXCLUDE (place_code)
FROM (
  SELECT place_code, rated AS ratio_count_b, rated_learners AS room_eligible_b, rated_capacity AS reported_rooms_b, rated_learners::DOUBLE / nullif(rated_capacity, 0) AS learners_per_room_b,
         {_share('rated_learners', 'learners')} AS room_coverage_pct_b, over AS room_affected_count_b, over_learners AS room_affected_learners_b,
         {_share('over_learners', 'learners')} AS room_affected_share_pct_b, coalesce(members > 0 AND rated_learners > 0 AND {_share('rated_learners', 'learners')} >= 90, false) AS room_assessed_b
  FROM room_sums WHERE scenario = 'kept') room
JOIN (SELECT place_code, offered > 0 AND passing = offered AS teacher_assessed_b, above AS pressured_level_count_b, above_learners AS teacher_affected_learners_b, lowest AS lowest_coverage_pct_b
      FROM level_counts WHERE scenario = 'kept') teacher USING (place_code)
JOIN (SELECT place_code, lowest AS lowest_coverage_pct FROM level_counts WHERE scenario = 'all') USING (place_code)
JOIN (SELECT place_code, {_by_level(_lb, '_b')} FROM level_results WHERE scenario = 'kept' GROUP BY place_code) wide USING (place_code)""")

# The first change decides the status; with no learners affected before, any that are affected now are a change.
_changes = dict(zip(rules.SENSITIVITY_STATUSES, ("outlier_count = 0", "category_changed", "room_flag_changed OR teacher_flag_changed", "coverage_gate_changed", "affected_changed", "true")))
_sql("without_outliers", ("matrix", "affected", "second"), _classified("""
SELECT *, room_flag_b + teacher_flag_b AS pressure_count_b, list_max([room_affected_learners_b, teacher_affected_learners_b, 0]) AS affected_learners_b,
       room_assessed_b AND teacher_assessed_b AS fully
FROM matrix
JOIN (SELECT *, (room_assessed_b AND room_affected_count_b > 0)::INT AS room_flag_b, (pressured_level_count_b > 0)::INT AS teacher_flag_b FROM second) USING (place_code)
LEFT JOIN affected USING (place_code)""", "_b"))
_sql("sensitivity", ("without_outliers",), f"""
SELECT *, {first_label(_changes)} AS sensitivity_status
FROM (
  SELECT * REPLACE ({', '.join(f'coalesce({c}, 0) AS {c}' for c in ('outlier_count', 'outlier_learners', 'room_outlier_count', 'teacher_outlier_count'))}),
         {', '.join(f'{c} IS DISTINCT FROM {c}_b AS {n}_changed' for c, n in (('room_flag', 'room_flag'), ('teacher_flag', 'teacher_flag'), ('priority_category', 'category')))},
         room_assessed > room_assessed_b OR teacher_assessed > teacher_assessed_b AS coverage_gate_changed,
         abs(affected_learners_b - affected_learners) > {rules.MAGNITUDE_CHANGE}::DOUBLE * affected_learners AS affected_changed
  FROM without_outliers)""")

_sc = priority.SCENARIO_COLUMNS
_sql("scenarios", ("sensitivity",), f"""
SELECT place_code, 'published' AS scenario, {', '.join(_sc)}, outlier_count, sensitivity_status, coverage_gate_changed FROM sensitivity
UNION ALL
SELECT place_code, 'without suspected outliers', {', '.join(c + '_b' for c in _sc)}, outlier_count, sensitivity_status, coverage_gate_changed FROM sensitivity""")

_sql("labels_sql", ("lgu",), """
SELECT place_code, place_name, place_name || ', ' || coalesce(province_name, region_name) AS place_label,
       coalesce(province_name, 'Independent cities (no province)') AS province_label, region_name,
       regexp_extract(region_name, '[(]([^)]*)[)]', 1) AS region_short, CASE place_type WHEN 'city' THEN 'City' ELSE 'Municipality' END AS type_label
FROM lgu""")

_sql("level_evidence", ("level_status",), """
SELECT place_code, count(*) FILTER (offered_count > 0) AS offered_level_count, min(coalesce(learner_coverage_pct, 0)) FILTER (offered_count > 0) AS teacher_coverage_pct,
       coalesce(string_agg(level_code, ', ' ORDER BY level_code) FILTER (benchmark_status = 'above reference'), '') AS levels_above
FROM level_status GROUP BY place_code""")

_signal = [(1, True, "Signal present"), (1, False, "Signal present"), (0, True, "No signal"), (0, False, "Not assessed")]
_open = {"room": "NOT room_assessed", "teacher": "NOT teacher_assessed", "growth": "is_growing IS NULL"}
_sql("evidence", ("matrix", "labels_sql", "screen", "levels", "level_evidence"), f"""
SELECT matrix.*, place_label, province_label, region_short, type_label, ratio_count, missing_room_count, zero_room_count, level_evidence.* EXCLUDE (place_code),
       rs.signal AS room_signal, ts.signal AS teacher_signal,
       {first_label({'Growing': 'is_growing', 'Not growing': 'NOT is_growing'}, "'Not comparable'")} AS growth_signal,
       coalesce(nullif({every_label({'Classroom': 'room_flag = 1', 'Teacher': 'teacher_flag = 1'}, ' + ')}, ''), 'None identified') AS pressure_signals,
       {first_label({'Data review': "priority_category = 'Data review'", 'Partly assessed': ' OR '.join(_open.values())}, "'Fully assessed'")} AS data_readiness,
       concat_ws('; ', if({_open['room']}, screen.not_assessed_reason, NULL), if({_open['teacher']}, levels.not_assessed_reason, NULL),
                                    if({_open['growth']}, growth_not_assessed_reason, NULL)) AS not_assessed_text
FROM matrix JOIN labels_sql USING (place_code) JOIN screen USING (place_code) JOIN levels USING (place_code) JOIN level_evidence USING (place_code)
JOIN {rule_table('rs', 'flag, assessed, signal', _signal)} ON (rs.flag, rs.assessed) = (room_flag, room_assessed)
JOIN {rule_table('ts', 'flag, assessed, signal', _signal)} ON (ts.flag, ts.assessed) = (teacher_flag, teacher_assessed)""")

# What is listed about an entity, in the order of the text, and the step that it leads to.
_LISTED = {"Missing room count": "f_rooms_missing", "Zero rooms reported": "f_rooms_zero", "Missing learner count": "f_learners_missing", "Missing teacher count": "f_teachers_missing",
           "Zero teachers reported": "f_teachers_zero", "Suspected extreme figure": "f_outlier", "Above classroom screen": "f_above"}
_STEPS = {"Verify reported room count": ("f_rooms_missing", "f_rooms_zero"), "Verify enrollment by level": ("f_learners_missing",),
          "Verify teacher count by level": ("f_teachers_missing", "f_teachers_zero"), "Verify the extreme room or teacher figure": ("f_outlier",),
          "Verify reported room count and enrollment": ("f_above",)}
_STATES = {"Above classroom screen": ("f_above",), "Missing figure": ("f_rooms_missing", "f_learners_missing", "f_teachers_missing"), "Zero reported": ("f_rooms_zero", "f_teachers_zero")}
_any_of = lambda table: {t: " + ".join(names) + " > 0" for t, names in table.items()}

# One row per entity and level, then per entity: each level's figures are a column only at the very end.
_sql("worklist_levels", ("public_levels", "capacity"), f"""
SELECT entity_id, {', '.join(f"bool_or(offered) FILTER (level_code = '{v}') AS offers_{v.lower()}, sum(counted) FILTER (level_code = '{v}')::BIGINT AS {v.lower()}_learners, any_value(denominator) FILTER (level_code = '{v}') AS {v.lower()}_teachers" for v in LEVELS)},
       sum(coalesce(counted, 0)) FILTER (denominator > 0)::DOUBLE / sum(denominator) FILTER (denominator > 0) AS learners_per_teacher,
       bool_or(offered AND denominator IS NULL)::INT AS f_teachers_missing, bool_or(offered AND NOT annex AND coalesce(denominator = 0, false))::INT AS f_teachers_zero
FROM public_levels LEFT JOIN (FROM capacity WHERE measure = 'teacher') USING (entity_id, level_code) GROUP BY entity_id""")

_sql("end_changes", ("fact",), f"""
SELECT entity_id, if(count(*) = count(learner_count) AND base > 0, (total - 2 * base)::DOUBLE / base, NULL) AS enrollment_change
FROM (SELECT *, sum(learner_count) OVER e AS total, sum(if(period = '1995', learner_count, 0)) OVER e AS base FROM fact
      WHERE period IN ('1995', '2001') AND is_offered AND sector = 'Public' AND match_status = 'matched' WINDOW e AS (PARTITION BY entity_id))
GROUP BY entity_id, total, base HAVING count(DISTINCT period) = 2""")

_sql("worklist", ("rollup", "worklist_levels", "capacity", "end_changes", "flags", "entities"), f"""
SELECT *, {first_label(_any_of(_STATES), "'Below classroom screen'")} AS status,
       coalesce(nullif({every_label({t: f'{f} = 1' for t, f in _LISTED.items()}, '; ')}, ''), 'Included by classroom-pressure order') AS why_listed,
       {first_label(_any_of(_STEPS), "'No figure to verify'")} AS next_step,
       count(*) OVER (PARTITION BY place_code ORDER BY row(checks = 0, -learners_per_room, entity_name, entity_id)) AS list_order
FROM (
  SELECT *, {' + '.join(_LISTED.values())} AS checks FROM (
    SELECT *, coalesce(learners_per_room >= {SCREEN}, false)::INT AS f_above, (rooms IS NULL)::INT AS f_rooms_missing, (rooms IS NOT DISTINCT FROM 0)::INT AS f_rooms_zero,
           (learners IS NULL)::INT AS f_learners_missing, (entity_id IN (SELECT entity_id FROM flags WHERE is_suspected))::INT AS f_outlier
    FROM (
      SELECT rollup.*, worklist_levels.* EXCLUDE (entity_id), entity_name, denominator AS rooms, enrollment_change,
             if(incomplete_levels = 0, complete_learners, NULL) AS learners, if(incomplete_levels = 0, complete_learners::DOUBLE / nullif(denominator, 0), NULL) AS learners_per_room
      FROM rollup JOIN worklist_levels USING (entity_id) JOIN entities USING (entity_id) LEFT JOIN end_changes USING (entity_id)
      LEFT JOIN (FROM capacity WHERE measure = 'room') USING (entity_id)
      WHERE is_active OR is_blank)))""")
