"""Analytics (A), dimensional model (G) and serving (D) queries over the planning star."""

from __future__ import annotations

from pyspark.sql import functions as F

from placegrid.session import literal_table
from placegrid.operators import metrics, modelling, priority, serving, spatial
from placegrid.queries import star
from placegrid.queries.registry import register
from placegrid.queries.star import published, read, with_star

# ------------------------------------------------------------------------------------------------- A


@register("a01_entity_completeness", with_star(("rollup",), "SELECT * FROM rollup"))
def a01(spark, sf):
    return metrics.entity_rollup(metrics.in_scope(star.fact(spark, sf), star.PERIOD), annex=star.ANNEX)


@register("a02_coverage_gate", with_star(("rollup",), """
SELECT place_code, schools, complete, coverage_pct, CASE WHEN schools = 0 THEN 'no active entity' WHEN coverage_pct < 95 THEN 'coverage below 95%' END AS not_assessed_reason,
       NOT coalesce(schools = 0 OR coverage_pct < 95, false) AS is_assessed
FROM (SELECT *, 100.0::DOUBLE * complete / nullif(schools, 0) AS coverage_pct FROM (
  SELECT place_code, count(*) FILTER (WHERE is_active OR is_blank) AS schools, count(*) FILTER (WHERE is_active AND incomplete_levels = 0) AS complete FROM rollup GROUP BY 1))"""))
def a02(spark, sf):
    rows = metrics.entity_rollup(metrics.in_scope(star.fact(spark, sf), star.PERIOD), annex=star.ANNEX)
    counts = rows.groupBy("place_code").agg(F.count_if(F.col("is_active") | F.col("is_blank")).alias("schools"),
                                            F.count_if(F.col("is_active") & (F.col("incomplete_levels") == 0)).alias("complete"))
    measured = counts.withColumn("coverage_pct", metrics.percent(F.col("complete"), F.col("schools")))
    return metrics.coverage_gated(measured, [(F.col("schools") == 0, "no active entity"), (F.col("coverage_pct") < 95, "coverage below 95%")])


@register("a03_provision_per_place", with_star(("provision",), "SELECT * FROM provision"))
def a03(spark, sf):
    return metrics.provision(star.places(spark, sf), star.fact(spark, sf), star.population(spark, sf), star.PERIOD, star.POPULATION_YEAR, annex=star.ANNEX)


@register("a04_room_screen", with_star(("screen",), "SELECT * FROM screen"))
def a04(spark, sf):
    return star.screen(spark, sf)


@register("a05_level_pressure", with_star(("levels",), "SELECT * FROM levels"))
def a05(spark, sf):
    return star.levels(spark, sf)


@register("a05_level_grid", with_star(("level_grid",), "SELECT * EXCLUDE (reference) FROM level_grid"))
def a05_grid(spark, sf):
    return metrics.level_grid(*[published(spark, sf, t) for t in ("places", "fact", "teachers")], star.PERIOD, star.LEVELS, annex=star.ANNEX)


@register("a06_enrollment_trend", with_star(("trend",), "SELECT * FROM trend"))
def a06(spark, sf):
    return star.trends(spark, sf)


@register("a07_census_context", with_star(("trend",), """
SELECT place_code, period, census_year, school_age_population, population_gap, gap_share, census_context FROM trend WHERE period IN ('1995', '1996', '2000')"""))
def a07(spark, sf):
    return published(spark, sf, "trend").filter(F.col("period").isin("1995", "1996", "2000")).select(
        "place_code", "period", "census_year", "school_age_population", "population_gap", "gap_share", "census_context")


@register("a08_endpoint_completeness", with_star(("trend",), """
SELECT place_code, first_public, latest_public, endpoints_complete, public_trend FROM trend WHERE period = latest_period"""))
def a08(spark, sf):
    return published(spark, sf, "trend").filter(F.col("period") == F.col("latest_period")).select(
        "place_code", "first_public", "latest_public", "endpoints_complete", "public_trend")


@register("a09_priority_matrix", with_star(("matrix",), "SELECT * FROM matrix"))
def a09(spark, sf):
    return star.matrix(spark, sf)


@register("a10_entity_order", """
SELECT o_custkey AS entity_id, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS orders,
       row_number() OVER (ORDER BY count(*) DESC, sum(CAST(o_totalprice AS DECIMAL(18,2))) DESC, o_custkey) AS position
FROM orders GROUP BY o_custkey""")
def a10(spark, sf):
    from placegrid.operators.scale import position_in_order

    totals = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("entity_id")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"), F.count("*").alias("orders"))
    return position_in_order(totals, [F.col("orders").desc(), F.col("total").desc(), F.col("entity_id").asc()], "position")


@register("a11_outer_fences", with_star(("fences",), "SELECT * FROM fences"))
def a11(spark, sf):
    ratios = priority.entity_ratios(*[published(spark, sf, t) for t in ("places", "fact", "rooms", "teachers")], star.PERIOD, star.ANNEX)
    return priority.tukey_fences(ratios, ["measure", "level_code", "place_type"], "ratio")


@register("a11_price_fences_by_type", """
SELECT p_type, count(*) AS fence_group_size, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3,
       quantile_cont(price, 0.75) - quantile_cont(price, 0.25) AS iqr,
       quantile_cont(price, 0.25) - 3.0::DOUBLE * (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) AS lower_fence,
       quantile_cont(price, 0.75) + 3.0::DOUBLE * (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) AS upper_fence
FROM (SELECT p_type, l_extendedprice / l_quantity AS price FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY p_type""")
def a11_prices(spark, sf):
    lines = read(spark, sf, "lineitem").select("l_partkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    part = read(spark, sf, "part").select("p_partkey", "p_type")
    return priority.tukey_fences(lines.join(part, lines.l_partkey == part.p_partkey), ["p_type"], "price")


@register("a11_suspected_outliers", with_star(("flags",), "SELECT * FROM flags"))
def a11_flags(spark, sf):
    return star.flags(spark, sf)


@register("a12_sensitivity", with_star(("sensitivity",), "SELECT * FROM sensitivity"))
def a12(spark, sf):
    return star.sensitivity(spark, sf)


@register("a13_sensitivity_status", with_star(("sensitivity",), """
SELECT sensitivity_status, count(*) AS places, CAST(sum(outlier_count) AS BIGINT) AS outliers FROM sensitivity GROUP BY 1"""))
def a13(spark, sf):
    return published(spark, sf, "sensitivity").groupBy("sensitivity_status").agg(F.count("*").alias("places"), F.sum("outlier_count").alias("outliers"))


@register("a14_scenarios", with_star(("scenarios",), "SELECT * FROM scenarios"))
def a14(spark, sf):
    return priority.scenarios(published(spark, sf, "sensitivity"))


@register("a15_affected_entities", with_star(("affected",), "SELECT * FROM affected"))
def a15(spark, sf):
    return priority.affected_entities(published(spark, sf, "flags"))


# ------------------------------------------------------------------------------------------------- G


@register("g01_latest_value_per_key", """
SELECT o_custkey, max_by(o_orderpriority, o_orderkey) FILTER (WHERE o_orderstatus <> 'P') AS latest_priority FROM orders GROUP BY o_custkey""")
def g01(spark, sf):
    rows = read(spark, sf, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("known"))
    return modelling.latest_value(rows, ["o_custkey"], "known", "o_orderkey", "latest_priority")


@register("g02_distinct_dimension", """
SELECT period, CAST(period AS INTEGER) AS start_year, period || '-' || right(CAST(CAST(period AS INTEGER) + 1 AS VARCHAR), 2) AS label
FROM (SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR) AS period FROM orders)""")
def g02(spark, sf):
    rows = read(spark, sf, "orders").select(F.year("o_orderdate").cast("string").alias("period"))
    year = F.col("period").cast("int")
    return modelling.distinct_dimension(rows, ["period"], {
        "start_year": year, "label": F.concat_ws("-", "period", F.right((year + 1).cast("string"), F.lit(2)))})


@register("g03_literal_dimension", """
SELECT v.level_code, v.level_name, v.level_order, count(o_orderkey) AS orders
FROM (VALUES ('1-URGENT', 'Urgent', 1), ('2-HIGH', 'High', 2), ('3-MEDIUM', 'Medium', 3), ('9-NONE', 'None', 4)) v(level_code, level_name, level_order)
LEFT JOIN orders ON o_orderpriority = v.level_code GROUP BY 1, 2, 3""")
def g03(spark, sf):
    dim = literal_table(spark, [("1-URGENT", "Urgent", 1), ("2-HIGH", "High", 2), ("3-MEDIUM", "Medium", 3), ("9-NONE", "None", 4)],
                                "level_code string, level_name string, level_order int")
    counts = read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("level_code")).agg(F.count("*").alias("orders"))
    return F.broadcast(dim).join(counts, "level_code", "left").withColumn("orders", F.coalesce("orders", F.lit(0)).cast("bigint"))


def unit_list(spark, sf):
    """Regions, nations and customers as one coded list: RR, NN and serial digits in one code."""
    region, nation, customer = (read(spark, sf, t) for t in ("region", "nation", "customer"))
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    r = region.select(F.concat(two("r_regionkey"), F.lit("0000000000")).alias("code"), F.col("r_name").alias("name"), F.lit("Reg").alias("level"))
    n = nation.select(F.concat(two("n_regionkey"), two("n_nationkey"), F.lit("00000000")).alias("code"), F.col("n_name").alias("name"), F.lit("Prov").alias("level"))
    c = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        F.concat(two("n_regionkey"), two("n_nationkey"), F.lpad((F.col("c_custkey") + 1).cast("string"), 8, "0")).alias("code"),
        F.col("c_name").alias("name"), F.lit("City").alias("level"))
    return r.unionByName(n).unionByName(c)


UNITS_SQL = """
units AS (
  SELECT lpad(CAST(r_regionkey AS VARCHAR), 2, '0') || '0000000000' AS code, r_name AS name, 'Reg' AS level FROM region
  UNION ALL SELECT lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '00000000', n_name, 'Prov' FROM nation
  UNION ALL SELECT lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || lpad(CAST(c_custkey + 1 AS VARCHAR), 8, '0'), c_name, 'City'
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@register("g04_parent_names", f"""WITH {UNITS_SQL}
SELECT u.code, u.name, left(u.code, 2) || '0000000000' AS region_code, left(u.code, 4) || '00000000' AS province_code, r.name AS region_name, p.name AS province_name
FROM units u LEFT JOIN units r ON r.code = left(u.code, 2) || '0000000000' LEFT JOIN units p ON p.code = left(u.code, 4) || '00000000' WHERE u.level = 'City'""")
def g04(spark, sf):
    from placegrid.functions.text import ancestor_code

    units = unit_list(spark, sf).withColumns({"region_code": ancestor_code("code", 2, 12), "province_code": ancestor_code("code", 4, 12)})
    named = modelling.with_parent_names(units, "code", "name", {"region_name": "region_code", "province_name": "province_code"})
    return named.filter(F.col("level") == "City").select("code", "name", "region_code", "province_code", "region_name", "province_name")


@register("g05_technical_members", with_star(("places",), "SELECT * FROM places"))
def g05(spark, sf):
    return star.places(spark, sf)


@register("g05_unknown_children", """
SELECT 'C' || c_custkey AS child_code, c_name AS child_name, 'P' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS place_code, 'regular' AS member_type FROM customer
UNION ALL SELECT 'P' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '-UNKNOWN', 'Unknown', 'P' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0'), 'unknown' FROM nation""")
def g05_children(spark, sf):
    place = lambda c: F.concat(F.lit("P"), F.lpad(F.col(c).cast("string"), 2, "0"))
    children = read(spark, sf, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("child_code"),
                                                  F.col("c_name").alias("child_name"), place("c_nationkey").alias("place_code"))
    parents = read(spark, sf, "nation").select(place("n_nationkey").alias("place_code"))
    return modelling.with_unknown_children(children, parents, "child_code", "child_name", "place_code")


@register("g06_latest_release", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)""")
def g06(spark, sf):
    rows = read(spark, sf, "orders").withColumn("release", F.year("o_orderdate"))
    return modelling.latest_release(rows, "release").select("o_orderkey", "o_custkey", "o_totalprice")


@register("g07_melt_levels", with_star(("melted",), "SELECT * FROM melted"))
def g07(spark, sf):
    return star.melted(spark, sf)


@register("g08_lenient_sum", with_star(("wide_cells",), """
SELECT entity_id, period, CAST(CASE WHEN coalesce(es_a, es_b, jhs_a, jhs_b, shs_a) IS NULL THEN NULL
       ELSE coalesce(es_a, 0) + coalesce(es_b, 0) + coalesce(jhs_a, 0) + coalesce(jhs_b, 0) + coalesce(shs_a, 0) END AS BIGINT) AS lenient_total,
       es_a + es_b + jhs_a + jhs_b + shs_a AS strict_total FROM wide_cells"""))
def g08(spark, sf):
    from placegrid.functions.text import lenient_sum, strict_sum

    cells = ["es_a", "es_b", "jhs_a", "jhs_b", "shs_a"]
    return star.wide_cells(spark, sf).select("entity_id", "period", lenient_sum(cells).alias("lenient_total"), strict_sum(cells).alias("strict_total"))


@register("g09_status_to_key", with_star(("entities",), """
SELECT entity_id, place_code, CASE WHEN match_status = 'matched' AND entity_id % 3 = 0 THEN 'C' || entity_id WHEN match_status = 'matched' THEN place_code || '-UNKNOWN'
       WHEN match_status = 'excluded' THEN 'EXCLUDED' ELSE 'UNKNOWN' END AS child_code FROM entities"""))
def g09(spark, sf):
    rows = star.entities(spark, sf)
    child = F.concat(F.lit("C"), F.col("entity_id").cast("string"))
    child_status = F.when(F.col("entity_id") % 3 == 0, "matched").otherwise("unmatched")
    return rows.select("entity_id", "place_code", modelling.status_to_child_key(
        F.col("match_status"), F.col("place_code"), child_status, child).alias("child_code"))


@register("g10_left_join_with_status", """
SELECT n_nationkey, s.suppliers, s.balance, CASE WHEN s.balance < 5000 THEN 'low_balance' WHEN s.suppliers IS NULL THEN 'not_in_source' ELSE 'available' END AS supplier_status
FROM nation LEFT JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS suppliers, CAST(max(s_acctbal) AS DOUBLE) AS balance FROM supplier GROUP BY 1) s USING (n_nationkey)""")
def g10(spark, sf):
    values = read(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(
        F.count("*").alias("suppliers"), F.max("s_acctbal").alias("balance"))
    members = read(spark, sf, "nation").select("n_nationkey")
    return modelling.left_with_status(members, values, ["n_nationkey"], "supplier_status", [(F.col("balance") < 5000, "low_balance")])


@register("g11_sum_into_members", with_star(("population_summed",), "SELECT * FROM population_summed"))
def g11(spark, sf):
    placed = star.population_cells(spark, sf).join(star.entities(spark, sf).select("entity_id", "place_code", "match_status"), "entity_id")
    return modelling.sum_into_members(placed, ["place_code", "reference_year", "age", "sex"], "population", "match_status")


@register("g12_comparable_members", with_star(("population",), "SELECT * FROM population"))
def g12(spark, sf):
    return star.population(spark, sf)


@register("g13_availability_grid", """
SELECT p.period, s.source_id, bool_or(o.o_orderkey IS NOT NULL) AS has_data
FROM (SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR) || '-' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') AS period FROM orders) p
CROSS JOIN (VALUES ('F'), ('O'), ('P'), ('X')) s(source_id)
LEFT JOIN orders o ON strftime(o_orderdate, '%Y-%m') = p.period AND o.o_orderstatus = s.source_id GROUP BY 1, 2""")
def g13(spark, sf):
    rows = read(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("o_orderstatus").alias("source_id"))
    return modelling.availability_grid(rows, "period", "source_id", ["F", "O", "P", "X"])


@register("g14_conformed_projection", """
SELECT s_suppkey AS entity_id, s_name AS entity_name, s_nationkey AS place_key FROM supplier WHERE s_acctbal > 0""")
def g14(spark, sf):
    return read(spark, sf, "supplier").filter(F.col("s_acctbal") > 0).select(
        F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("entity_name"), F.col("s_nationkey").alias("place_key"))


# ------------------------------------------------------------------------------------------------- D

EV = ("evidence",)


@register("d01_place_labels", with_star(("labels_sql",), "SELECT * FROM labels_sql"))
def d01(spark, sf):
    return serving.place_labels(star.places(spark, sf))


@register("d02_scenario_overlay", with_star(("matrix", "scenarios"), """
SELECT m.place_code, m.place_name, s.priority_category, s.priority_order, s.room_flag, s.affected_learners
FROM matrix m JOIN scenarios s USING (place_code) WHERE s.scenario = 'without suspected outliers'"""))
def d02(spark, sf):
    columns = ["priority_category", "priority_order", "room_flag", "affected_learners"]
    return serving.overlay(published(spark, sf, "matrix"), published(spark, sf, "scenarios"), "without suspected outliers", columns).select(
        "place_code", "place_name", *columns)


@register("d03_place_evidence", with_star(EV, "SELECT * FROM evidence"))
def d03(spark, sf):
    return star.evidence(spark, sf)


_VIEW = ["place_code", "place_label", "priority_category", "pressure_signals", "data_readiness", "not_assessed_text", "rank_in_view"]
_VIEW_SQL = "place_code, place_label, priority_category, pressure_signals, data_readiness, not_assessed_text"


@register("d04_places_in_view", with_star(EV, f"""
SELECT {_VIEW_SQL}, row_number() OVER (ORDER BY priority_order, place_code) AS rank_in_view FROM evidence WHERE type_label = 'City'"""))
def d04(spark, sf):
    return serving.in_view(published(spark, sf, "evidence"), place_type="City").select(_VIEW)


@register("d04_top_ten", with_star(EV, f"""
SELECT {_VIEW_SQL}, rank_in_view FROM (SELECT *, row_number() OVER (ORDER BY priority_order, place_code) AS rank_in_view FROM evidence) WHERE rank_in_view <= 10"""))
def d04_top(spark, sf):
    return serving.top(serving.in_view(published(spark, sf, "evidence")), 10).select(_VIEW)


@register("d04_data_review", with_star(EV, "SELECT place_code, region_short, not_assessed_text FROM evidence WHERE priority_category = 'Data review'"))
def d04_review(spark, sf):
    return published(spark, sf, "evidence").filter(serving.chosen("priority_category", "Data review")).select("place_code", "region_short", "not_assessed_text")


@register("d06_national_kpis", with_star(EV, """
SELECT *, format('{:,}', joint_review) || ' of ' || format('{:,}', places) AS joint_kpi, format('{:,}', any_pressure) || ' of ' || format('{:,}', places) AS any_kpi,
       format('{:,}', data_review) || ' of ' || format('{:,}', places) AS data_review_kpi,
       format('{:,.1f}', 100.0::DOUBLE * learners_above / nullif(public_learners, 0)) || '%' AS learners_share
FROM (SELECT count(*) AS places, count(*) FILTER (WHERE priority_category <> 'Data review') AS assessed, count(*) FILTER (WHERE priority_category = 'Priority 1') AS joint_review,
             count(*) FILTER (WHERE priority_category LIKE 'Priority%') AS any_pressure, count(*) FILTER (WHERE priority_category = 'Data review') AS data_review,
             CAST(sum(coalesce(room_affected_count, 0)) AS BIGINT) AS schools_above, CAST(sum(coalesce(room_affected_learners, 0)) AS BIGINT) AS learners_above,
             CAST(sum(public_enrollment) AS BIGINT) AS public_learners FROM evidence)"""))
def d06(spark, sf):
    return serving.national_kpis(published(spark, sf, "evidence"))


@register("d07_signal_matrix", with_star(EV, """
SELECT room_signal, teacher_signal, count(*) AS places, count(*) FILTER (WHERE growth_signal = 'Growing') AS growing,
       CASE WHEN room_signal = 'Signal present' AND teacher_signal = 'Signal present' THEN 'Priority 1 or 2'
            WHEN room_signal = 'Signal present' OR teacher_signal = 'Signal present' THEN 'Priority 2 or 3'
            WHEN room_signal = 'No signal' AND teacher_signal = 'No signal' THEN 'Monitor or no current pressure' ELSE 'Data review' END AS resulting_status
FROM evidence GROUP BY 1, 2"""))
def d07(spark, sf):
    return serving.signal_matrix(published(spark, sf, "evidence"))


@register("d08_region_by_status", with_star(EV, """
SELECT region_short, priority_category, places, CAST(places AS DOUBLE) / sum(places) OVER (PARTITION BY region_short) AS share,
       CAST(sum(high) OVER (PARTITION BY region_short) AS DOUBLE) / sum(places) OVER (PARTITION BY region_short) AS high_share
FROM (SELECT region_short, priority_category, count(*) AS places, count(*) FILTER (WHERE priority_category IN ('Priority 1', 'Priority 2')) AS high FROM evidence GROUP BY 1, 2)"""))
def d08(spark, sf):
    return serving.share_within(published(spark, sf, "evidence"), "region_short", "priority_category", ["Priority 1", "Priority 2"])


@register("d09_type_by_status", with_star(EV, """
SELECT type_label, priority_category, count(*) AS places, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY type_label) AS share FROM evidence GROUP BY 1, 2"""))
def d09(spark, sf):
    return serving.share_within(published(spark, sf, "evidence"), "type_label", "priority_category")


_PAIRS_SQL = """
SELECT place_code, max(school_age_population) FILTER (WHERE census_year = 1996) AS population_1996, max(school_age_population) FILTER (WHERE census_year = 2000) AS population_2000,
       max(all_enrollment) FILTER (WHERE census_year = 1996) AS enrolled_1996, max(all_enrollment) FILTER (WHERE census_year = 2000) AS enrolled_2000,
       min(CAST(is_geography_comparable AS INTEGER)) AS comparable FROM trend WHERE census_year IS NOT NULL GROUP BY place_code"""


@register("d10_census_pairs", with_star(("trend",), _PAIRS_SQL))
def d10(spark, sf):
    return serving.census_pairs(published(spark, sf, "trend"), [1996, 2000])


@register("d11_region_pairs", with_star(("trend", "labels_sql"), f"""
SELECT region_short, population AS size_order, u.series_order, u.series, CASE u.series_order WHEN 1 THEN population ELSE enrolled END AS people
FROM (SELECT region_short, CAST(sum(population_2000) AS BIGINT) AS population, CAST(sum(enrolled_2000) AS BIGINT) AS enrolled
      FROM labels_sql JOIN ({_PAIRS_SQL}) USING (place_code) GROUP BY 1) r
CROSS JOIN (VALUES (1, 'Resident children'), (2, 'Enrolled learners')) u(series_order, series) WHERE population IS NOT NULL"""))
def d11(spark, sf):
    rows = serving.census_pairs(published(spark, sf, "trend"), [1996, 2000]).join(
        serving.place_labels(published(spark, sf, "places")).select("place_code", "region_short"), "place_code")
    return serving.pair_series(rows, "region_short", {"Resident children": "population_2000", "Enrolled learners": "enrolled_2000"})


@register("d12_pick_one_place", with_star(EV, """
SELECT place_code, place_label, priority_category FROM evidence ORDER BY CASE WHEN place_label = 'NATION_7, Province ASIA' THEN 0 ELSE 1 END, priority_order, place_code LIMIT 1"""))
def d12(spark, sf):
    return serving.pick_one(published(spark, sf, "evidence"), "place_label", "NATION_7, Province ASIA", "priority_order").select(
        "place_code", "place_label", "priority_category")


@register("d13_place_card", with_star(EV, """
SELECT place_code, place_label, priority_category, priority_order, scope_order, scope_total,
       CASE WHEN NOT coalesce(room_assessed, false) THEN 'Not assessed' ELSE format('{:,}', room_affected_count) || ' of ' || format('{:,}', ratio_count) END AS room_kpi, data_readiness
FROM (SELECT *, row_number() OVER (ORDER BY priority_order, place_code) AS scope_order, count(*) OVER () AS scope_total FROM evidence WHERE type_label = 'Municipality')
ORDER BY CASE WHEN place_label = 'NATION_7, Province ASIA' THEN 0 ELSE 1 END, priority_order, place_code LIMIT 1"""))
def d13(spark, sf):
    return serving.place_card(published(spark, sf, "evidence"), "NATION_7, Province ASIA", place_type="Municipality")


@register("d14_decision_rows", with_star(EV, """
SELECT place_code, ord, signal, CASE ord WHEN 1 THEN CASE room_signal WHEN 'Signal present' THEN 'Yes' WHEN 'No signal' THEN 'No' ELSE 'Not assessed' END
       WHEN 2 THEN CASE teacher_signal WHEN 'Signal present' THEN 'Yes' WHEN 'No signal' THEN 'No' ELSE 'Not assessed' END
       WHEN 3 THEN CASE growth_signal WHEN 'Growing' THEN 'Yes' WHEN 'Not growing' THEN 'No' ELSE 'Not assessed' END ELSE priority_category END AS result
FROM evidence CROSS JOIN (VALUES (1, 'Classroom pressure'), (2, 'Teacher pressure'), (3, 'Enrollment growing'), (4, 'Review status')) v(ord, signal)"""))
def d14(spark, sf):
    return serving.decision_rows(published(spark, sf, "evidence"))


@register("d14_evidence_rows", with_star(("evidence", "levels"), """
SELECT e.place_code, v.ord, v.measure, CASE v.ord WHEN 1 THEN e.learners_per_room WHEN 2 THEN l.es_learners_per_teacher WHEN 3 THEN l.jhs_learners_per_teacher
       WHEN 4 THEN l.shs_learners_per_teacher ELSE e.learners_per_school END AS value,
       CASE v.ord WHEN 1 THEN e.room_signal WHEN 2 THEN l.es_benchmark_status WHEN 3 THEN l.jhs_benchmark_status WHEN 4 THEN l.shs_benchmark_status ELSE 'context only' END AS status
FROM evidence e JOIN levels l USING (place_code)
CROSS JOIN (VALUES (1, 'Classroom pressure'), (2, 'Teacher pressure ES'), (3, 'Teacher pressure JHS'), (4, 'Teacher pressure SHS'), (5, 'School network context')) v(ord, measure)"""))
def d14_evidence(spark, sf):
    return serving.evidence_rows(published(spark, sf, "evidence"), published(spark, sf, "levels"), star.REFERENCES)


@register("d15_reliability", with_star(EV, """
SELECT place_code, ord, measure, CASE ord WHEN 1 THEN provision_coverage_pct WHEN 2 THEN room_coverage_pct ELSE teacher_coverage_pct END AS coverage_pct,
       coalesce(CASE ord WHEN 1 THEN provision_assessed WHEN 2 THEN room_assessed ELSE teacher_assessed END, false) AS assessed,
       CASE ord WHEN 2 THEN coalesce(missing_room_count, 0) + coalesce(zero_room_count, 0) ELSE 0 END AS left_out
FROM evidence CROSS JOIN (VALUES (1, 'School network'), (2, 'Classrooms'), (3, 'Teachers')) v(ord, measure)"""))
def d15(spark, sf):
    return serving.reliability_rows(published(spark, sf, "evidence"))


@register("d16_level_shares", with_star(("level_status",), """
SELECT place_code, level_code, CASE WHEN learners_per_teacher IS NOT NULL AND passes_gate THEN learners_per_teacher / reference END AS share_of_reference,
       CASE WHEN learners_per_teacher IS NULL OR NOT passes_gate THEN 'Not assessed' WHEN learners_per_teacher > reference THEN 'Above comparison point'
            ELSE 'At or below comparison point' END AS status
FROM level_status WHERE offered_count > 0"""))
def d16(spark, sf):
    return serving.level_shares(published(spark, sf, "levels"), star.REFERENCES)


@register("d17_enrollment_series", with_star(("trend",), """
SELECT place_code, period, 'Public schools' AS scope, public_enrollment AS learners FROM trend UNION ALL SELECT place_code, period, 'All school sectors', all_enrollment FROM trend"""))
def d17(spark, sf):
    return serving.long_series(published(spark, sf, "trend"), ["place_code", "period"],
                               {"Public schools": "public_enrollment", "All school sectors": "all_enrollment"}, "scope", "learners")


@register("d18_age_bands", with_star(("population",), """
SELECT place_code, age_band, children_first, children_second, CAST(children_second - children_first AS DOUBLE) / nullif(children_first, 0) AS change,
       CASE WHEN children_first IS NULL OR children_second IS NULL THEN 'Not available' WHEN children_second >= children_first THEN 'Increase' ELSE 'Decrease' END AS direction
FROM (SELECT place_code, CASE WHEN age = 5 THEN 'Kindergarten age (5)' WHEN age <= 11 THEN 'Elementary age (6-11)' WHEN age <= 15 THEN 'Junior high age (12-15)' ELSE 'Senior high age (16-17)' END AS age_band,
             CAST(sum(population) FILTER (WHERE reference_year = 1996) AS BIGINT) AS children_first, CAST(sum(population) FILTER (WHERE reference_year = 2000) AS BIGINT) AS children_second
      FROM population WHERE sex IN ('male', 'female') AND age BETWEEN 5 AND 17 GROUP BY 1, 2)"""))
def d18(spark, sf):
    return serving.age_bands(star.population(spark, sf), 1996, 2000)


@register("d19_census_series", with_star(("trend",), """
SELECT place_code, census_year, 'Resident children' AS series, school_age_population AS people FROM trend WHERE census_year IS NOT NULL
UNION ALL SELECT place_code, census_year, 'Enrolled in local schools', all_enrollment FROM trend WHERE census_year IS NOT NULL"""))
def d19(spark, sf):
    rows = published(spark, sf, "trend").filter(F.col("census_year").isNotNull())
    return serving.long_series(rows, ["place_code", "census_year"], {"Resident children": "school_age_population", "Enrolled in local schools": "all_enrollment"}, value="people")


@register("d20_peer_places", with_star(EV, """
SELECT place_code, place_label, affected_learners, priority_category, row_number() OVER (ORDER BY affected_learners DESC, priority_order) AS area_rank,
       count(*) OVER () AS area_places, place_label = 'NATION_7, Province ASIA' AS is_selected FROM evidence WHERE province_label = 'Province ASIA'"""))
def d20(spark, sf):
    return serving.peers(published(spark, sf, "evidence"), "NATION_7, Province ASIA").select(
        "place_code", "place_label", "affected_learners", "priority_category", "area_rank", "area_places", "is_selected")


@register("d21_entity_worklist", with_star(("worklist",), "SELECT * FROM worklist"))
def d21(spark, sf):
    return star.worklist(spark, sf)


@register("d22_places_without_level", with_star(("worklist", "labels_sql"), """
SELECT l.place_code, l.place_name, coalesce(w.entities, 0) AS entities
FROM labels_sql l LEFT JOIN (SELECT place_code, count(*) AS entities, bool_or(offers_es AND es_learners > 2000) AS has FROM worklist GROUP BY 1) w USING (place_code)
WHERE NOT coalesce(w.has, false)"""))
def d22(spark, sf):
    places = serving.place_labels(published(spark, sf, "places")).select("place_code", "place_name")
    has = F.col("offers_es") & (F.col("es_learners") > 2000)
    return serving.without_entity(places, published(spark, sf, "worklist"), "place_code", has)


@register("d24_first_five_per_place", with_star(("worklist",), "SELECT place_code, entity_name, status, why_listed, next_step, list_order FROM worklist WHERE list_order <= 5"))
def d24(spark, sf):
    return serving.top(published(spark, sf, "worklist"), 5, "list_order").select("place_code", "entity_name", "status", "why_listed", "next_step", "list_order")


@register("d25_entity_pressure", with_star(("worklist",), f"""
SELECT place_code, entity_id, 0 AS ord, 'ROOM' AS figure, learners_per_room / {star.SCREEN}::DOUBLE AS share_of_reference FROM worklist
UNION ALL SELECT place_code, entity_id, 1, 'ES', CASE WHEN offers_es THEN CAST(es_learners AS DOUBLE) / nullif(es_teachers, 0) / {star.REFERENCES['ES']}::DOUBLE ELSE 0 END FROM worklist
UNION ALL SELECT place_code, entity_id, 2, 'JHS', CASE WHEN offers_jhs THEN CAST(jhs_learners AS DOUBLE) / nullif(jhs_teachers, 0) / {star.REFERENCES['JHS']}::DOUBLE ELSE 0 END FROM worklist
UNION ALL SELECT place_code, entity_id, 3, 'SHS', CASE WHEN offers_shs THEN CAST(shs_learners AS DOUBLE) / nullif(shs_teachers, 0) / {star.REFERENCES['SHS']}::DOUBLE ELSE 0 END FROM worklist"""))
def d25(spark, sf):
    rows = published(spark, sf, "worklist")
    packs = [F.struct(F.lit(0).alias("ord"), F.lit("ROOM").alias("figure"), (F.col("learners_per_room") / star.SCREEN).alias("share_of_reference"))]
    packs += [F.struct(F.lit(i).alias("ord"), F.lit(v).alias("figure"),
                       F.when(F.col(f"offers_{v.lower()}"), metrics.ratio(F.col(f"{v.lower()}_learners"), F.col(f"{v.lower()}_teachers")) / ref).otherwise(0.0).alias("share_of_reference"))
              for i, (v, ref) in enumerate(star.REFERENCES.items(), 1)]
    return rows.select("place_code", "entity_id", F.inline(F.array(*packs)))


@register("d27_entity_trend", with_star(("fact",), """
SELECT entity_id, period, 'All levels' AS series, CAST(sum(learner_count) AS BIGINT) AS learners FROM fact WHERE is_offered GROUP BY 1, 2
UNION ALL SELECT entity_id, period, level_code, CAST(sum(learner_count) AS BIGINT) FROM fact WHERE is_offered
  AND entity_id IN (SELECT entity_id FROM fact WHERE is_offered GROUP BY 1 HAVING count(DISTINCT level_code) > 1) GROUP BY 1, 2, 3"""))
def d27(spark, sf):
    return serving.entity_trend(published(spark, sf, "fact"))


@register("d28_rooms_table", with_star(("worklist",), """
SELECT entity_id, 1 AS ord, 'ES' AS level, es_learners AS learners, es_teachers AS teachers, CAST(NULL AS BIGINT) AS rooms FROM worklist WHERE offers_es
UNION ALL SELECT entity_id, 2, 'JHS', jhs_learners, jhs_teachers, NULL FROM worklist WHERE offers_jhs
UNION ALL SELECT entity_id, 3, 'SHS', shs_learners, shs_teachers, NULL FROM worklist WHERE offers_shs
UNION ALL SELECT entity_id, 4, 'Whole school', learners, coalesce(es_teachers, 0) + coalesce(jhs_teachers, 0) + coalesce(shs_teachers, 0), rooms FROM worklist"""))
def d28(spark, sf):
    return serving.rooms_table(published(spark, sf, "worklist"), star.LEVELS)


@register("d29_items_to_verify", with_star(("worklist",), "\nUNION ALL ".join(
    f"SELECT place_code, entity_id, {i} AS ord, '{t}' AS item FROM worklist WHERE {f} = 1" for i, (f, t) in enumerate(serving.WHY_LISTED, 1))
    + "\nUNION ALL SELECT place_code, entity_id, 8, 'No figure to verify' FROM worklist WHERE checks = 0"))
def d29(spark, sf):
    return serving.verify_items(published(spark, sf, "worklist"))


@register("d30_filtered_list", with_star(("worklist",), """
SELECT place_code, entity_id, list_order, learners_per_room, learners_per_teacher, enrollment_change FROM worklist WHERE status = 'Missing figure' AND offers_jhs"""))
def d30(spark, sf):
    return published(spark, sf, "worklist").filter(serving.chosen("status", "Missing figure") & F.col("offers_jhs")).select(
        "place_code", "entity_id", "list_order", "learners_per_room", "learners_per_teacher", "enrollment_change")


@register("d32_method_kpis", with_star(EV, """
SELECT count(*) AS places, count(*) FILTER (WHERE room_assessed) AS room_assessed, count(*) FILTER (WHERE teacher_assessed) AS teacher_assessed,
       count(*) FILTER (WHERE offered_level_count > 0) AS offering, count(is_growing) AS trends_comparable, count(*) FILTER (WHERE priority_category = 'Data review') AS data_review FROM evidence"""))
def d32(spark, sf):
    return serving.method_kpis(published(spark, sf, "evidence"))


@register("d32_trend_status", with_star(("trend",), """
SELECT CASE WHEN open_years THEN 'An incomplete school year' WHEN NOT same THEN 'Boundaries changed' ELSE 'Complete and comparable' END AS trend_status, count(*) AS places
FROM (SELECT place_code, bool_or(incomplete > 0) AS open_years, bool_and(is_geography_comparable) AS same FROM trend WHERE member_type = 'regular' GROUP BY 1) GROUP BY 1"""))
def d32_status(spark, sf):
    return serving.trend_status(published(spark, sf, "trend"))


@register("d33_coverage_bands", with_star(("evidence", "level_grid"), """
SELECT measure, coverage_status, count(*) AS places, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY measure) AS share
FROM (SELECT measure, CASE WHEN coverage IS NULL THEN 'Unavailable' WHEN coverage < 90 THEN 'Incomplete (under 90%)' ELSE 'Assessed (90% or more)' END AS coverage_status
      FROM (SELECT 'School network' AS measure, provision_coverage_pct AS coverage FROM evidence UNION ALL SELECT 'Classrooms', room_coverage_pct FROM evidence
            UNION ALL SELECT 'Teachers ' || level_code, learner_coverage_pct FROM level_grid WHERE offered_count > 0)) GROUP BY 1, 2"""))
def d33(spark, sf):
    wide = published(spark, sf, "evidence").join(published(spark, sf, "levels").select(
        "place_code", *[f"{v.lower()}_{c}" for v in star.LEVELS for c in ("offered_count", "learner_coverage_pct")]), "place_code")
    measures = {"School network": ("provision_coverage_pct", None), "Classrooms": ("room_coverage_pct", None)}
    measures |= {f"Teachers {v}": (f"{v.lower()}_learner_coverage_pct", f"{v.lower()}_offered_count > 0") for v in star.LEVELS}
    return serving.coverage_bands(wide, measures)


@register("d34_review_reasons", with_star(("evidence", "screen", "levels"), """
SELECT measure, reason, count(*) AS places FROM (
  SELECT 'Classrooms' AS measure, s.not_assessed_reason AS reason FROM evidence e JOIN screen s USING (place_code) WHERE e.priority_category = 'Data review'
  UNION ALL SELECT 'Teachers', v.not_assessed_reason FROM evidence e JOIN levels v USING (place_code) WHERE e.priority_category = 'Data review'
  UNION ALL SELECT 'Growth', growth_not_assessed_reason FROM evidence WHERE priority_category = 'Data review') WHERE reason IS NOT NULL GROUP BY 1, 2"""))
def d34(spark, sf):
    rows = (published(spark, sf, "evidence").join(published(spark, sf, "screen").select("place_code", F.col("not_assessed_reason").alias("room_reason")), "place_code")
            .join(published(spark, sf, "levels").select("place_code", F.col("not_assessed_reason").alias("teacher_reason")), "place_code"))
    return serving.review_reasons(rows, {"Classrooms": "room_reason", "Teachers": "teacher_reason", "Growth": "growth_not_assessed_reason"})


@register("d35_share_bands", with_star(EV, """
SELECT CASE WHEN coalesce(room_affected_learners, 0) = 0 THEN 'No school above the screen' WHEN room_affected_share_pct < 10 THEN 'Under 10%' WHEN room_affected_share_pct < 25 THEN '10-25%'
            WHEN room_affected_share_pct < 50 THEN '25-50%' ELSE '50% or more' END AS share_band, count(*) AS places FROM evidence WHERE room_assessed GROUP BY 1"""))
def d35(spark, sf):
    band = serving.share_band(F.col("room_affected_learners"), F.col("room_affected_share_pct"))
    return published(spark, sf, "evidence").filter("room_assessed").groupBy(band.alias("share_band")).agg(F.count("*").alias("places"))


@register("d35_level_status_shares", with_star(("level_grid",), """
SELECT level_code, status, count(*) AS places, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY level_code) AS share
FROM (SELECT level_code, CASE WHEN learners_per_teacher IS NULL OR NOT passes_gate THEN 'Not assessed' WHEN learners_per_teacher > reference THEN 'Above comparison point'
             ELSE 'At or below comparison point' END AS status FROM level_grid WHERE offered_count > 0) GROUP BY 1, 2"""))
def d35_levels(spark, sf):
    return serving.share_within(serving.level_shares(published(spark, sf, "levels"), star.REFERENCES), "level_code", "status")


@register("d36_availability_matrix", """
SELECT o_orderstatus AS source_id, """ + ", ".join(
    f"CASE WHEN count(*) FILTER (WHERE strftime(o_orderdate, '%Y-%m') = '{m}') > 0 THEN 'Available' ELSE 'Not available' END AS p_{m.replace('-', '_')}"
    for m in ("1995-01", "2001-07", "2001-12")) + " FROM orders GROUP BY 1 UNION ALL SELECT 'X', 'Not available', 'Not available', 'Not available'")
def d36(spark, sf):
    return serving.availability_matrix(g13(spark, sf), ["1995-01", "2001-07", "2001-12"])


@register("d37_cascading_options", with_star(("labels_sql",), """
SELECT '(All)' AS option, 0 AS ord UNION ALL SELECT DISTINCT province_label, 1 FROM labels_sql WHERE region_name = 'ASIA (AS)'"""))
def d37(spark, sf):
    return serving.options(serving.place_labels(star.places(spark, sf)), "province_label", region_name="ASIA (AS)")


@register("d38_reference_table", with_star(("level_grid", "screen"), f"""
SELECT 'Classroom pressure' AS measure, 'ALL' AS level_code, {star.SCREEN}::DOUBLE AS reference, 'at or above' AS comparison, (SELECT count(*) FROM screen WHERE is_assessed) AS places_assessed
UNION ALL SELECT 'Teacher pressure', level_code, reference, 'above', count(*) FILTER (WHERE passes_gate) FROM level_grid GROUP BY level_code, reference"""))
def d38(spark, sf):
    table = serving.reference_table(spark, star.REFERENCES, star.SCREEN)
    grid = metrics.level_grid(*[published(spark, sf, t) for t in ("places", "fact", "teachers")], star.PERIOD, star.LEVELS, annex=star.ANNEX)
    per_level = grid.groupBy("level_code").agg(F.count_if("passes_gate").alias("places_assessed"))
    rooms = published(spark, sf, "screen").agg(F.count_if("is_assessed").alias("places_assessed")).withColumn("level_code", F.lit("ALL"))
    return table.join(per_level.unionByName(rooms), "level_code")


@register("d38_rule_table", with_star(("matrix",), """
SELECT v.priority_category, v.pressures, v.growing, coalesce(m.places, 0) AS places
FROM (VALUES ('Priority 1', 2, 'yes'), ('Priority 2', 2, 'no or unknown'), ('Priority 2', 1, 'yes'), ('Priority 3', 1, 'no or unknown'), ('Monitor', 0, 'yes'),
             ('No current pressure identified', 0, 'no'), ('Data review', 0, 'unknown, or a gate failed')) v(priority_category, pressures, growing)
LEFT JOIN (SELECT priority_category, pressure_count AS pressures, count(*) AS places FROM matrix GROUP BY 1, 2) m USING (priority_category, pressures)"""))
def d38_rules(spark, sf):
    counts = published(spark, sf, "matrix").groupBy("priority_category", F.col("pressure_count").alias("pressures")).agg(F.count("*").alias("places"))
    return serving.rule_table(spark).join(counts, ["priority_category", "pressures"], "left").withColumn("places", F.coalesce("places", F.lit(0)).cast("bigint"))


# the location queries share one set of points and outlines

_SHAPE = lambda k: f"""'{{"type": "Polygon", "coordinates": [[[' || {k} * 2 || ',0],[' || ({k} * 2 + 1) || ',0],[' || ({k} * 2 + 1) || ',1],[' || ({k} * 2 + 0.5) || ',0.5],[' || {k} * 2 || ',1],[' || {k} * 2 || ',0]]]}}'"""


def shapes(spark, sf):
    """One notched outline per nation but the last five, which have none: a square with a V cut from its top."""
    k = F.col("n_nationkey")
    corner = lambda dx, y: F.concat(F.lit("["), (k * 2 + dx).cast("string"), F.lit(f",{y}]"))
    ring = F.concat_ws(",", corner(0, 0), corner(1, 0), corner(1, 1), corner(F.lit(0.5), 0.5), corner(0, 1), corner(0, 0))
    return read(spark, sf, "nation").filter(k < 20).select(
        F.concat(F.lit("P"), F.lpad(k.cast("string"), 2, "0")).alias("place_code"), F.concat(F.lit("S"), k.cast("string")).alias("shape_id"),
        F.concat(F.lit('{"type": "Polygon", "coordinates": [['), ring, F.lit("]]}")).alias("geometry"))


def points(spark, sf):
    """One point per customer near its nation's outline, from key and balance; some unusable."""
    x = (F.col("c_custkey") % 97) / F.lit(80.0)
    y = (F.col("c_custkey") % 89) / F.lit(83.0)
    place = star.entities(spark, sf).select("entity_id", F.when(F.col("match_status") == "matched", F.col("place_code")).alias("place_code"))
    raw = read(spark, sf, "customer").select(
        F.col("c_custkey").alias("entity_id"), F.when(F.col("c_mktsegment") != "FURNITURE", F.col("c_nationkey") * 2 + x).alias("longitude"), y.alias("latitude"))
    from placegrid.functions.text import coordinate_flag

    return raw.join(place, "entity_id").withColumn("coordinate_flag", coordinate_flag("longitude", "latitude", (-1.0, -1.0, 60.0, 1.05)))


POINTS_SQL = """
points AS (
  SELECT c_custkey AS entity_id, CASE WHEN e.match_status = 'matched' THEN e.place_code END AS place_code, c_nationkey AS k,
         CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_nationkey * 2 + (c_custkey % 97) / 80.0::DOUBLE END AS longitude, (c_custkey % 89) / 83.0::DOUBLE AS latitude
  FROM customer JOIN entities e ON e.entity_id = c_custkey),
flagged AS (
  SELECT *, CASE WHEN longitude IS NULL OR latitude IS NULL THEN 'missing' WHEN longitude = 0 AND latitude = 0 THEN 'zero'
                 WHEN NOT (longitude BETWEEN -1 AND 60 AND latitude BETWEEN -1 AND 1.05) THEN 'outside_box' END AS coordinate_flag FROM points),
located AS (
  SELECT entity_id, place_code, longitude, latitude, coordinate_flag,
         CASE WHEN coordinate_flag IS NULL AND place_code IS NOT NULL AND k < 20 AND longitude > 2 * k AND longitude < 2 * k + 1 AND latitude > 0
                   AND latitude < 0.5 + abs(longitude - 2 * k - 0.5) THEN 'S' || k END AS shape_id,
         CASE WHEN coordinate_flag IS NOT NULL THEN 'no_usable_point' WHEN place_code IS NULL THEN 'no_matched_city' WHEN k >= 20 THEN 'no_boundary'
              WHEN longitude > 2 * k AND longitude < 2 * k + 1 AND latitude > 0 AND latitude < 0.5 + abs(longitude - 2 * k - 0.5) THEN 'inside' ELSE 'outside' END AS boundary_status
  FROM flagged)"""


def _located_sql(body):
    return with_star(("entities",), "").rstrip() + ",\n" + POINTS_SQL.strip() + "\n" + body


def located(spark, sf):
    return spatial.boundary_status(points(spark, sf), shapes(spark, sf), ["entity_id"], band_height=0.1)


@register("i12_point_in_boundary", _located_sql("SELECT * FROM located"))
def i12(spark, sf):
    return located(spark, sf)


@register("d05_map_shapes_note", with_star(EV, """
SELECT 'Drawn ' || format('{:,}', count(*) FILTER (WHERE place_code < 'P20')) || ' of ' || format('{:,}', count(*)) || ' places in view.' AS map_line FROM evidence"""))
def d05(spark, sf):
    return serving.drawn_note(published(spark, sf, "evidence"), shapes(spark, sf))


@register("d05_map_shapes", with_star(EV, """
SELECT place_code, priority_category, CASE WHEN place_code < 'P20' THEN 4 END AS drawn_points FROM evidence"""))
def d05_shapes(spark, sf):
    rows = serving.map_shapes(published(spark, sf, "evidence").select("place_code", "priority_category"), shapes(spark, sf), 2)
    return rows.select("place_code", "priority_category", F.when(F.col("outline").isNotNull(), F.aggregate(
        "outline", F.lit(0), lambda acc, r: acc + F.size(r))).alias("drawn_points"))


@register("d23_points_inside_note", _located_sql("""
SELECT place_code, count(*) AS entities, count(*) FILTER (WHERE boundary_status = 'inside') AS mapped, count(*) FILTER (WHERE boundary_status = 'outside') AS outside,
       count(*) FILTER (WHERE boundary_status = 'no_usable_point') AS no_usable_point, count(*) FILTER (WHERE boundary_status IN ('no_matched_city', 'no_boundary')) AS not_validated
FROM located GROUP BY place_code"""))
def d23(spark, sf):
    return serving.location_note(located(spark, sf), ["place_code"])


@register("d26_nearby_entities", _located_sql("""
SELECT p.entity_id, c.entity_id AS near_entity_id, p.longitude, p.latitude FROM located p JOIN located c
  ON abs(p.longitude - c.longitude) <= 0.03 AND abs(p.latitude - c.latitude) <= 0.03
WHERE p.boundary_status = 'inside' AND c.boundary_status = 'inside' AND c.entity_id IN (SELECT min(entity_id) FROM located WHERE boundary_status = 'inside' GROUP BY place_code)"""))
def d26(spark, sf):
    inside = located(spark, sf).filter(F.col("boundary_status") == "inside")
    selected = inside.groupBy("place_code").agg(F.min_by(F.struct("entity_id", "longitude", "latitude"), "entity_id").alias("s")).select("s.*")
    return spatial.nearby(inside, selected, "entity_id", 0.03).select("entity_id", "near_entity_id", "longitude", "latitude")
