"""Profiling and comparison queries (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from placegrid.operators import profiling
from placegrid.queries import star
from placegrid.queries.cleaning import SHAPE_KIND_SQL, customer_shapes
from placegrid.queries.matching import _RESOLVED_SQL, _TWO_SQL, resolved, two_evidence
from placegrid.queries.registry import register
from placegrid.queries.star import read, with_star

_PROFILED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "remark"]


@register("p01_column_profile", "\nUNION ALL ".join(f"""
SELECT '{c}' AS column_name, count(*) AS rows, count(*) FILTER (WHERE v IS NOT NULL AND v <> '') AS filled, count(DISTINCT CASE WHEN v <> '' THEN v END) AS distinct_values, count(*) FILTER (WHERE TRY_CAST(v AS DOUBLE) = 0) AS zeros,
       CASE WHEN count(*) FILTER (WHERE v <> '') = 0 THEN 'empty' WHEN count(*) FILTER (WHERE v <> '' AND TRY_CAST(v AS DOUBLE) IS NULL) = 0 THEN 'number' ELSE 'text' END AS kind,
       min(TRY_CAST(v AS DOUBLE)) AS min_number, max(TRY_CAST(v AS DOUBLE)) AS max_number
FROM (SELECT {'CAST(' + c + ' AS VARCHAR)' if c != 'remark' else "CASE WHEN o_orderstatus = 'P' THEN '' END"} AS v FROM orders)""" for c in _PROFILED))
def p01(spark, sf):
    rows = read(spark, sf, "orders").withColumn("remark", F.when(F.col("o_orderstatus") == "P", ""))
    return profiling.column_profile(rows, _PROFILED)


@register("p01_exact_medians", "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_partkey")))
def p01_medians(spark, sf):
    return profiling.column_medians(read(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_partkey"])


@register("p01_top_values", "SELECT p_name AS value, count(*) AS rows FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def p01_top(spark, sf):
    part = read(spark, sf, "part").select("p_partkey", "p_name")
    return profiling.top_values(read(spark, sf, "lineitem").select("l_partkey").join(part, F.col("p_partkey") == F.col("l_partkey")), "p_name", 10)


@register("p02_key_profile", """
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (WHERE k = ''), 0) AS BIGINT) AS blank, CAST(coalesce(sum(n) FILTER (WHERE k <> '' AND NOT regexp_matches(k, '^[0-9]{4}$')), 0) AS BIGINT) AS malformed,
       CAST(coalesce(sum(n) FILTER (WHERE k <> '' AND length(k) <> 4), 0) AS BIGINT) AS wrong_length, count(*) FILTER (WHERE k <> '' AND n > 1) AS repeated_keys,
       (SELECT count(*) FROM orders) - (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders)) AS repeated_rows
FROM (SELECT CAST(o_custkey AS VARCHAR) AS k, count(*) AS n FROM orders GROUP BY 1)""")
def p02(spark, sf):
    rows = read(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")
    return profiling.key_profile(rows, "o_custkey", "^[0-9]{4}$", 4)


@register("p03_count_column_checks", with_star(("wide_cells",), "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, 0 AS not_whole, count(*) FILTER (WHERE v < 0) AS negative, count(*) FILTER (WHERE NOT {o} AND v IS NOT NULL) AS filled_not_offered FROM (SELECT *, {e} AS v FROM wide_cells)"
    for c, e, o in (("es_a", "es_a", "offers_es"), ("jhs_change", "jhs_a - jhs_b", "offers_es")))))
def p03(spark, sf):
    rows = star.wide_cells(spark, sf).withColumn("jhs_change", F.col("jhs_a") - F.col("jhs_b"))
    return profiling.count_checks(rows, ["es_a", "jhs_change"], F.col("offers_es"))


@register("p04_totals_by_category", """
SELECT 'all' AS category, 'all' AS member, count(*) AS rows, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem
UNION ALL SELECT 'l_returnflag', l_returnflag, count(*), CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) FROM lineitem GROUP BY 2
UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), count(*), CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) FROM lineitem GROUP BY 2""")
def p04(spark, sf):
    return profiling.totals_by(read(spark, sf, "lineitem"), F.col("l_quantity").cast("bigint"), ["l_returnflag", "l_linenumber"])


@register("p05_schema_diff", "SELECT 's_suppkey,s_name,s_nationkey,s_acctbal' AS removed, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS added, false AS reordered, count(*) AS rows FROM customer")
def p05(spark, sf):
    after = read(spark, sf, "customer")
    diff = profiling.schema_diff(read(spark, sf, "supplier").columns, after.columns)
    return after.agg(F.lit(",".join(diff["removed"])).alias("removed"), F.lit(",".join(diff["added"])).alias("added"), F.lit(diff["reordered"]).alias("reordered"), F.count("*").alias("rows"))


@register("p06_label_inventory", """
SELECT year(o_orderdate) AS period, 'o_orderstatus' AS column_name, o_orderstatus AS label, count(*) AS rows FROM orders GROUP BY 1, 3
UNION ALL SELECT year(o_orderdate), 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 1, 3""")
def p06(spark, sf):
    return profiling.label_inventory(read(spark, sf, "orders"), F.year("o_orderdate"), ["o_orderstatus", "o_orderpriority"])


_LATEST = lambda y: f"(SELECT o_custkey, max_by(o_orderpriority, o_orderkey) AS label FROM orders WHERE year(o_orderdate) = {y} GROUP BY 1)"


def latest_label(spark, sf, year):
    return read(spark, sf, "orders").filter(F.year("o_orderdate") == year).groupBy("o_custkey").agg(F.max_by("o_orderpriority", "o_orderkey").alias("label"))


@register("p07_label_drift", f"SELECT a.label AS label_before, b.label AS label_after, count(*) AS keys FROM {_LATEST(1996)} a JOIN {_LATEST(1997)} b USING (o_custkey) GROUP BY 1, 2")
def p07(spark, sf):
    return profiling.label_drift(latest_label(spark, sf, 1996), latest_label(spark, sf, 1997), "o_custkey", "label")


@register("p08_roster_diff", """
SELECT o_custkey, CASE WHEN a AND c AND NOT b THEN 'returned' WHEN a AND c THEN 'kept' WHEN a THEN 'dropped' WHEN c THEN 'new' ELSE 'between' END AS roster
FROM (SELECT o_custkey, bool_or(year(o_orderdate) = 1996) AS a, bool_or(year(o_orderdate) = 1997) AS b, bool_or(year(o_orderdate) = 1998) AS c FROM orders GROUP BY 1)""")
def p08(spark, sf):
    return profiling.roster(read(spark, sf, "orders"), "o_custkey", F.year("o_orderdate"), [1996, 1997, 1998])


_SPELLED = lambda y: f"(SELECT o_custkey, CASE WHEN max(o_orderkey) % 3 = 0 THEN lower(max_by(p_name, o_orderkey)) ELSE upper(max_by(p_name, o_orderkey)) END AS place FROM orders JOIN part ON p_partkey = o_custkey % 20 + o_orderkey % 2 WHERE year(o_orderdate) = {y} GROUP BY 1)"


@register("p09_place_changes", f"""
SELECT CASE WHEN a.place = b.place THEN 'same' WHEN upper(a.place) = upper(b.place) THEN 'spelling only' ELSE 'another place' END AS change, count(*) AS keys FROM {_SPELLED(1996)} a JOIN {_SPELLED(1997)} b USING (o_custkey) GROUP BY 1""")
def p09(spark, sf):
    from placegrid.functions.keys import exact_key

    part = read(spark, sf, "part").select("p_partkey", "p_name")

    def spelled(year):
        rows = read(spark, sf, "orders").filter(F.year("o_orderdate") == year).withColumn("p_partkey", F.col("o_custkey") % 20 + F.col("o_orderkey") % 2).join(part, "p_partkey")
        said = rows.groupBy("o_custkey").agg(F.max("o_orderkey").alias("m"), F.max_by("p_name", "o_orderkey").alias("name"))
        return said.withColumn("place", F.when(F.col("m") % 3 == 0, F.lower("name")).otherwise(F.upper("name"))).withColumn("key", exact_key("place"))

    return profiling.place_changes(spelled(1996), spelled(1997), "o_custkey", "place", "key")


@register("p10_match_stability", f"""WITH {_RESOLVED_SQL}, later AS (SELECT record_id, CASE WHEN tier = 5 THEN NULL WHEN tier = 6 THEN 'U0' ELSE code END AS code FROM resolved WHERE hits IS NULL OR hits < 3)
SELECT CASE WHEN a.code = b.code THEN 'same' WHEN a.code IS NOT NULL AND b.code IS NOT NULL THEN 'different' WHEN a.code IS NOT NULL THEN 'only before' WHEN b.code IS NOT NULL THEN 'only after' ELSE 'neither' END AS stability, count(*) AS keys
FROM resolved a FULL JOIN later b USING (record_id) GROUP BY 1""")
def p10(spark, sf):
    now = resolved(spark, sf)
    later = now.filter(F.coalesce("hits", F.lit(0)) < 3).withColumn("code", F.when(F.col("tier") == 5, F.lit(None)).when(F.col("tier") == 6, "U0").otherwise(F.col("code")))
    return profiling.match_stability(now, later, "record_id")


@register("p11_blank_row_patterns", with_star(("wide_cells",), """
SELECT 'ES' AS group_name, count(*) FILTER (WHERE coalesce(es_a, es_b) IS NULL) AS all_blank, count(*) FILTER (WHERE coalesce(es_a, es_b) IS NULL AND offers_es) AS blank_while_offered FROM wide_cells
UNION ALL SELECT 'SHS', count(*) FILTER (WHERE shs_a IS NULL), count(*) FILTER (WHERE shs_a IS NULL AND offers_shs) FROM wide_cells"""))
def p11(spark, sf):
    return profiling.blank_patterns(star.wide_cells(spark, sf), {"ES": ["es_a", "es_b"], "SHS": ["shs_a"]}, {"ES": F.col("offers_es"), "SHS": F.col("offers_shs")})


@register("p12_coverage_matrix", """
SELECT v.other_source, CAST(coalesce(sum(n) FILTER (WHERE CASE v.other_source WHEN 'supplier' THEN NOT has_supplier ELSE NOT has_low END), 0) AS BIGINT) AS entities_without,
       count(*) FILTER (WHERE CASE v.other_source WHEN 'supplier' THEN NOT has_supplier ELSE NOT has_low END) AS places_without
FROM (SELECT c_nationkey, count(*) AS n, c_nationkey IN (SELECT s_nationkey FROM supplier) AS has_supplier, c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) AS has_low FROM customer GROUP BY 1)
CROSS JOIN (VALUES ('supplier'), ('low_supplier')) v(other_source) GROUP BY 1""")
def p12(spark, sf):
    supplier = read(spark, sf, "supplier").withColumnRenamed("s_nationkey", "c_nationkey")
    return profiling.coverage_matrix(read(spark, sf, "customer"), {"supplier": supplier, "low_supplier": supplier.filter(F.col("s_acctbal") < 0)}, "c_nationkey")


@register("p13_code_against_name", f"""WITH {_TWO_SQL}
SELECT CASE WHEN by_code = by_name THEN 'agree' WHEN by_code IS NOT NULL AND by_name IS NOT NULL THEN 'differ' WHEN by_code IS NOT NULL THEN 'code only' WHEN by_name IS NOT NULL THEN 'name only' ELSE 'neither' END AS evidence, count(*) AS rows FROM two GROUP BY 1""")
def p13(spark, sf):
    return profiling.code_against_name(two_evidence(spark, sf), "by_code", "by_name")


@register("p14_functional_dependency", "SELECT p_name, count(DISTINCT (p_brand, p_type)) AS combinations FROM part GROUP BY 1")
def p14(spark, sf):
    return profiling.dependency(read(spark, sf, "part"), "p_name", ["p_brand", "p_type"])


@register("p15_geometry_inventory", f"""
SELECT kind AS geometry_type, count(*) AS shapes, count(*) FILTER (WHERE c_mktsegment = 'BUILDING' AND c_custkey % 4 = 0) AS valid, count(*) FILTER (WHERE copies > 1) AS repeated_ids
FROM (SELECT *, {SHAPE_KIND_SQL} AS kind, count(*) OVER (PARTITION BY c_custkey // 3 + c_nationkey) AS copies FROM customer) GROUP BY 1""")
def p15(spark, sf):
    rows = customer_shapes(spark, sf).withColumn("shape_id", F.floor(F.col("c_custkey") / 3) + F.col("c_nationkey"))
    return profiling.geometry_inventory(rows, "geometry", "shape_id")


@register("p16_totals_recomputed", "SELECT CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS by_first, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS by_second FROM lineitem")
def p16(spark, sf):
    return profiling.recomputed_totals(read(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_suppkey"], F.col("l_quantity").cast("bigint"))


@register("p17_place_list_reconciliation", """
SELECT key, a AS value_a, b AS value_b, CASE WHEN b IS NULL THEN 'only in first' WHEN a IS NULL THEN 'only in second' WHEN a = b THEN 'same value' ELSE 'value differs' END AS state
FROM (SELECT c_nationkey || '/' || c_mktsegment AS key, count(*) AS a FROM customer WHERE c_acctbal > -900 GROUP BY 1)
FULL JOIN (SELECT c_nationkey || '/' || c_mktsegment AS key, count(*) AS b FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1) USING (key)""")
def p17(spark, sf):
    keyed = read(spark, sf, "customer").withColumn("key", F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment"))
    count = lambda df: df.groupBy("key").agg(F.count("*").alias("n"))
    return profiling.place_list_gaps(count(keyed.filter(F.col("c_acctbal") > -900)), count(keyed.filter(F.col("c_mktsegment") != "BUILDING")), "key", "n")
