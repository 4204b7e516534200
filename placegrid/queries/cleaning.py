"""Cleaning, quarantine and reshaping queries (C)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from placegrid.functions import geo, text
from placegrid.operators import cleaning, hierarchy, reshape, validity
from placegrid.operators.control import current_batches
from placegrid.operators.scale import position_in_order
from placegrid.queries import star
from placegrid.queries.analytics import UNITS_SQL, unit_list
from placegrid.queries.registry import register
from placegrid.queries.star import published, read, with_star

SQUEEZE = lambda x: f"trim(regexp_replace(translate({x}, chr(9) || chr(160), '  '), ' +', ' ', 'g'))"
CLEAN = lambda x: f"nullif({SQUEEZE(x)}, '')"


@register("c01_clean_text", f"SELECT doc_id, md5({CLEAN('text')}) AS text_hash, length({CLEAN('text')}) AS n FROM documents")
def c01(spark, sf):
    t = text.clean_text("text")
    return read(spark, sf, "documents").select("doc_id", F.md5(t).alias("text_hash"), F.length(t).cast("bigint").alias("n"))


# Sequences UTF-8 text shows when it was read as a single-byte encoding, and what they stand for.
MOJIBAKE = (("Ã©", "é"), ("Ã±", "ñ"), ("Ã¡", "á"), ("â€™", "'"), ("é", "e"), ("ç", "c"))


def _repair_sql(x):
    for wrong, right in MOJIBAKE:
        x = f"replace({x}, '{wrong}', '{right.replace(chr(39), chr(39) * 2)}')"
    return x


@register("c02_repair_text", f"SELECT doc_id, md5({_repair_sql('text')}) AS text_hash FROM documents")
def c02(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(text.repair_text("text", MOJIBAKE)).alias("text_hash"))


@register("c03_placeholder_to_null", "SELECT conv_id, turn, CASE WHEN role NOT IN ('system', '-') THEN role END AS role FROM conversations")
def c03(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", text.placeholder_to_null("role", ["system", "-"]).alias("role"))


PRIORITY_LABELS = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "5-LOW": "low"}


@register("c04_map_labels", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' END AS priority,
       o_orderpriority = '4-NOT SPECIFIED' AS unmapped FROM orders""")
def c04(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", text.map_label("o_orderpriority", PRIORITY_LABELS).alias("priority"),
                                            text.label_unmapped("o_orderpriority", PRIORITY_LABELS).alias("unmapped"))


@register("c05_map_boolean", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS is_closed FROM orders")
def c05(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", text.map_boolean("o_orderstatus", ["F"], ["O"]).alias("is_closed"))


def published_text(spark, sf):
    """Events as published text: counts, decimals, placeholders and blanks by event type."""
    k = F.regexp_extract("props", '"k": ([0-9]+)', 1)
    kind = F.col("event_type")
    raw = (F.when(kind == "click", k).when(kind == "view", F.concat(k, F.lit(".0"))).when(kind == "error", "#N/A")
           .when(kind == "purchase", "").otherwise(F.concat(F.lit("-"), k, F.lit(".5e1"))))
    day = F.concat(F.lit("2024-02-"), F.lpad(k, 2, "0"))
    return read(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"), raw.alias("raw"), day.alias("day"))


RAW_SQL = """
raw_events AS (SELECT *, CASE event_type WHEN 'click' THEN k WHEN 'view' THEN k || '.0' WHEN 'error' THEN '#N/A' WHEN 'purchase' THEN '' ELSE '-' || k || '.5e1' END AS raw,
                      '2024-02-' || left(lpad(k, 2, '0'), 2) AS day
               FROM (SELECT *, regexp_extract(props, '"k": ([0-9]+)', 1) AS k FROM events))"""


@register("c06_strict_int", f"WITH {RAW_SQL} SELECT event_id, CASE WHEN regexp_matches(raw, '^[0-9]{{1,9}}$') THEN TRY_CAST(raw AS INTEGER) END AS n FROM raw_events")
def c06(spark, sf):
    return published_text(spark, sf).select("event_id", text.strict_int("raw").alias("n"))


@register("c07_integral_decimal", f"""WITH {RAW_SQL}
SELECT event_id, CASE WHEN regexp_matches(t, '^[0-9]+([.][0-9]+)?$') AND TRY_CAST(t AS DOUBLE) = floor(TRY_CAST(t AS DOUBLE)) AND TRY_CAST(t AS DOUBLE) <= 2147483647
       THEN CAST(TRY_CAST(t AS DOUBLE) AS INTEGER) END AS n
FROM (SELECT event_id, CASE WHEN event_type = 'signup' THEN k || '.5' WHEN event_type = 'error' THEN k || '0000000000' ELSE raw END AS t FROM raw_events)""")
def c07(spark, sf):
    kind = F.col("event_type")
    t = F.when(kind == "signup", F.concat("k", F.lit(".5"))).when(kind == "error", F.concat("k", F.lit("0000000000"))).otherwise(F.col("raw"))
    return published_text(spark, sf).select("event_id", text.integral_decimal(t).alias("n"))


@register("c08_strict_double", f"WITH {RAW_SQL} SELECT event_id, CASE WHEN regexp_matches(raw, '^-?[0-9]+([.][0-9]+)?([eE][-+]?[0-9]{{1,3}})?$') THEN TRY_CAST(raw AS DOUBLE) END AS x FROM raw_events")
def c08(spark, sf):
    return published_text(spark, sf).select("event_id", text.strict_double("raw").alias("x"))


@register("c09_strict_decimal_and_date", f"""WITH {RAW_SQL}
SELECT event_id, CAST(CASE WHEN regexp_matches(raw, '^-?[0-9]{{1,6}}([.][0-9]{{1,4}})?$') THEN TRY_CAST(raw AS DECIMAL(10,4)) END AS DOUBLE) AS amount,
       CASE WHEN regexp_matches(day, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN TRY_CAST(day AS DATE) END AS on_day FROM raw_events""")
def c09(spark, sf):
    return published_text(spark, sf).select("event_id", text.strict_decimal("raw", 10, 4).cast("double").alias("amount"), text.strict_date("day").alias("on_day"))


@register("c10_null_with_reason", f"""WITH {RAW_SQL}
SELECT event_id, n, CASE WHEN n IS NULL THEN CASE raw WHEN '#N/A' THEN 'publisher_na' WHEN '' THEN 'blank' ELSE 'unrecognized' END END AS n_null_reason
FROM (SELECT *, CASE WHEN regexp_matches(raw, '^[0-9]{{1,9}}$') THEN TRY_CAST(raw AS INTEGER) END AS n FROM raw_events)""")
def c10(spark, sf):
    rows = published_text(spark, sf).withColumn("n", text.strict_int("raw"))
    return rows.select("event_id", "n", text.null_reason("n", "raw", {"#N/A": "publisher_na", "": "blank"}, "unrecognized").alias("n_null_reason"))


@register("c11_split_label", """
SELECT p_partkey, CASE label WHEN 'SMALL' THEN 'small' WHEN 'SMALL*' THEN 'small' WHEN 'LARGE' THEN 'large' WHEN 'LARGE*' THEN 'large' END AS class,
       CASE label WHEN 'SMALL' THEN false WHEN 'SMALL*' THEN true WHEN 'LARGE' THEN false WHEN 'LARGE*' THEN true END AS retained
FROM (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_type || '*' ELSE p_type END AS label FROM part)""")
def c11(spark, sf):
    rows = read(spark, sf, "part").withColumn("label", F.when(F.col("p_size") > 25, F.concat("p_type", F.lit("*"))).otherwise(F.col("p_type")))
    return rows.select("p_partkey", text.map_label("label", {"SMALL": "small", "SMALL*": "small", "LARGE": "large", "LARGE*": "large"}).alias("class"),
                       text.map_label("label", {"SMALL": False, "SMALL*": True, "LARGE": False, "LARGE*": True}).alias("retained"))


def order_rules():
    return {"price_missing": F.col("o_totalprice").isNull(), "price_above_plausible": F.col("o_totalprice") > 490000,
            "priority_unmapped": text.label_unmapped("o_orderpriority", PRIORITY_LABELS), "outside_year": F.year("o_orderdate") != 1997}


REASONS_SQL = """
classified AS (SELECT *, concat_ws(',', CASE WHEN o_totalprice IS NULL THEN 'price_missing' END, CASE WHEN o_totalprice > 490000 THEN 'price_above_plausible' END,
   CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'priority_unmapped' END, CASE WHEN year(o_orderdate) <> 1997 THEN 'outside_year' END) AS reasons FROM orders)"""


@register("c12_quarantine_reasons", f"WITH {REASONS_SQL} SELECT o_orderkey, reasons FROM classified")
def c12(spark, sf):
    rows = cleaning.with_reasons(read(spark, sf, "orders"), order_rules())
    return rows.select("o_orderkey", F.array_join("quarantine_reasons", ",").alias("reasons"))


@register("c13_clean_rows", f"WITH {REASONS_SQL} SELECT o_orderkey, o_custkey, o_totalprice FROM classified WHERE reasons = ''")
def c13(spark, sf):
    return cleaning.split_clean(cleaning.with_reasons(read(spark, sf, "orders"), order_rules()))[0].select("o_orderkey", "o_custkey", "o_totalprice")


@register("c13_quarantined_rows", f"WITH {REASONS_SQL} SELECT o_orderkey, len(string_split(reasons, ',')) AS n_reasons FROM classified WHERE reasons <> ''")
def c13_quarantine(spark, sf):
    rows = cleaning.split_clean(cleaning.with_reasons(read(spark, sf, "orders"), order_rules()))[1]
    return rows.select("o_orderkey", F.size("quarantine_reasons").cast("bigint").alias("n_reasons"))


@register("c14_duplicate_key_count", "SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS key_rows FROM lineitem")
def c14(spark, sf):
    return cleaning.with_copies(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])


@register("c15_copies_and_conflicts", """
SELECT doc_id, key_rows, key_versions, CASE WHEN key_rows > 1 AND key_versions > 1 THEN 'key_conflicting' WHEN key_rows > 1 AND doc_id <> first_id THEN 'key_identical_copy' ELSE '' END AS reasons
FROM documents d JOIN (SELECT lang, source, n_chars, count(*) AS key_rows, count(DISTINCT md5(text)) AS key_versions, min(doc_id) AS first_id FROM documents GROUP BY 1, 2, 3) g
  ON (g.lang, g.source, g.n_chars) IS NOT DISTINCT FROM (d.lang, d.source, d.n_chars)""")
def c15(spark, sf):
    """Documents by language, source and length: the same text again is a copy, another one a conflict."""
    rows = read(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    counted = cleaning.with_versions(rows, ["lang", "source", "n_chars"], ["text"], "doc_id").drop("text")
    return cleaning.with_reasons(counted, cleaning.duplicate_rules()).select(
        "doc_id", "key_rows", "key_versions", F.array_join("quarantine_reasons", ",").alias("reasons"))


@register("c16_out_of_scope", """
SELECT o_orderkey, concat_ws(',', CASE WHEN year(o_orderdate) NOT IN (1997, 1998) THEN 'wrong_period' END, CASE WHEN o_orderstatus = 'P' THEN 'wrong_sector' END) AS reasons FROM orders""")
def c16(spark, sf):
    rules = {"wrong_period": ~F.year("o_orderdate").isin(1997, 1998), "wrong_sector": F.col("o_orderstatus") == "P"}
    return cleaning.with_reasons(read(spark, sf, "orders"), rules).select("o_orderkey", F.array_join("quarantine_reasons", ",").alias("reasons"))


@register("c17_measure_outside_scope", with_star(("wide_cells",), """
SELECT entity_id, period, NOT offers_es AND (es_a IS NOT NULL OR es_b IS NOT NULL) AS es_outside, NOT offers_shs AND shs_a IS NOT NULL AS shs_outside FROM wide_cells"""))
def c17(spark, sf):
    return star.wide_cells(spark, sf).select("entity_id", "period", (~F.col("offers_es") & text.any_filled(["es_a", "es_b"])).alias("es_outside"),
                                             (~F.col("offers_shs") & text.any_filled(["shs_a"])).alias("shs_outside"))


@register("c18_plausible_maximum", with_star(("wide_cells",), "SELECT entity_id, period, coalesce(greatest(es_a, es_b, jhs_a, jhs_b, shs_a) > 250, false) AS too_high FROM wide_cells"))
def c18(spark, sf):
    return star.wide_cells(spark, sf).select("entity_id", "period", text.any_above(["es_a", "es_b", "jhs_a", "jhs_b", "shs_a"], 250).alias("too_high"))


PADDED_SQL = "padded AS (SELECT c_custkey, CASE WHEN length(CAST(c_custkey AS VARCHAR)) BETWEEN 3 AND 6 THEN lpad(CAST(c_custkey AS VARCHAR), 6, '0') END AS code FROM customer)"


@register("c19_pad_code", f"WITH {PADDED_SQL} SELECT c_custkey, code FROM padded")
def c19(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", text.pad_code(F.col("c_custkey").cast("string"), (3, 6)).alias("code"))


@register("c20_prefix_recode", f"""WITH {PADDED_SQL}
SELECT c_custkey, CASE WHEN code LIKE '0001%' THEN '0909' || substr(code, 5) ELSE code END AS code, coalesce(code LIKE '0001%', false) AS recoded FROM padded""")
def c20(spark, sf):
    padded = read(spark, sf, "customer").select("c_custkey", text.pad_code(F.col("c_custkey").cast("string"), (3, 6)).alias("code"))
    return padded.select("c_custkey", text.recode_prefix("code", "0001", "0909").alias("code"), text.has_prefix("code", "0001").alias("recoded"))


@register("c21_parent_by_position", f"""WITH {UNITS_SQL}
SELECT u.code, u.level, p.code AS province_code FROM units u
LEFT JOIN (SELECT DISTINCT code FROM units WHERE level = 'Prov' AND name NOT IN ('NATION_3', 'NATION_4')) p ON p.code = left(u.code, 4) || '00000000'""")
def c21(spark, sf):
    is_parent = (F.col("level") == "Prov") & ~F.col("name").isin("NATION_3", "NATION_4")
    return cleaning.with_known_parent(unit_list(spark, sf), "code", 4, 12, is_parent, "province_code").select("code", "level", "province_code")


@register("c22_inside_parent", f"""WITH {UNITS_SQL} SELECT code, coalesce(left(code, 2) = left('01' || '0000000000', 2), false) AS inside FROM units""")
def c22(spark, sf):
    return unit_list(spark, sf).select("code", text.inside_parent("code", F.lit("010000000000"), 2).alias("inside"))


@register("c23_coordinate_flag", """
SELECT c_custkey, CASE WHEN lon IS NULL OR lat IS NULL THEN 'missing' WHEN lon = 0 AND lat = 0 THEN 'zero' WHEN NOT (lon BETWEEN 116 AND 127 AND lat BETWEEN 4 AND 21.5) THEN 'outside_box' END AS coordinate_flag
FROM (SELECT c_custkey, CASE c_mktsegment WHEN 'FURNITURE' THEN NULL WHEN 'HOUSEHOLD' THEN 0 ELSE 110 + c_nationkey END AS lon, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 0 ELSE c_nationkey END AS lat FROM customer)""")
def c23(spark, sf):
    segment = F.col("c_mktsegment")
    lon = F.when(segment == "FURNITURE", None).when(segment == "HOUSEHOLD", 0).otherwise(110 + F.col("c_nationkey"))
    lat = F.when(segment == "HOUSEHOLD", 0).otherwise(F.col("c_nationkey"))
    return read(spark, sf, "customer").select("c_custkey", text.coordinate_flag(lon, lat, (116, 4, 127, 21.5)).alias("coordinate_flag"))


@register("c24_length_cap", "SELECT p_partkey, length(p_name) = 8 AS possibly_cut FROM part")
def c24(spark, sf):
    return read(spark, sf, "part").select("p_partkey", text.at_length_cap("p_name", 8).alias("possibly_cut"))


@register("c25_row_status", with_star(("wide_cells",), """
SELECT entity_id, period, CASE WHEN NOT (offers_es OR offers_jhs) THEN 'out_of_scope' WHEN coalesce(es_a, es_b, jhs_a, jhs_b) IS NULL THEN 'no_counts'
       WHEN coalesce(es_a, 0) + coalesce(es_b, 0) + coalesce(jhs_a, 0) + coalesce(jhs_b, 0) = 0 THEN 'all_zero' ELSE 'has_learners' END AS count_status FROM wide_cells"""))
def c25(spark, sf):
    return star.wide_cells(spark, sf).select("entity_id", "period", text.count_status(["es_a", "es_b", "jhs_a", "jhs_b"], F.col("offers_es") | F.col("offers_jhs")).alias("count_status"))


@register("c26_label_and_data_flags", with_star(("wide_cells", "entities"), """
SELECT w.entity_id, period, sector IN ('Private', 'SUC/LUC') AS other_sector, coalesce(es_a, es_b, jhs_a, jhs_b, shs_a) IS NOT NULL AS has_data,
       (offers_es AND (es_a IS NULL OR es_b IS NULL)) OR (offers_shs AND shs_a IS NULL) AS missing_while_offered FROM wide_cells w JOIN entities e ON e.entity_id = w.entity_id"""))
def c26(spark, sf):
    rows = star.wide_cells(spark, sf).join(star.entities(spark, sf).select("entity_id", "sector"), "entity_id")
    gap = lambda *c: ~F.coalesce(text.strict_sum(c).isNotNull(), F.lit(False))
    return rows.select("entity_id", "period", F.col("sector").isin("Private", "SUC/LUC").alias("other_sector"),
                       text.any_filled(["es_a", "es_b", "jhs_a", "jhs_b", "shs_a"]).alias("has_data"),
                       ((F.col("offers_es") & gap("es_a", "es_b")) | (F.col("offers_shs") & gap("shs_a"))).alias("missing_while_offered"))


@register("c27_total_discrepancy", with_star(("wide_cells",), """
SELECT entity_id, period, coalesce(coalesce(es_a, es_b) IS NOT NULL AND coalesce(es_a, 0) + coalesce(es_b, 0) <> es_a, false) AS differs FROM wide_cells"""))
def c27(spark, sf):
    return star.wide_cells(spark, sf).select("entity_id", "period", text.total_differs(["es_a", "es_b"], "es_a").alias("differs"))


@register("c28_statistical_consistency", """
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(abs(l_extendedprice / 1000 - l_quantity * l_discount * 100 / 100) > 0.05, false) AS error_disagrees,
       l_discount * 100 > 5 AS variation_high, l_quantity - l_tax * 100 <= 0 AS lower_not_positive FROM lineitem""")
def c28(spark, sf):
    quantity, discount = F.col("l_quantity"), F.col("l_discount")
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
        text.error_disagrees(quantity, discount * 100, F.col("l_extendedprice") / 1000).alias("error_disagrees"),
        (discount * 100 > 5).alias("variation_high"), (quantity - F.col("l_tax") * 100 <= 0).alias("lower_not_positive"))


@register("c29_estimate_status", with_star(("wide_cells",), """
SELECT entity_id, period, CASE CAST(es_a IS NULL AS INT) + CAST(es_b IS NULL AS INT) + CAST(jhs_a IS NULL AS INT) WHEN 0 THEN 'estimated' WHEN 3 THEN 'no_estimate' ELSE 'partial_estimate' END AS estimate_status
FROM wide_cells"""))
def c29(spark, sf):
    return star.wide_cells(spark, sf).select("entity_id", "period", text.estimate_status(["es_a", "es_b", "jhs_a"]).alias("estimate_status"))


@register("c30_banner_carry_forward", """
SELECT conv_id, turn, role, md5(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) AS banner FROM conversations""")
def c30(spark, sf):
    rows = reshape.carry_banner(read(spark, sf, "conversations"), ["conv_id"], "turn", F.col("role") == "user", "text", "banner")
    return rows.select("conv_id", "turn", "role", F.md5("banner").alias("banner"))


@register("c30_carry_over_whole_table", """
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN user_id END IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last_buyer FROM events""")
def c30_whole(spark, sf):
    rows = read(spark, sf, "events").select("event_id", "event_type", "user_id").withColumn("sheet", F.lit("events"))
    return reshape.carry_banner(rows, ["sheet"], "event_id", F.col("event_type") == "purchase", "user_id", "last_buyer").select("event_id", "last_buyer")


@register("c31_section_grouping", """
SELECT n.conv_id, n.turn, n.section, h.turn AS head_turn FROM (
  SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section FROM conversations) n
LEFT JOIN (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations WHERE role = 'user') h ON h.conv_id = n.conv_id AND h.section = n.section""")
def c31(spark, sf):
    rows = read(spark, sf, "conversations").select("conv_id", "turn", "role")
    return reshape.sections_with_head(rows, ["conv_id"], "turn", F.col("role") == "user", {"head_turn": "turn"}).select("conv_id", "turn", "section", "head_turn")


@register("c32_periods_to_rows", """
SELECT o_custkey, v.period, CASE v.period WHEN '1996' THEN n96 ELSE n98 END AS orders, CASE v.period WHEN '1996' THEN t96 ELSE t98 END AS largest
FROM (SELECT o_custkey, count(*) FILTER (WHERE year(o_orderdate) = 1996) AS n96, count(*) FILTER (WHERE year(o_orderdate) = 1997) AS n97, count(*) FILTER (WHERE year(o_orderdate) = 1998) AS n98,
             max(o_totalprice) FILTER (WHERE year(o_orderdate) = 1996) AS t96, max(o_totalprice) FILTER (WHERE year(o_orderdate) = 1998) AS t98 FROM orders GROUP BY 1)
CROSS JOIN (VALUES ('1996'), ('1998')) v(period)""")
def c32(spark, sf):
    year = F.year("o_orderdate")
    wide = read(spark, sf, "orders").groupBy("o_custkey").agg(
        *[F.count_if(year == y).alias(f"orders_{y}") for y in (1996, 1997, 1998)],
        *[F.max(F.when(year == y, F.col("o_totalprice"))).alias(f"largest_{y}") for y in (1996, 1997, 1998)])
    measures = {str(y): {"orders": f"orders_{y}", "largest": f"largest_{y}"} for y in (1996, 1997, 1998)}
    return reshape.periods_to_rows(wide, ["o_custkey"], "period", measures, covered=F.lit("1996,1998"))


@register("c33_cells_to_rows", with_star(("wide_cells",), "\nUNION ALL ".join(
    f"SELECT entity_id, period, '{l}' AS level_code, '{p}' AS part, {c} AS learners FROM wide_cells" for l, p, c in
    (("ES", "a", "es_a"), ("ES", "b", "es_b"), ("JHS", "a", "jhs_a"), ("JHS", "b", "jhs_b")))))
def c33(spark, sf):
    cells = {("ES", "a"): "es_a", ("ES", "b"): "es_b", ("JHS", "a"): "jhs_a", ("JHS", "b"): "jhs_b"}
    return reshape.cells_to_rows(star.wide_cells(spark, sf), ["entity_id", "period"], cells, ["level_code", "part"], "learners")


@register("c33_two_layouts", with_star(("wide_cells",), """
SELECT entity_id, period, 'a' AS part, es_a AS learners FROM wide_cells WHERE period < '1998' UNION ALL SELECT entity_id, period, 'b', es_b FROM wide_cells WHERE period < '1998'
UNION ALL SELECT entity_id, period, 'c', shs_a FROM wide_cells WHERE period >= '1998' AND offers_shs"""))
def c33_layouts(spark, sf):
    rows = star.wide_cells(spark, sf).withColumn("version", F.when(F.col("period") < "1998", "v1").otherwise("v2"))
    layouts = {"v1": (F.lit(True), {("a",): "es_a", ("b",): "es_b"}), "v2": (F.col("offers_shs"), {("c",): "shs_a"})}
    return reshape.layouts_to_rows(rows, ["entity_id", "period"], "version", layouts, ["part"], "learners")


@register("c34_label_parse", """
SELECT c_custkey, nullif(regexp_extract(label, ' ([a-z0-9]{1,2}/)$', 1), '') AS footnote, c_mktsegment = 'BUILDING' AS is_capital,
       CASE c_mktsegment WHEN 'MACHINERY' THEN 'Old Town' WHEN 'FURNITURE' THEN 'First, Second' END AS old_name, upper(c_name) AS place_name
FROM (SELECT *, CASE c_mktsegment WHEN 'BUILDING' THEN c_name || ' (Capital) 2/' WHEN 'MACHINERY' THEN c_name || ' (Old Town)' WHEN 'FURNITURE' THEN c_name || ' (First) ( Second ) a/' ELSE c_name END AS label FROM customer)""")
def c34(spark, sf):
    segment, name = F.col("c_mktsegment"), F.col("c_name")
    label = (F.when(segment == "BUILDING", F.concat(name, F.lit(" (Capital) 2/"))).when(segment == "MACHINERY", F.concat(name, F.lit(" (Old Town)")))
             .when(segment == "FURNITURE", F.concat(name, F.lit(" (First) ( Second ) a/"))).otherwise(name))
    return read(spark, sf, "customer").withColumn("label", label).select(
        "c_custkey", text.footnote("label").alias("footnote"), text.is_capital("label").alias("is_capital"), text.old_names("label").alias("old_name"), text.bare_name("label").alias("place_name"))


def census_list(spark, sf):
    """Country, regions, nations and customers in publication order, each with three totals of its customers' orders."""
    totals = read(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("m1"), F.sum(F.floor(F.col("o_totalprice") * 100)).alias("m2"), F.sum("o_orderkey").alias("m3"))
    nation, region = read(spark, sf, "nation"), read(spark, sf, "region")
    leaf = (read(spark, sf, "customer").join(totals, F.col("c_custkey") == F.col("o_custkey"))
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("r_regionkey").alias("a"), F.col("n_nationkey").alias("b"), F.col("c_custkey").alias("c"), "r_name", "n_name", F.col("c_name").alias("place_name"), "m1", "m2", "m3"))
    # one rollup gives every level of the list; a missing key sorts before its children
    listed = leaf.rollup("a", "b", "c").agg(
        F.max("r_name").alias("r_name"), F.max("n_name").alias("n_name"), F.max("place_name").alias("c_name"), *[F.sum(m).cast("bigint").alias(m) for m in ("m1", "m2", "m3")],
        F.grouping_id().alias("g"))
    name = F.when(F.col("g") == 7, "COUNTRY").when(F.col("g") == 3, F.col("r_name")).when(F.col("g") == 1, F.col("n_name")).otherwise(F.col("c_name"))
    listed = listed.withColumn("place_name", name).withColumn("sheet", F.lit("S1"))
    return position_in_order(listed, [F.col(c).asc_nulls_first() for c in ("a", "b", "c")], "place_pos").select("sheet", "place_pos", "place_name", "m1", "m2", "m3", "g")


CENSUS_SQL = """
leaf AS (SELECT r_regionkey AS a, n_nationkey AS b, c_custkey AS c, r_name, n_name, c_name, t.* FROM customer
  JOIN (SELECT o_custkey, count(*) AS m1, CAST(sum(CAST(floor(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS m2, CAST(sum(o_orderkey) AS BIGINT) AS m3 FROM orders GROUP BY 1) t ON t.o_custkey = c_custkey
  JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
listed AS (SELECT *, row_number() OVER (ORDER BY a NULLS FIRST, b NULLS FIRST, c NULLS FIRST) AS place_pos FROM (
  SELECT NULL AS a, NULL AS b, NULL AS c, 'COUNTRY' AS place_name, 0 AS depth, NULL AS r, NULL AS n FROM region WHERE r_regionkey = (SELECT min(r_regionkey) FROM region)
  UNION ALL SELECT DISTINCT a, NULL, NULL, r_name, 1, r_name, NULL FROM leaf UNION ALL SELECT DISTINCT a, b, NULL, n_name, 2, r_name, n_name FROM leaf
  UNION ALL SELECT a, b, c, c_name, 3, r_name, n_name FROM leaf))"""


@register("c35_hierarchy_from_sums", f"""WITH {CENSUS_SQL}
SELECT l.place_pos AS start_pos, (SELECT max(x.place_pos) FROM listed x WHERE l.depth = 0 OR (x.a = l.a AND (l.depth = 1 OR x.b = l.b))) AS end_pos, 'S1' AS sheet FROM listed l WHERE l.depth < 3""")
def c35(spark, sf):
    return hierarchy.spans_from_sums(census_list(spark, sf), ["sheet"], "place_pos", ["m1", "m2", "m3"]).select("sheet", "start_pos", "end_pos")


@register("c36_close_spans", f"""WITH {CENSUS_SQL}
SELECT l.place_pos AS start_pos, (SELECT max(x.place_pos) FROM listed x WHERE l.depth = 0 OR (x.a = l.a AND (l.depth = 1 OR x.b = l.b))) AS end_pos, 'S1' AS sheet FROM listed l WHERE l.depth < 3""")
def c36(spark, sf):
    spans = hierarchy.spans_from_sums(census_list(spark, sf), ["sheet"], "place_pos", ["m1", "m2", "m3"])
    return hierarchy.close_spans(spans, ["sheet"]).select("sheet", "start_pos", "end_pos")


@register("c37_tree_levels", f"""WITH {CENSUS_SQL}
SELECT l.place_pos, l.place_name, CAST(l.depth AS BIGINT) AS depth, l.depth < 3 AS is_aggregate,
       CASE l.depth WHEN 1 THEN 1 WHEN 2 THEN (SELECT p.place_pos FROM listed p WHERE p.depth = 1 AND p.a = l.a) WHEN 3 THEN (SELECT p.place_pos FROM listed p WHERE p.depth = 2 AND p.b = l.b) END AS parent_pos,
       CASE l.depth WHEN 1 THEN 'COUNTRY' WHEN 2 THEN l.r WHEN 3 THEN l.n END AS parent_name,
       CASE l.depth WHEN 0 THEN 'country' WHEN 1 THEN 'region' WHEN 2 THEN 'province' ELSE 'city_municipality' END AS level, l.r AS region_name, l.n AS province_name FROM listed l""")
def c37(spark, sf):
    places = census_list(spark, sf)
    spans = hierarchy.close_spans(hierarchy.spans_from_sums(places, ["sheet"], "place_pos", ["m1", "m2", "m3"]), ["sheet"])
    tree = hierarchy.tree_from_spans(places.select("sheet", "place_pos", "place_name"), spans, ["sheet"], "place_pos", "place_name")
    return tree.select("place_pos", "place_name", "depth", "is_aggregate", "parent_pos", "parent_name", "level", "region_name", "province_name")


def customer_shapes(spark, sf):
    """One geometry text per customer; the segment decides what is wrong with it, and among buildings the key.

    Of four buildings one is right, one a bow tie, one touches itself at a corner, and one has its hole outside.
    """
    k, segment = F.col("c_nationkey").cast("string"), F.col("c_mktsegment")
    say = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    kind = F.col("c_custkey") % 4
    polygon = lambda *corners: say('{"type":"Polygon","coordinates":[', *corners, "]}")
    geometry = (F.when((segment == "BUILDING") & (kind == 1), polygon('[[', k, ',0],[', k, '.5,1],[', k, '.5,0],[', k, ',2],[', k, ',0]]'))
                .when((segment == "BUILDING") & (kind == 2), polygon('[[', k, ',0],[', k, '.5,0],[', k, '.5,1],[', k, '.25,0],[', k, ',1],[', k, ',0]]'))
                .when((segment == "BUILDING") & (kind == 3), polygon('[[', k, ',0],[', k, '.5,0],[', k, '.5,1],[', k, ',0]],[[', k, ',5],[', k, '.5,5],[', k, '.5,6],[', k, ',5]]'))
                .when(segment == "BUILDING", say('{"type":"Polygon","coordinates":[[[', k, ',0],[', k, '.5,0],[', k, '.5,1],[', k, ',0]]]}'))
                .when(segment == "MACHINERY", say('{"type":"Polygon","coordinates":[[[', k, ',0],[', k, '.5,0],[', k, '.5,1],[', k, ',0.5]]]}'))
                .when(segment == "FURNITURE", say('{"type":"MultiPolygon","coordinates":[[[[', k, ',0],[', k, ',1],[', k, ',2],[', k, ',0]]]]}'))
                .when(segment == "HOUSEHOLD", say('{"type":"Point","coordinates":[', k, ',0]}')).otherwise(F.lit(None)))
    return read(spark, sf, "customer").select("c_custkey", "c_nationkey", geometry.alias("geometry"))


SHAPE_KIND_SQL = "CASE c_mktsegment WHEN 'BUILDING' THEN 'Polygon' WHEN 'MACHINERY' THEN 'Polygon' WHEN 'FURNITURE' THEN 'MultiPolygon' WHEN 'HOUSEHOLD' THEN 'Point' END"


@register("c38_geometry_validity", f"""
SELECT c_custkey, {SHAPE_KIND_SQL} AS geometry_type, c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') AS is_parsed, c_mktsegment = 'BUILDING' AND c_custkey % 4 = 0 AS is_valid FROM customer""")
def c38(spark, sf):
    rows = customer_shapes(spark, sf).withColumn("shape", geo.rings("geometry"))
    rows = validity.with_validity(rows, "geometry", "is_valid")
    return rows.select("c_custkey", geo.geometry_type("geometry").alias("geometry_type"), geo.rings_parsed("shape").alias("is_parsed"), "is_valid")


def batches(spark, sf):
    """Orders as deliveries: customer as source, month as period, order of the month as version."""
    return read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("batch_id"), F.col("o_custkey").alias("source_id"), F.date_format("o_orderdate", "yyyy-MM").alias("period"),
        F.lit("orders").alias("dataset"), F.col("o_orderkey").alias("delivery_version"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("succeeded").alias("status"),
        F.col("o_orderdate").alias("succeeded_at"))


CURRENT_SQL = """
current_rows AS (SELECT * FROM (SELECT o_orderkey AS batch_id, o_custkey AS source_id, strftime(o_orderdate, '%Y-%m') AS period, o_orderdate AS succeeded_at,
   row_number() OVER (PARTITION BY o_custkey, strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus <> 'F') WHERE rn = 1)"""


@register("c39_only_current_batches", f"WITH {CURRENT_SQL} SELECT l_orderkey, count(*) AS rows FROM lineitem WHERE l_orderkey IN (SELECT batch_id FROM current_rows) GROUP BY l_orderkey")
def c39(spark, sf):
    lines = read(spark, sf, "lineitem").select("l_orderkey", F.col("l_orderkey").alias("batch_id"))
    return cleaning.only_current(lines, current_batches(batches(spark, sf))).groupBy("l_orderkey").agg(F.count("*").alias("rows"))


@register("c40_run_stamp", "SELECT n_nationkey, n_name, 'run-1' AS run_id, TIMESTAMP '2024-01-01 00:00:00' AS cleaned_at_utc, 'abc123' AS code_revision FROM nation")
def c40(spark, sf):
    rows = read(spark, sf, "nation").select("n_nationkey", "n_name")
    return cleaning.stamp(rows, "run-1", datetime(2024, 1, 1), "abc123").withColumn("cleaned_at_utc", F.col("cleaned_at_utc").cast("timestamp_ntz"))
