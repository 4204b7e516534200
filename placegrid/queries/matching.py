"""Name and code matching queries (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from placegrid.functions import keys
from placegrid.operators import matching
from placegrid.queries.cleaning import SQUEEZE
from placegrid.queries.registry import register
from placegrid.queries.star import read
from placegrid.rules import ACCENTED, PLAIN

_E0 = lambda x: f"regexp_replace({SQUEEZE(f'upper({x})')}, ' ?[(](CAPITAL|NOT A PROVINCE)[)]$', '')"
EXACT = lambda x: f"CASE WHEN {_E0(x)} LIKE 'CITY OF %' THEN substr({_E0(x)}, 9) || ' CITY' ELSE {_E0(x)} END"
FOLDED = lambda x: SQUEEZE(f"translate(translate({x}, '{ACCENTED}', '{PLAIN}'), '.-''', '   ')")
BRACKETLESS = lambda x: SQUEEZE(f"regexp_replace({x}, '[(][^)]*[)]?', ' ', 'g')")
WORDLESS = lambda x: f"array_to_string(list_filter(string_split({x}, ' '), lambda w: w NOT IN ('CITY', 'OF', '')), ' ')"


def _keys_sql(source, col, prefix="k_"):
    """CTE chain text adding the key columns to ``source``."""
    p = prefix
    return f"""(SELECT *, {WORDLESS(p + 'bracketless')} AS {p}wordless FROM (SELECT *, {BRACKETLESS(p + 'folded')} AS {p}bracketless FROM
  (SELECT *, {FOLDED(p + 'exact')} AS {p}folded FROM (SELECT *, {EXACT(col)} AS {p}exact FROM {source}))))"""


def units(spark, sf):
    """Parts as places: brand is the parent, the name carries brackets, accents and the word City; big ones have an old name."""
    size, name = F.col("p_size") % 6, F.col("p_name")
    shown = (F.when(size == 0, F.concat(F.lit("City of "), name)).when(size == 1, F.concat(name, F.lit(" (Capital)"))).when(size == 2, F.concat(name, F.lit(" (Pob.)")))
             .when(size == 3, F.concat(F.lit("Santo Niño "), name)).otherwise(name))
    return read(spark, sf, "part").select(
        F.concat(F.lit("U"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("code"), F.col("p_brand").alias("parent"), shown.alias("name"),
        F.when(F.col("p_size") > 44, F.concat(F.lit("Old "), name)).alias("old_name"), F.col("p_size").alias("size"), F.col("p_partkey").alias("partkey"))


def records(spark, sf):
    """Customers as records naming a part of some brand, spelled in their own way."""
    part = read(spark, sf, "part").select("p_partkey", "p_brand", "p_name")
    kind, name = F.col("c_nationkey") % 6, F.col("p_name")
    spelled = (F.when(kind == 0, F.concat(F.upper(name), F.lit(" CITY"))).when(kind == 1, F.concat(F.lit("  "), name)).when(kind == 2, F.concat(F.lit("Old "), name))
               .when(kind == 3, F.concat(F.lit("STO. NINO "), name)).when(kind == 4, F.concat(F.lit("Santo-Nino "), name)).otherwise(F.concat(name, F.lit(" (Poblacion"))))
    return read(spark, sf, "customer").join(part, F.col("c_custkey") == F.col("p_partkey")).select(
        F.col("c_custkey").alias("record_id"), F.col("p_brand").alias("parent"), spelled.alias("name"))


UNITS_SQL = f"""
unit_rows AS (SELECT 'U' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS code, p_brand AS parent, p_size AS size, p_partkey AS partkey,
  CASE p_size % 6 WHEN 0 THEN 'City of ' || p_name WHEN 1 THEN p_name || ' (Capital)' WHEN 2 THEN p_name || ' (Pob.)' WHEN 3 THEN 'Santo Niño ' || p_name ELSE p_name END AS name,
  CASE WHEN p_size > 44 THEN 'Old ' || p_name END AS old_name FROM part),
record_rows AS (SELECT c_custkey AS record_id, p_brand AS parent, CASE c_nationkey % 6 WHEN 0 THEN upper(p_name) || ' CITY' WHEN 1 THEN '  ' || p_name WHEN 2 THEN 'Old ' || p_name
  WHEN 3 THEN 'STO. NINO ' || p_name WHEN 4 THEN 'Santo-Nino ' || p_name ELSE p_name || ' (Poblacion' END AS name FROM customer JOIN part ON c_custkey = p_partkey),
u AS (SELECT * FROM {_keys_sql(_keys_sql('unit_rows', 'name'), 'old_name', 'ok_')}),
r AS (SELECT * FROM {_keys_sql('record_rows', 'name')})"""
_TIER = """least(CASE WHEN r.k_exact = u.k_exact THEN 1 WHEN r.k_folded = u.k_folded THEN 3 WHEN r.k_bracketless = u.k_bracketless THEN 5 WHEN r.k_wordless = u.k_wordless THEN 6 END,
   CASE WHEN r.k_exact = u.ok_exact THEN 2 WHEN r.k_folded = u.ok_folded THEN 4 END)"""
_METHOD = "CASE WHEN hits = 1 THEN CASE tier WHEN 1 THEN 'name_exact' WHEN 2 THEN 'name_old' WHEN 4 THEN 'name_old' ELSE 'name_normalized' END END AS match_method"
_STATUS = "CASE WHEN hits = 1 THEN 'matched' WHEN hits > 1 THEN 'ambiguous' ELSE 'unmatched' END AS match_status"


def keyed_units(spark, sf):
    # the record side meets wordless keys only with current names, so the old name needs just two keys
    named = keys.name_keys(units(spark, sf), "name")
    return named.withColumn("ok_exact", keys.exact_key("old_name")).withColumn("ok_folded", keys.folded_key("ok_exact"))


def keyed_records(spark, sf):
    return keys.name_keys(records(spark, sf), "name")


@register("i01_name_key_ladder", f"WITH {UNITS_SQL} SELECT record_id, k_exact, k_folded, k_bracketless, k_wordless FROM r")
def i01(spark, sf):
    return keyed_records(spark, sf).select("record_id", "k_exact", "k_folded", "k_bracketless", "k_wordless")


@register("i02_extra_keys", f"""WITH {UNITS_SQL}
SELECT record_id, array_to_string(list_transform(string_split(k_folded, ' '), lambda w: CASE w WHEN 'STO' THEN 'SANTO' WHEN 'OLD' THEN 'FORMER' ELSE w END), ' ') AS expanded,
       regexp_replace(k_folded, '[^A-Z]', '', 'g') AS letters FROM r""")
def i02(spark, sf):
    rows = keyed_records(spark, sf)
    return rows.select("record_id", keys.expanded_key("k_folded", {"STO": "SANTO", "OLD": "FORMER"}).alias("expanded"), keys.letters_key("k_folded").alias("letters"))


def resolved(spark, sf):
    reference = matching.reference_keys(keyed_units(spark, sf), "code", ["parent"])
    return matching.resolve(keyed_records(spark, sf), ["record_id"], reference, ["parent"])


_RESOLVED_SQL = f"""{UNITS_SQL},
pairs AS (SELECT r.record_id, u.code, {_TIER} AS tier FROM r JOIN u ON r.parent = u.parent),
best AS (SELECT p.record_id, p.tier, count(DISTINCT code) AS hits, min(code) AS code FROM pairs p JOIN (SELECT record_id, min(tier) AS tier FROM pairs GROUP BY 1) b USING (record_id, tier) GROUP BY 1, 2),
resolved AS (SELECT r.record_id, CASE WHEN tier IS NULL THEN NULL ELSE 0 END AS rank, tier, hits, CASE WHEN hits = 1 THEN code END AS code, {_STATUS}, {_METHOD} FROM r LEFT JOIN best USING (record_id))"""


@register("i03_tiered_resolver", f"WITH {_RESOLVED_SQL} SELECT * FROM resolved")
def i03(spark, sf):
    return resolved(spark, sf)


@register("i04_scope_rank", f"""WITH {UNITS_SQL},
pairs AS (SELECT r.record_id, u.code, CASE WHEN r.parent = u.parent THEN 1 ELSE 2 END AS scope_rank, {_TIER} AS tier FROM r JOIN u ON r.parent = u.parent OR u.size > 40),
s AS (SELECT record_id, min(scope_rank) AS scope_rank FROM pairs WHERE tier IS NOT NULL GROUP BY 1),
t AS (SELECT p.record_id, p.scope_rank, min(tier) AS tier FROM pairs p JOIN s USING (record_id, scope_rank) GROUP BY 1, 2),
h AS (SELECT p.record_id, p.scope_rank, p.tier, count(DISTINCT code) AS hits, min(code) AS code FROM pairs p JOIN t USING (record_id, scope_rank, tier) GROUP BY 1, 2, 3)
SELECT r.record_id, h.scope_rank AS rank, h.tier, h.hits, CASE WHEN hits = 1 THEN h.code END AS code, {_STATUS}, {_METHOD} FROM r LEFT JOIN h USING (record_id)""")
def i04(spark, sf):
    ranked = keyed_units(spark, sf)
    everywhere = ranked.filter(F.col("size") > 40).withColumn("scope", F.lit("independent"))
    reference = matching.reference_keys(ranked.withColumn("scope", F.col("parent")).unionByName(everywhere), "code", ["scope"])
    scoped = matching.with_scopes(keyed_records(spark, sf), [(1, F.col("parent")), (2, F.lit("independent"))])
    return matching.resolve(scoped, ["record_id"], reference, ["scope"], rank="scope_rank")


@register("i05_parent_scoping", f"""WITH {UNITS_SQL},
parents AS (SELECT DISTINCT p_brand AS parent, upper(replace(p_brand, '#', ' ')) AS parent_name FROM part),
named AS (SELECT r.*, p.parent AS found_parent FROM (SELECT *, CASE WHEN record_id % 10 = 0 THEN 'BRAND X' ELSE upper(replace(parent, '#', '-')) END AS said FROM r) r
          LEFT JOIN parents p ON p.parent_name = replace(r.said, '-', ' ')),
pairs AS (SELECT r.record_id, u.code, {_TIER} AS tier FROM named r JOIN u ON r.found_parent = u.parent),
best AS (SELECT p.record_id, p.tier, count(DISTINCT code) AS hits, min(code) AS code FROM pairs p JOIN (SELECT record_id, min(tier) AS tier FROM pairs GROUP BY 1) b USING (record_id, tier) GROUP BY 1, 2)
SELECT n.record_id, n.found_parent, CASE WHEN hits = 1 THEN b.code END AS code, {_STATUS} FROM named n LEFT JOIN best b USING (record_id)""")
def i05(spark, sf):
    # parents first, by their own name keys; then names inside the parent found
    said = keyed_records(spark, sf).withColumn("said", F.when(F.col("record_id") % 10 == 0, "BRAND X").otherwise(F.upper(F.replace("parent", F.lit("#"), F.lit("-")))))
    parents = keys.name_keys(read(spark, sf, "part").select(F.col("p_brand").alias("parent")).distinct().withColumn("shown", F.replace("parent", F.lit("#"), F.lit(" "))), "shown")
    parent_keys = matching.reference_keys(parents, "parent", [])
    wanted = keys.name_keys(said.select("said").distinct(), "said")
    found = matching.resolve(wanted, ["said"], parent_keys).select("said", F.col("code").alias("found_parent"))
    inside = said.join(found, "said").drop("parent").withColumn("parent", F.col("found_parent"))
    result = matching.resolve(inside, ["record_id"], matching.reference_keys(keyed_units(spark, sf), "code", ["parent"]), ["parent"])
    return inside.select("record_id", "found_parent").join(result.select("record_id", "code", "match_status"), "record_id")


def _code_records(spark, sf):
    return keyed_records(spark, sf).withColumns({
        "direct": F.concat(F.lit("U"), F.lpad(F.col("record_id").cast("string"), 8, "0")), "older": F.concat(F.col("parent"), F.lit("/"), (F.col("record_id") % 50 + 1).cast("string"))})


def _code_units(spark, sf):
    return keyed_units(spark, sf).withColumn("correspondence", F.concat(F.col("parent"), F.lit("/"), F.col("size").cast("string")))


_CODES_SQL = f"""{UNITS_SQL},
asked AS (SELECT *, 'U' || lpad(CAST(record_id AS VARCHAR), 8, '0') AS direct, parent || '/' || (record_id % 50 + 1) AS older FROM r),
met AS (SELECT r.record_id, 1 AS rule, u.code, r.k_wordless = u.k_wordless AS agrees FROM asked r JOIN u ON u.code = r.direct
        UNION ALL SELECT r.record_id, 2, u.code, r.k_wordless = u.k_wordless FROM asked r JOIN u ON u.parent || '/' || u.size = r.older)"""


@register("i06_code_rule_ladder", f"""WITH {_CODES_SQL},
per_rule AS (SELECT record_id, rule, count(DISTINCT code) FILTER (WHERE agrees) AS hits, min(code) FILTER (WHERE agrees) AS code, min(code) AS any_code FROM met GROUP BY 1, 2)
SELECT record_id, min(rule) FILTER (WHERE hits > 0) AS rule, min_by(hits, rule) FILTER (WHERE hits > 0) AS hits, min_by(code, rule) FILTER (WHERE hits > 0) AS code, min_by(any_code, rule) AS any_code
FROM per_rule GROUP BY 1""")
def i06(spark, sf):
    rules = [("code", F.col("direct"), "code"), ("correspondence_code", F.col("older"), "correspondence")]
    return matching.first_code_rule(_code_records(spark, sf), ["record_id"], _code_units(spark, sf), "code", rules, same_names=["k_wordless"])


@register("i07_code_crosswalk", f"""WITH {_CODES_SQL}
SELECT a.record_id, count(DISTINCT m.code) AS hits, CASE WHEN count(DISTINCT m.code) = 1 THEN min(m.code) END AS code,
       CASE count(DISTINCT m.code) WHEN 1 THEN 'matched' WHEN 0 THEN 'unmatched' ELSE 'ambiguous' END AS match_status
FROM asked a LEFT JOIN (SELECT record_id, code FROM met WHERE rule = 2) m USING (record_id) GROUP BY 1""")
def i07(spark, sf):
    rows = _code_records(spark, sf)
    hits = matching.first_code_rule(rows, ["record_id"], _code_units(spark, sf), "code", [("correspondence_code", F.col("older"), "correspondence")])
    out = rows.select("record_id").join(hits, "record_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)).cast("bigint"))
    return out.select("record_id", "hits", F.when(F.col("hits") == 1, F.col("code")).alias("code"),
                      F.when(F.col("hits") == 1, "matched").when(F.col("hits") == 0, "unmatched").otherwise("ambiguous").alias("match_status"))


@register("i08_cut_off_names", f"""WITH {UNITS_SQL},
cut AS (SELECT record_id, parent, left(k_exact, 1 + CAST(record_id % 40 AS INTEGER)) AS cut_name FROM r)
SELECT record_id, count(DISTINCT u.code) AS hits, CASE WHEN count(DISTINCT u.code) = 1 THEN min(u.code) END AS code
FROM cut JOIN u ON u.parent = cut.parent AND starts_with(u.k_folded, cut_name) GROUP BY 1""")
def i08(spark, sf):
    cut = keyed_records(spark, sf).select("record_id", "parent", F.substring(F.col("k_exact"), F.lit(1), 1 + (F.col("record_id") % 40).cast("int")).alias("cut_name"))
    return matching.prefix_match(cut, ["record_id"], "cut_name", keyed_units(spark, sf), "k_folded", "code", "parent")


@register("i09_reviewed_decisions", f"""WITH {_RESOLVED_SQL},
reviewed AS (SELECT record_id, CASE WHEN tier > 3 THEN 'U' || lpad(CAST(record_id AS VARCHAR), 8, '0') END AS reviewed_code, 'reviewed' AS reason FROM resolved WHERE hits = 2)
SELECT r.record_id, r.rank, r.tier, r.hits, CASE WHEN v.reason IS NULL THEN r.code ELSE v.reviewed_code END AS code,
       CASE WHEN v.reason IS NULL THEN r.match_status WHEN v.reviewed_code IS NULL THEN 'unmatched' ELSE 'matched' END AS match_status,
       CASE WHEN v.reason IS NULL THEN r.match_method ELSE 'reviewed_alias' END AS match_method,
       CASE WHEN v.reason IS NOT NULL THEN 'reviewed' WHEN r.match_status = 'matched' THEN 'rule' ELSE 'pending' END AS review_status, v.reason AS reviewed_reason
FROM resolved r LEFT JOIN reviewed v USING (record_id)""")
def i09(spark, sf):
    rows = resolved(spark, sf)
    reviewed = rows.filter(F.col("hits") == 2).select(
        "record_id", F.when(F.col("tier") > 3, F.concat(F.lit("U"), F.lpad(F.col("record_id").cast("string"), 8, "0"))).alias("reviewed_code"), F.lit("reviewed").alias("reason"))
    return matching.apply_reviewed(rows, reviewed, ["record_id"])


_TWO_SQL = f"""{_RESOLVED_SQL},
two AS (SELECT record_id, CASE WHEN record_id % 5 <> 0 THEN 'U' || lpad(CAST(record_id AS VARCHAR), 8, '0') END AS by_code, code AS by_name FROM resolved)"""


def two_evidence(spark, sf):
    code = F.when(F.col("record_id") % 5 != 0, F.concat(F.lit("U"), F.lpad(F.col("record_id").cast("string"), 8, "0")))
    return resolved(spark, sf).select("record_id", code.alias("by_code"), F.col("code").alias("by_name"))


@register("i10_two_evidence_arbitration", f"""WITH {_TWO_SQL}
SELECT record_id, by_code, by_name, CASE WHEN record_id % 11 = 0 THEN NULL WHEN by_code = by_name THEN by_code WHEN by_code IS NOT NULL AND by_name IS NOT NULL THEN CASE WHEN record_id % 2 = 0 THEN by_code END
         ELSE coalesce(by_code, by_name) END AS decided_code,
       CASE WHEN record_id % 11 = 0 THEN 'excluded' WHEN by_code <> by_name AND record_id % 2 <> 0 THEN 'ambiguous' WHEN coalesce(by_code, by_name) IS NULL THEN 'unmatched' ELSE 'matched' END AS match_status,
       CASE WHEN record_id % 11 = 0 THEN NULL WHEN by_code = by_name THEN 'code' WHEN by_code <> by_name THEN CASE WHEN record_id % 2 = 0 THEN 'code_name_differs' END
            WHEN by_code IS NOT NULL THEN 'code' WHEN by_name IS NOT NULL THEN 'name' END AS match_method,
       CASE WHEN record_id % 11 = 0 THEN 'excluded by rule' WHEN by_code = by_name THEN 'code and name agree' WHEN by_code <> by_name THEN CASE WHEN record_id % 2 = 0 THEN 'code, supported by the lower level' ELSE 'code and name differ' END
            WHEN by_code IS NOT NULL THEN 'code only' WHEN by_name IS NOT NULL THEN 'name only' ELSE 'no code or name match' END AS reason FROM two""")
def i10(spark, sf):
    return matching.arbitrate(two_evidence(spark, sf), "by_code", "by_name", F.col("record_id") % 2 == 0, F.col("record_id") % 11 == 0)


@register("i11_rollup_two_levels", """
SELECT c_custkey, 'city_mun' AS geographic_level, left(lpad(CAST(c_custkey AS VARCHAR), 8, '0'), 5) || '000' AS code FROM customer
UNION ALL SELECT c_custkey, 'sub_unit', lpad(CAST(c_custkey AS VARCHAR), 8, '0') FROM customer""")
def i11(spark, sf):
    from placegrid.functions.text import ancestor_code

    rows = read(spark, sf, "customer").select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("unit"))
    return matching.to_two_levels(rows.withColumn("city", ancestor_code("unit", 5, 8)), ["c_custkey"], "city", "unit")


@register("i13_unmatched_by_design", "SELECT s_suppkey, s_name, CAST(NULL AS VARCHAR) AS mother_code, 'unmatched' AS match_status, 'no mother column is published' AS reason FROM supplier WHERE s_acctbal < 1000")
def i13(spark, sf):
    rows = read(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return matching.unmatched_by_design(rows, F.col("s_acctbal") < 1000, "mother_code", "no mother column is published").drop("s_acctbal")


@register("i14_match_distinct_names", """
SELECT l_orderkey, l_linenumber, l_partkey, u.first_part FROM lineitem JOIN part ON p_partkey = l_partkey
JOIN (SELECT p_brand, p_name, min(p_partkey) AS first_part FROM part GROUP BY 1, 2) u USING (p_brand, p_name)""")
def i14(spark, sf):
    part = read(spark, sf, "part").select("p_partkey", "p_brand", "p_name")
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(part, F.col("p_partkey") == F.col("l_partkey"))
    first = part.groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("first_part"))
    out = matching.match_distinct(lines, ["p_brand", "p_name"], lambda names: names.join(first, ["p_brand", "p_name"]))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "first_part")


@register("i15_majority_vote", """
SELECT o_custkey, CASE WHEN top >= 2 AND 2 * top > total THEN choice END AS o_orderstatus, top AS votes, total
FROM (SELECT o_custkey, max(n) AS top, CAST(sum(n) AS BIGINT) AS total, max_by(o_orderstatus, n) AS choice FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1)""")
def i15(spark, sf):
    return matching.majority_vote(read(spark, sf, "orders"), "o_custkey", "o_orderstatus")


@register("i16_match_by_elimination", """
WITH claimed AS (SELECT DISTINCT s_suppkey FROM supplier WHERE s_acctbal > 500),
free AS (SELECT s_nationkey AS nation, count(DISTINCT s_suppkey) AS free, min(s_suppkey) AS s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM claimed) GROUP BY 1),
waiting AS (SELECT c_nationkey AS nation, count(*) AS waiting FROM customer WHERE c_acctbal > 9700 GROUP BY 1)
SELECT c_custkey, c_nationkey AS nation, CASE WHEN free = 1 AND waiting = 1 THEN f.s_suppkey END AS s_suppkey
FROM customer JOIN waiting w ON w.nation = c_nationkey LEFT JOIN free f ON f.nation = c_nationkey WHERE c_acctbal > 9700""")
def i16(spark, sf):
    supplier = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_acctbal")
    waiting = read(spark, sf, "customer").filter(F.col("c_acctbal") > 9700).select("c_custkey", F.col("c_nationkey").alias("nation"))
    return matching.by_elimination(waiting, supplier.select("nation", "s_suppkey"), supplier.filter(F.col("s_acctbal") > 500), ["nation"], "s_suppkey")


@register("i17_match_rates", f"""WITH {_RESOLVED_SQL}
SELECT parent, match_status, count(*) AS rows, 100.0::DOUBLE * CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY parent) AS percent FROM resolved JOIN record_rows USING (record_id) GROUP BY 1, 2""")
def i17(spark, sf):
    rows = resolved(spark, sf).join(records(spark, sf).select("record_id", "parent"), "record_id")
    return matching.match_rates(rows, ["parent"])
