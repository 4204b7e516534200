"""The relational building blocks by name: joins, aggregates, windows, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from placegrid.operators.scale import position_in_order
from placegrid.queries.registry import register
from placegrid.queries.star import read

# ------------------------------------------------------------------------------------------------- joins


@register("j01_inner_composite", "SELECT a.l_orderkey, a.l_linenumber, count(*) AS pairs FROM lineitem a JOIN (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_returnflag = 'A') b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY 1, 2")
def j01(spark, sf):
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    flagged = lines.filter(F.col("l_returnflag") == "A").select("l_orderkey", "l_linenumber", "l_suppkey").distinct()
    return lines.select("l_orderkey", "l_linenumber").join(flagged, ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("pairs"))


@register("j02_left_outer", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1")
def j02(spark, sf):
    orders = read(spark, sf, "orders").filter(F.col("o_orderstatus") == "F").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return read(spark, sf, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("bigint").alias("orders"))


@register("j03_full_outer", """
SELECT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, a.n AS early, b.n AS late FROM (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 49 GROUP BY 1) a
FULL JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_linenumber = 7 AND l_quantity < 2 GROUP BY 1) b ON a.l_suppkey = b.l_suppkey""")
def j03(spark, sf):
    lines = read(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", "l_quantity")
    early = lines.filter((F.col("l_linenumber") == 1) & (F.col("l_quantity") > 49)).groupBy("l_suppkey").agg(F.count("*").alias("early"))
    late = lines.filter((F.col("l_linenumber") == 7) & (F.col("l_quantity") < 2)).groupBy("l_suppkey").agg(F.count("*").alias("late"))
    return early.join(late, "l_suppkey", "full_outer")


@register("j04_semi", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def j04(spark, sf):
    rich = read(spark, sf, "orders").filter(F.col("o_totalprice") > 450000).select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf, "customer").select("c_custkey", "c_name").join(rich, "c_custkey", "left_semi")


@register("j05_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def j05(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey").join(read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@register("j06_null_safe", """
WITH a AS (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS segment, count(*) AS customers FROM customer GROUP BY 1)
SELECT c_custkey, a.customers FROM customer JOIN a ON a.segment IS NOT DISTINCT FROM CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END""")
def j06(spark, sf):
    rows = read(spark, sf, "customer").select("c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"))
    counts = rows.groupBy("segment").agg(F.count("*").alias("customers"))
    return rows.alias("l").join(counts.alias("r"), F.col("l.segment").eqNullSafe(F.col("r.segment"))).select("l.c_custkey", "r.customers")


@register("j07_any_of_several_keys", """
SELECT c_custkey, count(DISTINCT s_suppkey) AS suppliers FROM customer JOIN supplier ON s_suppkey = c_custkey OR s_suppkey = c_custkey // 10 OR s_suppkey = c_custkey - 50 GROUP BY 1""")
def j07(spark, sf):
    """An OR of keys as one equi-join on exploded keys."""
    key = F.col("c_custkey")
    asked = read(spark, sf, "customer").select("c_custkey", F.explode(F.array_distinct(F.array(key, F.floor(key / 10), key - 50))).alias("s_suppkey"))
    return asked.join(read(spark, sf, "supplier").select("s_suppkey"), "s_suppkey").groupBy("c_custkey").agg(F.count_distinct("s_suppkey").alias("suppliers"))


@register("j08_self_join_bounds", """
SELECT a.o_custkey, a.o_orderkey AS first_order, b.o_orderkey AS last_order, b.o_totalprice - a.o_totalprice AS change FROM orders a JOIN orders b USING (o_custkey)
WHERE a.o_orderkey = (SELECT min(o_orderkey) FROM orders x WHERE x.o_custkey = a.o_custkey) AND b.o_orderkey = (SELECT max(o_orderkey) FROM orders x WHERE x.o_custkey = a.o_custkey)""")
def j08(spark, sf):
    ends = read(spark, sf, "orders").groupBy("o_custkey").agg(F.min_by(F.struct("o_orderkey", "o_totalprice"), "o_orderkey").alias("a"), F.max_by(F.struct("o_orderkey", "o_totalprice"), "o_orderkey").alias("b"))
    return ends.select("o_custkey", F.col("a.o_orderkey").alias("first_order"), F.col("b.o_orderkey").alias("last_order"), (F.col("b.o_totalprice") - F.col("a.o_totalprice")).alias("change"))


@register("j09_scalar_subquery", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 0.99 * (SELECT max(o_totalprice) FROM orders)")
def j09(spark, sf):
    orders = read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return orders.filter(F.col("o_totalprice") > 0.99 * orders.agg(F.max("o_totalprice")).scalar())


@register("j10_dense_grid", "SELECT p.p_brand, y.period, count(l_orderkey) AS lines FROM (SELECT DISTINCT p_brand FROM part) p CROSS JOIN (SELECT DISTINCT year(l_shipdate) AS period FROM lineitem) y LEFT JOIN (SELECT l_orderkey, p_brand, year(l_shipdate) AS period FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity = 50 AND l_linenumber = 3) l ON l.p_brand = p.p_brand AND l.period = y.period GROUP BY 1, 2")
def j10(spark, sf):
    """Every member with every period: the periods are one scalar array, exploded."""
    part, lines = read(spark, sf, "part").select("p_partkey", "p_brand"), read(spark, sf, "lineitem")
    periods = lines.agg(F.collect_set(F.year("l_shipdate"))).scalar()
    some = (lines.filter((F.col("l_quantity") == 50) & (F.col("l_linenumber") == 3)).select("l_partkey", F.year("l_shipdate").alias("period"))
            .join(part, F.col("p_partkey") == F.col("l_partkey")).groupBy("p_brand", "period").agg(F.count("*").alias("lines")))
    grid = part.select("p_brand").distinct().withColumn("period", F.explode(periods))
    return grid.join(some, ["p_brand", "period"], "left").withColumn("lines", F.coalesce("lines", F.lit(0)).cast("bigint"))


@register("j11_prefix_in_parent", "SELECT c_custkey, count(*) AS parts FROM customer JOIN part ON p_brand = 'Brand#' || c_nationkey AND starts_with(p_name, lower(left(c_mktsegment, 1))) GROUP BY 1")
def j11(spark, sf):
    """A prefix inside an equi-joined parent; the prefix itself is the second equi-key."""
    parts = read(spark, sf, "part").groupBy(F.col("p_brand").alias("brand"), F.substring("p_name", 1, 1).alias("head")).agg(F.count("*").alias("parts"))
    asked = read(spark, sf, "customer").select("c_custkey", F.concat(F.lit("Brand#"), F.col("c_nationkey").cast("string")).alias("brand"), F.lower(F.substring("c_mktsegment", 1, 1)).alias("head"))
    return asked.join(parts, ["brand", "head"]).select("c_custkey", "parts")


# ------------------------------------------------------------------------------------------------- aggregates


@register("k01_conditional_aggregates", """
SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, CAST(sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS open_quantity,
       min(l_shipdate) AS first_ship, max(l_quantity) AS largest, bool_and(l_discount <= 0.1) AS all_small, max_by(l_partkey, l_orderkey * 10 + l_linenumber) AS last_part FROM lineitem GROUP BY 1""")
def k01(spark, sf):
    """A cast rounds halves to even, as in SQL. Of lines that share the largest order and line number, the first in the table tells the part; lines without a part tell none."""
    lines = read(spark, sf, "lineitem").select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    at = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return lines.groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.sum(F.when(F.col("l_linestatus") == "O", F.rint("l_quantity").cast("bigint")).otherwise(0)).alias("open_quantity"),
        F.min("l_shipdate").alias("first_ship"), F.max("l_quantity").alias("largest"), F.bool_and(F.col("l_discount") <= 0.1).alias("all_small"),
        F.min_by("l_partkey", F.when(at.isNotNull() & F.col("l_partkey").isNotNull(), F.struct(-at, "_file", "_row"))).alias("last_part"))


@register("k02_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT (l_partkey, l_suppkey)) AS pairs, count(DISTINCT CASE WHEN l_quantity > 25 THEN l_suppkey END) AS big_suppliers FROM lineitem GROUP BY 1")
def k02(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count_distinct("l_partkey").alias("parts"), F.count_distinct(F.struct("l_partkey", "l_suppkey")).alias("pairs"), F.count_distinct(F.when(F.col("l_quantity") > 25, F.col("l_suppkey"))).alias("big_suppliers"))


@register("k03_exact_quantiles", "SELECT l_returnflag, count(l_extendedprice) AS n, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY 1")
def k03(spark, sf):
    from placegrid.operators.quantiles import exact_quantiles

    q = exact_quantiles(read(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p99": 0.99})
    return q.select("l_returnflag", "n", *[F.round(c, 4).alias(c) for c in ("p10", "p50", "p99")])


@register("k04_distinct_text_list", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1")
def k04(spark, sf):
    """Distinct labels first, so a list holds no more than the labels there are."""
    return read(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ", ").alias("priorities"))


@register("k05_having", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 40")
def k05(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).filter(F.col("n") > 40)


@register("k06_pivot", "SELECT year(o_orderdate) AS period, " + ", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{s}') AS {s}" for s in "FOP") + " FROM orders GROUP BY 1")
def k06(spark, sf):
    return read(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("period")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)


@register("k07_window_over_aggregate", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY l_returnflag) AS share FROM lineitem GROUP BY 1, 2")
def k07(spark, sf):
    counts = read(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n").cast("double") / F.sum("n").over(Window.partitionBy("l_returnflag")))


# ------------------------------------------------------------------------------------------------- windows and order


@register("w01_first_of_group", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def w01(spark, sf):
    """The best row per group as one aggregate."""
    top = F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("t")
    return read(spark, sf, "orders").groupBy("o_custkey").agg(top).select("o_custkey", (-F.col("t.k")).alias("o_orderkey"), F.col("t.o_totalprice").alias("o_totalprice"))


@register("w02_position_in_table", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS position FROM lineitem")
def w02(spark, sf):
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    order = [F.col("l_extendedprice").desc(), *[F.col(c).asc() for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]]
    return position_in_order(rows, order, "position").drop("l_extendedprice")


@register("w03_rank_keeping_ties", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, rank() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC) AS r FROM lineitem) WHERE r = 1")
def w03(spark, sf):
    from placegrid.operators.scale import tie_ranked_first

    return tie_ranked_first(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), ["l_partkey"], "l_quantity")


@register("w04_lag_adjacent", """
SELECT o_custkey, period, n, CASE WHEN lag(period) OVER (PARTITION BY o_custkey ORDER BY period) = period - 1 THEN n - lag(n) OVER (PARTITION BY o_custkey ORDER BY period) END AS change FROM (SELECT o_custkey, year(o_orderdate) AS period, count(*) AS n FROM orders GROUP BY 1, 2)""")
def w04(spark, sf):
    per = read(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("period")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("o_custkey").orderBy("period")
    return per.withColumn("change", F.when(F.lag("period").over(w) == F.col("period") - 1, F.col("n") - F.lag("n").over(w)))


@register("w05_running_sum_whole_table", "SELECT o_orderkey, CAST(sum(o_custkey) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM orders")
def w05(spark, sf):
    from placegrid.operators.scale import running_sum

    rows = read(spark, sf, "orders").select("o_orderkey", "o_custkey").withColumn("sheet", F.lit(1))
    return running_sum(rows, ["sheet"], "o_orderkey", {"running": "o_custkey"}).select("o_orderkey", "running")


@register("w06_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def w06(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").limit(25)


@register("w07_count_over_all", "SELECT s_suppkey, count(*) OVER () AS suppliers FROM supplier")
def w07(spark, sf):
    rows = read(spark, sf, "supplier").select("s_suppkey")
    return rows.withColumn("suppliers", rows.agg(F.count("*")).scalar())


# ------------------------------------------------------------------------------------------------- set operations


@register("u01_union_all", "SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def u01(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).unionByName(read(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation")))


@register("u02_union_distinct", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def u02(spark, sf):
    return u01(spark, sf).distinct()


@register("u03_except_all", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def u03(spark, sf):
    orders = read(spark, sf, "orders").select("o_custkey", "o_orderstatus")
    pick = lambda s: orders.filter(F.col("o_orderstatus") == s).select("o_custkey")
    return pick("F").exceptAll(pick("O"))


@register("u04_all_columns_but", "SELECT * EXCLUDE (c_acctbal, c_mktsegment) FROM customer")
def u04(spark, sf):
    return read(spark, sf, "customer").drop("c_acctbal", "c_mktsegment")


# ------------------------------------------------------------------------------------------------- scalar functions


@register("x01_text_functions", """
SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, replace(p_name, ' ', '_') AS replaced, substr(p_name, 2, 3) AS middle, left(p_name, 2) AS head, right(p_name, 2) AS tail, length(p_name) AS n,
       instr(p_name, ' ') AS at, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, rpad(p_brand, 10, '.') AS dotted, concat_ws('-', p_brand, NULL, p_type) AS joined, string_split(p_name, ' ')[1] AS first_word,
       p_name LIKE 'red%' AS is_red, format('{:,.2f}', p_retailprice * 100) AS shown, regexp_extract(p_brand, '([0-9]+)', 1) AS digits, sha256(p_name) AS sha, md5(p_name) AS md FROM part""")
def x01(spark, sf):
    name = F.col("p_name")
    return read(spark, sf, "part").select(
        "p_partkey", F.upper(name).alias("up"), F.lower("p_brand").alias("low"), F.replace(name, F.lit(" "), F.lit("_")).alias("replaced"), F.substring(name, 2, 3).alias("middle"),
        F.left(name, F.lit(2)).alias("head"), F.right(name, F.lit(2)).alias("tail"), F.length(name).cast("bigint").alias("n"), F.instr(name, F.lit(" ")).cast("bigint").alias("at"),
        F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"), F.rpad("p_brand", 10, ".").alias("dotted"), F.concat_ws("-", "p_brand", F.lit(None), "p_type").alias("joined"),
        F.split(name, " ")[0].alias("first_word"), name.like("red%").alias("is_red"), F.format_number(F.col("p_retailprice") * 100, 2).alias("shown"),
        F.regexp_extract("p_brand", "([0-9]+)", 1).alias("digits"), F.sha2(name, 256).alias("sha"), F.md5(name).alias("md"))


@register("x02_null_and_math_functions", """
SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment, TRY_CAST(CASE WHEN c_mktsegment = 'MACHINERY' THEN 'x' ELSE CAST(c_nationkey AS VARCHAR) END AS INTEGER) AS cast_back,
       c_mktsegment IS DISTINCT FROM nullif(c_mktsegment, 'BUILDING') AS is_distinct, abs(c_acctbal) AS size, greatest(c_nationkey, 10, NULL) AS high, least(c_nationkey, 10, NULL) AS low FROM customer""")
def x02(spark, sf):
    segment = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    shown = F.when(F.col("c_mktsegment") == "MACHINERY", "x").otherwise(F.col("c_nationkey").cast("string"))
    return read(spark, sf, "customer").select(
        "c_custkey", F.coalesce(segment, F.lit("none")).alias("segment"), shown.try_cast("int").alias("cast_back"), (~F.col("c_mktsegment").eqNullSafe(segment)).alias("is_distinct"),
        F.abs("c_acctbal").alias("size"), F.greatest("c_nationkey", F.lit(10), F.lit(None).cast("int")).alias("high"), F.least("c_nationkey", F.lit(10), F.lit(None).cast("int")).alias("low"))


@register("x03_time_functions", """
SELECT event_id, CAST(ts AS DATE) AS day, date_diff('second', DATE '2024-01-01', ts) AS seconds, ts - INTERVAL 2 DAY AS earlier, ts >= TIMESTAMP '2024-01-10' - INTERVAL 3 DAY AS recent FROM events""")
def x03(spark, sf):
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    return read(spark, sf, "events").select(
        "event_id", F.col("ts").cast("date").alias("day"), F.timestamp_diff("SECOND", start, F.date_trunc("second", "ts")).alias("seconds"), (F.col("ts") - F.expr("INTERVAL 2 DAYS")).alias("earlier"),
        (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz") - F.expr("INTERVAL 3 DAYS")).alias("recent"))


@register("x04_array_functions", """
SELECT p_partkey, u.word, list_contains(string_split(p_name, ' '), 'red') AS has_red, array_to_string(string_split(p_name, ' '), '/') AS slashed FROM part, unnest(string_split(p_name, ' ')) u(word)""")
def x04(spark, sf):
    words = F.split("p_name", " ")
    return read(spark, sf, "part").select("p_partkey", F.explode(words).alias("word"), F.array_contains(words, "red").alias("has_red"), F.array_join(words, "/").alias("slashed"))


@register("x05_day_sequence", "SELECT o_custkey, CAST(unnest(generate_series(CAST(a AS DATE), CAST(a AS DATE) + 2, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT o_custkey, min(o_orderdate) AS a FROM orders GROUP BY 1)")
def x05(spark, sf):
    first = read(spark, sf, "orders").groupBy("o_custkey").agg(F.min(F.col("o_orderdate").cast("date")).alias("a"))
    return first.select("o_custkey", F.explode(F.sequence("a", F.date_add("a", 2))).alias("day"))
