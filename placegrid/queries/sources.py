"""Ingestion, sink and manifest queries (S)."""

from __future__ import annotations


from pyspark.sql import functions as F

from placegrid.operators import control, gates
from placegrid.queries.analytics import UNITS_SQL, unit_list
from placegrid.queries.cleaning import SHAPE_KIND_SQL, batches, customer_shapes
from placegrid.queries.control import checks_sql
from placegrid.queries.registry import register
from placegrid.queries.star import read
from placegrid.session import scratch_path
from placegrid.sources import contract, files, ingest, publish

DELIVERED = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]


@register("s01_delimited_scan", """
SELECT c_custkey, c_name, CASE c_mktsegment WHEN 'BUILDING' THEN '' ELSE c_mktsegment END AS c_mktsegment, CAST(count(*) OVER () AS BIGINT) AS rows_numbered FROM (
  SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_nationkey = 1 THEN 'Niño, "' || c_name || '"' ELSE c_name END AS c_name, c_mktsegment FROM customer)""")
def s01(spark, sf):
    """Customers delivered as CSV files with quotes, accents and blanks, read back."""
    name = F.when(F.col("c_nationkey") == 1, F.concat(F.lit('Niño, "'), F.col("c_name"), F.lit('"'))).otherwise(F.col("c_name"))
    path = scratch_path(spark, "delivery-csv")
    read(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("c_custkey"), name.alias("c_name"), F.col("c_nationkey").cast("string").alias("c_nationkey"),
        F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("c_mktsegment")).write.option("header", True).option("escape", '"').csv(path)
    rows = files.read_delimited(spark, path, DELIVERED)
    numbered = rows.select("source_file", "source_row_number").distinct().agg(F.count("*")).scalar()
    return rows.select("c_custkey", "c_name", "c_mktsegment").withColumn("rows_numbered", numbered)


@register("s02_feature_scan", """
SELECT 'C' || c_custkey AS code, c_nationkey || '.2460' AS area, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_name END AS name,
       '{"type":"Point","coordinates":[' || c_nationkey || '.50,' || c_custkey || ']}' AS geometry FROM customer
UNION ALL
SELECT 'S' || s_suppkey, s_nationkey || '.10', s_name || ' {"[', '{"type": "GeometryCollection",' || chr(10) || '"geometries": [{"type":"Point","coordinates":[' || s_nationkey || ',1.0]},'
       || chr(10) || '{"type":"Polygon","coordinates":[[[0,0],[1,0],' || chr(10) || '[1,1],[0,0]]]}]}' FROM supplier""")
def s02(spark, sf):
    """Customers delivered as GeoJSON features, one per line or a collection on one line, and suppliers as pretty-printed
    collections of nested geometries; digits come back as published."""
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    name = F.when(F.col("c_mktsegment") == "BUILDING", "null").otherwise(F.concat(F.lit('"'), F.col("c_name"), F.lit('"')))
    line = F.concat(F.lit('{"type":"Feature","properties":{"code":"C'), key, F.lit('","area":'), nation, F.lit('.2460,"name":'), name,
                    F.lit('},"geometry":{"type":"Point","coordinates":['), nation, F.lit(".50,"), key, F.lit("]}},"))
    path = scratch_path(spark, "delivery-geojson")
    lines = read(spark, sf, "customer").select("c_custkey", line.alias("value"))
    together = lines.where("c_custkey % 3 = 0").groupBy(F.floor(F.col("c_custkey") / 50)).agg(F.concat(
        F.lit('{"type":"FeatureCollection","features":['), F.rtrim(F.concat_ws("", F.collect_list("value")), F.lit(",")), F.lit("]}")).alias("value"))
    lines.where("c_custkey % 3 <> 0").select("value").unionByName(together.select("value")).write.text(path)
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    pretty = F.concat(F.lit('{ "type":\n"Feature", "properties": {"code": "S'), key, F.lit('",\n "area": '), nation, F.lit('.10, "name": "'), F.col("s_name"), F.lit(' {\\"["}, "geometry":\n'),
                      F.lit('{"type": "GeometryCollection",\n"geometries": [{"type":"Point","coordinates":['), nation,
                      F.lit(',1.0]},\n{"type":"Polygon","coordinates":[[[0,0],[1,0],\n[1,1],[0,0]]]}]} }'))
    collected = read(spark, sf, "supplier").groupBy(F.floor(F.col("s_suppkey") / 20).alias("file")).agg(F.concat(
        F.lit('{\n "type": "FeatureCollection",\n "crs": {"type": "name", "properties": {"name": {"a": 1}}},\n "features": [\n'), F.concat_ws(",\n", F.collect_list(pretty)), F.lit("\n]}")).alias("value"))
    # a file for each collection, all in one folder
    collected.select("value").write.option("maxRecordsPerFile", 1).text(f"{path}/collections")
    path = [path, f"{path}/collections"]
    return files.read_features(spark, path, ["code", "area", "name"]).select("code", "area", "name", "geometry")


@register("s03_row_kinds", """
SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'title' WHEN turn = 1 AND role = 'assistant' THEN 'blank' WHEN role = 'user' THEN 'unit' WHEN turn > 3 THEN 'unclassified' ELSE 'banner' END AS source_row_kind FROM conversations""")
def s03(spark, sf):
    """Conversation turns as sheet rows: which cells are filled decides the kind."""
    first_reply = (F.col("turn") == 1) & (F.col("role") == "assistant")
    cells = read(spark, sf, "conversations").select(
        "conv_id", "turn", "role", F.when(F.col("role") == "user", "7").otherwise(" ").alias("id"),
        F.when(first_reply, "").otherwise(F.col("text")).alias("label"), F.when(~first_reply & (F.col("turn") > 3), "3").otherwise("").alias("v1"), F.lit("").alias("v2"))
    return files.classify_rows(cells, "id", "label", ["v1", "v2"], {"title": F.col("role") == "system"}).select("conv_id", "turn", "source_row_kind")


@register("s04_schema_match", "SELECT 'v2' AS schema_version, sha256('n_nationkey' || chr(31) || 'n_name' || chr(31) || 'n_regionkey') AS schema_fingerprint, count(*) AS rows FROM nation")
def s04(spark, sf):
    rows = read(spark, sf, "nation")
    version, mark = contract.match_schema(rows.columns, {"v1": ["n_nationkey", "n_name"], "v2": ["n_nationkey", "n_name", "n_regionkey"]})
    return rows.agg(F.lit(version).alias("schema_version"), F.lit(mark).alias("schema_fingerprint"), F.count("*").alias("rows"))


def document_files(spark, sf):
    """Every document as one delivered file: its path and its bytes."""
    return read(spark, sf, "documents").select(
        F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content"), "doc_id", "text")


MANIFEST_SQL = "manifest AS (SELECT sha256(text) AS sha256, min(source || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.txt') AS path, max(strlen(text)) AS bytes, count(*) AS copies FROM documents GROUP BY 1)"


@register("s05_file_manifest", f"WITH {MANIFEST_SQL} SELECT * FROM manifest")
def s05(spark, sf):
    return files.manifest(document_files(spark, sf))


@register("s05_landing_manifest", """
SELECT sha256(string_agg(c_name || chr(10), '' ORDER BY c_name)) AS sha256, sum(length(c_name) + 1)::BIGINT AS bytes, 1 AS copies FROM customer GROUP BY c_custkey // 100""")
def s05_landing(spark, sf):
    """Customers written as text files of a hundred lines each, found again by their bytes."""
    path = scratch_path(spark, "landing")
    lines = read(spark, sf, "customer").select("c_name", F.floor(F.col("c_custkey") / 100).alias("delivery"))
    (lines.repartition("delivery").sortWithinPartitions("delivery", "c_name").write.partitionBy("delivery").text(path))
    return files.manifest(files.read_landing(spark, path, "*.txt")).drop("path")


@register("s05_missing_approved", f"WITH {MANIFEST_SQL} SELECT sha256(text) AS sha256 FROM benchmark WHERE sha256(text) NOT IN (SELECT sha256 FROM manifest)")
def s05_missing(spark, sf):
    approved = read(spark, sf, "benchmark").select(F.sha2("text", 256).alias("sha256"))
    return files.missing_approved(approved, files.manifest(document_files(spark, sf)))


def _remembered(spark, sf):
    """Labeled documents as remembered batches, keyed by their bytes."""
    status = F.when(F.col("toxic") == 1, "blocked").when(F.col("quality") == 1, "succeeded").otherwise("failed")
    labeled = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return labeled.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.max(status).alias("status"))


@register("s06_load_decision", f"""WITH {MANIFEST_SQL},
remembered AS (SELECT sha256(text) AS sha256, max(CASE WHEN toxic = 1 THEN 'blocked' WHEN quality = 1 THEN 'succeeded' ELSE 'failed' END) AS status FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT m.path, r.status AS batch_status, CASE WHEN r.status IS NULL OR r.status = 'blocked' THEN 'load' WHEN r.status = 'succeeded' THEN 'skip' ELSE 'retry' END AS action FROM manifest m LEFT JOIN remembered r USING (sha256)""")
def s06(spark, sf):
    return ingest.choose_action(files.manifest(document_files(spark, sf)), _remembered(spark, sf)).select("path", "batch_status", "action")


@register("s07_load_type", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'revision' WHEN l.latest IS NULL THEN 'initial' WHEN year(o_orderdate) < l.latest THEN 'backfill' ELSE 'incremental' END AS load_type
FROM orders o LEFT JOIN (SELECT o_custkey, max(year(o_orderdate)) AS latest FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) < 1999 GROUP BY 1) l USING (o_custkey)""")
def s07(spark, sf):
    orders = read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("source_id"), F.year("o_orderdate").alias("period"), "o_orderstatus")
    deliveries = orders.withColumn("delivery_version", F.when(F.col("o_orderstatus") == "P", 2).otherwise(1))
    return ingest.load_type(deliveries, orders.filter((F.col("o_orderstatus") == "F") & (F.col("period") < 1999))).select("o_orderkey", "load_type")


@register("s07_load_type_for_years", """
WITH d AS (SELECT o_custkey AS source_id, list(DISTINCT year(o_orderdate)) AS years FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), s AS (SELECT o_custkey AS source_id, list(DISTINCT year(o_orderdate)) AS years FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT d.source_id, CASE WHEN s.years IS NULL THEN 'initial' WHEN list_has_any(d.years, s.years) THEN 'revision' WHEN list_max(d.years) < list_max(s.years) THEN 'backfill' ELSE 'incremental' END AS load_type FROM d LEFT JOIN s USING (source_id)""")
def s07_years(spark, sf):
    years = lambda status: read(spark, sf, "orders").filter(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("source_id")).agg(F.collect_set(F.year("o_orderdate")).alias("years"))
    return ingest.load_type_for_years(years("P").withColumn("delivery_version", F.lit(1)), years("F")).select("source_id", "load_type")


@register("s08_row_checks", """
SELECT v.check_name, CASE WHEN v.ok THEN 'PASS' WHEN v.warn THEN 'WARN' ELSE 'FAIL' END AS status, v.expected, CAST(v.a AS VARCHAR) AS actual FROM (
  SELECT 'row_count_nonzero' AS check_name, count(*) AS a, count(*) > 0 AS ok, false AS warn, '> 0' AS expected FROM part
  UNION ALL SELECT 'row_count_matches_approved', count(*), count(*) = 1999, false, '1999' FROM part UNION ALL SELECT 'required_columns_present', 1, false, false, '0'
  UNION ALL SELECT 'p_name_not_blank', count(*) FILTER (WHERE trim(p_name) = ''), count(*) FILTER (WHERE trim(p_name) = '') = 0, false, '0' FROM part
  UNION ALL SELECT 'p_name_format', count(*) FILTER (WHERE NOT regexp_full_match(p_name, '[a-z]+ bolt')), false, true, '0' FROM part
  UNION ALL SELECT 'p_name_unique_in_file', count(*) - count(DISTINCT p_name), count(*) = count(DISTINCT p_name), true, '0' FROM part
  UNION ALL SELECT 'duplicate_rows_in_file', (SELECT count(*) FROM part) - count(*), (SELECT count(*) FROM part) = count(*), true, '0' FROM (SELECT DISTINCT p_name, p_brand FROM part)) v""")
def s08(spark, sf):
    rows = read(spark, sf, "part").select("p_name", "p_brand")
    return ingest.row_checks(rows, "p_name", "[a-z]+ bolt", ["p_name", "p_code"], 1999)


@register("s09_known_issues", checks_sql("customer", [
    ("known_issue/short_identifier", "count(*) FILTER (WHERE length(CAST(c_custkey AS VARCHAR)) < 3)", "{a} = 100", "100", "WARN"), ("known_issue/label_equals", "count(*) FILTER (WHERE c_mktsegment = 'BUILDING')", "{a} = 0", "0", "WARN"),
    ("known_issue/number_at_most", "count(*) FILTER (WHERE c_acctbal <= 0)", "{a} = 0", "0", "WARN"), ("known_issue/number_above", "count(*) FILTER (WHERE c_acctbal > 99999)", "{a} = 0", "0", "WARN")]))
def s09(spark, sf):
    return ingest.known_issues(read(spark, sf, "customer"), {
        "short_identifier": (F.length(F.col("c_custkey").cast("string")) < 3, 100), "label_equals": (F.col("c_mktsegment") == "BUILDING", 0),
        "number_at_most": (F.col("c_acctbal") <= 0, 0), "number_above": (F.col("c_acctbal") > 99999, 0)})


@register("s10_geometry_file_checks", checks_sql(f"(SELECT *, {SHAPE_KIND_SQL} AS kind FROM customer)", [
    ("geometry_not_null", "count(*) FILTER (WHERE kind IS NULL)", "{a} = 0", "0", "FAIL"), ("geometry_type_allowed", "count(*) FILTER (WHERE kind = 'Point')", "{a} = 0", "0", "FAIL"),
    ("single_reference_date", "CASE WHEN min(c_nationkey) = max(c_nationkey) THEN 1 ELSE 2 END", "{a} = 1", "1", "FAIL"), ("crs_is_wgs84", "0", "{a} = 0", "0", "FAIL"), ("no_byte_order_mark", "0", "{a} = 0", "0", "FAIL")]))
def s10(spark, sf):
    rows = customer_shapes(spark, sf).withColumns({"released": F.col("c_nationkey"), "crs": F.lit("EPSG:4326")})
    return ingest.geometry_checks(rows, "geometry", "released", "crs")


BRONZE = ["party_key", "party_name", "segment", "balance"]


def bronze(spark, sf):
    """Customers and suppliers as two schema versions of one Bronze table."""
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")

    def rows(table, key, name, extra):
        delivered = read(spark, sf, table).select(F.col(key).cast("string").alias("party_key"), F.col(name).alias("party_name"), extra)
        return ingest.bronze_rows(delivered, BRONZE, {"source_id": F.lit(table), "source_sha256": F.sha2("party_name", 256),
                                                      "batch_id": F.lit(f"{table}-1"), "ingested_at_utc": at})

    return rows("customer", "c_custkey", "c_name", F.col("c_mktsegment").alias("segment")).unionByName(
        rows("supplier", "s_suppkey", "s_name", F.format_number("s_acctbal", 2).alias("balance")))


@register("s11_bronze_rows", """
SELECT CAST(c_custkey AS VARCHAR) AS party_key, c_name AS party_name, c_mktsegment AS segment, NULL AS balance, 'customer' AS source_id, sha256(c_name) AS source_sha256, 'customer-1' AS batch_id, TIMESTAMP '2024-01-01' AS ingested_at_utc FROM customer
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, NULL, format('{:,.2f}', s_acctbal), 'supplier', sha256(s_name), 'supplier-1', TIMESTAMP '2024-01-01' FROM supplier""")
def s11(spark, sf):
    return bronze(spark, sf)


@register("s12_insert_only_merge", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1, 2""")
def s12(spark, sf):
    lines = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source_sha256"), F.col("l_linenumber").alias("source_row_number"))
    existing = lines.filter(F.col("source_row_number") <= 4).distinct()
    once = existing.unionByName(ingest.insert_only(existing, lines))
    twice = once.unionByName(ingest.insert_only(once, lines))  # a repeated delivery adds nothing
    return twice.groupBy(F.col("source_sha256").alias("l_orderkey"), F.col("source_row_number").alias("l_linenumber")).agg(F.count("*").alias("n"))


@register("s13_upsert_named_columns", """
SELECT coalesce(s.s_suppkey, c.c_custkey) AS key, coalesce(s.s_name, c.c_name) AS name, CASE WHEN c.c_custkey IS NOT NULL THEN c.c_acctbal ELSE s.s_acctbal END AS balance FROM supplier s FULL JOIN customer c ON c.c_custkey = s.s_suppkey""")
def s13(spark, sf):
    existing = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    incoming = read(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return control.upsert(existing, incoming, ["key"], ["balance"])


@register("s14_append_log_rows", "SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance FROM supplier UNION ALL SELECT c_custkey, c_name, NULL FROM customer")
def s14(spark, sf):
    log = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return control.append_rows(log, read(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")))


def reconciled(spark, sf):
    loaded = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("source_row_number"), "l_partkey")
    expected = read(spark, sf, "orders").select(F.col("o_orderkey").alias("batch_id"), F.when(F.col("o_orderstatus") == "F", 3).otherwise(4).cast("bigint").alias("expected_rows"))
    return ingest.reconcile_load(loaded, expected, ["batch_id"], provenance=["l_partkey"])


RECONCILED_SQL = """
reconciled AS (SELECT o_orderkey AS batch_id, l.rows, l.distinct_rows, l.first_row, l.last_row, l.provenance_missing, CASE WHEN o_orderstatus = 'F' THEN 3 ELSE 4 END AS expected_rows,
  CASE WHEN coalesce(l.rows = CASE WHEN o_orderstatus = 'F' THEN 3 ELSE 4 END AND l.rows = l.distinct_rows AND l.last_row - l.first_row + 1 = l.rows, false) THEN 'PASS' ELSE 'FAIL' END AS status
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS rows, count(DISTINCT l_linenumber) AS distinct_rows, min(l_linenumber) AS first_row, max(l_linenumber) AS last_row, 0 AS provenance_missing FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey)"""


@register("s15_post_load_reconciliation", f"WITH {RECONCILED_SQL} SELECT * FROM reconciled")
def s15(spark, sf):
    return reconciled(spark, sf)


@register("s16_batch_life_cycle", f"""WITH {RECONCILED_SQL}
SELECT o.o_orderkey AS batch_id, CASE WHEN o_totalprice > 450000 THEN 'blocked' WHEN r.status = 'PASS' THEN 'succeeded' WHEN o_orderpriority = '5-LOW' THEN 'loading' ELSE 'failed' END AS status
FROM orders o JOIN reconciled r ON r.batch_id = o.o_orderkey""")
def s16(spark, sf):
    orders = read(spark, sf, "orders")
    checks = orders.select(F.col("o_orderkey").alias("batch_id"), F.when(F.col("o_totalprice") > 450000, "FAIL").otherwise("PASS").alias("status"))
    low = orders.filter(F.col("o_orderpriority") == "5-LOW").select(F.col("o_orderkey").alias("batch_id"))
    rows = reconciled(spark, sf)
    finished = rows.join(low, "batch_id", "left_anti").unionByName(rows.filter(F.col("status") == "PASS").join(low, "batch_id", "left_semi"))
    waiting = orders.select(F.col("o_orderkey").alias("batch_id"), F.lit("validating").alias("status"))
    return ingest.batch_state(waiting, checks, finished)


# Every order is a batch and every line an event of its log, with retries, illegal steps and unknown events among them.
_EVENTS = ("start", "load", "succeed", "fail", "block", "rerun", "start", "load", "other")
_EVENT_LIST = ", ".join(f"'{e}'" for e in _EVENTS)
_STEP_ROWS = ", ".join(f"('{a}', '{e}', '{b}')" for (a, e), b in ingest.BATCH_STEPS.items())


@register("s16_batch_log", f"""
WITH RECURSIVE log AS (
  SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY l_linenumber, event) AS n
  FROM (SELECT l_orderkey AS batch_id, l_linenumber, [{_EVENT_LIST}][1 + (l_partkey + l_linenumber * l_suppkey) % {len(_EVENTS)}] AS event FROM lineitem)),
steps(state, event, next) AS (VALUES {_STEP_ROWS}),
fold AS (
  SELECT DISTINCT batch_id, 0::BIGINT AS n, 'new' AS status, 0::BIGINT AS attempts, 0::BIGINT AS refused FROM log
  UNION ALL
  SELECT f.batch_id, l.n, coalesce(s.next, f.status), f.attempts + (s.next IS NOT NULL AND l.event IN ('start', 'rerun'))::BIGINT, f.refused + (s.next IS NULL)::BIGINT
  FROM fold f JOIN log l ON l.batch_id = f.batch_id AND l.n = f.n + 1 LEFT JOIN steps s ON s.state = f.status AND s.event = l.event)
SELECT batch_id, arg_max(status, n) AS status, max(attempts) AS attempts, max(refused) AS refused FROM fold GROUP BY batch_id""")
def s16_log(spark, sf):
    """The first lines of every log are folded first, and the fold goes on from there with the rest."""
    names = F.array(*[F.lit(e) for e in _EVENTS])
    log = read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("batch_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("event_number"), "l_linenumber",
        F.get(names, ((F.col("l_partkey") + F.col("l_linenumber") * F.col("l_suppkey")) % len(_EVENTS)).cast("int")).alias("event"))
    return ingest.batch_life_cycle(log.where("l_linenumber > 3"), ingest.batch_life_cycle(log.where("l_linenumber <= 3")))


@register("s17_current_version_per_period", """
SELECT batch_id, source_id, period, delivery_version FROM (SELECT o_orderkey AS batch_id, o_custkey AS source_id, strftime(o_orderdate, '%Y-%m') AS period, o_orderkey AS delivery_version,
  row_number() OVER (PARTITION BY o_custkey, strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey DESC) AS r FROM orders WHERE o_orderstatus <> 'F') WHERE r = 1""")
def s17(spark, sf):
    return control.current_batches(batches(spark, sf)).select("batch_id", "source_id", "period", "delivery_version")


@register("s18_additive_evolution", "SELECT s_suppkey AS key, s_name AS name, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer")
def s18(spark, sf):
    old = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return contract.evolve(old, read(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment")), ["key", "name", "segment"])


@register("s19_candidate_and_publish", "SELECT s_nationkey, count(*) AS suppliers, CAST(max(s_suppkey) AS BIGINT) AS last_key FROM supplier GROUP BY 1")
def s19(spark, sf):
    """The first build passes its gate and is published; the second fails and leaves the published table as it was."""
    root = scratch_path(spark, "gold")
    build = lambda df: df.groupBy("s_nationkey").agg(F.count("*").alias("suppliers"), F.max("s_suppkey").alias("last_key"))
    gate = lambda df: gates.all_checks(gates.key_checks(df, ["s_nationkey"]), gates.run_checks(df, [gates.zero("no_supplier_zero", F.col("last_key") < 0)]))
    good = publish.write_candidate(build(read(spark, sf, "supplier")), root, "suppliers_per_nation", "run-1")
    publish.publish(good, root, "suppliers_per_nation", "run-1", gate(good))
    bad = publish.write_candidate(build(read(spark, sf, "supplier").withColumn("s_suppkey", F.lit(-1))), root, "suppliers_per_nation", "run-2")
    try:
        publish.publish(bad, root, "suppliers_per_nation", "run-2", gate(bad))
    except gates.GateFailed:
        pass
    return publish.read_published(spark, root, "suppliers_per_nation")


@register("s20_publish_column_subset", "SELECT n_regionkey, count(*) AS nations FROM nation GROUP BY 1")
def s20(spark, sf):
    root = scratch_path(spark, "gold")
    rows = read(spark, sf, "nation").groupBy("n_regionkey").agg(F.count("*").alias("nations"), F.max("n_name").alias("audit_last_name"))
    candidate = publish.write_candidate(rows, root, "nations", "run-1")
    publish.publish(candidate, root, "nations", "run-1", gates.key_checks(candidate, ["n_regionkey"]), columns=["n_regionkey", "nations"])
    return publish.read_published(spark, root, "nations")


_FRAMED = " || ".join(f"CASE WHEN {c} IS NULL THEN 'n' ELSE 'v' || length({c}) || ':' || {c} END" for c in (
    "o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"))


@register("s21_content_hash", f"""
WITH texts AS (SELECT o_custkey::VARCHAR AS o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderkey::VARCHAR AS o_orderkey, o_orderpriority, o_orderstatus,
                      o_totalprice::DECIMAL(18, 2)::VARCHAR AS o_totalprice FROM orders),
rows AS (SELECT md5({_FRAMED}) AS d FROM texts)
SELECT count(*) AS row_count, CAST(sum(CAST(('0x' || substr(d, 1, 16)) AS HUGEINT)) AS VARCHAR) || '-' || CAST(sum(CAST(('0x' || substr(d, 17, 16)) AS HUGEINT)) AS VARCHAR) AS content_sum FROM rows""")
def s21(spark, sf):
    """Every column takes part; price and date have one written form, as a decimal and an ISO day."""
    rows = read(spark, sf, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)")).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return publish.content_hash(rows)


@register("s22_publisher_summary", """
SELECT c_mktsegment, units, total, CASE WHEN c_mktsegment = 'BUILDING' THEN units + 1 ELSE units END AS published_units, total AS published_total, CASE WHEN c_mktsegment = 'BUILDING' THEN 'WARN' ELSE 'PASS' END AS status
FROM (SELECT c_mktsegment, count(*) AS units, CAST(sum(c_custkey) AS BIGINT) AS total FROM customer GROUP BY 1)""")
def s22(spark, sf):
    rows = read(spark, sf, "customer").select("c_mktsegment", "c_custkey")
    summary = rows.groupBy("c_mktsegment").agg((F.count("*") + F.when(F.first("c_mktsegment") == "BUILDING", 1).otherwise(0)).alias("published_units"), F.sum("c_custkey").alias("published_total"))
    return ingest.reconcile_summary(rows, summary, "c_mktsegment", "c_custkey")


@register("s22_orphan_rows", f"""WITH {UNITS_SQL}, kept AS (SELECT * FROM units WHERE level <> 'Prov' OR name NOT LIKE '%1%')
SELECT code, name, level FROM kept WHERE level = 'City' AND left(code, 4) || '00000000' NOT IN (SELECT code FROM kept)""")
def s22_orphans(spark, sf):
    from placegrid.functions.text import ancestor_code

    kept = unit_list(spark, sf).filter((F.col("level") != "Prov") | ~F.col("name").contains("1"))
    return ingest.orphan_rows(kept, "code", F.when(F.col("level") == "City", ancestor_code("code", 4, 12)).otherwise(F.col("code")))


@register("s23_refuse_unapproved", """
WITH found AS (SELECT doc_id, source || '-' || doc_id AS file_name, sha256(text) AS sha256 FROM documents),
approved AS (SELECT CASE WHEN lang = 'fr' THEN source || '-' || doc_id || '-old' ELSE source || '-' || doc_id END AS file_name, CASE WHEN lang = 'es' THEN sha256('changed' || doc_id) ELSE sha256(text) END AS sha256
             FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS copy FROM documents) WHERE lang <> 'de' AND copy = 1)
SELECT f.doc_id, CASE WHEN b.file_name = f.file_name THEN 'accepted' WHEN b.file_name IS NOT NULL THEN 'skipped: repackaged copy' WHEN n.sha256 IS NOT NULL THEN 'blocked: checksum mismatch' ELSE 'blocked: unregistered' END AS decision
FROM found f LEFT JOIN approved b ON b.sha256 = f.sha256 LEFT JOIN approved n ON n.file_name = f.file_name""")
def s23(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "lang", F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("file_name"), F.sha2("text", 256).alias("sha256"))
    first = docs.groupBy("sha256").agg(F.min(F.struct("doc_id", "file_name", "lang")).alias("d")).select("sha256", "d.*").filter(F.col("lang") != "de")
    changed = F.sha2(F.concat(F.lit("changed"), F.col("doc_id").cast("string")), 256)
    approved = first.select(F.when(F.col("lang") == "fr", F.concat("file_name", F.lit("-old"))).otherwise(F.col("file_name")).alias("file_name"),
                            F.when(F.col("lang") == "es", changed).otherwise(F.col("sha256")).alias("sha256"))
    return ingest.file_decision(docs, approved).select("doc_id", "decision")
