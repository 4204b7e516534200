"""Gates that block, sinks that survive, readers that refuse."""

import datetime

import pytest
from pyspark.sql import functions as F, types as T

from helpers import by_key, rows, statuses
from placegrid.operators import control, gates
from placegrid.sources import contract, files, ingest, publish
from placegrid.streaming.landing import load_landing


def test_a_changed_row_fails_the_gate_and_keeps_the_published_table(spark, table, tmp_path):
    source = table([("a", 1), ("b", 2)], "k string, v int")

    def build_and_publish(df, run):
        candidate = publish.write_candidate(df, str(tmp_path), "t", run)
        checks = gates.all_checks(gates.key_checks(candidate, ["k"]), gates.compare_rows(candidate, source, ["k"], ["v"]))
        publish.publish(candidate, str(tmp_path), "t", run, checks, results_path=str(tmp_path / "results"))

    build_and_publish(source, "run-1")
    with pytest.raises(gates.GateFailed, match="v_matches"):
        build_and_publish(source.withColumn("v", F.when(F.col("k") == "b", 3).otherwise(F.col("v"))), "run-2")
    with pytest.raises(gates.GateFailed, match="key_unique"):
        build_and_publish(source.union(source), "run-3")
    assert rows(publish.read_published(spark, str(tmp_path), "t")) == [("a", 1), ("b", 2)]
    assert spark.read.parquet(str(tmp_path / "results")).filter("status = 'FAIL'").count() >= 2
    with pytest.raises(LookupError):
        publish.read_published(spark, str(tmp_path), "other")


def test_warnings_do_not_block(table):
    df = table([(1,), (200,)], "v int")
    assert gates.record_and_raise(gates.run_checks(df, [gates.zero("small", F.col("v") > 100, warn_only=True)])) == []


def test_an_unknown_verdict_counts_as_bad(table):
    df = table([(None,), (1,)], "v int")
    assert statuses(gates.run_checks(df, [gates.zero("zero", F.col("v") < 0), gates.rule_holds("rule", F.col("v") == 1), gates.counter("count", F.col("v") == 1)])) == {
        "zero": "FAIL", "rule": "FAIL", "count": "PASS"}


def test_checks_on_an_empty_table(table):
    empty = table([], "k string, v int")
    assert set(statuses(gates.key_checks(empty, ["k"])).values()) == {"PASS"}
    assert statuses(gates.run_checks(empty, [gates.at_least("rows", F.count("*"), 1)])) == {"rows": "FAIL"}
    assert statuses(gates.totals_reconcile(empty, empty, ["k"], "v", "t")) == {"t": "PASS"}


def test_bags(table):
    a, b = table([("x",), ("x",), ("y",)], "k string"), table([("x",), ("y",), ("y",)], "k string")
    assert statuses(gates.same_bag(a, b, ["k"])) == {"same_rows": "FAIL"} and statuses(gates.same_bag(a, a, ["k"])) == {"same_rows": "PASS"}


def test_quarantine_rate(table):
    df = table([([],)] * 199 + [(["x"],)], "reasons array<string>")
    assert statuses(gates.quarantine_rate(df, "reasons", ["x", "y"])) == {"quarantine_rate": "WARN", "quarantine_reason/x": "WARN", "quarantine_reason/y": "PASS"}
    assert statuses(gates.quarantine_rate(df.limit(0).union(df.filter("size(reasons) > 0")), "reasons", []))["quarantine_rate"] == "FAIL"


def test_tree_gate(table):
    good = [("s", 1, None, 6), ("s", 2, 1, 2), ("s", 3, 1, 4)]
    schema = "sheet string, pos long, parent_pos long, v long"
    run = lambda data: statuses(gates.tree_closes(table(data, schema), ["sheet"], "pos", "parent_pos", "v"))
    assert set(run(good).values()) == {"PASS"}
    assert run(good[:2])["children_sum_to_parent"] == "FAIL"
    assert run([("s", 2, 1, 2), ("s", 3, None, 4)])["parent_exists"] == "FAIL"
    assert run(good + [("s", 9, None, 1)])["one_root"] == "FAIL"


def test_upsert_and_append(table):
    ledger = table([("r1", "running", None), ("r2", "running", "old")], "run_id string, status string, note string")
    done = table([("r1", "failed", "x"), ("r3", "succeeded", "new")], "run_id string, status string, note string")
    assert rows(control.upsert(ledger, done, ["run_id"], ["status"])) == [("r1", "failed", None), ("r2", "running", "old"), ("r3", "succeeded", "new")]
    with pytest.raises(ValueError):
        control.upsert(ledger, done.withColumn("extra", F.lit(1)), ["run_id"], ["status"])
    assert rows(control.append_rows(ledger, table([("r4",)], "run_id string")).filter("run_id = 'r4'")) == [("r4", None, None)]


def test_current_batches_and_actions(table):
    batches = table([("b1", "s", "2023", "d", 1, "succeeded", "h1"), ("b2", "s", "2023", "d", 2, "succeeded", "h2"), ("b3", "s", "2023", "d", 3, "failed", "h3"), ("b4", "s", None, "d", 1, "succeeded", "h4"),
                     ("b5", "s", "2024", "d", 1, "blocked", "h5")], "batch_id string, source_id string, period string, dataset string, delivery_version int, status string, sha256 string")
    assert rows(control.current_batches(batches), "batch_id") == [("b2",), ("b4",)]
    found = table([("h1",), ("h3",), ("h5",), ("h9",)], "sha256 string")
    assert rows(ingest.choose_action(found, batches), "sha256", "action") == [("h1", "skip"), ("h3", "retry"), ("h5", "load"), ("h9", "load")]
    assert rows(ingest.choose_action(found.filter("sha256 = 'h1'"), batches, rerun=True), "action") == [("rerun",)]


def test_load_types(table):
    deliveries = table([("a", "2023-24", 1), ("a", "2020-21", 1), ("a", "2025-26", 1), ("a", "2021-22", 2), ("n", "2020-21", 1)], "source_id string, period string, delivery_version int")
    loaded = table([("a", "2022-23"), ("a", "2023-24")], "source_id string, period string")
    assert [r["load_type"] for r in ingest.load_type(deliveries, loaded).orderBy("source_id", "period").collect()] == ["backfill", "revision", "incremental", "incremental", "initial"]
    years = table([("a", [2018, 2021], 1), ("b", [2015], 1), ("b", [2025], 1), ("c", [2020], 1)], "source_id string, years array<int>, delivery_version int")
    known = table([("a", [2021]), ("b", [2020])], "source_id string, years array<int>")
    assert sorted(r["load_type"] for r in ingest.load_type_for_years(years, known).collect()) == ["backfill", "incremental", "initial", "revision"]


def test_freshness_and_lanes(table):
    limits = table([("a", 10), ("b", 10), ("c", 10)], "source_id string, max_age_days int")
    current = table([("a", datetime.datetime(2024, 1, 5)), ("b", datetime.datetime(2023, 12, 1))], "source_id string, succeeded_at timestamp_ntz")
    got = by_key(control.freshness(limits, current, F.lit("2024-01-10").cast("timestamp_ntz")), "source_id")
    assert [got[s]["status"] for s in "abc"] == ["PASS", "WARN", "WARN"] and got["c"]["actual"] == "no succeeded batch"
    lanes = control.lane_status(["x", "y", "z"], table([("x", "succeeded"), ("y", "failed")], "lane string, status string"))
    assert rows(lanes, "check_name", "status", "actual") == [("lane/x", "PASS", "succeeded"), ("lane/y", "FAIL", "failed"), ("lane/z", "FAIL", "not run")]


def test_delimited_reader(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text('id,name\n1,"Niño, ""x"""\n2,\n3,""\n', encoding="utf-8")
    got = rows(files.read_delimited(spark, str(folder), ["id", "name"]), "source_row_number", "id", "name")
    assert got == [(1, "1", 'Niño, "x"'), (2, "2", ""), (3, "3", "")]
    (folder / "b.csv").write_text("id,name\n1,a,b\n", encoding="utf-8")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        files.read_delimited(spark, str(folder), ["id", "name"]).collect()
    (folder / "b.csv").write_text("id,other\n1,a\n", encoding="utf-8")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_delimited(spark, str(folder), ["id", "name"]).collect()
    (folder / "b.csv").write_bytes("id,name\n9,Ni\xf1o\n".encode("latin-1"))
    bad = files.read_delimited(spark, str(folder), ["id", "name"]).filter(files.undecodable(["name"]))
    assert rows(bad, "id") == [("9",)]
    assert rows(files.read_delimited(spark, str(folder / "b.csv"), ["id", "name"], encoding="ISO-8859-1"), "name") == [("Niño",)]


def test_row_numbers_survive_file_splits(spark, tmp_path):
    (tmp_path / "big.csv").write_text("id,name\n" + "".join(f"{i},{'x' * 50}\n" for i in range(1, 3001)), encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = files.read_delimited(spark, str(tmp_path / "big.csv"), ["id", "name"])
        assert df.filter(F.col("id").cast("int") != F.col("source_row_number")).count() == 0 and df.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_features_keep_exact_text(spark, tmp_path):
    (tmp_path / "f.geojson").write_text('{"type":"FeatureCollection","features":[\n{"type":"Feature","properties":{"code":"PH1","area":112.2460,"note":"a \\"q\\", b","none":null},"geometry":{"type":"Point","coordinates":[1.50,2]}},\n'
                                        '{"type":"Feature","properties":{"code":"PH2","area":7,"note":"","none":null},"geometry":null}\n]}\n', encoding="utf-8")
    got = rows(files.read_features(spark, str(tmp_path / "f.geojson"), ["code", "area", "note", "none"]), "code", "area", "note", "none", "geometry")
    assert got == [("PH1", "112.2460", 'a "q", b', None, '{"type":"Point","coordinates":[1.50,2]}'), ("PH2", "7", "", None, None)]


def test_schemas_are_approved_not_guessed(table):
    assert contract.match_schema(["a", "b"], {"v1": ["a"], "v2": ["a", "b"]})[0] == "v2"
    with pytest.raises(contract.SchemaRefused):
        contract.match_schema(["b", "a"], {"v2": ["a", "b"]})
    old, new = table([("1",)], "a string"), table([("2", "3")], "a string, z string")
    with pytest.raises(contract.SchemaRefused):
        contract.evolve(old, new, ["a", "b"])
    assert contract.fingerprint(["a", "b"]) != contract.fingerprint(["b", "a"])


def test_row_kinds(table):
    cells = table([("Title", "", "", ""), ("", "", "", ""), ("12", "x", "1", ""), ("", "Region", "", ""), ("", "Odd", "7", "")], "id string, label string, v1 string, v2 string")
    got = [r["source_row_kind"] for r in files.classify_rows(cells, "id", "label", ["v1", "v2"], {"title": F.col("id") == "Title"}).collect()]
    assert got == ["title", "blank", "unit", "banner", "unclassified"]


def test_content_hash_ignores_order_and_sees_repeats(table):
    df = table([("a", 1), ("b", None), ("b", None)], "k string, v int")
    h = lambda d: tuple(publish.content_hash(d).first())
    assert h(df) == h(df.orderBy(F.col("k").desc()).repartition(3)) and h(df) != h(df.distinct()) and h(df) != h(df.fillna(0))


def test_landing_stream_adds_each_row_once(spark, tmp_path):
    landing, target, state = (str(tmp_path / n) for n in ("landing", "bronze", "state"))
    (tmp_path / "landing").mkdir()
    schema = T.StructType([T.StructField("sha", T.StringType()), T.StructField("n", T.LongType()), T.StructField("v", T.StringType())])
    run = lambda: load_landing(spark, landing, schema, target, state, ["sha", "n"])
    (tmp_path / "landing" / "a.csv").write_text("h1,1,x\nh1,2,y\n")
    run()
    run()
    (tmp_path / "landing" / "b.csv").write_text("h1,2,y\nh2,1,z\n")
    run()
    assert rows(spark.read.parquet(target)) == [("h1", 1, "x"), ("h1", 2, "y"), ("h2", 1, "z")]


def test_null_keys_and_lost_rows_are_found(spark, table):
    from placegrid.operators import gates
    from placegrid.sources.publish import content_hash

    rows = table([(1, "a"), (None, "b"), (9, "c"), (9, "d")], "k int, t string")
    parents = table([(1,)], "k int")
    assert gates.foreign_key(rows, "k", parents, "k", "known").first()["actual"] == "3"
    assert gates.foreign_key(rows, "k", parents, "k", "known", nulls_allowed=True).first()["actual"] == "2"
    kept = gates.values_preserved(rows, rows.where("k = 1"), ["t"], {"k": "k"}).first()
    assert (kept["status"], kept["actual"]) == ("FAIL", "3")
    assert gates.left_join_adds_no_rows(rows, table([(9,), (9,), (9,)], "k int"), "k", "k").first()["actual"] == "4"
    same = [content_hash(table([r], "a string, b string")).first()["content_sum"] for r in (("a|b", "c"), ("a", "b|c"), (None, "c"), ("<null>", "c"))]
    assert len(set(same)) == 4


def test_all_failures_are_told(spark, table):
    import pytest

    from placegrid.operators import gates

    checks = table([(f"check_{k:03}", "FAIL", "0", "1") for k in range(150)], "check_name string, status string, expected string, actual string")
    with pytest.raises(gates.GateFailed, match="and 140 more"):
        gates.record_and_raise(checks, named=10)


def test_every_feature_of_a_line_is_read(spark, tmp_path):
    one = '{"type":"Feature","more":{"at":[{"x":"}\\""}]},"properties":{"code":"%s"},"geometry":{"type":"Point","coordinates":[1,2.50]}}'
    last = '{"geometry":{"type":"Point","coordinates":[3,4]},"bbox":[1,2],"properties":{"code":"D"},"type": "Feature"}'
    many = ",".join(one % f"M{k}" for k in range(3000))
    (tmp_path / "f.geojson").write_text("\n".join(['{"type":"FeatureCollection","features":[' + one % "A" + "," + one % "B" + ", " + last + "]}", one % "C" + ",",
                                                   '{"type":"FeatureCollection","features":[' + many + "]}"]))
    found = files.read_features(spark, str(tmp_path / "f.geojson"), ["code"])
    assert rows(found.where("source_row_number < 3"), "source_row_number", "source_feature_number", "code", "geometry") == [
        (1, 1, "A", '{"type":"Point","coordinates":[1,2.50]}'), (1, 2, "B", '{"type":"Point","coordinates":[1,2.50]}'),
        (1, 3, "D", '{"type":"Point","coordinates":[3,4]}'), (2, 1, "C", '{"type":"Point","coordinates":[1,2.50]}')]
    assert found.where("source_row_number = 3").select("code").distinct().count() == 3000


def test_a_feature_over_two_lines_is_refused(spark, tmp_path):
    (tmp_path / "f.geojson").write_text('{"type":"Feature","properties":{},\n"geometry":{"type":"Point","coordinates":[1,2]}}')
    with pytest.raises(Exception, match="features not told apart in line 1"):
        files.read_features(spark, str(tmp_path / "f.geojson"), []).collect()


def test_features_laid_out_freely(spark, tmp_path):
    one = '{"type": "Feature",\n "properties": {"code": "P%d", "note": "a { [ \\" } ,"},\n "geometry": {"type": "GeometryCollection", "geometries": [\n  {"type": "Point", "coordinates": [1, 2.50]}]}\n}'
    text = '{"type": "FeatureCollection",\n"name": "x", "crs": {"type": "name", "properties": {"name": {"deep": "Feature"}}},\n"features":\n[' + ", ".join(one % k for k in range(7)) + ',\n{"type":"Feature","properties":{"code":"Q","note":null},"geometry":null}\n]}\n'
    (tmp_path / "a.geojson").write_text(text)
    (tmp_path / "b.geojson").write_text('{"type":"Feature","properties":{"code":"B","note":"n"},"geometry":{"type":"Point","coordinates":[3,4]}}\n')
    got = rows(files.read_features(spark, str(tmp_path), ["code", "note"]), "code", "note", "geometry", "source_feature_number")
    shape = '{"type": "GeometryCollection", "geometries": [\n  {"type": "Point", "coordinates": [1, 2.50]}]}'
    assert got == [("B", "n", '{"type":"Point","coordinates":[3,4]}', 1), *[(f"P{k}", 'a { [ " } ,', shape, 1) for k in range(7)], ("Q", None, None, 1)]


@pytest.mark.parametrize("line", ['{"type":"Feature","properties":{"a":{"b":2},"code":"X"},"geometry":null}', '{"type":"Feature","properties":{"a":[1],"code":"X"},"geometry":null}'])
def test_nested_properties_are_refused(spark, tmp_path, line):
    (tmp_path / "f.geojson").write_text(line)
    for asked in (["code"], ["a"], []):
        with pytest.raises(Exception, match="nested property in the feature of line 1"):
            files.read_features(spark, str(tmp_path / "f.geojson"), asked).collect()


def test_a_turn_that_begins_with_blanks_is_a_banner(spark, table, tmp_path):
    from placegrid.queries.sources import s03

    table([("c", 2, "assistant", "     and so on")], "conv_id string, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert rows(s03(spark, str(tmp_path)), "source_row_kind") == [("banner",)]


@pytest.mark.parametrize("block", [4, 100_000])
def test_batch_log_is_folded_in_any_grouping(table, block):
    import random

    from placegrid.sources import ingest

    rng = random.Random(1)
    log = [(n, rng.choice("abc"), rng.choice(["start", "start", "load", "succeed", "fail", "block", "rerun", "other", None])) for n in range(400)] + [(401, "d", "load")]
    want = {}
    for _, batch, event in log:
        status, attempts, refused = want.get(batch, ("new", 0, 0))
        to = ingest.BATCH_STEPS.get((status, event))
        want[batch] = (to or status, attempts + (to is not None and event in ("start", "rerun")), refused + (to is None))
    rows_of = lambda some: table(rng.sample(some, len(some)), "event_number long, batch_id string, event string")
    half = ingest.batch_life_cycle(rows_of(log[:150]), block=block)
    for found in (ingest.batch_life_cycle(rows_of(log), block=block), ingest.batch_life_cycle(rows_of(log[150:]), half, block=block)):
        assert {r["batch_id"]: (r["status"], r["attempts"], r["refused"]) for r in found.collect()} == want


def test_succeeded_batches_reconcile(table):
    from placegrid.operators import gates

    stored = table([("f1",), ("f1",), ("f2",), ("f4",), (None,)], "source_sha256 string")
    batches = lambda *r: table(list(r), "source_sha256 string, status string, source_rows int, expected_rows int")
    check = lambda b: tuple(gates.batches_reconcile(stored, b).first())[1:]
    assert check(batches(("f1", "succeeded", 2, 2), ("f2", "failed", 9, 9))) == ("PASS", "0", "0")
    assert check(batches(("f1", "succeeded", 3, 3), ("f2", "succeeded", 1, 2), ("f3", "succeeded", 0, 0), ("f4", "succeeded", 1, None))) == ("FAIL", "0", "4")
