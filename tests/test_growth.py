"""Shared steps whose work must grow no faster than their input."""

import random

from pyspark.sql import functions as F

from placegrid.operators import matching, validity
from placegrid.queries import star
from placegrid.sources import files

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_summed_per_order_once(spark):
    for build in (star.wide_cells, star.rooms, star.teachers):
        read = build(spark, SF).inputFiles()
        assert read and not any("lineitem" in name for name in read)


def test_same_names_give_what_compared_pairs_give(spark):
    rng = random.Random(3)
    pick = lambda most: rng.choice([None, *[f"n{k}" for k in range(most)]])
    records = spark.createDataFrame([(k, pick(40), pick(5), pick(6)) for k in range(200)], "id long, direct string, older string, name string")
    units = spark.createDataFrame([(f"n{k}", pick(5), pick(6)) for k in range(60)], "code string, older string, name string")
    rules = [("code", F.col("direct"), "code"), ("older", F.col("older"), "older")]
    pairs = matching.first_code_rule(records, ["id"], units, "code", rules, F.col("l.name") == F.col("u.name"), ["name"])
    equal = matching.first_code_rule(records, ["id"], units, "code", rules, same_names=["name"])
    assert equal.columns == pairs.columns and sorted(map(str, equal.collect())) == sorted(map(str, pairs.collect())) and pairs.where("hits > 1").count() > 5


def test_shapes_are_parsed_once(spark):
    square = '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}'
    flat = '{"type":"Polygon","coordinates":[[[0,0],[1,0],[2,0],[0,0]]]}'
    edges = validity.banded_edges(spark.createDataFrame([(1, square), (2, flat), (3, None)], "id long, geometry string"), "id", "geometry")
    assert "from_json" not in _plan(edges) and {r.id for r in edges.collect()} == {1, 2}


def test_lines_of_a_delivery_are_matched_once(spark, tmp_path):
    feature = '{"type":"Feature","properties":{"code":"%d"},"geometry":{"type":"Point","coordinates":[%d,1]}}'
    (tmp_path / "a.geojson").write_text("\n".join(feature % (k, k) for k in range(3)))
    (tmp_path / "b.geojson").write_text('{"type":"FeatureCollection","features":[\n' + ",\n".join((feature % (k, k)).replace(",", ",\n", 1) for k in range(3, 6)) + "\n]}")
    found = files.read_features(spark, str(tmp_path), ["code"])
    assert "regexp_extract_all(value" not in _plan(found) and sorted(r.code for r in found.collect()) == [str(k) for k in range(6)]
