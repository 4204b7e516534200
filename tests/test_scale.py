"""Pieces and whole must agree: every split path against a plain window or a brute-force answer."""

import random

import pytest
from pyspark.sql import Window, functions as F

from helpers import rows
from placegrid.operators import hierarchy, scale


@pytest.fixture(scope="module")
def numbered(spark):
    rng = random.Random(7)
    data = [("hot" if i % 3 else f"k{i % 5}", i, rng.choice([None, rng.randint(-5, 50)])) for i in range(1, 900)]
    return spark.createDataFrame(data, "g string, pos long, v int")


@pytest.mark.parametrize("block", [7, 100_000])
def test_running_sum(numbered, block):
    w = Window.partitionBy("g").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    want = numbered.withColumn("s", F.coalesce(F.sum("v").over(w), F.lit(0)))
    assert rows(scale.running_sum(numbered, ["g"], "pos", {"s": "v"}, block)) == rows(want)


@pytest.mark.parametrize("block", [7, 100_000])
def test_carry_forward(numbered, block):
    w = Window.partitionBy("g").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    big = F.when(F.col("v") > 45, F.col("v"))
    want = numbered.withColumn("c", F.last(big, ignorenulls=True).over(w))
    assert rows(scale.carry_forward(numbered, ["g"], "pos", big, "c", block)) == rows(want)


@pytest.mark.parametrize("limit", [50, 100_000])
def test_position(numbered, monkeypatch, limit):
    monkeypatch.setattr(scale, "ONE_TASK_ROWS", limit)
    order = [F.col("v").desc_nulls_last(), F.col("pos").asc()]
    for by in ([], ["g"]):
        w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*order)
        assert rows(scale.position_in_order(numbered, order, "p", by)) == rows(numbered.withColumn("p", F.row_number().over(w)))


def test_ties_are_kept(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), (None, 1, "n")], "k string, t int, v string")
    assert rows(scale.tie_ranked_first(df, ["k"], "t"), "v") == [("n",), ("y",), ("z",)]


def census(spark, seed=5):
    """Country > 3 regions > 2 provinces > cities, plus cities directly under a region; 12 measures per place."""
    rng = random.Random(seed)
    shape = ("C", [("R1", [("P1", ["a", "b", "c"]), ("P2", ["d", "e"])]), ("R2", ["f"]), ("R3", ["g", "h"])])
    out = []

    def visit(node):
        name, children = node if isinstance(node, tuple) else (node, [])
        at = len(out)
        out.append([name, None, bool(children)])
        if children:
            parts = [visit(c) for c in children]
            counts = [sum(p[i] for p in parts) for i in range(12)]
        else:
            counts = [rng.randint(1, 500) for _ in range(12)]
        out[at][1] = counts
        return counts

    visit(shape)
    data = [("s", i, name, *counts) for i, (name, counts, _) in enumerate(out, 1)]
    return spark.createDataFrame(data, "sheet string, pos long, name string, " + ", ".join(f"m{i} long" for i in range(12)))


@pytest.mark.parametrize("block", [3, 100_000])
def test_tree_from_sums(spark, block):
    places = census(spark)
    spans = hierarchy.close_spans(hierarchy.spans_from_sums(places, ["sheet"], "pos", [f"m{i}" for i in range(12)], block=block), ["sheet"])
    assert rows(spans, "start_pos", "end_pos") == sorted([(1, 14), (2, 9), (3, 6), (7, 9), (10, 11), (12, 14)], key=lambda r: tuple(map(str, r)))
    tree = hierarchy.tree_from_spans(places.select("sheet", "pos", "name"), spans, ["sheet"], "pos", "name", block=block)
    got = {r["name"]: (r["level"], r["parent_name"], r["region_name"], r["province_name"]) for r in tree.collect()}
    assert got["C"] == ("country", None, None, None)
    assert got["R2"] == ("region", "C", "R2", None)
    assert got["P2"] == ("province", "R1", "R1", "P2")
    assert got["e"] == ("city_municipality", "P2", "R1", "P2")
    assert got["h"] == ("city_municipality", "R3", "R3", None)


def _plain_spans(values):
    """Pass by pass: the last j with running(j) = running(i) + value(i); what lies inside a span counts no more."""
    covered, done, out = set(), {}, {}
    while True:
        running, total = [], [0] * len(values[0])
        for k, v in enumerate(values):
            if k not in covered:
                total = [a + b for a, b in zip(total, v)]
            running.append(total)
        found = {}
        for k, v in enumerate(values):
            if k not in covered and k not in done:
                goal = [a + b for a, b in zip(running[k], v)]
                ends = [j for j in range(k + 1, len(values)) if running[j] == goal]
                if ends:
                    found[k] = max(ends)
        if not found:
            return {(k + 1, j + 1) for k, j in out.items()}
        done.update(found), out.update(found)
        covered.update(p for k, j in found.items() for p in range(k + 1, j + 1))


def _forest(rng, depth):
    """Values of a random list in publication order, down to ``depth`` levels, single children and zeros among them."""
    if depth == 0 or rng.random() < 0.15:
        return [[rng.choice([0, rng.randint(1, 9)]), rng.randint(1, 99)]]
    children = [_forest(rng, depth - 1) for _ in range(rng.choice([1, 2, 2, 3]))]
    return [[sum(c[0][k] for c in children) for k in range(2)]] + [v for c in children for v in c]


@pytest.mark.parametrize("block", [3, 100_000])
def test_spans_of_deep_lists(spark, block):
    rng = random.Random(2)
    lists = {"deep": [[7, 7]] * 13, "a": _forest(rng, 4), "b": _forest(rng, 5) + [[3, 4], [0, 5]], "c": [[5, 1], [0, 0], [0, 0], [2, 2]], "one": [[1, 1]]}
    nested, total = [], [0, 0]
    for k in range(12):  # every level holds one leaf and the next level
        total = [total[0] + k + 1, total[1] + 2]
        nested = [list(total), [k + 1, 2], *nested]
    lists["twelve"] = nested
    data = [(s, k, *v) for s, vs in lists.items() for k, v in enumerate(vs, 1)]
    places = spark.createDataFrame(data, "sheet string, pos long, x long, y long")
    got = hierarchy.spans_from_sums(places, ["sheet"], "pos", ["x", "y"], block).collect()
    for s, vs in lists.items():
        assert {(r["start_pos"], r["end_pos"]) for r in got if r["sheet"] == s} == _plain_spans(vs), s
    assert max(r["found_in_pass"] for r in got) >= 3
    spans = hierarchy.close_spans(hierarchy.spans_from_sums(places.where("sheet = 'twelve'"), ["sheet"], "pos", ["x", "y"], block), ["sheet"])
    tree = hierarchy.tree_from_spans(places.selectExpr("*", "'n' || pos AS name").where("sheet = 'twelve'"), spans, ["sheet"], "pos", "name", block).collect()
    assert max(r["depth"] for r in tree) >= 11
    around = {r["pos"]: sorted(s["start_pos"] for s in spans.collect() if s["start_pos"] < r["pos"] <= s["end_pos"]) for r in tree}
    assert all(r["depth"] == len(around[r["pos"]]) and r["parent_pos"] == (around[r["pos"]] or [None])[-1] for r in tree)
    assert all(r["region_name"] == (f"n{around[r['pos']][1]}" if r["depth"] > 1 else r["name"] if r["depth"] == 1 and r["is_aggregate"] else None) for r in tree)


def test_long_chain_of_spans_closes(spark):
    """Each span ends where the next one starts: more links than a few fixed rounds could follow."""
    chain = spark.createDataFrame([("s", i, i + 1) for i in range(1, 41)], "sheet string, start_pos long, end_pos long")
    assert {r["end_pos"] for r in hierarchy.close_spans(chain, ["sheet"]).collect()} == {41}


def test_parents_of_a_deep_tree(spark):
    places = spark.createDataFrame([("s", i, f"n{i}") for i in range(1, 9)], "sheet string, pos long, name string")
    spans = spark.createDataFrame([("s", i, 8) for i in range(1, 8)], "sheet string, start_pos long, end_pos long")
    got = {r["pos"]: r["parent_pos"] for r in hierarchy.tree_from_spans(places, spans, ["sheet"], "pos", "name", block=3).collect()}
    assert got == {1: None} | {i: i - 1 for i in range(2, 9)}


@pytest.mark.parametrize("block", [2, 100_000])
def test_banners_and_sections_go_over_blocks(numbered, block):
    from placegrid.operators import reshape

    w = Window.partitionBy("g").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.coalesce(F.col("v") > 40, F.lit(False))
    label = F.when(starts, F.col("pos").cast("string"))
    texts = numbered.withColumn("label", F.col("pos").cast("string"))
    want = numbered.withColumn("banner", F.last(label, ignorenulls=True).over(w))
    assert rows(reshape.carry_banner(texts, ["g"], "pos", starts, "label", "banner", block), "g", "pos", "banner") == rows(want, "g", "pos", "banner")
    got = reshape.sections_with_head(numbered, ["g"], "pos", starts, {"head": "pos"}, block)
    want = want.withColumn("section", F.coalesce(F.sum(starts.cast("int")).over(w), F.lit(0))).withColumn("head", F.col("banner").cast("bigint"))
    assert rows(got, "g", "pos", "section", "head") == rows(want, "g", "pos", "section", "head")
