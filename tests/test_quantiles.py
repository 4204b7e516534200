"""Radix select against sorting, for every kind of value and group."""

import datetime
import decimal
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from placegrid.operators import quantiles

PLAN = {"q1": 0.25, "m": 0.5, "q3": 0.75}


def _want(values):
    values = sorted(values)
    out = []
    for p in PLAN.values():
        h = p * (len(values) - 1)
        low, high = values[math.floor(h)], values[math.ceil(h)]
        out.append(low + (h - math.floor(h)) * (high - low))
    return out


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(3)
    return {"hot": [rng.choice([1.0, 2.0, rng.random() * 9]) for _ in range(700)], "small": [3.0, 1.0, 2.0, 10.0], "one": [4.5], "flat": [2.0] * 60,
            None: [rng.gauss(0, 1e9) for _ in range(900)], "signs": [-1e-300, 1e-300, 0.0, -0.0, 5e-324, -5e-324, 2.0 ** 1023, -(2.0 ** 1023), 1.0]}


@pytest.mark.parametrize("kind", ["double", "float", "long", "decimal(12,2)"])
def test_quantiles_of_groups(spark, groups, kind):
    data = [(g, v) for g, vs in groups.items() for v in vs if kind in ("double",) or abs(v) < 1e9]
    df = spark.createDataFrame(data + [("hot", None)], "g string, v double").select("g", F.col("v").try_cast(kind).alias("v"))
    values = {}
    for r in df.collect():
        if r["v"] is not None:
            values.setdefault(r["g"], []).append(float(r["v"]))
    got = {r["g"]: r for r in quantiles.exact_quantiles(df, ["g"], "v", PLAN).collect()}
    assert set(got) == set(values)
    for g, vs in values.items():
        assert got[g]["n"] == len(vs)
        assert [float(got[g][name]) for name in PLAN] == pytest.approx(_want(vs), abs=0, rel=1e-12)
        if kind == "double" and g == "hot":
            assert [got[g][name] for name in PLAN] == pytest.approx(statistics.quantiles(vs, n=4, method="inclusive"))


def test_without_groups_and_with_several(spark, groups):
    data = [(g, k % 2 if k % 7 else None, v) for g, vs in groups.items() for k, v in enumerate(vs)]
    df = spark.createDataFrame(data, "n string, _v int, q double")  # names that clash with those inside
    whole, = quantiles.exact_quantiles(df, [], "q", PLAN).collect()
    assert whole["n"] == len(data) and [whole[name] for name in PLAN] == pytest.approx(_want([v for *_, v in data]))
    two = quantiles.exact_quantiles(df.withColumnRenamed("n", "g"), ["g", "_v"], "q", PLAN).collect()
    values = {}
    for g, k, v in data:
        values.setdefault((g, k), []).append(v)
    assert {(r["g"], r["_v"]) for r in two} == set(values)
    assert all([r[name] for name in PLAN] == pytest.approx(_want(values[r["g"], r["_v"]])) for r in two)
    assert quantiles.exact_quantiles(df.where("q IS NULL"), ["_v"], "q", PLAN).collect() == []
    assert quantiles.exact_quantiles(df.where("q IS NULL"), [], "q", PLAN).collect() == []


def test_keys_are_in_the_order_of_the_values(spark):
    rng = random.Random(4)
    doubles = [rng.uniform(-1, 1) * 10.0 ** rng.randint(-320, 308) for _ in range(3000)]
    doubles += [s * m * 2.0 ** e for e in range(-1074, 1024, 3) for s in (1, -1) for m in (1.0, 1 - 2 ** -53)] + [0.0, -0.0, math.inf, -math.inf, math.nan]
    from pyspark.sql import types as T

    got = spark.createDataFrame([(v,) for v in doubles], "v double").select("v", quantiles.order_key(F.col("v"), T.DoubleType()).alias("k")).collect()
    ordered = sorted(got, key=lambda r: (math.isnan(r["v"]), r["v"] if not math.isnan(r["v"]) else 0))
    for a, b in zip(ordered, ordered[1:]):
        assert (a["k"] < b["k"]) == (a["v"] != b["v"]) and a["k"] <= b["k"]


def test_refused_kinds(spark):
    df = spark.createDataFrame([(datetime.date(2020, 1, 1), decimal.Decimal(1), "x")], "d date, c decimal(20,0), s string")
    for wrong in ("d", "c", "s"):
        with pytest.raises(ValueError):
            quantiles.exact_quantiles(df, [], wrong, {"m": 0.5})


def test_rounds_do_not_depend_on_the_number_of_rows(spark, monkeypatch):
    written = []
    plain = quantiles.materialize
    monkeypatch.setattr(quantiles, "materialize", lambda df: written.append(1) or plain(df))
    for rows in (10, 20_000):
        written.clear()
        quantiles.exact_quantiles(spark.range(rows).selectExpr("id % 10 + 1000000 AS v"), [], "v", {"m": 0.5})
        assert len(written) == 2  # the counted values, and one round for keys that are less than 65,536 apart
