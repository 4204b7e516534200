"""Column expressions, one case per rule."""

import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from placegrid.functions import geo, keys, text


def values(spark, items, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_clean_text(spark):
    assert values(spark, ["  a\t b  c ", " \t", "", None, "x"], text.clean_text) == ["a b c", None, None, None, "x"]


def test_repair_and_placeholder(spark):
    assert values(spark, ["PiÃ±as", "Ñ"], lambda c: text.repair_text(c, [("Ã±", "ñ")])) == ["Piñas", "Ñ"]
    assert values(spark, ["-", "n/a", "x", None], lambda c: text.placeholder_to_null(c, ["-", "n/a"])) == [None, None, "x", None]


def test_labels(spark):
    assert values(spark, ["A", "B", "C", None], lambda c: text.map_label(c, {"A": "one", "B": "two"})) == ["one", "two", None, None]
    assert values(spark, ["A", "C", None], lambda c: text.label_unmapped(c, {"A": 1})) == [False, True, False]
    assert values(spark, ["True", "False", "", None], lambda c: text.map_boolean(c, ["True"], ["False"])) == [True, False, None, None]


def test_strict_casts(spark):
    assert values(spark, ["5", "5.0", "-1", "", "1234567890", "000000005"], text.strict_int) == [5, None, None, None, None, 5]
    assert values(spark, ["5", "5.0", "5.5", "2147483647", "2147483648", "-3"], text.integral_decimal) == [5, 5, None, 2147483647, None, None]
    assert values(spark, ["1e3", "-2.5", ".5", "1e1234", "x", "NaN"], text.strict_double) == [1000.0, -2.5, None, None, None, None]
    assert values(spark, ["1.25", "1.123", "123.4", "x"], lambda c: text.strict_decimal(c, 4, 2)) == [Decimal("1.25"), None, None, None]
    assert values(spark, ["2024-02-29", "2023-02-29", "2024-2-1"], text.strict_date) == [datetime.date(2024, 2, 29), None, None]


def test_codes(spark):
    assert values(spark, ["12345", "123456", "1234", "12a45", None], lambda c: text.pad_code(c, (5, 6))) == ["012345", "123456", None, None, None]
    assert values(spark, ["1906612345", "0712345678", None], lambda c: text.recode_prefix(c, "19066", "09066")) == ["0906612345", "0712345678", None]
    assert values(spark, ["1380601001"], lambda c: text.ancestor_code(c, 5, 10)) == ["1380600000"]


def test_flags(spark):
    assert values(spark, ["x" * 40, "x" * 39, None], lambda c: text.at_length_cap(c, 40)) == [True, False, False]
    df = spark.createDataFrame([(0.0, 0.0), (None, 5.0), (120.0, 10.0), (100.0, 10.0)], "lon double, lat double")
    assert [r[0] for r in df.select(text.coordinate_flag("lon", "lat", (116, 4, 127, 21.5))).collect()] == ["zero", "missing", None, "outside_box"]


def test_sums_keep_missing_apart_from_zero(spark):
    df = spark.createDataFrame([(1, 2), (None, 2), (None, None), (0, 0)], "a int, b int")
    got = [tuple(r) for r in df.select(text.lenient_sum(["a", "b"]), text.strict_sum(["a", "b"]), text.count_status(["a", "b"])).collect()]
    assert got == [(3, 3, "has_learners"), (2, None, "has_learners"), (None, None, "no_counts"), (0, 0, "all_zero")]


def test_label_parse(spark):
    labels = ["REGION II 2/", "TUGUEGARAO CITY (Capital)", "SAN  ISIDRO ( Old One ) (Second)", None]
    assert values(spark, labels, text.footnote) == ["2/", None, None, None]
    assert values(spark, labels, text.is_capital) == [False, True, False, False]
    assert values(spark, labels, text.old_names) == [None, None, "Old One, Second", None]
    assert values(spark, labels, text.bare_name) == ["REGION II", "TUGUEGARAO CITY", "SAN ISIDRO", None]


def test_name_keys(spark):
    df = spark.createDataFrame([("City of  Ozámiz (Capital)",), ("Sta. Ana-Norte (Pob.",), ("Niño's City of Gold",)], "name string")
    got = [tuple(r)[1:] for r in keys.name_keys(df, "name").collect()]
    assert got == [("OZÁMIZ CITY", "OZAMIZ CITY", "OZAMIZ CITY", "OZAMIZ"),
                   ("STA. ANA-NORTE (POB.", "STA ANA NORTE (POB", "STA ANA NORTE", "STA ANA NORTE"),
                   ("NIÑO'S CITY OF GOLD", "NINO S CITY OF GOLD", "NINO S CITY OF GOLD", "NINO S GOLD")]


def test_geometry_flags(spark):
    good = '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}'
    open_ring = '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1]]]}'
    line = '{"type":"MultiPolygon","coordinates":[[[[0,0],[1,1],[2,2],[0,0]]]]}'
    empty = '{"type":"Polygon","coordinates":[]}'
    assert values(spark, [good, open_ring, line, empty, "nonsense", None], lambda c: geo.rings_formed(geo.rings(c))) == [True, False, False, False, False, False]
