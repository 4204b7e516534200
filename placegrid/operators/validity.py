"""Validity of Polygon and MultiPolygon shapes: rings that cross, touch themselves, overlap or lie outside (C-38).

Edges meet on (shape, band), so a shape of any size is many small rows and no task compares all edges of a shape. The
longer side of a shape is cut into bands, as many as keep the rows of its edges within about twice their number. A pair
of edges is tested once, in the first band that both reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from placegrid.functions import geo
from placegrid.session import materialize

_EDGE = "polygon int, ring int, edge int, edges int, x1 double, y1 double, x2 double, y2 double"


def polygons(geometry: Column | str) -> Column:
    """array<polygon>, a polygon being its rings, the shell first; NULL when the geometry is neither Polygon nor MultiPolygon."""
    text = F.get_json_object(geometry, "$.coordinates")
    one = F.array(F.from_json(text, "array<array<array<double>>>"))
    return F.when(geo.geometry_type(geometry) == "Polygon", one).when(
        geo.geometry_type(geometry) == "MultiPolygon", F.from_json(text, "array<array<array<array<double>>>>"))


def _edge_array(shape: Column) -> Column:
    """All edges of a shape with their polygon, ring and place in it; points given twice in a row make no edge."""
    def of_ring(ring: Column, p: Column, r: Column) -> Column:
        apart = F.filter(ring, lambda point, k: (k == 0) | (point != F.get(ring, k - 1)))
        return F.transform(geo.ring_edges(apart), lambda e, k: F.struct(
            p.alias("polygon"), r.alias("ring"), k.alias("edge"), (F.size(apart) - 1).alias("edges"), e["a"][0].alias("x1"), e["a"][1].alias("y1"),
            e["b"][0].alias("x2"), e["b"][1].alias("y2")).cast(f"struct<{_EDGE.replace(' ', ':').replace(',:', ',')}>"))

    return F.flatten(F.transform(shape, lambda rings, p: F.flatten(F.transform(rings, lambda ring, r: of_ring(ring, p, r)))))


def banded_edges(shapes: DataFrame, key: str, geometry: str, per_band: int = 4) -> DataFrame:
    """One row per edge and band it reaches; ``geometry`` is text or parsed by ``polygons``. Columns: key, number in the shape, ring and place, end points, first and last band.

    x and y are exchanged for shapes that are wider than high, which no test here minds.
    """
    parsed = F.col(geometry) if isinstance(shapes.schema[geometry].dataType, T.ArrayType) else polygons(geometry)
    reach = lambda pick, a, b: F.transform("_edges", lambda e: pick(e[a], e[b]))
    side = lambda a, b: F.array_max(reach(F.greatest, a, b)) - F.array_min(reach(F.least, a, b))
    # written, so that the edges are made once: filters below would be pushed to the shapes and make them again for each use
    rows = materialize(shapes.select(key, _edge_array(parsed).alias("_edges")))
    rows = rows.withColumn("_edges", F.when(side("x1", "x2") > side("y1", "y2"), F.transform("_edges", lambda e: F.struct(
        e["polygon"].alias("polygon"), e["ring"].alias("ring"), e["edge"].alias("edge"), e["edges"].alias("edges"),
        e["y1"].alias("x1"), e["x1"].alias("y1"), e["y2"].alias("x2"), e["x2"].alias("y2")))).otherwise(F.col("_edges")))
    rise = F.aggregate("_edges", F.lit(0.0), lambda total, e: total + F.abs(e["y2"] - e["y1"]))
    rows = rows.withColumns({"_base": F.array_min(reach(F.least, "y1", "y2")), "_high": side("y1", "y2"), "_rise": rise})
    many = F.size("_edges")
    bands = F.greatest(F.lit(1.0), F.floor(F.least(many / F.lit(per_band), many * F.col("_high") / F.col("_rise"))))
    rows = rows.withColumn("_band_high", F.col("_high") / bands).select(key, "_base", "_band_high", F.posexplode(F.when(F.col("_high") > 0, F.col("_edges"))).alias("number", "_edge"))
    edges = rows.select(key, "number", "_base", "_band_high", "_edge.*")
    at = lambda y: F.floor((y - F.col("_base")) / F.col("_band_high")).cast("int")
    edges = edges.withColumn("low", at(F.least("y1", "y2"))).withColumn("high", at(F.greatest("y1", "y2")))
    return edges.withColumn("band", F.explode(F.sequence("low", "high")))


def _side(a: str, b: str, x: Column, y: Column) -> Column:
    """Which side of edge ``a`` the point lies on: above zero to the left, zero on its line."""
    return (F.col(f"{a}.x2") - F.col(f"{a}.x1")) * (y - F.col(f"{a}.y1")) - (F.col(f"{a}.y2") - F.col(f"{a}.y1")) * (x - F.col(f"{a}.x1"))


def _between(a: str, x: Column, y: Column) -> Column:
    return (x.between(F.least(f"{a}.x1", f"{a}.x2"), F.greatest(f"{a}.x1", f"{a}.x2")) & y.between(F.least(f"{a}.y1", f"{a}.y2"), F.greatest(f"{a}.y1", f"{a}.y2")))


def meeting_edges(edges: DataFrame, key: str) -> DataFrame:
    """Pairs of edges of a shape that have a point in common: how they meet and, where they only touch, the point."""
    a, b = edges.alias("a"), edges.alias("b")
    column = lambda side, name: F.col(f"{side}.{name}")
    near = (column("a", key) == column("b", key)) & (column("a", "band") == column("b", "band"))
    once = (column("a", "number") < column("b", "number")) & (column("a", "band") == F.greatest("a.low", "b.low"))
    beside = F.greatest("a.x1", "a.x2") >= F.least("b.x1", "b.x2")
    beside = beside & (F.greatest("b.x1", "b.x2") >= F.least("a.x1", "a.x2"))
    ends = {"b1": ("a", column("b", "x1"), column("b", "y1")), "b2": ("a", column("b", "x2"), column("b", "y2")),
            "a1": ("b", column("a", "x1"), column("a", "y1")), "a2": ("b", column("a", "x2"), column("a", "y2"))}
    sides = {name: F.signum(_side(other, name[0], x, y)) for name, (other, x, y) in ends.items()}
    crossing = (sides["b1"] * sides["b2"] < 0) & (sides["a1"] * sides["a2"] < 0)
    on = {name: (sides[name] == 0) & _between(other, x, y) for name, (other, x, y) in ends.items()}
    line = (sides["a1"] == 0) & (sides["a2"] == 0) & (sides["b1"] == 0) & (sides["b2"] == 0)
    shared = lambda c: F.least(F.greatest(f"a.{c}1", f"a.{c}2"), F.greatest(f"b.{c}1", f"b.{c}2")) - F.greatest(F.least(f"a.{c}1", f"a.{c}2"), F.least(f"b.{c}1", f"b.{c}2"))
    touch = F.coalesce(*[F.when(on[name], F.struct(x.alias("x"), y.alias("y"))) for name, (_, x, y) in ends.items()])
    same = (column("a", "polygon") == column("b", "polygon")) & (column("a", "ring") == column("b", "ring"))
    gap = F.abs(column("a", "edge") - column("b", "edge"))
    return (a.join(b, near & once & beside)
            .select(column("a", key).alias(key), column("a", "polygon").alias("polygon"), column("a", "ring").alias("ring"),
                    column("b", "polygon").alias("other_polygon"), column("b", "ring").alias("other_ring"), same.alias("same_ring"),
                    (same & ((gap == 1) | (gap == column("a", "edges") - 1))).alias("neighbours"), crossing.alias("crossing"),
                    (line & ((shared("x") > 0) | (shared("y") > 0))).alias("overlapping"), touch.alias("touch"))
            .where(F.col("crossing") | F.col("overlapping") | F.col("touch").isNotNull()))


def misplaced_corners(edges: DataFrame, key: str) -> DataFrame:
    """key of shapes with a hole that leaves its shell or lies in another hole, or a polygon inside another one.

    Every corner meets the edges of the other rings of its shape in its band, and counts how many are to its right.
    """
    rings = edges.groupBy(key).agg(F.max("polygon").alias("_p"), F.max("ring").alias("_r")).where("_p > 0 OR _r > 0").select(key)
    several = edges.join(rings, key, "left_semi")
    corners = several.where(F.col("band") == F.floor((F.col("y1") - F.col("_base")) / F.col("_band_high")).cast("int")).select(
        key, F.col("number").alias("_corner"), F.col("polygon").alias("_polygon"), F.col("ring").alias("_ring"), F.col("x1").alias("_x"), F.col("y1").alias("_y"), "band")
    other = (F.col("polygon") != F.col("_polygon")) | (F.col("ring") != F.col("_ring"))
    met = corners.join(several.select(key, "band", "polygon", "ring", "x1", "y1", "x2", "y2"), [key, "band"]).where(other)
    met = met.select(key, "_corner", "_polygon", "_ring", "polygon", "ring", geo.crosses(F.col("_x"), F.col("_y")).cast("int").alias("_n"),
                     F.coalesce(geo.on_edge(F.col("_x"), F.col("_y")), F.lit(False)).alias("_on"))
    per_ring = met.groupBy(key, "_corner", "_polygon", "_ring", "polygon", "ring").agg(F.sum("_n").alias("_n"), F.max("_on").alias("_on"))
    own, odd = F.col("polygon") == F.col("_polygon"), F.col("_n") % 2 == 1
    per_corner = per_ring.groupBy(key, "_corner", "_ring", own.alias("_own"), F.when(~own, F.col("polygon")).alias("_other")).agg(
        F.sum("_n").alias("_n"), F.max("_on").alias("_on"), F.max(own & (F.col("ring") == 0) & (odd | F.col("_on"))).alias("_held"),
        F.max(own & (F.col("ring") > 0) & odd & ~F.col("_on")).alias("_in_hole"))
    wrong = (F.col("_own") & F.col("_in_hole")) | (~F.col("_own") & (F.col("_n") % 2 == 1) & ~F.col("_on"))
    held = per_corner.where(F.col("_own") & F.col("_held")).select(key, "_corner")
    loose = corners.where("_ring > 0").join(held, [key, "_corner"], "left_anti").select(key)
    return per_corner.where(wrong).select(key).unionByName(loose).distinct()


def with_validity(df: DataFrame, geometry: str, name: str) -> DataFrame:
    """Adds whether each geometry is a valid Polygon or MultiPolygon; false when it is missing or neither.

    Valid: every ring is closed with four points or more and some area, meets itself nowhere but at following corners,
    and does not turn back on itself; rings cross and overlap no other ring, and two rings of a polygon touch at one
    point at most; holes lie in their shell and not in each other; no polygon lies in another one. A chain of several
    holes that touch one another and cut a polygon in two is not told.
    """
    rows = materialize(df.withColumn("_shape_row", F.monotonically_increasing_id()).withColumn("_polygons", polygons(geometry)))
    formed = rows.where(geo.rings_formed(F.flatten("_polygons"))).select("_shape_row", "_polygons")
    edges = materialize(banded_edges(formed, "_shape_row", "_polygons"))
    met = meeting_edges(edges, "_shape_row")
    met = met.where(~F.col("neighbours") | F.col("overlapping"))
    wrong = F.col("crossing") | F.col("overlapping") | F.col("same_ring")
    pair = ["_shape_row", "polygon", "ring", "other_polygon", "other_ring"]
    met = met.groupBy(*pair).agg(F.max(wrong).alias("_wrong"), F.min("touch").alias("_first"), F.max("touch").alias("_last"))
    twice = (F.col("polygon") == F.col("other_polygon")) & (F.col("_first") != F.col("_last"))
    bad = met.where(F.col("_wrong") | twice).select("_shape_row").unionByName(misplaced_corners(edges, "_shape_row")).distinct()
    good = formed.select("_shape_row").join(bad, "_shape_row", "left_anti").withColumn(name, F.lit(True))
    return rows.drop("_polygons").join(good, "_shape_row", "left").withColumn(name, F.coalesce(name, F.lit(False))).drop("_shape_row")
