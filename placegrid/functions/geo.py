"""GeoJSON shapes with array functions (C-38, and the edges I-12 joins on)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from placegrid.functions.text import _c


def geometry_type(geometry: Column | str) -> Column:
    return F.get_json_object(_c(geometry), "$.type")


def rings(geometry: Column | str) -> Column:
    """Every ring of a Polygon or MultiPolygon as array<array<array<double>>>; NULL when it is neither."""
    g = _c(geometry)
    text = F.get_json_object(g, "$.coordinates")
    polygon = F.from_json(text, "array<array<array<double>>>")
    multi = F.flatten(F.from_json(text, "array<array<array<array<double>>>>"))
    return F.when(geometry_type(g) == "Polygon", polygon).when(geometry_type(g) == "MultiPolygon", multi)


def ring_edges(ring: Column) -> Column:
    """Consecutive point pairs of one ring."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.arrays_zip(F.slice(ring, 1, n).alias("a"), F.slice(ring, 2, n).alias("b"))


def double_area(ring: Column) -> Column:
    """Twice the signed area of a ring."""
    zero = F.lit(0.0)
    return F.aggregate(ring_edges(ring), zero,
                       lambda acc, e: acc + e["a"][0] * e["b"][1] - e["b"][0] * e["a"][1])


def rings_parsed(shape: Column | str) -> Column:
    """At least one ring, and every point has two numbers."""
    s = _c(shape)
    return F.coalesce(
        (F.size(s) > 0) & F.forall(s, lambda r: F.forall(r, lambda p: (F.size(p) >= 2) & F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull())),
        F.lit(False))


def rings_formed(shape: Column | str) -> Column:
    """Parsed, every ring closed, with four points or more and some area; ``operators.validity`` goes on from there."""
    s = _c(shape)
    ok = F.forall(s, lambda r: (F.size(r) >= 4) & (F.element_at(r, 1) == F.element_at(r, -1)) & (double_area(r) != 0))
    return rings_parsed(s) & F.coalesce(ok, F.lit(False))


def edge_rows(df: DataFrame, geometry: str, band_height: float) -> DataFrame:
    """One row per boundary edge and horizontal band it touches: x1, y1, x2, y2, band.

    A shape of any size becomes many small rows, so no task has to carry a whole outline per point.
    """
    edges = (
        df.withColumn("_ring", F.explode(rings(geometry)))
        .withColumn("_edge", F.explode(ring_edges(F.col("_ring"))))
        .drop("_ring", geometry)
        .withColumn("x1", F.col("_edge.a")[0]).withColumn("y1", F.col("_edge.a")[1])
        .withColumn("x2", F.col("_edge.b")[0]).withColumn("y2", F.col("_edge.b")[1])
        .drop("_edge")
    )
    low = F.floor(F.least("y1", "y2") / band_height)
    high = F.floor(F.greatest("y1", "y2") / band_height)
    return edges.withColumn("band", F.explode(F.sequence(low, high)))


def crosses(px: Column, py: Column) -> Column:
    """The eastward ray from the point crosses edge (x1,y1)-(x2,y2)."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    spans = (y1 > py) != (y2 > py)
    return F.coalesce(spans & (px < F.try_divide((x2 - x1) * (py - y1), y2 - y1) + x1), F.lit(False))


def on_edge(px: Column, py: Column) -> Column:
    """The point lies on the edge itself, which does not count as inside."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    straight = (x2 - x1) * (py - y1) == (y2 - y1) * (px - x1)
    return straight & px.between(F.least(x1, x2), F.greatest(x1, x2)) & py.between(F.least(y1, y2), F.greatest(y1, y2))
