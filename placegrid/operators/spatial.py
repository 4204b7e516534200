"""Point-in-boundary status without a spatial engine (I-12)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from placegrid.functions import geo

BAND_HEIGHT = 0.05


def boundary_status(points: DataFrame, shapes: DataFrame, point_key: Sequence[str], place: str = "place_code",
                    shape_id: str = "shape_id", geometry: str = "geometry", lon: str = "longitude",
                    lat: str = "latitude", flag: str = "coordinate_flag", band_height: float = BAND_HEIGHT) -> DataFrame:
    """Adds ``shape_id`` and ``boundary_status``: inside, outside, no_usable_point, no_matched_city, no_boundary.

    Each point is tested only against the shapes of its own place: boundary edges and points meet on
    (place, horizontal band), crossings are added up per point and shape, and an odd number is inside. Holes work
    because the crossings of all rings count together; a point on an edge is outside. Nothing larger than one
    edge is ever joined to a point, and a busy place is spread over its bands.
    """
    px, py = F.col(lon), F.col(lat)
    known = shapes.select(place).distinct().withColumn("_has_shape", F.lit(True))
    edges = geo.edge_rows(shapes.select(place, shape_id, geometry), geometry, band_height)
    usable = (points.filter(F.col(flag).isNull() & F.col(place).isNotNull())
              .select(*point_key, place, lon, lat, F.floor(py / band_height).alias("band")))
    hits = (usable.join(edges, [place, "band"])
            .select(*point_key, shape_id, geo.crosses(px, py).cast("int").alias("_x"), geo.on_edge(px, py).alias("_on"))
            .groupBy(*point_key, shape_id).agg(F.sum("_x").alias("_n"), F.max("_on").alias("_on"))
            .filter((F.col("_n") % 2 == 1) & ~F.col("_on"))
            .groupBy(*point_key).agg(F.min(shape_id).alias(shape_id)))
    out = points.join(hits, list(point_key), "left").join(known, place, "left")
    return out.withColumn(
        "boundary_status",
        F.when(F.col(flag).isNotNull(), "no_usable_point").when(F.col(place).isNull(), "no_matched_city")
        .when(F.col("_has_shape").isNull(), "no_boundary").when(F.col(shape_id).isNotNull(), "inside")
        .otherwise("outside")).drop("_has_shape")


def nearby(points: DataFrame, centers: DataFrame, center_key: str, distance: float, lon: str = "longitude",
           lat: str = "latitude") -> DataFrame:
    """D-26: points within ``distance`` degrees of a center in both directions.

    Centers offer the nine grid cells around them; points join on their own cell, then the exact test applies.
    """
    cell = lambda c: F.floor(F.col(c) / distance)
    around = F.sequence(F.lit(-1), F.lit(1))
    c = (centers.select(F.col(center_key).alias("_center"), F.col(lon).alias("_clon"), F.col(lat).alias("_clat"),
                        cell(lon).alias("_x"), cell(lat).alias("_y"))
         .withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
         .select("_center", "_clon", "_clat", (F.col("_x") + F.col("_dx")).alias("_x"), (F.col("_y") + F.col("_dy")).alias("_y")))
    near = (F.abs(F.col(lat) - F.col("_clat")) <= distance) & (F.abs(F.col(lon) - F.col("_clon")) <= distance)
    return (points.withColumn("_x", cell(lon)).withColumn("_y", cell(lat)).join(c, ["_x", "_y"]).filter(near)
            .withColumnRenamed("_center", f"near_{center_key}").drop("_x", "_y", "_clon", "_clat"))
