"""Circles and polygons on a sphere small enough to be flat in degrees."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scalars import metres_to_degrees


def _edges(ring: Column) -> Column:
    """The edges of a ring of points [x, y], the last one back to the first point; closed rings have an edge of length 0 more."""
    n = F.size(ring)
    return F.transform(ring, lambda p, i: F.struct(p[0].alias("x1"), p[1].alias("y1"), F.get(ring, (i + 1) % n)[0].alias("x2"), F.get(ring, (i + 1) % n)[1].alias("y2")))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a ring: an odd number of edges is crossed to its right."""
    def crossed(e: Column) -> Column:
        return ((e["y1"] > y) != (e["y2"] > y)) & F.coalesce(x < F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"]) + e["x1"], F.lit(False))

    return F.size(F.filter(_edges(ring), crossed)) % 2 == 1


def to_border(x: Column, y: Column, ring: Column) -> Column:
    """The distance from a point to the nearest edge of a ring."""
    def distance(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((x - e["x1"]) * dx + (y - e["y1"]) * dy, dx * dx + dy * dy), F.lit(0.0))))
        return F.hypot(x - e["x1"] - t * dx, y - e["y1"] - t * dy)

    return F.array_min(F.transform(_edges(ring), distance))


def fits(x: Column, y: Column, radius: Column, ring: Column, rule: str = "center") -> Column:
    """Whether a circle fits a rule: center inside, circle within, or circle intersects the ring."""
    center = inside(x, y, ring)
    if rule == "center":
        return center
    return center & (to_border(x, y, ring) >= radius) if rule == "within" else center | (to_border(x, y, ring) <= radius)


def in_any(points: DataFrame, polygons: DataFrame, x: str, y: str, ring: str = "ring") -> DataFrame:
    """Points that lie in the union of polygons, each once; the polygons are a small table, met first by their bounds."""
    xs, ys = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    box = F.broadcast(polygons.select(F.col(ring).alias("_r"), F.array_min(xs).alias("_w"), F.array_max(xs).alias("_e"), F.array_min(ys).alias("_s"), F.array_max(ys).alias("_n")))
    near = F.col(x).between(F.col("_w"), F.col("_e")) & F.col(y).between(F.col("_s"), F.col("_n"))
    return points.join(box, near & inside(F.col(x), F.col(y), F.col("_r")), "left_semi")


def ring_of(points: Sequence[tuple[float, float]]) -> Column:
    return F.array(*(F.array(F.lit(float(a)), F.lit(float(b))) for a, b in points))


def circle_grid(spark: SparkSession, ring: Sequence[tuple[float, float]], radius_m: float, step: float, rule: str = "center") -> DataFrame:
    """(lon, lat) of a grid whose circles fit a rule: center, within or intersects the polygon."""
    xs, ys = zip(*ring, strict=True)
    nx, ny = (max(0, math.ceil((max(v) - min(v)) / step)) for v in (xs, ys))
    grid = spark.range(nx * ny).select((F.lit(min(xs)) + F.col("id") % nx * step).alias("lon"), (F.lit(min(ys)) + F.floor(F.col("id") / nx) * step).alias("lat"))
    grid = grid.withColumn("r", metres_to_degrees(F.lit(float(radius_m)), F.col("lat")))

    return grid.where(fits(F.col("lon"), F.col("lat"), F.col("r"), ring_of(ring), rule)).select("lon", "lat")


def subsampled(circles: DataFrame, large_m: float, small_m: float, samples: int, factor: float = 1.0) -> DataFrame:
    """For each circle (lon, lat) its centre and points around it that lie inside the larger radius."""
    k = 111_132.95
    step = small_m * factor
    rings = F.sequence(F.lit(1), F.lit(max(1, int(large_m // step))))
    turn = F.sequence(F.lit(0), F.lit(samples - 1))
    around = circles.select("*", F.explode(rings).alias("ring")).select("*", F.explode(turn).alias("turn"))
    angle = F.lit(2 * math.pi) * F.col("turn") / samples
    d = F.col("ring") * F.lit(step)
    around = around.select("lon", "lat", (F.col("lon") + d * F.cos(angle) / (F.lit(k) * F.cos(F.radians("lat")))).alias("x"), (F.col("lat") + d * F.sin(angle) / k).alias("y"), d.alias("d"))
    return around.where(F.col("d") <= large_m).select("lon", "lat", "x", "y").union(circles.select("lon", "lat", F.col("lon").alias("x"), F.col("lat").alias("y")))
