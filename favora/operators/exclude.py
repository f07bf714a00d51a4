"""Exclusion areas, buffers and overlays of polygons on grids.

Polygons are edge tables (gid, x0, y0, x1, y1); containment is strict, points on an edge are outside.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from favora.functions.geometry import clip_ring, closed, ring_area, segment_distance
from favora.operators.distance import inside
from favora.operators.near import within_candidates

_SEGMENT = ("x", "y", "x0", "y0", "x1", "y1")


def mask_exclusion_areas(points: DataFrame, edges: DataFrame, column: str, keys: Sequence[str], set_to: float | str = 0) -> DataFrame:
    """`points` with `column` set inside any area; an absent column is NULL elsewhere."""
    if column not in points.columns:
        points = points.withColumn(column, F.lit(None).cast("double"))
    hit = inside(points, edges, list(keys)).select(*keys).distinct().withColumn("_in", F.lit(True))
    return points.join(hit, list(keys), "left").withColumn(column, F.when(F.col("_in"), F.lit(float(set_to))).otherwise(F.col(column))).drop("_in")


def add_exclusions(model: DataFrame, layers: Sequence[tuple[DataFrame, float]], keys: Sequence[str], column: str = "favorability") -> DataFrame:
    """`model` with pr_excl: `column` after all exclusion layers (edges, set_to) in order; ValueError without a model."""
    if model is None:
        raise ValueError("exclusions need a model")
    out = model.withColumn("pr_excl", F.col(column))
    for edges, set_to in layers:
        out = mask_exclusion_areas(out, edges, "pr_excl", keys, set_to)
    return out


def near_polygons(points: DataFrame, edges: DataFrame, keys: Sequence[str], distance: float) -> DataFrame:
    """(keys, polygon) of points inside polygons or closer than `distance` to them."""
    near = within_candidates(points.select(*dict.fromkeys([*keys, "x", "y"])), edges.select(F.col("gid").alias("polygon"), "x0", "y0", "x1", "y1"), distance)
    within = inside(points, edges, list(keys))
    if near is None:
        return within
    close = near.where(segment_distance(*(F.col(c) for c in _SEGMENT)) < distance).select(*keys, "polygon")
    return close.union(within).distinct()


def buffer_distance(points: DataFrame, edges: DataFrame, column: str, keys: Sequence[str], distance: float, set_to: float = 0.0) -> DataFrame:
    """`points` with `column` set inside the exact buffer of any area."""
    hit = near_polygons(points, edges, keys, distance).select(*keys).distinct().withColumn("_in", F.lit(True))
    return points.join(hit, list(keys), "left").withColumn(column, F.when(F.col("_in"), F.lit(float(set_to))).otherwise(F.col(column))).drop("_in")


def classify_points(points: DataFrame, edges: DataFrame, keys: Sequence[str], distance: float, polygon_value: float, buffer_value: float) -> DataFrame:
    """`points` with `classification`: by the first polygon (in order of gid) that holds the point or has it in its buffer, else 1."""
    within = inside(points, edges, list(keys)).withColumn("c", F.lit(float(polygon_value)))
    close = near_polygons(points, edges, keys, distance).join(within.select(*keys, "polygon"), [*keys, "polygon"], "left_anti").withColumn("c", F.lit(float(buffer_value)))
    first = within.unionByName(close).groupBy(*keys).agg(F.min_by("c", "polygon").alias("classification"))
    return points.join(first, list(keys), "left").withColumn("classification", F.coalesce("classification", F.lit(1.0)))


def mark_buffer_areas(grid: DataFrame, edges: DataFrame, distance: float, polygon_value: float = 0.0, buffer_value: float = 0.5, background: float = 1.0) -> DataFrame:
    """`grid` with `classification`: inside a polygon, else in a buffer, else background."""
    keys = ["ix", "iy"]
    within = inside(grid, edges, keys).select(*keys).distinct().withColumn("_in", F.lit(True))
    close = near_polygons(grid, edges, keys, distance).select(*keys).distinct().withColumn("_near", F.lit(True))
    out = grid.join(within, keys, "left").join(close, keys, "left")
    value = F.when(F.col("_in"), F.lit(float(polygon_value))).when(F.col("_near"), F.lit(float(buffer_value))).otherwise(F.lit(float(background)))
    return out.withColumn("classification", value).drop("_in", "_near")


def polygons_to_points(cells: DataFrame, polygons: DataFrame, width: float, height: float) -> DataFrame:
    """`cells` (centres ix, iy, x, y of boxes width by height) with `value`, the area-weighted mean of the polygons' values.

    `polygons` has gid, value and rings (ARRAY<ARRAY<STRUCT<x, y>>>, the first the shell, others holes).  Cells without any
    polygon have 0.
    """
    flat = F.flatten("rings")
    xs, ys = F.transform(flat, lambda v: v["x"]), F.transform(flat, lambda v: v["y"])
    boxed = polygons.withColumns({"xmin": F.array_min(xs) - width / 2, "ymin": F.array_min(ys) - height / 2, "xmax": F.array_max(xs) + width / 2, "ymax": F.array_max(ys) + height / 2})
    near = within_candidates(cells, boxed, 0.0)
    if near is None:
        return cells.withColumn("value", F.lit(0.0))
    near = near.where("x > xmin and x < xmax and y > ymin and y < ymax")
    box = (F.col("x") - width / 2, F.col("y") - height / 2, F.col("x") + width / 2, F.col("y") + height / 2)
    areas = F.transform("rings", lambda r: F.abs(ring_area(closed(clip_ring(r, *box)))))
    # The first ring is the shell, the others are holes.
    size = F.coalesce(F.get(areas, F.lit(0)) * 2 - F.aggregate(areas, F.lit(0.0), lambda s, a: s + a), F.lit(0.0))
    parts = near.select("ix", "iy", F.col("value").cast("double").alias("v"), size.alias("a"))
    means = parts.groupBy("ix", "iy").agg(F.coalesce(F.try_divide(F.sum(F.col("v") * F.col("a")), F.sum("a")), F.lit(0.0)).alias("value"))
    return cells.join(means, ["ix", "iy"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
