"""3D structure: flattening, extrusion, fault surfaces and traces, well paths."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from favora.functions.tables import store
from favora.operators.clean import clip_polygons, clip_segments
from favora.operators.grid import Extent

#: Rows of a sorted range in which traces are numbered.
CHUNK = 1_000_000


def convert_3d_to_2d(points: DataFrame, column: str) -> DataFrame:
    """(x, y, column, z_min): sums over the points of one place; ValueError without z."""
    if "z" not in points.columns:
        raise ValueError("points with z are needed")
    return points.where("x is not null and y is not null").groupBy("x", "y").agg(F.sum(column).alias(column), F.min("z").alias("z_min"))


def down_dip_offset(z_top: float, z_bottom: float, strike: float, dip: float | None) -> tuple[float, float]:
    """Shift of the bottom edge of a dipping sheet; vertical for no dip or one of 89.9 degrees and more."""
    if dip is None or dip >= 89.9:
        return 0.0, 0.0
    reach = abs(z_top - z_bottom) / math.tan(math.radians(dip))
    azimuth = math.radians(strike + 90)
    return reach * math.cos(azimuth), reach * math.sin(azimuth)


def _wall(top: Column, z_top: float, z_bottom: float, dx: float, dy: float) -> Column:
    """The corners of a trace at the top, then those of its shifted copy at the bottom backwards."""
    upper = F.transform(top, lambda v: F.struct(v["x"].cast("double").alias("x"), v["y"].cast("double").alias("y"), F.lit(float(z_top)).alias("z")))
    lower = F.transform(F.reverse(top), lambda v: F.struct((v["x"] + dx).cast("double").alias("x"), (v["y"] + dy).cast("double").alias("y"), F.lit(float(z_bottom)).alias("z")))
    return F.concat(upper, lower, F.slice(upper, 1, 1))


def extrude_lines(lines: DataFrame, z_top: float, z_bottom: float, strike: float = 0.0, dip: float | None = None, extent: Extent | None = None) -> DataFrame:
    """(gid, ring) of segments (gid, x0, y0, x1, y1) as walls: the top edge, then the shifted bottom edge backwards.

    With an extent the segments are cut at it first.  Azimuths count from the x axis as x = sin, y = cos of the compass
    direction.
    """
    dy, dx = down_dip_offset(z_top, z_bottom, strike, dip)
    cut = clip_segments(lines, extent) if extent else lines
    top = F.array(*(F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in "01"))
    return cut.select("gid", _wall(top, z_top, z_bottom, dx, dy).alias("ring"))


def extrude_polygons(polygons: DataFrame, z_top: float, z_bottom: float, strike: float = 0.0, dip: float | None = None, extent: Extent | None = None) -> DataFrame:
    """(gid, rings) of polygons (gid, rings) as prisms: each ring at the top, then its shifted copy at the bottom backwards.

    The first ring is the shell, others are holes.  With an extent the polygons are cut at it first, each part a row.
    """
    dy, dx = down_dip_offset(z_top, z_bottom, strike, dip)
    cut = clip_polygons(polygons, extent) if extent else polygons
    return cut.select("gid", F.transform("rings", lambda r: _wall(r, z_top, z_bottom, dx, dy)).alias("rings"))


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull counter-clockwise from the least point (monotone chains)."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def chain(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return np.array(chain(points)[:-1] + chain(points[::-1])[:-1])


def fault_surfaces(points: DataFrame, fault: str = "fault_id") -> DataFrame:
    """(fault, n_corners, area, hull): the planar convex hull of each fault's points; faults of less than three corners are left out.

    Hulls of parts of a fault are taken first, then the hull of their corners, so that no task needs a fault's points.
    """
    schema = "fault long, x double, y double"

    def hull(pdf: pd.DataFrame) -> pd.DataFrame:
        corners = convex_hull(pdf[["x", "y"]].to_numpy(float))
        return pd.DataFrame({"fault": pdf["fault"].iloc[0], "x": corners[:, 0], "y": corners[:, 1]})

    given = points.where("x is not null and y is not null").select(F.col(fault).cast("long").alias("fault"), "x", "y")
    parts = given.withColumn("_p", F.pmod(F.xxhash64("x", "y"), F.lit(64))).groupBy("fault", "_p").applyInPandas(lambda pdf: hull(pdf), schema)

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        c = convex_hull(pdf[["x", "y"]].to_numpy(float))
        size = abs(float((c[:, 0] * np.roll(c[:, 1], -1) - c[:, 1] * np.roll(c[:, 0], -1)).sum())) / 2
        return pd.DataFrame([{"fault": pdf["fault"].iloc[0], "n_corners": len(c), "area": size, "hull": [{"x": x, "y": y} for x, y in c.tolist()]}])

    return parts.groupBy("fault").applyInPandas(last, "fault long, n_corners long, area double, hull array<struct<x:double,y:double>>").where("n_corners >= 3")


def fault_traces_top(points: DataFrame, fault: str = "fault_id") -> DataFrame:
    """(fault, n, trace): all points of a fault by falling z (equal z by gid) as a 2D line, which is one value."""
    order = F.struct((-F.col("z")).alias("o"), "gid", "x", "y")
    grouped = points.groupBy(F.col(fault).alias("fault")).agg(F.array_sort(F.collect_list(order)).alias("p"))
    return grouped.select("fault", F.size("p").cast("long").alias("n"), F.transform("p", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("trace"))


def fault_traces_bottom(points: DataFrame, tolerance: float = 1e6, fault: str = "fault_id") -> DataFrame:
    """(fault, n, trace): of each fault with several points within `tolerance` of the least z, the line by x and y; ValueError without any."""
    least = points.agg(F.min("z")).first()[0]
    near = points.where(F.abs(F.col("z") - F.lit(least)) <= tolerance)
    grouped = near.groupBy(F.col(fault).alias("fault")).agg(F.array_sort(F.collect_list(F.struct("x", "y", "z"))).alias("trace")).where(F.size("trace") > 1)
    if not grouped.limit(1).count():
        raise ValueError("no fault has points near the bottom")
    return grouped.select("fault", F.size("trace").cast("long").alias("n"), "trace")


def _numbered(points: DataFrame, order: list[Column]) -> DataFrame:
    """(fault, seq, x, y): the points of each fault numbered from 1 by `order`, however many one fault has.

    Sorted ranges of about CHUNK rows are written once, which cut a large fault into many; inside a range places are counted,
    and the counts of the fault's ranges before are added.
    """
    named = [c.alias(f"_o{k}") for k, c in enumerate(order)]
    given = points.select("fault", "x", "y", *named)
    keys = [f"_o{k}" for k in range(len(order))]
    ranges = max(1, -(-given.count() // CHUNK))
    parts = store(given.repartitionByRange(ranges, "fault", *keys).withColumn("_p", F.spark_partition_id()), "traces")
    counts = parts.groupBy("fault", "_p").count()
    before = counts.select("fault", "_p", (F.sum("count").over(Window.partitionBy("fault").orderBy("_p")) - F.col("count")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("fault", "_p").orderBy(*keys))
    joined = parts.withColumn("_n", place).withColumn("_k", F.col("fault")).join(before.withColumnRenamed("fault", "_f"), (F.col("_k").eqNullSafe(F.col("_f"))) & (parts["_p"] == before["_p"]))
    return joined.select("fault", (F.col("_n") + F.col("_before")).cast("long").alias("seq"), "x", "y")


def trace_rows_top(points: DataFrame, fault: str = "fault_id") -> DataFrame:
    """fault_traces_top() as rows (fault, seq, x, y), for faults of any size."""
    given = points.select(F.col(fault).alias("fault"), "x", "y", "z", "gid")
    return _numbered(given, [-F.col("z"), F.col("gid"), F.col("x"), F.col("y")])


def trace_rows_bottom(points: DataFrame, tolerance: float = 1e6, fault: str = "fault_id") -> DataFrame:
    """fault_traces_bottom() as rows (fault, seq, x, y), for faults of any size; ValueError where no fault has two points."""
    least = points.agg(F.min("z")).first()[0]
    near = points.where(F.abs(F.col("z") - F.lit(least)) <= tolerance).select(F.col(fault).alias("fault"), "x", "y", "z")
    many = near.groupBy("fault").count().where("count > 1").select(F.col("fault").alias("_f"))
    if not many.limit(1).count():
        raise ValueError("no fault has points near the bottom")
    kept = near.join(many, F.col("fault").eqNullSafe(F.col("_f")), "left_semi")
    return _numbered(kept, [F.col("x"), F.col("y"), F.col("z")])


def well_path(rows: DataFrame, sort_by: str | None = None, seq: str = "seq", keys: Sequence[str] = (), dropna_any: bool = True) -> DataFrame:
    """Rows of a path in order, numbered anew, without incomplete points and without consecutive equal ones.

    ValueError for less than two points.
    """
    given = rows if "z" in rows.columns else rows.withColumn("z", F.lit(0.0))
    given = given.dropna(how="any" if dropna_any else "all", subset=["x", "y", "z"])
    if given.limit(2).count() < 2:
        raise ValueError("a well path needs two points")
    order = [c for c in (sort_by, seq) if c]
    here = F.struct("x", "y", "z")
    if keys:
        w = Window.partitionBy(*keys).orderBy(*order)
        kept = given.withColumn("_last", F.lag(here).over(w)).where(~here.eqNullSafe(F.col("_last"))).drop("_last")
        return kept.withColumn("seq", F.row_number().over(w).cast("long"))
    # Sorted ranges, each with the last point of the one before; one row for each range.
    parts = store(given.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "path")
    w, ranges = Window.partitionBy("_p").orderBy(*order), Window.orderBy("_p")
    ends = parts.groupBy("_p").agg(F.max_by(here, F.struct(*order)).alias("_end")).select("_p", F.lag("_end").over(ranges).alias("_end"))
    last = F.coalesce(F.lag(here).over(w), F.col("_end"))
    kept = store(parts.join(F.broadcast(ends), "_p").withColumn("_last", last).where(~here.eqNullSafe(F.col("_last"))).drop("_last", "_end"), "path")
    before = kept.groupBy("_p").count().select("_p", (F.sum("count").over(ranges) - F.col("count")).alias("_before"))
    return kept.join(F.broadcast(before), "_p").withColumn("seq", (F.row_number().over(w) + F.col("_before")).cast("long")).drop("_p", "_before")
