"""Counts of points and polygons per cell, in 2D and 3D."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from favora.operators.grid import Extent, centres


def _index(c: Column, low: float, size: float) -> Column:
    # Truncation, not rounding; floor differs below the extent, which is filtered away.
    return ((c - low) / size).cast("long")


def _projected(spark: SparkSession, e: Extent, cell: float, nx: int, ny: int, counts: DataFrame) -> DataFrame:
    """Fine cells (ix, iy, x, y, density): each coarse cell (cx, cy, n) fills the fine cells from int(i c / step) on."""
    fine = centres(spark, e, nx, ny)
    dx, dy = (e.xmax - e.xmin) / nx, (e.ymax - e.ymin) / ny
    first = lambda i, d: (i * F.lit(cell) / F.lit(d)).cast("long")
    filled = counts.withColumn("ix", F.explode(_span(first(F.col("cx"), dx), first(F.col("cx") + 1, dx), nx)))
    filled = filled.withColumn("iy", F.explode(_span(first(F.col("cy"), dy), first(F.col("cy") + 1, dy), ny)))
    # Later cells overwrite earlier ones.
    last = filled.groupBy("ix", "iy").agg(F.max_by("n", F.struct("cx", "cy")).alias("density"))
    return fine.join(last, ["ix", "iy"], "left").withColumn("density", F.coalesce("density", F.lit(0)).cast("long"))


def _span(a: Column, b: Column, n: int) -> Column:
    b = F.least(b, F.lit(n))
    return F.when(a < b, F.sequence(a, b - 1))


def point_density(points: DataFrame, e: Extent, cell: float, nx: int, ny: int) -> DataFrame:
    """Points in coarse cells of size `cell`, projected to nx by ny; those past the last whole cell don't count."""
    mx, my = int((e.xmax - e.xmin) / cell), int((e.ymax - e.ymin) / cell)
    at = points.select(_index(F.col("x"), e.xmin, cell).alias("cx"), _index(F.col("y"), e.ymin, cell).alias("cy"), F.col("x"), F.col("y"))
    inside = at.where((F.col("x") >= e.xmin) & (F.col("y") >= e.ymin) & (F.col("cx") < mx) & (F.col("cy") < my))
    return _projected(points.sparkSession, e, cell, nx, ny, inside.groupBy("cx", "cy").agg(F.count("*").alias("n")))


def polygon_density(boxes: DataFrame, e: Extent, cell: float, nx: int, ny: int) -> DataFrame:
    """Polygons whose bounding box (xmin, ymin, xmax, ymax) touches each coarse cell, projected to nx by ny."""
    mx, my = int((e.xmax - e.xmin) / cell), int((e.ymax - e.ymin) / cell)
    meets = (F.col("xmax") >= e.xmin) & (F.col("xmin") <= e.xmax) & (F.col("ymax") >= e.ymin) & (F.col("ymin") <= e.ymax)
    clamp = lambda c, low: _index(F.greatest(F.col(c), F.lit(low)), low, cell)
    near = boxes.where(meets).withColumn("cx", F.explode(_span(clamp("xmin", e.xmin), clamp("xmax", e.xmin) + 1, mx)))
    near = near.withColumn("cy", F.explode(_span(clamp("ymin", e.ymin), clamp("ymax", e.ymin) + 1, my)))
    return _projected(boxes.sparkSession, e, cell, nx, ny, near.groupBy("cx", "cy").agg(F.count("*").alias("n")))


def _voxels(points: DataFrame, e: Extent, sizes: tuple[float, float, float]) -> tuple[DataFrame, list[int]]:
    n = [int((b - a) / s) for a, b, s in zip((e.xmin, e.ymin, e.zmin), (e.xmax, e.ymax, e.zmax), sizes, strict=True)]
    at = points.select("x", "y", "z", *(_index(F.col(c), low, s).alias(f"c{c}") for c, low, s in zip("xyz", (e.xmin, e.ymin, e.zmin), sizes, strict=True)))
    inside = at.where((F.col("x") >= e.xmin) & (F.col("y") >= e.ymin) & (F.col("z") >= e.zmin) & (F.col("cx") < n[0]) & (F.col("cy") < n[1]) & (F.col("cz") < n[2]))
    return inside.groupBy("cx", "cy", "cz").agg(F.count("*").alias("density")), n


def point_density_3d(points: DataFrame, e: Extent, sx: float, sy: float, sz: float) -> DataFrame:
    """Whole voxels (ix, iy, iz, x, y, z, density) with the number of their points."""
    counts, n = _voxels(points, e, (sx, sy, sz))
    whole = Extent(e.xmin, e.ymin, e.xmin + n[0] * sx, e.ymin + n[1] * sy, e.zmin, e.zmin + n[2] * sz)
    renamed = counts.select(*(F.col(f"c{c}").alias(f"i{c}") for c in "xyz"), "density")
    return centres(points.sparkSession, whole, *n).join(renamed, ["ix", "iy", "iz"], "left").withColumn("density", F.coalesce("density", F.lit(0)).cast("long"))


def point_density_3d_projected(points: DataFrame, e: Extent, sx: float, sy: float, sz: float, nx: int, ny: int, nz: int) -> DataFrame:
    """Fine cells (ix, iy, iz, x, y, z, density) with the count of the voxel that their centre lies in."""
    counts, _ = _voxels(points, e, (sx, sy, sz))
    fine = centres(points.sparkSession, e, nx, ny, nz)
    for c, low, s in zip("xyz", (e.xmin, e.ymin, e.zmin), (sx, sy, sz), strict=True):
        fine = fine.withColumn(f"c{c}", _index(F.col(c), low, s))
    return fine.join(counts, ["cx", "cy", "cz"], "left").withColumn("density", F.coalesce("density", F.lit(0)).cast("long")).drop("cx", "cy", "cz")
