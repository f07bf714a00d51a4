"""Lattices: construction, indexing of scattered rows, and pivots."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from favora.functions.tables import store

#: Up to this many coordinates one task numbers them.
SMALL = 100_000
#: Cells of a full lattice for each row of a layer.
MOST_EMPTY = 1_000


class Extent(NamedTuple):
    """A box; zmin and zmax are None in two dimensions."""

    xmin: float
    ymin: float
    xmax: float
    ymax: float
    zmin: float | None = None
    zmax: float | None = None


def _node(i: Column, low: float, high: float, n: int) -> Column:
    if n == 1:
        return F.lit(float(low))
    return F.when(i == n - 1, F.lit(float(high))).otherwise(F.lit(float(low)) + i * F.lit((high - low) / (n - 1)))


def lattice(spark: SparkSession, extent: Extent, nx: int, ny: int, nz: int | None = None) -> DataFrame:
    """Nodes (ix, iy[, iz], x, y[, z]) from bound to bound, the last exactly on the bound."""
    axes = _indices(spark, nx, ny, nz)
    nodes = axes.withColumn("x", _node(F.col("ix"), extent.xmin, extent.xmax, nx)).withColumn("y", _node(F.col("iy"), extent.ymin, extent.ymax, ny))
    return nodes if nz is None else nodes.withColumn("z", _node(F.col("iz"), extent.zmin, extent.zmax, nz))


def centres(spark: SparkSession, extent: Extent, nx: int, ny: int, nz: int | None = None) -> DataFrame:
    """Cell centres (ix, iy[, iz], x, y[, z])."""
    out = _indices(spark, nx, ny, nz)
    for axis, low, high, n in (("x", extent.xmin, extent.xmax, nx), ("y", extent.ymin, extent.ymax, ny), ("z", extent.zmin, extent.zmax, nz)):
        if n is not None:
            out = out.withColumn(axis, F.lit(float(low)) + (F.col(f"i{axis}") + 0.5) * F.lit((high - low) / n))
    return out


def _indices(spark: SparkSession, nx: int, ny: int, nz: int | None) -> DataFrame:
    ids = spark.range(nx * ny * (nz or 1))
    out = ids.select((F.col("id") % nx).alias("ix"), F.floor(F.col("id") / nx % ny).alias("iy"), F.floor(F.col("id") / (nx * ny)).alias("iz"))
    return out.drop("iz") if nz is None else out


def ranked(df: DataFrame, axis: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, axis, i): the distinct coordinates of each group in order, numbered from 0.

    Many coordinates are written in sorted ranges, once; counts of the ranges before each are added to places inside it.
    """
    keys = list(keys)
    every = df.select(*keys, axis).where(F.col(axis).isNotNull()).distinct()
    order = Window.partitionBy(*keys).orderBy(axis) if keys else Window.orderBy(axis)
    if every.limit(SMALL + 1).count() <= SMALL:
        return every.select(*keys, axis, (F.row_number().over(order) - 1).cast("long").alias(f"i{axis}"))
    parts = store(every.repartitionByRange(*keys, axis).withColumn("_p", F.spark_partition_id()), "ranges")
    # A number for each range and group.
    counts = parts.groupBy("_p", *keys).count()
    before = counts.withColumn("_before", F.sum("count").over((Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("_p")) - F.col("count")).drop("count")
    place = F.row_number().over(Window.partitionBy("_p", *keys).orderBy(axis)) - 1
    return parts.join(before, ["_p", *keys]).select(*keys, axis, (place + F.col("_before")).cast("long").alias(f"i{axis}"))


def rasterize(df: DataFrame, column: str, axes: tuple[str, ...] = ("x", "y"), order: str | None = None, sparse: bool = False) -> DataFrame:
    """The full lattice of the distinct coordinates: (i*, coordinates, column); missing cells are NULL.

    Of rows in one cell the last by `order` counts (without it, the greatest value).  Raises ValueError for an empty layer,
    and for scattered rows, of which the full lattice would have more than MOST_EMPTY cells to each; with `sparse` only
    the cells that have rows are given.
    """
    value = F.max_by(column, order) if order else F.max(column)
    cells = df.groupBy(*axes).agg(value.alias(column))
    # Each axis is counted by itself, so that no task holds the distinct values of all.
    sizes = [df.select(a).where(F.col(a).isNotNull()).distinct().count() for a in axes]
    if not all(sizes):
        raise ValueError("cannot rasterize an empty layer")
    ranks = [ranked(df, a) for a in axes]
    if sparse:
        full = cells
        for a, r in zip(axes, ranks, strict=True):
            full = full.join(r, a)
        return full.select(*(f"i{a}" for a in axes), *axes, column)
    if math.prod(sizes) > max(SMALL, MOST_EMPTY * df.count()):
        raise ValueError(f"{math.prod(sizes)} cells for scattered rows; ask for a sparse raster")
    numbers = df.sparkSession.range(math.prod(sizes))
    full = numbers.select(*(F.floor(F.col("id") / math.prod(sizes[:k]) % sizes[k]).cast("long").alias(f"i{a}") for k, a in enumerate(axes)))
    for a, r in zip(axes, ranks, strict=True):
        full = full.join(r, f"i{a}")
    return full.join(cells, list(axes), "left").select(*(f"i{a}" for a in axes), *axes, column)


def derasterize(raster: DataFrame, column: str, geometry: DataFrame, axes: tuple[str, ...] = ("x", "y"), name: str = "favorability") -> DataFrame:
    """`column` of a raster on the lattice of another layer's coordinates, aligned by index."""
    coordinates = rasterize(geometry.select(*axes, F.lit(0).alias("_none")), "_none", axes).drop("_none")
    keys = [f"i{a}" for a in axes]
    return coordinates.join(raster.select(*keys, F.col(column).alias(name)), keys, "left")


def grid_from_tidy(df: DataFrame, column: str = "value") -> DataFrame:
    """(iy, ix, y, x, value): means of equal coordinates on the full lattice; what a pivot of y by x holds, in long form."""
    means = df.where(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("x", "y").agg(F.avg(column).alias(column))
    return rasterize(means, column)
