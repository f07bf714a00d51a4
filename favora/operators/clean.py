"""Cleaning, extents, clipping and slicing of layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from favora.functions.stats import quantile
from favora.operators.cut import cut_polygons
from favora.operators.grid import Extent

FEET = 3.28084


def clean_unnamed_columns(df: DataFrame) -> DataFrame:
    """Without the columns whose names start with `Unnamed:`."""
    return df.drop(*(c for c in df.columns if c.startswith("Unnamed:")))


#: The vertical system whose heights are those over the ellipsoid.
ELLIPSOIDAL = "epsg:4979"


def convert_z(df: DataFrame, z_meas: str, target: str, z: str = "z", undulations: DataFrame | None = None) -> DataFrame:
    """z from metres to feet above sea level or back, or from one vertical system (`epsg:...`, metres) to another.

    undulations: (system, x, y, n), for each system a lattice of its zero level's heights n over the ellipsoid; z changes by
    the difference of both systems' bilinear n at the point (x, y), and is NULL outside a lattice.  ELLIPSOIDAL needs no rows.
    Equal systems change nothing; others without rows raise ValueError.  Other pairs of units change nothing.
    """
    factor = {("m-msl", "ft-msl"): FEET, ("ft-msl", "m-msl"): 1 / FEET}.get((z_meas, target))
    if factor is not None:
        return df.withColumn(z, F.col(z) * factor if factor > 1 else F.col(z) / FEET)
    one, two = z_meas.lower(), target.lower()
    if not (one.startswith("epsg:") and two.startswith("epsg:")) or one == two:
        return df
    out = df
    for system, sign in ((one, 1), (two, -1)):
        if system == ELLIPSOIDAL:
            continue
        nodes = None if undulations is None else undulations.where(F.lower("system") == system)
        if nodes is None or not nodes.limit(1).count():
            raise ValueError(f"no undulations of {system}")
        out = _with_undulation(out, nodes).withColumn(z, F.col(z) + sign * F.col("_n")).drop("_n")
    return out


def _with_undulation(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """`df` with _n, bilinear between the four nodes (x, y, n) of its cell; NULL beyond the lattice."""
    a, b, nx, c, d, ny = nodes.agg(F.min("x"), F.max("x"), F.count_distinct("x"), F.min("y"), F.max("y"), F.count_distinct("y")).first()
    if nx < 2 or ny < 2:
        raise ValueError("undulations need a lattice of two by two nodes or more")
    dx, dy = (b - a) / (nx - 1), (d - c) / (ny - 1)
    place = lambda v, low, step: (F.col(v) - low) / step
    corners = F.array(*(F.struct((F.round(place("x", a, dx)).cast("long") - i).alias("_i"), (F.round(place("y", c, dy)).cast("long") - j).alias("_j"), F.lit(2 * j + i).alias("k")) for i in (0, 1) for j in (0, 1)))
    cells = nodes.select(F.explode(corners).alias("p"), "n").groupBy("p._i", "p._j").agg(*(F.max(F.when(F.col("p.k") == k, F.col("n"))).alias(f"_n{k}") for k in range(4)))
    # The last node belongs to the last cell.
    cell = lambda v, low, step, n: F.least(F.floor(place(v, low, step)).cast("long"), F.lit(n - 2))
    inside = F.col("x").between(a, b) & F.col("y").between(c, d)
    placed = df.withColumns({"_i": F.when(inside, cell("x", a, dx, nx)), "_j": F.when(inside, cell("y", c, dy, ny))})
    u, v = place("x", a, dx) - F.col("_i"), place("y", c, dy) - F.col("_j")
    n = (1 - v) * ((1 - u) * F.col("_n0") + u * F.col("_n1")) + v * ((1 - u) * F.col("_n2") + u * F.col("_n3"))
    return placed.join(cells, ["_i", "_j"], "left").withColumn("_n", n).drop("_i", "_j", *(f"_n{k}" for k in range(4)))


def winsorise(df: DataFrame, column: str, q: float = 0.9) -> DataFrame:
    """Values above the quantile `q` become that quantile; missing ones stay.  An absent column changes nothing."""
    if column not in df.columns:
        return df
    top = quantile(df, column, q)
    return df if top is None else df.withColumn(column, F.when(F.col(column) > top, F.lit(top)).otherwise(F.col(column)))


def extent(df: DataFrame, z: bool = False) -> Extent:
    """The bounds of points (x, y[, z]), segments (x0, y0, x1, y1) or boxes; ValueError without z where it is asked for."""
    if "x" in df.columns:
        low, high = ("x", "y"), ("x", "y")
    elif "x0" in df.columns:
        df = df.select(F.least("x0", "x1").alias("xl"), F.least("y0", "y1").alias("yl"), F.greatest("x0", "x1").alias("xh"), F.greatest("y0", "y1").alias("yh"))
        low, high = ("xl", "yl"), ("xh", "yh")
    elif "xmin" in df.columns:
        low, high = ("xmin", "ymin"), ("xmax", "ymax")
    else:
        raise TypeError("neither points nor segments nor boxes")
    if z and ("z" not in df.columns or df.where("z is null").limit(1).count()):
        raise ValueError("an extent in three dimensions needs z")
    more = [F.min("z"), F.max("z")] if z else []
    return Extent(*df.agg(*(F.min(c) for c in low), *(F.max(c) for c in high), *more).first())


def clip_points(df: DataFrame, e: Extent) -> DataFrame:
    """Points inside the extent or on its border, in 3D too (points without z count as z = 0)."""
    inside = F.col("x").between(e.xmin, e.xmax) & F.col("y").between(e.ymin, e.ymax)
    if e.zmin is not None:
        inside &= (F.coalesce("z", F.lit(0.0)) if "z" in df.columns else F.lit(0.0)).between(e.zmin, e.zmax)
    return df.where(inside)


def clip_segments(df: DataFrame, e: Extent) -> DataFrame:
    """Segments cut at the extent (Liang and Barsky); those outside are dropped."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    sides = ((-dx, F.col("x0") - e.xmin), (dx, F.lit(e.xmax) - F.col("x0")), (-dy, F.col("y0") - e.ymin), (dy, F.lit(e.ymax) - F.col("y0")))
    enter = F.greatest(F.lit(0.0), *(F.when(p < 0, F.try_divide(q, p)) for p, q in sides))
    leave = F.least(F.lit(1.0), *(F.when(p > 0, F.try_divide(q, p)) for p, q in sides))
    beside = F.lit(False)
    for p, q in sides:
        beside |= (p == 0) & (q < 0)
    cut = df.withColumn("_a", enter).withColumn("_b", leave).where(~beside & (F.col("_a") <= F.col("_b")))
    points = {"x0": F.col("x0") + F.col("_a") * dx, "y0": F.col("y0") + F.col("_a") * dy, "x1": F.col("x0") + F.col("_b") * dx, "y1": F.col("y0") + F.col("_b") * dy}
    return cut.withColumns(points).drop("_a", "_b")


def clip_polygons(df: DataFrame, e: Extent) -> DataFrame:
    """Polygons (rings: ARRAY<ARRAY<STRUCT<x, y>>>, the first the shell, others holes) cut at the extent, with `part`.

    A row for each part, numbered from 0: a shell that the extent cuts into several parts gives as many rows, and a hole that
    reaches the border becomes part of its shell's border.  Rings come back closed; polygons that only touch the extent or
    lie outside are dropped.
    """
    return cut_polygons(df, e.xmin, e.ymin, e.xmax, e.ymax)


def keep_inside(df: DataFrame, e: Extent) -> DataFrame:
    """Boxes (xmin, ymin, xmax, ymax[, zmin, zmax]) kept whole if inside in XY and overlapping in Z."""
    inside = (F.col("xmin") >= e.xmin) & (F.col("xmax") <= e.xmax) & (F.col("ymin") >= e.ymin) & (F.col("ymax") <= e.ymax)
    if e.zmin is not None and "zmin" in df.columns:
        inside &= (F.col("zmax") >= e.zmin) & (F.col("zmin") <= e.zmax)
    return df.where(inside)


def drop_z(df: DataFrame) -> DataFrame:
    """2D points."""
    return df.drop("z")


def prepare_slice(df: DataFrame, value: str, z: float, tolerance: float = 0.01) -> DataFrame:
    """(x, y, value) of the points with |z - Z| <= tolerance; ValueError without z or coordinates."""
    if not {"x", "y", "z"} <= set(df.columns):
        raise ValueError("a slice needs x, y and z")
    return df.where(F.abs(F.col("z") - z) <= tolerance).select("x", "y", F.col(value).alias("value"))


def plot_slice(df: DataFrame, x: float | None = None, y: float | None = None, z: float | None = None, value: float | None = None) -> DataFrame:
    """Rows up to the given coordinates and from the given value on; what the 3D plots show."""
    for c, most in (("x", x), ("y", y), ("z", z)):
        df = df if most is None else df.where(F.col(c) <= most)
    return df if value is None else df.where(F.col("value") >= value)


def thin(df: DataFrame, stride: int, seq: str = "seq") -> DataFrame:
    """Every stride-th row of a numbered path, from the first on."""
    return df.where((F.col(seq) - 1) % stride == 0)


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, n) of equal-width bins over the range of `column`; the greatest value falls in the last bin."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return df.select(F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("n")).limit(0)
    width = (high - low) / bins or 1.0
    at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("long")
    return df.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def colour_range(layers: Sequence[DataFrame], column: str) -> DataFrame:
    """(low, high) over several layers."""
    out = layers[0].select(column)
    for layer in layers[1:]:
        out = out.unionAll(layer.select(column))
    return out.agg(F.min(column).alias("low"), F.max(column).alias("high"))
