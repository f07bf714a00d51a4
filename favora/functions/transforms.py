"""Value transformations and normalisations, as column expressions over statistics of the whole layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from favora.functions.stats import medians_and_mads

INF = float("inf")
METHODS = ("inverse", "negate", "ln", "none", "hill", "valley")
NORMS = ("minmax", "mad")


def check_method(method: str | None) -> str:
    """The method in lower case; raises ValueError for an unknown one."""
    name = "none" if method is None else str(method).lower()
    if name not in METHODS:
        raise ValueError(f"unknown transformation method: {method}")
    return name


def transformed(v: Column, method: str | None, med: Column | None = None, mad: Column | None = None) -> Column:
    """`v` transformed; hill and valley need the layer's median and MAD.  1/0 is infinite, ln(0) minus infinite."""
    name = check_method(method)
    if name == "inverse":
        return F.when(v == 0, F.lit(INF)).otherwise(F.try_divide(F.lit(1.0), v))
    if name == "negate":
        return -v
    if name == "ln":
        return F.when(v == 0, F.lit(-INF)).otherwise(F.ln(v))
    if name in ("hill", "valley"):
        width = F.when(mad == 0, F.lit(1e-6)).otherwise(mad)
        hill = F.exp(-((v - med) * (v - med)) / (F.lit(2.0) * width * width))
        return hill if name == "hill" else F.lit(1.0) - hill
    return v


def is_constant(low: Column, high: Column) -> Column:
    """Whether a layer's range is nil up to a relative tolerance of 1e-5; never true for infinite bounds that differ."""
    finite = (F.abs(low) != INF) & (F.abs(high) != INF)
    return (low == high) | (finite & (F.abs(high - low) <= 1e-8 + 1e-5 * F.abs(low)))


def _finite_or_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def minmax(v: Column, low: Column, high: Column) -> Column:
    """(v - low) / (high - low); a constant layer gives 0 everywhere, missing cells too."""
    return F.when(is_constant(low, high), F.lit(0.0)).otherwise(_finite_or_null(F.try_divide(v - low, high - low)))


def robust(v: Column, med: Column, mad: Column, low: Column, high: Column) -> Column:
    """(v - median) / (1.482 MAD); a MAD of 0 falls back to minmax()."""
    return F.when(F.coalesce(mad, F.lit(0.0)) == 0, minmax(v, low, high)).otherwise((v - med) / (F.lit(1.482) * mad))


def transform_layer(df: DataFrame, column: str, method: str | None) -> DataFrame:
    """`df` with `column` transformed over the whole layer."""
    v = F.col(column)
    if check_method(method) not in ("hill", "valley"):
        return df.withColumn(column, transformed(v, method))
    s = medians_and_mads(df, column).first() or (None, None)
    return df.withColumn(column, transformed(v, method, F.lit(s[0]).cast("double"), F.lit(s[1]).cast("double")))


def normalize_layer(df: DataFrame, column: str, method: str = "minmax") -> DataFrame:
    """`df` with `column` normalised over the whole layer; raises ValueError for an unknown method."""
    if method not in NORMS:
        raise ValueError(f"unknown normalisation method: {method}")
    v = F.col(column)
    low, high = (F.lit(x).cast("double") for x in df.agg(F.min(column), F.max(column)).first())
    if method == "minmax":
        return df.withColumn(column, minmax(v, low, high))
    s = medians_and_mads(df, column).first() or (None, None)
    return df.withColumn(column, robust(v, F.lit(s[0]).cast("double"), F.lit(s[1]).cast("double"), low, high))


def scale_column(df: DataFrame, column: str, norm_to: float = 1.0) -> DataFrame:
    """`df` with `column` scaled to [0, norm_to]; a constant column becomes norm_to everywhere, missing rows too."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None or low == high:
        return df.withColumn(column, F.lit(float(norm_to)))
    return df.withColumn(column, (F.col(column) - low) / (high - low) * float(norm_to))
