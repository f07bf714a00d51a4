"""Exact statistics that stay distributed, and the NULL/NaN edges.

Missing values are NULL inside the engine; NaN exists only in files and arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
#: Up to this many values Spark's own exact percentile is used.
SMALL = 100_000


def null_if_nan(c: Column | str) -> Column:
    """NULL for NaN."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def exact_quantile(df: DataFrame, column: str, q: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, quantile): the linearly interpolated quantile of `column`, for each group; NULLs don't count.

    An approximate sketch brackets the quantile; only the values inside the bracket, a few of ACCURACY parts of the group,
    are sorted.  No task holds the values of a whole group.
    """
    keys = list(keys)
    if df.select(column).limit(SMALL + 1).count() <= SMALL:
        return df.where(F.col(column).isNotNull()).groupBy(*keys).agg(F.percentile(F.col(column).cast("double"), q).alias("quantile"))
    given = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("_v"))
    if not keys:
        given, keys = given.withColumn("_one", F.lit(1)), ["_one"]
    edge = 4 / ACCURACY
    about = given.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_v", [max(0.0, q - edge), min(1.0, q + edge)], ACCURACY).alias("_p"))
    about = about.select(*keys, "_n", F.col("_p")[0].alias("_lo"), F.col("_p")[1].alias("_hi"))
    both = given.join(F.broadcast(about) if keys == ["_one"] else about, keys)
    beside = both.groupBy(*keys).agg(F.count_if(F.col("_v") < F.col("_lo")).alias("_below"), F.max(F.when(F.col("_v") < F.col("_lo"), F.col("_v"))).alias("_before"), F.min(F.when(F.col("_v") > F.col("_hi"), F.col("_v"))).alias("_after"), F.first("_n").alias("_n"))
    inside = both.where("_v between _lo and _hi").groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    inside = inside.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v")))
    at = F.lit(q) * (F.col("_n") - 1) - F.col("_below")
    low, high = F.floor(at), F.ceil(at)
    joined = inside.join(beside, keys).withColumn("_low", low).withColumn("_high", high)
    holds = lambda rank: (F.col("_upto") > F.col(rank)) & (F.col("_upto") - F.col("_c") <= F.col(rank))
    picked = joined.groupBy(*keys).agg(F.max(F.when(holds("_low"), F.col("_v"))).alias("_a"), F.max(F.when(holds("_high"), F.col("_v"))).alias("_b"), *(F.first(c).alias(c) for c in ("_before", "_after")), F.first(at).alias("_at"))
    a, b = F.coalesce("_a", "_before"), F.coalesce("_b", "_after")
    return picked.select(*(k for k in keys if k != "_one"), (a + (b - a) * (F.col("_at") - F.floor("_at"))).alias("quantile"))


def quantile(df: DataFrame, column: str, q: float) -> float | None:
    """exact_quantile() of the whole column."""
    row = exact_quantile(df, column, q).first()
    return row[0] if row else None


def medians_and_mads(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, med, mad): the median, and the median of the absolute deviations from it."""
    med = exact_quantile(df, column, 0.5, keys).withColumnRenamed("quantile", "med")
    if keys:
        off = df.join(med, list(keys)).select(*keys, F.abs(F.col(column) - F.col("med")).alias("_d"))
        return med.join(exact_quantile(off, "_d", 0.5, keys).withColumnRenamed("quantile", "mad"), list(keys))
    value = quantile(df, column, 0.5)
    off = df.select(F.abs(F.col(column) - F.lit(value)).alias("_d"))
    return exact_quantile(off, "_d", 0.5).select(F.lit(value).cast("double").alias("med"), F.col("quantile").alias("mad"))
