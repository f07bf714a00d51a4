"""Segments joined to whole lines, and values along them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from favora.functions.tables import store


def merge_lines(segments: DataFrame) -> DataFrame:
    """(line, seq, x, y, z) of the lines that segments (x0, y0, x1, y1[, z0, z1]) make where exactly two of them meet.

    Ends where one or more than two segments meet stay ends.  seq counts a line's vertices from 1; a line runs from its
    lesser end, a closed one from an end of its first segment and back to it, and is named by the number of its least
    segment in coordinate order.  Segments without a coordinate or length don't count, and equal ones count once.

    Every way along a segment points to the next one; pointers are doubled until they end, so a line of n segments takes
    log2(n) rounds of equi-joins and no task holds a line.
    """
    solid = {"z0", "z1"} <= set(segments.columns)
    axes = "xyz"
    end = lambda i: F.struct(*((F.col(f"{a}{i}").cast("double") if a != "z" or solid else F.lit(0.0)).alias(a) for a in axes))
    whole = segments.dropna(subset=[f"{a}{i}" for i in "01" for a in ("xyz" if solid else "xy")])
    both = whole.select(F.least(end(0), end(1)).alias("a"), F.greatest(end(0), end(1)).alias("b")).where("a <> b").distinct()
    edges = store(both.withColumn("edge", F.monotonically_increasing_id()), "segments")
    ways = edges.select((F.col("edge") * 2).alias("way"), F.col("a").alias("of"), F.col("b").alias("to")).unionByName(edges.select((F.col("edge") * 2 + 1).alias("way"), F.col("b").alias("of"), F.col("a").alias("to")))
    ways = store(ways, "ways")
    # At a vertex where two segments meet: from the way that arrives to the way that leaves by the other one.
    pairs = ways.groupBy("of").agg(F.count("*").alias("n"), F.min("way").alias("one"), F.max("way").alias("two")).where("n = 2")
    back = lambda w: F.col(w).bitwiseXOR(F.lit(1))
    steps = store(pairs.select(back("one").alias("way"), F.col("two").alias("next")).unionByName(pairs.select(back("two").alias("way"), F.col("one").alias("next"))), "steps")

    def followed(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(way, last, far, least): the last way, the steps to it, and the least way passed; and the ways without an end."""
        at = ways.select("way").join(steps, "way", "left").select("way", "next", F.coalesce("next", "way").alias("last"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("far"), F.least("way", F.coalesce("next", "way")).alias("least"))
        at = store(at.withColumn("open", F.col("next").isNotNull()).drop("next"), "pointers")
        reached, before = 1, None
        while True:
            ahead = at.select(F.col("way").alias("last"), F.col("last").alias("last2"), F.col("far").alias("far2"), F.col("least").alias("least2"), F.col("open").alias("open2"))
            met = at.join(ahead, "last")
            at = store(met.select("way", F.col("last2").alias("last"), (F.col("far") + F.col("far2")).alias("far"), F.least("least", "least2").alias("least"), F.col("open2").alias("open")), "pointers")
            reached *= 2
            left = at.where("open").count()
            # While a way of an open line is left, fewer are left after the next round.
            if not left or (left == before and reached >= left):
                return at, at.where("open")
            before = left

    at, rings = followed(steps)
    cuts = store(rings.where("way = least").select("way"), "cuts")
    if cuts.limit(1).count():
        # A ring is opened before its least way.
        at, _ = followed(steps.join(cuts.select(F.col("way").alias("next")), "next", "left_anti").select("way", "next"))
    # Both directions of a line: the way back from its last way is the first one of the other direction.
    firsts = at.groupBy("last").agg(F.max_by("way", "far").alias("first"), F.min(F.shiftright("way", 1)).alias("line"), F.max("far").alias("far"))
    ends = firsts.join(ways.select(F.col("way").alias("first"), F.col("of").alias("begin")), "first").join(ways.select(F.col("way").alias("last"), F.col("to").alias("finish")), "last")
    closed = F.col("begin") == F.col("finish")
    # Of a ring opened at its least way the direction that starts with it counts.
    chosen = ends.where((F.col("begin") < F.col("finish")) | (closed & (F.shiftright("first", 1) == F.col("line")) & (F.col("first") % 2 == 0)))
    inner = at.join(chosen.select("last", "line", F.col("far").alias("all")), "last").join(ways, "way")
    vertices = inner.select("line", (F.col("all") - F.col("far") + 1).alias("seq"), F.col("of").alias("v"))
    tails = chosen.select("line", (F.col("far") + 2).alias("seq"), F.col("finish").alias("v"))
    return vertices.unionByName(tails).select("line", "seq", *(F.col("v")[a].alias(a) for a in axes))


def padded_values(vertices: DataFrame, values: DataFrame, value: str = "value") -> DataFrame:
    """`vertices` (line, seq, ...) with the value of the same seq from `values` (seq, value): missing ones are NULL, further
    ones are left out; of several with one seq the least counts."""
    return vertices.join(values.groupBy("seq").agg(F.min(value).alias(value)), "seq", "left")

