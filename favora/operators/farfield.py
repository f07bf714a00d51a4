"""Sums of exp(-d / alpha) over all points, far ones through interpolation: work that grows with the logarithm of the points.

The leaves of the points (see near.py) are the bottom of a tree whose inner nodes are FAN neighbouring nodes of the level
below.  An inner node stands for its points by weights on a Chebyshev grid of (DEGREE + 1) ** axes places in its box
(Wang, Tlupova and Krasny, 2020).  A group of targets goes down the tree from its top: a node that is far enough is taken by
its grid, others are opened, and leaves that are reached are summed point by point.

How far is enough follows from the error wanted.  For a target whose least distance from a box is delta times the box's half
width, exp(-r / alpha) is analytic, and at most 1, in the Bernstein ellipse of parameter rho = delta + sqrt(1 + delta ** 2)
around each of the box's axes.  Interpolation of degree q in one axis then errs by 4 rho ** -q / (rho - 1) at most, and in
all axes by the sum of that times powers of the Lebesgue constant 1 + 2 / pi log(q + 1).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from favora.functions.tables import store
from favora.operators import near

DEGREE = 8
TARGETS = 256
#: Nodes of the upper levels whose grids are sent to all tasks; those below meet their targets in a join.
SENT = 2_048


def separation(tolerance: float, axes: int, degree: int = DEGREE) -> float:
    """The least delta of which the error per unit of weight is at most `tolerance`."""
    growth = 1 + 2 / math.pi * math.log(degree + 1)
    factor = 4 * sum(growth**k for k in range(axes))
    error = lambda delta: factor * (rho := delta + math.sqrt(1 + delta * delta)) ** -degree / (rho - 1)
    low, high = 1e-3, 1e9
    for _ in range(200):
        middle = math.sqrt(low * high)
        low, high = (middle, high) if error(middle) > tolerance else (low, middle)
    return high


def _grid(degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Chebyshev places in [-1, 1] and their barycentric weights."""
    k = np.arange(degree + 1)
    angle = (2 * k + 1) * math.pi / (2 * degree + 2)
    return np.cos(angle), np.where(k % 2, -1.0, 1.0) * np.sin(angle)


def lagrange(x: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """The values at x, in [-1, 1], of the polynomials that are 1 at one Chebyshev place and 0 at the others."""
    places, weights = _grid(degree)
    gap = x[:, None] - places[None]
    exact = np.abs(gap) < 1e-14
    terms = weights / np.where(exact, 1, gap)
    out = terms / terms.sum(axis=1, keepdims=True)
    hit = exact.any(axis=1)
    out[hit] = exact[hit]
    return out


def _half(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Half widths of a box's axes; a flat axis counts as tiny, so that it has a place for each polynomial."""
    return np.maximum((high - low) / 2, 1e-12 * max(1.0, float(np.abs(low).max()), float(np.abs(high).max())))


def grid_weights(at: np.ndarray, w: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Weights on a box's Chebyshev grid that stand for points in it, flat."""
    half = _half(low, high)
    factors = [lagrange(np.clip((at[:, k] - (low[k] + high[k]) / 2) / half[k], -1, 1)) for k in range(at.shape[1])]
    out = w[:, None]
    for f in factors:
        out = (out[:, :, None] * f[:, None, :]).reshape(len(w), -1)
    return out.sum(axis=0)


def grid_places(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The places of a box's Chebyshev grid, in the order of grid_weights()."""
    places, _ = _grid(DEGREE)
    half = _half(low, high)
    return np.array(list(itertools.product(*((low[k] + high[k]) / 2 + half[k] * places for k in range(len(low))))))


def _summed(t: np.ndarray, at: np.ndarray, w: np.ndarray, alpha: float) -> np.ndarray:
    out = np.empty(len(t))
    for lo in range(0, len(t), 64):
        d = np.sqrt(sum((t[lo : lo + 64, k, None] - at[None, :, k]) ** 2 for k in range(t.shape[1])))
        out[lo : lo + 64] = np.exp(-d / alpha) @ w
    return out


def _levels(low: np.ndarray, high: np.ndarray, fan: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bounds of the tree's levels, from the leaves up to one node."""
    out = [(low, high)]
    while len(out[-1][0]) > 1:
        a, b = out[-1]
        cuts = np.arange(0, len(a), fan)
        out.append((np.minimum.reduceat(a, cuts), np.maximum.reduceat(b, cuts)))
    return out


def far_sums(targets: DataFrame, points: DataFrame, axes: tuple[str, ...], keys: list[str], alpha: float, tolerance: float) -> DataFrame:
    """(keys, s) with s the sum of w * exp(-d / alpha) over the points (axes, w), for each row of `targets` (keys, axes).

    The error of s is at most tolerance times the sum of |w|.  Targets or points without a coordinate, and points without a
    weight, don't count; without points there are no rows.
    """
    d = len(axes)
    given = points.select(*(F.col(a).cast("double").alias(a) for a in axes), F.col("w").cast("double").alias("w")).where("w is not null")
    tree = near._tree(given, axes)
    shape = T.StructType([*(targets.schema[k] for k in keys), T.StructField("s", T.DoubleType())])
    if tree is None:
        return targets.select(*keys, F.lit(0.0).alias("s")).where("false")
    fan, delta = 2**d, separation(tolerance, d)
    order = np.argsort(tree.ids)
    ids, levels = tree.ids[order], _levels(tree.low[order], tree.high[order], fan)
    spark = targets.sparkSession
    bounds = spark.sparkContext.broadcast((ids, levels))
    column = [f"_a{k}" for k in range(d)]

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Grid weights of inner nodes: of each level only the last node is open, as leaves come in order."""
        numbers, bands = bounds.value
        open_: dict[int, tuple[int, np.ndarray]] = {}

        def row(level: int, node: int, weights: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([level], pa.int32()), pa.array([node]), pa.array([weights.tolist()])], names=["level", "node", "grid"])

        for batch in batches:
            for i in range(batch.num_rows):
                items = batch.column(1)[i].values
                at, w = near._matrix(items, column), items.field("w").to_numpy(zero_copy_only=False)
                node = int(np.searchsorted(numbers, batch.column(0)[i].as_py()))
                for level in range(1, len(bands)):
                    node //= fan
                    if level in open_ and open_[level][0] != node:
                        yield row(level, *open_.pop(level))
                    weights = grid_weights(at, w, bands[level][0][node], bands[level][1][node])
                    open_[level] = node, open_[level][1] + weights if level in open_ else weights
        for level, (node, weights) in open_.items():
            yield row(level, node, weights)

    parts = tree.leaves.mapInArrow(nodes, "level int, node long, grid array<double>")
    # A node on the border of two tasks comes in two parts.
    added = F.aggregate(F.collect_list("grid"), F.array_repeat(F.lit(0.0), (DEGREE + 1) ** d), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    grids = store(parts.groupBy("level", "node").agg(added.alias("grid")), "grids")
    first_sent = next(k for k in range(len(levels)) if sum(len(x[0]) for x in levels[k:]) <= SENT)
    sent = {(r.level, r.node): np.array(r.grid) for r in grids.where(F.col("level") >= max(1, first_sent)).collect()}
    top = spark.sparkContext.broadcast(sent)
    item = T.ArrayType(T.StructType([*(targets.schema[k] for k in keys), *(T.StructField(f"_p{k}", T.DoubleType()) for k in range(d))]))
    asked = targets.select(*keys, *(F.col(a).cast("double").alias(f"_p{k}") for k, a in enumerate(axes))).where(" and ".join(f"_p{k} is not null" for k in range(d)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a group of targets gets from the nodes at hand, and the others that it asks: level 0 is a leaf."""
        numbers, bands = bounds.value
        for batch in batches:
            rows = near._rows(batch)
            every = near._matrix(rows, [f"_p{k}" for k in range(d)])
            for lo in range(0, len(rows), TARGETS):
                part, t = rows[lo : lo + TARGETS], every[lo : lo + TARGETS]
                box = t.min(axis=0), t.max(axis=0)
                level, live, s = len(bands) - 1, np.array([0]), np.zeros(len(t))
                wanted = []
                while len(live):
                    a, b = bands[level][0][live], bands[level][1][live]
                    if not level:
                        wanted += [(0, int(numbers[i])) for i in live]
                        break
                    gap = np.sqrt((np.maximum(0, np.maximum(a - box[1], box[0] - b)) ** 2).sum(axis=1))
                    far = gap >= delta * ((b - a) / 2).max(axis=1)
                    far &= gap > 0
                    for i in live[far].tolist():
                        if (grid := top.value.get((level, i))) is not None:
                            s += _summed(t, grid_places(bands[level][0][i], bands[level][1][i]), grid, alpha)
                        else:
                            wanted.append((level, i))
                    below = (live[~far][:, None] * fan + np.arange(fan)).ravel()
                    level -= 1
                    live = below[below < len(bands[level][0])]
                here = pa.array(s)
                yield pa.RecordBatch.from_arrays([pa.array([None] + [x[0] for x in wanted], pa.int32()), pa.array([None] + [x[1] for x in wanted], pa.int64()), near._lists([part] * (1 + len(wanted))), pa.ListArray.from_arrays(pa.array([0, len(t)] + [len(t)] * len(wanted), pa.int32()), here)], names=["level", "node", "items", "here"])

    placed = near._ordered(asked, [[f"_p{k}"] for k in range(d)], tree.cuts)
    lists = store(placed.mapInArrow(ask, T.StructType([T.StructField("level", T.IntegerType()), T.StructField("node", T.LongType()), T.StructField("items", item), T.StructField("here", T.ArrayType(T.DoubleType()))])), "lists")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                items = batch.column(2)[i].values
                t = near._matrix(items, [f"_p{k}" for k in range(d)])
                level, node = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if level:
                    _, bands = bounds.value
                    s = _summed(t, grid_places(bands[level][0][node], bands[level][1][node]), batch.column(3)[i].values.to_numpy(), alpha)
                else:
                    of = batch.column(3)[i].values
                    s = _summed(t, near._matrix(of, column), of.field("w").to_numpy(zero_copy_only=False), alpha)
                yield pa.RecordBatch.from_arrays([*(items.field(k) for k in keys), pa.array(s)], names=[*keys, "s"])

    own = lists.where("level is null").select(F.explode(F.arrays_zip("items", "here")).alias("r")).select(*(F.col("r.items")[k].alias(k) for k in keys), F.col("r.here").alias("s"))
    leaves = lists.where("level = 0").join(tree.leaves.withColumnRenamed("leaf", "node"), "node").select("level", "node", "items", "leaf_items").mapInArrow(met, shape)
    inner = lists.where("level > 0").join(grids, ["level", "node"]).select("level", "node", "items", "grid").mapInArrow(met, shape)
    return own.unionByName(leaves).unionByName(inner).groupBy(*keys).agg(F.sum("s").alias("s"))
