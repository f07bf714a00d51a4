"""Joins of targets with what lies nearest, or within a distance.

Features are put in order along a Z-curve and cut into leaves of LEAF rows, so that a leaf never holds more, however the
features cluster.  Only the bounds of the leaves, MOST_LEAVES of them at most, are sent to the tasks.  Targets go along
the same curve in groups; a group picks the leaves that matter to it by their bounds and meets them in an equi-join.

A few features, by counted rows and bytes, are sent to the tasks as they are instead, and each target meets all of them.

A search for the nearest takes two rounds: the leaf that seems nearest gives each target a distance, and the leaves that
may hold something as near, few as a rule, are searched in the second.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from favora.functions.tables import store

LEAF = 256
MOST_LEAVES = 200_000
GROUP = 1024
#: Up to so many features are sent to the tasks; or FEW_MORE, if there are no more targets.  Their size is bounded too.
FEW, FEW_MORE, FEW_BYTES = 4_096, 20_000, 16 << 20
#: For rounding in the distances of segments.
SLACK = 1 + 1e-9
#: Parts of equal numbers of features into which each axis is cut before the curve is laid.
PARTS = 256
_BITS = {2: 31, 3: 20}


class _Tree(NamedTuple):
    """The leaves of the features (leaf, items), their numbers and bounds, and the axes."""

    leaves: DataFrame
    ids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    axes: tuple[str, ...]
    cuts: list[np.ndarray]


def _ends(features: DataFrame, axes: tuple[str, ...]) -> list[tuple[Column, Column]]:
    """First and last coordinate of each axis."""
    out = []
    for a in axes:
        names = (f"{a}0", f"{a}1") if f"{a}0" in features.columns else (f"{a}min", f"{a}max") if f"{a}min" in features.columns else (a, a)
        out.append(tuple(F.col(n).cast("double") for n in names))
    return out


def _kind(features: DataFrame) -> str:
    return "segment" if "x0" in features.columns else "box" if "xmin" in features.columns else "point"


def _curve(at: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Places of points along a Z-curve, which is laid over ranks: `cuts` has for each axis the bounds of its parts.

    So neither an outlier nor a cluster leaves most points in one place.
    """
    d = at.shape[1]
    bits = _BITS[d]
    code = np.zeros(len(at), np.int64)
    for k, edges in enumerate(cuts):
        part = np.clip(np.searchsorted(edges, at[:, k], "right") - 1, 0, len(edges) - 2)
        wide = edges[part + 1] - edges[part]
        inside = np.clip(np.divide(at[:, k] - edges[part], wide, out=np.zeros(len(at)), where=wide > 0), 0, 1 - 1e-12)
        v = np.floor((part + inside) * ((1 << bits) / (len(edges) - 1))).astype(np.int64)
        for i in range(bits):
            code |= (v >> i & 1) << (i * d + k)
    return code


def _ordered(df: DataFrame, columns: list[list[str]], cuts: list[np.ndarray]) -> DataFrame:
    """`df` in ranges of the curve, sorted; equal places are told apart by the rest of the row.

    columns: for each axis the columns whose mean is the coordinate.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.column_stack([np.mean([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in of], axis=0) for of in columns])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_curve(at, cuts))], names=[*batch.schema.names, "_code"])

    plain = [F.col(c) for c, t in df.dtypes if not t.startswith(("array", "struct", "map"))]
    placed = df.mapInArrow(task, T.StructType([*df.schema.fields, T.StructField("_code", T.LongType())])).withColumn("_hash", F.xxhash64(*plain))
    return placed.repartitionByRange("_code", "_hash").sortWithinPartitions("_code", "_hash").select(df.columns)


def _rows(batch: pa.RecordBatch) -> pa.StructArray:
    return pa.StructArray.from_arrays(batch.columns, names=batch.schema.names)


def _matrix(rows: pa.StructArray, names: list[str]) -> np.ndarray:
    return np.column_stack([rows.field(n).to_numpy(zero_copy_only=False) for n in names])


def _lists(parts: list[pa.StructArray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]), pa.int32()), pa.concat_arrays(parts))


def _tree(features: DataFrame, axes: tuple[str, ...], least: int = 0) -> _Tree | None:
    """The leaves of `features`, of LEAF or `least` rows at most, or more where there would be too many; None without features."""
    d = len(axes)
    columns = [c for k, ends in enumerate(_ends(features, axes)) for c in (ends[0].alias(f"_a{k}"), ends[1].alias(f"_b{k}"))]
    given = features.select("*", *columns)
    given = given.where(" and ".join(f"_a{k} is not null and _b{k} is not null" for k in range(d)))
    row = given.agg(F.count("*"), *(F.percentile_approx((F.col(f"_a{k}") + F.col(f"_b{k}")) / 2, [i / PARTS for i in range(PARTS + 1)], 4 * PARTS) for k in range(d))).first()
    if not row[0]:
        return None
    cuts = [np.array(x) for x in row[1:]]
    size = max(LEAF, least, -(-row[0] // MOST_LEAVES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 33
        held: list[pa.StructArray] = []

        def cut(rows: pa.StructArray, n: int) -> pa.RecordBatch:
            parts = [rows[i : i + size] for i in range(0, len(rows), size)]
            ends = [[_matrix(p, [f"_{e}{k}" for k in range(d)]) for e in "ab"] for p in parts]
            first = np.array([np.minimum(a, b).min(axis=0) for a, b in ends])
            last = np.array([np.maximum(a, b).max(axis=0) for a, b in ends])
            return pa.RecordBatch.from_arrays([pa.array(np.arange(n, n + len(parts))), *(pa.array(x[:, k]) for k in range(d) for x in (first, last)), _lists(parts)], names=["leaf", *(f"{e}{k}" for k in range(d) for e in ("low", "high")), "items"])

        for batch in batches:
            held.append(_rows(batch))
            if sum(map(len, held)) >= size:
                rows = pa.concat_arrays(held)
                whole = len(rows) // size * size
                yield cut(rows[:whole], n)
                n, held = n + whole // size, [rows[whole:]]
        if any(len(x) for x in held):
            yield cut(pa.concat_arrays(held), n)

    fields = [T.StructField("leaf", T.LongType()), *(T.StructField(f"{e}{k}", T.DoubleType()) for k in range(d) for e in ("low", "high")), T.StructField("items", T.ArrayType(given.schema))]
    leaves = store(_ordered(given, [[f"_a{k}", f"_b{k}"] for k in range(d)], cuts).mapInArrow(task, T.StructType(fields)), "leaves")
    bounds = leaves.drop("items").toArrow()
    column = lambda n: bounds.column(n).to_numpy()
    return _Tree(leaves.select("leaf", F.col("items").alias("leaf_items")), column("leaf"), np.column_stack([column(f"low{k}") for k in range(d)]), np.column_stack([column(f"high{k}") for k in range(d)]), axes, cuts)


def _gap(low: np.ndarray, high: np.ndarray, tree_low: np.ndarray, tree_high: np.ndarray) -> np.ndarray:
    """Squared least distances between boxes (rows) and leaves (columns)."""
    out = np.zeros((len(low), len(tree_low)))
    for k in range(low.shape[1]):
        out += np.maximum(0, np.maximum(tree_low[None, :, k] - high[:, None, k], low[:, None, k] - tree_high[None, :, k])) ** 2
    return out


def _reach(low: np.ndarray, high: np.ndarray, tree_low: np.ndarray, tree_high: np.ndarray) -> np.ndarray:
    """Squared greatest distances between boxes and leaves."""
    out = np.zeros((len(low), len(tree_low)))
    for k in range(low.shape[1]):
        out += np.maximum(tree_high[None, :, k] - low[:, None, k], high[:, None, k] - tree_low[None, :, k]) ** 2
    return out


def _distances(p: np.ndarray, a: np.ndarray, b: np.ndarray, kind: str) -> np.ndarray:
    """Distances of points (rows) and features (columns); of boxes the least."""
    d = p.shape[1]
    if kind == "box":
        low, high = np.minimum(a, b), np.maximum(a, b)
        near = np.stack([np.clip(p[:, None, k], low[None, :, k], high[None, :, k]) for k in range(d)])
    elif kind == "segment":
        step = b - a
        square = (step**2).sum(axis=1)
        along = sum((p[:, None, k] - a[None, :, k]) * step[None, :, k] for k in range(d))
        t = np.clip(np.divide(along, square[None], out=np.zeros_like(along), where=square[None] > 0), 0, 1)
        near = np.stack([a[None, :, k] + t * step[None, :, k] for k in range(d)])
    else:
        near = np.stack([np.broadcast_to(a[None, :, k], (len(p), len(a))) for k in range(d)])
    return np.sqrt(sum((p[:, None, k] - near[k]) ** 2 for k in range(d)))


def _kth(gap: np.ndarray, k: int) -> np.ndarray:
    """The k-th least number of each row; infinite where there are fewer."""
    return np.partition(gap, k - 1, axis=1)[:, k - 1] if gap.shape[1] >= k else np.full(len(gap), np.inf)


def _groups(targets: DataFrame, tree: _Tree, pick: str, distance: float = 0.0) -> DataFrame:
    """(leaf, items): groups of targets with the leaves that they ask first ("nearest"), or all within `distance`."""
    d = len(tree.axes)
    sent = targets.sparkSession.sparkContext.broadcast((tree.ids, tree.low, tree.high))
    given = targets.select("*", *(F.col(a).cast("double").alias(f"_p{k}") for k, a in enumerate(tree.axes))).where(" and ".join(f"_p{k} is not null" for k in range(d)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, low, high = sent.value
        for batch in batches:
            rows = _rows(batch)
            every = _matrix(rows, [f"_p{k}" for k in range(d)])
            for lo in range(0, len(rows), GROUP):
                p = every[lo : lo + GROUP]
                box = p.min(axis=0)[None], p.max(axis=0)[None]
                gap = _gap(*box, low, high)[0]
                if pick == "nearest":
                    some = np.flatnonzero(gap <= _reach(*box, low, high)[0].min() * SLACK)
                    # Where a leaf promises something near for sure; large leaves around an outlier don't.
                    chosen = some[(_reach(p, p, low[some], high[some]) + 1e-9 * _gap(p, p, low[some], high[some])).argmin(axis=1)]
                    asked = [(leaf, np.flatnonzero(chosen == leaf)) for leaf in np.unique(chosen)]
                else:
                    some = np.flatnonzero(gap <= distance**2 * SLACK)
                    near = _gap(p, p, low[some], high[some]) <= distance**2 * SLACK
                    asked = [(leaf, np.flatnonzero(near[:, j])) for j, leaf in enumerate(some) if near[:, j].any()]
                for leaf, of in asked:
                    yield pa.RecordBatch.from_arrays([pa.array([int(ids[leaf])]), _lists([rows.take(pa.array(lo + of))])], names=["leaf", "items"])

    schema = T.StructType([T.StructField("leaf", T.LongType()), T.StructField("items", T.ArrayType(given.schema))])
    return _ordered(given, [[f"_p{k}"] for k in range(d)], tree.cuts).mapInArrow(task, schema)


def _met(groups: DataFrame, tree: _Tree, kind: str, mode: str, limit: float = 0.0, k: int = 1) -> DataFrame:
    """(found, leaf, items) of groups of targets in the leaves that they ask.

    found: pairs (t, f).  mode "nearest": the k nearest features of each target, and in (leaf, items) the targets again, with
    the leaves that may hold something as near; "again": the same, but no further than the items' `_best`; "within": those
    within `limit`; "cross": those of boxes that touch the target's box.
    """
    d = len(tree.axes)
    sent = groups.sparkSession.sparkContext.broadcast((tree.ids, tree.low, tree.high)) if mode == "nearest" else None
    target, feature = groups.schema["items"].dataType.elementType, tree.leaves.schema["leaf_items"].dataType.elementType
    again = T.StructType([*target.fields, T.StructField("_best", T.DoubleType())])
    pair = T.StructType([T.StructField("t", target), T.StructField("f", feature)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            leaf_of, items_of, leaves_of = (batch.column(names.index(n)) for n in ("leaf", "items", "leaf_items"))
            for i in range(batch.num_rows):
                t, f = items_of[i].values, leaves_of[i].values
                a, b = (_matrix(f, [f"_{e}{k}" for k in range(d)]) for e in "ab")
                if mode == "cross":
                    ta, tb = (_matrix(t, [f"_{e}{k}" for k in range(d)]) for e in "ab")
                    hit = (_gap(np.minimum(ta, tb), np.maximum(ta, tb), np.minimum(a, b), np.maximum(a, b)) == 0)
                else:
                    p = _matrix(t, [f"_p{k}" for k in range(d)])
                    gap = _distances(p, a, b, kind)
                    best = _kth(gap, k) if mode == "nearest" else np.full(len(t), limit)
                    if mode == "again":
                        best = np.minimum(_kth(gap, k), t.field("_best").to_numpy() * SLACK)
                    hit = gap <= best[:, None] * (SLACK if mode == "within" else 1)
                rows, columns = np.nonzero(hit)
                found = pa.StructArray.from_arrays([t.take(pa.array(rows)), f.take(pa.array(columns))], names=["t", "f"])
                out = [(None, None, found)]
                if mode == "nearest":
                    ids, low, high = sent.value
                    # Leaves that may be as near, by the bounds of the group first.
                    some = np.flatnonzero(_gap(p.min(axis=0)[None], p.max(axis=0)[None], low, high)[0] <= best.max() ** 2 * SLACK)
                    some = some[ids[some] != leaf_of[i].as_py()]
                    near = _gap(p, p, low[some], high[some]) <= (best**2)[:, None] * SLACK
                    for j in np.flatnonzero(near.any(axis=0)):
                        of = np.flatnonzero(near[:, j])
                        taken = t.take(pa.array(of))
                        rest = pa.StructArray.from_arrays([*taken.flatten(), pa.array(best[of])], names=again.names)
                        out.append((int(ids[some[j]]), rest, found[:0]))
                nothing = pa.StructArray.from_arrays([*t[:0].flatten(), pa.array([], pa.float64())], names=again.names) if mode == "nearest" else None
                arrays = [_lists([x[2] for x in out])]
                if mode == "nearest":
                    arrays += [pa.array([x[0] for x in out], pa.int64()), _lists([nothing if x[1] is None else x[1] for x in out])]
                yield pa.RecordBatch.from_arrays(arrays, names=["found", "leaf", "items"][: len(arrays)])

    fields = [T.StructField("found", T.ArrayType(pair))]
    if mode == "nearest":
        fields += [T.StructField("leaf", T.LongType()), T.StructField("items", T.ArrayType(again))]
    return groups.join(tree.leaves, "leaf").select("leaf", "items", "leaf_items").mapInArrow(task, T.StructType(fields))


def _pairs(found: DataFrame, targets: list[str], features: list[str]) -> DataFrame:
    """The pairs as rows: the targets' columns and the features', with f_ before names that both have."""
    one = found.select(F.explode("found").alias("m"))
    return one.select(*(F.col("m.t")[c].alias(c) for c in targets), *(F.col("m.f")[c].alias(f"f_{c}" if c in targets else c) for c in features))


def _few(targets: DataFrame, features: DataFrame, axes: tuple[str, ...]) -> pa.Table | None:
    """The features with their first and last coordinates, if they are few enough to be sent to the tasks."""
    columns = [c for k, ends in enumerate(_ends(features, axes)) for c in (ends[0].alias(f"_a{k}"), ends[1].alias(f"_b{k}"))]
    given = features.select("*", *columns).where(" and ".join(f"_a{k} is not null and _b{k} is not null" for k in range(len(axes))))
    nested = any(t.startswith(("array", "map", "struct")) for _, t in features.dtypes)
    most = FEW if nested else FEW_MORE
    found = given.limit(most + 1).toArrow()
    if found.num_rows > most or found.nbytes > FEW_BYTES or (found.num_rows > FEW and targets.limit(FEW_MORE + 1).count() > FEW_MORE):
        return None
    return found.combine_chunks()


def _with_few(targets: DataFrame, features: DataFrame, few: pa.Table, axes: tuple[str, ...], kind: str, k: int | None, limit: float = 0.0) -> DataFrame:
    """_pairs() of each target with its k nearest of a few features, or with all within `limit`."""
    d = len(axes)
    sent = targets.sparkSession.sparkContext.broadcast(few)
    names = targets.columns
    given = targets.select("*", *(F.col(a).cast("double").alias(f"_p{k}") for k, a in enumerate(axes))).where(" and ".join(f"_p{k} is not null" for k in range(d)))
    shape = T.StructType([*targets.schema.fields, *(T.StructField(f"f_{f.name}" if f.name in names else f.name, f.dataType) for f in features.schema.fields)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        a, b = (np.column_stack([table.column(f"_{e}{i}").to_numpy() for i in range(d)]) for e in "ab")
        others = [table.column(c).combine_chunks() for c in range(table.num_columns - 2 * d)]
        step = max(1, min(GROUP, (1 << 22) // max(1, len(a))))
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                p = np.column_stack([batch.column(len(names) + i).to_numpy(zero_copy_only=False) for i in range(d)])
                gap = _distances(p, a, b, kind)
                best = np.full(len(p), limit * SLACK) if k is None else _kth(gap, k)
                rows, at = (pa.array(x) for x in np.nonzero(gap <= best[:, None]))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(len(names))), *(c.take(at) for c in others)], names=shape.names)

    return given.mapInArrow(task, shape)


def nearest_candidates(targets: DataFrame, features: DataFrame, axes: tuple[str, ...] = ("x", "y"), k: int = 1) -> DataFrame | None:
    """Rows of targets with features (columns of both) that hold the k nearest of every target; None without features.

    Features are points (x, y[, z]) or segments (x0, y0, x1, y1).  Besides the nearest, all features at the same distance
    come, and some others.
    """
    if (few := _few(targets, features, axes)) is not None:
        return _with_few(targets, features, few, axes, _kind(features), k) if few.num_rows else None
    tree = _tree(features, axes, 4 * k)
    if tree is None:
        return None
    kind = _kind(features)
    first = store(_met(_groups(targets, tree, "nearest"), tree, kind, "nearest", k=k), "near")
    second = _met(first.where("leaf is not null").select("leaf", "items"), tree, kind, "again", k=k)
    one = _pairs(first.where("leaf is null"), targets.columns, features.columns)
    return one.unionByName(_pairs(second, targets.columns, features.columns))


def within_candidates(targets: DataFrame, features: DataFrame, distance: float) -> DataFrame | None:
    """Rows of targets (x, y) with the features whose boxes lie within `distance`; None without features."""
    if (few := _few(targets, features, ("x", "y"))) is not None:
        return _with_few(targets, features, few, ("x", "y"), "box", None, distance) if few.num_rows else None
    tree = _tree(features, ("x", "y"))
    if tree is None:
        return None
    return _pairs(_met(_groups(targets, tree, "within", distance), tree, "box", "within", distance), targets.columns, features.columns)


class Index(NamedTuple):
    """Points in leaves, for searches with rules of one's own."""

    tree: _Tree

    def search(self, targets: DataFrame, leaves_of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], pairs_of: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], columns: list[str]) -> DataFrame:
        """Rows (t, f) of targets and features.

        leaves_of(targets, low, high) tells which leaves (columns) matter to which targets (rows), by the leaves' bounds;
        pairs_of(targets, features) gives the places of the pairs.  Targets are rows of their `columns`, features of their
        coordinates.
        """
        d = len(self.tree.axes)
        sent = targets.sparkSession.sparkContext.broadcast((self.tree.ids, self.tree.low, self.tree.high))
        item = T.ArrayType(targets.schema)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, low, high = sent.value
            for batch in batches:
                rows = _rows(batch)
                step = max(1, min(GROUP, (1 << 22) // max(1, len(ids))))
                for lo in range(0, len(rows), step):
                    part = rows[lo : lo + step]
                    wanted = leaves_of(_matrix(part, columns), low, high)
                    for j in np.flatnonzero(wanted.any(axis=0)):
                        yield pa.RecordBatch.from_arrays([pa.array([int(ids[j])]), _lists([part.take(pa.array(np.flatnonzero(wanted[:, j])))])], names=["leaf", "items"])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    t, f = batch.column(0)[i].values, batch.column(1)[i].values
                    rows, of = pairs_of(_matrix(t, columns), _matrix(f, [f"_a{k}" for k in range(d)]))
                    yield pa.RecordBatch.from_arrays([t.take(pa.array(rows)), f.take(pa.array(of))], names=["t", "f"])

        asked = targets.mapInArrow(ask, T.StructType([T.StructField("leaf", T.LongType()), T.StructField("items", item)]))
        both = asked.join(self.tree.leaves, "leaf").select("items", "leaf_items")
        feature = self.tree.leaves.schema["leaf_items"].dataType.elementType
        return both.mapInArrow(meet, T.StructType([T.StructField("t", targets.schema), T.StructField("f", feature)]))


def index(points: DataFrame, axes: tuple[str, ...]) -> Index | None:
    """The points' leaves; None without points."""
    tree = _tree(points, axes)
    return None if tree is None else Index(tree)


def touching(features: DataFrame) -> DataFrame | None:
    """Pairs of features whose boxes touch, each in both orders, and each with itself; None without features."""
    tree = _tree(features, ("x", "y"))
    if tree is None:
        return None
    sent = features.sparkSession.sparkContext.broadcast((tree.ids, tree.low, tree.high))
    item = tree.leaves.schema["leaf_items"].dataType

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, low, high = sent.value
        for batch in batches:
            for i, leaf in enumerate(batch.column(0).to_pylist()):
                me = np.flatnonzero(ids == leaf)
                others = np.flatnonzero(_gap(low[me], high[me], low, high)[0] == 0)
                for part in np.array_split(others, -(-len(others) // 64)):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[part]), _lists([batch.column(1)[i].values] * len(part))], names=["leaf", "items"])

    asked = tree.leaves.mapInArrow(task, T.StructType([T.StructField("leaf", T.LongType()), T.StructField("items", item)]))
    return _pairs(_met(asked, tree, "box", "cross"), features.columns, features.columns)
