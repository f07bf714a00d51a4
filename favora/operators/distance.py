"""Distance and influence fields over the nodes of a grid.

Nearest features come from joins with leaves of bounded size.  Sums over all features go through packs of them, which meet
packs of nodes in an equi-join and are summed there as arrays, so that no pairs are written out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from favora.functions.geometry import crosses, on_segment, point_distance, segment_distance, segment_intersection
from favora.functions.tables import store
from favora.operators.farfield import far_sums
from favora.operators.near import nearest_candidates, touching, within_candidates

#: Points and nodes that a task multiplies at once.
BLOCK = 20_000
NODES = 8_192
CHUNK = 1 << 21
INF = float("inf")
#: Copies of a line in a row, and pairs of lines that a task lists.
MEMBERS, LISTED = 256, 1 << 22


def _keys(grid: DataFrame) -> list[str]:
    return [c for c in ("ix", "iy", "iz") if c in grid.columns]


def _least(grid: DataFrame, features: DataFrame, distance: Column, name: str = "distance") -> DataFrame:
    keys = _keys(grid)
    plane = grid.select("x", "y").distinct() if "iz" in keys else grid
    # Equal features are one.
    near = nearest_candidates(plane, features.distinct())
    if near is None:
        return grid.withColumn(name, F.lit(INF))
    if "iz" in keys:
        least = near.groupBy("x", "y").agg(F.min(distance).alias(name))
        return grid.join(least, ["x", "y"], "left").select(*grid.columns, name)
    least = near.groupBy(*keys).agg(F.min(distance).alias(name))
    return grid.join(least, keys, "left")


def _need(features: DataFrame, *columns: str) -> None:
    if not set(columns) <= set(features.columns) or not features.limit(1).count():
        raise ValueError(f"features with {', '.join(columns)} are needed")


def distance_from_points(grid: DataFrame, points: DataFrame) -> DataFrame:
    """`grid` with `distance`, the planar distance of the nearest point; ValueError without points."""
    _need(points, "x", "y")
    return _least(grid, points.select("x", "y"), point_distance(F.col("x"), F.col("y"), F.col("f_x"), F.col("f_y")))


def _to_segment() -> Column:
    return segment_distance(*(F.col(c) for c in ("x", "y", "x0", "y0", "x1", "y1")))


def distance_from_lines(grid: DataFrame, segments: DataFrame) -> DataFrame:
    """`grid` with `distance` of the nearest segment (x0, y0, x1, y1); in 3D grids too the distance is planar."""
    _need(segments, "x0", "y0", "x1", "y1")
    return _least(grid, segments.select("x0", "y0", "x1", "y1"), _to_segment())


def inside(points: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, polygon) of the points strictly inside polygons given by their edges (gid, x0, y0, x1, y1).

    Polygons meet the points within their bounds; an odd number of edges to the right means inside.
    """
    named = edges.select(F.col("gid").alias("polygon"), "x0", "y0", "x1", "y1")
    boxes = named.groupBy("polygon").agg(F.min(F.least("x0", "x1")).alias("xmin"), F.min(F.least("y0", "y1")).alias("ymin"), F.max(F.greatest("x0", "x1")).alias("xmax"), F.max(F.greatest("y0", "y1")).alias("ymax"))
    near = within_candidates(points.select(*dict.fromkeys([*keys, "x", "y"])), boxes, 0.0)
    if near is None:
        return points.select(*keys, F.lit(None).cast("long").alias("polygon")).limit(0)
    near = near.where("x > xmin and x < xmax and y > ymin and y < ymax").select(*dict.fromkeys([*keys, "x", "y"]), "polygon").distinct()
    at = [F.col(c) for c in ("x", "y", "x0", "y0", "x1", "y1")]
    tests = near.join(named, "polygon").groupBy(*keys, "polygon").agg(F.count_if(crosses(*at)).alias("n"), F.bool_or(on_segment(*at)).alias("on"))
    return tests.where("n % 2 = 1 and not on").select(*keys, "polygon")


def distance_from_polygons(grid: DataFrame, edges: DataFrame) -> DataFrame:
    """`grid` with `distance`: 0 inside a polygon, else that of the nearest edge."""
    keys = _keys(grid)
    near = distance_from_lines(grid, edges)
    within = inside(grid, edges, keys).select(*keys).distinct().withColumn("_in", F.lit(True))
    return near.join(within, keys, "left").withColumn("distance", F.when(F.col("_in"), F.lit(0.0)).otherwise(F.col("distance"))).drop("_in")


def slice_at_z(solids: DataFrame, z: float, tolerance: float) -> DataFrame:
    """The solids (zmin, zmax) whose range holds z, with tolerance; they keep their whole footprint."""
    return solids.where((F.col("zmin") - tolerance <= z) & (F.col("zmax") + tolerance >= z))


def distance_from_solids(grid: DataFrame, edges: DataFrame, solids: DataFrame, levels: list[float]) -> DataFrame:
    """3D `grid` with `distance` from solids (gid, zmin, zmax) with footprints `edges`.

    Each level takes the planar distance of the footprints that it cuts; a level without any takes that of the nearest level
    with some (of equals the lower), plus the difference in z.  Without solids the distance is infinite.
    """
    step = abs(levels[1] - levels[0]) if len(levels) > 1 else 0.0
    tolerance = step / 2 + 1e-9
    table = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(z)).alias("z")) for i, z in enumerate(levels)))
    cut = solids.select(F.col("gid").alias("polygon"), F.explode(F.filter(table, lambda v: (F.col("zmin") - tolerance <= v["z"]) & (F.col("zmax") + tolerance >= v["z"]))).alias("v")).select("polygon", F.col("v.i").alias("level"))
    valid = sorted(r.level for r in cut.select("level").distinct().collect())
    if not valid:
        return grid.withColumn("distance", F.lit(INF))
    plane = grid.select("x", "y").distinct()
    edged = edges.select(F.col("gid").alias("polygon"), "x0", "y0", "x1", "y1").join(cut, "polygon").drop("polygon")
    # Levels lie so far apart in z that the nearest edge is one of the same level.
    box = edged.agg(F.max(F.greatest(*(F.abs(c) for c in ("x0", "y0", "x1", "y1"))))).first()[0]
    far_off = 8 * max(box, *(abs(v) for v in plane.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()), 1.0)
    lifted = lambda df: df.withColumn("z", F.col("level") * F.lit(far_off))
    asked = lifted(plane.withColumn("level", F.explode(F.array(*(F.lit(i) for i in valid)))))
    both = lifted(edged).withColumns({"z0": F.col("z"), "z1": F.col("z")}).drop("z", "level").distinct()
    far = nearest_candidates(asked, both, ("x", "y", "z")).groupBy("x", "y", "level").agg(F.min(_to_segment()).alias("d"))
    within = inside(plane, edges, ["x", "y"]).join(cut, "polygon").select("x", "y", "level", F.lit(0.0).alias("d"))
    planar = far.unionByName(within).groupBy("x", "y", "level").agg(F.min("d").alias("d"))
    use = {i: min(valid, key=lambda j: (abs(j - i), j)) for i in range(len(levels))}
    # One row for each level.
    source = grid.sparkSession.createDataFrame([(i, j, abs(levels[i] - levels[j])) for i, j in use.items()], "iz long, level int, gap double")
    return grid.join(source, "iz").join(planar, ["x", "y", "level"]).withColumn("distance", F.col("d") + F.col("gap")).drop("level", "gap", "d")


def _signed(one: DataFrame) -> DataFrame:
    """(gid, _n, _h1, _h2) of lines with distinct segments: lines with the same segments have the same.

    Lines are told apart by the number of their segments and two sums of 64-bit hashes.
    """
    ends = [F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")]
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *ends).cast("decimal(20,0)"))
    return one.groupBy("gid").agg(F.count("*").alias("_n"), total(1).alias("_h1"), total(2).alias("_h2"))


def _meets(lines: DataFrame, all_points: bool, overlaps: bool) -> DataFrame:
    """(a, a_last, b, b_last, x, y): points of lines (gid, last, x0, y0, x1, y1) with those whose last number is greater than gid."""
    near = touching(lines)
    if near is None:
        return lines.select(F.col("gid").alias("a"), F.col("last").alias("a_last"), F.col("gid").alias("b"), F.col("last").alias("b_last"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    near = near.withColumnsRenamed({f"f_{c}": f"{c}_2" for c in lines.columns})
    meet = segment_intersection(tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")), tuple(F.col(f"{c}_2") for c in ("x0", "y0", "x1", "y1")), overlaps)
    pair = ["a", "a_last", "b", "b_last"]
    found = near.where("gid < last_2").select(F.col("gid").alias("a"), F.col("last").alias("a_last"), F.col("gid_2").alias("b"), F.col("last_2").alias("b_last"), meet.alias("p")).where("p is not null")
    found = found.select(*pair, F.col("p.x").alias("x"), F.col("p.y").alias("y")).distinct()
    if all_points:
        return found
    return found.groupBy(*pair).agg(F.count("*").alias("n"), F.first("x").alias("x"), F.first("y").alias("y")).where("n = 1").drop("n")


def _members(lines: DataFrame, kinds: DataFrame) -> DataFrame:
    """(kind, low, high, n, gids): the lines (gid, _kind) of each kind (gid, _kind), MEMBERS or fewer in a row, in order.

    Sorted ranges are cut where the kind changes, so a kind of many lines lies in many tasks.
    """
    gid = lines.schema["gid"].dataType
    shape = T.StructType([T.StructField("_kind", T.StringType()), T.StructField("low", gid), T.StructField("high", gid), T.StructField("n", T.LongType()), T.StructField("gids", T.ArrayType(gid))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            kind, gids = batch.column(0), batch.column(1)
            new = np.flatnonzero(np.append(True, pc.not_equal(kind[1:], kind[:-1]).to_numpy(zero_copy_only=False)))
            begin = np.concatenate([np.arange(lo, hi, MEMBERS) for lo, hi in zip(new, np.append(new[1:], len(kind)), strict=True)])
            end = np.append(begin[1:], len(kind))
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(kind)), pa.int32()), gids)
            yield pa.RecordBatch.from_arrays([kind.take(pa.array(begin)), gids.take(pa.array(begin)), gids.take(pa.array(end - 1)), pa.array(end - begin), lists], names=shape.names)

    cut = lines.select("_kind", "gid").repartitionByRange("_kind", "gid").sortWithinPartitions("_kind", "gid").mapInArrow(task, shape)
    return cut.join(kinds.select(F.col("gid").alias("kind"), "_kind"), "_kind").select("kind", "low", "high", "n", "gids")


def intersections(segments: DataFrame, all_points: bool = False, overlaps: bool = True, copies: bool = True, shown: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """(a, b, x, y): points where lines (gid, x0, y0, x1, y1) meet, each pair once; overlaps give their middle, unless told not to.

    Pairs of lines that meet in several points are left out, unless `all_points`.  Only segments whose boxes touch are compared,
    and of lines with the same segments the first stands for all: the pairs of all its copies are listed at the end, from packs
    of them that are dealt out evenly.  Without `copies` all lines are compared, for layers that are known to have few.
    shown: what is done with x and y, once for all copies.
    """
    shape = ["a", "b", shown(F.col("x")).alias("x"), shown(F.col("y")).alias("y")]
    one = segments.select("gid", "x0", "y0", "x1", "y1")
    if not copies:
        return _meets(one.withColumn("last", F.col("gid")), all_points, overlaps).select(*shape)
    one = one.dropna().distinct()
    lines = store(_signed(one).select("gid", F.concat_ws(" ", "_n", "_h1", "_h2").alias("_kind")), "lines")
    kinds = store(lines.groupBy("_kind").agg(F.min("gid").alias("gid"), F.max("gid").alias("last")), "kinds")
    meets = store(_meets(store(one.join(kinds.select("gid", "last"), "gid"), "lines"), all_points, overlaps), "meets")
    single = (F.col("a") == F.col("a_last")) & (F.col("b") == F.col("b_last"))
    out, many = meets.where(single).select(*shape), meets.where(~single).select(*shape)
    if not many.limit(1).count():
        return out
    packs = store(_members(lines, kinds), "members")
    # The point of a pair depends in its last digits on which line comes first, so kinds meet in both orders.
    sides = [packs.select(F.col("kind").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in packs.columns[1:])) for s in "ab"]
    pairs = many.join(sides[0], "a").join(sides[1], "b").where("a_low < b_high")
    total = pairs.agg(F.sum(F.col("a_n") * F.col("b_n"))).first()[0] or 0
    tasks = max(segments.sparkSession.sparkContext.defaultParallelism, -(-total // LISTED))
    dealt = pairs.select("a_gids", "b_gids", "x", "y").repartition(tasks)
    listed = dealt.select(F.explode("a_gids").alias("a"), "b_gids", "x", "y").select("a", F.explode("b_gids").alias("b"), "x", "y").where("a < b")
    return out.unionByName(listed)


def _two_of_each(segments: DataFrame, overlaps: bool) -> DataFrame:
    """`segments` of the first and the last line (gid) of those with the same segments: all places where lines meet are
    places where these do.  Without overlaps copies of one segment don't meet, and the first is enough."""
    one = segments.select("gid", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1"))).dropna().distinct()
    kept = _signed(one).groupBy("_n", "_h1", "_h2").agg(F.min("gid").alias("a"), F.max("gid").alias("b")).withColumn("g", F.when((F.col("a") == F.col("b")) | F.lit(not overlaps) & (F.col("_n") == 1), F.array("a")).otherwise(F.array("a", "b"))).select(F.explode("g").alias("gid"))
    return one.join(kept, "gid", "left_semi")


def line_and_intersection_distances(grid: DataFrame, segments: DataFrame, overlaps: bool = True) -> DataFrame:
    """`grid` with d_line and d_int, the distances of the nearest line and the nearest intersection; infinite without any.

    Copies of a line meet others where it does, so two lines of each kind stand for all.
    """
    line = _least(grid, segments.select("x0", "y0", "x1", "y1"), _to_segment(), "d_line")
    meets = store(intersections(store(_two_of_each(segments, overlaps), "lines"), overlaps=overlaps, copies=False).select("x", "y").distinct(), "meets")
    return _least(line, meets, point_distance(F.col("x"), F.col("y"), F.col("f_x"), F.col("f_y")), "d_int")


def distance_from_lines_with_intersections(grid: DataFrame, segments: DataFrame, weight_line: float = 1.0, weight_intersection: float = 0.5, overlaps: bool = True) -> DataFrame:
    """`grid` with `distance`: the weighted sum of both distances."""
    both = line_and_intersection_distances(grid, segments, overlaps)
    return both.withColumn("distance", weight_line * F.col("d_line") + weight_intersection * F.col("d_int")).drop("d_line", "d_int")


def process_faults(grid: DataFrame, segments: DataFrame, alpha_fault: float = 1000, alpha_intersection: float = 500, weight_fault: float = 0.7, weight_intersection: float = 0.3, use_intersections: bool = True, overlaps: bool = True) -> DataFrame:
    """`grid` with `distance` from faults and `fault score`: decayed influence of faults and their intersections."""
    if use_intersections:
        both = line_and_intersection_distances(grid, segments, overlaps).withColumnRenamed("d_line", "distance")
        meets = F.when(F.col("d_int") == INF, F.lit(0.0)).otherwise(F.exp(-F.col("d_int") / alpha_intersection))
    else:
        both, meets = distance_from_lines(grid, segments), F.lit(0.0)
    return both.withColumn("fault score", weight_fault * F.exp(-F.col("distance") / alpha_fault) + weight_intersection * meets).drop("d_int")


def point_weights(points: DataFrame, column: str | None, low: float = 1.0, high: float = 2.0) -> DataFrame:
    """`points` with `w`: values scaled to [low, high]; missing values count as 0, constant ones as the middle, none as 1."""
    if column is None:
        return points.withColumn("w", F.lit(1.0))
    v = F.coalesce(F.col(column).cast("double"), F.lit(0.0))
    least, most = points.agg(F.min(v), F.max(v)).first()
    if least is None or least == most:
        return points.withColumn("w", F.lit((low + high) / 2))
    return points.withColumn("w", low + (v - least) / (most - least) * (high - low))


def _packed(df: DataFrame, size: int, name: str) -> DataFrame:
    """(name, items): the rows of `df` in packs of `size` at most, numbered; nothing is shuffled."""
    from pyspark import TaskContext

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = pa.StructArray.from_arrays(batch.columns, names=batch.schema.names)
            for lo in range(0, len(rows), size):
                part = rows[lo : lo + size]
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)], names=[name, "items"])
                n += 1

    return df.mapInArrow(task, T.StructType([T.StructField(name, T.LongType()), T.StructField("items", T.ArrayType(df.schema))]))


def influence(grid: DataFrame, weighted: DataFrame, alpha: float, mode: str = "sum", k: int | None = None, tolerance: float = 0.0) -> DataFrame:
    """`grid` with weighted_point_score of w * exp(-d / alpha) over all points (x, y[, z], w).

    mode: sum, mean, max, or knearest (the sum over the k nearest points, of equally near ones by their order in gid, or
    else by their coordinates).  With a tolerance, sum and mean go through the tree of farfield.far_sums(), whose error is
    at most tolerance times the sum of |w|, and whose work for a node grows with the logarithm of the points.  The exact
    setting, 0, has no bound to prune by: packs of nodes meet packs of points in lanes, an equi-join, and each pair of packs
    is summed in a task as arrays.
    """
    if mode not in ("sum", "mean", "max", "knearest"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "knearest" and not k:
        raise ValueError("knearest needs k")
    axes = [a for a in ("x", "y", "z") if a in grid.columns and a in weighted.columns]
    order = ["gid"] if "gid" in weighted.columns else axes
    points = weighted.select(*dict.fromkeys([*order, *axes, "w"]))
    total = points.count()
    if not total:
        return grid.withColumn("weighted_point_score", F.lit(0.0))
    keys = _keys(grid)
    nodes = grid.select(*keys, *axes)
    if mode == "knearest":
        near = nearest_candidates(nodes, points, tuple(axes), min(k, total))
        d = F.sqrt(sum(((F.col(a) - F.col(f"f_{a}")) * (F.col(a) - F.col(f"f_{a}")) for a in axes), F.lit(0.0)))
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("d", *(c if c in near.columns and c not in axes else f"f_{c}" for c in order)))
        found = near.withColumn("d", d).withColumn("place", place).where(F.col("place") <= min(k, total))
        best = found.groupBy(*keys).agg(F.sum(F.col("w") * F.exp(-F.col("d") / alpha)).alias("weighted_point_score"))
        return grid.join(best, keys, "left")
    if tolerance > 0 and mode != "max":
        found = far_sums(nodes, points, tuple(axes), keys, alpha, tolerance)
        return grid.join(found.select(*keys, (F.col("s") / (total if mode == "mean" else 1)).alias("weighted_point_score")), keys, "left")
    packs = store(_packed(points.select(*(F.col(c).cast("double") for c in (*axes, "w"))), BLOCK, "pack"), "points")
    lanes = max(1, min(packs.count(), 4 * grid.sparkSession.sparkContext.defaultParallelism))
    some = _packed(nodes, NODES, "nodes").withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    dealt = packs.select(F.pmod(F.xxhash64("pack"), F.lit(lanes)).alias("lane"), F.col("items").alias("points"))
    pairs = some.join(dealt, "lane").select("items", "points")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                here, given = batch.column(0)[i].values, batch.column(1)[i].values
                at = np.column_stack([here.field(a).to_numpy(zero_copy_only=False).astype(float) for a in axes])
                of = np.column_stack([given.field(a).to_numpy(zero_copy_only=False) for a in axes])
                w = given.field("w").to_numpy(zero_copy_only=False)
                out = np.empty(len(at))
                step = max(1, CHUNK // max(1, len(of)))
                for lo in range(0, len(at), step):
                    part = at[lo : lo + step]
                    s = w * np.exp(-np.sqrt(sum((part[:, j, None] - of[None, :, j]) ** 2 for j in range(len(axes)))) / alpha)
                    out[lo : lo + step] = s.max(axis=1) if mode == "max" else s.sum(axis=1)
                yield pa.RecordBatch.from_arrays([*(here.field(c) for c in keys), pa.array(out)], names=[*keys, "s"])

    kinds = dict(grid.dtypes)
    found = pairs.mapInArrow(task, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", s double")
    value = F.max("s") if mode == "max" else F.sum("s") / (total if mode == "mean" else 1)
    return grid.join(found.groupBy(*keys).agg(value.alias("weighted_point_score")), keys)


def weighted_distance_from_points(grid: DataFrame, points: DataFrame, column: str | None = "value", alpha: float = 1000, weight_min: float = 1, weight_max: float = 2, mode: str = "sum", k_nearest: int | None = None, tolerance: float = 0.0) -> DataFrame:
    """influence() of points weighted by a column, in 2D or 3D."""
    _need(points, "x", "y")
    return influence(grid, point_weights(points, column, weight_min, weight_max), alpha, mode, k_nearest, tolerance)
