"""Smooth interpolation of scattered points: cubic patches on the Delaunay triangles, of continuous gradient.

Each point finds its ring of Delaunay neighbours by itself.  An inversion around the point turns circles through it into
lines, so the ring is the convex hull of the inverted points that it knows.  A hull edge stands for a circle that must hold no
point (or a half-plane, at the border); the points that do, found among all by leaves, are added until there are none.
Points are moved a little, each by a hash of its place, while rings are found, so that points on one circle give the same
triangles in all rings.

Gradients at the points minimise the curvature along all edges of the triangulation.  That is a linear system of 2 by 2 blocks
whose spectrum is known (between a half and three halves of its diagonal blocks), so Chebyshev iteration solves it by joins
and sums over the edges, with a fixed number of rounds for a given accuracy.

A triangle's patch is that of Clough and Tocher: three cubics around its centroid, with derivatives across an edge that run
linearly in the direction of the neighbour's centroid.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from favora.functions.tables import store
from favora.operators.near import index, nearest_candidates, within_candidates

NEIGHBOURS = 20
MORE = 8
#: Part of the points' typical distance by which they are moved to find rings.
MOVE = 1e-4
VIOLATED = 1e-11
TOLERANCE = 1e-8
_MEMBER = "struct<id: long, x: double, y: double, px: double, py: double, v: double>"
_RING = f"id long, x double, y double, px double, py double, v double, known array<{_MEMBER}>, ring array<{_MEMBER}>, border boolean, gx double, gy double, n0 array<double>, n1 array<double>, c array<double>"


def ring_of(u: np.ndarray) -> tuple[list[int], bool]:
    """Places of the Delaunay neighbours of the origin among the points `u`, counterclockwise, and whether it is at the border."""
    inverted = u / (u * u).sum(axis=1)[:, None]
    flat = [*map(tuple, inverted.tolist()), (0.0, 0.0)]
    order = sorted(range(len(flat)), key=flat.__getitem__)

    def chain(places: list[int]) -> list[int]:
        out: list[int] = []
        for i in places:
            c = flat[i]
            while len(out) > 1:
                a, b = flat[out[-2]], flat[out[-1]]
                if (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) > 0:
                    break
                out.pop()
            out.append(i)
        return out[:-1]

    hull = chain(order) + chain(order[::-1])
    origin = len(flat) - 1
    if origin in hull:
        at = hull.index(origin)
        return hull[at + 1 :] + hull[:at], True
    return hull, False


def _rules(u: np.ndarray, ring: list[int], border: bool) -> tuple[np.ndarray, np.ndarray]:
    """Normals n and numbers c: a point f other than those of the ring belongs to it if n · f > c |f|² for one of them."""
    inverted = u[ring] / (u[ring] ** 2).sum(axis=1)[:, None]
    if border:
        inverted = np.vstack([inverted, np.zeros(2)])
    step = np.roll(inverted, -1, axis=0) - inverted
    n = np.column_stack([step[:, 1], -step[:, 0]])
    size = np.hypot(n[:, 0], n[:, 1])
    n = n / np.where(size > 0, size, 1)[:, None]
    c = (n * inverted).sum(axis=1)
    if border:
        c[-2:] = 0.0
    return n, np.maximum(c, 0.0)


def _fitted(u: np.ndarray, dv: np.ndarray) -> np.ndarray:
    """The gradient at the origin of the quadratic that fits differences dv at u best, near ones more."""
    scale = math.sqrt(float((u * u).sum(axis=1).mean()))
    s = u / scale
    w = 1 / (s * s).sum(axis=1)
    terms = np.column_stack([s, s[:, 0] ** 2, s[:, 0] * s[:, 1], s[:, 1] ** 2])
    return np.linalg.lstsq(terms * w[:, None], dv * w, rcond=None)[0][:2] / scale


def _numbered(points: DataFrame, column: str) -> DataFrame:
    """Distinct places with the mean of their values: id, moved x and y, true px and py, v."""
    clean = points.where(F.col(column).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())
    given = store(clean.groupBy(F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py")).agg(F.avg(column).alias("v")).withColumn("id", F.monotonically_increasing_id()), "places")
    n, a, b, c, d = given.agg(F.count("*"), F.min("px"), F.max("px"), F.min("py"), F.max("py")).first()
    if not n:
        return given.select("id", F.col("px").alias("x"), F.col("py").alias("y"), "px", "py", "v")
    step = MOVE * max(b - a, d - c) / math.sqrt(n)
    moved = lambda p, seed: F.col(p) + step * (F.pmod(F.xxhash64("px", "py", F.lit(seed)), F.lit(1 << 20)) / (1 << 20) - 0.5)
    return store(given.select("id", moved("px", 1).alias("x"), moved("py", 2).alias("y"), "px", "py", "v"), "places")


def rings(places: DataFrame) -> DataFrame:
    """(id, px, py, v, ring, border, gx, gy) of each place: its Delaunay neighbours in order, and a gradient by local fit.

    With fewer than three places, or with all on one line, rings have fewer than two members and there is no triangle.
    """
    member = lambda prefix: F.struct(*(F.col(f"{prefix}{c}").alias(c) for c in ("id", "x", "y", "px", "py", "v")))
    gap = (F.col("x") - F.col("f_x")) * (F.col("x") - F.col("f_x")) + (F.col("y") - F.col("f_y")) * (F.col("y") - F.col("f_y"))
    near = nearest_candidates(places, places, ("x", "y"), NEIGHBOURS + 1).where("id <> f_id")
    first = near.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(gap, "f_id"))).where(F.col("_n") <= NEIGHBOURS)
    own = [c for c in ("id", "x", "y", "px", "py", "v")]
    waiting = store(first.groupBy(*own).agg(F.collect_list(member("f_")).alias("known"), F.sqrt(F.max(gap)).alias("sure")), "waiting")
    tree = index(places, ("x", "y"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, px, py, v, sure = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("x", "y", "px", "py", "v", "sure"))
            lists = batch.column(batch.schema.get_field_index("known"))
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            flat = lists.flatten()
            table = np.column_stack([flat.field(k).to_numpy(zero_copy_only=False) for k in range(1, 6)])
            taken, sizes, border, grad, n0, n1, c = [], [], [], [], [], [], []
            for i in range(batch.num_rows):
                part = table[at[i] : at[i + 1]]
                u = part[:, :2] - (x[i], y[i])
                ring, edge = ring_of(u)
                n, bound = _rules(u, ring, edge)
                # A circle within the distance up to which all points are known needs no search.
                open_ = np.flatnonzero(bound * sure[i] < 1)
                taken.append(at[i] + np.array(ring, np.int64))
                sizes.append(len(ring))
                border.append(edge)
                grad.append(_fitted(part[:, 2:4] - (px[i], py[i]), part[:, 4] - v[i]))
                n0.append(n[open_, 0].tolist())
                n1.append(n[open_, 1].tolist())
                c.append(bound[open_].tolist())
            ring_lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat.take(pa.array(np.concatenate(taken)))) if taken else lists
            g = np.array(grad).reshape(-1, 2)
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in (*own, "known")), ring_lists, pa.array(border, pa.bool_()), pa.array(g[:, 0]), pa.array(g[:, 1]), pa.array(n0, kind), pa.array(n1, kind), pa.array(c, kind)], names=[*own, "known", "ring", "border", "gx", "gy", "n0", "n1", "c"])

    def over(t: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The most that n · u - c |u|² reaches in boxes (columns), for the rules of targets (rows)."""
        out = np.zeros((len(t), len(low)))
        for k in range(2):
            a, b, n, c = low[None, :, k] - t[:, k, None], high[None, :, k] - t[:, k, None], t[:, 2 + k, None], t[:, 4, None]
            best = np.where(c > 0, np.clip(n / np.where(c > 0, 2 * c, 1), a, b), np.where(n > 0, b, a))
            out += n * best - c * best * best
        return out

    def violators(t: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        square = sum((f[None, :, k] - t[:, k, None]) ** 2 for k in range(2))
        far = np.where(square > 0, over(t, f, f) / np.where(square > 0, square, 1), -np.inf)
        far = np.where(over(t, f, f) > VIOLATED * np.sqrt(square), far, -np.inf)
        few = np.argsort(-far, axis=1, kind="stable")[:, :MORE]
        rows, at = np.nonzero(np.isfinite(np.take_along_axis(far, few, axis=1)))
        return rows, few[rows, at]

    done = None
    while True:
        solved = store(waiting.mapInArrow(solve, _RING), "rings")
        rules = solved.select("id", "x", "y", F.explode(F.arrays_zip("n0", "n1", "c")).alias("r")).select("id", "x", "y", "r.n0", "r.n1", "r.c")
        found = tree.search(rules, lambda t, low, high: over(t, low, high) > 0, violators, ["x", "y", "n0", "n1", "c"])
        more = found.select(F.col("t.id").alias("id"), F.struct(*(F.col("f")[k].alias(k) for k in own)).alias("p")).where("p.id <> id").distinct()
        known = solved.select("id", F.explode("known.id").alias("had"))
        more = more.join(known, (more["id"] == known["id"]) & (F.col("p.id") == F.col("had")), "left_anti")
        more = store(more.groupBy("id").agg(F.collect_list("p").alias("more")), "violators")
        ready = solved.join(more.select("id"), "id", "left_anti").select("id", "px", "py", "v", "ring", "border", "gx", "gy")
        done = ready if done is None else done.unionByName(ready)
        if not more.limit(1).count():
            return store(done, "rings")
        # Only the nearest are known to be complete, so `sure` stays.
        rest = waiting.select("id", "sure")
        waiting = store(solved.join(more, "id").join(rest, "id").select(*own, F.concat("known", "more").alias("known"), "sure"), "waiting")


def curvature_gradients(found: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(id, gx, gy) of least curvature along all edges, to `tolerance` of the first guess's error.

    Along an edge e of length l between values f, f' with slopes d = g · e and d' = g' · e, a cubic has the curvature
    4 (d² + d d' + d'² - 3 (f' - f) (d + d') + 3 (f' - f)²) / l³; the sum over all edges is least where its derivatives are 0.
    """
    ways = found.select("id", "px", "py", "v", F.explode("ring").alias("o")).select("id", F.col("o.id").alias("to"), (F.col("o.px") - F.col("px")).alias("ex"), (F.col("o.py") - F.col("py")).alias("ey"), (F.col("o.v") - F.col("v")).alias("dv"))
    back = ways.select(F.col("to").alias("id"), F.col("id").alias("to"), (-F.col("ex")).alias("ex"), (-F.col("ey")).alias("ey"), (-F.col("dv")).alias("dv"))
    edges = ways.union(back).dropDuplicates(["id", "to"]).withColumn("w", F.pow(F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey"), F.lit(-1.5)))
    edges = store(edges, "edges")
    w, ex, ey = F.col("w"), F.col("ex"), F.col("ey")
    block = edges.groupBy("id").agg(F.sum(2 * w * ex * ex).alias("a"), F.sum(2 * w * ex * ey).alias("b"), F.sum(2 * w * ey * ey).alias("d"), F.sum(3 * w * ex * F.col("dv")).alias("r"), F.sum(3 * w * ey * F.col("dv")).alias("s"))
    det = F.col("a") * F.col("d") - F.col("b") * F.col("b")
    # A place whose neighbours lie on one line has no gradient across it.
    flat = det <= 1e-12 * F.pow(F.col("a") + F.col("d"), F.lit(2.0))
    size = F.col("a") + F.col("d")
    inverse = block.select("id", "r", "s", *(F.when(flat, F.col(own) / (size * size)).otherwise(full / det).alias(name) for name, own, full in (("i", "a", F.col("d")), ("j", "b", -F.col("b")), ("k", "d", F.col("a")))))
    # The step of one round: the sum of the neighbours' slopes, through the inverse block.
    step = store(edges.join(inverse, "id").select("to", "id", *((w * (F.col(p) * ex + F.col(q) * ey) * e).alias(n) for n, p, q, e in (("m0", "i", "j", ex), ("m1", "i", "j", ey), ("m2", "j", "k", ex), ("m3", "j", "k", ey)))), "steps")
    base = inverse.select("id", (F.col("i") * F.col("r") + F.col("j") * F.col("s")).alias("cx"), (F.col("j") * F.col("r") + F.col("k") * F.col("s")).alias("cy"))
    at = store(base.select("id", "cx", "cy", F.col("cx").alias("gx"), F.col("cy").alias("gy"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy")), "gradients")
    theta, delta = 1.0, 0.5
    rho = None
    for _ in range(math.ceil(math.log(tolerance / 2) / math.log(2 - math.sqrt(3)))):
        met = step.join(at.select(F.col("id").alias("to"), "gx", "gy"), "to").groupBy("id").agg(F.sum(F.col("m0") * F.col("gx") + F.col("m1") * F.col("gy")).alias("hx"), F.sum(F.col("m2") * F.col("gx") + F.col("m3") * F.col("gy")).alias("hy"))
        now = 1 / (2 * theta / delta - rho) if rho else delta / theta
        old, new = (now * rho, 2 * now / delta) if rho else (0.0, 1 / theta)
        moved = at.join(met, "id").withColumns({f"d{c}": old * F.col(f"d{c}") + new * (F.col(f"c{c}") - F.col(f"h{c}") - F.col(f"g{c}")) for c in "xy"})
        at = store(moved.select("id", "cx", "cy", (F.col("gx") + F.col("dx")).alias("gx"), (F.col("gy") + F.col("dy")).alias("gy"), "dx", "dy"), "gradients")
        rho = now
    return at.select("id", "gx", "gy")


def triangles(found: DataFrame) -> DataFrame:
    """(a, b, c, xmin, ymin, xmax, ymax, and for each corner k: cxk, cyk, vk, gxk, gyk, and oxk, oyk, the corner beyond the edge
    opposite to k, null at the border) of the Delaunay triangles; ids a < b < c name the corners."""
    numbers = [f"{n}{k}" for k in range(3) for n in ("cx", "cy", "v", "gx", "gy", "ox", "oy")]

    def views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ring, m = r["ring"], len(r["ring"])
                for i in range(m - 1 if r["border"] else m):
                    p, q = ring[i], ring[(i + 1) % m]
                    ids = sorted((r["id"], p["id"], q["id"]))
                    row = dict(zip("abc", ids, strict=True))
                    k = ids.index(r["id"])
                    row |= {f"cx{k}": r["px"], f"cy{k}": r["py"], f"v{k}": r["v"], f"gx{k}": r["gx"], f"gy{k}": r["gy"]}
                    # Beyond the edge to p lies the neighbour before it, beyond the one to q the neighbour behind.
                    for corner, other in ((q, ring[i - 1] if i or not r["border"] else None), (p, ring[(i + 2) % m] if i + 2 < m or not r["border"] else None)):
                        if other is not None and m > 2:
                            at = ids.index(corner["id"])
                            row |= {f"ox{at}": other["px"], f"oy{at}": other["py"]}
                    rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, pa.schema([*((c, pa.int64()) for c in "abc"), *((c, pa.float64()) for c in numbers)]))

    each = found.select("id", "px", "py", "v", "ring", "border", "gx", "gy").mapInArrow(views, "a long, b long, c long, " + ", ".join(f"{c} double" for c in numbers))
    whole = each.groupBy("a", "b", "c").agg(F.count("*").alias("views"), *(F.max(c).alias(c) for c in numbers)).where("views = 3").drop("views")
    corners = lambda c: [F.col(f"c{c}{k}") for k in range(3)]
    return whole.select("*", *(f(*corners(c)).alias(f"{c}{n}") for n, f in (("min", F.least), ("max", F.greatest)) for c in "xy"))


def patch(q: np.ndarray, x: np.ndarray, v: np.ndarray, g: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values at points q (n, 2) in triangles, and the least barycentric coordinate, negative outside.

    x: corners (n, 3, 2); v: values (n, 3); g: gradients (n, 3, 2); o: the corners beyond the opposite edges (n, 3, 2), NaN
    at the border.
    """
    def bary(p: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        cross = lambda s, t: s[:, 0] * t[:, 1] - s[:, 1] * t[:, 0]
        area = cross(b - a, c - a)
        safe = np.where(area == 0, np.nan, area)
        one, two = cross(b - p, c - p) / safe, cross(c - p, a - p) / safe
        return np.column_stack([one, two, 1 - one - two])

    whole = bary(q, x[:, 0], x[:, 1], x[:, 2])
    out = np.full(len(q), np.nan)
    least = whole.argmin(axis=1)
    centre = x.mean(axis=1)
    dot = lambda s, t: (s * t).sum(axis=1)
    # The ordinates that two thirds share: next to the corners, towards the centre.
    inner = np.column_stack([v[:, k] + dot(centre - x[:, k], g[:, k]) / 3 for k in range(3)])
    edge = {}
    side = np.empty((len(q), 3))
    for k in range(3):
        i, j = (k + 1) % 3, (k + 2) % 3
        ahead = v[:, i] + dot(x[:, j] - x[:, i], g[:, i]) / 3
        back = v[:, j] + dot(x[:, i] - x[:, j], g[:, j]) / 3
        edge[k] = ahead, back
        beyond = (x[:, i] + x[:, j] + o[:, k]) / 3
        beyond = np.where(np.isnan(beyond), (x[:, i] + x[:, j]) / 2, beyond)
        w = bary(beyond, x[:, i], x[:, j], centre)
        w[:, 2] -= 1
        first = w[:, 0] * v[:, i] + w[:, 1] * ahead + w[:, 2] * inner[:, i]
        last = w[:, 0] * back + w[:, 1] * v[:, j] + w[:, 2] * inner[:, j]
        side[:, k] = ((first + last) / 2 - w[:, 0] * ahead - w[:, 1] * back) / w[:, 2]
    near = np.column_stack([(inner[:, k] + side[:, (k + 1) % 3] + side[:, (k + 2) % 3]) / 3 for k in range(3)])
    top = near.mean(axis=1)
    for k in range(3):
        i, j = (k + 1) % 3, (k + 2) % 3
        of = np.flatnonzero(least == k)
        r, s, t = whole[of, i] - whole[of, k], whole[of, j] - whole[of, k], 3 * whole[of, k]
        ahead, back = (e[of] for e in edge[k])
        out[of] = (
            v[of, i] * r**3 + v[of, j] * s**3 + top[of] * t**3
            + 3 * (ahead * r * r * s + back * r * s * s + inner[of, i] * r * r * t + inner[of, j] * s * s * t + near[of, i] * r * t * t + near[of, j] * s * t * t)
            + 6 * side[of, k] * r * s * t
        )
    # A triangle of three places on one line holds nothing.
    return out, np.where(np.isnan(out), -np.inf, whole.min(axis=1))


def cubic(grid: DataFrame, points: DataFrame, column: str = "value", gradients: str = "curvature") -> DataFrame:
    """`grid` with value_interpolated by cubic patches of continuous gradient on the points' Delaunay triangles, in 2D; NULL
    outside their hull, and everywhere if no three of the points make a triangle.

    Points without a value or coordinate don't count; of equal places the mean does.  gradients: "curvature" (the least along
    all edges) or "fit" (of a quadratic through the nearest points, which reproduces quadratic fields).
    """
    if gradients not in ("curvature", "fit"):
        raise ValueError(f"unknown gradients: {gradients}")
    if "z" in grid.columns and "z" in points.columns:
        raise ValueError("cubic interpolation is for two dimensions")
    keys = [c for c in ("ix", "iy") if c in grid.columns]
    none = grid.withColumn("value_interpolated", F.lit(None).cast("double"))
    places = _numbered(points, column)
    if places.limit(3).count() < 3:
        return none
    found = rings(places)
    if gradients == "curvature":
        found = found.drop("gx", "gy").join(curvature_gradients(found), "id")
    boxes = store(triangles(found), "triangles")
    asked = grid.select(*keys, *(F.col(a).cast("double").alias(a) for a in "xy"))
    met = within_candidates(asked, boxes, 0.0)
    if met is None:
        return none
    kinds = dict(grid.dtypes)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float)  # noqa: E731,B023
            both = lambda n: np.stack([np.column_stack([col(f"{n}x{k}"), col(f"{n}y{k}")]) for k in range(3)], axis=1)  # noqa: E731,B023
            value, inside = patch(np.column_stack([col("x"), col("y")]), both("c"), np.column_stack([col(f"v{k}") for k in range(3)]), both("g"), both("o"))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in keys), pa.array(inside), pa.array(value)], names=[*keys, "inside", "value_interpolated"])

    tried = met.mapInArrow(task, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", inside double, value_interpolated double")
    best = tried.where("inside >= -1e-9").groupBy(*keys).agg(F.max_by("value_interpolated", "inside").alias("value_interpolated"))
    return grid.join(best, keys, "left")
