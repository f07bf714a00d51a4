"""Cubic patches, exact kriging, far sums, cut polygons, fits by gradients, resamples, lines, vertical systems and lattices in SQL."""

import itertools
import math
import random

import numpy as np
import pytest
from favora.functions import sqlfuncs
from favora.operators import clean, cubic, cut, distance, farfield, gp, grid, interpolate, kriging, lines, near, structure
from favora.operators.grid import Extent
from pyspark.sql import functions as F


def points(spark, at, v):
    names = ["x", "y", "z"][: at.shape[1]]
    return spark.createDataFrame([(i, *map(float, p), float(w)) for i, (p, w) in enumerate(zip(at, v, strict=True))], "gid long, " + ", ".join(f"{n} double" for n in names) + ", value double")


def scattered(n, seed=1, side=100):
    """Random places, a lattice (points on one circle), and a cluster."""
    r = np.random.default_rng(seed)
    return np.vstack([r.uniform(0, side, (n, 2)), [[i * side / 5, j * side / 5] for i in range(6) for j in range(6)], r.normal(side / 3, 0.5, (10, 2))])


def test_cubic_reproduces_quadratics_and_planes(spark):
    at = scattered(60)
    nodes = grid.lattice(spark, Extent(-10.0, -10.0, 110.0, 110.0), 13, 13)
    quadratic = lambda x, y: 3 + 2 * x - y + 0.05 * x * x - 0.02 * x * y + 0.03 * y * y
    got = cubic.cubic(nodes, points(spark, at, quadratic(*at.T)), gradients="fit").toPandas()
    inside = got["x"].between(0, 100) & got["y"].between(0, 100)
    assert got.value_interpolated[inside].notna().all() and got.value_interpolated[~inside].isna().all()
    assert np.abs(got.value_interpolated - quadratic(got.x, got.y))[inside].max() < 1e-6


def test_cubic_gradients_and_triangles(spark):
    at = scattered(25, 2)
    v = np.sin(at[:, 0] / 9) * np.cos(at[:, 1] / 13)
    found = cubic.rings(cubic._numbered(points(spark, at, v), "value"))
    rows = {r.id: r for r in found.collect()}
    edges = {(i, o.id) for i, r in rows.items() for o in r.ring}
    assert edges == {(j, i) for i, j in edges}
    number = {i: k for k, i in enumerate(rows)}
    a, b = np.zeros((2 * len(rows),) * 2), np.zeros(2 * len(rows))
    for i, j in edges:
        e = np.array([rows[j].px - rows[i].px, rows[j].py - rows[i].py])
        w, k, m = (e @ e) ** -1.5, 2 * number[i], 2 * number[j]
        a[k : k + 2, k : k + 2] += 2 * w * np.outer(e, e)
        a[k : k + 2, m : m + 2] += w * np.outer(e, e)
        b[k : k + 2] += 3 * w * e * (rows[j].v - rows[i].v)
    expected = np.linalg.solve(a, b).reshape(-1, 2)
    solved = cubic.curvature_gradients(found)
    got = {r.id: (r.gx, r.gy) for r in solved.collect()}
    assert max(np.abs(np.array(got[i]) - expected[number[i]]).max() for i in rows) < 1e-6
    tri = cubic.triangles(found.drop("gx", "gy").join(solved, "id")).toPandas()
    # Euler's formula for a triangulation.
    assert len(tri) == 2 * len(rows) - 2 - sum(r.border for r in rows.values())
    true = np.abs((tri.cx1 - tri.cx0) * (tri.cy2 - tri.cy0) - (tri.cx2 - tri.cx0) * (tri.cy1 - tri.cy0)).sum() / 2
    assert abs(true - 100 * 100) < 1.0
    # Values and gradients agree across edges.
    stacked = lambda p, rs: np.array([[[r[f"{p}x{k}"], r[f"{p}y{k}"]] for k in range(3)] for r in rs])
    shared = {}
    for r in tri.to_dict("records"):
        for k in range(3):
            shared.setdefault(tuple(sorted((r["abc"[(k + 1) % 3]], r["abc"[(k + 2) % 3]]))), []).append(r)
    worst = 0.0
    for (i, j), pair in shared.items():
        if len(pair) < 2:
            continue
        p, q = np.array([rows[i].px, rows[i].py]), np.array([rows[j].px, rows[j].py])
        across = np.array([p[1] - q[1], q[0] - p[0]])
        size = np.hypot(*across)
        if any(abs(np.linalg.det(np.diff(x, axis=0))) < 1e-3 * size**2 for x in stacked("c", pair)):
            continue
        here, h = p + 0.37 * (q - p), 1e-5 * size
        slopes = []
        for r in pair:
            sign = np.sign((stacked("c", [r])[0].mean(axis=0) - here) @ across)
            at3 = np.array([here + across / size * sign * h * k for k in range(3)])
            f, _ = cubic.patch(at3, stacked("c", [r] * 3), np.array([[r[f"v{k}"] for k in range(3)]] * 3), stacked("g", [r] * 3), stacked("o", [r] * 3))
            slopes.append((sign * (4 * f[1] - f[2] - 3 * f[0]) / (2 * h), f[0]))
        worst = max(worst, abs(slopes[0][0] - slopes[1][0]), abs(slopes[0][1] - slopes[1][1]))
    assert worst < 1e-4


def test_cubic_edges(spark):
    nodes = grid.lattice(spark, Extent(0.0, 0.0, 10.0, 10.0), 3, 3)
    line = points(spark, np.array([[0.0, 0.0], [5.0, 5.0], [10.0, 10.0], [2.0, 2.0]]), np.arange(4))
    for given in (line, line.limit(0), line.limit(2), line.withColumn("value", F.lit(None).cast("double"))):
        assert cubic.cubic(nodes, given).where("value_interpolated is not null").count() == 0
    with pytest.raises(ValueError, match="unknown gradients"):
        cubic.cubic(nodes, line, gradients="x")
    with pytest.raises(ValueError, match="two dimensions"):
        cubic.cubic(nodes.withColumn("z", F.lit(0.0)), line.withColumn("z", F.lit(0.0)))


@pytest.mark.parametrize("sent", [0, 100_000])
def test_large_kriging_equals_one_system(spark, monkeypatch, sent):
    monkeypatch.setattr(kriging, "SENT", sent)
    monkeypatch.setattr(kriging, "PACK", 64)
    monkeypatch.setattr(kriging, "COARSE", 200 if not sent else 60)
    r = np.random.default_rng(4)
    n = 260 if sent else 130
    at = np.vstack([r.uniform(0, 100, (n, 2)), r.normal(30, 1, (20, 2))])
    # A trend, so that the slope counts, or noise alone.
    v = at[:, 0] / 20 + np.sin(at[:, 1] / 15) if sent else r.normal(size=len(at))
    nodes = grid.lattice(spark, Extent(0.0, 0.0, 100.0, 100.0), 6, 6)
    one = interpolate.kriging(nodes, points(spark, at, v)).toPandas().set_index(["ix", "iy"])
    many = interpolate.kriging(nodes, points(spark, at, v), whole=10).toPandas().set_index(["ix", "iy"])
    assert np.abs(one.value_interpolated - many.value_interpolated).max() < 1e-6


def test_preconditioned_tables_equal_arrays(spark, monkeypatch):
    monkeypatch.setattr(kriging, "PACK", 32)
    monkeypatch.setattr(kriging, "COARSE", 40)
    r = np.random.default_rng(5)
    at = r.uniform(0, 10, (100, 2))
    packs = kriging.packed(points(spark, at, r.normal(size=100)).withColumnRenamed("value", "v"), ("x", "y"))
    given = kriging._weights(packs, 2, 1.0, 0.01)
    out = kriging._preconditioned(packs.select("pack", F.col("v").alias("y")), packs, *given).collect()
    rows = {x.pack: x for x in packs.collect()}
    ids = [(k, i) for k in rows for i in range(len(rows[k].v))]
    v = {k: rows[k[0]].v[k[1]] for k in ids}
    weights = {}
    for w in given[0].collect():
        weights.setdefault((w.pack, w.place), []).append((w.of_pack, w.of_place, w.w, w.s))
    assert len(weights) + len(given[2]) == 100 and all(abs(sum(x[2] for x in w) - 1) < 1e-9 for w in weights.values())
    z = dict.fromkeys(ids, 0.0)
    for k, w in weights.items():
        t = (v[k] - sum(x[2] * v[x[:2]] for x in w)) / w[0][3]
        z[k] += t
        for x in w:
            z[x[:2]] -= x[2] * t
    for k, t in zip(given[2], given[1] @ np.array([v[k] for k in given[2]]), strict=True):
        z[k] += t
    assert max(abs(x.y[i] - z[x.pack, i]) for x in out for i in range(len(x.y))) < 1e-9


@pytest.mark.parametrize("d", [2, 3])
def test_far_sums_keep_their_bound(spark, d, monkeypatch):
    monkeypatch.setattr(farfield, "SENT", 20)
    r = np.random.default_rng(6)
    at = np.vstack([r.uniform(0, 1000, (9000, d)), r.normal(300, 5, (3000, d))])
    pts = points(spark, at, r.uniform(1, 2, len(at))).withColumnRenamed("value", "w")
    box = Extent(0.0, 0.0, 1000.0, 1000.0) if d == 2 else Extent(0.0, 0.0, 1000.0, 1000.0, 0.0, 1000.0)
    nodes = grid.lattice(spark, box, *([9, 9] if d == 2 else [4, 4, 4]))
    keys = ["ix", "iy", "iz"][:d]
    exact = distance.influence(nodes, pts, 150.0).toPandas().set_index(keys)
    total = pts.agg(F.sum("w")).first()[0]
    for tolerance in (1e-3, 1e-7):
        got = distance.influence(nodes, pts, 150.0, tolerance=tolerance).toPandas().set_index(keys)
        assert len(got) == len(exact)
        assert np.abs(got.weighted_point_score - exact.weighted_point_score).max() <= tolerance * total
    assert distance.influence(nodes, pts.limit(0), 150.0, tolerance=1e-3).agg(F.max("weighted_point_score")).first()[0] == 0


def test_work_for_a_node_grows_slowly():
    """Leaves of a square of points, four times as many each time: what one target asks grows by the same number."""
    asked = []
    for k in (4, 5, 6, 7):
        side = 2**k
        order = sorted(itertools.product(range(side), repeat=2), key=lambda c: sum(((c[0] >> i & 1) << 2 * i) | ((c[1] >> i & 1) << (2 * i + 1)) for i in range(k)))
        low = np.array(order, float) / side
        n, band = 0, farfield._levels(low, low + 1 / side, 4)
        live, level = np.array([0]), len(band) - 1
        delta, here = farfield.separation(1e-6, 2), np.array([0.4, 0.6])
        while level and len(live):
            a, b = band[level][0][live], band[level][1][live]
            gap = np.sqrt((np.maximum(0, np.maximum(a - here, here - b)) ** 2).sum(axis=1))
            far = gap >= delta * ((b - a) / 2).max(axis=1)
            n += int(far.sum())
            live = (live[~far][:, None] * 4 + np.arange(4)).ravel()
            level -= 1
        asked.append(n + len(live))
    steps = np.diff(asked)
    assert steps[-1] <= 1.3 * max(steps[0], steps[1]) and asked[-1] < 4**7 / 20


def test_few_features_equal_the_tree(spark, monkeypatch):
    r = np.random.default_rng(14)
    targets = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(r.integers(0, 20, (300, 2)))] + [(900, None, 1.0)], "id long, x double, y double")
    at = r.integers(0, 20, (40, 4)).astype(float)
    dots = spark.createDataFrame([(i, *p[:2].tolist(), [1.0, 2.0]) for i, p in enumerate(at)] + [(99, None, 1.0, None)], "id long, x double, y double, more array<double>")
    segments = spark.createDataFrame([(i, *p.tolist()) for i, p in enumerate(at)], "gid long, x0 double, y0 double, x1 double, y1 double")
    boxes = segments.selectExpr("gid", "least(x0, x1) as xmin", "least(y0, y1) as ymin", "greatest(x0, x1) as xmax", "greatest(y0, y1) as ymax")

    def nearest(features, f_gap):
        found = near.nearest_candidates(targets, features)
        gap = found.withColumn("d", f_gap)
        best = gap.join(gap.groupBy("id").agg(F.min("d").alias("best")), "id").where("d <= best")
        return sorted(map(str, best.drop("more").distinct().collect()))

    to_dot = F.sqrt((F.col("x") - F.col("f_x")) ** 2 + (F.col("y") - F.col("f_y")) ** 2)
    to_segment = distance.segment_distance(*(F.col(c) for c in ("x", "y", "x0", "y0", "x1", "y1")))
    one = nearest(dots, to_dot), nearest(segments, F.round(to_segment, 9)), sorted(map(str, near.within_candidates(targets, boxes, 1.5).collect()))
    assert near.nearest_candidates(targets, dots.limit(0)) is None and near.within_candidates(targets, boxes.limit(0), 1.0) is None
    monkeypatch.setattr(near, "FEW", -1)
    monkeypatch.setattr(near, "FEW_MORE", -1)
    two = nearest(dots, to_dot), nearest(segments, F.round(to_segment, 9)), sorted(map(str, near.within_candidates(targets, boxes, 1.5).collect()))
    assert one == two


def star(r, n, cx, cy, size):
    angles = [2 * math.pi * (i + r.uniform(0, 0.8)) / n for i in range(n)]
    return [(cx + f * math.cos(a), cy + f * math.sin(a)) for a in angles for f in [size * r.uniform(0.2, 1)]]


def test_cut_polygons_equal_their_points():
    """A point of the box is in one of the parts exactly if it is in the polygon."""
    r = random.Random(8)
    for _ in range(150):
        shell = star(r, r.randrange(7, 20), 5, 5, 5)
        hole = [(5 + (x - 5) * 0.15, 5 + (y - 5) * 0.15) for x, y in shell]
        box = (r.uniform(0, 5), r.uniform(0, 5), r.uniform(5, 10), r.uniform(5, 10))
        parts = cut.cut_polygon([shell, hole], *box)
        inside = lambda rings, p: sum(cut.holds(x, p) for x in rings) % 2 == 1
        for _ in range(60):
            p = r.uniform(0, 10), r.uniform(0, 10)
            within = box[0] < p[0] < box[2] and box[1] < p[1] < box[3]
            assert sum(inside(q, p) for q in parts) == int(within and inside([shell, hole], p))


def test_cut_gives_parts_and_keeps_holes(spark):
    u = [(0, 0), (9, 0), (9, 9), (6, 9), (6, 3), (3, 3), (3, 9), (0, 9)]
    hole = [(1, 6), (2, 6), (2, 7), (1, 7)]
    rings = lambda *rs: [[{"x": float(x), "y": float(y)} for x, y in [*r, r[0]]] for r in rs]
    rows = [(1, rings(u, hole), "a"), (2, rings([(20, 20), (30, 20), (30, 30)]), "b"), (3, None, "c"), (4, rings([(5, 5), (5.5, 5), (5.5, 6)]), "d"), (5, rings([(0, 0), (4, 4)]), "e")]
    df = spark.createDataFrame(rows, "gid long, rings array<array<struct<x: double, y: double>>>, name string")
    got = {(x.gid, x.part): x for x in clean.clip_polygons(df, Extent(-1.0, 4.0, 20.0, 20.0)).collect()}
    assert sorted(got) == [(1, 0), (1, 1), (4, 0)]
    area = lambda r: abs(cut.area([(v.x, v.y) for v in r[:-1]]))
    assert [area(r) for r in got[1, 0].rings] == [15, 1] and [area(r) for r in got[1, 1].rings] == [15]
    # A hole that reaches the border opens its shell.
    (one,) = [x for x in clean.clip_polygons(df.where("gid = 1"), Extent(-1.0, 6.5, 2.5, 20.0)).collect()]
    assert len(one.rings) == 1 and area(one.rings[0]) == 2.5 * 2.5 - 0.5
    assert clean.clip_polygons(df.limit(0), Extent(0.0, 0.0, 1.0, 1.0)).count() == 0


def searched(value, start, low, high):
    """A coordinate search, to compare with."""
    v, step, best = start.copy(), np.full(len(start), 0.5), value(start)[0]
    for _ in range(25):
        for i in range(len(v)):
            for sign in (1, -1):
                w = v.copy()
                w[i] = np.clip(v[i] + sign * step[i], low[i], high[i])
                if (now := value(w)[0]) > best:
                    v, best, step[i] = w, now, step[i] * 1.3
                    break
            else:
                step[i] /= 2
    return best


def test_gp_ascent_has_right_gradients_and_beats_a_search(monkeypatch):
    plain, seen = gp.ascend, []

    def checked(value, start, low, high):
        f, g = value(start)
        for i in range(len(start)):
            e = np.zeros(len(start))
            e[i] = 1e-5
            numeric = (value(start + e)[0] - value(start - e)[0]) / 2e-5
            assert abs(numeric - g[i]) < 1e-4 * max(1.0, abs(numeric))
        x, best = plain(value, start, low, high)
        seen.append((best, searched(value, start, low, high)))
        return x, best

    monkeypatch.setattr(gp, "ascend", checked)
    for seed in range(5):
        r = np.random.default_rng(seed)
        x = r.uniform(-1, 1, (150, 2))
        gp.fit(x, np.sin((2 + seed) * x[:, 0]) * np.cos(3 * x[:, 1]) + 0.1 * r.normal(size=150), n_inducing=25)
    assert len(seen) == 5 and all(a >= b - 1e-3 * abs(b) for a, b in seen)


def test_gp_is_the_same_on_both_sides(spark):
    r = np.random.default_rng(9)
    x = r.uniform(-1, 1, (200, 2))
    rows = points(spark, x, np.sin(3 * x[:, 0]) + 0.05 * r.normal(size=200))
    one, two = gp.fit_rows(rows, n_inducing=20), gp.fit_rows(rows, n_inducing=20, local=10)
    at = r.uniform(-1, 1, (50, 2))
    assert abs(one.log_likelihood - two.log_likelihood) < 1e-3 and np.abs(one.predict(at)[0] - two.predict(at)[0]).max() < 1e-4


def test_prediction_grid(spark):
    r = np.random.default_rng(12)
    x = r.uniform(-1, 1, (60, 2))
    model = gp.fit(x, x[:, 0], n_inducing=20)
    cells = points(spark, np.array([[0.0, 0.0], [0.5, 0.0], [0.0, 0.5], [0.0, 0.5]]), np.zeros(4))
    got = {(c.ix, c.iy): (c.prediction, c.sigma) for c in gp.prediction_grid(cells, model, (2.0, 3.0)).collect()}
    mean, sigma = model.predict(np.array([[0.0, 0.0], [0.5, 0.0], [0.0, 0.5]]))
    assert got[1, 1] == (None, None) and len(got) == 4
    assert [got[k] for k in ((0, 0), (1, 0), (0, 1))] == [pytest.approx((2 + 3 * m, 3 * s)) for m, s in zip(mean, sigma, strict=True)]


def test_fault_traces_as_rows_equal_arrays(spark, monkeypatch):
    monkeypatch.setattr(structure, "CHUNK", 7)
    r = random.Random(13)
    rows = [(i, r.randrange(3), float(r.randrange(9)), float(r.randrange(9)), -float(r.randrange(5))) for i in range(200)]
    df = spark.createDataFrame([*rows, (900, None, 1.0, 1.0, -4.0), (901, 1, 1.0, None, -2.0)], "gid long, fault_id long, x double, y double, z double")
    for traces, arrays in ((structure.trace_rows_top(df), structure.fault_traces_top(df)), (structure.trace_rows_bottom(df, 1.0), structure.fault_traces_bottom(df, 1.0))):
        got = {}
        for v in traces.orderBy("fault", "seq").collect():
            got.setdefault(v.fault, []).append((v.seq, v.x, v.y))
        expected = {t.fault: [(i, v.x, v.y) for i, v in enumerate(t.trace, 1)] for t in arrays.collect()}
        assert got == expected
    assert structure.trace_rows_top(df.limit(0)).count() == 0


def test_resamples_are_exact_and_stable(spark):
    r = np.random.default_rng(10)
    df = points(spark, r.normal(size=(3000, 2)), r.normal(size=3000))
    sizes = gp.resamples(df, "value", 5, 200).groupBy("sample").agg(F.count("*").alias("n"), F.count_distinct("gid").alias("d")).collect()
    assert [(x.n, x.d) for x in sizes] == [(200, 200)] * 5
    a, b = (sorted(map(tuple, gp.bootstrap_residuals(df.repartition(p), "value", 5, 200).collect())) for p in (1, 7))
    assert a == b and len(a) == 5
    tied = df.withColumn("value", F.col("gid") % 3)
    assert len(gp.bootstrap_residuals(tied, "value", 3, 100).collect()) == 5
    constant = {x.test: x.mean_p for x in gp.bootstrap_residuals(df.withColumn("value", F.lit(2.0)), "value", 3, 100).collect()}
    assert set(constant.values()) == {1.0}
    assert gp.resamples(df.limit(10), "value", 4, 200).count() == 40
    assert gp.bootstrap_residuals(df.limit(0), "value", 3, 100).count() == 0
    assert gp.resamples(tied.drop("gid"), "value", 2, 50).groupBy("sample").count().select("count").distinct().collect()[0][0] == 50


def test_lines_merge(spark):
    r = random.Random(11)
    path = [(float(i), float(i * i % 7)) for i in range(45)]
    ring = [(100.0, 0.0), (101.0, 0.0), (101.0, 1.0), (100.5, 2.0), (100.0, 1.0)]
    fork = [((200.0, 0.0), (201.0, 0.0)), ((201.0, 0.0), (202.0, 1.0)), ((201.0, 0.0), (202.0, -1.0))]
    segments = list(zip(path, path[1:], strict=False)) + list(zip(ring, ring[1:] + ring[:1], strict=True)) + fork
    segments = [s if r.random() < 0.5 else s[::-1] for s in segments]
    r.shuffle(segments)
    rows = [(*a, *b) for a, b in segments] + [(1.0, 1.0, 1.0, 1.0), (None, 1.0, 2.0, 3.0), (*segments[0][1], *segments[0][0])]
    got = {}
    for x in lines.merge_lines(spark.createDataFrame(rows, "x0 double, y0 double, x1 double, y1 double")).orderBy("line", "seq").collect():
        got.setdefault(x.line, []).append((x.x, x.y))
    found = sorted(got.values(), key=lambda v: (-len(v), v))
    assert found[0] == path
    assert len(found[1]) == 6 and found[1][0] == found[1][-1]
    turned = found[1][:-1]
    at = turned.index(ring[0])
    turned = turned[at:] + turned[:at]
    assert turned in (ring, ring[:1] + ring[:0:-1])
    assert sorted(tuple(sorted(v)) for v in found[2:]) == sorted(tuple(sorted(s)) for s in fork)
    assert lines.merge_lines(spark.createDataFrame([], "x0 double, y0 double, x1 double, y1 double")).count() == 0
    vertices = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "line long, seq long")
    values = spark.createDataFrame([(1, 5.0), (2, 6.0), (9, 7.0)], "seq long, value double")
    assert [x.value for x in lines.padded_values(vertices, values).orderBy("seq").collect()] == [5.0, 6.0, None]


def test_vertical_systems(spark):
    levels = spark.createDataFrame([("epsg:5703", float(x), float(y), float(x + 2 * y + x * y)) for x in range(4) for y in range(3)], "system string, x double, y double, n double")
    df = spark.createDataFrame([(0.5, 0.25, 10.0), (3.0, 2.0, 0.0), (1.0, 1.0, None), (5.0, 1.0, 1.0)], "x double, y double, z double")
    got = clean.convert_z(df, "EPSG:5703", clean.ELLIPSOIDAL, undulations=levels).orderBy("x").collect()
    assert [x.z for x in got] == [10 + 0.5 + 0.5 + 0.125, None, 13.0, None]
    back = clean.convert_z(df, clean.ELLIPSOIDAL, "epsg:5703", undulations=levels).orderBy("x").first()
    assert back.z == 10 - 1.125
    assert clean.convert_z(df, "epsg:5703", "EPSG:5703") is df
    for target in ("epsg:9999", "epsg:5703"):
        with pytest.raises(ValueError, match="no undulations"):
            clean.convert_z(df, clean.ELLIPSOIDAL, target, undulations=levels if target.endswith("9") else None)


def test_lattice_in_sql(spark):
    sqlfuncs.register(spark)
    e = Extent(0.5, 1.0, 7.25, 3.0)
    whole = spark.sql("select * from fv_lattice(0.5D, 1.0D, 7.25D, 3.0D, 5, 4)")
    rows = spark.sql("select l.* from range(4) r, lateral fv_lattice_row(0.5D, 1.0D, 7.25D, 3.0D, 5, 4, cast(r.id as int)) l")
    expected = sorted(map(tuple, grid.lattice(spark, e, 5, 4).collect()))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, rows.collect())) == expected
