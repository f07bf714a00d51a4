"""Statistics, geometry, files and models outside the registered queries."""

import itertools
import math
import random

import numpy as np
import pytest
from favora.functions import crs, geometry, stats, transforms
from favora.operators import distance, gp, grid, interpolate, kriging, near, structure
from favora.sources import readers, writers
from pyspark.sql import functions as F


@pytest.fixture(autouse=True)
def by_tree(monkeypatch):
    """These tables are few; the tests are of the tree."""
    monkeypatch.setattr(near, "FEW", -1)
    monkeypatch.setattr(near, "FEW_MORE", -1)


@pytest.mark.parametrize("q", [0.0, 0.1, 0.37, 0.5, 0.9, 1.0])
def test_exact_quantile_by_bracket(spark, monkeypatch, q):
    monkeypatch.setattr(stats, "SMALL", 0)
    r = random.Random(1)
    values = {k: [r.choice([r.random(), 5.0]) for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 4), ("d", 3001))}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("a", None)], "k string, v double")
    for row in stats.exact_quantile(df, "v", q, ["k"]).collect():
        assert row[1] == pytest.approx(np.quantile(values[row[0]], q))
    assert stats.quantile(df, "v", q) == pytest.approx(np.quantile(sum(values.values(), []), q))


def test_nearest_candidates_hold_the_nearest(spark):
    r = random.Random(2)
    points = [(i, r.gauss(0, 1) ** 3 * 50, r.random() * 10) for i in range(400)]
    nodes = [(i, r.uniform(-300, 300), r.uniform(-50, 60)) for i in range(200)]
    f = spark.createDataFrame(points, "o long, x double, y double")
    t = spark.createDataFrame(nodes, "ix long, x double, y double")
    got = near.nearest_candidates(t, f).groupBy("ix").agg(F.min(F.hypot(F.col("x") - F.col("f_x"), F.col("y") - F.col("f_y"))).alias("d")).collect()
    best = {i: min(math.hypot(x - a, y - b) for _, a, b in points) for i, x, y in nodes}
    assert {x.ix: round(x.d, 9) for x in got} == {k: round(v, 9) for k, v in best.items()}


def to_segment(p, a, b):
    step = np.subtract(b, a)
    t = np.clip(np.dot(np.subtract(p, a), step) / max(np.dot(step, step), 1e-300), 0, 1)
    return float(np.linalg.norm(np.subtract(p, a) - t * step))


def test_nearest_among_clusters_and_outliers(spark, monkeypatch):
    """Candidates stay few where almost all features sit in one place, far from the targets."""
    monkeypatch.setattr(near, "LEAF", 64)
    r = np.random.default_rng(3)
    n = 20000
    points = np.concatenate([r.normal(0, 1e-3, (n, 2)), [[1e6, 1e6]], np.zeros((500, 2))])
    targets = np.concatenate([r.uniform(-50, 50, (60, 2)), r.normal(0, 1e-3, (60, 2)), [[1e6, 9e5]]])
    f = spark.createDataFrame([(i, *p) for i, p in enumerate(points.tolist())], "o long, x double, y double")
    t = spark.createDataFrame([(i, *p) for i, p in enumerate(targets.tolist())], "ix long, x double, y double")
    found = near.nearest_candidates(t, f.groupBy("x", "y").agg(F.min("o").alias("o")))
    got = found.groupBy("ix").agg(F.count("*").alias("n"), F.min(F.hypot(F.col("x") - F.col("f_x"), F.col("y") - F.col("f_y"))).alias("d")).collect()
    gaps = np.sqrt(((targets[:, None] - points[None]) ** 2).sum(axis=2)).min(axis=1)
    assert {x.ix: x.d for x in got} == {i: pytest.approx(g) for i, g in enumerate(gaps)}
    # One feature of each leaf that is searched, of more than 300.
    assert max(x.n for x in got) <= 40


def test_nearest_segments_boxes_and_k(spark, monkeypatch):
    monkeypatch.setattr(near, "LEAF", 7)
    monkeypatch.setattr(near, "GROUP", 16)
    r = np.random.default_rng(4)
    targets = r.integers(0, 60, (150, 3)).astype(float)
    t = spark.createDataFrame([(i, *p) for i, p in enumerate(targets.tolist())], "ix long, x double, y double, z double")
    ends = r.integers(0, 60, (90, 4)).astype(float)
    ends[:10, 2:] = ends[:10, :2]
    lines = spark.createDataFrame([(i, *p) for i, p in enumerate(ends.tolist())], "gid long, x0 double, y0 double, x1 double, y1 double")
    got = distance.distance_from_lines(t.drop("z"), lines).collect()
    assert {x.ix: x.distance for x in got} == {i: pytest.approx(min(to_segment(p[:2], e[:2], e[2:]) for e in ends), abs=1e-9) for i, p in enumerate(targets)}
    within = {(x.ix, x.gid) for x in near.within_candidates(t, lines, 5.0).collect()}
    low, high = np.minimum(ends[:, :2], ends[:, 2:]), np.maximum(ends[:, :2], ends[:, 2:])
    gap = np.sqrt((np.maximum(0, np.maximum(low[None] - targets[:, None, :2], targets[:, None, :2] - high[None])) ** 2).sum(axis=2))
    assert within == {(int(i), int(j)) for i, j in zip(*np.nonzero(gap <= 5.0), strict=True)}
    touch = sorted((x.gid, x.f_gid) for x in near.touching(lines).collect())
    both = (low[:, None] <= high[None]).all(axis=2) & (low[None] <= high[:, None]).all(axis=2)
    assert touch == sorted((int(i), int(j)) for i, j in zip(*np.nonzero(both), strict=True))
    points = r.integers(0, 60, (200, 3)).astype(float)
    f = spark.createDataFrame([(i, *p) for i, p in enumerate(points.tolist())], "o long, x double, y double, z double")
    for k in (1, 5, 40, 200):
        found = {}
        for x in near.nearest_candidates(t, f, ("x", "y", "z"), k).select("ix", "o").collect():
            found.setdefault(x.ix, set()).add(x.o)
        for i, p in enumerate(targets):
            d = ((points - p) ** 2).sum(axis=1)
            assert set(np.flatnonzero(d < np.sort(d)[k - 1]).tolist()) <= found[i]
            assert len(found[i]) >= k
    assert near.nearest_candidates(t, f.limit(0)) is None
    assert near.nearest_candidates(t.limit(0), f).count() == 0


def test_influence_in_packs(spark, monkeypatch):
    monkeypatch.setattr(distance, "BLOCK", 30)
    monkeypatch.setattr(distance, "NODES", 20)
    r = np.random.default_rng(5)
    points, w = r.integers(0, 12, (200, 2)).astype(float), r.random(200)
    nodes = r.integers(0, 25, (70, 2)) / 2
    given = spark.createDataFrame([(i, *p, float(x)) for i, (p, x) in enumerate(zip(points.tolist(), w, strict=True))], "gid long, x double, y double, w double")
    at = spark.createDataFrame([(i, 0, *p) for i, p in enumerate(nodes.tolist())], "ix long, iy long, x double, y double")
    d = np.sqrt(((nodes[:, None] - points[None]) ** 2).sum(axis=2))
    s = w * np.exp(-d / 3)
    order = np.lexsort((np.broadcast_to(np.arange(200), d.shape), d.round(12)))[:, :9]
    expected = {"sum": s.sum(axis=1), "mean": s.mean(axis=1), "max": s.max(axis=1), "knearest": np.take_along_axis(s, order, 1).sum(axis=1)}
    for mode, values in expected.items():
        got = {x.ix: x.weighted_point_score for x in distance.influence(at, given, 3.0, mode, 9).collect()}
        assert got == {i: pytest.approx(v) for i, v in enumerate(values)}


@pytest.mark.parametrize("small", [0, 100_000])
def test_ranks_of_groups(spark, monkeypatch, small):
    monkeypatch.setattr(grid, "SMALL", small)
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 1000 / 8).alias("x"))
    got = grid.ranked(df.union(df), "x", ["k"]).collect()
    assert len(got) == 3000
    for k in range(3):
        of = sorted((r.x, r.ix) for r in got if r.k == k)
        assert [i for _, i in of] == list(range(1000))


def test_ranks_of_three_million_coordinates(spark):
    df = spark.range(3_000_000).select((F.col("id") * 7 % 3_000_017 / 4).alias("x"))
    got = grid.ranked(df, "x").agg(F.count("*"), F.count_distinct("ix"), F.min("ix"), F.max("ix"), F.count_if(F.col("x") < 0)).first()
    assert tuple(got)[:4] == (3_000_000, 3_000_000, 0, 2_999_999)
    table = grid.ranked(df, "x")
    assert table.where("ix in (0, 1000000, 2999999)").join(df.agg(F.min("x").alias("x")), "x").count() == 1
    with pytest.raises(ValueError, match="sparse"):
        grid.rasterize(df.select("x", F.col("x").alias("y"), F.col("x").alias("v")).where("x % 97 = 0").limit(200_000), "v")


def brute_delaunay(points, values, node):
    """Value of the simplex around a node whose circumsphere is empty, trying all."""
    d = len(node)
    best = None
    for some in itertools.combinations(range(len(points)), d + 1):
        at = points[list(some)]
        matrix = np.vstack([at.T, np.ones(d + 1)])
        if abs(np.linalg.det(matrix)) < 1e-12:
            continue
        w = np.linalg.solve(matrix, np.append(node, 1))
        if w.min() < -1e-9:
            continue
        centre = np.linalg.solve(2 * (at[1:] - at[0]), (at[1:] ** 2).sum(axis=1) - (at[0] ** 2).sum())
        radius = ((at[0] - centre) ** 2).sum()
        if (((points - centre) ** 2).sum(axis=1) >= radius * (1 - 1e-9)).all():
            best = float(w @ values[list(some)])
    return best


@pytest.mark.parametrize(("axes", "n"), [("xy", 40), ("xyz", 16)])
def test_linear_interpolation(spark, monkeypatch, axes, n):
    """Few neighbours at first, so that most simplices are found by added points."""
    monkeypatch.setattr(interpolate, "NEIGHBOURS", 4)
    monkeypatch.setattr(interpolate, "MORE", 2)
    monkeypatch.setattr(near, "LEAF", 8)
    r = np.random.default_rng(6)
    points, values = r.normal(0, 1, (n, len(axes))), r.normal(0, 1, n)
    nodes = np.concatenate([r.uniform(-2, 2, (60, len(axes))), points[:3]])
    kinds = ", ".join(f"{a} double" for a in axes)
    given = spark.createDataFrame([(*p, float(v)) for p, v in zip(points.tolist(), values, strict=True)] + [(*points[0].tolist(), float(values[0])), (*points[1].tolist(), None)], f"{kinds}, value double")
    at = spark.createDataFrame([(i, *p) for i, p in enumerate(nodes.tolist())], f"ix long, {kinds}")
    got = {x.ix: x.value_interpolated for x in interpolate.linear(at, given).collect()}
    expected = {i: brute_delaunay(points, values, p) for i, p in enumerate(nodes)}
    assert any(v is None for v in expected.values())
    for i, v in expected.items():
        assert got[i] == (None if v is None else pytest.approx(v, abs=1e-5)), i
    line = given.limit(5).withColumn("y", F.lit(0.0)).withColumns({a: F.lit(0.0) for a in axes[2:]})
    assert {x.value_interpolated for x in interpolate.linear(at.where("ix < 60"), line).collect()} == {None}
    assert {x.value_interpolated for x in interpolate.linear(at, given.limit(0)).collect()} == {None}


def test_kriging_of_many_points(spark):
    """More points than one system takes are solved in the tasks, with the same variogram and the same result."""
    r = np.random.default_rng(7)
    points = r.uniform(0, 10, (600, 2))
    values = np.sin(points[:, 0]) + 0.3 * points[:, 1]
    given = spark.createDataFrame([(*p, float(v)) for p, v in zip(points.tolist(), values, strict=True)], "x double, y double, value double")
    nodes = np.concatenate([r.uniform(0, 10, (80, 2)), points[:2]])
    at = spark.createDataFrame([(i, *p) for i, p in enumerate(nodes.tolist())], "ix long, x double, y double")
    whole = {x.ix: x.value_interpolated for x in interpolate.kriging(at, given).collect()}
    got = {x.ix: x.value_interpolated for x in interpolate.kriging(at, given, whole=10).collect()}
    packs = kriging.packed(given.withColumnRenamed("value", "v"), ("x", "y"))
    assert kriging.variogram(packs, 2)[:2] == pytest.approx(kriging.fit_variogram(points, values), rel=1e-6)
    assert got[80] == pytest.approx(values[0]) and got[81] == pytest.approx(values[1])
    assert all(got[i] == pytest.approx(v, abs=1e-6) for i, v in whole.items())


def test_unknown_methods_raise(spark):
    df = spark.createDataFrame([(1.0,)], "v double")
    for f in (transforms.transform_layer, transforms.normalize_layer):
        with pytest.raises(ValueError, match="unknown"):
            f(df, "v", "other")


def test_projections_round_trip(spark):
    df = spark.createDataFrame([(-121.25, 43.7), (9.0, 48.5)], "x double, y double")
    for code in (3857, 26910, 32632, 32733):
        back = crs.reproject(crs.reproject(df, 4326, code), code, 4326).collect()
        for a, b in zip(df.collect(), back, strict=True):
            if code in (3857,) or abs(a.x - ((code % 100) * 6 - 183)) < 10:
                assert (b.x, b.y) == pytest.approx((a.x, a.y), abs=1e-7)
    # A point on the central meridian: easting 500 km, northing 0.9996 of the meridian arc.
    one = crs.reproject(spark.createDataFrame([(9.0, 0.0)], "x double, y double"), 4326, 32632).first()
    assert (one.x, one.y) == pytest.approx((500000.0, 0.0), abs=1e-6)
    with pytest.raises(ValueError, match="unsupported"):
        crs.reproject(df, 4326, 2056)
    with pytest.raises(ValueError, match="invalid"):
        crs.parse("nowhere")


@pytest.mark.parametrize("text", ["POINT (1 2)", "POINT Z (1 2 3)", "LINESTRING (0 0, 1 1)", "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))", "MULTIPOINT ((1 2), (3 4))", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))"])
def test_wkt(spark, text):
    df = spark.createDataFrame([(text,)], "w string").select(geometry.from_wkt(F.col("w")).alias("g")).cache()
    got = df.select(geometry.to_wkt(F.col("g"))).first()[0]
    assert got.replace(".0", "") == text


def test_kriging_is_exact_at_points(spark):
    r = random.Random(3)
    rows = [(i, r.random() * 10, r.random() * 10, r.random()) for i in range(30)]
    points = spark.createDataFrame(rows, "gid long, x double, y double, value double")
    at = points.select(F.col("gid").alias("ix"), F.lit(0).alias("iy"), "x", "y")
    got = {x.ix: x.value_interpolated for x in interpolate.kriging(at, points).collect()}
    assert all(got[i] == pytest.approx(v, abs=1e-6) for i, _, _, v in rows)


def test_gaussian_process_on_held_out_points(tmp_path):
    r = np.random.default_rng(0)
    x = r.uniform(-1, 1, (400, 2))
    y = np.sin(3 * x[:, 0]) * np.cos(2 * x[:, 1])
    model = gp.fit(x[:300], y[:300])
    gp.save_model(model, str(tmp_path / "m.npz"))
    mean, sigma = gp.load_model(str(tmp_path / "m.npz")).predict(x[300:])
    assert np.sqrt(((mean - y[300:]) ** 2).mean()) < 0.25
    assert (sigma > 0).all()
    with pytest.raises(FileNotFoundError):
        gp.load_model(str(tmp_path / "none.npz"))
    with pytest.raises(ValueError, match="kernel"):
        gp.combined_kernel(1, 1, False, False, False, False, False)


def test_files(spark, tmp_path):
    points = spark.createDataFrame([("A", 1.5, 2.5), ("B", -3.0, 4.0)], "name string, x double, y double")
    writers.write_point_shapefile(points, str(tmp_path / "p.shp"), 4326)
    back = readers.read_shapefile(spark, str(tmp_path / "p.shp")).orderBy("gid").collect()
    assert [(x.kind, x.parts[0][0].x, x.attributes["name"]) for x in back] == [("POINT", 1.5, "A"), ("POINT", -3.0, "B")]
    writers.write_csv(points, str(tmp_path / "c"), 4326)
    csv = readers.read_csv(spark, str(tmp_path / "c"), "EPSG:4326", geometry_col="geometry")
    assert sorted(csv.selectExpr("geometry.parts[0][0][0].x").toPandas().iloc[:, 0]) == [-3.0, 1.5]
    with pytest.raises(ValueError, match="go together"):
        readers.read_csv(spark, str(tmp_path / "c"), 4326, x_col="name")
    (tmp_path / "t.tec").write_text('TITLE = "t"\nVARIABLES = "X" "Y" "V"\nZONE\n1 2 3\n4 5 abc\n6 7\n')
    assert [tuple(x) for x in readers.read_tec(spark, str(tmp_path / "t.tec")).orderBy("X").collect()] == [(1.0, 2.0, "3"), (4.0, 5.0, "abc"), (6.0, 7.0, None)]
    (tmp_path / "w.csv").write_text("md,e,n,d\n2,1,1,5\n1,0,0,0\n3,1,1,5\n")
    well = readers.read_well_path_csv(spark, str(tmp_path / "w.csv"), "e", "n", "d", md_col="md").orderBy("seq").collect()
    assert [(x.seq, x.x, x.z) for x in well] == [(1, 0.0, 0.0), (2, 1.0, 5.0)]


def test_tif(spark, tmp_path):
    import struct

    values = np.array([[1, 2], [3, -9]], "<f4").tobytes()
    tags = [(256, 3, 1, 2), (257, 3, 1, 2), (258, 3, 1, 32), (259, 3, 1, 1), (273, 4, 1, 8), (279, 4, 1, 16), (339, 3, 1, 3)]
    body = struct.pack("<2sHI", b"II", 42, 24) + values + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + b"\0" * 4
    (tmp_path / "r.tif").write_bytes(body)
    got = sorted(tuple(x) for x in readers.read_tif(spark, str(tmp_path / "r.tif")).collect())
    assert got == [(0.5, 0.5, 3.0), (0.5, 1.5, 1.0), (1.5, 0.5, -9.0), (1.5, 1.5, 2.0)]


def test_model_of_many_rows_equals_the_local_one(spark):
    r = np.random.default_rng(8)
    x = r.uniform(-2, 2, (400, 2))
    y = np.sin(x[:, 0]) * np.cos(x[:, 1]) + 0.05 * r.normal(size=400)
    rows = spark.createDataFrame([(*a, float(b)) for a, b in zip(x.tolist(), y, strict=True)], "x double, y double, value double")
    z = gp.kmeans(x, 20)
    parts = gp.combined_kernel(float(y.var()), 2.0)
    one, two = gp.local_sums(parts, x, y - 0.25, z), gp.row_sums(rows.repartition(5), parts, 0.25, z)
    assert two.n == 400
    for a, b in zip(one, two, strict=True):
        assert np.allclose(a, b)
    model = gp.fit_rows(rows, n_inducing=20, local=100)
    assert model.n_used == 400
    assert np.sqrt(((model.predict(x)[0] - y) ** 2).mean()) < 0.15
    assert gp.noise_bounds(model)[0] <= model.noise <= gp.noise_bounds(model)[1]
    assert set(gp.limits_hit(model)) <= {"noise", *(f"{p.kind}.{n}" for p in model.parts for n in ("variance", "lengthscale"))}
    row = gp.assess(gp.predict(rows, model).withColumn("v", F.col("value")), "v", model=model).first()
    k = gp.n_parameters(model)
    assert row.aic == pytest.approx(2 * k - 2 * row.log_likelihood) and row.bic == pytest.approx(k * math.log(400) - 2 * row.log_likelihood)
    assert gp.report({"rmse": 0.2, "r2": 0.5, "coverage": 0.5}) and not gp.report({"rmse": 0.01, "r2": 0.9, "coverage": 0.95})


def test_kernels():
    a, b = np.array([[0.0, 0.0]]), np.array([[3.0, 4.0]])
    rbf, matern = gp.Part("rbf", 2.0, (1, 3), (5.0, 5.0)), gp.Part("matern32", 2.0, (1, 3), (5.0, 5.0))
    assert gp.covariance([rbf], a, b)[0, 0] == pytest.approx(2 * math.exp(-0.5))
    assert gp.covariance([matern], a, b)[0, 0] == pytest.approx(2 * (1 + math.sqrt(3)) * math.exp(-math.sqrt(3)))
    both = gp.covariance([rbf, matern, gp.Part("bias", 1.0, (1, 1)), gp.Part("white", 0.5, (0.5, 0.5))], a, a, same=True)
    assert both[0, 0] == pytest.approx(2 + 2 + 1 + 0.5)


def test_residual_tests_hold_their_level():
    """Under the null hypothesis p-values are even on (0, 1), and far from it they are small."""
    r = np.random.default_rng(9)
    for n in (9, 40, 300):
        found = [gp.residual_statistics(r.normal(size=n)) for _ in range(400)]
        for test in found[0]:
            p = np.array([f[test] for f in found])
            share = (p < 0.05).mean()
            assert 0.0 <= share <= 0.12, (test, n, share)
            if n == 300:
                assert 0.4 < np.median(p) < 0.6, (test, np.median(p))
    skewed = gp.residual_statistics(r.exponential(size=300))
    assert max(skewed[t] for t in ("shapiro_wilk", "dagostino", "jarque_bera")) < 1e-6
    walk = gp.residual_statistics(np.cumsum(r.normal(size=300)))
    assert walk["ljung_box"] < 1e-6
    assert gp.residual_statistics(np.concatenate([r.normal(size=150), 5 * r.normal(size=150)]))["levene"] < 1e-6
    # Tabulated values: F(1, 10) at 4.965 and chi-squared with 3 degrees of freedom at 7.815 are exceeded in one of 20.
    assert gp.f_tail(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-4)
    assert gp._chi2_tail(7.8147, 3) == pytest.approx(0.05, abs=1e-4)


def test_well_paths_over_ranges(spark):
    r = random.Random(10)
    rows = [(i, float(r.randrange(3)), 0.0, float(-(i // 7))) for i in range(3000)]
    df = spark.createDataFrame(rows, "seq long, x double, y double, z double").repartition(5)
    kept = [row for k, row in enumerate(rows) if not k or row[1:] != rows[k - 1][1:]]
    got = structure.well_path(df).orderBy("seq").collect()
    assert [(x.seq, x.x, x.y, x.z) for x in got] == [(i + 1, *row[1:]) for i, row in enumerate(kept)]
    both = df.withColumn("well", F.col("seq") % 2)
    split = structure.well_path(both, keys=["well"]).where("well = 1").orderBy("seq").collect()
    odd = [row for row in rows if row[0] % 2]
    assert [(x.x, x.z) for x in split] == [(row[1], row[3]) for k, row in enumerate(odd) if not k or row[1:] != odd[k - 1][1:]]
    with pytest.raises(ValueError, match="two points"):
        structure.well_path(df.limit(1))


def test_fault_surfaces(spark):
    r = np.random.default_rng(11)
    points = {k: r.integers(0, 20, (n, 2)).astype(float) for k, n in ((1, 200), (2, 9), (3, 2))}
    points[4] = np.array([[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]])
    df = spark.createDataFrame([(k, *p, 1.0) for k, ps in points.items() for p in ps.tolist()], "fault_id int, x double, y double, z double")
    got = {x.fault: x for x in structure.fault_surfaces(df).collect()}
    assert set(got) == {1, 2}
    for k in got:
        # A corner is a point that some direction has furthest out, alone.
        angles = np.linspace(0, 2 * np.pi, 20001)
        far = (np.unique(points[k], axis=0) @ np.array([np.cos(angles), np.sin(angles)])).argmax(axis=0)
        corners = np.unique(points[k], axis=0)[np.unique(far)]
        assert {tuple(v) for v in got[k].hull} == {tuple(c) for c in corners.tolist()}
        centre = corners.mean(axis=0)
        round_ = corners[np.argsort(np.arctan2(*(corners - centre).T[::-1]))]
        x, y = round_.T
        assert got[k].area == pytest.approx(abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2)
