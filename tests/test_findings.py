"""Faults found by review: each test fails on the code before its mend."""

import duckdb
import numpy as np
import pytest

from favora.llm import pii
from favora.operators import distance, grid, interpolate, kriging
from favora.operators.grid import Extent
from favora.plans import spatial

LINES = [(1, 0.0, 0.0, 10.0, 0.0), (2, 4.0, 0.0, 12.0, 0.0), (3, 2.0, -1.0, 2.0, 1.0), (4, 11.0, -1.0, 11.0, 1.0)]
SEGMENTS = "gid long, x0 double, y0 double, x1 double, y1 double"


def _supplied(path, keys):
    duckdb.sql(f"copy (select cast(unnest({keys}) as bigint) as s_suppkey) to '{path}/supplier.parquet' (format parquet)")
    return str(path)


@pytest.mark.parametrize("name", ["j7_calculate_intersections", "j7_calculate_intersections_overlaps", "d7_vectorized_distance", "d8_distance_with_intersections", "d11_process_faults"])
def test_lines_with_common_stretches_equal_sql(spark, tmp_path, name):
    # Suppliers 4 and 179, 24 and 199, 35 and 210 share stretches.
    where = _supplied(tmp_path, [4, 179, 24, 199, 35, 210, 500, 501])
    con = duckdb.connect()
    con.sql(f"create view supplier as select * from '{where}/supplier.parquet'")
    got = spatial.QUERIES[name](spark, where)
    expected = con.sql(spatial.ORACLE_SQL[name]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_overlaps_of_lines(spark):
    df = spark.createDataFrame(LINES, SEGMENTS)
    crossed = {(1, 3, 2.0, 0.0), (2, 4, 11.0, 0.0)}
    assert set(map(tuple, distance.intersections(df, overlaps=False).collect())) == crossed
    assert set(map(tuple, distance.intersections(df).collect())) == crossed | {(1, 2, 7.0, 0.0)}


@pytest.mark.parametrize("overlaps", [True, False])
def test_copies_of_lines_meet_no_more_pairs(spark, monkeypatch, overlaps):
    bent = [(5, 20.0, 0.0, 21.0, 1.0), (5, 21.0, 1.0, 22.0, 0.0)]
    rows = [(g + 10 * k, *r) for k in range(40) for g, *r in LINES + bent]
    df = spark.createDataFrame(rows, SEGMENTS)
    grid = spark.createDataFrame([(x, y, float(x), float(y)) for x in range(0, 24, 3) for y in range(3)], "ix int, iy int, x double, y double")
    meets = distance.intersections(df, overlaps=overlaps).select("x", "y").distinct().collect()
    made, whole = [], distance.intersections
    monkeypatch.setattr(distance, "intersections", lambda *a, **k: made.append(whole(*a, **k)) or made[-1])
    got = distance.line_and_intersection_distances(grid, df, overlaps).collect()
    for r in got:
        assert r.d_int == pytest.approx(min(((r.x - m.x) ** 2 + (r.y - m.y) ** 2) ** 0.5 for m in meets), abs=1e-12)
    # 40 copies of 5 lines: before, 40 * 40 of each pair that meets.
    assert made[0].count() <= 4 * len(meets)


@pytest.mark.parametrize("name", ["j7_calculate_intersections", "j7_calculate_intersections_overlaps"])
def test_all_pairs_of_copies_come_from_their_kinds(spark, tmp_path, monkeypatch, name):
    # Lines repeat after 3,000 suppliers; some here have one copy, some eleven.
    keys = [k + 3000 * n for k in (4, 179, 218, 401, 24) for n in range(11)] + [63, 615, 829, 5]
    where = _supplied(tmp_path, keys)
    monkeypatch.setattr(distance, "MEMBERS", 4)
    monkeypatch.setattr(distance, "LISTED", 50)
    made, whole = [], distance.touching
    monkeypatch.setattr(distance, "touching", lambda *a: made.append(whole(*a)) or made[-1])
    con = duckdb.connect()
    con.sql(f"create view supplier as select * from '{where}/supplier.parquet'")
    expected = con.sql(spatial.ORACLE_SQL[name]).fetchall()
    got = spatial.QUERIES[name](spark, where).collect()
    assert len(expected) > 500 and sorted(map(tuple, got)) == sorted(expected)
    # Before: all pairs of copies whose boxes touch, more than the result has.
    assert made[0].count() <= 9 * 9


@pytest.mark.parametrize("overlaps", [True, False])
@pytest.mark.parametrize("all_points", [True, False])
def test_copies_of_bent_lines_meet_as_lines_do(spark, overlaps, all_points):
    bent = [(5, 0.0, -2.0, 3.0, 2.0), (5, 3.0, 2.0, 6.0, -2.0), (5, 3.0, 2.0, 6.0, -2.0), (6, 0.0, -2.0, 3.0, 2.0), (7, 1.0, None, 2.0, 3.0)]
    rows = [(g + 10 * k, *r) for k in range(5) for g, *r in LINES + bent] + [(99, 0.0, 1.0, 9.0, 1.0)]
    df = spark.createDataFrame(rows, SEGMENTS)
    got = distance.intersections(df, all_points, overlaps)
    assert got.columns == ["a", "b", "x", "y"]
    expected = distance.intersections(df, all_points, overlaps, copies=False)
    assert expected.count() > 50 and sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    empty = distance.intersections(df.where("gid = 7"), all_points, overlaps)
    assert not empty.count() and empty.columns == ["a", "b", "x", "y"]


def test_blocks_of_the_variogram_and_its_products():
    r = np.random.default_rng(3)
    own, x = r.normal(size=300) + 1e4, r.normal(size=200) + 1e4
    for apart in (0.0, 0.5, 3.0, 40.0):
        at, of = r.uniform(size=(300, 3)), r.uniform(size=(200, 3)) + apart
        if not apart:
            at[:50] = of[:50]
        gap = np.sqrt(((at[:, None] - of[None]) ** 2).sum(axis=2))
        edges = np.linspace(max(0.01, gap.min() * 0.9), gap.max() * 0.95, 7)
        lag, half = np.digitize(gap, edges) - 1, 0.5 * (own[:, None] - x[None]) ** 2
        expected = np.array([[w[lag == k].sum() for k in range(6)] for w in (np.ones_like(gap), gap, half)])
        # What lies below the first edge or beyond the last one isn't counted.
        assert kriging._binned(at, own, of, x, edges).reshape(3, 6) == pytest.approx(expected, rel=1e-9)
        assert kriging._times(at, of, x, 2.0, 0.5) == pytest.approx(-kriging.gamma(gap, 2.0, 0.5) @ x, rel=1e-12)


@pytest.mark.parametrize("sent", [True, False])
def test_kriging_meets_each_pair_of_packs_once(spark, monkeypatch, sent):
    """Points beyond SENT whose nugget outweighs the slope: before, three joins of all packs with all packs at least."""
    monkeypatch.setattr(kriging, "SENT", 10)
    monkeypatch.setattr(kriging, "PACK", 64)
    monkeypatch.setattr(kriging, "SENT_PLAIN", 1000 if sent else 10)
    r = np.random.default_rng(5)
    at, v = r.uniform(size=(500, 2)), r.normal(size=500)
    df = spark.createDataFrame(np.column_stack([at, v]).tolist(), "x double, y double, value double")
    nodes = grid.lattice(spark, Extent(0.0, 0.0, 1.0, 1.0), 4, 4)
    joined, whole = [], kriging._lanes
    monkeypatch.setattr(kriging, "_lanes", lambda *a, **k: joined.append(1) or whole(*a, **k))
    many = {(x.ix, x.iy): x.value_interpolated for x in interpolate.kriging(nodes, df, whole=10).collect()}
    assert len(joined) == 1 if sent else len(joined) > 3
    one = {(x.ix, x.iy): x.value_interpolated for x in interpolate.kriging(nodes, df).collect()}
    assert many == pytest.approx(one, rel=1e-6, abs=1e-7)


@pytest.mark.parametrize("noise", [0.0, 3.0])
def test_kriging_of_a_lattice_meets_planes(spark, monkeypatch, noise):
    """Points on uneven levels of an even lattice with gaps: before, all pairs of points were taken one by one."""
    monkeypatch.setattr(kriging, "CELL_PAIRS", 0)
    made, whole = [], kriging._lattice
    monkeypatch.setattr(kriging, "_lattice", lambda at: made.append(whole(at)) or made[-1])
    r = np.random.default_rng(8)
    cells = r.permutation(12 * 9 * 4)[:300]
    at = np.column_stack([0.1 * (cells % 12) + 7, 0.25 * (cells // 12 % 9) - 1, np.array([-5.0, -4.5, -2.0, 0.0])[cells // 108]])
    v = at @ [3.0, -2.0, 1.0] + noise * r.normal(size=300) + 100
    df = spark.createDataFrame(np.column_stack([at, v]).tolist(), "x double, y double, z double, value double")
    nodes = grid.lattice(spark, Extent(6.9, -1.1, 8.0, 1.0, -5.0, 0.0), 4, 4, 3)
    many = {(x.ix, x.iy, x.iz): x.value_interpolated for x in interpolate.kriging(nodes, df, whole=10).collect()}
    assert len(made) == 2 and all(x is not None and len(x.heights) == 4 for x in made)
    one = {(x.ix, x.iy, x.iz): x.value_interpolated for x in interpolate.kriging(nodes, df).collect()}
    assert many == pytest.approx(one, rel=1e-6, abs=1e-7)
    packs = kriging.packed(df.withColumnRenamed("value", "v"), ("x", "y", "z"))
    assert kriging.variogram(packs, 3)[:2] == pytest.approx(kriging.fit_variogram(at, v), rel=1e-6)
    assert whole(at + r.uniform(0, 1e-6, size=at.shape)) is None
    # A plane larger than all pairs together isn't taken.
    monkeypatch.setattr(kriging, "CELL_PAIRS", 300**2)
    assert whole(at) is None


def test_sums_of_terms_follow_the_cluster(spark):
    words = ["alpha", "beta", "gamma", "delta"]
    docs = spark.createDataFrame([(" ".join(words),) for _ in range(400)], "text string").repartition(50)
    every = np.full(pii.FILTER_BITS // 8, 255, np.uint8)
    # Before: a row for each term and partition of the input, 200.
    sums = pii._sums(docs, every).collect()
    assert len(sums) <= 2 * spark.sparkContext.defaultParallelism * len(words) < 50 * len(words)
    assert sorted(r.n for r in pii._occurrences(docs, every).collect()) == [400] * 4
    assert sum(r.n for r in sums) == 1600
