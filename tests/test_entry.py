"""The entry points: a sample of the queries against DuckDB; all of them run in the comparison of the driver."""

import os

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
SAMPLE = ["n1_minmax", "v4_voter", "v8_do_voter_veto_2d", "d1_distance_from_points", "d2_distance_from_lines", "j1_mask_exclusion_areas", "a1_point_density", "g4_rasterize_2d", "c4_filter", "i1_interpolate_nearest"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, name):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{DATA}/{file}'")
    expected = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in expected.description]
    got = entry.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(key, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(key, expected.fetchall()))


def test_every_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
