"""Projections by published examples, round trips, shifts between datums, and systems that a user defines."""

import pytest
from favora.functions import crs
from pyspark.sql import functions as F
#: Published worked examples: a projected system, degrees, and metres (feet are turned to metres).
CLARKE = {"radius": 6378206.4, "inverse_flattening": 294.9786982}
FOOT = 1200 / 3937
EXAMPLES = [
    (crs.System("lcc", 27 + 50 / 60, -99, 1, 2_000_000 * FOOT, 0, 28 + 23 / 60, 30 + 17 / 60, **CLARKE), -96, 28.5, 2963503.91 * FOOT, 254759.80 * FOOT),
    (crs.System("lcc", 18, -77, 1, 250_000, 150_000, 18, **CLARKE), -(76 + 56 / 60 + 37.26 / 3600), 17 + 55 / 60 + 55.8 / 3600, 255966.58, 142493.51),
    (crs.System("aea", 23, -96, 1, 0, 0, 29.5, 45.5, **CLARKE), -75, 35, 1885472.7, 1535925.0),
    (crs.System("stere", -90, 70, 1, 6_000_000, 6_000_000, -71, inverse_flattening=crs.WGS84), 120, -75, 7255380.79, 7053389.56),
    (crs.SYSTEMS[3035], 5, 50, 3962799.45, 2999718.85),
    (crs.SYSTEMS[27700], 0.5, 50.5, 577274.99, 69740.50),
]


def test_projections_by_published_examples(spark):
    for s, lon, lat, x, y in EXAMPLES:
        got = spark.range(1).select(*crs.METHODS[s.method][0](F.lit(float(lon)), F.lit(float(lat)), s, lambda *c: c)).first()
        assert got[0] == pytest.approx(x, abs=0.06) and got[1] == pytest.approx(y, abs=0.06), s
    at = spark.range(1).select(*crs.helmert(F.lit(3657660.66), F.lit(255768.55), F.lit(5201382.11), (0, 0, 4.5, 0, 0, 0.554, 0.219))).first()
    assert list(at) == pytest.approx([3657660.78, 255778.43, 5201387.75], abs=0.01)


def test_projections_and_shifts_lead_back(spark):
    where = {5070: (-95, 39), 3310: (-119, 36), 2154: (2, 46), 3035: (12, 48), 3034: (12, 48), 3413: (-60, 78), 3031: (100, -80), 3978: (-100, 60), 27700: (-1.5, 53), 2193: (173, -41), 3005: (-124, 52), 25832: (9, 50), 28355: (147, -37), 26910: (-121, 44)}
    for code, (lon, lat) in where.items():
        rows = [(lon + i * 1.3, lat + j * 1.1, "clash") for i in (-2, 0, 1) for j in (-1, 0, 2)] + [(None, 1.0, None), (float(lon), None, None)]
        df = spark.createDataFrame(rows, "x double, y double, lon string")
        out = crs.reproject(crs.reproject(df, 4326, code), f"epsg:{code}", 4326)
        assert out.columns == ["x", "y", "lon"]
        for (x, y, _), got in zip(rows, out.collect(), strict=True):
            if x is not None and y is not None:
                assert got.x == pytest.approx(x, abs=2e-8) and got.y == pytest.approx(y, abs=2e-8), code
            else:
                assert got.x is None and got.y is None
    # The shift is about a hundred metres, and the poles have images.
    moved = crs.reproject(spark.createDataFrame([(-1.5, 53.0)], "x double, y double"), 4326, 4277).first()
    assert 0.0005 < abs(moved.x + 1.5) < 0.003 and abs(moved.y - 53) < 0.001
    for code, lat in ((3413, 90.0), (3031, -90.0)):
        pole = crs.reproject(spark.createDataFrame([(10.0, lat)], "x double, y double"), 4326, code)
        assert pole.first().x == pytest.approx(0, abs=1e-6) and pole.first().y == pytest.approx(0, abs=1e-6)
        assert crs.reproject(pole, code, 4326).first().y == pytest.approx(lat, abs=1e-6)
    middle = crs.reproject(spark.createDataFrame([(4_321_000.0, 3_210_000.0)], "x double, y double"), 3035, 4258).first()
    assert (middle.x, middle.y) == pytest.approx((10, 52), abs=1e-9)


def test_defined_systems(spark):
    given = crs.System("lcc", 41 + 2 / 3, -120.5, 1, 600_000, 0, 42 + 1 / 3, 44)
    crs.define("EPSG:990001", given)
    crs.define(990001, given)
    df = spark.createDataFrame([(-121.0, 43.7)], "x double, y double")
    back = crs.reproject(crs.reproject(df, 4269, 990001), 990001, 4269).first()
    assert (back.x, back.y) == pytest.approx((-121.0, 43.7), abs=1e-9)
    for code, wrong in ((4326, given), (990001, given._replace(lat0=1)), (990002, crs.System("oblique")), (990003, crs.System("aea")), (990004, crs.System("laea", 90))):
        with pytest.raises(ValueError):
            crs.define(code, wrong)
