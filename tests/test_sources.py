"""Files: round trips of the writers and hand-made rasters, and the project catalog."""

import struct
import zlib

import numpy as np
import pytest
from favora.functions.geometry import from_wkt
from favora.sources import catalog, readers, writers
from pyspark.sql import functions as F


def test_point_shapefile_with_z(spark, tmp_path):
    rows = [(1.5, 2.5, 3.5, "Gölden", "a" * 200, 7), (-1.0, 4.0, -2.0, None, "", None)]
    df = spark.createDataFrame(rows, "x double, y double, z double, a_long_name_1 string, a_long_name_2 string, n int")
    path = str(tmp_path / "new" / "p.shp")
    writers.write_point_shapefile(df, path, 4326)
    got = readers.read_shapefile(spark, path).orderBy("gid").collect()
    assert [(x.kind, *x.parts[0][0]) for x in got] == [("POINT", 1.5, 2.5, 3.5), ("POINT", -1.0, 4.0, -2.0)]
    assert [dict(x.attributes) for x in got] == [{"a_long_nam": "Gölden", "a_long_n_1": "a" * 200, "n": "7"}, {"a_long_nam": None, "a_long_n_1": None, "n": None}]
    assert got[0].prj.startswith("GEOGCS")
    with pytest.raises(ValueError, match="254"):
        writers.write_point_shapefile(df.withColumn("n", F.lit("b" * 300)), path, 4326)
    writers.write_point_shapefile(df.drop("z").limit(0), str(tmp_path / "none.shp"), 4326)
    assert readers.read_shapefile(spark, str(tmp_path / "none.shp")).count() == 0


def test_lines_and_polygons_of_shapefiles():
    ring = [(0.0, 0.0, 1.0), (4.0, 0.0, 2.0), (4.0, 4.0, 3.0), (0.0, 0.0, 1.0)]
    hole = [(1.0, 0.5, 5.0), (2.0, 0.5, 5.0), (2.0, 1.0, 5.0), (1.0, 0.5, 5.0)]
    records = b""
    for kind, parts in ((15, [ring, hole]), (3, [ring]), (18, [ring]), (0, [])):
        flat = [v for p in parts for v in p]
        body = struct.pack("<i4d", kind, 0, 0, 4, 4) if kind else struct.pack("<i", 0)
        if kind in (15, 3):
            body += struct.pack("<2i", len(parts), len(flat)) + struct.pack(f"<{len(parts)}i", *np.cumsum([0, *map(len, parts)])[:-1])
        elif kind == 18:
            body += struct.pack("<i", len(flat))
        body += b"".join(struct.pack("<2d", *v[:2]) for v in flat)
        if kind in (15, 18):
            body += struct.pack("<2d", 1, 5) + b"".join(struct.pack("<d", v[2]) for v in flat)
        records += struct.pack(">2i", 1, len(body) // 2) + body
    flat = [(x, y, None) for x, y, _ in ring]
    assert list(readers.shapes(b"\0" * 100 + records)) == [("POLYGON", [ring, hole]), ("LINESTRING", [flat]), ("MULTIPOINT", [ring]), ("EMPTY", [])]


def test_geopackage(spark, tmp_path):
    points = spark.createDataFrame([(-105.2, 39.7, "Golden", 5), (1.0, None, None, None)], "x double, y double, City string, n long")
    path = str(tmp_path / "out" / "p.gpkg")
    writers.write_gpkg(points, path)
    got = readers.read_gpkg(spark, path).orderBy("gid").collect()
    assert [(x.kind, [tuple(v) for r in x.parts for v in r]) for x in got] == [("POINT", [(-105.2, 39.7, None)]), ("EMPTY", [])]
    assert dict(got[0].attributes) == {"fid": "1", "City": "Golden", "n": "5"} and got[0].prj.startswith("GEOGCS")
    with pytest.raises(ValueError, match="already"):
        writers.write_gpkg(points, path)
    texts = ["POINT Z (1 2 3)", "LINESTRING (0 0, 1 1)", "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))", "MULTIPOINT ((1 2), (3 4))", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))"]
    shaped = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", from_wkt(F.col("t"), 32610).alias("geometry"))
    writers.write_gpkg(shaped.coalesce(1), str(tmp_path / "g.gpkg"), "shapes", 32610)
    got = readers.read_gpkg(spark, str(tmp_path / "g.gpkg"), "shapes").orderBy("gid").collect()
    assert [x.kind for x in got] == [t.split()[0] for t in texts]
    expected = [x.p for x in shaped.orderBy("i").select(F.flatten("geometry.parts").alias("p")).collect()]
    assert [[[tuple(v) for v in r] for r in x.parts] for x in got] == [[[tuple(v) for v in r] for r in p] for p in expected]
    with pytest.raises(Exception, match="no layer"):
        readers.read_gpkg(spark, path, "other").collect()


def lzw(data):
    """TIFF's LZW, by a dictionary of bytes."""
    codes, width, table, now = [(256, 9)], 9, {bytes([i]): i for i in range(256)}, b""
    n = 258
    for b in data:
        if now + bytes([b]) in table:
            now += bytes([b])
            continue
        codes.append((table[now], width))
        table[now + bytes([b])] = n
        n += 1
        width = 12 if n >= 2048 else 11 if n >= 1024 else 10 if n >= 512 else 9
        now = bytes([b])
        if n == 4094:
            codes.append((256, width))
            width, table, n = 9, {bytes([i]): i for i in range(256)}, 258
    codes += [(table[now], width), (257, width)]
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


@pytest.mark.parametrize("tiled", [False, True])
@pytest.mark.parametrize("packed", [1, 5, 8, 32773])
@pytest.mark.parametrize("differ", [1, 2])
def test_tif_layouts(packed, tiled, differ):
    r = np.random.default_rng(1)
    values = (r.integers(0, 40, (70, 50)) + np.arange(50)).astype("<i2")
    wide, high = (32, 16) if tiled else (50, 20)
    blocks = []
    for top in range(0, 70, high):
        for left in range(0, 50, wide):
            block = np.zeros((high if tiled else min(high, 70 - top), wide), "<i2")
            part = values[top : top + high, left : left + wide]
            block[: part.shape[0], : part.shape[1]] = part
            if differ == 2:
                block[:, 1:] = block[:, 1:] - block[:, :-1].copy()
            raw = block.astype("<i2").tobytes()
            blocks.append({1: lambda x: x, 5: lzw, 8: zlib.compress, 32773: lambda x: b"".join(bytes([len(c) - 1]) + c for c in (x[i : i + 100] for i in range(0, len(x), 100)))}[packed](raw))
    offsets = np.cumsum([8, *map(len, blocks)])
    body, end = b"".join(blocks), int(offsets[-1])
    n = len(blocks)
    arrays = struct.pack(f"<{n}I", *offsets[:-1].tolist()) + struct.pack(f"<{n}I", *map(len, blocks))
    tags = [(256, 3, 1, 50), (257, 3, 1, 70), (258, 3, 1, 16), (259, 3, 1, packed), (317, 3, 1, differ), (339, 3, 1, 2)]
    tags += [(322, 3, 1, wide), (323, 3, 1, high), (324, 4, n, end), (325, 4, n, end + 4 * n)] if tiled else [(273, 4, n, end), (278, 3, 1, high), (279, 4, n, end + 4 * n)]
    data = struct.pack("<2sHI", b"II", 42, end + 8 * n) + body + arrays + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in sorted(tags)) + b"\0" * 4
    got = readers.decode_tif(data)["value"].to_numpy().reshape(70, 50)
    assert (got == values).all()


def test_catalog(spark, tmp_path):
    folder = tmp_path / "data" / "geo" / "heat"
    folder.mkdir(parents=True)
    (folder / "wells.csv").write_text("lon,lat,t\n1,2,30\n3,4,50\n")
    (folder / "logs.tec").write_text('TITLE="t"\nVARIABLES = "X" "Y" "T"\nZONE\n1 2 3.5\n4 5 6\n7 8\n')
    config = {"criteria": {"geo": {"components": {"heat": {"layers": {"wells": {"x_col": "lon", "y_col": "lat", "crs": 4326}, "logs": {"x_col": "X", "y_col": "Y"}, "missing": {}}}}}}}
    project = catalog.gather_data(spark, str(tmp_path / "data"), catalog.Project(config))
    assert {k[2] for k in project.data} == {"wells", "logs"}
    assert sorted((r.x, r.y, r.t) for r in project.data["geo", "heat", "wells"].collect()) == [(1.0, 2.0, 30), (3.0, 4.0, 50)]
    logs = {r.x: r["T"] for r in project.data["geo", "heat", "logs"].collect()}
    assert logs == {1.0: 3.5, 4.0: 6.0, 7.0: None}
    points = spark.createDataFrame([(1.0, 2.0, 9.5)], "x double, y double, v double")
    writers.write_csv(points, str(folder / "wells_processed.csv"), 4326)
    again = catalog.gather_processed_data(spark, str(tmp_path / "data"), project, 4326)
    assert [(r.x, r.y, r.v) for r in again.models["geo", "heat", "wells"].collect()] == [(1.0, 2.0, 9.5)]
    writers.write_processed(points, str(tmp_path / "m"))
    assert catalog.fetch(spark, {"m": str(tmp_path / "m")}, "m").count() == 1
    with pytest.raises(KeyError):
        catalog.fetch(spark, {}, "m")
    assert "heat" in catalog.clean_config(config | {"df": points})


def test_exclusion_areas(spark, tmp_path):
    ring = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (0.0, 0.0)]
    folder = tmp_path / "exclusion"
    folder.mkdir()
    records = b""
    for _ in range(2):
        body = struct.pack("<i4d2ii", 5, 0, 0, 2, 2, 1, 4, 0) + b"".join(struct.pack("<2d", *v) for v in ring)
        records += struct.pack(">2i", 1, len(body) // 2) + body
    (folder / "area.shp").write_bytes(b"\0" * 100 + records)
    (folder / "area.dbf").write_bytes(struct.pack("<4BIHH", 3, 26, 1, 1, 2, 65, 5).ljust(32, b"\0") + b"DN".ljust(11, b"\0") + b"N" + b"\0" * 4 + bytes([4, 0]) + b"\0" * 14 + b"\r" + b"    1" + b"    0")
    edges = catalog.gather_exclusion_areas(spark, str(tmp_path), ["area"])["area"].collect()
    assert sorted((e.gid, e.x0, e.y0, e.x1, e.y1) for e in edges) == [(0, 0.0, 0.0, 0.0, 2.0), (0, 0.0, 2.0, 2.0, 2.0), (0, 2.0, 2.0, 0.0, 0.0)]
    moved = catalog.gather_exclusion_areas(spark, str(tmp_path), ["area"], 4326, 3857)["area"].collect()
    assert max(e.x1 for e in moved) == pytest.approx(222638.98, abs=0.1)
