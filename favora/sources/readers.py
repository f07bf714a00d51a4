"""Readers of layer files: CSV, Tecplot text, well paths, shapefiles, GeoPackages and GeoTIFF, as DataFrames.

Binary formats are decoded in the tasks that Spark's binaryFile source feeds, so paths may be in any store that Spark reads.
"""

from __future__ import annotations

import re
import sqlite3
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from favora.functions.crs import parse, reproject
from favora.functions.geometry import from_wkt
from favora.operators.clean import convert_z
from favora.operators.structure import well_path


def _placed(df: DataFrame, x: str | None, y: str | None, z: str | None) -> DataFrame:
    if (x is None) != (y is None):
        raise ValueError("x_col and y_col go together")
    if z is not None and x is None:
        raise ValueError("z_col needs x_col and y_col")
    names = {"x": x, "y": y, "z": z}
    return df.withColumns({k: F.col(c).cast("double") for k, c in names.items() if c})


def read_csv(spark: SparkSession, path: str, crs: str | int, x_col: str | None = None, y_col: str | None = None, z_col: str | None = None, geometry_col: str | None = None) -> DataFrame:
    """Rows with x, y[, z] from columns, or with `geometry` from a WKT column; ValueError for half-given coordinates or an unknown CRS."""
    code = parse(crs)
    df = spark.read.csv(path, header=True, inferSchema=True)
    df = _placed(df, x_col, y_col, z_col)
    return df.withColumn("geometry", from_wkt(F.col(geometry_col), code)) if geometry_col else df


def tec_columns(lines: list[str]) -> list[str]:
    """Names of the variables in a Tecplot header; ValueError for less than four lines."""
    if len(lines) < 4:
        raise ValueError("a Tecplot file needs four lines")
    quoted = re.findall(r'"([^"]+)"', lines[1])
    return quoted or lines[1].split("=", 1)[-1].replace(",", " ").split()


def read_tec(spark: SparkSession, path: str, x_col: str | None = None, y_col: str | None = None, z_col: str | None = None) -> DataFrame:
    """Rows of a Tecplot text file: names in its second line, data from the fourth; short rows end in NULLs.

    Columns in which every value is a number are doubles, others strings.
    """
    # Lines keep their order inside a block of the file, so the first three of the first block are the header.
    lines = spark.read.text(path).select("value", (F.monotonically_increasing_id() % (1 << 33)).alias("n"), F.col("_metadata.file_block_start").alias("at"))
    head = [r.value for r in lines.where("at = 0 and n < 4").orderBy("n").collect()]
    names = tec_columns(head)
    rows = lines.where("at > 0 or n >= 3").select(F.filter(F.split(F.trim("value"), r"\s+"), lambda v: v != "").alias("v")).where(F.size("v") > 0)
    df = rows.select(*(F.get("v", F.lit(i)).alias(c) for i, c in enumerate(names)))
    numeric = df.agg(*(F.bool_and(F.col(f"`{c}`").isNull() | F.col(f"`{c}`").try_cast("double").isNotNull()).alias(f"k{i}") for i, c in enumerate(names))).first()
    df = df.select(*(F.col(f"`{c}`").try_cast("double").alias(c) if numeric[i] else F.col(f"`{c}`") for i, c in enumerate(names)))
    return _placed(df, x_col, y_col, z_col)


def read_well_path_csv(spark: SparkSession, path: str, x_col: str, y_col: str, z_col: str | None = None, *, well_name_col: str | None = None, value_col: str | None = None, source_crs: str | int | None = None, to_crs: str | int | None = None, sort_by: str | None = None, md_col: str | None = None, dropna_any: bool = True, z_meas: str | None = None, target_z_meas: str | None = None) -> DataFrame:
    """A well's points in order (seq, x, y, z[, value, well]) without consecutive equal ones; see well_path()."""
    raw = spark.read.csv(path, header=True, inferSchema=True).withColumn("_file_seq", F.monotonically_increasing_id())
    z = F.col(z_col).cast("double") if z_col else F.lit(0.0)
    df = raw.select(F.col(x_col).cast("double").alias("x"), F.col(y_col).cast("double").alias("y"), z.alias("z"), "_file_seq", *([F.col(sort_by or md_col).alias("_order")] if sort_by or md_col else []), *([F.col(value_col).alias("value")] if value_col else []), *([F.col(well_name_col).alias("well")] if well_name_col else []))
    df = well_path(df, "_order" if sort_by or md_col else None, "_file_seq", dropna_any=dropna_any)
    if well_name_col:
        first = df.where("well is not null").orderBy("seq").select("well").first()
        df = df.withColumn("well", F.lit(first[0] if first else None))
    if source_crs and to_crs:
        df = reproject(df, source_crs, to_crs)
    if z_meas and target_z_meas:
        df = convert_z(df, z_meas, target_z_meas)
    return df.drop("_file_seq", "_order")


def _dbf(data: bytes) -> pd.DataFrame:
    count, head, size = struct.unpack("<IHH", data[4:12])
    fields = [(data[i : i + 11].split(b"\0")[0].decode("latin-1"), data[i + 16]) for i in range(32, head - 1, 32) if data[i] != 13]
    rows = []
    for r in range(count):
        at, row = head + r * size + 1, []
        for _, n in fields:
            raw = data[at : at + n]
            try:
                row.append(raw.decode().strip() or None)
            except UnicodeDecodeError:
                row.append(raw.decode("latin-1").strip() or None)
            at += n
        rows.append(row)
    return pd.DataFrame(rows, columns=[f for f, _ in fields], dtype=object)


Ring = list[tuple[float, float, float | None]]


def _vertices(record: bytes, at: int, n: int, z_at: int | None) -> Ring:
    xy = np.frombuffer(record, "<f8", 2 * n, at).reshape(-1, 2).tolist()
    z = np.frombuffer(record, "<f8", n, z_at).tolist() if z_at is not None else [None] * n
    return [(x, y, v) for (x, y), v in zip(xy, z, strict=True)]


def shapes(data: bytes) -> Iterator[tuple[str, list[Ring]]]:
    """(kind, rings or lines or points) of each record of a .shp file, with Z where the file has it; M is not read."""
    at = 100
    while at < len(data):
        (words,) = struct.unpack(">i", data[at + 4 : at + 8])
        record = data[at + 8 : at + 8 + 2 * words]
        (full,) = struct.unpack("<i", record[:4])
        kind, has_z = full % 10, full // 10 == 1
        if kind == 1:
            yield "POINT", [_vertices(record, 4, 1, 20 if has_z else None)]
        elif kind in (3, 5):
            parts, points = struct.unpack("<2i", record[36:44])
            first = [*struct.unpack(f"<{parts}i", record[44 : 44 + 4 * parts]), points]
            start = 44 + 4 * parts
            every = _vertices(record, start, points, start + 16 * points + 16 if has_z else None)
            yield ("LINESTRING" if kind == 3 else "POLYGON"), [every[a:b] for a, b in zip(first, first[1:], strict=False)]
        elif kind == 8:
            (points,) = struct.unpack("<i", record[36:40])
            yield "MULTIPOINT", [_vertices(record, 40, points, 40 + 16 * points + 16 if has_z else None)]
        else:
            yield "EMPTY", []
        at += 8 + 2 * words


VERTICES = "array<array<struct<x: double, y: double, z: double>>>"
SHAPES = f"gid long, kind string, parts {VERTICES}, attributes map<string, string>, prj string"


def _parts(rings: list[Ring]) -> list[list[dict]]:
    return [[{"x": x, "y": y, "z": z} for x, y, z in ring] for ring in rings]


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """(gid, kind, parts, attributes, prj) of a .shp file with the .dbf and, if there is one, the .prj beside it.

    One task decodes a file, which the format bounds to 2 GB.
    """
    stem = path[:-4]
    wanted = [x for x in (path, f"{stem}.dbf", f"{stem}.prj") if x == path or exists(spark, x)]
    files = spark.read.format("binaryFile").load(wanted).select(F.lower(F.regexp_extract("path", r"(\w+)$", 1)).alias("suffix"), "content")
    one = files.groupBy(F.lit(1).alias("k")).agg(*(F.max(F.when(F.col("suffix") == x, F.col("content"))).alias(x) for x in ("shp", "dbf", "prj")))

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shp, dbf, prj in zip(frame["shp"], frame["dbf"], frame["prj"], strict=True):
                table = _dbf(dbf).to_dict("records") if dbf is not None else []
                said = prj.decode("utf-8", "replace").strip() if prj is not None else None
                rows = []
                for i, (kind, rings) in enumerate(shapes(shp)):
                    rows.append({"gid": i, "kind": kind, "parts": _parts(rings), "attributes": table[i] if i < len(table) else {}, "prj": said})
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows)

    return one.select("shp", "dbf", "prj").mapInPandas(task, SHAPES)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path, in any store that Spark reads."""
    try:
        spark.read.format("binaryFile").load(path).schema
    except AnalysisException:
        return False
    return True


def from_wkb(data: bytes, at: int = 0) -> tuple[str, list[Ring], int]:
    """(kind, parts, end) of a geometry in well-known binary, ISO or extended; collections of one kind become one geometry."""
    e = "<" if data[at] else ">"
    (code,) = struct.unpack(e + "I", data[at + 1 : at + 5])
    at += 5 + 4 * bool(code & 0x20000000)
    plain = code & 0xFFFF
    has_z, has_m = bool(code & 0x80000000) or plain // 1000 in (1, 3), bool(code & 0x40000000) or plain // 1000 in (2, 3)
    kind, size = plain % 1000, 2 + has_z + has_m

    def run(at: int, n: int) -> tuple[Ring, int]:
        rows = np.frombuffer(data, e + "f8", n * size, at).reshape(n, size).tolist()
        return [(v[0], v[1], v[2] if has_z else None) for v in rows], at + 8 * n * size

    def counted(at: int) -> tuple[int, int]:
        return struct.unpack(e + "I", data[at : at + 4])[0], at + 4

    if kind == 1:
        ring, at = run(at, 1)
        return "POINT", [ring], at
    if kind == 2:
        n, at = counted(at)
        ring, at = run(at, n)
        return "LINESTRING", [ring], at
    if kind == 3:
        n, at = counted(at)
        rings = []
        for _ in range(n):
            m, at = counted(at)
            ring, at = run(at, m)
            rings.append(ring)
        return "POLYGON", rings, at
    if kind in (4, 5, 6):
        n, at = counted(at)
        rings = []
        for _ in range(n):
            _, more, at = from_wkb(data, at)
            rings += more
        return {4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON"}[kind], rings, at
    raise ValueError(f"unsupported geometry type {kind}")


def read_gpkg(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """(gid, kind, parts, attributes, prj) of a layer of a GeoPackage (the first one, if none is named); prj is its system's text.

    The rings of all polygons of a multi-part geometry stand side by side in `parts`.  ValueError for an unknown layer.
    """

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                db = sqlite3.connect(":memory:")
                db.deserialize(content)
                found = db.execute("select c.table_name, c.column_name, s.definition from gpkg_geometry_columns c left join gpkg_spatial_ref_sys s using (srs_id) order by c.rowid").fetchall()
                if not (chosen := [x for x in found if layer in (None, x[0])]):
                    raise ValueError(f"no layer {layer}")
                name, column, prj = chosen[0]
                quoted = name.replace('"', '""')
                cursor = db.execute(f'select * from "{quoted}"')
                names = [d[0] for d in cursor.description]
                at = names.index(column)
                gid = 0
                while some := cursor.fetchmany(10_000):
                    rows = []
                    for row in some:
                        blob = row[at]
                        kind, rings = "EMPTY", []
                        if blob is not None and not blob[3] & 0x10:
                            kind, rings, _ = from_wkb(blob, 8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[blob[3] >> 1 & 7])
                        rows.append({"gid": gid, "kind": kind, "parts": _parts(rings), "attributes": {n: None if v is None else str(v) for n, v in zip(names, row, strict=True) if n != column}, "prj": prj})
                        gid += 1
                    yield pd.DataFrame(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(task, SHAPES)


def _lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant bit first."""
    out, table, width, bits, held = bytearray(), [], 9, 0, 0
    last = None
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFFFF, bits + 8
        if bits < width:
            continue
        code = held >> (bits - width) & (1 << width) - 1
        bits -= width
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if code == 257:
            break
        now = table[code] if code < len(table) else last + last[:1]
        out += now
        if last is not None:
            table.append(last + now[:1])
        last = now
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def _packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n, at = data[at], at + 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def decode_tif(data: bytes) -> pd.DataFrame:
    """(x, y, value) of the pixels of band 1 that aren't nodata, at their centres.

    Strips or tiles; uncompressed, deflated, LZW or PackBits, with or without differences along rows.
    """
    e = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack(e + "I", data[4:8])
    (n,) = struct.unpack(e + "H", data[at : at + 2])
    sizes = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("Q", 8), 11: ("f", 4), 12: ("d", 8)}
    tags: dict[int, tuple] = {}
    for i in range(n):
        entry = data[at + 2 + 12 * i : at + 14 + 12 * i]
        tag, kind, count = struct.unpack(e + "HHI", entry[:8])
        if kind not in sizes:
            continue
        code, size = sizes[kind]
        raw = entry[8 : 8 + size * count] if size * count <= 4 else data[(o := struct.unpack(e + "I", entry[8:12])[0]) : o + size * count]
        tags[tag] = (raw[: size * count].split(b"\0")[0].decode(),) if code == "s" else struct.unpack(f"{e}{count}{code}", raw)
    width, height, bits = tags[256][0], tags[257][0], tags.get(258, (8,))[0]
    kind = {1: "u", 2: "i", 3: "f"}[tags.get(339, (1,))[0]]
    packed = tags.get(259, (1,))[0]
    unpack = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}.get(packed)
    differ, bands = tags.get(317, (1,))[0], tags.get(277, (1,))[0]
    if unpack is None or differ not in (1, 2) or tags.get(284, (1,))[0] != 1:
        raise ValueError(f"unsupported GeoTIFF layout: compression {packed}, predictor {differ}")
    tiled = 324 in tags
    wide, high = (tags[322][0], tags[323][0]) if tiled else (width, tags.get(278, (height,))[0])
    across = -(-width // wide)
    pixels = np.dtype(f"{e}{kind}{bits // 8}")
    grid = np.zeros((height, width), float)
    for i, (o, c) in enumerate(zip(*((tags[324], tags[325]) if tiled else (tags[273], tags[279])), strict=True)):
        top, left = i // across * high, i % across * wide
        rows = high if tiled else min(high, height - top)
        block = np.frombuffer(unpack(data[o : o + c]), pixels, rows * wide * bands).reshape(rows, wide, bands)
        if differ == 2:
            block = np.cumsum(block, axis=1, dtype=pixels.newbyteorder("="))
        part = block[: height - top, : width - left, 0]
        grid[top : top + len(part), left : left + part.shape[1]] = part
    sx, sy = tags.get(33550, (1.0, 1.0))[:2]
    tie = tags.get(33922, (0, 0, 0, 0.0, float(height), 0))
    col, row = np.meshgrid(np.arange(width), np.arange(height))
    out = pd.DataFrame({"x": (tie[3] + (col + 0.5 - tie[0]) * sx).ravel(), "y": (tie[4] - (row + 0.5 - tie[1]) * sy).ravel(), "value": grid.ravel()})
    return out[out["value"] != float(tags[42113][0])] if 42113 in tags else out


def read_tif(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, value) of a GeoTIFF file or folder."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                yield decode_tif(content)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(task, "x double, y double, value double")


read_raster = read_tif
