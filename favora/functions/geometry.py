"""Planar geometry as column expressions: WKT, distances, containment, intersections, areas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERTEX = "struct<x: double, y: double, z: double>"
GEOMETRY = f"struct<kind: string, srid: int, parts: array<array<array<{VERTEX}>>>>"


def point_distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1))


def segment_distance(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance of a point from a segment, which may be a point itself."""
    dx, dy = x1 - x0, y1 - y0
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((px - x0) * dx + (py - y0) * dy, dx * dx + dy * dy))), F.lit(0.0))
    return point_distance(px, py, x0 + t * dx, y0 + t * dy)


def on_segment(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether the point lies on the segment."""
    cross = (x1 - x0) * (py - y0) - (y1 - y0) * (px - x0)
    return (cross == 0) & px.between(F.least(x0, x1), F.greatest(x0, x1)) & py.between(F.least(y0, y1), F.greatest(y0, y1))


def crosses(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether a ray to the right of the point crosses the segment; an odd number of a polygon's edges means inside."""
    return ((y0 > py) != (y1 > py)) & F.coalesce(px < x0 + F.try_divide((py - y0) * (x1 - x0), y1 - y0), F.lit(False))


def segment_intersection(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column], overlaps: bool = True) -> Column:
    """STRUCT<x, y> of the point common to two segments, or (with `overlaps`) the middle of a common stretch; null if there is none."""
    ax, ay, bx, by = a
    cx, cy, dx, dy = b
    rx, ry, sx, sy = bx - ax, by - ay, dx - cx, dy - cy
    den = rx * sy - ry * sx
    t = F.try_divide((cx - ax) * sy - (cy - ay) * sx, den)
    u = F.try_divide((cx - ax) * ry - (cy - ay) * rx, den)
    point = F.when((den != 0) & t.between(0, 1) & u.between(0, 1), F.struct((ax + t * rx).alias("x"), (ay + t * ry).alias("y")))
    if not overlaps:
        return point
    # On one line: the stretch between parameters of the first segment.
    rr = rx * rx + ry * ry
    t0, t1 = F.try_divide((cx - ax) * rx + (cy - ay) * ry, rr), F.try_divide((dx - ax) * rx + (dy - ay) * ry, rr)
    lo, hi = F.greatest(F.lit(0.0), F.least(t0, t1)), F.least(F.lit(1.0), F.greatest(t0, t1))
    same = (den == 0) & (((cx - ax) * ry - (cy - ay) * rx) == 0) & (lo <= hi)
    middle = F.when(same, F.struct((ax + (lo + hi) / 2 * rx).alias("x"), (ay + (lo + hi) / 2 * ry).alias("y")))
    return F.coalesce(point, middle)


def clip_ring(ring: Column, xmin: Column | float, ymin: Column | float, xmax: Column | float, ymax: Column | float) -> Column:
    """A ring's part inside a box, as an open ring, ARRAY<STRUCT<x, y>>; cut at one side after another."""
    number = lambda v: (F.lit(float(v)) if isinstance(v, (int, float)) else v.cast("double"))
    sides = F.array(*(F.struct(F.lit(axis).alias("axis"), F.lit(sign).alias("sign"), number(bound).alias("bound")) for axis, sign, bound in (("x", 1.0, xmin), ("x", -1.0, xmax), ("y", 1.0, ymin), ("y", -1.0, ymax))))
    plain = F.transform(ring, lambda v: F.struct(v["x"].cast("double").alias("x"), v["y"].cast("double").alias("y")))
    n = F.size(plain)
    # The last corner of a closed ring is the first one again.
    opened = F.when((n > 1) & (F.element_at(plain, 1) == F.element_at(plain, -1)), F.slice(plain, 1, n - 1)).otherwise(plain)

    def cut(corners: Column, s: Column) -> Column:
        def edge(i: Column) -> Column:
            a, b = F.get(corners, i), F.get(corners, (i + 1) % F.size(corners))
            over = lambda v: s["sign"] * (F.when(s["axis"] == "x", v["x"]).otherwise(v["y"]) - s["bound"])
            t = F.try_divide(over(a), over(a) - over(b))
            meet = F.struct((a["x"] + (b["x"] - a["x"]) * t).alias("x"), (a["y"] + (b["y"] - a["y"]) * t).alias("y"))
            none = F.slice(F.array(a), 1, 0)
            return F.concat(F.when(over(a) >= 0, F.array(a)).otherwise(none), F.when((over(a) >= 0) != (over(b) >= 0), F.array(meet)).otherwise(none))

        return F.when(F.size(corners) > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size(corners) - 1, F.lit(0))), edge))).otherwise(corners)

    return F.aggregate(sides, opened, cut)


def closed(ring: Column) -> Column:
    """An open ring with its first corner at the end again."""
    return F.concat(ring, F.slice(ring, 1, 1))


def ring_area(ring: Column) -> Column:
    """Signed area of a closed ring, ARRAY<STRUCT<x, y>>."""
    n = F.size(ring)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.lit(0.0), lambda s, i: s + F.coalesce(F.get(ring, i - 1)["x"] * F.get(ring, i)["y"] - F.get(ring, i)["x"] * F.get(ring, i - 1)["y"], F.lit(0.0))) / 2


def from_wkt(text: Column, srid: int | None = None) -> Column:
    """GEOMETRY of a WKT point, line or polygon, or a multi-part one, with or without Z; null for others."""
    kind = F.upper(F.regexp_extract(text, r"^\s*([A-Za-z]+)", 1))
    body = F.regexp_replace(F.regexp_replace(text, r"^\s*[A-Za-z]+\s*(?i:ZM|Z|M)?\s*", ""), r"\s+", " ")

    def vertex(t: Column) -> Column:
        xs = F.filter(F.split(F.regexp_replace(t, r"[()]", " "), r"\s+"), lambda v: v != "")
        number = lambda i: F.get(xs, F.lit(i)).try_cast("double")
        return F.struct(number(0).alias("x"), number(1).alias("y"), number(2).alias("z"))

    ring = lambda t: F.transform(F.split(t, ","), vertex)
    rings = lambda t: F.transform(F.split(t, r"\)\s*,\s*\("), ring)
    many = F.transform(F.split(body, r"\)\s*\)\s*,\s*\(\s*\("), rings)
    one = F.array(rings(body))
    each = F.transform(F.split(body, r"\)\s*,\s*\("), lambda t: F.array(ring(t)))
    points = F.transform(F.split(body, ","), lambda t: F.array(F.array(vertex(t))))
    parts = F.when(kind == "MULTIPOLYGON", many).when(kind == "MULTILINESTRING", each).when(kind == "MULTIPOINT", points).when(kind.isin("POINT", "LINESTRING", "POLYGON"), one)
    return F.when(parts.isNotNull(), F.struct(kind.alias("kind"), F.lit(srid).cast("int").alias("srid"), parts.alias("parts")))


def to_wkt(geom: Column) -> Column:
    """WKT of a GEOMETRY; numbers as Spark writes doubles."""
    has_z = F.exists(F.flatten(F.flatten(geom["parts"])), lambda v: v["z"].isNotNull())
    vertex = lambda v: F.concat_ws(" ", v["x"].cast("string"), v["y"].cast("string"), v["z"].cast("string"))
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, vertex), ", "), F.lit(")"))
    part = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, ring), ", "), F.lit(")"))
    flat = F.array_join(F.transform(geom["parts"], lambda p: ring(F.get(p, F.lit(0)))), ", ")
    body = F.when(geom["kind"].isin("POINT", "LINESTRING"), ring(F.get(F.get(geom["parts"], F.lit(0)), F.lit(0))))
    body = body.when(geom["kind"] == "POLYGON", part(F.get(geom["parts"], F.lit(0)))).when(geom["kind"] == "MULTIPOLYGON", F.concat(F.lit("("), F.array_join(F.transform(geom["parts"], part), ", "), F.lit(")")))
    body = body.otherwise(F.concat(F.lit("("), flat, F.lit(")")))
    return F.concat(geom["kind"], F.when(has_z, " Z ").otherwise(" "), body)
