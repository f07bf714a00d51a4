"""Polygons cut at a box into as many parts as there are, holes with the part that holds them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Point = tuple[float, float]
Ring = list[Point]


def area(ring: Ring) -> float:
    """Signed area of an open ring."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def holds(ring: Ring, p: Point) -> bool:
    """Whether a point lies inside an open ring."""
    inside = False
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y0 > p[1]) != (y1 > p[1]) and p[0] < x0 + (p[1] - y0) * (x1 - x0) / (y1 - y0):
            inside = not inside
    return inside


def cut_side(rings: list[Ring], axis: int, sign: float, bound: float) -> list[list[Ring]]:
    """The parts of a polygon (a shell, then holes) on one side of a line, sign * coordinate >= sign * bound.

    Where rings cross the line, the places of all crossings in order bound stretches that are inside by turns.  The chains
    of corners on the right side are therefore joined from each crossing to the other end of its stretch; corners on the
    line count as crossings.  Rings that the line misses stay; holes go to the part that holds them.
    """
    over = lambda p: sign * (p[axis] - bound)
    whole, chains = [], []
    for at, ring in enumerate(rings):
        if all(over(p) >= 0 for p in ring):
            whole.append((at, ring))
            continue
        inside = [over(p) > 0 for p in ring]
        if not any(inside):
            continue
        # From a corner outside, so that no chain wraps around.
        first = inside.index(False)
        turned = ring[first:] + ring[:first] + [ring[first]]
        chain: Ring = []
        for a, b in zip(turned[:-1], turned[1:], strict=True):
            if (over(a) > 0) != (over(b) > 0):
                t = over(a) / (over(a) - over(b))
                meet = [a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t]
                meet[axis] = bound
                chain.append((meet[0], meet[1]))
                if over(b) <= 0:
                    chains.append(chain)
                    chain = []
            if over(b) > 0:
                chain.append(b)
    ends = sorted((chain[k][1 - axis], i, k) for i, chain in enumerate(chains) for k in (0, -1))
    partner = {}
    for one, two in zip(ends[::2], ends[1::2], strict=True):
        partner[one[1:]], partner[two[1:]] = two[1:], one[1:]
    shells, used = [], set()
    for begin in range(len(chains)):
        if begin in used:
            continue
        ring, i, forward = [], begin, True
        while i not in used:
            used.add(i)
            ring += chains[i] if forward else chains[i][::-1]
            i, k = partner[i, -1 if forward else 0]
            forward = k == 0
        shells.append([p for p, q in zip(ring, ring[1:] + ring[:1], strict=True) if p != q])
    shells = [s for s in shells if len(s) > 2 and area(s)]
    parts = [[ring] for at, ring in whole if at == 0] + [[s] for s in shells]
    for at, ring in whole:
        if at:
            home = [p for p in parts if sum(holds(p[0], c) for c in ring) * 2 > len(ring)]
            if home:
                min(home, key=lambda p: abs(area(p[0]))).append(ring)
    return parts


def cut_polygon(rings: list[Ring], xmin: float, ymin: float, xmax: float, ymax: float) -> list[list[Ring]]:
    """The parts of a polygon of open rings inside a box, from left to right, then from below."""
    parts = [rings]
    for axis, sign, bound in ((0, 1.0, xmin), (0, -1.0, xmax), (1, 1.0, ymin), (1, -1.0, ymax)):
        parts = [q for p in parts for q in cut_side(p, axis, sign, bound)]
    return sorted((p for p in parts if area(p[0])), key=lambda p: min(p[0]))


def cut_polygons(df: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """`df` (rings: ARRAY<ARRAY<STRUCT<x, y>>>) with a row and `part` (from 0) for each part of a polygon inside the box.

    Polygons whose corners all lie inside stay as they are, and those beside the box are dropped, without leaving the JVM.
    Rings come back closed.  Null rings and rings of less than three corners have no part.
    """
    names = df.columns
    shell = F.get("rings", F.lit(0))
    xs, ys = F.transform(shell, lambda v: v["x"].cast("double")), F.transform(shell, lambda v: v["y"].cast("double"))
    boxed = df.withColumns({"_a": F.array_min(xs), "_b": F.array_min(ys), "_c": F.array_max(xs), "_d": F.array_max(ys)})
    met = boxed.where((F.col("_a") < xmax) & (F.col("_c") > xmin) & (F.col("_b") < ymax) & (F.col("_d") > ymin) & (F.col("_a") < F.col("_c")) & (F.col("_b") < F.col("_d")))
    inside = (F.col("_a") >= xmin) & (F.col("_c") <= xmax) & (F.col("_b") >= ymin) & (F.col("_d") <= ymax)
    plain = "array<array<struct<x: double, y: double>>>"
    pair = lambda r: F.transform(r, lambda v: F.struct(v["x"].cast("double").alias("x"), v["y"].cast("double").alias("y")))
    closed = lambda r: F.when(F.element_at(r, 1) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1)))
    given = met.withColumn("rings", F.transform("rings", pair))
    kept = given.where(inside).withColumn("rings", F.transform("rings", closed)).withColumn("part", F.lit(0))
    rest = given.where(~inside).select(*names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = names.index("rings")
        kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
        for batch in batches:
            rows, rings, numbers = [], [], []
            for i, polygon in enumerate(batch.column(place).to_pylist()):
                open_ = [[(v["x"], v["y"]) for v in r] for r in polygon]
                open_ = [r[:-1] if len(r) > 1 and r[0] == r[-1] else r for r in open_]
                for n, part in enumerate(cut_polygon([r for k, r in enumerate(open_) if len(r) > 2 or not k], xmin, ymin, xmax, ymax)):
                    rows.append(i)
                    rings.append([[{"x": x, "y": y} for x, y in [*r, r[0]]] for r in part])
                    numbers.append(n)
            columns = [c.take(pa.array(rows, pa.int64())) for c in batch.columns]
            columns[place] = pa.array(rings, kind)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(numbers, pa.int32())], names=[*names, "part"])

    shape = ", ".join(f"`{c}` {plain if c == 'rings' else t}" for c, t in rest.dtypes) + ", part int"
    return kept.select(*names, "part").unionByName(rest.mapInArrow(task, shape))
