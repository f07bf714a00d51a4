"""Functions for SQL: scalar ones, whose bodies Spark puts into the query, and a lattice as a table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

FUNCTIONS = {
    "fv_voter(w0 DOUBLE, total DOUBLE) RETURNS DOUBLE": "1e0 / (1e0 + exp(-w0 - total))",
    "fv_prior_logit(p DOUBLE) RETURNS DOUBLE": "ln(p / (1e0 - p))",
    "fv_minmax(v DOUBLE, low DOUBLE, high DOUBLE) RETURNS DOUBLE": "CASE WHEN abs(high - low) <= 1e-8 + 1e-5 * abs(low) THEN 0e0 ELSE (v - low) / (high - low) END",
    "fv_hill(v DOUBLE, med DOUBLE, mad DOUBLE) RETURNS DOUBLE": "exp(-power(v - med, 2) / (2e0 * power(CASE WHEN mad = 0 THEN 1e-6 ELSE mad END, 2)))",
    "fv_distance(x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE) RETURNS DOUBLE": "sqrt(power(x0 - x1, 2) + power(y0 - y1, 2))",
}


LATTICE = "ix bigint, iy bigint, x double, y double"


def _axis(i: int, low: float, high: float, n: int) -> float:
    return float(low) if n == 1 else float(high) if i == n - 1 else low + i * ((high - low) / (n - 1))


class LatticeRow:
    """fv_lattice_row(xmin, ymin, xmax, ymax, nx, ny, iy): one row of nodes, for LATERAL joins with the rows' numbers."""

    def eval(self, xmin: float, ymin: float, xmax: float, ymax: float, nx: int, ny: int, iy: int) -> Iterator[tuple]:
        for ix in range(nx):
            yield ix, iy, _axis(ix, xmin, xmax, nx), _axis(iy, ymin, ymax, ny)


class Lattice:
    """fv_lattice(xmin, ymin, xmax, ymax, nx, ny): all nodes, made by the task that asks; large lattices take rows."""

    def eval(self, xmin: float, ymin: float, xmax: float, ymax: float, nx: int, ny: int) -> Iterator[tuple]:
        for iy in range(ny):
            yield from LatticeRow().eval(xmin, ymin, xmax, ymax, nx, ny, iy)


def register(spark: SparkSession) -> None:
    """Make the functions known to the session."""
    spark.udtf.register("fv_lattice", F.udtf(Lattice, returnType=LATTICE, useArrow=True))
    spark.udtf.register("fv_lattice_row", F.udtf(LatticeRow, returnType=LATTICE, useArrow=True))
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
