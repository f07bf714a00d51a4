"""Whitened embeddings, from moments merged pairwise (Chan, Golub and LeVeque, 1979).

Each partition computes its count, mean and centred scatter; the merge formula joins two of them without losing digits to a
large mean, in a treeReduce whose values have the size of one matrix.  The driver decomposes that matrix.  A second pass
over all rows takes the moments of the whitened vectors in the same way and measures how far their covariance is from the
identity.

Entries are whole numbers (floor(64 * c) + 1000000), so sums are exact and a row's distance from the mean is too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from favora.llm.shared import read

SCALE = 64
OFFSET = 1_000_000
#: Components that are given.
COMPONENTS = 32
#: Of the greatest eigenvalue; directions of less have no spread in double precision, and are left out.
FLAT = 1e-12
#: Numbers of a matrix that are worked on together.
TOGETHER = 1 << 21


class Moments(NamedTuple):
    """Count, exact sums (Python integers), mean and centred scatter of rows."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    scatter: np.ndarray


class Basis(NamedTuple):
    """The moments of the fit list, components as columns by falling eigenvalue, eigenvalues, and the covariance's trace."""

    moments: Moments
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def merged(a: Moments, b: Moments) -> Moments:
    """The moments of the rows of both."""
    if not a.n or not b.n:
        return a if a.n else b
    n, apart = a.n + b.n, b.mean - a.mean
    return Moments(n, a.sums + b.sums, a.mean + apart * (b.n / n), a.scatter + b.scatter + np.outer(apart, apart) * (a.n * b.n / n))


def local_moments(x: np.ndarray) -> Moments:
    """The moments of the rows of a matrix."""
    mean = x.mean(axis=0)
    rest = x - mean
    # What rounding of the mean has left.
    left = rest.mean(axis=0)
    rest -= left
    return Moments(len(x), x.sum(axis=0).astype(object), mean + left, rest.T @ rest)


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    most = max(1, TOGETHER // max(width, 1))
    for batch in batches:
        for lo in range(0, batch.num_rows, most):
            part = batch.slice(lo, most)
            yield part, np.asarray(part.column(part.num_columns - 1).flatten()).reshape(part.num_rows, width)


def moments(rows: DataFrame, width: int, made: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> Moments:
    """The moments of made(x) over all rows, x being the last column; n is 0 without rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0)
        found = Moments(0, none.astype(object), none, none)
        for _, x in _matrices(batches, width):
            found = merged(found, local_moments(made(x)))
        yield pa.RecordBatch.from_arrays([pa.array([found.n]), pa.array([[str(v) for v in found.sums]]), pa.array([found.mean.tobytes()]), pa.array([found.scatter.tobytes()])], names=["n", "sums", "mean", "scatter"])

    def taken(r) -> Moments:
        mean, scatter = np.frombuffer(r.mean), np.frombuffer(r.scatter)
        return Moments(r.n, np.array([float(v) if "." in v or "e" in v else int(v) for v in r.sums], object), mean, scatter.reshape(len(mean), len(mean)))

    parts = rows.mapInArrow(task, "n long, sums array<string>, mean binary, scatter binary").rdd
    if not parts.getNumPartitions():
        return Moments(0, np.zeros(0, object), np.zeros(0), np.zeros((0, 0)))
    return parts.map(taken).treeReduce(merged)


def whole_vectors(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, x) of the rows that count, and the length of x.

    Rows go whose vector is null or empty or holds null or non-finite entries.  If vectors differ in length, those of the
    most frequent length count (of several, the greatest one), as others can't be compared with them.
    """
    sound = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(sound)
    widths = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    if not widths:
        return rows.select("vec_id", F.lit(None).cast("array<long>").alias("x")), 0
    width = widths[0].width
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET)
    return rows.where(F.size("embedding") == width).select("vec_id", x.alias("x")), width


def fit(rows: DataFrame, width: int, components: int) -> Basis | None:
    """The basis of `rows` (whole_vectors); None where there is no spread in any direction."""
    found = moments(rows, width)
    if not found.n:
        return None
    values, vectors = np.linalg.eigh(found.scatter / found.n)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = min(components, int((values > FLAT * max(values[0], 0)).sum()))
    return Basis(found, vectors[:, :keep], values[:keep], float(np.trace(found.scatter)) / found.n) if keep else None


def _apart(x: np.ndarray, found: Moments) -> np.ndarray:
    """n * x - S, exactly."""
    if found.n < 1 << 40 and np.abs(x).max(initial=0) < 1 << 22:
        return found.n * x - found.sums.astype(np.int64)
    return found.n * x.astype(object) - found.sums


def _whitened(basis: Basis) -> Callable[[np.ndarray], np.ndarray]:
    turn = basis.vectors / np.sqrt(basis.values)
    return lambda x: (_apart(x, basis.moments) / basis.moments.n).astype(float) @ turn


def _deviation(apart: np.ndarray) -> list[int]:
    if apart.dtype != object and len(apart) and float(np.abs(apart).max()) ** 2 * apart.shape[1] < 2.0**62:
        return (apart * apart).sum(axis=1).tolist()
    return [sum(int(v) ** 2 for v in row) for row in apart]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Basis | None, float]:
    """(vec_id, deviation, whitened) of each row that counts, the basis, and identity_error.

    deviation (decimal(38,0)) is the sum of (n * x - S) ** 2 over the dimensions; whitened has the components in order.
    identity_error is the largest absolute entry of the whitened vectors' covariance minus the identity.

    whole_vectors() says which rows count.  Repeated rows and rows without an id are vectors like others; columns other than
    vec_id and embedding are not read.  Directions without spread have no component; where there is no other, or no row,
    the basis is None and the result is empty.  Ties of eigenvalues stand in the order of the decomposition.
    """
    rows, width = whole_vectors(vectors)
    basis = fit(rows, width, components) if width else None
    if basis is None:
        none = rows.select("vec_id", F.lit(None).cast("decimal(38,0)").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened"))
        return none.where("false"), None, 0.0
    turned = _whitened(basis)
    again = moments(rows, width, turned)
    error = float(np.abs(again.scatter / again.n - np.eye(len(basis.values))).max())
    kind = rows.schema["vec_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, width):
            far = pa.array([str(v) for v in _deviation(_apart(x, basis.moments))])
            w = turned(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), far, lists], names=["vec_id", "deviation", "whitened"])

    out = rows.mapInArrow(task, f"vec_id {kind}, deviation string, whitened array<double>")
    return out.select("vec_id", F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened"), basis, error


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: all `embeddings`, a row for each vector and component; a deviation beyond a long is null."""
    out, basis, error = whiten(read(spark, sf_dir, "embeddings"))
    shares = [] if basis is None else (basis.values / basis.trace).tolist()
    rows = out.select("vec_id", F.expr("try_cast(deviation as long)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(basis.moments.n if basis else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(F.array(*[F.lit(float(v)) for v in shares]) if shares else F.array(F.lit(0.0)), F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
