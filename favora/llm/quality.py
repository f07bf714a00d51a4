"""Quality scores from a regularised quadratic discriminant over transformed document statistics.

Every document is reduced to `FEATURES` statistics of its whole text.  Per class the mean and covariance come from grouped
sums over all labelled rows of the learning folds; covariances are shrunk towards the pooled diagonal.  The score is a
logistic calibration of the difference of the two Gaussian log-densities, whose Cholesky factors are computed once and
handed to the tasks.  Only arrays of fixed size reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from favora.functions.tables import store
from favora.llm.shared import mix, pieces, read, word_hashes, word_spans

FEATURES = ("log_words", "log_word_bytes", "upper", "symbols", "bars", "shouts", "digits", "beyond_ascii", "stops", "lines", "distinct", "distinct_pairs", "repeats", "top_share", "wordless")
SHRINKAGE = 0.15
LEAST_VARIANCE = 4e-4
THRESHOLD = 0.3
BINS = 400
STEP_BITS = 16
_CLASS = np.zeros(256, np.uint8)
for _chars, _code in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("abcdefghijklmnopqrstuvwxyz", 2), ("0123456789", 3), ("|", 4), ("!", 5), (".,;:?'\"-", 6), ("#$%&*+/<=>@\\^_`{}~[]()", 7), ("\n", 8)):
    _CLASS[[ord(c) for c in _chars]] = _code
_CLASS[0xC0:] = 9
_CLASS[0x80:0xC0] = 10


class Model(NamedTuple):
    """Class means, inverse Cholesky factors and log-determinants (order: class 0, class 1), and the calibration."""

    means: np.ndarray
    factors: np.ndarray
    logdets: np.ndarray
    slope: float = 1.0
    shift: float = 0.0


def _angle(part: np.ndarray, whole: np.ndarray, drawn: float = 4.0) -> np.ndarray:
    """A share on a scale of even variance, drawn towards 0 where there is little to count."""
    return np.arcsin(np.sqrt(np.clip(part / (whole + drawn), 0, 1)))


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each document; zeros count for an empty text."""
    kinds = _CLASS[data]

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    upper, lower, digits, bars, shouts, stops, symbols, lines, wide, rest = (count(kinds == k) for k in range(1, 11))
    starts, ends, at = word_spans(data, offsets)
    h = word_hashes(data, starts, ends)
    n = np.diff(at).astype(float)
    lettered = np.concatenate([[0], np.cumsum((kinds == 1) | (kinds == 2) | (kinds == 9))])
    bare = np.concatenate([[0], np.cumsum(lettered[ends] == lettered[starts])])
    same = np.concatenate([[0], np.cumsum(np.concatenate([[False], h[1:] == h[:-1]]) if len(h) else np.empty(0, bool))])
    pairs = mix(h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:]) if len(h) > 1 else np.empty(0, np.uint64)
    distinct, most, distinct_pairs = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
    for i, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)):
        if hi > lo:
            counts = np.unique(h[lo:hi], return_counts=True)[1]
            distinct[i], most[i] = len(counts), counts.max()
            distinct_pairs[i] = len(np.unique(pairs[lo : hi - 1]))
    repeats = np.where(n > 0, (same[at[1:]] - same[np.minimum(at[:-1] + 1, len(h))]).clip(0), 0) if len(h) else np.zeros(len(n))
    letters, chars = upper + lower + wide, np.diff(offsets) - rest
    return np.column_stack(
        [
            np.log1p(n),
            np.log((chars + 5) / (n + 1)),
            _angle(upper, letters, 20),
            _angle(symbols, chars, 80),
            _angle(bars, n),
            _angle(shouts, n),
            _angle(digits, chars, 80),
            _angle(wide, chars, 80),
            _angle(stops, n),
            np.log1p(lines) - 0.5 * np.log1p(n),
            np.log((distinct + 1) / (n + 1)) / np.log(n + np.e),
            np.log((distinct_pairs + 1) / (n + 1)) / np.log(n + np.e),
            _angle(repeats, n),
            _angle(most - 1, n),
            _angle(bare[at[1:]] - bare[at[:-1]], n),
        ]
    )


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x) with x the array of FEATURES, for each row of `docs`."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches, 1):
            x = statistics(data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, len(FEATURES))


def _sums(learning: DataFrame) -> dict[int, np.ndarray]:
    """For each class the sums of 1, x and x xᵀ, as one flat array.

    Statistics count in steps of 2 ** -STEP_BITS, so that the sums are whole numbers and don't depend on the order of rows.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _matrix(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                part = np.rint(np.column_stack([np.ones((y == k).sum()), x[y == k]]) * (1 << STEP_BITS)).astype(np.int64)
                v = (part.T @ part).ravel()
                yield pa.RecordBatch.from_arrays([pa.array([k] * v.size), pa.array(range(v.size)), pa.array(v)], names=["y", "at", "v"])

    rows = learning.select(F.col("y").cast("long"), "x").mapInArrow(task, "y long, at long, v long").groupBy("y", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    out: dict[int, np.ndarray] = {}
    for r in rows:
        out.setdefault(r.y, np.zeros((len(FEATURES) + 1) ** 2))[r.at] = float(r.v) / (1 << 2 * STEP_BITS)
    return {k: v for k, v in out.items() if v[0] > 0}


def _discriminant(sums: dict[int, np.ndarray]) -> Model:
    m, d = len(FEATURES) + 1, len(FEATURES)
    moments = [sums[k].reshape(m, m) for k in (0, 1)]
    counts = np.array([v[0, 0] for v in moments])
    means = np.array([v[0, 1:] / v[0, 0] for v in moments])
    covs = [v[1:, 1:] / n - np.outer(mu, mu) for v, n, mu in zip(moments, counts, means, strict=True)]
    pooled = np.diag(sum(n * np.diag(c) for n, c in zip(counts, covs, strict=True)) / counts.sum())
    # Few rows of a class: more of the pooled diagonal.
    shrink = [max(SHRINKAGE, d / (d + n)) for n in counts]
    lower = [np.linalg.cholesky((1 - s) * c + s * pooled + LEAST_VARIANCE * np.eye(d)) for s, c in zip(shrink, covs, strict=True)]
    return Model(means, np.array([np.linalg.inv(v) for v in lower]), np.array([2 * np.log(np.diag(v)).sum() for v in lower]))


def _difference(model: Model, x: np.ndarray) -> np.ndarray:
    """log p(x | class 1) - log p(x | class 0), within ±100."""
    one, two = (-0.5 * (((x - model.means[k]) @ model.factors[k].T) ** 2).sum(axis=1) - 0.5 * model.logdets[k] for k in (1, 0))
    return np.clip(one - two, -100, 100)


def _calibrated(model: Model, learning: DataFrame) -> Model:
    """Logistic slope and shift, fitted to counts of each class in BINS bins of the difference."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.minimum((_difference(model, _matrix(batch.column(1))) + 100) * (BINS / 200), BINS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bins)], names=["y", "bin"])

    rows = learning.select(F.col("y").cast("long"), "x").mapInArrow(task, "y long, bin long").groupBy("y", "bin").count().collect()
    at = np.array([(r.bin + 0.5) * (200 / BINS) - 100 for r in rows])
    y, n = np.array([r.y for r in rows], float), np.array([r["count"] for r in rows], float)
    w = np.array([0.5, 0.0])
    x = np.column_stack([at, np.ones(len(at))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (n * (y - p)) - 1e-3 * w)
        w = w + np.clip(step, -1, 1)
    return model._replace(slope=float(max(w[0], 1e-3)), shift=float(w[1]))


def fit(found: DataFrame, labels: DataFrame) -> Model | None:
    """The model of `found` (document_statistics) and `labels`; None where a class has no row.

    Rows with crc32(doc_id as text) mod 5 = 0 are left for tests.  Rows without a label or id don't count; where a doc_id
    has several labels, the smallest counts.
    """
    given = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("long").alias("y"))
    learning = store(found.where(~held_out()).join(given, "doc_id").select("y", "x"), "learning")
    sums = _sums(learning)
    return _calibrated(_discriminant(sums), learning) if len(sums) == 2 else None


def held_out() -> Column:
    """Whether the row is one that the model doesn't learn from; true for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `docs`.

    Null texts count as empty and are scored like all others.  Without labels of both classes every score is 0.5.
    Repeated rows are scored each; columns other than doc_id and text are not read.
    """
    found = store(document_statistics(docs), "statistics")
    model = fit(found, labels)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                score = np.full(batch.num_rows, 0.5)
            else:
                score = 1 / (1 + np.exp(-(model.slope * _difference(model, _matrix(batch.column(2))) + model.shift)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return found.select("doc_id", held_out().alias("held_out"), "x").mapInArrow(task, "doc_id long, held_out boolean, score double, predicted int")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: all `documents`, labelled by `labels`."""
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted 0 go.

    Rows without a doc_id stay; of rows that share one all go if one does.  Null and empty texts are scored like others.
    Without labels of both classes, and of an empty table, all rows stay.
    """
    gone = quality_scores(docs, read(spark, sf_dir, "labels")).where("predicted = 0").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
