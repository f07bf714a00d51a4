"""Gaussian-process extrapolation of a level: statistics and metrics as aggregations, kernels and fit from sums.

A sparse posterior over inducing points needs of the training rows only the sums of k kᵀ and k y over them, k being a row's
covariances with the inducing points; the bound's gradient needs one more sum, of a row's weights times the derivatives of
its covariances.  Up to LOCAL rows both are added up on the driver; more rows are added up in the tasks, all of them, for each
step of the same bounded quasi-Newton ascent.  Prediction runs in the tasks with the small fitted model.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass
from pathlib import Path
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from favora.functions.tables import store
from favora.operators.clean import prepare_slice
from favora.operators.grid import grid_from_tidy
from favora.operators.interpolate import backfill_nearest, join_predictions

LOCAL = 5_000
#: Steps of the ascent at most, and the gain below which it ends.
ROUNDS, GAIN = 100, 1e-7
JITTER = 1e-8


def standardise(train: DataFrame, full: DataFrame, columns: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """`full` with its columns standardised by mean and population deviation of `train`; a deviation of 0 counts as 1."""
    s = train.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return full.withColumns({c: (F.col(c) - s[f"m_{c}"]) / (s[f"s_{c}"] or 1.0) for c in columns})


def split(df: DataFrame, test_size: float, seed: int = 0, keys: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """`df` with `test`, true for about test_size of the rows, by an MD5 of the seed and the keys as text."""
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed).cast("string"), *(F.col(c).cast("string") for c in keys))), 1, 7), 16, 10).cast("long")
    return df.withColumn("test", number < int(test_size * (1 << 28)))


def variance(df: DataFrame, column: str) -> float:
    """Sample variance."""
    return df.agg(F.var_samp(column)).first()[0]


def likelihood_params(var: float) -> dict:
    """Start, Gamma prior (shape, rate) and bounds of the noise variance."""
    init = 0.01 * var
    return {"init": init, "prior": (2.0, init / 2), "bounds": (1e-5, 0.1 * var)}


def global_radius(df: DataFrame) -> float:
    """Half of the longer side of the bounds."""
    a, b, c, d = df.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    return max(b - a, d - c) / 2


def lengthscale_bounds(radius: float, low: float = 0.02, high: float = 0.20) -> tuple[float, float]:
    """Shares of the radius."""
    return low * radius, high * radius


@dataclass(frozen=True)
class Part:
    """One kernel: rbf, matern32, long, bias or white; variance and length scales with their bounds (equal if fixed)."""

    kind: str
    variance: float
    bounds: tuple[float, float]
    scales: tuple[float, ...] = ()
    scale_bounds: tuple[float, float] = (0.0, 0.0)


def combined_kernel(var: float, radius: float, use_matern: bool = True, use_rbf: bool = True, bias: bool = True, white: bool = True, longscale: bool = True) -> list[Part]:
    """The enabled kernels; ValueError if there is none."""
    lo, hi = lengthscale_bounds(radius)
    mid, v = (lo + hi) / 2, max(var, 1e-6)
    parts = [Part("rbf", v, (0.01 * v, 10 * v), (mid, mid), (lo, hi))] if use_rbf else []
    parts += [Part("matern32", 0.5 * v, (0.01 * v, 10 * v), (mid, mid), (lo, hi))] if use_matern else []
    parts += [Part("long", 0.05, (0.05, 0.05), (2 * radius, 2 * radius), (2 * radius, 2 * radius))] if longscale else []
    parts += [Part("bias", 1.0, (1.0, 1.0))] if bias else []
    parts += [Part("white", 1e-5, (1e-5, 1e-5))] if white else []
    if not parts:
        raise ValueError("no kernel is enabled")
    return parts


def covariance(parts: list[Part], a: np.ndarray, b: np.ndarray, same: bool = False) -> np.ndarray:
    """The summed kernels between two sets of points; white noise only where they are the same."""
    out = np.zeros((len(a), len(b)))
    for p in parts:
        if p.kind == "bias":
            out += p.variance
        elif p.kind == "white":
            out += p.variance * np.eye(len(a)) if same else 0.0
        else:
            r2 = (((a[:, None] - b[None]) / np.array(p.scales)) ** 2).sum(axis=2)
            r = np.sqrt(r2)
            out += p.variance * ((1 + math.sqrt(3) * r) * np.exp(-math.sqrt(3) * r) if p.kind == "matern32" else np.exp(-r2 / 2))
    return out


@dataclass(frozen=True)
class Model:
    """A fitted sparse posterior: kernels, noise, inducing points, weights of the mean and the matrix of the variance."""

    parts: list[Part]
    noise: float
    noise_bounds: tuple[float, float]
    inducing: np.ndarray
    alpha: np.ndarray
    core: np.ndarray
    mean: float
    log_likelihood: float
    n_used: int

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Means and standard deviations."""
        k = covariance(self.parts, x, self.inducing)
        prior = sum(p.variance for p in self.parts)
        return self.mean + k @ self.alpha, np.sqrt(np.maximum(prior - ((k @ self.core) * k).sum(axis=1), 0) + self.noise)


class Sums(NamedTuple):
    """Of the training rows, with the inducing points z: the sums of k kᵀ, of k y and of y y, and the number of rows."""

    kk: np.ndarray
    ky: np.ndarray
    yy: float
    n: int


def local_sums(parts: list[Part], x: np.ndarray, y: np.ndarray, z: np.ndarray) -> Sums:
    """Sums over arrays."""
    k = covariance(parts, z, x)
    return Sums(k @ k.T, k @ y, float(y @ y), len(x))


def row_sums(rows: DataFrame, parts: list[Part], mean: float, z: np.ndarray) -> Sums:
    """Sums over the rows (x, y, value) in the tasks; a matrix of the size of z for each task reaches the driver's sum."""
    m = len(z)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kk, ky, yy, n = np.zeros((m, m)), np.zeros(m), 0.0, 0
        for batch in batches:
            x, y = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:2]]), batch.column(2).to_numpy(zero_copy_only=False) - mean
            for lo in range(0, len(x), 2048):
                part = local_sums(parts, x[lo : lo + 2048], y[lo : lo + 2048], z)
                kk, ky, yy, n = kk + part.kk, ky + part.ky, yy + part.yy, n + part.n
        if n:
            flat = np.concatenate([kk.ravel(), ky, [yy, n]])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat))), pa.array(flat)], names=["at", "v"])

    found = rows.select("x", "y", "value").mapInArrow(task, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(m * m + m + 2)
    flat[found.column("at").to_numpy()] = found.column("v").to_numpy()
    return Sums(flat[: m * m].reshape(m, m), flat[m * m : -2], float(flat[-2]), int(round(flat[-1])))


class Weights(NamedTuple):
    """How the bound changes with kk, ky, the inducing points' covariances and the noise variance, and the noise itself."""

    kk: np.ndarray
    ky: np.ndarray
    kmm: np.ndarray
    noise: float


def slopes(parts: list[Part], a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """The derivatives of covariance(parts, a, b) by the logarithms of its free parameters, in the order of free_bounds()."""
    out = []
    for p in parts:
        square = [((a[:, None, k] - b[None, :, k]) / s) ** 2 for k, s in enumerate(p.scales)]
        r = np.sqrt(sum(square)) if p.scales else None
        if p.bounds[0] < p.bounds[1]:
            out.append(covariance([p], a, b, same=a is b))
        if p.scales and p.scale_bounds[0] < p.scale_bounds[1]:
            each = 3 * p.variance * np.exp(-math.sqrt(3) * r) if p.kind == "matern32" else p.variance * np.exp(-r * r / 2)
            out += [each * q for q in square]
    return out


def free_bounds(parts: list[Part]) -> list[tuple[float, float, float]]:
    """(start, lower, upper) of each free parameter: a kernel's variance, then its scales."""
    out = []
    for p in parts:
        if p.bounds[0] < p.bounds[1]:
            out.append((p.variance, *p.bounds))
        if p.scales and p.scale_bounds[0] < p.scale_bounds[1]:
            out += [(s, *p.scale_bounds) for s in p.scales]
    return out


def local_slopes(parts: list[Part], x: np.ndarray, y: np.ndarray, z: np.ndarray, w: Weights) -> np.ndarray:
    """What the rows' covariances add to the bound's gradient."""
    k = covariance(parts, z, x)
    weight = 2 * w.kk @ k + np.outer(w.ky, y)
    return np.array([float((weight * s).sum()) for s in slopes(parts, z, x)])


def row_slopes(rows: DataFrame, parts: list[Part], mean: float, z: np.ndarray, w: Weights) -> np.ndarray:
    """The same over the rows (x, y, value) in the tasks; a few numbers for each task reach the driver's sum."""
    n = len(free_bounds(parts))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(n)
        for batch in batches:
            x, y = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:2]]), batch.column(2).to_numpy(zero_copy_only=False) - mean
            for lo in range(0, len(x), 2048):
                out += local_slopes(parts, x[lo : lo + 2048], y[lo : lo + 2048], z, w)
        yield pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(out)], names=["at", "v"])

    found = rows.select("x", "y", "value").mapInArrow(task, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(n)
    for r in found:
        out[r.at] = r.v
    return out


def _posterior(parts: list[Part], noise: float, sums: Sums, z: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, Weights]:
    """The variational bound, weights of the mean, the matrix of the variance, and how the bound changes with what it is made of."""
    m, n = len(z), sums.n
    kmm = covariance(parts, z, z, same=True) + JITTER * np.eye(m)
    l = np.linalg.cholesky(kmm)
    inverse = np.linalg.inv(l)
    aa = inverse @ sums.kk @ inverse.T
    lb = np.linalg.cholesky(np.eye(m) + (aa + aa.T) / 2 / noise)
    c = np.linalg.solve(lb, inverse @ sums.ky) / noise
    rest = n * sum(p.variance for p in parts if p.kind != "white") - float(np.trace(aa))
    score = -0.5 * n * math.log(2 * math.pi * noise) - np.log(np.diag(lb)).sum() - 0.5 * sums.yy / noise + 0.5 * c @ c - 0.5 * max(rest, 0) / noise
    inner = np.linalg.inv(lb) @ inverse
    # The inverses of kmm and of kmm + kk / noise, and the latter times ky.
    whole, both = inverse.T @ inverse, inner.T @ inner
    u = both @ sums.ky
    open_ = float(rest > 0)
    by_noise = -0.5 * n / noise + 0.5 * float((both * sums.kk).sum()) / noise**2 + 0.5 * sums.yy / noise**2 + 0.5 * float(u @ sums.kk @ u) / noise**4 - float(sums.ky @ u) / noise**3 + 0.5 * open_ * rest / noise**2
    by_kk = -0.5 * both / noise - 0.5 * np.outer(u, u) / noise**3 + 0.5 * open_ * whole / noise
    by_kmm = -0.5 * both + 0.5 * whole - 0.5 * np.outer(u, u) / noise**2 - 0.5 * open_ * whole @ sums.kk @ whole / noise
    return float(score), inner.T @ c, whole - both, Weights(by_kk, u / noise**2, by_kmm, by_noise)


def kmeans(x: np.ndarray, k: int, seed: int = 0, rounds: int = 10) -> np.ndarray:
    """Centres of a few rounds of Lloyd's algorithm."""
    centres = np.random.default_rng(seed).permutation(x)[:k]
    for _ in range(rounds):
        of = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[of == j].mean(axis=0) if (of == j).any() else centres[j] for j in range(len(centres))])
    return centres


def row_kmeans(rows: DataFrame, k: int, seed: int = 0, rounds: int = 5) -> np.ndarray:
    """The same over the rows (x, y) in the tasks; the first centres are the rows of the least hashes."""
    first = rows.select("x", "y").distinct().orderBy(F.xxhash64(F.lit(seed), "x", "y")).limit(k).toPandas()
    centres = first[["x", "y"]].to_numpy(float)

    def sums(centres: np.ndarray) -> pa.Table:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(centres), 3))
            for batch in batches:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                for lo in range(0, len(x), 4096):
                    part = x[lo : lo + 4096]
                    of = ((part[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
                    total += np.column_stack([np.bincount(of, weights=w, minlength=len(centres)) for w in (part[:, 0], part[:, 1], np.ones(len(part)))])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(centres))), *(pa.array(total[:, j]) for j in range(3))], names=["at", "x", "y", "n"])

        return rows.select("x", "y").mapInArrow(task, "at long, x double, y double, n double").groupBy("at").agg(*(F.sum(c).alias(c) for c in "xyn")).toArrow().sort_by("at")

    for _ in range(rounds):
        found = sums(centres)
        n = found.column("n").to_numpy()
        some = np.flatnonzero(n > 0)
        centres[some] = np.column_stack([found.column(c).to_numpy()[some] / n[some] for c in "xy"])
    return centres


def ascend(value: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """The place of a greatest value within bounds, by projected quasi-Newton steps (BFGS); value() gives the gradient too."""
    x = np.clip(start, low, high)
    now, g = value(x)
    h, fresh = np.eye(len(x)), True
    for _ in range(rounds):
        # At a bound that the gradient pushes against, a parameter stays.
        free = ~(((x <= low) & (g < 0)) | ((x >= high) & (g > 0)))
        if not free.any() or np.abs(g[free]).max() < GAIN:
            break
        d = np.zeros(len(x))
        d[free] = h[np.ix_(free, free)] @ g[free]
        if d @ g <= 0:
            h, fresh, d = np.eye(len(x)), True, np.where(free, g, 0)
        d *= min(1.0, 1.0 / np.abs(d).max())
        step, found = 1.0, None
        for _ in range(25):
            y = np.clip(x + step * d, low, high)
            try:
                then, gy = value(y)
            except np.linalg.LinAlgError:
                then = -np.inf
            if then > now and then >= now + 1e-4 * (g @ (y - x)):
                found = y, then, gy
                break
            step /= 2.5
        gain = found[1] - now if found else 0.0
        if gain < GAIN * max(1.0, abs(now)) and fresh:
            # The gradient itself leads no further.
            if found:
                x, now = found[:2]
            break
        if found:
            y, then, gy = found
            s, t = y - x, g - gy
            x, now, g = y, then, gy
        if gain < GAIN * max(1.0, abs(now)):
            h, fresh = np.eye(len(x)), True
            continue
        if s @ t > 1e-10 * math.sqrt((s @ s) * (t @ t)):
            if fresh:
                h = np.eye(len(x)) * ((s @ t) / (t @ t))
            rho = 1 / (s @ t)
            v = np.eye(len(x)) - rho * np.outer(s, t)
            h, fresh = v @ h @ v.T + rho * np.outer(s, s), False
        else:
            h, fresh = np.eye(len(x)), True
    return x, now


def _search(var: float, radius: float, mean: float, z: np.ndarray, sums: Callable[[list[Part]], Sums], inclines: Callable[[list[Part], Weights], np.ndarray], restarts: int, **kernel: bool) -> Model:
    """The model of the greatest variational bound with the noise's Gamma prior, by ascend() over the logarithms of the
    parameters; later starts are drawn in the bounds."""
    parts, lik = combined_kernel(var, radius, **kernel), likelihood_params(max(var, 1e-6))
    shape, rate = lik["prior"]
    free = free_bounds(parts)
    bounds = [(min(1e-5, lik["init"]), max(lik["bounds"][1], lik["init"])), *((lo, hi) for _, lo, hi in free)]
    limits = np.log(np.array(bounds))

    def made(v: np.ndarray) -> tuple[list[Part], float]:
        out, i = [], 1
        for p in parts:
            variance, scales = p.variance, p.scales
            if p.bounds[0] < p.bounds[1]:
                variance, i = float(np.exp(v[i])), i + 1
            if scales and p.scale_bounds[0] < p.scale_bounds[1]:
                scales, i = tuple(np.exp(v[i : i + 2]).tolist()), i + 2
            out.append(Part(p.kind, variance, p.bounds, scales, p.scale_bounds))
        return out, float(np.exp(v[0]))

    def value(v: np.ndarray) -> tuple[float, np.ndarray]:
        found, noise = made(v)
        used = sums(found)
        score, _, _, w = _posterior(found, noise, used, z)
        g = inclines(found, w) + np.array([float((w.kmm * k).sum()) for k in slopes(found, z, z)])
        # The rows' prior variances are part of the bound's trace.
        of = 0
        for p in found:
            if p.bounds[0] < p.bounds[1]:
                g[of] -= 0.5 * used.n * p.variance / noise * (p.kind != "white")
                of += 1
            of += len(p.scales) * (p.scale_bounds[0] < p.scale_bounds[1])
        prior, by_prior = (shape - 1) * math.log(noise) - rate * noise, (shape - 1) - rate * noise
        return score + prior, np.append(w.noise * noise + by_prior, g)

    r = np.random.default_rng(0)
    top = None
    for again in range(1 + restarts):
        start = np.log([lik["init"], *(x for x, _, _ in free)]) if not again else r.uniform(limits[:, 0], limits[:, 1])
        v, best = ascend(value, start, limits[:, 0], limits[:, 1])
        if top is None or best > top[0]:
            top = best, v
    found, noise = made(top[1])
    used = sums(found)
    score, alpha, core, _ = _posterior(found, noise, used, z)
    return Model(found, noise, bounds[0], z, alpha, core, mean, score, used.n)


def fit(x: np.ndarray, y: np.ndarray, n_inducing: int = 300, restarts: int = 0, z: np.ndarray | None = None, **kernel: bool) -> Model:
    """A model of arrays, of bounded parameters; z: inducing points, else the centres of kmeans()."""
    var = float(np.var(y, ddof=1)) if len(y) > 1 else 1.0
    z = kmeans(x, min(n_inducing, max(20, len(x) // 10), len(x))) if z is None else z
    mean = float(y.mean())
    radius = max(float(np.ptp(x, axis=0).max()) / 2, 1e-6)
    return _search(var, radius, mean, z, lambda parts: local_sums(parts, x, y - mean, z), lambda parts, w: local_slopes(parts, x, y - mean, z, w), restarts, **kernel)


def fit_rows(rows: DataFrame, n_inducing: int = 300, restarts: int = 0, local: int = LOCAL, **kernel: bool) -> Model:
    """A model of all rows (x, y, value), however many; ValueError without any.

    Up to `local` rows are added up on the driver, more in the tasks; inducing points, ascent and result are the same.
    """
    rows = store(rows.select("x", "y", "value"), "training")
    n, var, mean, *box = rows.agg(F.count("*"), F.var_samp("value"), F.avg("value"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if not n:
        raise ValueError("no rows to learn from")
    z = row_kmeans(rows, min(n_inducing, max(20, n // 10), n))
    if n <= local:
        given = rows.orderBy("x", "y", "value").toPandas()
        return fit(given[["x", "y"]].to_numpy(float), given["value"].to_numpy(float), restarts=restarts, z=z, **kernel)
    radius = max(box[1] - box[0], box[3] - box[2]) / 2 or 1e-6
    return _search(var, radius, mean, z, lambda parts: row_sums(rows, parts, mean, z), lambda parts, w: row_slopes(rows, parts, mean, z, w), restarts, **kernel)


def noise_bounds(model: Model) -> tuple[float, float]:
    """The bounds of the fitted noise variance."""
    return model.noise_bounds


def n_parameters(model: Model) -> int:
    """Free parameters of the fit."""
    return 1 + sum((p.bounds[0] < p.bounds[1]) + len(p.scales) * (p.scale_bounds[0] < p.scale_bounds[1]) for p in model.parts)


def save_model(model: Model, path: str) -> None:
    """The model as one .npz file."""
    np.savez(path, inducing=model.inducing, alpha=model.alpha, core=model.core, rest=json.dumps({"parts": [asdict(p) for p in model.parts], "noise": model.noise, "noise_bounds": model.noise_bounds, "mean": model.mean, "log_likelihood": model.log_likelihood, "n_used": model.n_used}))


def load_model(path: str) -> Model:
    """A saved model; FileNotFoundError if there is none."""
    if not Path(path).exists():
        raise FileNotFoundError(path)
    f = np.load(path)
    rest = json.loads(str(f["rest"]))
    parts = [Part(p["kind"], p["variance"], tuple(p["bounds"]), tuple(p["scales"]), tuple(p["scale_bounds"])) for p in rest["parts"]]
    return Model(parts, rest["noise"], tuple(rest["noise_bounds"]), f["inducing"], f["alpha"], f["core"], rest["mean"], rest["log_likelihood"], rest["n_used"])


def limits_hit(model: Model, tolerance: float = 1e-6) -> list[str]:
    """Parameters at one of their bounds, of kernels and noise."""
    near = lambda v, b: b[0] < b[1] and min(abs(v - b[0]), abs(v - b[1])) < tolerance
    out = [f"{p.kind}.variance" for p in model.parts if near(p.variance, p.bounds)]
    out += [f"{p.kind}.lengthscale" for p in model.parts if any(near(s, p.scale_bounds) for s in p.scales)]
    return out + ["noise"] * near(model.noise, model.noise_bounds)


def predict(cells: DataFrame, model: Model, shift: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """`cells` (standardised x, y) with prediction and sigma, shifted back by (mean, deviation) of the values."""
    names = cells.columns
    kinds = dict(cells.dtypes)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("x", "y")])
            mean, sigma = model.predict(x) if len(x) else (np.empty(0), np.empty(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shift[0] + shift[1] * mean), pa.array(shift[1] * sigma)], names=[*names, "prediction", "sigma"])

    return cells.mapInArrow(task, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", prediction double, sigma double")


def prediction_grid(cells: DataFrame, model: Model, shift: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """predict() on the full lattice of the cells' coordinates (ix, iy, x, y), in long form: what a pivot of y by x holds.

    Of several cells at one place the mean counts; places without a cell are NULL.
    """
    found = predict(cells.select("x", "y"), model, shift).groupBy("x", "y").agg(F.avg("prediction").alias("prediction"), F.avg("sigma").alias("sigma"))
    lattice = grid_from_tidy(found.select("x", "y", F.col("prediction").alias("value"))).withColumnRenamed("value", "prediction")
    return lattice.join(found.select("x", "y", "sigma"), ["x", "y"], "left").select("ix", "iy", "x", "y", "prediction", "sigma")


def assess(df: DataFrame, y: str = "y", prediction: str = "prediction", sigma: str = "sigma", model: Model | None = None) -> DataFrame:
    """One row: n, rmse, r2, mae and the share of values within two sigma; with a model its log_likelihood, aic and bic."""
    e = F.col(y) - F.col(prediction)
    out = df.agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / (F.var_pop(y) * F.count("*"))).alias("r2"), F.avg(F.abs(e)).alias("mae"), F.avg((F.abs(e) <= 2 * F.col(sigma)).cast("double")).alias("coverage"))
    if model is None:
        return out
    aic, bic = information_criteria(model.log_likelihood, n_parameters(model), model.n_used)
    return out.withColumns({"log_likelihood": F.lit(model.log_likelihood), "aic": F.lit(aic), "bic": F.lit(bic)})


def information_criteria(log_likelihood: float, n_params: int, n: int) -> tuple[float, float]:
    """AIC and BIC."""
    return 2 * n_params - 2 * log_likelihood, n_params * math.log(n) - 2 * log_likelihood


def report(metrics: dict) -> list[str]:
    """Warnings about a fit's error, R² and coverage."""
    out = [f"RMSE {metrics['rmse']:.3f} is over 0.1"] if metrics["rmse"] > 0.1 else []
    out += [f"R2 {metrics['r2']:.3f} is under 0.8"] if metrics["r2"] < 0.8 else []
    return out + ([f"coverage {metrics['coverage']:.3f} is outside 0.90 to 0.98"] if not 0.9 <= metrics["coverage"] <= 0.98 else [])


def _chi2_tail(x: float, k: int) -> float:
    """Upper tail of chi-squared, by the series of the regularised gamma function."""
    if x <= 0:
        return 1.0
    a, h = k / 2, x / 2
    term = total = 1 / a
    for i in range(1, 1000):
        term *= h / (a + i)
        total += term
        if term < total * 1e-14:
            break
    return min(1.0, max(0.0, 1 - total * math.exp(-h + a * math.log(h) - math.lgamma(a))))


def _beta_tail(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log(1 - x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        term = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / max(1 + term * d, 1e-300) if 1 + term * d > 0 else 1 / (1 + term * d or 1e-300)
        c = 1 + term / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-13 and i:
            break
    return min(1.0, max(0.0, front * (f - 1)))


def f_tail(x: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution."""
    return 1 - _beta_tail(d1 * x / (d1 * x + d2), d1 / 2, d2 / 2) if x > 0 else 1.0


def shapiro_wilk(r: np.ndarray) -> tuple[float, float]:
    """W and its p-value by Royston's approximation (AS R94), for 4 values or more."""
    x, n = np.sort(r), len(r)
    normal = NormalDist()
    m = np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    square, u = float(m @ m), 1 / math.sqrt(n)
    # The polynomials of the algorithm, fixed values.
    last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, m[-1] / math.sqrt(square)], u)
    a = m / math.sqrt(square)
    if n > 5:
        next_ = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(square)], u)
        a = m / math.sqrt((square - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * next_**2))
        a[[1, -2]] = -next_, next_
    else:
        a = m / math.sqrt((square - 2 * m[-1] ** 2) / (1 - 2 * last**2))
    a[[0, -1]] = -last, last
    spread = float(((x - x.mean()) ** 2).sum())
    if spread <= 0:
        return 1.0, 1.0
    w = min(1 - 1e-15, float(a @ x) ** 2 / spread)
    if n <= 11:
        gamma = 0.459 * n - 2.273
        mu, sigma = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
        inner = gamma - math.log(1 - w)
        z = (-math.log(inner) - mu) / sigma if inner > 0 else 40.0
    else:
        mu, sigma = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], math.log(n)), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], math.log(n)))
        z = (math.log(1 - w) - mu) / sigma
    return w, 1 - normal.cdf(z)


def dagostino(skew: float, kurt: float, n: int) -> float:
    """p-value of D'Agostino and Pearson's test, for 8 values or more."""
    y = skew * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (beta - 1)) - 1
    alpha = math.sqrt(2 / (w2 - 1))
    z1 = math.asinh(y / alpha) / math.sqrt(0.5 * math.log(w2))
    mean, var = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (kurt - mean) / math.sqrt(var)
    third = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / third * (2 / third + math.sqrt(1 + 4 / third**2))
    base = 1 + x * math.sqrt(2 / (a - 4))
    z2 = (1 - 2 / (9 * a) - math.copysign(abs((1 - 2 / a) / base) ** (1 / 3), base) if base else 0.0) / math.sqrt(2 / (9 * a))
    return _chi2_tail(z1 * z1 + z2 * z2, 2)


def residual_statistics(r: np.ndarray, lags: int = 10) -> dict[str, float]:
    """p-values of tests on residuals, in their order: Shapiro-Wilk, D'Agostino and Jarque-Bera (normal), Levene by medians
    of the two halves (even variance), and Ljung-Box (white)."""
    n = len(r)
    if not np.ptp(r):
        return dict.fromkeys(["shapiro_wilk", *(["dagostino"] if n >= 8 else []), "jarque_bera", "levene", "ljung_box"], 1.0)
    c = r - r.mean()
    s2 = float((c**2).mean()) or 1e-300
    skew, kurt = float((c**3).mean()) / s2**1.5, float((c**4).mean()) / s2**2
    auto = [float((c[k:] * c[:-k]).sum()) / (n * s2) for k in range(1, min(lags, n - 1) + 1)]
    groups = [np.abs(g - np.median(g)) for g in np.array_split(r, 2)]
    within = sum(((g - g.mean()) ** 2).sum() for g in groups) / max(1, n - 2)
    between = sum(len(g) * (g.mean() - np.concatenate(groups).mean()) ** 2 for g in groups)
    out = {"shapiro_wilk": shapiro_wilk(r)[1]} | ({"dagostino": dagostino(skew, kurt, n)} if n >= 8 else {})
    return out | {"jarque_bera": _chi2_tail(n / 6 * (skew**2 + (kurt - 3) ** 2 / 4), 2), "levene": f_tail(float(between / max(within, 1e-300)), 1, max(1, n - 2)), "ljung_box": _chi2_tail(n * (n + 2) * sum(a * a / (n - k) for k, a in enumerate(auto, 1)), len(auto))}


def resamples(df: DataFrame, column: str, n_boot: int = 100, sample_size: int = 500, keys: Sequence[str] | None = None) -> DataFrame:
    """(sample, keys, r): for each of n_boot samples the sample_size rows of the least MD5 of the sample's number and the keys.

    keys: columns that tell rows apart; gid if there is one, else all columns.  Of rows with equal keys those of the least r
    count first, so the samples depend on the rows alone and not on their partitions.  Rows without a value don't count; a
    table of fewer rows is each sample.  Only rows near the front of a sample's order leave their task.
    """
    keys = list(keys or (["gid"] if "gid" in df.columns else df.columns))
    given = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("r"))
    n = given.count()
    size = min(n, sample_size)
    named = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    number = lambda i: F.conv(F.substring(F.md5(F.concat_ws("|", i.cast("string"), named)), 1, 13), 16, 10).cast("long")
    share = min(1.0, (size + 10 * math.sqrt(size) + 50) / max(n, 1))
    while True:
        edge = 1 << 52 if share >= 1 else int(share * (1 << 52))
        order = F.filter(F.transform(F.sequence(F.lit(0), F.lit(n_boot - 1)), lambda i: F.struct(i.alias("sample"), number(i).alias("h"))), lambda s: s["h"] < edge)  # noqa: B023
        close = given.select(*keys, "r", F.explode(order).alias("s")).select("s.*", *keys, "r")
        ranked = close.withColumn("_n", F.row_number().over(Window.partitionBy("sample").orderBy("h", "r"))).where(F.col("_n") <= size)
        drawn = store(ranked.select("sample", *keys, "r"), "samples")
        if share >= 1 or not size or drawn.count() == size * n_boot:
            return drawn
        share = min(1.0, 2 * share)


def bootstrap_residuals(df: DataFrame, column: str, n_boot: int = 100, sample_size: int = 500, alpha: float = 0.05, keys: Sequence[str] | None = None) -> DataFrame:
    """(test, mean_p, median_p, rejected) over n_boot resamples() of exactly sample_size rows, each in the order of its keys.

    Each sample is tested in a task of its own.  Values without any spread pass all tests with 1; samples of less than four
    rows have no tests.
    """
    keys = list(keys or (["gid"] if "gid" in df.columns else df.columns))

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        found = residual_statistics(pdf.sort_values([*keys, "r"], kind="stable")["r"].to_numpy()) if len(pdf) > 3 else {}
        return pd.DataFrame({"test": list(found), "p": list(found.values())})

    tests = resamples(df, column, n_boot, sample_size, keys).groupBy("sample").applyInPandas(test, "test string, p double")
    return tests.groupBy("test").agg(F.avg("p").alias("mean_p"), F.median("p").alias("median_p"), F.avg((F.col("p") < alpha).cast("double")).alias("rejected"))


def extrapolate(df: DataFrame, column: str, z: float | None = None, tolerance: float = 0.01, test_size: float = 0.8, seed: int = 0) -> DataFrame:
    """`df` with value_extrapolated: known values as they are, missing ones from a model of the rest.

    The model learns from all training cells.  With `z` (0 too) only that level is used and filled, from the nearest
    predicted cell; else rows take the prediction at their rounded coordinates.  ValueError without training cells.
    """
    given = df if z is None else prepare_slice(df.withColumn("value", F.col(column)), "value", z, tolerance)
    tidy = grid_from_tidy(given.withColumn("value", F.col(column) if z is None else F.col("value")))
    known = split(tidy.where("value is not null"), test_size, seed)
    train = known.where("not test").select("x", "y", "value")
    row = train.agg(*(f(c).alias(f"{n}_{c}") for c in ("x", "y", "value") for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if row.m_value is None:
        raise ValueError("no rows to learn from")
    scale = {c: (float(row[f"m_{c}"]), float(row[f"s_{c}"] or 1.0)) for c in ("x", "y", "value")}
    model = fit_rows(train.select(*(((F.col(c) - m) / s).alias(c) for c, (m, s) in scale.items())))
    cells = tidy.select("ix", "iy", *(((F.col(c) - scale[c][0]) / scale[c][1]).alias(c) for c in ("x", "y")))
    filled = predict(cells, model, scale["value"]).select("ix", "iy", "prediction").join(tidy, ["ix", "iy"]).select("ix", "iy", "x", "y", F.coalesce("value", "prediction").alias("v"))
    if z is not None:
        out = backfill_nearest(df.withColumn("value_extrapolated", F.col(column)), filled, "value_extrapolated", z, tolerance)
        return out
    return join_predictions(df, filled.withColumnRenamed("v", "prediction"))
