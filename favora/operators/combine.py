"""Combination of layers into components, criteria and one favourability map.

Cells are long-form rows; layers, components and criteria carry ordinals, because the veto fold follows their order.
Statistics are grouped sums; no step collects cells.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from favora.functions.stats import exact_quantile, medians_and_mads
from favora.functions.tables import store
from favora.functions.transforms import check_method, minmax, robust, transformed
from favora.operators.grid import ranked

NAN_MODES = ("propagate_shared", "propagate_any")


def dimension(df: DataFrame) -> int:
    """2 or 3, by whether z is given; ValueError for an empty layer or one that mixes both."""
    if "z" not in df.columns:
        if not df.limit(1).count():
            raise ValueError("no geometry to detect a dimension from")
        return 2
    some, every = df.where(F.col("x").isNotNull()).agg(F.bool_or(F.col("z").isNotNull()), F.bool_and(F.col("z").isNotNull())).first()
    if some is None:
        raise ValueError("no geometry to detect a dimension from")
    if some != every:
        raise ValueError("mixed 2D and 3D geometries")
    return 3 if some else 2


def project_dimension(layers: Sequence[DataFrame | None]) -> int:
    """The common dimension of the layers that have rows; ValueError if they differ or there is none."""
    found = {dimension(x) if "z" in x.columns else 2 for x in layers if x is not None and x.limit(1).count()}
    if not found:
        raise ValueError("no layer with geometry")
    if len(found) > 1:
        raise ValueError("layers mix 2D and 3D geometries")
    return found.pop()


def prior_logit(pr0: float) -> float:
    """ln(p / (1 - p)); minus infinity at 0, ZeroDivisionError at 1."""
    return -math.inf if pr0 == 0 else math.log(pr0 / (1 - pr0))


def weighted_sum(items: Column) -> Column:
    """Sum of w * v over ARRAY<STRUCT<ord, w, v>> in the order of ord; missing values count as 0."""
    return F.aggregate(F.array_sort(items), F.lit(0.0), lambda s, x: s + F.coalesce(x["w"] * x["v"], F.lit(0.0)))


def logistic(w0: Column, total: Column) -> Column:
    """1 / (1 + exp(-w0 - total))."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-w0 - total))


def voter(cells: DataFrame, keys: Sequence[str], w0: float) -> DataFrame:
    """(keys, pr) of rows (keys, ord, w, v): logistic of the weighted sum of a cell's layers."""
    return cells.groupBy(*keys).agg(F.collect_list(F.struct("ord", "w", "v")).alias("_i")).select(*keys, logistic(F.lit(w0), weighted_sum(F.col("_i"))).alias("pr"))


def product(items: Column) -> Column:
    """Product of v over ARRAY<STRUCT<ord, w, v>>; NULL if one is missing."""
    return F.aggregate(F.array_sort(items), F.lit(1.0), lambda s, x: s * x["v"])


def veto(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, pr): the product of a cell's items."""
    return cells.groupBy(*keys).agg(F.collect_list(F.struct("ord", "w", "v")).alias("_i")).select(*keys, product(F.col("_i")).alias("pr"))


def _fold(items: Column, vetoing: bool, strict: bool) -> Column:
    total = F.aggregate(F.array_sort(items), F.lit(0.0), lambda s, x: F.when(F.lit(vetoing) & (x["v"] == 0), F.lit(0.0)).otherwise(s + x["w"] * x["v"]))
    return F.when(F.exists(items, lambda x: x["v"] == 0), F.lit(0.0)).otherwise(total) if vetoing and strict else total


def modified_veto(cells: DataFrame, keys: Sequence[str], by: Sequence[str] = (), vetoing: bool = True, strict: bool = False) -> DataFrame:
    """(keys, pr) of rows (keys, ord, w, v): weighted sum in order of ord, scaled to the greatest product.

    With `vetoing` an item of 0 sets the sum to 0 at its place, and later items add to it again; `strict` makes any 0
    final.  The maxima for the scale are taken for each group of `by`, or over all cells.
    """
    return _rescaled(_folded(cells, keys, vetoing, strict), by).select(*keys, "pr")


def _folded(cells: DataFrame, keys: Sequence[str], vetoing: bool, strict: bool = False, *more: Column) -> DataFrame:
    """(keys, _s, _p) and further aggregates: each cell's weighted sum and product."""
    items = cells.groupBy(*keys).agg(F.collect_list(F.struct("ord", "w", "v")).alias("_i"), *more)
    return items.select(*(c for c in items.columns if c != "_i"), _fold(F.col("_i"), vetoing, strict).alias("_s"), product(F.col("_i")).alias("_p"))


def _rescaled(folded: DataFrame, by: Sequence[str]) -> DataFrame:
    """`folded` with pr: sums scaled to the greatest product, of each group of `by` or of all."""
    if by:
        tops = folded.groupBy(*by).agg(F.max("_s").alias("_ms"), F.max("_p").alias("_mp"))
        folded = folded.join(tops, list(by))
        high, most = F.col("_ms"), F.col("_mp")
    else:
        high, most = (F.lit(x).cast("double") for x in folded.agg(F.max("_s"), F.max("_p")).first())
    return folded.withColumn("pr", F.when(high > 0, F.try_divide(F.col("_s"), high) * most).otherwise(F.col("_s")))


def prepare(cells: DataFrame, item: Sequence[str], cell: Sequence[str], mode: str = "propagate_shared") -> DataFrame:
    """`cells` (item, cell, v) with missing values filled by the item's median where another item has data, and `masked`.

    masked: all items are missing (propagate_shared) or any is (propagate_any).  ValueError for another mode.  Rows without a
    full cell key are left out.  A cell's rows, one an item, are brought together once; grouping by `cell` needs no second
    shuffle.
    """
    if mode not in NAN_MODES:
        raise ValueError(f"unknown nan_mode: {mode}")
    names = list(cells.columns)
    med = exact_quantile(cells, "v", 0.5, item).withColumnRenamed("quantile", "_med")
    whole = Window.partitionBy(*cell)
    masked = F.col("_have") == 0 if mode == "propagate_shared" else F.col("_have") < F.col("_all")
    joined = cells.where(functools.reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in cell))).join(med, list(item), "left").withColumns({"_have": F.count("v").over(whole), "_all": F.count("*").over(whole)})
    filled = F.coalesce("v", F.when(F.col("_have") > 0, F.coalesce("_med", F.lit(0.0))))
    return joined.select(*(c for c in names if c != "v"), filled.alias("v"), masked.alias("masked"))


class Layer(NamedTuple):
    """One evidence layer: its place in the hierarchy, its weight, and a model DataFrame (x, y[, z], column)."""

    criteria: str
    component: str
    layer: str
    model: DataFrame
    column: str = "value"
    weight: float = 1.0
    method: str | None = "none"
    #: Of several rows in a cell the last by this column counts; without it, the greatest value.
    order: str | None = None


class Weights(NamedTuple):
    """Weight and prior of each component, and weight of each criterion, in their order."""

    components: dict[tuple[str, str], tuple[float, float]]
    criteria: dict[str, float]


class Favorability(NamedTuple):
    """Results (coordinates, pr, pr_norm) of components, of criteria and of the project."""

    components: DataFrame
    criteria: DataFrame
    final: DataFrame


def _scaled(df: DataFrame, by: Sequence[str], norm_to: float) -> DataFrame:
    """`df` with pr_norm: pr scaled to [0, norm_to] in each group, norm_to everywhere in a constant one."""
    tops = df.groupBy(*by).agg(F.min("pr").alias("_lo"), F.max("pr").alias("_hi")) if by else None
    if tops is not None:
        df, low, high = df.join(tops, list(by)), F.col("_lo"), F.col("_hi")
    else:
        low, high = (F.lit(x).cast("double") for x in df.agg(F.min("pr"), F.max("pr")).first())
    value = F.when(low.isNull() | (low == high), F.lit(float(norm_to))).otherwise(F.try_divide(F.col("pr") - low, high - low) * norm_to)
    return df.withColumn("pr_norm", value).drop("_lo", "_hi")


def do_voter_veto(layers: Sequence[Layer], weights: Weights, normalize_method: str = "minmax", component_veto: bool = False, criteria_veto: bool = True, norm_to: float = 5.0, nan_mode: str = "propagate_shared", check_coords: bool = False) -> Favorability:
    """Layers to components by the voter, components to criteria and criteria to the project by the modified veto.

    Layers are aligned by lattice index; raises ValueError for a layer without rows, and if their lattices differ in
    shape, or with check_coords in coordinates.  Coordinates are those of the last layer.  `pr` is raw and `pr_norm` is
    scaled to norm_to.
    """
    axes = ("x", "y") if project_dimension([x.model for x in layers]) == 2 else ("x", "y", "z")
    cell = [f"i{a}" for a in axes]
    named = [(layer.criteria, layer.component, float(layer.weight), check_method(layer.method)) for layer in layers]
    parts = []
    for at, layer in enumerate(layers):
        value = F.max_by(layer.column, layer.order) if layer.order else F.max(layer.column)
        parts.append(layer.model.groupBy(*axes).agg(value.cast("double").alias("v")).select(F.lit(at).alias("ord"), *axes, "v"))
    given = store(functools.reduce(DataFrame.unionAll, parts), "layers")
    spark = given.sparkSession
    # One row for each layer, whatever the size of its lattice.
    counts = given.groupBy("ord").agg(*(F.count_distinct(a).alias(f"n{a}") for a in axes))
    shapes = {r.ord: shape for r in counts.collect() if all(shape := tuple(r[f"n{a}"] for a in axes))}
    if len(shapes) < len(layers):
        raise ValueError("cannot rasterize an empty layer")
    if len(set(shapes.values())) > 1:
        raise ValueError("Layer grid shape mismatch")
    sizes = shapes[0]
    indexed = given
    for a in axes:
        indexed = indexed.join(ranked(given, a, ["ord"]), ["ord", a])
    indexed = store(indexed, "rasters")
    if check_coords and any(indexed.select(f"i{a}", a).distinct().count() != n for a, n in zip(axes, sizes, strict=True)):
        raise ValueError("Layer coordinates differ")
    table = spark.createDataFrame([(i, *x) for i, x in enumerate(named)], "ord int, criteria string, component string, w double, method string")
    nodes = spark.range(math.prod(sizes)).select(*(F.floor(F.col("id") / math.prod(sizes[:k]) % sizes[k]).cast("long").alias(c) for k, c in enumerate(cell)))
    full = nodes.withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(len(layers) - 1))))
    rows = full.join(indexed.select("ord", *cell, "v"), ["ord", *cell], "left").join(F.broadcast(table), "ord")
    last = indexed.where(F.col("ord") == len(layers) - 1)
    placed_at = [last.select(f"i{a}", a).distinct() for a in axes]
    keys = ["ord"]
    if any(check_method(x.method) in ("hill", "valley") for x in layers):
        rows = rows.join(medians_and_mads(rows, "v", keys), keys, "left")
    else:
        rows = rows.withColumn("med", F.lit(None).cast("double")).withColumn("mad", F.lit(None).cast("double"))
    value = None
    for method in sorted({check_method(x.method) for x in layers}):
        one = transformed(F.col("v"), method, F.col("med"), F.col("mad"))
        value = one if value is None else F.when(F.col("method") == method, one).otherwise(value)
    rows = store(rows.withColumn("v", value).drop("med", "mad", "method"), "transformed")
    # One row for each layer.
    bounds = F.broadcast(rows.groupBy("ord").agg(F.min("v").alias("lo"), F.max("v").alias("hi")))
    if normalize_method == "minmax":
        rows = rows.join(bounds, "ord").withColumn("v", minmax(F.col("v"), F.col("lo"), F.col("hi")))
    elif normalize_method == "mad":
        rows = rows.join(bounds, "ord").join(medians_and_mads(rows, "v", keys), keys, "left").withColumn("v", robust(F.col("v"), F.col("med"), F.col("mad"), F.col("lo"), F.col("hi")))
    else:
        raise ValueError(f"unknown normalisation method: {normalize_method}")

    ready = prepare(rows.select("criteria", "component", "ord", "w", *cell, "v"), ["ord"], ["criteria", "component", *cell], nan_mode)
    order = [(c, k) for c, k in weights.components]
    table = rows.sparkSession.createDataFrame([(c, k, i, float(weights.components[c, k][0]), prior_logit(weights.components[c, k][1])) for i, (c, k) in enumerate(order)], "criteria string, component string, k_ord int, k_w double, w0 double")
    components = ready.groupBy("criteria", "component", *cell).agg(F.collect_list(F.struct("ord", "w", "v")).alias("_i"), F.bool_or("masked").alias("masked"))
    components = components.join(table, ["criteria", "component"]).select("criteria", "component", *cell, F.when(~F.col("masked"), logistic(F.col("w0"), weighted_sum(F.col("_i")))).alias("pr"), "k_ord", "k_w")
    components = store(components, "components")
    ready = prepare(components.select("criteria", F.col("k_ord").alias("ord"), F.col("k_w").alias("w"), *cell, F.col("pr").alias("v")), ["criteria", "ord"], ["criteria", *cell], nan_mode)
    criteria = _masked_veto(ready, ["criteria", *cell], ["criteria"], component_veto)
    table = rows.sparkSession.createDataFrame([(c, i, float(w)) for i, (c, w) in enumerate(weights.criteria.items())], "criteria string, ord int, w double")
    ready = prepare(criteria.join(table, "criteria").select("ord", "w", *cell, F.col("pr").alias("v")), ["ord"], cell, nan_mode)
    final = _masked_veto(ready, cell, [], criteria_veto)

    def placed(df: DataFrame, by: list[str]) -> DataFrame:
        df = _scaled(df, by, norm_to)
        for at, a in zip(placed_at, axes, strict=True):
            df = df.join(at, f"i{a}")
        return df.select(*by, *axes, "pr", "pr_norm")

    return Favorability(placed(components.drop("k_ord", "k_w"), ["criteria", "component"]), placed(criteria, ["criteria"]), placed(final, []))


def _masked_veto(ready: DataFrame, keys: Sequence[str], by: Sequence[str], vetoing: bool) -> DataFrame:
    """(keys, pr): the modified veto, NULL in masked cells.  Folded cells are stored, as their maxima are needed first."""
    folded = store(_folded(ready, keys, vetoing, False, F.bool_or("masked").alias("masked")), "folded")
    return _rescaled(folded, by).select(*keys, F.when(~F.col("masked"), F.col("pr")).alias("pr"))
