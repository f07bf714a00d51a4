"""Combination: hand-computed values, modes and errors."""

import math

import pytest
from favora.operators import combine
from favora.operators.combine import Layer, Weights


def rows(spark, values):
    return spark.createDataFrame(values, "x double, y double, ord int, w double, v double")


def test_prior_logit():
    assert combine.prior_logit(0.5) == 0
    assert combine.prior_logit(0) == -math.inf
    with pytest.raises(ZeroDivisionError):
        combine.prior_logit(1)


def test_voter_values(spark):
    df = rows(spark, [(float(i), 0.0, 0, 0.1, v) for i, v in enumerate((1.0, 2.0, 10.0, 20.0))])
    got = [round(r.pr, 8) for r in combine.voter(df, ["x", "y"], 0.0).orderBy("x").collect()]
    assert got == [0.52497919, 0.549834, 0.73105858, 0.88079708]


def test_veto_keeps_missing(spark):
    a, b = (0.0, 0.2, 1.0, 0.8), (0.4, 0.5, 0.5, None)
    df = rows(spark, [(float(i), 0.0, o, 1.0, v) for o, s in enumerate((a, b)) for i, v in enumerate(s)])
    assert [r.pr for r in combine.veto(df, ["x", "y"]).orderBy("x").collect()] == [0.0, 0.1, 0.5, None]


@pytest.mark.parametrize(("strict", "expected"), [(False, True), (True, False)])
def test_later_items_refill_a_vetoed_sum(spark, strict, expected):
    df = rows(spark, [(0.0, 0.0, 0, 0.5, 0.0), (0.0, 0.0, 1, 0.5, 1.0), (1.0, 0.0, 0, 0.5, 1.0), (1.0, 0.0, 1, 0.5, 1.0)])
    got = {r.x: r.pr for r in combine.modified_veto(df, ["x", "y"], strict=strict).collect()}
    assert (got[0.0] > 0) is expected
    assert got[1.0] == 1.0


def test_prepare_modes(spark):
    df = rows(spark, [(0.0, 0.0, 0, 1.0, None), (0.0, 0.0, 1, 1.0, 2.0), (1.0, 0.0, 0, 1.0, 3.0), (1.0, 0.0, 1, 1.0, None), (2.0, 0.0, 0, 1.0, None), (2.0, 0.0, 1, 1.0, None)])
    shared = {(r.x, r.ord): (r.v, r.masked) for r in combine.prepare(df, ["ord"], ["x", "y"]).collect()}
    assert shared[0.0, 0] == (3.0, False)
    assert shared[2.0, 0] == (None, True)
    assert sum(r.masked for r in combine.prepare(df, ["ord"], ["x", "y"], "propagate_any").collect()) == 6
    with pytest.raises(ValueError, match="nan_mode"):
        combine.prepare(df, ["ord"], ["x", "y"], "other")


def test_dimensions(spark):
    flat = spark.createDataFrame([(0.0, 0.0)], "x double, y double")
    deep = spark.createDataFrame([(0.0, 0.0, 1.0)], "x double, y double, z double")
    mixed = spark.createDataFrame([(0.0, 0.0, 1.0), (0.0, 0.0, None)], "x double, y double, z double")
    assert (combine.dimension(flat), combine.dimension(deep)) == (2, 3)
    for bad in (mixed, deep.limit(0)):
        with pytest.raises(ValueError, match="geometr"):
            combine.dimension(bad)
    with pytest.raises(ValueError, match="mix"):
        combine.project_dimension([flat, deep])


def test_shared_hole_stays_a_hole_and_shapes_must_match(spark):
    values = [(float(x), float(y), None if x == y == 0 else float(x + 2 * y)) for x in range(2) for y in range(2)]
    layer = spark.createDataFrame(values, "x double, y double, value double")
    weights = Weights({("c", "k"): (1.0, 0.5)}, {"c": 1.0})
    out = combine.do_voter_veto([Layer("c", "k", "a", layer, weight=0.5), Layer("c", "k", "b", layer, weight=0.5)], weights).final.collect()
    assert sum(r.pr is None for r in out) == 1
    wide = spark.createDataFrame([(float(x), float(y), 1.0) for x in range(3) for y in range(2)], "x double, y double, value double")
    with pytest.raises(ValueError, match="shape mismatch"):
        combine.do_voter_veto([Layer("c", "k", "a", layer), Layer("c", "k", "b", wide)], weights)
    moved = layer.withColumn("x", layer["x"] + 0.5)
    both = [Layer("c", "k", "a", layer, weight=0.5), Layer("c", "k", "b", moved, weight=0.5)]
    assert combine.do_voter_veto(both, weights).final.count() == 4
    with pytest.raises(ValueError, match="coordinates differ"):
        combine.do_voter_veto(both, weights, check_coords=True)
