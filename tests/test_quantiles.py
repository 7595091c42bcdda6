import numpy as np
import pytest
from pyspark.sql import functions as F
from skysift.operators import quantiles

FRACTIONS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 0.95, 1.0]


def samples():
    rng = np.random.default_rng(3)
    hot = np.where(rng.random(30_000) < 0.4, 7.0, rng.normal(size=30_000))
    return {
        "normal": rng.normal(size=30_000),
        "hot_value": hot,
        "hot_at_quartile": np.where(rng.random(30_000) < 0.34, 0.0, np.abs(rng.normal(size=30_000))),
        "few_values": rng.integers(0, 5, 30_000).astype(float),
        "constant": np.full(30_000, 2.5),
        "skewed": rng.pareto(0.5, 30_000),
        "sorted": np.arange(30_000, dtype=float),
    }


@pytest.mark.parametrize("name", sorted(samples()))
def test_counting_scans_equal_numpy(spark, name, monkeypatch):
    values = samples()[name]
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(6)
    monkeypatch.setattr(quantiles, "SKETCH_SIZE", 64)
    order = np.sort(values)
    ranks = sorted({int(f * (len(values) - 1)) for f in FRACTIONS})
    found = quantiles.values_at_ranks(df, {"x": (F.col("x"), len(values), ranks)}, final=50)
    assert {r: found["x", r].value for r in ranks} == {r: order[r] for r in ranks}
    for r in ranks:
        assert found["x", r].under == (values < order[r]).sum() and found["x", r].upto == (values <= order[r]).sum()
    got = quantiles.exact_quantiles(df, ["x"], FRACTIONS, final=50)["x"]
    assert np.allclose(got, np.quantile(values, FRACTIONS), rtol=1e-12, atol=1e-12)


def test_small_and_large_gaps_agree_and_nulls_are_ignored(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 != 0, F.rand(5)).alias("a"), F.lit(None).cast("double").alias("b"), "id"
    )
    few = quantiles.exact_quantiles(df, ["a", "b", "id"], FRACTIONS)
    many = quantiles.exact_quantiles(df, ["a", "b", "id"], FRACTIONS, final=10)
    assert few["b"] == many["b"] == [None] * len(FRACTIONS)
    assert np.allclose(few["a"], many["a"]) and np.allclose(few["id"], many["id"])


def test_a_bad_sketch_only_costs_scans(spark, monkeypatch):
    df = spark.range(5_000).select(F.col("id").cast("double").alias("x"))
    calls = []

    def useless(df, gaps):
        calls.append(len(gaps))
        return [[(g.low if g.low is not None else -1.0) + 1500.0] for g in gaps]

    monkeypatch.setattr(quantiles, "_sketch", useless)
    found = quantiles.values_at_ranks(df, {"x": (F.col("x"), 5_000, [4_200])}, final=1_499)
    assert found["x", 4_200] == (4_200.0, 4_200, 4_201) and len(calls) >= 2
    poor = {"x": [-5.0, -4.0]}
    monkeypatch.undo()
    assert quantiles.values_at_ranks(df, {"x": (F.col("x"), 5_000, [7])}, 100, poor)["x", 7].value == 7.0


def test_ranks_outside_are_refused(spark):
    with pytest.raises(ValueError):
        quantiles.values_at_ranks(spark.range(3), {"id": (F.col("id"), 3, [3])})
