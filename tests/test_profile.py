import math

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F
from skysift.operators import profile


@pytest.fixture(scope="module")
def table(spark):
    data = [(1, 1.0, "a", True), (2, None, "a", None), (3, 3.0, None, False), (3, 3.0, None, False), (4, 50.0, "b", True)]
    return spark.createDataFrame(data, "i int, d double, s string, b boolean")


def test_column_kinds(table):
    assert profile.numeric_columns(table) == ["i", "d"]
    # Null is one of the values: s has 3, b has 3.
    assert profile.categorical_columns(table, 3) == ["s", "b"]
    assert profile.categorical_columns(table, 2) == []


def test_missing(table):
    assert rows(profile.schema_and_missing(table)) == [
        ("b", "boolean", 1, 0.2), ("d", "double", 1, 0.2), ("i", "int", 0, 0.0), ("s", "string", 2, 0.4),
    ]
    assert {r["null_pct"] for r in profile.schema_and_missing(table.limit(0)).collect()} == {0.0}


def test_distributions(table):
    r = {x["column"]: x for x in profile.numeric_distributions(table).collect()}
    values = pd.Series([1.0, 3.0, 3.0, 50.0])
    assert r["d"]["count"] == 4 and math.isclose(r["d"]["std"], values.std()) and r["d"]["q75"] == values.quantile(0.75)
    assert (r["d"]["q00"], r["d"]["q100"]) == (1.0, 50.0)
    empty = {x["column"]: x for x in profile.numeric_distributions(table.limit(0)).collect()}
    assert empty["d"]["count"] == 0 and empty["d"]["mean"] is None and empty["d"]["q50"] is None


def test_outliers(table):
    r = {x["column"]: x for x in profile.outliers_iqr(table).collect()}
    assert (r["d"]["outliers"], r["d"]["outlier_pct"]) == (1, 0.2)
    nothing = table.withColumn("d", F.lit(None).cast("double"))
    r = {x["column"]: x for x in profile.outliers_iqr(nothing).collect()}
    assert (r["d"]["lower"], r["d"]["upper"], r["d"]["outliers"], r["d"]["outlier_pct"]) == (None, None, 0, 0.0)


def test_duplicates(table):
    assert rows(profile.duplicates_summary(table)) == [(5, 1, 2)]
    assert rows(profile.duplicated_rows(table)) == [(3, 3.0, None, False, 2)]
    assert rows(profile.duplicates_summary(table.limit(0))) == [(0, 0, 0)]


def test_imbalance_and_counts(table):
    assert rows(profile.class_imbalance(table, ["s", "b"])) == [("b", "false", 2, 0.4), ("s", None, 2, 0.4)]
    assert dict(rows(profile.value_counts(table, "s").select("value", "count"))) == {"a": 2, "b": 1, None: 2}
    assert [r["value"] for r in profile.top_values(table, "s", 2).collect()] == ["a", None]


def test_correlations_equal_pandas(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2_000, 6))
    x[:, 1] = x[:, 0] * 3 + 1e6
    x[:, 2] += x[:, 0]
    x[:, 5] = 0.1
    x[rng.random(x.shape) < 0.2] = np.nan
    pdf = pd.DataFrame(x, columns=list("abcdef"))
    df = spark.createDataFrame(pdf).repartition(5)
    want = pdf.corr()
    got = profile.correlations(df).collect()
    assert len(got) == 15
    for r in got:
        expected = want.loc[r["var1"], r["var2"]]
        assert (r["corr"] is None) == bool(np.isnan(expected)), r
        if r["corr"] is not None:
            assert math.isclose(r["corr"], expected, rel_tol=1e-9, abs_tol=1e-9)
    high = profile.high_correlation_pairs(profile.correlations(df), 0.9).collect()
    assert [(r["var1"], r["var2"]) for r in high] == [("a", "b")]


def test_correlation_constant_over_shared_rows(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, None), (None, 9.0)], "a double, b double")
    assert [r["corr"] for r in profile.correlations(df).collect()] == [None]


def test_histogram(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)] + [(None,)], "x double")
    bins = profile.histogram(df, "x", 50).orderBy("bin").collect()
    counts, edges = np.histogram(np.arange(101.0), 50)
    assert [b["count"] for b in bins] == counts.tolist() and [b["low"] for b in bins] == edges[:-1].tolist()
    same = profile.histogram(spark.createDataFrame([(3.0,), (3.0,)], "x double"), "x", 4).orderBy("bin").collect()
    assert [b["count"] for b in same] == np.histogram([3.0, 3.0], 4)[0].tolist()
    assert profile.histogram(df.filter("x < 0"), "x").count() == 0


def test_variance_ranking_and_explore(table):
    assert [r["column"] for r in profile.variance_ranking(table, k=1).collect()] == ["d"]
    r = {x["column"]: x for x in profile.explore_statistics(table).collect()}
    assert set(r) == {"i", "d"} and r["d"]["null_count"] == 1 and r["i"]["mean"] == 2.6
    assert [x["column"] for x in profile.ranked(profile.outliers_iqr(table), "outlier_pct", 1).collect()] == ["d"]


def test_correlations_of_far_clusters_and_infinities(spark):
    """A pair known only far away from the other rows keeps its digits; an infinity gives no number."""
    rng = np.random.default_rng(2)
    near = [(float(x), None, None) for x in rng.normal(size=500)]
    far = [(1e9 + float(x), 2 * float(x) + 1e-3 * float(y), None) for x, y in rng.normal(size=(500, 2))]
    df = spark.createDataFrame([*near, *far, (1.0, None, float("inf")), (2.0, None, 5.0)], "a double, b double, c double")
    found = {(r["var1"], r["var2"]): r["corr"] for r in profile.correlations(df.repartition(4)).collect()}
    assert found["a", "b"] > 0.99 and found["a", "c"] is None and found["b", "c"] is None
    assert profile.correlations(df.limit(0)).where("corr is not null").count() == 0


def test_scans_do_not_grow_with_the_columns(spark, tmp_path):
    """A profile of forty columns reads its table as often as one of four."""
    from skysift.plans import jobs


    counts = {}
    for width in (4, 40):
        path = str(tmp_path / f"w{width}")
        spark.range(300).select(*[(F.rand(i) * 100).alias(f"x{i}") for i in range(width)]).write.parquet(path)
        df = spark.read.parquet(path)
        tracker, group = spark.sparkContext.statusTracker(), f"profile-{width}"
        spark.sparkContext.setJobGroup(group, group)
        tables = jobs.profile_tables(df, staged=False)
        for name in tables:
            tables[name].collect()
        counts[width] = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[40] <= counts[4] + 4


def test_nan_is_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0,), (nan,), (3.0,), (None,)], "x double")
    r = profile.numeric_distributions(df).first()
    assert (r["count"], r["mean"], r["min"], r["max"], r["q50"]) == (2, 2.0, 1.0, 3.0, 2.0)
    assert profile.schema_and_missing(df).first()["null_count"] == 2
    assert profile.outliers_iqr(df).first()["outliers"] == 0
    assert sum(r["count"] for r in profile.histogram(df, "x", 4).collect()) == 2


def test_duplicates_of_odd_columns(spark):
    df = spark.createDataFrame(
        [(1, {"a": 1, "b": 2}, [1]), (1, {"b": 2, "a": 1}, [1]), (1, {"a": 1}, None), (2, None, [1])], "k int, m map<string,int>, l array<int>"
    )
    assert rows(profile.duplicates_summary(df)) == [(4, 1, 2)]
    assert [(r["k"], r["m"], r["multiplicity"]) for r in profile.duplicated_rows(df).collect()] == [(1, {"a": 1, "b": 2}, 2)]
    with pytest.raises(ValueError):
        profile.duplicated_rows(df, 5)


def test_top_values_of_several_columns(table):
    got = rows(profile.top_values_of(table, ["s", "b"], 1))
    assert got == [("b", "false", 2), ("s", "a", 2)]


def test_duplicates_by_typed_hashes(spark):
    """Nulls in other places, NaN, signed zeros, nested values and many columns."""
    schema = "a long, b long, x double, s string, l array<double>, m map<string,int>"
    nan, base = float("nan"), (1, None, 0.0, "t", [0.0], {"k": 1, "l": 2})
    data = [base, (None, 1, 0.0, "t", [0.0], {"k": 1, "l": 2}), (1, None, -0.0, "t", [-0.0], {"l": 2, "k": 1}),
            (1, None, nan, "t", [nan], None), (1, None, nan, "t", [nan], None), (None,) * 6, (None,) * 6, (None,) * 6]
    df = spark.createDataFrame(data, schema)
    assert rows(profile.duplicates_summary(df)) == [(8, 4, 7)]
    assert sorted(r["multiplicity"] for r in profile.duplicated_rows(df).collect()) == [2, 2, 3]
    wide = spark.range(200).select(*[F.when(F.col("id") % 100 != i, F.lit(1)).alias(f"c{i}") for i in range(100)])
    assert rows(profile.duplicates_summary(wide)) == [(200, 100, 200)]
    plan = profile.duplicates_summary(df)._jdf.queryExecution().executedPlan().toString()
    assert "md5" not in plan and "SortAggregate" not in plan
