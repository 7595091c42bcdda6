"""Every registered query against its SQL."""

import __spark_entry__ as entry_points
import compare
import pytest

SQL = entry_points.oracle_sql()
QUERIES = entry_points.queries()


@pytest.fixture(scope="module")
def con(folder):
    return compare.connect(folder)


# Queries that decode files or add up wide products in Python, or score with a model.
PYTHON = {"correlation_wide", "correlation_pairs", "correlation_with_gaps", "high_correlation", "profile_job", "lightcurve_decode", "lightcurve_status", "fits_headers", "train_predict"}
# Windows over one row a task and column pair, or one row a distinct value.
WINDOWS = {"correlation_wide", "correlation_pairs", "correlation_with_gaps", "high_correlation", "profile_job"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, folder, con, name):
    df = QUERIES[name](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    unwanted = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", *([] if name in WINDOWS else ["Window"])]
    unwanted += [] if name in PYTHON else ["MapInPandas", "ArrowEvalPython", "FlatMapGroups"]
    assert [node for node in unwanted if node in plan] == []
    assert compare.difference(df, con, SQL[name]) is None


LLM = {name for name in QUERIES if name == "pipeline" or name[:2] == "op" and name[2].isdigit()}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - LLM))
def test_runs_without_sql(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_sql_only_for_known_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == [
        "name", "original_status", "predicted_status", "confidence", "period", "radius", "confirmable",
    ]
    assert df.count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()


def test_the_listing_holds_every_entry(spark, folder):
    listed = [(r["created_at"] or "", r["analysis_id"]) for r in QUERIES["registry_listing"](spark, folder).collect()]
    assert len(listed) == spark.read.parquet(f"{folder}/orders.parquet").count()
    assert [d for d, _ in listed] == sorted((d for d, _ in listed), reverse=True)
