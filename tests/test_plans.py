"""What the physical plans must and must not contain."""

import __spark_entry__ as entry_points
from skysift.functions import scalars as S

QUERIES = entry_points.queries()
def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, folder):
    text = plan(QUERIES["object_lookup"](spark, folder))
    assert "EqualTo(c_name,Customer#000000042)" in text
    text = plan(QUERIES["results_table"](spark, folder))
    assert "ReadSchema: struct<l_orderkey:bigint,l_discount:double>" in text and "partial_max" in text


def test_profile_reads_its_table_once(spark, folder):
    for name in ("schema_missing", "variance_topk", "explore_stats", "duplicates_summary"):
        assert plan(QUERIES[name](spark, folder)).count("FileScan") == 1


def test_column_added_once_is_not_computed_again(spark):
    from pyspark.sql import functions as F

    df = spark.range(3).withColumn("x", F.col("id").cast("string"))
    kept = S.with_column_once(df, "y", F.regexp_extract("x", r"(\d)", 1)).filter("y <> ''")
    assert plan(kept).count("regexp_extract") == 1
