"""NaN, repeated rows, hot keys, many kinds, files of different headers, and runs after a crash."""

import os
import shutil

import pytest
from conftest import rows
from skysift import session
from skysift.operators import formats, learning, profile, relational, results
from skysift.sources import catalog
from skysift.sources import registry as registries
from skysift.streaming import ingest
from test_files import CURVE, curve_file, name

NAN = float("nan")


def test_nan_scores_have_no_class(spark):
    scores = spark.createDataFrame([(1, 0.4), (1, NAN), (2, NAN), (3, 0.95)], "target_id int, score double")
    best = results.best_score(scores)
    assert rows(best) == [(1, "False positive", 0.4), (2, None, None), (3, "Confirmed planet", 0.95)]
    assert rows(results.high_scores(scores).select("target_id")) == [(3,)]
    summary = results.catalogue_summary(scores.withColumnRenamed("target_id", "tic_id")).first()
    assert tuple(summary) == (4, 3, 1, pytest.approx(0.675))
    assert results.high_scores(scores.drop("score")).count() == 0


def test_results_have_one_row_a_target(spark):
    scores = spark.createDataFrame([(1, 0.4), (2, 0.95)], "target_id int, score double")
    official = spark.createDataFrame([(1, "FP"), (1, "KP"), (1, None), (1, "odd"), (9, "KP")], "tic int, disposition string")
    table = results.results_table(scores, official)
    assert rows(table.select("tic_id", "official_disposition")) == [(1, "KP"), (2, "Not officially analyzed yet")]


def test_labels_are_reduced_before_they_are_sorted(spark):
    official = spark.range(100).selectExpr("id % 7 as tic", "concat('K', id % 3) as disposition")
    plan = results.best_per_target(official)._jdf.queryExecution().executedPlan().toString()
    # The only ordering aggregate stands above the count per target and label.
    assert plan.index("SortAggregate") < plan.index("HashAggregate") and "partial_count" in plan


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds a third of all rows."""
    return spark.range(30_000).selectExpr("if(id % 3 = 0, 7, id) as key", "id", "id % 5 as label").repartition(8)


def test_a_key_with_a_third_of_the_rows(spark, hot):
    ids = spark.range(100).withColumnRenamed("id", "key").union(spark.createDataFrame([(7,)] * 500, "key long"))
    inside, outside = relational.rows_with_id(hot, ids, "key"), relational.rows_without_id(hot, ids, "key")
    assert inside.count() + outside.count() == 30_000 and inside.where("key = 7").count() == 10_001
    first = relational.keep_first(hot, ["key"], ["id"])
    assert first.count() == hot.select("key").distinct().count() and first.where("key = 7").first()["id"] == 0
    assert profile.duplicates_summary(hot.select("key")).first()["duplicates"] == 30_000 - first.count()
    table = results.results_table(
        hot.selectExpr("key as target_id", "id / 30000 as score"), hot.selectExpr("key as tic", "'KP' as disposition")
    )
    assert table.count() == first.count()


def test_first_rows_with_maps(spark):
    df = spark.createDataFrame([(1, 2, {"b": 1}), (1, 1, {"a": 1, "c": 2}), (2, 1, None)], "k int, o int, m map<string,int>")
    assert sorted((r["k"], r["o"], r["m"]) for r in relational.keep_first(df, ["k"], ["o"]).collect()) == [
        (1, 1, {"a": 1, "c": 2}), (2, 1, None),
    ]


def test_reports_of_many_labels(spark):
    df = spark.range(3_000).selectExpr("cast(id as string) as kepoi_name", "if(id < 1500, concat('L', id), null) as koi_disposition", "id / 2 as x")
    r = formats.catalog_report(df).first()
    assert len(r["label_distribution"]) == 1_501 and r["label_distribution"]["null"] == 1_500 and r["total_rows"] == 3_000
    with pytest.raises(ValueError, match="different values"):
        learning.train(df, "koi_disposition", "kepoi_name")


def test_training_check(spark):
    schema = "orbital_period double, transit_duration double, transit_depth double, planet_radius double, disposition string"
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0, "CONFIRMED")] * 12 + [(1.0, NAN, 1.0, 1.0, None)], schema)
    r = formats.training_check(df).first()
    assert r["usable"] and r["rows"] == 13 and r["columns"] == 5
    assert r["class_distribution"] == {"CONFIRMED": 12, "null": 1} and r["warnings"] == ["null_values: transit_duration: 1"]
    bad = formats.training_check(df.drop("planet_radius").limit(0)).first()
    assert not bad["usable"] and bad["rows"] == 0 and len(bad["errors"]) == 2


def write(folder, **files):
    for file, text in files.items():
        (folder / f"{file}.csv").write_text(text)


def test_files_with_headers_of_their_own(spark, tmp_path):
    write(tmp_path, batch_1="# note\na,b\n1,x\n2,y\n", batch_2="b,a\nz,3\n", batch_3="# only\n\nc,a\nNaN,4\n2.5,5\n")
    found = catalog.read_catalog(spark, str(tmp_path / "batch_*.csv"))
    assert sorted(found.columns) == ["a", "b", "c"]
    assert rows(found.select("a", "b", "c")) == sorted(
        [(1, "x", None), (2, "y", None), (3, "z", None), (4, None, None), (5, None, 2.5)], key=str
    )
    batches = catalog.read_batches(spark, str(tmp_path), "a bigint, c double, d string")
    assert batches.columns == ["a", "c", "d", "batch_file"]
    assert rows(batches.select("a", "c", "d", "batch_file"))[2] == (3, None, None, "batch_2.csv")
    with pytest.raises(ValueError, match="missing"):
        catalog.read_catalog(spark, str(tmp_path / "batch_2.csv"), required=["c"])


def test_scans_turn_nan_into_null(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1, NAN), (2, 1.0)], "k int, x double").write.parquet(path)
    assert rows(catalog.read_columns(spark, path)) == [(1, None), (2, 1.0)]
    write(tmp_path, t="k,x\n1,NaN\n2,1.5\n")
    assert rows(catalog.read_table(spark, str(tmp_path / "t.csv"))) == [(1, None), (2, 1.5)]


def test_types_of_many_columns_take_one_job(spark):
    df = spark.createDataFrame([(*["1"] * 30, *["1.5"] * 30, *["x"] * 30, None)], ", ".join(f"c{i} string" for i in range(91)))
    types = catalog.infer_types(df)
    assert [types[f"c{i}"] for i in (0, 30, 60, 90)] == ["bigint", "double", "string", "string"]


def test_an_empty_registry(spark, tmp_path):
    assert registries.read_registry(spark, str(tmp_path), registries.JOB_SCHEMA).count() == 0


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    source, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    source.mkdir()
    for tic in (5, 6):
        (source / name(tic)).write_bytes(curve_file([(1.0, float(tic), 1), (2.0, float(tic), 0)]))
    (source / name(8)).write_bytes(b"damaged")

    def run():
        ingest.ingest_light_curves(spark, str(source), out, CURVE, "curves", marks)
        return rows(spark.read.parquet(f"{out}/curves")), rows(spark.read.parquet(f"{out}/status").drop("batch"))

    first = run()
    # As after a crash between the two tables: the batch was planned, half written and never committed.
    shutil.rmtree(f"{out}/status")
    for entry in os.listdir(f"{marks}/curves/marks/commits"):
        os.remove(f"{marks}/curves/marks/commits/{entry}")
    assert run() == first and len(first[0]) == 4 and len(first[1]) == 3


def test_staged_tables_can_be_released(spark):
    staged = session.stage(spark.range(3), "test")
    (file,) = {os.path.dirname(f).removeprefix("file://") for f in staged.inputFiles()}
    assert os.path.isdir(file) and session.release(spark) >= 1 and not os.path.exists(file)


def test_a_bounded_fit_is_repeatable(spark):
    df = spark.range(400).selectExpr("cast(id as string) as name", "if(id % 2 = 0, 'a', 'b') as label", "id % 2 + rand(1) / 9 as x", "rand(2) as y")
    options = {"algorithm": "random_forest", "keys": ["name"], "max_labelled": 100, "partitions": 2, "parameters": {"n_estimators": 5}}
    models = [learning.train(df.repartition(n), "label", "name", **options) for n in (1, 6)]
    assert models[0][0].importances == models[1][0].importances
    scored = learning.with_scores(models[0][0], learning.evaluate(models[0][1]))
    assert scored.scores["accuracy"] > 0.95 and scored.training_seconds > 0
    assert sum(map(sum, scored.scores["confusion"])) == scored.n_test
