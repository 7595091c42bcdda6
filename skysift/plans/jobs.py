"""Whole jobs composed of the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..operators import formats, learning, lightcurves, metrics, profile, relational, results, targets, vetting
from ..session import stage
from ..sources import catalog, downloads, sinks

JOB_TEST_SIZE = 0.3
PREDICTIONS_SHOWN = 100
SAMPLE_ROWS = 100


def analyze_catalog(
    df: DataFrame,
    algorithm: str | None = None,
    parameters: Mapping[str, float] | None = None,
    confirmable: Sequence[str] = fv.CONFIRMABLE_LABELS,
    candidates: Sequence[str] | None = None,
    test_size: float = JOB_TEST_SIZE,
    seed: int = learning.SEED,
    staged: bool = False,
    max_labelled: int | None = None,
    partitions: int | None = None,
) -> dict[str, object]:
    """Report, train and vet one catalogue.

    Training passes over the table many times. With ``staged`` it is first written to the
    shared folder as Parquet, which suits a catalogue parsed from text or joined from
    others. The vetted table is always written, so that every object is scored once;
    ``session.release`` removes both when they are no longer read.
    """
    clean = catalog.drop_hash_rows(df)
    if staged:
        clean = stage(clean, "catalog")
    report = formats.catalog_report(clean)
    name = formats.detect_format(clean.columns)
    if name is None:
        raise ValueError(report.first()["errors"][0])
    label = formats.label_column(clean, name)
    if label is None:
        raise ValueError(f"no labels to learn from; expected one of {list(fv.FORMATS[name].label_columns)}")
    object_column = fv.FORMATS[name].object_column
    keys = [object_column] if object_column in clean.columns else None
    model, scored_test = learning.train(
        clean, label, object_column, name, algorithm, test_size, seed, parameters, keys,
        max_labelled=max_labelled, partitions=partitions,
    )
    outcomes = stage(learning.evaluate(scored_test), "outcomes")
    model = learning.with_scores(model, outcomes)
    return {
        "report": report,
        "model": model,
        "test_outcomes": outcomes,
        **vet_with_model(model, clean, confirmable, candidates),
    }


def analyze_file(spark: SparkSession, path: str, **options) -> dict[str, object]:
    """:func:`analyze_catalog` on catalogue text."""
    return analyze_catalog(catalog.read_catalog(spark, path), **{"staged": True, **options})


def vet_with_model(
    model: learning.CatalogModel,
    df: DataFrame,
    confirmable: Sequence[str] = fv.CONFIRMABLE_LABELS,
    candidates: Sequence[str] | None = None,
    staged: bool = True,
) -> dict[str, DataFrame]:
    """Vetting tables of a catalogue under a fitted or stored model; scored once, unless ``staged`` is false."""
    if formats.is_empty(df):
        raise ValueError("the table has no rows")
    vetted = vetting.vet(learning.predict(model, df), model.object_column, confirmable, candidates=candidates)
    if staged:
        vetted = stage(vetted, "vetted")
    return {
        "vetted": vetted,
        "confirmed": vetting.confirmed(vetted),
        "rejected": vetting.rejected(vetted),
        "summary": vetting.vetting_summary(vetted),
    }


def vet_with_stored_model(
    spark: SparkSession, df: DataFrame, models: str, format_name: str | None = None, **options
) -> dict[str, DataFrame]:
    """Vetting with the stored model of the table's format; options as in :func:`vet_with_model`."""
    name = format_name or formats.detect_format(df.columns)
    return vet_with_model(learning.load_model(models, name, spark), df, **options)


def predict_dataset(model: learning.CatalogModel, df: DataFrame) -> dict[str, DataFrame]:
    """All predictions, the first hundred by name, and the count per class."""
    records = learning.prediction_records(model, learning.predict(model, df))
    return {
        "predictions": records,
        "shown": records.orderBy("planet_name", "confidence").limit(PREDICTIONS_SHOWN),
        "counts": vetting.class_counts(records),
    }


def model_report(spark: SparkSession, model: learning.CatalogModel, outcomes: DataFrame) -> dict[str, DataFrame]:
    """Accuracy, report, confusion matrix and importances of a model."""
    return {
        "accuracy": metrics.accuracy(outcomes),
        "report": metrics.classification_report(outcomes),
        "confusion": metrics.confusion_matrix(outcomes, model.labels),
        "importance": learning.importance_table(spark, model),
    }


def explore(df: DataFrame, order_by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Statistics of the numeric columns, the first rows by ``order_by`` (all columns), and the label distribution."""
    label = formats.label_column(df, formats.detect_format(df.columns))
    distribution = formats.label_distribution(df, label or "").orderBy("value")
    ordered = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    sample = relational.head(df, SAMPLE_ROWS, order_by or ordered)
    return {"statistics": profile.explore_statistics(df), "sample": sample, "distribution": distribution}


def profile_tables(df: DataFrame, staged: bool = True) -> dict[str, DataFrame]:
    """Every profile table of one dataset.

    The table is written to the shared folder first, unless it is Parquet already (``staged=False``). The number
    of scans does not depend on the number of columns.
    """
    if staged:
        df = stage(df, "profile")
    numeric, categories = profile.numeric_columns(df), profile.categorical_columns(df, 20)
    correlation = profile.correlations(df, numeric)
    distributions = profile.numeric_distributions(df, numeric)
    known = distributions.collect()
    bounds = {r["column"]: profile.bounds_of(r["q25"], r["q75"]) for r in known}
    return {
        "schema_missing": profile.schema_and_missing(df),
        "numeric_distributions": distributions,
        "outliers_iqr": profile.outliers_iqr(df, numeric, bounds),
        "duplicates_summary": profile.duplicates_summary(df),
        "duplicates_sample": profile.duplicated_rows(df),
        "class_imbalance": profile.class_imbalance(df, categories),
        "correlations": correlation,
        "high_correlations": profile.high_correlation_pairs(correlation),
        "variance_ranking": profile.variance_ranking(df, numeric),
        "top_values": profile.top_values_of(df, categories),
        "histograms": profile.histograms(df, {r["column"]: (r["min"], r["max"]) for r in known}),
    }


def write_profile(df: DataFrame, dataset: str, folder: str) -> None:
    """Profile tables as Parquet under ``<table>/dataset=<name>``; a dataset replaces only its own part."""
    for table, rows in profile_tables(df).items():
        sinks.write_parquet(rows, f"{folder.rstrip('/')}/{table}/dataset={dataset}", mode="overwrite")


def result_report(scores: DataFrame, dispositions: DataFrame, catalogue: DataFrame | None = None) -> dict[str, DataFrame]:
    """Results of one scoring run: the table, its classes and its summaries."""
    table = results.results_table(scores, dispositions)
    report = {"results": table, "summary": results.results_summary(table), **results.split_by_class(table)}
    if catalogue is not None:
        report["catalogue"] = results.catalogue_summary(catalogue)
    return report


def target_intersection(spark: SparkSession, lc_scripts: str, dv_scripts: str) -> dict[str, DataFrame]:
    """Targets of the light-curve scripts that the validation scripts name too, with the counts."""
    lc = targets.first_per_target(downloads.read_scripts(spark, lc_scripts))
    dv = targets.first_per_target(downloads.read_scripts(spark, dv_scripts))
    kept, counts = targets.intersect_targets(lc, dv)
    return {"lc": lc, "dv": dv, "kept": kept, "counts": counts}


def ingest_report(status: DataFrame, curves: DataFrame) -> dict[str, DataFrame]:
    """Summaries of an ingest run and of the curves it gave."""
    return {"status": lightcurves.status_summary(status, "rows"), "curves": lightcurves.lightcurve_summary(curves)}
