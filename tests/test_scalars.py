import math

import pytest
from pyspark.sql import functions as F
from skysift.functions import scalars as S

LC = "tess2021118034608-s0038-0000000000000358-0209-s_lc.fits"
DV = "tess2018206190142-s0001-s0003-0000000000052357-00129_dvr.fits"


def one(spark, column, schema="x string", value=None):
    return spark.createDataFrame([(value,)], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("name, tic, sector", [(LC, 358, 38), (DV, 52357, 1), ("plain.fits", None, None)])
def test_ids_in_names(spark, name, tic, sector):
    assert one(spark, S.tic_from_name(F.col("x")), value=name) == tic
    assert one(spark, S.sector_from_name(F.col("x")), value=name) == sector


def test_urls(spark):
    line = f"curl -o a https://host.example/path/{LC} rest"
    url = f"https://host.example/path/{LC}"
    assert one(spark, S.url_in_line(F.col("x")), value=line) == url
    assert one(spark, S.fits_name_in_url(F.col("x")), value=url) == LC
    assert one(spark, S.fits_name_in_url(F.col("x")), value="https://host.example/a.txt") is None
    assert one(spark, S.base_name(F.col("x")), value="https://host.example/a/b_lc.sh?x=1/2") == "b_lc.sh"


@pytest.mark.parametrize(
    "text, expected",
    [("6-6", (6, 6)), ("1-39", (1, 39)), ("s0001-s0013", (1, 13)), ("none", (None, None)), (None, (None, None))],
)
def test_sector_runs(spark, text, expected):
    assert tuple(one(spark, S.parse_sector_run(F.col("x")), value=text)) == expected


def test_sector_run_text(spark):
    assert one(spark, S.sector_run(F.col("x")), "x int", 6) == "6-6"


@pytest.mark.parametrize(
    "score, result",
    [
        (0.0, "False positive"), (0.5, "False positive"), (0.500001, "Planetary candidate"),
        (0.9, "Planetary candidate"), (0.91, "Confirmed planet"), (None, None),
    ],
)
def test_score_classes(spark, score, result):
    assert one(spark, S.score_class(F.col("x")), "x double", score) == result


@pytest.mark.parametrize(
    "left, right, best",
    [
        ("KP", "CP", "KP"), ("FP", "PC", "PC"), ("PC", "PC", "PC"), (None, "FA", "FA"), ("FA", None, "FA"),
        (None, None, None), ("odd", "FA", "FA"), ("odd", "strange", "odd"), ("odd", None, "odd"),
    ],
)
def test_better_label(spark, left, right, best):
    df = spark.createDataFrame([(left, right)], "l string, r string")
    assert df.select(S.better_label(F.col("l"), F.col("r"))).first()[0] == best


def test_label_names(spark):
    df = spark.createDataFrame([("KP",), ("EB",), ("odd",), (None,)], "x string")
    assert [r[0] for r in df.select(S.label_name(F.col("x"))).collect()] == [
        "Known planet", "Eclipsing Binary", "odd", None,
    ]


@pytest.mark.parametrize(
    "label, confidence, expected",
    [("CONFIRMED", 0.70, False), ("CONFIRMED", 0.7000001, True), ("CP", 0.9, True), ("Confirmed", 0.9, True),
     ("KP", 0.99, False), (None, 0.9, False), ("CP", None, False)],
)
def test_confirmable(spark, label, confidence, expected):
    df = spark.createDataFrame([(label, confidence)], "l string, c double")
    assert df.select(S.is_confirmable(F.col("l"), F.col("c"))).first()[0] is expected


def test_characteristics_skip_null_and_nan(spark):
    df = spark.createDataFrame(
        [(None, math.nan, 3.0, "5.5", 2)], "koi_period double, pl_orbper double, orbital_period double, koi_depth string, pl_rade int"
    )
    found = df.select(S.characteristics(df).alias("c")).first()["c"].asDict()
    assert found == {"period": 3.0, "duration": None, "depth": 5.5, "radius": 2.0}


def test_nan_to_null_everywhere(spark):
    df = spark.createDataFrame(
        [(math.nan, [1.0, math.nan], {"a": math.nan}, (math.nan, "t"), math.inf)],
        "a double, b array<double>, c map<string,double>, d struct<x:double,y:string>, e double",
    )
    row = S.nan_to_null(df).first()
    assert row["a"] is None and row["b"] == [1.0, None] and row["c"] == {"a": None}
    assert row["d"]["x"] is None and row["d"]["y"] == "t" and row["e"] == math.inf


def test_formatted_numbers(spark):
    assert one(spark, S.percent_text(F.col("x")), "x double", 0.8765) in ("87.7%", "87.6%")
    assert one(spark, S.percent_text(F.col("x")), "x double", 0.94) == "94.0%"
    assert one(spark, S.fixed_text(F.col("x"), 3, "N/A"), "x double", 1.23456) == "1.235"
    assert one(spark, S.fixed_text(F.col("x"), 3, "N/A"), "x double", None) == "N/A"
    assert one(spark, S.size_mb(F.col("x")), "x bigint", 1_572_864) == 1.5


@pytest.mark.parametrize("token, number", [("12", 12.0), ("-1.5e3", -1500.0), ("12d", None), ("a1", None), ("", None)])
def test_number_tokens(spark, token, number):
    assert one(spark, S.number_token(F.col("x")), value=token) == number


def test_sampling_key_depends_on_seed_and_value(spark):
    df = spark.range(1000)
    keys = [r[0] for r in df.select(S.sampling_key([F.col("id")], 1)).collect()]
    other = [r[0] for r in df.select(S.sampling_key([F.col("id")], 2)).collect()]
    assert len(set(keys)) == 1000 and set(keys).isdisjoint(other) and 0 <= min(keys) and max(keys) < 2**52
