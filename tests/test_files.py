"""Light-curve files, incremental ingest, scripts, registries, sinks and whole jobs on files."""

import json
import os
import struct

import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F
from skysift.operators import lightcurves, registry, relational, results, targets
from skysift.plans import jobs
from skysift.sources import catalog, downloads, fits, sinks
from skysift.session import BATCH_KEY
from skysift.sources import registry as registries
from skysift.streaming import ingest

CURVE = "TIME double, FLUX float, QUALITY int"


def block(cards, data=b""):
    text = "".join(c.ljust(80) for c in [*cards, "END"])
    padded = text.encode().ljust(-(-len(text) // 2880) * 2880)
    return padded + data.ljust(-(-len(data) // 2880) * 2880, b"\0")


def card(key, value, comment=""):
    return f"{key:<8}= {value}" + (f" / {comment}" if comment else "")


PRIMARY = block([card("SIMPLE", "T"), card("BITPIX", 8), card("NAXIS", 0), card("OBJECT", "'it''s a star'", "its name")])


def table_file(columns, rows_bytes, n, extra=()):
    width = len(rows_bytes) // n if n else 0
    cards = [card("XTENSION", "'BINTABLE'"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", width), card("NAXIS2", n)]
    cards += [card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", len(columns))]
    for i, (name, form) in enumerate(columns, 1):
        cards += [card(f"TTYPE{i}", f"'{name}'"), card(f"TFORM{i}", f"'{form}'")]
    return PRIMARY + block([*cards, *extra], rows_bytes)


def curve_file(points):
    data = b"".join(struct.pack(">dfi", *p) for p in points)
    return table_file([("TIME", "D"), ("FLUX", "E"), ("QUALITY", "J")], data, len(points))


def name(tic, sector=38):
    return f"tess2021-s{sector:04d}-{tic:016d}-0209-s_lc.fits"


@pytest.fixture()
def curve_folder(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / name(358)).write_bytes(curve_file([(1.0, 0.5, 0), (2.0, float("nan"), 8)]))
    (folder / name(900, 39)).write_bytes(curve_file([(3.0, 1.5, 1)]))
    (folder / name(901)).write_bytes(curve_file([(3.0, 1.5, 1)])[:-2880])
    (folder / "tess-none.fits").write_bytes(curve_file([(4.0, 2.5, 1)]))
    (folder / "notes.txt").write_text("no curve")
    return str(folder)


WANT = [(1.0, 0.5, 0, 358, 38), (2.0, None, 8, 358, 38), (3.0, 1.5, 1, 900, 39)]


def test_curves_and_status(spark, curve_folder):
    files = fits.read_files(spark, f"{curve_folder}/*.fits")
    df = fits.read_light_curves(files, CURVE)
    assert df.columns[-2:] == ["TIC", "SECTOR"] and rows(df) == WANT
    status = {r["filename"]: r for r in fits.light_curve_status(files, CURVE).collect()}
    assert status[name(358)]["rows"] == 2 and status[name(358)]["status"] == "success"
    assert "truncated" in status[name(901)]["error"] and status["tess-none.fits"]["error"].startswith("no target id")
    summary = {r["status"]: (r["files"], r["size"]) for r in lightcurves.status_summary(fits.light_curve_status(files), "rows").collect()}
    assert summary == {"success": (2, 3), "failed": (2, 0)}
    curves = lightcurves.lightcurve_summary(df).first()
    assert (curves["total_rows"], curves["targets"], curves["tic_min"], curves["sector_list"]) == (3, 2, 358, [38, 39])


def test_wrong_or_absent_columns(spark, curve_folder):
    files = fits.read_files(spark, f"{curve_folder}/{name(900, 39)}")
    assert rows(fits.read_light_curves(files, "TIME double, OTHER string")) == [(3.0, None, 900, 39)]
    assert fits.read_light_curves(files, "TIME int").count() == 0
    assert "no int" in fits.light_curve_status(files, "TIME int").first()["error"]


def test_scaled_null_text_flag_and_array_columns(spark, tmp_path):
    points = [(1, -1, b"ab", b"T"), (2, 5, b"cdefg", b"F")]
    data = b"".join(struct.pack(">hhB5sc2f2s8s", a, b, 200, s, f, 1.0, 2.0, b"xx", b"complex!") for a, b, s, f in points)
    columns = [("A", "I"), ("B", "I"), ("C", "B"), ("S", "5A"), ("F", "L"), ("V", "2E"), ("BITS", "11X"), ("Z", "C")]
    extra = [card("TSCAL1", "5.0D-1"), card("TZERO1", 10), card("TNULL2", -1)]
    (tmp_path / name(5)).write_bytes(table_file(columns, data, 2, extra))
    df = fits.read_light_curves(
        fits.read_files(spark, str(tmp_path)), "A double, B int, C int, S string, F boolean, V array<float>"
    )
    assert rows(df) == [
        (10.5, None, 200, "ab", True, [1.0, 2.0], 5, 38), (11.0, 5, 200, "cdefg", False, [1.0, 2.0], 5, 38),
    ]
    assert "not read" in fits.light_curve_status(fits.read_files(spark, str(tmp_path)), "Z double").first()["error"]


def test_headers(spark, curve_folder):
    cards = fits.read_headers(fits.read_files(spark, f"{curve_folder}/{name(358)}"))
    found = {(r["hdu"], r["key"]): (r["value"], r["comment"]) for r in cards.collect()}
    assert found[0, "OBJECT"] == ("it's a star", "its name") and found[1, "NAXIS2"] == ("2", "")


def test_curve_files_come_in_batches_of_bounded_bytes(spark):
    for read in (lambda files: fits.read_light_curves(files, CURVE), fits.light_curve_status, lambda files: fits.decode_files(files, CURVE)):
        spark.conf.unset(BATCH_KEY)
        files = spark.range(0, 40, 1, 1).select(
            F.concat(F.lit("tess2021-s0038-"), F.lpad(F.col("id").cast("string"), 16, "0"), F.lit("-0209-s_lc.fits")).alias("filename"),
            F.repeat(F.lit("x"), 2**20).cast("binary").alias("content"),
        )
        read(files).count()
        sizes = files.select("content").mapInArrow(
            lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long"
        )
        assert sizes.agg(F.max("n")).first()[0] <= 6 * 2**20


class Caught:
    """Stands for a table of files: keeps the function that its batches would be given to."""

    def __init__(self, spark):
        self.sparkSession = spark

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_headers_of_many_files_come_together(spark):
    scan = fits.read_headers(Caught(spark))
    content = curve_file([(1.0, 0.5, 0)])
    given = [pa.RecordBatch.from_arrays([pa.array([name(k)]), pa.array([content])], ["filename", "content"]) for k in range(2000)]
    sizes = [b.num_rows for b in scan(iter(given))]
    assert sizes[:-1] == [20_000] * (len(sizes) - 1) and sum(sizes) == 2000 * 18 and list(scan(iter([]))) == []


def test_incremental_ingest(spark, curve_folder, tmp_path):
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")

    def run():
        ingest.ingest_light_curves(spark, curve_folder, out, CURVE, "curves", marks, files_per_batch=2)
        return rows(spark.read.parquet(f"{out}/curves").select("TIME", "FLUX", "QUALITY", "TIC", "SECTOR"))

    assert run() == WANT
    assert run() == WANT
    with open(os.path.join(curve_folder, name(77)), "wb") as f:
        f.write(curve_file([(9.0, 9.0, 9)]))
    assert run() == sorted([*WANT, (9.0, 9.0, 9, 77, 38)], key=str)
    assert spark.read.parquet(f"{out}/status").count() == 5
    status = spark.read.parquet(f"{out}/status").where("status = 'success' and rows > 0")
    curves = spark.read.parquet(f"{out}/curves").groupBy(F.col("TIC").alias("target"), "SECTOR").count()
    assert rows(status.select("tic", "sector", "rows")) == rows(curves)
    assert {d for d in os.listdir(f"{out}/curves") if d.startswith("SECTOR")} == {"SECTOR=38", "SECTOR=39"}
    report = jobs.ingest_report(spark.read.parquet(f"{out}/status"), spark.read.parquet(f"{out}/curves"))
    assert report["curves"].first()["total_rows"] == 4


def lines(*tics, prefix="curl -o x "):
    return "#!/bin/sh\n" + "".join(f"{prefix}https://host.example/get/{name(t)}\n" for t in tics) + "curl no link\n"


@pytest.fixture()
def scripts(tmp_path):
    folder = tmp_path / "sh"
    folder.mkdir()
    (folder / "tess_1_lc.sh").write_text(lines(5, 7, 9))
    (folder / "tess_2_lc.sh").write_text(lines(7, 11))
    (folder / "tess_1_dv.sh").write_text(lines(7, 11, 13, 0))
    return str(folder)


def test_target_intersection(spark, scripts):
    found = jobs.target_intersection(spark, f"{scripts}/*lc.sh", f"{scripts}/*dv.sh")
    assert [r["tic"] for r in found["kept"].collect()] == [7, 11]
    assert {r["tic"]: r["script"] for r in found["lc"].collect()}[7] == "tess_1_lc.sh"
    assert tuple(found["counts"].first()) == (2, 1, 2, 4, 3)


def test_script_stream(spark, scripts, tmp_path):
    for _ in range(2):
        ingest.ingest_scripts(spark, scripts, str(tmp_path / "t"), "scripts", str(tmp_path / "m"))
    assert sorted(r["tic"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [5, 7, 7, 9, 11]


def test_links(spark):
    html = """<a class="x" href="/a?x=1&amp;y=2">1</a><A HREF='/tesscurl_sector_3_lc.sh'>2</A><a href=/plain>3</a>
    <!-- <a href="/hidden">h</a> --><script>"<a href='/s'>"</script><a href="/a?x=1&amp;y=2">again</a><a name="n">no</a>"""
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    found = downloads.page_links(pages).orderBy("position").collect()
    assert [(r["href"], r["position"]) for r in found] == [("/a?x=1&y=2", 0), ("/tesscurl_sector_3_lc.sh", 1), ("/plain", 2)]
    from skysift.functions.fixed_values import DV_SCRIPT_LINK, LC_SCRIPT_LINK

    assert downloads.page_links(pages, pattern=LC_SCRIPT_LINK).count() == 1
    assert downloads.page_links(pages, pattern=DV_SCRIPT_LINK).count() == 0


def test_registries(spark, tmp_path):
    jobs_ = [
        {"analysis_id": "a", "created_at": "2025-10-01T10:00:00.5", "status": "completed", "duration_seconds": 5.0},
        {"analysis_id": "b", "created_at": "2025-10-08T09:00:00", "status": "running", "started_at": "2025-10-08T10:00:00"},
        {"analysis_id": "c", "created_at": "unknown", "status": "failed", "progress": 3},
        {"analysis_id": "d", "created_at": "2025-10-02T12:00:00", "status": "error"},
    ]
    for j in jobs_:
        (tmp_path / f"{j['analysis_id']}_metadata.json").write_text(json.dumps(j, indent=2))
    (tmp_path / "bad_metadata.json").write_text("{ not json")
    (tmp_path / "other.json").write_text("{}")
    df = registries.read_registry(spark, str(tmp_path), registries.JOB_SCHEMA)
    assert [r["analysis_id"] for r in registry.newest_first(df).collect()] == ["c", "b", "d", "a"]
    now = "2025-10-10 10:00:00"
    status = {r["analysis_id"]: (r["duration_seconds"], r["progress"]) for r in registry.job_status(df, now).collect()}
    assert status == {"a": (5.0, 0), "b": (2 * 86_400.0, 0), "c": (0.0, 3), "d": (0.0, 0)}
    # Exactly 7 whole days is not yet old enough.
    assert [r["analysis_id"] for r in registry.cleanup_candidates(df, now).collect()] == ["a"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), float("inf"), "x"), (2, 1.0, float("-inf"), None)], "k int, a double, b double, s string")
    sinks.write_json(df, str(tmp_path / "j"))
    found = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert sorted(found, key=lambda r: r["k"]) == [
        {"k": 1, "a": None, "b": "Infinity", "s": "x"}, {"k": 2, "a": 1.0, "b": "-Infinity", "s": None},
    ]
    sinks.write_parquet(df, str(tmp_path / "p"), partition_by=["k"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2 and (tmp_path / "p" / "k=1").exists()
    sinks.write_csv(df, str(tmp_path / "c"))
    assert catalog.read_table(spark, str(tmp_path / "c")).columns == df.columns


def test_exports(spark, tmp_path):
    table = spark.createDataFrame(
        [(1, "False positive", 0.1), (2, "Confirmed planet", 0.95), (3, "Planetary candidate", 0.6), (4, None, None)],
        "tic_id int, result string, score double",
    )
    sinks.export_scores(table, str(tmp_path / "s"))
    text = [r["value"] for r in spark.read.text(str(tmp_path / "s")).collect()]
    assert [t for t in text if t != "TIC ID,Résultat,Score"] == ["2,Confirmée,0.950", "3,Candidate,0.600", "1,Faux Positif,0.100"]
    vetted = spark.createDataFrame(
        [("n", "PC", 0.94, (1.23456, None), True), ("m", "PC", 0.1, (1.0, 1.0), False)],
        "name string, original_status string, confidence double, characteristics struct<period:double,radius:double>, confirmable boolean",
    )
    sinks.export_confirmed(vetted, str(tmp_path / "v"))
    assert "n,PC,94.0%,1.235,N/A" in [r["value"] for r in spark.read.text(str(tmp_path / "v")).collect()]


def test_results_and_dispositions(spark):
    scores = spark.createDataFrame([(1, 0.2, "u"), (1, 0.95, "v"), (2, 0.5, "w"), (3, None, "x")], "target_id int, score double, uid string")
    official = spark.createDataFrame([(1, "Known planet"), (2, None)], "tic int, disposition string")
    report = jobs.result_report(scores, official, scores.withColumnRenamed("target_id", "tic_id"))
    assert rows(report["results"]) == [
        (1, "Confirmed planet", 0.95, "Known planet"), (2, "False positive", 0.5, "Not officially analyzed yet"),
        (3, None, None, "Not officially analyzed yet"),
    ]
    assert tuple(report["summary"].first())[:4] == (3, 1, 0, 1) and report["confirmed"].count() == 1
    assert tuple(report["catalogue"].first())[:3] == (4, 3, 1)
    assert results.score_column(spark.createDataFrame([("x",)], "Score_text string")) is None
    left = spark.createDataFrame([(1, "FP"), (1, "KP"), (2, None), (4, "odd")], "tic int, disposition string")
    right = spark.createDataFrame([(1, "CP"), (2, "PC"), (3, "FA"), (4, "odder")], "tic int, disposition string")
    assert rows(results.best_disposition(left, right)) == [
        (1, "Known planet"), (2, "Planetary candidate"), (3, "False alarm"), (4, "odd"),
    ]
    assert rows(results.disposition_pairs(left, right)) == [
        (1, "Confirmed planet", 1), (1, "Known planet", 1), (2, "Planetary candidate", 1), (3, "False alarm", 1), (4, "odd", 1),
    ]
    many = results.disposition_pairs(left.unionAll(left), right.unionAll(right))
    assert {r["tic"]: r["pairs"] for r in many.groupBy("tic").sum("pairs").withColumnRenamed("sum(pairs)", "pairs").collect()} == {
        1: 8, 2: 4, 3: 2, 4: 4,
    }


def test_target_shapes(spark):
    text = spark.createDataFrame([(1, "[11, 38]"), (2, "[]")], "tic_id int, sectors string")
    assert rows(targets.prepare_targets(text)) == [(1, "11-11"), (1, "38-38")]
    assert rows(targets.explode_sectors(text, keep_empty=True)) == [(1, "11-11"), (1, "38-38"), (2, None)]
    with pytest.raises(ValueError):
        targets.prepare_targets(text.select("tic_id"))
    seen = spark.createDataFrame([(1, 3), (1, 3), (1, 2), (9, 4)], "tic_id int, sector int")
    assert rows(targets.prepare_targets(text.select("tic_id"), seen)) == [(1, "2-2"), (1, "3-3")]
    assert rows(targets.observed_sectors(seen, text, keep_missing=True)) == [(1, [2, 3]), (2, [])]
    assert rows(targets.observed_sectors(seen, text)) == [(1, [2, 3])]
    with pytest.raises(ValueError, match="sector_run"):
        targets.target_list_summary(seen)
    runs = spark.createDataFrame([(1, "s0001-s0013"), (2, "6-6")], "tic_id int, sector_run string")
    assert rows(targets.distinct_runs(runs)) == [("6-6", 6, 6), ("s0001-s0013", 1, 13)]


def test_exact_sample_and_keep_first(spark):
    df = spark.range(500).withColumn("k", F.col("id") % 5)
    a, b = relational.exact_sample(df, 50, ["id"]), relational.exact_sample(df.repartition(6), 50, ["id"])
    assert rows(a) == rows(b) and a.distinct().count() == 50
    assert relational.exact_sample(df, 1_000, ["id"]).count() == 500
    assert rows(relational.keep_first(df.repartition(3), ["k"], ["id"])) == [(i, i) for i in range(5)]
    assert rows(relational.head(df, 2, ["k", "id"])) == [(0, 0), (5, 0)]


def catalog_text(n=300):
    rows_ = [f"K{i},{('CONFIRMED', 'FALSE POSITIVE')[i % 2]},{i % 2 * 5 + i / 1000},{i}" for i in range(n)]
    return "# header\nkepoi_name,koi_disposition,koi_period,koi_depth\n" + "\n".join(rows_) + "\n"


def test_whole_job_on_a_file(spark, tmp_path):
    (tmp_path / "cat.csv").write_text(catalog_text())
    small = {"n_estimators": 3, "max_depth": 2}
    outcome = jobs.analyze_file(spark, str(tmp_path / "cat.csv"), parameters=small)
    assert outcome["report"].first()["format"] == "kepler"
    assert tuple(outcome["summary"].first()) == (300, 150, 150, 0.5)
    assert outcome["confirmed"].count() == 150 and outcome["rejected"].count() == 100
    tables = jobs.model_report(spark, outcome["model"], outcome["test_outcomes"])
    assert tables["accuracy"].first()["accuracy"] == 1.0 and tables["importance"].first()["feature"] == "koi_period"
    from skysift.operators import learning

    learning.save_model(outcome["model"], str(tmp_path / "models"), spark)
    df = catalog.read_catalog(spark, str(tmp_path / "cat.csv"))
    again = jobs.vet_with_stored_model(spark, df, str(tmp_path / "models"))
    assert tuple(again["summary"].first()) == (300, 150, 150, 0.5)
    predictions = jobs.predict_dataset(outcome["model"], df)
    assert predictions["shown"].count() == 100 and rows(predictions["counts"]) == [("CONFIRMED", 150), ("FALSE POSITIVE", 150)]
    with pytest.raises(ValueError, match="no rows"):
        jobs.vet_with_model(outcome["model"], df.limit(0))
    with pytest.raises(ValueError, match="unknown format"):
        jobs.analyze_catalog(spark.range(1))


def test_explore_and_profile(spark, tmp_path):
    (tmp_path / "cat.csv").write_text(catalog_text(40))
    df = catalog.read_catalog(spark, str(tmp_path / "cat.csv"))
    tables = jobs.explore(df, ["kepoi_name"])
    assert tables["statistics"].count() == 2 and tables["sample"].count() == 40
    assert rows(tables["distribution"]) == [("CONFIRMED", 20), ("FALSE POSITIVE", 20)]
    for dataset in ("one", "two"):
        jobs.write_profile(df, dataset, str(tmp_path / "profile"))
    missing = spark.read.parquet(str(tmp_path / "profile" / "schema_missing"))
    assert missing.count() == 8 and {r["dataset"] for r in missing.select("dataset").distinct().collect()} == {"one", "two"}
    histograms = spark.read.parquet(str(tmp_path / "profile" / "histograms" / "dataset=one"))
    assert histograms.groupBy("column").agg(F.sum("count").alias("n")).filter("n = 40").count() == 2
