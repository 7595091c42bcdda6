"""Stored models, JSON with odd numbers, registries from text, and ingests that compact."""

import json
import os

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F
from skysift import session
from skysift.operators import learning, profile
from skysift.sources import registry, sinks
from skysift.streaming import ingest, segments
from test_files import CURVE, WANT, curve_file, curve_folder, lines, name  # noqa: F401


@pytest.fixture(scope="module")
def model(spark):
    df = spark.range(200).selectExpr("cast(id as string) as kepoi_name", "if(id % 2 = 0, 'A', 'B') as label", "double(id % 2) as x")
    return learning.train(df, "label", "kepoi_name", "kepler", "random_forest", keys=["kepoi_name"], parameters={"n_estimators": 2, "max_depth": 2}, partitions=1)[0]


def test_models_are_published_whole(spark, model, tmp_path, monkeypatch):
    base = str(tmp_path / "m")
    with pytest.raises(FileNotFoundError):
        learning.load_model(base, "kepler", spark)
    first = learning.save_model(model, base, spark)
    loaded = learning.load_model(base, "kepler", spark)
    assert loaded.description() == model.description() and learning.model_versions(base, "kepler", spark) == [first]

    def crash(*_):
        raise RuntimeError("stopped before the new name")

    with monkeypatch.context() as patched:
        patched.setattr(session, "publish", crash)
        with pytest.raises(RuntimeError):
            learning.save_model(model, base, spark)
    assert learning.model_versions(base, "kepler", spark) == [first] and learning.load_model(base, "kepler", spark).labels == ["A", "B"]
    more = [learning.save_model(model, base, spark, kept=2) for _ in range(2)]
    assert learning.model_versions(base, "kepler", spark) == more
    assert learning.load_model(base, "kepler", spark, more[0]).features == ["x"]
    with pytest.raises(FileNotFoundError):
        learning.load_model(base, "kepler", spark, first)


def test_a_name_is_given_once(spark, tmp_path):
    for place in ("a", "b"):
        (tmp_path / place).mkdir()
    session.publish(spark, str(tmp_path / "a"), str(tmp_path / "new" / "n"))
    with pytest.raises(FileExistsError):
        session.publish(spark, str(tmp_path / "b"), str(tmp_path / "new" / "n"))
    assert session.children(spark, str(tmp_path)) == ["b", "new"] and session.children(spark, str(tmp_path / "none")) == []


ODD = "k int, s struct<a: double, l: array<float>>, m map<string, double>, n array<struct<d: double>>"


def test_json_of_odd_numbers(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    given = [(1, (inf, [nan, -inf, 1.5]), {"x": -inf, "y": nan}, [(nan,), (inf,)]), (2, None, None, []), (3, (nan, None), {}, None)]
    df = spark.createDataFrame(given, ODD)
    sinks.write_json(df, str(tmp_path / "null"))
    text = {json.loads(r["value"])["k"]: r["value"] for r in spark.read.text(str(tmp_path / "null")).collect()}
    assert text[1] == '{"k":1,"s":{"a":"Infinity","l":[null,"-Infinity",1.5]},"m":{"x":"-Infinity","y":null},"n":[{"d":null},{"d":"Infinity"}]}'
    got = {r["k"]: r for r in sinks.read_json(spark, str(tmp_path / "null"), df.schema).collect()}
    assert got[1]["s"] == (inf, [None, -inf, 1.5]) and got[1]["m"] == {"x": -inf, "y": None} and got[1]["n"] == [(None,), (inf,)]
    assert tuple(got[2]) == given[1] and got[3]["s"] == (None, None) and got[3]["m"] == {}
    sinks.write_json(df, str(tmp_path / "text"), nan="text")
    again = sinks.read_json(spark, str(tmp_path / "text"), df.schema)
    assert again.filter("isnan(s.l[0]) and isnan(m['y']) and isnan(n[0].d) and s.a = double('inf')").count() == 1
    with pytest.raises(ValueError):
        sinks.write_json(df, str(tmp_path / "none"), nan="drop")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        sinks.read_json(spark, str(tmp_path / "null"), "k int, s int").collect()


def test_entries_in_texts(spark):
    texts = [('{"id": 1, "n": {"l": [1, 2]}, "else": 0}', None), ('{"id": 2', "unreadable"), ("", "empty"), (" \n", "empty"), (None, "empty"), ("[1]", "not an object"),
             ("null", "not an object"), ('[{"id": 3}]', "not an object"), ('{"id": "x"}', "unreadable"), ("{}", None), (' {"id": null} ', None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "no int, value string")
    found = registry.parse_entries(df, "id bigint, n struct<l: array<int>>").orderBy("no").collect()
    assert [r["problem"] for r in found] == [p for _, p in texts] and found[0].asDict(True) == {"no": 0, "id": 1, "n": {"l": [1, 2]}, "problem": None}
    assert [r["id"] for r in found if r["id"] is not None] == [1]
    assert registry.parse_entries(df.limit(0), "id bigint").collect() == []


def test_documents_of_a_folder(spark, tmp_path):
    assert registry.read_registry(spark, str(tmp_path), "id bigint").collect() == []
    for title, text in {"a": '{\n "id": 5\n}', "b": "{ not json", "c": ""}.items():
        (tmp_path / f"{title}_metadata.json").write_text(text)
    assert rows(registry.read_registry(spark, str(tmp_path), "id bigint")) == [(5,)]
    assert rows(registry.broken_documents(spark, str(tmp_path), "id bigint"))[0] == ("b_metadata.json", "unreadable")


def test_compacted_curves(spark, curve_folder, tmp_path):  # noqa: F811
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")

    def run():
        ingest.ingest_light_curves(spark, curve_folder, out, CURVE, "curves", marks, files_per_batch=1)

    def curves():
        return rows(segments.read(spark, out, "curves").select("TIME", "FLUX", "QUALITY", "TIC", "SECTOR"))

    with pytest.raises(FileNotFoundError):
        segments.read(spark, out, "curves")
    run()
    want = list(WANT)
    assert curves() == want and segments.segments(spark, out) == []
    merged = ingest.compact_light_curves(spark, out)
    assert (merged.first, merged.last) == (0, 3) and curves() == want and ingest.compact_light_curves(spark, out) is None
    for i in range(1, 4):
        # The last batch runs again each time, as if the run had stopped before it was marked as done.
        commits = os.path.join(marks, "curves", "marks", "commits")
        last = max(int(f) for f in os.listdir(commits) if f.isdigit())
        os.remove(os.path.join(commits, str(last)))
        if os.path.exists(os.path.join(commits, f".{last}.crc")):
            os.remove(os.path.join(commits, f".{last}.crc"))
        with open(os.path.join(curve_folder, name(100 + i)), "wb") as f:
            f.write(curve_file([(float(i), 1.0, i)]))
        run()
        want = sorted([*want, (float(i), 1.0, i, 100 + i, 38)], key=str)
        assert curves() == want
        assert ingest.compact_light_curves(spark, out, least=1) is not None
        assert curves() == want and segments.read(spark, out, "status").count() == 4 + i
    found = segments.segments(spark, out)
    assert found[0].first == 0 and found[-1].last == 6 and len(found) <= 3
    # Nothing is left but what the last two manifests need.
    assert len(os.listdir(os.path.join(out, "_segments"))) <= 2 * len(found) + 1
    assert all(b > 4 for b, _ in segments._batch_folders(spark, f"{out}/status"))


def test_scripts_without_targets(spark, tmp_path):
    (tmp_path / "sh").mkdir()
    (tmp_path / "sh" / "a_lc.sh").write_text("#!/bin/sh\n")
    args = (spark, str(tmp_path / "sh"), str(tmp_path / "out"), "s", str(tmp_path / "marks"))
    ingest.ingest_script_batches(*args)
    assert ingest.compact_scripts(spark, str(tmp_path / "out"), least=1).rows == 1
    (tmp_path / "sh" / "b_lc.sh").write_text(lines(5, 7, 7))
    ingest.ingest_script_batches(*args)
    out = str(tmp_path / "out")
    assert rows(segments.read(spark, out, "targets").select("tic")) == [(5,), (7,), (7,)]
    assert rows(segments.read(spark, out, "scripts").select("script", "targets")) == [("a_lc.sh", 0), ("b_lc.sh", 3)]


def test_moments_of_gaps_need_no_loop(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 12)) + np.arange(12) * 1e3
    x[rng.random(x.shape) < 0.3] = np.nan
    monkeypatch.setattr(profile, "_CANCELLED", -1.0)
    whole = profile._moments(x)
    for i, j in ((0, 1), (3, 11), (7, 2)):
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        a, b = x[both, i] - x[both, i].mean(), x[both, j] - x[both, j].mean()
        assert whole["n"][i, j] == both.sum()
        assert np.allclose([whole["cxy"][i, j], whole["cxx"][i, j], whole["cyy"][i, j]], [a @ b, a @ a, b @ b], rtol=1e-10)
        assert np.allclose([whole["mx"][i, j], whole["my"][i, j]], [x[both, i].mean(), x[both, j].mean()], rtol=1e-12)


def test_the_folder_of_a_session_without_one(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), spark.sparkContext

    assert os.path.isdir(session.shared_dir(Session())) and session.shared_dir(Session()) == session.shared_dir(Session())


def test_first_and_later_batches_of_other_columns(spark, tmp_path):
    out = str(tmp_path / "t")
    for batch, part in enumerate((spark.range(3), spark.range(3, 5).withColumn("note", F.lit("x")))):
        segments.replace_batch(part, f"{out}/rows", batch)
        segments.replace_batch(part, f"{out}/rows", batch)
    segments.compact(spark, out, {"rows": []}, least=1)
    got = segments.read(spark, out, "rows")
    assert got.count() == 5 and set(got.columns) >= {"id", "batch"}
