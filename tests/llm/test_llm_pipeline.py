"""The corpus pipeline, and the registration of the queries."""

import hashlib
import sys

import __spark_entry__ as entry_points
import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from skysift.llm import bpe, leaks, quality, queries

QUERIES = queries.QUERIES


def test_pipeline_against_plain_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = quality.graded(spark.read.parquet(f"{folder}/labels.parquet"))
    rows = brute.table_rows(docs)
    model = quality.fit(docs, labels, grades=3)
    tails = model.tails(quality._sums([quality.features(t or "") for _, t in rows], model.weights))[:, -1]
    rows = [r for r, p in zip(rows, tails) if p >= quality.KEEP_FROM]
    rows = [(d, t) for d, t, _ in brute.lines(rows, 2, 10, grows=True)]
    rows = [r for r, (d, _, c) in zip(rows, brute.groups(rows, 4, 4)) if d == c]
    items = [leaks.word_hashes(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]

    def leaked(text):
        words = leaks.word_hashes(text)
        return any(
            len(np.intersect1d(words, item)) * 2 >= len(set(item.tolist())) and leaks.edits_within(item, words)[0] <= len(item) // 5
            for item in items
        )

    rows = [r for r in rows if not leaked(r[1])]
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        encoder = bpe.encoder(file.read())
    import regex

    want = []
    for d, t in rows:
        ids = [i for piece in regex.findall(public_tokenizers.PATTERN, t or "") for i in encoder.encode(piece)]
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want.append((d, len(ids), digest, hashlib.sha256((t or "").encode()).hexdigest()))
    got = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_stages_keep_columns_on_odd_and_empty_tables(spark, folder):
    for rows in (brute.odd_rows(), []):
        docs = brute.documents(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, folder)
            assert got.columns == docs.columns and got.count() <= len(rows)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == len(rows)


def test_stages_and_queries_are_registered():
    assert len(corpus_pipeline.STAGES) == 5
    assert set(QUERIES) | {"pipeline"} <= set(entry_points.queries())
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, folder, name):
    df = QUERIES[name](spark, folder)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry_points_without_the_subpackage(monkeypatch):
    """The other queries stay when the folders are gone."""
    for module in [m for m in sys.modules if m.startswith("skysift.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, module)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    import __spark_entry__ as alone

    assert alone.queries() and not any(name.startswith("op") and name[2:3].isdigit() for name in alone.queries())
