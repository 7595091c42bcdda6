"""Runs of repeated words against a search of every period."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from skysift.llm import periodic, queries


def plain_runs(words, least=6, times=4):
    """(start, length, period) of every run, by trying all periods."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, times * q):
                found.setdefault((start, i + q - start), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_looped(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def plain_row(doc_id, text, change=True):
    words = brute.words(text)
    words = plain_looped(doc_id, words) if change else words
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(((-n, s, q) for s, n, q in runs), default=None)
    first = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *first, hashlib.sha256(listed).hexdigest(), hashlib.sha256(left).hexdigest())


def periodic_words(draw):
    words = []
    for _ in range(draw.randint(1, 6)):
        part = [draw.choice("abc") for _ in range(draw.randint(1, 9))]
        if draw.random() < 0.4:
            part = part * draw.randint(1, 5) + [draw.choice("ab")]
        words += (part * draw.randint(1, 9))[: draw.randint(1, 120)]
    return words


def test_runs_against_all_periods():
    draw = random.Random(1)
    for _ in range(1500):
        words = periodic_words(draw)
        numbers = np.array([ord(w) for w in words])
        assert periodic.find_runs(numbers) == plain_runs(words), words


@pytest.mark.parametrize("least,times", [(1, 4), (20, 4), (6, 6)])
def test_other_limits(least, times):
    draw = random.Random(times + least)
    for _ in range(300):
        words = periodic_words(draw)
        numbers = np.array([ord(w) for w in words])
        assert periodic.find_runs(numbers, least=least, times=times) == plain_runs(words, least, times)


def test_too_few_periods_are_refused():
    with pytest.raises(ValueError):
        periodic.find_runs(np.zeros(9, np.int64), times=3)


def test_words_of_fibonacci_and_of_thue_and_morse():
    a, b = "a", "ab"
    while len(b) < 400:
        a, b = b, b + a
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(512))
    for text in (b, thue, "".join(c * 3 for c in b[:150])):
        assert periodic.find_runs(np.array(list(map(ord, text)))) == plain_runs(text)


def test_a_long_text_of_one_word_and_a_long_period():
    numbers = np.zeros(300_000, np.int64)
    assert periodic.find_runs(numbers) == [(0, 300_000, 1)]
    draw = np.random.default_rng(4)
    part = draw.integers(0, 1000, 50_000)
    words = np.concatenate([[-1], np.tile(part, 5)[:210_000], [-2, -3]])
    assert periodic.find_runs(words) == [(1, 210_000, 50_000)]


def test_names_that_coincide_change_nothing(monkeypatch):
    """With names of two bits every stretch is checked; a false one starts the search anew."""
    mixed = periodic._mixed
    monkeypatch.setattr(periodic, "_mixed", lambda x, seed: mixed(x, seed) & np.uint64(3) if seed < 3 else mixed(x, seed))
    draw = random.Random(6)
    for _ in range(50):
        words = periodic_words(draw)
        assert periodic.find_runs(np.array([ord(w) for w in words])) == plain_runs(words)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=brute.key)


def test_odd_rows_and_none(spark):
    draw = random.Random(2)
    rows = [*brute.odd_rows(), *[(100 + i, " ".join(periodic_words(draw))) for i in range(80)]]
    docs = brute.documents(spark, rows).withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit(2))
    assert rows_of(periodic.digests(docs)) == sorted((plain_row(*r, change=False) for r in rows), key=brute.key)
    assert rows_of(periodic.digests(periodic.looped(docs))) == sorted((plain_row(*r) for r in rows), key=brute.key)
    assert periodic.digests(periodic.looped(brute.documents(spark, []))).collect() == []
    out = periodic.collapse(docs)
    assert out.columns == [c for c in docs.columns if c not in ("text", "runs", "collapsed")] + ["runs", "collapsed"]


def test_query_against_the_plain_version(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = sorted((plain_row(*r) for r in brute.table_rows(docs)), key=brute.key)
    got = queries.QUERIES["op12_periodic_runs"](spark, folder)
    assert rows_of(got) == want and sum(r[1] > 0 for r in want) > 5
