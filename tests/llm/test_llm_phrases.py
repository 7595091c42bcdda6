"""Collocations against a plain count, and against their SQL."""

import random
import re
from collections import Counter, defaultdict

import brute
import duckdb
import pytest
from pyspark.sql import functions as F
from skysift.llm import phrases, queries


def plain(rows, longest=3, least=10, held=50, top=2000):
    """Rows (lang, text) to (lang, rank, phrase, a, l, r, n, score)."""
    found, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = brute.lower((text or "").encode()).decode()
        for piece in re.split(r"[.,;:!?\n-\r]", lowered):
            words = [w for w in re.split(r"[ \t]", piece) if w]
            total[lang] += len(words)
            for size in range(1, longest + 1):
                found[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in found.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            longer = [b for o, b in candidates.items() if len(o) > len(p) and any(o[i : i + len(p)] == p for i in range(len(o)))]
            if any(100 * b >= held * a for b in longer):
                continue
            cuts = [(1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def table(spark, rows):
    """Documents with columns whose names the operator uses itself."""
    full = [(i, lang, text, "x", "x", 1) for i, (lang, text) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, lang string, text string, phrase string, w1 string, n long")


def some_rows(seed, n, words="ab cd éf g'h 日本 Ünd"):
    draw = random.Random(seed)
    rows = []
    for _ in range(n):
        parts = [draw.choice(words.split()) + draw.choice(["", "", "", "", ",", ".", "\n", "\t", "  ", "?!", "\x0c"]) for _ in range(draw.randint(0, 40))]
        rows.append((draw.choice(["en", "de", None]), " ".join(parts)))
    return [*rows, ("en", None), (None, ""), ("fr", " \t.\n"), ("fr", "Ab aB"), ("en", "AB CD " * 300), ("en", "AB CD " * 300)]


@pytest.mark.parametrize("seed,longest,least,held,top", [(1, 3, 10, 50, 2000), (2, 4, 3, 80, 15), (3, 2, 5, 50, 7)])
def test_collocations_against_plain_counts(spark, seed, longest, least, held, top):
    rows = some_rows(seed, 80)
    got = phrases.collocations(table(spark, rows), longest, least, held, top)
    assert sorted(map(tuple, got.collect())) == plain(rows, longest, least, held, top)


def test_no_rows_and_no_words(spark):
    assert phrases.collocations(table(spark, [])).collect() == []
    assert phrases.collocations(table(spark, [("en", None), (None, " ,")])).collect() == []


def test_products_beyond_64_bits(spark):
    """Counts of a corpus of terabytes: the exact quotient is 333333, whatever doubles make of it."""
    a, part = 3_000_000_000_001, 5_196_152_422_708
    counted = spark.createDataFrame([("en", 2, "x y", a), ("en", 1, "x", part), ("en", 1, "y", part)], "lang string, size int, phrase string, n long")
    row = phrases.scored(counted).first()
    assert row["score"] == 1_000_000 * a * a // (part * part)


def test_query_against_sql_and_plain(spark, folder):
    got = sorted(map(tuple, queries.QUERIES["op13_phrases"](spark, folder).collect()))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert got == plain([(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()]) and got
    with duckdb.connect() as db:
        db.sql(f"create view documents as select * from read_parquet('{folder}/documents.parquet')")
        assert sorted(db.sql(queries.SQL["op13_phrases"]).fetchall()) == got


def test_windows_are_dealt_once_and_rolled_up_once(spark, folder):
    """Windows meet once, by all words but the last; the sums need one exchange more."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    counted = phrases.counts(docs)
    counted.collect()
    plan = counted._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow") == 1 and plan.count("ReusedExchange") == 1 and plan.count("Expand") == 1
    assert phrases.windows(docs).where("head like ' %' or (head like '% ' and last <> '')").count() == 0


def test_windows_added_up_in_small_parts(spark, monkeypatch):
    """A task that empties its tally often gives the same counts."""
    rows, tally = some_rows(9, 60), phrases._Tally(3)
    found = Counter()
    for k, (lang, text) in enumerate(rows):
        tally.add(lang or "und", text or "")
        if k % 7 == 0 or k + 1 == len(rows):
            for batch in tally.sums():
                for r in batch.to_pylist():
                    found[r["lang"], r["head"], r["last"]] += r["n"]
    got = phrases.windows(table(spark, rows)).groupBy("lang", "head", "last").agg(F.sum("n")).collect()
    assert {tuple(r)[:3]: r[3] for r in got} == found
