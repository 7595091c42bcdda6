"""BPE, languages, scores, fingerprints, quality and leaks."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from skysift.llm import bpe, classlm, langid, leaks, multiset, quality

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def content():
    with open(RANKS, "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def known(content):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_digests(spark, content, known, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = brute.table_rows(docs) + brute.odd_rows()
    assert bpe.read_ranks(spark, RANKS) == content
    got = bpe.digests(brute.documents(spark, rows), content, public_tokenizers.PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for d, t in rows:
        ids = known.encode_ordinary(t or "")
        listed = ",".join(map(str, ids)).encode()
        want.append((d, len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got.collect()), key=brute.key) == sorted(want, key=brute.key)
    assert bpe.digests(brute.documents(spark, []), content, public_tokenizers.PATTERN).collect() == []


def test_bpe_pieces_are_those_of_merging(content, known):
    encoder, draw = bpe.encoder(content), random.Random(1)
    assert not encoder.plain
    for _ in range(4000):
        alphabet = draw.choice(["ab", "aeiounrst", "éèàüöß", "日本語", "0123456789", "=-_*"])
        piece = "".join(draw.choice(alphabet) for _ in range(draw.randint(1, 40)))
        assert list(encoder.encode(piece)) == known._encode_single_piece(piece)


def test_bpe_of_a_vocabulary_without_order():
    # "bc" outranks what it is part of, so pieces are merged step by step.
    ranks = {bytes([b]): b + 10 for b in range(256)} | {b"abc": 300, b"bc": 301, b"ab": 5}
    encoder = bpe.Encoder(b"\n".join(base64.b64encode(t) + b" " + str(r).encode() for t, r in ranks.items()))
    own = tiktoken.Encoding("own", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    for piece in ("abcabc", "bcab", "aabbcc", "abc", "xbcx"):
        assert list(encoder.encode(piece)) == own.encode_ordinary(piece)


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out(F.col("doc_id")))
    right, n = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n == sum(zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in docs.select("doc_id").collect()) and right >= 0.97 * n


def test_languages_of_mixed_and_odd_texts(spark):
    english, russian = "the house is in the middle of the street and ", "дом стоит посреди большой улицы и "
    german = "das haus steht in der mitte der strasse und "
    train = [(i, text * 20, lang) for i, (text, lang) in enumerate([(english, "en"), (german, "de"), (russian, "ru")] * 3)]
    train += [(50, None, "en"), (51, english, None), (52, "", "xx")]
    model = langid.learn(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert sorted(model.languages) == ["de", "en", "ru"]
    assert model.scripts[model.languages.index("ru")] & model.scripts[model.languages.index("en")] == 0
    mixed = english * 3 + russian * 3 + german * 4
    (lang, score, spans), *rest = langid.label([mixed, None, "", "12 ++ 3", "дом", english], model)
    assert lang == "de" and 0 < score < 1 and [s["lang"] for s in spans] == ["en", "ru", "de"]
    assert spans[1]["first_word"] == 30 and sum(s["n_words"] for s in spans) == len(mixed.split())
    assert [r[:2] for r in rest] == [("und", 0.0)] * 3 + [("ru", 1.0), ("en", 1.0)]
    rows = brute.odd_rows()
    got = langid.identify(brute.documents(spark, rows), model).collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got} <= {"en", "de", "ru", "und"} and all(0 <= r["score"] <= 1 for r in got)
    nothing = langid.learn(brute.documents(spark, []))
    assert [r["lang_pred"] for r in langid.identify(brute.documents(spark, [(1, "text")]), nothing).collect()] == ["und"]


def test_viterbi_against_all_paths():
    draw = np.random.default_rng(4)
    for _ in range(30):
        counts = draw.integers(0, 5, 4)
        scores = draw.normal(size=(int(counts.sum()), 3))
        got, at = langid.viterbi(scores, counts, 0.7), 0
        for n in counts:
            part = scores[at : at + n]
            value = lambda p: part[np.arange(n), p].sum() - 0.7 * (np.diff(p) != 0).sum()  # noqa: B023, E731
            best = max((value(np.array(p, int)) for p in np.ndindex(*(3,) * int(n))), default=0)
            assert n == 0 or abs(value(got[at : at + n].astype(int)) - best) < 1e-9
            at += n


def test_class_scores(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = brute.table_rows(docs) + [r for r in brute.odd_rows() if r[0] not in (3, None)] + [(None, None), (None, "a text"), (None, "a text")]
    got = classlm.score(brute.documents(spark, rows)).collect()
    out = {d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    counts = Counter()
    for d, t in rows:
        if not out[d]:
            counts.update([*brute.lower((t or "").encode()).split(), b""])
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for d, t in rows:
        tokens = [*brute.lower((t or "").encode()).split(), b""]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens)
        want.append((d, out[d], len(tokens), sum(counts[w] > 0 for w in tokens), total, round(base, 6)))
    assert sorted([(*r[:5], round(r[5], 6)) for r in got], key=brute.key) == sorted(want, key=brute.key)
    held = [r for r in got if r["held_out"] and r["n_tokens"] > 1]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def class_pairs(lines, of, size):
    """How often which class follows which in some lines of words, ends included."""
    pairs = np.zeros((size, size))
    for line in lines:
        kinds = [size - 1, *(of(w) for w in line), size - 1]
        np.add.at(pairs, (kinds[:-1], kinds[1:]), 1)
    return pairs


def test_words_and_endings_of_many_texts_at_once():
    """The words and classes by ending of whole columns are those of one text and one word at a time."""
    draw = random.Random(3)
    texts = ["", " ", "a", " a\x1cb \t\x0b\x0c\r\nC", "Été ÀB!?", "xxxxx).", "|||", "\x1d \x85 \xa0z y"]
    texts += ["".join(draw.choice("abAB.,!| \n\t\x0b\x1féß日") for _ in range(draw.randint(0, 40))) for _ in range(500)]
    for column in (pa.array(texts), pa.array(texts)[7:]):
        words, ends = classlm.split_words(column)
        got = [words[ends[i] : ends[i + 1]].to_pylist() for i in range(len(column))]
        assert got == [[w.decode() for w in classlm.tokens(t)] for t in column.to_pylist()]
        assert classlm.ending_classes(words).tolist() == [classlm.ending_class(w.encode()) for w in words.to_pylist()]
    assert len(classlm.ending_classes(pa.array([], pa.string()))) == 0


def test_class_model_against_plain_counts(spark):
    """Every score from the classes by hand, and every word in the class that gains most, from chunks of any size."""
    draw = np.random.default_rng(8)
    states = {"a": "bcd", "b": "xyz", "x": "aw", "w": "a"}
    texts = []
    for i in range(80):
        state, line = "a", []
        for _ in range(int(draw.integers(0, 25))):
            state = str(draw.choice(list(states[state])))
            state = state if state in states else str(draw.choice(list(states)))
            line += [f"{state}{draw.integers(0, 12)}{draw.choice(['', '', '.'])}"] * int(draw.integers(1, 3))
        texts.append(" ".join([*line, f"Single{i}"]))
    rows = [*enumerate(texts), (None, None), (200, ""), (200, "")]
    docs = brute.documents(spark, rows)
    held = classlm.held_out()
    made = classlm.keep(classlm.chunks(classlm.text_rows(docs).withColumn("held_out", held), 40), "chunks").df
    assert made.count() > 12
    classes, size = 3, 3 + 2 * classlm.ENDINGS + 1
    model = classlm.fit(made, clustered=9, classes=classes)
    assert model.likelihoods == sorted(model.likelihoods) and len(model.likelihoods) >= 3
    known = {r["word"].encode(): (r["n"], r["class"]) for r in model.known.df.collect()}
    lines = [(d, classlm.tokens(t)) for d, t in rows]
    train = [w for d, w in lines if d is None or zlib.crc32(str(d).encode()) % 5 != 1]
    counts = Counter(w for line in train for w in line)
    assert {w: n for w, (n, _) in known.items()} == counts
    assert all((c >= 0) == (counts[w] >= 2) for w, (_, c) in known.items())

    def of(word):
        return known[word][1] if known.get(word, (0, -1))[1] >= 0 else classes + classlm.ending_class(word)

    # Words beyond the clustered ones, each alone against the classes of these.
    cut = sorted(counts.values(), reverse=True)[9]
    seeds = {w for w in counts if counts[w] > cut}
    assert 0 < len(seeds) <= 9

    def first(word):
        return of(word) if word in seeds else classes + classlm.ending_class(word)

    for word in sorted(w for w in counts if w not in seeds and counts[w] >= 2):
        value = [classlm._likelihood(class_pairs(train, lambda w: c if w == word else first(w), size)) for c in range(classes)]  # noqa: B023
        assert value[known[word][1]] > max(value) - 1e-6, word
    pairs = class_pairs(train, of, size)
    follows = (pairs.sum(axis=0) + 0.5) / (pairs.sum(axis=0) + 0.5).sum()
    steps = (pairs + classlm.BACK_OFF * follows) / (pairs.sum(axis=1, keepdims=True) + classlm.BACK_OFF)
    in_class = np.zeros(size)
    kinds = np.zeros(size)
    for w, n in counts.items():
        in_class[of(w)] += n
        kinds[of(w)] += 1
    want = []
    for d, words in lines:
        total, before = 0.0, size - 1
        for w in words:
            total += math.log10(steps[before, of(w)])
            learned = of(w) < classes
            total += math.log10(counts[w] / in_class[of(w)] if learned else (counts[w] + 0.5) / (in_class[of(w)] + 0.5 * (kinds[of(w)] + 1)))
            before = of(w)
        want.append((d, len(words) + 1, sum(of(w) < classes for w in words), round(total + math.log10(steps[before, size - 1]), 6)))
    got = classlm.score(docs, clustered=9, classes=classes).collect()
    assert sorted(((r["doc_id"], r["n_tokens"], r["n_learned"], round(r["score"], 6)) for r in got), key=brute.key) == sorted(want, key=brute.key)


def test_most_tokens_have_learned_classes(spark, folder):
    got = classlm.score(spark.read.parquet(f"{folder}/documents.parquet")).where("not held_out").agg(F.sum("n_learned"), F.sum("n_tokens"), F.count("*")).first()
    # The smallest table: more than a quarter of its words occur once.
    assert got[0] / (got[1] - got[2]) > 0.7


def test_without_training_documents(spark):
    for rows in ([], [(1, "held")]):
        empty = brute.documents(spark, rows)
        got = classlm.score(empty, F.lit(True)).collect()
        assert len(got) == len(rows) and all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in got)


def test_facts_of_chunks_are_packed_without_lists_of_rows(spark):
    """Facts of a chunk's words come back in one row of bytes, across batches, and no task gathers them as objects."""
    draw = random.Random(41)
    rows = [(chunk << 32, at, draw.randrange(2**40)) for chunk in range(5) for at in range(1, 40 * chunk + 2)]
    draw.shuffle(rows)
    found = spark.createDataFrame(rows, "chunk long, at int, both long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        facts = classlm._facts(found)
        got = facts.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "Aggregate" not in facts._jdf.queryExecution().executedPlan().toString()
    assert len(got) == 5
    unpacked = [(r["chunk"], *x) for r in got for x in zip(np.frombuffer(r["at"], "<u4").tolist(), np.frombuffer(r["both"], "<i8").tolist(), strict=True)]
    assert sorted(unpacked) == sorted(rows)
    assert classlm._facts(found.limit(0)).collect() == []
    parts = list(classlm._handed(pa.RecordBatch.from_arrays([pa.array(range(classlm.ROWS * 2 + 1))], ["x"])))
    assert [p.num_rows for p in parts] == [classlm.ROWS, classlm.ROWS, 1]


def test_fingerprints_follow_paragraphs(spark):
    rows = [(1, "first line\nsecond one\nthird"), (2, "third\nfirst line\nsecond one"), (3, "first line\nthird"), (4, "second one")]
    lanes = {r[0]: (r[1], r[2]) for r in multiset.fingerprints(brute.documents(spark, rows)).collect()}
    assert lanes[1] == lanes[2] != lanes[3]
    both = spark.createDataFrame([(lanes[3][0], lanes[4][0], lanes[1][0])], "a array<long>, b array<long>, c array<long>")
    grown = both.select(multiset.combine(F.col("a"), F.col("b"), 32), multiset.combine(F.col("c"), F.col("b"), 32, -1)).first()
    assert grown[0] == lanes[1][0] and grown[1] == lanes[3][0]


def test_edited_rows(spark, folder):
    given = brute.table_rows(spark.read.parquet(f"{folder}/documents.parquet"))
    got = multiset.edited_rows(brute.documents(spark, given)).collect()
    order = sorted(given)
    after = {d: order[(i + 1) % len(order)][1] or "" for i, (d, _) in enumerate(order)}
    want = {}
    for d, t in given:
        k = len(t or "") // 4
        want[d] = (len(t or ""), hashlib.sha256(((t or "")[: len(t or "") - k] + after[d][:k]).encode()).hexdigest())
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in got} == want
    assert np.mean([r["near_edited"] > r["near_next"] for r in got]) > 0.9
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    texts = dict(given)
    by_text = {}
    for r in got:
        assert by_text.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]


def test_edited_rows_of_odd_tables(spark):
    rows = brute.odd_rows()
    got = multiset.edited_rows(brute.documents(spark, rows)).collect()
    assert sorted([r["doc_id"] for r in got], key=str) == sorted([d for d, _ in rows], key=str)
    assert multiset.edited_rows(brute.documents(spark, [])).collect() == []
    (one,) = multiset.edited_rows(brute.documents(spark, [(1, "abcdefgh")])).collect()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and one["near_next"] == 1.0
    plan = multiset.edited_rows(brute.documents(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct"))


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rated = quality.graded(spark.read.parquet(f"{folder}/labels.parquet"))
    model = quality.fit(docs, rated.where("doc_id % 3 <> 0"), grades=3)
    assert (np.diff(model.thresholds) >= 0).all()
    scored = quality.score(docs.select("doc_id", "text"), model).join(rated.where("doc_id % 3 = 0"), "doc_id")
    keep = F.col("tail_probability") >= quality.KEEP_FROM
    share = {r[0]: r[1] for r in scored.groupBy("grade").agg(F.avg(keep.cast("int"))).collect()}
    assert share[2] > 0.95 and share[1] < 0.35 and share[0] < 0.15
    order = [r[1] for r in scored.groupBy("grade").agg(F.avg("expected_grade")).orderBy("grade").collect()]
    assert order == sorted(order)


def test_quality_of_odd_tables(spark):
    rows = brute.odd_rows()
    docs = brute.documents(spark, rows)
    ratings = spark.createDataFrame([(3, 2), (3, 1), (8, 0), (9, None), (None, 1), (99, 2)], "doc_id long, grade int")
    model = quality.fit(docs, ratings, grades=3)
    assert np.array_equal(model.weights, quality.fit(docs, ratings, grades=3).weights)
    got = quality.score(docs, model, "e_", "t_")
    assert got.count() == len(rows) and got.where("e_ is null or t_ is null").count() == 0
    assert quality.select(docs, model).columns == docs.columns
    empty = brute.documents(spark, [])
    nothing = quality.fit(empty, ratings.where("false"), grades=3)
    assert quality.select(empty, nothing).count() == 0 and not nothing.weights.any()
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 1), (3, 1, 0), (4, None, 0), (5, 1, None)], "doc_id long, quality int, toxic int")
    assert [r[1] for r in quality.graded(labels).orderBy("doc_id").collect()] == [0, 1, 2, None, None]


def planted(items, draw, share):
    """Each item with a share of the allowed edits, between words of other items."""
    vocabulary = [w for _, t in items for w in t.split()]
    for i, text in items:
        words = text.split()
        for _ in range(round(share * (len(words) // 5))):
            at, kind = draw.randrange(len(words)), draw.random()
            if kind < 0.34:
                words[at] = f"new{draw.randrange(99)}"
            elif kind < 0.67:
                words.insert(at, draw.choice(vocabulary))
            elif len(words) > 1:
                del words[at]
        yield i, " ".join(draw.choices(vocabulary, k=30) + words + draw.choices(vocabulary, k=30))


def test_leaks_recall(spark, folder):
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    finder, draw = leaks.Finder(items), random.Random(5)
    for share, least in ((0, 1.0), (0.5, 0.97), (1, 0.93)):
        got = [i in {f[0] for f in finder.find(text)} for _ in range(6) for i, text in planted(items, draw, share)]
        assert np.mean(got) >= least


def test_leaks_against_all_alignments(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in leaks.leaks(docs, items).collect()}
    listed = [(i, leaks.word_hashes(t)) for i, t in items.select("item_id", "text").collect()]
    want = {}
    for d, t in brute.table_rows(docs):
        words = leaks.word_hashes(t)
        for i, item in listed:
            if len(words) and len(np.intersect1d(words, item)) * 2 >= len(set(item.tolist())):
                cost = leaks.edits_within(item, words)[0]
                if cost <= len(item) // 5:
                    want[d, i] = cost
    assert found == want and found
    kept = {r[0] for r in leaks.without_leaks(docs, items).select("doc_id").collect()}
    assert kept == {d for d, _ in brute.table_rows(docs)} - {d for d, _ in found}


def test_alignment_against_all_passages():
    draw = random.Random(6)
    for _ in range(200):
        item = [draw.randrange(4) for _ in range(draw.randint(1, 6))]
        region = [draw.randrange(4) for _ in range(draw.randint(1, 9))]
        best = min(brute.edits(item, region[a:b]) for a in range(len(region) + 1) for b in range(a, len(region) + 1))
        cost, end = leaks.edits_within(np.array(item, np.uint64), np.array(region, np.uint64))
        assert cost == best and min(brute.edits(item, region[a:end]) for a in range(end + 1)) == best


def test_leaks_of_odd_tables(spark):
    passage = " ".join(f"item{i}" for i in range(12))
    items = spark.createDataFrame([(1, passage), (1, passage), (2, None), (3, "too short"), (None, passage.upper() + " x")], "item_id long, text string")
    rows = [*brute.odd_rows(), (20, f"before {passage} after"), (20, f"before {passage} after"), (None, passage), (21, passage.replace("item5", "other"))]
    docs = brute.documents(spark, rows)
    got = sorted({(str(r["doc_id"]), str(r["item_id"]), r["edits"]) for r in leaks.leaks(docs, items).collect()})
    assert got == [("20", "1", 0), ("20", "None", 1), ("21", "1", 1), ("21", "None", 2), ("None", "1", 0), ("None", "None", 1)]
    kept = leaks.without_leaks(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 4
    assert leaks.leaks(docs, items.where("false")).count() == 0 and leaks.leaks(brute.documents(spark, []), items).count() == 0
    assert leaks.without_leaks(docs, items.where("false")).count() == len(rows)
