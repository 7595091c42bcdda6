"""Substring dedup, line dedup and SimHash near-dedup against plain versions."""

import hashlib
import os
import random
import time

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from skysift.llm import lines, queries, simhash, substrings
from skysift.llm.common import CLEANUP_KEY, keep
from skysift.llm.components import components


def some_texts(seed, n):
    """Texts over small alphabets, with runs, periods and copied parts."""
    draw = random.Random(seed)
    rows = []
    for d in range(n):
        kind = draw.randint(0, 4)
        if kind == 0:
            text = " ".join(draw.choice("ab") for _ in range(draw.randint(0, 80)))
        elif kind == 1:
            text = " ".join(["z"] * draw.randint(0, 300))
        elif kind == 2:
            text = " ".join("pqr"[i % 3] for i in range(draw.randint(0, 90)))
        elif kind == 3 and rows:
            text = rows[-1][1][: draw.randint(0, 300)] + " x " + draw.choice(rows)[1]
        else:
            text = " ".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(0, 120)))
        rows.append((d, text))
    return rows


def removed(df, window):
    got = substrings.dedup_substrings(df, window).collect()
    return sorted((r[0], r[1], r[2], hashlib.sha256(r[3].encode()).hexdigest()) for r in got)


@pytest.mark.parametrize("window", [2, 5, 20])
def test_substrings_on_small_alphabets(spark, window):
    rows = some_texts(window, 150)
    assert removed(spark.createDataFrame(rows, "doc_id long, text string"), window) == sorted(brute.substrings(rows, window))


def test_substrings_of_odd_rows_and_of_none(spark):
    rows = brute.odd_rows()
    got = substrings.dedup_substrings(brute.documents(spark, rows)).collect()
    got = [(r[0], r[1], r[2], hashlib.sha256(r[3].encode()).hexdigest()) for r in got]
    assert sorted(got, key=brute.key) == sorted(brute.substrings(rows, 20), key=brute.key)
    assert substrings.dedup_substrings(brute.documents(spark, [])).collect() == []


def test_windows_are_made_and_dealt_once(spark, monkeypatch):
    """What is known of a name or of some words, and the rows that meet it, come from one exchange."""
    planned = []
    monkeypatch.setattr(substrings, "keep", lambda df, label: planned.append(df) or keep(df, label))
    text = " ".join(f"w{i % 50}" for i in range(300))
    docs = spark.createDataFrame([(i, text + f" {i}") for i in range(6)], "doc_id long, text string")
    planned.append(substrings.dedup_substrings(docs, 20))
    for df in (planned[0], planned[-1]):
        dealt = df._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1:]
        # Nothing tells the two sides apart before the exchange, so Spark plans it once.
        assert [part.split("\n")[1].strip(" :+-").split()[0] for part in dealt] == ["MapInArrow"] * 2


def test_substrings_of_the_given_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert removed(docs, 20) == sorted(brute.substrings(brute.table_rows(docs), 20))


def test_dependencies_rise_and_decide_symbols():
    draw = np.random.default_rng(2)
    hashes = substrings._mix(draw.integers(0, 6, 4000).astype(np.uint64))
    edge = np.zeros(4000, bool)
    first, last = edge.copy(), edge.copy()
    first[0], last[-1] = True, True
    names, starts, ends, low, high = substrings.symbols(hashes, first, last)
    assert (np.diff(low) >= 0).all() and (np.diff(high) >= 0).all()
    assert (low <= starts).all() and (high >= ends).all()
    # The same symbols arise from the words they depend on alone.
    for k in range(5, len(names) - 5, 37):
        part = hashes[low[k] : high[k]]
        f, z = np.zeros(len(part), bool), np.zeros(len(part), bool)
        f[0], z[-1] = True, True
        again = substrings.symbols(part, f, z)
        at = int(np.flatnonzero(again[1] == starts[k] - low[k])[0]) if starts[k] - low[k] in again[1] else None
        inside = at is not None and again[3][at] >= 0 and again[4][at] <= len(part)
        assert not inside or (again[0][at] == names[k] and again[2][at] == ends[k] - low[k])


def kept_lines(df, **options):
    got = lines.dedup_lines(df, n_removed="n_removed_", **options).select("doc_id", "text", "n_removed_").collect()
    return sorted(map(tuple, got), key=brute.key)


@pytest.mark.parametrize("max_edits,per_edit", [(1, 3), (2, 4), (3, 5)])
def test_lines_against_all_pairs(spark, max_edits, per_edit):
    draw = random.Random(max_edits)
    base = ["".join(draw.choice("abcé") for _ in range(draw.randint(0, 24))) for _ in range(40)]

    def edited(line):
        chars = list(line)
        for _ in range(draw.randint(0, 3)):
            i = draw.randint(0, len(chars))
            if draw.random() < 0.4:
                chars.insert(i, draw.choice("abcé"))
            elif i < len(chars):
                chars[i : i + 1] = [] if draw.random() < 0.5 else [draw.choice("abcé")]
        return "".join(chars)

    rows = [(d, "\n".join(edited(draw.choice(base)) for _ in range(draw.randint(0, 8)))) for d in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(brute.lines(rows, max_edits, per_edit), key=brute.key)
    assert kept_lines(df, max_edits=max_edits, per_edit=per_edit) == want


def test_lines_of_odd_rows_keep_all_columns(spark):
    rows = brute.odd_rows()
    docs = brute.documents(spark, rows)
    assert lines.dedup_lines(docs).columns == docs.columns
    assert kept_lines(docs) == sorted(brute.lines(rows, 2, 10), key=brute.key)
    assert lines.dedup_lines(brute.documents(spark, [])).collect() == []


def test_lines_without_python_and_without_cross_joins(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = lines.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


def test_automaton_counts_edits(spark):
    draw = random.Random(3)
    pairs = [("".join(draw.choice("abé") for _ in range(draw.randint(0, 9))), "".join(draw.choice("abé") for _ in range(draw.randint(0, 9)))) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string")
    points = keep(lines.code_points(df, "a", "b"), "pairs").df
    for k in (1, 2, 3):
        got = points.select("a", "b", lines.within(k), lines._bags_differ(lines.bag(F.col("a")), lines.bag(F.col("b"))))
        for r in got.collect():
            assert r[2] == (brute.edits(r[0], r[1]) <= k) and (not r[2] or r[3] <= 2 * k)


def test_letter_counts_bound_the_edits(spark):
    draw = random.Random(8)
    pairs = [("".join(draw.choice(lines.COUNTED + "xyzé ") for _ in range(draw.randint(0, 40))),) * 2 for _ in range(200)]
    changed = []
    for a, b in pairs:
        chars = list(b)
        for _ in range(draw.randint(0, 6)):
            chars[draw.randint(0, len(chars)) : draw.randint(0, len(chars))] = draw.choice(lines.COUNTED)
        changed.append((a, "".join(chars)))
    df = spark.createDataFrame(changed, "a string, b string")
    got = df.select("a", "b", lines._counts_differ(*[lines._counts(F.col(c)) for c in "ab"])).collect()
    for a, b, gap in got:
        rest = [(a.count(c) - b.count(c)) % 4 for c in lines.COUNTED]
        assert gap == sum(min(r, 4 - r) for r in rest) <= 2 * brute.edits(a, b)


def test_one_changed_word_in_long_lines(spark):
    """Edits grow with the line: a changed word does not save a long near copy, in a group or alone."""
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("aeioudnrstéß") for _ in range(draw.randint(2, 9)))
    rows = []
    for i in range(40):
        words = [word() for _ in range(draw.randint(12, 60))]
        rows.append((i, " ".join(words)))
        for k in range(30 if i == 0 else 2):
            changed = list(words)
            changed[draw.randrange(len(words))] = word()
            rows.append((100 + 40 * i + k, " ".join(changed)))
    solid = "".join(draw.choice("日本語文字列検索東京都大阪府県市町村山川海空") for _ in range(90))
    rows += [(5000, solid), (5001, solid[:40] + "新しい語" + solid[43:])]
    allowed = lambda a, b: min(len(a), len(b)) // 10
    want = {d for d, t in rows if any(e < d and abs(len(s) - len(t)) <= allowed(s, t) and brute.edits(s, t) <= allowed(s, t) for e, s in rows)}
    got = lines.dedup_lines(brute.documents(spark, rows), n_removed="n_removed_", grows=True).where("n_removed_ = 1")
    assert {r["doc_id"] for r in got.collect()} == want and len(want) > 100


def test_within_counts_edits():
    draw = random.Random(4)
    for _ in range(2000):
        a, b = ("".join(draw.choice("abé") for _ in range(draw.randint(0, 9))) for _ in range(2))
        k = draw.randint(0, 6)
        assert brute.within(a, b, k) == (brute.edits(a, b) <= k)


def test_registered_line_dedup_against_all_pairs(spark, folder):
    """What the query runs, on every line of the smallest table."""
    rows = brute.table_rows(spark.read.parquet(f"{folder}/documents.parquet"))
    want = [(d, t, n) for d, t, n in brute.lines(rows, 2, 10, grows=True)]
    got = queries.QUERIES["op4_line_dedup"](spark, folder).select("doc_id", "text", "n_removed").collect()
    assert sorted(map(tuple, got), key=brute.key) == sorted(want, key=brute.key)


def test_intact_segments_bound_the_edits(spark):
    draw = random.Random(5)
    pairs = []
    for _ in range(300):
        a = "".join(draw.choice("abcdé ") for _ in range(draw.randint(0, 60)))
        chars = list(a)
        for _ in range(draw.randint(0, 8)):
            i = draw.randint(0, len(chars))
            chars[i : i + draw.randint(0, 1)] = draw.choice(["", "x", "é"])
        pairs.append((a, "".join(chars), brute.edits(a, "".join(chars))))
    pairs.append(("abcdefghijklmnopqrstuvwxy", "zzzzzzzzzzzzzzzzzzzzzzzzz", 25))
    df = spark.createDataFrame(pairs, "a string, b string, k int")
    passed = [r[0] for r in df.select(lines._intact(F.col("a"), F.col("b"), F.col("k"))).collect()]
    assert all(passed)
    assert not df.select(lines._intact(F.col("a"), F.col("b"), F.lit(2))).collect()[-1][0]


def test_written_tables_leave_no_shuffle_files(spark):
    """The files of an exchange go once the table behind it is written; the session's setting stays as it was."""
    cleaner = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {name for name in cleaner.getAllFiles().mkString("\n").split("\n") if "shuffle_" in name}
    before, setting = shuffled(), spark.conf.get(CLEANUP_KEY)
    kept = keep(spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    for _ in range(100):
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before and spark.conf.get(CLEANUP_KEY) == setting
    assert kept.df.count() == 7


def test_frequent_texts_are_taken_once_or_more_with_equal_results(spark, monkeypatch):
    """However few texts may be sent to every task, the same lines go."""
    words = "the long and winding line of twenty or more words that many documents share with one another today".split()
    rows = [(i, " ".join(words[: 12 + i % 5]) + ("" if i % 3 else " tail")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(brute.lines(rows, 2, 10, grows=True), key=brute.key)
    for bound in (400_000, 3):
        monkeypatch.setattr(lines, "BROADCAST_LINES", bound)
        assert kept_lines(docs, grows=True) == want


def test_pairs_in_slices_lose_no_link(spark, monkeypatch):
    """However few pairs carry their segments at once, the same lines go, and every pair is in one slice."""
    draw = random.Random(17)
    line = lambda: " ".join("".join(draw.choice("aeinrst") for _ in range(draw.randint(3, 7))) for _ in range(14))
    common = "shared by all of them"
    rows = [(i, f"{common} {line()}") for i in range(24)]
    rows += [(100 + i, t.replace(t.split()[9], "changed").replace(t.split()[12], "again")) for i, t in rows[:12]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, slices, compared = sorted(brute.lines(rows, 2, 10, grows=True), key=brute.key), [], []
    write = lines.keep

    def watched(df, label):
        kept = write(df, label)
        if label == "line-pairs-held":
            slices[-1] += 1
            compared[-1] += kept.df.count()
        return kept

    monkeypatch.setattr(lines, "keep", watched)
    for at_once, a_text in ((1_000_000, 8), (1, 1)):
        monkeypatch.setattr(lines, "PAIRS_AT_ONCE", at_once)
        monkeypatch.setattr(lines, "PAIRS_A_TEXT", a_text)
        slices.append(0)
        compared.append(0)
        assert kept_lines(docs, grows=True) == want
    assert slices[0] == 2 < slices[1] and compared[0] == compared[1] > 0


def test_runs_in_slices_lose_no_line(spark, monkeypatch):
    """However few runs are dealt at once, the same lines go, and the rows of one slice go before the next is made."""
    draw = random.Random(29)
    line = lambda: " ".join("".join(draw.choice("aeinrst") for _ in range(draw.randint(3, 7))) for _ in range(14))
    rows = [(i, f"{line()} shared by all of them {line()}") for i in range(20)]
    rows += [(100 + i, t.replace(t.split()[5], "changed").replace(t.split()[20], "again")) for i, t in rows[:10]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, write, written, open_ = sorted(brute.lines(rows, 2, 10, grows=True), key=brute.key), lines.keep, [], []

    def watched(df, label):
        kept = write(df, label)
        written.append(label)
        if label == "line-heads":
            open_.append(kept)
            folders = [os.path.exists(k.path.removeprefix("file:")) for k in open_]
            assert folders == [False] * (len(open_) - 1) + [True]
        return kept

    monkeypatch.setattr(lines, "keep", watched)
    assert kept_lines(docs, grows=True) == want
    assert written.count("line-shared") == written.count("line-heads") == 1
    for name, most in (("RUNS_AT_ONCE", 1), ("RUNS_A_TEXT", 14), ("SHARED_AT_ONCE", 1), ("SHARED_A_TEXT", 8)):
        monkeypatch.setattr(lines, name, most)
    written.clear(), open_.clear()
    assert kept_lines(docs, grows=True) == want
    assert written.count("line-shared") >= 2 and written.count("line-heads") >= 4


def test_lengths_and_letters_bound_the_edits(spark, monkeypatch):
    """Lines that share a run, but whose letters and lengths differ by more than the edits can, are no pair."""
    # 62 and 66 characters: 6 edits may change 12 letters, but 8 if 4 of them are put in.
    texts = ["shared by all of them " + "w" * 40, "shared by all of them " + "w" * 37 + "e" * 7]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    write, pairs = lines.keep, []

    def watched(df, label):
        kept = write(df, label)
        if label in ("line-pairs-heads", "line-pairs-runs"):
            pairs.extend(tuple(r) for r in kept.df.collect())
        return kept

    monkeypatch.setattr(lines, "keep", watched)
    assert kept_lines(docs, grows=True) == sorted(brute.lines(list(enumerate(texts)), 2, 10, grows=True), key=brute.key)
    assert pairs == []
    draw = random.Random(31)
    rows = []
    for _ in range(300):
        a = "".join(draw.choice("etain ,.bq") for _ in range(draw.randint(0, 60)))
        chars = list(a)
        for _ in range(draw.randint(0, 8)):
            i = draw.randint(0, len(chars))
            chars[i : i + draw.randint(0, 1)] = draw.choice(["", "e", "é", " "])
        rows.append((a, "".join(chars), brute.edits(a, "".join(chars))))
    df = spark.createDataFrame(rows, "a string, b string, k int")
    counts = lambda c: F.struct(*[lines._letters(F.col(c), lines.RUN_LETTERS[8 * i : 8 * i + 8]).alias(n) for i, n in enumerate(lines.LETTER_COUNTS)])
    df = df.select("a", "b", "k", counts("a").alias("e"), counts("b").alias("l"))
    bound = 2 * F.col("k") - F.abs(F.char_length("a") - F.char_length("b"))
    assert df.where(lines._letters_differ("e", "l") > bound).count() == 0


def test_long_lines_by_pieces(spark):
    """Pieces of a line make up the line; their edits are as many as the distance or more, and the answer is that of the distance."""
    draw = random.Random(37)
    word = lambda: "".join(draw.choice("aeinrst日é") for _ in range(draw.randint(0, 9)))
    rows = []
    for k in range(24):
        words = [word() for _ in range(520)]
        other = list(words)
        for _ in range(draw.randint(0, 150)):
            other[draw.randrange(len(other))] = word()
        if k % 3 == 0:
            other.insert(draw.randrange(40), word())
        rows.append((" ".join(words), " ".join(other)))
    rows += [("", " "), ("a\r b \u0085 ", "a\r b"), ("x" * 2500, "x" * 2400 + "y" * 90), ("  ", "")]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("k", F.levenshtein("a", "b"))
    got = df.select(
        "a", F.array_join(lines._pieces(F.col("a")), "").alias("whole"), "k", F.size(lines._pieces(F.col("a"))).alias("pieces"),
        lines._edits_by_pieces(F.col("a"), F.col("b"), F.lit(10_000)).alias("more"),
        *[lines.near_lines(F.col("a"), F.col("b"), F.col("k") + d).alias(f"d{d}") for d in (-1, 0, 30)],
    ).collect()
    for r in got:
        assert r["a"] == r["whole"] and r["more"] >= r["k"] and (r["d-1"], r["d0"], r["d30"]) == (False, True, True)
    assert all(r["pieces"] >= 10 for r in got[:24])
    assert sum(r["more"] <= r["k"] + 30 for r in got[:24]) > 12


def test_runs_of_the_same_texts_bring_them_together_once(spark, monkeypatch):
    """A passage of many runs gives one row a text, and what was compared with a first line is not compared with it again."""
    draw = random.Random(23)
    word = lambda: "".join(draw.choice("aeinrst") for _ in range(draw.randint(3, 7)))
    passage = " ".join(word() for _ in range(20))
    rows = [(i, f"{' '.join(word() for _ in range(12))} {passage} {' '.join(word() for _ in range(12))}") for i in range(30)]
    rows += [(100 + i, t.replace(t.split()[3], "changed")) for i, t in rows[:5]]
    # A pair that shares several runs and is not near.
    rows += [(200 + i, " ".join(["some words that only these two hold", *(word() for _ in range(9))])) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    write, kept = lines.keep, {}

    def watched(df, label):
        written = write(df, label)
        if label in ("line-heads", "line-pairs-heads", "line-pairs-runs"):
            kept[label] = [tuple(r) for r in written.df.select(*written.df.columns[:2]).collect()]
        return written

    monkeypatch.setattr(lines, "keep", watched)
    assert kept_lines(docs, grows=True) == sorted(brute.lines(rows, 2, 10, grows=True), key=brute.key)
    # One row for the passage, one more for the runs beyond it that a text shares with its copy or the pair with each other.
    assert len(kept["line-heads"]) <= 35 + 2 * 5 + 2 + 4 < 17 * 35
    assert len(set(kept["line-pairs-heads"])) > 0 and not set(kept["line-pairs-heads"]) & set(kept["line-pairs-runs"])


def test_runs_row_by_row(spark):
    """Every run of four words, or of twelve characters where there are few spaces, but not one that repeats the last."""
    texts = ["a b\tc  d e", "x x x x x x x", "a b a b a b a b", "only three words", "日本語文字列検索東京都大阪府県" * 2, "q" * 30, ""]
    held = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, line string").withColumn("n", F.char_length("line"))
    got = lines._with_runs(held, id=F.col("id")).groupBy("id").agg(F.count("*"), F.count_distinct("run")).collect()
    assert sorted(map(tuple, got)) == [(0, 2, 2), (1, 1, 1), (2, 5, 2), (4, 19, 15), (5, 1, 1)]


def test_columns_of_a_line_are_made_once(spark):
    """No column of a line is computed above the explode of its runs."""
    docs = spark.createDataFrame([(1, "a line")], "doc_id long, text string")
    made = lines._with_runs(lines._lines(docs), key2=lines._second_key(), c=lines._letters(F.col("line"), "et"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    top = plan.split("Generate")[0]
    assert "replace" not in top and "xxhash64" not in top


def test_lines_without_sending_tables(spark, monkeypatch):
    """Both ways to fetch lines give the same."""
    rows = [*brute.odd_rows(), *[(100 + i, f"a line that differs by its number {i}\nand one that repeats\nodd {i * 7919}") for i in range(30)]]
    docs = brute.documents(spark, rows)
    want = sorted(brute.lines(rows, 2, 10), key=brute.key)
    assert kept_lines(docs) == want
    monkeypatch.setattr(lines, "BROADCAST_LINES", -1)
    assert kept_lines(docs) == want


def grouped(df, **options):
    return sorted(map(tuple, simhash.component_rows(df, **options).collect()), key=brute.key)


def test_groups_of_odd_rows_and_of_none(spark):
    rows = brute.odd_rows()
    docs = brute.documents(spark, rows)
    assert grouped(docs) == sorted(brute.groups(rows, 4, 4), key=brute.key)
    assert grouped(brute.documents(spark, [])) == []
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    # One row of each group stays.
    assert kept.count() == len(set(simhash.near_copies(docs).select("head").distinct().collect()))
    assert simhash.one_per_group(brute.documents(spark, [])).count() == 0


def test_groups_of_the_given_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = brute.table_rows(docs)
    want = brute.groups(rows, 4, 4)
    assert grouped(docs) == sorted(want, key=brute.key)
    kept = {r[0] for r in simhash.one_per_group(docs).select("doc_id").collect()}
    assert kept == {c for _, _, c in want}


@pytest.mark.parametrize("bits", [0, 2, 4, 6])
def test_links_against_all_pairs(spark, bits):
    draw = random.Random(bits)
    prints = [draw.getrandbits(64) for _ in range(60)]
    prints += [p ^ sum(1 << draw.randrange(64) for _ in range(draw.randint(0, 7))) for p in prints for _ in range(3)]
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    got = simhash.linked(spark.createDataFrame([(p,) for p in signed], "fp long"), bits).collect()
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= bits}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_postings_are_not_sent_to_every_task(spark):
    """A small table of fingerprints has 70 times as many postings, which no estimate of its size tells."""
    classes = keep(spark.range(20_000).select(F.xxhash64("id").alias("fp")), "classes").df
    plan = simhash.linked(classes, 4)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_a_chain_a_star_and_nothing(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
