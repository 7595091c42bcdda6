"""Phrase collocation mining by marginalising counts of the longest windows.

Every word of a piece starts one window of ``longest`` words, its lead columns, padded where the piece ends. Only
these windows are counted; Spark's ROLLUP over the lead columns adds up all shorter phrases, which are prefixes of
windows, and all words. No shorter phrase is ever listed by itself.

Each task adds up equal windows of its own texts before they are dealt, so a pair of words that stands everywhere
sends a few rows a task. They leave the task in order of their words, which shuffles in half the bytes, and are dealt
by all words but the last: the counts of windows and the sums over their last words then need no further exchange.

A phrase is as strong as its weakest cut in two: a * a / (l * r) with a, l, r the counts of the phrase, of what
stands before the cut and of what stands after it. A phrase goes if a longer candidate that holds it is at least
``held`` percent as frequent. All arithmetic is done on whole numbers, beyond 64 bits where it may get there.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.llm.common import in_batches, keep

#: Words of a phrase at most, its occurrences at least, percent of a phrase's count that a longer one needs to replace it.
LONGEST, LEAST, HELD = 3, 10, 50
TOP = 2000
#: A score of 1 is this many.
SCALE = 1_000_000
#: Ends of pieces; the first one stands for all of them. No word holds one.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
END = ENDS[:1]
LOWERED = bytes.maketrans(string.ascii_uppercase.encode() + ENDS, string.ascii_lowercase.encode() + END * len(ENDS))
#: Stands for the words of a window beyond the end of its piece; no word is empty.
PAD = ""
WINDOW = ["lang", "head", "last", "n"]
#: Windows that a task adds up at once, and rows handed over at once; bounds on memory, not on input.
WINDOWS, ROWS = 1 << 21, 1 << 15


class _Numbers(dict[bytes, int]):
    """Numbers of words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class _Tally:
    """Windows of some texts, by numbers that hold until the tally is emptied."""

    def __init__(self, longest: int):
        self.longest = longest
        self.empty()

    def empty(self) -> None:
        self.langs, self.words = _Numbers(), _Numbers({END: 0})
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, text: str) -> None:
        listed = text.encode().translate(LOWERED).replace(END, b" . ").split()
        ids = np.fromiter(map(self.words.__getitem__, listed), np.int64, len(listed))
        padded = np.concatenate([ids, np.zeros(self.longest - 1, np.int64)])
        columns = [np.full(len(ids), self.langs[lang.encode()]), ids]
        for k in range(1, self.longest):
            # A lead beyond the end of the piece is padding, and so are all later ones.
            columns.append(np.where(columns[-1] == 0, 0, padded[k : k + len(ids)]))
        self.parts.append(np.stack(columns)[:, ids != 0])
        self.size += len(ids)

    def sums(self) -> Iterator[pa.RecordBatch]:
        """Different windows and how often they occurred, sorted by the numbers of their words."""
        columns = np.concatenate(self.parts, axis=1) if self.parts else np.empty((self.longest + 1, 0), np.int64)
        # Prefixes are numbered afresh word by word, so a number and the next word fit into 64 bits.
        prefix = columns[0]
        for column in columns[1:]:
            _, first, prefix, times = np.unique(prefix * len(self.words) + column, return_index=True, return_inverse=True, return_counts=True)
        langs, words = (pa.array(list(known), pa.binary()).cast(pa.string()) for known in (self.langs, [PAD.encode(), *list(self.words)[1:]]))
        for begin in range(0, len(columns[0]) and len(first), ROWS):
            some = columns[:, first[begin : begin + ROWS]]
            lang, *listed = (source.take(pa.array(ids)) for source, ids in zip([langs, *[words] * self.longest], some))
            head = pc.binary_join_element_wise(*listed[:-1], " ")
            yield pa.RecordBatch.from_arrays([lang, head, listed[-1], pa.array(times[begin : begin + ROWS])], WINDOW)
        self.empty()


def windows(docs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Windows, and how often (n) some task met them: lang, head (all words but the last, by single spaces) and last word.

    Words beyond the end of a piece are empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally(longest)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tally.add(lang, text)
                if tally.size >= WINDOWS:
                    yield from tally.sums()
        yield from tally.sums()

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return in_batches(rows, run, "lang string, head string, last string, n long")


def counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """lang, size, phrase (words joined by spaces) and n of every phrase of ``longest`` words (2 or more) at most.

    Phrases of fewer than ``least`` occurrences are left out; the row of size 0 counts all words of a language.
    """
    dealt = windows(docs, longest).repartition("lang", "head")
    # The condition looks at the sum first, so it stays above the exchange, which both uses of the windows share.
    full = dealt.groupBy("lang", "head", "last").agg(F.sum("n").alias("n"))
    full = full.where(F.when(F.col("n") >= least, F.col("last") != PAD).otherwise(False))
    full = full.select("lang", F.lit(longest).alias("size"), F.concat_ws(" ", "head", "last").alias("phrase"), "n")
    # Windows of one head lie in one task, so their sum is final. The count keeps both uses reading the same columns.
    heads = dealt.groupBy("lang", "head").agg(F.sum("n").alias("n"), F.count("last").alias("windows")).where("windows > 0")
    names = [f"w{k + 1}" for k in range(longest - 2)]
    often = F.when(F.col("n") >= least, ~F.col("head").rlike("^ | $|  ")).otherwise(False)
    leads = heads.select(
        "lang", *[F.get(F.split("head", " "), F.lit(k)).alias(c) for k, c in enumerate(names)],
        F.when(often, F.col("head")).otherwise(PAD).alias("whole"), "n",
    )
    # Rare heads only count towards their prefixes.
    columns = [*names, "whole"]
    summed = leads.rollup("lang", *columns).agg(F.sum("n").alias("n"), F.grouping_id().alias("rolled"))
    # The columns summed over are the last ones; their bits are set.
    size = reduce(lambda rest, k: F.when(F.col("rolled") == 2**k - 1, len(columns) - k).otherwise(rest), range(len(columns) + 1), F.lit(-1))
    sized = summed.withColumn("size", size).where((F.col("size") == 0) | ((F.col("size") > 0) & (F.col("n") >= least)))
    unpadded = reduce(lambda a, b: a & b, [(F.col("size") < k) | (F.col(c) != PAD) for k, c in enumerate(columns, 1)])
    phrase = F.when(F.col("size") == len(columns), F.col("whole")).otherwise(F.concat_ws(" ", *names) if names else F.lit(""))
    return sized.where(unpadded).select("lang", "size", phrase.alias("phrase"), "n").union(full)


def _wide(count: str) -> Column:
    return F.col(count).cast("decimal(18,0)")


def scored(counted: DataFrame, scale: int = SCALE) -> DataFrame:
    """Phrases of two words or more with a, and l, r and score of the weakest cut; of equal scores the first cut counts.

    ``counted`` is a written table as ``counts`` makes it: phrases meet their parts by (lang, phrase).
    """
    phrases = counted.where("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"))
    cuts = phrases.select("*", F.split("phrase", " ").alias("words"))
    cuts = cuts.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    cuts = cuts.select(
        "lang", "size", "phrase", "a", "cut",
        F.concat_ws(" ", F.slice("words", F.lit(1), F.col("cut"))).alias("before"),
        F.concat_ws(" ", F.slice("words", F.col("cut") + 1, F.col("size") - F.col("cut"))).alias("after"),
    )
    parts = [counted.where("size > 0").select("lang", F.col("phrase").alias(name), F.col("n").alias(n)) for name, n in (("before", "l"), ("after", "r"))]
    met = cuts.join(parts[0], ["lang", "before"]).join(parts[1], ["lang", "after"])
    # At most 18 digits a count, so the products stay below 38 digits for counts of up to 15.
    cast = {n: _wide(n) for n in ("a", "l", "r")}
    ratio = (cast["a"] * cast["a"] * F.lit(scale).cast("decimal(7,0)")).cast("decimal(38,0)")
    met = met.withColumns({"ratio": ratio, "parted": (cast["l"] * cast["r"]).cast("decimal(38,0)")})
    met = met.withColumn("score", F.expr("ratio div parted"))
    best = F.min(F.struct("score", "cut", "l", "r"))
    weakest = met.groupBy("lang", "size", "phrase", "a").agg(best.alias("best"))
    return weakest.select("lang", "size", "phrase", "a", "best.l", "best.r", "best.score")


def replaced(counted: DataFrame, held: int = HELD) -> DataFrame:
    """(lang, phrase) of the phrases that a longer candidate holds at least ``held`` percent as often."""
    longer = counted.where("size > 2").select("lang", "size", "n", F.split("phrase", " ").alias("words"))
    size, begin = F.col("inner"), F.col("begin")
    parts = longer.select("lang", "size", "n", "words", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("inner"))
    parts = parts.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("inner") + 1)).alias("begin"))
    parts = parts.select("lang", F.concat_ws(" ", F.slice("words", begin, size)).alias("phrase"), "n")
    most = parts.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    met = most.join(counted.where("size > 1"), ["lang", "phrase"])
    return met.where(F.col("longer") * 100 >= F.col("n") * held).select("lang", "phrase")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, held: int = HELD, top: int = TOP) -> DataFrame:
    """The ``top`` strongest phrases of each language: lang, rank (from 1), phrase, a, l, r, n (all its words), score.

    A to Z count as lower case. Pieces end at . , ; : ! ? and line ends, words at spaces and tabs; a phrase lies within a
    piece, and its overlapping occurrences all count. A null text has no words, a null language counts as ``und``.
    Every row counts, repeated ones and those without an id too; ids and further columns are not looked at. Ties go
    by the phrase's count, then by its UTF-8 bytes. Only the phrases that occur often enough leave the counting, and
    each task ranks its own ``top`` rows of a language before they meet.
    """
    counted = keep(counts(docs, longest, least), "phrase-counts").df
    kept = scored(counted).join(replaced(counted, held), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = counted.where("size = 0").select("lang", F.col("n").alias("all_words"))
    met = ranked.join(totals, "lang")
    return met.select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("all_words").alias("n"), F.col("score").cast("long").alias("score")
    )


#: The same rows in DuckDB's SQL, counted phrase length by phrase length.
SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM split WHERE len(w) > 0),
total AS (SELECT lang, count(*) AS n FROM placed GROUP BY lang),
counted AS (
  SELECT lang, 1 AS size, w[i] AS phrase, count(*) AS n FROM placed GROUP BY ALL
  UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1], count(*) FROM placed WHERE i + 1 <= len(w) GROUP BY ALL
  UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2], count(*) FROM placed WHERE i + 2 <= len(w) GROUP BY ALL),
cuts AS (
  SELECT lang, size, phrase, n AS a, unnest(generate_series(1, size - 1)) AS cut, string_split(phrase, ' ') AS p
  FROM counted WHERE size > 1 AND n >= 10),
weighed AS (
  SELECT c.lang, c.size, c.phrase, c.a, c.cut, x.n AS l, y.n AS r,
         (1000000::HUGEINT * c.a * c.a) // (x.n::HUGEINT * y.n) AS score
  FROM cuts c
  JOIN counted x ON x.lang = c.lang AND x.phrase = array_to_string(c.p[1:c.cut], ' ')
  JOIN counted y ON y.lang = c.lang AND y.phrase = array_to_string(c.p[c.cut + 1:], ' ')),
weakest AS (
  SELECT * FROM weighed QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, phrase, max(n) AS n FROM (
    SELECT lang, array_to_string(string_split(phrase, ' ')[1:2], ' ') AS phrase, n FROM counted WHERE size = 3 AND n >= 10
    UNION ALL SELECT lang, array_to_string(string_split(phrase, ' ')[2:3], ' '), n FROM counted WHERE size = 3 AND n >= 10)
  GROUP BY ALL),
kept AS (
  SELECT w.* FROM weakest w LEFT JOIN longer g ON g.lang = w.lang AND g.phrase = w.phrase
  WHERE w.size > 2 OR g.n IS NULL OR 100 * g.n < 50 * w.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY k.score DESC, k.a DESC, k.phrase) AS rank,
       k.phrase, k.a, k.l, k.r, t.n, k.score::BIGINT AS score
FROM kept k JOIN total t ON t.lang = k.lang
QUALIFY rank <= 2000
"""
