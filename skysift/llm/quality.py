"""Quality classifier: an ordinal cumulative-link regression on graded ratings.

A document is a set of hashed words and of a few bucketed shares (capitals, repeats, symbols ...). All
grades share one weight per hashed feature; ordered thresholds cut the weighted sum s into grades:
P(grade >= k) = 1 / (1 + exp(threshold_k - s)). The expected grade ranks documents, the tail probability
selects them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysift.llm.common import free_name, in_batches, picked, text_rows, with_fields

#: Hashed features; the model is two arrays of this length.
BUCKETS = 2**18
#: Labelled documents used to fit, at most: those with the smallest digests of their ids.
MAX_LABELLED = 16_000
#: A hashed feature needs so many labelled documents to get a weight.
MIN_DOCUMENTS = 4
#: And a mean grade so many standard errors from the mean of all.
MIN_DEVIATION = 2.5
LETTERS = re.compile(r"[^\W\d_]+")
#: Lengths of the beginnings of words that are features beside the words: they hold what inflected words share.
BEGINNINGS = (4, 5)


@dataclass(frozen=True)
class Model:
    """Weights by hashed feature and rising thresholds between the grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, sums: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 ... as columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - sums[:, None], -60, 60)))


@lru_cache(maxsize=40_000)
def _bucket(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def features(text: str) -> np.ndarray:
    """The distinct hashed features of one whole text, sorted."""
    words = LETTERS.findall(text.lower())
    distinct = set(words)
    raw = text.split()
    n, chars = max(1, len(raw)), max(1, len(text))
    letters = sum(map(len, words))
    digits = len(re.findall(r"\d", text))
    spaces = chars - sum(map(len, raw))
    shares = {
        "capitals": (len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))) / max(1, letters),
        "symbols": (chars - spaces - letters - digits) / chars,
        "digits": digits / chars,
        "distinct": len(distinct) / max(1, len(words)) * min(1.0, n / 50),
        "commonest": (Counter(raw).most_common(1)[0][1] if raw else 0) / n,
        "adjacent": sum(map(str.__eq__, raw, raw[1:])) / n,
        "stops": len(re.findall(r"[.!?]", text)) / n,
    }
    found = {_bucket(w) for w in distinct}
    for size in BEGINNINGS:
        found.update({_bucket(f"\x02{w}") for w in {w[:size] for w in distinct if len(w) > size}})
    found.update(_bucket(f"\x01{name}{int(min(share, 1) ** 0.5 * 20)}") for name, share in shares.items())
    found.add(_bucket(f"\x01length{min(20, round(chars / n))}"))
    found.add(_bucket(f"\x01size{len(raw).bit_length()}"))
    return np.array(sorted(found), np.int32)


def _sums(rows: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of each row's features. Every row has some."""
    ends = np.cumsum([len(r) for r in rows])
    return np.add.reduceat(weights[np.concatenate(rows)], np.r_[0, ends[:-1]])


def _telling(rows: list[np.ndarray], grades: np.ndarray) -> np.ndarray:
    """Which features are in enough documents whose mean grade is far enough from that of all."""
    flat, off = np.concatenate(rows), grades - grades.mean()
    seen = np.bincount(flat, minlength=BUCKETS)
    total = np.bincount(flat, np.repeat(off, [len(r) for r in rows]), minlength=BUCKETS)
    spread = np.sqrt(np.maximum(seen, 1) * max(off.var(), 1e-12))
    return (seen >= MIN_DOCUMENTS) & (np.abs(total) >= MIN_DEVIATION * spread)


def _steps(rows: list[np.ndarray], grades: np.ndarray, top: int, epochs: int, rate: float, shrink: float) -> Model:
    """Adaptive gradient steps over small groups of rows in a fixed order."""
    told = _telling(rows, grades)
    rows = [r[told[r]] for r in rows]
    rows = [r if len(r) else np.zeros(1, np.int32) for r in rows]
    weights, past = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    share = np.array([(grades >= k).mean() for k in range(1, top + 1)]).clip(0.01, 0.99)
    thresholds = np.minimum.accumulate((np.log(1 - share) - np.log(share))[::-1])[::-1] + 1e-3 * np.arange(top)
    drawn = np.random.default_rng(1)
    for epoch in range(epochs):
        order = drawn.permutation(len(rows))
        for group in np.array_split(order, max(1, len(rows) // 128)):
            part, y = [rows[i] for i in group], grades[group]
            tails = Model(weights, thresholds).tails(_sums(part, weights))
            padded = np.c_[np.ones(len(group)), tails, np.zeros(len(group))]
            at = np.arange(len(group))
            above, below = padded[at, y], padded[at, y + 1]
            p = np.maximum(above - below, 1e-9)
            by_row = np.repeat(1 - above - below, [len(r) for r in part])
            at_features = np.concatenate(part)
            used, where = np.unique(at_features, return_inverse=True)
            slope = np.bincount(where, by_row) - shrink * len(group) * weights[used]
            past[used] += slope**2
            weights[used] += rate * slope / np.sqrt(past[used])
            for k in range(1, top + 1):
                move = np.where(y == k, -above * (1 - above) / p, 0) + np.where(y == k - 1, below * (1 - below) / p, 0)
                thresholds[k - 1] += 0.05 * move.mean()
            thresholds = np.maximum.accumulate(thresholds + 1e-6 * np.arange(top))
    return Model(weights, thresholds)


def fit(
    docs: DataFrame, ratings: DataFrame, grades: int, max_labelled: int = MAX_LABELLED,
    epochs: int = 60, rate: float = 0.3, shrink: float = 1e-3,
) -> Model:
    """Fit on the documents that ``ratings`` (doc_id, grade from 0 to grades - 1) rates.

    At most ``max_labelled`` documents are used, those with the smallest digests of their ids. Ratings with a
    null are left out; of several ratings of a document the lowest counts. Without any rated document the
    model rates everything alike. The fit itself runs in one task, over that bounded sample.
    """
    rated = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    sample = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    sample = sample.select(F.col("doc_id").alias("rated_id"), F.col("grade").cast("int"))
    rows = text_rows(docs)
    # The sample has at most max_labelled rows, so it may be sent to every task.
    given = rows.join(F.broadcast(sample), F.col("doc_id") == F.col("rated_id")).select("doc_id", "grade", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pa.array([features(t) for t in batch.column(2).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["doc_id", "grade", "found"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [
            (d, g, f) for b in batches for d, g, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))
        ]
        if not rows:
            return
        # Not the order in which rows arrive, so that a repeated run gives the same model.
        found = [np.asarray(f.values.to_numpy()) for _, _, f in rows]
        order = sorted(range(len(rows)), key=lambda i: (rows[i][0], rows[i][1], found[i].tobytes()))
        y = np.array([min(max(rows[i][1], 0), grades - 1) for i in order])
        model = _steps([found[i] for i in order], y, grades - 1, epochs, rate, shrink)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.weights.astype("<f8").tobytes()]), pa.array([model.thresholds.astype("<f8").tobytes()])],
            ["weights", "thresholds"],
        )

    prepared = in_batches(given, read, "doc_id long, grade int, found array<int>")
    learned = prepared.repartition(1).mapInArrow(learn, "weights binary, thresholds binary").collect()
    if not learned:
        return Model(np.zeros(BUCKETS), np.zeros(grades - 1))
    return Model(np.frombuffer(learned[0][0], "<f8"), np.frombuffer(learned[0][1], "<f8"))


def score(docs: DataFrame, model: Model, expected: str = "expected_grade", tail: str = "tail_probability") -> DataFrame:
    """``docs`` with the expected grade and the probability of the best grade, from whole texts.

    A null text counts as empty. Rows do not depend on each other; columns of these names are replaced.
    """
    names = [c for c in docs.columns if c not in (expected, tail)]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t or "") for t in batch.column(at).to_pylist()]
            tails = model.tails(_sums(rows, model.weights)) if rows else np.zeros((0, len(model.thresholds)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])], [*names, expected, tail]
            )

    given = picked(docs, names)
    added = [T.StructField(expected, T.DoubleType()), T.StructField(tail, T.DoubleType())]
    return in_batches(given, run, with_fields(given, *added))


def graded(labels: DataFrame) -> DataFrame:
    """Grades of the label table: 0 poor, 1 well written but toxic, 2 good. A null label gives no grade."""
    good = F.when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 2)
    return labels.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, good).alias("grade"),
    )


#: A document stays if the best grade is at least this likely.
KEEP_FROM = 0.6


def select(docs: DataFrame, model: Model, least: float = KEEP_FROM) -> DataFrame:
    """The documents whose best grade has a probability of ``least`` or more; all columns of ``docs``."""
    expected, tail = free_name(docs, "expected_grade"), free_name(docs, "tail_probability")
    return picked(score(docs, model, expected, tail).where(F.col(tail) >= least), docs.columns)
