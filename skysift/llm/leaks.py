"""Benchmark decontamination: documents that hold a benchmark item, exactly or with a few words edited.

An item of m words is held where some passage of a document is within floor(m / 5) word edits of it, which is a
similarity of 0.8 or more. Windows of m words are embedded by the random walk of Chakraborty, Goldenberg and
Koucky, which turns word edits into a number of differing places: step j writes the current word and moves on
or stays by a random bit of that word. Each of several tables samples a few places of the walk; windows that
agree with an item in all places of one table are candidates, and an exact alignment decides. Only windows
that hold one of the item's edits + 1 pieces unchanged, at its place give or take the edits, are embedded:
without an unchanged piece no passage is near enough, so none is lost by that.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.llm.common import in_batches, keep, picked

#: Words per allowed edit; shorter items say too little and are never found.
WORDS_PER_EDIT = 5
MIN_WORDS = 5
#: Tables and sampled places in each. Measured over randomly edited items: a recall of 0.95 or more for as many
#: edits as allowed, more for fewer, and 1 for exact passages (see the tests).
TABLES, PLACES = 48, 2
#: Items searched for at once. A larger benchmark is searched for in blocks, one scan of the documents each.
BLOCK = 20_000
PRIME = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 22


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit number a word: runs without white space of ASCII, in lower case."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of ``size`` words."""
    n = max(0, len(words) - size + 1)
    found = np.full(n, size, np.uint64)
    for k in range(size):
        found = (found ^ words[k : k + n]) * PRIME
        found ^= found >> np.uint64(29)
    return found


@dataclass
class Walks:
    """The random bits of the embedding and the places that each table samples, the same on every machine."""

    longest: int
    turns: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.turns = np.random.default_rng(5).integers(0, 2**63, 3 * self.longest, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def places(self, size: int) -> np.ndarray:
        """TABLES rows of PLACES places. Two thirds of a walk of 3 * size steps are reached before its end."""
        return np.random.default_rng(size).integers(0, 2 * size, (TABLES, PLACES))

    def signatures(self, words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """For each window words[start : start + size] a number per table; past the end stands a zero."""
        steps = 2 * size
        seen, at = np.zeros((steps, len(starts)), np.uint64), np.zeros(len(starts), np.int64)
        for j in range(steps):
            inside = (at < size) & (starts + at < len(words))
            here = np.where(inside, words[np.minimum(starts + at, len(words) - 1)], np.uint64(0))
            seen[j] = here
            at += ((here * self.turns[j]) >> np.uint64(63)).astype(np.int64)
            at += ~inside
        made = np.empty((len(starts), TABLES), np.uint64)
        for t, places in enumerate(self.places(size)):
            value = np.full(len(starts), t + 1, np.uint64)
            for p in places:
                value = (value ^ seen[p]) * PRIME
                value ^= value >> np.uint64(31)
            made[:, t] = value
        return made


def edits_within(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """The fewest word edits between an item and any run of words of a region, and where the best run ends."""
    n = len(region)
    at, row = np.arange(n + 1), np.zeros(n + 1, np.int64)
    for k, word in enumerate(item, 1):
        step = np.empty(n + 1, np.int64)
        step[0] = k
        step[1:] = np.minimum(row[1:] + 1, row[:-1] + (region != word))
        row = np.minimum.accumulate(step - at) + at
    end = int(row.argmin())
    return int(row[end]), end


class Finder:
    """Finds the items of one block in texts."""

    def __init__(self, items: Sequence[tuple[int | None, str | None]]):
        kept = [(i, w) for i, t in items if len(w := word_hashes(t)) >= MIN_WORDS]
        self.ids, self.words = [i for i, _ in kept], [w for _, w in kept]
        self.walks = Walks(max(map(len, self.words), default=1))
        #: By piece length: sorted numbers of pieces, and for each the items with the piece and its place.
        pieces: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        self.tables: dict[int, list[dict[int, list[int]]]] = {}
        for k, words in enumerate(self.words):
            m, edits = len(words), len(words) // WORDS_PER_EDIT
            size = m // (edits + 1)
            grams = _grams(words, size)
            for p in range(edits + 1):
                pieces[size][int(grams[p * size])].append((k, p * size))
            tables = self.tables.setdefault(m, [defaultdict(list) for _ in range(TABLES)])
            for table, value in zip(tables, self.walks.signatures(words, np.zeros(1, np.int64), m)[0].tolist()):
                table[value].append(k)
        self.pieces = {size: (np.array(sorted(by), np.uint64), by) for size, by in pieces.items()}
        self.filters = {}
        for size, (known, _) in self.pieces.items():
            self.filters[size] = np.zeros(1 << FILTER_BITS, bool)
            self.filters[size][known >> np.uint64(64 - FILTER_BITS)] = True

    def _windows(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """Starts of the windows to embed, by window size."""
        starts: dict[int, set[int]] = defaultdict(set)
        for size, (known, by) in self.pieces.items():
            grams = _grams(words, size)
            some = np.flatnonzero(self.filters[size][grams >> np.uint64(64 - FILTER_BITS)])
            for at, gram in zip(some.tolist(), grams[some].tolist()):
                for k, place in by.get(gram, ()):
                    m = len(self.words[k])
                    edits = m // WORDS_PER_EDIT
                    starts[m].update(range(max(0, at - place - edits), max(0, at - place + edits) + 1))
        return {m: np.array(sorted(s), np.int64) for m, s in starts.items()}

    def find(self, text: str | None) -> list[tuple[int | None, int, int, int]]:
        """(item, number of the first word, words, edits) of each item that a text holds, its best passage first found."""
        words = word_hashes(text)
        if len(words) == 0:
            return []
        near: dict[int, set[int]] = defaultdict(set)
        for m, starts in self._windows(words).items():
            starts = starts[starts < len(words)]
            for start, values in zip(starts.tolist(), self.walks.signatures(words, starts, m).tolist()):
                for table, value in zip(self.tables[m], values):
                    for k in table.get(value, ()):
                        near[k].add(start)
        found = []
        for k, places in sorted(near.items()):
            item = self.words[k]
            m, edits = len(item), len(item) // WORDS_PER_EDIT
            best: tuple[int, int, int] | None = None
            run: list[int] = []
            for start in [*sorted(places), None]:
                if run and (start is None or start > run[-1] + m):
                    low, high = max(0, run[0] - edits), min(len(words), run[-1] + m + edits)
                    cost, end = edits_within(item, words[low:high])
                    if cost <= edits and (best is None or cost < best[0]):
                        # The passage ends there; aligned from its end backwards it also shows its start.
                        back = edits_within(item[::-1], words[low : low + end][::-1][: m + edits])
                        best = (cost, low + end - back[1], back[1])
                    run = []
                if start is not None:
                    run.append(start)
            if best is not None:
                found.append((self.ids[k], best[1], best[2], best[0]))
        return found


def blocks(items: DataFrame, size: int = BLOCK) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items, at most about ``size`` at a time."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    parts = max(1, -(-rows.count() // size))
    for part in range(parts):
        some = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        yield [tuple(r) for r in some.orderBy("item_id", "text").collect()]


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, edits) for each document and item that it holds: the best passage.

    Whole texts are searched. Null and empty texts hold nothing; items that are null or shorter than
    MIN_WORDS words are never held; repeated items count once. Repeated rows of documents each give their rows.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, first_word long, n_words long, edits long"
    found = None
    for block in blocks(items):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            finder = Finder(block)
            for batch in batches:
                rows = [(d, *f) for d, t in zip(batch.column(0).to_pylist(), batch.column(1)) for f in finder.find(t.as_py())]
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "first_word", "n_words", "edits"])

        part = in_batches(given, run, schema)
        found = part if found is None else found.union(part)
    return found


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item; all their columns and rows as they are."""
    names = docs.columns
    at = names.index("text")
    for k, block in enumerate(blocks(items)):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            finder = Finder(block)
            for batch in batches:
                yield batch.filter(pa.array([not finder.find(t.as_py()) for t in batch.column(at)], pa.bool_()))

        # A long chain of scans is cut by a table in the shared folder.
        docs = picked(docs if k == 0 else keep(docs, "clean").df, names)
        docs = in_batches(docs, run, docs.schema)
    return docs
