"""Runs of repeated words, found online by dyadic square catching, and texts without their repeats.

A run is a stretch of consecutive words with smallest period q, as long as ``times`` periods and ``least`` words
at least, that no neighbouring word extends. The words are read from left to right. On level k every completed
block of B = 2^k words becomes a catcher: it waits for its own content to come back B to 2B - 1 words later. A
window of B words that a new word completes can only be awaited by one catcher of its level, so each new word
costs one comparison of suffix names a level. Where the neighbouring catchers j and j + 1 both see their content
again at distance q, the words hold squares of period q, and these squares merge into one stretch. A run of
period q is at least 3q words longer than its last q words, and so holds two neighbouring blocks of the level of q.

Names of windows double from level to level; they are hashes, so every stretch that becomes a run is compared
word by word, and a coincidence starts the search anew with other names. A stretch inside a run of smaller
period has that period too and is the same run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysift.llm.common import in_batches, picked, with_fields

#: A run holds so many words, and so many periods, at least.
LEAST, TIMES = 6, 4
#: Windows compared at once: a bound on memory, not on the text.
SLICE = 1 << 20
WORD_GAPS = r"[\x20\x09-\x0D]+"
RUNS = T.ArrayType(
    T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False
)


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit name of every number; distinct numbers have distinct names."""
    x = (x.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Found:
    """Runs found so far, by start, to ask whether one of them holds a stretch."""

    def __init__(self):
        self.runs: list[tuple[int, int, int]] = []
        self.starts = self.ends = np.empty(0, np.int64)

    def settle(self, runs: list[tuple[int, int, int]]) -> None:
        """Add the runs (start, end, period) of a level."""
        if runs:
            self.runs += runs
            ordered = np.array(sorted((s, e) for s, e, _ in self.runs), np.int64)
            self.starts, self.ends = ordered[:, 0], np.maximum.accumulate(ordered[:, 1])

    def hold(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether each stretch lies within a run."""
        if not len(self.starts):
            return np.zeros(len(starts), bool)
        at = np.searchsorted(self.starts, starts, "right") - 1
        return (at >= 0) & (self.ends[np.maximum(at, 0)] >= ends)


def _caught(names: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(period, first block, last block) of neighbouring catchers of a level that agree on a period."""
    block, parts = 1 << level, []
    for begin in range(block, len(names), SLICE):
        ends = np.arange(begin, min(begin + SLICE, len(names)), dtype=np.int64)
        owner = (ends >> level) - 1
        hit = names[begin : begin + SLICE] == names[owner << level]
        parts.append(np.stack([ends[hit] - (owner[hit] << level), owner[hit]]))
    if not any(part.size for part in parts):
        return (np.empty(0, np.int64),) * 3
    period, owner = np.concatenate(parts, axis=1)
    order = np.lexsort((owner, period))
    period, owner = period[order], owner[order]
    new = np.ones(len(owner), bool)
    new[1:] = (np.diff(period) != 0) | (np.diff(owner) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1
    enough = last > first
    return period[first][enough], owner[first][enough], owner[last][enough]


def _stretched(words: np.ndarray, x: int, y: int, q: int, block: int) -> tuple[int, int]:
    """The widest range around [x, y) whose words recur q words later; less than a block is missing on each side."""
    low = max(0, x - block)
    differ = np.flatnonzero(words[low:x] != words[low + q : x + q])
    high = min(y + block, len(words) - q)
    after = np.flatnonzero(words[y:high] != words[y + q : high + q])
    return (low + int(differ[-1]) + 1 if len(differ) else low), (y + int(after[0]) if len(after) else high)


def find_runs(words: np.ndarray, longest: int | None = None, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of an array of numbered words, by start and period.

    Texts can be searched together if a number that occurs once stands between them; ``longest`` is then the
    length of the longest text, which bounds the periods. Memory grows with the array.
    """
    if times < 4:
        raise ValueError("two neighbouring blocks lie within every run only if it has four periods or more")
    longest, seed = len(words) if longest is None else longest, 0
    while (runs := _search(words, longest, least, times, seed)) is None:
        seed += 1
    return sorted((s, e - s, q) for s, e, q in runs)


def _search(words: np.ndarray, longest: int, least: int, times: int, seed: int) -> list[tuple[int, int, int]] | None:
    found, names, level = _Found(), _mixed(words, seed), 0
    while times << level <= longest:
        block, runs = 1 << level, []
        period, first, last = _caught(names, level)
        x, y = first * block, (last + 1) * block
        free = ~found.hold(x, y + period)
        for q, a, b in zip(period[free].tolist(), x[free].tolist(), y[free].tolist()):
            a, b = _stretched(words, a, b, q, block)
            if b + q - a >= max(least, times * q):
                if not np.array_equal(words[a:b], words[a + q : b + q]):
                    return None
                runs.append((a, b + q, q))
        found.settle(runs)
        if len(names) <= block:
            break
        names = _mixed(names[:-block] ^ (names[block:] * np.uint64(0xD6E8FEB86659FD93)), seed)
        level += 1
    return found.runs


class _Numbers(dict[bytes, int]):
    """Numbers of words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _read(texts: list[str | None]) -> tuple[list[list[bytes]], list[list[tuple[int, int, int]]]]:
    """The words of some texts and the runs of each."""
    split = [(t or "").encode().split() for t in texts]
    numbers, parts, starts = _Numbers(), [], [0]
    for k, words in enumerate(split):
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        parts.append(np.array([-1 - k]))
        starts.append(starts[-1] + len(words) + 1)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if texts:
        all_runs = find_runs(np.concatenate(parts), max(map(len, split)))
        owners = np.searchsorted(np.array(starts), np.array([r[0] for r in all_runs], np.int64), "right") - 1
        for k, (start, length, period) in zip(owners.tolist(), all_runs):
            runs[k].append((start - starts[k], length, period))
    return split, runs


def _left(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    covered = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        covered[start + period] += 1
        covered[start + length] -= 1
    gone = np.cumsum(covered)[:-1] > 0
    return b" ".join(w for w, g in zip(words, gone.tolist()) if not g)


def collapse(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """``docs`` without its text, with the runs (start, length, period) of its words and the text left without repeats.

    Words are separated by ASCII white space and numbered from 0. Runs stand by start, then period. The text left
    drops each word that some run holds after the run's first period; its words are joined by one space. Null and
    empty texts have no runs and an empty text left. Each row stands for itself, so null ids, ties and repeated rows
    pass through, as do further columns; a whole text is read however long it is.
    """
    rest = [c for c in docs.columns if c not in (text, runs, collapsed)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split, found = _read(batch.column(len(rest)).to_pylist())
            ends = np.cumsum([0, *map(len, found)])
            flat = np.array([r for one in found for r in one], np.int64).reshape(-1, 3)
            items = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=[pa.field(n, pa.int64(), False) for n in ("start", "length", "period")])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)
            left = pa.array([_left(w, r) for w, r in zip(split, found)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], lists, left], [*rest, runs, collapsed])

    kept = picked(docs, rest)
    schema = with_fields(kept, T.StructField(runs, RUNS), T.StructField(collapsed, T.StringType()))
    return in_batches(picked(docs, [*rest, text]), run, schema)


def looped(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of documents, one in ten (by the CRC of its id) with an end that repeats a stretch of words.

    With h the CRC-32 of the decimal id and g = floor(h / 10), a text of n words with h % 10 = 0 keeps its first
    a = g % n words; word i from a on becomes word a + (i - a) % p, with p = 1 + floor((n - a) / (3 + g % 8)).
    A null id leaves its text as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", WORD_GAPS), lambda w: w != "")
    one, some = (lambda column, make: F.get(F.transform(F.array(column), make), F.lit(0))), F.struct

    def looping(s: Column) -> Column:
        return some(s["w"].alias("w"), s["a"].alias("a"), (1 + F.floor((s["n"] - s["a"]) / (3 + s["g"] % 8))).cast("int").alias("p"))

    begun = one(some(words.alias("w"), F.floor(h / 10).alias("g")), lambda s: some(s["w"].alias("w"), s["g"].alias("g"), F.size(s["w"]).alias("n")))
    placed = one(begun, lambda s: some(s["w"].alias("w"), s["g"].alias("g"), s["n"].alias("n"), (s["g"] % F.greatest(s["n"], F.lit(1))).cast("int").alias("a")))
    ready = one(one(placed, looping), lambda s: F.array_join(_repeated(s["w"], s["a"], s["p"]), " "))
    changed = (h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return docs.select("doc_id", F.when(changed, ready).otherwise(F.col("text")).alias("text"))


def _repeated(words: Column, a: Column, p: Column) -> Column:
    """``words`` with every word i from ``a`` on replaced by word a + (i - a) % p."""
    return F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, a + (i - a) % p)))


def digests(docs: DataFrame) -> DataFrame:
    """One row a document: the number of runs, the longest (ties: smallest start, then period), and digests.

    The digests are of the lines "start,length,period" of all runs, and of the text left without repeats. Without
    runs the four columns of the longest are null.
    """
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = collapse(docs).withColumn("first", first)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("first.s").alias("start"),
        (-F.col("first.l")).alias("length"),
        F.col("first.p").alias("period"),
        F.floor(-1000 * F.col("first.l") / F.col("first.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
