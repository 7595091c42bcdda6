"""Substring dedup by recompression: words that lie in a repeated window of words are removed.

Recompression names equal neighbouring words as runs, then, round by round, joins each symbol of the left half
of the alphabet with a following one of the right half and names the pair. Which half a symbol is in, and the
name of a pair, are hashes of names, so all tasks give equal words equal names without any exchange. Every
symbol knows the words that its making depended on; wherever these words stand, the same symbol stands. Among
the symbols whose words lie in a window, the widest one, least hash first, is the window's anchor: equal
windows have equal anchors at equal places. So the name of an anchor that occurs once proves all its windows
unique, and a name that occurs more often reveals repeats: where all its occurrences have the same words around
it, for all its windows together; else its windows are compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.llm.common import in_batches, keep, order_key, text_rows

WINDOW = 20
ROUNDS = 3
#: Words of a symbol, at most.
WIDEST = 8
#: Bits of the number that tells documents with one id apart, and of the number of windows of a group.
TIE_BITS, COUNT_BITS = 24, 8
#: Names below this one, spread evenly, say that all windows of a group are repeated.
SETTLED = np.uint64(2**16)
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
ODD = np.uint64(0xA0761D6478BD642F)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers; no two numbers become one."""
    x = (x ^ (x >> np.uint64(33))) * M1
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class Prefixes:
    """Hashes of any runs of words, in constant time each: sums of word hash times a power of an odd base."""

    def __init__(self, hashes: np.ndarray, base: np.uint64):
        n = len(hashes) + 1
        self.back = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, np.uint64(pow(int(base), -1, 2**64)))], dtype=np.uint64)
        powers = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base)], dtype=np.uint64)
        self.sums = np.r_[np.uint64(0), np.cumsum(hashes * powers[:-1], dtype=np.uint64)]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mix((self.sums[ends] - self.sums[starts]) * self.back[starts])


def symbols(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """Recompression of concatenated texts: names, starts and ends of symbols, and of the words they depend on.

    ``first`` and ``last`` mark the first and last word of each text. What depends on the edge of a text depends on
    the word beyond it, which lies in no window.
    """
    # Runs of equal words. A symbol depends on one word to each side, which shows where its run ends.
    new = first.copy()
    new[1:] |= hashes[1:] != hashes[:-1]
    starts = np.flatnonzero(new)
    ends = np.r_[starts[1:], len(hashes)]
    names = np.where(ends - starts > 1, _mix(hashes[starts] ^ ((ends - starts).astype(np.uint64) * ODD)), hashes[starts])
    low, high = starts - 1, ends + 1
    head, tail = first[starts], last[ends - 1]
    for turn in range(rounds):
        right = (_mix(names ^ np.uint64((turn + 1) * 0x51_7CC1B727)) & np.uint64(1)).astype(bool)
        joins = ~right[:-1] & right[1:] & ~tail[:-1] & (ends[1:] - starts[:-1] <= WIDEST)
        begins, follows = np.r_[joins, False], np.r_[False, joins]
        # A symbol left alone has seen its neighbour on the side it looks to.
        sees_next, sees_before = ~right & ~begins, right & ~follows
        new_low, new_high = low.copy(), high.copy()
        some = np.flatnonzero(sees_next & ~tail)
        new_high[some] = np.maximum(high[some], high[some + 1])
        some = np.flatnonzero(sees_before & ~head)
        new_low[some] = np.minimum(low[some], low[some - 1])
        pairs = np.flatnonzero(begins)
        names = names.copy()
        names[pairs] = _mix(_mix(names[pairs]) * ODD + names[pairs + 1])
        new_high[pairs], ends[pairs], tail[pairs] = high[pairs + 1], ends[pairs + 1], tail[pairs + 1]
        stay = ~follows
        names, starts, ends, low, high, head, tail = (x[stay] for x in (names, starts, ends, new_low, new_high, head, tail))
    return names, starts, ends, low, high


def anchors(hashes: np.ndarray, sizes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Groups of neighbouring windows with one anchor, in concatenated texts of ``sizes`` words.

    Returns the anchor's name, a hash of all words of the group and the anchor's place in it, the first window's
    """
    counts = np.maximum(sizes - window + 1, 0)
    if counts.sum() == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    first, last = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    full = sizes > 0
    first[begins[full]], last[ends[full] - 1] = True, True
    names, starts, stops, low, high = symbols(hashes, first, last)
    at = np.arange(counts.sum()) + np.repeat(begins - (np.cumsum(counts) - counts), counts)
    owner = np.repeat(np.arange(len(sizes)), counts)
    # Dependencies rise with the symbols, so those inside a window are neighbours: a range minimum finds the anchor.
    below = np.r_[0, np.cumsum(np.bincount(low + 1, minlength=len(hashes) + 2))]
    upto = np.cumsum(np.bincount(high, minlength=len(hashes) + 2))
    a, b = below[at + 1], upto[at + window]
    rank = np.uint64(63) - np.minimum(stops - starts, 63).astype(np.uint64)
    key = (rank << np.uint64(58)) | ((_mix(names) >> np.uint64(6)) & ~np.uint64(0xFFFFFF))
    key |= np.arange(len(names), dtype=np.uint64)
    level, least = key, np.full(len(at), ~np.uint64(0))
    size = 1
    width = b - a
    while len(level) and size <= window:
        use = np.flatnonzero((width >= size) & (width < 2 * size))
        least[use] = np.minimum(level[a[use]], level[b[use] - size])
        if len(level) <= size:
            break
        level = np.minimum(level[:-size], level[size:])
        size *= 2
    bare = width <= 0
    chosen = np.where(bare, -1, (least & np.uint64(0xFFFFFF)).astype(np.int64))
    # Inside a run of one word each window repeats the one before.
    same = np.r_[0, np.cumsum(np.r_[False, hashes[1:] == hashes[:-1]])]
    repeats = bare & (at > begins[owner]) & (same[np.minimum(at + window, len(hashes))] - same[at] == window)
    many = 1 << (COUNT_BITS - 1)
    new = np.ones(len(at), bool)
    new[1:] = (owner[1:] != owner[:-1]) | np.where(
        repeats[1:], ~repeats[:-1] | (at[1:] % many == 0), bare[1:] | (chosen[1:] != chosen[:-1])
    )
    groups = np.flatnonzero(new)
    n = np.diff(np.r_[groups, len(at)])
    start, alone = at[groups], bare[groups]
    around = Prefixes(hashes, BASES[0]).of(start, start + window + n - 1)
    symbol = np.maximum(chosen[groups], 0)
    place = np.where(alone, 0, starts[symbol] - start if len(starts) else 0)
    around = _mix(around ^ (place.astype(np.uint64) * ODD))
    name = np.where(alone, _mix(around + ODD), names[symbol] if len(names) else np.uint64(0))
    name = np.where(name < SETTLED, name + SETTLED, name)
    name = np.where(repeats[groups], around & (SETTLED - np.uint64(1)), name)
    return name, around, start, n


def _rows(docs: DataFrame) -> DataFrame:
    """id (the smallest number for null), tie (which of the texts with this id) and text."""
    rows = text_rows(docs)
    return rows.select(
        F.coalesce("doc_id", F.lit(-(2**63))).alias("id"),
        F.xxhash64("doc_id", "text").bitwiseAND((1 << TIE_BITS) - 1).alias("tie"),
        "text",
    )


def groups(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(name, around, id, packed) for each group of windows; ``packed`` holds the start, the size and the tie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t.as_py()) for t in batch.column(2)]
            sizes = np.array([len(w) for w in words], np.int64)
            hashes = hashes_of([w for part in words for w in part])
            name, around, start, n = anchors(hashes, sizes, window)
            ends = np.cumsum(sizes)
            owner = np.searchsorted(ends, start, side="right")
            local = start - (ends - sizes)[owner]
            tie = batch.column(1).to_numpy()[owner]
            packed = (((local << COUNT_BITS) | n) << TIE_BITS) | tie
            signed = [pa.array(name.view(np.int64)), pa.array(around.view(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [*signed, pa.array(batch.column(0).to_numpy()[owner]), pa.array(packed)], ["name", "around", "id", "packed"]
            )

    return in_batches(rows, run, "name long not null, around long not null, id long not null, packed long not null")


def marks(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, tie, start, n, settled): groups of windows that are repeated, or (not settled) are to be compared one by one.

    The groups are made and dealt by name once: the same exchange gives what is known of a name, from all its
    columns, and the rows that this meets. No filter may stand before it on one side alone, so no column is nullable.
    """
    found = groups(rows, window).repartition(F.col("name"))
    settled, start = F.col("name").between(0, int(SETTLED) - 1), F.shiftrightunsigned("packed", TIE_BITS + COUNT_BITS)
    place = order_key(_doc_id(), start)
    names = found.groupBy(F.col("name").alias("name_")).agg(
        F.count("*").alias("times"), F.min(place).alias("first"), (F.min("around") < F.max("around")).alias("mixed")
    )
    names = names.where((F.col("times") > 1) | F.col("name_").between(0, int(SETTLED) - 1)).drop("times")
    hits = found.join(names.hint("shuffle_hash"), F.col("name") == F.col("name_"))
    hits = hits.select("name", "around", "id", "packed", settled.alias("settled"), "mixed", (place > F.col("first")).alias("later"))
    # The first of windows that have the same words around them stays; of settled ones all go.
    hits = keep(hits.where("settled or mixed or later"), "window-groups").df
    mixed = hits.where("mixed and not settled").withColumn("place", place)
    firsts = mixed.groupBy(F.col("name").alias("n_"), F.col("around").alias("a_")).agg(F.min("place").alias("first"))
    judged = mixed.join(firsts, (F.col("name") == F.col("n_")) & (F.col("around") == F.col("a_")))
    judged = judged.select("id", "packed", (F.col("place") > F.col("first")).alias("settled"))
    every = judged.union(hits.where("settled or not mixed").select("id", "packed", F.lit(True)))
    return every.select(
        "id",
        F.col("packed").bitwiseAND((1 << TIE_BITS) - 1).alias("tie"),
        start.alias("start"),
        F.shiftrightunsigned("packed", TIE_BITS).bitwiseAND((1 << COUNT_BITS) - 1).alias("n"),
        "settled",
    )


def _doc_id() -> F.Column:
    return F.when(F.col("id") == -(2**63), F.lit(None).cast("long")).otherwise(F.col("id"))


def _windows(marked: DataFrame, window: int) -> DataFrame:
    """(w1, w2, id, packed) for each window to compare: 128 bits of its words; ``packed`` holds the start and the tie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, tie, text, starts, sizes in zip(*(batch.column(k) for k in range(5))):
                hashes = hashes_of(words_of(text.as_py()))
                first, n = starts.values.to_numpy(), sizes.values.to_numpy()
                at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
                ends = at + window
                one, two = Prefixes(hashes, BASES[0]), Prefixes(_mix(hashes ^ ODD), BASES[1])
                values = [x.of(at, ends).view(np.int64) for x in (one, two)]
                owner = pa.array(np.full(len(at), id_.as_py()), pa.int64())
                packed = pa.array((at << TIE_BITS) | tie.as_py())
                yield pa.RecordBatch.from_arrays([*map(pa.array, values), owner, packed], ["w1", "w2", "id", "packed"])

    return in_batches(marked.select("id", "tie", "text", "starts", "sizes"), run, "w1 long not null, w2 long not null, id long not null, packed long not null")


def _again(windows: DataFrame) -> DataFrame:
    """(id2, tie2, again): the starts of the windows whose words also start earlier, as a list per document.

    As in :func:`marks`, one exchange gives the first window of some words and the windows that meet it.
    """
    dealt = windows.repartition("w1", "w2")
    start = F.shiftrightunsigned("packed", TIE_BITS)
    place = order_key(_doc_id(), start)
    firsts = dealt.groupBy(F.col("w1").alias("w1_"), F.col("w2").alias("w2_"))
    firsts = firsts.agg(F.min(place).alias("first"), F.max(place).alias("last")).where("last > first")
    met = dealt.join(firsts.hint("shuffle_hash"), (F.col("w1") == F.col("w1_")) & (F.col("w2") == F.col("w2_")))
    # The optimiser would check a bare comparison for nulls, on this side and before the exchange.
    met = met.where(F.coalesce(place > F.col("first"), F.lit(False)))
    tie = F.col("packed").bitwiseAND((1 << TIE_BITS) - 1)
    return met.groupBy(F.col("id").alias("id2"), tie.alias("tie2")).agg(F.collect_set(start).alias("again"))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, text: str = "kept_text") -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by spaces, per document.

    A word goes if it is covered by a window of ``window`` consecutive words of its document whose words also
    start earlier: in a document with a smaller id, or earlier in the same one. All windows are judged on the
    input. Words are runs without white space of ASCII, unchanged; a null text has none; a null id is smaller
    than all others. Rows that repeat an id do not count as earlier than each other at the same place.
    """
    rows = _rows(docs)
    # The lists are bounded by the words of a document.
    of_doc = marks(rows, window).groupBy(F.col("id").alias("id_"), F.col("tie").alias("tie_"))
    entry = F.struct("start", "n", "settled")
    lists = keep(of_doc.agg(F.collect_set(entry).alias("found")), "marks").df
    done, compare = F.filter("found", lambda e: e["settled"]), F.filter("found", lambda e: ~e["settled"])
    lists = lists.select(
        "id_", "tie_", done["start"].alias("done"), done["n"].alias("done_n"),
        compare["start"].alias("starts"), compare["n"].alias("sizes"),
    )
    mine = (F.col("id") == F.col("id_")) & (F.col("tie") == F.col("tie_"))
    again = _again(_windows(rows.join(lists.where(F.size("starts") > 0), mine), window))
    joined = rows.join(lists.select("id_", "tie_", "done", "done_n"), mine, "left")
    joined = joined.join(again, (F.col("id") == F.col("id2")) & (F.col("tie") == F.col("tie2")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for value, done, done_n, more in zip(*(batch.column(k) for k in range(1, 5))):
                words = words_of(value.as_py())
                edge = np.zeros(len(words) + 1, np.int64)
                if done.is_valid and len(done):
                    first, n = done.values.to_numpy(), done_n.values.to_numpy()
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + n - 1 + window, -1)
                if more.is_valid and len(more):
                    first = more.values.to_numpy()
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                total.append(len(words))
                removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if removed[-1] else b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", text],
            )

    given = joined.select(_doc_id().alias("doc_id"), "text", "done", "done_n", "again")
    return in_batches(given, run, f"doc_id long, n_words long, n_removed long, `{text}` string")
