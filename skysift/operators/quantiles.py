"""Exact quantiles and order statistics that never bring a whole column into one task.

The wanted ranks are enclosed by open intervals. A sketch proposes cut values around each
rank, one scan counts the values below and at every cut, and each rank is then either at a
cut or in the gap between two. The counts are exact, so a poor sketch costs another scan but
never a wrong value. Every step is one scan, however many columns there are, and all sizes take the
same way: sketches are plain aggregates of the columns, and values are placed between the cuts
by binary search in batches of columns, so rows are never turned into cells.
Repeated values end up at a cut and are found by their count, so a value held by a third
of the rows does no harm. A gap with few values is sorted inside one aggregate buffer.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S

# An interval with no more values than this is sorted at once.
FINAL = 5_000
# Size of a sketch, how far (as a share) its proposals are asked left and right of a rank, and sketches of one aggregate.
SKETCH_SIZE, MARGIN, SKETCHES = 4096, 0.004, 200
# Fractions asked of the sketch are rounded to this many digits, so that columns of nearly equal size share them.
FRACTION_DIGITS = 7

Number = float | int


class Found(NamedTuple):
    """A value, how many values are smaller, and how many are not larger."""

    value: Number
    under: int
    upto: int


@dataclass
class _Gap:
    """An open interval of one expression: how many values lie up to it and in it, and the ranks in it."""

    name: str
    expr: Column
    size: int
    below: int = 0
    low: Number | None = None
    high: Number | None = None
    ranks: list[int] = field(default_factory=list)

    def inside(self) -> Column:
        """The expression where it lies in the gap, else null."""
        tests = [self.expr > F.lit(self.low)] if self.low is not None else []
        tests += [self.expr < F.lit(self.high)] if self.high is not None else []
        if not tests:
            return self.expr
        return F.when(tests[0] & tests[-1], self.expr)

    def cut_fractions(self) -> list[float]:
        """Fractions of the gap slightly left and right of every rank in it."""
        margin = MARGIN
        spots = [(r - self.below) / max(self.size - 1, 1) for r in self.ranks]
        return sorted({round(min(1.0, max(0.0, s + d)), FRACTION_DIGITS) for s in spots for d in (-margin, margin)})

    def split(self, cuts: Sequence[Number], under: Sequence[int], upto: Sequence[int]) -> tuple[dict, list[_Gap]]:
        """Values found at a cut, and the smaller gaps of the other ranks.

        ``under`` and ``upto`` count the values of the whole column below, and not above, each cut.
        """
        found, gaps = {}, {}
        for r in self.ranks:
            at = bisect_right(under, r) - 1
            if at >= 0 and r < upto[at]:
                found[self.name, r] = Found(cuts[at], under[at], upto[at])
                continue
            if at not in gaps:
                below = upto[at] if at >= 0 else self.below
                end = under[at + 1] if at + 1 < len(cuts) else self.below + self.size
                gaps[at] = _Gap(
                    self.name, self.expr, end - below, below,
                    cuts[at] if at >= 0 else self.low, cuts[at + 1] if at + 1 < len(cuts) else self.high,
                )
            gaps[at].ranks.append(r)
        return found, list(gaps.values())


def _columns(df: DataFrame, gaps: Sequence[_Gap]) -> tuple[DataFrame, list[int]]:
    """The expressions of some gaps as columns of doubles, each once, and the column of each gap."""
    places: dict[str, int] = {}
    exprs = []
    for g in gaps:
        if g.name not in places:
            places[g.name] = len(exprs)
            exprs.append(g.expr.cast("double").alias(f"v{len(exprs)}"))
    return df.select(*exprs), [places[g.name] for g in gaps]


def _usable(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The values of every column, without nulls."""
    return [c.drop_null().to_numpy(zero_copy_only=False) for c in batch.columns]


def _sketch(df: DataFrame, gaps: Sequence[_Gap]) -> list[list[Number]]:
    """Cut values of each gap, ascending: one sketch a gap, in one plain aggregate."""
    cuts = []
    for begin in range(0, len(gaps), SKETCHES):
        some = gaps[begin : begin + SKETCHES]
        data, places = _columns(df, some)
        inner = [replace(g, expr=F.col(f"v{i}")) for g, i in zip(some, places)]
        sketches = data.agg(*[F.kll_sketch_agg_double(g.inside(), F.lit(SKETCH_SIZE)).alias(f"s{i}") for i, g in enumerate(inner)])
        asked = [F.array(*map(F.lit, g.cut_fractions())) for g in some]
        row = sketches.select(*[F.kll_sketch_get_quantile_double(f"s{i}", q) for i, q in enumerate(asked)]).first()
        cuts += [sorted(set(values)) for values in row]
    return cuts


def _count(df: DataFrame, gaps: Sequence[_Gap], cuts: Sequence[Sequence[Number]]) -> list[tuple[list[int], list[int]]]:
    """Values below, and not above, each cut: a binary search of each value, counted batch by batch in each task."""
    data, places = _columns(df, gaps)
    known = [np.array(values, float) for values in cuts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(2 * len(values) + 1, np.int64) for values in known]
        for batch in batches:
            columns = _usable(batch)
            for total, values, place in zip(sums, known, places):
                # 2k below cut k and above the one before, 2k + 1 at cut k.
                spots = np.searchsorted(values, columns[place], "left") + np.searchsorted(values, columns[place], "right")
                total += np.bincount(spots, minlength=len(total))
        for i, total in enumerate(sums):
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), pa.array(at), pa.array(total[at])], ["gap", "place", "n"])

    counted = data.mapInArrow(run, "gap long, place long, n long").groupBy("gap", "place").agg(F.sum("n").alias("n"))
    seen = [np.zeros(2 * len(values) + 1, np.int64) for values in cuts]
    for gap, place, n in counted.collect():
        seen[gap][place] = n
    upto = [np.cumsum(total).tolist() for total in seen]
    return [(total[0:-1:2], total[1::2]) for total in upto]


def _finish(df: DataFrame, gaps: Sequence[_Gap]) -> dict[tuple[str, int], Found]:
    """Ranks of small gaps, from their sorted values."""
    data, places = _columns(df, gaps)
    bounds = [(-math.inf if g.low is None else g.low, math.inf if g.high is None else g.high) for g in gaps]
    # Open ends include infinite values.
    ends = [(g.low is None, g.high is None) for g in gaps]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = _usable(batch)
            for i, (place, (low, high), (first, last)) in enumerate(zip(places, bounds, ends)):
                x = columns[place]
                x = x[((x > low) | first) & ((x < high) | last)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i)), pa.array(x, pa.float64())], ["gap", "value"])

    sorted_values = data.mapInArrow(run, "gap long, value double").groupBy("gap").agg(F.sort_array(F.collect_list("value")).alias("values"))
    spots = F.array(*[F.array(*[F.lit(r - g.below) for r in g.ranks]) for g in gaps])

    def pick(spot: Column) -> Column:
        value = F.get("values", spot)
        copies = F.size(F.filter("values", lambda x: x == value))
        return F.struct(value.alias("v"), (F.array_position("values", value) - 1).alias("f"), copies.alias("n"))

    result = {}
    for gap, picks in sorted_values.select("gap", F.transform(F.get(spots, F.col("gap").cast("int")), pick)).collect():
        g = gaps[gap]
        for r, (value, first, copies) in zip(g.ranks, picks):
            result[g.name, r] = Found(value, g.below + first, g.below + first + copies)
    return result


def _whole(df: DataFrame, wanted: Mapping[str, tuple[Column, int, Sequence[int]]]) -> set[str]:
    """Names whose expression is a whole number."""
    schema = df.select(*[expr.alias(f"v{i}") for i, (expr, _, _) in enumerate(wanted.values())]).schema
    return {name for name, f in zip(wanted, schema.fields) if isinstance(f.dataType, T.IntegralType)}


def values_at_ranks(
    df: DataFrame,
    wanted: Mapping[str, tuple[Column, int, Sequence[int]]],
    final: int = FINAL,
    guesses: Mapping[str, Sequence[Number]] | None = None,
) -> dict[tuple[str, int], Found]:
    """Values at 0-based ranks of the sorted non-null values.

    ``wanted`` maps a name to (expression, number of non-null values, ranks). Whole numbers
    must be exact as double, because the sketch is. ``guesses`` are cut values to try
    before the first sketch. The driver only sees a few numbers per rank.
    """
    todo = []
    for name, (expr, size, ranks) in wanted.items():
        bad = [r for r in ranks if not 0 <= r < size]
        if bad:
            raise ValueError(f"ranks {bad} of {name} are outside its {size} values")
        if ranks:
            todo.append(_Gap(name, expr, size, ranks=sorted(set(ranks))))
    result: dict[tuple[str, int], Found] = {}
    guesses = dict(guesses or {})
    while todo:
        small, large, todo = [g for g in todo if g.size <= final], [g for g in todo if g.size > final], []
        if small:
            result.update(_finish(df, small))
        unknown = [g for g in large if g.name not in guesses]
        sketched = iter(_sketch(df, unknown) if unknown else [])
        cuts = [sorted(set(guesses[g.name])) if g.name in guesses else next(sketched) for g in large]
        for gap, values, counts in zip(large, cuts, _count(df, large, cuts) if large else []):
            found, rest = gap.split(values, *counts)
            if gap.name not in guesses and any(g.size >= gap.size for g in rest):
                raise RuntimeError(f"no value of {gap.name} between {gap.low} and {gap.high} was proposed")
            result.update(found)
            todo.extend(rest)
        guesses = {}
    whole = _whole(df, wanted)
    return {key: found._replace(value=int(found.value)) if key[0] in whole else found for key, found in result.items()}


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    fractions: Sequence[float],
    counts: Mapping[str, int] | None = None,
    final: int = FINAL,
) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation of every column; nulls and NaN are ignored.

    ``counts`` (usable values per column) saves one scan where they are known already.
    """
    if not columns:
        return {}
    data = df.select(*[S.valid_double(F.col(f"`{c}`")).alias(f"x{i}") for i, c in enumerate(columns)])
    if counts is None:
        seen = data.agg(*[F.count(c) for c in data.columns]).first()
        counts = dict(zip(columns, seen))
    wanted = {}
    for i, c in enumerate(columns):
        spots = [f * (counts[c] - 1) for f in fractions] if counts[c] else []
        wanted[c] = (F.col(f"x{i}"), counts[c], [r for s in spots for r in (math.floor(s), math.ceil(s))])
    at_ranks = {key: found.value for key, found in values_at_ranks(data, wanted, final).items()}
    return {
        c: [_interpolate(at_ranks, c, f * (counts[c] - 1)) if counts[c] else None for f in fractions] for c in columns
    }


def _interpolate(found: Mapping[tuple[str, int], float], name: str, spot: float) -> float:
    low, high = found[name, math.floor(spot)], found[name, math.ceil(spot)]
    return low if low == high else low + (spot - math.floor(spot)) * (high - low)
