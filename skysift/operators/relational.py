"""Set, duplicate and sample operators that stay spread when one key holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S


def keep_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key: the first by ``order_by``, nulls first.

    An aggregate instead of a window: every task first reduces its own rows, so a key that
    holds a third of the table sends one row per task and not its whole group. Rows equal
    in ``order_by`` are told apart by their remaining columns; maps, which have no order, by their sorted entries.
    """
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    maps = {f.name for f in df.schema.fields if isinstance(f.dataType, T.MapType)}

    def ordered(name: str) -> Column:
        column = F.col(f"`{name}`")
        return F.array_sort(F.map_entries(column)).alias(name) if name in maps else column

    def restored(name: str) -> Column:
        column = F.col(f"first.`{name}`")
        return (F.map_from_entries(column) if name in maps else column).alias(name)

    first = F.min(F.struct(*[ordered(c) for c in [*order_by, *rest]])).alias("first")
    picked = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(first)
    return picked.select(*[F.col(f"`{c}`") if c in keys else restored(c) for c in df.columns])


def common_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids present on both sides."""
    return left.select(key).intersect(right.select(key))


def only_left_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids of the left side that the right side lacks."""
    return left.select(key).subtract(right.select(key))


def rows_with_id(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``ids``; order and multiplicity of the rows are kept."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def rows_without_id(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key does not occur in ``ids``."""
    return df.join(ids.select(key).distinct(), key, "left_anti")


def exact_sample(df: DataFrame, n: int, keys: Sequence[str], seed: int = 79) -> DataFrame:
    """Exactly n rows (all, if there are fewer), repeatable for the same keys and seed."""
    columns = [F.col(f"`{k}`") for k in keys]
    ranked = df.withColumn("__rank", S.sampling_key(columns, seed))
    return ranked.orderBy("__rank", *columns).limit(n).drop("__rank")


def head(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The first n rows in a stated order."""
    return df.orderBy(*[F.col(f"`{c}`") for c in order_by]).limit(n)
