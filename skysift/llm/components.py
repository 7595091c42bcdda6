"""Connected components of a link table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.llm.common import keep


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least node of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def _clean(edges: DataFrame) -> DataFrame:
    """Each link once, the larger node first."""
    return (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """The least node reachable from each node of a link table.

    ``links`` has two columns of one orderable type; the result has (node, least) for every node of a
    link that is not itself the least of its component. Nodes without links do not appear. Every round
    works on the links left over, is one shuffle wide, and writes them to the shared folder. A round
    keeps hot nodes apart by a minimum per node, reduced before the shuffle, and a join that can be split.
    """
    a, b = links.columns
    now = keep(_clean(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")), "links")
    state = None
    while True:
        after = keep(_clean(_small_star(_clean(_large_star(now.df)))), "links")
        now.drop()
        # Stars are a fixed point: the rows then stay as they are.
        row = after.df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        now, state, before = after, tuple(row), state
        if state == before:
            return now.df.select(F.col("a").alias("node"), F.col("b").alias("least"))
