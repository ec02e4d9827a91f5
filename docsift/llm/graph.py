"""Connected components of a link table, by alternating stars over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import cut, cut_narrow, join_per_key

MAX_ROUNDS = 60


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every node ties its larger neighbours to the least of its neighbours and itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("uses")).select("a", F.least("a", "m").alias("m"), "uses")
    tied = join_per_key(both.where("b > a"), least, "a", 2 * total, F.xxhash64("b"))
    return tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Every node and its smaller neighbours are tied to the least of them. Edges come as a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("uses"))
    tied = join_per_key(edges, least, "a", total, F.xxhash64("b")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node, root the least of its component. links: columns a and b, of any ordered type.

    Minima combine on the map side, and a node with very many links is split over tasks. Rounds grow with the logarithm
    of the longest path. Self-links, repeated links and an empty table are allowed; links with a null end are not links.
    The result is cut.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    edges = cut(links.where("a <> b").select(high.alias("a"), low.alias("b")).distinct())
    seen = None
    for _ in range(MAX_ROUNDS):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        edges = cut_narrow(_small_star(_large_star(edges, state[0]), state[0]), state[0])
    else:
        raise RuntimeError("components did not settle")
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
    return cut_narrow(found, 2 * state[0])  # a root has a member
