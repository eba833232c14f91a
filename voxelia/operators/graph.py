"""Connected components of a graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from voxelia.store import dealt, drop, kept


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (a, b) between different nodes; component is the smallest node reached.

    Each round has two steps. In the first every node links its larger neighbours to the smallest node around
    it, in the second it links itself and its smaller neighbours to the smallest of these. Links only ever move
    towards smaller nodes, so chains shorten by a factor a round and hubs keep one link a node. Rounds are written to
    the shared folder and end once the set of links stays as it is. Null ends and links from a node to itself don't count.
    """
    now, mark = noted(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        if mark[0] == 0:
            break
        following, after = noted(to_smaller(to_larger(now)))
        drop(now)
        now, mark, before = following, after, mark
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def to_larger(links: DataFrame) -> DataFrame:
    around = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return around.join(dealt(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def to_smaller(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(dealt(least), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def noted(links: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """links, kept, with their number and a hash of the set, both taken while writing."""
    seen = Observation()
    out = kept(links.observe(seen, F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")), "links")
    return out, (seen.get["n"], seen.get["x"])
