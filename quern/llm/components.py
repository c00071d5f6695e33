"""Connected components of an edge table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import staged


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """From undirected edges (a, b) the rows (node, label): label is the smallest node of the component.

    Each round points every node to the smallest of its neighbours (Kiveris et al. 2014); the work is joins
    and grouped minima on narrow rows, combined map-side, so a hub costs no more than its edges. Every round
    is written to the shared folder. Self-loops keep a node without other edges; nulls aren't allowed.
    """
    stars = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), narrow=True)
    before = None
    for _ in range(rounds):
        both = stars.union(stars.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a or b = m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        stars = staged(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), narrow=True)
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return stars.groupBy("a").agg(F.min("b").alias("label")).union(stars.where("a > b").groupBy("b").agg(F.min("b"))).toDF("node", "label").groupBy("node").agg(F.min("label").alias("label"))
