"""Connected components of a distributed edge list, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_of_order, reliable

def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of an edge list (a, b): root is the smallest node that can be reached.

    Edges may repeat, in any direction; loops don't matter; null ends are left out.  Each round maps every node's
    neighbours to the smallest of them, first those above it, then those below; the rounds end when the edges are a star
    around each root.  Every round but the last puts some node under a smaller one, so they do end, after about the
    logarithm of the longest chain, in the worst case its square.  What a round needs of a node is one
    minimum, aggregated within tasks first, and a node with very many edges is split by the skew join.  Each round's
    edges are written to the shared checkpoint folder, so a lost executor repeats one round at most.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = reliable(e)
    before = None
    while True:
        # large star: neighbours above a node go to the smallest neighbour
        both = e.union(e.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = free_of_order(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: neighbours below a node, and itself, go to the smallest of them
        low = free_of_order(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m"))
        joined = large.join(low, F.col("a") == F.col("n"))
        star = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        e = reliable(star)
        now = e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("count(distinct a)")).first()
        # each node once, and no root is a node below another: a star forest doesn't change any more
        if tuple(now) == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())
        before = tuple(now)
