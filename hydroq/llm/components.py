"""Connected components by alternating large and small stars."""

from pyspark.sql import functions as F

from hydroq.llm.common import stage


def _mark(edges):
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("s"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1_000_003))).alias("t")).first()
    return tuple(row)


def components(edges):
    """(node, root) for every node of ``edges`` (a, b: long); the root is the smallest node reachable.

    Each round points every node at the smallest one it knows; a node with very many neighbours is a
    partial minimum and one skew-splittable join, never a gathered list. Rounds are written to the shared
    folder, so a lost executor repeats one round at most; about log(n) rounds are needed.
    No edges: no rows. Loops and repeated edges change nothing.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = stage(edges, "edges"), None
    while (now := _mark(edges)) != before:
        before = now
        if not now[0]:
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        least = stage(least, "least")  # two plain inputs: a join that can split a node with very many neighbours
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = stage(large, "edges")
        low = stage(large.groupBy("a").agg(F.min("b").alias("low")), "least")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").union(low.select("a", F.col("low").alias("b")))
        edges = stage(small.distinct(), "edges")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
