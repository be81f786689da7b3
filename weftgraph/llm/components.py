"""Connected components by alternating star contraction, edges in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, spread_join, written


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def _star(edges: DataFrame, total: int) -> DataFrame:
    """Every edge (a, b) with the least of a's neighbours and a itself. Minima are
    partially aggregated, and the edges of a hub stay dealt over all tasks."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return spread_join(edges, least, "a", "n", total, "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b of one orderable
    type): root is the least node that it reaches. Null ends and loops are ignored;
    repeated edges count once; no edges give no rows. A round is two joins on node keys;
    the number of rounds grows with the logarithm of the longest chain."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _signature(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: neighbours above a move to a's least neighbour
        large = _star(both, 2 * seen[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.distinct(), "large-star")
        # small star: lower neighbours of a, and a itself, move to the least of them
        joined = _star(large, seen[0])
        pairs = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))
        after = written(joined.select(F.inline(pairs)).where("a <> b").distinct(), "edges")
        found = _signature(after)
        discard(now)
        discard(large)
        now = after
        if found == seen:
            break
        seen = found
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
