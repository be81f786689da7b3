"""Graph analytics on edge tables with src and dst.

Edges are reduced to distinct pairs before any self-join; hubs cost what their
aggregates cost, unless a motif itself needs the pairs of their neighbours, for which
there is a stated ``degree_max``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut, discard, written


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct pairs a < b, without loops."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair (a, b) as (n, m) from either end."""
    return pairs.select(F.inline(F.array(F.struct(F.col("a").alias("n"), F.col("b").alias("m")), F.struct(F.col("b").alias("n"), F.col("a").alias("m")))))


def degrees(edges: DataFrame) -> DataFrame:
    """node, outdeg, indeg, degree of every node that has an edge, in one aggregation."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    return ends.groupBy("node").agg(F.sum("o").alias("outdeg"), F.sum("i").alias("indeg"), F.count(F.lit(1)).alias("degree"))


def top_degrees(edges: DataFrame, k: int) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "node").limit(k)


def quantile(c: str, p: float) -> Column:
    """The p-quantile of a column of counts: one of them."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c})").cast("long")


def hub_tiers(edges: DataFrame, p: float = 0.99) -> DataFrame:
    """node, degree, tier: 2 from the p-quantile of degrees, 1 from the median, else 0."""
    d = degrees(edges).select("node", "degree")
    cuts = d.agg(quantile("degree", p).alias("hi"), quantile("degree", 0.5).alias("mid"))  # one row
    return d.join(F.broadcast(cuts)).select("node", "degree", F.when(F.col("degree") >= F.col("hi"), 2).when(F.col("degree") >= F.col("mid"), 1).otherwise(0).alias("tier"))


def degree_hint(edges: DataFrame, heavy: float = 10.0) -> DataFrame:
    """One row: median, p99 and largest out-degree, median and largest in-degree, and
    whether the largest is more than ``heavy`` times the median."""
    o = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).agg(quantile("n", 0.5).alias("out_median"), quantile("n", 0.99).alias("out_p99"), F.max("n").alias("out_max"))
    i = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).agg(quantile("n", 0.5).alias("in_median"), F.max("n").alias("in_max"))
    return o.join(F.broadcast(i)).withColumn("heavy_tailed", F.col("out_max") > heavy * F.col("out_median"))


def multiplicity(edges: DataFrame) -> DataFrame:
    """One row: edges, distinct pairs, redundancy, largest multiplicity, pairs with more
    than one edge, and the per cent of edges in such pairs."""
    m = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m"))
    many = F.col("m") > 1
    out = m.agg(F.sum("m").alias("edges"), F.count(F.lit(1)).alias("pairs"), F.max("m").alias("most"), F.count_if(many).alias("dup_pairs"), F.coalesce(F.sum(F.when(many, F.col("m"))), F.lit(0)).alias("dup_edges"))
    return out.select("edges", "pairs", (F.col("edges") - F.col("pairs")).alias("redundant"), "most", "dup_pairs", F.round(100 * F.expr("try_divide(dup_edges, edges)"), 4).alias("dup_percent"))


def degree_profile(edges: DataFrame) -> DataFrame:
    """Anchors by rank of degree: the hub, and the nodes at p99.9, p99 and the median.

    Ranks are places in the order of degree; nodes of the least id win ties. Only the
    counts of each degree meet in one task, not the nodes."""
    d = cut(degrees(edges).select("node", "degree"))
    sizes = d.groupBy("degree").agg(F.count(F.lit(1)).alias("size"))
    above = sizes.select("degree", (F.sum("size").over(Window.orderBy(F.desc("degree"))) - F.col("size")).alias("above"), F.sum("size").over(Window.partitionBy()).alias("n"))
    # only the degrees that an anchor's rank falls on are ranked within
    marks = F.array(F.lit(1), *[F.floor(F.col("n") * q) + 1 for q in (0.001, 0.01, 0.5)])
    hit = above.join(sizes, "degree").where(F.exists(marks, lambda m: (m > F.col("above")) & (m <= F.col("above") + F.col("size"))))
    near = d.join(F.broadcast(hit), "degree")  # four degrees at most
    rank = ranked_within(near, "degree", "node").select("node", "degree", (F.col("above") + F.col("r")).alias("rank"), "n")
    at = {"hub": F.lit(1), "p999": F.floor(F.col("n") * 0.001) + 1, "p99": F.floor(F.col("n") * 0.01) + 1, "median": F.floor(F.col("n") * 0.5) + 1}
    hits = F.filter(F.array(*[F.when(F.col("rank") == r, F.lit(k)) for k, r in at.items()]), lambda x: x.isNotNull())
    return rank.select("node", "degree", "rank", F.explode(hits).alias("anchor"))


def ranked_within(rows: DataFrame, key: str, by: str) -> DataFrame:
    """``r``, each row's place among those of its key by the unique ``by``: ranks within
    range partitions, and the counts of those before, so that no key is one task's."""
    dealt = cut(rows.repartitionByRange(key, by).withColumn("__part", F.spark_partition_id()))
    own = dealt.withColumn("__own", F.row_number().over(Window.partitionBy("__part", key).orderBy(by)))
    counts = dealt.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("__n"))  # a row a key and partition
    before = counts.select(key, "__part", (F.sum("__n").over(Window.partitionBy(key).orderBy("__part")) - F.col("__n")).alias("__before"))
    return own.join(before, [key, "__part"]).withColumn("r", F.col("__own") + F.col("__before")).drop("__part", "__own", "__before")


def levels(edges: DataFrame) -> DataFrame:
    """src, l1 (its edges), l2 (the out-degrees of their targets, per edge), by degree:
    no two-hop path is made."""
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("l1"))
    second = edges.join(out.select(F.col("src").alias("dst"), F.col("l1").alias("d")), "dst", "left")
    return second.groupBy("src").agg(F.count(F.lit(1)).alias("l1"), F.sum(F.coalesce("d", F.lit(0))).alias("l2"))


def cost_estimate(lv: DataFrame, hops: int) -> DataFrame:
    """l2 (l2 / l1)^(hops - 2) for every source."""
    return lv.withColumn("cost", F.col("l2") * F.pow(F.col("l2") / F.col("l1"), F.lit(hops - 2)))


def curate(lv: DataFrame, key: str, quantiles: list[float], k: int) -> DataFrame:
    """For each quantile band of ``l2``, the k sources nearest to it, and the band's
    coefficient of variation."""
    cuts = lv.agg(F.array(*[F.struct(F.lit(q).alias("band"), quantile("l2", q).alias("at")) for q in quantiles]).alias("c"))
    bands = cuts.select(F.inline("c"))  # a row a quantile
    near = lv.join(F.broadcast(bands)).withColumn("gap", F.abs(F.col("l2") - F.col("at")))
    top = near.withColumn("r", F.row_number().over(Window.partitionBy("band").orderBy("gap", key))).where(F.col("r") <= k)
    return top.withColumn("cv", F.round(F.expr("try_divide(stddev_pop(l2) OVER (PARTITION BY band), avg(l2) OVER (PARTITION BY band))"), 6)).select("band", key, "l2", "gap", "cv")


def wedges(pairs: DataFrame, degree_max: int | None) -> DataFrame:
    """Pairs a < b of neighbours of a centre, for centres of at most ``degree_max``."""
    n = both_ways(pairs)
    if degree_max is not None:
        n = n.join(n.groupBy("n").count().where(F.col("count") <= degree_max).select("n"), "n", "left_semi")
    x, y = n.select(F.col("n").alias("c"), F.col("m").alias("a")), n.select(F.col("n").alias("c"), F.col("m").alias("b"))
    return x.join(y, "c").where("a < b")


def triangles(pairs: DataFrame) -> DataFrame:
    """(u, v, w, uv, uw, vw): each triangle of the pairs (a, b, w), a < b, once; v < w.

    Pairs point from lower to higher degree, so the wedges of a node are pairs of its
    higher neighbours, of which no node has more than the square root of twice all edges.
    ``w`` has the ways of a pair, 1 for a to b and 2 for b to a; uv, uw and vw have them
    seen from their first node."""
    pairs = cut(pairs)
    d = pairs.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("d"))
    known = pairs.join(d.toDF("a", "da"), "a").join(d.toDF("b", "db"), "b")
    up = F.struct("da", "a") <= F.struct("db", "b")
    turned = F.when(F.col("w") == 3, 3).otherwise(3 - F.col("w"))
    out = known.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("x"), F.when(up, F.col("w")).otherwise(turned).alias("ux"))
    one, two = out.toDF("u", "v", "uv"), out.toDF("u", "w", "uw")
    return one.join(two, "u").where("v < w").join(pairs.toDF("v", "w", "vw"), ["v", "w"])


def clustering(edges: DataFrame, degree_max: int | None = None) -> DataFrame:
    """node, degree, triangles and the local clustering coefficient 2 t / (d (d - 1))."""
    pairs = undirected(edges)
    closed = triangles(pairs.withColumn("w", F.lit(3))).select(F.explode(F.array("u", "v", "w")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("triangles"))
    d = both_ways(pairs).groupBy(F.col("n").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    d = d.where(F.col("degree") <= degree_max) if degree_max is not None else d
    out = d.join(closed, "node", "left").na.fill(0, ["triangles"])
    return out.withColumn("coefficient", F.when(F.col("degree") > 1, 2 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0))


def neighbour_similarity(edges: DataFrame, cutoff: float, degree_max: int | None = None) -> DataFrame:
    """Pairs a < b whose sets of out-neighbours have Jaccard similarity of at least
    ``cutoff``. Targets with more than ``degree_max`` sources may be left out by choice."""
    e = edges.select("src", "dst").distinct()
    size = e.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    if degree_max is not None:
        e = e.join(e.groupBy("dst").count().where(F.col("count") <= degree_max).select("dst"), "dst", "left_semi")
    x, y = e.toDF("a", "t"), e.toDF("b", "t")
    inter = x.join(y, "t").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("inter"))
    out = inter.join(size.toDF("a", "da"), "a").join(size.toDF("b", "db"), "b")
    return out.select("a", "b", (F.col("inter") / (F.col("da") + F.col("db") - F.col("inter"))).alias("similarity")).where(F.col("similarity") >= cutoff)


def adamic_adar(edges: DataFrame, k: int, degree_max: int | None = None) -> DataFrame:
    """The k non-adjacent pairs of greatest sum of 1 / ln(degree) over common neighbours."""
    pairs = undirected(edges)
    d = both_ways(pairs).groupBy(F.col("n").alias("c")).agg(F.count(F.lit(1)).alias("d"))
    score = wedges(pairs, degree_max).join(d, "c").groupBy("a", "b").agg(F.sum(1 / F.log("d")).alias("score"))
    return score.join(pairs, ["a", "b"], "left_anti").orderBy(F.desc(F.round("score", 9)), "a", "b").limit(k)


#: A node with more than one in so many of all edges is a hub; there are at most so many.
HUBS = 256


def _least(edges: DataFrame, total: int) -> DataFrame:
    """Every edge (a, b) with m, the least of a and all b that a has. Minima are partially
    aggregated; those of hubs are broadcast, so that a hub's edges stay where they are. The
    others never are, however small: that would take them through the driver."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("a", "m"))
    hub = F.col("n") > total / HUBS
    hubs, rest = F.broadcast(least.where(hub).select("a", "m")), least.where(~hub).select("a", "m").hint("merge")
    return edges.join(hubs, "a").unionByName(edges.join(hubs, "a", "left_anti").join(rest, "a"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of weakly connected components; a component is named by its
    least node. Stars are contracted by turns: above a node, then below it, neighbours move
    to the least one. Rounds grow with the logarithm of the number of nodes (its square is
    proven), whatever the order of ids on a path. The loop ends when every node has one
    edge down or none and no node has edges both ways: then only stars are left."""
    now = written(undirected(edges).select(F.col("b").alias("a"), F.col("a").alias("b")), "edges")
    while True:
        ends = now.select(F.inline(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("b").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up")))))
        seen = ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up")).agg(F.sum("down").alias("edges"), F.max(F.col("down") + F.col("up")).alias("most")).first()
        if (seen["most"] or 0) <= 1:
            break
        both = both_ways(now).toDF("a", "b")
        large = written(_least(both, 2 * seen["edges"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        small = F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        after = written(_least(large, seen["edges"]).select(small).where("a <> b").distinct(), "edges")
        discard(now)
        discard(large)
        now = after
    roots = now.select("b").distinct().toDF("node")
    return now.toDF("node", "component").unionByName(roots.withColumn("component", F.col("node")))


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """Communities by synchronous label propagation: a node takes the commonest label of
    its neighbours and itself, the least of equally common ones."""
    nbr = cut(both_ways(undirected(edges)))
    now = nbr.select("n").distinct().withColumn("l", F.col("n"))
    for _ in range(rounds):
        heard = nbr.join(now.select(F.col("n").alias("m"), "l"), "m").select("n", "l").unionByName(now)
        votes = heard.groupBy("n", "l").agg(F.count(F.lit(1)).alias("c"))
        now = cut(votes.groupBy("n").agg(F.min_by("l", F.struct(-F.col("c"), F.col("l"))).alias("l")))
    return now.select(F.col("n").alias("node"), F.col("l").alias("community"))


def community_samples(members: DataFrame, k: int = 6) -> DataFrame:
    """community, size and its first k nodes in order: ranks, not whole lists, are kept."""
    r = members.withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy("node")))
    return r.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.sort_array(F.collect_list(F.when(F.col("r") <= k, F.col("node")))).alias("sample"))


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """node, rank after a fixed number of rounds, from 1 / n; mass of nodes without
    out-edges is dealt to all."""
    e = edges.select("src", "dst").distinct()
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    e = cut(e.join(out, "src"))
    nodes = cut(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(out.withColumnRenamed("src", "node"), "node", "left"))
    n = nodes.count()
    now = nodes.select("node", "d", F.lit(1.0 / max(1, n)).alias("rank"))
    for i in range(rounds):
        given = e.join(now.select(F.col("node").alias("src"), (F.col("rank") / F.col("d")).alias("r")), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("r").alias("r"))
        idle = now.agg(F.coalesce(F.sum(F.when(F.col("d").isNull(), F.col("rank"))), F.lit(0.0)).alias("idle"))  # one row
        now = nodes.join(given, "node", "left").join(F.broadcast(idle)).select("node", "d", ((1 - damping) / n + damping * (F.coalesce("r", F.lit(0.0)) + F.col("idle") / n)).alias("rank"))
        now = cut(now) if i % 5 == 4 else now
    return now.select("node", "rank")


def projection_bytes(nodes: int, edges: int, heap: int, share: float = 0.3) -> dict:
    """The memory that an in-memory projection would take, and whether it may be made."""
    low, high = 24 * nodes + 16 * edges, 40 * nodes + 32 * edges
    return {"bytes_min": low, "bytes_max": high, "allowed": high <= share * heap}


def reach(edges: DataFrame, start: DataFrame, hops: int, include_start: bool = False) -> DataFrame:
    """node, hops: every node within ``hops`` of the start nodes (column node) with its
    least distance. A node is expanded once. With ``include_start`` a start node that
    lies on a cycle is reached, at the cycle's length; else start nodes are left out."""
    e = cut(edges.select("src", "dst").distinct())  # whatever makes the edges runs once
    first = start.select("node").distinct()
    seen = cut(e.join(first.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct().withColumn("hops", F.lit(1)))
    frontier = seen
    for h in range(2, hops + 1):
        new = e.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = cut(new.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(h)))
        seen = seen.unionByName(frontier)
    return seen if include_start else seen.join(first, "node", "left_anti")
