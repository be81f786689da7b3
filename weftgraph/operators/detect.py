"""Financial-crime detectors over typed edge tables.

All of them filter and project before they join, aggregate by owner or account, and
take their bounds as arguments. Edges need src, dst, and the columns named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .analytics import triangles

DAY = 86_400


def small_leg_owners(edges: DataFrame, owner: str, leg_max: float, total_min: float, parties_min: int, legs_min: int, party: str = "src") -> DataFrame:
    """Owners of many legs under ``leg_max`` that add up to more than ``total_min`` from
    at least ``parties_min`` parties. Larger legs are ignored, not held against them."""
    legs = edges.where(F.col("amount") <= leg_max).groupBy(F.col(owner).alias("owner"))
    found = legs.agg(F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("total"), F.countDistinct(party).alias("parties"), F.count(F.lit(1)).alias("legs"))
    return found.where((F.col("total") > total_min) & (F.col("parties") >= parties_min) & (F.col("legs") >= legs_min))


def capped(edges: DataFrame, degree_max: int) -> DataFrame:
    """Edges whose source has at most ``degree_max`` of them: the stated bound that
    keeps a motif join from hubs."""
    few = edges.groupBy("src").agg(F.count(F.lit(1)).alias("__d")).where(F.col("__d") <= degree_max).select("src")
    return edges.join(few, "src", "left_semi")


def rings(edges: DataFrame, degree_max: int | None = None, extra: Column | None = None) -> DataFrame:
    """Directed 3-cycles a -> b -> c -> a, each once, a the least, over all edges.

    Without conditions on single edges, triangles are closed from their node of least
    degree, so a hub costs its edges and not their square. ``extra`` may test the columns
    of the three edges, named e1, e2 and e3; ``degree_max`` is the stated bound on a
    source's edges that D2 may be given. Rows that differ only in their edges are one
    ring."""
    e = capped(edges, degree_max) if degree_max is not None else edges
    if extra is None:
        return _cycles(e)
    one, two, three = e.alias("e1"), e.alias("e2"), e.alias("e3")
    up = one.where("e1.src < e1.dst").join(two, F.col("e1.dst") == F.col("e2.src")).where("e2.dst > e1.src and e2.dst <> e2.src")
    closed = up.join(three, (F.col("e2.dst") == F.col("e3.src")) & (F.col("e3.dst") == F.col("e1.src")))
    return closed.where(extra).select(F.col("e1.src").alias("a"), F.col("e1.dst").alias("b"), F.col("e2.dst").alias("c")).distinct()


def _cycles(edges: DataFrame) -> DataFrame:
    ways = F.bit_or(F.when(F.col("src") < F.col("dst"), 1).otherwise(2))
    pairs = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(ways.alias("w"))
    t = triangles(pairs)
    # u the apex, v < w the others; the ways of each side: 1 with, 2 against
    with_, against = lambda c: F.col(c).bitwiseAND(1) != 0, lambda c: F.col(c).bitwiseAND(2) != 0
    found = F.array(F.when(with_("uv") & with_("vw") & against("uw"), F.array("u", "v", "w")), F.when(with_("uw") & against("vw") & against("uv"), F.array("u", "w", "v")))
    r = t.select(F.explode(F.filter(found, lambda c: c.isNotNull())).alias("r"))
    first = F.array_position("r", F.array_min("r")).cast("int") - 1
    at = lambda i: F.get("r", (first + i) % 3)
    return r.select(at(0).alias("a"), at(1).alias("b"), at(2).alias("c"))


def funnels(inflow: DataFrame, outflow: DataFrame, senders_min: int, slack: int, share: float) -> DataFrame:
    """Accounts with at least ``senders_min`` senders whose first outflow is later than
    the last inflow less ``slack`` seconds and whose largest outflow is at least
    ``share`` of what was collected."""
    i = inflow.groupBy(F.col("dst").alias("account")).agg(F.countDistinct("src").alias("senders"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("collected"), F.max("ts").alias("last_in")).where(F.col("senders") >= senders_min)
    o = outflow.groupBy(F.col("src").alias("account")).agg(F.max("amount").alias("largest_out"), F.min("ts").alias("first_out"))
    return i.join(o, "account").where((F.col("first_out") >= F.col("last_in") - slack) & (F.col("largest_out") >= share * F.col("collected"))).select("account", "senders", "collected", "largest_out")


def chains(*hops: tuple[DataFrame, Column]) -> DataFrame:
    """Entities at the end of a chain of edge tables; each hop after the first gives its
    table and the condition that links it to those before. No order in time."""
    out = hops[0][0]
    for step, on in hops[1:]:
        out = out.join(step, on)
    return out


def either_way(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs (a, b) that a link joins in one direction or the other: an OR of two
    equi-joins, as one on the ordered pair."""
    ends = links.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct()
    return pairs.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b")).join(ends, ["lo", "hi"], "left_semi").drop("lo", "hi")


def followed_within(events: DataFrame, key: str, first: str, second: str, seconds: int) -> DataFrame:
    """Events of kind ``second`` at most ``seconds`` after the latest earlier event of
    kind ``first`` of the same key: an as-of join by one window."""
    w = Window.partitionBy(key).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    seen = events.withColumn("before", F.last(F.when(F.col("kind") == first, F.col("ts")), ignorenulls=True).over(w))
    return seen.where((F.col("kind") == second) & (F.col("ts") - F.col("before") <= seconds)).select(key, "id", (F.col("ts") - F.col("before")).alias("lag"))


def structuring(payments: DataFrame, key: str, days: int, under: float, count_min: int) -> DataFrame:
    """Keys with at least ``count_min`` payments under a threshold inside some window of
    ``days`` days, with the largest such count."""
    w = Window.partitionBy(key).orderBy("ts").rangeBetween(-(days * DAY - 1), 0)
    near = payments.where(F.col("amount") < under).withColumn("n", F.count(F.lit(1)).over(w))
    return near.groupBy(key).agg(F.max("n").alias("most")).where(F.col("most") >= count_min)


def monotone_pairs(first: DataFrame, second: DataFrame, seconds: int) -> DataFrame:
    """Two-hop paths a -> m -> b whose second edge follows the first within ``seconds``,
    counted by (a, b)."""
    on = (F.col("f.dst") == F.col("s.src")) & (F.col("s.ts") > F.col("f.ts")) & (F.col("s.ts") <= F.col("f.ts") + seconds)
    return first.alias("f").join(second.alias("s"), on).groupBy(F.col("f.src").alias("a"), F.col("s.dst").alias("b")).agg(F.count(F.lit(1)).alias("paths"))


def precision_recall(found: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """One row: hits, found, truth, precision and recall; a rate without a denominator
    is null."""
    f = found.select(key).distinct().withColumn("f", F.lit(1))
    t = truth.select(key).distinct().withColumn("t", F.lit(1))
    n = f.join(t, key, "full_outer").agg(F.count(F.when((F.col("f") == 1) & (F.col("t") == 1), 1)).alias("hits"), F.count("f").alias("found"), F.count("t").alias("truth"))
    return n.select("hits", "found", "truth", F.expr("try_divide(hits, found)").alias("precision"), F.expr("try_divide(hits, truth)").alias("recall"))
