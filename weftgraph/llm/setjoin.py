"""Groups of similar sets by an exact Jaccard join: what the fingerprint operator and the
near-copy stage share. DataFrame operations only.

Sets are nodes (equal sets are one). Under any one order of all tokens, two sets of
similarity NUM / DEN or more share one of the first n - ceil(similarity n) + 1 of each,
and the smaller has at least that share of the larger one's tokens. An order that puts
common tokens last keeps the lists of a token short, and changes nothing else.

Lists are not multiplied out. First every node meets one partner, the least node that it
shares a token with. What links connect needs no further comparison, so a large group of
near copies costs a row a member. What lists still hold of several groups is gathered by
group, in pairs of blocks of at most ``BLOCK`` nodes, and compared in place: no pair
becomes a row unless it is close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .components import components

#: The similarity that links, as a ratio.
NUM, DEN = 4, 5
#: Nodes that are compared in one piece with as many others.
BLOCK = 256


def prefix_length(n: int) -> int:
    """Of n tokens, how many of the first must be looked at."""
    return n - (NUM * n + DEN - 1) // DEN + 1 if n else 0


def prefix_size(n: Column) -> Column:
    """``prefix_length`` of a column."""
    return F.when(n > 0, n - F.floor((n * NUM + (DEN - 1)) / DEN) + 1).otherwise(0).cast("int")


def long_enough(n: Column, m: Column) -> Column:
    return F.least(n, m) * DEN >= F.greatest(n, m) * NUM


def token_lists(prefixes: DataFrame) -> DataFrame:
    """(tok, node, n, first) of the tokens that several nodes have; ``first`` is the least
    of them, a struct (node, n). ``prefixes``: rows (node, n, toks), repeats allowed."""
    each = prefixes.select("node", "n", F.explode("toks").alias("tok"))
    own = F.struct("node", "n")
    shared = each.groupBy("tok").agg(F.min(own).alias("first"), F.max("node").alias("last")).where("first.node < last").select("tok", "first")
    return written(each.join(shared, "tok").select("tok", "node", "n", "first").distinct(), "lists")


def partners(lists: DataFrame) -> DataFrame:
    """A pair (a, b) a node: b with the least node that begins a list of its."""
    ok = (F.col("node") != F.col("first.node")) & long_enough(F.col("n"), F.col("first.n"))
    return lists.where(ok).groupBy(F.col("node").alias("b")).agg(F.min("first.node").alias("a")).select("a", "b")


def open_lists(lists: DataFrame, links: DataFrame) -> DataFrame:
    """(tok, node, n, root, first) of the lists that ``links`` leave with several groups,
    each list beginning with the least node of its least group."""
    rooted = written(lists.join(components(links), "node", "left").select("tok", "node", "n", F.coalesce("root", "node").alias("root")), "rooted")
    open_ = rooted.groupBy("tok").agg(F.min(F.struct("root", "node", "n")).alias("first"), F.max("root").alias("last")).where("first.root < last").select("tok", "first")
    opened = written(rooted.join(open_, "tok").select("tok", "node", "n", "root", "first"), "open")
    discard(rooted)
    return opened


def strangers(opened: DataFrame) -> DataFrame:
    """A pair (a, b) a node: b with the first node of a list where that is of another
    group."""
    ok = (F.col("root") != F.col("first.root")) & long_enough(F.col("n"), F.col("first.n"))
    return opened.where(ok).groupBy("node").agg(F.min("first.node").alias("other")).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))


def blocks(opened: DataFrame, payload: DataFrame, whole: bool = True) -> DataFrame:
    """(i, j, members) of each pair of blocks of nodes that may be near: members have
    node, root, n, their block ``own``, and ``what`` of ``payload`` (node, what). Members of
    two different blocks are to be compared where i < j, all where i = j.

    The lists that begin with the same group are one: its nodes, and all that share a token
    with one of them, stand there once, however many tokens they share. The nodes of a
    root with more than a block's have blocks of their own, which do not meet each other.
    Unless ``whole``, no block meets another one."""
    each = opened.select(F.col("first.root").alias("of"), "node", "n", "root").distinct()
    groups = each.groupBy("of", "root").agg(F.count(F.lit(1)).alias("c"))
    sizes = groups.groupBy("of").agg(F.max_by("root", F.struct("c", "root")).alias("top"), F.max("c").alias("most"), F.sum("c").alias("c")).where(F.col("c") > BLOCK)
    alone = F.when(F.col("most") > BLOCK, F.col("most")).otherwise(0)
    needed = lambda c: F.ceil(c / BLOCK).cast("int")
    sizes = sizes.select("of", F.when(alone > 0, F.col("top")).alias("top"), needed(F.col("c") - alone).alias("mixed"), needed(alone).alias("tops"))
    dealt = each.join(sizes, "of", "left").withColumn("mixed", F.coalesce("mixed", F.lit(1))).withColumn("tops", F.coalesce("tops", F.lit(0)))
    at_top, hashed = F.coalesce(F.col("root") == F.col("top"), F.lit(False)), F.xxhash64(F.lit("block"), "node")
    place = F.when(at_top, F.col("mixed") + F.pmod(hashed, F.greatest("tops", F.lit(1)))).otherwise(F.pmod(hashed, F.greatest("mixed", F.lit(1))))
    if not whole:
        place = F.pmod(hashed, F.greatest(F.col("mixed") + F.col("tops"), F.lit(1)))
    dealt = dealt.withColumn("own", place.cast("int"))
    met = F.col("mixed") + F.when(at_top, 0).otherwise(F.col("tops"))
    sides = F.transform(F.sequence(F.lit(0), met - 1), lambda c: F.struct(F.least("own", c).alias("i"), F.greatest("own", c).alias("j")))
    sides = F.when(met > 0, sides) if whole else F.array(F.struct(F.col("own").alias("i"), F.col("own").alias("j")))
    member = F.struct("node", "root", "n", "own", "what").alias("member")
    return dealt.join(payload, "node").select("of", member, F.inline(sides)).groupBy("of", "i", "j").agg(F.collect_list("member").alias("members")).where(F.size("members") > 1).select("i", "j", "members")
