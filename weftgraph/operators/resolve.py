"""Writes, deduplication and entity resolution.

Nodes to write: id, label, workspace, props map<string,string>, source, ts, ordinal. All
keys are (label, id, workspace), so equal ids of two tenants never meet."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import identity_segment, name_key

from .analytics import components

KEY = ["label", "id", "workspace"]
def N():  # noqa: N802
    return F.count(F.lit(1))



def upsert_nodes(writes: DataFrame) -> DataFrame:
    """Last writer wins by property: of the writes of a property the one of
    the latest ts, of equal ones the later arrival; properties that a write does not name
    stay. Sources add up whoever wins."""
    long = writes.select(*KEY, "ts", "ordinal", F.explode_outer("props").alias("k", "v"))
    best = long.where("k is not null").groupBy(*KEY, "k").agg(F.max_by("v", F.struct("ts", "ordinal")).alias("v"))
    props = best.groupBy(*KEY).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("props"))
    head = writes.groupBy(*KEY).agg(F.max("ts").alias("ts"), F.sort_array(F.collect_set("source")).alias("sources"))
    return head.join(props, KEY, "left")


def merge_conflicts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Properties whose stored value differs from the incoming one: key, prop, before,
    after. Names with an underscore in front are bookkeeping."""
    a = stored.select(*KEY, F.explode("props").alias("prop", "before"))
    b = incoming.select(*KEY, F.explode("props").alias("prop", "after"))
    return a.join(b, [*KEY, "prop"]).where("before is not null and after is not null and before <> after and prop <> 'id' and substring(prop, 1, 1) <> '_'")


def upsert_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One edge for each (src, type, dst) whose ends both exist in its workspace."""
    ids = nodes.select("id", "workspace").distinct()
    ok = edges.join(ids.withColumnRenamed("id", "src"), ["src", "workspace"], "left_semi").join(ids.withColumnRenamed("id", "dst"), ["dst", "workspace"], "left_semi")
    return ok.groupBy("src", "type", "dst", "workspace").agg(F.max_by("props", F.struct("ts", "ordinal")).alias("props"))


def orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that have no node at one end."""
    ids = nodes.select("id").distinct()
    no_src = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti")
    no_dst = edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return no_src.unionByName(no_dst).distinct()


def delete_by_source(nodes: DataFrame, source: str) -> DataFrame:
    """Nodes (with sources) after a source is withdrawn: those that only it gave go."""
    out = nodes.withColumn("sources", F.array_remove("sources", source))
    return out.where(F.size("sources") > 0)


def count_by_source(nodes: DataFrame) -> DataFrame:
    """W7"""
    return nodes.select(F.explode("sources").alias("source")).groupBy("source").agg(N().alias("n"))


def reindex(nodes: DataFrame, source: str, fresh: DataFrame) -> DataFrame:
    """Withdraw a source and write its new nodes."""
    return delete_by_source(nodes, source).unionByName(fresh, allowMissingColumns=True)


def exact_duplicates(docs: DataFrame, hashed: Column, key: str) -> DataFrame:
    """The row of the least key for each content hash."""
    return docs.withColumn("hash", hashed).groupBy("hash").agg(F.min(key).alias(key), N().alias("copies"))


def cross_chunk(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of one label and exact name become the first of them, later values
    winning; nameless ones stay; edges follow. Nodes have id, label, name, ordinal."""
    w = Window.partitionBy("label", "name").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    to = F.when(F.col("name").isNull() | (F.col("name") == ""), F.col("id")).otherwise(F.first("id").over(w))
    m = nodes.select("id", to.alias("to"))
    kept = nodes.join(m.select(F.col("to").alias("id")).distinct(), "id", "left_semi")
    e = edges.join(m.toDF("src", "s"), "src", "left").join(m.toDF("dst", "d"), "dst", "left")
    return kept, e.select(F.coalesce("s", "src").alias("src"), F.coalesce("d", "dst").alias("dst"), "type").distinct()


def identity_key(label: Column, *parts: Column) -> Column:
    """Label and segments joined by pipes; null if all segments are blank."""
    segments = [identity_segment(p) for p in parts]
    blank = reduce(Column.__and__, [s == "" for s in segments])
    return F.when(~blank, F.concat_ws("|", label, *segments))


def cross_source_id(name: Column) -> Column:
    """The id of an entity that is one across sources."""
    return F.concat(F.lit("~xs|"), identity_segment(name))


def intern(seen: DataFrame) -> DataFrame:
    """Rows (workspace, identity, canonical, seq): the first writer's canonical."""
    return seen.where("identity is not null").groupBy("workspace", "identity").agg(F.min_by("canonical", "seq").alias("canonical"))


def aliases(names: DataFrame) -> DataFrame:
    """Each normalised name's canonical, empty if several have it, and the least of
    them, to which they may be reconciled."""
    g = names.groupBy("name").agg(F.collect_set("canonical").alias("c"))
    return g.select("name", F.when(F.size("c") == 1, F.col("c")[0]).otherwise("").alias("canonical"), F.array_min("c").alias("reconciled"), F.size("c").alias("candidates"))


def candidate_pairs(proxies: DataFrame) -> DataFrame:
    """Pairs of proxies (id, name) by equal name key (1.0) or by one name's words
    beginning the other's (0.9), as links of representatives: equal names are a class, each
    member linked to the one of least id; classes meet through those. Every link is there,
    directly or through them, in rows that grow with the proxies. Each name meets its own
    beginnings by equality."""
    p = proxies.select("id", name_key("name").alias("k")).where("k <> ''")
    first = p.groupBy("k").agg(F.min("id").alias("first"))
    same = p.join(first, "k").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score"))
    words = F.split("k", " ")
    begins = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))
    longer = first.where(F.size(words) > 1).select(F.col("first").alias("other"), F.explode(begins).alias("k"))
    near = longer.join(first, "k").select(F.least("first", "other").alias("a"), F.greatest("first", "other").alias("b"), F.lit(0.9).alias("score"))
    return same.unionByName(near.distinct())


def clusters(pairs: DataFrame, apart: DataFrame) -> DataFrame:
    """Components of pairs less those that are known to be apart."""
    return components(pairs.join(apart, ["a", "b"], "left_anti").select(F.col("a").alias("src"), F.col("b").alias("dst")))


#: Vectors of a label that are compared in one piece with as many others.
VECTORS = 1024


def embedding_duplicates(vectors: DataFrame, block: str, threshold: float) -> DataFrame:
    """Pairs a < b of one block whose unit vectors (id, v) have an inner product of at
    least ``threshold``. The canonical of a group is its least id: unlike a greedy pass,
    this does not depend on the order of arrival.

    A block's vectors are dealt to pieces of ``VECTORS``, and pairs of pieces are compared
    as matrices, each in a task row of bounded size: no pair is a row unless it is close."""
    sizes = vectors.groupBy(block).agg(F.ceil(N() / VECTORS).cast("int").alias("pieces"))
    dealt = vectors.join(sizes, block).withColumn("own", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    sides = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda c: F.struct(F.least("own", c).alias("i"), F.greatest("own", c).alias("j")))
    pairs = dealt.select(block, "id", "v", "own", F.inline(sides)).groupBy(block, "i", "j").agg(F.collect_list(F.struct("id", "own", "v")).alias("m"))

    def run(batches):
        for batch in batches:
            for i, j, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids, own, v = (members.values.field(k) for k in range(3))
                ids, own = ids.to_numpy(), own.to_numpy()
                x = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
                left, right = (np.flatnonzero(own == i), np.flatnonzero(own == j))
                dots = x[left] @ x[right].T
                p, q = np.nonzero((dots >= threshold) & ((ids[left][:, None] < ids[right][None, :]) | (i != j)))
                a, b = ids[left[p]], ids[right[q]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(dots[p, q])], ["a", "b", "similarity"])

    return pairs.select("i", "j", "m").mapInArrow(run, "a long, b long, similarity double")


def relatedness(overlap: Column, candidates: Column, cosine: Column, lexical: Column) -> Column:
    """Why a document is related to what is known; all are while nothing is known."""
    return F.when(candidates == 0, "bootstrap").when(overlap / candidates >= 0.5, "overlap").when(cosine >= 0.72, "embedding").when(lexical >= 0.2, "lexical").otherwise("unrelated")


def survivorship(facts: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Facts (key, source, raw, value, percent, digits): key, sources, survivor
    and status of each key. One vote a source, its value of most digits; in order of value,
    those that agree with the one before within the tolerance are one group; a strict
    majority of two or more sources wins, and in it the value of most digits."""
    best = Window.partitionBy("key", "source").orderBy(F.desc("digits"), "raw")
    one = facts.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")
    by_value = Window.partitionBy("key", "percent").orderBy("value", "source")
    before = F.lag("value").over(by_value)
    apart = before.isNull() | (F.abs(F.col("value") - before) > tolerance * F.greatest(F.abs(F.col("value")), F.abs(before)))
    own = one.withColumn("new", apart.cast("int")).withColumn("group", F.sum("new").over(by_value.rowsBetween(Window.unboundedPreceding, 0)))
    groups = own.groupBy("key", "percent", "group").agg(N().alias("size"), F.min_by("raw", F.struct(-F.col("digits"), F.col("raw"))).alias("raw"))
    keys = groups.groupBy("key").agg(F.sum("size").alias("sources"), F.max_by(F.struct("size", "raw"), F.struct("size", "raw")).alias("top"))
    single = F.col("sources") == 1
    won = (F.col("top.size") >= 2) & (2 * F.col("top.size") > F.col("sources"))
    return keys.select("key", "sources", F.when(single | won, F.col("top.raw")).alias("survivor"), F.when(single, "single").when(won, "survived").otherwise("quarantine").alias("status"))


def federated(parts: dict[str, DataFrame]) -> DataFrame:
    """One table of several departments', each row tagged with its own."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [v.withColumn("dept", F.lit(k)) for k, v in sorted(parts.items())])


def qualify(text: Column, graph: Column, llm: Column) -> Column:
    """Merge, review or separate by the mean of the scores that there are."""
    scores = F.filter(F.array(text, graph, llm), lambda x: x.isNotNull())
    mean = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(scores), F.lit(1))
    return F.when(mean >= 0.85, "merge").when(mean >= 0.5, "review").otherwise("separate")


def conflicting_slots(rows: DataFrame) -> DataFrame:
    """Slots for which evidence (slot, value) disagrees."""
    return rows.groupBy("slot").agg(F.countDistinct("value").alias("values")).where("values > 1")


def coalition(required: set[str], offers: list[tuple[str, int, set[str]]]) -> tuple[list[str], set[str]]:
    """Sources chosen greedily by what they add, then priority and name, and what
    no one covers."""
    chosen, missing, left = [], set(required), list(offers)
    while missing and left:
        best = max(left, key=lambda o: (len(missing & o[2]), o[1], [-ord(c) for c in o[0]]))
        if not missing & best[2]:
            break
        chosen.append(best[0])
        missing -= best[2]
        left.remove(best)
    return chosen, missing


def changed_files(now: DataFrame, tracked: DataFrame) -> DataFrame:
    """Files (path, hash) that are new or have new content."""
    return now.join(tracked, ["path", "hash"], "left_anti")
