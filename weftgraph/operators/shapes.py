"""Query shapes over a property graph (G1 to G27) and their registry.

A shape takes (graph, spec) and returns a DataFrame: a logical plan, so predicates on
keys reach the scan and Catalyst picks the joins. Every limit has a total order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import entity_mention
from weftgraph.plans.graph import PropertyGraph

LIMIT, LIMIT_MAX, HOPS_MAX = 20, 50, 4


@dataclass(frozen=True)
class Spec:
    """Slots of a question: what the planner of a client fills in."""

    shape: str
    label: str = ""
    mention: str = ""
    target_label: str = ""
    target: str = ""
    relation: str = ""
    role: str = ""
    hops: int = 2
    limit: int = LIMIT
    workspace: str = ""
    types: tuple[str, ...] = ()
    years: tuple[int, ...] = ()
    metric: tuple[str, ...] = ()


Shape = Callable[[PropertyGraph, Spec], DataFrame]
SHAPES: dict[str, Shape] = {}


def shape(name: str) -> Callable[[Shape], Shape]:
    def add(f: Shape) -> Shape:
        SHAPES[name] = f
        return f

    return add


def run(graph: PropertyGraph, spec: Spec) -> DataFrame:
    """The shape's plan on the tenant's graph; an unknown shape means neighbours."""
    own = replace(spec, limit=max(1, min(spec.limit, LIMIT_MAX)), hops=max(1, min(spec.hops, HOPS_MAX)))
    return SHAPES.get(spec.shape, SHAPES["neighbors"])(graph.for_workspace(spec.workspace), own)


# predicates


def text_anchor(mention: str, *cols: str) -> Column:
    """The name or another column contains the mention, as said or tidied."""
    if not mention:
        return F.lit(True)  # P4
    hay = F.lower(F.coalesce(*[F.col(c) for c in cols], F.lit("")))
    return hay.contains(mention.lower()) | hay.contains(F.lower(entity_mention(F.lit(mention))))


def anchor(nodes: DataFrame, mention: str) -> Column:
    """One word that fits a typed key is an equality, which is pushed to the scan;
    anything else is a text anchor. Where nodes have a key, ``Label:key`` means the key,
    so the id, which may be computed, need not be."""
    if not mention:
        return F.lit(True)
    word = mention.strip().split(":")[-1]
    tests = []
    if " " not in mention.strip():
        keyed = "key" in nodes.columns
        if keyed and word.lstrip("-").isdigit():
            tests.append(F.col("key") == int(word))
        if not keyed:
            tests.append(F.col("id") == mention)
        tests.append(F.col("name") == mention)
    return reduce(Column.__or__, tests) if tests else text_anchor(mention, "name", "id")


def anchor_in(nodes: DataFrame, mention: str) -> Column:
    """Membership of the words between commas or blanks; those that don't fit a key
    are only tried as names."""
    words = [w for w in mention.replace(",", " ").split() if w]
    numbers = [int(w) for w in words if w.isdigit()]
    named = F.col("name").isin(words) | F.col("id").isin(words)
    return named | F.col("key").isin(numbers) if numbers and "key" in nodes.columns else named


def display(*extra: str) -> Column:
    """Name, else other columns, else the id."""
    return F.coalesce("name", *extra, "id")


def oriented(edges: DataFrame, role: str) -> DataFrame:
    """Edges with the anchor's end and the other, keeping their true direction. Either
    way, a loop comes once."""
    out = edges.withColumn("anchor", F.col("src")).withColumn("other", F.col("dst"))
    back = edges.withColumn("anchor", F.col("dst")).withColumn("other", F.col("src"))
    if role == "source":
        return out
    return back if role == "target" else out.unionByName(back.where("src <> dst"))


# shapes


@shape("entity_lookup")
def entity_lookup(g: PropertyGraph, s: Spec) -> DataFrame:
    """G1"""
    n = g.active().nodes[s.label]
    return n.where(anchor(n, s.mention)).orderBy("id").limit(s.limit)


@shape("entity_contains")
def entity_contains(g: PropertyGraph, s: Spec) -> DataFrame:
    """G1 with P1"""
    return g.active().nodes[s.label].where(text_anchor(s.mention, "name", "id")).orderBy("id").limit(s.limit)


@shape("relationship_lookup")
def relationship_lookup(g: PropertyGraph, s: Spec) -> DataFrame:
    """The anchored edges of a type; source and target as the edge has them."""
    t = g.ontology.relations[s.relation]
    role = s.role or ("source" if g.ontology.conforms(s.label, t.source) else "target" if g.ontology.conforms(s.label, t.target) else "either")
    n = g.active().nodes[s.label]
    hit = n.where(anchor(n, s.mention)).select(F.col("id").alias("anchor"))
    e = oriented(g.edges[s.relation], role).join(hit, "anchor", "left_semi")
    other = g.labelled(s.target_label) if s.target_label else g.all_nodes()
    found = e.join(other.select(F.col("id").alias("other"), F.col("label").alias("other_label"), F.col("name").alias("other_name")), "other")
    return found.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit(s.relation).alias("relation"), "other_label", "other_name").distinct().orderBy("source", "target").limit(s.limit)


@shape("neighbors")
def neighbors(g: PropertyGraph, s: Spec) -> DataFrame:
    """Distinct neighbours over one declared type; G4 without one."""
    if not s.relation:
        return neighbors_collected(g, s)
    n = g.active().nodes[s.label]
    hit = n.where(anchor(n, s.mention)).select(F.col("id").alias("anchor"))
    e = oriented(g.edges[s.relation], s.role or "either").join(hit, "anchor", "left_semi").select("other").distinct()
    return e.join(g.all_nodes(), F.col("other") == F.col("id")).select(display().alias("neighbor"), "label").distinct().orderBy("neighbor", "label").limit(s.limit)


@shape("neighbors_collected")
def neighbors_collected(g: PropertyGraph, s: Spec) -> DataFrame:
    """Each anchor with its first neighbours over any edge; none is an empty list.
    Ranks cut the list before it is collected."""
    n = g.active().nodes[s.label]
    hit = n.where(anchor(n, s.mention)).select("id", "name").orderBy("id").limit(s.limit)
    e = oriented(g.all_edges(), "either").select("anchor", "other", "type").distinct().join(hit.select(F.col("id").alias("anchor")), "anchor", "left_semi")
    near = e.join(g.all_nodes().select(F.col("id").alias("other"), F.col("name").alias("neighbor"), "label"), "other")
    top = near.withColumn("r", F.row_number().over(Window.partitionBy("anchor").orderBy("type", "neighbor", "label"))).where(F.col("r") <= s.limit)
    lists = top.groupBy("anchor").agg(F.sort_array(F.collect_list(F.concat_ws("|", "type", "neighbor", "label"))).alias("near"))
    return hit.join(lists, F.col("id") == F.col("anchor"), "left").select("id", "name", F.array_join(F.coalesce("near", F.array().cast("array<string>")), ";").alias("neighbors"))


@shape("path")
def path(g: PropertyGraph, s: Spec) -> DataFrame:
    """Shortest path between two bound ends, or the paths from one, of at most
    ``hops``. The schema may prove that there is none, narrow the types and settle the
    direction. No edge repeats on a path; the first level that reaches the target ends
    the search."""
    types = list(s.types) or g.ontology.connecting(s.label, s.target_label, s.hops)
    spark = g.nodes[s.label].sparkSession
    schema = "start string, end string, hops int, nodes string, types string"
    if not g.ontology.reachable(s.label, s.target_label, s.hops, types):
        return spark.createDataFrame([], schema)
    role = "source" if g.ontology.directed_path(s.label, s.target_label, s.hops, types) else "either"
    own = [g.edges[t].select("src", "dst").distinct().withColumn("type", F.lit(t)) for t in types if t in g.edges]
    e = oriented(reduce(DataFrame.unionByName, own), role).select("anchor", "other", "type", F.concat_ws(">", "src", "type", "dst").alias("edge"))
    a, b = g.nodes[s.label], g.labelled(s.target_label)
    now = a.where(anchor(a, s.mention)).select(F.col("id").alias("start"), F.col("id").alias("end"), F.array("id").alias("nodes"), F.array().cast("array<string>").alias("types"), F.array().cast("array<string>").alias("used"))
    goal = b.where(text_anchor(s.target, "name", "id")).select(F.col("id").alias("end"))
    levels = []
    for h in range(1, s.hops + 1):
        step = now.join(e, now["end"] == e["anchor"]).where(~F.array_contains("used", F.col("edge")))
        now = step.select("start", F.col("other").alias("end"), F.concat("nodes", F.array("other")).alias("nodes"), F.concat("types", F.array("type")).alias("types"), F.concat("used", F.array("edge")).alias("used"))
        levels.append(now.join(goal, "end", "left_semi").select("start", "end", F.lit(h).alias("hops"), F.array_join("nodes", ",").alias("nodes"), F.array_join("types", ",").alias("types")))
    found = reduce(DataFrame.unionByName, levels)
    if s.mention and s.target:
        found = found.withColumn("best", F.min("hops").over(Window.partitionBy("start", "end"))).where("hops = best").drop("best")
    return found.orderBy("hops", "nodes", "types").limit(s.limit)


@shape("count")
def count(g: PropertyGraph, s: Spec) -> DataFrame:
    """Distinct counterparties of an anchor, in-degree by default; G9 without one."""
    if not s.mention:
        return g.nodes[s.label].agg(F.count(F.lit(1)).alias("n"))
    n = g.active().nodes[s.label]
    hit = n.where(anchor(n, s.mention)).select(F.col("id").alias("anchor"))
    e = oriented(g.edges[s.relation], s.role or "target").join(hit, "anchor", "left_semi")
    return e.agg(F.countDistinct("other").alias("n"))


@shape("list_all")
def list_all(g: PropertyGraph, s: Spec) -> DataFrame:
    """Distinct targets of several anchors over a type; G11 without anchors."""
    if not s.mention:
        return g.nodes[s.label].select(display().alias("name"), F.lit(s.label).alias("label")).orderBy("name").limit(s.limit)
    n = g.active().nodes[s.label]
    hit = n.where(anchor_in(n, s.mention)).select(F.col("id").alias("anchor"))
    e = oriented(g.edges[s.relation], s.role or "source").join(hit, "anchor", "left_semi").select("other").distinct()
    return e.join(g.all_nodes(), F.col("other") == F.col("id")).select(display().alias("name"), "label").distinct().orderBy("name", "label").limit(s.limit)


def metric_lookup(facts: DataFrame, company: str, years: tuple[int, ...], aliases: tuple[str, ...], limit: int) -> DataFrame:
    """Facts (company, ticker, metric, year, value) of a company by part of its name or
    its ticker; aliases only rank, and with none of them every row ranks alike."""
    own = facts.where(text_anchor(company, "company") | (F.lower("ticker") == company.lower()))
    own = own.where(F.col("year").isin(list(years))) if years else own
    hit = F.lit(0) if not aliases else F.when(reduce(Column.__or__, [F.lower("metric").contains(a.lower()) for a in aliases]), 0).otherwise(1)
    return own.where("value is not null").withColumn("rank", hit).orderBy("rank", "company", "year", "metric").limit(limit)


def metric_delta(facts: DataFrame, first: int, last: int) -> DataFrame:
    """Change of each company's metric between two years."""
    at = lambda y: F.max(F.when(F.col("year") == y, F.col("value")))
    both = facts.where(F.col("year").isin(first, last)).groupBy("company", "metric").agg(at(first).alias("first"), at(last).alias("last"))
    return both.where("first is not null and last is not null").withColumn("delta", F.round(F.col("last") - F.col("first"), 2)).withColumn("percent", F.round(F.expr("try_divide(100 * (last - first), abs(first))"), 4))


def observation_lookup(obs: DataFrame, entity: str, concept: str, periods: list[str], basis: str) -> DataFrame:
    """Exact keys, in order of period."""
    return obs.where((F.col("entity") == entity) & (F.col("concept") == concept) & F.col("period").isin(periods) & (F.col("basis") == basis)).orderBy("period")


def optional_chain(start: DataFrame, *hops: tuple[DataFrame, Column]) -> DataFrame:
    """Optional matches from one start: left joins, nulls where nothing is."""
    return reduce(lambda df, h: df.join(h[0], h[1], "left"), hops, start)


def label_distribution(g: PropertyGraph, k: int = 10) -> DataFrame:
    """G18, G20"""
    return g.all_nodes().groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(k)


def resource_match(rows: DataFrame, labels: list[str], text: str, keys: list[str], k: int) -> DataFrame:
    """Resources by label or by having a uri, any of whose keys contains a text."""
    said = reduce(Column.__or__, [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(text.lower()) for c in keys])
    return rows.where((F.arrays_overlap("labels", F.array(*[F.lit(x) for x in labels])) | F.col("uri").isNotNull()) & said).orderBy(keys[0]).limit(k)


def bounded_counts(g: PropertyGraph, cap: int) -> DataFrame:
    """Count of each label up to a cap, and whether the cap was met. The cap is the
    feature; the scan stops there."""
    own = [v.limit(cap).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("label"), "n") for k, v in sorted(g.nodes.items())]
    return reduce(DataFrame.unionByName, own).withColumn("sampled", F.col("n") >= cap)


def truncated_expansion(edges: DataFrame, start: DataFrame, hops: int, per_hop: int) -> DataFrame:
    """Hop by hop, only the latest ``per_hop`` edges are followed."""
    now = start.select("node").distinct()
    for _ in range(hops):
        e = edges.join(now.withColumnRenamed("node", "src"), "src", "left_semi").orderBy(F.desc("ts"), "src", "dst").limit(per_hop)
        now = e.select(F.col("dst").alias("node")).distinct()
    return now


def event_chain(events: DataFrame, key: str, value, k: int) -> DataFrame:
    """One key's events in order of sequence."""
    return events.where(F.col(key) == value).orderBy("sequence").limit(k)


def rank_fusion(lists: DataFrame, weights: dict[str, float] | None = None, k: int = 60, least: float = 0.1) -> DataFrame:
    """Reciprocal-rank fusion of rows (backend, id, rank). Backends of a weight
    under ``least`` are left out."""
    weights = weights or {}
    w = F.lit(1.0)
    for name, x in weights.items():
        w = F.when(F.col("backend") == name, F.lit(float(x))).otherwise(w)
    own = lists.withColumn("w", w).where(F.col("w") >= least)
    return own.groupBy("id").agg(F.sum(F.col("w") / (k + F.col("rank"))).alias("score"))


def multi_plan(g: PropertyGraph, specs: list[Spec], name: str) -> DataFrame:
    """Up to four shapes from the same slots, fused by rank of their column ``name``."""
    own = []
    for i, s in enumerate(specs[:4]):
        rows = run(g, s).select(F.col(name).alias("id"))
        own.append(rows.withColumn("rank", F.row_number().over(Window.orderBy("id"))).withColumn("backend", F.lit(str(i))))  # at most LIMIT_MAX rows
    return rank_fusion(reduce(DataFrame.unionByName, own))
