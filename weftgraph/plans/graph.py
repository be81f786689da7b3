"""A property graph as typed DataFrames.

Nodes of a label and edges of a type keep their own schema, so filters and projections
reach the scan. The untyped union is built only for shapes that name no label."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .demo import table, transfers
from .ontology import DEMO, Ontology


@dataclass(frozen=True)
class PropertyGraph:
    """``nodes[label]`` has id, name, workspace, superseded_by and typed properties;
    ``edges[type]`` has src, dst, workspace and typed properties. Ids are ``Label:key``."""

    ontology: Ontology
    nodes: dict[str, DataFrame]
    edges: dict[str, DataFrame]

    def for_workspace(self, workspace: str) -> PropertyGraph:
        """One tenant's rows, at both ends and on edges. An empty name means all
        tenants; rows without a tenant belong to none."""
        if not workspace:
            return self
        own = lambda t: {k: v.where(F.col("workspace") == workspace) for k, v in t.items()}
        return replace(self, nodes=own(self.nodes), edges=own(self.edges))

    def active(self) -> PropertyGraph:
        """P5: nodes that nothing has superseded."""
        return replace(self, nodes={k: v.where(F.coalesce("superseded_by", F.lit("")) == "") for k, v in self.nodes.items()})

    def labelled(self, label: str) -> DataFrame:
        """Nodes of a label and of its kinds, by what they share: id, name, label."""
        own = [x for x in sorted(self.ontology.descendants(label)) if x in self.nodes]
        return reduce(DataFrame.unionByName, [self.nodes[x].select("id", "name", F.lit(x).alias("label"), "workspace") for x in own])

    def all_nodes(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [v.select("id", "name", F.lit(k).alias("label"), "workspace") for k, v in sorted(self.nodes.items())])

    def all_edges(self, types: list[str] | None = None) -> DataFrame:
        own = [v.select("src", "dst", F.lit(k).alias("type"), "workspace") for k, v in sorted(self.edges.items()) if not types or k in types]
        return reduce(DataFrame.unionByName, own)


def key(label: str, c) -> F.Column:
    return F.concat_ws(":", F.lit(label), c.cast("string"))


def demo_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The driver tables as customers, suppliers, parts, nations and regions. A party's
    workspace is its nation modulo 3; the rest are in all workspaces' ws0."""
    null = F.lit(None).cast("string").alias("superseded_by")
    ws = lambda c: F.concat(F.lit("ws"), (F.col(c) % 3).cast("string")).alias("workspace")
    c, s, p = (table(spark, sf_dir, t) for t in ("customer", "supplier", "part"))
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    zero = F.lit("ws0").alias("workspace")
    nodes = {
        "Customer": c.select(key("Customer", F.col("c_custkey")).alias("id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), ws("c_nationkey"), null),
        "Supplier": s.select(key("Supplier", F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"), ws("s_nationkey"), null),
        "Part": p.select(key("Part", F.col("p_partkey")).alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("key"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"), zero, null),
        "Nation": n.select(key("Nation", F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"), zero, null),
        "Region": r.select(key("Region", F.col("r_regionkey")).alias("id"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("key"), zero, null),
    }
    t = transfers(spark, sf_dir)
    at = lambda df, label, k, nk: df.select(key(label, F.col(k)).alias("src"), key("Nation", F.col(nk)).alias("dst"), ws(nk))
    edges = {
        "TRANSFER": t.select(key("Customer", F.col("src")).alias("src"), key("Supplier", F.col("dst")).alias("dst"), F.lit("ws0").alias("workspace"), "amount", "ts", "channel"),
        "LOCATED_IN": at(c, "Customer", "c_custkey", "c_nationkey").unionByName(at(s, "Supplier", "s_suppkey", "s_nationkey")),
        "IN_REGION": n.select(key("Nation", F.col("n_nationkey")).alias("src"), key("Region", F.col("n_regionkey")).alias("dst"), zero),
    }
    return PropertyGraph(DEMO, nodes, edges)
