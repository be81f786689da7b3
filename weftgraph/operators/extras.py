"""Smaller operators: centrality, projections, module selection, scorecards, pointers
(N18, P9, P12, R27, R37, W24, E9, E11, X28, X39, S5, S9)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import cut

def betweenness(edges: DataFrame, k: int, directed: bool = False) -> DataFrame:
    """The k nodes of greatest betweenness on shortest paths, exact, from every
    source. Nothing is gathered: counts of paths spread level by level, shares flow back
    the same way; the state has a row for each pair of nodes with a path, which bounds the
    graphs that this is for."""
    e = edges.where("src <> dst").select(F.col("src").alias("v"), F.col("dst").alias("w")).distinct()
    e = cut(e if directed else e.unionByName(e.select(F.col("w").alias("v"), F.col("v").alias("w"))).distinct())
    start = e.select(F.explode(F.array("v", "w")).alias("s")).distinct()
    layers = [cut(start.select("s", F.col("s").alias("v"), F.lit(1.0).alias("paths")))]
    seen = layers[0].select("s", "v")
    while True:
        step = layers[-1].join(e, "v").groupBy("s", F.col("w").alias("v")).agg(F.sum("paths").alias("paths"))
        new = cut(step.join(seen, ["s", "v"], "left_anti"))
        if new.isEmpty():
            break
        layers.append(new)
        seen = seen.unionByName(new.select("s", "v"))
    share = layers[-1].select("s", "v", "paths", F.lit(0.0).alias("share"))
    total = None
    for upper in reversed(layers[1:-1]):
        lower = share.select("s", F.col("v").alias("w"), F.col("paths").alias("under"), "share")
        flow = upper.join(e, "v").join(lower, ["s", "w"]).groupBy("s", "v").agg(F.sum(F.col("paths") / F.col("under") * (1 + F.col("share"))).alias("share"))
        share = cut(upper.join(flow, ["s", "v"], "left").select("s", "v", "paths", F.coalesce("share", F.lit(0.0)).alias("share")))
        part = share.groupBy(F.col("v").alias("node")).agg(F.sum("share").alias("share"))
        total = part if total is None else total.unionByName(part)
    nodes = start.select(F.col("s").alias("node"), F.lit(0.0).alias("share"))
    total = nodes if total is None else total.unionByName(nodes)
    score = F.round(F.sum("share") / (1 if directed else 2), 6)
    return total.groupBy("node").agg(score.alias("score")).orderBy(F.desc("score"), "node").limit(k)


def path_properties(cols: list[str], identity: list[str], cap: int = 12) -> list[str]:
    """The columns of a path's nodes: identity first, at most ``cap``."""
    return list(dict.fromkeys([c for c in identity if c in cols] + cols))[:cap]


def identity_candidates(question: str, kinds: dict[str, str]) -> dict[str, list[str]]:
    """Words of a question that could be values of declared keys, by key."""
    words = re.findall(r"[\w:.-]+", question)
    fits = {"INTEGER": lambda w: w.lstrip("-").isdigit(), "FLOAT": lambda w: bool(re.fullmatch(r"-?\d+(\.\d+)?", w))}
    return {k: [w for w in words if fits.get(t, lambda w: any(c.isdigit() for c in w) or w[:1].isupper())(w)] for k, t in kinds.items()}


def identity_words(question: Column, kind: str) -> Column:
    """P12, as a column: the words of a question that could be values of a key of a type."""
    fits = {"INTEGER": r"^-?[0-9]+$", "FLOAT": r"^-?[0-9]+(\.[0-9]+)?$"}.get(kind, r"[0-9]|^[A-Z]")
    return F.filter(F.regexp_extract_all(question, F.lit(r"([\w:.-]+)"), 1), lambda w: w.rlike(fits))


def learning_score(found: DataFrame, gold: DataFrame) -> DataFrame:
    """Task, precision, recall and F1 of rows (task, item); a task without gold has
    nulls, not zeros."""
    f, g = found.distinct().withColumn("f", F.lit(1)), gold.distinct().withColumn("g", F.lit(1))
    n = f.join(g, ["task", "item"], "full_outer").groupBy("task").agg(F.count("f").alias("nf"), F.count("g").alias("ng"), F.count_if((F.col("f") == 1) & (F.col("g") == 1)).alias("hit"))
    known = F.col("ng") > 0
    return n.select("task", F.when(known, F.round(F.expr("try_divide(hit, nf)"), 4)).alias("precision"), F.when(known, F.round(F.expr("try_divide(hit, ng)"), 4)).alias("recall"), F.when(known, F.round(F.expr("try_divide(2 * hit, nf + ng)"), 4)).alias("f1"))


def select_modules(modules: DataFrame, depends: dict[str, list[str]], question: str, k: int) -> DataFrame:
    """The k modules (name, terms) that a question's words fit best, by hits / (hits +
    2), with all that they depend on."""
    from weftgraph.functions.text import tokens

    asked = F.array(*[F.lit(w) for w in sorted(set(re.findall(r"[a-z0-9]+", question.lower())))])
    hits = F.size(F.array_intersect(tokens("terms"), asked))
    best = modules.select("name", F.round(hits / (hits + 2), 4).alias("score")).where("score > 0").orderBy(F.desc("score"), "name").limit(k)
    closed: dict[str, set[str]] = {}
    for m in depends:  # the catalogue's own dependencies, on the driver
        seen, queue = set(), [m]
        while queue:
            x = queue.pop()
            if x not in seen:
                seen.add(x)
                queue += depends.get(x, [])
        closed[m] = seen
    need = modules.sparkSession.createDataFrame([(m, d) for m, ds in closed.items() for d in sorted(ds)] or [("", "")], "name string, module string")
    out = best.join(F.broadcast(need), "name", "left").select(F.coalesce("module", "name").alias("module"), F.when(F.coalesce("module", "name") == F.col("name"), F.col("score")).alias("score"))
    return out.groupBy("module").agg(F.max("score").alias("score"))


def canonical_snapshot(nodes: DataFrame, edges: DataFrame, to: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with merged entities (rows id, canonical) as one; loops that merging
    makes go."""
    m = to.select("id", "canonical")
    n = nodes.join(m, "id", "left").select(F.coalesce("canonical", "id").alias("id"), "label").groupBy("id").agg(F.min("label").alias("label"))
    e = edges.join(m.toDF("src", "cs"), "src", "left").join(m.toDF("dst", "cd"), "dst", "left").select(F.coalesce("cs", "src").alias("src"), F.coalesce("cd", "dst").alias("dst"), "type")
    return n, e.where("src <> dst").distinct()


def utility_scorecard(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Each run's weighted mean of the metrics that it has."""
    w = F.lit(0.0)
    for k, x in weights.items():
        w = F.when(F.col("metric") == k, F.lit(float(x))).otherwise(w)
    own = rows.withColumn("w", w).where("w > 0 and value is not null")
    return own.groupBy("run").agg(F.round(F.sum((F.col("w") * F.col("value")).cast("decimal(18,6)")).cast("double") / F.sum("w"), 6).alias("utility"), F.countDistinct("metric").alias("metrics"))


def diagnosis(rows: DataFrame) -> DataFrame:
    """By category, questions, share correct, and how often each cause of failure."""
    total = rows.groupBy("category").agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"))
    cause = rows.where("not correct").groupBy("category", "cause").agg(F.count(F.lit(1)).alias("c")).groupBy("category").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "cause", F.col("c").cast("string")))), ",").alias("causes"))
    return total.join(cause, "category", "left").select("category", "questions", "accuracy", F.coalesce("causes", F.lit("")).alias("causes"))


@dataclass(frozen=True)
class Pointer:
    """Which snapshot is active. ``swap`` takes the expected state and a fence; a
    stale one changes nothing."""

    target: str
    generation: int = 0
    fence: int = 0

    def swap(self, expected: int, fence: int, target: str) -> tuple[Pointer, bool]:
        if expected != self.generation or fence < self.fence:
            return self, False
        return Pointer(target, self.generation + 1, fence), True


def swapped(swaps: DataFrame) -> DataFrame:
    """X28 over a log of swaps (ordinal, fence, target), each expecting what stands: target,
    fence and generation at its end. A swap counts if no earlier one had a newer fence."""
    newest = F.max("fence").over(Window.orderBy(F.col("part")).rowsBetween(Window.unboundedPreceding, -1))
    dealt = cut(swaps.repartitionByRange("ordinal").withColumn("part", F.spark_partition_id()))
    tops = dealt.groupBy("part").agg(F.max("fence").alias("fence")).select("part", F.coalesce(newest, F.lit(0)).alias("before"))  # a row a partition
    inner = F.max("fence").over(Window.partitionBy("part").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1))
    done = dealt.withColumn("inner", inner).join(tops, "part").where(F.col("fence") >= F.greatest(F.coalesce("inner", F.lit(0)), "before"))
    return done.agg(F.max_by("target", "ordinal").alias("target"), F.max_by("fence", "ordinal").alias("fence"), F.count(F.lit(1)).cast("int").alias("generation"))


def questions(spark: SparkSession, paths: dict[str, str], per_type: int) -> DataFrame:
    """Question files by type, the first of each type in order of id."""
    from functools import reduce

    parts = [spark.read.json(p).select(F.col("id").cast("string").alias("id"), "question", F.lit(t).alias("type")) for t, p in sorted(paths.items())]
    own = reduce(DataFrame.unionByName, parts)
    return own.withColumn("r", F.row_number().over(Window.partitionBy("type").orderBy("id"))).where(F.col("r") <= per_type).drop("r")


def fetched(spark: SparkSession, pages: int, fetch: Callable[[int], list[dict]], schema: str) -> DataFrame:
    """A paged source: each page is fetched by the task that has its number, so pages
    are fetched again where an executor is lost."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for p in df["id"].tolist():
                rows = fetch(int(p))
                if rows:
                    yield pd.DataFrame(rows)

    return spark.range(pages).repartition(max(1, min(pages, 64)), "id").mapInPandas(run, schema)


def read_pdf(spark: SparkSession, path: str, extract: Callable[[bytes], str], files: str = "*.pdf") -> DataFrame:
    """The text of PDF files by an extractor that the caller brings."""

    def text(content):
        return content.map(lambda b: extract(bytes(b)))

    text.__annotations__ = {"content": pd.Series, "return": pd.Series}
    found = spark.read.format("binaryFile").option("pathGlobFilter", files).option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("id"), F.pandas_udf(text, "string")("content").alias("content"))


