"""Evaluation metrics, policies, costs and roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import col

def N():  # noqa: N802
    return F.count(F.lit(1))


# -- evaluation


def nearest_rank(c: str, p: float) -> Column:
    """The value at rank ceil(p n)."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c})")


def latency_summary(rows: DataFrame, key: str, value: str) -> DataFrame:
    """p50, p95, p99, mean and count by key."""
    return rows.groupBy(key).agg(nearest_rank(value, 0.5).alias("p50"), nearest_rank(value, 0.95).alias("p95"), nearest_rank(value, 0.99).alias("p99"), F.round(F.avg(value), 4).alias("mean"), N().alias("n"))


def hit_mrr(ranked: DataFrame, k: int) -> DataFrame:
    """One row over rows (query, rank, relevant): share of queries with a hit in the
    first k, and the mean reciprocal rank of the first hit (0 without one)."""
    first = ranked.groupBy("query").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    return first.agg(F.round(F.avg((F.coalesce("first", F.lit(k + 1)) <= k).cast("double")), 6).alias("hit"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def ndcg(ranked: DataFrame, k: int) -> DataFrame:
    """E5: query and NDCG@k of rows (query, rank, gain), ranks from 1; k is cut to what
    there is; a query without gains has 1."""
    w = Window.partitionBy("query").orderBy(F.desc("gain"))
    r = ranked.withColumn("ideal", F.row_number().over(w))
    cut = lambda c: F.sum(F.when(F.col(c) <= k, F.col("gain") / F.log2(F.col(c) + 1)).otherwise(0.0))
    d = r.groupBy("query").agg(cut("rank").alias("dcg"), cut("ideal").alias("best"))
    return d.select("query", F.round(F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(1.0), 6).alias("ndcg"))


def kendall(rows: DataFrame) -> DataFrame:
    """E5: query and tau-a of rows (query, item, x, y); fewer than two items give 1. A
    query's list is one array of its values, compared in place: no pair becomes a row."""
    lists = rows.groupBy("query").agg(F.collect_list(F.struct("x", "y")).alias("l"))
    after = lambda i: F.slice("l", i + 2, F.greatest(F.size("l") - i - 1, F.lit(0)))
    against = lambda p, i: F.aggregate(after(i), F.lit(0.0), lambda s, q: s + F.signum(p["x"] - q["x"]) * F.signum(p["y"] - q["y"]))
    s = F.aggregate(F.transform("l", against), F.lit(0.0), lambda a, x: a + x)
    n = F.size("l").cast("long")
    return lists.select("query", F.round(F.when(n < 2, 1.0).otherwise(s / (n * (n - 1) / 2)), 6).alias("tau"))


def triples(found: DataFrame, gold: DataFrame) -> DataFrame:
    """One row for triples (s, p, o): precision, recall, F1 and the share of gold pairs
    that were found with their direction right."""
    key = ["s", "p", "o"]
    f, g = found.select(key).distinct().withColumn("f", F.lit(1)), gold.select(key).distinct().withColumn("g", F.lit(1))
    n = f.join(g, key, "full_outer").agg(F.count_if((F.col("f") == 1) & (F.col("g") == 1)).alias("hit"), F.count("f").alias("nf"), F.count("g").alias("ng"))
    back = f.select(F.col("o").alias("s"), "p", F.col("s").alias("o")).join(g, key, "left_semi").agg(N().alias("reversed"))
    out = n.join(F.broadcast(back)).selectExpr("try_divide(hit, nf) p", "try_divide(hit, ng) r", "try_divide(hit, hit + reversed) direction")
    return out.select(F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(F.expr("try_divide(2 * p * r, p + r)"), 6).alias("f1"), F.round("direction", 6).alias("direction"))


def quorum(votes: DataFrame, least: int) -> DataFrame:
    """Each question's commonest answer, and whether enough of the voters gave it and
    no other as often."""
    c = votes.groupBy("question", "answer").agg(N().alias("n"))
    w = Window.partitionBy("question").orderBy(F.desc("n"), "answer")
    r = c.withColumn("r", F.row_number().over(w)).withColumn("second", F.lead("n").over(w))
    return r.where("r = 1").select("question", "answer", "n", ((F.col("n") >= least) & (F.col("n") > F.coalesce("second", F.lit(0)))).alias("quorum"))


def citation_agreement(cited: DataFrame) -> DataFrame:
    """Mean Jaccard of the citation sets of each pair of agents by round; rows (round,
    agent, cites). A round has a handful of agents."""
    a, b = cited.toDF("round", "a", "ca"), cited.toDF("round", "b", "cb")
    j = F.size(F.array_intersect("ca", "cb")) / F.greatest(F.size(F.array_union("ca", "cb")), F.lit(1))
    return a.join(b, "round").where("a < b").groupBy("round").agg(F.round(F.avg(j), 6).alias("jaccard"))


def answer_score(answer: Column, gold: Column) -> Column:
    """Share of gold items found in an answer; an item with pipes is any of them."""
    found = F.filter(gold, lambda g: F.exists(F.split(g, r"\|"), lambda x: F.lower(answer).contains(F.lower(F.trim(x)))))
    return F.when(F.size(gold) > 0, F.size(found) / F.size(gold))


def stagewise(rows: DataFrame) -> DataFrame:
    """Rates over those rows that reached each stage; null where none did."""
    rate = lambda of, c: F.round(F.avg(F.when(of, c.cast("double"))), 6)
    return rows.agg(rate(F.lit(True), F.col("planned")).alias("planned"), rate(F.col("planned"), F.col("executed")).alias("executed"), rate(F.col("executed"), F.col("correct")).alias("correct"))


def profile_delta(base: DataFrame, new: DataFrame, up: float = 0.02) -> DataFrame:
    """Metrics (name, value) of two profiles: promote, reject or hold."""
    d = base.withColumnRenamed("value", "before").join(new.withColumnRenamed("value", "after"), "name", "full_outer").withColumn("delta", F.round(F.col("after") - F.col("before"), 6))
    return d.withColumn("verdict", F.when(F.col("delta").isNull(), "unknown").when(F.col("delta") >= up, "promote").when(F.col("delta") <= -up, "reject").otherwise("hold"))


# -- policy


def disclose(rows: DataFrame, classes: dict[str, str], clearance: str) -> DataFrame:
    """Columns above a clearance are null; an unknown class is restricted."""
    order = {"public": 0, "internal": 1, "confidential": 2, "restricted": 3}
    own = order.get(clearance, 0)
    hide = [c for c in rows.columns if c in classes and order.get(classes[c], 3) > own]
    return rows.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in hide})


def secure(rows: DataFrame, row_ok: Column, cells: dict[str, Column], arrays: dict[str, list]) -> DataFrame:
    """Rows that may not be seen go, cells that may not are null, and array elements
    outside a list are cut."""
    out = rows.where(F.coalesce(row_ok, F.lit(False)))
    out = out.withColumns({c: F.when(ok, F.col(c)) for c, ok in cells.items()})
    only = lambda c, own: F.filter(c, lambda x: x.isin(own))
    return out.withColumns({c: only(c, own) for c, own in arrays.items()})


def granted(facts: DataFrame, grants: DataFrame, principal: str) -> DataFrame:
    """Facts of sources that a principal may see."""
    return facts.join(grants.where(F.col("principal") == principal).select("source"), "source", "left_semi")


def disposition(signals: DataFrame) -> DataFrame:
    """Each subject by its worst signal: a critical one, or a high one at hand,
    blocks; a high one nearby or a medium one asks for review; else allow. Rows (subject,
    severity, hops)."""
    near = F.col("hops") <= 1
    s = signals.groupBy("subject").agg(F.max((F.col("severity") == "critical").cast("int")).alias("c"), F.max(((F.col("severity") == "high") & near).cast("int")).alias("h"), F.max(F.col("severity").isin("high", "medium").cast("int")).alias("m"))
    return s.select("subject", F.when((F.col("c") == 1) | (F.col("h") == 1), "block").when(F.col("m") == 1, "review").otherwise("allow").alias("disposition"))


def plan_cost(plans: DataFrame, a: float = 1.0, b: float = 0.001, g: float = 5.0, d: float = 50.0) -> DataFrame:
    """A depth + b rows + g missing indexes x fan-out + d cartesian, cheapest
    first, ties by id."""
    cost = a * F.col("depth") + b * F.col("rows") + g * F.col("misses") * F.col("fanout") + d * F.col("cartesian").cast("int")
    return plans.withColumn("cost", F.round(cost, 6)).orderBy("cost", "pattern_id")


def verdict(cost: Column, bound: float, hard: float, approximable: Column) -> Column:
    """Execute, bounded, approximate or decline."""
    return F.when(cost <= bound, "execute").when(cost <= hard, "bounded").when(approximable, "approximate").otherwise("decline")


def classify(c, rules: list[tuple[str, str]], default: str) -> Column:
    """The first pattern that a text meets names its class."""
    return reduce(lambda out, r: F.when(col(c).rlike(r[0]), r[1]).otherwise(out), reversed(rules), F.lit(default))


def route_margin(scores: DataFrame, margin: float) -> DataFrame:
    """Each query's best lane, or "abstain" if its lead over the next is too small."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "lane")
    r = scores.withColumn("r", F.row_number().over(w)).withColumn("next", F.coalesce(F.lead("score").over(w), F.lit(0.0)))
    return r.where("r = 1").select("query", F.when(F.col("score") - F.col("next") >= margin, F.col("lane")).otherwise("abstain").alias("lane"))


def replica(rows: DataFrame, lag_max: float) -> DataFrame:
    """The replica of least lag within a bound."""
    return rows.where(F.col("healthy") & (F.col("lag") <= lag_max)).orderBy("lag", "name").limit(1)


# -- roll-ups


def vocabulary(rows: DataFrame) -> DataFrame:
    """Terms by lower-case canonical: union of alternatives and sources, and the
    first definition that there is."""
    return rows.groupBy(F.lower("canonical").alias("key")).agg(F.array_join(F.sort_array(F.collect_set("alt")), ",").alias("alts"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"), F.min_by("definition", F.when(F.col("definition").isNotNull(), F.col("ordinal"))).alias("definition"))


def owners(rows: DataFrame) -> DataFrame:
    """Concepts that more than one profile owns."""
    return rows.groupBy("concept").agg(F.countDistinct("profile").alias("profiles")).where("profiles > 1")


def match_rank(offers: DataFrame, have: list[str], kind: str) -> DataFrame:
    """Capabilities whose kind fits and whose inputs are all there, by overlap
    and priority, ties by name."""
    own = F.array(*[F.lit(x) for x in have])
    ok = offers.where((F.col("kind") == kind) & (F.size(F.array_except("inputs", own)) == 0))
    return ok.withColumn("score", F.size(F.array_intersect("inputs", own)) + F.col("priority")).orderBy(F.desc("score"), "name")


def evidence_bundle(rows: DataFrame, required: list[str]) -> DataFrame:
    """For each subject of rows (subject, slot) the required slots that are covered
    and missing, in order of name; what is missing is what a retry asks for."""
    own = rows.groupBy("subject").agg(F.collect_set(F.when(F.col("slot").isin(required), F.col("slot"))).alias("found"))
    need = F.array(*[F.lit(r) for r in sorted(required)])
    return own.select("subject", F.array_intersect(need, "found").alias("covered"), F.array_except(need, "found").alias("missing"), (F.size(F.array_except(need, "found")) == 0).alias("complete"))


def artifact_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys added, removed and changed between two keyed maps (key, value)."""
    j = a.withColumnRenamed("value", "old").join(b.withColumnRenamed("value", "new"), "key", "full_outer")
    return j.where(~F.col("old").eqNullSafe(F.col("new"))).select("key", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("change"))


def sweep(spark, axes: dict[str, list]) -> DataFrame:
    """Every combination of a few short axes of parameters."""
    frames = [spark.createDataFrame([(v,) for v in vs], [k]) for k, vs in axes.items()]
    return reduce(lambda x, y: x.join(F.broadcast(y)), frames)  # as many rows as combinations


def leaderboard(rows: DataFrame, metric: str, k: int) -> DataFrame:
    """Runs by mean metric, best first."""
    return rows.groupBy("run").agg(F.round(F.avg(metric), 4).alias(metric)).orderBy(F.desc(metric), "run").limit(k)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("r = 1").drop("r")


def reclaimable(versions: DataFrame, pins: DataFrame) -> DataFrame:
    """Retired versions older than every live pin."""
    low = pins.agg(F.min("epoch").alias("low"))  # one row
    return versions.join(F.broadcast(low)).where(F.col("retired") & (F.col("epoch") < F.coalesce("low", F.lit(2**62)))).select("version")
