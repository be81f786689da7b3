"""Metrics, policies and roll-ups on the driver tables."""

from pyspark.sql import functions as F

from weftgraph.functions import text as x
from weftgraph.operators import evaluate as e
from weftgraph.plans.demo import table
from weftgraph.registry import query

def N():  # noqa: N802
    return F.count(F.lit(1))

WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> ''))"


@query("token_f1", "E1", f"WITH t AS (SELECT p_partkey, {WORDS.format('p_name')} AS a, {WORDS.format('p_type || chr(32) || p_name')} AS b FROM part) SELECT p_partkey, round(2.0 * len(list_intersect(a, b)) / (len(a) + len(b)), 4) AS f1 FROM t")
def token_f1(spark, sf):
    return table(spark, sf, "part").select("p_partkey", x.token_f1(x.tokens("p_name"), x.tokens(F.concat_ws(" ", "p_type", "p_name"))).alias("f1"))


RANKED = "r AS (SELECT user_id AS query, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank, event_type = 'purchase' AS relevant, CAST(value AS DOUBLE) AS gain, event_id FROM events)"


def _ranked(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(spark, sf, "events").select(F.col("user_id").alias("query"), F.row_number().over(w).alias("rank"), (F.col("event_type") == "purchase").alias("relevant"), F.col("value").alias("gain"), F.col("event_id").alias("item"))


@query("hit_mrr", "E3 E4", f"WITH {RANKED}, f AS (SELECT query, MIN(CASE WHEN relevant THEN rank END) AS f FROM r GROUP BY query) SELECT round(avg(CASE WHEN COALESCE(f, 99) <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit, round(avg(COALESCE(1.0 / f, 0.0)), 6) AS mrr FROM f")
def hit_mrr(spark, sf):
    return e.hit_mrr(_ranked(spark, sf), 3)


@query("ndcg", "E5", f"WITH {RANKED}, g AS (SELECT query, event_id AS item, CASE WHEN relevant THEN 1.0 ELSE 0.0 END AS gain, rank FROM r), i AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY gain DESC) AS ideal FROM g), d AS (SELECT query, SUM(CASE WHEN rank <= 5 THEN gain / log2(rank + 1) ELSE 0 END) AS dcg, SUM(CASE WHEN ideal <= 5 THEN gain / log2(ideal + 1) ELSE 0 END) AS best FROM i GROUP BY query) SELECT query, round(CASE WHEN best > 0 THEN dcg / best ELSE 1 END, 6) AS ndcg FROM d")
def ndcg(spark, sf):
    return e.ndcg(_ranked(spark, sf).withColumn("gain", F.col("relevant").cast("double")), 5)


@query("kendall", "E5", "WITH r AS (SELECT user_id AS query, event_id AS item, value AS x, event_id % 13 AS y FROM events), s AS (SELECT a.query, SUM(sign((a.x - b.x) * (a.y - b.y))) AS s, COUNT(*) AS n FROM r a JOIN r b ON a.query = b.query AND a.item < b.item GROUP BY a.query) SELECT DISTINCT r.query, round(COALESCE(s / n, 1.0), 6) AS tau FROM r LEFT JOIN s ON s.query = r.query")
def kendall(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("query"), F.col("event_id").alias("item"), F.col("value").alias("x"), (F.col("event_id") % 13).alias("y"))
    return e.kendall(rows)


@query("triple_scores", "E6", "WITH g AS (SELECT n_nationkey AS s, n_regionkey AS o FROM nation), f AS (SELECT n_nationkey AS s, n_regionkey AS o FROM nation WHERE n_nationkey % 2 = 0 UNION SELECT n_regionkey, n_nationkey FROM nation WHERE n_nationkey > 20), n AS (SELECT (SELECT COUNT(*) FROM f JOIN g USING (s, o)) AS hit, (SELECT COUNT(*) FROM f) AS nf, (SELECT COUNT(*) FROM g) AS ng, (SELECT COUNT(*) FROM f JOIN g ON f.s = g.o AND f.o = g.s) AS rev) SELECT round(hit / nf, 6) AS precision, round(hit / ng, 6) AS recall, round(2 * (hit / nf) * (hit / ng) / (hit / nf + hit / ng), 6) AS f1, round(hit / (hit + rev), 6) AS direction FROM n")
def triples(spark, sf):
    g = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s"), F.lit("in").alias("p"), F.col("n_regionkey").alias("o"))
    back = g.where("s > 20").select(F.col("o").alias("s"), "p", F.col("s").alias("o"))
    return e.triples(g.where("s % 2 = 0").unionByName(back), g)


@query("latency_percentiles", "E7 A8", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, round(avg(value), 4) AS mean, COUNT(*) AS n FROM events GROUP BY event_type")
def latency(spark, sf):
    return e.latency_summary(table(spark, sf, "events"), "event_type", "value")


@query("quorum", "E8", "WITH c AS (SELECT user_id AS question, event_type AS answer, COUNT(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY n DESC, answer) AS r, lead(n) OVER (PARTITION BY question ORDER BY n DESC, answer) AS second FROM c) SELECT question, answer, n, n >= 20 AND n > COALESCE(second, 0) AS quorum FROM r WHERE r = 1")
def quorum(spark, sf):
    return e.quorum(table(spark, sf, "events").select(F.col("user_id").alias("question"), F.col("event_type").alias("answer")), 20)


@query("citation_agreement", "E8 F27", "WITH c AS (SELECT user_id % 3 AS round, event_type AS agent, list_distinct(list(user_id)) AS cites FROM events GROUP BY 1, 2) SELECT CAST(a.round AS INTEGER) AS round, round(avg(len(list_intersect(a.cites, b.cites)) / len(list_distinct(list_concat(a.cites, b.cites)))), 6) AS jaccard FROM c a JOIN c b ON a.round = b.round AND a.agent < b.agent GROUP BY 1")
def citations(spark, sf):
    rows = table(spark, sf, "events").groupBy((F.col("user_id") % 3).cast("int").alias("round"), F.col("event_type").alias("agent")).agg(F.collect_set("user_id").alias("cites"))
    return e.citation_agreement(rows)


@query("answer_scores", "E2 X3 X4", "SELECT p_partkey, (CASE WHEN contains(p_name, 'red') OR contains(p_name, 'blue') THEN 1 ELSE 0 END + CASE WHEN contains(p_name, 'ring') THEN 1 ELSE 0 END) / 2 AS recall FROM part")
def answers(spark, sf):
    return table(spark, sf, "part").select("p_partkey", e.answer_score(F.col("p_name"), F.array(F.lit("red|blue"), F.lit("ring"))).alias("recall"))


@query("stagewise_rates", "X2 X5 X32", "SELECT round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 6) AS planned, round(avg(CASE WHEN event_type <> 'error' THEN CASE WHEN value > 5 THEN 1.0 ELSE 0.0 END END), 6) AS executed, round(avg(CASE WHEN value > 5 AND event_type <> 'error' THEN CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END END), 6) AS correct FROM events")
def stages(spark, sf):
    planned = F.col("event_type") != "error"
    return e.stagewise(table(spark, sf, "events").select(planned.alias("planned"), (planned & (F.col("value") > 5)).alias("executed"), (F.col("event_type") == "purchase").alias("correct")))


@query("profile_delta", "X6 X22", "WITH b AS (SELECT event_type AS name, avg(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1), a AS (SELECT event_type AS name, avg(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT name, CASE WHEN a.v - b.v >= 0.02 THEN 'promote' WHEN a.v - b.v <= -0.02 THEN 'reject' ELSE 'hold' END AS verdict FROM b JOIN a USING (name)")
def profile(spark, sf):
    half = lambda r: table(spark, sf, "events").where(F.col("event_id") % 2 == r).groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("value"))
    return e.profile_delta(half(0), half(1)).select("name", "verdict")


@query("security_rows_cells_elements", "J7", "SELECT c_custkey, CASE WHEN c_acctbal < 5000 THEN c_acctbal END AS c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILDING,x' ELSE 'x' END AS tags FROM customer WHERE c_nationkey < 10")
def secured(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", F.array("c_mktsegment", F.lit("x")).alias("tags"))
    out = e.secure(rows, F.col("c_nationkey") < 10, {"c_acctbal": F.col("c_acctbal") < 5000}, {"tags": ["BUILDING", "x"]})
    return out.select("c_custkey", "c_acctbal", F.array_join("tags", ",").alias("tags"))


@query("disclosure_by_role", "J6", "SELECT c_custkey, c_name, CAST(NULL AS DOUBLE) AS c_acctbal, CAST(NULL AS VARCHAR) AS c_mktsegment FROM customer")
def disclosed(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return e.disclose(rows, {"c_name": "internal", "c_acctbal": "confidential", "c_mktsegment": "never heard of"}, "internal")


@query("granted_facts", "J8", "SELECT source, COUNT(*) AS n FROM documents WHERE source IN ('src1', 'src3') GROUP BY 1")
def granted(spark, sf):
    grants = spark.createDataFrame([("ann", "src1"), ("ann", "src3"), ("bob", "src2")], "principal string, source string")
    return e.granted(table(spark, sf, "documents"), grants, "ann").groupBy("source").agg(N().alias("n"))


@query("risk_disposition", "J5 D12", "WITH s AS (SELECT user_id AS subject, CASE event_type WHEN 'error' THEN 'high' WHEN 'signup' THEN 'medium' ELSE 'low' END AS severity, event_id % 3 AS hops FROM events) SELECT subject, CASE WHEN MAX(CASE WHEN severity = 'high' AND hops <= 1 THEN 1 ELSE 0 END) = 1 THEN 'block' WHEN MAX(CASE WHEN severity IN ('high', 'medium') THEN 1 ELSE 0 END) = 1 THEN 'review' ELSE 'allow' END AS disposition FROM s GROUP BY subject")
def risk(spark, sf):
    sev = F.when(F.col("event_type") == "error", "high").when(F.col("event_type") == "signup", "medium").otherwise("low")
    return e.disposition(table(spark, sf, "events").select(F.col("user_id").alias("subject"), sev.alias("severity"), (F.col("event_id") % 3).alias("hops")))


@query("pattern_cost_rank", "J9 T2", "SELECT 'p' || p_partkey AS pattern_id, round(p_size + 0.001 * p_retailprice + 5 * (p_partkey % 3) * (p_partkey % 7) + CASE WHEN p_partkey % 11 = 0 THEN 50 ELSE 0 END, 6) AS cost FROM part")
def cost(spark, sf):
    p = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("pattern_id"), F.col("p_size").alias("depth"), F.col("p_retailprice").alias("rows"), (F.col("p_partkey") % 3).alias("misses"), (F.col("p_partkey") % 7).alias("fanout"), (F.col("p_partkey") % 11 == 0).alias("cartesian"))
    return e.plan_cost(p).select("pattern_id", "cost")


@query("workload_verdict", "J11 N15", "SELECT CASE WHEN n <= 5 THEN 'execute' WHEN n <= 10 THEN 'bounded' WHEN o_custkey % 2 = 0 THEN 'approximate' ELSE 'decline' END AS verdict, COUNT(*) AS customers FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def verdicts(spark, sf):
    c = table(spark, sf, "orders").groupBy("o_custkey").agg(N().alias("n"))
    return c.groupBy(e.verdict(F.col("n"), 5, 10, F.col("o_custkey") % 2 == 0).alias("verdict")).agg(N().alias("customers"))


@query("intent_classes", "J13", "SELECT CASE WHEN role = 'system' THEN 'system' WHEN contains(text, 'the ') THEN 'lookup' WHEN contains(text, 'of ') THEN 'path' ELSE 'other' END AS intent, COUNT(*) AS n FROM conversations GROUP BY 1")
def intents(spark, sf):
    c = table(spark, sf, "conversations")
    return c.groupBy(F.when(F.col("role") == "system", "system").otherwise(e.classify("text", [("the ", "lookup"), ("of ", "path")], "other")).alias("intent")).agg(N().alias("n"))


@query("lane_routing", "J12", "WITH s AS (SELECT user_id AS query, event_type AS lane, CAST(COUNT(*) AS DOUBLE) AS score FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, lane) AS r, COALESCE(lead(score) OVER (PARTITION BY query ORDER BY score DESC, lane), 0) AS nxt FROM s) SELECT query, CASE WHEN score - nxt >= 4 THEN lane ELSE 'abstain' END AS lane FROM r WHERE r = 1")
def lanes(spark, sf):
    s = table(spark, sf, "events").groupBy(F.col("user_id").alias("query"), F.col("event_type").alias("lane")).agg(N().cast("double").alias("score"))
    return e.route_margin(s, 4.0)


@query("replica_choice", "J15", "SELECT s_name AS name, s_acctbal AS lag FROM supplier WHERE s_nationkey % 2 = 0 AND s_acctbal BETWEEN 0 AND 9000 ORDER BY lag, name LIMIT 1")
def replicas(spark, sf):
    """Suppliers as replicas: their balance is how far they lag, even nations are up."""
    rows = table(spark, sf, "supplier").where("s_acctbal >= 0").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("lag"), (F.col("s_nationkey") % 2 == 0).alias("healthy"))
    return e.replica(rows, 9000.0).select("name", "lag")


@query("vocabulary_merge", "X7 X10 X11 X12", "SELECT lower(p_brand) AS key, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS alts, string_agg(DISTINCT 's' || (p_partkey % 3), ',' ORDER BY 's' || (p_partkey % 3)) AS sources, arg_min(p_name, p_partkey) FILTER (WHERE p_partkey % 4 <> 0) AS definition FROM part GROUP BY 1")
def vocab(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("canonical"), F.col("p_type").alias("alt"), F.concat(F.lit("s"), (F.col("p_partkey") % 3).cast("string")).alias("source"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_name")).alias("definition"), F.col("p_partkey").alias("ordinal"))
    return e.vocabulary(p)


@query("concept_owners", "X8 X9", "SELECT p_name AS concept, COUNT(DISTINCT p_brand) AS profiles FROM part WHERE p_size < 2 GROUP BY 1 HAVING COUNT(DISTINCT p_brand) > 1")
def concept_owners(spark, sf):
    return e.owners(table(spark, sf, "part").where("p_size < 2").select(F.col("p_name").alias("concept"), F.col("p_brand").alias("profile")))


@query("capability_match", "X18", "WITH o AS (SELECT 'part ' || p_partkey AS name, list_distinct(string_split(p_name, ' ')) AS inputs, p_size AS priority FROM part WHERE p_type = 'ECONOMY') SELECT name, CAST(len(inputs) + priority AS INTEGER) AS score FROM o WHERE len(list_filter(inputs, lambda w: w NOT IN ('small', 'ring', 'red', 'blue', 'box', 'steel'))) = 0")
def capability(spark, sf):
    """Parts as capabilities: their words are what they need, their size the priority."""
    o = table(spark, sf, "part").select(F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("name"), F.col("p_type").alias("kind"), F.array_distinct(F.split("p_name", " ")).alias("inputs"), F.col("p_size").alias("priority"))
    return e.match_rank(o, ["small", "ring", "red", "blue", "box", "steel"], "ECONOMY").select("name", "score")


@query("evidence_bundles", "X26", "WITH s AS (SELECT user_id, list_distinct(list(event_type)) AS slots, COUNT(*) AS n FROM events GROUP BY 1) SELECT user_id AS subject, array_to_string(list_sort(list_filter(['click', 'purchase', 'signup'], lambda x: NOT list_contains(slots, x))), ',') AS missing, len(list_filter(['click', 'purchase', 'signup'], lambda x: list_contains(slots, x))) = 3 AS complete FROM s")
def bundles(spark, sf):
    """What each user's events show of three required slots, and what is to be asked again."""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("subject"), F.col("event_type").alias("slot"))
    return e.evidence_bundle(rows, ["click", "purchase", "signup"]).select("subject", F.array_join("missing", ",").alias("missing"), "complete")


@query("artifact_diff", "X24 X29", "SELECT p_partkey AS key, CASE WHEN p_size < 5 THEN 'removed' WHEN p_size > 45 THEN 'added' ELSE 'changed' END AS change FROM part WHERE p_size < 5 OR p_size > 45 OR p_retailprice > 1500")
def diff(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value"), "p_size", "p_retailprice")
    new = p.where("p_size >= 5").withColumn("value", F.when(F.col("p_retailprice") > 1500, F.lit("new")).otherwise(F.col("value")))
    return e.artifact_diff(p.where("p_size <= 45").select("key", "value"), new.select("key", "value"))


@query("run_leaderboard", "X21 X22", "SELECT p_brand AS run, round(avg(p_retailprice), 4) AS score FROM part GROUP BY 1 ORDER BY score DESC, run LIMIT 5")
def board(spark, sf):
    return e.leaderboard(table(spark, sf, "part").select(F.col("p_brand").alias("run"), F.col("p_retailprice").alias("score")), "score", 5)


@query("latest_results", "X1 X38", "SELECT user_id, MAX(event_id) AS event_id FROM events GROUP BY 1")
def latest(spark, sf):
    return e.latest(table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("reclaimable_versions", "X27", "SELECT event_id AS version FROM events WHERE event_type = 'error' AND event_id < (SELECT MIN(event_id) FROM events WHERE event_type = 'signup' AND event_id > 500)")
def reclaim(spark, sf):
    ev = table(spark, sf, "events")
    v = ev.select(F.col("event_id").alias("version"), (F.col("event_type") == "error").alias("retired"), F.col("event_id").alias("epoch"))
    return e.reclaimable(v, ev.where("event_type = 'signup' and event_id > 500").select(F.col("event_id").alias("epoch")))


@query("parameter_sweep", "X23", "SELECT t AS threshold, k AS kind, COUNT(*) FILTER (WHERE value > t AND event_type = k) AS n FROM events, (VALUES (1.0), (5.0), (20.0)) x(t), (VALUES ('click'), ('error')) y(k) GROUP BY 1, 2")
def sweeps(spark, sf):
    """Every combination of two axes, each run on all events in one pass."""
    grid = e.sweep(spark, {"threshold": [1.0, 5.0, 20.0], "kind": ["click", "error"]})
    hit = (F.col("value") > F.col("threshold")) & (F.col("event_type") == F.col("kind"))
    return table(spark, sf, "events").join(F.broadcast(grid)).groupBy("threshold", "kind").agg(F.count_if(hit).alias("n"))  # six rows


@query("cost_saving_ratio", "X19 X20", "SELECT round(1 - SUM(CASE WHEN p_size < 25 THEN 1 ELSE 4 END) / (4.0 * COUNT(*)), 6) AS saved, COUNT(*) FILTER (WHERE p_partkey % 6 = 0) AS incomplete FROM part")
def saving(spark, sf):
    spent = F.sum(F.when(F.col("p_size") < 25, 1).otherwise(4))
    missing = F.when(F.col("p_partkey") % 6 != 0, F.col("p_name"))
    return table(spark, sf, "part").agg(F.round(1 - spent / (4.0 * N()), 6).alias("saved"), F.count_if(missing.isNull()).alias("incomplete"))
