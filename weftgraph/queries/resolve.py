"""Writes, deduplication and entity resolution on the driver tables."""

from pyspark.sql import functions as F

from weftgraph.functions import text as x
from weftgraph.operators import resolve as r
from weftgraph.plans.demo import table
from weftgraph.registry import query

def N():  # noqa: N802
    return F.count(F.lit(1))



def _writes(spark, sf, of="true"):
    """Events as writes of a user's last value by type: properties are event types."""
    e = table(spark, sf, "events").where(of)
    return e.select(F.lit("User").alias("label"), F.col("user_id").cast("string").alias("id"), F.lit("ws0").alias("workspace"), F.create_map("event_type", F.col("event_id").cast("string")).alias("props"), F.concat(F.lit("s"), (F.col("event_id") % 4).cast("string")).alias("source"), F.expr("event_id div 2").alias("ts"), F.col("event_id").alias("ordinal"))


@query("lww_upsert", "W1 W2 M12", "SELECT CAST(user_id AS VARCHAR) AS id, event_type AS prop, CAST(MAX(event_id) AS VARCHAR) AS value FROM events GROUP BY 1, 2")
def lww(spark, sf):
    return r.upsert_nodes(_writes(spark, sf)).select("id", F.explode("props").alias("prop", "value"))


@query("source_accumulation", "W2 W7", "SELECT 's' || (event_id % 4) AS source, COUNT(DISTINCT user_id) AS n FROM events GROUP BY 1")
def sources(spark, sf):
    return r.count_by_source(r.upsert_nodes(_writes(spark, sf)))


@query("merge_conflicts", "W3", "WITH a AS (SELECT user_id, event_type, MAX(event_id) AS v FROM events WHERE value <= 5 GROUP BY 1, 2), b AS (SELECT user_id, event_type, MAX(event_id) AS v FROM events WHERE value > 5 GROUP BY 1, 2) SELECT CAST(user_id AS VARCHAR) AS id, event_type AS prop, CAST(a.v AS VARCHAR) AS before, CAST(b.v AS VARCHAR) AS after FROM a JOIN b USING (user_id, event_type)")
def merge_conflicts(spark, sf):
    w = lambda of: r.upsert_nodes(_writes(spark, sf, of))
    return r.merge_conflicts(w("value <= 5"), w("value > 5")).select("id", "prop", "before", "after")


@query("delete_by_source", "W6 W8", "SELECT CAST(user_id AS VARCHAR) AS id, COUNT(DISTINCT event_id % 4) AS sources FROM events WHERE event_id % 4 <> 1 GROUP BY 1")
def delete_by_source(spark, sf):
    own = r.upsert_nodes(_writes(spark, sf))
    return r.delete_by_source(own, "s1").select("id", F.size("sources").cast("long").alias("sources"))


@query("edge_upsert", "W4 S25", "SELECT o_custkey AS src, l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) AND l_suppkey IN (SELECT s_suppkey FROM supplier) GROUP BY 1, 2")
def edge_upsert(spark, sf):
    from weftgraph.plans.demo import transfers

    t = transfers(spark, sf)
    ws = F.lit("w").alias("workspace")
    e = t.select(F.concat(F.lit("c"), F.col("src").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("dst").cast("string")).alias("dst"), F.lit("TRANSFER").alias("type"), ws, F.create_map(F.lit("amount"), F.col("amount").cast("string")).alias("props"), "ts", F.col("order_id").alias("ordinal"))
    nodes = table(spark, sf, "customer").where("c_nationkey < 5").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), ws).unionByName(table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), ws))
    return r.upsert_edges(e, nodes).select(F.substring("src", 2, 20).cast("long").alias("src"), F.substring("dst", 2, 20).cast("long").alias("dst"))


@query("endpoint_orphans", "W5", "SELECT COUNT(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20))")
def orphans(spark, sf):
    e = table(spark, sf, "orders").select(F.col("o_custkey").alias("src"), (-1 - F.col("o_orderkey")).alias("dst"))
    n = table(spark, sf, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("id")).unionByName(table(spark, sf, "orders").select((-1 - F.col("o_orderkey")).alias("id")))
    return r.orphans(e, n).agg(N().alias("n"))


@query("doc_dedup", "W12 F19", "SELECT MIN(doc_id) AS doc_id, COUNT(*) AS copies FROM documents GROUP BY sha256(text)")
def dedup(spark, sf):
    return r.exact_duplicates(table(spark, sf, "documents"), F.sha2("text", 256), "doc_id").select("doc_id", "copies")


@query("cross_chunk_dedup", "W13", "SELECT p_brand AS label, p_name AS name, MIN(p_partkey) AS id FROM part GROUP BY 1, 2")
def cross_chunk(spark, sf):
    n = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ordinal"))
    e = n.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("SELF").alias("type"))
    return r.cross_chunk(n, e)[0].select("label", "name", "id")


@query("identity_keys", "W14 F4", "SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN 'Customer|customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '|' || lower(c_mktsegment) END AS key FROM customer")
def identity(spark, sf):
    c = table(spark, sf, "customer")
    blank = F.col("c_custkey") % 7 == 0
    return c.select("c_custkey", r.identity_key(F.lit("Customer"), F.when(~blank, F.concat(F.lit("  "), "c_name")), F.when(~blank, F.col("c_mktsegment")).otherwise(" ")).alias("key"))


@query("intern_first_writer", "W15", "SELECT p_name AS identity, CAST(arg_min(p_partkey, p_partkey) AS VARCHAR) AS canonical FROM part GROUP BY p_name")
def intern(spark, sf):
    p = table(spark, sf, "part").select(F.lit("w").alias("workspace"), F.col("p_name").alias("identity"), F.col("p_partkey").cast("string").alias("canonical"), F.col("p_partkey").alias("seq"))
    return r.intern(p).select("identity", "canonical")


@query("alias_ambiguity", "W15", "SELECT p_name AS name, CASE WHEN COUNT(DISTINCT p_brand) = 1 THEN MIN(p_brand) ELSE '' END AS canonical, MIN(p_brand) AS reconciled, CAST(COUNT(DISTINCT p_brand) AS INTEGER) AS candidates FROM part WHERE p_size < 3 GROUP BY p_name")
def alias(spark, sf):
    return r.aliases(table(spark, sf, "part").where("p_size < 3").select(F.col("p_name").alias("name"), F.col("p_brand").alias("canonical")))


NAMES = "n AS (SELECT p_partkey AS id, p_name AS k, split_part(p_name, ' ', 1) AS w FROM part WHERE p_size <= 40 UNION ALL SELECT p_partkey, split_part(p_name, ' ', 1), split_part(p_name, ' ', 1) FROM part WHERE p_size > 40), f AS (SELECT k, MIN(id) AS id FROM n GROUP BY k)"


def _proxies(spark, sf):
    """Large parts go by their first word, all others by their name."""
    p = table(spark, sf, "part")
    large = F.col("p_size") > 40
    return p.select(F.col("p_partkey").alias("id"), F.when(large, F.concat(F.lit("The "), F.split("p_name", " ")[0])).otherwise(F.concat("p_name", F.lit(", Inc."))).alias("name"))


@query("er_candidates", "W18 F5 F6", f"WITH {NAMES} SELECT f.id AS a, n.id AS b, CAST(1.0 AS DOUBLE) AS score FROM n JOIN f ON f.k = n.k AND f.id <> n.id UNION ALL SELECT least(x.id, y.id), greatest(x.id, y.id), CAST(0.9 AS DOUBLE) FROM f x JOIN f y ON starts_with(x.k, y.k || ' ')")
def candidates(spark, sf):
    return r.candidate_pairs(_proxies(spark, sf))


@query("er_clusters", "W19 N5", f"WITH {NAMES}, s AS (SELECT DISTINCT w FROM n WHERE k = w), g AS (SELECT id, CASE WHEN n.w IN (SELECT w FROM s) THEN n.w ELSE k END AS g FROM n) SELECT id AS node, component FROM (SELECT id, MIN(id) OVER (PARTITION BY g) AS component, COUNT(*) OVER (PARTITION BY g) AS c FROM g) WHERE c > 1")
def er_clusters(spark, sf):
    pairs = r.candidate_pairs(_proxies(spark, sf))
    return r.clusters(pairs.select("a", "b"), pairs.where("score > 2").select("a", "b"))


@query("embedding_dedup", "W16 V5", "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 6) AS similarity FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) >= 0.4")
def embedding_dedup(spark, sf):
    e = table(spark, sf, "embeddings")
    norm = F.sqrt(F.aggregate(F.transform("embedding", lambda p: p.cast("double") * p.cast("double")), F.lit(0.0), lambda s, z: s + z))
    v = e.withColumn("n", norm).select("label", F.col("vec_id").alias("id"), F.transform("embedding", lambda p: p.cast("double") / F.col("n")).alias("v"))
    return r.embedding_duplicates(v, "label", 0.4).withColumn("similarity", F.round("similarity", 6))


@query("relatedness_ladder", "W17", "SELECT CASE WHEN n_chars % 5 = 0 THEN 'bootstrap' WHEN n_chars % 5 >= 2 AND (n_chars % 3) / (n_chars % 5) >= 0.5 THEN 'overlap' WHEN n_chars % 5 = 1 AND n_chars % 3 >= 1 THEN 'overlap' WHEN n_chars % 100 >= 72 THEN 'embedding' WHEN n_chars % 10 >= 2 THEN 'lexical' ELSE 'unrelated' END AS reason, COUNT(*) AS n FROM documents GROUP BY 1")
def related(spark, sf):
    c = F.col("n_chars")
    return table(spark, sf, "documents").groupBy(r.relatedness(c % 3, c % 5, (c % 100) / 100, (c % 10) / 10).alias("reason")).agg(N().alias("n"))


@query("survivorship_vote", "W20 W21 F11 F12", """WITH f AS (SELECT l_orderkey AS k, l_returnflag AS s, l_extendedprice AS v, length(replace(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), '.', '')) AS d, format('{:,.2f}', l_extendedprice) AS raw FROM lineitem), o AS (SELECT k, s, v FROM (SELECT *, row_number() OVER (PARTITION BY k, s ORDER BY d DESC, raw) AS r FROM f) WHERE r = 1),
g AS (SELECT k, v, CASE WHEN lag(v) OVER (PARTITION BY k ORDER BY v) IS NULL OR v - lag(v) OVER (PARTITION BY k ORDER BY v) > 0.005 * v THEN 1 ELSE 0 END AS new FROM o), c AS (SELECT k, SUM(new) OVER (PARTITION BY k ORDER BY v ROWS UNBOUNDED PRECEDING) AS g FROM g), z AS (SELECT k, g, COUNT(*) AS n FROM c GROUP BY 1, 2), y AS (SELECT k, MAX(n) AS m, SUM(n) AS n FROM z GROUP BY k) SELECT CASE WHEN n = 1 THEN 'single' WHEN m >= 2 AND 2 * m > n THEN 'survived' ELSE 'quarantine' END AS status, COUNT(*) AS n FROM y GROUP BY 1""")
def survive(spark, sf):
    raw = F.format_number("l_extendedprice", 2)
    v = x.parse_value(raw)
    facts = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("key"), F.col("l_returnflag").alias("source"), raw.alias("raw"), v["value"].alias("value"), v["percent"].alias("percent"), v["digits"].alias("digits"))
    return r.survivorship(facts).groupBy("status").agg(N().alias("n"))


@query("federated_read", "W22 T5", "SELECT 'customers' AS dept, COUNT(*) AS n FROM customer UNION ALL SELECT 'suppliers', COUNT(*) FROM supplier")
def federated(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return r.federated({"customers": c, "suppliers": table(spark, sf, "supplier").select(F.col("s_name").alias("name"))}).groupBy("dept").agg(N().alias("n"))


@query("qualification_run", "W23", "SELECT CASE WHEN m >= 0.85 THEN 'merge' WHEN m >= 0.5 THEN 'review' ELSE 'separate' END AS verdict, COUNT(*) AS n FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN (p_size / 50 + 0.9) / 2 ELSE p_size / 50 END AS m FROM part) GROUP BY 1")
def qualification(spark, sf):
    g = F.when(F.col("p_partkey") % 3 == 0, F.lit(0.9))
    return table(spark, sf, "part").groupBy(r.qualify(F.col("p_size") / 50, g, F.lit(None).cast("double")).alias("verdict")).agg(N().alias("n"))


@query("conflicting_slots", "W26", "SELECT c_nationkey AS slot, COUNT(DISTINCT c_mktsegment) AS values FROM customer WHERE c_acctbal > 9000 GROUP BY 1 HAVING COUNT(DISTINCT c_mktsegment) > 1")
def slots(spark, sf):
    return r.conflicting_slots(table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("slot"), F.col("c_mktsegment").alias("value")))


@query("incremental_files", "S6 S7", "SELECT doc_id FROM documents WHERE doc_id % 4 = 0 OR n_chars % 10 = 0")
def files(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"), "n_chars")
    tracked = d.where("path % 4 <> 0").select("path", F.when(F.col("n_chars") % 10 == 0, F.lit("old")).otherwise(F.col("hash")).alias("hash"))
    return r.changed_files(d.select("path", "hash"), tracked).select(F.col("path").alias("doc_id"))
