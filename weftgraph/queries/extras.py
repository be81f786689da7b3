"""Smaller operators on the driver tables."""

from pyspark.sql import functions as F

from weftgraph.operators import extras as x
from weftgraph.plans.demo import table
from weftgraph.registry import query


@query("betweenness_topk", "N18", "WITH bt AS (SELECT DISTINCT p_brand AS b, p_type AS t FROM part), tz AS (SELECT DISTINCT p_type AS t, p_size AS z FROM part), p AS (SELECT b, t, z FROM bt JOIN tz USING (t)), s AS (SELECT b, z, COUNT(*) AS n FROM p GROUP BY 1, 2) SELECT t AS node, round(SUM(1.0 / n), 6) AS score FROM p JOIN s USING (b, z) GROUP BY t UNION ALL SELECT DISTINCT p_brand, 0.0 FROM part UNION ALL SELECT DISTINCT 'size ' || p_size, 0.0 FROM part ORDER BY score DESC, node LIMIT 10")
def between(spark, sf):
    """Brands to types to sizes, over all parts: every path runs through a type."""
    p = table(spark, sf, "part")
    size = F.concat(F.lit("size "), F.col("p_size").cast("string"))
    e = p.select(F.col("p_brand").alias("src"), F.col("p_type").alias("dst")).unionByName(p.select(F.col("p_type").alias("src"), size.alias("dst")))
    return x.betweenness(e, 10, directed=True)


@query("canonical_projection", "W24", "SELECT DISTINCT 'B' || a.p_brand AS src, 'B' || b.p_brand AS dst, 'NEXT' AS type FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_brand <> b.p_brand")
def canonical(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("B"), F.col("p_brand")).alias("canonical"), F.lit("Part").alias("label"), "p_partkey")
    last = p.agg(F.max("p_partkey").alias("last"))
    e = p.join(F.broadcast(last)).where("p_partkey < last").select(F.col("id").alias("src"), (F.col("p_partkey") + 1).cast("string").alias("dst"), F.lit("NEXT").alias("type"))
    return x.canonical_snapshot(p.select("id", "label"), e, p)[1]


@query("module_selection", "R37 X17", "SELECT * FROM (VALUES ('base', CAST(NULL AS DOUBLE)), ('loans', 0.5), ('parties', 0.3333)) AS t(module, score)")
def modules(spark, sf):
    m = spark.createDataFrame([("loans", "loan lender principal"), ("parties", "person owner party"), ("base", "thing"), ("derivatives", "swap option")], "name string, terms string")
    return x.select_modules(m, {"loans": ["base"], "parties": ["base"]}, "Which loan has which lender and owner?", 2)


@query("learning_task_score", "R27", "WITH f AS (SELECT lang AS task, doc_id AS item FROM documents WHERE n_chars < 2000), g AS (SELECT lang AS task, doc_id AS item FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND lang <> 'es'), j AS (SELECT COALESCE(f.task, g.task) AS task, f.item AS f, g.item AS g FROM f FULL JOIN g ON f.task = g.task AND f.item = g.item), n AS (SELECT task, COUNT(f) AS nf, COUNT(g) AS ng, COUNT(*) FILTER (WHERE f IS NOT NULL AND g IS NOT NULL) AS hit FROM j GROUP BY task) SELECT task, CASE WHEN ng > 0 THEN round(hit / nf, 4) END AS precision, CASE WHEN ng > 0 THEN round(hit / ng, 4) END AS recall, CASE WHEN ng > 0 THEN round(2 * hit / (nf + ng), 4) END AS f1 FROM n")
def learning(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels").where("quality = 0").select("doc_id")
    row = lambda df: df.select(F.col("lang").alias("task"), F.col("doc_id").alias("item"))
    return x.learning_score(row(d.where("n_chars < 2000")), row(d.where("lang <> 'es'").join(lab, "doc_id", "left_semi")))


@query("utility_scorecard", "E9", "SELECT user_id AS run, round(CAST(SUM(CAST(CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 1 END * value AS DECIMAL(18,6))) AS DOUBLE) / SUM(CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 1 END), 6) AS utility, COUNT(DISTINCT event_type) AS metrics FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def utility(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("metric"), "value")
    return x.utility_scorecard(e, {"click": 2, "view": 1})


@query("failure_diagnosis", "E11", "WITH r AS (SELECT user_id % 7 AS category, value > 5 AS correct, event_type AS cause FROM events), c AS (SELECT category, string_agg(cause || '=' || n, ',' ORDER BY cause || '=' || n) AS causes FROM (SELECT category, cause, COUNT(*) AS n FROM r WHERE NOT correct GROUP BY 1, 2) GROUP BY 1) SELECT r.category, COUNT(*) AS questions, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 6) AS accuracy, COALESCE(MAX(causes), '') AS causes FROM r LEFT JOIN c ON c.category = r.category GROUP BY 1")
def failures(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 7).alias("category"), (F.col("value") > 5).alias("correct"), F.col("event_type").alias("cause"))
    return x.diagnosis(e)
