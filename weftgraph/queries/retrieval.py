"""Vector and text retrieval on embeddings, documents and the benchmark."""

from pyspark.sql import functions as F

from weftgraph.operators import retrieval as v
from weftgraph.operators.shapes import rank_fusion
from weftgraph.plans.demo import table
from weftgraph.registry import query

Q = [((i * 37) % 19 - 9) / 10 for i in range(64)]
QSQL = "[" + ", ".join(f"{x}::DOUBLE" for x in Q) + "]"
COS = f"list_cosine_similarity(embedding::DOUBLE[], {QSQL})"


def _items(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


@query("vector_topk_cosine", "V1", f"SELECT vec_id AS id, round({COS}, 6) AS score FROM embeddings ORDER BY round({COS}, 6) DESC, vec_id LIMIT 10")
def cosine(spark, sf):
    return v.top_cosine(_items(spark, sf), Q, 10).select("id", "score")


L2 = f"1 / (1 + pow(list_distance(embedding::DOUBLE[], {QSQL}), 2))"


@query("vector_topk_l2", "V2", f"SELECT vec_id AS id, round({L2}, 6) AS score FROM embeddings ORDER BY round({L2}, 6) DESC, vec_id LIMIT 10")
def l2(spark, sf):
    return v.top_l2(_items(spark, sf), Q, 10).select("id", "score")


@query("vector_topk_each", "V1 V10", "WITH s AS (SELECT q.vec_id AS query, e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) SELECT query, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def each(spark, sf):
    asked = table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    return v.top_each(_items(spark, sf), asked, 5)


@query("vector_upsert", "V3", "SELECT vec_id AS id FROM embeddings WHERE vec_id % 5 <> 0")
def upsert(spark, sf):
    e = table(spark, sf, "embeddings")
    kind = e.schema["embedding"].dataType
    first = e.select(F.col("vec_id").alias("id"), "embedding", F.lit("a").alias("text"), F.lit(1).alias("ordinal"))
    gone = e.where("vec_id % 5 = 0").select(F.col("vec_id").alias("id"), F.lit(None).cast(kind).alias("embedding"), F.lit(None).cast("string").alias("text"), F.lit(2).alias("ordinal"))
    return v.upsert_items(first.unionByName(gone)).select("id")


@query("vector_delete_source", "V4", "SELECT 'src_chunk_' || vec_id AS id FROM embeddings WHERE FALSE UNION ALL SELECT 'src_chunked_v2_' || vec_id FROM embeddings WHERE vec_id % 2 = 1")
def delete(spark, sf):
    i = table(spark, sf, "embeddings").select(F.concat(F.when(F.col("vec_id") % 2 == 0, "src_chunk_").otherwise("src_chunked_v2_"), F.col("vec_id").cast("string")).alias("id"))
    return v.delete_source(i, "src")


@query("rrf_fusion", "V6 G25", "WITH a AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS rank FROM embeddings WHERE label = 1), b AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id DESC) AS rank FROM embeddings WHERE label < 3) SELECT id, round(SUM(s), 8) AS score FROM (SELECT id, 1.0 / (60 + rank) AS s FROM a UNION ALL SELECT vec_id, 0.5 / (60 + rank) FROM b) GROUP BY id")
def rrf(spark, sf):
    from pyspark.sql import Window

    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    ranked = lambda df, o, b: df.select("id", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(o)).alias("rank"), F.lit(b).alias("backend"))
    lists = ranked(e.where("label = 1"), F.asc("id"), "a").unionByName(ranked(e.where("label < 3"), F.desc("id"), "b")).unionByName(ranked(e, F.asc("id"), "c"))
    return rank_fusion(lists, {"b": 0.5, "c": 0.05}).withColumn("score", F.round("score", 8))


@query("tfidf_rank", "V7", """WITH w AS (SELECT item_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM benchmark), tf AS (SELECT id, w, COUNT(*) AS c FROM w GROUP BY 1, 2), len AS (SELECT id, SUM(c) AS len FROM tf GROUP BY 1), n AS (SELECT COUNT(*) AS n FROM benchmark), idf AS (SELECT w, ln((n + 1) / (COUNT(*) + 1)) + 1 AS idf FROM tf, n GROUP BY w, n), x AS (SELECT tf.id, tf.w, c / len * idf AS x FROM tf JOIN len USING (id) JOIN idf USING (w)), q AS (SELECT w, CAST(0.25 AS DOUBLE) * idf AS q FROM idf WHERE w IN ('the', 'of', 'and', 'to')), qn AS (SELECT sqrt(SUM(q * q)) AS qn FROM q), dn AS (SELECT id, sqrt(SUM(x * x)) AS dn FROM x GROUP BY id) SELECT id, round(SUM(x * q) / (dn * qn), 6) AS score FROM x JOIN q USING (w) JOIN dn USING (id), qn GROUP BY id, dn, qn HAVING SUM(x * q) > 0 ORDER BY round(SUM(x * q) / (dn * qn), 6) DESC, id LIMIT 5""")
def tfidf(spark, sf):
    return v.tfidf_top(table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"), "the of and to", 5)


@query("entity_resolver", "V8 W-7", "WITH s AS (SELECT p_partkey AS id, p_name AS name, round((CASE WHEN p_name IN ('red ring', 'ring red') THEN 1.0 WHEN split_part(p_name, ' ', 1) IN ('red', 'ring') OR split_part(p_name, ' ', 2) IN ('red', 'ring') THEN 1.0 / 3 ELSE 0 END) + CASE WHEN p_brand = 'Brand#3' THEN 0.15 ELSE 0 END + CASE WHEN p_name = 'red ring' THEN 0.2 ELSE 0 END, 4) AS score FROM part WHERE split_part(p_name, ' ', 1) IN ('red', 'ring') OR split_part(p_name, ' ', 2) IN ('red', 'ring')), t AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 5) SELECT id, name, score, row_number() OVER (ORDER BY score DESC, id) = 1 AND score - COALESCE(lead(score) OVER (ORDER BY score DESC, id), 0) > 0.15 AS confident FROM t")
def resolver(spark, sf):
    n = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("label"), F.lit(None).cast("string").alias("alias"))
    return v.resolve_entities(n, "red ring", "Brand#3")


@query("chunk_fallback", "V11 G24", "SELECT doc_id AS id, substr(text, 1, 400) AS text, CAST(contains(lower(text), 'license') AS INTEGER) + CAST(contains(lower(text), 'apache') AS INTEGER) + CAST(contains(lower(text), 'reserved') AS INTEGER) AS hits FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'apache') OR contains(lower(text), 'reserved') ORDER BY hits DESC, id LIMIT 3")
def fallback(spark, sf):
    return v.chunk_fallback(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "What is the Apache license, reserved?")


@query("fulltext_postings", "V12", "SELECT word, COUNT(*) AS n FROM (SELECT item_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''))) AS word FROM benchmark) GROUP BY word".replace("\\\\", "\\"))
def postings(spark, sf):
    return v.postings(table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("graph_routing", "V13 V14", "WITH g AS (SELECT 'g' || p_partkey AS name, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS m FROM part WHERE p_size <= 40) SELECT name, CAST(len(list_intersect(m, ['economy', 'ring', 'small', 'steel'])) AS INTEGER) AS score FROM g WHERE len(list_intersect(m, ['economy', 'ring', 'small', 'steel'])) > 0 ORDER BY score DESC, name LIMIT 12")
def routing(spark, sf):
    """Parts as graphs, their names and types as metadata; large ones are blocked."""
    g = table(spark, sf, "part").select(F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("name"), F.concat_ws(" ", "p_name", "p_type").alias("metadata"), (F.col("p_size") > 40).alias("blocked"))
    return v.route(g, "small economy steel ring", 12)
