"""Sources, chunks and sinks on the driver tables."""

from pyspark.sql import functions as F

from weftgraph.plans.demo import table
from weftgraph.registry import query
from weftgraph.sources import chunks as ch
from weftgraph.sources import readers as s

def N():  # noqa: N802
    return F.count(F.lit(1))



@query("record_id", "S8 S17 F19", "SELECT CAST(doc_id AS VARCHAR) AS id, sha256(text) AS sha256, source FROM documents")
def records(spark, sf):
    d = table(spark, sf, "documents")
    return s.with_checksum(s.record(d, F.col("doc_id"), F.col("text"), source=F.col("source"))).select("id", "sha256", "source")


@query("csv_cells", "S2 S10", "SELECT p_partkey, 'p_name: ' || p_name || CASE WHEN p_partkey % 3 > 0 THEN ' | p_type: ' || p_type ELSE '' END AS content FROM part")
def cells(spark, sf):
    p = table(spark, sf, "part").withColumn("p_type", F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")))
    return p.select("p_partkey", s.joined_cells(["p_name", "p_type"]).alias("content"))


@query("connector_state", "S18 X34", "SELECT source, COUNT(*) AS n, MAX(CAST(doc_id AS VARCHAR)) AS last FROM documents GROUP BY source")
def state(spark, sf):
    return s.run_state(s.record(table(spark, sf, "documents"), F.col("doc_id"), F.col("text"), source=F.col("source")))


@query("conversation_threads", "S12", "SELECT 'slack:c:' || conv_id AS id, string_agg(role || ': ' || trim(text), chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id")
def threads(spark, sf):
    c = table(spark, sf, "conversations")
    m = c.select(F.lit("c").alias("channel"), F.lpad(F.col("turn").cast("string"), 6, "0").alias("ts"), F.col("conv_id").cast("string").alias("thread_ts"), F.col("role").alias("user"), "text")
    return s.slack_threads(m).select("id", "content")


@query("table_schemas", "S13 S14 S15", "SELECT 'pg:public:n' || n_regionkey AS id, string_agg(n_name || ' int', chr(10) ORDER BY n_nationkey) AS content FROM nation GROUP BY n_regionkey")
def schemas(spark, sf):
    n = table(spark, sf, "nation")
    return s.table_schemas(n.select(F.lit("public").alias("schema"), F.concat(F.lit("n"), F.col("n_regionkey").cast("string")).alias("table"), F.col("n_nationkey").alias("position"), F.col("n_name").alias("column"), F.lit("int").alias("type")), "pg").select("id", "content")


@query("company_facts", "S19", "WITH f AS (SELECT o_custkey, year(o_orderdate) AS y, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_totalprice) AS r FROM orders WHERE o_orderstatus = 'F'), g AS (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY y DESC) AS age FROM f WHERE r = 1) SELECT o_custkey AS entity, CAST(y AS INTEGER) AS fiscal_year, o_totalprice AS value FROM g WHERE age <= 2")
def facts(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), F.lit("total").alias("concept"), F.lit("USD").alias("unit"), F.when(F.col("o_orderstatus") == "F", "10-K").otherwise("8-K").alias("form"), F.year("o_orderdate").alias("fiscal_year"), F.col("o_orderdate").alias("filed"), F.col("o_totalprice").alias("value"))
    return s.company_facts(o, "USD", 2).select("entity", "fiscal_year", "value")


@query("stratified_sample", "S20 S39 T4", "SELECT lang, least(COUNT(*), 25) AS n FROM documents GROUP BY lang")
def stratified(spark, sf):
    return s.stratified(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 25, 7).groupBy("lang").agg(N().alias("n"))


@query("power_law_generator", "S22 M14")
def generator(spark, sf):
    return s.power_law_edges(spark, 20_000, 500, 3.0, 11).groupBy("dst").agg(N().alias("indegree")).orderBy(F.desc("indegree"), "dst").limit(10)


@query("prefixed_ids", "S23 S24", "SELECT 'Supplier:' || s_suppkey AS id, s_name FROM supplier")
def prefixed(spark, sf):
    return s.prefixed(table(spark, sf, "supplier"), "Supplier", "s_suppkey").select("id", "s_name")


@query("turtle_lines", "S26 S30", "SELECT '<urn:n:' || n_nationkey || '> <urn:p:in> ' || CASE n_nationkey % 3 WHEN 0 THEN '<urn:r:' || n_regionkey || '>' WHEN 1 THEN 'r:' || n_regionkey ELSE '\"' || n_name || '\"' END || ' .' AS value FROM nation")
def turtle(spark, sf):
    n = table(spark, sf, "nation")
    o = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("urn:r:"), F.col("n_regionkey").cast("string"))).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("r:"), F.col("n_regionkey").cast("string"))).otherwise(F.col("n_name"))
    return s.turtle(n.select(F.concat(F.lit("urn:n:"), F.col("n_nationkey").cast("string")).alias("s"), F.lit("urn:p:in").alias("p"), o.alias("o")))


@query("projection_ledger", "S27", "SELECT COUNT(DISTINCT user_id || event_type) AS n FROM events WHERE value > 5 AND user_id || event_type NOT IN (SELECT user_id || event_type FROM events WHERE value <= 2)")
def ledger(spark, sf):
    e = table(spark, sf, "events").withColumn("idempotency_key", F.concat(F.col("user_id").cast("string"), "event_type"))
    return s.new_only(e.where("value > 5"), e.where("value <= 2")).agg(N().alias("n"))


@query("glossary_round_trip", "S31", "SELECT n_name AS name, 'nation ' || n_nationkey AS definition FROM nation")
def glossary(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("definition"), F.array(F.lit("place")).alias("parents"))
    back = s.glossary(n).select(F.from_json("value", "name string, definition string, parents array<string>").alias("g"))
    return back.select("g.name", "g.definition")


@query("chunk_documents", "W9 W10 F26")
def chunked(spark, sf):
    return ch.chunk(table(spark, sf, "documents").select("doc_id", "text"), 1500, 100, "\n").select("doc_id", "ordinal", "char_start", "char_end", "token_count")


@query("chunk_chain", "W11", "SELECT 'HAS_CHUNK' AS type, COUNT(*) AS n FROM conversations UNION ALL SELECT 'NEXT', COUNT(*) - COUNT(DISTINCT conv_id) FROM conversations")
def chain(spark, sf):
    """Conversations as documents, their turns as chunks."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), F.concat_ws("_chunk_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"))
    return ch.document_layer(c)[1].groupBy("type").agg(N().alias("n"))


@query("fallback_entities", "X35", r"SELECT name AS dst, COUNT(*) AS n FROM (SELECT item_id, unnest(list_distinct(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', ' ', 'g'), '\b([A-Z][a-z]{2,})\b', 1))) AS name FROM benchmark) GROUP BY 1")
def fallback(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.regexp_replace("text", r"[^\x00-\x7F]", " ").alias("text"))
    return ch.fallback_extraction(b)[1].groupBy("dst").agg(N().alias("n"))


@query("fact_triples", "F28", "SELECT p_partkey AS doc_id, 'Acme Corp' AS s, 'did buy' AS p, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS o FROM part UNION ALL SELECT p_partkey, 'The ' || upper(p_type[1]) || lower(p_type[2:]), 'was made by', 'Zed' FROM part")
def triples(spark, sf):
    said = F.concat(F.lit("Acme Corp did buy "), F.initcap("p_name"), F.lit(". nothing here. The "), F.initcap("p_type"), F.lit(" was made by Zed."))
    return ch.facts(table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), said.alias("text")))


@query("payload_normalised", "X33 X36", "SELECT p_brand AS label, string_agg(DISTINCT w, ',' ORDER BY w) AS words FROM (SELECT p_brand, unnest(string_split(lower(p_name), ' ')) AS w FROM part) GROUP BY 1")
def payload(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("identifier"), F.col("p_brand").alias("type"), F.col("p_name").alias("title"))
    return ch.hints(ch.normalise_payload(p))
