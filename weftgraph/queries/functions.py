"""Scalar functions on the driver tables."""

from pyspark.sql import functions as F

from weftgraph.functions import text as x
from weftgraph.plans.demo import table
from weftgraph.registry import query


@query("content_hash", "F19 F4", r"SELECT doc_id, substr(sha256(regexp_replace(lower(trim(text)), '\s+', ' ', 'g')), 1, 16) AS hash FROM documents WHERE text NOT SIMILAR TO '[\n\t\r].*|.*[\n\t\r]'")
def content_hash(spark, sf):
    return table(spark, sf, "documents").where(~F.col("text").rlike(r"^[\n\t\r]|[\n\t\r]$")).select("doc_id", x.content_hash("text").alias("hash"))


@query("normalise_symbol", "F2", "SELECT p_partkey, regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '', 'g') AS symbol FROM part")
def symbol(spark, sf):
    return table(spark, sf, "part").select("p_partkey", x.normalise_symbol(F.concat_ws(" ", "p_brand", "p_name")).alias("symbol"))


@query("name_key", "F5 P10", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'acme ' ELSE '' END || p_name || ' ' || p_partkey AS key FROM part")
def name_key(spark, sf):
    said = F.concat(F.when(F.col("p_partkey") % 2 == 0, "The ACME, ").otherwise("the "), F.initcap("p_name"), F.lit(", "), F.col("p_partkey").cast("string"), F.when(F.col("p_size") > 25, " Holdings Inc.").otherwise(", LLC"))
    return table(spark, sf, "part").select("p_partkey", x.name_key(said).alias("key"))


@query("token_prefix", "F6", "WITH n AS (SELECT p_name AS k, COUNT(*) AS n FROM part GROUP BY 1), w AS (SELECT split_part(p_name, ' ', 1) AS k, COUNT(*) AS n FROM part GROUP BY 1) SELECT w.k AS a, n.k AS b, w.n AS parts_a, n.n AS parts_b FROM w JOIN n ON w.k = n.k OR starts_with(n.k, w.k || ' ')")
def token_prefix(spark, sf):
    """Pairs of names, each once with how many parts have it: first words and whole names."""
    p = table(spark, sf, "part").select("p_name", F.split("p_name", " ")[0].alias("block"))
    n = p.groupBy(F.col("p_name").alias("b"), "block").agg(F.count(F.lit(1)).alias("parts_b"))
    w = p.groupBy("block").agg(F.count(F.lit(1)).alias("parts_a")).withColumn("a", F.col("block"))
    return w.join(n, "block").where(x.token_prefix("a", "b")).select("a", "b", "parts_a", "parts_b")


TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> ''))"


@query("lexical_similarity", "F7 F8 F9", f"WITH t AS (SELECT p_partkey, {TOKENS.format('p_name')} AS a, {TOKENS.format('p_type || chr(32) || p_name')} AS b FROM part) SELECT p_partkey, round(0.6 * len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) + 0.4 * len(list_intersect(a, b)) / least(len(a), len(b)), 4) AS similarity FROM t")
def lexical(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", x.lexical_similarity(x.tokens("p_name"), x.tokens(F.concat_ws(" ", "p_type", "p_name"))).alias("similarity"))


@query("parse_money", "F11 F12 F13", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) * CASE o_orderkey % 3 WHEN 0 THEN 1000000.0 WHEN 1 THEN 1000.0 ELSE 1.0 END AS value, FALSE AS percent FROM orders WHERE o_totalprice >= 100")
def parse_money(spark, sf):
    plain = F.format_number("o_totalprice", 2)
    scaled = F.concat(F.lit("$"), plain, F.when(F.col("o_orderkey") % 3 == 0, " million").when(F.col("o_orderkey") % 3 == 1, "k").otherwise(""))
    said = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("("), scaled, F.lit(")"))).otherwise(scaled)
    v = x.parse_value(said)
    return table(spark, sf, "orders").where("o_totalprice >= 100").select("o_orderkey", v["value"].alias("value"), v["percent"].alias("percent"))


@query("coerce_year", "F14 P15", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def coerce_year(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", x.coerce_year(F.lit("no year"), F.concat(F.lit("FY"), F.date_format("o_orderdate", "yyyy"))).alias("year"))


@query("period_key", "F16", "SELECT o_orderkey, 'fiscal:' || year(o_orderdate) || ':Q' || quarter(o_orderdate) AS period FROM orders")
def period_key(spark, sf):
    said = F.concat(F.lit("in Q"), F.quarter("o_orderdate").cast("string"), F.lit(" of fiscal "), F.date_format("o_orderdate", "yyyy"))
    return table(spark, sf, "orders").select("o_orderkey", x.period_key(said).alias("period"))


@query("observation_key", "F18 W25", "SELECT o_orderkey, 'obs:' || substr(sha1(concat_ws(chr(1), CAST(o_custkey AS VARCHAR), 'total', CAST(year(o_orderdate) AS VARCHAR), 'USD', 'fiscal')), 1, 24) AS key FROM orders")
def observation_key(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", x.observation_key(F.col("o_custkey").cast("string"), F.lit("total"), F.date_format("o_orderdate", "yyyy"), F.lit("usd"), F.lit("Fiscal")).alias("key"))


@query("opaque_ref", "F20", "SELECT c_custkey, sha256(c_mktsegment || '|' || c_name) AS ref FROM customer")
def opaque(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.sha2(F.concat_ws("|", "c_mktsegment", "c_name"), 256).alias("ref"))


@query("shard_for", "F21 M10", "SELECT CAST(('0x' || substr(sha256(c_name), 1, 16))::UBIGINT % 16 AS INTEGER) AS shard, COUNT(*) AS n FROM customer GROUP BY 1")
def shard_for(spark, sf):
    return table(spark, sf, "customer").groupBy(x.shard_for("c_name", 16).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("golden_names", "F22 F23", "SELECT p_brand, max_by(p_name, (len(string_split(p_name, ' ')), length(p_name), p_name)) AS name, substr(sha256('v1' || chr(10) || string_agg(DISTINCT p_name, chr(10) ORDER BY p_name)), 1, 24) AS golden_id FROM part GROUP BY p_brand")
def golden(spark, sf):
    keys = F.array_join(F.array_sort(F.collect_set("p_name")), "\n")
    return table(spark, sf, "part").groupBy("p_brand").agg(F.max_by("p_name", x.canonical_rank("p_name")).alias("name"), F.substring(F.sha2(F.concat(F.lit("v1\n"), keys), 256), 1, 24).alias("golden_id"))


@query("staleness_penalty", "F24 F25", "SELECT o_orderkey, round(exp(-ln(2) * date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') / 365.0), 6) AS weight FROM orders")
def staleness(spark, sf):
    age = F.datediff(F.lit("2002-01-01").cast("date"), F.col("o_orderdate").cast("date"))
    return table(spark, sf, "orders").select("o_orderkey", F.round(x.staleness(age, 365.0), 6).alias("weight"))


@query("token_count", "F26", r"SELECT item_id, len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '')) AS n FROM benchmark")
def token_count(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", x.token_count("text").cast("long").alias("n"))


@query("citation_extraction", "F27", "SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN source || ',x' || (n_chars % 7) || '#' || (n_chars % 7) ELSE source || '#' || (n_chars % 7) END AS cited FROM documents")
def cited(spark, sf):
    """Marks with and without a chunk, and one that comes twice."""
    n = (F.col("n_chars") % 7).cast("string")
    whole = F.concat(F.lit("[src:x"), n, F.lit(", chunk:"), n, F.lit("]"))
    with_chunk = F.concat(F.lit("[src:"), F.col("source"), F.lit(", chunk:"), n, F.lit("]"))
    said = F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("as [src:"), F.col("source"), F.lit("] said and "), whole, whole)).otherwise(F.concat(F.lit("as said "), with_chunk, F.lit(" and "), with_chunk, F.lit(" not [src:a b]")))
    return table(spark, sf, "documents").select("doc_id", F.array_join(x.citations(said), ",").alias("cited"))


@query("semver_distance", "F33", "SELECT p_partkey, CAST(1000 * abs(p_size % 4 - 1) + abs(p_size % 10 - 3) AS INTEGER) AS distance FROM part")
def semver(spark, sf):
    v = F.concat_ws(".", (F.col("p_size") % 4).cast("string"), (F.col("p_size") % 10).cast("string"), F.lit("9"))
    return table(spark, sf, "part").select("p_partkey", x.version_distance(v, F.lit("1.3.0")).alias("distance"))


@query("mask_question", "F34 V9", "SELECT s_suppkey, 'what did <e> <n> pay <q> on ' || lower(CASE WHEN s_acctbal > 5000 THEN '<e>' ELSE 'monday' END) AS masked, s_name || ' x' AS entity FROM supplier")
def mask(spark, sf):
    day = F.when(F.col("s_acctbal") > 5000, F.lit("Monday")).otherwise("monday")
    q = F.concat(F.lit("what did Acme "), F.col("s_suppkey").cast("string"), F.lit(' pay "'), F.col("s_name"), F.lit(' x" on '), day)
    return table(spark, sf, "supplier").select("s_suppkey", x.mask_question(q).alias("masked"), F.array_join(x.question_entities(q), ",").alias("entity"))


@query("redacted_metadata", "F31 F32", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '[REDACTED]' AS token FROM events")
def redacted(spark, sf):
    m = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("api_key"), F.lit("s3cret")))
    r = table(spark, sf, "events").select("event_id", x.redact(m).alias("m"))
    return r.select("event_id", F.col("m")["k"].cast("long").alias("k"), F.col("m")["api_key"].alias("token"))


@query("gestalt_ratio", "F10")
def gestalt(spark, sf):
    return table(spark, sf, "part").select("p_partkey", x.gestalt_ratio("p_name", "p_type").alias("ratio"))


@query("mentions", "F35", "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)) WHERE b.text <> ''")
def mentions(spark, sf):
    names = table(spark, sf, "benchmark").select(F.col("item_id").alias("name_id"), F.col("text").alias("name"))
    found = x.mentions(table(spark, sf, "documents").select("doc_id", "text"), names)
    return found.select(F.col("name_id").alias("item_id"), "doc_id")


@query("answer_normalised", "F3", r"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_type || ', the (' || p_name || ')!'), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS answer FROM part")
def normalised_answer(spark, sf):
    return table(spark, sf, "part").select("p_partkey", x.normalise_answer(F.concat("p_type", F.lit(", the ("), "p_name", F.lit(")!"))).alias("answer"))


@query("overlap_scores", "F37", "WITH t AS (SELECT p_partkey, list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda w: w <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(p_type || ' ' || split_part(p_name, ' ', 1)), '[^a-z0-9]+'), lambda w: w <> '')) AS b FROM part) SELECT p_partkey, len(list_intersect(a, b)) / len(a) AS overlap FROM t")
def overlaps(spark, sf):
    first = F.split("p_name", " ")[0]
    return table(spark, sf, "part").select("p_partkey", x.overlap_score(x.tokens("p_name"), x.tokens(F.concat_ws(" ", "p_type", first))).alias("overlap"))


@query("slack_rendered", "F36", "SELECT conv_id, turn, trim('see ' || 'docs at http://a.b/' || turn || ' in #general from @U' || conv_id || ' ' || trim(role)) AS text FROM conversations")
def slack_rendered(spark, sf):
    t, c = F.col("turn").cast("string"), F.col("conv_id").cast("string")
    said = F.concat(F.lit("see <http://x.y|docs> at <http://a.b/"), t, F.lit("> in <#C1|general> from <@U"), c, F.lit("> "), F.trim("role"), F.lit(" "))
    return table(spark, sf, "conversations").select("conv_id", "turn", x.slack_text(said).alias("text"))
