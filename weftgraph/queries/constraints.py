"""Checks, rules and axioms on the demo graph."""

from pyspark.sql import functions as F

from weftgraph.operators import constraints as c
from weftgraph.plans.demo import TRANSFERS, table, transfers
from weftgraph.plans.graph import demo_graph, key
from weftgraph.plans.ontology import DEMO
from weftgraph.registry import query


def _payload(spark, sf):
    """Customers as raw payload nodes, and their edges to nations."""
    cu = table(spark, sf, "customer")
    label = F.when(F.col("c_custkey") % 97 == 0, "Client").otherwise("Customer")
    props = F.create_map(F.lit("id"), F.col("c_custkey").cast("string"), F.lit("name"), F.when(F.col("c_custkey") % 10 == 3, "").otherwise(F.col("c_name")), F.lit("balance"), F.when(F.col("c_custkey") % 50 == 1, "n/a").otherwise(F.col("c_acctbal").cast("string")), F.lit("segment"), F.col("c_mktsegment"))
    nodes = cu.select(key("Customer", F.col("c_custkey")).alias("id"), label.alias("label"), props.alias("props"))
    nations = table(spark, sf, "nation").where("n_nationkey < 20").select(key("Nation", F.col("n_nationkey")).alias("id"), F.lit("Nation").alias("label"), F.create_map(F.lit("id"), F.col("n_nationkey").cast("string")).alias("props"))
    edges = cu.select(key("Customer", F.col("c_custkey")).alias("src"), key("Nation", F.col("c_nationkey")).alias("dst"), F.lit("LOCATED_IN").alias("type"))
    again = cu.where("c_custkey % 25 = 0").select(key("Customer", F.col("c_custkey")).alias("src"), key("Nation", (F.col("c_nationkey") + 1) % 20).alias("dst"), F.when(F.col("c_custkey") % 2 == 0, "LOCATED_IN").otherwise("LIVES_IN").alias("type"))
    return nodes.unionByName(nations), edges.unionByName(again)


@query("extraction_violations", "R2 R3 R9", """WITH k AS (SELECT *, CASE WHEN c_custkey % 97 = 0 THEN 'Client' ELSE 'Customer' END AS label FROM customer),
e AS (SELECT c_custkey, c_nationkey AS d, 'LOCATED_IN' AS type FROM customer UNION ALL SELECT c_custkey, (c_nationkey + 1) % 20, CASE WHEN c_custkey % 2 = 0 THEN 'LOCATED_IN' ELSE 'LIVES_IN' END FROM customer WHERE c_custkey % 25 = 0),
v AS (SELECT 'unknown_label' AS kind FROM k WHERE label = 'Client'
UNION ALL SELECT 'missing_required' FROM k WHERE label = 'Customer' AND c_custkey % 10 = 3
UNION ALL SELECT 'datatype' FROM k WHERE label = 'Customer' AND c_custkey % 50 = 1
UNION ALL SELECT 'range' FROM k WHERE label = 'Customer' AND (c_custkey % 50 = 1 OR c_acctbal < -1000 OR c_acctbal > 10000)
UNION ALL SELECT 'unknown_relationship' FROM e WHERE type = 'LIVES_IN'
UNION ALL SELECT 'dangling' FROM e WHERE d >= 20
UNION ALL SELECT 'endpoint' FROM e WHERE type = 'LOCATED_IN' AND d < 20 AND c_custkey % 97 = 0
UNION ALL SELECT 'cardinality' FROM (SELECT c_custkey FROM e WHERE type = 'LOCATED_IN' GROUP BY 1 HAVING COUNT(*) > 1))
SELECT kind, COUNT(*) AS n FROM v GROUP BY kind""")
def violations(spark, sf):
    return c.violations(DEMO, *_payload(spark, sf)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("type_scores", "R4", """SELECT score, COUNT(*) AS n FROM (SELECT round((CASE WHEN c_custkey % 97 = 0 THEN 2.0 ELSE 1.0 + CASE WHEN c_custkey % 10 = 3 THEN 0.0 ELSE 1.0 END + CASE WHEN c_custkey % 50 = 1 THEN 0.75 ELSE 1.0 END END) / 3, 3) AS score FROM customer) GROUP BY score""")
def scores(spark, sf):
    nodes, _ = _payload(spark, sf)
    return c.score(DEMO, nodes.where("label <> 'Nation'")).groupBy("score").agg(F.count(F.lit(1)).alias("n"))


@query("annotated_labels", "R5 R30 R33", "SELECT CASE WHEN c_custkey % 97 = 0 THEN 'Entity' ELSE 'Customer' END AS coerced, c_custkey % 97 = 0 AS out_of_ontology, COUNT(*) AS n FROM customer GROUP BY 1, 2")
def annotated(spark, sf):
    nodes, _ = _payload(spark, sf)
    return c.annotate(DEMO, nodes.where("label <> 'Nation'")).groupBy("coerced", "out_of_ontology").agg(F.count(F.lit(1)).alias("n"))


def _long(spark, sf):
    p = table(spark, sf, "part")
    pairs = F.explode(F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"), F.lit("type"), F.when(F.col("p_partkey") % 30 != 0, F.col("p_type")))).alias("prop", "value")
    return p.select(F.lit("Part").alias("label"), F.col("p_partkey").alias("id"), pairs)


RULES = "l AS (SELECT p_partkey AS id, 'brand' AS prop, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT p_partkey, 'type', CASE WHEN p_partkey % 30 <> 0 THEN p_type END FROM part)"


@query("rule_inference", "R6 R31", f"WITH {RULES}, n AS (SELECT COUNT(DISTINCT id) AS n FROM l), f AS (SELECT prop, COUNT(value) AS filled, COUNT(DISTINCT value) AS values, MIN(TRY_CAST(value AS DOUBLE)) AS low, MAX(TRY_CAST(value AS DOUBLE)) AS high FROM l WHERE value IS NOT NULL GROUP BY prop) SELECT 'Part' AS label, prop, round(filled / n, 4) AS share, filled / n >= 0.98 AS required, CASE WHEN prop = 'size' THEN 'integer' ELSE 'string' END AS type, values, values <= 20 AND values <= greatest(2, floor(0.2 * filled)) AS enum, low, high FROM f, n")
def rules(spark, sf):
    return c.infer_rules(_long(spark, sf))


@query("rule_violations", "R7 R8 S32", f"WITH {RULES} SELECT 'Part' AS label, prop, COUNT(*) FILTER (WHERE CASE WHEN prop = 'size' THEN CAST(value AS INTEGER) BETWEEN 2 AND 40 ELSE value IS NOT NULL END) AS passed, COUNT(*) FILTER (WHERE NOT CASE WHEN prop = 'size' THEN CAST(value AS INTEGER) BETWEEN 2 AND 40 ELSE value IS NOT NULL END) AS failed FROM l GROUP BY prop")
def rule_violations(spark, sf):
    own = spark.createDataFrame([("Part", "brand", "string", None, None), ("Part", "size", "integer", 2.0, 40.0), ("Part", "type", "string", None, None)], "label string, prop string, type string, low double, high double")
    return c.apply_rules(_long(spark, sf), own)


@query("rule_sql", "R8 S32", "SELECT p_partkey FROM part WHERE p_size > 30 OR p_size < 5")
def rule_sql(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("weft_part")
    return spark.sql(c.violation_sql("weft_part", "p_size", {"type": "integer", "low": 5, "high": 30})).select("p_partkey")


@query("unique_violations", "R10", "SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def unique(spark, sf):
    return c.duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("ontology_coverage", "R11 X13", "SELECT 'label' AS kind, 'Customer' AS name, COUNT(*) AS n FROM customer UNION ALL SELECT 'label', 'Supplier', COUNT(*) FROM supplier UNION ALL SELECT 'label', 'Part', COUNT(*) FROM part UNION ALL SELECT 'label', 'Nation', COUNT(*) FROM nation UNION ALL SELECT 'label', 'Region', COUNT(*) FROM region UNION ALL SELECT 'label', 'Party', 0 UNION ALL SELECT 'type', 'TRANSFER', COUNT(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'type', 'LOCATED_IN', (SELECT COUNT(*) FROM customer) + (SELECT COUNT(*) FROM supplier) UNION ALL SELECT 'type', 'IN_REGION', COUNT(*) FROM nation")
def coverage(spark, sf):
    g = demo_graph(spark, sf)
    return c.coverage(DEMO, g.all_nodes(), g.all_edges())


@query("denormalized_customer", "R12", "SELECT 'Customer:' || c_custkey AS id, c_name AS name, n_name AS nation_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def denormalised(spark, sf):
    g = demo_graph(spark, sf)
    return c.denormalise(g.nodes["Customer"].select("id", "name"), g.edges["LOCATED_IN"], g.nodes["Nation"].select("id", "name"), "nation").select("id", "name", "nation_name")


@query("normalized_customer", "R13", "SELECT DISTINCT 'Nation:' || n_nationkey AS id, n_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def normalised(spark, sf):
    g = demo_graph(spark, sf)
    view = c.denormalise(g.nodes["Customer"].select("id", "name"), g.edges["LOCATED_IN"], g.nodes["Nation"].select("id", "name"), "nation")
    return c.normalise(view, "nation")[0]


@query("migrated_part", "R14", "SELECT p_partkey AS part_id, p_size AS _deleted_p_size, TIMESTAMP '2024-01-01 00:00:00' AS _deleted_at FROM part")
def migrated(spark, sf):
    return c.migrate(table(spark, sf, "part").select("p_partkey", "p_size"), {"p_partkey": "part_id"}, ["p_size"], "2024-01-01 00:00:00")


@query("induced_endpoints", "R21 A9", "SELECT 'IN_REGION' AS type, 'Nation' AS source, 'Region' AS target, COUNT(*) AS edges FROM nation UNION ALL SELECT 'LOCATED_IN', 'Customer', 'Nation', (SELECT COUNT(*) FROM customer) + (SELECT COUNT(*) FROM supplier)")
def induced(spark, sf):
    g = demo_graph(spark, sf)
    return c.induce(g.all_nodes(), g.all_edges(["LOCATED_IN", "IN_REGION"]))


@query("mined_axioms", "R22", f"WITH {TRANSFERS}, e AS (SELECT DISTINCT src, dst FROM transfers), f AS (SELECT COUNT(*) AS sources, avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END) AS functional FROM (SELECT src, COUNT(*) AS n FROM e GROUP BY src)), i AS (SELECT COUNT(*) AS targets, avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END) AS inverse FROM (SELECT dst, COUNT(*) AS n FROM e GROUP BY dst)) SELECT 'T' AS type, sources, targets, round(functional, 4) AS functional, round(inverse, 4) AS inverse, functional >= 0.95 AS is_functional, inverse >= 0.95 AS is_inverse FROM f, i")
def axioms(spark, sf):
    return c.mine_axioms(transfers(spark, sf).select(F.lit("T").alias("type"), "src", "dst"))


@query("disjoint_segments", "R22", "WITH m AS (SELECT DISTINCT c_nationkey AS id, c_mktsegment AS label FROM customer WHERE c_acctbal > 9000), s AS (SELECT DISTINCT label FROM m) SELECT a.label AS a, b.label AS b FROM s a JOIN s b ON a.label < b.label WHERE NOT EXISTS (SELECT 1 FROM m x JOIN m y ON x.id = y.id AND x.label = a.label AND y.label = b.label)")
def disjoint(spark, sf):
    return c.disjoint_labels(table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("id"), F.col("c_mktsegment").alias("label")))


@query("composition_rule", "R23", f"WITH {TRANSFERS}, b AS (SELECT DISTINCT src AS x, s_nationkey AS z FROM transfers JOIN supplier ON s_suppkey = dst), h AS (SELECT c_custkey AS x, c_nationkey AS z FROM customer) SELECT COUNT(*) AS body, COUNT(h.x) AS head, COUNT(h.x) / COUNT(*) AS confidence FROM b LEFT JOIN h USING (x, z)")
def composed(spark, sf):
    s, cu = table(spark, sf, "supplier"), table(spark, sf, "customer")
    return c.compositions(transfers(spark, sf), s.select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").alias("dst")), cu.select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("dst")))


@query("entailed_edges", "R24", "SELECT type, COUNT(*) AS n, TRUE AS entailed FROM (SELECT DISTINCT c_nationkey, c_custkey, 'HOSTS' AS type FROM customer UNION SELECT c_custkey, c_nationkey, 'KNOWS_PLACE' FROM customer) GROUP BY type")
def entailed(spark, sf):
    e = table(spark, sf, "customer").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").cast("long").alias("dst"), F.lit("LOCATED_IN").alias("type"))
    return c.entail(e, {"LOCATED_IN": "KNOWS_PLACE"}, {"LOCATED_IN": "HOSTS"}).groupBy("type", "entailed").agg(F.count(F.lit(1)).alias("n"))


@query("ambiguous_names", "R25", "SELECT p_name AS surface, COUNT(DISTINCT p_partkey) AS entities, COUNT(*) AS n, MIN(p_partkey) AS least FROM part GROUP BY p_name HAVING COUNT(DISTINCT p_partkey) > 1")
def ambiguous(spark, sf):
    return c.ambiguous(table(spark, sf, "part").select(F.col("p_name").alias("surface"), F.col("p_partkey").alias("id")))


@query("drift_summary", "R28", "SELECT COUNT(DISTINCT CASE WHEN n_chars % 11 <> 0 THEN lang END) AS hashes, COUNT(*) FILTER (WHERE n_chars % 11 = 0) AS missing, COUNT(*) FILTER (WHERE n_chars % 11 <> 0 AND lang <> 'en') AS stale FROM documents")
def drift(spark, sf):
    return c.drift(table(spark, sf, "documents").select(F.when(F.col("n_chars") % 11 != 0, F.col("lang")).alias("hash")), "en")


@query("freshness_decision", "R29", "SELECT CASE WHEN a <= 86400 THEN 'serve' WHEN a <= 604800 THEN 'repair' ELSE 'refuse' END AS decision, COUNT(*) AS n FROM (SELECT CAST(epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(ts)) AS BIGINT) AS a FROM events) GROUP BY 1")
def fresh(spark, sf):
    from weftgraph.plans.demo import epoch

    age = F.lit(1_706_745_600) - epoch("ts")
    return table(spark, sf, "events").groupBy(c.freshness(age, 86_400, 604_800).alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@query("shaped_properties", "R32", "SELECT c_custkey, COALESCE(CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END, 'NONE') AS segment, greatest(0.0, least(1.0, c_acctbal / 5000)) AS score, c_name || ' ' || COALESCE(CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END, 'NONE') AS embedding_text FROM customer")
def shaped(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).alias("segment"), (F.col("c_acctbal") / 5000).alias("score"))
    return c.shape_properties(rows, {"segment": "NONE"}, ["score"], ["c_name", "segment"]).drop("c_name")


@query("temporal_sanity", "R34 W-4", "WITH r AS (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT COUNT(*) FILTER (WHERE ts > TIMESTAMP '2024-01-20 00:00:00') AS future, COUNT(*) FILTER (WHERE value > 15) AS inverted, COUNT(*) FILTER (WHERE event_type = 'error') AS orphan, 0 AS stale, COUNT(*) FILTER (WHERE event_id <= b) AS non_monotone FROM r")
def temporal(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.when(F.col("event_type") != "error", F.lit("r")).alias("run"), F.col("event_id").alias("version"), F.col("value").alias("starts"), F.lit(15.0).alias("ends"), F.col("ts").alias("seen"))
    return c.sanity(e, "2024-01-20 00:00:00")


@query("compatibility_atoms", "R15 R16 T8", "WITH o AS (SELECT DISTINCT p_brand AS l, p_type AS p FROM part WHERE p_size <= 45), n AS (SELECT DISTINCT p_brand AS l, p_type AS p FROM part WHERE p_size >= 5), a AS (SELECT 'label ' || l AS x, '' AS v FROM o UNION SELECT 'property ' || l || '.' || p, CASE WHEN p = 'STANDARD' THEN 'required' ELSE '' END FROM o), b AS (SELECT 'label ' || l AS x, '' AS v FROM n UNION SELECT 'property ' || l || '.' || p, CASE WHEN p = 'STANDARD' THEN 'required' ELSE '' END FROM n) SELECT COALESCE(a.x, b.x) AS atom, CASE WHEN b.x IS NULL THEN 'BREAKING' WHEN b.v = 'required' THEN 'FORWARD' ELSE 'BACKWARD' END AS kind FROM a FULL JOIN b ON a.x = b.x WHERE a.x IS NULL OR b.x IS NULL")
def compatibility(spark, sf):
    """Two schemas read from the parts: brands are labels, types their properties."""
    p = table(spark, sf, "part")

    def schema(of):
        rows = p.where(of).select(F.col("p_brand").alias("label"), F.col("p_type").alias("prop"), (F.col("p_type") == "STANDARD").alias("required")).distinct()
        return c.schema_atoms(rows)

    return c.classify_atoms(schema("p_size <= 45"), schema("p_size >= 5"))


KINDS = "k AS (SELECT DISTINCT p_brand AS child, p_type AS parent FROM part UNION SELECT DISTINCT p_type, 'size ' || (p_size // 10) FROM part)"


def _kinds(spark, sf):
    """Brands as kinds of types, types as kinds of decades of sizes."""
    p = table(spark, sf, "part")
    size = F.concat(F.lit("size "), F.floor(F.col("p_size") / 10).cast("string"))
    return p.select(F.col("p_brand").alias("child"), F.col("p_type").alias("parent")).unionByName(p.select(F.col("p_type").alias("child"), size.alias("parent"))).distinct()


CLOSED = f"WITH RECURSIVE {KINDS}, r(label, ancestor) AS (SELECT child, child FROM k UNION SELECT parent, parent FROM k UNION SELECT r.label, k.parent FROM r JOIN k ON k.child = r.ancestor)"


@query("isa_closure", "X14", f"{CLOSED} SELECT label, ancestor FROM r")
def isa(spark, sf):
    return c.closure(_kinds(spark, sf))


@query("alias_bridge", "X15", f"{CLOSED} SELECT label, 'thing of ' || ancestor AS alias FROM r WHERE starts_with(ancestor, 'size ')")
def bridge(spark, sf):
    """A term given to a root is one of all that are kinds of it."""
    k = c.closure(_kinds(spark, sf))
    terms = k.where("ancestor like 'size %'").select(F.col("ancestor").alias("root"), F.concat(F.lit("thing of "), "ancestor").alias("alias")).distinct()
    return c.bridged(k, terms)


@query("root_candidates", "X16", f"{CLOSED} SELECT ancestor AS root, COUNT(*) - 1 AS descendants FROM r GROUP BY 1 HAVING COUNT(*) > 1 ORDER BY descendants DESC, root LIMIT 5")
def roots(spark, sf):
    return c.root_candidates(c.closure(_kinds(spark, sf)), 5)


NEAR = "abs({0} - {1}) <= 0.005 * greatest(abs({0}), abs({1}))"


@query("grounded_numbers", "R35 F29", f"WITH v AS (SELECT o_orderkey, round(o_totalprice * CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1.001 END, 2) AS x, 1000.0 * (o_custkey % 50) AS y, o_totalprice AS a, 1000.0 * (o_orderkey % 50) AS b FROM orders WHERE o_totalprice > 1000) SELECT o_orderkey, (CASE WHEN {NEAR.format('x', 'a')} OR {NEAR.format('x', 'b')} THEN 1 ELSE 0 END + CASE WHEN {NEAR.format('y', 'a')} OR {NEAR.format('y', 'b')} THEN 1 ELSE 0 END) / 2 AS grounded FROM v")
def grounded(spark, sf):
    """An answer's two numbers, read from text, against its source's: the total (wrong in
    a third of the orders) and a rounded thousand."""
    from weftgraph.functions.text import numbers_in

    wrong = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice") * 1.001)
    said = F.concat(F.format_string("%.2f", wrong), F.lit(" and "), (F.col("o_custkey") % 50).cast("string"), F.lit(" thousand"))
    source = F.array(F.col("o_totalprice"), (F.col("o_orderkey") % 50) * 1000.0)
    return table(spark, sf, "orders").where("o_totalprice > 1000").select("o_orderkey", c.grounded_numbers(numbers_in(said), source).alias("grounded"))
