"""Graph pattern shapes on the demo graph."""

from pyspark.sql import functions as F

from weftgraph.operators import shapes as s
from weftgraph.plans.demo import TRANSFERS, table
from weftgraph.plans.graph import demo_graph
from weftgraph.registry import query

Spec = s.Spec


def _run(spark, sf, **spec):
    return s.run(demo_graph(spark, sf), Spec(**spec))


@query("entity_lookup_exact", "G1 P2 P4 P5", "SELECT 'Customer:' || c_custkey AS id, c_name AS name, c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment, 'ws' || (c_nationkey % 3) AS workspace FROM customer WHERE c_custkey = 42")
def lookup_exact(spark, sf):
    return _run(spark, sf, shape="entity_lookup", label="Customer", mention="42").drop("superseded_by")


@query("entity_lookup_contains", "G1 P1 P10 T1", "SELECT 'Part:' || p_partkey AS id, p_name AS name, p_size AS size FROM part WHERE contains(lower(p_name), 'ring') ORDER BY id LIMIT 50")
def lookup_contains(spark, sf):
    return _run(spark, sf, shape="entity_contains", label="Part", mention="Ring", limit=80).select("id", "name", "size")


@query("entity_lookup_in", "G10 P3", "SELECT DISTINCT n_name AS name, 'Nation' AS label FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey IN (1, 2, 3, 77) ORDER BY name LIMIT 20")
def lookup_in(spark, sf):
    return _run(spark, sf, shape="list_all", label="Customer", mention="1, 2 3,77 x9", relation="LOCATED_IN")


REL = f"WITH {TRANSFERS} SELECT DISTINCT 'Customer:' || src AS source, 'Supplier:' || dst AS target, 'TRANSFER' AS relation, {{other}} FROM transfers {{join}} WHERE {{where}} ORDER BY source, target LIMIT 50"


@query("relationship_out", "G2 P8 P13", REL.format(other="'Supplier' AS other_label, s_name AS other_name", join="JOIN supplier ON s_suppkey = dst", where="src = 7"))
def rel_out(spark, sf):
    return _run(spark, sf, shape="relationship_lookup", label="Customer", mention="7", target_label="Supplier", relation="TRANSFER", limit=50)


@query("relationship_in", "G2", REL.format(other="'Customer' AS other_label, c_name AS other_name", join="JOIN customer ON c_custkey = src", where="dst = 3"))
def rel_in(spark, sf):
    return _run(spark, sf, shape="relationship_lookup", label="Supplier", mention="3", target_label="Customer", relation="TRANSFER", limit=50)


@query("relationship_undirected", "G2", "SELECT 'Nation:' || n_nationkey AS source, 'Region:' || n_regionkey AS target, 'IN_REGION' AS relation, 'Region' AS other_label, r_name AS other_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey = 5")
def rel_either(spark, sf):
    return _run(spark, sf, shape="relationship_lookup", label="Nation", mention="5", relation="IN_REGION", role="either", limit=50)


@query("neighbors_typed", "G3 P7", f"WITH {TRANSFERS} SELECT DISTINCT s_name AS neighbor, 'Supplier' AS label FROM transfers JOIN supplier ON s_suppkey = dst WHERE src = 11 ORDER BY neighbor LIMIT 20")
def near_typed(spark, sf):
    return _run(spark, sf, shape="neighbors", label="Customer", mention="11", relation="TRANSFER")


@query("neighbors_collected", "G4 G15 A6", f"WITH {TRANSFERS}, e AS (SELECT DISTINCT 'TRANSFER' AS type, s_name AS neighbor, 'Supplier' AS label FROM transfers JOIN supplier ON s_suppkey = dst WHERE src = 11 UNION SELECT 'LOCATED_IN', n_name, 'Nation' FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 11), r AS (SELECT *, row_number() OVER (ORDER BY type, neighbor, label) AS r FROM e) SELECT 'Customer:11' AS id, 'Customer#000000011' AS name, string_agg(type || '|' || neighbor || '|' || label, ';' ORDER BY type || '|' || neighbor || '|' || label) AS neighbors FROM r WHERE r <= 20")
def near_collected(spark, sf):
    return _run(spark, sf, shape="neighbors", label="Customer", mention="11")


@query("count_anchored", "G8", f"WITH {TRANSFERS} SELECT COUNT(DISTINCT src) AS n FROM transfers WHERE dst = 9")
def count_anchored(spark, sf):
    return _run(spark, sf, shape="count", label="Supplier", mention="9", relation="TRANSFER")


@query("count_label", "G9 P6 J1", "SELECT COUNT(*) AS n FROM customer WHERE c_nationkey % 3 = 1")
def count_label(spark, sf):
    return _run(spark, sf, shape="count", label="Customer", workspace="ws1")


@query("list_label", "G11", "SELECT p_name AS name, 'Part' AS label FROM part ORDER BY name LIMIT 20")
def list_label(spark, sf):
    return _run(spark, sf, shape="list_all", label="Part")


@query("shortest_path_region", "G5 G6 G7", "SELECT 'Customer:5' AS start, 'Region:' || r_regionkey AS \"end\", 2 AS hops, 'Customer:5,Nation:' || n_nationkey || ',Region:' || r_regionkey AS nodes, 'LOCATED_IN,IN_REGION' AS types FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_custkey = 5")
def shortest(spark, sf):
    return _run(spark, sf, shape="path", label="Customer", mention="5", target_label="Region", target="", hops=2)


@query("path_pruned_by_schema", "G6", "SELECT '' AS start, '' AS \"end\", 0 AS hops, '' AS nodes, '' AS types WHERE FALSE")
def pruned(spark, sf):
    return _run(spark, sf, shape="path", label="Part", mention="1", target_label="Region", hops=4)


@query("shortest_path_nation", "G5", "SELECT DISTINCT 'Customer:5' AS start, 'Nation:' || n_nationkey AS \"end\", 1 AS hops, 'Customer:5,Nation:' || n_nationkey AS nodes, 'LOCATED_IN' AS types FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 5")
def path_nation(spark, sf):
    return _run(spark, sf, shape="path", label="Customer", mention="5", target_label="Nation", hops=1)


def _facts(spark, sf):
    """Totals of a nation's customers by year, as company facts."""
    o = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_totalprice")
    c, n = table(spark, sf, "customer").select("c_custkey", "c_nationkey"), table(spark, sf, "nation")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.col("n_name").alias("company"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("ticker"), "year").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value")).withColumn("metric", F.lit("Total Revenue"))


FACTS = "facts AS (SELECT n_name AS company, 'N' || n_nationkey AS ticker, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value, 'Total Revenue' AS metric FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"


@query("financial_metric_lookup", "G12 P15", f"WITH {FACTS} SELECT company, ticker, year, value, metric, 0 AS rank FROM facts WHERE ticker = 'N3' AND year IN (1997, 1998) ORDER BY company, year LIMIT 20")
def metric_lookup(spark, sf):
    return s.metric_lookup(_facts(spark, sf), "n3", (1997, 1998), ("revenue",), 20).where("ticker = 'N3'")


@query("financial_metric_delta", "G13 F15", f"WITH {FACTS}, d AS (SELECT company, metric, MAX(value) FILTER (WHERE year = 1996) AS first, MAX(value) FILTER (WHERE year = 1999) AS last FROM facts GROUP BY 1, 2) SELECT company, metric, first, last, round(last - first, 2) AS delta, round(100 * (last - first) / abs(first), 4) AS percent FROM d WHERE first IS NOT NULL AND last IS NOT NULL")
def metric_delta(spark, sf):
    return s.metric_delta(_facts(spark, sf), 1996, 1999)


@query("observation_lookup", "G14 F17", f"WITH {FACTS} SELECT ticker AS entity, 'revenue' AS concept, 'fiscal:' || year || ':FY' AS period, 'fiscal' AS basis, value FROM facts WHERE ticker = 'N4' AND year IN (1996, 1997)")
def observation(spark, sf):
    obs = _facts(spark, sf).select(F.col("ticker").alias("entity"), F.lit("revenue").alias("concept"), F.concat(F.lit("fiscal:"), F.col("year").cast("string"), F.lit(":FY")).alias("period"), F.lit("fiscal").alias("basis"), "value")
    return s.observation_lookup(obs, "N4", "revenue", ["fiscal:1996:FY", "fiscal:1997:FY"], "fiscal")


@query("optional_chain", "G16 G17 G21", "SELECT c_custkey, n_name AS nation, r_name AS region, COUNT(o_orderkey) AS orders FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey > 1 LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY ALL")
def optional(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey")
    own = s.optional_chain(c, (table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")), (table(spark, sf, "region").where("r_regionkey > 1"), F.col("r_regionkey") == F.col("n_regionkey")), (o, F.col("o_custkey") == F.col("c_custkey")))
    return own.groupBy("c_custkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region")).agg(F.count("o_orderkey").alias("orders"))


@query("label_distribution", "G18 G20", "SELECT 'Customer' AS label, COUNT(*) AS n FROM customer UNION ALL SELECT 'Supplier', COUNT(*) FROM supplier UNION ALL SELECT 'Part', COUNT(*) FROM part UNION ALL SELECT 'Nation', COUNT(*) FROM nation UNION ALL SELECT 'Region', COUNT(*) FROM region")
def distribution(spark, sf):
    return s.label_distribution(demo_graph(spark, sf))


@query("bounded_label_counts", "A15 R11", "SELECT label, least(n, 500) AS n, n >= 500 AS sampled FROM (SELECT 'Customer' AS label, COUNT(*) AS n FROM customer UNION ALL SELECT 'Supplier', COUNT(*) FROM supplier UNION ALL SELECT 'Part', COUNT(*) FROM part UNION ALL SELECT 'Nation', COUNT(*) FROM nation UNION ALL SELECT 'Region', COUNT(*) FROM region)")
def bounded(spark, sf):
    return s.bounded_counts(demo_graph(spark, sf), 500)


@query("rdf_resource_match", "G19", "SELECT 'p' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN 'urn:part:' || p_partkey END AS uri FROM part WHERE (p_brand = 'Brand#3' OR p_partkey % 2 = 0) AND contains('p' || p_partkey, '19') ORDER BY name LIMIT 20")
def resources(spark, sf):
    rows = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), F.array("p_brand").alias("labels"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("urn:part:"), F.col("p_partkey").cast("string"))).alias("uri"))
    return s.resource_match(rows, ["Brand#3"], "19", ["name"], 20).select("name", "uri")


@query("truncated_expansion", "G27", f"WITH {TRANSFERS}, one AS (SELECT DISTINCT dst FROM (SELECT * FROM transfers WHERE src = 7 ORDER BY ts DESC, src, dst LIMIT 3)) SELECT dst AS node FROM one")
def truncated(spark, sf):
    from weftgraph.plans.demo import transfers

    return s.truncated_expansion(transfers(spark, sf), spark.createDataFrame([(7,)], "node long"), 1, 3)


@query("event_chain", "G23 X25", "SELECT event_id AS sequence, event_type FROM events WHERE user_id = 5 ORDER BY event_id LIMIT 10")
def chain(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("sequence"), "user_id", "event_type")
    return s.event_chain(e, "user_id", 5, 10).select("sequence", "event_type")


@query("multi_plan_fusion", "G25 V6", "WITH a AS (SELECT 'Part:' || p_partkey AS id FROM part WHERE contains(lower(p_name), 'ring') ORDER BY id LIMIT 20), b AS (SELECT 'Part:' || p_partkey AS id FROM part WHERE contains(lower(p_name), 'red') ORDER BY id LIMIT 20), r AS (SELECT id, row_number() OVER (ORDER BY id) AS r FROM a UNION ALL SELECT id, row_number() OVER (ORDER BY id) FROM b) SELECT id, round(SUM(1.0 / (60 + r)), 8) AS score FROM r GROUP BY id")
def fusion(spark, sf):
    specs = [Spec(shape="entity_contains", label="Part", mention=m) for m in ("ring", "red")]
    return s.multi_plan(demo_graph(spark, sf), specs, "id").withColumn("score", F.round("score", 8))


@query("risk_preflight_hops", "G22 D12 J5", "WITH t AS (SELECT o_custkey AS c, MAX(CASE WHEN o_totalprice > 450000 THEN 1 ELSE 0 END) AS direct FROM orders GROUP BY 1), n AS (SELECT c_nationkey, MAX(direct) AS near FROM t JOIN customer ON c_custkey = c GROUP BY 1) SELECT c_custkey, CASE WHEN direct = 1 THEN 'block' WHEN near = 1 THEN 'review' ELSE 'allow' END AS disposition FROM customer JOIN t ON c = c_custkey JOIN n USING (c_nationkey)")
def preflight(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.max((F.col("o_totalprice") > 450_000).cast("int")).alias("direct"))
    own = table(spark, sf, "customer").join(o, F.col("c") == F.col("c_custkey"))
    near = own.groupBy("c_nationkey").agg(F.max("direct").alias("near"))
    return own.join(near, "c_nationkey").select("c_custkey", F.when(F.col("direct") == 1, "block").when(F.col("near") == 1, "review").otherwise("allow").alias("disposition"))
