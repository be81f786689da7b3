"""Guards, gates, schemas and files on the driver tables."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from weftgraph.operators import extras as x
from weftgraph.operators import guards as g
from weftgraph.operators import memory as m
from weftgraph.operators.analytics import projection_bytes
from weftgraph.operators.lineage import scratch
from weftgraph.operators.shapes import anchor
from weftgraph.plans import importers as im
from weftgraph.plans import scorecard as sc
from weftgraph.plans.demo import table
from weftgraph.plans.graph import demo_graph
from weftgraph.plans.ontology import DEMO, NodeType, Ontology, Property, RelationType, clean_taxonomy, context_slice, mean_distance, richness
from weftgraph.registry import query
from weftgraph.sources import readers as r


def _said(spark, sf):
    """A query text a part, of eight kinds by its size."""
    name = F.concat(F.lit("'"), "p_name", F.lit("'"))
    kinds = [
        F.lit("MATCH (n:Part) WHERE n.name = $name AND n.id = $node_id RETURN n.size LIMIT 10"),
        F.concat(F.lit("MATCH (n:"), F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_"), F.lit(") RETURN n.name LIMIT 5")),
        F.concat(F.lit("MATCH (n:Part) WHERE n.name = "), name, F.lit(" SET n.size = 1 RETURN n LIMIT 3")),
        F.lit("MATCH (a:Customer)-[:TRANSFER*..]->(b:Supplier) RETURN b"),
        F.lit("MATCH (a:Supplier)-[t:TRANSFER]->(b:Customer) RETURN count(a) LIMIT $limit"),
        F.lit("MATCH (a:Customer), (b:Supplier) RETURN a.colour LIMIT 9"),
        F.lit("match (a:Customer {workspace_id: $workspace_id})-[:TRANSFER*1..9]->(b:Supplier) WHERE a.id = $node_id return distinct b.name limit $limit"),
        F.concat(F.lit("MATCH (n:Customer)-[:LOCATED_IN]->(m:Nation) WHERE n.valid_from < 7 AND m.name CONTAINS \""), "p_type", F.lit("\" RETURN n.id LIMIT 500")),
    ]
    text = F.element_at(F.array(*kinds), (F.col("p_size") % 8 + 1).cast("int"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.alias("text"), F.lit(60).alias("limit"), F.create_map(F.lit("limit"), F.lit("60"), F.lit("node_id"), F.when(F.col("p_partkey") % 2 == 0, "7").otherwise(" "), F.lit("workspace_id"), F.lit("w")).alias("params"))


LIMITS = g.Limits(labels=tuple(DEMO.nodes), types=tuple(DEMO.relations), properties=("size", "balance", "valid_from"), ends={"TRANSFER": ("Customer", "Supplier")}, timed=("TRANSFER", "LOCATED_IN"), hops=4, rows=50, parameters=("node_id", "workspace_id"))


def _by_kind(cases: dict[int, list[str]], extra: str = "") -> str:
    """SQL: the findings of each kind of query, as rows of all its parts."""
    rows = ", ".join(f"({k}, '{f}')" for k, fs in cases.items() for f in fs)
    brand = "replace(finding, '@', regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g'))"
    said = f"replace(replace({brand}, '~', p_name), '^', p_type)"
    return f"SELECT p_partkey AS id, {said} AS finding{extra} FROM part JOIN (VALUES {rows}) AS k(kind, finding) ON p_size % 8 = kind"


BLOCKS = ", CASE WHEN split_part(finding, ':', 1) IN ('label', 'write', 'unbounded', 'direction') THEN 'block' ELSE 'warn' END AS severity"
WRITE = ["write:SET"]


@query("guarded_queries", "J2", _by_kind({1: ["label:@"], 2: WRITE, 3: ["limit", "unbounded", "time:TRANSFER"], 4: ["limit", "direction:TRANSFER", "distinct", "time:TRANSFER"], 5: ["property:colour", "cartesian"], 6: ["limit", "time:TRANSFER"]}, BLOCKS))
def guarded(spark, sf):
    return g.guard(_said(spark, sf), LIMITS)


@query("sliced_queries", "J3", _by_kind({1: ["no_bound_node", "unknown_labels:@"], 2: ["no_bound_node", "forbidden:set"], 3: ["no_bound_node", "unbounded", "no_limit"], 4: ["no_bound_node", "rows"], 5: ["no_bound_node", "unknown_properties:colour"], 6: ["hops", "rows"], 7: ["no_bound_node", "rows"]}))
def sliced(spark, sf):
    from dataclasses import replace

    return g.check_slice(_said(spark, sf), replace(LIMITS, properties=("size", "valid_from", "id", "name")))


@query("generated_queries", "J4", "WITH f AS (" + _by_kind({0: ["no_parameter_limit", "no_tenant"], 1: ["no_parameter_limit", "no_tenant", "unknown_labels:@"], 2: ["no_parameter_limit", "no_tenant", "forbidden:set", "literal:= ''~'',= 1"], 3: ["no_parameter_limit", "no_tenant", "unbounded"], 4: ["no_tenant"], 5: ["no_parameter_limit", "no_tenant", "unknown_properties:colour"], 6: ["hops"], 7: ["no_parameter_limit", "no_tenant", 'literal:< 7,CONTAINS "^"']}) + ") SELECT * FROM f UNION ALL SELECT p_partkey, 'rows' FROM part UNION ALL SELECT p_partkey, 'no_value:node_id' FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT p_partkey, 'no_parameter:node_id' FROM part WHERE p_size % 8 NOT IN (0, 6) UNION ALL SELECT p_partkey, 'no_parameter:workspace_id' FROM part WHERE p_size % 8 <> 6")
def generated(spark, sf):
    from dataclasses import replace

    return g.check_fallback(_said(spark, sf), replace(LIMITS, properties=("size", "valid_from", "id", "name")))


@query("plan_gate", "J10", "WITH p AS (SELECT p_partkey AS id, concat_ws(' ', CASE WHEN p_size % 3 = 0 AND p_partkey % 2 = 0 THEN 'scan:AllNodesScan' END, CASE WHEN p_size % 5 = 0 THEN 'product' END, CASE WHEN p_size > 40 THEN 'hits' END, CASE WHEN p_retailprice > 1500 THEN 'estimated' END, CASE WHEN p_size < 10 THEN 'milliseconds' END, CASE WHEN p_partkey % 7 = 0 THEN 'rows' END) AS reasons FROM part) SELECT id, reasons, reasons <> '' AS breached FROM p")
def gate(spark, sf):
    size = F.col("p_size")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array(F.when(size % 3 == 0, "AllNodesScan").otherwise("NodeIndexSeek"), F.when(size % 5 == 0, "CartesianProduct").otherwise("Filter")).alias("operators"), (size * 5000).alias("hits"), (F.col("p_retailprice") * 100 / 1.5).alias("estimated"), F.when(size < 10, 1500.0).otherwise(20.0).alias("milliseconds"), F.when(F.col("p_partkey") % 7 == 0, 5000).otherwise(10).alias("rows"), (F.col("p_partkey") % 2 == 1).alias("indexed"))
    return g.gate(p)


@query("plan_audit", "E10", "WITH o AS (SELECT user_id AS plan, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position, CASE event_type WHEN 'click' THEN 'AllNodesScan' WHEN 'purchase' THEN 'Sort' WHEN 'signup' THEN 'EagerAggregation' WHEN 'error' THEN 'VarLengthExpand(All)' ELSE 'Filter' END AS operator, event_type AS details, value AS estimated, CAST(event_id % 90 AS DOUBLE) AS actual FROM events) SELECT plan, substr(sha256(string_agg(operator || ':' || details, '|' ORDER BY position)), 1, 16) AS fingerprint, CAST(SUM(position) AS DOUBLE) AS hits, concat_ws(',', CASE WHEN bool_or(operator = 'EagerAggregation') THEN 'aggregation' END, CASE WHEN bool_or(starts_with(operator, 'VarLength')) THEN 'expansion' END, CASE WHEN bool_or(estimated > 0 AND (actual / estimated >= 10 OR (actual > 0 AND actual / estimated <= 0.1))) THEN 'misestimate' END, CASE WHEN bool_or(operator = 'AllNodesScan') THEN 'scan' END, CASE WHEN bool_or(operator = 'Sort') THEN 'sort' END) AS findings FROM o GROUP BY plan")
def plan_audit(spark, sf):
    """Users' events as the operators of plans."""
    from pyspark.sql import Window

    kind = F.col("event_type")
    name = F.when(kind == "click", "AllNodesScan").when(kind == "purchase", "Sort").when(kind == "signup", "EagerAggregation").when(kind == "error", "VarLengthExpand(All)").otherwise("Filter")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    o = table(spark, sf, "events").select(F.col("user_id").alias("plan"), place.alias("position"), name.alias("operator"), kind.alias("details"), F.col("value").alias("estimated"), (F.col("event_id") % 90).cast("double").alias("actual"), place.cast("double").alias("hits"))
    return g.audit(o)


@query("admitted_requests", "J14", "WITH q AS (SELECT event_id AS id, event_type AS lane, CAST(epoch(ts) AS DOUBLE) AS t, value AS cost FROM events), b AS (SELECT x.id, COUNT(*) - 1 AS running FROM q x JOIN q y ON y.lane = x.lane AND (y.t < x.t OR (y.t = x.t AND y.id <= x.id)) AND y.t + 600 - 5 > x.t GROUP BY 1) SELECT q.id, lane, CASE WHEN cost > 20 THEN 'over budget' WHEN lane IN ('click', 'view') AND running >= CASE lane WHEN 'click' THEN 2 ELSE 4 END THEN 'rejected' ELSE 'admitted' END AS verdict FROM q JOIN b ON b.id = q.id")
def admitted(spark, sf):
    """Events as requests of ten minutes; clicks run two at a time, views four."""
    e = table(spark, sf, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("lane"), at.alias("at"), F.lit(600.0).alias("seconds"), F.col("value").alias("cost"), F.lit(20.0).alias("budget"))
    return g.admit(rows, {"click": 2, "view": 4}, 5.0)


EVENTS = Ontology(
    "events",
    nodes={
        "Act": NodeType(description="what a user does"),
        "Click": NodeType({"id": Property("INTEGER", unique=True), "k": Property("INTEGER")}, broader=("Act",), description="a click"),
        "Purchase": NodeType({"id": Property("INTEGER", unique=True)}, aliases=("sale",), broader=("Act",)),
        "UserAccount": NodeType({"id": Property("INTEGER", required=True)}, aliases=("signup",)),
    },
    relations={"MADE_BY": RelationType("Act", "UserAccount", "MANY_TO_ONE", description="who acted"), "near": RelationType("Click", "Any")},
)


@query("ontology_scorecard", "R18", "WITH c AS (SELECT event_type AS l, COUNT(*) AS n FROM events GROUP BY 1), k AS (SELECT SUM(CASE WHEN l IN ('click', 'purchase', 'signup', 'sale', 'act') THEN n ELSE 0 END) / SUM(n) AS s FROM c), t AS (SELECT * FROM (VALUES ('structure', 0.15, 0.84), ('taxonomy', 0.10, 1.0), ('definitions', 0.20, (0.5 + 0.5 + 2.0 / 3 + 3.0 / 4) / 4), ('constraints', 0.25, 0.45 * 0.5 + 0.4 * 0.75 + 0.15 * 0.5)) AS v(d, w, s) UNION ALL SELECT 'corpus', 0.25, s FROM k), o AS (SELECT SUM(w) AS w, SUM(w * s) / SUM(w) AS s FROM t) SELECT d AS dimension, CAST(w AS DOUBLE) AS weight, round(CAST(s AS DOUBLE), 6) AS score, NULL AS grade FROM t UNION ALL SELECT 'overall', round(CAST(w AS DOUBLE), 6), round(CAST(s AS DOUBLE), 6), CASE WHEN s >= 0.9 THEN 'A' WHEN s >= 0.8 THEN 'B' WHEN s >= 0.7 THEN 'C' WHEN s >= 0.6 THEN 'D' ELSE 'F' END FROM o")
def scorecard(spark, sf):
    """The schema of events against the events that there are."""
    corpus = table(spark, sf, "events").groupBy(F.col("event_type").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return sc.scorecard(spark, EVENTS, corpus=corpus, profile="guardrail")


@query("competency_questions", "R17", "SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'Refund' ELSE '' END AS missing, p_size % 3 <> 1 AS expressible, CASE p_size % 3 WHEN 0 THEN 'Click,MADE_BY,UserAccount' WHEN 1 THEN 'Purchase' ELSE '' END AS elements FROM part")
def competency(spark, sf):
    """A question a part, of three kinds, to the schema of events."""
    kind = F.col("p_size") % 3
    said = F.when(kind == 0, F.concat(F.lit("Which user account made the click on "), F.col("p_partkey").cast("string"), F.lit("?"))).when(kind == 1, "How large was the Sale?").otherwise("What is the weather?")
    need = F.when(kind == 0, F.array(F.lit("Click"), F.lit("made_by"))).when(kind == 1, F.array(F.lit("sale"), F.lit("Refund"))).otherwise(F.array().cast("array<string>"))
    q = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), said.alias("question"), need.alias("requires"))
    return sc.asked(EVENTS, q).select("id", F.array_join("missing", ",").alias("missing"), "expressible", F.array_join("elements", ",").alias("elements"))


@query("memory_qualification", "E12", "WITH s AS (SELECT user_id, event_id AS seq, event_type AS state, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events), c AS (SELECT 'current' AS operation, COUNT(*) AS cases FROM s WHERE r = 1 UNION ALL SELECT 'point_in_time', COUNT(*) FROM s WHERE r = 2 UNION ALL SELECT 'before', COUNT(*) FROM (SELECT MIN(event_id) AS f FROM events GROUP BY user_id) WHERE f > 0) SELECT operation, cases, cases AS correct, CAST(1.0 AS DOUBLE) AS accuracy FROM c WHERE cases > 0")
def qualification(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("memory_id"), F.col("event_id").alias("sequence"), F.col("event_type").alias("state"))
    return m.qualify_reads(e, m.state_cases(e))


# -- schemas in and out


def _schema(spark, sf, names):
    """(table, column, kind, nullable) of driver tables, as their files say."""
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "FLOAT", "string": "STRING"}
    return [(t, c, kinds.get(k, "DATETIME")) for t in names for c, k in table(spark, sf, t).dtypes]


COLUMNS = " UNION ALL ".join(f"SELECT '{t}' AS label, '{c}' AS prop, (SELECT CASE WHEN typeof(MAX({c})) IN ('BIGINT', 'INTEGER') THEN 'INTEGER' WHEN typeof(MAX({c})) = 'DOUBLE' THEN 'FLOAT' WHEN typeof(MAX({c})) = 'VARCHAR' THEN 'STRING' ELSE 'DATETIME' END FROM {t}) AS type" for t, cs in {"customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), "nation": ("n_nationkey", "n_name", "n_regionkey"), "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")}.items() for c in cs)


@query("imported_schemas", "S28", f"SELECT format, label, prop, type FROM ({COLUMNS}), (VALUES ('ddl'), ('graphql'), ('drawing'), ('linkml'), ('import model')) AS f(format)")
def imported(spark, sf):
    """The tables' schemas, written in five formats and imported from each."""
    own = _schema(spark, sf, ("customer", "nation", "orders"))
    tables = sorted({t for t, _, _ in own})
    of = lambda t: [(c, k) for u, c, k in own if u == t]
    ddl = "\n".join(f"CREATE CONSTRAINT c{i} FOR (n:{t}) REQUIRE n.{c} IS :: {'ZONED DATETIME' if k == 'DATETIME' else k};" for i, (t, c, k) in enumerate(own))
    kinds = {"INTEGER": "Int", "FLOAT": "Float", "STRING": "String", "DATETIME": "DateTime"}
    graphql = "scalar DateTime\n" + "\n".join(f'"""A table"""\ntype {t} @key(fields: "x") {{ # columns\n' + "\n".join(f"  {c}(first: Int = 3): {kinds[k]}" for c, k in of(t)) + "\n}" for t in tables)
    drawing = {"nodes": [{"id": t, "labels": [t], "properties": dict(of(t))} for t in tables]}
    linkml = {"classes": {t: {"attributes": {c: {"range": k.lower()} for c, k in of(t)}} for t in tables}}
    model = {"dataModel": {"graphSchemaRepresentation": {"graphSchema": {"nodeLabels": [{"$id": f"nl:{t}", "token": t, "properties": [{"$id": f"p:{c}", "token": c, "type": {"type": k.lower()}} for c, k in of(t)]} for t in tables]}}}}
    found = {"ddl": im.from_ddl(ddl), "graphql": im.from_graphql(graphql), "drawing": im.from_drawing(drawing), "linkml": im.from_linkml(linkml), "import model": im.from_import_model(model)}
    return spark.createDataFrame([(f, n, k, p.type) for f, (o, _) in found.items() for n, t in o.nodes.items() for k, p in t.properties.items()], "format string, label string, prop string, type string")


@query("exported_schemas", "S29", f"SELECT format, label, prop, type FROM ({COLUMNS}), (VALUES ('yaml'), ('jsonld'), ('json'), ('turtle'), ('shacl')) AS f(format)")
def exported(spark, sf):
    """The tables' schemas written and read back; Turtle and SHACL by their lines."""
    import re

    nodes: dict[str, dict] = {}
    for t, c, k in _schema(spark, sf, ("customer", "nation", "orders")):
        nodes.setdefault(t, {})[c] = Property(k)
    o = Ontology("tables", nodes={t: NodeType(p) for t, p in nodes.items()})
    rows = [(f, n, k, p.type) for f, back in (("yaml", Ontology.from_yaml(o.to_yaml())), ("jsonld", Ontology.from_jsonld(o.to_jsonld())), ("json", Ontology.from_json(o.to_json()))) for n, t in back.nodes.items() for k, p in t.properties.items()]
    rows += [("turtle", t, c, o.nodes[t].properties[c].type) for t, c in re.findall(r":([a-z]+)_(\w+) a owl:DatatypeProperty", o.to_turtle())]
    back = {"integer": "INTEGER", "double": "FLOAT", "string": "STRING", "dateTime": "DATETIME"}
    rows += [("shacl", t, c, back[k]) for t, body in re.findall(r":(\w+)Shape (.*)", o.to_shacl()) for c, k in re.findall(r"sh:path :(\w+) ; sh:datatype xsd:(\w+)", body)]
    return spark.createDataFrame(rows, "format string, label string, prop string, type string")


def _brands(spark, sf):
    """Brands as kinds of types, each related to them: a schema as small as the dimensions
    that it is read from. Whatever ends at a type may end at its kinds."""
    p = table(spark, sf, "part").select(F.translate("p_brand", "#", "_").alias("b"), "p_type", "p_size").distinct()
    kinds, sizes = {}, {}
    for row in p.groupBy("b").agg(F.collect_set("p_type").alias("t"), F.max("p_size").alias("s")).collect():  # a row a brand
        kinds[row["b"]], sizes[row["b"]] = sorted(row["t"]), row["s"]
    nodes = {t: NodeType() for ts in kinds.values() for t in ts}
    nodes |= {b: NodeType({"id": Property("INTEGER", unique=sizes[b] % 2 == 0)}, broader=tuple(ts)) for b, ts in kinds.items()}
    return Ontology("brands", nodes=nodes, relations={f"IS_{b}_{t}": RelationType(b, t) for b, ts in kinds.items() for t in ts})


PAIRS = "k AS (SELECT DISTINCT translate(p_brand, '#', '_') AS b, p_type AS t FROM part), n AS (SELECT COUNT(DISTINCT b) AS nb, COUNT(DISTINCT t) AS nt, COUNT(*) AS nk FROM k)"


@query("schema_metrics", "R19 R36", f"WITH RECURSIVE {PAIRS}, u AS (SELECT b AS x, t AS y FROM k UNION SELECT t, b FROM k UNION SELECT k.b, j.b FROM k JOIN k j ON k.t = j.t), r(s, v, d) AS (SELECT DISTINCT x, x, 0 FROM u UNION SELECT r.s, u.y, r.d + 1 FROM r JOIN u ON u.x = r.v WHERE r.d < 6), m AS (SELECT s, v, MIN(d) AS d FROM r GROUP BY 1, 2) SELECT round(nk / (nb + nt), 6) AS inheritance, round(nb / (nb + nt), 6) AS attribute, CAST(0.5 AS DOUBLE) AS relationship, round((SELECT SUM(d) / COUNT(*) FROM m WHERE d > 0), 6) AS distance FROM n")
def metrics(spark, sf):
    o = _brands(spark, sf)
    x_ = richness(o)
    return spark.createDataFrame([(round(x_["inheritance"], 6), round(x_["attribute"], 6), round(x_["relationship"], 6), round(mean_distance(o), 6))], "inheritance double, attribute double, relationship double, distance double")


@query("schema_problems", "R1", "WITH s AS (SELECT translate(p_brand, '#', '_') AS b, MAX(p_size) AS m FROM part GROUP BY 1) SELECT 'label ' || b || ' has no unique property' AS problem FROM s WHERE m % 2 = 1 UNION ALL SELECT DISTINCT 'label ' || p_type || ' has no unique property' FROM part")
def problems(spark, sf):
    return spark.createDataFrame([(p,) for p in _brands(spark, sf).problems()], "problem string")


@query("taxonomy_check", "R20", f"WITH {PAIRS} SELECT b || ' is rigid but a kind of anti-rigid ' || t AS problem FROM k WHERE t <> 'ECONOMY'")
def taxonomy(spark, sf):
    """Brands are rigid, types but one are not."""
    o = _brands(spark, sf)
    rigid = {n: bool(t.broader) or n == "ECONOMY" for n, t in o.nodes.items()}
    return spark.createDataFrame([(p,) for p in clean_taxonomy(o, rigid, {})], "problem string")


@query("context_slices", "R26", f"WITH {PAIRS} SELECT DISTINCT t AS label FROM k WHERE t = 'ECONOMY' UNION SELECT b FROM k WHERE t = 'ECONOMY'")
def context(spark, sf):
    found = context_slice(_brands(spark, sf), "what is an economy of it?")
    return spark.createDataFrame([(n,) for n in found], "label string")


# -- slots of questions


@query("path_columns", "P9", "SELECT p_name, p_partkey, p_brand FROM part")
def path_columns(spark, sf):
    p = table(spark, sf, "part")
    return p.select(*x.path_properties(p.columns, ["p_name", "p_partkey"], 3))


@query("identity_words", "P12", "SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS numbers, 'Acme,Supplier,' || CASE WHEN s_nationkey % 2 = 0 THEN 'Rome' ELSE 'X-' || s_nationkey END AS names FROM supplier")
def identity_words(spark, sf):
    place = F.when(F.col("s_nationkey") % 2 == 0, "Rome").otherwise(F.concat(F.lit("X-"), F.col("s_nationkey").cast("string")))
    q = F.concat(F.lit("is Acme "), F.col("s_suppkey").cast("string"), F.lit(" the Supplier from "), place)
    named = lambda kind: F.array_join(x.identity_words(q, kind), ",")
    return table(spark, sf, "supplier").select("s_suppkey", named("INTEGER").alias("numbers"), F.array_join(F.filter(x.identity_words(q, "STRING"), lambda w: ~w.rlike("^[0-9]+$")), ",").alias("names"))


@query("stripped_anchor", "P11", "SELECT 'Customer:' || c_custkey AS id, c_name AS name FROM customer WHERE c_custkey = 7")
def stripped(spark, sf):
    """``Customer:7`` means the key 7 of a customer."""
    n = demo_graph(spark, sf).nodes["Customer"]
    return n.where(anchor(n, "Customer:7")).select("id", "name")


@query("relation_names", "P14", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'LOCATED_IN' WHEN 1 THEN 'IN_REGION' END AS type FROM nation")
def relation_names(spark, sf):
    """What was said, of a handful of spellings, as the relationship that it means."""
    said = F.when(F.col("n_nationkey") % 3 == 0, "Based in").when(F.col("n_nationkey") % 3 == 1, "in the region").otherwise("owns")
    n = table(spark, sf, "nation").select("n_nationkey", said.alias("said"))
    known = [(row["said"], DEMO.match_relation(row["said"])) for row in n.select("said").distinct().collect()]
    return n.join(F.broadcast(spark.createDataFrame(known, "said string, type string")), "said").select("n_nationkey", "type")


# -- files (S1 to S16, X39)


@query("text_files", "S1 S7", "SELECT text AS content FROM benchmark")
def text_files(spark, sf):
    """Every benchmark text as a file of its own, in a folder read through."""
    at = scratch(spark, "texts")
    table(spark, sf, "benchmark").select("text").write.option("maxRecordsPerFile", 1).text(at)
    return r.read_texts(spark, at).select(F.regexp_replace("content", "\n$", "").alias("content"))


@query("json_array", "S3", "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS content, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def json_array(spark, sf):
    at = scratch(spark, "array")
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("content"), "n_regionkey")
    rows.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.text(at)  # one small file
    return r.read_json(spark, at).select("id", "content", F.col("metadata")["n_regionkey"].alias("region"))


@query("json_lines", "S4 S8", "SELECT CAST(doc_id AS VARCHAR) AS id, sha256(text) AS sha256, source, lang FROM documents")
def json_lines(spark, sf):
    at = scratch(spark, "lines")
    table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "source", "lang").write.json(at)
    got = r.read_json(spark, at, lines=True)
    return got.select("id", F.sha2("content", 256).alias("sha256"), F.col("metadata")["source"].alias("source"), F.col("metadata")["lang"].alias("lang"))


@query("csv_rows", "S2", "SELECT s_name AS content, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier")
def csv_rows(spark, sf):
    at = scratch(spark, "csv")
    table(spark, sf, "supplier").select(F.col("s_name").alias("content"), "s_nationkey").write.option("header", "true").csv(at)
    return r.read_csv(spark, at).select("content", F.col("metadata")["s_nationkey"].alias("nation"))


@query("pdf_texts", "S5", "SELECT n_name AS content FROM nation")
def pdf_texts(spark, sf):
    """A minimal file a nation, read by an extractor of literal strings."""
    import re

    at = scratch(spark, "pdf")
    body = F.concat(F.lit("%PDF-1.4 1 0 obj<</Length 9>>stream BT ("), "n_name", F.lit(") Tj ET endstream endobj %%EOF"))
    table(spark, sf, "nation").select(body.alias("value")).write.option("maxRecordsPerFile", 1).text(at)
    return x.read_pdf(spark, at, lambda b: " ".join(re.findall(r"\(([^)]*)\) Tj", b.decode("latin-1"))), "*.txt").select("content")


@query("paged_source", "S9", "SELECT n_name AS name FROM nation WHERE n_nationkey < 30")
def paged(spark, sf):
    """Pages of five keys each, fetched by tasks."""
    got = x.fetched(spark, 6, lambda page: [{"key": 5 * page + i} for i in range(5)], "key long")
    return got.join(table(spark, sf, "nation"), F.col("key") == F.col("n_nationkey")).select(F.col("n_name").alias("name"))


@query("block_pages", "S11 F36", "SELECT 'notion:' || conv_id AS id, string_agg(CASE turn % 3 WHEN 0 THEN '# ' WHEN 1 THEN '- ' ELSE '' END || role, chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id")
def block_pages(spark, sf):
    kind = F.when(F.col("turn") % 3 == 0, "heading_1").when(F.col("turn") % 3 == 1, "bulleted_list_item").otherwise("paragraph")
    b = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("page"), F.lit("t").alias("title"), F.col("turn").alias("position"), kind.alias("kind"), F.col("role").alias("text"))
    return r.notion_pages(b).select("id", "content")


@query("adapted_documents", "S16", "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS content, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def adapted(spark, sf):
    """Documents of another library, held by the caller: as many as there are nations."""
    docs = [SimpleNamespace(page_content=row["n_name"], metadata={"id": row["n_nationkey"], "region": row["n_regionkey"]}) for row in table(spark, sf, "nation").collect()]
    return r.adapt(spark, docs).select("id", "content", F.col("metadata")["region"].alias("region"))


@query("question_files", "X39", "WITH q AS (SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS id, text AS question, role AS type FROM conversations WHERE role IN ('user', 'assistant')), r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY id) AS r FROM q) SELECT id, question, type FROM r WHERE r <= 20")
def question_files(spark, sf):
    at = scratch(spark, "questions")
    c = table(spark, sf, "conversations")
    for role in ("user", "assistant"):
        c.where(F.col("role") == role).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("question")).write.json(f"{at}/{role}")
    return x.questions(spark, {k: f"{at}/{k}" for k in ("user", "assistant")}, 20).select("id", "question", "type")


# -- built-in functions, plans and pointers


@query("built_in_text", "F1", "SELECT p_partkey, lower(p_brand) AS brand, contains(lower(p_name), 'ring') AS ring, COALESCE(nullif(p_type, 'ECONOMY'), 'none') || ':' || CAST(p_size AS VARCHAR) AS said FROM part")
def built_in(spark, sf):
    own = F.coalesce(F.nullif("p_type", F.lit("ECONOMY")), F.lit("none"))
    return table(spark, sf, "part").select("p_partkey", F.lower("p_brand").alias("brand"), F.lower("p_name").contains("ring").alias("ring"), F.concat_ws(":", own, F.col("p_size").cast("string")).alias("said"))


@query("partial_aggregation", "A12", "SELECT event_type, COUNT(*) AS n, 2 AS phases FROM events GROUP BY 1")
def partial_aggregation(spark, sf):
    """A count by type, with how many aggregations Spark's own plan makes of it."""
    n = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    phases = g.plan_operators(n).where("operator like '%Aggregate%'").count()
    return n.withColumn("phases", F.lit(phases))


@query("neighbouring_orders", "W-6", "SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice) OVER w AS after, MAX(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS most FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def neighbouring(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select("o_orderkey", F.lag(price).over(w).alias("before"), F.lead(price).over(w).alias("after"), F.max(price).over(w.rowsBetween(-1, 1)).alias("most"))


@query("projection_gate", "N7", "SELECT 24 * (SELECT COUNT(*) FROM part) + 16 * (SELECT COUNT(*) FROM lineitem) AS bytes_min, 40 * (SELECT COUNT(*) FROM part) + 32 * (SELECT COUNT(*) FROM lineitem) AS bytes_max, TRUE AS allowed")
def projection_gate(spark, sf):
    got = projection_bytes(table(spark, sf, "part").count(), table(spark, sf, "lineitem").count(), 10**15)
    return spark.createDataFrame([(got["bytes_min"], got["bytes_max"], got["allowed"])], "bytes_min long, bytes_max long, allowed boolean")


@query("pointer_swaps", "X28", "WITH RECURSIVE e AS (SELECT event_id, user_id % 4 AS fence, event_type AS target FROM events WHERE event_type IN ('signup', 'error') ORDER BY event_id), o AS (SELECT *, row_number() OVER (ORDER BY event_id) AS i FROM e), w(i, fence, target, swaps) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), 'none', 0 UNION ALL SELECT o.i, CASE WHEN o.fence >= w.fence THEN o.fence ELSE w.fence END, CASE WHEN o.fence >= w.fence THEN o.target ELSE w.target END, w.swaps + CASE WHEN o.fence >= w.fence THEN 1 ELSE 0 END FROM w JOIN o ON o.i = w.i + 1) SELECT target, fence, swaps AS generation FROM w ORDER BY i DESC LIMIT 1")
def pointer_swaps(spark, sf):
    """Swaps in order of arrival; a fence older than the pointer's changes nothing."""
    e = table(spark, sf, "events").where("event_type in ('signup', 'error')").select(F.col("event_id").alias("ordinal"), (F.col("user_id") % 4).alias("fence"), F.col("event_type").alias("target"))
    return x.swapped(e)
