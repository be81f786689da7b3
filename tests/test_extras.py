from weftgraph.operators import extras as x
from weftgraph.functions import text as t
from weftgraph.plans import importers as im
from weftgraph.plans import scorecard as sc
from weftgraph.plans.ontology import DEMO, NodeType, Ontology, Property, RelationType


def test_imports():
    ddl, _ = im.from_ddl("CREATE CONSTRAINT a IF NOT EXISTS FOR (n:Person) REQUIRE n.id IS UNIQUE; // no\nCREATE CONSTRAINT b FOR (n:Person) REQUIRE n.name IS NOT NULL; CREATE INDEX c FOR (n:City) ON (n.name, n.`zip`)")
    assert ddl.nodes["Person"].properties["id"].unique and ddl.nodes["Person"].properties["name"].required and ddl.nodes["City"].properties["zip"].index
    keyed, notes = im.from_ddl("CREATE CONSTRAINT k FOR (n:A) REQUIRE (n.x, n.y) IS NODE KEY; CREATE CONSTRAINT r FOR ()-[e:KNOWS]-() REQUIRE e.since IS NOT NULL; CREATE CONSTRAINT t FOR (n:A) REQUIRE n.z IS :: INTEGER")
    assert keyed.nodes["A"].identity == ("x", "y") and keyed.nodes["A"].properties["z"].type == "INTEGER" and "KNOWS" in keyed.relations and "since" in notes[0]
    gql, left = im.from_graphql('scalar Date\nenum Kind { A B }\ninterface N { id: ID! }\ntype Query { all: [Person] }\ntype Person implements N @key(fields: "id") { id: ID! age: Int, kind: Kind! born: Date\n "a: b" friends(first: Int = 3): [Person!]! home: City x: Missing } type City { name: String! }')
    assert gql.relations["FRIENDS"].cardinality == "ONE_TO_MANY" and gql.relations["HOME"].target == "City" and gql.nodes["Person"].properties["age"].type == "INTEGER"
    own = gql.nodes["Person"].properties
    assert own["kind"].enum == ("A", "B") and own["kind"].required and own["born"].type == "DATE" and own["id"].unique and set(own) == {"id", "age", "kind", "born"}
    assert set(gql.nodes) == {"Person", "City"} and len(left) == 2
    drawn, _ = im.from_drawing({"nodes": [{"id": "1", "labels": ["A"], "properties": {"k": "integer", "n": "12"}}, {"id": "2", "caption": "B"}, {"id": "3", "labels": ["A"], "properties": {"n": "1.5"}}], "relationships": [{"type": "R", "fromId": "1", "toId": "2"}]})
    assert (drawn.relations["R"].source, drawn.relations["R"].target) == ("A", "B") and [drawn.nodes["A"].properties[k].type for k in "kn"] == ["INTEGER", "FLOAT"]
    lk, _ = im.from_linkml({"name": "l", "enums": {"E": {"permissible_values": {"u": {}, "v": {}}}}, "slots": {"s": {"range": "integer"}}, "classes": {"A": {"slots": ["s"], "attributes": {"id": {"identifier": True}, "e": {"range": "E"}, "hasB": {"range": "B", "multivalued": True}}}, "B": {"is_a": "A"}}})
    assert lk.nodes["B"].broader == ("A",) and lk.relations["HAS_B"].cardinality == "ONE_TO_MANY" and lk.nodes["A"].properties["e"].enum == ("u", "v") and lk.nodes["A"].properties["s"].type == "INTEGER"
    schema = {"nodeLabels": [{"$id": "nl:0", "token": "A", "properties": [{"$id": "p:0", "token": "id", "type": {"type": "integer"}, "nullable": False}]}], "relationshipTypes": [{"$id": "rt:0", "token": "R", "properties": []}], "nodeObjectTypes": [{"$id": "n:0", "labels": [{"$ref": "#nl:0"}]}], "relationshipObjectTypes": [{"$id": "r:0", "type": {"$ref": "#rt:0"}, "from": {"$ref": "#n:0"}, "to": {"$ref": "#n:9"}}], "constraints": [{"constraintType": "uniqueness", "properties": [{"$ref": "#p:0"}]}]}
    model, _ = im.from_import_model({"dataModel": {"graphSchemaRepresentation": {"graphSchema": schema}}})
    assert model.nodes["A"].properties["id"] == Property("INTEGER", unique=True, required=True) and (model.relations["R"].source, model.relations["R"].target) == ("A", "Any")
    assert im.from_modules([{"class": "A"}, {"property": "P", "domain": "A"}]).relations["P"].target == "Any"


def test_exports_round_trip():
    for o in (DEMO, Ontology("x y: z", nodes={"A": NodeType({"k": Property(enum=("a: b", "ü"), low=1.5)}, aliases=("q",), description="it's: so")})):
        assert Ontology.from_yaml(o.to_yaml()) == Ontology.from_jsonld(o.to_jsonld()) == Ontology.from_json(o.to_json()) == o
    assert Ontology.from_yaml("name: t\nversion: 2.0.0\n# a comment\nnodes:\n  A:\n    properties:\n      k:\n        type: INTEGER\n").nodes["A"].properties["k"].type == "INTEGER"


def test_scorecard_of_broken_schemas(spark):
    bad = Ontology("b", nodes={"A": NodeType(broader=("B",)), "B": NodeType(broader=("A",)), "R": NodeType()}, relations={"R": RelationType()})
    found = {(f.severity, f.check) for f in sc.lint(bad)}
    assert {("error", "duplicate"), ("error", "cycle"), ("warning", "definition")} <= found
    got = {r.dimension: r for r in sc.scorecard(spark, bad).collect()}
    assert got["overall"].grade in ("D", "F") and got["structure"].score < 0.4
    assert sc.taxonomy(Ontology("e")) == 0.0 and sc.structure(Ontology("e")) == 1.0
    assert {r.dimension for r in sc.scorecard(spark, Ontology("e")).collect()} == {"structure", "taxonomy", "definitions", "constraints", "overall"}
    q = spark.createDataFrame([(1, "which demo customer?", ["Customer"])], "id long, question string, requires array<string>")
    assert {r.dimension: r.score for r in sc.scorecard(spark, DEMO, questions=q).collect()}["questions"] > 0.5


def test_mentions_in_blocks(spark):
    docs = spark.createDataFrame([(1, "The Red box and xred BOXy"), (2, "nothing"), (3, None)], "doc_id long, text string")
    names = spark.createDataFrame([(10, "red box"), (11, "RED"), (12, ""), (13, None), (14, "red box")], "name_id long, name string")
    for block in (1, 100):
        assert sorted(map(tuple, t.mentions(docs, names, block).collect())) == [(10, 1), (11, 1), (14, 1)]
    assert t.mentions(docs, names.limit(0)).count() == 0


def test_gestalt_ratio_is_the_library_s(spark):
    from difflib import SequenceMatcher

    pairs = [("small ring", "STANDARD"), ("abc", "ABCD"), ("", ""), (None, "x"), ("kitten", "sitting")]
    got = spark.createDataFrame(pairs, "a string, b string").select(t.gestalt_ratio("a", "b").alias("r")).collect()
    assert [r.r for r in got] == [None if None in p else SequenceMatcher(None, p[0].lower(), p[1].lower()).ratio() for p in pairs]


def test_betweenness_equals_all_paths(spark):
    """Against the share of shortest paths, by enumerating them."""
    import random
    from itertools import permutations

    random.seed(4)
    edges = {tuple(random.sample(range(9), 2)) for _ in range(16)}
    for directed in (True, False):
        out = {v: {b for a, b in edges if a == v} | (set() if directed else {a for a, b in edges if b == v}) for v in range(9)}
        score = dict.fromkeys({v for e in edges for v in e}, 0.0)
        for s, z in permutations(range(9), 2):
            paths = [[s]]
            while paths and not any(p[-1] == z for p in paths):
                paths = [[*p, n] for p in paths for n in out[p[-1]] if n not in p]
            paths = [p for p in paths if p[-1] == z]
            for p in paths:
                for v in p[1:-1]:
                    score[v] += 1 / len(paths) / (1 if directed else 2)
        df = spark.createDataFrame(sorted(edges), "src long, dst long")
        got = {r.node: r.score for r in x.betweenness(df, 9, directed).collect()}
        assert got == {k: round(v, 6) for k, v in score.items()} or all(abs(got[k] - v) < 1e-5 for k, v in score.items())


def test_betweenness_of_a_path(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    assert [(r.node, r.score) for r in x.betweenness(df, 2).collect()] == [(2, 2.0), (3, 2.0)]


def test_pointer_and_candidates():
    p, ok = x.Pointer("a").swap(0, 1, "b")
    assert ok and p.swap(0, 9, "c") == (p, False) and p.swap(1, 0, "c") == (p, False)
    assert x.identity_candidates("account 42 of Ann", {"id": "INTEGER", "name": "STRING"}) == {"id": ["42"], "name": ["42", "Ann"]}
    assert x.path_properties(["a", "id", "b"], ["id"], 2) == ["id", "a"]


def test_paged_and_file_sources(spark, tmp_path):
    df = x.fetched(spark, 3, lambda p: [{"id": p * 10 + i} for i in range(2)], "id long")
    assert sorted(r.id for r in df.collect()) == [0, 1, 10, 11, 20, 21]
    (tmp_path / "a.pdf").write_bytes(b"%PDF text")
    assert [r.content for r in x.read_pdf(spark, str(tmp_path), lambda b: b[5:].decode()).collect()] == ["text"]
    (tmp_path / "q.json").write_text('{"id": "2", "question": "b"}\n{"id": "1", "question": "a"}\n')
    assert [r.question for r in x.questions(spark, {"fact": f"{tmp_path}/q.json"}, 1).collect()] == ["a"]


def test_merged_loops_go(spark):
    n = spark.createDataFrame([("a", "L"), ("b", "L"), ("c", "L")], "id string, label string")
    e = spark.createDataFrame([("a", "b", "R"), ("b", "c", "R"), ("a", "c", "R")], "src string, dst string, type string")
    to = spark.createDataFrame([("a", "m"), ("b", "m")], "id string, canonical string")
    nodes, edges = x.canonical_snapshot(n, e, to)
    assert {r.id for r in nodes.collect()} == {"m", "c"} and [tuple(r) for r in edges.collect()] == [("m", "c", "R")]
