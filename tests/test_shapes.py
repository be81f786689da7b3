import pytest
from pyspark.sql import functions as F

from weftgraph.operators import shapes as s
from weftgraph.plans.graph import PropertyGraph
from weftgraph.plans.ontology import DEMO, NodeType, Ontology, Property, RelationType, classify_change, clean_taxonomy, context_slice, mean_distance, recommended_bump, richness

ONT = Ontology(
    "work",
    nodes={"Agent": NodeType({"name": Property(unique=True)}), "Company": NodeType({"name": Property(unique=True)}, broader=("Agent",)), "Person": NodeType({"name": Property(unique=True)}, broader=("Agent",)), "City": NodeType({"name": Property(unique=True)})},
    relations={"WORKS_AT": RelationType("Person", "Company", "MANY_TO_ONE"), "ACQUIRED": RelationType("Company", "Company", aliases=("took over",))},
)


@pytest.fixture(scope="module")
def graph(spark):
    node = "id string, name string, workspace string, superseded_by string"
    people = [("p1", "Ann Lee", "a", None), ("p2", "Bob", "a", ""), ("p3", "Old Bob", "a", "p2"), ("p1b", "Ann Lee", "b", None)]
    firms = [("c1", "Acme Inc", "a", None), ("c2", "Bolt", "a", None), ("c3", "Coil", "a", None), ("c9", "Acme", "b", None)]
    works = [("p1", "c1", "a"), ("p2", "c1", "a"), ("p2", "c2", "a"), ("p3", "c1", "a"), ("p1b", "c9", "b")]
    took = [("c1", "c2", "a"), ("c2", "c3", "a"), ("c3", "c1", "a"), ("c2", "c2", "a")]
    edge = "src string, dst string, workspace string"
    return PropertyGraph(ONT, {"Person": spark.createDataFrame(people, node), "Company": spark.createDataFrame(firms, node)}, {"WORKS_AT": spark.createDataFrame(works, edge), "ACQUIRED": spark.createDataFrame(took, edge)})


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_tenants_never_meet(graph):
    got = rows(s.run(graph, s.Spec("entity_contains", label="Person", mention="ann", workspace="a")).select("id"))
    assert got == [("p1",)]
    assert len(rows(s.run(graph, s.Spec("entity_contains", label="Person", mention="ann")))) == 2


def test_superseded_nodes_are_left_out(graph):
    assert rows(s.run(graph, s.Spec("entity_contains", label="Person", mention="bob")).select("id")) == [("p2",)]
    assert rows(s.run(graph, s.Spec("count", label="Person", workspace="a"))) == [(3,)]


def test_legal_forms_and_possessives_are_tidied(graph):
    got = rows(s.run(graph, s.Spec("entity_contains", label="Company", mention="Acme's", workspace="b")).select("id"))
    assert got == [("c9",)]


def test_direction_and_loops(graph):
    out = s.run(graph, s.Spec("relationship_lookup", label="Company", mention="c2", relation="ACQUIRED", role="either", target_label="Company", workspace="a"))
    assert [r[:2] for r in rows(out)] == [("c1", "c2"), ("c2", "c2"), ("c2", "c3")]
    into = s.run(graph, s.Spec("relationship_lookup", label="Company", mention="c1", relation="WORKS_AT", workspace="a"))
    assert {r[0] for r in rows(into)} == {"p1", "p2", "p3"}


def test_counts_take_the_in_degree_by_default(graph):
    assert rows(s.run(graph, s.Spec("count", label="Company", mention="c1", relation="WORKS_AT", workspace="a"))) == [(3,)]
    assert rows(s.run(graph, s.Spec("count", label="Person", mention="p2", relation="WORKS_AT", role="source", workspace="a"))) == [(2,)]


def test_paths_never_repeat_an_edge(graph):
    out = rows(s.run(graph, s.Spec("path", label="Person", mention="p1", target_label="Company", target="coil", hops=4, workspace="a")))
    assert out[0] == ("p1", "c3", 3, "p1,c1,c2,c3", "WORKS_AT,ACQUIRED,ACQUIRED")
    assert all(r[2] == 3 for r in out)
    assert rows(s.run(graph, s.Spec("path", label="Person", mention="p1", target_label="City", target="x", hops=4))) == []


def test_unknown_shapes_mean_neighbours_and_limits_are_clamped(graph):
    out = s.run(graph, s.Spec("nothing", label="Person", mention="p2", relation="WORKS_AT", limit=1, workspace="a"))
    assert rows(out) == [("Acme Inc", "Company")]
    lonely = s.run(graph, s.Spec("neighbors", label="Company", mention="c3", workspace="a"))
    assert rows(lonely)[0][0] == "c3"


def test_lists_take_several_anchors(graph):
    out = s.run(graph, s.Spec("list_all", label="Person", mention="p1, p2", relation="WORKS_AT", workspace="a"))
    assert [r[0] for r in rows(out)] == ["Acme Inc", "Bolt"]


def test_rank_fusion_drops_weak_backends(spark):
    df = spark.createDataFrame([("x", "a", 1), ("x", "b", 2), ("y", "b", 1), ("z", "c", 1)], "backend string, id string, rank int")
    got = {r.id: r.score for r in s.rank_fusion(df, {"y": 0.5, "z": 0.05}).collect()}
    assert got == {"a": pytest.approx(1 / 61), "b": pytest.approx(1 / 62 + 0.5 / 61)}


def test_ontology_reasoning():
    assert ONT.conforms("Person", "Agent") and not ONT.conforms("Agent", "Person")
    assert ONT.orient("Company", "Person", "WORKS_AT") == ("Company", "Person", "target")
    assert ONT.match_relation("took over") == "ACQUIRED" and ONT.match_relation("works at") == "WORKS_AT" and ONT.match_relation("zzz") is None
    assert ONT.reachable("Person", "Company", 1) and not ONT.reachable("Person", "City", 4)
    assert ONT.connecting("Person", "Company", 1) == ["WORKS_AT"]
    assert ONT.directed_path("Person", "Company", 2, ["WORKS_AT", "ACQUIRED"]) and not ONT.directed_path("Company", "Person", 2, ["WORKS_AT"])
    assert Ontology.from_json(ONT.to_json()) == ONT
    assert ":Person a owl:Class ; rdfs:subClassOf :Agent ." in ONT.to_turtle() and "sh:targetClass :Customer" in DEMO.to_shacl()
    assert context_slice(ONT, "which city?") == {"City"}
    assert richness(ONT)["inheritance"] == 0.5 and mean_distance(ONT) == 1.0


def test_ontology_problems():
    bad = Ontology("x", nodes={"A b": NodeType({"k": Property("WHAT")}), "B": NodeType({"k": Property(unique=True)}, broader=("C",)), "C": NodeType({"k": Property(unique=True)}, broader=("B",))}, relations={"R": RelationType("B", "Nope", "SOME")})
    text = " / ".join(bad.problems())
    for part in ("not allowed", "no unique property", "unknown type WHAT", "kind of itself", "unknown label Nope", "unknown cardinality"):
        assert part in text
    assert not [p for p in DEMO.problems()]


def test_versions():
    new = ONT.subtract(Ontology("y", nodes={"City": NodeType()}))
    assert classify_change(ONT, new) == [("label City", "BREAKING"), ("property City.name", "BREAKING")]
    assert recommended_bump(classify_change(new, ONT)) == "minor" and recommended_bump([]) == "patch"
    assert ONT.merge(new) == ONT
    assert clean_taxonomy(ONT, {"Person": True, "Agent": False}, {}) == ["Person is rigid but a kind of anti-rigid Agent"]


def test_predicates_reach_the_scan(spark):
    from weftgraph.plans.graph import demo_graph

    plan = s.run(demo_graph(spark, "/root/testdata/sf0.001"), s.Spec("count", label="Customer", workspace="ws1"))._jdf.queryExecution().executedPlan().toString()
    assert "c_nationkey" in plan and "c_acctbal" not in plan


def test_truncated_expansion_takes_the_latest(spark):
    e = spark.createDataFrame([(1, 2, 10), (1, 3, 20), (3, 4, 5)], "src long, dst long, ts long")
    got = s.truncated_expansion(e, spark.createDataFrame([(1,)], "node long"), 2, 1)
    assert rows(got.select(F.col("node"))) == [(4,)]
