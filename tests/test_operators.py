"""Edge cases of operators on small frames."""

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import text as x
from weftgraph.operators import analytics as a
from weftgraph.operators import constraints as c
from weftgraph.operators import detect as d
from weftgraph.operators import evaluate as e
from weftgraph.operators import guards as g
from weftgraph.operators import memory as m
from weftgraph.operators import resolve as r
from weftgraph.operators import retrieval as v


def rows(df, *order):
    return [tuple(z) for z in (df.orderBy(*order) if order else df).collect()]


def test_small_legs_ignore_large_ones(spark):
    t = [("a", "o", 10.0), ("b", "o", 10.0), ("c", "o", 1e9), ("a", "p", 10.0)]
    df = spark.createDataFrame(t, "src string, dst string, amount double")
    assert rows(d.small_leg_owners(df, "dst", 100, 15, 2, 2)) == [("o", 20.0, 2, 2)]


def test_rings_once_each_and_capped(spark):
    e3 = [(1, 2), (2, 3), (3, 1), (2, 1), (1, 4), (1, 5)]
    df = spark.createDataFrame(e3, "src long, dst long")
    assert rows(d.rings(df)) == [(1, 2, 3)]
    assert rows(d.rings(df, 2)) == []


def test_ring_within_a_day(spark):
    df = spark.createDataFrame([(1, 2, 0), (2, 3, 10), (3, 1, 90_000)], "src long, dst long, ts long")
    span = F.greatest("e1.ts", "e2.ts", "e3.ts") - F.least("e1.ts", "e2.ts", "e3.ts")
    assert rows(d.rings(df, extra=span <= 86_400)) == [] and rows(d.rings(df, extra=span <= 90_000)) == [(1, 2, 3)]


def test_funnel_and_rates_without_denominator(spark):
    kind = "src string, dst string, amount double, ts long"
    i = spark.createDataFrame([("a", "h", 5.0, 1), ("b", "h", 5.0, 100)], kind)
    o = spark.createDataFrame([("h", "z", 9.0, 99)], kind)
    assert rows(d.funnels(i, o, 2, 10, 0.5)) == [("h", 2, 10.0, 9.0)] and rows(d.funnels(i, o, 2, 0, 0.5)) == []
    none = spark.createDataFrame([], "id long")
    assert rows(d.precision_recall(none, none, "id")) == [(0, 0, 0, None, None)]


def test_components_and_communities(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "src long, dst long")
    got = dict(rows(a.components(df)))
    assert {got[i] for i in range(41)} == {0} and got[101] == 100
    assert rows(a.components(df.limit(0))) == []
    assert len({x[1] for x in rows(a.label_propagation(df))}) >= 2


def test_components_of_a_path_whose_ids_fall(spark):
    # the least label went one edge a round here, and the planner's estimates doubled their digits in each
    order = [0, *range(60, 0, -1)]
    df = spark.createDataFrame(list(zip(order, order[1:])), "src long, dst long")
    assert rows(a.components(df), "node") == [(i, 0) for i in range(61)]


def test_components_of_random_graphs_with_hubs(spark):
    import random

    rng = random.Random(5)
    pairs = [(rng.randrange(900), rng.randrange(900)) for _ in range(420)] + [(950, 1000 + i) for i in range(700)] + [(1001, 950), (None, 3), (4, None), (8, 8)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for x, y in pairs:
        if x is not None and y is not None and x != y:
            x, y = sorted((find(x), find(y)))
            root[y] = x
    want = sorted((x, find(x)) for x in root)
    assert rows(a.components(spark.createDataFrame(pairs, "src long, dst long")), "node") == want
    assert rows(a.components(spark.createDataFrame([("b", "c"), ("c", "a"), ("y", "z")], "src string, dst string")), "node") == [("a", "a"), ("b", "a"), ("c", "a"), ("y", "y"), ("z", "y")]


def test_pagerank_sums_to_one(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    assert sum(x[1] for x in rows(a.pagerank(df))) == pytest.approx(1.0)


def test_clustering_of_a_triangle_with_a_tail(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 3)], "src long, dst long")
    assert rows(a.clustering(df), "node") == [(1, 2, 1, 1.0), (2, 2, 1, 1.0), (3, 3, 1, pytest.approx(1 / 3)), (4, 1, 0, 0.0)]


def test_reach_keeps_the_anchor_only_if_asked(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src long, dst long")
    one = spark.createDataFrame([(1,)], "node long")
    assert rows(a.reach(df, one, 2), "node") == [(2, 1), (3, 2)]
    assert rows(a.reach(df, one, 2, True), "node") == [(1, 2), (2, 1), (3, 2)]


def test_last_writer_wins_by_property(spark):
    w = [("L", "1", "w", {"a": "1", "b": "1"}, "s1", 10.0, 1), ("L", "1", "w", {"a": "2"}, "s2", 10.0, 2), ("L", "1", "w", {"b": "0"}, "s3", 5.0, 3), ("L", "1", "v", {"a": "9"}, "s1", 1.0, 4), ("L", "2", "w", {}, "s1", 1.0, 5)]
    df = spark.createDataFrame(w, "label string, id string, workspace string, props map<string,string>, source string, ts double, ordinal int")
    got = {(z.id, z.workspace): (z.props, z.sources) for z in r.upsert_nodes(df).collect()}
    assert got == {("1", "w"): ({"a": "2", "b": "1"}, ["s1", "s2", "s3"]), ("1", "v"): ({"a": "9"}, ["s1"]), ("2", "w"): (None, ["s1"])}
    left = r.delete_by_source(r.upsert_nodes(df), "s1")
    assert {(z.id, z.workspace) for z in left.collect()} == {("1", "w")}


def test_identity_of_blank_keys_is_null(spark):
    df = spark.createDataFrame([(" A  b ", None), (" ", "")], "a string, b string")
    assert rows(df.select(r.identity_key(F.lit("P"), F.col("a"), F.col("b")))) == [("P|a b|",), (None,)]


def test_survivorship_quarantines_ties(spark):
    f = [("k", "s1", "1.00B", 1e9, False, 3), ("k", "s2", "1.001B", 1.001e9, False, 4), ("k", "s3", "2B", 2e9, False, 1), ("t", "s1", "1", 1.0, False, 1), ("t", "s2", "2", 2.0, False, 1), ("one", "s1", "7", 7.0, False, 1), ("one", "s1", "7", 7.0, False, 1)]
    df = spark.createDataFrame(f, "key string, source string, raw string, value double, percent boolean, digits int")
    assert rows(r.survivorship(df), "key") == [("k", 3, "1.001B", "survived"), ("one", 1, "7", "single"), ("t", 2, None, "quarantine")]
    assert r.coalition({"a", "b", "c"}, [("x", 1, {"a"}), ("y", 1, {"a", "b"}), ("z", 9, {"a", "b"})]) == (["z"], {"c"})


def test_money_text(spark):
    said = ["(1,234)", "$1.5 billion", "-3k", "12%", "none", "1.2mm"]
    df = spark.createDataFrame([(s,) for s in said], "s string").select(x.parse_value("s").alias("v"))
    got = [z.v and (z.v.value, z.v.percent) for z in df.collect()]
    assert got == [(-1234.0, False), (1.5e9, False), (-3000.0, False), (12.0, True), None, (1.2e6, False)]


def test_years_and_periods(spark):
    df = spark.createDataFrame([("FY2023",), ("id 20234",), ("Q3 of fiscal 2021",), ("second quarter calendar 1999",)], "s string")
    assert rows(df.select(x.coerce_year("s"), x.period_key("s"))) == [(2023, "fiscal:2023:FY"), (None, None), (2021, "fiscal:2021:Q3"), (1999, "calendar:1999:Q2")]


def test_names(spark):
    df = spark.createDataFrame([("The Acme Holdings, Inc.",), ("Inc",), ("camelCase_Type",)], "s string")
    assert rows(df.select(x.name_key("s"))) == [("acme",), ("inc",), ("camelcase type",)]
    assert df.select(x.type_tokens("s")).collect()[2][0] == ["camel", "case", "type"]


def test_shard_equals_big_endian_hash(spark):
    import hashlib

    df = spark.createDataFrame([("a",), ("漢",)], "s string")
    want = [int.from_bytes(hashlib.sha256(s.encode()).digest()[:8], "big") % 7 for s in ("a", "漢")]
    assert [z[0] for z in df.select(x.shard_for("s", 7)).collect()] == want


def test_gestalt_ratio_is_difflib(spark):
    from difflib import SequenceMatcher

    df = spark.createDataFrame([("night", "Nacht"), ("", "a"), (None, "x")], "a string, b string")
    assert [z[0] for z in df.select(x.gestalt_ratio("a", "b")).collect()] == [SequenceMatcher(None, "night", "nacht").ratio(), 0.0, None]


def test_commits_are_idempotent(spark):
    t = [("w", "m", "k1", "{}", "a", 1), ("w", "m", "k1", "{}", "a", 5), ("w", "m", "k2", "{}", "b", 2), ("v", "m", "k1", "{}", "a", 3), ("w", "m", "k3", "1", "a", 6), ("w", "m", "k3", "2", "a", 7)]
    df = spark.createDataFrame(t, "workspace string, memory_id string, key string, payload string, event_type string, ordinal long")
    got = rows(m.commit(df).select("workspace", "key", "sequence", "revision", "canonical"), "workspace", "sequence")
    assert got == [("v", "k1", 1, 1, True), ("w", "k1", 1, 1, False), ("w", "k2", 2, 2, False), ("w", "k3", 3, 3, True)]
    assert rows(m.replay_conflicts(df)) == [("w", "k3", 2)]


def test_reorg(spark):
    b = [("c", 1, "x", "e1", 1), ("c", 1, "y", "e2", 2), ("c", 1, "x", "e1", 3), ("c", 2, "z", "e3", 4)]
    df = spark.createDataFrame(b, "chain string, height long, block string, event string, ordinal long")
    assert rows(m.reconcile(df).select("event", "status"), "event") == [("e1", "orphaned"), ("e2", "canonical"), ("e3", "canonical")]


def test_frontiers(spark):
    k = "domain string, shard int, sequence long"
    need, have = spark.createDataFrame([("d", 1, 5)], k), spark.createDataFrame([("d", 1, 4), ("d", 2, 9)], k)
    assert rows(m.satisfied_by(need, have)) == [(False,)] and rows(m.satisfied_by(need.limit(0), have)) == [(True,)]


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [z[0] for z in df.select(v.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


def test_source_prefix_does_not_hit_its_neighbour(spark):
    df = spark.createDataFrame([("src_chunk_1",), ("src_chunked_v2_1",), ("src_chunk`",)], "id string")
    assert [z[0] for z in v.delete_source(df, "src").collect()] == ["src_chunked_v2_1", "src_chunk`"]


def test_rules_of_a_small_table(spark):
    t = [("L", i, p, val) for i in range(10) for p, val in (("a", str(i)), ("b", "x" if i % 2 else "y"), ("c", None if i == 0 else "true"))]
    got = {z.prop: z for z in c.infer_rules(spark.createDataFrame(t, "label string, id long, prop string, value string")).collect()}
    assert (got["a"].type, got["a"].low, got["a"].high, got["a"].enum, got["a"].required) == ("integer", 0.0, 9.0, False, True)
    assert got["b"].enum and (got["c"].type, got["c"].required) == ("boolean", False)


def test_guards_and_costs(spark):
    q = spark.createDataFrame([(1, "MATCH (n {a:'DROP it'}) RETURN n LIMIT 5"), (2, "MATCH (n:X)-[:R*]->(m:A) DELETE n"), (3, None)], "id long, text string")
    lim = g.Limits(labels=("A",), types=("R",), ends={"R": ("A", "A")})
    assert rows(g.guard(q, lim), "id", "finding") == [(2, "direction:R", "block"), (2, "label:X", "block"), (2, "unbounded", "block"), (2, "write:DELETE", "block")]
    found = g.plan_operators(spark.range(3).crossJoin(spark.range(3)))
    assert found.where("operator in ('CartesianProduct', 'BroadcastNestedLoopJoin')").count() == 1
    assert a.projection_bytes(10, 10, 10**9)["allowed"] and not a.projection_bytes(10**9, 10**9, 10**9)["allowed"]


def test_metrics_edges(spark):
    k = "query string, rank int, gain double, relevant boolean"
    df = spark.createDataFrame([("q", 1, 0.0, False), ("q", 2, 1.0, True), ("z", 1, 0.0, False)], k)
    assert rows(e.hit_mrr(df, 1)) == [(0.0, 0.25)]
    assert rows(e.ndcg(df, 2), "query") == [("q", pytest.approx(0.63093, abs=1e-5)), ("z", 1.0)]
    solo = spark.createDataFrame([("q", 1, 1.0, 1.0)], "query string, item int, x double, y double")
    assert rows(e.kendall(solo)) == [("q", 1.0)]


def test_security_hides_unknown_classes(spark):
    df = spark.createDataFrame([(1, "a", "b")], "id int, x string, y string")
    assert rows(e.disclose(df, {"x": "public", "y": "??"}, "confidential")) == [(1, "a", None)]


def test_top_each_equals_all_pairs(spark):
    """Copies, zeros, nulls, odd numbers and lengths: what cosine itself gives for each
    pair; and no pair of a query and an item becomes a row."""
    from pyspark.sql import Window

    from weftgraph.operators import retrieval as v

    vecs = [[float((i * 7 + j * 5) % 11 - 5) for j in range(4)] for i in range(60)] + [[1.0, 1.0, 0.0, 0.0]] * 9
    vecs += [[0.0] * 4, None, [1.0, None, 0.0, 0.0], [float("nan"), 1.0, 0.0, 0.0], [1e200, 1.0, 0.0, 0.0], [1.0, 2.0], [], [1.0, 0.0, 0.0, 8000.0]]
    items = spark.createDataFrame([(i, x) for i, x in enumerate(vecs)], "id long, embedding array<double>").repartition(3)
    asked = items.where("id % 3 = 0 or id > 66").select(F.col("id").alias("query"), F.col("embedding").alias("q"))
    pairs = items.crossJoin(asked).select("query", "id", F.round(v.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where("rank <= 5")
    got = v.top_each(items, asked, 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "zip_with" not in got._jdf.queryExecution().toString()
