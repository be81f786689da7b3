"""Graph analytics on the part graph and the transfer graph."""

from pyspark.sql import functions as F

from weftgraph.operators import analytics as a
from weftgraph.plans.demo import PARTS, TRANSFERS, parts, table, transfers
from weftgraph.registry import query

PAIRS = f"{PARTS}, pairs AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM parts), nbr AS (SELECT a AS n, b AS m FROM pairs UNION ALL SELECT b, a FROM pairs)"
DEGREES = f"{PARTS}, degrees AS (SELECT node, SUM(o) AS outdeg, SUM(i) AS indeg, COUNT(*) AS degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM parts UNION ALL SELECT dst, 0, 1 FROM parts) GROUP BY node)"


@query("degree_topk", "N1 T1", f"WITH {DEGREES} SELECT node, CAST(outdeg AS BIGINT) AS outdeg, CAST(indeg AS BIGINT) AS indeg, degree FROM degrees ORDER BY degree DESC, node LIMIT 25")
def degree_topk(spark, sf):
    return a.top_degrees(parts(spark, sf), 25)


@query("hub_tier", "N8 A7", f"WITH {DEGREES}, c AS (SELECT quantile_disc(degree, 0.99) AS hi, quantile_disc(degree, 0.5) AS mid FROM degrees) SELECT node, degree, CASE WHEN degree >= hi THEN 2 WHEN degree >= mid THEN 1 ELSE 0 END AS tier FROM degrees, c")
def hub_tier(spark, sf):
    return a.hub_tiers(parts(spark, sf))


@query("degree_hint", "N9 A7", f"WITH {PARTS}, o AS (SELECT src, COUNT(*) AS n FROM parts GROUP BY src), i AS (SELECT dst, COUNT(*) AS n FROM parts GROUP BY dst), oo AS (SELECT quantile_disc(n, 0.5) AS out_median, quantile_disc(n, 0.99) AS out_p99, MAX(n) AS out_max FROM o), ii AS (SELECT quantile_disc(n, 0.5) AS in_median, MAX(n) AS in_max FROM i) SELECT *, out_max > 10 * out_median AS heavy_tailed FROM oo, ii")
def degree_hint(spark, sf):
    return a.degree_hint(parts(spark, sf))


@query("multiplicity_profile", "N10", f"WITH {TRANSFERS}, m AS (SELECT src, dst, COUNT(*) AS m FROM transfers GROUP BY src, dst) SELECT CAST(SUM(m) AS BIGINT) AS edges, COUNT(*) AS pairs, CAST(SUM(m) - COUNT(*) AS BIGINT) AS redundant, MAX(m) AS most, COUNT(*) FILTER (WHERE m > 1) AS dup_pairs, round(100 * CAST(SUM(m) FILTER (WHERE m > 1) AS DOUBLE) / CAST(SUM(m) AS DOUBLE), 4) AS dup_percent FROM m")
def multiplicity(spark, sf):
    return a.multiplicity(transfers(spark, sf))


@query("degree_profile", "N11 W-1", f"WITH {DEGREES}, r AS (SELECT node, degree, row_number() OVER (ORDER BY degree DESC, node) AS rank, COUNT(*) OVER () AS n FROM degrees), t AS (SELECT 'hub' AS anchor, 0.0 AS q UNION ALL SELECT 'p999', 0.001 UNION ALL SELECT 'p99', 0.01 UNION ALL SELECT 'median', 0.5) SELECT node, degree, rank, anchor FROM r JOIN t ON rank = CAST(floor(n * CAST(q AS DOUBLE)) AS BIGINT) + 1")
def degree_profile(spark, sf):
    return a.degree_profile(parts(spark, sf))


LEVELS = f"{PARTS}, o AS (SELECT src, COUNT(*) AS d FROM parts GROUP BY src), lv AS (SELECT p.src, COUNT(*) AS l1, CAST(SUM(COALESCE(o.d, 0)) AS BIGINT) AS l2 FROM parts p LEFT JOIN o ON o.src = p.dst GROUP BY p.src)"


@query("l1_l2_levels", "N13 N15", f"WITH {LEVELS} SELECT src, l1, l2, round(l2 * (l2 / l1), 4) AS cost FROM lv")
def l1_l2(spark, sf):
    return a.cost_estimate(a.levels(parts(spark, sf)), 3).withColumn("cost", F.round("cost", 4))


@query("curated_anchors", "N14 T3 A11", f"WITH {LEVELS}, c AS (SELECT 0.1 AS band, quantile_disc(l2, 0.1) AS mark FROM lv UNION ALL SELECT 0.5, quantile_disc(l2, 0.5) FROM lv UNION ALL SELECT 0.99, quantile_disc(l2, 0.99) FROM lv), n AS (SELECT CAST(band AS DOUBLE) AS band, src, l2, abs(l2 - mark) AS gap FROM lv, c), r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY gap, src) AS r FROM n) SELECT band, src, l2, gap, round(stddev_pop(l2) OVER (PARTITION BY band) / avg(l2) OVER (PARTITION BY band), 6) AS cv FROM r WHERE r <= 5")
def curated(spark, sf):
    return a.curate(a.levels(parts(spark, sf)), "src", [0.1, 0.5, 0.99], 5)


@query("local_clustering", "N3", f"WITH {PAIRS}, t AS (SELECT x.n AS node, COUNT(*) AS triangles FROM nbr x JOIN nbr y ON x.n = y.n AND x.m < y.m JOIN pairs p ON p.a = x.m AND p.b = y.m GROUP BY x.n), d AS (SELECT n AS node, COUNT(*) AS degree FROM nbr GROUP BY n) SELECT node, degree, COALESCE(triangles, 0) AS triangles, round(CASE WHEN degree > 1 THEN 2 * COALESCE(triangles, 0) / (degree * (degree - 1)) ELSE 0 END, 6) AS coefficient FROM d LEFT JOIN t USING (node)")
def local_clustering(spark, sf):
    return a.clustering(parts(spark, sf)).withColumn("coefficient", F.round("coefficient", 6))


@query("node_similarity", "N2", f"WITH {PARTS}, d AS (SELECT src, COUNT(*) AS d FROM parts GROUP BY src), i AS (SELECT x.src AS a, y.src AS b, COUNT(*) AS i FROM parts x JOIN parts y ON x.dst = y.dst AND x.src < y.src GROUP BY 1, 2) SELECT a, b, round(i / (da.d + db.d - i), 6) AS similarity FROM i JOIN d da ON da.src = a JOIN d db ON db.src = b WHERE i / (da.d + db.d - i) >= 0.08")
def node_similarity(spark, sf):
    return a.neighbour_similarity(parts(spark, sf), 0.08).withColumn("similarity", F.round("similarity", 6))


@query("adamic_adar", "N4", f"WITH {PAIRS}, d AS (SELECT n, COUNT(*) AS d FROM nbr GROUP BY n), s AS (SELECT x.m AS a, y.m AS b, SUM(1 / ln(d.d)) AS score FROM nbr x JOIN nbr y ON x.n = y.n AND x.m < y.m JOIN d ON d.n = x.n GROUP BY 1, 2) SELECT a, b, round(score, 6) AS score FROM s WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.a = s.a AND p.b = s.b) ORDER BY round(s.score, 9) DESC, a, b LIMIT 50")
def adamic(spark, sf):
    return a.adamic_adar(parts(spark, sf), 50).withColumn("score", F.round("score", 6))


def _copies(spark, sf):
    """Documents linked to the least document of the same text or the same source and length."""
    docs = table(spark, sf, "documents")
    same = docs.groupBy("text").agg(F.min("doc_id").alias("dst")).join(docs.select("text", F.col("doc_id").alias("src")), "text")
    alike = docs.groupBy("source", "n_chars").agg(F.min("doc_id").alias("dst")).join(docs.select("source", "n_chars", F.col("doc_id").alias("src")), ["source", "n_chars"])
    return same.select("src", "dst").unionByName(alike.select("src", "dst")).where("src <> dst")


COPIES = "e AS (SELECT doc_id AS src, MIN(doc_id) OVER (PARTITION BY text) AS dst FROM documents UNION SELECT doc_id, MIN(doc_id) OVER (PARTITION BY source, n_chars) FROM documents), u AS (SELECT src AS a, dst AS b FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst)"


@query("connected_components", "N5 W19", f"WITH RECURSIVE {COPIES}, r(node, root) AS (SELECT a, a FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node) SELECT node, MIN(root) AS component FROM r GROUP BY node")
def connected(spark, sf):
    return a.components(_copies(spark, sf))


#: Ten rounds of votes, one after the other.
VOTES = ", ".join(f"l{i + 1} AS MATERIALIZED (SELECT n, l FROM (SELECT n, l, row_number() OVER (PARTITION BY n ORDER BY COUNT(*) DESC, l) AS r FROM (SELECT u.a AS n, l{i}.l FROM u JOIN l{i} ON l{i}.n = u.b UNION ALL SELECT n, l FROM l{i}) GROUP BY n, l) WHERE r = 1)" for i in range(10))


@query("label_communities", "N6 N19", f"WITH {COPIES}, l0 AS (SELECT DISTINCT a AS n, a AS l FROM u), {VOTES}, r AS (SELECT n, l, row_number() OVER (PARTITION BY l ORDER BY n) AS r FROM l10) SELECT l AS community, COUNT(*) AS size, string_agg(CASE WHEN r <= 6 THEN CAST(n AS VARCHAR) END, ',' ORDER BY n) AS sample FROM r GROUP BY l")
def communities(spark, sf):
    found = a.community_samples(a.label_propagation(_copies(spark, sf)))
    return found.withColumn("sample", F.array_join("sample", ","))


#: Twenty rounds of ranks.
RANKS = ", ".join(f"r{i + 1} AS MATERIALIZED (SELECT n.node, n.d, 0.15 / c.n + 0.85 * (COALESCE(g.r, 0.0) + z.idle / c.n) AS rank FROM nodes n CROSS JOIN c CROSS JOIN (SELECT COALESCE(SUM(rank) FILTER (WHERE d IS NULL), 0.0) AS idle FROM r{i}) z LEFT JOIN (SELECT e.dst AS node, SUM(s.rank / s.d) AS r FROM parts e JOIN r{i} s ON s.node = e.src GROUP BY 1) g ON g.node = n.node)" for i in range(20))


@query("pagerank_topk", "N17", f"WITH {PARTS}, o AS (SELECT src, COUNT(*) AS d FROM parts GROUP BY src), nodes AS MATERIALIZED (SELECT node, o.d FROM (SELECT src AS node FROM parts UNION SELECT dst FROM parts) LEFT JOIN o ON o.src = node), c AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n FROM nodes), r0 AS (SELECT node, d, 1 / c.n AS rank FROM nodes, c), {RANKS} SELECT node, round(rank, 9) AS rank FROM r20 ORDER BY 2 DESC, 1 LIMIT 10")
def pagerank(spark, sf):
    return a.pagerank(parts(spark, sf)).withColumn("rank", F.round("rank", 9)).orderBy(F.desc("rank"), "node").limit(10)


@query("khop_reach_2", "G26 D10 T6", f"WITH {PARTS}, o AS (SELECT DISTINCT dst AS node FROM parts WHERE src = 7), t AS (SELECT DISTINCT p.dst AS node FROM parts p JOIN o ON o.node = p.src) SELECT node, CAST(MIN(h) AS INTEGER) AS hops FROM (SELECT node, 1 AS h FROM o UNION ALL SELECT node, 2 FROM t) GROUP BY node HAVING node <> 7")
def khop2(spark, sf):
    return a.reach(parts(spark, sf), spark.createDataFrame([(7,)], "node long"), 2)


@query("khop_reach_3", "G26 G5 G22", f"WITH RECURSIVE {PARTS}, r(node, h) AS (SELECT dst, 1 FROM parts WHERE src = 7 UNION SELECT p.dst, r.h + 1 FROM r JOIN parts p ON p.src = r.node WHERE r.h < 3) SELECT node, MIN(h) AS hops FROM r GROUP BY node")
def khop3(spark, sf):
    return a.reach(parts(spark, sf), spark.createDataFrame([(7,)], "node long"), 3, include_start=True)


@query("ext_reach", "D9 D10", f"WITH {TRANSFERS}, b AS (SELECT DISTINCT src, dst FROM transfers), s AS (SELECT dst FROM b WHERE src = 3) SELECT COUNT(DISTINCT b.src) AS reached FROM b JOIN s ON b.dst = s.dst WHERE b.src <> 3")
def ext_reach(spark, sf):
    t = transfers(spark, sf).select("src", "dst").distinct()
    return t.join(t.where("src = 3").select("dst"), "dst", "left_semi").where("src <> 3").agg(F.countDistinct("src").alias("reached"))
