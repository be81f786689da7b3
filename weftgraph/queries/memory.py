"""The event memory on the events table."""

from pyspark.sql import functions as F

from weftgraph.operators import memory as m
from weftgraph.plans.demo import epoch, table
from weftgraph.registry import query


def _events(spark, sf):
    """Users as memories; every tenth event is sent twice under one key."""
    e = table(spark, sf, "events")
    own = e.select(F.concat(F.lit("ws"), (F.col("user_id") % 3).cast("string")).alias("workspace"), F.col("user_id").alias("memory_id"), F.col("event_id").cast("string").alias("key"), F.col("props").alias("payload"), "event_type", (F.col("event_id") * 2).alias("ordinal"))
    again = own.where("cast(key as long) % 10 = 0").withColumn("ordinal", F.col("ordinal") + 100_001)
    return own.unionByName(again)


def _sequenced(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("memory_id"), F.col("event_id").alias("sequence"), "event_type", "value", epoch("ts").alias("ts"))


SEQ = "s AS (SELECT user_id AS memory_id, event_id AS sequence, event_type, value, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events)"


@query("memory_commit", "M1 W-5", "SELECT 'ws' || (user_id % 3) AS workspace, CAST(event_id AS VARCHAR) AS key, user_id AS memory_id, event_type, props AS payload, event_id * 2 AS ordinal, CAST(row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS INTEGER) AS sequence, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS revision, CAST(nullif(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1, 0) AS INTEGER) AS supersedes, event_id = MAX(event_id) OVER (PARTITION BY user_id) AS canonical FROM events")
def commit(spark, sf):
    return m.commit(_events(spark, sf))


@query("memory_replay_conflicts", "M1", "SELECT 'ws0' AS workspace, CAST(event_type AS VARCHAR) AS key, COUNT(DISTINCT props) AS payloads FROM events GROUP BY event_type HAVING COUNT(DISTINCT props) > 1")
def conflicts(spark, sf):
    e = table(spark, sf, "events").select(F.lit("ws0").alias("workspace"), F.col("event_type").alias("key"), F.col("props").alias("payload"))
    return m.replay_conflicts(e)


@query("memory_transition_violations", "M2", f"WITH {SEQ}, b AS (SELECT *, COALESCE(lag(event_type) OVER (PARTITION BY memory_id ORDER BY sequence), '__initial__') AS before FROM s) SELECT event_type, before, COUNT(*) AS n FROM b WHERE NOT ((event_type = 'purchase' AND before IN ('click', 'view')) OR (event_type <> 'purchase' AND before <> 'error')) GROUP BY 1, 2")
def transitions(spark, sf):
    anything = ["__initial__", "click", "purchase", "signup", "view"]
    rules = {"purchase": ["click", "view"], **{k: anything for k in ("click", "error", "signup", "view")}}
    return m.transition_violations(_sequenced(spark, sf), rules).groupBy("event_type", "before").agg(F.count(F.lit(1)).alias("n"))


@query("memory_asof", "M3 A10", f"WITH {SEQ} SELECT memory_id, arg_max(event_type, sequence) AS event_type, MAX(sequence) AS sequence, arg_max(value, sequence) AS value FROM s WHERE sequence <= 5000 GROUP BY memory_id")
def asof(spark, sf):
    return m.as_of(_sequenced(spark, sf).drop("ts"), 5000)


@query("memory_asof_join", "M3", f"WITH {SEQ}, c AS (SELECT * FROM s WHERE event_type = 'click'), p AS (SELECT * FROM s WHERE event_type = 'purchase') SELECT p.memory_id, p.sequence, (SELECT arg_max(c.value, c.sequence) FROM c WHERE c.memory_id = p.memory_id AND c.sequence <= p.sequence) AS value FROM p")
def asof_join(spark, sf):
    s = _sequenced(spark, sf)
    return m.as_of_join(s.where("event_type = 'purchase'"), s.where("event_type = 'click'"), "memory_id", "sequence", "value")


@query("memory_history", "M4", f"WITH {SEQ} SELECT sequence, event_type, value FROM s WHERE memory_id = 7 ORDER BY sequence DESC LIMIT 25")
def history(spark, sf):
    return m.history(_sequenced(spark, sf), 7, 25).select("sequence", "event_type", "value")


@query("memory_backlog", "M5", f"WITH {SEQ} SELECT COUNT(*) AS pending, 1706745600 - MIN(ts) AS oldest_seconds FROM s WHERE sequence > 9000")
def backlog(spark, sf):
    return m.backlog(_sequenced(spark, sf), 9000, F.lit(1_706_745_600))


@query("memory_acknowledge", "M6 M9", "WITH s AS (SELECT event_type AS p, MAX(event_id) AS seq, MAX(user_id % 5) AS f FROM events WHERE value <= 5 GROUP BY 1), a AS (SELECT event_type AS p, event_id AS seq, user_id % 7 AS f FROM events WHERE value > 5), o AS (SELECT a.* FROM a LEFT JOIN s ON s.p = a.p WHERE s.f IS NULL OR a.f >= s.f) SELECT p AS projection, MAX(seq) AS sequence, MAX(f) AS fence FROM (SELECT * FROM s UNION ALL SELECT * FROM o) GROUP BY 1")
def acknowledge(spark, sf):
    """Small events as the projections' state, large ones as acknowledgements, of which
    those with an older fence are refused."""
    e = table(spark, sf, "events")
    state = e.where("value <= 5").groupBy(F.col("event_type").alias("projection")).agg(F.max("event_id").alias("sequence"), F.max(F.col("user_id") % 5).alias("fence"))
    return m.acknowledge(state, e.where("value > 5").select(F.col("event_type").alias("projection"), F.col("event_id").alias("sequence"), (F.col("user_id") % 7).alias("fence")))


@query("reorg_reconcile", "M7", "WITH b AS (SELECT user_id % 5 AS c, event_id // 20 AS h, event_type AS block, event_id AS event, event_id AS o FROM events), f AS (SELECT c, h, block, MIN(o) AS seen FROM b GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY c, h ORDER BY seen DESC, block) AS r FROM f) SELECT 'c' || c AS chain, h AS height, block, event, CASE WHEN r = 1 THEN 'canonical' ELSE 'orphaned' END AS status FROM b JOIN r USING (c, h, block)")
def reorg(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")).alias("chain"), F.expr("event_id div 20").alias("height"), F.col("event_type").alias("block"), F.col("event_id").alias("event"), F.col("event_id").alias("ordinal"))
    return m.reconcile(e.unionByName(e.withColumn("ordinal", F.col("ordinal") + 1_000_000)))


@query("risk_aggregate", "M8", "SELECT user_id, greatest(CAST(SUM(CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN -1 ELSE 0 END) AS BIGINT), 0) AS flagged FROM events GROUP BY user_id")
def risk(spark, sf):
    d = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "signup", -1).otherwise(0)
    return m.risk_totals(table(spark, sf, "events").select("user_id", d.alias("delta")), "user_id")


@query("shard_frontier", "M10", "SELECT event_type AS domain, CAST(user_id % 4 AS INTEGER) AS shard, MAX(event_id) AS sequence FROM events GROUP BY 1, 2")
def frontier(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("domain"), (F.col("user_id") % 4).cast("int").alias("shard"), F.col("event_id").alias("sequence"))
    return m.merge_frontiers(e.where("sequence % 2 = 0"), e.where("sequence % 2 = 1"))


@query("outbox_projection", "M11", "WITH l AS (SELECT arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id) SELECT event_type AS dst, COUNT(*) AS n FROM l GROUP BY 1")
def outbox(spark, sf):
    return m.project(m.commit(_events(spark, sf)))[1].groupBy("dst").agg(F.count(F.lit(1)).alias("n"))


@query("debate_stop", "M13", "WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rd, MAX(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS score FROM events), d AS (SELECT *, CASE WHEN rd = 1 THEN 1 WHEN score - lag(score) OVER (PARTITION BY user_id ORDER BY rd) > 0.1 THEN 1 ELSE 0 END AS moved FROM r), s AS (SELECT *, moved + COALESCE(lag(moved) OVER (PARTITION BY user_id ORDER BY rd), 0) AS m FROM d) SELECT user_id AS debate, CAST(COALESCE(MIN(CASE WHEN m = 0 AND rd > 2 THEN rd END), MAX(rd)) AS INTEGER) AS stops_at FROM s GROUP BY 1")
def debate(spark, sf):
    """Users' events as rounds, scored by the best value so far."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    best = F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return m.stop_round(table(spark, sf, "events").select(F.col("user_id").alias("debate"), F.row_number().over(w).alias("round"), best.alias("score")), 0.1)


@query("chain_events", "M15 X36", "SELECT l_orderkey AS tx, COUNT(*) AS events FROM (SELECT l_orderkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) GROUP BY 1")
def chain(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.col("l_suppkey").cast("string"))).alias("outputs"))
    o = table(spark, sf, "orders")
    t = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.year("o_orderdate").alias("block"), F.col("o_orderkey").alias("tx"), F.array(F.col("o_custkey").cast("string")).alias("inputs"), "outputs")
    return m.chain_events(t).groupBy("tx").agg(F.count(F.lit(1)).alias("events"))


@query("latest_active_keys", "X30 X32", "SELECT user_id AS memory_id, MAX(event_id) AS last, COUNT(*) AS n FROM events GROUP BY user_id HAVING COUNT(*) >= 2 ORDER BY last DESC, memory_id LIMIT 15")
def active(spark, sf):
    return m.latest_active(_sequenced(spark, sf), 15)


@query("projection_parity", "X31", "SELECT COUNT(DISTINCT user_id) AS source, COUNT(DISTINCT CASE WHEN event_type = 'error' THEN user_id END) AS projected, COUNT(DISTINCT user_id) - COUNT(DISTINCT CASE WHEN event_type = 'error' THEN user_id END) AS missing, 0 AS extra FROM events")
def parity(spark, sf):
    e = table(spark, sf, "events")
    return m.parity(e, e.where("event_type = 'error'"), "user_id")


@query("event_rollup", "A13 (extension)", "SELECT event_type, CAST(user_id % 3 AS INTEGER) AS ws, COUNT(*) AS n FROM events GROUP BY ROLLUP (event_type, CAST(user_id % 3 AS INTEGER))")
def rollup(spark, sf):
    return table(spark, sf, "events").select("event_type", (F.col("user_id") % 3).cast("int").alias("ws")).rollup("event_type", "ws").agg(F.count(F.lit(1)).alias("n"))


@query("event_windows", "M12 (extension)", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2")
def windows(spark, sf):
    e = table(spark, sf, "events").groupBy(F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.select("start", "event_type", "n")


@query("approx_users", "A14", "SELECT event_type, TRUE AS close, COUNT(DISTINCT user_id) AS users FROM events GROUP BY 1")
def approx(spark, sf):
    """The sketch's estimate beside the exact count, of which it is within a tenth."""
    u = table(spark, sf, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("about"), F.countDistinct("user_id").alias("users"))
    return u.select("event_type", (F.abs(F.col("about") - F.col("users")) <= 0.1 * F.col("users")).alias("close"), "users")
