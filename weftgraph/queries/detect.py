"""Detectors and analyst questions on orders and line items."""

from pyspark.sql import functions as F

from weftgraph.operators import detect as d
from weftgraph.plans.demo import PARTS, TRANSFERS, epoch, money, parts, table, total, transfers
from weftgraph.registry import query

SUM = "CAST(SUM(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"


@query("flagship_small_leg_owner", "D1 A1 A2 A4 S21", f"""WITH {TRANSFERS} SELECT dst AS owner, {SUM.format('amount')} AS total, COUNT(DISTINCT src) AS parties, COUNT(*) AS legs FROM transfers WHERE amount <= 20000 GROUP BY dst HAVING SUM(CAST(amount AS DECIMAL(18,2))) > 1000000 AND COUNT(DISTINCT src) >= 50 AND COUNT(*) >= 50""")
def flagship(spark, sf):
    return d.small_leg_owners(transfers(spark, sf), "dst", 20_000, 1_000_000, 50, 50)


@query("funnel_accounts", "D3", f"""WITH {TRANSFERS}, i AS (SELECT dst AS account, COUNT(DISTINCT src) AS senders, {SUM.format('amount')} AS collected, MAX(ts) AS last_in FROM transfers WHERE channel = 'A' GROUP BY dst), o AS (SELECT dst AS account, MAX(amount) AS largest_out, MIN(ts) AS first_out FROM transfers WHERE channel = 'R' GROUP BY dst) SELECT account, senders, collected, largest_out FROM i JOIN o USING (account) WHERE senders >= 20 AND first_out >= last_in - 400000000 AND largest_out >= 0.01 * collected""")
def funnel(spark, sf):
    t = transfers(spark, sf)
    back = t.where("channel = 'R'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "amount", "ts")
    return d.funnels(t.where("channel = 'A'"), back, 20, 400_000_000, 0.01)


RING = "SELECT DISTINCT e1.src AS a, e1.dst AS b, e2.dst AS c FROM {0} e1 JOIN {0} e2 ON e1.dst = e2.src JOIN {0} e3 ON e2.dst = e3.src AND e3.dst = e1.src WHERE e1.src < e1.dst AND e2.dst > e1.src"


@query("ring_3cycle", "D2 G26 F30", f"WITH {PARTS} {RING.format('parts')}")
def ring(spark, sf):
    return d.rings(parts(spark, sf))


@query("ring_3cycle_bounded", "D2 N12", f"WITH {PARTS}, few AS (SELECT src FROM parts GROUP BY src HAVING COUNT(*) <= 40), e AS (SELECT * FROM parts WHERE src IN (SELECT src FROM few)) {RING.format('e')}")
def ring_bounded(spark, sf):
    """The detector with its stated bound: sources of at most 40 edges."""
    return d.rings(parts(spark, sf), 40)


@query("ring_selectivity_funnel", "D8 A3", f"""WITH {PARTS}, r AS (SELECT e1.src AS a, e1.dst AS b, e2.dst AS c FROM parts e1 JOIN parts e2 ON e1.dst = e2.src JOIN parts e3 ON e2.dst = e3.src AND e3.dst = e1.src WHERE e1.src < e1.dst AND e2.dst > e1.src) SELECT COUNT(*) AS rings, COUNT(*) FILTER (WHERE a % 2 = 0) AS even_start, COUNT(*) FILTER (WHERE a % 2 = 0 AND b % 2 = 0) AS even_pair, COUNT(*) FILTER (WHERE a % 2 = 0 AND b % 2 = 0 AND c % 2 = 0) AS even_all FROM r""")
def ring_funnel(spark, sf):
    even = [F.col(x) % 2 == 0 for x in "abc"]
    return d.rings(parts(spark, sf)).agg(F.count(F.lit(1)).alias("rings"), F.count_if(even[0]).alias("even_start"), F.count_if(even[0] & even[1]).alias("even_pair"), F.count_if(even[0] & even[1] & even[2]).alias("even_all"))


@query("chain_4leg", "D4", """SELECT DISTINCT s.s_suppkey AS supplier FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey WHERE o.o_orderpriority = '1-URGENT' AND l.l_quantity > 45 AND n.n_regionkey = 1""")
def chain(spark, sf):
    o = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    li = table(spark, sf, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_suppkey")
    n = table(spark, sf, "nation").where("n_regionkey = 1").select("n_nationkey")
    legs = d.chains((o, None), (li, F.col("l_orderkey") == F.col("o_orderkey")), (table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")), (n, F.col("n_nationkey") == F.col("s_nationkey")))
    return legs.select(F.col("s_suppkey").alias("supplier")).distinct()


@query("common_control_pairs", "D5 F30", f"""WITH {PARTS}, p AS (SELECT src AS a, dst AS b FROM parts WHERE src < dst) SELECT DISTINCT p.a, p.b FROM p JOIN part x ON x.p_partkey = p.a JOIN part y ON y.p_partkey = p.b WHERE x.p_brand = y.p_brand AND EXISTS (SELECT 1 FROM parts q WHERE q.src = p.b AND q.dst = p.a)""")
def common_control(spark, sf):
    e = parts(spark, sf)
    brand = table(spark, sf, "part").select("p_partkey", "p_brand")
    a, b = brand.toDF("a", "ba"), brand.toDF("b", "bb")
    pairs = e.where("src < dst").toDF("a", "b").join(a, "a").join(b, "b").where("ba = bb").select("a", "b").distinct()
    return d.either_way(pairs, e.where("src > dst"))


@query("stake_after_inbound", "D6 W-5", """SELECT user_id, event_id AS id, CAST(lag AS BIGINT) AS lag FROM (SELECT user_id, event_id, event_type, t - last_value(CASE WHEN event_type = 'signup' THEN t END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lag FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)) WHERE event_type = 'purchase' AND lag <= 86400""")
def stake(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("id"), F.col("event_type").alias("kind"), epoch("ts").alias("ts"))
    return d.followed_within(e, "user_id", "signup", "purchase", 86_400)


@query("structuring_window_7d", "D11", """SELECT o_custkey, MAX(n) AS most FROM (SELECT o_custkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY CAST(epoch(o_orderdate) AS BIGINT) RANGE BETWEEN 2591999 PRECEDING AND CURRENT ROW) AS n FROM orders WHERE o_totalprice < 300000) GROUP BY o_custkey HAVING MAX(n) >= 3""")
def structuring(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.col("o_totalprice").alias("amount"), epoch("o_orderdate").alias("ts"))
    return d.structuring(o, "o_custkey", 30, 300_000, 3)


@query("monotone_time_path", "D11 G5", f"""WITH {TRANSFERS}, b AS (SELECT dst AS src, src AS dst, ts FROM transfers WHERE channel = 'R') SELECT f.src AS a, s.dst AS b, COUNT(*) AS paths FROM transfers f JOIN b s ON f.dst = s.src AND s.ts > f.ts AND s.ts <= f.ts + 86400 WHERE f.channel = 'N' GROUP BY 1, 2""")
def monotone(spark, sf):
    t = transfers(spark, sf)
    back = t.where("channel = 'R'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "ts")
    return d.monotone_pairs(t.where("channel = 'N'"), back, 86_400)


@query("detector_precision_recall", "D7 E6 T7", """WITH f AS (SELECT doc_id FROM documents WHERE n_chars < 2000), t AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0), n AS (SELECT COUNT(*) FILTER (WHERE f.doc_id IS NOT NULL AND t.doc_id IS NOT NULL) AS hits, COUNT(f.doc_id) AS found, COUNT(t.doc_id) AS truth FROM f FULL JOIN t ON f.doc_id = t.doc_id) SELECT hits, found, truth, hits / found AS precision, hits / truth AS recall FROM n""")
def detector_pr(spark, sf):
    found = table(spark, sf, "documents").where("n_chars < 2000")
    return d.precision_recall(found, table(spark, sf, "labels").where("quality = 0"), "doc_id")


# analyst questions


@query("ext_in_totals", "D9 A2", f"""WITH {TRANSFERS} SELECT dst, {SUM.format('amount')} AS total, COUNT(*) AS n, MAX(amount) AS largest FROM transfers GROUP BY dst""")
def ext_in_totals(spark, sf):
    return transfers(spark, sf).groupBy("dst").agg(total("amount").alias("total"), F.count(F.lit(1)).alias("n"), F.max("amount").alias("largest"))


@query("ext_out_max", "D9 T1 T2", f"""WITH {TRANSFERS} SELECT src, MAX(amount) AS largest FROM transfers GROUP BY src ORDER BY largest DESC, src LIMIT 5""")
def ext_out_max(spark, sf):
    return transfers(spark, sf).groupBy("src").agg(F.max("amount").alias("largest")).orderBy(F.desc("largest"), "src").limit(5)


@query("ext_risky_senders", "D9 A4", f"""WITH {TRANSFERS} SELECT dst, COUNT(DISTINCT src) AS senders FROM transfers WHERE channel = 'R' GROUP BY dst HAVING COUNT(DISTINCT src) > 50""")
def ext_risky(spark, sf):
    return transfers(spark, sf).where("channel = 'R'").groupBy("dst").agg(F.countDistinct("src").alias("senders")).where("senders > 50")


@query("ext_owners", "D9", """SELECT n_name AS nation, COUNT(*) AS suppliers, CAST(SUM(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""")
def ext_owners(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"), total("s_acctbal").alias("balance"))


@query("int_totals", "D9 A3", f"""WITH {TRANSFERS} SELECT channel, COUNT(*) AS n, {SUM.format('amount')} AS total, {SUM.format("CASE WHEN amount > 50000 THEN amount ELSE 0 END")} AS large FROM transfers GROUP BY channel""")
def int_totals(spark, sf):
    return transfers(spark, sf).groupBy("channel").agg(F.count(F.lit(1)).alias("n"), total("amount").alias("total"), total(F.when(F.col("amount") > 50_000, F.col("amount")).otherwise(0)).alias("large"))


@query("int_top_channels", "D9 N16", f"""WITH {TRANSFERS} SELECT src, channel, COUNT(*) AS tx_count FROM transfers GROUP BY src, channel ORDER BY tx_count DESC, src, channel LIMIT 20""")
def int_top_channels(spark, sf):
    return transfers(spark, sf).groupBy("src", "channel").agg(F.count(F.lit(1)).alias("tx_count")).orderBy(F.desc("tx_count"), "src", "channel").limit(20)


@query("int_same_owner_pairs", "D9", f"""WITH {TRANSFERS} SELECT COUNT(*) AS n, {SUM.format('amount')} AS total FROM transfers JOIN customer ON c_custkey = src JOIN supplier ON s_suppkey = dst WHERE c_nationkey = s_nationkey""")
def int_same_owner(spark, sf):
    t = transfers(spark, sf)
    c, s = table(spark, sf, "customer").select("c_custkey", "c_nationkey"), table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    own = t.join(c, F.col("src") == F.col("c_custkey")).join(s, (F.col("dst") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return own.agg(F.count(F.lit(1)).alias("n"), total("amount").alias("total"))


@query("int_fan_in", "D9 A1 A4", f"""WITH {TRANSFERS} SELECT dst, COUNT(DISTINCT src) AS senders FROM transfers GROUP BY dst HAVING COUNT(DISTINCT src) > 100""")
def int_fan_in(spark, sf):
    return transfers(spark, sf).groupBy("dst").agg(F.countDistinct("src").alias("senders")).where("senders > 100")


@query("int_multi_layer_pairs", "D9 A5", f"""WITH {TRANSFERS} SELECT channel, COUNT(DISTINCT (src, dst)) AS pairs FROM transfers GROUP BY channel""")
def int_multi_layer(spark, sf):
    return transfers(spark, sf).groupBy("channel").agg(F.countDistinct("src", "dst").alias("pairs"))


@query("int_structuring_party", "D9 D1", f"""WITH {TRANSFERS} SELECT src AS owner, {SUM.format('amount')} AS total, COUNT(DISTINCT dst) AS parties, COUNT(*) AS legs FROM transfers WHERE amount <= 10000 GROUP BY src HAVING SUM(CAST(amount AS DECIMAL(18,2))) > 20000 AND COUNT(DISTINCT dst) >= 3 AND COUNT(*) >= 3""")
def int_structuring(spark, sf):
    return d.small_leg_owners(transfers(spark, sf), "src", 10_000, 20_000, 3, 3, party="dst")


@query("weighted_band_pick", "W-3 W-2 S22", """WITH s AS (SELECT l_returnflag AS code, COUNT(*) AS share FROM lineitem GROUP BY 1), b AS (SELECT code, SUM(share) OVER (ORDER BY code ROWS UNBOUNDED PRECEDING) - share AS lo, SUM(share) OVER (ORDER BY code ROWS UNBOUNDED PRECEDING) AS hi, SUM(share) OVER () AS total FROM s) SELECT code, COUNT(*) AS n FROM orders JOIN b ON (o_orderkey % 1000) * total >= lo * 1000 AND (o_orderkey % 1000) * total < hi * 1000 GROUP BY code""")
def weighted_band(spark, sf):
    from pyspark.sql import Window

    share = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("code")).agg(F.count(F.lit(1)).alias("share"))
    run = F.sum("share").over(Window.orderBy("code").rowsBetween(Window.unboundedPreceding, 0))
    # one row a channel
    bands = share.select("code", (run - F.col("share")).alias("lo"), run.alias("hi"), F.sum("share").over(Window.partitionBy()).alias("total"))
    pick = (F.col("o_orderkey") % 1000) * F.col("total")
    return table(spark, sf, "orders").join(F.broadcast(bands), (pick >= F.col("lo") * 1000) & (pick < F.col("hi") * 1000)).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("running_money_by_customer", "W-1 A2", """SELECT o_custkey, o_orderkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM orders""")
def running(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.sum(money("o_totalprice")).over(w).cast("double").alias("running"))
