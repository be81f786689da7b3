"""Versioned event memory in batch form.

Events carry workspace, memory_id, key (idempotency), payload, event_type, ordinal (order
of arrival). Revisions are windows by memory; sequences are windows by workspace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .analytics import ranked_within


def N():  # noqa: N802
    return F.count(F.lit(1))



def commit(events: DataFrame) -> DataFrame:
    """M1: a key that comes again with the same payload is one event (its first arrival);
    each event gets the workspace's next sequence and its memory's next revision, and only
    a memory's last revision is canonical."""
    first = events.groupBy("workspace", "key").agg(F.min_by(F.struct("memory_id", "event_type", "payload", "ordinal"), "ordinal").alias("e")).select("workspace", "key", "e.*")
    by_mem = Window.partitionBy("workspace", "memory_id").orderBy("ordinal")
    # a workspace's events are numbered in range partitions and by the counts before each
    out = ranked_within(first, "workspace", "ordinal").withColumn("sequence", F.col("r").cast("int")).drop("r").withColumn("revision", F.row_number().over(by_mem))
    return out.withColumn("supersedes", F.lag("revision").over(by_mem)).withColumn("canonical", F.lead("revision").over(by_mem).isNull())


def replay_conflicts(events: DataFrame) -> DataFrame:
    """M1: keys that come again with another payload: an error to the sender."""
    return events.groupBy("workspace", "key").agg(F.countDistinct(F.sha2("payload", 256)).alias("payloads")).where("payloads > 1")


def transition_violations(events: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """M2: events whose type may not follow the memory's type before; ``__initial__``
    stands before the first."""
    w = Window.partitionBy("memory_id").orderBy("sequence")
    before = events.withColumn("before", F.coalesce(F.lag("event_type").over(w), F.lit("__initial__")))
    rules = before.sparkSession.createDataFrame([(a, b) for b, xs in allowed.items() for a in xs], "before string, event_type string")
    return before.join(F.broadcast(rules), ["before", "event_type"], "left_anti")  # as small as the rules


def as_of(events: DataFrame, sequence: int) -> DataFrame:
    """M3, A10: each memory's last event at or before a sequence."""
    cols = [c for c in events.columns if c != "memory_id"]
    return events.where(F.col("sequence") <= sequence).groupBy("memory_id").agg(F.max_by(F.struct(*cols), "sequence").alias("e")).select("memory_id", "e.*")


def as_of_join(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """For each left row (key, at) the value of the last right row at or before it: one
    union and one window, no range join."""
    both = left.select(key, at, F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(1).alias("side")).unionByName(right.select(key, at, value, F.lit(0).alias("side")))
    w = Window.partitionBy(key).orderBy(at, "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("side = 1").drop("side")


def history(events: DataFrame, memory_id, limit: int) -> DataFrame:
    """M4: newest first, 1 to 1000."""
    return events.where(F.col("memory_id") == memory_id).orderBy(F.desc("sequence")).limit(max(1, min(1000, limit)))


def backlog(events: DataFrame, watermark: int, now: Column) -> DataFrame:
    """M5: one row: how many events a projection has not applied, and the oldest's age."""
    return events.where(F.col("sequence") > watermark).agg(N().alias("pending"), (now - F.min("ts")).alias("oldest_seconds"))


def acknowledge(state: DataFrame, acks: DataFrame) -> DataFrame:
    """M6: watermarks (projection, sequence, fence) after acknowledgements: those of an
    older fence are refused, and a watermark never goes back."""
    ok = acks.join(state.select("projection", F.col("fence").alias("now")), "projection", "left").where("now is null or fence >= now").drop("now")
    return state.unionByName(ok).groupBy("projection").agg(F.max("sequence").alias("sequence"), F.max("fence").alias("fence"))


def reconcile(blocks: DataFrame) -> DataFrame:
    """M7: events by what becomes of them: of the blocks of one height the last seen is
    canonical, the others' events are orphaned; a block that comes again is one block.
    Rows: chain, height, block, event, ordinal."""
    first = blocks.groupBy("chain", "height", "block", "event").agg(F.min("ordinal").alias("ordinal"))
    last = Window.partitionBy("chain", "height").orderBy(F.desc("seen"), "block")
    seen = first.groupBy("chain", "height", "block").agg(F.min("ordinal").alias("seen")).withColumn("r", F.row_number().over(last))
    out = first.join(seen, ["chain", "height", "block"])
    return out.select("chain", "height", "block", "event", F.when(F.col("r") == 1, "canonical").otherwise("orphaned").alias("status"))


def digest_conflicts(blocks: DataFrame) -> DataFrame:
    """M7: blocks that came again with other content."""
    return blocks.groupBy("chain", "height", "block").agg(F.countDistinct("digest").alias("digests")).where("digests > 1")


def risk_totals(events: DataFrame, key: str) -> DataFrame:
    """M8: flagged less retracted events of each key, never below zero."""
    return events.groupBy(key).agg(F.greatest(F.sum("delta"), F.lit(0)).alias("flagged"))


def projection_status(state: DataFrame, required: DataFrame) -> DataFrame:
    """M9: whether each projection has applied what is required of it."""
    return required.join(state.select("projection", "sequence"), "projection", "left").select("projection", "required", F.coalesce("sequence", F.lit(0)).alias("applied"), (F.coalesce("sequence", F.lit(0)) >= F.col("required")).alias("ready"))


def frontier(events: DataFrame) -> DataFrame:
    """The greatest sequence of each (domain, shard)."""
    return events.groupBy("domain", "shard").agg(F.max("sequence").alias("sequence"))


def merge_frontiers(a: DataFrame, b: DataFrame) -> DataFrame:
    return frontier(a.unionByName(b))


def satisfied_by(need: DataFrame, have: DataFrame) -> DataFrame:
    """One row: whether a frontier has reached all of another."""
    j = need.join(have.withColumnRenamed("sequence", "got"), ["domain", "shard"], "left")
    return j.agg(F.coalesce(F.min((F.coalesce("got", F.lit(0)) >= F.col("sequence")).cast("int")) == 1, F.lit(True)).alias("satisfied"))


def project(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of canonical events: a node a memory, an edge to its type."""
    e = events.where("canonical")
    nodes = e.select(F.col("memory_id").cast("string").alias("id"), F.lit("Memory").alias("label"), "event_type", "revision").unionByName(e.select(F.col("event_type").alias("id"), F.lit("State").alias("label"), F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("int").alias("revision")).distinct())
    return nodes, e.select(F.col("memory_id").cast("string").alias("src"), F.col("event_type").alias("dst"), F.lit("IN_STATE").alias("type"))


def stop_round(rounds: DataFrame, gain: float, patience: int = 2) -> DataFrame:
    """For each debate the round at which its score last gained more than ``gain``
    within ``patience`` rounds."""
    w = Window.partitionBy("debate").orderBy("round")
    d = rounds.withColumn("moved", (F.col("score") - F.lag("score").over(w) > gain).cast("int"))
    stuck = F.sum(F.coalesce("moved", F.lit(1))).over(w.rowsBetween(-(patience - 1), 0))
    out = d.withColumn("stop", (stuck == 0) & (F.row_number().over(w) > patience))
    return out.groupBy("debate").agg(F.coalesce(F.min(F.when(F.col("stop"), F.col("round"))), F.max("round")).alias("stops_at"))


def chain_events(txs: DataFrame) -> DataFrame:
    """An event for every input and output of a transaction, numbered in it."""
    parts = F.concat(F.transform("inputs", lambda x: F.struct(F.lit("in").alias("side"), x.alias("party"))), F.transform("outputs", lambda x: F.struct(F.lit("out").alias("side"), x.alias("party"))))
    return txs.select("block", "tx", F.posexplode(parts).alias("event_index", "p")).select("block", "tx", "event_index", "p.side", "p.party")


def latest_active(events: DataFrame, k: int, least: int = 2) -> DataFrame:
    """The k memories of the greatest last sequence among those with ``least`` events."""
    return events.groupBy("memory_id").agg(F.max("sequence").alias("last"), N().alias("n")).where(F.col("n") >= least).orderBy(F.desc("last"), "memory_id").limit(k)


def parity(source: DataFrame, projected: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys on either side and those that only one side has."""
    s, p = source.select(key).distinct().withColumn("s", F.lit(1)), projected.select(key).distinct().withColumn("p", F.lit(1))
    return s.join(p, key, "full_outer").agg(F.count("s").alias("source"), F.count("p").alias("projected"), F.count_if(F.col("p").isNull()).alias("missing"), F.count_if(F.col("s").isNull()).alias("extra"))


def state_cases(events: DataFrame) -> DataFrame:
    """What reads of a history (memory_id, sequence, state) must give: the last state
    now, the one before at its own sequence, and none before the first: rows (operation,
    memory_id, at, expected)."""
    back = F.row_number().over(Window.partitionBy("memory_id").orderBy(F.desc("sequence")))
    on = F.row_number().over(Window.partitionBy("memory_id").orderBy("sequence"))
    h = events.withColumn("back", back).withColumn("on", on)
    now = h.where("back = 1").select(F.lit("current").alias("operation"), "memory_id", F.lit(None).cast("long").alias("at"), F.col("state").alias("expected"))
    then = h.where("back = 2").select(F.lit("point_in_time").alias("operation"), "memory_id", F.col("sequence").alias("at"), F.col("state").alias("expected"))
    before = h.where("on = 1 and sequence > 0").select(F.lit("before").alias("operation"), "memory_id", (F.col("sequence") - 1).alias("at"), F.lit(None).cast("string").alias("expected"))
    return now.unionByName(then).unionByName(before)


def qualify_reads(events: DataFrame, cases: DataFrame) -> DataFrame:
    """Operation, cases, correct and accuracy of reads by ``as_of_join`` against the
    cases that ``state_cases`` expects."""
    asked = cases.withColumn("at", F.coalesce("at", F.lit(2**62)))
    seen = as_of_join(asked.select("memory_id", "at").distinct(), events.select("memory_id", F.col("sequence").alias("at"), "state"), "memory_id", "at", "state")
    read = asked.join(seen, ["memory_id", "at"], "left").withColumn("ok", F.col("state").eqNullSafe(F.col("expected")))
    return read.groupBy("operation").agg(N().alias("cases"), F.count_if("ok").alias("correct"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("accuracy"))
