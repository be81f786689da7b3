"""The event memory as streams: state is kept by key and outlives executors in the
query's checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark, path: str, schema: str) -> DataFrame:
    """Parquet files of events as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def deduplicated(events: DataFrame, late: str) -> DataFrame:
    """M1: the first event of each idempotency key, among those up to ``late`` late."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["workspace", "key"])


def revisions(events: DataFrame) -> DataFrame:
    """M1: each memory's events with their revision: one counter a memory is the state."""

    def number(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        whole = pd.concat(list(frames)).sort_values(["sequence"])
        whole = whole.assign(revision=range(last + 1, last + 1 + len(whole)))
        state.update((last + len(whole),))
        yield whole[["memory_id", "sequence", "event_type", "revision"]]

    own = events.select("memory_id", "sequence", "event_type")
    return own.groupBy("memory_id").applyInPandasWithState(number, "memory_id long, sequence long, event_type string, revision long", "n long", "append", GroupStateTimeout.NoTimeout)


def block_changes(blocks: DataFrame) -> DataFrame:
    """M7: for each (chain, height) the block that becomes canonical and the one that it
    puts out; a block that comes again changes nothing."""

    def change(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, out = state.get[0] if state.exists else None, []
        for row in pd.concat(list(frames)).sort_values("ordinal").itertuples():
            if row.block != now:
                out.append((key[0], key[1], row.block, now))
                now = row.block
        state.update((now,))
        yield pd.DataFrame(out, columns=["chain", "height", "canonical", "orphaned"])

    return blocks.groupBy("chain", "height").applyInPandasWithState(change, "chain string, height long, canonical string, orphaned string", "block string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str, width: str) -> DataFrame:
    """Extension: events of each type in tumbling windows of event time, under a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def project_to(events: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand every micro-batch and its number to an idempotent writer."""
    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, checkpoint: str, path: str, mode: str = "append") -> None:
    """Process what is there and stop."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
