"""Shared plumbing: tables, the shared folder, written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of text that an operator in Python works on at a time.
ARROW_ROWS = 256
ARROW_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``. Where that is unset a
    local session gets a temporary one of its own; a cluster is refused, as no executor
    could read what another wrote to its own disk."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="weft-shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """Where this application's intermediate tables stand."""
    return f"{shared_dir(spark)}/weft/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{scratch(spark)}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clean(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, results that still read them
    included: for the end of a job, once its results are written."""
    remove(spark, scratch(spark))


def written(df: DataFrame, what: str, level: int = 3) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the re-read table.

    Cuts lineage the way a checkpoint does: any executor can read the result, and
    the loss of one re-runs only the tasks in flight."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.weft_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a ``written`` table that no later step reads."""
    remove(df.sparkSession, df.weft_path)


def slices(batches: Iterator[pa.RecordBatch], text: int | None = None, rows: int = ARROW_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``rows`` rows, and to ``ARROW_BYTES`` of column
    ``text`` or one row. Batches come bounded in bytes by Spark itself
    (``arrow.maxBytesPerBatch``); these bounds are an operator's own, so no setting of
    the session changes."""
    for batch in batches:
        if text is None:
            for lo in range(0, batch.num_rows, rows):
                yield batch.slice(lo, rows)
            continue
        start, held = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()):
            if i > start and (i - start >= rows or held + n > ARROW_BYTES):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)


def positional(df: DataFrame) -> DataFrame:
    """``df`` with columns c0, c1, ...: names that clash, or differ in case only, are
    then told apart."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def place_of(df: DataFrame, name: str) -> str:
    """The name in ``positional(df)`` of the column of exactly this name, or of the only
    one that differs in case."""
    if name in df.columns:
        return f"c{df.columns.index(name)}"
    near = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(near) != 1:
        raise ValueError(f"no column {name} in {df.columns}")
    return f"c{near[0]}"


def picked(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, whatever else the table has."""
    return positional(df).select(*[F.col(place_of(df, n)).alias(n) for n in names])


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and whole ``text`` only, null text as empty: extra or clashing
    columns of the input never reach an operator."""
    return picked(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def row_key(*columns: Column) -> Column:
    """What tells rows apart by these columns, 128 bits of a digest in which every value
    stands with its length, and nulls are no empty strings."""
    said = [F.when(c.isNull(), "-").otherwise(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]
    return F.substring(F.sha2(F.concat_ws(",", *said), 256), 1, 32)


#: A key with more than one in so many rows is hot; there are at most so many of them.
HOT = 256


def spread_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, by: str) -> DataFrame:
    """``left`` left-joined with ``right``, which has one row a value of ``key`` and in
    ``weight`` how many rows of the left (or more) have it, of ``total``.

    Values with more than total / HOT rows are at most HOT and broadcast. Their rows, and
    those without a value, are dealt by a hash of column ``by``; so no task gets more than
    its share and total / HOT rows of one value."""
    extra = [c for c in right.columns if c not in (key, weight)]
    hot = F.col(weight) > total / HOT
    tops = right.where(hot).select(key, *[F.col(c).alias(f"hot_{c}") for c in extra], F.lit(True).alias("hot_row"))
    # zero, but no constant: of a constant the planner would make a filter, and deal by the key
    zero = F.pmod(F.xxhash64(key), F.lit(1)).cast("int")
    rest = right.where(~hot).select(F.col(key).alias("rest_key"), zero.alias("rest_salt"), *[F.col(c).alias(f"rest_{c}") for c in extra])
    settled = F.col("hot_row").isNotNull() | F.col(key).isNull()
    dealt = left.join(F.broadcast(tops), key, "left")
    dealt = dealt.select("*", F.when(settled, 1 + F.pmod(F.xxhash64(by), F.lit(1 << 16)).cast("int")).otherwise(0).alias("own_salt"), F.when(~settled, F.col(key)).alias("own_key"))
    out = dealt.join(rest, (F.col("own_salt") == F.col("rest_salt")) & (F.col("own_key") == F.col("rest_key")), "left")
    return out.select(*left.columns, *[F.coalesce(f"hot_{c}", f"rest_{c}").alias(c) for c in extra])


def sampled_texts(keys: DataFrame, texts: DataFrame, size: int, counts: dict) -> dict:
    """{class: at most ``size`` distinct texts, those of least hash} in three narrow
    steps, two passes over the rows whatever the number of classes.

    ``keys``: rows (cls, h); ``texts``: rows (h, text) with the texts of those hashes;
    ``counts``: about how many rows a class has. A fraction of the hashes that holds
    twice a class's sample is cut first, so the driver gets some 2 x ``size`` keys a
    class; then only the chosen texts move."""
    spark = keys.sparkSession
    if not counts:
        return {}
    cuts = spark.createDataFrame([(c, int(min(1.0, 2 * size / max(1, n)) * (1 << 20))) for c, n in counts.items()], schema_of(keys, "cls") + ", cut int")
    near = keys.join(F.broadcast(cuts), "cls").where(F.pmod(F.col("h"), F.lit(1 << 20)) <= F.col("cut")).select("cls", "h").distinct()
    found: dict = {c: [] for c in counts}
    for r in near.collect():
        found[r["cls"]].append(r["h"])
    chosen = {c: sorted(hs)[:size] for c, hs in found.items()}
    wanted = [(h,) for h in sorted({h for hs in chosen.values() for h in hs})]
    if not wanted:
        return chosen
    got = texts.join(F.broadcast(spark.createDataFrame(wanted, "h long")), "h").groupBy("h").agg(F.max("text").alias("text"))
    by_hash = {r["h"]: r["text"] for r in got.collect()}
    return {c: [by_hash[h] for h in hs] for c, hs in chosen.items()}


def schema_of(df: DataFrame, name: str) -> str:
    return f"{name} {df.schema[name].dataType.simpleString()}"
