"""The driver tables as a property graph: typed nodes and edges.

Money has two digits, so sums go through DECIMAL(18, 2) and are exact whatever the
order in which partitions arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def total(c: Column | str) -> Column:
    """An exact sum of money, as a double."""
    return F.sum(money(c)).cast("double")


def epoch(c: str) -> Column:
    """Seconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {c})")


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer to supplier: src, dst, amount, ts (seconds), channel, order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem")
    edge = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return edge.select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_extendedprice").alias("amount"), epoch("l_shipdate").alias("ts"), F.col("l_returnflag").alias("channel"), F.col("l_orderkey").alias("order_id"))


#: The same edges in SQL.
TRANSFERS = "transfers AS (SELECT o_custkey AS src, l_suppkey AS dst, l_extendedprice AS amount, CAST(epoch(l_shipdate) AS BIGINT) AS ts, l_returnflag AS channel, l_orderkey AS order_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part to the part of the next line of the same order, distinct, without loops.
    Lines of an order are in order of number, part, supplier and quantity."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    pairs = li.select(F.lag("l_partkey").over(w).alias("src"), F.col("l_partkey").alias("dst"))
    return pairs.where("src is not null and src <> dst").distinct()


PARTS = "parts AS (SELECT DISTINCT src, dst FROM (SELECT lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS src, l_partkey AS dst FROM lineitem) WHERE src IS NOT NULL AND src <> dst)"
