import pytest

from weftgraph.llm import common as c
from weftgraph.llm import op2_quality, op6_language, op10_media
from weftgraph.llm.components import components


def test_session_settings_stay(spark, docs):
    before = {k: spark.conf.get(f"spark.sql.execution.arrow.{k}") for k in ("maxRecordsPerBatch", "maxBytesPerBatch")}
    op2_quality.score(docs, op2_quality.train(([], []), (0, 0))).count()
    op6_language.identify(op6_language.document_rows(docs), op6_language.fit(docs)).count()
    op10_media.encode_media(docs).count()
    assert before == {k: spark.conf.get(f"spark.sql.execution.arrow.{k}") for k in before}


def test_slices_bound_rows_and_bytes():
    import pyarrow as pa

    texts = ["x" * (c.ARROW_BYTES // 2), "y" * c.ARROW_BYTES, None, *["z"] * 600]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["k", "t"])
    got = list(c.slices([batch, batch.slice(0, 0)], 1))
    assert [t for b in got for t in b.column(1).to_pylist()] == texts
    assert [b.num_rows for b in got[:2]] == [1, 2] and all(b.num_rows <= c.ARROW_ROWS for b in got)
    assert [b.num_rows for b in c.slices([batch], rows=500)] == [500, 103]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master, applicationId = "spark://somewhere:7077", "a"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        c.shared_dir(Session())


def test_written_tables_can_be_deleted(spark):
    from pathlib import Path

    t = c.written(spark.range(5).toDF("x"), "some")
    at = Path(t.weft_path.removeprefix("file://"))
    assert t.count() == 5 and at.exists()
    c.discard(t)
    assert not at.exists()


def test_spread_join_is_a_left_join(spark):
    """One value with most rows, nulls, and values that the right side lacks."""
    rows = [(i, "hot" if i % 3 else f"k{i % 40}") for i in range(900)] + [(1000 + i, None) for i in range(300)] + [(2000, "none")]
    left = spark.createDataFrame(rows, "i long, k string").repartition(4)
    right = left.where("k is not null and k <> 'none'").groupBy("k").count().selectExpr("k", "count as n", "k || '!' as said")
    got = {(r.i, r.k, r.said) for r in c.spread_join(left, right, "k", "n", left.count(), "i").collect()}
    assert got == {(i, k, None if k in (None, "none") else k + "!") for i, k in rows}


def test_spread_join_deals_hot_and_null_keys(spark):
    """Where both sides are shuffled, it is by the salt too."""
    left = spark.range(100).selectExpr("id as i", "if(id % 3 > 0, 'hot', null) as k")
    right = left.groupBy("k").count().selectExpr("k", "count as n", "k as said")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = c.spread_join(left, right, "k", "n", 100, "i")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(own_salt" in plan and "hashpartitioning(rest_salt" in plan


def test_row_key_tells_nulls_and_bounds_apart(spark):
    from pyspark.sql import functions as F

    rows = [(None, ""), ("", None), ("", ""), ("a", "bc"), ("ab", "c"), ("a,1:b", "c"), (None, None), ("-", None)]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(c.row_key(F.col("x"), F.col("y")).alias("k")).distinct().count() == len(rows)


def test_components_with_a_hub(spark):
    pairs = [(0, i) for i in range(1, 1500)] + [(i, i + 1) for i in range(3000, 3300)] + [(3300, 2), (9, 9), (None, 4), (8000, 8001)]
    got = dict(components(spark.createDataFrame(pairs, "a long, b long").repartition(3)).collect())
    assert set(got.values()) == {0, 8000} and got[3100] == 0 and got[8001] == 8000 and len(got) == 1500 + 301 + 2
