from pyspark.sql import functions as F

from weftgraph.sources import chunks as ch
from weftgraph.sources import readers as s
from weftgraph.streaming import memory as st


def test_files(spark, tmp_path):
    (tmp_path / "t" / "in").mkdir(parents=True)
    (tmp_path / "t" / "a.md").write_text("# A\nx")
    (tmp_path / "t" / "in" / "b.txt").write_text("y")
    assert sorted(r.content for r in s.read_texts(spark, f"{tmp_path}/t").collect()) == ["# A\nx", "y"]
    (tmp_path / "c.csv").write_text("a,b\n1,\n2,z\n3\n")
    assert sorted(r.content for r in s.read_any(spark, f"{tmp_path}/c.csv").collect()) == ["a: 1", "a: 2 | b: z", "a: 3"]
    (tmp_path / "l.jsonl").write_text('{"id": "1", "text": "x"}\n{bad\n{"id": "2", "references": ["p", "q"]}\n')
    assert sorted(r.content for r in s.read_any(spark, f"{tmp_path}/l.jsonl").where("content <> '{}'").collect())[-2:] == ["p\nq", "x"]
    (tmp_path / "o.json").write_text('[{"id": "1", "content": "k"}]')
    assert [r.content for r in s.read_any(spark, f"{tmp_path}/o.json").collect()] == ["k"]
    spark.createDataFrame([("9", "doc")], "id string, document string").write.parquet(f"{tmp_path}/p.parquet")
    assert [(r.id, r.content) for r in s.read_any(spark, f"{tmp_path}/p.parquet").collect()] == [("9", "doc")]


def test_records_are_redacted_and_written(spark, tmp_path):
    df = spark.createDataFrame([(None, "body", {"api_key": "x", "k": "v"})], "i string, c string, m map<string,string>")
    rec = s.record(df, F.col("i"), F.col("c"), metadata=F.col("m"))
    s.write_records(rec, f"{tmp_path}/r")
    back = spark.read.json(f"{tmp_path}/r").first()
    assert back.metadata.api_key == "[REDACTED]" and back.metadata.k == "v" and len(back.id) == 32


def test_connectors(spark):
    m = spark.createDataFrame([("c", "2", "1", "u", "see <https://x.y|here>"), ("c", "1", None, None, "hi <@U1>")], "channel string, ts string, thread_ts string, user string, text string")
    assert [r.content for r in s.slack_threads(m).collect()] == ["?: hi @U1\nu: see here"]
    b = spark.createDataFrame([("p", "T", 1, "heading_1", "A"), ("p", "T", 2, "bulleted_list_item", "b")], "page string, title string, position int, kind string, text string")
    assert [r.content for r in s.notion_pages(b).collect()] == ["# A\n- b"]

    class Doc:
        page_content, metadata = "t", {"id": "7"}

    assert [(r.id, r.content) for r in s.adapt(spark, [Doc()]).collect()] == [("7", "t")]


def test_chunks_cover_the_text():
    text = "# H\n\n" + "para one. " * 30 + "\n\n## Sub\n\n" + "x" * 700 + "\n\nend"
    got = ch.chunk_text(text, 300, 50, "\n\n")
    covered = "".join(text[a:b] for _, a, b in got)
    assert covered.replace("\n", "").replace(" ", "") == text.replace("\n", "").replace(" ", "")
    assert all(b - a <= 300 for _, a, b in got) and got[1][0].endswith(text[got[1][1] : got[1][2]])
    assert ch.chunk_text(" ", 10, 2, "\n") == [("", -1, -1)]
    assert [h[1] for h in ch.sections(text)] == ["H", "H > Sub"]


def test_turtle_objects(spark):
    df = spark.createDataFrame([("a", "b", o) for o in ("http://x", "urn:y", "p:z", 'say "hi"')], "s string, p string, o string")
    assert [r.value.split(" ", 2)[2] for r in s.turtle(df).collect()] == ["<http://x> .", "<urn:y> .", "p:z .", '"say \\"hi\\"" .']


def test_samples_and_generators_repeat(spark):
    df = spark.range(200).select("id", (F.col("id") % 3).alias("g"))
    one = {r.id for r in s.stratified(df, "g", "id", 5, 1).collect()}
    assert one == {r.id for r in s.stratified(df.repartition(7), "g", "id", 5, 1).collect()} and len(one) == 15
    e = s.power_law_edges(spark, 1000, 50, 3.0, 1)
    assert e.collect() == s.power_law_edges(spark, 1000, 50, 3.0, 1).orderBy("id").collect() and e.where("src < 0 or src >= 50").count() == 0


def test_streams(spark, tmp_path):
    kind = "workspace string, key string, memory_id long, sequence long, event_type string, ts timestamp"
    rows = [("w", f"k{i % 8}", i % 2, i, "a", f"2024-01-01 00:00:{i:02d}") for i in range(10)]
    df = spark.createDataFrame(rows, "workspace string, key string, memory_id long, sequence long, event_type string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    ev = st.read_events(spark, f"{tmp_path}/in", kind)
    st.run_to_table(st.revisions(ev), f"{tmp_path}/c1", f"{tmp_path}/rev")
    got = {(r.memory_id, r.sequence): r.revision for r in spark.read.parquet(f"{tmp_path}/rev").collect()}
    assert got == {(i % 2, i): i // 2 + 1 for i in range(10)}
    st.run_to_table(st.deduplicated(ev, "1 minute"), f"{tmp_path}/c2", f"{tmp_path}/dd")
    assert spark.read.parquet(f"{tmp_path}/dd").count() == 8
    blocks = spark.createDataFrame([("c", 1, "x", 1), ("c", 1, "x", 2), ("c", 1, "y", 3)], "chain string, height long, block string, ordinal long")
    blocks.coalesce(1).write.parquet(f"{tmp_path}/b")
    st.run_to_table(st.block_changes(spark.readStream.schema(blocks.schema).parquet(f"{tmp_path}/b")), f"{tmp_path}/c3", f"{tmp_path}/bb")
    assert sorted((r.canonical, r.orphaned) for r in spark.read.parquet(f"{tmp_path}/bb").collect()) == [("x", None), ("y", "x")]
    seen = []
    st.project_to(ev, f"{tmp_path}/c4", lambda b, i: seen.append((i, b.count()))).awaitTermination()
    assert seen == [(0, 10)]
