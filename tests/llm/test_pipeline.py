import numpy as np

import corpus_pipeline as p
from weftgraph.llm import op2_quality, op6_language, op7_simhash


def test_stages_on_planted_documents(spark, tmp_path):
    """Junk, wordless texts and copies go, all else stays and is packed whole."""
    rng = np.random.default_rng(1)
    say = lambda n, abc: " ".join("".join(rng.choice(list(abc), 5)) for _ in range(n))
    rows = [(i, say(80, "etaoinsh" if i % 2 else "rdlucmfw"), ["aa", "bb"][i % 2 == 0]) for i in range(200)]
    rows += [(200 + i, " ".join(w + "$$$" for w in say(80, "etaoinsh").split()), "aa") for i in range(60)]
    base = say(400, "etaoinsh")
    words = base.split()
    rows += [(300, base, "aa"), (301, base, "aa"), (302, " ".join([*words[:-1], "changed"]), "aa"), (303, "12 34 !!", "aa"), (301, base, "aa")]
    docs = spark.createDataFrame([(k, t, lang, "s", len(t)) for k, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 200), 0) for k in range(260)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at, left = docs, {}
    for name, stage in p.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
        left[name] = {r.doc_id for r in at.select("doc_id").collect()}
    assert left["quality"] >= set(range(200)) | {300, 301, 302} and len(left["quality"] & set(range(200, 260))) <= 2
    assert left["language"] == left["quality"] - {303}
    assert left["near_copies"] == left["language"] - {301, 302}
    assert at.where("doc_id = 300").count() == 1
    out = p.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == left["near_copies"]


def test_keep_one_of_odd_rows(spark, docs, empty):
    kept = op7_simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.select("doc_id", "text").collect()
    assert sum((r.text or "").startswith("Plain") for r in rows) == 1
    assert sum(not (r.text or "").strip() for r in rows) == 1
    assert [r.doc_id for r in rows if r.text == "a null key"] == [99]
    assert op7_simhash.keep_one(empty).count() == 0


def test_clashing_and_odd_columns(spark):
    """Names that differ in case only, and names that operators use themselves."""
    rows = [(i, f"text number {i % 3} of these and others", 10 + i, "t", "en", "s", i) for i in range(6)] + [(None, None, 1, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, DOC_ID long, tag string, lang string, source string, Source long")
    kept = op7_simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.collect() if r[0] is not None) == [0, 1, 2]
    known = op6_language.keep_identified(docs, op6_language.fit(docs.drop("Source").toDF("a", "text", "b", "tag", "lang")))
    assert known.columns == docs.columns and known.count() == 6
    good = op2_quality.keep_good(docs, op2_quality.train(([], []), (0, 0)))
    assert good.columns == docs.columns and good.count() == 7


def test_null_text_is_no_empty_source(spark):
    """(null, "x") and ("x", null) are different rows to the language stage."""
    rows = [(1, None, "abc def ghi jkl mno"), (1, "abc def ghi jkl mno", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    model = op6_language.fit_texts({"aa": ["abc def ghi"] * 4})
    assert [r.text for r in op6_language.keep_identified(docs, model).collect()] == [rows[1][1]]


def test_stages_on_an_empty_table(spark, empty, tmp_path):
    e = empty.select("doc_id", "text", "lang", "source", "n_chars")
    e.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
