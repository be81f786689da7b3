import zlib

import numpy as np

from weftgraph.llm import op2_quality as op


def words(rng, n):
    return " ".join("".join(rng.choice(list("etaoinshrdlu"), 5)) for _ in range(n))


def test_held_out_accuracy_and_folds(spark):
    rng = np.random.default_rng(1)
    rows = [(i, words(rng, 60) if i % 3 else " ".join(w + "$$$" for w in words(rng, 60).split()), int(i % 3 > 0)) for i in range(500)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q, 0) for k, _, q in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in op.score(docs, op.fit(docs, labels)).selectExpr("doc_id", "score").collect()}
    out = [k for k, _, _ in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([(got[k].score >= 0.5) == rows[k][2] for k in out]) > 0.97
    flags = docs.select("doc_id", (op.fold(docs.doc_id) == 1).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in flags)
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - quality, quality) quality", "toxic")
    assert op.fit(docs, flipped) == op.fit(docs, labels)  # held-out labels are never seen


def test_odd_rows_score_once_each(spark, docs, sf_dir):
    labels = spark.createDataFrame([(0, None), (None, 1), (3, 1), (3, 0), (777, 0)], "doc_id long, quality int")
    model = op.fit(docs, labels)
    assert model.dictionaries is None
    got = op.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    rng = np.random.default_rng(2)
    model = op.train(([words(rng, 300) for _ in range(20)], [words(rng, 300).upper() for _ in range(20)]), (20, 20))
    got = op.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    kept = op.keep_good(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_empty_tables(empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert op.fit(empty, none).share == 0.5
    assert op.score(empty, op.fit(empty, none)).count() == 0


def test_ten_bad_labels_are_learnt(spark):
    """A class of few texts still gets a model; only a missing one gets none."""
    rng = np.random.default_rng(4)
    bad = lambda: " ".join(w + "$$$" for w in words(rng, 60).split())
    for few in (10, 2):
        rows = [(i, words(rng, 60)) for i in range(150)] + [(200 + i, bad()) for i in range(40)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        labels = spark.createDataFrame([(k, int(k < 200)) for k, _ in rows if k < 200 + few], "doc_id long, quality int")
        model = op.fit(docs, labels, None)
        got = {r.doc_id: r.score for r in op.score(docs, model).collect()}
        assert model.dictionaries and len(set(got.values())) > 2
        assert np.mean([(got[k] >= 0.5) == (k < 200) for k, _ in rows]) > 0.9
        assert {r.doc_id for r in op.keep_good(docs, model).collect()} == {k for k in got if got[k] >= 0.5}
    assert op.train((["a"], ["b"]), (1, 1)).dictionaries
    assert op.train(([], ["b"] * 20), (5, 20)).dictionaries is None
