import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from weftgraph.llm import op4_spotsigs as op


def brute_set(text):
    words = [w for w in re.split(r"[\x00-/:-@\[-`{-\x7f]+", text.lower()) if w]
    out = set()
    for i, w in enumerate(words):
        chain = [x for x in words[i + 1 :] if x not in op.ANCHORS][: op.CHAIN]
        if w in op.ANCHORS and len(chain) == op.CHAIN:
            out.add((w, *chain))
    return out or {text}


def like(a, b):
    return len(a & b) / len(a | b)


def texts():
    rng = np.random.default_rng(1)
    pool = ["the", "of", "and", "la", "und", *(f"w{i}" for i in range(12))]
    out = [" ".join(rng.choice(pool, rng.integers(0, 60))) for _ in range(60)]
    return [*out, "", "a", "The of THE", "the é 漢字 x1 y", "😀" * 9, "the " * 300, "the a b c. The a, b; c"]


def test_query_equals_brute_force(spark, tmp_path):
    rows = sorted((i * 7 % 101, t) for i, t in enumerate(texts()))
    spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, hash string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op.op4_spotsigs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for (k, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        q = len(t) // 4
        e = t[: len(t) - q] + after[:q]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert len(r.fingerprint) == 8 * len(brute_set(t)) and len(r.edited_fingerprint) == 8 * len(brute_set(e))
        assert abs(r.near_edited - like(brute_set(t), brute_set(e))) < 1e-9
        assert abs(r.near_next - like(brute_set(t), brute_set(after))) < 1e-9
        assert all(got[j].fingerprint == r.fingerprint for j, u in rows if u == t)
    assert {k: r.class_id for k, r in got.items()} == brute_classes(rows)


def brute_classes(rows):
    """Least key of each row's component of links at the threshold."""
    own, root = [brute_set(t) for _, t in rows], [k for k, _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if like(own[i], own[j]) >= op.THRESHOLD - 1e-12:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return dict(zip([k for k, _ in rows], root, strict=True))


def test_classes_of_near_fingerprints(spark, tmp_path):
    """Edits of many kinds, a passage that all texts share, and a large group of copies."""
    rng = np.random.default_rng(7)
    pool = ["the", "of", "and", "la", "und"]
    say = lambda n: [w for _ in range(n) for w in (str(rng.choice(pool)), *(f"x{rng.integers(9000)}" for _ in range(3)))]
    shared, rows = say(30), []
    for i in range(25):
        base = say(60)
        for _ in range(4):
            own = [w for w in base if rng.random() > 0.004 * (i % 6)]
            rows.append(" ".join(shared + own if i % 2 else own))
    hub = say(60)
    rows += [" ".join([*hub[:k], "changed", *hub[k + 1 :]]) for k in range(0, 240, 2)]
    rows = list(enumerate(rows))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_classes(rows)
    got = {(r.id): r.class_id for r in op.class_ids(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    assert got == want and 20 < len(set(want.values())) < 100


def test_odd_rows(spark, docs):
    got = op.edited_neighbours(docs).collect()
    assert len(got) == docs.count()
    same = [r for r in got if r.doc_id == 0 and r.text == "Plain words of a text."]
    assert len(same) == 2 and any(r.next_sig == r.sig for r in same)
    assert sum(r.doc_id is None for r in got) == 1


def test_near_pairs_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    sets = set()
    for _ in range(25):
        base = [f"{x:08x}" for x in rng.choice(400, rng.integers(1, 40), replace=False)]
        for _ in range(6):
            own = [x for x in base if rng.random() > 0.08] or base[:1]
            sets.add("".join(sorted(own)))
    sets = sorted(sets)
    df = spark.createDataFrame([(s,) for s in [*sets, *sets[:5], None]], "fingerprint string")
    for t in (0.8, 0.5):
        cut = [{s[i : i + 8] for i in range(0, len(s), 8)} for s in sets]
        want = {(sets[i], sets[j]) for i in range(len(sets)) for j in range(i + 1, len(sets)) if like(cut[i], cut[j]) >= t}
        assert {(r.a, r.b) for r in op.near_pairs(df, t).collect()} == want and want


def test_one_row_and_empty_table(spark, empty):
    one = spark.createDataFrame([(5, "the a b c d e f g")], "doc_id long, text string")
    assert [r.edited for r in op.edited_neighbours(one).collect()] == ["the a b c d ethe "]
    assert op.edited_neighbours(empty).count() == 0
    assert op.near_pairs(spark.createDataFrame([], "fingerprint string")).count() == 0


def test_bit_maps_rule_out_strangers_only(spark):
    """Maps let every similar pair pass, and hardly any pair of strangers."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(40):
        base = rng.integers(-(2**31), 2**31, 90)
        rows += [(i, k, sorted({int(x) for x in np.where(rng.random(90) < 0.03 * k, rng.integers(-(2**31), 2**31, 90), base)})) for k in range(4)]
    sets = spark.createDataFrame(rows, "i int, k int, sig array<int>").withColumn("map", op.bit_map(F.col("sig")))
    both = sets.alias("x").crossJoin(sets.alias("y")).where("x.i < y.i or (x.i = y.i and x.k < y.k)")
    near = op.jaccard(F.col("x.sig"), F.col("y.sig")) >= 0.8
    got = both.groupBy(near.alias("near"), op.may_be(F.col("x.map"), F.col("y.map"), F.size("x.sig") + F.size("y.sig")).alias("may")).count().collect()
    count = {(r.near, r.may): r["count"] for r in got}
    assert (True, False) not in count and count[True, True] > 100 and count[False, True] < 200 and count[False, False] > 10000
