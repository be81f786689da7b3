import re

import numpy as np

from weftgraph.llm import op5_license as op

PATTERN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    w = words_of(text)
    places = sorted((label, i) for p, label in op.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    met = set()
    for label, t in op.TEMPLATES:
        size = op.BLOCK
        while size < 2 * len(words_of(t)):
            size *= 2
        t = set(zip(words_of(t), words_of(t)[1:]))
        for lo in range(0, max(1, len(w) - size // 2), size // 2):
            b = w[lo : lo + size]
            b = set(zip(b, b[1:]))
            if len(t & b) >= op.THRESHOLD * len(t) - 1e-9:
                met.add((label, lo, round(len(t & b) / len(t), 9)))
    return len(w), places, met


def texts():
    rng = np.random.default_rng(1)
    pool = sorted({w for _, t in op.TEMPLATES for w in t.split()}) + ["été", "x1", "MIT-ish", "a_b"]
    out = [" ".join(rng.choice(pool, rng.integers(1, 200))) + ("\n" if i % 3 else ". ") + " ".join(rng.choice(pool, 9)) for i in range(300)]
    for i in range(60):
        t = op.TEMPLATES[i % len(op.TEMPLATES)][1].split()
        if i % 2:
            t[int(rng.integers(len(t)))] = "changed"
        out.append(" ".join(rng.choice(["le", "la", "of"], 50)) + "\n" + " ".join(t) + ".\nend")
    return [*out, "CC BY cc  by\nby cc\nby", "All rights\n reserved. all rights reserved!", "w " * 5000, "", None, " \n\n ", "cc by " * 300, "éCC BY", "漢字 CC BY 4.0"]


def test_scan_equals_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(*r, "mit", 1) for r in rows], "doc_id long, text string, labels string, base int")
    got = {r.doc_id: r for r in op.scan(df).collect()}
    found = 0
    for k, t in rows:
        n, places, met = brute(t)
        assert got[k].n_words == n
        assert sorted((p.label, p.word) for p in got[k].base) == places
        assert {(m.label, m.word, round(m.containment, 9)) for m in got[k].blocks} == met
        found += len(met)
    assert found > 40


def wrapped(text, width):
    """A text in lines of so many words, each behind a comment sign."""
    w = text.split()
    return "\n".join(" # " + " ".join(w[i : i + width]) for i in range(0, len(w), width))


def test_wrapped_notices_and_order(spark):
    """Line ends do not matter; the words of a notice in another order are no notice."""
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for i, (label, t) in enumerate(op.TEMPLATES):
        around = " ".join(f"w{x}" for x in rng.integers(0, 99, 70))
        for j, said in enumerate((t, wrapped(t, 3), wrapped(t, 9), " ".join(rng.permutation(t.split())))):
            rows.append((4 * i + j, f"{around}\n{said}\n{around}"))
            want[4 * i + j] = label if j < 3 else None
    got = {r.doc_id: {b.label for b in r.blocks} for r in op.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label is None or label in got[k] for k, label in want.items())
    assert not any(got[k] for k in want if k % 4 == 3)


def test_query_columns(spark, sf_dir, tmp_path):
    d = str(tmp_path)
    rows = [(1, "X\nAll rights reserved. cc by"), (2, "Released under the MIT License."), (3, None), (None, "nothing"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    got = {r.doc_id: r for r in op.op5_license(spark, d).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].labels, got[1].score) == (6, 2, 1, 4, "cc-by,reserved", "cc-by,reserved", 1.0)
    assert (got[2].n_base, got[2].first_word, got[2].base_labels, got[2].labels, got[2].score) == (0, None, "", "mit", 1.0)
    assert (got[3].n_words, got[3].labels, got[3].score) == (0, "", 0.0)
    assert op.op5_license(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_empty_table(empty):
    assert op.scan(empty).count() == 0
