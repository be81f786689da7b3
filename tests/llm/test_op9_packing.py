import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from weftgraph.llm import op9_packing as op

TOK = public_tokenizers.path("word_bpe_49k.json")


def check(pieces, rows, window=2048):
    """Every id in one piece of its document, sequences gapless and within the window."""
    tok, want = Tokenizer.from_file(TOK), []
    for k, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(k, s, len(ids[s : s + window]), zlib.crc32(ids[s : s + window].tobytes()), len(ids)) for s in range(0, len(ids), window)]
    assert sorted(((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces), key=str) == sorted(want, key=str)
    seqs = {}
    for p in pieces:
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= window
    return seqs


def test_query_on_odd_rows(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(op.op9_packing(spark, sf_dir).collect(), rows)


def test_little_padding(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, "word " * int(n)) for i, n in enumerate(rng.exponential(500, 600))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = op.op9_packing(spark, str(tmp_path)).collect()
    seqs = check(pieces, rows)
    assert sum(p.length for p in pieces) >= 0.95 * 2048 * len(seqs)


def test_empty_table(empty):
    assert op.assign(op.cut(empty, TOK, end_id=1).drop("ids")).count() == 0


def test_plan_uses_up_the_histogram_with_little_padding():
    rng = np.random.default_rng(3)
    counts = np.bincount(np.minimum(1 + rng.exponential(30, 20_000).astype(int), 128), minlength=129)
    counts[0] = 0
    plan = op.plan_packing(counts)
    used = np.zeros(129, int)
    for combo, times in plan:
        assert times > 0 and sum(combo) <= 128
        for c in combo:
            used[c] += times
    assert (used == counts).all()
    assert sum(t for _, t in plan) <= 1.01 * (counts * np.arange(129)).sum() / 128 + 1


def test_nnls_matches_conditions():
    rng = np.random.default_rng(5)
    for _ in range(20):
        a, b = rng.random((12, 30)), rng.random(12)
        x = op.nnls(a, b)
        g = a.T @ (b - a @ x)
        assert (x >= 0).all() and (g < 1e-6).all() and abs(g[x > 0]).max(initial=0) < 1e-6
