import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from weftgraph.llm import op1_token_index as op

TOK = public_tokenizers.path("byte_bpe_50k.json")


def brute(rows):
    tok, at, out = Tokenizer.from_file(TOK), 0, []
    for key, text in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query_equals_brute_force(spark, sf_dir):
    got = [tuple(r) for r in op.op1_token_index(spark, sf_dir).orderBy("start").collect()]
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "coalesce(text,'') text").selectExpr("*", "xxhash64(text) h").orderBy("doc_id", "h").collect()
    assert got == brute([(r.doc_id, r.text) for r in texts])


def test_small_shards_and_lookup(spark, docs, tmp_path):
    path = f"file://{tmp_path}/ix"
    op.write_index(docs, TOK, path, end_id=2, shard_ids=50)
    assert op.read_index(spark, path).count() == docs.count()
    keys = [r.doc_id for r in docs.where("doc_id is not null").select("doc_id").distinct().collect()]
    found = op.lookup(spark, path, [*keys, 123456]).collect()
    assert len(found) == docs.where("doc_id is not null").count()
    assert len(op.lookup(spark, path, [*keys, None]).collect()) == docs.count()
    assert op.lookup(spark, path, []).count() == op.lookup(spark, path, [-5]).count() == 0
    ids = {bytes(r.ids) for r in found if r.doc_id == 0}
    assert ids == {np.array([*Tokenizer.from_file(TOK).encode("Plain words of a text.").ids, 2], "<u4").tobytes()}


def test_a_look_up_opens_only_the_shards_of_its_keys(spark, tmp_path):
    path = f"file://{tmp_path}/ix"
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id long, text string").repartition(4)
    op.write_index(rows, TOK, path, end_id=2, shard_ids=60)
    every = spark.read.parquet(f"{path}/manifest").collect()
    assert len(every) > 10
    files = op.shards_of(spark, path, [7, 350])
    assert len(files) == 2
    for f in every:  # the others may be gone
        if f.path not in files:
            (tmp_path / "ix" / "shards" / f.path.rsplit("/", 1)[1]).unlink()
    got = {r.doc_id: bytes(r.ids) for r in op.lookup(spark, path, [7, 350]).collect()}
    assert got == {k: np.array([*Tokenizer.from_file(TOK).encode(f"text {k}").ids, 2], "<u4").tobytes() for k in (7, 350)}


def test_empty_table(spark, empty, tmp_path):
    path = f"file://{tmp_path}/ix"
    op.write_index(empty, TOK, path, end_id=2)
    assert op.read_index(spark, path).count() == 0


def test_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 500, 5000):
        h = op.key_hash(rng.permutation(10 * n)[:n], np.zeros(n), np.zeros(n))
        assert sorted(op.build_mph(h)[1]) == list(range(n))
