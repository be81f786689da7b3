import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from weftgraph.llm import op8_bpe as op

TOK = public_tokenizers.path("word_bpe_49k.json")


def same_as_library(texts):
    own, tok = op.bpe(TOK), Tokenizer.from_file(TOK)
    ids = own.encode_batch(texts)
    want = tok.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [w.ids for w in want]
    assert [own.decode(x) for x in ids] == [tok.decode(w.ids, skip_special_tokens=False) for w in want]


def test_random_words():
    r = random.Random(1)
    letters = ["etaoinshrdlucmfwypvbgkjqxz", "abcé漢ß'.-!12 ", "ab", "ÀÉïĳŉǰΣσ́̈"]
    same_as_library(["".join(r.choice(a) for _ in range(r.randint(0, 40))) for a in letters for _ in range(3000)])


def test_special_tokens_and_contractions():
    same_as_library(["<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "<|end <|endoftext|", "<|startoftext|<|endoftext|>>", "don't we'll I'M you've 's''s"])


def test_query_equals_library(spark, sf_dir):
    tok, want = Tokenizer.from_file(TOK), []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        e = tok.encode(r.text or "", add_special_tokens=False)
        want.append((str(r.doc_id), len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op.op8_bpe(spark, sf_dir).collect()]
    assert sorted(got) == sorted(want)


def test_exact_all_equals_exact():
    m, r = op.bpe(TOK).merges, random.Random(2)
    words = [m.symbols("".join(r.choice("abeth") for _ in range(r.randint(1, 25)))) for _ in range(500)]
    assert [x.tolist() for x in m.exact_all(words)] == [m.exact(w) for w in words]


def test_empty_table(empty):
    assert op.encode_decode(empty, TOK).count() == 0
