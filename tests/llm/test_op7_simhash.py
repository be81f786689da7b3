import re

import numpy as np
import pytest
import xxhash

from weftgraph.llm import op7_simhash as op
from weftgraph.llm.components import components


def brute_fp(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows, radius=4):
    n, root = len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    x = np.array([r[1] for r in rows], np.uint64)
    for i, j in zip(*np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= radius), strict=True):
        root[find(i)] = find(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(rows[i][0], least.get(find(i), rows[i][0]))
    return sorted((str(rows[i][0]), rows[i][1], str(least.get(find(i)))) for i in range(n))


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, brute_fp(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((str(r.doc_id), int(r.fingerprint, 16), str(r.component_id)) for r in op.op7_simhash(spark, sf_dir).collect())
    assert got == brute_groups(rows)


@pytest.mark.parametrize("block", [8, 2048])
def test_links_connect_all_within_the_radius(spark, monkeypatch, block):
    """Dense balls, chains and strangers, also with cells cut into blocks."""
    monkeypatch.setattr(op, "BLOCK", block)
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    xs = list(base)
    for b in base[:6]:
        for _ in range(60):
            xs.append(b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 7)).astype(np.uint64)))
    x = base[7]
    for _ in range(30):
        x ^= np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, 4, replace=False).astype(np.uint64))
        xs.append(x)
    xs = sorted({int(v) for v in xs})
    signed = [v - 2**64 if v >> 63 else v for v in xs]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {r.node: r.root for r in components(op.links(df, 4)).collect()}
    got = {}
    for u, v in zip(xs, signed, strict=True):
        got.setdefault(found.get(v, v), []).append(u)
    want = {}
    for key, u, root in brute_groups([(i, v) for i, v in enumerate(xs)]):
        want.setdefault(root, []).append(u)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_long_text_in_spans(monkeypatch):
    text = " ".join(f"w{i % 977}x{i % 31}" for i in range(3000))
    whole = op.fingerprint(text.encode())
    monkeypatch.setattr(op, "SPAN", 97)
    assert op.fingerprint(text.encode()) == whole == brute_fp(text)


def test_more_groups_for_more_rows():
    assert [op.groups_needed(n, 4) for n in (10, 10**6, 10**9)] == sorted(op.groups_needed(n, 4) for n in (10, 10**6, 10**9))


def test_empty_table(empty):
    assert op.simhash_groups(empty).count() == 0
