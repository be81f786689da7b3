from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from weftgraph.llm import near_copies as op
from weftgraph.llm import op7_simhash


def shingled(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(texts):
    """Least index of each text's component, from all pairs."""
    own, root = [shingled(t) for t in texts], list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j]):
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    return root


def groups(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in op.near_copy_groups(df).collect()}
    return [got[i] for i in range(len(texts))]


def at_the_threshold():
    """Texts that differ in the last word: 8 common shingles of 10 link, 7 of 9 do not."""
    w = [f"w{i}" for i in range(40)]
    at, below = [" ".join(w[:13]), " ".join([*w[:12], "x"])], [" ".join(w[20:32]), " ".join([*w[20:31], "y"])]
    assert len(shingled(at[0]) & shingled(at[1])) / len(shingled(at[0]) | shingled(at[1])) == 8 / 10
    assert len(shingled(below[0]) & shingled(below[1])) / len(shingled(below[0]) | shingled(below[1])) == 7 / 9
    return at + below


def test_groups_equal_all_pairs(spark):
    """Scattered edits from far below to far above the threshold, pairs just at and below
    it, and a common line."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("etaoinshrdlu"), 6))
    line = " ".join(word() for _ in range(30))
    texts = []
    for i in range(60):
        w = [word() for _ in range(250)]
        for edits in (0, *rng.integers(1, 12, 2)):
            v = list(w)
            for at in rng.choice(250, edits, replace=False):
                v[at] = word()
            texts.append(" ".join(v) + (" " + line if i % 2 else ""))
    texts += [*at_the_threshold(), line, line.upper(), "", "few words", "few words"]
    want = brute(texts[:-3]) + [len(texts) - 3, len(texts) - 2, len(texts) - 2]
    assert groups(spark, texts) == want
    n = len(texts) - 9
    assert want[n : n + 4] == [n, n, n + 2, n + 3]
    assert 60 < len(set(want)) < len(texts)


def test_keep_one_drops_no_text_below(spark):
    """Pairs at 0.6 to 0.79 all stay, pairs from 0.8 on lose one."""
    rng = np.random.default_rng(6)
    rows, stays = [], 0
    for i in range(80):
        w = [f"{i}x{k}" for k in range(204)]
        v = list(w)
        for k in range(1 + i % 9):
            v[5 + 20 * k] = "z" + "".join(rng.choice(list("abcdef"), 8))
        near = 5 * len(shingled(" ".join(w)) & shingled(" ".join(v))) >= 4 * len(shingled(" ".join(w)) | shingled(" ".join(v)))
        stays += 1 if near else 2
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    assert op7_simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).count() == stays


def test_bit_maps_lose_no_pair():
    """Close pairs hold all that is similar, whatever the sizes of the maps."""
    rng = np.random.default_rng(8)
    sets = []
    for n in (1, 2, 15, 16, 17, 63, 64, 65, 66, 500, 4100):
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        for keep in (1.0, 0.97, 0.9, 0.85, 0.7):
            own = np.concatenate((base[rng.random(n) < keep], rng.integers(0, 2**63, int(n * (1 - keep) / 4)).astype(np.uint64)))
            sets.append(np.unique(own if len(own) else base))
    nodes = np.arange(len(sets))
    maps = [op.bit_map(s) for s in sets]
    got = set(op.close_pairs(nodes, nodes, np.array([len(s) for s in sets]), None, maps, False))
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if op.similar(sets[i], sets[j])}
    assert want <= got and len(got) < 4 * len(want)
    assert all(np.array_equal(op.folded(m, len(m) // 2), op.folded(op.folded(m, len(m) // 2), len(m) // 2)) for m in maps if len(m) > 1)


def test_a_dense_group_gives_fewer_links_than_sets():
    """Of a group in which all pairs are close, links connect it; they are not its pairs."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(300) < 0.03, rng.integers(0, 2**63, 300).astype(np.uint64), base)) for _ in range(80)]
    sets += [np.unique(rng.integers(0, 2**63, 300).astype(np.uint64)) for _ in range(20)]
    every, sizes = np.arange(100), np.array([len(s) for s in sets])
    assert len(set(op.close_pairs(every, every, sizes, None, [op.bit_map(s) for s in sets], False))) > 3000
    for own in (None, every % 2):
        got, label = op.connecting(every, own, sets), list(range(100))
        for i, j in got:
            assert op.similar(sets[i], sets[j]) and (own is None or own[i] != own[j])
            label = [label[i] if x == label[j] else x for x in label]
        assert len(got) == 79 and len(set(label[:80])) == 1 and len(set(label)) == 21


def test_a_large_root_does_not_meet_itself(spark):
    """900 nodes of one root and 3 others in a list: the 3 stand in every block, the
    others once, and each pair of different roots meets once."""
    rows = [(1, i, 9, i if i > 900 else 0, (0, 0, 9)) for i in range(1, 904)]
    opened = spark.createDataFrame(rows, "tok long, node long, n int, root long, first struct<root: long, node: long, n: int>")
    got = op.blocks(opened, opened.select("node", F.lit(b"").alias("what"))).collect()
    assert sum(r.i != r.j for r in got) == 4 and sum(len(r["members"]) for r in got) == 900 + 3 * 5
    met = [frozenset((x.node, y.node)) for r in got for x, y in combinations(r["members"], 2) if x.root != y.root and (r.i == r.j or x.own != y.own)]
    assert len(met) == len(set(met)) == 3 * 900 + 3
