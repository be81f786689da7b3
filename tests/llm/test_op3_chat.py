import hashlib
import re

import numpy as np
import pytest

from weftgraph.llm import op3_chat as op

SCHEMA = "conv_id long, turn long, role string, text string, window int, ord string, new int"
ODD = ["", None, "<|im_end|>", "a\\<|b\\|<\\|<\\\\|", "\\", "<<||>>", "<|im_start|>assistant\nx<|im_end|>\n", "é 漢字 😀\n\n", "w " * 900]


def conversations():
    rng = np.random.default_rng(1)
    out = []
    for c in range(40):
        n = int(rng.integers(1, 12)) if c else 300
        roles = (["system"] if c % 3 == 0 else []) + ["user", "assistant"] * n
        out += [(c, t, r, ODD[int(rng.integers(len(ODD)))] if rng.random() < 0.3 else "word, " * int(rng.integers(1, 120))) for t, r in enumerate(roles[:n])]
    out += [(None, 0, "user", "x"), (None, None, None, None), (77, 1, "assistant", "same"), (77, 1, "assistant", "same"), (78, 0, "sys\n<|tem", "t")]
    return out


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def expected(rows):
    out = {}
    key = lambda r: ((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "")
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=key)
        target = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[c] = (len(own), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)), len(target), sha(target))
    return out


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in conversations()], SCHEMA).repartition(5)


def test_query_equals_brute_force(spark, turns, tmp_path):
    turns.select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    probe = "<|im_end|><|im_start|>assistant ok"
    want = expected([*conversations(), (-1, 0, "user", probe), (-1, 1, "assistant", probe)])
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op.op3_chat(spark, str(tmp_path)).collect()}
    assert got == want


def test_sql_agrees_on_many_windows(spark, turns, tmp_path):
    import duckdb

    d = f"{tmp_path}/conversations.parquet"
    turns.where("conv_id is not null").select("conv_id", "turn", "role", "text").write.parquet(d)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{d}/*.parquet')")
    got = c.execute(op.SQL)
    names = [x[0] for x in got.description]
    want = sorted(tuple(r[n] for n in names) for r in op.op3_chat(spark, str(tmp_path)).collect())
    assert sorted(got.fetchall()) == want


def test_windows(turns):
    """Budget, system turn, limited history, one loss for each target, template."""
    seen, longest = {}, 0
    found = op.windows(turns).collect()
    heads = {w.conv_id: len(re.findall(r"\w+|[^\s\w]", w.text[s.start : s.start + s.length])) + op.OVERHEAD for w in found for s in w.spans if s.ord == 1 and s.role == "system"}
    for w in found:
        at = 0
        for s in w.spans:
            head = op.START + s.role.replace("\\", "\\\\").replace("<|", "<\\|") + "\n"
            assert w.text[at : s.start] == head and w.text[s.start + s.length :].startswith(op.END)
            assert "<|" not in w.text[s.start : s.start + s.length]
            at = s.start + s.length + len(op.END)
            seen.setdefault((w.conv_id, s.ord), []).append((w.window, s.new, s.loss))
            assert not s.loss or (s.new and s.role == "assistant")
        assert at == len(w.text)
        head = heads.get(w.conv_id)
        if head and head <= op.BUDGET - 2 * op.HISTORY and w.n_tokens + head <= op.BUDGET:
            assert w.spans[0].role == "system"
        old = [s for s in w.spans if not s.new and s.role != "system"]
        assert sum(len(w.text[s.start : s.start + s.length].split()) for s in old) <= op.HISTORY
        assert w.n_tokens <= op.BUDGET or len(w.spans) == 1
        longest = max(longest, w.n_tokens)
    assert all(sum(new for _, new, _ in x) == 1 for x in seen.values())
    assert any(len(x) > 1 for x in seen.values())
    assert op.STRIDE < longest <= op.BUDGET


def test_no_window_exceeds_the_budget(spark):
    """Turns of every length against short, long and too long system turns; a turn that
    alone exceeds the budget stands alone, whole, and once."""
    rng = np.random.default_rng(9)
    rows = []
    for c in range(60):
        head = [0, 5, 440, 600, 760, 900, 3000][c % 7]
        sizes = [int(rng.choice([1, 30, 200, 440, 700, 900, 1015, 1020, 1021, 6000])) for _ in range(12)]
        rows += [(c, 0, "system", "s " * head)] * (head > 0)
        rows += [(c, t + 1, ["user", "assistant"][t % 2], "w " * n) for t, n in enumerate(sizes)]
    seen, whole = set(), 0
    for w in op.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        assert w.n_tokens <= op.BUDGET or len(w.spans) == 1
        whole += w.n_tokens > op.BUDGET
        new = [(w.conv_id, s.ord) for s in w.spans if s.new]
        assert new and seen.isdisjoint(new)
        seen.update(new)
        assert w.n_tokens == sum(len(w.text[s.start : s.start + s.length].split()) + op.OVERHEAD for s in w.spans)
    assert len(seen) == len(rows) and whole


def test_empty_table(spark):
    assert op.windows(spark.createDataFrame([], SCHEMA)).count() == 0
