import numpy as np

from weftgraph.llm import op6_language as op

LETTERS = {"aa": "abcdefgh", "bb": "hijklmno", "cc": "opqrstuv"}


def say(rng, lang, n):
    return " ".join("".join(rng.choice(list(LETTERS[lang]), 6)) for _ in range(n))


def model(rng):
    return op.fit_texts({k: [say(rng, k, 40) for _ in range(20)] for k in LETTERS})


def test_held_out_accuracy(spark):
    rng = np.random.default_rng(1)
    rows = [(i, say(rng, k, 12), k, None, 1) for i, k in enumerate(list(LETTERS) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    train, test = docs.where("doc_id < 90"), docs.where("doc_id >= 90")
    got = op.identify(op.document_rows(test), op.fit(train)).collect()
    assert np.mean([r.lang == rows[r.id][2] for r in got]) > 0.98


def test_evidence_is_fused(spark):
    """Wordless pages follow what they declare, and their host where nothing is said."""
    rng = np.random.default_rng(2)
    pages = [(i, f"http://h{i % 2}.x.test/", f"<html lang='{k}'><p>{say(rng, k, 60)}</p><script>{say(rng, 'cc', 90)}</script>") for i, k in enumerate(["aa", "bb"] * 40)]
    pages += [(100, "http://new.test/", "<html lang='bb'><p>12</p>"), (101, "http://h0.x.test/a", "<p>34</p>"), (102, "http://h1.x.test/b", "<p>56"), (103, None, "78"), (104, None, None), (None, "no address", "")]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, host string")
    got = {r.id: r for r in op.identify(op.page_rows(df), model(rng)).collect()}
    assert len(got) == len(pages)
    assert all(got[i].lang == ["aa", "bb"][i % 2] and got[i].posterior > 0.9 for i in range(80))
    assert (got[100].lang, got[101].lang, got[102].lang) == ("bb", "aa", "bb")
    assert (got[103].lang, got[104].lang, got[None].lang) == ("und", "und", "und")


def brute(rows, m):
    """(lang, posterior) of rows (text, declared, host, domain, suffix), one at a time."""
    n = len(m.languages)
    told = [op.likelihoods(r[0], m.weights) for r in rows]
    vote = [int(np.argmax(ll)) if k >= op.VOTE_GRAMS else None for ll, k in told]

    def counts(at, value, but):
        out = np.zeros(n)
        for i, r in enumerate(rows):
            if i != but and vote[i] is not None and (at is None or (r[at] is not None and r[at] == value)):
                out[vote[i]] += 1
        return out

    out = []
    for i, r in enumerate(rows):
        everything = counts(None, None, i)
        prior = (everything + 1) / (everything.sum() + n)
        for at in (4, 3, 2):
            c = counts(at, r[at], i)
            prior = (c + op.ALPHA * prior) / (c.sum() + op.ALPHA)
        z = told[i][0] * m.temper + np.log(prior)
        if r[1] is not None:
            c = counts(1, r[1], i)
            share = (c.sum() + 1) / (everything.sum() + n)
            z = z + np.log((c + op.ALPHA * share) / (everything + op.ALPHA))
        p = np.exp(z - z.max())
        p /= p.sum()
        known = told[i][1] > 0 or r[1] is not None or r[4] is not None
        out.append((m.languages[int(p.argmax())], float(p.max())) if known else ("und", 0.0))
    return out


def test_query_equals_brute_force(spark, tmp_path):
    """The whole query, one host with over a third of all rows, null and clashing keys."""
    rng = np.random.default_rng(3)
    names = list(LETTERS)
    docs = [(i, say(rng, names[i % 3], int(rng.integers(1, 40))), names[i % 3], "hot" if i % 5 < 2 else f"s{i % 7}", 1) for i in range(150)]
    docs += [(-3, "12 34", None, "s1", 1), (-1, "", "aa", None, 1), (None, None, None, "hot", 1), (7, docs[7][1], "bb", "hot", 1)]
    pages = [(i, f"http://h{i % 3}.x.t{i % 2}/{i}", f"<html lang='{names[i % 2]}'><p>{say(rng, names[i % 2], 30)}") for i in range(30)] + [(90, "http://new.zz/", "12"), (2, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2).write.parquet(f"{tmp_path}/pages.parquet")
    m = op.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    rows = [(t or "", None, s, s, None) for _, t, _, s, _ in docs]
    for i, url, page in pages:
        text = op.html.unescape(op.MARKUP.sub(" ", page)) if page else ""
        host = op.HOST.match(url)[1] if url else None
        labels = host.split(".") if host else []
        said = op.DECLARED.search(page or "")
        rows.append((text, said[1] if said else None, host, ".".join(labels[-2:]) or None, labels[-1] if labels else None))
    want = sorted([(d[0], None, *w) for d, w in zip(docs, brute(rows, m), strict=False)] + [(-1 - p[0], p[0], *w) for p, w in zip(pages, brute(rows, m)[len(docs) :], strict=True)], key=str)
    got = sorted([(r.doc_id, r.page_id, r.lang, r.posterior) for r in op.op6_language(spark, str(tmp_path)).collect()], key=str)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want])


def test_every_label_has_a_model(spark):
    """Rare labels, and one that only long texts have."""
    rows = [("aa", "abc def")] * 3 + [("bb", "hij klm")] + [("cc", "qrs " * 6000)] + [(f"l{i}", f"x{i} yz") for i in range(80)]
    assert len(op.fit(spark.createDataFrame(rows, "lang string, text string")).languages) == 83


def test_odd_rows_and_filter(spark, docs):
    fitted = op.fit(docs)
    got = op.identify(op.document_rows(docs), fitted).collect()
    assert len(got) == docs.count()
    kept = op.keep_identified(docs, fitted)
    assert kept.columns == docs.columns
    assert kept.where("text is null or text = ''").count() == 0
    assert kept.where("text like 'Plain%'").count() == docs.where("text like 'Plain%'").count()


def test_empty_table(empty):
    fitted = op.fit(empty)
    assert fitted.languages == () and op.identify(op.document_rows(empty), fitted).count() == 0
    assert op.keep_identified(empty, fitted).count() == 0
