"""Language identification by Bayesian evidence fusion (operator 6).

The posterior of a language is the product of
- the likelihood of the text: hashed byte trigrams under one distribution a language,
  tempered by a factor fitted on texts that the distributions have not seen;
- the declared markup language and the address suffix, as categorical likelihoods
  counted over the corpus: how far they are believed is learnt, not assumed;
- the prior of the row's host, smoothed towards its domain, that towards its suffix,
  and that towards the corpus: grouped aggregates of the texts' own verdicts, each
  row's own vote left out.
Missing evidence (null or empty) leaves the posterior unchanged. A row without a
single letter is "und" (undetermined), with posterior 0, unless other evidence speaks.

The text model is fitted on a bounded sample: of every labelled language at most
``SAMPLE`` texts of at most ``SAMPLE_CHARS`` characters, or, where all are longer,
``FEW`` of them. It takes 256 kB a language. The counts behind all other evidence cover
every row.

Hosts, domains, suffixes and declarations are joined with their counts by
``spread_join``: rows of a value that many rows have, and rows without one, stay dealt
over all tasks.

Other columns of the rows ride along unread. Null texts count as empty, null keys and repeated rows are kept, an empty table gives
no rows. Ties go to the language that sorts first. With no labelled text at all,
every row is "und"."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import picked, place_of, positional, row_key, sampled_texts, slices, spread_join, table, written

SAMPLE = 500
SAMPLE_CHARS = 20_000
#: Texts of a language that has longer ones only.
FEW = 4
BUCKETS = 1 << 16
#: Trigrams from which a text's own verdict counts as a vote.
VOTE_GRAMS = 50
#: Pseudo-counts of the level above.
ALPHA = 20.0
#: Bytes of a text whose trigrams are in memory at a time.
SPAN = 1 << 20

MARKUP = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


@dataclass(frozen=True)
class TextModel:
    """Log probabilities, BUCKETS x languages, and the tempering factor."""

    languages: tuple[str, ...]
    weights: np.ndarray
    temper: float


def grams(text: str) -> Iterator[np.ndarray]:
    """Trigram buckets of a lower-cased text whose non-letters are single blanks."""
    data = (" " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " ").encode()
    if len(data) < 3:
        return
    for at in range(0, len(data) - 2, SPAN):
        b = np.frombuffer(data, np.uint8, min(SPAN + 2, len(data) - at), at).astype(np.uint32)
        yield ((b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)).astype(np.int64)


def likelihoods(text: str, weights: np.ndarray) -> tuple[np.ndarray, int]:
    total, n = np.zeros(weights.shape[1]), 0
    for g in grams(text):
        total += weights[g].sum(axis=0, dtype=np.float64)
        n += len(g)
    return total, n


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_texts(by_language: dict[str, list[str]]) -> TextModel:
    """Distributions from each language's first half, the temper from the second; a
    language of one text has a distribution of it."""
    languages = tuple(sorted(k for k, t in by_language.items() if t))
    counts = np.full((BUCKETS, len(languages)), 0.05)
    for j, k in enumerate(languages):
        for text in by_language[k][: max(1, len(by_language[k]) // 2)]:
            for g in grams(text):
                counts[:, j] += np.bincount(g, minlength=BUCKETS)
    weights = np.log(counts / counts.sum(axis=0, keepdims=True)).astype(np.float32) if languages else np.zeros((BUCKETS, 0), np.float32)
    seen, truth = [], []
    for j, k in enumerate(languages):
        for text in by_language[k][max(1, len(by_language[k]) // 2) :]:
            ll, n = likelihoods(text, weights)
            if n:
                seen.append(ll)
                truth.append(j)
    best, temper = -np.inf, 0.3
    for t in (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0) if len(seen) else ():
        p = softmax(np.array(seen) * t)[np.arange(len(truth)), truth]
        if (score := np.log(np.maximum(p, 1e-12)).mean()) > best:
            best, temper = score, t
    return TextModel(languages, weights, temper)


def fit(docs: DataFrame) -> TextModel:
    """The text model from a bounded sample of documents with a language label."""
    own = picked(docs, "lang", "text")
    rows = own.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and lang <> '' and length(text) > 0").withColumn("h", F.xxhash64("lang", "text"))
    short = F.length("text") <= SAMPLE_CHARS
    # a row a language
    counts = rows.groupBy("lang").agg(F.count_if(short).alias("n"), F.count(F.lit(1)).alias("all")).collect()
    some = lambda of, size, n: sampled_texts(rows.where(of).select(F.col("lang").alias("cls"), "h"), rows.select("h", "text"), size, n)
    texts = some(short, SAMPLE, {r["lang"]: r["n"] for r in counts if r["n"]})
    long = {r["lang"]: r["all"] for r in counts if not r["n"]}
    return fit_texts(texts | some(~short, FEW, long))


READ = ["text", "markup", "url", "host"]
FOUND = "host string, domain string, suffix string, declared string, ll array<double>, grams long, vote int"


def schema_of(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{n}` {df.schema[n].dataType.simpleString()}, " for n in names)


def evidence(rows: DataFrame, model: TextModel) -> DataFrame:
    """Of rows (text, markup, url, host, and any others): the others, host, domain, suffix,
    declared, ll (log likelihood by language), grams, and vote (the text's verdict, if
    long)."""
    shared = rows.sparkSession.sparkContext.broadcast(model.weights)  # 256 kB a language
    kept = [c for c in rows.columns if c not in READ]
    names = [*kept, *(f.split()[0] for f in FOUND.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in slices(batches, len(kept)):
            out = []
            for text, markup, url, host in zip(*(batch.column(len(kept) + i).to_pylist() for i in range(4)), strict=True):
                declared = None
                if markup is not None:
                    m = DECLARED.search(markup)
                    declared = m[1].lower() if m else None
                    text = html.unescape(MARKUP.sub(" ", markup))
                domain = suffix = None
                if url is not None:
                    m = HOST.match(url)
                    host = m[1].lower().rstrip(".") if m else None
                    labels = host.split(".") if host else []
                    domain, suffix = (".".join(labels[-2:]), labels[-1]) if len(labels) > 1 else (host, None)
                ll, n = likelihoods(text or "", weights)
                vote = int(np.argmax(ll)) if n >= VOTE_GRAMS and len(ll) else None
                out.append((host, domain or host, suffix, declared, ll.tolist(), n, vote))
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.float64()), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names)

    return rows.select(*kept, *READ).mapInArrow(run, schema_of(rows, kept) + FOUND)


def votes_by(ev: DataFrame, key: str, n: int) -> DataFrame:
    """Of each value of ``key``: its votes by language as one array, and its rows."""
    counted = [F.sum((F.col("vote") == i).cast("double")) for i in range(n)]
    counted = [F.coalesce(c, F.lit(0.0)) for c in counted]
    return ev.where(F.col(key).isNotNull()).groupBy(key).agg(F.array(*counted).alias(f"n_{key}"), F.count(F.lit(1)).alias("rows"))


def matrix(column: pa.ListArray, n: int) -> np.ndarray:
    """Lists of n numbers as rows, nulls as zeros."""
    out = np.zeros((len(column), n))
    out[column.is_valid().to_numpy(zero_copy_only=False)] = column.drop_null().flatten().to_numpy().reshape(-1, n)
    return out


KEYS = ("host", "domain", "suffix", "declared")


def fuse(ev: DataFrame, model: TextModel) -> DataFrame:
    """lang, posterior and text_lang of every row of ``evidence``, and what else it has."""
    n = len(model.languages)
    kept = [c for c in ev.columns if c not in [f.split()[0] for f in FOUND.split(", ")]]
    if not n:
        return ev.select(*kept, F.lit("und").alias("lang"), F.lit(0.0).alias("posterior"), F.lit(None).cast("string").alias("text_lang"))
    corpus, rows = np.zeros(n), 0
    for r in ev.groupBy("vote").count().collect():  # a row a language
        rows += r["count"]
        if r["vote"] is not None:
            corpus[r["vote"]] = r["count"]
    joined = ev.withColumn("spread", F.xxhash64(*kept, "ll", "grams"))
    for key in KEYS:
        joined = spread_join(joined, votes_by(ev, key, n), key, "rows", rows, "spread")
    names, temper = np.array([*model.languages]), model.temper

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=4096):
            col = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731, B023
            size, ll = batch.num_rows, matrix(col("ll"), n)
            own, known = np.zeros((size, n)), {k: col(k).is_valid().to_numpy(zero_copy_only=False) for k in KEYS}
            voted = col("vote").is_valid().to_numpy(zero_copy_only=False)
            own[np.flatnonzero(voted), col("vote").drop_null().to_numpy()] = 1
            counts = {k: matrix(col(f"n_{k}"), n) for k in KEYS}
            rest = np.maximum(corpus - own, 0)
            prior = (rest + 1) / (rest.sum(axis=1, keepdims=True) + n)
            for k in ("suffix", "domain", "host"):
                c = np.maximum(counts[k] - own, 0) * known[k][:, None]
                prior = (c + ALPHA * prior) / (c.sum(axis=1, keepdims=True) + ALPHA)
            z = ll * temper + np.log(prior)
            # the suffix is in the prior already; what the page declares is new evidence
            c = np.maximum(counts["declared"] - own, 0)
            share = (c.sum(axis=1, keepdims=True) + 1) / (rest.sum(axis=1, keepdims=True) + n)
            z += np.where(known["declared"][:, None], np.log((c + ALPHA * share) / (rest + ALPHA)), 0)
            p = softmax(z)
            grams = col("grams").to_numpy()
            spoken = (grams > 0) | known["declared"] | known["suffix"]
            lang = np.where(spoken, names[p.argmax(axis=1)], "und")
            text = pa.array(names[ll.argmax(axis=1)], pa.string(), mask=grams <= 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(lang, pa.string()), pa.array(np.where(spoken, p.max(axis=1), 0.0)), text], [*kept, "lang", "posterior", "text_lang"])

    wide = joined.select(*kept, *KEYS, "ll", "grams", "vote", *[f"n_{k}" for k in KEYS])
    return wide.mapInArrow(run, schema_of(ev, kept) + "lang string, posterior double, text_lang string")


def identify(rows: DataFrame, model: TextModel) -> DataFrame:
    """lang, posterior and text_lang of rows (text, markup, url, host), with what other
    columns they have, such as a key."""
    return fuse(written(evidence(rows, model), "language-evidence"), model)


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents as rows (id, text, markup, url, host) to identify: their source is the
    host; their language label is what the text model learns from and so is never
    evidence for a verdict."""
    null = F.lit(None).cast("string")
    own = picked(docs, "doc_id", "text", "source")
    return own.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"), null.alias("markup"), null.alias("url"), F.col("source").cast("string").alias("host"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages as rows (id, text, markup, url, host) to identify."""
    null = F.lit(None).cast("string")
    return picked(pages, "page_id", "html", "url").select(F.col("page_id").alias("id"), null.alias("text"), F.col("html").alias("markup"), "url", null.alias("host"))


#: Least posterior of an accepted verdict.
ACCEPT = 0.5


def keep_identified(docs: DataFrame, model: TextModel, threshold: float = ACCEPT) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is identified.

    Rows are told apart by a 128-bit digest of key, text and source, so repeated rows
    share their verdict and null keys keep theirs; columns are taken by position, so
    clashing names are harmless. An empty table stays empty. Without a model, for lack of
    any language label, nothing is judged and all rows stay."""
    if not model.languages:
        return docs
    rows = positional(docs)
    tagged = rows.withColumn("tag", row_key(*[F.col(place_of(docs, c)) for c in ("doc_id", "text", "source")]))
    named = tagged.select(F.col("tag").alias("doc_id"), F.col(place_of(docs, "text")).alias("text"), F.col(place_of(docs, "source")).alias("source"))
    verdicts = identify(document_rows(named), model)
    good = verdicts.where((F.col("lang") != "und") & (F.col("posterior") >= threshold)).select(F.col("id").alias("tag")).distinct()
    return tagged.join(good, "tag", "left_semi").select(*rows.columns).toDF(*docs.columns)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all pages: doc_id (for a page -1 - page_id), page_id (null for a
    document), lang, posterior, text_lang, accepted."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs)
    rows = document_rows(docs).withColumn("page", F.lit(False)).unionByName(page_rows(table(spark, sf_dir, "pages")).withColumn("page", F.lit(True)))
    got = identify(rows, model)
    return got.select(
        F.when(F.col("page"), -1 - F.col("id")).otherwise(F.col("id")).alias("doc_id"),
        F.when(F.col("page"), F.col("id")).alias("page_id"),
        "lang",
        "posterior",
        "text_lang",
        ((F.col("lang") != "und") & (F.col("posterior") >= ACCEPT)).alias("accepted"),
    )
