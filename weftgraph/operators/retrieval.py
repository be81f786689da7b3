"""Vector and text retrieval."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import col, tokens

STOPWORDS = ("the", "and", "for", "with", "that", "this", "from", "what", "which", "who", "how", "are", "was", "were", "did", "does", "has", "have")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in doubles; no rows leave the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, z: s + z)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """V5: 0 for a zero vector or unequal lengths, else within [-1, 1]."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n))).otherwise(0.0)


def top_cosine(items: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """V1: the k items of greatest cosine; a stated query against all rows."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return items.withColumn("score", F.round(cosine(F.col("embedding"), q), 6)).orderBy(F.desc("score"), "id").limit(k)


def top_l2(items: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """V2: the k items of least squared distance d, with score 1 / (1 + d)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    d = F.aggregate(F.zip_with("embedding", q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, z: s + z)
    return items.withColumn("score", F.round(1 / (1 + d), 6)).orderBy(F.desc("score"), "id").limit(k)


#: Most vectors of a query block; items stand in blocks of an Arrow batch.
QUERIES = 1024


def _packed(df: DataFrame, rows: int) -> DataFrame:
    """(ids, sizes, flat) of blocks of at most ``rows`` rows of (id, vector): ids in order,
    nulls first; the vectors' lengths, and all their numbers as doubles. A vector that is
    null or has a null scores 0 with all: its length is -1."""
    kind = df.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                part = part.take(pc.sort_indices(part.column(0), null_placement="at_start"))
                vectors = [None if v is None or None in v else v for v in part.column(1).to_pylist()]
                sizes = np.array([-1 if v is None else len(v) for v in vectors], np.int32)
                flat = np.array([x for v in vectors if v for x in v], np.float64)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([sizes.tobytes()]), pa.array([flat.tobytes()])], ["ids", "sizes", "flat"])

    return df.mapInArrow(run, f"ids array<{kind}>, sizes binary, flat binary")


def _vectors(sizes: pa.Scalar, flat: pa.Scalar) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The vectors of a block by length: (places, matrix)."""
    n, x = np.frombuffer(sizes.as_buffer(), np.int32), np.frombuffer(flat.as_buffer(), np.float64)
    start = np.cumsum(np.maximum(n, 0)) - np.maximum(n, 0)
    return {int(d): (at := np.flatnonzero(n == d), x[start[at][:, None] + np.arange(d)]) for d in np.unique(n[n > 0])}


def _in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices, summed as ``dot`` does."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out += x[:, k] * y[:, k]
    return out


def millionths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of all rows of x with all of y in whole millionths, as ``round(cosine, 6)``
    has them. Where the product of the matrices leaves the last digit open, and for zeros,
    NaN and infinities, each pair is summed in order and rounded by its decimal digits."""
    with np.errstate(all="ignore"):
        p, q = np.sqrt(_in_order(x, x)), np.sqrt(_in_order(y, y))
        c = (x @ y.T) / (p[:, None] * q[None, :]) * 1e6
        near = np.abs(np.abs(c) % 1 - 0.5)
        out = np.clip(np.sign(c) * np.floor(np.abs(c) + 0.5), -1e6, 1e6)
        plain = [(n > 1e-100) & (n < 1e100) for n in (p, q)]
        i, j = np.nonzero(~(near >= 1e-6) | ~(plain[0][:, None] & plain[1][None, :]))
        if len(i):
            n = p[i] * q[j]
            v = _in_order(x[i], y[j]) / n
            v = np.where(np.isnan(v), 1.0, np.clip(v, -1.0, 1.0))
            v, back = np.unique(np.where((n > 0) | np.isnan(n), v, 0.0), return_inverse=True)
            exact = np.array([int(Decimal(repr(float(k))).quantize(Decimal("1e-6"), ROUND_HALF_UP).scaleb(6)) for k in v], np.float64)
            out[i, j] = exact[back]
    return out


def top_each(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """V1 for a table of queries (query, q): k items each, of greatest rounded cosine, then
    of least id. Every query meets every item, as blocks that are multiplied in place; a
    pair of blocks gives k rows a query, not its pairs."""
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, "query"), (items, "id"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                asked, ids = batch.column(0)[r].values, batch.column(3)[r].values
                one, two = (_vectors(batch.column(c + 1)[r], batch.column(c + 2)[r]) for c in (0, 3))
                for lo in range(0, len(asked), 256):
                    hi = min(lo + 256, len(asked))
                    score = np.zeros((hi - lo, len(ids)))
                    for d, (at, x) in one.items():
                        mine = (at >= lo) & (at < hi)
                        if d in two and mine.any():
                            score[np.ix_(at[mine] - lo, two[d][0])] = millionths(x[mine], two[d][1])
                    # ids are in order, so places break ties; the keys are whole numbers
                    key = np.arange(len(ids)) - score * len(ids)
                    best = np.argpartition(key, k - 1, axis=1)[:, :k] if k < len(ids) else np.tile(np.arange(len(ids)), (hi - lo, 1))
                    own = np.repeat(np.arange(lo, hi), best.shape[1])
                    found = np.take_along_axis(score, best, axis=1).ravel() / 1e6
                    yield pa.RecordBatch.from_arrays([asked.take(pa.array(own)), ids.take(pa.array(best.ravel())), pa.array(found)], ["query", "id", "score"])

    # by id, so that one small file is no single task; as many parts as the cluster has cores
    dealt = items.select("id", "embedding").repartition(items.sparkSession.sparkContext.defaultParallelism, "id")
    one = _packed(queries.select("query", "q"), QUERIES).toDF("asked", "m", "x")
    both = one.crossJoin(_packed(dealt, 1 << 13))
    best = both.mapInArrow(run, f"query {kinds[0]}, id {kinds[1]}, score double")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def upsert_items(writes: DataFrame) -> DataFrame:
    """V3: the last write of each id; a null embedding is a tombstone."""
    return writes.groupBy("id").agg(F.max_by(F.struct("embedding", "text"), "ordinal").alias("w")).select("id", "w.*").where("embedding is not null")


def delete_source(items: DataFrame, source: str) -> DataFrame:
    """V4: without the chunks of a source: a half-open range of ids, so no other source
    whose name begins alike is hit."""
    low = f"{source}_chunk_"
    high = f"{source}_chunk" + chr(ord("_") + 1)
    return items.where(~((F.col("id") >= low) & (F.col("id") < high)))


def tfidf_top(docs: DataFrame, question: str, k: int = 3) -> DataFrame:
    """V7: rows (id, text) by cosine of tf-idf with a question: tf = count / length,
    idf = ln((n + 1) / (df + 1)) + 1, scores above 0. Document frequencies are only
    needed for the question's words; norms need all."""
    words = docs.select("id", F.explode(F.filter(F.split(F.lower("text"), r"[^a-z0-9]+"), lambda w: w != "")).alias("w"))
    tf = words.groupBy("id", "w").agg(F.count(F.lit(1)).alias("c"))
    length = tf.groupBy("id").agg(F.sum("c").alias("len"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))  # one row
    idf = tf.groupBy("w").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n)).select("w", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    weight = tf.join(idf, "w").join(length, "id").select("id", "w", (F.col("c") / F.col("len") * F.col("idf")).alias("x"), "idf")
    q = [w for w in "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in question.lower()).split()]
    asked = docs.sparkSession.createDataFrame([(w, q.count(w) / max(1, len(q))) for w in sorted(set(q))], "w string, qtf double")
    asked = asked.join(idf, "w").select("w", (F.col("qtf") * F.col("idf")).alias("q"))
    qn = asked.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qn"))
    norms = weight.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("dn"))
    score = weight.join(F.broadcast(asked), "w").groupBy("id").agg(F.sum(F.col("x") * F.col("q")).alias("s")).join(norms, "id").join(F.broadcast(qn))
    return score.select("id", F.round(F.col("s") / (F.col("dn") * F.col("qn")), 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k)


def resolve_entities(nodes: DataFrame, mention: str, hint: str = "", k: int = 5) -> DataFrame:
    """V8, W-7: nodes (id, name, label, alias) whose name has a word of the mention, by
    lexical overlap + 0.15 for the hinted label + 0.2 for the exact name + 0.12 for the
    alias; the best is confident if it leads by more than 0.15."""
    asked = F.array(*[F.lit(w) for w in mention.lower().split()])
    name = tokens("name")
    own = nodes.where(F.arrays_overlap(name, asked) | (F.lower("alias") == mention.lower()))
    s = F.size(F.array_intersect(name, asked)) / F.size(F.array_union(name, asked))
    s = s + F.when(F.col("label") == hint, 0.15).otherwise(0) + F.when(F.lower("name") == mention.lower(), 0.2).otherwise(0) + F.when(F.lower("alias") == mention.lower(), 0.12).otherwise(0)
    top = own.withColumn("score", F.round(s, 4)).orderBy(F.desc("score"), "id").limit(k)
    w = Window.orderBy(F.desc("score"), "id")  # k rows
    return top.withColumn("confident", (F.row_number().over(w) == 1) & (F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0)) > 0.15)).select("id", "name", "score", "confident")


def nearest_examples(examples: DataFrame, question: Column, k: int) -> DataFrame:
    """Examples by Jaccard of masked words, ties by question."""
    a, b = tokens("masked"), tokens(question)
    return examples.withColumn("score", F.round(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)), 6)).orderBy(F.desc("score"), "question").limit(k)


def chunk_fallback(chunks: DataFrame, question: str, k: int = 3) -> DataFrame:
    """Chunks with any of the question's first eight words of three letters up
    that are no stop words; the first 400 characters of each. In order of words met,
    then id, where the original took any."""
    words = [w for w in dict.fromkeys("".join(c if c.isalnum() else " " for c in question.lower()).split()) if len(w) > 2 and w not in STOPWORDS][:8]
    if not words:
        return chunks.limit(0).select("id", F.lit("").alias("text"), F.lit(0).alias("hits"))
    hits = reduce(Column.__add__, [F.lower("text").contains(w).cast("int") for w in words])
    return chunks.withColumn("hits", hits).where("hits > 0").orderBy(F.desc("hits"), "id").limit(k).select("id", F.substring("text", 1, 400).alias("text"), "hits")


def postings(docs: DataFrame) -> DataFrame:
    """A full-text index: for each word its documents, as rows."""
    return docs.select("id", F.explode(tokens("text")).alias("word"))


def route(graphs: DataFrame, question: str, k: int, strict: bool = False) -> DataFrame:
    """The k graphs (name, metadata, blocked) with most words of the question in
    their metadata. Blocked ones are skipped; unless strict, the best stands in for none."""
    asked = F.array(*[F.lit(w) for w in sorted(set(question.lower().split()))])
    own = graphs.where(~F.col("blocked")).select("name", F.size(F.array_intersect(tokens("metadata"), asked)).alias("score"))
    top = own.orderBy(F.desc("score"), "name").limit(k)
    if strict:
        return top.where("score > 0")
    best = F.row_number().over(Window.orderBy(F.desc("score"), "name"))  # k rows
    return top.withColumn("r", best).where("score > 0 or r = 1").select("name", "score")


def contains_any(c, words: list[str]) -> Column:
    return reduce(Column.__or__, [F.lower(col(c)).contains(w.lower()) for w in words], F.lit(False))
