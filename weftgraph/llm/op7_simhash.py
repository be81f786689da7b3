"""SimHash near-duplicates by segment-popcount embedding (operator 7).

A fingerprint's 64 bits are 32 segments of two. Its embedding has the number of set
bits of each segment, held in unary (a segment's bits sorted), so that the Manhattan
distance of two embeddings is the popcount of an xor, and never above the Hamming
distance of the fingerprints.

Range join on a grid: the segments form k + r groups. Embeddings within Manhattan
distance r agree in at least k whole groups, so they share one of the C(k + r, k)
grid cells that k groups name: nothing within the radius is missed. Rows of a cell
are compared by the lower bound first; survivors are verified by Hamming distance.
k grows with the number of distinct fingerprints, which keeps cells small; it only
changes the cells, never the result.

Equal fingerprints are one class before the join, so groups of copies cost one row.
A cell beyond ``BLOCK`` rows is cut into hashed blocks and compared as pairs of
blocks, one task row each. A task emits a spanning forest of what it links, not all
pairs; components are the same.

Null text counts as empty: no words, fingerprint zero, linked like any other. A null
key keeps its row; a component's id is its least non-null key (null if it has none).
Repeated rows are each returned. An empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_text, place_of, positional, row_key, slices, spread_join, table, written
from .components import components

WORDS = 4
RADIUS = 4
SEED = 42
#: Rows of a cell that one comparison takes from each of two blocks.
BLOCK = 2048
SEGMENTS = 32
ODD = 0x5555555555555555
#: Bytes of a text that are split into words at a time.
SPAN = 1 << 20


def word_spans(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text (runs between ASCII white space), a span at a time."""
    at = 0
    while len(data) - at > SPAN:
        end = at + SPAN
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end].split()
        at = end
    yield data[at:].split()


def shingles(data: bytes, words: int) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """(joined words, starts, ends) of a text's shingles, a span at a time. A text of
    fewer words has one shingle, their sequence; one of no words has none."""
    carry, any_yet = [], False
    for span in word_spans(data.lower()):
        own = carry + span
        if len(own) < words:
            carry = own
            continue
        joined = b" ".join(own)
        ends = list(accumulate(map(len, own), lambda a, n: a + 1 + n))
        any_yet = True
        yield joined, [0, *(e + 1 for e in ends[: len(own) - words])], ends[words - 1 :]
        carry = own[len(own) - words + 1 :] if words > 1 else []
    if carry and not any_yet:
        joined = b" ".join(carry)
        yield joined, [0], [len(joined)]


def majority(hashed: Iterator[tuple[bytes, int]], size: int) -> bytes:
    """Of (hashes of ``size`` bytes each, how many): a bit is set where it is in over
    half of all."""
    counts, total = np.zeros(8 * size, np.int64), 0
    for digests, n in hashed:
        total += n
        bits = np.frombuffer(digests, np.uint8).reshape(n, size)
        for lo in range(0, n, 1 << 14):
            counts += np.unpackbits(bits[lo : lo + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > total).tobytes()


def fingerprint(data: bytes, words: int = WORDS) -> int:
    """SimHash of a text's word shingles, repeats included: a bit is set where it is in
    over half of the shingles' hashes. Fewer words: their sequence; none: zero."""
    digest = xxhash.xxh64_digest
    own = ((b"".join([digest(j[s:e], SEED) for s, e in zip(starts, ends, strict=True)]), len(starts)) for j, starts, ends in shingles(data, words))
    return int.from_bytes(majority(own, 8), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            fps = np.array([fingerprint(t.as_py().encode(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return keyed_text(docs).mapInArrow(run, "doc_id long, fp long")


def groups_needed(n: int, radius: int) -> int:
    """The k, two or more, of least cost a fingerprint: C(k + r, k) cells, each about as dear as 100
    comparisons, and the strangers in them (two random segments hold equal counts in 3
    of 8 cases)."""
    return min(range(2, 13), key=lambda k: comb(k + radius, k) * (100 + n * 0.375 ** (SEGMENTS * k / (k + radius))))


def embed(x: np.ndarray) -> np.ndarray:
    """Two-bit segments in unary: 0, 1 or 2 set bits as 00, 01 or 11."""
    odd, one = np.uint64(ODD), np.uint64(1)
    return ((x | (x >> one)) & odd) | (((x & (x >> one)) & odd) << one)


def cell_masks(k: int, radius: int) -> list[int]:
    """Signed 64-bit masks of the segments of each choice of k of k + radius groups."""
    m = k + radius
    edges = [round(i * SEGMENTS / m) for i in range(m + 1)]
    own = [sum(3 << (2 * s) for s in range(edges[i], edges[i + 1])) for i in range(m)]
    masks = [sum(own[i] for i in c) for c in combinations(range(m), k)]
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def forest(x: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints within ``radius``: breadth-first,
    each member compared once with those not yet reached."""
    t, out = embed(x), []
    left = np.arange(len(x))
    while len(left):
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            reached = np.zeros(len(left), bool)
            for lo in range(0, len(frontier), 64):
                part, rest = frontier[lo : lo + 64], np.flatnonzero(~reached)
                i, j = np.nonzero(np.bitwise_count(t[part][:, None] ^ t[left[rest]][None, :]) <= radius)
                ok = np.bitwise_count(x[part[i]] ^ x[left[rest[j]]]) <= radius
                j, first = np.unique(rest[j[ok]], return_index=True)
                out += zip(part[i[ok][first]].tolist(), left[j].tolist(), strict=True)
                reached[j] = True
            frontier, left = left[reached], left[~reached]
    return out


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints ``fp`` that connect exactly
    what is within ``radius``: a spanning forest for each cell or pair of blocks."""
    own = classes.select("fp")
    masks = cell_masks(groups_needed(own.count(), radius), radius)
    x, half = F.col("fp"), F.shiftrightunsigned("fp", 1)
    odd = F.lit(ODD)
    unary = x.bitwiseOR(half).bitwiseAND(odd).bitwiseOR(F.shiftleft(x.bitwiseAND(half).bitwiseAND(odd), 1))
    named = own.select("fp", unary.alias("t"))
    cells = named.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("t").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])).alias("cell"))
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    block = F.pmod(F.xxhash64(F.lit("block"), "fp"), F.col("blocks")).cast("int")
    dealt = cells.join(sizes, "cell").withColumn("own", block)
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda c: F.struct(F.least("own", c).alias("i"), F.greatest("own", c).alias("j")))
    lists = dealt.select("fp", "cell", F.inline(pairs)).groupBy("cell", "i", "j").agg(F.collect_list("fp").alias("fps"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=1024):
            col = batch.column(0)
            flat, off = col.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate(([0], np.cumsum(np.diff(col.offsets.to_numpy()))))
            size, a, b = np.diff(off), [], []
            todo = np.flatnonzero(size > 64).tolist()
            for s in np.unique(size[(size > 1) & (size <= 64)]):
                rows = np.flatnonzero(size == s)
                u, v = np.triu_indices(int(s), 1)
                for lo in range(0, len(rows), max(1, 500_000 // len(u))):
                    some = rows[lo : lo + max(1, 500_000 // len(u))]
                    x = flat[off[some][:, None] + np.arange(s)[None, :]]
                    t = embed(x)
                    near = np.bitwise_count(t[:, u] ^ t[:, v]) <= radius
                    g, p = np.nonzero(near)
                    ok = np.bitwise_count(x[g, u[p]] ^ x[g, v[p]]) <= radius
                    todo += some[np.unique(g[ok])].tolist()
            for g in todo:
                x = flat[off[g] : off[g + 1]]
                for i, j in forest(x, radius):
                    a.append(x[i])
                    b.append(x[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], ["a", "b"])

    return lists.select("fps").mapInArrow(verify, "a long, b long")


def simhash_groups(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs``."""
    fps = written(fingerprints(docs, words), "simhash")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "simhash-classes")
    total = classes.agg(F.sum("copies").alias("n")).first()["n"] or 1
    found = components(links(classes, radius))
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = spread_join(rooted, ids, "root", "n", total, "fp").select("fp", "component_id", "copies")
    return spread_join(fps, named, "fp", "copies", total, "doc_id").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 5) -> DataFrame:
    """One row of each group of near copies in ``docs``, with all its columns: the one of
    least key (null keys last), then of least digest of key and text; of rows equal in both
    any. Columns are taken by position, so clashing names are harmless; null texts count as
    empty; an empty table stays empty."""
    from .near_copies import near_copy_groups

    key, text = F.col(place_of(docs, "doc_id")), F.col(place_of(docs, "text"))
    rows = positional(docs)
    tagged = rows.withColumn("tag", row_key(key, text))
    order = F.struct(key.isNull().alias("n"), key.cast("long").alias("d"), F.col("tag").alias("t"))
    groups = near_copy_groups(tagged.select(F.col("tag").alias("doc_id"), text.alias("text")), words).distinct()
    keys = tagged.select(F.col("tag").alias("doc_id"), order.alias("key")).distinct()
    chosen = keys.join(groups, "doc_id").groupBy("component_id").agg(F.min("key").alias("key")).select(F.col("key.t").alias("tag"))
    return tagged.join(chosen, "tag", "left_semi").dropDuplicates(["tag"]).select(*rows.columns).toDF(*docs.columns)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, fingerprint, component_id."""
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
