"""Groups of near copies by SimHash and exact verification (the pipeline's third stage).

Two texts are linked if the sets of their shingles' 64-bit hashes have a Jaccard
similarity of NUM / DEN or more; groups are the components of these links. Candidates come
from operator 7, its fingerprints of the same shingles and its grid join, and every one is
verified on whole sets. Fingerprints alone do not reach all pairs: at a similarity of 0.8
they lie some ten bits apart. So what shares rare shingles is verified too, by the prefix
filter of ``setjoin``, which is exact. Nothing is lost and nothing below is linked.

Within a list of texts that share a shingle, pairs are judged by bit maps first: a map has
a bit flipped for each shingle, so two maps differ in no more bits than the sets in
shingles. A pair whose maps differ in more than a ninth of both sizes is no near copy;
most others are. What then stands in a close pair is read again and compared on whole
sets in its block, which gives links that connect it and not all its pairs.

The order of shingles puts those that a sample of texts has seen often last; the sample
changes the lists that are compared, never the result.

Null text counts as empty; all texts without words are one node. Repeated rows are each
returned. An empty table gives no rows. Equal sets are one node, named by a 64-bit hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, picked, schema_of, slices, spread_join, written
from .op7_simhash import RADIUS, SEED, links, majority, shingles
from .components import components
from .setjoin import DEN, NUM, blocks, open_lists, partners, prefix_length, token_lists

WORDS = 5
#: One text in so many is sampled for the order, which has so many frequent shingles at most.
EVERY, FREQUENT = 8, 1 << 17
#: Bits of the map by which texts that take part in some pair are read again.
MAP = 1 << 23


def shingle_hashes(data: bytes, words: int = WORDS) -> list[int]:
    """The hashes of a text's shingles, repeats included."""
    digest = xxhash.xxh64_intdigest
    return [digest(j[s:e], SEED) for j, starts, ends in shingles(data, words) for s, e in zip(starts, ends, strict=True)]


def shingle_set(data: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    return np.unique(np.array(shingle_hashes(data, words), np.uint64))


def fingerprint_of(hashes: np.ndarray) -> int:
    """Operator 7's fingerprint of a text with these shingle hashes, as a signed number."""
    return int.from_bytes(majority(iter([(hashes.astype(">u8").tobytes(), len(hashes))] if len(hashes) else []), 8), "big", signed=True)


def bit_map(s: np.ndarray) -> np.ndarray:
    """A set's map: two bits a shingle or more, a power of two of 64-bit words."""
    words = 1 << max(0, (len(s) - 1) // 32).bit_length()
    bits = np.bincount((s % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(m: np.ndarray, words: int) -> np.ndarray:
    """The map of fewer words of the same set."""
    return np.bitwise_xor.reduce(m.reshape(-1, words), axis=0)


def close_pairs(nodes: np.ndarray, roots: np.ndarray, sizes: np.ndarray, own: np.ndarray | None, maps: list[np.ndarray], best: bool) -> list[tuple[int, int]]:
    """Pairs of nodes of different roots (and blocks ``own``, if given) whose sizes and
    maps allow the similarity; with ``best`` only the closest of each root a node."""
    out, words = [], np.array([len(m) for m in maps])
    for w in np.unique(words):
        x, y = np.flatnonzero(words == w), np.flatnonzero((words == w) | (words == 2 * w))
        small = np.stack([folded(maps[i], w) for i in y])
        for lo in range(0, len(x), 32):
            part = x[lo : lo + 32]
            differ = np.zeros((len(part), len(y)), np.int64)
            for k in range(0, w, 256):
                mine = np.stack([maps[i][k : k + 256] for i in part])
                differ += np.bitwise_count(mine[:, None, :] ^ small[None, :, k : k + 256]).sum(axis=2, dtype=np.int64)
            both = sizes[part][:, None] + sizes[y][None, :]
            ok = ((DEN + NUM) * differ <= (DEN - NUM) * both) & (roots[part][:, None] != roots[y][None, :])
            ok &= DEN * np.minimum(sizes[part][:, None], sizes[y][None, :]) >= NUM * np.maximum(sizes[part][:, None], sizes[y][None, :])
            if own is not None:
                ok &= own[part][:, None] != own[y][None, :]
            i, j = np.nonzero(ok)
            if best and len(i):
                order = np.lexsort((nodes[y[j]], differ[i, j], roots[y[j]], i))
                i, j = i[order], j[order]
                keep = np.concatenate(([True], (i[1:] != i[:-1]) | (roots[y[j[1:]]] != roots[y[j[:-1]]])))
                i, j = i[keep], j[keep]
            out += [(min(p, q), max(p, q)) for p, q in zip(nodes[part[i]].tolist(), nodes[y[j]].tolist(), strict=True)]
    return out


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets have the similarity that links."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return DEN * common >= NUM * (len(x) + len(y) - common)


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, whatever its type, text (null as empty) and a hash of the text."""
    return picked(docs, "doc_id", "text").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h"))


def frequent(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, counts) of the shingles that are frequent in a sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py().encode(), words).view(np.int64))], ["tok"])

    seen = _hashed(docs).where(F.pmod("h", F.lit(EVERY)) == 0).select("text").mapInArrow(run, "tok long")
    top = seen.groupBy("tok").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "tok").limit(FREQUENT).collect()
    toks, n = np.array([r["tok"] for r in top], np.int64).view(np.uint64), np.array([r["n"] for r in top], np.int64)
    order = np.argsort(toks)
    return toks[order], n[order]


def prefixes(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, h, node, n, fp, toks, map) of every row: hash of the text, hash and size of
    its set, its SimHash, the set's prefix and bit map."""
    hot, count = frequent(docs, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            nodes, sizes, fps, toks, maps = [], [], [], [], []
            for t in batch.column(1):
                own = np.array(shingle_hashes(t.as_py().encode(), words), np.uint64)
                s = np.unique(own)
                rank = np.zeros(len(s), np.int64)
                if len(hot) and len(s):
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    rank = np.where(hot[at] == s, count[at], 0)
                nodes.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                sizes.append(len(s))
                fps.append(fingerprint_of(own))
                maps.append(bit_map(s).tobytes())
                toks.append(s[np.argsort(rank, kind="stable")[: prefix_length(len(s))]])
            off = np.concatenate(([0], np.cumsum([len(p) for p in toks]))).astype(np.int32)
            flat = np.concatenate([*toks, np.zeros(0, np.uint64)]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(off), pa.array(flat))
            columns = [batch.column(0), batch.column(2), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), lists, pa.array(maps, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "node", "n", "fp", "toks", "map"])

    rows = _hashed(docs)
    return rows.mapInArrow(run, f"{schema_of(rows, 'doc_id')}, h long, node long, n int, fp long, toks array<bigint>, map binary")


def bits_of(wanted: DataFrame) -> list[np.ndarray]:
    """Two bit maps of one size, whatever the table's: of the values of ``h`` and of ``node``."""
    each = wanted.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.pmod(c, F.lit(MAP)).alias("bit")) for k, c in enumerate(("h", "node"))])))
    parts = each.groupBy("k", F.floor(F.col("bit") / 64).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).collect()
    bits = np.zeros((2, MAP // 64), np.int64)
    for r in parts:
        bits[r["k"], r["at"]] = r["bits"]
    return list(bits.view(np.uint64))


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, own binary) of the texts whose hashes ``wanted.h`` has, one row a node, and
    of a few others that the bit maps let pass. No text is shuffled, a set once; of equal
    texts a task reads one."""
    by_text, by_node = bits_of(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in slices(batches, 0):
            h = batch.column(1).to_numpy()
            at, own = h % MAP, {}
            for i in np.flatnonzero((by_text[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)):
                if h[i] not in done:
                    done.add(h[i])
                    s = shingle_set(batch.column(0)[int(i)].as_py().encode(), words).tobytes()
                    node = xxhash.xxh64_intdigest(s, SEED)
                    node -= node >> 63 << 64
                    if int(by_node[node % MAP // 64]) >> (node % MAP % 64) & 1:
                        own[node] = s
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.binary())], ["node", "own"])

    return _hashed(docs).select("text", "h").mapInArrow(run, "node long, own binary").dropDuplicates(["node"])


def likely(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """Those of the ``pairs`` (a, b) whose sizes and bit maps allow the similarity: exact,
    no similar pair is lost, and few sets are read for others. ``maps``: a row a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, m = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            x, y = ([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(k)] for k in (4, 5))
            least = [min(len(p), len(q)) for p, q in zip(x, y, strict=True)]
            near = DEN * np.minimum(n, m) >= NUM * np.maximum(n, m)
            differ = np.array([int(np.bitwise_count(folded(p, w) ^ folded(q, w)).sum()) if ok else 0 for p, q, w, ok in zip(x, y, least, near, strict=True)], np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(near & ((DEN + NUM) * differ <= (DEN - NUM) * (n + m))))

    one = pairs.join(maps.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("map").alias("x")), "a")
    both = one.join(maps.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("map").alias("y")), "b")
    return both.select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the ``pairs`` (a, b) of nodes whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ok = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def simhash_candidates(rows: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints are equal or linked: of each fingerprint's
    nodes with its least node, and of linked fingerprints' least nodes."""
    nodes = rows.select("fp", "node").distinct()
    classes = written(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    total = classes.agg(F.sum("n").alias("n")).first()["n"] or 1
    same = spread_join(nodes, classes, "fp", "n", total, "node").select(F.col("least").alias("a"), F.col("node").alias("b")).where("a <> b")
    near = links(classes.select("fp"), radius)
    x, y = classes.select(F.col("fp").alias("a"), F.col("least").alias("x")), classes.select(F.col("fp").alias("b"), F.col("least").alias("y"))
    return near.join(x, "a").join(y, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(same)


def connecting(roots: np.ndarray, own: np.ndarray | None, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Places of similar sets, fewer than there are sets: they connect the roots (of
    different blocks ``own``, if given) that any similar pairs connect."""
    every, label, out = np.arange(len(sets)), np.unique(roots, return_inverse=True)[1], []
    left = np.array(sorted(set(close_pairs(every, roots, np.array([len(s) for s in sets]), own, [bit_map(s) for s in sets], False))), np.int64).reshape(-1, 2)
    while len(left):
        for i, j in left[:64].tolist():
            if label[i] != label[j] and similar(sets[i], sets[j]):
                out.append((i, j))
                label[label == label[j]] = label[i]
        left = left[64:]
        left = left[label[left[:, 0]] != label[left[:, 1]]]
    return out


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """node, root, n, block (None within one block) and payload of each group of ``blocks``."""
    for batch in slices(batches, rows=256):
        for i, j, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            own = members.values
            node, root, n, block = (own.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            yield node, root, n.astype(np.int64), None if i == j else block, [np.frombuffer(m.as_buffer(), np.uint64) for m in own.field(4)]


def suspects(groups: DataFrame) -> DataFrame:
    """The nodes that are in a close pair of ``blocks`` whose payload is the bit map: no
    more rows than members, however many pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, root, n, block, maps in _members(batches):
            found = sorted({x for p in close_pairs(node, root, n, block, maps, False) for x in p})
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["node"])

    return groups.select("i", "j", "members").mapInArrow(run, "node long").distinct()


def joined(groups: DataFrame) -> DataFrame:
    """The connecting links (a, b) of ``blocks`` whose payload is the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, root, _, block, sets in _members(batches):
            found = [sorted((node[i], node[j])) for i, j in connecting(root, block, sets)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return groups.select("i", "j", "members").mapInArrow(run, "a long, b long").distinct()


def near_copy_groups(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id and component_id (the least key of the group) of every row of ``docs``."""
    wide = written(prefixes(docs, words), "shingles")
    rows = written(wide.select("doc_id", "h", "node"), "keys")
    maps = written(wide.select("node", "n", "map").dropDuplicates(["node"]), "maps")

    def sets(nodes: DataFrame) -> DataFrame:
        return sets_of(docs, rows.select("node", "h").join(nodes.distinct(), "node", "left_semi").groupBy("node").agg(F.min("h").alias("h")), words)

    lists = token_lists(wide.select("node", "n", "toks"))
    found = simhash_candidates(wide, radius).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = written(likely(found.unionByName(partners(lists)).distinct(), maps), "pairs")
    discard(wide)
    near = written(verified(pairs, sets(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))))), "links")
    discard(pairs)
    for whole in (False, True):
        # each block of a list by itself, which leaves few groups, then all against all
        opened = open_lists(lists.select("tok", "node", "n"), near)
        discard(lists)
        what = opened.select("node").distinct()
        near_maps = maps.join(what, "node", "left_semi").select("node", F.col("map").alias("what"))
        some = written(suspects(blocks(opened, near_maps, whole)), "suspects")
        few = opened.join(some, "node", "left_semi")
        near = near.unionByName(written(joined(blocks(few, sets(some).withColumnRenamed("own", "what"), whole)), "links"))
        discard(some)
        lists = opened
    discard(lists)
    discard(maps)
    found = components(near)
    least = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    roots = written(least.join(found, "node", "left").select("node", "least", "copies", F.coalesce("root", "node").alias("root")), "roots")
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("nodes"), F.sum("copies").alias("rows"))
    total = ids.agg(F.sum("rows").alias("rows")).first()["rows"] or 1
    named = spread_join(roots, ids.drop("rows"), "root", "nodes", total, "node").select("node", "component_id", "copies")
    return spread_join(rows.select("doc_id", "node"), named, "node", "copies", total, "doc_id").select("doc_id", "component_id")
