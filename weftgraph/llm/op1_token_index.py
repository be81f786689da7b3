"""Token-id binary output with a minimal perfect hash index (operator 1).

``write_index`` encodes documents in ascending key order and writes raw token ids
as self-describing shard files, and a manifest of their key ranges in that order;
``read_index`` scans the files and ``lookup`` gives keyed access. A shard file holds one
shard (all numbers little-endian):

    magic "WTIX", u32 id width in bytes, u32 part, u32 null keys, u64 n documents,
    u64 n ids, u64 ids of the part before this shard, i64 least key, i64 greatest key,
    i32 seeds[n], u32 fingerprints[n], u64 offsets[n], u64 lengths[n]   (hash slots)
    i64 keys[n], u8 null[n], u32 occurrence[n]                          (file order)
    payload: n ids x width bytes, and the writer's closing line end.

The manifest (path, least and greatest key, null keys of each shard) leads a key to its
shard: no other is opened. There it hashes to a bucket, the bucket's seed sends it to a
slot of its own, the slot's stored fingerprint rejects strangers, and the slot gives
offset and length: constant time whatever the shard's size, and a shard is bounded. The files are written by Spark's own text
writer (bytes pass through unchanged), so any file system that Spark can reach will
do and its commit protocol leaves whole shards only, whatever executors are lost.

Null text counts as empty; empty text has the end id alone. A null key is a key of
its own, before all others. Repeated keys are told apart by their occurrence number
in the shard, in order of a hash of the text; equal rows are interchangeable. An
empty table writes no shard and reads back as no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, keyed_text, slices, table, written
from .wordcache import encoder

#: A shard is closed once it holds this many ids.
SHARD_IDS = 4_000_000
MAGIC = b"WTIX"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
HEAD = 4 + 12 + 24 + 16


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_hash(keys: np.ndarray, null: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        salt = mix(occurrence.astype(np.uint64) * np.uint64(2) + null.astype(np.uint64))
        return mix(keys.astype(np.int64).view(np.uint64) + GOLDEN * (salt + np.uint64(1)))


def _slot(h: np.ndarray, seed, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(h + np.asarray(seed, dtype=np.uint64) * GOLDEN) % np.uint64(n)).astype(np.int64)


def fingerprint(h: np.ndarray) -> np.ndarray:
    return (mix(h ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


def build_mph(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds by bucket and the slot of each of n distinct hashes, a permutation.

    Buckets of two or more try seeds until all their slots are free, largest buckets
    first; single keys then take the free slots outright (seed -1 - slot)."""
    n = len(h)
    seeds, slots = np.zeros(n, np.int32), np.zeros(n, np.int64)
    taken = np.zeros(n, bool)
    bucket = (h % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    own, first, count = np.unique(bucket[order], return_index=True, return_counts=True)
    for b in np.argsort(-count, kind="stable"):
        if count[b] == 1:
            break
        rows = order[first[b] : first[b] + count[b]]
        for seed in range(1, 2**31 - 1):
            s = _slot(h[rows], seed, n)
            if not taken[s].any() and len(set(s.tolist())) == len(s):
                break
        seeds[own[b]], slots[rows] = seed, s
        taken[s] = True
    single = order[first[count == 1]]
    slots[single] = np.flatnonzero(~taken)
    seeds[bucket[single]] = -1 - slots[single]
    return seeds, slots


class Shard:
    """One shard's bytes, opened without copying."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a token shard")
        self.width, self.part, self.nulls = (int(x) for x in np.frombuffer(blob, "<u4", 3, 4))
        n, self.n_ids, self.before = (int(x) for x in np.frombuffer(blob, "<u8", 3, 16))
        self.least, self.greatest = (int(x) for x in np.frombuffer(blob, "<i8", 2, 40))
        at, self.n = HEAD, n
        if len(blob) == HEAD:  # the head alone, for a manifest
            return
        for name, kind in (("seeds", "<i4"), ("prints", "<u4"), ("offsets", "<u8"), ("lengths", "<u8"), ("keys", "<i8"), ("null", "u1"), ("occurrence", "<u4")):
            setattr(self, name, np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
        self.payload = np.frombuffer(blob, f"<u{self.width}", self.n_ids, at)

    def find(self, keys: np.ndarray, null: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for strangers."""
        h = key_hash(keys, null, occurrence)
        seed = self.seeds[(h % np.uint64(self.n)).astype(np.int64)]
        slot = np.where(seed < 0, -1 - seed.astype(np.int64), _slot(h, np.maximum(seed, 0), self.n))
        return np.where(self.prints[slot] == fingerprint(h), slot, -1)

    def holds(self, key: int, null: bool, occurrence: int) -> bool:
        """Whether the shard has so many of a key: keys stand in order, nulls first."""
        own = self.keys[self.nulls :]
        n = self.nulls if null else int(np.searchsorted(own, key, "right") - np.searchsorted(own, key, "left"))
        return occurrence < n

    def ids(self, slot: int) -> np.ndarray:
        at = int(self.offsets[slot])
        return self.payload[at : at + int(self.lengths[slot])]


def pack_shard(part: int, before: int, keys: list[int | None], payloads: list[bytes], width: int) -> bytes:
    n = len(keys)
    null = np.array([k is None for k in keys], np.uint8)
    key = np.array([0 if k is None else k for k in keys], np.int64)
    seen: dict = {}
    occurrence = np.zeros(n, np.uint32)
    for i, k in enumerate(keys):
        occurrence[i] = seen.get(k, 0)
        seen[k] = int(occurrence[i]) + 1
    h = key_hash(key, null, occurrence)
    seeds, slots = build_mph(h)
    length = np.array([len(p) // width for p in payloads], np.uint64)
    offset = np.concatenate(([0], np.cumsum(length)[:-1])).astype(np.uint64)
    prints, offsets, lengths = np.zeros(n, "<u4"), np.zeros(n, "<u8"), np.zeros(n, "<u8")
    prints[slots], offsets[slots], lengths[slots] = fingerprint(h), offset, length
    known = key[null == 0]
    ends = [known.min(), known.max()] if len(known) else [1, 0]
    head = MAGIC + np.array([width, part, int(null.sum())], "<u4").tobytes() + np.array([n, int(length.sum()), before], "<u8").tobytes() + np.array(ends, "<i8").tobytes()
    return b"".join([head, seeds.astype("<i4").tobytes(), prints.tobytes(), offsets.tobytes(), lengths.tobytes(), key.astype("<i8").tobytes(), null.tobytes(), occurrence.astype("<u4").tobytes(), *payloads])


def write_index(docs: DataFrame, tokenizer: str, path: str, end_id: int, spaces: str = "keep", width: int = 2, shard_ids: int = SHARD_IDS) -> None:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order and write the shards.

    Range partitions by (doc_id, hash of the text) split even one repeated key; each
    task holds one open shard."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer, spaces, width), np.array([end_id], f"<u{width}").tobytes()
        part, before, held, keys, payloads = TaskContext.get().partitionId(), 0, 0, [], []

        def close() -> pa.RecordBatch:
            nonlocal before, held, keys, payloads
            blob = pack_shard(part, before, keys, payloads, width)
            before, held, keys, payloads = before + held, 0, [], []
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["blob"])

        for batch in slices(batches, 1):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(text.as_py()) + end
                keys.append(key)
                payloads.append(ids)
                held += len(ids) // width
                if held >= shard_ids:
                    yield close()
        if keys:
            yield close()

    order = ["doc_id", F.xxhash64("text")]
    rows = keyed_text(docs).repartitionByRange(*order).sortWithinPartitions(*order)
    blobs = rows.mapInArrow(encode, "blob binary").select(F.col("blob").cast("string").alias("value"))
    blobs.write.option("maxRecordsPerFile", 1).option("compression", "none").text(f"{path}/shards")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [Shard(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([getattr(s, f) for s in own], pa.int64()) for f in ("least", "greatest", "nulls"))], ["path", "least", "greatest", "nulls"])

    found = _files(docs.sparkSession, f"{path}/shards").select("path", F.substring("content", 1, HEAD).alias("head"))
    # one row a shard, in order of keys, so that a look-up reads few pages of it
    found.mapInArrow(heads, "path string, least long, greatest long, nulls long").sort("least", "path").write.parquet(f"{path}/manifest")


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the index, looked up by key in its shard: part, doc_id,
    occurrence, at (ids of the part before it), n_tokens, ids (u32 little-endian)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=1):
            for blob in batch.column(0):
                shard = Shard(blob.as_buffer().to_pybytes())
                slots = shard.find(shard.keys, shard.null, shard.occurrence)
                if (slots < 0).any():
                    raise ValueError("a stored key does not match its fingerprint")
                for lo in range(0, shard.n, 1000):
                    s = slots[lo : lo + 1000]
                    keys = pa.array(shard.keys[lo : lo + 1000], pa.int64(), mask=shard.null[lo : lo + 1000].astype(bool))
                    at = pa.array(shard.offsets[s].astype(np.int64) + shard.before)
                    ids = pa.array([shard.ids(x).astype("<u4").tobytes() for x in s], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), shard.part)), keys, pa.array(shard.occurrence[lo : lo + 1000].astype(np.int64)), at, pa.array(shard.lengths[s].astype(np.int64)), ids], ["part", "doc_id", "occurrence", "at", "n_tokens", "ids"])

    return _files(spark, f"{path}/shards").select("content").mapInArrow(scan, "part long, doc_id long, occurrence long, at long, n_tokens long, ids binary")


def shards_of(spark: SparkSession, path: str, keys: list[int | None]) -> list[str]:
    """The files that may hold the keys, by the manifest."""
    known = sorted({k for k in keys if k is not None})
    wanted = F.lit(None in keys) & (F.col("nulls") > 0)
    if known:
        inside = F.exists(F.lit(np.array(known, np.int64)), lambda k: k.between(F.col("least"), F.col("greatest")))
        wanted |= F.col("least").isNotNull() & (F.col("least") <= known[-1]) & (F.col("greatest") >= known[0]) & inside
    return [r["path"] for r in spark.read.parquet(f"{path}/manifest").where(wanted).select("path").collect()]


def lookup(spark: SparkSession, path: str, keys: list[int | None]) -> DataFrame:
    """Keyed access: doc_id and ids (u32 little-endian) of a stated list of keys, by one
    constant-time probe of the index of each shard whose range has the key; other shards
    are not read. Unknown keys give no row, repeated keys one a document."""
    wanted = sorted(set(keys), key=lambda k: (k is not None, k or 0))
    key = np.array([k or 0 for k in wanted], np.int64)
    null = np.array([k is None for k in wanted], np.uint8)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=1):
            for blob in batch.column(0):
                shard = Shard(blob.as_buffer().to_pybytes())
                left, occurrence = np.arange(len(key)), 0
                while len(left):
                    slots = shard.find(key[left], null[left], np.full(len(left), occurrence))
                    ok = np.flatnonzero(slots >= 0)
                    # a stranger may share a slot's fingerprint: the stored key decides
                    ok = ok[[shard.holds(int(key[left[i]]), bool(null[left[i]]), occurrence) for i in ok]] if len(ok) else ok
                    left, slots = left[ok], slots[ok]
                    if len(left):
                        yield pa.RecordBatch.from_arrays([pa.array(key[left], pa.int64(), mask=null[left].astype(bool)), pa.array([shard.ids(x).astype("<u4").tobytes() for x in slots], pa.binary())], ["doc_id", "ids"])
                    occurrence += 1

    files = shards_of(spark, path, keys)
    if not files:
        return spark.createDataFrame([], "doc_id long, ids binary")
    return _files(spark, files).select("content").mapInArrow(probe, "doc_id long, ids binary")


def op1_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the written index: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    path = fresh_path(spark, "op1")
    write_index(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path, end_id=2)
    rows = read_index(spark, path).select("part", "doc_id", "at", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    rows = written(rows, "op1-rows")
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row per written part, whatever the number of documents.
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(before, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
