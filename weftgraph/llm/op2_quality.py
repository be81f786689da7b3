"""Quality by compression (operator 2).

Two zstandard dictionaries are built from bad and from good labelled text. A text is
compressed in blocks under each; the classifier sees the normalised difference of the
compressed sizes (of the whole text, and of its worst block) and how far the text
shrinks at all, and a logistic calibration turns them into the probability of good.

The fit takes a bounded sample: at most ``SAMPLE`` labelled rows of each class, those
of least hash of key and text, with texts of at most ``SAMPLE_CHARS`` characters. Half of each makes the
dictionary, the other half the calibration, which is weighted to the classes' shares
over all labelled rows that may be learnt from. Scores read whole texts and nothing
else of a row.

Null text counts as empty; an empty text has a score like any other. Null keys and
repeated rows are kept. Labels without a text, null labels and repeated labels of a
key (of which the least counts) are harmless. With no text labelled with one of the
classes, every score is the share of good ones (0.5 with none)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_text, place_of, positional, sampled_texts, slices, table

#: Bounds of the labelled sample, for each class.
SAMPLE = 4000
SAMPLE_CHARS = 20_000
BLOCK = 512
LEVEL = 3
DICTIONARY = 112_640
FEATURES = 5
#: A class of fewer texts is not halved but cross-fitted, in so many folds.
FEW, FOLDS = 16, 5


@dataclass(frozen=True)
class Model:
    """Dictionaries (bad, good) and the calibration; plain bytes and numbers, some
    230 kB, so it ships with each task."""

    dictionaries: tuple[bytes, bytes] | None
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    share: float


def compressors(dictionaries: tuple[bytes, bytes]) -> list[zs.ZstdCompressor]:
    out = []
    for d in dictionaries:
        own = zs.ZstdCompressionDict(d)
        own.precompute_compress(level=LEVEL)
        out.append(zs.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def features(text: str, pair: list[zs.ZstdCompressor]) -> list[float]:
    data = text.encode() or b" "
    bad, good = (np.array([len(c.compress(data[i : i + BLOCK])) for i in range(0, len(data), BLOCK)], float) for c in pair)
    both = bad + good
    ratio = both.sum() / (2 * len(data))
    return [1.0, (bad.sum() - good.sum()) / both.sum(), ((bad - good) / both).min(), ratio, np.log(ratio)]


def calibrate(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.01) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted logistic regression by Newton's method on standardised features."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    mean[0], scale[0] = 0, 1
    a, b = (x - mean) / scale, np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(b)), a.T @ (w * (y - p)) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return mean, scale, b


def train(texts: tuple[list[str], list[str]], counts: tuple[int, int]) -> Model:
    """A model from sampled texts (bad, good) and the classes' counts over all rows."""
    share = counts[1] / max(1, sum(counts)) if sum(counts) else 0.5
    if not all(texts):
        return Model(None, (), (), (), share)
    halves = [(t[: len(t) // 2], t[len(t) // 2 :]) for t in texts]
    if any(len(t) < FEW for t in texts) or any(sum(map(len, _blocks(h[0]))) < 1000 for h in halves):
        dictionaries, seen = tuple(_dictionary(_blocks(t)) for t in texts), texts
        x, y = _cross_fitted(texts)
    else:
        dictionaries, seen = tuple(_dictionary(_blocks(h[0])) for h in halves), [h[1] for h in halves]
        pair = compressors(dictionaries)
        x = np.array([features(t, pair) for own in seen for t in own])
        y = np.concatenate([np.full(len(own), c) for c, own in enumerate(seen)])
    w = np.where(y == 1, counts[1] / len(seen[1]), counts[0] / len(seen[0]))
    mean, scale, b = calibrate(x, y, w)
    return Model(dictionaries, tuple(mean), tuple(scale), tuple(b), share)


def _blocks(texts: list[str]) -> list[bytes]:
    return [d[i : i + BLOCK] for t in texts if (d := t.encode()) for i in range(0, len(d), BLOCK)]


def _cross_fitted(texts: tuple[list[str], list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and classes of all texts, each under dictionaries without its own fold.
    How far a text shrinks is left out (its weight stays 0): texts that a dictionary was
    made of shrink far more, and would be judged by that."""
    x, y = [], []
    for k in range(FOLDS):
        rest = [[t for i, t in enumerate(own) if i % FOLDS != k] or own for own in texts]
        pair = compressors(tuple(_dictionary(_blocks(t)) for t in rest))
        for c, own in enumerate(texts):
            x += [[*features(t, pair)[:3], 0.0, 0.0] for t in own[k::FOLDS]]
            y += [c] * len(own[k::FOLDS])
    return np.array(x), np.array(y)


def _dictionary(blocks: list[bytes]) -> bytes:
    """A trained dictionary; samples too small to train on serve as raw content."""
    size = min(DICTIONARY, sum(map(len, blocks)) // 4)
    try:
        return zs.train_dictionary(size, blocks).as_bytes()
    except zs.ZstdError:
        return b"".join(blocks)[-size:]


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 3."""
    return F.crc32(F.encode(key.cast("string"), "UTF-8")) % 3


def fit(docs: DataFrame, labels: DataFrame, held_out: int | None = 1) -> Model:
    """Learn ``labels.quality`` from the rows whose fold is not ``held_out``."""
    own = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    if held_out is not None:
        own = own.where(fold(F.col("doc_id")) != held_out)
    counts = {r["quality"]: r["count"] for r in own.groupBy("quality").count().collect()}  # two rows
    rows = keyed_text(docs).where(F.length("text").between(1, SAMPLE_CHARS)).withColumn("h", F.xxhash64("doc_id", "text"))
    marked = rows.select("doc_id", "h").join(own, "doc_id").select(F.col("quality").alias("cls"), "h")  # no texts move
    texts = sampled_texts(marked, rows.select("h", "text"), SAMPLE, counts)
    return train((texts.get(0, []), texts.get(1, [])), (counts.get(0, 0), counts.get(1, 0)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, whole text and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = compressors(model.dictionaries) if model.dictionaries else None
        for batch in slices(batches, 1):
            if pair:
                x = np.array([features(t.as_py(), pair) for t in batch.column(1)]).reshape(-1, FEATURES)
                z = ((x - np.array(model.mean)) / np.array(model.scale)) @ np.array(model.weights)
                s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            else:
                s = np.full(batch.num_rows, model.share)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], ["doc_id", "text", "score"])

    return keyed_text(docs).mapInArrow(run, "doc_id long, text string, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``threshold`` or more. Null
    texts score as empty ones, repeated rows alike; columns are taken by position, so
    clashing names are harmless; an empty table stays empty."""
    at = int(place_of(docs, "text")[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = compressors(model.dictionaries) if model.dictionaries else None
        for batch in slices(batches, at):
            if pair:
                x = np.array([features(t.as_py() or "", pair) for t in batch.column(at)]).reshape(-1, FEATURES)
                z = ((x - np.array(model.mean)) / np.array(model.scale)) @ np.array(model.weights)
                keep = 1 / (1 + np.exp(-np.clip(z, -30, 30))) >= threshold
            else:
                keep = np.full(batch.num_rows, True)
            yield batch.filter(pa.array(keep))

    rows = positional(docs)
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
