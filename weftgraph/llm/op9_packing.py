"""Sequence packing by non-negative least squares (operator 9).

``cut`` encodes documents, appends the end id and cuts them at multiples of the
window; what is left over is shorter than the window. ``plan_packing`` enumerates
shallow combinations of length classes that fill a window, solves for repeat counts
x >= 0 with A x = histogram by least squares, rounds down and packs the residuals
greedily. ``assign`` deals the pieces to the planned sequences.

Only the histogram (one count for each of at most ``window / grain`` classes) and
the plan reach the driver: both have a fixed bound. A piece's place follows from
its rank in its class: a rank in its part, counted while the part is written, plus
the sum over earlier parts, so no class is ever gathered in one task.

Null text counts as empty; an empty text is the end id alone. Null keys and repeated
rows are packed like all others; the order of equal rows does not matter. An empty
table gives no pieces."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keyed_text, slices, table, written
from .wordcache import encoder

WINDOW = 2048
#: Width of a length class.
GRAIN = 8
#: Most pieces in an enumerated combination.
DEPTH = 3

PIECES = "part long, class int, rank long, doc_id long, start long, length long, doc_tokens long, ids binary"


def cut(docs: DataFrame, tokenizer: str, end_id: int, spaces: str = "drop", window: int = WINDOW, grain: int = GRAIN) -> DataFrame:
    """Pieces of whole documents, written once: ids as u32 little-endian bytes, the
    length class, and the rank of the piece among those of its part and class."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer, spaces, 4), np.array([end_id], "<u4").tobytes()
        part, ranks = TaskContext.get().partitionId(), np.zeros(window // grain + 1, np.int64)
        for batch in slices(batches, 1):
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(text.as_py()) + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    n = len(piece) // 4
                    c = -(-n // grain)
                    out.append((part, c, int(ranks[c]), key, start, n, total, piece))
                    ranks[c] += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "class", "rank", "doc_id", "start", "length", "doc_tokens", "ids"])

    return written(keyed_text(docs).mapInArrow(pieces, PIECES), "pieces")


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 2000) -> np.ndarray:
    """min ||a x - b|| over x >= 0, by the active-set method: columns enter while
    their gradient is positive and leave when a step would make them negative."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tol = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(steps):
        w = a.T @ (b - a @ x)
        w[passive] = 0
        j = int(np.argmax(w))
        if w[j] <= tol:
            break
        passive[j] = True
        while True:
            cols = np.flatnonzero(passive)
            s = np.linalg.lstsq(a[:, cols], b, rcond=None)[0]
            if (s > 0).all():
                break
            old = x[cols]
            low = s <= 0
            step = float(np.min(old[low] / np.maximum(old[low] - s[low], 1e-300)))
            x[cols] = np.maximum(old + step * (s - old), 0)
            passive[cols[low & (x[cols] <= tol)]] = False
            passive[cols[np.argmin(np.where(low, x[cols], np.inf))]] = False
            x[~passive] = 0
        x[:] = 0
        x[cols] = s
    return x


def plan_packing(counts: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(classes of a sequence, how many such sequences), using up ``counts`` exactly.

    ``counts[c]`` pieces need c units each; a window has ``len(counts) - 1`` units."""
    units = len(counts) - 1
    left = counts.astype(np.int64).copy()
    plan = [((units,), int(left[units]))] if left[units] else []
    left[units] = 0
    have = [c for c in range(1, units) if left[c]]
    known = set(have)
    combos = []
    for k in range(2, depth + 1):
        for head in combinations_with_replacement(have, k - 1):
            last = units - sum(head)
            if last >= head[-1] and last in known:
                combos.append((*head, last))
    if combos:
        a = np.zeros((units + 1, len(combos)))
        for j, combo in enumerate(combos):
            for c in combo:
                a[c, j] += 1
        x = nnls(a, left.astype(float))
        for j in np.argsort(-x, kind="stable"):
            use = a[:, j].astype(np.int64)
            need = use > 0
            if x[j] < 1:
                break
            times = int(min(np.floor(x[j]), (left[need] // use[need]).min()))
            if times:
                left -= times * use
                plan.append((combos[j], times))
    while left.any():
        room, combo, rest = units, [], left.copy()
        while room:
            fit = np.flatnonzero(rest[: room + 1])
            if not len(fit):
                break
            c = int(fit[-1])
            k = min(int(rest[c]), room // c)
            combo += [c] * k
            rest[c] -= k
            room -= k * c
        use = np.bincount(combo, minlength=units + 1)
        times = int((left[use > 0] // use[use > 0]).min())
        left -= times * use
        plan.append((tuple(combo), times))
    return plan


def plan_slots(plan: list[tuple[tuple[int, ...], int]], units: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each class: first ranks of its slots, the slots' first sequence, and their
    place in the sequence. Rank r of slot s is in sequence first[s] + r - ranks[s]."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    ranks, base = np.zeros(units + 1, np.int64), 0
    for combo, times in plan:
        for place, c in enumerate(combo):
            slots.setdefault(c, []).append((int(ranks[c]), base, place))
            ranks[c] += times
        base += times
    return {c: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for c, rows in slots.items()}


def assign(pieces: DataFrame, window: int = WINDOW, grain: int = GRAIN) -> DataFrame:
    """Add sequence_id and the gapless offset in it to pieces with part, class, rank
    and length. Other columns ride along: leave wide ones out."""
    units = window // grain
    by_part = pieces.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n"))
    # One row per class and part; the histogram has at most `units` rows.
    by_part = written(by_part.withColumn("before", F.sum("n").over(Window.partitionBy("class").orderBy("part")) - F.col("n")), "classes")
    counts = np.zeros(units + 1, np.int64)
    for row in by_part.groupBy("class").agg(F.sum("n").alias("n")).collect():
        counts[row["class"]] = row["n"]
    slots = plan_slots(plan_packing(counts), units)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            seq, place = np.zeros(len(df), np.int64), np.zeros(len(df), np.int64)
            cls, rank = df["class"].to_numpy(), df["rank"].to_numpy() + df["before"].to_numpy()
            for c in np.unique(cls):
                at = np.flatnonzero(cls == c)
                first, base, where = slots[int(c)]
                s = np.searchsorted(first, rank[at], side="right") - 1
                seq[at], place[at] = base[s] + rank[at] - first[s], where[s]
            yield df.drop(columns=["before"]).assign(sequence_id=seq, place=place)

    joined = pieces.join(by_part.select("class", "part", "before"), ["class", "part"])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.drop("before").schema)
    dealt = joined.mapInPandas(deal, f"{kinds}, sequence_id long, place long")
    in_seq = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("offset", F.coalesce(F.sum("length").over(in_seq), F.lit(0)).cast("long"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens: one row per piece."""
    import public_tokenizers

    pieces = cut(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    narrow = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return assign(narrow).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
