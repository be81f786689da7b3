"""Media columns: progressive JPEG (operator 10).

``encode_media`` stores bytes without loss in a progressive 4:2:0 file: a byte is a
quantized coefficient of magnitude 128 + its low seven bits, negative if its top bit
is set. Of the seven, bits 0 and 5 change places, and the new bit 0 is negated: the last
scans hold the magnitudes' low bit, and as bit 5 is nearly always set in text, they are
nearly all zeros. ``decode_media``
accumulates the file's scans into coefficient arrays, gives the payload back,
inverse-transforms in numpy, upsamples chroma and returns the full-resolution RGB tensor.
``features`` describes tensors. The query stores files and tensors, and reads both back.

The quantizers are 255: coefficients of this size saturate most samples whatever the
quantizer, and saturated tensors take a quarter of the disk of others.

Null text counts as empty; the payload is at least one unit of 192 bytes. Null keys
and repeated rows are kept, equal texts give equal files. A null file decodes to
nulls, and a null tensor has a null feature. An empty table gives no rows. One row's
arrays are in memory at a time, some 50 times its text; a batch is bounded by bytes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jpeg
from .common import keyed_text, schema_of, slices, table, written

UNIT = 192
MCU = 384
QUANTIZER = 255
#: A byte with bits 0 and 5 exchanged and the new bit 0 negated, and the way back.
SWAPPED = np.array([b & 0xDE | (b & 1) << 5 | ~b >> 5 & 1 for b in range(256)], np.uint8)
BACK = np.argsort(SWAPPED).astype(np.uint8)


def payload_of(text: bytes) -> bytes:
    return text + b" " * (-len(text) % UNIT or (UNIT if not text else 0))


def encode_payload(payload: bytes) -> bytes:
    """A file whose first coefficients are the payload, in the rectangle that wastes least
    of those at most four times as wide as high; the MCUs that complete the
    rectangle repeat a blank. A comment holds the payload's length."""
    n = -(-len(payload) // MCU)
    root = math.isqrt(n - 1) + 1
    rows, cols = min(((-(-n // c), c) for c in range(min(root, 4095), min(2 * root, 4095) + 1)), key=lambda rc: (rc[0] * rc[1], rc[1]))
    if rows > 4095:
        raise ValueError("payload beyond the format's largest frame")
    b = np.full(rows * cols * MCU, 32, np.uint8)
    b[: len(payload)] = np.frombuffer(payload, np.uint8)
    b = SWAPPED[b]
    mag = 128 + (b & 127).astype(np.int16)
    out = jpeg.encode_420(np.where(b >> 7, -mag, mag).reshape(-1, 6, 64), rows, cols, QUANTIZER)
    return out[:2] + b"\xff\xfe\x00\x0a" + len(payload).to_bytes(8, "big") + out[2:]


def payload_from(data: bytes, coefs: list[np.ndarray]) -> bytes:
    rows, cols = coefs[1].shape[:2]
    v = np.concatenate([jpeg.unraster(coefs[0], rows, cols), coefs[1].reshape(-1, 1, 64), coefs[2].reshape(-1, 1, 64)], axis=1)
    b = ((np.abs(v) & 127) | ((v < 0).astype(np.int16) << 7)).astype(np.uint8)
    return BACK[b].tobytes()[: int.from_bytes(data[6:14], "big")]


def feature(rgb: np.ndarray) -> str:
    """Size, mean of each channel, and which of 8 x 8 cells are lighter than the mean."""
    h, w, _ = rgb.shape
    sums = rgb.sum(axis=(0, 1), dtype=np.int64)
    cells = np.add.reduceat(np.add.reduceat(rgb.sum(axis=2, dtype=np.int64), np.arange(8) * h // 8, axis=0), np.arange(8) * w // 8, axis=1)
    bits = np.packbits((cells.ravel() * 64 > cells.sum()).astype(np.uint8))
    return f"{w}x{h}:" + ",".join(str(int(s) // (h * w)) for s in sums) + ":" + bits.tobytes().hex()


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text), media (the file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            texts = [t.as_py().encode() for t in batch.column(1)]
            media = [encode_payload(payload_of(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return keyed_text(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decode_media(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media as they came, with payload, height, width and the RGB
    tensor (height x width x 3 bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2, 64):
            out = []
            for x in part.column(2):
                if not x.is_valid:
                    out.append((None,) * 4)
                    continue
                data = x.as_py()
                coefs, frame = jpeg.decode(data)
                out.append((payload_from(data, coefs), frame["height"], frame["width"], jpeg.to_rgb(coefs, frame).tobytes()))
            kinds = (pa.binary(), pa.int32(), pa.int32(), pa.binary())
            new = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, *new], ["doc_id", "n_bytes", "media", "payload", "height", "width", "rgb"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, height int, width int, rgb binary")


def features(tensors: DataFrame) -> DataFrame:
    """The rows with ``feature`` in place of their tensor (height, width, rgb)."""
    kept = [c for c in tensors.columns if c not in ("height", "width", "rgb")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, len(kept) + 2):
            out = []
            for h, w, x in zip(part.column(len(kept)).to_pylist(), part.column(len(kept) + 1).to_pylist(), part.column(len(kept) + 2), strict=True):
                out.append(feature(np.frombuffer(x.as_buffer(), np.uint8).reshape(h, w, 3)) if x.is_valid else None)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(out, pa.string())], [*kept, "feature"])

    kinds = ", ".join(schema_of(tensors, c) for c in kept)
    return tensors.select(*kept, "height", "width", "rgb").mapInArrow(run, kinds + ", feature string")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as progressive files, decoded to stored tensors, both read
    back and digested."""
    stored = written(encode_media(table(spark, sf_dir, "documents")), "media", level=6)
    back = decode_media(stored)
    tensors = back.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "height",
        "width",
        "rgb",
    )
    return features(written(tensors, "tensors", level=6))
