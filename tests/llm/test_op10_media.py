import hashlib
import zlib

import numpy as np
import pytest

from weftgraph.llm import jpeg
from weftgraph.llm import op10_media as op


def test_query_equals_brute_force(spark, sf_dir):
    rows = {}
    for r in op.op10_media(spark, sf_dir).collect():
        rows.setdefault(r.doc_id, []).append(r)
    n, seen = 0, {}
    files = {(r.doc_id, hashlib.sha256(r.media).hexdigest(), len(r.media)) for r in op.encode_media(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        p = op.payload_of((d.text or "").encode())
        assert len(p) % 192 == 0 and p
        r = next(r for r in rows[d.doc_id] if r.payload_sha256 == hashlib.sha256(p).hexdigest())
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len((d.text or "").encode()), len(p), zlib.crc32(p[-16:]))
        assert (d.doc_id, r.media_sha256, r.media_bytes) in files
        coefs, frame = jpeg.decode(op.encode_payload(p))
        assert r.feature == op.feature(jpeg.to_rgb(coefs, frame))
        assert seen.setdefault(p, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
        n += 1
    assert n == sum(map(len, rows.values()))


def test_every_byte_round_trips_on_both_paths():
    rng = np.random.default_rng(2)
    for n in (192, 384, 576, 192 * 37, 192 * 2100):
        payload = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        data = op.encode_payload(payload)
        coefs, frame = jpeg.decode(data)
        assert op.payload_from(data, coefs) == payload
        if n < 10_000:
            slow, _ = jpeg.decode(data, fast=False)
            assert all((a == b).all() for a, b in zip(coefs, slow, strict=True))
        rgb = jpeg.to_rgb(coefs, frame)
        assert rgb.shape == (frame["height"], frame["width"], 3)


def sparse_file(blocks, width, height, restart=0):
    """A scalar grey progressive encoder: DC and AC, first to bit 1, then bit 0."""
    bits = []

    def put(v, n):
        bits.extend(v >> (n - 1 - i) & 1 for i in range(n))

    def sym(s):  # every symbol has an 8-bit code, in order, 0 to 254
        put(s, 8)

    def flush():
        out = jpeg._stuffed(np.array(bits, np.uint8))
        bits.clear()
        return out

    def mag(v):
        n = abs(v).bit_length()
        return n, v if v > 0 else v + (1 << n) - 1

    def scan(head, each):
        out = [jpeg._sos([(1, 0)], *head)]
        for i, b in enumerate(blocks):
            if restart and i and i % restart == 0:
                out += [flush(), bytes([0xFF, 0xD0 + (i // restart - 1) % 8])]
            each(i, b)
        return b"".join([*out, flush()])

    last = [0]

    def dc(i, b):
        if restart and i % restart == 0:
            last[0] = 0
        d = (int(b[0]) >> 1) - last[0]
        last[0] += d
        n, x = mag(d) if d else (0, 0)
        sym(n)
        put(x, n)

    def half(v):
        return int(np.sign(v)) * (abs(int(v)) >> 1)

    def ac(i, b):
        run = 0
        for k in range(1, 64):
            v = half(b[k])
            if not v:
                run += 1
                continue
            while run > 15:
                sym(0xF0)
                run -= 16
            n, x = mag(v)
            sym(run << 4 | n)
            put(x, n)
            run = 0
        if run:
            sym(0)

    def fix(i, b):
        new = [k for k in range(1, 64) if b[k] and not half(b[k])]
        k, run, held = 1, 0, []
        while new and k <= new[-1]:
            if half(b[k]):
                held.append(abs(int(b[k])) & 1)
            elif b[k]:
                sym(run << 4 | 1)
                put(int(b[k] > 0), 1)
                bits.extend(held)
                run, held = 0, []
            else:
                if run == 15:
                    sym(0xF0)
                    bits.extend(held)
                    run, held = 0, []
                else:
                    run += 1
            k += 1
        if k <= 63:
            sym(0)
            bits.extend(held)
            bits.extend(abs(int(b[j])) & 1 for j in range(k, 64) if half(b[j]))

    out = b"\xff\xd8" + jpeg._marker(0xDB, b"\0" + b"\1" * 64)
    out += jpeg._marker(0xC2, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\x01\x01\x11\x00")
    out += jpeg._marker(0xC4, jpeg._dht(0x00, list(range(255)), 8) + jpeg._dht(0x10, list(range(255)), 8))
    if restart:
        out += jpeg._marker(0xDD, restart.to_bytes(2, "big"))
    out += scan(((0, 0), 0, 1), dc) + scan(((1, 63), 0, 1), ac) + scan(((0, 0), 1, 0), lambda i, b: put(int(b[0]) & 1, 1)) + scan(((1, 63), 1, 0), fix)
    return out + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 3])
def test_sparse_scans_are_accumulated_exactly(restart):
    rng = np.random.default_rng(4)
    blocks = rng.integers(-40, 41, (12, 64)) * (rng.random((12, 64)) < 0.25)
    coefs, frame = jpeg.decode(sparse_file(blocks, 30, 21, restart))
    assert (coefs[0].reshape(-1, 64) == blocks).all()
    assert jpeg.to_rgb(coefs, frame).shape == (21, 30, 3)


def test_inverse_transform():
    """A flat block and one cosine, against the definition."""
    x = np.zeros((1, 1, 64), np.int16)
    x[0, 0, 0], x[0, 0, 1] = 80, 50
    frame = {"components": [jpeg._Component(1, 1, 1, 0)], "quant": {0: np.ones(64, np.float32)}, "vm": 1, "hm": 1, "height": 8, "width": 8}
    want = 128 + 10 + 50 * np.sqrt(0.125) * 0.5 * np.cos((2 * np.arange(8) + 1) * np.pi / 16)
    assert (jpeg.to_rgb([x], frame)[:, :, 0] == np.rint(want)[None, :]).all()


def test_tensors_are_stored_and_read_back(spark, docs, tmp_path):
    op.decode_media(op.encode_media(docs)).select("doc_id", "payload", "height", "width", "rgb").write.parquet(f"{tmp_path}/t")
    for r in spark.read.parquet(f"{tmp_path}/t").collect():
        assert len(r.rgb) == 3 * r.height * r.width
        coefs, frame = jpeg.decode(op.encode_payload(bytes(r.payload)))
        assert bytes(r.rgb) == jpeg.to_rgb(coefs, frame).tobytes()


def test_empty_table_and_null_file(spark, empty):
    assert op.decode_media(op.encode_media(empty)).count() == 0
    row = op.decode_media(spark.createDataFrame([(1, 0, None)], "doc_id long, n_bytes long, media binary")).first()
    assert row.payload is None and row.rgb is None
    assert op.features(op.decode_media(spark.createDataFrame([(1, 0, None)], "doc_id long, n_bytes long, media binary"))).first().feature is None
