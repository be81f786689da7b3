"""Progressive JPEG in numpy: coefficient arrays in, scans out, and back to RGB.

The decoder takes Huffman-coded progressive files (SOF2, 8 bits, one or three
components, sampling factors up to 4, restart intervals): each scan adds its band of
coefficients (spectral selection) or its next bit of them (successive approximation)
to the components' coefficient arrays. Scans in which every coefficient has a fixed
width are read as whole arrays; all others bit by bit."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Natural position of each zigzag index (fixed value of the format, by its rule:
#: antidiagonals, every other one upwards).
ZIGZAG = np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])


def _basis() -> np.ndarray:
    """64 x 64: a row of zigzag coefficients times this is a block's samples."""
    k = np.arange(8)
    c = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)[:, None]
    return np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)[ZIGZAG].astype(np.float32)


BASIS = _basis()


def _marker(code: int, body: bytes) -> bytes:
    return bytes([0xFF, code]) + (len(body) + 2).to_bytes(2, "big") + body


def _dht(kind: int, symbols: list[int], length: int) -> bytes:
    return bytes([kind]) + bytes(len(symbols) if n == length else 0 for n in range(1, 17)) + bytes(symbols)


def _stuffed(bits: np.ndarray) -> bytes:
    pad = -len(bits) % 8
    return np.packbits(np.concatenate((bits, np.ones(pad, np.uint8)))).tobytes().replace(b"\xff", b"\xff\x00")


def _sos(components: list[tuple[int, int]], band: tuple[int, int], high: int, low: int) -> bytes:
    return _marker(0xDA, bytes([len(components)]) + b"".join(bytes([c, t]) for c, t in components) + bytes([*band, high << 4 | low]))


def _dc_first(dc: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Bits of interleaved differences; dc: (MCU, blocks), sizes: blocks by component."""
    cuts = np.cumsum([0, *sizes])
    diff = np.concatenate([np.diff(dc[:, a:b].ravel(), prepend=0).reshape(-1, b - a) for a, b in zip(cuts, cuts[1:], strict=False)], axis=1).ravel()
    size = np.ceil(np.log2(np.abs(diff) + 1)).astype(np.int64)
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    value, width = (size << size) | extra, 4 + size
    k = np.arange(16)
    return ((value[:, None] >> np.maximum(width[:, None] - 1 - k, 0)) & 1)[k < width[:, None]].astype(np.uint8)


def _refine_bits(low: np.ndarray) -> np.ndarray:
    """Correction bits of blocks whose coefficients are all known, in end-of-band runs."""
    out = []
    for at in range(0, len(low), 32767):
        part = low[at : at + 32767]
        n = len(part).bit_length() - 1
        head = (n << n) | (len(part) - (1 << n))
        out += [np.array([head >> (3 + n - i) & 1 for i in range(4 + n)], np.uint8), part.ravel().astype(np.uint8)]
    return np.concatenate(out)


def encode_420(blocks: np.ndarray, rows: int, cols: int, quantizer: int = 1, bands: tuple[tuple[int, int], ...] = ((1, 2), (3, 63))) -> bytes:
    """A 4:2:0 progressive file from (rows * cols, 6, 64) quantized coefficients in zigzag
    order with magnitudes 128 to 255; they come back as they are.

    Scans: all bits but the last (differences of DC; AC by band, for which every
    symbol is the same), then the last bit (DC; AC)."""
    v = blocks.astype(np.int64)
    head = b"\xff\xd8" + _marker(0xDB, b"".join(bytes([i, *[quantizer] * 64]) for i in (0, 1)))
    size = (rows * 16).to_bytes(2, "big") + (cols * 16).to_bytes(2, "big")
    head += _marker(0xC2, b"\x08" + size + b"\x03\x01\x22\x00\x02\x11\x01\x03\x11\x01")
    head += _marker(0xC4, _dht(0x00, list(range(12)), 4) + _dht(0x10, [7], 1) + _dht(0x11, [n << 4 for n in range(15)], 4))
    every = [(1, 0), (2, 0), (3, 0)]
    out = [head, _sos(every, (0, 0), 0, 1), _stuffed(_dc_first(v[:, :, 0] >> 1, [4, 1, 1]))]
    mag = np.abs(v)
    top = np.where(v < 0, 127 - (mag >> 1), mag >> 1).astype(np.uint8)
    planes = [(1, _raster), (2, lambda x, *_: x[:, 4]), (3, lambda x, *_: x[:, 5])]
    for a, b in bands:
        for c, pick in planes:
            out += [_sos([(c, 0)], (a, b), 0, 1), pick(top, rows, cols)[:, a : b + 1].tobytes()]
    out += [_sos(every, (0, 0), 1, 0), _stuffed((v[:, :, 0] & 1).astype(np.uint8).ravel())]
    low = (mag & 1).astype(np.uint8)
    for c, pick in planes:
        out += [_sos([(c, 1)], (1, 63), 1, 0), _stuffed(_refine_bits(pick(low, rows, cols)[:, 1:]))]
    return b"".join([*out, b"\xff\xd9"])


def _raster(x: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Luma blocks of each MCU (first four) in the component's raster order."""
    return x[:, :4].reshape(rows, cols, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)


def unraster(x: np.ndarray, rows: int, cols: int) -> np.ndarray:
    return x.reshape(rows, 2, cols, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 4, 64)


@lru_cache(maxsize=256)
def _table(counts: bytes, symbols: bytes) -> tuple[dict[tuple[int, int], int], int]:
    """{(length, code): symbol}, longest length."""
    out, code, at = {}, 0, 0
    for n in range(1, 17):
        for s in symbols[at : at + counts[n - 1]]:
            out[(n, code)] = s
            code += 1
        at += counts[n - 1]
        code <<= 1
    return out, max((n for n, _ in out), default=0)


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.acc, self.n = data, 0, 0, 0

    def get(self, n: int) -> int:
        while self.n < n:
            chunk = self.data[self.at : self.at + 4] or b"\xff"
            self.at += len(chunk)
            self.acc = (self.acc << (8 * len(chunk))) | int.from_bytes(chunk, "big")
            self.n += 8 * len(chunk)
        self.n -= n
        value = self.acc >> self.n
        self.acc &= (1 << self.n) - 1
        return value

    def symbol(self, table) -> int:
        codes, longest = table
        code = 0
        for n in range(1, longest + 1):
            code = code << 1 | self.get(1)
            if (n, code) in codes:
                return codes[(n, code)]
        raise ValueError("bad Huffman code")

    def signed(self, size: int) -> int:
        if not size:
            return 0
        x = self.get(size)
        return x if x >> (size - 1) else x - (1 << size) + 1


class _Component:
    def __init__(self, ident: int, h: int, v: int, q: int):
        self.ident, self.h, self.v, self.q = ident, h, v, q


def _ac_first_flat(data: bytes, coef: np.ndarray, band: tuple[int, int], low: int, table) -> bool:
    """A scan whose table has one symbol without run: fixed width, read at once."""
    codes, _ = table
    if len(codes) != 1 or next(iter(codes)) != (1, 0) or not 0 < (size := codes[(1, 0)]) < 16:
        return False
    n = len(coef) * (band[1] - band[0] + 1)
    if len(data) * 8 < n * (1 + size):
        return False
    if size == 7:
        raw = np.frombuffer(data, np.uint8, n).astype(np.int16)
    else:
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * (1 + size)).reshape(n, 1 + size)
        raw = bits.astype(np.int32) @ (1 << np.arange(size, -1, -1))
    if (raw >> size).any():
        return False
    value = np.where(raw >> (size - 1), raw, raw - (1 << size) + 1) * (1 << low)
    coef[:, band[0] : band[1] + 1] = value.reshape(len(coef), -1)
    return True


def _ac_refine_flat(data: bytes, coef: np.ndarray, band: tuple[int, int], low: int, table) -> bool:
    """A scan over known coefficients alone: end-of-band runs and correction bits."""
    own = coef[:, band[0] : band[1] + 1]
    if not own.all():
        return False
    bits, at, done, width = np.unpackbits(np.frombuffer(data, np.uint8)), 0, 0, own.shape[1]
    add = np.empty(own.shape, np.uint8)
    while done < len(own):
        code, n, symbol = 0, 0, None
        while symbol is None and n < table[1]:
            code, n = code << 1 | int(bits[at + n]), n + 1
            symbol = table[0].get((n, code))
        if symbol is None or symbol & 15 or symbol >> 4 == 15:
            return False
        at, extra, run = at + n, symbol >> 4, 0
        for b in bits[at : at + extra]:
            run = run << 1 | int(b)
        at, run = at + extra, run + (1 << extra)
        add[done : done + run] = bits[at : at + run * width].reshape(run, width)
        at, done = at + run * width, done + run
    step = np.where(own < 0, -1, 1).astype(coef.dtype) * (1 << low)
    own += step * add
    return True


def _ac_first(bits: _Bits, coef: np.ndarray, order, band, low: int, table) -> None:
    run = 0
    for b in order:
        if run:
            run -= 1
            continue
        k = band[0]
        while k <= band[1]:
            rs = bits.symbol(table)
            r, s = rs >> 4, rs & 15
            if s:
                k += r
                coef[b, k] = bits.signed(s) * (1 << low)
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) + (bits.get(r) if r else 0) - 1
                break


def _ac_refine(bits: _Bits, coef: np.ndarray, order, band, low: int, table) -> None:
    run, one = 0, 1 << low

    def correct(b: int, k: int) -> None:
        if bits.get(1):
            coef[b, k] += one if coef[b, k] > 0 else -one

    for b in order:
        k = band[0]
        if not run:
            while k <= band[1]:
                rs = bits.symbol(table)
                r, s = rs >> 4, rs & 15
                new = 0
                if s:
                    new = one if bits.get(1) else -one
                elif r < 15:
                    run = (1 << r) + (bits.get(r) if r else 0)
                    break
                while k <= band[1]:
                    if coef[b, k]:
                        correct(b, k)
                    elif r:
                        r -= 1
                    else:
                        if new:
                            coef[b, k] = new
                        k += 1
                        break
                    k += 1
        if run:
            for j in range(k, band[1] + 1):
                if coef[b, j]:
                    correct(b, j)
            run -= 1


def decode(data: bytes, fast: bool = True) -> tuple[list[np.ndarray], dict]:
    """Coefficients of each component, (block rows, block columns, 64) in zigzag order
    padded to whole MCUs, and the frame: width, height, components, quantizers."""
    at, tables, quant, frame, restart = 2, {}, {}, {}, 0
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    coefs: list[np.ndarray] = []
    while at < len(data):
        code = data[at + 1]
        if code == 0xD9:
            break
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if code == 0xDB:
            while body:
                wide = 128 if body[0] >> 4 else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + wide], ">u2" if wide == 128 else "u1").astype(np.float32)
                body = body[1 + wide :]
        elif code == 0xC4:
            while body:
                total = sum(body[1:17])
                tables[body[0]] = _table(bytes(body[1:17]), bytes(body[17 : 17 + total]))
                body = body[17 + total :]
        elif code == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif code == 0xC2:
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            comps = [_Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
            hm, vm = max(c.h for c in comps), max(c.v for c in comps)
            mx, my = -(-width // (8 * hm)), -(-height // (8 * vm))
            frame = {"width": width, "height": height, "components": comps, "quant": quant, "hm": hm, "vm": vm, "mx": mx, "my": my}
            coefs = [np.zeros((my * c.v * mx * c.h, 64), np.int16) for c in comps]
            for c in comps:  # blocks that a scan of this component alone has
                c.across, c.down = -(-(-(-width * c.h // hm)) // 8), -(-(-(-height * c.v // vm)) // 8)
        elif code == 0xDA:
            if not frame:
                raise ValueError("only progressive files")
            picked = [(next(i for i, c in enumerate(frame["components"]) if c.ident == body[j]), body[j + 1]) for j in range(1, 1 + 2 * body[0], 2)]
            band, (high, low) = (body[-3], body[-2]), divmod(body[-1], 16)
            end = at
            while True:
                end = data.index(b"\xff", end)
                if data[end + 1] and not 0xD0 <= data[end + 1] <= 0xD7:
                    break
                end += 2
            _scan(data[at:end], frame, coefs, picked, band, high, low, tables, restart, fast)
            at = end
    return [x.reshape(frame["my"] * c.v, frame["mx"] * c.h, 64) for x, c in zip(coefs, frame["components"], strict=True)], frame


def _scan(raw: bytes, frame: dict, coefs, picked, band, high: int, low: int, tables, restart: int, fast: bool) -> None:
    comps = frame["components"]
    parts, start = [], 0
    if restart:
        at = raw.find(b"\xff")
        while at >= 0:
            if raw[at + 1]:
                parts.append(raw[start:at])
                start = at + 2
            at = raw.find(b"\xff", at + 2)
    parts = [p.replace(b"\xff\x00", b"\xff") for p in [*parts, raw[start:]]]
    if len(picked) == 1:
        i, c = picked[0][0], comps[picked[0][0]]
        wide = frame["mx"] * c.h
        whole = c.across == wide and c.down == frame["my"] * c.v
        units = [[(0, y * wide + x)] for y in range(c.down) for x in range(c.across)] if not (fast and whole and band[0]) else None
        if units is None and not restart:
            reader = _ac_refine_flat if high else _ac_first_flat
            if reader(parts[0], coefs[i], band, low, tables[0x10 | picked[0][1] & 15]):
                return
        if units is None:
            units = [[(0, y * wide + x)] for y in range(c.down) for x in range(c.across)]
    else:
        units = [[(j, (my * comps[i].v + v) * frame["mx"] * comps[i].h + mx * comps[i].h + h) for j, (i, _) in enumerate(picked) for v in range(comps[i].v) for h in range(comps[i].h)] for my in range(frame["my"]) for mx in range(frame["mx"])]
    each = restart or len(units)
    for p, lo in enumerate(range(0, len(units), each)):
        own, bits = units[lo : lo + each], _Bits(parts[p])
        if band[0]:
            i, t = picked[0]
            (_ac_refine if high else _ac_first)(bits, coefs[i], [u[0][1] for u in own], band, low, tables[0x10 | t & 15])
            continue
        last = [0] * len(picked)
        dc = [tables.get(t >> 4) for _, t in picked]
        for unit in own:
            for j, b in unit:
                if high:
                    coefs[picked[j][0]][b, 0] |= bits.get(1) << low
                else:
                    last[j] += bits.signed(bits.symbol(dc[j]))
                    coefs[picked[j][0]][b, 0] = last[j] << low


def to_rgb(coefs: list[np.ndarray], frame: dict) -> np.ndarray:
    """(height, width, 3) samples: dequantize, inverse-transform, upsample, convert."""
    planes = []
    for x, c in zip(coefs, frame["components"], strict=True):
        r, k, _ = x.shape
        samples = (x.reshape(-1, 64).astype(np.float32) * frame["quant"][c.q]) @ BASIS + 128
        plane = np.clip(np.rint(samples), 0, 255).reshape(r, k, 8, 8).transpose(0, 2, 1, 3).reshape(r * 8, k * 8)
        plane = plane.repeat(frame["vm"] // c.v, axis=0).repeat(frame["hm"] // c.h, axis=1)
        planes.append(plane[: frame["height"], : frame["width"]])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
    y, cb, cr = planes
    cb, cr = cb - 128, cr - 128
    out = np.empty((*y.shape, 3), np.uint8)
    for i, p in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
        out[:, :, i] = np.clip(np.rint(p), 0, 255)
    return out
