"""BPE encoding and decoding by speculation and verification (operator 8).

Speculate: greedy longest match proposes the tokens of every distinct word. Verify: a
sequence of tokens is what the merges give if every token is what the merges give for
its own string and every adjacent pair is compatible, that is, if no merge across
their border could have come before a merge inside them. All pairs of a batch are
tested at once, by undoing their latest merges step by step on arrays. Only words with
a failing token or pair undergo exact merging.

Normal forms, lower case and the split into words follow the tokenizer's file; plain
Latin text is split by its pattern here, other text by the library's normalizer and
pre-tokenizer. The strings of special tokens become those tokens wherever they stand,
as in the library.

Null text counts as empty and has no ids. Null keys and repeated rows are kept, an
empty table gives no rows. Whole texts are encoded; the cache of distinct chunks has
a fixed number of entries."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_text, slices, table
from .wordcache import BYTE_LEVEL, PLAIN

CACHE_ENTRIES = 400_000
_LOADED: dict[str, "SpeculativeBPE"] = {}


class Merges:
    """The merges on internal ids: symbols that no merge makes come first, then merge
    i makes symbol ``base + i``, so that ids are in order of precedence."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.suffix = suffix
        made = {a + b.removesuffix(suffix) + (suffix if b.endswith(suffix) else "") if suffix else a + b for a, b in merges}
        names = sorted((t for t in vocab if t not in made), key=vocab.__getitem__)
        self.base = len(names)
        own = {t: i for i, t in enumerate(names)}
        left, right = list(range(self.base)), list(range(self.base))
        self.rank: dict[tuple[int, int], int] = {}
        self.odd: set[int] = set()  # made by more than one merge: never speculated on
        for i, (a, b) in enumerate(merges):
            name = a + b
            pair = (own[a], own[b])
            if name in own:
                self.odd.add(own[name])
            own[name] = self.base + i
            left.append(pair[0])
            right.append(pair[1])
            names.append(name)
            self.rank[pair] = self.base + i
        self.own, self.names = own, names
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        keys = np.array([a << 32 | b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.array(list(self.rank.values()), np.int64)[order]
        self.vocab = np.array([vocab[n] for n in names], np.int64)
        # every beginning of a token, with the token that it is, or -1
        self.steps: dict[str, int] = {}
        for t, i in own.items():
            for k in range(1, len(t)):
                self.steps.setdefault(t[:k], -1)
            self.steps[t] = i
        self.sound: dict[int, bool] = {}

    def exact(self, symbols: list[int]) -> list[int]:
        """Merge the earliest pair, leftmost first, until none is left."""
        out = list(symbols)
        while len(out) > 1:
            first = min(((self.rank[p], i) for i, p in enumerate(zip(out, out[1:], strict=False)) if p in self.rank), default=None)
            if first is None:
                break
            made, i = first
            a, b, merged, i = out[i], out[i + 1], [], 0
            while i < len(out):
                if i + 1 < len(out) and out[i] == a and out[i + 1] == b:
                    merged.append(made)
                    i += 2
                else:
                    merged.append(out[i])
                    i += 1
            out = merged
        return out

    def exact_all(self, words: list[list[int]]) -> list[np.ndarray]:
        """``exact`` for many words at once. In a round every word merges all places
        of its earliest pair (a later merge can't come before the one it needs), and
        words without a pair leave."""
        size = np.array([len(w) for w in words], np.int64)
        flat = np.array([t for w in words for t in w], np.int64)
        owner, far = np.repeat(np.arange(len(words)), size), np.iinfo(np.int64).max
        done_owner, done = [], []
        while len(flat):
            rank = np.full(len(flat), far)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            key = flat[inner] << 32 | flat[inner + 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank[inner] = np.where(self.keys[at] == key, self.made[at], far)
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(flat))))
            over = least == far
            done_owner.append(owner[over])
            done.append(flat[over])
            hit = np.flatnonzero((rank == least) & ~over)
            if not len(hit):
                break
            # of places that overlap, every other one from the left
            first = np.concatenate(([True], np.diff(hit) != 1))
            hit = hit[(np.arange(len(hit)) - np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))) % 2 == 0]
            flat[hit] = least[hit]
            keep = ~over
            keep[hit + 1] = False
            flat, owner = flat[keep], owner[keep]
        if not done:
            return [np.zeros(0, np.int64) for _ in words]
        own, out = np.concatenate(done_owner), np.concatenate(done)
        order = np.argsort(own, kind="stable")
        return np.split(out[order], np.cumsum(np.bincount(own, minlength=len(words)))[:-1])

    def symbols(self, piece: str) -> list[int]:
        """Single characters, the last with the word's end mark."""
        own = self.own
        return [own[c] for c in piece[:-1] if c in own] + ([own[piece[-1] + self.suffix]] if piece[-1] + self.suffix in own else [])

    def greedy(self, piece: str) -> list[int] | None:
        """Longest match from the left: a walk along known beginnings of tokens, after a
        try of the whole rest. A token may not end inside the end mark."""
        text, out, at, steps = piece + self.suffix, [], 0, self.steps
        end = len(text)
        inner = end - len(self.suffix)
        while at < end:
            t = steps.get(text[at:], -1)
            if t >= 0:
                out.append(t)
                return out
            best, to = -1, at
            for k in range(at + 1, inner + 1):
                t = steps.get(text[at:k])
                if t is None:
                    break
                # with an end mark the last character stands with it alone
                if t >= 0 and (k < inner or not self.suffix):
                    best, to = t, k
            if best < 0:
                return None
            out.append(best)
            at = to
        return out

    def is_sound(self, t: int) -> bool:
        """Whether the merges give a token for its own string."""
        if t not in self.sound:
            name = self.names[t]
            whole = bool(self.suffix) and name.endswith(self.suffix)
            body = name.removesuffix(self.suffix) if whole else name
            parts = [self.own.get(c) for c in body]
            if whole:
                parts[-1:] = [self.own.get(body[-1] + self.suffix)]
            self.sound[t] = t not in self.odd and None not in parts and self.exact(parts) == [t]
        return self.sound[t]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of sound tokens whether the merges keep them apart."""
        ok, t1, t2 = np.ones(len(a), bool), a.copy(), b.copy()
        limit, live = np.full(len(a), np.iinfo(np.int64).max), np.arange(len(a))
        while len(live):
            x, y = t1[live], t2[live]
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            crossed = (self.keys[at] == key) & (self.made[at] < limit[live])
            ok[live[crossed]] = False
            live, x, y = live[~crossed], x[~crossed], y[~crossed]
            # undo the later of the two tokens' last merges; base symbols stay whole
            later_left = x > y
            can_left, can_right = x >= self.base, y >= self.base
            undo_left = np.where(later_left, can_left, can_left & ~can_right)
            undo_right = ~undo_left & can_right
            t1[live] = np.where(undo_left, self.right[x], x)
            t2[live] = np.where(undo_right, self.left[y], y)
            # a cross merge beats the left token's merge if it is earlier, the right
            # token's merge also if it is the same (the leftmost goes first)
            limit[live] = np.where(undo_left, x, y + 1)
            live = live[undo_left | undo_right]
        return ok


class SpeculativeBPE:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(path)
        model = spec["model"]
        self.merges = Merges(model["vocab"], [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]], model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"].get("pretokenizers", []) if p["type"] == "Split"]
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if len(splits) != 1 or "Lowercase" not in steps:
            raise ValueError("a tokenizer of words in lower case is needed")
        self.pattern = regex.compile(splits[0])
        n = max(max(model["vocab"].values(), default=0), max(self.special.values(), default=0)) + 1
        self.strings = [""] * n
        for t, i in [*model["vocab"].items(), *self.special.items()]:
            self.strings[i] = t
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.failed = self.proposed = 0

    def pieces(self, chunk: str) -> list[str]:
        """Words of a chunk without special tokens, in the byte-level alphabet."""
        end = chunk[-1:] in (".", ",")
        word = chunk[:-1] if end else chunk
        if word.isascii() and word.isalpha():  # one run of letters, its own byte-level form
            return [word.lower(), chunk[-1]] if end else [word.lower()]
        if PLAIN.fullmatch(chunk):
            return [p.encode().decode("latin-1").translate(BYTE_LEVEL) for p in self.pattern.findall(chunk.lower())]
        return [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(chunk))]

    def words(self, pieces: list[str]) -> dict[str, bytes]:
        """ids of distinct words: propose, verify all pairs at once, repair failures."""
        m = self.merges
        guess = [m.greedy(p) for p in pieces]
        flat = np.array([t for g in guess if g for t in g], np.int64)
        size = np.array([len(g) if g else 0 for g in guess], np.int64)
        good = size > 0
        if len(flat):
            owner = np.repeat(np.arange(len(pieces)), size)
            for t in np.unique(flat):
                if not m.is_sound(int(t)):
                    good[owner[flat == t]] = False
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            pair, back = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
            ok = m.compatible(pair >> 32, pair & 0xFFFFFFFF)
            good[owner[inner[~ok[back]]]] = False
        self.proposed += len(pieces)
        self.failed += int((~good).sum())
        bad = np.flatnonzero(~good)
        repaired = iter(m.exact_all([m.symbols(pieces[i]) for i in bad]))
        # one table look-up for all proposals, then each word's slice of the bytes
        found, ends = m.vocab[flat].astype("<u4").tobytes(), np.cumsum(size).tolist()
        out = {}
        for p, ok, n, end in zip(pieces, good.tolist(), size.tolist(), ends, strict=True):
            out[p] = found[4 * (end - n) : 4 * end] if ok else m.vocab[next(repaired)].astype("<u4").tobytes()
        return out

    def _parts(self, chunk: str) -> list[str]:
        return self.cut.split(chunk) if self.cut and "<" in chunk else [chunk]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """ids of whole texts as u32 little-endian bytes."""
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        missing = {c for parts in cut for c in parts}.difference(self.young)
        if len(self.young) + len(missing) > CACHE_ENTRIES:
            self.old, self.young = self.young, {}
            missing = {c for parts in cut for c in parts}
        young, old, new = self.young, self.old, {}
        for c in missing:
            if c in old:
                young[c] = old[c]
            else:
                new[c] = [(self.special[p], None) if p in self.special else (None, self.pieces(p)) for p in self._parts(c)]
        distinct = sorted({p for parts in new.values() for _, own in parts if own for p in own})
        ids = self.words(distinct) if distinct else {}
        for c, parts in new.items():
            young[c] = b"".join(np.uint32(s).tobytes() if own is None else b"".join(map(ids.__getitem__, own)) for s, own in parts)
        return [b"".join(map(young.__getitem__, parts)) for parts in cut]

    def decode(self, ids: bytes) -> str:
        """The tokens' strings with a blank between: what a file without a decoder says."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def bpe(path: str) -> SpeculativeBPE:
    if path not in _LOADED:
        _LOADED[path] = SpeculativeBPE(path)
    return _LOADED[path]


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (u32 little-endian) and decoded text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(tokenizer)
        for batch in slices(batches, 1):
            ids = coder.encode_batch(batch.column(1).to_pylist())
            for lo in range(0, len(ids), 64):
                part = ids[lo : lo + 64]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 64), pa.array(part, pa.binary()), pa.array(list(map(coder.decode, part)), pa.large_string()).cast(pa.string())], ["doc_id", "ids", "decoded"])

    return keyed_text(docs).mapInArrow(run, "doc_id long, ids binary, decoded string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    got = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return got.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
