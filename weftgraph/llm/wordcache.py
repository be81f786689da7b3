"""Tokenization with the tokenizers library through a cache of distinct chunks.

A text is cut where the tokenizer itself must cut, each distinct chunk is encoded
by the library, and ids are looked up. The cache has two generations and a fixed
number of entries, so memory is bounded however many distinct words a corpus has."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import regex

#: Chunks in each of the two generations of one Python worker's cache.
CACHE_ENTRIES = 500_000
#: Characters on which normal forms and every regex engine's classes agree.
PLAIN = re.compile(r"[\n\t\x20-\x7e\xa1-\xac\xae-\xff]*")
_LOADED: dict[str, "ChunkEncoder"] = {}


def byte_level_table() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves,
    the other bytes for U+0100 onward, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


BYTE_LEVEL = byte_level_table()
BLANK = chr(BYTE_LEVEL[0x20])


class ChunkEncoder:
    """ids of whole texts as little-endian bytes of ``width`` bytes per id.

    ``spaces`` names the rule for safe cuts:
    "drop": white space is never part of a token and always ends one, so a text is
    cut at blanks and line ends, which vanish;
    "keep": a blank begins the token that follows it, so a text is cut before
    blanks, unless one of them follows white space (runs are tokens of their own)
    or the text has NULs: such a text goes to the library whole. A line end between
    words is a token of its own.

    Chunks of plain characters are split by the tokenizer's own pattern and given
    to the library's BPE model; all others go through the library's whole encoder."""

    def __init__(self, path: str, spaces: str, width: int = 4):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model, self.spaces, self.dtype = self.tok.model, spaces, np.dtype(f"<u{width}")
        self.young, self.old = {}, {}
        self.run = re.compile(r"\s ")
        with open(path, encoding="utf-8") as f:
            head = json.load(f)
        splits = [p["pattern"]["Regex"] for p in (head["pre_tokenizer"].get("pretokenizers") or []) if p["type"] == "Split"]
        # The byte-level pre-tokenizer's built-in pattern is a fixed value of its format.
        self.pattern = regex.compile(splits[0] if splits else r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.lower, self.blank = spaces == "drop", spaces == "keep"
        self.code = {2: "H", 4: "I"}[width]  # the box's own byte order is little-endian, as the files are
        if array(self.code, [1]).tobytes()[0] != 1:
            raise RuntimeError("little-endian machines only")
        self.specials = [t["content"] for t in head["added_tokens"]]

    def _library(self, texts: list[str]) -> list[bytes]:
        out = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=self.dtype).tobytes() for x in out]

    def _word(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece)]

    def _chunk(self, chunk: str) -> bytes:
        word = chunk[1:] if self.blank and chunk[:1] == " " else chunk
        end = word[-1:] in (".", ",")
        word = word[:-1] if end else word
        if word.isascii() and word.isalpha():  # one run of letters: one piece, its own byte-level form
            if end and (known := self.young.get(chunk[:-1])):
                return known + array(self.code, self._word(chunk[-1])).tobytes()
            ids = self._word(word.lower() if self.lower else BLANK + word if len(chunk) > len(word) + end else word)
            return array(self.code, ids + self._word(chunk[-1]) if end else ids).tobytes()
        if not PLAIN.fullmatch(chunk) or "<|" in chunk:
            return self._library([chunk])[0]
        ids: list[int] = []
        for piece in self.pattern.findall(chunk.lower() if self.lower else chunk):
            ids += self._word(piece.encode().decode("latin-1").translate(BYTE_LEVEL))
        return array(self.code, ids).tobytes()

    def chunks(self, text: str) -> list[str] | None:
        if self.spaces == "drop":
            return text.replace("\n", " ").split(" ")
        if "\0" in text:
            return None
        if " ".join(text.split()) == text.replace("\n", " "):  # single blanks and line ends between words
            return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
        if self.run.search(text):
            return None
        return text.replace(" ", "\0 ").split("\0")

    def encode(self, text: str) -> bytes:
        parts = self.chunks(text)
        if parts is None:
            return self._library([text])[0]
        try:
            return b"".join(map(self.young.__getitem__, parts))
        except KeyError:
            pass
        missing = set(parts).difference(self.young)
        if len(self.young) + len(missing) > CACHE_ENTRIES:
            self.old, self.young = self.young, {}
            missing = set(parts)
        young, old = self.young, self.old
        for p in missing:
            young[p] = old.get(p) or self._chunk(p)
        return b"".join(map(young.__getitem__, parts))


def encoder(path: str, spaces: str, width: int = 4) -> ChunkEncoder:
    key = f"{path}|{spaces}|{width}"
    if key not in _LOADED:
        _LOADED[key] = ChunkEncoder(path, spaces, width)
    return _LOADED[key]
