"""License scans by an exact set-similarity join (operator 5).

Templates are licence notices and whole licence texts; their tokens, and a text's, are
the distinct pairs of adjacent words, so order counts and line ends do not. A text block
is a window over the whole text's words that steps by half a window. Windows have
``BLOCK`` words, or that times the power of two by which a template is at most half a
window: so every passage of a template's length lies whole in a block. A template meets a
block if the block has at least ``THRESHOLD`` of the template's tokens. Tokens are ordered
by how many blocks of ``BLOCK`` words of the whole corpus have them, rarest first; then
- prefix: a block that meets template T has one of T's first |T| - o + 1 tokens among
  its own first |B| - o + 1, with o = ceil(threshold |T|) the overlap that is needed;
- length: it has at least o distinct tokens;
- position: what stands behind the first common token in both orders suffices for o.
Only pairs that pass are verified by counting. No pair at the threshold is lost, and
the templates' tokens are the only thing gathered on the driver.

Beside the join stand the base phrases, found wherever their words are consecutive.

Null text counts as empty: no words, no labels, score 0. Null keys and repeated rows
are kept; an empty table gives no rows. Words are as the base rule says, whatever the
language; ties in frequency are broken by the token itself."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_text, slices, table

#: Words of the least block.
BLOCK = 64
THRESHOLD = 0.8

#: Base phrases and their labels (fixed by the query's contract).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices by which licences ask to be named, and the texts of short licences.
TEMPLATES = [
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT License"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the Apache License Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "released under the BSD license"),
    ("gpl", "licensed under the GNU General Public License version 3"),
    ("gpl", "this program is free software you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("mpl", "subject to the terms of the Mozilla Public License"),
    ("cc-by-nc", "licensed under CC BY NC 4.0"),
    ("cc-by-sa", "licensed under CC BY SA 4.0"),
    ("cc-by-nd", "licensed under CC BY ND 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "dedicated to the public domain under CC0 1.0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
        "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
        "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ),
]

#: Byte map: A-Z to a-z; digits, letters and bytes from 0x80 stay; all else is a blank.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORDS).split()


def pairs_of(words: list[bytes]) -> list[bytes]:
    """The token that begins at each word but the last: it and the next."""
    return [a + b" " + b for a, b in zip(words, words[1:], strict=False)]


def starts_of(n: int, block: int) -> range:
    """Where the blocks of a text of n words begin."""
    return range(0, max(1, n - block // 2), block // 2)


def blocks_with(places: list[int], n: int, block: int) -> list[int]:
    """Where those blocks begin that have a token at one of ``places``, ascending."""
    half, last, out = block // 2, starts_of(n, block)[-1], set()
    for p in places:
        for lo in (p // half * half, p // half * half - half):
            if 0 <= lo <= last and p <= min(lo + block, n) - 2:
                out.add(lo)
    return sorted(out)


def template_tokens(templates: list[tuple[str, str]]) -> list[frozenset[bytes]]:
    out = [frozenset(pairs_of(words_of(t))) for _, t in templates]
    if not all(out):
        raise ValueError("a template needs two words")
    return out


def template_block(text: str) -> int:
    """The block length of a template's own scale: at least twice its words."""
    size = BLOCK
    while 2 * len(words_of(text)) > size:
        size *= 2
    return size


def block_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many blocks of ``BLOCK`` words of all documents each template token stands.
    At most one row a token and task is shuffled, at most the vocabulary is collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches, 1):
            for text in batch.column(1):
                words = words_of(text.as_py())
                seen: dict[bytes, list[int]] = {}
                for i, t in enumerate(pairs_of(words)):
                    if t in vocabulary:
                        seen.setdefault(t, []).append(i)
                for t, places in seen.items():
                    counts[t] += len(blocks_with(places, len(words), BLOCK))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])

    rows = keyed_text(docs).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["token"]): r["n"] for r in rows}


@dataclass(frozen=True)
class Index:
    """Templates in the global order, and for each scale and prefix token its templates."""

    labels: list[str]
    tokens: list[frozenset]
    orders: list[dict]
    needed: list[int]
    rank: dict
    prefix: dict


def build_index(templates: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float = THRESHOLD) -> Index:
    tokens = template_tokens(templates)
    rank = {w: i for i, w in enumerate(sorted(frozenset().union(*tokens), key=lambda w: (frequency.get(w, 0), w)))}
    orders = [{w: i for i, w in enumerate(sorted(t, key=rank.__getitem__))} for t in tokens]
    needed = [math.ceil(threshold * len(t) - 1e-9) for t in tokens]
    prefix: dict[int, dict[bytes, list[int]]] = {}
    for i, order in enumerate(orders):
        for w in list(order)[: len(order) - needed[i] + 1]:
            prefix.setdefault(template_block(templates[i][1]), {}).setdefault(w, []).append(i)
    return Index([label for label, _ in templates], tokens, orders, needed, rank, prefix)


def meets(index: Index, scale: int, own: set[bytes]) -> list[tuple[int, float]]:
    """(template, containment) of every template of a scale that a block's tokens meet."""
    prefix = index.prefix[scale]
    hits = own.intersection(prefix)
    if not hits:
        return []
    # tokens of no template come after all others in the block's order: none of them is common
    order = {w: i for i, w in enumerate(sorted(own.intersection(index.rank), key=index.rank.__getitem__))}
    out, seen = [], set()
    for w in sorted(hits, key=order.__getitem__):
        for t in prefix[w]:
            if t in seen:
                continue
            seen.add(t)
            need, size = index.needed[t], len(index.tokens[t])
            if len(own) < need or order[w] > len(own) - need:  # length, and the block's prefix
                continue
            # w is the first common token: every earlier one of T's is absent
            if 1 + min(size - index.orders[t][w] - 1, len(order) - order[w] - 1) < need:
                continue
            common = len(index.tokens[t] & own)
            if common >= need:
                out.append((t, common / size))
    return out


def phrase_places(words: list[bytes], phrases: list[list[bytes]]) -> list[list[int]]:
    """Where the words of each phrase stand consecutively, overlaps included."""
    joined = b" " + b" ".join(words) + b" "
    out = []
    for phrase in phrases:
        needle, found = b" " + b" ".join(phrase) + b" ", []
        at = joined.find(needle)
        if at >= 0:
            starts = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
            while at >= 0:
                found.append(int(np.searchsorted(starts, at)))
                at = joined.find(needle, at + 1)
        out.append(found)
    return out


SCAN = "doc_id long, n_words long, base array<struct<label:string,word:long>>, blocks array<struct<label:string,word:long,n_words:int,containment:double>>"


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, base: dict[str, str] = BASE, threshold: float = THRESHOLD) -> DataFrame:
    """For every row: n_words, all places of base phrases, and all blocks that meet a
    template with their place and containment."""
    index = build_index(templates, block_frequencies(docs, frozenset().union(*template_tokens(templates))), threshold)
    phrases, labels = [p.encode().split() for p in base], list(base.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())])), pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("n_words", pa.int32()), ("containment", pa.float64())])))
        for batch in slices(batches, 1):
            out = []
            for text in batch.column(1):
                words = words_of(text.as_py())
                places = [{"label": label, "word": p} for label, ps in zip(labels, phrase_places(words, phrases), strict=True) for p in ps]
                tokens, met = pairs_of(words), []
                if not index.rank.keys().isdisjoint(tokens):
                    for scale, prefix in index.prefix.items():
                        for lo in blocks_with([i for i, t in enumerate(tokens) if t in prefix], len(words), scale):
                            size = min(scale, len(words) - lo)
                            met += [{"label": index.labels[t], "word": lo, "n_words": size, "containment": c} for t, c in meets(index, scale, set(tokens[lo : lo + size - 1]))]
                out.append((len(words), places, met))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], ["doc_id", "n_words", "base", "blocks"])

    return keyed_text(docs).mapInArrow(run, SCAN)


def sql(templates: list[tuple[str, str]] = TEMPLATES, base: dict[str, str] = BASE, threshold: float = THRESHOLD) -> str:
    """The query in SQL (DuckDB), without filters: every block against every template."""
    words = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    listed = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    known = ", ".join(f"('{label}', {template_block(text)}, {listed(sorted(w.decode() for w in t))})" for (label, text), t in zip(templates, template_tokens(templates), strict=True))
    sizes = ", ".join(f"({n})" for n in sorted({template_block(text) for _, text in templates}))
    said = ", ".join(f"('{label}', {listed(p.split())})" for p, label in base.items())
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT rid, doc_id, regexp_extract_all(t, '{words}') AS ws FROM d),
p(label, ps) AS (VALUES {said}),
places AS (SELECT rid, label, i - 1 AS word FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) x, p WHERE ws[i] = ps[1] AND ws[i:i + len(ps) - 1] = ps),
pairs AS (SELECT rid, len(ws) AS n, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) AS ps FROM w WHERE len(ws) > 1),
s(size) AS (VALUES {sizes}),
blocks AS (SELECT rid, size, list_distinct(ps[lo + 1:lo + size - 1]) AS b FROM (SELECT rid, ps, size, unnest(range(0, greatest(1, n - size // 2), size // 2)) AS lo FROM pairs, s) z),
k(label, size, ts) AS (VALUES {known}),
met AS (SELECT rid, label, len(list_intersect(b, ts)) / len(ts) AS c FROM blocks JOIN k ON blocks.size = k.size WHERE len(list_intersect(b, ts)) >= ceil({threshold} * len(ts) - 1e-9)),
pb AS (SELECT rid, COUNT(*) AS n, MIN(word) AS lo, MAX(word) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY rid),
mb AS (SELECT rid, COUNT(*) AS n, MAX(c) AS c FROM met GROUP BY rid),
l AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM places UNION SELECT rid, label FROM met) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, COALESCE(pb.n, 0) AS n_base, lo AS first_word, hi AS last_word, COALESCE(pb.labels, '') AS base_labels, COALESCE(l.labels, '') AS labels, CASE WHEN pb.n > 0 THEN 1.0::DOUBLE ELSE COALESCE(mb.c, 0.0::DOUBLE) END AS score, COALESCE(mb.n, 0) AS n_blocks
FROM w LEFT JOIN pb USING (rid) LEFT JOIN mb USING (rid) LEFT JOIN l USING (rid)"""


def op5_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: words, base places and labels, the join's labels and score."""
    got = scan(table(spark, sf_dir, "documents"))
    base, met = F.col("base.label"), F.col("blocks.label")
    return got.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, met)), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max("blocks.containment"), F.lit(0.0))).alias("score"),
        F.size("blocks").cast("long").alias("n_blocks"),
    )
