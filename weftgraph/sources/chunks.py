"""Chunking and the document layer.

Packing paragraphs into chunks carries state from one to the next, which no built-in
expresses: it runs on Arrow batches, a whole document at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "doc_id long, chunk_id string, ordinal int, text string, char_start int, char_end int, token_count int, section_path string, section_title string, section_level int"


def chunk_text(text: str, size: int, overlap: int, separator: str) -> list[tuple[str, int, int]]:
    """(text, start, end) of chunks: whole paragraphs up to ``size`` characters, longer
    ones cut; each but the first opens with the last ``overlap`` characters of the one
    before. Offsets are of a chunk's own content; an empty text gives (-1, -1)."""
    if not text.strip():
        return [("", -1, -1)]
    parts, at = [], 0
    for p in text.split(separator):
        for lo in range(0, max(1, len(p)), size):
            if p[lo : lo + size].strip():
                parts.append((at + lo, at + min(len(p), lo + size)))
        at += len(p) + len(separator)
    spans: list[list[int]] = []
    for a, b in parts:
        if spans and b - spans[-1][0] <= size:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    out = []
    for i, (a, b) in enumerate(spans):
        tail = text[max(spans[i - 1][0], spans[i - 1][1] - overlap) : spans[i - 1][1]] if i and overlap else ""
        out.append((tail + text[a:b], a, b))
    return out


def sections(text: str) -> list[tuple[int, str, str, int]]:
    """(start, path, title, level) of a text's markdown headings."""
    stack: list[tuple[int, str]] = []
    out = []
    for m in re.finditer(r"(?m)^(#{1,6})\s+(.+?)\s*$", text):
        level = len(m[1])
        stack = [s for s in stack if s[0] < level] + [(level, m[2])]
        out.append((m.start(), " > ".join(t for _, t in stack), m[2], level))
    return out


def chunk(docs: DataFrame, size: int = 6000, overlap: int = 200, separator: str = "\n\n") -> DataFrame:
    """Chunks of (doc_id, text) with their section."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = []
            for key, text in zip(df["doc_id"], df["text"], strict=True):
                text = text or ""
                heads = sections(text)
                for i, (t, a, b) in enumerate(chunk_text(text, size, overlap, separator)):
                    own = next((h for h in reversed(heads) if h[0] <= max(a, 0)), (0, None, None, None))
                    out.append((key, f"{key}_chunk_{i}", i, t, a, b, len(t.split()), *own[1:]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CHUNK.split(", ")]).astype({"section_level": "Int32"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, CHUNK)


def document_layer(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of documents and their chunks, with the chain of chunks."""
    doc = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    nodes = chunks.select(F.col("chunk_id").alias("id"), F.lit("Chunk").alias("label")).unionByName(chunks.select(doc.alias("id"), F.lit("Document").alias("label")).distinct())
    has = chunks.select(doc.alias("src"), F.col("chunk_id").alias("dst"), F.lit("HAS_CHUNK").alias("type"))
    before = F.lag("chunk_id").over(Window.partitionBy("doc_id").orderBy("ordinal"))
    chain = chunks.select(before.alias("src"), F.col("chunk_id").alias("dst"), F.lit("NEXT").alias("type")).where("src is not null")
    return nodes, has.unionByName(chain)


def fallback_extraction(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Capitalised words as entities, and who mentions them."""
    found = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Z][a-z]{2,})\b"), 1))).alias("name"))
    return found.select("name").distinct().select(F.col("name").alias("id"), F.lit("Entity").alias("label")), found.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("src"), F.col("name").alias("dst"), F.lit("MENTIONS").alias("type"))


def fact_triples(text: pd.Series) -> pd.Series:
    """(subject, predicate, object) of sentences of the form Name verb ... Name, with
    at most four words between and at most twelve of a text."""
    rule = re.compile(r"\b([A-Z]\w*(?:\s[A-Z]\w*)*)\s+((?:[a-z]\w*\s+){1,4})([A-Z]\w*(?:\s[A-Z]\w*)*)")

    def of(t: str | None) -> list[dict]:
        out = []
        for s in re.split(r"(?<=[.!?])\s+", t or ""):
            m = rule.search(s)
            if m:
                out.append({"s": m[1], "p": m[2].strip(), "o": m[3]})
        return out[:12]

    return text.map(of)


def facts(docs: DataFrame) -> DataFrame:
    udf = F.pandas_udf(fact_triples, "array<struct<s:string,p:string,o:string>>")
    return docs.select("doc_id", F.inline(udf("text")))


def normalise_payload(rows: DataFrame) -> DataFrame:
    """Nodes of any spelling (id or name, label or type) as the contract has them."""
    have = set(rows.columns)
    first = lambda *cs: F.coalesce(*[F.col(c).cast("string") for c in cs if c in have], F.lit(None).cast("string"))
    return rows.select(first("id", "identifier", "name", "title").alias("id"), F.coalesce(first("label", "type", "kind"), F.lit("Entity")).alias("label"), first("name", "title", "id").alias("name"))


def hints(records: DataFrame) -> DataFrame:
    """For each label the words that its records use."""
    return records.select("label", F.explode(F.split(F.lower("name"), r"\W+")).alias("word")).where("word <> ''").groupBy("label").agg(F.array_join(F.sort_array(F.collect_set("word")), ",").alias("words"))
