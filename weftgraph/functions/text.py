"""Scalar functions as column expressions.

All stay in the JVM. Patterns that the SQL twins share use no look-around; where the
semantics need it (periods, camel case) Java's regex has it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Legal forms at the end of a company's name (fixed values).
LEGAL_FORMS = ("inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "llc", "llp", "plc", "gmbh", "ag", "sa", "nv", "holdings", "group")
#: Scale words and letters of amounts (fixed values).
SCALES = {"t": 1e12, "trillion": 1e12, "b": 1e9, "bn": 1e9, "billion": 1e9, "m": 1e6, "mm": 1e6, "mn": 1e6, "million": 1e6, "k": 1e3, "thousand": 1e3}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_symbol(c) -> Column:
    """lower case, letters and digits only."""
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "")


def normalise_answer(c) -> Column:
    """lower case, punctuation to blanks, one blank between words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"[^\w\s]", " "), r"\s+", " "))


def identity_segment(c) -> Column:
    """trimmed, lower case, one blank for white space, null as empty."""
    return F.coalesce(F.regexp_replace(F.trim(F.lower(col(c))), r"\s+", " "), F.lit(""))


def name_key(c) -> Column:
    """words without a leading "the" and without legal forms at the end, but never
    to nothing."""
    plain = F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", " "))
    plain = F.regexp_replace(plain, "^the ", "")
    cut = F.regexp_replace(plain, r"( (?:" + "|".join(LEGAL_FORMS) + r"))+$", "")
    return F.when(cut == "", plain).otherwise(cut)


def entity_mention(c) -> Column:
    """P10: no possessive, no legal form or ampersand at the end, single blanks."""
    out = F.regexp_replace(F.trim(col(c)), r"['’]s\b", "")
    out = F.regexp_replace(out, r"(?i)[,\s]+(?:" + "|".join(LEGAL_FORMS) + r")\.?$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\s*&\s*$", ""), r"\s+", " "))


def token_prefix(a, b) -> Column:
    """one name's words begin the other's."""
    a, b = col(a), col(b)
    return (a == b) | a.startswith(F.concat(b, F.lit(" "))) | b.startswith(F.concat(a, F.lit(" ")))


def type_tokens(c) -> Column:
    """words of a camel-case or underscored type name, lower case."""
    spaced = F.regexp_replace(F.regexp_replace(col(c), "([a-z0-9])([A-Z])", "$1 $2"), r"[_\W]+", " ")
    return F.filter(F.split(F.lower(F.trim(spaced)), " "), lambda w: w != "")


def tokens(c) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.filter(F.split(F.lower(col(c)), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def lexical_similarity(a: Column, b: Column) -> Column:
    """F8: 0.6 Jaccard + 0.4 containment of word sets, to four digits; 0 if one is empty."""
    inter, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    small = F.least(F.size(a), F.size(b))
    return F.when(small > 0, F.round(0.6 * inter / union + 0.4 * inter / small, 4)).otherwise(0.0)


def token_f1(a: Column, b: Column) -> Column:
    """F1 of word sets, to four digits; 0 if either is empty or nothing is shared."""
    both = F.size(F.array_intersect(a, b))
    return F.when((both > 0), F.round(2.0 * both / (F.size(a) + F.size(b)), 4)).otherwise(0.0)


def overlap_score(query: Column, content: Column) -> Column:
    """share of the query's words that the content has."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, content)) / F.size(query)).otherwise(0.0)


def parse_value(c) -> Column:
    """struct(value, percent, digits) of an amount: parentheses or a minus are
    negative, currency signs go, scale words multiply. Null without a number."""
    s = F.lower(F.trim(col(c)))
    digits = F.regexp_extract(s, r"([0-9][0-9,]*\.?[0-9]*)", 1)
    plain = F.regexp_replace(digits, ",", "")
    number = F.try_to_number(plain, F.lit("9" * 20 + "D" + "9" * 10)).cast("double")
    scale = F.lit(1.0)
    word = F.regexp_extract(s, r"[0-9][0-9,]*\.?[0-9]*\s*([a-z]+)", 1)
    for k, v in SCALES.items():
        scale = F.when(word == k, F.lit(v)).otherwise(scale)
    negative = s.rlike(r"^\s*\(.*\)\s*$") | s.rlike(r"^[^0-9]*-\s*[^0-9]*[0-9]")
    value = number * scale * F.when(negative, -1).otherwise(1)
    significant = F.length(F.regexp_replace(F.regexp_replace(plain, r"\.", ""), "^0+", ""))
    return F.when(digits != "", F.struct(value.alias("value"), (s.contains("%") | s.contains("percent")).alias("percent"), significant.alias("digits")))


def values_agree(a: Column, b: Column, tolerance: float = 0.005) -> Column:
    """relative tolerance; a percentage never equals a plain number; zeros agree."""
    top = F.greatest(F.abs(a["value"]), F.abs(b["value"]))
    return (a["percent"] == b["percent"]) & ((top == 0) | (F.abs(a["value"] - b["value"]) <= tolerance * top))


def coerce_year(*cs) -> Column:
    """the first 19xx or 20xx in the columns, letters before it allowed."""
    found = [F.nullif(F.regexp_extract(col(c).cast("string"), r"((?:19|20)[0-9]{2})(?:[^0-9]|$)", 1), F.lit("")) for c in cs]
    return F.coalesce(*found).cast("int")


def period_key(c) -> Column:
    """F16: ``basis:year:period`` of a phrase; fiscal if it says so, FY without a quarter."""
    s = F.lower(col(c))
    year = F.nullif(F.regexp_extract(s, r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])", 1), F.lit(""))
    q = F.nullif(F.regexp_extract(s, r"\bq([1-4])\b", 1), F.lit(""))
    words = F.when(s.rlike(r"\bfirst quarter\b"), "1").when(s.rlike(r"\bsecond quarter\b"), "2").when(s.rlike(r"\bthird quarter\b"), "3").when(s.rlike(r"\bfourth quarter\b"), "4")
    basis = F.when(s.rlike(r"\bcalendar\b"), "calendar").otherwise("fiscal")
    return F.when(year.isNotNull(), F.concat_ws(":", basis, year, F.coalesce(F.concat(F.lit("Q"), F.coalesce(q, words)), F.lit("FY"))))


def observation_key(entity, concept, period, unit, basis, segment=None, restated=None) -> Column:
    """``obs:`` and 24 digits of a sha1 over the parts; segment and restatement
    only where they say something."""
    parts = [col(entity), col(concept), col(period), F.upper(col(unit)), F.lower(col(basis))]
    parts += [F.when(F.coalesce(col(segment), F.lit("")) != "", F.concat(F.lit("segment="), col(segment)))] if segment is not None else []
    parts += [F.when(col(restated), F.lit("restated"))] if restated is not None else []
    return F.concat(F.lit("obs:"), F.substring(F.sha1(F.concat_ws("\x01", *parts)), 1, 24))


def content_hash(c) -> Column:
    """16 digits of a sha256 that ignores case and white space."""
    return F.substring(F.sha2(F.regexp_replace(F.lower(F.trim(col(c))), r"\s+", " "), 256), 1, 16)


def opaque_ref(*cs) -> Column:
    """sha256 over the parts with NUL between."""
    return F.sha2(F.concat_ws("\x00", *[col(c) for c in cs]), 256)


def shard_for(c, shards: int) -> Column:
    """the first 8 bytes of a sha256, big-endian, modulo the number of shards."""
    return (F.conv(F.substring(F.sha2(col(c), 256), 1, 16), 16, 10).cast("decimal(20,0)") % shards).cast("int")


def canonical_rank(c) -> Column:
    """the order by which a canonical name is the greatest: words, length, name."""
    c = col(c)
    return F.struct(F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")), F.length(c), c)


def staleness(days, half_life: float) -> Column:
    """exp(-ln 2 days / half life); unknown age costs nothing."""
    return F.when(col(days).isNull(), 1.0).otherwise(F.exp(-F.log(F.lit(2.0)) * col(days) / half_life))


def token_count(c) -> Column:
    """words between white space; none in an empty text."""
    return F.size(F.filter(F.split(F.trim(col(c)), r"\s+"), lambda w: w != ""))


def citations(c) -> Column:
    """the distinct [src:id] and [src:id, chunk:n] marks of a text, as id and id#n."""
    marks = F.regexp_extract_all(col(c), F.lit(r"\[src:[^\],\s]+(?:,\s*chunk:[0-9]+)?\]"), 0)
    source, chunk = lambda m: F.regexp_extract(m, r"src:([^\],\s]+)", 1), lambda m: F.regexp_extract(m, r"chunk:([0-9]+)", 1)
    return F.array_sort(F.array_distinct(F.transform(marks, lambda m: F.when(chunk(m) == "", source(m)).otherwise(F.concat_ws("#", source(m), chunk(m))))))


def numbers_in(c) -> Column:
    """the numbers of a text with their scale words."""
    marks = F.regexp_extract_all(F.lower(col(c)), F.lit(r"-?[0-9][0-9,]*(?:\.[0-9]+)?(?:\s?(?:trillion|billion|million|thousand|bn|mn|b|m|k)\b)?"), 0)
    return F.transform(marks, lambda m: parse_value(m)["value"])


def semver(c) -> Column:
    """struct(major, minor, patch)."""
    p = F.split(col(c), r"\.")
    return F.struct(*[F.coalesce(F.get(p, F.lit(i)).try_cast("int"), F.lit(0)).alias(n) for i, n in enumerate(("major", "minor", "patch"))])


def version_distance(a, b) -> Column:
    """1000 a major step and 1 a minor step between two versions."""
    x, y = semver(a), semver(b)
    return 1000 * F.abs(x["major"] - y["major"]) + F.abs(x["minor"] - y["minor"])


def mask_question(c) -> Column:
    """quoted spans, numbers and capitalised words as marks."""
    out = F.regexp_replace(col(c), '"[^"]*"', "<q>")
    out = F.regexp_replace(out, r"\b[0-9]+(?:\.[0-9]+)?\b", "<n>")
    return F.lower(F.regexp_replace(out, r"\b[A-Z]\w*", "<e>"))


def question_entities(c) -> Column:
    """V9: quoted spans, else runs of capitalised words, else words of four letters up."""
    quoted = F.regexp_extract_all(col(c), F.lit("[\"']([^\"']+)[\"']"), 1)
    spans = F.regexp_extract_all(col(c), F.lit(r"\b[A-Z][\w&.-]*(?:\s+[A-Z][\w&.-]*)*"), 0)
    words = F.regexp_extract_all(F.lower(col(c)), F.lit(r"\b[a-z]{4,}\b"), 0)
    return F.when(F.size(quoted) > 0, quoted).when(F.size(spans) > 0, spans).otherwise(words)


def redact(m) -> Column:
    """a map whose credential-like keys are struck out."""
    return F.transform_values(col(m), lambda k, v: F.when(F.lower(k).rlike("token|secret|password|api_?key|credential|authorization"), "[REDACTED]").otherwise(v))


def slack_text(c) -> Column:
    """links, mentions and channels of a message as plain text."""
    out = F.regexp_replace(col(c), r"<(?:https?://[^|>]+)\|([^>]+)>", "$1")
    out = F.regexp_replace(out, r"<(https?://[^>]+)>", "$1")
    out = F.regexp_replace(out, r"<#[A-Z0-9]+\|([^>]+)>", "#$1")
    return F.trim(F.regexp_replace(out, r"<@([A-Z0-9]+)>", "@$1"))


def display_number(c) -> Column:
    """1.2B, 3.4M or the number with separators."""
    c = col(c)
    size = F.abs(c)
    return F.when(size >= 1e9, F.concat(F.format_number(c / 1e9, 2), F.lit("B"))).when(size >= 1e6, F.concat(F.format_number(c / 1e6, 2), F.lit("M"))).otherwise(F.format_number(c, 2))


def gestalt_ratio(a, b) -> Column:
    """similarity by longest matching blocks. No built-in has it, so an Arrow UDF
    for a small set of candidates."""
    from difflib import SequenceMatcher

    def ratio(x, y):
        return pd.Series([None if p is None or q is None else SequenceMatcher(None, p.lower(), q.lower()).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    ratio.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return F.pandas_udf(ratio, "double")(col(a), col(b))


#: Names that one pass over the texts looks for.
NAMES = 100_000


def mentions(docs: DataFrame, names: DataFrame, block: int = NAMES) -> DataFrame:
    """(name_id, doc_id) of every text that contains a name, in any case, anywhere.

    ``names`` (name_id, name) is a stated list, taken in blocks of ``block``: an automaton
    of a block's names reads each text (doc_id, text) once, whatever their number. Null
    and empty names are in no text; equal names are each found."""
    kinds = f"name_id {names.schema['name_id'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    texts = docs.where("text is not null").select("doc_id", F.lower("text").alias("text"))
    listed = names.where("name <> ''").select("name_id", F.lower("name").alias("name")).toLocalIterator()
    found = [texts.mapInArrow(_finder([(r["name_id"], r["name"]) for r in part], texts), kinds) for part in batched(listed, block)]
    out = found[0] if found else texts.select(F.lit(None).alias("name_id"), "doc_id").where("false")
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _finder(names: list[tuple], texts: DataFrame):
    shared = texts.sparkSession.sparkContext.broadcast(names)  # one block of names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        ids: dict[str, list] = {}
        for k, name in shared.value:
            ids.setdefault(name, []).append(k)
        trie = ahocorasick.Automaton()
        for name in ids:
            trie.add_word(name, name)
        trie.make_automaton()
        kind = None
        for batch in batches:
            rows, of = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for name in {name for _, name in trie.iter(text)}:
                    rows += ids[name]
                    of += [i] * len(ids[name])
            kind = kind or pa.array([k for k, _ in shared.value]).type
            yield pa.RecordBatch.from_arrays([pa.array(rows, kind), batch.column(0).take(pa.array(of, pa.int64()))], ["name_id", "doc_id"])

    return run
