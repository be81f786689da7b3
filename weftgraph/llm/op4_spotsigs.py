"""Document fingerprints by SpotSigs (operator 4), DataFrame functions only.

Words are runs of ASCII letters, digits and any characters beyond ASCII, in lower case. A word of ``ANCHORS`` marks a
spot; its signature is the anchor with the next ``CHAIN`` content words, the words
that are no anchors. With p_j the place of the j-th anchor (from 0), p_j - j content
words stand before it, so every chain is a slice of the array of content words. A
text's fingerprint is the set of its signatures, as ascending 32-bit hashes in
hexadecimal. A text without a whole signature has one of its own, the hash of the
text itself, so that different texts without signatures are not alike.

Sets are compared by Jaccard similarity at a threshold. Sets are classes (equal
fingerprints meet once); their lengths are cut into partitions of ratio t, so that only
neighbouring partitions can meet; similar sets share one of their first
n - ceil(t n) + 1 signatures in an order that puts common ones last; pairs whose lengths
differ too much, or whose rest behind the shared signature is too short, are pruned before
the exact comparison. ``near_pairs`` gives the pairs of classes; ``near_classes`` the
groups that they connect, without making all pairs of a large group.

Null text counts as empty. Null keys come first in the order of documents; rows with
equal keys follow in order of their text, nulls first. Repeated rows are kept. An
empty table gives no rows. Classes are told apart by 64-bit hashes of their sets of
32-bit signature hashes."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, keyed_text, spread_join, table, written
from .components import components
from .setjoin import DEN, NUM, blocks, long_enough, open_lists, partners, prefix_size, strangers, token_lists

CHAIN = 3
#: Common function words of English, French, German and Spanish.
ANCHORS = (
    "the of and to in is it that for on with as was by this be at from are or an have not but they his her which you were "
    "le la les de des du un une et est en que qui dans pour par sur pas au aux ce cette il elle son sa ses avec ne plus "
    "der die das den dem des ein eine einer und ist im von zu mit nicht auf für als auch es sich werden wird sind an "
    "el los las del una y por con para su se lo al como más pero sus este entre ya o"
).split()
THRESHOLD = NUM / DEN
#: One class in so many is sampled for the order of signatures, which has so many common
#: ones at most, in two tiers.
EVERY, COMMON, COMMONEST = 8, 4096, 256
#: Classes of a signature's list that are compared in one piece.
BLOCK = 512
#: What stands between words: ASCII that is neither letter nor digit.
SPLIT = r"[\x00-/:-@\[-`{-\x7f]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a lambda evaluates what it refers to
    outside itself anew for every element, except another lambda's variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def signatures(text: Column) -> Column:
    """The sorted distinct 32-bit hashes of a text's signatures, in linear time: words
    and content words are computed once, each word is looked up once."""
    words = F.filter(F.split(F.lower(text), SPLIT), lambda w: w != "")
    marked = let(words, lambda w: F.struct(w.alias("words"), F.transform(w, lambda x: F.when(~x.isin(ANCHORS), x)).alias("kept")))
    found = let(marked, lambda m: let(F.filter(m["kept"], lambda x: x.isNotNull()), lambda content: _chains(m["words"], m["kept"], content)))
    own = F.array(F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF)))
    return let(F.array_sort(F.array_distinct(found)), lambda s: F.when(F.size(s) > 0, s).otherwise(own))


def _chains(words: Column, kept: Column, content: Column) -> Column:
    """Hashes of the whole chains: the j-th anchor at place p has p - j content words
    before it, so its chain is the slice of ``content`` from there."""
    places = F.filter(F.transform(kept, lambda w, i: F.when(w.isNull(), i)), lambda i: i.isNotNull())
    chain = lambda p, c: F.xxhash64(F.get(words, p), *[F.get(content, c + i) for i in range(CHAIN)]).bitwiseAND(F.lit(0xFFFFFFFF))
    hashed = F.transform(places, lambda p, j: F.when(p - j + CHAIN <= F.size(content), chain(p, p - j)))
    return F.filter(hashed, lambda h: h.isNotNull())


def as_text(sig: Column) -> Column:
    """A signature set as a fingerprint: ascending hashes of eight digits each."""
    return F.array_join(F.transform(sig, lambda h: F.lpad(F.hex(h), 8, "0")), "")


def hashes(fp: Column) -> Column:
    """A fingerprint's set as an array of strings."""
    return F.regexp_extract_all(fp, F.lit(".{8}"), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets, given as arrays without repeats."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def bit_map(sig: Column) -> Column:
    """256 bits of a set in four longs: a bit is flipped for each signature, so two maps
    differ in no more bits than the sets in signatures."""
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.floor(h / 4).cast("long"), F.lit(64)).cast("int"))
    part = lambda k: F.filter(sig, lambda h: F.pmod(h, F.lit(4)) == k)
    return F.array(*[F.aggregate(part(k), F.lit(0).cast("long"), lambda m, h: m.bitwiseXOR(bit(h))) for k in range(4)])


def may_be(x: Column, y: Column, both: Column) -> Column:
    """Whether sets of these maps, of ``both`` signatures together, can be similar."""
    differ = sum((F.bit_count(F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))) for k in range(1, 4)), F.bit_count(F.get(x, F.lit(0)).bitwiseXOR(F.get(y, F.lit(0)))))
    return differ * (DEN + NUM) <= both * (DEN - NUM)


def common_signatures(sets: DataFrame) -> list[list[int]]:
    """The signatures that several classes of a sample have, the commonest first, as two
    tiers of bounded length. ``sets``: rows (node, sig)."""
    some = sets.where(F.pmod(F.xxhash64("node"), F.lit(EVERY)) == 0).select("node", F.explode("sig").alias("s")).distinct()
    top = some.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 1").orderBy(F.desc("c"), "s").limit(COMMON)
    found = [r["s"] for r in top.collect()]
    return [found[:COMMONEST], found[COMMONEST:]]


def rare_first(sig: Column, tiers: list[list[int]]) -> Column:
    """Signatures in the global order: rare ones, then each tier, by hash."""
    top, some = tiers
    if not top:
        return sig
    common = top + some
    return F.concat(F.filter(sig, lambda s: ~s.isin(common)), F.filter(sig, lambda s: s.isin(some)) if some else F.slice(sig, 1, 0), F.filter(sig, lambda s: s.isin(top)))


def prefixes(sets: DataFrame) -> DataFrame:
    """Rows (node, sig) as (node, n, toks): size and prefix of each set."""
    n = F.size("sig")
    return sets.select("node", n.alias("n"), F.slice(rare_first(F.col("sig"), common_signatures(sets)), F.lit(1), prefix_size(n)).alias("toks"))


def near_classes(sets: DataFrame) -> DataFrame:
    """(node, root) of the classes that some other is similar to: ``sets`` has rows (node,
    sig), repeats allowed; a group's root is its least node.

    Every class meets one partner, then one of another group; what is left is compared
    within blocks, by length, group and exact Jaccard. A block gives one link a class, and
    groups so joined are one to the next round; the last round finds none. A class that
    gave no link has no similar one in another group, now or later, so only those that gave
    one go on. Bit maps settle most pairs of strangers before sets are compared."""

    def own(nodes: DataFrame) -> DataFrame:
        return written(sets.select("node", "sig").join(nodes.distinct(), "node", "left_semi").dropDuplicates(["node"]), "spot-own")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "pairs")
        some = own(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        both = pairs.join(some.toDF("a", "x"), "a").join(some.toDF("b", "y"), "b")
        found = written(both.where(jaccard(F.col("x"), F.col("y")) >= THRESHOLD - 1e-12).select("a", "b"), "links")
        discard(pairs)
        discard(some)
        return found

    def close(x: Column, y: Column) -> Column:
        apart = (F.col("i") == F.col("j")) | (x["own"] != y["own"])
        u, v = x["what"], y["what"]
        return (x["root"] != y["root"]) & apart & long_enough(x["n"], y["n"]) & may_be(u["map"], v["map"], x["n"] + y["n"]) & (jaccard(u["sig"], v["sig"]) >= THRESHOLD - 1e-12)

    lists = token_lists(prefixes(sets))
    near = verified(partners(lists))
    opened = open_lists(lists, near)
    discard(lists)
    near = near.unionByName(verified(strangers(opened)))
    one = F.transform("members", lambda x: F.struct(x["node"].alias("a"), F.get(F.filter("members", lambda y: close(x, y)), F.lit(0))["node"].alias("b")))
    while True:
        before, opened = opened, open_lists(opened.select("tok", "node", "n"), near)
        discard(before)
        some = own(opened.select("node"))
        links = blocks(opened, some.select("node", F.struct("sig", bit_map(F.col("sig")).alias("map")).alias("what"))).select(F.inline(F.filter(one, lambda p: p["b"].isNotNull())))
        given = written(links.distinct(), "given")
        found = written(given.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        discard(some)
        if found.isEmpty():
            discard(opened)
            return components(near)
        near = near.unionByName(found)
        still = opened
        opened = written(opened.select("tok", "node", "n").join(given.select(F.col("a").alias("node")).distinct(), "node", "left_semi"), "still")
        discard(still)
        discard(given)


def near_pairs(prints: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b, likeness) of different fingerprints in column ``fingerprint`` whose
    Jaccard similarity is ``threshold`` or more, a < b.

    A signature that many classes have in their prefix is dealt as pairs of blocks."""
    sets = prints.select("fingerprint").where("fingerprint is not null").distinct().withColumn("sig", F.transform(hashes(F.col("fingerprint")), lambda h: F.conv(h, 16, 10).cast("long")))
    sets = sets.withColumn("node", F.xxhash64("fingerprint")).withColumn("n", F.size("sig"))
    part = F.floor(F.log("n") / F.lit(-math.log(threshold)) + 1e-9).cast("int")
    length = F.greatest(F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))
    first = F.posexplode(F.slice(rare_first(F.col("sig"), common_signatures(sets)), F.lit(1), length)).alias("at", "s")
    keyed = written(sets.select("fingerprint", "n", part.alias("part"), first), "spot-prefixes")
    blocks = keyed.groupBy("s").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    keyed = keyed.join(blocks, "s", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = keyed.select(F.col("fingerprint").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"), "s", F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"), own.alias("i"), every.alias("js"))
    left = left.withColumn("j", F.explode("js")).drop("js")
    right = keyed.select(F.col("fingerprint").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"), "s", "part", own.alias("j"), every.alias("is"))
    right = right.withColumn("i", F.explode("is")).drop("is")
    close = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold)
    # if this is the first signature that both have, nothing before it is common
    behind = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    enough = behind >= F.ceil(threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-9)
    pairs = left.join(right, ["s", "part", "i", "j"]).where(close & enough).select("a", "b").distinct()
    return pairs.withColumn("likeness", jaccard(hashes(F.col("a")), hashes(F.col("b")))).where(F.col("likeness") >= threshold - 1e-12)


KEY = ["known", "id", "hash"]


def in_order(rows: DataFrame) -> DataFrame:
    """One row for each distinct (doc_id, text): its key, and the key ``p_known, p_id,
    p_hash`` and length ``p_chars`` of the one before it; the first follows the last.

    Only keys and lengths move. Range partitions are linked by the last key of each:
    one row a partition meets in one task, whatever the number of documents."""
    keys = rows.groupBy(*KEY).agg(F.max(F.length("text")).cast("long").alias("chars"))
    keys = written(keys.repartitionByRange(*KEY).withColumn("part", F.spark_partition_id()), "spot-keys")
    whole = F.struct(*KEY, "chars")
    last = keys.groupBy("part").agg(F.max(whole).alias("last"))
    ends = last.agg(F.max("last").alias("end"))  # one row
    linked = last.select("part", F.lag("last").over(Window.orderBy("part")).alias("linked")).join(F.broadcast(ends)).select("part", F.coalesce("linked", "end").alias("linked"))
    own = keys.withColumn("inner", F.lag(whole).over(Window.partitionBy("part").orderBy(*KEY)))
    before = F.coalesce("inner", "linked")
    return own.join(linked, "part").select(*KEY, "chars", *[before[c].alias(f"p_{c}") for c in [*KEY, "chars"]])


def keyed_rows(docs: DataFrame) -> DataFrame:
    """known, id, hash and whole text of every row: the key of ``in_order`` and the text."""
    return keyed_text(docs).select(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("hash"), "text")


def class_ids(docs: DataFrame) -> DataFrame:
    """known, id, hash and class_id of every distinct (doc_id, text): the least doc_id of
    the group of near fingerprints that it is in (null if none of them has one). No text
    moves: signature sets are written once and joined by class."""
    rows = keyed_rows(docs).withColumn("sig", signatures(F.col("text")))
    rows = written(rows.select(*KEY, F.xxhash64("sig").alias("node"), F.transform("sig", lambda h: (h - (1 << 31)).cast("int")).alias("sig")), "spot-rows")
    total = max(1, rows.count())
    least = rows.groupBy("node").agg(F.min(F.when(F.col("known"), F.col("id"))).alias("least"), F.count(F.lit(1)).alias("copies"))
    found = near_classes(rows.select("node", "sig"))
    rooted = least.join(found, "node", "left").select("node", "least", "copies", F.coalesce("root", "node").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("nodes"))
    named = spread_join(rooted, groups, "root", "nodes", total, "node").select("node", "class_id", "copies")
    return spread_join(rows.select(*KEY, "node"), written(named, "spot-classes"), "node", "copies", total, "id").select(*KEY, "class_id").distinct()


def edited_neighbours(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Every row with the text that its last quarter's replacement by the next row's
    beginning gives, and the signature sets of its own, that, and the next text:
    doc_id, text, edited, sig, edited_sig, next_sig, class_id.

    Texts are shuffled once, by key; each sends its first characters, as many as the row
    before it takes, and its signatures to that row.
    Rows that are equal in key and text are one row with a count until the end; each is
    followed by its like, the last of them by the next text.

    ``groups``: rows (known, id, hash, class_id) to give each row its class_id."""
    rows = keyed_rows(docs)
    classes = rows.groupBy(*KEY).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")).join(in_order(rows), KEY)
    classes = classes.join(groups, KEY, "left") if groups is not None else classes.withColumn("class_id", F.lit(None).cast("long"))
    # both uses read the same columns of the texts' one exchange, so it is reused
    said = classes.where("copies > 0").select(*[F.col(f"p_{c}").alias(c) for c in KEY], F.substring(F.col("text"), F.lit(1), F.floor(F.col("p_chars") / 4).cast("int")).alias("next_head"), signatures(F.col("text")).alias("next_sig"))
    quarter = F.floor(F.col("chars") / 4).cast("int")
    keep = F.substring(F.col("text"), F.lit(1), (F.col("chars") - quarter).cast("int"))
    own = classes.where("copies > 0").select(*KEY, "text", "copies", "class_id", signatures(F.col("text")).alias("sig"), keep.alias("keep"), F.substring(F.col("text"), F.lit(1), quarter).alias("own_head"))
    both = own.join(said, KEY).withColumn("edited", F.concat("keep", "next_head")).withColumn("edited_sig", signatures(F.col("edited")))
    last = F.array(F.struct("edited", "edited_sig", "next_sig", F.lit(1).cast("long").alias("times")))
    self_edited = F.concat("keep", "own_head")
    inner = F.array(F.struct(self_edited.alias("edited"), signatures(self_edited).alias("edited_sig"), F.col("sig").alias("next_sig"), (F.col("copies") - 1).alias("times")))
    kinds = both.select("known", "id", "text", "sig", "class_id", F.inline(F.when(F.col("copies") > 1, F.concat(last, inner)).otherwise(last)))
    each = kinds.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return each.select(F.when(F.col("known"), F.col("id")).alias("doc_id"), "text", "edited", "sig", "edited_sig", "next_sig", "class_id")


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and their edited texts, fingerprinted and compared; class_id is the
    least doc_id of the group of near fingerprints that a document is in."""
    docs = table(spark, sf_dir, "documents")
    got = edited_neighbours(docs, class_ids(docs))
    return got.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("sig")).alias("fingerprint"),
        as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        jaccard(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        jaccard(F.col("sig"), F.col("next_sig")).alias("near_next"),
        "class_id",
    )
