"""Ontology checks, rules and axioms over data.

Payloads come as nodes (id, label, props map<string,string>) and edges (src, dst, type).
Schema tables are as small as the schema and broadcast as such."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

from weftgraph.plans.ontology import Ontology

def N():  # noqa: N802
    return F.count(F.lit(1))



def falsy(c: Column) -> Column:
    """Missing, empty, zero or false: what does not fill a required property."""
    return c.isNull() | c.isin("", "0", "0.0", "false", "False")


def castable(value: Column, kind: str) -> Column:
    """Whether a text can be a value of a type; booleans must say so."""
    if kind == "INTEGER":
        return value.try_cast("long").isNotNull()
    if kind == "FLOAT":
        return value.try_cast("double").isNotNull()
    if kind == "BOOLEAN":
        return F.lower(value).isin("true", "false")
    if kind == "DATE":
        return value.try_cast("date").isNotNull()
    if kind == "DATETIME":
        return value.try_cast("timestamp_ntz").isNotNull()
    return F.lit(True)


def violations(o: Ontology, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (kind, subject, detail): unknown label or type, missing required
    property, dangling or wrong endpoint, wrong datatype, value outside a list or range,
    and more than one edge where the cardinality allows one."""
    spark = nodes.sparkSession
    ont, props, rels = (F.broadcast(t) for t in o.tables(spark))
    isa = F.broadcast(o.isa(spark))
    bad = lambda df, kind, subject, detail: df.select(F.lit(kind).alias("kind"), subject.alias("subject"), detail.alias("detail"))
    out = [bad(nodes.join(ont.select("label"), "label", "left_anti"), "unknown_label", F.col("id"), F.col("label"))]
    own = nodes.join(props, "label").withColumn("value", F.col("props")[F.col("prop")])
    out.append(bad(own.where(F.col("required") & falsy(F.col("value"))), "missing_required", F.col("id"), F.col("prop")))
    said = own.where(F.col("value").isNotNull() & (F.col("value") != ""))
    fits = reduce(lambda c, t: F.when(F.col("type") == t, castable(F.col("value"), t)).otherwise(c), ("INTEGER", "FLOAT", "BOOLEAN", "DATE", "DATETIME"), F.lit(True))
    out.append(bad(said.where(~fits), "datatype", F.col("id"), F.concat_ws("=", "prop", "value")))
    out.append(bad(said.where((F.size("enum") > 0) & ~F.array_contains("enum", F.col("value"))), "enum", F.col("id"), F.concat_ws("=", "prop", "value")))
    number = F.col("value").try_cast("double")
    ranged = F.col("low").isNotNull() | F.col("high").isNotNull()
    off = number.isNull() | (number < F.coalesce("low", F.lit(float("-inf")))) | (number > F.coalesce("high", F.lit(float("inf"))))
    out.append(bad(said.where(ranged & off), "range", F.col("id"), F.concat_ws("=", "prop", "value")))
    out.append(bad(edges.join(rels.select("type"), "type", "left_anti"), "unknown_relationship", F.col("src"), F.col("type")))
    label = nodes.select("id", "label")
    ends = edges.join(label.toDF("src", "src_label"), "src", "left").join(label.toDF("dst", "dst_label"), "dst", "left")
    out.append(bad(ends.where(F.col("src_label").isNull() | F.col("dst_label").isNull()), "dangling", F.col("src"), F.concat_ws("->", "type", "dst")))
    typed = ends.where("src_label is not null and dst_label is not null").join(rels, "type")
    for end, want in (("src_label", "source"), ("dst_label", "target")):
        ok = typed.join(isa.select(F.col("label").alias(end), F.col("ancestor").alias(want)), [end, want], "left_anti").where(F.col(want) != "Any")
        out.append(bad(ok, "endpoint", F.col("src"), F.concat_ws(":", "type", F.col(end))))
    single = edges.join(rels.where("cardinality in ('ONE_TO_ONE', 'MANY_TO_ONE')").select("type"), "type", "left_semi").groupBy("src", "type").agg(N().alias("n")).where("n > 1")
    out.append(bad(single, "cardinality", F.col("src"), F.col("type")))
    return reduce(DataFrame.unionByName, out)


def score(o: Ontology, nodes: DataFrame) -> DataFrame:
    """Id and the mean of label match (a generic label is half), completeness of
    required properties and type correctness, to three digits."""
    spark = nodes.sparkSession
    ont, props, _ = (F.broadcast(t) for t in o.tables(spark))
    own = nodes.join(props, "label", "left").withColumn("value", F.col("props")[F.col("prop")])
    fits = reduce(lambda c, t: F.when(F.col("type") == t, castable(F.col("value"), t)).otherwise(c), ("INTEGER", "FLOAT", "BOOLEAN", "DATE", "DATETIME"), F.lit(True))
    per = own.groupBy("id", "label").agg(F.count_if(F.col("required")).alias("need"), F.count_if(F.col("required") & ~falsy(F.col("value"))).alias("has"), F.count("value").alias("said"), F.count_if(F.col("value").isNotNull() & fits).alias("right"))
    match = F.when(F.col("known").isNotNull(), 1.0).when(F.col("label") == "Entity", 0.5).otherwise(0.0)
    rate = lambda a, b: F.coalesce(F.expr(f"try_divide({a}, {b})"), F.lit(1.0))
    both = per.join(ont.select("label", F.lit(1).alias("known")), "label", "left")
    return both.select("id", F.round((match + rate("has", "need") + rate("right", "said")) / 3, 3).alias("score"))


def annotate(o: Ontology, nodes: DataFrame) -> DataFrame:
    """Stamp what is outside the ontology and offer the generic label."""
    known = F.broadcast(o.tables(nodes.sparkSession)[0].select("label", F.lit(True).alias("known")))
    return nodes.join(known, "label", "left").withColumn("out_of_ontology", F.col("known").isNull()).withColumn("coerced", F.when(F.col("known"), F.col("label")).otherwise("Entity")).drop("known")


def infer_rules(rows: DataFrame, required: float = 0.98) -> DataFrame:
    """One row for each (label, prop) of long rows (label, id, prop, value): share
    filled, whether required, dominant type (ties by name), distinct values, whether
    they may be a list (at most 20 and at most max(2, n / 5)), least and greatest number."""
    of = rows.groupBy("label").agg(F.countDistinct("id").alias("n_label"))
    v = F.col("value")
    kind = F.when(F.lower(v).isin("true", "false"), "boolean").when(v.try_cast("long").isNotNull(), "integer").when(v.try_cast("double").isNotNull(), "number").otherwise("string")
    said = rows.where("value is not null and value <> ''").withColumn("kind", kind)
    kinds = said.groupBy("label", "prop", "kind").agg(N().alias("c"))
    top = kinds.groupBy("label", "prop").agg(F.min_by("kind", F.struct(-F.col("c"), F.col("kind"))).alias("type"))
    facts = said.groupBy("label", "prop").agg(N().alias("filled"), F.countDistinct("value").alias("values"), F.min(v.try_cast("double")).alias("low"), F.max(v.try_cast("double")).alias("high"))
    out = facts.join(top, ["label", "prop"]).join(of, "label")
    share = F.col("filled") / F.col("n_label")
    listed = (F.col("values") > 0) & (F.col("values") <= 20) & (F.col("values") <= F.greatest(F.lit(2), F.floor(0.2 * F.col("filled"))))
    return out.select("label", "prop", F.round(share, 4).alias("share"), (share >= required).alias("required"), "type", "values", listed.alias("enum"), "low", "high")


def apply_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """For each (label, prop), rows that pass and that break its range or type."""
    r = F.broadcast(rules.select("label", "prop", "type", "low", "high"))
    x = F.col("value").try_cast("double")
    ok = F.when(F.col("type").isin("integer", "number"), x.isNotNull() & (x >= F.col("low")) & (x <= F.col("high"))).otherwise(F.col("value").isNotNull())
    return rows.join(r, ["label", "prop"]).groupBy("label", "prop").agg(F.count_if(ok).alias("passed"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed"))


def violation_sql(label: str, prop: str, rule: dict) -> str:
    """SQL that finds rows of a table ``label`` which break a rule."""
    q = lambda x: "`" + x.replace("`", "``") + "`"
    tests = []
    if rule.get("type") in ("integer", "number"):
        tests.append(f"try_cast({q(prop)} AS DOUBLE) IS NULL")
    if rule.get("low") is not None:
        tests.append(f"{q(prop)} < {float(rule['low'])}")
    if rule.get("high") is not None:
        tests.append(f"{q(prop)} > {float(rule['high'])}")
    if rule.get("enum"):
        values = ", ".join("'" + str(v).replace("'", "''") + "'" for v in rule["enum"])
        tests.append(f"{q(prop)} NOT IN ({values})")
    return f"SELECT * FROM {q(label)} WHERE {q(prop)} IS NOT NULL AND ({' OR '.join(tests) or 'FALSE'})"


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has; rows with a null key are not compared."""
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    return rows.where(known).groupBy(*keys).agg(N().alias("n")).where("n > 1")


def coverage(o: Ontology, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """How often each declared label and type is used, unused ones with 0."""
    ont, _, rels = o.tables(nodes.sparkSession)
    n = ont.select("label").join(nodes.groupBy("label").agg(N().alias("n")), "label", "left").select(F.lit("label").alias("kind"), F.col("label").alias("name"), "n")
    e = rels.select("type").join(edges.groupBy("type").agg(N().alias("n")), "type", "left").select(F.lit("type").alias("kind"), F.col("type").alias("name"), "n")
    return n.unionByName(e).na.fill(0, ["n"])


def denormalise(nodes: DataFrame, edge: DataFrame, target: DataFrame, prefix: str) -> DataFrame:
    """The one target of each node as columns ``prefix_*``: for edges whose
    cardinality allows it."""
    t = target.select(*[F.col(c).alias(f"{prefix}_{c}") for c in target.columns])
    e = edge.select(F.col("src").alias("__s"), F.col("dst").alias("__d"))
    return nodes.join(e, nodes["id"] == e["__s"], "left").join(t, F.col("__d") == F.col(f"{prefix}_id"), "left").drop("__s", "__d")


def normalise(view: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(targets, edges) back from a denormalised view."""
    cols = [c for c in view.columns if c.startswith(prefix + "_")]
    own = view.where(F.col(f"{prefix}_id").isNotNull())
    return own.select(*[F.col(c).alias(c[len(prefix) + 1 :]) for c in cols]).distinct(), own.select(F.col("id").alias("src"), F.col(f"{prefix}_id").alias("dst")).distinct()


def migrate(rows: DataFrame, renames: dict[str, str], drops: list[str], at: str) -> DataFrame:
    """Renamed columns; dropped ones stay as ``_deleted_*`` with a time, so nothing
    is lost."""
    out = rows.withColumnsRenamed(renames).withColumnsRenamed({d: f"_deleted_{d}" for d in drops})
    return out.withColumn("_deleted_at", F.lit(at).cast("timestamp_ntz")) if drops else out


def induce(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """For each relationship its majority endpoint labels (ties by name) and use."""
    label = nodes.select("id", "label")
    ends = edges.join(label.toDF("src", "source"), "src").join(label.toDF("dst", "target"), "dst").groupBy("type", "source", "target").agg(N().alias("n"))
    best = ends.groupBy("type").agg(F.min_by(F.struct("source", "target"), F.struct(-F.col("n"), F.col("source"), F.col("target"))).alias("m"), F.sum("n").alias("edges"))
    return best.select("type", F.col("m.source").alias("source"), F.col("m.target").alias("target"), "edges")


def mine_axioms(edges: DataFrame, confidence: float = 0.95) -> DataFrame:
    """For each type, the shares of sources with one target and of targets with one
    source, and whether it is functional or inverse functional."""
    e = edges.select("type", "src", "dst").distinct()
    f = e.groupBy("type", "src").agg(N().alias("n")).groupBy("type").agg(N().alias("sources"), F.avg((F.col("n") == 1).cast("double")).alias("functional"))
    i = e.groupBy("type", "dst").agg(N().alias("n")).groupBy("type").agg(N().alias("targets"), F.avg((F.col("n") == 1).cast("double")).alias("inverse"))
    out = f.join(i, "type")
    return out.select("type", "sources", "targets", F.round("functional", 4).alias("functional"), F.round("inverse", 4).alias("inverse"), (F.col("functional") >= confidence).alias("is_functional"), (F.col("inverse") >= confidence).alias("is_inverse"))


def disjoint_labels(members: DataFrame, support: int = 1) -> DataFrame:
    """Pairs of labels that no entity has together; members are (id, label)."""
    m = members.distinct()
    size = m.groupBy("label").agg(N().alias("n")).where(F.col("n") >= support)
    together = m.toDF("id", "a").join(m.toDF("id", "b"), "id").where("a < b").select("a", "b").distinct()
    pairs = size.select(F.col("label").alias("a")).join(F.broadcast(size.select(F.col("label").alias("b"))), F.col("a") < F.col("b"))  # labels of the schema
    return pairs.join(together, ["a", "b"], "left_anti")


def compositions(first: DataFrame, second: DataFrame, head: DataFrame) -> DataFrame:
    """One row for the rule first(x, y), second(y, z) -> head(x, z): pairs that the
    body gives, those that the head has too, and the confidence."""
    body = first.select(F.col("src").alias("x"), F.col("dst").alias("y")).distinct().join(second.select(F.col("src").alias("y"), F.col("dst").alias("z")).distinct(), "y").select("x", "z").distinct()
    h = head.select(F.col("src").alias("x"), F.col("dst").alias("z")).distinct().withColumn("h", F.lit(1))
    return body.join(h, ["x", "z"], "left").agg(N().alias("body"), F.count("h").alias("head")).withColumn("confidence", F.expr("try_divide(head, body)"))


def entail(edges: DataFrame, subtype: dict[str, str], inverse: dict[str, str]) -> DataFrame:
    """Edges that sub-types and inverses entail and that are not there yet, once."""
    made = [edges.where(F.col("type") == a).select("src", "dst", F.lit(b).alias("type")) for a, b in subtype.items()]
    made += [edges.where(F.col("type") == a).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(b).alias("type")) for a, b in inverse.items()]
    return reduce(DataFrame.unionByName, made).distinct().join(edges.select("src", "dst", "type"), ["src", "dst", "type"], "left_anti").withColumn("entailed", F.lit(True))


def ambiguous(names: DataFrame) -> DataFrame:
    """Surfaces that more than one entity has, commonest first; rows (surface, id)."""
    return names.groupBy("surface").agg(F.countDistinct("id").alias("entities"), N().alias("n"), F.min("id").alias("least")).where("entities > 1")


def drift(rows: DataFrame, active: str) -> DataFrame:
    """One row: distinct schema hashes of indexed rows, rows without one, and rows of
    another than the active one."""
    return rows.agg(F.countDistinct("hash").alias("hashes"), F.count_if(F.col("hash").isNull()).alias("missing"), F.count_if(F.col("hash") != active).alias("stale"))


def freshness(age_seconds: Column, serve: int, repair: int) -> Column:
    """Serve, repair or refuse by age."""
    return F.when(age_seconds <= serve, "serve").when(age_seconds <= repair, "repair").otherwise("refuse")


def shape_properties(rows: DataFrame, defaults: dict[str, str], clip: list[str], text: list[str]) -> DataFrame:
    """Defaults for nulls, scores clipped to [0, 1], and one text for embedding."""
    out = rows
    for k, v in defaults.items():
        out = out.withColumn(k, F.coalesce(F.col(k).cast("string"), F.lit(v)))
    for k in clip:
        out = out.withColumn(k, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(k))))
    return out.withColumn("embedding_text", F.concat_ws(" ", *text))


def sanity(rows: DataFrame, now: str) -> DataFrame:
    """R34, W-4: counts of five faults in rows (id, run, version, starts, ends, seen):
    mentions of the future, inverted ranges, rows without a run, rows not seen for a
    year, and versions that do not grow."""
    t = F.lit(now).cast("timestamp_ntz")
    w = Window.partitionBy("id").orderBy("seen", "version")
    v = rows.withColumn("before", F.lag("version").over(w))
    tests = {"future": F.col("seen") > t, "inverted": F.col("starts") > F.col("ends"), "orphan": F.col("run").isNull(), "stale": F.col("seen") < t - F.expr("interval 365 days"), "non_monotone": F.col("version") <= F.col("before")}
    return v.agg(*[F.count_if(c).alias(k) for k, c in tests.items()])


def grounded_numbers(values: Column, source: Column, tolerance: float = 0.005) -> Column:
    """The share of an answer's numbers that the source's numbers have, within a
    tolerance; 1 without numbers."""
    found = F.filter(values, lambda v: F.exists(source, lambda s: F.abs(v - s) <= tolerance * F.greatest(F.abs(v), F.abs(s))))
    return F.when(F.size(values) > 0, F.size(found) / F.size(values)).otherwise(1.0)


def schema_atoms(rows: DataFrame) -> DataFrame:
    """Rows (label, prop, required) as atoms (atom, value) that versions compare."""
    labels = rows.select(F.concat(F.lit("label "), "label").alias("atom"), F.lit("").alias("value"))
    props = rows.select(F.concat(F.lit("property "), "label", F.lit("."), "prop").alias("atom"), F.when(F.col("required"), "required").otherwise("").alias("value"))
    return labels.unionByName(props).distinct()


def classify_atoms(old: DataFrame, new: DataFrame) -> DataFrame:
    """(atom, kind) of the differences of two versions' atoms: what is added is
    read by old readers (BACKWARD) unless it is required (FORWARD); what goes, or changes
    but to become required, breaks them."""
    j = old.withColumnRenamed("value", "was").join(new.withColumnRenamed("value", "now"), "atom", "full_outer")
    added = F.when(F.col("now").endswith("required"), "FORWARD").otherwise("BACKWARD")
    changed = F.when(F.trim("was") == F.trim(F.regexp_replace("now", "required$", "")), "BACKWARD").otherwise("BREAKING")
    kind = F.when(F.col("now").isNull(), "BREAKING").when(F.col("was").isNull(), added).otherwise(changed)
    return j.where(~F.col("was").eqNullSafe(F.col("now"))).select("atom", kind.alias("kind"))


def closure(kinds: DataFrame) -> DataFrame:
    """(label, ancestor) of all that rows (child, parent) imply, each label its own
    ancestor. Reach doubles each round; cycles end it like anything else."""
    own = kinds.select(F.explode(F.array("child", "parent")).alias("label")).distinct().select("label", F.col("label").alias("ancestor"))
    now = cut(own.unionByName(kinds.select(F.col("child").alias("label"), F.col("parent").alias("ancestor"))).distinct())
    n = now.count()
    while True:
        step = now.select("label", F.col("ancestor").alias("via")).join(now.select(F.col("label").alias("via"), "ancestor"), "via")
        now = cut(step.select("label", "ancestor").distinct())
        found = now.count()
        if found == n:
            return now
        n = found


def bridged(closed: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms (root, alias) as (label, alias) of the root and all that are kinds of it."""
    return closed.join(terms, closed["ancestor"] == terms["root"]).select("label", "alias").distinct()


def root_candidates(closed: DataFrame, k: int) -> DataFrame:
    """The k labels that most others are kinds of."""
    return closed.where("label <> ancestor").groupBy(F.col("ancestor").alias("root")).agg(N().alias("descendants")).orderBy(F.desc("descendants"), "root").limit(k)
