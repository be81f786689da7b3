"""How good a schema is (R17, R18): hygiene, questions that it can express, and six
weighted dimensions with a letter grade. What depends on a corpus is joined and summed in
Spark; all else follows from the schema alone."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ontology import Ontology

#: Weights of the dimensions by purpose, and the least scores of the grades (fixed values).
WEIGHTS = {
    "balanced": {"structure": 0.30, "taxonomy": 0.25, "definitions": 0.20, "constraints": 0.15, "questions": 0.10, "corpus": 0.0},
    "guardrail": {"structure": 0.15, "taxonomy": 0.10, "definitions": 0.20, "constraints": 0.25, "questions": 0.05, "corpus": 0.25},
    "taxonomy": {"structure": 0.25, "taxonomy": 0.35, "definitions": 0.20, "constraints": 0.10, "questions": 0.10, "corpus": 0.0},
}
GRADES = (("A", 0.9), ("B", 0.8), ("C", 0.7), ("D", 0.6))


@dataclass(frozen=True)
class Finding:
    severity: str
    check: str
    target: str


def lint(o: Ontology) -> list[Finding]:
    """Errors (a name of both kinds, an unknown or circular broader label) and
    warnings (no definition, unusual names, aliases that are labels, dangling ends)."""
    out = []
    for kind, items, usual in (("label", o.nodes, r"[A-Z][A-Za-z0-9]*"), ("relationship", o.relations, r"[A-Z][A-Z0-9]*(_[A-Z0-9]+)*")):
        for n, t in items.items():
            out += [Finding("warning", "definition", n)] * (not t.description.strip()) + [Finding("warning", "naming", n)] * (not re.fullmatch(usual, n))
    out += [Finding("error", "duplicate", n) for n in sorted(o.nodes.keys() & o.relations.keys())]
    out += [Finding("warning", "alias", n) for n, t in o.nodes.items() for a in t.aliases if a != n and a in o.nodes]
    out += [Finding("error", "broader", n) for n, t in o.nodes.items() for b in t.broader if b not in o.nodes]
    circular = [n for n, t in o.nodes.items() if any(b in o.nodes and n in o.ancestors(b) for b in t.broader)]
    out += [Finding("error", "cycle", min(circular))] if circular else []
    out += [Finding("warning", "end", r) for r, t in o.relations.items() for x in (t.source, t.target) if x != "Any" and x not in o.nodes]
    return out


def spoken(name: str) -> str:
    """``worksFor`` and ``WORKS_FOR`` as words in lower case."""
    return re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name).replace("_", " ").lower()


def forms(o: Ontology, relations: bool = True) -> dict[str, set[str]]:
    """What each element is called: its name, the name in words, its aliases."""
    items = {**o.nodes, **(o.relations if relations else {})}
    return {n: {n.lower(), spoken(n), *(a.strip().lower() for a in t.aliases if a.strip())} for n, t in items.items()}


def abstract(o: Ontology) -> set[str]:
    """Labels that others are kinds of and that have no properties: never instances."""
    return {b for t in o.nodes.values() for b in t.broader if b in o.nodes and not o.nodes[b].properties}


def form_table(spark: SparkSession, o: Ontology, relations: bool = True) -> DataFrame:
    """(element, form), as small as the schema."""
    return spark.createDataFrame([(n, f) for n, fs in forms(o, relations).items() for f in sorted(fs)] or [("", "")], "element string, form string")


def asked(o: Ontology, questions: DataFrame) -> DataFrame:
    """Questions (id, question, requires array) with the elements of the schema that
    they name, what they require and it lacks, and whether it can express them."""
    spark = questions.sparkSession
    known = F.broadcast(form_table(spark, o))  # as small as the schema
    said = F.lower(F.concat_ws(" ", F.coalesce("question", F.lit("")), F.array_join("requires", " ")))
    hits = questions.join(known, said.contains(F.col("form")), "left").groupBy("id").agg(F.array_sort(F.collect_set("element")).alias("elements"))
    members = F.array(*[F.lit(x) for x in sorted({n.lower() for n in (*o.nodes, *o.relations)} | {a.lower() for t in (*o.nodes.values(), *o.relations.values()) for a in t.aliases})])
    missing = F.filter("requires", lambda r: ~F.array_contains(members, F.lower(r)))
    own = questions.select("id", missing.alias("missing"), (F.size(missing) == 0).alias("expressible"))
    return own.join(hits, "id")


def covered(o: Ontology, corpus: DataFrame) -> DataFrame:
    """Label, n and whether the schema has it, of a corpus's labels (label, n)."""
    known = form_table(corpus.sparkSession, o, relations=False).select("form").distinct()
    words = F.lower(F.regexp_replace(F.regexp_replace("label", "([a-z0-9])([A-Z])", "$1 $2"), "_", " "))
    named = corpus.select("label", "n", F.explode(F.array_distinct(F.array(F.lower("label"), words))).alias("form"))
    hit = named.join(F.broadcast(known.withColumn("hit", F.lit(True))), "form", "left")  # as small as the schema
    return hit.groupBy("label", "n").agg(F.coalesce(F.max("hit"), F.lit(False)).alias("covered"))


def ratio(part: int, whole: int) -> float:
    return part / whole if whole else 1.0


def structure(o: Ontology) -> float:
    found = [f.severity for f in lint(o)]
    return max(0.0, 1 - min(1.0, 0.34 * found.count("error")) - min(0.4, 0.04 * found.count("warning")))


def taxonomy(o: Ontology, broken: int = 0) -> float:
    """Less the share of labels that nothing connects, for a flat vocabulary, for parents
    of one child, and for kinds that are wrong by their meta-properties (R20)."""
    if not o.nodes:
        return 0.0
    up = {n: [b for b in t.broader if b in o.nodes] for n, t in o.nodes.items()}
    children = [b for bs in up.values() for b in bs]
    ends = {x for t in o.relations.values() for x in (t.source, t.target)}
    alone = [n for n in o.nodes if not up[n] and n not in children and n not in ends]
    single = sum(children.count(b) == 1 for b in set(children))
    flat = len(o.nodes) >= 6 and not children
    return max(0.0, 1 - len(alone) / len(o.nodes) - 0.2 * flat - min(0.15, 0.05 * single) - min(0.5, 0.2 * broken))


def definitions(o: Ontology) -> float:
    """Mean share of labels and relationships that are defined, of instances' labels that
    have an identity, and of properties that say more than their type."""
    concrete = [t for n, t in o.nodes.items() if n not in abstract(o)]
    props = [p for t in o.nodes.values() for p in t.properties.values()]
    identified = [t for t in concrete if t.identity or any(p.unique for p in t.properties.values())]
    shares = [
        ratio(sum(bool(t.description.strip()) for t in o.nodes.values()), len(o.nodes)),
        ratio(sum(bool(t.description.strip()) for t in o.relations.values()), len(o.relations)),
        ratio(len(identified), len(concrete)),
        ratio(sum(bool(p.description.strip()) or p.unique or p.required or p.index for p in props), len(props)),
    ]
    return sum(shares) / 4


def constraints(o: Ontology) -> float:
    rel = list(o.relations.values())
    typed = ratio(sum("Any" not in (t.source, t.target) for t in rel), len(rel))
    tight = ratio(sum(t.cardinality != "MANY_TO_MANY" for t in rel), len(rel))
    own = ratio(sum(bool(t.identity) or any(p.unique or p.required for p in t.properties.values()) for t in o.nodes.values()), len(o.nodes))
    return 0.45 * typed + 0.4 * own + 0.15 * tight


def scorecard(spark: SparkSession, o: Ontology, questions: DataFrame | None = None, corpus: DataFrame | None = None, profile: str = "balanced", broken: int = 0) -> DataFrame:
    """(dimension, weight, score) with a last row "overall", the weighted mean of the
    dimensions that could be judged, and its grade. A structural error caps the grade at D."""
    weights = WEIGHTS[profile]
    rows = [(d, weights[d], f) for d, f in (("structure", structure(o)), ("taxonomy", taxonomy(o, broken)), ("definitions", definitions(o)), ("constraints", constraints(o)))]
    table = spark.createDataFrame(rows, "dimension string, weight double, score double")
    if questions is not None:
        q = asked(o, questions)
        hidden = abstract(o)
        total = len(o.nodes) + len(o.relations) - len(hidden)
        seen = q.select(F.explode("elements").alias("e")).where(~F.col("e").isin(sorted(hidden)) if hidden else F.lit(True)).agg((F.countDistinct("e") / max(1, total)).alias("seen"))
        able = q.agg(F.avg(F.col("expressible").cast("double")).alias("able"))
        score = (F.coalesce("able", F.lit(1.0)) + (F.col("seen") if total > 0 else F.lit(1.0))) / 2
        table = table.unionByName(seen.join(F.broadcast(able)).select(F.lit("questions").alias("dimension"), F.lit(weights["questions"]).alias("weight"), score.alias("score")))  # one row each
    if corpus is not None:
        mass = covered(o, corpus).agg(F.sum(F.when(F.col("covered"), F.col("n")).otherwise(0)).alias("hit"), F.sum("n").alias("all"))
        table = table.unionByName(mass.select(F.lit("corpus").alias("dimension"), F.lit(weights["corpus"]).alias("weight"), F.coalesce(F.expr("try_divide(hit, all)"), F.lit(1.0)).alias("score")))
    blocking = any(f.severity == "error" for f in lint(o)) or not o.nodes
    overall = table.agg(F.sum("weight").alias("weight"), (F.sum(F.col("weight") * F.col("score")) / F.sum("weight")).alias("score"))
    grade = F.lit("F")
    for letter, least in reversed(GRADES[-1:] if blocking else GRADES):
        grade = F.when(F.col("score") >= least, letter).otherwise(grade)
    last = overall.select(F.lit("overall").alias("dimension"), "weight", "score", grade.alias("grade"))
    return table.withColumn("grade", F.lit(None).cast("string")).unionByName(last).withColumn("score", F.round("score", 6)).withColumn("weight", F.round("weight", 6))
