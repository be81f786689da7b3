"""Guards over tables of query texts, plans and requests.

A query text is read once into words, labels, types and properties, as columns; a guard
is a condition on those with a code. Everything is a projection: millions of logged
queries are checked as one scan."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that change data or reach beyond it (fixed values).
WRITES = ("CREATE", "MERGE", "DELETE", "DETACH", "SET", "REMOVE", "DROP")
CALLS = ("LOAD CSV", "CALL DBMS", "CALL GDS")
#: Properties by which a query limits time (fixed values).
TIMES = ("TEMPORAL_RANGE", "VALID_FROM", "VALID_UNTIL", "EXTRACTED_AT", "PUBLISHED_AT")
#: Properties that every label has.
COMMON = ("id", "name")


@dataclass(frozen=True)
class Limits:
    """What queries may use: names of the schema, the ends of each relationship, which
    are bound to time, and bounds on hops and rows. Empty names are not checked."""

    labels: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    properties: tuple[str, ...] = ()
    ends: dict[str, tuple[str, str]] = field(default_factory=dict)
    timed: tuple[str, ...] = ()
    hops: int = 0
    rows: int = 0
    parameters: tuple[str, ...] = ()
    tenant: str = "workspace_id"


def listed(names) -> Column:
    return F.array(*[F.lit(n) for n in names]).cast("array<string>")


def read(queries: DataFrame) -> DataFrame:
    """``queries`` (id, text) with bare (quoted spans as ``'?'``), words (upper case),
    labels, types, properties and the quoted or compared literals of each text."""
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), "'[^']*'|\"[^\"]*\"", "'?'")
    q = queries.withColumn("bare", F.trim(F.regexp_replace(bare, r"\s+", " ")))
    all_of = lambda pattern: F.array_sort(F.array_distinct(F.regexp_extract_all("bare", F.lit(pattern), 1)))
    return q.withColumns(
        {
            "words": F.filter(F.split(F.upper("bare"), r"[^A-Z0-9_$]+"), lambda w: w != ""),
            "labels": all_of(r"\(\s*\w*\s*:\s*(\w+)"),
            "types": all_of(r"\[\s*\w*\s*:\s*(\w+)"),
            "properties": all_of(r"(?<![\w$.])[A-Za-z_]\w*\.([A-Za-z_]\w*)"),
        }
    )


def follows(word: str, pattern: str) -> Column:
    """Whether the word after the first ``word`` looks so."""
    return F.coalesce(F.get("words", F.array_position("words", word).cast("int")).rlike(f"^(?:{pattern})$") & F.array_contains("words", word), F.lit(False))


def unbounded() -> Column:
    """A path of any length: a star without an upper end."""
    return F.col("bare").rlike(r"\[[^\]]*\*\s*(?:\.\.)?\s*\]")


def named(code: str, found: Column) -> Column:
    """``code:a,b`` of the names found, null without any."""
    return F.when(F.size(found) > 0, F.concat(F.lit(f"{code}:"), F.array_join(found, ",")))


def coded(code: str, condition: Column) -> Column:
    return F.when(condition, F.lit(code))


def _findings(q: DataFrame, checks: list[Column]) -> DataFrame:
    codes = F.filter(F.array(*checks), lambda c: c.isNotNull())
    return q.select("id", F.explode(codes).alias("finding"))


def disconnected() -> Column:
    """Several patterns in a match, and no condition that names two of their variables."""
    several = F.col("bare").rlike(r"(?i)\bmatch\b(?:(?!\bwhere\b|\breturn\b).)*\)\s*,\s*\(")
    condition = F.regexp_extract("bare", r"(?i)\bwhere\b(.*?)(?:\breturn\b|$)", 1)
    variables = F.array_distinct(F.regexp_extract_all(condition, F.lit(r"(?<![\w$.])([A-Za-z_]\w*)\."), 1))
    return several & (F.size(variables) < 2)


def reversed_paths(ends: dict[str, tuple[str, str]]) -> Column:
    """Drawn arrows whose labels are not those that their relationship declares."""
    paths = F.regexp_extract_all("bare", F.lit(r"(\(\s*\w*\s*:\s*\w+[^()]*\)\s*-\s*\[\s*\w*\s*:\s*\w+[^\]]*\]\s*->\s*\(\s*\w*\s*:\s*\w+)"), 1)
    part = lambda p, pattern: F.regexp_extract(p, pattern, 1)
    said = F.transform(paths, lambda p: F.struct(part(p, r"^\(\s*\w*\s*:\s*(\w+)").alias("a"), part(p, r"\[\s*\w*\s*:\s*(\w+)").alias("r"), part(p, r"\(\s*\w*\s*:\s*(\w+)$").alias("b")))
    wrong = lambda s: reduce(Column.__or__, [(s["r"] == r) & ((s["a"] != a) | (s["b"] != b)) for r, (a, b) in ends.items()], F.lit(False))
    return F.array_sort(F.array_distinct(F.transform(F.filter(said, wrong), lambda s: s["r"])))


def guard(queries: DataFrame, limits: Limits) -> DataFrame:
    """(id, finding, severity) of ``queries`` (id, text): names that the schema lacks,
    writes, unbounded paths and reversed arrows block; unlikely properties, no limit,
    unconnected patterns, counts without distinct and no condition on time warn."""
    q = read(queries)
    timed = F.array_intersect("types", listed(limits.timed))
    checks = [
        named("label", F.array_except("labels", listed(limits.labels))) if limits.labels else F.lit(None),
        named("property", F.array_except("properties", listed((*limits.properties, *COMMON)))) if limits.properties else F.lit(None),
        coded("limit", F.array_contains("words", "RETURN") & ~follows("LIMIT", "[0-9]+")),
        named("write", F.array_intersect("words", listed(WRITES))),
        coded("unbounded", unbounded()),
        coded("cartesian", disconnected()),
        named("direction", reversed_paths(limits.ends)) if limits.ends else F.lit(None),
        coded("distinct", F.col("bare").rlike(r"(?i)\bcount\s*\(") & ~F.array_contains("words", "DISTINCT")),
        F.when(~F.arrays_overlap("words", listed(TIMES)), named("time", timed)) if limits.timed else F.lit(None),
    ]
    blocks = F.split("finding", ":")[0].isin("label", "write", "unbounded", "direction")
    return _findings(q, checks).withColumn("severity", F.when(blocks, "block").otherwise("warn"))


def _forbidden() -> list[Column]:
    text = F.concat(F.lit(" "), F.upper("bare"), F.lit(" "))
    return [coded(f"forbidden:{w.lower().replace(' ', '_')}", text.contains(f" {w} " if w in WRITES else f" {w}")) for w in (*WRITES, *CALLS)]


def _too_many_hops(hops: int) -> Column:
    upper = F.regexp_extract_all("bare", F.lit(r"\*\s*[0-9]+\s*\.\.\s*([0-9]+)"), 1)
    return F.exists(upper, lambda n: n.cast("int") > hops)


def _unknown(limits: Limits) -> list[Column]:
    own = (("labels", limits.labels), ("types", limits.types), ("properties", limits.properties))
    return [named(f"unknown_{c}", F.array_except(c, listed(names))) for c, names in own if names]


def check_slice(queries: DataFrame, limits: Limits) -> DataFrame:
    """(id, finding) of plans (id, text, limit: the value of its parameter): no bound
    node, no return, forbidden words, hops, rows and names beyond the slice."""
    q = read(queries)
    said = F.regexp_extract("bare", r"(?i)\blimit\s+(\$\w+|[0-9]+)", 1)
    value = F.when(said.startswith("$"), F.col("limit")).otherwise(said.try_cast("int"))
    checks = [
        coded("no_bound_node", ~F.col("bare").contains("$node_id")),
        coded("no_return", ~F.array_contains("words", "RETURN")),
        *_forbidden(),
        coded("unbounded", unbounded()),
        *([coded("hops", _too_many_hops(limits.hops))] if limits.hops else []),
        *([F.when(said == "", "no_limit").when(F.coalesce(value, F.lit(0)).between(1, limits.rows), None).otherwise("rows")] if limits.rows else []),
        *_unknown(limits),
    ]
    return _findings(q, checks)


def inlined() -> Column:
    """Literals that are compared, and should be parameters; limits and hops are not."""
    kept = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?i)(?:\blimit\b|\bskip\b|\*\s*[0-9]*\s*\.\.)\s*[0-9]+", " ")
    compared = r"""(?i)((?:[<>=]{1,2}|\b(?:contains|in|starts with|ends with)\b)\s*(?:'[^']*'|"[^"]*"|[0-9]+(?:\.[0-9]+)?))"""
    return F.array_distinct(F.transform(F.regexp_extract_all(kept, F.lit(compared), 1), lambda x: F.trim(x)))


def check_fallback(queries: DataFrame, limits: Limits) -> DataFrame:
    """(id, finding) of generated queries (id, text, params map): all of the slice's
    bounds, and no literal, no missing tenant, parameter or value, no limit of their own."""
    q = read(queries)
    limit = F.col("params")["limit"].try_cast("int")
    tenant = F.col("bare").rlike(rf"\b{limits.tenant}\s*:\s*\${limits.tenant}\b")
    checks = [
        *_forbidden(),
        coded("no_return", ~F.array_contains("words", "RETURN")),
        coded("no_parameter_limit", ~follows("LIMIT", r"\$LIMIT")),
        coded("unbounded", unbounded() | F.col("bare").rlike(r"\*\s*[0-9]*\s*\.\.(?!\s*[0-9])")),
        *([coded("hops", _too_many_hops(limits.hops))] if limits.hops else []),
        *_unknown(limits),
        named("literal", F.slice(inlined(), 1, 5)),
        coded("no_tenant", ~tenant),
        *[coded(f"no_parameter:{p}", ~F.col("bare").contains(f"${p}")) for p in limits.parameters],
        *[coded(f"no_value:{p}", F.trim(F.coalesce(F.col("params")[p], F.lit(""))) == "") for p in limits.parameters],
        coded("rows", ~F.coalesce(limit.between(1, limits.rows), F.lit(False))),
    ]
    return _findings(q, checks)


# -- plans


@dataclass(frozen=True)
class Budget:
    """Bounds on a plan."""

    hits: int = 200_000
    estimated: float = 100_000.0
    milliseconds: float = 1_000.0
    rows: int = 1_000


def gate(plans: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """(id, reasons, breached) of plans (id, operators array, hits, estimated,
    milliseconds, rows, indexed): full scans without an index, products, and what is over
    the budget."""
    whole = F.array_intersect("operators", listed(("AllNodesScan", "NodeByLabelScan", "FileScan")))
    product = F.arrays_overlap("operators", listed(("CartesianProduct", "BroadcastNestedLoopJoin")))
    over = [coded(c, F.col(c) > limit) for c, limit in (("hits", budget.hits), ("estimated", budget.estimated), ("milliseconds", budget.milliseconds), ("rows", budget.rows))]
    reasons = F.filter(F.array(F.when(~F.col("indexed"), named("scan", F.array_sort(whole))), coded("product", product), *over), lambda r: r.isNotNull())
    return plans.select("id", F.array_join(reasons, " ").alias("reasons"), (F.size(reasons) > 0).alias("breached"))


def audit(operators: DataFrame, ratio: float = 10.0) -> DataFrame:
    """Plans as rows (plan, position, operator, details, estimated, actual, hits):
    (plan, fingerprint, hits, findings). A plan is misestimated where an operator made
    ``ratio`` times the rows that were expected of it, or as many times fewer."""
    off = F.expr("try_divide(actual, estimated)")
    has = lambda *names: F.max(reduce(Column.__or__, [F.col("operator").contains(n) for n in names]))
    found = {
        "aggregation": has("EagerAggregation", "HashAggregate", "SortAggregate"),
        "expansion": has("VarLengthExpand"),
        "misestimate": F.max((off >= ratio) | ((off > 0) & (off <= 1 / ratio))),
        "scan": has("AllNodesScan", "FileScan"),
        "sort": has("Sort", "Top"),
    }
    line = F.struct("position", F.concat_ws(":", "operator", "details").alias("said"))
    whole = operators.groupBy("plan").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.sum(F.coalesce("hits", F.lit(0.0))).alias("hits"), *[c.alias(f"has_{k}") for k, c in found.items()])
    codes = F.filter(F.array(*[coded(k, F.col(f"has_{k}")) for k in found]), lambda c: c.isNotNull())
    return whole.select("plan", F.substring(F.sha2(F.array_join("lines.said", "|"), 256), 1, 16).alias("fingerprint"), "hits", F.array_join(codes, ",").alias("findings"))


def promotable(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """(case, parity, faster, promote) of measured plans (case, p95, result): a plan
    is promoted if its results are the same and it is faster."""
    both = base.toDF("case", "p95", "result").join(candidate.toDF("case", "new_p95", "new_result"), "case")
    parity = F.col("result").eqNullSafe(F.col("new_result"))
    return both.select("case", parity.alias("parity"), (F.col("new_p95") < F.col("p95")).alias("faster"), (parity & (F.col("new_p95") < F.col("p95"))).alias("promote"))


def plan_operators(df: DataFrame) -> DataFrame:
    """Spark's own physical plan of ``df`` as rows for ``audit`` and ``gate``: (plan,
    position, operator, details), read from its formatted tree."""
    import re

    tree = df._jdf.queryExecution().executedPlan().treeString()
    rows = [(0, i, m[1], m[2].strip()[:240]) for i, line in enumerate(tree.splitlines()) if (m := re.match(r"[\s:+\-*()\d]*([A-Z]\w+)(.*)", line))]
    return df.sparkSession.createDataFrame(rows, "plan int, position int, operator string, details string")


# -- admission


def admit(requests: DataFrame, lanes: dict[str, int], wait: float) -> DataFrame:
    """(id, lane, verdict) of requests (id, lane, at, seconds, cost, budget). A lane
    runs so many at a time: a request is admitted if fewer are running when it comes or
    within ``wait`` seconds of it, and if its tenant's budget covers its cost; lanes
    without a limit admit all. Requests that came before count as running for their
    seconds, whatever became of them: the verdict of a log, not a scheduler."""
    limit = reduce(lambda c, kv: F.when(F.col("lane") == kv[0], F.lit(kv[1])).otherwise(c), lanes.items(), F.lit(0))
    # ends are events too: those still running at (at + wait) are those begun by at less those ended by then
    began = requests.select("lane", "id", F.col("at").alias("t"), F.lit(2).alias("kind"), F.lit(1).alias("step"))
    ended = requests.select("lane", F.lit(None).cast(requests.schema["id"].dataType).alias("id"), (F.col("at") + F.col("seconds") - F.lit(wait)).alias("t"), F.lit(1).alias("kind"), F.lit(-1).alias("step"))
    order = Window.partitionBy("lane").orderBy("t", "kind", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    load = began.unionByName(ended).withColumn("running", F.sum("step").over(order) - 1).where("id is not null").select("id", "running")
    full = (F.col("cap") > 0) & (F.col("running") >= F.col("cap"))
    return requests.withColumn("cap", limit).join(load, "id").select("id", "lane", F.when(F.col("cost") > F.col("budget"), "over budget").when(full, "rejected").otherwise("admitted").alias("verdict"))
