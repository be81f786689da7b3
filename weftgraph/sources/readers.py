"""Sources as records (id, content, title, source, metadata map) and sinks.

Readers are Spark's own; what a reader adds is columns. Files that a schema does not
describe are read with the columns that they have."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import redact, slack_text

RECORD = ["id", "content", "title", "source", "metadata"]


def record(df: DataFrame, ident: Column, content: Column, title: Column | None = None, source: Column | None = None, metadata: Column | None = None) -> DataFrame:
    """A record's columns; credential-like metadata is struck out."""
    null = F.lit(None).cast("string")
    meta = F.create_map().cast("map<string,string>") if metadata is None else redact(metadata)
    return df.select(ident.cast("string").alias("id"), content.alias("content"), (null if title is None else title).alias("title"), (null if source is None else source).alias("source"), meta.alias("metadata"))


def with_checksum(records: DataFrame) -> DataFrame:
    """The sha256 of a record's content, and a stable id where it has none."""
    return records.withColumn("sha256", F.sha2(F.coalesce("content", F.lit("")), 256)).withColumn("id", F.coalesce("id", F.substring("sha256", 1, 32)))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """A file is a document; folders are read through, bytes that are no UTF-8
    replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,md}").load(path)
    return record(files, F.col("path"), F.make_valid_utf8(F.col("content").cast("string")), source=F.col("path"))


def joined_cells(columns: list[str]) -> Column:
    """``k: v | k: v`` of the cells that say something."""
    cells = F.array(*[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns])
    return F.array_join(F.filter(cells, lambda x: x.isNotNull()), " | ")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The content column, or all cells; short rows have empty cells."""
    df = spark.read.option("header", "true").option("mode", "PERMISSIVE").option("multiLine", "true").csv(path)
    return record(df, F.xxhash64(*df.columns), F.col("content") if "content" in df.columns else joined_cells(df.columns), metadata=other_fields(df, ["content"]))


def other_fields(df: DataFrame, taken: list[str]) -> Column:
    """What else a row says, as metadata: its other fields that are not null,
    nested ones as JSON."""
    said = []
    for f in df.schema:
        if f.name not in taken:
            plain = F.col(f"`{f.name}`")
            said.append(F.struct(F.lit(f.name).alias("k"), (F.to_json(plain) if f.dataType.typeName() in ("struct", "array", "map") else plain.cast("string")).alias("v")))
    if not said:
        return F.create_map().cast("map<string,string>")
    return F.map_from_entries(F.filter(F.array(*said), lambda e: e["v"].isNotNull()))


CONTENT = ["id", "content", "text", "document", "references"]


def content_of(df: DataFrame) -> Column:
    """The first of content, text, document, references that there is; lists are
    joined by line ends; else the row as JSON."""
    kinds = dict(df.dtypes)
    own = [F.array_join(c, "\n") if kinds[c].startswith("array") else F.col(c).cast("string") for c in ("content", "text", "document", "references") if c in kinds]
    return F.coalesce(*own, F.to_json(F.struct(*[F.col(c) for c in df.columns])))


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """An array or an object, or a document a line of which bad ones are skipped."""
    df = spark.read.option("multiLine", str(not lines).lower()).option("mode", "DROPMALFORMED").json(path)
    ident = F.coalesce(F.col("id").cast("string"), F.hex(F.xxhash64(F.to_json(F.struct("*"))))) if "id" in df.columns else F.hex(F.xxhash64(F.to_json(F.struct("*"))))
    return record(df, F.substring(ident, 1, 50), content_of(df), metadata=other_fields(df, CONTENT))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """By extension: csv, json, jsonl or parquet."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return read_csv(spark, path)
    if kind in ("json", "jsonl"):
        return read_json(spark, path, lines=kind == "jsonl")
    df = spark.read.parquet(path)
    return record(df, F.substring(F.col("id").cast("string"), 1, 50) if "id" in df.columns else F.hex(F.xxhash64(*df.columns)), content_of(df), metadata=other_fields(df, CONTENT))


def write_records(records: DataFrame, path: str) -> None:
    """JSON lines with checksums."""
    with_checksum(records).write.json(path)


def slack_threads(messages: DataFrame) -> DataFrame:
    """A record a thread, its messages in order of time; messages are (channel, ts,
    thread_ts, user, text)."""
    m = messages.withColumn("thread", F.coalesce("thread_ts", "ts"))
    lines = F.sort_array(F.collect_list(F.struct("ts", F.concat(F.coalesce("user", F.lit("?")), F.lit(": "), slack_text("text")).alias("line"))))
    t = m.groupBy("channel", "thread").agg(lines.alias("l"))
    return record(t, F.concat_ws(":", F.lit("slack"), "channel", "thread"), F.array_join("l.line", "\n"), source=F.col("channel"))


def notion_pages(blocks: DataFrame) -> DataFrame:
    """A record a page from its blocks (page, title, position, kind, text)."""
    mark = F.when(F.col("kind") == "heading_1", "# ").when(F.col("kind") == "heading_2", "## ").when(F.col("kind") == "bulleted_list_item", "- ").when(F.col("kind") == "to_do", "[ ] ").otherwise("")
    lines = F.sort_array(F.collect_list(F.struct("position", F.concat(mark, F.coalesce("text", F.lit(""))).alias("line"))))
    p = blocks.groupBy("page").agg(F.max("title").alias("title"), lines.alias("l"))
    return record(p, F.concat(F.lit("notion:"), "page"), F.array_join("l.line", "\n"), title=F.col("title"))


def table_schemas(columns: DataFrame, system: str) -> DataFrame:
    """A record a table from rows (schema, table, position, column, type)."""
    lines = F.sort_array(F.collect_list(F.struct("position", F.concat_ws(" ", "column", "type").alias("line"))))
    t = columns.groupBy("schema", "table").agg(lines.alias("l"))
    return record(t, F.concat_ws(":", F.lit(system), "schema", "table"), F.array_join("l.line", "\n"), title=F.col("table"), source=F.lit(system))


def run_state(records: DataFrame) -> DataFrame:
    """What a run brought from each source, without content."""
    return records.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))


def company_facts(facts: DataFrame, unit: str, newest: int) -> DataFrame:
    """Of rows (entity, concept, unit, form, fiscal_year, filed, value) the first
    annual filing of each fiscal year, for the newest years of each concept."""
    own = facts.where((F.col("unit") == unit) & (F.col("form") == "10-K"))
    first = own.withColumn("r", F.row_number().over(Window.partitionBy("entity", "concept", "fiscal_year").orderBy("filed", "value"))).where("r = 1")
    return first.withColumn("age", F.dense_rank().over(Window.partitionBy("entity", "concept").orderBy(F.desc("fiscal_year")))).where(F.col("age") <= newest).drop("r", "age")


def stratified(rows: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """The same n rows of each stratum whenever asked: those of least hash of
    key and seed. A sample is what this operator is for."""
    h = F.xxhash64(F.col(key), F.lit(seed))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(stratum).orderBy(h, key))).where(F.col("r") <= n).drop("r")


def power_law_edges(spark: SparkSession, n: int, nodes: int, skew: float, seed: int) -> DataFrame:
    """N edges whose ends are floor(nodes u^skew), u from a hash of row and seed: the
    same whatever the partitions."""
    u = lambda salt: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    end = lambda salt: F.floor(F.lit(nodes) * F.pow(u(salt), F.lit(skew)))
    return spark.range(n).select("id", end("s").alias("src"), end("d").alias("dst"), F.floor(u("a") * 100_000).alias("amount"))


def prefixed(df: DataFrame, label: str, key: str) -> DataFrame:
    """Rows with id ``Label:key``."""
    return df.withColumn("id", F.concat_ws(":", F.lit(label), F.col(key).cast("string")))


def admin_csv(nodes: DataFrame, label: str, path: str) -> None:
    """Files for a bulk import: header with the id and label columns."""
    own = nodes.select(F.col("id").alias(":ID"), F.lit(label).alias(":LABEL"), *[c for c in nodes.columns if c != "id"])
    own.write.option("header", "true").csv(path)


def turtle(triples: DataFrame) -> DataFrame:
    """Lines of Turtle for (s, p, o): an object is a resource if it begins with
    http or urn: or has a prefix before a colon, else a quoted literal."""
    resource = F.col("o").rlike(r"^(https?://|urn:)")
    short = F.col("o").rlike(r"^[A-Za-z][\w-]*:[\w-]+$")
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    o = F.when(resource, F.concat(F.lit("<"), "o", F.lit(">"))).when(short, F.col("o")).otherwise(quoted)
    return triples.select(F.concat_ws(" ", F.concat(F.lit("<"), "s", F.lit(">")), F.concat(F.lit("<"), "p", F.lit(">")), o, F.lit(".")).alias("value"))


def fact_id(*parts: str) -> Column:
    """A content-addressed id."""
    return F.concat(F.lit("urn:fact:"), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32))


def new_only(batch: DataFrame, ledger: DataFrame, key: str = "idempotency_key") -> DataFrame:
    """Rows of a batch that no earlier batch had, each key once."""
    return batch.dropDuplicates([key]).join(ledger.select(key), key, "left_anti")


def adapt(spark: SparkSession, docs: list) -> DataFrame:
    """Documents of other libraries (page_content or text, metadata) as records."""
    rows = [(str(getattr(d, "id", None) or (getattr(d, "metadata", None) or {}).get("id") or i), getattr(d, "page_content", None) or getattr(d, "text", None) or "", {str(k): str(v) for k, v in (getattr(d, "metadata", None) or {}).items()}) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "id string, text string, meta map<string,string>")
    return record(df, F.col("id"), F.col("text"), metadata=F.col("meta"))


def glossary(terms: DataFrame) -> DataFrame:
    """A glossary's terms as JSON rows and back with ``from_json``."""
    return terms.select(F.to_json(F.struct("name", "definition", "parents")).alias("value"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
