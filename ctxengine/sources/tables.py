"""Relational views of the supplied tables: files, signals, commits, edges, code, replies, changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_path():  # noqa: ANN201
    return F.concat_ws("/", "lang", "source", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md")))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, path, size, text, doc_id) of documents; size in bytes."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("project_id"), doc_path().alias("path"), F.octet_length("text").cast("long").alias("size"), "text", "doc_id")


def signals(spark: SparkSession, sf_dir: str, term: str) -> DataFrame:
    """(project_id, path, reason, ord, size): text matches, then modified, then recently committed files."""
    found = files(spark, sf_dir)
    labels = table(spark, sf_dir, "labels")
    keys = ["project_id", "path", "size"]
    text = found.where(F.contains(F.lower("text"), F.lit(term.lower()))).select(*keys, F.lit("rgMatch").alias("reason"), F.lit(0).alias("ord"))
    labelled = found.select(*keys, "doc_id").join(labels.select("doc_id", "quality", "toxic"), "doc_id")
    modified = labelled.where("quality = 1").select(*keys, F.lit("gitModified").alias("reason"), F.lit(1).alias("ord"))
    recent = labelled.where("toxic = 1").select(*keys, F.lit("recentCommit").alias("reason"), F.lit(2).alias("ord"))
    return text.unionByName(modified).unionByName(recent)


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit_id, path, ts): orders as commits, the parts in them as paths."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.concat(F.lit("docs/part_"), F.col("l_partkey").cast("string"), F.lit(".md")).alias("path")).distinct()
    return items.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit_id"), F.col("o_orderdate").alias("ts")), "commit_id")


def file_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, commit_id, path, ts): runs of 40 document ids as commits of their sources."""
    run = F.floor(F.col("doc_id") / 40)
    return files(spark, sf_dir).select("project_id", run.alias("commit_id"), "path", run.alias("ts"))


#: Rows of a range of ids that one task looks through, about.
RANGE_ROWS = 200_000


def following(files: DataFrame, values: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """files with next_<value> of the next doc_id of the same project, null at its end.

    Ranges of ids, as many as the rows call for, are looked through one by one, each with the first row behind it, so no project is sorted in one task.
    """
    ids = files.where("doc_id is not null").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if ids["lo"] is None:
        return files.select("*", *(F.lit(None).cast(dict(files.dtypes)[v]).alias(f"next_{v}") for v in values))
    width = max(1, -(-(ids["hi"] - ids["lo"] + 1) // -(-ids["n"] // range_rows)))
    cut = files.withColumn("_r", F.floor((F.col("doc_id") - ids["lo"]) / width).cast("int"))
    led = cut.withColumn("_next", F.lead(F.struct(*values)).over(Window.partitionBy("project_id", "_r").orderBy("doc_id")))
    if ids["n"] <= range_rows:
        return led.select(*files.columns, *(F.col("_next")[v].alias(f"next_{v}") for v in values))
    firsts = cut.groupBy("project_id", "_r").agg(F.min_by(F.struct(*values), "doc_id").alias("_first"))  # a row for each project and range
    behind = firsts.withColumn("_behind", F.lead("_first").over(Window.partitionBy("project_id").orderBy("_r"))).drop("_first")
    joined = led.join(behind, ["project_id", "_r"], "left")
    return joined.select(*files.columns, *(F.coalesce(F.col("_next"), F.col("_behind"))[v].alias(f"next_{v}") for v in values))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, src, dst, reason, confidence): each document to the next of its source by id."""
    f = following(files(spark, sf_dir).select("project_id", "path", "doc_id"), ["path"])
    return f.select("project_id", F.col("path").alias("src"), F.col("next_path").alias("dst"), F.lit("docgraph").alias("reason"), ((F.col("doc_id") % 11) / 10.0).alias("confidence"))


def parts(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """Columns of the parts, dealt over the tasks: their file is so small, next to the texts that are made of its rows, that few tasks would read it."""
    return table(spark, sf_dir, "part").select(*columns).repartition("p_partkey")


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code_id, text): a brace-structured text for each part."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = F.concat(
        F.lit("import { a } from './part_"), size, F.lit("'\n// rest of file\nclass P"), key, F.lit(" {\n  run("), size, F.lit(") {\n    // "), F.col("p_name"), F.lit("\n    a = "), size,
        F.lit(";\n\n    b = a;\n  }\n}\nconst x = { y: "), size, F.lit(" };\n# "), F.col("p_brand"), F.lit("\nurl = 'http://x/"), key, F.lit("'; // tail"),
    )
    return parts(spark, sf_dir, ["p_partkey", "p_size", "p_name", "p_brand"]).select(F.col("p_partkey").alias("code_id"), text.alias("text"))


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code_id, text): a script for each part, of seven shapes with a body that nests others, and one for each document, in a comment and a template."""
    c, lit = F.concat, F.lit
    p = parts(spark, sf_dir, ["p_partkey", "p_name"])
    key = F.col("p_partkey").cast("string")
    inner = c(lit(" // } "), "p_name", lit("\n const s = '{' + \"}\" + `{${1}`; /* } */ return /[{]/.test(s); "))
    body = c(lit("{"), inner, lit("list.forEach(y => {"), inner, lit("});}"))
    shapes = [
        (c(lit("function f"), key, lit("(a = { x: 1 }) ")), lit("\ncall(1);")), (c(lit("class C"), key, lit(" { get g() { return 1 } static async m(b: string): Promise<{ y: number }> ")), lit(" }")),
        (lit("const h = (a: string): void => "), lit(";")), (lit("let a = 1\nexport default async function () "), lit("")), (c(lit("const o = { a: function() { return 2; }, m"), key, lit("() ")), lit("};")),
        (lit("const t = `} ${list.map(x => "), lit(")} {`;")), (lit("const f = function() "), lit(";")),
    ]
    texts = F.array(*(c(before, body, after) for before, after in shapes))
    of_parts = p.select(F.col("p_partkey").cast("long").alias("code_id"), F.get(texts, (F.col("p_partkey") % len(shapes)).cast("int")).alias("text"))
    clean = F.translate("text", "*`\\$", "")
    of_documents = table(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).alias("code_id"), c(lit("/* () => { "), clean, lit(" */ function d() { return `"), clean, lit("`; }\n// function x() { y }")).alias("text"))
    return of_parts.unionByName(of_documents)


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, text): assistant turns as replies that name a file and hold it in a fence, twice."""
    one = F.concat(F.lit("## File: src/f"), F.col("conv_id").cast("string"), F.lit(".ts\n```ts\n"), F.col("text"), F.lit("\n```\n"))
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("Here it is.\n"), one, F.lit("And more:\n"), one).alias("text"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, ts, content): events as changes of a file."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("content"), "event_id")
