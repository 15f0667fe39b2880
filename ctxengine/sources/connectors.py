"""Sources and sinks over files that Spark reads: directory scans, search events, status and log text, registries, presets, prompts, patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import fold_separators, ignore_pattern, js_trim, matches

# Directories that a scan never enters.
PRUNED = r"(?:^|/)(?:\.git|node_modules|dist|out|\.next)/"
PROJECT = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("rootPath", T.StringType()), T.StructField("excludePatterns", T.ArrayType(T.StringType()))])
SEARCH_EVENT = "type string, data struct<path:struct<text:string>, line_number:int, lines:struct<text:string>>"


def scan_files(spark: SparkSession, root: str, ignore_lines: list[str] | None = None, with_content: bool = False) -> DataFrame:
    """(path, size, mtime[, text]) of the files below root, pruned; content is only read where asked for."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    top = root.rstrip("/")
    path = F.regexp_replace(F.substr("path", F.locate(top, F.col("path")) + len(top)), "^/+", "")
    kept = found.withColumn("path", path).where(~F.col("path").rlike(PRUNED) & ~matches(F.col("path"), ignore_pattern(ignore_lines or [])))
    columns = [F.col("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")]
    return kept.select(*columns, *([F.expr("try_validate_utf8(cast(content as string))").alias("text")] if with_content else []))


def search_events(lines: DataFrame) -> DataFrame:
    """(path, line_number, text) of match and context events of JSON lines (value); malformed and other events go."""
    e = lines.select(F.from_json("value", SEARCH_EVENT).alias("e")).where("e.type in ('match', 'context')")
    out = e.select(F.col("e.data.path.text").alias("path"), F.col("e.data.line_number").alias("line_number"), F.col("e.data.lines.text").alias("content"))
    return out.where("path is not null and line_number is not null and content is not null")


def status_paths(lines: DataFrame, quoted: bool = False) -> DataFrame:
    """Distinct paths of short status lines (value); of a rename the new path."""
    p = F.element_at(F.split(F.substr("value", F.lit(4)), " -> "), -1)
    p = js_trim(F.regexp_replace(p, '^"|"$', "") if quoted else p)
    return lines.select(p.alias("path")).where("path <> ''").distinct()


def log_paths(lines: DataFrame) -> DataFrame:
    """Distinct trimmed paths of name-only log lines (value)."""
    return lines.select(js_trim(F.col("value")).alias("path")).where("path <> ''").distinct()


def read_projects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(projects, warnings): a malformed entry voids the registry, an absent file is an empty one."""
    try:
        raw = spark.read.schema(T.StructType([*PROJECT.fields, T.StructField("_bad", T.StringType())])).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
        bad = raw.where("_bad is not null or id is null or name is null or rootPath is null").limit(1).count()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raw, bad = spark.createDataFrame([], PROJECT), 0
    warnings = spark.createDataFrame([("malformedRegistry", path)] if bad else [], "kind string, message string")
    return (raw.drop("_bad") if not bad else raw.drop("_bad").where("false")), warnings


def write_registry(df: DataFrame, path: str) -> None:
    """S16 as a sink: one JSON array, as a registry is read (a row for each project)."""
    one = df.select(F.struct(*df.columns).alias("p")).agg(F.to_json(F.sort_array(F.collect_list("p"))).alias("value"))
    one.write.mode("overwrite").text(path)


def commit_paths(commits: DataFrame, ref: str) -> tuple[DataFrame, DataFrame]:
    """(distinct paths of one commit, a warning if there is none such); commits (commit_id, path)."""
    one = commits.where(F.col("commit_id").cast("string") == ref)
    missing = one.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("gitFailure").alias("kind"), F.lit(ref).alias("message"))
    return one.select(js_trim(F.col("path")).alias("path")).where("path <> ''").distinct(), missing


def save_store(rows: DataFrame, path: str) -> None:
    """S20, S21 as sinks: rows by name, a folder for each name."""
    rows.write.mode("overwrite").partitionBy("name").json(path)


def load_store(spark: SparkSession, path: str, schema: str, name: str | None = None) -> DataFrame:
    """The rows of a store, of one name or all; of one name only its folder is read."""
    rows = spark.read.schema(f"{schema}, name string").json(path)
    return rows if name is None else rows.where(F.col("name") == name)


def merge_prompts(stored: DataFrame, news: DataFrame, deleted: list[str] | None = None) -> DataFrame:
    """(name, text): news overwrite what is stored under their name, deleted names go."""
    kept = stored.where(~F.col("name").isin(deleted)) if deleted else stored
    both = kept.select("name", "text", F.lit(0).alias("turn")).unionByName(news.select("name", "text", F.lit(1).alias("turn")))
    return both.groupBy("name").agg(F.max_by("text", "turn").alias("text"))


def write_patched(plans: DataFrame, path: str) -> None:
    """A row for each patched document; nothing is changed in place."""
    plans.select("target", "patched").write.mode("overwrite").parquet(path)


def changed_diff(diffs: DataFrame, excludes: list[str]) -> DataFrame:
    """Unstaged, then staged diffs of each project in one text, without excluded paths."""
    kept = diffs.where(~matches(fold_separators(F.col("path")), ignore_pattern(excludes)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("staged", "path", "diff"))), lambda x: x["diff"]), "\n")
    return kept.groupBy("project_id").agg(body.alias("diff"))
