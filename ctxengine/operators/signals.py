"""Signals to scored candidates: union, merge, weights, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import js_trim

# The weight of each reason.
REASON_WEIGHTS = {
    "rgMatch": 35, "gitModified": 30, "recentCommit": 20, "pathAffinity": 15, "fileTypeBoost": 10, "manualPin": 100, "clipboardPath": 25,
    "extensionMatch": 10, "directoryMatch": 15, "gitCommit": 30, "dependency": 5, "docgraph": 5, "excluded": -1000,
}


def weight_of(reason: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in REASON_WEIGHTS.items() for x in kv))[reason], F.lit(0))


def score_of(reasons: Column, pinned: Column | None = None) -> Column:
    """A2: the sum of weights; manualPin counts only with the flag, whatever the reasons say."""
    base = F.aggregate(F.filter(reasons, lambda r: r != "manualPin"), F.lit(0), lambda a, r: a + weight_of(r))
    return base + (F.when(pinned, REASON_WEIGHTS["manualPin"]).otherwise(0) if pinned is not None else F.lit(0))


def readable(signals: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signals with a readable file, warnings for the rest)."""
    keys = ["project_id", "path"]
    known = files.select(*keys, F.lit(True).alias("_there"))
    joined = signals.join(known, keys, "left")
    lost = joined.where("_there is null").select("project_id", "path").distinct()
    return joined.where("_there").drop("_there"), lost.select(F.lit("unreadableFile").alias("kind"), "project_id", F.col("path").alias("relative_path"))


def read_contents(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Wanted (project_id, path) with text and size, and size 0 and a warning where no such file is inside the project."""
    inside = ~F.col("path").rlike(r"^/|(?:^|/)\.\.(?:/|\z)")
    there = files.select("project_id", "path", "text", F.lit(True).alias("_there"))
    warning = F.when(F.col("_there").isNull(), F.lit("unreadableFile"))
    return wanted.join(there.where(inside), ["project_id", "path"], "left").select("project_id", "path", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), warning.alias("warning"))


def valid_roots(projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """F16: (projects with a root, warnings)."""
    blank = js_trim(F.coalesce("rootPath", F.lit(""))) == ""
    return projects.where(~blank), projects.where(blank).select(F.lit("invalidRoot").alias("kind"), F.col("id").alias("project_id"))


def joined_messages(warnings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, message): the messages of warnings in order of their files, one a line."""
    return warnings.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("relative_path", "message"))), lambda w: w["message"]), "\n").alias("message"))


def merge_signals(signals: DataFrame) -> DataFrame:
    """A1: one row for each file: distinct reasons, first seen first, and the first known size.

    There are 13 reasons, so a group is reduced to its first ord per reason before it is listed.
    """
    first = signals.groupBy("project_id", "path", "reason").agg(F.min("ord").alias("ord"), F.min_by("size", F.when(F.col("size").isNotNull(), F.col("ord"))).alias("size"))
    listed = F.array_sort(F.collect_list(F.struct("ord", "reason")))
    return first.groupBy("project_id", "path").agg(
        F.transform(listed, lambda x: x["reason"]).alias("reasons"), F.min_by("size", F.when(F.col("size").isNotNull(), F.col("ord"))).alias("size")
    )


def analyze(signals: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Signals (project_id, path, reason, ord, size) to candidates with a score."""
    kept = readable(signals, files)[0] if files is not None else signals
    return merge_signals(kept).withColumn("score", score_of(F.col("reasons")).cast("long"))


def in_order(candidates: DataFrame, by: str = "score") -> DataFrame:
    """O1, O2, O3: by score and then path in code-point order, or by path in the locale's order."""
    if by == "score":
        return candidates.orderBy(F.desc("score"), "project_id", "path")
    return candidates.orderBy("project_id", F.collate("path", "UNICODE"), "path")
