"""Versioned tables, and what is kept in them: previews of patches, patched files, snapshots.

A version is written into a folder of its own and becomes the current one by an empty marker file beside it, made in one
operation; a reader takes the highest marker. So a reader sees a whole version or the one before, a task or job
that failed leaves nothing to be seen, and the same version written again (the replay of a micro-batch) changes nothing.
One writer at a time is assumed, as for a streaming checkpoint.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "current-"


def _open(spark: SparkSession, root: str):  # noqa: ANN202
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """The published versions of a table, ascending."""
    path, fs = _open(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(m.group(1)) for m in (re.fullmatch(MARK + r"(\d+)", n) for n in names) if m)


def folder(root: str, version: int) -> str:
    return f"{root}/v{version}"


def publish(spark: SparkSession, root: str, version: int, write: Callable[[str], None]) -> bool:
    """Has write(folder) fill a version and makes it the current one; False if that version or a later one is published already."""
    published = versions(spark, root)
    if published and published[-1] >= version:
        return False
    path, fs = _open(spark, root)
    new = spark._jvm.org.apache.hadoop.fs.Path(folder(root, version))
    fs.delete(new, True)  # what a failed attempt left
    write(folder(root, version))
    fs.createNewFile(spark._jvm.org.apache.hadoop.fs.Path(path, f"{MARK}{version}"))
    return True


def expire(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Deletes all but the last versions; the one before the current stays for readers that have begun on it."""
    path, fs = _open(spark, root)
    for version in versions(spark, root)[:-keep]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path, f"{MARK}{version}"), False)
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder(root, version)), True)


# --- K13: previews --------------------------------------------------------------------------

PREVIEW = "id string, content string, turn long, bucket int"


def _bucket(id_: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(buckets)).cast("int")


class PreviewStore:
    """Texts by id, the last one of an id counts. Sets are appended to a log that is laid out by buckets of the
    id's hash, and ``compact`` folds log and base into a new version of the base; a lookup of one id reads one bucket of both.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root, buckets

    def _places(self) -> tuple[str | None, str]:
        published = versions(self.spark, f"{self.root}/base")
        at = published[-1] if published else 0
        return folder(f"{self.root}/base", at) if published else None, f"{self.root}/log-{at}"

    def set(self, previews: DataFrame) -> None:
        """previews (id, content, turn): turn orders those of one id. Line ends become \\n."""
        content = F.regexp_replace("content", "\r\n", "\n")
        rows = previews.select(F.col("id").cast("string").alias("id"), content.alias("content"), F.col("turn").cast("long").alias("turn")).where("id is not null").withColumn("bucket", _bucket("id", self.buckets))
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").mode("append").parquet(self._places()[1])

    def _stored(self) -> DataFrame:
        out = None
        for place in self._places():
            path, fs = _open(self.spark, place) if place else (None, None)
            if place and fs.exists(path):
                rows = self.spark.read.schema(PREVIEW).parquet(place)
                out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], PREVIEW) if out is None else out

    @staticmethod
    def _last(rows: DataFrame) -> DataFrame:
        last = F.max(F.struct("turn", "content"))  # of two texts at the same turn the greater one, so that it is always the same
        return rows.groupBy("bucket", "id").agg(last.alias("l")).select("id", F.col("l.content").alias("content"), F.col("l.turn").alias("turn"), "bucket")

    def get(self, id_: str) -> DataFrame:
        """(id, content) of one id, no row if it was never set; only its bucket is read."""
        return self._last(self._stored().where((F.col("bucket") == _bucket(F.lit(id_), self.buckets)) & (F.col("id") == id_))).select("id", "content")

    def get_all(self, wanted: DataFrame) -> DataFrame:
        """(id, content) for each row of wanted (id); empty where nothing was set."""
        keyed = wanted.select("id").distinct().withColumn("bucket", _bucket("id", self.buckets))
        return keyed.join(self._last(self._stored()), ["bucket", "id"], "left").select("id", F.coalesce("content", F.lit("")).alias("content"))

    def compact(self) -> None:
        """Folds the log into a new base; the log begins anew."""
        published = versions(self.spark, f"{self.root}/base")
        rows = self._last(self._stored())
        publish(self.spark, f"{self.root}/base", (published[-1] if published else 0) + 1, lambda at: rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(at))


# --- K9, K14: patched files ------------------------------------------------------------------


def inside(path: str = "path") -> Column:
    """Whether a relative path stays within its root."""
    folded = F.translate(F.col(path), "\\", "/")
    parts = F.filter(F.split(folded, "/"), lambda p: (p != "") & (p != "."))
    # the depth below the root, which stays negative once it has been
    depth = F.aggregate(parts, F.lit(0), lambda at, p: F.when(at < 0, at).when(p == "..", at - 1).otherwise(at + 1))
    return (depth > 0) & ~folded.rlike(r"\A(?:/|[A-Za-z]:)")


def write_files(files: DataFrame, root: str, version: int) -> bool:
    """Publishes files (path, text, action) as a version: first their texts, then a manifest (path, action, size, sha256) made from
    what was written, then the marker. Paths that leave the root are in the manifest as refused and have no text.
    """
    spark = files.sparkSession
    told = files.select("path", F.when(inside(), F.coalesce("text", F.lit(""))).alias("text"), F.when(inside(), F.col("action")).otherwise("refused").alias("action"))

    def write(at: str) -> None:
        told.write.parquet(f"{at}/texts")
        stored = spark.read.schema(told.schema).parquet(f"{at}/texts")
        stored.select("path", "action", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256")).write.parquet(f"{at}/manifest")

    return publish(spark, root, version, write)


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The current manifest; texts are not read."""
    return spark.read.parquet(f"{folder(root, versions(spark, root)[-1])}/manifest")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of the current version, each checked against its digest in the manifest."""
    texts = spark.read.parquet(f"{folder(root, versions(spark, root)[-1])}/texts").where("text is not null").select("path", "text", F.sha2("text", 256).alias("now"))
    joined = texts.join(read_manifest(spark, root).where("sha256 is not null").select("path", "sha256"), "path")
    same = F.when(F.col("now") == F.col("sha256"), F.col("text")).otherwise(F.raise_error(F.lit("a stored text does not match the manifest")))
    return joined.select("path", same.alias("text"))
