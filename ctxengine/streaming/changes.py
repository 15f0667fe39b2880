"""Change streams: bursts of events, changed content, snapshots.

Each function takes a DataFrame that may be a stream; a watermark is set only for streams, as a
batch keeps all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bursts(changes: DataFrame, gap: str = "1 second", late: str = "10 minutes") -> DataFrame:
    """ST1, ST2, ST3: (key, start, end, n, last): one row for each run of changes with no pause longer than the gap; last: the content of the latest one."""
    timed = changes.withWatermark("ts", late) if changes.isStreaming else changes
    w = F.session_window("ts", gap)
    out = timed.groupBy("key", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("ts", "content")).alias("l"))
    return out.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", F.col("l.content").alias("last"))


#: Rows of a slice of time, so that a key with many changes is not one task's.
SLICE_ROWS = 200_000


def content_changes(changes: DataFrame, order: list[Column], by: str = "ts", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """F19, ST4 over a batch: the changes of a key whose content isn't that of the one before. ``by``, a timestamp, comes first in the order.

    Keys are cut by slices of time with about slice_rows rows each, at quantiles of the whole table; within a slice the change before is
    the row before, and a slice's first row looks at how the key's slices before it ended.
    """
    n = changes.count()
    cuts = changes.select(F.unix_micros(by).alias("t")).approxQuantile("t", [i / (n // slice_rows + 1) for i in range(1, n // slice_rows + 1)], 0.25 / (n // slice_rows + 1)) if n > slice_rows else []
    piece = F.lit(0)
    for i, cut in enumerate(sorted(set(cuts))):
        piece = F.when(F.unix_micros(by) >= int(cut), i + 1).otherwise(piece)
    cut_up = changes.withColumn("_slice", piece).withColumn("_order", F.struct(*order))
    in_slice = Window.partitionBy("key", "_slice").orderBy("_order")
    rows = cut_up.withColumn("_n", F.row_number().over(in_slice)).withColumn("_before", F.lag("content").over(in_slice))
    if not cuts:
        first = F.col("_n") == 1
        return rows.where(first | ~F.col("_before").eqNullSafe(F.col("content"))).drop("_slice", "_order", "_n", "_before")
    ends = cut_up.groupBy("key", "_slice").agg(F.max_by(F.struct("content"), "_order").alias("_end"))
    ends = ends.select(F.col("key").alias("_key"), F.col("_slice").alias("_at"), F.lag("_end").over(Window.partitionBy("key").orderBy("_slice")).alias("_end"))  # a row for each key and slice
    joined = rows.join(ends, (F.col("_slice") == F.col("_at")) & F.col("key").eqNullSafe(F.col("_key"))).drop("_at", "_key")
    first = F.col("_n") == 1
    changed = F.when(first, F.col("_end").isNull() | ~F.col("_end.content").eqNullSafe(F.col("content"))).otherwise(~F.col("_before").eqNullSafe(F.col("content")))
    return joined.where(changed).drop("_slice", "_order", "_n", "_before", "_end")


def refresh_snapshot(modified: DataFrame, path: str) -> DataFrame:
    """ST5 over a batch: replaces the snapshot and returns what membership tests read."""
    modified.write.mode("overwrite").parquet(path)
    return modified.sparkSession.read.schema(modified.schema).parquet(path)


def is_modified(files: DataFrame, snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """ST5: files with whether the snapshot has them."""
    return files.join(snapshot.select(*keys).distinct().withColumn("modified", F.lit(True)), keys, "left").withColumn("modified", F.coalesce("modified", F.lit(False)))
