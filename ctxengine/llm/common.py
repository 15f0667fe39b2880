"""Helpers shared by the operators: shared-folder tables, skew-proof joins, connected components.

Conventions of all operators here
---------------------------------
* Inputs are narrowed to the columns an operator reads before anything else, so extra
  columns of the caller, whatever their names, can't clash with internal ones.
* Lineage is cut by writing a Parquet table under ``spark.checkpoint.dir`` (``keep``), which
  every executor can read again after another one was lost.
* Nothing that grows with the corpus is collected or broadcast without a size check.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: A key is heavy if it has at least one in so many rows; so there are at most so many heavy keys.
HEAVY = 1000
#: Sides of at most so many narrow rows (a key or two of 8 bytes) are broadcast.
BROADCAST_ROWS = 300_000
#: Rows for each task of a small kept table, and tasks that it has at least.
TASK_ROWS, TASKS = 10_000, 8
#: Rows of an Arrow batch on its way to a Python worker and back.
ARROW_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only a local session may leave it unset: it gets a temporary folder. On a cluster that would be another
    folder on each machine, so it is an error there.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local(?:\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-ctxengine-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/ctxengine/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def drop_kept(spark: SparkSession) -> None:
    """Deletes all tables that this application kept; to be called when no result that reads them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/ctxengine/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a restart point with no lineage behind it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def freeing(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, to be run in Python workers, giving freed memory back to the system at the end of each task.

    Spark uses workers again for later stages; what they hold idle comes on top of the executor's heap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def in_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:  # noqa: ANN001
    """df.mapInArrow(work, schema) in bounded memory: batches of whole texts hold ARROW_ROWS rows, unless the session sets another number than Spark's own."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(ARROW_ROWS))
    return df.mapInArrow(freeing(work), schema)


def small_or(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it was counted at no more than that many rows, else as it is.

    df must be cheap to count (a kept table)."""
    return F.broadcast(df) if df.count() <= rows else df


def join_skewed(left: DataFrame, right: DataFrame, keys: list[str], n_rows: str, spread: Column, how: str = "left") -> DataFrame:
    """left join right on keys, where right has each key once and, in n_rows, how many rows of left have it.

    A key with at least 1/HEAVY of all rows is dealt over several tasks: its left rows get a
    salt from ``spread`` and its right row is repeated for each salt. There are at most HEAVY
    such keys and 2 * HEAVY such copies, which bounds the broadcast and the growth.
    Where right has no more than BROADCAST_ROWS rows, all of it is broadcast, and no row of left
    moves. right must be cheap to read twice (a kept table).
    """
    total, distinct = right.agg(F.coalesce(F.sum(n_rows), F.lit(0)), F.count(F.lit(1))).first()
    if distinct <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), keys, how)
    per_task = max(total // HEAVY, 1000)
    salts = F.when(F.col(n_rows) > per_task, F.ceil(F.col(n_rows) / F.lit(per_task))).otherwise(F.lit(1)).cast("int")
    heavy = right.where(F.col(n_rows) > per_task).select(*keys, salts.alias("_salts"))
    dealt = left.join(F.broadcast(heavy), keys, "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int"), F.lit(0))
    ).drop("_salts")
    spreaded = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.join(spreaded, [*keys, "_salt"], how).drop("_salt")


def few(df: DataFrame, rows: int) -> DataFrame:
    """df, of at most so many narrow rows, in no more tasks than these need: TASK_ROWS each, or TASKS in all if that is more.

    Shuffled rows keep their partitions where there are fewer of these."""
    return df.coalesce(max(TASKS, rows // TASK_ROWS))


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge table as (node, component), component = smallest node.

    Alternates the large-star and small-star steps until all edges are stars, which is so when
    no node with a smaller neighbour has another one; each step is one kept table. A hub's rows
    are pre-aggregated before every shuffle that takes the minimum, and dealt over tasks by
    ``join_skewed`` where its minimum goes back to its rows. Only nodes with an edge are
    returned.
    """
    now = keep(
        edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).where("a < b").distinct(), "cc"
    )
    n = now.count()  # no step makes more edges
    for _ in range(max_rounds):
        # large star: each node's larger neighbours move to its smallest neighbour
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = keep(few(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), 2 * n), "cc-min")
        lowest = F.least("m", "u")
        if not low.where("m < u and n > 1").limit(1).count():
            return low.select(F.col("u").alias("node"), lowest.alias("component"))
        low = low.withColumn("m", lowest)
        large = join_skewed(both.where("v > u"), low, ["u"], "n", F.col("v"), "inner").select(F.col("m").alias("a"), F.col("v").alias("b"))
        large = keep(few(large, n), "cc-large")
        # small star: each node and its smaller neighbours move to the smallest of them
        low = keep(few(large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n")), n), "cc-min")
        moved = join_skewed(large.select(F.col("b").alias("u"), F.col("a").alias("v")), low, ["u"], "n", F.col("v"), "inner")
        now = moved.select(F.col("m").alias("a"), F.col("v").alias("b")).unionAll(low.select(F.col("m").alias("a"), F.col("u").alias("b")))
        now = keep(few(now.where("a < b").distinct(), n), "cc")
    raise RuntimeError("components did not settle")
