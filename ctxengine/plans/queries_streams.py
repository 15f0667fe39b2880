"""Queries over streams that are stopped and started again: the events arrive in three parts, ten days each, and each part is a run of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from ..sources import store
from ..sources.tables import changes, table
from ..streaming import live
from .catalog import query

PARTS = 3
SLICE = "least((dayofmonth(ts) - 1) // 10, 2)"
#: The key of the row that comes last and lets the watermark pass all others.
TICK = -1
TOKEN_DELAY, TOKEN_PAUSE = 7_200_000, 3_600_000


def _in_parts(rows: DataFrame, run: Callable[[DataFrame], None], tick: bool = True) -> None:
    """Lets rows (key, ts, ...) arrive part by part, each followed by a run over a stream of all that has arrived."""
    spark = rows.sparkSession
    incoming = shared_path(spark, "incoming")
    last = rows.limit(1).withColumn("key", F.lit(TICK).cast("long")).withColumn("ts", F.lit("2100-01-01").cast("timestamp"))
    part = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(PARTS - 1))
    for news in [*(rows.where(part == i) for i in range(PARTS)), *([last] if tick else [])]:
        news.write.mode("append").parquet(incoming)
        run(spark.readStream.schema(rows.schema).parquet(incoming))


def _streamed(rows: DataFrame, name: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    spark = rows.sparkSession
    out, checkpoint = shared_path(spark, name), shared_path(spark, f"{name}-state")
    _in_parts(rows, lambda stream: live.run_to_files(work(stream), out, checkpoint))
    return spark.read.parquet(out).where(F.col("key") != TICK)


@query(
    "stream_bursts", "ST1 ST2",
    """WITH e AS (SELECT user_id AS key, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e)
      SELECT key, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*)::BIGINT AS n FROM s GROUP BY key, sid""",
)
def stream_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _streamed(changes(spark, sf_dir), "bursts", lambda s: live.live_bursts(s, "2 hours"))
    return found.select("key", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


@query(
    "stream_token_updates", "ST3",
    f"""WITH r AS (SELECT user_id AS key, event_id AS id, epoch_ms(ts) AS t, (event_id % 90)::INTEGER AS paths, lead(epoch_ms(ts)) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS after FROM events),
      s AS (SELECT *, t + {TOKEN_DELAY} AS begins, lead(t) OVER (PARTITION BY key ORDER BY t, id) + {TOKEN_DELAY} AS ends FROM r WHERE after IS NULL OR after - t >= {TOKEN_DELAY}),
      p AS (SELECT *, (paths + 19) // 20 AS parts, unnest(range((paths + 19) // 20 + 1)) AS k FROM s)
      SELECT key, id AS request_id, (CASE WHEN k = parts THEN -1 ELSE k END)::INTEGER AS part, (CASE WHEN k = parts THEN paths ELSE least(20, paths - 20 * k) END)::INTEGER AS paths FROM p WHERE ends IS NULL OR begins + k * {TOKEN_PAUSE} < ends""",
)
def stream_token_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests of up to 89 paths; a newer one cancels what has not been reported."""
    requests = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("request_id"), (F.col("event_id") % 90).cast("int").alias("paths"))
    return _streamed(requests, "updates", lambda s: live.token_updates(s, TOKEN_DELAY, TOKEN_PAUSE))


@query(
    "stream_changes", "ST4 F19",
    "SELECT key, event_id, content FROM (SELECT user_id AS key, event_id, event_type AS content, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM content",
)
def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(changes(spark, sf_dir), "changes", live.live_changes)


@query("stream_snapshot", "ST5", f"SELECT ({SLICE})::INTEGER AS batch, user_id AS key, bool_or(event_type = 'error') AS modified FROM events GROUP BY ALL")
def stream_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part of the events replaces the snapshot of the users with an error, and all its users are looked up in it."""
    root, out, checkpoint = (shared_path(spark, f"snapshot-{x}") for x in ("root", "out", "state"))
    _in_parts(changes(spark, sf_dir), lambda stream: live.live_snapshot(stream, "error", root, out, checkpoint), tick=False)
    return spark.read.schema("batch int, key long, modified boolean").option("recursiveFileLookup", "true").parquet(out)


@query(
    "preview_store", "K13",
    """SELECT 'p' || conv_id AS id, replace(arg_max(text, turn), chr(13) || chr(10), chr(10)) AS content FROM conversations WHERE text IS NOT NULL GROUP BY conv_id UNION ALL SELECT DISTINCT 'q' || conv_id, '' FROM conversations""",
)
def preview_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation are set one after the other under its id, with the log folded into the base in between; then all ids and as many that nothing was set under are looked up."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    previews = c.select(F.concat(F.lit("p"), F.col("conv_id").cast("string")).alias("id"), F.col("text").alias("content"), "turn")
    kept = store.PreviewStore(spark, shared_path(spark, "previews"), buckets=16)
    kept.set(previews.where("turn % 2 = 1"))
    kept.compact()
    kept.set(previews.where("turn % 2 = 0"))
    every = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return kept.get_all(every.select(F.explode(F.array(*(F.concat(F.lit(x), F.col("conv_id").cast("string")) for x in "pq"))).alias("id")))


@query(
    "patch_write", "K9 K14",
    """WITH w AS (SELECT 'src/f' || doc_id || '.md' AS path, CASE WHEN quality = 1 THEN 'new' ELSE text END AS text, CASE WHEN quality = 1 THEN 'replaced' ELSE 'kept' END AS action FROM documents LEFT JOIN labels USING (doc_id)
      UNION ALL SELECT CASE WHEN doc_id % 2 = 0 THEN 'made/f' ELSE 'made/../../f' END || doc_id || '.md', 'new', CASE WHEN doc_id % 2 = 0 THEN 'created' ELSE 'refused' END FROM labels WHERE toxic = 1)
      SELECT path, action, CASE WHEN action <> 'refused' THEN strlen(coalesce(text, '')) ELSE 0 END::BIGINT AS size, CASE WHEN action <> 'refused' THEN sha256(coalesce(text, '')) ELSE '' END AS sha256, CASE WHEN action <> 'refused' THEN coalesce(text, '') ELSE '' END AS text FROM w""",
)
def patch_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patched and made files are written as a version, and read back with their manifest; writing the version again changes nothing."""
    from ..operators.patch import apply_patches

    labels = table(spark, sf_dir, "labels")
    named = lambda folder: F.concat(F.lit(folder), F.col("doc_id").cast("string"), F.lit(".md")).alias("path")
    made = labels.where("toxic = 1").select(F.when(F.col("doc_id") % 2 == 0, named("made/f")).otherwise(named("made/../../f")).alias("path"))
    new = labels.where("quality = 1").select(named("src/f")).unionByName(made).withColumn("code", F.lit("new"))
    patched = apply_patches(table(spark, sf_dir, "documents").select(named("src/f"), "text"), new)
    root = shared_path(spark, "patched")
    store.write_files(patched, root, 1)
    store.write_files(patched.limit(0), root, 1)  # a repeated write of a version that is there
    read = store.read_manifest(spark, root).join(store.read_files(spark, root), "path", "left")
    return read.select("path", "action", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("sha256", F.lit("")).alias("sha256"), F.coalesce("text", F.lit("")).alias("text"))
