"""Change streams that run: bursts, token updates that a newer request cancels, last values, snapshots.

Every stream here can be stopped at any moment and started again from its checkpoint: sinks are files that Spark commits with the
batch, or versions that a replayed batch does not write twice. State is in RocksDB.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources import store
from .changes import bursts

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
# The pause before an update starts, that between two of its parts, paths in a part, and paths of an update at most.
DELAY_MS, PAUSE_MS, PART, MOST_PATHS = 800, 50, 20, 10_000


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's own settings come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    try:
        for k, v in ROCKSDB.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends all that is available to files and stops; what comes later is for the next call with this checkpoint."""
    with rocksdb(stream.sparkSession):
        q = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()


# --- ST1, ST2 -------------------------------------------------------------------------------


def live_bursts(changes: DataFrame, gap: str = "1 second", late: str = "10 minutes") -> DataFrame:
    """ST1, ST2: a row for each burst, as soon as the watermark says that no change can prolong it."""
    return bursts(changes, gap, late)


# --- ST3 ------------------------------------------------------------------------------------


def due(requests: list[tuple[int, int, int, int]], until: int | None, delay: int = DELAY_MS, pause: int = PAUSE_MS, part: int = PART) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]], int | None]:
    """What of requests (ts, id, paths, parts already reported) happens up to ``until`` (None: all): (reported (id, part, paths; part -1: complete), what is left, when the next thing happens).

    A request starts ``delay`` after it came, unless another came meanwhile; then it reports a part at once and another after each pause, and
    is complete one pause after the last. The start of a newer request ends it. All that came by ``until`` must be known.
    A newer request that starts only after ``until`` ends nothing yet, as another may still come in its place.
    """
    requests = sorted(requests)
    out, left, upcoming = [], [], None
    started = [r for r, after in zip(requests, [*requests[1:], None]) if after is None or after[0] - r[0] >= delay]
    for r, after in zip(started, [*started[1:], None]):
        ts, id_, paths, reported = r
        parts = -(-paths // part)
        end = None if after is None else after[0] + delay
        k = reported
        while k <= parts:
            at = ts + delay + k * pause
            if end is not None and at >= end:
                if until is not None and end > until:
                    left.append((ts, id_, paths, k))
                    upcoming = end if upcoming is None else min(upcoming, end)
                break  # cancelled, or so if the newer one does start
            if until is not None and at > until:
                left.append((ts, id_, paths, k))
                upcoming = at if upcoming is None else min(upcoming, at)
                break
            out.append((id_, k, min(part, paths - k * part)) if k < parts else (id_, -1, paths))
            k += 1
    return out, left, upcoming


class TokenUpdates(StatefulProcessor):
    """ST3: the requests of a key that are not finished are its state; an event-time timer stands at the next thing that happens to them."""

    def __init__(self, delay: int, pause: int, part: int):
        self.delay, self.pause, self.part = delay, pause, part

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.requests = handle.getListState("requests", "ts long, id long, paths int, reported int")

    def _set_timer(self, at: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        held = [tuple(r) for r in self.requests.get()] if self.requests.exists() else []
        held += [(r.at_ms, r.request_id, min(r.paths, MOST_PATHS), 0) for r in rows]
        self.requests.put(held)
        # nothing is reported before the watermark has passed it, as an earlier request may still come
        self._set_timer(due(held, -1, self.delay, self.pause, self.part)[2])
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201, N802, N803
        held = [tuple(r) for r in self.requests.get()] if self.requests.exists() else []
        found, left, upcoming = due(held, timerValues.getCurrentWatermarkInMs(), self.delay, self.pause, self.part)
        if left:
            self.requests.put(left)
        else:
            self.requests.clear()
        self._set_timer(upcoming)
        for id_, k, n in found:
            yield Row(key=key[0], request_id=id_, part=k, paths=n)

    def close(self) -> None:
        pass


def nearest_ms(ts: Column) -> Column:
    """Milliseconds of a time, rounded as SQL's epoch_ms does."""
    return F.round(F.unix_micros(ts) / 1000).cast("long")


def token_updates(requests: DataFrame, delay: int = DELAY_MS, pause: int = PAUSE_MS, part: int = PART, late: str = "10 minutes") -> DataFrame:
    """ST3 over a stream of requests (key long, ts, request_id, paths): (key, request_id, part, paths): the parts that a request gets to report, and
    its completion as part -1 with all its paths."""
    timed = requests.withWatermark("ts", late).select("key", "ts", nearest_ms(F.col("ts")).alias("at_ms"), "request_id", F.col("paths").cast("int").alias("paths"))
    return timed.groupBy("key").transformWithState(TokenUpdates(delay, pause, part), "key long, request_id long, part int, paths int", "append", "eventTime")


# --- ST4 ------------------------------------------------------------------------------------


class LastValue(StatefulProcessor):
    """ST4: keeps the last content of a key, for good."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "content string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        known = self.last.exists()
        last = self.last.get()[0] if known else None
        for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
            if not known or r.content != last:
                yield Row(key=key[0], event_id=r.event_id, content=r.content)
            known, last = True, r.content
        self.last.update((last,))

    def close(self) -> None:
        pass


def live_changes(changes: DataFrame) -> DataFrame:
    """F19, ST4 over a stream of (key long, ts, event_id, content): the changes of a key whose content isn't that of the one before."""
    rows = changes.select("key", "ts", "event_id", "content")
    return rows.groupBy("key").transformWithState(LastValue(), "key long, event_id long, content string", "append", "none")


# --- ST5 ------------------------------------------------------------------------------------


def refresh(spark: SparkSession, root: str, modified: DataFrame, batch_id: int) -> bool:
    """ST5: replaces the snapshot of modified keys as version batch_id + 1; a batch that was written before writes nothing."""
    return store.publish(spark, root, batch_id + 1, lambda at: modified.write.parquet(at))


def current_snapshot(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The snapshot as it is now; empty before the first refresh."""
    published = store.versions(spark, root)
    return spark.read.schema(schema).parquet(store.folder(root, published[-1])) if published else spark.createDataFrame([], schema)


def live_snapshot(changes: DataFrame, modified: str, root: str, out: str, checkpoint: str) -> None:
    """ST5: each batch of changes (key, content) replaces the snapshot by the keys whose change is ``modified``, and asks for all its keys
    whether the snapshot holds them; the answers of a batch (batch, key, modified) are a version of their own, so a replayed batch answers once."""

    def batch(df: DataFrame, batch_id: int) -> None:
        session = df.sparkSession
        refresh(session, root, df.where(F.col("content") == modified).select("key").distinct(), batch_id)
        seen = df.select("key").distinct().join(current_snapshot(session, root, "key long").withColumn("modified", F.lit(True)), "key", "left")
        answers = seen.select(F.lit(batch_id).cast("int").alias("batch"), "key", F.coalesce("modified", F.lit(False)).alias("modified"))
        store.publish(session, f"{out}/{batch_id}", 1, lambda at: answers.write.parquet(at))

    q = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
