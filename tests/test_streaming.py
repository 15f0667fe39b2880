"""Streams and versioned stores: restarts, replays, failures, and brute force of what they compute."""

from __future__ import annotations

import random

import pytest
from conftest import SF
from pyspark.sql import functions as F

from ctxengine.sources import store
from ctxengine.sources.tables import changes
from ctxengine.streaming import live
from ctxengine.streaming.changes import bursts, content_changes, is_modified


def tick(source):
    return source.limit(1).withColumn("key", F.lit(-1).cast("long")).withColumn("ts", F.lit("2100-01-01").cast("timestamp"))


def parts_of(source, n):
    """The rows in n parts of their time, as they would arrive, and the row that comes last."""
    span = source.agg(F.min("event_id").alias("a"), F.max("event_id").alias("z")).first()
    step = (span["z"] - span["a"]) // n + 1
    return [source.where(F.floor((F.col("event_id") - span["a"]) / step) == i) for i in range(n)] + [tick(source)]


def stream_of(spark, place, source):
    return spark.readStream.schema(source.schema).parquet(str(place))


# --- ST1, ST2: bursts over a restart -------------------------------------------------------------


def test_bursts_survive_restarts_in_the_middle_of_a_burst(spark, tmp_path):
    source = changes(spark, SF).where("key < 12")
    want = {tuple(r) for r in bursts(source, "2 hours").select("key", "start", "n").collect()}
    seen, out = [], str(tmp_path / "out")
    for part in parts_of(source, 4):  # each run is a new query that goes on from the checkpoint
        part.write.mode("append").parquet(str(tmp_path / "in"))
        live.run_to_files(live.live_bursts(stream_of(spark, tmp_path / "in", source), "2 hours"), out, str(tmp_path / "state"))
        seen.append(spark.read.parquet(out).count())
    got = [tuple(r) for r in spark.read.parquet(out).where("key <> -1").select("key", "start", "n").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert 0 < seen[1] < seen[3] < len(want) + 1  # rows came as they were due, not all at the end


def test_a_run_without_news_adds_nothing(spark, tmp_path):
    source = changes(spark, SF).where("key < 5")
    source.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        live.run_to_files(live.live_changes(stream_of(spark, tmp_path / "in", source)), str(tmp_path / "out"), str(tmp_path / "state"))
    want = {tuple(r) for r in content_changes(source, [F.col("ts"), F.col("event_id")]).select("key", "event_id", "content").collect()}
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


# --- ST3 ------------------------------------------------------------------------------------------


def simulated(requests, delay, pause, part):
    """The token update as a clock: each millisecond a timer, a new request, or the next part of the running one."""
    out, waiting, running = [], None, None
    by_time = {}
    for ts, id_, paths in sorted(requests):
        by_time.setdefault(ts, []).append((id_, paths))
    for now in range(min(by_time), max(by_time) + delay + pause * 20 + 1):
        if waiting and now == waiting[0] + delay:
            running, waiting = [now, waiting[1], waiting[2], 0], None
        if running and now == running[0] + running[3] * pause:
            _, id_, paths, k = running
            if k * part < paths:
                out.append((id_, k, min(part, paths - k * part)))
                running[3] += 1
            else:
                out.append((id_, -1, paths))
                running = None
        for id_, paths in by_time.get(now, []):
            waiting = (now, id_, paths)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_due_equals_a_simulated_clock_however_the_watermark_moves(seed):
    r = random.Random(seed)
    requests = [(r.randrange(300), i, r.randrange(9)) for i in range(r.randint(1, 12))]
    delay, pause, part = r.choice([(10, 3, 2), (5, 8, 3), (20, 1, 4)])
    want = simulated(requests, delay, pause, part)
    assert sorted(live.due([(*x, 0) for x in requests], None, delay, pause, part)[0]) == sorted(want)
    got, held, at, coming = [], [], 0, sorted(requests)
    while coming or held:
        at += r.randint(1, 40)
        held += [(*x, 0) for x in coming if x[0] < at]
        coming = [x for x in coming if x[0] >= at]
        found, held, upcoming = live.due(held, at - 1, delay, pause, part)
        assert upcoming is None or upcoming >= at
        got += found
    assert sorted(got) == sorted(want)


def test_a_request_that_never_starts_cancels_nothing():
    # 2 would end 1 at 25, but 3 comes before and takes its place until 30, so 1 is complete at 26
    found, held, upcoming = live.due([(0, 1, 3, 0), (15, 2, 3, 0)], 19, 10, 8, 2)
    assert found == [(1, 0, 2), (1, 1, 1)] and upcoming == 25
    assert live.due([*held, (20, 3, 0, 0)], None, 10, 8, 2)[0] == [(1, -1, 3), (3, -1, 0)]
    assert live.due(held, None, 10, 8, 2)[0] == [(2, 0, 2), (2, 1, 1), (2, -1, 3)]


def test_times_of_requests_are_rounded_as_in_sql(spark, duck):
    times = ["2024-01-01 00:00:00.000499", "2024-01-01 00:00:00.0005", "2024-01-01 00:00:00.0015", "1969-12-31 23:59:59.9995", "1969-12-31 23:59:59.9996"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp").alias("ts"))
    got = [r["ms"] for r in df.select(live.nearest_ms(F.col("ts")).alias("ms")).collect()]
    assert got == [duck.execute(f"SELECT epoch_ms(TIMESTAMP '{t}')").fetchone()[0] for t in times]


def test_a_newer_request_cancels_the_older_one_over_a_stream(spark, tmp_path):
    rows = [(1, 0, 10, 50), (1, 500, 11, 50), (1, 3000, 12, 70), (1, 3850, 13, 5), (2, 0, 20, 0), (2, 60_000, 21, 20_000)]
    schema = "key long, ts timestamp, request_id long, paths int"
    source = spark.createDataFrame([(k, __import__("datetime").datetime.fromtimestamp(1_700_000_000 + t / 1000), i, n) for k, t, i, n in rows], schema)
    for part in (source.where("request_id in (10, 11, 20)"), source.where("request_id in (12, 13, 21)"), tick(source)):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        live.run_to_files(live.token_updates(stream_of(spark, tmp_path / "in", source)), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where("key <> -1").collect()}
    assert {g for g in got if g[0] == 1} == {(1, 11, 0, 20), (1, 11, 1, 20), (1, 11, 2, 10), (1, 11, -1, 50), (1, 12, 0, 20), (1, 12, 1, 20), (1, 12, 2, 20), (1, 12, 3, 10), (1, 12, -1, 70), (1, 13, 0, 5), (1, 13, -1, 5)}
    assert {(2, 20, -1, 0), (2, 21, -1, 10_000), (2, 21, 499, 20)} <= got and (2, 21, 500, 20) not in got  # no paths; at most 10,000


# --- ST4 ------------------------------------------------------------------------------------------


def test_content_changes_in_slices_of_a_hot_key(spark):
    r = random.Random(8)
    rows = [(r.choice([1, 1, 1, 2, None]), t // 3, t, r.choice(["a", "b", None])) for t in range(600)]
    df = spark.createDataFrame(rows, "key long, s long, event_id long, content string").select("key", F.timestamp_seconds("s").alias("ts"), "event_id", "content")
    last, want = {}, set()
    for key, _, event_id, content in rows:
        if key not in last or last[key] != content:
            want.add((key, event_id, content))
        last[key] = content
    order = [F.col("ts"), F.col("event_id")]
    for n in (10, 50, 10_000):
        got = [tuple(x) for x in content_changes(df, order, slice_rows=n).select("key", "event_id", "content").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert not content_changes(df.limit(0), order).count()


# --- ST5 and versions -----------------------------------------------------------------------------


def test_a_replayed_batch_writes_no_second_snapshot(spark, tmp_path):
    root = str(tmp_path / "snap")
    rows = lambda *keys: spark.createDataFrame([(k,) for k in keys], "key long")
    now = lambda: {r["key"] for r in live.current_snapshot(spark, root, "key long").collect()}
    assert now() == set()
    assert live.refresh(spark, root, rows(1, 2), 0) and now() == {1, 2}
    assert live.refresh(spark, root, rows(3), 1) and now() == {3}
    assert not live.refresh(spark, root, rows(9), 1) and not live.refresh(spark, root, rows(9), 0) and now() == {3}
    got = {r["key"]: r["modified"] for r in is_modified(rows(1, 3), live.current_snapshot(spark, root, "key long"), ["key"]).collect()}
    assert got == {1: False, 3: True}
    for k in range(2, 6):
        live.refresh(spark, root, rows(k), k)
    store.expire(spark, root)
    assert store.versions(spark, root) == [5, 6] and now() == {5}


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    root = str(tmp_path / "files")
    files = spark.createDataFrame([("a/b.md", "text", "kept"), ("a/../../x", "no", "created"), ("/etc/x", "no", "created"), ("C:\\x", "no", "created"), ("a/../c.md", None, "created"), ("..\\y", "no", "created"), (".", "no", "created")], "path string, text string, action string")
    assert store.write_files(files, root, 1)
    before = {tuple(r) for r in store.read_files(spark, root).collect()}
    assert before == {("a/b.md", "text"), ("a/../c.md", "")}
    assert {r["path"]: r["action"] for r in store.read_manifest(spark, root).collect()} == {"a/b.md": "kept", "a/../c.md": "created", "a/../../x": "refused", "/etc/x": "refused", "C:\\x": "refused", "..\\y": "refused", ".": "refused"}

    def half(at):
        files.write.parquet(f"{at}/texts")
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        store.publish(spark, root, 2, half)
    assert store.versions(spark, root) == [1] and {tuple(r) for r in store.read_files(spark, root).collect()} == before
    assert store.write_files(files.where("action = 'kept'"), root, 2)  # the same version again, over what was left
    assert {tuple(r) for r in store.read_files(spark, root).collect()} == {("a/b.md", "text")}


def test_a_changed_text_does_not_pass_the_manifest(spark, tmp_path):
    root = str(tmp_path / "files")
    store.write_files(spark.createDataFrame([("a", "text", "kept")], "path string, text string, action string"), root, 1)
    spark.createDataFrame([("a", "other", "kept")], "path string, text string, action string").write.mode("overwrite").parquet(f"{root}/v1/texts")
    with pytest.raises(Exception, match="does not match the manifest"):
        store.read_files(spark, root).collect()


def test_previews(spark, tmp_path):
    s = store.PreviewStore(spark, str(tmp_path / "previews"), buckets=4)
    assert not s.get("a").count()
    put = lambda *rows: s.set(spark.createDataFrame(list(rows), "id string, content string, turn long"))
    put(("a", "1\r\n2", 1), ("b", "x", 1), (None, "n", 1))
    assert s.get("a").collect()[0]["content"] == "1\n2"
    s.compact()
    put(("a", "new", 2), ("b", "older", 0), ("c", "", 1))
    wanted = spark.createDataFrame([(x,) for x in ("a", "b", "c", "none", "a")], "id string")
    want = {"a": "new", "b": "x", "c": "", "none": ""}
    assert {r["id"]: r["content"] for r in s.get_all(wanted).collect()} == want
    s.compact()
    s.compact()
    assert {r["id"]: r["content"] for r in s.get_all(wanted).collect()} == want
    plan = s.get("a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan  # one bucket is read
