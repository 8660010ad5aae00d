from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from brindle.operators import behavior, detect, policy, review
from brindle.sources import frames, views
from brindle.streaming import jobs, state

SF = "/root/testdata/sf0.001"


@pytest.fixture
def map_state(spark):
    for key, value in state.STORE.items():
        spark.conf.set(key, value)
    yield spark
    for key in state.STORE:
        spark.conf.unset(key)


def _detections(spark):
    return views.detections(spark, SF).select("user_id", "detection_id", "created_at", "thread_id", F.col("k").cast("string").alias("kind"), "risk_score").withColumn("user_id", F.col("user_id") % 20)


def _files(rows, path, n):
    """Rows in order of time as n files, so that each micro-batch is one of them."""
    ordered = rows.orderBy("created_at", "detection_id").toPandas()
    step = -(-len(ordered) // n)
    return [rows.sparkSession.createDataFrame(ordered.iloc[i : i + step], rows.schema).coalesce(1) for i in range(0, len(ordered), step)]


def test_behavior_stream_equals_batch_over_batches_and_a_restart(map_state, tmp_path):
    spark, d = map_state, _detections(map_state).drop("risk_score")
    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    for part in _files(d, source, 4):  # every file is a run of its own: the state comes back from the checkpoint
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(d.schema).parquet(source)
        state.behavior_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    names = ["detection_id", "thread_count", "n_user", "n_thread", "n_kinds", "stage3_score", "stage3_labels"]
    want = behavior.stage3_as_documented(d).select(names)
    got = spark.read.parquet(out).select(names)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_a_batch_that_runs_again_is_not_there_twice(spark, tmp_path):
    d = _detections(spark)
    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    parts = _files(d, source, 3)
    run = lambda: state.run_once(spark.readStream.schema(d.schema).parquet(source), lambda rows: rows.select("detection_id"), out, check).awaitTermination()
    for part in parts[:2]:
        part.write.mode("append").parquet(source)
        run()
    # The process ended behind the write and in front of the commit of the last batch.
    last = max(glob.glob(f"{check}/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    os.remove(last)
    crc = f"{check}/commits/.{os.path.basename(last)}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    parts[2].write.mode("append").parquet(source)
    run()
    got = spark.read.parquet(out)
    assert got.count() == d.count() and got.select("detection_id").exceptAll(d.select("detection_id")).isEmpty()


def test_thresholds_that_change_while_a_stream_runs(spark, tmp_path):
    source, out, check, versions = (str(tmp_path / x) for x in ("in", "out", "check", "versions"))
    d = spark.createDataFrame([(1, i, f"2024-01-0{i} 00:00:00", 0.35) for i in range(1, 7)], "user_id long, detection_id long, at string, risk_score double")
    d = d.withColumn("created_at", F.col("at").cast("timestamp")).drop("at")
    run = lambda: state.banded_stream(spark.readStream.schema(d.schema).parquet(source), versions, out, check).awaitTermination()
    policy.thresholds_table(spark, []).write.parquet(versions)
    d.filter("detection_id <= 2").write.mode("append").parquet(source)
    run()
    stricter = policy.Thresholds().updated(allow_max=0.30, nudge_min=0.31, nudge_max=0.60, soft_block_min=0.61, soft_block_max=0.80, hard_block_min=0.81)
    policy.thresholds_table(spark, [("2024-01-04 00:00:00", stricter)]).write.mode("append").parquet(versions)
    d.filter("detection_id > 2").write.mode("append").parquet(source)
    run()
    got = {r.detection_id: (r.risk_band, r.t_version) for r in spark.read.parquet(out).collect()}
    assert got == {1: ("low", 0), 2: ("low", 0), 3: ("low", 0), 4: ("medium", 1), 5: ("medium", 1), 6: ("medium", 1)}
    with pytest.raises(ValueError):
        policy.Thresholds().updated(allow_max=0.9)
    banded = spark.readStream.schema(spark.read.parquet(out).drop("batch_id").schema).parquet(f"{out}/batch_id=*")
    assert "strike_number" in jobs.strike_stream(banded).columns


def test_versions_that_are_no_rising_edges_hold_never(spark):
    d = _detections(spark)
    bad = spark.createDataFrame([(7, "2000-01-01 00:00:00", 0.9, 0.6, 0.8), (8, "2000-01-01 00:00:00", 0.1, 0.6, 1.8)], "version int, at string, allow_max double, nudge_max double, soft_block_max double")
    bad = bad.withColumn("activated_at", F.col("at").cast("timestamp"))
    got = policy.enforce_as_of(d.withColumn("labels", F.array("thread_id")), bad)
    want = policy.enforce(d.withColumn("labels", F.array("thread_id")))
    assert got.count() == want.count() and got.select("detection_id", "action").exceptAll(want.select("detection_id", "action")).isEmpty()


def test_salted_days_give_the_same(spark, monkeypatch):
    d = _detections(spark)
    v = policy.thresholds_table(spark, [("2024-01-05 00:00:00", policy.Thresholds()), ("2024-01-15 10:00:00", policy.Thresholds(allow_max=0.2))])
    want = policy.band_as_of(d, v).collect()
    monkeypatch.setattr(policy, "FEW_VERSIONS", 0)
    assert sorted(policy.band_as_of(d, v).collect()) == sorted(want) and len(want) == d.count()


def test_a_busy_user_is_many_tasks(spark):
    d = spark.range(20_000).select(F.lit(1).alias("user_id"), F.col("id").alias("detection_id"), (F.col("id") % 3).cast("string").alias("thread_id"), F.timestamp_seconds(F.col("id") * 600).alias("created_at"), (F.col("id") % 5).cast("string").alias("kind"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = behavior.with_history(d, kind="kind")
        per = out.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(per) >= 4 and max(r["count"] for r in per) < 12_000
    last = out.orderBy(F.col("detection_id").desc()).first()
    assert (last.n_user, last.n_thread, last.thread_count, last.n_kinds, last.gap) == (19_999, 6666, 3, 5, 1800.0)


def test_history_with_nulls_and_ties(spark):
    rows = [(None, 1, None, "2024-01-01 00:00:00", None), (None, 2, None, "2024-01-01 00:00:00", None), (1, 3, "a", None, "x"), (1, 4, "a", "2024-01-01 00:00:00", "x"), (1, 5, "b", "2024-01-03 00:00:00", None)]
    d = spark.createDataFrame(rows, "user_id long, detection_id long, thread_id string, at string, kind string").withColumn("created_at", F.col("at").cast("timestamp"))
    got = {r.detection_id: (r.thread_count, r.n_user, r.n_thread, r.n_kinds) for r in behavior.with_history(d, kind="kind").collect()}
    assert got == {1: (1, 0, 0, 0), 2: (1, 1, 1, 1), 3: (1, 0, 0, 0), 4: (1, 1, 1, 1), 5: (2, 2, 0, 0)}
    assert behavior.with_history(d.filter("false"), kind="kind").count() == 0


def test_requests_beyond_the_cap_are_refused(spark):
    e = [(i, "assign", 1, 100 + i) for i in range(4)] + [(4, "resolve", None, 100), (5, "assign", 1, 104), (6, "assign", 1, 105), (7, "unassign", 1, 101), (8, "assign", 1, 102), (9, "assign", 2, 101), (10, "resolve", None, 999), (11, "assign", None, 1)]
    events = spark.createDataFrame(e, "seq long, kind string, moderator long, case_id long")
    got = [(r.seq, r.moderator, r.admitted, r.load) for r in review.admissions(events, capacity=3).orderBy("seq").collect()]
    assert got == [(0, 1, True, 1), (1, 1, True, 2), (2, 1, True, 3), (3, 1, False, 3), (4, 1, None, 2), (5, 1, True, 3), (6, 1, False, 3), (7, 1, None, 2), (8, 1, True, 2), (9, 2, True, 1)]


FRAMES = [
    '{"type": "intercept", "request_id": "r1", "message": {"message_id": "m", "user_id": "u", "thread_id": "t", "content": "hi", "ts": "2024-01-01T00:00:00Z", "more": 1}, "also": []}',
    '{"type": "intercept", "message": {"content": "hi"}}', '{"type": "intercept", "request_id": "", "message": {"content": "hi"}}',
    '{"type": "ping", "request_id": "r2", "message": {"content": "hi"}}', '{"request_id": "r3"}', '{"type": "intercept", "request_id": "r4", "message": {"content": ""}}',
    '{"type": "intercept", "request_id": "r5"}', "not json", "[1]", "5", "", None, '{"type": "intercept", "mess',
]


def _check_frames(good, dead):
    assert {r.reason: r["count"] for r in dead.groupBy("reason").count().collect()} == {"not_json": 6, "invalid_type": 2, "missing_content": 2}
    rows = good.collect()
    assert len(rows) == 3 and len({r.request_id for r in rows}) == 3 and all(r.content == "hi" and r.request_id for r in rows)
    assert {r.request_id for r in dead.filter("reason <> 'not_json'").collect()} == {"r2", "r3", "r4", "r5"}


def test_frames_of_a_batch_and_of_a_stream(spark, tmp_path):
    raw = spark.createDataFrame([(f,) for f in FRAMES], "value string")
    _check_frames(*frames.split_frames(raw))
    raw.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in"))
    found = []
    for name, part in zip(("good", "dead"), frames.split_frames(stream), strict=True):
        part.writeStream.format("memory").queryName(f"frames_{name}").trigger(availableNow=True).start().awaitTermination()
        found.append(spark.table(f"frames_{name}"))
    _check_frames(*found)


def test_batches_in_order_and_beyond_the_limit(spark):
    row = lambda b, p, u, text, minute: (b, p, f"{b}-{p}", "t", u, text, f"2024-01-01 00:{minute:02d}:00", "phone")
    rows = [row(1, i, "u1", "call me at 555-123-4567", 0) for i in range(5)] + [row(2, i, "u2", "hello", 1) for i in range(51)] + [row(3, 0, "u1", "hello", 30), row(3, 1, "u3", "hello", 30)]
    d = spark.createDataFrame(rows, "batch_id int, position int, message_id string, thread_id string, user_id string, content string, at string, kind string").withColumn("created_at", F.col("at").cast("timestamp"))
    results, refused = detect.analyze_batches(d)
    assert [(r.batch_id, r.n, r.reason) for r in refused.collect()] == [(2, 51, "batch_too_large")]
    got = {r.message_id: (r.n_thread, r.stage3_score, r.labels) for r in results.collect()}
    assert len(got) == 7 and [got[f"1-{i}"][0] for i in range(5)] == [0, 1, 2, 3, 4] and got["3-0"][0] == 5 and got["3-1"][:2] == (0, 0.0)
    assert "burst_attempts" in got["1-2"][2] and "persistent_contact_attempts" in got["1-4"][2] and "persistent_contact_attempts" in got["3-0"][2]


def test_late_rows_and_sliding_windows(spark, tmp_path):
    """Rows behind the watermark are dropped, rows within it counted; a row is in every window that slides over it."""
    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    at = lambda *times: spark.createDataFrame([(t, "x") for t in times], "at string, event_type string").select(F.col("at").cast("timestamp").alias("ts"), "event_type")
    for part in (at("2024-01-01 00:10:00"), at("2024-01-01 01:55:00"), at("2024-01-01 00:20:00", "2024-01-01 01:50:00"), at("2024-01-01 06:00:00"), at("2024-01-01 06:01:00")):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = jobs.windowed_counts(spark.readStream.schema(part.schema).parquet(source), "1 hour", "30 minutes", "10 minutes")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {r.start.strftime("%d %H:%M"): r.events for r in spark.read.parquet(out).collect()}
    assert got == {"31 23:30": 1, "01 00:00": 1, "01 01:00": 2, "01 01:30": 2}
