from __future__ import annotations

import json

from pyspark.sql import functions as F

from brindle.operators import policy
from brindle.sources import views
from brindle.streaming import jobs

SF = "/root/testdata/sf0.001"


def _stream(spark, df, tmp_path, name):
    df.write.parquet(str(tmp_path / name))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / name))


def _run(stream, name, spark):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_gate_stream_equals_batch(spark, tmp_path):
    m = views.conversation_messages(spark, SF)
    q = jobs.write_gate_stream(_stream(spark, m, tmp_path, "in"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    info = jobs.stream_info(q)
    assert info["rows"] == m.count() and info["last_batch"] is not None and not info["active"]
    want = jobs.gate_events(m)
    assert got.count() == m.count() and got.exceptAll(want).isEmpty()


def test_strike_stream_equals_batch(spark, tmp_path):
    d = views.detections(spark, SF).select("user_id", "detection_id", "created_at", "risk_score")
    got = _run(jobs.strike_stream(_stream(spark, d, tmp_path, "strikes"), window_days=7), "strikes", spark)
    banded = d.withColumn("band", policy.risk_band(F.col("risk_score")))
    want = policy.with_active_strikes(banded, F.col("band").isin("high", "critical"), 7).filter("band in ('high', 'critical')")
    want = want.select("detection_id", F.col("active_strikes").alias("strike_number"))
    assert got.count() == want.count() and got.select("detection_id", "strike_number").exceptAll(want).isEmpty()


def test_missing_decisions_pass_with_a_marker(spark, monkeypatch):
    """The gate fails open: allowed, score 0 and a label that says so; decisions that are there stay."""
    real = jobs.gate.gate

    def broken(messages):
        g = real(messages)
        return g.withColumns({c: F.when(F.col("message_id") != 2, F.col(c)) for c in ("allowed", "action", "risk_score", "labels")})

    monkeypatch.setattr(jobs.gate, "gate", broken)
    m = spark.createDataFrame([(1, "call 555-123-4567 please"), (2, "call 555-123-4567 please"), (3, None)], "message_id int, content string")
    out = jobs.gate_events(m, F.timestamp_seconds(F.lit(0)))
    got = {r.message_id: json.loads(r.intercept_result) for r in out.collect()}
    assert got["2"] == {"allowed": True, "action": "allow", "risk_score": 0.0, "labels": ["interceptor_error"]}
    assert not got["1"]["allowed"] and got["1"]["labels"] == ["contact_info_phone"] and got["3"]["labels"] == []
    assert {r.emitted_at for r in out.collect()} == {"1970-01-01T00:00:00.000Z"} and dict(out.dtypes)["message_id"] == "string"
