from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from brindle.operators import policy


def _scores(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "risk_score double")


def test_band_edges(spark):
    rows = _scores(spark, [0.39, 0.395, 0.40, 0.64, 0.65, 0.84, 0.845, 0.85]).select(policy.risk_band(F.col("risk_score"))).collect()
    assert [r[0] for r in rows] == ["low", "medium", "medium", "medium", "high", "high", "critical", "critical"]


def test_score_outside_is_an_error(spark):
    with pytest.raises(Exception, match="risk score"):
        _scores(spark, [1.5]).select(policy.risk_band(F.col("risk_score"))).collect()


def test_thresholds_are_checked():
    with pytest.raises(ValueError):
        policy.Thresholds(allow_max=0.5)
    t = policy.Thresholds()
    with pytest.raises(ValueError):
        t.updated(nudge_max=0.9)
    assert t.updated(allow_max=0.3).allow_max == 0.3


def _events(spark, rows):
    d = spark.createDataFrame(rows, "detection_id long, user_id long, ts string, risk_score double")
    return d.withColumn("created_at", F.col("ts").cast("timestamp")).withColumn("labels", F.array(F.lit("spam")))


def test_four_high_events_escalate(spark):
    e = policy.enforce(_events(spark, [(i, 1, "2024-01-01 00:00:00", 0.75) for i in range(4)]))
    assert [r.action for r in e.orderBy("detection_id").collect()] == ["soft_block", "cooldown", "restriction", "suspension_candidate"]


def test_low_risk_after_two_strikes_is_escalated(spark):
    rows = [(1, 1, "2024-01-01 00:00:00", 0.75), (2, 1, "2024-01-02 00:00:00", 0.8), (3, 1, "2024-01-03 00:00:00", 0.2), (4, 2, "2024-01-03 00:00:00", 0.2)]
    got = {r.detection_id: (r.action, r.strike_count) for r in policy.enforce(_events(spark, rows)).collect()}
    assert got[3] == ("cooldown", 2) and got[4] == ("allow", 0)


@pytest.mark.parametrize(("day", "number"), [(30, 2), (31, 1), (32, 1)])
def test_window_is_half_open(spark, day, number):
    second = f"2024-01-{day:02d} 00:00:00" if day < 32 else "2024-02-01 00:00:00"
    e = policy.enforce(_events(spark, [(1, 1, "2024-01-01 00:00:00", 0.9), (2, 1, second, 0.9)]), window_days=30)
    assert e.filter("detection_id = 2").head().strike_count == number


def test_expire_and_deactivate(spark):
    strikes = policy.strikes_from(policy.enforce(_events(spark, [(1, 1, "2024-01-01 00:00:00", 0.9), (2, 2, "2024-02-01 00:00:00", 0.9)])))
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    assert policy.expire(strikes, now).filter("expired").count() == 1
    controls = spark.createDataFrame([(None, 2)], "strike_id string, user_id long")
    assert policy.active(policy.deactivate(strikes, controls), F.lit("2024-01-15").cast("timestamp")).count() == 1


def test_messages(spark):
    e = policy.enforce(_events(spark, [(1, 1, "2024-01-01 00:00:00", 0.75)])).head()
    assert "spam" in e.user_message and e.scope == "message" and e.duration_hours is None


def test_gate_settings_are_checked():
    assert policy.GateSettings().max_message_length == 10_000
    for wrong in ({"sync_threshold": 1.1}, {"detection_port": 0}, {"breaker_threshold": 0}, {"breaker_reset_ms": 999}, {"max_message_length": 0}):
        with pytest.raises(ValueError, match=next(iter(wrong))):
            policy.GateSettings(**wrong)
