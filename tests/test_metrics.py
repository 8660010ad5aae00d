from __future__ import annotations

from brindle.operators import policy
from brindle.sources import seeds


def test_seeds(spark):
    t = seeds.seed_tables(spark)
    assert {k: v.count() for k, v in t.items()} == {"detections": 4, "cases": 2, "strikes": 1, "actions": 2, "config": 3}
    got = policy.enforce(t["detections"].withColumn("risk_score", t["detections"].risk_score.cast("double")))
    assert {r.detection_id: r.risk_band for r in got.collect()} == {"d1": "critical", "d2": "medium", "d3": "high", "d4": "low"}
