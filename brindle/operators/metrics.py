"""Operations metrics over enforced detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latency(rows: DataFrame, column: str) -> DataFrame:
    """Exact median, 95th and 99th percentile, one row."""
    return rows.agg(*[F.percentile(column, F.lit(q)).alias(name) for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])


def escalation_rate(enforced: DataFrame) -> DataFrame:
    """Share of detections whose action is more severe than that of their band, and strikes per user."""
    more = F.count_if(F.col("action") != F.col("base_action"))
    strikes = F.count_if(F.col("risk_band").isin("high", "critical"))
    return enforced.agg((more / F.count(F.lit(1))).alias("escalation_rate"), (strikes / F.count_distinct("user_id")).alias("strikes_per_user"))
