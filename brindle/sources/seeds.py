"""Small fixture tables in the library's schemas, for demos and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources import views


def seed_tables(spark: SparkSession, now: str = "2024-01-31 00:00:00") -> dict[str, DataFrame]:
    """Four detections, two cases, one strike, two actions and three configuration rows, relative to ``now``."""
    detections = [
        ("d1", "m1", "t1", "u1", 0.92, ["phone_number", "intent_phrase"], 1, 45),
        ("d2", "m2", "t2", "u2", 0.55, ["social_handle"], 2, 320),
        ("d3", "m3", "t1", "u1", 0.78, ["email_address"], 1, 38),
        ("d4", "m4", "t3", "u3", 0.25, [], 1, 12),
    ]
    d = spark.createDataFrame(detections, "detection_id string, message_id string, thread_id string, user_id string, risk_score double, labels array<string>, stage int, processing_ms int")
    at = F.lit(now).cast("timestamp")
    cases = spark.createDataFrame([("c1", "d1", "u1", "t1", "open", 5), ("c2", "d3", "u1", "t1", "in_review", 3)], "id string, detection_id string, user_id string, thread_id string, status string, priority int")
    strikes = spark.createDataFrame([("s1", "u1", "c1", "d1", 1, "warning", True)], "id string, user_id string, case_id string, detection_id string, strike_number int, action_taken string, is_active boolean")
    actions = spark.createDataFrame(
        [("a1", "c1", "system", "system", "block", "u1", "message", "contact_sharing", {"auto": "true"}, False), ("a2", "c2", "mod1", "moderator", "quarantine", "u1", "thread", "contact_sharing", {"ticket": "7"}, False)],
        "id string, case_id string, actor_id string, actor_role string, action_type string, target_user_id string, target_scope string, reason_code string, metadata map<string,string>, is_permanent boolean",
    )
    config = spark.createDataFrame([("k1", "risk_thresholds", '{"allow_max": 0.39}', 1, True), ("k2", "strike_window_days", "30", 1, True), ("k3", "ruleset_version", '"1.0.0"', 1, True)], "id string, config_key string, config_value string, version int, is_active boolean")
    return {
        "detections": _as(d.withColumns({"created_at": at, "ruleset_version": F.lit("1.0.0")}), views.DETECTION),
        "cases": _as(cases.withColumns({"created_at": at, "updated_at": at}), views.CASE),
        "strikes": _as(strikes.withColumns({"window_start": at, "window_end": at + F.make_dt_interval(F.lit(30))}), views.STRIKE),
        "actions": _as(actions.withColumns({"requires_human": F.col("is_permanent"), "created_at": at}), views.ACTION),
        "config": _as(config.withColumns({"activated_at": at, "created_at": at}), views.CONFIG),
    }


def _as(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of a schema in its order; what the rows lack is null."""
    schema = df.sparkSession.createDataFrame([], ddl).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
