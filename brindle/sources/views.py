"""Driver tables seen as messages, detections, cases and actions (one definition, mirrored by the oracles)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.session import table

MESSAGE = T.StructType(
    [
        T.StructField("message_id", T.StringType(), False),
        T.StructField("thread_id", T.StringType(), False),
        T.StructField("user_id", T.StringType(), False),
        T.StructField("content", T.StringType()),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("gps_lat", T.DecimalType(10, 7)),
        T.StructField("gps_lon", T.DecimalType(10, 7)),
    ]
)
SPAN = "struct<offset:int,length:int,type:string,confidence:double>"
DETECTION = (
    "detection_id string, message_id string, thread_id string, user_id string, risk_score decimal(4,3), labels array<string>, "
    f"evidence_spans array<{SPAN}>, hashed_tokens array<string>, stage smallint, ruleset_version string, model_version string, "
    "gps_lat decimal(10,7), gps_lon decimal(10,7), processing_ms int, created_at timestamp"
)
CASE = "id string, detection_id string, user_id string, thread_id string, status string, priority smallint, assigned_to string, resolution string, resolution_note string, created_at timestamp, updated_at timestamp"
STRIKE = "id string, user_id string, case_id string, detection_id string, strike_number smallint, action_taken string, is_active boolean, window_start timestamp, window_end timestamp"
ACTION = (
    "id string, case_id string, actor_id string, actor_role string, action_type string, target_user_id string, target_scope string, reason_code string, "
    "metadata map<string,string>, is_permanent boolean, requires_human boolean, approved_by string, created_at timestamp"
)
CONFIG = "id string, config_key string, config_value string, version int, changed_by string, change_reason string, is_active boolean, activated_at timestamp, created_at timestamp"


def document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id"), "lang", F.col("text").alias("content"))


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("message_id"), F.col("conv_id").alias("thread_id"), "turn", "role", F.col("text").alias("content")
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as detections: the thread is the event type, the score value / 100 up to 1."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("detection_id"),
        "user_id",
        F.col("event_type").alias("thread_id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("risk_score"),
        F.array("event_type").alias("labels"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases: status F, O, P; priority 5 for 1-URGENT down to 1; three resolutions."""
    status = F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "O", "open").otherwise("in_review")
    resolution = F.element_at(F.array(F.lit("confirmed"), F.lit("false_positive"), F.lit("escalated")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("case_id"),
        F.col("o_custkey").alias("user_id"),
        status.alias("status"),
        (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"),
        (F.col("o_custkey") % 7).alias("assigned_to"),
        F.when(status == "resolved", resolution).alias("resolution"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as moderation actions on the case of their order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"),
        F.col("l_linenumber").alias("action_no"),
        F.col("l_suppkey").alias("actor_id"),
        (F.col("l_returnflag") == "R").alias("is_permanent"),
        F.when(F.col("l_linestatus") == "F", F.col("l_suppkey")).alias("approved_by"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
    )


def read_messages(spark: SparkSession, path: str, streaming: bool = False) -> tuple[DataFrame, DataFrame]:
    """JSON message files as (valid rows, dead letters); a row without content or ids is a dead letter."""
    reader = spark.readStream if streaming else spark.read
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in MESSAGE] + [T.StructField("_corrupt", T.StringType())])
    rows = reader.schema(nullable).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    ok = F.col("_corrupt").isNull() & F.col("message_id").isNotNull() & F.col("user_id").isNotNull() & (F.coalesce("content", F.lit("")) != "")
    return rows.filter(ok).drop("_corrupt"), rows.filter(~ok)
