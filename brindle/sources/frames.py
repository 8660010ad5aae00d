"""Request frames: one JSON object per row, as a client of the gate sends it.

A frame is ``{"type": "intercept", "request_id": ..., "message": {...}}``. What is no such frame is a dead letter with
the reason: ``not_json`` (no JSON object), ``invalid_type`` (another type or none) or ``missing_content`` (no message, or
one without content), tested in that order. A frame without an id gets one made of its text, so
that a task that runs again gives the same; equal frames without ids share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGE = "struct<message_id:string,thread_id:string,user_id:string,content:string,ts:timestamp,gps_lat:decimal(10,7),gps_lon:decimal(10,7)>"
FRAME = f"type string, request_id string, message {MESSAGE}, _f_bad string"
REASONS = ["not_json", "invalid_type", "missing_content"]


def _made_id(value: Column) -> Column:
    """The hash of a frame in the form of a UUID."""
    return F.regexp_replace(F.md5(value), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def parsed(frames: DataFrame, value: str = "value") -> DataFrame:
    """Adds request_id, message and ``reason``, which is null for good frames."""
    body = F.from_json(F.col(value), FRAME, {"columnNameOfCorruptRecord": "_f_bad"})
    f = frames.withColumn("_f", body)
    is_text = lambda c: F.coalesce(c, F.lit("")) != ""
    reason = (
        F.when(F.col("_f").isNull() | F.col("_f._f_bad").isNotNull() | ~F.coalesce(F.trim(value).startswith("{"), F.lit(False)), REASONS[0])
        .when(~F.col("_f.type").eqNullSafe(F.lit("intercept")), REASONS[1])
        .when(~is_text(F.col("_f.message.content")), REASONS[2])
    )
    request_id = F.when(is_text(F.col("_f.request_id")), F.col("_f.request_id")).otherwise(_made_id(F.col(value)))
    return f.withColumns({"reason": reason, "request_id": request_id, "message": F.col("_f.message")}).drop("_f")


def split_frames(frames: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(requests: request_id and the message's columns; dead letters: value, request_id where sent, reason), of a batch or a stream."""
    p = parsed(frames, value)
    dead = p.filter("reason is not null").select(F.col(value), F.get_json_object(value, "$.request_id").alias("request_id"), "reason")
    return p.filter("reason is null").select("request_id", "message.*"), dead
