"""Structured Streaming forms of the gate, of strikes and of event-time windows.

The gate is a stateless map and the same function as in batch. Strikes are keyed state: per
user the strikes still in their window, with control rows (deactivate one, clear all) on the
same stream. Sinks are Parquet with a checkpoint, so a restart repeats nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brindle.operators import gate, policy

STRIKE_OUT = "user_id long, detection_id long, created_at timestamp, strike_number int, action string"
STRIKE_STATE = "ids array<long>, ends array<long>"


def gate_events(messages: DataFrame, emitted_at: Column | None = None) -> DataFrame:
    """What goes to the message stream: flat strings, the decision as JSON and, where given, the time of emission.

    A row whose decision is missing passes with score 0 and a marker: the gate fails open.
    """
    g = gate.gate(messages)
    decision = F.struct(F.coalesce("allowed", F.lit(True)).alias("allowed"), F.coalesce("action", F.lit("allow")).alias("action"), F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"), F.coalesce("labels", F.array(F.lit("interceptor_error"))).alias("labels"))
    plain = [F.col(c).cast("string").alias(c) for c in messages.columns]
    when = [] if emitted_at is None else [F.date_format(emitted_at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("emitted_at")]
    return g.select(*plain, F.to_json(decision).alias("intercept_result"), *when)


def stream_info(query: StreamingQuery) -> dict:
    """Rows so far seen in recent progress and the last batch, for monitoring."""
    progress = query.recentProgress
    return {"rows": sum(p["numInputRows"] for p in progress), "last_batch": progress[-1]["batchId"] if progress else None, "active": query.isActive}


def write_gate_stream(messages: DataFrame, path: str, checkpoint: str):
    """Run what is there and stop; the same call later goes on where it ended."""
    return gate_events(messages).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Tumbling or sliding event-time counts by type with a watermark; NTZ times are read as UTC."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return e.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events")).select("w.start", "w.end", "event_type", "events")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy("user_id", F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select("user_id", "w.start", "w.end", "events")


def strike_stream(events: DataFrame, window_days: int = 30, late: str = "1 hour") -> DataFrame:
    """Strikes of high and critical detections, numbered within the rolling window of their user.

    ``events``: user_id, detection_id, created_at, risk_score or a ``risk_band`` that is known already, and optionally ``control``
    (null, ``deactivate`` with the strike's detection_id, or ``clear``). Rows of a batch are taken in order of
    time and id; strikes that ended are dropped when the user is next seen or at timeout.
    """
    span = window_days * policy.MICROS_A_DAY
    e = events if "control" in events.columns else events.withColumn("control", F.lit(None).cast("string"))
    band = F.col("risk_band") if "risk_band" in events.columns else policy.risk_band(F.col("risk_score"))
    e = e.withColumn("band", band).filter("control is not null or band in ('high', 'critical')")
    e = e.withWatermark("created_at", late).select("user_id", "detection_id", "created_at", "control")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ids, ends = (list(x) for x in state.get) if state.exists else ([], [])
        rows = pd.concat(list(batches)).sort_values(["created_at", "detection_id"])
        out = []
        for r in rows.itertuples():
            now = r.created_at.value // 1000
            live = [(i, t) for i, t in zip(ids, ends, strict=True) if t > now]
            ids, ends = [i for i, _ in live], [t for _, t in live]
            if r.control == "clear":
                ids, ends = [], []
            elif r.control == "deactivate":
                kept = [(i, t) for i, t in live if i != r.detection_id]
                ids, ends = [i for i, _ in kept], [t for _, t in kept]
            else:
                ids, ends = [*ids, int(r.detection_id)], [*ends, now + span]
                n = len(ids)
                out.append((key[0], r.detection_id, r.created_at, n, policy.ESCALATION[min(n, len(policy.ESCALATION)) - 1]))
        if ids:
            state.update((ids, ends))
            state.setTimeoutTimestamp(max(max(ends) // 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["user_id", "detection_id", "created_at", "strike_number", "action"])

    return e.groupBy("user_id").applyInPandasWithState(step, STRIKE_OUT, STRIKE_STATE, "append", GroupStateTimeout.EventTimeTimeout)
