"""Behavioural signals of a user, from what the user did before each detection.

No task holds a user's whole history: a two-level prefix scan. Sums, last times and first sights are grouped per (user, thread,
kind, period), a scan over periods says what there was before each period, and windows inside one
(user, period) add what the period itself holds. The scan over periods has one row per period of a
user's thread, not one per detection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS_A_DAY = 86_400_000_000


def with_history(detections: DataFrame, ts: str = "created_at", order: str = "detection_id", kind: str | None = None, period_days: float = 1.0) -> DataFrame:
    """Adds what is known at each detection, in order of (ts, order).

    ``thread_count``: threads of the user so far, this one included; ``n_user`` and ``n_thread``: detections of the user and in
    the user's thread before; ``n_kinds``: kinds before in the thread; ``gap``: seconds since the one before in the thread, else null.
    Nulls in user, thread, kind or time are values of their own; a null time comes first.
    """
    us = F.unix_micros(ts)
    k = F.lit(None).cast("string") if kind is None else F.col(kind)
    d = detections.withColumns({"_b_us": us, "_b_kind": k, "_b_period": F.floor(us / int(period_days * MICROS_A_DAY))})
    cell = ["user_id", "thread_id", "_b_kind", "_b_period"]
    c = d.groupBy(*cell).agg(F.count(F.lit(1)).alias("_c_n"), F.max("_b_us").alias("_c_last"))
    by = lambda *keys: Window.partitionBy(*keys).orderBy("_b_period")
    past = lambda *keys: by(*keys).rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("_c_kind", (F.row_number().over(by("user_id", "thread_id", "_b_kind")) == 1).cast("long"))
    thread = c.groupBy("user_id", "thread_id", "_b_period").agg(F.sum("_c_n").alias("n"), F.max("_c_last").alias("last"), F.sum("_c_kind").alias("kinds"), F.collect_list(F.struct("_b_kind", "_c_kind")).alias("kind_list"))
    line = past("user_id", "thread_id")
    thread = thread.withColumns({"_c_thread": (F.row_number().over(by("user_id", "thread_id")) == 1).cast("long"), "_c_n_thread": F.sum("n").over(line), "_c_before": F.max("last").over(line), "_c_n_kinds": F.sum("kinds").over(line)})
    user = thread.groupBy("user_id", "_b_period").agg(F.sum("n").alias("n"), F.sum("_c_thread").alias("threads"))
    line = past("user_id")
    user = user.select(F.col("user_id").alias("_u_user"), F.col("_b_period").alias("_u_period"), F.sum("n").over(line).alias("_c_n_user"), F.sum("threads").over(line).alias("_c_threads"))
    met = thread.join(user, [F.col("user_id").eqNullSafe(F.col("_u_user")), F.col("_b_period").eqNullSafe(F.col("_u_period"))])
    met = met.select("user_id", "thread_id", "_b_period", "_c_thread", "_c_n_thread", "_c_before", "_c_n_kinds", "_c_n_user", "_c_threads", F.inline("kind_list"))
    met = met.select(*[F.col(x).alias(f"_k_{x}") for x in cell], *[x for x in met.columns if x.startswith("_c_")])
    d = d.join(met, [F.col(x).eqNullSafe(F.col(f"_k_{x}")) for x in cell]).drop(*[f"_k_{x}" for x in cell])
    inside = lambda *keys: Window.partitionBy("user_id", "_b_period", *keys).orderBy(ts, order)
    so_far = lambda *keys: inside(*keys).rowsBetween(Window.unboundedPreceding, 0)
    before = lambda *keys: inside(*keys).rowsBetween(Window.unboundedPreceding, -1)
    first = lambda flag, *keys: F.when(F.row_number().over(inside(*keys)) == 1, F.col(flag)).otherwise(0)
    d = d.withColumns({"_b_thread": first("_c_thread", "thread_id"), "_b_new": first("_c_kind", "thread_id", "_b_kind")})
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    d = d.withColumns(
        {
            "thread_count": zero(F.col("_c_threads")) + F.sum("_b_thread").over(so_far()),
            "n_user": zero(F.col("_c_n_user")) + F.row_number().over(inside()) - 1,
            "n_thread": zero(F.col("_c_n_thread")) + F.row_number().over(inside("thread_id")) - 1,
            "n_kinds": zero(F.col("_c_n_kinds")) + zero(F.sum("_b_new").over(before("thread_id"))),
            "gap": (F.col("_b_us") - F.coalesce(F.lag("_b_us").over(inside("thread_id")), F.col("_c_before"))) / 1e6,
        }
    )
    return d.drop(*[x for x in d.columns if x.startswith(("_b_", "_c_"))])


def _cross_thread() -> Column:
    return F.when(F.col("thread_count") >= 2, F.least(F.lit(0.25) + (F.col("thread_count") - 2) * 0.15, F.lit(0.6))).otherwise(F.lit(0.0))


def stage3_as_executed(detections: DataFrame, ts: str = "created_at", order: str = "detection_id") -> DataFrame:
    """History is never recorded, so only the cross-thread signal is left."""
    d = with_history(detections, ts, order)
    labels = F.when(F.col("thread_count") >= 2, F.array(F.lit("multi_thread_pattern"))).otherwise(F.array().cast("array<string>"))
    return d.withColumns({"stage3_score": F.round(_cross_thread(), 3), "stage3_labels": labels}).drop("n_user", "n_thread", "n_kinds", "gap")


def stage3_as_documented(detections: DataFrame, ts: str = "created_at", order: str = "detection_id", kind: str = "kind", period_days: float = 1.0) -> DataFrame:
    """All five signals, each detection recorded after it was scored."""
    return signals(with_history(detections, ts, order, kind, period_days)).drop("gap")


def signals(d: DataFrame) -> DataFrame:
    """Adds stage3_score and stage3_labels to rows with what ``with_history`` adds."""
    n, u, k, gap, no = F.col("n_thread"), F.col("n_user"), F.col("n_kinds"), F.col("gap"), F.lit(0.0)
    found = {
        "persistent_contact_attempts": F.when(n >= 3, F.least(F.lit(0.3) + (n - 3) * 0.1, F.lit(0.7))),
        "multi_thread_pattern": F.when(F.col("thread_count") >= 2, _cross_thread()),
        "burst_attempts": F.when((n >= 2) & (gap < 60), F.lit(0.5)),
        "diverse_evasion_methods": F.when(k >= 3, F.least(F.lit(0.4) + (k - 3) * 0.1, F.lit(0.7))),
        "high_volume_user": F.when(u >= 5, F.least(F.lit(0.3) + (u - 5) * 0.05, F.lit(0.6))),
    }
    mild = F.when(n.between(1, 2), n * 0.1)
    slow_burst = F.when((n >= 2) & (gap >= 60) & (gap < 300), F.lit(0.3))
    score = F.greatest(no, *[F.coalesce(s, no) for s in [*found.values(), mild, slow_burst]])
    labels = F.array_compact(F.array(*[F.when(s.isNotNull(), F.lit(name)) for name, s in found.items()]))
    return d.withColumns({"stage3_score": F.round(score, 3), "stage3_labels": labels})
