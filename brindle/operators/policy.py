"""Risk bands, rolling strikes, escalation and enforcement decisions.

Strikes count within a bounded window, so events are dealt by (user, window-sized period) and
each event also goes, as context only, to the next period: no task holds a user's whole history.
"""

from __future__ import annotations

from dataclasses import dataclass
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MICROS_A_DAY = 86_400_000_000
#: Most intervals of versions, by day, that are broadcast; parts of a day beyond that.
FEW_VERSIONS, SALTS = 20_000, 16
# Actions by severity, and what follows from bands, strikes and actions.
SEVERITY = ["allow", "nudge", "warning", "soft_block", "cooldown", "hard_block", "restriction", "suspension_candidate"]
BASE_ACTION = {"low": "allow", "medium": "nudge", "high": "soft_block", "critical": "hard_block"}
ESCALATION = ["warning", "cooldown", "restriction", "suspension_candidate"]
DURATION_HOURS = {"cooldown": 24, "restriction": 72}
ACCOUNT_SCOPE = ["cooldown", "restriction", "suspension_candidate"]
MESSAGES = {
    "allow": "Your message has been delivered.",
    "nudge": "We detected potential {labels} in your message. Please review our community guidelines before sending.",
    "warning": "Your message was flagged for {labels}. This is your first warning. Repeated violations may result in restrictions. Please familiarize yourself with our community standards.",
    "soft_block": "Your message could not be delivered due to {labels}. Please revise your message to comply with our guidelines.",
    "cooldown": "Your messaging has been temporarily restricted for 24 hours due to repeated {labels}. This is strike {strikes} on your account. Use this time to review our community guidelines.",
    "hard_block": "Your message has been blocked due to severe {labels}. This action has been logged and may result in further restrictions.",
    "restriction": "Your account has been placed under elevated monitoring for 72 hours due to repeated violations. This is strike {strikes}. Future violations may result in account suspension.",
    "suspension_candidate": "Your account has been flagged for review by our moderation team due to {strikes} policy violations. Your messaging capabilities are restricted pending review. You will be notified of the outcome within 48 hours.",
}


@dataclass(frozen=True)
class Thresholds:
    """Edges of the risk bands; invalid ones are refused, so an update either holds or changes nothing."""

    allow_max: float = 0.39
    nudge_min: float = 0.40
    nudge_max: float = 0.64
    soft_block_min: float = 0.65
    soft_block_max: float = 0.84
    hard_block_min: float = 0.85

    def __post_init__(self) -> None:
        edges = [self.allow_max, self.nudge_min, self.nudge_max, self.soft_block_min, self.soft_block_max, self.hard_block_min]
        if edges[0] < 0 or edges[-1] > 1 or any(a >= b for a, b in zip(edges, edges[1:], strict=False)):
            raise ValueError(f"edges must rise strictly within 0 and 1: {edges}")

    def updated(self, **changes: float) -> Thresholds:
        return Thresholds(**(self.__dict__ | changes))


def risk_band(score: Column, t: Thresholds = Thresholds()) -> Column:
    """Upper edges decide; a score outside 0 and 1 is an error."""
    checked = F.when((score < 0) | (score > 1), F.raise_error(F.lit("risk score outside 0 and 1")).cast("double")).otherwise(score)
    return F.when(checked <= t.allow_max, "low").when(checked <= t.nudge_max, "medium").when(checked <= t.soft_block_max, "high").when(checked.isNotNull(), "critical")


def ui_badge(score: Column) -> Column:
    """The dashboard's bands, which differ from ``risk_band`` between edges."""
    return F.when(score >= 0.85, "critical").when(score >= 0.65, "high").when(score >= 0.40, "medium").when(score.isNotNull(), "low")


def mapping(key: Column, values: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def escalation(strikes: Column) -> Column:
    """The action for the n-th strike; n below 1 is an error."""
    n = F.when(strikes < 1, F.raise_error(F.lit("strike count below 1")).cast("int")).otherwise(strikes)
    return F.element_at(F.array(*[F.lit(a) for a in ESCALATION]), F.least(n, F.lit(len(ESCALATION))).cast("int"))


def more_severe(base: Column, other: Column) -> Column:
    rank = {a: i for i, a in enumerate(SEVERITY)}
    return F.when(mapping(other, rank) > mapping(base, rank), other).otherwise(base)


def with_active_strikes(events: DataFrame, is_strike: Column, window_days: int = 30, user: str = "user_id", ts: str = "created_at", order: str = "detection_id") -> DataFrame:
    """Adds ``active_strikes``: strikes of the user in (ts - window, ts], in order of (ts, id), this event's own included."""
    span = window_days * MICROS_A_DAY
    e = events.withColumns({"_p_us": F.unix_micros(ts), "_p_s": F.coalesce(is_strike, F.lit(False)).cast("long")})
    e = e.withColumn("_p_own", F.floor(F.col("_p_us") / span))
    context = e.filter("_p_s = 1").select(user, order, "_p_us", "_p_s", (F.col("_p_own") + 1).alias("_p_period"), F.lit(False).alias("_p_here"))
    both = e.withColumns({"_p_period": F.col("_p_own"), "_p_here": F.lit(True)}).unionByName(context, allowMissingColumns=True)
    line = Window.partitionBy(user, "_p_period").orderBy("_p_us")
    peers = Window.partitionBy(user, "_p_period", "_p_us")
    until = F.sum("_p_s").over(line.rangeBetween(-span + 1, 0))
    later = F.sum("_p_s").over(peers) - F.sum("_p_s").over(peers.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("active_strikes", (until - later).cast("int")).filter("_p_here")
    return out.drop("_p_us", "_p_s", "_p_own", "_p_period", "_p_here")


def strikes_in_force(events: DataFrame, strikes: DataFrame, window_days: int = 30, user: str = "user_id", ts: str = "created_at", order: str = "detection_id") -> DataFrame:
    """Interval join: ``events`` with the number of strikes (user, start ts, id) of the user in force at each, the event's own included.

    A strike holds in [start, start + window). Both sides are dealt by (user, window-sized period); a strike also goes to the
    next period, so each pair meets once and no task holds a user's whole history. Of strikes at the event's own time those up
    to its id count. Events without strikes are left out.
    """
    span = window_days * MICROS_A_DAY
    s = strikes.select(F.col(user).alias("_s_u"), F.unix_micros(ts).alias("_s_us"), F.col(order).alias("_s_id"))
    s = s.withColumn("_s_p", F.explode(F.array(F.floor(F.col("_s_us") / span), F.floor(F.col("_s_us") / span) + 1)))
    e = events.withColumn("_e_us", F.unix_micros(ts)).withColumn("_e_p", F.floor(F.col("_e_us") / span))
    before = (F.col("_s_us") < F.col("_e_us")) | ((F.col("_s_us") == F.col("_e_us")) & (F.col("_s_id") <= F.col(order)))
    inside = before & (F.col("_e_us") < F.col("_s_us") + span)
    met = e.join(s, (F.col(user) == F.col("_s_u")) & (F.col("_e_p") == F.col("_s_p")) & inside)
    return met.groupBy(*events.columns).agg(F.count(F.lit(1)).alias("strikes"))


@dataclass(frozen=True)
class GateSettings:
    """Settings of the gate and of what it calls; invalid ones are refused."""

    sync_threshold: float = 0.65
    detection_port: int = 8000
    breaker_threshold: int = 5
    breaker_reset_ms: int = 30_000
    max_message_length: int = 10_000

    def __post_init__(self) -> None:
        wrong = {
            "sync_threshold": not 0 <= self.sync_threshold <= 1,
            "detection_port": not 1 <= self.detection_port <= 65_535,
            "breaker_threshold": self.breaker_threshold < 1,
            "breaker_reset_ms": self.breaker_reset_ms < 1000,
            "max_message_length": self.max_message_length < 1,
        }
        if any(wrong.values()):
            raise ValueError(f"invalid: {', '.join(f'{k}={getattr(self, k)}' for k, bad in wrong.items() if bad)}")


def user_message(action: Column, labels: Column, strikes: Column) -> Column:
    text = mapping(action, MESSAGES)
    named = F.when(F.size(labels) > 0, F.array_join(F.slice(labels, 1, 3), ", ")).otherwise(F.lit("policy violation"))
    return F.replace(F.replace(text, F.lit("{labels}"), named), F.lit("{strikes}"), strikes.cast("string"))


def enforce(detections: DataFrame, thresholds: Thresholds | None = Thresholds(), window_days: int = 30) -> DataFrame:
    """Adds risk_band, base_action, strike_count, action, duration_hours, scope and user_message.

    High and critical detections are strikes; whoever has active strikes gets the more severe
    of the band's action and the strikes' action, even for a low-risk message. Without thresholds
    the ``risk_band`` that is there holds.
    """
    d = detections if thresholds is None else detections.withColumn("risk_band", risk_band(F.col("risk_score"), thresholds))
    d = with_active_strikes(d, F.col("risk_band").isin("high", "critical"), window_days).withColumnRenamed("active_strikes", "strike_count")
    d = d.withColumn("base_action", mapping(F.col("risk_band"), BASE_ACTION))
    n = F.col("strike_count")
    final = F.when(n > 0, more_severe(F.col("base_action"), F.when(n > 0, escalation(F.greatest(n, F.lit(1)))))).otherwise(F.col("base_action"))
    d = d.withColumn("action", final)
    return d.withColumns(
        {
            "duration_hours": F.try_element_at(F.create_map(*[F.lit(x) for kv in DURATION_HOURS.items() for x in kv]), F.col("action")),
            "scope": F.when(F.col("action").isin(ACCOUNT_SCOPE), "account").otherwise("message"),
            "user_message": user_message(F.col("action"), F.col("labels"), n),
        }
    )


def strikes_from(enforced: DataFrame, window_days: int = 30) -> DataFrame:
    """The strike table of enforced detections: half-open validity [window_start, window_end)."""
    s = enforced.filter(F.col("risk_band").isin("high", "critical"))
    return s.select(
        F.sha2(F.concat_ws(":", F.lit("strike"), F.col("detection_id").cast("string")), 256).alias("id"), "user_id", "detection_id",
        F.col("strike_count").alias("strike_number"), escalation(F.col("strike_count")).alias("action_taken"), F.lit(True).alias("is_active"),
        F.col("created_at").alias("window_start"), (F.col("created_at") + F.make_dt_interval(F.lit(window_days))).alias("window_end"),
    )


def with_cases(strikes: DataFrame, cases: DataFrame) -> DataFrame:
    """Strikes with the ``case_id`` that was opened for their detection, null where none was."""
    opened = cases.filter("detection_id is not null").groupBy(F.col("detection_id").alias("_k_detection")).agg(F.min("case_id").alias("case_id"))
    return strikes.join(opened, F.col("detection_id") == F.col("_k_detection"), "left").drop("_k_detection")


def active(strikes: DataFrame, now: Column) -> DataFrame:
    return strikes.filter(F.col("is_active") & (F.col("window_end") > now))


def strikes_for(strikes: DataFrame, user: object, active_only: bool, now: Column) -> DataFrame:
    found = strikes.filter(F.col("user_id") == user)
    return (active(found, now) if active_only else found).orderBy("window_start", "id")


def expire(strikes: DataFrame, now: Column) -> DataFrame:
    """Strikes with ``expired`` (they were active and ended) and ``is_active`` brought up to date."""
    over = F.col("is_active") & (F.col("window_end") <= now)
    return strikes.withColumn("expired", over).withColumn("is_active", F.col("is_active") & (F.col("window_end") > now))


def deactivate(strikes: DataFrame, controls: DataFrame) -> DataFrame:
    """Apply control rows (strike_id or user_id, the other null): single deactivations and cleared users."""
    one = controls.filter("strike_id is not null").select(F.col("strike_id").alias("id"), F.lit(True).alias("_off")).distinct()
    whole = controls.filter("strike_id is null and user_id is not null").select("user_id", F.lit(True).alias("_clear")).distinct()
    out = strikes.join(one, "id", "left").join(whole, "user_id", "left")
    return out.withColumn("is_active", F.col("is_active") & F.col("_off").isNull() & F.col("_clear").isNull()).select(strikes.columns)


def config_as_of(events: DataFrame, config: DataFrame, ts: str = "created_at", days: int = 1) -> DataFrame:
    """As-of join: each event with the config value that was last activated at its time.

    Config rows become validity intervals that are joined on the days they touch. Up to ``FEW_VERSIONS`` intervals
    and days (they are counted) are broadcast, so events are not moved; more are repeated for each of ``SALTS`` parts
    of a day, so that the events of one day are many tasks.
    """
    ends = F.lead("activated_at").over(Window.partitionBy("config_key").orderBy("activated_at", "version"))
    spans = config.select("config_key", "config_value", "version", "activated_at", ends.alias("_c_end")).filter("_c_end is null or _c_end > activated_at")
    limits = events.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    day = lambda c: F.floor(F.unix_micros(c) / (days * MICROS_A_DAY))
    spans = spans.crossJoin(F.broadcast(limits)).filter("activated_at <= hi and (_c_end is null or _c_end > lo)")
    spans = spans.withColumn("_c_day", F.explode(F.sequence(day(F.greatest("activated_at", "lo")), day(F.least(F.coalesce("_c_end", "hi"), "hi")))))
    e = events.withColumn("_c_day", day(F.col(ts)))
    inside = (F.col(ts) >= F.col("activated_at")) & (F.col("_c_end").isNull() | (F.col(ts) < F.col("_c_end")))
    spans = spans.drop("lo", "hi")
    if spans.limit(FEW_VERSIONS + 1).count() <= FEW_VERSIONS:
        return e.join(F.broadcast(spans), "_c_day").filter(inside).drop("_c_day", "_c_end")
    spans = spans.withColumn("_c_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    e = e.withColumn("_c_salt", F.pmod(F.xxhash64(*events.columns), F.lit(SALTS)).cast("int"))
    return e.join(spans, ["_c_day", "_c_salt"]).filter(inside).drop("_c_day", "_c_salt", "_c_end")


def thresholds_table(spark: SparkSession, versions: list[tuple[str, Thresholds]]) -> DataFrame:
    """Versions of thresholds by the time from which they hold; each was checked when it was made."""
    rows = [(i, at, t.allow_max, t.nudge_max, t.soft_block_max) for i, (at, t) in enumerate(versions, 1)]
    return spark.createDataFrame(rows, "version int, activated_at string, allow_max double, nudge_max double, soft_block_max double").withColumn("activated_at", F.col("activated_at").cast("timestamp"))


def with_thresholds(events: DataFrame, versions: DataFrame, ts: str = "created_at") -> DataFrame:
    """Events with the edges in force at their time (``t_version``, ``t_allow``, ``t_nudge``, ``t_soft``); before the first version the defaults hold, as version 0.

    Of versions that begin at one time the last holds. Versions that are no rising edges within 0 and 1 were refused and hold never.
    """
    t = Thresholds()
    fine = versions.filter("0 <= allow_max and allow_max < nudge_max and nudge_max < soft_block_max and soft_block_max <= 1")
    first = events.sparkSession.createDataFrame([(0, t.allow_max, t.nudge_max, t.soft_block_max)], "version int, allow_max double, nudge_max double, soft_block_max double")
    first = first.withColumn("activated_at", F.lit("0001-01-01 00:00:00").cast("timestamp"))
    edges = fine.select("version", "activated_at", "allow_max", "nudge_max", "soft_block_max").unionByName(first.select("version", "activated_at", "allow_max", "nudge_max", "soft_block_max"))
    value = F.struct(F.col("allow_max").alias("t_allow"), F.col("nudge_max").alias("t_nudge"), F.col("soft_block_max").alias("t_soft"))
    config = edges.select(F.lit("thresholds").alias("config_key"), value.alias("config_value"), "version", "activated_at")
    out = config_as_of(events, config, ts)
    return out.withColumn("t_version", F.col("version")).select(*events.columns, "t_version", "config_value.*")


def band_as_of(detections: DataFrame, versions: DataFrame) -> DataFrame:
    """Adds the ``risk_band`` of the thresholds in force at each detection's time, and their version ``t_version``."""
    d = with_thresholds(detections, versions)
    band = risk_band(F.col("risk_score"), SimpleNamespace(allow_max=F.col("t_allow"), nudge_max=F.col("t_nudge"), soft_block_max=F.col("t_soft")))
    return d.withColumn("risk_band", band).drop("t_allow", "t_nudge", "t_soft")


def enforce_as_of(detections: DataFrame, versions: DataFrame, window_days: int = 30) -> DataFrame:
    """``enforce`` with the thresholds in force at each detection's time, and their version."""
    return enforce(band_as_of(detections, versions), None, window_days)
