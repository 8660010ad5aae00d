"""Every registered query of the library and its SQL oracle, by name.

Queries over driver tables use the views of ``brindle.sources.views``; the oracles repeat
those views as common table expressions. Windows of strikes are seven days, because events
span thirty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.operators import behavior, gate, policy, review
from brindle.session import spread, table
from brindle.sources import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DAYS = 7

# ---- views in SQL -----------------------------------------------------------------

DETECTIONS = """d as (select event_id as detection_id, user_id, event_type as thread_id, ts as created_at,
 least(value / 100, 1.0::double) as risk_score, cast(json_extract_string(props, '$.k') as bigint) as k, epoch_us(ts) as us from events)"""
BANDS = "b as (select *, case when risk_score <= 0.39 then 'low' when risk_score <= 0.64 then 'medium' when risk_score <= 0.84 then 'high' else 'critical' end as risk_band from d)"
CASES = """c as (select o_orderkey as case_id, o_custkey as user_id, case o_orderstatus when 'F' then 'resolved' when 'O' then 'open' else 'in_review' end as status,
 6 - cast(substr(o_orderpriority, 1, 1) as integer) as priority, o_custkey % 7 as assigned_to,
 case when o_orderstatus = 'F' then ['confirmed', 'false_positive', 'escalated'][o_orderkey % 3 + 1] end as resolution, o_orderdate as created_at from orders)"""
ACTIONS = """a as (select l_orderkey as case_id, l_linenumber as action_no, l_suppkey as actor_id, l_returnflag = 'R' as is_permanent,
 case when l_linestatus = 'F' then l_suppkey end as approved_by, l_shipdate as created_at from lineitem)"""
SPAN = DAYS * policy.MICROS_A_DAY
STRIKES = f"""s as (select *, risk_band in ('high', 'critical') as is_strike from b),
 n as (select *, cast(sum(is_strike::int) over (partition by user_id order by us range between {SPAN - 1} preceding and current row)
  - sum(is_strike::int) over (partition by user_id, us) + sum(is_strike::int) over (partition by user_id, us order by detection_id rows unbounded preceding) as integer) as strike_count from s)"""
ESCALATE = "case when {n} >= 4 then 'suspension_candidate' when {n} = 3 then 'restriction' when {n} = 2 then 'cooldown' when {n} = 1 then 'warning' end"
SEVERITY_SQL = "list_position(['allow','nudge','warning','soft_block','cooldown','hard_block','restriction','suspension_candidate'], {a})"
ENFORCED = f"""{DETECTIONS}, {BANDS}, {STRIKES},
 e as (select *, case risk_band when 'low' then 'allow' when 'medium' then 'nudge' when 'high' then 'soft_block' else 'hard_block' end as base_action, {ESCALATE.format(n='strike_count')} as esc from n),
 f as (select *, case when esc is not null and {SEVERITY_SQL.format(a='esc')} > {SEVERITY_SQL.format(a='base_action')} then esc else base_action end as action from e)"""


#: Length in UTF-16 units.
UNITS = "(length({t}) + length(regexp_replace({t}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def _gate_sql(relation: str, keep: str, text: str = "text") -> str:
    """The gate as common table expressions m (counts) and g (score and action)."""
    lit = lambda p: "'" + p.replace("'", "''") + "'"

    def count(kind: str) -> str:
        each = ", ".join(f"regexp_extract_all(t, {lit(gate.spaced(p))})" for p in gate.PATTERNS[kind])
        return f"len(list_distinct(list_transform(flatten([{each}]), lambda x: regexp_replace(x, '^[{gate.SPACE}]+|[{gate.SPACE}]+$', '', 'g'))))"

    counts = ", ".join(f"{count(k)} as n_{k}" for k in gate.KINDS)
    best = "greatest(" + ", ".join(f"case when n_{k} > 0 then {w}::double else 0.0::double end" for k, w in gate.WEIGHTS.items()) + ")"
    total = "0.0::double" + "".join(f" + least(n_{k}, 3) / 3.0::double * {w}::double" for k, w in gate.WEIGHTS.items())
    kinds = "(" + " + ".join(f"(n_{k} > 0)::int" for k in gate.KINDS) + ")"
    return f"""t as (select {keep}, {text} as content, case when {UNITS.format(t=text)} <= {gate.MAX_LENGTH} then {text} else '' end as t from {relation}),
 m as (select *, {counts} from t),
 g as (select *, case when coalesce(content, '') = '' then 0.0::double when {UNITS.format(t='content')} > {gate.MAX_LENGTH} then 1.0::double when {kinds} = 0 then 0.0::double
  else least(greatest({best} * 0.85::double, ({total}) * 0.7::double) + greatest({kinds} - 1, 0) * 0.10::double, 1.0::double) end as risk_score from m),
 h as (select *, case when risk_score >= 0.65 then 'hard_block' when risk_score >= 0.4 then 'nudge' else 'allow' end as action from g)"""


def register(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


# ---- the gate ---------------------------------------------------------------------

_COUNTS = ", ".join(f"cast(n_{k} as integer) as n_{k}" for k in gate.KINDS)


@register("gate_type_counts", f"with {_gate_sql('documents', 'doc_id')} select doc_id, {_COUNTS} from m")
def gate_type_counts(spark, sf_dir):
    return gate.with_matches(views.document_messages(spark, sf_dir)).select("doc_id", *[f"n_{k}" for k in gate.KINDS])


@register("gate_decisions", f"with {_gate_sql('documents', 'doc_id')} select doc_id, round(risk_score, 6) as risk_score, action, action <> 'hard_block' as allowed from h")
def gate_decisions(spark, sf_dir):
    return gate.gate(views.document_messages(spark, sf_dir)).select("doc_id", F.round("risk_score", 6).alias("risk_score"), "action", "allowed")


@register("gate_decision_by_lang", f"with {_gate_sql('documents', 'lang')} select lang, action, count(*) as messages, round(sum(round(risk_score, 6)), 3) as risk from h group by lang, action")
def gate_decision_by_lang(spark, sf_dir):
    g = gate.gate(views.document_messages(spark, sf_dir))
    return g.groupBy("lang", "action").agg(F.count(F.lit(1)).alias("messages"), F.round(F.sum(F.round("risk_score", 6)), 3).alias("risk"))


@register("gate_length_guard", f"select doc_id, length(text) as n, {UNITS.format(t='text')} > {gate.MAX_LENGTH} as too_long, coalesce(text, '') = '' as no_text from documents")
def gate_length_guard(spark, sf_dir):
    d = views.document_messages(spark, sf_dir)
    return d.select("doc_id", F.length("content").cast("long").alias("n"), gate.too_long(F.col("content")).alias("too_long"), (F.coalesce("content", F.lit("")) == "").alias("no_text"))


@register("gate_conversation_roles", f"with {_gate_sql('conversations', 'role')} select role, action, count(*) as messages, max(round(risk_score, 6)) as most from h group by role, action")
def gate_conversation_roles(spark, sf_dir):
    g = gate.gate(views.conversation_messages(spark, sf_dir))
    return g.groupBy("role", "action").agg(F.count(F.lit(1)).alias("messages"), F.max(F.round("risk_score", 6)).alias("most"))


@register("gate_pages", f"with {_gate_sql('pages', 'page_id', 'html')} select page_id, round(risk_score, 6) as risk_score, action from h")
def gate_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("content"))
    return gate.gate(pages).select("page_id", F.round("risk_score", 6).alias("risk_score"), "action")


_NUDGE_SQL = "case when risk_score >= 0.4 and risk_score < 0.65 then case when n_phone > 0 or n_email > 0 then 'contact' when n_social > 0 then 'social' else 'other' end end"


@register("gate_nudges", f"with {_gate_sql('documents', 'doc_id')} select {_NUDGE_SQL} as nudge, count(*) as messages from h group by 1")
def gate_nudges(spark, sf_dir):
    text = F.col("nudge_message")
    name = F.when(text == gate.NUDGE_CONTACT, "contact").when(text == gate.NUDGE_SOCIAL, "social").when(text.isNotNull(), "other")
    return gate.gate(views.document_messages(spark, sf_dir)).groupBy(name.alias("nudge")).agg(F.count(F.lit(1)).alias("messages"))


# ---- policy -----------------------------------------------------------------------


@register("risk_bands", f"with {DETECTIONS}, {BANDS} select risk_band, count(*) as detections, count(distinct user_id) as users from b group by risk_band")
def risk_bands(spark, sf_dir):
    d = views.detections(spark, sf_dir).withColumn("risk_band", policy.risk_band(F.col("risk_score")))
    return d.groupBy("risk_band").agg(F.count(F.lit(1)).alias("detections"), F.count_distinct("user_id").alias("users"))


@register(
    "band_range_join",
    f"""with {DETECTIONS}, r(band, lo, hi) as (values ('low', -1.0, 0.39), ('medium', 0.39, 0.64), ('high', 0.64, 0.84), ('critical', 0.84, 1.0))
 select band, count(*) as detections from d join r on risk_score > lo and risk_score <= hi group by band""",
)
def band_range_join(spark, sf_dir):
    """Scores meet four ranges; the range side is a literal of four rows."""
    t = policy.Thresholds()
    edges = spark.createDataFrame([("low", -1.0, t.allow_max), ("medium", t.allow_max, t.nudge_max), ("high", t.nudge_max, t.soft_block_max), ("critical", t.soft_block_max, 1.0)], "band string, lo double, hi double")
    d = views.detections(spark, sf_dir)
    joined = d.join(F.broadcast(edges), (d["risk_score"] > edges["lo"]) & (d["risk_score"] <= edges["hi"]))
    return joined.groupBy("band").agg(F.count(F.lit(1)).alias("detections"))


@register(
    "ui_badge_vs_band",
    f"""with {DETECTIONS}, {BANDS}, u as (select risk_band, case when risk_score >= 0.85 then 'critical' when risk_score >= 0.65 then 'high' when risk_score >= 0.40 then 'medium' else 'low' end as badge from b)
 select risk_band, badge, count(*) as detections from u group by all""",
)
def ui_badge_vs_band(spark, sf_dir):
    d = views.detections(spark, sf_dir)
    return d.groupBy(policy.risk_band(F.col("risk_score")).alias("risk_band"), policy.ui_badge(F.col("risk_score")).alias("badge")).agg(F.count(F.lit(1)).alias("detections"))


def _strikes(spark, sf_dir):
    d = views.detections(spark, sf_dir).withColumn("risk_band", policy.risk_band(F.col("risk_score")))
    return policy.with_active_strikes(d, F.col("risk_band").isin("high", "critical"), DAYS)


@register("strike_numbers", f"with {DETECTIONS}, {BANDS}, {STRIKES} select detection_id, user_id, strike_count as strike_number from n where is_strike")
def strike_numbers(spark, sf_dir):
    return _strikes(spark, sf_dir).filter(F.col("risk_band").isin("high", "critical")).select("detection_id", "user_id", F.col("active_strikes").alias("strike_number"))


@register("strike_escalation", f"with {DETECTIONS}, {BANDS}, {STRIKES} select {ESCALATE.format(n='strike_count')} as action, count(*) as strikes from n where is_strike group by 1")
def strike_escalation(spark, sf_dir):
    s = _strikes(spark, sf_dir).filter(F.col("risk_band").isin("high", "critical"))
    return s.groupBy(policy.escalation(F.col("active_strikes")).alias("action")).agg(F.count(F.lit(1)).alias("strikes"))


@register("enforcement", f"with {ENFORCED} select detection_id, risk_band, base_action, strike_count, action, case action when 'cooldown' then 24 when 'restriction' then 72 end as duration_hours, case when action in ('cooldown','restriction','suspension_candidate') then 'account' else 'message' end as scope from f")
def enforcement(spark, sf_dir):
    return policy.enforce(views.detections(spark, sf_dir), window_days=DAYS).select("detection_id", "risk_band", "base_action", "strike_count", "action", "duration_hours", "scope")


_MESSAGE_SQL = "case action " + " ".join("when '{}' then '{}'".format(a, m.replace("'", "''")) for a, m in policy.MESSAGES.items()) + " end"


@register("enforcement_messages", f"with {ENFORCED} select detection_id, replace(replace({_MESSAGE_SQL}, '{{labels}}', thread_id), '{{strikes}}', cast(strike_count as varchar)) as user_message from f")
def enforcement_messages(spark, sf_dir):
    return policy.enforce(views.detections(spark, sf_dir), window_days=DAYS).select("detection_id", "user_message")


@register("enforcement_mix", f"with {ENFORCED} select cast(created_at as date) as day, {', '.join(f'''count(*) filter (where action = '{a}') as {a}''' for a in policy.SEVERITY)} from f group by 1")
def enforcement_mix(spark, sf_dir):
    e = policy.enforce(views.detections(spark, sf_dir), window_days=DAYS).withColumn("day", F.to_date("created_at"))
    return e.groupBy("day").agg(*[F.count_if(F.col("action") == a).alias(a) for a in policy.SEVERITY])


NOW = "2024-01-20 00:00:00"


@register("active_strikes_asof", f"with {DETECTIONS}, {BANDS} select user_id, count(*) as active_strikes from b where risk_band in ('high','critical') and created_at + interval {DAYS} day > timestamp '{NOW}' group by user_id")
def active_strikes_asof(spark, sf_dir):
    strikes = policy.strikes_from(policy.enforce(views.detections(spark, sf_dir), window_days=DAYS), DAYS)
    return policy.active(strikes, F.lit(NOW).cast("timestamp")).groupBy("user_id").agg(F.count(F.lit(1)).alias("active_strikes"))


@register("expired_strikes", f"with {DETECTIONS}, {BANDS} select user_id, count(*) filter (where created_at + interval {DAYS} day <= timestamp '{NOW}') as expired, count(*) as strikes from b where risk_band in ('high','critical') group by user_id")
def expired_strikes(spark, sf_dir):
    strikes = policy.strikes_from(policy.enforce(views.detections(spark, sf_dir), window_days=DAYS), DAYS)
    return policy.expire(strikes, F.lit(NOW).cast("timestamp")).groupBy("user_id").agg(F.count_if("expired").alias("expired"), F.count(F.lit(1)).alias("strikes"))


@register(
    "strike_interval_join",
    f"""with {DETECTIONS}, {BANDS} select d.detection_id, count(*) as strikes from b d join b s on s.user_id = d.user_id and s.risk_band in ('high', 'critical')
 and (s.us < d.us or (s.us = d.us and s.detection_id <= d.detection_id)) and d.us < s.us + {SPAN} group by d.detection_id""",
)
def strike_interval_join(spark, sf_dir):
    """Strikes in force at each detection's time, by an interval join dealt by (user, period)."""
    d = views.detections(spark, sf_dir).select("detection_id", "user_id", "created_at", policy.risk_band(F.col("risk_score")).alias("risk_band"))
    strikes = d.filter(F.col("risk_band").isin("high", "critical"))
    return policy.strikes_in_force(d, strikes, DAYS).select("detection_id", "strikes")


@register(
    "config_asof",
    f"""with {DETECTIONS}, cfg(config_value, version, activated_at) as (values ('0.39', 1, timestamp '2023-12-01 00:00:00'), ('0.35', 2, timestamp '2024-01-10 12:00:00'), ('0.45', 3, timestamp '2024-01-20 06:30:00'))
 select version, count(*) as detections, count(*) filter (where risk_score > cast(config_value as double)) as above from d asof join cfg on d.created_at >= cfg.activated_at group by version""",
)
def config_asof(spark, sf_dir):
    rows = [("allow_max", "0.39", 1, "2023-12-01 00:00:00"), ("allow_max", "0.35", 2, "2024-01-10 12:00:00"), ("allow_max", "0.45", 3, "2024-01-20 06:30:00")]
    config = spark.createDataFrame(rows, "config_key string, config_value string, version int, activated_at string").withColumn("activated_at", F.col("activated_at").cast("timestamp"))
    d = policy.config_as_of(views.detections(spark, sf_dir), config)
    return d.groupBy("version").agg(F.count(F.lit(1)).alias("detections"), F.count_if(F.col("risk_score") > F.col("config_value").cast("double")).alias("above"))


_VERSIONS_SQL = """ver as (select row_number() over (order by min(ts), event_type) as version, min(ts) + interval 8 day as activated_at, round(0.30::double + 0.02::double * length(event_type) / 2, 6) as allow_max,
  round(0.55::double + 0.01::double * length(event_type), 6) as nudge_max, round(0.75::double + 0.01::double * length(event_type), 6) as soft_block_max from events group by event_type)"""


def _versions(spark, sf_dir):
    """An update of the thresholds eight days after each event type was first seen."""
    first = table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("ts").cast("timestamp").alias("first"))
    n = F.length("event_type")
    return first.select(
        F.row_number().over(Window.orderBy("first", "event_type")).alias("version"), (F.col("first") + F.make_dt_interval(F.lit(8))).alias("activated_at"),
        F.round(F.lit(0.30) + F.lit(0.02) * n / 2, 6).alias("allow_max"), F.round(F.lit(0.55) + F.lit(0.01) * n, 6).alias("nudge_max"), F.round(F.lit(0.75) + F.lit(0.01) * n, 6).alias("soft_block_max"),
    )  # fmt: skip  one row per event type


_BANDS_AS_OF = """o as (select d.*, coalesce(version, 0) as t_version, coalesce(allow_max, 0.39) as a, coalesce(nudge_max, 0.64) as m, coalesce(soft_block_max, 0.84) as x from d asof left join ver on d.created_at >= ver.activated_at),
 b as (select *, case when risk_score <= a then 'low' when risk_score <= m then 'medium' when risk_score <= x then 'high' else 'critical' end as risk_band from o)"""


@register("enforcement_asof", f"with {_VERSIONS_SQL}, {ENFORCED.replace(BANDS, _BANDS_AS_OF)} select detection_id, cast(t_version as integer) as t_version, risk_band, strike_count, action from f")
def enforcement_asof(spark, sf_dir):
    """Thresholds that change while events arrive: each is judged by the version in force."""
    d = policy.enforce_as_of(views.detections(spark, sf_dir), _versions(spark, sf_dir), DAYS)
    return d.select("detection_id", "t_version", "risk_band", "strike_count", "action")


# ---- behaviour --------------------------------------------------------------------

_THREADS_SQL = """w as (select *, sum(new) over (partition by user_id order by created_at, detection_id rows unbounded preceding) as thread_count
 from (select *, (row_number() over (partition by user_id, thread_id order by created_at, detection_id) = 1)::int as new from d))"""
_CROSS_SQL = "case when thread_count >= 2 then least(0.25::double + (thread_count - 2) * 0.15::double, 0.6::double) else 0.0::double end"


@register("stage3_as_executed", f"with {DETECTIONS}, {_THREADS_SQL} select detection_id, cast(thread_count as bigint) as thread_count, round({_CROSS_SQL}, 3) as stage3_score from w")
def stage3_as_executed(spark, sf_dir):
    return behavior.stage3_as_executed(views.detections(spark, sf_dir)).select("detection_id", "thread_count", "stage3_score")


_DOC_SQL = f"""{DETECTIONS}, {_THREADS_SQL},
 x as (select *, count(*) over (partition by user_id, thread_id order by created_at, detection_id rows between unbounded preceding and 1 preceding) as n,
  count(*) over (partition by user_id order by created_at, detection_id rows between unbounded preceding and 1 preceding) as u,
  (us - lag(us) over (partition by user_id, thread_id order by created_at, detection_id)) / 1e6::double as gap,
  (row_number() over (partition by user_id, thread_id, k order by created_at, detection_id) = 1)::int as fresh from w),
 y as (select *, coalesce(sum(fresh) over (partition by user_id, thread_id order by created_at, detection_id rows between unbounded preceding and 1 preceding), 0) as kinds from x)"""


@register(
    "stage3_as_documented",
    f"""with {_DOC_SQL} select detection_id, round(greatest(0.0::double, case when n >= 3 then least(0.3::double + (n - 3) * 0.1::double, 0.7::double) when n >= 1 then n * 0.1::double else 0.0::double end, {_CROSS_SQL},
 case when n >= 2 and gap < 60 then 0.5::double when n >= 2 and gap < 300 then 0.3::double else 0.0::double end, case when kinds >= 3 then least(0.4::double + (kinds - 3) * 0.1::double, 0.7::double) else 0.0::double end,
 case when u >= 5 then least(0.3::double + (u - 5) * 0.05::double, 0.6::double) else 0.0::double end), 3) as stage3_score,
 cast((n >= 3)::int + (thread_count >= 2)::int + coalesce((n >= 2 and gap < 60)::int, 0) + (kinds >= 3)::int + (u >= 5)::int as integer) as n_labels from y""",
)
def stage3_as_documented(spark, sf_dir):
    d = behavior.stage3_as_documented(views.detections(spark, sf_dir), kind="k")
    return d.select("detection_id", "stage3_score", F.size("stage3_labels").alias("n_labels"))


@register(
    "burst_sessions",
    """with g as (select user_id, ts, value, coalesce((ts - lag(ts) over (partition by user_id order by ts) >= interval 30 minute)::int, 1) as fresh from events),
 s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as session from g),
 p as (select user_id, session, min(ts) as session_start, count(*) as events, round(sum(value), 4) as total from s group by user_id, session)
 select user_id, session_start, events, total from p""",
)
def burst_sessions(spark, sf_dir):
    """Event-time sessions with a gap of thirty minutes."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "events", "total")


@register("tumbling_counts", "select time_bucket(interval 6 hour, ts) as window_start, event_type, count(*) as events from events group by all")
def tumbling_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    t = e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"))
    return t.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "events")


# ---- review -----------------------------------------------------------------------


@register("case_page", f"with {CASES} select case_id, user_id, priority, created_at, count(*) over () as total from c where status = 'open' and priority >= 3 order by priority desc, created_at, case_id limit 50 offset 20")
def case_page(spark, sf_dir):
    page = review.list_cases(views.cases(spark, sf_dir), status="open", min_priority=3, offset=20, limit=50)
    return page.select("case_id", "user_id", "priority", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "total")


@register(
    "queue_stats",
    f"""with {CASES}, q as (select count(*) filter (where status = 'open') as open_cases, count(*) filter (where status = 'in_review') as in_review_cases, count(*) filter (where status = 'resolved') as resolved_cases,
 count(*) filter (where status = 'resolved' and resolution = 'false_positive') as wrong from c)
 select open_cases, in_review_cases, resolved_cases, coalesce(round(wrong / nullif(resolved_cases, 0), 3), 0) as false_positive_rate, open_cases + in_review_cases + resolved_cases as total_cases,
 coalesce(round(resolved_cases / nullif(open_cases + in_review_cases + resolved_cases, 0), 3), 0) as resolution_rate from q""",
)
def queue_stats(spark, sf_dir):
    return review.queue_stats(views.cases(spark, sf_dir))


@register("queue_period", f"with {CASES} select case when priority >= 5 then 'red' when priority >= 3 then 'orange' else 'grey' end as bucket, count(*) as cases from c where created_at > timestamp '1997-06-30' - interval 90 day and created_at <= timestamp '1997-06-30' group by 1")
def queue_period(spark, sf_dir):
    """Cases of a period by the queue's colours."""
    c = review.in_period(views.cases(spark, sf_dir), 90, F.lit("1997-06-30").cast("timestamp"))
    return c.groupBy(review.priority_bucket(F.col("priority")).alias("bucket")).agg(F.count(F.lit(1)).alias("cases"))


@register("audit_size", "select count(*) as actions from lineitem")
def audit_size(spark, sf_dir):
    return review.audit_size(review.record(views.actions(spark, sf_dir)))


def _updates(spark, sf_dir):
    """Events as updates of the case of their user: k picks what is set."""
    e = views.detections(spark, sf_dir).filter("k is not null")
    k = F.col("k")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.floor(k / 7) % len(values) + 1).cast("int"))
    return e.select(
        F.col("user_id").alias("case_id"), F.col("detection_id").alias("seq"), F.col("created_at").alias("ts"),
        F.when(k % 3 == 0, pick(["open", "in_review", "resolved", "appealed", "overturned"])).alias("status"), F.when(k % 4 == 1, k.cast("string")).alias("assigned_to"),
        F.when(k % 5 == 2, pick(["confirmed", "false_positive"])).alias("resolution"), F.when(k % 5 == 3, F.concat(F.lit("note "), k.cast("string"))).alias("note"),
        F.when((k % 3 != 0) & (k % 7 == 2), F.concat(F.lit("reason "), k.cast("string"))).alias("appeal"),
    )


@register(
    "case_updates",
    f"""with recursive {DETECTIONS}, u as (select user_id as case_id, detection_id as seq, row_number() over (partition by user_id order by detection_id) as n,
  case when k % 3 = 0 then ['open', 'in_review', 'resolved', 'appealed', 'overturned'][(k // 7) % 5 + 1] end as status, case when k % 4 = 1 then cast(k as varchar) end as assigned,
  case when k % 5 = 2 then ['confirmed', 'false_positive'][(k // 7) % 2 + 1] end as resolution, case when k % 5 = 3 then 'note ' || k end as note, case when k % 3 <> 0 and k % 7 = 2 then 'reason ' || k end as appeal from d where k is not null),
 f(case_id, n, status, assigned_to, resolution, note, refused) as (select distinct case_id, 0, 'open', null::varchar, null::varchar, null::varchar, 0 from u
  union all select case_id, n, case when not ok then old when appeal is not null then 'appealed' when assigned is not null and new_status = 'open' then 'in_review' else new_status end,
   case when ok then coalesce(assigned, assigned_to) else assigned_to end, case when ok then coalesce(resolution, res) else res end,
   case when ok then coalesce('Appeal reason: ' || appeal, new_note, note) else note end, refused + (not ok)::int
  from (select f.case_id, u.n, f.status as old, coalesce(u.status, f.status) as new_status, u.assigned, f.assigned_to, u.resolution, f.resolution as res, u.note as new_note, f.note, u.appeal, f.refused,
   (u.status is null or (f.status, u.status) in (('open', 'in_review'), ('open', 'resolved'), ('in_review', 'resolved'), ('in_review', 'open'), ('resolved', 'appealed'), ('appealed', 'in_review'), ('appealed', 'overturned')))
    and (u.appeal is null or coalesce(u.status, f.status) = 'resolved') as ok from f join u on u.case_id = f.case_id and u.n = f.n + 1))
 select case_id, arg_max(status, n) as status, arg_max(assigned_to, n) filter (where assigned_to is not null) as assigned_to, arg_max(resolution, n) filter (where resolution is not null) as resolution,
  arg_max(note, n) filter (where note is not null) as note, max(refused) as refused from f group by case_id""",
)
def case_updates(spark, sf_dir):
    return review.apply_case_updates(_updates(spark, sf_dir)).drop("updated_at")


@register(
    "case_assignments",
    f"""with {DETECTIONS}, e as (select detection_id as seq, ['assign', 'unassign', 'assign', 'resolve'][k % 4 + 1] as kind, k % 11 as moderator, user_id as case_id from d where k is not null),
 done as (select case_id, max(seq) as done from e where kind = 'resolve' group by case_id),
 p as (select moderator, case_id, max(seq) as last, arg_max(kind, seq) as kind from e where kind in ('assign', 'unassign') group by all)
 select moderator, count(*) as cases from p left join done using (case_id) where kind = 'assign' and (done is null or done < last) group by moderator""",
)
def case_assignments(spark, sf_dir):
    return review.assignments(_assignment_events(spark, sf_dir)).groupBy("moderator").agg(F.count(F.lit(1)).alias("cases"))


def _assignment_events(spark, sf_dir):
    kinds = F.element_at(F.array(*map(F.lit, ["assign", "unassign", "assign", "resolve"])), (F.col("k") % 4 + 1).cast("int"))
    return views.detections(spark, sf_dir).filter("k is not null").select(F.col("detection_id").alias("seq"), kinds.alias("kind"), (F.col("k") % 11).alias("moderator"), F.col("user_id").alias("case_id"))


@register(
    "case_admissions",
    f"""with recursive {DETECTIONS}, e as (select detection_id as seq, ['assign', 'unassign', 'assign', 'resolve'][k % 4 + 1] as kind, k % 11 as moderator, user_id as case_id from d where k is not null),
 asked as (select distinct moderator, case_id from e where kind = 'assign'),
 l as (select *, row_number() over (partition by moderator order by seq, kind) as n from (select * from e where kind in ('assign', 'unassign') union all select e.seq, e.kind, a.moderator, e.case_id from e join asked a using (case_id) where kind = 'resolve')),
 f(moderator, n, seq, kind, case_id, admitted, held) as (select distinct moderator, 0::bigint, null::bigint, null::varchar, null::bigint, null::boolean, []::bigint[] from l
  union all select l.moderator, l.n, l.seq, l.kind, l.case_id, case when l.kind = 'assign' then len(held) < {review.CAPACITY} end,
   case when l.kind <> 'assign' then list_filter(held, lambda x: x <> l.case_id) when len(held) < {review.CAPACITY} and not list_contains(held, l.case_id) then list_append(held, l.case_id) else held end
   from f join l on l.moderator = f.moderator and l.n = f.n + 1)
 select seq, kind, moderator, case_id, admitted, cast(len(held) as integer) as load from f where n > 0""",
)
def case_admissions(spark, sf_dir):
    """Requests for cases under the cap: who is refused, and how full each moderator is."""
    return review.admissions(_assignment_events(spark, sf_dir))


_LABELS_SQL = " union all ".join(f"select '{gate.LABELS[k]}' as label, count(*) as count from m where n_{k} > 0" for k in gate.KINDS)


@register("top_labels", f"with {_gate_sql('documents', 'doc_id')}, l as ({_LABELS_SQL} union all select 'message_too_long', count(*) from m where {UNITS.format(t='content')} > {gate.MAX_LENGTH}) select label, count from l where count > 0")
def top_labels(spark, sf_dir):
    return review.top_labels(gate.gate(views.document_messages(spark, sf_dir)))


@register(
    "case_detail",
    f"""with {CASES}, {ACTIONS}, n as (select case_id, count(*) as n_actions, count(*) filter (where is_permanent) as n_permanent from a group by case_id)
 select c.case_id, status, cast(coalesce(n_actions, 0) as integer) as n_actions, cast(coalesce(n_permanent, 0) as integer) as n_permanent from c left join n using (case_id)""",
)
def case_detail(spark, sf_dir):
    d = review.case_detail(views.cases(spark, sf_dir), views.actions(spark, sf_dir))
    return d.select("case_id", "status", F.size("actions").alias("n_actions"), F.size(F.filter("actions", lambda a: a["is_permanent"])).alias("n_permanent"))


@register(
    "case_detail_full",
    f"""with {CASES}, {ACTIONS}, {ENFORCED}, na as (select case_id, count(*) as n_actions from a group by case_id), st as (select detection_id, count(*) as n_strikes, max(strike_count) as strike_number from f where is_strike group by 1)
 select c.case_id, cast(coalesce(n_actions, 0) as integer) as n_actions, f.risk_score, f.thread_id, cast(coalesce(n_strikes, 0) as integer) as n_strikes, st.strike_number
 from c left join na using (case_id) left join f on f.detection_id = c.case_id left join st on st.detection_id = c.case_id""",
)
def case_detail_full(spark, sf_dir):
    """Cases with their actions, the detection they were opened for (that of their number) and its strikes."""
    cases = views.cases(spark, sf_dir).withColumn("detection_id", F.col("case_id"))
    found = views.detections(spark, sf_dir)
    strikes = policy.with_cases(policy.strikes_from(policy.enforce(found, window_days=DAYS), DAYS), cases).filter("case_id is not null")
    d = review.case_detail(cases, views.actions(spark, sf_dir), found.select("detection_id", "risk_score", "thread_id"), strikes.select("case_id", "id", "strike_number", "action_taken"))
    strikes = F.coalesce(F.transform("strikes", lambda s: s["strike_number"]), F.array().cast("array<int>"))
    return d.select("case_id", F.size("actions").alias("n_actions"), "detection.risk_score", "detection.thread_id", F.size(strikes).alias("n_strikes"), F.array_max(strikes).alias("strike_number"))


@register(
    "case_actions",
    f"""with {CASES}, {ACTIONS} select case_id, action_no, actor_id, cast(row_number() over (partition by case_id order by created_at, action_no, actor_id) as integer) as nth
 from a where case_id in (select case_id from c where status = 'in_review')""",
)
def case_actions(spark, sf_dir):
    found = review.case_actions(views.actions(spark, sf_dir), views.cases(spark, sf_dir).filter("status = 'in_review'"))
    return found.select("case_id", "action_no", "actor_id", "nth")


_STATUS = ["open", "in_review", "resolved", "appealed", "overturned"]


def _changes(spark, sf_dir):
    """Events as status changes: the status is taken from the event's k, the one before it from the user's line."""
    e = views.detections(spark, sf_dir)
    status = F.element_at(F.array(*map(F.lit, _STATUS)), (F.col("k") % 5 + 1).cast("int"))
    e = e.withColumn("to_status", status)
    return e.withColumn("from_status", F.lag("to_status").over(Window.partitionBy("user_id").orderBy("created_at", "detection_id"))).filter("from_status is not null")


_PAIRS_SQL = ", ".join(f"('{a}', '{b}')" for a, bs in review.TRANSITIONS.items() for b in bs)


@register(
    "illegal_transitions",
    f"""with {DETECTIONS}, s as (select *, {_STATUS}[k % 5 + 1] as to_status from d), l as (select *, lag(to_status) over (partition by user_id order by created_at, detection_id) as from_status from s),
 ok(from_status, to_status) as (values {_PAIRS_SQL}) select from_status, to_status, count(*) as changes from l anti join ok using (from_status, to_status) where from_status is not null group by all""",
)
def illegal_transitions(spark, sf_dir):
    bad = review.illegal_transitions(_changes(spark, sf_dir), review.allowed_pairs(spark))
    return bad.groupBy("from_status", "to_status").agg(F.count(F.lit(1)).alias("changes"))


@register("moderator_load", f"with {CASES} select assigned_to, count(distinct case_id) as load from c where status = 'in_review' group by assigned_to")
def moderator_load(spark, sf_dir):
    return review.moderator_load(views.cases(spark, sf_dir))


@register("least_loaded", f"with {CASES} select user_id % 400 as moderator, count(distinct case_id) as load from c where status = 'in_review' group by 1 having count(distinct case_id) < {review.CAPACITY} order by load, moderator limit 1")
def least_loaded(spark, sf_dir):
    """Of 400 moderators those with cases in review and room for more; full ones are not taken."""
    load = review.moderator_load(views.cases(spark, sf_dir).withColumn("assigned_to", F.col("user_id") % 400))
    people = load.select(F.col("assigned_to").alias("moderator"), F.col("assigned_to").alias("ord"))
    return review.least_loaded(people, load).select("moderator", "load")


@register("full_moderators", f"with {CASES} select assigned_to as moderator, count(distinct case_id) as load from c where status = 'in_review' group by 1 having count(distinct case_id) >= {review.CAPACITY}")
def full_moderators(spark, sf_dir):
    load = review.moderator_load(views.cases(spark, sf_dir))
    return load.filter(F.col("load") >= review.CAPACITY).select(F.col("assigned_to").alias("moderator"), "load")


@register("pending_approvals", f"with {ACTIONS} select case_id, action_no, actor_id from a where is_permanent and approved_by is null")
def pending_approvals(spark, sf_dir):
    return review.pending_approvals(views.actions(spark, sf_dir)).select("case_id", "action_no", "actor_id")


@register("recent_actions", f"with {ACTIONS} select case_id, action_no, actor_id from a order by created_at desc, case_id, action_no limit 50")
def recent_actions(spark, sf_dir):
    return review.recent_actions(views.actions(spark, sf_dir)).select("case_id", "action_no", "actor_id")


@register("users_without_strikes", f"with {DETECTIONS}, {BANDS} select c_custkey as user_id from customer where c_custkey not in (select user_id from b where risk_band in ('high','critical') and user_id is not null)")
def users_without_strikes(spark, sf_dir):
    d = views.detections(spark, sf_dir).withColumn("risk_band", policy.risk_band(F.col("risk_score")))
    strikes = d.filter(F.col("risk_band").isin("high", "critical")).select("user_id")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")).join(strikes, "user_id", "left_anti")


@register(
    "detection_quality",
    f"""with {_gate_sql('documents', 'doc_id')} select action, toxic, count(*) as documents, round(avg(round(risk_score, 6)), 4) as mean_score from h join labels using (doc_id) group by action, toxic""",
)
def detection_quality(spark, sf_dir):
    """Labels first: what has none needs no decision."""
    g = gate.gate(views.document_messages(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id"))
    return g.groupBy("action", "toxic").agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg(F.round("risk_score", 6)), 4).alias("mean_score"))


@register("resolution_hours", f"with {CASES}, {ACTIONS}, r as (select case_id, max(created_at) as done from a group by case_id) select priority, count(*) as cases, round(avg(epoch(done) - epoch(c.created_at)) / 3600, 3) as mean_hours from c join r using (case_id) where status = 'resolved' group by priority")
def resolution_hours(spark, sf_dir):
    done = views.actions(spark, sf_dir).groupBy("case_id").agg(F.max("created_at").alias("done"))
    c = views.cases(spark, sf_dir).filter("status = 'resolved'").join(done, "case_id")
    return c.groupBy("priority").agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg(F.unix_timestamp("done") - F.unix_timestamp("created_at")) / 3600, 3).alias("mean_hours"))


# ---- detection --------------------------------------------------------------------

from brindle.functions import patterns as P  # noqa: E402
from brindle.functions import text as T  # noqa: E402
from brindle.operators import detect  # noqa: E402

def _values(spark, sf_dir, p: str):
    """Matches of one pattern in whole documents, as the detectors find them."""
    from brindle.operators import spans

    m = spread(views.document_messages(spark, sf_dir))
    return m.select("doc_id", F.explode_outer(F.expr(spans.found("content", p))).alias("m")).filter("m is not null").select("doc_id", "m.v")


@register("token_hashes")
def token_hashes(spark, sf_dir):
    return _values(spark, sf_dir, P.EMAIL["standard"]).select("doc_id", T.token_hash(F.col("v")).alias("token_hash")).distinct()


@register("phone_values")
def phone_values(spark, sf_dir):
    return _values(spark, sf_dir, P.PHONE["us_format"]).groupBy(F.col("v").alias("phone")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"))


@register("url_values")
def url_values(spark, sf_dir):
    return _values(spark, sf_dir, P.URL["full"]).groupBy(F.col("v").alias("url")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"))


def _span_rows(kind: str):
    def query(spark, sf_dir):
        # Outer: of a plain explode Spark derives a filter that finds all spans first, once or twice more, and in front of spread().
        spans = detect.with_spans(views.document_messages(spark, sf_dir), kind).select("doc_id", F.explode_outer(f"{kind}_spans").alias("s")).filter("s is not null")
        return spans.select("doc_id", F.col("s.off").alias("offset"), F.col("s.len").alias("length"), F.round("s.conf", 3).alias("confidence"), T.token_hash(F.col("s.v")).alias("value_hash"))

    return query


for _kind in ("phone", "email", "url", "social", "intent", "obfuscation"):
    QUERIES[f"{_kind}_spans"] = _span_rows(_kind)


@register("deobfuscated_text")
def deobfuscated_text(spark, sf_dir):
    d = views.document_messages(spark, sf_dir)
    clean = T.deobfuscate(F.col("content"))
    return d.select("doc_id", F.length(clean).alias("n"), F.md5(clean).alias("clean_md5"))


@register("stage1_scores")
def stage1_scores(spark, sf_dir):
    m = detect.stage1(views.conversation_messages(spark, sf_dir))
    return m.select("message_id", "stage1_score", "stage1_labels", F.size("evidence").alias("n_spans"), F.size("hashed_tokens").alias("n_hashes"))


@register("combined_scores")
def combined_scores(spark, sf_dir):
    return detect.detect(views.conversation_messages(spark, sf_dir)).select("message_id", "stage1_score", "stage2_score", "risk_score", "stage", "labels")


_HITS_SQL = " + ".join("regexp_matches(t, '(?i){}')::int".format("|".join(f"(?:{p})" for p in group).replace("'", "''")) for _, group in P.CLUSTERS.values())


@register(
    "context_hits",
    f"""with t as (select conv_id, turn, text as t from conversations), h as (select conv_id, turn, coalesce({_HITS_SQL}, 0) as hits from t)
 select conv_id, turn, cast(coalesce(sum(hits) over (partition by conv_id order by turn rows between 5 preceding and 1 preceding), 0) as integer) as context_hits from h""",
)
def context_hits(spark, sf_dir):
    return detect.context_hits(views.conversation_messages(spark, sf_dir)).select(F.col("thread_id").alias("conv_id"), "turn", "context_hits")


# ---- operations metrics -----------------------------------------------------------

from brindle.operators import metrics  # noqa: E402


@register("value_percentiles", "select quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.95) as p95, quantile_cont(value, 0.99) as p99 from events")
def value_percentiles(spark, sf_dir):
    return metrics.latency(table(spark, sf_dir, "events"), "value")


@register("escalation_rate", f"with {ENFORCED} select count(*) filter (where action <> base_action) / count(*) as escalation_rate, count(*) filter (where is_strike) / count(distinct user_id) as strikes_per_user from f")
def escalation_rate(spark, sf_dir):
    return metrics.escalation_rate(policy.enforce(views.detections(spark, sf_dir), window_days=DAYS))


@register("latest_config", "select event_type || ':' || (user_id % 10) as config_key, arg_max(cast(value as varchar), event_id) as config_value, max(event_id) as version from events group by 1")
def latest_config(spark, sf_dir):
    """Events as changes of settings: one key per event type and tenth of the users, the value as text."""
    e = table(spark, sf_dir, "events")
    key = F.concat_ws(":", "event_type", (F.col("user_id") % 10).cast("string"))
    return review.latest_config(e.select(key.alias("config_key"), F.col("value").cast("string").alias("config_value"), F.col("event_id").alias("version")))


@register(
    "detection_case_strike_chain",
    f"""with {CASES}, {ACTIONS} select c.user_id, count(distinct c.case_id) as cases, count(*) as actions from customer u join c on c.user_id = u.c_custkey join a using (case_id) where c.status = 'resolved' group by c.user_id""",
)
def detection_case_strike_chain(spark, sf_dir):
    """The chain user, case, action as inner joins."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    cases = views.cases(spark, sf_dir).filter("status = 'resolved'").select("case_id", "user_id")
    chain = users.join(cases, "user_id").join(views.actions(spark, sf_dir).select("case_id"), "case_id")
    return chain.groupBy("user_id").agg(F.count_distinct("case_id").alias("cases"), F.count(F.lit(1)).alias("actions"))
