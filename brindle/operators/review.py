"""The review queue: case events, paging, details, statistics, moderators and the audit log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Legal changes of a case's status, and the limits of a page and of a moderator.
TRANSITIONS = {"open": ["in_review", "resolved"], "in_review": ["resolved", "open"], "resolved": ["appealed"], "appealed": ["in_review", "overturned"], "overturned": []}
PAGE_LIMIT, CAPACITY = 100, 10


def allowed_pairs(spark) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, bs in TRANSITIONS.items() for b in bs], "from_status string, to_status string")


def list_cases(cases: DataFrame, status: str | None = None, assigned_to: object = None, user_id: object = None, min_priority: int | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page, most urgent first, then oldest, then by id; absent filters do nothing. ``total`` counts all that the filters leave."""
    for name, value in (("status", status), ("assigned_to", assigned_to), ("user_id", user_id)):
        if value:
            cases = cases.filter(F.col(name) == value)
    if min_priority:
        cases = cases.filter(F.col("priority") >= min_priority)
    page = cases.orderBy(F.col("priority").desc(), "created_at", "case_id").offset(offset).limit(min(limit, PAGE_LIMIT))
    total = cases.agg(F.count(F.lit(1)).alias("total"))
    return page.crossJoin(F.broadcast(total))  # one row


def in_period(rows: DataFrame, days: int, now: Column, ts: str = "created_at") -> DataFrame:
    """Rows of the last ``days`` days before ``now``."""
    return rows.filter((F.col(ts) > now - F.make_dt_interval(F.lit(days))) & (F.col(ts) <= now))


def priority_bucket(priority: Column) -> Column:
    """The queue's colours: 5 and above are urgent, 3 and 4 raised."""
    return F.when(priority >= 5, "red").when(priority >= 3, "orange").when(priority.isNotNull(), "grey")


def queue_stats(cases: DataFrame) -> DataFrame:
    """One row: open, in review, resolved, the false-positive rate and the roll-ups of the dashboard."""
    n = lambda s: F.count_if(F.col("status") == s)
    wrong = F.count_if((F.col("status") == "resolved") & (F.col("resolution") == "false_positive"))
    s = cases.agg(n("open").alias("open_cases"), n("in_review").alias("in_review_cases"), n("resolved").alias("resolved_cases"), wrong.alias("_wrong"))
    rate = lambda a, b: F.coalesce(F.round(F.try_divide(a, b), 3), F.lit(0.0))
    s = s.withColumn("false_positive_rate", rate(F.col("_wrong"), F.col("resolved_cases"))).drop("_wrong")
    total = F.col("open_cases") + F.col("in_review_cases") + F.col("resolved_cases")
    return s.withColumn("total_cases", total).withColumn("resolution_rate", rate(F.col("resolved_cases"), F.col("total_cases")))


def top_labels(rows: DataFrame, labels: str = "labels", n: int = 10) -> DataFrame:
    """The n most frequent labels, ties by name."""
    return rows.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "label").limit(n)


def moderator_load(cases: DataFrame) -> DataFrame:
    return cases.filter("status = 'in_review' and assigned_to is not null").groupBy("assigned_to").agg(F.count_distinct("case_id").alias("load"))


def least_loaded(moderators: DataFrame, load: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The candidate with the smallest load under capacity; ties by order of candidates ``ord``."""
    full = moderators.join(load, moderators["moderator"] == load["assigned_to"], "left").select("moderator", "ord", F.coalesce("load", F.lit(0)).alias("load"))
    return full.filter(F.col("load") < capacity).orderBy("load", "ord").limit(1)


def assignments(events: DataFrame) -> DataFrame:
    """(moderator, case_id) now assigned, from (seq, kind, moderator, case_id): assign, unassign, and resolve, which frees a case from all.

    The last event of a pair decides, unless the case was resolved after it. A moderator's capacity is not looked at: see ``admissions``.
    """
    pair = events.filter("kind in ('assign', 'unassign')").groupBy("moderator", "case_id").agg(F.max(F.struct("seq", "kind")).alias("last"))
    done = events.filter("kind = 'resolve'").groupBy("case_id").agg(F.max("seq").alias("done"))
    out = pair.filter("last.kind = 'assign'").join(done, "case_id", "left").filter("done is null or done < last.seq")
    return out.select("moderator", "case_id")


def admissions(events: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Assignments in order under a cap: (seq, kind, moderator, case_id, admitted, load) of every request and of what frees places.

    A moderator who holds ``capacity`` cases is refused the next (``admitted`` is false; null for what is no request); unassign and
    resolve free the place. A resolve concerns whoever ever asked for its case, so it is sent to those moderators by a join on the
    case. What is left is ordered per moderator by nature: events are dealt by moderator, sorted by seq (Spark
    spills), and folded as a stream whose memory is the at most ``capacity`` cases held; many moderators are many tasks.
    """
    own = events.filter("kind in ('assign', 'unassign')").select("seq", "kind", "moderator", "case_id")
    asked = own.filter("kind = 'assign'").select("moderator", "case_id").distinct()
    done = events.filter("kind = 'resolve'").select("seq", "kind", "case_id").join(asked, "case_id").select("seq", "kind", "moderator", "case_id")
    line = own.unionByName(done).filter("moderator is not null").repartition("moderator").sortWithinPartitions("moderator", "seq", "kind")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, held = None, set()
        for rows in batches:
            admitted, load = [], []
            for kind, moderator, case in zip(rows["kind"], rows["moderator"], rows["case_id"], strict=True):
                if moderator != who:
                    who, held = moderator, set()
                fits = len(held) < capacity if kind == "assign" else None
                if fits:
                    held.add(case)
                elif kind != "assign":
                    held.discard(case)
                admitted.append(fits)
                load.append(len(held))
            yield rows.assign(admitted=pd.array(admitted, "boolean"), load=load)

    return line.mapInPandas(fold, ", ".join(f"{c} {t}" for c, t in line.dtypes) + ", admitted boolean, load int")


def illegal_transitions(changes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Changes (from_status, to_status, ...) that the state machine refuses."""
    return changes.join(F.broadcast(pairs), ["from_status", "to_status"], "left_anti")  # 8 pairs


def case_detail(cases: DataFrame, actions: DataFrame, detections: DataFrame | None = None, strikes: DataFrame | None = None) -> DataFrame:
    """Cases with nested actions, and detection and strikes where given; children are gathered per case before the join."""
    nested = actions.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "action_no", "actor_id", "is_permanent"))).alias("actions"))
    out = cases.join(nested, "case_id", "left").withColumn("actions", F.coalesce("actions", F.array().cast(nested.schema["actions"].dataType)))
    if detections is not None:
        out = out.join(detections.select("detection_id", F.struct(*detections.columns).alias("detection")), "detection_id", "left")
    if strikes is not None:
        by_case = strikes.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(*strikes.columns))).alias("strikes"))
        out = out.join(by_case, "case_id", "left")
    return out


def case_actions(actions: DataFrame, cases: DataFrame) -> DataFrame:
    """The actions of the given cases, numbered within each in order of time, number and actor; many cases at once are one semi-join."""
    found = actions.join(cases.select(F.col("case_id").alias("_a_case")).distinct(), F.col("case_id") == F.col("_a_case"), "left_semi")
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("case_id").orderBy("created_at", "action_no", "actor_id")))


def with_approval(actions: DataFrame) -> DataFrame:
    """What the audit log adds where it has not been recorded yet: permanent actions need a human."""
    return actions.withColumn("requires_human", F.col("is_permanent"))


def record(actions: DataFrame) -> DataFrame:
    """New actions as the audit log takes them: a permanent one waits for a human, nothing is approved yet."""
    return with_approval(actions).withColumn("approved_by", F.lit(None).cast(actions.schema["approved_by"].dataType))


def audit_size(actions: DataFrame) -> DataFrame:
    return actions.agg(F.count(F.lit(1)).alias("actions"))


def pending_approvals(actions: DataFrame) -> DataFrame:
    return with_approval(actions).filter("requires_human and approved_by is null")


def recent_actions(actions: DataFrame, n: int = 50) -> DataFrame:
    return actions.orderBy(F.col("created_at").desc(), "case_id", "action_no").limit(n)


UPDATE = {"status": "string", "assigned_to": "string", "resolution": "string", "note": "string", "appeal": "string"}


def apply_case_updates(updates: DataFrame) -> DataFrame:
    """Latest state of each case from its ordered updates: case_id, seq, ts and any of the columns of ``UPDATE``.

    An update takes what is not null: first the status, and where that change is illegal the whole update is
    refused; then the moderator, which puts an open case in review; then resolution and note, whatever the
    status. An ``appeal`` (its reason) is taken by resolved cases only and is kept as the note. The fold runs
    inside one row per case, whose updates are a case's own history.
    """
    fields = [F.col(c).cast(t).alias(c) if c in updates.columns else F.lit(None).cast(t).alias(c) for c, t in UPDATE.items()]
    history = updates.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("seq", *fields, "ts"))).alias("h"))
    legal = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)).cast("array<string>") for kv in TRANSITIONS.items() for x in kv])
    none = F.lit(None).cast("string")
    start = F.struct(F.lit("open").alias("status"), none.alias("assigned_to"), none.alias("resolution"), none.alias("note"), F.lit(0).alias("refused"), F.element_at("h", 1)["ts"].alias("updated_at"))

    def step(s: Column, e: Column) -> Column:
        changes = e["status"].isNull() | F.coalesce(F.array_contains(F.element_at(legal, s["status"]), e["status"]), F.lit(False))
        fine = changes & (e["appeal"].isNull() | (F.coalesce(e["status"], s["status"]) == "resolved"))
        status = F.coalesce(e["status"], s["status"])
        status = F.when((F.coalesce(e["assigned_to"], F.lit("")) != "") & (status == "open"), "in_review").otherwise(status)
        status = F.when(e["appeal"].isNotNull(), "appealed").otherwise(status)
        note = F.coalesce(F.concat(F.lit("Appeal reason: "), e["appeal"]), e["note"], s["note"])
        pick = lambda new, old: F.when(fine, new).otherwise(old)
        return F.struct(
            pick(status, s["status"]).alias("status"),
            pick(F.coalesce(e["assigned_to"], s["assigned_to"]), s["assigned_to"]).alias("assigned_to"),
            pick(F.coalesce(e["resolution"], s["resolution"]), s["resolution"]).alias("resolution"),
            pick(note, s["note"]).alias("note"),
            (s["refused"] + F.when(fine, 0).otherwise(1)).alias("refused"),
            pick(e["ts"], s["updated_at"]).alias("updated_at"),
        )

    return history.select("case_id", F.aggregate("h", start, step).alias("s")).select("case_id", "s.*")


def latest_config(config: DataFrame) -> DataFrame:
    """The newest version of every key, by a grouping that keeps one row per key from the first pass on."""
    rest = [c for c in config.columns if c != "config_key"]
    newest = config.groupBy("config_key").agg(F.max_by(F.struct(*rest), "version").alias("_n"))
    return newest.select("config_key", "_n.*").select(config.columns)
