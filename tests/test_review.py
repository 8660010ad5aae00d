from __future__ import annotations

from brindle.operators import review


def _fold(spark, rows):
    updates = spark.createDataFrame(rows, "case_id int, seq int, status string, assigned_to string, resolution string, note string, appeal string, ts timestamp")
    return {r.case_id: r for r in review.apply_case_updates(updates).collect()}


def test_case_state_machine(spark):
    got = _fold(
        spark,
        [
            (1, 1, None, "ann", None, None, None, None),
            (1, 2, "resolved", None, "confirmed", "seen", None, None),
            (1, 3, None, None, None, None, "please", None),
            (1, 4, "overturned", None, None, None, None, None),
            (2, 1, "overturned", "bob", "confirmed", None, None, None),
            (3, 1, None, None, None, None, "early", None),
            (4, 1, None, None, "false_positive", "no change of status", None, None),
            (5, 1, "in_review", "", None, None, None, None),
        ],
    )
    assert (got[1].status, got[1].assigned_to, got[1].resolution, got[1].note, got[1].refused) == ("overturned", "ann", "confirmed", "Appeal reason: please", 0)
    assert (got[2].status, got[2].assigned_to, got[2].resolution, got[2].refused) == ("open", None, None, 1)
    assert (got[3].status, got[3].note) == ("open", None)
    assert (got[4].status, got[4].resolution, got[4].note) == ("open", "false_positive", "no change of status")
    assert got[5].status == "in_review"


def test_assignments(spark):
    rows = [(1, "assign", "a", 1), (2, "assign", "b", 1), (3, "unassign", "a", 1), (4, "assign", "a", 2), (5, "resolve", None, 2), (6, "assign", "b", 2), (7, "unassign", "c", 9)]
    got = review.assignments(spark.createDataFrame(rows, "seq int, kind string, moderator string, case_id int"))
    assert {tuple(r) for r in got.collect()} == {("b", 1), ("b", 2)}


def test_recorded_actions_wait(spark):
    df = spark.createDataFrame([(True, "x"), (False, None)], "is_permanent boolean, approved_by string")
    assert [(r.requires_human, r.approved_by) for r in review.record(df).collect()] == [(True, None), (False, None)]


def test_least_loaded_ties_by_order(spark):
    people = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "moderator string, ord int")
    load = spark.createDataFrame([("a", 10), ("b", 3)], "assigned_to string, load long")
    assert review.least_loaded(people, load).head().moderator == "c"


def test_page_is_capped(spark):
    cases = spark.range(300).selectExpr("id as case_id", "'open' as status", "1 as priority", "timestamp '2024-01-01' as created_at")
    page = review.list_cases(cases, limit=1000).collect()
    assert len(page) == review.PAGE_LIMIT and {r.total for r in page} == {300}
