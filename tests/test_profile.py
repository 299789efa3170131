"""Profile replay and scores, against a sequential replay written from their description."""

from __future__ import annotations

import random
import uuid
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from studyloom.config import DEFAULT
from studyloom.operators import profile as P

BASE = datetime(2026, 4, 29, 12)
SUBS = "delivery_id long, job_id string, submission_id string, task_id string, task_number int, task_text string, is_correct boolean, student_answer string, correct_answer string, diagnostic_tags array<string>, submitted_at timestamp_ntz, seq string"


def subs(spark, rows):
    """rows: (user, offset, correct, tags[, task_number, text])"""
    data = []
    for i, (user, offset, ok, tags, *rest) in enumerate(rows):
        number, text = rest or (10, "Задача про насос")
        data.append((i, f"job-{user}", str(uuid.UUID(int=i + 1)), f"task-{offset}", number, text, ok, None if ok else "1", "2", tags, BASE + timedelta(seconds=offset), "clash"))
    jobs = spark.createDataFrame([(f"job-{u}", u) for u in {r[0] for r in rows}] + [("job-none", None)], "job_id string, user_id string")
    return spark.createDataFrame(data, SUBS), jobs


def log(spark, rows):
    return P.attempt_log(*subs(spark, rows))


def test_no_history(spark):
    df, jobs = spark.createDataFrame([], SUBS), spark.createDataFrame([], "job_id string, user_id string")
    assert P.attempt_log(df, jobs).collect() == []
    assert P.attempt_errors(P.attempt_log(df, jobs)).collect() == []


def test_one_right_answer(spark):
    a = log(spark, [("u", 0, True, [])])
    assert [(r.seq, r.subtype) for r in a.collect()] == [(1, "joint_work")]
    assert P.attempt_errors(a).collect() == []


def test_an_event_for_each_tag_and_one_without_any(spark):
    a = log(spark, [("u", 0, False, ["x", "y"]), ("u", 5, False, [])])
    assert [(r.seq, r.tag, r.weight) for r in P.attempt_errors(a).orderBy("seq", "place").collect()] == [(1, "x", 1.0), (1, "y", 1.0), (2, "unknown", 1.0)]


def test_order_is_by_time(spark):
    a = log(spark, [("u", 20, False, ["x"]), ("u", 10, False, ["x"]), ("u", 0, False, ["x"])])
    assert [r.task_id for r in a.orderBy("seq").collect()] == ["task-0", "task-10", "task-20"]


@pytest.mark.parametrize(("text", "number", "subtype"), [("sin x = 1/2", 13, "simplest_trig"), ("взять кредит", 16, "annuity_credit"), ("погода", 16, "other")])
def test_subtype_by_number(spark, text, number, subtype):
    assert log(spark, [("u", 0, True, [], number, text)]).first().subtype == subtype


def test_persistence_against_a_replay(spark):
    rng = random.Random(2)
    rows = [(rng.choice("uv"), i, rng.random() < 0.2, rng.choices(["a", "b", "c", "unknown"], [5, 2, 1, 1], k=rng.randrange(3))) for i in range(400)]
    got = {(r.student_id, r.seq, r.place): (r.tag, r.weight) for r in P.attempt_errors(log(spark, rows)).collect()}
    want, events, seq = {}, defaultdict(list), defaultdict(int)
    for user, _, ok, tags in rows:
        seq[user] += 1
        if ok:
            continue
        for place, tag in enumerate(tags or ["unknown"]):
            again = tag != "unknown" and events[user][-12:].count(tag) >= 3
            want[user, seq[user], place] = (tag, 1.5 if again else 1.0)
            events[user].append(tag)
    assert got == want
    assert any(w == 1.5 for _, w in got.values())


def test_decay_counts_the_newest_errors_only(spark):
    rng = random.Random(4)
    events = [("s", f"t{rng.randrange(4)}", 1 + i // 2, i, rng.choice([None, 0.5, 2.0])) for i in range(50)]
    df = spark.createDataFrame(events, "student_id string, tag string, attempt_seq int, rec_id long, weight double")
    for c in ("task_id", "subtype", "student_answer", "correct_answer", "task_text", "problem_katex", "solution"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    errors = P.error_log(df.withColumn("task_number", F.lit(10)))
    from dataclasses import replace

    got = {r.tag: r.score for r in P.decayed_scores(errors, replace(DEFAULT, event_limit=10)).collect()}
    want = defaultdict(float)
    for _, tag, seq, _, w in events[-10:]:
        want[tag] += (1.0 if w is None else w) * (1 + 25 - seq) ** -0.5
    assert got == pytest.approx(dict(want))
    top = P.top_errors(P.decayed_scores(errors), 2).orderBy("place").collect()
    assert [r.place for r in top] == [1, 2] and top[0].score >= top[1].score


def test_detail_and_mastery(spark):
    counts = spark.createDataFrame([("a", "x", 10, 8), ("b", "x", 10, 5), ("c", "x", 10, 1), ("d", "x", 0, 0)], "student_id string, subtype string, attempts int, wrong int")
    assert {r.student_id: r.detail for r in P.accuracy_level(counts).collect()} == {"a": "подробный", "b": "средний", "c": "краткий", "d": "подробный"}
    assert {r.student_id: round(r.mastery, 6) for r in P.mastery(counts).collect()} == {"a": 0.2, "b": 0.5, "c": 0.9, "d": 0.0}


def test_recent_wrong_takes_each_task_once(spark):
    rows = [("s", 1, 1, "A", "t1", None), ("s", 2, 2, "B", "t2", "k"), ("s", 3, 3, "A", "t3", None), ("s", 4, 4, None, "t4", None), ("s", 5, 5, None, "t5", None)]
    df = spark.createDataFrame(rows, "student_id string, seq long, rec_id long, task_id string, task_text string, problem_katex string")
    for c in ("subtype", "tag", "solution", "student_answer", "correct_answer"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    df = df.withColumn("task_number", F.lit(10))
    assert [(r.task_id, r.task_text) for r in P.recent_wrong(df).orderBy("place").collect()] == [("", ""), ("A", ""), ("B", "k")]
    assert [r.task_text for r in P.recent_wrong_context(df, 3).orderBy("place").collect()] == ["t5", "t4", "t3"]
