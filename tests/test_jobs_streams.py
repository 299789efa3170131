"""Queues, stores, messages and streams."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryException

from studyloom.functions import events as M
from studyloom.operators import jobs as J
from studyloom.streaming import submissions as S

BASE = datetime(2026, 4, 29, 12)
GOOD = {"event_id": "e", "event_type": "submission.created", "schema_version": "1.0", "occurred_at": "2026-04-29T12:00:00Z", "submission": {"submission_id": "00000000-0000-0000-0000-00000000000a", "user_id": "u", "task_id": "t", "task_number": 10, "task_text": "x", "is_correct": False, "student_answer": None, "correct_answer": "2"}}


def change(**new):
    sub = GOOD["submission"] | {k: v for k, v in new.items() if v is not ...}
    return json.dumps(GOOD | {"submission": {k: v for k, v in sub.items() if new.get(k) is not ...}})


def drop(field):
    return json.dumps(GOOD | {"submission": {k: v for k, v in GOOD["submission"].items() if k != field}})


@pytest.mark.parametrize(
    ("raw", "defect"),
    [("{broken", "bad_json"), (json.dumps(GOOD | {"event_type": "x"}), "other_type"), (json.dumps({"event_type": "submission.created"}), "no_submission"), (drop("user_id"), "missing_fields"), (drop("task_text"), "missing_fields"), (change(task_number=7), "unsupported_task"), *((change(task_number=n), None) for n in (6, 10, 12, 13, 16)), ("", "bad_json"), (None, "bad_json")],
)
def test_messages_that_count(spark, raw, defect):
    got = spark.createDataFrame([(raw,)], "value string").select(M.event_defect(F.col("value")).alias("d")).first().d
    assert got == defect


def jobs(spark, rows):
    return spark.createDataFrame(rows, "job_id string, status string, created_at timestamp_ntz, n int")


def test_insertion_is_idempotent(spark):
    there = jobs(spark, [("a", "done", BASE, 1)])
    new = jobs(spark, [("a", "queued", BASE, 5), ("b", "queued", BASE, 3), ("b", "queued", BASE, 2), (None, "queued", BASE, 2)])
    assert [(r.job_id, r.n) for r in J.insert_new(there, new).collect()] == [("b", 2)]
    assert J.insert_new(there.unionByName(J.insert_new(there, new)), new).collect() == []


def test_oldest_waiting_and_newest(spark):
    df = jobs(spark, [(c, "queued" if i % 2 else "done", BASE + timedelta(seconds=i), i) for i, c in enumerate("abcd")])
    assert [r.job_id for r in J.next_waiting(df, "queued").collect()] == ["b"]
    assert [r.job_id for r in J.latest(df, 2).collect()] == ["d", "c"]
    changed = J.update_where(df, F.col("status") == "done", status=F.lit("posted"))
    assert sorted(r.status for r in changed.collect()) == ["posted", "posted", "queued", "queued"]


def test_statistics(spark):
    rows = [("a", "pending", BASE, None), ("b", "done", BASE, BASE + timedelta(seconds=10)), ("c", "done", BASE, BASE + timedelta(seconds=20)), ("d", "odd", BASE, None)]
    df = spark.createDataFrame(rows, "job_id string, status string, created_at timestamp_ntz, ended_at timestamp_ntz")
    now = F.lit(BASE + timedelta(seconds=100)).cast("timestamp_ntz")
    one = J.queue_statistics(df, now, ("pending", "done", "failed"), "done", "pending", "created_at", "ended_at", "created_at").first()
    assert (one.n_pending, one.n_done, one.n_failed, one.n_total) == (1, 2, 0, 3)
    assert (one.avg_ms, one.p50_ms, one.p95_ms, one.n_samples) == (15000.0, 10000.0, 20000.0, 2)
    assert one.longest_wait_s == 100.0 and one.throughput == 0
    none = J.queue_statistics(df.where("false"), now, ("pending", "done"), "done", "pending", "created_at", "ended_at", "created_at").first()
    assert none.avg_ms is None and none.p50_ms is None and none.longest_wait_s is None


def test_percentile_ranks_round_to_even(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0, 3.0, 4.0],), ([],)], "v array<double>")
    assert [r[0] for r in df.select(J.nearest_rank(F.col("v"), 0.5)).collect()] == [1.0, 3.0, None]


def test_a_store_keeps_places_and_the_newest(spark):
    from dataclasses import replace

    from studyloom.config import DEFAULT

    rows = [("a", 1, "x"), ("b", 2, "x"), ("c", 3, "x"), ("a", 4, "again"), ("d", 5, "x"), (None, 6, "x"), ("", 7, "x")]
    df = spark.createDataFrame(rows, "id string, at int, v string").withColumn("seen", F.col("at"))
    got = J.newest_kept(df, "id", "at", "seen", replace(DEFAULT, store_limit=3)).orderBy("place").collect()
    assert [r.id for r in got] == ["d", "c", "b"]
    got = J.newest_kept(df, "id", "at", "seen").orderBy("place").collect()
    assert [(r.id, r.v) for r in got] == [("d", "x"), ("c", "x"), ("b", "x"), ("a", "again")]


def test_outcomes(spark):
    df = spark.createDataFrame([(200,), (404,), (408,), (429,), (503,), (None,)], "s int")
    assert [r[0] for r in df.select(J.delivery_outcome(F.col("s"))).collect()] == ["delivered", "permanent", "transient", "transient", "transient", "transient"]


def folder(tmp_path, batches):
    for i, lines in enumerate(batches):
        (tmp_path / f"{i}.txt").write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(tmp_path)


def test_transient_failure_brings_the_batch_again(spark, tmp_path):
    source, dead, mark = folder(tmp_path / "in" if (tmp_path / "in").mkdir() is None else tmp_path, [[change(), "{broken", change(is_correct=True)]]), str(tmp_path / "dead"), str(tmp_path / "mark")
    outcome = ["transient"]
    seen = []

    def diagnose(df):
        return df.withColumn("tag", F.lit("x"))

    def deliver(df):
        seen.append(df.count())
        return df.withColumn("outcome", F.lit(outcome[0]))

    def start():
        batch = S.diagnosing_batch(diagnose, deliver, dead)
        return spark.readStream.text(source).writeStream.foreachBatch(batch).option("checkpointLocation", mark).trigger(availableNow=True).start()

    with pytest.raises(StreamingQueryException):
        start().awaitTermination()
    outcome[0] = "delivered"
    start().awaitTermination()
    assert seen == [1, 1]
    start().awaitTermination()
    assert seen == [1, 1]
    assert {r.reason for r in spark.read.parquet(dead).collect()} == {"bad_json"}


def test_permanent_failures_are_set_aside(spark, tmp_path):
    (tmp_path / "in").mkdir()
    source, dead = folder(tmp_path / "in", [[change()]]), str(tmp_path / "dead")
    batch = S.diagnosing_batch(lambda df: df, lambda df: df.withColumn("outcome", F.lit("permanent")), dead)
    spark.readStream.text(source).writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "m")).trigger(availableNow=True).start().awaitTermination()
    assert [r.reason for r in spark.read.parquet(dead).collect()] == ["permanent"]


def test_stream_keeps_one_of_each(spark, tmp_path):
    (tmp_path / "in").mkdir()
    a, b = "00000000-0000-0000-0000-00000000000a", "00000000-0000-0000-0000-00000000000b"
    source = folder(tmp_path / "in", [[change(), change(submission_id=a.upper())], [change(submission_id="{%s}" % a), change(submission_id=b)]])
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(source)
    out = str(tmp_path / "out")
    S.once_each(M.valid_submissions(stream)).select("submission_id").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "m")).trigger(availableNow=True).start().awaitTermination()
    assert len({r.submission_id.strip("{}").lower() for r in spark.read.parquet(out).collect()}) == spark.read.parquet(out).count() == 2


def test_states_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    changes = [("a", "created", "", 1), ("a", "tags", "x", 2), ("b", "tags", "y", 3), ("c", "created", "", 4), ("a", "created", "", 5), ("d", "created", "", 6), ("d", "tags", "z", 7), ("", "created", "", 8), (None, "created", "", 9)]
    df = spark.createDataFrame(changes, "submission_id string, kind string, tags string, at_us long")
    path = str(tmp_path / "in")
    df.where("at_us <= 4 or at_us is null").coalesce(1).write.parquet(path)
    df.where("at_us > 4").coalesce(1).write.mode("append").parquet(path)
    batches = []
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    S.status_store(stream).writeStream.outputMode("update").foreachBatch(lambda b, n: batches.append([tuple(r) for r in b.collect()])).option("checkpointLocation", str(tmp_path / "m")).trigger(availableNow=True).start().awaitTermination()
    last = {}
    for batch in batches:
        last |= {r[0]: r for r in batch}
    assert sorted(last.values()) == sorted(map(tuple, S.status_table(df).collect()))
    assert last["a"][1:3] == ("pending", "") and last["d"][1:3] == ("done", "z") and "b" not in last


def test_states_are_checked_and_jobs_end_in_them(spark):
    now = F.lit("2026-04-01").cast("timestamp")
    jobs = spark.createDataFrame([("a", "running", 0, None, "old"), ("b", "queued", 0, None, None), ("c", "failed", 2, "X", "old"), ("d", "failed", 2, "X", "old")], "job_id string, status string, retry_count int, error_code string, error_message string").withColumns({c: F.lit(None).cast("timestamp") for c in ("completed_at", "updated_at", "posted_at")})
    done = {r.job_id: r for r in J.finished(jobs, F.lit(True), now).collect()}
    assert [done[k].status for k in "abcd"] == ["done", "queued", "failed", "failed"]
    lost = {r.job_id: r for r in J.failed(jobs, F.col("job_id") == "b", F.lit("E"), F.lit("why"), now).collect()}
    assert (lost["b"].status, lost["b"].error_code, lost["b"].error_message, lost["a"].status) == ("failed", "E", "why", "running")
    again = {r.job_id: (r.retry_count, r.error_message) for r in J.retried(jobs, F.col("status") == "failed", F.when(F.col("job_id") == "c", F.lit("n" * 600)), now).collect()}
    assert again["c"] == (3, "n" * 500) and again["d"] == (3, "old") and again["a"] == (0, "old")
    assert jobs.select(J.checked_state(F.col("status"))).count() == 4
    with pytest.raises(Exception, match="no state of a job"):
        jobs.select(J.checked_state(F.concat("status", F.lit("?")))).collect()


def states_of(spark, tmp_path, parts):
    """What a stream of files gives, state by state, and how many rows its store holds in the end."""
    shape = "submission_id string, kind string, tags string, at_us long"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = []
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = S.status_store(stream).writeStream.outputMode("update").foreachBatch(lambda b, n: out.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "m")).trigger(availableNow=True).start()
    query.awaitTermination()
    return out, query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_states_are_kept_by_blocks(spark, tmp_path, monkeypatch):
    """A call of Python for each id made the store end by time over large tables."""
    monkeypatch.setattr(S, "BLOCKS", 8, raising=False)
    first = [(f"s{i}", "created", "", 2 * i) for i in range(3000)] + [("s0", "tags", None, 1), ("s1", "tags", "b", 9), ("s1", "tags", "a", 9), ("s2", "created", "", None)]
    second = [(f"s{i}", "tags", f"t{i}", 9000 + i) for i in range(0, 4000, 3)]
    out, rows = states_of(spark, tmp_path, [first, second])
    want = S.status_table(spark.createDataFrame(first + second, "submission_id string, kind string, tags string, at_us long"))
    assert sorted({r[0]: r for r in out}.values(), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert rows == 8


@pytest.mark.parametrize("blocks", [1, 64])
def test_states_are_forgotten(spark, tmp_path, monkeypatch, blocks):
    monkeypatch.setattr(S, "BLOCKS", blocks, raising=False)
    day = 24 * 3600 * 1_000_000
    parts = [[("a", "created", "", day), ("b", "created", "", day)], [("b", "tags", "x", 5 * day)], [("c", "created", "", 10 * day)], [("a", "tags", "y", 10 * day), ("b", "tags", "z", 10 * day)], [("d", "created", "", 40 * day)]]
    out, rows = states_of(spark, tmp_path, parts)
    want = [("a", "pending", "", day, None, 1), ("b", "pending", "", day, None, 1), ("b", "done", "x", day, 5 * day, 2), ("b", "done", "z", day, 10 * day, 3), ("c", "pending", "", 10 * day, None, 1), ("d", "pending", "", 40 * day, None, 1)]
    assert sorted(out, key=lambda r: (r[0], r[5])) == want
    assert rows == 1
