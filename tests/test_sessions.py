"""Sessions by gaps, against a plain loop."""

from __future__ import annotations

import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa

from studyloom.functions.keys import iso_micros
from studyloom.operators.sessions import GAP_US, _scan, learner_moments, sessionize


def plain(moments, gap):
    by = defaultdict(list)
    for u, t in moments:
        if u is not None and t is not None:
            by[u].append(t)
    out = []
    for u, times in by.items():
        times.sort()
        start = last = times[0]
        n = 0
        for t in times:
            if t - last > gap:
                out.append((u, start, last, last - start, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((u, start, last, last - start, n))
    return sorted(out)


def test_against_a_loop_with_one_frequent_user(spark):
    rng = random.Random(3)
    moments = [("hot" if rng.random() < 0.5 else f"u{rng.randrange(20)}", rng.randrange(0, 4000)) for _ in range(3000)] + [(None, 5), ("hot", None)]
    df = spark.createDataFrame(moments, "user_id string, at_us long").repartition(7)
    assert sorted(map(tuple, sessionize(df, 10).collect())) == plain(moments, 10)


def test_the_gap_itself_still_joins(spark):
    df = spark.createDataFrame([("a", 0), ("a", GAP_US), ("a", 2 * GAP_US + 1)], "user_id string, at_us long")
    assert sorted(map(tuple, sessionize(df).collect())) == [("a", 0, GAP_US, GAP_US, 2), ("a", 2 * GAP_US + 1, 2 * GAP_US + 1, 0, 1)]


def test_empty(spark):
    assert sessionize(spark.createDataFrame([], "user_id string, at_us long")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 60)), max_size=40), st.integers(1, 5))
def test_scan_is_the_same_for_all_batch_sizes(moments, size):
    moments.sort()
    batches = [pa.RecordBatch.from_pydict({"u": pa.array([m[0] for m in moments[i : i + size]], pa.string()), "t": pa.array([m[1] for m in moments[i : i + size]], pa.int64())}) for i in range(0, len(moments), size)]
    got = [tuple(r.values())[:4] for b in _scan(5)(iter(batches)) for r in b.to_pylist()]
    assert sorted(got) == sorted((u, s, e, n) for u, s, e, _, n in plain(moments, 5))


def test_times_as_they_are_written(spark):
    cases = {
        "2026-03-01T00:00:01+00:00": 1, "2026-03-01 00:00:01.500000+00:00": 1.5, "2026-03-01T03:00:01+03:00": 1, "2026-02-28T21:30:01-02:30": 1, "2026-03-01T00:00:01Z": 1, "2026-03-01T00:00:01": 1,
        " 2026-03-01T00:00:01Z ": 1, "2026-03-01T03:00:01+0300": 1, "2026-03-01T03:00:01+03": 1, "n/a": None, "": None, None: None, "2026-03-01": None, "0000-00-00T00:00:00": None, "12:30": None, "2026-13-01T00:00:00Z": None,
    }
    base = 1772323200
    got = {r.s: r.t for r in spark.createDataFrame([(k,) for k in cases], "s string").select("s", iso_micros("s").alias("t")).collect()}
    assert got == {k: None if v is None else int((base + v) * 1e6) for k, v in cases.items()}


def test_moments_of_messages_and_events(spark):
    from datetime import datetime
    import uuid

    a = str(uuid.UUID(int=5))
    subs = spark.createDataFrame(
        [(1, "j1", a, datetime(2026, 3, 1, 0, 0, 9)), (2, "j2", a.upper(), datetime(2026, 3, 1, 0, 0, 3)), (3, "j1", None, datetime(2026, 3, 1, 0, 0, 4)), (4, "j9", None, datetime(2026, 3, 1)), (5, "j1", None, None)],
        "delivery_id long, job_id string, submission_id string, submitted_at timestamp_ntz",
    )
    jobs = spark.createDataFrame([("j1", "u"), ("j1", "u"), ("j3", None)], "job_id string, user_id string")
    events = spark.createDataFrame([("u", "2026-03-01T00:00:01Z"), ("u", "bad"), (None, "2026-03-01T00:00:01Z")], "student_id string, ts string")
    got = sorted((r.user_id, r.at_us // 10**6 - 1772323200) for r in learner_moments(subs, jobs, events).where("user_id is not null and at_us is not null").collect())
    assert got == [("u", 1), ("u", 3), ("u", 4)]
