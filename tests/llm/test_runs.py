"""Runs of equal neighbours, against itertools."""

from __future__ import annotations

import random
from itertools import groupby

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from studyloom.llm.runs import _Numbers, _scan, collapse_runs, repeated_errors

SCHEMA = "entity string, value binary, seq long, rec_id long, at_us long, extra string, place long"


def plain(rows, keep):
    usable = sorted((r for r in rows if None not in r[:4]), key=lambda r: (r[0], r[2], r[3]))
    out = []
    for (entity, value), run in groupby(usable, key=lambda r: (r[0], r[1])):
        run = list(run)
        times = [r[4] for r in run if r[4] is not None]
        if len(run) >= keep:
            out.append((entity, value, min(r[3] for r in run), max(r[3] for r in run), max(times) - min(times) if times else None, len(run)))
    return sorted(out, key=str)


def got(df, keep):
    return sorted(((r.entity, bytes(r.value), r.lo_rec_id, r.hi_rec_id, r.duration_us, r.n_events) for r in collapse_runs(df, keep).collect()), key=str)


def test_one_entity_over_many_partitions(spark):
    rng = random.Random(6)
    ids = list(range(3000))
    rng.shuffle(ids)
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), rng.choice([b"x", b"x", b"y", None]), rng.choice([None, *range(200)] if i % 40 == 0 else range(200)), i, rng.choice([None, i]), "clash", 1) for i in ids]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    for keep in (1, 2):
        assert got(df, keep) == plain([r[:5] for r in rows], keep)


def test_one_run_over_all_partitions(spark):
    df = spark.range(500).selectExpr("'e' entity", "cast('v' as binary) value", "id seq", "id rec_id", "id at_us").repartition(5)
    assert got(df, 2) == [("e", b"v", 0, 499, 499, 500)]


def test_equal_values_at_both_edges_of_a_partition(spark):
    rows = [("e", v, i, i, None, "", 0) for i, v in enumerate([b"a", b"b"] * 60)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df, 1) == plain([r[:5] for r in rows], 1) and got(df, 2) == []


def test_empty(spark):
    assert got(spark.createDataFrame([], SCHEMA), 1) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ef"), st.sampled_from([b"x", b"y"])), max_size=30), st.integers(1, 4))
def test_scan_is_the_same_for_all_batch_sizes(pairs, size):
    rows = sorted((e, v, i, i, i) for i, (e, v) in enumerate(pairs))
    rows.sort(key=lambda r: (r[0], r[2]))
    kinds = (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + size]), kinds)], list("abcde")) for i in range(0, len(rows), size)]
    out = [(r["entity"], r["value"], r["lo_rec_id"], r["hi_rec_id"], r["n_events"]) for b in _scan(1)(iter(batches)) for r in b.to_pylist()]
    assert sorted(out) == sorted((e, v, lo, hi, n) for e, v, lo, hi, _, n in plain(rows, 1))


def test_spellings(spark):
    rows = [("s", "Sign-lost", 1, 10, "2026-03-01T00:00:00Z", "A 1"), ("s", " sign_lost ", 1, 11, "bad", "a_1"), ("s", "sign lost", 2, 5, "2026-03-01T00:00:09Z", "A-1"), ("s", None, 2, 6, None, "A-1"), ("s", "sign lost", 3, 7, None, "B")]
    df = spark.createDataFrame(rows, "student_id string, tag string, attempt_seq int, rec_id long, ts string, task_id string")
    assert [(r.lo_rec_id, r.hi_rec_id, r.n_events, r.duration_us) for r in repeated_errors(df).collect()] == [(5, 11, 3, 9_000_000)]


def test_the_difference_of_numbers_separates_runs_of_equal_values():
    entity, value = (pa.array(x).dictionary_encode() for x in (["e"] * 6 + ["f"] * 2, [b"a", b"a", b"b", b"a", b"b", b"a", b"a", b"a"]))
    numbers = _Numbers()
    order, begin, island = numbers.groups(entity, value)
    groups = [sorted(g.tolist()) for g in np.split(order, begin[1:])]
    assert sorted(groups) == [[0, 1], [2], [3], [4], [5], [6, 7]]
    assert {g[0]: int(i) for g, i in zip(groups, island)} == {0: 0, 3: 1, 5: 2, 2: 2, 4: 3, 6: 0}
    # The next batch goes on with the open entity, so its first run has the same key as this batch's last.
    again = numbers.groups(*(pa.array(x).dictionary_encode() for x in (["f", "f"], [b"a", b"c"])))
    assert again[2].tolist() == [0, 3]
