"""Bit-sliced features, against plain sums."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from studyloom.operators.entity_features import carry_add, feature_rows, learner_features, pack, slices_of, unpack, values_of

BLOCK = 4096
pairs = st.dictionaries(st.integers(0, BLOCK - 1), st.integers(0, 2**40), max_size=30)


def sliced(d):
    return slices_of(np.array(sorted(d), np.int64), np.array([d[k] for k in sorted(d)], np.int64))


@settings(max_examples=80, deadline=None)
@given(pairs, pairs)
def test_carry_addition_adds_all_entities_at_once(a, b):
    x, y = sliced(a), sliced(b)
    carry_add(x, y)
    want = np.zeros(BLOCK, np.int64)
    for d in (a, b):
        for k, v in d.items():
            want[k] += v
    assert (values_of(x, BLOCK) == want).all()
    assert unpack(pack(x)) == x


def test_full_blocks_are_stored_as_bitmaps():
    x = slices_of(np.arange(BLOCK), np.full(BLOCK, 5))
    assert (values_of(unpack(pack(x)), BLOCK) == 5).all()
    assert sum(len(data) for _, data in pack(x)) <= 3 * BLOCK // 8
    assert sum(len(data) for _, data in pack(slices_of(np.array([7, BLOCK - 1]), np.array([1, 1])))) == 8


def test_against_plain_sums(spark):
    rng = random.Random(1)
    events = []
    for _ in range(4000):
        entity = "hot" if rng.random() < 0.4 else rng.choice([None, *(f"e{i}" for i in range(300))])
        kinds = rng.choice([None, [], ["a"], ["a", "b"], ["b", None], ["c", "c"], [f"k{rng.randrange(40)}"]])
        events.append((entity, kinds, rng.choice([None, 1.0, 0.25, -2.5, 1.725, float("nan"), float("inf")]), rng.choice([None, rng.randrange(-5, 10**15)])))
    want: dict = defaultdict(dict)
    for entity, kinds, weight, at in events:
        want[entity]
        for kind in dict.fromkeys(k for k in kinds or [] if k is not None):
            n, t, w = want[entity].get(kind, (0, None, 0.0))
            usable = weight if weight is not None and abs(weight) < 1e12 else 0.0
            want[entity][kind] = (n + 1, at if t is None or at is not None and at > t else t, w + usable)
    df = spark.createDataFrame(events, "entity string, kinds array<string>, weight double, at_us long").repartition(5)
    got = {}
    for r in feature_rows(df, chunk=100, flush=50).collect():
        assert r.entity not in got
        got[r.entity] = {k: (r.counts[k], r.latest_us[k], round(r.totals[k], 6)) for k in r.counts}
    assert got == {e: {k: (n, t, round(w, 6)) for k, (n, t, w) in v.items()} for e, v in want.items()}


def test_many_entities_span_blocks(spark):
    df = spark.range(20_000).selectExpr("concat('e', id) entity", "array('k') kinds", "1.5D weight", "id at_us").repartition(3)
    out = feature_rows(df)
    assert out.count() == 20_000
    assert out.selectExpr("sum(counts['k'])", "sum(totals['k'])", "max(latest_us['k'])").first()[:] == (20_000, 30_000.0, 19_999)


def test_totals_past_the_range_of_a_long_are_kept(spark):
    df = spark.range(200).selectExpr("'e' entity", "array('k') kinds", "4e12D + id weight", "id at_us").repartition(3)
    for chunk, flush in ((10**6, 10**6), (20, 5)):
        assert feature_rows(df, chunk, flush).first().totals["k"] == 200 * 4e12 + 199 * 100


def test_empty_and_spellings(spark):
    schema = "student_id string, tag string, subtype string, weight double, ts string, entity string, kinds int"
    assert learner_features(spark.createDataFrame([], schema)).collect() == []
    rows = [("s", "A-b", "x", 1.0, "2026-03-01T00:00:00Z", "clash", 1), ("s", " a_B", None, None, "bad", "clash", 1), ("t", None, None, 1.0, None, None, None)]
    got = {r.student_id: r for r in learner_features(spark.createDataFrame(rows, schema)).collect()}
    assert got["s"].counts == {"tag:a_b": 2, "subtype:x": 1} and got["s"].totals["tag:a_b"] == 1.0
    assert got["t"].counts == {}
