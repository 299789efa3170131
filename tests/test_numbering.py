"""Row numbers and short windows over groups of any size."""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from studyloom.operators.numbering import number_rows, over_preceding


def test_numbers_run_through_partitions(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(50)]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, t int, i int").repartition(6)
    by = defaultdict(list)
    for g, t, i in rows:
        by[g].append((t is not None, t or 0, i))
    want = {i: n for v in by.values() for n, (_, _, i) in enumerate(sorted(v), 1)}
    assert {r.i: r.seq for r in number_rows(df, "g", ["t", "i"]).collect()} == want


def test_windows_cross_stretches(spark):
    df = spark.range(1, 201).selectExpr("'g' g", "id number", "cast(id % 7 as string) v")
    out = over_preceding(df, "g", "number", 12, lambda w: F.count("*").over(w), "n", stretch=25)
    assert {r.number: r.n for r in out.collect()} == {i: min(12, i - 1) for i in range(1, 201)}
    assert out.count() == 200
