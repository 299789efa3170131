"""One row of each message."""

from __future__ import annotations

import os
import subprocess
import sys
import uuid
from datetime import datetime
from pathlib import Path

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import studyloom
from studyloom.functions.keys import uuid_key
from studyloom.operators.messages import _ROW, MessageStore, merge_runs, message_rows, superseded_deliveries, unique_messages

A, B = uuid.UUID(int=10**30), uuid.UUID(int=7)
SCHEMA = "delivery_id long, submission_id string, submitted_at timestamp_ntz, key string, `row_id` string"


def rows(spark, data):
    return spark.createDataFrame([(i, s, t, "clash", "clash") for i, s, t in data], SCHEMA)


def at(minute):
    return datetime(2026, 3, 1, 12, minute)


def gone(df, store=None):
    return sorted(r.delivery_id for r in superseded_deliveries(df, store).collect())


@pytest.mark.parametrize("text", [str(A), str(A).upper(), "{%s}" % A, "urn:uuid:%s" % A, A.hex, f" \t{A} ", "({%s" % "x", None, "", "null", str(uuid.UUID(int=0)), A.hex[:-1], str(A) + "0"])
def test_notations_of_an_identifier(spark, text):
    got = spark.createDataFrame([(text,)], "s string").select(uuid_key("s")).first()[0]
    plain = (text or "").strip().lower().replace("urn:uuid:", "").strip("{}()").replace("-", "")
    want = bytes.fromhex(plain) if len(plain) == 32 and int(plain, 16) else None
    assert (bytes(got) if got is not None else None) == want


def test_earliest_time_then_smallest_delivery_is_kept(spark):
    df = rows(spark, [(1, str(A), at(5)), (2, A.hex.upper(), at(3)), (3, f"{{{A}}}", at(3)), (4, str(A), None), (5, str(B), None), (6, str(B), None), (7, None, at(1)), (8, "x", at(1)), (9, "x", at(1))])
    assert gone(df) == [1, 3, 4, 6]
    assert sorted(r.delivery_id for r in unique_messages(df).collect()) == [2, 5, 7, 8, 9]
    assert gone(df.repartition(1)) == gone(df.repartition(7)) == [1, 3, 4, 6]


def test_upserting_again_changes_nothing(spark):
    df = rows(spark, [(i, str(uuid.UUID(int=i % 5 + 1)), at(i % 7)) for i in range(60)])
    store = MessageStore(spark, 3)
    lost = {r.row_id for r in store.upsert(message_rows(df)).collect()} | {r.row_id for r in store.compact().collect()}
    once = sorted(map(tuple, store.rows().collect()))
    store.upsert(message_rows(df.where("delivery_id % 2 = 0")))
    store.upsert(message_rows(df))
    again = {r.row_id for r in store.compact().collect()}
    assert sorted(map(tuple, store.rows().collect())) == once
    assert len(once) == 5 and lost == set(range(60)) - {r[2] for r in once} and again <= lost


def test_a_later_job_opens_the_store_by_its_path(spark, tmp_path):
    path = str(tmp_path / "store")
    first = rows(spark, [(i, str(uuid.UUID(int=i + 1)), at(30)) for i in range(40)])
    assert gone(first, MessageStore(spark, 4, path)) == []
    late = [(100 + i, str(uuid.UUID(int=2 * i + 1)), at(10 if i % 2 else 50)) for i in range(30)]
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from studyloom.operators.messages import MessageStore, superseded_deliveries
import datetime
df = spark.createDataFrame({late!r}, "delivery_id long, submission_id string, submitted_at timestamp_ntz")
store = MessageStore(spark, path={path!r})
print("GONE", store.buckets, sorted(r.delivery_id for r in superseded_deliveries(df, store).collect()))
store.vacuum()
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(Path(studyloom.__file__).parent.parent)})
    want = sorted(2 * i if i % 2 else 100 + i for i in range(20))
    assert f"GONE 4 {want}" in out.stdout, out.stderr[-2000:]
    kept = {bytes(r.key): r.row_id for r in MessageStore(spark, path=path).rows().collect()}
    assert len(kept) == 50 and kept[uuid.UUID(int=3).bytes] == 101 and kept[uuid.UUID(int=1).bytes] == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 3)), max_size=14), max_size=4), st.integers(1, 4))
def test_merging_runs_of_any_batches(data, size):
    ids = iter(range(10**6))
    runs = [sorted((bytes([k]), t, next(ids)) for k, t in run) for run in data]
    batches = [iter([pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*run[i : i + size]), _ROW)], schema=_ROW) for i in range(0, len(run), size)]) for run in runs]
    kept, lost = [], []
    for table, gone_ in merge_runs(batches):
        kept += [tuple(r.values()) for r in table.to_pylist()]
        lost += gone_.tolist()
    every = sorted(r for run in runs for r in run)
    want = [r for i, r in enumerate(every) if i == 0 or every[i - 1][0] != r[0]]
    assert kept == want and sorted(lost) == sorted({r[2] for r in every} - {r[2] for r in want})


def test_one_identifier_with_most_rows(spark):
    df = rows(spark, [(i, str(A) if i % 3 else str(uuid.UUID(int=i + 1)), at(i % 50)) for i in range(900)])
    kept = {}
    for i in range(900):
        key = A if i % 3 else uuid.UUID(int=i + 1)
        kept[key] = min(kept.get(key, (99, 10**6)), (i % 50, i))
    assert gone(df) == sorted(set(range(900)) - {i for _, i in kept.values()})


def test_empty_and_all_null(spark):
    assert gone(rows(spark, [])) == []
    assert gone(rows(spark, [(1, None, None), (2, "", None)])) == []


def test_one_run_file_for_each_run_and_bucket(spark):
    store = MessageStore(spark, 4)
    store.upsert(message_rows(rows(spark, [(i, str(uuid.UUID(int=i + 1)), at(1)) for i in range(4000)]).repartition(6)), chunk=100)
    assert sorted(store.files) == [0, 1, 2, 3] and all(len(f) == 3 for f in store.files.values())
    store.compact()
    assert all(len(f) == 1 for f in store.files.values()) and store.rows().count() == 4000
