"""Streams of submissions: diagnosis, delivery, status and throughput.

Delivery is at least once: a batch whose delivery fails for a while raises, so the checkpoint stays
and the same batch comes again; what can't be delivered at all, or can't be read, goes to a dead
letter table and isn't tried again. Receivers drop repeats by the submission's id.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from studyloom.functions.events import event_defect, valid_submissions
from studyloom.functions.keys import iso_micros, uuid_key

Deliver = Callable[[DataFrame], DataFrame]


class TransientFailure(RuntimeError):
    """Some results couldn't be delivered for now; the batch has to come again."""


def wrong_answers(messages: DataFrame, value: str = "value") -> DataFrame:
    """Submissions of a message stream that need a diagnosis: readable, supported and wrong."""
    return valid_submissions(messages, value).where(~F.col("is_correct"))


def diagnosing_batch(diagnose: Callable[[DataFrame], DataFrame], deliver: Deliver, dead_letters: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: diagnose, deliver, set aside what failed for good, raise for what failed for now.

    ``deliver`` returns its input with ``outcome``: ``delivered``, ``permanent`` or ``transient``.
    """

    def run(batch: DataFrame, number: int) -> None:
        raw = F.col("value").cast("string")
        batch = batch.persist()
        try:
            unread = batch.select(raw.alias("message"), event_defect(raw).alias("reason")).where("reason is not null")
            unread.withColumn("batch", F.lit(number)).write.mode("append").parquet(dead_letters)
            done = deliver(diagnose(wrong_answers(batch))).persist()
            failed = done.where("outcome = 'permanent'").select(F.to_json(F.struct(*[c for c in done.columns if c != "outcome"])).alias("message"), F.lit("permanent").alias("reason"))
            failed.withColumn("batch", F.lit(number)).write.mode("append").parquet(dead_letters)
            again = done.where("outcome = 'transient'").count()
            done.unpersist()
            if again:
                raise TransientFailure(f"{again} results of batch {number} have to be sent again")
        finally:
            batch.unpersist()

    return run


def dated(submissions: DataFrame) -> DataFrame:
    """With ``at``, the event time: ``submitted_at``, else ``occurred_at``."""
    micros = F.coalesce(iso_micros("submitted_at"), iso_micros("occurred_at"))
    return submissions.withColumn("at", F.timestamp_micros(micros))


def once_each(submissions: DataFrame, delay: str = "1 day") -> DataFrame:
    """One row of each submission id (in any notation) within the watermark's delay; rows without a valid id are all kept."""
    key = F.coalesce(uuid_key("submission_id"), F.unhex(F.sha2(F.to_json(F.struct("*")), 256)))
    return dated(submissions).withColumn("key_", key).withWatermark("at", delay).dropDuplicatesWithinWatermark(["key_"]).drop("key_")


def throughput(submissions: DataFrame, width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """``start, task_number, n`` of event-time windows; later rows than the delay don't count."""
    windows = dated(submissions).withWatermark("at", delay).groupBy(F.window("at", width), "task_number").agg(F.count("*").alias("n"))
    return windows.select(F.col("window.start").alias("start"), "task_number", "n")


#: How long the state of a submission is kept after its last change, and how much later a block without changes is cleared of it, in milliseconds.
KEEP_MS, SWEEP_MS = 7 * 24 * 3600 * 1000, 3600 * 1000
#: Blocks of ids that have their states in common; a checkpoint goes on with as many as it began with.
BLOCKS = 4096
_STATUS = "submission_id string, status string, tags string, created_us long, diagnosed_us long, n_updates int"
_NO_TIME = -(1 << 63)


def _in_order(change: tuple) -> tuple:
    at, kind, tags, _ = change
    return at, kind or "", tags is not None, tags or ""


def _status(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """States of a block of ids. Pending until tags come; a second creation starts it again, tags for an unknown id change nothing."""
    now = state.getCurrentWatermarkMs()
    # id: status, tags, created, diagnosed, number of updates, when it is forgotten
    known = {k: v for k, v in json.loads(state.get[0]).items() if v[5] >= now} if state.exists else {}
    changes = [c for b in batches for c in zip(b.at_us.tolist(), b.kind.tolist(), b.tags.tolist(), b.submission_id.tolist())]
    changed = {}
    for at, kind, tags, name in sorted(changes, key=_in_order):
        when = None if at == _NO_TIME else at
        old = known.get(name)
        if kind == "created":
            new = ["pending", "", when, None]
        elif old is not None:
            new = ["done", tags, old[2], when]
        else:
            continue
        n, until = (old[4], old[5]) if old else (0, now + 1)
        known[name] = changed[name] = [*new, n + 1, max(until, now + 1, at // 1000 + KEEP_MS)]
    if known:
        state.update((json.dumps(known),))
        state.setTimeoutTimestamp(max(min(v[5] for v in known.values()) + SWEEP_MS, now + 1))
    elif state.exists:
        state.remove()
    if changed:
        status, tags, created, diagnosed, n, _ = zip(*changed.values())
        yield pd.DataFrame({"submission_id": pd.Series(list(changed), dtype=object), "status": pd.Series(status, dtype=object), "tags": pd.Series(tags, dtype=object), "created_us": pd.Series(created, dtype="Int64"), "diagnosed_us": pd.Series(diagnosed, dtype="Int64"), "n_updates": n})


def status_store(changes: DataFrame, delay: str = "1 day") -> DataFrame:
    """The state of each submission after each batch of ``changes(submission_id, kind, tags, at_us)``; ``kind`` is ``created`` or ``tags``.

    A batch's changes of one id are applied in order of their time. States are kept by blocks of ids (:data:`BLOCKS`), as a call
    of Python for each id takes milliseconds. A state without changes for :data:`KEEP_MS` of event time is forgotten, so the
    store stays as large as the submissions of that time.
    """
    # A watermark begins at 1970 and takes what is not after it for late, a null never.
    at = F.when(F.col("at_us") > 0, F.timestamp_micros("at_us"))
    named = changes.where("submission_id is not null and submission_id <> ''").withColumn("at", at).withWatermark("at", delay)
    block = F.pmod(F.xxhash64("submission_id"), F.lit(BLOCKS)).cast("int")
    rows = named.select(block.alias("block"), "submission_id", "kind", "tags", F.coalesce("at_us", F.lit(_NO_TIME)).alias("at_us"), "at")
    return rows.groupBy("block").applyInPandasWithState(_status, _STATUS, "states string", "update", GroupStateTimeout.EventTimeTimeout)


def status_table(changes: DataFrame) -> DataFrame:
    """What :func:`status_store` ends with, for a table of all changes at once."""
    from pyspark.sql import Window

    order = Window.partitionBy("submission_id").orderBy("at_us", "kind")
    known = changes.where("submission_id is not null and submission_id <> ''").withColumn("born", F.max(F.when(F.col("kind") == "created", 1)).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("born = 1")
    last = known.groupBy("submission_id").agg(F.max(F.struct("at_us", "kind", "tags")).alias("x"), F.max(F.when(F.col("kind") == "created", F.col("at_us"))).alias("created_us"), F.count("*").cast("int").alias("n_updates"))
    done = F.col("x.kind") == "tags"
    return last.select("submission_id", F.when(done, "done").otherwise("pending").alias("status"), F.when(done, F.col("x.tags")).otherwise("").alias("tags"), "created_us", F.when(done, F.col("x.at_us")).alias("diagnosed_us"), "n_updates")
