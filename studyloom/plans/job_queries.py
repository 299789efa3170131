"""Queries of queues, stores, messages and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.functions import events as M
from studyloom.functions.keys import uuid_key
from studyloom.operators import jobs as J
from studyloom.plans.data_queries import _KEY
from studyloom.plans.tables import table
from studyloom.staging import new_path
from studyloom.streaming import submissions as S

STATES = J.STATES
#: The moment that ages are taken at.
NOW = "2026-04-01 00:00:00"
_COLUMNS = ("job_id", "user_id", "status", "retry_count", "created_at", "updated_at")


def _jobs(spark, folder):
    return table(spark, folder, "job_requests")


def _now():
    return F.expr(f"TIMESTAMP_NTZ'{NOW}'")


def job_latest_state(spark, folder):
    return J.latest_state(_jobs(spark, folder).select(*_COLUMNS))


def job_lookup(spark, folder):
    """One job by its id: the first of all ids."""
    jobs = _jobs(spark, folder)
    first = jobs.agg(F.min("job_id").alias("wanted"))
    return jobs.join(F.broadcast(first), F.col("job_id") == F.col("wanted"), "left_semi").select(*_COLUMNS)


def job_insert_idempotent(spark, folder):
    """Requests that submissions name, added to those that are there."""
    incoming = table(spark, folder, "submissions").select("job_id", F.lit("queued").alias("status"))
    return J.insert_new(_jobs(spark, folder).select("job_id"), incoming)


def job_claim(spark, folder):
    return J.next_waiting(_jobs(spark, folder), "queued", 5).select("job_id", "created_at")


def job_transitions(spark, folder):
    """What the statements of the queue leave behind: retry what failed, post what is done, and end what runs, by a rule on the retry count."""
    jobs = J.latest_state(_jobs(spark, folder).select(*_COLUMNS, "error_code", "error_message", "posted_at", "completed_at")).withColumn("status", J.checked_state(F.col("status")))
    reason = F.when(F.col("retry_count") % 2 == 0, F.concat(F.lit("next try of "), "job_id"))
    jobs = J.retried(jobs, F.col("status") == "failed", reason, _now())
    jobs = J.posted(jobs, (F.col("status") == "done") & F.col("posted_at").isNull(), _now())
    jobs = J.failed(jobs, (F.col("status") == "running") & (F.col("retry_count") > 0), F.lit("TIMEOUT"), F.lit("no answer in time"), _now())
    jobs = J.finished(jobs, F.col("status") == "running", _now())
    return jobs.select("job_id", "status", "retry_count", "error_code", "error_message", "posted_at", "completed_at", "updated_at")


def latest_jobs(spark, folder):
    return J.latest(_jobs(spark, folder), 50).select("job_id", "status", "created_at")


def job_stats(spark, folder):
    """Statistics of the newest 500 rows."""
    newest = J.latest(_jobs(spark, folder), 500)
    out = J.queue_statistics(newest, _now(), STATES, "done", "queued", "started_at", "completed_at", "created_at")
    return out.select(*(f"n_{s}" for s in STATES), "n_total", *(F.round(c, 3).alias(c) for c in ("avg_ms", "p50_ms", "p95_ms")), F.col("n_samples").cast("long").alias("n_samples"), F.round("longest_wait_s", 3).alias("longest_wait_s"))


def job_payload(spark, folder):
    shape = "callback struct<url:string>, submissions int"
    return _jobs(spark, folder).select("job_id", F.from_json("payload", shape).alias("p")).groupBy(F.col("p.callback.url").alias("url")).agg(F.count("*").alias("n"), F.sum("p.submissions").alias("n_submissions"))


def store_newest(spark, folder):
    """The store of recent submissions: a repeated id keeps its place and shows its last delivery."""
    rows = table(spark, folder, "submissions").select(F.lower(F.hex(uuid_key("submission_id"))).alias("submission_id"), "delivery_id", F.col("delivery_id").alias("last_id"), "task_number", "is_correct")
    return J.newest_kept(rows, "submission_id", "delivery_id", "last_id").select("place", "submission_id", "last_id", "task_number")


def store_stats(spark, folder):
    """Statistics of the store, with the time of receipt as the time of diagnosis."""
    rows = table(spark, folder, "submissions").select(F.lower(F.hex(uuid_key("submission_id"))).alias("submission_id"), "delivery_id", F.col("delivery_id").alias("last_id"), "submitted_at", "received_at", F.when(F.col("is_correct"), "pending").otherwise("done").alias("status"))
    kept = J.newest_kept(rows, "submission_id", "delivery_id", "last_id")
    out = J.queue_statistics(kept, _now(), ("pending", "done", "failed"), "done", "pending", "submitted_at", "received_at", "submitted_at")
    return out.select("n_pending", "n_done", "n_failed", "n_total", *(F.round(c, 3).alias(c) for c in ("avg_ms", "p50_ms", "p95_ms")), F.col("n_samples").cast("long").alias("n_samples"), "throughput", F.round("longest_wait_s", 3).alias("longest_wait_s"))


def offsets_lag(spark, folder):
    """Partitions by batch: the last delivery of each against the last one of a finished job."""
    rows = table(spark, folder, "submissions").select((F.col("batch_id") % 8).alias("partition"), "delivery_id", "is_correct")
    ends = rows.groupBy("partition").agg(F.max("delivery_id").alias("offset"))
    done = rows.where("is_correct and partition <> 3").groupBy("partition").agg(F.max("delivery_id").alias("offset"))
    return J.offsets_lag(ends, done)


def delivery_outcomes(spark, folder):
    """How answers of a receiver are treated, by status and try."""
    tries = table(spark, folder, "submissions").select((200 + F.col("delivery_id") % 400).cast("int").alias("status"), (F.col("batch_id") % 8).cast("int").alias("attempt"))
    return tries.groupBy("status", "attempt").agg(F.count("*").alias("n")).select("status", "attempt", "n", J.retryable(F.col("status")).alias("retryable"), J.delivery_outcome(F.col("status")).alias("outcome"), J.pause_before(F.col("attempt")).alias("pause_s"))


def _messages(spark, folder) -> DataFrame:
    """Submissions as messages, some of them broken."""
    t = table(spark, folder, "submissions")
    users = _jobs(spark, folder).where("user_id is not null").groupBy("job_id").agg(F.min("user_id").alias("user_id"))
    rows = t.join(users, "job_id", "left")
    whole = F.struct("submission_id", F.coalesce("user_id", F.lit("")).alias("user_id"), "task_id", F.when(F.col("delivery_id") % 17 == 0, 7).otherwise(F.col("task_number")).alias("task_number"), "task_text", "is_correct", "student_answer", "correct_answer", F.col("submitted_at").cast("string").alias("submitted_at"))
    cut = F.to_json(F.struct(F.lit(M.EVENT_TYPE).alias("event_type"), F.struct("task_id", "task_number").alias("submission")))
    good = M.event_message(whole, F.concat(F.lit("ev-"), "delivery_id"), F.col("received_at").cast("string"))
    kind = F.col("delivery_id") % 23
    value = F.when(kind == 0, "{broken").when(kind == 1, F.lit('{"event_type": "other"}')).when(kind == 2, F.lit('{"event_type": "submission.created"}')).when(kind == 3, cut).otherwise(good)
    return rows.select("delivery_id", value.alias("value"))


def event_parse(spark, folder):
    out = _messages(spark, folder).select("delivery_id", M.event_defect(F.col("value")).alias("defect"))
    return out


def event_submissions(spark, folder):
    """Messages that need a diagnosis."""
    out = S.wrong_answers(_messages(spark, folder))
    return out.select(F.regexp_extract("event_id", r"(\d+)", 1).cast("long").alias("delivery_id"), "task_number", "user_id")


def _stream(spark, folder) -> DataFrame:
    """The messages as files, read as a stream."""
    path = new_path(spark, "messages-in")
    _messages(spark, folder).select("value").write.text(path)
    return spark.readStream.text(path)


def _ended(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream wrote when all its input was read."""
    spark = stream.sparkSession
    out, mark = new_path(spark, name), new_path(spark, f"{name}-mark")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", mark).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def stream_dedup(spark, folder):
    """One row of each submission id in the stream."""
    once = S.once_each(M.valid_submissions(_stream(spark, folder)), "1 day").where(uuid_key("submission_id").isNotNull())
    return _ended(once.select(F.lower(F.hex(uuid_key("submission_id"))).alias("submission_id")), "once").select("submission_id")


def stream_throughput(spark, folder):
    """Submissions by day of the stream, as far as the watermark has closed them."""
    out = _ended(S.throughput(M.valid_submissions(_stream(spark, folder)), "1 day", "1 day"), "windows")
    return out.select("start", "task_number", "n")


def _changes(spark, folder) -> DataFrame:
    t = table(spark, folder, "submissions").select(F.lower(F.hex(uuid_key("submission_id"))).alias("submission_id"), "delivery_id", "is_correct", F.array_join("diagnostic_tags", ",").alias("tags"))
    born = t.select("submission_id", F.lit("created").alias("kind"), F.lit("").alias("tags"), (F.col("delivery_id") * 2).alias("at_us"))
    done = t.where("not is_correct").select("submission_id", F.lit("tags").alias("kind"), "tags", (F.col("delivery_id") * 2 + 1).alias("at_us"))
    return born.unionByName(done)


def status_table(spark, folder):
    return S.status_table(_changes(spark, folder))


def stream_status(spark, folder):
    """The keyed store of states, kept by a stream; its end equals ``status_table``."""
    path = new_path(spark, "changes")
    changes = _changes(spark, folder)
    changes.write.parquet(path)
    stream = spark.readStream.schema(changes.schema).parquet(path)
    out = _ended(S.status_store(stream), "states", "update")
    last = out.groupBy("submission_id").agg(F.max(F.struct("batch", "status", "tags", "created_us", "diagnosed_us", "n_updates")).alias("x"))
    return last.select("submission_id", "x.status", "x.tags", "x.created_us", "x.diagnosed_us", "x.n_updates")


def stream_diagnosis(spark, folder):
    """The diagnosis loop over the stream, with tags from the texts' keywords in place of a model: what was set aside, by reason."""
    dead, mark = new_path(spark, "dead"), new_path(spark, "dead-mark")

    def diagnose(wrong: DataFrame) -> DataFrame:
        return wrong.withColumn("tag", F.when(F.length("student_answer") > 0, "wrong_answer").otherwise("unknown"))

    def deliver(done: DataFrame) -> DataFrame:
        status = F.when(uuid_key("submission_id").isNull(), 422).otherwise(200)
        return done.withColumn("outcome", J.delivery_outcome(status))

    batch = S.diagnosing_batch(diagnose, deliver, dead)
    query = _stream(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", mark).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(dead).groupBy("reason").agg(F.count("*").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        job_latest_state, job_lookup, job_insert_idempotent, job_claim, job_transitions, latest_jobs, job_stats, job_payload, store_newest, store_stats, offsets_lag, delivery_outcomes,
        event_parse, event_submissions, stream_dedup, stream_throughput, status_table, stream_status, stream_diagnosis,
    )
}

_ROUND = "round(avg({0}), 3) avg_ms, round(list_sort(list({0}) filter ({0} is not null))[round_even((count({0}) - 1) * 0.5, 0)::int + 1], 3) p50_ms, round(list_sort(list({0}) filter ({0} is not null))[round_even((count({0}) - 1) * 0.95, 0)::int + 1], 3) p95_ms, count({0}) n_samples"
_STORE = f"""s as (select *, {_KEY} k from submissions), kept as (select k, min(delivery_id) f, max(delivery_id) l from s where k is not null group by 1 order by f desc limit 500)"""
_DEFECT = "case when delivery_id % 23 = 0 then 'bad_json' when delivery_id % 23 = 1 then 'other_type' when delivery_id % 23 = 2 then 'no_submission' when delivery_id % 23 = 3 or submission_id is null then 'missing_fields' when delivery_id % 17 = 0 then 'unsupported_task' end"
_STATUS_SQL = f"""ch as (select k, delivery_id * 2 at_, 'created' kind, '' tags from (select *, {_KEY} k from submissions) where k is not null
    union all select k, delivery_id * 2 + 1, 'tags', array_to_string(diagnostic_tags, ',') from (select *, {_KEY} k from submissions) where k is not null and not is_correct)"""
_STATUS_ORACLE = f"""with {_STATUS_SQL} select k submission_id, case when arg_max(kind, at_) = 'tags' then 'done' else 'pending' end status, case when arg_max(kind, at_) = 'tags' then arg_max(tags, at_) else '' end tags,
  max(at_) filter (kind = 'created') created_us, case when arg_max(kind, at_) = 'tags' then max(at_) end diagnosed_us, count(*)::int n_updates from ch group by 1"""

ORACLES: dict[str, str] = {
    "job_latest_state": f"select {', '.join(_COLUMNS)} from job_requests qualify row_number() over (partition by job_id order by updated_at desc, user_id desc nulls last, status desc, retry_count desc, created_at desc) = 1",
    "job_lookup": f"select {', '.join(_COLUMNS)} from job_requests where job_id = (select min(job_id) from job_requests)",
    "job_insert_idempotent": "select distinct job_id, 'queued' status from submissions where job_id not in (select job_id from job_requests)",
    "job_claim": "select job_id, created_at from job_requests where status = 'queued' order by created_at, job_id limit 5",
    "job_transitions": f"""with l as (select * from job_requests qualify row_number() over (partition by job_id order by updated_at desc, user_id desc nulls last, status desc, retry_count desc, created_at desc) = 1)
      select job_id, case when status <> 'running' then status when retry_count > 0 then 'failed' else 'done' end status, retry_count + case when status = 'failed' then 1 else 0 end retry_count,
        case when status = 'running' and retry_count > 0 then 'TIMEOUT' else error_code end error_code,
        case when status = 'failed' and retry_count % 2 = 0 then 'next try of ' || job_id when status = 'running' and retry_count > 0 then 'no answer in time' else error_message end error_message,
        case when status = 'done' and posted_at is null then timestamp '{NOW}' else posted_at end posted_at, case when status = 'running' then timestamp '{NOW}' else completed_at end completed_at,
        case when status in ('failed', 'running') or status = 'done' and posted_at is null then timestamp '{NOW}' else updated_at end updated_at from l""",
    "latest_jobs": "select job_id, status, created_at from job_requests order by created_at desc, job_id desc limit 50",
    "job_stats": f"""with l as (select *, case when status = 'done' and started_at is not null and completed_at is not null then (epoch_us(completed_at) - epoch_us(started_at)) / 1000 end ms from job_requests order by created_at desc, job_id desc limit 500)
      select {', '.join(f"count(*) filter (status = '{s}') n_{s}" for s in STATES)}, count(*) filter (status in {STATES}) n_total, {_ROUND.format("ms")}, round(max(case when status = 'queued' then (epoch_us(timestamp '{NOW}') - epoch_us(created_at)) / 1e6 end), 3) longest_wait_s from l""",
    "job_payload": "select json_extract_string(payload, '$.callback.url') url, count(*) n, sum(json_extract(payload, '$.submissions')::bigint)::bigint n_submissions from job_requests group by 1",
    "store_newest": f"with {_STORE} select row_number() over (order by f desc) place, kept.k submission_id, l last_id, task_number from kept join submissions on delivery_id = l",
    "store_stats": f"""with {_STORE}, r as (select *, case when is_correct then 'pending' else 'done' end status from kept join submissions on delivery_id = l), t as (select *, case when status = 'done' and submitted_at is not null then (epoch_us(received_at) - epoch_us(submitted_at)) / 1000 end ms from r)
      select count(*) filter (status = 'pending') n_pending, count(*) filter (status = 'done') n_done, 0::bigint n_failed, count(*) n_total, {_ROUND.format("ms")},
        count(*) filter (status = 'done' and (epoch_us(timestamp '{NOW}') - epoch_us(received_at)) / 1e6 <= 60) throughput, round(max(case when status = 'pending' then (epoch_us(timestamp '{NOW}') - epoch_us(submitted_at)) / 1e6 end), 3) longest_wait_s from t""",
    "offsets_lag": """with e as (select batch_id % 8 p, max(delivery_id) o from submissions group by 1), c as (select batch_id % 8 p, max(delivery_id) o from submissions where is_correct and batch_id % 8 <> 3 group by 1)
      select sum(greatest(e.o - coalesce(c.o, 0), 0))::bigint lag from e left join c using (p)""",
    "delivery_outcomes": """with t as (select (200 + delivery_id % 400)::int status, (batch_id % 8)::int attempt from submissions) select status, attempt, count(*) n, status in (429, 502, 503, 504) retryable,
      case when status between 200 and 299 then 'delivered' when status between 400 and 499 and status not in (408, 429) then 'permanent' else 'transient' end outcome, least(pow(2.0, attempt), 30.0) pause_s from t group by 1, 2""",
    "event_parse": f"select delivery_id, {_DEFECT} defect from submissions",
    "event_submissions": f"""select delivery_id, task_number, coalesce(user_id, '') user_id from submissions left join (select job_id, min(user_id) user_id from job_requests where user_id is not null group by 1) j using (job_id) where {_DEFECT} is null and not is_correct""",
    "stream_dedup": f"select distinct {_KEY} submission_id from submissions where {_DEFECT} is null and {_KEY} is not null",
    "status_table": _STATUS_ORACLE,
    "stream_status": _STATUS_ORACLE,
    "stream_diagnosis": f"""select reason, count(*) n from (select coalesce({_DEFECT}, case when not is_correct and {_KEY} is null then 'permanent' end) reason from submissions) where reason is not null group by 1""",
}
