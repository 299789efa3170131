"""Queries of the general training-data operators: p2 features, p3 sessions, p4 messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from studyloom.operators.entity_features import feature_cells, learner_features
from studyloom.operators.messages import superseded_deliveries, unique_messages
from studyloom.operators.sessions import learner_sessions
from studyloom.plans.tables import table

_ISO = r"'^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})?$'"
#: Readable times of profile_events as microseconds; the offset is taken off by hand.
_EVENT_US = f"""case when regexp_matches(trim(ts), {_ISO}) then
      epoch_us(try_cast(replace(regexp_replace(trim(ts), '(Z|[+-][0-9][0-9]:[0-9][0-9])$', ''), 'T', ' ') as timestamp))
      - case when regexp_matches(trim(ts), '[+-][0-9][0-9]:[0-9][0-9]$')
             then (case when substr(trim(ts), length(trim(ts)) - 5, 1) = '-' then -1 else 1 end)
                  * (cast(substr(trim(ts), length(trim(ts)) - 4, 2) as bigint) * 60 + cast(right(trim(ts), 2) as bigint)) * 60000000
             else 0 end end"""
_WORDS = "replace(replace(lower(trim({0})), '-', '_'), ' ', '_')"
_KEY = r"""case when regexp_matches(lower(trim(submission_id)), '^(urn:uuid:)?\{?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?$')
        then nullif(regexp_replace(replace(lower(trim(submission_id)), 'urn:uuid:', ''), '[{}-]', '', 'g'), repeat('0', 32)) end"""
_GONE = f"""select delivery_id from (
    select delivery_id, row_number() over (partition by k order by submitted_at nulls last, delivery_id) nth
    from (select delivery_id, submitted_at, {_KEY} k from submissions) where k is not null) where nth > 1"""
_MOMENTS = f"""
  select user_id, us from (
    select coalesce(k, 'row ' || delivery_id) m, min(user_id) user_id, epoch_us(min(submitted_at)) us
    from (select delivery_id, job_id, submitted_at, {_KEY} k from submissions) s
    left join (select job_id, min(user_id) user_id from job_requests group by job_id) j using (job_id) group by 1)
  union all select student_id, {_EVENT_US} from profile_events"""
_SESSIONS = f"""
  with m as (select * from ({_MOMENTS}) where user_id is not null and us is not null),
  g as (select *, case when us - lag(us) over (partition by user_id order by us) <= 1800000000 then 0 else 1 end fresh from m),
  s as (select *, sum(fresh) over (partition by user_id order by us range unbounded preceding) sid from g)
  select user_id, min(us) start_us, max(us) end_us, count(*) n_moments from s group by user_id, sid"""


def p2_features(spark: SparkSession, folder: str) -> DataFrame:
    return learner_features(table(spark, folder, "profile_events"))


def p2_feature_cells(spark: SparkSession, folder: str) -> DataFrame:
    return feature_cells(p2_features(spark, folder))


def _sessions(spark: SparkSession, folder: str) -> DataFrame:
    return learner_sessions(table(spark, folder, "submissions"), table(spark, folder, "job_requests"), table(spark, folder, "profile_events"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _sessions(spark, folder).select("user_id", "start_us", "end_us")


def p3_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return _sessions(spark, folder)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return superseded_deliveries(table(spark, folder, "submissions"))


def p4_messages(spark: SparkSession, folder: str) -> DataFrame:
    kept = unique_messages(table(spark, folder, "submissions"))
    return kept.select("delivery_id", "job_id", "submission_id", "task_id", "is_correct", "submitted_at")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_features": p2_features,
    "p2_feature_cells": p2_feature_cells,
    "p3_found": p3_found,
    "p3_sessions": p3_sessions,
    "p4_found": p4_found,
    "p4_messages": p4_messages,
}

ORACLES: dict[str, str] = {
    "p2_feature_cells": f"""
      with e as (select student_id, weight, {_EVENT_US} us, tag, subtype from profile_events),
      k as (select student_id, weight, us, 'tag:' || {_WORDS.format("tag")} kind from e where tag is not null
            union all select student_id, weight, us, 'subtype:' || {_WORDS.format("subtype")} from e where subtype is not null)
      select student_id, kind, count(*) n_events, max(us) latest_us,
             coalesce(sum(cast(round(weight * 1000000) as bigint)), 0) / 1000000.0::double total_weight
      from k group by student_id, kind""",
    "p3_found": f"select user_id, start_us, end_us from ({_SESSIONS})",
    "p3_sessions": f"select user_id, start_us, end_us, end_us - start_us as duration_us, n_moments from ({_SESSIONS})",
    "p4_found": _GONE,
    "p4_messages": f"select delivery_id, job_id, submission_id, task_id, is_correct, submitted_at from submissions where delivery_id not in ({_GONE})",
}
