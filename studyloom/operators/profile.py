"""Learner profiles from histories of answers: replay, error scores, mastery, what to show of the past.

Long tables stand for a profile's lists and maps:

* *attempts*: ``student_id, seq, delivery_id, task_id, task_number, subtype, ok, tags, at, task_text, student_answer, correct_answer``
* *errors*: ``student_id, seq, rec_id, tag, weight, task_number, task_id, subtype, student_answer, correct_answer, task_text, problem_katex, solution``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.config import DEFAULT, UNKNOWN, Settings
from studyloom.functions.cascade import SUBTYPE_LABELS, subtype_of
from studyloom.functions.keys import joined_words, uuid_key
from studyloom.functions.tags import ERROR_LABELS
from studyloom.functions.text import clip, first_filled, label, normalize, strip
from studyloom.operators.messages import message_identity
from studyloom.operators.numbering import number_rows, over_preceding


def newest(df: DataFrame, n: int, group: str | list[str], *order: str, name: str = "nth") -> DataFrame:
    """The ``n`` rows of each group with the largest ``order`` columns, numbered from the newest. Limited before the shuffle."""
    keys = [group] if isinstance(group, str) else group
    window = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)


# --- replay ---


def attempt_log(submissions: DataFrame, job_requests: DataFrame) -> DataFrame:
    """Attempts of every learner in order of time: each message once, its earliest delivery.

    Rows without a user aren't attempts. Order is ``submitted_at`` (null first), then ``delivery_id``;
    ``seq`` counts from 1. The subtype is read from the task text.
    """
    users = job_requests.where("job_id is not null and user_id is not null").groupBy("job_id").agg(F.min("user_id").alias("student_id"))
    key = F.coalesce(uuid_key("submission_id"), message_identity(F.col("delivery_id")))
    first = submissions.select(key.alias("message"), F.col("submitted_at").isNull().alias("undated"), "submitted_at", "delivery_id").groupBy("message").agg(F.min(F.struct("undated", "submitted_at", "delivery_id")).alias("k")).select(F.col("k.delivery_id").alias("delivery_id"))
    kept = submissions.join(first, "delivery_id", "left_semi").join(users, "job_id")
    columns = kept.select(
        "student_id", "delivery_id", "task_id", "task_number", F.col("is_correct").alias("ok"), F.coalesce("diagnostic_tags", F.array().cast("array<string>")).alias("tags"),
        F.col("submitted_at").alias("at"), "task_text", "student_answer", "correct_answer",
    )
    # The subtype is read after numbering, which looks at its input twice.
    numbered = number_rows(columns, "student_id", ["at", "delivery_id"]).withColumn("normal_", normalize("task_text"))
    return numbered.withColumn("subtype", subtype_of(F.col("normal_"), F.col("task_number"))).drop("normal_")


def attempt_errors(attempts: DataFrame, settings: Settings = DEFAULT, weights: DataFrame | None = None) -> DataFrame:
    """One error for each tag of each wrong attempt, or ``unknown`` where it has none: ``student_id, seq, place, number, tag, persistent, weight, task_number, task_id, subtype``.

    A tag other than ``unknown`` that occurred often enough among the learner's preceding errors is
    persistent and weighs more. ``weights(tag, weight)`` gives base weights; others are 1.
    """
    tags = F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.array(F.lit(UNKNOWN)))
    errors = attempts.where("not ok").select("student_id", "seq", "task_number", "task_id", "subtype", F.posexplode(tags).alias("place", "tag"))
    numbered = number_rows(errors, "student_id", ["seq", "place"], "number")
    before = over_preceding(numbered, "student_id", "number", settings.persistence_window, lambda w: F.size(F.filter(F.collect_list("tag").over(w), lambda t: t == F.col("tag"))), "before")
    if weights is not None:
        before = before.join(weights.select(F.col("tag").alias("t_"), F.col("weight").alias("base")), F.col("tag") == F.col("t_"), "left").drop("t_")
    else:
        before = before.withColumn("base", F.lit(1.0))
    persistent = (F.col("tag") != UNKNOWN) & (F.col("before") >= settings.persistence_threshold)
    weight = F.coalesce("base", F.lit(1.0)) * F.when(persistent, settings.persistence_multiplier).otherwise(1.0)
    return before.select("student_id", "seq", "place", "number", "tag", persistent.alias("persistent"), weight.alias("weight"), "task_number", "task_id", "subtype")


def error_log(profile_events: DataFrame) -> DataFrame:
    """Stored error events as *errors*: tags in one spelling, a missing weight is 1; events without tag or sequence are left out."""
    return profile_events.where("tag is not null and attempt_seq is not null and student_id is not null").select(
        "student_id", F.col("attempt_seq").cast("long").alias("seq"), "rec_id", joined_words("tag").alias("tag"), F.coalesce("weight", F.lit(1.0)).alias("weight"), "task_number", "task_id", "subtype",
        "student_answer", "correct_answer", "task_text", "problem_katex", "solution",
    )


def attempt_counts(attempts: DataFrame) -> DataFrame:
    """``student_id, subtype, attempts, wrong``."""
    return attempts.groupBy("student_id", "subtype").agg(F.count("*").alias("attempts"), F.sum((~F.col("ok")).cast("long")).alias("wrong"))


def stored_counts(profiles: DataFrame) -> DataFrame:
    """``student_id, subtype, attempts, wrong`` of stored profiles, of each learner's newest head."""
    heads = newest(profiles, 1, "student_id", "attempt_seq", "updated_at")
    missing = F.create_map().cast("map<string,int>")
    pairs = heads.select("student_id", F.explode(F.coalesce("attempts", missing)).alias("subtype", "attempts"), "wrong")
    return pairs.select("student_id", "subtype", "attempts", F.coalesce(F.coalesce("wrong", missing)[F.col("subtype")], F.lit(0)).alias("wrong"))


def mastery(counts: DataFrame) -> DataFrame:
    """``student_id, subtype, mastery``: share of right answers within [0, 1], 0 without attempts."""
    share = F.when(F.col("attempts") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("wrong") / F.col("attempts")))).otherwise(0.0)
    return counts.select("student_id", "subtype", share.alias("mastery"))


def accuracy_level(counts: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``student_id, attempts, wrong, accuracy, detail``: how detailed an explanation should be; 0 attempts count as accuracy 0."""
    totals = counts.groupBy("student_id").agg(F.sum("attempts").alias("attempts"), F.sum("wrong").alias("wrong"))
    accuracy = F.when(F.col("attempts") > 0, (F.col("attempts") - F.col("wrong")) / F.col("attempts")).otherwise(0.0)
    detail = F.when(F.col("accuracy") < settings.accuracy_low, "подробный").when(F.col("accuracy") < settings.accuracy_mid, "средний").otherwise("краткий")
    return totals.withColumn("accuracy", accuracy).withColumn("detail", detail)


# --- scores ---


def raw_scores(errors: DataFrame) -> DataFrame:
    """``student_id, tag, score`` over all errors ever."""
    return errors.groupBy("student_id", "tag").agg(F.sum("weight").alias("score"))


def retained(errors: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The newest errors that a profile keeps."""
    return newest(errors, settings.event_limit, "student_id", "seq", "rec_id")


def decayed_scores(errors: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``student_id, tag, score`` with weights falling as a power of how many attempts ago; over the newest errors of all tags."""
    kept = retained(errors, settings)
    now = kept.groupBy("student_id").agg(F.max("seq").alias("now"))
    age = F.greatest(F.col("now") - F.col("seq"), F.lit(0))
    return kept.join(now, "student_id").groupBy("student_id", "tag").agg(F.sum(F.col("weight") * F.pow(1.0 + age, F.lit(-settings.decay_alpha))).alias("score"))


def top_errors(scores: DataFrame, n: int = 5, atoms: DataFrame | None = None, subtype: str | None = None) -> DataFrame:
    """``student_id, place, tag, score`` of the largest positive scores, equal ones by tag.

    With ``atoms`` only their tags count, with ``subtype`` only those of atoms of that subtype.
    """
    kept = scores.where("score > 0")
    if atoms is not None:
        own = atoms if subtype is None else atoms.where(F.array_contains("subtypes", subtype))
        kept = kept.join(own.select(F.explode("error_tags").alias("tag")).distinct(), "tag", "left_semi")
    window = Window.partitionBy("student_id").orderBy(F.desc(F.round("score", 9)), "tag")
    return kept.withColumn("place", F.row_number().over(window)).where(F.col("place") <= n).select("student_id", "place", "tag", "score")


def skill_transfer(errors: DataFrame, atoms: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``student_id, skill, score``: each error adds a part of its weight to the skills of every atom with its tag."""
    skills = atoms.select(F.explode("error_tags").alias("tag"), "shared_skills").select("tag", F.explode("shared_skills").alias("skill")).groupBy("tag", "skill").agg(F.count("*").alias("times"))
    weights = raw_scores(errors.where(F.col("tag") != UNKNOWN))
    return weights.join(skills, "tag").groupBy("student_id", "skill").agg(F.sum(F.col("score") * F.col("times") * settings.cross_pollination).alias("score"))


# --- what to show of the past ---


def recent_wrong(errors: DataFrame, n: int = 5, task_number: int | None = None) -> DataFrame:
    """The newest error of each task, at most ``n`` tasks a learner: ``student_id, place, task_id, task_number, task_text, solution, student_answer, correct_answer``. A missing task id is one task."""
    own = errors if task_number is None else errors.where(F.col("task_number") == task_number)
    named = own.withColumn("task_id", F.coalesce("task_id", F.lit("")))
    one = newest(named, 1, ["student_id", "task_id"], "seq", "rec_id").drop("nth")
    text = F.coalesce("problem_katex", F.lit(""))
    return newest(one, n, "student_id", "seq", "rec_id", name="place").select("student_id", "place", "task_id", "task_number", text.alias("task_text"), F.coalesce("solution", F.lit("")).alias("solution"), "student_answer", "correct_answer")


def recent_wrong_context(errors: DataFrame, n: int = 5) -> DataFrame:
    """Like :func:`recent_wrong`, with tag and subtype, and the plain task text where there is no rich one; without a task id, number and text name the task."""
    fallback = F.concat(F.coalesce(F.col("task_number").cast("string"), F.lit("None")), F.lit(":"), F.coalesce("task_text", F.lit("")))
    named = errors.withColumn("task_id", first_filled("task_id", fallback))
    one = newest(named, 1, ["student_id", "task_id"], "seq", "rec_id").drop("nth")
    text = strip(first_filled("problem_katex", F.coalesce("task_text", F.lit(""))))
    return newest(one, n, "student_id", "seq", "rec_id", name="place").select(
        "student_id", "place", "task_id", "task_number", "subtype", F.col("tag").alias("error_tag"), text.alias("task_text"), strip(F.coalesce("solution", F.lit(""))).alias("solution"), "student_answer", "correct_answer"
    )


def recent_attempts(attempts: DataFrame, n: int = 3, task_number: int | None = None, only_wrong: bool = False, settings: Settings = DEFAULT) -> DataFrame:
    """The newest attempt of each task among those a profile keeps: ``student_id, place, task_id, task_number, subtype, ok, problem, errors``."""
    kept = newest(attempts, settings.recent_limit, "student_id", "seq").drop("nth")
    if only_wrong:
        kept = kept.where("not ok")
    if task_number is not None:
        kept = kept.where(F.col("task_number") == task_number)
    one = newest(kept, 1, ["student_id", "task_id"], "seq").drop("nth")
    return newest(one, n, "student_id", "seq", name="place").select("student_id", "place", "task_id", "task_number", label("subtype", SUBTYPE_LABELS).alias("subtype"), "ok", clip("task_text", 900).alias("problem"), F.array_join(F.transform("tags", lambda t: label(t, ERROR_LABELS)), ", ").alias("errors"))


def recent_wrong_examples(attempts: DataFrame, errors: DataFrame, n: int = 3, settings: Settings = DEFAULT, task_number: int | None = None) -> DataFrame:
    """Wrong attempts, newest of each task; where there are fewer than ``n`` tasks, error events fill up: ``student_id, place, task_id, origin, subtype, problem``."""
    wrong = newest(attempts, settings.recent_limit, "student_id", "seq").where("not ok")
    kept = retained(errors, settings)
    if task_number is not None:
        wrong, kept = (df.where(F.col("task_number") == task_number) for df in (wrong, kept))
    first = wrong.select("student_id", F.coalesce("task_id", F.lit("")).alias("task_id"), F.lit(0).alias("origin"), F.col("seq").alias("s_"), F.lit(0).cast("long").alias("r_"), "subtype", F.col("task_text").alias("problem"))
    second = kept.select("student_id", F.coalesce("task_id", F.lit("")).alias("task_id"), F.lit(1).alias("origin"), F.col("seq").alias("s_"), F.col("rec_id").alias("r_"), "subtype", first_filled("problem_katex", F.coalesce("task_text", F.lit(""))).alias("problem"))
    by_origin = [F.col("origin"), F.desc("s_"), F.desc("r_")]
    one = first.unionByName(second).withColumn("nth", F.row_number().over(Window.partitionBy("student_id", "task_id").orderBy(*by_origin))).where("nth = 1")
    placed = one.withColumn("place", F.row_number().over(Window.partitionBy("student_id").orderBy(*by_origin))).where(F.col("place") <= n)
    return placed.select("student_id", "place", "task_id", "origin", label(F.coalesce("subtype", F.lit("other")), SUBTYPE_LABELS).alias("subtype"), clip("problem", 900).alias("problem"))


def concrete_mistakes(errors: DataFrame, n: int = 2, last: int = 20) -> DataFrame:
    """``student_id, place, line``: what was answered and what was right, among the ``last`` errors, each once."""
    subtype = F.coalesce("subtype", F.lit("other"))
    both = newest(errors, last, "student_id", "seq", "rec_id", name="age").where("student_answer is not null and correct_answer is not null").withColumn("subtype", subtype)
    one = both.groupBy("student_id", "student_answer", "correct_answer", "subtype").agg(F.min("age").alias("age"))
    placed = one.withColumn("place", F.row_number().over(Window.partitionBy("student_id").orderBy("age"))).where(F.col("place") <= n)
    line = F.concat(F.lit("В задаче на "), label("subtype", SUBTYPE_LABELS), F.lit(" ответил "), F.col("student_answer"), F.lit(", правильный ответ "), F.col("correct_answer"))
    return placed.select("student_id", "place", line.alias("line"))


def past_context(errors: DataFrame, n: int = 5, last: int = 24, least: int = 20, prefix: int = 400, shown: int = 380) -> DataFrame:
    """``student_id, place, line``: task texts of the ``last`` errors that are long enough, each (by prefix) once."""
    aged = newest(errors, last, "student_id", "seq", "rec_id", name="age").withColumn("t", strip(F.coalesce("task_text", F.lit("")))).where(F.length("t") >= least)
    one = aged.groupBy("student_id", F.substring("t", 1, prefix).alias("p")).agg(F.min(F.struct("age", "task_number", "t")).alias("x"))
    placed = one.withColumn("place", F.row_number().over(Window.partitionBy("student_id").orderBy("x.age"))).where(F.col("place") <= n)
    line = F.concat(F.lit("  - (задание "), F.coalesce(F.col("x.task_number").cast("string"), F.lit("")), F.lit("): "), F.substring(F.col("x.t"), 1, shown))
    return placed.select("student_id", "place", line.alias("line"))


# How queries about a task begin.
_TOPIC_PREFIX = {6: "ЕГЭ задание 6 (уравнение / тип): ", 10: "ЕГЭ задание 10 (текст / тип): ", 12: "ЕГЭ задание 12 (микромодуль / тип задачи): "}


def topic_queries(errors: DataFrame, task_number: int, n: int = 5, least: int = 15, prefix: int = 240, shown: int = 320, settings: Settings = DEFAULT) -> DataFrame:
    """``student_id, place, query`` from the newest error texts of one task, each (by prefix) once."""
    own = retained(errors, settings).where(F.col("task_number") == task_number)
    one = own.withColumn("t", F.replace(strip(F.coalesce("task_text", F.lit(""))), F.lit("\n"), F.lit(" "))).where(F.length("t") >= least)
    one = one.groupBy("student_id", F.substring("t", 1, prefix).alias("p")).agg(F.min(F.struct("nth", "t")).alias("x"))
    placed = one.withColumn("place", F.row_number().over(Window.partitionBy("student_id").orderBy("x.nth"))).where(F.col("place") <= n)
    start = _TOPIC_PREFIX.get(task_number, f"ЕГЭ задание {task_number}: ")
    return placed.select("student_id", "place", F.concat(F.lit(start), F.substring(F.col("x.t"), 1, shown)).alias("query"))


def practised_subtypes(counts: DataFrame, focus: DataFrame, n: int = 4) -> DataFrame:
    """``student_id, place, query``: queries (of ``focus(subtype, query)``) of the most practised subtypes; the first ``n`` are taken before those without a query drop out."""
    relevant = counts.where("attempts > 0").join(focus.select("subtype").distinct(), "subtype", "left_semi")
    window = Window.partitionBy("student_id").orderBy(F.desc("attempts"), "subtype")
    first = relevant.withColumn("place", F.row_number().over(window)).where(F.col("place") <= n)
    return first.join(focus.where("query is not null"), "subtype").select("student_id", "place", "query")


def summary(counts: DataFrame, top: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """One row a learner: totals, detail, top errors with scores to two places, practised and weak subtypes (eight each, as text)."""
    levels = accuracy_level(counts, settings)

    def listed(df: DataFrame, name: str, *parts: Column) -> DataFrame:
        entry = F.struct(F.col("o1"), F.col("o2"), F.concat(*parts).alias("text"))
        ordered = F.array_sort(F.collect_list(entry))
        return df.groupBy("student_id").agg(F.array_join(F.transform(F.slice(ordered, 1, 8), lambda e: e["text"]), "; ").alias(name))

    best = listed(top.where("place <= 8").withColumn("o1", F.col("place").cast("long")).withColumn("o2", F.col("tag")), "top_errors", label("tag", ERROR_LABELS), F.lit(" "), F.format_string("%.2f", F.round(F.round("score", 9), 2)))
    practised = listed(counts.where("attempts > 0").withColumn("o1", -F.col("attempts").cast("long")).withColumn("o2", F.col("subtype")), "practised", label("subtype", SUBTYPE_LABELS), F.lit(" "), F.col("attempts").cast("string"))
    weak = listed(counts.where("wrong > 0").withColumn("o1", -F.col("wrong").cast("long")).withColumn("o2", F.col("subtype")), "weak", label("subtype", SUBTYPE_LABELS), F.lit(" "), F.col("wrong").cast("string"))
    joined = levels.join(best, "student_id", "left").join(practised, "student_id", "left").join(weak, "student_id", "left")
    return joined.select("student_id", "attempts", "wrong", "detail", *(F.coalesce(c, F.lit("")).alias(c) for c in ("top_errors", "practised", "weak")))
