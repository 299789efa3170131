"""Submitted answers from lookup to record: which task, which subtype, right or wrong, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.config import UNKNOWN
from studyloom.functions.cascade import subtype_of
from studyloom.functions.tags import allowed_tags
from studyloom.functions.text import first_filled, normalize, normalize_task, same_answer, strip


def graded(answers: DataFrame, bank: DataFrame) -> DataFrame:
    """``submission_id, student_id, task_id, task_number, subtype, ok, task_text, student_answer, correct_answer, error`` of each answer.

    ``answers(submission_id, student_id, task_number, task_id, student_answer)``, ``bank(task_id, task_number, question, problem_katex, answer)``
    with unique ``task_id``. ``error`` is ``unknown_task`` for an id that the bank doesn't have (null too) and ``other_number`` for a task of another
    number; what depends on the task is null then. A null answer is wrong.
    """
    tasks = bank.select(F.col("task_id").alias("t_"), F.col("task_number").alias("n_"), first_filled(strip("problem_katex"), "question").alias("text_"), F.col("answer").alias("a_"))
    joined = answers.select("submission_id", "student_id", "task_number", "task_id", "student_answer").join(tasks, F.col("task_id") == F.col("t_"), "left")
    error = F.when(F.col("t_").isNull(), "unknown_task").when(~F.col("task_number").eqNullSafe(F.col("n_")), "other_number")
    known = joined.withColumn("error", error).withColumn("normal_", normalize(normalize_task("text_")))
    right = lambda c: F.when(F.col("error").isNull(), c)
    return known.select(
        "submission_id", "student_id", "task_id", "task_number", right(subtype_of(F.col("normal_"), F.col("task_number"))).alias("subtype"), right(F.coalesce(same_answer("student_answer", "a_"), F.lit(False))).alias("ok"),
        right(F.col("text_")).alias("task_text"), "student_answer", right(F.col("a_")).alias("correct_answer"), "error",
    )


def submit(answers: DataFrame, bank: DataFrame, diagnosed: DataFrame) -> DataFrame:
    """What an answer adds to its learner's profile: :func:`graded` rows with ``tags array<string>, weights map<string,double>``.

    ``diagnosed(submission_id, place, tag, weight)`` are a model's findings (see ``prompts.diagnoses``); those with a tag that the task can't have
    don't count. A wrong answer without a finding has the one tag ``unknown`` of weight 1, a right one none. Task text and
    answers are kept for wrong answers only.
    """
    rows = graded(answers, bank)
    tagged = diagnosed.join(rows.where("not ok").select("submission_id", allowed_tags(F.col("task_number")).alias("allowed_")), "submission_id").where(F.array_contains("allowed_", F.col("tag")))
    once = tagged.groupBy("submission_id", "tag").agg(F.min("place").alias("place"), F.max("weight").alias("weight"))
    found = once.groupBy("submission_id").agg(F.array_sort(F.collect_list(F.struct("place", "tag", F.col("weight").cast("double").alias("weight")))).alias("found"))  # at most the tags of a task
    default = F.array(F.struct(F.lit(1).alias("place"), F.lit(UNKNOWN).alias("tag"), F.lit(1.0).alias("weight")))
    listed = F.when(~F.col("ok"), F.coalesce(F.col("found"), default)).when(F.col("ok"), F.filter(default, lambda x: F.lit(False)))
    wrong = lambda c: F.when(~F.col("ok"), F.col(c)).alias(c)
    out = rows.join(found, "submission_id", "left").withColumn("listed", listed)
    tags = F.transform("listed", lambda x: x["tag"]).alias("tags")
    weights = F.map_from_entries(F.transform("listed", lambda x: F.struct(x["tag"], x["weight"]))).alias("weights")
    return out.select("submission_id", "student_id", "task_id", "task_number", "subtype", "ok", wrong("task_text"), wrong("student_answer"), "correct_answer", "error", tags, weights)
