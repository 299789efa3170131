"""Measures of retrieval and of judged results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.config import DEFAULT, JUDGE_SCORES, Settings

CUTS = (1, 3, 5, 10)


def ir_metrics(ranked: DataFrame, relevant: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """``query_id, k, precision, recall, hit, mrr, map, ndcg`` of ``ranked(query_id, doc_id, place)`` against ``relevant(query_id, doc_id)``.

    Queries without a relevant document don't count; those without an answer score 0. Precision is over
    ``k`` even where fewer came back; average precision over the smaller of ``k`` and the relevant ones.
    """
    pairs = relevant.select("query_id", "doc_id").distinct()
    counts = pairs.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    hits = ranked.where(F.col("place") <= max(cuts)).join(pairs, ["query_id", "doc_id"]).select("query_id", "place")
    found = Window.partitionBy("query_id").orderBy("place")
    hits = hits.withColumn("nth", F.row_number().over(found))
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "nth"))).alias("hits"))  # at most the largest cut
    each = counts.join(lists, "query_id", "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<place:int,nth:int>>"))).withColumn("k", F.explode(F.array(*map(F.lit, cuts))))
    top = F.filter("hits", lambda h: h["place"] <= F.col("k"))
    add = lambda f: F.aggregate(F.transform(top, f), F.lit(0.0), lambda a, x: a + x)
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.least("k", F.col("n_relevant").cast("int"))), lambda i: 1 / F.log2(i + 1.0)), F.lit(0.0), lambda a, x: a + x)
    n = F.size(top)
    return each.select(
        "query_id", "k", (n / F.col("k")).alias("precision"), (n / F.col("n_relevant")).alias("recall"), F.when(n > 0, 1.0).otherwise(0.0).alias("hit"),
        F.coalesce(1 / F.get(top, F.lit(0))["place"], F.lit(0.0)).alias("mrr"), (add(lambda h: h["nth"] / h["place"]) / F.least("k", "n_relevant")).alias("map"), (add(lambda h: 1 / F.log2(h["place"] + 1.0)) / ideal).alias("ndcg"),
    )


METRICS = ("precision", "recall", "hit", "mrr", "map", "ndcg")


def macro_averages(metrics: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """Means of :func:`ir_metrics` per group and over all (null group) at each cut, in one pass: ``<group>, k, n_queries, ...``."""
    joined = metrics.join(groups.select("query_id", group), "query_id")
    means = [F.avg(m).alias(m) for m in METRICS]
    return joined.rollup("k", group).agg(F.count("*").alias("n_queries"), *means).where("k is not null").select(group, "k", "n_queries", *METRICS)


def snap_score(c: Column) -> Column:
    """The allowed score nearest to a number, the lower of two equally near."""
    grid = F.array(*map(F.lit, JUDGE_SCORES))
    return F.array_min(F.transform(grid, lambda x: F.struct(F.abs(x - c).alias("off"), x.alias("score"))))["score"]


def judged(answers: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``judge_score, is_relevant, matched_task_numbers, rationale`` from a judge's JSON in ``raw_response`` beside all other columns.

    An empty or unreadable answer scores 0 and says why.
    """
    from studyloom.functions.text import relaxed_json, strip

    data = F.from_json(relaxed_json("raw_response"), "score double, matched_task_numbers array<string>, rationale string")
    parsed = answers.withColumn("d_", data)
    empty = F.length(strip(F.coalesce("raw_response", F.lit("")))) == 0
    score = snap_score(F.coalesce("d_.score", F.lit(0.0)))
    numbers = F.transform(F.filter(F.coalesce("d_.matched_task_numbers", F.array().cast("array<string>")), lambda x: x.rlike(r"^\d{1,9}$")), lambda x: x.cast("int"))
    why = F.when(empty, "empty_llm_response").when(F.col("d_").isNull(), "invalid_json_from_llm").otherwise(strip(F.coalesce("d_.rationale", F.lit(""))))
    return parsed.withColumns({"judge_score": score, "is_relevant": score >= settings.judge_relevant, "matched_task_numbers": numbers, "rationale": why}).drop("d_")


def judge_averages(results: DataFrame) -> DataFrame:
    """``student_id, avg_judge_score, relevant_count, retrieved_count, relevant_ratio``."""
    n, relevant = F.count("*"), F.sum(F.col("is_relevant").cast("long"))
    return results.groupBy("student_id").agg(F.avg("judge_score").alias("avg_judge_score"), relevant.alias("relevant_count"), n.alias("retrieved_count"), (relevant / n).alias("relevant_ratio"))


def judge_overall(per_student: DataFrame) -> DataFrame:
    """One row: mean of the learners' means, and totals."""
    relevant, retrieved = F.sum("relevant_count"), F.sum("retrieved_count")
    return per_student.agg(F.count("*").alias("student_count"), F.avg("avg_judge_score").alias("overall_avg_judge_score"), F.coalesce(relevant, F.lit(0)).alias("total_relevant"), F.coalesce(retrieved, F.lit(0)).alias("total_retrieved"), F.try_divide(relevant, retrieved).alias("relevant_ratio"))


def document_scores(documents: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """One row of means over documents without an error: count, excluded, the overall mean and each metric's."""
    good = F.when(~F.col("has_error"), 1)
    overall = sum((F.col(m) for m in metrics[1:]), F.col(metrics[0])) / len(metrics)
    return documents.agg(F.count(good).alias("student_count"), F.count(F.when(F.col("has_error"), 1)).alias("excluded_count"), F.avg(F.when(~F.col("has_error"), overall)).alias("overall_avg_score"), *(F.avg(F.when(~F.col("has_error"), F.col(m))).alias(f"avg_{m}") for m in metrics))


def student_order(c: Column) -> tuple[Column, Column, Column]:
    """Sort key of ids like ``archive_u12``: prefix, number, id."""
    prefix, number = F.regexp_extract(c, r"^(.*)_u\d+$", 1), F.regexp_extract(c, r"_u(\d+)$", 1)
    split = number != ""
    return F.when(split, prefix).otherwise(c), F.when(split, number.cast("bigint")).otherwise(F.lit(0).cast("bigint")), c


def merge_students(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer merge of two tables by ``student_id``; ids that are null or empty are left out."""
    a, b = (df.where("student_id is not null and student_id <> ''") for df in (left, right))
    return a.join(b, "student_id", "full")


def dashboard_summary(documents: DataFrame, judged_results: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row that a dashboard begins with, from one row each of :func:`document_scores` and :func:`judge_overall`, and from
    :func:`macro_averages`; counts of sources that are missing are 0, their means null.
    """
    # One row each.
    one = lambda df, prefix: df.select(*(F.col(c).alias(f"{prefix}_{c}") for c in df.columns))
    every = benchmark.agg(F.coalesce(F.max("n_queries"), F.lit(0)).alias("benchmark_evaluated"), F.array_sort(F.collect_set("k")).alias("benchmark_cuts"))
    row = every.join(F.broadcast(one(documents, "conspect").limit(1)), how="left").join(F.broadcast(one(judged_results, "judge").limit(1)), how="left")
    return row.select(*(F.coalesce(c, F.lit(0)).alias(c) if c.endswith(("_count", "_relevant", "_retrieved", "_evaluated")) else F.col(c) for c in row.columns))
