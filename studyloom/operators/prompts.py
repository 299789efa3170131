"""Texts put together from profiles and results: queries, context blocks, snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from studyloom.functions.tags import ERROR_LABELS
from studyloom.functions.text import label, strip, without_fence

#: The query that is always asked, and the one for an empty set.
OVERVIEW, DEFAULT_QUERY = "ЕГЭ профильная математика задания 6, 10 и 12 обзор", "ЕГЭ профильная математика обзор"


def default_query(task_number: Column) -> Column:
    """The query for one task, or for all where the number is null."""
    return F.when(task_number.isNull(), DEFAULT_QUERY).otherwise(F.concat(F.lit("ЕГЭ профильная математика задание "), task_number.cast("string"), F.lit(" обзор")))


def answer_query(text: Column, student_answer: Column, correct_answer: Column) -> Column:
    """A wrong answer as a search query; parts that are null are left out."""
    said = F.concat(F.lit(" Ученик ответил "), student_answer, F.lit("."))
    right = F.concat(F.lit(" Правильный ответ "), correct_answer, F.lit("."))
    return F.concat_ws("", strip(text), said, right)


def wrong_answer_queries(context: DataFrame) -> DataFrame:
    """``student_id, place, query`` of recent wrong tasks, by solution where there is one, else by task text."""
    text = F.when(F.length("solution") > 0, F.col("solution")).otherwise(F.col("task_text"))
    return context.select("student_id", "place", answer_query(text, F.col("student_answer"), F.col("correct_answer")).alias("query"))


def wrong_task_block(context: DataFrame) -> DataFrame:
    """``student_id, block``: a learner's recent wrong tasks as the text that a judge reads."""
    said = F.when(F.col("student_answer").isNotNull(), F.concat(F.lit("- Ответ ученика: "), F.col("student_answer")))
    right = F.when(F.col("correct_answer").isNotNull(), F.concat(F.lit("- Правильный ответ: "), F.col("correct_answer")))
    task = F.when(F.length("solution") > 0, F.concat(F.lit("- Условие задачи с примером решения: "), F.col("solution"))).when(F.length("task_text") > 0, F.concat(F.lit("- Условие задачи: "), F.col("task_text")))
    one = F.concat_ws("\n", F.concat(F.lit("Задача "), F.col("place").cast("string"), F.lit(":")), task, said, right)
    listed = F.array_sort(F.collect_list(F.struct("place", one.alias("t"))))  # as many as tasks were asked for
    return context.groupBy("student_id").agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n\n").alias("block"))


def query_sets(students: DataFrame, *parts: tuple[int, DataFrame]) -> DataFrame:
    """``student_id, place, query``: queries of several parts in order, each once, and the overview last.

    A part is ``(order, DataFrame of student_id, place, query)``.
    """
    every = students.select("student_id", F.lit(10**6).alias("part"), F.lit(1).alias("at"), F.lit(OVERVIEW).alias("query"))
    for order, df in parts:
        every = every.unionByName(df.select("student_id", F.lit(order).alias("part"), F.col("place").cast("int").alias("at"), "query"))
    once = every.where("query is not null").groupBy("student_id", "query").agg(F.min(F.struct("part", "at")).alias("first"))
    return once.select("student_id", F.row_number().over(Window.partitionBy("student_id").orderBy("first", "query")).alias("place"), "query")


def cold_start_queries(students: DataFrame, pool: DataFrame, per_task: int = 3) -> DataFrame:
    """``student_id, place, query``: some queries of each task's ``pool(task_number, query)`` in an order of the learner's own.

    The order comes from a hash of learner and query, not from a random generator, so it is the same everywhere.
    """
    listed = pool.where("query is not null").agg(F.collect_set(F.struct("task_number", "query")).alias("pool"))  # one row, a short curated list
    learners = students.select("student_id").distinct().crossJoin(F.broadcast(listed))
    own = F.array_sort(F.transform("pool", lambda p: F.struct(p["task_number"].alias("task"), F.sha2(F.concat_ws("\u0001", F.col("student_id"), p["query"]), 256).alias("own"), p["query"].alias("query"))))
    mixed = learners.select("student_id", own.alias("own"))
    first = F.filter("own", lambda x, i: (i < per_task) | (F.get("own", i - per_task)["task"] != x["task"]))
    return mixed.select("student_id", F.posexplode(first).alias("p", "x")).select("student_id", (F.col("p") + 1).alias("place"), F.col("x.query").alias("query"))


def pick_task(tasks: DataFrame, seed: int) -> DataFrame:
    """One task for each number, picked by a hash with a seed."""
    usable = tasks.where("task_id is not null and length(task_id) > 0 and answer is not null").where(F.length(strip("answer")) > 0)
    picked = usable.groupBy("task_number").agg(F.min_by("task_id", F.struct(F.sha2(F.concat(F.col("task_id"), F.lit(f"#{seed}")), 256), "task_id")).alias("task_id"))
    return picked.select("task_number", "task_id")


#: Hex digits of an id's hash that name its block in a digest.
BLOCK_DIGITS = 3


def _digest(rows: DataFrame, group: str) -> DataFrame:
    """``<group>, n, digest`` of ``rows(<group>, i, h)``: SHA-256 over the blocks' digests, each over its ``h`` in order of ``i``.

    A group of any size is spread over its blocks (by a hash of the id) first, so that no task holds all of it.
    """
    block = F.substring(F.sha2(F.coalesce("i", F.lit("")), 256), 1, BLOCK_DIGITS)
    own = rows.groupBy(group, block.alias("b")).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("x"), F.count("*").alias("n"))
    blocks = own.select(group, "b", "n", F.sha2(F.array_join(F.transform("x", lambda x: x["h"]), ""), 256).alias("d"))
    every = blocks.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("b", "d"))).alias("x"), F.sum("n").alias("n"))  # at most 16^3 blocks
    return every.select(group, "n", F.sha2(F.array_join(F.transform("x", lambda x: x["d"]), ""), 256).alias("digest"))


def content_digest(rows: DataFrame, id_: str, text: str, group: str) -> DataFrame:
    """``<group>, digest``: 16 hex digits over all ids and texts of a group; a stored index is fresh while it stays the same."""
    line = F.sha2(F.concat(F.coalesce(F.col(id_), F.lit("")), F.lit("|"), F.coalesce(F.col(text), F.lit("")), F.lit("\n")), 256)
    return _digest(rows.select(group, F.col(id_).alias("i"), line.alias("h")), group).select(group, F.substring("digest", 1, 16).alias("digest"))


def ids_digest(rows: DataFrame, group: str, id_: str) -> DataFrame:
    """``<group>, n, digest``: 32 hex digits over a group's ids, as a mark of what a result was made from."""
    found = _digest(rows.select(group, F.col(id_).alias("i"), F.col(id_).alias("h")), group)
    return found.select(group, "n", F.concat(F.lit("sha256:"), F.substring("digest", 1, 32)).alias("digest"))


def diagnoses(answers: DataFrame, known: DataFrame, weight: float = 1.15, most: int = 3) -> DataFrame:
    """``submission_id, place, tag, reason, weight`` from a model's JSON in ``raw``: its first ``most`` mistakes, those with a known tag and a reason."""
    shape = "mistakes array<struct<tag:string,reason:string>>"
    first = F.slice(F.coalesce(F.from_json(without_fence("raw"), shape)["mistakes"], F.array().cast("array<struct<tag:string,reason:string>>")), 1, most)
    rows = answers.select("submission_id", F.posexplode(first).alias("p", "m")).select("submission_id", (F.col("p") + 1).alias("place"), strip("m.tag").alias("tag"), strip("m.reason").alias("reason"))
    return rows.where(F.length("reason") > 0).join(known.select("tag").distinct(), "tag", "left_semi").select("submission_id", "place", "tag", "reason", F.lit(weight).alias("weight"))


def rationale(found: DataFrame, most: int = 1000) -> DataFrame:
    """``submission_id, tags, rationale``: reasons joined by dashes, cut to a length."""
    listed = F.array_sort(F.collect_list(F.struct("place", "tag", "reason")))  # at most three a submission
    whole = found.groupBy("submission_id").agg(listed.alias("x"))
    return whole.select("submission_id", F.array_join(F.transform("x", lambda x: x["tag"]), ",").alias("tags"), F.substring(F.array_join(F.transform("x", lambda x: x["reason"]), " - "), 1, most).alias("rationale"))


def learner_block(top: DataFrame, frontier: DataFrame, wrong: DataFrame) -> DataFrame:
    """``student_id, block``: what a reader has to know about a learner: main error, top errors, topics, recent wrong tasks."""
    errors = top.groupBy("student_id").agg(F.array_sort(F.collect_list(F.struct("place", label("tag", ERROR_LABELS).alias("t")))).alias("e"))
    topics = frontier.groupBy("student_id").agg(F.array_sort(F.collect_list(F.struct("place", "title"))).alias("f"))
    part = F.concat(
        F.lit("  "), F.col("place").cast("string"), F.lit(". Задание №"), F.coalesce(F.col("task_number").cast("string"), F.lit("?")),
        F.when(F.length(strip("task_text")) > 0, F.concat(F.lit(": "), F.substring(strip("task_text"), 1, 120))).otherwise(""),
        F.coalesce(F.concat(F.lit(" | ответил: "), F.col("student_answer")), F.lit("")), F.coalesce(F.concat(F.lit(" | правильно: "), F.col("correct_answer")), F.lit("")),
    )
    tasks = wrong.groupBy("student_id").agg(F.array_sort(F.collect_list(F.struct("place", part.alias("t")))).alias("w"))
    joined = errors.join(topics, "student_id", "full").join(tasks, "student_id", "full")
    lines = F.array(
        F.concat(F.lit("Главная ошибка ученика: "), F.get("e", F.lit(0))["t"]),
        F.concat(F.lit("Частые ошибки: "), F.array_join(F.transform(F.slice("e", 1, 6), lambda x: x["t"]), ", ")),
        F.concat(F.lit("Следующие темы: "), F.array_join(F.transform("f", lambda x: x["title"]), "; ")),
        F.concat(F.lit("Недавние неверные задачи:\n"), F.array_join(F.transform("w", lambda x: x["t"]), "\n")),
    )
    return joined.select("student_id", F.array_join(F.array_compact(lines), "\n").alias("block"))


#: Words of queries whose places in the bank a task keeps.
MOST_WORDS = 20_000


def _bank_best(queries: DataFrame, bank: DataFrame, n: int) -> DataFrame:
    """``query_id, at, problem, match``: for each query the ``n`` best distinct problems of a bank, equal matches in order of ``ord``.

    The bank is a table that people write, so it goes along with the code; queries come in Arrow batches, and no pair is ever a row.
    """
    from studyloom.functions.text import clip

    shown = bank.select("ord", clip("problem", 650).alias("problem"), F.lower(F.concat_ws(" ", F.coalesce("problem", F.lit("")), F.coalesce("solution", F.lit("")))).alias("hay"))
    rows = shown.where(F.length("problem") > 0).orderBy("ord", "problem", "hay").collect()
    at, problems, hays = ([r[c] for r in rows] for c in ("ord", "problem", "hay"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds: dict[str, np.ndarray] = {}
        for batch in it:
            if len(holds) > MOST_WORDS:
                holds.clear()
            out: tuple[list, list, list, list] = ([], [], [], [])
            for query, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                match = np.zeros(len(hays), np.int32)
                for token in tokens or ():
                    if token not in holds:
                        holds[token] = np.fromiter((token in hay for hay in hays), bool, len(hays))
                    match += holds[token]
                seen: set[str] = set()
                for i in np.argsort(-match, kind="stable"):
                    if len(seen) == n or (tokens and not match[i]):
                        break
                    if problems[i] not in seen:
                        seen.add(problems[i])
                        for column, x in zip(out, (query, at[i], problems[i], int(match[i]))):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (batch.schema.field(0).type, at_type, pa.string(), pa.int32()))], ["query_id", "at", "problem", "match"])

    at_type = to_arrow_type(bank.schema["ord"].dataType)
    kinds = queries.schema["query_id"].dataType.simpleString(), bank.schema["ord"].dataType.simpleString()
    return queries.select("query_id", "tokens").mapInArrow(run, f"query_id {kinds[0]}, at {kinds[1]}, problem string, match int")


def similar_solved(queries: DataFrame, own: DataFrame, bank: DataFrame, n: int = 2) -> DataFrame:
    """``query_id, place, problem, source, match``: solved tasks whose text holds the most words of a query; a learner's own tasks count three more.

    ``queries(query_id, student_id, tokens)``, ``own(student_id, seq, rec_id, problem, solution)``, ``bank(ord, problem, solution)``. A word counts wherever
    the text has it, inside longer words too. Of equal matches own tasks come first, by ``seq, rec_id`` from the newest, then the bank's by ``ord``, of any type. Bank tasks without any word of the query don't count; queries without words get the bank's first tasks.
    """
    from studyloom.functions.text import clip, tokens_contained

    mine = queries.join(own.where("length(problem) > 0 and length(solution) > 0"), "student_id").withColumn("match", tokens_contained(F.col("tokens"), "problem", "solution") + 3)
    mine = mine.select("query_id", "seq", "rec_id", clip("problem", 650).alias("problem"), "match")  # matched before: the whole text counts
    theirs = _bank_best(queries, bank, n)
    every = mine.withColumn("origin", F.lit(0)).unionByName(theirs.withColumn("origin", F.lit(1)), allowMissingColumns=True).where(F.length("problem") > 0)
    order = [F.desc("match"), F.col("origin"), F.desc("seq"), F.desc("rec_id"), F.col("at")]
    one = every.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "problem").orderBy(*order))).where("nth = 1")
    placed = one.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= n)
    return placed.select("query_id", "place", "problem", F.when(F.col("origin") == 0, "student_recent").otherwise("task_bank").alias("source"), "match")


# Lead-ins of the context that a note is written from.
_ERRORS_LEAD, _NO_ERRORS = "Ученик чаще всего допускает такие ошибки:", "У ученика пока нет статистики ошибок — дай общий конспект по теме."
_EXAMPLES_LEAD, _TOPICS_LEAD = "Конкретные примеры:", "Следующие темы для изучения (слабо освоены, но пререквизиты готовы):"
_MISTAKES_LEAD, _MATERIAL_LEAD, _NO_MATERIAL = "Известные типичные заблуждения:", "Справочный материал:", "Нет дополнительного справочного материала."
_ANY_ERROR = "типичная ошибка"


def _collected(df: DataFrame, name: str, text: Column, most: int | None = None) -> DataFrame:
    """``student_id, <name>``: a learner's texts in order of ``place``, at most the first few; without ``most`` all, which are as many as were asked for."""
    kept = df if most is None else df.where(F.col("place") <= most)
    return kept.groupBy("student_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", text.alias("t")))), lambda x: x["t"]).alias(name))


def context_bundle(levels: DataFrame, top: DataFrame, mistakes: DataFrame, topics: DataFrame, retrieved: DataFrame) -> DataFrame:
    """One row a learner of ``levels(student_id, detail)`` with all that a note is written from.

    ``top(student_id, place, tag)``, ``mistakes(student_id, place, line)``, ``topics(student_id, place, title)``,
    ``retrieved(student_id, place, atom, title, text)``; misconceptions (ids with ``mc_``) come before other material.
    Result: ``student_id, detail, errors_block, frontier_block, context_section, n_err_items, top_err``.
    """
    is_mistake = F.col("atom").startswith("mc_")
    block = F.concat(F.col("place").cast("string"), F.lit(". "), F.col("title"), F.lit("\n"), F.col("text"))
    parts = [
        _collected(top, "e", label("tag", ERROR_LABELS), 5),
        _collected(mistakes, "m", F.concat(F.lit("  - "), F.col("line")), 2),
        _collected(topics, "f", F.concat(F.lit("  - "), F.col("title")), 3),
        _collected(retrieved.where(is_mistake), "w", block),
        _collected(retrieved.where(~is_mistake), "c", block),
    ]
    row = levels.select("student_id", "detail")
    for part in parts:
        row = row.join(part, "student_id", "left")
    errors = F.concat_ws("\n", F.lit(_ERRORS_LEAD), F.array_join(F.transform("e", lambda x: F.concat(F.lit("  - "), x)), "\n"))
    examples = F.when(F.col("m").isNotNull(), F.concat(F.lit("\n\n" + _EXAMPLES_LEAD + "\n"), F.array_join("m", "\n"))).otherwise("")
    known = F.when(F.col("w").isNotNull(), F.concat(F.lit(_MISTAKES_LEAD + "\n"), F.array_join("w", "\n\n")))
    material = F.when(F.col("c").isNotNull(), F.concat(F.lit(_MATERIAL_LEAD + "\n"), F.array_join("c", "\n\n"))).otherwise(_NO_MATERIAL)
    return row.select(
        "student_id", "detail",
        F.when(F.col("e").isNotNull(), F.concat(errors, examples)).otherwise(_NO_ERRORS).alias("errors_block"),
        F.when(F.col("f").isNotNull(), F.concat(F.lit(_TOPICS_LEAD + "\n"), F.array_join("f", "\n"))).otherwise("").alias("frontier_block"),
        F.concat_ws("\n\n---\n\n", known, material).alias("context_section"),
        F.coalesce(F.size("e"), F.lit(2)).alias("n_err_items"), F.coalesce(F.get("e", F.lit(0)), F.lit(_ANY_ERROR)).alias("top_err"),
    )
