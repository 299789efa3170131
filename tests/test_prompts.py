"""Solved tasks like a query."""

from __future__ import annotations

from studyloom.operators import prompts
from studyloom.plans.text_queries import similar_tasks

BANK = [(3, "Насосы качают воду", ""), (1, "Лодка плывёт", "по воде и водой"), (2, "Лодка  плывёт", "по морю"), (4, "", "насос"), (5, "Сплав меди", None), (6, "Подводная ЛОДКА", "насос")]
OWN = [("a", 1, "Сплав меди", "водой"), ("a", 2, "Труба", ""), ("b", 7, "Насосная", "вод"), ("b", 9, "Ров", "вода")]
QUERIES = [("a", "a", ["насос", "вод"]), ("b", "b", ["лодка", "вод"]), ("c", "c", []), ("d", "d", ["нет"]), ("e", "e", ["лод", "одк", "дка"])]


def one_by_one(n):
    """What the tasks are when each query goes through all of them, its own newest first."""
    for query, student, tokens in QUERIES:
        found = []
        for _, _, problem, solution in sorted((o for o in OWN if o[0] == student), key=lambda o: -o[1]):
            if problem and solution:
                found.append((sum(t in f"{problem} {solution}".lower() for t in tokens) + 3, problem, "student_recent"))
        for _, problem, solution in sorted(BANK):
            score = sum(t in f"{problem} {solution or ''}".lower() for t in tokens)
            if score > 0 or not tokens:
                found.append((score, problem, "task_bank"))
        place, seen = 0, set()
        for score, problem, source in sorted(found, key=lambda x: -x[0]):
            problem = " ".join(problem.split())
            if problem and problem not in seen and place < n:
                seen.add(problem)
                place += 1
                yield query, place, problem, source, score


def test_similar_tasks_hold_words_inside_words(spark):
    queries = spark.createDataFrame(QUERIES, "query_id string, student_id string, tokens array<string>")
    own = spark.createDataFrame([(s, q, q, p, t) for s, q, p, t in OWN], "student_id string, seq long, rec_id long, problem string, solution string")
    bank = spark.createDataFrame(BANK, "ord long, problem string, solution string")
    for n in (1, 2, 4):
        got = prompts.similar_solved(queries, own, bank, n).orderBy("query_id", "place").collect()
        assert [tuple(r) for r in got] == list(one_by_one(n))


def test_similar_tasks_keep_the_order_of_large_record_numbers(spark, tmp_path):
    """The newest first, across multiples of 2^20; bank tasks with equal CRC-32 ("plumless", "buckeroo") stay apart."""
    events = [("s", 1, 2**20 - 1, "Труба старая"), ("s", 1, 2**20 + 1, "Труба новая"), ("s", 1, 2**21 + 1, "Труба третья"), ("t", 5, 3 * 2**20, "бассейн")]
    rows = [(s, "x", q, r, 1.0, 10, f"task{r}", "other", "1", "2", text, None, "решение" if s == "s" else None) for s, q, r, text in events]
    schema = "student_id string, tag string, attempt_seq int, rec_id long, weight double, task_number int, task_id string, subtype string, student_answer string, correct_answer string, task_text string, problem_katex string, solution string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "profile_events.parquet"))
    spark.createDataFrame([("plumless", "Один бассейн", None), ("buckeroo", "Другой бассейн", None)], "task_id string, question string, problem_katex string").write.parquet(str(tmp_path / "task_bank.parquet"))
    got = [(r.query_id, r.problem) for r in similar_tasks(spark, str(tmp_path)).orderBy("query_id", "place").collect()]
    assert got == [("s", "Труба третья"), ("s", "Труба новая"), ("t", "Другой бассейн"), ("t", "Один бассейн")]


def test_similar_tasks_are_scored_by_whole_texts(spark):
    long = "слово " * 200
    queries = spark.createDataFrame([("a", "a", ["хвост", "слово"])], "query_id string, student_id string, tokens array<string>")
    own = spark.createDataFrame([("a", 1, 1, long + "хвост", "x")], "student_id string, seq long, rec_id long, problem string, solution string")
    bank = spark.createDataFrame([("k", "другое " + long + "хвост", "")], "ord string, problem string, solution string")
    assert [(r.source, r.match, len(r.problem)) for r in prompts.similar_solved(queries, own, bank).orderBy("place").collect()] == [("student_recent", 5, 650), ("task_bank", 2, 650)]
