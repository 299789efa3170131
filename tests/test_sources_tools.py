"""Readers and writers, model hooks, tools, and the registered queries."""

from __future__ import annotations

import importlib
import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from studyloom.operators import hooks
from studyloom.sources import files
from studyloom.staging import release, stage

REPO = Path(__file__).resolve().parent.parent


def put(path, data):
    path.write_text(data if isinstance(data, str) else json.dumps(data, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_atoms_are_checked(spark, tmp_path):
    good = put(tmp_path / "a.json", [{"id": "x", "title": "T", "text": "t", "task_number": 10, "prerequisites": ["y"]}, {"id": "y", "title": "T", "text": "t", "task_number": 10, "subtypes": None}])
    rows = files.read_atoms(spark, [good, good]).orderBy("ord").collect()
    assert [(r.id, r.ord, r.prerequisites, r.subtypes) for r in rows[:2]] == [("x", 0, ["y"], []), ("y", 1, [], [])] and len(rows) == 4
    for bad in ([{"id": "x"}], ["x"], {"id": "x"}):
        with pytest.raises(files.AtomError):
            files.read_atoms(spark, [put(tmp_path / "b.json", bad)])
    assert files.read_atoms(spark, []).collect() == []


def test_misconceptions_are_lenient(spark, tmp_path):
    path = put(tmp_path / "m.json", [{"id": "mc_1", "title": "T", "text": " t ", "error_tag": "a", "task_number": 12}, "odd", {"id": "mc_2", "title": "T", "text": "t", "error_tag": "unknown"}, {"id": "mc_3", "title": "T", "text": "x" * 800, "error_tag": "b"}])
    df = files.read_misconceptions(spark, path, {"a", "b"}, 5)
    assert [(r.id, r.task_number, r.error_tags, r.ord) for r in df.orderBy("ord").collect()] == [("mc_1", 12, ["a"], 5), ("mc_3", 10, ["b"], 6)]
    assert [len(r.text) for r in files.misconception_hints(df).orderBy("ord").collect()] == [1, 700]


def test_task_bank_drops_what_it_cannot_read(spark, tmp_path):
    path = put(tmp_path / "t.json", [{"id": "1", "task_number": "10", "question": "q", "answer": " 5 "}, {"id": "2", "task_number": "x"}, {"id": "3", "task_number": 6}])
    assert sorted((r.task_id, r.task_number, r.answer) for r in files.read_tasks(spark, path).collect()) == [("1", 10, "5"), ("3", 6, "")]


def test_archive(spark, tmp_path):
    text = "﻿user_number;task_number;task_id;submission_id;node_name;task_name;is_correct;submission_time\n1;10.0;a;s;n;t;True;2026-02-04 22:23:20.665872+00:00\n2;99;a;s;n;t;no;x\n3;6;a;s;n;t;0;bad\n;x;a;s;n;t;1;\n"
    rows = files.read_archive(spark, put(tmp_path / "a.csv", text)).collect()
    assert [(r.user_number, r.task_number, r.is_correct, r.submitted_at is not None) for r in rows] == [("1", 10, True, True), ("3", 6, False, False)]


def test_profiles_round_trip(spark, tmp_path):
    path = put(tmp_path / "p.json", {"student_id": "archive_u1", "attempts": {"x": 2}})
    df = files.read_profiles(spark, path)
    one = df.first()
    assert (one.attempts, one.wrong, one.decay_half_life, one.attempt_seq, one.error_events) == ({"x": 2}, {}, 20.0, 0, [])
    files.write_profiles(df, str(tmp_path / "out"))
    files.write_profiles(df, str(tmp_path / "out"))
    more = df.unionByName(df.withColumn("student_id", F.lit("archive_u2")))
    files.write_profiles(more, str(tmp_path / "out"), buckets=4)
    assert sorted(r.student_id for r in files.read_profiles(spark, str(tmp_path / "out")).collect()) == ["archive_u1", "archive_u2"]
    assert [(r.student_id, r.attempts) for r in files.read_profile(spark, str(tmp_path / "out"), "archive_u2", buckets=4).collect()] == [("archive_u2", {"x": 2})]


def test_solutions_of_users_and_of_a_table(spark, tmp_path):
    solved = lambda n: {"task_number": str(n), "problem_katex": f"p{n}", "solution": "s"}
    path = put(tmp_path / "s.json", [{"user_id": str(u), "solutions": [solved(10 * u + i) for i in range(4)]} for u in range(3)])
    csv = put(tmp_path / "t.csv", "problem_katex,solution\na,b\n\"c,\nd\",e\nf,g\n")
    assert files.read_solutions(spark, path, per_user=2).count() == 6
    rows = files.read_solutions(spark, path, csv, users=2, per_user=3, most=5, in_all=7).collect()
    assert [r.source for r in rows] == ["archive_submission"] * 5 + ["tasks_with_solutions"] * 2
    assert (rows[-1].problem, rows[-1].task_number, rows[0].task_number) == ("c,\nd", None, 0)


def test_vectors_are_put_over_older_ones(spark, tmp_path):
    schema = "id string, text string, task_number int, dense array<float>"
    path = str(tmp_path / "index")
    files.write_vectors(spark.createDataFrame([("a", "x", 10, [1.0]), ("b", "y", 12, [2.0])], schema), path)
    files.upsert_vectors(spark.createDataFrame([("b", "z", 12, [3.0]), ("c", "w", 10, [4.0])], schema), path)
    assert sorted((r.id, r.text) for r in spark.read.parquet(f"{path}/points").collect()) == [("a", "x"), ("b", "z"), ("c", "w")]
    assert files.is_fresh(spark.createDataFrame([("a", "x", 10, [1.0]), ("b", "z", 12, [3.0]), ("c", "w", 10, [4.0])], schema), path)


def test_notes_with_and_without_meta(spark, tmp_path):
    put(tmp_path / "u1.md", "# a\nb")
    put(tmp_path / "u2.md", "c")
    put(tmp_path / "u1.meta.json", {"k": 1})
    assert sorted(map(tuple, files.read_notes(spark, str(tmp_path)).collect())) == [("u1", "# a\nb", '{"k": 1}'), ("u2", "c", "{}")]


def test_an_index_is_fresh_until_a_text_changes(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x", 10, [1.0]), ("b", "y", 12, [2.0])], "id string, text string, task_number int, dense array<float>")
    path = str(tmp_path / "index")
    assert not files.is_fresh(docs, path)
    files.write_vectors(docs, path)
    assert files.is_fresh(docs, path)
    assert not files.is_fresh(docs.withColumn("text", F.concat("text", F.lit("!"))), path)
    assert not files.is_fresh(docs.where("id = 'a'"), path)


def test_a_model_that_fails_gives_errors_not_failures(spark):
    prompts = spark.createDataFrame([(i, "s", f"q{i}") for i in range(6)], "id int, system string, user string")

    def model(pairs):
        if any(u == "q3" for _, u in pairs):
            raise ValueError("no")
        return [u.upper() for _, u in pairs]

    got = {r.id: (r.answer, r.error) for r in hooks.ask(prompts, model).collect()}
    assert got == {i: (f"Q{i}", None) if i != 3 else (None, "ValueError: no") for i in range(6)}
    vectors = hooks.embed(spark.createDataFrame([(1, "a"), (2, None)], "id int, t string"), lambda ts: [[3.0, 4.0] for _ in ts], "id", "t")
    assert {r.id: r.vector for r in vectors.collect()} == {1: [0.6, 0.8], 2: None}

    def picky(ts):
        if "bad" in ts:
            raise ValueError("no")
        return [[1.0]] * len(ts)

    texts = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "c")], "id int, t string").coalesce(1)
    assert {r.id: (r.vector, r.error) for r in hooks.embed(texts, picky, "id", "t").collect()} == {1: ([1.0], None), 2: (None, "ValueError: no"), 3: (None, None), 4: ([1.0], None)}
    short = {r.id: r.error for r in hooks.embed(texts.where("id = 1"), lambda ts: [], "id", "t").collect()}
    assert short[1].startswith("ValueError")


def test_deliveries_are_tried_again_under_one_key(spark):
    rows = spark.createDataFrame([("ok", "u", "t", "{}"), ("busy", "u", None, "{}"), ("no", "u", None, "{}"), ("late", "u", None, "{}"), ("down", "u", None, "{}")], "job_id string, url string, token string, body string").coalesce(1)

    def send(url, headers, body, seen={}):  # noqa: B006
        key = headers["Idempotency-Key"]
        seen[key] = seen.get(key, 0) + 1
        assert ("Authorization" in headers) == (key == "ok")
        if key == "down":
            raise OSError("no network")
        return {"ok": 204, "no": 404, "busy": 503}.get(key) or (429 if seen[key] < 2 else 200)

    got = {r.job_id: (r.outcome, r.status, r.n_tries) for r in hooks.deliver(rows, send, "job_id", "url", "token", "body", pause=lambda s: None).collect()}
    assert got == {"ok": ("delivered", 204, 1), "busy": ("transient", 503, 3), "no": ("permanent", 404, 1), "late": ("delivered", 200, 2), "down": ("transient", None, 3)}
    assert hooks.deliver(rows.where("false"), send, "job_id", "url", "token", "body").collect() == []


def test_submitted_answers(spark):
    from studyloom.operators.submit import submit

    bank = spark.createDataFrame([("t1", 10, "Насос наполняет бак", None, "2,5"), ("t2", 12, "f(x) = sin x", None, "1")], "task_id string, task_number int, question string, problem_katex string, answer string")
    answers = spark.createDataFrame([(1, "s", 10, "t1", "2.5"), (2, "s", 10, "t1", "3"), (3, "s", 12, "t2", None), (4, "s", 6, "t2", "1"), (5, "s", 6, "no", "1"), (6, None, 6, None, None)], "submission_id long, student_id string, task_number int, task_id string, student_answer string")
    found = spark.createDataFrame([(2, 1, "units_mismatch", 1.15), (2, 2, "deriv_sign_error", 1.15), (2, 3, "units_mismatch", 1.15), (1, 1, "units_mismatch", 1.15)], "submission_id long, place int, tag string, weight double")
    got = {r.submission_id: r for r in submit(answers, bank, found).collect()}
    assert (got[1].ok, got[1].tags, got[1].subtype, got[1].task_text) == (True, [], "joint_work", None)
    assert (got[2].ok, got[2].tags, got[2].weights, got[2].correct_answer) == (False, ["units_mismatch"], {"units_mismatch": 1.15}, "2,5")
    assert (got[3].ok, got[3].tags, got[3].subtype) == (False, ["unknown"], "trig")
    assert [got[i].error for i in (1, 4, 5, 6)] == [None, "other_number", "unknown_task", "unknown_task"] and got[5].ok is None and got[5].tags is None
    assert submit(answers.where("false"), bank, found).collect() == []


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from studyloom import staging

    cluster = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            staging.shared_root(cluster(master))
    assert staging.shared_root(cluster("local[4]")).startswith("file://")


def test_tools(spark):
    from studyloom.operators import tools
    from studyloom.operators.profile import error_log
    from studyloom.plans import profile_queries as Q
    from studyloom.plans.tables import table

    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no test tables")
    atoms = table(spark, folder, "atoms")
    mis = atoms.where("ord < 40").select("title", "text", F.get("error_tags", F.lit(0)).alias("error_tag"), "task_number", "ord")
    bank = table(spark, folder, "task_bank").select(F.crc32(F.col("task_id").cast("binary")).alias("ord"), F.coalesce("question", F.lit("")).alias("problem"), F.coalesce("problem_katex", F.lit("")).alias("solution"))
    errors = error_log(table(spark, folder, "profile_events"))
    base = errors.select("student_id").distinct().crossJoin(atoms.where("ord < 30").select(F.col("id").alias("atom"), (1 / (10 + F.col("ord"))).alias("score")))
    ctx = tools.Context(Q._attempts(spark, folder), errors, Q._counts(spark, folder), atoms, mis, bank, base)
    for name in tools.TOOLS:
        out = tools.call(ctx, name, {"task number": "10", "limit": "2", "k": 3, "query": "насос"})
        assert "error" not in out.columns or name == "get_misconception_hints", name
        assert out.count() > 0, name
    assert tools.call(ctx, "none").first().error == "unknown tool: none"
    assert tools.call(ctx, "get_frontier_topics", {"limit": "99"}).groupBy("student_id").count().agg(F.max("count")).first()[0] <= 6


def test_tools_keep_to_the_asked_task(spark):
    from studyloom.operators import tools

    empty = "array<string>"
    atoms = spark.createDataFrame([(f"a{i}", f"A{i}", "t", n, [s], ["x"], [], [], i) for i, (n, s) in enumerate([(6, "p"), (10, "p"), (10, "q"), (12, "q")])], f"id string, title string, text string, task_number int, subtypes {empty}, error_tags {empty}, prerequisites {empty}, shared_skills {empty}, ord int")
    tasks = [("s", i, i, "x", 1.0, n, f"t{i}", "p", None, None, f"насос {n}", None, "решение") for i, n in enumerate([6, 10, 12, 10, 6], 1)]
    errors = spark.createDataFrame(tasks, "student_id string, seq long, rec_id long, tag string, weight double, task_number int, task_id string, subtype string, student_answer string, correct_answer string, task_text string, problem_katex string, solution string")
    attempts = errors.select("student_id", "seq", F.concat(F.lit("w"), "task_id").alias("task_id"), "task_number", "subtype", F.lit(False).alias("ok"), F.concat(F.lit("попытка "), "task_number").alias("task_text"))
    bank = spark.createDataFrame([(n, n, f"банк насос {n}", "решение") for n in (6, 10, 12)], "ord long, task_number int, problem string, solution string")
    counts = spark.createDataFrame([("s", "p", 5, 5)], "student_id string, subtype string, attempts int, wrong int")
    base = atoms.select(F.lit("s").alias("student_id"), F.col("id").alias("atom"), F.lit(0.1).alias("score"))
    ctx = tools.Context(attempts, errors, counts, atoms, atoms, bank, base)
    ask = lambda name, **more: tools.call(ctx, name, {"task number": "10", "limit": "5", **more}).collect()
    assert sorted(r.problem for r in ask("get_similar_solved_tasks", query="насос")) == ["банк насос 10", "насос 10"]
    assert sorted(r.problem for r in ask("get_recent_wrong_examples")) == ["насос 10", "насос 10", "попытка 10", "попытка 10"]
    assert sorted(r.title for r in ask("retrieve_learning_atoms")) == ["A1", "A2"]
    assert [r.title for r in ask("retrieve_learning_atoms", subtype="q")] == ["A2"]
    assert len(tools.call(ctx, "retrieve_learning_atoms").collect()) == 4


def test_staged_tables_can_be_read_twice_and_released(spark):
    df = stage(spark.range(10), "ten")
    assert df.count() == df.count() == 10
    path = df.inputFiles()[0].removeprefix("file://")
    release()
    assert not Path(path).exists()


def test_every_query_has_its_own_name_and_the_entry_runs(spark):
    entry = importlib.import_module("__spark_entry__")
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100
    if Path("/root/testdata/sf0.001").exists():
        assert entry.entry(spark).count() > 0


def test_the_core_stands_without_the_text_subpackage():
    code = "import sys; sys.modules['studyloom.llm'] = None\nimport importlib.util as u; f = u.find_spec\nu.find_spec = lambda n, *a: None if n.startswith('studyloom.llm') else f(n, *a)\nimport __spark_entry__ as e; q = e.queries(); assert 'p4_found' in q and 'p6_ids' not in q; e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=REPO, timeout=120).returncode == 0
    for path in (REPO / "studyloom").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert "from studyloom.llm" not in path.read_text(encoding="utf-8") and "import studyloom.llm" not in path.read_text(encoding="utf-8")
