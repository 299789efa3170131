"""The knowledge graph and ranking, against sequential versions on small random graphs."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from studyloom.config import DEFAULT
from studyloom.operators import evaluation as E
from studyloom.operators import graph as G
from studyloom.operators import retrieval as V

N = 24


@pytest.fixture(scope="module")
def world():
    rng = random.Random(7)
    atoms = []
    for i in range(N):
        pre = sorted(rng.sample(range(i), min(i, rng.randrange(3))))
        tags = [f"t{j}" for j in sorted(rng.sample(range(8), rng.randrange(3)))]
        atoms.append((f"a{i:02d}", f"T{i}", "x", rng.choice([6, 10, 12]), [f"s{j}" for j in sorted(rng.sample(range(4), rng.randrange(3)))], tags, [f"a{p:02d}" for p in pre], ["k"] if i % 4 == 0 else [], i))
    scores = {s: {f"t{j}": round(rng.random() * 1.2, 3) for j in range(8) if rng.random() < 0.7} for s in ("p", "q")}
    base = {s: {f"a{i:02d}": round(rng.random() / 5, 4) for i in rng.sample(range(N), 16)} for s in ("p", "q")}
    return atoms, scores, base


@pytest.fixture(scope="module")
def frames(spark, world):
    atoms, scores, base = world
    schema = "id string, title string, text string, task_number int, subtypes array<string>, error_tags array<string>, prerequisites array<string>, shared_skills array<string>, ord int"
    long = lambda d, c: spark.createDataFrame([(s, k, v) for s, x in d.items() for k, v in x.items()], f"student_id string, {c} string, score double")
    return spark.createDataFrame(atoms, schema), long(scores, "tag"), long(base, "atom")


def weak(world, student):
    atoms, scores, _ = world
    return {a[0]: sum(scores[student].get(t, 0) for t in a[5]) / max(1, len(a[5])) for a in atoms}


def deps(atoms, aid):
    return [a[0] for a in atoms if aid in a[6]]


def hops(atoms, aid, depth):
    by = {a[0]: a for a in atoms}
    seen, level, out = {aid}, [aid], []
    for _ in range(depth):
        level = sorted({p for x in level for p in by[x][6] if p not in seen}, key=lambda p: by[p][8])
        out += level
        seen |= set(level)
    return out


def test_weakness_and_prediction(world, frames):
    atoms, scores, _ = frames
    w = G.atom_weakness(scores, atoms)
    for student in ("p", "q"):
        want = {k: v for k, v in weak(world, student).items() if v > 0}
        assert {r.atom: r.weakness for r in w.where(F.col("student_id") == student).collect()} == pytest.approx(want)
    got = {(r.student_id, r.atom): r.predicted for r in G.predicted_weakness(w, atoms).collect()}
    for (student, atom), value in got.items():
        own = weak(world, student)[atom]
        total, seen, queue = own, {atom}, [(atom, 0, own)]
        while queue:
            a, d, x = queue.pop(0)
            for child in deps(world[0], a) if d < 2 else ():
                if child not in seen:
                    seen.add(child)
                    total += x * 0.7
                    queue.append((child, d + 1, x * 0.7))
        assert value == pytest.approx(total)


def test_frontier_is_the_greedy_choice(world, frames):
    atoms, scores, _ = frames
    w = G.atom_weakness(scores, atoms)
    predicted = {(r.student_id, r.atom): r.predicted for r in G.predicted_weakness(w, atoms).collect()}
    got = G.frontier(w, atoms, 5).orderBy("student_id", "place").collect()
    for student in ("p", "q"):
        own = weak(world, student)
        ranked = sorted(((own[a[0]] + 0.15 * predicted[student, a[0]] - 0.5 * (sum(own[p] for p in a[6]) / len(a[6]) if a[6] else 0), -a[8], a) for a in world[0] if own[a[0]] >= 0.2), reverse=True)
        taken, per = [], {}
        for _, _, a in ranked:
            if len(taken) < 5 and per.get(a[3], 0) < 2:
                taken.append(a[0])
                per[a[3]] = per.get(a[3], 0) + 1
        assert [r.atom for r in got if r.student_id == student] == taken


def test_expansion_folds_in_order(world, frames):
    atoms, scores, base = frames
    got = {(r.student_id, r.atom): r.score for r in V.expand(base, atoms, G.atom_weakness(scores, atoms), 12).collect()}
    by = {a[0]: a for a in world[0]}
    for student, start in world[2].items():
        own, s = weak(world, student), dict(start)
        for parent in sorted(start, key=lambda a: (-start[a], by[a][8]))[:12]:
            for p in hops(world[0], parent, 2):
                bonus = DEFAULT.prereq_bonus * (1 + own[p]) + DEFAULT.prereq_tag_bonus * len(by[p][5])
                s[p] = max(s.get(p, -math.inf), s[parent] + bonus)
            for d in deps(world[0], parent):
                s[d] = max(s.get(d, -math.inf), s[parent] + DEFAULT.dependent_bonus)
        assert {a: v for (st, a), v in got.items() if st == student} == pytest.approx(s)


def test_diversity_is_the_greedy_choice(world, frames):
    atoms, _, base = frames
    got = V.diverse(base, atoms, 6).orderBy("student_id", "place").collect()
    by = {a[0]: a for a in world[0]}
    for student, start in world[2].items():
        left = sorted(start, key=lambda a: (-start[a], by[a][8]))[:12]
        low, high = min(start[a] for a in left), max(start[a] for a in left)
        like = lambda a, b: len(set(by[a][4]) & set(by[b][4])) / len(set(by[a][4]) | set(by[b][4])) if by[a][4] or by[b][4] else 0.0
        chosen = []
        while len(chosen) < 6:
            best = max((a for a in left if a not in chosen), key=lambda a: (round(0.6 * (start[a] - low) / (high - low) - 0.4 * max([0.0, *(like(a, c) for c in chosen)]), 12), -left.index(a)))
            chosen.append(best)
        assert [r.atom for r in got if r.student_id == student] == chosen


def test_few_candidates_are_kept_as_they_are(frames):
    atoms, _, base = frames
    some = base.where("atom < 'a06'")
    assert V.diverse(some, atoms, 12).count() == some.count()


def test_prerequisites_come_first(world, frames):
    atoms, scores, base = frames
    best = V.best_atoms(base, atoms, 16).select("student_id", "atom", "place")
    by = {a[0]: a for a in world[0]}
    rows = G.learning_order(best, atoms, "student_id").collect()
    for student in ("p", "q"):
        place = {r.atom: r.place for r in rows if r.student_id == student}
        assert sorted(place.values()) == list(range(1, len(place) + 1))
        assert all(place[p] < n for a, n in place.items() for p in by[a][6] if p in place)
    skills = base.select("student_id", F.lit("k").alias("skill"), F.lit(0.5).alias("score")).distinct()
    out = V.retrieve(base, atoms, scores, skills, G.atom_weakness(scores, atoms), 5)
    assert out.groupBy("student_id").count().where("count <> 5").isEmpty()


def test_block_search_is_exact(spark, monkeypatch):
    rng = random.Random(1)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)], i % 3) for i in range(300)] + [(300, None, 0), (301, [], 1)]
    df = spark.createDataFrame(vectors, "id long, v array<float>, g int").repartition(5)
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    monkeypatch.setattr(V, "DOCUMENT_BLOCK", 40)
    got = {(r.query_id, r.place): r.doc_id for r in V.dense_topk(df.where("id % 50 = 0"), df, "id", "v", 4, ["g"]).collect()}
    rows = {r.id: (r.v, r.g) for r in df.collect() if r.v}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    for q in range(0, 300, 50):
        best = sorted(((-round(cos(rows[q][0], v), 9), d) for d, (v, g) in rows.items() if d != q and g == rows[q][1]))[:4]
        assert [got[q, i + 1] for i in range(4)] == [d for _, d in best]


def test_metrics_of_one_query(spark):
    ranked = spark.createDataFrame([(1, d, i + 1) for i, d in enumerate("abcde")] + [(9, "a", 1)], "query_id long, doc_id string, place int")
    relevant = spark.createDataFrame([(1, "b"), (1, "d"), (1, "z"), (1, "z"), (2, "a")], "query_id long, doc_id string")
    got = {(r.query_id, r.k): r for r in E.ir_metrics(ranked, relevant).collect()}
    r = got[1, 5]
    assert (r.precision, r.recall, r.hit, r.mrr) == (2 / 5, pytest.approx(2 / 3), 1.0, 0.5)
    assert r.map == pytest.approx((1 / 2 + 2 / 4) / 3)
    assert r.ndcg == pytest.approx((1 / math.log2(3) + 1 / math.log2(5)) / (1 + 1 / math.log2(3) + 1 / 2))
    assert got[1, 10].precision == 2 / 10 and got[2, 1].map == 0.0 and (9, 1) not in got


def test_tasks_without_a_match_are_linked_to_all(spark):
    atoms = spark.createDataFrame([("a", 13, ["x"]), ("b", 13, []), ("c", 13, ["none"]), ("d", 13, ["wide", "x"]), ("e", 16, ["x"])], "id string, task_number int, subtypes array<string>")
    tasks = spark.createDataFrame([("1", 13, "x"), ("2", 13, "y"), ("", 13, "x"), (None, 13, "x")], "task_id string, task_number int, subtype string")
    got = sorted(map(tuple, G.label_tasks(atoms, tasks, {13: ("wide",)}).collect()))
    assert got == [("a", "1"), ("b", "1"), ("b", "2"), ("c", "1"), ("c", "2"), ("d", "1"), ("d", "2")]


def test_scores_snap_to_the_lower_of_two(spark):
    df = spark.createDataFrame([(x,) for x in (0.1, 0.125, 0.3, 0.375, 0.9, -1.0, 7.0)], "x double")
    assert [r[0] for r in df.select(E.snap_score(F.col("x"))).collect()] == [0.0, 0.0, 0.25, 0.25, 1.0, 0.0, 1.0]


def test_the_pipeline_begins_with_the_learners_queries(spark):
    """Atoms that hold the words of a learner's queries are candidates, whatever their task; ranks of each query add up."""
    from pathlib import Path

    from studyloom.plans import retrieval_queries as R
    from studyloom.plans.tables import table
    from studyloom.plans.text_queries import query_set

    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no test tables")
    words = lambda t: [w for w in re.findall(r"[a-zа-яё0-9]+", t.lower()) if len(w) > 1]
    atoms = table(spark, folder, "atoms").collect()
    asked = query_set(spark, folder).collect()
    texts, queries = {a.ord: words(f"{a.title}\n{a.text}") for a in atoms}, {r.query: words(r.query) for r in asked}

    def weights(bags):
        mean = sum(map(len, bags.values())) / len(bags)
        return {k: {w: n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(b) / mean)) for w, n in Counter(b).items()} for k, b in bags.items()}

    q, d, want = weights(queries), weights(texts), {}
    ids = {a.ord: a.id for a in atoms}
    ranked = {t: sorted((-round(sum(w * d[o][x] for x, w in own.items() if x in d[o]), 9), o) for o in d if own.keys() & d[o].keys())[:48] for t, own in q.items()}
    for r in asked:
        for place, (_, o) in enumerate(ranked[r.query], 1):
            want[r.student_id, ids[o]] = want.get((r.student_id, ids[o]), 0) + 1 / (10 + place)
    got = {(r.student_id, r.atom): r.score for r in R._searched(spark, folder).collect()}
    assert got.keys() == want.keys() and got == pytest.approx(want)
    out = {r.student_id for r in R.retrieve_pipeline(spark, folder).collect()}
    assert out == {s for s, _ in want}
