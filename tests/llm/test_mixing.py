"""Mixing to target shares."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyloom.llm import mixing
from studyloom.llm.mixing import fit_classifier, mix_sources
from studyloom.llm.tokens import tokenizer

WORDS = {"math": "корень уравнение функция предел интеграл".split(), "chat": "привет спасибо пока ладно хорошо".split(), "rare": "олимпиада турнир кубок медаль".split(), "other": "погода дождь снег ветер".split()}


def documents(spark, n=1500, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choices(["math", "chat", "rare", "other", None], [60, 30, 2, 5, 3])[0]
        words = WORDS[source or rng.choice(list(WORDS))]
        rows.append((i, source, " ".join(rng.choice(words) for _ in range(rng.choice([5, 20, 60]))), "clash"))
    rows += [(n, "math", None, ""), (n + 1, "chat", "", ""), (n + 2, "rare", " ", "")]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, soft string").repartition(4)


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_and_repeats(spark):
    df = documents(spark)
    mix = mix_sources(df, targets(spark, [("math", 0.5, 1), ("chat", 0.3, 2), ("rare", 0.2, 4)]))
    shares = {r.source: r for r in mix.shares.collect()}
    for name, share, most in (("math", 0.5, 1), ("chat", 0.3, 2), ("rare", 0.2, 4)):
        assert shares[name].actual_share == pytest.approx(share, abs=0.005)
        assert shares[name].most_copies <= most
    taken = mix.documents.collect()
    sums = {}
    for r in taken:
        sums[r.source] = sums.get(r.source, 0) + r.n_copies * r.n_tokens
    assert len({r.doc_id for r in taken}) == len(taken) and set(sums) == {"math", "chat", "rare"}
    assert {k: v for k, v in sums.items()} == {r.source: r.n_tokens for r in shares.values()}
    assert shares["rare"].n_copies == 4 * shares["rare"].n_documents  # the scarcest is used up


def test_the_same_seed_gives_the_same_mix(spark):
    df, t = documents(spark, 300), targets(spark, [("math", 0.7, 1), ("chat", 0.3, 2)])
    one, two = (sorted(map(tuple, mix_sources(df.repartition(n), t).documents.collect())) for n in (2, 5))
    assert one == two


def test_a_listed_source_without_documents(spark):
    mix = mix_sources(documents(spark, 300), targets(spark, [("math", 0.5, 1), ("none", 0.25, 3), ("chat", 0.25, 0), (None, 0.1, 1)]))
    shares = {r.source: r for r in mix.shares.collect()}
    assert shares["none"].n_tokens == 0 and shares["chat"].n_tokens == 0
    assert shares["math"].actual_share == pytest.approx(1.0)


def test_a_smaller_size_can_be_asked_for(spark):
    mix = mix_sources(documents(spark), targets(spark, [("math", 0.5, 1), ("chat", 0.5, 1)]), total_tokens=5000)
    assert mix.documents.agg(F.sum(F.col("n_copies") * F.col("n_tokens"))).first()[0] == pytest.approx(5000, rel=0.05)


def test_nothing_to_mix(spark):
    df = documents(spark, 50)
    for docs, t in ((df.where("false"), [("math", 1.0, 1)]), (df, []), (df, [("none", 1.0, 1)])):
        mix = mix_sources(docs, targets(spark, t))
        assert mix.documents.collect() == []
        assert mix.shares.count() == len(t)


def test_classifier_on_held_out_documents(spark):
    df = documents(spark, 2000).where("source is not null and length(text) > 1")
    names = ["chat", "math", "rare"]
    c = fit_classifier(df.where("doc_id % 2 = 0"), names)
    held = df.where("doc_id % 2 = 1").select("source", "text").collect()
    encoder = tokenizer()
    likely = c.most_likely([encoder.encode(r.text) for r in held])
    assert sum([*names, "other"][p] == r.source for p, r in zip(likely, held)) / len(held) > 0.95
    assert c.posteriors([np.empty(0, np.int64)]).sum() == pytest.approx(1.0)


def test_documents_without_a_listed_source_are_scored(spark):
    df = documents(spark)
    shares = {r.source: r for r in mix_sources(df, targets(spark, [("math", 0.5, 1), ("chat", 0.5, 2)])).shares.collect()}
    unlisted = df.where("source is null").collect()
    encoder = tokenizer()
    for name in ("math", "chat"):
        own = sum(encoder.count(r.text) for r in unlisted if r.text.split() and r.text.split()[0] in WORDS[name])
        assert shares[name].unlisted_tokens == pytest.approx(own, rel=0.25)


def test_soft_membership_decides_within_a_source(spark):
    """Of two sources, half of one reads like the other; these documents are taken less often."""
    rng = random.Random(1)
    rows = [(i, "math" if i % 3 else "chat", " ".join(rng.choice(WORDS["chat" if i % 3 == 0 or i % 30 == 1 else "math"]) for _ in range(30)), "") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, soft string").repartition(3)
    mix = mix_sources(df, targets(spark, [("math", 0.6, 1), ("chat", 0.4, 1)]))
    copies = {r.doc_id: r.n_copies for r in mix.documents.collect()}
    taken = lambda like: [copies.get(i, 0) for i in range(3000) if i % 3 and (i % 30 == 1) == like]
    assert np.mean(taken(True)) < 0.5 * np.mean(taken(False))
    assert {r.source: round(r.actual_share, 2) for r in mix.shares.collect()} == {"math": 0.6, "chat": 0.4}


def test_many_domains_are_scored_alike(monkeypatch):
    rng = np.random.default_rng(3)
    feature, domain = rng.integers(0, 500, 3000), rng.integers(0, 5, 3000)
    cells = {(f, d): float(n) for f, d, n in zip(feature.tolist(), domain.tolist(), rng.integers(1, 9, 3000).tolist())}
    parts = np.array([f for f, _ in cells]), np.array([d for _, d in cells]), np.array(list(cells.values()))
    ids = [rng.integers(0, 500, n) for n in (0, 1, 7, 400)]
    one = mixing.Classifier(*parts, dict.fromkeys(range(5), 10), 500).posteriors(ids)
    monkeypatch.setattr(mixing, "DOMAINS_AT_ONCE", 2)
    monkeypatch.setattr(mixing, "AT_ONCE", 50)
    assert np.allclose(one, mixing.Classifier(*parts, dict.fromkeys(range(5), 10), 500).posteriors(ids), atol=1e-4)


def test_steps_between_jobs_cost_the_driver_no_joins(spark):
    """Every broadcast of a table of sources, and every exchange of a round, left a table and a thread on the driver."""
    df, t = documents(spark, 300), targets(spark, [("math", 0.6, 1), ("chat", 0.3, 2), ("rare", 0.1, 3)])
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()

    def executions():
        bus.waitUntilEmpty()
        found = store.executionsList()
        return {(e := found.apply(i)).executionId(): e.physicalPlanDescription() for i in range(found.size())}

    earlier = executions()
    assert mix_sources(df, t).documents.count() > 0
    plans = [p for k, p in executions().items() if k not in earlier]
    rounds = [p for p in plans if "sums" in p]
    assert not [p for p in plans if "Broadcast" in p and "Exchange" in p.partition("Broadcast")[2]]
    assert len(rounds) > 1 and not [p for p in rounds if "Exchange" in p]


def test_a_long_document_leaves_no_gap(spark):
    """What a source's longest documents leave open is filled by shorter ones, for each source by its own threshold."""
    rows = [(i, "math" if i % 2 else "chat", " ".join(WORDS["math" if i % 2 else "chat"][:1] * (400 if i < 20 else 3)), "") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, soft string").repartition(3)
    shares = {r.source: r for r in mix_sources(df, targets(spark, [("math", 0.7, 1), ("chat", 0.3, 1), ("none", 0.0, 1)])).shares.collect()}
    assert shares["math"].actual_share == pytest.approx(0.7, abs=0.002) and shares["chat"].actual_share == pytest.approx(0.3, abs=0.002)
    assert shares["none"].n_copies == 0
