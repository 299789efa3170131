"""Truncated texts, on texts cut here."""

from __future__ import annotations

import random

import numpy as np
import pytest

from studyloom.llm.truncation import Ending, fit_censored, truncated_rows, truncation_report

SENTENCES = (
    "Первая труба наполняет бассейн за {} часов.", "Вторая труба работает на {} минут дольше.", "Найдите общее время работы обеих труб в часах.", "Ответ округлите до целого числа.",
    "Пароход прошёл {} километров против течения и вернулся обратно.", "Скорость течения равна {} километрам в час.", "Сколько минут занял весь путь?", "Известно, что остановок по дороге не было.",
)
TITLES = ("Сборник задач, вариант {}", "Движение по воде, урок {}", "Контрольная работа номер {} для класса")


def corpus(seed=1, n=6000):
    rng = random.Random(seed)
    rows, truth = [], set()
    for i in range(n):
        source = rng.choice(["clean", "limited", "broken", "clean2"])
        if rng.random() < 0.2:
            text = rng.choice(TITLES).format(rng.randrange(1, 40))
        else:
            text = " ".join(rng.choice(SENTENCES).format(rng.randrange(2, 90)) for _ in range(rng.randrange(2, 9)))
        whole = text
        if source == "limited":
            text = text[:150]
        elif source == "broken" and rng.random() < 0.3:
            text = text[: rng.randrange(15, max(16, len(text)))]
        if text != whole and not text.rstrip().endswith((".", "?")):
            truth.add(i)
        rows.append((i, source, text, "clash"))
    rows += [(n, "clean", None, ""), (n + 1, None, "", ""), (n + 2, None, "Найдите общее время работы обеих труб в часах.", "")]
    return rows, truth


@pytest.fixture(scope="module")
def made(spark):
    rows, truth = corpus()
    return spark.createDataFrame(rows, "rec_id long, channel string, task_text string, source string").repartition(4).cache(), truth


def test_cut_texts_are_found(made):
    df, truth = made
    found = {r.rec_id for r in truncated_rows(df, "rec_id", "channel", "task_text").collect()}
    assert len(found & truth) / len(found) > 0.97
    assert len(found & truth) / len(truth) > 0.97


def test_report_names_the_limit(made):
    df, truth = made
    rows = {r.source: r for r in truncation_report(df, "channel", "task_text").collect()}
    assert 150 in rows["limited"].char_limits and rows["clean"].char_limits == []
    assert rows["clean"].share < 0.01 and rows["limited"].share > 0.3
    assert rows[None].n_rows == 2 and rows[None].n_texts_seen == 1
    assert sum(r.n_rows for r in rows.values()) == df.count()


def test_empty_table_and_no_texts(spark):
    schema = "rec_id long, channel string, task_text string"
    for rows in ([], [(1, "a", None), (2, None, "")]):
        df = spark.createDataFrame(rows, schema)
        assert truncated_rows(df, "rec_id", "channel", "task_text").collect() == []
        assert truncation_report(df, "channel", "task_text").count() == len({r[1] for r in rows})


def test_repeated_rows_and_very_long_texts(spark):
    text = "Найдите сумму. " * 20_000
    df = spark.createDataFrame([(1, "a", text), (2, "a", text), (3, "a", text + "Найдите $x^2")], "rec_id long, channel string, task_text string")
    assert {r.rec_id for r in truncated_rows(df, "rec_id", "channel", "task_text").collect()} == {3}


@pytest.mark.parametrize(
    ("text", "state"),
    [
        ("Найдите корень.", 0), ("Сколько часов?", 0), ("Ряд: 1, 2, 3, …", 0), ("Конец. [...]", 0), ("Конец. (далее см. файл)", 0), ("<p>Конец.</p>", 0), ("Конец. <su", 0), ("", 0),
        ("Найдите $x^2", 2), ("выехал из горо�", 2), ("Скорость,", 2), ("Отбор -", 2), ("выехал из горо", 1), ("на всём…", 1), ("и [...]", 1), ("вклад на 5 тыс.", 1), ("Задача 3.", 0), ("Сборник. 3.", 1), ("дро<su", 1), ("дро&nb", 1),
    ],
)
def test_endings(text, state):
    assert Ending(text).state == state


def test_censored_fit_recovers_the_distribution():
    rng = np.random.default_rng(1)
    true = np.maximum(1, np.rint(np.exp(rng.normal(5.0, 0.5, 40_000)))).astype(int)
    lengths, counts = np.unique(np.minimum(true, 180), return_counts=True)
    mean, spread = fit_censored(lengths, counts, np.array([180]))
    assert mean == pytest.approx(5.0, abs=0.03) and spread == pytest.approx(0.5, abs=0.03)
