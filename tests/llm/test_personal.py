"""Personal data: where it stands, and what replaces it."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from studyloom.llm import name_model
from studyloom.llm.name_model import fit_on_runs, fit_on_texts, names_in_runs
from studyloom.llm.names import ENGLISH_FEMALE, ENGLISH_MALE, FEMALE, MALE
from studyloom.llm.personal import _spans, find_items, read_texts, reading_form
from studyloom.llm.surrogates import drawn, drawn_words, open_words, permuted_digits, personal_items, redact, redact_texts, replacement, surrogate_items

KEY = b"test"


def items(text):
    return [(i.kind, text[i.start : i.end]) for i in find_items(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("пиши на ivan.petrov+a@mail.example!", [("email", "ivan.petrov+a@mail.example")]),
        ("[почта](mailto:a.b @ c.test)", [("email", "a.b @ c.test")]),
        ("ivan(at)mail(dot)example", [("email", "ivan(at)mail(dot)example")]),
        ("ivan собака mail точка example", [("email", "ivan собака mail точка example")]),
        ("лол 33@5 и @bot", []),
        ("тел. +7 (927) 123-45-67.", [("phone", "7 (927) 123-45-67")]),
        ("звони 8-927-123-45-67", [("phone", "8-927-123-45-67")]),
        ("номер (927) 123 4567", [("phone", "927) 123 4567")]),
        ("+7 (206)\n588-63-74", [("phone", "7 (206)\n588-63-74")]),
        ("call +44 7700 900205 or 555-555-0147", [("phone", "44 7700 900205"), ("phone", "555-555-0147")]),
        ("Ответ 88080808019? Штрихкод 469901199512, ряд 10 20 30 40 50 60 70", []),
        ("ISBN 978-5-0000-63-4, код 69-13-69, заявка № 77150077", []),
        ("снилс для договора 112-233-445 95", [("id_number", "112-233-445 95")]),
        ("inn:500100732259 snils:11223344595", [("id_number", "500100732259"), ("id_number", "11223344595")]),
        ("паспорт серия 45 08 № 123456, выдан", [("id_number", "45 08 № 123456")]),
        ("Свидетельство о рождении II-АЛ № 504182", [("id_number", "II-АЛ № 504182")]),
        ("Anna Petrova, SSN 666-12-3456.", [("name", "Anna Petrova"), ("id_number", "666-12-3456")]),
        ("адрес: 101000, г. Москва, ул. Мира, д. 5, кв. 7. Далее", [("address", "101000, г. Москва, ул. Мира, д. 5, кв. 7")]),
        ("живу в переулке рядом, ул. Лесной, д. 5", [("address", "ул. Лесной, д. 5")]),
        ("на проспекте Старой Мельницы 6, можно?", [("address", "проспекте Старой Мельницы 6")]),
        ("По улице Лесной едет 5 машин, прошёл по проспекту туда за 6 минут", []),
        ("We live at Flat 35, 342 Quill Lane.", [("address", "Flat 35, 342 Quill Lane")]),
        ("С уважением, Иванова Анна Петровна, и Пётр", [("name", "Иванова Анна Петровна")]),
        ("для Иванова Петра и Анны Сидоровой-Козловой", [("name", "Иванова Петра"), ("name", "Анны Сидоровой-Козловой")]),
        ("ИВАНОВ ПЁТР; анна сидорова; Иванов П. С.; П.С. Иванову; И. Смирнов", [("name", "ИВАНОВ ПЁТР"), ("name", "анна сидорова"), ("name", "Иванов П. С."), ("name", "П.С. Иванову"), ("name", "И. Смирнов")]),
        ("Добрый день, Вера Павловна!", [("name", "Вера Павловна")]),
        ("My name is Ivanova, Anna, and Roman T. Petrov", [("name", "Ivanova, Anna"), ("name", "Roman T. Petrov")]),
        ("Петя и Катя решили, лемма Иванова не нужна, Марина из 11Б. Это Т.З.", []),
        (None, []),
        ("", []),
    ],
)
def test_items(text, want):
    assert items(text or "") == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Пишет Коваленко Анна, потом Коваленко А. Б.", ["Коваленко Анна", "Коваленко А. Б."]),
        ("А. Б. Коваленко; АННА КОВАЛЕНКО; КОВАЛЕНКО АННА", ["А. Б. Коваленко", "АННА КОВАЛЕНКО", "КОВАЛЕНКО АННА"]),
        ("Шмидт Анна", ["Шмидт Анна"]),
        ("Сдала Анна Шмидт и Шмидт А. Б.", ["Анна Шмидт", "Шмидт А. Б."]),
        ("мы с John Smith решили, и Mary J. Jones тоже", ["John Smith", "Mary J. Jones"]),
        ("от Шмидт Анны Петровны", ["Шмидт Анны Петровны"]),
        ("Ученик Анна Петрова. Сегодня Анна решила. Только Анна. Привет Анна! Анна Решите. Это Т.З. Отрезок А. Б. дан", ["Анна Петрова"]),
        ("Найдите А. Б. по рисунку. Анна\nЗадача", []),
    ],
)
def test_surnames_without_a_telling_ending(text, want):
    assert [t for kind, t in items(text) if kind == "name"] == want
    found = find_items(text)
    out = redact(text, found, KEY, words_of(found))
    assert not any(w in out for w in ("Коваленко", "КОВАЛЕНКО", "Шмидт", "Smith", "Jones"))


def test_positions_count_code_points_of_the_original():
    text = "﻿😀 й тел. +7 927 123‑45‑67"
    (item,) = find_items(text)
    assert text[item.start :].startswith("7 927") and item.end == len(text)


def test_digits_are_permuted():
    assert len({permuted_digits(KEY, f"{i:03d}") for i in range(1000)}) == 1000
    assert sorted(permuted_digits(KEY, str(i)) for i in range(10)) == [str(i) for i in range(10)]
    assert not any(permuted_digits(KEY, t) == t for n in (1, 2, 3, 4) for t in (f"{i:0{n}d}" for i in range(10**n)))
    assert permuted_digits(KEY, "12345") != permuted_digits(b"other", "12345")


def words_of(found):
    return {w: drawn(KEY, w, 0) for i in found for w in open_words(i)}


def test_replacements_keep_form_gender_and_identity():
    text = "Иванова Анна Петровна, для Ивановой Анны, Иванов П., АННА ИВАНОВА, Anna Ivanova, +7 (927) 123-45-67, 89271234567, ул. Лесная, д. 5"
    found = find_items(text)
    new = [replacement(i, KEY, words_of(found)) for i in found]
    stem = re.match(r"(\w+)ова ", new[0]).group(1)
    assert new[0].endswith("овна") and new[1].startswith(stem + "овой ") and new[2].startswith(stem + "ов ")
    assert new[3].isupper() and new[3].lower().endswith(stem.lower() + "ова")
    assert new[4].isascii() and re.fullmatch(r"[A-Z][a-z]+ [A-Z][a-z]+ova", new[4])
    assert re.fullmatch(r"7 \(\d{3}\) \d{3}-\d{2}-\d{2}", new[5]) and re.sub(r"\D", "", new[5])[1:] == new[6][1:]
    assert re.fullmatch(r"ул\. [А-Я]\w+ая, д\. \d", new[7])
    out = redact(text, found, KEY, words_of(found))
    assert "Иванов" not in out and "927" not in out and out.startswith("[NAME ") and "[PHONE" in out and "[ADDRESS" in out


def test_drawn_words_never_collide(spark):
    words = ["аба", "x1", *(f"слово{c}" for c in "абвгдежзиклмнопрстуф")]
    df = spark.createDataFrame([(w,) for w in words * 2], "word string")
    # At first all draw one of three words, one of them an original; later attempts spread.
    got = {r.word: r.drawn for r in drawn_words(df, KEY, lambda key, w, n: ["аба", "y", "z"][len(w) % 3] if n == 0 else f"{w}{n}").collect()}
    assert set(got) == set(words) and len(set(got.values())) == len(words) and not set(got.values()) & set(words)


def test_tables(spark):
    rng = random.Random(3)
    names = ["Иванова Анна", "Петров Пётр Иванович", "Anna Petrova"]
    rows = [(i, f"Пишет {rng.choice(names)}, тел. 8 927 123 45 {i % 90 + 10}, задача {i}.", "x") for i in range(200)] + [(200, None, "x"), (201, "", "x"), (202, "без данных", "x"), (203, "слово " * 60_000 + "Иванова Анна", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string").repartition(3)
    found = personal_items(df, "doc_id", "text", KEY).collect()
    texts = {r[0]: r[1] for r in rows}
    assert len(found) == 401 and all(texts[r.doc_id][r.start_pos].isalnum() for r in found)
    out = {r.doc_id: r for r in redact_texts(df, "doc_id", "text", KEY).collect()}
    assert out[200].text is None and out[201].text == "" and out[202].text == "без данных" and out[0].n_items == 2
    assert all(f"задача {i}." in out[i].text and "8 927 123" not in out[i].text and "Пишет [NAME " in out[i].text for i in range(200))
    by_name = {}
    for i in range(200):
        original, new = re.search(r"Пишет (.*?), тел", texts[i]).group(1), re.search(r"\[NAME (.*?)\]", out[i].text).group(1)
        assert by_name.setdefault(original, new) == new
    assert len(set(by_name.values())) == 3
    assert personal_items(df.where("false"), "doc_id", "text", KEY).collect() == [] and redact_texts(df.where("false"), "doc_id", "text", KEY).collect() == []


def letters(text):
    return {w for w in re.findall(r"[^\W\d_]+", text.lower().replace("ё", "е"))}


@pytest.mark.parametrize(
    "text",
    [
        "My name is John Smith",
        "My name is Michael Johnson, we met Emma Brown and Mary J. Jones",
        "Student: Priya Sharma. Tutor: Mohammed Ali",
        "Пишет Коваленко Анна, Шмидт А. Б., Лев Щукин и Игорь Ёлкин, Любовь Цой",
        "Лев Иванов, ИГОРЬ ПЕТРОВ, Й. Щ. Сидоров, анна сидорова",
        "a.smith@mail.example, тел. 8 927 123-45-67, Свидетельство о рождении II-АЛ № 504182, 101000, г. Москва, ул. Мира, д. 5, кв. 0",
    ],
)
def test_no_part_of_an_item_is_left(text):
    found = find_items(text)
    assert found
    words = words_of(found)
    for item in found:
        new = replacement(item, KEY, words)
        kept = letters(item.text) & letters(new)
        assert not {w for w in kept if item.kind == "name" or len(w) > 3 and w not in ("example",)}, (item, new)
        assert not {d for d in re.findall(r"\d{2,}", item.text) if item.kind != "phone" and d in re.findall(r"\d+", new)}, (item, new)


def test_every_listed_name_is_replaced():
    for name in {*MALE, *FEMALE, *ENGLISH_MALE, *ENGLISH_FEMALE}:
        word = name.capitalize()
        (item,) = [i for i in find_items(f"{word} Smithson" if word.isascii() else f"{word} Иванов") if i.kind == "name"]
        assert word.lower().replace("ё", "е") not in replacement(item, KEY, words_of([item])).lower().split(), word


def test_domains_are_drawn_without_collisions():
    (item,) = find_items("пиши на ivan@mail.example")
    assert open_words(item) == ["ivan", "mail.example"]
    assert replacement(item, KEY, {"ivan": "bakod", "mail.example": "zunep"}) == "bakod@zunep.example"


def test_redacted_documents_hold_no_item(spark):
    """Outside placeholders the text is what it was; inside, no word of the item but for types of streets and the like."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    out = {r.doc_id: r.text for r in redact_texts(df, "doc_id", "text", KEY).collect()}
    found = {}
    for r in surrogate_items(df, "doc_id", "text", KEY).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert set(out) == set(texts) and found
    for doc, items in found.items():
        at, pattern = 0, []
        for r in sorted(items, key=lambda r: r.start_pos):
            pattern += [re.escape(texts[doc][at : r.start_pos]), rf"\[{r.kind.upper()} (.*?)\]"]
            at = r.end_pos
        assert (m := re.fullmatch("".join(pattern) + re.escape(texts[doc][at:]), out[doc], re.S)), doc
        for r, new in zip(sorted(items, key=lambda r: r.start_pos), m.groups()):
            if r.kind == "name":
                assert not {w for w in letters(texts[doc][r.start_pos : r.end_pos]) & letters(new) if len(w) > 1}
    assert all(out[k] == t for k, t in texts.items() if k not in found)


def test_names_outside_the_lists():
    """The classifier learns from what the rules find, and finds names that it has never seen."""
    rng = random.Random(4)
    given_names, ends = ["Анна", "Мария", "Пётр", "Иван", "Олег", "Ирина"], ["ов", "ев", "ин", "ова", "ина"]
    made = lambda: "".join(rng.choice("БВГДКЛМНПРСТ") + rng.choice("аеио") for _ in range(1)) + "".join(rng.choice("бвгдклмнпрст") + rng.choice("аеиоу") for _ in range(2)) + rng.choice("вдлнрт")
    around = ["Пишет {}, мама ученика.", "С уважением, {}", "Звонила {} вчера.", "Репетитор: {}, тел. нет"]
    places = ["Едем в Тихие Дюны завтра.", "Кружок «Осенний Марафон» открыт.", "Город Малая Полынная рядом.", "Станция Озёрная Гать закрыта."]
    texts = [rng.choice(around).format(f"{rng.choice(given_names)} {made() + rng.choice(ends)}") for _ in range(400)] + [rng.choice(places) for _ in range(300)]
    model = fit_on_texts([reading_form(t).view for t in texts], _spans)
    unseen = [(w, f"{w} {made() + rng.choice(ends)}") for w in ("Нурсултан", "Гульнара", "Мухаммад", "Айгерим") for _ in range(25)]
    hits = sum([(i.kind, i.text) for i in find_items(rng.choice(around).format(name), model)] == [("name", name)] for _, name in unseen)
    assert hits >= 90
    assert not any(find_items(t, model) for t in places)


def texts_with_names(n, seed=5):
    """Texts that the rules label, and names outside the lists."""
    rng = random.Random(seed)
    made = lambda: rng.choice("БВГДКЛМНПРСТ") + rng.choice("аеио") + "".join(rng.choice("бвгдклмнпрст") + rng.choice("аеиоу") for _ in range(2)) + rng.choice("вдлнрт") + rng.choice(["ов", "ев", "ин", "ова", "ина"])
    around = ["Пишет {}, мама ученика.", "С уважением, {}", "Звонила {} вчера.", "Репетитор: {}, тел. нет"]
    given_names = [w.capitalize() for w in sorted([*MALE, *FEMALE])[::3]]
    others = ["Едем в Тихие Дюны завтра.", "Кружок «Осенний Марафон» открыт.", "Город Малая Полынная рядом.", "Станция Озёрная Гать закрыта.", "Тихие дюны. Осенний Марафон Идёт", "Почта a.b@mail.example, Вера Павловна Сидорова"]
    return [rng.choice(around).format(f"{rng.choice(given_names)} {made()}") for _ in range(n)] + [rng.choice(others) for _ in range(n)], [rng.choice(around).format(f"{w} {made()}") for w in ("Нурсултан", "Гульнара", "Мухаммад", "Айгерим") for _ in range(10)]


def test_long_texts_teach_names_too(spark):
    """A sample of texts of at most 4,000 characters once decided which names the classifier knows."""
    known, unseen = texts_with_names(300)
    rows = [(i, "слово " * 700 + "\n" + t) for i, t in enumerate(known + unseen[::4])]
    found = personal_items(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", KEY).collect()
    assert len({r.doc_id for r in found if r.doc_id >= len(known) and r.kind == "name"}) >= 7
    assert all(rows[r.doc_id][1][r.start_pos].isupper() for r in found if r.kind == "name")


def test_the_fit_over_a_table_is_that_over_its_texts(spark):
    known, unseen = texts_with_names(200)
    # Nothing is left out in a table of many texts: each copy counts as in a list.
    texts = known * 2 + known[:50] * 30
    one = fit_on_texts([reading_form(t).view for t in texts], _spans)
    read = read_texts(spark.createDataFrame(list(enumerate(texts)), "key long, text string").repartition(5)).persist()
    all_ = fit_on_runs(read)
    assert abs(one.weights - all_.weights).max() < 1e-3 and abs(one.bias - all_.bias) < 1e-3 and abs(one.threshold - all_.threshold) < 3e-3
    table = read_texts(spark.createDataFrame(list(enumerate(unseen)), "key long, text string"))
    got = {(r.key, r.start_pos, r.end_pos) for r in table.where("run is not null").select("key", "run").mapInArrow(names_in_runs(all_), "key long, kind string, start_pos int, end_pos int, item string").collect()}
    assert got == {(k, i.start, i.end) for k, t in enumerate(unseen) for i in find_items(t, all_) if i.kind == "name"} and len(got) >= 36


def test_rows_are_fitted_a_chunk_at_a_time(monkeypatch):
    rng = random.Random(6)
    rows = [{"spelling": [rng.randrange(50)], "general": [60 + (i % 3)], "around": [70 + i % 2, 90 + rng.randrange(9)], "label": i % 2, "weight": 1.0, "n": 1, "fit": i // 650} for i in range(950)]
    batches = pa.Table.from_pylist(rows).to_batches(max_chunksize=300)
    for size in (10_000, 100):
        monkeypatch.setattr(name_model, "CHUNK_ROWS", size)
        assert [t.num_rows for t in name_model._in_chunks(iter(batches))] == ([650, 300] if size > 950 else [100] * 6 + [50] + [100] * 3)
        fits = [(b.column(0)[0].as_py(), np.frombuffer(b.column(1)[0].as_py())) for b in name_model._fit_rows(iter(batches))]
        assert [fit for fit, _ in fits] == [0, 1]
        assert all(weights[71] > 1 and weights[70] < -1 and abs(weights[60:63]).max() < 1 for _, weights in fits)


def test_small_words_count_in_every_text():
    words = ["дом", "д", "Дом", "x1", "по-русски", "ёлка.", "(кот)", "iPhone"]
    assert name_model.small_words([" ".join(words[:4]), "\n".join(words[4:])]) == {name_model.word_hash(w) for w in ("дом", "по", "русски", "елка", "кот")}
