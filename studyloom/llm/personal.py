"""Personal data in free text: where it stands, and what replaces it.

Kinds are ``email``, ``phone``, ``id_number``, ``address`` and ``name``. Text is read in a form
without invisible characters, composed letter by letter, with one kind of hyphen and blank;
positions refer to the code points of the original.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from studyloom.llm.name_model import FoundPlace, NameModel, fit_on_runs, label_of, names_in_runs, places, small_words, word_hash
from studyloom.llm.names import parts

KINDS = ("email", "phone", "id_number", "address", "name")


class Item(NamedTuple):
    """One item; ``start`` is the position of its first letter or digit, ``end`` is past its last character."""

    kind: str
    start: int
    end: int
    text: str


# --- reading form ---

_DASHES = "‐‑‒–−﹣"
_ODD = regex.compile(r"[^\x00-\x7Fа-яА-ЯёЁ№«»—–−…°‐‑‒﹣]")


@lru_cache(maxsize=10_000)
def _plain_form(c: str) -> str | None:
    """What a character is read as: nothing if it is invisible, None for a mark that joins the letter before it."""
    category = unicodedata.category(c)
    if category == "Cf":
        return ""
    if category == "Mn":
        return None
    plain = " " if category == "Zs" else unicodedata.normalize("NFKC", c) if category in ("Nd", "Lu", "Ll") else c
    return plain if len(plain) == 1 else c


class Reading(NamedTuple):
    """The text to search, and how its positions go back: from each of ``places`` on, ``shifts`` more."""

    view: str
    places: list[int]
    shifts: list[int]

    def original(self, at: int) -> int:
        return at + self.shifts[bisect_right(self.places, at) - 1] if self.places else at


def reading_form(text: str) -> Reading:
    """The text without invisible characters, composed letter by letter, with one kind of hyphen and blank."""
    for dash in _DASHES:
        if dash in text:
            text = text.replace(dash, "-")
    if text.isascii():
        return Reading(text, [], [])
    out: list[str] = []
    places, shifts, done, size = [0], [0], 0, 0

    def keep(piece: str) -> None:
        nonlocal size
        if piece:
            out.append(piece)
            size += len(piece)

    for m in _ODD.finditer(text):
        at = m.start()
        keep(text[done:at])
        done = at + 1
        plain = _plain_form(m.group())
        if plain is None and out:
            joined = unicodedata.normalize("NFC", out[-1][-1] + m.group())
            if len(joined) == 1:
                out[-1] = out[-1][:-1] + joined
        elif plain != "":
            keep(m.group() if plain is None else plain)
            continue
        places.append(size)
        shifts.append(at + 1 - size)
    if not done:
        return Reading(text, [], [])
    keep(text[done:])
    return Reading("".join(out), places, shifts)


# --- email ---

_B = r"[^\S\r\n]"
_AT = rf"(?:{_B}*@{_B}*|{_B}*[(\[{{]{_B}*(?i:at|собака|эт){_B}*[)\]}}]{_B}*|{_B}+(?i:собака){_B}+)"
_DOT = rf"(?:\.|{_B}*[(\[{{]{_B}*(?i:dot|точка){_B}*[)\]}}]{_B}*|{_B}+(?i:точка|dot){_B}+)"
_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?"
EMAIL = regex.compile(rf"(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}._%+-]*+(?<=[\p{{L}}\p{{N}}_]){_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}\p{{L}}[\p{{L}}\p{{N}}-]+")
_AT_HINT = re.compile(r"[(\[{]\s*(?:[aA][tT]|[эЭ][тТ]|[сС][оО][бБ][аА][кК][аА])\s*[)\]}]")

# --- numbers of identity ---

_GAP = r"(?:\s{1,3}|[-:#№.=|]|\s?№\s?)"
_NUMBER_HINT = regex.compile(r"\d(?:[\d\-\s.()№]{0,6}\d){4}")
_SNILS = r"\d{3}[- ]?\d{3}[- ]?\d{3}[- ]?\d{2}"
_PASSPORT = r"\d{2}[ -]?\d{2}(?:\s|,|№|N|номер|-){0,10}\d{6}"
_BIRTH = r"[IVXLС1-9]{1,5}[- ]?[А-ЯЁ]{2}\s?(?:№|N)?\s?\d{6}"
IDENTITY = [
    regex.compile(rf"(?i:\bснилс|\bsnils|страхов\w+\s+(?:номер|свидетельств\w+))[^\d\n]{{0,40}}?(?P<n>{_SNILS})(?!\d)"),
    regex.compile(r"(?i:\bинн|\binn|налогоплательщик\w*)\b[^\d\n]{0,40}?(?P<n>\d{2} ?\d{2} ?\d{6}(?: ?\d{2})?)(?!\d)"),
    regex.compile(rf"(?i:паспорт\w*|passport|\bсерия|\bсерии)[^\d\n]{{0,30}}?(?P<n>{_PASSPORT})(?!\d)"),
    regex.compile(rf"(?<![\p{{L}}\d])(?P<n>{_BIRTH})(?!\d)"),
    regex.compile(r"(?i:\bssn|social security(?: number| no\.?)?)[^\d\n]{0,20}?(?P<n>\d{3}[- ]?\d{2}[- ]?\d{4})(?!\d)"),
    regex.compile(rf"[|;\t]\s?(?P<n>{_PASSPORT})(?=\s?[|;\t])"),
    regex.compile(r"(?<![\d.,-])(?P<n>\d{3}-\d{3}-\d{3}[ -]\d{2})(?![\d-])"),
]

# --- phones ---

_S = r"[\s.\-]{0,3}"
PHONE = [
    regex.compile(rf"(?<![\d\p{{L}}@_])(?<!\d[-.,/])(?:\+\s?7|8|7){_S}\(?\d{{3}}\)?{_S}\d{{3}}{_S}\d{{2}}{_S}\d{{2}}(?!\d|[-./]\d|@)"),
    regex.compile(r"(?<![\d\p{L}@_])(?<!\d[-.,/])(?:\+\s?1[ .\-]?|1[ .\-])?(?:\(\d{3}\)\s{0,2}|\d{3}[-. ])\d{3}[-. ]\d{4}(?!\d|[-./]\d|@)"),
    regex.compile(r"(?<![\d\p{L}@_])(?<!\d[-.,/])(?:\(\d{3}\)\s{0,2}|\d{3}[- ])\d{3}[- ]\d{2}[- ]\d{2}(?!\d|[-./]\d|@)"),
    regex.compile(r"(?<![\d\p{L}@_])\+\d{1,3}(?:[ .\-]?\(?\d{2,5}\)?)(?:[ .\-]?\d{2,6}){2,4}(?!\d|[-./]\d|@)"),
    regex.compile(r"(?i:\bтел(?:ефон\w*)?\.?|\bphone|\btel|\bзвони\w*|\bномер\b|\bcall\b)[\s:.=,]{1,3}(?P<n>\d{10,11})(?!\d|[-./]\d|@)"),
]
_NO_PHONE = regex.compile(r"(?i:ответ\w*|штрихкод\w*|заявк\w*|isbn(?:\s+\w+)?|квитанци\w*|чек\w*|верси\w*|код\w*|артикул\w*|сравните|ряд|answer|barcode|version|order|№|\$|=)[\s:№#]*$")
_PHONE_AFTER_EQUALS = regex.compile(r"(?i:tel|phone|тел\w*)=$")

# --- addresses ---

_CAP = r"[А-ЯЁ][а-яё]+"
_WORDS = rf"(?:(?:\d+-[а-я]{{1,3}}|{_CAP}|[А-ЯЁ]{{3,}})(?:[- ](?:{_CAP}|[А-ЯЁ]{{3,}}|\d{{1,3}}(?=\s)))?(?:[- ]{_CAP})?)"
_TYPE = r"(?:[Уу]л(?:ица|ице|ицы|ицу)?\b\.?|[Пп]р-?к?т\b\.?|[Пп]росп(?:ект(?:а|е|у)?)?\b\.?|[Пп]ер(?:еул(?:ок|ке|ка|ку))?\b\.?|[Бб]ульвар(?:е|а|у)?\b|[Бб]-р\b\.?|[Шш]оссе\b|[Нн]аб(?:ережн\p{L}+)?\b\.?|[Пп]л(?:ощад\p{L}+)?\b\.?|[Аа]лле[яеию]\b|[Тт]упик(?:е|а)?\b|[Пп]роезд(?:е|а)?\b)"
_HOUSE = r"(?:(?:д(?:ом)?\b\.?\s?)?\d{1,4}[а-яА-Я]?(?:[/\\]\d{1,4}[а-я]?)?(?![\d\p{L}%]|[.,]\d|:\d))"
_MORE = r"(?:(?:,?\s{0,2}(?:к(?:орп(?:ус)?)?\b\.?|стр(?:оение)?\b\.?|кв(?:артира)?\b\.?|оф(?:ис)?\b\.?|под(?:ъезд)?\b\.?|эт(?:аж)?\b\.?)\s?\d{1,4}[а-я]?)|(?:-\d{1,4}(?!\d)|,\s\d{1,4}(?![\d\p{L}%]|[.,:]\d|\s\p{L})))"
_TOWN = rf"(?:(?:г|гор|пос|п|с|дер|д|ст|пгт|город|поселок|посёлок|село|деревня)\b\.?\s?{_CAP}(?:[- ]{_CAP}){{0,2}},\s{{0,2}})"
_BARE_TOWN = rf"(?:{_CAP}(?:[- ]{_CAP}){{0,2}},\s)"
_REGION = rf"(?:(?:{_CAP}\s(?:обл(?:асть)?|край|р-н|район)\b\.?|[Рр]еспублика\s{_CAP}),\s)"
_BEFORE = rf"(?:(?P<post>\d{{6}}),?\s)?(?:(?:Россия|РФ),\s)?{_REGION}?(?:{_TOWN}|(?P<bare>{_BARE_TOWN}))?(?:{_REGION})?"
_FLAT_FIRST = r"(?:(?:кв(?:артира)?\b\.?|д(?:ом)?\b\.?)\s?\d{1,4},\s){0,2}"
ADDRESS = [
    regex.compile(rf"(?<![\p{{L}}\d]){_BEFORE}{_FLAT_FIRST}(?P<street>{_TYPE}\s{{0,2}}[«\"]?{_WORDS}[»\"]?)(?:,\s{{0,2}}|\s{{1,2}}){_HOUSE}{_MORE}{{0,4}}"),
    regex.compile(rf"(?<![\p{{L}}\d]){_BEFORE}(?P<street>{_WORDS}\s{_TYPE})(?:,\s{{0,2}}|\s{{1,2}}){_HOUSE}{_MORE}{{0,4}}"),
]
_STREETS = r"(?:(?:Lane|Drive|Road|Street|Way|Close|Court|Avenue|Boulevard|Square|Terrace|Place|Crescent|Hill|Row|Grove|Gardens|Parkway|Mews|Walk)\b|(?:Ln|Dr|Rd|St|Ct|Ave|Blvd|Sq|Pl)\b\.?)"
_UNIT = r"(?:Flat|Apt|Apartment|Unit|Suite|Room|No)\.?\s#?\d{1,4}[A-Za-z]?"
ADDRESS_EN = regex.compile(rf"(?<![\p{{L}}\d])(?:{_UNIT},\s)?\d{{1,5}}[A-Za-z]?\s(?:[A-Z][a-z']+\s){{1,3}}{_STREETS}(?:,\s{_UNIT})?(?:,\s[A-Z][a-z]+(?:\s[A-Z][a-z]+)?(?=[.,;!?\n]|$))?")
#: Whether an address can be in a text: its letters first, which is faster, then whether a word begins there.
_ADDRESS_HINT = re.compile(
    r"[УуПпБбШшНнАаТт](?<!\w.)(?:л(?:иц[аеыу])?\b|р-?к?т\b|росп(?:ект[аеу]?)?\b|ер(?:еул(?:ок|к[еау]))?\b|ульвар[еау]?\b|-р\b|оссе\b|аб(?:ережн\w+)?\b|л(?:ощад\w+)?\b|лле[яеию]\b|упик[еа]?\b|роезд[еа]?\b)"
    r"|[LDRSWCABPTHGM](?<=\s.)(?:ane|rive|oad|treet|ay|lose|ourt|venue|oulevard|quare|errace|lace|rescent|ill|ow|rove|ardens|arkway|ews|alk|n|r|d|t|ve|lvd|q|l)\b"
)

# --- names ---

_WORD = re.compile(r"[A-Za-zА-Яа-яЁё]+(?:['’][A-Za-z]+)?(?:-[A-Za-zА-Яа-яЁё]+)*")
_INITIALS = regex.compile(r"\s?([A-ZА-ЯЁ])\.(?:\s?([A-ZА-ЯЁ])\.)?(?![A-Za-zа-яё])")
_INITIALS_BEFORE = regex.compile(r"(?<![\p{L}\d.])([A-ZА-ЯЁ])\.\s?(?:([A-ZА-ЯЁ])\.\s?)?$")
_MIDDLE = regex.compile(r"[^\S\n]?[A-Z]\.[^\S\n]?")
_MIDDLE_AFTER = regex.compile(r" [A-Z]\.")
_DOTTED = regex.compile(r"[A-ZА-ЯЁ]\.")
_TELLING = frozenset(("given", "patronymic"))
_SPACE = regex.compile(r"[^\S\n]{1,3}|[^\S\n]?\n[^\S\n]?")
#: Capitalised words beside a given name or initials that are no surnames.
_NO_SURNAME = frozenset(
    "ученик ученица студент студентка школьник школьница отличник отличница выпускник учитель учительница преподаватель репетитор директор мальчик девочка юноша девушка мама папа брат сестра друг подруга "
    "дорогой дорогая уважаемый уважаемая уважаемые привет здравствуй здравствуйте спасибо пожалуйста салют добрый доброе добрая только сколько столько несколько однако далеко легко потом затем тогда когда если пусть "
    "пока после перед вчера сегодня завтра вместе также этих других таких каких своих моих твоих наших ваших всех обоих знак конец участник участница садовник лодочник велосипедист мотоциклист пешеход рабочий "
    "треугольник четырехугольник многоугольник прямоугольник отрезок кружок рисунок рисунке точка точки точке задача задание задачи пример ответ решение автор лемма теорема метод формула город улица проверил проверила "
    "решил решила пишет писал писала зовут привел телефон почта паспорт адрес контакты контакт родитель имя фамилия снилс "
    "dear hello thanks thank student teacher tutor parent mother father brother sister uncle aunt friend then when where while with from after before because please call contact reach email phone answer task problem point line and but the this that what does will can did has have name sincerely regards".split()
)
_IMPERATIVE = regex.compile(r"(?:ите|йте|ьте|итесь|йтесь)$")
_CLAUSE_START = regex.compile(r"(?:^|[.!?…:;\n])[\s\"«(*_#>\-–—]*$")
_CLAUSE_END = regex.compile(r"[^\S\n]*(?:[.,;:!?…)\n»\"]|$)")


def _style(word: str) -> str:
    """``u`` all capitals, ``t`` capitalised, ``l`` small letters, ``x`` other."""
    if len(word) > 1 and word.isupper():
        return "u"
    if all(p[:1].isupper() and p[1:].islower() for p in word.split("-")):
        return "t"
    return "l" if word.islower() else "x"


def find_names(text: str) -> Iterator[tuple[int, int]]:
    """Spans of personal names of at least two parts."""
    tokens = _WORD.findall(text)
    roles = list(map(parts, tokens))
    telling = {r for r in set(roles) if not r.isdisjoint(_TELLING)}
    dotted = _DOTTED.search(text) is not None
    if not telling and not dotted:
        return
    words = [(*m.span(), w) for m, w in zip(_WORD.finditer(text), tokens)]
    i, taken = 0, 0
    n = len(words)
    # A name begins only where a given or father's name is near, or an initial.
    key = [r in telling for r in roles]
    begins = [a or b or c for a, b, c in zip(key, [*key[1:], False], [*key[2:], False, False])]
    if dotted:
        for at, (start, end, word) in enumerate(words):
            if word[0].isupper() and ("." in text[end : end + 4] or "." in text[max(0, start - 8) : start]):
                begins[at] = True
    begins.append(True)

    def any_surname(role: frozenset[str]) -> bool:
        return "surname" in role or "surname?" in role

    def adjacent(a: int) -> bool:
        """Whether word ``a`` and the next one are neighbours in one line and style."""
        if a + 1 >= n:
            return False
        gap = text[words[a][1] : words[a + 1][0]]
        if gap != " " and not _SPACE.fullmatch(gap):
            return False
        one, two = words[a][2], words[a + 1][2]
        return _style(one) == _style(two) != "x" and one[0].isascii() == two[0].isascii()

    def may_be_surname(a: int, least: int = 3) -> bool:
        """Whether a capitalised word without a telling ending can be one; in capitals throughout, only by its ending."""
        word, role = words[a][2], roles[a]
        low = word.lower().replace("ё", "е")
        if len(word) < least or low in _NO_SURNAME or _IMPERATIVE.search(low) or "given" in role or "patronymic" in role:
            return False
        return _style(word) == "t" or "surname?" in role and _style(word) == "u"

    def less_telling(a: int) -> tuple[int, int, int] | None:
        """Start, end and number of words of a name whose surname has no telling ending, in one line."""
        start, end, word = words[a]
        near = adjacent(a) and text[end : words[a + 1][0]] == " "
        if "given" in roles[a]:
            if _style(word) not in "tu":
                return None
            if near and may_be_surname(a + 1):
                return start, words[a + 1][1], 2
            if word[0].isascii() and a + 2 < n and len(words[a + 1][2]) == 1 and _MIDDLE.fullmatch(text[end : words[a + 2][0]]) and words[a + 2][2][0].isascii() and may_be_surname(a + 2):
                return start, words[a + 2][1], 3
            return None
        if not may_be_surname(a):
            return None
        by_ending = bool(roles[a])
        if near and "given" in roles[a + 1]:
            after = adjacent(a + 1) and text[words[a + 1][1] : words[a + 2][0]] == " "
            used = 3 if after and "patronymic" in roles[a + 2] else 2
            until = words[a + used - 1][1]
            if used == 2 and after and (any_surname(roles[a + 2]) or may_be_surname(a + 2)):  # the given name goes with what follows
                return None
            if by_ending or not _CLAUSE_START.search(text, max(0, start - 8), start) or _CLAUSE_END.match(text, until):
                return start, until, used
        if len(word) > 3:
            before, behind = _INITIALS_BEFORE.search(text, max(0, start - 8), start), _INITIALS.match(text, end)
            if before and (by_ending or before.group(2)) and "\n" not in before.group():
                return before.start(), end, 1
            if behind and (by_ending or behind.group(2)) and "\n" not in behind.group():
                return start, behind.end(), 1
        return None

    while i < n:
        if not begins[i]:
            i = begins.index(True, i)
            continue
        role = roles[i]
        if not role:
            if words[i][2][0].isupper() and words[i][0] >= taken and (found := less_telling(i)):
                yield found[:2]
                taken, i = found[1], i + found[2]
            else:
                i += 1
            continue
        start, end, word = words[i]
        if start < taken:
            i += 1
            continue
        style, latin = _style(word), word[0].isascii()
        found, used = None, 1
        surname = "surname" in role
        if adjacent(i):
            nxt, third = roles[i + 1], roles[i + 2] if i + 2 < n and adjacent(i + 1) else frozenset()
            if "given" in role and "patronymic" in nxt:
                used = 3 if any_surname(third) and "given" not in third else 2
            elif any_surname(role) and "given" in nxt and "patronymic" in third:
                used = 3
            elif "given" in role and ("surname" in nxt or "surname?" in nxt and style == "t") and "patronymic" not in nxt:
                used = 3 if "patronymic" in third and "given" not in nxt else 2
                if used == 2 and "given" in nxt and "patronymic" in third:  # the second is the given name
                    used = 3
            elif surname and "given" in nxt:
                used = 2
            elif surname and "patronymic" in nxt:
                used = 2
            if used > 1:
                found = (start, words[i + used - 1][1])
        if found is None and style in "tu" and ("given" in role or surname) and latin:
            # Latin script: Given I. Surname, and Surname, Given.
            if "given" in role and i + 2 < n and (m := _MIDDLE.fullmatch(text[end : words[i + 2][0]])) and len(words[i + 1][2]) == 1 and "surname" in roles[i + 2]:
                found, used = (start, words[i + 2][1]), 3
            elif surname and i + 1 < n and text[end : words[i + 1][0]] == ", " and "given" in roles[i + 1] and _style(words[i + 1][2]) == style:
                found, used = (start, words[i + 1][1]), 2
                if m := _MIDDLE_AFTER.match(text, found[1]):
                    found = (start, m.end())
        if found is None and surname and style in "tu":
            before = _INITIALS_BEFORE.search(text, max(0, start - 8), start)
            after = _INITIALS.match(text, end)
            if before:
                found = (before.start(), end)
            elif after and text[end : end + 1] != "":
                found = (start, after.end())
        if found is None and style in "tu" and (not surname or latin and "given" in role) and (loose := less_telling(i)):
            found, used = loose[:2], loose[2]
        if found:
            yield found
            taken = found[1]
        i += used


_CONTEXT_EN = regex.compile(r"(?:\b[Mm]y name is|\bReach|\bParent:|\bStudent:|\bTutor:|\bMr\.?|\bMrs\.?|\bMs\.?|\bDr\.?|\bsincerely,|\bregards,)\s+(?P<n>(?:[A-Z]\.\s?){0,2}[A-Z][a-z]+(?:-[A-Z][a-z]+)?(?:,?\s[A-Z]\.)?(?:,?\s[A-Z][a-z]+(?:-[A-Z][a-z]+)?)?)")


def _english_names(text: str) -> Iterator[tuple[int, int]]:
    for m in _CONTEXT_EN.finditer(text):
        if regex.search(r"[A-Z][a-z.]*[\s,]+[A-Z]", m.group("n")):
            yield m.span("n")


# --- all kinds ---


def _free(spans: list[tuple[int, int, str]], a: int, b: int) -> bool:
    return all(b <= x or y <= a for x, y, _ in spans)


def _rule_spans(view: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of what the rules find in a reading form, without overlaps."""
    spans: list[tuple[int, int, str]] = []

    def free(a: int, b: int) -> bool:
        return _free(spans, a, b)

    def add(kind: str, a: int, b: int) -> None:
        if free(a, b):
            spans.append((a, b, kind))

    if "@" in view or "собака" in view.lower() or _AT_HINT.search(view):
        for m in EMAIL.finditer(view):
            add("email", *m.span())
    numbers = _NUMBER_HINT.search(view) is not None
    if numbers:
        for pattern in IDENTITY:
            for m in pattern.finditer(view):
                add("id_number", *m.span("n"))
    for a, b in find_names(view):
        add("name", a, b)
    for a, b in _english_names(view):
        add("name", a, b)
    if _ADDRESS_HINT.search(view):
        for pattern in ADDRESS:
            for m in pattern.finditer(view):
                a, b = m.span()
                if not free(a, b):  # what looks like a town may be the end of a name
                    a = max([y for x, y, _ in spans if x < m.start("street") and y > a], default=a)
                    while a < b and not view[a].isalnum():
                        a += 1
                add("address", a, b)
        for m in ADDRESS_EN.finditer(view):
            add("address", *m.span())
    if numbers:
        for k, pattern in enumerate(PHONE):
            for m in pattern.finditer(view):
                a, b = m.span("n") if k == 4 else m.span()
                ahead = view[max(0, a - 30) : a]
                if not _NO_PHONE.search(ahead) or _PHONE_AFTER_EQUALS.search(ahead):
                    add("phone", a, b)
    return spans


def _begun(view: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans in order, each from its first letter or digit on."""
    out = []
    for a, b, kind in sorted(spans):
        while a < b and not view[a].isalnum():
            a += 1
        out.append((a, b, kind))
    return out


def _spans(view: str, model: NameModel | None = None) -> list[tuple[int, int, str]]:
    """Start, end and kind of the items of a reading form, without overlaps."""
    spans = _rule_spans(view)
    if model is not None:
        for a, b in model.names(view):
            if _free(spans, a, b):
                spans.append((a, b, "name"))
    return _begun(view, spans)


def find_items(text: str | None, model: NameModel | None = None) -> list[Item]:
    """Items of a text in order, without overlaps; none for null or empty text. ``model`` adds names that the rules don't know."""
    if not text:
        return []
    reading = reading_form(text)
    return [Item(kind, reading.original(a), reading.original(b - 1) + 1, reading.view[a:b]) for a, b, kind in _spans(reading.view, model)]


# --- tables of texts ---

_READ = pa.schema([("key", pa.int64()), ("kind", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("item", pa.string()), ("run", pa.string()), ("hashes", pa.list_(pa.int64()))])


def _reader(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, text`` to :func:`read_texts`."""
    for batch in it:
        rows, views = [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not text:
                continue
            reading = reading_form(text)
            view, spans = reading.view, _rule_spans(reading.view)
            begun = _begun(view, spans)
            views.append(view)
            rows += [(key, kind, reading.original(a), reading.original(b - 1) + 1, view[a:b], None, None) for a, b, kind in begun]
            for place in places(view):
                end = place.end
                more = {skip: (label_of(a, end, begun), _free(spans, a, end), reading.original(a), view[a:end]) for skip, (a, _) in place.options.items()}
                rows.append((key, None, None, None, None, FoundPlace(place, more, reading.original(end - 1) + 1).dumps(), list({word_hash(w) for w in place.words})))
        rows.append((None, None, None, None, None, None, list(small_words(views))))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)


def read_texts(rows: DataFrame) -> DataFrame:
    """What is read once of all ``rows(key, text)``: items by rules (with ``kind``), capitalised runs (with ``run``) and the words of small letters."""
    return rows.mapInArrow(_reader, "key long, kind string, start_pos int, end_pos int, item string, run string, hashes array<long>")


def names_of_model(read: DataFrame) -> DataFrame | None:
    """``key, kind, start_pos, end_pos, item`` of names that the rules don't know, by a classifier fitted on all of ``read``; None if there is too little to learn from."""
    model = fit_on_runs(read)
    if model is None:
        return None
    return read.where("run is not null").select("key", "run").mapInArrow(names_in_runs(model), "key long, kind string, start_pos int, end_pos int, item string")
