"""Words of personal names: which part of a name a word can be, in any case form and script."""

from __future__ import annotations

from functools import lru_cache

import regex

# Given names in common use, nominative, by gender.
MALE = (
    "александр алексей анатолий андрей антон аркадий арсений артём артур богдан борис вадим валентин валерий василий виктор виталий владимир владислав вячеслав "
    "геннадий георгий герман глеб григорий данил даниил данила денис дмитрий евгений егор ефим захар иван игорь илья иннокентий кирилл константин лев леонид макар "
    "максим марат марк матвей мирон михаил назар никита николай олег павел пётр платон прохор роман руслан савелий святослав семён сергей станислав степан "
    "тарас тимофей тимур тихон фёдор филипп эдуард эльдар эрик юрий яков ян ярослав"
).split()
FEMALE = (
    "агата аделина аида алевтина александра алёна алина алиса алла алсу амина анастасия ангелина анжела анна арина ася валентина валерия варвара василиса вера вероника "
    "виктория галина дарья диана дина ева евгения екатерина елена елизавета жанна зарема злата зинаида зоя инга инна ирина камилла карина кира клавдия кристина ксения лада лариса лидия "
    "лилия лия любовь людмила майя маргарита марина мария марьяна мила милана надежда наталья наталия нелли ника нина оксана олеся ольга пелагея полина раиса регина "
    "римма роза руслана светлана серафима снежана софия софья стефания таисия тамара татьяна ульяна фаина эвелина элеонора эльвира эмилия эмма юлия юлиана яна ярослава"
).split()
ENGLISH_MALE = "adam andrew anthony brian charles christopher daniel david edward eric george henry jack james jason john joseph kevin mark matthew michael oliver paul peter richard robert samuel steven thomas william".split()
ENGLISH_FEMALE = "alice amanda amy ann barbara caroline charlotte elizabeth emily emma grace hannah helen jane jennifer jessica julia karen laura linda lucy mary nancy olivia rachel rebecca ruth sandra sarah susan".split()
#: Letters of the Cyrillic alphabet and the spellings in Latin script that names take.
LATIN = {
    "а": ("a",), "б": ("b",), "в": ("v",), "г": ("g",), "д": ("d",), "е": ("e", "ye"), "ё": ("yo", "e", "io"), "ж": ("zh",), "з": ("z",), "и": ("i",), "й": ("y", "i"), "к": ("k",), "л": ("l",),
    "м": ("m",), "н": ("n",), "о": ("o",), "п": ("p",), "р": ("r",), "с": ("s",), "т": ("t",), "у": ("u",), "ф": ("f",), "х": ("kh", "h"), "ц": ("ts",), "ч": ("ch",), "ш": ("sh",), "щ": ("shch", "sch"),
    "ъ": ("",), "ы": ("y",), "ь": ("", "'"), "э": ("e",), "ю": ("yu", "iu"), "я": ("ya", "ia"),
}


def in_latin(word: str) -> set[str]:
    """Latin spellings of a Cyrillic word."""
    out = {""}
    for letter in word:
        out = {head + tail for head in out for tail in LATIN.get(letter, (letter,))}
        if len(out) > 64:
            break
    return out


def _plain(word: str) -> str:
    return word.lower().replace("ё", "е")


def _forms(name: str) -> set[str]:
    """Singular case forms of a Cyrillic given name."""
    name = _plain(name)
    if name in ("лев", "павел", "петр", "любовь"):
        stem = {"лев": "льв", "павел": "павл", "петр": "петр", "любовь": "любов"}[name]
        return {name, *(stem + e for e in (("и", "ью") if name == "любовь" else ("а", "у", "ом", "е")))}
    head, last = name[:-1], name[-1]
    if name.endswith("ия"):
        return {head + e for e in ("я", "и", "ю", "ей", "ею")}
    endings = {"а": ("а", "ы", "и", "е", "у", "ой", "ою", "ей"), "я": ("я", "и", "е", "ю", "ей", "ею"), "й": ("й", "я", "ю", "ем", "е", "и"), "ь": ("ь", "я", "ю", "ем", "е", "и")}
    return {head + e for e in endings[last]} if last in endings else {name + e for e in ("", "а", "у", "ом", "ем", "е")}


def _lexicon() -> dict[str, tuple[str, str]]:
    """Form to (nominative, gender)."""
    out: dict[str, tuple[str, str]] = {}
    for gender, names, english in (("m", MALE, ENGLISH_MALE), ("f", FEMALE, ENGLISH_FEMALE)):
        for name in names:
            for form in _forms(name):
                out.setdefault(form, (_plain(name), gender))
        for name in names:
            for form in in_latin(name):
                out.setdefault(form, (_plain(name), gender))
        for name in english:
            out.setdefault(name, (name, gender))
    return out


GIVEN = _lexicon()
_PATRONYMIC = regex.compile(r"^(\w{2,}?)(?:(ович|евич|ьич|ич)(|а|у|ем|е)|(овн|евн|иничн|ичн)(а|ы|е|у|ой|ою))$")
_PATRONYMIC_LATIN = regex.compile(r"^[a-z]{2,}(?:ovich|evich|yevich|ovna|evna|yevna)$")
_SURNAME = regex.compile(
    r"^(\w{2,}?)(?:(ов|ев|ин|ын)(|а|у|ым|е|ой|ою|ы|ых|ыми)|(ск|цк)(ий|ого|ому|им|ом|ая|ой|ую|ие|их)|(енко|ко|дзе|швили|ых|их)()|(ук|юк|ян|ец|ак|як|ик|ич)(|а|у|ом|ем|е))$"
)
_SURNAME_LATIN = regex.compile(r"^[a-z']{2,}(?:(?:ov|ev|yov|in|yn)a?|sk(?:y|iy|ii|i|aya|aia)|tsk(?:y|iy|aya)|enko|ko|uk|yuk|yan|ich|ian)$")


@lru_cache(maxsize=200_000)
def parts(word: str) -> frozenset[str]:
    """Which of ``given``, ``patronymic``, ``surname`` and ``surname?`` (by a less telling ending) a word can be."""
    low = _plain(word)
    out = set()
    if low in GIVEN:
        out.add("given")
    if "-" in low:
        halves = low.split("-")
        if all("surname" in parts(h) for h in halves):
            out.add("surname")
        return frozenset(out)
    latin = low[:1].isascii()
    if len(low) >= 6 and (_PATRONYMIC_LATIN.match(low) if latin else _PATRONYMIC.match(low)):
        out.add("patronymic")
    m = (_SURNAME_LATIN if latin else _SURNAME).match(low)
    if m and len(low) >= 4:
        out.add("surname?" if not latin and (m.group(6) or m.group(8)) else "surname")
    return frozenset(out)


def given(word: str) -> tuple[str, str] | None:
    """Nominative and gender of a given name in any case form, or None."""
    return GIVEN.get(_plain(word))


def split_surname(word: str) -> tuple[str, str]:
    """Stem and rest (suffix with case ending) of a surname; the rest is empty if no suffix is known."""
    low = _plain(word)
    m = None if low[:1].isascii() else _SURNAME.match(low)
    if m:
        return m.group(1), low[len(m.group(1)) :]
    m = regex.match(r"^([a-z']{2,}?)((?:ov|ev|in|yn)a?|sk(?:y|iy|aya))$", low)
    return (m.group(1), m.group(2)) if m else (low, "")


def split_patronymic(word: str) -> tuple[str, str]:
    """Stem and rest of a patronymic."""
    low = _plain(word)
    m = _PATRONYMIC.match(low) or regex.match(r"^([a-z]{2,}?)(ovich|evich|yevich|ovna|evna|yevna)$", low)
    return (m.group(1), low[len(m.group(1)) :]) if m else (low, "")
