"""Keyed replacements for personal data, and texts with every item replaced.

An item becomes ``[KIND replacement]``. The replacement has the item's form: digits take the place
of digits, a surname keeps its suffix and case ending (and so its gender), a word keeps its script
and capitals, initials stay initials. Parts are replaced one by one, so the same person, number or
street is the same in every form and every document, and different ones stay different:

* numbers, given names and fathers' names in the lists, initials and the letters of documents go through
  keyed permutations that leave nothing where it was, and can't collide;
* all other words (stems of surnames, names in no list, streets and towns, local parts and domains of
  emails) get syllables drawn from a keyed digest; these are checked against each other and against all
  original words over the whole corpus, and those that collide are drawn again.

Detection runs once: :func:`surrogate_items` writes the items, gives each its replacement, and is what the
items' positions and the redacted texts are both read from.
"""

from __future__ import annotations

import hmac
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm.names import ENGLISH_FEMALE, ENGLISH_MALE, FEMALE, MALE, given, parts, split_patronymic, split_surname
from studyloom.llm.personal import Item, names_of_model, read_texts
from studyloom.staging import stage

_CONSONANTS, _VOWELS = "бвгдзклмнпрстфхшч", "аеоуи"
_CONSONANTS_LATIN, _VOWELS_LATIN = "bdfgklmnprstvz", "aeiou"
#: Letters that stand for each other as initials and in series of documents.
_ALPHABETS = tuple(map(tuple, ("АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЭЮЯ", "ЪЫЬ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")))
_ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X")
_TYPE_WORD = regex.compile(
    r"(?i)^(?:ул(?:иц\p{L})?|пр-?к?т|просп(?:ект\p{L}?)?|пер(?:еул\p{L}+)?|бульвар\p{L}?|б-р|шоссе|наб(?:ережн\p{L}+)?|пл(?:ощад\p{L}+)?|алле\p{L}|тупик\p{L}?|проезд\p{L}?|д|дом|кв(?:артира)?|к|корп(?:ус)?|стр(?:оение)?|оф(?:ис)?|эт(?:аж)?|под(?:ъезд)?"
    r"|г|гор|город|пос|п|с|ст|дер|пгт|пос[её]лок|село|деревня|обл(?:асть)?|край|р-н|район|республика|россия|рф|flat|apt|apartment|unit|suite|room|no|lane|ln|drive|dr|road|rd|street|st|way|close|court|ct|avenue|ave|boulevard|blvd|square|sq|terrace|place|pl|crescent|hill|row|grove|gardens|parkway|mews|walk)$"
)
_TOKEN = regex.compile(r"\p{L}[\p{L}'’]*(?:-\p{L}[\p{L}'’]*)*|\d+")
#: Letters in the number of a document: Roman numerals, and pairs of capitals.
_SERIES = regex.compile(r"(?<!\p{L})(?:[IVXLС]+|[А-ЯЁ]{2})(?!\p{L})")
_ENDING = regex.compile(r"(?:ая|ой|ую|ий|ый|ого|ому|ых|их|ые|ие|ов|ев|ей|ам|ы|и|а|я|е|у|ю|о|ь)$")


def _number(key: bytes, *parts_: str) -> int:
    return int.from_bytes(hmac.digest(key, "\x00".join(parts_).encode(), "sha256")[:16], "big")


@lru_cache(maxsize=100_000)
def permuted_digits(key: bytes, digits: str) -> str:
    """Keyed permutation of all digit strings of one length that leaves none where it was.

    Rounds over two halves (Feistel) give a permutation; one step along the order that it makes gives one without fixed points.
    """
    n = len(digits)
    if n < 2:
        return _order(key, "digit", tuple("0123456789"))[digits] if digits else digits
    cut = n // 2
    left, right = 10**cut, 10 ** (n - cut)
    a, b = int(digits[:cut]), int(digits[cut:])
    for r in range(8):
        if r % 2:
            b = (b + _number(key, str(n), str(r), str(a))) % right
        else:
            a = (a + _number(key, str(n), str(r), str(b))) % left
    a, b = divmod((a * right + b + 1) % (left * right), right)
    for r in reversed(range(8)):
        if r % 2:
            b = (b - _number(key, str(n), str(r), str(a))) % right
        else:
            a = (a - _number(key, str(n), str(r), str(b))) % left
    return f"{a:0{cut}d}{b:0{n - cut}d}"


@lru_cache(maxsize=64)
def _order(key: bytes, what: str, words: tuple[str, ...]) -> dict[str, str]:
    """Keyed permutation of a closed list of at least two words: each goes to the next one in a keyed order."""
    mixed = sorted(words, key=lambda w: _number(key, what, w))
    return dict(zip(mixed, [*mixed[1:], mixed[0]]))


def drawn(key: bytes, word: str, attempt: int) -> str:
    """Syllables for an open-ended word, in its script; each further attempt is a syllable longer."""
    cyrillic = regex.search(r"\p{Cyrillic}", word) is not None
    cons, vowels = (_CONSONANTS, _VOWELS) if cyrillic else (_CONSONANTS_LATIN, _VOWELS_LATIN)
    left = _number(key, "word", word, str(attempt))
    out = []
    for _ in range(3 + attempt):
        left, c = divmod(left, len(cons))
        left, v = divmod(left, len(vowels))
        out.append(cons[c] + vowels[v])
    return "".join(out) + cons[left % len(cons)]


def _in_style(word: str, like: str) -> str:
    if len(like) > 1 and like.isupper():
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() else word


def _surname_part(word: str) -> tuple[str, str]:
    return split_surname(word)


def _place_part(word: str) -> tuple[str, str]:
    low = word.lower().replace("ё", "е")
    m = _ENDING.search(low)
    return (low[: m.start()], m.group()) if m and m.start() >= 3 and not low.isascii() else (low, "")


def _email_parts(text: str) -> tuple[str, str, str]:
    m = regex.match(r"^(.*?[\p{L}\p{N}_])([^\p{L}\p{N}_.%+-]*(?:@|[(\[{]\s*(?:at|собака|эт)\s*[)\]}]|\sсобака\s)\s*)(.*)$", text, flags=regex.I | regex.S)
    return (m.group(1).lower(), m.group(2), m.group(3).lower()) if m else (text.lower(), "@", "")


def open_words(item: Item) -> list[str]:
    """The parts of an item that get drawn words."""
    if item.kind == "email":
        local, _, domain = _email_parts(item.text)
        return [local, domain]
    if item.kind == "address":
        return [_place_part(h)[0] for w in _TOKEN.findall(item.text) if not w.isdigit() and not _TYPE_WORD.match(w) for h in w.split("-")]
    if item.kind == "name":
        out = []
        for w in _TOKEN.findall(item.text):
            role = parts(w)
            if len(w) == 1 or _listed(w):
                continue
            stems = [split_patronymic(w)[0]] if "patronymic" in role else [_surname_part(h)[0] for h in w.split("-")]
            out += [s for s in stems if "patronymic" not in role or _father(w) is None]
        return out
    return []


_PLAIN_MALE = [m.replace("ё", "е") for m in MALE]
#: Stems that take -ович, and those that take -евич.
_FATHERS = {"о": tuple(sorted({n for n in _PLAIN_MALE if n[-1] not in "аяйь"})), "е": tuple(sorted({n[:-1] for n in _PLAIN_MALE if n[-1] == "й"}))}


def _father(word: str) -> tuple[str, ...] | None:
    """The list of fathers' names that a patronymic's stem is in, or None."""
    stem, rest = split_patronymic(word)
    known = _FATHERS.get(rest[:1], ())
    return known if stem in known else None


def _letter(key: bytes, letter: str) -> str:
    for letters in _ALPHABETS:
        if letter.upper() in letters:
            other = _order(key, "letter", letters)[letter.upper()]
            return other if letter.isupper() else other.lower()
    return letter


_RUSSIAN = {"m": tuple(m.replace("ё", "е") for m in MALE), "f": tuple(f.replace("ё", "е") for f in FEMALE)}
#: English names that aren't a spelling of a Russian one too.
_ENGLISH = {"m": tuple(n for n in ENGLISH_MALE if given(n)[0] == n), "f": tuple(n for n in ENGLISH_FEMALE if given(n)[0] == n)}


def _soft(name: str) -> str:
    """The last letter that changes with the case."""
    return name[-1] if name[-1] in "аяйь" else ""


def _listed(word: str) -> tuple[str, str, tuple[str, ...]] | None:
    """Nominative, gender and the names that may stand for a listed given name: of its language, gender and, in Cyrillic, declension."""
    found = given(word)
    if found is None or "-" in word:
        return None
    lemma, gender = found
    if word.isascii():
        names = _ENGLISH[gender] if lemma in _ENGLISH[gender] else tuple(sorted(set(_RUSSIAN[gender])))
    else:
        names = tuple(sorted({n for n in _RUSSIAN[gender] if _soft(n) == _soft(lemma)}))
    return (lemma, gender, names) if lemma in names and len(names) > 1 else None


def _name_word(key: bytes, word: str, words: dict[str, str]) -> str:
    if len(word) == 1:
        return _letter(key, word)
    if listed := _listed(word):
        lemma, gender, names = listed
        other = _order(key, f"{gender} {word.isascii()} {_soft(lemma)}" if not word.isascii() else gender, names)[lemma]
        if word.isascii():
            return _in_style(other.translate(_TO_LATIN), word)
        low, ending = word.lower().replace("ё", "е"), _soft(lemma)
        head = lemma.removesuffix(ending)
        tail = low[len(head) :] if low.startswith(head) else ending
        return _in_style(other.removesuffix(_soft(other)) + tail, word)
    if "patronymic" in parts(word):
        stem, rest = split_patronymic(word)
        known = _father(word)
        return _in_style((_order(key, "father", known)[stem] if known else words.get(stem, stem)) + rest, word)
    return "-".join(_in_style(words.get(_surname_part(h)[0], _surname_part(h)[0]) + _surname_part(h)[1], h) for h in word.split("-"))


_TO_LATIN = str.maketrans({"а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya"})


def replacement(item: Item, key: bytes, words: dict[str, str]) -> str:
    """What stands for an item; ``words`` gives the drawn words of :func:`open_words`."""
    text = item.text
    if item.kind in ("phone", "id_number"):
        digits = "".join(c for c in text if c.isdigit())
        kept = max(0, len(digits) - 10) if item.kind == "phone" else 0
        new = iter(digits[:kept] + permuted_digits(key, digits[kept:]))
        text = "".join(next(new) if c.isdigit() else c for c in text)
        return _SERIES.sub(lambda m: _order(key, "roman", _ROMAN).get(m.group(), "".join(_letter(key, c) for c in m.group())), text) if item.kind == "id_number" else text
    if item.kind == "email":
        local, at, domain = _email_parts(text)
        return f"{words.get(local, local)}{at}{words.get(domain, domain)}.example"
    if item.kind == "address":

        def swap(m) -> str:
            w = m.group()
            if w.isdigit():
                return permuted_digits(key, w)
            if _TYPE_WORD.match(w):
                return w
            return "-".join(_in_style(words.get(_place_part(h)[0], _place_part(h)[0]) + _place_part(h)[1], h) for h in w.split("-"))

        return _TOKEN.sub(swap, text)
    return _TOKEN.sub(lambda m: _name_word(key, m.group(), words), text)


def filled(text: str, pieces: list[tuple[int, int, str, str]]) -> str:
    """The text with each of ``pieces`` (start, end, kind, replacement; in order) as a typed placeholder; everything else is kept as it is."""
    out, at = [], 0
    for start, end, kind, new in pieces:
        out += [text[at:start], f"[{kind.upper()} {new}]"]
        at = end
    return "".join(out) + text[at:]


def redact(text: str, items: list[Item], key: bytes, words: dict[str, str]) -> str:
    """The text with each item replaced."""
    return filled(text, [(i.start, i.end, i.kind, replacement(i, key, words)) for i in items])


# --- DataFrames ---

def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))


def _open_words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``kind, item`` to ``kind, item, word`` for each word to be drawn."""
    for batch in it:
        rows = [(kind, item, word) for kind, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for word in dict.fromkeys(open_words(Item(kind, 0, 0, item)))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [()] * 3)], ["kind", "item", "word"])


def drawn_words(words: DataFrame, key: bytes, generate: Callable[[bytes, str, int], str] = drawn) -> DataFrame:
    """``word, drawn`` for each distinct ``word``: no two alike, and none an original word."""

    @F.pandas_udf("string")
    def draw(word: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([generate(key, w, a) for w, a in zip(word, attempt)], dtype=object)

    table = words.select("word").distinct().withColumn("attempt", F.lit(0)).withColumn("drawn", draw("word", F.col("attempt")))
    while True:
        table = stage(table, "drawn")
        # Each drawn word has one owner; an original word has none.
        owners = table.groupBy("drawn").agg(F.min(F.struct("attempt", "word")).alias("owner"), F.count("*").alias("n"))
        real = owners.join(table.select(F.col("word").alias("real")), F.col("drawn") == F.col("real"), "left")
        clashing = stage(real.where("n > 1 or real is not null").select(F.col("drawn").alias("drawn_"), F.when(F.col("real").isNull(), F.col("owner.word")).alias("owner_")), "clashes")
        if clashing.isEmpty():
            return table.select("word", "drawn")
        marked = table.join(clashing, F.col("drawn") == F.col("drawn_"), "left").withColumn("again", F.col("drawn_").isNotNull() & ~F.col("word").eqNullSafe(F.col("owner_")))
        attempt = F.col("attempt") + F.col("again").cast("int")
        table = marked.select("word", attempt.alias("attempt"), F.when(F.col("again"), draw("word", attempt)).otherwise(F.col("drawn")).alias("drawn"))


def _replacements(key: bytes):
    """``kind, item, words`` to ``kind, item, replacement``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            kinds, items, words = (batch.column(i).to_pylist() for i in range(3))
            done = [replacement(Item(k, 0, 0, i), key, dict(w or ())) for k, i, w in zip(kinds, items, words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(done, pa.string())], ["kind", "item", "replacement"])

    return run


def surrogate_items(df: DataFrame, key: str, text: str, secret: bytes, model: bool = True) -> DataFrame:
    """``<key>, kind, start_pos, end_pos, item, replacement`` of each item of each text; none for null and empty texts.

    Repeated rows repeat their items. ``model`` says whether names are also looked for by the classifier that is
    fitted on all texts. Replacements are made once for each different item.
    """
    rows = _rows(df, key, text)
    read = stage(read_texts(rows), "items")
    items = read.where("kind is not null").select("key", "kind", "start_pos", "end_pos", "item")
    if model and (names := names_of_model(read)) is not None:
        items = items.unionByName(stage(names, "names"))
    different = stage(items.select("kind", "item").distinct(), "different-items")
    opened = stage(different.mapInArrow(_open_words, "kind string, item string, word string"), "open-words")
    pairs = opened.join(drawn_words(opened, secret), "word").groupBy("kind", "item").agg(F.map_from_entries(F.collect_list(F.struct("word", "drawn"))).alias("words"))  # the words of one item
    made = different.join(pairs, ["kind", "item"], "left").select("kind", "item", "words").mapInArrow(_replacements(secret), "kind string, item string, replacement string")
    return items.join(made, ["kind", "item"]).select(F.col("key").alias(key), "kind", "start_pos", "end_pos", "item", "replacement")


def personal_items(df: DataFrame, key: str, text: str, secret: bytes, model: bool = True) -> DataFrame:
    """``<key>, kind, start_pos`` of each item that :func:`surrogate_items` replaces."""
    return surrogate_items(df, key, text, secret, model).where("replacement is not null").select(key, "kind", "start_pos")


def _redactor(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        keys, texts, found = (batch.column(i).to_pylist() for i in range(3))
        done = [filled(text, [(i["start_pos"], i["end_pos"], i["kind"], i["replacement"]) for i in items]) if items else text for text, items in zip(texts, found)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(done, pa.string()), pa.array([len(i or ()) for i in found], pa.int32())], ["key", "text", "n_items"])


def redact_texts(df: DataFrame, key: str, text: str, secret: bytes, model: bool = True) -> DataFrame:
    """``<key>, text, n_items``: each text with its items replaced. Null stays null; ``<key>`` must be unique."""
    found = surrogate_items(df, key, text, secret, model).select(F.col(key).alias("key"), F.struct("start_pos", "end_pos", "kind", "replacement").alias("item"))
    of_text = found.groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))  # the items of one text
    return _rows(df, key, text).join(of_text, "key", "left").select("key", "text", "items").mapInArrow(_redactor, "key long, text string, n_items int").withColumnRenamed("key", key)
