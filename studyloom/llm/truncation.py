"""Texts cut off by a field limit or in transfer.

Three kinds of evidence are combined into the probability that a text's end was lost:

* **Length.** For each source, lengths in characters and in UTF-8 bytes get a log-normal
  distribution by maximum likelihood, right-censored at candidate limits: lengths where more
  different texts end than the fit and the neighbouring lengths allow. The censoring posterior of a
  text at such a limit is the share of texts there that the uncensored distribution doesn't explain.
* **Ending.** Over all texts, how often is a context of words followed by exactly this last word and
  then by the end of the text, without a closing mark? What stops inside a word or sentence ends in a
  way that is rare for its context; whole titles and last lines don't. A text's own ending, and endings
  at limits or before marks of omission, aren't examples. How much an ending tells is learned as the
  two densities of a mixture (whole, cut) over all sources, whose shares differ by source.
* **Breakage.** Open formulas, halves of characters, unfinished markup, closing commas, and marks
  that stand for omitted text.

A text that stops at the end of a sentence is never a case; a known whole title or line isn't either.
"""

from __future__ import annotations

import html
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.staging import stage

#: Share of a context's occurrences that end as the text does, at which the ending says nothing.
NEUTRAL = 0.03
#: Weight of the shorter context in the estimate of the longer one.
BACKOFF = 3.0
#: Bound of the ending's evidence, in natural logarithm of odds.
MOST = 5.0
#: Evidence of a mark of omission, and of unfinished markup, before an unfinished sentence.
MARK, MARKUP = 2.5, 3.0
#: Different texts that a limit must stop at least.
LEAST_AT_LIMIT = 8

# Words after which a full stop doesn't end a sentence.
_SHORT = frozenset("тыс млн млрд см рис стр им напр ул гл ср пп табл fig eq vs no mr mrs dr".split())
_TAG = regex.compile(r"</?[A-Za-z][^<>]{0,200}>")
_OPEN_TAG = regex.compile(r"<(?:/?[A-Za-z][^<>]{0,200})?$")
_OPEN_ENTITY = regex.compile(r"&(?:#?\w{0,8})$")
_OMITTED = regex.compile(r"\s*(?:\[\s*(?:\.{3}|…)\s*\]|\((?:далее|продолжение|см\.|окончание|continued|more|see)[^()]{0,60}\)|\[(?:далее|продолжение|обрезано|truncated|more|cut)[^\[\]]{0,60}\]|<\.{3}>|…|\.{3,})\s*$", regex.I)
_NATURAL_DOTS = regex.compile(r"[,;]\s(?:…|\.{3})\s*$")
_CLOSED = regex.compile(r"[.!?][\"'»”)\]]{0,2}$")
_NUMBERED = regex.compile(r"(?:^|[.!?]\s)\s*\d{1,4}\.$")
_PIECE = regex.compile(r"\$[^$]*\$|[^\W_]+(?:[/'’-][^\W_]+)*|[^\w\s]|_")
_DIGITS = regex.compile(r"\d+")
_HARD_END = frozenset(",;(«“[{-–—/\\=+^_<&*×·")
_QUOTES = frozenset("\"'“”„«»‘’`")


def _pieces(text: str) -> list[str]:
    """Words, formulas and marks in one spelling; ``.`` after a sentence only."""
    out = []
    for m in _PIECE.finditer(text):
        t = m.group()
        if t in _QUOTES:
            continue
        if t[0] == "$" and len(t) > 1:
            out.append("$")
        elif t in ".!?…":
            after = text[m.end() : m.end() + 2].strip()
            if not (out and (out[-1] in _SHORT or after[:1].islower())):
                out.append(".")
        else:
            out.append(_DIGITS.sub("#", t.lower().replace("ё", "е")))
    return out


def _key(*words: str) -> int:
    joined = "\x00".join(words).encode("utf-8", "replace")
    return (crc32(joined) << 31) ^ crc32(joined[::-1] + b"\x01")


class Ending:
    """How a text ends: ``state`` 0 closed, 1 open, 2 broken; ``extra`` evidence; whether it may teach whole endings."""

    __slots__ = ("extra", "pieces", "state", "teaches")

    def __init__(self, text: str):
        self.extra, self.teaches = 0.0, True
        body = html.unescape(_TAG.sub(" ", text)) if "<" in text or "&" in text else text
        body = body.rstrip()
        half = body.endswith("�")
        body = body.rstrip("�")
        for pattern in (_OPEN_TAG, _OPEN_ENTITY):
            if m := pattern.search(body[-210:]):
                body = body[: len(body) - len(m.group())]
                self.extra, self.teaches = MARKUP, False
        inside = half and bool(body) and (body[-1].isspace() or body[-1].isalnum())
        body = body.rstrip()
        if (m := _OMITTED.search(body[-120:])) and not _NATURAL_DOTS.search(body[-10:]):
            body = body[: len(body) - len(m.group())].rstrip()
            self.extra, self.teaches = self.extra + MARK, False
        elif m:
            body = body.rstrip("….") + "."
        formula = body.count("$") % 2 == 1
        self.pieces = _pieces(body)
        closed = bool(_CLOSED.search(body)) and not _NUMBERED.search(body)
        if closed and body.endswith(".") and regex.search(r"(\w+)\.$", body) and regex.search(r"(\w+)\.$", body).group(1).lower() in _SHORT:
            closed = False
        if not self.pieces:
            self.state = 0
        elif formula or inside:
            self.state = 2
        elif closed:
            self.state = 0
        elif body[-1:] in _HARD_END:
            self.state = 2
        else:
            self.state = 1
            while self.pieces and self.pieces[-1] == ".":
                self.pieces.pop()
        if self.state == 2 or half:
            self.teaches = False

    def contexts(self) -> list[str]:
        return [".", ".", *self.pieces]


_FEATURE = "source string, h1 long, h2 long, n_rows long, n_chars long, n_bytes long, state int, extra double, teaches boolean, w3 long, c3 long, w2 long, c2 long, w1 long"
_GRAM = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("ends", pa.int64())])


def _features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``source, text, h1, h2, n_rows`` to one row of :data:`_FEATURE` each."""
    for batch in it:
        rows = []
        for source, text, h1, h2, n in zip(*(batch.column(i).to_pylist() for i in range(5))):
            e = Ending(text)
            a, b, c = e.contexts()[-3:]
            rows.append((source, h1, h2, n, len(text), len(text.encode("utf-8", "replace")), e.state, e.extra, e.teaches, _key("3", a, b, c), _key("c", a, b), _key("2", b, c), _key("c", b), _key("1", c)))
        columns = list(zip(*rows)) if rows else [()] * 14
        kinds = [pa.string(), *[pa.int64()] * 5, pa.int32(), pa.float64(), pa.bool_(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in _FEATURE.split(", ")])


def _grams(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``text, at_limit`` to counts of contexts and of whole endings, added up within a batch."""
    for batch in it:
        seen: dict[int, list[int]] = {}

        def count(key: int, n: int, end: int) -> None:
            cell = seen.setdefault(key, [0, 0])  # noqa: B023
            cell[0] += n
            cell[1] += end

        for text, at_limit in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            e = Ending(text)
            words = e.contexts()
            last = len(words) - 1
            for i in range(2, last + 1):
                a, b, c = words[i - 2 : i + 1]
                if c == ".":
                    continue
                count(_key("c", a, b), 1, 0)
                count(_key("c", b), 1, 0)
                if i == last and e.state == 1 and e.teaches and not at_limit:
                    count(_key("3", a, b, c), 0, 1)
                    count(_key("2", b, c), 0, 1)
                    count(_key("1", c), 0, 1)
            count(0, max(0, last - 1), 0)
        keys = np.fromiter(seen, np.int64, len(seen))
        cells = np.array(list(seen.values()), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(cells[:, 0]), pa.array(cells[:, 1])], schema=_GRAM)


# --- lengths ---


def _normal_tail(z: np.ndarray | float) -> np.ndarray | float:
    return 0.5 * np.vectorize(math.erfc)(np.asarray(z) / math.sqrt(2))


def fit_censored(lengths: np.ndarray, counts: np.ndarray, limits: np.ndarray) -> tuple[float, float]:
    """Mean and deviation of log length, by maximum likelihood; values at ``limits`` are only known to be at least that (EM)."""
    x, w = np.log(lengths), counts.astype(float)
    cut = np.isin(lengths, limits)
    mean = np.average(x, weights=w)
    spread = max(0.05, math.sqrt(np.average((x - mean) ** 2, weights=w)))
    for _ in range(60):
        z = (x[cut] - mean) / spread
        tail = np.maximum(_normal_tail(z), 1e-12) if cut.any() else np.empty(0)
        hazard = np.exp(-0.5 * z**2) / math.sqrt(2 * math.pi) / tail
        first, second = x.copy(), x**2
        first[cut] = mean + spread * hazard
        second[cut] = mean**2 + spread**2 + spread * hazard * (x[cut] + mean)
        new = np.average(first, weights=w)
        new_spread = max(0.05, math.sqrt(max(1e-9, np.average(second, weights=w) - new**2)))
        if abs(new - mean) + abs(new_spread - spread) < 1e-6:
            break
        mean, spread = new, new_spread
    return float(mean), float(spread)


def expected_at(lengths: np.ndarray, counts: np.ndarray, usual: np.ndarray, mean: float, spread: float) -> np.ndarray:
    """Texts expected to end at each length uncut: the largest of the fit, the neighbouring lengths' mean and what is usual among sources."""
    x = np.log(lengths)
    total = counts.sum()
    fit = total * np.exp(-0.5 * ((x - mean) / spread) ** 2) / (lengths * spread * math.sqrt(2 * math.pi))
    near = np.empty(len(lengths))
    for i, at in enumerate(lengths):
        a, b = np.searchsorted(lengths, at - 12), np.searchsorted(lengths, at + 12, "right")
        others = np.delete(counts[a:b], i - a)
        others = np.sort(others)[: max(0, len(others) - 2)]  # other limits may stand beside this one
        near[i] = others.sum() / 24
    return np.maximum(np.maximum(fit, near), usual * total)


_LIMIT = "source string, unit string, length long, n_texts long, expected double, p_cut double, mean_log double, spread_log double"


def _limits(pdf: pd.DataFrame) -> pd.DataFrame:
    """Candidate limits of one source and unit from its histogram of ``length, n_texts, usual``."""
    pdf = pdf.sort_values("length")
    columns = [c.split()[0] for c in _LIMIT.split(", ")]
    lengths, counts = pdf.length.to_numpy(np.int64), pdf.n_texts.to_numpy(np.int64)
    usual = pdf.usual.to_numpy(float)
    limits = np.empty(0, np.int64)
    for _ in range(4):
        mean, spread = fit_censored(lengths, counts, limits)
        expected = expected_at(lengths, counts, usual, mean, spread)
        found = lengths[(counts >= LEAST_AT_LIMIT) & (counts > 3 * expected) & (counts > expected + 6 * np.sqrt(expected + 1))]
        if np.array_equal(found, limits):
            break
        limits = found
    at = np.isin(lengths, limits)
    n = int(at.sum())
    same = lambda column: pd.Series([column.iloc[0]] * n, dtype=object)
    return pd.DataFrame({"source": same(pdf.source), "unit": same(pdf.unit), "length": lengths[at], "n_texts": counts[at], "expected": expected[at], "p_cut": np.clip(1 - expected[at] / counts[at], 0.01, 0.99), "mean_log": mean, "spread_log": spread}, columns=columns)


def _calibrate(pdf: pd.DataFrame) -> pd.DataFrame:
    """From a histogram ``source, bin, free, limited`` of open and broken endings, by EM over the free ones: their probability of being cut, and each bin's likelihood ratio.

    Evidence is bounded, so a source has at most 64 bins however many texts it has.
    """
    bins = np.unique(pdf.bin.to_numpy(float))
    at = np.searchsorted(bins, pdf.bin.to_numpy(float))
    code, names = pd.factorize(pdf.source, use_na_sentinel=False)
    n = pdf.free.to_numpy(float)
    cut = 1 / (1 + np.exp(-2 * pdf.bin.to_numpy(float)))
    ratio = np.ones(len(bins))
    for _ in range(25):
        totals = np.bincount(code, n, len(names))
        share = np.clip((np.bincount(code, n * cut, len(names)) + 0.5) / (totals + 1), 1e-4, 1 - 1e-4)[code]
        as_cut, as_whole = (np.bincount(at, n * w, len(bins)) + 0.1 for w in (cut, 1 - cut))
        ratio = np.maximum.accumulate((as_cut / as_cut.sum()) / (as_whole / as_whole.sum()))
        cut = share * ratio[at] / (share * ratio[at] + 1 - share)
    return pd.DataFrame({"source": pdf.source.astype(object), "bin": pdf.bin, "p_free": cut, "log_ratio": np.log(ratio[at])})


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def length_limits(features: DataFrame) -> DataFrame:
    """Candidate limits of each source in characters and bytes; see :data:`_LIMIT`. Counts are of different texts.

    A length that is frequent in most sources comes from their content: the median, over sources, of
    its share is expected in each.
    """
    units = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("n_chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("length")))).alias("u")
    histogram = features.select("source", units).groupBy("source", "u.unit", "u.length").agg(F.count("*").alias("n_texts"))
    sizes = histogram.groupBy("source", "unit").agg(F.sum("n_texts").alias("size")).withColumnsRenamed({"source": "s_", "unit": "u_"})
    sources = sizes.agg(F.countDistinct(F.coalesce("s_", F.lit("\u0000"))).alias("n_sources"))  # one row
    shared = histogram.join(sizes, _same("source", "s_") & (F.col("unit") == F.col("u_"))).select("source", "unit", "length", "n_texts", (F.col("n_texts") / F.col("size")).alias("share"))
    rank = F.col("n_sources") - F.floor((F.col("n_sources") - 1) / 2)  # from the top; absent sources have no share
    nth = F.row_number().over(Window.partitionBy("unit", "length").orderBy(F.desc("share")))
    ranked = shared.withColumn("nth", nth).crossJoin(F.broadcast(sources)).where((F.col("n_sources") > 2) & (F.col("nth") == rank))
    usual = ranked.select(F.col("unit").alias("u_"), F.col("length").alias("l_"), F.col("share").alias("usual"))
    placed = shared.join(usual, (F.col("unit") == F.col("u_")) & (F.col("length") == F.col("l_")), "left").select("source", "unit", "length", "n_texts", F.coalesce("usual", F.lit(0.0)).alias("usual"))
    return placed.groupBy("source", "unit").applyInPandas(_limits, _LIMIT)


def _hashes(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("x"), F.length(text), text).alias("h2")


def judged_texts(rows: DataFrame, source: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Different texts of each source with their probability of being cut, and the sources' limits.

    The first has ``source, h1, h2, n_rows, state, p_cut``, with the hashes that rows of the same text
    have; null and empty texts aren't in it.
    """
    usable = rows.select(F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text")).where("text is not null and length(text) > 0")
    texts = stage(usable.groupBy("source", "text").agg(F.count("*").alias("n_rows")).select("source", "text", *_hashes(F.col("text")), "n_rows"), "texts")
    features = stage(texts.mapInArrow(_features, _FEATURE), "endings")
    limits = stage(length_limits(features), "limits")

    def at(df: DataFrame, unit: str, length: str, name: str) -> DataFrame:
        own = limits.where(F.col("unit") == unit).select(F.col("source").alias("s_"), F.col("length").alias("l_"), F.col("p_cut").alias(name))
        return df.join(own, _same("source", "s_") & (F.col(length) == F.col("l_")), "left").drop("s_", "l_")

    placed = at(at(features, "chars", "n_chars", "by_chars"), "bytes", "n_bytes", "by_bytes").withColumn("p_limit", F.greatest("by_chars", "by_bytes"))
    placed = stage(placed.drop("by_chars", "by_bytes"), "placed")
    flags = placed.select("source", "h1", "h2", (F.col("p_limit") > 0.5).alias("at_limit"))
    marked = texts.select("source", "text", "h1", "h2").join(flags.withColumnRenamed("source", "s_").withColumnsRenamed({"h1": "h1_", "h2": "h2_"}), _same("source", "s_") & (F.col("h1") == F.col("h1_")) & (F.col("h2") == F.col("h2_")))
    grams = marked.select("text", F.coalesce("at_limit", F.lit(False)).alias("at_limit")).mapInArrow(_grams, "key long, n long, ends long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))

    # Only open endings need the counts of their five keys.
    open_ = placed.where("state = 1")
    names = ("w3", "c3", "w2", "c2", "w1")
    every_word = rows.sparkSession.range(1).select(F.col("id").alias("key"))  # key 0 counts all words
    wanted = open_.select(F.explode(F.array(*names)).alias("key")).unionByName(every_word).distinct()
    known = stage(grams.join(wanted, "key"), "grams")
    total = known.where("key = 0").select(F.col("n").alias("all_words"))
    long = open_.select("source", "h1", "h2", F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("key")) for c in names))).alias("k")).select("source", "h1", "h2", "k.name", "k.key")
    counted = long.join(known, "key").groupBy("source", "h1", "h2").pivot("name", list(names)).agg(F.first(F.struct("n", "ends")))
    counted = counted.select(F.col("source").alias("s_"), F.col("h1").alias("h1_"), F.col("h2").alias("h2_"), *(F.coalesce(F.col(c)["ends" if c[0] == "w" else "n"], F.lit(0)).alias("n_" + c) for c in names))
    joined = placed.join(counted, _same("source", "s_") & (F.col("h1") == F.col("h1_")) & (F.col("h2") == F.col("h2_")), "left").drop("s_", "h1_", "h2_").crossJoin(F.broadcast(total))  # one row
    taught = (F.col("teaches") & ~F.coalesce(F.col("p_limit") > 0.5, F.lit(False))).cast("int")
    others = lambda c, own: F.greatest(F.coalesce(F.col("n_" + c), F.lit(0)) - own, F.lit(0))
    p1 = (others("w1", taught) + 0.01) / (F.col("all_words") + 1)
    p2 = (others("w2", taught) + BACKOFF * p1) / (others("c2", F.lit(1)) + BACKOFF)
    p3 = (others("w3", taught) + BACKOFF * p2) / (others("c3", F.lit(1)) + BACKOFF)
    by_end = F.least(F.greatest(F.log(F.lit(NEUTRAL) / F.greatest(p3, F.lit(1e-9))), F.lit(-MOST)), F.lit(MOST))
    evidence = F.when(F.col("state") == 2, F.lit(2 * MOST)).when(F.col("state") == 1, by_end + F.col("extra")).otherwise(F.lit(-2 * MOST))
    scored = stage(joined.withColumn("evidence", evidence).select("source", "h1", "h2", "n_rows", "state", "p_limit", "evidence", (F.round(F.col("evidence") * 2) / 2).alias("bin")), "scored")
    bins = scored.where("state > 0").groupBy("source", "bin").agg(F.sum(F.col("p_limit").isNull().cast("long")).alias("free"), F.sum(F.col("p_limit").isNotNull().cast("long")).alias("limited"))
    one = bins.groupBy(F.lit(1).alias("all"))  # one row for each source and bin
    known_bins = one.applyInPandas(lambda pdf: _calibrate(pdf), "source string, bin double, p_free double, log_ratio double").withColumnsRenamed({"source": "s_", "bin": "b_"})
    odds = F.log(F.col("p_limit") / (1 - F.col("p_limit"))) + F.col("log_ratio")
    p_cut = F.when(F.col("state") == 0, 0.0).when(F.col("p_limit").isNotNull(), F.greatest(1 / (1 + F.exp(-odds)), F.col("p_free"))).otherwise(F.col("p_free"))
    judged = scored.join(known_bins, _same("source", "s_") & (F.col("bin") == F.col("b_")), "left").select("source", "h1", "h2", "n_rows", "state", "evidence", "p_limit", p_cut.alias("p_cut"))
    return judged, limits


def truncated_rows(rows: DataFrame, key: str, source: str, text: str, threshold: float = 0.5) -> DataFrame:
    """``<key>`` of every row whose text is more likely cut than not.

    Null and empty texts are no cases; a null source is a source of its own. Repeated rows are judged
    alike. All texts of all sources take part in the statistics.
    """
    judged, _ = judged_texts(rows, source, text)
    cut = judged.where(F.col("p_cut") > threshold).select(F.col("source").alias("s_"), F.col("h1").alias("h1_"), F.col("h2").alias("h2_"))
    named = rows.select(F.col(key).alias(key), F.col(source).cast("string").alias("source_"), *_hashes(F.col(text).cast("string")))
    return named.join(cut, _same("source_", "s_") & (F.col("h1") == F.col("h1_")) & (F.col("h2") == F.col("h2_")), "left_semi").select(key)


def truncation_report(rows: DataFrame, source: str, text: str, threshold: float = 0.5) -> DataFrame:
    """For each source: ``source, n_rows, n_texts_seen, n_truncated, share, char_limits, byte_limits``.

    ``n_rows`` counts all rows, null and empty texts too; ``share`` is of all rows. Limits are listed in order.
    """
    judged, limits = judged_texts(rows, source, text)
    every = rows.select(F.col(source).cast("string").alias("source")).groupBy("source").agg(F.count("*").alias("n_rows"))
    cut = judged.groupBy("source").agg(F.sum("n_rows").alias("n_texts_seen"), F.sum(F.when(F.col("p_cut") > threshold, F.col("n_rows")).otherwise(0)).alias("n_truncated")).withColumnRenamed("source", "s_")
    lists = limits.groupBy("source").agg(*(F.array_sort(F.collect_list(F.when(F.col("unit") == u, F.col("length")))).alias(f"{u[:-1]}_limits") for u in ("chars", "bytes"))).withColumnRenamed("source", "t_")
    zero = F.lit(0).cast("long")
    return (
        every.join(cut, _same("source", "s_"), "left")
        .join(lists, _same("source", "t_"), "left")
        .select("source", "n_rows", F.coalesce("n_texts_seen", zero).alias("n_texts_seen"), F.coalesce("n_truncated", zero).alias("n_truncated"), (F.coalesce("n_truncated", zero) / F.col("n_rows")).alias("share"), *(F.coalesce(c, F.array().cast("array<bigint>")).alias(c) for c in ("char_limits", "byte_limits")))
    )
