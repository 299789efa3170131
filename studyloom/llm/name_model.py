"""A classifier of capitalised words as personal names, for names that no list holds.

It is fitted on labelled rows: runs of two or three capitalised words in all texts, with
the label that the rules of :mod:`studyloom.llm.personal` give (a whole name, or no name). Its features
never say whether a word is in a list of names. They are the spelling of the first and last word, whether
the words occur in small letters too, the endings, and the words around the run. Each row is learned with
all of them, without the spelling, and without the surroundings, so that neither is leaned on alone. A
run is taken for a name if its score exceeds nearly all scores of runs that are none.

Over tables, texts are read once (:func:`studyloom.llm.personal.read_texts`), which leaves a row for each run.
Equal rows are counted, and one task descends over the different ones, a chunk at a time.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from tempfile import TemporaryFile
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm.names import parts
from studyloom.staging import stage

#: Hashed features.
WIDTH = 1 << 15
#: Rows that a step of the fit takes at once, least steps, and least passes over all rows.
CHUNK_ROWS, STEPS, PASSES = 4_096, 300, 4
#: Least steps of fits that only say which labels to leave out.
CLEANING_STEPS = 100
#: Parts of the words, for scores by fits that saw neither of a run's outer words.
FOLDS = 4
#: Rounds in which runs without an item that look like names are left out: more than this share of the names that such fits see for the first time do.
ROUNDS, USUAL = 2, 0.1
#: Least score of a name in logits, whatever the sample says; share of other runs that may lie above.
LEAST, OVER = 0.5, 0.001
#: Labelled names, and other runs, that a fit needs.
LEAST_ROWS = 20
_W = r"(?:[A-Z][a-z]+(?:['’][A-Za-z]+)?(?:-[A-Z][a-z]+)?|[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?)"
RUN = re.compile(rf"(?<![\w.@-]){_W}(?:[^\S\n]{_W})+(?![\w@-])")
#: Where a run can begin; looks for capitals first, which is faster.
_MAY_RUN = re.compile(r"[A-ZА-ЯЁ][a-zа-яё]+(?:['’-][A-Za-zА-Яа-яЁё]+)*(?=[^\S\n][A-ZА-ЯЁ][a-zа-яё])")
_TOKEN = re.compile(r"\w+|[^\w\s]|\n")
_SMALL = re.compile(r"(?<![\w])[a-zа-яё]{2,}(?![\w])")
_BEGINS = re.compile(r"(?:^|[.!?…:;\n])[\s\"«(*_#>–—-]*$")


def _runs_in(text: str) -> Iterator[re.Match[str]]:
    """The matches of :data:`RUN` in a text."""
    at = 0
    while may := _MAY_RUN.search(text, at):
        m = RUN.match(text, may.start())
        at = m.end() if m else may.end()
        if m:
            yield m


class Place(NamedTuple):
    """All capitalised words in a row; ``options`` are the starts and words before of the readings that leave out so many words."""

    begins: bool
    words: tuple[str, ...]
    options: dict[int, tuple[int, tuple[str, ...]]]
    end: int
    after: tuple[str, ...]


def places(text: str) -> Iterator[Place]:
    """Where a text has runs of two or three capitalised words of one script; words in front may be left out where they begin a clause."""
    for m in _runs_in(text):
        at, words = [], []
        for w in _WORD_SPANS.finditer(text, *m.span()):
            at.append(w.span())
            words.append(w.group())
        begins = _BEGINS.search(text, max(0, m.start() - 8), m.start()) is not None
        options = {}
        for skip in range(max(0, len(words) - 3), len(words) - 1 if begins else min(1, len(words) - 1)):
            own = words[skip:]
            if len({w[0].isascii() for w in own}) > 1 or min(map(len, own)) < 2 or max(map(len, own)) < 3:
                continue
            start = at[skip][0]
            options[skip] = start, tuple(t.lower() for t in _TOKEN.findall(text, max(0, start - 40), start)[-2:])
        if options:
            end = at[-1][1]
            yield Place(begins, tuple(words), options, end, tuple(t.lower() for t in _TOKEN.findall(text, end, end + 20)[:1]))


class Run(NamedTuple):
    """A run of capitalised words, and what its features are made of."""

    start: int
    end: int
    words: tuple[str, ...]
    before: tuple[str, ...]
    after: tuple[str, ...]


def _hash(word: str, size: int) -> int:
    return crc32(word.encode("utf-8", "replace")) % size


def word_hash(word: str) -> int:
    """What a word is known by, in small letters or not."""
    return _hash(word.lower().replace("ё", "е"), 1 << 32)


def small_words(views: Iterable[str]) -> set[int]:
    """Hashes of the words that occur in small letters."""
    pieces = {piece for view in views for piece in view.split()}  # no word goes over a blank
    return {word_hash(w) for w in set(_SMALL.findall(" ".join(pieces)))}


class NameModel:
    """Weights of hashed features, the threshold, and the sorted hashes of words that occur in small letters."""

    def __init__(self, small: np.ndarray, weights: np.ndarray, bias: float, threshold: float):
        self.small, self.weights, self.bias, self.threshold = small, weights, bias, threshold

    def known_small(self, word: str) -> bool:
        wanted = word_hash(word)
        at = int(self.small.searchsorted(np.uint32(wanted)))
        return at < len(self.small) and int(self.small[at]) == wanted

    # --- candidates ---

    def readings(self, place: Place) -> list[Run]:
        """Readings of a place; words in front that begin a clause and are written small elsewhere don't count.

        Where three words begin a clause, the last two of them are another reading of the same place.
        """
        words, first = place.words, 0
        while first < len(words) and place.begins and self.known_small(words[first]):
            first += 1
        skips = (first, first + 1) if place.begins and not first and len(words) == 3 else (first,)
        return [Run(place.options[k][0], place.end, words[k:], place.options[k][1], place.after) for k in skips if k in place.options]

    def runs(self, text: str) -> Iterator[list[Run]]:
        """The readings of each place of a text."""
        for place in places(text):
            if readings := self.readings(place):
                yield readings

    def features(self, run: Run) -> tuple[list[int], list[int], list[int]]:
        """Hashed features of spelling, of words as wholes, and of what stands around."""
        words = run.words
        spelling, general = [], [f"script {words[0].isascii()} {len(words)}"]
        for i, word in ((0, words[0]), (1, words[-1])):
            low = word.lower().replace("ё", "е")
            spelling += [f"{i}<{low[:3]}", f"{i}>{low[-1:]}", f"{i}>{low[-2:]}", f"{i}>{low[-3:]}"]
            ending = parts(word) - {"given"}
            general += [f"{i} small {self.known_small(word)}", f"{i} ending {sorted(ending)}"]
        general.append(f"both small {self.known_small(words[0])} {self.known_small(words[-1])} {words[0].isascii()}")
        around = [f"before {t}" for t in run.before[-1:]] + [f"earlier {t}" for t in run.before[:-1]] + [f"after {t}" for t in run.after]
        around.append(f"ends {not run.before} {not run.after}")
        return tuple([_hash(f, WIDTH) for f in group] for group in (spelling, general, around))

    def score(self, run: Run) -> float:
        return float(self.weights[[f for group in self.features(run) for f in group]].sum() + self.bias)

    def names(self, text: str) -> Iterator[tuple[int, int]]:
        """Spans of runs that are taken for names."""
        for readings in self.runs(text):
            score, run = max((self.score(r), r) for r in readings)
            if score > self.threshold:
                yield run.start, run.end


_WORD_SPANS = re.compile(_W)


class _Chunk(NamedTuple):
    """Rows with all features, without the spelling, and without the surroundings: features, and the row of each."""

    cells: np.ndarray
    row: np.ndarray
    labels: np.ndarray
    weight: np.ndarray


def _chunk(groups: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weight: np.ndarray) -> _Chunk:
    """``groups`` are the features of each of the three groups, and how many each row has."""
    n = len(labels)
    rows = [np.repeat(np.arange(n), lengths) for _, lengths in groups]
    kept = [(i, k) for i, keep in enumerate(((0, 1, 2), (1, 2), (0, 1))) for k in keep]
    return _Chunk(np.concatenate([groups[k][0] for _, k in kept]), np.concatenate([rows[k] + i * n for i, k in kept]), np.tile(labels, 3), np.tile(weight, 3))


def _descend(chunks: Callable[[], Iterable[_Chunk]], n_chunks: int, steps: int = STEPS, rate: float = 0.5, decay: float = 2e-3) -> tuple[np.ndarray, float]:
    """Logistic regression by gradient descent with scaled steps; each pass steps once for each chunk."""
    weights, bias = np.zeros(WIDTH), 0.0
    seen, seen_bias = np.full(WIDTH, 1e-6), 1e-6
    for _ in range(steps if n_chunks == 1 else max(PASSES, -(-steps // n_chunks))):
        for cells, row, labels, weight in chunks():
            logits = np.bincount(row, weights[cells], len(labels)) + bias
            off = (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - labels) * weight
            gradient = np.bincount(cells, off[row], WIDTH) + decay / n_chunks * weights
            seen += gradient**2
            seen_bias += off.sum() ** 2
            weights -= rate * gradient / np.sqrt(seen)
            bias -= rate * off.sum() / np.sqrt(seen_bias)
    return weights, bias


# --- tables of runs ---


def label_of(start: int, end: int, spans: list[tuple[int, int, str]]) -> int:
    """1 for a name, 0 for what touches no item, -1 for anything else."""
    if (start, end, "name") in spans:
        return 1
    return -1 if any(a < end and start < b for a, b, _ in spans) else 0


def labelled(readings: list[tuple[Run, int]]) -> list[tuple[Run, int]]:
    """The readings of a place that are names; else the first one, if it is none."""
    return [r for r in readings if r[1] == 1] or [r for r in readings[:1] if r[1] == 0]


def pair_of(run: Run) -> int:
    """The parts that the first and the last word lie in."""
    a, b = sorted(word_hash(w) % FOLDS for w in (run.words[0], run.words[-1]))
    return a * FOLDS + b


def _apart(pair: int) -> list[int]:
    """The pairs that have no part in common with ``pair``."""
    own = {pair // FOLDS, pair % FOLDS}
    rest = [i for i in range(FOLDS) if i not in own]
    return [i * FOLDS + j for i in rest for j in rest if i <= j]


class FoundPlace(NamedTuple):
    """A place, and of each option: its label, whether a name may be there, its first position in the original, and the item. ``end`` is the place's last position there."""

    place: Place
    more: dict[int, tuple[int, bool, int, str]]
    end: int

    def dumps(self) -> str:
        begins, words, options, end, after = self.place
        return json.dumps([begins, words, end, after, self.end, [[skip, *options[skip], *self.more[skip]] for skip in options]])

    @staticmethod
    def loads(text: str) -> FoundPlace:
        begins, words, end, after, last, options = json.loads(text)
        return FoundPlace(Place(begins, tuple(words), {o[0]: (o[1], tuple(o[2])) for o in options}, end, tuple(after)), {o[0]: tuple(o[3:]) for o in options}, last)

    def with_more(self, readings: list[Run]) -> list[tuple[Run, tuple[int, bool, int, str]]]:
        n = len(self.place.words)
        return [(r, self.more[n - len(r.words)]) for r in readings]


_GROUPS = ("spelling", "general", "around")
_COLUMNS = ["words", *_GROUPS, "label", "pair"]
_ROW = pa.schema([("words", pa.string()), *((g, pa.list_(pa.int32())) for g in _GROUPS), ("label", pa.int32()), ("pair", pa.int32())])
_ROWS = ", ".join(["words string", *(f"{g} array<int>" for g in _GROUPS), "label int", "pair int"])


def _row(model: NameModel, run: Run, label: int) -> tuple:
    """The fields of :data:`_ROW`."""
    return " ".join(run.words), *map(tuple, model.features(run)), label, pair_of(run)


def _labelled_rows(model: NameModel):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for text in batch.column(0).to_pylist():
                found = FoundPlace.loads(text)
                rows += [_row(model, r, label) for r, label in labelled([(r, more[0]) for r, more in found.with_more(model.readings(found.place))])]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(_ROW), _ROW)], schema=_ROW)

    return run


def _groups_of(batch: pa.RecordBatch | pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features of each group of a batch, and how many each row has."""
    out = []
    for name in _GROUPS:
        column = batch.column(name)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        out.append((column.flatten().to_numpy(zero_copy_only=False).astype(np.int32), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)))
    return out


def _in_chunks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one fit each, in chunks; a fit's rows stand together."""
    held, n = [], 0
    for batch in it:
        while batch.num_rows:
            fit = batch.column("fit").to_numpy()
            if held and held[0].column("fit")[0].as_py() != fit[0]:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            held.append(batch.slice(0, min(CHUNK_ROWS - n, int((fit != fit[0]).argmax()) or len(fit))))
            n += held[-1].num_rows
            batch = batch.slice(held[-1].num_rows)
            if n == CHUNK_ROWS:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _fit_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A model for each ``fit``; its rows wait in a file, so that a chunk is in memory at a time."""
    for fit, tables in groupby(_in_chunks(it), lambda t: t.column("fit")[0].as_py()):
        with TemporaryFile() as rows:
            n, labels = 0, np.zeros(2)
            for table in tables:
                y = table.column("label").to_numpy()
                for array in (*(a for group in _groups_of(table) for a in group), y.astype(float), table.column("weight").to_numpy()):
                    np.save(rows, array)
                n += 1
                labels += np.bincount(y, table.column("n").to_numpy(), 2)

            def chunks() -> Iterator[_Chunk]:
                rows.seek(0)
                for _ in range(n):
                    arrays = [np.load(rows) for _ in range(8)]
                    yield _chunk(list(zip(arrays[0:6:2], arrays[1:6:2])), *arrays[6:])

            if labels.min() < LEAST_ROWS:
                continue
            only = list(chunks()) if n == 1 else None
            weights, bias = _descend(lambda: only or chunks(), n, STEPS if fit == _WHOLE else CLEANING_STEPS)
        yield pa.RecordBatch.from_arrays([pa.array([fit], pa.int32()), pa.array([weights.tobytes()], pa.binary()), pa.array([bias], pa.float64())], ["fit", "weights", "bias"])


_FITTED = "fit int, weights binary, bias double"
#: The fit over all rows.
_WHOLE = -1


class _Fits:
    """Fitted weights by pair of parts that they saw no word of, or of the whole."""

    def __init__(self, fitted: Iterable):
        self.fits = {fit: (np.frombuffer(bytes(weights)), bias) for fit, weights, bias in fitted}

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        """The scores of rows, by the whole or by the fit for their pair; not a number where there is none."""
        pair = batch.column("pair").to_numpy()
        groups = [(cells, np.repeat(np.arange(len(pair)), lengths)) for cells, lengths in _groups_of(batch)]
        out = np.full(len(pair), np.nan)
        for fit, (weights, bias) in self.fits.items():
            own = np.full(len(pair), True) if fit == _WHOLE else pair == fit
            if own.any():
                out[own] = (sum(np.bincount(row, weights[cells], len(pair)) for cells, row in groups) + bias)[own]
        return out

    def scored(self, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds ``score`` to rows."""
        for batch in it:
            score = self.scores(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, mask=np.isnan(score))], [*batch.schema.names, "score"])


def _score_at(scores: np.ndarray, n: np.ndarray, share: float) -> float:
    """The score, in thousandths, that so large a share of rows lies below."""
    order = np.argsort(scores)
    ends = n[order].cumsum()
    return float(scores[order[ends.searchsorted(min(ends[-1] - 1, int(np.ceil(ends[-1] * share))), "right")]]) / 1000


def fit_on_texts(texts: list[str], find: Callable[[str], list[tuple[int, int, str]]]) -> NameModel | None:
    """Fit on reading forms of a few texts; ``find(text)`` gives start, end and kind of all items by rules. None if there are too few labelled runs.

    Runs that overlap an item in part, or lie in an item of another kind, have no label. Names that the
    rules miss are labelled as none. So a run so labelled is left out if fits that never saw its words
    score it above a tenth of the labelled names (:data:`USUAL`); the last fit is over all that stay.
    """
    model = NameModel(np.sort(np.fromiter(small_words(texts), np.uint32)), np.zeros(WIDTH), 0.0, np.inf)
    counts: Counter[tuple] = Counter()
    for text in texts:
        spans: list[tuple[int, int, str]] | None = None
        for readings in model.runs(text):
            spans = find(text) if spans is None else spans
            counts.update(_row(model, *r) for r in labelled([(r, label_of(r.start, r.end, spans)) for r in readings]))
    rows = [dict(zip(_COLUMNS, row)) | {"n": n} for row, n in counts.items()]
    rounds = ROUNDS
    while True:
        sums, often = np.zeros((2, 2)), Counter()
        for r in rows:
            often[r["words"]] += r["n"]
        for r in rows:
            r["weight"] = r["n"] / often[r["words"]] ** 0.5
            sums[r["label"]] += r["n"], r["weight"]
        if sums[:, 0].min() < LEAST_ROWS:
            return None
        scale = sums[:, 0].sum() / 2 / sums[:, 1]
        fits = [r | {"weight": r["weight"] * scale[r["label"]], "fit": fit} for r in rows for fit in (_apart(r["pair"]) if rounds else [_WHOLE])]
        types = pa.schema([*_ROW, ("n", pa.int64()), ("weight", pa.float64()), ("fit", pa.int32())])
        batches = pa.Table.from_pylist(sorted(fits, key=lambda r: r["fit"]), types).to_batches()
        fitted = _Fits(tuple(c[0].as_py() for c in b.columns) for b in _fit_rows(iter(batches)))
        scores = fitted.scores(pa.RecordBatch.from_pylist(rows, pa.schema([*_ROW, ("n", pa.int64())])))
        y, n = np.array([r["label"] for r in rows]), np.array([r["n"] for r in rows])
        scores = np.ceil(scores * 1000)
        if not rounds:
            break
        known = (y == 1) & ~np.isnan(scores)
        out = (y == 0) & (scores / 1000 >= (_score_at(scores[known], n[known], USUAL) if known.any() else np.inf))
        rows = [r for r, left in zip(rows, out) if not left]
        rounds = rounds - 1 if out.any() else 0
    model.weights, model.bias = fitted.fits[_WHOLE]
    model.threshold = max(LEAST, _score_at(scores[y == 0], n[y == 0], 1 - OVER))
    return model


def fit_on_runs(read: DataFrame) -> NameModel | None:
    """:func:`fit_on_texts` over all texts of a table: ``read(run, hashes)`` has a row for each :class:`FoundPlace`, with
    the hashes of its words, and rows without ``run`` with hashes of words in small letters."""
    seen = read.where("hashes is not null").select(F.col("run").isNotNull().alias("in_run"), F.explode("hashes").alias("hash"))
    small = seen.groupBy("hash").agg(F.bool_or("in_run").alias("a"), F.bool_or(~F.col("in_run")).alias("b")).where("a and b").select("hash").toPandas()
    model = NameModel(np.sort(small.hash.to_numpy().astype(np.uint32)), np.zeros(WIDTH), 0.0, np.inf)
    rows = stage(read.where("run is not null").select("run").mapInArrow(_labelled_rows(model), _ROWS).groupBy(*_COLUMNS).agg(F.count("*").alias("n")), "labelled-runs")
    pairs = [p for p in range(FOLDS * FOLDS) if p // FOLDS <= p % FOLDS]
    apart = F.create_map(*(F.lit(x) if isinstance(x, int) else F.array(*map(F.lit, x)) for p in pairs for x in (p, _apart(p))))

    def scores_of(scored: DataFrame, label: int):
        """Scores in thousandths, of which there are few, and how often they occur."""
        return scored.where((F.col("label") == label) & F.col("score").isNotNull()).groupBy(F.ceil(F.col("score") * 1000).alias("score")).agg(F.sum("n").alias("n")).toPandas()

    rounds = ROUNDS
    while True:
        # A run that occurs again and again counts less each time, and both labels weigh the same in all. Whole numbers add up alike in any order.
        often = rows.groupBy("words").agg(F.sum("n").alias("often"))
        weighed = rows.join(often, "words").withColumn("weight", F.round(F.col("n") / F.sqrt("often") * 1e6).cast("long"))
        sums = {r.label: (r.n, r.weight) for r in weighed.groupBy("label").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).collect()}
        if len(sums) < 2 or min(n for n, _ in sums.values()) < LEAST_ROWS:
            return None
        total = sum(n for n, _ in sums.values())
        scale = F.when(F.col("label") == 1, total / 2 / sums[1][1]).otherwise(total / 2 / sums[0][1])
        fits = weighed.select(*_COLUMNS, "n", (F.col("weight") * scale).alias("weight"), F.explode(apart[F.col("pair")]).alias("fit") if rounds else F.lit(_WHOLE).alias("fit"))
        mixed = fits.repartition(len(pairs) if rounds else 1, "fit").sortWithinPartitions("fit", F.xxhash64(*_COLUMNS), *_COLUMNS)
        fitted = _Fits(mixed.mapInArrow(_fit_rows, _FITTED).collect())
        scored = rows.mapInArrow(fitted.scored, f"{_ROWS}, n long, score double")
        if not rounds:
            break
        scored = stage(scored, "scored-runs")
        names, others = scores_of(scored, 1), scores_of(scored, 0)
        usual = _score_at(names.score.to_numpy(), names.n.to_numpy(), USUAL) if len(names) else np.inf
        rounds = rounds - 1 if (others.score / 1000 >= usual).any() else 0
        rows = scored.where((F.col("label") == 1) | F.col("score").isNull() | (F.ceil(F.col("score") * 1000) / 1000 < float(usual))).select(*_COLUMNS, "n")
    model.weights, model.bias = fitted.fits[_WHOLE]
    others = scores_of(scored, 0)
    model.threshold = max(LEAST, _score_at(others.score.to_numpy(), others.n.to_numpy(), 1 - OVER))
    return model


def names_in_runs(model: NameModel):
    """``key, run`` to ``key, kind, start_pos, end_pos, item`` of what the model takes for names, where no item is."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = FoundPlace.loads(text)
                if readings := found.with_more(model.readings(found.place)):
                    score, _, (_, free, start, item) = max((model.score(r), r, more) for r, more in readings)
                    if free and score > model.threshold:
                        rows.append((key, "name", start, found.end, item))
            types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, types)], ["key", "kind", "start_pos", "end_pos", "item"])

    return run
