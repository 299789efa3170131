"""Mixing sources to target shares of all tokens.

1. A classifier is fitted on a bounded sample of labelled documents (those with a source): smoothed
   counts of tokens and pairs of tokens for each domain. Every document, with a source or without, gets a posterior over
   domains, a soft membership, from the same tokens that are counted for its size.
2. Nonnegative rates, how often a document is taken in expectation, are fitted by projected gradient
   least squares. Two sets of totals must match the targets: expected tokens of each domain under
   the soft membership, and tokens of each recorded source, which weigh more and are matched
   exactly in the end. Recorded sources say how much of each source there is; the soft membership decides which of
   a source's documents are taken more often, so that the mix also reads as the targets ask. Documents of one
   source and (rounded) posterior share a rate, so an iteration is one small distributed sum over
   groups; every task replays the projected steps from the gradients so far.
3. Rates become whole numbers of copies by a keyed hash; a threshold for each source, found from
   histograms of a fixed size, brings its tokens to the target within about one document.

Documents without a source or of a source that isn't listed have rate 0, since every token of the
mix has to belong to a listed source; how many tokens of them read like each source is reported. The mix
is as large as the scarcest listed source allows when each of its documents is taken ``max_repeats``
times, unless a smaller size is asked for. Listed sources are a setting and are read on the driver, and so are a few
numbers for each of them (sums of a round, thresholds), which go into the next step's expressions; what grows with the
documents isn't. Joins with tables of a row a source would cost the driver a hash table and a thread each.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.llm.tokens import TOKENIZERS, tokenizer
from studyloom.staging import stage

#: Bounds of the sample that the classifier is fitted on: documents, and their longest length in characters. They bound the model's size too.
SAMPLE_TEXTS, SAMPLE_CHARS = 10_000, 4_000
#: Hashed pairs of neighbouring tokens.
PAIRS = 1 << 18
#: Occurrences that the whole sample adds to each domain, and the number of features that a document's evidence counts for at most.
SMOOTH, SHARPNESS = 300.0, 40.0
#: Posteriors are rounded to this many equal steps.
STEPS = 10
#: Weight of recorded sources against soft domains while fitting.
RECORDED = 2.0
#: Iterations with both sets of totals, and at most as many with recorded sources alone; these end when shares are within ``CLOSE``.
BOTH_ROUNDS, LAST_ROUNDS, CLOSE = 12, 10, 1e-5
#: Bins of the histograms that thresholds are found from.
BINS = 2048
#: Rounds that fill what long documents leave open, while it is more than this share of a source's tokens.
FILL_ROUNDS, OPEN = 4, 1e-5
#: Domains up to which the gains of all of them stand in one table; for more, only those that aren't 0 are held.
DOMAINS_AT_ONCE = 64
#: Cells of a table of documents by domains that a task fills at once, at most as many documents, and as many of their features.
CELLS, BATCH, AT_ONCE = 1_000_000, 1_000, 50_000


class Targets(NamedTuple):
    names: list[str]
    shares: np.ndarray
    repeats: np.ndarray


def read_targets(targets: DataFrame) -> Targets:
    """Listed sources in order of name; shares are scaled to sum to 1. A repeated source counts once, with its largest share and fewest repeats."""
    rows = (
        targets.where("source is not null")
        .groupBy("source")
        .agg(F.max(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("share"), F.min(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("repeats"))
        .orderBy("source")
        .collect()
    )
    shares = np.array([r.share for r in rows], float)
    return Targets([r.source for r in rows], shares / (shares.sum() or 1.0), np.array([r.repeats for r in rows], float))


# --- classifier ---


def features_of(ids: np.ndarray, vocabulary: int) -> np.ndarray:
    """Features of a document's token ids: the ids, and behind them hashed pairs of neighbours."""
    ids = np.asarray(ids, np.int64)
    return np.concatenate([ids, vocabulary + (ids[:-1] * 1_000_003 + ids[1:]) % PAIRS])


class Classifier:
    """Posteriors over domains from log probabilities of features, which each domain has in common with the whole sample
    where it lacks its own (Dirichlet smoothing). Evidence is an average over features, times at most :data:`SHARPNESS`.

    Only features and domains that occur together in the sample are held. Domains are places of listed sources; the place
    after the last stands for all other sources.
    """

    def __init__(self, feature: np.ndarray, domain: np.ndarray, count: np.ndarray, documents: dict[int, int], vocabulary: int):
        self.vocabulary, width = vocabulary, vocabulary + PAIRS
        self.domains = np.array(sorted(documents), np.int64)
        code = np.searchsorted(self.domains, domain)
        usual = np.bincount(feature, count, width) + 0.1
        gain = np.log1p(count / (SMOOTH * usual[feature] / usual.sum()))
        known, row = np.unique(feature, return_inverse=True)
        #: Row of each feature in the table of gains; row 0 holds nothing.
        self.row = np.zeros(width, np.int32)
        self.row[known] = np.arange(1, len(known) + 1)
        if len(self.domains) <= DOMAINS_AT_ONCE:
            self.sparse, self.gains = None, np.zeros((len(known) + 1, len(self.domains)), np.float32)
            self.gains[row + 1, code] = gain
        else:
            order = np.argsort(row, kind="stable")
            self.sparse = np.searchsorted(row[order] + 1, np.arange(len(known) + 2)), code[order], gain[order]
        self.unseen = np.log(SMOOTH / (np.bincount(code, count, len(self.domains)) + SMOOTH))
        self.base = np.log(np.array([documents[int(d)] for d in self.domains], float) / max(1, sum(documents.values())))

    def posteriors(self, ids: list[np.ndarray]) -> np.ndarray:
        """Posteriors of documents by their token ids; columns as in :attr:`domains`."""
        width = len(self.domains)
        each = [features_of(i, self.vocabulary) for i in ids]
        sizes = np.array([len(f) for f in each], np.int64)
        features = np.concatenate(each) if each else np.empty(0, np.int64)
        rows, documents = self.row[features], np.repeat(np.arange(len(sizes)), sizes)
        sums = np.zeros(len(sizes) * width)
        for a in range(0, len(rows), AT_ONCE):
            some, of = rows[a : a + AT_ONCE], documents[a : a + AT_ONCE]
            if self.sparse is None:
                begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                sums.reshape(-1, width)[of[begin]] += np.add.reduceat(self.gains[some], begin)
            else:
                first, code, gain = self.sparse
                begin, n = first[some], first[some + 1] - first[some]
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begin, n)
                sums += np.bincount(np.repeat(of * width, n) + code[at], gain[at], len(sums))
        scores = sums.reshape(-1, width)
        scores = scores / np.maximum(sizes, 1)[:, None] + self.unseen
        scores = self.base + scores * np.minimum(SHARPNESS, sizes)[:, None]
        p = np.exp(scores - scores.max(axis=1, keepdims=True)) if width else scores
        return p / p.sum(axis=1, keepdims=True)

    def most_likely(self, ids: list[np.ndarray]) -> list[int]:
        return self.domains[self.posteriors(ids).argmax(axis=1)].tolist()


def _placed(names: list[str], source: Column) -> Column:
    """Place of a listed source, and the place after the last for another one."""
    listed = F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, i))) if names else F.create_map().cast("map<string,int>")
    return F.coalesce(listed[source], F.lit(len(names)))


def fit_classifier(documents: DataFrame, domains: list[str], name: str = "byte_bpe_50k", folder: str = TOKENIZERS, n_texts: int = SAMPLE_TEXTS, n_chars: int = SAMPLE_CHARS) -> Classifier:
    """Token counts of each domain over about ``n_texts`` labelled documents of at most ``n_chars`` characters, chosen by a hash of ``doc_id``."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(name, folder)
        for batch in it:
            each = [features_of(encoder.encode(t), encoder.size) for t in batch.column(1).to_pylist()]
            place = np.repeat(batch.column(0).to_numpy().astype(np.int64), [len(f) for f in each])
            cell, n = np.unique(place * (encoder.size + PAIRS) + (np.concatenate(each) if each else np.empty(0, np.int64)), return_counts=True)
            own, documents = np.unique(batch.column(0).to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(cell, -1 - own.astype(np.int64))), pa.array(np.append(n, documents).astype(np.int64))], ["cell", "n"])

    labelled = documents.where("source is not null and text is not null").where(F.length("text").between(1, n_chars))
    share = max(1, labelled.count() // n_texts)
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select(_placed(domains, F.col("source").cast("string")).alias("place"), F.col("text").cast("string").alias("text"))
    # At most one row for each different feature of a domain in the sample, and only those that occur again.
    cells = sample.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1 or cell < 0").toPandas()
    cell, n, size = cells.cell.to_numpy(np.int64), cells.n.to_numpy(np.int64), tokenizer(name, folder).size
    own, width = cell < 0, size + PAIRS
    return Classifier(cell[~own] % width, cell[~own] // width, n[~own].astype(float), dict(zip((-1 - cell[own]).tolist(), n[own].tolist())), size)


_SOFT = pa.list_(pa.struct([("place", pa.int32()), ("n", pa.int32())]))


def described(documents: DataFrame, names: list[str], classifier: Classifier, name: str, folder: str) -> DataFrame:
    """``doc_id, source, place, n_tokens, soft`` with the posterior over domains in steps of 1/:data:`STEPS`, without those of 0.

    ``place`` is that of the listed source, and the one after the last for no source or another one.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, domains = tokenizer(name, folder), classifier.domains.astype(np.int32)
        listed = {n: i for i, n in enumerate(names)}
        some = max(1, min(BATCH, CELLS // max(1, len(domains))))
        for whole in it:
            for at in range(0, whole.num_rows, some):
                batch = whole.slice(at, some)
                ids = [np.asarray(encoder.encode(t), np.int32) for t in batch.column(2).to_pylist()]
                sizes = np.array([len(i) for i in ids], np.int64)
                soft = np.rint(classifier.posteriors(ids) * STEPS).astype(np.int32)
                row, column = np.nonzero(soft)
                offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
                cells = pa.StructArray.from_arrays([pa.array(domains[column]), pa.array(soft[row, column])], fields=list(_SOFT.value_type))
                place = pa.array([listed.get(s, len(names)) for s in batch.column(1).to_pylist()], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), place, pa.array(sizes), pa.ListArray.from_arrays(offsets, cells)], ["doc_id", "source", "place", "n_tokens", "soft"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, source string, place int, n_tokens long, soft array<struct<place: int, n: int>>")


# --- rates ---


class Steps(NamedTuple):
    """All that a task needs to replay the projected gradient; a few numbers for each listed source."""

    caps: np.ndarray
    supply: np.ndarray  # tokens of each recorded source over the size of the mix
    soft_supply: np.ndarray  # and of each soft domain
    start: np.ndarray
    soft: list[np.ndarray]  # gradient of each round over soft domains
    hard: list[np.ndarray]  # and over recorded sources
    weights: list[tuple[float, float]]

    def rates(self, source: np.ndarray, member: Membership, ahead: bool = False) -> np.ndarray:
        """Rates after the rounds so far; with ``ahead``, where the next gradient is taken (steps are carried on by momentum while both sets are fitted)."""
        r = y = self.start[source]
        cap, supply = self.caps[source], self.supply[source]
        like = member.times(self.soft_supply) if self.soft else supply
        for k, (soft, hard, (a, b)) in enumerate(zip(self.soft, self.hard, self.weights)):
            new = np.clip(y - (a * member.times(soft) + b * hard[source]) / (a * like + b * supply), 0, cap)
            y = new + (k + 1) / (k + 4) * (new - r) if a and k + 1 < BOTH_ROUNDS else new
            r = new
        return y if ahead else r


class Membership:
    """Posteriors of rows, as shares of the places that aren't 0."""

    def __init__(self, soft: pa.Array):
        sizes = np.diff(soft.offsets.to_numpy())
        cells = soft.flatten()
        self.n, self.row = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
        self.place = cells.field(0).to_numpy().astype(np.int64)
        share = cells.field(1).to_numpy().astype(float)
        self.share = share / np.maximum(np.bincount(self.row, share, self.n), 1)[self.row]

    def times(self, of_place: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.share * of_place[self.place], self.n)

    def totals(self, of_row: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.place, self.share * of_row[self.row], width)


def _rate_batches(steps: Steps):
    """Append the rate to batches of ``doc_id, source, place, n_tokens, soft``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            source = batch.column("place").to_numpy().astype(np.int64)
            rates = steps.rates(source, Membership(batch.column("soft"))) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates, pa.float64())], ["doc_id", "source", "place", "n_tokens", "soft", "rate"])

    return run


def _totals(groups: DataFrame, steps: Steps) -> np.ndarray:
    """At the present rates, four rows with a number for each place: tokens by soft domain and by recorded source, and
    the tokens of each source's documents whose rates can still rise, and can fall.

    Each task over the groups sends one row of 32 bytes a place; there is no exchange.
    """
    width = len(steps.caps) + 1

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, width))
        for batch in it:
            if not batch.num_rows:
                continue
            source = batch.column(0).to_numpy().astype(np.int64)
            member = Membership(batch.column(1))
            rates, tokens = steps.rates(source, member, ahead=True), batch.column(2).to_numpy()
            sums[0] += member.totals(rates * tokens, width)
            for row, weight in ((1, rates), (2, rates < steps.caps[source]), (3, rates > 0)):
                sums[row] += np.bincount(source, weight * tokens, width)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])

    out = np.zeros((4, width))
    for r in groups.mapInArrow(run, "sums binary").collect():
        out += np.frombuffer(r.sums).reshape(4, width)
    return out


def fit_rates(groups: DataFrame, targets: Targets, total_tokens: float | None = None) -> tuple[Steps, float, np.ndarray]:
    """Projected gradient over ``groups(place, soft, n_tokens)`` of listed sources: the steps, the size of the mix, and the shares aimed at.

    Shares of sources without tokens or repeats are given to the others in proportion.
    """
    ones = np.ones(len(targets.names))
    every = Steps(ones, ones, ones, ones, [], [], [])
    soft_tokens, tokens = _totals(groups, every)[:2]
    tokens = tokens[:-1]
    usable = (tokens * targets.repeats > 0) & (targets.shares > 0)
    if not usable.any():
        return every._replace(start=np.zeros(len(tokens))), 0.0, np.zeros(len(tokens))
    aim = np.where(usable, targets.shares, 0.0)
    aim = aim / aim.sum()
    size = float(np.min(tokens[usable] * targets.repeats[usable] / aim[usable]))
    size = min(size, total_tokens) if total_tokens else size
    supply = np.where(usable, tokens / size, 1.0)
    caps = np.where(usable, targets.repeats, 0.0)
    start = np.where(usable, np.minimum(np.minimum(1.0, caps), aim / supply), 0.0)
    steps = Steps(caps, supply, soft_tokens / size, start, [], [], [])
    wanted = np.append(aim, 0.0)
    for k in range(BOTH_ROUNDS + LAST_ROUNDS):
        soft, hard, up, down = _totals(groups, steps) / size
        both = k < BOTH_ROUNDS
        off = hard[:-1] - aim
        if not both and np.abs(off).max() < CLOSE:
            break
        free = np.where(off < 0, up[:-1], down[:-1])  # what a step moves, once other rates are at their bounds
        steps.soft.append(soft - wanted)
        steps.hard.append(off if both else off * supply / np.maximum(free, 1e-12))
        steps.weights.append((1.0, RECORDED) if both else (0.0, 1.0))
    return steps, size, aim


# --- copies ---


def _uniform(seed: int) -> Column:
    return (F.xxhash64("doc_id", F.lit(seed)).bitwiseAND(2**52 - 1) + 0.5) / 2.0**52


def _by_place(of_place: np.ndarray) -> Column:
    """A row's number among those of all listed sources, which are one constant of the plan (a literal for each took long for thousands of sources)."""
    return F.get(F.split(F.lit(" ".join(map(repr, of_place.tolist()))), " ").cast("array<double>"), F.col("place"))


def _passed(rated: DataFrame, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Of each source's scores from ``low`` to ``high``, the bin in which its tokens pass ``wanted``: rows ``bin, n, before, every`` with a number for each place.

    ``bin`` is -1 where they never do. A source has at most :data:`BINS` bins, so the window is short.
    """
    score, begin, end = F.col("score"), _by_place(low), _by_place(high)
    inside = rated.where((score >= begin) & (score < end))
    bins = inside.groupBy("place", F.least(F.floor((score - begin) / (end - begin) * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.sum("n_tokens").alias("n"))
    summed = bins.withColumn("so_far", F.sum("n").over(Window.partitionBy("place").orderBy("bin")))
    passing = F.when(F.col("so_far") > _by_place(wanted), F.struct("bin", "n", (F.col("so_far") - F.col("n")).alias("before")))
    found = summed.groupBy("place").agg(F.min(passing).alias("at"), F.sum("n").alias("every"))
    out = np.zeros((4, len(low)))
    out[0] = -1
    for r in found.select("place", "at.*", "every").collect():  # one row a listed source
        out[:, r.place] = (-1, 0, 0, r.every) if r.bin is None else (r.bin, r.n, r.before, r.every)
    return out


def _threshold(rated: DataFrame, wanted: np.ndarray, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each source a score below which its documents have together up to ``wanted`` tokens (or come nearest), and what is left.

    Two histograms of :data:`BINS` bins for each source, the second inside one bin of the first.
    """
    bin_, _, before, every = _passed(rated, np.zeros(len(wanted)), np.ones(len(wanted)), wanted)
    inner, step = bin_ >= 0, 1 / BINS
    if not inner.any():
        return np.ones(len(wanted)), wanted - every
    low, high = np.where(inner, bin_ * step, 2.0), np.where(inner, (bin_ + 1) * step, 3.0)  # scores are below 1
    wanted_inside = wanted - before
    at, n, before, inside = _passed(rated, low, high, wanted_inside)
    left = wanted_inside - np.where(at >= 0, before, inside)
    over = nearest & (at >= 0) & (n - left < left)
    cut = low + (np.where(at >= 0, at, BINS) + over) * ((high - low) / BINS)
    return np.where(inner, cut, 1.0), np.where(inner, left - over * n, wanted - every)


def _taken(rated: DataFrame, wanted: np.ndarray, least: np.ndarray) -> DataFrame:
    """``rated`` with ``extra``: whether a document with a ``score`` is taken once more, so that each source comes to ``wanted`` tokens.

    A long document at the threshold may leave a gap; later rounds fill it with shorter ones.
    """
    extra, open_ = F.lit(False), wanted >= 1
    for k in range(FILL_ROUNDS):
        if not open_.any():
            break
        gap = _by_place(np.where(open_, wanted, 0.0))
        fits = gap > 0 if k == 0 else (gap > 0) & (F.col("n_tokens") <= gap)
        cut, left = _threshold(rated.where(F.col("score").isNotNull() & ~extra & fits).select("place", "score", "n_tokens"), wanted, k + 1 == FILL_ROUNDS)
        extra = extra | F.coalesce(fits & (F.col("score") < _by_place(cut)), F.lit(False))
        wanted, open_ = left, open_ & (left >= least)
    return rated.withColumn("extra", extra)


class Mix(NamedTuple):
    """``documents``: ``doc_id, source, n_copies, n_tokens`` of what is taken; ``shares``: one row for each listed source."""

    documents: DataFrame
    shares: DataFrame


def mix_sources(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 7, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Mix:
    """Choose copies of ``documents(doc_id, source, text)`` so that listed sources have their target shares of all tokens.

    No document is taken more than its source's ``max_repeats`` times. Null and empty texts have no
    tokens and aren't taken; documents without a listed source aren't either. A listed source without
    documents gets no tokens, and the others share its part. ``doc_id`` must be unique. With no
    usable source the mix is empty.
    """
    listed = read_targets(targets)
    classifier = fit_classifier(documents, listed.names, name, folder)
    rows = stage(described(documents, listed.names, classifier, name, folder).where("n_tokens > 0"), "described")
    own = F.col("place") < len(listed.names)
    groups = stage(rows.where(own).groupBy("place", "soft").agg(F.sum("n_tokens").alias("n_tokens")), "groups")
    steps, size, aim = fit_rates(groups, listed, total_tokens)
    kind = documents.schema["doc_id"].dataType.simpleString()
    rated = rows.where(own).mapInArrow(_rate_batches(steps), f"doc_id {kind}, source string, place int, n_tokens long, soft array<struct<place: int, n: int>>, rate double")
    whole = F.floor(F.col("rate") + 1e-9)
    fraction = F.greatest(F.col("rate") - whole, F.lit(0.0))
    rated = rated.withColumn("whole", whole.cast("int")).withColumn("score", F.when(fraction > 1e-9, _uniform(seed) / (_uniform(seed) + fraction)))
    rated = stage(rated.drop("rate"), "rated")
    sure = np.zeros(len(aim))
    for r in rated.groupBy("place").agg(F.sum(F.col("whole") * F.col("n_tokens")).alias("sure")).collect():  # one row a listed source
        sure[r.place] = r.sure
    taken = _taken(rated, np.maximum(aim * size - sure, 0.0), np.maximum(1.0, aim * size * OPEN)).withColumn("n_copies", F.col("whole") + F.col("extra").cast("int")).where("n_copies > 0")
    return Mix(taken.select("doc_id", "source", "n_copies", "n_tokens"), _shares(taken, rows.where(~own), listed, documents.sparkSession))


def _soft_tokens(rows: DataFrame, tokens: Column, name: str) -> DataFrame:
    """Tokens of each domain by soft membership: ``<name>_place, <name>``."""
    every = F.greatest(F.aggregate("soft", F.lit(0), lambda a, x: a + x["n"]), F.lit(1))
    cells = rows.select(tokens.alias("t"), every.alias("every"), F.explode("soft").alias("cell"))
    return cells.groupBy(F.col("cell.place").alias(f"{name}_place")).agg(F.sum(F.col("t") * F.col("cell.n") / F.col("every")).alias(name))


def _shares(taken: DataFrame, others: DataFrame, listed: Targets, spark) -> DataFrame:
    """``source, target_share, actual_share, expected_share, n_documents, n_copies, n_tokens, most_copies, unlisted_tokens``.

    ``actual_share`` is of all tokens of the mix by recorded source, ``expected_share`` by soft membership;
    ``unlisted_tokens`` are tokens of documents without a listed source that read like this one.
    """
    tokens = (F.col("n_copies") * F.col("n_tokens")).alias("t")
    table = spark.createDataFrame([(n, i, float(s)) for i, (n, s) in enumerate(zip(listed.names, listed.shares))], "source string, place int, target_share double")
    hard = taken.select("source", "n_copies", tokens).groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n_copies").alias("n_copies"), F.sum("t").alias("n_tokens"), F.max("n_copies").alias("most_copies")).withColumnRenamed("source", "s_")
    soft, likely = _soft_tokens(taken, F.col("n_copies") * F.col("n_tokens"), "soft_tokens"), _soft_tokens(others, F.col("n_tokens"), "unlisted_tokens")
    every = taken.agg(F.sum(F.col("n_copies") * F.col("n_tokens")).alias("every"))
    zero = F.lit(0).cast("long")
    joined = table.join(hard, F.col("source") == F.col("s_"), "left").join(soft, F.col("place") == F.col("soft_tokens_place"), "left").join(likely, F.col("place") == F.col("unlisted_tokens_place"), "left").crossJoin(F.broadcast(every))  # one row
    return joined.select(
        "source",
        "target_share",
        F.coalesce(F.col("n_tokens") / F.col("every"), F.lit(0.0)).alias("actual_share"),
        F.coalesce(F.col("soft_tokens") / F.col("every"), F.lit(0.0)).alias("expected_share"),
        *(F.coalesce(c, zero).alias(c) for c in ("n_documents", "n_copies", "n_tokens")),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.round(F.coalesce("unlisted_tokens", F.lit(0.0))).cast("long").alias("unlisted_tokens"),
    )
