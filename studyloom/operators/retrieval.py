"""Ranked retrieval: similarity legs, rank fusion, a learner's boost, graph expansion, diversity.

Vectors and token vectors are columns; models are outside. A set of queries is scored against all
documents block by block: a block of queries and a block of documents meet in one task, which keeps
the best of each query, so nothing has to fit on the driver and no pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.config import DEFAULT, Settings
from studyloom.operators.graph import dependents, learning_order, mastery_level, prerequisites
from studyloom.operators.linear_scan import scan_groups

#: Rows of a block of queries and of a block of documents.
QUERY_BLOCK, DOCUMENT_BLOCK = 256, 2048


#: Postings of documents times queries that a task multiplies at once.
POSTINGS_AT_ONCE = 1_000_000


def unit_length(c: Column) -> Column:
    """A vector divided by its length (at least 1e-12)."""
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(c, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))


def _blocks(df: DataFrame, id_: str, rows: int, *columns: str) -> DataFrame:
    """One row for each block of about ``rows`` rows: ids and columns as arrays. Blocks are cut by a hash of the id."""
    count = max(1, -(-df.count() // rows))
    own = df.select(F.col(id_).cast("long").alias("id"), *columns)
    return own.groupBy(F.pmod(F.xxhash64("id"), F.lit(count)).alias("block")).agg(F.collect_list(F.struct("id", *columns)).alias("rows")).select("rows")


def _top(scores: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for i, row in enumerate(scores):
        kept = np.flatnonzero(np.isfinite(row))
        if len(kept) > k:
            edge = np.partition(row[kept], len(kept) - k)[len(kept) - k]
            kept = kept[row[kept] >= edge]  # ties at the edge stay; the final order decides
        yield i, kept


def block_topk(queries: DataFrame, documents: DataFrame, query_id: str, document_id: str, columns: list[str], k: int, score: Callable[[list[dict], list[dict]], np.ndarray]) -> DataFrame:
    """``query_id, doc_id, place, score``: the ``k`` best documents of each query, equal scores by document id.

    ``score(query_rows, document_rows)`` gives a matrix, with NaN where a pair doesn't count. Scores are
    compared to nine decimals.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for q, d in zip(batch.column(0), batch.column(1)):
                q, d = q.as_py(), d.as_py()
                matrix = np.round(np.asarray(score(q, d), float), 9)
                out_q, out_d, out_s = [], [], []
                for i, kept in _top(matrix, k):
                    out_q += [q[i]["id"]] * len(kept)
                    out_d += [d[j]["id"] for j in kept]
                    out_s += matrix[i, kept].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_d, pa.int64()), pa.array(out_s, pa.float64())], ["query_id", "doc_id", "score"])

    q = _blocks(queries, query_id, QUERY_BLOCK, *columns).withColumnRenamed("rows", "q")
    d = _blocks(documents, document_id, DOCUMENT_BLOCK, *columns).withColumnRenamed("rows", "d")
    best = d.crossJoin(q).select("q", "d").mapInArrow(run, "query_id long, doc_id long, score double")  # of blocks, not of rows
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return best.withColumn("place", F.row_number().over(window)).where(F.col("place") <= k).select("query_id", "doc_id", "place", "score")


def hits(ranked: DataFrame, documents: DataFrame, id_: str, text: str) -> DataFrame:
    """``query_id, place, doc_id, text, meta, score`` of a ranking: each hit's text, and its document's other columns as JSON but for vectors and digests."""
    hidden = {id_, text, "content_hash", *(f.name for f in documents.schema if f.dataType.typeName() == "array" and f.dataType.elementType.typeName() in ("float", "double", "array"))}
    rest = [c for c in documents.columns if c not in hidden]
    meta = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    stored = documents.select(F.col(id_).alias("doc_"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), meta.alias("meta"))
    return ranked.join(stored, F.col("doc_id") == F.col("doc_")).select("query_id", "place", "doc_id", "text", "meta", "score")


def dense_topk(queries: DataFrame, documents: DataFrame, id_: str, vector: str, k: int, filters: list[str] | None = None) -> DataFrame:
    """Best documents by cosine. A pair counts only if all ``filters`` columns are equal; a document isn't its own answer."""
    same = list(filters or [])

    def score(q: list[dict], d: list[dict]) -> np.ndarray:
        a, b = (np.array([r[vector] for r in rows], float) for rows in (q, d))
        a, b = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (a, b))
        out = a @ b.T
        out[np.array([r["id"] for r in q])[:, None] == np.array([r["id"] for r in d])[None, :]] = np.nan
        for name in same:
            out[np.array([r[name] for r in q], object)[:, None] != np.array([r[name] for r in d], object)[None, :]] = np.nan
        return out

    usable = F.col(vector).isNotNull() & (F.size(vector) > 0)
    return block_topk(queries.where(usable), documents.where(usable), id_, id_, [vector, *same], k, score)


def term_weights(documents: DataFrame, id_: str, text: str, k1: float = 1.2, b: float = 0.75, idf: bool = False) -> DataFrame:
    """``id, terms, weights``: saturated term counts of each text, by default without inverse document frequency.

    ``terms`` are 64-bit hashes of words of small letters and digits. Counts and the mean length are of all documents.
    """
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-zа-яё0-9]+)"), 1), lambda w: F.length(w) > 1)
    bags = documents.select(F.col(id_).cast("long").alias("id"), words.alias("w")).withColumn("n", F.size("w"))
    mean = bags.agg(F.avg("n").alias("mean"))  # one row
    counts = bags.select("id", "n", F.explode("w").alias("w")).groupBy("id", "n", F.xxhash64("w").alias("term")).agg(F.count("*").alias("tf"))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.greatest("mean", F.lit(1e-9))))
    weighted = counts.crossJoin(F.broadcast(mean)).withColumn("weight", weight)
    if idf:
        total = documents.agg(F.count("*").alias("total"))  # one row
        df = counts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total))
        inverse = F.log(1 + (F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weighted = weighted.join(df.select("term", inverse.alias("idf")), "term").withColumn("weight", F.col("weight") * F.col("idf"))
    packed = weighted.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("t"))
    return packed.select("id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"))


def sparse_topk(queries: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """Best documents by the sum of products of common terms' weights (``id, terms, weights`` each); without a common term there is no hit."""

    def score(q: list[dict], d: list[dict]) -> np.ndarray:
        vocabulary = np.unique(np.concatenate([np.array(r["terms"], np.int64) for r in q]))
        a = np.zeros((len(q), len(vocabulary)))
        for i, r in enumerate(q):
            a[i, np.searchsorted(vocabulary, r["terms"])] = r["weights"]
        out = np.full((len(q), len(d)), np.nan)
        if not len(vocabulary):
            return out
        # Postings of the block's documents, cut to terms that a query has; then as many documents at once as fit.
        sizes = [len(r["terms"]) for r in d]
        owner = np.repeat(np.arange(len(d)), sizes)
        terms, weights = (np.concatenate([np.array(r[c], t) for r in d]) if d else np.empty(0, t) for c, t in (("terms", np.int64), ("weights", float)))
        at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
        hit = vocabulary[at] == terms
        owner, at, weights = owner[hit], at[hit], weights[hit]
        step = max(1, POSTINGS_AT_ONCE // len(q))
        begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, np.int64)
        first = 0
        while first < len(begins):
            last = max(first + 1, int(np.searchsorted(begins, begins[first] + step, "right")) - 1)
            x, y = begins[first], begins[last] if last < len(begins) else len(owner)
            part, starts = a[:, at[x:y]], begins[first:last] - x
            sums = np.add.reduceat(part * weights[x:y], starts, axis=1)
            met = np.logical_or.reduceat(part > 0, starts, axis=1)
            out[:, owner[begins[first:last]]] = np.where(met, sums, np.nan)
            first = last
        out[np.array([r["id"] for r in q])[:, None] == np.array([r["id"] for r in d])[None, :]] = np.nan
        return out

    return block_topk(queries, documents, "id", "id", ["terms", "weights"], k, score)


def late_topk(queries: DataFrame, documents: DataFrame, id_: str, vectors: str, k: int) -> DataFrame:
    """Best documents by late interaction: each query vector's best product with a document vector, summed."""

    def score(q: list[dict], d: list[dict]) -> np.ndarray:
        owner = np.repeat(np.arange(len(d)), [len(r[vectors]) for r in d])
        b = np.array([v for r in d for v in r[vectors]], float)
        starts = np.flatnonzero(np.r_[True, np.diff(owner) != 0])
        out = np.empty((len(q), len(d)))
        for i, r in enumerate(q):
            out[i] = np.maximum.reduceat(np.array(r[vectors], float) @ b.T, starts, axis=1).sum(axis=0)
        out[np.array([r["id"] for r in q])[:, None] == np.array([r["id"] for r in d])[None, :]] = np.nan
        return out

    usable = F.col(vectors).isNotNull() & (F.size(vectors) > 0)
    return block_topk(queries.where(usable), documents.where(usable), id_, id_, [vectors], k, score)


# --- fusion ---


def fetch_limit(k: int, settings: Settings = DEFAULT) -> int:
    """How many documents each leg hands to fusion for ``k`` results."""
    return max(settings.fetch_least, settings.fetch_factor * k)



def fuse_legs(legs: list[tuple[DataFrame, float]], k: int, settings: Settings = DEFAULT) -> DataFrame:
    """``query_id, doc_id, score, place``: weighted reciprocal ranks of several legs, the ``k`` best, equal scores by id."""
    ranked = None
    for leg, weight in legs:
        part = leg.select("query_id", "doc_id", (F.lit(weight) / (settings.rrf_k + F.col("place"))).alias("part"))
        ranked = part if ranked is None else ranked.unionByName(part)
    fused = ranked.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 9).alias("score"))
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return fused.withColumn("place", F.row_number().over(window)).where(F.col("place") <= k)


def fuse_queries(ranked: DataFrame, owner: str, settings: Settings = DEFAULT) -> DataFrame:
    """``<owner>, doc_id, score``: reciprocal ranks summed over the queries of one owner."""
    return ranked.groupBy(owner, "doc_id").agg(F.sum(1 / (settings.rrf_k + F.col("place"))).alias("score"))


def rerank(legs: list[DataFrame], k: int, scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``query_id, doc_id, score, place`` of candidates from all legs, first occurrence kept, ordered by a scorer.

    ``scorer`` takes and returns ``query_id, doc_id, score``; without one the candidates' own scores count.
    """
    joined = None
    for i, leg in enumerate(legs):
        part = leg.select("query_id", "doc_id", "score", F.struct(F.lit(i).alias("leg"), "place").alias("seen"))
        joined = part if joined is None else joined.unionByName(part)
    first = joined.groupBy("query_id", "doc_id").agg(F.min(F.struct("seen", "score")).alias("x")).select("query_id", "doc_id", F.col("x.score").alias("score"), F.col("x.seen").alias("seen"))
    if scorer is not None:
        first = scorer(first.select("query_id", "doc_id", "score")).withColumn("seen", F.lit(0))
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen", "doc_id")
    return first.withColumn("place", F.row_number().over(window)).where(F.col("place") <= k).select("query_id", "doc_id", "score", "place")


# --- a learner's ranking ---


def profile_boost(base: DataFrame, atoms: DataFrame, errors: DataFrame, skills: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``student_id, atom, score``: base scores raised by errors and skills that the atom touches, lowered where it is mastered.

    ``base(student_id, atom, score)``; ``errors(student_id, tag, score)``; ``skills(student_id, skill, score)``.
    """
    tags = atoms.select(F.col("id").alias("atom"), F.size("error_tags").alias("n"), F.explode("error_tags").alias("tag"))
    own = errors.join(tags, "tag").groupBy("student_id", "atom").agg(F.sum("score").alias("err"), F.first("n").alias("n"))
    shared = skills.join(atoms.select(F.col("id").alias("atom"), F.explode("shared_skills").alias("skill")), "skill").groupBy("student_id", "atom").agg(F.sum("score").alias("skl"))
    joined = base.join(own, ["student_id", "atom"], "left").join(shared, ["student_id", "atom"], "left")
    err, skl = F.coalesce("err", F.lit(0.0)), F.coalesce("skl", F.lit(0.0))
    mastered = mastery_level(err / F.greatest(F.coalesce("n", F.lit(1)), F.lit(1))) > settings.mastery_threshold
    score = F.col("score") + settings.profile_weight * (err + settings.skill_factor * skl) - F.when(mastered, settings.mastery_penalty).otherwise(0.0)
    return joined.select("student_id", "atom", score.alias("score"))


def _neighbours(atoms: DataFrame, settings: Settings, task_number: int | None, subtype: str | None) -> DataFrame:
    """``parent, near, place, fixed, per_weakness``: what an atom lends to its prerequisites (nearest first) and its dependents."""
    own = atoms.select("id", "task_number", "subtypes", "ord", F.size("error_tags").alias("n_tags"))
    pre = prerequisites(atoms, 2).select(F.col("atom").alias("parent"), F.col("prereq").alias("near"), "hops").join(own.withColumnRenamed("id", "near"), "near")
    factor = F.lit(1.0) if task_number is None else F.when(F.col("task_number") != task_number, settings.cross_task_factor).otherwise(1.0)
    lent = settings.prereq_bonus * factor
    first = pre.select("parent", "near", F.struct(F.lit(0).alias("kind"), "hops", "ord").alias("place"), (lent + settings.prereq_tag_bonus * F.col("n_tags")).alias("fixed"), lent.alias("per_weakness"))
    dep = dependents(atoms, 1).select(F.col("prereq").alias("parent"), F.col("atom").alias("near"), "hops").join(own.withColumnRenamed("id", "near"), "near")
    if task_number is not None:
        dep = dep.where(F.col("task_number") == task_number)
    if subtype is not None:
        dep = dep.where(F.array_contains("subtypes", subtype))
    second = dep.select("parent", "near", F.struct(F.lit(1).alias("kind"), "hops", "ord").alias("place"), F.lit(settings.dependent_bonus).alias("fixed"), F.lit(0.0).alias("per_weakness"))
    out = first.unionByName(second)
    if task_number is not None:
        out = out.join(atoms.where(F.col("task_number") == task_number).select(F.col("id").alias("parent")), "parent", "left_semi")
    return out


def best_atoms(scores: DataFrame, atoms: DataFrame, n: int) -> DataFrame:
    """The ``n`` best atoms of each learner with ``place``, equal scores in atom order."""
    ordered = scores.join(atoms.select(F.col("id").alias("atom"), "ord"), "atom")
    window = Window.partitionBy("student_id").orderBy(F.desc(F.round("score", 9)), "ord")
    return ordered.withColumn("place", F.row_number().over(window)).where(F.col("place") <= n).select("student_id", "atom", "place", "score")


def expand_once(scores: DataFrame, atoms: DataFrame, weakness: DataFrame, k: int = 12, settings: Settings = DEFAULT) -> DataFrame:
    """``student_id, atom, score``: graph expansion in one pass, all parents lending from their initial scores.

    Differs from :func:`expand` where a parent was raised by an earlier one.
    """
    parents = best_atoms(scores, atoms, max(8, k)).select("student_id", F.col("atom").alias("parent"), F.col("score").alias("s"))
    near = parents.join(_neighbours(atoms, settings, None, None), "parent").join(weakness.select("student_id", F.col("atom").alias("near"), "weakness"), ["student_id", "near"], "left")
    raised = near.select("student_id", F.col("near").alias("atom"), (F.col("s") + F.col("fixed") + F.col("per_weakness") * F.coalesce("weakness", F.lit(0.0))).alias("score"))
    return scores.select("student_id", "atom", "score").unionByName(raised).groupBy("student_id", "atom").agg(F.max("score").alias("score"))


def _fold(rows: list[tuple]) -> list[tuple]:
    """Nodes first, then edges in order of their parents' initial scores; a parent lends from the score it has by then."""
    scores: dict[str, float] = {}
    for _, place, _, _, _, atom, near, score in rows:
        if place is None:
            scores[atom] = score
        elif (raised := scores[atom] + score) > scores.get(near, float("-inf")):
            scores[near] = raised
    return [(rows[0][0], atom, score) for atom, score in scores.items()]


def expand(scores: DataFrame, atoms: DataFrame, weakness: DataFrame, k: int = 12, task_number: int | None = None, subtype: str | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """``student_id, atom, score``: graph expansion in the order of parents, as raised scores are lent on.

    A fold over one learner's candidates: at most a row for each atom and edge of the curated graph.
    """
    parents = best_atoms(scores, atoms, max(8, k)).select("student_id", F.col("atom").alias("parent"), F.col("place").alias("parent_place"))
    near = parents.join(_neighbours(atoms, settings, task_number, subtype), "parent").join(weakness.select("student_id", F.col("atom").alias("near"), "weakness"), ["student_id", "near"], "left")
    bonus = F.col("fixed") + F.col("per_weakness") * F.coalesce("weakness", F.lit(0.0))
    edges_ = near.select("student_id", "parent_place", "place.kind", "place.hops", "place.ord", F.col("parent").alias("atom"), "near", bonus.alias("score"))
    none = [F.lit(None).cast("int").alias(c) for c in ("parent_place", "kind", "hops", "ord")]
    nodes = scores.select("student_id", *none, "atom", F.lit(None).cast("string").alias("near"), "score")
    return scan_groups(nodes.unionByName(edges_), ["parent_place", "kind", "hops", "ord"], "student_id string, atom string, score double", _fold)


def subtype_similarity(a: Column, b: Column) -> Column:
    """Share of common subtypes; 0 where both have none."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def _diverse(k: int, weight: float):
    def fold(rows: list[tuple]) -> list[tuple]:
        owner, scores = rows[0][0], [r[3] for r in rows]
        chosen = list(range(len(rows)))
        if len(rows) > k:
            bit: dict[str, int] = {}
            sets = [sum(1 << bit.setdefault(s, len(bit)) for s in set(r[4] or ())) for r in rows]
            low, high = min(scores), max(scores)
            relevance = [(s - low) / ((high - low) or 1.0) for s in scores]
            nearest, left, chosen = [0.0] * len(rows), list(range(len(rows))), []
            while len(chosen) < k:
                best = max(left, key=lambda i: (round(weight * relevance[i] - (1 - weight) * nearest[i], 12), -i))  # the first of equal ones
                chosen.append(best)
                left.remove(best)
                for i in left:
                    either = (sets[i] | sets[best]).bit_count()
                    if either:
                        nearest[i] = max(nearest[i], (sets[i] & sets[best]).bit_count() / either)
        return [(owner, rows[i][2], n, scores[i]) for n, i in enumerate(chosen, 1)]

    return fold


def diverse(scores: DataFrame, atoms: DataFrame, k: int = 12, settings: Settings = DEFAULT) -> DataFrame:
    """``student_id, atom, place, score``: ``k`` of the ``2k`` best atoms, weighing relevance against likeness of subtypes to those already chosen.

    A choice depends on those before, so it is a fold over at most ``2k`` rows a learner.
    """
    candidates = best_atoms(scores, atoms, 2 * k).join(atoms.select(F.col("id").alias("atom"), "subtypes"), "atom").select("student_id", "place", "atom", "score", "subtypes")
    return scan_groups(candidates, ["place"], "student_id string, atom string, place int, score double", _diverse(k, settings.mmr_lambda))


def retrieve(base: DataFrame, atoms: DataFrame, errors: DataFrame, skills: DataFrame, weakness: DataFrame, k: int = 12, task_number: int | None = None, subtype: str | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """``student_id, place, atom, score``: from fused search scores to an ordered answer: boost, expansion, diversity, prerequisites first."""
    boosted = profile_boost(base, atoms, errors, skills, settings)
    chosen = diverse(expand(boosted, atoms, weakness, k, task_number, subtype, settings), atoms, k, settings)
    ordered = learning_order(chosen, atoms, "student_id")
    return ordered.join(chosen.select("student_id", "atom", "score"), ["student_id", "atom"]).select("student_id", "place", "atom", "score")
