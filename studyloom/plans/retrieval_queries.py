"""Queries of retrieval, ranking and evaluation.

Vectors come from ``embeddings``; a query set is every vector whose id is divisible by 100, against
all vectors, and likewise for documents. ``retrieve_pipeline`` begins with a search by words, as there are
no vectors of atoms or learners' queries; the other queries of a learner's ranking begin with ranks by ``ord``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.config import DEFAULT
from studyloom.operators import evaluation as E
from studyloom.operators import graph as G
from studyloom.operators import profile as P
from studyloom.operators import retrieval as V
from studyloom.plans import profile_queries as Q
from studyloom.plans import text_queries as T
from studyloom.plans.tables import table
from studyloom.staging import stage

K = 10


def _vectors(spark, folder):
    return table(spark, folder, "embeddings")


def _asked(df: DataFrame, id_: str) -> DataFrame:
    return df.where(F.col(id_) % 100 == 0)


def vector_normalize(spark, folder):
    unit = V.unit_length(F.col("embedding"))
    return _vectors(spark, folder).select("vec_id", F.round(unit[0], 6).alias("first"), F.round(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))


def _dense(spark, folder, k=K, filters=None):
    v = _vectors(spark, folder)
    return V.dense_topk(_asked(v, "vec_id"), v, "vec_id", "embedding", k, filters)


def dense_topk(spark, folder):
    return _dense(spark, folder).select("query_id", "doc_id", "place", F.round("score", 6).alias("score"))


def hit_rows(spark, folder):
    """Hits with what is stored beside their vectors."""
    v = _vectors(spark, folder).withColumn("text", F.concat(F.lit("вектор "), "vec_id"))
    return V.hits(_dense(spark, folder), v, "vec_id", "text").select("query_id", "place", "doc_id", "text", "meta", F.round("score", 6).alias("score"))


def dense_topk_filtered(spark, folder):
    return _dense(spark, folder, K, ["label"]).select("query_id", "doc_id", "place", F.round("score", 6).alias("score"))


def _multi(spark, folder):
    pieces = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 16 + 1, 16))
    return _vectors(spark, folder).select("vec_id", pieces.alias("pieces"))


def _late(spark, folder, k=K):
    v = _multi(spark, folder)
    return V.late_topk(_asked(v, "vec_id"), v, "vec_id", "pieces", k)


def maxsim_topk(spark, folder):
    """Late interaction, with each vector cut into four."""
    return _late(spark, folder).select("query_id", "doc_id", "place", F.round("score", 6).alias("score"))


def _sparse(spark, folder, k=K, idf=False):
    terms = V.term_weights(table(spark, folder, "documents"), "doc_id", "text", idf=idf)
    return V.sparse_topk(_asked(terms, "id"), terms, k)


def sparse_topk(spark, folder):
    return _sparse(spark, folder).select("query_id", "doc_id", "place", F.round("score", 6).alias("score"))


def sparse_topk_idf(spark, folder):
    return _sparse(spark, folder, idf=True).select("query_id", "doc_id", "place", F.round("score", 6).alias("score"))


def rrf_legs(spark, folder):
    n = V.fetch_limit(K)
    legs = [(_dense(spark, folder, n), DEFAULT.dense_weight), (_late(spark, folder, n), DEFAULT.late_weight)]
    return V.fuse_legs(legs, K).select("query_id", "doc_id", "place", F.round("score", 6).alias("score"))


def rrf_multi_query(spark, folder):
    """One owner for each label of the queries."""
    ranked = _dense(spark, folder, 48).join(_vectors(spark, folder).select(F.col("vec_id").alias("query_id"), F.col("label").alias("owner")), "query_id")
    return V.fuse_queries(ranked, "owner").select("owner", "doc_id", F.round("score", 6).alias("score"))


def rerank_concat(spark, folder):
    return V.rerank([_dense(spark, folder, 20), _late(spark, folder, 20)], K).select("query_id", "doc_id", "place", F.round("score", 6).alias("score"))


def point_count(spark, folder):
    return _vectors(spark, folder).groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims"))


def subtype_jaccard(spark, folder):
    """Likeness of each atom to its dependents."""
    atoms = table(spark, folder, "atoms")
    a, b = (atoms.select(F.col("id").alias(n), F.col("subtypes").alias(f"{n}_s")) for n in ("prereq", "atom"))
    return G.dependents(atoms).join(a, "prereq").join(b, "atom").select("prereq", "atom", F.round(V.subtype_similarity(F.col("prereq_s"), F.col("atom_s")), 6).alias("likeness"))


# --- a learner's ranking ---


def _base(spark, folder) -> DataFrame:
    """In place of a search's scores: the atoms of each learner's most frequent task, ranked by ``ord``."""
    atoms = table(spark, folder, "atoms")
    tasks = Q._errors(spark, folder).groupBy("student_id", "task_number").agg(F.count("*").alias("n"))
    main = tasks.groupBy("student_id").agg(F.max_by("task_number", F.struct("n", "task_number")).alias("task_number"))
    ranked = atoms.select("task_number", F.col("id").alias("atom"), ((F.col("ord") % 36) + 1).alias("place"))
    return main.join(ranked, "task_number").select("student_id", "atom", (1 / (DEFAULT.rrf_k + F.col("place"))).alias("score"))


def _boosted(spark, folder):
    errors = Q._errors(spark, folder)
    atoms = table(spark, folder, "atoms")
    return V.profile_boost(_base(spark, folder), atoms, P.decayed_scores(errors), P.skill_transfer(errors, atoms))


def profile_boost(spark, folder):
    return _boosted(spark, folder).select("student_id", "atom", F.round("score", 6).alias("score"))


def expand_one_pass(spark, folder):
    out = V.expand_once(_boosted(spark, folder), table(spark, folder, "atoms"), Q._weakness(spark, folder))
    return out.select("student_id", "atom", F.round("score", 6).alias("score"))


def _expanded(spark, folder):
    return V.expand(_boosted(spark, folder), table(spark, folder, "atoms"), Q._weakness(spark, folder))


def expand_exact(spark, folder):
    return _expanded(spark, folder).select("student_id", "atom", F.round("score", 6).alias("score"))


def mmr_select(spark, folder):
    return V.diverse(_expanded(spark, folder), table(spark, folder, "atoms")).select("student_id", "atom", "place", F.round("score", 6).alias("score"))


def topo_order(spark, folder):
    atoms = table(spark, folder, "atoms")
    best = V.best_atoms(_boosted(spark, folder), atoms, 12)
    return G.learning_order(best.select("student_id", "atom", "place"), atoms, "student_id")


def _searched(spark, folder, k: int = 12) -> DataFrame:
    """``student_id, atom, score``: reciprocal ranks of the atoms that each of a learner's queries finds by words, summed over the queries."""
    atoms = table(spark, folder, "atoms")
    asked = stage(T.query_set(spark, folder).select("student_id", "query", F.xxhash64("query").alias("query_id")), "asked")
    queries = stage(V.term_weights(asked.select("query_id", "query").distinct(), "query_id", "query"), "query-terms")
    documents = V.term_weights(atoms.select("ord", F.concat_ws("\n", "title", "text").alias("text")), "ord", "text")
    found = V.fuse_legs([(V.sparse_topk(queries, documents, V.fetch_limit(k)), DEFAULT.sparse_weight)], V.fetch_limit(k))
    scores = V.fuse_queries(asked.join(found, "query_id").select("student_id", "doc_id", "place"), "student_id")
    return scores.join(atoms.select(F.col("ord").cast("long").alias("doc_id"), F.col("id").alias("atom")), "doc_id").select("student_id", "atom", "score")


def retrieve_pipeline(spark, folder):
    """From the learners' own queries (:func:`text_queries.query_set`) to atoms in the order of learning."""
    errors, atoms = Q._errors(spark, folder), table(spark, folder, "atoms")
    out = V.retrieve(_searched(spark, folder), atoms, P.decayed_scores(errors), P.skill_transfer(errors, atoms), Q._weakness(spark, folder))
    return out.select("student_id", "place", "atom", F.round("score", 6).alias("score"))


# --- evaluation ---


def _relevant(spark, folder):
    """Vectors of a query's label are relevant to it."""
    v = _vectors(spark, folder)
    q = _asked(v, "vec_id").select(F.col("vec_id").alias("query_id"), "label")
    return q.join(v.select(F.col("vec_id").alias("doc_id"), "label"), "label").where("query_id <> doc_id").select("query_id", "doc_id")


def _metrics(spark, folder):
    return E.ir_metrics(_dense(spark, folder), _relevant(spark, folder))


def ir_metrics(spark, folder):
    return _metrics(spark, folder).select("query_id", "k", *(F.round(m, 6).alias(m) for m in E.METRICS))


def ir_macro_rollup(spark, folder):
    labels = _vectors(spark, folder).select(F.col("vec_id").alias("query_id"), "label")
    return E.macro_averages(_metrics(spark, folder), labels, "label").select("label", "k", "n_queries", *(F.round(m, 6).alias(m) for m in E.METRICS))


def _answers(spark, folder):
    """A judge's answers about learners' best atoms: readable, fenced, empty and broken ones."""
    atoms = table(spark, folder, "atoms")
    best = V.best_atoms(_boosted(spark, folder), atoms, 5).join(atoms.select(F.col("id").alias("atom"), "ord"), "atom")
    score = ((F.col("ord") * 37 + F.col("place") * 11) % 101 / 100).cast("string")
    body = F.concat(F.lit('{"score": '), score, F.lit(', "matched_task_numbers": [1, "2", "x"], "rationale": " ok "}'))
    kind = (F.col("ord") + F.col("place") + F.length("student_id")) % 5
    raw = F.when(kind == 0, "").when(kind == 1, "no json").when(kind == 2, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 3, F.concat(F.lit("Ответ: "), body, F.lit(" конец"))).otherwise(body)
    return best.select("student_id", "atom", "place", score.cast("double").alias("given"), kind.alias("kind"), raw.alias("raw_response"))


def judge_snap(spark, folder):
    out = E.judged(_answers(spark, folder))
    return out.select("student_id", "atom", "kind", "given", "judge_score", "is_relevant", F.array_join("matched_task_numbers", ",").alias("tasks"), "rationale")


def judge_macro_avg(spark, folder):
    per = E.judge_averages(E.judged(_answers(spark, folder)))
    return per.select("student_id", F.round("avg_judge_score", 6).alias("avg_judge_score"), "relevant_count", "retrieved_count", F.round("relevant_ratio", 6).alias("relevant_ratio"))


def judge_overall(spark, folder):
    out = E.judge_overall(E.judge_averages(E.judged(_answers(spark, folder))))
    return out.select("student_count", F.round("overall_avg_judge_score", 6).alias("overall_avg_judge_score"), "total_relevant", "total_retrieved", F.round("relevant_ratio", 6).alias("relevant_ratio"))


def _graded(spark, folder):
    """Graded notes: three measures of each, some with an error."""
    d = table(spark, folder, "documents")
    part = lambda salt: (F.col("doc_id") * salt % 101) / 100
    return d.select("doc_id", part(7).alias("personalization"), part(13).alias("school_format"), part(29).alias("math_correctness"), (F.col("doc_id") % 9 == 0).alias("has_error"))


def geval_excl_errors(spark, folder):
    out = E.document_scores(_graded(spark, folder), ("personalization", "school_format", "math_correctness"))
    return out.select("student_count", "excluded_count", *(F.round(c, 6).alias(c) for c in out.columns[2:]))


def dashboard_merge(spark, folder):
    """Stored profiles beside judged ones."""
    left = Q._counts(spark, folder).groupBy("student_id").agg(F.sum("attempts").alias("attempts")).where("attempts > 20")
    right = E.judge_averages(E.judged(_answers(spark, folder))).select("student_id", "relevant_count").where("relevant_count > 1")
    return E.merge_students(left, right)


def dashboard_summary(spark, folder):
    documents = E.document_scores(_graded(spark, folder), ("personalization", "school_format", "math_correctness"))
    judged = E.judge_overall(E.judge_averages(E.judged(_answers(spark, folder))))
    benchmark = E.macro_averages(_metrics(spark, folder), _vectors(spark, folder).select(F.col("vec_id").alias("query_id"), "label"), "label")
    out = E.dashboard_summary(documents, judged, benchmark)
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes if c != "benchmark_cuts"), F.array_join("benchmark_cuts", ",").alias("benchmark_cuts"))


def _tasks(spark, folder):
    return table(spark, folder, "task_bank").select("task_id", "task_number", "subtype")


_UNIVERSAL = {13: ("interval_selection",)}


def label_links(spark, folder):
    return G.label_tasks(table(spark, folder, "atoms"), _tasks(spark, folder), _UNIVERSAL)


def label_totals(spark, folder):
    links = label_links(spark, folder).join(table(spark, folder, "atoms").select(F.col("id").alias("atom"), "task_number"), "atom")
    each = links.groupBy("task_number", "atom").agg(F.count("*").alias("n"))
    return each.groupBy("task_number").agg(F.count("*").alias("n_atoms"), F.sum("n").alias("n_links"), F.round(F.avg("n"), 6).alias("avg_links"))


def labelled_tasks(spark, folder):
    """Tasks with their known atoms; unlabelled tasks are skipped."""
    labels = table(spark, folder, "atom_labels").where("length(trim(task_id)) > 0").select("task_id", "atom_id").distinct()
    return _tasks(spark, folder).join(labels, "task_id").groupBy("task_id").agg(F.count("*").alias("n_atoms"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        vector_normalize, dense_topk, hit_rows, dense_topk_filtered, maxsim_topk, sparse_topk, sparse_topk_idf, rrf_legs, rrf_multi_query, rerank_concat, point_count, subtype_jaccard, profile_boost, expand_one_pass,
        expand_exact, mmr_select, topo_order, retrieve_pipeline, ir_metrics, ir_macro_rollup, judge_snap, judge_macro_avg, judge_overall, geval_excl_errors, dashboard_merge, dashboard_summary, label_links, label_totals, labelled_tasks,
    )
}

_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1]::double * p[2]::double))"
_NORM = "greatest(sqrt(list_sum(list_transform({0}, lambda x: x::double * x::double))), 1e-12)"
_UNIT = "u as (select vec_id, label, list_transform(embedding, lambda x: x::double / {0}) e from embeddings)".format(_NORM.format("embedding"))
_TOPK = "select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) place from {0} qualify place <= {1}"
_DENSE = f"{_UNIT}, ds as (select q.vec_id query_id, d.vec_id doc_id, round({_DOT.format('q.e', 'd.e')}, 9) score, q.label ql, d.label dl from u q, u d where q.vec_id % 100 = 0 and q.vec_id <> d.vec_id)"
_PIECE = "[e[1:16], e[17:32], e[33:48], e[49:64]]"
_LATE = f"""lv as (select vec_id, {_PIECE.replace("e[", "embedding[")} p from embeddings),
  ls as (select q.vec_id query_id, d.vec_id doc_id, round(list_sum(list_transform(q.p, lambda a: list_max(list_transform(d.p, lambda b: list_sum(list_transform(list_zip(a, b), lambda z: z[1]::double * z[2]::double)))))), 9) score
    from lv q, lv d where q.vec_id % 100 = 0 and q.vec_id <> d.vec_id)"""


def _sparse_sql(idf: bool) -> str:
    weight = "tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / m))" + (" * idf" if idf else "")
    return f"""with b as (select doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '([a-zа-яё0-9]+)', 1), lambda w: length(w) > 1) w from documents),
      m as (select avg(len(w)) m, count(*) total from b), c as (select doc_id, n, term, count(*) tf from (select doc_id, len(w) n, unnest(w) term from b) group by 1, 2, 3),
      f as (select term, ln(1 + (total - count(*) + 0.5) / (count(*) + 0.5)) idf from c, m group by term, total),
      x as (select doc_id, c.term, {weight} wt from c join f using (term), m),
      s as (select q.doc_id query_id, d.doc_id, round(sum(q.wt * d.wt), 9) score from x q join x d using (term) where q.doc_id % 100 = 0 and q.doc_id <> d.doc_id group by 1, 2)
      select query_id, doc_id, place, round(score, 6) score from ({_TOPK.format("s", K)})"""


_FUSED = f"""f as (select query_id, doc_id, round(sum(p), 9) score from (select query_id, doc_id, 0.5 / (10 + place) p from ({_TOPK.format("ds", 48)}) union all
  select query_id, doc_id, 0.5 / (10 + place) from ({_TOPK.format("ls", 48)})) group by 1, 2)"""
_BASE = f"""main as (select student_id, arg_max(task_number, (n, task_number)) task_number from (select student_id, task_number, count(*) n from errors group by 1, 2) group by 1),
  base as (select student_id, id atom, 1.0 / (10 + ord % 36 + 1) score from main join atoms using (task_number)),
  tg as (select id atom, len(error_tags) n, unnest(error_tags) tag from atoms), sk as (select id atom, unnest(shared_skills) skill from atoms),
  tt as (select skill, tag, count(*) n from (select tag, unnest(shared_skills) skill from (select unnest(error_tags) tag, shared_skills from atoms)) group by 1, 2),
  skills as (select student_id, skill, sum(weight * n * 0.3) score from errors join tt using (tag) where tag <> 'unknown' group by 1, 2),
  er as (select student_id, atom, sum(score) err, max(n) n from scores join tg using (tag) group by 1, 2), ss as (select student_id, atom, sum(score) skl from skills join sk using (skill) group by 1, 2),
  boosted as (select student_id, atom, base.score + 0.3 * (coalesce(err, 0) + 0.3 * coalesce(skl, 0)) - case when greatest(0, least(1, 1 - coalesce(err, 0) / greatest(coalesce(n, 1), 1))) > 0.8 then 0.15 else 0 end score
    from base left join er using (student_id, atom) left join ss using (student_id, atom))"""
_ANSWERS = """best as (select student_id, atom, ord, row_number() over (partition by student_id order by round(score, 9) desc, ord) place from boosted join atoms on atoms.id = atom qualify place <= 5),
  ans as (select student_id, atom, (ord * 37 + place * 11) % 101 / 100 given, (ord + place + length(student_id)) % 5 kind from best),
  jud as (select *, case when kind < 2 then 0.0 else list_min(list_transform([0.0, 0.25, 0.5, 0.75, 1.0], lambda x: (round(abs(x - given), 9), x)))[2] end judge_score from ans),
  per as (select student_id, avg(judge_score) a, count(*) filter (judge_score >= 0.2) relevant_count, count(*) retrieved_count from jud group by 1)"""
_HITS = f"""{_DENSE}, r as ({_TOPK.format("ds", K)}), rel as (select q.vec_id query_id, d.vec_id doc_id from embeddings q join embeddings d using (label) where q.vec_id % 100 = 0 and q.vec_id <> d.vec_id),
  cnt as (select query_id, count(*) n from rel group by 1), h as (select query_id, place, row_number() over (partition by query_id order by place) nth from r join rel using (query_id, doc_id)),
  cuts as (select unnest([1, 3, 5, 10]) k),
  m as (select query_id, k, count(place) / k "precision", count(place) / n recall, case when count(place) > 0 then 1.0 else 0.0 end hit, coalesce(1.0 / min(place), 0.0) mrr,
      coalesce(sum(nth / place), 0) / least(k, n) map, coalesce(sum(1 / log2(place + 1)), 0) / list_sum(list_transform(range(1, least(k, n) + 1), lambda i: 1 / log2(i + 1))) ndcg
    from cnt cross join cuts left join h using (query_id) where place is null or place <= k or true group by query_id, k, n)"""
_HITS = _HITS.replace("left join h using (query_id) where place is null or place <= k or true", "left join h on h.query_id = cnt.query_id and h.place <= cuts.k").replace("m as (select query_id,", "m as (select cnt.query_id,").replace("group by query_id, k, n)", "group by cnt.query_id, k, n)")
_ROUNDED = ", ".join(f'round("{m}", 6) "{m}"' for m in E.METRICS)
_AVERAGES = ", ".join(f'round(avg("{m}"), 6) "{m}"' for m in E.METRICS)
_GRADED = "g as (select doc_id * 7 % 101 / 100 a, doc_id * 13 % 101 / 100 b, doc_id * 29 % 101 / 100 c, doc_id % 9 = 0 e from documents)"
_LABELS = """own as (select id atom, task_number, subtypes, len(subtypes) = 0 or (task_number = 13 and list_contains(subtypes, 'interval_selection')) wide from atoms),
  matched as (select distinct atom, task_id from (select atom, task_number, unnest(subtypes) s from own where not wide) o join task_bank t on t.task_number = o.task_number and t.subtype = s where length(task_id) > 0),
  links as (select * from matched union all select distinct atom, task_id from own join task_bank t using (task_number) where length(task_id) > 0 and atom not in (select atom from matched))"""

ORACLES: dict[str, str] = {
    "vector_normalize": f"with {_UNIT} select vec_id, round(e[1], 6) first, round(list_sum(list_transform(e, lambda x: x * x)), 6) norm from u",
    "dense_topk": f"with {_DENSE} select query_id, doc_id, place, round(score, 6) score from ({_TOPK.format('ds', K)})",
    "dense_topk_filtered": f"with {_DENSE} select query_id, doc_id, place, round(score, 6) score from ({_TOPK.format('(select * from ds where ql = dl)', K)})",
    "maxsim_topk": f"with {_LATE} select query_id, doc_id, place, round(score, 6) score from ({_TOPK.format('ls', K)})",
    "sparse_topk": _sparse_sql(False),
    "sparse_topk_idf": _sparse_sql(True),
    "rrf_legs": f"with {_DENSE}, {_LATE}, {_FUSED} select query_id, doc_id, place, round(score, 6) score from ({_TOPK.format('f', K)})",
    "rrf_multi_query": f"with {_DENSE}, r as ({_TOPK.format('ds', 48)}) select label owner, doc_id, round(sum(1.0 / (10 + place)), 6) score from r join embeddings on vec_id = query_id group by 1, 2",
    "rerank_concat": f"""with {_DENSE}, {_LATE}, j as (select *, 0 leg from ({_TOPK.format("ds", 20)}) union all select *, 1 from ({_TOPK.format("ls", 20)})),
      one as (select query_id, doc_id, score, leg, place seen from j qualify row_number() over (partition by query_id, doc_id order by leg, place) = 1)
      select query_id, doc_id, row_number() over (partition by query_id order by score desc, leg, seen, doc_id) place, round(score, 6) score from one qualify place <= 10""",
    "point_count": "select label, count(*) n, max(len(embedding)) dims from embeddings group by 1",
    "subtype_jaccard": f"""with {Q.EDGES} select prereq, atom, round(case when len(list_distinct(list_concat(a.subtypes, b.subtypes))) > 0 then len(list_intersect(a.subtypes, b.subtypes)) / len(list_distinct(list_concat(a.subtypes, b.subtypes))) else 0.0 end, 6) likeness
      from edges join atoms a on a.id = prereq join atoms b on b.id = atom where prereq <> atom""",
    "profile_boost": f"with {Q.SCORES}, {_BASE} select student_id, atom, round(score, 6) score from boosted",
    "expand_one_pass": f"""with {Q.WEAK}, {_BASE}, {Q.EDGES}, hop as (select atom, prereq, 1 hops from edges union all select a.atom, b.prereq, 2 from edges a join edges b on a.prereq = b.atom),
      parents as (select student_id, atom parent, score s from boosted join atoms on atoms.id = atom qualify row_number() over (partition by student_id order by round(score, 9) desc, ord) <= 12),
      near as (select distinct atom parent, prereq near, 0.05 + 0.03 * len(error_tags) fixed, 0.05 per from hop join atoms on atoms.id = prereq where atom <> prereq union all select prereq, atom, 0.03, 0 from edges where atom <> prereq),
      raised as (select student_id, near atom, s + fixed + per * coalesce(weakness, 0) score from parents join near using (parent) left join weak on weak.student_id = parents.student_id and weak.atom = near)
      select student_id, atom, round(max(score), 6) score from (select student_id, atom, score from boosted union all select * from raised) group by 1, 2""".replace("select student_id, near atom, s", "select parents.student_id, near atom, s"),
    "ir_metrics": f"with {_HITS} select query_id, k, {_ROUNDED} from m",
    "ir_macro_rollup": f"with {_HITS}, l as (select m.*, label from m join embeddings on vec_id = query_id) select label, k, count(*) n_queries, {_AVERAGES} from l group by grouping sets ((label, k), (k))",
    "judge_snap": f"""with {Q.SCORES}, {_BASE}, {_ANSWERS} select student_id, atom, kind, given, judge_score, judge_score >= 0.2 is_relevant, case when kind < 2 then '' else '1,2' end tasks,
      case kind when 0 then 'empty_llm_response' when 1 then 'invalid_json_from_llm' else 'ok' end rationale from jud""",
    "judge_macro_avg": f"with {Q.SCORES}, {_BASE}, {_ANSWERS} select student_id, round(a, 6) avg_judge_score, relevant_count, retrieved_count, round(relevant_count / retrieved_count, 6) relevant_ratio from per",
    "judge_overall": f"with {Q.SCORES}, {_BASE}, {_ANSWERS} select count(*) student_count, round(avg(a), 6) overall_avg_judge_score, sum(relevant_count)::bigint total_relevant, sum(retrieved_count)::bigint total_retrieved, round(sum(relevant_count) / sum(retrieved_count), 6) relevant_ratio from per",
    "dashboard_merge": f"""with {Q.SCORES}, {_BASE}, {_ANSWERS}, {Q.COUNTS}, l as (select student_id, sum(attempts)::bigint attempts from counts group by 1 having sum(attempts) > 20), r as (select student_id, relevant_count from per where relevant_count > 1)
      select student_id, attempts, relevant_count from l full join r using (student_id)""",
    "dashboard_summary": f"""select d.student_count conspect_student_count, d.excluded_count conspect_excluded_count, d.overall_avg_score conspect_overall_avg_score, d.avg_personalization conspect_avg_personalization,
        d.avg_school_format conspect_avg_school_format, d.avg_math_correctness conspect_avg_math_correctness, j.student_count judge_student_count, j.overall_avg_judge_score judge_overall_avg_judge_score,
        coalesce(j.total_relevant, 0) judge_total_relevant, coalesce(j.total_retrieved, 0) judge_total_retrieved, j.relevant_ratio judge_relevant_ratio, (select count(distinct query_id) from (with {_HITS} select query_id from m)) benchmark_evaluated, '1,3,5,10' benchmark_cuts
      from (with {_GRADED} select count(*) filter (not e) student_count, count(*) filter (e) excluded_count, round(avg((a + b + c) / 3) filter (not e), 6) overall_avg_score, round(avg(a) filter (not e), 6) avg_personalization, round(avg(b) filter (not e), 6) avg_school_format, round(avg(c) filter (not e), 6) avg_math_correctness from g) d,
        (with {Q.SCORES}, {_BASE}, {_ANSWERS} select count(*) student_count, round(avg(a), 6) overall_avg_judge_score, sum(relevant_count)::bigint total_relevant, sum(retrieved_count)::bigint total_retrieved, round(sum(relevant_count) / sum(retrieved_count), 6) relevant_ratio from per) j""",
    "hit_rows": f"""select query_id, place, doc_id, 'вектор ' || doc_id as text, case when label is null then '{{}}' else '{{"label":' || label || '}}' end meta, score
      from (with {_DENSE} select query_id, doc_id, place, round(score, 6) score from ({_TOPK.format('ds', K)})) join embeddings on vec_id = doc_id""",
    "geval_excl_errors": f"with {_GRADED} select count(*) filter (not e) student_count, count(*) filter (e) excluded_count, round(avg((a + b + c) / 3) filter (not e), 6) overall_avg_score, round(avg(a) filter (not e), 6) avg_personalization, round(avg(b) filter (not e), 6) avg_school_format, round(avg(c) filter (not e), 6) avg_math_correctness from g",
    "label_links": f"with {_LABELS} select atom, task_id from links",
    "label_totals": f"with {_LABELS} select task_number, count(*) n_atoms, sum(n)::bigint n_links, round(avg(n), 6) avg_links from (select atom, count(*) n from links group by 1) l join atoms on id = atom group by 1",
    "labelled_tasks": "select task_id, count(distinct atom_id) n_atoms from task_bank join atom_labels using (task_id) where length(trim(task_id)) > 0 group by 1",
}
