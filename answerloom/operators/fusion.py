"""Fusion, cutting, reranking, gating and budgeting of candidate lists, for all queries at once.

Candidates are rows keyed by (query_id, chunk_key); a query has at most a few times ``fetch_k`` of them. Every step
is a window over ``query_id`` or a fold over one query's short array, so one exchange by ``query_id`` serves them all.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from answerloom.functions import text as T

# --- fixed values -----------------------------------------------------------------------------------------------
RRF_K = 60
W_CONTENT, W_SECTION, W_VECTOR = 0.60, 0.25, 0.15
BLEND_RERANK, BLEND_FUSED = 0.70, 0.30
REASON_VECTOR = "vector_score_above_threshold"
REASON_KEYWORD = "keyword_coverage_above_threshold"
REASON_NO_CANDIDATES = "no_candidates"
REASON_BELOW = "below_all_thresholds"
# ----------------------------------------------------------------------------------------------------------------


def by_query(within: Sequence[str] = ()):
    """Rows of one query; ``within`` names flags that separate its rows (all of them stay in the query's partition)."""
    return W.partitionBy("query_id", *within)


def minmax(value: Column, within: Sequence[str] = ()) -> Column:
    """Scale to [0, 1] inside the query; a span of at most 1e-12 gives 1.0. NULLs stay out and stay NULL."""
    low, high = F.min(value).over(by_query(within)), F.max(value).over(by_query(within))
    return F.when(value.isNotNull(), F.when(high - low <= 1e-12, 1.0).otherwise((value - low) / (high - low)))


def rank_of(score: Column, key: str = "chunk_key", present: Column | None = None, within: Sequence[str] = ()) -> Column:
    """Unique 1-based rank by (score desc, key); rows outside ``present`` get NULL."""
    rank = F.row_number().over(by_query(within).orderBy(score.desc_nulls_last(), F.asc(key)))
    return rank if present is None else F.when(present, rank)


def merge_recall(vec: DataFrame, bm: DataFrame) -> DataFrame:
    """Union of both recall lists with the scores and ranks of each side; chunks of different collections may share a key."""
    keys = ["query_id", "chunk_key", "kb_id"]
    v = vec.select(*keys, "vector_score", "vector_rank").alias("v")
    b = bm.select(*keys, "bm25_score", "bm25_rank").alias("b")
    same = (F.col("v.query_id") == F.col("b.query_id")) & (F.col("v.chunk_key") == F.col("b.chunk_key")) & F.col("v.kb_id").eqNullSafe(F.col("b.kb_id"))
    both = [F.coalesce(f"v.{c}", f"b.{c}").alias(c) for c in keys]
    return v.join(b, same, "full_outer").select(*both, "vector_score", "vector_rank", "bm25_score", "bm25_rank")


def fuse_weighted(df: DataFrame, alpha: float = 0.6, within: Sequence[str] = ()) -> DataFrame:
    """alpha x scaled vector score + (1 - alpha) x scaled keyword score; a missing side counts 0."""
    a = min(max(float(alpha), 0.0), 1.0)
    v = F.coalesce(minmax(F.col("vector_score"), within), F.lit(0.0))
    b = F.coalesce(minmax(F.col("bm25_score"), within), F.lit(0.0))
    return df.withColumn("fused", a * v + (1 - a) * b)


def fuse_rrf(
    df: DataFrame, scores: Sequence[str] = ("vector_score", "bm25_score"), k: int = RRF_K, within: Sequence[str] = ()
) -> DataFrame:
    """Sum of 1 / (k + rank) over the lists a candidate is in; ranks are taken among the given rows."""
    parts = [
        F.coalesce(1.0 / (k + rank_of(F.col(s), present=F.col(s).isNotNull(), within=within)), F.lit(0.0)) for s in scores
    ]
    return df.withColumn("fused", reduce(lambda a, b: a + b, parts))


def fuse_lists(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """RRF of any number of lists given as rows (query_id, list, chunk_key, score)."""
    rank = F.row_number().over(W.partitionBy("query_id", "list").orderBy(F.desc("score"), F.asc("chunk_key")))
    return lists.withColumn("r", rank).groupBy("query_id", "chunk_key").agg(F.sum(1.0 / (k + F.col("r"))).alias("fused"))


def normalize_scores(df: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    return df.withColumn("score", F.round(minmax(F.col("fused"), within), 6)).withColumn("fused_score", F.round("fused", 8))


def autocut(
    df: DataFrame, ratio: float = 0.35, min_keep: int = 1, max_keep: int | None = None, within: Sequence[str] = ()
) -> DataFrame:
    """Flag the prefix whose score is at least ``ratio`` of the best one: column ``kept``.

    Scores are sorted, so the prefix is every row above the limit. No cut when ``ratio`` or the best score is not
    positive.
    """
    position = rank_of(F.col("score"), within=within)
    top = F.max("score").over(by_query(within))
    above = (F.lit(ratio) <= 0) | (top <= 0) | (F.col("score") >= top * ratio)
    keep = above | (position <= min_keep)
    return df.withColumn("kept", keep if max_keep is None else keep & (position <= max_keep))


def section_text() -> Column:
    return F.concat_ws(
        " ", F.when(F.col("section_path") != "", F.col("section_path")), F.when(F.col("doc_name") != "", F.col("doc_name"))
    )


def heuristic_score() -> Column:
    """0.60 content coverage + 0.25 section and name coverage + 0.15 clamped vector score."""
    vector = F.least(F.greatest(F.coalesce("vector_score", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return W_CONTENT * F.col("keyword_coverage") + W_SECTION * F.col("section_coverage") + W_VECTOR * vector


def blend(df: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Final score: 0.7 rerank (NULL counts 0) + 0.3 fused score scaled within the batch."""
    mixed = BLEND_RERANK * F.coalesce("rerank_score", F.lit(0.0)) + BLEND_FUSED * minmax(F.col("fused_score"), within)
    return df.withColumn("score", F.round(mixed, 6))


def rerank_heuristic(df: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    return blend(df.withColumn("rerank_score", F.round(heuristic_score(), 6)), within)


def rerank_external(df: DataFrame, scores: DataFrame, top_n: int = 10, within: Sequence[str] = ()) -> DataFrame:
    """Rerank with a score table (query_id, rank, score 0 to 10) made by any outside model.

    Ranks refer to the present order. The first ``top_n`` rows take score / 10 clamped to [0, 1], or the heuristic
    score where the table has none; later rows keep NULL. A query without any usable score falls back to the
    heuristic for all its rows.
    """
    ranked = df.withColumn("_rank", rank_of(F.col("score"), within=within))
    usable = scores.filter("rank >= 1 AND score IS NOT NULL").select(
        "query_id", F.col("rank").alias("_rank"), F.col("score").alias("_ext")
    )
    joined = ranked.join(usable, ["query_id", "_rank"], "left")
    given = F.when(F.col("_rank") <= top_n, F.least(F.greatest(F.col("_ext") / 10.0, F.lit(0.0)), F.lit(1.0)))
    any_given = F.max(given.isNotNull()).over(by_query(within))
    own = heuristic_score()
    score = F.when(~any_given, own).otherwise(F.when(F.col("_rank") <= top_n, F.coalesce(given, own)))
    return blend(joined.withColumn("rerank_score", F.round(score, 6)), within).drop("_ext", "_rank")


def passes(v_thr: float, k_thr: float, member: Column) -> Column:
    """Does the query of this row pass the gate? The best signals are taken over its rows in ``member``."""
    vector = F.max(F.when(member, F.col("vector_score"))).over(by_query())
    words = F.max(F.when(member, F.col("keyword_coverage"))).over(by_query())
    return F.coalesce(vector >= v_thr, F.lit(False)) | F.coalesce(words >= k_thr, F.lit(False))


def reason_of(n: Column, vector: Column, words: Column, v_thr: float, k_thr: float) -> Column:
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, REASON_NO_CANDIDATES)
        .when(F.coalesce(vector, F.lit(0.0)) >= v_thr, REASON_VECTOR)
        .when(words >= k_thr, REASON_KEYWORD)
        .otherwise(REASON_BELOW)
    )


def gate(queries: DataFrame, candidates: DataFrame, v_thr: float = 0.60, k_thr: float = 0.40) -> DataFrame:
    """One row per query: passed, reason and the best signals; queries without candidates are reported too."""
    best = candidates.groupBy("query_id").agg(
        F.count("*").alias("_n"),
        F.coalesce(F.max("vector_score"), F.lit(0.0)).alias("best_vector_score"),
        F.max("keyword_coverage").alias("best_keyword_coverage"),
    )
    v, c = F.col("best_vector_score"), F.col("best_keyword_coverage")
    reason = reason_of(F.col("_n"), v, c, v_thr, k_thr)
    return queries.select("query_id").join(best, "query_id", "left").select(
        "query_id",
        reason.isin(REASON_VECTOR, REASON_KEYWORD).alias("passed"),
        reason.alias("reason"),
        F.coalesce(v, F.lit(0.0)).alias("best_vector_score"),
        F.coalesce(c, F.lit(0.0)).alias("best_keyword_coverage"),
    )


def kept_by_budget(items: Column, max_chars: int, min_keep: int = 1) -> Column:
    """Positions kept from an ordered array of structs(pos, len): too long ones are skipped, later ones may fit."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = (F.size(acc.kept) < min_keep) | (acc.used + x.len <= max_chars)
        return F.when(
            fits, F.struct((acc.used + x.len).alias("used"), F.array_append(acc.kept, x.pos).alias("kept"))
        ).otherwise(acc)

    return F.aggregate(items, start, step, lambda acc: acc.kept)


def trim_to_budget(
    df: DataFrame, max_chars: int = 8000, min_keep: int = 1, length: str = "context_chars", within: Sequence[str] = ()
) -> DataFrame:
    """Flag (``fits``) the rows of every query that fit the character budget, in ``rank`` order."""
    item = F.struct(F.col("rank").cast("int").alias("pos"), F.col(length).cast("long").alias("len"))
    items = F.array_sort(F.collect_list(item).over(by_query(within)))
    return df.withColumn("fits", F.array_contains(kept_by_budget(items, max_chars, min_keep), F.col("rank").cast("int")))


# --- several queries or rounds per question ---------------------------------------------------------------------
def merge_candidates(df: DataFrame, cap: int | None = None) -> DataFrame:
    """Best row per (question, key) over several searches, ordered by score; ``cap`` is 3 x top_k in the chain."""
    best = W.partitionBy("question_id", "chunk_key").orderBy(F.desc("score"), F.asc("query_id"))
    once = df.withColumn("_b", F.row_number().over(best)).filter("_b = 1").drop("_b")
    order = W.partitionBy("question_id").orderBy(F.desc("score"), F.asc("chunk_key"))
    ranked = once.withColumn("rank", F.row_number().over(order))
    return ranked if cap is None else ranked.filter(F.col("rank") <= cap)


def normalize_queries(raw: Column, fallback: Column, limit: int = 3) -> Column:
    """Collapsed, non-blank, distinct queries in order, at most ``limit``; the question itself when none is left."""
    cleaned = F.filter(F.transform(F.coalesce(raw, F.array().cast("array<string>")), T.collapse_ws), lambda q: q != "")
    picked = F.slice(F.array_distinct(cleaned), 1, limit)
    question = T.collapse_ws(F.coalesce(fallback, F.lit("")))
    own = F.when(question != "", F.array(question)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(picked) > 0, picked).otherwise(own)


def grade(df: DataFrame, v_thr: float = 0.60, k_thr: float = 0.40, skip_at: int = 3) -> DataFrame:
    """Flag (``relevant``) candidates: all when there are at most three, else by either threshold, else the first."""
    w = W.partitionBy("question_id")
    ok = (F.coalesce("vector_score", F.lit(0.0)) >= v_thr) | (F.col("keyword_coverage") >= k_thr)
    relevant = (F.count("*").over(w) <= skip_at) | ok | (~F.max(ok).over(w) & (F.col("rank") == 1))
    return df.withColumn("relevant", relevant)


def select_contexts(df: DataFrame, fallback: int = 3) -> DataFrame:
    """Relevant candidates, or the best three when none is, by score."""
    some = F.max("relevant").over(W.partitionBy("question_id"))
    chosen = df.withColumn("_some", some).filter(F.when(F.col("_some"), F.col("relevant")).otherwise(F.col("rank") <= fallback))
    order = W.partitionBy("question_id").orderBy(F.desc("score"), F.asc("chunk_key"))
    return chosen.withColumn("rank", F.row_number().over(order)).drop("_some")
