"""Hybrid search of a table of queries: recall on two sides, fusion, cut, rerank, gate and budget in one plan."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, functions as F

from answerloom.functions import text as T
from answerloom.operators import fusion as R
from answerloom.operators.bm25 import B, K1, Bm25Index, bm25_topk
from answerloom.operators.skew import bounded_join, within_bounds
from answerloom.operators.vectors import vector_topk
from answerloom.session import kept

MODES = ("vector", "bm25", "hybrid", "hybrid_rerank")
NO_KB = "no kb specified; vector recall skipped"
NO_VECTOR = "embedding: query has no vector"


@dataclass(frozen=True)
class SearchConfig:
    """Defaults of the service. ``all_kbs`` searches every collection, else each query names its own ``kb_ids``."""

    mode: str = "hybrid_rerank"
    top_k: int = 5
    fetch_k: int = 20
    fusion: str = "rrf"
    alpha: float = 0.6
    rrf_k: int = R.RRF_K
    use_rerank: bool = True
    rerank_top_n: int = 10
    use_autocut: bool = True
    autocut_ratio: float = 0.35
    vector_min_score: float = 0.60
    keyword_min_coverage: float = 0.40
    max_context_chars: int = 8000
    k1: float = K1
    b: float = B
    all_kbs: bool = False

    @property
    def resolved_mode(self) -> str:
        return self.mode.lower() if self.mode.lower() in MODES else "hybrid"

    @property
    def pool(self) -> int:
        return max(self.fetch_k, self.top_k)


@dataclass(frozen=True)
class Corpus:
    """chunks(kb_id, chunk_key, doc_id, chunk_index, content, parent_content, section_path, page_no), the keyword
    index, vectors(kb_id, chunk_key, embedding, metadata...), and documents(doc_id, doc_name, deleted_at)."""

    chunks: DataFrame
    bm25: Bm25Index | None = None
    vectors: DataFrame | None = None
    documents: DataFrame | None = None


@dataclass(frozen=True)
class SearchResult:
    hits: DataFrame
    gate: DataFrame
    debug: DataFrame
    candidates: DataFrame


def recall(
    queries: DataFrame, corpus: Corpus, cfg: SearchConfig, where: Mapping[str, Any] | None = None
) -> DataFrame:
    """Candidates of the sides the mode asks for, with both scores and ranks. ``where`` filters vectors only."""
    mode = cfg.resolved_mode
    listed = "kb_ids" in queries.columns and not cfg.all_kbs
    vec = bm = None
    if mode != "bm25":
        if corpus.vectors is None or (not listed and not cfg.all_kbs):
            vec = _empty(corpus, "vector_score double, vector_rank int", queries)
        elif listed:
            bound = queries.select("query_id", F.explode("kb_ids").alias("kb_id"), "embedding")
            vec = vector_topk(bound, corpus.vectors, cfg.pool, where)
        else:
            vec = vector_topk(queries.select("query_id", "embedding"), corpus.vectors, cfg.pool, where)
    if mode != "vector":
        terms = queries.select("query_id", "question", *(["kb_ids"] if listed else []))
        bm = bm25_topk(terms, corpus.bm25, cfg.pool, cfg.k1, cfg.b)
    if vec is None:
        return bm.withColumns({"vector_score": F.lit(None).cast("double"), "vector_rank": F.lit(None).cast("int")})
    if bm is None:
        return vec.withColumns({"bm25_score": F.lit(None).cast("double"), "bm25_rank": F.lit(None).cast("int")})
    return R.merge_recall(vec, bm)


def _empty(corpus: Corpus, extra: str, queries: DataFrame) -> DataFrame:
    types = {**dict(corpus.chunks.dtypes), **dict(queries.dtypes)}
    schema = f"query_id {types['query_id']}, kb_id {types['kb_id']}, chunk_key {types['chunk_key']}, {extra}"
    return queries.sparkSession.createDataFrame([], schema)


def enrich(candidates: DataFrame, queries: DataFrame, corpus: Corpus, small: bool | None = None) -> DataFrame:
    """Join candidates to live chunks of live documents; ``orphan`` marks keys that have none.

    The candidate keys go to the chunk table (broadcast when they are few), so its wide text column is read in place
    and never shuffled as a whole; the collection is part of the key, which prunes a chunk table partitioned by it.
    Coverage is taken there too, beside the text, in as many tasks as the chunk scan has. The candidates are read twice and
    cost a search of the whole corpus, so they are kept in the shared folder.
    """
    candidates = kept(candidates, "candidates")
    terms = queries.select("query_id", T.query_terms("question").alias("q_terms"))
    keys = bounded_join(
        candidates.select("query_id", "kb_id", "chunk_key"), terms, ["query_id"], spread=["chunk_key"], small_is_small=small
    )
    cols = ["doc_id", "chunk_index", "content", "parent_content", "section_path", "page_no"]
    chunks = corpus.chunks
    if "deleted_at" in chunks.columns:
        chunks = chunks.filter(F.col("deleted_at").isNull())
    has_name = "doc_name" in chunks.columns
    found = bounded_join(
        chunks.select("kb_id", "chunk_key", *cols, *(["doc_name"] if has_name else [])),
        keys, ["kb_id", "chunk_key"], spread=["chunk_key"], small_is_small=small,
    )
    if corpus.documents is not None:
        docs = corpus.documents.filter(F.col("deleted_at").isNull()).select("doc_id", "doc_name")
        found = found.drop("doc_name").join(docs, "doc_id")
    elif not has_name:
        found = found.withColumn("doc_name", F.lit(None).cast("string"))
    context = F.coalesce("parent_content", "content")
    found = found.select(
        "query_id", "kb_id", "chunk_key", "doc_id", "doc_name", "chunk_index", "content", "section_path", "page_no",
        context.alias("context_text"),
        F.char_length(context).alias("context_chars"),
        T.coverage_of(F.col("q_terms"), T.tokenize("content")).alias("keyword_coverage"),
        T.coverage_of(F.col("q_terms"), T.tokenize(R.section_text())).alias("section_coverage"),
    )
    return candidates.join(found, ["query_id", "kb_id", "chunk_key"], "left").withColumn("orphan", F.col("doc_id").isNull())


def rank_candidates(found: DataFrame, cfg: SearchConfig, external: DataFrame | None = None) -> DataFrame:
    """Run enriched candidates through fusion, cut, rerank, gate and budget.

    No row is dropped: the flags ``orphan``, ``kept`` (after the cut), ``top`` (gate open and within ``top_k``) and
    ``fits`` (within the budget) tell how far it came, so hits, gate and counters read one and the same frame. Flags
    only subdivide a query, hence the windows share one exchange by ``query_id``.
    """
    mode = cfg.resolved_mode
    df = found
    side = ["orphan"]
    if mode == "vector":
        df = df.withColumn("fused", F.coalesce("vector_score", F.lit(0.0)))
    elif mode == "bm25":
        df = df.withColumn("fused", F.coalesce("bm25_score", F.lit(0.0)))
    elif cfg.fusion == "weighted":
        df = R.fuse_weighted(df, cfg.alpha, side)
    else:
        df = R.fuse_rrf(df, k=cfg.rrf_k, within=side)
    df = R.normalize_scores(df, side)
    ratio = cfg.autocut_ratio if cfg.use_autocut else 0.0
    df = R.autocut(df, ratio, 1, cfg.pool if cfg.use_autocut else None, side)
    df = df.withColumn("kept", F.col("kept") & ~F.col("orphan"))
    if mode == "hybrid_rerank" and cfg.use_rerank:
        kept = ["kept"]
        df = R.rerank_heuristic(df, kept) if external is None else R.rerank_external(df, external, cfg.rerank_top_n, kept)
    else:
        df = df.withColumn("rerank_score", F.lit(None).cast("double"))
    rank = R.rank_of(F.col("score"), within=["kept"])
    is_open = R.passes(cfg.vector_min_score, cfg.keyword_min_coverage, F.col("kept"))
    df = df.withColumn("rank", rank).withColumn("top", F.col("kept") & is_open & (F.col("rank") <= cfg.top_k))
    df = R.trim_to_budget(df, cfg.max_context_chars, within=["top"])
    return df.withColumn("fits", F.col("top") & F.col("fits"))


def hybrid_search(
    queries: DataFrame,
    corpus: Corpus,
    cfg: SearchConfig = SearchConfig(),
    where: Mapping[str, Any] | None = None,
    external: DataFrame | None = None,
) -> SearchResult:
    """Answer queries(query_id, question, embedding[, kb_ids]) against a corpus.

    Candidates are at most ``2 x fetch_k`` per query. Their order facts: the gate looks at the list after the cut and
    rerank but before ``top_k``; a closed gate empties the hits; coverage reads the chunk, the budget its context.
    A caller that needs several of the results persists ``candidates`` and derives them with ``results_of``.
    """
    n = queries.count()
    small = within_bounds(n * 2 * cfg.pool, n * 2 * cfg.pool * 128)
    found = enrich(recall(queries, corpus, cfg, where), queries, corpus, small)
    return results_of(queries, rank_candidates(found, cfg, external), cfg)


def results_of(queries: DataFrame, ranked: DataFrame, cfg: SearchConfig) -> SearchResult:
    flags = ["section_coverage", "kept", "orphan", "fused", "fits", "top"]
    hits = ranked.filter("fits").drop("rank").withColumn("rank", R.rank_of(F.col("score"))).drop(*flags)
    gates = R.gate(queries, ranked.filter("kept"), cfg.vector_min_score, cfg.keyword_min_coverage)
    return SearchResult(hits, gates, debug_counts(queries, ranked, cfg), ranked)


def debug_counts(queries: DataFrame, ranked: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Stage counters per query; queries that found nothing report zeros, a skipped side reports why."""
    kept = F.col("kept")
    counted = ranked.groupBy("query_id").agg(
        F.count("vector_score").alias("vector_candidates"),
        F.count("bm25_score").alias("bm25_candidates"),
        F.count_if(~F.col("orphan")).alias("fused"),
        F.count_if(kept).alias("after_autocut"),
        F.count_if(kept).alias("after_rerank"),
        F.count_if(F.col("top") & ~F.col("fits")).alias("dropped_by_budget"),
        F.count_if("orphan").alias("dropped_orphans"),
        F.max(F.when(kept, F.col("vector_score"))).alias("_v"),
        F.max(F.when(kept, F.col("keyword_coverage"))).alias("_c"),
    )
    error = F.lit(None).cast("string")
    if cfg.resolved_mode != "bm25":
        if not cfg.all_kbs:
            no_kb = F.size("kb_ids") <= 0 if "kb_ids" in queries.columns else F.lit(True)
            error = F.when(F.coalesce(no_kb, F.lit(True)), NO_KB)
        if "embedding" in queries.columns:
            error = F.when(F.col("embedding").isNull(), NO_VECTOR).otherwise(error)
    joined = queries.select("query_id", error.alias("vector_error")).join(counted, "query_id", "left")
    reason = R.reason_of(F.col("after_autocut"), F.col("_v"), F.col("_c"), cfg.vector_min_score, cfg.keyword_min_coverage)
    zero = F.lit(0).cast("long")
    counts = ["vector_candidates", "bm25_candidates", "fused", "after_autocut", "after_rerank", "dropped_by_budget", "dropped_orphans"]
    out = joined.withColumn("reason", reason).withColumns({c: F.coalesce(c, zero) for c in counts})
    closed = F.when(F.col("reason") == R.REASON_BELOW, F.col("after_autocut")).otherwise(zero)
    return out.select("query_id", *counts, closed.alias("dropped_by_gate"), "vector_error", "reason")


def hit_rows(hits: DataFrame) -> DataFrame:
    """Hits in the shape the search interface returns them."""
    six = {c: F.round(c, 6) for c in ("score", "vector_score", "bm25_score", "rerank_score", "keyword_coverage")}
    return hits.withColumns(six).select(
        "query_id", "rank", "chunk_key", "doc_id", "doc_name", "page_no", "section_path", "content",
        T.snippet("content").alias("snippet"), "score", "vector_score", "bm25_score", "vector_rank", "bm25_rank",
        "rerank_score", "keyword_coverage",
    )


def format_contexts(hits: DataFrame) -> DataFrame:
    """Numbered context block per query: ``[n] (source) text``, separated by blank lines."""
    label = T.source_label(F.col("doc_name"), F.col("doc_id"), F.col("section_path"), F.col("page_no"))
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] （出处："), label, F.lit("）\n"))
    block = F.struct("rank", F.concat(head, T.trim_ws("context_text")).alias("b"))
    ordered = F.array_sort(F.collect_list(block))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x.b), "\n\n").alias("context"))
