"""Queries over fusion, gating and hybrid search: every benchmark text is a question, every document a chunk.

Documents in Spanish count as deleted, so recall meets orphans.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.operators import bm25, fusion as R
from answerloom.operators.vectors import hash_embed
from answerloom.plans import search as S
from answerloom.registry import query
from answerloom.registry.fixtures import BM25_CTE, DIM, coverage_sql, doc_chunks, documents, questions, stored_index, tokens_sql
from answerloom.registry.vectors import hash_cte

CFG = dict(all_kbs=True, keyword_min_coverage=0.6, vector_min_score=0.9)


def parts(spark, sf, keyword=True):
    """Queries with vectors, and the corpus of live documents, with its keyword index unless only vectors are searched."""
    q = questions(spark, sf).withColumn("embedding", hash_embed("question", DIM))
    chunks = doc_chunks(spark, sf)
    docs = documents(spark, sf).withColumn(
        "deleted_at", F.when(F.col("lang") == "es", F.lit("2024-01-01").cast("timestamp"))
    )
    vectors = chunks.select("kb_id", "chunk_key", hash_embed("content", DIM).alias("embedding"))
    index = stored_index(spark, sf) if keyword else None
    return q, S.Corpus(chunks, index, vectors, docs)


def external_scores(q):
    """A score per question and rank from a hash, some above 10."""
    ranks = F.explode(F.sequence(F.lit(1), F.lit(8))).alias("rank")
    text = F.concat_ws(":", F.col("query_id").cast("string"), F.col("rank").cast("string"))
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    return q.select("query_id", ranks).withColumn("score", F.pmod(h, F.lit(12)).cast("double"))


def run(spark, sf, external=False, **cfg):
    q, corpus = parts(spark, sf, cfg.get("mode") != "vector")
    return S.hybrid_search(q, corpus, S.SearchConfig(**{**CFG, **cfg}), external=external_scores(q) if external else None)


NORM = "CASE WHEN {x} IS NULL THEN NULL WHEN max({x}) OVER w - min({x}) OVER w <= 1e-12 THEN 1.0 ELSE ({x} - min({x}) OVER w) / (max({x}) OVER w - min({x}) OVER w) END"

RECALL_CTE = f"""
{BM25_CTE.strip()},
{hash_cte('de', 'documents', 'doc_id').strip()},
{hash_cte('qe', 'benchmark', 'item_id').strip()},
vs AS (SELECT item_id AS query_id, doc_id, round(sum(q.v * d.v), 9) AS s FROM qe q JOIN de d USING (bucket) GROUP BY ALL),
va AS (SELECT b.item_id AS query_id, d.source AS kb_id, d.doc_id || ':0' AS chunk_key, coalesce(s, 0.0) AS vector_score
       FROM benchmark b CROSS JOIN documents d LEFT JOIN vs ON vs.query_id = b.item_id AND vs.doc_id = d.doc_id),
vt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC, chunk_key)::INT AS vector_rank FROM va)
       WHERE vector_rank <= 20),
bt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, chunk_key)::INT AS bm25_rank FROM bm)
       WHERE bm25_rank <= 20)"""


def search_cte(mode: str, fusion: str = "rrf", external: bool = False, k: int = 5, ratio: float = 0.35) -> str:
    """The whole chain as CTEs: cand -> live -> fu -> no -> cut -> rr -> gt -> top -> hits."""
    sides = {
        "vector": "SELECT query_id, kb_id, chunk_key, vector_score, vector_rank, NULL::DOUBLE AS bm25_score, NULL::INT AS bm25_rank FROM vt",
        "bm25": "SELECT query_id, kb_id, chunk_key, NULL::DOUBLE AS vector_score, NULL::INT AS vector_rank, bm25_score, bm25_rank FROM bt",
    }
    cand = sides.get(mode, "SELECT query_id, chunk_key, coalesce(vt.kb_id, bt.kb_id) AS kb_id, vector_score, vector_rank, bm25_score, bm25_rank "
                     "FROM vt FULL JOIN bt USING (query_id, chunk_key)")
    if mode == "vector":
        fused = "vector_score"
    elif mode == "bm25":
        fused = "bm25_score"
    elif fusion == "weighted":
        fused = f"0.6 * coalesce({NORM.format(x='vector_score')}, 0.0) + 0.4 * coalesce({NORM.format(x='bm25_score')}, 0.0)"
    else:
        part = ("coalesce(CASE WHEN {x} IS NOT NULL THEN 1.0 / (60 + row_number() OVER (PARTITION BY query_id "
                "ORDER BY {x} DESC NULLS LAST, chunk_key)) END, 0.0)")
        fused = part.format(x="vector_score") + " + " + part.format(x="bm25_score")
    heur = ("0.60 * cov + 0.25 * seccov + 0.15 * least(greatest(coalesce(vector_score, 0.0), 0.0), 1.0)")
    if mode == "hybrid_rerank" and external:
        score = (f"round(CASE WHEN NOT bool_or(rk <= 10 AND ext IS NOT NULL) OVER w THEN {heur} "
                 f"WHEN rk <= 10 THEN coalesce(least(greatest(ext / 10.0, 0.0), 1.0), {heur}) END, 6)")
    elif mode == "hybrid_rerank":
        score = f"round({heur}, 6)"
    else:
        score = "NULL::DOUBLE"
    # cast first: half-way cases must round by the exact double, as on the other side
    final = (f"round((0.7 * coalesce(rerank_score, 0.0) + 0.3 * ({NORM.format(x='fused_score')}))::DECIMAL(38, 17), 6)::DOUBLE"
             if mode == "hybrid_rerank" else "score")
    return f"""{RECALL_CTE},
cand AS ({cand}),
live AS (SELECT c.*, d.doc_id, d.lang, d.text, {coverage_sql('qt.toks', 'dt.toks')} AS cov,
                {coverage_sql('qt.toks', 'dt.sec')} AS seccov
         FROM cand c JOIN documents d ON c.chunk_key = d.doc_id || ':0' AND d.lang <> 'es'
         JOIN (SELECT item_id, {tokens_sql('text')} AS toks FROM benchmark) qt ON qt.item_id = c.query_id
         JOIN (SELECT doc_id, {tokens_sql('text')} AS toks, {tokens_sql("lang || ' doc_' || doc_id || '.txt'")} AS sec
               FROM documents) dt ON dt.doc_id = d.doc_id),
fu AS (SELECT *, {fused} AS fused FROM live WINDOW w AS (PARTITION BY query_id)),
no AS (SELECT *, round({NORM.format(x='fused')}, 6) AS score, round(fused, 8) AS fused_score FROM fu WINDOW w AS (PARTITION BY query_id)),
cu AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_key) AS rk,
              max(score) OVER (PARTITION BY query_id) AS mx FROM no),
cut AS (SELECT * FROM cu WHERE (mx <= 0 OR score >= mx * {ratio} OR rk <= 1) AND rk <= 20),
ext AS (SELECT item_id AS query_id, rk, (('0x' || substr(md5(item_id || ':' || rk), 1, 15))::BIGINT % 12)::DOUBLE AS ext
        FROM benchmark, range(1, 9) t(rk)),
r1 AS (SELECT cut.*, {score} AS rerank_score FROM cut LEFT JOIN ext USING (query_id, rk) WINDOW w AS (PARTITION BY query_id)),
r2 AS (SELECT * EXCLUDE (score), {final} AS score FROM r1 WINDOW w AS (PARTITION BY query_id)),
gt AS (SELECT item_id AS query_id, count(chunk_key) AS n, coalesce(max(vector_score), 0.0) AS bv, coalesce(max(cov), 0.0) AS bc
       FROM benchmark LEFT JOIN r2 ON r2.query_id = item_id GROUP BY 1),
ga AS (SELECT *, CASE WHEN n = 0 THEN 'no_candidates' WHEN bv >= 0.9 THEN 'vector_score_above_threshold'
              WHEN bc >= 0.6 THEN 'keyword_coverage_above_threshold' ELSE 'below_all_thresholds' END AS reason FROM gt),
tp AS (SELECT * FROM (SELECT r2.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_key)::INT AS rank
              FROM r2 JOIN ga USING (query_id) WHERE reason LIKE '%above_threshold') WHERE rank <= {k}),
fold AS (
  SELECT query_id, rank, length(text) AS used, 1 AS n, true AS fits FROM tp WHERE rank = 1
  UNION ALL
  SELECT t.query_id, t.rank, f.used + CASE WHEN f.used + length(t.text) <= 8000 THEN length(t.text) ELSE 0 END,
         f.n + (f.used + length(t.text) <= 8000)::INT, f.used + length(t.text) <= 8000
  FROM fold f JOIN tp t ON t.query_id = f.query_id AND t.rank = f.rank + 1),
hits AS (SELECT tp.* EXCLUDE (rank), row_number() OVER (PARTITION BY tp.query_id ORDER BY tp.rank)::INT AS rank
         FROM tp JOIN fold USING (query_id, rank) WHERE fits)"""


HIT_COLS = "query_id, rank, chunk_key, doc_id, score, round(vector_score, 6) AS vector_score, round(bm25_score, 6) AS bm25_score, vector_rank, bm25_rank, rerank_score, round(cov, 6) AS keyword_coverage"


def hits_sql(*args, **kw) -> str:
    return f"WITH RECURSIVE {search_cte(*args, **kw)} SELECT {HIT_COLS} FROM hits"


def hits_of(result):
    keep = ["query_id", "rank", "chunk_key", "doc_id", "score", "vector_score", "bm25_score", "vector_rank", "bm25_rank",
            "rerank_score", "keyword_coverage"]
    return S.hit_rows(result.hits).select(*keep)


@query("search_vector", hits_sql("vector"))
def search_vector(spark, sf):
    return hits_of(run(spark, sf, mode="vector"))


@query("search_bm25", hits_sql("bm25"))
def search_bm25(spark, sf):
    return hits_of(run(spark, sf, mode="bm25"))


@query("search_hybrid", hits_sql("hybrid"))
def search_hybrid(spark, sf):
    return hits_of(run(spark, sf, mode="hybrid"))


@query("search_hybrid_weighted", hits_sql("hybrid", "weighted"))
def search_hybrid_weighted(spark, sf):
    return hits_of(run(spark, sf, mode="hybrid", fusion="weighted"))


@query("search_hybrid_rerank", hits_sql("hybrid_rerank"))
def search_hybrid_rerank(spark, sf):
    return hits_of(run(spark, sf, mode="hybrid_rerank"))


@query("search_rerank_external", hits_sql("hybrid_rerank", external=True))
def search_rerank_external(spark, sf):
    return hits_of(run(spark, sf, external=True, mode="hybrid_rerank"))


@query(
    "search_gate",
    f"""WITH RECURSIVE {search_cte('hybrid_rerank')} SELECT query_id, reason LIKE '%above_threshold' AS passed, reason,
        round(bv, 6) AS best_vector_score, round(bc, 6) AS best_keyword_coverage FROM ga""",
)
def search_gate(spark, sf):
    g = run(spark, sf, mode="hybrid_rerank").gate
    return g.withColumns({c: F.round(c, 6) for c in ("best_vector_score", "best_keyword_coverage")})


@query(
    "search_debug",
    f"""WITH RECURSIVE {search_cte('hybrid_rerank')},
        a AS (SELECT query_id, count(vector_score) AS vector_candidates, count(bm25_score) AS bm25_candidates, count(*) AS total FROM cand GROUP BY 1),
        b AS (SELECT query_id, count(*) AS fused FROM live GROUP BY 1), c AS (SELECT query_id, count(*) AS after_autocut FROM cut GROUP BY 1),
        d AS (SELECT query_id, count(*) FILTER (NOT fits) AS db FROM fold GROUP BY 1)
        SELECT ga.query_id, vector_candidates, bm25_candidates, coalesce(fused, 0) AS fused, coalesce(after_autocut, 0) AS after_autocut,
               coalesce(after_autocut, 0) AS after_rerank,
               CASE WHEN reason LIKE '%above_threshold' THEN 0 ELSE coalesce(after_autocut, 0) END AS dropped_by_gate,
               coalesce(db, 0) AS dropped_by_budget, total - coalesce(fused, 0) AS dropped_orphans, NULL AS vector_error, reason
        FROM ga LEFT JOIN a USING (query_id) LEFT JOIN b USING (query_id) LEFT JOIN c USING (query_id) LEFT JOIN d USING (query_id)""",
)
def search_debug(spark, sf):
    return run(spark, sf, mode="hybrid_rerank").debug


@query(
    "recall_merge",
    f"""WITH {RECALL_CTE} SELECT query_id, chunk_key, coalesce(vt.kb_id, bt.kb_id) AS kb_id, round(vector_score, 6) AS vector_score,
        vector_rank, round(bm25_score, 6) AS bm25_score, bm25_rank FROM vt FULL JOIN bt USING (query_id, chunk_key)""",
)
def recall_merge(spark, sf):
    q, corpus = parts(spark, sf)
    merged = S.recall(q, corpus, S.SearchConfig(mode="hybrid", all_kbs=True))
    return merged.withColumns({c: F.round(c, 6) for c in ("vector_score", "bm25_score")})


@query(
    "enriched_orphans",
    f"""WITH {RECALL_CTE} SELECT query_id, count(*) AS candidates, count(*) FILTER (lang = 'es') AS orphans,
        sum(CASE WHEN lang <> 'es' THEN length(text) END)::BIGINT AS context_chars
        FROM (SELECT query_id, chunk_key FROM vt UNION SELECT query_id, chunk_key FROM bt)
        JOIN documents ON chunk_key = doc_id || ':0' GROUP BY 1""",
)
def enriched_orphans(spark, sf):
    q, corpus = parts(spark, sf)
    found = S.enrich(S.recall(q, corpus, S.SearchConfig(mode="hybrid", all_kbs=True)), q, corpus)
    return found.groupBy("query_id").agg(
        F.count("*").alias("candidates"),
        F.count_if("orphan").alias("orphans"),
        F.sum(F.char_length("context_text")).alias("context_chars"),
    )


def event_lists(spark, sf):
    """Two ranked lists per event type: users by summed value and by number of events."""
    from answerloom.registry.fixtures import table

    e = table(spark, sf, "events")
    s = e.groupBy(F.col("event_type").alias("query_id"), F.col("user_id").alias("chunk_key")).agg(
        F.round(F.sum("value"), 2).alias("vector_score"), F.count("*").cast("double").alias("bm25_score")
    )
    return s.withColumn("bm25_score", F.when(F.col("bm25_score") > 1, F.col("bm25_score")))


LIST_CTE = """l AS (SELECT event_type AS query_id, user_id AS chunk_key, round(sum(value), 2) AS vector_score,
     CASE WHEN count(*) > 1 THEN count(*)::DOUBLE END AS bm25_score FROM events GROUP BY ALL)"""


@query(
    "fusion_minmax",
    f"""WITH {LIST_CTE} SELECT query_id, chunk_key, round({NORM.format(x='vector_score')}, 6) AS v,
        round({NORM.format(x='bm25_score')}, 6) AS b FROM l WINDOW w AS (PARTITION BY query_id)""",
)
def fusion_minmax(spark, sf):
    return event_lists(spark, sf).select(
        "query_id", "chunk_key", F.round(R.minmax(F.col("vector_score")), 6).alias("v"),
        F.round(R.minmax(F.col("bm25_score")), 6).alias("b"),
    )


@query(
    "fusion_weighted",
    f"""WITH {LIST_CTE} SELECT query_id, chunk_key, round(0.6 * coalesce({NORM.format(x='vector_score')}, 0.0)
        + 0.4 * coalesce({NORM.format(x='bm25_score')}, 0.0), 6) AS fused FROM l WINDOW w AS (PARTITION BY query_id)""",
)
def fusion_weighted(spark, sf):
    return R.fuse_weighted(event_lists(spark, sf)).select("query_id", "chunk_key", F.round("fused", 6).alias("fused"))


_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY {x} DESC NULLS LAST, chunk_key)"


@query(
    "fusion_rrf",
    f"""WITH {LIST_CTE} SELECT query_id, chunk_key, round(1.0 / (60 + {_RANK.format(x='vector_score')})
        + CASE WHEN bm25_score IS NULL THEN 0.0 ELSE 1.0 / (60 + {_RANK.format(x='bm25_score')}) END, 8) AS fused FROM l""",
)
def fusion_rrf(spark, sf):
    return R.fuse_rrf(event_lists(spark, sf)).select("query_id", "chunk_key", F.round("fused", 8).alias("fused"))


@query(
    "fusion_rrf_lists",
    f"""WITH {LIST_CTE}, u AS (SELECT query_id, 'v' AS list, chunk_key, vector_score AS score FROM l
          UNION ALL SELECT query_id, 'b', chunk_key, bm25_score FROM l WHERE bm25_score IS NOT NULL
          UNION ALL SELECT query_id, 'k', chunk_key, chunk_key::DOUBLE FROM l),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id, list ORDER BY score DESC, chunk_key) AS r FROM u)
        SELECT query_id, chunk_key, round(sum(1.0 / (60 + r)), 8) AS fused FROM r GROUP BY ALL""",
)
def fusion_rrf_lists(spark, sf):
    lists = event_lists(spark, sf)
    named = [("v", F.col("vector_score")), ("b", F.col("bm25_score")), ("k", F.col("chunk_key").cast("double"))]
    rows = [lists.select("query_id", F.lit(n).alias("list"), "chunk_key", c.alias("score")) for n, c in named]
    union = rows[0].unionByName(rows[1]).unionByName(rows[2]).filter("score IS NOT NULL")
    return R.fuse_lists(union).select("query_id", "chunk_key", F.round("fused", 8).alias("fused"))


@query(
    "score_cliff_cut",
    f"""WITH {LIST_CTE}, s AS (SELECT query_id, chunk_key, vector_score AS score,
             row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC, chunk_key) AS rk,
             max(vector_score) OVER (PARTITION BY query_id) AS mx FROM l)
        SELECT query_id, chunk_key, score FROM s WHERE (score >= mx * 0.35 OR rk <= 2) AND rk <= 60""",
)
def score_cliff_cut(spark, sf):
    lists = event_lists(spark, sf).withColumn("score", F.col("vector_score"))
    return R.autocut(lists, 0.35, min_keep=2, max_keep=60).filter("kept").select("query_id", "chunk_key", "score")


@query(
    "budget_trim",
    """WITH RECURSIVE o AS (SELECT conv_id AS query_id, (turn + 1)::INT AS rank, length(text) AS len FROM conversations),
        fold AS (SELECT query_id, rank, len AS used, 1 AS n, true AS fits FROM o WHERE rank = 1
          UNION ALL SELECT o.query_id, o.rank, used + CASE WHEN n < 2 OR used + len <= 700 THEN len ELSE 0 END,
                 n + (n < 2 OR used + len <= 700)::INT, n < 2 OR used + len <= 700
          FROM fold f JOIN o ON o.query_id = f.query_id AND o.rank = f.rank + 1)
       SELECT query_id, rank, fits FROM fold""",
)
def budget_trim(spark, sf):
    from answerloom.registry.fixtures import table

    c = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("query_id"), (F.col("turn") + 1).cast("int").alias("rank"), F.char_length("text").alias("context_chars")
    )
    return R.trim_to_budget(c, 700, min_keep=2).select("query_id", "rank", "fits")


@query(
    "context_block",
    f"""WITH RECURSIVE {search_cte('hybrid_rerank')} SELECT query_id, md5(string_agg('[' || rank || '] （出处：doc_' || doc_id || '.txt > '
        || lang || '）' || chr(10) || trim(text, E' \\t\\n\\r'), chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM hits GROUP BY 1""",
)
def context_block(spark, sf):
    block = S.format_contexts(run(spark, sf, mode="hybrid_rerank").hits)
    return block.select("query_id", F.md5("context").alias("context_md5"))
