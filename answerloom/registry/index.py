"""Queries over the keyword index."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.operators import bm25
from answerloom.registry import query
from answerloom.registry.fixtures import BM25_CTE, doc_chunks, questions, stored_index


def search_all(spark, sf, k, per_kb=False):
    queries = questions(spark, sf)
    return bm25.bm25_topk(queries, stored_index(spark, sf), k, per_kb=per_kb)


@query("bm25_postings", f"WITH {BM25_CTE} SELECT kb_id, chunk_key, term, tf::INT AS tf FROM ps")
def bm25_postings(spark, sf):
    return bm25.postings(doc_chunks(spark, sf)).drop("dl")


@query("bm25_corpus_stats", f"WITH {BM25_CTE} SELECT kb_id, n, total_dl::BIGINT AS total_dl, round(avgdl, 6) AS avgdl FROM cs")
def bm25_corpus_stats(spark, sf):
    stats = bm25.corpus_stats(bm25.doc_stats(doc_chunks(spark, sf)))
    return stats.withColumn("avgdl", F.round("avgdl", 6))


@query(
    "bm25_idf",
    f"WITH {BM25_CTE} SELECT kb_id, term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM ts JOIN cs USING (kb_id)",
)
def bm25_idf(spark, sf):
    index = bm25.build_index(doc_chunks(spark, sf))
    joined = bm25.bounded_join(index.terms, index.corpus, ["kb_id"], spread=["term"])
    return joined.select("kb_id", "term", "df", F.round(bm25.idf(), 6).alias("idf"))


@query(
    "bm25_topk",
    f"""WITH {BM25_CTE} SELECT query_id, kb_id, chunk_key, round(bm25_score, 6) AS bm25_score, bm25_rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, chunk_key)::INT AS bm25_rank FROM bm)
        WHERE bm25_rank <= 10""",
)
def bm25_topk(spark, sf):
    hits = search_all(spark, sf, 10)
    return hits.withColumn("bm25_score", F.round("bm25_score", 6))


@query(
    "bm25_topk_per_kb",
    f"""WITH {BM25_CTE} SELECT query_id, kb_id, chunk_key, round(bm25_score, 6) AS bm25_score, bm25_rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id, kb_id ORDER BY bm25_score DESC, chunk_key)::INT AS bm25_rank
        FROM bm) WHERE bm25_rank <= 3""",
)
def bm25_topk_per_kb(spark, sf):
    hits = search_all(spark, sf, 3, per_kb=True)
    return hits.withColumn("bm25_score", F.round("bm25_score", 6))


@query(
    "bm25_index_stats",
    f"""WITH {BM25_CTE} SELECT kb_id, n AS docs, terms, round(avgdl, 2) AS avgdl, 1.5::DOUBLE AS k1, 0.75::DOUBLE AS b
        FROM cs JOIN (SELECT kb_id, count(*) AS terms FROM ts GROUP BY 1) USING (kb_id)""",
)
def bm25_index_stats(spark, sf):
    return bm25.index_stats(bm25.build_index(doc_chunks(spark, sf)))


@query(
    "bm25_incremental",
    f"""WITH ch AS (SELECT source AS kb_id, doc_id || ':0' AS chunk_key,
                      list_filter(regexp_extract_all(lower(CASE WHEN lang = 'fr' THEN text || ' amended' ELSE text END),
                      '[a-z0-9]+'), lambda w: w NOT IN ('the','a','an','of','to','in','is','are','and','or','for','on','at',
                      'by','with','how','what','which','who','when','where','why')) AS toks FROM documents WHERE lang <> 'es'),
             dl AS (SELECT kb_id, chunk_key, greatest(len(toks), 1) AS dl FROM ch),
             ps AS (SELECT kb_id, chunk_key, unnest(toks) AS term FROM ch),
             ts AS (SELECT kb_id, term, count(DISTINCT chunk_key) AS df FROM ps GROUP BY ALL)
        SELECT kb_id, n, round(avgdl, 6) AS avgdl, terms, df_sum::BIGINT AS df_sum
        FROM (SELECT kb_id, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY 1)
        JOIN (SELECT kb_id, count(*) AS terms, sum(df) AS df_sum FROM ts GROUP BY 1) USING (kb_id)""",
)
def bm25_incremental(spark, sf):
    """Replace every French document by an amended text and delete the Spanish ones."""
    chunks = doc_chunks(spark, sf)
    upserts = chunks.filter("section_path = 'fr'").withColumn("content", F.concat("content", F.lit(" amended")))
    deletes = chunks.filter("section_path = 'es'").select("kb_id", "chunk_key")
    index = bm25.apply_changes(bm25.postings(chunks), bm25.doc_stats(chunks), upserts, deletes)
    terms = index.terms.groupBy("kb_id").agg(F.count("*").alias("terms"), F.sum("df").alias("df_sum"))
    return index.corpus.join(terms, "kb_id").select("kb_id", "n", F.round("avgdl", 6).alias("avgdl"), "terms", "df_sum")
