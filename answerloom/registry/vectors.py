"""Queries over dense vectors and metadata filters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from answerloom.functions.filters import last_hours, search_name, where_to_column
from answerloom.operators import ivf, vectors as V
from answerloom.registry import query
from answerloom.registry.fixtures import DIM, NOW, spread_out, table
from answerloom.session import shared_dir

HASH_SQL = "('0x' || substr(md5(g), 1, 15))::BIGINT"


def hash_cte(name: str, source: str, ids: str) -> str:
    """CTEs giving {name}(ids, embedding DOUBLE[64]) from a relation with the columns ``ids`` and ``text``."""
    return f"""
{name}_c AS (SELECT {ids}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]') AS cs FROM {source}),
{name}_g AS (SELECT {ids}, unnest(cs || list_transform(range(1, len(cs)), lambda i: cs[i] || cs[i + 1])) AS g FROM {name}_c),
{name}_n AS (SELECT {ids}, g, count(*) AS n FROM {name}_g GROUP BY ALL),
{name}_h AS (SELECT {ids}, {HASH_SQL} AS h, n FROM {name}_n),
{name}_b AS (SELECT {ids}, h % {DIM} AS bucket, sum(CASE WHEN (h >> 59) % 2 = 0 THEN n ELSE -n END)::DOUBLE AS v
             FROM {name}_h GROUP BY ALL),
{name}_s AS (SELECT {ids}, sqrt(sum(v * v)) AS norm FROM {name}_b GROUP BY ALL),
{name} AS (SELECT {ids}, bucket, CASE WHEN norm > 0 THEN v / norm ELSE 0.0 END AS v FROM {name}_b JOIN {name}_s USING ({ids}))"""


def vec_table(spark, sf):
    e = table(spark, sf, "embeddings")
    return spread_out(
        e.select((F.col("label") % 2).alias("kb_id"), F.col("vec_id").alias("chunk_key"), "label", "embedding"), "chunk_key"
    )


def vec_queries(spark, sf, bound=False):
    e = table(spark, sf, "embeddings")
    kb = [(F.col("label") % 2).alias("kb_id")] if bound else []
    return e.select(F.col("vec_id").alias("query_id"), *kb, "label", "embedding")


DOT_CTE = """
e AS (SELECT vec_id, label, label % 2 AS kb_id, embedding::DOUBLE[64] AS v FROM embeddings),
dots AS (SELECT a.vec_id AS query_id, a.label AS q_label, a.kb_id AS q_kb, b.vec_id AS chunk_key, b.label, b.kb_id,
                round(array_inner_product(a.v, b.v), 9) AS s FROM e a, e b)
"""


@query(
    "hash_embedding",
    f"WITH {hash_cte('emb', 'documents', 'doc_id')} SELECT doc_id, bucket::INT AS bucket, round(v, 6) AS value FROM emb WHERE v <> 0",
)
def hash_embedding(spark, sf):
    d = spread_out(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    emb = d.select("doc_id", V.hash_embed("text", DIM).alias("e"))
    return emb.select("doc_id", F.posexplode("e").alias("bucket", "v")).filter("v <> 0").select(
        "doc_id", "bucket", F.round("v", 6).alias("value")
    )


@query(
    "l2_normalized",
    """SELECT vec_id, round(list_aggregate(list_transform(x, lambda y: y / n), 'sum'), 6) AS total FROM (
         SELECT vec_id, x, sqrt(list_aggregate(list_transform(x, lambda y: y * y), 'sum')) AS n FROM (
           SELECT vec_id, list_transform(embedding::DOUBLE[], lambda y: y * (label + 1)) AS x FROM embeddings))""",
)
def l2_normalized(spark, sf):
    e = table(spark, sf, "embeddings")
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1))
    unit = V.l2_normalize(scaled)
    return e.select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(
    "vector_topk",
    f"""WITH {DOT_CTE} SELECT query_id, kb_id, chunk_key, round(s, 6) AS vector_score, r AS vector_rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_key)::INT AS r FROM dots WHERE kb_id = q_kb)
        WHERE r <= 10""",
)
def vector_topk(spark, sf):
    hits = V.vector_topk(vec_queries(spark, sf, bound=True), vec_table(spark, sf), 10)
    return hits.withColumn("vector_score", F.round("vector_score", 6))


@query(
    "vector_topk_blocks",
    f"""WITH {DOT_CTE} SELECT query_id, kb_id, chunk_key, round(s, 6) AS vector_score, r AS vector_rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_key)::INT AS r FROM dots WHERE kb_id = q_kb)
        WHERE r <= 10""",
)
def vector_topk_blocks(spark, sf):
    hits = V.vector_topk(vec_queries(spark, sf, bound=True), vec_table(spark, sf), 10, shared=False)
    return hits.withColumn("vector_score", F.round("vector_score", 6))


@query(
    "vector_topk_filtered",
    f"""WITH {DOT_CTE} SELECT query_id, chunk_key, round(s, 6) AS vector_score, r AS vector_rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_key)::INT AS r FROM dots
        WHERE label >= 3 AND label NOT IN (5, 7)) WHERE r <= 5""",
)
def vector_topk_filtered(spark, sf):
    where = {"$and": [{"label": {"$gte": 3}}, {"label": {"$nin": [5, 7]}}]}
    hits = V.vector_topk(vec_queries(spark, sf), vec_table(spark, sf), 5, where=where)
    return hits.select("query_id", "chunk_key", F.round("vector_score", 6).alias("vector_score"), "vector_rank")


@query(
    "vector_topk_per_kb",
    f"""WITH {DOT_CTE} SELECT query_id, kb_id, chunk_key, round(s, 6) AS vector_score, r AS vector_rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id, kb_id ORDER BY s DESC, chunk_key)::INT AS r FROM dots)
        WHERE r <= 5""",
)
def vector_topk_per_kb(spark, sf):
    hits = V.vector_topk(vec_queries(spark, sf), vec_table(spark, sf), 5, per_kb=True)
    return hits.withColumn("vector_score", F.round("vector_score", 6))


@query(
    "vector_topk_merged",
    f"""WITH {DOT_CTE},
        a AS (SELECT *, row_number() OVER (PARTITION BY query_id, kb_id ORDER BY s DESC, chunk_key) AS rk FROM dots),
        m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_key)::INT AS r FROM a WHERE rk <= 8)
        SELECT query_id, kb_id, chunk_key, round(s, 6) AS vector_score, r AS vector_rank FROM m WHERE r <= 8""",
)
def vector_topk_merged(spark, sf):
    hits = V.vector_topk(vec_queries(spark, sf), vec_table(spark, sf), 8)
    return hits.withColumn("vector_score", F.round("vector_score", 6))


@query("vector_topk_lsh")
def vector_topk_lsh(spark, sf):
    hits = V.vector_topk_lsh(vec_queries(spark, sf, bound=True), vec_table(spark, sf), 10, DIM)
    return hits.withColumn("vector_score", F.round("vector_score", 6))


@query(
    "ivf_search",
    """WITH e AS (SELECT vec_id, label % 2 AS kb_id, embedding::DOUBLE[64] AS v FROM embeddings),
         c AS (SELECT row_number() OVER (ORDER BY vec_id) AS cell, v FROM (SELECT vec_id, v FROM e ORDER BY vec_id LIMIT 64)),
         p AS (SELECT e.vec_id, e.kb_id, e.v, c.cell, row_number() OVER (PARTITION BY e.vec_id ORDER BY round(array_inner_product(e.v, c.v), 9) DESC, cell) AS r FROM e, c),
         s AS (SELECT q.vec_id AS query_id, x.kb_id, x.vec_id AS chunk_key, round(array_inner_product(q.v, x.v), 9) AS s
               FROM p q JOIN p x ON q.cell = x.cell AND x.r = 1 AND q.r <= 6 AND q.vec_id % 50 = 0 AND q.kb_id = x.kb_id)
       SELECT query_id, kb_id, chunk_key, round(s, 6) AS vector_score, r AS vector_rank FROM (
         SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_key)::INT AS r FROM s) WHERE r <= 10""",
)
def ivf_search(spark, sf):
    """Cells around given centres, the first vectors, so that SQL can tell which cells a query probes."""
    centres = np.array([r.embedding for r in table(spark, sf, "embeddings").orderBy("vec_id").limit(64).collect()])
    path = shared_dir(spark, "ivf")
    ivf.write(vec_table(spark, sf), path, centres)
    hits = ivf.search(vec_queries(spark, sf, bound=True).filter("query_id % 50 = 0"), ivf.read(spark, path), 10, probes=6)
    return hits.withColumn("vector_score", F.round("vector_score", 6))


@query("ivf_recall", "SELECT count(*) AS queries, true AS at_least_90 FROM embeddings WHERE vec_id % 50 = 0")
def ivf_recall(spark, sf):
    """Share of the exact first 10 that fitted cells find, with as many probes as other vectors need."""
    path, asked = shared_dir(spark, "ivf"), vec_queries(spark, sf).filter("query_id % 50 = 0")
    ivf.write(vec_table(spark, sf), path)
    index = ivf.read(spark, path)
    probes = ivf.tune(vec_table(spark, sf), index, 10, target=0.95)
    found = ivf.search(asked, index, 10, probes).select("query_id", "chunk_key", F.lit(1).alias("hit"))
    exact = V.vector_topk(asked, vec_table(spark, sf), 10).select("query_id", "chunk_key")
    share = F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")
    return exact.join(found, ["query_id", "chunk_key"], "left").agg(F.countDistinct("query_id").alias("queries"), (share >= 0.9).alias("at_least_90"))


@query("vector_counts", "SELECT label % 2 AS kb_id, count(*) AS vectors FROM embeddings GROUP BY 1")
def vector_counts(spark, sf):
    return V.vector_counts(vec_table(spark, sf))


@query("vector_keys", "SELECT label % 2 AS kb_id, vec_id AS chunk_key FROM embeddings")
def vector_keys(spark, sf):
    return V.vector_keys(vec_table(spark, sf))


@query(
    "best_pos_neg",
    f"""WITH {DOT_CTE} SELECT query_id, round(max(s) FILTER (label = q_label), 6) AS positive,
        round(max(s) FILTER (label <> q_label), 6) AS negative FROM dots WHERE chunk_key <> query_id GROUP BY 1""",
)
def best_pos_neg(spark, sf):
    best = V.best_pos_neg(vec_queries(spark, sf), vec_table(spark, sf))
    return best.select("query_id", F.round("positive", 6).alias("positive"), F.round("negative", 6).alias("negative"))


@query(
    "metadata_filter",
    """WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice,
                 CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS prio FROM orders)
       SELECT o_orderkey, coalesce(prio = '1-URGENT', false) AS eq, NOT coalesce(prio = '1-URGENT', false) AS ne,
              coalesce(prio IN ('1-URGENT', '2-HIGH'), false) AS is_in, NOT coalesce(prio IN ('1-URGENT', '2-HIGH'), false) AS nin,
              coalesce(prio > '3', false) AS gt, false AS mismatch FROM o
       WHERE o_orderstatus = 'F' OR (o_totalprice >= 100000 AND o_totalprice < 300000)""",
)
def metadata_filter(spark, sf):
    o = table(spark, sf, "orders").withColumn(
        "prio", F.when(F.col("o_custkey") % 3 == 0, None).otherwise(F.col("o_orderpriority"))
    )
    where = {"$or": [{"o_orderstatus": "F"}, {"$and": [{"o_totalprice": {"$gte": 100000}}, {"o_totalprice": {"$lt": 300000}}]}]}
    parts = {
        "eq": {"prio": "1-URGENT"}, "ne": {"prio": {"$ne": "1-URGENT"}}, "is_in": {"prio": {"$in": ["1-URGENT", "2-HIGH"]}},
        "nin": {"prio": {"$nin": ["1-URGENT", "2-HIGH"]}}, "gt": {"prio": {"$gt": "3"}}, "mismatch": {"prio": {"$gt": 3}},
    }
    cols = [where_to_column(w, o.schema).alias(n) for n, w in parts.items()]
    return o.filter(where_to_column(where, o.schema)).select("o_orderkey", *cols)


@query(
    "time_window",
    f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 72 HOUR",
)
def time_window(spark, sf):
    return last_hours(table(spark, sf, "events"), "ts", 72, NOW).select("event_id")


@query("name_search", "SELECT c_custkey FROM customer WHERE contains(c_name, '00010') OR contains(c_mktsegment, 'BUILD')")
def name_search(spark, sf):
    c = table(spark, sf, "customer")
    a = search_name(c, ["c_name"], "00010").select("c_custkey")
    b = search_name(c, ["c_name", "c_mktsegment"], "BUILD").select("c_custkey")
    return a.union(b).distinct()
