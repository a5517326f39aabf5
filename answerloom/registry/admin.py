"""Queries over corpus administration; whole documents stand in as chunks, Spanish ones count as deleted."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.functions.filters import active_kbs, live
from answerloom.functions.text import estimate_tokens
from answerloom.operators import admin as A, bm25
from answerloom.operators.usage import usage_by_mode, usage_totals
from answerloom.operators.vectors import hash_embed
from answerloom.registry import query
from answerloom.operators.skew import bounded_join
from answerloom.registry.fixtures import BM25_CTE, DIM, NOW, USAGE_CTE, doc_chunks, documents, questions, table, traces
from answerloom.session import shared_dir
from answerloom.sources import cases as C


def docs(spark, sf):
    d = documents(spark, sf)
    return d.withColumns({
        "deleted_at": F.when(F.col("lang") == "es", F.lit("2024-01-01").cast("timestamp_ntz")),
        "status": F.when(F.char_length("text") < 100, "FAILED").when(F.col("lang") == "de", "UPLOADED").otherwise("READY"),
        "sha256": A.content_hash("text"),
        "chunk_count": F.lit(1).cast("long"),
    })


DOCS = """d AS (SELECT doc_id, source AS kb_id, 'doc_' || doc_id || '.txt' AS doc_name, text, lang, lang = 'es' AS gone,
  CASE WHEN length(text) < 100 THEN 'FAILED' WHEN lang = 'de' THEN 'UPLOADED' ELSE 'READY' END AS status, sha256(text) AS sha256 FROM documents)"""


def sized(spark, sf):
    return doc_chunks(spark, sf).withColumns({"char_count": F.char_length("content"), "token_count": estimate_tokens("content")})


@query("live_chunks", f"WITH {DOCS} SELECT doc_id, 0 AS chunk_index, doc_name, length(text)::INT AS chars FROM d WHERE NOT gone")
def live_chunks(spark, sf):
    return A.live_chunks(doc_chunks(spark, sf), docs(spark, sf)).select("doc_id", "chunk_index", "doc_name", F.char_length("content").alias("chars"))


@query(
    "index_deletion",
    f"""WITH {DOCS} SELECT kb_id, count(*) FILTER (lang = 'fr') AS by_doc, count(*) FILTER (lang = 'fr' AND length(text) > 500) AS by_both,
        count(*) FILTER (NOT (lang = 'fr' AND length(text) > 500)) AS remaining FROM d GROUP BY 1""",
)
def index_deletion(spark, sf):
    c = doc_chunks(spark, sf)
    french = c.filter("section_path = 'fr'")
    by_doc = french.select("kb_id", "doc_id")
    both = french.filter(F.char_length("content") > 500).select("kb_id", "doc_id", "chunk_key")
    rest, gone_both = A.delete_from_index(c, both)
    _, gone_doc = A.delete_from_index(c, by_doc)
    out = rest.groupBy("kb_id").agg(F.count("*").alias("remaining")).join(gone_doc.withColumnRenamed("deleted", "by_doc"), "kb_id", "left")
    return out.join(gone_both.withColumnRenamed("deleted", "by_both"), "kb_id", "left").na.fill(0)


@query(
    "document_removal",
    f"""WITH {DOCS} SELECT kb_id, count(*) FILTER (gone OR lang = 'fr') AS deleted, sum(CASE WHEN lang = 'fr' THEN 0 ELSE 1 END)::BIGINT AS chunk_count,
        count(*) FILTER (lang <> 'fr') AS chunks, count(*) FILTER (lang <> 'fr') AS vectors, count(*) FILTER (lang <> 'fr') AS indexed FROM d GROUP BY 1""",
)
def document_removal(spark, sf):
    c = doc_chunks(spark, sf)
    v = c.select("kb_id", "chunk_key", hash_embed("content", DIM).alias("embedding"))
    tables = A.Tables(docs(spark, sf), c, v, bm25.postings(c), bm25.doc_stats(c))
    after = A.remove_documents(tables, c.filter("section_path = 'fr'").select("doc_id"), NOW)
    d = after.documents.groupBy("kb_id").agg(F.count("deleted_at").alias("deleted"), F.sum("chunk_count").alias("chunk_count"))
    for name, df in (("chunks", after.chunks), ("vectors", after.vectors), ("indexed", after.doc_stats)):
        d = d.join(df.groupBy("kb_id").agg(F.count("*").alias(name)), "kb_id", "left")
    return d


@query(
    "duplicate_documents",
    f"""WITH {DOCS}, f AS (SELECT kb_id, sha256, min(doc_id) AS first_id FROM d WHERE NOT gone GROUP BY ALL)
        SELECT kb_id, doc_id, sha256, first_id FROM d JOIN f USING (kb_id, sha256) WHERE NOT gone AND doc_id > first_id""",
)
def duplicate_documents(spark, sf):
    return A.duplicates(docs(spark, sf))


@query(
    "new_documents",
    f"""WITH {DOCS} SELECT 'src0' AS kb_id, sha256, min(doc_id) AS doc_id FROM d WHERE sha256 NOT IN (SELECT sha256 FROM d WHERE kb_id = 'src0' AND NOT gone) GROUP BY sha256""",
)
def new_documents(spark, sf):
    """Every document offered to one collection that holds some of them already."""
    stored = docs(spark, sf).filter("kb_id = 'src0'")
    incoming = docs(spark, sf).select(F.lit("src0").alias("kb_id"), "sha256", "doc_id")
    return A.new_only(incoming, stored).select("kb_id", "sha256", "doc_id")


@query(
    "store_consistency",
    f"""WITH {DOCS} SELECT kb_id, count(*)::BIGINT AS chunks, count(*) FILTER (lang <> 'fr')::BIGINT AS vectors, count(*)::BIGINT AS indexed, count(*) FILTER (lang = 'fr') AS different_keys,
        count(*) FILTER (lang = 'fr') = 0 AS consistent FROM d GROUP BY 1""",
)
def store_consistency(spark, sf):
    c = doc_chunks(spark, sf)
    return A.consistency(c, c.filter("section_path <> 'fr'"), bm25.doc_stats(c))


@query("missing_vectors", f"WITH {DOCS} SELECT kb_id, doc_id || ':0' AS chunk_key FROM d WHERE lang = 'fr'")
def missing_vectors(spark, sf):
    c = doc_chunks(spark, sf)
    return A.missing_keys(c, c.filter("section_path <> 'fr'"))


@query(
    "kb_statistics",
    f"""WITH {DOCS} SELECT kb_id, count(*) FILTER (NOT gone)::BIGINT AS documents, count(*) FILTER (NOT gone AND status = 'UPLOADED')::BIGINT AS docs_uploaded, count(*) FILTER (NOT gone AND status = 'READY')::BIGINT AS docs_ready,
        count(*) FILTER (NOT gone AND status = 'FAILED')::BIGINT AS docs_failed, 0::BIGINT AS docs_deleted, count(*)::BIGINT AS chunks, sum(length(text))::BIGINT AS chars,
        sum(ceil(length(text) / 4.0))::BIGINT AS tokens, count(*) FILTER (lang <> 'fr')::BIGINT AS vectors, count(*)::BIGINT AS indexed FROM d GROUP BY ROLLUP (kb_id)""",
)
def kb_statistics(spark, sf):
    c = sized(spark, sf)
    return A.kb_stats(docs(spark, sf), c, c.filter("section_path <> 'fr'"), bm25.doc_stats(c))


@query(
    "document_counts",
    f"WITH {DOCS} SELECT kb_id, count(*) FILTER (NOT gone) AS documents FROM d GROUP BY 1 UNION ALL SELECT 'empty', 0",
)
def document_counts(spark, sf):
    kbs = docs(spark, sf).select("kb_id").distinct().union(spark.createDataFrame([("empty",)], "kb_id string"))
    return A.doc_counts(kbs, docs(spark, sf))


@query("chunk_counts", f"WITH {DOCS} SELECT kb_id, doc_id, CASE WHEN lang = 'fr' THEN 0 ELSE 1 END::BIGINT AS chunks FROM d WHERE NOT gone")
def chunk_counts(spark, sf):
    return A.chunk_counts(docs(spark, sf), doc_chunks(spark, sf).filter("section_path <> 'fr'"))


@query("active_bases", "SELECT c_custkey FROM customer WHERE c_acctbal >= 0 AND c_mktsegment = 'BUILDING'")
def active_bases(spark, sf):
    c = table(spark, sf, "customer").withColumns({
        "deleted_at": F.when(F.col("c_acctbal") < 0, F.lit("2024-01-01").cast("timestamp_ntz")), "is_active": F.col("c_mktsegment") == "BUILDING"
    })
    return active_kbs(c).select("c_custkey")


@query(
    "document_page",
    f"""WITH {DOCS} SELECT doc_id, doc_name, (SELECT count(*) FROM d WHERE NOT gone) AS total FROM d WHERE NOT gone ORDER BY doc_id DESC LIMIT 20 OFFSET 40""",
)
def document_page(spark, sf):
    rows, total = A.paginate(live(docs(spark, sf)).select("doc_id", "doc_name"), [F.desc("doc_id")], 3, 20)
    return rows.crossJoin(F.broadcast(total))  # one total row


@query("trace_page", f"WITH {USAGE_CTE} SELECT trace_id, status FROM tr ORDER BY created_at DESC, trace_id DESC LIMIT 25 OFFSET 25")
def trace_page(spark, sf):
    rows, _ = A.paginate(traces(spark, sf), [F.desc("created_at"), F.desc("trace_id")], 2, 25)
    return rows.select("trace_id", "status")


@query("order_page_after", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey < 900 ORDER BY o_orderkey DESC LIMIT 30")
def order_page_after(spark, sf):
    return A.after(table(spark, sf, "orders"), "o_orderkey", 900, 30).select("o_orderkey", "o_orderstatus")


@query(
    "document_list",
    f"""WITH {DOCS} SELECT doc_id, doc_name, status, 1::BIGINT AS chunks FROM d WHERE NOT gone AND contains(doc_name, '1') ORDER BY doc_id DESC LIMIT 50""",
)
def document_list(spark, sf):
    return A.list_documents(docs(spark, sf), doc_chunks(spark, sf), "1")


@query(
    "ingest_report",
    """SELECT doc_id, source AS kb_id, CASE WHEN lang <> 'de' THEN 'text' END AS parser, 1 AS page_count, length(text)::BIGINT AS text_chars, CASE WHEN lang = 'de' THEN 0 ELSE length(text) END::BIGINT AS char_count,
              CASE WHEN lang = 'de' THEN 0 ELSE 1 END::BIGINT AS chunk_count, CASE WHEN lang = 'de' THEN 0 ELSE ceil(length(text) / 4.0) END::BIGINT AS token_count,
              CASE WHEN lang = 'de' THEN 'FAILED' ELSE 'READY' END AS status, CASE WHEN lang = 'de' THEN CASE WHEN length(text) > 500 THEN 'REJECTED' ELSE 'EMPTY' END END AS error_code,
              CASE WHEN lang = 'de' THEN CASE WHEN length(text) > 500 THEN 'too long' ELSE 'no chunk produced' END END AS error_message FROM documents""",
)
def ingest_report(spark, sf):
    d, c = docs(spark, sf), sized(spark, sf)
    rejects = d.filter((F.col("lang") == "de") & (F.char_length("text") > 500)).select("doc_id", F.lit("too long").alias("reason"))
    return A.ingest_report(d, c.filter("section_path <> 'de'"), rejects)


@query(
    "vector_screening",
    """SELECT kb, count(*) AS vectors, sum(norm)::DOUBLE AS norms FROM (SELECT 'k' AS kb, vec_id, 1 AS norm FROM embeddings WHERE label <> 3) GROUP BY 1""",
)
def vector_screening(spark, sf):
    """Vectors written twice with a growing sequence; those of one class are cut short and must be refused."""
    e = table(spark, sf, "embeddings")
    cut = F.when(F.col("label") == 3, F.slice("embedding", 1, 10)).otherwise(F.transform("embedding", lambda x: x * 3))
    rows = e.select(F.lit("other").alias("kb_id"), F.col("vec_id").cast("string").alias("chunk_key"), cut.alias("embedding"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    good, _ = A.screen_vectors(rows, DIM, kb_id="k")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return good.groupBy(F.col("kb_id").alias("kb")).agg(F.count("*").alias("vectors"), F.sum(F.round(norm, 3)).alias("norms"))


@query("stored_bm25_index", f"""WITH {DOCS} SELECT kb_id, count(*) AS docs FROM d GROUP BY 1""")
def stored_bm25_index(spark, sf):
    """Write the index of all documents to the shared folder and count the stored lengths."""
    index = A.write_bm25_index(doc_chunks(spark, sf), shared_dir(spark, "bm25"))
    return index.corpus.select("kb_id", F.col("n").alias("docs"))


#: Documents after the French ones were amended, and the Spanish ones and one whole collection were deleted.
_CHANGED = f"""d2 AS (SELECT doc_id, source, lang, CASE WHEN lang = 'fr' THEN text || ' amended' ELSE text END AS text FROM documents WHERE lang <> 'es' AND source <> 'src1'),
  {BM25_CTE.strip().replace('FROM documents', 'FROM d2')}"""


def updated_index(spark, sf):
    path = shared_dir(spark, "bm25")
    chunks = doc_chunks(spark, sf)
    A.write_bm25_index(chunks, path)
    upserts = chunks.filter("section_path = 'fr' AND kb_id <> 'src1'").withColumn("content", F.concat("content", F.lit(" amended")))
    return A.update_bm25_index(path, upserts, chunks.filter("section_path = 'es' OR kb_id = 'src1'").select("kb_id", "chunk_key"))


@query("stored_bm25_update", f"WITH {_CHANGED} SELECT kb_id, chunk_key, term, tf::INT AS tf, dl::INT AS dl, df::BIGINT AS df, n FROM ps JOIN ts USING (kb_id, term) JOIN dl USING (kb_id, chunk_key) JOIN cs USING (kb_id)")
def stored_bm25_update(spark, sf):
    """Everything a stored index holds after an update that empties a collection."""
    index = updated_index(spark, sf)
    joined = bounded_join(index.postings.join(index.terms, ["kb_id", "term"]), index.corpus.select("kb_id", "n"), ["kb_id"])
    return joined.select("kb_id", "chunk_key", "term", "tf", "dl", "df", "n")


@query(
    "stored_bm25_search",
    f"""WITH {_CHANGED} SELECT query_id, kb_id, chunk_key, round(bm25_score, 6) AS bm25_score, bm25_rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, chunk_key)::INT AS bm25_rank FROM bm) WHERE bm25_rank <= 5""",
)
def stored_bm25_search(spark, sf):
    return bm25.bm25_topk(questions(spark, sf), updated_index(spark, sf), 5).withColumn("bm25_score", F.round("bm25_score", 6))


@query(
    "stored_vectors",
    """SELECT CASE label % 2 WHEN 0 THEN '007' ELSE '7' END AS kb_id, vec_id::VARCHAR AS chunk_key, CASE WHEN label = 4 THEN -1 ELSE 1 END * sign(embedding[1])::INT AS side,
       len(embedding)::INT AS dim FROM embeddings""",
)
def stored_vectors(spark, sf):
    """Write all vectors into collections whose names look alike, then one class again, turned round and with every key twice."""
    kb = F.when(F.col("label") % 2 == 0, "007").otherwise("7")
    e = table(spark, sf, "embeddings").select(kb.alias("kb_id"), F.col("vec_id").cast("string").alias("chunk_key"), "label", "embedding")
    path = shared_dir(spark, "vectors")
    A.write_vectors(e, path, DIM)
    again = e.filter("label = 4").withColumn("embedding", F.transform("embedding", lambda x: -x))
    A.write_vectors(again.union(again), path, DIM)
    stored = A.read_stored(spark, path, "kb_id string, chunk_key string, label int, embedding array<float>")
    return stored.select("kb_id", "chunk_key", F.signum(F.col("embedding")[0]).cast("int").alias("side"), F.size("embedding").alias("dim"))


@query(
    "metrics_text",
    f"""WITH {USAGE_CTE}, t AS (SELECT count(*) AS requests, count(*) FILTER (status <> 'ok') AS errors FROM tr),
        m AS (SELECT coalesce(mode, 'unknown') AS mode, count(*)::DOUBLE AS requests, sum(cost_usd)::DOUBLE AS cost FROM tr GROUP BY 1),
        r AS (SELECT 'qa_requests' AS n, 'requests in the window' AS h, requests::DOUBLE AS v, '' AS l FROM t UNION ALL SELECT 'qa_errors', 'failed requests', errors, '' FROM t
              UNION ALL SELECT 'qa_requests_by_mode', 'requests per mode', requests, '{{mode="' || mode || '"}}' FROM m
              UNION ALL SELECT 'qa_cost_usd_by_mode', 'cost per mode in USD', cost, '{{mode="' || mode || '"}}' FROM m)
        SELECT '# HELP ' || n || ' ' || h AS line FROM r UNION ALL SELECT '# TYPE ' || n || ' gauge' FROM r UNION ALL SELECT n || l || ' ' || v::DECIMAL(38, 6)::VARCHAR FROM r""",
)
def metrics_text(spark, sf):
    t = traces(spark, sf)
    lines = A.to_prometheus(usage_totals(t, 744, NOW), {"requests": "requests in the window", "errors": "failed requests"}, usage_by_mode(t))
    return lines.select("line")


@query(
    "case_lines",
    """SELECT conv_id * 1000 + turn AS file, (2 + k)::INT AS line_no, CASE WHEN k = 2 THEN 'invalid JSON' WHEN k = 3 THEN 'not a JSON object' WHEN k = 4 THEN 'question is required' END AS reason,
              CASE WHEN k = 1 THEN trim(text, E' \\t\\n\\r') END AS question, CASE WHEN k = 1 THEN 'a,b' END AS sections
       FROM conversations, (SELECT unnest([1, 2, 3, 4]) AS k)""",
)
def case_lines(spark, sf):
    """Every message as a case file: a comment, a blank line, a case and three kinds of bad lines."""
    c = table(spark, sf, "conversations")
    good = F.to_json(F.struct(F.concat(F.lit("  "), "text", F.lit(" ")).alias("question"), F.array(F.lit(" a"), F.lit("b "), F.lit("a")).alias("sections"), F.lit("t").alias("tags")))
    value = F.concat(F.lit("\ufeff# cases\n\n"), good, F.lit('\n{"question": \n[1, 2]\n{"tags": null}'))
    files = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("file"), value.alias("value"))
    parsed, bad = C.split_cases(files)
    cases, unusable = C.normalize_cases(parsed)
    none = F.lit(None).cast("string")
    rejected = bad.unionByName(unusable).select("file", "line_no", "reason", none.alias("question"), none.alias("sections"))
    return cases.select("file", "line_no", none.alias("reason"), "question", F.array_join("expected_sections", ",").alias("sections")).unionByName(rejected)
