"""Queries over batch question answering."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.functions import text as T
from answerloom.operators import fusion as R
from answerloom.operators.vectors import hash_embed
from answerloom.plans import answers as P
from answerloom.plans.search import SearchConfig
from answerloom.registry import query
from answerloom.registry.fixtures import DIM, coverage_sql, table, tokens_sql
from answerloom.registry.search import CFG, parts

#: Candidates taken from events: the event type is the question, the user the key, the day the query.
CAND_CTE = """c0 AS (SELECT event_type AS question_id, user_id AS chunk_key, strftime(ts, '%d') AS query_id, max(round(value, 2)) AS score, max(event_id % 100) / 100.0 AS vector_score, max(event_id % 10) / 10.0 AS keyword_coverage
  FROM events GROUP BY ALL),
mc AS (SELECT * EXCLUDE (b), row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_key)::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id, chunk_key ORDER BY score DESC, query_id) AS b FROM c0) WHERE b = 1),
gr AS (SELECT *, count(*) OVER w <= 3 OR (vector_score >= 0.97 OR keyword_coverage >= 0.95) OR (NOT bool_or(vector_score >= 0.97 OR keyword_coverage >= 0.95) OVER w AND rank = 1) AS relevant
  FROM mc WHERE rank <= 15 WINDOW w AS (PARTITION BY question_id))"""


def candidates(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("question_id"), F.col("user_id").alias("chunk_key"), F.date_format("ts", "dd").alias("query_id")).agg(
        F.max(F.round("value", 2)).alias("score"), (F.max(F.col("event_id") % 100) / 100.0).alias("vector_score"), (F.max(F.col("event_id") % 10) / 10.0).alias("keyword_coverage")
    )


@query("candidate_merge", f"WITH {CAND_CTE} SELECT question_id, chunk_key, query_id, score, rank FROM mc WHERE rank <= 15")
def candidate_merge(spark, sf):
    return R.merge_candidates(candidates(spark, sf), 15).select("question_id", "chunk_key", "query_id", "score", "rank")


@query("candidate_grading", f"WITH {CAND_CTE} SELECT question_id, chunk_key, relevant FROM gr")
def candidate_grading(spark, sf):
    return R.grade(R.merge_candidates(candidates(spark, sf), 15), 0.97, 0.95).select("question_id", "chunk_key", "relevant")


@query(
    "context_selection",
    f"""WITH {CAND_CTE} SELECT question_id, chunk_key, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_key)::INT AS rank
        FROM (SELECT *, bool_or(relevant) OVER (PARTITION BY question_id) AS any_ok FROM gr) WHERE CASE WHEN any_ok THEN relevant ELSE rank <= 3 END""",
)
def context_selection(spark, sf):
    graded = R.grade(R.merge_candidates(candidates(spark, sf), 15), 0.97, 0.95)
    return R.select_contexts(graded).select("question_id", "chunk_key", "rank")


@query(
    "query_cleanup",
    r"""WITH q AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, CASE WHEN turn % 3 = 0 THEN NULL ELSE 'about ' || trim(regexp_replace(text, '\s+', ' ', 'g')) END AS u FROM conversations)
        SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 1 WHEN t = u THEN 1 ELSE 2 END AS n, md5(CASE WHEN turn % 3 = 0 THEN t WHEN t = u THEN t ELSE t || '|' || u END) AS queries_md5 FROM q""",
)
def query_cleanup(spark, sf):
    c = table(spark, sf, "conversations")
    text = F.col("text")
    raw = F.when(F.col("turn") % 3 == 0, F.array(F.lit("  "))).otherwise(
        F.array(F.concat(F.lit(" "), text, F.lit("  ")), text, F.lit(""), F.concat(F.lit("about  "), text), F.concat(F.lit("about "), T.collapse_ws(text)))
    )
    q = R.normalize_queries(raw, text)
    return c.select("conv_id", "turn", F.size(q).alias("n"), F.md5(F.array_join(q, "|")).alias("queries_md5"))


_PAIR = "pr AS (SELECT u.conv_id * 100 + u.turn AS question_id, u.text AS q FROM conversations u WHERE role = 'user'), cx AS (SELECT u.conv_id * 100 + u.turn AS question_id, a.turn::INT AS rank, a.text AS t FROM conversations u JOIN conversations a USING (conv_id) WHERE u.role = 'user' AND a.role = 'assistant')"


def conversation_contexts(spark, sf):
    """Every user turn as a question, the assistant texts of its conversation as contexts."""
    c = table(spark, sf, "conversations")
    u = c.filter("role = 'user'").select("conv_id", (F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), F.col("text").alias("question"))
    a = c.filter("role = 'assistant'").select("conv_id", F.col("turn").cast("int").alias("rank"), "text", F.lit("").alias("source"))
    return u.drop("conv_id"), u.join(a, "conv_id").select("question_id", "rank", "text", "source")


@query(
    "extractive_answers",
    f"""WITH {_PAIR}, s0 AS (SELECT question_id, rank, t, {coverage_sql('qt', 'tt')} AS cov FROM (SELECT cx.question_id, rank, t, {tokens_sql('q')} AS qt, {tokens_sql('t')} AS tt FROM cx JOIN pr USING (question_id))),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY cov DESC, rank) AS n FROM s0) WHERE n = 1),
        se AS (SELECT question_id, pos, trim(s, E' \\t\\n\\r') AS s FROM (SELECT question_id, generate_subscripts(ss, 1) AS pos, unnest(ss) AS s FROM (SELECT question_id, regexp_extract_all(trim(t, E' \\t\\n\\r'), '[^。！？!?\\n]+[。！？!?]?') AS ss FROM b))),
        sc AS (SELECT question_id, pos, s, {coverage_sql('qt', 'st')} AS c FROM (SELECT se.*, {tokens_sql('q')} AS qt, {tokens_sql('s')} AS st FROM se JOIN pr USING (question_id) WHERE length(s) >= 6)),
        tp AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY floor(c * 1000) DESC, pos) AS n FROM sc WHERE c > 0),
        pk AS (SELECT question_id, string_agg(s, ' ' ORDER BY pos) AS body FROM tp WHERE n <= 2 GROUP BY 1)
        SELECT pr.question_id, CASE WHEN b.cov IS NULL OR b.cov < 0.25 THEN '{P.REFUSAL_ANSWER}' ELSE coalesce(body, trim(left(t, 200), E' \\t\\n\\r')) || ' [' || rank || ']' END AS answer,
               CASE WHEN b.cov >= 0.25 THEN rank END AS cited_rank, b.cov IS NULL OR b.cov < 0.25 AS refused
        FROM pr LEFT JOIN b USING (question_id) LEFT JOIN pk USING (question_id)""",
)
def extractive_answers(spark, sf):
    questions, contexts = conversation_contexts(spark, sf)
    return P.extractive_answer(questions, contexts)


@query(
    "citation_support",
    r"""WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE regexp_replace(text, '\.', ' [1].', 'g') || '[2]' END AS t FROM conversations),
        s AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(t, '[^。！？!?\n]+[。！？!?]?'), lambda x: trim(x, E' \t\n\r')), lambda x: length(x) >= 12 AND NOT regexp_matches(x, '\[\d+\]')) AS u FROM a)
        SELECT conv_id, turn, len(u)::INT AS unsupported, len(u) = 0 AS passed FROM s""",
)
def citation_support(spark, sf):
    c = table(spark, sf, "conversations")
    cited = F.concat(F.regexp_replace("text", r"\.", " [1]."), F.lit("[2]"))
    a = c.withColumn("answer", F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(cited))
    return P.unsupported_sentences(a).select("conv_id", "turn", F.size("unsupported").alias("unsupported"), "passed")


@query("answer_batch")
def answer_batch(spark, sf):
    q, corpus = parts(spark, sf)
    questions = q.select(F.col("query_id").alias("question_id"), "question", F.array(F.col("question"), F.concat(F.lit("about "), "question")).alias("rewrites"))
    out = P.answer_batch(questions, corpus, lambda c: hash_embed(c, DIM), SearchConfig(**CFG))
    return out.select("question_id", "answer", "cited_rank", "refused", "refusal", F.coalesce(F.size("sources"), F.lit(0)).alias("n_sources"))
