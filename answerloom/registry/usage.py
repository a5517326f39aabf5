"""Queries over usage data: events as traces and spans, conversations as messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.functions import text as T
from answerloom.operators import usage as U
from answerloom.registry import query
from answerloom.registry.fixtures import NOW, PRICES, USAGE_CTE, cost_sql, doc_chunks, documents, messages, spans, table, traces

IN_WINDOW = "created_at >= TIMESTAMP '" + NOW + "' - INTERVAL 168 HOUR"


@query("usage_percentiles", f"WITH {USAGE_CTE} SELECT mode, round(quantile_cont(latency_ms, 0.5), 4) AS p50, round(quantile_cont(latency_ms, 0.9), 4) AS p90 FROM tr GROUP BY 1")
def usage_percentiles(spark, sf):
    t = traces(spark, sf)
    return t.groupBy("mode").agg(F.round(U.pct("latency_ms", 50), 4).alias("p50"), F.round(U.pct("latency_ms", 90), 4).alias("p90"))


_LAT = """round(coalesce(quantile_cont(latency_ms, 0.5), 0), 2)::DOUBLE AS p50, round(coalesce(quantile_cont(latency_ms, 0.95), 0), 2)::DOUBLE AS p95,
  round(coalesce(quantile_cont(latency_ms, 0.99), 0), 2)::DOUBLE AS p99, coalesce(max(latency_ms), 0)::DOUBLE AS max_ms,
  coalesce(round(avg(latency_ms), 2), 0)::DOUBLE AS avg_ms, count(latency_ms) AS n"""


@query("usage_latency", f"WITH {USAGE_CTE} SELECT 'all' AS part, {_LAT} FROM tr UNION ALL SELECT 'none', {_LAT} FROM tr WHERE trace_id < 0")
def usage_latency(spark, sf):
    t = traces(spark, sf)
    every = U.latency_summary(t).withColumn("part", F.lit("all"))
    return every.unionByName(U.latency_summary(t.filter("trace_id < 0")).withColumn("part", F.lit("none")))


@query(
    "usage_totals",
    f"""WITH {USAGE_CTE} SELECT count(*) AS requests, count(*) FILTER (status <> 'ok') AS errors, count(*) FILTER (status = 'ok') AS success,
        round(count(*) FILTER (status <> 'ok') / count(*), 4) AS error_rate, sum(prompt_tokens)::BIGINT AS prompt_tokens,
        sum(completion_tokens)::BIGINT AS completion_tokens, sum(prompt_tokens + completion_tokens)::BIGINT AS total_tokens,
        round(sum(prompt_tokens + completion_tokens) / count(*), 2) AS tokens_per_request, sum(cost_usd)::DECIMAL(20, 6) AS cost_usd,
        round(sum(cost_usd)::DECIMAL(20, 6) * 7.2::DECIMAL(8, 4), 4)::DECIMAL(20, 4) AS cost_cny, sum(llm_calls)::BIGINT AS llm_calls
        FROM tr WHERE {IN_WINDOW}""",
)
def usage_totals(spark, sf):
    return U.usage_totals(traces(spark, sf), 168, NOW)


@query(
    "usage_by_mode",
    f"""WITH {USAGE_CTE} SELECT coalesce(mode, 'unknown') AS mode, count(*) AS requests, count(*) FILTER (status <> 'ok') AS errors,
        sum(prompt_tokens + completion_tokens)::BIGINT AS tokens, sum(llm_calls)::BIGINT AS llm_calls, sum(cost_usd)::DECIMAL(20, 6) AS cost_usd,
        round(avg(latency_ms), 2) AS avg_latency_ms, round(avg(refusal::INT), 4) AS refusal_rate FROM tr GROUP BY 1""",
)
def usage_by_mode(spark, sf):
    return U.usage_by_mode(traces(spark, sf))


@query(
    "usage_by_model",
    f"""WITH {USAGE_CTE} SELECT model, count(*) AS messages, sum(prompt_tokens + completion_tokens)::BIGINT AS tokens, sum(cost_usd)::DECIMAL(20, 6) AS cost_usd,
        round(count(*) / sum(count(*)) OVER (), 4) AS share FROM me WHERE role = 'assistant' GROUP BY 1""",
)
def usage_by_model(spark, sf):
    return U.usage_by_model(messages(spark, sf))


@query(
    "usage_hourly",
    f"""WITH {USAGE_CTE}, g AS (SELECT unnest(generate_series(date_trunc('hour', TIMESTAMP '{NOW}' - INTERVAL 168 HOUR), TIMESTAMP '{NOW}', INTERVAL 1 HOUR)) AS h),
        a AS (SELECT date_trunc('hour', created_at) AS h, count(*) AS requests, count(*) FILTER (status <> 'ok') AS errors,
              sum(prompt_tokens + completion_tokens) AS tokens, sum(cost_usd) AS cost_usd, round(avg(latency_ms), 2) AS lat,
              count(*) FILTER (refusal) AS refusals FROM tr WHERE {IN_WINDOW} GROUP BY 1)
        SELECT strftime(h, '%Y-%m-%d %H') AS hour, coalesce(requests, 0) AS requests, coalesce(errors, 0) AS errors, coalesce(tokens, 0)::BIGINT AS tokens,
               coalesce(cost_usd, 0)::DECIMAL(20, 6) AS cost_usd, coalesce(lat, 0)::DOUBLE AS avg_latency_ms, coalesce(refusals, 0) AS refusals
        FROM g LEFT JOIN a USING (h)""",
)
def usage_hourly(spark, sf):
    return U.hourly_series(traces(spark, sf), 168, NOW).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


@query(
    "usage_quality",
    f"""WITH {USAGE_CTE} SELECT count(*) AS requests, round(avg(refusal::INT), 4) AS refusal_rate, round(avg(source_count), 2) AS avg_source_count,
        round(avg((source_count = 0)::INT), 4) AS zero_source_rate, round(avg(retrieval_rounds), 2) AS avg_retrieval_rounds FROM tr WHERE {IN_WINDOW}""",
)
def usage_quality(spark, sf):
    return U.quality(traces(spark, sf), 168, NOW)


@query(
    "reflect_rate",
    f"""WITH {USAGE_CTE} SELECT count(DISTINCT trace_id) FILTER (status = 'ok') AS ok_traces, count(DISTINCT trace_id) AS reflect_traces,
        round(count(DISTINCT trace_id) FILTER (status = 'ok') / count(DISTINCT trace_id), 4) AS reflect_pass_rate FROM sp WHERE name LIKE '%reflect%'""",
)
def reflect_rate(spark, sf):
    return U.reflect_rate(spans(spark, sf))


@query(
    "span_breakdown",
    f"WITH {USAGE_CTE} SELECT span_type, count(*) AS spans, sum(duration_ms)::BIGINT AS total_ms, round(avg(duration_ms), 2) AS avg_ms FROM sp GROUP BY 1",
)
def span_breakdown(spark, sf):
    return U.span_breakdown(spans(spark, sf))


def _per_type(t: str) -> str:
    return (f"count(*) FILTER (span_type = '{t}') AS {t}_count, coalesce(sum(duration_ms) FILTER (span_type = '{t}'), 0)::BIGINT AS {t}_ms, "
            f"count(*) FILTER (span_type = '{t}' AND status = 'error') AS {t}_errors")


@query(
    "trace_summary",
    f"""WITH {USAGE_CTE} SELECT trace_id, count(*) AS span_count, count(*) FILTER (status = 'ok') AS ok_spans, count(*) FILTER (status = 'error') AS error_spans,
        count(*) FILTER (span_type = 'llm') AS llm_calls, sum(duration_ms) FILTER (name = 'retrieve')::BIGINT AS retrieval_total_ms,
        sum(duration_ms) FILTER (name = 'Rerank')::BIGINT AS rerank_total_ms, sum(duration_ms) FILTER (name = 'generate.llm')::BIGINT AS generate_total_ms,
        {', '.join(_per_type(t) for t in U.SPAN_TYPES)} FROM sp GROUP BY 1""",
)
def trace_summary(spark, sf):
    return U.trace_summary(spans(spark, sf))


@query(
    "price_and_cost",
    f"""WITH {USAGE_CTE} SELECT trace_id, cost_usd, round(cost_usd * 7.2::DECIMAL(8, 4), 4)::DECIMAL(20, 4) AS cost_cny, '$' || cost_usd::DECIMAL(20, 6) || '（≈¥' ||
        round(cost_usd * 7.2::DECIMAL(8, 4), 4)::DECIMAL(20, 4) || '）' AS cost_text FROM tr""",
)
def price_and_cost(spark, sf):
    t = traces(spark, sf)
    return t.select("trace_id", "cost_usd", U.to_cny(F.col("cost_usd")).alias("cost_cny"), U.format_cost(F.col("cost_usd")).alias("cost_text"))


@query(
    "usage_merge",
    f"""WITH {USAGE_CTE} SELECT 'prompt_tokens' AS key, sum(prompt_tokens)::BIGINT AS total FROM tr UNION ALL SELECT 'completion_tokens', sum(completion_tokens)::BIGINT FROM tr
        UNION ALL SELECT 'llm_calls', sum(llm_calls)::BIGINT FROM tr""",
)
def usage_merge(spark, sf):
    keys = ("prompt_tokens", "completion_tokens", "llm_calls")
    usage = F.create_map(*[x for k in keys for x in (F.lit(k), F.col(k))])
    return U.merge_usage(traces(spark, sf).select(usage.alias("usage")))


_HIST = """r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM me WHERE role IN ('user', 'assistant')) WHERE age <= 18)"""


@query(
    "history_window",
    f"""WITH RECURSIVE {USAGE_CTE}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM me
            WHERE role IN ('user', 'assistant')) WHERE age <= 10),
        f AS (SELECT conv_id, turn, age, (role = 'user')::INT AS turns, length(text) AS chars FROM r WHERE age = 1
          UNION ALL SELECT r.conv_id, r.turn, r.age, turns + (role = 'user')::INT, chars + length(text) FROM f JOIN r ON r.conv_id = f.conv_id AND r.age = f.age + 1
          WHERE turns < 2 AND chars + length(text) <= 900)
        SELECT conv_id, turn FROM f""",
)
def history_window(spark, sf):
    return U.history(messages(spark, sf), max_turns=2, max_chars=900).select("conv_id", "turn")


@query(
    "history_digest",
    f"""WITH {USAGE_CTE}, {_HIST} SELECT conv_id, left(string_agg(CASE WHEN role = 'user' THEN '用户：' ELSE '助手：' END || left(trim(text, E' \\t\\n\\r'), 120), ' / ' ORDER BY turn), 400) AS digest
        FROM r WHERE age <= 4 GROUP BY 1""",
)
def history_digest(spark, sf):
    return U.history_digest(messages(spark, sf))


@query(
    "conversation_title",
    r"""WITH q AS (SELECT conv_id, trim(regexp_replace(arg_min(text, turn), '\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'user' GROUP BY 1)
        SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'kept' WHEN q.t IS NULL THEN '新对话' WHEN length(t) > 30 THEN left(t, 30) || '…' ELSE t END AS title
        FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN q USING (conv_id)""",
)
def conversation_title(spark, sf):
    m = messages(spark, sf)
    title = F.when(F.col("conv_id") % 3 == 0, "kept").otherwise(U.DEFAULT_TITLE)
    return U.conversation_title(m.select("conv_id").distinct().withColumn("title", title), m)


@query(
    "trace_messages",
    f"""WITH {USAGE_CTE} SELECT trace_id, message_id, role, pos, content FROM (SELECT trace_id, message_id, role,
          row_number() OVER (PARTITION BY trace_id ORDER BY message_id)::INT AS pos, CASE WHEN length(text) > 300 THEN left(text, 300) || '…' ELSE text END AS content FROM me) WHERE pos <= 50""",
)
def trace_messages(spark, sf):
    return U.trace_messages(messages(spark, sf))


@query(
    "trace_detail",
    f"""WITH {USAGE_CTE}, p AS (SELECT trace_id, 'span' AS part, seq::BIGINT AS pos, name AS label, duration_ms::BIGINT AS amount FROM sp UNION ALL
          SELECT trace_id, 'message', pos, role, amount FROM (SELECT trace_id, role, row_number() OVER (PARTITION BY trace_id ORDER BY message_id) AS pos,
            least(length(text), 301)::BIGINT AS amount FROM me) WHERE pos <= 50)
        SELECT trace_id, status, part, pos, label, amount FROM tr LEFT JOIN p USING (trace_id)""",
)
def trace_detail(spark, sf):
    return U.trace_detail(traces(spark, sf), spans(spark, sf), messages(spark, sf))


@query(
    "citation_view",
    """WITH c AS (SELECT conv_id * 1000 + turn AS message_id, r.rank, (conv_id * 7 + turn * 3 + r.rank * 11) || ':0' AS chunk_key FROM conversations, (SELECT unnest([1, 2, 3]) AS rank) r WHERE role = 'assistant'),
            d AS (SELECT doc_id || ':0' AS chunk_key, 'doc_' || doc_id || '.txt' AS doc_name, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents)
       SELECT message_id, count(*) AS n, string_agg(rank || '=' || coalesce(doc_name, '?'), ';' ORDER BY rank) AS labels,
              sum(least(length(s), 201))::BIGINT AS snippet_chars FROM c LEFT JOIN d USING (chunk_key) GROUP BY 1""",
)
def citation_view(spark, sf):
    m = messages(spark, sf).filter("role = 'assistant'")
    key = F.concat((F.col("conv_id") * 7 + F.col("turn") * 3 + F.col("rank") * 11).cast("string"), F.lit(":0"))
    c = m.select("message_id", "conv_id", "turn", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("rank")).select("message_id", "rank", key.alias("chunk_key"))
    v = U.citation_view(c, doc_chunks(spark, sf), documents(spark, sf))
    label = F.transform("citations", lambda x: F.concat(x["rank"].cast("string"), F.lit("="), F.coalesce(x.doc_name, F.lit("?"))))
    chars = F.aggregate(F.transform("citations", lambda x: F.char_length(x.snippet).cast("long")), F.lit(None).cast("long"),
                        lambda a, x: F.when(x.isNull(), a).otherwise(F.coalesce(a, F.lit(0)) + x))
    return v.select("message_id", F.size("citations").cast("long").alias("n"), F.array_join(label, ";").alias("labels"), chars.alias("snippet_chars"))


@query(
    "feedback_latest",
    """SELECT user_id, event_type AS message_id, arg_max(event_id % 2 = 0, (ts, event_id)) AS rating FROM events GROUP BY ALL""",
)
def feedback_latest(spark, sf):
    e = table(spark, sf, "events")
    f = e.select(F.col("event_type").alias("message_id"), "user_id", (F.col("event_id") % 2 == 0).alias("rating"), F.col("ts").alias("created_at"), F.col("event_id").alias("feedback_id"))
    return U.latest_feedback(f)
