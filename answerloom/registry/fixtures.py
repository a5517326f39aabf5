"""Views over the given tables under the names and shapes the operators expect, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from answerloom.operators.admin import read_bm25_index, write_bm25_index
from answerloom.operators.bm25 import Bm25Index
from answerloom.operators.skew import spread_out
from answerloom.session import shared_dir

NOW = "2024-01-31 00:00:00"
DIM = 64
_STORED: dict[tuple[str, str], str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id",
        F.col("source").alias("kb_id"),
        F.format_string("doc_%d.txt", "doc_id").alias("doc_name"),
        "text",
        "lang",
        F.lit(None).cast("timestamp").alias("deleted_at"),
    )


def doc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as one chunk, with its language as section path."""
    chunks = table(spark, sf, "documents").select(
        F.col("source").alias("kb_id"),
        F.format_string("%d:0", "doc_id").alias("chunk_key"),
        "doc_id",
        F.lit(0).alias("chunk_index"),
        F.col("text").alias("content"),
        F.lit(None).cast("string").alias("parent_content"),
        F.col("lang").alias("section_path"),
        F.lit(None).cast("int").alias("page_no"),
    )
    return spread_out(chunks, "chunk_key")


def stored_index(spark: SparkSession, sf: str) -> Bm25Index:
    """The keyword index of ``doc_chunks``, written to the shared folder without knowing any question; once for a session and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORED:
        path = shared_dir(spark, "index")
        write_bm25_index(doc_chunks(spark, sf), path)
        _STORED[key] = path
    return read_bm25_index(spark, _STORED[key])


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


STOP_SQL = (
    "('the','a','an','of','to','in','is','are','and','or','for','on','at','by','with','how','what','which','who',"
    "'when','where','why')"
)


def tokens_sql(expr: str, stop: bool = True) -> str:
    """The Latin part of the tokeniser; the given tables hold no CJK text."""
    words = f"regexp_extract_all(lower({expr}), '[a-z0-9]+')"
    return f"list_filter({words}, lambda w: w NOT IN {STOP_SQL})" if stop else words


def coverage_sql(q_terms: str, t_tokens: str) -> str:
    return (
        f"(CASE WHEN len({q_terms}) = 0 OR len({t_tokens}) = 0 THEN 0.0 ELSE "
        f"len(list_intersect(list_distinct({q_terms}), list_distinct({t_tokens})))::DOUBLE"
        f" / len(list_distinct({q_terms})) END)"
    )


def bm25_cte(source: str) -> str:
    """Postings, statistics and BM25 scores over the relation ``source``(kb_id, chunk_key, toks), as CTEs."""
    return f"""
dl AS (SELECT kb_id, chunk_key, greatest(len(toks), 1) AS dl FROM {source}),
cs AS (SELECT kb_id, count(*) AS n, sum(dl) AS total_dl, avg(dl) AS avgdl FROM dl GROUP BY kb_id),
ps AS (SELECT kb_id, chunk_key, term, count(*) AS tf
       FROM (SELECT kb_id, chunk_key, unnest(toks) AS term FROM {source}) GROUP BY ALL),
ts AS (SELECT kb_id, term, count(*) AS df FROM ps GROUP BY ALL),
qt AS (SELECT query_id, term, count(*) AS mult
       FROM (SELECT item_id AS query_id, unnest({tokens_sql('text')}) AS term FROM benchmark) GROUP BY ALL),
bm AS (SELECT query_id, kb_id, chunk_key, round(sum(
         mult * ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.5 * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 9)
         AS bm25_score
       FROM qt JOIN ts USING (term) JOIN cs USING (kb_id) JOIN ps USING (kb_id, term) JOIN dl USING (kb_id, chunk_key)
       GROUP BY ALL)
"""


#: The same over whole documents.
BM25_CTE = f"""
ch AS (SELECT source AS kb_id, doc_id || ':0' AS chunk_key, {tokens_sql('text')} AS toks FROM documents),{bm25_cte('ch')}"""


# --- usage views ------------------------------------------------------------------------------------------------
MODELS = ["deepseek-chat", "gpt-4o-mini-2024", "GPT-4o", "local-model"]
PRICES = [
    ("gpt-4o-mini", "0.00015", "0.0006"),
    ("gpt-4o", "0.0025", "0.01"),
    ("deepseek-chat", "0.00027", "0.0011"),
]


def _price_sql(model: str, position: int) -> str:
    default = ("0.00014", "0.00028")[position]
    cases = " ".join(f"WHEN starts_with(lower({model}), '{p[0]}') THEN {p[position + 1]}" for p in PRICES)
    return f"(CASE {cases} ELSE {default} END)::DECIMAL(12, 8)"


def cost_sql(model: str, p: str, c: str) -> str:
    return (
        f"round((({_price_sql(model, 0)} * greatest({p}, 0)::DECIMAL(12, 0) + {_price_sql(model, 1)} * greatest({c}, 0)::DECIMAL(12, 0))"
        f" * 0.001::DECIMAL(4, 3))::DECIMAL(30, 11), 6)::DECIMAL(12, 6)"
    )


MODEL_SQL = "CASE {x} % 4 WHEN 0 THEN 'deepseek-chat' WHEN 1 THEN 'gpt-4o-mini-2024' WHEN 2 THEN 'GPT-4o' ELSE 'local-model' END"

USAGE_CTE = f"""
tr AS (SELECT *, {cost_sql('model', 'prompt_tokens', 'completion_tokens')} AS cost_usd FROM (
  SELECT event_id AS trace_id, ts AS created_at, CASE WHEN event_type <> 'error' THEN event_type END AS mode,
         CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, floor(value)::INT AS latency_ms,
         (event_id % 4096)::INT AS prompt_tokens, (event_id % 512)::INT AS completion_tokens, (event_id % 4)::INT AS llm_calls,
         event_id % 17 = 0 AS refusal, (event_id % 6)::INT AS source_count, (1 + event_id % 3)::INT AS retrieval_rounds,
         {MODEL_SQL.format(x='user_id')} AS model FROM events)),
sp AS (SELECT trace_id, created_at, 0 AS seq, 'retrieve' AS name, 'retrieval' AS span_type, latency_ms // 2 AS duration_ms, 'ok' AS status FROM tr
  UNION ALL SELECT trace_id, created_at, 1, 'Rerank', 'retrieval', latency_ms // 5, 'ok' FROM tr
  UNION ALL SELECT trace_id, created_at, 2, 'generate.llm', 'llm', latency_ms // 4, status FROM tr
  UNION ALL SELECT trace_id, created_at, 3, 'reflect', 'node', latency_ms // 20, CASE WHEN trace_id % 10 = 0 THEN 'error' ELSE 'ok' END
            FROM tr WHERE trace_id % 2 = 0),
me AS (SELECT *, {cost_sql('model', 'prompt_tokens', 'completion_tokens')} AS cost_usd FROM (
  SELECT conv_id, turn, conv_id * 1000 + turn AS message_id, conv_id AS trace_id, role, text,
         {MODEL_SQL.format(x='conv_id')} AS model, (ceil(length(text) / 4.0) * 3)::INT AS prompt_tokens,
         ceil(length(text) / 4.0)::INT AS completion_tokens FROM conversations))
"""


def _model(col: str):
    out = F.lit(MODELS[3])
    for i in (2, 1, 0):
        out = F.when(F.col(col) % 4 == i, MODELS[i]).otherwise(out)
    return out


def traces(spark: SparkSession, sf: str) -> DataFrame:
    from answerloom.operators.usage import with_cost

    return with_cost(traces_of(table(spark, sf, "events")), "model", PRICES)


def traces_of(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    return events.select(
        e.alias("trace_id"),
        F.col("ts").cast("timestamp_ntz").alias("created_at"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("mode"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        F.floor("value").cast("int").alias("latency_ms"),
        (e % 4096).cast("int").alias("prompt_tokens"),
        (e % 512).cast("int").alias("completion_tokens"),
        (e % 4).cast("int").alias("llm_calls"),
        (e % 17 == 0).alias("refusal"),
        (e % 6).cast("int").alias("source_count"),
        (1 + e % 3).cast("int").alias("retrieval_rounds"),
        _model("user_id").alias("model"),
    )


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """Three spans per trace and a reflect span for every second one, from one scan."""
    from pyspark.sql import Column

    t = traces_of(table(spark, sf, "events"))

    def span(seq: int, name: str, kind: str, share: int, status: Column) -> Column:
        ms = F.floor(F.col("latency_ms") / share).cast("int")
        return F.struct(F.lit(seq).alias("seq"), F.lit(name).alias("name"), F.lit(kind).alias("span_type"), ms.alias("duration_ms"), status.alias("status"))

    ok = F.lit("ok")
    reflect = F.when(
        F.col("trace_id") % 2 == 0,
        span(3, "reflect", "node", 20, F.when(F.col("trace_id") % 10 == 0, "error").otherwise("ok")),
    )
    all_spans = F.array_compact(
        F.array(span(0, "retrieve", "retrieval", 2, ok), span(1, "Rerank", "retrieval", 5, ok), span(2, "generate.llm", "llm", 4, F.col("status")), reflect)
    )
    return t.select("trace_id", "created_at", F.inline(all_spans))


def messages(spark: SparkSession, sf: str) -> DataFrame:
    from answerloom.functions.text import estimate_tokens
    from answerloom.operators.usage import with_cost

    c = table(spark, sf, "conversations").select(
        "conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), F.col("conv_id").alias("trace_id"),
        "role", "text", _model("conv_id").alias("model"), (estimate_tokens("text") * 3).alias("prompt_tokens"),
        estimate_tokens("text").alias("completion_tokens"),
    )
    return with_cost(c, "model", PRICES)
