"""Usage analytics over traces, spans and messages: windows, percentiles, tokens, cost, series, histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from answerloom.functions import text as T
from answerloom.functions.filters import clamp_hours, last_hours, window_start
from answerloom.operators.skew import top_per_group

# --- fixed values -----------------------------------------------------------------------------------------------
USD_TO_CNY = "7.2"
DEFAULT_PRICE = ("0.00014", "0.00028")
RERANK_HINTS = ["rerank", "重排"]
GENERATE_HINTS = ["generate", "answer", "生成"]
SPAN_TYPES = ["retrieval", "llm", "node", "tool"]
MEMORY_ROLES = ["user", "assistant"]
DEFAULT_TITLE = "新对话"
# ----------------------------------------------------------------------------------------------------------------


def fits_budget(df: DataFrame, group: list[str], budget: int, text: str = "text") -> DataFrame:
    """Does the estimated token total of a group stay within the budget?"""
    return df.groupBy(*group).agg(F.sum(T.estimate_tokens(text)).alias("tokens")).withColumn("fits", F.col("tokens") <= budget)


# --- percentiles and totals -------------------------------------------------------------------------------------
def pct(col: str, p: float) -> Column:
    """Percentile with linear interpolation, p clamped to 0..100; 0 when there are no rows."""
    return F.coalesce(F.percentile(col, min(max(p, 0.0), 100.0) / 100.0), F.lit(0.0))


def latency_summary(df: DataFrame, by: Sequence[str] = (), latency: str = "latency_ms", approx: bool = False) -> DataFrame:
    """p50, p95, p99, max, mean and count. Exact by default: Spark keeps one counter per distinct value, which
    millisecond latencies bound; ``approx`` uses a fixed-size sketch instead."""
    quantile = (lambda p: F.coalesce(F.percentile_approx(latency, p / 100).cast("double"), F.lit(0.0))) if approx else (
        lambda p: pct(latency, p)
    )
    return df.groupBy(*by).agg(
        F.round(quantile(50), 2).alias("p50"),
        F.round(quantile(95), 2).alias("p95"),
        F.round(quantile(99), 2).alias("p99"),
        F.coalesce(F.max(latency).cast("double"), F.lit(0.0)).alias("max_ms"),
        F.coalesce(F.round(F.avg(latency), 2), F.lit(0.0)).alias("avg_ms"),
        F.count(latency).alias("n"),
    )


def _ratio(part: Column, whole: Column, digits: int) -> Column:
    return F.coalesce(F.round(F.when(whole > 0, part / whole), digits), F.lit(0.0))


def _sum(c: str) -> Column:
    return F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0))


def usage_totals(traces: DataFrame, hours: int, now: str) -> DataFrame:
    """One row for the window, also when it is empty."""
    errors = F.count_if(F.col("status") != "ok")
    total = F.count("*")
    tokens = _sum("prompt_tokens") + _sum("completion_tokens")
    cost = F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("decimal(20,6)")
    return last_hours(traces, "created_at", hours, now).agg(
        total.alias("requests"),
        errors.alias("errors"),
        (total - errors).alias("success"),
        _ratio(errors, total, 4).alias("error_rate"),
        _sum("prompt_tokens").alias("prompt_tokens"),
        _sum("completion_tokens").alias("completion_tokens"),
        tokens.alias("total_tokens"),
        _ratio(tokens, total, 2).alias("tokens_per_request"),
        cost.alias("cost_usd"),
        to_cny(cost).alias("cost_cny"),
        _sum("llm_calls").alias("llm_calls"),
    )


def usage_by_mode(traces: DataFrame) -> DataFrame:
    tokens = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    mode = F.when(F.col("mode") != "", F.col("mode"))
    return traces.groupBy(F.coalesce(mode, F.lit("unknown")).alias("mode")).agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("status") != "ok").alias("errors"),
        F.sum(tokens).alias("tokens"),
        _sum("llm_calls").alias("llm_calls"),
        F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("decimal(20,6)").alias("cost_usd"),
        F.round(F.avg(F.coalesce("latency_ms", F.lit(0))), 2).alias("avg_latency_ms"),
        F.round(F.avg(F.col("refusal").cast("int")), 4).alias("refusal_rate"),
    )


def usage_by_model(messages: DataFrame) -> DataFrame:
    """Assistant messages per model with their share; the window runs over the handful of aggregated rows."""
    rows = messages.filter("role = 'assistant'").groupBy(F.coalesce(F.when(F.col("model") != "", F.col("model")), F.lit("unknown")).alias("model"))
    agg = rows.agg(
        F.count("*").alias("messages"),
        F.sum(F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))).alias("tokens"),
        F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("decimal(20,6)").alias("cost_usd"),
    )
    total = agg.agg(F.sum("messages").alias("_all"))
    shared = agg.crossJoin(F.broadcast(total))  # one aggregated row
    return shared.withColumn("share", F.round(F.col("messages") / F.col("_all"), 4)).drop("_all").orderBy(F.desc("cost_usd"), "model")


def hourly_series(traces: DataFrame, hours: int, now: str) -> DataFrame:
    """``hours + 1`` buckets from the truncated window start; hours without requests are filled with zeros."""
    start = F.date_trunc("hour", window_start(hours, now)).cast("timestamp_ntz")
    n = clamp_hours(hours)
    spark = traces.sparkSession
    grid = spark.range(n + 1).select(F.timestamp_add("HOUR", F.col("id").cast("int"), start).alias("hour"))
    tokens = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    per_hour = (
        last_hours(traces, "created_at", hours, now)
        .groupBy(F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("hour"))
        .agg(
            F.count("*").alias("requests"),
            F.count_if(F.col("status") != "ok").alias("errors"),
            F.sum(tokens).alias("tokens"),
            F.sum("cost_usd").alias("cost_usd"),
            F.round(F.avg("latency_ms"), 2).alias("avg_latency_ms"),
            F.count_if("refusal").alias("refusals"),
        )
    )
    filled = grid.join(per_hour, "hour", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("requests", "errors", "tokens", "refusals")}
    cost = F.coalesce("cost_usd", F.lit(0)).cast("decimal(20,6)")
    return filled.withColumns({**zero, "cost_usd": cost, "avg_latency_ms": F.coalesce("avg_latency_ms", F.lit(0.0))})


def quality(traces: DataFrame, hours: int, now: str) -> DataFrame:
    total = F.count("*")
    sources = F.coalesce("source_count", F.lit(0))
    return last_hours(traces, "created_at", hours, now).agg(
        total.alias("requests"),
        _ratio(F.count_if("refusal"), total, 4).alias("refusal_rate"),
        _ratio(F.sum(sources), total, 2).alias("avg_source_count"),
        _ratio(F.count_if(sources == 0), total, 4).alias("zero_source_rate"),
        _ratio(F.sum(F.coalesce("retrieval_rounds", F.lit(0))), total, 2).alias("avg_retrieval_rounds"),
    )


def reflect_rate(spans: DataFrame, approx: bool = False) -> DataFrame:
    """Traces with an ok reflect span over traces with any. A trace-level combine replaces two distinct counts."""
    reflect = spans.filter(F.col("name").contains("reflect"))
    if approx:
        ok, every = F.approx_count_distinct(F.when(F.col("status") == "ok", F.col("trace_id"))), F.approx_count_distinct("trace_id")
        counts = reflect.agg(ok.alias("ok_traces"), every.alias("reflect_traces"))
    else:
        per_trace = reflect.groupBy("trace_id").agg(F.max(F.col("status") == "ok").alias("ok"))
        counts = per_trace.agg(F.count_if("ok").alias("ok_traces"), F.count("*").alias("reflect_traces"))
    return counts.withColumn("reflect_pass_rate", _ratio(F.col("ok_traces"), F.col("reflect_traces"), 4))


def span_breakdown(spans: DataFrame) -> DataFrame:
    return spans.groupBy("span_type").agg(
        F.count("*").alias("spans"), _sum("duration_ms").alias("total_ms"), F.round(F.avg("duration_ms"), 2).alias("avg_ms")
    ).orderBy(F.desc("total_ms"), "span_type")


def _has(col: Column, hints: Sequence[str]) -> Column:
    found = F.lit(False)
    for hint in hints:
        found = found | col.contains(hint)
    return found


def trace_summary(spans: DataFrame, types: Sequence[str] = tuple(SPAN_TYPES)) -> DataFrame:
    """Roll-up of the spans of a trace: name hints for rerank come first, then the type, then hints for generate."""
    name = F.lower("name")
    ms = F.col("duration_ms")
    rerank = _has(name, RERANK_HINTS)
    retrieval = ~rerank & (F.col("span_type") == "retrieval")
    generate = ~rerank & ~retrieval & _has(name, GENERATE_HINTS)

    def total(flag: Column) -> Column:
        return F.coalesce(F.sum(F.when(flag, ms)), F.lit(0))

    per_type = []
    for t in types:
        is_type = F.col("span_type") == t
        per_type += [
            F.count_if(is_type).alias(f"{t}_count"),
            total(is_type).alias(f"{t}_ms"),
            F.count_if(is_type & (F.col("status") == "error")).alias(f"{t}_errors"),
        ]
    return spans.groupBy("trace_id").agg(
        F.count("*").alias("span_count"),
        F.count_if(F.col("status") == "ok").alias("ok_spans"),
        F.count_if(F.col("status") == "error").alias("error_spans"),
        F.count_if(F.col("span_type") == "llm").alias("llm_calls"),
        total(retrieval).alias("retrieval_total_ms"),
        total(rerank).alias("rerank_total_ms"),
        total(generate).alias("generate_total_ms"),
        *per_type,
    )


# --- cost -------------------------------------------------------------------------------------------------------
def with_price(df: DataFrame, model: str, prices: Sequence[tuple[str, str, str]], default: tuple[str, str] = DEFAULT_PRICE) -> DataFrame:
    """Price of the first prefix in the ordered list that starts the model name, else the default.

    The list is short configuration, so it becomes one CASE expression beside the scan and needs no join.
    """
    name = F.lower(T.trim_ws(F.coalesce(model, F.lit(""))))
    prompt, completion = F.lit(default[0]), F.lit(default[1])
    for prefix, p, c in reversed(list(prices)):
        match = name.startswith(prefix.lower())
        prompt, completion = F.when(match, F.lit(p)).otherwise(prompt), F.when(match, F.lit(c)).otherwise(completion)
    return df.withColumn("prompt_price", prompt.cast("decimal(12,8)")).withColumn("completion_price", completion.cast("decimal(12,8)"))


def with_cost(df: DataFrame, model: str, prices: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``cost_usd`` from token counts and prices per 1000; negative counts are 0; half up to six places."""

    def count(c: str) -> Column:
        return F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("decimal(12,0)")

    priced = with_price(df, model, prices)
    raw = F.col("prompt_price") * count("prompt_tokens") + F.col("completion_price") * count("completion_tokens")
    cost = F.round((raw * F.lit("0.001").cast("decimal(4,3)")).cast("decimal(30,11)"), 6).cast("decimal(12,6)")
    return priced.withColumn("cost_usd", cost)


def to_cny(usd: Column, rate: str = USD_TO_CNY) -> Column:
    return F.round(usd.cast("decimal(20,6)") * F.lit(rate).cast("decimal(8,4)"), 4).cast("decimal(20,4)")


def format_cost(usd: Column, rate: str = USD_TO_CNY) -> Column:
    cny = to_cny(usd, rate).cast("string")
    return F.concat(F.lit("$"), usd.cast("decimal(20,6)").cast("string"), F.lit("（≈¥"), cny, F.lit("）"))


def merge_usage(df: DataFrame, keys: str = "usage") -> DataFrame:
    """Key-wise sum of token usage maps."""
    return df.select(F.explode(keys).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("total"))


# --- conversations ----------------------------------------------------------------------------------------------
def _remembered(messages: DataFrame, limit: int) -> DataFrame:
    """Newest ``limit`` user and assistant messages of every conversation; the cut happens before the shuffle."""
    newest = [F.desc("turn")]
    return top_per_group(messages.filter(F.col("role").isin(MEMORY_ROLES)), ["conv_id"], newest, limit, "age")


def history(messages: DataFrame, max_turns: int = 6, max_chars: int = 4000) -> DataFrame:
    """Messages kept as memory: from the newest back until a message would break either limit; the newest stays.

    At most ``max(3 x max_turns, 10)`` newest messages are looked at.
    """
    recent = _remembered(messages, max(3 * max_turns, 10))
    before = W.partitionBy("conv_id").orderBy("age").rowsBetween(W.unboundedPreceding, -1)
    turns = F.coalesce(F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(before), F.lit(0))
    chars = F.coalesce(F.sum(F.char_length("text")).over(before), F.lit(0))
    breaks = (F.col("age") > 1) & ((turns >= max_turns) | (chars + F.char_length("text") > max_chars))
    so_far = W.partitionBy("conv_id").orderBy("age").rowsBetween(W.unboundedPreceding, 0)
    return recent.withColumn("_break", F.max(breaks).over(so_far)).filter(~F.col("_break")).drop("_break", "age")


def history_digest(messages: DataFrame, user: str = "用户：", assistant: str = "助手：", limit: int = 400) -> DataFrame:
    """Last four turns in one line, 120 characters each."""
    label = F.when(F.col("role") == "user", user).otherwise(assistant)
    line = F.struct("turn", F.concat(label, F.left(T.trim_ws("text"), F.lit(120))).alias("s"))
    ordered = F.transform(F.array_sort(F.collect_list(line)), lambda x: x.s)
    recent = _remembered(messages, 4)
    return recent.groupBy("conv_id").agg(F.left(F.array_join(ordered, " / "), F.lit(limit)).alias("digest"))


def conversation_title(conversations: DataFrame, messages: DataFrame, size: int = 30) -> DataFrame:
    """First user question, collapsed and cut, for conversations that still have the default title."""
    first = messages.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("_q"))
    text = T.collapse_ws("_q")
    short = F.when(F.char_length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("…"))).otherwise(text)
    still_default = F.coalesce("title", F.lit(DEFAULT_TITLE)) == DEFAULT_TITLE
    new = F.when(still_default & (text != ""), short).otherwise(F.col("title"))
    return conversations.join(first, "conv_id", "left").withColumn("title", new).drop("_q")


def trace_messages(messages: DataFrame, limit: int = 50, size: int = 300) -> DataFrame:
    """At most 50 messages per trace, text cut to 300 characters."""
    cut = F.when(F.char_length("text") > size, F.concat(F.left("text", F.lit(size)), F.lit("…"))).otherwise(F.col("text"))
    rows = top_per_group(messages, ["trace_id"], [F.asc("message_id")], limit, "pos")
    return rows.select("trace_id", "message_id", "role", "pos", cut.alias("content"))


def trace_detail(traces: DataFrame, spans: DataFrame, messages: DataFrame) -> DataFrame:
    """Parts of every trace as rows: its spans by sequence, then its messages by id; a bare trace keeps one row.

    Rows instead of nested arrays, so a trace with very many spans is never gathered in one place.
    """
    s = spans.select("trace_id", F.lit("span").alias("part"), F.col("seq").cast("long").alias("pos"), F.col("name").alias("label"), F.col("duration_ms").cast("long").alias("amount"))
    m = trace_messages(messages).select("trace_id", F.lit("message").alias("part"), F.col("pos").cast("long"), F.col("role").alias("label"), F.char_length("content").cast("long").alias("amount"))
    return traces.select("trace_id", "status").join(s.unionByName(m), "trace_id", "left")


def citation_view(citations: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Citations of a message by rank, with the chunk text and the present document name where they still exist."""
    c = chunks.select("chunk_key", "content", "doc_id")
    d = documents.select("doc_id", "doc_name")
    joined = citations.join(c, "chunk_key", "left").join(d, "doc_id", "left")
    item = F.struct("rank", "chunk_key", "doc_name", T.snippet("content").alias("snippet"))
    return joined.groupBy("message_id").agg(F.array_sort(F.collect_list(item)).alias("citations"))


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """Latest rating per (message, user)."""
    return feedback.groupBy("message_id", "user_id").agg(F.max_by("rating", F.struct("created_at", "feedback_id")).alias("rating"))
