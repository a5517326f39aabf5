"""Usage roll-ups over a stream of traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def stream_hourly(traces: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """Requests, errors, tokens and cost per hour and mode. Rows behind the watermark are dropped; state holds one
    row per open hour and mode. Hours without requests are filled when the result is read, not in state."""
    tokens = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    return (
        traces.withWatermark("created_at", watermark)
        .groupBy(F.window("created_at", "1 hour"), F.coalesce("mode", F.lit("unknown")).alias("mode"))
        .agg(
            F.count("*").alias("requests"),
            F.count_if(F.col("status") != "ok").alias("errors"),
            F.sum(tokens).alias("tokens"),
            F.sum("cost_usd").cast("decimal(20,6)").alias("cost_usd"),
        )
        .select(F.col("window.start").alias("hour"), "mode", "requests", "errors", "tokens", "cost_usd")
    )


def stream_latency(traces: DataFrame, watermark: str = "2 hours", accuracy: int = 1000) -> DataFrame:
    """Rolling hour every 15 minutes: count, maximum, mean and sketched percentiles (an exact percentile would keep
    every value in state)."""
    return (
        traces.withWatermark("created_at", watermark)
        .groupBy(F.window("created_at", "1 hour", "15 minutes"))
        .agg(
            F.count("latency_ms").alias("n"),
            F.max("latency_ms").alias("max_ms"),
            F.round(F.avg("latency_ms"), 2).alias("avg_ms"),
            F.percentile_approx("latency_ms", [0.5, 0.95, 0.99], accuracy).alias("p"),
        )
        .select(
            F.col("window.start").alias("start"), "n", "max_ms", "avg_ms", F.col("p")[0].alias("p50_approx"), F.col("p")[1].alias("p95_approx"),
            F.col("p")[2].alias("p99_approx"),
        )
    )
