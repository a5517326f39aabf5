"""Evaluation of retrieval runs: case scoring, run summaries, comparison, bootstrap, threshold calibration."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T_
from pyspark.sql.pandas.types import to_arrow_schema

from answerloom.functions import text as T
from answerloom.operators.skew import bounded_join, dense_index

MODES = ["vector", "bm25", "hybrid", "hybrid_rerank"]
METRICS = ["hit_rate", "recall_at_k", "mrr", "ndcg"]
CONFIDENCE = 0.95
SIGNIFICANT = 0.05


# --- rank metrics on arrays of ids (a case has at most ``top_k`` hits) -------------------------------------------
def recall_at_k(retrieved: Column, relevant: Column, k: int) -> Column:
    if k <= 0:
        return F.lit(0.0)
    want = F.array_distinct(relevant)
    found = F.size(F.array_intersect(F.slice(F.array_distinct(retrieved), 1, k), want))
    return F.when(F.size(want) > 0, found / F.size(want)).otherwise(F.lit(0.0))


def _matches(retrieved: Column, relevant: Column) -> Column:
    """1-based ranks of the distinct retrieved ids that are relevant."""
    flags = F.transform(F.array_distinct(retrieved), lambda x, i: F.when(F.array_contains(relevant, x), i + 1))
    return F.array_compact(flags)


def mrr(retrieved: Column, relevant: Column) -> Column:
    return F.coalesce(1.0 / F.array_min(_matches(retrieved, relevant)), F.lit(0.0))


def _gain(ranks: Column) -> Column:
    return F.aggregate(ranks, F.lit(0.0), lambda acc, r: acc + 1.0 / F.log2(r + 1.0))


def ndcg_at_k(retrieved: Column, relevant: Column, k: int) -> Column:
    if k <= 0:
        return F.lit(0.0)
    n = F.least(F.lit(k), F.size(F.array_distinct(relevant)))
    dcg = _gain(F.filter(_matches(retrieved, relevant), lambda r: r <= k))
    return F.when(n > 0, dcg / _gain(F.sequence(F.lit(1), F.greatest(n, F.lit(1))))).otherwise(F.lit(0.0))


def hit_rate(hit: Column) -> Column:
    return F.coalesce(F.avg(hit.cast("double")), F.lit(0.0))


def citation_precision(cited: Column, relevant: Column) -> Column:
    ids = F.array_distinct(cited)
    return F.when(F.size(ids) > 0, F.size(F.array_intersect(ids, F.array_distinct(relevant))) / F.size(ids)).otherwise(F.lit(0.0))


# --- case scoring -----------------------------------------------------------------------------------------------
def doc_ident(name: Column | str) -> Column:
    """One id per document: the normalised name without its extension."""
    key = T.norm_key(name)
    stem = F.regexp_replace(key, r"\.[^.]*$", "")
    return F.when(stem != "", stem).otherwise(key)


def expectations(cases: DataFrame, expected: DataFrame, alias_compat: bool = False) -> DataFrame:
    """(case_id, id) rows to match hits against: ``doc:``/``section:`` keys decide hits, ``id:`` rows count as relevant
    documents. cases(case_id, expected_sections), expected(case_id, expected_doc).

    Expectations stay rows: a passage copied into very many documents makes many rows, never one long array.
    """
    doc_ids = (
        F.transform(T.doc_keys("expected_doc"), lambda k: F.concat(F.lit("id:"), k))
        if alias_compat
        else F.array(F.concat(F.lit("id:"), doc_ident("expected_doc")))
    )
    docs = expected.select("case_id", F.explode_outer(F.concat(T.doc_keys("expected_doc"), doc_ids)).alias("id"))
    sections = F.flatten(F.transform("expected_sections", T.section_keys))
    return docs.unionByName(cases.select("case_id", F.explode_outer(sections).alias("id"))).filter("id IS NOT NULL").distinct()


def _hit_ids(hits: DataFrame, alias_compat: bool) -> DataFrame:
    """(mode, case_id, rank, ord, id): match keys with ord 0, then the ids a hit contributes to the rank metrics."""
    keys = F.concat(T.doc_keys("doc_name"), T.section_keys("section_path"))
    if alias_compat:
        names = F.transform(T.doc_keys("doc_name"), lambda k: F.concat(F.lit("id:"), k))
        ids = F.concat(F.array(F.concat(F.lit("id:#"), F.col("doc_id").cast("string"))), F.array_sort(names))
    else:
        ids = F.array(F.concat(F.lit("id:"), doc_ident("doc_name")))
    cells = F.concat(
        F.transform(keys, lambda k: F.struct(F.lit(0).alias("ord"), k.alias("id"))),
        F.transform(ids, lambda x, i: F.struct((i + 1).cast("int").alias("ord"), x.alias("id"))),
    )
    return hits.select("mode", "case_id", "rank", F.inline(cells))


def _flag_matches(ids: DataFrame, want: DataFrame, small: bool | None = None) -> DataFrame:
    """Add ``m``: is (case_id, id) expected? Only expectations that some hit asks for are looked at."""
    asked = ids.select("case_id", "id").distinct()
    found = bounded_join(want, asked, ["case_id", "id"], "left_semi", spread=["id"], small_is_small=small)
    return ids.join(found.withColumn("_m", F.lit(True)), ["case_id", "id"], "left").withColumn("m", F.coalesce("_m", F.lit(False))).drop("_m")


def match_expected(hits: DataFrame, want: DataFrame) -> DataFrame:
    """Flag (``hit``) hits whose document or section key their case expects."""
    keys = _flag_matches(_hit_ids(hits, False).filter("ord = 0"), want)
    flags = keys.groupBy("mode", "case_id", "rank").agg(F.max("m").alias("hit"))
    return hits.join(flags, ["mode", "case_id", "rank"])


def score_cases(hits: DataFrame, cases: DataFrame, want: DataFrame, k: int, alias_compat: bool = False) -> DataFrame:
    """hit, recall, MRR and nDCG per (mode, case); cases without hits score 0 in every mode.

    hits(mode, case_id, rank, doc_id, doc_name, section_path), at most ``top_k`` per case. Rank metrics see one id per
    document; with ``alias_compat`` every hit contributes its number, stem and name in turn, as older reports did.
    """
    flagged = _flag_matches(_hit_ids(hits, alias_compat), want)
    once = flagged.filter("ord > 0").groupBy("mode", "case_id", "id").agg(
        F.min(F.struct("rank", "ord")).alias("pos"), F.max("m").alias("m")
    )
    order = W.partitionBy("mode", "case_id").orderBy("pos")
    ranked = once.withColumn("r", F.row_number().over(order))
    good = F.col("m") & (F.col("r") <= k)
    metrics = ranked.groupBy("mode", "case_id").agg(
        F.count_if(good).alias("got"), F.min(F.when(F.col("m"), F.col("r"))).alias("first"),
        F.sum(F.when(good, 1.0 / F.log2(F.col("r") + 1.0))).alias("dcg"),
    )
    hit = flagged.filter("ord = 0").groupBy("mode", "case_id").agg(F.max("m").alias("hit"))
    n_rel = want.filter(F.col("id").startswith("id:")).groupBy("case_id").agg(F.count("*").cast("int").alias("n_rel"))
    modes = F.explode(F.array(*[F.lit(m) for m in MODES])).alias("mode")
    df = cases.select("case_id", modes).join(n_rel, "case_id", "left")
    df = df.join(metrics, ["mode", "case_id"], "left").join(hit, ["mode", "case_id"], "left")
    some = F.coalesce("n_rel", F.lit(0)) > 0
    ideal = _gain(F.sequence(F.lit(1), F.greatest(F.least(F.lit(k), F.col("n_rel")), F.lit(1))))
    zero = F.lit(0.0)
    return df.select(
        "mode", "case_id", F.coalesce("hit", F.lit(False)).alias("hit"),
        F.when(some & F.lit(k > 0), F.coalesce("got", F.lit(0)) / F.col("n_rel")).otherwise(zero).alias("recall_at_k"),
        F.coalesce(1.0 / F.col("first"), zero).alias("mrr"),
        F.when(some & F.lit(k > 0), F.coalesce("dcg", zero) / ideal).otherwise(zero).alias("ndcg"),
    )


def summarize_run(results: DataFrame, by: Sequence[str] = ("mode",)) -> DataFrame:
    """Averages per run, rounded to 6; a metric nothing computed is NULL, never 0."""

    def mean(c: str) -> Column:
        return F.round(F.avg(c), 6) if c in results.columns else F.lit(None).cast("double")

    has_latency = "latency_ms" in results.columns
    p95 = F.round(F.percentile("latency_ms", 0.95), 6) if has_latency else F.lit(None).cast("double")
    refusal = F.round(F.avg(F.col("refusal").cast("double")), 6) if "refusal" in results.columns else F.lit(None).cast("double")
    return results.groupBy(*by).agg(
        F.count("*").alias("case_count"), F.round(hit_rate(F.col("hit")), 6).alias("hit_rate"),
        mean("recall_at_k").alias("recall_at_k"), mean("mrr").alias("mrr"), mean("ndcg").alias("ndcg"),
        mean("faithfulness").alias("faithfulness"), mean("answer_relevance").alias("answer_relevance"),
        mean("latency_ms").alias("avg_latency_ms"), p95.alias("p95_latency_ms"), refusal.alias("refusal_rate"),
    )


def ablation(runs: DataFrame, dataset_id: int, top_k: int, baseline: str = "hybrid", modes: Sequence[str] = tuple(MODES)) -> DataFrame:
    """Newest finished run per mode and its distance to the baseline mode (else to the newest run); empty rows for
    modes without a run. At most one row per mode takes part after the first combine."""
    fields = ["run_id", *METRICS]
    done = runs.filter((F.col("dataset_id") == dataset_id) & (F.col("top_k") == top_k) & (F.col("status") == "done"))
    latest = done.groupBy("mode").agg(F.max_by(F.struct(*fields), "run_id").alias("r")).select("mode", "r.*")
    spark = runs.sparkSession
    names = spark.createDataFrame([(m, i) for i, m in enumerate(modes)], "mode string, ord int")
    table = names.join(latest, "mode", "left")
    base = latest.agg(F.max_by(F.struct(*METRICS), F.struct(F.col("mode") == baseline, "run_id")).alias("b"))
    joined = table.crossJoin(F.broadcast(base))  # one aggregated row
    deltas = [F.round(F.col(m) - F.col(f"b.{m}"), 6).alias(f"delta_{m}") for m in METRICS]
    return joined.select("mode", "run_id", *METRICS, *deltas)


def pair_runs(a: DataFrame, b: DataFrame, strict: bool = False) -> DataFrame:
    """Cases both runs share; ``strict`` refuses runs of different size."""
    if strict and a.count() != b.count():
        raise ValueError("paired comparison needs the same cases in both runs")
    left = a.select("case_id", *[F.col(c).alias(f"a_{c}") for c in ("hit", "recall_at_k", "ndcg")])
    right = b.select("case_id", *[F.col(c).alias(f"b_{c}") for c in ("hit", "recall_at_k", "ndcg")])
    return left.join(right, "case_id")


def composite(prefix: str) -> Column:
    return (F.col(f"{prefix}hit").cast("double") + F.col(f"{prefix}recall_at_k") + F.col(f"{prefix}ndcg")) / 3


def compare_runs(a: DataFrame, b: DataFrame, n_boot: int = 2000, seed: int = 42) -> DataFrame:
    """Differences B - A per metric with the paired bootstrap of the composite, interval and sign also as B - A.

    Runs of different size are not significant and get a zero interval.
    """
    sizes = F.struct(F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.avg("recall_at_k").alias("recall_at_k"), F.avg("mrr").alias("mrr"), F.avg("ndcg").alias("ndcg"))
    totals = a.agg(sizes.alias("a")).crossJoin(b.agg(sizes.alias("b")))  # two aggregated rows
    pairs = pair_runs(a, b).select(F.lit(0).alias("run"), "case_id", composite("b_").alias("a"), composite("a_").alias("b"))
    test = paired_bootstrap(pairs, ["run"], n_boot, seed)
    joined = totals.crossJoin(F.broadcast(test))  # one aggregated row
    same = F.col("a.n") == F.col("b.n")
    deltas = [F.round(F.col(f"b.{m}") - F.col(f"a.{m}"), 6).alias(f"delta_{m}") for m in METRICS]
    return joined.select(
        *deltas, "n", F.when(same, F.col("p_value")).otherwise(1.0).alias("p_value"),
        (same & F.col("significant")).alias("significant"),
        F.when(same, F.col("ci_low")).otherwise(0.0).alias("ci_low"), F.when(same, F.col("ci_high")).otherwise(0.0).alias("ci_high"),
    )


# --- bootstrap --------------------------------------------------------------------------------------------------
def _boot_hashes(start: int, stop: int, n_boot: int, seed: int) -> np.ndarray:
    """The leading 60 bits of md5("seed:boot:slot"), slot by slot and in each resample by resample."""
    heads = [f"{seed}:{boot}:".encode() for boot in range(n_boot)]
    slots = [str(slot).encode() for slot in range(start, stop)]
    digests = b"".join([hashlib.md5(head + slot).digest()[:8] for slot in slots for head in heads])  # noqa: S324 - a draw, not a secret
    return np.frombuffer(digests, dtype=">u8").astype(np.int64) >> 4 & (1 << 60) - 1


def _boot_means(df: DataFrame, group: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """Mean of every resample: df(group..., case_id, value) -> (group..., boot, mean).

    Every row opens one draw slot per resample; the slot's hash picks a position in its group. Draws travel as packed
    integers to the block of positions they fall into, where the block's values wait; what leaves is one sum per block and
    resample. A draw costs four bytes of shuffle, a block holds at most 2 ** 22 expected draws, and a slot's hashes are taken
    once for all groups that have it.
    """
    width, span = max(1, (1 << 18) // n_boot), max(64, min(1 << 16, (1 << 22) // n_boot))
    packed = "<u4" if n_boot * span <= 1 << 32 else "<u8"
    fields = [df.schema[c] for c in group]
    sizes = df.groupBy(*group).agg(F.count("*").alias("_n"), F.count("case_id").alias("_m")).filter("_m > 0").dropna(subset=list(group))
    least = F.col("_n") - F.col("_m")  # rows without a key come first and are not drawn
    slots = sizes.select(*group, "_n", least.alias("_least"), F.explode(F.sequence(least - F.pmod(least, F.lit(width)), F.col("_n") - 1, F.lit(width).cast("long"))).alias("_start"))
    dealt = slots.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, "_start").sortWithinPartitions("_start")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hashes = -1, np.zeros(0, np.int64)
        boots = np.tile(np.arange(n_boot, dtype=np.int64) * span, width)
        for batch in batches:
            sized = zip(*(batch.column(c).to_pylist() for c in ("_n", "_least", "_start")), strict=True)
            for i, (n, least, start) in enumerate(sized):
                if start != at:
                    at, hashes = start, _boot_hashes(start, start + width, n_boot, seed)
                idx = hashes[max(least - start, 0) * n_boot : (min(n, start + width) - start) * n_boot] % n
                block = idx // span
                order = np.argsort(block, kind="stable")
                codes = (boots[: len(idx)] + idx - block * span)[order].astype(packed)
                found, first = np.unique(block[order], return_index=True)
                rows = [c.tobytes() for c in np.split(codes, first[1:])]
                own = [pa.array(batch.column(c).slice(i, 1).to_pylist() * len(rows), batch.column(c).type) for c in group]
                yield pa.RecordBatch.from_arrays([*own, pa.array(found), pa.array(rows, pa.binary())], names=[*group, "_block", "_draws"])

    def fetch(draws: pa.Table, rows: pa.Table) -> pa.Table:
        if not (draws.num_rows and rows.num_rows):
            return empty
        values, held, known = np.zeros(span), np.zeros(span, dtype=bool), np.zeros(span, dtype=bool)
        place, value = rows.column("_at").to_numpy(), rows.column("value")
        held[place], known[place] = True, value.is_valid().to_numpy()
        values[place] = value.fill_null(0.0).to_numpy()
        sums = np.zeros((3, n_boot))
        for piece in draws.column("_draws").to_pylist():
            boot, at = np.divmod(np.frombuffer(piece, dtype=packed).astype(np.int64), span)
            sums += [np.bincount(boot, weights=w[at], minlength=n_boot) for w in (values, known, held)]
        some = np.flatnonzero(sums[2])
        own = [pa.array(draws.column(c).slice(0, 1).to_pylist() * len(some), draws.column(c).type) for c in group]
        columns = [*own, pa.array(some, pa.int32()), pa.array(sums[0, some]), pa.array(sums[1, some].astype(np.int64))]
        return pa.Table.from_arrays(columns, names=[*group, "boot", "_sum", "_count"])

    keyed = T_.StructType([*fields, T_.StructField("_block", T_.LongType())])
    summed = T_.StructType([*fields, T_.StructField("boot", T_.IntegerType()), T_.StructField("_sum", T_.DoubleType()), T_.StructField("_count", T_.LongType())])
    empty = to_arrow_schema(summed).empty_table()
    draws = dealt.mapInArrow(draw, keyed.add("_draws", T_.BinaryType()))
    indexed = dense_index(df.select(*group, "case_id", F.col("value").cast("double").alias("value")), group, "case_id")
    rows = indexed.select(*group, F.floor(F.col("idx") / span).alias("_block"), F.pmod("idx", F.lit(span)).alias("_at"), "value")
    keys = [*group, "_block"]
    sums = draws.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(fetch, summed)
    return sums.groupBy(*group, "boot").agg(F.when(F.sum("_count") > 0, F.sum("_sum") / F.sum("_count")).alias("mean"))


def bootstrap_ci(df: DataFrame, group: Sequence[str], n_boot: int = 2000, seed: int = 42, confidence: float = CONFIDENCE) -> DataFrame:
    """Percentile interval of a mean per group; without resampling low = high = point."""
    point = df.groupBy(*group).agg(F.avg("value").alias("point"), F.count("*").alias("n"))
    if n_boot <= 0:
        return point.withColumn("low", F.col("point")).withColumn("high", F.col("point"))
    tail = (1 - confidence) / 2
    bounds = _boot_means(df, group, n_boot, seed).groupBy(*group).agg(
        F.percentile("mean", tail).alias("low"), F.percentile("mean", 1 - tail).alias("high")
    )
    return point.join(bounds, list(group))


def paired_bootstrap(pairs: DataFrame, group: Sequence[str], n_boot: int = 2000, seed: int = 42) -> DataFrame:
    """Is the mean of a - b different from 0? pairs(group..., case_id, a, b); p is two-sided and at most 1."""
    diffs = pairs.select(*group, "case_id", (F.col("a") - F.col("b")).alias("value"))
    point = pairs.groupBy(*group).agg(
        F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg(F.col("a") - F.col("b")).alias("delta"), F.count("*").alias("n")
    )
    if n_boot <= 0:
        return point.select(*group, "mean_a", "mean_b", "delta", F.lit(1.0).alias("p_value"), F.lit(False).alias("significant"),
                            F.col("delta").alias("ci_low"), F.col("delta").alias("ci_high"), "n")
    means = bounded_join(_boot_means(diffs, group, n_boot, seed), point.select(*group, "delta"), group, spread=["boot"])
    opposite = F.when(F.col("delta") >= 0, F.col("mean") <= 0).otherwise(F.col("mean") >= 0)
    tail = (1 - CONFIDENCE) / 2
    test = means.groupBy(*group).agg(
        F.least(2.0 * F.count_if(opposite) / F.count("*"), F.lit(1.0)).alias("p"),
        F.percentile("mean", tail).alias("low"), F.percentile("mean", 1 - tail).alias("high"),
    )
    six = lambda c: F.round(c, 6)
    return point.join(test, list(group)).select(
        *group, six("mean_a").alias("mean_a"), six("mean_b").alias("mean_b"), six("delta").alias("delta"), six("p").alias("p_value"),
        (F.col("p") < SIGNIFICANT).alias("significant"), six("low").alias("ci_low"), six("high").alias("ci_high"), "n",
    )


# --- calibration ------------------------------------------------------------------------------------------------
def threshold_sweep(samples: DataFrame, lo: int, hi: int) -> DataFrame:
    """Counts and rates for thresholds lo/100 ... hi/100 over samples(positive, negative); ``best`` marks the first
    maximum of F1.

    Samples are first counted per step they reach, one combine over the data; the cumulative sums then run over one
    row per threshold.
    """
    both = samples.select(F.inline(F.array(
        F.struct(F.col("positive").alias("v"), F.lit(1).alias("pos"), F.lit(0).alias("neg")),
        F.struct(F.col("negative").alias("v"), F.lit(0).alias("pos"), F.lit(1).alias("neg")),
    ))).filter("v IS NOT NULL")
    guess = F.floor(F.col("v") * 100).cast("long")
    step = F.when((guess + 1) / 100 <= F.col("v"), guess + 1).when(guess / 100 > F.col("v"), guess - 1).otherwise(guess)
    reach = F.least(F.greatest(step, F.lit(lo - 1)), F.lit(hi))
    counts = both.groupBy(reach.alias("step")).agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    grid = samples.sparkSession.range(lo - 1, hi + 1).select(F.col("id").alias("step"))
    above = W.orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, 0)  # one row per threshold
    every = W.partitionBy()
    filled = grid.join(counts, "step", "left").na.fill(0, ["p", "q"])
    t = filled.select(
        "step", F.sum("p").over(above).alias("tp"), F.sum("q").over(above).alias("fp"), F.sum("p").over(every).alias("np"), F.sum("q").over(every).alias("nq")
    ).filter(F.col("step") >= lo)
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("np") - F.col("tp"), F.col("nq") - F.col("fp")
    zero = F.lit(0.0)
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(zero)
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(zero)
    rates = t.withColumns({"fn": fn, "tn": tn, "_p": precision, "_r": recall})
    f1 = F.when(F.col("_p") + F.col("_r") > 0, 2 * F.col("_p") * F.col("_r") / (F.col("_p") + F.col("_r"))).otherwise(zero)
    rates = rates.withColumn("_f1", f1)
    best = F.row_number().over(W.orderBy(F.desc("_f1"), "step")) == 1
    accept = F.when(F.col("nq") > 0, fp / F.col("nq")).otherwise(zero)
    return rates.withColumn("best", best).select(
        (F.col("step") / 100).alias("threshold"), F.round("_r", 4).alias("recall"), F.round(accept, 4).alias("false_accept"),
        F.round("_p", 4).alias("precision"), F.round("_f1", 4).alias("f1"), "tp", "fp", "tn", "fn", "best",
    )


def coverage_scores(queries: DataFrame, postings: DataFrame, text: str = "question") -> DataFrame:
    """Coverage of every (query, chunk) pair that shares a term, from the postings; all other pairs have 0."""
    terms = queries.select("query_id", T.query_terms(text).alias("t")).withColumn("n_terms", F.size("t"))
    wanted = terms.select("query_id", "n_terms", F.explode_outer("t").alias("term")).filter("term IS NOT NULL")
    matches = bounded_join(postings.select("kb_id", "chunk_key", "term"), wanted, ["term"], spread=["chunk_key"])
    return matches.groupBy("query_id", "kb_id", "chunk_key", "n_terms").agg(F.count("*").alias("_hit")).select(
        "query_id", "kb_id", "chunk_key", (F.col("_hit") / F.col("n_terms")).alias("coverage")
    )


def coverage_samples(scores: DataFrame, expected: DataFrame) -> DataFrame:
    """Best coverage inside and outside the expected chunks per query; expected(query_id, chunk_key)."""
    flagged = scores.join(expected.withColumn("_in", F.lit(True)), ["query_id", "chunk_key"], "left")
    inside = F.coalesce("_in", F.lit(False))
    best = flagged.groupBy("query_id").agg(
        F.max(F.when(inside, F.col("coverage"))).alias("positive"),
        F.coalesce(F.max(F.when(~inside, F.col("coverage"))), F.lit(0.0)).alias("negative"),
    )
    return best.filter("positive IS NOT NULL")


def sample_summary(samples: DataFrame) -> DataFrame:
    """min, mean, median and max of the positive and the negative samples."""
    def stats(c: str) -> list[Column]:
        return [F.round(f(c), 6).alias(f"{c}_{n}") for n, f in (("min", F.min), ("mean", F.avg), ("median", lambda x: F.percentile(x, 0.5)), ("max", F.max))]

    return samples.agg(F.count("*").alias("samples"), *stats("positive"), *stats("negative"))


# --- datasets and answers ---------------------------------------------------------------------------------------
def upsert_cases(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert or update cases by (dataset, question), never delete; of repeated incoming cases the last wins.

    Empty lists are stored as NULL.
    """
    keys = ["dataset", "question"]
    fields = ["ground_truth", "expected_doc", "expected_sections", "tags"]
    lists = {c: F.when(F.size(c) > 0, F.col(c)) for c in ("expected_sections", "tags")}
    last = incoming.withColumns(lists).groupBy(*keys).agg(F.max_by(F.struct(*fields), "seq").alias("n"))
    joined = existing.select(*keys, F.struct(*fields).alias("o")).join(last, keys, "full_outer")
    taken = F.when(F.col("n").isNotNull(), F.col("n")).otherwise(F.col("o"))
    change = F.when(F.col("n").isNull(), "kept").when(F.col("o").isNull(), "inserted").otherwise("updated")
    return joined.select(*keys, taken.alias("v"), change.alias("change")).select(*keys, "v.*", "change")


def judge_rules(answers: DataFrame) -> DataFrame:
    """Rule scores per answer(question, answer, contexts): faithfulness and relevance by coverage, 4 places;
    0 for an empty answer or one that opens with the refusal phrase."""
    text = T.trim_ws(F.coalesce("answer", F.lit("")))
    empty = (text == "") | text.startswith(T.REFUSAL_MARKERS[0])
    tokens = T.tokenize(text)
    faithful = T.coverage_of(tokens, T.tokenize(F.array_join("contexts", "\n")))
    relevant = T.coverage_of(T.tokenize("question"), tokens)
    zero = F.lit(0.0)
    return answers.withColumn("faithfulness", F.round(F.when(empty, zero).otherwise(faithful), 4)).withColumn(
        "answer_relevance", F.round(F.when(empty, zero).otherwise(relevant), 4)
    )


def first_hit_answer(hits: DataFrame) -> DataFrame:
    return hits.filter("rank = 1").select("query_id", F.coalesce("context_text", F.lit("")).alias("answer"))


def tokenizer_parity(df: DataFrame, question: str, text: str) -> DataFrame:
    """Index and evaluation tokenisers side by side: tokens only one of them makes, and both coverages."""
    index, other = T.tokenize(text), T.tokenize_eval(text)
    return df.withColumns({
        "only_index": F.size(F.array_except(index, other)),
        "only_eval": F.size(F.array_except(other, index)),
        "coverage_index": F.round(T.coverage(question, text), 6),
        "coverage_eval": F.round(T.coverage_eval(question, text), 6),
    })
