"""Queries over evaluation: benchmark items are cases; a document that contains the item verbatim is expected."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.functions import text as T
from answerloom.operators import bm25, evaluate as E
from answerloom.operators.skew import bounded_join, spread_out
from answerloom.plans.evaluation import evaluate, search_modes
from answerloom.plans.search import SearchConfig
from answerloom.registry import query
from answerloom.registry.fixtures import BM25_CTE, coverage_sql, doc_chunks, questions, stored_index, table, tokens_sql
from answerloom.registry.search import CFG, parts, search_cte
from answerloom.registry.vectors import DOT_CTE, vec_queries, vec_table


def verbatim(spark, sf):
    """(item_id, doc_id) where the document contains the item's text.

    Items meet documents through their rarest inner word, an equi join; containment is then tested on those pairs
    only. Words are what white space parts: all but the first and the last word of a passage are whole words, in that order, of
    any text that contains it, so no pair is missed. Passages without an inner word are looked for in every text; they are
    part of the stated set of questions.
    """
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("passage"))
    words = items.select("item_id", F.split("passage", r"\s+").alias("w"))
    inner = words.select("item_id", F.explode_outer(F.array_distinct(F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0))))).alias("term")).filter("term <> ''")
    docs = spread_out(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    tokens = docs.select("doc_id", F.array_distinct(F.split("text", r"\s+")).alias("w"))
    in_docs = tokens.select("doc_id", F.explode_outer("w").alias("term")).filter("term IS NOT NULL")
    in_docs = bounded_join(in_docs, inner.select("term").distinct(), ["term"], "left_semi", spread=["doc_id"])
    counts = in_docs.groupBy("term").agg(F.count("*").alias("df"))
    anchors = inner.join(counts, "term", "left").groupBy("item_id").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    pairs = bounded_join(in_docs, anchors, ["term"], spread=["doc_id"]).select("doc_id", "item_id")
    with_passage = bounded_join(pairs, items, ["item_id"], spread=["doc_id"])
    found = docs.join(with_passage, "doc_id").filter(F.contains("text", "passage")).select("item_id", "doc_id")
    bare = items.join(anchors, "item_id", "left_anti")
    return found.unionByName(docs.join(bare, F.contains("text", "passage")).select("item_id", "doc_id"))


def cases(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("case_id"), F.array().cast("array<string>").alias("expected_sections"))


def expected(spark, sf):
    return verbatim(spark, sf).select(F.col("item_id").alias("case_id"), F.format_string("doc_%d.txt", "doc_id").alias("expected_doc"))


_PAIRS = "vb AS (SELECT item_id, doc_id FROM benchmark b, documents d WHERE contains(d.text, b.text))"


@query("verbatim_cases", f"WITH {_PAIRS} SELECT item_id, doc_id FROM vb")
def verbatim_cases(spark, sf):
    return verbatim(spark, sf)


def _mode_hits(mode: str) -> str:
    return f"SELECT '{mode}' AS mode, query_id, rank, doc_id FROM (WITH RECURSIVE {search_cte(mode)} SELECT query_id, rank, doc_id FROM hits)"


_DCG = "sum(1.0 / log2(r + 1)) FILTER (m AND r <= {k})"
_IDEAL = "(SELECT sum(1.0 / log2(i + 1)) FROM range(1, least({k}, n_rel) + 1) t(i))"


def scores_sql(alias_compat: bool) -> str:
    """Scores per mode and case from the four modes' hits."""
    hits = " UNION ALL ".join(_mode_hits(m) for m in E.MODES)
    if alias_compat:
        # three ids per hit in sorted order: doc-id, stem name, full name ('doc_1' sorts before 'doc_1.txt')
        ids = """ex AS (SELECT mode, query_id, (rank - 1) * 3 + a.o AS pos, doc_id || ':' || a.o AS id, doc_id, a.o FROM h, (SELECT unnest([1, 2, 3]) AS o) a)"""
        match, rel = "o > 1 AND vb.doc_id IS NOT NULL", "2 * count(vb.doc_id)"
    else:
        ids = "ex AS (SELECT mode, query_id, rank AS pos, doc_id::VARCHAR AS id, doc_id, 2 AS o FROM h)"
        match, rel = "vb.doc_id IS NOT NULL", "count(vb.doc_id)"
    return f"""WITH {_PAIRS}, h AS ({hits}), {ids},
      nr AS (SELECT b.item_id, {rel} AS n_rel FROM benchmark b LEFT JOIN vb USING (item_id) GROUP BY 1),
      d1 AS (SELECT mode, query_id, id, doc_id, o, min(pos) AS pos FROM ex GROUP BY ALL),
      d2 AS (SELECT *, row_number() OVER (PARTITION BY mode, query_id ORDER BY pos) AS r FROM d1),
      d3 AS (SELECT d2.*, {match} AS m FROM d2 LEFT JOIN vb ON vb.item_id = d2.query_id AND vb.doc_id = d2.doc_id),
      s AS (SELECT mode, query_id, bool_or(m) AS hit, count(*) FILTER (m AND r <= 5) AS got, min(r) FILTER (m) AS first,
                   {_DCG.format(k=5)} AS dcg FROM d3 GROUP BY ALL),
      md AS (SELECT unnest({E.MODES}) AS mode)
      SELECT md.mode, nr.item_id AS case_id, coalesce(hit, false) AS hit,
             CASE WHEN n_rel > 0 THEN coalesce(got, 0) / n_rel ELSE 0.0 END AS recall_at_k, coalesce(1.0 / first, 0.0) AS mrr,
             CASE WHEN n_rel > 0 THEN coalesce(dcg, 0.0) / {_IDEAL.format(k=5)} ELSE 0.0 END AS ndcg
      FROM md CROSS JOIN nr LEFT JOIN s ON s.mode = md.mode AND s.query_id = nr.item_id"""


_ROUND = "SELECT mode, case_id, hit, round(recall_at_k, 6) AS recall_at_k, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM"


def scored(spark, sf, alias_compat=False):
    q, corpus = parts(spark, sf)
    return evaluate(cases(spark, sf), expected(spark, sf), q, corpus, 5, cfg=SearchConfig(**CFG), alias_compat=alias_compat)


def _six(df):
    return df.withColumns({c: F.round(c, 6) for c in ("recall_at_k", "mrr", "ndcg")})


@query("evaluation_cases", f"{_ROUND} ({scores_sql(False)})")
def evaluation_cases(spark, sf):
    return _six(scored(spark, sf))


@query("evaluation_cases_alias", f"{_ROUND} ({scores_sql(True)})")
def evaluation_cases_alias(spark, sf):
    return _six(scored(spark, sf, alias_compat=True))


@query(
    "evaluation_summary",
    f"""SELECT mode, count(*) AS case_count, round(avg(hit::INT), 6) AS hit_rate, round(avg(recall_at_k), 6) AS recall_at_k, round(avg(mrr), 6) AS mrr,
        round(avg(ndcg), 6) AS ndcg FROM ({scores_sql(False)}) GROUP BY 1""",
)
def evaluation_summary(spark, sf):
    return E.summarize_run(scored(spark, sf)).select("mode", "case_count", "hit_rate", "recall_at_k", "mrr", "ndcg")


def event_results(spark, sf):
    """Case results taken from events: the event type is the run, the event the case."""
    e = table(spark, sf, "events")
    i = F.col("event_id")
    return e.select(
        F.col("event_type").alias("mode"), i.alias("case_id"), (i % 3 > 0).alias("hit"), (i % 5 / 4.0).alias("recall_at_k"),
        (i % 7 / 6.0).alias("mrr"), (i % 11 / 10.0).alias("ndcg"), F.when(i % 2 == 0, i % 13 / 12.0).alias("faithfulness"),
        F.lit(None).cast("double").alias("answer_relevance"), F.floor("value").cast("int").alias("latency_ms"), (i % 17 == 0).alias("refusal"),
    )


RESULTS_CTE = """res AS (SELECT event_type AS mode, event_id AS case_id, event_id % 3 > 0 AS hit, event_id % 5 / 4.0 AS recall_at_k, event_id % 7 / 6.0 AS mrr,
  event_id % 11 / 10.0 AS ndcg, CASE WHEN event_id % 2 = 0 THEN event_id % 13 / 12.0 END AS faithfulness, floor(value)::INT AS latency_ms, event_id % 17 = 0 AS refusal FROM events)"""


@query(
    "run_summary",
    f"""WITH {RESULTS_CTE} SELECT mode, count(*) AS case_count, round(avg(hit::INT), 6) AS hit_rate, round(avg(recall_at_k), 6) AS recall_at_k,
        round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(avg(faithfulness), 6) AS faithfulness, NULL::DOUBLE AS answer_relevance,
        round(avg(latency_ms), 6) AS avg_latency_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_latency_ms, round(avg(refusal::INT), 6) AS refusal_rate
        FROM res GROUP BY 1""",
)
def run_summary(spark, sf):
    return E.summarize_run(event_results(spark, sf))


@query(
    "citation_precision",
    """WITH a AS (SELECT conv_id, turn, list_distinct([turn % 4, turn % 3, conv_id % 5]) AS c, [0, 1, conv_id % 7] AS r FROM conversations)
       SELECT conv_id, turn, round(len(list_intersect(c, list_distinct(r))) / len(c), 6) AS precision FROM a""",
)
def citation_precision(spark, sf):
    c = table(spark, sf, "conversations")
    t, v = F.col("turn"), F.col("conv_id")
    zero = F.lit(0).cast("long")
    p = E.citation_precision(F.array(t % 4, t % 3, v % 5), F.array(zero, zero + 1, v % 7))
    return c.select("conv_id", "turn", F.round(p, 6).alias("precision"))


@query(
    "rank_metrics",
    """WITH a AS (SELECT conv_id, turn, list_distinct([turn % 4, turn % 3 + 4, conv_id % 5, 1]) AS c, list_distinct([0, 1, conv_id % 7]) AS r FROM conversations),
            p AS (SELECT conv_id, turn, c, r, list_filter(list_transform(r, lambda x: list_position(c, x)), lambda x: x IS NOT NULL AND x > 0) AS m FROM
                  (SELECT conv_id, turn, r, [x[2] FOR x IN list_sort([[list_position(d, v), v] FOR v IN list_distinct(d)])] AS c FROM (SELECT conv_id, turn, r, [turn % 4, turn % 3 + 4, conv_id % 5, 1] AS d FROM a)))
       SELECT conv_id, turn, round(len(list_filter(m, lambda x: x <= 3)) / len(r), 6) AS recall, round(coalesce(1.0 / list_min(m), 0), 6)::DOUBLE AS mrr,
              round(coalesce(list_sum(list_transform(list_filter(m, lambda x: x <= 3), lambda x: 1 / log2(x + 1))), 0) / list_sum(list_transform(range(1, least(3, len(r)) + 1), lambda x: 1 / log2(x + 1))), 6) AS ndcg FROM p""",
)
def rank_metrics(spark, sf):
    c = table(spark, sf, "conversations")
    t, v = F.col("turn"), F.col("conv_id")
    zero = F.lit(0).cast("long")
    got, want = F.array(t % 4, t % 3 + 4, v % 5, zero + 1), F.array(zero, zero + 1, v % 7)
    six = lambda x: F.round(x, 6)
    return c.select("conv_id", "turn", six(E.recall_at_k(got, want, 3)).alias("recall"), six(E.mrr(got, want)).alias("mrr"), six(E.ndcg_at_k(got, want, 3)).alias("ndcg"))


@query(
    "expectation_match",
    f"""WITH {_PAIRS} SELECT query_id AS case_id, rank, doc_id, EXISTS (SELECT 1 FROM vb WHERE vb.item_id = h.query_id AND vb.doc_id = h.doc_id) AS hit
        FROM (WITH RECURSIVE {search_cte('bm25')} SELECT query_id, rank, doc_id FROM hits) h""",
)
def expectation_match(spark, sf):
    q, corpus = parts(spark, sf)
    hits = search_modes(q, corpus, ["bm25"], SearchConfig(**CFG)).withColumnRenamed("query_id", "case_id")
    return E.match_expected(hits, E.expectations(cases(spark, sf), expected(spark, sf))).select("case_id", "rank", "doc_id", "hit")


@query(
    "run_ablation",
    """WITH r AS (SELECT event_id AS run_id, CASE event_type WHEN 'click' THEN 'vector' WHEN 'view' THEN 'bm25' WHEN 'error' THEN 'hybrid' ELSE event_type END AS mode,
             event_id % 101 / 100.0 AS hit_rate, event_id % 97 / 96.0 AS recall_at_k, event_id % 89 / 88.0 AS mrr, event_id % 83 / 82.0 AS ndcg
             FROM events WHERE value > 10),
       l AS (SELECT r.* FROM r JOIN (SELECT mode, max(run_id) AS run_id FROM r GROUP BY 1) USING (mode, run_id)),
       b AS (SELECT * FROM l ORDER BY (mode = 'hybrid') DESC, run_id DESC LIMIT 1), m AS (SELECT unnest(['vector', 'bm25', 'hybrid', 'hybrid_rerank']) AS mode)
       SELECT m.mode, l.run_id, l.hit_rate, l.recall_at_k, l.mrr, l.ndcg, round(l.hit_rate - b.hit_rate, 6) AS delta_hit_rate, round(l.recall_at_k - b.recall_at_k, 6) AS delta_recall_at_k,
              round(l.mrr - b.mrr, 6) AS delta_mrr, round(l.ndcg - b.ndcg, 6) AS delta_ndcg FROM m LEFT JOIN l USING (mode) CROSS JOIN b""",
)
def run_ablation(spark, sf):
    """Runs taken from events: dataset, top_k and status by id, of which one combination is asked for."""
    e = table(spark, sf, "events")
    i, kind = F.col("event_id"), F.col("event_type")
    mode = F.when(kind == "click", "vector").when(kind == "view", "bm25").when(kind == "error", "hybrid").otherwise(kind)
    runs = e.select(
        i.alias("run_id"), mode.alias("mode"), F.lit(1).alias("dataset_id"), F.lit(5).alias("top_k"),
        F.when(F.col("value") > 10, "done").otherwise("failed").alias("status"), (i % 101 / 100.0).alias("hit_rate"),
        (i % 97 / 96.0).alias("recall_at_k"), (i % 89 / 88.0).alias("mrr"), (i % 83 / 82.0).alias("ndcg"),
    )
    return E.ablation(runs, 1, 5)


def _boot_cte(src: str, n_boot: int) -> str:
    """CTEs: src(grp, case_id, value) -> bm(grp, boot, mean)."""
    return f"""ix AS (SELECT grp, value, row_number() OVER (PARTITION BY grp ORDER BY case_id) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM {src}),
      dr AS (SELECT grp, boot, ('0x' || substr(md5('42:' || boot || ':' || idx), 1, 15))::BIGINT % n AS idx FROM ix, range({n_boot}) t(boot)),
      bm AS (SELECT grp, boot, avg(value) AS mean FROM dr JOIN ix USING (grp, idx) GROUP BY ALL)"""


@query(
    "bootstrap_interval",
    f"""WITH v AS (SELECT event_type AS grp, event_id AS case_id, value FROM events), {_boot_cte('v', 50)},
        p AS (SELECT grp, avg(value) AS point, count(*) AS n FROM v GROUP BY 1)
        SELECT grp, round(point, 6) AS point, n, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high
        FROM bm JOIN p USING (grp) GROUP BY ALL""",
)
def bootstrap_interval(spark, sf):
    v = table(spark, sf, "events").select(F.col("event_type").alias("grp"), F.col("event_id").alias("case_id"), "value")
    return E.bootstrap_ci(v, ["grp"], n_boot=50).select("grp", "n", *[F.round(c, 6).alias(c) for c in ("point", "low", "high")])


@query(
    "bootstrap_paired",
    f"""WITH v AS (SELECT 0 AS grp, doc_id AS case_id, (quality - toxic)::DOUBLE AS value FROM labels), {_boot_cte('v', 500)},
        p AS (SELECT avg(quality) AS a, avg(toxic) AS b, avg(quality - toxic) AS d, count(*) AS n FROM labels)
        SELECT 0 AS run, round(a, 6) AS mean_a, round(b, 6) AS mean_b, round(d, 6) AS delta,
               round(least(2.0 * count(*) FILTER (CASE WHEN d >= 0 THEN mean <= 0 ELSE mean >= 0 END) / count(*), 1.0), 6) AS p_value,
               least(2.0 * count(*) FILTER (CASE WHEN d >= 0 THEN mean <= 0 ELSE mean >= 0 END) / count(*), 1.0) < 0.05 AS significant,
               round(quantile_cont(mean, 0.025), 6) AS ci_low, round(quantile_cont(mean, 0.975), 6) AS ci_high, n
        FROM bm, p GROUP BY a, b, d, n""",
)
def bootstrap_paired(spark, sf):
    pairs = table(spark, sf, "labels").select(F.lit(0).alias("run"), F.col("doc_id").alias("case_id"), F.col("quality").cast("double").alias("a"), F.col("toxic").cast("double").alias("b"))
    return E.paired_bootstrap(pairs, ["run"], n_boot=500)


@query(
    "run_comparison",
    f"""WITH {RESULTS_CTE}, a AS (SELECT * FROM res WHERE mode = 'click'), b0 AS (SELECT * FROM res WHERE mode = 'click'),
        b AS (SELECT case_id, NOT hit AS hit, 1 - recall_at_k AS recall_at_k, mrr, ndcg * ndcg AS ndcg FROM b0),
        v AS (SELECT 0 AS grp, case_id, (b.hit::INT::DOUBLE + b.recall_at_k + b.ndcg) / 3 - (a.hit::INT::DOUBLE + a.recall_at_k + a.ndcg) / 3 AS value FROM a JOIN b USING (case_id)),
        {_boot_cte('v', 100)}, d AS (SELECT avg(value) AS d, count(*) AS n FROM v)
        SELECT round((SELECT avg(hit::INT) FROM b) - (SELECT avg(hit::INT) FROM a), 6) AS delta_hit_rate,
               round((SELECT avg(recall_at_k) FROM b) - (SELECT avg(recall_at_k) FROM a), 6) AS delta_recall_at_k, 0.0::DOUBLE AS delta_mrr,
               round((SELECT avg(ndcg) FROM b) - (SELECT avg(ndcg) FROM a), 6) AS delta_ndcg, n,
               round(least(2.0 * count(*) FILTER (CASE WHEN d >= 0 THEN mean <= 0 ELSE mean >= 0 END) / count(*), 1.0), 6) AS p_value,
               least(2.0 * count(*) FILTER (CASE WHEN d >= 0 THEN mean <= 0 ELSE mean >= 0 END) / count(*), 1.0) < 0.05 AS significant,
               round(quantile_cont(mean, 0.025), 6) AS ci_low, round(quantile_cont(mean, 0.975), 6) AS ci_high FROM bm, d GROUP BY d, n""",
)
def run_comparison(spark, sf):
    a = event_results(spark, sf).filter("mode = 'click'")
    b = a.withColumns({"hit": ~F.col("hit"), "recall_at_k": 1 - F.col("recall_at_k"), "ndcg": F.col("ndcg") * F.col("ndcg")})
    return E.compare_runs(a, b, n_boot=100)


@query(
    "run_pairing",
    f"WITH {RESULTS_CTE} SELECT a.case_id, a.hit AS a_hit, a.recall_at_k AS a_recall_at_k, a.ndcg AS a_ndcg, a.hit AS b_hit, a.recall_at_k AS b_recall_at_k, a.ndcg AS b_ndcg FROM res a WHERE latency_ms >= 20 AND latency_ms < 60",
)
def run_pairing(spark, sf):
    r = event_results(spark, sf)
    return E.pair_runs(r.filter("latency_ms >= 20"), r.filter("latency_ms < 60"))


_SWEEP = """SELECT t / 100 AS threshold, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 4)::DOUBLE AS recall, round(fp / (fp + tn), 4)::DOUBLE AS false_accept,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4)::DOUBLE AS precision, round(f1, 4)::DOUBLE AS f1, tp, fp, tn, fn, row_number() OVER (ORDER BY f1 DESC, t) = 1 AS best
  FROM (SELECT *, CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END AS f1 FROM (
    SELECT t, count(*) FILTER (positive >= t / 100) AS tp, count(*) FILTER (negative >= t / 100) AS fp, count(*) FILTER (positive < t / 100) AS fn, count(*) FILTER (negative < t / 100) AS tn
    FROM {s}, range({lo}, {hi} + 1) r(t) GROUP BY t))"""
_POSNEG = f"""{DOT_CTE}, smp AS (SELECT query_id, max(s) FILTER (label = q_label) AS positive, max(s) FILTER (label <> q_label) AS negative FROM dots WHERE chunk_key <> query_id GROUP BY 1)"""


def vector_samples(spark, sf):
    from answerloom.operators.vectors import best_pos_neg

    return best_pos_neg(vec_queries(spark, sf), vec_table(spark, sf))


@query("threshold_sweep_vector", f"WITH {_POSNEG} {_SWEEP.format(s='smp', lo=30, hi=95)}")
def threshold_sweep_vector(spark, sf):
    return E.threshold_sweep(vector_samples(spark, sf), 30, 95)


_COVER = f"""{BM25_CTE.strip()}, {_PAIRS}, qn AS (SELECT item_id AS query_id, len(list_distinct({tokens_sql('text')})) AS n FROM benchmark),
  cv AS (SELECT query_id, chunk_key, count(*) / any_value(qn.n) AS c FROM (SELECT DISTINCT query_id, term FROM qt) JOIN ps USING (term) JOIN qn USING (query_id) GROUP BY ALL),
  smp AS (SELECT * FROM (SELECT query_id, max(c) FILTER (vb.doc_id IS NOT NULL) AS positive, coalesce(max(c) FILTER (vb.doc_id IS NULL), 0) AS negative
          FROM cv LEFT JOIN vb ON vb.item_id = query_id AND vb.doc_id || ':0' = chunk_key GROUP BY 1) WHERE positive IS NOT NULL)"""


def text_samples(spark, sf):
    q = questions(spark, sf)
    index = stored_index(spark, sf)
    expected = verbatim(spark, sf).select(F.col("item_id").alias("query_id"), F.format_string("%d:0", "doc_id").alias("chunk_key"))
    return E.coverage_samples(E.coverage_scores(q, index.postings), expected)


@query("threshold_sweep_coverage", f"WITH {_COVER} {_SWEEP.format(s='smp', lo=0, hi=60)}")
def threshold_sweep_coverage(spark, sf):
    return E.threshold_sweep(text_samples(spark, sf), 0, 60)


@query(
    "calibration_samples",
    f"WITH {_COVER} SELECT query_id, round(positive, 6) AS positive, round(negative, 6) AS negative FROM smp",
)
def calibration_samples(spark, sf):
    return text_samples(spark, sf).select("query_id", F.round("positive", 6).alias("positive"), F.round("negative", 6).alias("negative"))


@query(
    "calibration_summary",
    f"""WITH {_POSNEG} SELECT count(*) AS samples, round(min(positive), 6) AS positive_min, round(avg(positive), 6) AS positive_mean, round(quantile_cont(positive, 0.5), 6) AS positive_median,
        round(max(positive), 6) AS positive_max, round(min(negative), 6) AS negative_min, round(avg(negative), 6) AS negative_mean, round(quantile_cont(negative, 0.5), 6) AS negative_median,
        round(max(negative), 6) AS negative_max FROM smp""",
)
def calibration_summary(spark, sf):
    return E.sample_summary(vector_samples(spark, sf))


@query(
    "case_upsert",
    """WITH o AS (SELECT c_mktsegment AS dataset, c_name AS question, 'old' AS ground_truth FROM customer WHERE c_acctbal < 5000),
        n AS (SELECT c_mktsegment AS dataset, c_name AS question, 'new' || max(c_custkey) AS ground_truth FROM customer WHERE c_acctbal > 2000 GROUP BY ALL)
       SELECT dataset, question, coalesce(n.ground_truth, o.ground_truth) AS ground_truth, CASE WHEN n.question IS NULL THEN 'kept' WHEN o.question IS NULL THEN 'inserted' ELSE 'updated' END AS change,
              CASE WHEN n.question IS NULL THEN 1 ELSE -1 END AS n_sections
       FROM o FULL JOIN n USING (dataset, question)""",
)
def case_upsert(spark, sf):
    c = table(spark, sf, "customer")
    none = F.array().cast("array<string>")
    cols = lambda truth, sec: [F.col("c_mktsegment").alias("dataset"), F.col("c_name").alias("question"), truth.alias("ground_truth"),
                               F.lit(None).cast("string").alias("expected_doc"), sec.alias("expected_sections"), none.alias("tags")]
    old = c.filter("c_acctbal < 5000").select(*cols(F.lit("old"), F.array(F.lit("s"))))
    new = c.filter("c_acctbal > 2000").select(*cols(F.concat(F.lit("new"), F.col("c_custkey").cast("string")), none), F.col("c_custkey").alias("seq"))
    merged = E.upsert_cases(old, new)
    return merged.select("dataset", "question", "ground_truth", "change", F.coalesce(F.size("expected_sections"), F.lit(-1)).alias("n_sections"))


_CONV = "cv AS (SELECT u.conv_id, a.turn, u.text AS q, a.text AS a FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user')"


@query(
    "rule_judgement",
    f"""WITH {_CONV}, c AS (SELECT conv_id, turn, {tokens_sql('q')} AS qt, {tokens_sql('a')} AS ans, {tokens_sql("q || chr(10) || a")} AS ct FROM cv)
        SELECT conv_id, turn, round({coverage_sql('ans', 'ct')}, 4) AS faithfulness, round({coverage_sql('qt', 'ans')}, 4) AS answer_relevance FROM c""",
)
def rule_judgement(spark, sf):
    c = table(spark, sf, "conversations")
    u = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    a = c.select("conv_id", "turn", F.col("text").alias("answer"))
    pairs = u.join(a, ["conv_id", "turn"]).withColumn("contexts", F.array("question", "answer"))
    return E.judge_rules(pairs).select("conv_id", "turn", "faithfulness", "answer_relevance")


@query(
    "first_hit_answer",
    f"""WITH RECURSIVE {search_cte('bm25')} SELECT query_id, md5(text) AS answer_md5 FROM hits WHERE rank = 1""",
)
def first_hit_answer(spark, sf):
    q, corpus = parts(spark, sf)
    hits = search_modes(q, corpus, ["bm25"], SearchConfig(**CFG))
    return E.first_hit_answer(hits).select("query_id", F.md5("answer").alias("answer_md5"))


@query(
    "tokenizer_parity",
    f"""WITH {_CONV}, c AS (SELECT conv_id, turn, {tokens_sql('q')} AS qi, {tokens_sql('a')} AS ai, {tokens_sql('q', False)} AS qe, {tokens_sql('a', False)} AS ae FROM cv)
        SELECT conv_id, turn, 0 AS only_index, len(list_filter(list_distinct(ae), lambda x: NOT list_contains(ai, x)))::INT AS only_eval,
               round({coverage_sql('qi', 'ai')}, 6) AS coverage_index, round({coverage_sql('qe', 'ae')}, 6) AS coverage_eval FROM c""",
)
def tokenizer_parity(spark, sf):
    c = table(spark, sf, "conversations")
    u = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("q"))
    pairs = u.join(c.select("conv_id", "turn", F.col("text").alias("a")), ["conv_id", "turn"])
    return E.tokenizer_parity(pairs, "q", "a").drop("q", "a")
