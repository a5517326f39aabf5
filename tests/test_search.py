import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerloom.functions.filters import FilterError, validate_where, where_to_column
from answerloom.operators import bm25, fusion as R, vectors as V
from answerloom.plans.search import NO_KB, Corpus, SearchConfig, hybrid_search


def chunks(spark, texts, kb="k"):
    rows = [(kb, f"{i}:0", i, 0, t, None, None, None, f"d{i}.md") for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "kb_id string, chunk_key string, doc_id long, chunk_index int, content string, parent_content string, section_path string, page_no int, doc_name string"
    )


def ask(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "query_id int, question string")


def scores(df):
    return {(r.query_id, r.chunk_key): r.bm25_score for r in df.collect()}


def test_bm25_hand_computed(spark):
    got = scores(bm25.bm25_topk(ask(spark, "apple pear"), bm25.build_index(chunks(spark, ["apple pear", "apple plum"])), 5))
    assert got[(0, "0:0")] == pytest.approx(math.log(1.2) + math.log(2), abs=1e-8)
    assert got[(0, "1:0")] == pytest.approx(math.log(1.2), abs=1e-8)


def test_bm25_repeated_query_tokens_add(spark):
    index = bm25.build_index(chunks(spark, ["apple pear", "plum fig"]))
    once, twice = scores(bm25.bm25_topk(ask(spark, "apple"), index, 5)), scores(bm25.bm25_topk(ask(spark, "apple apple"), index, 5))
    assert twice[(0, "0:0")] == pytest.approx(2 * once[(0, "0:0")], abs=1e-8)


def test_bm25_salted_join_agrees(spark, monkeypatch):
    texts = [f"apple word{i % 7} word{i % 3}" for i in range(40)]
    q = ask(spark, "apple word1", "word2 word5 word5")
    full = scores(bm25.bm25_topk(q, bm25.build_index(chunks(spark, texts)), 50))
    monkeypatch.setattr("answerloom.operators.skew.BROADCAST_ROWS", 0)
    assert scores(bm25.bm25_topk(q, bm25.build_index(chunks(spark, texts)), 50)) == full


def test_incremental_index_equals_rebuild(spark):
    before, after = chunks(spark, ["apple pear", "plum", "fig"]), chunks(spark, ["apple kiwi", "plum"])
    changed = bm25.apply_changes(
        bm25.postings(before), bm25.doc_stats(before), after.filter("doc_id = 0"), before.filter("doc_id = 2").select("kb_id", "chunk_key")
    )
    rebuilt = bm25.build_index(after)
    for part in ("postings", "corpus", "terms"):
        a, b = getattr(changed, part), getattr(rebuilt, part)
        assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))


def vector_frame(spark, matrix, name, **extra):
    rows = [(i, *extra.values(), [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{name} long, " + "".join(f"{k} string, " for k in extra) + "embedding array<float>")


@pytest.mark.parametrize("shared", [True, False])
def test_vector_topk_is_brute_force(spark, shared):
    rng = np.random.default_rng(1)
    v, q = rng.standard_normal((90, 8)), rng.standard_normal((7, 8))
    v, q = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (v, q))
    v[40] = v[3]
    got = V.vector_topk(vector_frame(spark, q, "query_id"), vector_frame(spark, v, "chunk_key", kb_id="k"), 5, shared=shared)
    got = sorted((r.query_id, r.vector_rank, r.chunk_key) for r in got.collect())
    sims = np.round(q.astype("float32").astype(float) @ v.astype("float32").astype(float).T, 9)
    want = [(i, n + 1, int(k)) for i in range(7) for n, k in enumerate(sorted(range(90), key=lambda k: (-sims[i, k], k))[:5])]
    assert got == want


def test_vector_search_refuses_other_dimensions(spark):
    with pytest.raises(Exception, match="dimension"):
        V.vector_topk(vector_frame(spark, np.eye(3), "query_id"), vector_frame(spark, np.eye(4), "chunk_key", kb_id="k"), 2).collect()
    with pytest.raises(ValueError):
        V.vector_topk(vector_frame(spark, np.eye(3), "query_id"), vector_frame(spark, np.eye(3), "chunk_key", kb_id="k"), 0)


def test_bucketed_search_recall(spark):
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((12, 32))
    v = centers[np.arange(240) % 12] + 0.3 * rng.standard_normal((240, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    q, vec = vector_frame(spark, v[:20], "query_id"), vector_frame(spark, v, "chunk_key", kb_id="k")
    exact = {(r.query_id, r.chunk_key) for r in V.vector_topk(q, vec, 10).collect()}
    near = {(r.query_id, r.chunk_key) for r in V.vector_topk_lsh(q, vec, 10, 32).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_bucketed_search_scores_in_blocks_and_keeps_the_same_rows(spark):
    """Against the plain join of pairs by bucket, with copies of a vector and rows without a collection; no row per pair is made."""
    v = np.round(np.random.default_rng(3).standard_normal((60, 8)), 1)
    v[40:50] = v[:10]
    rows = [(i, None if i % 11 == 5 else i % 2, x.tolist()) for i, x in enumerate(v)]
    vec = spark.createDataFrame(rows, "chunk_key long, kb_id int, embedding array<float>")
    q = vec.withColumnRenamed("chunk_key", "query_id")
    a, b = V.with_signatures(vec, 8, 12, 5), V.with_signatures(q, 8, 12, 5).withColumnRenamed("embedding", "_q")
    pairs = a.join(b, ["_table", "_sig", "kb_id"]).select("query_id", "chunk_key", F.round(V.dot("embedding", "_q"), 9).alias("s")).distinct()
    scores = {}
    for r in pairs.collect():
        scores.setdefault(r.query_id, []).append((-r.s, r.chunk_key))
    found = V.vector_topk_lsh(q, vec, 5, 8)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r.vector_rank):
        got.setdefault(r.query_id, []).append((-r.vector_score, r.chunk_key))
    assert got == {k: sorted(x)[:5] for k, x in scores.items()}
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()


def test_hash_embedding_of_blank_text_is_zero(spark):
    df = spark.createDataFrame([("Ab1",), ("!?",), (None,)], "t string").select(V.hash_embed("t", 16).alias("e"))
    full, blank, missing = (np.array(r.e) for r in df.collect())
    assert np.linalg.norm(full) == pytest.approx(1.0) and not blank.any() and not missing.any()


def test_user_model_failure_is_visible_and_degrades(spark):
    def broken():
        raise RuntimeError("no model")

    df = spark.createDataFrame([(1, "abc")], "id long, t string")
    failed = V.embed_with(df, "t", broken, 8)
    row = failed.first()
    assert row.embed_mode == "failed" and "no model" in row.embed_error
    assert V.degrade_to_hash(failed, "t", 8).first().embed_mode == "hash"
    good = V.embed_with(df, "t", lambda: lambda texts: [[3.0, 4.0] for _ in texts], 2).first()
    assert good.embedding == pytest.approx([0.6, 0.8])


def test_filters(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")

    def ids(where):
        return [r.n for r in df.filter(where_to_column(where, df.schema)).orderBy("n").collect()]

    assert ids({"s": {"$ne": "a"}}) == [2] and ids({"s": {"$nin": ["a"]}}) == [2] and ids({"s": "a"}) == [1]
    assert ids({"s": {"$gt": 1}}) == [] and ids({"absent": {"$ne": 1}}) == [1, 2] and ids({"absent": 1}) == []
    assert ids({"$or": [{"n": 2}, {"s": "a"}]}) == [1, 2]
    for bad in ({}, {"a": 1, "b": 2}, {"$and": [{"a": 1}]}, {"a": None}, {"a": {"$contains": "x"}}, {"a": {"$in": 1}}, {"a": {"$gt": 1, "$lt": 2}}, {"$not": []}):
        with pytest.raises(FilterError):
            validate_where(bad)


def candidates(spark, rows):
    return spark.createDataFrame(rows, "query_id int, chunk_key string, vector_score double, bm25_score double")


def test_minmax_of_equal_scores_is_one(spark):
    df = candidates(spark, [(1, "a", 0.5, 2.0), (1, "b", 0.5, None)])
    got = df.select(R.minmax(F.col("vector_score")).alias("v"), R.minmax(F.col("bm25_score")).alias("b")).collect()
    assert [(r.v, r.b) for r in got] == [(1.0, 1.0), (1.0, None)]


def test_rrf_counts_only_lists_a_key_is_in(spark):
    df = candidates(spark, [(1, "a", 0.9, None), (1, "b", 0.1, 3.0)])
    got = {r.chunk_key: r.fused for r in R.fuse_rrf(df).collect()}
    assert got["a"] == pytest.approx(1 / 61) and got["b"] == pytest.approx(1 / 62 + 1 / 61)


def test_weighted_alpha_is_clamped(spark):
    df = candidates(spark, [(1, "a", 0.9, 1.0), (1, "b", 0.1, 3.0)])
    assert {r.chunk_key: r.fused for r in R.fuse_weighted(df, 7.0).collect()} == {"a": 1.0, "b": 0.0}


def test_autocut_keeps_at_least_one_and_can_be_off(spark):
    df = candidates(spark, [(1, "a", 1.0, None), (1, "b", 0.2, None)]).withColumn("score", F.col("vector_score"))
    assert R.autocut(df, 0.35).filter("kept").count() == 1
    assert R.autocut(df, 0.0).filter("kept").count() == 2
    assert R.autocut(df.withColumn("score", F.lit(0.0)), 0.35).filter("kept").count() == 2


def test_budget_skips_and_goes_on(spark):
    df = spark.createDataFrame([(1, 1, 700), (1, 2, 900), (1, 3, 200)], "query_id int, rank int, context_chars int")
    kept = lambda **kw: sorted(r["rank"] for r in R.trim_to_budget(df, 1000, **kw).filter("fits").collect())
    assert kept() == [1, 3] and kept(min_keep=2) == [1, 2]


def test_gate_reports_queries_without_candidates(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    c = spark.createDataFrame([(1, None, 0.5), (2, 0.1, 0.1)], "query_id int, vector_score double, keyword_coverage double")
    got = {r.query_id: (r.passed, r.reason) for r in R.gate(q, c).collect()}
    assert got == {1: (True, R.REASON_KEYWORD), 2: (False, R.REASON_BELOW), 3: (False, R.REASON_NO_CANDIDATES)}


def test_batch_equals_single_queries_and_missing_kb_is_reported(spark):
    c = chunks(spark, ["apple pear tart", "plum cake", "apple cake", "fig jam"])
    q = ask(spark, "apple cake", "fig", "nothing here").withColumn("embedding", V.hash_embed("question", 16))
    corpus = Corpus(c, bm25.build_index(c), c.select("kb_id", "chunk_key", V.hash_embed("content", 16).alias("embedding")))
    cfg = SearchConfig(all_kbs=True)
    key = lambda df: sorted((r.query_id, r["rank"], r.chunk_key, r.score) for r in df.collect())
    batch = key(hybrid_search(q, corpus, cfg).hits)
    single = sorted(x for i in range(3) for x in key(hybrid_search(q.filter(f"query_id = {i}"), corpus, cfg).hits))
    assert batch == single and batch
    debug = hybrid_search(q, corpus, SearchConfig()).debug.collect()
    assert {r.vector_error for r in debug} == {NO_KB} and all(r.vector_candidates == 0 for r in debug)
    listed = q.withColumn("kb_ids", F.array(F.lit("k")))
    assert key(hybrid_search(listed, corpus, SearchConfig()).hits) == batch
    unnamed = q.withColumn("kb_ids", F.lit(None).cast("array<string>"))
    rows = hybrid_search(unnamed, corpus, SearchConfig()).debug.collect()
    assert any(r.bm25_candidates > 0 for r in rows) and all(r.vector_candidates == 0 and r.vector_error == NO_KB for r in rows)


def test_collections_may_share_chunk_keys(spark):
    cols = "query_id int, kb_id string, chunk_key string, {0}_score double, {0}_rank int"
    vec = spark.createDataFrame([(1, "a", "0:0", 0.5, 1), (1, None, "1:0", 0.4, 2)], cols.format("vector"))
    bm = spark.createDataFrame([(1, "b", "0:0", 2.0, 1), (1, "a", "0:0", 1.0, 2), (1, None, "1:0", 0.5, 3)], cols.format("bm25"))
    got = sorted((r.kb_id or "", r.chunk_key, r.vector_score, r.bm25_score) for r in R.merge_recall(vec, bm).collect())
    assert got == [("", "1:0", 0.4, 0.5), ("a", "0:0", 0.5, 1.0), ("b", "0:0", None, 2.0)]
    both = chunks(spark, ["apple pear", "plum"], "a").unionByName(chunks(spark, ["apple fig", "nut"], "b"))
    corpus = Corpus(both, bm25.build_index(both), None, None)
    hits = hybrid_search(ask(spark, "apple"), corpus, SearchConfig(mode="bm25", all_kbs=True)).hits.collect()
    assert sorted((r.kb_id, r.content) for r in hits) == [("a", "apple pear"), ("b", "apple fig")]
