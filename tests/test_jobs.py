import hashlib

import pytest
from pyspark.sql import functions as F

from answerloom.operators import admin as A, evaluate as E, usage as U
from answerloom.operators.skew import dense_index
from answerloom.registry import streams


def test_dense_index_numbers_without_gaps(spark):
    df = spark.createDataFrame([("a", i * 1000) for i in range(50)] + [("b", 7)], "g string, k long")
    got = dense_index(df, ["g"], "k", width=4096).collect()
    assert sorted((r.g, r.k, r.idx) for r in got) == [("a", i * 1000, i) for i in range(50)] + [("b", 7, 0)]


def scored(spark, alias):
    hits = spark.createDataFrame([("bm25", 1, 1, 5, "x.md", None), ("bm25", 1, 2, 6, "want.md", "A > B")],
                                 "mode string, case_id int, rank int, doc_id long, doc_name string, section_path string")
    cases = spark.createDataFrame([(1, ["B"]), (2, [])], "case_id int, expected_sections array<string>")
    expected = spark.createDataFrame([(1, "Want.md")], "case_id int, expected_doc string")
    want = E.expectations(cases, expected, alias)
    return {(r.mode, r.case_id): r for r in E.score_cases(hits, cases, want, 5, alias).collect()}


def test_case_scores(spark):
    got = scored(spark, False)
    one, two = got[("bm25", 1)], got[("bm25", 2)]
    assert (one.hit, one.recall_at_k, one.mrr) == (True, 1.0, 0.5) and one.ndcg == pytest.approx(0.63093, abs=1e-4)
    assert (two.hit, two.recall_at_k, two.mrr, two.ndcg) == (False, 0.0, 0.0, 0.0)


def test_alias_scores_see_three_ids_per_hit(spark):
    one = scored(spark, True)[("bm25", 1)]
    assert one.mrr == pytest.approx(1 / 5) and one.recall_at_k == 0.5


def test_bootstrap_edges(spark):
    same = spark.createDataFrame([(0, i, 1.0, 1.0) for i in range(5)], "run int, case_id long, a double, b double")
    row = E.paired_bootstrap(same, ["run"], 50).first()
    assert (row.delta, row.p_value, row.significant) == (0.0, 1.0, False)
    better = spark.createDataFrame([(0, i, 1.0, 0.0) for i in range(5)], "run int, case_id long, a double, b double")
    row = E.paired_bootstrap(better, ["run"], 50).first()
    assert (row.delta, row.p_value, row.significant, row.ci_low) == (1.0, 0.0, True, 1.0)
    point = E.bootstrap_ci(better.select("run", "case_id", F.col("a").alias("value")), ["run"], 0).first()
    assert point.low == point.high == point.point == 1.0


def test_bootstrap_draws_over_blocks_and_groups(spark):
    """Against plain Python: a group over several blocks, a missing value, a missing key (first, never drawn) and a missing group."""
    rows = [("a", i * 3, float(i * i % 101)) for i in range(300)] + [("b", 1, 2.0), ("b", 9, None), ("b", None, 5.0), (None, 4, 1.0), ("c", 1, None)]
    boots = 1 << 16  # blocks of 64 positions
    got = {(r.g, r.boot): r.mean for r in E._boot_means(spark.createDataFrame(rows, "g string, case_id long, value double"), ["g"], boots, 7).filter("boot % 6553 = 0").collect()}
    want = {}
    for g in "abc":
        n, held = sum(r[0] == g for r in rows), [r[2] for r in rows if r[0] == g and r[1] is not None]
        for boot in range(0, boots, 6553):
            drawn = [int(hashlib.md5(f"7:{boot}:{slot}".encode()).hexdigest()[:15], 16) % n for slot in range(n - len(held), n)]
            some = [held[i - n + len(held)] for i in drawn if i >= n - len(held)]
            if some:
                known = [v for v in some if v is not None]
                want[g, boot] = pytest.approx(sum(known) / len(known)) if known else None
    assert got == want


def test_bootstrap_plan_does_not_replicate_values(spark):
    """Draws meet the values in a cogroup of packed blocks: no join by position with a salted copy of every value."""
    df = spark.createDataFrame([(0, i, 1.0) for i in range(9)], "run int, case_id long, value double")
    plan = E._boot_means(df, ["run"], 50, 1)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "_salt" not in plan


@pytest.mark.parametrize("folder", [False, True])
def test_stream_source_reads_a_file_or_a_folder(spark, tmp_path, folder):
    """A table kept as a folder of files was listed as nothing, and the query failed for want of output."""
    rows, path = spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", "yes"), (2, 0, "user", "x")], "conv_id long, turn int, role string, text string"), str(tmp_path / "in")
    rows.repartition(2).write.parquet(f"{path}/conversations.parquet") if folder else rows.toPandas().to_parquet((tmp_path / "in").mkdir() or f"{path}/conversations.parquet")
    assert sorted(r.turns for r in streams.stream_conversation_history(spark, path).collect()) == ["0", "0,1"]


def test_stream_ingest_reads_a_folder(spark, tmp_path):
    spark.createDataFrame([(1, "a text", "web"), (2, "other words", "web"), (3, "third", "wiki")], "doc_id long, text string, source string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.kb_id: (r.chunks, r.documents) for r in streams.stream_ingested_chunks(spark, str(tmp_path)).collect()} == {"web": (2, 2), "wiki": (1, 1)}


def test_strict_pairing_refuses_other_sizes(spark):
    a = spark.createDataFrame([(1, True, 1.0, 1.0)], "case_id int, hit boolean, recall_at_k double, ndcg double")
    with pytest.raises(ValueError):
        E.pair_runs(a, a.limit(0), strict=True)


def test_sweep_marks_first_best(spark):
    s = spark.createDataFrame([(0.9, 0.2), (0.8, 0.3), (0.7, None)], "positive double, negative double")
    best = E.threshold_sweep(s, 30, 95).filter("best").first()
    assert (best.threshold, best.f1, best.tp, best.fp) == (0.31, 1.0, 3, 0)


def test_history_keeps_the_newest_and_stops(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", "x" * n) for i, n in enumerate([10, 10, 50, 5, 5000])]
    m = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    assert [r.turn for r in U.history(m, 6, 100).collect()] == [4]
    assert sorted(r.turn for r in U.history(m.filter("turn < 4"), 6, 60).collect()) == [2, 3]


def test_price_takes_first_prefix_and_default(spark):
    prices = [("gpt-4o-mini", "0.001", "0.002"), ("gpt-4o", "0.01", "0.02")]
    df = spark.createDataFrame([("GPT-4o-mini-x", 1000, -5), ("gpt-4o", 1000, 1000), ("other", 0, 0)], "m string, prompt_tokens int, completion_tokens int")
    assert [str(r.cost_usd) for r in U.with_cost(df, "m", prices).collect()] == ["0.001000", "0.030000", "0.000000"]


def test_empty_window_gives_one_zero_row(spark):
    t = spark.createDataFrame([], "created_at timestamp_ntz, status string, prompt_tokens int, completion_tokens int, cost_usd decimal(12,6), llm_calls int")
    row = U.usage_totals(t, 5, "2024-01-31 00:00:00").first()
    assert (row.requests, row.error_rate, row.total_tokens) == (0, 0.0, 0)


def test_vector_upsert_and_rejects(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = [("k", "a", [3.0, 4.0], 1), ("k", "a", [0.0, 2.0], 2), ("k", "b", [1.0], 1)]
    df = spark.createDataFrame(rows, "kb_id string, chunk_key string, embedding array<double>, seq int")
    bad = A.write_vectors(df, path, 2)
    assert [(r.chunk_key, r.reason) for r in bad.collect()] == [("b", "wrong dimension")]
    A.write_vectors(spark.createDataFrame([("k", "c", [1.0, 0.0], 1), ("z", "a", [1.0, 0.0], 1)], df.schema), path, 2)
    got = sorted((r.kb_id, r.chunk_key, list(r.embedding)) for r in spark.read.parquet(path).collect())
    assert got == [("k", "a", [0.0, 1.0]), ("k", "c", [1.0, 0.0]), ("z", "a", [1.0, 0.0])]


def test_vector_store_keeps_names_and_last_rows(spark, tmp_path):
    path, schema = str(tmp_path / "v"), "kb_id string, chunk_key string, embedding array<double>"
    A.write_vectors(spark.createDataFrame([("007", "a", [1.0, 0.0]), ("7", "a", [0.0, 1.0]), ("1e3", "a", [1.0, 0.0])], schema), path, 2)
    twice = spark.createDataFrame([("007", "a", [0.0, 1.0]), ("007", "a", [0.0, 1.0])], schema)
    A.write_vectors(twice, path, 2)
    got = sorted((r.kb_id, r.chunk_key, list(r.embedding)) for r in A.read_stored(spark, path, "kb_id string, chunk_key string, embedding array<float>").collect())
    assert got == [("007", "a", [0.0, 1.0]), ("1e3", "a", [1.0, 0.0]), ("7", "a", [0.0, 1.0])]


def test_a_failing_read_is_raised_and_keeps_the_store(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "v"), "kb_id string, chunk_key string, embedding array<double>"
    A.write_vectors(spark.createDataFrame([("k", "a", [1.0, 0.0])], schema), path, 2)

    def broken(*_):
        raise OSError("storage")

    monkeypatch.setattr(A, "read_stored", broken)
    with pytest.raises(OSError):
        A.write_vectors(spark.createDataFrame([("k", "b", [1.0, 0.0])], schema), path, 2)
    monkeypatch.undo()
    assert A.read_stored(spark, path, "kb_id string, chunk_key string, embedding array<float>").count() == 1


def test_index_of_an_emptied_collection_is_cleared(spark, tmp_path):
    schema = "kb_id string, chunk_key string, content string"
    chunks = spark.createDataFrame([("007", "a", "apple pear"), ("7", "b", "apple"), ("7", "c", "plum")], schema)
    path = str(tmp_path / "i")
    A.write_bm25_index(chunks, path)
    index = A.update_bm25_index(path, spark.createDataFrame([("7", "c", "kiwi")], schema), spark.createDataFrame([("007", "a")], "kb_id string, chunk_key string"))
    assert sorted((r.kb_id, r.chunk_key, r.term, r.tf) for r in index.postings.collect()) == [("7", "b", "apple", 1), ("7", "c", "kiwi", 1)]
    assert [(r.kb_id, r.n) for r in index.corpus.collect()] == [("7", 2)] and sorted(r.term for r in index.terms.collect()) == ["apple", "kiwi"]
    index = A.write_bm25_index(chunks.filter("kb_id = '007'").withColumn("content", F.lit("!")), path, chunks.select("kb_id"))
    assert index.postings.count() == 0 and [(r.kb_id, r.n) for r in index.corpus.collect()] == [("007", 1)]
