import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from answerloom.operators import admin, bm25, impact, vectors as V


def corpus(spark, n=300, seed=1, kbs=("a", "b")):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(2000)]
    rows = [(kbs[i % len(kbs)], f"{i}:0", i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(n)]
    return spark.createDataFrame(rows, "kb_id string, chunk_key string, doc_id long, content string")


def asked(spark, seed=2, n=20):
    rng = random.Random(seed)
    return spark.createDataFrame([(f"q{i}", " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(1, 8)))) for i in range(n)], "query_id string, question string")


def rows(df):
    return sorted((r.query_id, r.kb_id, r.chunk_key, round(r.bm25_score, 8), r.bm25_rank) for r in df.collect())


@pytest.mark.parametrize("per_kb", [False, True])
def test_blocks_give_the_same_hits(spark, tmp_path, monkeypatch, per_kb):
    monkeypatch.setattr(impact, "RECORD", 40)
    monkeypatch.setattr(impact, "BLOCK", 8)
    monkeypatch.setattr(impact, "WEIGHTS", 16)
    chunks, q = corpus(spark), asked(spark)
    index = admin.write_bm25_index(chunks, str(tmp_path / "i"))
    assert index.blocks.count() >= 8
    plain = bm25.bm25_topk(q, bm25.build_index(chunks), 4, per_kb=per_kb)
    assert rows(bm25.bm25_topk(q, index, 4, per_kb=per_kb)) == rows(plain)
    some = q.withColumn("kb_ids", F.array(F.lit("b")))
    assert rows(bm25.bm25_topk(some, index, 4)) == rows(bm25.bm25_topk(some, bm25.build_index(chunks), 4))


def test_search_exchanges_only_its_best_rows(spark, tmp_path):
    index = admin.write_bm25_index(corpus(spark), str(tmp_path / "i"))
    plan = bm25.bm25_topk(asked(spark), index, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "MapInArrow" in plan
    above = plan[: plan.index("MapInArrow")]
    assert above.count("Exchange") == 1  # the merge of the tasks' first rows


def test_blocks_are_skipped_and_no_hit_is_lost(spark, tmp_path):
    chunks = corpus(spark, 3000, kbs=("a",))
    record = [impact._plain(b, i) for b in impact.blocked(bm25.postings(chunks)).coalesce(1).toArrow().to_batches() for i in range(b.num_rows)]
    rng = np.random.default_rng(3)
    met = scored = 0
    for r in record:
        s = impact.Searcher(r, 30.0, 1.5, 0.75)
        spans = np.diff(np.append(0, r["block_ends"])[s.first])
        some = np.flatnonzero((spans >= 8) & (spans <= 40))
        for _ in range(30):
            at = np.append(rng.choice(some, 2, replace=False), np.argsort(-spans)[:3])  # two rare terms among common ones
            weights = np.log(1 + 3000 / spans[at])
            got = dict(zip(*s.top(r["terms"][at], weights, 3, 0.0), strict=True))
            want = np.zeros(s.n)
            for t, w in zip(at, weights, strict=True):
                lo, hi = (r["block_ends"][e - 1] if e else 0 for e in (s.first[t], s.first[t + 1]))
                place, tf = r["place"][lo:hi], r["tf"][lo:hi]
                np.add.at(want, place, w * tf / (tf + s.norm[place]))
            for p in np.lexsort((np.arange(s.n), -want))[:3]:
                assert want[p] == 0 or abs(got[p] - want[p]) < 1e-9
        met, scored = met + s.work.met, scored + s.work.scored
    assert 0 < scored < 0.9 * met


def test_a_broken_write_leaves_the_last_version(spark, tmp_path, monkeypatch):
    path, chunks, q = str(tmp_path / "i"), corpus(spark), asked(spark)
    admin.write_bm25_index(chunks, path)
    before, version = rows(bm25.bm25_topk(q, admin.read_bm25_index(spark, path), 5)), admin.index_version(spark, path)
    write = admin._write_table
    for table in ("doc_stats", "terms", "corpus", "blocks"):
        with monkeypatch.context() as m:
            m.setattr(admin, "_write_table", lambda df, to: (_ for _ in ()).throw(OSError("disk")) if f"/{table}/" in to else write(df, to))
            with pytest.raises(OSError):
                admin.update_bm25_index(path, corpus(spark, 50, 9), chunks.limit(0))
        assert admin.index_version(spark, path) == version
    assert rows(bm25.bm25_topk(q, admin.read_bm25_index(spark, path), 5)) == before


def test_updates_touch_named_collections_and_removal_is_written(spark, tmp_path):
    path, q = str(tmp_path / "i"), asked(spark)
    chunks = corpus(spark)
    admin.write_bm25_index(chunks, path)
    more = spark.createDataFrame([("c", "x:0", 900, "w1 w2 fresh"), ("a", "0:0", 0, "w1 w1 changed")], chunks.schema)
    admin.update_bm25_index(path, more, spark.createDataFrame([("b", "1:0")], "kb_id string, chunk_key string"))
    keyed = chunks.filter("chunk_key NOT IN ('0:0', '1:0')").unionByName(more)
    assert rows(bm25.bm25_topk(q, admin.read_bm25_index(spark, path), 5)) == rows(bm25.bm25_topk(q, bm25.build_index(keyed), 5))
    gone = spark.createDataFrame([(900,), (2,), (3,)], "doc_id long")
    index = admin.remove_from_index(path, gone, keyed)
    left = keyed.filter("doc_id NOT IN (900, 2, 3)")
    assert rows(bm25.bm25_topk(q, index, 5)) == rows(bm25.bm25_topk(q, bm25.build_index(left), 5))
    assert "c" not in {r.kb_id for r in index.corpus.collect()} and admin.index_version(spark, path)[0] == 3


def test_a_chunk_may_span_batches(spark, monkeypatch):
    chunks = corpus(spark, 40, kbs=("a", None))
    post = bm25.postings(chunks).select("kb_id", "chunk_key", "dl", F.xxhash64("term").alias("term"), "tf").coalesce(1).sortWithinPartitions("kb_id", "chunk_key").toArrow()
    whole = list(impact._records(iter(post.combine_chunks().to_batches())))
    split = list(impact._records(iter(post.combine_chunks().to_batches(max_chunksize=7))))
    keys = lambda found: [k for b in found for r in b.column("keys").to_pylist() for k in r]
    assert keys(whole) == keys(split) == list(dict.fromkeys(post.column("chunk_key").to_pylist()))
    assert sum(len(r) for b in split for r in b.column("tf").to_pylist()) == post.num_rows and isinstance(whole[0], pa.RecordBatch)


def test_records_are_cut_in_few_passes(monkeypatch):
    """Postings that arrive in many small batches are encoded a few times, not once a batch, and the records hold all of them."""
    calls, bounds = [], impact._bounds
    monkeypatch.setattr(impact, "_bounds", lambda *c: calls.append(len(c[0])) or bounds(*c))
    n = 5000
    kb, key = ["a"] * n + [None] * 40, [f"{i:06}" for i in range(n)] + [f"{i:03}" for i in range(40)]
    table = pa.table({"kb_id": pa.array(kb).take(np.repeat(np.arange(n + 40), 3)), "chunk_key": pa.array(key).take(np.repeat(np.arange(n + 40), 3)), "dl": pa.array([3] * 3 * (n + 40), pa.int32()),
                      "term": np.tile(np.arange(3), n + 40), "tf": pa.array([1, 2, 1] * (n + 40), pa.int32())})
    records = pa.Table.from_batches(impact._records(iter(table.to_batches(max_chunksize=10)))).to_pylist()
    assert [(r["kb_id"], len(r["keys"]), len(r["tf"])) for r in records] == [("a", 4096, 12288), ("a", n - 4096, 3 * (n - 4096)), (None, 40, 120)]
    assert [k for r in records for k in r["keys"]] == key and records[0]["terms"] == [0, 1, 2] and records[0]["ends"][-1] == len(records[0]["block"])
    assert sum(calls) < 20 * table.num_rows


def test_postings_are_not_shuffled_and_repeated_keys_add_up(spark):
    rows = [("a", "1", "x y x"), ("a", "2", "y"), ("b", "2", "y y"), (None, "3", "z"), ("a", None, "z z"), ("b", "4", "of the")]
    single = spark.createDataFrame(rows, "kb_id string, chunk_key string, content string")
    assert "Exchange" not in bm25.postings(single)._jdf.queryExecution().executedPlan().toString()
    again = spark.createDataFrame([*rows, ("a", "1", "x y x"), ("a", None, "z w"), ("a", None, "z")], single.schema)
    for df, twice in ((single, False), (again, True)):
        for ranged in (False, True):
            got = {(r.kb_id, r.chunk_key, r.dl, r.term): r.tf for r in bm25.postings(df, ranged=ranged).collect()}
            want = {("a", "1", 3, "x"): 4 if twice else 2, ("a", "1", 3, "y"): 2 if twice else 1, ("a", "2", 1, "y"): 1, ("b", "2", 2, "y"): 2, (None, "3", 1, "z"): 1}
            assert got == want | ({("a", None, 2, "z"): 3, ("a", None, 2, "w"): 1, ("a", None, 1, "z"): 1} if twice else {("a", None, 2, "z"): 2})


def test_long_and_empty_texts_are_counted_piece_by_piece(spark, monkeypatch):
    chunks = corpus(spark, 200)
    plain = sorted(map(tuple, bm25.postings(chunks).collect()))
    brute = {(r.kb_id, r.chunk_key, max(1, len(r.content.split())), w): r.content.split().count(w) for r in chunks.collect() for w in set(r.content.split())}
    assert {x[:4]: x[4] for x in plain} == brute
    tokens = bm25.tokenized(chunks.coalesce(1)).toArrow().combine_chunks().to_batches()
    monkeypatch.setattr(bm25, "TOKENS", 50)
    parts = list(bm25._terms(iter(tokens)))
    assert len(parts) > 50 and sorted(tuple(r.values()) for p in parts for r in p.to_pylist()) == plain


def test_stored_postings_stay_in_the_order_of_their_chunks(spark, tmp_path):
    index = admin.write_bm25_index(corpus(spark), str(tmp_path / "i"))
    files = list((tmp_path / "i" / "postings").rglob("*.parquet"))
    runs = []
    for f in files:
        keys = pq.ParquetFile(f).read(["chunk_key"]).column("chunk_key").to_pylist()
        runs.append([k for i, k in enumerate(keys) if not i or keys[i - 1] != k])
    assert all(r == sorted(set(r)) for r in runs) and max(map(len, runs)) > 10
    key = ["kb_id", "chunk_key", "term", "tf", "dl"]
    assert sorted(map(tuple, index.postings.select(*key).collect())) == sorted(map(tuple, bm25.postings(corpus(spark)).select(*key).collect()))


def test_search_keeps_its_candidates(spark, tmp_path):
    from answerloom.plans import search as S

    chunks = corpus(spark).selectExpr("*", "0 AS chunk_index", "CAST(NULL AS string) AS parent_content", "kb_id AS section_path", "CAST(NULL AS int) AS page_no")
    found = S.hybrid_search(asked(spark), S.Corpus(chunks, admin.write_bm25_index(chunks, str(tmp_path / "i"))), S.SearchConfig(mode="bm25", all_kbs=True))
    assert "MapInArrow" not in found.hits._jdf.queryExecution().executedPlan().toString()  # the search ran once, before its two readers


def test_one_sided_modes_search_their_side_only(spark, tmp_path, monkeypatch):
    from answerloom.plans import evaluation, search as S

    seen, recall = [], evaluation.recall
    monkeypatch.setattr(evaluation, "recall", lambda q, c, cfg: (seen.append(cfg.mode), recall(q, c, cfg))[1])
    chunks = corpus(spark).selectExpr("*", "0 AS chunk_index", "CAST(NULL AS string) AS parent_content", "kb_id AS section_path", "CAST(NULL AS int) AS page_no")
    vectors = chunks.select("kb_id", "chunk_key", V.hash_embed("content", 16).alias("embedding"))
    whole = S.Corpus(chunks, admin.write_bm25_index(chunks, str(tmp_path / "i")), vectors)
    q = asked(spark).withColumn("embedding", V.hash_embed("question", 16))
    both = evaluation.search_modes(q, whole, ["bm25", "vector"], S.SearchConfig(all_kbs=True))
    columns = sorted(both.columns)
    for mode in ("bm25", "vector"):
        one = evaluation.search_modes(q, whole, [mode], S.SearchConfig(all_kbs=True))
        assert sorted(map(str, one.select(*columns).collect())) == sorted(map(str, both.filter(f"mode = '{mode}'").select(*columns).collect())) != []
    assert seen == ["hybrid", "bm25", "vector"]


def test_embedding_goes_by_few_texts(spark, monkeypatch):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else "" if i % 7 == 0 else f"Text {i} été") for i in range(23)], "i long, t string").coalesce(1)
    whole = sorted(map(tuple, df.select("i", V.hash_embed("t", 8)).collect()))
    monkeypatch.setattr(V, "TEXTS", 4)
    assert sorted(map(tuple, df.select("i", V.hash_embed("t", 8)).collect())) == whole
    assert whole[0][1] == whole[7][1] == [0.0] * 8 and abs(sum(x * x for x in whole[1][1]) - 1) < 1e-12


def test_scores_are_held_in_bounded_pieces(monkeypatch):
    rng = np.random.default_rng(4)
    q, v = rng.standard_normal((40, 6)), rng.standard_normal((30, 6))
    run = lambda: V._scan((np.arange(40), q, None), np.arange(30), np.zeros(30), v, 5, False)
    whole, sizes, best = run(), [], V._best
    monkeypatch.setattr(V, "_best", lambda s, *a: (sizes.append(s.size), best(s, *a))[1])
    monkeypatch.setattr(V, "SCORES", 100)
    assert run().equals(whole) and max(sizes) <= 100


def test_records_hold_few_postings_and_chunks_stay_whole(monkeypatch):
    """Long chunks make records of fewer of them; a chunk beyond the bound has one of its own."""
    monkeypatch.setattr(impact, "POSTINGS", 10)
    sizes = [3, 4, 3, 25, 1, 9, 2, 8]
    table = pa.table({"kb_id": ["a"] * sum(sizes), "chunk_key": [f"{i}" for i, n in enumerate(sizes) for _ in range(n)], "dl": pa.array([1] * sum(sizes), pa.int32()),
                      "term": pa.array([t for n in sizes for t in range(n)], pa.int64()), "tf": pa.array([1] * sum(sizes), pa.int32())})
    for step in (4, 100):
        found = pa.Table.from_batches(impact._records(iter(table.to_batches(max_chunksize=step)))).to_pylist()
        assert [(r["keys"], len(r["tf"])) for r in found] == [(["0", "1", "2"], 10), (["3"], 25), (["4", "5"], 10), (["6", "7"], 10)]


def test_a_record_meets_all_small_weights_at_once(spark, tmp_path, monkeypatch):
    """Records are not repeated for groups of queries; weights that are not known to be small still are parted, with the same hits."""
    monkeypatch.setattr(impact, "WEIGHTS", 16)
    chunks, q = corpus(spark), asked(spark)
    index = admin.write_bm25_index(chunks, str(tmp_path / "i"))
    seen, join = [], impact.bounded_join
    monkeypatch.setattr(impact, "bounded_join", lambda *a, **k: seen.append(join(*a, **k)) or seen[-1])
    hits = rows(bm25.bm25_topk(q, index, 4))
    assert seen[0].count() == index.blocks.count()
    weights, small, terms = bm25._weighed(q, index, 1.5, "question")
    parted = rows(impact.blocked_topk(weights, terms, index.blocks, 4, 1.5, 0.75, False, None))
    assert small and parted == hits and seen[1].count() > 2 * index.blocks.count()


def test_records_of_chunks_are_those_of_their_postings(spark):
    """Counted and cut in one worker, repeated and missing keys included."""
    rows_ = [("a", f"{i % 50:03}" if i < 60 else f"{i:03}", " ".join(f"w{j % 7}" for j in range(i))) for i in range(120)] + [(None, "3", "z z y"), ("a", None, "z"), ("b", "4", "of the"), ("b", "5", None)]
    chunks = spark.createDataFrame(rows_, "kb_id string, chunk_key string, content string")

    def flat(df):
        return sorted((r.kb_id or "", r["keys"][p] or "", r.dl[p], t, f) for r in df.collect() for t, p, f in zip(np.repeat(r.terms, np.diff([0, *(r.block_ends[e - 1] for e in r.ends)])), r.place, r.tf, strict=True))

    assert flat(bm25.postings_and_records(chunks)[1]) == flat(impact.blocked(bm25.postings(chunks)))
    plan = bm25.postings_and_records(chunks.filter("kb_id = 'b'"))[1]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_compaction_folds_records_without_their_postings(spark, tmp_path, monkeypatch):
    """Every chunk of the segments is in one record of its collection, with the terms, lengths and counts of its postings."""
    path, q = str(tmp_path / "i"), asked(spark)
    chunks = corpus(spark)
    for part in range(3):
        admin.append_segment(chunks.filter(F.col("doc_id") % 3 == part), path)
    assert admin.read_bm25_index(spark, path).blocks.count() > chunks.select("kb_id").distinct().count()
    monkeypatch.setattr(admin, "blocked", lambda post: pytest.fail("postings dealt again"))
    index = admin.compact_index(spark, path)

    def flat(df):
        return sorted((r.kb_id or "", r["keys"][p], r.dl[p], t, f) for r in df.collect() for t, p, f in zip(np.repeat(r.terms, np.diff([0, *(r.block_ends[e - 1] for e in r.ends)])), r.place, r.tf, strict=True))

    assert flat(index.blocks) == flat(impact.blocked(bm25.postings(chunks)))
    assert index.blocks.count() <= impact.blocked(bm25.postings(chunks)).count() + 2
    assert rows(bm25.bm25_topk(q, index, 5)) == rows(bm25.bm25_topk(q, bm25.build_index(chunks), 5))
