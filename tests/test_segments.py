"""The segmented keyword index and the stream that appends to it."""

import pytest
from pyspark.sql import functions as F

from answerloom.operators import admin, bm25
from answerloom.operators.chunking import chunk
from answerloom.plans.search import SearchConfig, hybrid_search
from answerloom.streaming import jobs

CHUNKS = "kb_id string, chunk_key string, content string"
DOCS = "kb_id string, doc_id long, text string, at timestamp_ntz"
WORDS = "apple pear plum kiwi grape melon lemon peach cherry mango".split()


def chunks(spark, ids, kbs=("a", "b")):
    rows = [(kbs[i % len(kbs)], f"{i}:0", " ".join(WORDS[(i * j + j) % 10] for j in range(1, 3 + i % 7))) for i in ids]
    return spark.createDataFrame(rows, CHUNKS)


def asked(spark):
    return spark.createDataFrame([("q1", "apple melon"), ("q2", "pear pear cherry"), ("q3", "nothing")], "query_id string, question string")


def hits(spark, index, k=4):
    return sorted((r.query_id, r.bm25_rank, r.kb_id, r.chunk_key, round(r.bm25_score, 8)) for r in bm25.bm25_topk(asked(spark), index, k).collect())


def same_tables(got, want):
    for name in ("postings", "corpus", "terms"):
        a, b = getattr(got, name), getattr(want, name)
        assert sorted(map(str, a.select(sorted(b.columns)).collect())) == sorted(map(str, b.select(sorted(b.columns)).collect())), name


def test_segments_add_up_and_fold(spark, tmp_path):
    path, whole = str(tmp_path / "i"), bm25.build_index(chunks(spark, range(60)))
    admin.append_segment(chunks(spark, range(0, 20)), path)
    admin.append_segment(chunks(spark, range(20, 45)), path)
    index = admin.append_segment(chunks(spark, range(45, 60)), path)
    assert {r.segments for r in admin.segment_counts(spark, path).collect()} == {3} and index.term_parts is not None
    same_tables(index, whole)
    assert hits(spark, index) == hits(spark, whole)
    version = admin.index_version(spark, path)
    admin.compact_index(spark, path, segments=3)
    assert admin.index_version(spark, path) == version  # nothing had more than three
    folded = admin.compact_index(spark, path)
    assert {r.segments for r in admin.segment_counts(spark, path).collect()} == {1} and folded.term_parts is None
    same_tables(folded, whole)
    assert hits(spark, folded) == hits(spark, whole) == hits(spark, index)  # the older version is still readable


def test_only_the_collections_with_segments_are_folded(spark, tmp_path):
    path = str(tmp_path / "i")
    admin.append_segment(chunks(spark, range(10), ("a",)), path)
    admin.append_segment(chunks(spark, range(10, 20), ("b",)), path)
    admin.append_segment(chunks(spark, range(20, 30), ("b",)), path)
    before = {(r.kb_id, r.generation) for r in admin._segments(spark, path).collect()}
    admin.compact_index(spark, path)
    after = {(r.kb_id, r.generation) for r in admin._segments(spark, path).collect()}
    assert {r for r in after if r[0] == "a"} == {r for r in before if r[0] == "a"} and len(after) == 2


def test_update_folds_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "i")
    admin.append_segment(chunks(spark, range(20)), path)
    admin.append_segment(chunks(spark, range(20, 40)), path)
    new = spark.createDataFrame([("a", "2:0", "quince"), ("a", "30:0", "quince fig")], CHUNKS)
    index = admin.update_bm25_index(path, new, spark.createDataFrame([("a", "4:0")], "kb_id string, chunk_key string"))
    kept = chunks(spark, range(40)).where("NOT (kb_id = 'a' AND chunk_key IN ('2:0', '30:0', '4:0'))").unionByName(new)
    same_tables(index, bm25.build_index(kept))
    assert {(r.kb_id, r.segments) for r in admin.segment_counts(spark, path).collect()} == {("a", 1), ("b", 2)}


def texts(i, version=0):
    return " ".join(WORDS[(i * 3 + j + version) % 10] for j in range(5 + i % 4))


def run(spark, tmp_path, batches, **options):
    """Drain one file after the other into the same ingest folder, each as a batch of one stream."""
    src, root = tmp_path / "src", str(tmp_path / "root")
    for rows in batches:
        spark.createDataFrame(rows, DOCS).withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(DOCS.replace("timestamp_ntz", "timestamp")).parquet(str(src))
        jobs.stream_ingest(stream, "at", root, str(tmp_path / "state"), **options)
    return root


def day(n):
    import datetime

    return datetime.datetime(2024, 1, n)


def twin(spark, rows):
    return bm25.build_index(chunk(spark.createDataFrame(rows, "kb_id string, doc_id long, text string")))


def test_stream_equals_batch_before_and_after_folding(spark, tmp_path):
    docs = [("a" if i % 3 else "b", i, f"{texts(i)} {i}", day(1)) for i in range(18)]
    copy = ("a", 99, docs[1][2], day(2))  # the text of document 1, in the batch after it
    root = run(spark, tmp_path, [docs[:6], [*docs[6:12], copy], docs[12:]])
    corpus, want = jobs.ingested_corpus(spark, root), twin(spark, [d[:3] for d in docs])
    assert max(r.segments for r in admin.segment_counts(spark, f"{root}/index").collect()) == 3
    same_tables(corpus.bm25, want)
    assert hits(spark, corpus.bm25) == hits(spark, want)
    same_tables(admin.compact_index(spark, f"{root}/index"), want)
    assert admin.last_batch(spark, f"{root}/index") == 2


def test_changed_documents_replace_their_chunks(spark, tmp_path):
    docs = [("a", i, f"{texts(i)} {i}", day(1)) for i in range(4)]
    changed = [("a", 2, "quince fig", day(2)), ("a", 2, "older quince", day(1)), ("a", 7, "date", day(2)), ("a", 8, "date", day(2)), ("a", None, "lost", day(2))]
    root = run(spark, tmp_path, [docs, changed], embed=lambda c: F.array(F.length(c).cast("double"), F.lit(1.0)))
    want = [d[:3] for d in docs if d[1] != 2] + [("a", 2, "quince fig"), ("a", 7, "date")]
    corpus = jobs.ingested_corpus(spark, root)
    same_tables(corpus.bm25, twin(spark, want))
    assert sorted((r.doc_id, r.text) for r in jobs.ingested(spark, root, "documents").collect()) == sorted(w[1:] for w in want)
    assert sorted(r.chunk_key for r in corpus.vectors.collect()) == sorted(r.chunk_key for r in corpus.chunks.collect())
    found = hybrid_search(spark.createDataFrame([("q", "quince")], "query_id string, question string"), corpus, SearchConfig(mode="bm25", all_kbs=True)).hits
    assert [h.doc_id for h in found.collect()] == [2]


def test_a_repeated_batch_changes_nothing(spark, tmp_path, monkeypatch):
    docs = [("a", i, f"{texts(i)} {i}", day(1)) for i in range(6)]
    real = jobs.compact_index
    monkeypatch.setattr(jobs, "compact_index", lambda *_: (_ for _ in ()).throw(RuntimeError("lost after the commit")))
    with pytest.raises(Exception, match="lost after the commit"):
        run(spark, tmp_path, [docs])
    monkeypatch.setattr(jobs, "compact_index", real)
    stream = spark.readStream.schema(DOCS.replace("timestamp_ntz", "timestamp")).parquet(str(tmp_path / "src"))
    root = str(tmp_path / "root")
    jobs.stream_ingest(stream, "at", root, str(tmp_path / "state"))
    assert admin.index_version(spark, f"{root}/index")[0] == 1
    same_tables(jobs.ingested_corpus(spark, root).bm25, twin(spark, [d[:3] for d in docs]))
