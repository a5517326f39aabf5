"""Keyword index (postings and per-collection statistics) and BM25 top-k for a table of queries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from answerloom.functions.text import tokenize
from answerloom.operators.impact import RECORDS, _records, blocked_in_place, blocked_topk
from answerloom.operators.skew import bounded_join, explode_computed, measure, top_per_group, within_bounds

K1 = 1.5
B = 0.75
#: Tokens that a task counts at once, one chunk's tokens more.
TOKENS = 1 << 18


@dataclass(frozen=True)
class Bm25Index:
    """postings(kb_id, term, chunk_key, tf, dl), corpus(kb_id, n, avgdl), terms(kb_id, term, df)."""

    postings: DataFrame
    corpus: DataFrame
    terms: DataFrame
    kbs: DataFrame | None = None  # distinct kb_id, when that is cheaper to read than the statistics
    blocks: DataFrame | None = None  # the postings again, as records of whole chunks; a stored index has them
    term_parts: DataFrame | None = None  # terms as the segments of a collection hold them, df to be added up


def tokenized(chunks: DataFrame, text: str = "content") -> DataFrame:
    return chunks.select("kb_id", "chunk_key", tokenize(text).alias("tokens"))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kb_id, chunk_key, dl, term, tf) of rows (kb_id, chunk_key, tokens), each row for itself."""
    for batch in batches:
        n = batch.column("tokens").value_lengths().fill_null(0).to_numpy()
        piece = (np.cumsum(n, dtype=np.int64) - n) // TOKENS  # rows that start in the same stretch of tokens are counted at once
        bounds = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(n)]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            part, own = batch.slice(lo, hi - lo), n[lo:hi]
            coded = part.column("tokens").flatten().dictionary_encode()
            if not len(coded):
                continue
            pairs, tf = np.unique(np.repeat(np.arange(hi - lo) << 32, own) | coded.indices.to_numpy(), return_counts=True)
            row = pairs >> 32
            names = [part.column(c).take(pa.array(row)) for c in ("kb_id", "chunk_key")]
            term = coded.dictionary.take(pa.array(pairs & 0xFFFFFFFF))
            yield pa.RecordBatch.from_arrays([*names, pa.array(own[row].astype(np.int32)), term, pa.array(tf.astype(np.int32))], names=["kb_id", "chunk_key", "dl", "term", "tf"])


def _by_key(chunks: DataFrame, text: str, ranged: bool) -> tuple[DataFrame, DataFrame | None]:
    """(kb_id, chunk_key, tokens) of the chunks whose key is theirs alone, and (kb_id, chunk_key, dl, term, tf) of the others, if any.

    The terms of a chunk are counted in its own row, so no posting is shuffled; with ``ranged`` its text was dealt by key ranges
    before, and the rows of a partition are in the order of their chunks. Rows that share a key are told by a first look at
    the keys, and only theirs are grouped.
    """
    rows = chunks.select("kb_id", "chunk_key", F.col(text).alias("content"), F.xxhash64("kb_id", "chunk_key").alias("_key"))
    again = rows.groupBy("_key").agg(F.count("*").alias("c")).filter("c > 1").select("_key")
    n, size = measure(again)
    small = within_bounds(n, size)
    once = bounded_join(rows, again, ["_key"], "left_anti", spread=["_key"], small_is_small=small) if n else rows
    own = tokenized(once.repartitionByRange("kb_id", "chunk_key").sortWithinPartitions("kb_id", "chunk_key") if ranged else once)
    if not n:
        return own, None
    more = bounded_join(rows, again, ["_key"], "left_semi", spread=["_key"], small_is_small=small).repartition("kb_id", "chunk_key")
    tokens = tokenized(more).withColumn("dl", F.greatest(F.size("tokens"), F.lit(1)))
    exploded = explode_computed(tokens, "tokens", "term").select("kb_id", "chunk_key", "dl", "term")
    grouped = exploded.groupBy("kb_id", "chunk_key", "dl", "term").agg(F.count("*").cast("int").alias("tf"))
    return own, grouped.sortWithinPartitions("kb_id", "chunk_key") if ranged else grouped


def _counted(own: DataFrame, more: DataFrame | None) -> DataFrame:
    kinds = dict(own.dtypes)
    post = own.mapInArrow(_terms, f"kb_id {kinds['kb_id']}, chunk_key {kinds['chunk_key']}, dl int, term string, tf int")
    return post if more is None else post.unionByName(more)


def postings(chunks: DataFrame, text: str = "content", ranged: bool = False) -> DataFrame:
    """Term frequency per chunk, all terms of a chunk in one partition; ``ranged`` as for ``_by_key``."""
    return _counted(*_by_key(chunks, text, ranged))


def postings_and_records(chunks: DataFrame, text: str = "content") -> tuple[DataFrame, DataFrame]:
    """Ranged postings of ``chunks`` and their ``impact.blocked_in_place``. For the latter, tokens are hashed before they are counted, so
    one Python worker a task counts them and cuts the records, and no posting travels between the two."""
    own, more = _by_key(chunks, text, True)
    hashed = own.withColumn("tokens", F.transform("tokens", lambda t: F.xxhash64(t)))
    cut = hashed.mapInArrow(lambda batches: _records(_terms(batches)), RECORDS)
    return _counted(own, more), cut if more is None else cut.unionByName(blocked_in_place(more))


def doc_stats(chunks: DataFrame, text: str = "content") -> DataFrame:
    """Length per chunk; a chunk without tokens still counts, with length 1."""
    return tokenized(chunks, text).select("kb_id", "chunk_key", F.greatest(F.size("tokens"), F.lit(1)).alias("dl"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    return stats.groupBy("kb_id").agg(
        F.count("*").alias("n"), F.sum("dl").alias("total_dl"), F.avg("dl").alias("avgdl")
    )


def merged_corpus(parts: DataFrame) -> DataFrame:
    """``corpus_stats`` of whole collections from those of their segments."""
    total = parts.groupBy("kb_id").agg(F.sum("n").alias("n"), F.sum("total_dl").alias("total_dl"))
    return total.withColumn("avgdl", F.col("total_dl") / F.col("n"))


def merged_terms(parts: DataFrame) -> DataFrame:
    """``term_stats`` of whole collections from those of their segments, which share no chunk."""
    return parts.groupBy("kb_id", "term").agg(F.sum("df").alias("df"))


def term_stats(post: DataFrame) -> DataFrame:
    """Chunks per term."""
    return post.groupBy("kb_id", "term").agg(F.sum(F.when(F.col("tf") > 0, 1).otherwise(0)).alias("df"))


def build_index(chunks: DataFrame, text: str = "content") -> Bm25Index:
    """Index of every term of ``chunks``, in memory; stored indexes are written and kept up to date by the administration."""
    post = postings(chunks, text)
    return Bm25Index(post, corpus_stats(doc_stats(chunks, text)), term_stats(post), chunks.select("kb_id").distinct())


def idf(n: str = "n", df: str = "df") -> F.Column:
    return F.log(1 + (F.col(n) - F.col(df) + 0.5) / (F.col(df) + 0.5))


def query_tokens(queries: DataFrame, text: str = "question") -> DataFrame:
    """(query_id, term, mult), plus ``kb_ids`` when the queries name the collections to search."""
    keep = [c for c in ("kb_ids",) if c in queries.columns]
    tokens = queries.select("query_id", *keep, tokenize(text).alias("tokens"))
    exploded = explode_computed(tokens, "tokens", "term")
    return exploded.groupBy("query_id", *keep, "term").agg(F.count("*").alias("mult"))


def query_weights(wanted: DataFrame, index: Bm25Index, k1: float = K1, small: bool | None = None) -> DataFrame:
    """One row per (query, collection, term): multiplicity x idf x (k1 + 1), with the collection's mean length.

    Only statistics of terms that occur in a query are read.
    """
    parts = index.terms if index.term_parts is None else index.term_parts
    weights = bounded_join(parts, wanted, ["term"], spread=["kb_id"], small_is_small=small)
    if index.term_parts is not None:  # added up after the join, so that only the terms asked for are shuffled
        weights = weights.groupBy(*wanted.columns, "kb_id").agg(F.sum("df").alias("df"))
    if "kb_ids" in wanted.columns:
        everywhere = F.coalesce(F.size("kb_ids") <= 0, F.lit(True))  # a query that names no collection searches all
        weights = weights.filter(everywhere | F.array_contains("kb_ids", F.col("kb_id")))
    corpus = index.corpus.select("kb_id", "n", "avgdl")
    weights = bounded_join(weights, corpus, ["kb_id"], spread=["query_id", "term"], small_is_small=small)
    return weights.select(
        "query_id", "kb_id", "term", (F.col("mult") * idf() * (k1 + 1)).alias("weight"), "avgdl"
    )


def _weighed(queries: DataFrame, index: Bm25Index, k1: float, text: str) -> tuple[DataFrame, bool | None, int]:
    """(weights, whether all of them are known to be small, query terms)."""
    wanted = query_tokens(queries, text)
    small, rows = None, None
    if index.kbs is not None:
        rows, size = measure(wanted)
        kbs, kb_size = measure(index.kbs)
        small = within_bounds(rows * kbs, size * kbs + rows * kb_size) or None
    return query_weights(wanted, index, k1, small), small, rows if small else wanted.count()


def bm25_scores(
    queries: DataFrame, index: Bm25Index, k1: float = K1, b: float = B, text: str = "question"
) -> DataFrame:
    """Score of every (query, chunk) pair that shares a term; repeated query tokens add again.

    The weight rows are at most query terms x collections; when that product is below the broadcast bounds nothing
    else has to be measured.
    """
    weights, small, _ = _weighed(queries, index, k1, text)
    matches = bounded_join(index.postings, weights, ["kb_id", "term"], spread=["chunk_key"], small_is_small=small)
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    return (
        matches.groupBy("query_id", "kb_id", "chunk_key")
        .agg(F.sum(F.col("weight") * F.col("tf") / norm).alias("raw"))
        .filter(F.col("raw") > 0)
        .select("query_id", "kb_id", "chunk_key", F.round("raw", 9).alias("bm25_score"))
    )


def bm25_topk(
    queries: DataFrame,
    index: Bm25Index,
    k: int,
    k1: float = K1,
    b: float = B,
    text: str = "question",
    per_kb: bool = False,
) -> DataFrame:
    """Best ``k`` chunks by (score, key) per query, or per query and collection with ``per_kb``.

    Merging per-collection lists by the same order equals one ranking over all of them, so the merged form needs
    a single window.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if index.blocks is not None:
        weights, small, terms = _weighed(queries, index, k1, text)
        return blocked_topk(weights, terms, index.blocks, k, k1, b, per_kb, small)
    scores = bm25_scores(queries, index, k1, b, text)
    group = ["query_id", "kb_id"] if per_kb else ["query_id"]
    return top_per_group(scores, group, [F.desc("bm25_score"), F.asc("chunk_key")], k, "bm25_rank")


def index_stats(index: Bm25Index, k1: float = K1, b: float = B) -> DataFrame:
    terms = index.terms.groupBy("kb_id").agg(F.count("*").alias("terms"))
    return index.corpus.join(terms, "kb_id", "left").select(
        "kb_id",
        F.col("n").alias("docs"),
        F.coalesce("terms", F.lit(0)).alias("terms"),
        F.round("avgdl", 2).alias("avgdl"),
        F.lit(k1).alias("k1"),
        F.lit(b).alias("b"),
    )


def changed(postings_table: DataFrame, stats: DataFrame, upserts: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) after the upserted chunks replaced theirs and the deleted ones, (kb_id, chunk_key), went."""
    touched = upserts.select("kb_id", "chunk_key").unionByName(deletes.select("kb_id", "chunk_key")).distinct()
    kept = bounded_join(postings_table, touched, ["kb_id", "chunk_key"], "left_anti")
    kept_stats = bounded_join(stats, touched, ["kb_id", "chunk_key"], "left_anti")
    return kept.unionByName(postings(upserts)), kept_stats.unionByName(doc_stats(upserts))


def apply_changes(postings_table: DataFrame, stats: DataFrame, upserts: DataFrame, deletes: DataFrame) -> Bm25Index:
    """The index after ``changed``, with its statistics derived again; ``admin.update_bm25_index`` stores it."""
    post, all_stats = changed(postings_table, stats, upserts, deletes)
    return Bm25Index(post, corpus_stats(all_stats), term_stats(post))
