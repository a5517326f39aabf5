"""Language of texts: bit-sliced Bloom filters over character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from answerloom.llm.common import constants, fold, mix, over_batches, text_blocks

#: Labelled texts of a language that are learned from: the first by a hash of the id. Up to 1000 Spark cuts each task to them
#: before the shuffle.
TEXTS_PER_LANGUAGE = 1000
#: Languages in one word of a mask; a mask has as many words as the languages need.
WORD = 64
#: Ranges of hashes that a language is dealt to before its first texts are found.
DEALT = 32
#: Bytes of an n-gram (of the lower-cased text, with a space for each run of characters that are no letters).
SIZES = (4, 6)
#: An n-gram belongs to a language when it makes up at least this share of the language's n-grams,
#: and this share of the mean over all languages.
SHARE, OF_MEAN = 2e-5, 0.25
#: Rows of the filter: a power of two; n-grams set HASHES of them.
ROW_BITS, HASHES = 19, 3


@dataclass(frozen=True)
class Filters:
    """``rows[l // WORD, i]`` has bit l % WORD set when an n-gram of language l hashes to row i; ``filled[l]`` is the chance
    of any n-gram to be accepted."""

    languages: list[str]
    rows: np.ndarray
    filled: np.ndarray


class _Spaced(dict):
    """For str.translate: characters that are no letters become spaces; learned once each."""

    def __missing__(self, code: int) -> str | int:
        self[code] = code if chr(code).isalpha() else " "
        return self[code]


def _normal(texts: list[str | None], spaced: dict) -> list[str]:
    out = []
    for t in texts:
        words = (t or "").lower().translate(spaced).split()
        out.append(f" {' '.join(words)} " if words else "")
    return out


def _ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every n-gram; none crosses texts."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(data), 8), (1, 1)).copy().view(np.uint64).ravel() if len(data) else np.zeros(0, np.uint64)
    at = np.arange(len(data))
    row = np.searchsorted(offsets, at, "right") - 1
    left = offsets[row + 1] - at if len(data) else at
    hashes, rows = [], []
    for size in SIZES:
        full = left >= size
        hashes.append(mix((eight[full] & np.uint64((1 << (8 * size)) - 1)) + np.uint64(size)))
        rows.append(row[full])
    return np.concatenate(hashes), np.concatenate(rows)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    spaced = _Spaced()
    texts = batch.column("text").to_pylist()
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size < 1 << 20):
            size += len(texts[last] or "")
            last += 1
        block = pa.array(_normal(texts[first:last], spaced), pa.large_string())
        for lo, hi, data, offsets in text_blocks(block, 1 << 40):
            yield first + lo, first + hi, data, offsets
        first = last


def _counts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    code = np.array(batch.column("code").to_pylist(), dtype=np.int64)
    for first, _, data, offsets in _blocks(batch):
        hashes, rows = _ngrams(data, offsets)
        for c in np.unique(code[first:][: len(offsets) - 1]):
            values, n = np.unique(hashes[code[first + rows] == c], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), c)), pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["code", "gram", "n"])


def train(docs: DataFrame, texts_per_language: int = TEXTS_PER_LANGUAGE) -> Filters:
    """Filters learned from the text and the non-null lang of ``docs`` outside fold 2.

    Of each language, however many there are, the ``texts_per_language`` different texts first by a hash of the id are used; rows that
    repeat an id and a text teach once, one id with several texts or languages teaches each of them. N-grams are counted on
    the cluster and only those that are frequent in a language come to the driver: at most 1 / SHARE a language. Broadcasts hold
    at most ``texts_per_language`` keys a language, and the filter takes 4 MB for every WORD languages.
    Null ids, texts and languages teach nothing.
    """
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 2))
    first = _first(rows, texts_per_language)
    languages = sorted(r.lang for r in first.select("lang").distinct().collect())
    words = max(1, -(-len(languages) // WORD))
    if not languages:
        return Filters([], np.zeros((words, 1 << ROW_BITS), dtype=np.uint64), np.zeros(0))
    key = ["doc_id", "lang", "print"]
    sample = rows.withColumn("print", F.xxhash64("text")).join(F.broadcast(first), key).dropDuplicates(key)
    sample = sample.select("text", (F.array_position(F.lit(languages), F.col("lang")) - 1).alias("code")).repartition(16, "text")
    counts = sample.mapInArrow(over_batches(_counts), "code long, gram long, n long").groupBy("code", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("code").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), "code").withColumn("share", F.col("n") / F.col("total")).where(F.col("share") >= SHARE)
    mean = W.partitionBy("gram")
    shares = shares.withColumn("mean", F.sum("share").over(mean) / len(languages)).where(F.col("share") >= OF_MEAN * F.col("mean"))
    kept = shares.select("code", "gram").toPandas()
    table = np.zeros((words, 1 << ROW_BITS), dtype=np.uint64)
    code = kept["code"].to_numpy().astype(np.int64)
    bits = np.left_shift(np.uint64(1), (code % WORD).astype(np.uint64))
    for place in _places(kept["gram"].to_numpy().astype(np.int64).view(np.uint64)):
        np.bitwise_or.at(table, (code // WORD, place), bits)
    filled = np.array([float(_has(table, c).mean()) for c in range(len(languages))])
    return Filters(languages, table, filled**HASHES)


def _first(rows: DataFrame, n: int) -> DataFrame:
    """(doc_id, lang, print) of the first ``n`` different texts of every language by a hash of the id: first of each range of
    hashes, so that no task gets a large language whole."""
    keys = rows.select("doc_id", "lang", F.xxhash64("text").alias("print"), F.xxhash64("doc_id").alias("h")).distinct()
    order = ["h", "doc_id", "print"]
    for group in ([F.col("lang"), F.pmod("h", F.lit(DEALT))], [F.col("lang")]):
        keys = keys.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("place") <= n).drop("place")
    return keys.drop("h")


def _has(masks: np.ndarray, code: int) -> np.ndarray:
    """Whether language ``code`` is in each of the masks (words, n)."""
    return (masks[code // WORD] >> np.uint64(code % WORD)) & np.uint64(1) == 1


def _places(grams: np.ndarray) -> list[np.ndarray]:
    return [((grams * c) >> np.uint64(64 - ROW_BITS)).astype(np.int64) for c in constants(HASHES, 505)]


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs``; its lang is not read.

    An n-gram's rows of the filter, and-ed, are the mask of languages that have it. A language's count, less what
    its filter would accept of any n-grams by chance, is its evidence; the most evidence wins, ties go to the
    first by name, and the score is 1 / sum(exp(evidence - most evidence)) over all languages: near 1 where the winner leads by a few
    n-grams, 1 / languages where all are alike. A null text or one without letters is ``und`` with score 0, and so is every text when
    nothing was learned. Texts that share no n-gram with any language get the first language. Repeated rows give
    repeated results; a row without an id gets a null ``held_out``.
    """
    k = len(filters.languages)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("doc_id")
        names = np.array([*filters.languages, "und"], dtype=object)
        for first, last, data, offsets in _blocks(batch):
            n = last - first
            hashes, rows = _ngrams(data, offsets)
            mask = np.full((len(filters.rows), len(hashes)), np.uint64(2**64 - 1))
            for place in _places(hashes):
                mask &= filters.rows[:, place]
            total = np.bincount(rows, minlength=n).astype(float)
            evidence = np.zeros((n, k))
            for c in range(k):
                hits = np.bincount(rows[_has(mask, c)], minlength=n)
                chance = filters.filled[c]
                evidence[:, c] = np.maximum(hits - chance * total, 0) / max(1e-9, 1 - chance)
            empty = np.diff(offsets) == 0
            if k:
                best = evidence.argmax(axis=1)
                top = evidence[np.arange(n), best]
                odds = np.exp(np.clip(evidence - top[:, None], -50, 0))
                score = np.where(empty, 0.0, 1 / odds.sum(axis=1))
                best = np.where(empty, k, best)
            else:
                best, score = np.zeros(n, dtype=int), np.zeros(n)
            yield pa.RecordBatch.from_arrays([ids.slice(first, n), pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    out = docs.select("doc_id", "text").mapInArrow(over_batches(work), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")


def languages(docs: DataFrame) -> DataFrame:
    """Trains on ``docs`` and names the language of each of its rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    return identify(docs, train(docs))
