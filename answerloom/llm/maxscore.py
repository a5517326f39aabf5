"""Ranked lexical search over an index of compressed posting blocks: Block-Max MaxScore in each shard, heaps merged."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from answerloom.llm.blocks import against
from answerloom.llm.common import Words, group_bounds, over_batches, saved, text_blocks
from answerloom.operators.skew import top_per_group

#: Bytes that end a term: all of ASCII but digits and letters.
BETWEEN = np.ones(256, dtype=bool)
BETWEEN[0x30:0x3A] = BETWEEN[0x41:0x5B] = BETWEEN[0x61:0x7B] = BETWEEN[0x80:] = False
#: Postings of a block, and of a shard before it is written.
BLOCK, SHARD = 64, 1 << 21
#: Bytes of text whose terms are found together.
PIECE = 1 << 21
#: Queries of a block.
QUERIES = 256
#: Blocks of queries for which a task holds its best documents at one time.
HELD = 16
#: The score's constants: length share in percent, saturation times ten, scale.
LENGTH, SATURATION, SCALE = 75, 8, 1_000_000_000

_INDEX = (
    "row_block long, n_docs long, n_terms long, ids array<long>, no_id array<boolean>, sizes array<int>, terms array<long>, dfs array<int>, "
    "most_tf array<int>, least_size array<int>, last_doc array<int>, doc_width array<byte>, tf_width array<byte>, doc_bytes binary, tf_bytes binary"
)


# --- index ------------------------------------------------------------------------------------------------------
def _packed(values: np.ndarray, width: np.ndarray) -> bytes:
    """Little-endian bytes of ``values``, each with its own width."""
    at = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), dtype=np.uint8)
    for k in range(4):
        longer = width > k
        out[at[longer] + k] = (values[longer] >> (8 * k)) & 255
    return out.tobytes()


def _unpacked(data: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Values of ``width`` bytes each at the byte positions ``at``."""
    out = np.zeros(len(at), dtype=np.int64)
    for k in range(4):
        longer = width > k
        if longer.any():
            out[longer] |= data[at[longer] + k].astype(np.int64) << (8 * k)
    return out


def _widths(most: np.ndarray) -> np.ndarray:
    return (1 + (most > 0xFF) + (most > 0xFFFF) + (most > 0xFFFFFF)).astype(np.int64)


def _block_starts(dfs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of ``dfs`` postings: the first block of each list (and the end), and each block's first posting and length."""
    n_blocks = -(-dfs // BLOCK)
    first_block = np.concatenate([[0], np.cumsum(n_blocks)])
    of = np.repeat(np.arange(len(dfs)), n_blocks)
    inside = np.arange(first_block[-1]) - first_block[of]
    start = (np.cumsum(dfs) - dfs)[of] + inside * BLOCK
    return first_block, start, np.minimum(BLOCK, dfs[of] - inside * BLOCK)


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one range after another."""
    return np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())


class _Shard:
    """Postings of documents, gathered until they fill a shard."""

    def __init__(self):
        self.ids, self.sizes, self.term, self.doc, self.tf, self.n, self.held = [], [], [], [], [], 0, 0

    def add(self, ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> None:
        words = Words(data, offsets, also=BETWEEN)
        order = np.lexsort((words.hash, words.doc))
        term, doc = words.hash[order], words.doc[order]
        bounds = group_bounds(doc, term)
        self.ids.append(ids)
        self.sizes.append(words.count.astype(np.int64))
        self.term.append(term[bounds[:-1]])
        self.doc.append(doc[bounds[:-1]] + self.n)
        self.tf.append(np.diff(bounds))
        self.n += len(words.count)
        self.held += len(bounds) - 1

    def row(self, number: int) -> pa.RecordBatch:
        ids, sizes = pa.concat_arrays(self.ids), np.concatenate(self.sizes)
        none = ids.is_null().to_numpy(zero_copy_only=False)
        value = ids.fill_null(0).to_numpy()
        rank = np.lexsort((value, none))  # documents by id, those without one last
        place = np.empty(self.n, dtype=np.int64)
        place[rank] = np.arange(self.n)
        value, none, sizes = value[rank], none[rank], sizes[rank]
        term, doc, tf = (np.concatenate(x) for x in (self.term, self.doc, self.tf))
        doc = place[doc]
        order = np.lexsort((doc, term))
        term, doc, tf = term[order], doc[order], tf[order]
        bounds = group_bounds(term)
        dfs = np.diff(bounds)
        _, start, length = _block_starts(dfs)
        delta = doc.copy()
        delta[1:] -= doc[:-1]
        delta[start] = doc[start]
        most = lambda x: np.maximum.reduceat(x, start) if len(start) else x
        least = np.minimum.reduceat(sizes[doc], start) if len(start) else start
        doc_width, tf_width = _widths(most(delta)), _widths(most(tf))
        columns = {
            "row_block": number, "n_docs": int((sizes > 0).sum()), "n_terms": int(sizes.sum()), "ids": value, "no_id": none, "sizes": sizes,
            "terms": term[bounds[:-1]].view(np.int64), "dfs": dfs, "most_tf": most(tf), "least_size": least, "last_doc": doc[start + length - 1],
            "doc_width": doc_width, "tf_width": tf_width, "doc_bytes": _packed(delta, np.repeat(doc_width, length)), "tf_bytes": _packed(tf, np.repeat(tf_width, length)),
        }
        kinds = {"ids": pa.int64(), "no_id": pa.bool_(), "terms": pa.int64(), "doc_width": pa.int8(), "tf_width": pa.int8()}
        made = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kinds.get(c, pa.int32()))) if isinstance(x, np.ndarray) else pa.array([x], pa.binary() if isinstance(x, bytes) else pa.int64()) for c, x in columns.items()]
        return pa.RecordBatch.from_arrays(made, names=list(columns))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, number = _Shard(), None
    for batch in batches:
        for first, last, data, offsets in text_blocks(batch.column("text"), PIECE):
            number = batch.column("row")[first].as_py() if number is None else number
            shard.add(batch.column("doc_id").slice(first, last - first), data, offsets)
            if shard.held >= SHARD:
                yield shard.row(number)
                shard, number = _Shard(), None
    if shard.n:
        yield shard.row(number)


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of every term of ``docs`` (doc_id, text): one record per shard, which is a run of documents of one input
    task with at most about ``SHARD`` postings. It holds the documents' ids and lengths, and for each term blocks of ``BLOCK`` postings:
    document gaps and frequencies in as few bytes as the block needs, and beside them the largest frequency, the shortest
    document and the last document of the block."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    return saved(rows.mapInArrow(_shards, _INDEX), "lexical_index")


# --- search -----------------------------------------------------------------------------------------------------
@dataclass
class Work:
    """Blocks of the lists that queries asked for, and those of them that were decompressed."""

    asked: int = 0
    opened: int = 0


@dataclass
class Searcher:
    """One shard and the corpus figures: exact best documents of weighted terms."""

    row: dict
    n: int
    total: int
    work: Work = field(default_factory=Work)

    def __post_init__(self):
        r = self.row
        self.terms = r["terms"].view(np.uint64)
        self.sizes = r["sizes"].astype(np.int64)
        dfs = r["dfs"].astype(np.int64)
        self.first, _, self.length = _block_starts(dfs)
        self.of = np.repeat(np.arange(len(dfs)), np.diff(self.first))
        self.last_doc, self.doc_width, self.tf_width = (r[c].astype(np.int64) for c in ("last_doc", "doc_width", "tf_width"))
        self.doc_at, self.tf_at = (np.cumsum(w * self.length) - w * self.length for w in (self.doc_width, self.tf_width))
        self.docs, self.tfs = (np.frombuffer(r[c], dtype=np.uint8) for c in ("doc_bytes", "tf_bytes"))
        self.most = self.impact(r["most_tf"].astype(np.int64), r["least_size"].astype(np.int64))
        self.best = np.maximum.reduceat(self.most, self.first[:-1]) if len(dfs) else self.most

    def impact(self, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        m = 100 - LENGTH + (LENGTH * size * self.n) // self.total
        return (SCALE * tf) // (1000 * tf + SATURATION * m)

    def opened(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of whole blocks."""
        self.work.opened += len(blocks)
        length = self.length[blocks]
        inside = _spread(np.zeros(len(blocks), dtype=np.int64), length)
        of = np.repeat(np.arange(len(blocks)), length)
        read = lambda data, at, width: _unpacked(data, at[blocks][of] + inside * width[blocks][of], width[blocks][of])
        doc = np.cumsum(read(self.docs, self.doc_at, self.doc_width))
        ends = np.cumsum(length)
        before = np.concatenate([[0], doc[ends[:-1] - 1]]) if len(ends) else ends
        doc -= before[of]
        return doc, self.impact(read(self.tfs, self.tf_at, self.tf_width), self.sizes[doc])

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Places in the shard and scores of the first k documents with a score above 0 that reach ``floor``.

        Lists go by falling bound. While the bounds of those left sum to the k-th score or more, they are essential: a document may enter
        through any of them, and they are read whole. The rest is asked only about documents found already; the maximum of the
        block that would hold a document, with the bounds behind it, rejects it before the block is decompressed.
        """
        at = np.searchsorted(self.terms, terms)
        held = at < len(self.terms)
        held[held] = self.terms[at[held]] == terms[held]
        lists, weights = at[held], weights[held]
        bound = weights * self.best[lists]
        order = np.argsort(-bound, kind="stable")
        lists, weights, bound = lists[order], weights[order], bound[order]
        left = np.append(np.cumsum(bound[::-1])[::-1], 0)
        self.work.asked += int((self.first[lists + 1] - self.first[lists]).sum())
        score = np.zeros(len(self.sizes), dtype=np.int64)
        kth = lambda x: max(floor, int(np.partition(x, len(x) - k)[len(x) - k]) if len(x) >= k else 0)
        reached, i = floor, 0
        while i < len(lists) and left[i] >= max(reached, 1):
            doc, impact = self.opened(np.arange(self.first[lists[i]], self.first[lists[i] + 1]))
            score[doc] += weights[i] * impact
            i += 1
            reached = kth(score)
        found = np.flatnonzero(score > 0)
        for j in range(i, len(lists)):
            found = found[score[found] + left[j] >= reached]
            if not len(found):
                break
            first, end = self.first[lists[j]], self.first[lists[j] + 1]
            block = first + np.searchsorted(self.last_doc[first:end], found)
            inside = block < end
            most = np.where(inside, self.most[np.minimum(block, end - 1)], 0) * weights[j]
            may = score[found] + most + left[j + 1] >= reached
            found, block, inside = found[may], block[may], inside[may]
            if inside.any():
                doc, impact = self.opened(np.unique(block[inside]))
                place = np.minimum(np.searchsorted(doc, found), len(doc) - 1)
                hit = doc[place] == found
                score[found[hit]] += weights[j] * impact[place[hit]]
                reached = max(reached, kth(score[found]))
        found = found[(score[found] >= max(reached, 1))]
        best = np.lexsort((found, -score[found]))[:k]
        return found[best], score[found[best]]


def _plain(batch: pa.RecordBatch, i: int) -> dict:
    row = {}
    for c, x in zip(batch.schema.names, (col[i] for col in batch.columns), strict=True):
        kind = x.type
        row[c] = x.values if pa.types.is_list(kind) and pa.types.is_struct(kind.value_type) else x.values.to_numpy(zero_copy_only=False) if pa.types.is_list(kind) else x.as_py()
    return row


class _Heap:
    """The best documents of one query block's queries in the shards a task has seen."""

    def __init__(self, asked: pa.StructArray, k: int):
        query, term, weight = (asked.field(c).to_numpy(zero_copy_only=False) for c in ("query", "term", "weight"))
        self.bounds, self.k = group_bounds(query), k
        self.query, self.term, self.weight = query[self.bounds[:-1]], term.view(np.uint64), weight
        empty = np.zeros(0, dtype=np.int64)
        self.best = [(empty, empty, empty.astype(bool))] * len(self.query)

    def search(self, shard: Searcher) -> None:
        ids, none = shard.row["ids"], shard.row["no_id"]
        for q, (a, b) in enumerate(zip(self.bounds[:-1], self.bounds[1:], strict=True)):
            scores, held, nulls = self.best[q]
            floor = int(scores[-1]) if len(scores) == self.k else 0
            doc, score = shard.top(self.term[a:b], self.weight[a:b], self.k, floor)
            scores, held, nulls = np.append(scores, score), np.append(held, ids[doc]), np.append(nulls, none[doc])
            order = np.lexsort((held, nulls, -scores))[: self.k]
            self.best[q] = scores[order], held[order], nulls[order]

    def told(self) -> pa.RecordBatch:
        query = np.repeat(self.query, [len(x[0]) for x in self.best])
        score, ids, nulls = (np.concatenate([x[c] for x in self.best]) for c in range(3))
        return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(ids, pa.int64(), mask=nulls), pa.array(score, pa.int64())], names=["query", "doc_id", "score"])


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, _Heap] = {}
        shard = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = _plain(batch, i)
                if shard is None or shard.row["row_block"] != row["row_block"]:
                    shard = Searcher(row, row["n"], row["total"])
                if row["block"] not in heaps:
                    if len(heaps) == HELD:
                        yield from (heap.told() for heap in heaps.values())
                        heaps = {}
                    heaps[row["block"]] = _Heap(row["asked"], k)
                heaps[row["block"]].search(shard)
        yield from (heap.told() for heap in heaps.values())

    return run


def _query_terms(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    query = batch.column("query").to_numpy()
    for first, _, data, offsets in text_blocks(batch.column("text")):
        words = Words(data, offsets, also=BETWEEN)
        order = np.lexsort((words.hash, words.doc))
        doc, term = words.doc[order], words.hash[order]
        bounds = group_bounds(doc, term)
        columns = [query[first + doc[bounds[:-1]]], term[bounds[:-1]].view(np.int64), np.diff(bounds)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["query", "term", "times"])


def search(index: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score) of the first ``k`` documents of ``index`` for each row of ``items`` (item_id, text).

    Terms are runs of digits, letters and non-ASCII characters with A-Z lower-cased. N documents have a term, L terms are in all of
    them. A term of df documents weighs floor(1000 * ln((2N + 2) / (2 df + 1))); in a document of n terms it gives that times
    (10^9 tf) div (1000 tf + 8 m), where m = 25 + (75 n N) div L. An item's repeated terms count repeatedly. Documents with a score
    above 0 are ranked by score, then id.

    Items without text or terms, and those whose terms no document holds, have no rows. Documents without an id come after equal scores with one. Repeated
    documents, and repeated items, are rows of their own. An empty index or no items give an empty result.

    Items meet the shards in blocks; a task keeps k documents an item over its shards, and their k-th score is the floor of its
    next search. These heaps are merged by one ranking.
    """
    asked = saved(items.select(F.monotonically_increasing_id().alias("query"), F.col("item_id"), F.col("text")), "items")
    terms = saved(asked.select("query", "text").mapInArrow(over_batches(_query_terms, "text"), "query long, term long, times long"), "item_terms")
    lists = index.select(F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("dfs").alias("df"))).alias("l")).select("l.*")
    df = lists.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    size = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("total"))
    weight = F.floor(1000 * F.log((2 * F.col("n") + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = terms.join(df, "term").crossJoin(size).select("query", "term", (F.col("times") * weight).alias("weight"), "n", "total").where("weight > 0")
    blocks = max(1, -(-asked.count() // QUERIES))
    asked_for = weighed.groupBy(F.pmod("query", F.lit(blocks)).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("query", "term", "weight"))).alias("asked"), F.first("n").alias("n"), F.first("total").alias("total")
    )
    asked_for = saved(asked_for.withColumn("bytes", (24 * F.size("asked")).cast("long")), "item_blocks")
    found = against(index, asked_for, "bytes").mapInArrow(_searched(k), "query long, doc_id long, score long")
    ranked = top_per_group(found, ["query"], [F.desc("score"), F.asc_nulls_last("doc_id")], k)
    return ranked.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
