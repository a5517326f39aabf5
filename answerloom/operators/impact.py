"""Keyword search over blocked postings: a block that cannot reach the running k-th score is not scored."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from answerloom.operators.skew import bounded_join, top_per_group

#: Chunks of a record, and of a block inside it.
RECORD, BLOCK = 4096, 64
#: Postings of a record, one chunk's at least: a record is held whole by readers and writers, some 30 bytes a posting.
POSTINGS = 1 << 18
#: Postings that are gathered before records are cut from them.
GATHERED = 1 << 19
#: Query weights that meet a record at once, on average, where those of all queries are too many to send to every task.
WEIGHTS = 1 << 16
#: Rounding of the scores that decide ranks, and what a bound may fall short of it.
DIGITS, MARGIN = 9, 1e-8

RECORDS = (
    "kb_id string, keys array<string>, dl array<int>, terms array<bigint>, ends array<int>, place array<int>, tf array<int>, "
    "block array<int>, block_ends array<int>, most_tf array<int>, least_dl array<int>"
)


def _bounds(*columns: np.ndarray) -> np.ndarray:
    change = np.zeros(len(columns[0]), dtype=bool)
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(np.append([True], change[1:])), len(columns[0]))


def _record(kb: str | None, keys: list[str], dl: np.ndarray, chunk: np.ndarray, term: np.ndarray, tf: np.ndarray) -> dict:
    """One record: postings by term and place; each (term, block) with its end, largest frequency and shortest chunk."""
    order = np.lexsort((chunk, term))
    term, chunk, tf = term[order], chunk[order], tf[order]
    terms = _bounds(term)
    blocks = _bounds(term, chunk // BLOCK)
    return {
        "kb_id": kb, "keys": keys, "dl": dl, "terms": term[terms[:-1]], "ends": np.searchsorted(blocks, terms[1:]), "place": chunk, "tf": tf,
        "block": chunk[blocks[:-1]] // BLOCK, "block_ends": blocks[1:], "most_tf": np.maximum.reduceat(tf, blocks[:-1]), "least_dl": np.minimum.reduceat(dl[chunk], blocks[:-1]),
    }


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from postings (kb_id, chunk_key, dl, term, tf) sorted by collection and chunk."""
    kinds = {f: pa.list_(pa.int32()) for f in ("dl", "ends", "place", "tf", "block", "block_ends", "most_tf", "least_dl")}
    schema = pa.schema([("kb_id", pa.string()), ("keys", pa.list_(pa.string())), ("dl", kinds["dl"]), ("terms", pa.list_(pa.int64())), *((f, kinds[f]) for f in ("ends", "place", "tf", "block", "block_ends", "most_tf", "least_dl"))])

    def cut(rows: pa.Table, last: bool) -> tuple[list[dict], pa.Table]:
        kb, key = (rows.column(c).combine_chunks().dictionary_encode() for c in ("kb_id", "chunk_key"))
        kb_names, key_names = kb.dictionary.to_pylist(), key.dictionary.to_pylist()
        kb, key = (c.indices.fill_null(-1).to_numpy() for c in (kb, key))
        dl, term, tf = (rows.column(c).to_numpy() for c in ("dl", "term", "tf"))
        chunks = _bounds(kb, key)
        found, at = [], 0
        while at < len(chunks) - 1:
            same = kb[chunks[at : at + RECORD]] == kb[chunks[at]] if at + RECORD < len(chunks) else kb[chunks[at:-1]] == kb[chunks[at]]
            size = int(same.argmin()) if not same.all() else len(same)
            size = min(size, max(1, int(np.searchsorted(chunks, chunks[at] + POSTINGS, "right")) - 1 - at))
            if not last and at + size >= len(chunks) - 1:
                break  # the last chunks may go on in the next batch
            lo, hi = chunks[at], chunks[at + size]
            starts = chunks[at : at + size]
            own = np.repeat(np.arange(size), np.diff(chunks[at : at + size + 1]))
            found.append(_record(kb_names[kb[lo]] if kb[lo] >= 0 else None, [key_names[key[s]] for s in starts], dl[starts], own, term[lo:hi], tf[lo:hi]))
            at += size
        return found, rows.slice(int(chunks[at]))

    def written(found: list[dict]) -> Iterator[pa.RecordBatch]:
        for r in found:
            columns = []
            for f in schema:
                if isinstance(r[f.name], np.ndarray):
                    values = pa.array(r[f.name].astype(f.type.value_type.to_pandas_dtype(), copy=False))
                    columns.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
                else:
                    columns.append(pa.array([r[f.name]], f.type))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rest, size, enough = [], 0, GATHERED
    for batch in batches:
        rest.append(batch)
        size += batch.num_rows
        if size >= enough:  # what is not cut is read again, so it has to double first
            found, left = cut(pa.Table.from_batches(rest), False)
            rest, size = left.to_batches(), left.num_rows
            enough = max(GATHERED, 2 * size)
            yield from written(found)
    if size:
        yield from written(cut(pa.Table.from_batches(rest), True)[0])


def blocked(post: DataFrame) -> DataFrame:
    """Records of ``post`` (kb_id, chunk_key, dl, term, tf): up to ``RECORD`` chunks and ``POSTINGS`` postings of a collection, chunks whole, so that a
    search needs no exchange between postings and scores. Chunks are dealt by key ranges; a large collection spreads over
    many tasks. Terms are told apart by a 64-bit hash."""
    return blocked_in_place(post.repartitionByRange("kb_id", "chunk_key").sortWithinPartitions("kb_id", "chunk_key"))


def blocked_in_place(post: DataFrame) -> DataFrame:
    """``blocked`` of postings whose partitions are in the order of their chunks, a chunk in one partition: no exchange, no sort."""
    return post.select("kb_id", "chunk_key", "dl", F.xxhash64("term").alias("term"), "tf").mapInArrow(_records, RECORDS)


def _taken_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings (kb_id, chunk_key, dl, term, tf) of records, chunk by chunk."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = _plain(batch, i)
            order = np.argsort(r["place"], kind="stable")
            place = r["place"][order]
            term = np.repeat(r["terms"], np.diff(np.append(0, r["block_ends"])[np.append(0, r["ends"])]))[order]
            kb, keys = pa.array([r["kb_id"]], pa.string()).take(pa.array(np.zeros(len(place), np.int64))), pa.array(r["keys"], pa.string()).take(pa.array(place))
            yield pa.RecordBatch.from_arrays([kb, keys, pa.array(r["dl"][place]), pa.array(term), pa.array(r["tf"][order])], names=["kb_id", "chunk_key", "dl", "term", "tf"])


def merged(records: DataFrame) -> DataFrame:
    """The chunks of ``records``, none of which is in two of them, in records as full as they may be. Records are exchanged, not postings."""
    first = F.get("keys", F.lit(0))
    dealt = records.repartitionByRange("kb_id", first).sortWithinPartitions("kb_id", first)
    return dealt.mapInArrow(lambda batches: _records(_taken_apart(batches)), RECORDS)


@dataclass
class Work:
    """Blocks that hold a query's term, and those of them whose postings were scored."""

    met: int = 0
    scored: int = 0


@dataclass
class Searcher:
    """One record of chunks, ready for queries."""

    row: dict
    avgdl: float
    k1: float
    b: float
    work: Work = field(default_factory=Work)

    def __post_init__(self):
        r = self.row
        self.first = np.append(0, r["ends"])
        self.start = np.append(0, r["block_ends"])
        self.n = len(r["dl"])
        self.norm = self.k1 * (1 - self.b + self.b * r["dl"] / self.avgdl)
        self.bound = r["most_tf"] / (r["most_tf"] + self.k1 * (1 - self.b + self.b * r["least_dl"] / self.avgdl))

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of chunks that may be among the first ``k`` and reach ``floor``.

        The bounds of a block are summed over the query's terms. Blocks with the largest sums are scored first, as many as hold k
        chunks; what they give raises the floor, and only blocks whose sum reaches it are scored then.
        """
        at = np.searchsorted(self.row["terms"], terms)
        held = at < len(self.row["terms"])
        held[held] = self.row["terms"][at[held]] == terms[held]
        at, weights = at[held], weights[held]
        count = self.first[at + 1] - self.first[at]
        cells = np.repeat(self.first[at] - np.cumsum(count) + count, count) + np.arange(count.sum())
        weight, block = np.repeat(weights, count), self.row["block"][cells]
        most = np.bincount(block, weights=weight * self.bound[cells], minlength=-(-self.n // BLOCK))
        self.work.met += int((most > 0).sum())
        scores = np.zeros(self.n)
        order = np.argsort(-most, kind="stable")
        early = np.zeros(len(most), dtype=bool)
        early[order[: 1 + k // BLOCK]] = True
        for chosen in (early & (most > 0), ~early & (most > 0)):
            chosen &= most >= floor - MARGIN
            if not chosen.any():
                continue
            self.work.scored += int(chosen.sum())
            mine = chosen[block]
            part = cells[mine]
            length = self.start[part + 1] - self.start[part]
            posting = np.repeat(self.start[part] - np.cumsum(length) + length, length) + np.arange(length.sum())
            place, tf = self.row["place"][posting], self.row["tf"][posting]
            scores += np.bincount(place, weights=np.repeat(weight[mine], length) * tf / (tf + self.norm[place]), minlength=self.n)
            if self.n >= k:
                floor = max(floor, float(np.partition(scores, self.n - k)[self.n - k]))
        found = np.flatnonzero((scores > 0) & (scores >= floor - MARGIN))
        return found, scores[found]


class _Best:
    """The first k chunks of each query (or query and collection) among the records a task has seen."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def floor(self, key: tuple) -> float:
        best = self.held.get(key, ())
        return best[-1][3] if len(best) >= self.k else 0.0

    def add(self, key: tuple, kb: str | None, keys: list, places: np.ndarray, scores: np.ndarray) -> None:
        new = [(-round(float(s), DIGITS), keys[p], kb, float(s)) for p, s in zip(places, scores, strict=True)]
        self.held[key] = sorted([*self.held.get(key, ()), *new], key=lambda x: (x[0], x[1], x[2] or ""))[: self.k]


def _plain(batch: pa.RecordBatch, i: int) -> dict:
    def value(x: pa.Scalar):
        if pa.types.is_list(x.type):
            inner = x.type.value_type
            return x.values if pa.types.is_struct(inner) else x.values.to_pylist() if pa.types.is_string(inner) else x.values.to_numpy(zero_copy_only=False)
        return x.as_py()

    return {c: value(col[i]) for c, col in zip(batch.schema.names, batch.columns, strict=True)}


def _searching(k: int, k1: float, b: float, per_kb: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, ids = _Best(k), None
        for batch in batches:
            for i in range(batch.num_rows):
                row = _plain(batch, i)
                asked, searcher = row["asked"], Searcher(row, row["avgdl"], k1, b)
                ids = asked.field("query_id").type
                names = asked.field("query_id").to_pylist()
                place = np.unique(np.array([str(x) for x in names]), return_inverse=True)[1]
                order = np.argsort(place, kind="stable")
                term, weight = asked.field("term").to_numpy()[order], asked.field("weight").to_numpy()[order]
                bounds = _bounds(place[order])
                for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                    key = (names[order[lo]], row["kb_id"] if per_kb else None)
                    found, scores = searcher.top(term[lo:hi], weight[lo:hi], k, best.floor(key))
                    if len(found):
                        best.add(key, row["kb_id"], row["keys"], found, scores)
        rows = [(key[0], x[2], x[1], x[3]) for key, held in best.held.items() for x in held]
        if rows:
            columns = list(zip(*rows, strict=True))
            kinds = [ids, pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "kb_id", "chunk_key", "raw"])

    return run


def blocked_topk(weights: DataFrame, n_weights: int, records: DataFrame, k: int, k1: float, b: float, per_kb: bool, small: bool | None) -> DataFrame:
    """(query_id, kb_id, chunk_key, bm25_score, bm25_rank) for ``weights`` (query_id, kb_id, term, weight, avgdl), of which there are about
    ``n_weights`` per collection. The queries' weights go to the records; only k rows per query and task leave.

    A join repeats a record, some MB, for every row of weights that it meets. So weights known to be ``small`` are one row for each
    collection, and only others are parted by query."""
    groups = 1 if small else max(1, -(-n_weights // WEIGHTS))
    asked = weights.groupBy("kb_id", F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("part")).agg(
        F.first("avgdl").alias("avgdl"), F.collect_list(F.struct("query_id", F.xxhash64("term").alias("term"), "weight")).alias("asked")
    )
    rows = bounded_join(records, asked.drop("part"), ["kb_id"], spread=["keys"], small_is_small=small)
    query_id = weights.schema["query_id"].dataType.simpleString()
    found = rows.mapInArrow(_searching(k, k1, b, per_kb), f"query_id {query_id}, kb_id string, chunk_key string, raw double")
    found = found.select("query_id", "kb_id", "chunk_key", F.round("raw", DIGITS).alias("bm25_score"))
    group = ["query_id", "kb_id"] if per_kb else ["query_id"]
    return top_per_group(found, group, [F.desc("bm25_score"), F.asc("chunk_key")], k, "bm25_rank")
