"""Benchmark passages in documents: SimHash of item-sized windows, Hamming blocks, exact weighted shingles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from answerloom.llm.common import Words, over_batches, saved, shingles, text_blocks

#: Words of a shingle, and the similarity from which a window holds an item.
SHINGLE, SIMILAR = 5, 0.8
#: Fingerprints within this many bits are looked at: windows of similarity 0.8 differ in 9.7 of 64 bits on average, with
#: a deviation of 2.9. Split into four blocks, one of them then differs in at most RADIUS // BLOCKS bits.
RADIUS, BLOCKS = 19, 4
#: Weights are whole numbers: this for a shingle of one item, less for one that several of all items share.
UNIT = 16
#: Items and bytes of text that are looked for in one pass over the documents.
PASS_ITEMS, PASS_BYTES = 5_000, 16 << 20
#: log2 of the entries of the table that tells whether a shingle may be an item's.
_SIGN_BITS = 20
_LEAKS = "array<struct<item_id:bigint,similarity:double,first_word:bigint,n_words:bigint,distance:bigint>>"


@dataclass(frozen=True)
class Items:
    """Items with words: ids, words, fingerprints and shingles; ``near[size][b]`` has the block values within reach of an item of that size.

    ``plain`` and ``plain_near`` are the same without weights, for the ``sharing`` items: those with a shingle that another item has too.
    """

    ids: list[int]
    size: np.ndarray
    print_: np.ndarray
    own: list[np.ndarray]
    known: np.ndarray
    weight: np.ndarray
    of: list[np.ndarray]
    sign: np.ndarray
    near: dict[int, np.ndarray]
    sharing: np.ndarray
    plain: np.ndarray
    plain_near: dict[int, np.ndarray]


def _signs(hashes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """(shingle, 64): its weight, with the sign of each bit of its hash."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return (bits.astype(np.int32) * 2 - 1) * weight[:, None]


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def _reach() -> np.ndarray:
    """The 16-bit values with at most RADIUS // BLOCKS bits."""
    values = np.arange(1 << 16, dtype=np.uint64)
    return values[np.bitwise_count(values) <= RADIUS // BLOCKS].astype(np.int64)


def _blocks(prints: np.ndarray) -> np.ndarray:
    """(fingerprint, block): 16 bits each."""
    return np.stack([((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64) for b in range(BLOCKS)], axis=1)


def _tables(size: np.ndarray, prints: np.ndarray) -> dict[int, np.ndarray]:
    near, reach = {}, _reach()
    for n in np.unique(size):
        table = np.zeros((BLOCKS, 1 << 16), dtype=bool)
        for row in _blocks(prints[size == n]):
            for b in range(BLOCKS):
                table[b, row[b] ^ reach] = True
        near[int(n)] = np.packbits(table, axis=1)
    return near


def learn(ids: list[int], texts: list[str | None], counts: tuple[np.ndarray, np.ndarray] | None = None) -> Items:
    """``counts``: shingles in order that several of all items share, and by how many; without it, these items are all."""
    shingled: list[np.ndarray] = [np.zeros(0, dtype=np.uint64)] * len(ids)
    size = np.zeros(len(ids), dtype=np.int64)
    for first, last, data, offsets in text_blocks(pa.array(texts, pa.string()), 1 << 20):
        words = Words(data, offsets)
        values, _, rows = shingles(words, SHINGLE)
        size[first:last] = words.count
        for i in range(last - first):
            shingled[first + i] = values[rows == i]
    keep = [i for i in range(len(ids)) if size[i]]
    ids, size, shingled = [ids[i] for i in keep], size[keep], [shingled[i] for i in keep]
    own = [np.unique(x) for x in shingled]
    known, index, shared = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *own]), return_inverse=True, return_counts=True)
    everywhere = shared
    if counts is not None and len(counts[0]):
        place = np.minimum(np.searchsorted(counts[0], known), len(counts[0]) - 1)
        everywhere = np.where(counts[0][place] == known, counts[1][place], 1)
    weight = np.maximum(1, UNIT // everywhere).astype(np.int32) if len(known) else np.zeros(0, dtype=np.int32)
    of_item = np.repeat(np.arange(len(own)), [len(x) for x in own])
    by_shingle = np.argsort(index, kind="stable")
    of = np.split(of_item[by_shingle], np.cumsum(shared)[:-1]) if len(known) else []
    weighted = [weight[np.searchsorted(known, x)] for x in shingled]
    prints, plain = (
        np.array([_fingerprints(_signs(x, w).sum(axis=0, keepdims=True))[0] for x, w in zip(shingled, ws, strict=True)], dtype=np.uint64)
        for ws in (weighted, [np.ones(len(x), dtype=np.int32) for x in shingled])
    )
    sharing = np.array([bool((w < UNIT).any()) for w in weighted], dtype=bool)
    sign = np.zeros(1 << _SIGN_BITS, dtype=bool)
    sign[(known >> np.uint64(64 - _SIGN_BITS)).astype(np.int64)] = True
    near, plain_near = _tables(size, prints), _tables(size[sharing], plain[sharing])
    return Items(ids, size, prints, own, known, weight, of, sign, near, sharing, plain, plain_near)


def _weights(items: Items, values: np.ndarray) -> np.ndarray:
    """Of any shingles; one that no item has weighs UNIT."""
    if not len(items.known):
        return np.full(len(values), UNIT, dtype=np.int32)
    place = np.minimum(np.searchsorted(items.known, values), len(items.known) - 1)
    return np.where(items.known[place] == values, items.weight[place], UNIT).astype(np.int32)


def _similarity(items: Items, item: int, values: np.ndarray, plain: bool = False) -> float:
    """Weight of the common shingles over the weight of all, each once; plain: all weigh the same."""
    values, own = np.unique(values), items.own[item]
    shared = np.intersect1d(values, own, assume_unique=True)
    if plain:
        return len(shared) / (len(values) + len(own) - len(shared))
    common = _weights(items, shared).sum()
    return float(common / (_weights(items, values).sum() + _weights(items, own).sum() - common))


def _leaks(items: Items, values: np.ndarray) -> list[dict]:
    """Items found in one document's shingles (in order)."""
    may = np.flatnonzero(items.sign[(values >> np.uint64(64 - _SIGN_BITS)).astype(np.int64)])
    if not len(may):
        return []
    place = np.minimum(np.searchsorted(items.known, values[may]), len(items.known) - 1)
    hit = items.known[place] == values[may]
    may, place = may[hit], place[hit]
    if not len(may):
        return []
    best: dict[int, tuple[bool, float, dict]] = {}
    longest = int(items.size.max())
    cuts = np.flatnonzero(np.diff(may) > 2 * longest) + 1  # no window reaches from one stretch of hits to the next
    for hits, of in zip(np.split(may, cuts), np.split(place, cuts), strict=True):
        _look(items, values, hits, of, best)
    return sorted((x for _, _, x in best.values()), key=lambda x: x["item_id"])


def _look(items: Items, values: np.ndarray, may: np.ndarray, place: np.ndarray, best: dict[int, tuple[bool, float, dict]]) -> None:
    """Puts into ``best`` what the windows over one stretch of hits find: whether by weight, the similarity, the leak."""
    lo, hi = int(may[0]), int(may[-1])
    by_shingle = {int(p): items.of[p] for p in np.unique(place)}
    touched = np.unique(np.concatenate(list(by_shingle.values())))
    longest = max(1, int(items.size[touched].max()) - SHINGLE + 1)
    lo, hi = max(0, lo - longest), min(len(values), hi + longest)
    near = values[lo:hi]
    for plain in (False, True):
        # without a shared shingle, an item's weighted similarity is never below its plain one
        looked = items.sharing if plain else np.ones(len(items.size), dtype=bool)
        lengths = np.unique(items.size[touched[looked[touched]]]).tolist()
        if not lengths:
            continue
        of_item, tables = (items.plain, items.plain_near) if plain else (items.print_, items.near)
        sums = np.zeros((len(near) + 1, 64), dtype=np.int32)
        np.cumsum(_signs(near, np.ones(len(near), dtype=np.int32) if plain else _weights(items, near)), axis=0, out=sums[1:])
        for n in lengths:
            wide = max(1, n - SHINGLE + 1)
            wanted = (items.size == n) & looked
            touch = np.zeros(len(near) + 1, dtype=np.int64)
            for at, p in zip(may - lo, place, strict=True):
                if wanted[by_shingle[int(p)]].any():
                    touch[max(0, at - wide + 1)] += 1
                    touch[at + 1] -= 1
            starts = np.flatnonzero(np.cumsum(touch)[:-1] > 0)
            ends = np.minimum(starts + wide, len(near))
            prints = _fingerprints(sums[ends] - sums[starts])
            table, blocks = tables[n], _blocks(prints)
            close = np.zeros(len(starts), dtype=bool)
            for b in range(BLOCKS):
                close |= (table[b, blocks[:, b] >> 3] >> (7 - (blocks[:, b] & 7)).astype(np.uint8)) & 1 == 1
            for item in np.flatnonzero(wanted) if close.any() else ():
                apart = np.bitwise_count(prints[close] ^ of_item[item])
                for k in np.flatnonzero(apart <= RADIUS):
                    a, e = int(starts[close][k]), int(ends[close][k])
                    s = _similarity(items, item, near[a:e], plain)
                    if s >= SIMILAR and (item not in best or (not plain, s) > best[item][:2]):
                        words = min(n, e - a + SHINGLE - 1)
                        leak = {"item_id": items.ids[item], "similarity": s, "first_word": lo + a, "n_words": words, "distance": int(apart[k])}
                        best[item] = (not plain, s, leak)


def _held(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(part, value): the distinct shingles of each item."""
    part = batch.column("part").to_numpy()
    for first, last, data, offsets in text_blocks(batch.column("text"), 1 << 20):
        values, _, rows = shingles(Words(data, offsets), SHINGLE)
        order = np.lexsort((values, rows))
        values, rows = values[order], rows[order]
        new = np.ones(len(values), dtype=bool)
        new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(part[first:last][rows[new]]), pa.array(values[new].view(np.int64))], names=["part", "value"])


def _passes(items: DataFrame) -> list[Items]:
    """The distinct items, a bounded number at a time; how many share a shingle is counted over all of them."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-n // PASS_ITEMS), -(-size // PASS_BYTES))
    if parts > 1:
        items = saved(items.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts))), "items")
        shared = items.select("part", "text").mapInArrow(over_batches(_held), "part long, value long").groupBy("value")
        shared = saved(shared.agg(F.count("*").alias("n"), F.collect_set("part").alias("parts")).where("n > 1"), "shared")
    out = []
    for part in range(parts):
        rows = (items.where(F.col("part") == part) if parts > 1 else items).collect()
        rows.sort(key=lambda r: (r.item_id, r.text))
        counts = None
        if parts > 1:
            own = shared.where(F.array_contains("parts", F.lit(part).cast("long"))).select("value", "n").toArrow()
            value, n_items = own.column("value").to_numpy().view(np.uint64), own.column("n").to_numpy()
            order = np.argsort(value)
            counts = value[order], n_items[order]
        out.append(learn([r.item_id for r in rows], [r.text for r in rows], counts))
    return out


def flag(docs: DataFrame, items: DataFrame, col: str = "text") -> DataFrame:
    """``docs`` with ``leaks``: an array of (item_id, similarity, first_word, n_words, distance), by item.

    An item is found where a window of its own number of words (fewer at a text's end) has at least SIMILAR of the weight
    of its and the item's distinct shingles in common; the best window counts, the first of equals. Shingles that several
    items share weigh less, and where that alone keeps an item from being found, SIMILAR of the shingles without weights
    is enough, so repeated items and templates lose nothing. Windows come from where at least one shingle is an item's: no others have anything in common
    with one. Their SimHash has to be within RADIUS bits of an item of that size, which the block tables tell.

    Null texts, ids and items have no leaks; an item of less than five words is one shingle. Equal rows of ``items`` are one item. Items are learned a bounded
    number at a time, each time over all documents. Rows are independent and all columns stay, save one named leaks.
    """
    names = [f for f in docs.schema.fields if f.name != "leaks"]
    none = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("distance", pa.int64())]))
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in names), f"leaks {_LEAKS}"])
    docs = docs.drop("leaks").withColumn("leaks", F.expr(f"CAST(array() AS {_LEAKS})"))
    for known in _passes(items):
        if not known.ids:
            continue

        def work(batch: pa.RecordBatch, known: Items = known) -> Iterator[pa.RecordBatch]:
            leaks = batch.column("leaks").to_pylist()
            for first, last, data, offsets in text_blocks(batch.column(col)):
                values, _, rows = shingles(Words(data, offsets), SHINGLE)
                hit = known.sign[(values >> np.uint64(64 - _SIGN_BITS)).astype(np.int64)]
                bounds = np.searchsorted(rows, np.arange(last - first + 1))
                for i in np.unique(rows[hit]):
                    leaks[first + i] = leaks[first + i] + _leaks(known, values[bounds[i] : bounds[i + 1]])
            columns = [batch.column(f.name) for f in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(leaks, none)], names=[*(f.name for f in names), "leaks"])

        docs = docs.mapInArrow(over_batches(work, col), fields)
    return docs


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words, distance): a row for each document row and each item in it."""
    rows = flag(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items)
    return rows.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any benchmark item, with the columns of ``docs``."""
    names = docs.columns
    rows = flag(docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(names))), items, f"_{names.index('text')}").where(F.size("leaks") == 0)
    return rows.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(names)))
