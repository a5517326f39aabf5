"""Near duplicates: MinHash bands propose, odd sketches estimate, full shingle sets confirm."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from answerloom.llm.common import WORD, Words, constants, group_bounds, mix, over_batches, saved, shingles, sorted_groups, text_blocks
from answerloom.llm.components import components

#: MinHash samples of a text; all of them are folded into the sketch, the first BANDS * ROWS also into bands.
SAMPLES = 128
#: A pair of similarity 0.85 shares none of 20 bands of 4 rows with probability 4e-7.
BANDS, ROWS = 20, 4
#: Bits of a parity bitmap.
BITS = 1024
#: A pair is looked at when its estimate is at least this far below the threshold: over 4.5 standard errors.
SLACK = 0.15
#: Rows of a bucket that meet in one tile with as many others.
TILE = 256

_SIGNATURE = "doc_id long, t long, n_shingles long, print binary, bands array<long>, sketch binary, parity binary"


def _parity(rows: np.ndarray, bits: np.ndarray, n: int) -> np.ndarray:
    """Bitmaps (n, BITS / 8): bit b of row r is the parity of the occurrences of (r, b)."""
    return np.packbits((np.bincount(rows * BITS + bits, minlength=n * BITS) & 1).astype(np.uint8).reshape(n, BITS), axis=1)


def _distinct(values: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Values sorted and distinct within each of ``n`` rows, and the bounds of the rows."""
    bounds = np.searchsorted(rows, np.arange(n + 1))
    values = values.copy()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        values[a:b].sort()
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, last, data, offsets in text_blocks(batch.column("text")):
        values, _, rows = shingles(Words(data, offsets))
        yield first, last, *_distinct(values, rows, last - first)


def _prints(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    return [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _signatures(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    multiply, add = constants(SAMPLES, 101), constants(SAMPLES, 202)
    of_band, ids = constants(BANDS * ROWS, 303).reshape(BANDS, ROWS), batch.select(["doc_id", "t"]).columns
    for first, last, values, bounds in _sets(batch):
        n, sizes = last - first, np.diff(bounds)
        full = np.flatnonzero(sizes)
        least = np.zeros((n, SAMPLES), dtype=np.uint64)
        if len(full):
            for k in range(SAMPLES):
                least[full, k] = np.minimum.reduceat(values * multiply[k] + add[k], bounds[:-1][full])
        bands = mix((least[:, : BANDS * ROWS].reshape(n, BANDS, ROWS) * of_band).sum(axis=2, dtype=np.uint64) + of_band[:, 0])
        top = np.uint64(64 - BITS.bit_length() + 1)
        folded = (mix(least + constants(SAMPLES, 404)) >> top).astype(np.int64)
        sketch = _parity(np.repeat(np.arange(n), SAMPLES), folded.ravel(), n)
        parity = _parity(np.repeat(np.arange(n), sizes), (mix(values) >> top).astype(np.int64), n)
        prints = _prints(values, bounds)
        yield pa.RecordBatch.from_arrays(
            [
                *(c.slice(first, n) for c in ids), pa.array(sizes.astype(np.int64)), pa.array(prints, pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(bands.view(np.int64).ravel())),
                pa.array([x.tobytes() for x in sketch], pa.binary()), pa.array([x.tobytes() for x in parity], pa.binary()),
            ],
            names=["doc_id", "t", "n_shingles", "print", "bands", "sketch", "parity"],
        )


def _full_sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The sets of texts that have their class's print."""
    ids, prints = batch.column("id"), batch.column("print").to_pylist()
    for first, last, values, bounds in _sets(batch):
        held = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))
        own = pa.array([x == y for x, y in zip(_prints(values, bounds), prints[first:last], strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), held], names=["id", "held"]).filter(own)


def estimate(xor_bits: np.ndarray) -> np.ndarray:
    """Similarity that the population count of two sketches' XOR stands for."""
    return 1 + BITS / (4 * SAMPLES) * np.log(np.maximum(1 - 2 * xor_bits / BITS, 1e-9))


class _Tile:
    """Rows of one bucket's tile: which pairs may be links."""

    def __init__(self, size: np.ndarray, sketch: np.ndarray, parity: np.ndarray, percent: int):
        self.size, self.sketch, self.parity, self.percent = size, sketch, parity, percent

    def scores(self, i: int) -> np.ndarray:
        """Estimated similarity of row i with every row, -1 where the pair can't be a link.

        The XOR of the whole sets' parity bitmaps never counts more than their difference, so it only
        rules out pairs that are surely below the threshold.
        """
        s = estimate(np.bitwise_count(self.sketch ^ self.sketch[i]).sum(axis=1))
        both, share = self.size + self.size[i], self.percent / 100
        apart = np.bitwise_count(self.parity ^ self.parity[i]).sum(axis=1)
        s[(apart > both * ((1 - share) / (1 + share)) + 1e-9) | (s < share - SLACK)] = -1
        return s


def _forest(tile: _Tile) -> list[tuple[int, int]]:
    """The most similar pairs that connect a tile, as far as possible links do: fewer than its rows."""
    n = len(tile.size)
    best, to, out = np.full(n, -1.0), np.zeros(n, dtype=int), np.zeros(n, dtype=bool)
    pairs, i = [], 0
    for _ in range(n - 1):
        out[i] = True
        s = tile.scores(i)
        nearer = s > best
        best[nearer], to[nearer] = s[nearer], i
        i = int(np.where(out, -2, best).argmax())
        if best[i] >= 0:
            pairs.append((int(to[i]), i))
    return pairs


def _pairs(percent: int, every: bool):
    """For mapInArrow over sorted tiles: a spanning forest of each, or every pair across components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, ["key", "tile"]):
            key, tiles, ids, size = (rows.column(c).to_numpy() for c in ("key", "tile", "id", "n_shingles"))
            sketch, parity = (np.frombuffer(b"".join(rows.column(c).to_pylist()), dtype=np.uint64).reshape(-1, BITS // 64) for c in ("sketch", "parity"))
            part, chunk = (rows.column(c).to_numpy() if every else None for c in ("component", "chunk"))
            a, b = [], []
            bounds = group_bounds(key, tiles)
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if hi - lo < 2:
                    continue
                tile, own = _Tile(size[lo:hi], sketch[lo:hi], parity[lo:hi], percent), ids[lo:hi]
                if not every:
                    found = _forest(tile)
                else:
                    found, parts, chunks = [], part[lo:hi], chunk[lo:hi]
                    two = chunks.min() != chunks.max()
                    for i in range(hi - lo):
                        other = (tile.scores(i) >= 0) & (parts != parts[i]) & (own > own[i])
                        if two:
                            other &= chunks != chunks[i]
                        found += [(i, int(j)) for j in np.flatnonzero(other)]
                a += [min(own[i], own[j]) for i, j in found]
                b += [max(own[i], own[j]) for i, j in found]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 85, cols: tuple[str, str] = ("doc_id", "text")) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    A text's set holds the distinct runs of five lower-cased words (all words of a shorter text as one run);
    texts are linked when 100 * intersection >= percent * union. component_id is the smallest id reachable by
    links and kept says whether it is the row's own. Rows without an id have none to offer: component_id is null, and they
    are kept, where a component has no other rows.

    - Texts without words (null, empty, white space) have size 0, are linked with nothing and kept.
    - Equal sets are one class from the start, so a crowd of copies is one row in all that follows.
    - Texts of one band bucket meet in tiles of bounded size. Each tile first proposes a forest of its most
      similar pairs; what the confirmed ones leave unconnected is then compared pair by pair, so no link is lost
      to a bucket's size, and no bucket's pairs are all written out.
    - Rows that repeat an id are rows of their own with that id: an id links nothing. Other columns are ignored; an empty table gives
      an empty result.
    """
    return _classed(docs.select(F.col(cols[0]).cast("long").alias("doc_id"), F.col(cols[1]).alias("text")), percent).drop("t", "component")


def survivors(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row of each group of near duplicates in ``docs`` (doc_id, text, ...), with all columns: of the rows that have the
    group's smallest id, the one whose text has the smallest hash. Rows in no common group all stay, also under one id. Texts
    without words are no group: all stay, repeated rows with an id once."""
    id_ = F.col("doc_id").cast("long")
    rows = docs.withColumn("_t", F.xxhash64("text")).withColumn("_key", F.coalesce(id_, "_t"))
    worded = F.coalesce(F.rlike("text", F.lit(WORD)), F.lit(False))
    found = _classed(docs.select(id_.alias("doc_id"), "text"), percent).where("n_shingles > 0")
    found = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("of"))
    kept = found.select(F.coalesce("of.doc_id", "of.t").alias("_key"), F.col("of.t").alias("_t"))
    one = rows.where(worded).join(kept, ["_key", "_t"], "left_semi").unionByName(rows.where(~worded & id_.isNotNull())).dropDuplicates(["_key", "_t"])
    return one.unionByName(rows.where(~worded & id_.isNull())).select(*docs.columns)


def _classed(docs: DataFrame, percent: int) -> DataFrame:
    """``near_duplicates`` with ``t``, a hash of the text, and ``component``, a number of the row's component whatever its ids.

    The nodes are classes of equal sets, numbered as they are written.
    """
    docs = docs.withColumn("t", F.xxhash64("text"))
    signed = saved(docs.mapInArrow(over_batches(_signatures), _SIGNATURE), "sketches")
    key = F.coalesce("doc_id", "t").alias("key")
    classes = signed.where("n_shingles > 0").groupBy("print").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct(key, "t")).alias("of"), *(F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch", "parity"))
    )
    classes = saved(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    members = classes.select("id", F.explode("bands").alias("key"))
    crowd = members.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).where("n > 1")
    crowd = crowd.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n")  # bands that met in the same rows are one bucket
    held = members.join(crowd, "key").withColumn("chunks", F.ceil(F.col("n") / TILE).cast("long"))
    held = saved(held.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(2)), F.col("chunks"))), "buckets")
    involved = saved(held.select("id").distinct(), "involved")
    sources = classes.select("id", "print", "of.*").join(involved, "id", "left_semi")
    sets = docs.select(key, "t", "text").join(sources, ["key", "t"]).select("id", "print", "text")
    sets = saved(sets.mapInArrow(over_batches(_full_sets), "id long, held array<long>").dropDuplicates(["id"]), "sets")
    sketches = classes.select("id", "n_shingles", "sketch", "parity").join(involved, "id", "left_semi")

    def proposed(tiled: DataFrame, every: bool) -> DataFrame:
        rows = tiled.join(sketches, "id").repartition("key", "tile").sortWithinPartitions("key", "tile", "id")
        return rows.mapInArrow(_pairs(percent, every), "a long, b long").distinct()

    def confirmed(pairs: DataFrame) -> DataFrame:
        left, right = (sets.select(F.col("id").alias(side), F.col("held").alias(f"of_{side}")) for side in ("a", "b"))
        common = F.size(F.array_intersect("of_a", "of_b")).cast("long")
        rows = pairs.join(left, "a").join(right, "b").select("a", "b", common.alias("i"), (F.size("of_a") + F.size("of_b")).cast("long").alias("s"))
        return rows.where(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("a", "b")

    star = F.when(F.col("chunk") == 0, F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array("chunk"))
    tried = saved(proposed(held.withColumn("tile", F.explode(star)), False), "pairs")
    links = saved(confirmed(tried), "links")
    found = components(links)

    placed = held.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    apart = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    other = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)
    lesser, greater = F.least("chunk", "o"), F.greatest("chunk", "o")
    tiled = placed.join(apart, "key", "left_semi").withColumn("o", F.explode(other)).withColumn("tile", lesser * F.col("chunks") + greater)
    rest = saved(proposed(tiled, True).join(tried, ["a", "b"], "left_anti"), "pairs")
    late = saved(confirmed(rest), "links")
    if not late.isEmpty():
        found = components(links.union(late))

    placed = saved(classes.select("print", "id", "first_id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")
    least = saved(placed.groupBy("component").agg(F.min("first_id").alias("component_id")), "least")
    class_of = placed.join(least, "component", "left").select("print", "component", "component_id")
    rows = signed.select("doc_id", "t", "n_shingles", "print").join(class_of, "print", "left")
    rows = rows.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return rows.select("doc_id", "t", "n_shingles", "component", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
