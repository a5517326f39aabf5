"""Hard negatives of anchors by exact integer scores, several rows scored with one multiplication."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from answerloom.llm.blocks import against
from answerloom.llm.common import saved, sorted_groups
from answerloom.operators.skew import top_per_group

#: Rows and anchors of a block.
ROWS, ANCHORS = 2048, 512
#: Integers below this bound are exact in a double, so a packed product may have so many bits.
EXACT_BITS = 53
#: Stands for "no row"; every score lies above it.
NONE = -(1 << 55)
#: Blocks of anchors for which a task holds its best rows at one time.
HELD = 64

_BLOCK = "row_block long, ids array<long>, labels array<int>, dim int, parts array<double>"


def packed_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products (anchors x rows) of matrices whose doubles are integers.

    Both sides are biased to be non-negative. Components of several rows then lie in separated fields of one wide integer, each
    field as wide as the largest biased product of these two blocks, so one multiplication per anchor component moves all of
    them and no field reaches into the next. As many fields as stay below 2 ** 53 go into one double; where not even one does,
    all rows of the block go into one Python integer.
    """
    dim, n = rows.shape[1], len(rows)
    if not dim or not n or not len(anchors):
        return np.zeros((len(anchors), n), dtype=np.int64)
    up, over = max(0.0, -anchors.min()), max(0.0, -rows.min())
    a, r = anchors + up, rows + over
    width = max(1, (dim * int(a.max()) * int(r.max())).bit_length())
    fields = EXACT_BITS // width
    if not fields or max(a.max(), r.max()) >= 1 << EXACT_BITS:
        return _wide_scores(anchors, rows)
    each = -(-n // fields)
    wide = np.zeros((each, dim))
    for f in range(fields):
        part = r[f * each : (f + 1) * each]
        wide[: len(part)] += part * float(1 << (width * f))
    product = (a @ wide.T).astype(np.int64)
    out = np.concatenate([(product >> (width * f)) & ((1 << width) - 1) for f in range(fields)], axis=1)[:, :n]
    bias = int(up) * rows.sum(axis=1).astype(np.int64)[None, :] + int(over) * anchors.sum(axis=1).astype(np.int64)[:, None]
    return out - bias - dim * int(up) * int(over)


def _wide_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The same by one Python integer per component, for numbers of any size."""
    a, r = ([[int(x) for x in row] for row in side] for side in (anchors, rows))
    dim, up, over = len(r[0]), max(0, -min(map(min, a))), max(0, -min(map(min, r)))
    wide = max(1, (dim * (max(map(max, a)) + up) * (max(map(max, r)) + over)).bit_length()) // 8 + 1
    columns = [int.from_bytes(b"".join((row[j] + over).to_bytes(wide, "little") for row in r), "little") for j in range(dim)]
    out = np.empty((len(a), len(r)), dtype=np.int64)
    sums = [sum(row) for row in r]
    for i, row in enumerate(a):
        fields = sum((x + up) * column for x, column in zip(row, columns, strict=True)).to_bytes(wide * len(r), "little")
        rest = over * sum(row) + dim * up * over
        for k, s in enumerate(sums):
            score = int.from_bytes(fields[k * wide : (k + 1) * wide], "little") - up * s - rest
            if abs(score) >= -NONE:
                raise OverflowError(f"score {score} is beyond 2 ** 55")
            out[i, k] = score
    return out


def _matrix(parts: pa.Array) -> np.ndarray:
    """Rows of a list column, shorter ones filled with zeros."""
    sizes = np.diff(parts.offsets.to_numpy())
    flat = parts.flatten().to_numpy(zero_copy_only=False)
    dim = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def _block(number: int, rows: pa.Table | pa.RecordBatch) -> pa.RecordBatch:
    order = np.argsort(ids := rows.column("vec_id").to_numpy(), kind="stable")
    parts = rows.column("part")
    matrix = _matrix(parts.combine_chunks() if isinstance(parts, pa.ChunkedArray) else parts)[order]
    lists = [ids[order], rows.column("label").to_numpy()[order], None, matrix.ravel()]
    kinds = [pa.int64(), pa.int32(), None, pa.float64()]
    columns = [pa.array([matrix.shape[1]], pa.int32()) if k is None else pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, k)) for x, k in zip(lists, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *columns], names=["row_block", "ids", "labels", "dim", "parts"])


def _row_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            rows = batch.slice(first, ROWS)
            yield _block(int(rows.column("row")[0].as_py()), rows)


def _anchor_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in sorted_groups(batches, ["block"]):
        numbers = rows.column("block").to_numpy()
        for number in np.unique(numbers):
            a, b = np.searchsorted(numbers, [number, number + 1])
            yield _block(int(number), rows.slice(a, b - a))


def _sides(row: dict) -> tuple[np.ndarray, ...]:
    """ids and labels of the anchors, then of the rows, and their scores."""
    a_ids, a_labels, ids, labels = (np.asarray(row[c], dtype=np.int64) for c in ("a_ids", "a_labels", "ids", "labels"))
    dim = max(row["a_dim"], row["dim"])
    both = []
    for n, own, parts in ((len(a_ids), row["a_dim"], row["a_parts"]), (len(ids), row["dim"], row["parts"])):
        matrix = np.zeros((n, dim))
        matrix[:, :own] = np.asarray(parts, dtype=float).reshape(n, own)
        both.append(matrix)
    return a_ids, a_labels, ids, labels, packed_scores(*both)


def _merged(held: tuple[np.ndarray, np.ndarray] | None, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k along the last axis by (score descending, id) of what is held and what comes."""
    if held is not None:
        scores, ids = np.concatenate([held[0], scores], axis=-1), np.concatenate([held[1], ids], axis=-1)
    order = np.lexsort((ids, -scores), axis=-1)[..., :k]
    return np.take_along_axis(scores, order, -1), np.take_along_axis(ids, order, -1)


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k of each line; the ids ascend along it."""
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(scores, order, 1), ids[order]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: x.as_py() if not pa.types.is_list(x.type) else x.values.to_numpy(zero_copy_only=False) if not pa.types.is_struct(x.type.value_type) else x.values for c, x in zip(batch.schema.names, (col[i] for col in batch.columns), strict=True)}


def _positives(k: int):
    """For mapInArrow over pairs of blocks: the first k other rows of each anchor's label that the task has seen."""

    def told(held: dict) -> Iterator[pa.RecordBatch]:
        for block, (scores, ids) in held.items():
            a, c = np.nonzero(scores > NONE)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), block), pa.int64()), pa.array(a, pa.int32()), pa.array(ids[a, c], pa.int64()), pa.array(scores[a, c], pa.int64())], names=["block", "a", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for row in _rows(batches):
            a_ids, a_labels, ids, labels, scores = _sides(row)
            scores[(a_labels[:, None] != labels) | (a_ids[:, None] == ids)] = NONE
            held[row["block"]] = _merged(held.get(row["block"]), *_first(scores, ids, k), k)
            if len(held) > HELD:
                yield from told(held)
                held = {}
        yield from told(held)

    return run


def _negatives(k: int, low: int, high: int):
    """For mapInArrow over pairs of blocks: the first k rows of other labels in each positive's range that the task has seen."""

    def told(held: dict, of: dict) -> Iterator[pa.RecordBatch]:
        for block, (scores, ids) in held.items():
            a_ids, places, rank, positive, p_score = of[block]
            p, c = np.nonzero(scores > NONE)
            columns = [np.full(len(p), block), places[p], rank[p], a_ids[places[p]], positive[p], p_score[p], ids[p, c], scores[p, c]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["block", "a", "p", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        of: dict[int, tuple[np.ndarray, ...]] = {}
        for row in _rows(batches):
            a_ids, a_labels, ids, labels, scores = _sides(row)
            found = row["found"]
            places, rank, positive, p_score = (found.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "rank", "id", "score"))
            scores[a_labels[:, None] == labels] = NONE
            order = np.argsort(-scores, axis=1, kind="stable")
            ranked = np.take_along_axis(scores, order, 1)[places]
            begin = (100 * ranked > high * p_score[:, None]).sum(axis=1)
            at = begin[:, None] + np.arange(k)
            inside = at < ranked.shape[1]
            at = np.minimum(at, ranked.shape[1] - 1)
            best = np.take_along_axis(ranked, at, 1)
            best[~inside | (100 * best < low * p_score[:, None])] = NONE
            block = row["block"]
            of[block] = (a_ids, places, rank, positive, p_score)
            held[block] = _merged(held.get(block), best, ids[np.take_along_axis(order[places], at, 1)], k)
            if len(held) > HELD:
                yield from told(held, of)
                held, of = {}, {}
        yield from told(held, of)

    return run


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``vectors`` (vec_id, embedding, label).

    Anchors are the rows whose id is divisible by ``every``. Components become floor(256 * x); a score is the integer inner
    product with the anchor, ties go to the smaller id. Each anchor takes its first ``positives`` rows of its label, and for each
    of them the first ``negatives`` rows of other labels whose score lies from ``low`` to ``high`` percent of the positive's.

    Rows without id, label or vector, and those with a null or non-finite component, take no part; a shorter vector is
    filled with zeros, and an empty one scores 0. Other rows than an anchor are those with another id. Repeated rows are rows of their
    own, repeated anchors have results of their own. A negative positive's range is empty. Scores stay below 2 ** 55, or the job
    fails. Other columns are ignored; an empty table gives an empty result.

    The anchors, in blocks, meet the rows, in blocks, twice: first for the positives, then for their ranges. A task sends its
    best rows only.
    """
    double = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), double.alias("part"))
    blocks = saved(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_row_blocks, _BLOCK), "row_blocks")

    picked = rows.where(F.col("vec_id") % every == 0)
    n_blocks = max(1, -(-picked.count() // ANCHORS))
    dealt = picked.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(n_blocks))).repartition("block").sortWithinPartitions("block", "vec_id")
    anchors = dealt.mapInArrow(_anchor_blocks, _BLOCK)
    names = {"row_block": "block", "ids": "a_ids", "labels": "a_labels", "dim": "a_dim", "parts": "a_parts"}
    anchors = anchors.withColumn("a_bytes", (8 * F.size("parts") + 12 * F.size("ids")).cast("long")).withColumnsRenamed(names)
    anchors = saved(anchors, "anchor_blocks")
    near = against(blocks, anchors, "a_bytes").mapInArrow(_positives(positives), "block long, a int, id long, score long")
    near = top_per_group(near, ["block", "a"], [F.desc("score"), F.asc("id")], positives)
    found = near.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("a", "rank", "id", "score"))).alias("found"))  # a block's own
    asked = saved(anchors.join(found, "block"), "anchor_blocks")
    schema = "block long, a long, p long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    far = against(blocks, asked, "a_bytes").mapInArrow(_negatives(negatives, low, high), schema)
    ranked = top_per_group(far, ["block", "a", "p"], [F.desc("negative_score"), F.asc("negative_id")], negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

