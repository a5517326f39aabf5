"""Repeated passages: run-length compressed indexes over buckets of text that hold all copies of their passages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from answerloom.llm.common import constants, group_bounds, mix, over_batches, prefix_hashes, saved, sorted_groups, text_blocks

#: Bytes of a string that counts as repeated.
LENGTH = 200
#: A string's anchor is the smallest hash of its runs of GRAM bytes: equal strings have equal anchors.
GRAM = 32
#: Strings of consecutive starts and one anchor are a passage; longer stretches are cut here, which loses no string.
MOST_STARTS = 240
#: An anchor with more different passages than this is not indexed in one task: its strings are dealt by hash, to a part for so many passages.
MOST_PASSAGES = 1000
#: Bytes of passages to an index, save where one anchor has more: small enough for a core's cache.
INDEX_BYTES = 1 << 18
#: Bits of a sort key.
_KEY_BITS = 62

_WIDE = LENGTH - GRAM + 1
_RUN = "doc_id long, t int, start int, n int, anchor long, content long, twice boolean"
_MARKS = "anchor long, content long, n int, ranges array<int>"


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of GRAM bytes, and for each start of LENGTH bytes the smallest of those inside."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    c = constants(3, 707)
    h = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1)).copy().view(np.uint64).ravel()
    for k, step in enumerate((8, 16)):
        h = h[:-step] * c[k] + (h[step:] ^ (h[step:] >> np.uint64(29))) * c[k + 1]
    h = mix(h)
    rows = -(-len(h) // _WIDE)
    padded = np.full(rows * _WIDE, np.uint64(2**64 - 1))
    padded[: len(h)] = h
    ahead = np.minimum.accumulate(padded.reshape(rows, _WIDE), axis=1).ravel()
    back = np.minimum.accumulate(padded.reshape(rows, _WIDE)[:, ::-1], axis=1)[:, ::-1].ravel()
    return h, np.minimum(back[:n], ahead[_WIDE - 1 : _WIDE - 1 + n])


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start in the row, starts, anchor, content hash, whether the anchor is twice inside) of a block's passages;
    none crosses rows."""
    hashes, least = anchors(data)
    at = np.arange(len(least))
    row = np.searchsorted(offsets, at, "right") - 1
    at = at[at + LENGTH <= offsets[row + 1]]
    row = row[at]
    if not len(at):
        return (*(np.zeros(0, dtype=np.int64) for _ in range(5)), np.zeros(0, dtype=bool))
    fresh = np.append([True], (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1]) | (least[at[1:]] != least[at[:-1]]))
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
    fresh |= (np.arange(len(at)) - begin) % MOST_STARTS == 0
    first = np.flatnonzero(fresh)
    n = np.diff(np.append(first, len(at)))
    sums, back = prefix_hashes(data, constants(256, 808))
    begin = at[first]
    content = mix((sums[begin + n + LENGTH - 1] - sums[begin]) * back[begin])
    twice, inside = np.zeros(len(first), dtype=bool), np.arange(_WIDE)
    for i in range(0, len(first), 4096):  # the anchor's first place in the first string against its last in the last one
        a, z, own = begin[i : i + 4096], (begin + n - 1)[i : i + 4096], least[begin[i : i + 4096]][:, None]
        left = a + (hashes[a[:, None] + inside] == own).argmax(axis=1)
        right = z + _WIDE - 1 - (hashes[z[:, None] + inside[::-1]] == own).argmax(axis=1)
        twice[i : i + 4096] = left != right
    return row[first], begin - offsets[row[first]], n, least[begin].view(np.int64), content.view(np.int64), twice


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ids, t = batch.column("doc_id"), batch.column("t")
    for first, _, data, offsets in text_blocks(batch.column("text")):
        row, start, n, anchor, content, twice = passages(data, offsets)
        take = pa.array(first + row)
        yield pa.RecordBatch.from_arrays(
            [ids.take(take), t.take(take), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor), pa.array(content), pa.array(twice)],
            names=["doc_id", "t", "start", "n", "anchor", "content", "twice"],
        )


def _pack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    texts = [press.compress((x or "").encode()) for x in batch.column("text").to_pylist()]
    yield pa.RecordBatch.from_arrays([*batch.select(["doc_id", "t", "no_id"]).columns, pa.array(texts, pa.binary())], names=["doc_id", "t", "no_id", "packed"])


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The bytes of each chosen passage."""
    out: dict[str, list] = {k: [] for k in ("anchor", "content", "n", "many", "parts", "bytes")}
    open_ = zstandard.ZstdDecompressor()
    for packed, chosen in zip(batch.column("packed").to_pylist(), batch.column("chosen").to_pylist(), strict=True):
        text = open_.decompress(packed)
        for c in chosen:
            for k in ("anchor", "content", "n", "many", "parts"):
                out[k].append(c[k])
            out["bytes"].append(text[c["start"] : c["start"] + c["n"] + LENGTH - 1])
    kinds = {"anchor": pa.int64(), "content": pa.int64(), "n": pa.int32(), "many": pa.bool_(), "parts": pa.int32(), "bytes": pa.binary()}
    yield pa.RecordBatch.from_arrays([pa.array(out[k], kinds[k]) for k in kinds], names=list(kinds))


class RunIndex:
    """Suffix order of passages, reduced to the runs of its Burrows-Wheeler transform.

    Only the first place of each run is kept: its text position, the text position before it in suffix order and
    how far the two agree. Every passage ends in a mark of its own, smaller than any byte, in passage order.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        n, sizes = len(data), np.diff(np.append([0], ends))
        self.n, at = n, np.arange(n)
        left = (np.repeat(ends, sizes) - at).astype(np.int32)
        seen = np.zeros(256, dtype=bool)
        seen[data] = True
        code = np.cumsum(seen)
        bits = int(code[-1]).bit_length()
        depth = _KEY_BITS // bits
        chars = np.zeros(n + depth, dtype=np.int64)
        chars[:n] = code[data]
        key = np.zeros(n, dtype=np.int64)
        for j in range(depth):
            key = (key << bits) | np.where(left > j, chars[j : j + n], 0)
        width = n.bit_length()
        ways, ranks = _KEY_BITS // width, []
        while True:  # each round ranks the suffixes by ``ways`` times as many bytes
            order = np.argsort(key)
            fresh = np.append([True], key[order[1:]] != key[order[:-1]])
            rank = np.zeros(n + 1, dtype=np.int32)
            rank[order] = np.cumsum(fresh, dtype=np.int32)
            ranks.append((depth, rank))
            if depth >= sizes.max():
                break
            key = rank[:n].astype(np.int64)
            for w in range(1, ways):
                key <<= width
                m = max(0, n - w * depth)
                key[:m] |= np.where(left[:m] > w * depth, rank[n - m : n], 0)
            depth *= ways
        tied = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))  # equal to their passages' ends, so in passage order
        order[tied] = order[tied][np.lexsort((order[tied], rank[order[tied]]))]
        start = np.zeros(n, dtype=bool)
        start[0] = True
        start[ends[:-1]] = True
        before = np.where(start[order], 0, chars[order - 1])  # 0 is the mark before a passage: a run of its own each
        head = np.flatnonzero(np.append([True], (before[1:] != before[:-1]) | (before[1:] == 0)))
        self.position, self.previous = order[head], np.where(head > 0, order[head - 1], -1)
        by_position = np.argsort(self.position)
        self.position, self.previous = self.position[by_position], self.previous[by_position]
        self.agree = self._agreement(ranks, ways, chars, left)

    def _agreement(self, ranks: list[tuple[int, np.ndarray]], ways: int, chars: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at a run's first place and at the place before have in common."""
        i, j = self.position, np.maximum(self.previous, 0)
        most = np.where(self.previous >= 0, np.minimum(left[i], left[j]), 0)
        same = np.zeros(len(i), dtype=np.int64)
        steps = [(depth, rank) for depth, rank in reversed(ranks) for _ in range(ways - 1)] + [(1, chars)] * (ranks[0][0] - 1)
        for depth, rank in steps:
            equal = (same < most) & (rank[np.minimum(i + same, self.n)] == rank[np.minimum(j + same, self.n)])
            same[equal] += depth
        return np.minimum(same, most)

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each text position in turn: how far it agrees with the position before it in suffix order, and which that is.

        Within a run both follow from the last sample passed: each further position agrees one byte less.
        """
        last = np.repeat(np.arange(len(self.position)), np.diff(np.append(self.position, self.n)))
        gone = np.arange(self.n) - self.position[last]
        return np.maximum(self.agree[last] - gone, 0), self.previous[last] + gone

    def repeated(self) -> np.ndarray:
        """Whether the LENGTH bytes from each position start anywhere else."""
        agree, other = self.statistics()
        long_enough = agree >= LENGTH
        out = long_enough.copy()
        out[other[long_enough]] = True
        return out


def _ranges(flags: np.ndarray) -> list[int]:
    """First and past-last places of runs of true flags, one after another."""
    padded = np.concatenate([[0], flags.astype(np.int8), [0]])
    return np.flatnonzero(np.diff(padded)).tolist()


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of the passages of a partition sorted by anchor.

    A passage that occurs twice or more is wholly repeated; where it is its anchor's only one, an index has nothing to add.
    """
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32())]
    for rows in sorted_groups(batches, ["anchor"]):
        key = rows.column("anchor").to_numpy()
        texts, many = rows.column("bytes").to_pylist(), rows.column("many").to_pylist()
        content, n = rows.column("content").to_pylist(), rows.column("n").to_pylist()
        bounds, size = group_bounds(key), 0
        out: list[tuple] = []
        part: list[int] = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a == 1 and many[a]:
                out.append((int(key[a]), content[a], n[a], [0, n[a]]))
            else:
                part += range(a, b)
                size += sum(map(len, texts[a:b]))
            if not part or size < INDEX_BYTES and b < len(key):
                continue
            ends = np.cumsum([len(texts[i]) for i in part])
            flags = RunIndex(np.frombuffer(b"".join(texts[i] for i in part), dtype=np.uint8), ends).repeated()
            for i, end in zip(part, ends, strict=True):
                begin = end - len(texts[i])
                own = flags[begin : begin + n[i]] | many[i]
                if own.any():
                    out.append((int(key[i]), content[i], n[i], _ranges(own)))
            part, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=["anchor", "content", "n", "ranges"])


def _strings(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The strings of LENGTH bytes of crowded anchors' passages, as two hashes: one row for a passage and each part its strings fall in."""
    anchor, content, n, many, parts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "content", "n", "many", "parts"))
    packed = batch.column("bytes")
    for first in range(0, len(n), 512):
        of, part, sizes, lists = [], [], [], []
        for i in range(first, min(first + 512, len(n))):
            data, at, hashes = np.frombuffer(packed[i].as_buffer(), dtype=np.uint8), np.arange(n[i]), []
            for seed in (808, 909):
                sums, back = prefix_hashes(data, constants(256, seed))
                hashes.append(mix((sums[at + LENGTH] - sums[at]) * back[at]))
            own = (hashes[0] % np.uint64(parts[i])).astype(np.int32)
            order = np.argsort(own, kind="stable")
            bounds = group_bounds(own[order])
            of.append(np.full(len(bounds) - 1, i))
            part.append(own[order][bounds[:-1]])
            sizes.append(np.diff(bounds))
            lists.append((at[order].astype(np.int32), *(h[order].view(np.int64) for h in hashes)))
        row, offsets = np.concatenate(of), pa.array(np.cumsum(np.concatenate([[0], *sizes])), pa.int32())
        columns = [anchor[row], content[row], n[row], many[row], np.concatenate(part)]
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in zip(*lists, strict=True)]
        yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), *lists], names=["anchor", "content", "n", "many", "part", "at", "x", "y"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of the passages of a partition sorted by anchor and part: which of the strings in the part are there twice or more."""
    for rows in sorted_groups(batches, ["anchor", "part"]):
        rows = rows.combine_chunks()
        at, x, y = (rows.column(c).combine_chunks().flatten().to_numpy() for c in ("at", "x", "y"))
        row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows.column("at")).to_numpy())
        order = np.lexsort((y, x))
        bounds = group_bounds(x[order], y[order])
        found = rows.column("many").to_numpy()[row]
        found[order] |= np.repeat(np.diff(bounds) > 1, np.diff(bounds))
        kept = np.bincount(row[found], minlength=rows.num_rows)
        marked_rows = np.flatnonzero(kept)
        ranges = np.stack([at[found], at[found] + 1], axis=1).ravel()
        offsets = pa.array(np.append(0, 2 * np.cumsum(kept[marked_rows])), pa.int32())
        own = rows.select(["anchor", "content", "n"]).take(pa.array(marked_rows)).combine_chunks()
        yield pa.RecordBatch.from_arrays(
            [*(c.combine_chunks() for c in own.columns), pa.ListArray.from_arrays(offsets, pa.array(ranges, pa.int32()))], names=["anchor", "content", "n", "ranges"]
        )


def merged(starts: list[tuple[int, int]]) -> list[list[int]]:
    """Byte ranges covered by the strings that start in the given ranges, in order and apart."""
    out: list[list[int]] = []
    for a, b in sorted(starts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + LENGTH - 1)
        else:
            out.append([a, b + LENGTH - 1])
    return out


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, t, no_id, packed, marks) of each row of ``docs`` (doc_id, t, text): marks are the repeated strings' starts.

    Rows are joined by id and text hash; a row without an id (no_id) has a second hash of its text as doc_id.
    """
    docs = docs.select(F.coalesce("doc_id", F.xxhash64("text")).alias("doc_id"), "t", F.col("doc_id").isNull().alias("no_id"), "text")
    runs = docs.mapInArrow(over_batches(_runs), _RUN)
    again = runs.groupBy("anchor").agg(F.count("*").alias("c"), F.max("twice").alias("twice")).where("c > 1 or twice").select("anchor")
    held = saved(runs.drop("twice").join(again, "anchor"), "passages")
    kinds = held.groupBy("anchor", "content", "n").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "t", "start")).alias("of"))
    crowds = kinds.groupBy("anchor").agg(F.ceil(F.count("*") / MOST_PASSAGES).cast("int").alias("parts"))
    chosen = kinds.join(crowds, "anchor").select("of.*", F.struct(F.col("of.start").alias("start"), "anchor", "content", "n", (F.col("c") > 1).alias("many"), "parts").alias("one"))
    chosen = chosen.groupBy("doc_id", "t").agg(F.collect_list("one").alias("chosen"))  # at most a document's own passages
    packed = docs.mapInArrow(over_batches(_pack), "doc_id long, t int, no_id boolean, packed binary")
    once = packed.join(chosen, ["doc_id", "t"])
    cut = saved(once.mapInArrow(over_batches(_cut), "anchor long, content long, n int, many boolean, parts int, bytes binary").dropDuplicates(["anchor", "content", "n"]), "bytes")
    calm = cut.where("parts = 1").repartition("anchor").sortWithinPartitions("anchor", "content", "n")
    marks = calm.mapInArrow(_index, _MARKS)
    strings = cut.where("parts > 1").mapInArrow(over_batches(_strings), "anchor long, content long, n int, many boolean, part int, at array<int>, x array<long>, y array<long>")
    single = strings.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(_counted, _MARKS)
    single = single.groupBy("anchor", "content", "n").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))  # at most a passage's own strings
    marks = saved(marks.unionByName(single), "marks")
    found = held.join(marks, ["anchor", "content", "n"]).select("doc_id", "t", F.struct("start", "ranges").alias("mark"))
    found = found.groupBy("doc_id", "t").agg(F.collect_list("mark").alias("marks"))  # at most a document's own passages
    return packed.join(found, ["doc_id", "t"], "left")


def _digest(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    open_ = zstandard.ZstdDecompressor()
    for packed, marks in zip(batch.column("packed").to_pylist(), batch.column("marks").to_pylist(), strict=True):
        text = open_.decompress(packed)
        spans = merged([(m["start"] + a, m["start"] + b) for m in marks or () for a, b in zip(m["ranges"][::2], m["ranges"][1::2], strict=True)])
        rest, last = hashlib.sha256(), 0
        for a, b in spans:
            rest.update(text[last:a])
            last = b
        rest.update(text[last:])
        line = ",".join(f"{a}:{b}" for a, b in spans)
        out.append((len(text), sum(b - a for a, b in spans), len(spans), rest.hexdigest(), line))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    ids = pc.if_else(batch.column("no_id"), pa.scalar(None, pa.int64()), batch.column("doc_id"))
    yield pa.RecordBatch.from_arrays([ids, *(pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds))], names=["doc_id", *names])


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for each row of ``docs``.

    Removed is each byte of the UTF-8 text that a string of LENGTH bytes covers which also starts anywhere else, in the same
    text (overlapping or not) or in another; strings are judged on the input. Null texts count as empty, texts below LENGTH
    bytes lose nothing, and equal rows are copies of each other, so both lose all. Rows without an id are rows like others.

    - Equal strings have equal anchors, so the passages of one anchor are all that has to be compared; anchors that occur
      once, and once in their passage, go before any text moves, and equal passages are one with a mark.
    - Each task indexes the passages of whole anchors: the run-compressed transform with the samples at its runs gives every
      position's agreement with its neighbour in suffix order, and strings of LENGTH bytes or more are marked on both sides.
    - Anchors with over MOST_PASSAGES different passages are not gathered: their strings are dealt by hash to a part for every
      MOST_PASSAGES of them, a passage's strings of one part in one row, and counted there by a 128-bit hash. Passages are told apart by a hash of 64 bits within an anchor of 64.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("t"), F.col("text"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string"
    return marked(docs).mapInArrow(over_batches(_digest), out)
