"""Toxic spans and scores: a linear-chain conditional random field over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from answerloom.llm.common import SPACE, Words, constants, fold, mix, over_batches, text_blocks

#: Labelled texts that are learned from: so many toxic ones and so many others, the first by a hash of the id.
TOXIC_TEXTS, CLEAN_TEXTS = 800, 1200
#: A word's features are itself and its first 3 to 7 bytes, hashed to a table of 2 ** TABLE_BITS weights.
PREFIXES, TABLE_BITS = (3, 4, 5, 6, 7), 18
#: A feature names toxic words when it is in at least so many toxic texts and, of all texts that have it, this part is toxic.
SEED_TEXTS, SEED_PART = 3, 0.95
#: Words of a piece of text in training, which takes all pieces with a toxic word and as many others; scoring has no pieces.
PIECE = 50
ROUNDS, RATE, SHRINK = 40, 0.25, 1e-3
#: A word is in a span when its marginal is at least this.
SPAN_AT = 0.5
#: predicted is 1 from this score on.
PREDICT_AT = 0.3

#: Letters are bytes that are neither white space nor ASCII punctuation.
_BREAK = SPACE.copy()
_BREAK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


@dataclass(frozen=True)
class Field:
    """``weight`` of each feature and ``bias`` for the toxic state, ``step[a, b]`` from state a to b, and the document's score from its marginals."""

    weight: np.ndarray
    bias: float
    step: np.ndarray
    final: np.ndarray


def features(words: Words) -> np.ndarray:
    """(word, feature) indices; a prefix as long as the word stands for the word."""
    salts = constants(len(PREFIXES) + 1, 606)
    hashes = [words.hash ^ salts[-1], *(words.span(words.start, np.minimum(words.end, words.start + n)) ^ s for n, s in zip(PREFIXES, salts, strict=False))]
    return np.stack([(mix(h) >> np.uint64(64 - TABLE_BITS)).astype(np.int32) for h in hashes], axis=1)


def _order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences from long to short, and how many of them have more than t words, for each t."""
    order = np.argsort(-lengths, kind="stable")
    alive = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), "left") if len(lengths) else np.zeros(0, dtype=int)
    return order, alive


def forward_backward(u: np.ndarray, first: np.ndarray, lengths: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of the toxic state, and forward and backward log odds, of all sequences side by side.

    ``u`` is the log odds of each word by itself; sequence s has words first[s] to first[s] + lengths[s]. With two
    states, the messages are one number: the log odds of the second state. Also returns the log normalizer of each sequence.
    """
    order, alive = _order(lengths)
    at, size = first[order], lengths[order]
    ahead, back = np.zeros(len(u)), np.zeros(len(u))
    total, r = np.zeros(len(first)), None
    for t, n in enumerate(alive):
        here = u[at[:n] + t]
        if r is not None:
            r = r[:n]
            low = np.logaddexp(step[0, 0], r + step[1, 0])
            total[:n] += low
            here = here + np.logaddexp(step[0, 1], r + step[1, 1]) - low
        r = here
        ahead[at[:n] + t] = r
    if len(alive):
        last = size > 0
        total[last] += np.logaddexp(0, ahead[at[last] + size[last] - 1])
    r = np.zeros(0)
    for t in range(len(alive) - 2, -1, -1):
        n = alive[t + 1]
        after = u[at[:n] + t + 1] + np.concatenate([r, np.zeros(n - len(r))])
        r = np.logaddexp(step[1, 0], after + step[1, 1]) - np.logaddexp(step[0, 0], after + step[0, 1])
        back[at[:n] + t] = r
    normal = np.zeros(len(first))
    normal[order] = total
    return 1 / (1 + np.exp(-np.clip(ahead + back, -60, 60))), ahead, back, normal


def document_features(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Columns: one, the largest marginal, and the logarithm of their sum plus one."""
    top, total = np.zeros(n), np.bincount(doc, weights=p, minlength=n)
    np.maximum.at(top, doc, p)
    return np.stack([np.ones(n), top, np.log1p(total)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge-regularized logistic regression, by Newton's method."""
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [0.05] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
    return w


def _pieces(f: np.ndarray, doc: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, tags and first words of the pieces to learn from."""
    place = np.arange(len(doc)) - np.searchsorted(doc, doc)
    begins = np.flatnonzero(place % PIECE == 0)
    piece = np.cumsum(place % PIECE == 0) - 1
    toxic = np.bincount(piece, weights=tag, minlength=len(begins)) > 0
    others = np.flatnonzero(~toxic)
    keep = toxic.copy()
    keep[others[np.argsort(mix(others.astype(np.uint64)))[: max(200, int(toxic.sum()))]]] = True
    rows = keep[piece]
    own = piece[rows]
    return f[rows], tag[rows], np.flatnonzero(np.append([True], own[1:] != own[:-1]))


def _descend(f: np.ndarray, tag: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and transitions by gradient steps with momentum and scaling."""
    lengths, inner, t = np.diff(np.append(begins, len(tag))), np.ones(len(tag), dtype=bool), tag.astype(int)
    inner[begins] = False
    pairs = np.flatnonzero(inner)
    seen_steps = np.bincount(t[pairs - 1] * 2 + t[pairs], minlength=4).reshape(2, 2).astype(float)
    used, slot = np.unique(f, return_inverse=True)
    slot, many = slot.reshape(f.shape), max(1.0, tag.sum())
    w, bias, step = np.zeros(len(used)), -3.0, np.zeros((2, 2))
    m1, m2 = (np.zeros(len(used) + 5) for _ in range(2))
    for i in range(1, ROUNDS + 1):
        u = w[slot].sum(axis=1) + bias
        p, ahead, back, _ = forward_backward(u, begins, lengths, step)
        left, right = ahead[pairs - 1], u[pairs] + back[pairs]
        joint = np.stack([np.full(len(pairs), step[0, 0]), right + step[0, 1], left + step[1, 0], left + right + step[1, 1]], axis=1)
        joint = np.exp(joint - joint.max(axis=1, keepdims=True))
        joint = (joint / joint.sum(axis=1, keepdims=True)).sum(axis=0).reshape(2, 2)
        gap = p - tag
        g = np.bincount(slot.ravel(), weights=np.repeat(gap, f.shape[1]), minlength=len(used))
        g = np.concatenate([g / many + SHRINK * w, [gap.sum() / many], ((joint - seen_steps) / many + SHRINK * step).ravel()])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        move = RATE * (m1 / (1 - 0.9**i)) / (np.sqrt(m2 / (1 - 0.99**i)) + 1e-8)
        w, bias, step = w - move[: len(used)], bias - move[len(used)], step - move[len(used) + 1 :].reshape(2, 2)
    weight = np.zeros(1 << TABLE_BITS, dtype=np.float32)
    weight[used] = w
    return weight, float(bias), step


def fit(texts: list[str], toxic: np.ndarray) -> Field:
    """A field learned from whole texts and their labels.

    Token labels come from the text labels: a word of a toxic text is toxic when a feature of it occurs in
    SEED_TEXTS toxic texts or more and hardly in others. The field is then fitted to the tagged words by the
    gradient of the conditional likelihood (expected minus observed counts from forward-backward).
    """
    none = Field(np.zeros(1 << TABLE_BITS, dtype=np.float32), -6.0, np.zeros((2, 2)), np.array([-4.0, 0.0, 0.0]))
    if not len(texts) or toxic.min() == toxic.max():
        return none
    parts, docs, texts_with = [], [], np.zeros((2, 1 << TABLE_BITS))
    for first, _, data, offsets in text_blocks(pa.array(texts, pa.string()), 1 << 19):
        words = Words(data, offsets, also=_BREAK)
        f, doc = features(words), words.doc + first
        parts.append(f)
        docs.append(doc.astype(np.int32))
        for label in (0, 1):
            rows = toxic[doc] == label
            seen = np.unique((doc[rows][:, None] << TABLE_BITS) + f[rows])
            texts_with[label] += np.bincount(seen & ((1 << TABLE_BITS) - 1), minlength=1 << TABLE_BITS)
    f, doc = np.concatenate(parts), np.concatenate(docs)
    del parts, docs
    if not len(f):
        return none
    rate = texts_with / np.maximum(1, np.array([(toxic == 0).sum(), (toxic == 1).sum()]))[:, None]
    seed = (texts_with[1] >= SEED_TEXTS) & (rate[1] >= SEED_PART * (rate[0] + rate[1]))
    tag = ((toxic[doc] == 1) & seed[f].any(axis=1)).astype(float)

    weight, bias, step = _descend(*_pieces(f, doc, tag))
    ends = np.searchsorted(doc, np.arange(len(texts) + 1))
    p, *_ = forward_backward(weight[f].sum(axis=1, dtype=np.float64) + bias, ends[:-1], np.diff(ends), step)
    return Field(weight, bias, step, _logistic(document_features(p, doc, len(texts)), toxic.astype(float)))


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """A field from the rows of ``docs`` that ``labels`` marks, outside fold 2.

    At most TOXIC_TEXTS and CLEAN_TEXTS texts come to the driver, the first by a hash of the id. Null labels and
    null texts teach nothing; of repeated labels of a document the largest counts.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.where(fold(F.col("doc_id")) != 2).withColumn("h", F.xxhash64("doc_id"))
    chosen = [known.where(F.col("toxic") == v).orderBy("h", "doc_id").limit(n) for v, n in ((1, TOXIC_TEXTS), (0, CLEAN_TEXTS))]
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    sample = rows.select("h", "doc_id", "text", "toxic").toPandas().sort_values(["h", "doc_id", "text"])
    return fit(list(sample["text"]), sample["toxic"].to_numpy().astype(int))


def tag(docs: DataFrame, field: Field, col: str = "text") -> DataFrame:
    """``docs`` with ``score``, ``n_toxic_words`` and ``toxic_spans`` (start:end in code points, comma-joined).

    The marginals of a text's words give its score; runs of words whose marginal is at least SPAN_AT are its
    spans. Null and empty texts have the score of no toxic word at all. Rows are independent; columns of these
    names are replaced, all others kept. No text is cut.
    """
    new = ("score", "n_toxic_words", "toxic_spans")
    out = [f for f in docs.schema.fields if f.name not in new]

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        u, doc, start, end = [np.zeros(0)], [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0, int)]
        for first, _, data, offsets in text_blocks(batch.column(col)):
            words = Words(data, offsets, also=_BREAK)
            odds = field.weight[features(words)].sum(axis=1, dtype=np.float64) + field.bias
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            u.append(odds)
            doc.append(words.doc + first)
            start.append(points[words.start] - points[offsets[words.doc]])
            end.append(points[words.end] - points[offsets[words.doc]])
        u, doc, start, end = (np.concatenate(x) for x in (u, doc, start, end))
        n = batch.num_rows
        bounds = np.searchsorted(doc, np.arange(n + 1))
        p, *_ = forward_backward(u, bounds[:-1], np.diff(bounds), field.step)
        score = 1 / (1 + np.exp(-np.clip(document_features(p, doc, n) @ field.final, -40, 40)))
        at = np.flatnonzero(p >= SPAN_AT)
        spans: list[list[list[int]]] = [[] for _ in range(n)]
        last = -2
        for i in at:
            own = spans[doc[i]]
            if own and i == last + 1:
                own[-1][1] = int(end[i])
            else:
                own.append([int(start[i]), int(end[i])])
            last = i
        joined = [",".join(f"{a}:{b}" for a, b in x) for x in spans]
        columns = [batch.column(f.name) for f in out]
        hits = np.bincount(doc[at], minlength=n)
        yield pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.array(hits.astype(np.int64)), pa.array(joined, pa.string())], names=[*(f.name for f in out), *new])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in out]
    return docs.mapInArrow(over_batches(work, col), ", ".join([*fields, "score double, n_toxic_words long, toxic_spans string"]))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_toxic_words, toxic_spans) for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = tag(docs, train(docs, labels)).withColumn("held_out", fold(F.col("doc_id")) == 2)
    return rows.select("doc_id", "held_out", "score", F.when(F.col("score") >= PREDICT_AT, 1).otherwise(0).alias("predicted"), "n_toxic_words", "toxic_spans")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted not to be toxic, with the columns of ``docs``."""
    own, names = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), docs.columns
    rows = docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(names)))
    rows = tag(rows, train(own, labels), f"_{names.index('text')}").where(F.col("score") < PREDICT_AT)
    return rows.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(names)))
