"""Set join, hard negatives and ranked search against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from answerloom.llm import blocks, maxscore, negatives, setjoin
from answerloom.llm.maxscore import Searcher, Work, build_index, search
from answerloom.llm.negatives import _wide_scores, hard_negatives, packed_scores
from answerloom.llm.setjoin import joined, skipping_pairs
from test_near_duplicates import brute, corpus


# --- set join ---------------------------------------------------------------------------------------------------
def crowds():
    """Template crowds: one linked through its base, one of copies too far from each other, one with few links inside."""
    rng, texts = random.Random(11), []
    for size, edits, base in ((40, 2, True), (40, 3, False), (40, 4, False)):
        words = [f"t{rng.randrange(10**6)}" for _ in range(100)]
        texts += [" ".join(words)] * base
        for _ in range(size):
            copy = list(words)
            for at in rng.sample(range(100), edits):
                copy[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
        passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(30))
        texts += [passage + " " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(rng.randrange(4))) for _ in range(20)]
    rng.shuffle(texts)
    return list(enumerate(texts, 1))


@pytest.mark.parametrize("least, levels", [(8, 8), (2, 0)])
def test_join_agrees_with_all_pairs(spark, monkeypatch, least, levels):
    sent, confirmed = [], setjoin._Join.confirmed
    monkeypatch.setattr(setjoin._Join, "confirmed", lambda self, p, held: sent.append(p.count()) or confirmed(self, p, held))
    monkeypatch.setattr(setjoin, "LIST", least)
    monkeypatch.setattr(setjoin, "LATER", least)
    monkeypatch.setattr(setjoin, "LEVELS", levels)
    monkeypatch.setattr(setjoin, "HOT_LEAST", 12)  # shingles of the crowds are dealt by set
    rows = crowds() if levels else corpus()
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, component_id string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in joined(docs).collect()}
    assert got == {i: v[:2] for i, v in brute(rows, 80).items()}
    assert sum(sent) < 4 * len(rows) or not levels  # no crowd's pairs are sent


def test_join_of_odd_rows(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(3, a), (None, a), (None, b), (5, None), (6, " \n"), (7, "one"), (7, "ONE"), (7, b + " more"), (None, None)]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in joined(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("3", 56, "3"), ("None", 56, "3"), ("None", 56, "7"), ("5", 0, "5"), ("6", 0, "6"), ("7", 1, "7"), ("7", 1, "7"), ("7", 57, "7"), ("None", 0, "None")])
    assert joined(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_walk_skips_blocks_and_loses_no_pair():
    rng = np.random.default_rng(5)
    n = np.sort(rng.integers(20, 60, 400))
    pos = rng.integers(0, 20, 400)
    order = np.lexsort((pos, n))
    n, pos, one = n[order], pos[order], np.zeros(400, dtype=int)
    for part in (np.arange(400), np.where(rng.random(400) < 0.8, 400, np.arange(400))):
        i, j, looks = skipping_pairs(one, n, n, pos, part, part == 400, np.zeros(400, dtype=int), np.zeros((400, 4), dtype=np.uint64), 80)
        may = lambda x, y: 80 * n[y] <= 100 * n[x] and min(n[x] - pos[x], n[y] - pos[y]) >= math.ceil(80 * (n[x] + n[y]) / 180)
        want = {(x, y) for x in range(400) for y in range(x + 1, 400) if part[x] != part[y] and may(x, y)}
        assert {(min(p), max(p)) for p in zip(i.tolist(), j.tolist(), strict=True)} == want and len(i) == len(want) and looks < (part != 400).sum() * 400 / 2


# --- hard negatives ---------------------------------------------------------------------------------------------
def mined(rows, every, k_pos, k_neg):
    ok = [(i, v, y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    fixed = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in ok]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, v, y in fixed:
        if a % every:
            continue
        scored = sorted(((-dot(v, w), i, z == y) for i, w, z in fixed if i != a))
        for s, p, _ in [x for x in scored if x[2]][:k_pos]:
            good = [(i, -t) for t, i, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s][:k_neg]
            out += [(a, p, rank, i, -s, t) for rank, (i, t) in enumerate(good, 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [True, False])
def test_negatives_agree_with_all_pairs(spark, monkeypatch, small):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, 0.25, rng.uniform(-1, 1)]) for _ in range(6)], rng.randrange(3)) for i in range(1, 240)]
    rows += [(300 + i, [0.5] * 6, i % 2) for i in range(30)]  # ties
    rows += [(400, [0.1, None] * 3, 1), (410, [float("nan")] * 6, 1), (420, [float("inf")] * 6, 0), (430, None, 1), (440, [0.5] * 6, None), (None, [0.5] * 6, 1), (450, [0.5, 0.5], 1), (460, [], 0)]
    rows += [(500 + i, [9.0 + i] * 6, 0) for i in range(3)] + [(7, [0.5] * 6, 2), (20, [0.3] * 6, 1)]
    monkeypatch.setattr(negatives, "ROWS", 64)
    monkeypatch.setattr(negatives, "ANCHORS", 5)
    if not small:
        monkeypatch.setattr(blocks, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(negatives, "HELD", 1)
    df = spark.createDataFrame([(i, v, y, 1.5) for i, v, y in rows], "vec_id long, embedding array<double>, label int, score double").repartition(3)
    got = sorted(tuple(r) for r in hard_negatives(df, every=10, positives=3, negatives=4).collect())
    assert got == mined(rows, 10, 3, 4) and len(got) > 50
    assert hard_negatives(df.limit(0)).collect() == []


def test_packed_products_are_exact():
    rng = np.random.default_rng(1)
    for most in (3, 200, 1 << 13, 1 << 20, 1 << 24):
        a, r = (rng.integers(-most, most + 1, (n, 7)).astype(float) for n in (9, 23))
        want = a.astype(np.int64) @ r.astype(np.int64).T
        assert (packed_scores(a, r) == want).all() and (_wide_scores(a, r) == want).all()
    with pytest.raises(OverflowError):
        packed_scores(np.full((1, 4), 2.0**40), np.full((1, 4), 2.0**40))


# --- ranked search ----------------------------------------------------------------------------------------------
def ranked(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_all, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in held:
            m = 25 + (75 * n * n_all) // total
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s:
                found.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(map(str, out))


def texts(seed, n):
    rng = random.Random(seed)
    words = [f"W{int(rng.paretovariate(0.6))}" for _ in range(3000)] + ["Été", "x_y", "a-b", "naïve", "東京"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 120)))) for i in range(n)]
    docs += [(n + 1, None), (n + 2, ""), (n + 3, "!?"), (None, docs[0][1]), (4, docs[4][1]), (9, docs[3][1]), (n + 4, " ".join(rng.choice(words) for _ in range(30000)))]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for i in range(25)]
    return docs, [*items, (90, None), (91, "zzz"), (92, "w1 W1 w1 w2"), (3, "W2 été")]


@pytest.mark.parametrize("small", [True, False])
def test_search_agrees_with_scoring_all(spark, monkeypatch, small):
    docs, items = texts(1, 400)
    monkeypatch.setattr(maxscore, "SHARD", 3000)
    monkeypatch.setattr(maxscore, "PIECE", 10000)
    monkeypatch.setattr(maxscore, "QUERIES", 7)
    monkeypatch.setattr(maxscore, "HELD", 2)
    if not small:
        monkeypatch.setattr(blocks, "BROADCAST_BYTES", 0)
    frame = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, score double").repartition(2)
    index = build_index(frame)
    assert index.count() > 2
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, term string")
    assert sorted(str(tuple(r)) for r in search(index, asked, 5).collect()) == ranked(docs, items, 5)
    assert search(index, asked.limit(0)).collect() == [] and search(build_index(frame.limit(0)), asked).collect() == []


def test_blocks_are_rejected_unopened(spark):
    docs, items = texts(3, 3000)
    index = build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    row = next(maxscore._plain(b, 0) for b in index.toArrow().to_batches())
    shard, work = Searcher(row, row["n_docs"], row["n_terms"]), Work()
    shard.work = work
    rng = np.random.default_rng(0)
    dfs = row["dfs"]
    for _ in range(40):  # a rare term among common ones
        at = np.append(rng.choice(np.flatnonzero(dfs > 300), 4, replace=False), rng.choice(np.flatnonzero(dfs < 100)))
        weight = np.floor(1000 * np.log((2 * row["n_docs"] + 2) / (2 * dfs[at] + 1))).astype(np.int64)
        shard.top(shard.terms[at], weight, 3)
    assert 0 < work.opened < 0.9 * work.asked


def test_block_bytes_round_trip():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 1 << rng.integers(1, 31, 500))
    width = maxscore._widths(values)
    data = np.frombuffer(maxscore._packed(values, width), dtype=np.uint8)
    assert (maxscore._unpacked(data, np.cumsum(width) - width, width) == values).all()
