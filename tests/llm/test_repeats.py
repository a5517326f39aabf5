import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from answerloom.llm import runindex
from answerloom.llm.runindex import RunIndex, repeated_bytes


def brute(rows):
    n, seen = runindex.LENGTH, {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        for s in range(len(b) - n + 1):
            seen[b[s : s + n]] = seen.get(b[s : s + n], 0) + 1
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - n + 1):
            if seen[b[s : s + n]] > 1:
                gone[s : s + n] = b"\1" * n
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [prose(60) for _ in range(4)] + ["ab" * 300, "x" * 900, "\x00" * 210, "\x00" * 300 + "q" * 210]
    texts = [None, "", "short", "y" * 199, "z" * 200, "z" * 200, "w" * 201]
    for _ in range(25):
        text = prose(rng.randrange(5, 200))
        for _ in range(rng.randrange(3)):
            text = text + rng.choice(shared) + prose(rng.randrange(0, 60))
        texts.append(text)
    whole = prose(150)
    for _ in range(8):
        at = rng.randrange(len(whole))
        texts.append(whole[:at] + "#" + whole[at:])
    texts += [whole, whole]
    return list(enumerate(texts))


@pytest.mark.parametrize("most", [1000, 3])
def test_agrees_with_every_string_counted(spark, monkeypatch, most):
    monkeypatch.setattr(runindex, "MOST_PASSAGES", most)
    rows = corpus(5)
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, n int, marks string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_bytes(docs).collect())
    assert got == brute(rows)


def test_repeated_rows_and_ids(spark):
    long = " ".join(f"word{i}" for i in range(80))
    rows = [(1, long), (1, long), (1, long[::-1]), (2, None), (2, None)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("most", [1000, 1])
def test_passages_shared_with_rows_without_an_id(spark, monkeypatch, most):
    monkeypatch.setattr(runindex, "MOST_PASSAGES", most)
    rng = random.Random(6)
    prose = lambda k: " ".join("".join(rng.choice("abcde") for _ in range(6)) for _ in range(k))
    licence, other = prose(80), prose(80)
    texts = [(None, licence), (None, f"{prose(30)} {licence} {prose(40)}"), (None, None), (None, prose(90)), (None, other), (None, other)]
    texts += [(i, f"{prose(40)} {licence} {prose(10 * i)}") for i in range(1, 6)]
    key = lambda r: (str(r[0]), *r[1:])
    numbered = dict(enumerate(texts, 1000))
    want = [(numbered[i][0], *rest) for i, *rest in brute([(i, t) for i, (_, t) in numbered.items()])]
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_bytes(spark.createDataFrame(texts, "doc_id long, text string")).collect()]
    assert sum(r[2] > 0 for r in got) == 9 and sorted(got, key=key) == sorted(want, key=key)


def test_strings_of_crowded_anchors_travel_packed(spark, monkeypatch):
    monkeypatch.setattr(runindex, "MOST_PASSAGES", 10)
    rng = random.Random(9)
    prose = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    licence, tail = prose(150), prose(60)
    texts = [f"{prose(120)}{licence}{tail if i % 3 else prose(60)}{prose(80)}" for i in range(60)] + ["k" * 450, licence * 3]
    made = []
    batch = pa.table({"anchor": [1, 1], "content": [5, 6], "n": pa.array([101, 1], pa.int32()), "many": [False, True], "parts": pa.array([6, 6], pa.int32()), "bytes": [texts[0][:300].encode(), b"k" * 200]})
    for rows in runindex._strings(batch.to_batches()[0]):
        made += rows.to_pylist()
    assert [len(r["at"]) for r in made if r["content"] == 6] == [1] and sum(r["content"] == 5 for r in made) <= 6
    assert sorted(a for r in made if r["content"] == 5 for a in r["at"]) == list(range(101))
    assert all(r["x"][k] % 2**64 % 6 == r["part"] for r in made for k in range(len(r["x"])))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_bytes(docs.repartition(3)).collect())
    assert got == brute(rows) and sum(r[2] > 0 for r in got) > 30


def test_empty_table(spark):
    assert repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_index_keeps_a_sample_a_run_and_finds_all():
    rng = random.Random(2)
    base = bytes(rng.randrange(97, 101) for _ in range(330))
    parts = [base, base[:150] + b"!" + base[150:], base[20:300], bytes(rng.randrange(97, 101) for _ in range(300)), b"a" * 250]
    data, ends = np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum([len(p) for p in parts])
    index = RunIndex(data, ends)
    assert len(index.position) < len(data)
    seen, at, want = {}, 0, np.zeros(len(data), dtype=bool)
    for p in parts:
        for s in range(len(p) - runindex.LENGTH + 1):
            seen.setdefault(p[s : s + runindex.LENGTH], []).append(at + s)
        at += len(p)
    for places in seen.values():
        if len(places) > 1:
            want[places] = True
    assert (index.repeated() == want).all()
