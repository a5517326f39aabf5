import random
import re

from answerloom.llm.oddsketch import near_duplicates, survivors
from answerloom.llm.components import components


def brute(rows, percent=85):
    sets, ids = {}, [r[0] for r in rows]
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \t\n", "one", "ONE", "one two", "One Two", "a b c d", "a b c d e", "A b c d e ", "é b c d e", "É b c d e"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(20, 300))]
        texts += [" ".join(base)] * rng.randrange(1, 4)
        for _ in range(rng.randrange(0, 25)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return list(enumerate(texts, 1))


def test_agrees_with_all_pairs(spark, monkeypatch):
    from answerloom.llm import oddsketch

    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, component_id string, n_shingles int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert got == brute(rows)
    monkeypatch.setattr(oddsketch, "TILE", 3)  # many tiles to a bucket
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()} == brute(rows)


def test_ids_that_repeat_or_are_missing(spark):
    rng = random.Random(5)
    base = {k: [f"{k}{rng.randrange(10**6)}" for _ in range(100)] for k in "abcdefg"}
    text = lambda k, at=None: " ".join(w if i != at else "changed" for i, w in enumerate(base[k]))
    rows = [(7, text("a")), (7, text("b")), (7, text("c")), (8, text("b", 40)), (9, text("c", 0)), (5, text("a", 50)), (7, ""), (7, text("g")), (7, text("g"))]
    rows += [(None, text("d")), (None, text("d", 60)), (None, text("e")), (None, text("e", 20)), (6, text("e", 70)), (None, text("f")), (None, ""), (None, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    found = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_duplicates(docs).collect())
    want = [(7, 5, False), (7, 7, True), (7, 7, True), (8, 7, False), (9, 7, False), (5, 5, True), (7, 7, True), (7, 7, True), (7, 7, True)]
    want += [(None, None, True), (None, None, True), (None, 6, False), (None, 6, False), (6, 6, True), (None, None, True)] + [(None, None, True)] * 3
    assert found == sorted((str(a), str(b), k) for a, b, k in want)
    left = survivors(docs)
    assert left.columns == docs.columns
    stay = sorted((str(r.doc_id), str(r.text)) for r in left.collect())
    d = [t for i, t in rows if i is None and t and t.startswith("d")]
    sure = [(5, text("a", 50)), (7, text("b")), (7, text("c")), (7, ""), (7, text("g")), (6, text("e", 70)), (None, text("f")), (None, ""), (None, ""), (None, None)]
    assert any(stay == sorted((str(i), str(t)) for i, t in [*sure, (None, x)]) for x in d)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_path_and_a_star(spark):
    rng = random.Random(1)
    ids = list(range(1, 60))
    rng.shuffle(ids)
    links = list(zip(ids, ids[1:], strict=False)) + [(100, 200 + i) for i in range(30)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in ids) and all(got[200 + i] == 100 for i in range(30))
