"""Decontamination and the pipeline against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from answerloom.llm import decontaminate
from answerloom.llm.decontaminate import clean, contaminated

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def grams(ws):
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute(docs, items, least=0.8):
    sets = {i: (len(words(t)), grams(words(t))) for i, t in items if words(t)}
    shared = {}
    for _, g in sets.values():
        for s in g:
            shared[s] = shared.get(s, 0) + 1
    weigh = lambda g: sum(max(1, decontaminate.UNIT // shared[s]) if s in shared else decontaminate.UNIT for s in g)
    out = {}
    for d, t in docs:
        ws = words(t)
        for i, (n, g) in sets.items():
            wide = max(1, n - 4)
            runs = [tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))] if ws else []
            best = max((weigh(set(runs[a : a + wide]) & g) / weigh(set(runs[a : a + wide]) | g) for a in range(len(runs))), default=0)
            if best >= least:
                out[d, i] = best
    return out


def corpus(seed=2):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(500)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(prose(rng.randrange(15, 60)))) for i in range(30)] + [(30, None), (31, ""), (32, "only three words"), (33, "One two three four five")]
    items += [(34, items[0][1]), (35, items[1][1] + " " + " ".join(prose(20)))]
    docs = [(0, None), (1, ""), (2, "a b"), (3, "x ONLY three words y"), (4, "Only three\nwords"), (5, "zero one two three four five six")]
    for d in range(6, 80):
        text = prose(rng.randrange(0, 200))
        for _ in range(rng.randrange(0, 3)):
            item = items[rng.randrange(30)][1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                item[rng.randrange(len(item))] = rng.choice(vocabulary)
            item = item[rng.choice([0, 0, 1, 3]) :]
            at = rng.randrange(len(text) + 1)
            text[at:at] = [w.upper() for w in item]
        docs.append((d, " ".join(text)))
    docs.append((80, items[2][1].rsplit(" ", 2)[0]))
    return docs, items


def test_finds_what_all_windows_find(spark, monkeypatch):
    docs, items = corpus()
    want = brute(docs, items)
    monkeypatch.setattr(decontaminate, "PASS_ITEMS", 1000)
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, leaks int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(frame, bench).collect()}
    assert len(want) > 30 and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    kept = clean(frame, bench)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == sorted({d for d, _ in docs} - {d for d, _ in want})


def test_items_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASS_ITEMS", 9)
    docs, items = corpus(5)
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(frame, bench).collect()}
    exact = {(d, i) for d, t in docs for i, x in items if len(words(x)) >= 5 and " ".join(words(x)) in " ".join(words(t))}
    assert exact <= got


def test_near_copies_of_items_that_share_shingles(spark, monkeypatch):
    rng = random.Random(8)
    prose = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    rows, twice, often, template = prose(60), prose(60), prose(60), prose(50)
    items = [(1, " ".join(rows))] * 5 + [(i, " ".join(twice)) for i in (2, 3)] + [(i, " ".join(often)) for i in range(10, 26)]
    items += [(i, " ".join(template + prose(10))) for i in range(30, 46)]
    filled = items[-1][1].split()
    docs = []
    for d, item in enumerate((rows, twice, often, filled)):
        copy = list(item)
        copy[30 if item is not filled else 55] = "changed"
        docs.append((d, " ".join(prose(40) + copy + prose(40))))
    bench, frame = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    want = {(0, 1), (1, 2), (1, 3)} | {(2, i) for i in range(10, 26)} | {(3, 45)}
    seen = set()
    for n in (1000, 20, 8):
        monkeypatch.setattr(decontaminate, "PASS_ITEMS", n)
        found = contaminated(frame, bench).collect()
        assert len(found) == len(want) and {(r.doc_id, r.item_id) for r in found} == want
        seen.add(tuple(sorted((tuple(r) for r in found))))
        assert clean(frame, bench).count() == 0
    assert len(seen) == 1


def test_empty_tables_and_repeats(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (1, "one two three four five"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(docs, none).collect() == [] and clean(docs, none).count() == 3
    items = spark.createDataFrame([(1, "one two three four five"), (None, "x")], "item_id long, text string")
    assert len(contaminated(docs, items).collect()) == 2 and clean(docs, items).count() == 1
    assert contaminated(docs.limit(0), items).collect() == []


SF = "/root/testdata/sf0.001"


def test_pipeline_stage_by_stage(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    columns = docs.columns
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    labels = {r.doc_id: r.toxic for r in corpus_pipeline.table(spark, SF, "labels").collect()}
    items = [(r.item_id, r.text) for r in corpus_pipeline.table(spark, SF, "benchmark").collect()]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.saved(stage(spark, before, SF), "test")
        old, new = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in after.collect()}
        if name != "source_mix":
            assert after.columns == columns
            assert set(new) <= set(old)
        if name == "toxicity":
            gone = set(old) - set(new)
            assert gone and sum(labels.get(i, 1) for i in gone) >= 0.8 * len(gone)
        if name == "near_duplicates":
            sets = {i: grams(words(r.text)) for i, r in old.items()}
            links = [(a, b) for a in old for b in old if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[b]]
            up = {i: i for i in old}
            for _ in old:
                for a, b in links:
                    up[a] = up[b] = min(up[a], up[b])
            assert set(new) == {i for i in old if up[i] == i}
        if name == "benchmark_decontamination":
            assert set(old) - set(new) == {d for d, _ in brute([(i, r.text) for i, r in old.items()], items)}
        if name == "personal_data":
            assert set(new) == set(old) and all(r.n_chars == len(r.text) for r in new.values())
            assert not any(re.search(r"[a-z0-9]@mail\d", r.text) for r in new.values())
        if name == "source_mix":
            assert all(r.taken > 0 and r.taken <= 2 * r.size for r in new.values())
        before = after
    assert corpus_pipeline.ORACLE_SQL is None
    ran = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, ran.collect())) == sorted(map(str, before.collect()))


def test_stages_on_an_empty_table_and_repeated_rows(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    twice = docs.limit(3).union(docs.limit(3))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        n = stage(spark, twice, SF).count()
        assert n <= 6, name


def test_mix_keeps_further_columns(spark):
    docs = corpus_pipeline.table(spark, SF, "documents").withColumns({"extra": F.length("text"), "size": F.lit("x"), "place": F.lit(1)})
    got = corpus_pipeline.mixed(spark, docs, SF)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra", "place", "size", "taken", "position", "epochs"]
    assert got.where("extra <> length(text)").count() == 0 < got.count()
