"""PII, line cleaning and source mixing against plain Python."""

import hashlib
import random
import re
from collections import Counter

import pytest

from answerloom.llm import cleaning, curriculum, pii
from answerloom.llm.cleaning import judged, measure

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def holds(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return kind != "phone" or 9 <= len(d) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in p.finditer(text or "") if holds(k, m.group())]


TEXTS = [
    None, "", " ", "no data here", "a@b.c_d@e.f x@y.z.", "@a.b a@.b a@b a@@b.c.d é.x@é.de ü+1%@Ab-C.d.e.",
    "1.2.3.4.5.6.7.8 999.1.2.3.4 1.2.3.256 0000.00.255.0255 1.2.3 12345678901.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 4111  1111", "card 5500005555555559 ééé 5500005555555559",
    "+1 (506) 555-5534 +49 30 1234567. +1 + 1 +12 +1234567890123456 call +1.2.3.4.5.6.7.8.9",
    "IBAN DE89370400440532013000 and GB82 WEST 1234 5698 7654 32 or DE89370400440532013001", "ssn 123-45-6789 or 123-45-6789; tel 212-555-1234 or (212) 555-1234",
    "1" * 5000 + "." + "2" * 5000, "a" * 20000, "a." * 3000 + "@" + "b." * 3000 + "c", "1 " * 4000, "+" + "1-" * 3000 + "x",
]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    bits = ["@", ".", "+", "-", " ", "(", ")", "1", "22", "333", "4111111111111111", "a", "é", "x.y", "_", "%", ".com", "127.0.0.1", "+1 (506) 555-5534", "\n"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_pii_base_spans(spark):
    rows = list(enumerate(TEXTS + random_texts(400)))
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, pii string, start int")
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    for i, t in rows:
        want = base(t)
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), (t, line, got[i].spans)
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in want) for k in pii.BASE]
        assert got[i].spans.startswith(line)
    added = {i: [x for x in got[i].spans.split(",") if x.split(":")[0] in pii.ADDED] for i, _ in rows}
    assert added[10] == ["iban:5:27", "iban:32:59"]
    assert added[11] == ["ssn:4:15", "local:37:49", "local:53:67"] or added[11][0] == "ssn:4:15"


def test_each_form_of_an_added_kind_alone(spark):
    forms = {
        "local": ["(212) 555-1234", "(212)-555-1234", "(212).555.1234", "(212 555 1234", "212) 555-1234", "212-555-1234", "212.555.1234", "212 555 1234"],
        "ssn": ["123-45-6789"], "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO9386011117947"],
    }
    label = {"local": "phone", "ssn": "ssn", "iban": "iban"}
    rows = [(i, k, f) for i, (k, f) in enumerate((k, f) for k, fs in forms.items() for f in fs)]
    docs = spark.createDataFrame([(i, f"{label[k]} {f}") for i, k, f in rows], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    for i, k, f in rows:
        a = len(label[k]) + 1
        assert f"{k}:{a}:{a + len(f)}" in got[i].split(","), f
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert all(masked[i] == f"{label[k]} {pii.MASK[k]}" for i, k, _ in rows)


def test_added_kinds_in_lists_and_runs_of_words(spark):
    cases = [
        ("ssn 123-45-6789 or 123-45-6789; tel 212-555-1234 or (212) 555-1234", "ssn:4:15,ssn:19:30,local:36:48,local:52:66"),
        ("ssn 000-45-6789, 123-45-6789", "ssn:17:28"), ("tel 212-555-1234 or 212-555-9876", "local:4:16,local:20:32"),
        ("tel " + "x" * 40 + " 212-555-9876", ""), ("tel 212-555-1234 " + "x" * 40 + " 212-555-9876", "local:4:16"),
        ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "iban:5:32"), ("DE89370400440532013000 BIC: X", "iban:0:22"),
        ("NO9386011117947 GB82 WEST 1234 5698 7654 32", "iban:0:15,iban:16:43"), ("AB12 DE89 3704 0044 0532 0130 00", "iban:5:32"),
        ("é DE89370400440532013001 DE89370400440532013000", "iban:25:47"), ("DE89370400440532013000X", ""), ("DE89 3704 0044 05", ""),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    added = {i: ",".join(x for x in s.split(",") if x.split(":")[0] in pii.ADDED) for i, s in got.items()}
    assert added == {i: want for i, (_, want) in enumerate(cases)}
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[5] == "IBAN [IBAN] BIC COBADEFFXXX" and masked[7] == "[IBAN] [IBAN]"


def test_pii_masks_every_span_and_keeps_rows(spark):
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, pii string")
    got = {r.doc_id: r for r in pii.mask(docs).collect()}
    assert docs.columns == ["doc_id", "text", "pii"] and len(got) == len(rows)
    assert got[0].text is None and got[3].text == "no data here" and got[8].pii == "k"
    assert got[8].text == "card [CARD] ééé [CARD]"
    assert all(not base(got[i].text) or not base(t) for i, t in rows)


def figures(text):
    ws = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    runs = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    hit = {j for i in range(len(ws) - 4) if runs[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(ws) < 10 or 100 * len(hit) > 20 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), failed


@pytest.mark.parametrize("bits", [24, 62, 3])  # usual; hashes that nearly always clash; texts with more places
def test_cleaning_figures(spark, monkeypatch, bits):
    monkeypatch.setattr(cleaning, "_PLACE_BITS", bits)
    rng = random.Random(4)
    texts = [None, "", "\n\n", "a", "a b c d e a b c d e", "x " * 50, "é|<> #\n" * 7, "a b c\x1cd e\x85f"]
    texts += [" ".join(rng.choice("abcdef") + rng.choice(["", "", ".", "\n"]) for _ in range(rng.randrange(0, 120))) for _ in range(150)]
    texts += ["word " * 6000, " ".join(str(i % 4000) for i in range(9000))]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in judged(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, kept int")).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == figures(t), t and t[:80]
        assert not (r.base_failed and r.kept)


def test_cleaning_drops_lines_then_documents(spark):
    prose = "This is a sentence that has quite a few different words in it, as prose has."
    other = "Another line follows it here and closes the same way with a stop."
    good = f"Home | About | Contact\n{prose}\nHeading\n{other}\nCopyright 2020 all rights reserved"
    bad = f"{prose}\n" + "\n".join(f"item w{i} in x{i} list y{i} that z{i} never" for i in range(30))
    got = {r.doc_id: r for r in measure(spark.createDataFrame([(1, good), (2, bad)], "doc_id long, text string")).collect()}
    assert got[1].clean_text == f"{prose}\nHeading\n{other}" and got[1].kept and got[1].n_lines_removed == 2
    assert got[2].clean_text == prose and not got[2].kept and not got[2].base_failed


def water(sizes):
    names = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    weight = {s: curriculum.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            target.update(share)
            break
        target.update({s: 2.0 * sizes[s] for s in over})
        free -= over
    return target


def test_mix_meets_targets(spark, monkeypatch):
    monkeypatch.setattr(curriculum, "STRETCH", 7)
    rng = random.Random(9)
    rows = [(i, None if i % 50 == 0 else "w " * rng.randrange(0, 40), rng.choice(["a", "a", "a", "b", "c", "d", "", None, "é"])) for i in range(400)]
    rows += [(i + 1000, "one two", "tiny") for i in range(3)] + [(7, "a b c", "a"), (7, "a b c", "a"), (2000, None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = curriculum.schedule(docs).collect()
    again = curriculum.schedule(docs.repartition(5)).collect()
    key = lambda r: (r.doc_id, r.size, r.taken, str(r.position))
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, taken = water(sizes), Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size and (r.position is None) == (r.taken == 0)
    assert all(abs(taken[s] - want[s]) < 1.001 for s in sizes)


def test_curriculum_follows_its_schedule(spark):
    rows = [(i, "w " * 10, "abc"[i % 3]) for i in range(3000)]
    got = curriculum.schedule(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    early = {s: sum(r.size for r in got if r.source == s for t in r.epochs if t < 0.5) / sum(r.taken for r in got if r.source == s) for s in "abc"}
    for s, slope in zip("abc", curriculum.SLOPES, strict=True):
        assert abs(early[s] - (0.5 - slope / 4)) < 0.02
    order = [r.position for r in curriculum.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()]
    seen = [p for p in order if p is not None]
    assert seen == sorted(seen) and None not in order[: len(seen)]


def test_native_operators_on_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert pii.report(docs).collect() == judged(docs).collect() == curriculum.mixed(docs).collect() == []


def test_native_operators_run_no_python(spark):
    docs = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string").select("doc_id", "text", "source")
    for df in (pii.report(docs), pii.mask(docs), judged(docs), curriculum.mixed(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)
