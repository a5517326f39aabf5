"""Page text, language, toxicity and secrets: exact cases and held-out accuracy."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest

from answerloom.llm import langid, secrets, toxicity
from answerloom.llm.common import SPACE, Words, shingles, table, text_blocks
from answerloom.llm.html import extract, main_text, main_texts

SF = "/root/testdata/sf0.01"

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header><a href=/>Site</a> name</header><nav><ul><li><a href="/a">Menu, one</a></li></ul></nav><!-- <p>hidden</p> -->
<div class="cookie-notice"><p>We use cookies, and more cookies, and even more of them, on this site.</p></div>
<div class="ad">Buy, now, this, thing, today.</div>
<article><header><h1>A &amp; B</h1></header><p><b>First, the  text\n goes<br>on, as it does.<p>Second &lt;i&gt; part&nbsp;here, with <a href=x>one link</a>.
<form><input name=q><label>Search</label></form><ul><li>Point one</li><li>Point two</ul><p hidden>not seen</p><pre>a
 b</pre></article>
<aside><p>Aside, of, no, use.</p></aside><section id="comments"><p>I, for one, disagree, strongly, with, all, of, this.</p></section>
<footer>&copy; 2020 <p>Contact, us</p></footer></body></html>"""


def test_page_text():
    assert main_text(PAGE) == "A & B First, the text goes on, as it does. Second <i> part here, with one link. Point one Point two a b"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<html><body></body></html>", ""), ("plain words", "plain words"), ("<p>one<p>two", "one two"), ("<p>cut off <a href=\"", "cut off"),
        ("<nav>menu</nav>", ""), ("</p></div>text", "text"), ("<div><div><p>deep, text, here</p></div></div>", "deep, text, here"), ("<p>a &#233; &#x41; &unknown; &amp</p>", "a é A &unknown; &"),
        ("<p>x<script>y", "x"), ("<" * 500, "<" * 500),
    ],
)
def test_page_text_edges(page, text):
    assert main_text(page) == text


def test_div_pages_without_article():
    prose = "<p>" + "Words, of the story, that go on for a while, as stories do. " * 4 + "</p>"
    page = f'<body><div id="wrap"><div class="sidebar">{prose}</div><div class="story">{prose * 3}</div><div class="links">' + "<a href=x>link text here</a> " * 30 + "</div></div></body>"
    want = " ".join([re.sub("<.*?>", "", prose).strip()] * 3)
    assert main_text(page) == want


def test_deep_and_long_pages():
    assert main_text("<div>" * 20000 + "x, y") == "x, y"
    body = "<p>some, words</p>" * 20000
    assert main_text(f"<article>{body}</article>").count("some") == 20000


def test_extract_keeps_other_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a, b</p>", "old", 3.5), (2, None, None, None, None), (2, None, None, None, None)], "page_id long, url string, html string, text string, extra double")
    got = sorted((tuple(r) for r in extract(pages).select("page_id", "url", "extra", "text", "n_chars").collect()), key=str)
    assert got == [(1, "u", 3.5, "a, b", 4), (2, None, None, "", 0), (2, None, None, "", 0)]
    assert main_texts(pages.limit(0)).collect() == []


def test_words_and_shingles_of_a_block():
    texts = [None, "", " a  b\tc\x0bd ", "e", "A b C d e f", "é é"]
    for _, _, data, offsets in text_blocks(__import__("pyarrow").array(texts)):
        words = Words(data, offsets)
        found = [bytes(data[a:b]).decode() for a, b in zip(words.start, words.end, strict=True)]
        assert found == ["a", "b", "c", "d", "e", "A", "b", "C", "d", "e", "f", "é", "é"]
        assert words.count.tolist() == [0, 0, 4, 1, 6, 2]
        assert words.hash[0] == words.hash[5] and words.hash[1] == words.hash[6] and len(set(words.hash.tolist())) == 7
        _, _, rows = shingles(words)
        assert rows.tolist() == [2, 3, 4, 4, 5]
    assert SPACE.sum() == 6


def test_languages_held_out(spark):
    docs = table(spark, SF, "documents")
    got = {r.doc_id: r for r in langid.languages(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i, r in got.items() if r.held_out and truth[i]]
    assert len(got) == len(truth) and sum(got[i].lang_pred == truth[i] for i in held) > 0.97 * len(held) > 100
    assert all(0 <= r.score <= 1 for r in got.values())


def spoken(n_languages, n_docs, seed=3):
    """Documents of made-up languages, each with words of its own and some that all share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 8)))
    shared = [word() for _ in range(40)]
    own = [[word() for _ in range(60)] for _ in range(n_languages)]
    return [(i, " ".join(rng.choice(own[i % n_languages] if rng.random() < 0.7 else shared) for _ in range(25)), f"l{i % n_languages:03d}") for i in range(n_docs)]


def plain_languages(rows):
    """The same by plain sets of n-grams, without hashes and filters."""
    grams = lambda text: [(size, b[i : i + size]) for b in [f" {text} ".encode()] for size in langid.SIZES for i in range(len(b) - size + 1)]
    counts = {}
    for doc_id, text, lang in rows:
        if zlib.crc32(str(doc_id).encode()) % 4 != 2:
            counts.setdefault(lang, Counter()).update(grams(text))
    shares = {lang: {g: n / c.total() for g, n in c.items() if n / c.total() >= langid.SHARE} for lang, c in counts.items()}
    means = Counter()
    for held in shares.values():
        for g, share in held.items():
            means[g] += share / len(shares)
    sets = {lang: {g for g, share in held.items() if share >= langid.OF_MEAN * means[g]} for lang, held in shares.items()}
    return {i: max(sorted(sets), key=lambda lang: sum(g in sets[lang] for g in own)) for i, text, _ in rows for own in [grams(text)]}


def test_seventy_languages_equal_plain_sets(spark):
    rows = spoken(70, 1400)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.train(docs)
    assert filters.rows.shape[0] == 2 and len(filters.languages) == 70
    got = {r.doc_id: r for r in langid.identify(docs, filters).collect()}
    want = plain_languages(rows)
    assert sum(got[i].lang_pred == want[i] for i, _, _ in rows) >= 0.99 * len(rows)
    held = [r for r in rows if got[r[0]].held_out]
    assert len(held) > 200 and sum(got[i].lang_pred == lang for i, _, lang in held) >= 0.97 * len(held)
    rare = [r for r in held if int(r[2][1:]) >= 64]
    assert rare and all(got[i].lang_pred == lang for i, _, lang in rare)


def test_a_repeated_id_teaches_each_different_text_once(spark):
    rows = spoken(2, 200)
    once = spark.createDataFrame(rows, "doc_id long, text string, lang string").where("crc32(cast(doc_id AS string)) % 4 <> 2")
    one_id = once.withColumn("doc_id", once.doc_id * 0 + 1)
    want = langid.train(once)
    for docs in (one_id, one_id.unionByName(one_id), once.unionByName(once)):
        got = langid.train(docs)
        assert got.languages == want.languages and (got.rows == want.rows).all()
    first = langid._first(one_id.unionByName(one_id), 30)
    assert sorted(r["count"] for r in first.groupBy("lang").count().collect()) == [30, 30]


def test_language_edges(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "123 !?", None), (5, "", "de"), (5, "", "de"), (6, "日本語", None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    got = [tuple(r) for r in langid.languages(docs).collect()]
    assert len(got) == len(rows) and {r[2] for r in got if r[0] in (3, 4, 5)} == {"und"} and all(r[3] == 0 for r in got if r[2] == "und")
    assert [tuple(r) for r in langid.languages(docs.limit(0)).collect()] == []
    assert {r.lang_pred for r in langid.languages(docs.withColumn("lang", docs.text.substr(0, 0).cast("string")).where("doc_id = 99")).collect()} == set()


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    lengths = np.array([5, 0, 1, 7, 3])
    first = np.cumsum(lengths) - lengths
    u, step = rng.normal(size=lengths.sum()), rng.normal(size=(2, 2))
    p, _, _, normal = toxicity.forward_backward(u, first, lengths, step)
    for s, (a, n) in enumerate(zip(first, lengths, strict=True)):
        if not n:
            continue
        total, marginal = 0.0, np.zeros(n)
        for path in np.ndindex(*[2] * n):
            weight = np.exp(sum(u[a + t] * path[t] for t in range(n)) + sum(step[path[t - 1], path[t]] for t in range(1, n)))
            total += weight
            marginal += weight * np.array(path)
        assert np.allclose(p[a : a + n], marginal / total) and np.isclose(normal[s], np.log(total))


def toxic_corpus(n=600):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("ba", "do", "ki", "lu", "re") for b in ("na", "ti", "so", "ve", "mu")]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        bad = rng.random() < 0.3
        for _ in range(rng.randrange(1, 4) if bad else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["grumf", "Zorlak,", f"vekt{rng.choice('abcdefgh')}"]))
        rows.append((i, " ".join(text), int(bad)))
    return rows


def test_toxicity_held_out_and_spans(spark):
    rows = toxic_corpus() + [(9000, None, None), (9001, "", None), (9002, "grumf " * 3000, None), (9002, "grumf " * 3000, None)]
    docs = spark.createDataFrame([(i, t, "x", 2) for i, t, _ in rows], "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows if y is not None] + [(None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.scored(docs, labels).collect()
    truth = {i: (t, y) for i, t, y in rows}
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and truth[r.doc_id][1] is not None]
    assert len(held) > 80 and sum(r.predicted == truth[r.doc_id][1] for r in held) >= 0.97 * len(held)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        text = truth[r.doc_id][0]
        if r.predicted and r.doc_id < 9000:
            a, b = map(int, r.toxic_spans.split(",")[0].split(":"))
            assert re.match("grumf|Zorlak|vekt", text[a:b])
    assert all(r.predicted == 0 for r in got if r.doc_id in (9000, 9001)) and all(r.predicted == 1 for r in got if r.doc_id == 9002)
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    got = toxicity.scored(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert got[0].predicted == 0 and 0 <= got[0].score < 0.3


ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secret_base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def secret_corpus():
    rng = random.Random(8)
    pick = lambda s, n: "".join(rng.choice(s) for _ in range(n))
    hexs, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    texts = [
        None, "", "secret: token: abcdefghij", "secret=token=abcdefgh", "paſſword=abcdefgh1 toKen=abcdefgh1", "PASSWORD = 'abcdefgh'", "password=short", "api_key:abc_def-12", "APIKEY=\"x/y+z=12\"",
        "AKIA" + "A" * 11, "AKIA" + "A" * 12, "AKIAKIA" + "AKIA" * 5, "f" * 31, "f" * 32, "xyzf" + "0" * 40, "token=" + "ab12" * 5000, "é" * 50 + " token = \"" + "0a" * 20 + '"',
    ]
    for _ in range(400):
        bits = [rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randrange(5, 30))]
        thing = rng.choice([f"password={pick(hexs, 18)}", f'token = "{pick(hexs, 40)}"', f"AKIA{pick(alnum, 16)}", f"user{rng.randrange(99)}@mail{rng.randrange(9)}.example.com", f"{rng.randrange(10**15, 10**16)}", f"10.22.{rng.randrange(256)}.{rng.randrange(256)}"])
        bits.insert(rng.randrange(len(bits)), thing)
        texts.append(" ".join(bits))
    return texts


def test_secrets_base_and_network(spark):
    texts = secret_corpus()
    texts += ["alpha beta " + "".join(random.Random(5).choices("0123456789abcdef", k=30)) + " gamma"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    names = ("assign", "access", "hex", "network")
    for i, t in enumerate(texts):
        want = secret_base(t or "")
        line = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in want)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), (t, got[i].spans)
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(x[1] == k for x in want) for k in range(3)]
        assert set(line.split(",")) - {""} <= set(got[i].spans.split(","))
    assert got[len(texts) - 1].n_network == 1  # a key without a word before it, found by its letters
    plain = [i for i, t in enumerate(texts[17:-1], 17) if "@mail" in t or re.search(r" \d{16}|10\.22", t)]
    assert sum(got[i].n_network for i in plain) <= 0.05 * len(plain)


def test_secrets_without_findings(spark):
    docs = spark.createDataFrame([(1, "nothing"), (1, "nothing"), (2, None)], "doc_id long, text string")
    assert [(r.spans, r.n_network) for r in secrets.scan(docs).collect()] == [("", 0)] * 3
    assert secrets.scan(docs.limit(0)).collect() == []


KEYS = string.ascii_letters + string.digits


def key_families(rng):
    pick = lambda s, n: "".join(rng.choice(s) for _ in range(n))
    return {
        "live": lambda: f"sk_live_{pick(KEYS, 24)}",
        "personal": lambda: f"ghp_{pick(KEYS, 36)}",
        "bot": lambda: f"xoxb-{pick(string.digits, 12)}-{pick(string.digits, 12)}-{pick(KEYS, 24)}",
        "cloud": lambda: pick(KEYS + "+/", 40),
        "letters": lambda: pick(string.ascii_letters, 28),
        "named": lambda: f"pwd = {rng.choice(['hunter', 'dragon', 'monkey', 'winter'])}{rng.randrange(10, 999)}{rng.choice('abcxyz')}",
    }


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_secrets_of_families_that_no_pattern_names(spark, sf):
    docs = table(spark, f"/root/testdata/{sf}", "documents").select("doc_id", "text")
    texts = [r.text for r in docs.where("text is not null and doc_id < 400").collect()]
    rng, planted = random.Random(4), []
    for name, make in key_families(rng).items():
        for _ in range(50):
            words = rng.choice(texts).split(" ")[:80]
            at = rng.randrange(len(words) + 1)
            head = " ".join(words[:at]) + " "
            value = make()
            planted.append((-1 - len(planted), head + value + " " + " ".join(words[at:]), name, len(head) + value.rfind(" ") + 1, len(head) + len(value)))
    rows = spark.createDataFrame([(i, t) for i, t, *_ in planted], docs.schema)
    got = {r.doc_id: r for r in secrets.scan(docs.unionByName(rows)).select("doc_id", "spans", "n_network").collect()}
    hits = Counter()
    for i, _, name, a, b in planted:
        assert "network:" in got[i].spans or got[i].n_network == 0
        hits[name] += f"network:{a}:{b}" in got[i].spans.split(",")
    assert all(hits[name] >= 45 for name in key_families(rng)), hits
    clean = [r for i, r in got.items() if i >= 0]
    assert sum(r.n_network > 0 for r in clean) <= 0.01 * len(clean)


def test_secret_windows():
    text = "é pwd='abcdefgh12' " + "Q7" * 50
    spans = secrets.candidates(text, [])
    assert [text[a:b] for a, b in spans] == ["abcdefgh12", "Q7" * 50]
    which, codes = secrets.windows(text, spans)
    assert which.tolist() == [0, 1, 1, 1, 1]
    show = ["".join({0: "_", 1: "?"}.get(c, chr(c + 30)) for c in row.tolist()) for row in codes]
    assert show[0] == "_" * 17 + "? pwd='" + "abcdefgh12" + "_" * 30 + "' Q7Q7Q7"
    assert show[1] == "_" * 5 + "? pwd='abcdefgh12' " + "Q7" * 20 + "Q7" * 4 and show[4].endswith("Q7" * 20 + "_" * 8)
    assert secrets.candidates(text, [(0, 0, 9)]) == spans[1:] and secrets.candidates("a.b-c.d. short 1234567", []) == []
    assert secrets.windows("", [])[1].shape == (0, 72) and len(secrets.windows("a1" * 300_000, [(0, 600_000)])[0]) == 29_999
    shown = secrets.windows("say token = abcdefgh", [(12, 20)], [4])[1][0]
    assert "".join(chr(c + 30) for c in shown.tolist() if c) == "say abcdefgh"


def test_secrets_are_learned_from_every_window(spark):
    texts = [t or "" for t in secret_corpus()] + [f"note {w} and {w.upper()} again" for w in ("ordinary", "wordlike", "separate", "mornings")] * 40
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    each, layers = 2, secrets.untrained()
    windows = {}
    for t in texts:
        for kind, codes in secrets.examples(t, each).items():
            windows.setdefault(kind, []).append(codes)
    windows = {k: np.concatenate(v) for k, v in windows.items()}
    assert len(windows["word"]) > 300 and len(windows["finding"]) > 1000 and set(secrets.SECRET) | set(secrets.ORDINARY) < set(windows)
    dealt = [secrets._products(docs.repartition(n), layers, each) for n in (1, 7)]
    assert set(dealt[0]) == set(dealt[1]) == set(windows) - {"unseen"}
    for kind, sums in dealt[0].items():
        own = layers.activations(windows[kind]).astype(np.float64)
        assert (sums == own.T @ own).all() and (dealt[1][kind] == sums).all(), kind
    net = secrets.fit(layers, dealt[0])
    counts = secrets._histogram(docs.repartition(5), net, each)
    assert {k: x.sum() for k, x in counts.items()} == {k: len(x) for k, x in windows.items()}


def test_secrets_network_does_not_depend_on_how_rows_are_dealt(spark):
    docs = spark.createDataFrame([(t or "",) for t in secret_corpus()], "text string")
    one, other = (secrets.train(docs.repartition(n)) for n in (2, 5))
    assert (one.out == other.out).all() and one.threshold == other.threshold and (one.scale == other.scale).all()
    assert one.report[0] >= 0.9 and one.report[2] >= 0.95


def test_secrets_threshold_from_unseen_shapes_alone():
    steps = np.zeros(2 * secrets.WIDEST * secrets.SCORE)
    high, low = steps.copy(), steps.copy()
    high[-9], low[9] = 5, 7
    net = secrets.calibrate(secrets.untrained(), {"unseen": high, "joined": low})
    assert net.report == (0.0, 1.0, 1.0) and 0.5 < net.threshold < 1
