import random

import pytest
from pyspark.sql import functions as F

from answerloom.operators import chunking as C
from answerloom.sources import cases, corpus, tabular


def split_plainly(text, size, overlap, separators=(*C.SEPARATORS, "")):
    """Recursive character splitting as publicly documented: cut at the first separator present, pack, recurse."""
    sep, rest = "", ()
    for n, s in enumerate(separators):
        if s == "" or s in text:
            sep, rest = s, separators[n + 1 :]
            break
    if sep == "":
        parts = list(text)
    else:
        raw = text.split(sep)
        parts = [p for p in [raw[0], *[sep + r for r in raw[1:]]] if p]
    out, good = [], []

    def pack():
        cur, total = [], 0
        for p in good:
            if total + len(p) > size and cur:
                out.append("".join(cur))
                while total > overlap or (total + len(p) > size and total > 0):
                    total -= len(cur[0])
                    cur = cur[1:]
            cur.append(p)
            total += len(p)
        if cur:
            out.append("".join(cur))
        good.clear()

    for p in parts:
        if len(p) < size:
            good.append(p)
        else:
            pack()
            out.extend(split_plainly(p, size, overlap, rest) if rest else [p])
    pack()
    return [t for t in (o.strip() for o in out) if t]


@pytest.mark.parametrize(("size", "overlap"), [(40, 10), (25, 0), (60, 30)])
def test_split_equals_recursive_reference(spark, size, overlap):
    rng = random.Random(5)
    alphabet = ["word", "a", "longerword", "住宿标准", "x" * 70, " ", " ", " ", ". ", "。", "\n", "\n\n", "，", "! ", "?", "; "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))).replace("\n\n\n", "\n") for _ in range(60)]
    while any("\n\n\n" in t for t in texts):
        texts = [t.replace("\n\n\n", "\n\n") for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.c for r in df.select("i", C.split_text(F.col("t"), size, overlap).alias("c")).collect()}
    for i, text in enumerate(texts):
        assert [c.text for c in got[i]] == split_plainly(text, size, overlap), repr(text)
        assert all(text[c.s : c.e] == c.text for c in got[i])


def test_split_arguments():
    with pytest.raises(ValueError):
        C.split_text(None, 100, 100)


MD = "intro\n# One\nalpha beta\n## Two\n\n```\n# not a header\n```\ntext\n### Deep\nmore\n# Next\nlast\n## Empty\n"


def test_markdown_sections(spark):
    df = spark.createDataFrame([(1, MD), (2, "plain text")], "doc_id long, text string")
    rows = [(r.section_path, r.body.strip()) for r in C.markdown_sections(df).orderBy("section_no").collect()]
    assert rows == [
        (None, "intro"), ("One", "alpha beta"), ("One > Two", "```\n# not a header\n```\ntext"), ("One > Two > Deep", "more"), ("Next", "last"),
    ]


def test_heading_stack_replaces_the_last(spark):
    text = "A\nlong sentence ends here.\nB\nC\nD\nname: x | dept: y"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [r.section_path for r in C.heading_labels(df).orderBy("start").collect()] == ["A", "A > B", "A > B > C", "A > B > D"]


def test_chunks_merge_share_windows_and_keep_invariants(spark):
    body = " ".join(f"sentence number {i} of this section." for i in range(60))
    text = f"# T\n{body}\n## S\nshort\n## U\n{body}"
    df = spark.createDataFrame([("k", 1, text), ("k", 2, "tiny"), ("k", 3, "  ")], "kb_id string, doc_id long, text string")
    out = C.chunk(df, size=300, overlap=60, min_chars=80, parent_size=900)
    rows = [r for r in out.orderBy("doc_id", "chunk_index").collect()]
    assert C.invariant_violations(out).count() == 0
    assert {r.doc_id for r in rows} == {1, 2}
    one = [r for r in rows if r.doc_id == 1]
    assert all(r.content in r.parent_content for r in one) and all(len(r.content) >= 80 for r in one)
    assert any(r.section_path == "T > S" and "short" in r.content for r in one)
    assert max(len(r.parent_content) for r in one) <= 900 + 310
    assert len({r.parent_content for r in one}) < len(one)


def test_pages_are_hard_borders(spark):
    df = spark.createDataFrame([("k", 1, 1, "first page words"), ("k", 1, 2, "x")], "kb_id string, doc_id long, page_no int, text string")
    rows = C.chunk(df, paged=True).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.page_no, r.content) for r in rows] == [(0, 1, "first page words"), (1, 2, "x")]


def test_json_flattening(spark):
    deep = "1"
    for _ in range(25):
        deep = '{"d": ' + deep + "}"
    rows = [(1, '{"a": {"b": [1, null, true]}, "e": {}, "f": []}'), (2, "[1.5, \"x\"]"), (3, "7"), (4, deep), (5, "{bad")]
    df = spark.createDataFrame(rows, "id int, j string")
    got = {}
    for r in tabular.flatten_json(df, ["id"], "j").collect():
        got.setdefault(r.id, {})[r.path] = r.value
    assert got[1] == {"a.b[0]": "1", "a.b[1]": "null", "a.b[2]": "true", "e": "{}", "f": "[]"}
    assert got[2] == {"[0]": "1.5", "[1]": "x"} and got[3] == {"$": "7"} and 5 not in got
    assert list(got[4].values()) == [tabular.TRUNCATED]


def test_files_and_tables(spark, tmp_path):
    (tmp_path / "a.MD").write_text("hello\r\nworld  ")
    (tmp_path / "b.exe").write_text("x")
    (tmp_path / "c.txt").write_text("  \n ")
    good, bad = corpus.read_corpus(spark, str(tmp_path), [".md", "TXT"])
    assert [(r.filename, r.text) for r in good.collect()] == [("a.MD", "hello\nworld")]
    assert {r.filename: r.reason for r in bad.collect()} == {"b.exe": "unsupported extension", "c.txt": "empty text"}
    table = tmp_path / "t"
    table.mkdir()
    (table / "t.csv").write_text("name;n\n ann ;1\n;\n")
    (table / "u.csv").write_text("a;b\n1;2;3\n")
    (table / "v.csv").write_text("only;names\n")
    assert sorted(r.text for r in tabular.read_table_text(spark, str(table), sep=";").collect()) == ["a: 1 | b: 2 | col_2: 3", "name: ann | n: 1", "only | names"]


def test_files_of_other_kinds_are_not_opened(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 \xff\xfe binary")
    (tmp_path / "b.txt").write_text("text")
    good, bad = corpus.read_corpus(spark, str(tmp_path))
    assert [r.filename for r in good.collect()] == ["b.txt"]
    assert [(r.filename, r.reason, r.text) for r in bad.collect()] == [("a.pdf", "unsupported extension", "")]


def test_case_lines(spark, tmp_path):
    lines = ["﻿# head", "", '{"question": " q1 ", "sections": "s", "tags": ["a", "a", " b "]}', "oops", "[1]", '{"question": "q2", "expected_doc": "' + "x" * 300 + '"}', '{"tags": []}']
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    parsed, bad = cases.read_cases(spark, str(tmp_path))
    good, unusable = cases.normalize_cases(parsed)
    rows = {r.question: r for r in good.collect()}
    assert rows["q1"].expected_sections == ["s"] and rows["q1"].tags == ["a", "b"] and rows["q1"].line_no == 3
    assert len(rows["q2"].expected_doc) == 255 and rows["q2"].expected_sections == []
    assert sorted((r.line_no, r.reason) for r in bad.unionByName(unusable).collect()) == [
        (4, "invalid JSON"), (5, "not a JSON object"), (7, "question is required"),
    ]


def test_cells_have_no_length_limit(spark):
    cell = 'long ""quoted"" cell\nover lines ' * 36_000
    files = spark.createDataFrame([("f", f'name,note\nann,"{cell}"\nbob,short\n')], "path string, text string")
    got = [r.line for r in tabular.table_text(files).orderBy("row_no").collect()]
    assert got == ["name: ann | note: " + cell.replace('""', '"').strip(), "name: bob | note: short"] and len(got[0]) > 1_000_000
