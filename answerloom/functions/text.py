"""Text functions as Column expressions: normalising, tokenising, coverage, keys, citations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

# --- fixed values -----------------------------------------------------------------------------------------------
# Characters and words that decide token boundaries and token filtering.
INVISIBLE_IN_TOKENS = "\u200b\ufeff\u00ad"
INVISIBLE_IN_DOCUMENTS = "\u200b\ufeff\u200e\u00ad"
CJK = "[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u3040-\u30ff]"
CJK_OR_FULLWIDTH = "[\u3000-\u303f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff00-\uffef]"
WORD = "[a-z0-9]+"
FIRST_CJK = "\u3000"  # every Latin word sorts before it, every CJK run after it
STOPWORDS_LATIN = (
    "the a an of to in is are and or for on at by with how what which who when where why"
).split()
STOPWORDS_CJK = list(
    "的了是在和与或有我你他她它这那个们都也就还而但被把给对从到为以及等中上下里着过吗呢吧啊呀哦嗯一不会能要可什么怎样多少哪谁何如"
)
STOPWORDS_CJK_PAIRS = (
    "什么 怎么 怎样 如何 多少 哪些 哪个 是否 可以 请问 一下 我们 你们 他们 这个 那个 以及 但是 因为 所以 如果 那么 还是 "
    "或者 需要 应该 有没有"
).split()
REFUSAL_MARKERS = [
    "知识库中没有",
    "资料中没有",
    "没有找到相关",
    "未找到相关",
    "无法从提供的资料",
    "提供的信息不足以",
    "暂无相关信息",
]
SECTION_SEPARATORS = [" > ", ">", "/", "／", "|"]
SENTENCE = "[^。！？!?\n]+[。！？!?]?"
CITATION = r"\[(\d+)\]"
# ----------------------------------------------------------------------------------------------------------------

WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS = f"[{WHITESPACE}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _strings() -> Column:
    return F.array().cast("array<string>")


def trim_ws(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(WHITESPACE))


def collapse_ws(c: Column | str) -> Column:
    """Runs of whitespace become one blank; both ends are trimmed."""
    return trim_ws(F.regexp_replace(_col(c), f"{WS}+", " "))


# --- tokens -----------------------------------------------------------------------------------------------------
def norm(c: Column | str) -> Column:
    """Lower case, without invisible characters; widths are left as they are."""
    return F.lower(F.translate(_col(c), INVISIBLE_IN_TOKENS, ""))


def _pairs(run: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.char_length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def _split_tokens(c: Column | str, from_runs: Callable[[Column], Column], stop: Callable[[Column], Column]) -> Column:
    """CJK runs and Latin words of a text in one pass; texts without CJK take the short way."""

    def by_kind(pieces: Column) -> Column:
        runs = F.filter(pieces, lambda p: p >= FIRST_CJK)
        words = F.filter(pieces, lambda p: p < FIRST_CJK)
        mixed = F.concat(from_runs(runs), stop(words))
        return F.when(F.exists(pieces, lambda p: p >= FIRST_CJK), mixed).otherwise(stop(pieces))

    pieces = F.regexp_extract_all(norm(c), F.lit(f"{CJK}+|{WORD}"), F.lit(0))
    return F.coalesce(_let(pieces, by_kind), _strings())


def tokenize(c: Column | str, drop_stopwords: bool = True) -> Column:
    """Index tokens: every CJK character, every adjacent CJK pair inside a run, and Latin words; repeats are kept."""

    def drop(words: Sequence[str]) -> Callable[[Column], Column]:
        return lambda tokens: F.filter(tokens, lambda w: ~w.isin(list(words))) if drop_stopwords else tokens

    def cjk(runs: Column) -> Column:
        singles = F.flatten(F.transform(runs, lambda r: F.split(r, "")))
        pairs = F.flatten(F.transform(runs, lambda r: F.when(F.char_length(r) > 1, _pairs(r)).otherwise(_strings())))
        return F.concat(drop(STOPWORDS_CJK)(singles), drop(STOPWORDS_CJK_PAIRS)(pairs))

    return _split_tokens(c, cjk, drop(STOPWORDS_LATIN))


def tokenize_eval(c: Column | str) -> Column:
    """Evaluation tokens: CJK pairs (a run of one character stays), Latin words, no stopword list."""

    def cjk(runs: Column) -> Column:
        return F.flatten(F.transform(runs, lambda r: F.when(F.char_length(r) > 1, _pairs(r)).otherwise(F.array(r))))

    return _split_tokens(c, cjk, lambda words: words)


def query_terms(c: Column | str) -> Column:
    return F.array_distinct(tokenize(c))


def coverage_of(query_terms: Column, text_tokens: Column) -> Column:
    """Share of the distinct query terms found in the text tokens; 0 when either side has no token."""

    def share(terms: Column, tokens: Column) -> Column:
        hit = F.size(F.array_intersect(terms, tokens))
        return F.when((F.size(terms) > 0) & (F.size(tokens) > 0), hit / F.size(terms)).otherwise(F.lit(0.0))

    return _let(F.array_distinct(query_terms), lambda terms: _let(text_tokens, lambda tokens: share(terms, tokens)))


def coverage(query: Column | str, text: Column | str) -> Column:
    return coverage_of(tokenize(query), tokenize(text))


def coverage_eval(query: Column | str, text: Column | str) -> Column:
    return coverage_of(tokenize_eval(query), tokenize_eval(text))


def estimate_tokens(c: Column | str) -> Column:
    """CJK and full-width characters count 1 each, every four others count 1, rounded up."""
    text = F.coalesce(_col(c), F.lit(""))
    wide = F.regexp_count(text, F.lit(CJK_OR_FULLWIDTH))
    return (wide + F.ceil((F.char_length(text) - wide) / 4)).cast("int")


# --- documents --------------------------------------------------------------------------------------------------
def normalize_document(c: Column | str) -> Column:
    """Unify line ends, drop invisible characters, squeeze 3+ newlines to 2, trim the right end; in this order."""
    text = F.regexp_replace(_col(c), "\r\n?", "\n")
    text = F.translate(text, INVISIBLE_IN_DOCUMENTS, "")
    return F.rtrim(F.regexp_replace(text, "\n{3,}", "\n\n"), F.lit(WHITESPACE))


def line_count(c: Column | str) -> Column:
    text = _col(c)
    newlines = F.char_length(text) - F.char_length(F.translate(text, "\n", ""))
    return F.when(F.char_length(text) == 0, 0).otherwise(newlines + 1).cast("int")


def sentences(c: Column | str) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(SENTENCE), F.lit(0))


def snippet(c: Column | str, size: int = 200) -> Column:
    text = collapse_ws(c)
    return F.when(F.char_length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("…"))).otherwise(text)


def source_label(doc_name: Column, doc_id: Column, section: Column, page: Column) -> Column:
    """``document > section > page``; missing parts are skipped, a missing name falls back to the id."""
    name = F.when(F.coalesce(doc_name, F.lit("")) != "", doc_name).otherwise(
        F.concat(F.lit("文档"), doc_id.cast("string"))
    )
    part = F.when(section != "", section)
    page_label = F.when(page.isNotNull(), F.concat(F.lit("第"), page.cast("string"), F.lit("页")))
    return F.concat_ws(" > ", name, part, page_label)


# --- answers ----------------------------------------------------------------------------------------------------
def is_refusal(c: Column | str, markers: Sequence[str] = tuple(REFUSAL_MARKERS), max_chars: int = 200) -> Column:
    text = trim_ws(F.coalesce(_col(c), F.lit("")))
    found = F.lit(False)
    for marker in markers:
        found = found | text.contains(marker)
    return F.char_length(text).between(1, max_chars) & found


def citation_ranks(c: Column | str, valid: Column | None = None) -> Column:
    """Positive ranks cited as ``[n]``, in text order; only those in ``valid`` when it is given."""
    ranks = F.transform(F.regexp_extract_all(_col(c), F.lit(CITATION), F.lit(1)), lambda n: n.try_cast("int"))
    ranks = F.filter(ranks, lambda n: n > 0)
    return ranks if valid is None else F.filter(ranks, lambda n: F.array_contains(valid, n))


# --- match keys -------------------------------------------------------------------------------------------------
def norm_key(c: Column | str) -> Column:
    return F.lower(collapse_ws(F.coalesce(_col(c), F.lit(""))))


def doc_keys(c: Column | str) -> Column:
    """A document matches by its full name or by its stem."""
    key = norm_key(c)
    stem = F.rtrim(F.regexp_replace(key, r"\.[^.]*$", ""), F.lit(WHITESPACE))
    keys = F.array(F.concat(F.lit("doc:"), key), F.concat(F.lit("doc:"), F.when(stem != "", stem)))
    return F.when(key == "", _strings()).otherwise(F.array_distinct(F.array_compact(keys)))


def section_keys(c: Column | str) -> Column:
    """A section matches by its full path or by the last part after the first separator kind present."""
    key = norm_key(c)
    tail = F.lit(None).cast("string")
    for sep in reversed(SECTION_SEPARATORS):
        tail = F.when(key.contains(sep), trim_ws(F.substring_index(key, sep, -1))).otherwise(tail)
    keys = F.array(F.concat(F.lit("section:"), key), F.concat(F.lit("section:"), F.when(tail != "", tail)))
    return F.when(key == "", _strings()).otherwise(F.array_distinct(F.array_compact(keys)))
