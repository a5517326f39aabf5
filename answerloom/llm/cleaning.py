"""Line-first cleaning with SQL functions only: lines fail rules, then documents that lose too much text go."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

#: White space that ends words, as a class of Java's regular expressions.
BLANK = r"[\x20\x09-\x0D]+"
#: Lines of so few words are judged by whether they look like navigation; longer ones must be prose.
SHORT_LINE = 4
#: Ends of a sentence, with closing marks after it.
STOP = r"""[.!?…。！？:;]["'”’»)\]]*$"""
#: Navigation: words between bars, arrows and dots, or a line of at most NAVIGATION_CHARS characters that names where to go.
BARS = "|»›→·"
BARRED = r"[^\x20\x09-\x0D][\x20\x09-\x0D]*[|»›→·][\x20\x09-\x0D]*[^\x20\x09-\x0D]+.*[|»›→·]"
NAVIGATION_CHARS = 60
NAVIGATION = (
    r"(?i)^[^A-Za-z0-9_]*(?:home|menu|login|log in|sign (?:in|up)|next|previous|prev|back(?: to top)?|share|search|skip to .*|read more|more|"
    r"contact(?: us)?|about(?: us)?|impressum|kontakt|accueil|inicio)[^A-Za-z0-9_]*$"
)
#: Boilerplate that sites and programs add; as here, with a capital first, or in capitals.
BOILERPLATE = (
    "all rights reserved", "copyright (c)", "©", "terms of use", "terms of service", "privacy policy", "cookie policy", "enable javascript",
    "lorem ipsum", "click here", "licensed under", "powered by",
)
FORMS = sorted({form for w in BOILERPLATE for form in (w, w.capitalize(), w.upper())})
#: Part of a text's word characters that may go before the text is rejected, in percent.
MOST_LOST = 50
#: Words a text must keep.
LEAST_WORDS = 10
WINDOW = 5
_PLACE_BITS = 24


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def line_fails(line: Column) -> Column:
    """Whether a line with a word is to go: navigation, boilerplate, or a longer line that no sentence end closes.

    Short lines without navigation are headings and stay. Cheap signs go before regular expressions.
    """
    end = F.regexp_replace(F.right(line, F.lit(32)), r"[\x20\x09-\x0D]+$", "")
    end = F.when(end == "", F.regexp_replace(line, r"[\x20\x09-\x0D]+$", "")).otherwise(end)
    barred = reduce(or_, (F.contains(line, F.lit(b)) for b in BARS)) & F.rlike(line, F.lit(BARRED))
    named = (F.length(line) <= NAVIGATION_CHARS) & F.rlike(line, F.lit(NAVIGATION))
    added = reduce(or_, (F.contains(line, F.lit(b)) for b in FORMS))
    long_ = F.rlike(line, F.lit(rf"^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]++{BLANK}){{{SHORT_LINE}}}[^\x20\x09-\x0D]"))
    return (long_ & ~F.rlike(end, F.lit(STOP))) | barred | named | added


def _runs(hashes: Column) -> Column:
    """Hashes of all runs of WINDOW words, from the hashes of the words; null for fewer words."""
    n = F.size(hashes)
    run = lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW)))
    return F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), run))


def _places(order: Column, same: Column, place: Callable[[Column], Column]) -> Column:
    """Sorted places of the sorted runs that equal the one before them, and of those before."""
    return F.sort_array(F.array_distinct(F.concat(F.transform(same, lambda i: place(F.get(order, i))), F.transform(same, lambda i: place(F.get(order, i - 1))))))


def _covered(places: Column) -> Column:
    """Words in the runs at sorted places: each adds what the one before it leaves."""
    return F.aggregate(
        places,
        F.struct(F.lit(-WINDOW).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW).cast("bigint"), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )


def _with_repeated(rows: DataFrame) -> DataFrame:
    """``rows`` (_runs) with n_repeat_words: words in runs that occur twice or more.

    Only a text with fewer distinct runs than runs sorts them, as numbers of 40 bits of hash and 24 of place; where two
    runs agree in those bits alone, or a text has more places, whole hashes are sorted with their places instead.
    """
    runs, few = F.col("_runs"), F.lit(0).cast("bigint")
    again = runs.isNotNull() & (F.size(F.array_distinct(runs)) < F.size(runs))
    wide = F.size(runs) >= 1 << _PLACE_BITS
    mask = (1 << _PLACE_BITS) - 1
    packed = F.transform(runs, lambda h, i: h.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("bigint")))
    place = lambda x: x.bitwiseAND(F.lit(mask))
    rows = rows.withColumn("_order", F.when(again & ~wide, F.sort_array(packed)))
    rows = rows.withColumn("_same", F.filter(F.sequence(F.lit(1), F.size("_order") - 1), lambda i: F.shiftright(F.get("_order", i).bitwiseXOR(F.get("_order", i - 1)), _PLACE_BITS) == 0))
    at = lambda i: F.get("_runs", place(F.get("_order", i)).cast("int"))
    clash = wide | F.exists("_same", lambda i: at(i) != at(i - 1))
    rows = rows.withColumn("_whole", F.when(again & clash, F.array_sort(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.cast("bigint").alias("i"))))))
    whole_same = F.filter(F.sequence(F.lit(1), F.size("_whole") - 1), lambda i: F.get("_whole", i)["h"] == F.get("_whole", i - 1)["h"])
    by_whole = _covered(_places(F.col("_whole"), whole_same, lambda x: x["i"]))
    n = F.when(~again, few).when(F.col("_whole").isNotNull(), by_whole).otherwise(_covered(_places(F.col("_order"), F.col("_same"), place)))
    return rows.withColumn("n_repeat_words", F.coalesce(n, few)).drop("_order", "_same", "_whole")


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the base figures, the cleaned text and the verdict.

    Runs of words are compared by a 64-bit hash. What the cleaned text has left is what the removed lines take away.
    """
    text = F.coalesce("text", F.lit(""))
    total = lambda xs, f: F.aggregate(xs, F.lit(0).cast("bigint"), lambda acc, x: acc + f(x))
    rows = docs.withColumn("_words", words(text)).withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))))
    rows = rows.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w))).withColumn("_gone", F.filter("_lines", line_fails))
    rows = _with_repeated(rows.withColumn("_runs", _runs(F.col("_hashes"))))
    rows = rows.select(
        *docs.columns,
        F.size("_words").cast("bigint").alias("n_words"),
        total(F.col("_words"), F.length).alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("_gone").cast("bigint").alias("n_lines_removed"),
        F.array_join(F.filter("_lines", lambda x: ~line_fails(x)), "\n").alias("clean_text"),
        total(F.col("_gone"), lambda x: F.length(F.regexp_replace(x, BLANK, ""))).alias("_gone_chars"),
        total(F.col("_gone"), lambda x: F.size(words(x))).alias("_gone_words"),
    )
    rows = rows.withColumn("clean_chars", F.col("word_chars") - F.col("_gone_chars"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    little = (100 * F.col("_gone_chars") > MOST_LOST * F.col("word_chars")) | (F.col("n_words") - F.col("_gone_words") < LEAST_WORDS)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & ~little).drop("_gone_chars", "_gone_words")


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines_removed, clean_chars)
    for each row of ``docs``.

    Lines that look like navigation or boilerplate, and longer lines without a sentence's end, are removed one by one;
    a text is kept when it passes the base rules and at most MOST_LOST percent of its word characters went with the lines.
    Null texts have no words and fail. Rows are independent, so repeated rows give repeated results; other columns are ignored.
    """
    return measure(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "clean_chars"
    )
