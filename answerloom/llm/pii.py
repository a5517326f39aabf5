"""Personal data in texts with SQL functions only: patterns propose, checksums confirm, nearby words weigh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The base kinds with their patterns, in the order in which spans are listed. The quantifiers give
# nothing back where that can't change a match, and a match begins at the start of its run of characters or where
# the last match ended, so that time stays in proportion to a text's length.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Added kinds: an account number of a country, a national number, a telephone number without a country code.
# Of account numbers the pattern takes the head; its group holds what may belong to the number, whose end is found by mod-97.
IBAN = r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]){11,30}(?![A-Za-z0-9])))[A-Z]{2}[0-9]{2}"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL = r"(?<![0-9+.()-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-]*[0-9])"
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "local")
#: Words that raise a proposal's score when they stand within NEAR characters before it.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write to|correo|adresse)\b",
    "ip": r"(?i)\b(?:ip|address|host|server|login|adresse)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|anruf|appel|llamar)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b",
    "ssn": r"(?i)\b(?:ssn|social security|tax|national)\b",
    "local": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|anruf|appel|llamar)\b",
}
NEAR = 40
#: Lengths of account numbers by country, without spaces.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU",
    31: "MT SC", 32: "LC", 33: "RU",
}
#: Score of a proposal that its validator confirms, what a context word adds, and the score from which a span of an
#: added kind counts. A base span always counts; mod-97 alone is enough for an account number.
SCORE = {"email": 0.8, "ip": 0.7, "card": 0.9, "phone": 0.8, "iban": 0.9, "ssn": 0.4, "local": 0.4}
WITH_CONTEXT, LEAST = 0.3, 0.6
#: What stands in place of a span.
MASK = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "iban": "[IBAN]", "ssn": "[SSN]", "local": "[PHONE]"}

#: Cheap signs without which a pattern can't match.
_SIGN = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
    "card": lambda t: F.rlike(t, F.lit(r"[0-9](?:[\x20-]?+[0-9]){12}")),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "iban": lambda t: F.rlike(t, F.lit(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")),
    "ssn": lambda t: F.rlike(t, F.lit(r"[0-9]-[0-9]{2}-[0-9]")),
    "local": lambda t: F.rlike(t, F.lit(r"[0-9]\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}")),
}
_PATTERN = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SSN, "local": LOCAL}
_SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(number)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc + F.when((n - i) % 2 == 0, F.substring(number, i, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*(F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(number, i, F.lit(1)).cast("int") + 1)
        ),
    )
    return F.when(n > 0, total % 10 == 0).otherwise(F.lit(False))


def mod97(account: Column) -> Column:
    """Whether an account number, its first four characters moved to the end and letters as 10 to 35, is 1 modulo 97."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, F.lit(1), F.lit(4)))

    def step(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 58, (acc * 10 + c - 48) % 97).otherwise((acc * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(account)), F.lit(0), step) == 1


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        d = digits(s)
        return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(s)).between(9, 15)
    if kind == "ssn":
        return ~F.rlike(s, F.lit(r"^(?:000|666|9..)|-00-|-0000$"))
    return F.lit(True)


def _account(s: Column) -> Column:
    """Length of the account number that ``s`` begins with, null if there is none: it ends with a word of ``s`` and passes
    mod-97; the length of its country goes before the longest."""
    compact = lambda n: F.regexp_replace(F.substring(s, F.lit(1), n), " ", "")
    whole_words = F.filter(F.sequence(F.lit(15), F.length(s)), lambda n: (F.substring(s, n + 1, F.lit(1)).isin("", " ")) & (F.substring(s, n, F.lit(1)) != " "))
    ends = F.filter(whole_words, lambda n: (F.length(compact(n)) >= 15) & mod97(compact(n)))
    lengths = F.create_map(*(F.lit(v) for n, names in IBAN_LENGTHS.items() for name in names.split() for v in (name, n)))
    return F.coalesce(F.array_max(F.filter(ends, lambda n: F.length(compact(n)) == lengths[F.substring(s, F.lit(1), F.lit(2))])), F.array_max(ends))


def _proposed(kind: str, text: Column) -> Column:
    """Confirmed spans of a kind, in code points, with their scores.

    The pieces between the matches give their places, and the last NEAR characters are carried along, so that time stays in
    proportion to the text. Texts without the sign are not searched.
    """
    pattern = F.lit(_PATTERN[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    pieces = F.split(text, _PATTERN[kind], -1)
    no_spans = F.expr(f"CAST(array() AS {_SPAN})").alias("spans")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("free"), F.lit("").alias("tail"), no_spans)

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["piece"])
        at = begin + F.length(x["hit"])
        before = F.right(F.concat(acc["tail"], x["piece"]), F.lit(NEAR))
        end = begin + _account(x["whole"]) if kind == "iban" else at
        near = F.rlike(before, F.lit(CONTEXT[kind]))
        score = F.least(F.lit(1.0), F.lit(SCORE[kind]) + F.when(near, WITH_CONTEXT).otherwise(0.0))
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), score.alias("score"))
        good = (begin >= acc["free"]) & end.isNotNull() if kind == "iban" else _valid(kind, x["hit"])
        if kind in ADDED:
            good = good & (score >= LEAST)
        spans = F.when(good, F.array_append(acc["spans"], span)).otherwise(acc["spans"])
        free = F.when(good, end).otherwise(acc["free"])
        return F.struct(at.alias("at"), free.alias("free"), F.right(F.concat(before, x["hit"]), F.lit(NEAR)).alias("tail"), spans.alias("spans"))

    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, h: F.struct(p.alias("piece"), h.alias("hit")))
    if kind == "iban":
        whole = F.regexp_extract_all(text, pattern, F.lit(1))
        pairs = F.zip_with(pairs, whole, lambda x, w: F.struct(x["piece"].alias("piece"), x["hit"].alias("hit"), w.alias("whole")))
    spans = F.aggregate(pairs, start, step, lambda acc: acc["spans"])
    return F.when(_SIGN[kind](text), spans).otherwise(F.expr(f"CAST(array() AS {_SPAN})"))


def find(docs: DataFrame, col: str = "text") -> DataFrame:
    """``docs`` with ``pii``: an array of (kind, start, end, score), by kind as listed and then by start.

    A null text counts as empty. Spans of different kinds may overlap. A column named pii is replaced; others stay.
    """
    text = F.coalesce(F.col(col), F.lit(""))
    return docs.withColumn("pii", F.concat(*(_proposed(k, text) for k in (*BASE, *ADDED))))


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for each row of ``docs``.

    Base spans are whole matches of the patterns that pass their checks, leftmost and without overlap within a kind; a
    failing match is dropped without another try. Account numbers that pass mod-97 are added, wherever in a run of upper-case
    words they begin and end, and so are national and local telephone numbers with a context word among the NEAR characters
    before them, whatever else stands there. Rows are independent; repeated rows give repeated results.
    """
    base = F.filter("pii", lambda x: x["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("bigint")
    return find(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(_line(base).cast("binary"), 256).alias("base_sha256"),
        _line(F.col("pii")).alias("spans"), F.size(F.filter("pii", lambda x: x["kind"].isin(*ADDED))).cast("bigint").alias("n_added"),
    )


def mask(docs: DataFrame, col: str = "text") -> DataFrame:
    """``docs`` with every found span of ``col`` replaced by the mark of its kind; all columns, all rows.

    Of overlapping spans the one that starts first is replaced, the longer one of two with the same start; what the other has
    beyond it goes too. A null text stays null; other columns are not read.
    """
    names = docs.columns
    rows = docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(names)), F.col(col).alias("_text"))
    rows = find(rows, "_text")
    text = F.col("_text")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("CAST(array() AS array<string>)").alias("parts"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int"))
        marks = F.create_map(*(F.lit(v) for kv in MASK.items() for v in kv))
        parts = F.when(x["start"] >= acc["at"], F.concat(acc["parts"], F.array(gap, marks[x["kind"]]))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), parts.alias("parts"))

    order = F.array_sort(F.transform("pii", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["end"].alias("end"), x["kind"].alias("kind"))))
    end = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    masked = F.when(F.size("pii") > 0, F.aggregate(order, start, step, end)).otherwise(text)
    return rows.withColumn("_masked", masked).select(*(F.col("_masked" if c == col else f"_{i}").alias(c) for i, c in enumerate(names)))
