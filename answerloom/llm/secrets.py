"""Secrets in texts: fixed patterns, and a character network over every other candidate and its surroundings."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from answerloom.llm.common import over_batches

# The kinds, their patterns and the least lengths that count.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS, ACCESS_LEAST = re.compile(r"AKIA[A-Z0-9]+"), 16
HEX = re.compile(r"[0-9a-f]{32,}")  # a longest run of 32 or more: shorter runs fail as wholes
ASSIGN_LEAST = 8

#: The kind of the spans that the network adds.
ADDED = "network"
#: A candidate is a longest run of these characters, LEAST or more of them, without a dot or hyphen at its ends; it may end in padding.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_])(?=[A-Za-z0-9+/_.-]{8})[A-Za-z0-9+/_]+(?:[.-]+[A-Za-z0-9+/_]+)*={0,2}", re.A)
LEAST = 8
#: What counts as ordinary for training: words of one case (also joined ones), and numbers (also joined ones).
WORDS = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[._/+-]+(?:[A-Z]?[a-z]+|[A-Z]+))*")
NUMBERS = re.compile(r"[0-9]+(?:[._/+-]+[0-9]+)*")
#: Characters that the network sees: before, within (a window; longer candidates have several) and after.
BEFORE, WITHIN, AFTER = 24, 40, 8
#: Drawn secrets, and as many ordinary words joined as names, paths and the like: so many at least, and one a text.
DRAWN = 6000
#: Weight of each kind of training windows beside the others of its label, that of a kind of the texts' own no more than its windows;
#: the windows of one kind, of which all are learned, weigh the same.
SECRET, ORDINARY = {"finding": 2000, "drawn": 6000}, {"word": 12000, "number": 4000, "joined": 5000, "named": 1300}
#: The same where the threshold is set: shapes that were never trained, too.
HELD = {"finding": 2000, "drawn": 4700, "unseen": 5300}
OWN = ("finding", "word", "number")
FILTERS, WIDTH, EMBED, HIDDEN = 64, 5, 12, 384
#: Whole numbers for an activation of 1, a response of 1 and a raw score of 1; the widest raw score of a histogram.
UNIT, RESPONSE, SCORE, WIDEST = 127, 512, 256, 8
#: A usual largest response, and what a hidden sum is divided by.
USUAL, SUM = 2400, 8192
#: Sums of products that are added up in one group.
BAND = 4096
#: The threshold is the highest one that keeps this part of the held-out secrets, shapes that were never trained among them.
RECALL = 0.95


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, in order."""
    return [(s, k, e) for s, k, e, _ in _base(text)]


def _base(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the fixed patterns' matches, in order."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of every candidate that meets no base span."""
    spans = [m.span() for m in CANDIDATE.finditer(text)]
    spans = [(a, b) for a, b in spans if b - a >= LEAST]
    if not base:
        return spans
    reach = np.maximum.accumulate([e for _, _, e in base])  # the furthest end among the base spans up to each
    before = np.searchsorted([s for s, _, _ in base], [b for _, b in spans], "left")
    return [x for x, i in zip(spans, before, strict=True) if not i or reach[i - 1] <= x[0]]


def codes_of(text: str) -> np.ndarray:
    """Printable ASCII as 2 and up, any other character as 1; 0 is padding."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where((points >= 32) & (points < 127), points - 30, 1).astype(np.uint8)


def windows(text: str, spans: list[tuple[int, int]], left: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(span, codes) of each window of the spans; windows of long spans overlap by half.

    ``left``: where the characters before each span end, if not at its start (a name in between is not shown).
    """
    codes = np.concatenate([np.zeros(BEFORE, np.uint8), codes_of(text), np.zeros(AFTER + 1, np.uint8)])
    pieces = [(i, s, b, (a if left is None else left[i]) if s == a else s) for i, (a, b) in enumerate(spans) for s in range(a, max(a + 1, b - WITHIN // 2), WITHIN // 2)]
    table, last, out = np.array(pieces, dtype=np.int64).reshape(-1, 4), len(codes) - 1, []
    for k in range(0, len(table), 4096):  # one very long span has very many windows
        s, b, before = table[k : k + 4096, 1:].T[:, :, None] + BEFORE
        inner = s + np.arange(WITHIN)
        around = codes[before + np.arange(-BEFORE, 0)], codes[np.minimum(np.minimum(b, s + WITHIN) + np.arange(AFTER), last)]
        out.append(np.concatenate([around[0], np.where(inner < b, codes[np.minimum(inner, last)], 0), around[1]], axis=1).astype(np.uint8))
    return table[:, 0], np.concatenate([np.zeros((0, BEFORE + WITHIN + AFTER), np.uint8), *out])


@dataclass
class Network:
    """Embedding, convolution, the largest activation over candidate and surroundings, a hidden layer, and its calibration.

    The layers up to the hidden one are drawn once, and apart from the character classes know nothing of any text; the
    output layer is learned. All but the calibration is done in whole numbers, which add up alike in any order.
    """

    taps: np.ndarray
    hidden: np.ndarray
    out: np.ndarray = field(default_factory=lambda: np.zeros(HIDDEN + 1))
    scale: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))
    threshold: float = 0.5
    #: Share of the held-out secrets of trained and of untrained shapes that pass, and of ordinary runs that do not.
    report: tuple[float, float, float] = (0.0, 0.0, 0.0)

    @cached_property
    def _pairs(self) -> list[np.ndarray]:
        """Responses to two characters at once."""
        return [(self.taps[j][:, None] + self.taps[j + 1][None]).reshape(-1, FILTERS) for j in (0, 2)]

    def features(self, codes: np.ndarray) -> np.ndarray:
        """The largest responses within and around."""
        codes = codes.T.astype(np.intp)  # places first: the largest over places is then taken row by row of the table
        two, slides, end = codes[:-1] * len(self.taps[0]) + codes[1:], len(codes) - WIDTH + 1, BEFORE + WITHIN - WIDTH + 1
        h = np.take(self._pairs[0], two[:slides], axis=0)
        h += np.take(self._pairs[1], two[2 : 2 + slides], axis=0)
        h += np.take(self.taps[4], codes[4:], axis=0)
        return np.concatenate([h[BEFORE:end].max(axis=0), np.maximum(h[:BEFORE].max(axis=0), h[end:].max(axis=0))], axis=1)

    def activations(self, codes: np.ndarray) -> np.ndarray:
        """The hidden layer, with a constant: whole numbers up to UNIT."""
        parts = [np.zeros((0, HIDDEN + 1), np.float32)]
        for i in range(0, len(codes), 256):
            top = np.clip((self.features(codes[i : i + 256]) - USUAL) >> 5, -UNIT, UNIT).astype(np.float32)
            sums = top @ self.hidden[:-1] + self.hidden[-1] * UNIT  # below 2 ** 24, so exact
            parts.append(np.append(np.rint(np.tanh(sums / SUM) * UNIT), np.full((len(top), 1), UNIT, np.float32), axis=1))
        return np.concatenate(parts)

    def raw(self, codes: np.ndarray) -> np.ndarray:
        return self.activations(codes).astype(np.float64) @ self.out

    def score(self, codes: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        return _sigmoid(self.raw(codes) * self.scale[0] + self.scale[1])


def untrained() -> Network:
    """The layers before the output, the same every time."""
    rng, classes = np.random.default_rng(6), np.zeros((97, 6))
    for c in range(97):
        char = chr(c + 30) if c > 1 else ""
        classes[c] = [c == 0, char.isdigit(), char.islower(), char.isupper(), char == " ", c == 1 or not (char.isalnum() or char in ("", " "))]
    embed = np.concatenate([classes, rng.normal(0, 0.3, (97, EMBED - 6))], axis=1)
    taps = np.einsum("ce,jef->jcf", embed, rng.normal(0, 1, (WIDTH, EMBED, FILTERS)))
    hidden = rng.normal(0, 256 / np.sqrt(2 * FILTERS), (2 * FILTERS + 1, HIDDEN))
    return Network(np.rint(np.clip(taps, -12, 12) * RESPONSE).astype(np.int16), np.rint(np.clip(hidden, -UNIT, UNIT)).astype(np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


# Quotation marks, and the characters that drawn secrets are drawn from.
QUOTES = "\"'"
LOW, UP, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = ("0123456789abcdef", UP + DIGITS, LOW + DIGITS, LOW + UP, LOW + UP + DIGITS, LOW + UP + DIGITS + "+/")
SHAPES = (*range(len(ALPHABETS)), "prefixed", "grouped", "word")
#: Shapes that only calibrate.
UNSEEN = (2, "grouped")


def _put(row: np.ndarray, value: str, name: str | None, at: int = 0) -> np.ndarray:
    """``row`` with ``value`` in place of its candidate, seen from character ``at``, and ``name`` in place of the last characters before it."""
    row = row.copy()
    piece = codes_of(value)
    inner = piece[at : at + WITHIN]
    row[BEFORE : BEFORE + WITHIN] = 0
    row[BEFORE : BEFORE + len(inner)] = inner
    if at:
        row[:BEFORE] = piece[max(0, at - BEFORE) : at][-BEFORE:] if at >= BEFORE else np.append(row[at:BEFORE], piece[:at])
        rest = piece[at + WITHIN : at + WITHIN + AFTER]
        row[BEFORE + WITHIN : BEFORE + WITHIN + len(rest)] = rest
    elif name:
        own = codes_of(name)[-BEFORE:]
        row[:BEFORE] = np.append(row[len(own) : BEFORE], own)
        if name[-1] in QUOTES:
            row[-AFTER:] = np.append(codes_of(name[-1]), row[-AFTER:-1])
    return row


def _name(rng: np.random.Generator, words: list[str]) -> str:
    """A name with a sign, as it stands before an assigned value."""
    word = words[rng.integers(len(words))].lower()
    word = word[: rng.integers(2, 9)] if rng.random() < 0.6 else "".join(c for c in word if c not in "aeiou")[:4] or word
    return f" {word}{(' = ', '=', ': ', ':', chr(32) + '= ' + chr(34), '=' + chr(34), ': ' + chr(39))[rng.integers(7)]}"


def drawn(row: np.ndarray, shape: int | str, words: list[str], rng: np.random.Generator) -> np.ndarray:
    """An ordinary window with a secret of the given shape in its place; values that are words with digits stand behind a name."""

    def draw(alphabet: str, least: int, most: int) -> str:
        return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), rng.integers(least, most + 1)))

    if shape == "word":
        value = words[rng.integers(len(words))][: rng.integers(4, 11)] + draw(DIGITS, 2, 4) + draw(LOW + UP + "_", 0, 2)
        value = value + draw(DIGITS, 2, 4) if len(value) < LEAST else value
        return _put(row, value, _name(rng, words))
    if shape == "prefixed":
        value = "".join(draw(LOW, 2, 5) + "_-"[rng.integers(2)] for _ in range(rng.integers(1, 3))) + draw(ALPHABETS[rng.integers(3, 5)], 16, 40)
    elif shape == "grouped":
        value = "-".join(draw(ALPHABETS[rng.integers(3) if i else 4], 4, 12) for i in range(rng.integers(3, 6)))
    else:
        value = draw(ALPHABETS[shape], 12 if shape else 16, 44)
    far = len(value) > WITHIN and rng.random() < 0.3
    return _put(row, value, (None, _name(rng, words), " " + words[rng.integers(len(words))] + " ")[rng.integers(3)], WITHIN // 2 if far else 0)


def joined(row: np.ndarray, words: list[str], rng: np.random.Generator) -> np.ndarray:
    """An ordinary window with a name, path, host, date, version or counter made of words and numbers; some stand behind a name."""
    some = [words[i][: rng.integers(3, 12)].lower() for i in rng.integers(0, len(words), rng.integers(2, 5))]
    n = [str(rng.integers(0, 10 ** rng.integers(1, 5))) for _ in range(4)]
    form = rng.integers(9)
    if form == 8:  # a word with a number, without a name before it
        return _put(row, f"{''.join(some[:2])}{n[0]}"[-WITHIN:], " " + words[rng.integers(len(words))] + " ")
    value = (
        "_".join(some), "-".join(some), some[0] + "".join(w.title() for w in some[1:]), "/".join(some) + "." + some[0][:3],
        f"{some[0]}{n[0][:2]}." + ".".join(some[1:]) + ".com", f"20{n[0][:2]:0>2}-{n[1][:2]:0>2}-{n[2][:2]:0>2}T{n[3][:2]:0>2}", "v" + ".".join(n) + "-" + some[0], "/".join([*some, n[0]]),
    )[form]
    value = value if len(value) >= LEAST else value + "_" + "_".join(some)
    return _put(row, value, _name(rng, words) if rng.random() < 0.3 else None, WITHIN // 2 if len(value) > WITHIN and rng.random() < 0.3 else 0)


def examples(text: str, each: int) -> dict[str, np.ndarray]:
    """All training windows of a text by kind: its findings, ordinary words and numbers, and where it has ordinary ones, ``each``
    drawn secrets and joined words in their surroundings and a third as many behind a name; the same for the same text."""
    base, out = _base(text), {}
    if base:
        own = [x for x, y in zip(base, [(0, 0, 0, 0), *base], strict=False) if x[0] >= y[2]]  # a hex run behind a name is one finding
        out["finding"] = windows(text, [(v, e) for _, _, e, v in own], [s for s, _, _, _ in own])[1]
    spans, plain, words = candidates(text, [(s, k, e) for s, k, e, _ in base]), [], []
    for kind, pattern in ("word", WORDS), ("number", NUMBERS):
        own = [(a, b) for a, b in spans if pattern.fullmatch(text, a, b)]
        if own:
            out[kind] = windows(text, own)[1]
            plain.append(out[kind])
            words += [text[a:b] for a, b in own] if kind == "word" else []
    if plain:
        rows, rng = np.concatenate(plain), np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
        words = [w for w in re.split("[^A-Za-z]+", " ".join(words)) if len(w) >= 4] or ["name", "value", "entry"]
        pick = lambda: rows[rng.integers(len(rows))]
        shapes = [SHAPES[i] for i in rng.integers(0, len(SHAPES), each)]
        new = [drawn(pick(), s, words, rng) for s in shapes]
        for kind, unseen in ("drawn", False), ("unseen", True):
            if some := [x for x, s in zip(new, shapes, strict=True) if (s in UNSEEN) == unseen]:
                out[kind] = np.stack(some)
        out["joined"] = np.stack([joined(pick(), words, rng) for _ in range(each)])
        again = [pick() for _ in range(-(-each // 3))]
        out["named"] = np.stack([_put(r, "".join(chr(c + 30) for c in r[BEFORE : BEFORE + WITHIN] if c > 1), _name(rng, words)) for r in again])
    return out


def _by_kind(each: int, add: Callable[[str, np.ndarray], None]) -> Callable:
    """For over_batches: hands all training windows of a batch of texts to ``add``, kind by kind, and gives back nothing."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[np.ndarray]] = {}
        for text in batch.column("text").to_pylist():
            for kind, codes in examples(text, each).items():
                parts.setdefault(kind, []).append(codes)
        for kind, some in parts.items():
            add(kind, np.concatenate(some))
        return iter(())

    return work


def _products(docs: DataFrame, net: Network, each: int) -> dict[str, np.ndarray]:
    """For each kind that trains, the sums over all its windows of the products of every two activations; the last is UNIT for all."""
    half = np.triu_indices(HIDDEN + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def add(kind: str, codes: np.ndarray) -> None:
            if kind not in SECRET and kind not in ORDINARY:
                return
            own = sums.setdefault(kind, np.zeros((HIDDEN + 1, HIDDEN + 1)))
            for i in range(0, len(codes), 512):  # sums of 512 products of numbers up to UNIT are exact
                x = net.activations(codes[i : i + 512])
                own += x.T @ x

        for _ in over_batches(_by_kind(each, add), "text", 1 << 20)(batches):
            pass
        for kind, own in sums.items():
            own = own[half]
            bands = [own[i : i + BAND].tobytes() for i in range(0, len(half[0]), BAND)]
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(bands)), pa.array(range(len(bands)), pa.int32()), pa.array(bands, pa.binary())], names=["kind", "band", "sums"])

    def total(rows: pa.Table) -> pa.Table:
        own = sum(np.frombuffer(x.as_py()) for x in rows.column("sums"))
        return pa.table({"kind": rows.column("kind")[:1], "band": rows.column("band")[:1], "sums": pa.array([own.tobytes()], pa.binary())})

    kinds = "kind string, band int, sums binary"
    rows = docs.mapInArrow(run, kinds).groupBy("kind", "band").applyInArrow(total, kinds).collect()  # one matrix a kind, at any size
    out: dict[str, np.ndarray] = {}
    for r in rows:
        own, at = out.setdefault(r.kind, np.zeros((HIDDEN + 1, HIDDEN + 1))), slice(r.band * BAND, (r.band + 1) * BAND)
        own[half[0][at], half[1][at]] = own[half[1][at], half[0][at]] = np.frombuffer(r.sums)
    return out


def _weight(kind: str, weights: dict[str, int], n: float) -> float:
    return min(weights[kind], n) if kind in OWN else weights[kind]


def fit(net: Network, products: dict[str, np.ndarray]) -> Network:
    """The output layer that comes nearest, in squares, to 1 for secrets and -1 for ordinary windows."""
    both, goal = 1e-3 * np.eye(HIDDEN + 1), np.zeros(HIDDEN + 1)
    for weights, sign in (SECRET, 1), (ORDINARY, -1):
        count = {k: products[k][-1, -1] / UNIT**2 for k in weights if k in products}
        share = {k: _weight(k, weights, n) for k, n in count.items()}
        for k, n in count.items():
            part = 0.5 * share[k] / sum(share.values()) / n
            both += part * products[k] / UNIT**2
            goal += sign * part * products[k][-1] / UNIT**2
    net.out = np.rint(np.linalg.solve(both, goal) / UNIT * 2**30) / 2**30  # sums of such numbers are exact
    return net


def _histogram(docs: DataFrame, net: Network, each: int) -> dict[str, np.ndarray]:
    """For each kind, how many of all its windows have which raw score, in steps of 1 / SCORE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def add(kind: str, codes: np.ndarray) -> None:
            own = counts.setdefault(kind, np.zeros(2 * WIDEST * SCORE, np.int64))
            for i in range(0, len(codes), 4096):
                step = np.clip(np.floor(net.raw(codes[i : i + 4096]) * SCORE).astype(np.int64) + WIDEST * SCORE, 0, len(own) - 1)
                own += np.bincount(step, minlength=len(own))

        for _ in over_batches(_by_kind(each, add), "text", 1 << 20)(batches):
            pass
        for kind, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at])], names=["kind", "step", "n"])

    out: dict[str, np.ndarray] = {}
    for r in docs.mapInArrow(run, "kind string, step long, n long").groupBy("kind", "step").agg(F.sum("n").alias("n")).collect():
        out.setdefault(r.kind, np.zeros(2 * WIDEST * SCORE))[r.step] = r.n
    return out


def calibrate(net: Network, counts: dict[str, np.ndarray]) -> Network:
    """Probabilities and the threshold from the scores of windows that were not trained on."""

    def mixed(weights: dict[str, int]) -> np.ndarray:
        own = {k: counts[k] for k in weights if k in counts}
        return sum(_weight(k, weights, x.sum()) * x / x.sum() for k, x in own.items())

    one, none = mixed(HELD), mixed(ORDINARY)
    raw = (np.arange(len(one)) - WIDEST * SCORE) / SCORE
    net.scale = _platt(np.append(raw, raw), np.repeat([1, 0], len(raw)), np.append(one, none))
    step = int((np.cumsum(one) <= (1 - RECALL) * one.sum()).sum())
    net.threshold = float(_sigmoid(raw[step] * net.scale[0] + net.scale[1]))
    empty = np.zeros(len(one))
    seen = sum((counts[k] for k in SECRET if k in counts), empty)
    net.report = tuple(float(x[a:b].sum() / max(1, x.sum())) for x, a, b in ((seen, step, None), (counts.get("unseen", empty), step, None), (none, 0, step)))
    return net


def _platt(raw: np.ndarray, label: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Slope and intercept that turn raw scores into probabilities, with smoothed targets."""
    n1, n0 = count[label == 1].sum(), count[label == 0].sum()
    goal, w = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2)), np.array([1.0, 0.0])
    x = np.stack([raw, np.ones(len(raw))], axis=1)
    for _ in range(100):
        p = _sigmoid(x @ w)
        move = np.linalg.solve((x * (count * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (count * (p - goal)) + 1e-2 * (w - [1.0, 0.0]))
        w = w - move * min(1.0, 0.3 / max(1e-9, float(np.abs(move).max())))
    return w if w[0] > 0 else np.array([1.0, 0.0])


def train(docs: DataFrame) -> Network | None:
    """A network from ``docs`` (text): values that a fixed pattern finds are secrets; words of one case and numbers are ordinary.

    A finding is shown without the name before it, so that the value has to tell. Findings have few shapes, so most
    examples are drawn in other ones, in the surroundings of ordinary runs. Runs of mixed shape that no pattern finds have no label.
    Every labelled window is used, as often as it occurs: those of three texts in four, by a hash, add to the sums from which
    the output layer is solved, and all others to the histograms that calibrate it and set its threshold; where the three
    parts or the fourth lack secrets or ordinary runs, all texts serve for both. Sums and histograms do not depend on how the rows
    are dealt, and only they come to the driver, at one size. None without a finding, or without ordinary runs.
    """
    each, net = -(-DRAWN // max(1, docs.count())), untrained()
    held = F.crc32(F.col("text").cast("binary")) % 4 == 3
    products, rest = _products(docs.where(~held), net, each), docs.where(held)
    if "finding" not in products or "joined" not in products:
        products, rest = _products(docs, net, each), docs
    if "finding" not in products or "joined" not in products:
        return None
    net = fit(net, products)
    counts = _histogram(rest, net, each)
    return calibrate(net, counts if "joined" in counts else _histogram(docs, net, each))


def _line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{(*KINDS, ADDED)[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_network) for each row of ``docs``.

    The fixed patterns' spans always stay. Every other run of LEAST or more key characters is scored with its surroundings
    by a network trained as ``train`` says, and spans of kind ``network`` at or above its threshold are added, save where
    they meet a base span; a candidate of several windows takes its best. Without findings there is no network and nothing
    is added. Null texts count as empty, whole texts are read, rows are independent, and other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    net = train(docs.select("text"))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts, prints, lines, n_added = [], [], [], []
        bases, more, waiting, ready = [], [], [], 0

        def judge() -> None:
            """Scores the windows that wait, of many texts at a time."""
            sure = net.score(np.concatenate([codes for *_, codes in waiting])) >= net.threshold
            at = 0
            for i, part, which, _ in waiting:
                more[i] |= {part[k] for k in which[sure[at : at + len(which)]].tolist()}
                at += len(which)
            waiting.clear()

        for text in batch.column("text").to_pylist():
            own = base_spans(text)
            spans = candidates(text, own) if net is not None else []
            bases.append(own)
            more.append(set())
            for i in range(0, len(spans), 4096):
                part = spans[i : i + 4096]
                a = max(0, part[0][0] - BEFORE)
                which, codes = windows(text[a : part[-1][1] + AFTER], [(s - a, e - a) for s, e in part])
                waiting.append((len(more) - 1, part, which, codes))
                ready += len(which)
                if ready >= 4096:
                    judge()
                    ready = 0
        if waiting:
            judge()
        for own, added in zip(bases, more, strict=True):
            counts.append([sum(k == kind for _, k, _ in own) for kind in range(3)])
            prints.append(hashlib.sha256(_line(own).encode()).hexdigest())
            lines.append(_line([*own, *((a, 3, b) for a, b in added)]))
            n_added.append(len(added))
        columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *columns, pa.array(prints, pa.string()), pa.array(lines, pa.string()), pa.array(n_added, pa.int64())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_network"],
        )

    return docs.mapInArrow(over_batches(work, "text", 1 << 20), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_network long")
