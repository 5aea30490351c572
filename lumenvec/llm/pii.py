"""Personal data: base patterns, and spans that a boosted classifier adds.

Four kinds: email, ip, card, phone. Base spans follow fixed patterns and always stay. Besides, high-recall generators
propose further spans (obfuscated addresses, IPv6, cards and phones written in other ways); gradient-boosted trees score each by its
format and its context, and those at or over the calibrated threshold of their kind are added unless they meet a base span or
a better candidate. The trees are trained here, on seeded synthetic examples; thresholds are the lowest that keep
min_precision on the part of the examples that the trees didn't see.

Every pattern is linear in the text: unbounded runs are possessive or found from their one fixed character, and the
generators have bounded runs. Work is row by row, without a shuffle.

Defined cases: a null text counts as empty and has no span (redaction leaves null as it is); an empty text has none either; a very long text
is searched whole, in time in proportion to its length, whatever its runs of digits or letters; of candidates with equal scores the first in the text, then by kind, wins;
repeated rows get equal results; a null id stays null; an empty table gives no rows; columns other than the id and the text are carried or
left out, never read, so their names may be any.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, spark_struct, unused

KINDS = ("email", "ip", "card", "phone")
FIELDS = {"n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string", "n_spans": "bigint", "n_added": "bigint"}
Span = tuple[int, int, int]  # start, place in KINDS, end

_domain = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digits = re.compile(r"[0-9]+").findall


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base spans in their order."""
    out: list[Span] = []
    end = 0
    for m in _domain.finditer(text):
        at = start = m.start()
        while start > end and text[start - 1] in _local:  # back to the end of the match before, or of the run
            start -= 1
        if start < at:
            end = m.end()
            out.append((start, 0, end))
    if any(x in text for x in "0123456789"):
        for m in _ip.finditer(text):
            if all(len(x) <= 3 and int(x or "0") <= 255 for x in (part.lstrip("0") for part in _digits(m[0]))):
                out.append((m.start(), 1, m.end()))
        for m in _card.finditer(text):
            if 14 <= m.end() - m.start() <= 37 and 14 <= len(d := "".join(_digits(m[0]))) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        for m in _phone.finditer(text):
            if 10 <= sum(map(len, _digits(m[0]))) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


#: High-recall generators: kind and pattern. A candidate is what the pattern covers.
GENERATORS = tuple((KINDS.index(k), re.compile(p)) for k, p in (
    ("email", r"(?<![\w.%+-])[\w.%+-]{1,64} ?(?:@|\(at\)|\[at\]|\{at\}) ?[\w-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[\w-]{1,63}){1,4}"),
    ("email", r"(?<![\w.%+-])[\w.%+-]{1,64} at [\w-]{1,63}(?: dot [\w-]{1,63}){1,3}(?!\w)"),
    ("ip", r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6}(?![\w:])"),
    ("ip", r"(?<![\w.])[0-9]{1,3}(?:(?:\[\.\]|\.)[0-9]{1,3}){3}(?![\w.])"),
    ("card", r"(?<![\w.])[0-9]{3,6}(?:[ ./_-]?[0-9]{2,6}){2,5}(?!\w)"),
    ("phone", r"(?<![\w.+])(?:00[0-9]{1,3}[ .-]?)?\(?[0-9]{2,5}\)?[ ./-]{1,2}[0-9]{3,4}[ .-][0-9]{3,5}(?!\w)"),
    ("phone", r"\+[ (]{0,2}[0-9]{1,3}[ ()./-]{0,3}[0-9]{2,4}(?:[ ()./-]{1,3}[0-9]{2,4}){2,4}(?!\w)"),
))

#: Words before a span that tell its kind, and some that tell against personal data.
HINTS = (("mail", "e-mail", "email", "contact", "write"), ("ip", "host", "server", "addr", "address"), ("card", "visa", "mastercard", "amex", "credit", "pan"), ("tel", "phone", "call", "mobile", "fax", "telefon"))
AGAINST = ("version", "v", "release", "isbn", "order", "invoice", "id", "no", "section", "serial", "sku", "date", "ref", "at", "time")
NAMES = ("kind", "length", "digits", "letters", "separators", "groups", "longest_group", "luhn", "octets", "has_at", "tld", "dots", "colons", "parens", "plus", "hint", "against", "before", "after", "card_prefix", "first_group")


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    s = text[start:end]
    groups = _digits(s)
    digits = "".join(groups)
    before = re.findall(r"\w+", text[max(0, start - 24) : start].lower())[-2:]
    letters = sum(map(str.isalpha, s))
    tail = re.split(r"[^A-Za-z]+", s)[-1]
    at = lambda i: 0 if not 0 <= i < len(text) or text[i].isspace() else 1 if text[i].isalpha() else 2 if text[i].isdigit() else 3
    return [
        kind, len(s), len(digits), letters, len(s) - len(digits) - letters, len(groups), max(map(len, groups), default=0), bool(digits) and luhn(digits), len(groups) == 4 and all(int(x) < 256 for x in groups),
        "@" in s or "at" in s, len(tail), s.count("."), s.count(":"), s.count("("), "+" in s or s.startswith("00"), any(w in HINTS[kind] for w in before), any(w in AGAINST for w in before), at(start - 1), at(end), digits[:1] in "3456", len(groups[0]) if groups else 0,
    ]


@dataclass
class Forest:
    """Boosted regression trees of one depth for the logistic loss. A tree: features and cuts in heap order, then leaf values."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    prior: float
    thresholds: tuple[float, ...] = (0.5,) * len(KINDS)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.prior)
        for which, cut, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < len(which):
                at = 2 * at + 1 + (x[np.arange(len(x)), which[at]] > cut[at])
            raw += leaf[at - len(which)]
        return 1 / (1 + np.exp(-raw))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.3, l2: float = 1.0) -> Forest:
    """Newton boosting; each split takes the feature and cut with the largest gain."""
    prior = float(np.log(y.mean() / (1 - y.mean())))
    raw, trees = np.full(len(y), prior), []
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[:-1])) for j in range(x.shape[1])]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        which, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for node in range(2**depth - 1):
            own = np.flatnonzero(at == node)
            best = 1e-9
            for j in range(x.shape[1]):
                bins = np.searchsorted(cuts[j], x[own, j], side="left")  # x > cuts[b - 1] for bins of b and more
                gs = np.bincount(bins, g[own], len(cuts[j]) + 1)
                hs = np.bincount(bins, h[own], len(cuts[j]) + 1)
                gl, hl = np.cumsum(gs)[:-1], np.cumsum(hs)[:-1]
                gain = gl**2 / (hl + l2) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + l2) - gs.sum() ** 2 / (hs.sum() + l2)
                if len(gain) and gain.max() > best:
                    best, which[node], cut[node] = gain.max(), j, cuts[j][gain.argmax()]
            at[own] = 2 * node + 1 + (x[own, which[node]] > cut[node])
        at -= 2**depth - 1
        leaf = rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + l2)
        raw += leaf[at]
        trees.append((which, cut, leaf))
    return Forest(trees, prior)


def _check_digit(digits: str) -> str:
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def example(rng: random.Random) -> tuple[str, int, int, int, bool]:
    """A made text with one span: text, start, kind, end, whether it is personal data."""
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    kind, good = rng.randrange(4), rng.random() < 0.5
    hint = rng.choice(HINTS[kind]) if rng.random() < 0.3 else word()
    if kind == 0:
        at, dot = rng.choice(((" at ", " dot "), ("(at)", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" @ ", "."), ("@", ".")))
        s = f"{word()}{rng.choice(('', '.' + word(), num(2)))}{at}{word()}{dot}{rng.choice(('com', 'org', 'net', 'de', 'fr', 'io', 'info'))}"
        if not good:
            s, hint = rng.choice((f"{word()} at {word()} dot {word()}{word()}", f"{word()}@{num(3)}.{num(2)}", f"{word()} @ {num(2)} .{num(2)}", f"{word()} @ {word()}. {word()}ing")), word()
    elif kind == 1:
        s = ":".join(f"{rng.randrange(65536):x}" for _ in range(8)) if rng.random() < 0.7 else rng.choice(("[.]",)).join(str(rng.randint(1, 255)) for _ in range(4))
        if not good:
            s = rng.choice((f"{num(2)}:{num(2)}:{num(2)}", f"{rng.randint(256, 999)}.{num(1)}.{num(2)}.{num(3)}", ":".join(num(2) for _ in range(4)), ":".join(num(1) for _ in range(5)), f"{rng.randint(1, 9)}.{rng.randint(256, 999)}.{num(1)}.{num(3)}"))
    elif kind == 2:
        d = _check_digit(rng.choice(("4", "51", "53", "37", "6011")) + num(12))[:16]
        d = _check_digit(d[:15])
        s = rng.choice((".", "/", "_")).join((d[:4], d[4:8], d[8:12], d[12:]))
        if not good:
            d = num(rng.choice((9, 10, 11, 12, 13, 16, 16, 18, 20)))
            d = d[:-1] + str((int(d[-1]) + luhn(d)) % 10)
            s = rng.choice((d, d, rng.choice(" -./_").join(d[i : i + 4] for i in range(0, len(d), 4)), f"{num(4)}-{num(2)}-{num(2)}"))
    else:
        s = rng.choice((f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"00{num(2)} {num(3)} {num(3)} {num(4)}", f"+ {num(2)} ({num(3)}) {num(3)} {num(4)}", f"+{num(2)}/{num(3)}/{num(3)}/{num(4)}"))
        if not good:
            s = rng.choice((f"{num(4)}-{num(4)} {num(4)}", f"{num(2)} {num(3)} {num(3)}", f"{num(4)} {num(4)} {num(4)}", f"{num(5)} {num(3)}-{num(3)}", f"{num(4)}-{num(3)}-{num(5)}"))
    if not good and rng.random() < 0.4:
        hint = rng.choice(AGAINST)
    lead, tail = f"{word()} {word()} {hint}{rng.choice((' ', ': '))}", rng.choice((f" {word()} {word()}", ".", f", {word()}", f". {word()}"))
    return lead + s + tail, len(lead), kind, len(lead) + len(s), good


@lru_cache(maxsize=2)
def trained(n_examples: int = 6000, seed: int = 11, min_precision: float = 0.995) -> Forest:
    """Train on three quarters of the examples; set each kind's threshold on the rest."""
    rng = random.Random(seed)
    made = [example(rng) for _ in range(n_examples)]
    x = np.array([features(t, a, k, b) for t, a, k, b, _ in made], float)
    y = np.array([good for *_, good in made], float)
    n = 3 * n_examples // 4
    forest = boost(x[:n], y[:n])
    score, kind, true = forest.score(x[n:]), x[n:, 0], y[n:]
    found = []
    for k in range(len(KINDS)):
        order = np.argsort(-score[kind == k], kind="stable")
        s, right = score[kind == k][order], true[kind == k][order]
        good = np.flatnonzero(np.cumsum(right) >= min_precision * np.arange(1, len(s) + 1))
        found.append(max(0.5, float(s[good[-1]])) if len(good) else 1.1)
    forest.thresholds = tuple(found)
    return forest


def candidates(text: str) -> set[Span]:
    """Overlapping spans that may be personal data."""
    return {(m.start(), kind, m.end()) for kind, pattern in GENERATORS for m in pattern.finditer(text)}


def find(text: str, forest: Forest) -> tuple[list[Span], list[Span]]:
    """Base spans, and those that the trees add."""
    base, added = base_spans(text), []
    tried = [c for c in sorted(candidates(text)) if not any(c[0] < b[2] and b[0] < c[2] for b in base)] if len(base) < 50 else _apart(sorted(candidates(text)), base)
    if tried:
        score = forest.score(np.array([features(text, *c) for c in tried], float))
        good = [(-p, c) for p, c in zip(score, tried, strict=True) if p >= forest.thresholds[c[1]]]
        taken = bytearray(0)
        for _, c in sorted(good):
            if not taken:
                taken = bytearray(len(text) + 1)
            if not any(taken[c[0] : c[2]]):
                taken[c[0] : c[2]] = b"\1" * (c[2] - c[0])
                added.append(c)
    return base, sorted(added)


def _apart(found: list[Span], base: list[Span]) -> list[Span]:
    """Those found that meet no base span, in time linear in the text."""
    taken = bytearray(max(b[2] for b in base) + 1)
    for a, _, b in base:
        taken[a:b] = b"\1" * (b - a)
    return [c for c in found if not any(taken[c[0] : c[2]])]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def report(text: str | None, forest: Forest) -> tuple:
    """The values of FIELDS: counts and checksum of the base spans, all spans, how many these are, and how many were added."""
    base, added = find(text or "", forest)
    counts = [sum(k == n for _, k, _ in base) for n in range(len(KINDS))]
    return (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + added)), len(base) + len(added), len(added))


def redact(text: str, forest: Forest) -> str:
    """Each span, overlapping ones together, becomes the name of its first kind in brackets."""
    base, added = find(text, forest)
    out, end, start = [], 0, -1
    for a, k, b in sorted(base + added):
        if start >= 0 and a < end:
            end = max(end, b)
            continue
        out += [text[end:a], f"[{KINDS[k].upper()}]"]
        start, end = a, b
    return "".join([*out, text[end:]])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and FIELDS for each row of docs."""
    forest = trained()

    @F.arrow_udf(spark_struct(FIELDS))
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield arrow_rows(FIELDS, [report(t.as_py(), forest) for t in texts])

    (found,) = unused(docs, "_found")
    return docs.select(F.col(id_col), udf(F.col(text_col)).alias(found)).select(id_col, f"{found}.*")


def redacted(text: Column) -> Column:
    """The text without personal data; null stays null."""
    forest = trained()

    @F.arrow_udf("string")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([None if (t := x.as_py()) is None else redact(t, forest) for x in texts], pa.string())

    return udf(text)
