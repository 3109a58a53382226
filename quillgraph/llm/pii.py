"""Personal data by a semi-Markov conditional random field over candidate segments, on top of exact patterns.

Words with a digit or an at sign form islands. A segment is a run of at most ``LONGEST`` words of one island; features
of the whole segment (its shape, digit groups, check digit, the word before it) score it for each type. Dynamic
programming over segment ends, with the segment length bounded, sums over all ways to cut an island into segments and
other words for training, and finds the best way, boundaries and types together, for prediction. The field is
trained here, on generated examples. Matches of the exact patterns always stay; the field adds segments that
overlap none of them.
"""

from __future__ import annotations

import bisect
import random
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LONGEST = 5
EXAMPLES = 700

Span = tuple[str, int, int]


def digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def luhn(number: str) -> bool:
    """Whether the last digit of a row of digits is its check digit."""
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


PATTERNS: dict[str, tuple[str, re.Pattern, Callable[[str], bool]]] = {
    "email": ("@", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    # a match can't start inside a row of digits: what follows is the same from its first digit
    "ip": ("", re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))),
    "card": ("", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 16 <= len(d := digits(s)) <= 19 and luhn(d)),
    "phone": ("+", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 8 <= len(digits(s)) <= 15),
}
DIGIT = re.compile(r"[0-9]")
MARKED = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")  # tried once a word, however long
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The e-mail pattern's matches, found from the at signs instead of from every word."""
    pattern, at, done = PATTERNS["email"][1], text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        if m := start < at and pattern.match(text, start):
            yield m.span()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """What the exact patterns match, by kind and start."""
    out: list[Span] = [("email", *s) for s in emails(text)]
    if DIGIT.search(text):
        for kind in KINDS[1:]:
            mark, pattern, holds = PATTERNS[kind]
            if mark in text:
                out += [(kind, *m.span()) for m in pattern.finditer(text) if holds(m.group())]
    return out


CONTEXT = {"email": {"mail", "email", "e-mail", "contact"}, "ip": {"ip", "host", "server", "address"}, "card": {"card", "visa", "credit", "payment"}, "phone": {"tel", "phone", "call", "mobile", "fax"}}
FEATURES = 26


def core(text: str, start: int, end: int) -> tuple[int, int]:
    """A segment without the punctuation around it."""
    while start < end and text[start] in "\"'<>[]{},;:!?.=|":
        start += 1
    while start < end and text[end - 1] in "\"'<>[]{},;:!?.=|":
        end -= 1
    if start < end and text[end - 1] == ")" and "(" not in text[start:end]:
        end -= 1
    if start < end and text[start] == "(" and ")" not in text[start:end]:
        start += 1
    return start, end


@lru_cache(maxsize=4096)
def shape(s: str) -> tuple[float, ...]:
    """Features of a segment's own characters."""
    number = digits(s)
    n, letters = len(number), sum(c.isalpha() for c in s)
    groups = re.findall(r"[0-9]+", s)
    parts = s.split(".")
    plain = letters == 0 and all(c.isdigit() or c in " -().+" for c in s)
    quad = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
    name, _, host = s.partition("@")
    mail = bool(LOCAL.match(name)) and bool(re.fullmatch(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", host))
    sizes = [len(g) for g in groups]
    local = sizes == [3, 3, 4]
    return tuple(float(x) for x in (
        1, "@" in s, mail, s.count("@") > 1, quad, quad and all(len(p) <= 3 and int(p) <= 255 for p in parts), len(parts) == 4, plain, s.startswith("+"),
        plain and s.startswith("+") and 8 <= n <= 15, plain and local, plain and 8 <= n <= 15 and len(groups) >= 3, plain and 15 <= n <= 19 and luhn(number), plain and 15 <= n <= 19,
        plain and len(groups) > 1 and all(x == 4 for x in sizes), len(groups) == 1, n < 7, n > 19, letters > 0, "(" in s, bool(re.fullmatch(r"(19|20)\d\d[-./]\d\d?[-./]\d\d?", s)),
    ))


BLOCK = 1024  # words whose segments are held at once for prediction


class Island:
    """The candidate segments of adjoining marked words, each with its features; those that start in a range of words."""

    def __init__(self, text: str, words: list[tuple[int, int]], before: str, first: int = 0, end: int | None = None) -> None:
        self.n, self.segments, rows = len(words), [], []
        context = before.lower().strip(":.,;=#")
        told = [float(context in CONTEXT[k]) for k in KINDS]
        for i in range(first, self.n if end is None else end):
            for j in range(i, min(self.n, i + LONGEST)):
                a, z = core(text, words[i][0], words[j][1])
                if a < z and z - a <= 80:
                    self.segments.append((i, j, a, z))
                    rows.append([*shape(text[a:z]), j > i, *(told if i == 0 else [0.0] * 4)])
        self.x = np.array(rows).reshape(-1, FEATURES)

    def forward(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Log sums over all cuttings before each place and after it, and over all."""
        ends: list[list[tuple[int, float]]] = [[] for _ in range(self.n)]
        starts: list[list[tuple[int, float]]] = [[] for _ in range(self.n)]
        for (i, j, _, _), s in zip(self.segments, np.logaddexp.reduce(scores, axis=1), strict=True):
            ends[j].append((i, s))
            starts[i].append((j, s))
        alpha, beta = np.zeros(self.n + 1), np.zeros(self.n + 1)
        for j in range(self.n):
            alpha[j + 1] = np.logaddexp.reduce([alpha[j], *(alpha[i] + s for i, s in ends[j])])
        for i in range(self.n - 1, -1, -1):
            beta[i] = np.logaddexp.reduce([beta[i + 1], *(beta[j + 1] + s for j, s in starts[i])])
        return alpha, beta, float(alpha[self.n])


def best(text: str, words: list[tuple[int, int]], before: str, weights: np.ndarray) -> list[Span]:
    """The segments of an island's best cutting. Features are held for ``BLOCK`` words at a time, so memory follows the words, not the segments."""
    n = len(words)
    value, back = [0.0], []
    ends: dict[int, list[tuple[int, float, Span]]] = {}
    for first in range(0, n, BLOCK):
        part = Island(text, words, before, first, min(n, first + BLOCK))
        scores = part.x @ weights
        top = scores.argmax(1)
        for (i, j, a, z), k, s in zip(part.segments, top.tolist(), scores[np.arange(len(top)), top].tolist(), strict=True):
            ends.setdefault(j, []).append((i, s, (KINDS[k], a, z)))
        for j in range(first, min(n, first + BLOCK)):
            v, step = value[j], None
            for i, s, span in ends.pop(j, ()):
                if value[i] + s > v:
                    v, step = value[i] + s, (i, span)
            value.append(v)
            back.append(step)
    out, j = [], n - 1
    while j >= 0:
        if back[j] is None:
            j -= 1
        else:
            i, span = back[j]
            out.append(span)
            j = i - 1
    return out[::-1]


def runs(text: str) -> Iterator[tuple[list[tuple[int, int]], str]]:
    """Runs of marked words with single spaces between them, and the word before each."""
    run: list[tuple[int, int]] = []
    for m in MARKED.finditer(text):
        if run and not (m.start() == run[-1][1] + 1 and text[run[-1][1]] in " \t"):
            yield run, _before(text, run[0][0])
            run = []
        run.append(m.span())
    if run:
        yield run, _before(text, run[0][0])


def _before(text: str, at: int) -> str:
    return (text[max(0, at - 40) : at].split() or [""])[-1]


def examples(n: int, seed: int = 7) -> Iterator[tuple[str, list[Span]]]:
    """Generated texts with their true spans: personal data in several forms, and numbers that are none."""
    rng = random.Random(seed)
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))

    def card(k: int, valid: bool = True) -> str:
        head = rng.choice("3456") + number(k - 2)
        return next(head + c for c in rng.sample("0123456789", 10) if luhn(head + c) == valid)

    def fours(s: str, by: str) -> str:
        return by.join(s[i : i + 4] for i in range(0, len(s), 4))

    true = {
        "email": [lambda: f"{word()}.{number(2)}@{word()}.example.{rng.choice(['com', 'org', 'net'])}", lambda: f"{word()}_{word()}@{word()}.org", lambda: f"{word()}+{word()}@mail{number(1)}.{word()}.co"],
        "ip": [lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))],
        "card": [lambda: card(16), lambda: fours(card(16), " "), lambda: fours(card(16), "-"), lambda: card(15), lambda: card(19)],
        "phone": [lambda: f"+1 ({number(3)}) 555-{number(4)}", lambda: f"({number(3)}) {number(3)}-{number(4)}", lambda: f"{number(3)}-{number(3)}-{number(4)}", lambda: f"+{rng.randint(20, 99)} {number(2)} {number(4)} {number(4)}", lambda: f"+{number(11)}"],
    }
    false = [
        lambda: f'"{rng.getrandbits(160):040x}"', lambda: number(rng.randint(1, 7)), lambda: f"{number(1)}.{number(2)}", lambda: f"20{number(2)}-0{rng.randint(1, 9)}-1{number(1)}", lambda: f"{number(1)}.{number(1)}.{number(2)}",
        lambda: card(16, False), lambda: f"{number(2)}:{number(2)}", lambda: f"v{number(1)}.{number(1)}", lambda: f"{number(2)}%", lambda: f"{number(2)}-{number(2)}", lambda: f"{rng.randint(300, 999)}.{number(2)}.{number(1)}.{number(1)}", lambda: f"@{word()}",
        lambda: f"{word()}{number(3)}", lambda: f"{number(3)},{number(3)}.{number(2)}", lambda: number(rng.randint(20, 30)), lambda: fours(number(8), " "), lambda: f"{number(1)}.{number(1)}.{number(1)}.{number(1)}.{number(1)}", lambda: number(rng.randint(8, 14)),
    ]
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            lead = rng.choice(["", word(), rng.choice(sorted(CONTEXT[rng.choice(KINDS)]))])
            text += f"{lead}{rng.choice([' ', ': '])}" if lead else ""
            if rng.random() < 0.5:
                kind = rng.choice(KINDS)
                s = rng.choice(true[kind])()
                spans.append((kind, len(text), len(text) + len(s)))
            else:
                s = rng.choice(false)()
            text += s + rng.choice([" ", ", ", f" {word()} ", ". "])
        yield text, spans


def train(n: int = EXAMPLES, rounds: int = 60, penalty: float = 0.05) -> np.ndarray:
    """Weights by features and kinds: Adam on the penalised likelihood of the true cuttings."""
    data = []
    for text, spans in examples(n):
        truth = {(a, z): KINDS.index(k) for k, a, z in spans}
        for island in (Island(text, *run) for run in runs(text)):
            gold = np.zeros((len(island.segments), len(KINDS)))
            for row, (_, _, a, z) in enumerate(island.segments):
                if (a, z) in truth:
                    gold[row, truth[a, z]] = 1
            data.append((island, gold))
    w, m, v = np.zeros((3, FEATURES, len(KINDS)))
    for step in range(1, rounds + 1):
        grad = -penalty * w
        for island, gold in data:
            if not len(island.segments):
                continue
            scores = island.x @ w
            alpha, beta, z = island.forward(scores)
            i, j = np.array([s[:2] for s in island.segments]).T
            grad += island.x.T @ (gold - np.exp(scores + (alpha[i] + beta[j + 1] - z)[:, None]))
        grad /= len(data)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w + 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def find(text: str, weights: np.ndarray) -> tuple[list[Span], list[Span]]:
    """The exact patterns' spans, and those with the field's additions, both by kind as listed and start."""
    if "@" not in text and not DIGIT.search(text):
        return [], []
    base = base_spans(text)
    taken: list[list[int]] = []  # merged, so that ends are sorted as starts are
    for a, z in sorted((a, z) for _, a, z in base):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], z)
        else:
            taken.append([a, z])
    more = []
    for run, before in runs(text):
        for k, a, z in best(text, run, before, weights):
            at = bisect.bisect_left(taken, [z]) - 1  # the last that starts before the segment's end
            if at < 0 or taken[at][1] <= a:
                more.append((k, a, z))
    order = lambda s: (KINDS.index(s[0]), s[1], s[2])
    return sorted(base, key=order), sorted(base + more, key=order)


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


SPANS = "array<struct<kind:string,start:long,end:long,exact:boolean>>"


def personal_data(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, spans)``, a row per input row.

    ``spans`` holds structs of kind, start and end (code points, end exclusive) and exact (whether a pattern, not the
    field, found it), by kind as in ``KINDS`` and start. A null text counts as empty. Repeated rows and null doc_ids
    are searched row by row, texts of any length whole. Other columns are ignored.
    """
    learnt = train() if weights is None else weights
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("exact", pa.bool_())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base, spans = find(text or "", learnt)
                known = set(base)
                rows.append([{"kind": k, "start": a, "end": z, "exact": (k, a, z) in known} for k, a, z in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(search, f"doc_id long, spans {SPANS}")


def exact_of(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["exact"] & (s["kind"] == kind)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text of the whole documents table."""
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["exact"])
    digest = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter("spans", exact_of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(digest(base).cast("binary"), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
