"""What a question asks for: its intent, how far to look, and the names it mentions. One question is one row, so this runs on the driver.

A question is cut into tokens once. Clauses that an excluding word opens are set aside; the stems of the other words vote for
intents, and names are told by their spelling.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stems that tell an intent, the intent that settles a question with several of them first.
CUES: dict[str, frozenset[str]] = {
    "debug": frozenset("why debug broken bug crash fail failure exception error throw slow hang leak deadlock stuck wrong".split()),
    "impact": frozenset("impact break regress regression depend dependent dependency affect consumer caller downstream".split()),
    "review": frozenset("review audit critique assess".split()),
    "test": frozenset("test spec coverage".split()),
    "refactor": frozenset("refactor simplify tidy extract cleanup restructure".split()),
    "rename": frozenset("rename format typo spell reword capitalize".split()),
    "explain": frozenset("explain describe what how summarize summarise overview".split()),
}
GREETINGS = frozenset("hi hey hello thanks thank you ok okay cool".split())
#: Levels without and with a name in the question.
LEVELS = {"chitchat": (0, 0), "debug": (3, 3), "impact": (4, 4), "review": (3, 3), "test": (4, 3), "refactor": (2, 2), "rename": (0, 1), "explain": (1, 2), "unknown": (1, 1)}
EXCLUDING = frozenset("exclude ignore omit skip without not no".split())
RESUMING = frozenset("but while however when".split())
LISTING = frozenset(("and", "or"))
ENDINGS = ("ing", "ed", "es", "s")


@dataclass(frozen=True)
class Reading:
    """A question read: ``level`` from 0 (nothing to look up) to 5 (a whole change with what depends on it)."""

    intent: str
    level: int
    paths: list[str] = field(default_factory=list)
    symbols: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)


def stems(word: str) -> set[str]:
    """A word and what is left of it without a common ending, with and without a final e, and y for i."""
    low = word.lower()
    out = {low}
    for end in ENDINGS:
        if low.endswith(end) and len(low) - len(end) >= 3:
            root = low[: -len(end)]
            out |= {root, root + "e", root[:-1] + "y" if root.endswith("i") else root}
    return out


def clauses(question: str) -> tuple[list[str], list[str]]:
    """The tokens that a question is about, and the terms that it excludes."""
    about: list[str] = []
    excluded: list[list[str]] = []
    inside = False
    for sentence in re.split(r"[;\n]|[.!?](?=\s|$)", question):
        inside = False
        for token in re.findall(r"[^\s,]+|,", sentence):
            kinds = stems(token)
            if inside and kinds & RESUMING:
                inside = False
            elif inside and (token == "," or kinds & LISTING):
                excluded.append([])
            elif inside:
                excluded[-1].append(token)
            elif kinds & EXCLUDING:
                inside = True
                excluded.append([])
            else:
                about.append(token)
    return about, [" ".join(t) for t in excluded if t]


def is_path(token: str) -> bool:
    """Whether a token is spelt like a file: a name, a dot and one to eight letters."""
    name, dot, ending = token.rpartition(".")
    return bool(dot and name and name[-1] not in "./") and ending.isascii() and ending.isalpha() and len(ending) <= 8 and all(c.isalnum() or c in "_@./-" for c in name) and ("/" in name or ending.islower())


def is_name(part: str) -> bool:
    return part.replace("$", "_").isidentifier()


def named(tokens: list[str]) -> tuple[list[str], list[str]]:
    """Paths and symbols among tokens: symbols stand in backticks, end in parentheses or join names by a dot, a hash or two colons."""
    paths: dict[str, None] = {}
    symbols: dict[str, None] = {}
    for token in tokens:
        quoted = len(token) > 2 and token.strip(",:;?!'\"").startswith("`")
        bare = token.strip("`,:;?!'\"")
        called = bare.endswith("()")
        parts = re.split(r"\.|#|::", bare[:-2] if called else bare)
        if not quoted and not called and is_path(bare) and ("/" in bare or len(parts) == 2 and "#" not in bare and ":" not in bare and bare.islower()):
            paths[bare] = None
        elif all(map(is_name, parts)) and (quoted or called or len(parts) > 1):
            symbols[bare] = None
    return list(paths), list(symbols)


def has_trace(question: str) -> bool:
    """Whether a line of a question is a call in a stack trace: ``at name (place:line)``."""
    for line in question.splitlines():
        words = line.split()
        place = words[-1].rstrip(")").rpartition(":")[2] if words else ""
        if len(words) > 2 and words[0] == "at" and words[-1].endswith(")") and place.isdigit():
            return True
    return False


def read_question(question: str, has_diff: bool = False, level: int | None = None) -> Reading:
    """Intent from what the question wants, not from what it excludes; a given ``level`` overrides the one found."""
    about, excluded = clauses(question)
    words = [w for t in about for w in re.findall(r"[^\W\d_]+", t)]
    votes = {name for name, cues in CUES.items() for w in words if stems(w) & cues}
    if words and all(w.lower() in GREETINGS for w in words):
        intent = "chitchat"
    else:
        intent = next((name for name in CUES if name in votes), "unknown")
    paths, symbols = named(about)
    if level is None and has_trace(question):
        level = 3
    if level is None:
        whole = has_diff and intent in ("review", "impact", "test")
        level = 5 if whole else LEVELS[intent][bool(paths or symbols)]
    return Reading(intent, level, paths, symbols, excluded)


def flat(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def plain(text: str) -> str:
    return re.sub(r"[^a-z0-9]", "", text.lower())


def symbol_score(label: Column, source_file: Column, symbols: list[str]) -> Column:
    """How well a node fits the symbols a question names: 4 whole name, 3.5 method in a file of its class, 3 the method, 2.5 the bare name."""
    name, path = flat(label), flat(source_file)
    last = flat(F.element_at(F.split(F.regexp_replace(label, r"\(\)$", ""), r"[.#]|::"), -1))
    scores = [F.lit(0.0)]
    for symbol in symbols:
        parts = [plain(p) for p in re.split(r"\.|#|::", symbol) if plain(p)]
        if not parts:
            continue
        hit = F.when(name == "".join(parts), 4.0)
        if len(parts) > 1:
            hit = hit.when((last == parts[-1]) & path.contains(parts[-2]), 3.5)
        scores.append(hit.when(last == parts[-1], 3.0 if len(parts) > 1 else 2.5).otherwise(0.0))
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def identifiers(question: str, known: list[str] | None = None) -> list[tuple[str, int]]:
    """Compound names in a question other than the ``known`` ones, flattened, with their number of words."""
    out: dict[str, int] = {}
    for word in re.findall(r"[A-Za-z0-9_./-]+", question):
        if re.search(r"[A-Za-z]", word) and (re.search(r"[_./-]", word) or re.search(r"[a-z][A-Z]", word)):
            pieces = [p for p in re.split(r"[\s_\\\-./,:;!?]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", word)) if len(p) > 1]
            if len(pieces) >= 2 and len(plain(word)) >= 6 and plain(word) not in map(plain, known or []):
                out.setdefault(plain(word), len(pieces))
    return list(out.items())


def identifier_score(label: Column, source_file: Column, names: list[tuple[str, int]]) -> Column:
    """The best of the names: 1.1 in the label, 0.8 in the path only, more for both, an equal label and longer names; 1.75 at most."""
    name, path = flat(label), flat(source_file)
    scores = [F.lit(0.0)]
    for key, words in names:
        inside, near = name.contains(key), path.contains(key)
        base = F.when(inside, 1.1 + F.when(near, 0.35).otherwise(0.0)).otherwise(F.lit(0.8 + 0.25))
        full = base + F.when(name == key, 0.2).otherwise(0.0) + min(0.35, max(0, words - 2) * 0.15)
        scores.append(F.when(inside | near, F.least(F.lit(1.75), full)).otherwise(0.0))
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def quality_score(weights: list[Column]) -> Column:
    """1 less a tenth of the weights of the rules that were broken, between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - sum(weights, F.lit(0)) / 10))
