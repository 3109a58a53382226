"""Licence detection by Dice's coefficient over word bigrams, with size bounds on the templates.

A region is any run of words. With a bigrams in it and b in a template, 2 * min(a, b) / (a + b) bounds the coefficient, so a
template is compared only with runs of its own size bounds, and only where enough of its bigrams lie within so
many words. There every run that begins and ends with one of them is measured: another can only be less similar.
Of all runs and templates the best is taken, then the best of what it leaves, and so on.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import chunks, mix, words
from .license_templates import TEMPLATES

THRESHOLD = 0.8
TABLE_BITS = 18

#: Letters, digits and all bytes of non-ASCII characters belong to words; the rest separates them.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def bigrams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word with its next one, and where each word begins."""
    h, begin, _ = words(data, BETWEEN)
    with np.errstate(over="ignore"):
        return mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]), begin


class Template:
    """A licence's bigrams with their counts, and the sizes of the regions that it may match."""

    def __init__(self, name: str, grams: np.ndarray, threshold: float) -> None:
        self.name, self.size = name, len(grams)
        self.grams, self.counts = np.unique(grams, return_counts=True)
        share = threshold / (2 - threshold)
        self.longest = int(self.size / share + 1e-9)
        self.needed = int(np.ceil(threshold * (np.ceil(share * self.size - 1e-9) + self.size) / 2 - 1e-9))


class Templates:
    """All templates, and a table of the places that their bigrams hash to."""

    def __init__(self, rows: tuple[tuple[str, str], ...], threshold: float) -> None:
        told = ((n, bigrams(np.frombuffer(t.encode() + b"\n", np.uint8))[0]) for n, t in rows)
        self.rows = [Template(n, g, threshold) for n, g in told if len(g)]
        self.threshold = threshold
        self.grams = np.unique(np.concatenate([t.grams for t in self.rows])) if self.rows else np.zeros(0, np.uint64)
        self.some = np.zeros(1 << TABLE_BITS, bool)
        self.some[self.slot(self.grams)] = True
        self.holds = [np.isin(self.grams, t.grams) for t in self.rows]
        self.caps = []
        for t in self.rows:
            cap = np.zeros(len(self.grams), int)
            cap[np.searchsorted(self.grams, t.grams)] = t.counts
            self.caps.append(cap)

    @staticmethod
    def slot(grams: np.ndarray) -> np.ndarray:
        return (grams >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of bigrams that some template has, and which ones they are."""
        at = np.flatnonzero(self.some[self.slot(grams)])
        if not len(self.grams):
            return at[:0], at[:0]
        which = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        known = self.grams[which] == grams[at]
        return at[known], which[known]


class Hits:
    """Where one text may hold one template: places of its bigrams, and for each the place that lies as many occurrences back as count."""

    def __init__(self, template: Template, place: np.ndarray, which: np.ndarray, cap: np.ndarray, threshold: float) -> None:
        self.template, self.place, self.threshold = template, place, threshold
        self.before = np.full(len(place), -1)
        order = np.lexsort((place, which))
        rank, caps = np.arange(len(order)), cap[which[order]]
        begin = np.maximum.accumulate(np.where(np.append(True, np.diff(which[order]) != 0), rank, 0))
        back = rank - caps
        inside = back >= begin
        self.before[order[inside]] = order[back[inside]]

    def best(self, i: int, limit: int) -> tuple[float, int] | None:
        """The highest coefficient of the runs that begin at hit ``i`` and end before word bigram ``limit``, and the last hit of the longest such."""
        first = int(self.place[i])
        end = int(np.searchsorted(self.place, min(limit, first + self.template.longest)))
        if end - i < self.template.needed:
            return None
        shared = np.cumsum(self.before[i:end] < i)
        dice = 2 * shared / (self.place[i:end] - first + 1 + self.template.size)
        k = len(dice) - 1 - int(dice[::-1].argmax())
        return (float(dice[k]), i + k) if dice[k] >= self.threshold else None


def scan_text(place: np.ndarray, which: np.ndarray, templates: Templates) -> list[tuple[str, int, int, float]]:
    """``(licence, first word, last word, coefficient)`` of one text's hits: the best run, then the best that doesn't overlap it, and so on.

    Of equal ones the longer is better, then the earlier, then the first by name.
    """
    found: list[Hits] = []
    heap: list[tuple[float, int, int, str, int, int]] = []

    def offer(t: int, i: int, limit: int) -> None:
        if told := found[t].best(i, limit):
            first, last = int(found[t].place[i]), int(found[t].place[told[1]])
            heapq.heappush(heap, (-told[0], first - last, first, found[t].template.name, t, i))

    for template, holds, cap in zip(templates.rows, templates.holds, templates.caps, strict=True):
        own = holds[which]
        p, n = place[own], template.needed
        if len(p) < n or not (p[n - 1 :] - p[: len(p) - n + 1] < template.longest).any():
            continue
        found.append(Hits(template, p, which[own], cap, templates.threshold))
        for i in np.flatnonzero(p[n - 1 :] - p[: len(p) - n + 1] < template.longest).tolist():
            offer(len(found) - 1, i, 1 << 62)
    taken: list[tuple[int, int]] = []  # words, both ends inclusive
    out = []
    while heap:
        minus, shorter, first, name, t, i = heapq.heappop(heap)
        last = first - shorter + 1  # a bigram's second word
        at = bisect.bisect_right(taken, (first, 1 << 62))
        if at and taken[at - 1][1] >= first:
            continue
        if at < len(taken) and taken[at][0] <= last:
            offer(t, i, taken[at][0] - 1)
            continue
        taken.insert(at, (first, last))
        out.append((name, first, last, round(-minus, 6)))
    return sorted(out, key=lambda x: x[1])


FOUND = "doc_id long, license string, first_line int, last_line int, dice double"


def _scan(batches: Iterator[pa.RecordBatch], templates: Templates) -> Iterator[pa.RecordBatch]:
    least = min((t.needed for t in templates.rows), default=0)
    for batch in batches:
        for a, b in chunks(batch, "text"):
            part = batch.slice(a, b - a)
            raw = [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()]
            starts = np.zeros(len(raw) + 1, np.int64)
            np.cumsum([len(x) + 1 for x in raw], out=starts[1:])
            data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
            grams, begin = bigrams(data)
            at, which = templates.hits(grams)
            doc = np.searchsorted(starts, begin[at], "right") - 1
            inside = begin[np.minimum(at + 1, len(begin) - 1)] < starts[doc + 1] if len(at) else at.astype(bool)
            at, which, doc = at[inside], which[inside], doc[inside]
            breaks = np.flatnonzero(data == 10)
            ids, rows = part.column("doc_id").to_pylist(), []
            edge = np.flatnonzero(np.append(True, np.diff(doc) != 0))[: len(doc)]
            for x, y in zip(edge.tolist(), [*edge[1:].tolist(), len(doc)][: len(edge)], strict=True):
                if y - x < least:
                    continue
                d = int(doc[x])
                zero = int(np.searchsorted(breaks, starts[d]))
                for name, first, last, dice in scan_text(at[x:y], which[x:y], templates):
                    lines = np.searchsorted(breaks, begin[[first, last]]) - zero
                    rows.append((ids[d], name, int(lines[0]), int(lines[1]), dice))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "license", "first_line", "last_line", "dice"])


def licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, license, first_line, last_line, dice)``, a row per region that matches.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased; a region is a run of words, within a
    line or over several, and the lines of its first and last word are numbered from 0. Regions don't overlap: the best comes
    first, of equal ones the longer, the earlier and the first by name. Null, empty and other texts without a match give no row; repeated
    rows and null doc_ids are scanned row by row; texts of any length are scanned whole. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(partial(_scan, templates=Templates(templates, threshold)), FOUND)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence regions in the whole documents table."""
    return licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
