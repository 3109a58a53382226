"""Benchmark decontamination by the q-gram lemma, with banded alignment as the proof.

An item of m characters that lies in a text with at most e edits shares at least m + 1 - q * (e + 1) of its q-grams
with it, on diagonals that differ by at most e. Shared q-grams are counted in overlapping bands of diagonals; the
bands that reach the bound are aligned with the item inside the band, and kept if the edits stay in the budget.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import chunks
from .scratch import materialize

Q = 12
FINE = 5  # the length of the grams that a candidate region is tested with before it is aligned
EDIT_RATE = 0.07
BLOCK_CHARS = 4 << 20  # characters of benchmark items sent to the executors at once
FILTER_BITS = 22
NOTHING = 0xFFFFFFFF  # no character
FAR = 1 << 40  # more than any place

FOLD = np.arange(0x250, dtype=np.uint32)
for _c in range(0x250):
    _l = chr(_c).lower()
    FOLD[_c] = 32 if chr(_c).isspace() else ord(_l) if len(_l) == 1 else _c


def folded(text: str) -> np.ndarray:
    """Code points, lower-cased and with white space as spaces; every character keeps its place."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 0x250, FOLD[np.minimum(codes, 0x24F)], codes)


def trimmed(codes: np.ndarray) -> np.ndarray:
    """Folded characters without the spaces at both ends."""
    inside = np.flatnonzero(codes != 32)
    return codes[inside[0] : inside[-1] + 1] if len(inside) else codes[:0]


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q characters from each place on."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        base = np.uint64(0x9E3779B97F4A7C15)
        powers, width, power, rest, out, at = codes.astype(np.uint64), 1, base, q, None, 0
        while rest:  # widths double, so q characters take about 2 log q passes
            if rest & 1:
                piece = powers[at : at + n]
                out = piece.copy() if out is None else out * power + piece
                at += width
            rest >>= 1
            if rest:
                powers = powers[:-width] * power + powers[width:]
                width, power = 2 * width, power * power
        return out


class Items:
    """A block of benchmark items with the places of their q-grams.

    Grams that an item holds once are kept with their place. Of those that it repeats only the fact is kept: a text's
    grams could otherwise pair with all of their places.
    """

    def __init__(self, rows: list[tuple[int | None, str]], q: int, rate: float) -> None:
        told = [(n, c) for n, c in ((r[0], trimmed(folded(r[1]))) for r in rows) if len(c)]
        self.q, self.ids, self.codes = q, [n for n, _ in told], [c for _, c in told]
        self.sizes = np.array([len(c) for c in self.codes], int)
        self.budget = np.maximum(0, np.minimum(np.floor(rate * self.sizes).astype(int), (self.sizes - q) // q))
        self.bound = np.maximum(1, self.sizes + 1 - q * (self.budget + 1))
        self.fine = [grams(c, FINE) for c in self.codes]
        hashes = [grams(c, q) for c in self.codes]
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(told)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, int)
        order = np.lexsort((place, item, flat))
        flat, item, place = flat[order], item[order], place[order]
        same = (flat[1:] == flat[:-1]) & (item[1:] == item[:-1])
        begins, follows = np.append(True, ~same)[: len(flat)], np.append(same, False)[: len(flat)]
        once = begins & ~follows
        self.hash, self.item, self.place = flat[once], item[once], place[once]
        self.again, self.again_item = flat[begins & follows], item[begins & follows]
        self.some = np.zeros(1 << FILTER_BITS, bool)
        self.some[self.slots(flat)] = True
        self.short = [i for i, n in enumerate(self.sizes) if n < q]

    def likely(self, i: int, text: np.ndarray) -> bool:
        """Whether a window holds as many of an item's short grams, wherever they stand, as the lemma asks for."""
        least = self.sizes[i] + 1 - FINE * (self.budget[i] + 1)
        return least <= 0 or np.isin(self.fine[i], grams(text, FINE)).sum() >= least

    @staticmethod
    def slots(hashes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def aligned(item: np.ndarray, text: np.ndarray, budget: int) -> tuple[int, int, int] | None:
    """The least edits that turn ``item`` into a part of ``text``, and that part's start and end; None beyond the budget.

    ``text`` begins ``budget`` places before the band's first diagonal, so only cells in the band are kept: the row
    of item position i holds text positions i to i + width.
    """
    far = len(item) + len(text) + 1
    width = len(text) - len(item) + 1
    if width <= 0:
        text = np.concatenate((text, np.full(1 - width, NOTHING, np.uint32)))
        width = 1
    steps = np.arange(width)
    same = (np.lib.stride_tricks.sliding_window_view(text, len(item)) == item).all(1)
    if same.any():
        j = int(same.argmax())
        return 0, j, j + len(item)
    row, start = np.zeros(width, int), steps.copy()  # free start anywhere in the band
    for i, c in enumerate(item):
        diagonal = row + (text[i : i + width] != c)
        up = np.append(row[1:] + 1, far)  # an item character that the text lacks
        low, begin = np.where(up < diagonal, up, diagonal), np.where(up < diagonal, np.append(start[1:], 0), start)
        ahead = low - steps  # a run of text characters that the item lacks
        best = np.minimum.accumulate(ahead)
        source = np.maximum.accumulate(np.where(ahead == best, steps, 0))
        row, start = best + steps, begin[source]
        if row.min() > budget:
            return None
    j = int(row.argmin())
    return (int(row[j]), int(start[j]), j + len(item)) if row[j] <= budget else None


def window(codes: np.ndarray, a: int, z: int, low: int, high: int) -> np.ndarray:
    """Places ``a`` to ``z``; those outside the text, ``low`` to ``high``, hold a character that matches nothing.

    So every diagonal of the band exists at a text's ends too: an item's character there costs one edit, as if deleted.
    """
    out = np.full(z - a, NOTHING, np.uint32)
    x, y = max(a, low), min(z, high)
    if x < y:
        out[x - a : y - a] = codes[x:y]
    return out


def matches(known: np.ndarray, hashes: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places among ``near`` and indices of the sorted ``known`` hashes that are equal, all pairs of them."""
    lo, hi = np.searchsorted(known, hashes[near], "left"), np.searchsorted(known, hashes[near], "right")
    count = hi - lo
    return np.repeat(near, count), np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def regions(codes: np.ndarray, starts: np.ndarray, items: Items) -> Iterator[tuple[int, int, int, int, int]]:
    """``(document, item, edits, start, end)`` of the items found in the joined texts."""
    q = items.q
    hashes = grams(codes, q)
    near = np.flatnonzero(items.some[items.slots(hashes)])
    doc = np.searchsorted(starts, near, "right") - 1
    near = near[near + q < starts[doc + 1]]  # not across two texts
    place, at = matches(items.hash, hashes, near)
    item, diagonal = items.item[at], place - items.place[at] + FAR  # not negative
    doc, half = np.searchsorted(starts, place, "right") - 1, items.budget[item] + 1
    band = diagonal // half
    key = np.concatenate([np.stack((doc, item, band)), np.stack((doc, item, band - 1))], axis=1)
    found, number = np.unique(key.astype(np.int64), axis=1, return_counts=True)
    wanted = set(map(tuple, found[:, number >= items.bound[found[1]]].T.tolist()))
    place, at = matches(items.again, hashes, near)
    item, doc = items.again_item[at], np.searchsorted(starts, place, "right") - 1
    order = np.lexsort((place, item, doc))
    item, doc, place = item[order], doc[order], place[order]
    edge = np.flatnonzero(np.append(True, (np.diff(item) != 0) | (np.diff(doc) != 0))) if len(item) else []
    told = dict(zip(map(tuple, found.T.tolist()), number.tolist(), strict=True)) if len(edge) else {}
    for x, y in zip(edge, [*edge[1:], len(item)][: len(edge)], strict=True):
        d, i, p = int(doc[x]), int(item[x]), place[x:y]
        half, size, bound = int(items.budget[i]) + 1, int(items.sizes[i]), int(items.bound[i])
        reach = size // half + 3  # bands whose items may cover a place
        bands = np.unique(((np.unique(p // half) * half + FAR) // half)[:, None] - np.arange(reach)[None, :])
        first = bands * half - FAR
        within = np.searchsorted(p, first + 2 * half + half + size) - np.searchsorted(p, first - half)
        for b, w in zip(bands.tolist(), within.tolist(), strict=True):
            if w + told.get((d, i, b), 0) >= bound:
                wanted.add((d, i, b))
    done: dict[tuple[int, int], int] = {}
    for d, i, b in sorted(wanted):
        e = int(items.budget[i])
        first = b * (e + 1) - FAR
        a, z = first - e, first + 2 * (e + 1) + e + int(items.sizes[i])
        if done.get((d, i), first - 1) >= first:  # the region before has it
            continue
        text = window(codes, a, z, int(starts[d]), int(starts[d + 1]) - 1)
        if items.likely(i, text) and (hit := aligned(items.codes[i], text, e)):
            low, high = max(a + hit[1], int(starts[d])), min(a + hit[2], int(starts[d + 1]) - 1)
            done[d, i] = high
            yield d, i, hit[0], low - int(starts[d]), high - int(starts[d])
    for i in items.short:
        text = items.codes[i]
        at = np.flatnonzero(codes[: len(codes) - len(text) + 1] == text[0])
        for k in range(1, len(text)):
            at = at[codes[at + k] == text[k]]
        for p in at.tolist():
            d = int(np.searchsorted(starts, p, "right") - 1)
            if p + len(text) < starts[d + 1]:
                yield d, i, 0, p - int(starts[d]), p - int(starts[d]) + len(text)


FOUND = "doc_id long, item_id long, edits int, start long, end long"


def _scan(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    items = sent.value
    for batch in batches:
        for a, b in chunks(batch, "text"):
            part = batch.slice(a, b - a)
            texts = [x or "" for x in part.column("text").to_pylist()]
            starts = np.zeros(len(texts) + 1, np.int64)
            np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
            codes = folded("\x00".join(texts) + "\x00")
            rows = list(regions(codes, starts, items))
            ids = part.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([ids[r[0]] for r in rows], pa.int64()), pa.array([items.ids[r[1]] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (3, 4))], ["doc_id", "item_id", "edits", "start", "end"])


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE) -> DataFrame:
    """``docs(doc_id, text, ...)``, ``benchmark(item_id, text, ...)`` -> ``(doc_id, item_id, edits, start, end)``.

    A row for each region of a text that holds a whole item with at most ``floor(rate * length)`` edits, or fewer
    where the lemma's bound would fall below one shared q-gram (items under about ``q / (1 - rate * q)`` characters).
    Items shorter than ``q`` must occur exactly. Upper and lower case, and kinds of white space, are alike.
    Texts are scanned whole. Null and empty texts and items, and items of white space alone, match nothing; white space around an
    item doesn't count. Repeated rows of ``docs`` each give their rows, equal rows of ``benchmark`` count once; a null
    id is carried along. Items go out in blocks of about ``BLOCK_CHARS``, each a pass over the texts; an item is never split.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text <> ''").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_CHARS))
    out = None
    for i in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).collect()
        sent = spark.sparkContext.broadcast(Items(sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r)), q, rate))
        found = docs.mapInArrow(partial(_scan, sent=sent), FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    bad = materialize(contaminated(docs, benchmark).select(F.col("doc_id").alias("_bad")).distinct())
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["_bad"]), "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of the whole documents table that holds an item of the benchmark table."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
