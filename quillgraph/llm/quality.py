"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features describe its characters and words and those of its neighbours; two
states and their transitions form the chain. Forward-backward marginals of the good state, weighted by the lines'
lengths, give the document's score. The field is trained on labelled documents. Which of their lines are good isn't known:
by expectation maximisation each document's marginals are shifted until as large a share of it is good as its label
says, which leaves some lines of good documents bad and the other way round, and the field is fitted to those. All passes run over many documents at once in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import chunks, give_back, joined, mix, words

SAMPLE_DOCUMENTS = 6000  # labelled documents that the field is trained on at most
SAMPLE_CHARS, SAMPLE_LINES = 100_000, 200  # documents with more are left out of training only, so the driver gets 160 MB at most
SHARE = {0: 0.1, 1: 0.9}  # of a document's characters in good lines, by its label
CUT = 0.3

LETTER, CAPITAL, DIGIT, SPACE, STOP, BAR, SHOUT, SYMBOL, LEAD, TRAIL = range(10)
KIND = np.full(256, SYMBOL, np.uint8)
KIND[ord("a") : ord("z") + 1], KIND[ord("A") : ord("Z") + 1], KIND[ord("0") : ord("9") + 1] = LETTER, CAPITAL, DIGIT
KIND[[9, 10, 11, 12, 13, 32]], KIND[[ord(c) for c in ".,;:'\"-()"]] = SPACE, STOP
KIND[ord("|")], KIND[[ord("!"), ord("?")]] = BAR, SHOUT
KIND[0x80:0xC0], KIND[0xC0:] = TRAIL, LEAD

BASE_FEATURES, NEAR = 15, 8


def line_features(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, characters of every line, and the offsets of documents among the lines."""
    data, starts = joined(col)
    breaks = np.flatnonzero(data == 10)
    n = len(breaks)
    sizes = np.diff(breaks, prepend=-1)
    line = np.repeat(np.arange(n), sizes)
    count = np.bincount(line * 10 + KIND[data], minlength=10 * n).reshape(n, 10).astype(np.float64)
    count[:, SPACE] -= 1  # the line feed
    chars = count.sum(1) - count[:, TRAIL]
    share = count / np.maximum(chars, 1)[:, None]
    h, begin, _ = words(data)
    owner = np.searchsorted(breaks, begin)
    total = np.bincount(owner, minlength=n).astype(np.float64)
    twin = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    twins = np.bincount(owner[1:][twin], minlength=n)
    key = mix(h ^ mix(owner.astype(np.uint64)))  # a word of one line
    order = np.argsort(key)
    first = np.ones(len(h), bool)
    first[1:] = np.diff(key[order]) != 0
    distinct = np.bincount(owner[order][first], minlength=n)
    some = np.maximum(total, 1)
    base = np.column_stack((
        np.ones(n), share[:, LETTER], share[:, CAPITAL], share[:, DIGIT], share[:, SPACE], share[:, STOP], np.minimum(share[:, BAR] * 5, 1), np.minimum(share[:, SHOUT] * 5, 1),
        np.minimum(share[:, SYMBOL] * 3, 1), share[:, LEAD], np.log1p(chars) / 8, np.log1p(total) / 6, twins / some, distinct / some, np.minimum(chars / some / 12, 2),
    ))
    offsets = np.searchsorted(breaks, starts)
    told = base[:, [2, 5, 6, 7, 8, 12, 13, 14]]
    back, ahead = np.zeros_like(told), np.zeros_like(told)
    back[1:], ahead[:-1] = told[:-1], told[1:]
    opens, ends = offsets[:-1], offsets[1:] - 1
    back[opens], ahead[ends] = 0, 0
    flags = np.zeros((n, 2))
    flags[opens, 0], flags[ends, 1] = 1, 1
    return np.column_stack((base, back, ahead, flags)), chars, offsets


class Chains:
    """Documents as rows of lines, longest first, so that each step works on a prefix of them."""

    def __init__(self, offsets: np.ndarray) -> None:
        sizes = np.diff(offsets)
        self.order = np.argsort(-sizes, kind="stable")
        self.start, self.size = offsets[:-1][self.order], sizes[self.order]
        self.active = [int(np.searchsorted(-self.size, -t, "left")) for t in range(int(self.size.max(initial=0)))]  # longer than t

    def marginals(self, good: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(good) of each line, the expected transitions, and the log partition, from scores of good over bad."""
        n = len(good)
        emit = np.column_stack((np.zeros(n), good))
        alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
        pairs = np.zeros((2, 2))
        alpha[self.start] = emit[self.start]
        for t in range(1, len(self.active)):
            at = self.start[: self.active[t]] + t
            a = alpha[at - 1]
            alpha[at, 0] = emit[at, 0] + np.logaddexp(a[:, 0] + change[0, 0], a[:, 1] + change[1, 0])
            alpha[at, 1] = emit[at, 1] + np.logaddexp(a[:, 0] + change[0, 1], a[:, 1] + change[1, 1])
        last = self.start + self.size - 1
        z = np.zeros(n)
        z[last] = np.logaddexp(alpha[last, 0], alpha[last, 1])
        total = z[last].sum()
        for t in range(len(self.active) - 1, 0, -1):
            at = self.start[: self.active[t]] + t
            z[at - 1] = z[at]
            b = beta[at] + emit[at]
            for i in (0, 1):
                beta[at - 1, i] = np.logaddexp(change[i, 0] + b[:, 0], change[i, 1] + b[:, 1])
                for j in (0, 1):
                    pairs[i, j] += np.exp(alpha[at - 1, i] + change[i, j] + b[:, j] - z[at]).sum()
        return np.exp(alpha[:, 1] + beta[:, 1] - z), pairs, float(total)


class Field:
    """Weights of the good state's features and of the transitions, and the scale from shares to probabilities."""

    def __init__(self, weights: np.ndarray, change: np.ndarray, slope: float = 1.0, shift: float = 0.0) -> None:
        self.weights, self.change, self.slope, self.shift = weights, change, slope, shift

    def shares(self, x: np.ndarray, chars: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Length-weighted log-odds of the share of good lines in each text; one without characters counts its empty lines."""
        good, _, _ = Chains(offsets).marginals(x @ self.weights, self.change)
        weight = chars + 1e-9
        share = np.clip(np.add.reduceat(good * weight, offsets[:-1]) / np.add.reduceat(weight, offsets[:-1]), 1e-6, 1 - 1e-6)
        return np.log(share / (1 - share))

    def scores(self, col: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.shares(*line_features(col)) + self.shift)))


def expected(chains: Chains, good: np.ndarray, change: np.ndarray, weight: np.ndarray, offsets: np.ndarray, share: np.ndarray, steps: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Marginals and expected transitions once each document's scores are shifted so that ``share`` of its weight is good."""
    sizes = np.diff(offsets)
    low, high = np.full(len(sizes), -12.0), np.full(len(sizes), 12.0)
    for _ in range(steps):
        middle = (low + high) / 2
        p, pairs, _ = chains.marginals(good + np.repeat(middle, sizes), change)
        more = np.add.reduceat(p * weight, offsets[:-1]) / np.add.reduceat(weight, offsets[:-1]) < share
        low, high = np.where(more, middle, low), np.where(more, high, middle)
    return p, pairs


def train(x: np.ndarray, chars: np.ndarray, offsets: np.ndarray, labels: np.ndarray, turns: int = 4, rounds: int = 40, penalty: float = 2.0) -> Field:
    """Expectation maximisation; each maximisation by Adam on the penalised log-likelihood, every line counting alike."""
    chains, sizes, weight = Chains(offsets), np.diff(offsets), chars + 1e-9
    share = np.array([SHARE[int(n)] for n in labels])
    theta = np.zeros(x.shape[1] + 4)
    theta[[-4, -1]] = 1.0  # neighbours tend to be alike
    for turn in range(turns):
        if turn == 0:  # nothing is known of single lines yet
            gold, seen = np.repeat(share, sizes), np.zeros((2, 2))
            for n, k in zip(share, sizes - 1, strict=True):
                seen += k * np.array([[1 - n, 0.0], [0.0, n]])
            seen = 0.9 * seen + 0.1 * seen.sum() / 4
        else:
            gold, seen = expected(chains, x @ theta[:-4], theta[-4:].reshape(2, 2), weight, offsets, share)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, rounds + 1):
            good, pairs, _ = chains.marginals(x @ theta[:-4], theta[-4:].reshape(2, 2))
            grad = np.concatenate((x.T @ (gold - good), (seen - pairs).ravel())) - penalty * theta
            grad /= len(gold)
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    field = Field(theta[:-4], theta[-4:].reshape(2, 2))
    field.slope, field.shift = calibrated(field.shares(x, chars, offsets), labels)
    return field


def calibrated(odds: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic scale for the documents' shares, by Newton's method with a weak prior at (1, 0)."""
    design, theta = np.column_stack((odds, np.ones(len(odds)))), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ theta))
        grad = design.T @ (labels - p) - 0.1 * (theta - [1.0, 0.0])
        theta = theta + np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2), grad).clip(-1, 1)
    return float(max(theta[0], 1e-3)), float(theta[1])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in chunks(batch, "text"):
            part = batch.slice(a, b - a)
            x, chars, offsets = line_features(part.column("text"))
            x = np.column_stack((x, chars))
            rows = [x[i:j].astype(np.float32).tobytes() for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(rows, pa.binary())], ["label", "x"])
    batch = part = x = chars = rows = None
    give_back()


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCUMENTS) -> Field | None:
    """A field from at most ``most`` labelled documents of at most ``SAMPLE_CHARS`` characters and ``SAMPLE_LINES`` lines, those with the lowest hash of their id; None without both labels.

    ``labels(doc_id, quality)``: rows with a null in either count as unlabelled; a doc_id with several labels takes the least.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where((F.length("text") <= SAMPLE_CHARS) & (F.length("text") - F.length(F.replace("text", F.lit("\n"))) < SAMPLE_LINES))
    chosen = texts.select("doc_id").join(known, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = texts.join(F.broadcast(chosen), "doc_id")  # at most ``most`` rows
    rows = sorted((r.label, bytes(r.x)) for r in sample.select("label", "text").mapInArrow(_features, "label int, x binary").collect())
    if len({r[0] for r in rows}) < 2:
        return None
    width = BASE_FEATURES + 2 * NEAR + 3
    xs = [np.frombuffer(r[1], np.float32).reshape(-1, width) for r in rows]
    x = np.concatenate(xs).astype(np.float64)
    return train(x[:, :-1], x[:, -1], np.concatenate(([0], np.cumsum([len(x) for x in xs]))), np.array([r[0] for r in rows]))


def _score(batches: Iterator[pa.RecordBatch], field: Field | None, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in chunks(batch, "text", 1 << 21):
            part = batch.slice(a, b - a)
            score = field.scores(part.column("text")) if field else np.full(len(part), 0.5)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*part.schema.names, name])
    batch = part = score = None
    give_back()


def quality(docs: DataFrame, field: Field | None, name: str = "score") -> DataFrame:
    """``docs(..., text, ...)`` with a column ``name`` (0 to 1) that replaces one of that name.

    A null text counts as empty. Without a field, as when labels are missing, every score is 0.5. Every row is scored
    from its own text only, whole, so repeated rows score alike.
    """
    docs = docs.drop(name).withColumn("text", F.col("text").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{name}` double"
    return docs.mapInArrow(partial(_score, field=field, name=name), schema)


def held_out(doc_id: Column) -> Column:
    """The rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def accept(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """``docs`` without the documents that score below ``cut``, their text and columns as they were."""
    field = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    name = "score"
    while name in docs.columns:
        name = f"_{name}"
    return quality(docs, field, name).where(F.col(name) >= cut).select(*(F.col(f"`{c}`") for c in docs.columns))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for each text of the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    field = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id"))))
    scored = quality(docs, field)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
