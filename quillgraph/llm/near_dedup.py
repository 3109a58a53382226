"""Near-duplicate documents by SetSketch registers, banded, estimated jointly and verified on full sets.

Every text becomes the set of its distinct word shingles. A SetSketch of m registers keeps, per register, the
minimum of one hash over the set, rounded onto an exponential scale: ``K = floor(1 - log_b(min))``. Registers of
two sets merge by maximum, and agree with a probability that rises with the sets' Jaccard similarity. Bands of
registers give candidates; the pattern of greater, smaller and equal registers gives the maximum-likelihood
Jaccard of a candidate given both set sizes; survivors are verified by intersecting the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import chunks, mix, shingle_sets, stream
from .links import linked_groups
from .scratch import materialize

BASE = 1.02  # spacing of the register scale; unrelated sets then agree in 0.5 % of registers
BANDS, ROWS = 24, 5  # at Jaccard 0.8 a pair shares no band with probability (1 - 0.8**5)**24 = 7e-5
SIGMAS = 6.0  # a candidate is dropped by its estimate only if it lies so many standard errors below the threshold


def registers(hashes: np.ndarray, offsets: np.ndarray, m: int) -> np.ndarray:
    """One row of ``m`` registers (int16) per set; an empty set has registers of -1."""
    n = len(offsets) - 1
    out = np.full((n, m), -1, np.int16)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if not len(full):
        return out
    mul, add = stream(21, m) | np.uint64(1), stream(22, m)
    with np.errstate(over="ignore"):
        for j in range(m):
            low = np.minimum.reduceat(hashes * mul[j] + add[j], offsets[full])
            out[full, j] = np.floor(1 - np.log((low.astype(np.float64) + 0.5) / 2.0**64) / np.log(BASE)).astype(np.int16)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard of register rows ``a`` and ``b`` of sets with ``na`` and ``nb`` elements."""
    up, down = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - up - down
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    j = np.linspace(0, 1, 401)[None, :] * np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    pu, pd_ = p(u - v * j), p(v - u * j)
    log = up * np.log(np.maximum(pu, 1e-12)) + down * np.log(np.maximum(pd_, 1e-12)) + same * np.log(np.maximum(1 - pu - pd_, 1e-12))
    return np.take_along_axis(np.broadcast_to(j, log.shape), log.argmax(1)[:, None], 1)[:, 0]


SKETCH = "doc_id long, n_shingles long, fp long, fp2 long, regs binary"


def _sketch(batches: Iterator[pa.RecordBatch], size: int, m: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in chunks(batch, "text"):
            part = batch.slice(a, b - a)
            hashes, offsets = shingle_sets(part.column("text"), size)
            fp, fp2 = _fingerprints(hashes, offsets)
            regs = pa.array([r.tobytes() for r in registers(hashes, offsets, m)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(fp), pa.array(fp2), regs], ["doc_id", "n_shingles", "fp", "fp2", "regs"])


def _fingerprints(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set; zero for the empty one."""
    n, full = np.diff(offsets), np.flatnonzero(np.diff(offsets) > 0)
    fp, fp2 = np.zeros((2, len(n)), np.uint64)
    if len(full):
        fp[full] = mix(np.add.reduceat(hashes, offsets[full]) + n[full].astype(np.uint64))
        fp2[full] = mix(np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), offsets[full]))
    return fp.view(np.int64), fp2.view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in chunks(batch, "text"):
            hashes, offsets = shingle_sets(batch.slice(a, b - a).column("text"), size)
            fp, _ = _fingerprints(hashes, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes.view(np.int64)))], ["fp", "shingles"])


def _likely(frames: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    for f in frames:
        for i in range(0, len(f), 1000):
            g = f.iloc[i : i + 1000]
            x, y = (np.stack([np.frombuffer(r, np.int16) for r in g[c]]) for c in ("regs_a", "regs_b"))
            j = estimate(x, y, g.n_a.to_numpy(float), g.n_b.to_numpy(float))
            yield g.loc[j >= threshold - SIGMAS * np.sqrt(threshold * (1 - threshold) / x.shape[1]), ["a", "b"]]


def _bands(sketches: DataFrame, bands: int, rows: int) -> DataFrame:
    """``(bucket, id)``: one 64-bit value of each band of each distinct set."""
    width = 2 * rows
    cells = F.array(*(F.xxhash64(F.lit(i), F.substring("regs", i * width + 1, width)) for i in range(bands)))
    return sketches.select(F.col("fp").alias("id"), F.explode(cells).alias("bucket"))


PROFILE = "pivot long, id long, component long, n int, own array<long>, extra int, held array<long>"

#: The most elements that two sets of one pivot can share: those of the pivot that both hold, counted exactly, and at most so
#: many of the others as their hashed bits allow (a bit that only one set has stands for an element the other lacks).
SHARED = """
aggregate(zip_with(x_own, y_own, (p, q) -> bit_count(p & q)), 0, (s, v) -> s + v)
+ least(x_extra - aggregate(zip_with(x_held, y_held, (p, q) -> bit_count(p & ~q)), 0, (s, v) -> s + v),
        y_extra - aggregate(zip_with(y_held, x_held, (p, q) -> bit_count(p & ~q)), 0, (s, v) -> s + v))"""


def _bits(flags: np.ndarray) -> list[int]:
    return np.packbits(np.pad(flags, (0, -len(flags) % 64))).view(np.int64).tolist()


def _profiles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each set against its pivot's: which of the pivot's elements it holds, and hashed bits of its others."""
    for f in frames:
        rows = []
        for r in f.itertuples():
            pivot, own = np.asarray(r.pivot_set), np.asarray(r.own_set)
            extra = np.setdiff1d(own, pivot, assume_unique=True)
            held = np.zeros(4 * len(pivot) + 64, bool)
            held[mix(extra.view(np.uint64)) % np.uint64(len(held))] = True
            rows.append((r.pivot, r.id, r.component, len(own), _bits(np.isin(pivot, own, assume_unique=True)), len(extra), _bits(held)))
        yield pd.DataFrame(rows, columns=["pivot", "id", "component", "n", "own", "extra", "held"])


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_shingles, component_id, kept)``, one row per input row.

    Words are runs of characters other than space and U+0009 to U+000D, A-Z lower-cased; the set holds the distinct
    ``shingle_words``-word shingles. Rows are linked if 100 * intersection >= percent * union. Texts with the same
    set are one node, so copies are never expanded into pairs; ``component_id`` is the smallest doc_id of the
    connected group and ``kept`` marks the row that has it.

    Null or blank text: an empty set, linked with nothing, its own component, kept. Repeated rows with one doc_id
    share a component and are all marked alike. A null doc_id never names a component that has another id; alone it
    is its own component (null) and kept. Texts of any length are used whole. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = materialize(docs.mapInArrow(partial(_sketch, size=shingle_words, m=bands * rows), SKETCH))
    nodes = materialize(sketches.where("n_shingles > 0").groupBy("fp", "fp2", "n_shingles").agg(F.min("doc_id").alias("low"), F.first("regs").alias("regs")))

    def sets_of(wanted: DataFrame) -> DataFrame:
        """``(fp, shingles)`` of some nodes, from the texts again: most nodes never need theirs."""
        wanted = wanted.distinct()
        ids = nodes.join(wanted, "fp", "left_semi").select(F.col("low").alias("id")).distinct()
        texts = docs.join(ids, docs.doc_id.eqNullSafe(ids.id), "left_semi").select("text")
        sets = texts.mapInArrow(partial(_sets, size=shingle_words), "fp long, shingles array<long>")
        return materialize(sets.join(wanted, "fp", "left_semi").dropDuplicates(["fp"]))

    def verify(pairs: DataFrame) -> DataFrame:
        side = nodes.select("fp", "n_shingles", "regs")
        a = side.select(F.col("fp").alias("a"), F.col("n_shingles").alias("n_a"), F.col("regs").alias("regs_a"))
        b = side.select(F.col("fp").alias("b"), F.col("n_shingles").alias("n_b"), F.col("regs").alias("regs_b"))
        sized = pairs.join(a, "a").join(b, "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
        likely = materialize(sized.mapInPandas(partial(_likely, threshold=percent / 100), "a long, b long"))
        sets = sets_of(likely.select(F.explode(F.array("a", "b")).alias("fp")))
        x = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("s"))
        y = sets.select(F.col("fp").alias("b"), F.col("shingles").alias("t"))
        shared = likely.join(x, "a").join(y, "b").withColumn("i", F.size(F.array_intersect("s", "t")))
        return shared.where(f"100 * i >= {percent} * (size(s) + size(t) - i)").select("a", "b")

    def profile(rest: DataFrame) -> DataFrame:
        sets = sets_of(rest.select(F.explode(F.array("pivot", "id")).alias("fp")))
        own = sets.select(F.col("fp").alias("id"), F.col("shingles").alias("own_set"))
        pivots = sets.select(F.col("fp").alias("pivot"), F.col("shingles").alias("pivot_set"))
        return rest.join(own, "id").join(pivots, "pivot").mapInPandas(_profiles, PROFILE)

    closer = f"{100 + percent} * ({SHARED}) >= {percent} * (x_n + y_n)"
    groups = linked_groups(_bands(nodes, bands, rows), verify, profile, closer)
    named = nodes.select("fp", "low").join(groups.select(F.col("id").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    members = named.join(lowest, "component").select("fp", "component_id")
    out = sketches.select("doc_id", "n_shingles", "fp").join(members, "fp", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one_of_each(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that aren't the first of their near duplicates; columns stay as they are."""
    gone = near_duplicates(docs, shingle_words, percent).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    gone = materialize(gone)
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_gone"]), "left_anti")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of the whole documents table on two-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=2)
