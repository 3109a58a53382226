"""Exact top-k inner-product search by vector approximation.

Every block of vectors is quantised into 256 cells per dimension. A query's product with a cell's centre, plus or
minus half the cells' widths weighted by the query, bounds its product with every vector of the cell. The cells are
scanned first; exact vectors are then read in the order of their bounds, and reading stops once the next bound
lies below the k-th best exact score. Queries go out in blocks of bounded size, each scanned against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import materialize

QUERY_BLOCK = 8 << 20  # bytes of query vectors sent to the executors at once
VECTOR_BLOCK = 1024
SAFE = float(1 << 62)  # sums of products below this are exact in 64 bits


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` as 64-bit integers, or as Python's where those don't reach."""
    if np.abs(x).max(initial=0) < SAFE / scale:
        return np.floor(x * float(scale)).astype(np.int64)
    exact = [int(v) * scale if abs(v) >= 1 << 53 else int(np.floor(v * scale)) for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def largest(x: np.ndarray) -> float:
    return float(max((abs(v) for v in x.ravel().tolist()), default=0) if x.dtype == object else np.abs(x).max(initial=0))


class Block:
    """Vectors of one length with their cells."""

    def __init__(self, ids: np.ndarray, exact: np.ndarray) -> None:
        self.ids, self.exact = ids, exact
        low, high = exact.min(0), exact.max(0)
        self.width = (high - low + 1) / 256.0
        cells = np.minimum((exact - low) / self.width, 255).astype(np.uint8)
        self.centre = low + (cells + 0.5) * self.width

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """An upper bound of each query's product with each vector."""
        product = queries @ self.centre.T
        slack = np.abs(queries) @ (self.width / 2 + 1e-9 * (np.abs(self.centre).max(0) + 1))
        return product + slack[:, None] + 1


def better(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if score.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))[:k], int)
    return np.lexsort((ids, -score))[:k]


Best = tuple[np.ndarray, np.ndarray]


def merged(a: Best, b: Best, k: int) -> Best:
    score, ids = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
    top = better(score, ids, k)
    return score[top], ids[top]


def search(queries: dict[int, tuple[np.ndarray, np.ndarray]], batches: Iterator[pa.RecordBatch], k: int, scale: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of this partition for every query. ``queries``: by vector length, ids and integer vectors."""
    best = {n: [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids) for n, (ids, _) in queries.items()}
    reach = {n: largest(vectors) * max(n, 1) for n, (_, vectors) in queries.items()}
    for batch in batches:
        lists = batch.column("v")
        values = np.asarray(lists.flatten(), dtype=np.float64)
        ids = np.asarray(batch.column("vec_id"), dtype=np.int64)
        offsets = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(lists)))))
        sizes = np.diff(offsets)
        for n in set(sizes.tolist()) & set(queries):
            rows = np.flatnonzero(sizes == n)
            for i in range(0, len(rows), VECTOR_BLOCK):
                part = rows[i : i + VECTOR_BLOCK]
                exact = whole(values[offsets[part][:, None] + np.arange(n)], scale)
                own, vectors = queries[n]
                if largest(exact) * reach[n] >= SAFE or exact.dtype == object:
                    # no bounds: floating point can't tell such products apart, so every one is taken exactly
                    for q in range(len(own)):
                        others = ids[part] != own[q]
                        score = exact[others].astype(object) @ vectors[q].astype(object) if n else np.zeros(others.sum(), object)
                        best[n][q] = merged(best[n][q], (score, ids[part][others]), k)
                    continue
                block = Block(ids[part], exact)
                upper = block.bounds(vectors.astype(np.float64))
                for q in range(len(own)):
                    best[n][q] = refine(block, own[q], vectors[q], upper[q], best[n][q], k)
    for n, (own, _) in queries.items():
        for q, (score, ids) in zip(own, best[n], strict=True):
            if score.dtype == object:
                if any(not -(1 << 63) <= s < 1 << 63 for s in score):
                    raise OverflowError(f"a score of query {q} doesn't fit 64 bits")
                score = score.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q)), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])


def refine(block: Block, own: int, query: np.ndarray, upper: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    score, ids = best
    bar = score[-1] if len(score) == k else -np.inf
    near = np.flatnonzero((upper >= bar) & (block.ids != own))
    near = near[np.argsort(-upper[near], kind="stable")]
    step = 2 * k
    for i in range(0, len(near), step):
        if len(score) == k and upper[near[i]] < score[-1]:
            break
        read = near[i : i + step]
        score, ids = merged((score, ids), (block.exact[read] @ query, block.ids[read]), k)
    return score, ids


def finite(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v)`` of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fits = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & fits).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """``vectors(vec_id, embedding, ...)`` -> ``(query_id, rank, vec_id, score)``: each query's k best other rows.

    The score is the inner product of ``floor(scale * x)``, exact for finite components of any size; one of the best that
    64 bits can't hold raises an error. Ties go to the smaller vec_id. Rows with a null vec_id or
    vector, or a null or non-finite component, take no part; a product needs vectors of equal length. A query
    whose vec_id repeats is searched once, with the least of its vectors; a repeated candidate row counts each
    time. With fewer candidates than k all are returned; without any, none. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = materialize(finite(vectors))
    asked = rows.withColumn("_q", is_query).where("_q").groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = materialize(asked)
    total = asked.agg(F.sum(8 * (F.size("v") + 1))).first()[0] or 0
    blocks = max(1, -(-int(total) // QUERY_BLOCK))
    spread = rows.repartition(max(spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())) if rows.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism else rows
    found = []
    for i in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).collect()
        by_size: dict[int, list] = {}
        for r in part:
            by_size.setdefault(len(r.v), []).append(r)
        queries = {n: (np.array([r.vec_id for r in rs], np.int64), whole(np.array([r.v for r in rs], np.float64).reshape(len(rs), n), scale)) for n, rs in by_size.items()}
        sent = spark.sparkContext.broadcast(queries)
        near = spread.mapInArrow(partial(_search, sent=sent, k=k, scale=scale), "query_id long, vec_id long, score long")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks > 1:  # one block after the other, so that only one is held
            best = materialize(best)
            sent.destroy()
        found.append(best)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _search(batches: Iterator[pa.RecordBatch], sent, k: int, scale: int) -> Iterator[pa.RecordBatch]:
    return search(sent.value, batches, k, scale)


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other rows for each vector whose id is divisible by 100."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * c.v[i])) as bigint) as score
      from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10"""
