"""Bulk-synchronous best-fit packing of tokenised documents into sequences.

Pieces and gaps are kept sorted by size. In each superstep every size of pieces looks up its successor among the
gaps, the smallest that holds it; where several sizes meet at one gap size, rank decides, longest first; the gaps
are updated, and the steps repeat until no piece fits. Then the longest pieces left open new sequences.

The sorted lists are run-length encoded: pieces of one length differ only by their rank within it, and gaps of one
size only by their sequence number. A sweep merges runs, at most one per size, so its cost depends on the
capacity and not on the corpus. Its outcome is a plan of rank intervals. Ranks come from per-partition counts, so
no length, however frequent, is sorted in one task.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import materialize

CAPACITY = 1024
END = 2
BROADCAST_ROWS = 100_000
#: Characters whose handling by both tokenizer libraries is tested one by one; a text with any other goes the slower way.
PLAIN = r"\A[\x00-ɏ‐-›€]*\Z"


@lru_cache(maxsize=2)
def tokenizer(path: str | None):
    """``texts -> lists of ids`` for a tokenizers JSON file.

    Where a file of ranks with the same vocabulary lies beside it, plain texts go through that, which gives
    equal ids five times faster. ``path`` None stands for the public byte-level vocabulary.
    """
    import base64
    import os
    import re

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    slow = Tokenizer.from_file(path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    ranks_file = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_file):
        return lambda texts: [e.ids for e in slow.encode_batch(texts, add_special_tokens=False)]
    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    plain = re.compile(PLAIN)

    def encode(texts: list[str]) -> list[list[int]]:
        return [fast.encode_ordinary(t) if plain.match(t) and not any(s in t for s in special) else slow.encode(t, add_special_tokens=False).ids for t in texts]

    return encode


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, at long"


def _pieces(batches: Iterator[pa.RecordBatch], capacity: int, path: str | None) -> Iterator[pa.RecordBatch]:
    """The pieces of each text, with the partition and the count of equal lengths before it there."""
    from pyspark import TaskContext

    encode = tokenizer(path)
    task = TaskContext.get()
    part = task.partitionId() if task else 0
    seen: dict[int, int] = defaultdict(int)
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            ids = np.array(encode([text.as_py() or ""])[0] + [END], "<u4")
            cut = (len(ids) - 1) % capacity + 1
            for n, (a, b) in enumerate(zip([0, *range(cut, len(ids), capacity)], range(cut, len(ids) + 1, capacity), strict=True)):
                rows.append((doc, n, a, b - a, zlib.crc32(ids[a:b].tobytes()), part, seen[b - a]))
                seen[b - a] += 1
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "at"])


class Gaps:
    """Runs of sequences by the room left in them."""

    def __init__(self) -> None:
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.sizes: list[int] = []

    def put(self, size: int, first: int, count: int) -> None:
        if size > 0 and count > 0:
            if size not in self.runs:
                self.runs[size] = []
                bisect.insort(self.sizes, size)
            self.runs[size].append((first, count))

    def successor(self, length: int) -> int | None:
        i = bisect.bisect_left(self.sizes, length)
        return self.sizes[i] if i < len(self.sizes) else None

    def take(self, size: int, most: int) -> tuple[int, int]:
        """Up to ``most`` sequences of one run."""
        first, count = self.runs[size].pop()
        used = min(count, most)
        if used < count:
            self.runs[size].append((first + used, count - used))
        if not self.runs[size]:
            del self.runs[size]
            self.sizes.remove(size)
        return first, used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Counts by length -> ``(length, first rank, end rank, first sequence, offset)``: rank r lies in sequence first + r - rank."""
    left = {n: c for n, c in counts.items() if c > 0}
    ranks: dict[int, int] = defaultdict(int)
    gaps, out, opened = Gaps(), [], 0

    def place(length: int, first: int, used: int, offset: int) -> None:
        out.append((length, ranks[length], ranks[length] + used, first, offset))
        ranks[length] += used
        left[length] -= used
        if not left[length]:
            del left[length]

    while left:
        while True:  # one superstep per turn
            wanted: dict[int, list[int]] = defaultdict(list)
            for length in left:
                if (size := gaps.successor(length)) is not None:
                    wanted[size].append(length)
            if not wanted:
                break
            freed = []
            for size, lengths in wanted.items():
                for length in sorted(lengths, reverse=True):
                    while length in left and size in gaps.runs:
                        first, used = gaps.take(size, left[length])
                        place(length, first, used, capacity - size)
                        freed.append((size - length, first, used))
            for size, first, used in freed:
                gaps.put(size, first, used)
        if left:
            length = max(left)
            several = capacity // length
            # pieces longer than half open one sequence each; shorter ones only as many as their own copies fill
            used = left[length] if several == 1 else max(1, left[length] // several)
            first, opened = opened, opened + used
            place(length, first, used, 0)
            gaps.put(capacity - length, first, used)
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, a row per piece.

    A document is its ids and the end id. One longer than ``capacity`` is cut into pieces of it, the first of which
    takes the remainder. A null text counts as empty: one piece with the end id. Repeated rows and null doc_ids
    are packed row by row. No text is cut before it is tokenised. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = materialize(docs.mapInArrow(partial(_pieces, capacity=capacity, path=tokenizer_path), PIECES))
    local = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = materialize(local.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))))
    counts = {r[0]: r[1] for r in before.groupBy("length").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    rows = [(int(a), int(b), int(c), int(d), int(e)) for a, b, c, d, e in plan(counts, capacity)]
    rows.sort()
    by_length: dict[int, list] = defaultdict(list)
    for length, *rest in rows:
        by_length[length].append(tuple(rest))
    steps = spark.createDataFrame(list(by_length.items()), "length long, steps array<struct<lo:long,hi:long,first:long,offset:long>>")
    starts = before.select("length", "part", F.coalesce("before", F.lit(0)).alias("before"))
    if before.count() < BROADCAST_ROWS:  # lengths times partitions; else a shuffled join
        starts = F.broadcast(starts)
    ranked = pieces.join(starts, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("at"))
    return place_ranks(ranked, steps)


def place_ranks(ranked: DataFrame, steps: DataFrame) -> DataFrame:
    """Look each piece's rank up in the plan's intervals of its length."""
    joined = ranked.join(F.broadcast(steps), "length")  # one row per length, at most the capacity
    found = F.filter("steps", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") < s["hi"]))[0]
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32", (found["first"] + F.col("rank") - found["lo"]).alias("sequence_id"), found["offset"].alias("offset"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
