"""Connected groups from bucketed candidates, without expanding a bucket into all its pairs.

A *bucket* is a value that similar items are likely to share (an LSH band, a pigeonhole block). The items of
one bucket are first compared with the bucket's smallest item, its pivot, only: a bucket of n items costs n - 1
comparisons. Where items of one pivot still lie in different groups, the pairs whose groups differ are tested
inside a join against a bound that every link meets, and only those within it are compared. A pivot with many such items is dealt over
several tasks. Every pair of a bucket
is therefore compared, excluded by the bound or known to be connected already: no link between groups is lost,
whatever a bucket's size, and rows stay in proportion to the links rather than to the pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize

BROADCAST_ROWS = 1_000_000  # of two longs; more are joined by a shuffle
MEMBERS_PER_TASK = 1000  # of a crowded pivot that one task tests the others against


def broadcast_if_few(df: DataFrame) -> DataFrame:
    """``df``, which is cheap to count and has rows of two longs, with a broadcast hint if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of any orderable id -> ``(id, component)``, component being the smallest id reachable.

    Alternating large-star and small-star contraction: O(log n) rounds, each two shuffles of the remaining
    edges, written to the shared folder. A star's hub is aggregated map-side before it is shuffled, and the join that
    returns to its rays is one that adaptive execution splits. No edge gives an empty result; self loops and
    repeated edges are ignored; an edge with a null end is ignored.
    """
    pairs = edges.where("a is not null and b is not null and a <> b")
    pairs = materialize(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        last, pairs = pairs, materialize(small.select("e.a", "e.b").where("a <> b").distinct())
        discard(last)
        after = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).union(pairs.select("b", "b").distinct())


def linked_groups(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], profile: Callable[[DataFrame], DataFrame], closer: str) -> DataFrame:
    """``buckets(bucket, id)`` -> ``(id, component)`` of the items that have a verified link.

    ``verify`` takes distinct candidate pairs ``(a, b)`` and returns those that are links. ``profile`` takes
    ``(pivot, id, component)`` and adds columns; ``closer`` is an SQL condition over the columns of two items of one
    pivot (``x_`` and ``y_`` prefixed) that every link meets, and is tested inside the join of the second pass. ``buckets``
    is evaluated twice and should be cheap to derive.
    """
    first = materialize(buckets.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("n > 1 and lo <> hi"))
    crowded = broadcast_if_few(first.where("n > 2").select("bucket", "lo"))
    members = materialize(buckets.select("bucket", "id").join(crowded, "bucket").where("id <> lo").select(F.col("lo").alias("a"), F.col("id").alias("b")).distinct())
    stars = first.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).union(members).distinct()
    edges = materialize(verify(stars).select("a", "b"))
    groups = connected_components(edges)

    placed = members.select(F.col("a").alias("pivot"), F.col("b").alias("id")).join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = placed.groupBy("pivot").agg(F.min("component").alias("p"), F.max("component").alias("q"), F.count("*").alias("size")).where("p <> q")
    rest = materialize(placed.join(split.select("pivot", "size"), "pivot").select("pivot", "size", "id", "component"))
    if rest.isEmpty():
        return groups
    sizes = rest.select("pivot", "id", "size")
    rest = materialize(profile(rest.drop("size")).join(sizes, ["pivot", "id"]))
    parts = F.ceil(F.col("size") / MEMBERS_PER_TASK).cast("int")
    taken = [c for c in rest.columns if c not in ("pivot", "size")]
    x = rest.select("pivot", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), *(F.col(c).alias(f"x_{c}") for c in taken))
    y = rest.select("pivot", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), *(F.col(c).alias(f"y_{c}") for c in taken))
    more = x.join(y, ["pivot", "part"]).where("x_component <> y_component").where(closer)
    more = more.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()
    found = materialize(verify(more).select("a", "b"))
    return groups if found.isEmpty() else connected_components(edges.union(found))
