"""Packing context into a token budget, coverage, and differences to what was sent before."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from quillgraph.functions.text import round_half_up

CHARS_PER_TOKEN = 4


def token_estimate(text: Column | str) -> Column:
    """Tokens of a text, estimated as its characters over four, rounded up."""
    return F.ceil(F.length(text) / CHARS_PER_TOKEN).cast("int")


def knapsack(items: DataFrame, budget: float, keys: tuple[str, ...] = ("pool",), pin_free: bool = True) -> DataFrame:
    """``items(pool, id, score, token_cost)`` -> the same with ``density``, ``place`` and ``included``.

    Greedy by score per token: an item that doesn't fit is passed over, and later ones may still fit. Free items are
    pinned. Ties go to the higher score, the lower cost, then the id. Items with a score or cost that isn't finite,
    or a negative cost, are left out. The fold is exact, takes a step an item and holds one batch of a pool at a time.
    """
    finite = lambda n: F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))
    ok = items.where(finite("score") & finite("token_cost") & (F.col("token_cost") >= 0))
    density = F.when(F.col("token_cost") == 0, float("inf")).otherwise(F.col("score") / F.col("token_cost"))
    order = [F.col("density").desc(), F.col("score").desc(), F.col("token_cost").cast("double"), F.col("id")]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    others = [c for c in items.columns if c not in (*keys, "id")]
    placed = ok.withColumn("density", density).withColumn("place", place).withColumn("_cost", F.col("token_cost").cast("double"))
    placed = placed.select(*keys, F.col("id").cast("string").alias("id"), *others, "density", "place", "_cost")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = 0.0  # of the pool that the last row was in: pools follow one another, each by place
        for batch in batches:
            fits = []
            for n, cost in zip(batch.column("place").to_pylist(), batch.column("_cost").to_pylist()):
                if n == 1:
                    used = 0.0
                fit = pin_free if cost == 0 else used + cost <= budget
                if fit:
                    used += cost
                fits.append(fit)
            kept = batch.drop_columns(["_cost"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(fits, pa.bool_())], names=[*kept.schema.names, "included"])

    return placed.mapInArrow(fold, StructType([*placed.drop("_cost").schema.fields, StructField("included", BooleanType())]))


def prefix_pack(items: DataFrame, budget: float, keys: tuple[str, ...] = ("pool",), order: tuple[str, ...] = ("place",)) -> DataFrame:
    """Items in order up to the first that overflows the budget; the first one always stays."""
    w = Window.partitionBy(*keys).orderBy(*order)
    running = F.sum("token_cost").over(w.rowsBetween(Window.unboundedPreceding, 0))
    summed = items.withColumn("_n", F.row_number().over(w)).withColumn("_over", (running > budget) & (F.col("_n") > 1))
    stopped = F.max(F.col("_over").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return summed.withColumn("_stop", stopped).where("_stop = 0").drop("_n", "_over", "_stop")


def compile_pack(items: DataFrame, budget: float, keys: tuple[str, ...] = ("pool",)) -> DataFrame:
    """``items(..., required, score, token_cost)``: required ones first, then the knapsack over what they leave.

    The remaining budget differs by pool, so costs are scaled to a budget of 1 per pool before the fold.
    """
    needed = items.where("required").groupBy(*keys).agg(F.sum("token_cost").alias("spent"))
    left = items.where("not required").join(needed, list(keys), "left").withColumn("room", F.greatest(F.lit(budget) - F.coalesce("spent", F.lit(0.0)), F.lit(0.0)))
    scaled = left.withColumn("token_cost", F.when(F.col("room") > 0, F.col("token_cost") / F.col("room")).otherwise(F.when(F.col("token_cost") > 0, 2.0).otherwise(0.0)))
    chosen = knapsack(scaled, 1.0, keys).where("included").select(*keys, "id")
    return items.where("required").select(*keys, F.col("id").cast("string").alias("id"), F.lit(True).alias("required")).unionByName(chosen.withColumn("required", F.lit(False)))


def duplicate_penalty(candidates: DataFrame) -> DataFrame:
    """``copies``: how many candidates share file, evidence and label; every one after the first costs."""
    n = F.count("*").over(Window.partitionBy("source_file", "evidence", "label"))
    return candidates.withColumn("copies", n).withColumn("penalty", F.when(n > 1, (n - 1) * 0.5).otherwise(0.0))


def coverage(selected: DataFrame, required: list[str]) -> DataFrame:
    """``(evidence, nodes, covered)`` of each required class of evidence."""
    wanted = selected.sparkSession.createDataFrame([(r,) for r in required], "evidence string")
    found = selected.groupBy("evidence").agg(F.count("*").alias("nodes"))
    return wanted.join(found, "evidence", "left").select("evidence", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.col("nodes").isNotNull().alias("covered"))


def confidence(required: Column, semantic: Column, relationships: Column, missing_required: Column, missing_semantic: Column) -> tuple[Column, Column]:
    """A score and its band from the covered shares of required evidence, semantic categories and relationships.

    ``0.55 * required + 0.3 * semantic + 0.15 * relationships``, less 0.03 for each missing class (0.15 at most) and
    0.02 for each missing category (0.1 at most); high from 0.85, medium from 0.5.
    """
    score = required * 0.55 + semantic * 0.3 + relationships * 0.15 - F.least(F.lit(0.15), missing_required * 0.03) - F.least(F.lit(0.1), missing_semantic * 0.02)
    score = round_half_up(score, 4)
    return score, F.when(score >= 0.85, "high").when(score >= 0.5, "medium").otherwise("low")


def truncated(text: Column | str, tokens: int, chars: int = 3) -> Column:
    """A text cut to ``tokens`` times three characters, with a mark if anything was cut."""
    most = tokens * chars
    t = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("\n... (truncated)"))).otherwise(t)


def handle(*parts: Column | str) -> Column:
    """A stable short id of some columns."""
    return F.concat(F.lit("h_"), F.left(F.sha2(F.concat_ws("\x1f", *parts), 256), F.lit(12)))


def resolutions(ranked: DataFrame, mode: str) -> DataFrame:
    """``resolution`` per row: ``detail``, ``summary``, ``signature`` or ``sketch`` for all, or ``mixed``: the first third in detail."""
    if mode != "mixed":
        return ranked.withColumn("resolution", F.lit(mode))
    n, place = F.count("*").over(Window.partitionBy("pool")), F.row_number().over(Window.partitionBy("pool").orderBy("place"))
    return ranked.withColumn("resolution", F.when(place <= F.ceil(n / 3), "detail").otherwise("summary"))


def delta_pack(nodes: DataFrame, relationships: DataFrame, sent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the receiver lacks: nodes not sent yet, and relationships unless both their ends were sent."""
    known = sent.select("id").distinct()
    old = relationships.join(known.select(F.col("id").alias("src")), "src", "left_semi").join(known.select(F.col("id").alias("dst")), "dst", "left_semi")
    return nodes.join(known, "id", "left_anti"), relationships.join(old.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def session_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(ref, status)`` of two states ``(ref, hash)``: added, updated, invalidated or reused."""
    a, b = before.select("ref", F.col("hash").alias("h1")), after.select("ref", F.col("hash").alias("h2"))
    status = F.when(F.col("h1").isNull(), "added").when(F.col("h2").isNull(), "invalidated").when(F.col("h1") == F.col("h2"), "reused").otherwise("updated")
    return a.join(b, "ref", "full_outer").select("ref", status.alias("status"))


def snippet(lines: DataFrame, budget: int) -> DataFrame:
    """``lines(node, line, text, focus)`` -> the lines around each node's focus line that fit, growing outward in turn.

    The cost of a line and of all nearer ones decides; of two lines equally far the earlier comes first.
    """
    far = F.abs(F.col("line") - F.col("focus"))
    w = Window.partitionBy("node").orderBy(far, "line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("spent", F.sum(token_estimate("text") + 1).over(w)).where((F.col("spent") <= budget) | (far == 0)).drop("spent")
