"""Community detection: exact local moving per component, and label propagation that scales past one task."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.plans.staging import staged

from .components import connected_components
from .graph import PropertyGraph

LARGEST = 150
DEEPEST = 2
PASSES = 20
LEAST_GAIN = 1e-10


def local_moving(ids: list[str], pairs: list[tuple[str, str, float]], total: float) -> dict[str, int]:
    """Greedy modularity moves, best connected node first, until a pass moves nothing. ``total``: the whole graph's weight."""
    near: dict[str, dict[str, float]] = {i: {} for i in ids}
    degree = dict.fromkeys(ids, 0.0)
    for a, b, w in pairs:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
        degree[a] += w
        degree[b] += w
    home = {node: k for k, node in enumerate(ids)}
    mass = {k: degree[node] for k, node in enumerate(ids)}
    visits = sorted(ids, key=lambda node: (-degree[node], node))
    for _ in range(PASSES):
        moved = False
        for node in visits:
            if not near[node]:
                continue
            pull: dict[int, float] = {}
            for other, w in near[node].items():
                pull[home[other]] = pull.get(home[other], 0.0) + w
            own, k = home[node], degree[node]
            mass[own] -= k
            gain = lambda c: pull.get(c, 0.0) - mass[c] * k / (2 * total)  # noqa: E731, B023
            stay, best, most = gain(own), own, 0.0
            for c in pull:
                more = gain(c) - stay
                if more > LEAST_GAIN and more > most:
                    best, most = c, more
            mass[best] += k
            home[node] = best
            moved |= best != own
        if not moved:
            break
    return home


def split(ids: list[str], pairs: list[tuple[str, str, float]], total: float, depth: int = -1) -> list[list[str]]:
    """Communities of at most LARGEST nodes where two more levels of moving achieve it."""
    home = local_moving(ids, pairs, total)
    groups: dict[int, list[str]] = {}
    for node in ids:
        groups.setdefault(home[node], []).append(node)
    if depth >= 0 and len(groups) <= 1:
        return [ids]
    inner: dict[int, list[tuple[str, str, float]]] = {}
    for p in pairs:
        if home[p[0]] == home[p[1]]:
            inner.setdefault(home[p[0]], []).append(p)
    out: list[list[str]] = []
    for k, group in groups.items():
        own = inner.get(k, [])
        if len(group) > LARGEST and depth + 1 < DEEPEST and own:
            out += split(group, own, sum(w for *_, w in own), depth + 1)
        else:
            out.append(group)
    return out


def with_first(groups: list[list[str]]) -> list[tuple[str, str]]:
    """Each node with the least one of its group, found once a group."""
    return [(node, first) for first, group in ((min(g), g) for g in groups) for node in group]


def communities(graph: PropertyGraph) -> DataFrame:
    """``(id, community)``: numbered from 0 by size, then by the first member.

    Components only share the total weight, so each is one group. The order of moves matters, so a component is
    moved through by one task, which bounds it to what a task holds; use ``label_propagation`` beyond that.
    """
    graph = graph.staged()
    weight = F.when(F.col("weight").isNotNull() & ~F.isnan("weight") & (F.col("weight") > 0), F.col("weight")).otherwise(1.0)
    edges = staged(graph.edges.select("src", "dst", weight.alias("w")))
    total = edges.agg(F.sum("w")).first()[0] or 0.0
    parts = staged(connected_components(graph.nodes.select("id"), edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))))
    rows = parts.select("component", F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0.0).alias("w"))
    rows = rows.union(edges.join(parts.withColumnRenamed("id", "src"), "src").select("component", F.col("src"), "dst", "w"))

    def groups(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a", "b"])
        ids = pdf[pdf.b.isna()].a.tolist()
        pairs = list(pdf[pdf.b.notna()][["a", "b", "w"]].itertuples(index=False, name=None))
        found = split(ids, pairs, total) if pairs else [[i] for i in ids]
        return pd.DataFrame(with_first(found), columns=["id", "first"])

    grouped = staged(rows.groupBy("component").applyInPandas(lambda pdf: groups(pdf), "id string, first string"))
    return numbered(grouped)


def numbered(grouped: DataFrame) -> DataFrame:
    """``(id, first)`` -> ``(id, community)``, largest first, ties by the first member.

    Ranks are taken within each size and shifted by the number of larger communities, so no task sorts them all.
    """
    sizes = grouped.groupBy("first").agg(F.count("*").alias("n"))
    counts = sizes.groupBy("n").agg(F.count("*").alias("k"))
    before = counts.withColumn("before", F.coalesce(F.sum("k").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per size
    ranked = sizes.withColumn("r", F.row_number().over(Window.partitionBy("n").orderBy("first")))
    number = ranked.join(before, "n").select("first", (F.col("before") + F.col("r") - 1).cast("int").alias("community"))
    return grouped.join(number, "first").select("id", "community")


def label_propagation(graph: PropertyGraph, rounds: int = 10) -> DataFrame:
    """``(id, community)``: each round every node takes its neighbours' heaviest label, the smaller on ties."""
    graph = graph.staged()
    weight = F.coalesce("weight", F.lit(1.0))
    both = staged(graph.edges.select("src", "dst", weight.alias("w")).union(graph.edges.select("dst", "src", weight)))
    labels = staged(graph.nodes.select("id", F.col("id").alias("label")))
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("w").alias("w"))
        best = votes.groupBy("id").agg(F.min(F.struct((-F.col("w")).alias("w"), "label"))["label"].alias("next"))
        after = staged(labels.join(best, "id", "left").select("id", F.least("label", "next").alias("kept"), F.coalesce("next", "label").alias("label")).select("id", "label"))
        if after.exceptAll(labels).isEmpty():
            break
        labels = after
    return numbered(labels.select("id", F.col("label").alias("first")))


__all__ = ["communities", "label_propagation", "local_moving", "numbered", "split"]
