"""Traversals by frontier: each level is one join of the frontier with the steps, less what was visited."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.plans.staging import staged

from .graph import PropertyGraph
from .metrics import find_node

FORWARD_IMPACT = ("defines_action", "defines_selector", "registered_in_store")
DEEPEST_IMPACT = 5


def _ids(graph: PropertyGraph, ids: Iterable[str]) -> DataFrame:
    wanted = list(ids)
    return graph.nodes.where(F.col("id").isin(wanted)).select("id")


def bfs(graph: PropertyGraph, seeds: Iterable[str], depth: int, allowed: DataFrame | None = None, direction: str = "outgoing") -> tuple[DataFrame, DataFrame]:
    """``(visited(id, level), edges(src, dst, level))`` within ``depth`` steps of the seeds.

    ``allowed(id)`` masks all nodes. An edge is listed at each level where its far end was unvisited when the level
    began, so a node found from several nodes of one level has several edges.
    """
    if depth < 0:
        raise ValueError("depth must not be negative")
    steps = graph.steps(direction)
    start = _ids(graph, seeds)
    if allowed is not None:
        start = start.join(allowed.select("id"), "id", "left_semi")
        steps = steps.join(allowed.select(F.col("id").alias("neighbor")), "neighbor", "left_semi")
    visited = staged(start.select("id", F.lit(0).alias("level")))
    found = steps.select("src", "dst", F.lit(0).alias("level")).limit(0)
    for level in range(1, depth + 1):
        frontier = visited.where(F.col("level") == level - 1).select("id")
        reached = steps.join(frontier, "id").join(visited.select(F.col("id").alias("neighbor")), "neighbor", "left_anti")
        reached = staged(reached.select("neighbor", "src", "dst", F.lit(level).alias("level")))
        if reached.isEmpty():
            break
        found = found.union(reached.select("src", "dst", "level"))
        visited = staged(visited.union(reached.select("neighbor", "level").distinct()))
    return visited, found


def dfs(graph: PropertyGraph, seeds: Iterable[str], depth: int, allowed: DataFrame | None = None, direction: str = "outgoing") -> DataFrame:
    """``(id, place, level)`` in the order of a stack traversal, neighbours in edge order.

    The order is sequential by nature, so it is computed in one group; only the steps within ``depth`` of the seeds
    are handed to it.
    """
    wanted = list(seeds)
    near, _ = bfs(graph, wanted, depth, allowed, direction)
    ids = near.select("id")
    back = graph.edges.select(F.col("dst").alias("id"), F.col("src").alias("neighbor"), F.lit(1).alias("side"), "ord")
    out = graph.edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbor"), F.lit(0).alias("side"), "ord")
    if not graph.directed:
        steps = out.union(back.withColumn("side", F.lit(0)))
    else:
        steps = out.union(back) if direction == "incident" else out
    steps = steps.join(ids, "id", "left_semi").join(ids.withColumnRenamed("id", "neighbor"), "neighbor", "left_semi")
    rows = steps.select("id", "neighbor", "side", "ord").union(near.where("level = 0").select("id", F.lit(None).cast("string"), F.lit(-1), F.lit(0).cast("long")))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "ord", "neighbor"], kind="stable")
        nexts = pdf[pdf.side >= 0].groupby("id", sort=False).neighbor.apply(lambda s: list(dict.fromkeys(s))).to_dict()
        known = set(pdf[pdf.side < 0].id)
        stack = [(s, 0) for s in reversed(wanted) if s in known]
        seen: dict[str, int] = {}
        while stack:
            node, level = stack.pop()
            if node in seen or level > depth:
                continue
            seen[node] = level
            stack += [(n, level + 1) for n in nexts.get(node, ()) if n not in seen]
        return pd.DataFrame({"id": list(seen), "place": range(len(seen)), "level": list(seen.values())})

    return rows.groupBy(F.lit(1).alias("one")).applyInPandas(lambda pdf: walk(pdf), "id string, place long, level long")


def shortest_path(graph: PropertyGraph, source: str, target: str, most_hops: int = 8) -> DataFrame:
    """``(place, id)`` of one shortest path along edges; empty without one. Of equal parents the first in id order leads."""
    spark = graph.nodes.sparkSession
    if source == target:
        return _ids(graph, [source]).select(F.lit(0).alias("place"), "id")
    steps = graph.steps("outgoing").select("id", "neighbor").distinct()
    seen = staged(_ids(graph, [source]).select("id", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("level")))
    for level in range(1, most_hops + 1):
        frontier = seen.where(F.col("level") == level - 1).select("id")
        reached = steps.join(frontier, "id").join(seen.select(F.col("id").alias("neighbor")), "neighbor", "left_anti")
        reached = reached.groupBy("neighbor").agg(F.min("id").alias("parent")).select(F.col("neighbor").alias("id"), "parent", F.lit(level).alias("level"))
        reached = staged(reached)
        seen = seen.union(reached)
        if reached.where(F.col("id") == target).count():
            break
        if reached.isEmpty():
            return spark.createDataFrame([], "place int, id string")
    else:
        return spark.createDataFrame([], "place int, id string")
    path, at = [target], target
    for _ in range(level):  # one row per hop
        at = seen.where(F.col("id") == at).first()["parent"]
        path.append(at)
    return spark.createDataFrame(list(enumerate(reversed(path))), "place int, id string")


def call_chains(graph: PropertyGraph, source: str, target: str, most_hops: int = 8, relations: tuple[str, ...] = ("calls", "imports_from"), most: int = 10) -> DataFrame:
    """``(path, hops)`` of simple paths from one label to another: the first ``most`` in edge order, shortest first."""
    if not graph.directed:
        raise ValueError("call chains need a directed graph")
    start, goal = find_node(graph, source).select("id"), find_node(graph, target).select(F.col("id").alias("goal"))
    edges = graph.edges.where(F.coalesce("relation", F.lit("related_to")).isin(*relations)) if relations else graph.edges
    edges = edges.select("src", "dst", "ord")
    ends = goal.first()
    paths = staged(start.select(F.array("id").alias("path"), F.array().cast("array<long>").alias("turns"), F.col("id").alias("last")))
    done = paths.limit(0)
    if ends is None:
        return done.select("path", F.size("path").alias("hops"))
    for _ in range(most_hops):
        paths = paths.join(edges, paths["last"] == edges["src"]).where(~F.array_contains("path", F.col("dst")))
        paths = staged(paths.select(F.concat("path", F.array("dst")).alias("path"), F.concat("turns", F.array("ord")).alias("turns"), F.col("dst").alias("last")))
        done = done.union(paths.where(F.col("last") == ends.goal))
        paths = paths.where(F.col("last") != ends.goal)
        if paths.isEmpty():
            break
    first = done.orderBy("turns").limit(most)
    return first.select("path", (F.size("path") - 1).alias("hops")).orderBy("hops", "turns")


def impact(graph: PropertyGraph, label: str, depth: int = 3, relations: tuple[str, ...] = ()) -> DataFrame:
    """``(id, distance, relation, path)`` of what depends on a node: predecessors, and successors over a few relations.

    Of several ways to a node the one with the smallest path of ids counts. ``path`` starts at the node itself.
    """
    if not graph.directed:
        raise ValueError("impact needs a directed graph")
    edges = graph.edges.withColumn("relation", F.coalesce("relation", F.lit("related_to")))
    if relations:
        edges = edges.where(F.col("relation").isin(*relations))
    back = edges.select(F.col("dst").alias("id"), F.col("src").alias("neighbor"), "relation")
    ahead = edges.where(F.col("relation").isin(*FORWARD_IMPACT)).select(F.col("src").alias("id"), F.col("dst").alias("neighbor"), "relation")
    steps = back.union(ahead)
    seen = staged(find_node(graph, label).select("id", F.lit(0).alias("distance"), F.lit(None).cast("string").alias("relation"), F.array("id").alias("path")))
    for distance in range(1, min(depth, DEEPEST_IMPACT) + 1):
        frontier = seen.where(F.col("distance") == distance - 1).select("id", "path")
        reached = steps.join(frontier, "id").join(seen.select(F.col("id").alias("neighbor")), "neighbor", "left_anti")
        way = F.struct(F.concat("path", F.array("neighbor")).alias("path"), "relation")
        reached = staged(reached.groupBy("neighbor").agg(F.min(way).alias("way")).select(F.col("neighbor").alias("id"), F.lit(distance).alias("distance"), "way.relation", "way.path"))
        if reached.isEmpty():
            break
        seen = seen.union(reached)
    return seen.where("distance > 0")


# Roles of frameworks by how much they say in a summary.
SUMMARY_ROLES = {
    4: ("express_route", "react_router_route", "nest_route", "next_route", "next_route_handler"),
    3: ("redux_slice", "redux_store", "nest_module", "nest_controller", "next_page", "next_layout", "next_pages_app", "next_pages_document", "next_pages_error"),
    2: (
        "express_handler", "express_middleware", "redux_selector", "redux_action", "redux_thunk", "react_router_loader", "react_router_action", "react_router_component", "nest_provider", "nest_guard", "nest_pipe",
        "nest_interceptor", "next_template", "next_loading", "next_error", "next_not_found", "next_default", "next_middleware", "next_server_action", "next_client_component",
    ),
}


def summary_rank(kind: str = "node_kind", role: str = "framework_role"):
    kinds = {4: ("route",), 3: ("slice", "store"), 2: ()}
    out = F.lit(0)
    for rank in (2, 3, 4):
        hit = F.coalesce(F.col(role).isin(*SUMMARY_ROLES[rank]), F.lit(False))
        if kinds[rank]:
            hit = hit | F.coalesce(F.col(kind).isin(*kinds[rank]), F.lit(False))
        out = F.when(hit, rank).otherwise(out)
    return out


def impact_by_community(graph: PropertyGraph, affected: DataFrame) -> DataFrame:
    """``(community, node_count, distance, path)``: nodes of each affected community and the best way to it, by labels."""
    named = affected.join(graph.nodes.select("id", "community", "node_kind", "framework_role"), "id").where("community is not null")
    labels = graph.nodes.select("id", F.coalesce("label", "id").alias("label"))
    steps = named.select("id", F.posexplode("path").alias("place", "at")).join(labels.withColumnRenamed("id", "at"), "at")
    ways = steps.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]).alias("way"))
    best = F.min(F.struct((-summary_rank()).alias("rank"), "distance", F.array_join("way", "\x00").alias("key"), "way")).alias("b")
    grouped = named.join(ways, "id").groupBy("community").agg(F.count("*").alias("node_count"), best)
    return grouped.select("community", "node_count", F.col("b.distance").alias("distance"), F.col("b.way").alias("path"))


def compact(affected: DataFrame, graph: PropertyGraph) -> DataFrame:
    """Affected nodes with a file type only where they don't all share one, and the shared one in its own column."""
    typed = affected.join(graph.nodes.select("id", "label", "source_file", "file_type"), "id")
    shared = typed.agg(F.when((F.countDistinct("file_type") == 1) & (F.count("*") == F.count("file_type")), F.first("file_type")).alias("shared_file_type"))
    return typed.crossJoin(F.broadcast(shared)).withColumn("file_type", F.when(F.col("shared_file_type").isNull(), F.col("file_type")))  # one row


def best_runtime_paths(graph: PropertyGraph, starts: DataFrame, relation_score: dict[str, int], hops: int = 6) -> DataFrame:
    """``(start, id, hops, score, path)``: for each start and node the way with most hops' relation score, fewest hops first."""
    score = F.coalesce(*(F.when(F.col("relation") == k, v) for k, v in relation_score.items()), F.lit(0))
    edges = graph.edges.select("src", "dst", score.alias("s"))
    seen = staged(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("hops"), F.lit(0).alias("score"), F.array("id").alias("path")))
    for hop in range(1, hops + 1):
        frontier = seen.where(F.col("hops") == hop - 1)
        reached = frontier.join(edges, frontier["id"] == edges["src"]).where(~F.array_contains("path", F.col("dst")))
        reached = reached.select("start", F.col("dst").alias("id"), F.lit(hop).alias("hops"), (F.col("score") + F.col("s")).alias("score"), F.concat("path", F.array("dst")).alias("path"))
        reached = reached.join(seen.select("start", "id"), ["start", "id"], "left_anti")
        best = Window.partitionBy("start", "id").orderBy(F.desc("score"), F.array_join("path", "\x00"))
        reached = staged(reached.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r"))
        if reached.isEmpty():
            break
        seen = seen.union(reached)
    return seen
