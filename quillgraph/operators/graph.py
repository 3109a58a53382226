"""The property graph as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import basename
from quillgraph.plans.staging import spread, staged

NODE_COLUMNS = {"id": "string", "label": "string", "file_type": "string", "source_file": "string", "source_location": "string", "node_kind": "string", "framework_role": "string", "community": "int", "ord": "long"}
EDGE_COLUMNS = {"src": "string", "dst": "string", "relation": "string", "confidence": "string", "weight": "double", "source_file": "string", "ord": "long"}


def conformed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with all of ``columns``, absent ones null, in their types."""
    return df.select(*((F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in columns.items()))


def is_entity(label: str = "label", source_file: str = "source_file") -> Column:
    """Neither a node that stands for its file nor a concept without a file."""
    path, name = F.coalesce(F.col(source_file), F.lit("")), F.coalesce(F.col(label), F.lit(""))
    return (path != "") & basename(path).contains(".") & ((name == "") | (name != basename(path)))


@dataclass(frozen=True)
class PropertyGraph:
    """Nodes by id and at most one edge per pair of ends; ``ord`` keeps the order in which they came.

    ``nodes`` and ``edges`` have the columns of NODE_COLUMNS and EDGE_COLUMNS. An undirected graph has its
    edges as they were given, and treats both directions alike.
    """

    nodes: DataFrame
    edges: DataFrame
    directed: bool = True

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame, directed: bool = True, multigraph: bool = False) -> PropertyGraph:
        """Conform, keep the last row of each id and edge key at the first one's place, and drop dangling edges.

        With ``multigraph`` parallel edges of different relations stay.
        """
        nodes, edges = conformed(nodes, NODE_COLUMNS), conformed(edges, EDGE_COLUMNS)
        row = F.struct(*(n for n in NODE_COLUMNS if n not in ("id", "ord")))
        nodes = nodes.where("id is not null").groupBy("id").agg(F.max_by(row, "ord").alias("r"), F.min("ord").alias("ord")).select("id", "r.*", "ord").select(*NODE_COLUMNS)
        ends = [F.col("src"), F.col("dst")] if directed else [F.least("src", "dst"), F.greatest("src", "dst")]
        keys = [ends[0].alias("k1"), ends[1].alias("k2"), *([F.coalesce("relation", F.lit("")).alias("k3")] if multigraph else [])]
        row = F.struct(*(n for n in EDGE_COLUMNS if n != "ord"))
        edges = edges.groupBy(*keys).agg(F.max_by(row, "ord").alias("r"), F.min("ord").alias("ord")).select("r.*", "ord").select(*EDGE_COLUMNS)
        ids = nodes.select("id")
        edges = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return cls(nodes, edges.select(*EDGE_COLUMNS), directed)

    def staged(self) -> PropertyGraph:
        """The graph written once, for algorithms that read it many times."""
        return replace(self, nodes=staged(self.nodes), edges=staged(self.edges))

    @cached_property
    def incident(self) -> DataFrame:
        """``(id, neighbor)``: every pair of adjacent nodes in both directions, once each; a self loop once.

        Pairs are made distinct before they are turned both ways, so half the rows are shuffled for it.
        """
        swapped = F.coalesce(F.col("src") > F.col("dst"), F.col("src").isNull())  # a null end comes last
        pairs = self.edges.select(F.when(swapped, F.col("dst")).otherwise(F.col("src")).alias("u"), F.when(swapped, F.col("src")).otherwise(F.col("dst")).alias("v"))
        there, back = (F.struct(F.col(a).alias("id"), F.col(b).alias("neighbor")) for a, b in ("uv", "vu"))
        both = F.when(F.col("u").eqNullSafe(F.col("v")), F.array(there)).otherwise(F.array(there, back))
        return spread(pairs, "u", "v").distinct().select(F.explode(both).alias("e")).select("e.*")

    def steps(self, direction: str = "outgoing") -> DataFrame:
        """``(id, neighbor, src, dst)`` for one traversal step: along edges, or both ways if incident or undirected."""
        out = self.edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbor"), "src", "dst")
        back = self.edges.select(F.col("dst").alias("id"), F.col("src").alias("neighbor"), "src", "dst")
        if not self.directed:
            back = self.edges.select(F.col("dst").alias("id"), F.col("src").alias("neighbor"), F.col("dst").alias("src"), F.col("src").alias("dst"))
        return out.union(back) if direction == "incident" or not self.directed else out

    @cached_property
    def degrees(self) -> DataFrame:
        """``(id, degree)`` of nodes that have a neighbour: distinct neighbours, a self loop counting once.

        Ends are counted where their pairs were made distinct, so hubs are counted in part before they meet.
        """
        return self.incident.groupBy("id").agg(F.count("*").alias("degree"))

    @cached_property
    def entities(self) -> DataFrame:
        return self.nodes.where(is_entity())

    def with_degree(self, nodes: DataFrame | None = None) -> DataFrame:
        """Nodes with their degree, 0 for isolated ones."""
        return (self.nodes if nodes is None else nodes).join(self.degrees, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))

    def undirected_pairs(self) -> DataFrame:
        """``(u, v)``: each pair of adjacent nodes once, the smaller id first."""
        return spread(self.edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")), "u", "v").distinct()

    def as_directed(self, directed: bool) -> PropertyGraph:
        """The same graph with its edges keyed the other way."""
        return PropertyGraph.of(self.nodes, self.edges, directed)
