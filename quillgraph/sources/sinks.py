"""Graphs as files: Parquet, JSON documents, GraphML, Cypher, drawings and notes. Lines are written by the executors."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import escape_cypher, escape_xml
from quillgraph.operators.graph import PropertyGraph


def write_tables(graph: PropertyGraph, path: str) -> None:
    """Nodes and edges as Parquet, the form that other jobs read."""
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")


def json_rows(graph: PropertyGraph, membership: DataFrame) -> DataFrame:
    """``(part, value)``: a JSON object per node (with its community, -1 without one) and per link, for JSON lines or an assembled document.

    Weights of 1 are left out, as readers assume them.
    """
    nodes = graph.nodes.drop("community").join(membership, "id", "left").withColumn("community", F.coalesce("community", F.lit(-1)))
    node = F.to_json(F.struct("id", "label", "file_type", "source_file", "source_location", "node_kind", "community"))
    link = F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "relation", "confidence", F.when(F.col("weight") != 1, F.col("weight")).alias("weight"), "source_file"))
    return nodes.select(F.lit("node").alias("part"), node.alias("value")).unionByName(graph.edges.select(F.lit("link").alias("part"), link.alias("value")))


def graphml_lines(graph: PropertyGraph) -> DataFrame:
    """``(place, value)``: the lines of a GraphML document in three places: head, body, tail."""
    kind = "directed" if graph.directed else "undirected"
    keys = "".join(f'<key id="{k}" for="{f}" attr.name="{k}" attr.type="string"/>' for k, f in (("label", "node"), ("file_type", "node"), ("relation", "edge"), ("confidence", "edge")))
    data = lambda k: F.when(F.col(k).isNotNull(), F.concat(F.lit(f'<data key="{k}">'), escape_xml(k), F.lit("</data>"))).otherwise("")
    node = F.concat(F.lit('<node id="'), escape_xml("id"), F.lit('">'), data("label"), data("file_type"), F.lit("</node>"))
    edge = F.concat(F.lit('<edge source="'), escape_xml("src"), F.lit('" target="'), escape_xml("dst"), F.lit('">'), data("relation"), data("confidence"), F.lit("</edge>"))
    fixed = graph.nodes.sparkSession.createDataFrame([(0, f'<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="{kind}">'), (3, "</graph></graphml>")], "place int, value string")
    return fixed.unionByName(graph.nodes.select(F.lit(1).alias("place"), node.alias("value"))).unionByName(graph.edges.select(F.lit(2).alias("place"), edge.alias("value")))


def cypher_lines(graph: PropertyGraph) -> DataFrame:
    """``(place, value)``: MERGE statements for nodes, then for relationships."""
    text = lambda k: escape_cypher(F.coalesce(k, F.lit("")))
    kind = lambda k, other: F.when(F.coalesce(k, F.lit("")) == "", other).otherwise(F.upper(F.regexp_replace(k, "[^A-Za-z0-9_]", "_")))
    node = F.concat(F.lit("MERGE (n:"), F.initcap(kind("file_type", "ENTITY")), F.lit(" {id: '"), text("id"), F.lit("'}) SET n.label = '"), text("label"), F.lit("';"))
    edge = F.concat(F.lit("MATCH (a {id: '"), text("src"), F.lit("'}), (b {id: '"), text("dst"), F.lit("'}) MERGE (a)-[:"), kind("relation", "RELATED_TO"), F.lit(" {confidence: '"), text("confidence"), F.lit("'}]->(b);"))
    return graph.nodes.select(F.lit(0).alias("place"), node.alias("value")).unionByName(graph.edges.select(F.lit(1).alias("place"), edge.alias("value")))


def write_lines(lines: DataFrame, path: str) -> None:
    """Text files whose names sort in the lines' order; concatenated they are the document."""
    lines.repartitionByRange("place").sortWithinPartitions("place").select("value").write.mode("overwrite").text(path)


def layout(membership: DataFrame, columns: int = 5, cell: float = 240.0) -> DataFrame:
    """``(id, x, y)``: communities on a grid, their nodes on a circle."""
    n = F.count("*").over(Window.partitionBy("community"))
    place = F.row_number().over(Window.partitionBy("community").orderBy("id")) - 1
    angle = place / n * (2 * math.pi)
    cx, cy = (F.col("community") % columns + 0.5) * cell, (F.floor(F.col("community") / columns) + 0.5) * cell
    radius = F.least(F.lit(cell * 0.4), 20 + n * 4)
    return membership.select("id", (cx + radius * F.cos(angle)).alias("x"), (cy + radius * F.sin(angle)).alias("y"))


def svg_lines(graph: PropertyGraph, membership: DataFrame) -> DataFrame:
    at = layout(membership)
    a, b = at.select(F.col("id").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1")), at.select(F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    edges = graph.edges.join(a, "src").join(b, "dst").select(F.lit(1).alias("place"), F.format_string('<line x1="%.1f" y1="%.1f" x2="%.1f" y2="%.1f" stroke="#999"/>', "x1", "y1", "x2", "y2").alias("value"))
    nodes = at.join(graph.nodes.select("id", "label"), "id").select(F.lit(2).alias("place"), F.concat(F.format_string('<circle cx="%.1f" cy="%.1f" r="5"><title>', "x", "y"), escape_xml(F.coalesce("label", "id")), F.lit("</title></circle>")).alias("value"))
    fixed = graph.nodes.sparkSession.createDataFrame([(0, '<svg xmlns="http://www.w3.org/2000/svg">'), (3, "</svg>")], "place int, value string")
    return fixed.unionByName(edges).unionByName(nodes)


def notes(graph: PropertyGraph, membership: DataFrame, labels: DataFrame, most: int = 50) -> DataFrame:
    """``(community, value)``: a page per community with its best connected nodes."""
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "id"))
    named = graph.with_degree().drop("community").join(membership, "id").withColumn("r", rank).where(F.col("r") <= most)
    body = named.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.coalesce("label", "id").alias("label"), "degree"))), lambda x: F.concat(F.lit("- "), x["label"], F.lit(" ("), x["degree"].cast("string"), F.lit(")"))), "\n").alias("body"))
    return body.join(labels, "community").select("community", F.concat(F.lit("# "), "label", F.lit("\n\n"), "body", F.lit("\n")).alias("value"))


def saved_answer(question: str, answer: str) -> str:
    """A question and its answer as markdown with a header."""
    quoted = question.replace("\\", "\\\\").replace('"', '\\"')
    return f'---\nquestion: "{quoted}"\n---\n\n{answer}\n'
