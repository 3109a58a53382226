"""Extraction documents and published graphs: reading, validating, normalising, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.graph import EDGE_COLUMNS, NODE_COLUMNS, PropertyGraph, conformed

FILE_TYPES = ("code", "document", "paper", "image", "audio", "video", "rationale")
CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
LAYERS = ("base", "semantic", "media")

PROVENANCE = "array<struct<capability_id:string,stage:string>>"
NODE = f"struct<id:string,label:string,file_type:string,source_file:string,source_location:string,node_kind:string,framework_role:string,community:string,layer:string,provenance:{PROVENANCE}>"
EDGE = f"struct<source:string,target:string,relation:string,confidence:string,confidence_score:double,source_file:string,weight:double,layer:string,provenance:{PROVENANCE}>"
HYPEREDGE = "struct<id:string,label:string,nodes:array<string>,relation:string,confidence:string,source_file:string,layer:string>"
DOCUMENT = f"schema_version int, directed boolean, input_tokens long, output_tokens long, nodes array<{NODE}>, edges array<{EDGE}>, links array<{EDGE}>, hyperedges array<{HYPEREDGE}>, community_labels map<string,string>, semantic_anomalies array<struct<id:string,kind:string,severity:string,score:double,summary:string,why:string>>"


def read_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """One row per JSON document with its file's name; ``links`` stand in for missing ``edges``."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).json(list(paths)).withColumn("path", F.input_file_name())
    return docs.withColumn("edges", F.coalesce("edges", "links")).drop("links")


def rows_of(docs: DataFrame, column: str) -> DataFrame:
    """The rows of a nested array with their place in it (``ord``, over several documents their order too)."""
    return docs.select("path", F.posexplode(column).alias("ord", "r")).select("path", F.col("ord").cast("long").alias("ord"), "r.*")


def derived_confidence(score: Column, confidence: Column) -> Column:
    """A given finite score, or the one that the kind of evidence stands for."""
    given = F.when(score.isNotNull() & ~F.isnan(score), score)
    return F.coalesce(given, F.when(confidence == "AMBIGUOUS", 0.2).when(confidence == "INFERRED", 0.5).when(confidence == "EXTRACTED", 1.0))


def nodes_of(docs: DataFrame) -> DataFrame:
    return rows_of(docs, "nodes").withColumn("community", F.col("community").try_cast("int"))


def edges_of(docs: DataFrame) -> DataFrame:
    edges = rows_of(docs, "edges").withColumnsRenamed({"source": "src", "target": "dst"})
    return edges.withColumn("confidence_score", derived_confidence(F.col("confidence_score"), F.col("confidence")))


def graph_of(docs: DataFrame, directed: bool = False) -> PropertyGraph:
    return PropertyGraph.of(conformed(nodes_of(docs), NODE_COLUMNS), conformed(edges_of(docs), EDGE_COLUMNS), directed)


def merged(docs: DataFrame) -> DataFrame:
    """One row for several documents: the highest schema version, all tokens, and counts of what they hold."""
    size = lambda c: F.sum(F.greatest(F.size(F.coalesce(c, F.array())), F.lit(0))).alias(c)
    return docs.agg(F.coalesce(F.max("schema_version"), F.lit(1)).alias("schema_version"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"), size("nodes"), size("edges"), size("hyperedges"))


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(item, ord, problem)``: missing required fields, unknown values, and edges to unknown nodes."""
    need = lambda *cols: [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in cols]
    known = lambda c, values: F.when(F.col(c).isNotNull() & ~F.col(c).isin(*values), F.concat(F.lit(f"invalid {c} "), c))
    node_problems = [*need("id", "label", "file_type", "source_file"), known("file_type", FILE_TYPES)] + ([known("layer", LAYERS)] if "layer" in nodes.columns else [])
    edge_problems = [*need("src", "dst", "relation", "confidence", "source_file"), known("confidence", CONFIDENCES)]
    per_node = nodes.select(F.lit("node").alias("item"), "ord", F.explode(F.array_compact(F.array(*node_problems))).alias("problem"))
    per_edge = edges.select(F.lit("edge").alias("item"), "ord", F.explode(F.array_compact(F.array(*edge_problems))).alias("problem"))
    ids = nodes.where("id is not null").select("id").distinct()
    lost = [edges.where(f"{end} is not null").join(ids.select(F.col("id").alias(end)), end, "left_anti").select(F.lit("edge").alias("item"), "ord", F.concat(F.lit(f"unknown {end} "), end).alias("problem")) for end in ("src", "dst")]
    return per_node.unionByName(per_edge).unionByName(lost[0]).unionByName(lost[1])


def normalized(rows: DataFrame, ingest: DataFrame | None = None) -> DataFrame:
    """Default layer and provenance; ``ingest(source_file, provenance, ord)`` adds the first record of each file."""
    base = F.array(F.struct(F.lit("baseline").alias("capability_id"), F.lit("extract").alias("stage"))).cast(PROVENANCE)
    out = rows.withColumn("layer", F.coalesce("layer", F.lit("base"))).withColumn("provenance", F.when(F.size(F.coalesce("provenance", F.array().cast(PROVENANCE))) > 0, F.col("provenance")).otherwise(base))
    if ingest is None:
        return out
    first = ingest.groupBy("source_file").agg(F.min_by("provenance", "ord").alias("more"))
    return out.join(first, "source_file", "left").withColumn("provenance", F.when(F.col("more").isNotNull(), F.array_union("provenance", "more")).otherwise(F.col("provenance"))).drop("more")


def whole_hyperedges(hyperedges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hyperedges all of whose members exist."""
    members = hyperedges.select("id", F.explode("nodes").alias("node"))
    lost = members.join(nodes.select(F.col("id").alias("node")), "node", "left_anti").select("id").distinct()
    return hyperedges.join(lost, "id", "left_anti")


def retained(nodes: DataFrame, edges: DataFrame, hyperedges: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What stays when ``removed(source_file)`` are taken out: their nodes and edges go, and what refers to them."""
    kept = nodes.join(removed, "source_file", "left_anti")
    ids = kept.select("id")
    left = edges.join(removed, "source_file", "left_anti").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept, left, whole_hyperedges(hyperedges.join(removed, "source_file", "left_anti"), kept)


def resolved_references(references: DataFrame, nodes: DataFrame) -> DataFrame:
    """``references(owner, name)`` -> ``(owner, id)`` by id or by label in any case, without repeats."""
    flat = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    keys = nodes.select("id", F.col("id").alias("name")).union(nodes.select("id", flat("label")))
    wanted = references.select("owner", "name").union(references.select("owner", flat("name")))
    return wanted.where("name <> ''").join(keys.where("name <> ''"), "name").select("owner", "id").distinct()


def unique_stems(files: DataFrame) -> DataFrame:
    """``files(path)`` -> ``(path, stem)``: names without extension, numbered by path where several agree."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("stem").orderBy("path"))
    return files.select("path", stem.alias("stem")).withColumn("r", rank).select("path", F.when(F.col("r") > 1, F.concat_ws("_", "stem", F.col("r").cast("string"))).otherwise(F.col("stem")).alias("stem"))


def stored_anomalies(docs: DataFrame, most: int = 20, longest: int = 500) -> DataFrame:
    """Anomalies of a published graph whose fields are sound, with texts cut and at most ``most`` of them."""
    rows = rows_of(docs, "semantic_anomalies").where("id is not null and kind is not null and summary is not null and score is not null and severity in ('HIGH', 'MEDIUM', 'LOW')")
    return rows.select("id", "kind", "severity", "score", F.left("summary", F.lit(longest)).alias("summary"), F.left("why", F.lit(longest)).alias("why")).orderBy(F.desc("score"), "id").limit(most)


def stored_labels(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode("community_labels").alias("k", "label")).select(F.col("k").try_cast("int").alias("community"), F.trim("label").alias("label")).where("community is not null and label <> ''")
