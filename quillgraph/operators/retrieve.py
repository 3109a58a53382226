"""Lexical and vector scoring of nodes, rank fusion, expansion along edges, and whole retrieval passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import cosine, match_count, question_tokens, tokens

from quillgraph.plans.staging import staged

from .graph import PropertyGraph, is_entity

K1, B = 1.2, 0.6

# How strongly a relation carries relevance to a neighbour.
RELATION_WEIGHTS = {
    "calls": 1.0, "enqueues_job": 1.0, "imports_from": 1.0, "defines": 1.0, "defines_action": 1.0, "defines_selector": 1.0,
    "contains": 1.2, "renders": 1.2,
    "loads_route": 1.0, "submits_route": 1.0, "registered_in_store": 1.0, "updates_slice": 1.0,
    "uses": 0.7, "depends_on": 0.7,
}
OTHER_WEIGHT = 0.35
#: Weights of the rankings that are fused: exact, phrase, token, path, community, degree, identifier.
RANKING_WEIGHTS = {"exact": 2.0, "phrase": 1.5, "token": 1.5, "path": 0.5, "community": 0.25, "degree": 0.25, "identifier": 1.75}


def words_of(spark: SparkSession, question: str) -> list[str]:
    """The question's tokens without stop words. One row, split on the driver's JVM."""
    return list(spark.range(1).select(question_tokens(F.lit(question)).alias("t")).first()["t"])


def relation_weight(relation: Column | str = "relation") -> Column:
    r = F.col(relation) if isinstance(relation, str) else relation
    out = F.lit(OTHER_WEIGHT)
    for weight in sorted(set(RELATION_WEIGHTS.values())):
        out = F.when(r.isin(*(k for k, v in RELATION_WEIGHTS.items() if v == weight)), weight).otherwise(out)
    return out


def term_score(question: dict[str, float], field: Column, average: Column) -> Column:
    """Weighted sum over the question's tokens of ``tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))``."""
    size = F.greatest(F.size(field), F.lit(1)).cast("double")

    def one(token: str, weight: float) -> Column:
        tf = match_count(F.lit(token), field).cast("double")
        return F.when(tf > 0, F.lit(weight) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / average))).otherwise(0.0)

    return reduce(Column.__add__, [one(t, w) for t, w in question.items()], F.lit(0.0))


def average_label_length(graph: PropertyGraph) -> DataFrame:
    """One row: mean number of tokens of the labels that have any; 1 without such."""
    n = F.size(tokens(F.coalesce("label", F.lit(""))))
    return graph.nodes.select(n.alias("n")).where("n > 0").agg(F.coalesce(F.avg("n"), F.lit(1.0)).alias("average"))


def token_weights(graph: PropertyGraph, question: list[str]) -> DataFrame:
    """``(token, nodes, weight)``: ``max(0.1, ln(1 + (N - n + 0.5) / (n + 0.5)))``, 1 for a token that no label matches."""
    labels = tokens(F.coalesce("label", F.lit("")))
    counts = graph.nodes.select(labels.alias("t")).agg(F.count("*").alias("total"), *(F.count_if(match_count(F.lit(q), F.col("t")) > 0).alias(f"n{i}") for i, q in enumerate(question)))
    rows = counts.select("total", F.explode(F.array(*(F.struct(F.lit(q).alias("token"), F.col(f"n{i}").alias("nodes")) for i, q in enumerate(question)))).alias("r")).select("total", "r.*")
    idf = F.greatest(F.lit(0.1), F.log(1 + (F.col("total") - F.col("nodes") + 0.5) / (F.col("nodes") + 0.5)))
    return rows.select("token", "nodes", F.when(F.col("nodes") > 0, idf).otherwise(1.0).alias("weight"))


def bm25(graph: PropertyGraph, question: str) -> DataFrame:
    """``(id, score)`` of the nodes whose label matches the question's words."""
    spark = graph.nodes.sparkSession
    weights = {r.token: r.weight for r in token_weights(graph, words_of(spark, question)).collect()}  # a row per word asked
    average = average_label_length(graph).first().average
    scored = graph.nodes.select("id", term_score(weights, tokens(F.coalesce("label", F.lit(""))), F.lit(average)).alias("score"))
    return scored.where("score > 0")


def simple_scores(graph: PropertyGraph, terms: list[str], rank_by: str = "relevance", nodes: DataFrame | None = None) -> DataFrame:
    """``(id, score, degree)``: 1 for each term in the label, 0.5 for each in the path, best first."""
    label, path = F.lower(F.coalesce("label", F.lit(""))), F.lower(F.coalesce("source_file", F.lit("")))
    wanted = [t.lower() for t in terms if t]
    score = reduce(Column.__add__, [F.when(label.contains(t), 1.0).otherwise(0.0) + F.when(path.contains(t), 0.5).otherwise(0.0) for t in wanted], F.lit(0.0))
    scored = graph.with_degree(nodes).select("id", score.alias("score"), "degree").where("score > 0")
    first = [F.desc("degree"), F.desc("score")] if rank_by == "degree" else [F.desc("score")]
    return scored.orderBy(*first, F.collate("id", "UNICODE"))


def seed_scores(graph: PropertyGraph, question: str, labels: DataFrame | None = None) -> DataFrame:
    """Seed components of each node and their sum ``total``.

    exact (2 for the whole question), phrase (1 where the label's words follow one another in it), token, path (a quarter), community
    (a tenth, 0.2 at most, over ``labels(community, label)``), and identifier (1.75 for a name quoted in the question).
    """
    spark = graph.nodes.sparkSession
    asked = words_of(spark, question)
    weights = {r.token: r.weight for r in token_weights(graph, asked).collect()} if asked else {}
    average = F.lit(average_label_length(graph).first().average)
    nodes = graph.with_degree().select("id", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("source_file", F.lit("")).alias("file"), "community", "degree")
    if labels is not None:
        nodes = nodes.join(labels.select("community", F.col("label").alias("community_label")), "community", "left")
    else:
        nodes = nodes.withColumn("community_label", F.lit(None).cast("string"))
    name = tokens("label")
    flat = lambda x: F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))
    exact = F.when((flat(F.lit(question)) != "") & (flat(F.lit(question)) == flat(F.col("label"))), 2.0).otherwise(0.0)
    said = F.lit(f" {' '.join(asked)} ")
    phrase = F.when((F.size(name) >= 2) & said.contains(F.concat(F.lit(" "), F.array_join(name, " "), F.lit(" "))), 1.0).otherwise(0.0)
    own = lambda field: F.greatest(F.size(field), F.lit(1)).cast("double")
    path, about = tokens("file"), tokens(F.coalesce("community_label", F.lit("")))
    quoted = F.lit(question).contains(F.col("label")) & F.col("label").rlike(r"[A-Za-z0-9][A-Z_]|[()_.]")
    parts = nodes.select(
        "id", "label", "file", "community", "degree", exact.alias("exact"), phrase.alias("phrase"), term_score(weights, name, average).alias("token"), (term_score(weights, path, own(path)) * 0.25).alias("path"),
        F.least(term_score(dict.fromkeys(asked, 1.0), about, own(about)) * 0.1, F.lit(0.2)).alias("community_score"), F.when((F.col("label") != "") & quoted, 1.75).otherwise(0.0).alias("identifier"),
    )
    return parts.withColumn("total", F.col("exact") + F.col("phrase") + F.col("token") + F.col("path") + F.col("community_score") + F.col("identifier"))


def fuse(rankings: list[tuple[DataFrame, float]], constant: int = 10) -> DataFrame:
    """``(id, fused)``: sum over rankings ``(id, place)`` of ``weight / (constant + place)``, places from 1."""
    parts = [r.select("id", (F.lit(w) / (constant + F.col("place"))).alias("x")) for r, w in rankings]
    return reduce(DataFrame.union, parts).groupBy("id").agg(F.sum("x").alias("fused"))


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """``(id, place)``: the place from 1 of every row in a total ``order``, without one task that sorts them all.

    Rows are dealt by ranges of the order and written; a row's place is its number there and the rows of earlier ranges.
    """
    dealt = staged(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = F.sum("rows").over(Window.orderBy("part")) - F.col("rows")  # a row per task
    earlier = dealt.groupBy("part").agg(F.count("*").alias("rows")).select("part", before.alias("earlier"))
    here = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.withColumn("here", here).join(F.broadcast(earlier), "part").select("id", (F.col("earlier") + F.col("here")).alias("place"))


def ranked(scores: DataFrame, column: str) -> DataFrame:
    """``(id, place)`` of all rows with a positive ``column``."""
    return placed(scores.where(F.col(column) > 0), F.desc(column), F.desc("total"), F.desc("degree"), F.asc("label"), F.asc("file"), F.asc("id"))


def fused_seeds(scores: DataFrame) -> DataFrame:
    """Seeds by reciprocal rank fusion of the seven component rankings."""
    columns = {"exact": "exact", "phrase": "phrase", "token": "token", "path": "path", "community": "community_score", "degree": "degree", "identifier": "identifier"}
    hit = scores.where("total > 0")
    return fuse([(ranked(hit, columns[k]), w) for k, w in RANKING_WEIGHTS.items()])


def semantic_scores(vectors: DataFrame, query: list[float]) -> DataFrame:
    """``(id, score)``: cosine with the query; 0 for empty, unequal or zero vectors."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select("id", cosine(F.col("vector"), q).alias("score"))


def rerank(candidates: DataFrame, model) -> DataFrame:
    """``model`` is a scalar pandas UDF over the text column; its score joins the row. Nothing is scored without one."""
    return candidates.withColumn("rerank", model("text") if model is not None else F.lit(0.0))


def hybrid(lexical: DataFrame, semantic: DataFrame, reranked: DataFrame | None = None, extra: int = 8) -> DataFrame:
    """``lexical + 3 * semantic + 4 * rerank`` over the lexical hits and the ``extra`` best semantic ones."""
    near = semantic.orderBy(F.desc("score"), "id").limit(extra).select("id")
    ids = lexical.select("id").union(near).distinct()
    out = ids.join(lexical.select("id", F.col("score").alias("l")), "id", "left").join(semantic.select("id", F.col("score").alias("s")), "id", "left")
    if reranked is not None:
        out = out.join(reranked.select("id", F.col("score").alias("r")), "id", "left")
    else:
        out = out.withColumn("r", F.lit(0.0))
    zero = lambda n: F.coalesce(n, F.lit(0.0))
    return out.select("id", (zero("l") + 3 * zero("s") + 4 * zero("r")).alias("score"))


def expand(graph: PropertyGraph, seeds: DataFrame, hops: int = 2, most_second: int = 40, relations: tuple[str, ...] = ()) -> DataFrame:
    """``(id, score, hop)``: a neighbour gets half its seed's score times the relation's weight, the best over seeds.

    The second hop starts from the ``most_second`` best nodes of the first.
    """
    edges = graph.edges.where(F.col("relation").isin(*relations)) if relations else graph.edges
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbor"), relation_weight().alias("w")).union(edges.select("dst", "src", relation_weight()))
    known = staged(seeds.select("id", "score", F.lit(0).alias("hop")))
    frontier = known
    for hop in range(1, hops + 1):
        if hop > 1:
            frontier = frontier.orderBy(F.desc("score"), "id").limit(most_second)
        reached = both.join(frontier.select("id", "score"), "id").groupBy("neighbor").agg(F.max(F.col("score") * 0.5 * F.col("w")).alias("score"))
        frontier = staged(reached.select(F.col("neighbor").alias("id"), "score", F.lit(hop).alias("hop")).join(known.select("id"), "id", "left_anti").select("id", "score", "hop"))
        known = known.union(frontier)
    return known


def structural_boosts(scored: DataFrame, graph: PropertyGraph, bridge_ids: DataFrame, hub_ids: DataFrame, home: int | None = None) -> DataFrame:
    """+0.3 for bridges, -0.2 for hubs, +0.1 in the seeds' community."""
    out = scored.join(bridge_ids.select("id", F.lit(0.3).alias("b")), "id", "left").join(hub_ids.select("id", F.lit(-0.2).alias("h")), "id", "left")
    out = out.join(graph.nodes.select("id", "community"), "id")
    near = F.when(F.col("community") == home, 0.1).otherwise(0.0) if home is not None else F.lit(0.0)
    return out.select("id", (F.col("score") + F.coalesce("b", F.lit(0.0)) + F.coalesce("h", F.lit(0.0)) + near).alias("score"))


def induced(graph: PropertyGraph, ids: DataFrame) -> DataFrame:
    """Edges between selected nodes."""
    return graph.edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def mentioned_paths(nodes: DataFrame, paths: list[str]) -> DataFrame:
    """Nodes whose file is, or ends in, one of the paths."""
    wanted = [p.replace("\\", "/") for p in paths]
    file = F.replace(F.coalesce("source_file", F.lit("")), F.lit("\\"), F.lit("/"))
    hit = reduce(Column.__or__, [(file == p) | file.endswith(f"/{p}") for p in wanted], F.lit(False))
    return nodes.where(hit)


def excluded(nodes: DataFrame, words: list[str]) -> DataFrame:
    """Nodes that share no token with the excluded words."""
    return nodes.where(~F.arrays_overlap(tokens(F.concat_ws(" ", "label", "source_file")), F.array(*map(F.lit, words)).cast("array<string>")))


def retrieve(graph: PropertyGraph, question: str, seeds: int = 10, most: int = 40, hops: int = 2) -> DataFrame:
    """``(id, label, source_file, community, band, score)``: fused seeds, then what they reach, best first."""
    graph = graph.staged()
    scores = staged(seed_scores(graph, question).where("total > 0"))
    fused = fused_seeds(scores).select("id", F.greatest(F.lit(0.05), F.col("fused") * 10).alias("score"))
    top = fused.orderBy(F.desc("score"), "id").limit(seeds)
    reached = expand(graph, top, hops)
    band = F.when(F.col("hop") == 0, "direct").when(F.col("hop") == 1, "related").otherwise("peripheral")
    return reached.join(graph.nodes.select("id", "label", "source_file", "community"), "id").select("id", "label", "source_file", "community", band.alias("band"), "score").orderBy(F.desc("score"), "id").limit(most)


def slice_of(graph: PropertyGraph, anchors: DataFrame, relations: tuple[str, ...], depth: int = 2, busy: int = 40) -> DataFrame:
    """``(id, distance)``: what anchors reach both ways over some relations, without passing through nodes of ``busy`` neighbours or more."""
    edges = graph.edges.where(F.col("relation").isin(*relations))
    quiet = graph.with_degree().where(F.col("degree") < busy).select("id")
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbor")).union(edges.select("dst", "src")).distinct()
    known = staged(anchors.select("id", F.lit(0).alias("distance")))
    frontier = known
    for d in range(1, depth + 1):
        through = frontier.select("id") if d == 1 else frontier.select("id").join(quiet, "id", "left_semi")
        frontier = staged(both.join(through, "id", "left_semi").select(F.col("neighbor").alias("id")).distinct().join(known.select("id"), "id", "left_anti").select("id", F.lit(d).alias("distance")))
        known = known.union(frontier)
    return known


def relevant_files(matches: DataFrame, limit: int = 8) -> DataFrame:
    """``(source_file, score, direct, related)`` of ``matches(id, source_file, band, score)`` without the peripheral ones."""
    used = matches.where("band <> 'peripheral' and source_file <> ''")
    out = used.groupBy("source_file").agg(F.sum("score").alias("score"), F.count_if(F.col("band") == "direct").alias("direct"), F.count_if(F.col("band") == "related").alias("related"))
    return out.orderBy(F.desc("direct"), F.desc("score"), F.desc("related"), F.collate("source_file", "UNICODE")).limit(limit)


def feature_map(matches: DataFrame, graph: PropertyGraph, top: int = 5) -> DataFrame:
    """``(community, matched, score, files, entry)``: the communities that a question touches, with their best node."""
    best = F.min(F.struct((-F.col("score")).alias("s"), "label"))["label"]
    grouped = matches.where("community is not null").groupBy("community").agg(F.count("*").alias("matched"), F.sum("score").alias("score"), F.countDistinct("source_file").alias("files"), best.alias("entry"))
    return grouped.orderBy(F.desc("score"), "community").limit(top)


def entity_hits(nodes: DataFrame) -> DataFrame:
    return nodes.where(is_entity())
