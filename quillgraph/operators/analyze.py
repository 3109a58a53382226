"""Bridges, surprises, anomalies, questions, differences between graphs and their history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import file_category, round_half_up, top_directory

from quillgraph.plans.staging import spread, staged

from .centrality import edge_betweenness, node_betweenness
from .community import communities
from .graph import PropertyGraph, is_entity
from .metrics import entity_degrees, entity_subgraph, god_nodes, low_cohesion, neighbor_communities

LOW_VALUE = ("imports", "imports_from", "contains", "method")


def unicode(name: str) -> Column:
    return F.collate(F.col(name), "UNICODE")


def with_ends(graph: PropertyGraph, membership: DataFrame | None = None) -> DataFrame:
    """Edges with both ends' attributes (``s_`` and ``d_``), degrees and communities."""
    nodes = graph.with_degree().withColumn("entity", is_entity())
    if membership is not None:
        nodes = nodes.drop("community").join(membership, "id", "left")
    side = staged(nodes.select("id", F.coalesce("label", "id").alias("label"), F.coalesce("source_file", F.lit("")).alias("file"), "degree", "entity", "community"))
    s = side.select(F.col("id").alias("src"), *(F.col(n).alias(f"s_{n}") for n in ("label", "file", "degree", "entity", "community")))
    d = side.select(F.col("id").alias("dst"), *(F.col(n).alias(f"d_{n}") for n in ("label", "file", "degree", "entity", "community")))
    edges = graph.edges.withColumn("confidence", F.coalesce("confidence", F.lit("EXTRACTED"))).withColumn("relation", F.coalesce("relation", F.lit("")))
    return spread(spread(edges, "src").join(s, "src"), "dst").join(d, "dst")


def bridges(graph: PropertyGraph, membership: DataFrame, top: int | None = 6) -> DataFrame:
    """Entities that touch other communities: ``score = 10 * communities + entity degree + betweenness``, to two places."""
    nodes = graph.entities.select("id", F.coalesce("label", "id").alias("label"))
    home = membership.select("id", "community")
    near = neighbor_communities(graph, nodes.select("id").join(home, "id", "left"), "inner")
    reach = near.groupBy("id").agg(F.sum("n").alias("degree"), F.collect_list("other").alias("others"))
    central = node_betweenness(graph)
    joined = nodes.join(reach, "id").join(home, "id", "left").join(central, "id", "left")
    other = F.filter("others", lambda c: ~c.eqNullSafe(F.col("community")))
    joined = joined.withColumn("connected", F.array_sort(other)).where(F.size("connected") > 0)
    k = F.size("connected")
    score = round_half_up(k * 10 + F.col("degree") + F.coalesce("betweenness", F.lit(0.0)))
    kept = joined.where(~(F.col("community").isNotNull() & (k == 1) & (F.col("degree") <= 1))).withColumn("score", score)
    out = kept.select("id", "label", "community", "connected", "degree", "score").orderBy(F.desc(F.size("connected")), F.desc("score"), F.desc("degree"), unicode("label"), "id")
    return out if top is None else out.limit(top)


def surprise_score() -> Column:
    """Over ``with_ends``: weaker evidence, other kinds of file, other directories, other communities, hubs met at the rim."""
    confidence = F.when(F.col("confidence") == "AMBIGUOUS", 3).when(F.col("confidence") == "INFERRED", 2).otherwise(1)
    kinds = F.when(file_category("s_file") != file_category("d_file"), 2).otherwise(0)
    places = F.when(top_directory("s_file") != top_directory("d_file"), 2).otherwise(0)
    apart = F.when(F.col("s_community") != F.col("d_community"), 1).otherwise(0)
    base = confidence + kinds + places + apart
    base = F.when(F.col("relation") == "semantically_similar_to", (base * 1.5).cast("int")).otherwise(base)
    rim = (F.least("s_degree", "d_degree") <= 2) & (F.greatest("s_degree", "d_degree") >= 5)
    return base + F.when(rim, 1).otherwise(0)


def surprise_reasons() -> Column:
    say = lambda when, text: F.when(when, text)
    low = F.col("s_degree") <= 2
    rim = (F.least("s_degree", "d_degree") <= 2) & (F.greatest("s_degree", "d_degree") >= 5)
    reasons = F.array(
        say(F.col("confidence").isin("AMBIGUOUS", "INFERRED"), F.concat(F.lower("confidence"), F.lit(" connection - not explicitly stated in source"))),
        say(file_category("s_file") != file_category("d_file"), F.concat(F.lit("crosses file types ("), file_category("s_file"), F.lit(" ↔ "), file_category("d_file"), F.lit(")"))),
        say(top_directory("s_file") != top_directory("d_file"), F.lit("connects across different repos/directories")),
        say(F.col("s_community") != F.col("d_community"), F.lit("bridges separate communities")),
        say(F.col("relation") == "semantically_similar_to", F.lit("semantically similar concepts with no structural link")),
        say(rim, F.concat(F.lit("peripheral node `"), F.when(low, F.col("s_label")).otherwise(F.col("d_label")), F.lit("` unexpectedly reaches hub `"), F.when(low, F.col("d_label")).otherwise(F.col("s_label")), F.lit("`"))),
    )
    return F.array_compact(reasons)


def cross_file_surprises(graph: PropertyGraph, membership: DataFrame, top: int = 5) -> DataFrame:
    ends = with_ends(graph, membership).where(~F.col("relation").isin(*LOW_VALUE) & F.col("s_entity") & F.col("d_entity") & (F.col("s_file") != "") & (F.col("d_file") != "") & (F.col("s_file") != F.col("d_file")))
    order = [F.desc("score"), F.col("ord"), F.col("src"), F.col("dst")]
    ends = ends.withColumn("score", surprise_score()).drop("s_label", "d_label")
    best = ends.orderBy(*order).limit(top)  # labels are joined to these few only
    names = graph.nodes.select("id", F.coalesce("label", "id").alias("label"))
    for side, end in (("s_label", "src"), ("d_label", "dst")):
        best = F.broadcast(best).join(names.select(F.col("id").alias(end), F.col("label").alias(side)), end)
    why = F.when(F.size(surprise_reasons()) > 0, F.array_join(surprise_reasons(), "; ")).otherwise("cross-file semantic connection")
    return best.orderBy(*order).select("src", "dst", F.col("s_label").alias("source"), F.col("d_label").alias("target"), "s_file", "d_file", "relation", "confidence", "score", why.alias("why"))


def cross_community_surprises(graph: PropertyGraph, membership: DataFrame, top: int = 5) -> DataFrame:
    """The weakest-evidenced edge between each two communities."""
    ends = with_ends(graph, membership).where(~F.col("relation").isin(*LOW_VALUE) & F.col("s_entity") & F.col("d_entity") & (F.col("s_community") != F.col("d_community")))
    priority = F.when(F.col("confidence") == "AMBIGUOUS", 0).when(F.col("confidence") == "INFERRED", 1).when(F.col("confidence") == "EXTRACTED", 2).otherwise(3)
    pair = Window.partitionBy(F.least("s_community", "d_community"), F.greatest("s_community", "d_community")).orderBy("priority", "ord", "src", "dst")
    first = ends.withColumn("priority", priority).withColumn("r", F.row_number().over(pair)).where("r = 1")
    why = F.concat(F.lit("bridges community "), F.col("s_community").cast("string"), F.lit(" → community "), F.col("d_community").cast("string"))
    return first.orderBy("priority", "ord", "src", "dst").limit(top).select("src", "dst", F.col("s_label").alias("source"), F.col("d_label").alias("target"), "s_file", "d_file", "relation", "confidence", F.lit(None).cast("int").alias("score"), why.alias("why"))


def surprises(graph: PropertyGraph, membership: DataFrame, top: int = 5) -> DataFrame:
    """Across files where there are several; else across communities; without those, by edge betweenness."""
    files = graph.nodes.where("source_file <> ''").select("source_file").distinct().limit(2).count()
    if files > 1:
        return cross_file_surprises(graph, membership, top)
    if not membership.isEmpty():
        return cross_community_surprises(graph, membership, top)
    ends = with_ends(graph).join(edge_betweenness(graph).select(F.col("u"), F.col("v"), "betweenness"), (F.least("src", "dst") == F.col("u")) & (F.greatest("src", "dst") == F.col("v")))
    why = F.format_string("bridges graph structure (betweenness=%.3f)", F.col("betweenness"))
    return ends.orderBy(F.desc("betweenness"), "ord", "src", "dst").limit(top).select("src", "dst", F.col("s_label").alias("source"), F.col("d_label").alias("target"), "s_file", "d_file", "relation", "confidence", F.lit(None).cast("int").alias("score"), why.alias("why"))


def severity(score: Column, high: float, medium: float) -> Column:
    return F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")


def bridge_nodes(graph: PropertyGraph, membership: DataFrame) -> DataFrame:
    """``(id, label, betweenness, others)``: entities on shortest paths whose successors lie in other communities."""
    central = node_betweenness(graph).where("betweenness > 0").join(graph.entities.select("id", F.coalesce("label", "id").alias("label")), "id")
    step = graph.steps("outgoing").select("id", "neighbor").distinct()
    other = membership.select(F.col("id").alias("neighbor"), F.col("community").alias("other"))
    home = membership.select("id", "community")
    reach = step.join(other, "neighbor").join(home, "id", "left").where(~F.col("other").eqNullSafe(F.col("community"))).groupBy("id", "community").agg(F.array_sort(F.collect_set("other")).alias("others"))
    return central.join(reach, "id").select("id", "label", "community", "betweenness", "others")


def anomalies(graph: PropertyGraph, membership: DataFrame, top: int = 5, per_kind: int = 3) -> DataFrame:
    """Chokepoints, thin communities and unexpected edges, the highest scores, a few of each kind."""
    number = lambda c_: F.concat(F.lit("Community "), c_.cast("string"))
    b = bridge_nodes(graph, membership)
    score = round_half_up(F.col("betweenness") * (F.size("others") + 1))
    home = F.when(F.col("community").isNull(), "its home community").otherwise(number(F.col("community")))
    chokes = b.select(
        F.concat(F.lit("bridge_node:"), "id").alias("id"), F.lit("bridge_node").alias("kind"), score.alias("score"), severity(score, 4, 1.5).alias("severity"),
        F.concat("label", F.lit(" bridges "), home, F.lit(" and "), F.array_join(F.transform("others", number), ", "), F.lit(".")).alias("summary"),
    )
    inner = entity_subgraph(graph)
    thin = low_cohesion(inner, communities(inner))
    score = round_half_up((F.lit(0.15) - F.col("cohesion")) * F.col("n") * 10)
    thin = thin.select(F.concat(F.lit("low_cohesion_community:"), F.col("community").cast("string")).alias("id"), F.lit("low_cohesion_community").alias("kind"), score.alias("score"), severity(score, 6, 3).alias("severity"), F.concat(number(F.col("community")), F.lit(" is weakly connected for its size.")).alias("summary"))
    odd = surprises(graph, membership, max(2 * top, 5))
    score = (F.when(F.col("confidence") == "AMBIGUOUS", 4).when(F.col("confidence") == "INFERRED", 3).otherwise(2) + F.when(F.col("s_file") != F.col("d_file"), 2).otherwise(0) + F.when(F.col("why").contains("bridges"), 1).otherwise(0)).cast("double")
    odd = odd.select(F.concat(F.lit("cross_boundary_edge:"), "source", F.lit("->"), "target", F.lit(":"), "relation").alias("id"), F.lit("cross_boundary_edge").alias("kind"), score.alias("score"), severity(score, 5, 3).alias("severity"), F.concat("source", F.lit(" → "), "target", F.lit(" crosses graph boundaries in an unexpected way.")).alias("summary"))
    order = [F.desc("score"), unicode("summary"), F.col("id")]
    ranked = chokes.unionByName(thin).unionByName(odd).withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy(*order)))
    return ranked.where(F.col("r") <= per_kind).orderBy(*order).limit(top).drop("r")


def questions(graph: PropertyGraph, membership: DataFrame, top: int = 7) -> DataFrame:
    """``(type, question)`` worth asking: unclear edges, bridges, inferred edges of hubs, isolated nodes, thin communities."""
    tick = lambda x: F.concat(F.lit("`"), x, F.lit("`"))
    number = lambda c_: F.concat(F.lit("Community "), c_.cast("string"))
    ends = with_ends(graph, membership)
    unclear = ends.where("confidence = 'AMBIGUOUS'").select(F.lit(0).alias("k"), F.col("ord").cast("double").alias("o"), F.lit("ambiguous_edge").alias("type"), F.concat(F.lit("What is the exact relationship between "), tick(F.col("s_label")), F.lit(" and "), tick(F.col("d_label")), F.lit("?")).alias("question"))
    unclear = unclear.orderBy("o", "question").limit(top)
    b = bridge_nodes(graph, membership).orderBy(F.desc("betweenness"), unicode("label"), "id").limit(3)
    across = b.select(F.lit(1).alias("k"), (-F.col("betweenness")).alias("o"), F.lit("bridge_node").alias("type"), F.concat(F.lit("Why does "), tick(F.col("label")), F.lit(" connect "), tick(F.coalesce(number(F.col("community")), F.lit("unknown"))), F.lit(" to "), F.array_join(F.transform("others", lambda x: tick(number(x))), ", "), F.lit("?")).alias("question"))
    hubs = god_nodes(graph, 5)
    inferred = ends.where("confidence = 'INFERRED'").select("ord", F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"), F.col("src"), F.col("s_label"), F.col("d_label"))
    guessed = inferred.join(F.broadcast(hubs.select("id", "label", "edges")), "id").withColumn("other", F.when(F.col("src") == F.col("id"), F.col("d_label")).otherwise(F.col("s_label")))  # five rows
    seen = guessed.groupBy("id", "label", "edges").agg(F.count("*").alias("n"), F.min_by("other", F.struct("ord", "other")).alias("one"), F.array_sort(F.collect_set("other")).alias("all"))
    check = seen.where("n >= 2").select(F.lit(2).alias("k"), (-F.col("edges")).cast("double").alias("o"), F.lit("verify_inferred").alias("type"), F.concat(F.lit("Are the "), F.col("n").cast("string"), F.lit(" inferred relationships involving "), tick(F.col("label")), F.lit(" (e.g. with "), tick(F.col("one")), F.lit(") actually correct?")).alias("question"))
    alone = graph.entities.select("id", F.coalesce("label", "id").alias("label"), "ord").join(entity_degrees(graph).where("degree <= 1"), "id")
    names = alone.orderBy("ord", "id").limit(3).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "label"))), lambda x: tick(x["label"])), ", ").alias("names"), F.count("*").alias("n"))
    lost = names.where("n > 0").select(F.lit(3).alias("k"), F.lit(0.0).alias("o"), F.lit("isolated_nodes").alias("type"), F.concat(F.lit("What connects "), "names", F.lit(" to the rest of the system?")).alias("question"))
    inner = entity_subgraph(graph)
    thin = low_cohesion(inner, communities(inner)).select(F.lit(4).alias("k"), (-F.col("n")).cast("double").alias("o"), F.lit("low_cohesion").alias("type"), F.concat(F.lit("Should "), tick(number(F.col("community"))), F.lit(" be split into smaller, more focused modules?")).alias("question"))
    found = unclear.unionByName(across).unionByName(check).unionByName(lost).unionByName(thin).orderBy("k", "o", "question").limit(top).select("type", "question")
    if found.isEmpty():
        return graph.nodes.sparkSession.createDataFrame([("no_signal", None)], "type string, question string")
    return found


def edge_keys(graph: PropertyGraph) -> DataFrame:
    ends = (F.col("src"), F.col("dst")) if graph.directed else (F.least("src", "dst"), F.greatest("src", "dst"))
    return graph.edges.select(ends[0].alias("k1"), ends[1].alias("k2"), F.coalesce("relation", F.lit("")).alias("relation"), "src", "dst", F.coalesce("confidence", F.lit("")).alias("confidence"))


def graph_diff(old: PropertyGraph, new: PropertyGraph) -> DataFrame:
    """``(change, id, src, dst, relation)`` of nodes and edges that only one graph has."""
    key = ["k1", "k2", "relation"]
    none = F.lit(None).cast("string")
    node = lambda a, b, name: a.nodes.select("id").join(b.nodes.select("id"), "id", "left_anti").select(F.lit(name).alias("change"), "id", none.alias("src"), none.alias("dst"), none.alias("relation"))
    edge = lambda a, b, name: edge_keys(a).join(edge_keys(b).select(*key), key, "left_anti").select(F.lit(name).alias("change"), none.alias("id"), "src", "dst", "relation")
    return node(new, old, "node_added").unionByName(node(old, new, "node_removed")).unionByName(edge(new, old, "edge_added")).unionByName(edge(old, new, "edge_removed"))


def diff_summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change").agg(F.count("*").alias("n"))


def diff_sections(diff: DataFrame, limit: int = 10) -> DataFrame:
    """At most ``limit`` rows of each kind of change."""
    rank = F.row_number().over(Window.partitionBy("change").orderBy("id", "src", "dst", "relation"))
    return diff.withColumn("r", rank).where(F.col("r") <= limit).drop("r")


def moved_nodes(old: PropertyGraph, new: PropertyGraph) -> DataFrame:
    """Nodes of both graphs whose community changed, null being a community of its own."""
    a = old.nodes.select("id", F.col("community").alias("from_community"))
    b = new.nodes.select("id", F.coalesce("label", "id").alias("label"), F.col("community").alias("to_community"))
    return a.join(b, "id").where(~F.col("from_community").eqNullSafe(F.col("to_community")))


def changed_communities(old: PropertyGraph, new: PropertyGraph, limit: int | None = None) -> DataFrame:
    """``(community, changes)``: one per added or removed node, per end of such an edge, and per side of a move."""
    diff = graph_diff(old, new)
    ends = diff.select("change", F.explode(F.array_compact(F.array("id", "src", "dst"))).alias("id"))
    a, b = old.nodes.select("id", F.col("community").alias("c")), new.nodes.select("id", F.col("community").alias("c"))
    added = ends.where(F.col("change").endswith("_added")).join(b, "id").select("c")
    removed = ends.where(F.col("change").endswith("_removed")).join(a, "id").select("c")
    moved = moved_nodes(old, new).select(F.explode(F.array("from_community", "to_community")).alias("c"))
    out = added.union(removed).union(moved).where("c is not null").groupBy(F.col("c").alias("community")).agg(F.count("*").alias("changes")).orderBy(F.desc("changes"), "community")
    return out if limit is None else out.limit(limit)


def timeline(old: PropertyGraph, new: PropertyGraph, limit: int | None = None) -> DataFrame:
    """``(kind, label, community, relation)`` of all changes: moves, nodes, then edges."""
    place = F.when(F.col("kind") == "community_moved", 0).when(F.col("kind") == "node_added", 1).when(F.col("kind") == "node_removed", 2).when(F.col("kind") == "edge_added", 3).otherwise(4)
    moved = moved_nodes(old, new).select(F.lit("community_moved").alias("kind"), "label", F.col("to_community").alias("community"), F.lit(None).cast("string").alias("relation"))
    diff = graph_diff(old, new)
    names = new.nodes.select("id", F.coalesce("label", "id").alias("label"), "community").unionByName(old.nodes.join(new.nodes.select("id"), "id", "left_anti").select("id", F.coalesce("label", "id").alias("label"), "community"))
    nodes = diff.where("id is not null").join(names, "id").select(F.col("change").alias("kind"), "label", "community", F.lit(None).cast("string").alias("relation"))
    s, d = names.select(F.col("id").alias("src"), F.col("label").alias("sl")), names.select(F.col("id").alias("dst"), F.col("label").alias("dl"))
    edges = diff.where("id is null").join(s, "src").join(d, "dst").select(F.col("change").alias("kind"), F.concat("sl", F.lit(" → "), "dl").alias("label"), F.lit(None).cast("int").alias("community"), "relation")
    out = moved.unionByName(nodes).unionByName(edges)
    return out if limit is None else out.withColumn("place", place).orderBy("place", "label", "relation").limit(limit).drop("place")


def partition_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(community, best, overlap)``: for each community of ``a`` the one of ``b`` that shares most members."""
    both = a.select("id", F.col("community").alias("ca")).join(b.select("id", F.col("community").alias("cb")), "id").groupBy("ca", "cb").agg(F.count("*").alias("n"))
    return both.groupBy(F.col("ca").alias("community")).agg(F.min(F.struct((-F.col("n")).alias("n"), "cb")).alias("m")).select("community", F.col("m.cb").alias("best"), (-F.col("m.n")).alias("overlap"))


def report(graph: PropertyGraph, membership: DataFrame, top: int = 5) -> DataFrame:
    """``(section, place, line)``: the hubs, bridges, surprises and questions as lines of text."""
    line = lambda df, name, text: df.select(F.lit(name).alias("section"), F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).alias("place"), text.alias("line"))
    hubs = line(god_nodes(graph, top), "hubs", F.concat("label", F.lit(" ["), F.col("edges").cast("string"), F.lit(" edges]")))
    across = line(bridges(graph, membership, top), "bridges", F.concat("label", F.lit(" ["), F.col("score").cast("string"), F.lit("]")))
    odd = line(surprises(graph, membership, top), "surprises", F.concat("source", F.lit(" --"), "relation", F.lit("--> "), "target", F.lit(": "), "why"))
    ask = line(questions(graph, membership, top), "questions", F.col("question"))
    return hubs.unionByName(across).unionByName(odd).unionByName(ask)
