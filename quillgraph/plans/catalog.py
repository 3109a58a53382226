"""Every operator as a named query over the test tables, with the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import analyze, budget, centrality, community, components, federation, interpret, metrics, retrieve, review, traverse
from quillgraph.operators.graph import EDGE_COLUMNS, PropertyGraph, conformed
from quillgraph.sources import extraction, files, sinks, text_parsers

from . import bindings as B
from .staging import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

PI_SHIFT = 1
OLD, NEW = "1995-06-01", "1996-06-01"
QUESTION = "How does the Customer order Building parts in EUROPE?"
ASKED = ["customer", "order", "building", "parts", "europe"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- degrees, statistics, communities


@query("degrees", B.TRADE + " select id, degree from degrees")
def degrees(spark, d):
    return B.trade(spark, d).degrees.select("id", "degree")


@query("god_nodes", B.TRADE + " select id, label, degree as edges from entities join degrees using (id) order by degree desc, label, id limit 10")
def god_nodes(spark, d):
    return metrics.god_nodes(B.trade(spark, d))


@query("entity_degrees", B.TRADE + " select n.id, coalesce(c.degree, 0) as degree from nodes n left join (select i.id, count(*) as degree from incident i join entities e on i.neighbor = e.id group by i.id) c on n.id = c.id")
def entity_degrees(spark, d):
    return metrics.entity_degrees(B.trade(spark, d))


@query("entities", B.TRADE + " select id, label, source_file from entities")
def entities(spark, d):
    return B.trade(spark, d).entities.select("id", "label", "source_file")


@query("file_nodes", B.PLACES + """, named as (select n.id, case when n.id like 'n:%' then 'nations.md' when n.id like 's:%' then '.' || label || '()' when n.id like 'c:%' then label || '()' else label end as label, source_file, coalesce(degree, 0) as degree from nodes n left join degrees using (id))
select id, label, source_file, degree from named where label = string_split(source_file, '/')[-1] or label like '.%()' or (label like '%()' and degree <= 1)""")
def file_nodes(spark, d):
    g = B.places(spark, d)
    at = lambda p: F.col("id").startswith(p)
    label = F.when(at("n:"), "nations.md").when(at("s:"), F.concat(F.lit("."), "label", F.lit("()"))).when(at("c:"), F.concat("label", F.lit("()"))).otherwise(F.col("label"))
    return metrics.file_nodes(PropertyGraph(g.nodes.withColumn("label", label), g.edges))


@query("incident_sample", B.SUPPLY + """,
sides as (select src as id, dst as neighbor, 0 as side, ord from edges union all select dst, src, 1, ord from edges),
turns as (select *, row_number() over (partition by id, side order by ord, neighbor) as turn from sides),
once as (select id, neighbor, min((turn, side)) as turn_at from turns group by id, neighbor),
placed as (select id, neighbor, row_number() over (partition by id order by turn_at, neighbor) as place from once)
select id, neighbor, cast(place as integer) as place from placed where place <= 3""")
def incident_sample(spark, d):
    return metrics.incident_sample(B.supply(spark, d), 3)


@query("graph_stats", B.TRADE + """ select (select count(*) from nodes) as nodes, count(*) as edges, (select count(distinct community) from nodes) as communities,
cast(floor(avg(case when confidence = 'EXTRACTED' then 1.0 else 0 end) * 100 + 0.5) as integer) as extracted,
cast(floor(avg(case when confidence = 'INFERRED' then 1.0 else 0 end) * 100 + 0.5) as integer) as inferred,
cast(floor(avg(case when confidence = 'AMBIGUOUS' then 1.0 else 0 end) * 100 + 0.5) as integer) as ambiguous from edges""")
def graph_stats(spark, d):
    return metrics.graph_stats(B.trade(spark, d))


_COHESION = """,
pairs as (select distinct least(src, dst) as u, greatest(src, dst) as v from edges),
sizes as (select community, count(*) as n from nodes group by 1),
inner_pairs as (select a.community, count(*) as k from pairs join nodes a on u = a.id join nodes b on v = b.id where a.community = b.community group by 1),
cohesion as (select s.community, n, coalesce(k, 0) as edges, case when n <= 1 then 1.0 else floor(coalesce(k, 0) / (n * (n - 1) / 2.0) * 100.0 + 0.5) / 100.0 end::double as cohesion from sizes s left join inner_pairs using (community))"""


@query("cohesion", B.TRADE + _COHESION + " select community, n, edges, cohesion from cohesion")
def cohesion(spark, d):
    g = B.trade(spark, d)
    return metrics.cohesion(g, metrics.membership_of(g))


@query("low_cohesion", B.TRADE + """,
pairs as (select distinct least(src, dst) as u, greatest(src, dst) as v from edges),
sizes as (select community, count(*) as n from entities group by 1),
k as (select a.community, count(*) as k from pairs join entities a on u = a.id join entities b on v = b.id where a.community = b.community group by 1),
c as (select s.community, n, coalesce(k, 0) as edges, floor(coalesce(k, 0) / (n * (n - 1) / 2.0) * 100.0 + 0.5) / 100.0 as cohesion from sizes s left join k using (community))
select community, n, edges, cohesion from c where n >= 5 and cohesion < 0.15""")
def low_cohesion(spark, d):
    g = B.trade(spark, d)
    return metrics.low_cohesion(g, metrics.membership_of(g))


@query("community_overview", B.TRADE + """,
r as (select n.community, coalesce(label, n.id) as label, row_number() over (partition by n.community order by coalesce(degree, 0) desc, ord, n.id) as r from nodes n left join degrees using (id))
select community, count(*) as node_count, list(label order by r) filter (where r <= 3) as top_nodes from r group by community""")
def community_overview(spark, d):
    g = B.trade(spark, d)
    return metrics.community_overview(g, metrics.membership_of(g))


@query("community_details", B.TRADE + _COHESION + """,
outside as (select i.id, a.community, b.community as other from incident i join nodes a on i.id = a.id join nodes b on i.neighbor = b.id where a.community <> b.community),
per as (select community, id, count(distinct other) as others, count(*) as n from outside group by 1, 2),
ends as (select community, count(*) as entry_points, count(*) filter (where others >= 2) as bridge_nodes, max(n) as most_outside from per group by 1),
fc as (select community, source_file, row_number() over (partition by community order by count(*) desc, source_file) as r from nodes group by 1, 2)
select c.community, n as node_count, edges as edge_count, coalesce(entry_points, 0) as entry_points, coalesce(bridge_nodes, 0) as bridge_nodes, coalesce(most_outside, 0) as most_outside, f.source_file as dominant_file
from cohesion c left join ends using (community) left join fc f on c.community = f.community and f.r = 1""")
def community_details(spark, d):
    g = B.trade(spark, d)
    return metrics.community_details(g, metrics.membership_of(g))


@query("community_edges", B.PLACES + """
select e.src, e.dst, a.label as "from", b.label as "to", relation, case when a.community = 2 and b.community = 2 then 'internal' else 'cross' end as kind,
case when a.community = 2 and b.community = 2 then null when a.community = 2 then b.community else a.community end as other_community
from edges e join nodes a on src = a.id join nodes b on dst = b.id where a.community = 2 or b.community = 2""")
def community_edges(spark, d):
    g = B.places(spark, d)
    return metrics.community_edges(g, metrics.membership_of(g), 2)


@query("file_distribution", B.TRADE + " select community, source_file, count(*) as node_count from nodes group by 1, 2")
def file_distribution(spark, d):
    g = B.trade(spark, d)
    return metrics.file_distribution(g, metrics.membership_of(g))


@query("cross_community_links", B.TRADE + " select least(a.community, b.community) as a, greatest(a.community, b.community) as b, count(*) as links from edges join nodes a on src = a.id join nodes b on dst = b.id where a.community <> b.community group by 1, 2")
def cross_community_links(spark, d):
    g = B.trade(spark, d)
    return metrics.cross_community_links(g, metrics.membership_of(g))


@query("confidence_audit", B.TRADE + """,
t as (select n.community, src, dst, confidence from edges join nodes n on n.id = src union select n.community, src, dst, confidence from edges join nodes n on n.id = dst)
select community, count(*) filter (where confidence = 'EXTRACTED') as extracted, count(*) filter (where confidence = 'INFERRED') as inferred, count(*) filter (where confidence = 'AMBIGUOUS') as ambiguous from t group by 1""")
def confidence_audit(spark, d):
    g = B.trade(spark, d)
    return metrics.confidence_audit(g, metrics.membership_of(g))


@query("community_labels")
def community_labels(spark, d):
    g = B.trade(spark, d)
    return metrics.community_labels(g, metrics.membership_of(g))


@query("node_card", B.PLACES + " select n.id, label, source_file, community, degree from nodes n join degrees using (id) where lower(label) = 'germany'")
def node_card(spark, d):
    name = table(spark, d, "nation").where("n_nationkey = 7").first()["n_name"]
    return metrics.node_card(B.places(spark, d), name).select("id", "label", "source_file", "community", "degree")


ORACLE_SQL["node_card"] = B.PLACES + " select n.id, label, source_file, community, degree from nodes n join degrees using (id) where n.id = 'n:7'"


@query("node_neighbors", B.PLACES + " select dst, n.label, relation, confidence from edges join nodes n on dst = n.id where src = 's:3' and contains(relation, 'locat')")
def node_neighbors(spark, d):
    name = table(spark, d, "supplier").where("s_suppkey = 3").first()["s_name"]
    return metrics.neighbors_of(B.places(spark, d), name, "LOCAT")


@query("community_members", B.TRADE + " select id, label, source_file from nodes where community = 3")
def community_members(spark, d):
    g = B.trade(spark, d)
    return metrics.community_members(g, metrics.membership_of(g), 3)


@query("query_filter", B.TRADE + " select id, label from nodes where community = 1 and file_type = 'code'")
def query_filter(spark, d):
    return metrics.query_filter(B.trade(spark, d).nodes, "1", " Code ").select("id", "label")


@query("entity_subgraph", B.PLACES + " select src, dst, relation from edges where src in (select id from entities) and dst in (select id from entities)")
def entity_subgraph(spark, d):
    return metrics.entity_subgraph(B.places(spark, d)).edges.select("src", "dst", "relation")


@query("components", """with nodes as (select 't:' || conv_id || ':' || turn as id, conv_id, turn from conversations),
runs as (select *, turn - row_number() over (partition by conv_id order by turn) as run from nodes)
select id, min(id) over (partition by conv_id, run) as component from runs""")
def components_(spark, d):
    g = B.chat(spark, d)
    return components.connected_components(g.nodes.select("id"), g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))


@query("structure", """with nodes as (select conv_id, turn from conversations),
runs as (select *, turn - row_number() over (partition by conv_id order by turn) as run from nodes),
sizes as (select conv_id, run, count(*) as n from runs group by 1, 2)
select cast(sum(n) as bigint) as nodes, cast(sum(n) - count(*) as bigint) as edges, count(*) as components, count(*) filter (where n = 1) as singletons, max(n) as largest, max(n) / sum(n) as largest_share from sizes""")
def structure(spark, d):
    return metrics.structure(B.chat(spark, d))


@query("communities")
def communities(spark, d):
    return community.communities(B.events(spark, d))


@query("communities_places")
def communities_places(spark, d):
    return community.communities(B.places(spark, d))


@query("label_propagation")
def label_propagation(spark, d):
    return community.label_propagation(B.places(spark, d))


@query("node_betweenness")
def node_betweenness(spark, d):
    return centrality.node_betweenness(B.supply(spark, d))


@query("edge_betweenness")
def edge_betweenness(spark, d):
    return centrality.edge_betweenness(B.supply(spark, d))


# --- analysis


@query("bridges", B.TRADE + """,
near as (select i.id, i.neighbor from incident i join entities a on i.id = a.id join entities b on i.neighbor = b.id),
deg as (select id, count(*) as degree from near group by 1),
reach as (select n.id, list(distinct b.community order by b.community) as connected from near n join nodes a on n.id = a.id join nodes b on n.neighbor = b.id where a.community <> b.community group by 1)
select e.id, e.label, e.community, connected, degree, floor((len(connected) * 10 + degree) * 100.0 + 0.5) / 100.0 as score
from entities e join reach using (id) join deg using (id) where not (len(connected) = 1 and degree <= 1)
order by len(connected) desc, score desc, degree desc, label, id limit 6""")
def bridges(spark, d):
    g = B.trade(spark, d)
    return analyze.bridges(g, metrics.membership_of(g))


_ENDS = """,
side as (select n.id, n.label, n.source_file, n.community, coalesce(degree, 0) as degree, string_split(n.source_file, '/')[1] as top, string_split(n.source_file, '.')[-1] as ext, n.id in (select id from entities) as entity from nodes n left join degrees using (id)),
ends as (select e.*, s.label as sl, t.label as tl, s.source_file as sf, t.source_file as tf, s.degree as sd, t.degree as td, s.community as sc, t.community as tc, s.top as st, t.top as tt, s.ext as se, t.ext as te, s.entity and t.entity as both_entities from edges e join side s on src = s.id join side t on dst = t.id)"""


@query("surprise_scores", B.TRADE + _ENDS + """
select src, dst, cast(case confidence when 'AMBIGUOUS' then 3 when 'INFERRED' then 2 else 1 end + case when (se = 'md') <> (te = 'md') then 2 else 0 end + case when st <> tt then 2 else 0 end
 + case when sc <> tc then 1 else 0 end + case when least(sd, td) <= 2 and greatest(sd, td) >= 5 then 1 else 0 end as integer) as score from ends""")
def surprise_scores(spark, d):
    g = B.trade(spark, d)
    return analyze.with_ends(g, metrics.membership_of(g)).select("src", "dst", analyze.surprise_score().alias("score"))


@query("surprises")
def surprises(spark, d):
    g = B.trade(spark, d)
    return analyze.surprises(g, metrics.membership_of(g))


@query("cross_community_surprises", B.TRADE + _ENDS + """,
r as (select *, case confidence when 'AMBIGUOUS' then 0 when 'INFERRED' then 1 else 2 end as p from ends where both_entities and sc <> tc and relation not in ('imports', 'imports_from', 'contains', 'method')),
f as (select *, row_number() over (partition by least(sc, tc), greatest(sc, tc) order by p, ord, src, dst) as k from r)
select src, dst, confidence, 'bridges community ' || sc || ' → community ' || tc as why from f where k = 1 order by p, ord, src, dst limit 5""")
def cross_community_surprises(spark, d):
    g = B.trade(spark, d)
    return analyze.cross_community_surprises(g, metrics.membership_of(g)).select("src", "dst", "confidence", "why")


@query("anomalies")
def anomalies(spark, d):
    g = B.events(spark, d)
    return analyze.anomalies(g, metrics.membership_of(g))


@query("questions")
def questions(spark, d):
    g = B.supply(spark, d)
    return analyze.questions(g, metrics.membership_of(g))


_DIFF = """,
diff as (select 'node_added' as change, id, null as src, null as dst, null as relation from new_nodes where id not in (select id from old_nodes)
union all select 'node_removed', id, null, null, null from old_nodes where id not in (select id from new_nodes)
union all select 'edge_added', null, src, dst, relation from new_edges where (src, dst, relation) not in (select src, dst, relation from old_edges)
union all select 'edge_removed', null, src, dst, relation from old_edges where (src, dst, relation) not in (select src, dst, relation from new_edges))"""


def snapshots(spark, d):
    return B.trade_until(spark, d, OLD), B.trade_until(spark, d, NEW, PI_SHIFT)


@query("graph_diff", B.snapshots(OLD, NEW) + _DIFF + " select change, id, src, dst, relation from diff")
def graph_diff(spark, d):
    return analyze.graph_diff(*snapshots(spark, d))


@query("diff_summary", B.snapshots(OLD, NEW) + _DIFF + " select change, count(*) as n from diff group by 1")
def diff_summary(spark, d):
    return analyze.diff_summary(analyze.graph_diff(*snapshots(spark, d)))


@query("diff_sections", B.snapshots(OLD, NEW) + _DIFF + ", r as (select *, row_number() over (partition by change order by id, src, dst, relation) as r from diff) select change, id, src, dst, relation from r where r <= 10")
def diff_sections(spark, d):
    return analyze.diff_sections(analyze.graph_diff(*snapshots(spark, d)))


@query("moved_nodes", B.snapshots(OLD, NEW) + " select id, n.label, o.community as from_community, n.community as to_community from old_nodes o join new_nodes n using (id) where o.community is distinct from n.community")
def moved_nodes(spark, d):
    return analyze.moved_nodes(*snapshots(spark, d)).select("id", "label", "from_community", "to_community")


_CHANGES = _DIFF + """,
c as (select n.community from diff x join new_nodes n on n.id = x.id where change = 'node_added'
union all select n.community from diff x join new_nodes n on n.id = x.src where change = 'edge_added'
union all select n.community from diff x join new_nodes n on n.id = x.dst where change = 'edge_added'
union all select o.community from diff x join old_nodes o on o.id = x.id where change = 'node_removed'
union all select o.community from diff x join old_nodes o on o.id = x.src where change = 'edge_removed'
union all select o.community from diff x join old_nodes o on o.id = x.dst where change = 'edge_removed'
union all select unnest([o.community, n.community]) from old_nodes o join new_nodes n using (id) where o.community is distinct from n.community)"""


@query("changed_communities", B.snapshots(OLD, NEW) + _CHANGES + " select community, count(*) as changes from c group by 1")
def changed_communities(spark, d):
    return analyze.changed_communities(*snapshots(spark, d))


@query("timeline")
def timeline(spark, d):
    return analyze.timeline(*snapshots(spark, d), limit=20)


@query("partition_overlap", B.TRADE + """, o as (select community, cast(ord % 3 as integer) as cb, count(*) as n from nodes group by 1, 2), r as (select *, row_number() over (partition by community order by n desc, cb) as k from o)
select community, cb as best, n as overlap from r where k = 1""")
def partition_overlap(spark, d):
    g = B.trade(spark, d)
    return analyze.partition_overlap(metrics.membership_of(g), g.nodes.select("id", (F.col("ord") % 3).cast("int").alias("community")))


@query("report")
def report(spark, d):
    g = B.supply(spark, d)
    return analyze.report(g, metrics.membership_of(g))


# --- traversal


def _levels(anchor: str, step: str, depth: int) -> str:
    return f"""
    b0 as (select {anchor} as id, 0 as level),""" + ",".join(
        f"""
    n{k} as (select distinct {step.split('->')[1]} as id, {k} as level from edges join b{k - 1} on {step.split('->')[0]} = b{k - 1}.id and b{k - 1}.level = {k - 1} where {step.split('->')[1]} not in (select id from b{k - 1})),
    b{k} as (select * from b{k - 1} union all select * from n{k})""" for k in range(1, depth + 1)
    )


@query("bfs", B.TRADE + "," + _levels("'o:1'", "src->dst", 3) + " select id, level from b3")
def bfs(spark, d):
    return traverse.bfs(B.trade(spark, d), ["o:1"], 3)[0]


@query("bfs_incident", B.PLACES + ", both_ways as (select id as src, neighbor as dst from incident)," + _levels("'n:3'", "src->dst", 2).replace("from edges", "from both_ways") + " select id, level from b2")
def bfs_incident(spark, d):
    return traverse.bfs(B.places(spark, d), ["n:3"], 2, direction="incident")[0]


@query("bfs_edges", B.TRADE + "," + _levels("'o:1'", "src->dst", 3) + """
select e.src, e.dst, a.level + 1 as level from edges e join b3 a on e.src = a.id join b3 z on e.dst = z.id where z.level = a.level + 1""")
def bfs_edges(spark, d):
    return traverse.bfs(B.trade(spark, d), ["o:1"], 3)[1]


@query("bfs_masked", B.PLACES + ", both_ways as (select id as src, neighbor as dst from incident where id not like 'c:%' and neighbor not like 'c:%')," + _levels("'n:3'", "src->dst", 3).replace("from edges", "from both_ways") + " select id, level from b3")
def bfs_masked(spark, d):
    g = B.places(spark, d)
    return traverse.bfs(g, ["n:3"], 3, g.nodes.where("id not like 'c:%'").select("id"), "incident")[0]


@query("dfs")
def dfs(spark, d):
    return traverse.dfs(B.supply(spark, d), ["r:1"], 3, direction="incident")


@query("shortest_path", B.PLACES + """, p as (select 's:3' as a, n.dst as b, r.dst as c from edges n join edges r on r.src = n.dst where n.src = 's:3')
select 0 as place, a as id from p union all select 1, b from p union all select 2, c from p""")
def shortest_path(spark, d):
    g = B.places(spark, d)
    region = table(spark, d, "supplier").where("s_suppkey = 3").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).first()["n_regionkey"]
    return traverse.shortest_path(g, "s:3", f"r:{region}")


@query("call_chains", B.TRADE + """, p as (select ['o:1', a.dst, b.dst] as path from edges a join edges b on b.src = a.dst where a.src = 'o:1' and a.relation = 'calls' and b.dst = (select min(b.dst) from edges a join edges b on b.src = a.dst where a.src = 'o:1' and a.relation = 'calls'))
select path, 2 as hops from p""")
def call_chains(spark, d):
    g = B.trade(spark, d)
    goal = g.edges.where("src = 'o:1' and relation = 'calls'").select(F.col("dst").alias("src")).join(g.edges.select("src", F.col("dst").alias("goal")), "src").agg(F.min("goal")).first()[0]
    labels = {r.id: r.label for r in g.nodes.where(F.col("id").isin("o:1", goal)).collect()}  # two rows
    return traverse.call_chains(g, labels["o:1"], labels[goal], 2, ("calls", "depends_on"), most=1000)


_IMPACT = _levels("'s:3'", "dst->src", 2)


@query("impact", B.TRADE + "," + _IMPACT + " select id, level as distance from b2 where level > 0")
def impact(spark, d):
    name = table(spark, d, "supplier").where("s_suppkey = 3").first()["s_name"]
    return traverse.impact(B.trade(spark, d), name, 2).select("id", "distance")


@query("impact_by_community", B.TRADE + "," + _IMPACT + " select community, count(*) as node_count, min(level) as distance from b2 join nodes using (id) where level > 0 group by 1")
def impact_by_community(spark, d):
    g = B.trade(spark, d)
    name = table(spark, d, "supplier").where("s_suppkey = 3").first()["s_name"]
    return traverse.impact_by_community(g, traverse.impact(g, name, 2)).select("community", "node_count", "distance")


@query("impact_compact", B.TRADE + "," + _IMPACT + " select id, label, case when (select count(distinct file_type) from b2 join nodes using (id) where level > 0) > 1 then file_type end as file_type, case when (select count(distinct file_type) from b2 join nodes using (id) where level > 0) = 1 then file_type end as shared_file_type from b2 join nodes using (id) where level > 0")
def impact_compact(spark, d):
    g = B.trade(spark, d)
    name = table(spark, d, "supplier").where("s_suppkey = 3").first()["s_name"]
    return traverse.compact(traverse.impact(g, name, 2), g).select("id", "label", "file_type", "shared_file_type")


@query("runtime_paths")
def runtime_paths(spark, d):
    g = B.places(spark, d)
    return traverse.best_runtime_paths(g, g.nodes.where("id like 's:%'").select("id"), {"located_in": 2, "part_of": 1}, 4)


# --- retrieval

_TOKENS = r"list_filter(regexp_split_to_array(lower(regexp_replace({0}, '([a-z])([A-Z])', '\1 \2', 'g')), '[\s_\\\-./,:;!?''\"()\[\]{{}}]+'), lambda t: length(t) > 1)".replace('\\"', '"')


def tok(column: str) -> str:
    return _TOKENS.format(column)


def _tf(token: str, tokens: str) -> str:
    return f"len(list_filter({tokens}, lambda t: starts_with(t, {token}) or starts_with({token}, t)))"


_Q = "[" + ", ".join(f"'{t}'" for t in ASKED) + "]"


@query("tokens", f"select doc_id, list_filter({tok('text')}, lambda t: true) as tokens from documents")
def tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", T.tokens("text").alias("tokens"))


@query("token_weights", B.TRADE + f""", t as (select {tok('label')} as t from nodes), q as (select unnest({_Q}) as token),
c as (select token, count(*) filter (where {_tf('token', 't')} > 0) as nodes, count(*) as total from q, t group by token)
select token, nodes, round(case when nodes > 0 then greatest(0.1, ln(1 + (total - nodes + 0.5) / (nodes + 0.5))) else 1.0 end, 9) as weight from c""")
def token_weights(spark, d):
    return retrieve.token_weights(B.trade(spark, d), retrieve.words_of(spark, QUESTION)).select("token", "nodes", F.round("weight", 9).alias("weight"))


@query("average_label_length", B.TRADE + f" select round(avg(n), 9) as average from (select len({tok('label')}) as n from nodes) where n > 0")
def average_label_length(spark, d):
    return retrieve.average_label_length(B.trade(spark, d)).select(F.round("average", 9).alias("average"))


_BM25 = f""", t as (select id, {tok('label')} as t from nodes), q as (select unnest({_Q}) as token),
c as (select token, count(*) filter (where {_tf('token', 't')} > 0) as k, count(*) as total from q, t group by token),
w as (select token, case when k > 0 then greatest(0.1, ln(1 + (total - k + 0.5) / (k + 0.5))) else 1.0 end as w from c),
a as (select avg(len(t)) as a from t where len(t) > 0),
f as (select id, w, {_tf('token', 't')}::double as tf, greatest(len(t), 1) as n from t, w),
bm as (select id, sum(w * tf * 2.2 / (tf + 1.2 * (0.4 + 0.6 * n / a))) as score from f, a where tf > 0 group by id)"""


@query("bm25", B.TRADE + _BM25 + " select id, round(score, 6) as score from bm")
def bm25(spark, d):
    return retrieve.bm25(B.trade(spark, d), QUESTION).select("id", F.round("score", 6).alias("score"))


@query("simple_scores", B.TRADE + """, s as (select n.id, case when contains(lower(label), 'customer') then 1.0 else 0 end + case when contains(lower(source_file), 'customer') then 0.5 else 0 end + case when contains(lower(label), 'build') then 1.0 else 0 end + case when contains(lower(source_file), 'build') then 0.5 else 0 end as score, coalesce(degree, 0) as degree from nodes n left join degrees using (id))
select id, score::double as score, degree from s where score > 0""")
def simple_scores(spark, d):
    return retrieve.simple_scores(B.trade(spark, d), ["Customer", "BUILD"])


@query("rank_fusion", B.TRADE + """, x as (select id, row_number() over (order by degree desc, id) as a, row_number() over (order by id) as b from degrees)
select id, round(2.0 / (10 + a) + 1.5 / (10 + b), 9) as fused from x""")
def rank_fusion(spark, d):
    g = B.trade(spark, d)
    by_degree, by_id = retrieve.placed(g.degrees, F.desc("degree"), F.asc("id")), retrieve.placed(g.degrees, F.asc("id"))
    return retrieve.fuse([(by_degree, 2.0), (by_id, 1.5)]).select("id", F.round("fused", 9).alias("fused"))


@query("seed_scores")
def seed_scores(spark, d):
    return retrieve.seed_scores(B.trade(spark, d), QUESTION).where("total > 0")


@query("retrieve")
def retrieve_(spark, d):
    return retrieve.retrieve(B.trade(spark, d), QUESTION)


_SEEDS = ", seeds as (select id, 4.0::double as score from nodes where id in ('p:1', 'p:2', 'c:5'))"
_W = "case when relation in ('calls') then 1.0 when relation in ('contains', 'renders') then 1.2 when relation in ('uses', 'depends_on') then 0.7 else 0.35 end"


@query("expand", B.TRADE + _SEEDS + f""",
both_ways as (select src as id, dst as neighbor, {_W} as w from edges union all select dst, src, {_W} from edges),
h1 as (select neighbor as id, max(score * 0.5 * w)::double as score from both_ways join seeds using (id) where neighbor not in (select id from seeds) group by 1),
t1 as (select * from h1 order by score desc, id limit 40),
h2 as (select neighbor as id, max(score * 0.5 * w)::double as score from both_ways join t1 using (id) where neighbor not in (select id from seeds) and neighbor not in (select id from h1) group by 1)
select id, score, 0 as hop from seeds union all select id, score, 1 from h1 union all select id, score, 2 from h2""")
def expand(spark, d):
    g = B.trade(spark, d)
    seeds = g.nodes.where(F.col("id").isin("p:1", "p:2", "c:5")).select("id", F.lit(4.0).alias("score"))
    return retrieve.expand(g, seeds)


@query("semantic_scores", """with q as (select embedding as q from embeddings where vec_id = 7)
select vec_id as id, round(list_sum(list_transform(generate_series(1, 64), lambda i: embedding[i]::double * q[i]::double)) / (sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(q, lambda x: x::double * x::double)))), 6) as score from embeddings, q""")
def semantic_scores(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieve.semantic_scores(vectors, vectors.where("id = 7").first()["vector"]).select("id", F.round("score", 6).alias("score"))


@query("hybrid", """with l as (select vec_id as id, (vec_id % 5)::double as score from embeddings where vec_id % 50 = 3), s as (select vec_id as id, label / 10.0 as score from embeddings),
ids as (select id from l union (select id from s order by score desc, id limit 8))
select id, round(coalesce(l.score, 0) + 3 * coalesce(s.score, 0), 9) as score from ids left join l using (id) left join s using (id)""")
def hybrid(spark, d):
    e = table(spark, d, "embeddings")
    lexical = e.where("vec_id % 50 = 3").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 5).cast("double").alias("score"))
    return retrieve.hybrid(lexical, e.select(F.col("vec_id").alias("id"), (F.col("label") / 10.0).alias("score"))).select("id", F.round("score", 9).alias("score"))


@query("structural_boosts", B.TRADE + """, s as (select id, degree::double as score from degrees)
select s.id, s.score + case when s.id in ('n:1', 'n:2') then 0.3 else 0 end - case when s.id in ('n:2', 'n:3') then 0.2 else 0 end + case when community = 2 then 0.1 else 0 end as score from s join nodes using (id)""")
def structural_boosts(spark, d):
    g = B.trade(spark, d)
    pick = lambda *ids: g.nodes.where(F.col("id").isin(*ids)).select("id")
    return retrieve.structural_boosts(g.degrees.select("id", F.col("degree").cast("double").alias("score")), g, pick("n:1", "n:2"), pick("n:2", "n:3"), 2)


@query("induced", B.TRADE + " select src, dst, relation from edges where src in (select id from nodes where community = 1) and dst in (select id from nodes where community = 1)")
def induced(spark, d):
    g = B.trade(spark, d)
    return retrieve.induced(g, g.nodes.where("community = 1").select("id")).select("src", "dst", "relation")


@query("mentioned_paths", B.TRADE + " select id from nodes where source_file = 'geo/nations.md' or ends_with(source_file, '/building.ts')")
def mentioned_paths(spark, d):
    return retrieve.mentioned_paths(B.trade(spark, d).nodes, ["geo/nations.md", "building.ts"]).select("id")


@query("exclusions", B.PLACES + f" select id from nodes where not list_has_any({tok(chr(39) + chr(39) + ' || label || ' + chr(39) + ' ' + chr(39) + ' || source_file')}, ['building', 'supply'])")
def exclusions(spark, d):
    return retrieve.excluded(B.places(spark, d).nodes, ["building", "supply"]).select("id")


@query("slice", B.PLACES + """, both_ways as (select id, neighbor from incident), quiet as (select id from degrees where degree < 40),
a as (select neighbor as id from both_ways where id = 's:3' and neighbor <> 's:3'),
b as (select distinct neighbor as id from both_ways join a using (id) join quiet using (id) where neighbor <> 's:3' and neighbor not in (select id from a))
select 's:3' as id, 0 as distance union all select distinct id, 1 from a union all select id, 2 from b""")
def slice_(spark, d):
    g = B.places(spark, d)
    return retrieve.slice_of(g, g.nodes.where("id = 's:3'").select("id"), ("located_in", "part_of"))


_MATCHES = B.TRADE + ", m as (select n.id, label, source_file, community, case when degree > 20 then 'direct' when degree > 5 then 'related' else 'peripheral' end as band, degree::double as score from nodes n join degrees using (id))"


def _matches(spark, d):
    g = B.trade(spark, d)
    band = F.when(F.col("degree") > 20, "direct").when(F.col("degree") > 5, "related").otherwise("peripheral")
    return g, g.nodes.join(g.degrees, "id").select("id", "label", "source_file", "community", band.alias("band"), F.col("degree").cast("double").alias("score"))


@query("relevant_files", _MATCHES + " select source_file, sum(score) as score, count(*) filter (where band = 'direct') as direct, count(*) filter (where band = 'related') as related from m where band <> 'peripheral' group by 1 order by direct desc, score desc, related desc, source_file limit 8")
def relevant_files(spark, d):
    return retrieve.relevant_files(_matches(spark, d)[1])


@query("feature_map", _MATCHES + ", b as (select community, label, row_number() over (partition by community order by score desc, label) as r from m) select m.community, count(*) as matched, sum(score) as score, count(distinct source_file) as files, any_value(b.label) as entry from m join b on m.community = b.community and r = 1 group by 1")
def feature_map(spark, d):
    g, m = _matches(spark, d)
    return retrieve.feature_map(m, g)


# --- budgets and sessions

_ITEMS = "with items as (select l_suppkey as pool, l_partkey as id, sum(l_quantity) as score, cast(count(*) * 7 + l_partkey % 5 as double) as token_cost from lineitem group by 1, 2)"


def _items(spark, d):
    lines = spread(table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity"), "l_suppkey")  # once, for the groups and their packs
    return lines.groupBy(F.col("l_suppkey").alias("pool"), F.col("l_partkey").alias("id")).agg(F.sum("l_quantity").alias("score"), (F.count("*") * 7 + F.col("l_partkey") % 5).cast("double").alias("token_cost"))


@query("knapsack")
def knapsack(spark, d):
    return budget.knapsack(_items(spark, d), 100).select("pool", "id", "score", "token_cost", "place", "included")


@query("prefix_pack", _ITEMS + ", r as (select *, sum(token_cost) over w as s, row_number() over w as n from items window w as (partition by pool order by id)), x as (select *, max(case when s > 60 and n > 1 then 1 else 0 end) over (partition by pool order by id) as stop from r) select pool, id, score, token_cost from x where stop = 0")
def prefix_pack(spark, d):
    return budget.prefix_pack(_items(spark, d), 60, order=("id",)).select("pool", "id", "score", "token_cost")


@query("compile_pack")
def compile_pack(spark, d):
    return budget.compile_pack(_items(spark, d).withColumn("required", F.col("id") % 9 == 0), 150)


@query("duplicate_penalty", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, count(*) over (partition by l_returnflag, l_linestatus, l_suppkey) as copies, case when count(*) over (partition by l_returnflag, l_linestatus, l_suppkey) > 1 then (count(*) over (partition by l_returnflag, l_linestatus, l_suppkey) - 1) * 0.5 else 0.0 end as penalty from lineitem")
def duplicate_penalty(spark, d):
    rows = table(spark, d, "lineitem").withColumnsRenamed({"l_returnflag": "source_file", "l_linestatus": "evidence", "l_suppkey": "label"})
    return budget.duplicate_penalty(rows).select("l_orderkey", "l_linenumber", "l_partkey", F.col("label").alias("l_suppkey"), "l_extendedprice", "copies", "penalty")


@query("coverage", "with r as (select unnest(['A', 'N', 'X']) as evidence) select r.evidence, count(l_orderkey) as nodes, count(l_orderkey) > 0 as covered from r left join lineitem on l_returnflag = r.evidence group by 1")
def coverage(spark, d):
    return budget.coverage(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("evidence")), ["A", "N", "X"])


@query("confidence_bands", """with x as (select o_orderkey, floor(((o_orderkey % 5) / 4.0 * 0.55 + (o_orderkey % 3) / 2.0 * 0.3 + 0.15 - least(0.15, (4 - o_orderkey % 5) * 0.03) - least(0.1, (2 - o_orderkey % 3) * 0.02))::double * 10000.0 + 0.5) / 10000.0 as s from orders)
select o_orderkey, round(s, 3) as score, case when s >= 0.85 then 'high' when s >= 0.5 then 'medium' else 'low' end as band from x""")
def confidence_bands(spark, d):
    a, b = F.col("o_orderkey") % 5, F.col("o_orderkey") % 3
    score, band = budget.confidence(a / 4.0, b / 2.0, F.lit(1.0), 4 - a, 2 - b)
    return table(spark, d, "orders").select("o_orderkey", F.round(score, 3).alias("score"), band.alias("band"))


@query("symbol_scores", B.TRADE + """, f as (
  select id, regexp_replace(lower(l), '[^a-z0-9]', '', 'g') as n, regexp_replace(lower(source_file), '[^a-z0-9]', '', 'g') as p,
         regexp_replace(lower(regexp_extract(regexp_replace(l, '\\(\\)$', ''), '[^.#:]*$')), '[^a-z0-9]', '', 'g') as tail
  from (select *, regexp_replace(label, '^Supplier#0*', 'Supplier.s') as l from nodes)),
asked(whole, tail, owner) as (values ('order12', 'order12', null), ('suppliers3', 's3', 'supplier'), ('partss4', 's4', 'parts'), ('s5', 's5', null)),
scored as (select id, max(case when n = whole then 4.0 when owner is not null and f.tail = asked.tail and contains(p, owner) then 3.5
                               when f.tail = asked.tail then case when owner is null then 2.5 else 3.0 end else 0 end) as score from f cross join asked group by id)
select id, score::double as score from scored where score > 0""")
def symbol_scores(spark, d):
    score = interpret.symbol_score(F.regexp_replace("label", "^Supplier#0*", "Supplier.s"), F.col("source_file"), ["Order12", "Supplier.s3", "Parts.s4", "s5"])
    return B.trade(spark, d).nodes.select("id", score.alias("score")).where("score > 0")


@query("identifier_scores", B.TRADE + """, f as (select id, regexp_replace(lower(label), '[^a-z0-9]', '', 'g') as n, regexp_replace(lower(source_file), '[^a-z0-9]', '', 'g') as p from nodes),
asked(k, words) as (values ('geonationsmd', 3), ('supplier000000003', 2), ('customer00000', 2)),
scored as (select id, max(case when contains(n, k) or contains(p, k) then least(1.75, case when contains(n, k) then 1.1 + case when contains(p, k) then 0.35 else 0 end else 1.05 end
                               + case when n = k then 0.2 else 0 end + least(0.35, greatest(0, words - 2) * 0.15)) else 0 end) as score from f cross join asked group by id)
select id, round(score::double, 6) as score from scored where score > 0""")
def identifier_scores(spark, d):
    names = interpret.identifiers("What do geo/nations.md and supplier_000000003 and customer-00000 hold today?")
    return B.trade(spark, d).nodes.select("id", F.round(interpret.identifier_score(F.col("label"), F.col("source_file"), names), 6).alias("score")).where("score > 0")


@query("question_readings")
def question_readings(spark, d):
    asked = ["hello!", "Why does `login()` fail in src/auth.py?", "Explain billing, without tests and docs", "What breaks if I change Order.total?", "rename things"]
    rows = [(q, r.intent, r.level, r.paths, r.symbols, r.excluded) for q in asked for r in [interpret.read_question(q)]]
    return spark.createDataFrame(rows, "question string, intent string, level int, paths array<string>, symbols array<string>, excluded array<string>")


@query("truncation", "select doc_id, case when length(text) > 300 then substr(text, 1, 300) || chr(10) || '... (truncated)' else text end as text, cast(ceil(length(text) / 4.0) as integer) as tokens from documents")
def truncation(spark, d):
    return table(spark, d, "documents").select("doc_id", budget.truncated("text", 100).alias("text"), budget.token_estimate("text").alias("tokens"))


@query("handles", "select p_partkey, 'h_' || substr(sha256(p_name || chr(31) || p_brand), 1, 12) as handle from part")
def handles(spark, d):
    return table(spark, d, "part").select("p_partkey", budget.handle("p_name", "p_brand").alias("handle"))


@query("resolutions", "select conv_id, turn, case when row_number() over (partition by conv_id order by turn) <= ceil(count(*) over (partition by conv_id) / 3.0) then 'detail' else 'summary' end as resolution from conversations")
def resolutions(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("pool"), F.col("turn").alias("place"))
    return budget.resolutions(rows, "mixed").select(F.col("pool").alias("conv_id"), F.col("place").alias("turn"), "resolution")


@query("snippets")
def snippets(spark, d):
    lines = text_parsers.numbered_lines(table(spark, d, "documents"), "doc_id").withColumn("focus", (F.col("doc_id") % 5 + 1).cast("int"))
    return budget.snippet(lines.withColumnsRenamed({"doc_id": "node", "content": "text"}), 120)


@query("delta_pack", B.PLACES + " select src, dst from edges where not (src in (select id from nodes where community < 3) and dst in (select id from nodes where community < 3))")
def delta_pack(spark, d):
    g = B.places(spark, d)
    return budget.delta_pack(g.nodes, g.edges, g.nodes.where("community < 3"))[1].select("src", "dst")


@query("session_diff", """with a as (select o_orderkey as ref, o_orderpriority as h from orders where o_orderkey % 3 <> 0), b as (select o_orderkey as ref, case when o_orderkey % 7 = 0 then 'x' else o_orderpriority end as h from orders where o_orderkey % 5 <> 0)
select coalesce(a.ref, b.ref) as ref, case when a.ref is null then 'added' when b.ref is null then 'invalidated' when a.h = b.h then 'reused' else 'updated' end as status from a full join b on a.ref = b.ref""")
def session_diff(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("ref"), F.col("o_orderpriority").alias("hash"))
    return budget.session_diff(o.where("ref % 3 <> 0"), o.where("ref % 5 <> 0").withColumn("hash", F.when(F.col("ref") % 7 == 0, "x").otherwise(F.col("hash"))))


# --- several graphs, reviews, risk


@query("shared_labels", """with n as (select p_size % 3 as repo, 'p:' || p_partkey as id, lower(p_type) as name, p_partkey as ord from part where length(p_type) >= 3)
select a.id as a, b.id as b from n a join n b on a.name = b.name and a.repo <> b.repo and (a.repo, a.ord, a.id) < (b.repo, b.ord, b.id)""")
def shared_labels(spark, d):
    n = table(spark, d, "part").select((F.col("p_size") % 3).alias("repo"), B.key("p", "p_partkey").alias("id"), F.col("p_type").alias("label"), F.col("p_partkey").alias("ord"))
    return federation.shared_labels(n)


@query("federate", """with n as (select 'a::r:' || r_regionkey as id, lower(r_name) as l from region union all select 'b::r:' || r_regionkey, lower(r_name) from region)
select a.id as src, b.id as dst, 'shared_across_repos' as relation from n a join n b on a.l = b.l and a.id < b.id""")
def federate(spark, d):
    g = B.supply(spark, d)
    part = PropertyGraph(g.nodes.where("id like 'r:%'"), g.edges.limit(0), True)
    return federation.federate({"a": part, "b": part}).edges.select("src", "dst", "relation")


@query("line_ranges", """with s as (select l_suppkey as file, cast(l_orderkey % 100 as integer) as first, cast(l_orderkey % 100 + 5 as integer) as last, l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || floor(l_extendedprice)::bigint as id from lineitem),
c as (select distinct l_suppkey as file, cast(l_partkey % 40 as integer) as first, cast(l_partkey % 40 + 2 as integer) as last from lineitem where l_partkey % 50 = 0)
select s.file, id, s.first, s.last, c.first as c_first, c.last as c_last from s join c on s.file = c.file and s.first <= c.last and c.first <= s.last""")
def line_ranges(spark, d):
    lines = table(spark, d, "lineitem")
    id_ = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.floor("l_extendedprice").cast("long").cast("string"))
    symbols = lines.select(F.col("l_suppkey").alias("file"), (F.col("l_orderkey") % 100).cast("int").alias("first"), (F.col("l_orderkey") % 100 + 5).cast("int").alias("last"), id_.alias("id"))
    changed = lines.where("l_partkey % 50 = 0").select(F.col("l_suppkey").alias("file"), (F.col("l_partkey") % 40).cast("int").alias("first"), (F.col("l_partkey") % 40 + 2).cast("int").alias("last")).distinct()
    return review.overlapping(changed, symbols)


@query("review_candidates", B.TRADE + """, s as (select id from nodes where id in ('p:1', 'p:2', 's:4')), w as (select src, dst, case when relation = 'calls' then 1.5 when relation in ('depends_on', 'imports_from') then 1.25 when relation in ('uses', 'references') then 1.0 else 0.75 end as w from edges),
v as (select id, 10.0 as value from s union all select src, 6 + w from w where dst in (select id from s) union all select dst, 5 + w from w where src in (select id from s)) select id, max(value)::double as value from v group by 1""")
def review_candidates(spark, d):
    g = B.trade(spark, d)
    return review.review_candidates(g.edges, g.nodes.where(F.col("id").isin("p:1", "p:2", "s:4")))


@query("review_seeds")
def review_seeds(spark, d):
    g = B.places(spark, d)
    nodes = g.nodes.where("id like 's:%'").withColumn("source_location", F.concat(F.lit("L"), (F.col("ord") % 50 + 1).cast("string")))
    changed = spark.createDataFrame([("supply/n1.py", 1, 20), ("supply/n2.py", 900, 901)], "file string, first int, last int")
    return review.review_seeds(nodes, changed)


@query("test_paths")
def test_paths(spark, d):
    files_ = spark.createDataFrame([("src/app/user.ts",), ("lib/tools.py",), ("main.go",)], "path string")
    listing = spark.createDataFrame([("src/app/user.test.ts",), ("tests/user.spec.ts",), ("tests/test_tools.py",), ("lib/other.py",)], "path string")
    return review.test_paths(files_, listing)


@query("risk_map", """with c as (select 'Supplier ' || l_suppkey as label, count(distinct l_orderkey) % 7 as affected, count(distinct l_partkey) % 4 as communities, l_suppkey % 2 as hotspots, count(*) % 3 as dependents from lineitem group by l_suppkey),
s as (select *, affected * 2 + communities + hotspots * 6 + dependents * 2 as score from c) select label, affected, communities, hotspots, dependents, score, case when score >= 6 or communities >= 2 then 'high' when score >= 3 then 'medium' else 'low' end as severity from s""")
def risk_map(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_suppkey").agg((F.countDistinct("l_orderkey") % 7).alias("affected"), (F.countDistinct("l_partkey") % 4).alias("communities"), (F.count("*") % 3).alias("dependents"))
    return review.risk_map(c.select(F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")).alias("label"), "affected", "communities", (F.col("l_suppkey") % 2).alias("hotspots"), "dependents"))


# --- sources


def _raw(spark, d):
    lines = table(spark, d, "lineitem")
    order = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", "l_extendedprice"))
    return lines.select(B.key("s", "l_suppkey").alias("id"), F.col("l_returnflag").alias("label"), F.lit("code").alias("file_type"), F.lit("a.py").alias("source_file"), order.cast("long").alias("ord"))


@query("last_attributes_win", "with r as (select 's:' || l_suppkey as id, l_returnflag as label, row_number() over (partition by l_suppkey order by l_orderkey, l_partkey, l_linenumber, l_shipdate, l_extendedprice) as ord from lineitem) select id, arg_max(label, ord) as label, min(ord) as ord from r group by 1")
def last_attributes_win(spark, d):
    nodes = _raw(spark, d)
    empty = conformed(nodes.limit(0), EDGE_COLUMNS)
    return PropertyGraph.of(nodes, empty).nodes.select("id", "label", "ord")


@query("dangling_edges", "select distinct 'o:' || l_orderkey as src, 'p:' || l_partkey as dst from lineitem where l_orderkey in (select o_orderkey from orders where o_orderkey % 2 = 0) and l_partkey in (select p_partkey from part where p_size < 25)")
def dangling_edges(spark, d):
    g = B.trade(spark, d)
    size = table(spark, d, "part").where("p_size < 25").select(B.key("p", "p_partkey").alias("id"))
    orders = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(B.key("o", "o_orderkey").alias("id"))
    nodes = g.nodes.join(size.union(orders), "id", "left_semi")
    return PropertyGraph.of(nodes, g.edges).edges.select("src", "dst")


@query("undirected_copy", B.PLACES + " select distinct least(src, dst) as u, greatest(src, dst) as v from edges")
def undirected_copy(spark, d):
    return B.places(spark, d).as_directed(False).edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))


@query("violations", """with n as (select 's:' || s_suppkey as id, case when s_suppkey % 10 = 0 then null else s_name end as label, case when s_suppkey % 7 = 0 then 'odd' else 'code' end as file_type, 'a.py' as source_file, s_suppkey as ord from supplier)
select 'node' as item, ord, 'missing label' as problem from n where label is null union all select 'node', ord, 'invalid file_type odd' from n where file_type = 'odd'""")
def violations(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    nodes = s.select(B.key("s", "s_suppkey").alias("id"), F.when(k % 10 != 0, F.col("s_name")).alias("label"), F.when(k % 7 == 0, "odd").otherwise("code").alias("file_type"), F.lit("a.py").alias("source_file"), k.alias("ord"))
    return extraction.violations(nodes, conformed(nodes.limit(0), EDGE_COLUMNS))


@query("derived_confidence", B.TRADE + " select src, dst, case confidence when 'AMBIGUOUS' then 0.2 when 'INFERRED' then 0.5 else 1.0 end::double as score from edges")
def derived_confidence(spark, d):
    return B.trade(spark, d).edges.select("src", "dst", extraction.derived_confidence(F.lit(None).cast("double"), F.col("confidence")).alias("score"))


@query("retained", B.TRADE + ", kept as (select * from nodes where source_file <> 'sales/building.ts') select src, dst from edges where src in (select id from kept) and dst in (select id from kept)")
def retained(spark, d):
    g = B.trade(spark, d)
    removed = spark.createDataFrame([("sales/building.ts",)], "source_file string")
    none = spark.createDataFrame([], "id string, nodes array<string>, source_file string")
    return extraction.retained(g.nodes, g.edges, none, removed)[1].select("src", "dst")


@query("resolved_references")
def resolved_references(spark, d):
    g = B.places(spark, d)
    return extraction.resolved_references(table(spark, d, "customer").select(B.key("c", "c_custkey").alias("owner"), F.col("c_mktsegment").alias("name")).union(table(spark, d, "nation").select(B.key("n", "n_nationkey"), "n_name")), g.nodes)


@query("unique_stems", "with p as (select url as path, regexp_replace(string_split(url, '/')[-1], '\\.[^.]*$', '') as stem from pages), r as (select *, row_number() over (partition by stem order by path) as r from p) select path, case when r > 1 then stem || '_' || r else stem end as stem from r")
def unique_stems(spark, d):
    return extraction.unique_stems(table(spark, d, "pages").select(F.col("url").alias("path")))


@query("slugs", "select s_suppkey, lower(regexp_replace(regexp_replace(s_name, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) as slug from supplier")
def slugs(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", T.slug("s_name").alias("slug"))


@query("word_counts", r"select doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) as words from documents")
def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.words_in("text").alias("words"))


@query("file_types")
def file_types(spark, d):
    names = spark.createDataFrame([("a/b.py",), ("x.md",), ("p.pdf",), ("i.PNG",), ("m.mp3",), ("v.mp4",), ("Makefile",)], "path string")
    return names.select("path", files.file_type("path").alias("type"), T.file_category("path").alias("category"))


@query("papers", r"select doc_id, (cast(regexp_matches(t, '\barxiv\b') as int) + cast(regexp_matches(t, '\babstract\b') as int) + cast(regexp_matches(t, '\[\d+\]') as int)) >= 3 as paper from (select doc_id, lower(substr(text, 1, 3000)) as t from documents)")
def papers(spark, d):
    return table(spark, d, "documents").select("doc_id", files.looks_like_paper("text").alias("paper"))


@query("corpus_verdict", r"with f as (select count(*) as files, sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))) as words from documents) select files, cast(words as bigint) as words, words >= 50000 as needs_graph, case when words >= 500000 then 'too many words' when files >= 200 then 'too many files' when words < 50000 then 'fits a context window' end as warning from f")
def corpus_verdict(spark, d):
    return files.corpus_verdict(table(spark, d, "documents"))


@query("source_domains")
def source_domains(spark, d):
    return table(spark, d, "pages").select("page_id", files.source_domain("url").alias("domain"))


@query("sensitive_paths")
def sensitive_paths(spark, d):
    names = [".env", ".env.example", "keys/id_rsa", "a/.aws/config.txt", "src/secrets/load.py", "conf/db_password.yml", "readme.md"]
    return spark.createDataFrame([(n,) for n in names], "path string").select("path", files.sensitive("path").alias("reason"))


@query("ignore_rules")
def ignore_rules(spark, d):
    names = ["a/node_modules/x.js", "docs/a.md", "docs/keep.md", "src/a.gen.ts", "src/deep/b.gen.ts", "src/c.ts"]
    return files.ignored(spark.createDataFrame([(n,) for n in names], "path string"), ["docs/**", "!docs/keep.md", "*.gen.ts"])


@query("manifest_diff", """with a as (select o_orderkey as path, o_totalprice as f from orders where o_orderkey % 4 <> 1), b as (select o_orderkey as path, case when o_orderkey % 9 = 0 then 0 else o_totalprice end as f from orders where o_orderkey % 6 <> 2)
select coalesce(a.path, b.path) as path, case when a.path is null then 'new' when b.path is null then 'deleted' when a.f = b.f then 'unchanged' else 'changed' end as status from a full join b on a.path = b.path""")
def manifest_diff(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("fingerprint"))
    return files.manifest_diff(o.where("path % 4 <> 1"), o.where("path % 6 <> 2").withColumn("fingerprint", F.when(F.col("path") % 9 == 0, 0.0).otherwise(F.col("fingerprint"))))


@query("freshness", "with j as (select o_orderkey, o_orderkey % 11 = 0 as changed, o_orderkey % 2 = 0 as chosen from orders) select 0 as missing, count(*) filter (where changed) as changed, case when count(*) filter (where changed) = 0 then 'fresh' when count(*) filter (where changed and chosen) = 0 then 'partially_stale' else 'possibly_stale' end as status from j")
def freshness(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderpriority").alias("fingerprint"))
    return files.freshness(o.withColumn("chosen", F.col("path") % 2 == 0), o.withColumn("fingerprint", F.when(F.col("path") % 11 == 0, "x").otherwise(F.col("fingerprint"))))


@query("cache_misses", "with p as (select p_partkey, p_size, sha256(p_name || '/' || p_size) as hash from part) select p_partkey, hash from p where hash not in (select hash from p where p_size > 20)")
def cache_misses(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", F.concat_ws("/", "p_name", "p_size").cast("binary").alias("content"))
    return files.cache_misses(p, p.where("p_size > 20").select(F.sha2("content", 256).alias("hash"))).select("p_partkey", "hash")


@query("workspace_fingerprint")
def workspace_fingerprint(spark, d):
    return files.workspace_fingerprint(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_name").alias("hash")))


@query("outcomes", "with c as (select count(*) filter (where s = 0) as indexed, count(*) filter (where s = 1) as warning, count(*) filter (where s = 2) as skipped, 0 as unsupported, 0 as failed from (select p_partkey % 3 as s from part)) select *, case when indexed + warning = 0 and failed + unsupported > 0 then 'failed' when warning + skipped + unsupported + failed > 0 then 'partial' else 'complete' end as state from c")
def outcomes(spark, d):
    k = F.col("p_partkey") % 3
    return files.outcomes(table(spark, d, "part").select(F.when(k == 0, "indexed").when(k == 1, "warning").otherwise("skipped").alias("status")))


@query("ingest_kinds")
def ingest_kinds(spark, d):
    return table(spark, d, "pages").select("page_id", files.ingest_kind("url").alias("kind"))


_PATCH = "diff --git a/x b/x\n--- a/x\n+++ b/src/x.py\n@@ -1,3 +2,4 @@ def\n line\n@@ -9 +12 @@\n one\n+++ /dev/null\n@@ -1,2 +0,0 @@\n+++ b/src/y.py\n@@ -4,0 +7,0 @@\n@@ -5,2 +8,3 @@\n"


@query("changed_ranges")
def changed_ranges(spark, d):
    return text_parsers.changed_ranges(spark.createDataFrame([(1, _PATCH)], "id int, text string"))


@query("sections")
def sections(spark, d):
    text = "# Top\ntext\n## One\n```\n# not a heading\n```\n### Deep\n## Two\nSetext\n======\nBody\n"
    return text_parsers.sections(spark.createDataFrame([(1, text)], "id int, text string"))


@query("citations")
def citations(spark, d):
    text = r"See 10.1000/xyz123 and arXiv:2101.00001, \cite{Smith2020, jones} and [paper](docs/p.pdf)."
    return text_parsers.citations(spark.createDataFrame([(1, text)], "id int, text string"))


@query("markdown_links")
def markdown_links(spark, d):
    return text_parsers.markdown_links(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("html_links", """select page_id, href, count(*) as n from (select page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) as href from pages) group by 1, 2""")
def html_links(spark, d):
    return text_parsers.html_links(table(spark, d, "pages"))


_SOURCE = "import os\nfrom a import b\nclass K:\n    def m(self):\n        return helper()\ndef helper():\n    return os.getcwd()\n"


@query("python_symbols")
def python_symbols(spark, d):
    return text_parsers.python_symbols(spark.createDataFrame([("pkg/k.py", _SOURCE), ("pkg/bad.py", "def (")], "path string, text string"))


@query("python_graph")
def python_graph(spark, d):
    return text_parsers.symbol_graph(text_parsers.python_symbols(spark.createDataFrame([("pkg/k.py", _SOURCE)], "path string, text string")))[1]


@query("covered_by")
def covered_by(spark, d):
    rows = [("tests/test_user.py", "src/user.py"), ("tests/test_user.py", "src/db.py"), ("src/db.py", "src/user.py")]
    return text_parsers.covered_by(spark.createDataFrame(rows, "src string, dst string"))


# --- sinks and streams


@query("json_rows", B.PLACES + " select 'node' as part, count(*) as n from nodes union all select 'link', count(*) from edges")
def json_rows(spark, d):
    g = B.places(spark, d)
    return sinks.json_rows(g, metrics.membership_of(g)).groupBy("part").agg(F.count("*").alias("n"))


@query("graphml")
def graphml(spark, d):
    return sinks.graphml_lines(B.supply(spark, d))


@query("cypher")
def cypher(spark, d):
    return sinks.cypher_lines(B.supply(spark, d))


@query("svg")
def svg(spark, d):
    g = B.supply(spark, d)
    return sinks.svg_lines(g, metrics.membership_of(g))


@query("notes")
def notes(spark, d):
    g = B.supply(spark, d)
    m = metrics.membership_of(g)
    return sinks.notes(g, m, metrics.community_labels(g, m))


@query("layout", B.SUPPLY + """, p as (select id, community, row_number() over (partition by community order by id) - 1 as k, count(*) over (partition by community) as n from nodes)
select id, round((community % 5 + 0.5) * 240.0 + least(96.0, 20 + n * 4) * cos(k * 2 * pi() / n), 4) as x, round((floor(community / 5) + 0.5) * 240.0 + least(96.0, 20 + n * 4) * sin(k * 2 * pi() / n), 4) as y from p""")
def layout(spark, d):
    return sinks.layout(metrics.membership_of(B.supply(spark, d))).select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("rate_limit", "select user_id, time_bucket(interval '60 seconds', ts) as at, count(*) as n, count(*) > 2 as limited from events group by 1, 2")
def rate_limit(spark, d):
    from quillgraph.streaming.windows import rate_limited

    return rate_limited(table(spark, d, "events"), "user_id", 2).select("user_id", "at", "n", "limited")


@query("debounce", "with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval '3 hours' then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from e) select user_id, min(ts) as first, max(ts) as last, count(*) as n from s group by user_id, k")
def debounce(spark, d):
    from quillgraph.streaming.windows import settled

    return settled(table(spark, d, "events"), "user_id", "3 hours")

