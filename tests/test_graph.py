from __future__ import annotations

import itertools
import random
from collections import defaultdict

import pytest
from graphs import CHAINS, IMPACT, graph
from pyspark.sql import functions as F

from quillgraph.operators import analyze, centrality, community, components, metrics, traverse
from quillgraph.operators.graph import EDGE_COLUMNS, NODE_COLUMNS, PropertyGraph, conformed


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()) if cols else map(tuple, df.collect()))


def random_edges(seed, n=12, m=20):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(m)})


def test_last_row_wins_and_dangling_edges_go(spark):
    nodes = spark.createDataFrame([("a", "old", 0), ("b", "B", 1), ("a", "new", 2)], "id string, label string, ord long")
    edges = spark.createDataFrame([("a", "b", "calls", 0), ("a", "b", "uses", 1), ("a", "x", "calls", 2)], "src string, dst string, relation string, ord long")
    g = PropertyGraph.of(conformed(nodes, NODE_COLUMNS), conformed(edges, EDGE_COLUMNS))
    assert rows(g.nodes, "id", "label", "ord") == [("a", "new", 0), ("b", "B", 1)]
    assert rows(g.edges, "src", "dst", "relation", "ord") == [("a", "b", "uses", 0)]
    assert PropertyGraph.of(conformed(nodes, NODE_COLUMNS), conformed(edges, EDGE_COLUMNS), multigraph=True).edges.count() == 2


def test_undirected_edges_share_a_key(spark):
    assert graph(spark, [("a", "b"), ("b", "a")], directed=False).edges.count() == 1
    assert graph(spark, [("a", "b"), ("b", "a")]).edges.count() == 2


def test_degree_counts_distinct_neighbors(spark):
    g = graph(spark, [("a", "b"), ("b", "a"), ("a", "a"), ("a", "c")], nodes=["z"])
    assert rows(g.with_degree(), "id", "degree") == [("a", 3), ("b", 1), ("c", 1), ("z", 0)]


def test_god_nodes_leave_files_and_concepts_out(spark):
    g = graph(spark, [("hub", "a"), ("hub", "b"), ("file", "a"), ("file", "b"), ("file", "c"), ("idea", "a")], nodes=[("file", "x.py", "src/x.py"), ("idea", "Idea", "")])
    assert [r.id for r in metrics.god_nodes(g, 3).collect()] == ["a", "b", "hub"]


def test_cohesion_rounds_half_up(spark):
    g = graph(spark, CHAINS, communities={x: 0 if x[0] == "a" else 1 for x in [f"{p}{i}" for p in "ab" for i in range(5)]})
    assert rows(metrics.cohesion(g, metrics.membership_of(g))) == [(0, 5, 4, 0.4), (1, 5, 4, 0.4)]


@pytest.mark.parametrize("seed", range(3))
def test_components_match_union_find(spark, seed):
    edges = random_edges(seed, 20, 14)
    g = graph(spark, edges, nodes=["alone"])
    parent = {x: x for e in edges for x in e} | {"alone": "alone"}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    found = components.connected_components(g.nodes.select("id"), g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    assert rows(found) == sorted((x, find(x)) for x in parent)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    found = components.connected_components(spark.range(302), edges)
    assert found.where("id <= 300 and component = 0").count() == 301
    assert found.where("component = 301").count() == 1


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("directed", [True, False])
def test_betweenness_matches_path_counting(spark, seed, directed):
    edges = [e for e in random_edges(seed, 8, 12) if e[0] != e[1]]
    g = graph(spark, edges, directed=directed)
    nexts = defaultdict(set)
    for a, b in edges:
        nexts[a].add(b)
        if not directed:
            nexts[b].add(a)
    ids = sorted({x for e in edges for x in e})

    def paths(s, t):
        level, done = [[s]], []
        while level and not done:
            done = [p for p in level if p[-1] == t]
            level = [[*p, n] for p in level for n in nexts[p[-1]] if n not in p]
        short = min(map(len, done), default=0)
        return [p for p in done if len(p) == short]

    want = dict.fromkeys(ids, 0.0)
    for s, t in itertools.permutations(ids, 2):
        found = paths(s, t)
        for p in found:
            for v in p[1:-1]:
                want[v] += 0.5 / len(found)
    got = {r.id: r.betweenness for r in centrality.node_betweenness(g).collect()}
    assert got == pytest.approx(want)


def test_edge_betweenness_peaks_at_the_bridge(spark):
    g = graph(spark, CHAINS, directed=False)
    top = centrality.edge_betweenness(g).orderBy(F.desc("betweenness")).first()
    assert (top.u, top.v, top.betweenness) == ("a4", "b0", 25.0)


def test_communities_cover_all_nodes_and_split_chains(spark):
    g = graph(spark, CHAINS, nodes=["alone"], directed=False)
    found = dict(rows(community.communities(g), "id", "community"))
    assert set(found) == {f"{p}{i}" for p in "ab" for i in range(5)} | {"alone"}
    assert found["a0"] == found["a1"] and found["b3"] == found["b4"] and found["a0"] != found["b4"]
    sizes = sorted((list(found.values()).count(c) for c in set(found.values())), reverse=True)
    assert [list(found.values()).count(c) for c in range(len(sizes))] == sizes


def test_communities_ignore_direction(spark):
    flipped = [(e[1], e[0], *e[2:]) for e in CHAINS]
    a, b = (dict(rows(community.communities(graph(spark, e)), "id", "community")) for e in (CHAINS, flipped))
    assert a == b


def test_large_communities_split():
    clique = lambda p: [(f"{p}{i:03}", f"{p}{j:03}", 1.0) for i in range(90) for j in range(i)]
    pairs = clique("a") + clique("b") + [("a000", "b000", 1.0)]
    ids = sorted({x for p in pairs for x in p[:2]})
    assert sorted(map(len, community.split(ids, pairs, float(len(pairs))))) == [90, 90]


def test_label_propagation_finds_cliques(spark):
    cliques = [(f"{p}{i}", f"{p}{j}") for p in "ab" for i in range(4) for j in range(i)] + [("a0", "b0")]
    found = dict(rows(community.label_propagation(graph(spark, cliques)), "id", "community"))
    assert len({found[f"a{i}"] for i in range(4)}) == 1 and len({found[f"b{i}"] for i in range(4)}) == 1


def test_bfs_levels_edges_and_mask(spark):
    g = graph(spark, [("s", "a"), ("s", "b"), ("a", "c"), ("b", "c"), ("c", "s")])
    visited, edges = traverse.bfs(g, ["s"], 2)
    assert rows(visited, "id", "level") == [("a", 1), ("b", 1), ("c", 2), ("s", 0)]
    assert rows(edges, "src", "dst") == [("a", "c"), ("b", "c"), ("s", "a"), ("s", "b")]
    masked, _ = traverse.bfs(g, ["s"], 2, g.nodes.where("id <> 'a' and id <> 'b'").select("id"))
    assert rows(masked, "id", "level") == [("s", 0)]
    assert traverse.bfs(g, ["s"], 1, direction="incident")[0].count() == 4
    with pytest.raises(ValueError):
        traverse.bfs(g, ["s"], -1)


def test_dfs_takes_the_first_edge_first(spark):
    g = graph(spark, [("s", "a"), ("s", "b"), ("b", "d"), ("a", "c")])
    assert [r.id for r in traverse.dfs(g, ["s"], 5).orderBy("place").collect()] == ["s", "b", "d", "a", "c"]
    assert {r.id for r in traverse.dfs(g, ["s"], 1).collect()} == {"s", "a", "b"}


def test_shortest_path(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("a", "x"), ("x", "y"), ("y", "c")])
    assert [r.id for r in traverse.shortest_path(g, "a", "c").orderBy("place").collect()] == ["a", "b", "c"]
    assert traverse.shortest_path(g, "c", "a").count() == 0
    assert traverse.shortest_path(g, "a", "c", 1).count() == 0
    assert traverse.shortest_path(g, "a", "a").count() == 1


def test_call_chains_are_simple_paths_in_edge_order(spark):
    g = graph(spark, [("a", "b"), ("b", "d"), ("a", "d"), ("b", "a"), ("a", "c", "uses"), ("c", "d")])
    assert [r.path for r in traverse.call_chains(g, "A", "D").collect()] == [["a", "d"], ["a", "b", "d"]]
    with pytest.raises(ValueError):
        traverse.call_chains(graph(spark, [("a", "b")], directed=False), "A", "B")


def test_impact_follows_dependents(spark):
    g = graph(spark, [*IMPACT, ("db", "store", "registered_in_store")], communities={"api": 1, "auth": 1, "session": 2})
    found = traverse.impact(g, "Db", 3)
    assert rows(found, "id", "distance") == [("api", 3), ("auth", 2), ("session", 1), ("store", 1)]
    by = {r.community: (r.node_count, r.distance, r.path) for r in traverse.impact_by_community(g, found).collect()}
    assert by == {1: (2, 2, ["Db", "Session", "Auth"]), 2: (1, 1, ["Db", "Session"])}
    assert traverse.impact(g, "Db", 1).count() == 2


def test_bridges_and_their_score(spark):
    g = graph(spark, [("api", "shared"), ("web", "shared")], communities={"api": 0, "shared": 1, "web": 2})
    top = analyze.bridges(g, metrics.membership_of(g)).first()
    assert (top.id, top.connected, top.degree, top.score) == ("shared", [0, 2], 2, 22.0)


def test_surprise_score_adds_up(spark):
    g = graph(spark, [("a", "b", "semantically_similar_to", "AMBIGUOUS")], nodes=[("a", "A", "x/a.py"), ("b", "B", "y/b.md")], communities={"a": 0, "b": 1})
    row = analyze.with_ends(g, metrics.membership_of(g)).select(analyze.surprise_score().alias("s"), analyze.surprise_reasons().alias("r")).first()
    assert row.s == 12  # (3 + 2 + 2 + 1) * 1.5
    assert len(row.r) == 5


def test_diff_drift_and_changed_communities(spark):
    old = graph(spark, [("a", "b")], communities={"a": 0, "b": 1})
    new = graph(spark, [("a", "b"), ("b", "c")], communities={"a": 2, "b": 1, "c": 1})
    assert rows(analyze.diff_summary(analyze.graph_diff(old, new))) == [("edge_added", 1), ("node_added", 1)]
    assert rows(analyze.moved_nodes(old, new), "id", "from_community", "to_community") == [("a", 0, 2)]
    assert rows(analyze.changed_communities(old, new)) == [(0, 1), (1, 3), (2, 1)]
    assert analyze.timeline(old, new, 1).first().kind == "community_moved"


def test_anomalies_and_questions(spark):
    ring = [(f"g{i}", f"g{(i + 1) % 15}") for i in range(15)]
    alpha = [(f"a{i}", f"a{j}") for i in range(6) for j in range(i)]
    g = graph(spark, [*ring, *alpha, ("a0", "bridge"), ("bridge", "g0")], directed=False, communities={**{f"g{i}": 0 for i in range(15)}, **{f"a{i}": 1 for i in range(6)}, "bridge": 2})
    m = metrics.membership_of(g)
    found = analyze.anomalies(g, m, 8).collect()
    assert "bridge_node:bridge" in {r.id for r in found}
    assert all(sum(r.kind == k for r in found) <= 3 for k in {r.kind for r in found})
    assert {r.type for r in analyze.questions(g, m).collect()} >= {"bridge_node"}
    quiet = graph(spark, [("x", "y"), ("y", "z"), ("z", "x")], communities={"x": 0, "y": 0, "z": 0})
    assert analyze.questions(quiet, metrics.membership_of(quiet)).first().type == "no_signal"


def test_incident_sample_alternates(spark):
    g = graph(spark, [("m", "a"), ("m", "b"), ("x", "m"), ("y", "m")])
    assert [r.neighbor for r in metrics.incident_sample(g, 3).where("id = 'm'").orderBy("place").collect()] == ["a", "x", "b"]


def test_find_node_prefers_equal_labels(spark):
    g = graph(spark, [("a", "b")], nodes=[("a", "Order Service", "x.py"), ("b", "order", "y.py")])
    assert metrics.find_node(g, "ORDER").first().id == "b"
    assert metrics.find_node(g, "order serv").first().id == "a"
    assert metrics.find_node(g, "zzz").count() == 0


def test_same_answer_for_any_number_of_partitions(spark):
    g = graph(spark, random_edges(5, 15, 30))
    out = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append((rows(community.communities(g)), rows(metrics.god_nodes(g))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out[0] == out[1]


def test_communities_places_clusters_the_customers_too(spark):
    from quillgraph.plans.catalog import QUERIES

    d = "/root/testdata/sf0.001"
    customers = spark.read.parquet(f"{d}/customer.parquet").count()
    assert QUERIES["communities_places"](spark, d).where("id like 'c:%'").count() == customers > 0
