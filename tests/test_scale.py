"""Steps whose cost has to follow the input."""


from graphs import graph
from pyspark.sql import functions as F

from quillgraph.operators import analyze, budget, centrality, community, federation, metrics
from quillgraph.operators.graph import EDGE_COLUMNS, NODE_COLUMNS, PropertyGraph, conformed
from quillgraph.plans import staging



class Counted(str):
    compared = 0

    def __lt__(self, other):
        Counted.compared += 1
        return str.__lt__(self, other)


class Pairs(list):
    read = 0

    def __iter__(self):
        self.read += 1
        return super().__iter__()


def test_first_of_a_group_is_found_once():
    Counted.compared = 0
    got = community.with_first([[Counted(f"n{i:03}") for i in range(200)], [Counted("z")]])
    assert Counted.compared < 400
    assert got == [(f"n{i:03}", "n000") for i in range(200)] + [("z", "z")]


def test_pairs_are_not_read_again_for_each_group():
    groups = 30
    ids = [f"{g:02}:{i:03}" for g in range(groups) for i in range(160)]  # more than LARGEST each, so that each is split again
    pairs = Pairs((f"{g:02}:000", f"{g:02}:{i:03}", 1.0) for g in range(groups) for i in range(1, 160))
    found = community.split(ids, pairs, float(len(pairs)))
    assert pairs.read <= 2
    assert sorted(x for g in found for x in g) == ids


def stored_graph(spark, folder, edges):
    """A graph read from files, whose size is therefore known."""
    g = graph(spark, edges)
    g.nodes.write.parquet(f"{folder}/nodes")
    g.edges.write.parquet(f"{folder}/edges")
    return PropertyGraph(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges"), True)


EDGES = [(f"n{i % 50:02}", f"n{(i * 7 + i // 50) % 60:02}") for i in range(500)] + [("n01", "n01"), ("n07", "n01"), ("n01", "n07")]


def test_pairs_are_grouped_by_tasks_that_grow_in_number(spark, tmp_path, monkeypatch):
    g = stored_graph(spark, tmp_path, EDGES)
    monkeypatch.setattr(staging, "TASK_BYTES", staging.stored_bytes(g.edges) // 40)
    assert g.incident.select("id").rdd.getNumPartitions() >= 40
    want = {(a, b) for x, y in EDGES for a, b in ((x, y), (y, x))}
    assert sorted(map(tuple, g.incident.collect())) == sorted(want)
    assert {r.id: r.degree for r in g.degrees.collect()} == {n: sum(a == n for a, _ in want) for n in {a for a, _ in want}}
    plan = g.incident._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan[plan.rindex("REPARTITION_BY_NUM") :]  # no table of pairs before they are dealt


def test_incident_keeps_null_ends(spark):
    edges = spark.createDataFrame([("a", None), (None, "a"), ("a", "b"), (None, None)], "src string, dst string")
    g = PropertyGraph(conformed(spark.createDataFrame([("a",)], "id string"), NODE_COLUMNS), conformed(edges, EDGE_COLUMNS))
    assert sorted(map(str, map(tuple, g.incident.collect()))) == sorted(map(str, [("a", None), (None, "a"), ("a", "b"), ("b", "a"), (None, None)]))


def test_knapsack_places_each_item_once(spark):
    items = [("p", "x", 3.0, 2.0), ("p", "x", 3.0, 2.0), ("p", "y", 1.0, 3.0), ("q", "x", 1.0, 4.0)] + [("r", f"i{i:05}", 1.0, 0.0) for i in range(30000)]
    got = budget.knapsack(spark.createDataFrame(items, "pool string, id string, score double, token_cost double"), 5)
    assert got.columns == ["pool", "id", "score", "token_cost", "density", "place", "included"]
    assert sorted((r.id, r.place, r.included) for r in got.where("pool <> 'r'").collect()) == [("x", 1, True), ("x", 1, True), ("x", 2, True), ("y", 3, False)]
    assert got.where("pool = 'r' and included").count() == 30000


def test_a_common_label_is_paired_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(federation, "NODES_PER_TASK", 5, raising=False)
    nodes = [(r, f"{r}:{i}", "Same" if i else "only", i) for r in (2, 0, 1) for i in range(31)] + [(0, "0:x", "alone", 99)]
    got = federation.shared_labels(spark.createDataFrame(nodes, "repo int, id string, label string, ord long"))
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 5
    pairs = [(a[1], b[1]) for a in nodes for b in nodes if a[2].lower() == b[2].lower() and a[0] < b[0]]
    assert sorted(map(tuple, got.collect())) == sorted(pairs)


HOME = {f"n{i:02}": i % 3 for i in range(58)}  # n58 and n59 are in none


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ends_are_judged_before_edges_are_multiplied(spark):
    g = graph(spark, EDGES, communities=HOME)
    member = metrics.membership_of(g)
    audit, inner = metrics.confidence_audit(g, member), metrics.cohesion(g, member)
    plan = plan_of(audit)
    assert plan.index("Generate") < plan.index("Join")  # a row per edge is joined, not one per end
    plan = plan_of(inner)
    assert plan.index("hashpartitioning(u#") < plan.index("hashpartitioning(dst#")  # only pairs inside are made distinct
    once = set(EDGES)
    assert {r.community: r.extracted for r in audit.collect()} == {c: sum(c in (HOME.get(a), HOME.get(b)) for a, b in once) for c in range(3)}
    pairs = {(min(e), max(e)) for e in once}
    assert {r.community: r.edges for r in inner.collect()} == {c: sum(HOME.get(a) == HOME.get(b) == c for a, b in pairs) for c in range(3)}


def test_details_count_loops_and_reverse_edges_once(spark):
    g = graph(spark, EDGES, communities=HOME)
    got = {r.community: (r.edge_count, r.entry_points, r.bridge_nodes, r.most_outside) for r in metrics.community_details(g, metrics.membership_of(g)).collect()}
    pairs = {(min(e), max(e)) for e in EDGES}
    near = {(a, b) for x, y in pairs for a, b in ((x, y), (y, x))}
    for c in range(3):
        outside = {n: [HOME.get(b) for a, b in near if a == n and HOME.get(b) != c] for n in HOME if HOME[n] == c}
        some = [o for o in outside.values() if o]
        assert got[c] == (sum(HOME.get(a) == HOME.get(b) == c for a, b in pairs), len(some), sum(len(set(o) - {None}) >= 2 for o in some), max(map(len, some), default=0))


def test_a_graph_too_large_for_betweenness_is_not_written(spark, monkeypatch):
    g = graph(spark, EDGES, communities=HOME)
    monkeypatch.setattr(centrality, "MOST_NODES", 10)
    monkeypatch.setattr(PropertyGraph, "staged", lambda self: 1 / 0)
    got = analyze.bridges(g, metrics.membership_of(g), None).collect()
    near = {(a, b) for x, y in EDGES for a, b in ((x, y), (y, x))}
    want = {n: (sorted({HOME[b] for a, b in near if a == n and b in HOME} - {HOME.get(n)}), sum(a == n for a, b in near)) for n in {a for a, _ in near}}
    assert {r.id: (r.connected, r.degree) for r in got} == {n: w for n, w in want.items() if w[0] and not (n in HOME and len(w[0]) == 1 and w[1] <= 1)}
