"""Small literal graphs."""

from quillgraph.operators.graph import EDGE_COLUMNS, NODE_COLUMNS, PropertyGraph, conformed


def graph(spark, edges, nodes=None, directed=True, communities=None):
    """``edges``: (src, dst[, relation[, confidence[, weight]]]); ``nodes``: ids or (id, label, source_file)."""
    rows = [(e[0], e[1], (e[2] if len(e) > 2 else "calls"), (e[3] if len(e) > 3 else "EXTRACTED"), float(e[4] if len(e) > 4 else 1), i) for i, e in enumerate(edges)]
    ids = dict.fromkeys([x for e in edges for x in e[:2]])
    given = {(n if isinstance(n, str) else n[0]): n for n in nodes or []}
    ids.update(dict.fromkeys(given))
    out = []
    for i, n in enumerate(ids):
        known = given.get(n, n)
        label, file = (n.title(), f"src/{n}.py") if isinstance(known, str) else known[1:3]
        out.append((n, label, "code", file, (communities or {}).get(n), i))
    ndf = spark.createDataFrame(out, "id string, label string, file_type string, source_file string, community int, ord long")
    edf = spark.createDataFrame(rows, "src string, dst string, relation string, confidence string, weight double, ord long")
    return PropertyGraph.of(conformed(ndf, NODE_COLUMNS), conformed(edf, EDGE_COLUMNS), directed)


CHAINS = [(f"{p}{i}", f"{p}{i + 1}") for p in "ab" for i in range(4)] + [("a4", "b0", "related_to", "INFERRED", 0.5)]
IMPACT = [("api", "auth"), ("auth", "session"), ("auth", "user"), ("auth", "logger"), ("session", "db")]
