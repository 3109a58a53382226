from __future__ import annotations

import math
import random

import pytest
from graphs import graph
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import budget, federation, interpret, retrieve, review


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect() if cols else df.collect()))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, T.tokens(F.lit("getUserName_by/id (x)"))) == ["get", "user", "name", "by", "id"]
    assert one(spark, T.question_tokens(F.lit("How does the Login work?"))) == ["login", "work"]
    assert one(spark, T.slug(F.lit("_src/Foo.py."), F.lit("Bar Baz"))) == "src_foo_py_bar_baz"
    assert one(spark, T.round_half_up(F.lit(0.285))) == 0.28
    assert one(spark, T.line_range(F.lit("L10-L20"))).asDict() == {"first": 10, "last": 20}
    assert one(spark, T.line_range(F.lit("§3.1"))) is None
    assert one(spark, T.escape_xml(F.lit("<a & 'b'>"))) == "&lt;a &amp; &apos;b&apos;&gt;"
    assert one(spark, T.fnv1a(F.lit("foobar"))) == 0xBF9CF968
    assert one(spark, T.file_category(F.lit("a/B.TSX"))) == "code"


@pytest.mark.parametrize(("a", "b", "want"), [([1.0, 0.0], [1.0, 1.0], math.sqrt(0.5)), ([], [], 0.0), ([1.0], [1.0, 2.0], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0)])
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    assert df.select(T.cosine("a", "b").alias("x")).first().x == pytest.approx(want)


def test_bm25_prefers_short_rare_labels(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("c", "d")], nodes=[("a", "login", "x.py"), ("b", "login handler for users", "x.py"), ("c", "users", "x.py"), ("d", "other", "x.py")])
    found = {r.id: r.score for r in retrieve.bm25(g, "where is the login?").collect()}
    assert set(found) == {"a", "b"} and found["a"] > found["b"]
    idf = math.log(1 + (4 - 2 + 0.5) / (2 + 0.5))
    assert found["a"] == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.4 + 0.6 * 1 / (7 / 4))))


def test_simple_scores_and_rank_by_degree(spark):
    g = graph(spark, [("hub", "x"), ("hub", "y"), ("hub", "z")], nodes=[("hub", "Auth", "lib/a.py"), ("x", "auth auth", "auth/x.py")])
    assert [(r.id, r.score) for r in retrieve.simple_scores(g, ["auth"]).collect()] == [("x", 1.5), ("hub", 1.0)]
    assert retrieve.simple_scores(g, ["auth"], "degree").first().id == "hub"


def test_fusion(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, place int")
    b = spark.createDataFrame([("y", 1)], "id string, place int")
    assert dict(rows(retrieve.fuse([(a, 2.0), (b, 1.5)]))) == pytest.approx({"x": 2 / 11, "y": 2 / 12 + 1.5 / 11})


def test_expansion_weighs_relations(spark):
    g = graph(spark, [("s", "a", "calls"), ("s", "b", "uses"), ("a", "c", "contains")])
    seeds = spark.createDataFrame([("s", 8.0)], "id string, score double")
    assert {r.id: (r.score, r.hop) for r in retrieve.expand(g, seeds).collect()} == {"s": (8.0, 0), "a": (4.0, 1), "b": (pytest.approx(2.8), 1), "c": (pytest.approx(2.4), 2)}


def test_retrieve_ranks_the_named_node_first(spark):
    g = graph(spark, [("login", "session"), ("session", "db")], nodes=[("login", "loginUser", "auth/login.py"), ("session", "Session", "auth/session.py"), ("db", "Database", "db/db.py")])
    found = retrieve.retrieve(g, "How does loginUser work?").collect()
    assert (found[0].id, found[0].band) == ("login", "direct") and {r.id for r in found} == {"login", "session", "db"}


def greedy(items, limit, pin=True):
    ok = [i for i in items if all(map(math.isfinite, i[1:])) and i[2] >= 0]
    ok.sort(key=lambda i: (-(i[1] / i[2]) if i[2] else -math.inf, -i[1], i[2], i[0]))
    used, out = 0.0, set()
    for id_, _, cost in ok:
        if cost == 0:
            out |= {id_} if pin else set()
        elif used + cost <= limit:
            used += cost
            out.add(id_)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_knapsack_matches_the_greedy_rule(spark, seed):
    rng = random.Random(seed)
    items = [(f"i{k:02}", float(rng.randint(0, 9)), float(rng.choice([0, 1, 2, 3, 5, 8, 13]))) for k in range(25)] + [("nan", math.nan, 1.0), ("neg", 1.0, -1.0)]
    df = spark.createDataFrame([(1, *i) for i in items], "pool int, id string, score double, token_cost double")
    got = {r.id for r in budget.knapsack(df, 20).where("included").collect()}
    assert got == greedy(items, 20)
    assert {r.id for r in budget.knapsack(df, 20, pin_free=False).where("included").collect()} == greedy(items, 20, False)


def test_prefix_pack_keeps_the_first(spark):
    df = spark.createDataFrame([(1, 1, 50.0), (1, 2, 1.0), (2, 1, 3.0), (2, 2, 3.0), (2, 3, 9.0), (2, 4, 1.0)], "pool int, place int, token_cost double")
    assert rows(budget.prefix_pack(df, 10), "pool", "place") == [(1, 1), (2, 1), (2, 2)]


def test_compile_pack_fits_the_rest(spark):
    df = spark.createDataFrame([("a", True, 1.0, 6.0), ("b", False, 9.0, 5.0), ("c", False, 1.0, 4.0)], "id string, required boolean, score double, token_cost double").withColumn("pool", F.lit(1))
    assert rows(budget.compile_pack(df, 10), "id") == [("a",), ("c",)]


def test_delta_and_session(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    rel = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    n, r = budget.delta_pack(nodes, rel, nodes.where("id <> 'c'"))
    assert rows(n) == [("c",)] and rows(r, "src", "dst") == [("b", "c")]
    s = lambda *x: spark.createDataFrame(list(x), "ref string, hash string")
    assert rows(budget.session_diff(s(("a", "1"), ("b", "1"), ("c", "1")), s(("a", "1"), ("b", "2"), ("d", "1")))) == [("a", "reused"), ("b", "updated"), ("c", "invalidated"), ("d", "added")]


def test_federation_links_equal_labels(spark):
    side = lambda x: graph(spark, [(x, "k")], nodes=[(x, x, "a.py"), ("k", "SessionContract", "a.py")], directed=False)
    g = federation.federate({"front": side("f"), "back": side("b")})
    assert ("front::k", "back::k") in {tuple(sorted((r.src, r.dst), reverse=True)) for r in g.edges.where("relation = 'shared_across_repos'").collect()}
    assert g.nodes.count() == 4 and g.edges.count() == 3
    with pytest.raises(ValueError):
        federation.federate({})


def test_review_seeds_fall_back_to_the_file(spark):
    nodes = spark.createDataFrame([("a", "x.py", "L1-L9", 0), ("b", "x.py", "L20", 1), ("c", "y.py", "L5", 2)], "id string, source_file string, source_location string, ord long")
    changed = spark.createDataFrame([("x.py", 8, 12), ("y.py", 90, 91)], "file string, first int, last int")
    assert rows(review.review_seeds(nodes, changed), "id", "match") == [("a", "line"), ("c", "file")]


def test_likely_tests(spark):
    got = review.test_paths(spark.createDataFrame([("src/a.ts",), ("b.py",)], "path string"), spark.createDataFrame([("src/__tests__/a.spec.ts",), ("tests/test_b.py",), ("b_test.py",)], "path string"))
    assert rows(got) == [("b.py", "b_test.py"), ("b.py", "tests/test_b.py"), ("src/a.ts", "src/__tests__/a.spec.ts")]


def test_risk(spark):
    df = spark.createDataFrame([("x", 1, 1, 0, 0), ("y", 0, 0, 1, 0), ("z", 0, 1, 0, 0)], "label string, affected int, communities int, hotspots int, dependents int")
    assert [(r.label, r.score, r.severity) for r in review.risk_map(df).collect()] == [("y", 6, "high"), ("x", 3, "medium"), ("z", 1, "low")]


@pytest.mark.parametrize(
    ("question", "intent", "level"),
    [("hello!", "chitchat", 0), ("Why is it slow?", "debug", 3), ("What depends on x?", "impact", 4), ("Explain the billing", "explain", 1), ("Explain `Bill.total`", "explain", 2), ("rename it", "rename", 0), ("Add a button", "unknown", 1), ("Explain it, without tests", "explain", 1)],
)
def test_questions(question, intent, level):
    r = interpret.read_question(question)
    assert (r.intent, r.level) == (intent, level)


def test_names_in_questions(spark):
    r = interpret.read_question("Where does src/auth/login.ts call `Session.open()`? Ignore tests and mocks.")
    assert (r.paths, r.symbols, r.excluded) == (["src/auth/login.ts"], ["Session.open()"], ["tests", "mocks"])
    assert interpret.read_question("review this", has_diff=True).level == 5 and interpret.read_question("hi", level=3).level == 3
    df = spark.createDataFrame([("Session.open()", "x.ts"), (".open()", "lib/session.ts"), ("Door.open()", "door.ts"), ("close", "x.ts")], "label string, file string")
    got = [x.s for x in df.select(interpret.symbol_score(F.col("label"), F.col("file"), ["Session.open()"]).alias("s")).collect()]
    assert got == [4.0, 3.5, 3.0, 0.0]
    names = interpret.identifiers("what sets user_login_count here")
    assert names == [("userlogincount", 3)]
    df = spark.createDataFrame([("userLoginCount", "x.ts"), ("x", "a/user_login_count.ts"), ("y", "y.ts")], "label string, file string")
    assert [round(x.s, 2) for x in df.select(interpret.identifier_score(F.col("label"), F.col("file"), names).alias("s")).collect()] == [1.45, 1.2, 0.0]
    assert one(spark, interpret.quality_score([F.lit(2), F.lit(1)])) == 0.7


@pytest.mark.parametrize("name", ["knapsack", "compile_pack"])
def test_packing_queries_take_every_pool(spark, name):
    from quillgraph.plans.catalog import QUERIES

    d = "/root/testdata/sf0.01"
    pools = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey").distinct().count()
    assert pools > 20 and QUERIES[name](spark, d).select("pool").distinct().count() == pools


def test_places_of_all_rows(spark):
    scores = spark.range(0, 3000, 1, 7).selectExpr("id", "cast(id % 40 as double) as score", "0 as total", "0 as degree", "'' as label", "'' as file")
    want = {r: i for i, r in enumerate(sorted((r for r in range(3000) if r % 40), key=lambda r: (-(r % 40), r)), 1)}
    assert dict(rows(retrieve.ranked(scores, "score").select("id", "place"))) == want
    assert retrieve.ranked(scores.where("id < 0"), "score").count() == 0
