from __future__ import annotations

import json

from graphs import graph
from pyspark.sql import functions as F

from quillgraph.operators import metrics
from quillgraph.sources import extraction, files, sinks, text_parsers
from quillgraph.streaming import watch, windows


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect() if cols else df.collect()), key=repr)


def test_extraction_document(spark, tmp_path):
    doc = {
        "schema_version": 2, "input_tokens": 1200, "output_tokens": 340,
        "nodes": [{"id": "a", "label": "A", "file_type": "code", "source_file": "a.py", "source_location": "L1"}, {"id": "b", "label": "B", "file_type": "odd", "source_file": "b.py"}],
        "links": [{"source": "a", "target": "b", "relation": "calls", "confidence": "INFERRED", "source_file": "a.py", "weight": 0.8}, {"source": "a", "target": "zz", "relation": "calls", "confidence": "EXTRACTED", "source_file": "a.py"}],
        "hyperedges": [{"id": "h", "nodes": ["a", "b"], "label": "H"}, {"id": "i", "nodes": ["a", "q"], "label": "I"}],
    }
    (tmp_path / "g.json").write_text(json.dumps(doc))
    docs = extraction.read_documents(spark, str(tmp_path / "g.json"))
    g = extraction.graph_of(docs)
    assert rows(g.edges, "src", "dst", "weight") == [("a", "b", 0.8)] and not g.directed
    assert rows(extraction.edges_of(docs), "dst", "confidence_score") == [("b", 0.5), ("zz", 1.0)]
    assert rows(extraction.violations(extraction.nodes_of(docs), extraction.edges_of(docs)), "item", "problem") == [("edge", "unknown dst zz"), ("node", "invalid file_type odd")]
    assert rows(extraction.whole_hyperedges(extraction.rows_of(docs, "hyperedges"), g.nodes), "id") == [("h",)]
    assert extraction.merged(docs).first().asDict() == {"schema_version": 2, "input_tokens": 1200, "output_tokens": 340, "nodes": 2, "edges": 2, "hyperedges": 2}
    assert {r.layer for r in extraction.normalized(extraction.nodes_of(docs)).collect()} == {"base"}


def test_retained_drops_what_refers_to_removed_files(spark):
    g = graph(spark, [("a", "b"), ("b", "c")])
    hyper = spark.createDataFrame([("h", ["a", "c"], "x"), ("i", ["b", "c"], "x")], "id string, nodes array<string>, source_file string")
    n, e, h = extraction.retained(g.nodes, g.edges.withColumn("source_file", F.lit("z.py")), hyper, spark.createDataFrame([("src/a.py",)], "source_file string"))
    assert rows(n, "id") == [("b",), ("c",)] and rows(e, "src", "dst") == [("b", "c")] and rows(h, "id") == [("i",)]


def test_unified_diff(spark):
    patch = "+++ b/src/x.py\n@@ -1,3 +2,4 @@ f\n@@ -9 +12 @@\n+++ /dev/null\n@@ -1,2 +0,0 @@\n+++ nothing\n@@ -1 +1 @@\n+++ b/y.py\n@@ -4,2 +7,0 @@\n@@ -5,2 +8,3 @@\n"
    df = spark.createDataFrame([(1, patch), (2, "")], "id int, text string")
    assert rows(text_parsers.changed_ranges(df)) == [(1, "src/x.py", 12, 12), (1, "src/x.py", 2, 5), (1, "y.py", 8, 10)]


def test_sections_nest(spark):
    text = "# Top\n## One\n```\n# no\n```\n### Deep\n## Two\nTitle\n=====\n#### Far\n"
    got = {r.title: (r.level, r.parent) for r in text_parsers.sections(spark.createDataFrame([(1, text)], "id int, text string")).collect()}
    assert got == {"Top": (1, None), "One": (2, 1), "Deep": (3, 2), "Two": (2, 1), "Title": (1, None), "Far": (4, 8)}


def test_python_sources(spark):
    src = "from pkg.b import go\nclass K:\n    def m(self):\n        return helper()\ndef helper():\n    return 1\n"
    df = spark.createDataFrame([("pkg/a.py", src), ("pkg/b.py", "def go(): pass\n"), ("bad.py", "def (")], "path string, text string")
    symbols = text_parsers.python_symbols(df)
    assert symbols.where("kind = 'error'").count() == 1
    nodes, edges = text_parsers.symbol_graph(symbols.where("kind <> 'error'"))
    assert {("contains",), ("method",), ("calls",)} == {tuple(r) for r in edges.select("relation").distinct().collect()}
    assert rows(text_parsers.import_edges(symbols)) == [("pkg/a.py", "pkg/b.py")]


def test_citations_and_links(spark):
    df = spark.createDataFrame([(1, r"10.1000/Ab1, arXiv:2101.00001 \citep{x, y} [a](b.md) ![i](c.png)")], "id int, text string")
    assert rows(text_parsers.citations(df), "kind", "target") == [("arxiv", "2101.00001"), ("doi", "10.1000/ab1"), ("latex", "x"), ("latex", "y")]
    assert rows(text_parsers.markdown_links(df), "target") == [("b.md",)]


def test_file_rules(spark):
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    got = dict(rows(files.ignored(paths("a/node_modules/x.js", "docs/a.md", "docs/keep.md", "src/a.gen.ts", "x.ts"), ["docs/**", "!docs/keep.md", "*.gen.ts"]), "path", "ignored"))
    assert got == {"a/node_modules/x.js": True, "docs/a.md": True, "docs/keep.md": False, "src/a.gen.ts": True, "x.ts": False}
    got = dict(rows(paths(".env", ".env.example", "k/id_rsa", "a/.aws/c.txt", "secrets/load.py", "db_password.yml").select("path", files.sensitive("path"))))
    assert got == {".env": "env_file", ".env.example": None, "k/id_rsa": "private_key", "a/.aws/c.txt": "sensitive_directory", "secrets/load.py": None, "db_password.yml": "secret_config"}
    assert dict(rows(paths("https://x.com/a", "https://arxiv.org/abs/1", "notaurl").select("path", files.ingest_kind("path")))) == {"https://x.com/a": "tweet", "https://arxiv.org/abs/1": "arxiv", "notaurl": "webpage"}


def test_freshness(spark):
    was = spark.createDataFrame([("a", "1", True), ("b", "1", False)], "path string, fingerprint string, chosen boolean")
    now = lambda *x: spark.createDataFrame(list(x), "path string, fingerprint string")
    status = lambda n: files.freshness(was, n).first().status
    assert [status(now(("a", "1"), ("b", "1"))), status(now(("a", "2"), ("b", "1"))), status(now(("a", "1"), ("b", "2"))), status(now(("a", "1")))] == ["fresh", "possibly_stale", "partially_stale", "stale"]


def test_discovery_reads_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.py").write_text("x = 1\n")
    (tmp_path / "b.md").write_text("one two three\n")
    found = files.discover(spark, str(tmp_path))
    assert files.corpus_verdict(found).first().asDict() == {"files": 2, "words": 6, "needs_graph": False, "warning": "fits a context window"}
    assert files.cache_misses(found, found.where("path like '%a.py'").select(F.sha2("content", 256).alias("hash"))).count() == 1


def test_sinks(spark, tmp_path):
    g = graph(spark, [("a", "b")], nodes=[("a", "<A>", "a.py"), ("b", "it's", "b.py")], communities={"a": 0, "b": 1})
    m = metrics.membership_of(g)
    body = "\n".join(r.value for r in sinks.graphml_lines(g).orderBy("place").collect())
    assert "&lt;A&gt;" in body and body.endswith("</graphml>")
    assert any("it\\'s" in r.value for r in sinks.cypher_lines(g).collect())
    node = json.loads(sinks.json_rows(g, m.where("id = 'a'")).where("part = 'node' and value like '%\"b\"%'").first().value)
    assert node["community"] == -1
    assert sinks.svg_lines(g, m).count() == 5
    sinks.write_lines(sinks.cypher_lines(g), str(tmp_path / "c"))
    sinks.write_tables(g, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "c")).count() == 3 and spark.read.parquet(str(tmp_path / "t/nodes")).count() == 2
    assert "# X" in sinks.notes(g, m, m.select("community", F.lit("X").alias("label"))).first().value


def test_windows(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:01"), (1, "2024-01-01 00:00:02"), (1, "2024-01-01 00:00:59"), (1, "2024-01-01 00:02:00")], "k int, t string").select("k", F.col("t").cast("timestamp").alias("ts"))
    assert rows(windows.rate_limited(df, "k", 2), "n", "limited") == [(1, False), (3, True)]
    assert rows(windows.settled(df, "k", "3 seconds"), "n") == [(1,), (1,), (2,)]


def test_rebuild_keeps_unchanged_files(spark):
    t = lambda *x: spark.createDataFrame(list(x), "source_file string, id string")
    m = lambda *x: spark.createDataFrame(list(x), "path string, fingerprint string")
    got = watch.rebuilt(t(("a", "a1"), ("b", "b1"), ("c", "c1")), t(("b", "b2"), ("d", "d1")), m(("a", "1"), ("b", "1"), ("c", "1")), m(("a", "1"), ("b", "2"), ("d", "1")))
    assert rows(got, "id") == [("a1",), ("b2",), ("d1",)]
    assert [watch.next_interval(8, False), watch.next_interval(200, False), watch.next_interval(200, True)] == [16, 300, 1]


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.py").write_text("x")
    seen = []
    for name in ("b.py", None):
        watch.watch_files(spark, str(tmp_path / "in"), str(tmp_path / "ck"), lambda df, n: seen.extend(r.path.rsplit("/", 1)[1] for r in df.select("path").collect())).awaitTermination()
        if name:
            (tmp_path / "in" / name).write_text("y")
    assert sorted(seen) == ["a.py", "b.py"]


def test_session_state(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "session string, ref string, hash string"
    write = lambda *x: spark.createDataFrame(list(x), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: watch.session_updates(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    write(("s", "a", "1"), ("s", "b", "1"))
    run()
    write(("s", "a", "1"), ("s", "b", "2"), ("s", "c", "1"))
    run()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "ref", "status") == [("a", "added"), ("a", "reused"), ("b", "added"), ("b", "updated"), ("c", "added")]
