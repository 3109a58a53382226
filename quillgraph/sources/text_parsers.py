"""Rows from texts: unified diffs, markdown structure, citations, links, Python sources, covered tests."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import slug


def numbered_lines(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``(key, line, content)`` with lines from 1, without trailing white space."""
    return docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("n", "raw")).select(key, (F.col("n") + 1).alias("line"), F.rtrim(F.regexp_replace("raw", r"\r$", "")).alias("content"))


def changed_ranges(patches: DataFrame, key: str = "id") -> DataFrame:
    """``patches(id, text)`` of unified diffs -> ``(id, path, first, last)``: the new side's ranges of each file."""
    lines = numbered_lines(patches, key)
    path = F.when(F.col("content").startswith("+++ b/"), F.substring("content", 7, 1 << 20)).when(F.col("content").startswith("+++ "), "")
    filled = lines.withColumn("path", F.last(path, True).over(Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    head = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    hunks = filled.where((F.coalesce("path", F.lit("")) != "") & F.col("content").rlike(head))
    first = F.regexp_extract("content", head, 1).cast("int")
    count = F.regexp_extract("content", head, 2)
    out = hunks.select(key, "path", "line", first.alias("first"), F.when(count == "", "1").otherwise(count).cast("int").alias("n"))
    return out.where("n > 0 and first > 0").select(key, "path", "first", (F.col("first") + F.col("n") - 1).alias("last"))


def sections(docs: DataFrame, key: str = "id") -> DataFrame:
    """``(id, line, level, title, parent)``: headings of markdown texts outside fenced code, and the line of the one they belong to."""
    lines = numbered_lines(docs, key)
    w = Window.partitionBy(key).orderBy("line")
    fence = F.col("content").rlike(r"^\s*(```|~~~)").cast("int")
    open_ = lines.withColumn("fenced", (F.sum(fence).over(w.rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1) | (fence == 1)).withColumn("under", F.lead("content").over(w))
    marks = F.regexp_extract("content", r"^(#{1,6})\s+\S", 1)
    setext = F.when(F.col("under").rlike(r"^=+$"), 1).when(F.col("under").rlike(r"^-{2,}$"), 2)
    level = F.when(marks != "", F.length(marks)).when((F.trim("content") != "") & ~F.col("content").rlike(r"^([#>|*-]|\s)"), setext)
    heads = open_.where(~F.col("fenced")).select(key, "line", level.alias("level"), F.trim(F.regexp_replace("content", r"^#{1,6}\s+|\s+#+$", "")).alias("title")).where("level is not null")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    # the last heading of each smaller level, unless one that is smaller still has come since
    last = [F.max(F.when(F.col("level") == n, F.col("line"))).over(earlier).alias(f"l{n}") for n in range(1, 6)]
    placed = heads.select("*", *last)
    return placed.select(key, "line", "level", "title", F.greatest(*(F.when(F.col("level") > n, F.col(f"l{n}")) for n in range(1, 6)), F.lit(None).cast("int")).alias("parent"))


def markdown_links(docs: DataFrame, key: str = "id") -> DataFrame:
    """``(id, target)`` of inline links other than images."""
    found = F.regexp_extract_all("text", F.lit(r"(?<!!)\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1))
    return docs.select(key, F.explode(found).alias("target")).distinct()


def citations(docs: DataFrame, key: str = "id") -> DataFrame:
    """``(id, kind, target)``: DOIs, arXiv numbers and LaTeX keys that a text cites."""
    doi = F.transform(F.regexp_extract_all("text", F.lit(r"\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]*[A-Za-z0-9])"), F.lit(1)), lambda x: F.struct(F.lit("doi").alias("kind"), F.lower(x).alias("target")))
    arxiv = F.transform(F.regexp_extract_all("text", F.lit(r"(?i)arxiv:\s*(\d{4}\.\d{4,5})"), F.lit(1)), lambda x: F.struct(F.lit("arxiv").alias("kind"), x.alias("target")))
    latex = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(r"\\cite[tp]?\{([^}]+)\}"), F.lit(1)), lambda x: F.transform(F.split(x, r"\s*,\s*"), lambda k: F.struct(F.lit("latex").alias("kind"), F.trim(k).alias("target")))))
    return docs.select(key, F.explode(F.array_distinct(F.concat(doi, arxiv, latex))).alias("c")).select(key, "c.*")


def html_links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """``(page_id, href, n)`` of a page's anchors."""
    return pages.select(key, F.explode(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))).alias("href")).groupBy(key, "href").agg(F.count("*").alias("n"))


SYMBOLS = "file string, kind string, name string, owner string, first int, last int, target string"


def python_symbols(files: DataFrame) -> DataFrame:
    """``files(path, text)`` -> classes, functions, imports and calls of Python sources, one row each.

    ``owner`` is the enclosing class or function, ``target`` what an import or a call names. A file that doesn't
    parse gives one row of kind ``error``.
    """

    def walk(path: str, text: str) -> Iterator[tuple]:
        try:
            tree = ast.parse(text or "")
        except (SyntaxError, ValueError):
            yield path, "error", None, None, None, None, None
            return
        stack: list[tuple[ast.AST, str | None]] = [(tree, None)]
        while stack:
            node, owner = stack.pop()
            for child in ast.iter_child_nodes(node):
                inner = owner
                if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                    kind = "class" if isinstance(child, ast.ClassDef) else "function"
                    yield path, kind, child.name, owner, child.lineno, child.end_lineno, None
                    inner = child.name
                elif isinstance(child, ast.Import):
                    for a in child.names:
                        yield path, "import", a.asname or a.name, owner, child.lineno, child.end_lineno, a.name
                elif isinstance(child, ast.ImportFrom):
                    for a in child.names:
                        yield path, "import", a.asname or a.name, owner, child.lineno, child.end_lineno, f"{'.' * child.level}{child.module or ''}.{a.name}"
                elif isinstance(child, ast.Call):
                    name = child.func.attr if isinstance(child.func, ast.Attribute) else child.func.id if isinstance(child.func, ast.Name) else None
                    if name:
                        yield path, "call", None, owner, child.lineno, child.end_lineno, name
                stack.append((child, inner))

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SYMBOLS.split(", ")]
        for f in frames:
            rows = [r for path, text in zip(f.path, f.text, strict=True) for r in walk(path, text)]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"first": "Int32", "last": "Int32"})

    return files.select("path", "text").mapInPandas(parse, SYMBOLS)


def symbol_graph(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of ``python_symbols``: files contain symbols, owners have methods, callers call what a name resolves to in their file."""
    own = symbols.where("kind in ('class', 'function')").select(slug("file", F.coalesce("owner", F.lit("")), "name").alias("id"), "file", "kind", "name", "owner", "first", "last")
    files = symbols.select("file").distinct().select(slug("file").alias("id"), F.element_at(F.split("file", "/"), -1).alias("label"), F.lit("code").alias("file_type"), F.col("file").alias("source_file"), F.lit(None).cast("string").alias("source_location"), F.lit(None).cast("string").alias("node_kind"), F.lit(0).cast("long").alias("ord"))
    label = F.when(F.col("kind") == "function", F.concat(F.when(F.col("owner").isNotNull(), ".").otherwise(""), "name", F.lit("()"))).otherwise(F.col("name"))
    nodes = own.select("id", label.alias("label"), F.lit("code").alias("file_type"), F.col("file").alias("source_file"), F.concat(F.lit("L"), F.col("first").cast("string"), F.lit("-L"), F.col("last").cast("string")).alias("source_location"), F.col("kind").alias("node_kind"), F.col("first").cast("long").alias("ord"))
    edge = lambda df, src, dst, relation, confidence: df.select(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"), F.lit(confidence).alias("confidence"), F.lit(1.0).alias("weight"), F.col("file").alias("source_file"), F.col("first").cast("long").alias("ord"))
    contains = edge(own.where("owner is null"), slug("file"), F.col("id"), "contains", "EXTRACTED")
    owners = own.select("file", F.col("name").alias("owner"), F.col("id").alias("owner_id"))
    method = edge(own.join(owners, ["file", "owner"]), F.col("owner_id"), F.col("id"), "method", "EXTRACTED")
    targets = own.select("file", F.col("name").alias("target"), F.col("id").alias("target_id"))
    calls = symbols.where("kind = 'call' and owner is not null").select("file", "owner", "target", "first").join(owners, ["file", "owner"]).join(targets, ["file", "target"]).where("owner_id <> target_id").dropDuplicates(["owner_id", "target_id"])
    return files.unionByName(nodes), contains.unionByName(method).unionByName(edge(calls, F.col("owner_id"), F.col("target_id"), "calls", "EXTRACTED"))


def import_edges(symbols: DataFrame) -> DataFrame:
    """``(src, dst)`` files: imports resolved to the files whose module path they name."""
    module = F.regexp_replace(F.regexp_replace("file", r"(/__init__)?\.py$", ""), "/", ".")
    files = symbols.select("file").distinct().select(F.col("file").alias("dst"), module.alias("module"))
    wanted = symbols.where("kind = 'import'").select(F.col("file").alias("src"), F.explode(F.array("target", F.regexp_replace("target", r"\.[^.]*$", ""))).alias("module"))
    return wanted.join(files, "module").where("src <> dst").select("src", "dst").distinct()


def covered_by(imports: DataFrame) -> DataFrame:
    """``imports(src, dst)`` of files -> ``(file, test, confidence)``: tests that import a file, high where the names pair."""
    test = r"(^|/)(__tests__|tests?)/|\.(test|spec)\.|(^|/)test_|_test\."
    base = lambda c: F.regexp_replace(F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"(\.(test|spec))?\.[^.]*$", ""), r"^test_|_test$", "")
    found = imports.where(F.col("src").rlike(test) & ~F.col("dst").rlike(test))
    return found.select(F.col("dst").alias("file"), F.col("src").alias("test"), F.when(base("src") == base("dst"), "high").otherwise("medium").alias("confidence")).distinct()
