"""Files as rows: discovery, classification, safety and ignore rules, manifests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import KINDS_OF_FILE, basename, extension, words_in

# Marks of scientific papers, three of which make one.
PAPER_MARKS = (
    r"\barxiv\b", r"\bdoi\s*:", r"\babstract\b", r"\bproceedings\b", r"\bjournal\b", r"\bpreprint\b", r"\\cite\{", r"\[\d+\]", r"\[\n\d+\n\]", r"eq\.\s*\d+|equation\s+\d+", r"\d{4}\.\d{4,5}", r"\bwe propose\b", r"\bliterature\b",
)
SENSITIVE_DIRECTORIES = (".ssh", ".aws", ".gnupg", ".kube", ".docker", "secrets", "credentials")
ALWAYS_IGNORED = r"(^|/)(node_modules|\.git|__pycache__|\.venv|venv|dist|build|coverage|\.next|target)(/|$)"
WORDS_WORTH_A_GRAPH, WORDS_TOO_MANY, FILES_TOO_MANY = 50_000, 500_000, 200


def discover(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``(path, text, bytes, modified)`` of all files under a root. Contents come in only where a plan reads them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text"), "content")


def looks_like_paper(text: Column | str) -> Column:
    """At least three marks in the first 3000 characters."""
    head = F.lower(F.substring(text, 1, 3000))
    return sum((head.rlike(m).cast("int") for m in PAPER_MARKS), F.lit(0)) >= 3


def file_type(path: Column | str, text: Column | str | None = None) -> Column:
    """code, document, paper, image, audio or video by extension; a document that reads like a paper is one; null for others."""
    ext = extension(path)
    out = F.lit(None).cast("string")
    for kind, names in KINDS_OF_FILE.items():
        found = F.lit(kind) if kind != "document" or text is None else F.when(looks_like_paper(text), "paper").otherwise("document")
        out = F.when(ext.isin(*names), found).otherwise(out)
    return out


def source_domain(path: Column | str) -> Column:
    """Where a file belongs, by the first rule that fits."""
    p = F.lower(F.col(path) if isinstance(path, str) else path)
    rules = [
        (r"(^|/)(node_modules|vendor|third_party)/", "vendored"), (r"(^|/)(dist|build|out|coverage)/", "build_output"), (r"\.(min|bundle)\.js$|\.generated\.|(^|/)generated/", "generated"),
        (r"(^|/)(__tests__|tests?|spec)/|\.(test|spec)\.[a-z]+$|(^|/)test_[^/]*\.py$", "test"), (r"(^|/)(fixtures?|__mocks__|mocks?)/", "fixture"), (r"(^|/)(benchmarks?|bench)/", "benchmark"),
        (r"(^|/)docs?/|\.(md|rst|txt)$", "docs"), (r"(^|/)(scripts?|tools?)/", "tooling"),
    ]
    out = F.lit("production")
    for pattern, name in reversed(rules):
        out = F.when(p.rlike(pattern), name).otherwise(out)
    return out


def sensitive(path: Column | str) -> Column:
    """Why a file must not be read: env_file, private_key, credential_store, sensitive_directory, secret_config; null if nothing speaks against it."""
    p = F.lower(F.col(path) if isinstance(path, str) else path)
    name, ext = basename(p), extension(p)
    source = ext.isin(*KINDS_OF_FILE["code"])
    return (
        F.when(name.rlike(r"^\.env(\.|$)") & ~name.rlike(r"\.(example|sample|template)$"), "env_file")
        .when(ext.isin("pem", "key", "p12", "pfx", "jks") | name.rlike(r"^id_(rsa|dsa|ecdsa|ed25519)$"), "private_key")
        .when(name.isin(".netrc", ".npmrc", ".pypirc", ".htpasswd", "credentials.json"), "credential_store")
        .when(source, None)
        .when(F.arrays_overlap(F.split(p, "/"), F.array(*map(F.lit, SENSITIVE_DIRECTORIES))), "sensitive_directory")
        .when(name.rlike(r"(secret|credential|password)s?") & ext.isin("json", "yaml", "yml", "toml", "ini", "conf", "env"), "secret_config")
    )


def glob_regex(pattern: str) -> str:
    """A path pattern (``*``, ``**``, ``?``, trailing and leading slashes) as an anchored regular expression."""
    body = pattern.strip("/")
    out = ""
    for part in re.split(r"(\*\*/|\*\*|\*|\?)", body):
        out += {"**/": "(.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    lead = "^" if pattern.startswith("/") or "/" in body else "(^|.*/)"
    return f"{lead}{out}(/.*)?$"


def ignored(files: DataFrame, patterns: list[str]) -> DataFrame:
    """``files(path, ...)`` with ``ignored``: the last pattern that fits decides, ``!`` takes a file back in."""
    out = F.col("path").rlike(ALWAYS_IGNORED)
    for p in patterns:
        if p.strip() and not p.startswith("#"):
            out = F.when(F.col("path").rlike(glob_regex(p.strip().lstrip("!"))), not p.strip().startswith("!")).otherwise(out)
    return files.withColumn("ignored", out)


def corpus_verdict(files: DataFrame) -> DataFrame:
    """One row: files, words, whether a graph pays, and a warning for very large corpora."""
    total = files.agg(F.count("*").alias("files"), F.coalesce(F.sum(words_in("text")), F.lit(0)).alias("words"))
    warning = F.when(F.col("words") >= WORDS_TOO_MANY, "too many words").when(F.col("files") >= FILES_TOO_MANY, "too many files").when(F.col("words") < WORDS_WORTH_A_GRAPH, "fits a context window")
    return total.select("files", "words", (F.col("words") >= WORDS_WORTH_A_GRAPH).alias("needs_graph"), warning.alias("warning"))


def manifest_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(path, status)`` of two manifests ``(path, fingerprint)``: new, changed, unchanged or deleted."""
    a, b = before.select("path", F.col("fingerprint").alias("f1")), after.select("path", F.col("fingerprint").alias("f2"))
    status = F.when(F.col("f1").isNull(), "new").when(F.col("f2").isNull(), "deleted").when(F.col("f1") == F.col("f2"), "unchanged").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def freshness(selected: DataFrame, current: DataFrame) -> DataFrame:
    """One row: stale if a file is missing, partially_stale or possibly_stale if one changed, fresh otherwise.

    ``selected(path, fingerprint, chosen)``: what the graph was built from, and whether the answer uses it. A change
    counts as partial where nothing was chosen or all that was chosen is as it was.
    """
    joined = selected.join(current.select("path", F.col("fingerprint").alias("now")), "path", "left")
    missing, changed = F.col("now").isNull(), F.col("now").isNotNull() & (F.col("now") != F.col("fingerprint"))
    counts = joined.agg(F.count_if(missing).alias("missing"), F.count_if(changed).alias("changed"), F.count_if(changed & F.col("chosen")).alias("chosen_changed"))
    status = F.when(F.col("missing") > 0, "stale").when((F.col("changed") > 0) & (F.col("chosen_changed") == 0), "partially_stale").when(F.col("changed") > 0, "possibly_stale").otherwise("fresh")
    return counts.select("missing", "changed", status.alias("status"))


def cache_misses(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose content isn't in the cache, by hash."""
    return files.withColumn("hash", F.sha2("content", 256)).join(cache.select("hash"), "hash", "left_anti")


def workspace_fingerprint(files: DataFrame) -> DataFrame:
    """One hash for all ``files(path, hash)``: the hash of the sum of their row hashes, which needs no order and no collection."""
    rows = files.select(F.conv(F.left(F.sha2(F.concat_ws("\x00", "path", "hash"), 256), F.lit(15)), 16, 10).cast("decimal(38,0)").alias("h"))
    return rows.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.coalesce(F.sum("h"), F.lit(0)).cast("string")), 256).alias("fingerprint"))


def outcomes(rows: DataFrame) -> DataFrame:
    """``rows(path, status)`` -> one row: counts by status and the state of the whole."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    counts = rows.agg(*(n(s) for s in ("indexed", "warning", "skipped", "unsupported", "failed")))
    state = F.when((F.col("indexed") + F.col("warning") == 0) & (F.col("failed") + F.col("unsupported") > 0), "failed").when(F.col("warning") + F.col("skipped") + F.col("unsupported") + F.col("failed") > 0, "partial").otherwise("complete")
    return counts.withColumn("state", state)


def ingest_kind(url: Column | str) -> Column:
    """What a URL points to, by its host and path."""
    u = F.col(url) if isinstance(url, str) else url
    host = F.lower(F.coalesce(F.try_parse_url(u, F.lit("HOST")), F.lit("")))
    path = F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit(""))
    at = lambda *names: host.rlike("(^|\\.)(" + "|".join(n.replace(".", "\\.") for n in names) + ")$")
    return F.when(at("twitter.com", "x.com"), "tweet").when(at("reddit.com"), "reddit").when(at("news.ycombinator.com"), "hackernews").when(at("arxiv.org"), "arxiv").when(at("youtube.com", "youtu.be"), "youtube").when(at("github.com"), "github").when(F.lower(path).endswith(".pdf"), "pdf").when(extension(path).isin(*KINDS_OF_FILE["image"]), "image").otherwise("webpage")
