"""Secret scanning over a trigram inverted index, in DataFrame operations only.

The trigrams that the rules' Boolean queries name form the index's vocabulary. Postings (trigram, document) are
intersected per document as bit sets, which gives each rule its candidate documents; the rule's regular
expression then runs on candidates only. A rule without mandatory trigrams scans every document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .trigrams import Query, trigram_query


@dataclass(frozen=True)
class Rule:
    """A kind of secret; a match counts if ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # the runs of hexadecimal digits, short of those under 24
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("source_host", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
RULES = BASE_RULES + MORE_RULES

SPANS = "array<struct<start:long,rank:int,kind:string,end:long>>"


def vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    """All trigrams that some rule's query names."""
    return sorted({g for r in rules for option in trigram_query(r.pattern) or () for g in option})


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index ``(gram, word, bit, doc_id)`` over lower-cased texts; word and bit number the trigrams."""
    entries = [F.struct(F.lit(g).alias("gram"), F.lit(i // 63).alias("word"), F.lit(1 << i % 63).cast("long").alias("bit")) for i, g in enumerate(grams)]
    folded = docs.select("doc_id", F.lower("text").alias("folded"))
    held = F.filter(F.array(*entries), lambda e: F.contains(F.col("folded"), e["gram"]))
    return folded.select("doc_id", F.explode(held).alias("e")).select("doc_id", "e.*")


def intersected(index: DataFrame, grams: list[str]) -> DataFrame:
    """``(doc_id, m0, m1, ...)``: the postings of each document as 63-bit sets, combined map-side first."""
    sets = [F.bit_or(F.when(F.col("word") == w, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in range(-(-len(grams) // 63))]
    return index.groupBy("doc_id").agg(*sets)


def candidate(query: Query | None, grams: list[str]) -> Column:
    """Whether a document's sets meet a rule's query."""
    if query is None:
        return F.lit(True)
    options = []
    for option in query:
        need: dict[int, int] = {}
        for g in option:
            w, b = divmod(grams.index(g), 63)
            need[w] = need.get(w, 0) | 1 << b
        options.append(reduce(Column.__and__, [F.coalesce(F.col(f"m{w}"), F.lit(0)).bitwiseAND(F.lit(n)) == n for w, n in need.items()]))
    return reduce(Column.__or__, options)


def spans(rule: Rule, rank: int) -> Column:
    """Where ``rule`` matches ``text``, leftmost first and without overlap, in code points.

    The pieces between the matches and the matches themselves alternate, so running lengths give the places.
    """
    part = F.arrays_zip(
        F.transform(F.split("text", rule.pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)), F.length).alias("size"),
        F.transform(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)), F.length).alias("part"),
    )
    none = F.array().cast(SPANS)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["part"] >= rule.least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    folded = F.aggregate(part, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.col("text").rlike(rule.pattern), folded).otherwise(none)


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, spans)``: a row per input row, its spans by start, then rule order.

    ``spans`` holds structs of start, rank (the rule's place), kind and end, in code points, end exclusive. A null
    text counts as empty. Rows that repeat a doc_id, or have none, are each scanned; their postings are pooled,
    which only adds candidates. Texts of any length are scanned whole. Other columns are ignored.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grams = vocabulary(rules)
    if grams:
        index = intersected(postings(docs, grams), grams).withColumnRenamed("doc_id", "_id")
        docs = docs.join(index, docs.doc_id.eqNullSafe(index._id), "left")
    found = [F.when(candidate(trigram_query(r.pattern), grams), spans(r, i)).otherwise(F.array().cast(SPANS)) for i, r in enumerate(rules)]
    return docs.select("doc_id", F.array_sort(F.concat(*found)).alias("spans"))


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def digest(spans_column: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans_column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text of the whole documents table."""
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(F.filter("spans", of_kind(r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES]
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    return found.select("doc_id", *counts, F.sha2(digest(base).cast("binary"), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def oracle_sql() -> str:
    """The same query in DuckDB's SQL."""
    kinds = []
    for i, r in enumerate(RULES):
        flags, pattern = ("i", r.pattern[4:]) if r.pattern.startswith("(?i)") else ("", r.pattern)
        p = pattern.replace("'", "''")
        p = f"(?{flags}){p}" if flags else p
        kinds.append(f"""
        select d.id, {i} as rank, '{r.kind}' as kind, u.k,
               list_sum(list_transform(d.g{i}[1:u.k], lambda x: length(x))) + coalesce(list_sum(list_transform(d.m{i}[1:u.k - 1], lambda x: length(x))), 0) as s,
               length(d.m{i}[u.k]) as n, length(d.p{i}[u.k]) as part, {r.least} as least
        from d, unnest(generate_series(1, len(d.m{i}))) as u(k)""")
    cols = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        cols.append(f"string_split_regex(text, '{p}') as g{i}, regexp_extract_all(text, '{p}') as m{i}, regexp_extract_all(text, '{p}', {r.group}) as p{i}")
    base = len(BASE_RULES)
    return f"""
    with t as (select row_number() over () as id, doc_id, coalesce(text, '') as text from documents),
    d as (select id, {', '.join(cols)} from t),
    f as (select * from ({' union all '.join(kinds)}) where part >= least),
    g as (select id, {', '.join(f"count(*) filter (where rank = {i}) as n_{r.kind}" for i, r in enumerate(BASE_RULES))},
                 string_agg(kind || ':' || cast(s as bigint) || ':' || cast(s + n as bigint), ',' order by s, rank) filter (where rank < {base}) as b,
                 string_agg(kind || ':' || cast(s as bigint) || ':' || cast(s + n as bigint), ',' order by s, rank) as a
          from f group by id)
    select t.doc_id, {', '.join(f"cast(coalesce(n_{r.kind}, 0) as bigint) as n_{r.kind}" for r in BASE_RULES)},
           sha256(coalesce(b, '')) as base_sha256, coalesce(a, '') as spans
    from t left join g on t.id = g.id"""
