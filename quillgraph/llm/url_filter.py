"""URL rules as nested intervals of canonical keys, matched by a sorted sweep in DataFrame operations only.

A rule (host, path) becomes the key of its reversed host labels and its path, so that the URLs under it form one
interval of keys. A URL has one key for each suffix of its host. Rules' starts and ends and the URLs' keys are
sorted together; the running count of open intervals is the depth of the stack of active rules, and the last rule
that started at the current depth is the top of the stack: the longest rule that fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .links import broadcast_if_few
from .scratch import materialize

KEYS_PER_GROUP = 20_000  # keys that one sorted sweep holds, about; a host with more of them is dealt over several

RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without it."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Reversed labels, a separator below every character of a path, and the path."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("\u0001"), path)


def suffixes(host: Column) -> Column:
    """The host and all its parents, down to the last label."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def matched(urls: DataFrame, rules: DataFrame, keys_per_group: int) -> DataFrame:
    """``urls(host, path)``, ``rules(host, path, rule, verdict)`` -> ``(host, path, rule, verdict)`` of URLs with a rule.

    Only a host of more than ``keys_per_group`` URLs is dealt over several sweeps, each of which gets that host's rules.
    """
    rules = rules.select("host", "path", "rule", "verdict").groupBy("host", "path").agg(F.min_by("rule", F.struct("rule", "verdict")).alias("rule"), F.min_by("verdict", F.struct("rule", "verdict")).alias("verdict"))
    probes = urls.select(F.col("host").alias("full"), "path", F.explode(suffixes(F.col("host"))).alias("host"))
    probes = probes.join(rules.select("host").distinct(), "host", "left_semi")
    dealt = probes.groupBy("host").agg(F.ceil(F.count("*") / keys_per_group).cast("int").alias("groups"))
    dealt = broadcast_if_few(materialize(dealt))  # a row for each host that has rules and URLs
    probes = probes.join(dealt, "host")
    deal = F.pmod(F.xxhash64("full", "path"), F.col("groups")).cast("int")
    keys = probes.select("host", deal.alias("group"), canonical(F.col("host"), F.col("path")).alias("key"), F.lit(1).alias("kind"), F.lit(0).alias("step"), "full", "path", F.lit(None).cast("struct<rule:string,verdict:string,size:int>").alias("r"))
    own = F.struct("rule", "verdict", (F.length("host") + F.length("path")).alias("size"))
    events = rules.join(dealt, "host").select("host", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), canonical(F.col("host"), F.col("path")).alias("key"), own.alias("r"))
    none = F.lit(None).cast("string")
    starts = events.select("host", "group", "key", F.lit(0).alias("kind"), F.lit(1).alias("step"), none.alias("full"), none.alias("path"), "r")
    ends = events.select("host", "group", F.concat("key", F.unhex(F.lit("FF")).cast("string")).alias("key"), F.lit(2).alias("kind"), F.lit(-1).alias("step"), none.alias("full"), none.alias("path"), "r")
    swept = keys.unionByName(starts).unionByName(ends)
    order = [F.col("key"), F.col("kind")]
    depth = F.sum("step").over(Window.partitionBy("host", "group").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    swept = swept.withColumn("depth", depth)
    top = F.last(F.when(F.col("kind") == 0, F.col("r")), True).over(Window.partitionBy("host", "group", "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    fits = swept.withColumn("top", top).where("kind = 1 and depth > 0")
    longest = fits.groupBy("full", "path").agg(F.max(F.struct("top.size", "top.rule", "top.verdict")).alias("t"))
    return longest.select(F.col("full").alias("host"), "path", "t.rule", "t.verdict")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", keys_per_group: int = KEYS_PER_GROUP) -> DataFrame:
    """``pages(page_id, url, ...)`` -> ``(page_id, host, path, rule, verdict)``, one row per input row.

    A rule fits its host and every subdomain if the path starts with the rule's path; the longest host and path win.
    A URL without a rule, a null URL and one without ``://`` get a null rule and the ``default`` verdict. Repeated
    rows and null page_ids are each judged. Rules repeated for one host and path count as the least of them.
    Other columns are ignored.
    """
    pages = pages.select("page_id", host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    urls = pages.where("host <> ''").groupBy("host", "path").agg(F.lit(1).alias("_one")).drop("_one")
    found = matched(urls, rules, keys_per_group)
    out = pages.join(found, ["host", "path"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL of the whole pages table under five rules."""
    rules = spark.createDataFrame([(h, p, h + p, v) for v, h, p in RULES], "host string, path string, rule string, verdict string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


ORACLE_SQL = f"""
with rules(verdict, h, p) as (values {', '.join(map(str, RULES))}),
u as (select row_number() over () as id, page_id, coalesce(lower(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1)), '') as host,
             coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path from pages),
m as (select u.id, r.*, row_number() over (partition by u.id order by length(h || p) desc) as n
      from u join rules r on (u.host = r.h or ends_with(u.host, '.' || r.h)) and starts_with(u.path, r.p))
select page_id, host, path, h || p as rule, coalesce(verdict, 'allow') as verdict from u left join m on u.id = m.id and m.n = 1"""
