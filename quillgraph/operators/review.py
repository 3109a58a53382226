"""What a change touches: changed lines, the nodes there, what depends on them, and how risky that is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import basename, line_range

MOST_SEEDS = 12


def overlapping(changed: DataFrame, symbols: DataFrame) -> DataFrame:
    """``changed(file, first, last)`` and ``symbols(file, id, first, last)`` whose line ranges meet, within each file."""
    a = changed.select("file", F.col("first").alias("c_first"), F.col("last").alias("c_last"))
    return symbols.join(a, "file").where("first <= c_last and c_first <= last").select("file", "id", "first", "last", "c_first", "c_last")


def review_seeds(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """``(id, file, match)``: nodes on changed lines; for a changed file without such, its first nodes."""
    span = line_range("source_location")
    placed = nodes.withColumn("r", span).select("id", F.col("source_file").alias("file"), F.col("r.first").alias("first"), F.col("r.last").alias("last"), "ord").join(changed.select("file").distinct(), "file", "left_semi")
    lines = overlapping(changed, placed.where("first is not null")).select("id", "file").distinct().withColumn("match", F.lit("line"))
    rest = placed.join(lines.select("file").distinct(), "file", "left_anti").withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy("ord", "id"))).where(F.col("r") <= MOST_SEEDS)
    return lines.unionByName(rest.select("id", "file", F.lit("file").alias("match")))


def seed_weight(relation: Column) -> Column:
    return F.when(relation == "calls", 1.5).when(relation.isin("depends_on", "imports_from"), 1.25).when(relation.isin("uses", "references"), 1.0).otherwise(0.75)


def review_candidates(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(id, value)``: 10 for a seed, 6 plus the relation's weight for what points to it, 5 plus it for what it points to."""
    s = seeds.select("id").distinct()
    back = edges.join(s.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"), (seed_weight(F.col("relation")) + 6).alias("value"))
    ahead = edges.join(s.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"), (seed_weight(F.col("relation")) + 5).alias("value"))
    return s.select("id", F.lit(10.0).alias("value")).union(back).union(ahead).groupBy("id").agg(F.max("value").alias("value"))


def test_paths(files: DataFrame, listing: DataFrame) -> DataFrame:
    """``files(path)`` -> ``(path, test)``: tests that exist in ``listing(path)`` under one of the twelve usual names."""
    path = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    name, folder = basename(path), F.regexp_replace(path, "/?[^/]*$", "")
    ext = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    base = F.regexp_replace(name, r"\.[^.]*$", "")
    under = lambda d, f: F.when(d == "", f).otherwise(F.concat(d, F.lit("/"), f))
    dotted = [F.concat(base, F.lit(x), ext) for x in (".test", ".spec")]
    python = [F.concat(F.lit("test_"), base, F.lit(".py")), F.concat(base, F.lit("_test.py"))]
    places = [under(folder, f) for f in dotted] + [under(under(folder, F.lit("__tests__")), f) for f in dotted] + [under(F.lit(d), f) for d in ("tests", "test") for f in dotted] + [under(folder, f) for f in python] + [under(F.lit("tests"), f) for f in python]
    options = files.select("path", F.explode(F.array_distinct(F.array(*places))).alias("test"))
    return options.join(listing.select(F.col("path").alias("test")).distinct(), "test", "left_semi").select("path", "test")


def risk_score(affected: Column, communities: Column, hotspots: Column, dependents: Column) -> Column:
    return affected * 2 + communities + hotspots * 6 + dependents * 2


def risk_severity(score: Column, communities: Column) -> Column:
    return F.when((score >= 6) | (communities >= 2), "high").when(score >= 3, "medium").otherwise("low")


def risk_map(candidates: DataFrame) -> DataFrame:
    """``candidates(label, affected, communities, hotspots, dependents)`` by risk, the highest first."""
    score = risk_score(F.col("affected"), F.col("communities"), F.col("hotspots"), F.col("dependents"))
    scored = candidates.withColumn("score", score).withColumn("severity", risk_severity(score, F.col("communities")))
    return scored.orderBy(F.desc("score"), F.desc("hotspots"), F.desc("dependents"), F.collate("label", "UNICODE"))


def checklist(seeds: DataFrame, tests: DataFrame, risks: DataFrame) -> DataFrame:
    """``(place, step)``: what to edit, what to run, what to look at."""
    parts = [
        seeds.select(F.lit(0).alias("place"), F.concat(F.lit("edit "), "file").alias("step")).distinct(),
        tests.select(F.lit(1).alias("place"), F.concat(F.lit("run "), "test").alias("step")).distinct(),
        risks.where("severity = 'high'").select(F.lit(2).alias("place"), F.concat(F.lit("review "), "label").alias("step")).distinct(),
    ]
    return reduce(DataFrame.unionByName, parts).orderBy("place", "step")
