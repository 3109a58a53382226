"""Inputs with every awkward case, and union-find."""

from __future__ import annotations

from pyspark.sql import functions as F

WORDS = "time house river stone light paper green seven music table window garden letter number silver winter summer basket market doctor engine forest castle bridge planet orange yellow".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def docs(spark, rows, *extra):
    """``rows``: (doc_id, text); columns that clash with results are added."""
    df = spark.createDataFrame(list(rows), "doc_id long, text string")
    for name in ("kept", "component_id", "n_shingles", "h1", "line", "spans", "at", "id", "score", "length", *extra):
        df = df.withColumn(name, F.lit("clash"))
    return df


class Groups:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
