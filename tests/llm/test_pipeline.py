from __future__ import annotations

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F

from quillgraph.llm import quality, queries


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "decontaminate", "packing"]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and len(queries.QUERIES) == 10


def test_every_stage_works_on_what_is_left(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        counts.append(docs.count())
        assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    assert counts[0] > counts[1] and counts == sorted(counts, reverse=True) and counts[-1] > 50
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert corpus_pipeline.run(spark, d).count() == packed.count()


def test_scoring_workers_return_their_memory(monkeypatch):
    texts = pa.RecordBatch.from_arrays([pa.array(["some words here\nand there"] * 20)], ["text"])
    events = []
    monkeypatch.setattr(quality, "give_back", lambda: events.append("back"))
    for out in quality._score(iter([texts, texts]), None, "score"):
        events.append(out.num_rows)
    assert events == [20, 20, "back"]
