"""Incremental rebuilds: a stream of changed files, and session state kept across batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from quillgraph.plans.staging import staged
from quillgraph.sources.files import manifest_diff

FASTEST, SLOWEST = 1, 300


def next_interval(current: int, changed: bool, fastest: int = FASTEST, slowest: int = SLOWEST) -> int:
    """Seconds until the next look: the shortest after a change, doubling in silence."""
    return fastest if changed else min(slowest, current * 2)


def watch_files(spark: SparkSession, folder: str, checkpoint: str, rebuild: Callable[[DataFrame, int], None], available_now: bool = True, pattern: str = "*"):
    """A query that hands each micro-batch of new files to ``rebuild(files, batch)``.

    Files arrive as ``(path, modificationTime, length, content)``. The checkpoint allows one writer at a time and
    makes a batch that failed come again.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    writer = files.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def rebuilt(old: DataFrame, fresh: DataFrame, before: DataFrame, after: DataFrame, key: str = "source_file") -> DataFrame:
    """Rows of unchanged files from ``old`` and rows of new and changed files from ``fresh``; the rest is gone."""
    status = staged(manifest_diff(before, after))
    touched = status.where("status <> 'unchanged'").select(F.col("path").alias(key))
    renewed = status.where("status in ('new', 'changed')").select(F.col("path").alias(key))
    return old.join(touched, key, "left_anti").unionByName(fresh.join(renewed, key, "left_semi"), allowMissingColumns=True)


SESSION = "session string, ref string, status string"


def session_updates(items: DataFrame) -> DataFrame:
    """A stream ``items(session, ref, hash)`` -> what each session hasn't seen yet or saw differently: added, updated or reused."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = []
        for f in frames:
            for ref, h in zip(f.ref, f.hash, strict=True):
                rows.append((key[0], ref, "added" if ref not in known else "reused" if known[ref] == h else "updated"))
                known[ref] = h
        state.update((list(known), list(known.values())))
        yield pd.DataFrame(rows, columns=["session", "ref", "status"])

    return items.groupBy("session").applyInPandasWithState(step, SESSION, "refs array<string>, hashes array<string>", "append", GroupStateTimeout.NoTimeout)
