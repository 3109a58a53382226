"""Time windows over events, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rate_limited(events: DataFrame, key: str, most: int, width: str = "60 seconds") -> DataFrame:
    """``(key, at, n, limited)``: events per key and fixed window, and whether they exceed ``most``."""
    counted = events.groupBy(key, F.window("ts", width).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("at"), "n", (F.col("n") > most).alias("limited"))


def settled(events: DataFrame, key: str, silence: str = "3 seconds") -> DataFrame:
    """``(key, first, last, n)``: bursts of events that end with ``silence``; one rebuild follows each."""
    counted = events.groupBy(key, F.session_window("ts", silence).alias("w")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return counted.select(key, "first", "last", "n")
