"""Optional streaming forms of the batch operators: windows with late data, sessions.

They take any streaming or static DataFrame, so that the same plan runs on both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_counts(df: DataFrame, at: str, keys: list[str], value: Column, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, keys, n, total; rows later than `late` behind the newest are left out
    of a stream, whose state is bounded thereby."""
    d = df.withColumn("__t", F.col(at).cast("timestamp"))
    if df.isStreaming:
        d = d.withWatermark("__t", late)
    g = d.groupBy(F.window("__t", every), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def sessions(df: DataFrame, at: str, key: str, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """key, session_start, session_end, n: rows of a key that follow each other within the
    gap, such as the matches of a series."""
    d = df.withColumn("__t", F.col(at).cast("timestamp")).where(F.col(key).isNotNull())
    if df.isStreaming:
        d = d.withWatermark("__t", late)
    g = d.groupBy(F.session_window("__t", gap), key).agg(F.count("*").alias("n"), F.max("__t").alias("last"))
    return g.select(key, F.col("session_window.start").alias("session_start"), F.col("last").alias("session_end"), "n")
