"""Event feeds: the same functions serve batch tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprint(*columns: str):
    return F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in columns)), 256)


def latest_events(df: DataFrame, columns: list[str], at: str) -> DataFrame:
    """Each event once by fingerprint, with when it was first and last seen and how often."""
    return df.withColumn("fingerprint", fingerprint(*columns)).groupBy("fingerprint", *columns).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("seen"))


def new_events(stream: DataFrame, columns: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """The first arrival of each event of a stream, within the watermark."""
    return stream.withColumn("fingerprint", fingerprint(*columns)).withWatermark(at, late).dropDuplicatesWithinWatermark(["fingerprint"])


def rates(df: DataFrame, by: list[str], at: str, length: str = "1 minute", limit: int = 120, late: str | None = None) -> DataFrame:
    """Requests in tumbling windows by key, and whether they exceed the limit; `late` is the watermark of a stream."""
    rows = df.withWatermark(at, late) if late else df
    counted = rows.groupBy(F.window(at, length).alias("w"), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), *by, "n", (F.col("n") > limit).alias("over_limit"))
