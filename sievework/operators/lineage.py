"""Lineage: nodes of several kinds, edges between known nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def node(df: DataFrame, kind: str, key: str, label: str) -> DataFrame:
    return df.select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), F.col(label).cast("string").alias("label"))


def edge(df: DataFrame, source: tuple[str, str], target: tuple[str, str], relation: str) -> DataFrame:
    name = lambda end: F.concat(F.lit(f"{end[0]}:"), F.col(end[1]).cast("string"))
    return df.select(name(source).alias("source"), name(target).alias("target"), F.lit(relation).alias("relation"))


def nodes(parts: list[DataFrame]) -> DataFrame:
    """Each node once; of several labels the smallest."""
    return reduce(DataFrame.unionByName, parts).groupBy("id", "kind").agg(F.min("label").alias("label"))


def edges(parts: list[DataFrame], known: DataFrame) -> DataFrame:
    """Distinct edges whose ends are both known."""
    ids = known.select("id")
    found = reduce(DataFrame.unionByName, parts).distinct()
    return found.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target", "relation")
