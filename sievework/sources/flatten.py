"""Flattening of landed JSON, harvest of page links, integrity of stored bytes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FACTS = "map<string,map<string,struct<label:string,units:map<string,array<struct<start:date,end:date,val:double,accn:string,fy:int,fp:string,form:string,filed:date>>>>>>"


def submissions(df: DataFrame, key: str, recent: str, fields: Sequence[str]) -> DataFrame:
    """One row for each place of a struct of parallel arrays, in their order; shorter arrays give nulls."""
    zipped = F.arrays_zip(*(F.col(f"{recent}.{f}").alias(f) for f in fields))
    rows = df.select(key, F.posexplode(zipped).alias("position", "z"))
    return rows.select(key, "position", *(F.col(f"z.{f}").alias(f) for f in fields))


def company_facts(df: DataFrame, key: str, payload: str, concepts: DataFrame, forms: Sequence[str], unit: str = "USD") -> DataFrame:
    """Facts of listed concepts (taxonomy, concept, metric, priority), the latest filed of each metric, concept, filing and span."""
    facts = df.select(key, F.explode(F.from_json(payload, FACTS)).alias("taxonomy", "by_concept")).select(key, "taxonomy", F.explode("by_concept").alias("concept", "c"))
    named = facts.join(F.broadcast(concepts), ["taxonomy", "concept"])  # a rule table of the caller
    rows = named.select(key, "taxonomy", "concept", "metric", "priority", F.explode(F.try_element_at(F.col("c.units"), F.lit(unit))).alias("f")).select("*", "f.*").drop("f")
    kept = rows.filter(F.col("form").isin(*forms) & F.col("val").isNotNull())
    last = Window.partitionBy(key, "metric", "concept", "accn", "start", "end").orderBy(F.desc("filed"), F.desc("val"))
    return kept.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n").withColumn("value", F.col("val") / 1e6)


def links(df: DataFrame, key: str, html: str) -> DataFrame:
    """key, position, href, title of every anchor of a page, tags inside titles left out."""
    found = F.regexp_extract_all(html, F.lit(r'(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>'), F.lit(0))
    rows = df.select(key, F.posexplode(found).alias("position", "a"))
    return rows.select(key, "position", F.regexp_extract("a", r'(?i)href="([^"]*)"', 1).alias("href"), F.trim(F.regexp_replace("a", r"(?s)<[^>]*>", "")).alias("title"))


def archive(df: DataFrame, key: str, content: str) -> DataFrame:
    """content_hash, storage_key, key of the first row of each content, its size: first write wins."""
    digest = F.sha2(F.col(content), 256)
    rows = df.select(key, digest.alias("content_hash"), F.octet_length(content).cast("long").alias("size"))
    path = F.concat_ws("/", F.lit("sha256"), F.substring("content_hash", 1, 2), F.substring("content_hash", 3, 2), F.col("content_hash"))
    return rows.groupBy("content_hash", "size").agg(F.min(key).alias(key), F.count("*").alias("writes")).withColumn("storage_key", path)
