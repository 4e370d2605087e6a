"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own characters say so, which makes equal texts equal lists of chunks. Chunks are deduplicated
on their full characters to verified identifiers: a chunk's 64-bit hash, and a rank that tells different chunks of one
hash apart. Documents are then compared by their ordered lists of identifiers, so a text moves once, as chunks that
each task has already deduplicated, and never again, however many copies it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: A chunk ends after a sentence or line end, from 1,024 characters on, at 8,192 at the latest.
CHUNK = r"(?s).{1023,8191}?[.!?\n](?=\s)|.{1,8192}"


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def group_equal(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, keep_id, group_size long, kept boolean, text_sha256 string for every row.

    Texts are equal when identical. Of equal texts the row with the largest key stays; group_size counts rows.
    Null text counts as empty, and all empty texts are equal. Null keys lose against any other; in a group with null
    keys only, all stay. Rows repeated with one key and text all count and are all marked alike. An empty table gives
    no rows; columns not named, clashing names included, are not read.
    """
    docs = df.select(F.col(key).alias("__key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))

    # distinct chunks: the grouping compares all characters, after each task has merged its own repetitions
    chunks = docs.select(F.explode(_chunks(F.col("__text"))).alias("chunk")).withColumn("hash", F.xxhash64("chunk"))
    distinct = chunks.groupBy("hash", "chunk").agg(F.count("*").alias("copies"))
    # hashes that stand for more than one chunk: next to none, and a rank then sets their chunks apart
    clashes = stored(distinct.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "clashes")

    recipes = docs.select(
        "__key",
        F.sha2("__text", 256).alias("text_sha256"),
        F.octet_length("__text").alias("bytes"),
        F.transform(_chunks(F.col("__text")), lambda c: F.struct(F.xxhash64(c).alias("hash"), c.alias("chunk"))).alias("parts"),
    )
    if clashes.isEmpty():
        named = recipes.withColumn("recipe", F.transform("parts", lambda p: F.struct(p["hash"].alias("hash"), F.lit(0).alias("rank"))))
    else:
        ranks = chunks.join(clashes, "hash", "left_semi").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("hash").orderBy("chunk")))
        at = recipes.withColumn("row", F.monotonically_increasing_id())
        exploded = at.select("row", F.posexplode("parts").alias("pos", "part")).select("row", "pos", F.col("part.hash").alias("hash"), F.col("part.chunk").alias("chunk"))
        ranked = exploded.join(ranks, ["hash", "chunk"], "inner").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("pos", "rank"))).alias("ranks"))
        rank_of = lambda p, i: F.struct(p["hash"].alias("hash"), F.coalesce(F.try_element_at(F.col("ranks"), i), F.lit(0)).alias("rank"))
        named = at.join(ranked, "row", "left").withColumn("recipe", F.transform("parts", rank_of))
    named = stored(named.select("__key", "text_sha256", "bytes", "recipe"), "recipes")

    groups = named.groupBy("bytes", "recipe").agg(F.max("__key").alias("keep_id"), F.count("*").alias("group_size"))
    found = named.join(groups, ["bytes", "recipe"])  # a hot group's rows are split among tasks as a skewed join
    return found.select(
        F.col("__key").alias(key),
        "keep_id",
        "group_size",
        F.col("__key").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
