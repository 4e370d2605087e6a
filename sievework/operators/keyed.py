"""Keyed state: overlays, upserts, reconciliation, best rows, pages and facets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Keys that are sent to every task at most (about 24 bytes each there).
SENT = 2_000_000


def kept(wide: DataFrame, narrow: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """wide joined with narrow (how: inner, left_semi or left_anti) before costly work on wide's texts, which are not shuffled while narrow has up to SENT rows."""
    return wide.join(F.broadcast(narrow) if narrow.limit(SENT + 1).count() <= SENT else narrow, key, how)


def overlay(facts: DataFrame, decisions: DataFrame, key: str, column: str, default: str) -> DataFrame:
    """facts with a team's decision for each key in `column`, or the default."""
    own = decisions.select(key, F.col(column).alias("__own"))
    return facts.join(own, key, "left").withColumn(column, F.coalesce("__own", F.lit(default))).drop("__own")


def best_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each group; order must end in a unique key. Tasks leave out rows beyond n before the shuffle."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__rank") <= n)
    return ranked.withColumnRenamed("__rank", rank) if rank else ranked.drop("__rank")


def upsert(old: DataFrame, new: DataFrame, key: str, always: Sequence[str], while_pending: Sequence[str], status: str) -> DataFrame:
    """Rows of both by key: `always` columns come from new, `while_pending` columns only where the old status is pending."""
    o, n = old.alias("o"), new.alias("n")
    found = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    was, now = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    pending = ~was | (F.col(f"o.{status}") == "pending")
    pick = lambda c, test: F.when(now & test, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return found.select(
        F.coalesce(f"n.{key}", f"o.{key}").alias(key),
        *(pick(c, F.lit(True)) for c in always),
        *(pick(c, pending) for c in while_pending),
        F.coalesce(f"o.{status}", F.lit("pending")).alias(status),
    )


def changes(old: DataFrame, new: DataFrame, key: str, content: str, keep: Sequence[str] = ()) -> DataFrame:
    """key, keep, content_hash, action (new, changed, missing, same) of the rows of two snapshots.

    Contents travel as digests; null content counts as empty. `keep` and the digest come from the new row where there is
    one. Keys are unique in each snapshot; a null key meets no other, so its row is new or missing.
    """
    digest = F.sha2(F.coalesce(F.col(content), F.lit("")), 256)
    o, n = (df.select(key, *keep, digest.alias("content_hash"), F.lit(True).alias("here")).alias(a) for df, a in ((old, "o"), (new, "n")))
    found = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    now = F.col("n.here")
    action = F.when(now.isNull(), "missing").when(F.col("o.here").isNull(), "new").when(F.col("o.content_hash") != F.col("n.content_hash"), "changed").otherwise("same")
    pick = lambda c: F.when(now, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return found.select(pick(key), *(pick(c) for c in (*keep, "content_hash")), action.alias("action"))


def missing(old: DataFrame, active: DataFrame, key: str, references: Sequence[DataFrame] = ()) -> DataFrame:
    """Rows no longer produced; `action` is delete, or reject where a reference holds the row."""
    gone = old.join(active.select(key).distinct(), key, "left_anti")
    held = references[0].select(key)
    for more in references[1:]:
        held = held.union(more.select(key))
    mark = held.distinct().withColumn("__held", F.lit(True))
    return gone.join(mark, key, "left").withColumn("action", F.when(F.col("__held"), "reject").otherwise("delete")).drop("__held")


def page(df: DataFrame, size: int, number: str, when: str, key: str, after: tuple | None = None) -> DataFrame:
    """The next page in (number desc, date desc, key desc) after a cursor of those three; one row more tells of a next page."""
    if after:
        n, d, k = (F.lit(v) for v in after)
        df = df.filter((F.col(number) < n) | (F.col(number) == n) & ((F.col(when) < d) | (F.col(when) == d) & (F.col(key) < k)))
    return df.orderBy(F.desc(number), F.desc(when), F.desc(key)).limit(size + 1)


def facets(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts by each column alone and in total, in one pass."""
    sets = [[F.col(c)] for c in columns] + [[]]
    counted = df.groupingSets(sets, *columns).agg(F.count("*").alias("n"), F.grouping_id(*columns).alias("__set"))
    top = (1 << len(columns)) - 1
    name = F.when(F.col("__set") == top, "total")
    value = F.lit("")
    for i, c in enumerate(columns):
        here = F.col("__set") == top ^ (1 << (len(columns) - 1 - i))
        name, value = name.when(here, c), F.when(here, F.col(c).cast("string")).otherwise(value)
    return counted.select(name.alias("facet"), value.alias("value"), "n")
