"""Pairs of similar token sets by prefix filter, greedy assignment and first-wins removal in rounds of joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import text
from sievework.storage import stored

#: A token is frequent from this share of all tokens on, so at most as many tokens are broadcast.
FREQUENT = 50_000


def _ordered(rows: DataFrame) -> DataFrame:
    """rows with `set`: its tokens, rare ones first, in one order for all; the order of frequent tokens follows their counts."""
    tokens = rows.select(F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
    total = tokens.count()
    frequent = F.broadcast(counts.filter(F.col("n") * FREQUENT >= total))  # counts add up to total: FREQUENT rows at most
    each = rows.select("__id", F.explode("tokens").alias("token")).join(frequent, "token", "left")
    sets = each.groupBy("__id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.xxhash64("token").alias("h"), "token"))).alias("s"))
    return rows.drop("tokens").join(sets.select("__id", F.col("s.token").alias("set")), "__id")


def _least_shared(size: Column, least: float) -> Column:
    return F.ceil(size * least - 1e-9)


def similar_pairs(left: DataFrame, right: DataFrame, by: Sequence[str], key: Sequence[str], tokens: str, least: float) -> DataFrame:
    """by, left_key..., right_key..., similarity: pairs of rows of one `by` whose token sets have a Jaccard similarity of `least` or more.

    Sets share one of their first tokens in an order with rare ones first (the prefix filter), so only such rows meet, by
    `by` and token. Two empty sets are equal; null sets are empty. by and key name a row uniquely; no set holds a token twice.
    """
    columns = [*by, *key]

    def side(df: DataFrame, mark: int) -> DataFrame:
        own = F.coalesce(F.col(tokens), F.array().cast("array<string>"))
        return df.select(*columns, F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(""))).alias("tokens"), F.lit(mark).alias("__side"))

    rows = side(left, 0).unionByName(side(right, 1)).withColumn("__id", F.struct("__side", *columns))
    sets = stored(_ordered(rows), "similar-sets")
    size = F.size("set")
    first = sets.select("__id", "__side", *columns, size.alias("size"), F.explode(F.slice("set", F.lit(1), (size - _least_shared(size, least) + 1).cast("int"))).alias("token"))
    named = lambda side, name: first.filter(F.col("__side") == side).select(*by, "token", F.col("size").alias(f"{name}_size"), F.col("__id").alias(f"{name}_id"))
    near = F.least("left_size", "right_size") >= _least_shared(F.greatest("left_size", "right_size"), least)
    met = named(0, "left").join(named(1, "right"), [*by, "token"]).filter(near).select("left_id", "right_id").distinct()
    whole = lambda name: sets.select(F.col("__id").alias(f"{name}_id"), F.col("set").alias(f"{name}_set"))
    pairs = met.join(whole("left"), "left_id").join(whole("right"), "right_id").withColumn("similarity", text.jaccard(F.col("left_set"), F.col("right_set"), 1.0))
    own = [F.col(f"left_id.{c}").alias(c) for c in by] + [F.col(f"{name}_id.{c}").alias(f"{name}_{c}") for name in ("left", "right") for c in key]
    return pairs.filter(F.col("similarity") >= least).select(*own, "similarity")


def assign(pairs: DataFrame, by: Sequence[str], left: str, right: str, score: str) -> DataFrame:
    """by, left, right, score: what taking the lefts in order, each with its best free right, gives; ties go to the smaller right.

    In each round a pair is final if it is the left's best one and no earlier left may still take the right, so at least
    the first open left of each `by` is settled, and most are in the first rounds. Only pairs move; those that are
    settled leave. by, left and right name a pair uniquely.
    """
    rows, done = stored(pairs.select(*by, left, right, score), "assign-open"), []
    best = F.row_number().over(Window.partitionBy(*by, left).orderBy(F.desc(score), F.asc(right)))
    first = F.min(left).over(Window.partitionBy(*by, right))
    while not rows.isEmpty():
        final = stored(rows.withColumns({"__best": best, "__first": first}).filter(F.col("__best").eqNullSafe(1) & (F.col("__first") == F.col(left))).drop("__best", "__first"), "assign-final")
        done.append(final)
        rest = rows.join(final.select(*by, left), [*by, left], "left_anti").join(final.select(*by, right), [*by, right], "left_anti")
        rows = stored(rest.select(*by, left, right, score), "assign-open")
    out = done[0] if done else rows
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def first_distinct(df: DataFrame, by: Sequence[str], order: str, tokens: str, least: float) -> DataFrame:
    """df with `kept` and `like`: taken in order, a row goes if an earlier kept one of its `by` has a similarity of `least` or more.

    like: the first such kept row's order, null for kept rows. order is unique within by. Rows of equal sets share the
    fate of their first, so copies never pair; of the others a row is kept once all earlier similar ones have gone, in
    rounds. Null sets are empty, and empty sets are equal.
    """
    same = [*by, F.sha2(F.concat_ws("\x01", F.array_sort(F.coalesce(F.col(tokens), F.array().cast("array<string>")))), 256).alias("__set")]
    rows = stored(df.select("*", same[-1]), "first-rows")
    heads = rows.groupBy(*by, "__set").agg(F.min_by(F.struct(F.col(order).alias("head"), F.col(tokens).alias("tokens")), order).alias("f")).select(*by, "__set", "f.*")
    heads = stored(heads, "first-heads")
    links = similar_pairs(heads, heads, by, ["head"], "tokens", least).filter("left_head < right_head").select(*by, F.col("left_head").alias("earlier"), F.col("right_head").alias("later"))
    links = stored(links, "first-links")
    open_, gone = links, []
    while not open_.isEmpty():
        # earlier rows that no open row precedes stay; what is like them goes, with all its links
        free = open_.select(*by, F.col("earlier").alias("head")).distinct().join(open_.select(*by, F.col("later").alias("head")).distinct(), [*by, "head"], "left_anti")
        lost = stored(open_.join(free.withColumnRenamed("head", "earlier"), [*by, "earlier"]).select(*by, F.col("later").alias("head")).distinct(), "first-lost")
        gone.append(lost)
        rest = open_.join(free.withColumnRenamed("head", "earlier"), [*by, "earlier"], "left_anti")
        rest = rest.join(lost.select(*by, F.col("head").alias("earlier")), [*by, "earlier"], "left_anti").join(lost.select(*by, F.col("head").alias("later")), [*by, "later"], "left_anti")
        open_ = stored(rest.select(*by, "earlier", "later"), "first-open")
    fate = heads.drop("tokens").withColumn("like", F.lit(None).cast(heads.schema["head"].dataType))
    if gone:
        lost = gone[0]
        for more in gone[1:]:
            lost = lost.unionByName(more)
        stays = links.join(lost.select(*by, F.col("head").alias("earlier")), [*by, "earlier"], "left_anti")
        fate = heads.drop("tokens").join(stays.groupBy(*by, F.col("later").alias("head")).agg(F.min("earlier").alias("like")), [*by, "head"], "left")
    found = rows.join(fate, [*by, "__set"])
    like = F.coalesce(F.col("like"), F.when(F.col(order) != F.col("head"), F.col("head")))
    return found.select(*df.columns, like.isNull().alias("kept"), like.alias("like"))
