"""Periods, as-of joins, revisions, conflicts and running scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_interval(events: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """Events joined with the intervals of their key that hold them; a null end is open."""
    i = intervals.alias("i")
    test = (F.col(f"e.{key}") == F.col(f"i.{key}")) & (F.col(f"e.{at}") >= F.col(f"i.{start}")) & (F.col(f"e.{at}") <= F.coalesce(f"i.{end}", F.lit("9999-12-31").cast("date")))
    found = events.alias("e").join(i, test, how)
    return found if how == "left_anti" else found.select("e.*", *(F.col(f"i.{c}") for c in intervals.columns if c != key))


def nearest(rows: DataFrame, anchors: DataFrame, key: str, at: str, anchor_at: str, anchor_id: str, within: int, row_id: str) -> DataFrame:
    """Each row with the anchor of its key that is nearest in days, at most `within`; ties to the smaller anchor id.

    Both sides are dealt by key and a stretch of days, so that the day range never meets a whole key at once.
    """
    stretch = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / F.lit(within + 1))
    left = rows.select(key, row_id, at, F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: stretch(F.col(at)) + d)).alias("__s"))
    right = anchors.select(key, F.col(anchor_at), F.col(anchor_id), stretch(F.col(anchor_at)).alias("__s"))
    days = F.abs(F.datediff(F.col(at), F.col(anchor_at)))
    near = left.join(right, [key, "__s"]).withColumn("__days", days).filter(F.col("__days") <= within)
    best = near.groupBy(row_id).agg(F.min(F.struct("__days", anchor_id)).alias("b"))
    return rows.join(best, row_id, "left").select(row_id, F.col(f"b.{anchor_id}").alias("anchor_id"), F.col("b.__days").alias("days"))


#: Days of a stretch, and steps or dates that are folded at once.
STRETCH, CHUNK = 64, 512


def as_of(rows: DataFrame, facts: DataFrame, key: str, at: str, fact_at: str, fact_order: str, values: list[str], forward: bool = False, largest: bool = True) -> DataFrame:
    """rows with `values` of the last fact of their key at or before `at` (forward: the first at or after it), else nulls.

    Of facts of one day the largest fact_order counts, or the smallest. Both sides are sorted together, by key and
    stretches of days, and the last value is carried inside a stretch and from stretch to stretch, so no pairs of rows and
    facts arise and a task holds a key's rows of one stretch. Dates; rows with a null date or key meet nothing.
    """
    stretch = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / F.lit(STRETCH))
    fact = F.struct(*values)
    own = rows.select(key, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(facts.schema[fact_order].dataType).alias("__o"), F.lit(None).cast(facts.select(fact.alias("v")).schema["v"].dataType).alias("__v"), F.struct(*rows.columns).alias("__row"))
    given = facts.filter(F.col(fact_at).isNotNull() & F.col(key).isNotNull()).select(key, F.col(fact_at).alias("__t"), F.lit(0).alias("__side"), F.col(fact_order).alias("__o"), fact.alias("__v"), F.lit(None).cast(own.schema["__row"].dataType).alias("__row"))
    both = own.unionByName(given).withColumn("__s", stretch(F.col("__t")))
    time = F.desc if forward else F.asc
    inside = Window.partitionBy(key, "__s").orderBy(time("__t"), "__side", F.asc("__o") if largest else F.desc("__o")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = both.withColumn("__here", F.last("__v", ignorenulls=True).over(inside)).filter("__side = 1").select(key, "__s", "__row", "__here")
    nearer = F.datediff(F.col("__t"), F.lit("1970-01-01"))  # the fact that a later stretch sees
    order = F.struct((-nearer if forward else nearer).alias("t"), F.dense_rank().over(Window.partitionBy(key, "__s", "__t").orderBy(F.asc("__o") if largest else F.desc("__o"))).alias("o"))
    ends = given.withColumn("__s", stretch(F.col("__t"))).withColumn("__order", order).groupBy(key, "__s").agg(F.max_by("__v", "__order").alias("__end"))
    steps = ends.unionByName(here.select(key, "__s").distinct(), allowMissingColumns=True).groupBy(key, "__s").agg(F.max_by("__end", F.col("__end").isNotNull()).alias("__end"))
    before = Window.partitionBy(key).orderBy(time("__s")).rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.withColumn("__carried", F.last("__end", ignorenulls=True).over(before)).select(key, "__s", "__carried")
    met = here.alias("h").join(carried.alias("c"), (F.col(f"h.{key}") == F.col(f"c.{key}")) & (F.col("h.__s") == F.col("c.__s")), "left")
    found = F.coalesce("__here", "__carried")
    return met.select("__row.*", found.alias("__found")).select(*rows.columns, *(F.col(f"__found.{v}").alias(v) for v in values))


def saturating_path(df: DataFrame, key: str, at: str, order: str, delta: str, start: int = 50, low: int = 10, high: int = 90) -> DataFrame:
    """key, at, score, n: a running score held to low..high after each step, as it stands at the end of each date.

    A stretch of steps is x -> min(h, max(l, x + a)), and such functions compose into one of their kind. So up to CHUNK
    steps of a date in order become one function, up to CHUNK of these again, until each date has one; dates are
    composed alike, and a chunk of dates starts from where the chunks before it end. No list is longer than CHUNK but
    that of a key's chunks of dates.
    """
    hold = lambda x, lo, hi: F.greatest(lo, F.least(hi, x))
    unit = F.struct(F.lit(0).cast("long").alias("a"), F.lit(-(10**6)).cast("long").alias("l"), F.lit(10**6).cast("long").alias("h"))

    def then(f: Column, g: Column) -> Column:
        return F.struct((f["a"] + g["a"]).alias("a"), hold(f["l"] + g["a"], g["l"], g["h"]).alias("l"), hold(f["h"] + g["a"], g["l"], g["h"]).alias("h"))

    def composed(rows: DataFrame, by: list[str]) -> DataFrame:
        """by, __g, __k, __i: rows with __g (a function), __k (its steps) and __i (their place, from 0), CHUNK of them as one."""
        chunks = rows.groupBy(*by, F.floor(F.col("__i") / CHUNK).alias("__i")).agg(F.sort_array(F.collect_list(F.struct("__i", "__g"))).alias("__f"), F.sum("__k").alias("__k"))
        return chunks.select(*by, "__i", "__k", F.aggregate("__f", unit, lambda f, x: then(f, x["__g"])).alias("__g"))

    place = F.row_number().over(Window.partitionBy(key, at).orderBy(order, delta)) - 1
    one = F.struct(F.col(delta).cast("long").alias("a"), F.lit(low).cast("long").alias("l"), F.lit(high).cast("long").alias("h"))
    dates = df.select(key, at, one.alias("__g"), F.lit(1).cast("long").alias("__k"), place.cast("long").alias("__i"))
    for _ in range(4):  # 512 ** 4 steps of a key and date
        dates = composed(dates, [key, at])
    dates = dates.drop("__i").withColumn("__i", (F.row_number().over(Window.partitionBy(key).orderBy(at)) - 1).cast("long"))
    dates = dates.withColumn("__c", F.floor(F.col("__i") / CHUNK))
    whole = composed(dates.select(key, "__g", "__k", "__i"), [key])
    ends = whole.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__i", "__g", "__k"))).alias("__f"))
    first = F.struct(F.lit(start).cast("long").alias("x"), F.lit(0).cast("long").alias("n"))
    moved = lambda s, f, k: F.struct(hold(s["x"] + f["a"], f["l"], f["h"]).alias("x"), (s["n"] + k).alias("n"))

    def path(state: Column, steps: Column, inclusive: bool) -> Column:
        """The states after each step, or before it."""
        begun = F.struct(state.alias("s"), F.array().cast("array<struct<x:bigint,n:bigint>>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            after = moved(acc["s"], x["__g"], x["__k"])
            return F.struct(after.alias("s"), F.concat(acc["out"], F.array(after if inclusive else acc["s"])).alias("out"))

        return F.aggregate(steps, begun, step, lambda acc: acc["out"])

    starts = ends.select(key, F.explode(F.arrays_zip(F.transform("__f", lambda x: x["__i"]).alias("__c"), path(first, F.col("__f"), False).alias("s"))).alias("z")).select(key, "z.__c", "z.s")
    lists = dates.groupBy(key, "__c").agg(F.sort_array(F.collect_list(F.struct("__i", F.col(at).alias("at"), "__g", "__k"))).alias("__f"))
    out = lists.join(starts, [key, "__c"]).select(key, F.explode(F.arrays_zip(F.transform("__f", lambda x: x["at"]).alias("at"), path(F.col("s"), F.col("__f"), True).alias("p"))).alias("z"))
    return out.select(key, F.col("z.at").alias(at), F.col("z.p.x").cast("int").alias("score"), F.col("z.p.n").alias("n"))


def revisions(df: DataFrame, key: str, valid_from: str, tie: str, value: str) -> DataFrame:
    """sequence, previous value and kind of each statement of a commitment, in valid time."""
    w = Window.partitionBy(key).orderBy(valid_from, tie)
    before = F.lag(value).over(w)
    kind = F.when(before.isNull(), "initiated").when(F.col(value) > before, "raised").when(F.col(value) < before, "lowered").otherwise("reaffirmed")
    return df.withColumns({"sequence": F.row_number().over(w), "previous_value": before, "kind": kind})


def conflicts(df: DataFrame, by: list[str], value: str, source: str, anchor: Column, tolerance: float = 0.02) -> DataFrame:
    """Groups with an anchoring row, two sources and values further apart than the tolerance of the smallest, 1 at least."""
    grouped = df.groupBy(*by).agg(
        F.max(value).alias("most"), F.min(value).alias("least"), F.min(F.abs(value)).alias("floor"), F.count_distinct(source).alias("sources"), F.bool_or(anchor).alias("anchored"), F.count("*").alias("rows")
    )
    return grouped.filter("anchored AND sources >= 2").filter((F.col("most") - F.col("least")) > F.greatest(F.lit(1.0), F.col("floor")) * tolerance)
