"""Metrics in text: amounts of money, power and accelerators with their places, labels, sentences and exclusions.

Places are found by a small walk in Arrow batches, as built-in functions give matches without them; which metric a match
is, whether it counts, and which of several stays, are column expressions and one window for each text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions import rules, text

KINDS = [(kind, re.compile(pattern, re.I | re.A), reach) for kind, pattern, reach in rules.AMOUNTS]
ENDS = (". ", "? ", "! ", "\n")


def sentence_around(value: str, at: int) -> str:
    """The sentence that holds a place: from the last mark before it to the first after it, 360 characters on without one."""
    start = max(value.rfind(mark, 0, max(at - 1, 0) + len(mark)) if at else (0 if value.startswith(mark) else -1) for mark in ENDS)
    stops = [found for mark in ENDS if (found := value.find(mark, at)) >= 0]
    return re.sub(r"\s+", " ", value[0 if start < 0 else start + 2 : min(stops) + 1 if stops else at + 360].strip())


def amounts(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, kind, place, match, amount, scale, nearby, at, context of every amount in a text.

    place: character of the text, from 0; nearby: the text around, where the match starts at `at`; context: its sentence.
    Null texts have none; repeated rows repeat theirs; key names a text.
    """
    fields = (("kind", "string"), ("place", "int"), ("match", "string"), ("amount", "string"), ("scale", "string"), ("nearby", "string"), ("at", "int"), ("context", "string"))
    schema = T.StructType([df.schema[key], *(T.StructField(n, T.IntegerType() if t == "int" else T.StringType()) for n, t in fields)])

    def found(value: str) -> Iterator[tuple]:
        for kind, pattern, reach in KINDS:
            for m in pattern.finditer(value):
                start = max(0, m.start() - reach)
                amount, scale = m[1], m[2] if pattern.groups > 1 else ""
                yield kind, m.start(), m[0], amount, scale or "", value[start : m.end() + reach], m.start() - start, sentence_around(value, m.start())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, value in enumerate(batch.column(1)):
                rows = list(found(value.as_py() or ""))
                for start in range(0, len(rows), 1024):
                    part = rows[start : start + 1024]
                    columns = [pa.array(c, pa.int32() if n in ("place", "at") else pa.string()) for (n, _), c in zip(fields, zip(*part, strict=True), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([row] * len(part))), *columns], names=schema.names)

    return df.select(key, F.col(column).cast("string").alias("__text")).mapInArrow(run, schema)


def _place(value: Column, pattern: str) -> Column:
    """Where a pattern first matches, from 0; -1 where it does not."""
    return F.regexp_instr(value, F.lit(f"(?i){text.ascii_edges(pattern)}")) - 1


def metrics(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, metric, value, unit, display, context, confidence, place of the metrics of a text, one for each metric.

    Money goes to the label nearest within 45 characters, ties to the earlier rule; market estimates are no capital
    spending or revenue, parts of revenue no revenue, and small numbers without a scale no amounts; the first of a metric
    stays. Power needs a word for it nearby and is active, planned or neither by the nearer word; of power and
    accelerators (100 at least) the largest stays, the first of equal ones.
    """
    has = lambda c, pattern: c.rlike(f"(?i){text.ascii_edges(pattern)}")
    found = amounts(df, key, column).withColumn("number", F.regexp_replace("amount", ",", "").try_cast("double"))
    near, context, at = F.col("nearby"), F.col("context"), F.col("at")
    end = at + F.length("match")
    options = []
    for i, (metric, pattern, sure) in enumerate(rules.MONEY_METRICS):
        start = _place(near, pattern)
        stop = start + F.length(F.regexp_substr(near, F.lit(f"(?i){text.ascii_edges(pattern)}")))
        away = F.when(start < 0, None).when(stop <= at, at - stop).when(start >= end, start - end).otherwise(0)
        options.append(F.when(away <= 45, F.struct(away.alias("away"), F.lit(i).alias("order"), F.lit(metric).alias("metric"), F.lit(sure).alias("sure"))))
    best = F.array_min(F.filter(F.array(*options), lambda o: o.isNotNull()))
    money = found.filter("kind = 'money'").withColumn("b", best).filter("b IS NOT NULL").withColumn("metric", F.col("b.metric"))
    scale = F.lower("scale")
    value = F.when(scale.isin("billion", "bn", "b"), F.col("number") * 1000).when(scale.isin("million", "mm", "m"), F.col("number")).otherwise(F.col("number") / 1e6)
    wrong = F.col("metric").isin("capex", "revenue") & has(context, rules.MARKET_ESTIMATE) | (F.col("metric") == "revenue") & has(context, rules.PART_OF_REVENUE)
    suffix = F.when(scale.isin("billion", "bn", "b"), "B").when(scale.isin("million", "mm", "m"), "M").otherwise("")
    shown = F.concat(F.lit("$"), F.regexp_replace("amount", r"\.0+$", ""), suffix)
    money = money.filter(~wrong & (value > 0) & ((scale != "") | (F.col("number") >= 100_000))).select(key, "metric", value.alias("value"), F.lit("USD millions").alias("unit"), shown.alias("display"), "context", F.col("b.sure").alias("confidence"), "place", F.lit(0.0).alias("less"), F.lit(0).alias("order"))
    giga = F.lower(F.substring("scale", 1, 1)) == "g"
    size = F.when(giga, F.col("number") * 1000).otherwise(F.col("number"))
    active, planned, own = _place(near, rules.POWER_ACTIVE), _place(near, rules.POWER_PLANNED), F.instr(near, F.col("match")) - 1
    is_active = (active >= 0) & (F.abs(active - own) <= 70) & ((planned < 0) | (F.abs(active - own) <= F.abs(planned - own)))
    named = F.when(is_active, "active_power_capacity").when(planned >= 0, "planned_power_capacity").otherwise("power_capacity")
    power = found.filter("kind = 'power'").filter(has(near, rules.POWER_NEARBY) & (size > 0) & ~((size <= 5) & has(context, rules.FINANCING_TABLE)))
    power = power.select(key, named.alias("metric"), size.alias("value"), F.lit("MW").alias("unit"), F.concat_ws(" ", "amount", F.when(giga, "GW").otherwise("MW")).alias("display"), "context", F.lit(93).alias("confidence"), "place", (-size).alias("less"), F.lit(0).alias("order"))
    chips = found.filter("kind IN ('gpu', 'gpu_after') AND number >= 100")
    chips = chips.select(key, F.lit("gpu_count").alias("metric"), F.col("number").alias("value"), F.lit("GPUs").alias("unit"), F.concat(F.format_number(F.floor(F.col("number") + 0.5), 0), F.lit(" GPUs")).alias("display"), "context", F.lit(88).alias("confidence"), "place", (-F.col("number")).alias("less"), (F.col("kind") == "gpu_after").cast("int").alias("order"))
    first = F.row_number().over(Window.partitionBy(key, "metric").orderBy("less", "order", "place"))
    return money.unionByName(power).unionByName(chips).withColumn("__n", first).filter("__n = 1").select(key, "metric", "value", "unit", "display", "context", "confidence", "place")
