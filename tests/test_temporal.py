"""As-of values and running scores against plain walks, and on a key that holds all rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import temporal

DAY = datetime.date(2020, 1, 1)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("largest", [False, True])
def test_as_of_equals_a_search(spark, forward, largest):
    rng = random.Random(7)
    day = lambda: DAY + datetime.timedelta(rng.randint(0, 900))
    facts = [(rng.randint(0, 5), day(), i, f"v{i}") for i in range(120)] + [(0, None, 900, "x"), (None, DAY, 901, "y")]
    facts += [(1, facts[0][1], 500 + i, f"w{i}") for i in range(3)]
    rows = [(rng.randint(0, 6), day(), i) for i in range(300)] + [(0, None, 700), (None, DAY, 701), (1, facts[0][1], 702), (1, facts[0][1], 702)]
    got = temporal.as_of(spark.createDataFrame(rows, "k int, d date, v int").repartition(3), spark.createDataFrame(facts, "k int, since date, o int, name string"), "k", "d", "since", "o", ["name", "since"], forward, largest)
    want = []
    for k, d, v in rows:
        own = [f for f in facts if f[0] == k and None not in (k, d, f[1]) and (f[1] >= d if forward else f[1] <= d)]
        best = max(own, key=lambda f: ((f[1] - DAY).days * (-1 if forward else 1), f[2] if largest else -f[2]), default=(None,) * 4)
        want.append((k, d, v, best[3], best[1]))
    assert got.columns == ["k", "d", "v", "name", "since"] and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_as_of_on_one_hot_key_makes_no_pairs(spark):
    day = F.date_add(F.lit(DAY), (F.col("id") % 3000).cast("int"))
    rows = spark.range(100_000).select(F.lit(1).alias("k"), day.alias("d"), F.col("id").alias("v"))
    facts = spark.range(100_000).filter("id % 2 = 0").select(F.lit(1).alias("k"), day.alias("since"), F.col("id").alias("o"))
    found = temporal.as_of(rows, facts, "k", "d", "since", "o", ["o"])
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = {r.v: r.o for r in found.filter("v >= 99000").collect()}
    assert len(got) == 1000 and all(o % 3000 in (v % 3000, v % 3000 - 1) and o % 2 == 0 for v, o in got.items())
    assert found.count() == 100_000


def test_scores_in_chunks_equal_a_walk(spark, monkeypatch):
    monkeypatch.setattr(temporal, "CHUNK", 7)
    rng = random.Random(3)
    rows = [(k, DAY + datetime.timedelta(rng.randint(0, 60)), i, rng.randint(-30, 30)) for i in range(1500) for k in ([1] if i % 3 else [1, 2])]
    got = {(r.k, r.d): (r.score, r.n) for r in temporal.saturating_path(spark.createDataFrame(rows, "k int, d date, i int, x int").repartition(4), "k", "d", "i", "x").collect()}
    want = {}
    for k in (1, 2):
        score, n = 50, 0
        for _, d, _, x in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3]):
            score, n = max(10, min(90, score + x)), n + 1
            want[k, d] = (score, n)
    assert got == want
