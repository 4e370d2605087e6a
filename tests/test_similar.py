"""Similar pairs, assignment and removal against the sequential rules."""

import random

import pytest

from sievework.operators import similar


def sets(rng, n, words=14):
    return [sorted({f"t{int(rng.paretovariate(0.6)) % words}" for _ in range(rng.randint(0, 9))}) for _ in range(n)]


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("least", [0.35, 0.82])
def test_pairs_equal_brute_force(spark, least):
    rng = random.Random(2)
    left, right = ([(i % 3, i, t or (None if i % 2 else [])) for i, t in enumerate(sets(rng, 90))] for _ in range(2))
    schema = "g int, i int, t array<string>"
    got = similar.similar_pairs(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["g"], ["i"], "t", least).collect()
    want = sorted((g, i, j, jaccard(a or [], b or [])) for g, i, a in left for h, j, b in right if g == h and jaccard(a or [], b or []) >= least)
    assert sorted(map(tuple, got)) == want and len(want) > 30


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_assignment_equals_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    pairs = [(g, i, j, rng.randint(35, 50) / 100) for g in range(4) for i in range(14) for j in range(12) if rng.random() < (0.1, 0.3, 0.6, 1)[g]]
    want = []
    for g in range(4):
        free = set(range(12))
        for i in range(14):
            own = sorted((-s, j) for h, k, j, s in pairs if h == g and k == i and j in free)
            if own:
                free.discard(own[0][1])
                want.append((g, i, own[0][1], -own[0][0]))
    df = spark.createDataFrame(pairs, "g int, i int, j int, s double").repartition(5)
    assert sorted(map(tuple, similar.assign(df, ["g"], "i", "j", "s").collect())) == want
    assert similar.assign(df.limit(0), ["g"], "i", "j", "s").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_removal_equals_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    rows = [(i % 3, i, t or None, "x") for i, t in enumerate(sets(rng, 160))]
    rng.shuffle(rows)
    kept, want = {0: [], 1: [], 2: []}, {}
    for g, i, t, _ in sorted(rows, key=lambda r: r[1]):
        like = [k for k, s in kept[g] if jaccard(t or [], s or []) >= 0.6]
        want[i] = like[0] if like else None
        if not like:
            kept[g].append((i, t))
    df = spark.createDataFrame(rows, "company int, i int, t array<string>, kind string").repartition(4)
    got = similar.first_distinct(df, ["company"], "i", "t", 0.6)
    assert got.columns == ["company", "i", "t", "kind", "kept", "like"]
    assert {r.i: r.like for r in got.collect()} == want and all(r.kept == (r.like is None) for r in got.collect())
    assert similar.first_distinct(df.limit(0), ["company"], "i", "t", 0.6).count() == 0
