"""Whitening against a full decomposition and exact sums."""

import math
from fractions import Fraction

import numpy as np
import pytest

from sievework.llm import whitening


def matrices():
    rng = np.random.default_rng(4)
    for d in (1, 2, 3, 8, 40, 64):
        a = rng.standard_normal((d, d + 3))
        yield a @ a.T
        q, _ = np.linalg.qr(rng.standard_normal((d, d)))
        yield q @ np.diag(np.r_[np.full(min(d, 3), 5.0), np.linspace(1, 2, d)[min(d, 3) :]]) @ q.T  # one value three times
        yield q @ np.diag(10.0 ** -np.arange(d)) @ q.T
        yield q @ np.diag(1 + 1e-9 * np.arange(d)) @ q.T
        yield np.diag(np.arange(d).astype(float))
        yield np.zeros((d, d))
        yield np.ones((d, d)) * 3


def test_counts_are_those_of_the_spectrum():
    rng = np.random.default_rng(1)
    for v in matrices():
        e = np.linalg.eigvalsh(v)
        for shift in rng.uniform(e.min() - 1, e.max() + 1, 12):
            if np.abs(e - shift).min() > 1e-9:
                assert whitening.above(v, shift) == (e > shift).sum()


def test_leading_components_equal_a_full_decomposition():
    for v in matrices():
        e = np.linalg.eigvalsh(v)[::-1]
        values, vectors = whitening.leading(v, 4)
        norm = max(np.abs(e).max(), 1e-300)
        assert len(values) == min(4, (e > whitening.NOTHING * len(v) * max(e.sum(), 0)).sum() if e.sum() > 0 else 0)
        assert np.allclose(values, e[: len(values)], rtol=0, atol=1e-12 * norm)
        assert np.allclose(v @ vectors, vectors * values, rtol=0, atol=1e-12 * norm)
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-9)


def brute(rows, components=4):
    x = {}
    for i, (key, v) in enumerate(rows):
        if v and all(c is not None and math.isfinite(c) for c in v):
            x[i] = (key, tuple(math.floor(256 * c) for c in v))
    distinct = sorted({v for _, v in x.values()})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    centred = np.array([[float(Fraction(a) - Fraction(s, n)) for a, s in zip(v, sums, strict=True)] for v in distinct])
    e, vectors = np.linalg.eigh(centred.T @ centred / n)
    out = {}
    for key, v in x.values():
        y = np.array([float(Fraction(a) - Fraction(s, n)) for a, s in zip(v, sums, strict=True)])
        for k in range(1, components + 1):
            out.setdefault((key, k), []).append((n, sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)), y @ vectors[:, -k] / e[-k] ** 0.5, e[-k] / e.sum()))
    return out


def same(got, want):
    found = {}
    for r in got:
        found.setdefault((r.vec_id, r.component), []).append((r.n, r.deviation, r.whitened, r.explained))
        assert r.identity_error <= 1e-4
    assert found.keys() == want.keys()
    for k in range(1, 5):
        sign = [np.sign(a[2] * b[2]) for key in want if key[1] == k for a, b in zip(sorted(found[key], key=lambda r: r[:2]), sorted(want[key], key=lambda r: r[:2]), strict=True) if abs(b[2]) > 1e-6]
        assert len(set(sign)) == 1
        for key in (key for key in want if key[1] == k):
            for a, b in zip(sorted(found[key], key=lambda r: r[:2]), sorted(want[key], key=lambda r: r[:2]), strict=True):
                assert a[:2] == b[:2] and a[2] * sign[0] == pytest.approx(b[2], abs=1e-9) and a[3] == pytest.approx(b[3], rel=1e-9)


SCHEMA = "vec_id long, embedding array<float>, x int, n string"


def test_rows_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(i, np.float32(v).tolist()) for i, v in enumerate(rng.standard_normal((60, 6)) @ rng.standard_normal((6, 6)))]
    rows += [(1, rows[0][1]), (None, rows[2][1]), (70, None), (71, []), (72, [1.0] * 5 + [None]), (73, [1.0] * 5 + [math.nan]), (74, [math.inf] * 6), (75, [0.0] * 6), (76, [-0.0] * 6)]
    df = spark.createDataFrame([(k, v, 3, "n") for k, v in rows], SCHEMA).repartition(4)
    same(whitening.whiten(df).collect(), brute(rows))


def test_few_vectors_lengths_and_large_numbers(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], 1, "a"), (2, [1.0, 2.0], 1, "a")], SCHEMA)
    assert whitening.whiten(one).count() == 0
    assert whitening.whiten(one.limit(0)).count() == 0
    two = one.union(spark.createDataFrame([(3, [1.0, 3.0], 1, "a"), (4, [5.0], 1, "a"), (5, [7.0], 1, "a"), (6, [7.5], 1, "a"), (7, [1e18, 4.0], 1, "a")], SCHEMA))
    got = {(r.vec_id, r.component): r for r in whitening.whiten(two.filter("vec_id < 7")).collect()}
    assert sorted(got) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1)]
    assert {abs(round(got[i, 1].whitened, 9)) for i in (1, 2, 3)} == {1.0} and got[4, 1].n == 3 and got[1, 1].explained == pytest.approx(1)
    assert all(r.deviation is None or r.deviation >= 0 for r in whitening.whiten(two).collect())


def test_query_equals_brute_force(spark):
    from sievework.llm.queries import QUERIES

    rows = [(r.vec_id, list(r.embedding) if r.embedding is not None else None) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    same(QUERIES["op13_whitening"](spark, "/root/testdata/sf0.001").collect(), brute(rows))
