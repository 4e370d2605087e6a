"""Spelling variants against a plain comparison of all pairs of words."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from sievework.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def counted(rows, one_in=97):
    counts = Counter()
    for key, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % one_in == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    """By the definition: delete each place, or replace one."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(words):
    links = {w: [] for w in words}
    for a, b in itertools.combinations(words, 2):
        if near(a, b):
            links[a].append(b)
            links[b].append(a)
    form = {}
    for w, others in links.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        if best is not None and words[best] >= 2 * words[w]:
            form[w] = best
    rows = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n, len(links[w]), words.get(form.get(w))))
    return sorted(rows)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcéÀ") for _ in range(rng.randint(4, 9))) for _ in range(120)]
    rows = [(i, " ".join(rng.choice(stems) for _ in range(rng.randint(0, 80)))) for i in range(150)]
    return [*rows, (1, "ABCDE abcde ÀÀÀÀÀ àààààà × a÷bcd"), (1, "ABCDE abcde ÀÀÀÀÀ àààààà × a÷bcd"), (None, "abcde abcde aabcde"), (7, None), (8, ""), (9, "12 .. 34"), (10, "x" * 3000 + " " + "x" * 3001 + (" " + "x" * 2999) * 4)]


def test_variants_equal_brute_force(spark, texts):
    df = spark.createDataFrame([(k, t, "a", 1) for k, t in texts], "doc_id long, text string, word string, n int").repartition(5)
    want = grouped(counted(texts, 5))
    got = rows_of(spelling.spelling_variants(df, slips_one_in=5))
    assert got == want
    assert sum(r[1] is not None for r in got) > 20


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    chain = {"k" * i + "mnopq": 3 * 2**i for i in range(12)}
    words = chain | {"".join(("abc", *(rng.choice("xyzé") for _ in range(rng.randint(2, 6))))): rng.randint(3, 400) for _ in range(500)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = grouped(words)
    assert len({r[2] for r in want if r[0] in chain}) == 1
    monkeypatch.setattr(spelling, "BLOCK", 30)
    monkeypatch.setattr(spelling, "MOST_SENT", 3)
    assert rows_of(spelling.group_variants(df)) == want


def test_small_tiles(texts):
    import pyarrow as pa

    spelling_side = spelling.SIDE
    words = sorted({"abcde", "abcdf", "abcd", "abxcde", "aabcde", "zbcde"})
    m, suffix, key = 4, False, 1
    try:
        spelling.SIDE = 2
        table = pa.table({"m": pa.array([m] * 6, pa.int32()), "suffix": [suffix] * 6, "key": [key] * 6, "word": words, "n": [3] * 6, "left": [True] * 6, "right": [True] * 6})
        got = {tuple(sorted((r["word"], r["other"]))) for r in spelling._tile(table).to_pylist()}
    finally:
        spelling.SIDE = spelling_side
    assert got == {(a, b) for a, b in itertools.combinations(words, 2) if near(a, b) and max(len(a), len(b)) == m + 1}


def test_ties_and_empty_tables(spark):
    tied = {"aaaaa": 3, "aaaab": 6, "aaaac": 6, "zzzzz": 9}
    got = rows_of(spelling.group_variants(spark.createDataFrame(list(tied.items()), "word string, n long")))
    assert got == [("aaaaa", "aaaab", "aaaab", 3, 2, 6), ("aaaab", None, "aaaab", 6, 2, None), ("aaaac", None, "aaaac", 6, 2, None), ("zzzzz", None, "zzzzz", 9, 0, None)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(empty).count() == 0
    with pytest.raises(ValueError):
        spelling.group_variants(empty, times=1)


def test_query_equals_brute_force(spark):
    from sievework.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(QUERIES["op11_spelling"](spark, "/root/testdata/sf0.001")) == grouped(counted([tuple(r) for r in docs]))
