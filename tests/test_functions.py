import datetime

import pytest
from pyspark.sql import functions as F

from sievework.functions import rules, text
from sievework.operators import keyed, temporal


def values(spark, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(*columns).collect()]


def test_urls_lose_tracking_and_fragments(spark):
    got = values(spark, ["http://a/b?utm_source=x&id=1#top", "http://a/b?gclid=1", "http://a/b?id=2&mc_cid=3", None], text.canonical_url(F.col("x")))
    assert got == [("http://a/b?id=1",), ("http://a/b",), ("http://a/b?id=2",), (None,)]


def test_topics_follow_rule_order(spark):
    got = values(spark, ["New data center power", "customer risk", "nothing here"], text.first_topic(F.col("x"), rules.TOPICS, rules.DEFAULT_TOPIC))
    assert [g[0] for g in got] == ["Power & capacity", "Customers & demand", "Company developments"]


def test_empty_text_is_unreadable_and_hashes(spark):
    rows = spark.createDataFrame([(0, ""), (1, "one sentence. Another.")], "i int, x string")
    got = [tuple(r) for r in text.readability_risk(rows, "x", rules.TABLE_LABELS).orderBy("i").select("risk", text.fnv1a(F.col("x"))).collect()]
    assert got[0] == (100, "811c9dc5") and got[1][0] == 20


def test_change_has_a_band_and_rounds_halves_up(spark):
    df = spark.createDataFrame([(100.0, None), (101.0, 100.0), (97.5, 100.0), (5.0, 0.0), (130.0, 100.0)], "a double, b double")
    got = [tuple(r.c) for r in df.select(text.change(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got == [("new", None, "medium"), ("unchanged", 1, "low"), ("unchanged", -2, "low"), ("changed", None, "low"), ("increased", 30, "high")]


@pytest.mark.parametrize("seed", [1, 2])
def test_composed_fold_equals_the_sequential_one(spark, seed):
    import random

    rnd = random.Random(seed)
    rows = [(rnd.randint(0, 2), datetime.date(2024, 1, 1 + rnd.randint(0, 5)), i, rnd.randint(-40, 40)) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, d date, i int, x int")
    got = {(r.k, r.d): (r.score, r.n) for r in temporal.saturating_path(df, "k", "d", "i", "x").collect()}
    want = {}
    for k in range(3):
        score, n = 50, 0
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            score, n = max(10, min(90, score + r[3])), n + 1
            want[k, r[1]] = (score, n)
    assert got == want


def test_upsert_twice_is_upsert_once(spark):
    old = spark.createDataFrame([(1, "a", "s", "accepted"), (2, "b", "s", "pending")], "id int, v string, s string, status string")
    new = spark.createDataFrame([(1, "x", "t"), (2, "y", "t"), (3, "z", "t")], "id int, v string, s string")
    once = keyed.upsert(old, new, "id", ["v"], ["s"], "status")
    assert sorted(map(tuple, once.collect())) == [(1, "x", "s", "accepted"), (2, "y", "t", "pending"), (3, "z", "t", "pending")]
    assert sorted(map(tuple, keyed.upsert(once, new, "id", ["v"], ["s"], "status").collect())) == sorted(map(tuple, once.collect()))


def test_pages_join_to_the_full_order(spark):
    df = spark.createDataFrame([(i % 3, datetime.date(2024, 1, 1 + i % 5), i) for i in range(40)], "q int, d date, id int")
    seen, after = [], None
    while True:
        rows = keyed.page(df, 7, "q", "d", "id", after).collect()
        seen += rows[:7]
        if len(rows) <= 7:
            break
        after = tuple(rows[6])
    assert [r.id for r in seen] == [r.id for r in sorted(df.collect(), key=lambda r: (r.q, r.d, r.id), reverse=True)]


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    from sievework.streaming import events

    rows = [(i, datetime.datetime(2024, 1, 1, 0, i % 7, i % 60), i % 3) for i in range(100)]
    spark.createDataFrame(rows, "id int, ts timestamp, user int").write.parquet(str(tmp_path / "in"))
    batch = events.rates(spark.read.parquet(str(tmp_path / "in")), ["user"], "ts", limit=5)
    stream = events.rates(spark.readStream.schema("id int, ts timestamp, user int").parquet(str(tmp_path / "in")), ["user"], "ts", limit=5, late="1 minute")
    q = stream.writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("rates").collect())) == sorted(map(tuple, batch.collect()))


def test_hashes_of_many_texts(spark):
    def plain(t):
        h = 2166136261
        for c in t:
            h = (h ^ ord(c)) * 16777619 % (1 << 32)
        return f"{h:x}"

    rows = ["", "a", "\u00e9t\u00e9", "x" * 5000, "b", "a longer text with words", "x" * 4999, None]
    got = values(spark, rows, text.fnv1a(F.col("x")))
    assert [g[0] for g in got] == [None if t is None else plain(t) for t in rows]


def test_passages_keep_sentences_whole_and_cut_long_ones(spark):
    long = "Y" * 2300
    rows = ["One. Two. Three.", f"Short one. {long} Next one.", "A" * 600 + ". " + "B" * 600 + ". C.", ""]
    got = [g[0] for g in values(spark, rows, text.passages(F.col("x")))]
    assert got[0] == ["One. Two. Three."] and got[2] == ["A" * 600 + ".", "B" * 600 + ". C."] and got[3] == []
    assert got[1][0] == "Short one." and [len(p) for p in got[1][1:]] == [1100, 1100, len(long) + len(" Next one.") - 2200]


def test_research_grade_and_malformed_claims(spark):
    good = "The company signed a contract for twenty megawatts of new capacity at its campus in the north with two customers this year"
    rows = [good, "Too short", good + " which is incorporated herein by reference", "12.1 Press release " + good]
    assert [g[0] for g in values(spark, rows, text.research_grade(F.col("x"), rules.BOILERPLATE))] == [True, False, False, False]
    rows = ["Revenue rose by ten percent over last year.", "revenue rose by ten percent over last year.", "See www.example.com for the full report", "Page 3 / 12 of the investor slides", "Sites 1 2 3 4 here", "AA BB CC DD EE FF GG of it"]
    assert [g[0] for g in values(spark, rows, text.malformed(F.col("x")))] == [False, True, True, True, True, True]


def test_numeric_facts_have_one_spelling(spark):
    got = values(spark, ["$1,200.5 bn and 3-year terms, 40 % or 25 bps, 7 GPUs and 2024", "none", "\u20ac5m"], text.numeric_facts(F.col("x")))
    assert got[0][0] == ["$1200.5:billion", "3:year", "40:percent", "25:basis-points", "7:gpus", "2024"] and got[1][0] == [] and got[2][0] == ["\u20ac5:million"]


def test_contradiction_and_direction(spark):
    df = spark.createDataFrame([("Sales increased", "Sales declined", True), ("It is not so", "It is so", True), ("Profit before tax", "Profit before tax", False)], "a string, b string, want boolean")
    got = df.select(text.contradicts(F.col("a"), F.col("b"), rules.NEGATIONS, rules.DIRECTIONS).alias("c"), "want").collect()
    assert all(r.c == r.want for r in got)


def test_sections_and_changes(spark):
    got = values(spark, ["Item 1A. Risk Factors", "Item 5.02 Departure of Directors.", "plain text", "Item 8.01: Other Events"], text.section(F.col("x"), rules.SECTIONS))
    assert [tuple(g[0]) if g[0] else None for g in got] == [("Risk", "Risk Factors"), ("Filing item", "Item 5.02: Departure of Directors"), None, ("Event", "Other Material Events")]
    df = spark.createDataFrame([("modified", 0.5, ["a"], ["a"]), ("modified", 0.9, ["debt"], ["a"]), ("modified", 0.7, ["a"], ["a"]), ("modified", 0.9, ["a"], ["a"]), ("added", None, ["risk"], []), ("added", None, ["a"], []), ("not_repeated", None, [], ["risk"])], "k string, s double, n array<string>, o array<string>")
    got = [r[0] for r in df.select(text.text_change(F.col("k"), F.col("s"), F.col("n"), F.col("o"), rules.MATERIAL_TERMS)).collect()]
    assert got == ["high", "high", "medium", "low", "high", "medium", "low"]


def test_periods_and_targets_read_from_text(spark):
    from sievework.plans import claims, metrics

    rows = ["Q1 2026 results", "Fourth quarter and full year of FY '25", "Q3/FY24", "Full year 2023", "FY2022 letter", "no period"]
    got = [tuple(g[0])[1:3] if g[0] else None for g in values(spark, rows, metrics.explicit_period(F.col("x")))]
    assert got == [(2026, 1), (2025, 4), (2024, 3), (2023, None), (2022, None), None]
    rows = ["by the end of Q2 2027", "ready by February 2028", "through fiscal 2026", "soon"]
    got = [tuple(g[0]) for g in values(spark, rows, metrics.commitment_target(F.col("x")))]
    assert got == [(datetime.date(2027, 6, 30), "quarter"), (datetime.date(2028, 2, 29), "day"), (datetime.date(2026, 12, 31), "year"), (None, "undated")]
    df = spark.createDataFrame([("cash position", "increased", "positive"), ("debt cost", "new", "negative"), ("debt cost", "decreased", "positive"), ("customer growth", "decreased", "negative"), ("weather", "changed", "neutral")], "l string, d string, want string")
    assert all(r.got == r.want for r in df.select(claims.sentiment(F.col("l"), F.col("d")).alias("got"), "want").collect())


def test_changes_between_snapshots(spark):
    schema = "k long, t string, c string"
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, None, "x"), (4, "d", "x"), (None, "n", "x")], schema)
    new = spark.createDataFrame([(1, "a", "y"), (2, "B", "y"), (3, "", "y"), (5, "e", "y"), (None, "n", "y")], schema)
    got = {(r.k, r.c, r.action) for r in keyed.changes(old, new, "k", "t", ["c"]).collect()}
    assert got == {(1, "y", "same"), (2, "y", "changed"), (3, "y", "same"), (4, "x", "missing"), (5, "y", "new"), (None, "x", "missing"), (None, "y", "new")}
    assert keyed.changes(old.limit(0), new.limit(0), "k", "t").isEmpty()
