"""Comparison of filings against the sequential rule, and the policy for events on hand-made passages."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sievework.functions import rules
from sievework.operators import filings

SCHEMA = "filing long, section int, category string, title string, item_code string, passage int, text string"


def tokens(x):
    return {t for t in re.findall("[a-z0-9]+", x.lower()) if len(t) > 1 and t not in rules.FILING_STOP_WORDS}


def similarity(a, b):
    a, b = tokens(a), tokens(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def level(kind, s, now, before):
    terms = lambda x: {t for t in rules.MATERIAL_TERMS if t in tokens(x)}
    if kind == "not_repeated":
        return "low"
    if kind == "added":
        return "high" if terms(now) else "medium"
    return "high" if s < 0.55 or terms(now) != terms(before) else "medium" if s < 0.75 else "low"


def sequential(now, before):
    """now, before: (category, title) -> texts, in order."""
    out = []
    for section, texts in now.items():
        free = dict(enumerate(before.get(section, []), 1))
        for i, t in enumerate(texts, 1):
            best = max(((similarity(t, o), -j) for j, o in free.items()), default=(0, 0))
            if best[0] >= 0.35:
                old = free.pop(-best[1])
                if best[0] < 0.9:
                    out.append(("modified", level("modified", best[0], t, old), section[1], i, -best[1]))
            else:
                out.append(("added", level("added", None, t, ""), section[1], i, None))
        out += [("not_repeated", "low", section[1], None, j) for j in free]
    out += [("not_repeated", "low", section[1], None, j) for section, texts in before.items() if section not in now for j, _ in enumerate(texts, 1)]
    rank = {"high": 0, "medium": 1, "low": 2}
    return sorted(out, key=lambda c: (c[0] == "not_repeated", rank[c[1]]))


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_equal_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    words = [*rules.MATERIAL_TERMS[:6], *(f"w{i}" for i in range(9)), "the", "of"]
    sections = [("Risk", "Risk Factors"), ("Liquidity", "Liquidity and Capital Resources"), ("Filing item", "Item 2: Unregistered sales"), ("Demand", "Customers and Demand")]
    text = lambda: " ".join(rng.sample(words, rng.randint(2, 9)))
    made = {n: {s: [text() for _ in range(rng.randint(1, 5))] for s in rng.sample(sections, rng.randint(0, 4))} for n in range(24)}
    forms = {n: rng.choice(["10-Q", "10-K/A", "20-F"]) for n in made}
    rows = [(n, i, c, t, None, k, x) for n, own in made.items() for i, ((c, t), texts) in enumerate(own.items(), 1) for k, x in enumerate(texts, 1)]
    about = [(n, forms[n], n - 1 if n % 5 else None) for n in made] + [(None, "10-Q", None)]
    got = {}
    for r in filings.compare(spark.createDataFrame(about, "filing long, form string, previous long"), spark.createDataFrame(rows, SCHEMA).repartition(3)).orderBy("filing", "place").collect():
        got.setdefault(r.filing, []).append((r.type, r.significance, r.title, r.passage, r.previous_passage))
        assert r.mode == ("amendment" if forms[r.filing] == "10-K/A" else "periodic")
    keep = lambda n, own: {s: x for s, x in own.items() if forms[n] == "10-K/A" or s[0] != "Filing item"}
    want = {n: w for n in made if n % 5 and (w := sequential(keep(n, made[n]), keep(n, made[n - 1])))}
    assert got == want and {c[0] for w in want.values() for c in w} == {"added", "modified", "not_repeated"}


def test_events_follow_the_items_policy(spark):
    rows = [
        (1, 1, "Agreement", "Material Agreement", None, 1, "A lease for a data center with powered capacity, and a credit facility of the lender."),  # 35 + 25 + 25
        (1, 2, "Filing item", "Item 5.07: Votes", None, 1, "Customers and debt and revenue and delay."),  # administrative
        (1, 3, "Filing item", "Item 2.06: Impairment", None, 1, "Nothing that counts."),  # own category, 45
        (1, 4, "Financials", "Financial Statements", "9.01", 1, "Revenue and debt."),
        (2, 1, "Overview", "Filing Overview", None, 1, "The customer asked for a delay."),  # 25 + 20 + 20, ties to the earlier signal
        (2, 1, "Overview", "Filing Overview", None, 2, "The customer, incorporated by reference into this item, and a delay."),
        (3, 1, "Overview", "Filing Overview", None, 1, "Revenue."),  # 10 + 20 is too little
    ]
    about = spark.createDataFrame([(1, "8-K", None), (2, "6-K", 1), (3, "8-K", 2)], "filing long, form string, previous long")
    got = filings.compare(about, spark.createDataFrame(rows, SCHEMA)).orderBy("filing", "place").collect()
    assert [(r.filing, r.place, r.type, r.significance, r.category, r.title) for r in got] == [
        (1, 1, "new_event", "high", "Capacity", "Material Agreement"), (1, 2, "new_event", "low", "Execution", "Item 2.06: Impairment"), (2, 1, "new_event", "medium", "Customer", "Filing Overview"),
    ]
    e = filings.event_policy(F.lit("8-K"), F.lit(None).cast("string"), F.lit("Filing item"), F.lit("Item 2.03: Debt"), F.lit("é revenue of a loan"))
    assert tuple(spark.range(1).select(e.alias("e")).first().e) == ("2.03", "Financial obligation", "Funding", 100, True)
