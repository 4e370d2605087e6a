"""Claims from evidence against what each rule of the domain asks for, on hand-made texts."""

import pytest
from pyspark.sql import functions as F

from sievework.functions import rules
from sievework.operators import similar, synthesis

POWER = "Acme Grid expanded its contracted power capacity to 240 MW across three data center campuses during the quarter."
ROWS = [
    # excerpt, section, wanted claim, representation, status
    ("We expect capacity at the northern campus to reach 240 MW before the end of next year. It is fine.", "exposure", "Acme Grid expects capacity at the northern campus to reach 240 MW before the end of next year.", "paraphrase", "verified"),
    ("Our backlog for infrastructure services grew to 3 billion dollars in the last quarter alone.", "advantages", "Acme Grid's backlog for infrastructure services grew to 3 billion dollars in the last quarter alone.", "paraphrase", "verified"),
    (POWER, "exposure", POWER, "quote", "verified"),
    ("Signed a lease agreement with a large customer for the southern data center campus last month.", "catalysts", "Acme Grid signed a lease agreement with a large customer for the southern data center campus last month.", "paraphrase", "verified"),
    ("Revenue from cloud services rose because customers deployed larger clusters in the period.", "advantages", "Acme Grid reported revenue from cloud services rose because customers deployed larger clusters in the period.", "paraphrase", "verified"),
    ("As of June the liquidity position covered all planned capital spending for two full years.", "risks", "Acme Grid reported that as of June the liquidity position covered all planned capital spending for two full years.", "paraphrase", "verified"),
    ("AWS capacity at the site remains constrained by the utility's delayed substation upgrade work.", "risks", "Acme Grid disclosed that AWS capacity at the site remains constrained by the utility's delayed substation upgrade work.", "paraphrase", "verified"),
    # the better sentence for the section wins over the first
    ("Management met several investors in the spring and discussed many things with all of them. Debt costs rose and a delay in financing could pressure the schedule of the project.", "risks", "Acme Grid disclosed that debt costs rose and a delay in financing could pressure the schedule of the project.", "paraphrase", "verified"),
    # a slide has no readable sentence but for its fragment
    ("Company timeline 2021 2022 2023 and Acme Grid has secured $12.5 billion of total contracted lease value", "exposure", "Acme Grid has secured $12.5 billion of total contracted lease value", "quote", "verified"),
    # the text denies elsewhere what the claim says: a quote stays
    ("The second building reached full operation ahead of plan according to the update. Power was not available at the third one.", "catalysts", "The second building reached full operation ahead of plan according to the update.", "quote", "source-fallback"),
    ("1 2 3 4", "exposure", "1 2 3", "quote", "source-fallback"),
    ("", "exposure", "", "quote", "source-fallback"),
    (None, None, "", "quote", "source-fallback"),
]


def test_own_claims(spark):
    rows = [(i, excerpt, "Acme Grid", section, 80, "kept") for i, (excerpt, section, *_) in enumerate(ROWS)]
    df = spark.createDataFrame([*rows, rows[0]], "id long, excerpt string, name string, section string, quality int, claims string").repartition(3)
    found = synthesis.own_claims(df, "excerpt", "name", "section", "quality", rules.CLAIM_SECTIONS).collect()
    assert len(found) == len(rows) + 1
    for r in found:
        assert (r.claim, r.representation, r.status) == ROWS[r.id][2:], r.id
        assert r.claims == "kept" and (r.quality_score == 72 if r.status == "source-fallback" else 64 < r.quality_score <= 84)
    assert synthesis.own_claims(df.limit(0), "excerpt", "name", "section", "quality", rules.CLAIM_SECTIONS).count() == 0


def test_names_are_no_patterns_and_numbers_of_names_count(spark):
    df = spark.createDataFrame([(1, "C3 (AI)* has secured $4 million of contract value", "C3 (AI)*"), (2, POWER.replace("Acme Grid expanded", "It expanded"), "Site 9"), (3, POWER, None)], "id int, excerpt string, name string")
    df = df.withColumns({"section": F.lit("exposure"), "quality": F.lit(70)})
    found = {r.id: r for r in synthesis.own_claims(df, "excerpt", "name", "section", "quality", rules.CLAIM_SECTIONS).collect()}
    assert found[2].status == "source-fallback" and found[2].claim.startswith("It expanded")
    assert found[3].claim == POWER


@pytest.fixture(scope="module")
def given(spark):
    source = "Power capacity at the campus increased to 240 MW in March. The company signed 12 new customers for cloud services in the same quarter."
    claims = [
        ("Power capacity at the campus increased to 240 MW in March.", True),
        ("Power capacity at the campus increased to 250 MW in March.", False),
        ("Power capacity at the campus has increased to 240 MW by March.", True),
        ("Power capacity at the campus decreased to 240 MW in March.", False),
        ("Analysts believe that margins will recover in the coming period.", False),
        ("power capacity increased to 240 MW in March at the campus.", False),
        ("Capacity.", False),
        (None, False),
    ]
    rows = [(i, c, q, source, "Acme", "exposure", 90) for i, (c, q) in enumerate(claims)]
    df = spark.createDataFrame(rows, "id long, said string, quote boolean, text string, name string, section string, quality int")
    return synthesis.verified(df, "said", F.col("quote"), "text", "name", "section", "quality", rules.CLAIM_SECTIONS)


def test_each_check_fails_alone(given):
    found = {r.id: (r.numeric_ok, r.supported, r.quote_ok, r.malformed, r.status) for r in given.collect()}
    assert found[0] == (True, True, True, False, "verified")
    assert found[1] == (False, True, True, False, "source-fallback")
    assert found[2] == (True, True, False, False, "source-fallback")
    assert found[3] == (True, False, True, False, "source-fallback")
    assert found[4] == (True, False, True, False, "source-fallback")
    assert found[5][3:] == (True, "source-fallback")
    assert found[6] == (True, True, True, True, "source-fallback")
    assert found[7] == (True, False, True, True, "source-fallback")


def test_fallbacks_of_one_source_are_near_equal(given):
    words = given.select("id", F.lit("c").alias("company"), synthesis.claim_words(F.col("final")).alias("words"))
    found = {r.id: r.like for r in similar.first_distinct(words, ["company"], "id", "words", 0.82).collect()}
    assert found == {i: None if i == 0 else 0 for i in range(8)}
