"""Metrics of hand-made sentences, each with the rule that it shows."""

from sievework.sources import amounts

CASES = [
    ("Revenue was $1,250.0 million. Backlog of US$ 3.5bn stood at the end.", {"backlog": (1250.0, "$1,250M")}),  # the nearest label, and the first amount of it
    ("Revenue was $1,250.0 million in the year. At its end there was a backlog of US$ 3.5bn.", {"revenue": (1250.0, "$1,250M"), "backlog": (3500.0, "$3.5B")}),
    ("Annual recurring revenue reached $90 m. Sales of $12 million came later.", {"annual_recurring_revenue": (90.0, "$90M")}),  # the first place of a label counts, ties go to the earlier rule
    ("The market size is $900 billion revenue. Capex was $2 billion.", {"capex": (2000.0, "$2B")}),
    ("An increase in revenue of $5 million due to pricing. Debt of $250,000 and debt of $7.", {"debt": (0.25, "$250,000")}),
    ("The campus has 40 MW energized and 1.2 GW planned; another building has 300 megawatts planned.", {"active_power_capacity": (40.0, "40 MW"), "planned_power_capacity": (1200.0, "1.2 GW")}),
    ("It weighs 40 MW. Grid power is 5 MW in the capitalization table.", {"power_capacity": (40.0, "40 MW")}),
    ("We run 12,000 NVIDIA GPUs, with accelerators totaling 15,500 next, and 90 GPUs elsewhere.", {"gpu_count": (15500.0, "15,500 GPUs")}),
    ("Nothing here, $ of it, and revenue of $1.2.3 million.", {}),
    (None, {}),
    ("", {}),
]


def test_metrics_of_sentences(spark):
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(CASES)], "id int, text string, metric string").repartition(3)
    got = {i: {} for i in range(len(CASES))}
    for r in amounts.metrics(df, "id", "text").collect():
        got[r.id][r.metric] = (r.value, r.display)
        assert CASES[r.id][0][r.place :].startswith(("$", "US", *"0123456789", "acc"))
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


def test_sentence_around_a_place():
    value = "One is here. Two has 5 MW! Three\nFour goes on"
    assert amounts.sentence_around(value, value.index("5")) == "Two has 5 MW!"
    assert amounts.sentence_around(value, 0) == "One is here."
    assert amounts.sentence_around(value, value.index("goes")) in ("our goes on", "Four goes on")
    assert amounts.sentence_around("x" * 500, 10) == "x" * 370
