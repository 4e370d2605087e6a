"""Scores of odd texts, and the queries over accepted evidence, against the oracles."""

import duckdb
import pytest

from sievework.operators import keyed
from sievework.plans import catalog

WORDS = "the of and to in is by with on for are was that this from were have"
TEXTS = [
    None, "", " ", " ", "a b the of", WORDS, WORDS.upper() + ".", f"  {WORDS}\t\n{WORDS}  {WORDS}. And so. More! Yes? ", f"{WORDS} " * 9, "2020 2021 20222 x2023 2024 and 2025.", "12 a1 1a 9", "lower start the of", "x" * 30,
    "The is. " * 4, "the of and " * 30, "the of and. " * 30, "x " * 40 + "end.", f"In {WORDS} 2019, 2020. 2021; 2022! " * 2, "  \n ", "Of the 7.", "end. ", "end. ",
]
QUERIES = ["eligible_evidence", "evidence_quality", "greedy_cells", "packet_scores", "topic_diverse_claims"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at, con = tmp_path_factory.mktemp("scores"), duckdb.connect()
    docs = [(n * 41, TEXTS[n % len(TEXTS)] if n < 66 else f"{WORDS} that {n}. The end of it is here.", f"src{n % 5}" if n % 9 else None) for n in range(120)]
    labels = [(n * 41, n % 3 % 2 if n % 7 else None, n % 2) for n in range(0, 130, 2) if n % 5] + [(41 * 6, 1, 0)]
    for name, rows, schema in (("documents", docs, "doc_id long, text string, source string"), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{at}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet/*.parquet'")
    return str(at), con


def same(spark, tables, name):
    found = catalog.QUERIES[name](spark, tables[0])
    want = sorted(tables[1].sql(f"SELECT {', '.join(found.columns)} FROM ({catalog.ORACLES[name]})").fetchall(), key=str)
    assert sorted(map(tuple, found.collect()), key=str) == want and want
    return found


@pytest.mark.parametrize("name", QUERIES)
@pytest.mark.parametrize("sent", [3, keyed.SENT])
def test_odd_texts(spark, tables, name, sent, monkeypatch):
    monkeypatch.setattr(keyed, "SENT", sent)
    same(spark, tables, name)


def scans_of_text(found):
    """Regular expressions in the plan that is left to run."""
    return found._jdf.queryExecution().optimizedPlan().toString().count("regexp")


@pytest.mark.parametrize("name", ["eligible_evidence", "packet_scores", "topic_diverse_claims"])
def test_scores_are_made_once(spark, tables, name):
    assert scans_of_text(catalog.QUERIES[name](spark, tables[0])) == 0
