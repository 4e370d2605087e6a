"""Pages whose headings are cut inside a character reference, against the oracle."""

import duckdb
import pytest

from sievework.plans import catalog

BODY = "A paragraph of more than ninety characters that stands under the heading, so that a passage is made of it."
HEADS = ["Ends in a whole &amp;", "Cut at &amp", "Cut at &am", "Cut at &a", "Cut at &", "Cut at &lt", "Cut at &quot", "Twice &amp;&amp", "AT&ampT &copy; &gt"]


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("cut")
    rows = [(n, f"<html><head><title>{h}</title></head><body><h1>{h}</h1><p>{BODY}</p><footer>&copy; 2020</footer></body></html>") for n, h in enumerate(HEADS)]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"file://{at}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{at}/pages.parquet/*.parquet'")
    return str(at), con


def same(spark, pages, name):
    at, con = pages
    found = catalog.QUERIES[name](spark, at)
    want = sorted(con.sql(f"SELECT {', '.join(found.columns)} FROM ({catalog.ORACLES[name]})").fetchall(), key=str)
    assert sorted(map(tuple, found.collect()), key=str) == want and len(want) >= len(HEADS)


def test_page_blocks(spark, pages):
    same(spark, pages, "page_blocks")


def test_page_passages(spark, pages):
    same(spark, pages, "page_passages")


def test_heading_carry_forward(spark, pages):
    same(spark, pages, "heading_carry_forward")
