"""Quotes at places that the generated tables do not hold, against the oracle."""

import duckdb

from sievework.plans import catalog


def test_quotes_with_glued_ends_and_short_items(spark, tmp_path):
    long = "The first of seven words is here"
    items = [(1, long), (2, "two words"), (3, "one two three four."), (4, "x"), (5, " led by a blank and more words "), (6, None)]
    docs = [(1, f"\u201c{long}\u201d, they said"), (2, f"pre{long}post"), (3, long), (4, "the first of seven words is here"), (5, "two words"), (6, "(two words)"), (7, "one two three four.five"), (8, "so led by a blank and more words end"), (9, None), (None, f"[{long}]"), (10, "The first\nof seven words is here")]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for name in ("benchmark", "documents"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(con.sql(catalog.ORACLES["quote_fidelity"]).fetchall(), key=str)
    assert {(1, 1), (2, 1), (None, 1), (6, 2), (7, 3), (8, 5)} <= set(want)
    assert sorted(map(tuple, catalog.QUERIES["quote_fidelity"](spark, str(tmp_path)).collect()), key=str) == want
