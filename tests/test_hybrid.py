"""Hybrid search over terms inside words and missing or odd vectors, against the oracle."""

import duckdb
import pytest

from sievework.plans import catalog


def _tables(spark, at, tables):
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{at}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("width", [1, 60])
def test_terms_count_inside_longer_words(spark, tmp_path, width):
    run = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(3000))
    items = [(20, "power GRID capacity"), (40, f"{run[1000 : 1000 + 40 * width // 2]} {run[5:8]} \u0130ron"), (60, None), (80, "..."), (100, "unmet words only"), (21, "no question")]
    texts = ["The superpowers of gridlock grow", "Power to the grid, capacity ahead.", "powe rgrid capacit.", "POWERGRIDCAPACITY is one word here.", f"A run {run} ends.", "\u0130RON and Iron", "", "enviromental en\u212aviron", None]
    docs = [(n, (texts + [f"Plain text number {n}."] * 20)[n], "web") for n in range(29)]
    labels = [(n, 1 if n != 27 else 0, 0) for n in range(29)]
    vectors = [(n, [float((n * 7 + k * 3) % 5 - 2) for k in range(3)]) for n in range(26)] + [(26, [1.0, 2.0]), (40, [1.0, 0.0, 2.0]), (80, [1.0, 3.0]), (100, [-1.0, -1.0, -1.0])]
    con = _tables(spark, tmp_path, {
        "benchmark": (items, "item_id long, text string"),
        "documents": (docs, "doc_id long, text string, source string"),
        "labels": (labels, "doc_id long, quality int, toxic int"),
        "embeddings": (vectors, "vec_id long, embedding array<double>"),
    })
    want = con.sql(f"SELECT item_id, place, doc_id, score FROM ({catalog.ORACLES['hybrid_topk']}) ORDER BY 1, 2").fetchall()
    found = catalog.QUERIES["hybrid_topk"](spark, str(tmp_path)).select("item_id", "place", "doc_id", "score").orderBy("item_id", "place")
    assert [tuple(r) for r in found.collect()] == want
    assert {3} <= {doc for item, place, doc, _ in want if item == 20 and place <= 2}  # holds all terms, each inside its one word
    assert 4 in {doc for item, _, doc, _ in want if item == 40}
