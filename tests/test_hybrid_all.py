"""Hybrid search asks every item of the benchmark, against the oracle."""

from sievework.plans import catalog
from tests.test_hybrid import _tables


def test_every_item_is_asked(spark, tmp_path):
    con = _tables(spark, tmp_path, {
        "benchmark": ([(n, t) for n, t in enumerate(["power grid", "unmet words", None, "grid", "capacity of the power", "the the grid"])], "item_id long, text string"),
        "documents": ([(n, ["Power of the grid is here.", "The capacity ends.", "Nothing of it."][n % 3] + f" Number {n}.", "web") for n in range(40)], "doc_id long, text string, source string"),
        "labels": ([(n, n % 4 and 1, 0) for n in range(40)], "doc_id long, quality int, toxic int"),
        "embeddings": ([(n, [float(n % 5 - 2), float(n % 7), 1.0]) for n in range(0, 40, 3)], "vec_id long, embedding array<double>"),
    })
    want = con.sql(f"SELECT item_id, place, doc_id, score FROM ({catalog.ORACLES['hybrid_topk']}) ORDER BY 1, 2").fetchall()
    found = catalog.QUERIES["hybrid_topk"](spark, str(tmp_path)).select("item_id", "place", "doc_id", "score").orderBy("item_id", "place").collect()
    assert {r.item_id for r in found} == set(range(6)) and len(found) == 60
    assert [tuple(r) for r in found] == want
