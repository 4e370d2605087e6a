"""Texts that end in numbers, against the oracles."""

import duckdb

from sievework.plans import catalog

PROSE = "Ontion in tishha orwh onaton reing reesst ndennt thheing whou"
TEXTS = [
    f"{PROSE}. 4072374829496490", f"0 {PROSE} 10", f"{PROSE} 1 such. Another thheing of orwh onaton reing reesst ndennt and whou takes 31", f"{PROSE} $$$ 4072374829496490",
    f"{PROSE}. $ 5,500,000***", "$$$ 123456", f"{PROSE} with debt", "A 7 MW", "12 gw***", None, "", f"{PROSE} $$$ 170.116.163.254###",
]


def same(spark, tmp_path, name):
    rows = [(n, t, f"src{n % 3}") for n, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = catalog.QUERIES[name](spark, str(tmp_path))
    want = sorted(con.sql(f"SELECT {', '.join(found.columns)} FROM ({catalog.ORACLES[name]})").fetchall(), key=str)
    assert sorted(map(tuple, found.collect()), key=str) == want and len(want) >= len(TEXTS)


def test_evidence_claims(spark, tmp_path):
    same(spark, tmp_path, "evidence_claims")


def test_text_metrics(spark, tmp_path):
    same(spark, tmp_path, "text_metrics")
