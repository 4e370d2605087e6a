"""What a comparison of filings moves and writes."""

from sievework.operators import filings as operator
from sievework.plans import filings

SF = "/root/testdata/sf0.001"


def test_passages_do_not_move(spark):
    assert "Exchange" not in filings._passages(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_texts_are_not_written(spark, monkeypatch):
    written = []
    monkeypatch.setattr(operator, "stored", lambda df, name, put=operator.stored: written.append(df.columns) or put(df, name))
    filings.filing_change_counts(spark, SF).count()
    assert written and not any("text" in columns for columns in written) and sum("tokens" in columns for columns in written) == 1
