"""The roles that the given tables play, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import rules, text


def registry() -> tuple[dict, dict, Callable]:
    """Queries and oracles of a module by name, and a decorator that adds a query with its oracle."""
    queries: dict = {}
    oracles: dict = {}

    def query(sql: str):
        def add(f):
            queries[f.__name__] = f
            oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as evidence: company, kind, date and source quality follow from source and number."""
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        F.col("source").alias("company"),
        F.when(n % 2 == 0, "sec").otherwise("ir").alias("kind"),
        F.date_add(F.lit("2020-01-01").cast("date"), (n % 1000).cast("int")).alias("d"),
        (60 + n % 40).cast("int").alias("source_quality"),
    )


EVIDENCE = """ev AS (SELECT doc_id, coalesce(text, '') AS text, source AS company, CASE WHEN doc_id % 2 = 0 THEN 'sec' ELSE 'ir' END AS kind,
    DATE '2020-01-01' + (doc_id % 1000)::INTEGER AS d, (60 + doc_id % 40)::INTEGER AS source_quality FROM documents)"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as a team's decisions."""
    status = F.when(F.col("quality") == 1, "accepted").otherwise("rejected")
    return table(spark, sf_dir, "labels").select("doc_id", status.alias("status"), "toxic")


REVIEWS = "rv AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'accepted' ELSE 'rejected' END AS status, toxic FROM labels)"


def scored(df: DataFrame) -> DataFrame:
    """quality, materiality, specificity, relevance and risk of `text`, by rules that fit the prose."""
    value = F.col("text")
    nbsp = F.contains(value, F.lit("\u00a0"))  # parts words of the cleaned text, but not of this one
    signals = text.readability_risk(df, "text", rules.PROSE_LABELS, words="n_words").withColumns(
        {
            "said": F.array_distinct(F.regexp_extract_all(F.lower(value), F.lit(text.word(f"{rules.PROSE_MATERIAL}|{rules.PROSE_SPECIFIC}")), F.lit(0))),
            "n_words": F.when(nbsp, F.regexp_count(value, F.lit(r"[^ \t\n\x0B\f\r]+"))).otherwise(F.col("n_words")),
            "risk": F.greatest(F.lit(5), "risk"),
        }
    )
    of = lambda words: F.size(F.filter("said", lambda w: w.rlike(f"^(?:{words})$")))
    counted = signals.withColumns({"material": of(rules.PROSE_MATERIAL), "specific": of(rules.PROSE_SPECIFIC)}).drop("said")
    scores = counted.withColumns(
        {
            "materiality": text.score(20 + F.col("material") * 11 + F.col("specific") * 7),
            "specificity": text.score(16 + F.col("specific") * 16 + F.when(F.col("n_words") >= 35, 12).otherwise(0) + F.when(F.col("n_words") >= 80, 8).otherwise(0)),
            "relevance": text.score(12 + F.col("material") * 14),
        }
    )
    total = F.col("source_quality") * 0.2 + F.col("materiality") * 0.3 + F.col("specificity") * 0.18 + F.col("relevance") * 0.32 - F.col("risk") * 0.38
    cap = F.when(F.col("risk") >= 70, 34).when(F.col("risk") >= 50, 44).otherwise(100)
    return scores.withColumn("quality", F.least(cap, text.score(total)))


_B = r"\b(?:{})\b"
CLEAN = r"trim(regexp_replace(replace(text, chr(160), ' '), '[ \t\n\x0B\f\r]+', ' ', 'g'))"
SCORED = rf"""
    s0 AS (SELECT *, {CLEAN} AS c FROM ev),
    s1 AS (SELECT *, list_filter(string_split(c, ' '), lambda w: w <> '') AS parts, len(regexp_extract_all(c, '[.!?](?:\s|$)')) AS marks,
        len(regexp_extract_all(c, '\b20\d{{2}}\b')) AS years, len(regexp_extract_all(c, '(?i){_B.format(rules.PROSE_LABELS)}')) AS churn,
        len(list_distinct(regexp_extract_all(lower(text), '(?i){_B.format(rules.PROSE_MATERIAL)}'))) AS material,
        len(list_distinct(regexp_extract_all(lower(text), '(?i){_B.format(rules.PROSE_SPECIFIC)}'))) AS specific,
        len(list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS n_words FROM s0),
    s2 AS (SELECT *, CASE WHEN len(parts) = 0 THEN 100 ELSE least(100, (CASE WHEN len(parts) >= 25 AND marks = 0 THEN 35 ELSE 0 END)
        + (CASE WHEN len(parts) >= 45 AND marks = 0 THEN 20 ELSE 0 END) + (CASE WHEN len(parts) >= 80 AND marks <= 1 THEN 25 ELSE 0 END)
        + (CASE WHEN len(list_filter(parts, lambda w: regexp_matches(w, '[0-9]')))::DOUBLE / greatest(len(parts), 1) > 0.28 THEN 30 ELSE 0 END)
        + (CASE WHEN years >= 4 THEN 25 ELSE 0 END) + (CASE WHEN churn >= 10 AND marks <= 2 THEN 25 ELSE 0 END)
        + (CASE WHEN regexp_matches(c, '^[a-z]{{2,}}\s') THEN 20 ELSE 0 END)) END AS readability FROM s1),
    s3 AS (SELECT *, greatest(5, readability) AS risk, greatest(0, least(100, 20 + material * 11 + specific * 7)) AS materiality,
        greatest(0, least(100, 16 + specific * 16 + (CASE WHEN n_words >= 35 THEN 12 ELSE 0 END) + (CASE WHEN n_words >= 80 THEN 8 ELSE 0 END))) AS specificity,
        greatest(0, least(100, 12 + material * 14)) AS relevance FROM s2),
    sc AS (SELECT *, least(CASE WHEN risk >= 70 THEN 34 WHEN risk >= 50 THEN 44 ELSE 100 END, greatest(0, least(100,
        floor(source_quality::DOUBLE * 0.2::DOUBLE + materiality::DOUBLE * 0.3::DOUBLE + specificity::DOUBLE * 0.18::DOUBLE + relevance::DOUBLE * 0.32::DOUBLE - risk::DOUBLE * 0.38::DOUBLE + 0.5::DOUBLE)::INTEGER)))::INTEGER AS quality FROM s3)"""


def fnv_sql(x: str) -> str:
    codes = f"list_transform(list_filter(string_split({x}, ''), lambda c: c <> ''), lambda c: unicode(c)::BIGINT)"
    return f"lower(to_hex(list_reduce({codes}, lambda a, b: (xor(a, b) * 16777619) % 4294967296, 2166136261::BIGINT)))"
