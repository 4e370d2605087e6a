"""What comes in over time: content changes between two snapshots, their impact on decisions, look-back windows, packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import keyed

from .base import EVIDENCE, evidence, registry, reviews, table

QUERIES, ORACLES, query = registry()

#: The day on which the look-back windows end, and the bounds of a briefing.
AS_OF, SINCE, UNTIL = "2022-06-01", "2021-01-01", "2021-03-31"

SNAPSHOTS = f"""WITH {EVIDENCE}, a AS (SELECT doc_id, company, sha256(text) AS h FROM ev WHERE doc_id % 5 <> 0),
    b AS (SELECT doc_id, company, sha256(CASE WHEN doc_id % 7 = 0 THEN text || ' (revised)' ELSE text END) AS h FROM ev WHERE doc_id % 5 <> 1),
    ch AS (SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, coalesce(b.company, a.company) AS company, coalesce(b.h, a.h) AS content_hash,
    CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'new' WHEN a.h <> b.h THEN 'changed' ELSE 'same' END AS action FROM a FULL JOIN b USING (doc_id))"""


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes between two snapshots of the evidence, which together hold every row: some rows are only in one, some are revised."""
    ev = evidence(spark, sf_dir).select("doc_id", "company", "text")
    revised = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" (revised)"))).otherwise(F.col("text"))
    return keyed.changes(ev.filter("doc_id % 5 <> 0"), ev.filter("doc_id % 5 <> 1").withColumn("text", revised), "doc_id", "text", ["company"])


@query(f"{SNAPSHOTS} SELECT doc_id, company, content_hash, action FROM ch")
def incremental_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sync has to write: new, changed, missing and same evidence, by digest, so that no text is shuffled."""
    return _snapshots(spark, sf_dir)


@query(f"""{SNAPSHOTS} SELECT company, count(*) AS accepted, count(*) FILTER (WHERE action = 'missing') AS removed, count(*) FILTER (WHERE action = 'changed') AS changed,
    count(*) FILTER (WHERE action IN ('missing', 'changed')) AS reset FROM ch WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY company""")
def promotion_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted evidence that promoting the second snapshot removes or changes; its decisions are reset."""
    accepted = reviews(spark, sf_dir).filter("status = 'accepted'").select("doc_id")
    hit = _snapshots(spark, sf_dir).select("doc_id", "company", "action").join(accepted, "doc_id", "left_semi")
    count = lambda *actions: F.count_if(F.col("action").isin(*actions))
    return hit.groupBy("company").agg(F.count("*").alias("accepted"), count("missing").alias("removed"), count("changed").alias("changed"), count("missing", "changed").alias("reset"))


@query(f"""WITH {EVIDENCE} SELECT doc_id, company, d, source_quality FROM ev WHERE source_quality >= 70 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
    AND doc_id NOT IN (SELECT vec_id * 3 FROM embeddings) ORDER BY source_quality DESC, d DESC, doc_id LIMIT 100""")
def backfill_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hundred accepted evidence rows that have no vector yet; vector n belongs to document 3 n."""
    held = table(spark, sf_dir, "embeddings").select((F.col("vec_id") * 3).alias("doc_id"))
    ready = evidence(spark, sf_dir).filter("source_quality >= 70").select("doc_id", "company", "d", "source_quality")
    ready = ready.join(reviews(spark, sf_dir).filter("status = 'accepted'").select("doc_id"), "doc_id", "left_semi").join(held, "doc_id", "left_anti")
    return ready.orderBy(F.desc("source_quality"), F.desc("d"), "doc_id").limit(100)


@query(f"""WITH {EVIDENCE} SELECT company, max(d) FILTER (WHERE d <= DATE '{AS_OF}') AS newest, count(*) FILTER (WHERE d BETWEEN DATE '{AS_OF}' - 120 AND DATE '{AS_OF}') AS in_120_days,
    count(*) FILTER (WHERE d BETWEEN DATE '{AS_OF}' - 365 AND DATE '{AS_OF}') AS in_365_days, count(*) FILTER (WHERE d < DATE '{AS_OF}' - 365) AS older FROM ev GROUP BY company""")
def look_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much evidence the event window (120 days) and the catalog cutoff (365 days) reach, by company."""
    d, end = F.col("d"), F.lit(AS_OF).cast("date")
    since = lambda days: F.count_if(d.between(F.date_sub(end, days), end))
    newest = F.max(F.when(d <= end, d)).alias("newest")
    older = F.count_if(d < F.date_sub(end, 365)).alias("older")
    return evidence(spark, sf_dir).groupBy("company").agg(newest, since(120).alias("in_120_days"), since(365).alias("in_365_days"), older)


@query(f"""WITH {EVIDENCE}, r AS (SELECT doc_id, quality FROM labels), j AS (SELECT ev.*, r.quality AS q FROM ev LEFT JOIN r USING (doc_id) WHERE d BETWEEN DATE '{SINCE}' AND DATE '{UNTIL}')
    SELECT company, count(*) AS added, count(*) FILTER (WHERE q = 1) AS accepted, count(*) FILTER (WHERE q IS NULL) AS open, arg_max(doc_id, (source_quality, d, doc_id)) AS best FROM j GROUP BY company""")
def window_briefing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came in between two days, both included, what of it is decided, and the best of it, by company."""
    rows = evidence(spark, sf_dir).filter(F.col("d").between(SINCE, UNTIL)).select("doc_id", "company", "d", "source_quality")
    rows = rows.join(reviews(spark, sf_dir).select("doc_id", "status"), "doc_id", "left")
    best = F.max(F.struct("source_quality", "d", "doc_id"))["doc_id"].alias("best")
    return rows.groupBy("company").agg(F.count("*").alias("added"), F.count_if(F.col("status") == "accepted").alias("accepted"), F.count_if(F.col("status").isNull()).alias("open"), best)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations)
    SELECT conv_id, count(*) AS passages, count(DISTINCT role) AS kinds, string_agg(substr(coalesce(text, ''), 1, 200), ' | ' ORDER BY n) FILTER (WHERE n <= 5) AS excerpts FROM r GROUP BY conv_id""")
def document_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of a document: how many, of how many kinds, and the first five as excerpts. Conversations stand for documents."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("passages"), F.count_distinct("role").alias("kinds"))
    first = keyed.best_rows(turns, ["conv_id"], [F.asc("turn"), F.asc("role"), F.asc("text")], 5, "n")
    cut = F.struct("n", F.substring(F.coalesce("text", F.lit("")), 1, 200).alias("x"))
    excerpts = first.groupBy("conv_id").agg(F.concat_ws(" | ", F.transform(F.array_sort(F.collect_list(cut)), lambda s: s["x"])).alias("excerpts"))
    return sizes.join(excerpts, "conv_id")


@query("""SELECT o_custkey, count(*) AS statements, arg_max(o_orderkey, (o_orderdate::DATE, o_orderkey)) AS current, max(o_orderkey) AS last_arrival,
    arg_max(o_orderdate::DATE, o_orderkey) < max(o_orderdate::DATE) AS last_is_late FROM orders GROUP BY o_custkey""")
def late_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current statement of each key by the day it is valid from; one that arrives late is kept and replaces nothing newer.

    Orders stand for statements: valid from their date, arriving in the order of their keys.
    """
    day = F.col("o_orderdate").cast("date")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", day.alias("d"))
    late = F.max_by("d", "o_orderkey") < F.max("d")
    current = F.max(F.struct("d", "o_orderkey"))["o_orderkey"].alias("current")
    return rows.groupBy("o_custkey").agg(F.count("*").alias("statements"), current, F.max("o_orderkey").alias("last_arrival"), late.alias("last_is_late"))


@query(f"""WITH {EVIDENCE}, g AS (SELECT company, year(d)::INTEGER AS y, quarter(d)::INTEGER AS q, count(*) FILTER (WHERE kind = 'sec') AS filings, count(*) FILTER (WHERE kind = 'ir') AS releases,
    min(d) AS first_day, max(d) AS last_day FROM ev GROUP BY ALL) SELECT *, CASE WHEN filings > 0 AND releases > 0 THEN 'complete' WHEN filings > 0 THEN 'filings only' ELSE 'releases only' END AS package FROM g""")
def package_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The package of each company and quarter: its filings and releases, and whether both kinds are there."""
    rows = evidence(spark, sf_dir).groupBy("company", F.year("d").alias("y"), F.quarter("d").alias("q"))
    built = rows.agg(F.count_if(F.col("kind") == "sec").alias("filings"), F.count_if(F.col("kind") == "ir").alias("releases"), F.min("d").alias("first_day"), F.max("d").alias("last_day"))
    both = (F.col("filings") > 0) & (F.col("releases") > 0)
    return built.withColumn("package", F.when(both, "complete").when(F.col("filings") > 0, "filings only").otherwise("releases only"))
