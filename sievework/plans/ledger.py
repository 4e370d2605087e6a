"""Ledger: periods, metrics, conflicts, commitments, support scores, events, lineage, evaluation and operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions import text
from sievework.operators import keyed, lineage, temporal
from sievework.sources import flatten
from sievework.streaming import events as feeds

from .base import EVIDENCE, REVIEWS, evidence, reviews, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value by customer nation and quarter, in whole units."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", F.trunc("o_orderdate", "quarter").alias("quarter"))
    nations = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    return orders.join(nations, "o_custkey").groupBy("nation", "quarter").agg(F.sum(F.round("o_totalprice").cast("long")).alias("value"), F.count("*").alias("orders"))


QUARTERS = "qt AS (SELECT c_nationkey AS nation, date_trunc('quarter', o_orderdate)::DATE AS quarter, sum(round(o_totalprice)::BIGINT)::BIGINT AS value, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
CHANGE = """CASE WHEN before IS NULL THEN 'new' WHEN before = 0 THEN CASE WHEN value = before THEN 'unchanged' ELSE 'changed' END WHEN abs(delta_percent) <= 2 THEN 'unchanged' WHEN delta_percent > 0 THEN 'increased' ELSE 'decreased' END AS direction,
    delta_percent, CASE WHEN before IS NULL THEN 'medium' WHEN abs(delta_percent) >= 25 THEN 'high' WHEN abs(delta_percent) >= 10 THEN 'medium' ELSE 'low' END AS significance"""


@query(f"WITH {QUARTERS} SELECT nation, count(*) AS quarters, max(value) AS most, arg_max(quarter, value) AS best, sum(orders)::BIGINT AS orders FROM qt GROUP BY nation")
def period_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarters(spark, sf_dir).groupBy("nation").agg(F.count("*").alias("quarters"), F.max("value").alias("most"), F.max_by("quarter", "value").alias("best"), F.sum("orders").alias("orders"))


@query(f"WITH {QUARTERS}, l AS (SELECT *, lag(value) OVER (PARTITION BY nation ORDER BY quarter) AS before FROM qt), p AS (SELECT *, CASE WHEN before <> 0 THEN floor((value - before)::DOUBLE / abs(before) * 100 + 0.5::DOUBLE)::INTEGER END AS delta_percent FROM l) SELECT nation, quarter, value, {CHANGE} FROM p")
def period_over_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("value").over(Window.partitionBy("nation").orderBy("quarter"))
    rows = quarters(spark, sf_dir).withColumn("before", before)
    return rows.select("nation", "quarter", "value", text.change(F.col("value").cast("double"), F.col("before").cast("double")).alias("c")).select("nation", "quarter", "value", "c.*")


@query(f"WITH {QUARTERS} SELECT nation, year(quarter)::INTEGER AS year, " + ", ".join(f"sum(value) FILTER (WHERE quarter(quarter) = {q})::BIGINT AS q{q}" for q in (1, 2, 3, 4)) + " FROM qt GROUP BY 1, 2")
def metric_matrix_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quarters(spark, sf_dir).select("nation", F.year("quarter").alias("year"), F.concat(F.lit("q"), F.quarter("quarter")).alias("q"), "value")
    return rows.groupBy("nation", "year").pivot("q", ["q1", "q2", "q3", "q4"]).sum("value")


@query("""SELECT l_partkey, l_suppkey, max(l_quantity) AS most, min(l_quantity) AS least, min(abs(l_quantity)) AS floor, count(DISTINCT l_returnflag) AS sources, bool_or(l_linestatus = 'F') AS anchored, count(*) AS rows
    FROM lineitem GROUP BY 1, 2 HAVING bool_or(l_linestatus = 'F') AND count(DISTINCT l_returnflag) >= 2 AND max(l_quantity) - min(l_quantity) > greatest(1.0, min(abs(l_quantity))) * 0.02""")
def metric_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.conflicts(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], "l_quantity", "l_returnflag", F.col("l_linestatus") == "F")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END DESC, o_orderdate DESC, o_orderpriority, o_orderkey) AS r FROM orders WHERE o_orderpriority <> '5-LOW')
    SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority FROM r WHERE r = 1""")
def preferred_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").filter("o_orderpriority <> '5-LOW'")
    status = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    best = keyed.best_rows(rows, ["o_custkey"], [status.desc(), F.desc("o_orderdate"), F.asc("o_orderpriority"), F.asc("o_orderkey")])
    return best.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")


REGIMES = "rg AS (SELECT n_nationkey AS nation, 'a' AS regime, DATE '1995-01-01' AS f, DATE '1997-06-30' AS t FROM nation UNION ALL SELECT n_nationkey, 'b', DATE '1997-07-01', NULL FROM nation WHERE n_nationkey % 2 = 0)"


def _regimes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"))
    day = lambda s: F.lit(s).cast("date")
    first = nations.select("nation", F.lit("a").alias("regime"), day("1995-01-01").alias("f"), day("1997-06-30").alias("t"))
    second = nations.filter("nation % 2 = 0").select("nation", F.lit("b").alias("regime"), day("1997-07-01").alias("f"), F.lit(None).cast("date").alias("t"))
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d")).join(owners, "o_custkey").select("o_orderkey", "nation", "d")
    return orders, first.union(second)


@query(f"WITH {REGIMES} SELECT o_orderkey, c_nationkey AS nation, o_orderdate::DATE AS d, regime FROM orders JOIN customer ON o_custkey = c_custkey JOIN rg ON c_nationkey = nation AND o_orderdate::DATE >= f AND o_orderdate::DATE <= coalesce(t, DATE '9999-12-31')")
def regime_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.in_interval(*_regimes(spark, sf_dir), "nation", "d", "f", "t").select("o_orderkey", "nation", "d", "regime")


@query(f"WITH {REGIMES} SELECT o_orderkey, c_nationkey AS nation, o_orderdate::DATE AS d FROM orders JOIN customer ON o_custkey = c_custkey WHERE NOT EXISTS (SELECT 1 FROM rg WHERE c_nationkey = nation AND o_orderdate::DATE >= f AND o_orderdate::DATE <= coalesce(t, DATE '9999-12-31'))")
def regime_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.in_interval(*_regimes(spark, sf_dir), "nation", "d", "f", "t", "left_anti").select("o_orderkey", "nation", "d")


@query("""WITH a AS (SELECT o_custkey AS k, o_orderkey AS aid, o_orderdate::DATE AS ad FROM orders WHERE o_orderpriority = '1-URGENT'), r AS (SELECT o_custkey AS k, o_orderkey AS rid, o_orderdate::DATE AS d FROM orders WHERE o_orderpriority <> '1-URGENT'),
    c AS (SELECT rid, aid, abs(d - ad)::INTEGER AS days, row_number() OVER (PARTITION BY rid ORDER BY abs(d - ad), aid) AS n FROM r JOIN a USING (k) WHERE abs(d - ad) <= 35) SELECT r.rid AS o_orderkey, aid AS anchor_id, days FROM r LEFT JOIN c ON c.rid = r.rid AND n = 1""")
def nearest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("d"), "o_orderpriority")
    anchors = rows.filter("o_orderpriority = '1-URGENT'").select("o_custkey", F.col("d").alias("ad"), F.col("o_orderkey").alias("aid"))
    return temporal.nearest(rows.filter("o_orderpriority <> '1-URGENT'"), anchors, "o_custkey", "d", "ad", "aid", 35, "o_orderkey")


@query("""WITH w AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS d, round(o_totalprice)::BIGINT AS target, row_number() OVER p AS sequence, lag(round(o_totalprice)::BIGINT) OVER p AS previous_value FROM orders WINDOW p AS (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey))
    SELECT o_custkey, o_orderkey, d, target, sequence::INTEGER AS sequence, previous_value, CASE WHEN previous_value IS NULL THEN 'initiated' WHEN target > previous_value THEN 'raised' WHEN target < previous_value THEN 'lowered' ELSE 'reaffirmed' END AS kind FROM w""")
def commitment_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("d"), F.round("o_totalprice").cast("long").alias("target"))
    return temporal.revisions(rows, "o_custkey", "d", "o_orderkey", "target")


@query("SELECT o_custkey, max(o_orderdate) AS valid_from, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS o_orderkey FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey")
def current_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    return rows.groupBy("o_custkey").agg(F.max("o_orderdate").alias("valid_from"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("""WITH RECURSIVE e AS (SELECT user_id, ts::DATE AS d, (CASE event_type WHEN 'purchase' THEN 12 WHEN 'click' THEN 3 WHEN 'view' THEN 1 ELSE -7 END)::INTEGER AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts::DATE, event_id) AS n FROM events),
    f AS (SELECT user_id, d, n, greatest(10, least(90, 50 + x)) AS score FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.d, e.n, greatest(10, least(90, f.score + e.x)) FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
    SELECT user_id, d, arg_max(score, n)::INTEGER AS score, max(n)::BIGINT AS n FROM f GROUP BY user_id, d""")
def support_score_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    delta = F.when(kind == "purchase", 12).when(kind == "click", 3).when(kind == "view", 1).otherwise(-7)
    steps = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("d"), "event_id", delta.alias("delta"))
    return temporal.saturating_path(steps, "user_id", "d", "event_id", "delta")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, count(*) > 3 AS over_limit FROM events GROUP BY 1, 2")
def tumbling_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.rates(table(spark, sf_dir, "events"), ["event_type"], "ts", "1 hour", 3)


@query("SELECT sha256(concat(user_id, '|', event_type)) AS fingerprint, user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS seen FROM events GROUP BY user_id, event_type")
def event_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.latest_events(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts")


@query("""WITH s AS (SELECT event_id, user_id, event_type, (greatest(35, least(98, 42 + (floor(value) % 5)::INTEGER * 13 + CASE WHEN event_type = 'purchase' THEN 12 ELSE 0 END)))::INTEGER AS materiality FROM events)
    SELECT event_id, user_id, materiality, greatest(2, floor(materiality / 12.0::DOUBLE + 0.5::DOUBLE))::INTEGER AS impact, CASE WHEN materiality >= 82 THEN 'high' WHEN materiality >= 68 THEN 'medium' ELSE 'none' END AS alert FROM s""")
def event_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = 42 + (F.floor("value") % 5).cast("int") * 13 + F.when(F.col("event_type") == "purchase", 12).otherwise(0)
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.greatest(F.lit(35), F.least(F.lit(98), base)).alias("materiality"))
    m = F.col("materiality")
    return rows.withColumns({"impact": F.greatest(F.lit(2), text.rounded(m / 12)), "alert": F.when(m >= 82, "high").when(m >= 68, "medium").otherwise("none")})


@query("""WITH g AS (SELECT user_id, event_type, ts::DATE AS d, count(*) AS events, max(value) AS most, arg_max(event_id, struct_pack(v := value, i := event_id)) AS event_id FROM events GROUP BY 1, 2, 3) SELECT * FROM g WHERE events > 1""")
def alert_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type", F.to_date("ts").alias("d"))
    return rows.agg(F.count("*").alias("events"), F.max("value").alias("most"), F.max_by("event_id", F.struct("value", "event_id")).alias("event_id")).filter("events > 1")


@query(f"""WITH {EVIDENCE}, {REVIEWS}, n AS (SELECT 'company:' || company AS id, 'company' AS kind, company AS label FROM ev UNION SELECT 'document:' || doc_id, 'document', kind FROM ev UNION SELECT 'claim:' || item_id, 'claim', text FROM benchmark) SELECT id, kind, min(label) AS label FROM n GROUP BY id, kind""")
def lineage_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[0]


@query(f"""WITH {EVIDENCE}, {REVIEWS} SELECT DISTINCT 'company:' || company AS source, 'document:' || doc_id AS target, 'published' AS relation FROM ev
    UNION SELECT 'document:' || doc_id, 'claim:' || (doc_id % 60), 'supports' FROM rv WHERE status = 'accepted' AND doc_id % 60 IN (SELECT item_id FROM benchmark) AND doc_id IN (SELECT doc_id FROM ev)""")
def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[1]


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ev = evidence(spark, sf_dir).select("doc_id", "company", "kind")
    claims = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("label"))
    known = lineage.nodes([lineage.node(ev, "company", "company", "company"), lineage.node(ev, "document", "doc_id", "kind"), lineage.node(claims, "claim", "item_id", "label")])
    cited = reviews(spark, sf_dir).filter("status = 'accepted'").withColumn("item", F.col("doc_id") % 60)
    parts = [lineage.edge(ev, ("company", "company"), ("document", "doc_id"), "published"), lineage.edge(cited, ("document", "doc_id"), ("claim", "item"), "supports")]
    return known, lineage.edges(parts, known)


@query(f"""WITH {EVIDENCE}, {REVIEWS}, c AS (SELECT company, count(*) AS documents, count(*) FILTER (WHERE kind = 'sec') AS filings, count(status) AS reviewed, count(*) FILTER (WHERE status = 'accepted') AS accepted, max(d) AS latest FROM ev LEFT JOIN rv USING (doc_id) GROUP BY company)
    SELECT company, documents, filings, reviewed, accepted, latest, concat_ws(',', CASE WHEN filings < 26 THEN 'filings' END, CASE WHEN reviewed < 20 THEN 'reviews' END, CASE WHEN accepted < 18 THEN 'accepted' END) AS gaps FROM c""")
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence(spark, sf_dir).drop("text").join(reviews(spark, sf_dir), "doc_id", "left").groupBy("company").agg(
        F.count("*").alias("documents"), F.count_if(F.col("kind") == "sec").alias("filings"), F.count("status").alias("reviewed"), F.count_if(F.col("status") == "accepted").alias("accepted"), F.max("d").alias("latest")
    )
    gap = lambda c, least, name: F.when(F.col(c) < least, name)
    return rows.withColumn("gaps", F.concat_ws(",", gap("filings", 26, "filings"), gap("reviewed", 20, "reviews"), gap("accepted", 18, "accepted")))


@query("SELECT sha256(coalesce(html, '')) AS content_hash, octet_length(encode(coalesce(html, '')))::BIGINT AS size, min(page_id) AS page_id, count(*) AS writes, concat_ws('/', 'sha256', sha256(coalesce(html, ''))[1:2], sha256(coalesce(html, ''))[3:4], sha256(coalesce(html, ''))) AS storage_key FROM pages GROUP BY coalesce(html, '')")
def content_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))
    return flatten.archive(pages, "page_id", "content")


@query(r"""WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>') AS l FROM pages), u AS (SELECT page_id, unnest(l) AS a, generate_subscripts(l, 1) - 1 AS position FROM a)
    SELECT page_id, position::INTEGER AS position, regexp_extract(a, '(?i)href="([^"]*)"', 1) AS href, trim(regexp_replace(a, '(?s)<[^>]*>', '', 'g')) AS title FROM u""")
def link_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.links(table(spark, sf_dir, "pages"), "page_id", "html")


@query("""WITH o AS (SELECT s_nationkey AS k, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rn FROM suppliers_v), r AS (SELECT *, row_number() OVER (ORDER BY rn, k) AS pick FROM o) SELECT k AS nation, s_suppkey, rn::INTEGER AS rn FROM r WHERE pick <= 25""".replace("suppliers_v", "supplier"))
def round_robin_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 suppliers, the best of each nation first, then the second best, and so on."""
    ranked = keyed.best_rows(table(spark, sf_dir, "supplier"), ["s_nationkey"], [F.desc("s_acctbal"), F.asc("s_suppkey")], 25, "rn")
    return ranked.orderBy("rn", "s_nationkey").limit(25).select(F.col("s_nationkey").alias("nation"), "s_suppkey", "rn")


@query("""WITH a AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS q FROM lineitem WHERE l_linenumber <> 4), b AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_partkey % 4 = 0 THEN l_quantity + 1 ELSE l_quantity END AS q FROM lineitem WHERE l_linenumber <> 1)
    , a1 AS (SELECT k, n, sum(q) AS q FROM a GROUP BY k, n), b1 AS (SELECT k, n, sum(q) AS q FROM b GROUP BY k, n) SELECT k AS l_orderkey, count(*) FILTER (WHERE a1.q IS NULL) AS added, count(*) FILTER (WHERE b1.q IS NULL) AS removed, count(*) FILTER (WHERE a1.q <> b1.q) AS changed, count(*) FILTER (WHERE a1.q = b1.q) AS unchanged FROM a1 FULL JOIN b1 USING (k, n) GROUP BY k""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    by = ["l_orderkey", "l_linenumber"]
    old = lines.filter("l_linenumber <> 4").groupBy(*by).agg(F.sum("l_quantity").alias("a"))
    new = lines.filter("l_linenumber <> 1").groupBy(*by).agg(F.sum(F.when(F.col("l_partkey") % 4 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))).alias("b"))
    return old.join(new, by, "full_outer").groupBy("l_orderkey").agg(
        F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("b").isNull()).alias("removed"), F.count_if(F.col("a") != F.col("b")).alias("changed"), F.count_if(F.col("a") == F.col("b")).alias("unchanged")
    )


@query(f"""WITH {EVIDENCE}, {REVIEWS} SELECT company, concat_ws('; ', CASE WHEN count(status) * 100 < count(*) * 40 THEN 'too few reviews' END, CASE WHEN count(*) FILTER (WHERE status = 'accepted') * 100 < count(status) * 85 THEN 'too few accepted' END) AS reasons,
    count(status) * 100 >= count(*) * 40 AND count(*) FILTER (WHERE status = 'accepted') * 100 >= count(status) * 85 AS passed FROM ev LEFT JOIN rv USING (doc_id) GROUP BY company""")
def gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence(spark, sf_dir).select("doc_id", "company").join(reviews(spark, sf_dir), "doc_id", "left").groupBy("company").agg(F.count("*").alias("n"), F.count("status").alias("seen"), F.count_if(F.col("status") == "accepted").alias("ok"))
    few, poor = F.col("seen") * 100 < F.col("n") * 40, F.col("ok") * 100 < F.col("seen") * 85
    return rows.select("company", F.concat_ws("; ", F.when(few, "too few reviews"), F.when(poor, "too few accepted")).alias("reasons"), (~few & ~poor).alias("passed"))
