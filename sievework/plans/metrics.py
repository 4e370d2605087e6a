"""Metrics: periods, observations and their policy, comparisons, commitments and their outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions import rules, text
from sievework.operators import keyed, temporal

from .base import registry, table
from .ledger import QUARTERS, quarters

QUERIES, ORACLES, query = registry()

ORDERS = "od AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS d, round(o_totalprice)::BIGINT AS value, o_orderpriority, o_orderstatus FROM orders)"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"), F.round("o_totalprice").cast("long").alias("value"), "o_orderpriority", "o_orderstatus")


@query(f"""WITH {ORDERS} SELECT o_orderkey, 'calendar:' || year(d) || '-Q' || quarter(d) AS period_key, 'Calendar Q' || quarter(d) || ' ' || year(d) AS label, date_trunc('quarter', d)::DATE AS period_start,
    (date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS period_end, (date_trunc('month', d) - INTERVAL 2 MONTH)::DATE AS quarter_before FROM od""")
def calendar_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar quarter of each date, and the start of the three months that end with its month."""
    d = F.col("d")
    start = F.trunc(d, "quarter")
    return orders(spark, sf_dir).select(
        "o_orderkey",
        F.concat(F.lit("calendar:"), F.year(d), F.lit("-Q"), F.quarter(d)).alias("period_key"),
        F.concat(F.lit("Calendar Q"), F.quarter(d), F.lit(" "), F.year(d)).alias("label"),
        start.alias("period_start"),
        F.date_sub(F.add_months(start, 3), 1).alias("period_end"),
        F.add_months(F.trunc(d, "month"), -2).alias("quarter_before"),
    )


# Titles as documents have them, from an order's own date; which form a title has follows from its number.
_WORDS = ["first", "second", "third", "fourth"]
_TITLE_SQL = """CASE o_orderkey % 5 WHEN 0 THEN 'Results for Q' || quarter(d) || ' ' || year(d) WHEN 1 THEN 'Report on the ' || ['first', 'second', 'third', 'fourth'][quarter(d)] || ' quarter of ' || year(d)
    WHEN 2 THEN 'Full year ' || year(d) || ' letter' WHEN 3 THEN 'Q' || quarter(d) || '/FY' || lpad((year(d) % 100)::VARCHAR, 2, '0') || ' update' ELSE 'News of the company' END"""


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, form = F.col("d"), F.col("o_orderkey") % 5
    title = F.when(form == 0, F.concat(F.lit("Results for Q"), F.quarter(d), F.lit(" "), F.year(d)))
    title = title.when(form == 1, F.concat(F.lit("Report on the "), F.element_at(F.array(*map(F.lit, _WORDS)), F.quarter(d)), F.lit(" quarter of "), F.year(d)))
    title = title.when(form == 2, F.concat(F.lit("Full year "), F.year(d), F.lit(" letter"))).when(form == 3, F.concat(F.lit("Q"), F.quarter(d), F.lit("/FY"), F.date_format(d, "yy"), F.lit(" update")))
    return orders(spark, sf_dir).withColumn("title", title.otherwise("News of the company"))


def explicit_period(title: Column) -> Column:
    """kind, fiscal_year, fiscal_quarter and label that a title names, null where it names none."""
    short, spelt, annual = r"(?i)\bQ([1-4])\s*(?:/\s*)?(?:FY\s*)?'?(\d{2,4})\b", r"(?i)\b(?:fiscal\s+)?(first|second|third|fourth)\s+quarter(?:\s+and\s+full\s+year)?(?:\s+of)?\s+(?:FY\s*)?'?(\d{2,4})\b", r"(?i)\b(?:full\s+year|FY)\s*'?(\d{2,4})\b"
    year_of = lambda y: F.when(y.cast("int") < 100, y.cast("int") + 2000).otherwise(y.cast("int"))
    word = F.array_position(F.array(*map(F.lit, _WORDS)), F.lower(F.regexp_extract(title, spelt, 1))).cast("int")
    has_short = title.rlike(short)
    quarter = F.when(has_short, F.try_to_number(F.regexp_extract(title, short, 1), F.lit("9")).cast("int")).otherwise(word)
    year = year_of(F.try_to_number(F.when(has_short, F.regexp_extract(title, short, 2)).otherwise(F.regexp_extract(title, spelt, 2)), F.lit("9999")))
    full = year_of(F.try_to_number(F.regexp_extract(title, annual, 1), F.lit("9999")))
    of = lambda kind, y, q, label: F.struct(F.lit(kind).alias("kind"), y.alias("fiscal_year"), q.alias("fiscal_quarter"), label.alias("label"))
    named = F.when(has_short | title.rlike(spelt), of("quarter", year, quarter, F.concat(F.lit("Q"), quarter, F.lit(" FY"), year)))
    return named.when(title.rlike(annual), of("annual", full, F.lit(None).cast("int"), F.concat(F.lit("FY"), full)))


@query(f"""WITH {ORDERS}, t AS (SELECT *, {_TITLE_SQL} AS title FROM od) SELECT o_orderkey, title, CASE WHEN o_orderkey % 5 IN (0, 1, 3) THEN 'quarter' WHEN o_orderkey % 5 = 2 THEN 'annual' END AS kind,
    CASE WHEN o_orderkey % 5 = 3 THEN 2000 + year(d) % 100 WHEN o_orderkey % 5 < 3 THEN year(d) END::INTEGER AS fiscal_year, CASE WHEN o_orderkey % 5 IN (0, 1, 3) THEN quarter(d) END::INTEGER AS fiscal_quarter FROM t""")
def explicit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fiscal period that a title names; the oracle knows it from the dates that the titles were made of."""
    rows = _titled(spark, sf_dir).withColumn("p", explicit_period(F.col("title")))
    return rows.select("o_orderkey", "title", "p.kind", "p.fiscal_year", "p.fiscal_quarter")


@query(f"""WITH {ORDERS}, t AS (SELECT *, {_TITLE_SQL} AS title FROM od), a AS (SELECT o_custkey, d AS ad, o_orderkey AS aid FROM od WHERE o_orderpriority = '1-URGENT'),
    n AS (SELECT t.o_orderkey, aid, abs(t.d - ad) AS days, row_number() OVER (PARTITION BY t.o_orderkey ORDER BY abs(t.d - ad), aid) AS r FROM t JOIN a USING (o_custkey) WHERE abs(t.d - ad) <= 35 AND t.o_orderpriority <> '1-URGENT'),
    m AS (SELECT t.*, aid, days FROM t LEFT JOIN n ON n.o_orderkey = t.o_orderkey AND r = 1)
    SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'reported' WHEN aid IS NOT NULL THEN 'anchored' WHEN o_orderkey % 5 < 4 THEN 'explicit' ELSE 'calendar' END AS method,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 100 WHEN aid IS NOT NULL THEN CASE WHEN days <= 7 THEN 95 ELSE 82 END WHEN o_orderkey % 5 < 4 THEN 90 ELSE 45 END::INTEGER AS confidence FROM m""")
def period_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each document's period is found: reported, that of the nearest anchor of its company, named by its title, or the calendar's."""
    from sievework.operators import temporal

    rows = _titled(spark, sf_dir)
    anchors = rows.filter("o_orderpriority = '1-URGENT'").select("o_custkey", F.col("d").alias("ad"), F.col("o_orderkey").alias("aid"))
    near = temporal.nearest(rows.filter("o_orderpriority <> '1-URGENT'").select("o_orderkey", "o_custkey", "d"), anchors, "o_custkey", "d", "ad", "aid", 35, "o_orderkey")
    found = rows.join(near, "o_orderkey", "left").withColumn("p", explicit_period(F.col("title")))
    reported, anchored, named = F.col("o_orderpriority") == "1-URGENT", F.col("anchor_id").isNotNull(), F.col("p").isNotNull()
    method = F.when(reported, "reported").when(anchored, "anchored").when(named, "explicit").otherwise("calendar")
    sure = F.when(reported, 100).when(anchored, F.when(F.col("days") <= 7, 95).otherwise(82)).when(named, 90).otherwise(45)
    return found.select("o_orderkey", method.alias("method"), sure.alias("confidence"))


# Statements as filings make them, from an order's own number and date.
_STATEMENT_SQL = """CASE o_orderkey % 4 WHEN 0 THEN 'We plan 5 sites by the end of Q' || quarter(d) || ' ' || (year(d) + 20) WHEN 1 THEN 'Done by ' || monthname(d) || ' ' || (year(d) + 20) || '.' WHEN 2 THEN 'Growth through fiscal ' || (year(d) + 20) ELSE 'Soon.' END"""


def commitment_target(statement: Column) -> Column:
    """period_end and precision of the day that a statement promises something by."""
    quarter = r"(?i)\b(?:by|in|during|for)\s+(?:the\s+end\s+of\s+)?Q([1-4])\s+(20\d{2})\b"
    month = r"(?i)\bby\s+(?:the\s+end\s+of\s+)?(January|February|March|April|May|June|July|August|September|October|November|December)\s+(20\d{2})\b"
    year = r"(?i)\b(?:by|in|during|for|through)\s+(?:the\s+end\s+of\s+)?(?:fiscal\s+|FY\s*)?(20\d{2})\b"
    number = lambda p, i: F.try_to_number(F.regexp_extract(statement, p, i), F.lit("9999")).cast("int")
    named = F.to_date(F.try_to_timestamp(F.concat_ws(" ", F.lit("1"), F.initcap(F.regexp_extract(statement, month, 1)), F.regexp_extract(statement, month, 2)), F.lit("d MMMM yyyy")))
    of = lambda day, precision: F.struct(day.alias("period_end"), F.lit(precision).alias("precision"))
    out = F.when(statement.rlike(quarter), of(F.last_day(F.make_date(number(quarter, 2), number(quarter, 1) * 3, F.lit(1))), "quarter")).when(statement.rlike(month), of(F.last_day(named), "day"))
    return out.when(statement.rlike(year), of(F.make_date(number(year, 1), F.lit(12), F.lit(31)), "year")).otherwise(of(F.lit(None).cast("date"), "undated"))


@query(f"""WITH {ORDERS} SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN last_day(make_date(year(d) + 20, quarter(d) * 3, 1)) WHEN 1 THEN last_day(make_date(year(d) + 20, month(d), 1)) WHEN 2 THEN make_date(year(d) + 20, 12, 31) END::DATE AS period_end,
    ['quarter', 'day', 'year', 'undated'][(o_orderkey % 4)::INTEGER + 1] AS precision FROM od""")
def commitment_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that statements promise something by; the oracle knows them from the dates that the statements were made of."""
    d, form, later = F.col("d"), F.col("o_orderkey") % 4, F.year("d") + 20
    said = F.when(form == 0, F.concat(F.lit("We plan 5 sites by the end of Q"), F.quarter(d), F.lit(" "), later)).when(form == 1, F.concat(F.lit("Done by "), F.date_format(d, "MMMM"), F.lit(" "), later, F.lit(".")))
    said = said.when(form == 2, F.concat(F.lit("Growth through fiscal "), later)).otherwise("Soon.")
    return orders(spark, sf_dir).withColumn("said", said).withColumn("t", commitment_target(F.col("said"))).select("o_orderkey", "t.period_end", "t.precision")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS rows, CASE WHEN max(days) >= 300 THEN 'annual' WHEN max(days) >= 150 THEN 'year-to-date' WHEN max(days) >= 70 THEN 'quarter' ELSE 'other-duration' END AS period_type
    FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate::DATE - o_orderdate::DATE AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1, 2, 3""")
def period_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of period that the days from order to shipping span."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.max(F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")))
    kind = F.when(days >= 300, "annual").when(days >= 150, "year-to-date").when(days >= 70, "quarter").otherwise("other-duration")
    return rows.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.count("*").alias("rows"), kind.alias("period_type"))


# Contexts that an observation may stand in; which one follows from the order's number.
CONTEXTS = ["revenue of the campus", "prospectus supplement for securities", "increase in revenue of the segment by $4", "total addressable market", "our fleet", "grew by $3.5", "an industry estimate"]
KEYS = ["revenue", "capex", "power_capacity", "debt"]


def observation_flags(key: Column, context: Column, value: Column, source: Column) -> Column:
    """What makes an observation doubtful, in order."""
    has = lambda p: context.rlike(f"(?i){p}")
    financial, own = key.isin(*rules.FINANCIAL_KEYS), r"total|aggregate|portfolio|fleet|active power|con-?\s*nected power|contracted power|contracted capacity|owned capacity|secur(?:ed|ing)|pipeline|guidance|target|we (?:have|ended|expect)|our "
    flags = [
        ((key == "revenue") & has(rules.OFFERING), "financing_amount_misclassified"),
        ((key == "revenue") & has(rules.COMPONENT), "component_not_total"),
        (key.isin("revenue", "capex") & has(rules.MARKET), "market_estimate"),
        (key.contains("power_capacity") & (value <= 5) & has(rules.OFFERING), "financing_table_collision"),
        ((key == "power_capacity") & ~has(rules.FACILITY) & ~has(own), "scope_uncertain"),
        (financial & (source == "text") & has(r"\bby\s+\$[\d,.]+"), "delta_not_period_total"),
    ]
    return F.filter(F.array(*(F.when(test, name) for test, name in flags)), lambda x: x.isNotNull())


@query(rf"""WITH {ORDERS}, c AS (SELECT *, {CONTEXTS}[(o_orderkey % 7)::INTEGER + 1] AS context, {KEYS}[(o_custkey % 4)::INTEGER + 1] AS key, value % 11 AS amount, CASE WHEN o_orderstatus = 'F' THEN 'text' ELSE 'xbrl' END AS source FROM od),
    f AS (SELECT *, list_filter([CASE WHEN key = 'revenue' AND regexp_matches(context, '(?i){rules.OFFERING}') THEN 'financing_amount_misclassified' END, CASE WHEN key = 'revenue' AND regexp_matches(context, '(?i){rules.COMPONENT}') THEN 'component_not_total' END,
        CASE WHEN key IN ('revenue', 'capex') AND regexp_matches(context, '(?i){rules.MARKET}') THEN 'market_estimate' END, CASE WHEN contains(key, 'power_capacity') AND amount <= 5 AND regexp_matches(context, '(?i){rules.OFFERING}') THEN 'financing_table_collision' END,
        CASE WHEN key = 'power_capacity' AND NOT regexp_matches(context, '(?i){rules.FACILITY}') AND NOT regexp_matches(context, '(?i)total|fleet|our ') THEN 'scope_uncertain' END,
        CASE WHEN key <> 'power_capacity' AND source = 'text' AND regexp_matches(context, '(?i)\bby\s+\$[\d,.]+') THEN 'delta_not_period_total' END], lambda x: x IS NOT NULL) AS flags FROM c)
    SELECT o_orderkey, CASE WHEN key <> 'power_capacity' THEN 'consolidated' WHEN regexp_matches(context, '(?i){rules.FACILITY}') THEN 'facility' ELSE 'company' END AS scope, array_to_string(flags, ',') AS flags, least(100, len(flags) * 35)::INTEGER AS anomaly, len(flags) = 0 AS eligible FROM f""")
def metric_policy_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope, flags, anomaly score and eligibility of observations by what stands around them."""
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names)).cast("int") + 1)
    rows = orders(spark, sf_dir).select("o_orderkey", pick(CONTEXTS, F.col("o_orderkey")).alias("context"), pick(KEYS, F.col("o_custkey")).alias("key"), (F.col("value") % 11).alias("amount"), F.when(F.col("o_orderstatus") == "F", "text").otherwise("xbrl").alias("source"))
    rows = rows.withColumn("flags", observation_flags(F.col("key"), F.col("context"), F.col("amount"), F.col("source")))
    scope = F.when(F.col("key").isin(*rules.FINANCIAL_KEYS), "consolidated").when(F.col("context").rlike(f"(?i){rules.FACILITY}"), "facility").otherwise("company")
    return rows.select("o_orderkey", scope.alias("scope"), F.array_join("flags", ",").alias("flags"), F.least(F.lit(100), F.size("flags") * 35).alias("anomaly"), (F.size("flags") == 0).alias("eligible"))


@query(f"""WITH {ORDERS} SELECT o_orderkey, unnest([1, 2])::INTEGER AS place, unnest(['revenue', 'debt']) AS metric, unnest([value / 1000.0::DOUBLE, (value % 977)::DOUBLE * 1000]) AS usd_millions FROM od""")
def metric_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts read from sentences that were made of them: label, at most 45 characters, amount and unit, in millions of dollars."""
    amount = F.format_string("%.3f", F.col("value") / 1000.0)
    said = F.concat(F.lit("In the quarter, revenue reached $"), amount, F.lit(" million, after a slow start. Total debt as of that day stood at $"), (F.col("value") % 977).cast("string"), F.lit(" billion. Growth was 12%."))
    rule = r"(?i)(revenue|capex|liquidity|debt|backlog)[^.$]{0,45}\$\s?([0-9][0-9,]*(?:\.[0-9]+)?)\s*(billion|million|thousand)?"
    rows = orders(spark, sf_dir).select("o_orderkey", F.posexplode(F.regexp_extract_all(said, F.lit(rule), F.lit(0))).alias("pos", "hit"))
    number, unit = F.regexp_replace(F.regexp_extract("hit", rule, 2), ",", "").cast("double"), F.lower(F.regexp_extract("hit", rule, 3))
    return rows.select("o_orderkey", (F.col("pos") + 1).alias("place"), F.lower(F.regexp_extract("hit", rule, 1)).alias("metric"), (number * F.when(unit == "billion", 1000.0).when(unit == "million", 1.0).otherwise(0.001)).alias("usd_millions"))


@query(f"""WITH {ORDERS} SELECT o_orderkey, CASE WHEN value >= 100000 THEN '$' || (floor(value / 10000.0::DOUBLE + 0.5::DOUBLE) / 10)::DECIMAL(12, 1) || 'B' ELSE '$' || value || 'M' END AS money, 'Alert # of #-#' AS signature,
    strftime(d, '%Y%m%dT000000Z') AS stamp, d AS parsed FROM od""")
def display_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts as they are shown, signatures of titles with their numbers taken out, and dates read from stamps."""
    stamp = F.date_format("d", "yyyyMMdd'T000000Z'")
    title = F.concat(F.lit("Alert "), "o_orderkey", F.lit(" of "), F.date_format("d", "yyyy-M"))
    money = F.when(F.col("value") >= 100_000, F.concat(F.lit("$"), (F.floor(F.col("value") / 10_000.0 + 0.5) / 10).cast("decimal(12,1)"), F.lit("B"))).otherwise(F.concat(F.lit("$"), "value", F.lit("M")))
    return orders(spark, sf_dir).select("o_orderkey", money.alias("money"), F.regexp_replace(title, "[0-9]+", "#").alias("signature"), stamp.alias("stamp"), F.to_date(F.try_to_timestamp(stamp, F.lit("yyyyMMdd'T'HHmmss'Z'"))).alias("parsed"))


@query(f"""WITH {ORDERS}, w AS (SELECT *, lag(value) OVER p AS v0, lag(d + (o_orderkey % 90)::INTEGER) OVER p AS e0, d + (o_orderkey % 90)::INTEGER AS due FROM od WINDOW p AS (PARTITION BY o_custkey ORDER BY d, o_orderkey))
    SELECT o_orderkey, CASE WHEN v0 IS NULL THEN 'initiated' WHEN v0 = value AND e0 = due THEN 'reiterated' WHEN due > e0 THEN 'delayed' WHEN value > v0 THEN 'raised' WHEN value < v0 THEN 'lowered' ELSE 'updated' END AS revision,
    CASE WHEN v0 <> 0 THEN floor((value - v0)::DOUBLE / abs(v0) * 100 + 0.5::DOUBLE)::INTEGER END AS variance FROM w""")
def commitment_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each statement does to the one before it, by value and due day, and by how many percent."""
    rows = orders(spark, sf_dir).withColumn("due", F.date_add("d", (F.col("o_orderkey") % 90).cast("int")))
    before = Window.partitionBy("o_custkey").orderBy("d", "o_orderkey")
    v, v0, e, e0 = F.col("value"), F.col("v0"), F.col("due"), F.col("e0")
    kind = F.when(v0.isNull(), "initiated").when((v0 == v) & (e0 == e), "reiterated").when(e > e0, "delayed").when(v > v0, "raised").when(v < v0, "lowered").otherwise("updated")
    return rows.withColumns({"v0": F.lag("value").over(before), "e0": F.lag("due").over(before)}).select("o_orderkey", kind.alias("revision"), text.rounded(F.try_divide((v - v0).cast("double"), F.abs(v0)) * 100).alias("variance"))


@query(f"""WITH {ORDERS}, c AS (SELECT o_custkey, o_orderkey AS commitment, value AS target, d AS valid_from, d + 60 AS due FROM od WHERE o_orderpriority = '1-URGENT'), a AS (SELECT o_custkey, o_orderkey AS actual, value, d FROM od WHERE o_orderpriority <> '1-URGENT'),
    j AS (SELECT commitment, target, actual, value, row_number() OVER (PARTITION BY commitment ORDER BY a.d >= due DESC, CASE WHEN a.d >= due THEN a.d END, a.d DESC, actual) AS r FROM c JOIN a USING (o_custkey) WHERE a.d >= valid_from)
    SELECT commitment, actual, CASE WHEN value >= target THEN 'achieved' WHEN value >= target * 0.75::DOUBLE THEN 'partial' ELSE 'missed' END AS outcome FROM j WHERE r = 1""")
def suggested_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observation that settles a commitment: the first at or after its due day, else the last; and how it came out."""
    rows = orders(spark, sf_dir)
    promised = rows.filter("o_orderpriority = '1-URGENT'").select("o_custkey", F.col("o_orderkey").alias("commitment"), F.col("value").alias("target"), F.col("d").alias("valid_from"), F.date_add("d", 60).alias("due"))
    seen = rows.filter("o_orderpriority <> '1-URGENT'").select("o_custkey", F.col("o_orderkey").alias("actual"), "value", "d")
    after = temporal.as_of(promised, seen, "o_custkey", "due", "d", "actual", ["actual", "value", "d"], forward=True, largest=False)
    early = temporal.as_of(after.filter("actual IS NULL").select(*promised.columns), seen, "o_custkey", "due", "d", "actual", ["actual", "value", "d"], largest=False)
    best = after.filter("actual IS NOT NULL").unionByName(early.filter("d >= valid_from")).select("commitment", F.struct("actual", "value", "target").alias("b"))
    outcome = F.when(F.col("b.value") >= F.col("b.target"), "achieved").when(F.col("b.value") >= F.col("b.target") * 0.75, "partial").otherwise("missed")
    return best.select("commitment", "b.actual", outcome.alias("outcome"))


@query(f"""WITH {ORDERS}, r AS (SELECT o_custkey, d AS valid_from, o_orderkey AS revision FROM od WHERE o_orderpriority = '1-URGENT'), s AS (SELECT o_custkey, d, o_orderkey FROM od WHERE o_orderpriority = '5-LOW')
    SELECT s.o_orderkey, coalesce(arg_max(revision, struct_pack(v := valid_from, r := revision)) FILTER (WHERE valid_from <= d), arg_min(revision, struct_pack(v := valid_from, r := revision))) AS revision FROM s JOIN r USING (o_custkey) GROUP BY s.o_orderkey""")
def as_of_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revision in force on a statement's day: the last from before it, else the first of all."""
    rows = orders(spark, sf_dir)
    revisions = rows.filter("o_orderpriority = '1-URGENT'").select("o_custkey", F.col("d").alias("valid_from"), F.col("o_orderkey").alias("revision"))
    first = revisions.groupBy("o_custkey").agg(F.min_by("revision", F.struct("valid_from", "revision")).alias("first"))
    stated = rows.filter("o_orderpriority = '5-LOW'").select("o_custkey", "d", "o_orderkey")
    found = temporal.as_of(stated, revisions, "o_custkey", "d", "valid_from", "revision", ["revision"]).join(first, "o_custkey")
    return found.select("o_orderkey", F.coalesce("revision", "first").alias("revision"))


@query(f"WITH {ORDERS}, b AS (SELECT *, left(o_orderpriority, 1) IN ('1', '2') AS periodic FROM od) SELECT o_orderkey, last_value(CASE WHEN periodic THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY d, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM b")
def previous_filing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filing of the same company and base form before each; only periodic ones count as such."""
    earlier = Window.partitionBy("o_custkey", "o_orderstatus").orderBy("d", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    periodic = F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), F.col("o_orderkey"))
    return orders(spark, sf_dir).withColumn("previous", F.last(periodic, ignorenulls=True).over(earlier)).select("o_orderkey", "previous")


@query(f"WITH {QUARTERS}, k AS (SELECT *, CASE WHEN quarter(quarter) = 4 THEN 'annual' ELSE 'interim' END AS kind FROM qt) SELECT nation, quarter, kind, value, lag(value) OVER w AS previous, lag(quarter) OVER w AS previous_quarter FROM k WINDOW w AS (PARTITION BY nation, kind ORDER BY quarter)")
def previous_of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each period beside the one of the same kind before it."""
    rows = quarters(spark, sf_dir).withColumn("kind", F.when(F.quarter("quarter") == 4, "annual").otherwise("interim"))
    before = Window.partitionBy("nation", "kind").orderBy("quarter")
    return rows.select("nation", "quarter", "kind", "value", F.lag("value").over(before).alias("previous"), F.lag("quarter").over(before).alias("previous_quarter"))


@query(f"""WITH {ORDERS}, g AS (SELECT o_custkey, date_trunc('quarter', d)::DATE AS quarter, o_orderkey, value, o_orderpriority, d FROM od), x AS (SELECT o_custkey, quarter, max(value) - min(value) > greatest(1, min(abs(value))) * 0.02::DOUBLE AND count(*) > 1 AS conflict FROM g GROUP BY 1, 2),
    c AS (SELECT o_custkey, quarter, arg_max(o_orderkey, struct_pack(d := d, k := o_orderkey)) AS canonical FROM g WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2)
    SELECT o_orderkey, CASE WHEN canonical IS NULL THEN CASE WHEN conflict THEN 'open' ELSE 'single' END WHEN canonical = o_orderkey THEN 'canonical' WHEN conflict THEN 'rejected' ELSE 'kept' END AS state FROM g JOIN x USING (o_custkey, quarter) LEFT JOIN c USING (o_custkey, quarter)""")
def metric_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last decision on each period makes one observation canonical and rejects those that it conflicts with."""
    rows = orders(spark, sf_dir).withColumn("quarter", F.trunc("d", "quarter"))
    by = rows.groupBy("o_custkey", "quarter")
    spread = (F.max("value") - F.min("value") > F.greatest(F.lit(1).cast("long"), F.min(F.abs("value"))) * 0.02) & (F.count("*") > 1)
    decided = F.max_by("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", F.struct("d", "o_orderkey")))
    found = rows.join(by.agg(spread.alias("conflict"), decided.alias("canonical")), ["o_custkey", "quarter"])
    state = F.when(F.col("canonical").isNull(), F.when(F.col("conflict"), "open").otherwise("single")).when(F.col("canonical") == F.col("o_orderkey"), "canonical").when(F.col("conflict"), "rejected").otherwise("kept")
    return found.select("o_orderkey", state.alias("state"))


@query(f"""WITH {QUARTERS}, s AS (SELECT nation, quarter, value, CASE (orders % 4) WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN 'pending' ELSE 'canonical' END AS status, value % 5 = 0 AS anomalous FROM qt), n AS (SELECT count(*) AS nations FROM nation), q AS (SELECT count(DISTINCT quarter) AS q FROM qt)
    SELECT count(*) AS observations, count(*) FILTER (WHERE status = 'canonical') AS canonical, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE anomalous) AS anomalies, count(*) FILTER (WHERE anomalous AND status = 'canonical') AS anomalous_canonical,
    floor(100.0::DOUBLE * count(DISTINCT CASE WHEN status <> 'rejected' THEN nation || ':' || quarter END) / greatest(1, any_value(nations) * any_value(q)) + 0.5::DOUBLE)::INTEGER AS coverage FROM s, n, q""")
def ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a metric ledger by status, its anomalies, and the share of cells that it fills."""
    rows = quarters(spark, sf_dir)
    status = F.element_at(F.array(*map(F.lit, ("accepted", "rejected", "pending", "canonical"))), (F.col("orders") % 4).cast("int") + 1)
    rows = rows.select("nation", "quarter", status.alias("status"), (F.col("value") % 5 == 0).alias("anomalous"))
    cells = F.count_distinct(F.when(F.col("status") != "rejected", F.struct("nation", "quarter")))
    one = rows.agg(F.count("*").alias("observations"), F.count_if(F.col("status") == "canonical").alias("canonical"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if("anomalous").alias("anomalies"), F.count_if(F.col("anomalous") & (F.col("status") == "canonical")).alias("anomalous_canonical"), cells.alias("filled"), F.count_distinct("quarter").alias("q"))
    full = one.join(F.broadcast(table(spark, sf_dir, "nation").agg(F.count("*").alias("nations"))))
    return full.select("observations", "canonical", "pending", "anomalies", "anomalous_canonical", text.rounded(F.col("filled") * 100 / F.greatest(F.lit(1).cast("long"), F.col("nations") * F.col("q"))).alias("coverage"))


@query(f"""WITH {QUARTERS}, f AS (SELECT l_suppkey, l_orderkey, l_linenumber, (date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS period_end, l_quantity FROM lineitem), p AS (SELECT DISTINCT (quarter + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS period_end, quarter FROM qt)
    SELECT quarter, count(*) AS facts, count(DISTINCT l_suppkey) AS sources, sum(l_quantity)::BIGINT AS quantity FROM f JOIN p USING (period_end) WHERE period_end - quarter + 1 BETWEEN 70 AND 110 GROUP BY quarter""")
def fact_to_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that end on a known period's last day, where that period has a quarter's length."""
    end = lambda c: F.date_sub(F.add_months(F.trunc(c, "quarter"), 3), 1)
    facts = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", end("l_shipdate").alias("period_end"))
    periods = quarters(spark, sf_dir).select(end("quarter").alias("period_end"), "quarter").distinct()
    met = facts.join(periods, "period_end").filter((F.datediff("period_end", "quarter") + 1).between(70, 110))
    return met.groupBy("quarter").agg(F.count("*").alias("facts"), F.count_distinct("l_suppkey").alias("sources"), F.sum("l_quantity").cast("long").alias("quantity"))


@query(f"""WITH {QUARTERS}, p AS (SELECT nation, quarter, orders, row_number() OVER (PARTITION BY nation ORDER BY CASE WHEN orders >= 8 AND quarter(quarter) < 4 THEN 0 WHEN orders >= 8 THEN 1 ELSE 2 END, quarter DESC) AS r FROM qt) SELECT nation, quarter, orders FROM p WHERE r = 1""")
def default_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The period to show first: the newest well filled quarter, else the newest well filled year end, else the newest."""
    full = F.col("orders") >= 8
    order = [F.when(full & (F.quarter("quarter") < 4), 0).when(full, 1).otherwise(2).asc(), F.desc("quarter")]
    return keyed.best_rows(quarters(spark, sf_dir), ["nation"], order).select("nation", "quarter", "orders")


@query(f"""WITH {ORDERS}, w AS (SELECT o_custkey, o_orderkey, d, value, count(*) OVER (PARTITION BY o_custkey) AS revisions, row_number() OVER (PARTITION BY o_custkey ORDER BY d DESC, o_orderkey DESC) AS r FROM od WHERE o_orderstatus <> 'P')
    SELECT count(*) AS commitments, sum(revisions)::BIGINT AS revisions, count(*) FILTER (WHERE d < DATE '1997-01-01') AS due, count(*) FILTER (WHERE revisions > 1) AS revised, max(value) AS largest FROM w WHERE r = 1""")
def commitment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of commitments in one row: how many, how often revised, and how many are due."""
    rows = orders(spark, sf_dir).filter("o_orderstatus <> 'P'")
    current = rows.groupBy("o_custkey").agg(F.count("*").alias("revisions"), F.max_by(F.struct("d", "value"), F.struct("d", "o_orderkey")).alias("c"))
    return current.agg(F.count("*").alias("commitments"), F.sum("revisions").alias("revisions"), F.count_if(F.col("c.d") < "1997-01-01").alias("due"), F.count_if(F.col("revisions") > 1).alias("revised"), F.max("c.value").alias("largest"))


@query(f"WITH {QUARTERS} SELECT a.n_nationkey AS a, b.n_nationkey AS b, qa.quarter AS quarter, qa.value - qb.value AS lead FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey JOIN qt qa ON qa.nation = a.n_nationkey JOIN qt qb ON qb.nation = b.n_nationkey AND qb.quarter = qa.quarter")
def company_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each two nations of a region, once, compared in each quarter that both have."""
    nations = table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_nationkey").alias("nation"))
    value = quarters(spark, sf_dir).select("nation", "quarter", "value").join(nations, "nation")
    a, b = value.alias("a"), value.alias("b")
    met = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.quarter") == F.col("b.quarter")) & (F.col("a.nation") < F.col("b.nation")))
    return met.select(F.col("a.nation").alias("a"), F.col("b.nation").alias("b"), F.col("a.quarter").alias("quarter"), (F.col("a.value") - F.col("b.value")).alias("lead"))


_DOMAINS = {"o_orderstatus": ("F", "O"), "o_orderpriority": ("1-URGENT", "2-HIGH", "3-MEDIUM")}


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS value, count(*) AS n, min(o_orderkey) AS example FROM orders WHERE {c} IS NULL OR {c} NOT IN {v} GROUP BY {c}" for c, v in _DOMAINS.items()))
def domain_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values outside of what a column may hold, with how many rows have each, from one scan."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value"), (~F.coalesce(F.col(c).isin(*v), F.lit(False))).alias("bad")) for c, v in _DOMAINS.items()))).alias("x"))
    return rows.filter("x.bad").groupBy("x.field", "x.value").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("example"))


@query(f"""WITH {ORDERS}, l AS (SELECT l_orderkey, arg_max(l_returnflag, l_shipdate) FILTER (WHERE false) AS f, max(l_shipdate)::DATE AS shipped, count(*) AS lines FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey, coalesce(CASE WHEN o_custkey % 3 > 0 THEN c_mktsegment END, n_name, r_name, 'unknown') AS label, coalesce(shipped, d) AS shown, coalesce(lines, 0) AS lines, r_name AS region FROM od LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN l ON o_orderkey = l_orderkey""")
def alert_hydration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts with what five tables know of them, each label from the first that has one."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.max("l_shipdate")).alias("shipped"), F.count("*").alias("lines"))
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    rows = orders(spark, sf_dir).join(owners, "o_custkey", "left").join(table(spark, sf_dir, "nation"), "n_nationkey", "left").join(table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey", "left").join(lines, "o_orderkey", "left")
    label = F.coalesce(F.when(F.col("o_custkey") % 3 > 0, F.col("c_mktsegment")), "n_name", "r_name", F.lit("unknown"))
    return rows.select("o_orderkey", label.alias("label"), F.coalesce("shipped", "d").alias("shown"), F.coalesce("lines", F.lit(0).cast("long")).alias("lines"), F.col("r_name").alias("region"))
