"""Claims and alerts: verification against cited evidence, changes of text, alerts and events, evaluation, retrieval by vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions import rules, text
from sievework.operators import keyed, vectors
from sievework.storage import stored

from .base import EVIDENCE, REVIEWS, SCORED, evidence, registry, reviews, scored, table

QUERIES, ORACLES, query = registry()


def _b(pattern: str) -> str:
    return rf"(?i)\b(?:{pattern})\b"


def _pick(names: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (n % len(names)).cast("int") + 1)


def _pick_sql(names: list[str], n: str) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in names) + f"][(({n}) % {len(names)})::INTEGER + 1]"


# Titles of events; which one an event has follows from its number.
TITLES = ["Signed contract for 20 MW of new capacity", "Debt financing delayed by lender", "Customer concentration is a risk", "GPU cluster energized ahead of schedule", "Quarter results and guidance", "Agreement with a utility for grid power", "Outage at the campus", "Company picnic", "Convertible note offering increased to $1 billion", "Backlog growth is strong"]


@query(rf"""WITH t AS (SELECT event_id, {_pick_sql(TITLES, 'event_id')} AS title FROM events), c AS (SELECT event_id, CASE {' '.join(f"WHEN regexp_matches(title, '(?i){p}') THEN '{k}'" for k, p in rules.ALERTS)} ELSE 'Other' END AS category,
        regexp_matches(title, '{_b(rules.STRENGTHENS)}') AS up, regexp_matches(title, '{_b(rules.WEAKENS)}') AS down FROM t), i AS (SELECT *, CASE WHEN up AND NOT down THEN 'strengthens' WHEN down AND NOT up THEN 'weakens' ELSE 'watch' END AS impact FROM c)
    SELECT event_id, category, impact, CASE WHEN impact = 'watch' THEN 'watch' WHEN (category IN ('Funding', 'Customer', 'Execution')) = (impact = 'weakens') THEN 'supports' ELSE 'weakens' END AS claim_impact FROM i""")
def alert_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category and direction of each alert, and what that means for its claim: bad news supports a claim of risk."""
    title = _pick(TITLES, F.col("event_id"))
    rows = table(spark, sf_dir, "events").select("event_id", text.first_topic(title, rules.ALERTS, "Other").alias("category"), text.impact(title, rules.STRENGTHENS, rules.WEAKENS).alias("impact"))
    risk, bad = F.col("category").isin(*rules.RISK_CATEGORIES), F.col("impact") == "weakens"
    return rows.withColumn("claim_impact", F.when(F.col("impact") == "watch", "watch").when(risk == bad, "supports").otherwise("weakens"))


@query(rf"""WITH t AS (SELECT event_id, {_pick_sql(TITLES, 'event_id')} AS title, event_type = 'purchase' AS official, (event_id % 100)::INTEGER AS given FROM events)
    SELECT event_id, CASE {' '.join(f"WHEN regexp_matches(title, '(?i){p}') THEN '{k}'" for k, p in rules.EVENT_KINDS)} ELSE 'Company update' END AS kind,
    greatest(35, least(98, 42 + 13 * ({' + '.join(f"(CASE WHEN regexp_matches(title, '{_b(p)}') THEN 1 ELSE 0 END)" for p in rules.EVENT_MATERIAL)}) + CASE WHEN official THEN 12 ELSE 0 END))::INTEGER AS materiality,
    CASE WHEN official THEN greatest(80, least(100, given)) ELSE greatest(35, least(78, given)) END::INTEGER AS credibility FROM t""")
def event_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, materiality and credibility of live events by their titles and sources."""
    title, official, given = _pick(TITLES, F.col("event_id")), F.col("event_type") == "purchase", (F.col("event_id") % 100).cast("int")
    hits = sum((F.when(title.rlike(text.word(p)), 1).otherwise(0) for p in rules.EVENT_MATERIAL), F.lit(0))
    material = F.greatest(F.lit(35), F.least(F.lit(98), 42 + hits * 13 + F.when(official, 12).otherwise(0)))
    credible = F.when(official, F.greatest(F.lit(80), F.least(F.lit(100), given))).otherwise(F.greatest(F.lit(35), F.least(F.lit(78), given)))
    return table(spark, sf_dir, "events").select("event_id", text.first_topic(title, rules.EVENT_KINDS, "Company update").alias("kind"), material.alias("materiality"), credible.alias("credibility"))


@query(f"""WITH t AS (SELECT event_id, user_id, ts, regexp_replace({_pick_sql(TITLES, 'event_id')} || ' ' || event_id, '[0-9]+', '#', 'g') AS signature, value FROM events WHERE event_type <> 'view'), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, signature ORDER BY value DESC, ts DESC, event_id) AS r FROM t WHERE value >= 5)
    SELECT user_id, signature, event_id FROM r WHERE r = 1""")
def priority_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of alerts whose titles differ in numbers only, the weightiest unread one of each user."""
    rows = table(spark, sf_dir, "events").filter("event_type <> 'view' AND value >= 5")
    signature = F.regexp_replace(F.concat_ws(" ", _pick(TITLES, F.col("event_id")), "event_id"), "[0-9]+", "#")
    best = keyed.best_rows(rows.withColumn("signature", signature), ["user_id", "signature"], [F.desc("value"), F.desc("ts"), F.asc("event_id")])
    return best.select("user_id", "signature", "event_id")


_CLEAN = r"trim(regexp_replace(replace({}, chr(160), ' '), '[ \t\n\x0B\f\r]+', ' ', 'g'))"


@query(rf"""WITH s AS (SELECT conv_id, turn, string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS parts FROM conversations),
    u AS (SELECT conv_id, turn, unnest(range(1, len(parts) + 1)) AS place, parts FROM s), t AS (SELECT conv_id, turn, place, {_CLEAN.format('parts[place]')} AS t FROM u), w AS (SELECT *, string_split(t, ' ') AS p FROM t)
    SELECT conv_id, turn, place::INTEGER AS place, length(t) < 24 OR length(t) > 420 OR len(p) < 5 OR regexp_matches(t, '^[a-z]{{2,}}\s') OR regexp_matches(t, '(?i)\bwww\.\S+|\b\d+\s*/\s*\d+\b') OR len(regexp_extract_all(t, '\b20\d{{2}}\b')) >= 4
    OR len(list_filter(p, lambda x: regexp_matches(x, '[0-9]')))::DOUBLE / len(p) > 0.32 OR regexp_matches(t, '(?:\b[A-Z]{{2,}}\b\s*){{7,}}') AS malformed FROM w""")
def malformed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every whole turn, taken as a claim: whether it is no readable sentence. Null texts have none."""
    parts = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(text.sentences(F.col("text"))).alias("place", "claim"))
    return parts.select("conv_id", "turn", (F.col("place") + 1).alias("place"), text.malformed(F.col("claim")).alias("malformed"))


# What a claim cites: the accepted evidence whose number leads to it. The claim takes a denial with it in every third case.
_CITED = "ci AS (SELECT rv.doc_id, item_id, CASE WHEN rv.doc_id % 3 = 0 THEN 'It is not so that ' || b.text ELSE b.text END AS claim, d.text AS source FROM rv JOIN benchmark b ON b.item_id = rv.doc_id % (SELECT count(*) FROM benchmark) JOIN documents d ON d.doc_id = rv.doc_id WHERE status = 'accepted')"
_PLAIN = r"trim(regexp_replace(regexp_replace(lower(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '[\x{{00a0}}\x{{2007}}\x{{202f}}]', ' ', 'g'), '[“”]', '\"', 'g'), '[‘’]', '''', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')), '^[\"'']|[\"'']$', '', 'g')), '[^a-z0-9$%£€.'' -]', ' ', 'g'), ' +', ' ', 'g'))".replace('\\"', '"')
_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in rules.STOP_WORDS) + "]"


def _tokens_sql(x: str) -> str:
    parts = f"list_transform(string_split({_PLAIN.format(x)}, ' '), lambda t: regexp_replace(t, '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g'))"
    return f"list_distinct(list_filter({parts}, lambda t: length(t) >= 4 AND NOT list_contains({_STOP_SQL}, t) AND NOT regexp_matches(t, '^[0-9]+$')))"


_OPPOSED = " OR ".join(f"(regexp_matches(claim, '{_b(u)}') AND regexp_matches(source, '{_b(d)}')) OR (regexp_matches(claim, '{_b(d)}') AND regexp_matches(source, '{_b(u)}'))" for u, d in rules.DIRECTIONS)
_NEGATED = _b(rules.NEGATIONS).replace("'", "''")


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, claim, source."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    count = F.broadcast(items.agg(F.count("*").alias("items")))
    accepted = reviews(spark, sf_dir).filter("status = 'accepted'").select("doc_id").join(count).withColumn("item_id", F.expr("CASE WHEN items > 0 THEN doc_id % items END"))
    claims = accepted.join(items.withColumnRenamed("text", "said"), "item_id").join(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source")), "doc_id")
    return claims.select("doc_id", "item_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("It is not so that "), "said")).otherwise(F.col("said")).alias("claim"), "source")


def _supported(cited: DataFrame) -> DataFrame:
    """matched, overlap, comparable and opposed for each citation."""
    own, its = text.content_tokens(F.col("claim"), rules.STOP_WORDS), text.content_tokens(F.col("source"), rules.STOP_WORDS)
    met = cited.withColumns({"n": F.size(own), "matched": F.size(F.array_intersect(own, its)), "opposed": text.contradicts(F.col("claim"), F.col("source"), rules.NEGATIONS, rules.DIRECTIONS)})
    overlap = F.try_divide(F.col("matched"), F.col("n"))
    return met.withColumns({"overlap": F.coalesce(overlap, F.lit(0.0)), "comparable": F.coalesce((F.col("matched") >= F.least(F.lit(3), F.col("n"))) & (overlap >= 0.24), F.lit(False))})


_SUPPORT = f"""s0 AS (SELECT doc_id, item_id, claim, source, {_tokens_sql('claim')} AS a, {_tokens_sql('source')} AS b, (regexp_matches(claim, '{_NEGATED}') <> regexp_matches(source, '{_NEGATED}')) OR {_OPPOSED} AS opposed FROM ci),
    s1 AS (SELECT *, len(a) AS n, len(list_intersect(a, b)) AS matched FROM s0), su AS (SELECT *, CASE WHEN n > 0 THEN matched::DOUBLE / n ELSE 0 END AS overlap, n > 0 AND matched >= least(3, n) AND matched::DOUBLE / greatest(n, 1) >= 0.24 AS comparable FROM s1)"""


@query(f"""WITH {REVIEWS}, {_CITED}, {_SUPPORT}, g AS (SELECT item_id, doc_id % 3 = 0 AS denied, max(n) AS n, max(overlap) AS overlap, count(*) FILTER (WHERE comparable) AS comparable, count(*) FILTER (WHERE comparable AND opposed) AS opposed FROM su GROUP BY 1, 2)
    SELECT item_id, denied, overlap, comparable, opposed, CASE WHEN n = 0 THEN 'no-content-tokens' WHEN comparable = 0 THEN 'insufficient-lexical-support' WHEN opposed = comparable THEN 'polarity-conflict' ELSE 'supported' END AS reason FROM g""")
def claim_support_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any cited text says what a claim says, by shared words, and whether all that do deny it."""
    by = _supported(_cited(spark, sf_dir)).groupBy("item_id", (F.col("doc_id") % 3 == 0).alias("denied"))
    found = by.agg(F.max("n").alias("n"), F.max("overlap").alias("overlap"), F.count_if("comparable").alias("comparable"), F.count_if(F.col("comparable") & F.col("opposed")).alias("opposed"))
    reason = F.when(F.col("n") == 0, "no-content-tokens").when(F.col("comparable") == 0, "insufficient-lexical-support").when(F.col("opposed") == F.col("comparable"), "polarity-conflict").otherwise("supported")
    return found.select("item_id", "denied", "overlap", "comparable", "opposed", reason.alias("reason"))


@query(f"""WITH {REVIEWS}, {_CITED}, {_SUPPORT} SELECT item_id, count(*) AS citations, count(*) FILTER (WHERE NOT comparable) AS no_support, count(*) FILTER (WHERE comparable AND opposed) AS conflicts, count(*) FILTER (WHERE length(claim) > 420 OR length(claim) < 24) AS malformed,
    count(*) FILTER (WHERE contains(source, claim)) AS quoted FROM su GROUP BY item_id""")
def verification_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many citations of each claim fail, by reason, and how many quote it."""
    size = F.length("claim")
    return _supported(_cited(spark, sf_dir)).groupBy("item_id").agg(
        F.count("*").alias("citations"), F.count_if(~F.col("comparable")).alias("no_support"), F.count_if(F.col("comparable") & F.col("opposed")).alias("conflicts"),
        F.count_if((size > 420) | (size < 24)).alias("malformed"), F.count_if(F.contains("source", "claim")).alias("quoted"),
    )


@query("""WITH o AS (SELECT o_custkey, o_orderkey, round(o_totalprice)::BIGINT AS v FROM orders), s AS (SELECT o_custkey, list(v) AS vs, list(v % 40) AS ms FROM o GROUP BY o_custkey)
    SELECT o_orderkey, o_orderkey % 4 <> 3 OR list_contains(vs, v + 1) AS passed, CASE WHEN o_orderkey % 4 <> 3 OR list_contains(vs, v + 1) THEN 0 ELSE 1 END::INTEGER AS unsupported FROM o JOIN s USING (o_custkey)""")
def numeric_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all numbers of a claim, with their units, are in the texts that it cites; every fourth claim has a wrong one."""
    v = F.round("o_totalprice").cast("long")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", v.alias("v"))
    source = F.concat(F.lit("Revenue of $"), F.col("v").cast("string"), F.lit("bn was booked, after "), (F.col("v") % 40).cast("string"), F.lit("-month terms"))
    said = F.concat(F.lit("It booked $"), F.when(F.col("o_orderkey") % 4 == 3, F.col("v") + 1).otherwise(F.col("v")).cast("string"), F.lit(" billion with "), (F.col("v") % 40).cast("string"), F.lit(" month terms"))
    known = rows.select("o_custkey", F.explode(text.numeric_facts(source)).alias("fact")).distinct().withColumn("known", F.lit(True))
    facts = rows.select("o_custkey", "o_orderkey", F.explode(text.numeric_facts(said)).alias("fact")).join(known, ["o_custkey", "fact"], "left")
    return facts.groupBy("o_orderkey").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("passed"), F.count_if(F.col("known").isNull()).cast("int").alias("unsupported"))


# Two versions of a text: a conversation's turns in a row are a section before and after.
_TOK = f"list_distinct(list_filter(regexp_extract_all(lower({{}}), '[a-z0-9]+'), lambda t: length(t) > 1 AND NOT list_contains({_STOP_SQL}, t)))"
_TERMS = ["que", "la", "thon", "ing", "onan", "les", "der"]
_TERMS_SQL = "[" + ", ".join(f"'{t}'" for t in _TERMS) + "]"


@query(f"""WITH a AS (SELECT conv_id, turn, {_TOK.format('text')} AS t FROM conversations), j AS (SELECT coalesce(n.conv_id, o.conv_id) AS conv_id, coalesce(n.turn, o.turn + 2) AS turn, n.t AS now, o.t AS before FROM a n FULL JOIN a o ON n.conv_id = o.conv_id AND n.turn = o.turn + 2),
    s AS (SELECT *, CASE WHEN before IS NULL THEN 'added' WHEN now IS NULL THEN 'not_repeated' ELSE 'modified' END AS kind, CASE WHEN now IS NOT NULL AND before IS NOT NULL THEN CASE WHEN len(now) + len(before) = 0 THEN 1 ELSE len(list_intersect(now, before))::DOUBLE / len(list_distinct(list_concat(now, before))) END END AS similarity,
        list_sort(list_intersect({_TERMS_SQL}, coalesce(now, []))) AS mn, list_sort(list_intersect({_TERMS_SQL}, coalesce(before, []))) AS mb FROM j)
    SELECT conv_id, turn, kind, similarity, CASE WHEN kind = 'not_repeated' THEN 'low' WHEN kind = 'added' THEN CASE WHEN len(mn) > 0 THEN 'high' ELSE 'medium' END WHEN similarity < 0.55 OR mn <> mb THEN 'high' WHEN similarity < 0.75 THEN 'medium' ELSE 'low' END AS significance FROM s""")
def change_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a filing beside those of the one before, unmatched ones included, and how much each change matters."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.tokens(F.col("text"), rules.STOP_WORDS).alias("now"))
    before = rows.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("now").alias("before"))
    met = rows.join(before, ["conv_id", "turn"], "full_outer")
    now, old = F.col("now"), F.col("before")
    kind = F.when(old.isNull(), "added").when(now.isNull(), "not_repeated").otherwise("modified")
    met = met.withColumns({"kind": kind, "similarity": F.when(now.isNotNull() & old.isNotNull(), text.jaccard(now, old, 1.0))})
    empty = F.array().cast("array<string>")
    level = text.text_change(F.col("kind"), F.col("similarity"), F.coalesce(now, empty), F.coalesce(old, empty), _TERMS)
    return met.select("conv_id", "turn", "kind", "similarity", level.alias("significance"))


# Comparisons of a brief: for each user and event type, the newest value beside the one before.
_CMP = """cm AS (SELECT user_id, event_type, event_id, value - lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS delta, ts FROM events), cl AS (SELECT *, CASE WHEN delta IS NULL THEN 'new' WHEN abs(delta) < 0.5 THEN 'unchanged' WHEN delta > 0 THEN 'increased' ELSE 'decreased' END AS direction,
    CASE event_type WHEN 'purchase' THEN 'revenue growth' WHEN 'click' THEN 'debt and funding cost' WHEN 'view' THEN 'cash position' ELSE 'other matters' END AS label FROM cm),
    se AS (SELECT *, CASE WHEN label = 'cash position' AND direction = 'increased' THEN 'positive' WHEN label = 'cash position' AND direction = 'decreased' THEN 'negative' WHEN label = 'debt and funding cost' AND direction IN ('new', 'increased') THEN 'negative'
        WHEN label = 'debt and funding cost' AND direction = 'decreased' THEN 'positive' WHEN label = 'revenue growth' AND direction IN ('new', 'increased') THEN 'positive' WHEN direction = 'increased' THEN 'positive' WHEN direction = 'decreased' THEN 'negative' ELSE 'neutral' END AS sentiment,
        CASE WHEN abs(delta) >= 5 THEN 3 WHEN abs(delta) >= 2 THEN 2 ELSE 1 END * 10 + CASE WHEN direction = 'unchanged' THEN 0 ELSE 1 END AS weight FROM cl)"""


def sentiment(label: Column, direction: Column) -> Column:
    """Whether a change is good or bad news, by what it is of: liquidity, a threat, an opportunity, or anything else."""
    up, down, fresh = direction == "increased", direction.isin("decreased", "removed"), direction.isin("new", "increased")
    has = lambda p: label.rlike(f"(?i){p}")
    out = F.when(has(rules.LIQUIDITY) & up, "positive").when(has(rules.LIQUIDITY) & down, "negative").when(has(rules.THREAT) & (fresh | (direction == "changed")), "negative").when(has(rules.THREAT) & down, "positive")
    return out.when(has(rules.OPPORTUNITY) & fresh, "positive").when(has(rules.OPPORTUNITY) & down, "negative").when(up, "positive").when(down, "negative").otherwise("neutral")


def _comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    delta = F.col("value") - F.lag("value").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", delta.alias("delta"))
    direction = F.when(F.col("delta").isNull(), "new").when(F.abs("delta") < 0.5, "unchanged").when(F.col("delta") > 0, "increased").otherwise("decreased")
    label = F.when(kind == "purchase", "revenue growth").when(kind == "click", "debt and funding cost").when(kind == "view", "cash position").otherwise("other matters")
    rows = rows.withColumns({"direction": direction, "label": label})
    weight = F.when(F.abs("delta") >= 5, 30).when(F.abs("delta") >= 2, 20).otherwise(10) + F.when(F.col("direction") == "unchanged", 0).otherwise(1)
    return rows.withColumns({"sentiment": sentiment(F.col("label"), F.col("direction")), "weight": weight})


@query(f"WITH {_CMP} SELECT event_id, direction, sentiment, weight::INTEGER AS weight FROM se")
def comparison_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _comparisons(spark, sf_dir).select("event_id", "direction", "sentiment", "weight")


@query(f"""WITH {_CMP}, b AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS types, count(*) FILTER (WHERE sentiment = 'positive') AS bull, count(*) FILTER (WHERE sentiment = 'negative') AS bear, avg(weight) AS mean FROM se GROUP BY user_id)
    SELECT user_id, bull, bear, least(100, n * 14 + types * 8)::INTEGER AS diversity, least(100, n * 14)::INTEGER AS coverage, floor(mean * 0.25::DOUBLE + 35 + least(100, n * 14 + types * 8) * 0.2::DOUBLE + least(100, n * 14) * 0.2::DOUBLE + 0.5::DOUBLE)::INTEGER AS confidence,
    CASE WHEN n < 3 THEN 'thin' WHEN bull > bear THEN 'positive' WHEN bear > bull THEN 'negative' ELSE 'mixed' END AS verdict FROM b""")
def brief_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diversity, coverage, confidence and verdict of each brief."""
    n = F.count("*")
    by = _comparisons(spark, sf_dir).groupBy("user_id").agg(n.alias("n"), F.count_distinct("event_type").alias("types"), F.count_if(F.col("sentiment") == "positive").alias("bull"), F.count_if(F.col("sentiment") == "negative").alias("bear"), F.avg("weight").alias("mean"))
    diversity, coverage = (F.least(F.lit(100), x).cast("int") for x in (F.col("n") * 14 + F.col("types") * 8, F.col("n") * 14))
    verdict = F.when(F.col("n") < 3, "thin").when(F.col("bull") > F.col("bear"), "positive").when(F.col("bear") > F.col("bull"), "negative").otherwise("mixed")
    return by.select("user_id", "bull", "bear", diversity.alias("diversity"), coverage.alias("coverage"), text.rounded(F.col("mean") * 0.25 + 35 + diversity * 0.2 + coverage * 0.2).alias("confidence"), verdict.alias("verdict"))


@query(f"""WITH {_CMP}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id, label ORDER BY weight DESC, ts DESC, event_id) AS k FROM se WHERE sentiment IN ('positive', 'negative')), t AS (SELECT *, row_number() OVER (PARTITION BY user_id, sentiment ORDER BY weight DESC, ts DESC, event_id) AS place FROM o WHERE k = 1)
    SELECT user_id, sentiment, place::INTEGER AS place, label, event_id FROM t WHERE place <= 2""")
def brief_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brief's two weightiest claims for and against, each label once."""
    order = [F.desc("weight"), F.desc("ts"), F.asc("event_id")]
    once = keyed.best_rows(_comparisons(spark, sf_dir).filter("sentiment IN ('positive', 'negative')"), ["user_id", "label"], order)
    return keyed.best_rows(once, ["user_id", "sentiment"], order, 2, "place").select("user_id", "sentiment", "place", "label", "event_id")


# Evaluation: a case is a claim; what it should cite are the documents whose number leads to it, what it cites the reviewed ones of the next two as well.
_CASE = "ex AS (SELECT doc_id % 40 AS c, doc_id, company FROM ev), rt AS (SELECT doc_id, status, (doc_id * 7) % 40 AS c FROM rv WHERE doc_id % 40 IN ((doc_id * 7) % 40, ((doc_id * 7) + 1) % 40, 0, 8, 16, 24, 32))"
_PERCENT = "CASE WHEN {1} = 0 THEN 100.0::DOUBLE ELSE {0}::DOUBLE * 100 / {1} END"


@query(f"""WITH {EVIDENCE}, {REVIEWS}, {_CASE}, e AS (SELECT c, count(*) AS expected, count(DISTINCT company) AS companies FROM ex GROUP BY c), r AS (SELECT rt.c, count(*) AS retrieved, count(ex.doc_id) AS hits, count(*) FILTER (WHERE status = 'accepted') AS grounded, count(DISTINCT ex.company) AS found FROM rt LEFT JOIN ex ON ex.c = rt.c AND ex.doc_id = rt.doc_id GROUP BY rt.c),
    s AS (SELECT e.c, {_PERCENT.format('coalesce(hits, 0)', 'expected')} AS coverage, {_PERCENT.format('coalesce(hits, 0)', 'coalesce(retrieved, 0)')} AS precision, {_PERCENT.format('coalesce(grounded, 0)', 'coalesce(retrieved, 0)')} AS groundedness, {_PERCENT.format('coalesce(found, 0)', 'companies')} AS accuracy FROM e LEFT JOIN r USING (c))
    SELECT c AS case_id, floor(coverage + 0.5::DOUBLE)::INTEGER AS coverage, floor(precision + 0.5::DOUBLE)::INTEGER AS precision, floor(groundedness + 0.5::DOUBLE)::INTEGER AS groundedness, floor(accuracy + 0.5::DOUBLE)::INTEGER AS accuracy,
    floor(coverage * 0.3::DOUBLE + precision * 0.25::DOUBLE + groundedness * 0.3::DOUBLE + accuracy * 0.15::DOUBLE + 0.5::DOUBLE)::INTEGER AS overall FROM s""")
def benchmark_case_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, precision, groundedness and company accuracy of each case's citations, and their weighted mean; an empty denominator is 100 %."""
    return _case_scores(spark, sf_dir)


def _case_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.col("doc_id") % 40
    expected = evidence(spark, sf_dir).select(case.alias("c"), "doc_id", "company")
    own = (F.col("doc_id") * 7) % 40
    cited = reviews(spark, sf_dir).filter((case == own) | (case == (own + 1) % 40) | case.isin(0, 8, 16, 24, 32)).select("doc_id", "status", own.alias("c"))
    wanted = expected.groupBy("c").agg(F.count("*").alias("expected"), F.count_distinct("company").alias("companies"))
    met = cited.join(expected.withColumn("hit", F.lit(1)), ["c", "doc_id"], "left")
    got = met.groupBy("c").agg(F.count("*").alias("retrieved"), F.count("hit").alias("hits"), F.count_if(F.col("status") == "accepted").alias("grounded"), F.count_distinct("company").alias("found"))
    rows = wanted.join(got, "c", "left").fillna(0)
    percent = lambda a, b: F.when(F.col(b) == 0, 100.0).otherwise(F.col(a).cast("double") * 100 / F.col(b))
    rows = rows.select("c", percent("hits", "expected").alias("v"), percent("hits", "retrieved").alias("p"), percent("grounded", "retrieved").alias("g"), percent("found", "companies").alias("a"))
    whole = F.col("v") * 0.3 + F.col("p") * 0.25 + F.col("g") * 0.3 + F.col("a") * 0.15
    return rows.select(F.col("c").alias("case_id"), text.rounded(F.col("v")).alias("coverage"), text.rounded(F.col("p")).alias("precision"), text.rounded(F.col("g")).alias("groundedness"), text.rounded(F.col("a")).alias("accuracy"), text.rounded(whole).alias("overall"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case scores of two runs, from whole amounts so that sums are exact."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.when(F.col("o_orderdate") < "1996-01-01", 1).otherwise(2).alias("run"), F.round("o_totalprice").cast("long").alias("v"))
    return rows.groupBy("case_id", "run").agg((F.sum("v") % 100).cast("int").alias("score"))


_RUNS = "ru AS (SELECT o_custkey AS case_id, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 1 ELSE 2 END AS run, (sum(round(o_totalprice)::BIGINT) % 100)::INTEGER AS score FROM orders GROUP BY 1, 2)"


@query(f"WITH {_RUNS} SELECT case_id, b.score - a.score AS delta, CASE WHEN a.score >= 60 AND b.score < 60 THEN 'regression' WHEN a.score < 60 AND b.score >= 60 THEN 'fix' ELSE 'same' END AS change FROM ru a JOIN ru b USING (case_id) WHERE a.run = 1 AND b.run = 2")
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two runs say of one case: score delta, and whether it now fails or passes."""
    rows = _runs(spark, sf_dir).groupBy("case_id").agg(F.max(F.when(F.col("run") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("run") == 2, F.col("score"))).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    change = F.when((F.col("a") >= 60) & (F.col("b") < 60), "regression").when((F.col("a") < 60) & (F.col("b") >= 60), "fix").otherwise("same")
    return rows.select("case_id", (F.col("b") - F.col("a")).alias("delta"), change.alias("change"))


@query(f"WITH {_RUNS} SELECT run::INTEGER AS run, count(*) AS cases, count(*) FILTER (WHERE score >= 60) AS passed, floor(avg(score) + 0.5::DOUBLE)::INTEGER AS mean, floor(count(*) FILTER (WHERE score >= 60) * 100.0::DOUBLE / count(*) + 0.5::DOUBLE)::INTEGER AS pass_rate, concat_ws('; ', CASE WHEN avg(score) < 70 THEN 'mean below 70' END, CASE WHEN min(score) < 5 THEN 'a case below 5' END) AS reasons FROM ru GROUP BY run")
def run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, pass rate and the reasons why a run's gate stays shut."""
    good = F.count_if(F.col("score") >= 60)
    return _runs(spark, sf_dir).groupBy("run").agg(F.count("*").alias("cases"), good.alias("passed"), text.rounded(F.avg("score")).alias("mean"), text.rounded(good * 100 / F.count("*")).alias("pass_rate"), F.concat_ws("; ", F.when(F.avg("score") < 70, "mean below 70"), F.when(F.min("score") < 5, "a case below 5")).alias("reasons"))


@query(f"""WITH x AS (SELECT doc_id, doc_id % 10 AS fixture, CASE WHEN contains(text, 'tion') THEN 'tion' WHEN contains(text, 'ing') THEN 'ing' ELSE 'none' END AS actual, CASE lang WHEN 'en' THEN 'ing' WHEN 'fr' THEN 'tion' ELSE 'none' END AS expected FROM documents WHERE lang IS NOT NULL)
    SELECT fixture, expected, count(*) AS cases, count(*) FILTER (WHERE actual = expected) AS passed, floor(count(*) FILTER (WHERE actual = expected) * 100.0::DOUBLE / count(*) + 0.5::DOUBLE)::INTEGER AS accuracy, string_agg(DISTINCT CASE WHEN actual <> expected THEN expected || ' is ' || actual END, ';' ORDER BY CASE WHEN actual <> expected THEN expected || ' is ' || actual END) AS reasons FROM x GROUP BY 1, 2""")
def golden_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected against actual marks of fixtures, accuracy by category, and what was taken for what."""
    value = F.col("text")
    actual = F.when(value.contains("tion"), "tion").when(value.contains("ing"), "ing").otherwise("none")
    wanted = F.when(F.col("lang") == "en", "ing").when(F.col("lang") == "fr", "tion").otherwise("none")
    rows = table(spark, sf_dir, "documents").filter("lang IS NOT NULL").select((F.col("doc_id") % 10).alias("fixture"), wanted.alias("expected"), F.coalesce(actual, F.lit("none")).alias("actual"))
    right = F.count_if(F.col("actual") == F.col("expected"))
    wrong = F.array_join(F.sort_array(F.collect_set(F.when(F.col("actual") != F.col("expected"), F.concat("expected", F.lit(" is "), "actual")))), ";")
    return rows.groupBy("fixture", "expected").agg(F.count("*").alias("cases"), right.alias("passed"), text.rounded(right * 100 / F.count("*")).alias("accuracy"), F.when(F.length(wrong) > 0, wrong).alias("reasons"))


@query("SELECT event_type, count(*) AS total, count(*) FILTER (WHERE user_id % 2 = 0) AS official, count(*) FILTER (WHERE user_id % 2 <> 0) AS discovery, count(*) FILTER (WHERE value >= 8.2) AS high, max(ts)::DATE AS latest, count(DISTINCT user_id) AS sources FROM events GROUP BY event_type")
def catalog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("user_id") % 2 == 0
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("total"), F.count_if(even).alias("official"), F.count_if(~even).alias("discovery"), F.count_if(F.col("value") >= 8.2).alias("high"), F.to_date(F.max("ts")).alias("latest"), F.count_distinct("user_id").alias("sources"))


@query(f"WITH {EVIDENCE}, {REVIEWS} SELECT company, floor(avg(source_quality) + 0.5::DOUBLE)::INTEGER AS rating, floor(avg(source_quality) * 0.7::DOUBLE + 30.0::DOUBLE * count(status) / count(*) + 0.5::DOUBLE)::INTEGER AS completeness FROM ev LEFT JOIN rv USING (doc_id) GROUP BY company")
def source_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence(spark, sf_dir).drop("text").join(reviews(spark, sf_dir), "doc_id", "left")
    return rows.groupBy("company").agg(text.rounded(F.avg("source_quality")).alias("rating"), text.rounded(F.avg("source_quality") * 0.7 + F.count("status") * 30.0 / F.count("*")).alias("completeness"))


# Aliases of companies, in order of precedence.
ALIASES = [("north", "^s|north"), ("ring", "ring"), ("tin", "tin|box"), ("any", "e")]


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(p_name, '(?i){p}') THEN '{n}'" for n, p in ALIASES) + " END AS alias FROM part")
def alias_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first company whose alias a title has; the few aliases are sent to every task."""
    dim = F.broadcast(spark.createDataFrame([(i, n, f"(?i){p}") for i, (n, p) in enumerate(ALIASES)], "i int, alias string, pattern string"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    met = rows.join(dim, F.expr("p_name RLIKE pattern"), "left")
    return met.groupBy("p_partkey").agg(F.min_by("alias", "i").alias("alias"))


@query("""SELECT doc_id, sha256('{"company":"' || source || '","number":' || doc_id || ',"title":"' || coalesce(lang, '') || '"}') AS memo_hash, CASE WHEN n_chars >= 2000 THEN 'high' WHEN n_chars >= 500 THEN 'medium' ELSE 'limited' END AS label,
    CASE WHEN n_chars >= 2000 THEN 92 WHEN n_chars >= 500 THEN 78 ELSE 60 END + CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 0 END AS base_score, floor(n_chars * 0.15::DOUBLE + doc_id % 1000 * 0.6::DOUBLE + 0.5::DOUBLE)::BIGINT AS cost_micros,
    left(string_split(regexp_replace(text, '([.!?])[ \t\n\\x0B\f\r]+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1))[1], 360) AS opening FROM documents WHERE text IS NOT NULL AND n_chars IS NOT NULL""")
def memo_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small fields of a memo: hash of its stable JSON, extraction label and score, cost in millionths, opening sentence."""
    n = F.col("n_chars")
    json = F.to_json(F.struct(F.col("source").alias("company"), F.col("doc_id").alias("number"), F.coalesce("lang", F.lit("")).alias("title")))
    label = F.when(n >= 2000, "high").when(n >= 500, "medium").otherwise("limited")
    base = F.when(n >= 2000, 92).when(n >= 500, 78).otherwise(60) + F.when(F.col("doc_id") % 2 == 0, 3).otherwise(0)
    cost = F.floor(n * 0.15 + F.col("doc_id") % 1000 * 0.6 + 0.5)
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL AND n_chars IS NOT NULL")
    return rows.select("doc_id", F.sha2(json, 256).alias("memo_hash"), label.alias("label"), base.alias("base_score"), cost.alias("cost_micros"), F.substring(text.sentences(F.col("text"))[0], 1, 360).alias("opening"))


# Runs of a parser over documents: which were promoted, in which order, and what is current.
_PARSES = "pa AS (SELECT o_custkey AS document, o_orderkey AS run, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS promoted, o_orderdate AS completed FROM orders)"


@query(f"WITH {_PARSES}, r AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY promoted DESC NULLS LAST, completed DESC, run DESC) AS r FROM pa) SELECT run, CASE WHEN promoted IS NULL THEN 'preview' WHEN r = 1 THEN 'promoted' ELSE 'superseded' END AS state, r = 1 AS is_current FROM r")
def promotion_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest promotion of each document stays, older ones are superseded, the others are previews."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document"), F.col("o_orderkey").alias("run"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("promoted"), F.col("o_orderdate").alias("completed"))
    place = F.row_number().over(Window.partitionBy("document").orderBy(F.desc_nulls_last("promoted"), F.desc("completed"), F.desc("run")))
    rows = rows.withColumn("r", place)
    return rows.select("run", F.when(F.col("promoted").isNull(), "preview").when(F.col("r") == 1, "promoted").otherwise("superseded").alias("state"), (F.col("r") == 1).alias("is_current"))


@query(f"WITH {_PARSES} SELECT document, arg_max(run, struct_pack(p := promoted, r := run)) FILTER (WHERE promoted IS NOT NULL) AS current_run, count(*) FILTER (WHERE promoted IS NULL) AS previews, max(completed)::DATE AS last_completed FROM pa GROUP BY document")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current run, open previews and last run of each document."""
    promoted = F.when(F.col("o_orderstatus") == "F", F.struct("o_orderdate", "o_orderkey"))
    by = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("document"))
    return by.agg(F.max_by("o_orderkey", promoted).alias("current_run"), F.count_if(F.col("o_orderstatus") != "F").alias("previews"), F.to_date(F.max("o_orderdate")).alias("last_completed"))


_TOKEN = "tk AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN upper(sha256(doc_id::VARCHAR)) ELSE sha256(doc_id::VARCHAR) END AS token, toxic = 1 AS revoked FROM labels)"


@query(f"WITH {_TOKEN} SELECT doc_id, token FROM tk WHERE regexp_matches(token, '^[a-f0-9]{{64}}$') AND NOT revoked")
def report_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public reports whose token has the right form and isn't revoked."""
    own = F.sha2(F.col("doc_id").cast("string"), 256)
    rows = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.upper(own)).otherwise(own).alias("token"), (F.col("toxic") == 1).alias("revoked"))
    return rows.filter(F.col("token").rlike("^[a-f0-9]{64}$") & ~F.col("revoked")).select("doc_id", "token")


@query("SELECT conv_id, '# Report ' || conv_id || chr(10) || string_agg('- [' || turn || '] ' || role || ': ' || length(text), chr(10) ORDER BY turn) AS body, count(*) AS claims FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL GROUP BY conv_id")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's claims as lines of Markdown, one row for each report."""
    line = F.concat(F.lit("- ["), "turn", F.lit("] "), "role", F.lit(": "), F.length("text"))
    by = table(spark, sf_dir, "conversations").filter("text IS NOT NULL AND role IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"), F.count("*").alias("claims"))
    return by.select("conv_id", F.concat(F.lit("# Report "), "conv_id", F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("body"), "claims")


@query("SELECT event_id, event_type, coalesce(c_name, 'unknown') AS actor FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) LEFT JOIN customer ON user_id = c_custkey")
def audit_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 newest events with who did them."""
    newest = table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)
    return newest.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name"), "user_id", "left").select("event_id", "event_type", F.coalesce("c_name", F.lit("unknown")).alias("actor"))


_UNIT = "list_reduce(list_transform(list_zip({0}, {1}), lambda p: p[1] * p[2]), lambda a, b: a + b, 0.0::DOUBLE)"
_VEC = f"vc AS (SELECT vec_id, e, sqrt({_UNIT.format('e', 'e')}) AS size FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0))"
#: Vectors whose number this divides are the stated queries.
QUERY_STEP = 100


@query(f"""WITH {_VEC}, s AS (SELECT q.vec_id AS query_id, c.vec_id, CASE WHEN q.size * c.size = 0 THEN 0 ELSE {_UNIT.format('q.e', 'c.e')} / (q.size * c.size) END AS score FROM vc q JOIN vc c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % {QUERY_STEP} = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s) SELECT query_id, place::INTEGER AS place, vec_id, score FROM r WHERE place <= 10""")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 vectors nearest by cosine to each stated query, by products of blocks."""
    rows = table(spark, sf_dir, "embeddings")
    found = vectors.nearest(rows.filter(F.col("vec_id") % QUERY_STEP == 0), rows, "vec_id", "embedding", 10)
    return found.select(F.col("query").alias("query_id"), "place", F.col("row").alias("vec_id"), "score")


_ASKED = "aq AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda t: length(t) >= 3)) AS terms FROM benchmark)"


@query(f"""WITH {EVIDENCE}, {SCORED}, {REVIEWS}, {_VEC}, {_ASKED}, p AS (SELECT sc.doc_id, company, d, quality, text, e, size FROM sc JOIN rv USING (doc_id) LEFT JOIN vc ON vc.vec_id = sc.doc_id WHERE status = 'accepted' AND risk < 60),
    s AS (SELECT item_id, p.doc_id, d, CASE WHEN len(terms) = 0 THEN 0 ELSE len(list_filter(terms, lambda t: contains(lower(text), t)))::DOUBLE / len(terms) END * 0.58::DOUBLE + coalesce(CASE WHEN p.size * q.size > 0 THEN {_UNIT.format('q.e', 'p.e')} / (q.size * p.size) END, 0) * 0.42::DOUBLE + quality / 10000.0::DOUBLE AS score
        FROM aq JOIN p ON true LEFT JOIN vc q ON q.vec_id = item_id), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, d DESC, doc_id) AS place FROM s) SELECT item_id, place::INTEGER AS place, doc_id, round(score, 9) AS score FROM r WHERE place <= 10""")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 accepted documents that fit each item of the benchmark best: share of its terms that stand in a text, inside longer words, too, cosine of their vectors, quality.

    Terms meet the different words of all texts by parts of words, and documents meet terms by their words. Each document
    that holds a term of a question is scored for it; of the others, the nearest by vector and quality, and the best of
    those whose cosine is 0 since a vector is missing or of another length. What a document holds is gathered where it is
    scored, so pairs of a question and a document do not move; ten of each task do.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    embedded = table(spark, sf_dir, "embeddings").select("vec_id", vectors.finite(F.col("embedding")).alias("e")).filter("e IS NOT NULL")
    runs = lambda: F.filter(F.split(F.lower(F.translate("text", "İ", "i")), "[^a-z]+"), lambda t: F.length(t) >= 3)
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(runs()).alias("terms"))
    items = asked.filter("terms IS NOT NULL").join(embedded.withColumnRenamed("vec_id", "item_id"), "item_id", "left").select("item_id", "e", F.coalesce(F.size("e"), F.lit(0)).alias("length"))
    by_term = asked.select("item_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    accepted = keyed.kept(evidence(spark, sf_dir), reviews(spark, sf_dir).filter("status = 'accepted'").select("doc_id"), "doc_id")
    longest = by_term.agg(F.max(F.length("term"))).first()[0] or 0
    # written before the filter, which would be pushed below the scores and score each text many times
    fit = stored(scored(accepted).select("doc_id", "d", "quality", "risk", text.pieces(runs(), longest).alias("own")), "hybrid-fit").filter("risk < 60").drop("risk")
    words = fit.select(F.explode("own").alias("word")).distinct().select("word", F.explode(text.parts(F.col("word"))).alias("part"))
    hits = words.join(by_term.select("term", F.substring("term", 1, text.PART).alias("part")).distinct(), "part").filter(F.contains("word", "term")).select("word", "term")
    held = fit.select("doc_id", F.explode("own").alias("word")).join(hits, "word").groupBy("doc_id").agg(F.collect_set("term").alias("held"))
    met = keyed.kept(held.select("doc_id", F.explode("held").alias("term")), by_term, "term").groupBy("doc_id", "item_id", "n_terms").agg(F.count("*").alias("matched")).select("item_id", "doc_id", (F.col("matched") / F.col("n_terms")).alias("share"))
    docs = fit.drop("own").join(embedded.withColumnRenamed("vec_id", "doc_id"), "doc_id", "left")
    near = vectors.nearest(items.withColumnRenamed("item_id", "id"), docs.withColumnRenamed("doc_id", "id"), "id", "e", 10, F.col("quality") / 4200.0, -F.unix_date("d"), True)
    by_length = docs.select("doc_id", "d", "quality", F.coalesce(F.size("e"), F.lit(0)).alias("other"))
    best = keyed.best_rows(by_length, ["other"], [F.desc("quality"), F.desc("d"), F.asc("doc_id")], 10)
    apart = items.join(F.broadcast(best), F.expr("other <> length OR length = 0"))  # ten rows for each length of vectors
    without = near.select(F.col("query").alias("item_id"), F.col("row").alias("doc_id")).unionByName(apart.select("item_id", "doc_id")).distinct().withColumn("share", F.lit(0.0))
    sized, asking = docs.withColumn("size", F.sqrt(dot("e", "e"))), items.select("item_id", F.col("e").alias("qe"), F.sqrt(dot("e", "e")).alias("qsize"))
    order = [F.desc("score"), F.desc("d"), F.asc("doc_id")]

    def rated(pairs: DataFrame) -> DataFrame:
        size = F.col("size") * F.col("qsize")
        cosine = F.coalesce(F.when(size > 0, dot("qe", "e") / size), F.lit(0.0))
        score = F.round(F.col("share") * 0.58 + cosine * 0.42 + F.col("quality") / 10_000.0, 9)
        return pairs.join(sized, "doc_id").join(F.broadcast(asking), "item_id").select("item_id", "doc_id", "d", score.alias("score"))

    # a pair in both has its full share among the first, if it is among the best there
    rows = keyed.best_rows(rated(met), ["item_id"], order, 10).unionByName(rated(without)).groupBy("item_id", "doc_id", "d").agg(F.max("score").alias("score"))
    newest = fit.select("doc_id", "d").orderBy(F.desc("d"), F.asc("doc_id")).limit(10)
    unasked = asked.filter("terms IS NULL").crossJoin(F.broadcast(newest)).select("item_id", "doc_id", "d", F.lit(None).cast("double").alias("score"))  # no text, no score
    return keyed.best_rows(rows.unionByName(unasked), ["item_id"], order, 10, "place").select("item_id", "place", "doc_id", "score")
