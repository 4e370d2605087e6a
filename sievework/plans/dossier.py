"""Dossiers: which evidence is fit for research, what a team has decided on it, and what follows from that."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions import rules, text
from sievework.operators import keyed
from sievework.storage import stored

from .base import EVIDENCE, REVIEWS, SCORED, evidence, registry, reviews, scored, table

QUERIES, ORACLES, query = registry()

_ANY = " OR ".join(f"regexp_matches(text, '(?i){p}')" for p in rules.BOILERPLATE)
WORDS = r"list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"


@query(f"WITH {EVIDENCE} SELECT doc_id, company, kind FROM ev WHERE len({WORDS}) >= 18 AND NOT ({_ANY})")
def research_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of enough words that are no filing boilerplate."""
    return evidence(spark, sf_dir).filter(text.research_grade(F.col("text"), rules.BOILERPLATE)).select("doc_id", "company", "kind")


@query(f"""WITH {EVIDENCE}, {REVIEWS} SELECT doc_id, company, kind, d, coalesce(status, 'unreviewed') AS status FROM ev LEFT JOIN rv USING (doc_id)
    WHERE (text ILIKE '%ation%' OR company ILIKE '%src1%') AND kind = 'sec' AND d >= DATE '2020-06-01' AND coalesce(status, 'unreviewed') <> 'rejected'""")
def evidence_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence by free text over its columns, kind, date and review status."""
    rows = keyed.overlay(evidence(spark, sf_dir), reviews(spark, sf_dir), "doc_id", "status", "unreviewed")
    found = F.col("text").ilike("%ation%") | F.col("company").ilike("%src1%")
    return rows.filter(found & (F.col("kind") == "sec") & (F.col("d") >= "2020-06-01") & (F.col("status") != "rejected")).select("doc_id", "company", "kind", "d", "status")


@query(f"WITH {EVIDENCE}, {SCORED}, {REVIEWS} SELECT doc_id, company, d, quality, risk::INTEGER AS risk FROM sc JOIN rv USING (doc_id) WHERE status = 'accepted' AND quality >= 45 AND risk < 60 AND kind IN ('sec', 'ir') AND d BETWEEN DATE '2020-01-01' AND DATE '2022-06-30'")
def eligible_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be cited: accepted, good enough, readable, of the kinds and dates asked for."""
    return eligible(spark, sf_dir).filter(F.col("kind").isin("sec", "ir") & F.col("d").between("2020-01-01", "2022-06-30")).select("doc_id", "company", "d", "quality", "risk")


def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted evidence of enough quality and low risk; accepted texts alone are scored.

    Scores are written before they are filtered, as a filter would be pushed below them and score each text many times.
    """
    accepted = reviews(spark, sf_dir).filter("status = 'accepted'").select("doc_id")
    rows = scored(keyed.kept(evidence(spark, sf_dir), accepted, "doc_id"))
    return stored(rows.select("doc_id", "company", "kind", "d", "quality", "risk"), "scored").filter("quality >= 45 AND risk < 60")


ELIGIBLE = "el AS (SELECT sc.*, status, toxic FROM sc JOIN rv USING (doc_id) WHERE status = 'accepted' AND quality >= 45 AND risk < 60)"

_CLAIM_SCORES = ", ".join(f"{{'n': len(list_distinct(regexp_extract_all(lower(text), '(?i){p}'))), 'o': {-i}, 'k': '{k}', 'r': {r}}}" for i, (k, p, r) in enumerate(rules.PROSE_CLAIMS))


@query(rf"""WITH {EVIDENCE}, {SCORED}, c AS (SELECT doc_id, quality, relevance, risk, list_reverse_sort([{_CLAIM_SCORES}]) AS s,
        regexp_matches(text, '(?i)\b(?:{rules.PROSE_POSITIVE})\b') AS up, regexp_matches(text, '(?i)\b(?:{rules.PROSE_NEGATIVE})\b') AS down FROM sc WHERE risk < 60 AND quality >= 45 AND relevance >= 30)
    SELECT doc_id, s[1].k AS claim, CASE WHEN (CASE WHEN s[1].r THEN down ELSE up END) AND NOT (CASE WHEN s[1].r THEN up ELSE down END) THEN 'supports'
        WHEN (CASE WHEN s[1].r THEN up ELSE down END) AND NOT (CASE WHEN s[1].r THEN down ELSE up END) THEN 'weakens' ELSE 'watch' END AS impact,
        greatest(0, least(100, floor(34 + s[1].n * 8 + (s[1].n - s[2].n) * 5 + quality::DOUBLE * 0.18::DOUBLE + relevance::DOUBLE * 0.12::DOUBLE - risk::DOUBLE * 0.2::DOUBLE + 0.5::DOUBLE)::INTEGER))::INTEGER AS confidence FROM c WHERE s[1].n >= 1""")
def claim_suggestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claim that an eligible text speaks to most, which way it points, and how sure that is."""
    rows = scored(evidence(spark, sf_dir)).filter("risk < 60 AND quality >= 45 AND relevance >= 30")
    value = F.col("text")
    each = [F.struct(text.distinct_matches(value, f"(?i){p}").alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k"), F.lit(r).alias("r")) for i, (k, p, r) in enumerate(rules.PROSE_CLAIMS)]
    s = rows.withColumn("s", F.sort_array(F.array(*each), asc=False)).withColumns({"top": F.col("s")[0], "next": F.col("s")[1]})
    up, down = value.rlike(text.word(rules.PROSE_POSITIVE)), value.rlike(text.word(rules.PROSE_NEGATIVE))
    good, bad = F.when(F.col("top.r"), down).otherwise(up), F.when(F.col("top.r"), up).otherwise(down)
    sure = 34 + F.col("top.n") * 8 + (F.col("top.n") - F.col("next.n")) * 5 + F.col("quality") * 0.18 + F.col("relevance") * 0.12 - F.col("risk") * 0.2
    return s.filter("top.n >= 1").select("doc_id", F.col("top.k").alias("claim"), F.when(good & ~bad, "supports").when(bad & ~good, "weakens").otherwise("watch").alias("impact"), text.score(sure).alias("confidence"))


_LAST = "string_split(acc, chr(1))[-1]"
_PIECES = "array_to_string(list_transform(range(0, greatest(length(s), 1), 1100), lambda i: trim(s[i + 1 : i + 1100])), chr(1))"


@query(rf"""WITH x AS (SELECT doc_id, list_prepend('', string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+([A-Z0-9])', '\1' || chr(2) || '\2', 'g'), chr(2))) AS l FROM documents),
    p AS (SELECT doc_id, list_filter(string_split(list_reduce(l, lambda acc, s: CASE WHEN length(s) > 1100 THEN acc || chr(1) || {_PIECES} || chr(1)
        WHEN {_LAST} = '' THEN acc || s WHEN length({_LAST}) + length(s) + 1 > 1100 THEN acc || chr(1) || s ELSE acc || ' ' || s END), chr(1)), lambda t: t <> '') AS l FROM x),
    u AS (SELECT doc_id, unnest(l) AS t FROM p), g AS (SELECT doc_id, t, count(*) AS n FROM u WHERE length(t) >= 90 GROUP BY doc_id, t)
    SELECT doc_id, count(*) AS passages, sum(length(t))::BIGINT AS characters, max(length(t))::BIGINT AS longest, sum(n - 1)::BIGINT AS repeated FROM g GROUP BY doc_id""")
def sentence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different passages of at least 90 characters of each document, of whole sentences up to 1,100 characters."""
    parts = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.passages(F.col("text"))).alias("t")).filter(F.length("t") >= 90)
    once = parts.groupBy("doc_id", "t").agg(F.count("*").alias("n"))
    return once.groupBy("doc_id").agg(F.count("*").alias("passages"), F.sum(F.length("t")).cast("long").alias("characters"), F.max(F.length("t")).cast("long").alias("longest"), F.sum(F.col("n") - 1).alias("repeated"))


_LINKS = r"""a0 AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>') AS l FROM pages), a1 AS (SELECT page_id, unnest(l) AS a, generate_subscripts(l, 1) - 1 AS position FROM a0),
    li AS (SELECT page_id, position, regexp_extract(a, '(?i)href="([^"]*)"', 1) AS href, trim(regexp_replace(a, '(?s)<[^>]*>', '', 'g')) AS title FROM a1)"""
_KEY = "trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))"


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.sources import flatten

    key = F.trim(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " "))
    return flatten.links(table(spark, sf_dir, "pages"), "page_id", "html").withColumn("title_key", key)


@query(f"WITH {_LINKS} SELECT href, min({_KEY}) AS title_key, count(*) AS cards FROM li GROUP BY href HAVING count(DISTINCT {_KEY}) = 1")
def ambiguous_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose address stands for one title only; the others are left out as ambiguous."""
    return _links(spark, sf_dir).groupBy("href").agg(F.min("title_key").alias("title_key"), F.count("*").alias("cards"), F.count_distinct("title_key").alias("titles")).filter("titles = 1").drop("titles")


@query(f"WITH {_LINKS}, r AS (SELECT {_KEY} AS title_key, href, page_id, row_number() OVER (PARTITION BY {_KEY} ORDER BY page_id DESC, position DESC) AS r FROM li) SELECT title_key, href, page_id FROM r WHERE r = 1")
def keep_last_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last link of each title."""
    last = F.max_by(F.struct("href", "page_id"), F.struct("page_id", "position"))
    return _links(spark, sf_dir).groupBy("title_key").agg(last.alias("l")).select("title_key", "l.href", "l.page_id")


_TYPE = """CASE WHEN regexp_matches(title || ' ' || href, '(?i)tion|letter to shareholders') THEN 'Shareholder Letter' WHEN regexp_matches(title || ' ' || href, '(?i)presentation|slides|investor update|outlook|and') THEN 'Presentation'
    WHEN regexp_matches(title || ' ' || href, '(?i)earnings|financial results|quarterly results|reports? .* results|ing') THEN 'Earnings Release' ELSE 'Press Release' END"""


@query(f"""WITH {_LINKS}, t AS (SELECT page_id, position, title, {_TYPE} AS type FROM li)
    SELECT page_id, position::INTEGER AS position, type, greatest(0, least(100, CASE type WHEN 'Earnings Release' THEN 85 WHEN 'Presentation' THEN 78 WHEN 'Shareholder Letter' THEN 80 ELSE 55 END
        + least(15, len(regexp_extract_all(title, '(?i)th|er|re')) * 5) - CASE WHEN type = 'Press Release' AND regexp_matches(title, '(?i)conference|participate|date of|to release|webcast|of') THEN 35 ELSE 0 END))::INTEGER AS relevance FROM t""")
def title_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of document that a link's title and address tell of, and how relevant it is. The words fit the given prose as well."""
    both, title = F.concat_ws(" ", "title", "href"), F.col("title")
    kind = F.when(both.rlike("(?i)tion|letter to shareholders"), "Shareholder Letter").when(both.rlike("(?i)presentation|slides|investor update|outlook|and"), "Presentation")
    kind = kind.when(both.rlike("(?i)earnings|financial results|quarterly results|reports? .* results|ing"), "Earnings Release").otherwise("Press Release")
    base = F.when(F.col("type") == "Earnings Release", 85).when(F.col("type") == "Presentation", 78).when(F.col("type") == "Shareholder Letter", 80).otherwise(55)
    event = F.when((F.col("type") == "Press Release") & title.rlike("(?i)conference|participate|date of|to release|webcast|of"), 35).otherwise(0)
    points = base + F.least(F.lit(15), F.regexp_count(title, F.lit("(?i)th|er|re")) * 5) - event
    return _links(spark, sf_dir).withColumn("type", kind).select("page_id", "position", "type", F.greatest(F.lit(0), F.least(F.lit(100), points)).alias("relevance"))


# Decisions on evidence: the labels, with a claim that follows from the document's number and a day of review.
_DECISIONS = "de AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'accepted' ELSE 'rejected' END AS status, 'src' || (doc_id % 7) AS claim_company, (50 + doc_id % 50)::INTEGER AS confidence FROM labels)"


def _link_points(quality, days, confidence):
    band = F.when(quality >= 90, 10).when(quality >= 80, 8).when(quality >= 70, 6).otherwise(4)
    recent = F.when(days <= 180, 1.0).when(days <= 365, 0.8).otherwise(0.55)
    return F.greatest(F.lit(2), text.rounded(band * recent * F.greatest(F.lit(50), confidence) / 100))


@query(f"""WITH {EVIDENCE}, {_DECISIONS}, j AS (SELECT ev.doc_id, company, status, source_quality, confidence, claim_company, DATE '2022-12-31' - d AS days FROM ev JOIN de USING (doc_id)),
    l AS (SELECT doc_id, status, CASE WHEN status = 'accepted' AND company = claim_company THEN (CASE WHEN doc_id % 3 = 0 THEN -1 ELSE 1 END) * greatest(2, floor(CASE WHEN source_quality >= 90 THEN 10 WHEN source_quality >= 80 THEN 8 WHEN source_quality >= 70 THEN 6 ELSE 4 END
        * CASE WHEN days <= 180 THEN 1.0::DOUBLE WHEN days <= 365 THEN 0.8::DOUBLE ELSE 0.55::DOUBLE END * greatest(50, confidence) / 100 + 0.5::DOUBLE)::INTEGER) END AS impact FROM j)
    SELECT doc_id, status, impact::INTEGER AS impact, CASE WHEN abs(impact) >= 9 THEN 'high' WHEN abs(impact) >= 6 THEN 'medium' END AS alert FROM l""")
def evidence_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions applied: a signed link to the claim where it is accepted and of the same company, and an alert where that weighs much."""
    decided = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "accepted").otherwise("rejected").alias("status"), F.concat(F.lit("src"), F.col("doc_id") % 7).alias("claim_company"), (50 + F.col("doc_id") % 50).alias("confidence"))
    rows = evidence(spark, sf_dir).drop("text").join(decided, "doc_id")
    points = _link_points(F.col("source_quality"), F.datediff(F.lit("2022-12-31").cast("date"), "d"), F.col("confidence"))
    linked = F.when((F.col("status") == "accepted") & (F.col("company") == F.col("claim_company")), F.when(F.col("doc_id") % 3 == 0, -points).otherwise(points))
    return rows.withColumn("impact", linked).select("doc_id", "status", "impact", F.when(F.abs("impact") >= 9, "high").when(F.abs("impact") >= 6, "medium").alias("alert"))


@query(f"""WITH {EVIDENCE}, {REVIEWS}, l AS (SELECT 'src' || (doc_id % 20) || ':' || (doc_id % 5) AS claim, CASE WHEN toxic = 1 THEN -7 WHEN status = 'accepted' THEN 3 ELSE -1 END AS impact FROM rv WHERE doc_id IN (SELECT doc_id FROM ev))
    SELECT claim, greatest(10, least(90, 50 + sum(impact)))::BIGINT AS support, count(*) FILTER (WHERE impact > 0) AS supports, count(*) FILTER (WHERE impact < 0) AS weakens FROM l GROUP BY claim""")
def claim_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support of each claim from its links, held to 10 to 90, with how many support and weaken it."""
    known = reviews(spark, sf_dir).join(evidence(spark, sf_dir).select("doc_id"), "doc_id", "left_semi")
    claim = F.concat(F.lit("src"), F.col("doc_id") % 20, F.lit(":"), F.col("doc_id") % 5)
    links = known.select(claim.alias("claim"), F.when(F.col("toxic") == 1, -7).when(F.col("status") == "accepted", 3).otherwise(-1).alias("impact"))
    return links.groupBy("claim").agg(F.greatest(F.lit(10).cast("long"), F.least(F.lit(90).cast("long"), 50 + F.sum("impact"))).alias("support"), F.count_if(F.col("impact") > 0).alias("supports"), F.count_if(F.col("impact") < 0).alias("weakens"))


@query(f"""WITH {EVIDENCE}, {SCORED}, {REVIEWS}, {ELIGIBLE} SELECT company, count(*) AS items, floor(avg(quality) + 0.5::DOUBLE)::INTEGER AS quality, least(100, count(*) * 12 + count(DISTINCT kind) * 16)::INTEGER AS diversity,
    floor(100.0::DOUBLE * count(*) FILTER (WHERE d >= DATE '2021-12-31') / count(*) + 0.5::DOUBLE)::INTEGER AS recent FROM el GROUP BY company""")
def packet_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quality, diversity of documents and kinds, and recent share of what may be cited for each company."""
    by = eligible(spark, sf_dir).groupBy("company")
    recent = F.count_if(F.col("d") >= "2021-12-31") * 100 / F.count("*")
    return by.agg(F.count("*").alias("items"), text.rounded(F.avg("quality")).alias("quality"), F.least(F.lit(100), F.count("*") * 12 + F.count_distinct("kind") * 16).cast("int").alias("diversity"), text.rounded(recent).alias("recent"))


@query(f"""WITH {EVIDENCE}, {SCORED}, {REVIEWS}, p AS (SELECT company, count(*) AS new_evidence, count(*) FILTER (WHERE quality >= 70) AS high_value, count(*) FILTER (WHERE status IS NULL) AS pending FROM sc LEFT JOIN rv USING (doc_id) GROUP BY company),
    o AS (SELECT company, doc_id, relevance >= 35 AS fit, quality, d, relevance, row_number() OVER (PARTITION BY company ORDER BY relevance >= 35 DESC, CASE WHEN relevance >= 35 THEN relevance END DESC NULLS LAST, quality DESC, d DESC, doc_id) AS r,
        bool_or(relevance >= 35) OVER (PARTITION BY company) AS any_fit FROM sc)
    SELECT company, new_evidence, high_value, pending, string_agg(doc_id::VARCHAR, ',' ORDER BY r) FILTER (WHERE r <= 3 AND (fit OR NOT any_fit)) AS top FROM p JOIN o USING (company) GROUP BY ALL""")
def briefing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each company's evidence, and its three most relevant items, or its three best where none is relevant."""
    rows = scored(evidence(spark, sf_dir)).drop("text").join(reviews(spark, sf_dir).select("doc_id", "status"), "doc_id", "left").withColumn("fit", F.col("relevance") >= 35)
    counts = rows.groupBy("company").agg(F.count("*").alias("new_evidence"), F.count_if(F.col("quality") >= 70).alias("high_value"), F.count_if(F.col("status").isNull()).alias("pending"))
    order = [F.desc("fit"), F.when(F.col("fit"), F.col("relevance")).desc_nulls_last(), F.desc("quality"), F.desc("d"), F.asc("doc_id")]
    top = keyed.best_rows(rows.select("company", "doc_id", "fit", "relevance", "quality", "d"), ["company"], order, 3, "r")
    listed = top.groupBy("company").agg(F.bool_or("fit").alias("any"), F.sort_array(F.collect_list(F.struct("r", "doc_id", "fit"))).alias("l"))
    ids = F.array_join(F.transform(F.filter("l", lambda x: x["fit"] | ~F.col("any")), lambda x: x["doc_id"].cast("string")), ",")
    return counts.join(listed, "company").select("company", "new_evidence", "high_value", "pending", ids.alias("top"))


@query(f"""WITH {EVIDENCE}, {SCORED}, {REVIEWS}, c AS (SELECT *, doc_id % 4 AS topic FROM sc), done AS (SELECT DISTINCT company, topic, kind FROM c JOIN rv USING (doc_id) WHERE status = 'accepted' AND quality >= 60),
    r AS (SELECT c.company, c.topic, c.kind, c.doc_id, c.quality, row_number() OVER (PARTITION BY c.company, c.topic, c.kind ORDER BY c.quality DESC, c.d DESC, c.doc_id) AS r FROM c LEFT JOIN rv USING (doc_id)
        WHERE status IS NULL AND NOT EXISTS (SELECT 1 FROM done WHERE done.company = c.company AND done.topic = c.topic AND done.kind = c.kind)) SELECT company, topic, kind, doc_id, quality FROM r WHERE r = 1""")
def greedy_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best unreviewed item for each company, topic and kind that has no accepted one."""
    rows, status = evidence(spark, sf_dir).withColumn("topic", F.col("doc_id") % 4), reviews(spark, sf_dir).select("doc_id", "status")
    cell = ["company", "topic", "kind"]
    accepted = scored(keyed.kept(rows, status.filter("status = 'accepted'").select("doc_id"), "doc_id"))
    done = stored(accepted.groupBy(*cell).agg(F.max("quality").alias("best")), "done-cells").filter("best >= 60")
    open_ = keyed.kept(rows.join(done, cell, "left_anti"), status.select("doc_id"), "doc_id", "left_anti")  # of the rest, only what lies in open cells is scored
    return keyed.best_rows(scored(open_).drop("text"), cell, [F.desc("quality"), F.desc("d"), F.asc("doc_id")]).select(*cell, "doc_id", "quality")


@query(f"""WITH {EVIDENCE}, w AS (SELECT doc_id, company, d, kind, row_number() OVER (PARTITION BY company, kind ORDER BY d DESC, doc_id DESC) AS rk FROM ev),
    p AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY CASE WHEN kind = 'sec' AND rk <= 6 THEN 0 WHEN kind = 'ir' THEN 1 ELSE 2 END, d DESC, doc_id DESC) AS pick FROM w) SELECT company, doc_id, kind, pick::INTEGER AS pick FROM p WHERE pick <= 15""")
def coverage_reserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """15 items of each company: its 6 newest filings first, then the newest others, then filings again."""
    rows = evidence(spark, sf_dir).select("doc_id", "company", "d", "kind")
    newest = keyed.best_rows(rows, ["company", "kind"], [F.desc("d"), F.desc("doc_id")], 15, "rk")
    turn = F.when((F.col("kind") == "sec") & (F.col("rk") <= 6), 0).when(F.col("kind") == "ir", 1).otherwise(2)
    return keyed.best_rows(newest, ["company"], [turn.asc(), F.desc("d"), F.desc("doc_id")], 15, "pick").select("company", "doc_id", "kind", "pick")


@query(f"""WITH {EVIDENCE}, {SCORED}, {REVIEWS}, {ELIGIBLE}, a AS (SELECT company, doc_id, doc_id % 4 AS topic, quality, row_number() OVER (PARTITION BY company, doc_id % 4 ORDER BY quality DESC, doc_id) AS r FROM el),
    b AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY quality DESC, doc_id) AS n FROM a WHERE r = 1) SELECT company, topic, doc_id, n::INTEGER AS n FROM b WHERE n <= 3""")
def topic_diverse_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best item of each of a company's topics, three topics at most."""
    best = keyed.best_rows(eligible(spark, sf_dir).select("company", "doc_id", "quality", (F.col("doc_id") % 4).alias("topic")), ["company", "topic"], [F.desc("quality"), F.asc("doc_id")])
    return keyed.best_rows(best, ["company"], [F.desc("quality"), F.asc("doc_id")], 3, "n").select("company", "topic", "doc_id", "n")


# Memos: one for each conversation; its packet cites a document for each turn, as it was when the memo was made.
_MEMOS = "mm AS (SELECT conv_id AS memo, turn, CASE WHEN (conv_id + turn) % 97 <> 0 THEN (conv_id * 13 + turn * 7) % 900 END AS cited, CASE WHEN turn % 3 = 0 THEN sha256(((conv_id * 13 + turn * 7) % 900)::VARCHAR) ELSE 'old' END AS hash FROM conversations)"


def _memos(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.pmod(F.col("conv_id") * 13 + F.col("turn") * 7, F.lit(900))
    cited = F.when((F.col("conv_id") + F.col("turn")) % 97 != 0, number)
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("memo"), "turn", cited.alias("cited"), F.when(F.col("turn") % 3 == 0, F.sha2(number.cast("string"), 256)).otherwise("old").alias("hash"))


_STALE = "CASE WHEN cited IS NULL THEN 'no identifier' WHEN e.doc_id IS NULL THEN 'not in the catalog' WHEN coalesce(status, '') <> 'accepted' THEN 'not approved' WHEN e.quality < 45 OR e.risk >= 60 THEN 'below the policy' WHEN hash <> sha256(e.doc_id::VARCHAR) THEN 'changed' END"


def _stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """memo, turn and why a citation no longer holds, null where it does."""
    now = scored(evidence(spark, sf_dir)).select(F.col("doc_id").alias("cited"), "quality", "risk", F.lit(True).alias("there"))
    rows = _memos(spark, sf_dir).join(now, "cited", "left").join(reviews(spark, sf_dir).select(F.col("doc_id").alias("cited"), "status"), "cited", "left")
    why = F.when(F.col("cited").isNull(), "no identifier").when(F.col("there").isNull(), "not in the catalog").when(F.coalesce("status", F.lit("")) != "accepted", "not approved")
    why = why.when((F.col("quality") < 45) | (F.col("risk") >= 60), "below the policy").when(F.col("hash") != F.sha2(F.col("cited").cast("string"), 256), "changed")
    return rows.select("memo", "turn", "cited", why.alias("why"))


@query(f"WITH {EVIDENCE}, {SCORED}, {REVIEWS}, {_MEMOS}, s AS (SELECT memo, turn, {_STALE} AS why FROM mm LEFT JOIN sc e ON e.doc_id = cited LEFT JOIN rv ON rv.doc_id = cited) SELECT memo, arg_min(why, turn) FILTER (WHERE why IS NOT NULL) AS reason, count(*) AS citations FROM s GROUP BY memo")
def staleness_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason in the order of its packet why a memo is stale, null for one that isn't."""
    return _stale(spark, sf_dir).groupBy("memo").agg(F.min_by("why", F.when(F.col("why").isNotNull(), F.col("turn"))).alias("reason"), F.count("*").alias("citations"))


@query(f"WITH {EVIDENCE}, {SCORED}, {REVIEWS}, {_MEMOS}, s AS (SELECT memo, turn, {_STALE} AS why FROM mm LEFT JOIN sc e ON e.doc_id = cited LEFT JOIN rv ON rv.doc_id = cited) SELECT memo, count(*) FILTER (WHERE why IS NULL OR why = 'changed') AS kept, count(*) FILTER (WHERE NOT (why IS NULL OR why = 'changed')) AS withheld, bool_and(why IS NULL OR why = 'changed') AS compliant FROM s GROUP BY memo")
def memo_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a memo's citations may be published, and whether all may."""
    fit = F.coalesce(F.col("why") == "changed", F.lit(True))
    return _stale(spark, sf_dir).groupBy("memo").agg(F.count_if(fit).alias("kept"), F.count_if(~fit).alias("withheld"), F.bool_and(fit).alias("compliant"))


@query(f"WITH {REVIEWS}, {_MEMOS} SELECT memo, count(DISTINCT cited) AS touched FROM mm WHERE cited IN (SELECT doc_id FROM rv WHERE status = 'rejected') GROUP BY memo")
def stale_memos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memos whose packet holds evidence that is now rejected, with how much of it."""
    gone = reviews(spark, sf_dir).filter("status = 'rejected'").select(F.col("doc_id").alias("cited"))
    return _memos(spark, sf_dir).join(gone, "cited", "left_semi").groupBy("memo").agg(F.count_distinct("cited").alias("touched"))


@query(f"WITH {EVIDENCE}, {_MEMOS} SELECT memo, count(*) AS citations, count(e.doc_id) AS found, bool_and(e.company IS NOT NULL AND e.company = 'src' || (memo % 20)) AS one_company FROM mm LEFT JOIN ev e ON e.doc_id = cited GROUP BY memo")
def citation_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all citations of a memo exist and are of its company."""
    rows = _memos(spark, sf_dir).join(evidence(spark, sf_dir).select(F.col("doc_id").alias("cited"), "company"), "cited", "left")
    own = F.coalesce(F.col("company") == F.concat(F.lit("src"), F.col("memo") % 20), F.lit(False))
    return rows.groupBy("memo").agg(F.count("*").alias("citations"), F.count("company").alias("found"), F.bool_and(own).alias("one_company"))


@query(f"""WITH {EVIDENCE}, {_MEMOS} SELECT memo, count(*) FILTER (WHERE d > DATE '2021-06-30') AS published_after, count(*) FILTER (WHERE d > DATE '2021-06-30' OR d + (doc_id % 60)::INTEGER > DATE '2021-06-30') AS known_after,
    count(*) FILTER (WHERE d > DATE '2021-06-30') = 0 AS clean FROM mm JOIN ev ON doc_id = cited GROUP BY memo""")
def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations that a memo as of a day could not have known: published after it, or reviewed after it."""
    rows = _memos(spark, sf_dir).join(evidence(spark, sf_dir).select(F.col("doc_id").alias("cited"), "d"), "cited")
    late = F.col("d") > "2021-06-30"
    known = late | (F.date_add("d", (F.col("cited") % 60).cast("int")) > "2021-06-30")
    return rows.groupBy("memo").agg(F.count_if(late).alias("published_after"), F.count_if(known).alias("known_after"), (F.count_if(late) == 0).alias("clean"))


@query(f"WITH {REVIEWS}, {EVIDENCE} SELECT doc_id, status FROM rv WHERE doc_id IN (SELECT doc_id FROM ev WHERE source_quality >= 80)")
def restore_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions that a rebuilt catalog still has rows for."""
    return reviews(spark, sf_dir).join(evidence(spark, sf_dir).filter("source_quality >= 80").select("doc_id"), "doc_id", "left_semi").select("doc_id", "status")


@query(f"WITH {EVIDENCE}, {REVIEWS} SELECT doc_id, r_regionkey AS workspace, 'pending' AS status FROM ev JOIN region ON true WHERE NOT EXISTS (SELECT 1 FROM rv WHERE rv.doc_id = ev.doc_id AND rv.doc_id % 5 = r_regionkey)")
def bootstrap_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pending decision on each document in each workspace that has none; workspaces are the few regions."""
    places = table(spark, sf_dir, "region").agg(F.collect_set("r_regionkey").alias("all"))
    rows = evidence(spark, sf_dir).select("doc_id").join(F.broadcast(places)).select("doc_id", F.explode("all").alias("workspace"))
    have = reviews(spark, sf_dir).select("doc_id", (F.col("doc_id") % 5).cast("int").alias("workspace"))
    return rows.join(have, ["doc_id", "workspace"], "left_anti").withColumn("status", F.lit("pending"))


@query(f"""WITH {EVIDENCE}, v AS (SELECT doc_id, company, d, doc_id % 50 AS document, sha256(text) AS artifact FROM ev), o AS (SELECT document, artifact, max(d) AS d, max(doc_id) AS doc_id, count(*) AS fetches FROM v GROUP BY document, artifact)
    SELECT document, artifact, d, fetches, row_number() OVER (PARTITION BY document ORDER BY d DESC, doc_id DESC) = 1 AS is_current FROM o""")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of each document, one for each different content; the last fetched is current."""
    rows = evidence(spark, sf_dir).select("doc_id", "d", (F.col("doc_id") % 50).alias("document"), F.sha2("text", 256).alias("artifact"))
    once = rows.groupBy("document", "artifact").agg(F.max("d").alias("d"), F.max("doc_id").alias("doc_id"), F.count("*").alias("fetches"))
    last = once.groupBy("document").agg(F.max_by("artifact", F.struct("d", "doc_id")).alias("last"))
    return once.join(last, "document").select("document", "artifact", "d", "fetches", (F.col("artifact") == F.col("last")).alias("is_current"))


@query("""WITH k AS (SELECT page_id, sha256(coalesce(html, '')) AS now, CASE WHEN page_id % 11 = 0 THEN sha256('x' || page_id) ELSE sha256(coalesce(html, '')) END AS stored, octet_length(encode(coalesce(html, '')))::BIGINT AS size, CASE WHEN page_id % 4 <> 0 THEN page_id % 30 END AS verified FROM pages)
    SELECT count(*) AS archived, count(DISTINCT now) AS documents, sum(size)::BIGINT AS bytes, count(*) FILTER (WHERE now = stored) AS verified, count(*) FILTER (WHERE now <> stored) AS corrupt, floor(100.0::DOUBLE * count(*) FILTER (WHERE now = stored) / greatest(1, count(*)) + 0.5::DOUBLE)::INTEGER AS percent FROM k""")
def integrity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents hashed again and held against what was noted."""
    content = F.coalesce("html", F.lit(""))
    rows = table(spark, sf_dir, "pages").select(F.sha2(content, 256).alias("now"), F.when(F.col("page_id") % 11 == 0, F.sha2(F.concat(F.lit("x"), F.col("page_id")), 256)).otherwise(F.sha2(content, 256)).alias("stored"), F.octet_length(content).alias("size"))
    same = F.count_if(F.col("now") == F.col("stored"))
    return rows.agg(F.count("*").alias("archived"), F.count_distinct("now").alias("documents"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"), same.alias("verified"), F.count_if(F.col("now") != F.col("stored")).alias("corrupt"), text.rounded(same * 100 / F.greatest(F.lit(1), F.count("*"))).alias("percent"))


@query("SELECT page_id, verified FROM (SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN page_id % 30 END AS verified FROM pages) ORDER BY verified NULLS FIRST, page_id LIMIT 50")
def integrity_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 contents to verify next: never verified ones first, then the longest ago."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 4 != 0, F.col("page_id") % 30).alias("verified"))
    return rows.orderBy(F.asc_nulls_first("verified"), "page_id").limit(50)


@query(f"""WITH {EVIDENCE}, f AS (SELECT company, max(d) FILTER (WHERE kind = 'sec') AS filing, max(d) FILTER (WHERE kind = 'ir') AS release FROM ev GROUP BY company)
    SELECT company, filing, release, CASE WHEN coalesce(greatest(filing, release), DATE '1970-01-01') >= DATE '2022-09-20' THEN 'fresh' ELSE 'stale' END AS label, concat_ws(',', CASE WHEN filing IS NULL OR filing < DATE '2022-09-15' THEN 'filing' END, CASE WHEN release IS NULL OR release < DATE '2022-09-15' THEN 'release' END) AS overdue FROM f""")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each company's sources were last seen, and which are overdue."""
    by = evidence(spark, sf_dir).groupBy("company").agg(F.max(F.when(F.col("kind") == "sec", F.col("d"))).alias("filing"), F.max(F.when(F.col("kind") == "ir", F.col("d"))).alias("release"))
    old = lambda c: F.when(F.col(c).isNull() | (F.col(c) < "2022-09-15"), c)
    return by.select("company", "filing", "release", F.when(F.greatest("filing", "release") >= "2022-09-20", "fresh").otherwise("stale").alias("label"), F.concat_ws(",", old("filing"), old("release")).alias("overdue"))


@query(f"""WITH {EVIDENCE}, fresh AS (SELECT doc_id, company, d FROM ev WHERE doc_id % 2 = 0 AND company <> 'src3' AND company <> 'src7'), prev AS (SELECT doc_id, company, d - 30 AS d FROM ev WHERE doc_id % 3 = 0)
    SELECT * FROM fresh UNION ALL SELECT * FROM prev WHERE company IN ('src3', 'src7')""")
def catalog_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fresh catalog, with the rows of the snapshot before for companies whose source has failed."""
    rows = evidence(spark, sf_dir).select("doc_id", "company", "d")
    failed = rows.select("company").distinct().filter(F.col("company").isin("src3", "src7"))
    fresh = rows.filter("doc_id % 2 = 0").join(failed, "company", "left_anti")
    before = rows.filter("doc_id % 3 = 0").withColumn("d", F.date_sub("d", 30)).join(failed, "company", "left_semi")
    return fresh.unionByName(before).select("doc_id", "company", "d")
