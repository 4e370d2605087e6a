"""Claim synthesis: a claim from each text, verification of given claims with fallback, removal of near-equal ones, diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import rules
from sievework.operators import similar, synthesis

from .base import EVIDENCE, REVIEWS, evidence, registry, reviews, table
from .claims import _PLAIN

QUERIES, ORACLES, query = registry()

# Sections in the order of a memo; which one a text belongs to follows from its number. The prose holds few words of the domain, so
# each section's pattern also takes endings that are frequent in it. Every seventh name keeps its digits, which no text may back.
SECTIONS = {k: rf"{p}|{extra}" for (k, p), extra in zip(rules.CLAIM_SECTIONS.items(), ("tion", "ing", "les", "der"), strict=True)}
KEYS = list(SECTIONS)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, name, section, quality and text of documents."""
    n = F.col("doc_id")
    name = F.initcap(F.when(n % 7 == 0, F.col("company")).otherwise(F.translate("company", "0123456789", "abcdefghij")))
    return evidence(spark, sf_dir).select("doc_id", name.alias("name"), F.element_at(F.array(*map(F.lit, KEYS)), (n % len(KEYS)).cast("int") + 1).alias("section"), F.col("source_quality").alias("quality"), "text")


def _q(pattern: str) -> str:
    return "(?i)" + pattern.replace("'", "''")


_KEYS_SQL = "[" + ", ".join(f"'{k}'" for k in KEYS) + "]"
_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in rules.CLAIM_STOP_WORDS) + "]"
_FLAT = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({}, '\"', '"'), '[\x{{00a0}}\x{{2007}}\x{{202f}}]', ' ', 'g'), '[“”]', '"', 'g'), '[‘’]', '''', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))"""


def _tokens(x: str) -> str:
    parts = f"list_transform(string_split({_PLAIN.format(x)}, ' '), lambda t: regexp_replace(t, '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g'))"
    return f"list_distinct(list_filter({parts}, lambda t: length(t) >= 4 AND NOT list_contains({_STOP_SQL}, t) AND NOT regexp_matches(t, '^[0-9]+$')))"


def _malformed(t: str) -> str:
    return rf"""(length({t}) < 24 OR length({t}) > 420 OR len(string_split({t}, ' ')) < 5 OR regexp_matches({t}, '^[a-z]{{2,}}\s') OR regexp_matches({t}, '(?i)\bwww\.\S+|\b\d+\s*/\s*\d+\b') OR len(regexp_extract_all({t}, '\b20\d{{2}}\b')) >= 4
        OR len(list_filter(string_split({t}, ' '), lambda w: regexp_matches(w, '[0-9]')))::DOUBLE / len(string_split({t}, ' ')) > 0.32 OR regexp_matches({t}, '(?:\b[A-Z]{{2,}}\b\s*){{7,}}') OR regexp_matches({t}, '{_q(rules.SLIDE)}') OR regexp_matches({t}, '{_q(rules.ESTIMATE_NOTE)}'))"""


_UNITS = "%|percent|basis points?|bps|mw|gw|kw|billion|million|thousand|bn|mn|years?|months?|quarters?|gpus?|buildings?|customers?|b|m|k"
_NAMES = "MAP {'b': 'billion', 'bn': 'billion', 'm': 'million', 'mn': 'million', 'k': 'thousand', '%': 'percent', 'bps': 'basis-points', 'basis point': 'basis-points', 'basis points': 'basis-points'}"


def _facts(x: str) -> str:
    found = rf"regexp_extract_all(regexp_replace({_FLAT.format(x)}, '(?i)([0-9])-((?:year|month|quarter)\b)', '\1 \2', 'g'), '(?i)(?:[$€£]\s*)?\d[\d,]*(?:\.\d+)?\s*(?:{_UNITS})?')"
    unit = r"lower(regexp_extract(f, '(?i)([a-z%][a-z ]*)$', 1))"
    number = r"regexp_extract(f, '^([$€£]?)', 1) || replace(regexp_extract(f, '(\d[\d,]*(?:\.\d+)?)', 1), ',', '')"
    return f"list_distinct(list_transform({found}, lambda f: {number} || CASE WHEN {unit} = '' THEN '' ELSE ':' || coalesce(({_NAMES})[{unit}], {unit}) END))"


def _opposed(a: str, b: str) -> str:
    has = lambda x, p: rf"regexp_matches({x}, '(?i)\b(?:{p})\b')"
    negations = rules.NEGATIONS.replace("'", "''")
    return f"({has(a, negations)} <> {has(b, negations)} OR " + " OR ".join(f"({has(a, u)} AND {has(b, d)}) OR ({has(a, d)} AND {has(b, u)})" for u, d in rules.DIRECTIONS) + ")"


_ITEMS = f"it AS (SELECT doc_id, company, upper(left(company, 1)) || substr(CASE WHEN doc_id % 7 = 0 THEN company ELSE translate(company, '0123456789', 'abcdefghij') END, 2) AS name, {_KEYS_SQL}[(doc_id % {len(KEYS)})::INTEGER + 1] AS section, source_quality AS quality, text FROM ev)"
_FRAGMENTS = "list_filter([" + ", ".join(
    [rf"regexp_extract(body, '(?i)' || replace('{rules.CLAIM_FRAGMENTS[0].format(chr(1))}', chr(1), regexp_escape(name)))"] + [f"regexp_extract(body, '{_q(p)}')" for p in rules.CLAIM_FRAGMENTS[1:]]
) + "], lambda f: f <> '')"
_ON_TOPIC = " OR ".join(f"(section = '{k}' AND regexp_matches(s, '{_q(p)}'))" for k, p in SECTIONS.items())
_BEST = rf"""b0 AS (SELECT *, {_FLAT.format('text')} AS flat FROM it), b1 AS (SELECT *, regexp_replace(regexp_replace(flat, '^[0-9]{{1,3}} +([A-Z"''])', '\1'), '^[•·▪◦-] *', '') AS body FROM b0),
    b2 AS (SELECT *, {_FRAGMENTS} AS fr, list_filter(list_transform(string_split(regexp_replace(body, '([.!?]) +(["''A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS se FROM b1),
    b3 AS (SELECT doc_id, section, body, fr, unnest(list_concat(fr, se)) AS s, generate_subscripts(list_concat(fr, se), 1) - 1 AS place FROM b2),
    b4 AS (SELECT doc_id, s, place, list_contains(fr, s) AS fragment, (CASE WHEN len(string_split(s, ' ')) BETWEEN 10 AND 48 THEN 20 ELSE 0 END) + (CASE WHEN {_ON_TOPIC} THEN 20 ELSE 0 END) + (CASE WHEN regexp_matches(s, '[0-9]') THEN 8 ELSE 0 END) + greatest(0, 8 - 2 * place) AS points, regexp_matches(body, '{_q(rules.SLIDE)}') AS slide FROM b3 WHERE NOT {_malformed('s')}),
    b5 AS (SELECT doc_id, arg_max(s, (points + CASE WHEN fragment THEN 16 ELSE 0 END) * 1000000 - place) AS sentence FROM b4 WHERE fragment OR NOT slide GROUP BY doc_id),
    be AS (SELECT b0.*, sentence, coalesce(sentence, regexp_replace(trim(left(flat, {synthesis.QUOTE_CHARS})), ' +[^ ]*$', '')) AS quoted FROM b0 LEFT JOIN b5 USING (doc_id))"""
_SMALL = r"CASE WHEN regexp_matches(u, '^[A-Z]{2,}\b') THEN u ELSE lower(substring(u, 1, 1)) || substring(u, 2) END"
_TOLD = rf"""t0 AS (SELECT *, regexp_replace(sentence, '^["'']|["'']$', '', 'g') AS u FROM be),
    t1 AS (SELECT *, CASE WHEN regexp_matches(sentence, '{_q(rules.REPORTED_SPEECH)}') THEN sentence WHEN regexp_matches(u, '(?i)^we +') THEN name || ' ' || regexp_replace(regexp_replace(regexp_replace(u, '(?i)^we +', ''), '(?i)^expect\b', 'expects'), '(?i)^believe\b', 'believes')
        WHEN regexp_matches(u, '(?i)^our +') THEN name || '''s ' || regexp_replace(u, '(?i)^our +', '') WHEN starts_with(lower(u), lower(name)) THEN u WHEN regexp_matches(u, '(?i)^(?:{rules.OWN_VERBS})\b') THEN name || ' ' || {_SMALL}
        WHEN regexp_matches(u, '(?i)^(?:{rules.OWN_FIGURES})\b') THEN name || ' reported ' || {_SMALL} WHEN regexp_matches(u, '(?i)^as of\b') THEN name || ' reported that ' || {_SMALL} ELSE name || ' disclosed that ' || {_SMALL} END AS said FROM t0)"""


def _checked(source: str) -> str:
    return rf"""k0 AS (SELECT *, {_FLAT.format('said')} AS sf, {_tokens('said')} AS own, {_tokens('text')} AS its FROM {source}), k1 AS (SELECT *, len(own) AS n, len(list_intersect(own, its)) AS shared FROM k0),
    k2 AS (SELECT *, CASE WHEN n > 0 THEN shared::DOUBLE / n ELSE 0 END AS overlap, len(list_filter({_facts('said')}, lambda f: NOT list_contains({_facts('text')}, f))) = 0 AS numeric_ok, {_malformed('sf')} AS malformed FROM k1),
    k3 AS (SELECT *, n > 0 AND shared >= least(3, n) AND overlap >= 0.24 AND NOT {_opposed('said', 'text')} AS supported FROM k2)"""


_GOOD = "greatest(0, least(100, floor(quality::DOUBLE * 0.8::DOUBLE + overlap * 20 + 0.5)))::INTEGER"
_LESS = "greatest(0, least(100, quality - 8))::INTEGER"


@query(f"""WITH {EVIDENCE}, {_ITEMS}, {_BEST}, {_TOLD}, {_checked('t1')}, k4 AS (SELECT *, coalesce(sentence IS NOT NULL AND numeric_ok AND supported AND NOT malformed, false) AS good FROM k3)
    SELECT doc_id, section, CASE WHEN good THEN said ELSE quoted END AS claim, CASE WHEN good AND {_PLAIN.format('said')} <> {_PLAIN.format('sentence')} THEN 'paraphrase' ELSE 'quote' END AS representation,
    CASE WHEN good THEN 'verified' ELSE 'source-fallback' END AS status, CASE WHEN good THEN {_GOOD} ELSE {_LESS} END AS quality_score FROM k4""")
def evidence_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claim of every document: its best sentence for its section, retold and verified, else quoted."""
    made = synthesis.own_claims(_items(spark, sf_dir), "text", "name", "section", "quality", SECTIONS)
    return made.select("doc_id", "section", "claim", "representation", "status", "quality_score")


# Given claims: an item of the benchmark said of an accepted text, denied in every third case, taken as a quote in every second.
_GIVEN = "g0 AS (SELECT be.*, CASE WHEN be.doc_id % 3 = 0 THEN 'It is not so that ' || b.text ELSE b.text END AS said FROM be JOIN rv ON rv.doc_id = be.doc_id AND status = 'accepted' JOIN benchmark b ON b.item_id = rv.doc_id % (SELECT count(*) FROM benchmark))"
_SYNTHESIS = f"""{EVIDENCE}, {REVIEWS}, {_ITEMS}, {_BEST}, {_GIVEN}, {_checked('g0')}, k4 AS (SELECT *, doc_id % 2 = 1 OR contains({_PLAIN.format('text')}, {_PLAIN.format('said')}) AS quote_ok FROM k3),
    k5 AS (SELECT *, numeric_ok AND supported AND quote_ok AND NOT malformed AS good FROM k4), k6 AS (SELECT doc_id, company, numeric_ok, supported, quote_ok, malformed, CASE WHEN good THEN 'verified' ELSE 'source-fallback' END AS status,
    CASE WHEN good THEN said ELSE quoted END AS claim, CASE WHEN good THEN {_GOOD} ELSE {_LESS} END AS quality_score FROM k5), k7 AS (SELECT *, {_tokens('claim')} AS w FROM k6),
    k8 AS (SELECT * EXCLUDE (w), CASE WHEN len(w) > 0 THEN w ELSE ['=' || {_PLAIN.format('claim')}] END AS w, row_number() OVER (PARTITION BY company ORDER BY doc_id) AS step FROM k7),
    r AS (SELECT company, 0::BIGINT AS step, NULL::BIGINT AS doc_id, []::STRUCT(n BIGINT, w VARCHAR[])[] AS kept, NULL::BIGINT AS near FROM (SELECT DISTINCT company FROM k8) UNION ALL
        SELECT company, step, doc_id, CASE WHEN near IS NULL THEN list_append(kept, struct_pack(n := doc_id, w := w)) ELSE kept END, near FROM (SELECT r.company, k8.step, k8.doc_id, r.kept, k8.w,
        list_min(list_transform(list_filter(r.kept, lambda e: len(list_intersect(e.w, k8.w))::DOUBLE / len(list_distinct(list_concat(e.w, k8.w))) >= 0.82), lambda e: e.n)) AS near FROM r JOIN k8 ON k8.company = r.company AND k8.step = r.step + 1)),
    sy AS (SELECT k8.doc_id, k8.company, numeric_ok, supported, quote_ok, malformed, status, claim, quality_score, near AS duplicate_of FROM k8 JOIN r USING (doc_id))"""


def _synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, company, claim and what became of it; every accepted text has one claim."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    count = F.broadcast(items.agg(F.count("*").alias("items")))
    accepted = reviews(spark, sf_dir).filter("status = 'accepted'").select("doc_id").join(count).withColumn("item_id", F.expr("CASE WHEN items > 0 THEN doc_id % items END"))
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("It is not so that "), "item")).otherwise(F.col("item"))
    given = _items(spark, sf_dir).join(accepted.join(items, "item_id").select("doc_id", said.alias("said")), "doc_id")
    companies = evidence(spark, sf_dir).select("doc_id", "company")
    made = synthesis.verified(given, "said", F.col("doc_id") % 2 == 0, "text", "name", "section", "quality", SECTIONS)
    made = made.select("doc_id", "numeric_ok", "supported", "quote_ok", "malformed", "status", F.col("final").alias("claim"), "quality_score").join(companies, "doc_id")
    marked = similar.first_distinct(made.withColumn("words", synthesis.claim_words(F.col("claim"))), ["company"], "doc_id", "words", 0.82)
    return marked.withColumnRenamed("like", "duplicate_of").drop("words", "kept")


@query(f"WITH RECURSIVE {_SYNTHESIS} SELECT * FROM sy")
def claim_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given claims held against the texts that they cite, with what failed, the fallback, and the earlier claim of the company that says the same."""
    return _synthesis(spark, sf_dir)


@query(f"""WITH RECURSIVE {_SYNTHESIS} SELECT company, count(*) AS claims, count(*) FILTER (WHERE NOT numeric_ok) AS numeric_failures, count(*) FILTER (WHERE NOT supported) AS support_failures, count(*) FILTER (WHERE NOT quote_ok) AS quote_failures,
    count(*) FILTER (WHERE malformed) AS malformed, count(*) FILTER (WHERE duplicate_of IS NOT NULL) AS duplicates, count(*) FILTER (WHERE duplicate_of IS NULL AND status = 'source-fallback') AS fallbacks FROM sy GROUP BY company""")
def synthesis_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many claims of each company fail each check, repeat another, or are kept as a fallback."""
    counts = {"numeric_failures": ~F.col("numeric_ok"), "support_failures": ~F.col("supported"), "quote_failures": ~F.col("quote_ok"), "malformed": F.col("malformed"), "duplicates": F.col("duplicate_of").isNotNull(), "fallbacks": F.col("duplicate_of").isNull() & (F.col("status") == "source-fallback")}
    return _synthesis(spark, sf_dir).groupBy("company").agg(F.count("*").alias("claims"), *(F.count_if(test).alias(name) for name, test in counts.items()))
