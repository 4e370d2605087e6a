"""Evidence: scoring, topics, duplicates, triage, overlays, pages, facets, retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import rules, text
from sievework.operators import keyed

from .base import CLEAN, EVIDENCE, REVIEWS, SCORED, evidence, fnv_sql, reviews, scored, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


PLAIN = r"trim(regexp_replace(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g'), '[^a-z0-9$% ]', '', 'g'))"
GROUPED = f"dg AS (SELECT *, {PLAIN} AS grp FROM sc)"


@query(f"""WITH {EVIDENCE}, {SCORED}, {REVIEWS}, {GROUPED},
    b AS (SELECT *, count(*) OVER (PARTITION BY grp) AS group_size, row_number() OVER (PARTITION BY grp ORDER BY quality DESC, d DESC, doc_id DESC) AS r FROM dg)
    SELECT b.doc_id, company, d, quality, risk::INTEGER AS risk, group_size, coalesce(status, 'unreviewed') AS status FROM b LEFT JOIN rv USING (doc_id)
    WHERE r = 1 AND quality >= 60 AND risk < 60 AND status IS NULL""")
def flagship_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unreviewed evidence worth reading: scored, best of its duplicates, readable."""
    rows = scored(evidence(spark, sf_dir)).withColumn("grp", F.sha2(text.plain(F.col("text")), 256))
    columns = ["doc_id", "company", "d", "quality", "risk"]
    best = rows.groupBy("grp").agg(F.max_by(F.struct(*columns), F.struct("quality", "d", "doc_id")).alias("b"), F.count("*").alias("group_size")).select("b.*", "group_size")
    seen = keyed.overlay(best, reviews(spark, sf_dir), "doc_id", "status", "unreviewed")
    ready = (F.col("quality") >= 60) & (F.col("risk") < 60) & (F.col("status") == "unreviewed")
    return seen.filter(ready).select("doc_id", "company", "d", "quality", "risk", "group_size", "status")


@query(f"WITH {EVIDENCE}, {SCORED} SELECT doc_id, quality, materiality::INTEGER AS materiality, specificity::INTEGER AS specificity, relevance::INTEGER AS relevance, risk::INTEGER AS risk FROM sc")
def evidence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(evidence(spark, sf_dir)).select("doc_id", "quality", "materiality", "specificity", "relevance", "risk")


@query(f"WITH {EVIDENCE}, e2 AS (SELECT *, {PLAIN} AS pl FROM ev) SELECT doc_id, concat('duplicate:', {fnv_sql('pl')}, ':', length(pl)) AS grp, count(*) OVER (PARTITION BY pl) AS group_size FROM e2")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence(spark, sf_dir).select("doc_id", text.plain(F.col("text")).alias("plain")).withColumn("own", F.sha2("plain", 256))
    groups = rows.groupBy("own").agg(F.count("*").alias("group_size"))
    labelled = rows.select("doc_id", "own", text.duplicate_key(F.col("plain")).alias("grp"))
    return labelled.join(groups, "own").select("doc_id", "grp", "group_size")


def _first_rule(column: str, default: str, rows: list) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '(?i){p}') THEN '{t}'" for t, p in rows) + f" ELSE '{default}' END"


@query(f"SELECT doc_id, {_first_rule('text', rules.DEFAULT_TOPIC, rules.TOPICS)} AS topic, {_first_rule('text', 'other', rules.PROSE_TOPICS[::-1])} AS prose_topic FROM documents")
def topic_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.first_topic(value, rules.TOPICS, rules.DEFAULT_TOPIC).alias("topic"), text.first_topic(value, rules.PROSE_TOPICS[::-1], "other").alias("prose_topic"))


@query(
    "WITH c AS (SELECT doc_id, unnest([" + ", ".join(f"{{'n': len(regexp_extract_all(text, '(?i){p}')), 'o': {-i}, 't': '{t}'}}" for i, (t, p) in enumerate(rules.PROSE_TOPICS)) + "]) AS s FROM documents)"
    " SELECT doc_id, CASE WHEN max(s.n) > 0 THEN arg_max(s.t, s.n * 100 + s.o) ELSE 'other' END AS topic FROM c GROUP BY doc_id"
)
def topic_most_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.most_topic(F.col("text"), rules.PROSE_TOPICS, "other").alias("topic"))


@query(r"WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS x FROM documents) SELECT doc_id, count(*) AS sentences, max(length(x))::BIGINT AS longest FROM s GROUP BY doc_id")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.sentences(F.col("text"))).alias("x"))
    return parts.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.max(F.length("x")).cast("long").alias("longest"))


@query(f"""WITH {EVIDENCE}, {REVIEWS}, j AS (SELECT company, kind, coalesce(status, 'unreviewed') AS status FROM ev LEFT JOIN rv USING (doc_id))
    SELECT CASE WHEN grouping(company) = 0 THEN 'company' WHEN grouping(kind) = 0 THEN 'kind' WHEN grouping(status) = 0 THEN 'status' ELSE 'total' END AS facet,
    coalesce(company, kind, status, '') AS value, count(*) AS n FROM j GROUP BY GROUPING SETS ((company), (kind), (status), ())""")
def facets_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed.overlay(evidence(spark, sf_dir).select("doc_id", "company", "kind"), reviews(spark, sf_dir), "doc_id", "status", "unreviewed")
    return keyed.facets(rows, ["company", "kind", "status"])


@query(f"""WITH {EVIDENCE}, {SCORED}, {REVIEWS} SELECT count(*) FILTER (WHERE status IS NULL AND quality >= 60 AND risk < 60) AS decision_ready, count(*) FILTER (WHERE quality >= 70 AND risk < 40) AS high_value,
    count(*) FILTER (WHERE risk >= 60) AS boilerplate, count(*) FILTER (WHERE status = 'accepted') AS accepted, count(*) AS total FROM sc LEFT JOIN rv USING (doc_id)""")
def triage_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(evidence(spark, sf_dir)).select("doc_id", "quality", "risk").join(reviews(spark, sf_dir), "doc_id", "left")
    return rows.agg(
        F.count_if(F.col("status").isNull() & (F.col("quality") >= 60) & (F.col("risk") < 60)).alias("decision_ready"),
        F.count_if((F.col("quality") >= 70) & (F.col("risk") < 40)).alias("high_value"),
        F.count_if(F.col("risk") >= 60).alias("boilerplate"),
        F.count_if(F.col("status") == "accepted").alias("accepted"),
        F.count("*").alias("total"),
    )


@query(f"WITH {EVIDENCE} SELECT doc_id, source_quality, d FROM ev WHERE (source_quality, d, doc_id) < (95, DATE '2022-01-01', 500) ORDER BY source_quality DESC, d DESC, doc_id DESC LIMIT 26")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime

    rows = evidence(spark, sf_dir).select("doc_id", "source_quality", "d")
    return keyed.page(rows, 25, "source_quality", "d", "doc_id", (95, datetime.date(2022, 1, 1), 500))


@query(f"""WITH {EVIDENCE}, o AS (SELECT doc_id, d, source_quality AS q, kind AS topic, CASE WHEN doc_id % 3 = 0 THEN 'accepted' ELSE 'pending' END AS status FROM ev WHERE doc_id % 5 <> 0),
    n AS (SELECT doc_id, d + 7 AS d, source_quality + 1 AS q, company AS topic FROM ev WHERE doc_id % 4 <> 0)
    SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN n.doc_id IS NOT NULL THEN n.d ELSE o.d END AS d, CASE WHEN n.doc_id IS NOT NULL THEN n.q ELSE o.q END AS q,
    CASE WHEN n.doc_id IS NOT NULL AND (o.doc_id IS NULL OR o.status = 'pending') THEN n.topic ELSE o.topic END AS topic, coalesce(o.status, 'pending') AS status FROM o FULL JOIN n USING (doc_id)""")
def overlay_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = evidence(spark, sf_dir)
    old = ev.filter("doc_id % 5 <> 0").select("doc_id", "d", F.col("source_quality").alias("q"), F.col("kind").alias("topic"), F.when(F.col("doc_id") % 3 == 0, "accepted").otherwise("pending").alias("status"))
    new = ev.filter("doc_id % 4 <> 0").select("doc_id", F.date_add("d", 7).alias("d"), (F.col("source_quality") + 1).alias("q"), F.col("company").alias("topic"))
    return keyed.upsert(old, new, "doc_id", ["d", "q"], ["topic"], "status")


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL OR b.doc_id IS NOT NULL THEN 'reject' ELSE 'delete' END AS action FROM documents d
    LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) LEFT JOIN (SELECT DISTINCT conv_id AS doc_id FROM conversations) b USING (doc_id) WHERE d.lang <> 'en'""")
def reconcile_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    held = [table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"))]
    return keyed.missing(docs, docs.filter("lang = 'en'"), "doc_id", held).select("doc_id", "action")


@query(r"""WITH p AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS u FROM pages), s AS (SELECT *, string_split(u, '?') AS q FROM p),
    k AS (SELECT *, list_filter(string_split(array_to_string(q[2:], '?'), '&'), lambda x: NOT regexp_matches(x, '(?i)^(utm_[^=]*|gclid|fbclid|mc_[^=]*)(=|$)')) AS kept FROM s)
    SELECT page_id, CASE WHEN len(q) > 1 AND len(kept) > 0 AND array_to_string(kept, '&') <> '' THEN q[1] || '?' || array_to_string(kept, '&') ELSE q[1] END AS url FROM k""")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.canonical_url(F.col("url")).alias("url"))


@query(rf"""SELECT doc_id, CASE WHEN u > abs(s - w) THEN 'uncertain' WHEN s > w THEN 'stronger' WHEN s < w THEN 'weaker' ELSE 'neutral' END AS tone FROM (SELECT doc_id,
    len(regexp_extract_all(text, '(?i)\b(?:{rules.STRONG}|the|ing)\b')) AS s, len(regexp_extract_all(text, '(?i)\b(?:{rules.WEAK}|of|by|in)\b')) AS w, len(regexp_extract_all(text, '(?i)\b(?:{rules.UNSURE}|that|was)\b')) AS u FROM documents)""")
def disclosure_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tone by the domain's words and such as the prose has."""
    return table(spark, sf_dir, "documents").select("doc_id", text.tone(F.col("text"), f"{rules.STRONG}|the|ing", f"{rules.WEAK}|of|by|in", f"{rules.UNSURE}|that|was").alias("tone"))


@query(f"WITH {EVIDENCE} SELECT doc_id, {CLEAN} AS c, length({CLEAN})::INTEGER AS n FROM ev")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = text.clean(F.col("text"))
    return evidence(spark, sf_dir).select("doc_id", c.alias("c"), F.length(c).alias("n"))


@query(f"""WITH {EVIDENCE}, {REVIEWS}, r AS (SELECT company, doc_id, d, source_quality, row_number() OVER (PARTITION BY company ORDER BY source_quality DESC, d DESC, doc_id) AS rank FROM ev JOIN rv USING (doc_id) WHERE status = 'accepted')
    SELECT * REPLACE (rank::INTEGER AS rank) FROM r WHERE rank <= 6""")
def per_company_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = evidence(spark, sf_dir).drop("text", "kind").join(reviews(spark, sf_dir).filter("status = 'accepted'").select("doc_id"), "doc_id", "left_semi")
    return keyed.best_rows(ok, ["company"], [F.desc("source_quality"), F.desc("d"), F.asc("doc_id")], 6, "rank").select("company", "doc_id", "d", "source_quality", "rank")


@query(r"""WITH q AS (SELECT item_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) >= 3))) AS terms FROM benchmark),
    t AS (SELECT item_id, unnest(terms) AS term FROM q), d AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) >= 3))) AS term FROM documents),
    s AS (SELECT item_id, doc_id, count(*) AS matched FROM t JOIN d USING (term) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY matched DESC, doc_id) AS rank FROM s) SELECT item_id, doc_id, matched, rank::INTEGER AS rank FROM r WHERE rank <= 5""")
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents that hold most of a question's terms, through an inverted table of terms."""
    terms = lambda c: text.tokens(F.col(c), [""], 3)
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.explode(terms("text")).alias("term"))
    held = table(spark, sf_dir, "documents").select("doc_id", F.explode(terms("text")).alias("term"))
    matched = held.join(asked, "term").groupBy("item_id", "doc_id").agg(F.count("*").alias("matched"))
    return keyed.best_rows(matched, ["item_id"], [F.desc("matched"), F.asc("doc_id")], 5, "rank")


@query(r"""WITH t AS (SELECT doc_id, length(text) AS n, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) >= 2 AND NOT list_contains(['the','of','and','to','in','is','by','with','on','for','are','was'], t))) AS k FROM documents),
    p AS (SELECT a.doc_id, b.doc_id AS next_id, a.k AS x, b.k AS y FROM t a JOIN t b ON b.doc_id = a.doc_id + 1)
    SELECT doc_id, next_id, round(CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 1.0 ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END, 9)::DOUBLE AS similarity FROM p""")
def token_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token similarity of each document and the next."""
    rows = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text"), rules.STOP_WORDS).alias("k"))
    after = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("next_id"), F.col("k").alias("y"))
    return rows.join(after, "doc_id").select("doc_id", "next_id", F.round(text.jaccard(F.col("k"), F.col("y"), 1.0), 9).alias("similarity"))


@query(f"""WITH {EVIDENCE}, {REVIEWS}, a AS (SELECT doc_id, company, d, source_quality FROM ev JOIN rv USING (doc_id) WHERE status = 'accepted'),
    h AS (SELECT * FROM a WHERE d <= DATE '2021-06-01') SELECT a.company, count(*) AS now, count(h.doc_id) AS then, count(*) - count(h.doc_id) AS added, round(avg(a.source_quality), 6)::DOUBLE AS quality FROM a LEFT JOIN h USING (doc_id) GROUP BY a.company""")
def replay_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known at a date against what is known now, by company."""
    ok = evidence(spark, sf_dir).drop("text").join(reviews(spark, sf_dir).filter("status = 'accepted'").select("doc_id"), "doc_id", "left_semi")
    known = F.count_if(F.col("d") <= "2021-06-01")
    return ok.groupBy("company").agg(F.count("*").alias("now"), known.alias("then"), (F.count("*") - known).alias("added"), F.round(F.avg("source_quality"), 6).alias("quality"))


@query("""WITH c AS (SELECT conv_id, turn, role, text FROM conversations), q AS (SELECT conv_id, count(*) AS messages, max(turn) AS last_turn, arg_max(text, turn) FILTER (WHERE role = 'user') AS last_question FROM c GROUP BY conv_id) SELECT * FROM q""")
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    asked = F.max_by("text", F.when(F.col("role") == "user", F.col("turn")))
    return turns.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"), asked.alias("last_question"))


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def quote_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that quote an item whole, at any place: no pair of a document and a long item is tried in vain.

    Words inside a quote stand between white space, so they are whole words of the document too, whatever its first and
    last word are glued to. Four of them find the candidates; items of fewer than six words meet all documents.
    """
    four = lambda w, i: F.concat_ws(" ", F.slice(w, i, 4))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"), F.split(F.col("text"), r"\s+").alias("w"))
    long, short = items.filter(F.size("w") >= 6).select("item_id", "quote", four("w", 2).alias("inside")), items.filter(F.size("w") < 6).select("item_id", "quote")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    split = docs.select("doc_id", F.split("text", r"\s+").alias("w")).filter(F.size("w") >= 6)
    windows = split.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 3), lambda i: four("w", i)))).alias("inside"))
    met = windows.join(long, "inside").select(F.col("doc_id").alias("met_id"), "item_id", "quote").distinct()
    pairs = met.join(docs, F.col("met_id").eqNullSafe(F.col("doc_id"))).unionByName(docs.crossJoin(short), allowMissingColumns=True)
    return pairs.filter(F.contains("text", "quote")).select("doc_id", "item_id").distinct()
