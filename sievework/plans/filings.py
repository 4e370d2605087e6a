"""Filings: passages assigned to those of the filing before, changes in three modes, claims without near-equal ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions import rules, text
from sievework.operators import filings, similar

from .base import registry, table
from .pages import _PACKED

QUERIES, ORACLES, query = registry()

# Eight filings of each company; a filing's previous one is the company's last of its base form. Sections are topics.
FORMS = ["10-Q", "10-Q", "8-K", "10-Q/A", "10-K", "10-Q", "6-K", "10-K/A"]
_FORM_SQL = "[" + ", ".join(f"'{f}'" for f in FORMS) + "][(doc_id % 8)::INTEGER + 1]"
TERMS = ["que", "la", "thon", "ing", "onan", "les", "der"]
RECURRING = ["relation", "action", "article"]
_STOP = "[" + ", ".join(f"'{w}'" for w in rules.FILING_STOP_WORDS) + "]"
_TERMS = "[" + ", ".join(f"'{w}'" for w in TERMS) + "]"
_MOST = "greatest(" + ", ".join(f"n{i}" for i in range(len(rules.PROSE_TOPICS))) + ")"
_TOPIC = "CASE WHEN " + _MOST + " = 0 THEN 'other' " + " ".join(f"WHEN n{i} = {_MOST} THEN '{t}'" for i, (t, _) in enumerate(rules.PROSE_TOPICS)) + " END"
_COUNTS = ", ".join(f"len(regexp_extract_all(text, '(?i){p}')) AS n{i}" for i, (_, p) in enumerate(rules.PROSE_TOPICS))


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.element_at(F.array(*map(F.lit, FORMS)), (F.col("doc_id") % 8 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("filing"), F.floor(F.col("doc_id") / 8).alias("company"), form.alias("form"))
    before = Window.partitionBy("company", F.regexp_replace("form", "/A$", "")).orderBy("filing")
    return rows.select("filing", "form", F.lag("filing").over(before).alias("previous"))


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's passages by section, numbered where they lie, so that texts do not move for it; sections go in order of their first passages."""
    topic = lambda t: text.most_topic(t, rules.PROSE_TOPICS, "other")
    long = F.filter(text.passages(F.col("text")), lambda t: F.length(t) >= 90)
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("filing"), long.alias("long"))
    rows = rows.withColumn("parts", F.transform("long", lambda t: F.struct(topic(t).alias("category"), t.alias("text"))))
    own = lambda c: F.transform(F.filter("parts", lambda p: p["category"] == c), lambda p, i: F.struct(p["category"].alias("category"), (i + 1).alias("passage"), p["text"].alias("text")))
    sections = F.transform(F.array_distinct("parts.category"), own)
    rows = rows.select("filing", F.posexplode(sections).alias("section", "own")).select("filing", (F.col("section") + 1).alias("section"), F.explode("own").alias("p"))
    return rows.select("filing", "section", "p.category", F.concat(F.lit("About "), "p.category").alias("title"), F.lit(None).cast("string").alias("item_code"), "p.passage", "p.text")


_FILINGS = f"""f0 AS (SELECT doc_id AS filing, doc_id // 8 AS company, {_FORM_SQL} AS form FROM documents), fi AS (SELECT filing, form, lag(filing) OVER (PARTITION BY company, regexp_replace(form, '/A$', '') ORDER BY filing) AS previous,
    CASE WHEN form LIKE '%/A' THEN 'amendment' WHEN form IN ('8-K', '6-K') THEN 'event' ELSE 'periodic' END AS mode FROM f0),
    p0 AS (SELECT doc_id AS filing, {_PACKED} AS l FROM documents WHERE text IS NOT NULL), p1 AS (SELECT filing, unnest(l) AS text, generate_subscripts(l, 1) AS pos FROM p0), p2 AS (SELECT *, {_COUNTS} FROM p1 WHERE length(text) >= 90),
    p3 AS (SELECT filing, pos, text, {_TOPIC} AS category FROM p2), p4 AS (SELECT *, row_number() OVER (PARTITION BY filing, category ORDER BY pos)::INTEGER AS passage, min(pos) OVER (PARTITION BY filing, category) AS first FROM p3),
    pa AS (SELECT filing, dense_rank() OVER (PARTITION BY filing ORDER BY first)::INTEGER AS section, category, 'About ' || category AS title, passage, text,
        list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t))) AS tokens FROM p4)"""
_ASSIGNED = f"""RECURSIVE {_FILINGS}, ok AS (SELECT * FROM fi WHERE mode <> 'event' AND previous IS NOT NULL),
    nw AS (SELECT ok.filing, mode, section, category, title, passage, tokens FROM pa JOIN ok USING (filing) WHERE mode = 'amendment' OR category IN ('relation', 'action', 'article')),
    be AS (SELECT ok.filing, mode, section, category, title, passage, tokens FROM pa JOIN ok ON pa.filing = ok.previous WHERE mode = 'amendment' OR category IN ('relation', 'action', 'article')),
    pr AS (SELECT a.filing, a.category, a.passage AS i, b.passage AS j, CASE WHEN len(a.tokens) + len(b.tokens) = 0 THEN 1.0 ELSE len(list_intersect(a.tokens, b.tokens))::DOUBLE / len(list_distinct(list_concat(a.tokens, b.tokens))) END AS s FROM nw a JOIN be b ON a.filing = b.filing AND a.category = b.category),
    ca AS (SELECT filing, category, i, list(struct_pack(s := -s, j := j) ORDER BY s DESC, j) AS c FROM pr WHERE s >= 0.35 GROUP BY filing, category, i),
    st AS (SELECT filing, category, i, c, row_number() OVER (PARTITION BY filing, category ORDER BY i) AS step FROM ca),
    go AS (SELECT filing, category, 0::BIGINT AS step, []::INTEGER[] AS used, NULL::INTEGER AS i, NULL::INTEGER AS j, NULL::DOUBLE AS s FROM (SELECT DISTINCT filing, category FROM ca) UNION ALL
        SELECT g.filing, g.category, x.step, CASE WHEN x.b IS NULL THEN g.used ELSE list_append(g.used, x.b.j) END, x.i, x.b.j, -x.b.s FROM (SELECT g.filing, g.category, st.step, st.i, list_filter(st.c, lambda e: NOT list_contains(g.used, e.j))[1] AS b FROM go g JOIN st ON g.filing = st.filing AND g.category = st.category AND st.step = g.step + 1) x
        JOIN go g ON g.filing = x.filing AND g.category = x.category AND g.step = x.step - 1),
    tk AS (SELECT filing, category, i AS passage, j AS previous_passage, s AS similarity FROM go WHERE j IS NOT NULL)"""
_RANK = "CASE WHEN mode = 'event' OR significance = 'high' THEN 0 WHEN significance = 'medium' THEN 1 ELSE 2 END"
_SIGNALS = " + ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN {w} ELSE 0 END" for _, w, p in rules.PROSE_SIGNALS)
_SIGNAL = "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{c}'" for c, _, p in rules.PROSE_SIGNALS) + " END"
_CHANGES = f"""{_ASSIGNED}, n0 AS (SELECT nw.*, tk.previous_passage, tk.similarity, be.tokens AS old FROM nw LEFT JOIN tk USING (filing, category, passage) LEFT JOIN be ON be.filing = nw.filing AND be.category = nw.category AND be.passage = tk.previous_passage),
    n1 AS (SELECT *, list_sort(list_intersect({_TERMS}, tokens)) AS mn, list_sort(list_intersect({_TERMS}, coalesce(old, []))) AS mo FROM n0 WHERE similarity IS NULL OR similarity < 0.9),
    n2 AS (SELECT filing, mode, CASE WHEN similarity IS NULL THEN 'added' ELSE 'modified' END AS type, CASE WHEN similarity IS NULL THEN CASE WHEN len(mn) > 0 THEN 'high' ELSE 'medium' END WHEN similarity < 0.55 OR mn <> mo THEN 'high' WHEN similarity < 0.75 THEN 'medium' ELSE 'low' END AS significance,
        category, title, floor(similarity * 100 + 0.5)::INTEGER AS similarity, passage, previous_passage, section, 0 AS block, passage AS pos FROM n1),
    g0 AS (SELECT be.filing, be.mode, 'not_repeated' AS type, 'low' AS significance, be.category, be.title, NULL::INTEGER AS similarity, NULL::INTEGER AS passage, be.passage AS previous_passage, coalesce(c.section, be.section + 1000000) AS section, 1 AS block, be.passage AS pos
        FROM be ANTI JOIN tk ON be.filing = tk.filing AND be.category = tk.category AND be.passage = tk.previous_passage LEFT JOIN (SELECT filing, category, min(section) AS section FROM nw GROUP BY ALL) c ON c.filing = be.filing AND c.category = be.category),
    e0 AS (SELECT filing, mode, title, section, passage, least(100, CASE form WHEN '6-K' THEN 25 ELSE 10 END + {_SIGNALS}) AS score, {_SIGNAL} AS category FROM pa JOIN fi USING (filing) WHERE mode = 'event'),
    e1 AS (SELECT filing, mode, 'new_event' AS type, CASE WHEN score >= 75 THEN 'high' WHEN score >= 55 THEN 'medium' ELSE 'low' END AS significance, category, title, NULL::INTEGER AS similarity, passage, NULL::INTEGER AS previous_passage, section, 0 AS block, passage AS pos FROM e0 WHERE category IS NOT NULL AND score >= 45),
    al AS (SELECT * FROM n2 UNION ALL SELECT * FROM g0 UNION ALL SELECT * FROM e1),
    ch AS (SELECT *, row_number() OVER (PARTITION BY filing ORDER BY type = 'not_repeated', {_RANK}, section, block, pos)::INTEGER AS place FROM al)"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings.compare(_filings(spark, sf_dir), _passages(spark, sf_dir), TERMS, RECURRING, "^$", signals=rules.PROSE_SIGNALS)


@query(f"WITH {_CHANGES} SELECT filing, mode, place, type, significance, category, similarity, passage, previous_passage FROM ch WHERE place <= 16")
def filing_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 16 changes of each filing that a report shows, in its order: the feature is a report of that length."""
    return _changes(spark, sf_dir).filter(F.col("place") <= filings.SHOWN).drop("title")


@query(f"WITH {_CHANGES} SELECT filing, mode, count(*) FILTER (WHERE type = 'new_event') AS new_event, count(*) FILTER (WHERE type = 'added') AS added, count(*) FILTER (WHERE type = 'modified') AS modified, count(*) FILTER (WHERE type = 'not_repeated') AS not_repeated, count(*) FILTER (WHERE significance = 'high') AS high FROM ch GROUP BY ALL")
def filing_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many changes of each kind every filing has."""
    kinds = (F.count_if(F.col("type") == k).alias(k) for k in ("new_event", "added", "modified", "not_repeated"))
    return _changes(spark, sf_dir).groupBy("filing", "mode").agg(*kinds, F.count_if(F.col("significance") == "high").alias("high"))


_CLAIM = r"""c0 AS (SELECT conv_id, turn, string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS l FROM conversations WHERE text IS NOT NULL),
    c1 AS (SELECT conv_id, turn, unnest(l) AS claim, generate_subscripts(l, 1) AS pos FROM c0), c2 AS (SELECT conv_id, turn * 100000 + pos AS number, list_sort(list_distinct(regexp_extract_all(lower(claim), '[a-z]{2,}'))) AS k FROM c1),
    c3 AS (SELECT conv_id, number, k, row_number() OVER (PARTITION BY conv_id ORDER BY number) AS step FROM c2)"""


@query(f"""WITH RECURSIVE {_CLAIM}, r AS (SELECT conv_id, 0::BIGINT AS step, 0::BIGINT AS number, []::STRUCT(n BIGINT, k VARCHAR[])[] AS kept, NULL::BIGINT AS near FROM (SELECT DISTINCT conv_id FROM c3) UNION ALL
    SELECT conv_id, step, number, CASE WHEN near IS NULL THEN list_append(kept, struct_pack(n := number, k := k)) ELSE kept END, near FROM (SELECT r.conv_id, c3.step, c3.number, r.kept, c3.k,
        list_min(list_transform(list_filter(r.kept, lambda e: CASE WHEN len(e.k) + len(c3.k) = 0 THEN true ELSE len(list_intersect(e.k, c3.k))::DOUBLE / len(list_distinct(list_concat(e.k, c3.k))) >= 0.82 END), lambda e: e.n)) AS near FROM r JOIN c3 ON c3.conv_id = r.conv_id AND c3.step = r.step + 1))
    SELECT conv_id, number, near IS NULL AS kept, near AS "like" FROM r WHERE step > 0""")
def distinct_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of a conversation as a claim: kept unless an earlier kept one says nearly the same."""
    each = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(text.sentences(F.col("text"))).alias("at", "claim"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("claim"), F.lit("[a-z]{2,}"), F.lit(0)))
    rows = each.select("conv_id", (F.col("turn").cast("long") * 100_000 + F.col("at") + 1).alias("number"), words.alias("tokens"))
    return similar.first_distinct(rows, ["conv_id"], "number", "tokens", 0.82).drop("tokens")
