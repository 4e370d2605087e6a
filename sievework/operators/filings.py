"""Comparison of a filing with the one before: passages assigned one to one inside sections, events scored on their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import rules, text
from sievework.storage import stored

from . import similar

#: Least similarity of a pair, from where a pair counts as unchanged, and changes that a report shows.
LEAST, UNCHANGED, SHOWN = 0.35, 0.9, 16


def mode(form: Column) -> Column:
    """amendment, event or periodic."""
    name = F.upper(form)
    return F.when(F.endswith(name, F.lit("/A")), "amendment").when(name.isin("8-K", "6-K"), "event").otherwise("periodic")


def section_key(category: Column, title: Column) -> Column:
    item = F.lower(F.regexp_extract(title, r"(?i)^item\s+([0-9]+(?:\.[0-9]+)?[a-z]?)", 1))
    return F.when(item != "", F.concat(F.lit("item:"), item)).otherwise(F.lower(F.concat_ws(":", category, title)))


def event_policy(form: Column, item_code: Column, category: Column, title: Column, body: Column, signals: Sequence[tuple[str, int, str]] = tuple(rules.EVENT_SIGNALS), policies: Sequence[tuple] = tuple(rules.ITEM_POLICIES)) -> Column:
    """code, type, category, score and eligible of a passage of an event filing.

    The item's policy gives type and base score, each signal that the passage has its weight; the category is that of the
    largest weight, 12 more for the item's own, ties to the earlier signal. Administrative items, boilerplate, exhibit
    lines, passages without a category and scores under 45 are not eligible.
    """
    own = F.regexp_extract(title, r"(?i)^item\s+([0-9]+(?:\.[0-9]+)?)", 1)
    code = F.coalesce(item_code, F.when(own != "", own), F.when(category == "Agreement", "1.01").when(category == "Financials", "9.01").when(category == "Event", "8.01"))
    foreign = F.upper(form) == "6-K"
    pick = lambda value, default: _case(code, [(p[0], value(p)) for p in policies], default)
    kind = pick(lambda p: p[1], F.when(foreign, "Foreign issuer update").otherwise("Current report update"))
    base = pick(lambda p: p[2], F.when(foreign, 25).otherwise(10))
    item_category, administrative = pick(lambda p: p[3], F.lit(None).cast("string")), pick(lambda p: p[4], F.lit(False))
    has = lambda pattern: body.rlike(f"(?i){text.ascii_edges(pattern)}")
    found = [has(pattern) for _, _, pattern in signals]
    points = [F.when(hit, weight).otherwise(0) for hit, (_, weight, _) in zip(found, signals, strict=True)]
    ranked = [
        F.struct((p + F.when(item_category == name, 12).otherwise(0)).alias("n"), F.when(hit, -i).otherwise(-100).alias("order"), F.lit(name).alias("category"))
        for i, (p, hit, (name, *_)) in enumerate(zip(points, found, signals, strict=True))
    ]
    top = F.array_max(F.array(*ranked))
    best = F.when(top["n"] > 0, top["category"]).otherwise("Other")
    total = F.least(F.lit(100), base + sum(points, F.lit(0)))
    plain = has(rules.EVENT_BOILERPLATE) | has(rules.EXHIBIT_LINE) | F.coalesce(category == "Financials", F.lit(False))
    eligible = ~administrative & ~plain & (best != "Other") & (total >= 45)
    return F.struct(code.alias("code"), kind.alias("type"), best.alias("category"), total.cast("int").alias("score"), eligible.alias("eligible"))


def _case(value: Column, options: Sequence[tuple], default: Column) -> Column:
    out = default
    for key, result in options:
        out = F.when(value == key, result if isinstance(result, Column) else F.lit(result)).otherwise(out)
    return out


def compare(
    filings: DataFrame, passages: DataFrame, terms: Sequence[str] = tuple(rules.MATERIAL_TERMS), recurring: Sequence[str] = tuple(rules.RECURRING),
    recurring_title: str = rules.RECURRING_TITLE, stop: Sequence[str] = tuple(rules.FILING_STOP_WORDS), signals: Sequence[tuple[str, int, str]] = tuple(rules.EVENT_SIGNALS),
) -> DataFrame:
    """filing, mode, place long, type, significance, category, title, similarity int, passage, previous_passage: all changes of every filing.

    filings: filing, form, previous (null: none); passages: filing, section (order of a filing's sections), category, title,
    item_code, passage (order within the section), text. Event filings give new_event for eligible passages. Others are
    compared with their previous filing, periodic ones in recurring sections only: inside sections of one key, passages in
    order take their most similar free partner of at least LEAST, and are modified below UNCHANGED; the others are added,
    and unmatched passages of the previous filing not_repeated. Filings without a previous one give no rows unless they
    are events. place orders a filing's changes as a report does, which shows the first SHOWN.
    """
    how = filings.select("filing", "form", "previous", mode(F.col("form")).alias("mode"))
    compared = how.filter((F.col("mode") != "event") & F.col("previous").isNotNull())
    role = lambda target, side: F.struct(F.col(target).alias("target"), F.col("mode").alias("mode"), F.lit(side).alias("side"))
    # what a filing's passages are for: sides of comparisons (0 now, 1 before) or events (2); texts move to that once, token sets once more
    roles = compared.select("filing", role("filing", 0).alias("role"), F.lit(None).cast("string").alias("form")).unionByName(compared.select(F.col("previous").alias("filing"), role("filing", 1).alias("role"), F.lit(None).cast("string").alias("form")))
    roles = roles.unionByName(how.filter("mode = 'event'").select("filing", role("filing", 2).alias("role"), "form"))
    roles = roles.groupBy("filing").agg(F.collect_list("role").alias("roles"), F.max("form").alias("form"))
    again = F.coalesce(F.col("category").isin(*recurring) | F.col("title").rlike(f"(?i){recurring_title}"), F.lit(False))
    rows = passages.select("filing", "section", "category", "title", "item_code", "passage", "text").join(roles, "filing")
    rows = rows.withColumn("roles", F.filter("roles", lambda r: (r["side"] == 2) | (r["mode"] == "amendment") | again)).filter(F.size("roles") > 0)
    is_event = F.exists("roles", lambda r: r["side"] == 2)
    rows = rows.withColumns({
        "tokens": F.when(F.exists("roles", lambda r: r["side"] != 2), text.tokens(F.col("text"), list(stop))),
        # of other rows an empty text is rated: inside a condition each pattern would be tried several times
        "e": event_policy(F.col("form"), F.col("item_code"), F.col("category"), F.col("title"), F.when(is_event, F.col("text")).otherwise(""), signals),
    })
    rows = rows.select(F.explode("roles").alias("role"), section_key(F.col("category"), F.col("title")).alias("key"), "section", "category", "title", "passage", "tokens", "e")
    known = F.array_intersect(F.array(*map(F.lit, terms)).cast("array<string>"), "tokens")
    rows = rows.select(F.col("role.target").alias("filing"), "role.mode", "role.side", "key", "section", "category", "title", "passage", F.when(F.col("role.side") != 2, F.col("tokens")).alias("tokens"), F.when(F.col("role.side") != 2, known).alias("terms"), F.when(F.col("role.side") == 2, F.col("e")).alias("e"))
    rows = stored(rows, "filings-sides")
    now, before = rows.filter("side = 0").drop("side", "e"), rows.filter("side = 1").drop("side", "e")
    by = ["filing", "key"]
    side = lambda df, name: df.select(*by, F.col("passage").alias(f"{name}_passage"), F.col("tokens").alias(name))
    met = side(now, "left").join(side(before, "right"), by)
    near = F.least(F.size("left"), F.size("right")) >= F.greatest(F.size("left"), F.size("right")) * LEAST - 1e-9
    pairs = met.filter(near).select(*by, "left_passage", "right_passage", text.jaccard(F.col("left"), F.col("right"), 1.0).alias("similarity"))
    pairs = pairs.filter(F.col("similarity") >= LEAST)
    taken = similar.assign(pairs, by, "left_passage", "right_passage", "similarity")
    now, before = now.drop("tokens"), before.drop("tokens")
    n = now.withColumn("left_passage", F.col("passage")).join(taken, [*by, "left_passage"], "left").withColumnRenamed("right_passage", "previous_passage")
    old = before.select(*by, F.col("passage").alias("previous_passage"), F.col("terms").alias("old_terms"))
    n = n.join(old, [*by, "previous_passage"], "left").filter(F.col("similarity").isNull() | (F.col("similarity") < UNCHANGED))
    kind = F.when(F.col("similarity").isNull(), "added").otherwise("modified")
    empty = F.array().cast("array<string>")
    level = lambda k, s, a, b: text.text_change(k, s, F.coalesce(a, empty), F.coalesce(b, empty), list(terms))
    shown = ["filing", "mode", "type", "significance", "category", "title", "similarity", "passage", "previous_passage", "section", "block", "at"]
    fresh = n.withColumns({"type": kind, "significance": level(kind, F.col("similarity"), F.col("terms"), F.col("old_terms")), "similarity": text.rounded(F.col("similarity") * 100), "block": F.lit(0), "at": F.col("passage")}).select(*shown)
    gone = before.withColumn("right_passage", F.col("passage")).join(taken.select(*by, "right_passage"), [*by, "right_passage"], "left_anti")
    current = now.groupBy(*by).agg(F.min("section").alias("now_section"))
    gone = gone.join(current, by, "left").select(
        "filing", "mode", F.lit("not_repeated").alias("type"), F.lit("low").alias("significance"), "category", "title", F.lit(None).cast("int").alias("similarity"), F.lit(None).cast(rows.schema["passage"].dataType).alias("passage"),
        F.col("passage").alias("previous_passage"), F.coalesce("now_section", F.col("section") + 1_000_000).alias("section"), F.lit(1).alias("block"), F.col("passage").alias("at"),
    )
    events = rows.filter("side = 2 AND e.eligible").select(
        "filing", "mode", F.lit("new_event").alias("type"), F.when(F.col("e.score") >= 75, "high").when(F.col("e.score") >= 55, "medium").otherwise("low").alias("significance"), F.col("e.category").alias("category"), "title",
        F.lit(None).cast("int").alias("similarity"), "passage", F.lit(None).cast(rows.schema["passage"].dataType).alias("previous_passage"), "section", F.lit(0).alias("block"), F.col("passage").alias("at"),
    )
    every = fresh.unionByName(gone).unionByName(events)
    rank = F.when((F.col("mode") == "event") | (F.col("significance") == "high"), 0).when(F.col("significance") == "medium", 1).otherwise(2)
    order = Window.partitionBy("filing").orderBy(F.col("type") == "not_repeated", rank, "section", "block", "at")
    return every.withColumn("place", F.row_number().over(order)).select("filing", "mode", "place", "type", "significance", "category", "title", "similarity", "passage", "previous_passage")
