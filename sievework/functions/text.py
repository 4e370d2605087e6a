"""Text as column expressions: built-in functions, so that they stay inside generated code; only fnv1a needs a batch in Python."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def word(pattern: str) -> str:
    """A pattern between ASCII word boundaries, whatever the regular expression engine takes a letter to be."""
    return rf"(?i)(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def ascii_edges(pattern: str) -> str:
    """A pattern whose \\b is the edge of a run of ASCII letters, digits and underscores, whatever the engine takes it to be."""
    w = "[A-Za-z0-9_]"
    return pattern.replace(r"\b", f"(?:(?<!{w})(?={w})|(?<={w})(?!{w}))")


def clean(text: Column) -> Column:
    """White space and no-break spaces as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), r"[\t\n\x0B\f\r][ \t\n\x0B\f\r]*| [ \t\n\x0B\f\r]+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Cut after a sentence mark, before white space and a capital or digit."""
    return F.split(text, r"(?<=[.!?])[ \t\n\x0B\f\r]+(?=[A-Z0-9])")


def distinct_matches(text: Column, pattern: str) -> Column:
    """Number of different matches, without regard to case."""
    return F.size(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))))


def rounded(x: Column) -> Column:
    """Halves go up, as for negative numbers too."""
    return F.floor(x + 0.5).cast("int")


def score(x: Column) -> Column:
    """Rounded and held to 0 to 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), rounded(x)))


def first_topic(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The topic of the first rule that matches."""
    out = F.lit(default)
    for topic, pattern in reversed(rules):
        out = F.when(text.rlike(f"(?i){pattern}"), topic).otherwise(out)
    return out


def most_topic(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The topic whose rule matches most often, the earlier on ties."""
    counts = [F.struct(F.regexp_count(text, F.lit(f"(?i){p}")).alias("n"), F.lit(-i).alias("order"), F.lit(t).alias("topic")) for i, (t, p) in enumerate(rules)]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["topic"]).otherwise(default)


def readability_risk(df: DataFrame, column: str, labels: str, name: str = "risk", words: str | None = None) -> DataFrame:
    """df with the risk that a passage is a broken table or slide: few sentence marks, many numbers, years or labels, a lower-case start.

    The cleaned text is a column of its own on the way, so that it is made once for all tests. words names a column for its
    number of words. Years are counted only where a 20 stands, labels only where so few marks stand that they count.
    """
    value = F.col("__clean")
    count = lambda pattern: F.regexp_count(value, F.lit(pattern))
    spaces = F.length(value) - F.length(F.replace(value, F.lit(" "), F.lit("")))
    tests = {"__n": F.when(value == "", 0).otherwise(spaces + 1), "__dense": count("[0-9][^ ]*"), "__marks": count(r"[.!?](?:\s|$)"), "__years": F.when(F.contains(value, F.lit("20")), count(word(r"20\d{2}"))).otherwise(0), "__low": value.rlike(r"^[a-z]{2,}\s")}
    n, marks = F.col("__n"), F.col("__marks")
    add = lambda test, points: F.when(test, points).otherwise(0)
    risk = (
        add((n >= 25) & (marks == 0), 35)
        + add((n >= 45) & (marks == 0), 20)
        + add((n >= 80) & (marks <= 1), 25)
        + add(F.col("__dense") / F.greatest(n, F.lit(1)) > 0.28, 30)
        + add(F.col("__years") >= 4, 25)
        + F.when(marks > 2, 0).otherwise(add(count(word(labels)) >= 10, 25))
        + add(F.col("__low"), 20)
    )
    tested = df.withColumn("__clean", clean(F.col(column))).withColumns(tests)
    rated = tested.withColumn(name, F.when(n == 0, 100).otherwise(F.least(F.lit(100), risk)).cast("int"))
    return (rated.withColumn(words, n) if words else rated).drop("__clean", *tests)


@F.pandas_udf(T.StringType())
def fnv1a(texts: pd.Series) -> pd.Series:
    """32-bit FNV-1a over the characters of a text of code points below 65,536, in hexadecimal without leading zeros.

    All texts of a batch take a step together, the longest last; null gives null.
    """
    known = texts.dropna()
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in known]
    order = sorted(range(len(codes)), key=lambda i: -len(codes[i]))
    sizes = np.array([len(codes[i]) for i in order], np.int64)
    flat = np.concatenate([codes[i] for i in order] or [np.empty(0, np.uint32)])
    start, hashes = np.cumsum(sizes) - sizes, np.full(len(order), 2166136261, np.uint32)
    left, longest = len(order), int(sizes[0]) if len(order) else 0
    for at in range(longest):
        while sizes[left - 1] <= at:
            left -= 1
        hashes[:left] = (hashes[:left] ^ flat[start[:left] + at]) * np.uint32(16777619)
    out = [""] * len(order)
    for i, h in zip(order, hashes.tolist(), strict=True):
        out[i] = f"{h:x}"
    return pd.Series(out, known.index, dtype=object).reindex(texts.index)


def plain(text: Column) -> Column:
    """What texts that differ in case, white space and signs only have in common."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[ \t\n\x0B\f\r]+", " "), r"[^a-z0-9$% ]", ""))


def duplicate_key(plain_text: Column) -> Column:
    """A short label of a plain() text; two different ones may share it."""
    return F.concat_ws(":", F.lit("duplicate"), fnv1a(plain_text), F.length(plain_text).cast("string"))


def tokens(text: Column, stop: list[str], shortest: int = 2) -> Column:
    """Distinct lower-case ASCII words and numbers that are no stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= shortest) & ~t.isin(stop)))


#: Letters of the longest part of a word by which terms inside it are found, and of the shortest.
PART, SHORTEST_PART = 6, 3


def parts(word: Column) -> Column:
    """Distinct parts of a word of SHORTEST_PART to PART letters: a term inside it begins with, or is, one of them."""
    starts = F.sequence(F.lit(1), F.length(word) - SHORTEST_PART + 1)
    return F.array_distinct(F.flatten(F.transform(starts, lambda at: F.array(*(F.substring(word, at, F.lit(n)) for n in range(SHORTEST_PART, PART + 1))))))


def pieces(words: Column, longest: int) -> Column:
    """Distinct words, long ones in pieces that overlap so far that a term of up to `longest` letters inside a word is inside a piece."""
    step = max(64, longest)
    most = step + longest
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - longest), F.lit(step)), lambda at: F.substring(w, at, F.lit(most)))
    long = F.exists(words, lambda w: F.length(w) > most)
    return F.array_distinct(F.when(long, F.filter(F.flatten(F.transform(words, cut)), lambda w: F.length(w) >= SHORTEST_PART)).otherwise(words))


def jaccard(a: Column, b: Column, both_empty: float) -> Column:
    """Shared share of two sets of tokens."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, both_empty).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def canonical_url(url: Column) -> Column:
    """Without fragment and tracking parameters (utm_*, gclid, fbclid, mc_*)."""
    plain = F.regexp_replace(url, "#.*$", "")
    cut = F.regexp_replace(plain, r"(?i)(?<=[?&])(?:utm_[^=&]*|gclid|fbclid|mc_[^=&]*)(?:=[^&]*)?(?:&|$)", "")
    return F.regexp_replace(cut, "[?&]$", "")


def tone(text: Column, strong: str, weak: str, unsure: str) -> Column:
    """uncertain, stronger, weaker or neutral."""
    balance = F.regexp_count(text, F.lit(word(strong))) - F.regexp_count(text, F.lit(word(weak)))
    return F.when(F.regexp_count(text, F.lit(word(unsure))) > F.abs(balance), "uncertain").when(balance > 0, "stronger").when(balance < 0, "weaker").otherwise("neutral")


def change(now: Column, before: Column) -> Column:
    """direction, delta_percent and significance of a value against the one before; a band of 2 % is unchanged."""
    delta = rounded(F.try_divide(now - before, F.abs(before)) * 100)
    direction = (
        F.when(before.isNull(), "new")
        .when(before == 0, F.when(now == before, "unchanged").otherwise("changed"))
        .when(F.abs(delta) <= 2, "unchanged")
        .when(delta > 0, "increased")
        .otherwise("decreased")
    )
    significance = F.when(before.isNull(), "medium").when(F.abs(delta) >= 25, "high").when(F.abs(delta) >= 10, "medium").otherwise("low")
    return F.struct(direction.alias("direction"), delta.alias("delta_percent"), significance.alias("significance"))


def research_grade(text: Column, boilerplate: list[str], least: int = 18) -> Column:
    """Enough words, and no boilerplate."""
    any_of = F.lit(False)
    for pattern in boilerplate:
        any_of = any_of | text.rlike(f"(?i){pattern}")
    return (F.size(words(text)) >= least) & ~any_of


def passages(text: Column, most: int = 1100) -> Column:
    """Sentences packed in order into passages of at most `most` characters; a longer sentence is cut hard."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, s: Column) -> Column:
        full = (acc["open"] != "") & (F.length(acc["open"]) + F.length(s) + 1 > most)
        done = F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.length(s) - 1, F.lit(0)), F.lit(most)), lambda at: F.trim(F.substring(s, at + 1, F.lit(most))))
        long = F.length(s) > most  # never fits what is open, which is done by then
        joined = F.when(full | (acc["open"] == ""), s).otherwise(F.concat_ws(" ", acc["open"], s))
        return F.struct(F.when(long, F.concat(done, pieces)).otherwise(done).alias("done"), F.when(long, F.lit("")).otherwise(joined).alias("open"))

    packed = F.aggregate(sentences(text), empty, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))
    return F.filter(packed, lambda p: p != "")


def section(heading: Column, sections: list[tuple[str, str, str]]) -> Column:
    """category and title of a section heading, null for other text."""
    item = r"(?i)^item\s+([0-9]+(?:\.[0-9]+)?[a-z]?)[.\s:-]+(.{3,165})$"
    generic = F.concat(F.lit("Item "), F.regexp_extract(heading, item, 1), F.lit(": "), F.regexp_replace(F.regexp_extract(heading, item, 2), r"\.$", ""))
    out = F.when(heading.rlike(item), F.struct(F.lit("Filing item").alias("category"), generic.alias("title")))
    for category, title, pattern in reversed(sections):
        out = F.when(heading.rlike(f"(?i){pattern}"), F.struct(F.lit(category).alias("category"), F.lit(title).alias("title"))).otherwise(out)
    return F.when(F.length(heading) <= 180, out)


def flat(text: Column) -> Column:
    """Quotes and spaces made plain, escaped quotes too; white space as one space, none at the ends."""
    plain = F.regexp_replace(F.regexp_replace(F.replace(text, F.lit('\\"'), F.lit('"')), "[\u00a0\u2007\u202f]", " "), "[“”]", '"')
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[‘’]", "'"), r"[ \t\n\x0B\f\r]+", " "))


def comparable(text: Column) -> Column:
    """Lower case, quotes and spaces made plain, other signs as spaces."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[\u00a0\u2007\u202f]", " "), "[“”]", '"'), "[‘’]", "'")
    plain = F.lower(F.regexp_replace(F.trim(F.regexp_replace(plain, r"[ \t\n\x0B\f\r]+", " ")), "^[\"']|[\"']$", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9$%£€.' -]", " "), " +", " "))


def content_tokens(text: Column, stop: list[str], shortest: int = 4) -> Column:
    """Distinct words that carry content: no short ones, stop words or plain numbers."""
    parts = F.transform(F.split(comparable(text), " "), lambda t: F.regexp_replace(t, "^[^a-z0-9]+|[^a-z0-9]+$", ""))
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) >= shortest) & ~t.isin(stop) & ~t.rlike("^[0-9]+$")))


def numeric_facts(text: Column) -> Column:
    """Numbers of a text with currency and unit, in one spelling each."""
    pattern = r"(?i)(?:[$€£]\s*)?\d[\d,]*(?:\.\d+)?\s*(?:%|percent|basis points?|bps|mw|gw|kw|billion|million|thousand|bn|mn|years?|months?|quarters?|gpus?|buildings?|customers?|b|m|k)?"
    prepared = F.regexp_replace(text, r"(?i)([0-9])-(?=(?:year|month|quarter)(?![A-Za-z0-9_]))", "$1 ")

    def fact(x: Column) -> Column:
        unit = F.lower(F.regexp_extract(x, r"(?i)([a-z%][a-z ]*)$", 1))
        name = F.when(unit.isin("b", "bn", "billion"), "billion").when(unit.isin("m", "mn", "million"), "million").when(unit.isin("k", "thousand"), "thousand").when(unit.isin("%", "percent"), "percent")
        name = name.when(unit.isin("bps", "basis point", "basis points"), "basis-points").otherwise(unit)
        number = F.concat(F.regexp_extract(x, "^([$€£]?)", 1), F.regexp_replace(F.regexp_extract(x, r"(\d[\d,]*(?:\.\d+)?)", 1), ",", ""))
        return F.when(name != "", F.concat_ws(":", number, name)).otherwise(number)

    return F.transform(F.regexp_extract_all(prepared, F.lit(pattern), F.lit(0)), fact)


def malformed(text: Column) -> Column:
    """Whether a claim is no readable sentence: too short or long, too many numbers or years, an address or a page number, a run of capitals."""
    return unreadable(clean(text))


def unreadable(value: Column) -> Column:
    """malformed() of a text that is clean already."""
    parts = F.split(value, " ")
    dense = F.size(F.filter(parts, lambda w: w.rlike("[0-9]"))) / F.size(parts)
    return (
        ~F.length(value).between(24, 420)
        | (F.size(parts) < 5)
        | value.rlike(r"^[a-z]{2,}\s")
        | value.rlike(r"(?i)(?<![A-Za-z0-9_])www\.\S+|(?<![A-Za-z0-9_])\d+\s*/\s*\d+(?![A-Za-z0-9_])")
        | (F.regexp_count(value, F.lit(word(r"20\d{2}"))) >= 4)
        | (dense > 0.32)
        | value.rlike(r"(?:(?<![A-Za-z0-9_])[A-Z]{2,}(?![A-Za-z0-9_])\s*){7,}")
    )


def contradicts(a: Column, b: Column, negations: str, directions: list[tuple[str, str]]) -> Column:
    """Whether one text denies what the other says, or points the other way."""
    has = lambda x, p: x.rlike(word(p))
    out = has(a, negations) != has(b, negations)
    for up, down in directions:
        out = out | (has(a, up) & has(b, down)) | (has(a, down) & has(b, up))
    return out


def impact(text: Column, good: str, bad: str) -> Column:
    """strengthens, weakens or watch."""
    up, down = text.rlike(word(good)), text.rlike(word(bad))
    return F.when(up & ~down, "strengthens").when(down & ~up, "weakens").otherwise("watch")


def text_change(kind: Column, similarity: Column, now: Column, before: Column, terms: list[str]) -> Column:
    """high, medium or low: significance of a change of text, by its kind, similarity and the material terms that come or go. now, before: tokens."""
    of = lambda x: F.array_intersect(F.array(*map(F.lit, terms)), x)
    either = F.when(F.size(now) > 0, now).otherwise(before)
    moved = (F.size(F.array_except(of(now), before)) > 0) | (F.size(F.array_except(of(before), now)) > 0)
    alone = F.when(F.size(of(either)) > 0, "high").otherwise("medium")
    return F.when(kind == "not_repeated", "low").when(kind != "modified", alone).when((similarity < 0.55) | moved, "high").when(similarity < 0.75, "medium").otherwise("low")
