"""Claims from evidence: the sentence that says most, retold with the company's name, checked against its source, else quoted.

All of it is row-local: a text is cut, its sentences are scored and the best is kept where the text lies, so texts are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import rules, text

#: A quoted fallback without a readable sentence has at most so many characters.
QUOTE_CHARS = 380


def _has(x: Column, pattern: str) -> Column:
    return x.rlike("(?i)" + text.ascii_edges(pattern))


def best_sentence(df: DataFrame, excerpt: str, name: str, section: str, sections: dict[str, str], target: str = "sentence") -> DataFrame:
    """df with the readable sentence or fragment of excerpt that scores best for its section, the earlier on ties; null if none is readable.

    Null excerpts count as empty, null names and sections match nothing.
    """
    body = F.regexp_replace(F.regexp_replace(F.col("__flat"), r"^[0-9]{1,3} +(?=[A-Z\"'])", ""), "^[•·▪◦-] *", "")
    quoted = F.regexp_replace(F.col(name), r"([.*+?^${}()|\[\]\\])", r"\\$1")
    first, *others = rules.CLAIM_FRAGMENTS
    before, after = text.ascii_edges(first.format("\0")).split("\0")
    fragments = [F.regexp_substr("__body", F.concat(F.lit("(?i)" + before), quoted, F.lit(after)))]
    fragments += [F.regexp_substr("__body", F.lit("(?i)" + text.ascii_edges(p))) for p in others]
    sentences = F.filter(F.transform(F.split("__body", r"(?<=[.!?]) +(?=[\"'A-Z])"), lambda s: F.trim(s)), lambda s: s != "")
    cut = df.withColumn("__flat", text.flat(F.coalesce(F.col(excerpt), F.lit("")))).withColumn("__body", body).withColumn("__fragments", F.array_compact(F.array(*fragments)))
    # of a slide, fragments alone are read; decided here, as the lambda below would test the whole text for each sentence
    cut = cut.withColumn("__parts", F.when(_has(F.substring("__body", 1, 80), rules.SLIDE), F.col("__fragments")).otherwise(F.concat("__fragments", sentences)))

    def scored(s: Column, place: Column) -> Column:
        fragment = F.array_contains("__fragments", s)
        readable = ~text.unreadable(s) & ~_has(s, rules.SLIDE) & ~_has(s, rules.ESTIMATE_NOTE)
        on_topic = F.lit(False)
        for key, pattern in sections.items():
            on_topic = on_topic | (F.col(section).eqNullSafe(key) & _has(s, pattern))
        points = lambda test, n: F.when(test, n).otherwise(0)
        size = F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1
        total = points(size.between(10, 48), 20) + points(on_topic, 20) + points(s.rlike("[0-9]"), 8) + points(fragment, 16) + F.greatest(F.lit(0), 8 - 2 * place)
        return F.when(readable, F.struct(total.alias("total"), (-place).alias("place"), s.alias("s")))

    best = F.array_max(F.transform("__parts", scored))
    return cut.withColumn(target, best["s"]).drop("__flat", "__body", "__fragments", "__parts")


def retold(sentence: Column, name: Column) -> Column:
    """A sentence of a company's own text as a statement about the company; reported speech stays as it is."""
    s = F.regexp_replace(sentence, "^[\"']|[\"']$", "")
    small = F.when(s.rlike("^[A-Z]{2,}(?![A-Za-z0-9_])"), s).otherwise(F.concat(F.lower(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30)))
    after_we = F.regexp_replace(s, r"(?i)^we +", "")
    after_we = F.regexp_replace(F.regexp_replace(after_we, "(?i)^expect(?![A-Za-z0-9_])", "expects"), "(?i)^believe(?![A-Za-z0-9_])", "believes")
    return (
        F.when(_has(sentence, rules.REPORTED_SPEECH), sentence)
        .when(s.rlike("(?i)^we +"), F.concat(name, F.lit(" "), after_we))
        .when(s.rlike("(?i)^our +"), F.concat(name, F.lit("'s "), F.regexp_replace(s, "(?i)^our +", "")))
        .when(F.startswith(F.lower(s), F.lower(name)), s)
        .when(_has(s, rf"^(?:{rules.OWN_VERBS})\b"), F.concat(name, F.lit(" "), small))
        .when(_has(s, rf"^(?:{rules.OWN_FIGURES})\b"), F.concat(name, F.lit(" reported "), small))
        .when(_has(s, r"^as of\b"), F.concat(name, F.lit(" reported that "), small))
        .otherwise(F.concat(name, F.lit(" disclosed that "), small))
    )


def checked(df: DataFrame, claim: str, excerpt: str, quote: Column) -> DataFrame:
    """df with overlap, and whether the claim's numbers are the source's, the source supports it, a quote is in it, and it is malformed.

    A claim without words of content is not supported. Null claims and excerpts count as empty.
    """
    said, source = F.coalesce(F.col(claim), F.lit("")), F.coalesce(F.col(excerpt), F.lit(""))
    tokens = lambda x: text.content_tokens(x, rules.CLAIM_STOP_WORDS)
    own = df.withColumns({"__said": text.flat(said), "__own": tokens(said), "__shared": F.size(F.array_intersect(tokens(said), tokens(source)))})
    n, shared = F.size("__own"), F.col("__shared")
    overlap = F.coalesce(F.try_divide(shared, n), F.lit(0.0))
    supported = (n > 0) & (shared >= F.least(F.lit(3), n)) & (overlap >= 0.24) & ~text.contradicts(said, source, rules.NEGATIONS, rules.DIRECTIONS)
    facts = lambda x: F.transform(text.numeric_facts(text.flat(x)), F.lower)
    flat = F.col("__said")
    bad = text.unreadable(flat) | _has(flat, rules.SLIDE) | _has(flat, rules.ESTIMATE_NOTE)
    tests = {
        "overlap": overlap,
        "numeric_ok": F.size(F.array_except(facts(said), facts(source))) == 0,
        "supported": supported,
        "quote_ok": ~quote | F.contains(text.comparable(source), text.comparable(said)),
        "malformed": bad,
    }
    return own.withColumns(tests).drop("__said", "__own", "__shared")


def quoted(sentence: Column, excerpt: Column) -> Column:
    """The fallback: the best readable sentence, else the excerpt's start up to a whole word."""
    start = F.regexp_replace(F.trim(F.substring(text.flat(F.coalesce(excerpt, F.lit(""))), 1, QUOTE_CHARS)), " +[^ ]*$", "")
    return F.coalesce(sentence, start)


def own_claims(df: DataFrame, excerpt: str, name: str, section: str, quality: str, sections: dict[str, str]) -> DataFrame:
    """df with claim, representation, status and quality_score: each row's best sentence, retold if that passes all checks, else quoted."""
    told = best_sentence(df, excerpt, name, section, sections, "__sentence").withColumn("__told", retold(F.col("__sentence"), F.coalesce(F.col(name), F.lit(""))))
    tested = checked(told, "__told", excerpt, F.lit(False))
    good = F.col("__sentence").isNotNull() & F.col("numeric_ok") & F.col("supported") & ~F.col("malformed")
    same = text.comparable(F.col("__told")) == text.comparable(F.col("__sentence"))
    out = {
        "claim": F.when(good, F.col("__told")).otherwise(quoted(F.col("__sentence"), F.col(excerpt))),
        "representation": F.when(good & ~same, "paraphrase").otherwise("quote"),
        "status": F.when(good, "verified").otherwise("source-fallback"),
        "quality_score": F.when(good, text.score(F.col(quality) * 0.8 + F.col("overlap") * 20)).otherwise(text.score(F.col(quality) - 8)),
    }
    return tested.withColumns(out).drop("__sentence", "__told", "overlap", "numeric_ok", "supported", "quote_ok", "malformed")


def verified(df: DataFrame, claim: str, quote: Column, excerpt: str, name: str, section: str, quality: str, sections: dict[str, str]) -> DataFrame:
    """df with the four checks of each claim against the text it cites, and final, status and quality_score: what fails any check is replaced by a quote of its source."""
    tested = checked(best_sentence(df, excerpt, name, section, sections, "__sentence"), claim, excerpt, quote)
    good = F.col("numeric_ok") & F.col("supported") & F.col("quote_ok") & ~F.col("malformed")
    out = {
        "final": F.when(good, F.col(claim)).otherwise(quoted(F.col("__sentence"), F.col(excerpt))),
        "status": F.when(good, "verified").otherwise("source-fallback"),
        "quality_score": F.when(good, text.score(F.col(quality) * 0.8 + F.col("overlap") * 20)).otherwise(text.score(F.col(quality) - 8)),
    }
    return tested.withColumns(out).drop("__sentence", "overlap")


def claim_words(claim: Column) -> Column:
    """What near-equal claims share; a claim without words of content is like equal texts alone."""
    found = text.content_tokens(claim, rules.CLAIM_STOP_WORDS)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.concat(F.lit("="), text.comparable(claim))))
