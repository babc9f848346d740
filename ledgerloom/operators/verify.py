"""How well an answer is supported by its sources."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerloom.functions import rules, text as T


def overlap(answer: Column, chunk: Column) -> Column:
    """Share of the answer's words that occur in the chunk."""
    return T.let(T.word_set(answer), lambda a: overlap_of_sets(a, T.word_set(chunk)))


def overlap_of_sets(answer: Column, chunk: Column) -> Column:
    """The same of two word sets, for callers that meet each text in many pairs."""
    return F.size(F.array_intersect(answer, chunk)) / F.greatest(F.size(answer), F.lit(1))


def alignment(answer: Column, chunks: Column, first: int = 5) -> Column:
    """Mean overlap over the first chunks (array<string>); no chunks give 0."""
    top = F.slice(chunks, 1, first)
    total = F.aggregate(F.transform(top, lambda c: overlap(answer, c)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(top) > 0, total / F.size(top)).otherwise(0.0)


def citation_coverage(answer: Column, sources: Column) -> Column:
    """Of sources (array<struct<ticker, year>>): identifiers named in the answer per source, plus up to 0.3 for phrases that
    cite. Blank identifiers never count."""

    def ids(s):
        t, y = F.upper(F.coalesce(s["ticker"], F.lit(""))), F.coalesce(s["year"].cast("string"), F.lit(""))
        return F.filter(F.array(t, F.trim(F.concat(t, F.lit(" "), y)), y), lambda x: x != "")

    named = F.filter(F.flatten(F.transform(sources, ids)), lambda x: F.contains(F.upper(answer), F.upper(x)))
    explicit = F.least(F.size(named) / F.greatest(F.size(sources), F.lit(1)), F.lit(1.0))
    bonus = F.least(T.count_matching(answer, rules.CITATION_PHRASES) * 0.1, F.lit(0.3))
    return F.when(F.size(sources) > 0, F.least(explicit + bonus, F.lit(1.0))).otherwise(0.0)


def overall(align: Column, cited: Column, facts: Column) -> Column:
    return rules.ALIGNMENT_WEIGHT * align + rules.CITATION_WEIGHT * cited + rules.FACT_WEIGHT * facts


def issues(align: Column, cited: Column, facts: Column) -> Column:
    flags = [F.when(align < 0.5, F.lit("Low alignment between answer and sources")), F.when(cited < 0.5, F.lit("Few sources are cited")), F.when(facts < 0.7, F.lit("Some facts could not be verified"))]
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


@F.pandas_udf(StringType())
def first_json_object(s: pd.Series) -> pd.Series:
    """The first balanced {...} of a judge's reply; null if there is none."""

    def cut(t):
        if t is None or (a := t.find("{")) < 0:
            return None
        depth = 0
        for i in range(a, len(t)):
            depth += (t[i] == "{") - (t[i] == "}")
            if not depth:
                return t[a : i + 1]
        return None

    return s.map(cut)


CLAIMS = "struct<claims: array<struct<claim: string, verified: boolean, supporting_sources: array<int>, confidence: double>>>"


def judged_score(reply_json: Column) -> Column:
    """Score of a judge's JSON clamped to [0, 1], 0.5 if it names none; null if it is no JSON object."""
    parsed = F.from_json(reply_json, "struct<score: double>")
    return F.when(F.try_parse_json(reply_json).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(parsed["score"], F.lit(0.5)))))


def fact_check(reply_json: Column, chunk_ids: Column) -> Column:
    """struct<score, verified_sources, unverified_claims>; source numbers count from 1; no claims give 0.5."""
    claims = F.filter(F.coalesce(F.from_json(reply_json, CLAIMS)["claims"], F.array().cast("array<" + CLAIMS[len("struct<claims: array<") : -2] + ">")), lambda c: c.isNotNull())
    good = F.filter(claims, lambda c: F.coalesce(c["verified"], F.lit(False)))
    numbers = F.flatten(F.transform(good, lambda c: F.coalesce(c["supporting_sources"], F.array().cast("array<int>"))))
    used = F.array_distinct(F.transform(F.filter(numbers, lambda n: (n >= 1) & (n <= F.size(chunk_ids))), lambda n: F.element_at(chunk_ids, n)))
    bad = F.transform(F.filter(claims, lambda c: ~F.coalesce(c["verified"], F.lit(False))), lambda c: F.coalesce(c["claim"], F.lit("")))
    none = F.array().cast("array<string>")
    some = F.size(claims) > 0
    return F.struct(F.when(some, F.size(good) / F.size(claims)).otherwise(0.5).alias("score"), F.when(some, used).otherwise(none).alias("verified_sources"), F.when(some, bad).otherwise(none).alias("unverified_claims"))


def verification(answer: Column, texts: Column, sources: Column, facts: Column, align: Column | None = None) -> Column:
    """The whole result; without sources all zeros and one issue."""
    a = F.coalesce(align, alignment(answer, texts)) if align is not None else alignment(answer, texts)
    c = citation_coverage(answer, sources)
    none = F.array().cast("array<string>")
    full = F.struct(overall(a, c, facts["score"]).alias("overall_score"), a.alias("answer_source_alignment"), c.alias("citation_coverage"), facts["score"].alias("fact_verification_score"), issues(a, c, facts["score"]).alias("issues"), facts["verified_sources"].alias("verified_sources"), facts["unverified_claims"].alias("unverified_claims"))
    zero = F.lit(0.0)
    empty = F.struct(zero.alias("overall_score"), zero.alias("answer_source_alignment"), zero.alias("citation_coverage"), zero.alias("fact_verification_score"), F.array(F.lit(rules.NO_SOURCES)).alias("issues"), none.alias("verified_sources"), none.alias("unverified_claims"))
    return F.when(F.size(texts) > 0, full).otherwise(empty)


