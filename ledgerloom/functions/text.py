"""Text functions as Spark columns: everything stays in built-in expressions unless said otherwise."""

from __future__ import annotations

import html
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerloom.functions import rules


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: The characters of rules.SPACE.
BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c) -> Column:
    """Unicode whitespace off both ends."""
    return F.btrim(_col(c), F.lit(BLANKS))


def normalize_ws(c) -> Column:
    return F.trim(F.regexp_replace(_col(c), rf"[{rules.SPACE}]+", " "))


@F.pandas_udf(StringType())
def decode_entities(s: pd.Series) -> pd.Series:
    """All named and numeric entities (the one text function that needs a table Spark does not have)."""
    return s.map(html.unescape, na_action="ignore")


def strip_tags(c) -> Column:
    return F.regexp_replace(_col(c), "<[^>]+>", "")


def _each(c: Column, patterns, flags: str) -> Column:
    return reduce(lambda acc, p: F.regexp_replace(acc, flags + p, ""), patterns, c)


def _lines(c: Column) -> Column:
    return F.split(c, "\n")


def _join(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def let(c: Column, f) -> Column:
    """f(c) with c evaluated once, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def remove_xbrl(c, long_line: int = rules.LONG_XBRL_LINE) -> Column:
    """Containers, tags with attributes, then long lines that name a taxonomy or a url. Texts without the signs these rules
    need pass by."""
    marked = lambda x: x.contains("http://") | x.contains("https://") | F.lower(x).contains("xbrl") | F.lower(x).contains("us-gaap") | x.rlike("[a-z]+:[A-Z][a-zA-Z]+")
    spans = lambda x: F.when(x.rlike("(?i)<(?:link|xbrli?):"), _each(x, rules.XBRL_SPANS, "(?is)")).otherwise(x)
    tags = lambda x: F.when(x.contains("<"), F.regexp_replace(x, r"<[^>]+\s+[^>]+>", "")).otherwise(x)
    lines = lambda x: F.when((F.length(x) > long_line) & marked(x), _join(F.filter(_lines(x), lambda y: ~((F.length(y) > long_line) & marked(y))))).otherwise(x)
    return let(let(let(_col(c), spans), tags), lines)


def remove_encoded_runs(c, width: int = 60, least: int = 3) -> Column:
    """Runs of at least ``least`` lines of base64-like characters. A fold over the lines of a row: no shuffle, and a text
    that consists of one run only becomes empty instead of disappearing."""
    is_code = lambda x: strip(x).rlike(f"^[A-Za-z0-9+/=]{{{width},}}$")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("held"))

    def step(acc, x):
        keep = F.when(F.size(acc["held"]) >= least, acc["out"]).otherwise(F.concat(acc["out"], acc["held"]))
        return F.when(is_code(x), F.struct(acc["out"].alias("out"), F.concat(acc["held"], F.array(x)).alias("held"))).otherwise(
            F.struct(F.concat(keep, F.array(x)).alias("out"), F.array().cast("array<string>").alias("held"))
        )

    end = lambda acc: F.when(F.size(acc["held"]) >= least, acc["out"]).otherwise(F.concat(acc["out"], acc["held"]))
    return let(_col(c), lambda x: F.when(x.rlike(f"[A-Za-z0-9+/=]{{{width}}}"), _join(F.aggregate(_lines(x), start, step, end))).otherwise(x))


ANY_LABEL = "(?id)(?:" + "|".join(rules.HEADER_LABELS) + ")"


def remove_header_labels(c) -> Column:
    """Labelled header values, then lines that still hold one, then long lines of digits, colons and dashes."""
    labels = lambda x: F.when(x.contains(":") & x.rlike(ANY_LABEL), _each(x, rules.HEADER_LABELS, "(?id)")).otherwise(x)
    numbers = rf"[\p{{Nd}}{rules.SPACE}:-]"
    bad = lambda x: let(strip(x), lambda y: (y.contains(":") & y.rlike(ANY_LABEL)) | (y.rlike(f"^{numbers}+$") & (F.length(y) > 10)))
    lines = lambda x: F.when((x.contains(":") & x.rlike(ANY_LABEL)) | x.rlike(f"(?m)^{numbers}{{11,}}$"), _join(F.filter(_lines(x), lambda y: ~bad(y)))).otherwise(x)
    return let(let(_col(c), labels), lines)


def remove_boilerplate(c) -> Column:
    return _each(_col(c), rules.BOILERPLATE, "(?is)")


def main_content(c) -> Column:
    """From the first line with a start marker up to the last line with an end marker, if both leave something."""
    has = lambda x, marks: reduce(lambda a, b: a | b, [x.contains(m) for m in marks])

    def cut(x):
        lines = _lines(x)

        def bounds(upper):
            start = F.array_position(F.transform(upper, lambda y: has(y, rules.CONTENT_STARTS)), F.lit(True)) - 1
            last = F.array_position(F.reverse(F.transform(upper, lambda y: has(y, rules.CONTENT_ENDS))), F.lit(True))
            return F.struct(start.cast("int").alias("s"), F.when(last > 0, F.size(upper) - last).otherwise(F.size(upper)).cast("int").alias("e"))

        at = let(F.transform(lines, lambda y: F.upper(strip(y))), bounds)
        return let(at, lambda b: F.when((b["s"] > 0) & (b["s"] < b["e"]), _join(F.slice(lines, b["s"] + 1, F.greatest(b["e"] - b["s"], F.lit(0))))).otherwise(x))

    return let(_col(c), cut)


def clean_text(c) -> Column:
    """The whole cleaning pipeline in its fixed order; every step sees the text of the one before it once."""
    out = strip_tags(decode_entities(_col(c)))
    for step in (remove_xbrl, remove_encoded_runs, remove_header_labels, main_content, remove_boilerplate, normalize_ws):
        out = step(out)  # each binds its text once
    return out


def sentences(c) -> Column:
    return F.filter(F.split(_col(c), rf"(?<=[.!?])[{rules.SPACE}]+"), lambda x: strip(x) != "")


def token_count(c, cap: int | None = rules.SENTENCE_TOKEN_CAP) -> Column:
    """Words, numbers and runs of signs: the stand-in for a subword tokenizer; pluggable wherever tokens are counted."""
    n = F.regexp_count(_col(c), F.lit(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"))
    return F.least(n, F.lit(cap)) if cap else n


def byte_length(c) -> Column:
    return F.octet_length(_col(c))


def letter_ratio(c) -> Column:
    return F.length(F.regexp_replace(_col(c), "[^a-zA-Z]+", "")) / F.greatest(F.length(_col(c)), F.lit(1))


def symbol_ratio(c) -> Column:
    return F.length(F.regexp_replace(_col(c), rf"[0-9A-Za-z{rules.SPACE}]+", "")) / F.greatest(F.length(_col(c)), F.lit(1))


def count_matching(c, patterns, flags: str = "(?d)") -> Column:
    return reduce(lambda a, b: a + b, [_col(c).rlike(flags + p).cast("int") for p in patterns])


def has_financial_sign(c) -> Column:
    """Any of the financial patterns; magnitudes and kinds of result are looked for as plain substrings of the lower-case
    text, which is what their patterns amount to."""
    c = _col(c)
    words = reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(w)) for p in rules.FINANCIAL if p.startswith("(?i)(") for w in p[5:-1].split("|")])
    return reduce(lambda a, b: a | b, [words, *[c.rlike("(?d)" + p) for p in rules.FINANCIAL if not p.startswith("(?i)(")]])


def has_gibberish(c) -> Column:
    """Any of the gibberish patterns, each behind a plain substring that it cannot do without."""
    needs = ("@", "****", "____", "HHHH", "ZZZZ", None, "XXX")
    c = _col(c)
    return reduce(lambda a, b: a | b, [c.rlike(p) if n is None else c.contains(n) & c.rlike(p) if n == "@" else c.contains(n) for p, n in zip(rules.GIBBERISH, needs)])


def is_good_chunk(
    c, min_length: int = rules.MIN_CHUNK_LENGTH, min_letters: float = rules.MIN_LETTER_RATIO, max_symbols: float = rules.MAX_SYMBOL_RATIO, max_labels: int = rules.MAX_HEADER_LABELS, max_urls: int = rules.MAX_URLS
) -> Column:
    """True for the chunks that stay; null text counts as empty. Cheap tests come first: Spark evaluates AND/OR lazily."""

    def good(c, letters):
        fin = has_financial_sign(c)
        return (
            (F.length(strip(c)) >= min_length)
            & ~((letters < min_letters) & (~fin | c.rlike(rules.XBRL_URL)))
            & ~((letters < 0.4) & ~fin)
            & ~((symbol_ratio(c) > max_symbols) & ~fin)
            & ~(has_gibberish(c) & ~fin)
            & ~(c.contains(":") & c.rlike(ANY_LABEL) & (count_matching(c, rules.HEADER_LABELS, "(?id)") > max_labels))
            & ~((letters < 0.5) & (F.regexp_count(c, F.lit("https?://")) > max_urls))
        )

    return let(F.coalesce(_col(c), F.lit("")), lambda x: let(letter_ratio(x), lambda r: good(x, r)))


def word_set(c) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(_col(c)), rf"[{rules.SPACE}]+"), lambda x: x != ""))


def drop_image_lines(c) -> Column:
    """Lines that only point to an image removed, ends stripped, empty becomes null."""
    line = rf"(?i)^[{rules.SPACE}]*Image:"
    kept = F.when(_col(c).rlike("(?i)image:"), _join(F.filter(_lines(_col(c)), lambda x: ~x.rlike(line)))).otherwise(_col(c))
    return F.nullif(strip(kept), F.lit(""))


def mime_type(suffix) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in rules.MIME_TYPES for x in kv]), F.lower(_col(suffix)))


def clean_title(c, lower: bool = True) -> Column:
    """Dashes to blanks, runs of blanks to one, signs at the end off."""
    t = F.regexp_replace(_col(c), "[-–—]", " ")
    t = F.regexp_replace(normalize_ws(t), rf"[.,:;{rules.SPACE}]+$", "")
    return F.lower(t) if lower else t


def source_tags(answer) -> Column:
    """array<struct<ticker, year, chunk_id, content>> of the citation tags of an answer."""
    tags = F.regexp_extract_all(_col(answer), F.lit(r"(?i)(<source\s+[^>]+>[^<]+</source>)"), F.lit(1))

    def one(t):
        attr = lambda k: F.nullif(F.regexp_extract(t, rf'(?i)\b{k}="([^"]+)"', 1), F.lit(""))
        return F.struct(attr("ticker").alias("ticker"), attr("year").alias("year"), attr("chunk_id").alias("chunk_id"), F.regexp_extract(t, r"(?i)<source\s+[^>]+>([^<]+)</source>", 1).alias("content"))

    return F.transform(tags, one)
