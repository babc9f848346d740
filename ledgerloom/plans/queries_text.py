"""Queries over text, quality, chunk and section operators, with their SQL."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import rules, text as T
from ledgerloom.operators import chunking, sections
from ledgerloom.plans import pipelines
from ledgerloom.runtime import spread, table

S = rules.SPACE
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _any(patterns, col: str = "t", flags: str = "") -> str:
    return "(" + " or ".join(f"regexp_matches({col}, '{flags}{p.replace(chr(39), chr(39) * 2)}')" for p in patterns) + ")"


def _count(patterns, col: str = "t", flags: str = "(?i)") -> str:
    return "(" + " + ".join(f"cast(regexp_matches({col}, '{flags}{p}') as int)" for p in patterns) + ")"


def _n(pattern: str, col: str = "t") -> str:
    return f"len(regexp_extract_all({col}, '{pattern}'))"


def _strip(col: str) -> str:
    return f"regexp_replace({col}, '^[{S}]+|[{S}]+$', '', 'g')"


FIN = _any(rules.FINANCIAL)
LETTERS = f"({_n('[a-zA-Z]')} / greatest(length(t), 1))"
SYMBOLS = f"({_n(f'[^0-9A-Za-z{S}]')} / greatest(length(t), 1))"
GOOD = f"""(length({_strip('t')}) >= 50
 and not ({LETTERS} < 0.3 and (not {FIN} or regexp_matches(t, '{rules.XBRL_URL}')))
 and not ({SYMBOLS} > 0.35 and not {FIN}) and not ({LETTERS} < 0.4 and not {FIN})
 and not ({_any(rules.GIBBERISH)} and not {FIN}) and {_count(rules.HEADER_LABELS)} <= 2
 and not ({_n('https?://')} > 3 and {LETTERS} < 0.5))"""


@query(f"select chunk_uid, {GOOD} as keep from (select chunk_uid, coalesce(text, '') as t from sec_chunks)")
def quality_filter(spark: SparkSession, d: str) -> DataFrame:
    """FLT1, SC11, SC12, AG9: keep or drop each chunk."""
    return spread(table(spark, d, "sec_chunks").select("chunk_uid", "text")).select("chunk_uid", T.is_good_chunk("text").alias("keep"))


@query(f"select section, count(*) as n, sum(cast({GOOD} as int)) as kept from (select section, coalesce(text, '') as t from sec_chunks) group by section")
def quality_by_section(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "sec_chunks").select("section", "text")).groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.sum(T.is_good_chunk("text").cast("int")).alias("kept"))


@query(f"select doc_id, round({LETTERS}, 6) as letters, round({SYMBOLS}, 6) as symbols, strlen(t) as n_bytes, {FIN} as financial from (select doc_id, text as t from documents) where t is not null")
def char_ratios(spark: SparkSession, d: str) -> DataFrame:
    """SC10, SC11, SC12."""
    t = F.col("text")
    return spread(table(spark, d, "documents").filter("text is not null").select("doc_id", "text")).select("doc_id", F.round(T.letter_ratio(t), 6).alias("letters"), F.round(T.symbol_ratio(t), 6).alias("symbols"), T.byte_length(t).cast("bigint").alias("n_bytes"), T.has_financial_sign(t).alias("financial"))


@query(f"select doc_id, len(s) as n_sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) as longest from (select doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[{S}]+', '\\1' || chr(57344), 'g'), chr(57344)), lambda x: {_strip('x')} <> '') as s from documents where text is not null)")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    """SC8."""
    s = spread(table(spark, d, "documents").filter("text is not null").select("doc_id", "text")).select("doc_id", T.sentences("text").alias("s"))
    return s.select("doc_id", F.size("s").cast("bigint").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).cast("bigint").alias("longest"))


@query("select doc_id, len(regexp_extract_all(text, '\\p{L}+|\\p{N}+|[^\\s\\p{L}\\p{N}]+')) as n_tokens from documents where text is not null")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    """SC9 with the stand-in counter, over whole documents: the cap of SC9 is one of sentences."""
    return table(spark, d, "documents").filter("text is not null").select("doc_id", T.token_count("text", cap=None).cast("bigint").alias("n_tokens"))


@query(f"select doc_id, md5(trim(regexp_replace(text, '[{S}]+', ' ', 'g'))) as h from documents where text is not null")
def normalize_whitespace(spark: SparkSession, d: str) -> DataFrame:
    """SC6."""
    return spread(table(spark, d, "documents").filter("text is not null").select("doc_id", "text")).select("doc_id", F.md5(T.normalize_ws("text")).alias("h"))


@query("select table_uid, md5(regexp_replace(html, '<[^>]+>', '', 'g')) as h from sec_tables where html is not null")
def strip_html_tags(spark: SparkSession, d: str) -> DataFrame:
    """SC2."""
    return spread(table(spark, d, "sec_tables").filter("html is not null").select("table_uid", "html")).select("table_uid", F.md5(T.strip_tags("html")).alias("h"))


def _sql(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _decoded(src: str, key: str, col: str) -> str:
    """CTEs that end in ``decoded`` (key, t): a text is cut at its ampersands, each part begins with what may be a reference. The
    names come from the standard library's table of HTML 5."""
    named = ", ".join(f"({_sql(n)}, {_sql(v)})" for n, v in html5.items())
    old = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
    moved = " ".join(f"when {b} then {_sql(bytes([b]).decode('cp1252'))}" for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
    number = "case when num[2] in ('x', 'X') then try_cast('0x' || regexp_replace(num[3:], ';$', '') as bigint) else try_cast(regexp_replace(num[2:], ';$', '') as bigint) end"
    sign = f"""case c {moved} when 0 then chr(65533) else case when c is null or c > 1114111 or c between 55296 and 57343 then chr(65533)
      when c between 1 and 8 or c = 11 or c between 14 and 31 or c between 127 and 159 or c between 64976 and 65007 or c % 65536 in (65534, 65535) then '' else chr(cast(c as int)) end end"""
    return f"""names as (select * from (values {named}) n(name, value)),
parts as (select {key}, unnest(string_split({col}, '&')) as p, unnest(range(len(string_split({col}, '&')))) as i from {src} where {col} is not null),
tokens as (select *, regexp_extract(p, '^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?)') as num, regexp_extract(p, '^[^\\t\\n\\f <&#;]{{1,32}};') as name, regexp_extract(p, '^(?:{old})') as old from parts),
valued as (select t.{key}, t.i, t.p, t.num, t.name, t.old, n.value, o.value as old_value, {number} as c from tokens t left join names n on n.name = t.name left join names o on o.name = t.old),
decoded as (select {key}, string_agg(case when i = 0 then p when num <> '' then {sign} || p[length(num) + 1 :] when value is not null then value || p[length(name) + 1 :] when old <> '' then old_value || p[length(old) + 1 :] else '&' || p end, '' order by i) as t from valued group by {key})"""


@query(f"with {_decoded('sec_tables', 'table_uid', 'html')} select table_uid, t as decoded from decoded")
def decode_html_entities(spark: SparkSession, d: str) -> DataFrame:
    """SC1 with the full table of names."""
    return table(spark, d, "sec_tables").filter("html is not null").select("table_uid", T.decode_entities("html").alias("decoded"))


_XB = "html"
for _p in rules.XBRL_SPANS:
    _XB = f"regexp_replace({_XB}, '(?is){_p}', '', 'g')"
_XB = rf"regexp_replace({_XB}, '<[^>]+\s+[^>]+>', '', 'g')"
_XBL = f"array_to_string(list_filter(string_split({_XB}, chr(10)), lambda x: not (length(x) > 200 and (contains(x, 'http://') or contains(x, 'https://') or contains(lower(x), 'xbrl') or contains(lower(x), 'us-gaap') or regexp_matches(x, '[a-z]+:[A-Z][a-zA-Z]+')))), chr(10))"


@query(
    f"select table_uid, md5({_XBL}) as h from sec_tables where html is not null"
)
def remove_xbrl(spark: SparkSession, d: str) -> DataFrame:
    """SC3."""
    return spread(table(spark, d, "sec_tables").filter("html is not null").select("table_uid", "html")).select("table_uid", F.md5(T.remove_xbrl("html")).alias("h"))


@query(rf"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as x, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents where text is not null),
c as (select *, regexp_matches({_strip('x')}, '^[A-Za-z0-9+/=]{{60,}}$') as code from l),
g as (select *, i - row_number() over (partition by doc_id, code order by i) as run from c),
n as (select *, count(*) over (partition by doc_id, code, run) as len from g),
k as (select doc_id, md5(string_agg(x, chr(10) order by i)) as h from n where not (code and len >= 3) group by doc_id)
select d.doc_id, coalesce(k.h, md5('')) as h from documents d left join k using (doc_id) where text is not null""")
def drop_line_runs(spark: SparkSession, d: str) -> DataFrame:
    """WN4, AG7: runs of encoded lines."""
    return spread(table(spark, d, "documents").filter("text is not null").select("doc_id", "text")).select("doc_id", F.md5(T.remove_encoded_runs("text")).alias("h"))


_HL = "text"
for _p in rules.HEADER_LABELS:
    _HL = f"regexp_replace({_HL}, '(?i){_p}', '', 'g')"
_HB = f"({_any(rules.HEADER_LABELS, _strip('x'), '(?i)')} or (regexp_matches({_strip('x')}, '^[\\p{{Nd}}{S}:-]+$') and length({_strip('x')}) > 10))"


@query(f"select chunk_uid, md5(array_to_string(list_filter(string_split({_HL}, chr(10)), lambda x: not {_HB}), chr(10))) as h from sec_chunks where text is not null")
def remove_headers(spark: SparkSession, d: str) -> DataFrame:
    """SC4."""
    return spread(table(spark, d, "sec_chunks").filter("text is not null").select("chunk_uid", "text")).select("chunk_uid", F.md5(T.remove_header_labels("text")).alias("h"))


_BP = "text"
for _p in rules.BOILERPLATE:
    _BP = f"regexp_replace({_BP}, '(?is){_p}', '', 'g')"


@query(f"select section_uid, md5({_BP}) as h from sec_sections where text is not null")
def remove_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    """SC5."""
    return spread(table(spark, d, "sec_sections").filter("text is not null").select("section_uid", "text")).select("section_uid", F.md5(T.remove_boilerplate("text")).alias("h"))


def _marks(marks, x: str = "x") -> str:
    return "(" + " or ".join("contains(%s, '%s')" % (x, m.replace("'", "''")) for m in marks) + ")"


@query(f"""
with l as (select doc_id, text, string_split(text, chr(10)) as ls, list_transform(string_split(text, chr(10)), lambda x: upper({_strip('x')})) as us from documents where text is not null),
p as (select *, coalesce(list_position(list_transform(us, lambda x: {_marks(rules.CONTENT_STARTS)}), true), 0) - 1 as s,
  coalesce(list_position(list_reverse(list_transform(us, lambda x: {_marks(rules.CONTENT_ENDS)})), true), 0) as r from l),
q as (select *, case when r > 0 then len(ls) - r else len(ls) end as e from p)
select doc_id, md5(case when s > 0 and s < e then array_to_string(ls[s + 1 : e], chr(10)) else text end) as h from q""")
def main_content(spark: SparkSession, d: str) -> DataFrame:
    """WN12."""
    return spread(table(spark, d, "documents").filter("text is not null").select("doc_id", "text")).select("doc_id", F.md5(T.main_content("text")).alias("h"))


@query(rf"""
with {_decoded('documents', 'doc_id', 'text')},
a as (select doc_id, regexp_replace(t, '<[^>]+>', '', 'g') as html from decoded),
b as (select doc_id, {_XBL} as text from a),
l as (select doc_id, unnest(string_split(text, chr(10))) as x, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from b),
c as (select *, regexp_matches({_strip('x')}, '^[A-Za-z0-9+/=]{{60,}}$') as code from l),
g as (select *, i - row_number() over (partition by doc_id, code order by i) as run from c),
n as (select *, count(*) over (partition by doc_id, code, run) as len from g),
k as (select doc_id, string_agg(x, chr(10) order by i) as kept from n where not (code and len >= 3) group by doc_id),
r as (select b.doc_id, coalesce(k.kept, '') as text from b left join k using (doc_id)),
h as (select doc_id, array_to_string(list_filter(string_split({_HL}, chr(10)), lambda x: not {_HB}), chr(10)) as text from r),
u as (select doc_id, text, string_split(text, chr(10)) as ls, list_transform(string_split(text, chr(10)), lambda x: upper({_strip('x')})) as us from h),
p as (select *, coalesce(list_position(list_transform(us, lambda x: {_marks(rules.CONTENT_STARTS)}), true), 0) - 1 as s, coalesce(list_position(list_reverse(list_transform(us, lambda x: {_marks(rules.CONTENT_ENDS)})), true), 0) as r from u),
q as (select *, case when r > 0 then len(ls) - r else len(ls) end as e from p),
m as (select doc_id, case when s > 0 and s < e then array_to_string(ls[s + 1 : e], chr(10)) else text end as text from q),
z as (select doc_id, trim(regexp_replace({_BP}, '[{S}]+', ' ', 'g')) as clean from m)
select d.doc_id, z.clean from documents d left join z using (doc_id)""")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    """SC7: all steps in order."""
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", T.clean_text("text").alias("clean"))


@query(f"select chunk_id, nullif({_strip('''array_to_string(list_filter(string_split(text, chr(10)), lambda x: not regexp_matches(x, '(?i)^[''' + S + ''']*Image:')), chr(10))''')}, '') as body from tsla_2023_unified_chunks")
def drop_image_lines(spark: SparkSession, d: str) -> DataFrame:
    """SC13."""
    return table(spark, d, "tsla_2023_unified_chunks").select("chunk_id", T.drop_image_lines("text").alias("body"))


@query(f"select chunk_uid, len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[{S}]+'), lambda x: x <> ''))) as n from sec_chunks where text is not null")
def word_sets(spark: SparkSession, d: str) -> DataFrame:
    """SC14."""
    return table(spark, d, "sec_chunks").filter("text is not null").select("chunk_uid", F.size(T.word_set("text")).cast("bigint").alias("n"))


@query()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """WN2, WN3, FLT7, PRJ8: overlapping chunks under the byte limit."""
    return chunking.chunk_documents(spread(table(spark, d, "documents").filter("text is not null")), "doc_id", "text", metadata=("ticker", "filing_type", "accession_number", "year"))


@query(f"select cast(doc_id as varchar) as doc_id, true as within_bytes, true as within_tokens from documents where text is not null and length({_strip('text')}) >= 50")
def chunk_limits(spark: SparkSession, d: str) -> DataFrame:
    """WN2, WN3: what holds for the chunks of every document: no more bytes than allowed unless it is one word, no more tokens
    unless it is one sentence."""
    c = chunking.chunk_documents(spread(table(spark, d, "documents").filter("text is not null")), "doc_id", "text", keep_bad=True)
    one_word, one_sentence = ~F.col("text").rlike(rf"[^{S}][{S}]+[^{S}]"), F.size(T.sentences("text")) == 1
    bytes_ok, tokens_ok = (T.byte_length("text") <= rules.MAX_CHUNK_BYTES) | one_word, (F.col("end_token") <= rules.CHUNK_TOKENS) | one_sentence
    return c.groupBy("doc_id").agg(F.bool_and(bytes_ok).alias("within_bytes"), F.bool_and(tokens_ok).alias("within_tokens"))


@query(rf"""
with a as (select section_uid, regexp_replace(text, '(?i)(item\s+(?:1a|1b|7a|7|8|9|15))', chr(57344) || '\1', 'g') as t from sec_sections where text is not null),
b as (select section_uid, unnest(string_split(t, chr(57344))) as block, unnest(range(0, len(string_split(t, chr(57344))))) as ord from a),
c as (select section_uid, ord, upper(regexp_extract(block, '(?i)^(item\s+(?:1a|1b|7a|7|8|9|15))', 1)) as item, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(block, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&#160;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&mdash;', '—'), '&ndash;', '–'), '&amp;', '&'), '[{S}]+', ' ', 'g')) as text from b)
select section_uid, dense_rank() over (partition by section_uid order by ord) as nr, item, md5(text) as h from c where item <> '' and text <> ''""")
def item_blocks(spark: SparkSession, d: str) -> DataFrame:
    """WN10, SC24: blocks between item labels."""
    b = sections.item_blocks(table(spark, d, "sec_sections").filter("text is not null"), "section_uid", "text")
    w = Window.partitionBy("section_uid").orderBy("ord")
    return b.select("section_uid", F.dense_rank().over(w).cast("bigint").alias("nr"), "item", F.md5("text").alias("h"))


@query()
def html_tables(spark: SparkSession, d: str) -> DataFrame:
    """SC25, JN9: tables of the HTML column with the nearest heading before them."""
    return sections.html_tables(table(spark, d, "sec_tables"), "table_uid", "html").drop("html")


@query("select table_uid, coalesce(len(regexp_extract_all(html, '(?i)<table\\b')), 0) as n_tables, coalesce(len(regexp_extract_all(html, '(?i)<h[1-6]\\b')), 0) as n_headings from sec_tables")
def html_structure(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("html")
    return table(spark, d, "sec_tables").select("table_uid", F.coalesce(F.regexp_count(h, F.lit(r"(?i)<table\b")), F.lit(0)).cast("bigint").alias("n_tables"), F.coalesce(F.regexp_count(h, F.lit(r"(?i)<h[1-6]\b")), F.lit(0)).cast("bigint").alias("n_headings"))


def _case(names) -> str:
    known = {n: p.replace("'", "''") for n, _, p in rules.SECTIONS}
    risk = "((contains(lower(title), '1a') or contains(lower(title), 'risk factors')) and not contains(lower(title), 'summary'))"
    return "case " + " ".join(f"when {risk if n == 'RISK_FACTORS' else f'regexp_matches(k, {chr(39)}{known[n]}{chr(39)})'} then '{n}'" for n in names) + " end"


_TITLED = "case matched " + " ".join(f"when '{n}' then '{t}'" for n, t, _ in rules.SECTIONS) + " end"


def _title(col: str) -> str:
    blanks = f"trim(regexp_replace(regexp_replace({col}, '[-–—]', ' ', 'g'), '[{S}]+', ' ', 'g'))"
    return f"lower(regexp_replace({blanks}, '[.,:;{S}]+$', ''))"



@query(f"""
with t as (select chunk_uid, replace(lower(section), '_', ' ') as title, filing_type as form from sec_chunks where section is not null and filing_type in ('10-K', '10-K/A', '10-Q', '10-Q/A')),
c as (select *, {_title(f"regexp_replace(regexp_replace(title, '{rules.ITEM_TITLE}', '', 'g'), '^[{S}]+|[{S}]+$', '', 'g')")} as k from t)
select *, {_TITLED} as matched_title from (select chunk_uid, case when starts_with(form, '10-K') then {_case(rules.SECTIONS_10K)} else {_case(rules.SECTIONS_10Q)} end as matched from c)""")
def match_sections(spark: SparkSession, d: str) -> DataFrame:
    """SC19-SC23: section names turned into titles and matched by the catalog."""
    c = table(spark, d, "sec_chunks").filter(F.col("section").isNotNull() & F.col("filing_type").isin(*rules.REPORT_FORMS))
    t = c.select("chunk_uid", F.replace(F.lower("section"), F.lit("_"), F.lit(" ")).alias("title"), F.col("filing_type").alias("form"))
    return sections.match_sections(t, "title", "form").select("chunk_uid", F.col("section").alias("matched"), F.col("section_title").alias("matched_title"))


@query("select form, count(*) as n, min(ord) as first, max(ord) as last from (values " + ", ".join(f"('{f}', {i})" for f, ns in (("10-K", rules.SECTIONS_10K), ("10-Q", rules.SECTIONS_10Q), ("S-1", rules.SECTIONS_S1)) for i in range(len(ns))) + ") t(form, ord) group by form")
def section_catalog(spark: SparkSession, d: str) -> DataFrame:
    """SC20, SC23, SC34."""
    return sections.section_catalog(spark).groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"), F.max("ord").alias("last"))


_POS = """
pos as (select cast(trunc(page / 10.0) as int) as doc_id, chunk_id, is_title, row_number() over (partition by cast(trunc(page / 10.0) as int) order by chunk_id) as pos
  from (select chunk_id, max(page) as page, bool_or(coalesce(type = 'Section header', false)) as is_title from tsla_2023_unified_chunks where page is not null and text is not null group by chunk_id)),
t as (select * from pos where is_title)"""


@query(f"""
with {_POS},
n as (select *, count(*) over (partition by doc_id order by pos range between 6 preceding and 6 following) >= 5 as core from t),
b as (select *, max(case when core then pos end) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding) as prv,
  min(case when core then pos end) over (partition by doc_id order by pos rows between 1 following and unbounded following) as nxt from n),
c as (select *, sum(cast(core and (prv is null or pos - prv > 6) as int)) over (partition by doc_id order by pos) - 1 as cid from b)
select chunk_id, cast(case when core then cid when pos - prv <= 6 then cid when nxt - pos <= 6 then cid + 1 else -1 end as int) as cluster from c""")
def title_clusters(spark: SparkSession, d: str) -> DataFrame:
    """AG13."""
    t = table(spark, d, "tsla_2023_unified_chunks").filter("page is not null and text is not null").groupBy("chunk_id").agg(F.max("page").alias("page"), F.max(F.coalesce(F.col("type") == "Section header", F.lit(False))).alias("is_title"))
    t = t.withColumn("doc_id", (F.col("page") / 10).cast("int"))
    t = t.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_id")))
    return sections.title_clusters(t.filter("is_title")).select("chunk_id", "cluster")


@query(f"""
with t as (select doc_id, chunk_uid, {_title('section_title')} as title from sec_chunks where section_title is not null)
select doc_id, title, min(chunk_uid) as first_pos, max(chunk_uid) as second_pos from t where contains(title, 'risk') group by doc_id, title having count(*) = 2""")
def duplicate_titles(spark: SparkSession, d: str) -> DataFrame:
    """AG12."""
    c = table(spark, d, "sec_chunks").filter("section_title is not null")
    return sections.duplicate_titles(c, "doc_id", "chunk_uid", "section_title", "risk")


@query(f"""
with b as (select doc_id, section, chunk_uid, {_strip('text')} as t from sec_chunks where text is not null and section is not null)
select doc_id, section, md5(string_agg(t, chr(10) || chr(10) order by chunk_uid)) as h, count(*) as n_blocks from b where t <> '' group by doc_id, section""")
def join_section_text(spark: SparkSession, d: str) -> DataFrame:
    """AG6: the text blocks of a section of a filing in order."""
    c = table(spark, d, "sec_chunks").filter("text is not null and section is not null")
    return sections.join_blocks(c, ["doc_id", "section"], "chunk_uid", "text").select("doc_id", "section", F.md5("text").alias("h"), "n_blocks")


@query("""
with e as (select chunk_uid as pos, doc_id, section_title, section, chunk_uid % 3 as k from sec_chunks),
c as (select *, max(case when section_title is not null then pos end) over (partition by doc_id order by pos) as at from e where doc_id is not null)
select c.pos, a.section, a.section_title from c left join e a on a.doc_id = c.doc_id and a.pos = c.at where c.section_title is null""")
def carry_section(spark: SparkSession, d: str) -> DataFrame:
    """WN9: chunks without a title take the title before them in the filing."""
    c = table(spark, d, "sec_chunks").filter("doc_id is not null")
    e = c.select("doc_id", F.col("chunk_uid").alias("pos"), F.when(F.col("section_title").isNotNull(), "title").otherwise("table").alias("kind"), F.coalesce("section_title", F.lit("")).alias("text"), "section")
    return sections.carry_section(e).select("pos", "section", "section_title")


_ELEMENTS = (
    ("a", "10-K", ("title|Table of Contents", "text|Part I", "title|Item 1. Business", "title|Item 1A. Risk Factors", "title|Item 2. Properties", "title|Index", "text|Part II", "title|Item 7.", "title|Part I", "title|Item 1. Business", "narrative|We make cars.", "list|And batteries.", "title|Item 1A. Risk Factors", "narrative|Much may fail.", "title|Item 2. Properties", "narrative|A plant.")),
    ("b", "S-1", ("title|About this Prospectus", "text|SUMMARY", "text|RISK FACTORS", "text|x", "title|About this prospectus", "title|RISK FACTORS", "narrative|Young firm.", "title|USE OF PROCEEDS", "narrative|To grow.")),
    ("c", "10-Q", ("title|Item 1A. Risk Factors", "title|Item 2. Other", "title|Item 1A. Risk Factors", "narrative|Rates may rise.", "list|Fast.", "title|Item 5.", "narrative|None.")),
)


def elements(spark: SparkSession) -> DataFrame:
    rows = [(doc, form, i, *e.split("|", 1)) for doc, form, es in _ELEMENTS for i, e in enumerate(es)]
    return spark.createDataFrame(rows, "doc_id string, form string, pos int, kind string, text string").withColumn("is_title", F.col("kind") == "title")


_OUTLINE = f"""
f as (select *, min(filing_type) filter (filing_type in ('10-K', '10-Q', '10-K/A', '10-Q/A')) over (partition by doc_id) as form from sec_chunks where doc_id is not null and section is not null and text is not null),
e as (select doc_id, form, section, 'Item 1. ' || replace(lower(section), '_', ' ') as title, dense_rank() over (partition by doc_id order by section) as rs, row_number() over (partition by doc_id order by section, chunk_uid) as rc from f where form is not null),
m as (select *, max(rs) over (partition by doc_id) as n from e),
b as (select doc_id, section, title, rs, cast(n + 2 + rc + rs as int) as pos from m),
hd as (select doc_id, section, any_value(title) as title, any_value(rs) as rs, min(pos) - 1 as pos from b group by doc_id, section)"""


def _outlines(spark: SparkSession, d: str) -> DataFrame:
    """Elements of every filing as its chunks make it: a table of contents between two "Part I", then each section's title and
    chunks. doc_id, form, pos, kind, text, is_title."""
    c = table(spark, d, "sec_chunks").filter("doc_id is not null and section is not null and text is not null")
    form = F.min(F.when(F.col("filing_type").isin(*rules.REPORT_FORMS), F.col("filing_type"))).over(Window.partitionBy("doc_id"))
    by = Window.partitionBy("doc_id").orderBy("section")
    e = c.withColumn("form", form).filter("form is not null").withColumn("rs", F.dense_rank().over(by)).withColumn("rc", F.row_number().over(by.orderBy("section", "chunk_uid")))
    e = e.withColumn("n", F.max("rs").over(Window.partitionBy("doc_id"))).withColumn("pos", F.col("n") + 2 + F.col("rc") + F.col("rs"))
    title = F.concat(F.lit("Item 1. "), F.replace(F.lower("section"), F.lit("_"), F.lit(" ")))
    heads = e.groupBy("doc_id", "form", "section", "rs").agg(F.min("pos").alias("at")).withColumn("text", title)
    docs = e.groupBy("doc_id", "form").agg(F.max("n").alias("n"))
    row = lambda pos, kind, text: F.struct(pos.cast("int").alias("pos"), F.lit(kind).alias("kind"), text.alias("text"))
    parts = F.array(row(F.lit(0), "text", F.lit("Part I")), row(F.col("n") + 1, "text", F.lit("x")), row(F.col("n") + 2, "text", F.lit("Part I")))
    out = docs.select("doc_id", "form", F.inline(parts))
    out = out.unionByName(heads.select("doc_id", "form", F.inline(F.array(row(F.col("rs"), "title", F.col("text")), row(F.col("at") - 1, "title", F.col("text"))))))
    out = out.unionByName(e.select("doc_id", "form", F.col("pos").cast("int").alias("pos"), F.lit("narrative").alias("kind"), "text"))
    return out.withColumn("is_title", F.col("kind") == "title")


@query(f"with {_OUTLINE} select doc_id, cast(unnest(range(0, n + 1)) as int) as pos from (select doc_id, max(rs) as n from hd group by doc_id)")
def toc_slice(spark: SparkSession, d: str) -> DataFrame:
    """WN8 over every filing."""
    return sections.toc_slice(_outlines(spark, d)).select("doc_id", "pos")


@query(f"""with {_OUTLINE}, risk as (select doc_id, min(section) as section from b where (contains(lower(title), '1a') or contains(lower(title), 'risk factors')) and not contains(lower(title), 'summary') group by doc_id)
select b.doc_id, b.pos from b join risk using (doc_id, section)""")
def narrative_without_toc(spark: SparkSession, d: str) -> DataFrame:
    """WN7 over every filing."""
    return sections.narrative_without_toc(_outlines(spark, d), sections.is_risk_title(F.col("text"), F.col("form"))).select("doc_id", "pos")


@query(f"with {_OUTLINE} select a.doc_id, cast(a.rs as int) as toc_pos, max(o.pos) as start_pos from hd a join hd o on o.doc_id = a.doc_id and starts_with(o.title, a.title) group by a.doc_id, a.rs")
def heading_positions(spark: SparkSession, d: str) -> DataFrame:
    """JN8 over every filing."""
    e = _outlines(spark, d)
    toc = sections.toc_slice(e).filter("kind = 'title'").select("doc_id", F.col("pos").alias("toc_pos"), F.col("text").alias("toc_text"))
    return sections.heading_positions(e, toc).select("doc_id", "toc_pos", "start_pos")


@query(f"with {_OUTLINE} select doc_id, pos from b")
def narrative_between(spark: SparkSession, d: str) -> DataFrame:
    """WN11 over every filing: between each title and the next, the last without a known end."""
    e = _outlines(spark, d)
    h = e.join(sections.toc_slice(e).select("doc_id", "pos"), ["doc_id", "pos"], "left_anti").filter("is_title")
    bounds = h.select("doc_id", F.col("pos").alias("start_pos"), F.lead("pos").over(Window.partitionBy("doc_id").orderBy("pos")).alias("end_pos"))
    return sections.narrative_between(e, bounds).select("doc_id", "pos")


@query("""
select accession_number, case when filing_type is null or filing_type = '' then 'Filing type is empty.' when filing_type not in ('10-K', '10-Q', 'S-1', '10-K/A', '10-Q/A', 'S-1/A') then 'Unexpected filing type: ' || filing_type end as reason
from filings where filing_type is null or filing_type not in ('10-K', '10-Q', 'S-1', '10-K/A', '10-Q/A', 'S-1/A')""")
def rejected_forms(spark: SparkSession, d: str) -> DataFrame:
    """FLT8."""
    return sections.split_by_validity(table(spark, d, "filings"), "filing_type")[1].select("accession_number", "reason")


def _raw_filings(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, form, raw_text: a submission written from the chunks of every filing, each section under an item title, each
    chunk a paragraph."""
    c = table(spark, d, "sec_chunks").filter("doc_id is not null and section is not null and text is not null")
    form = F.min(F.when(F.col("filing_type").isin(*rules.REPORT_FORMS), F.col("filing_type"))).over(Window.partitionBy("doc_id"))
    c = c.withColumn("form", form).filter("form is not null")
    body = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    c = c.withColumn("p", F.concat(F.lit("<p>"), body, F.lit("</p>")))
    parts = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(x, "p"))), lambda e: e["p"]), "\n")
    per = c.groupBy("doc_id", "form", "section").agg(parts("chunk_uid").alias("p"))
    per = per.withColumn("p", F.concat(F.lit("<h2>Item 1. "), F.replace(F.lower("section"), F.lit("_"), F.lit(" ")), F.lit("</h2>\n"), "p"))
    return per.groupBy("doc_id", "form").agg(parts("section").alias("body")).select("doc_id", "form", F.concat(F.lit("<type>"), "form", F.lit("\n<html><body>"), "body", F.lit("</body></html>")).alias("raw_text"))


_N_WORDS = "(length(t) - length(replace(t, ' ', '')) + 1)"


@query(f"""
with f as (select *, min(filing_type) filter (filing_type in ('10-K', '10-Q', '10-K/A', '10-Q/A')) over (partition by doc_id) as form from sec_chunks where doc_id is not null and section is not null and text is not null),
t as (select doc_id, chunk_uid, form, section as name, replace(lower(section), '_', ' ') as title, trim(regexp_replace(text, '[{S}]+', ' ', 'g')) as t from f where form is not null),
k as (select *, {_title(f"regexp_replace(regexp_replace('item 1. ' || title, '{rules.ITEM_TITLE}', '', 'g'), '^[{S}]+|[{S}]+$', '', 'g')")} as k from t),
m as (select *, case when starts_with(form, '10-K') then {_case(rules.SECTIONS_10K)} else {_case(rules.SECTIONS_10Q)} end as matched from k),
n as (select * from m where matched is not null and t <> '' and ({_N_WORDS} >= 15 or {_N_WORDS} >= 8 and right(t, 1) in ('.', '!', '?'))),
w as (select *, min(name) over (partition by doc_id, matched) as first from n)
select doc_id, matched as section, {_TITLED} as section_title, count(*) as n_blocks, md5(string_agg(t, chr(10) || chr(10) order by chunk_uid)) as h from w where name = first group by doc_id, matched""")
def filing_sections(spark: SparkSession, d: str) -> DataFrame:
    """E1: SRC to AG6 over raw filings: elements, sections of the form's list, narrative of each."""
    return pipelines.section_texts(_raw_filings(spark, d)).select("doc_id", "section", "section_title", "n_blocks", F.md5("text").alias("h"))


@query()
def filings_to_chunks(spark: SparkSession, d: str) -> DataFrame:
    """E1 to its end: chunks of every section of every raw filing."""
    f = table(spark, d, "filings").select("doc_id", "ticker", "filing_type", "accession_number", "year")
    return pipelines.filings_to_chunks(f.join(_raw_filings(spark, d).drop("form"), "doc_id"))[0]
