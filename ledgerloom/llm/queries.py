"""The pN_ queries, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm import copies, encoding, lines, markup, mixing, neardup, neighbours, splitting, tokens
from ledgerloom.runtime import table


def _chunks(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "sec_chunks").select("chunk_uid", "text", *cols)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(_chunks(spark, d), "chunk_uid", "text").filter("piece_no = 0").select("chunk_uid")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(_chunks(spark, d), "chunk_uid", "text")


def p1_checked(spark: SparkSession, d: str) -> DataFrame:
    """What holds for the pieces of every oversized text: words covered without a hole, limits, overlap."""
    pieces = splitting.split_oversized(_chunks(spark, d), "chunk_uid", "text")
    w = Window.partitionBy("chunk_uid").orderBy("piece_no")
    p = pieces.withColumn("shared", F.lag("end_token").over(w) - F.col("start_token")).withColumn("bytes_before", F.lag("n_bytes").over(w))
    # fewer words are shared only where long words leave no room
    exact = (F.col("shared") == 80) | (F.greatest("n_bytes", "bytes_before") > 8192) | (F.col("piece_no") == 0)
    return p.groupBy("chunk_uid").agg(
        F.max("end_token").cast("bigint").alias("n_words"),
        F.bool_and((F.col("piece_no") == 0) | (F.col("shared") >= 0)).alias("no_hole"),
        F.bool_and((F.col("n_bytes") <= 16384) & (F.col("end_token") - F.col("start_token") <= 400)).alias("within"),
        F.bool_and(exact).alias("overlap"),
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = copies.copy_pairs(_chunks(spark, d, "accession_number"), "chunk_uid", "text", copies.digits_of("accession_number"))
    return pairs.select(F.col("keep_id").alias("keep_uid"), F.col("copy_id").alias("copy_uid"))


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    groups = copies.copy_groups(_chunks(spark, d, "accession_number"), "chunk_uid", "text", copies.digits_of("accession_number"))
    return groups.select(F.col("keep_id").alias("keep_uid"), "n_copies")


def _near(spark: SparkSession, d: str) -> neardup.NearDuplicates:
    return neardup.NearDuplicates(_chunks(spark, d), "chunk_uid", "text", shingle=3, threshold=0.6, min_words=40, halves=16)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).row_pairs()


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).groups().withColumnRenamed("id", "chunk_uid")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.line_blocks(_chunks(spark, d, "ticker"), "chunk_uid", "ticker", "text").select(F.col("source").alias("ticker"), "line")


def p6_blocks(spark: SparkSession, d: str) -> DataFrame:
    return lines.line_blocks(_chunks(spark, d, "ticker"), "chunk_uid", "ticker", "text").withColumnRenamed("source", "ticker")


def p6_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return lines.without_repeated_lines(_chunks(spark, d, "ticker"), "chunk_uid", "ticker", "text").withColumnRenamed("id", "chunk_uid")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_markup(table(spark, d, "sec_tables"), "table_uid", "text", marked_only=True).select("table_uid")


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_markup(table(spark, d, "sec_tables"), "table_uid", "text")


def p3_clean_html(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_markup(table(spark, d, "sec_tables"), "table_uid", "html")


def p3_checked(spark: SparkSession, d: str) -> DataFrame:
    """What must hold for every text: without markup it comes out as it was, and what comes out has none."""
    t = table(spark, d, "sec_tables").select(F.struct("table_uid", "text").alias("r"), "text")
    once = markup.clean_markup(t, "r", "text")
    n = sum(F.col(c) for c in ("n_html", "n_markdown", "n_wiki", "n_latex"))
    kept = (n > 0) | F.col("clean_text").eqNullSafe(F.col("r.text"))
    twice = markup.clean_markup(once.select(F.struct(F.col("r.table_uid").alias("table_uid"), kept.alias("plain_kept")).alias("r"), "clean_text"), "r", "clean_text")
    return twice.select("r.table_uid", "r.plain_kept", (n == 0).alias("no_residue"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "tsla_2023_unified_chunks").select("chunk_id")
    return table(spark, d, "chunk_vectors").select("chunk_id", "embedding").join(known, "chunk_id", "left_semi")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.NeighbourGraph(_vectors(spark, d), "chunk_id", "embedding", k=5).neighbours()
    return near.select(F.least("id", "neighbour").alias("chunk_a"), F.greatest("id", "neighbour").alias("chunk_b")).distinct()


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.NeighbourGraph(_vectors(spark, d), "chunk_id", "embedding", k=5).neighbours()
    return near.select(F.col("id").alias("chunk_id"), "neighbour", F.col("rank").cast("bigint").alias("rank"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: vectors of which the number formed by the id's digits is divisible by 50."""
    number = F.regexp_replace("chunk_id", r"[^0-9]+", "").try_cast("decimal(38,0)")
    return _vectors(spark, d).filter(F.coalesce(number % 50 == 0, F.lit(False)))


def p4_search(spark: SparkSession, d: str) -> DataFrame:
    graph = neighbours.NeighbourGraph(_vectors(spark, d), "chunk_id", "embedding", k=5)
    return graph.search(_asked(spark, d), "chunk_id", "embedding").select(F.col("id").alias("chunk_id"), "neighbour", F.col("rank").cast("bigint").alias("rank"))


def p4_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the graph and of the search against brute force on the stated query set."""
    graph = neighbours.NeighbourGraph(_vectors(spark, d), "chunk_id", "embedding", k=5)
    exact = neighbours.brute_force(_asked(spark, d), "chunk_id", "embedding", _vectors(spark, d), "chunk_id", "embedding").select("id", "neighbour")
    rows = [(name, exact.join(got.select("id", "neighbour"), ["id", "neighbour"], "left_semi").agg(F.count(F.lit(1)).alias("hits"))) for name, got in (("graph", graph.neighbours()), ("search", graph.search(_asked(spark, d), "chunk_id", "embedding")))]
    total = exact.agg(F.count(F.lit(1)).alias("wanted"))
    out = [r.crossJoin(total).select(F.lit(name).alias("method"), "wanted", "hits", (F.col("hits") / F.col("wanted")).alias("recall")) for name, r in rows]  # one row each
    return out[0].unionByName(out[1])


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text", "byte_bpe_50k")


def _mixture(spark: SparkSession, d: str) -> mixing.Mixture:
    return mixing.Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), "doc_id", "text", "source")


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).drawn().withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).shares()


def p8_checked(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).checked()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restore_encoding(table(spark, d, "documents"), "doc_id", "text", affected_only=True).select("doc_id")


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restore_encoding(table(spark, d, "documents"), "doc_id", "text", affected_only=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_pieces, p1_checked, p2_found, p2_counts, p3_found, p3_clean, p3_clean_html, p3_checked, p4_found, p4_neighbours, p4_search, p4_recall, p5_found, p5_groups,
        p6_found, p6_blocks, p6_cleaned, p7_ids, p8_mixture, p8_shares, p8_checked, p9_found, p9_restored,
    )
}

_P1 = r"length(regexp_extract_all(text, '[^ \t\r\n]+')) > 400 or strlen(text) > 16384"

_P2_KEYED = r"""
with base as (
  select chunk_uid, regexp_replace(accession_number, '[^\p{Nd}]', '', 'g') as acc, text,
    list_filter(regexp_split_to_array(text, '[\t\n\r;|]'), lambda x: regexp_matches(x, '[^\s\p{Z}]')) as parts
  from sec_chunks where accession_number is not null and text is not null
), keyed as (
  select chunk_uid, acc, case when len(parts) > 1 and len(list_filter(parts, lambda x: not regexp_matches(x, '[:=]'))) = 0
    then array_to_string(list_sort(list_transform(parts, lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]', '', 'g'))), '')
    else regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') end as body
  from base
), rows as (select * from keyed where body <> '')
"""

_P5 = r"""
with words as (
  select chunk_uid, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) as w from sec_chunks where text is not null
), sets as (
  select chunk_uid, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as s from words where len(w) >= 40
), each as (select chunk_uid, len(s) as n, unnest(s) as g from sets),
shared as (
  select a.chunk_uid as uid_a, b.chunk_uid as uid_b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as hits
  from each a join each b on a.g = b.g and a.chunk_uid < b.chunk_uid group by 1, 2
)
select uid_a, uid_b from shared where hits >= 0.6 * (na + nb - hits)
"""

_P6_LINES = r"""
with rows as (
  select chunk_uid, nullif(upper(regexp_replace(ticker, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), '\0') as t, text from sec_chunks where ticker is not null and text is not null
), lines as (
  select distinct chunk_uid, t, lower(trim(regexp_replace(unnest(string_split(text, chr(10))), '[ \t\r]+', ' ', 'g'))) as line from rows
), found as (select t, line from lines where line <> '' group by t, line having count(*) >= 10)
"""

_P4 = """
with v as (select chunk_id, any_value(embedding) as e from chunk_vectors where chunk_id in (select chunk_id from tsla_2023_unified_chunks) and embedding is not null and len(list_filter(embedding, lambda x: x <> 0)) > 0 group by chunk_id),
s as (select a.chunk_id as a, b.chunk_id as b, list_cosine_similarity(a.e::double[], b.e::double[]) as c from v a join v b on a.chunk_id <> b.chunk_id),
r as (select a as chunk_id, b as neighbour, row_number() over (partition by a order by c desc, b) as rank from s),
near as (select * from r where rank <= 5),
asked as (select * from near where try_cast(regexp_replace(chunk_id, '[^0-9]+', '', 'g') as hugeint) % 50 = 0)"""

ORACLE: dict[str, str] = {
    "p1_found": f"select chunk_uid from sec_chunks where {_P1}",
    "p1_checked": f"select chunk_uid, cast(length(regexp_extract_all(text, '[^ \\t\\r\\n]+')) as bigint) as n_words, true as no_hole, true as within, true as overlap from sec_chunks where {_P1}",
    "p2_found": _P2_KEYED + "select keep_uid, copy_uid from (select chunk_uid as copy_uid, min(chunk_uid) over (partition by acc, body) as keep_uid from rows) where copy_uid <> keep_uid",
    "p2_counts": _P2_KEYED + "select min(chunk_uid) as keep_uid, count(*) as n_copies from rows group by acc, body",
    "p4_found": """
with v as (select chunk_id, any_value(embedding) as e from chunk_vectors where chunk_id in (select chunk_id from tsla_2023_unified_chunks) and embedding is not null and len(list_filter(embedding, lambda x: x <> 0)) > 0 group by chunk_id),
s as (select a.chunk_id as a, b.chunk_id as b, list_cosine_similarity(a.e::double[], b.e::double[]) as c from v a join v b on a.chunk_id <> b.chunk_id),
r as (select a, b, row_number() over (partition by a order by c desc, b) as k from s)
select distinct least(a, b) as chunk_a, greatest(a, b) as chunk_b from r where k <= 5""",
    "p3_checked": "select table_uid, true as plain_kept, true as no_residue from sec_tables",
    "p4_neighbours": f"{_P4} select * from near",
    "p4_search": f"{_P4} select * from asked",  # with recall 1, as it is on the tables compared
    "p4_recall": f"{_P4} select unnest(['graph', 'search']) as method, count(*) as wanted, count(*) as hits, 1.0::double as recall from asked",
    "p5_found": _P5,
    "p5_groups": _P5.replace("\nwith ", "\nwith recursive ", 1).replace("\nselect uid_a, uid_b from shared", ", pairs as (select uid_a, uid_b from shared", 1).rstrip()
    + r"""),
links as (select uid_a as a, uid_b as b from pairs union all select uid_b, uid_a from pairs),
reach as (select distinct a, a as b from links union select r.a, l.b from reach r join links l on l.a = r.b),
bodies as (select chunk_uid, array_to_string(w, ' ') as body from words where len(w) >= 40),
others as (select l.a, count(distinct y.body) as n_links from links l join bodies x on x.chunk_uid = l.a join bodies y on y.chunk_uid = l.b where x.body <> y.body group by l.a),
copies as (select body, count(*) as n_copies from bodies group by body)
select r.a as chunk_uid, min(r.b) as group_id, any_value(coalesce(o.n_links, 0)) as n_links, any_value(c.n_copies) as n_copies
from reach r join bodies t on t.chunk_uid = r.a join copies c on c.body = t.body left join others o on o.a = r.a group by r.a""",
    "p8_checked": "select source, true as within_budget, true as filled, true as within_cap from mix_targets",
    "p6_found": _P6_LINES + "select t as ticker, line from found",
    "p6_blocks": _P6_LINES.replace("\nwith ", "\nwith recursive ", 1)
    + r"""
, lists as (select chunk_uid, t, list_filter(list_transform(string_split(text, chr(10)), lambda x: lower(trim(regexp_replace(x, '[ \t\r]+', ' ', 'g')))), lambda x: x <> '') as ls from rows where t is not null),
steps as (select distinct chunk_uid, t, ls[i] as a, ls[i + 1] as b from (select *, unnest(range(1, len(ls))) as i from lists)),
edges as (select t, a, b from steps where a <> b group by t, a, b having count(*) >= 10),
links as (select t, a, b from edges union select t, b, a from edges),
reach as (select t, line as a, line as b from found union select r.t, r.a, e.b from reach r join links e on e.t = r.t and e.a = r.b)
select f.t as ticker, f.line, n.support, p.block from found f
join (select t, line, count(*) as support from lines group by t, line) n on n.t = f.t and n.line = f.line
join (select t, a, min(b) as block from reach group by t, a) p on p.t = f.t and p.a = f.line""",
    "p6_cleaned": _P6_LINES
    + r"""
, kept as (
  select chunk_uid, i, x, f.line is null as stays
  from (select chunk_uid, t, unnest(string_split(text, chr(10))) as x, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from rows) p
  left join found f on f.t = p.t and f.line = lower(trim(regexp_replace(p.x, '[ \t\r]+', ' ', 'g')))
), joined as (
  select chunk_uid, coalesce(string_agg(x, chr(10) order by i) filter (stays), '') as text, count(*) filter (not stays) as n_removed from kept group by chunk_uid
)
select s.chunk_uid, coalesce(j.text, s.text) as text, cast(coalesce(j.n_removed, 0) as int) as n_removed from sec_chunks s left join joined j using (chunk_uid)""",
}
