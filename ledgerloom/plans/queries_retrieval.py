"""Queries over retrieval, context, detection and verification, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import rules, text as T, vectors
from ledgerloom.operators import context, detect, retrieval, verify
from ledgerloom.plans import models, pipelines
from ledgerloom.plans.queries_text import S, _count, _strip
from ledgerloom.runtime import spread, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def _vector(spark: SparkSession, d: str) -> list[float]:
    """The question's vector: the one stored under the smallest id."""
    return list(_emb(spark, d).orderBy("vec_id").select("embedding").first()[0])


Q0 = "(select embedding from embeddings order by vec_id limit 1)"
COS = "list_cosine_similarity(embedding::double[], (select embedding from q)::double[])"


@query(f"with q as {Q0} select vec_id, label, round({COS}, 5) as score from embeddings order by {COS} desc, vec_id limit 20")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """TK1, SC31, ML1 by stored vectors."""
    return retrieval.top_k(_emb(spark, d), "vec_id", "embedding", _vector(spark, d)).select("vec_id", "label", F.round("score", 5).alias("score"))


@query(f"with q as {Q0} select vec_id, label, round({COS}, 5) as score from embeddings where label = 3 order by {COS} desc, vec_id limit 20")
def dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    """TK2, FLT2, FLT3: filtered before the search."""
    return retrieval.top_k(_emb(spark, d), "vec_id", "embedding", _vector(spark, d), filters={"label": 3}).select("vec_id", "label", F.round("score", 5).alias("score"))


@query(f"with q as {Q0} select vec_id, round({COS}, 5) as cosine, round(2 * {COS} - 1, 5) as score_l2 from embeddings order by {COS} desc, vec_id limit 10")
def store_scores(spark: SparkSession, d: str) -> DataFrame:
    """TK5, Q3: the store's score from its distance."""
    t = retrieval.top_k(_emb(spark, d), "vec_id", "embedding", _vector(spark, d), 10)
    return t.select("vec_id", F.round("score", 5).alias("cosine"), F.round(vectors.score_from_l2(F.col("score")), 5).alias("score_l2"))


@query("select vec_id, round(list_sum(list_transform(embedding, lambda x: (x * 3)::double * (x * 3)::double)) , 4) as squared, round(1.0, 4) as unit from embeddings")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    """SC31 on scaled vectors."""
    e = _emb(spark, d).withColumn("v", F.transform("embedding", lambda x: (x * 3).cast("float")))
    n = vectors.l2_normalize("v")
    return e.select("vec_id", F.round(vectors.dot(F.col("v"), F.col("v")), 4).alias("squared"), F.round(vectors.norm(n), 4).alias("unit"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: vectors whose id is divisible by 50, each asking within its own label if the id is odd in hundreds."""
    return _emb(spark, d).filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))


@query("""
with s as (select q.vec_id as query_id, e.vec_id as id, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as c from embeddings q, embeddings e where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by c desc, id) as rank from s)
select query_id, id, round(c, 5) as score, rank from r where rank <= 10""")
def dense_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    """JN4, JN6: a batch of questions against all rows."""
    return retrieval.top_k_batch(_emb(spark, d), "vec_id", "embedding", _questions(spark, d), "query_id", "qv", 10).withColumn("score", F.round("score", 5)).withColumn("rank", F.col("rank").cast("bigint"))


@query("""
with s as (select q.vec_id as query_id, e.vec_id as id, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as c from embeddings q join embeddings e using (label) where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by c desc, id) as rank from s)
select query_id, id, round(c, 5) as score from r where rank <= 5""")
def dense_topk_batch_filtered(spark: SparkSession, d: str) -> DataFrame:
    q = _emb(spark, d).filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"), "label")
    return retrieval.top_k_batch(_emb(spark, d), "vec_id", "embedding", q, "query_id", "qv", 5, on=["label"]).select("query_id", "id", F.round("score", 5).alias("score"))


@query(f"""with q as {Q0}, s as (select vec_id, label, {COS} as c from embeddings), r as (select *, row_number() over (partition by label order by c desc, vec_id) as k from s)
select vec_id, label, round(c, 5) as score from r where k <= 5 order by c desc, vec_id limit 20""")
def partitioned_topk_merge(spark: SparkSession, d: str) -> DataFrame:
    """TK4."""
    per = retrieval.top_k_per_partition(_emb(spark, d), ["label"], "vec_id", "embedding", _vector(spark, d), 5)
    return retrieval.merge_partitions(per, "vec_id", 20).select("vec_id", "label", F.round("score", 5).alias("score"))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.CellIndex(_emb(spark, d), "vec_id", "embedding").search_batch(_questions(spark, d), "query_id", "qv")


_NEAREST = """
s as (select q.vec_id as query_id, e.vec_id, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as c from embeddings q, embeddings e where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by c desc, vec_id) as rank from s)"""


@query(f"with {_NEAREST} select query_id, vec_id, round(c, 5) as score, rank from r where rank <= 20")
def ivf_topk(spark: SparkSession, d: str) -> DataFrame:
    """TK3: cells and probes, for the stated query set."""
    return _cells(spark, d).select("query_id", F.col("id").alias("vec_id"), F.round("score", 5).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"with {_NEAREST} select count(*) as wanted, count(*) as hits, 1.0::double as recall from r where rank <= 20")
def ivf_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of ivf_topk against brute force on the stated query set."""
    exact = retrieval.top_k_batch(_emb(spark, d), "vec_id", "embedding", _questions(spark, d), "query_id", "qv").select("query_id", "id")
    hits = exact.join(_cells(spark, d).select("query_id", "id"), ["query_id", "id"], "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    return hits.crossJoin(exact.agg(F.count(F.lit(1)).alias("wanted"))).select("wanted", "hits", (F.col("hits") / F.col("wanted")).alias("recall"))  # one row each


@query("select case when count(*) > 10000 then 'cells' else 'exact' end as path, count(*) as n from embeddings")
def access_path(spark: SparkSession, d: str) -> DataFrame:
    n = _emb(spark, d).count()
    return spark.createDataFrame([(retrieval.plan_search(n), n)], "path string, n bigint")




def _words(col: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({col}), '[{S}]+'), lambda x: x <> ''))"


_OV = f"(len(list_intersect({_words('a')}, {_words('t')})) / greatest(len({_words('a')}), 1))"
#: Answers are whole items, sources all chunks of the same filing: pairs met by an equi-join on doc_id.
ANSWERS = """an as (select section_uid as qid, doc_id, text as a from sec_sections where text is not null and doc_id is not null),
src as (select an.qid, an.a, c.chunk_uid, coalesce(c.text, '') as t, upper(coalesce(trim(c.ticker), '')) as ticker, c.year, row_number() over (partition by an.qid order by c.chunk_uid) as rank from an join sec_chunks c using (doc_id))"""


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """qid, doc_id, a: whole texts."""
    return table(spark, d, "sec_sections").filter("text is not null and doc_id is not null").select(F.col("section_uid").alias("qid"), "doc_id", F.col("text").alias("a"))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sec_chunks").select("doc_id", "chunk_uid", F.coalesce("text", F.lit("")).alias("t"), F.upper(F.coalesce(F.trim("ticker"), F.lit(""))).alias("ticker"), "year")


@query(f"with {ANSWERS} select qid, chunk_uid, round({_OV}, 6) as overlap from src")
def word_overlap(spark: SparkSession, d: str) -> DataFrame:
    """ST3, SC14, ML2's stand-in, JN5."""
    a, c = _answers(spark, d).withColumn("a", T.word_set("a")), _sources(spark, d).select("doc_id", "chunk_uid", T.word_set("t").alias("t"))
    return a.join(c, "doc_id").select("qid", "chunk_uid", F.round(verify.overlap_of_sets(F.col("a"), F.col("t")), 6).alias("overlap"))


@query(f"with {ANSWERS}, o as (select qid, {_OV} as o from src where rank <= 5) select qid, round(avg(o), 5) as alignment from o group by qid")
def alignment(spark: SparkSession, d: str) -> DataFrame:
    """AG8, ML5's fallback: the first 5 chunks are the operator's own."""
    from pyspark.sql.window import Window

    r = _answers(spark, d).join(_sources(spark, d), "doc_id").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("chunk_uid"))).filter("rank <= 5")
    g = r.groupBy("qid").agg(F.first("a").alias("a"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]).alias("ts"))
    return g.select("qid", F.round(verify.alignment(F.col("a"), F.col("ts")), 5).alias("alignment"))


@query(f"""with {ANSWERS},
i as (select qid, any_value(a) as a, count(*) as n, sum(cast(ticker <> '' and contains(upper(a), ticker) as int) + cast(trim(ticker || ' ' || coalesce(cast(year as varchar), '')) <> '' and contains(upper(a), trim(ticker || ' ' || coalesce(cast(year as varchar), ''))) as int) + cast(year is not null and contains(upper(a), cast(year as varchar)) as int)) as cited from src group by qid)
select qid, round(least(least(cited / n, 1) + least({_count(rules.CITATION_PHRASES, 'a', '')} * 0.1, 0.3), 1), 6) as coverage from i""")
def citation_coverage(spark: SparkSession, d: str) -> DataFrame:
    """SC29: nothing is reranked here, so every chunk of the filing is a source."""
    g = _answers(spark, d).join(_sources(spark, d), "doc_id").groupBy("qid").agg(F.first("a").alias("a"), F.collect_list(F.struct("ticker", "year")).alias("s"))
    return g.select("qid", F.round(verify.citation_coverage(F.col("a"), F.col("s")), 6).alias("coverage"))


@query("""select k, round(0.4 * a + 0.3 * c + 0.3 * f, 6) as overall, list_filter([case when a < 0.5 then 'Low alignment between answer and sources' end, case when c < 0.5 then 'Few sources are cited' end, case when f < 0.7 then 'Some facts could not be verified' end], lambda x: x is not null) as issues
from (select doc_id as k, (doc_id % 11) / 10.0 as a, (doc_id % 7) / 6.0 as c, (doc_id % 5) / 4.0 as f from documents)""")
def overall_score(spark: SparkSession, d: str) -> DataFrame:
    """AG10, SC30 over a grid of scores."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("k"), (F.col("doc_id") % 11 / 10).alias("a"), (F.col("doc_id") % 7 / 6).alias("c"), (F.col("doc_id") % 5 / 4).alias("f"))
    a, c, f = F.col("a"), F.col("c"), F.col("f")
    return t.select("k", F.round(verify.overall(a, c, f), 6).alias("overall"), verify.issues(a, c, f).alias("issues"))


_REPLIES = (
    (1, 'Sure: {"claims": [{"claim": "a", "verified": true, "supporting_sources": [2, 1]}, {"claim": "b", "verified": true, "supporting_sources": [1]}, {"claim": "c", "verified": false}]} done', 2 / 3, ["y", "x"], ["c"]),
    (2, '{"claims": []}', 0.5, [], []),
    (3, "no json", 0.5, [], []),
    (4, '{"claims": [{"claim": "z {nested}", "verified": false, "supporting_sources": [9]}], "x": {"y": 1}} tail }', 0.0, [], ["z {nested}"]),
)


@query("select * from (values " + ", ".join(f"({k}, round({s!r}::double, 6), {v!r}::varchar[], {u!r}::varchar[])" for k, _, s, v, u in _REPLIES) + ") t(k, score, verified_sources, unverified_claims)")
def fact_check(spark: SparkSession, d: str) -> DataFrame:
    """SC27, SC28, AG11, JN7, ML6's parsing on canned replies."""
    r = spark.createDataFrame([(k, t) for k, t, *_ in _REPLIES], "k int, reply string")
    f = r.select("k", verify.fact_check(verify.first_json_object(F.col("reply")), F.array(F.lit("x"), F.lit("y"))).alias("f"))
    return f.select("k", F.round("f.score", 6).alias("score"), "f.verified_sources", "f.unverified_claims")


@query("select section_uid as k, case section_uid % 4 when 0 then null when 1 then 0.5::double else round(greatest(0, least(1, (section_uid % 17) / 10.0 - 0.3)), 6)::double end as score from sec_sections")
def judged_score(spark: SparkSession, d: str) -> DataFrame:
    """SC28."""
    uid = F.col("section_uid")
    score = F.round((uid % 17) / 10 - 0.3, 6).cast("decimal(5,2)").cast("string")
    reply = F.when(uid % 4 == 0, "nothing").when(uid % 4 == 1, 'well {"why": {"a": "none"}} }').otherwise(F.concat(F.lit('x {"score": '), score, F.lit(', "why": {"a": 1}} y')))
    r = table(spark, d, "sec_sections").select(uid.alias("k"), reply.alias("reply"))
    return r.select("k", F.round(verify.judged_score(verify.first_json_object(F.col("reply"))), 6).alias("score"))


@query(f"""
with c as (select doc_id, chunk_uid, '[Source: ' || coalesce(ticker, 'Unknown') || ' ' || coalesce(cast(year as varchar), 'Unknown') || ', chunk_id: ' || chunk_uid || ']' || chr(10) as head,
  coalesce(nullif({_strip('''array_to_string(list_filter(string_split(text, chr(10)), lambda x: not regexp_matches(x, '(?i)^[''' + S + ''']*Image:')), chr(10))''')}, ''), '') as body from sec_chunks where doc_id is not null),
r as (select *, row_number() over (partition by doc_id order by chunk_uid) as n, sum(length(head) + length(body)) over (partition by doc_id order by chunk_uid) + 2 * (row_number() over (partition by doc_id order by chunk_uid) - 1) as used from c),
k as (select *, n = 1 and used > 50000 and 50000 - length(head) - 3 > 0 as cut from r),
p as (select doc_id, chunk_uid, case when cut then head || body[1 : 50000 - length(head) - 3] || '...' else head || body end as part, cut, used from k where used <= 50000 or cut)
select doc_id, chunk_uid, md5(part) as h, cast(case when cut then length(part) else used end as bigint) as used from p""")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    """WN1, SC32, SC13: the chunks of each filing under the budget."""
    c = table(spark, d, "sec_chunks").filter("doc_id is not null").select("doc_id", "chunk_uid", "text", "ticker", "year")
    k = context.within_budget(c, ["doc_id"], "chunk_uid", "text", rules.CONTEXT_CHARS, context.source_header(F.col("ticker"), F.col("year"), F.col("chunk_uid").cast("string")))
    return k.select("doc_id", "chunk_uid", F.md5("part").alias("h"), F.col("used").cast("bigint").alias("used"))


@query("with r as (select chunk_uid, doc_id, row_number() over (partition by doc_id order by length(coalesce(text, '')) desc, chunk_uid) as k from sec_chunks) select chunk_uid, doc_id, k as final_rank from r where k <= 18")
def rerank_cut(spark: SparkSession, d: str) -> DataFrame:
    """TK6 with text length in the reranker's place."""
    c = table(spark, d, "sec_chunks").select(F.col("doc_id").alias("query_id"), "chunk_uid", F.col("chunk_uid").alias("rank"), "text")
    return retrieval.rerank(c, F.length(F.coalesce("text", F.lit("")))).select("chunk_uid", F.col("query_id").alias("doc_id"), F.col("final_rank").cast("bigint").alias("final_rank"))


_NAMES = "case " + " ".join(f"when contains(lower(q), '{n}') then '{t}'" for n, t in rules.COMPANIES) + " end"
#: Questions about every filing, in turn by the company's name, its ticker and a name of the dictionary, with and without the form
#: and the year.
_PHRASES = ("What did %s report in its %s of %s?", "how is the %s, see %s, apple and metadata, %s", "advisable margins of %s: %s %s", "")


@query(f"""
with questions as (select f.accession_number as k, replace(replace(replace(case length(f.accession_number || coalesce(f.filing_type, '')) % 4 when 0 then '{_PHRASES[0]}' when 1 then '{_PHRASES[1]}' when 2 then '{_PHRASES[2]}' else coalesce(f.filing_type, '') end, 'What did %s', 'What did ' || c.company_name), 'the %s', 'the ' || f.ticker), 'of %s?', 'of ' || f.year || '?') as q
  from filings f join companies c on c.ticker = f.ticker),
x as (select k, coalesce({_NAMES}, list_filter(regexp_extract_all(upper(q), '\\b([A-Z]{{1,5}})\\b', 1), lambda w: length(w) >= 2)[1]) as ticker, cast(nullif(regexp_extract(q, '\\b(19\\d{{2}}|20\\d{{2}})\\b', 1), '') as int) as year, nullif(upper(regexp_extract(q, '(?i)\\b(10-K|10-Q|8-K|10-KT)\\b', 1)), '') as filing_type from questions)
select k, ticker, year, filing_type from x""")
def detect_metadata(spark: SparkSession, d: str) -> DataFrame:
    """SC15, TK9."""
    f = table(spark, d, "filings").join(table(spark, d, "companies").select("ticker", "company_name"), "ticker")
    kind = F.length(F.concat("accession_number", F.coalesce("filing_type", F.lit("")))) % 4
    phrase = F.when(kind == 0, _PHRASES[0]).when(kind == 1, _PHRASES[1]).when(kind == 2, _PHRASES[2]).otherwise(F.coalesce("filing_type", F.lit("")))
    for mark, value in (("What did %s", F.concat(F.lit("What did "), "company_name")), ("the %s", F.concat(F.lit("the "), "ticker")), ("of %s?", F.concat(F.lit("of "), F.col("year").cast("string"), F.lit("?")))):
        phrase = F.replace(phrase, F.lit(mark), value)
    q = f.select(F.col("accession_number").alias("k"), phrase.alias("q"))
    return q.select("k", detect.detect(F.col("q")).alias("m")).select("k", "m.ticker", "m.year", "m.filing_type")


@query("select d.doc_id, arg_min(c.ticker, c.ticker) as ticker from documents d join companies c on contains(lower(d.text), lower(c.company_name)) group by d.doc_id")
def company_lookup(spark: SparkSession, d: str) -> DataFrame:
    """JN10, SC16: the companies table as dictionary, in ticker order, over all documents."""
    return detect.company_ticker_join(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "companies"), "company_name", "ticker", "ticker")


@query("select chunk_uid from sec_chunks where ticker in (select ticker from companies where sector = 'energy') and year in (select distinct year from filings where filing_type = '10-K')")
def available_filter(spark: SparkSession, d: str) -> DataFrame:
    """JN11."""
    c = table(spark, d, "sec_chunks")
    t = table(spark, d, "companies").filter("sector = 'energy'").select("ticker")
    y = table(spark, d, "filings").filter("filing_type = '10-K'").select("year").distinct()
    return c.join(t, "ticker", "left_semi").join(y, "year", "left_semi").select("chunk_uid")


@query("select chunk_uid from sec_chunks where ticker = 'ZORV' and year = 2023 and filing_type = '10-K'")
def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    """FLT2, FLT3, Q18: year given as text still matches."""
    return table(spark, d, "sec_chunks").filter(retrieval.matches({"ticker": "ZORV", "year": "2023", "filing_type": "10-K"})).select("chunk_uid")


@query("select nullif(ticker, '') as ticker, cast(year as varchar) as year, cast(chunk_uid as varchar) as chunk_id, text as content from sec_chunks where text <> '' and not contains(text, '<')")
def citation_tags(spark: SparkSession, d: str) -> DataFrame:
    """SC17."""
    c = table(spark, d, "sec_chunks").filter("text is not null")
    s = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    a = c.select(F.format_string('It <source ticker="%s" year="%s" chunk_id="%s">%s</source> then <source>x</source>.', s("ticker"), s("year"), s("chunk_uid"), F.col("text")).alias("a"))
    return a.select(F.inline(T.source_tags("a")))


@query("select chunk_uid as query_id from sec_chunks where trim(coalesce(text, '')) <> ''")
def valid_questions(spark: SparkSession, d: str) -> DataFrame:
    """FLT9."""
    return pipelines.valid_questions(table(spark, d, "sec_chunks").select(F.col("chunk_uid").alias("query_id"), F.col("text").alias("query"))).select("query_id")


@query()
def answer_questions(spark: SparkSession, d: str) -> DataFrame:
    """E3: one question per company against all narrative chunks, with hashed word vectors, reranking, budget, an extractive
    answer and its verification."""
    q = table(spark, d, "companies").select(F.xxhash64("ticker").alias("query_id"), F.format_string("What did %s say about revenue?", "company_name").alias("query"), "ticker", F.lit(None).cast("int").alias("year"))
    e = models.HashedWords()
    c = spread(table(spark, d, "sec_chunks").filter("text is not null").select(F.col("chunk_uid").cast("string").alias("chunk_id"), "text", "ticker", "year"))
    return pipelines.answer_questions(q, c.withColumn("v", e.embed(F.col("text"))), embedder=e)
