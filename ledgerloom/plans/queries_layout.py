"""Queries over sources, the store, layout joins and groupings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import rules, text as T
from ledgerloom.operators import chunking, layout
from ledgerloom.plans.queries_text import _strip
from ledgerloom.runtime import scratch, table
from ledgerloom.sources import filings, parsed, store

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _tsla(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tsla_2023_unified_chunks")


def _one(spark: SparkSession, d: str) -> DataFrame:
    """One row per chunk_id: the first stored (by time, then page)."""
    w = Window.partitionBy("chunk_id").orderBy("uploaded_at", F.coalesce("page", F.lit(-1)), F.coalesce("text", F.lit("")), F.coalesce("type", F.lit("")), F.coalesce("ticker", F.lit("")), F.coalesce("year", F.lit("")))
    return _tsla(spark, d).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


ONE = "one as (select * exclude (rn_) from (select *, row_number() over (partition by chunk_id order by uploaded_at, coalesce(page, -1), coalesce(text, ''), coalesce(type, ''), coalesce(ticker, ''), coalesce(year, '')) as rn_ from tsla_2023_unified_chunks) where rn_ = 1)"


@query(r"""
with p as (select accession_number as key, path, string_split(path, '/') as parts from filings),
a as (select *, nullif(parts[3], '') as acc, regexp_extract(coalesce(parts[3], ''), '-(\d{2})-', 1) as yy from p)
select key, nullif(parts[1], '') as ticker, nullif(parts[2], '') as filing_type, acc as accession_number,
  cast(case when yy <> '' then (case when cast(yy as int) < 50 then 2000 else 1900 end) + cast(yy as int) end as int) as year,
  coalesce(acc, nullif(parts[case when len(parts) > 1 then len(parts) - 1 else len(parts) end], '')) as doc_id from a""")
def path_metadata(spark: SparkSession, d: str) -> DataFrame:
    """SRC1-SRC3 on the stored paths."""
    f = table(spark, d, "filings")
    return f.select(F.col("accession_number").alias("key"), *[c.alias(k) for k, c in filings.path_metadata(F.col("path")).items()])


@query(r"""
select chunk_id, case when regexp_matches(n, '^([A-Z]+)_(\d{4})_unified_chunks$') then regexp_extract(n, '^([A-Z]+)_(\d{4})_unified_chunks$', 1) else ticker end as ticker,
  case when regexp_matches(n, '^([A-Z]+)_(\d{4})_unified_chunks$') then regexp_extract(n, '^([A-Z]+)_(\d{4})_unified_chunks$', 2) else year end as year,
  regexp_matches(n, '^([A-Z]+)_(\d{4})_unified_chunks$') as name_ok
from (select *, coalesce(ticker, '') || '_' || coalesce(year, '') || '_unified_chunks' as n from tsla_2023_unified_chunks)""")
def name_metadata(spark: SparkSession, d: str) -> DataFrame:
    """SRC6: ticker and year by the name of the file."""
    stem = F.concat(F.coalesce("ticker", F.lit("")), F.lit("_"), F.coalesce("year", F.lit("")), F.lit("_unified_chunks"))
    return parsed.with_name_metadata(_tsla(spark, d), stem).select("chunk_id", "ticker", "year", "name_ok")


@query("select ticker as key, ticker, cast(first_year as varchar) as year from companies")
def parsed_names(spark: SparkSession, d: str) -> DataFrame:
    """SRC7: tsla_2023.json for every company."""
    c = table(spark, d, "companies")
    name = F.concat(F.lower("ticker"), F.lit("_"), F.col("first_year").cast("string"), F.lit(".json"))
    return c.select(F.col("ticker").alias("key"), *[x.alias(k) for k, x in parsed.parsed_name(name).items()])


@query("select ticker as key, 'pdfs/' || lower(ticker) || '-' || first_year || '1231.pdf' as pdf from companies")
def find_pdfs(spark: SparkSession, d: str) -> DataFrame:
    """SRC8: each company's name against three files, of which one fits best."""
    c = table(spark, d, "companies").select("ticker", F.col("first_year").cast("string").alias("year"))
    low = F.lower("ticker")
    files = c.select(F.explode(F.array(F.concat(F.lit("pdfs/"), low, F.lit("-"), "year", F.lit("1231.pdf")), F.concat(F.lit("pdfs/"), low, F.lit("_annual_"), "year", F.lit(".pdf")), F.concat(F.lit("pdfs/x"), low, F.lit("-"), "year", F.lit(".pdf")))).alias("path"))
    return parsed.pdf_for(c, files, "ticker", "ticker", "year", "path").select(F.col("ticker").alias("key"), "pdf")


@query("select t as ticker, f as filing_type, y || '-01-01' as after, y || '-12-31' as before from (values ('AAPL'), ('TSLA')) a(t), (values ('10-K'), ('10-Q')) b(f), (values (2022), (2023)) c(y)")
def download_grid(spark: SparkSession, d: str) -> DataFrame:
    """SRC9: the requests only."""
    return filings.download_requests(spark, ["AAPL", "TSLA"], ["10-K", "10-Q"], [2022, 2023])


@query("select coalesce(nullif(trim(ticker), ''), 'unknown') as ticker, coalesce(nullif(trim(cast(year as varchar)), ''), 'unknown') as year, count(*) as num_chunks, 'ticker=' || coalesce(nullif(trim(ticker), ''), 'unknown') || '/year=' || coalesce(nullif(trim(cast(year as varchar)), ''), 'unknown') as path from sec_chunks group by all")
def group_manifest(spark: SparkSession, d: str) -> DataFrame:
    """AG1, AG2, SNK2, D15."""
    return store.manifest(table(spark, d, "sec_chunks"))


@query("select coalesce(type, 'Unknown') as type, count(*) as n from tsla_2023_unified_chunks group by 1")
def type_counts(spark: SparkSession, d: str) -> DataFrame:
    """AG3."""
    return _tsla(spark, d).groupBy(F.coalesce("type", F.lit("Unknown")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("select list_sort(list(distinct ticker)) as tickers, list_sort(list(distinct try_cast(year as int)) filter (try_cast(year as int) is not null)) as years from (select ticker, year from tsla_2023_unified_chunks where ticker is not null)")
def available_metadata(spark: SparkSession, d: str) -> DataFrame:
    """AG5."""
    return store.available(_tsla(spark, d).filter("ticker is not null"))


@query("select page, count(*) as n, sum(cast(coalesce(type, '') in ('Table', 'Figure') as int)) as n_clipped from tsla_2023_unified_chunks group by page")
def per_page(spark: SparkSession, d: str) -> DataFrame:
    """AG4."""
    clip = F.coalesce(F.col("type").isin("Table", "Figure"), F.lit(False))
    return _tsla(spark, d).groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.sum(clip.cast("int")).alias("n_clipped"))


@query("select coalesce(filing_type, 'unknown') as filing_type, count(*) as n, sum(cast(path is null as int)) as failed from filings group by 1")
def batch_tallies(spark: SparkSession, d: str) -> DataFrame:
    """AG14."""
    return table(spark, d, "filings").groupBy(F.coalesce("filing_type", F.lit("unknown")).alias("filing_type")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("path").isNull()).alias("failed"))


def _collection(spark: SparkSession, d: str, label: str, rows: DataFrame) -> store.Collection:
    c = store.Collection(spark, scratch(spark, label))
    c.write(rows)
    return c


KEYED = "select coalesce(nullif(trim(ticker), ''), 'unknown') as ticker, coalesce(nullif(trim(year), ''), 'unknown') as year, * exclude (ticker, year) from tsla_2023_unified_chunks"


@query(f"""with k as ({KEYED}), h as (select ticker, year, count(*) as n, list(distinct chunk_id) as have from k where page % 2 = 0 group by ticker, year),
a as (select k.ticker, k.year, count(distinct k.chunk_id) filter (not coalesce(list_contains(h.have, k.chunk_id), false)) as added from k left join h using (ticker, year) group by k.ticker, k.year)
select a.ticker, a.year, coalesce(h.n, 0) + a.added as n, a.added from a left join h using (ticker, year)""")
def incremental_append(spark: SparkSession, d: str) -> DataFrame:
    """SNK2, SNK3: a collection of the even pages, to which all chunks are appended twice."""
    t = _tsla(spark, d).select("chunk_id", "ticker", "year", "page")
    c = _collection(spark, d, "append", t.filter("page % 2 = 0").withColumn("first", F.lit(True)))
    for _ in range(2):
        c.append(t.withColumn("first", F.lit(False)))
    return c.read().groupBy("ticker", "year").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("first")).alias("added"))


@query("select f.accession_number from filings f where not exists (select 1 from sec_tables t where t.doc_id = f.doc_id)")
def new_filings(spark: SparkSession, d: str) -> DataFrame:
    """SNK3's test: filings not loaded yet."""
    return store.new_rows(table(spark, d, "filings").select(F.col("doc_id"), "accession_number"), table(spark, d, "sec_tables"), "doc_id", "doc_id").select("accession_number")


@query(f"with k as ({KEYED}) select ticker, year, count(*) as n from k where not coalesce(type = 'Figure' or ticker = 'unknown', false) group by ticker, year")
def delete_by_key(spark: SparkSession, d: str) -> DataFrame:
    """SNK4: figures, and all chunks without a ticker, deleted from a collection; what its manifest then says."""
    c = _collection(spark, d, "delete", _tsla(spark, d).select("chunk_id", "ticker", "year", "type"))
    c.delete((F.col("type") == "Figure") | (F.col("ticker") == "unknown"))
    left = c.read().groupBy("ticker", "year").agg(F.count(F.lit(1)).alias("n"))
    return left.join(c.manifest().select("ticker", "year", F.col("num_chunks").alias("n")), ["ticker", "year", "n"])


@query(f"with k as ({KEYED}) select 'sec_filings' as name, count(*) as n, count(distinct (ticker, year)) as partitions from k")
def collection_info(spark: SparkSession, d: str) -> DataFrame:
    """SNK8, SRC12, SRC13: a collection found by its folder and described by its manifest."""
    c = _collection(spark, d, "info", _tsla(spark, d).select("chunk_id", "ticker", "year"))
    found = [store.Collection(spark, c.path.rsplit("/", 1)[0], name).info() for name in store.discover(spark, c.path.rsplit("/", 1)[0])]
    return spark.createDataFrame([(i["name"], i["count"], i["partitions"]) for i in found], "name string, n bigint, partitions bigint")


@query(f"""with {ONE}
select chunk_id, coalesce(ticker, '') as ticker, coalesce(year, '') as year, coalesce(type, 'Text') as type, coalesce(cast(page as varchar), '0') as page,
  case when type in ('Table', 'Figure') then image_path end as image_path, case when type in ('Table', 'Figure') then filename end as filename,
  case when type in ('Table', 'Figure') then cast(size.width as varchar) end as image_width, case when type in ('Table', 'Figure') then cast(size.height as varchar) end as image_height,
  cast(coordinates.x_1 as varchar) as x_1, cast(coordinates.y_1 as varchar) as y_1, cast(coordinates.x_2 as varchar) as x_2, cast(coordinates.y_2 as varchar) as y_2 from one""")
def flatten_metadata(spark: SparkSession, d: str) -> DataFrame:
    """SNK6."""
    return layout.stored_metadata(_one(spark, d))


@query(f"""with {ONE},
n as (select *, row_number() over (order by chunk_id) - 1 as i, case when page % 2 = 0 then null else chunk_id end as given from one)
select chunk_id, case when trim(coalesce(given, '')) <> '' then trim(given)
  when ticker is not null and year is not null then format('{{}}_{{}}_{{}}_{{}}_{{}}', replace(lower(coalesce(type, 'text')), ' ', '_'), ticker, year, lpad(cast(coalesce(page, 0) as varchar), cast(greatest(3, length(cast(coalesce(page, 0) as varchar))) as int), '0'), '0007')
  when ticker is not null then format('{{}}_{{}}_{{}}_{{}}', replace(lower(coalesce(type, 'text')), ' ', '_'), ticker, lpad(cast(coalesce(page, 0) as varchar), cast(greatest(3, length(cast(coalesce(page, 0) as varchar))) as int), '0'), '0007')
  else 'chunk_' || md5(coalesce(text, ''))[1:8] || '_0007' end as id from n""")
def fallback_ids(spark: SparkSession, d: str) -> DataFrame:
    """PRJ4: chunks of even pages lose their id and get one."""
    t = _one(spark, d).withColumn("given", F.when(F.col("page") % 2 == 0, None).otherwise(F.col("chunk_id")))
    return t.select("chunk_id", layout.fallback_id(F.col("given"), F.col("type"), F.col("ticker"), F.col("year"), F.col("page"), F.lit(7), F.col("text")).alias("id"))


@query(f"with {ONE} select chunk_id, md5(case when type in ('Table', 'Figure') and image_path is not null then text || chr(10) || chr(10) || 'Image: ' || image_path else text end) as h from one")
def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    """PRJ6."""
    return _one(spark, d).select("chunk_id", F.md5(layout.text_for_embedding(F.col("text"), F.col("type"), F.col("image_path"))).alias("h"))


@query(f"""with {ONE}
select coalesce(ticker, 'Unknown') as ticker, coalesce(year, 'Unknown') as year, chunk_id, coalesce(nullif(type, ''), 'Text') as chunk_type, coalesce(page, 0) as page, coalesce(nullif(image_path, ''), filename) as image_path, md5(text) as text from one""")
def to_sources(spark: SparkSession, d: str) -> DataFrame:
    """PRJ2, D12."""
    return layout.to_source(_one(spark, d), F.md5("text"))


@query(f"with {ONE} select chunk_id, case when g like '/%' then g when contains(g, '/') then case when g like 'data/%' then g else 'data/sec_pdfs/clippings/' || g end else 'data/sec_pdfs/clippings/' || 'tsla-20231231' || '/clippings/' || coalesce(filename, g) end as path from (select *, coalesce(image_path, filename, '') as g from one where type in ('Table', 'Figure'))")
def image_paths(spark: SparkSession, d: str) -> DataFrame:
    """PRJ5."""
    t = _one(spark, d).filter(F.col("type").isin("Table", "Figure"))
    return t.select("chunk_id", layout.image_path(F.col("image_path"), F.col("filename"), F.lit("tsla-20231231")).alias("path"))


@query(f"""with {ONE} select chunk_id, case lower(regexp_extract(coalesce(image_path, filename, ''), '(\\.[^./]*)$', 1)) when '.png' then 'image/png' when '.jpg' then 'image/jpeg' when '.jpeg' then 'image/jpeg' when '.gif' then 'image/gif' when '.webp' then 'image/webp' end as mime,
  not (contains('/' || coalesce(image_path, filename, '') || '/', '/../') or starts_with(coalesce(image_path, filename, ''), '/')) and lower(regexp_extract(coalesce(image_path, filename, ''), '(\\.[^./]*)$', 1)) in ('.png', '.jpg', '.jpeg', '.gif', '.webp') as served from one where type in ('Table', 'Figure')""")
def served_images(spark: SparkSession, d: str) -> DataFrame:
    """FLT10, SC33: type and containment of the image files."""
    t = _one(spark, d).filter(F.col("type").isin("Table", "Figure")).withColumn("p", F.coalesce("image_path", "filename", F.lit("")))
    return t.select("chunk_id", T.mime_type(F.regexp_extract("p", r"(\.[^./]*)$", 1)).alias("mime"), layout.is_served(F.col("p")).alias("served"))


@query("select chunk_id, type from tsla_2023_unified_chunks where type in ('Text', 'Section header', 'Title', 'List') and trim(coalesce(text, '')) <> ''")
def text_elements(spark: SparkSession, d: str) -> DataFrame:
    """FLT4, FLT6."""
    return _tsla(spark, d).filter(F.col("type").isin(*rules.TEXT_TYPES) & (F.trim(F.coalesce("text", F.lit(""))) != "")).select("chunk_id", "type")


def _elements(spark: SparkSession, d: str) -> DataFrame:
    """Layout elements again from the unified chunks: left/top/width/height, figures called pictures, seq by id."""
    t = _one(spark, d).filter("page is not null and coordinates is not null and type is not null")
    c = lambda x: F.col(f"coordinates.{x}")
    return t.select(
        (F.col("page") / 100).cast("int").alias("doc_id"), F.col("page").alias("page_number"), F.when(F.col("type") == "Figure", "Picture").otherwise(F.col("type")).alias("type"), "text", c("x_1").alias("left"), c("y_1").alias("top"),
        (c("x_2") - c("x_1")).alias("width"), (c("y_2") - c("y_1")).alias("height"), F.col("chunk_id").alias("seq"), "coordinates",
    )


ELEMENTS = f"{ONE}, el as (select cast(trunc(page / 100.0) as int) as doc_id, page, case when type = 'Figure' then 'Picture' else type end as type, text, coordinates, chunk_id as seq, image_path, filename from one where page is not null and coordinates is not null and type is not null)"


@query(f"""with {ELEMENTS}
select seq, page + 59 as pdf_page, 'Figure' as type, cast(row_number() over (partition by doc_id order by seq) - 1 as int) as block_id, round(coordinates.x_2, 3) as x_2 from el where type = 'Picture'
""")
def target_elements(spark: SparkSession, d: str) -> DataFrame:
    """FLT5, PRJ1, PRJ7, WN6: pictures renamed, corners, block ids."""
    t = layout.target_elements(_elements(spark, d), ("Figure",), page_offset=59)
    return t.select("seq", "pdf_page", "type", "block_id", F.round("coordinates.x_2", 3).alias("x_2"))


@query(f"""with {ELEMENTS},
t as (select seq, page, coordinates.x_1 as x1, coordinates.y_1 as y1, coordinates.x_2 as x2, coordinates.y_2 as y2 from el where type in ('Table', 'Picture')),
h as (select page, coordinates.x_1 as hx1, coordinates.y_1 as hy1, coordinates.x_2 as hx2, coordinates.y_2 as hy2 from el where type in ('Text', 'Section header')),
j as (select *, min(hy1) over (partition by seq) as top from t join h using (page) where hy2 between y1 - 5 and y1 + 10 and not (hx2 < x1 - 50 or hx1 > x2 + 50)),
w as (select seq, min(hx1) as mx1, min(hy1) as my1, max(hx2) as mx2, count(*) as n from j where hy1 - top <= 5 group by seq)
select t.seq, least(x1, coalesce(mx1, x1)) as x_1, least(y1, coalesce(my1, y1)) as y_1, greatest(x2, coalesce(mx2, x2)) as x_2, y2 as y_2, coalesce(n, 0) as n_headers from t left join w using (seq)""")
def header_capture(spark: SparkSession, d: str) -> DataFrame:
    """JN2."""
    e = _elements(spark, d).select("type", "seq", F.col("page_number").alias("page"), *[F.col(f"coordinates.{c}").alias(c) for c in ("x_1", "y_1", "x_2", "y_2")])
    t = e.filter(F.col("type").isin("Table", "Picture")).withColumnRenamed("seq", "target_id")
    return layout.capture_headers(t, e.filter(F.col("type").isin("Text", "Section header")), ["page"]).select(F.col("target_id").alias("seq"), "x_1", "y_1", "x_2", "y_2", "n_headers")


@query(f"""with {ELEMENTS},
b as (select seq, cast(greatest(0, least(cast(trunc(trunc(coordinates.x_1) * 1.5) as int), 1000)) as int) as x_1, cast(greatest(0, least(cast(trunc(trunc(coordinates.y_1) * 1.5) as int), 1200)) as int) as y_1,
  cast(greatest(0, least(cast(trunc(trunc(coordinates.x_2) * 1.5) as int), 1000)) as int) as x_2, cast(greatest(0, least(cast(trunc(trunc(coordinates.y_2) * 1.5) as int), 1200)) as int) as y_2 from el where type in ('Table', 'Picture'))
select *, x_2 - x_1 as width, y_2 - y_1 as height from b where x_2 > x_1 and y_2 > y_1""")
def scaled_boxes(spark: SparkSession, d: str) -> DataFrame:
    """SC26, SNK7 (geometry): crops on an image of 1000 x 1200 for pages of two thirds that scale."""
    t = _elements(spark, d).filter(F.col("type").isin("Table", "Picture")).select("seq", *[F.col(f"coordinates.{c}").alias(c) for c in ("x_1", "y_1", "x_2", "y_2")])
    s = layout.scale_and_clamp(t, F.lit(1000.0), F.lit(1200.0), F.lit(1000 / 1.5), F.lit(800.0))
    return s.select("seq", "x_1", "y_1", "x_2", "y_2", "size.width", "size.height")


def _clippings(spark: SparkSession, d: str) -> DataFrame:
    t = _one(spark, d).filter(F.col("type").isin("Table", "Figure") & F.col("page").isNotNull())
    w = Window.partitionBy("page").orderBy("chunk_id")
    return t.select((F.col("page") / 100).cast("int").alias("doc_id"), F.col("page").alias("page_number"), F.col("type").alias("kind"), (F.row_number().over(w) - 1).alias("block_id"), F.col("chunk_id").alias("cseq"), F.when(F.substring("chunk_id", -1, 1) == "3", "  ").otherwise(F.col("text")).alias("caption"), "image_path", "filename")


CLIPS = "cl as (select cast(trunc(page / 100.0) as int) as doc_id, page, type as kind, row_number() over (partition by page order by chunk_id) - 1 as block_id, chunk_id as cseq, case when right(chunk_id, 1) = '3' then '  ' else text end as caption, image_path, filename from one where type in ('Table', 'Figure') and page is not null)"


@query(f"""with {ELEMENTS}, {CLIPS},
e as (select seq, doc_id, page, case when type = 'Picture' then 'Figure' else type end as kind, row_number() over (partition by doc_id, page, type order by seq) as n from el where type in ('Table', 'Picture')),
c as (select *, row_number() over (partition by doc_id, page, kind order by cseq) as n from cl)
select e.seq, c.block_id, md5(c.caption) as h from e join c using (doc_id, page, kind, n) where trim(coalesce(c.caption, '')) <> ''""")
def ordinal_zip(spark: SparkSession, d: str) -> DataFrame:
    """JN1."""
    z = layout.zip_clippings(_elements(spark, d).drop("text"), _clippings(spark, d), ["doc_id", "page_number"])
    return z.select("seq", F.col("block_id").cast("bigint").alias("block_id"), F.md5("caption").alias("h"))


@query(f"""with {ELEMENTS}, {CLIPS},
e as (select seq, doc_id, page, case when type = 'Picture' then 'Figure' else type end as kind, row_number() over (partition by doc_id, page, type order by seq) as n from el where type in ('Table', 'Picture')),
c as (select *, row_number() over (partition by doc_id, page, kind order by cseq) as n from cl),
u as (select e.seq, e.doc_id, e.page, e.kind, cast(c.block_id as int) as block_id from e join c using (doc_id, page, kind, n) where trim(coalesce(c.caption, '')) <> ''
  union all select seq, doc_id, page, type, null from el where type in ('Text', 'Section header', 'Title', 'List') and trim(coalesce(text, '')) <> ''),
r as (select *, row_number() over (partition by doc_id order by seq) - 1 as i from u)
select seq, kind, i as "index", case when block_id is null then 'text' else lower(kind) end || '_' || lpad(cast(page as varchar), cast(greatest(3, length(cast(page as varchar))) as int), '0') || '_' || lpad(cast(coalesce(block_id, i) as varchar), cast(greatest(3, length(cast(coalesce(block_id, i) as varchar))) as int), '0') as chunk_id from r""")
def unified_chunks(spark: SparkSession, d: str) -> DataFrame:
    """E2: ST1, ST2, PRJ3, WN5, TK7."""
    u = layout.unified_chunks(_elements(spark, d), _clippings(spark, d), "doc_id", "page_number", F.lit("tsla-20231231"))
    return u.select("seq", "kind", F.col("index").cast("bigint").alias("index"), "chunk_id")


@query(f"""with {ELEMENTS}, {CLIPS},
t as (select page, coalesce(text, '') as t, row_number() over (partition by page order by seq) as n from el where type = 'Text'),
x as (select page, string_agg(t, ' ' order by n) as context from t where n <= 3 group by page)
select cseq, md5(case when page <> 0 then context end) as h from cl left join x using (page)""")
def page_context(spark: SparkSession, d: str) -> DataFrame:
    """JN3, TK8."""
    e = _elements(spark, d).withColumnRenamed("page_number", "page")
    return layout.page_context(_clippings(spark, d).withColumnRenamed("page_number", "page"), e, ["page"]).select("cseq", F.md5("context").alias("h"))


@query(f"with {ONE} select chunk_id from one where type in ('Table', 'Figure') and filename in (select distinct filename from one where image_path like 'data/%')")
def images_present(spark: SparkSession, d: str) -> DataFrame:
    """JN12."""
    t = _one(spark, d)
    listing = t.filter(F.col("image_path").startswith("data/")).select("filename").distinct()
    return t.filter(F.col("type").isin("Table", "Figure")).join(listing, "filename", "left_semi").select("chunk_id")


@query(f"with {ONE} select chunk_id, row_number() over (order by coalesce(page, 0), coalesce(coordinates.y_1, 0), chunk_id) as place from one")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    """TK7: the place of each chunk."""
    return layout.reading_places(_one(spark, d), "chunk_id").select("chunk_id", "place")


_JSON = " || ', ' || ".join(f"""'"{n}": ' || coalesce({f"'{chr(34)}' || cast({n} as varchar) || '{chr(34)}'" if n not in ("start_token", "end_token") else f"cast({n} as varchar)"}, 'null')""" for n in ("doc_id", "ticker", "filing_type", "accession_number", "year", "start_token", "end_token"))


@query(f"select chunk_uid, strlen(coalesce(text, '')) + strlen('{{' || {_JSON} || '}}') as n_bytes from sec_chunks")
def stored_bytes(spark: SparkSession, d: str) -> DataFrame:
    """PRJ8, SC10: bytes of text and metadata for the limit."""
    c = table(spark, d, "sec_chunks")
    size = chunking.metadata_size(F.struct("doc_id", "ticker", "filing_type", "accession_number", "year", "start_token", "end_token"))
    return c.select("chunk_uid", (F.coalesce(T.byte_length("text"), F.lit(0)) + size).cast("bigint").alias("n_bytes"))


@query(f"select doc_id from documents where text is not null and length({_strip('text')}) >= 50")
def long_enough(spark: SparkSession, d: str) -> DataFrame:
    """FLT7."""
    return chunking.long_enough(table(spark, d, "documents"), "text").select("doc_id")
