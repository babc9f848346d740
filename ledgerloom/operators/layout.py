"""Layout elements, clippings and unified chunks: joins by page and ordinal, geometry as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import rules, text as T

CLIPPED = ("Table", "Figure")


def rename_picture(kind: Column) -> Column:
    return F.when(kind == "Picture", "Figure").otherwise(kind)


def corners(left: Column, top: Column, width: Column, height: Column) -> Column:
    d = lambda c: c.cast("double")
    return F.struct(d(left).alias("x_1"), d(top).alias("y_1"), d(left + width).alias("x_2"), d(top + height).alias("y_2"))


def target_elements(elements: DataFrame, kinds: tuple[str, ...] = ("Table", "Picture", "Figure"), page_offset: int = 0, doc: str = "doc_id") -> DataFrame:
    """Elements of the wanted kinds with PDF page, renamed kind, corners, and a running block_id per document (by seq)."""
    d = elements.withColumn("pdf_page", F.col("page_number") + page_offset).withColumn("original_type", F.col("type")).withColumn("type", rename_picture(F.col("type")))
    d = d.filter(F.col("type").isin(*kinds) | F.col("original_type").isin(*kinds)).withColumn("coordinates", corners(*(F.col(c) for c in ("left", "top", "width", "height"))))
    return d.withColumn("block_id", F.row_number().over(Window.partitionBy(doc).orderBy("seq")) - 1)


def capture_headers(targets: DataFrame, texts: DataFrame, keys: list[str], below: float = 10, above: float = 5, side: float = 50, row: float = 5) -> DataFrame:
    """Boxes (x_1, y_1, x_2, y_2) of ``targets`` (keyed by ``target_id``) widened by the text boxes right above them.

    A text box counts if its bottom lies in [y_1 - above, y_1 + below] and it is not apart by more than ``side``; of those the
    topmost row is taken. Equi-join on the page keys and on a coarse band of the y axis, so a page with many boxes does not
    compare all with all; a bottom can only meet the band of y_1 and its neighbours."""
    band = max(below + above, 1.0)
    t = targets.select(*keys, "target_id", "x_1", "y_1", "x_2", "y_2").withColumn("_b", F.explode(F.array(*[F.floor(F.col("y_1") / band) + k for k in (-1, 0, 1)])))
    x = texts.select(*keys, F.col("x_1").alias("h_x1"), F.col("y_1").alias("h_y1"), F.col("x_2").alias("h_x2"), F.col("y_2").alias("h_y2")).withColumn("_b", F.floor(F.col("h_y2") / band))
    hit = t.join(x, [*keys, "_b"]).filter(F.col("h_y2").between(F.col("y_1") - above, F.col("y_1") + below) & ~((F.col("h_x2") < F.col("x_1") - side) | (F.col("h_x1") > F.col("x_2") + side)))
    hit = hit.withColumn("_top", F.min("h_y1").over(Window.partitionBy("target_id"))).filter(F.col("h_y1") - F.col("_top") <= row)
    wide = hit.groupBy("target_id").agg(F.min("h_x1").alias("hx1"), F.min("h_y1").alias("hy1"), F.max("h_x2").alias("hx2"), F.count(F.lit(1)).alias("n_headers"))
    d = targets.join(wide, "target_id", "left")
    return d.withColumn("x_1", F.least("x_1", F.coalesce("hx1", "x_1"))).withColumn("y_1", F.least("y_1", F.coalesce("hy1", "y_1"))).withColumn("x_2", F.greatest("x_2", F.coalesce("hx2", "x_2"))).withColumn("n_headers", F.coalesce("n_headers", F.lit(0))).drop("hx1", "hy1", "hx2")


def scale_and_clamp(df: DataFrame, image_width: Column, image_height: Column, page_width: Column, page_height: Column) -> DataFrame:
    """Boxes in image pixels, inside the image; boxes without area are dropped; ``size`` is that of the crop."""
    sx, sy = image_width / F.coalesce(page_width, image_width), image_height / F.coalesce(page_height, image_height)
    clamp = lambda v, m: F.greatest(F.lit(0), F.least(v.cast("int"), m.cast("int")))
    d = df
    for c, s, m in (("x_1", sx, image_width), ("y_1", sy, image_height), ("x_2", sx, image_width), ("y_2", sy, image_height)):
        d = d.withColumn(c, clamp(F.col(c).cast("int") * s, m))
    d = d.filter("x_2 > x_1 and y_2 > y_1")
    return d.withColumn("size", F.struct((F.col("x_2") - F.col("x_1")).alias("width"), (F.col("y_2") - F.col("y_1")).alias("height")))


def clipping_name(pdf_page: Column, kind: Column, block_id: Column) -> Column:
    return F.format_string("page_%03d_%s_%03d.png", pdf_page, F.lower(kind), block_id)


def chunk_id(prefix: Column, page: Column, index: Column) -> Column:
    return F.format_string("%s_%03d_%03d", F.lower(prefix), page, index)


def image_path(path: Column, filename: Column, pdf_name: Column, root: str = "data/sec_pdfs/clippings/") -> Column:
    given = F.coalesce(path, filename, F.lit(""))
    under = F.when(given.startswith("data/"), given).otherwise(F.concat(F.lit(root), given))
    return F.when(given.startswith("/"), given).when(given.contains("/"), under).otherwise(F.concat(F.lit(root), pdf_name, F.lit("/clippings/"), F.coalesce(filename, given)))


def page_context(clippings: DataFrame, elements: DataFrame, keys: list[str], seq: str = "seq", first: int = 3) -> DataFrame:
    """context: the first texts of a clipping's page, joined by blanks; null where the page has none or is 0."""
    w = Window.partitionBy(*keys).orderBy(seq)
    texts = elements.filter(F.col("type") == "Text").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= first)
    ctx = texts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), " ").alias("context"))
    out = clippings.join(ctx, keys, "left")
    return out.withColumn("context", F.when(F.col(keys[-1]) != 0, F.col("context")))


def zip_clippings(elements: DataFrame, clippings: DataFrame, keys: list[str]) -> DataFrame:
    """The n-th Table/Picture of a page takes the n-th clipping of that page and kind; unmatched rows of either side fall away.

    Clippings with the same (page, kind, block_id) count once: the last value (by seq) at the first one's place. A match
    whose caption is blank uses up its clipping and gives nothing."""
    e = elements.filter(F.col("type").isin("Table", "Picture", "Figure")).withColumn("kind", rename_picture(F.col("type")))
    e = e.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "kind").orderBy("seq")))
    c = clippings.groupBy(*keys, "kind", "block_id").agg(F.min("cseq").alias("_at"), F.max_by(F.struct("caption", "image_path", "filename"), "cseq").alias("c"))
    c = c.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "kind").orderBy("_at"))).select(*keys, "kind", "_n", "block_id", "c.*")
    joined = e.join(c, [*keys, "kind", "_n"])
    return joined.filter(F.trim(F.coalesce("caption", F.lit(""))) != "").drop("_n")


def unified_chunks(elements: DataFrame, clippings: DataFrame, doc: str, page: str, pdf_name: Column) -> DataFrame:
    """Text elements and captioned clippings of each document in one order, with ids and a running index over both."""
    keys = [doc, page]
    texts = elements.filter(F.col("type").isin(*rules.TEXT_TYPES) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    none = F.lit(None).cast("string")
    t = texts.select(doc, page, "seq", F.col("type").alias("kind"), F.trim("text").alias("text"), F.lit(None).cast("int").alias("block_id"), none.alias("image_path"), none.alias("filename"), "coordinates")
    z = zip_clippings(elements.drop("text"), clippings, keys).select(doc, page, "seq", "kind", F.trim("caption").alias("text"), F.col("block_id").cast("int"), image_path(F.col("image_path"), F.col("filename"), pdf_name).alias("image_path"), "filename", "coordinates")
    both = t.unionByName(z).withColumn("index", F.row_number().over(Window.partitionBy(doc).orderBy("seq")) - 1)
    prefix = F.when(F.col("block_id").isNull(), "text").otherwise(F.lower("kind"))
    return both.withColumn("chunk_id", chunk_id(prefix, F.col(page), F.coalesce("block_id", "index")))


def reading_order(df: DataFrame, *tie: str) -> DataFrame:
    """Rank by page and top of the box, missing values first, then the tie-breakers: a global order for output only."""
    return df.orderBy(F.coalesce("page", F.lit(0)), F.coalesce("coordinates.y_1", F.lit(0.0)), *tie)


def reading_places(df: DataFrame, *tie: str) -> DataFrame:
    """``place`` of each row in reading order, from 1: numbered per page after a count of the pages before it, so no task sorts
    everything. Pages are few beside rows."""
    t = df.withColumn("_p", F.coalesce("page", F.lit(0)))
    sizes = t.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    w = Window.partitionBy("_p").orderBy(F.coalesce("coordinates.y_1", F.lit(0.0)), *tie)
    return t.withColumn("_k", F.row_number().over(w)).join(before, "_p").withColumn("place", F.col("_before") + F.col("_k")).drop("_p", "_k", "_before")


def to_source(df: DataFrame, text: Column) -> DataFrame:
    """The flat source record of a retrieved chunk, with its defaults."""
    blank = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d))
    return df.select(
        F.coalesce("ticker", F.lit("Unknown")).alias("ticker"), F.coalesce("year", F.lit("Unknown")).alias("year"), "chunk_id", blank("type", "Text").alias("chunk_type"),
        F.coalesce("page", F.lit(0)).alias("page"), F.coalesce(F.nullif("image_path", F.lit("")), F.col("filename")).alias("image_path"), text.alias("text"),
    )


def fallback_id(chunk_id_: Column, kind: Column, ticker: Column, year: Column, page: Column, index: Column, text: Column) -> Column:
    """An existing id, else one from the metadata that is there, else a hash of the text instead of a random one."""
    t = F.replace(F.lower(F.coalesce(kind, F.lit("text"))), F.lit(" "), F.lit("_"))
    p = F.coalesce(page, F.lit(0))
    return (
        F.when(F.trim(F.coalesce(chunk_id_, F.lit(""))) != "", F.trim(chunk_id_))
        .when(ticker.isNotNull() & year.isNotNull(), F.format_string("%s_%s_%s_%03d_%04d", t, ticker, year, p, index))
        .when(ticker.isNotNull(), F.format_string("%s_%s_%03d_%04d", t, ticker, p, index))
        .otherwise(F.format_string("chunk_%s_%04d", F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 8), index))
    )


def is_served(path: Column) -> Column:
    """The file lies inside the image folder and is of a known image type: no absolute path, no step upwards."""
    given = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    inside = ~(F.contains(F.concat(F.lit("/"), given, F.lit("/")), F.lit("/../")) | F.startswith(given, F.lit("/")))
    return inside & T.mime_type(F.regexp_extract(given, r"(\.[^./]*)$", 1)).isNotNull()


def text_for_embedding(text: Column, kind: Column, path: Column) -> Column:
    return F.when(kind.isin(*CLIPPED) & path.isNotNull(), F.concat(text, F.lit("\n\nImage: "), path)).otherwise(text)


def stored_metadata(df: DataFrame) -> DataFrame:
    """Flat text metadata as a vector store keeps it; image fields only for tables and figures."""
    clip = F.col("type").isin(*CLIPPED)
    s = lambda c: F.col(c).cast("string")
    return df.select(
        "chunk_id", F.coalesce("ticker", F.lit("")).alias("ticker"), F.coalesce(s("year"), F.lit("")).alias("year"), F.coalesce("type", F.lit("Text")).alias("type"), F.coalesce(s("page"), F.lit("0")).alias("page"),
        F.when(clip, F.col("image_path")).alias("image_path"), F.when(clip, F.col("filename")).alias("filename"), F.when(clip, s("size.width")).alias("image_width"), F.when(clip, s("size.height")).alias("image_height"),
        *[s(f"coordinates.{c}").alias(c) for c in ("x_1", "y_1", "x_2", "y_2")],
    )
