"""JSON arrays of parsed layouts, clippings and chunks; file names that carry metadata."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "struct<x_1: double, y_1: double, x_2: double, y_2: double>"
SIZE = "struct<width: int, height: int>"
ELEMENT = "type string, page_number int, text string, left double, top double, width double, height double, page_width double, page_height double"
CLIPPING = f"page int, pdf_page int, type string, block_id int, filename string, coordinates {BOX}, size {SIZE}, caption string, image_path string"
UNIFIED = f"chunk_id string, text string, type string, page int, ticker string, year string, coordinates {BOX}, image_path string, filename string, size {SIZE}"


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of pretty-printed JSON arrays with the file they came from; a missing path is an empty table."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))
    except AnalysisException:
        return spark.createDataFrame([], schema).withColumn("file", F.lit(None).cast("string"))


def unified_name(stem: Column) -> dict[str, Column]:
    """ticker and year of TICKER_YEAR_unified_chunks; null where the name has another form."""
    part = lambda i: F.nullif(F.regexp_extract(stem, r"^([A-Z]+)_(\d{4})_unified_chunks$", i), F.lit(""))
    return {"ticker": part(1), "year": part(2)}


def with_name_metadata(df: DataFrame, stem: Column) -> DataFrame:
    """ticker and year overwritten by those of the file name; kept, and marked, where the name does not say."""
    named = unified_name(stem)
    return df.withColumn("name_ok", named["ticker"].isNotNull()).withColumn("ticker", F.coalesce(named["ticker"], F.col("ticker"))).withColumn("year", F.coalesce(named["year"], F.col("year")))


def parsed_name(filename: Column) -> dict[str, Column]:
    """ticker (upper) and year of tsla_2023.json; null with fewer than two parts."""
    parts = F.split(F.regexp_replace(filename, r"\.[^.]*$", ""), "_")
    ok = F.size(parts) >= 2
    return {"ticker": F.when(ok, F.upper(F.get(parts, F.lit(0)))), "year": F.when(ok, F.get(parts, F.lit(1)))}


def pdf_for(names: DataFrame, pdfs: DataFrame, key: str, ticker: str, year: str, path: str) -> DataFrame:
    """key, pdf: the first file by the order of the three name patterns, then by path. Joined on the year found in the file
    name, so no name is compared with all files."""
    base = F.regexp_extract(F.col(path), r"([^/]+)$", 1)
    p = pdfs.select(F.col(path).alias("_p"), base.alias("_b")).withColumn("_y", F.explode(F.array_distinct(F.regexp_extract_all("_b", F.lit(r"(?=(\d{4}))"), F.lit(1)))))
    n = names.select(F.col(key), F.lower(F.col(ticker)).alias("_t"), F.col(year).alias("_y"))
    j = n.join(p, "_y").filter(F.col("_b").endswith(".pdf"))
    tight = F.startswith("_b", F.concat("_t", F.lit("-"), "_y"))
    loose = F.startswith("_b", F.col("_t")) & F.contains(F.substr("_b", F.length("_t") + 1), F.col("_y"))
    rank = F.when(tight, 1).when(loose, 3)
    return j.withColumn("_r", rank).filter("_r is not null").groupBy(key).agg(F.min_by("_p", F.struct("_r", "_p")).alias("pdf"))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Chunks, tables, items or unified chunks as JSON lines, one file per task; ``read_json_array`` reads them back."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
