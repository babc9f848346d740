"""Filing files: scan, path metadata, lossy text."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def accession_year(accession: Column) -> Column:
    """Year of the two digits between dashes, pivot 50."""
    y = F.nullif(F.regexp_extract(accession, r"-(\d{2})-", 1), F.lit("")).cast("int")
    return F.when(y < 50, y + 2000).otherwise(y + 1900)


def path_metadata(path: Column) -> dict[str, Column]:
    """ticker, filing_type, accession_number, year and doc_id of a path ticker/form/accession/file; missing parts are null."""
    parts = F.split(path, "/")
    at = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit(""))
    return {"ticker": at(0), "filing_type": at(1), "accession_number": at(2), "year": accession_year(at(2)), "doc_id": F.coalesce(at(2), F.nullif(F.element_at(parts, F.when(F.size(parts) > 1, -2).otherwise(-1)), F.lit("")))}


def read_filings(spark: SparkSession, root: str, name: str = "full-submission.txt") -> DataFrame:
    """One row per submission under ``root``: path metadata and raw text; bytes that are no UTF-8 are dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    inside = F.regexp_extract("path", r"([^/]+/[^/]+/[^/]+/[^/]+)$", 1)
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    return files.select(*[c.alias(k) for k, c in path_metadata(inside).items()], text.alias("raw_text"), inside.alias("path"))


def read_binary(spark: SparkSession, root: str, pattern: str = "*.png") -> DataFrame:
    """Image or page files as bytes; rasterizing pages is left to an external library."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)


def download_requests(spark: SparkSession, tickers: list[str], forms: list[str], years: list[int]) -> DataFrame:
    """The grid of downloads (fetching itself is outside the engine): ticker, filing_type, after, before."""
    return spark.createDataFrame([(t, f, f"{y}-01-01", f"{y}-12-31") for t, f, y in product(tickers, forms, years)], "ticker string, filing_type string, after string, before string")
