"""Company, ticker, year and form named in a question."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import rules


def companies(spark: SparkSession, more: list[tuple[str, str]] = ()) -> DataFrame:
    """ord, name, ticker: the dictionary in order, custom names after it (a known name keeps its place)."""
    names = {**dict(rules.COMPANIES), **{n.lower(): t.upper() for n, t in more}}
    return spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(names.items())], "ord int, name string, ticker string")


def company_ticker(question: Column, names=rules.COMPANIES, word_boundary: bool = False) -> Column:
    """Ticker of the first name, in dictionary order, that occurs in the question. A small dictionary is one CASE."""
    low = F.lower(question)
    case = None
    for name, ticker in names:
        hit = low.rlike(r"\b" + re.escape(name) + r"\b") if word_boundary else low.contains(name)
        case = F.when(hit, ticker) if case is None else case.when(hit, ticker)
    return case


#: Names that one automaton holds; a larger dictionary is looked up in several passes.
NAMES_AT_ONCE = 100_000


def company_ticker_join(df: DataFrame, id_col: str, text_col: str, names: DataFrame, name_col: str, ticker_col: str, ord_col: str) -> DataFrame:
    """id, ticker for a dictionary of any size: the first name, in order, that occurs anywhere in the text, inside of words too.

    Names go in blocks of NAMES_AT_ONCE into a multi-pattern automaton that is sent to every task; a text is read once per
    block, whatever the number of names, and texts do not move. Only ids and the best name so far are shuffled, and those only
    for more than one block."""
    listed = names.select(F.lower(F.col(name_col)).alias("n"), F.col(ticker_col).cast("string").alias("t"), F.col(ord_col).alias("o")).filter("n <> ''")
    src = df.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text")).filter("text is not null")
    kind = src.schema["id"].dataType.simpleString()
    parts = []
    for rank, block in enumerate(batched(listed.orderBy("o", "t", "n").toLocalIterator(), NAMES_AT_ONCE)):
        held = df.sparkSession.sparkContext.broadcast([(r.n, r.t) for r in block])

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            machine, tickers = ahocorasick.Automaton(), [t for _, t in held.value]
            for i, (name, _) in enumerate(held.value):
                if name not in machine:  # of equal names the first counts
                    machine.add_word(name, i)
            machine.make_automaton()
            for batch in batches:
                best = [min((i for _, i in machine.iter(x)), default=-1) for x in batch.column(1).to_pylist()]
                take = pa.array([k for k, i in enumerate(best) if i >= 0], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array([tickers[i] for i in best if i >= 0], pa.string())], names=["id", "ticker"])

        parts.append(src.mapInArrow(run, f"id {kind}, ticker string").withColumn("block", F.lit(rank)))
    if not parts:
        return src.select(F.col("id").alias(id_col), F.lit(None).cast("string").alias("ticker")).limit(0)
    if len(parts) == 1:
        return parts[0].select(F.col("id").alias(id_col), "ticker")
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.min_by("ticker", "block").alias("ticker")).withColumnRenamed("id", id_col)


def detect(question: Column, tickers: list[str] | None = None, years: list[int] | None = None, names=rules.COMPANIES, word_boundary: bool = False) -> Column:
    """struct<ticker, year, filing_type>; null if nothing is named. With a list of tickers or years only those count; of
    several years only the first is looked at."""
    tokens = F.filter(F.regexp_extract_all(F.upper(question), F.lit(r"\b([A-Z]{1,5})\b"), F.lit(1)), lambda t: (F.length(t) >= 2) & (t.isin(*tickers) if tickers is not None else F.lit(True)))
    ticker = F.coalesce(company_ticker(question, names, word_boundary), F.get(tokens, F.lit(0)))
    year = F.nullif(F.regexp_extract(question, rules.YEAR_IN_QUESTION, 1), F.lit("")).cast("int")
    if years is not None:
        year = F.when(year.isin(*years), year)
    form = F.nullif(F.upper(F.regexp_extract(question, rules.FORM_IN_QUESTION, 1)), F.lit(""))
    found = F.struct(ticker.alias("ticker"), year.alias("year"), form.alias("filing_type"))
    return F.when(ticker.isNotNull() | year.isNotNull() | form.isNotNull(), found)
