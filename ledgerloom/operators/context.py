"""Context assembly under a character budget, prompts and source headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import rules, text as T


def source_header(ticker: Column, year: Column, chunk_id: Column) -> Column:
    return F.format_string("[Source: %s %s, chunk_id: %s]\n", F.coalesce(ticker, F.lit("Unknown")), F.coalesce(year.cast("string"), F.lit("Unknown")), chunk_id)


def within_budget(df: DataFrame, keys: list[str], rank: str, text_col: str, budget: int = rules.CONTEXT_CHARS, header: Column | None = None) -> DataFrame:
    """The longest prefix by rank whose parts, joined by two line ends, fit the budget. ``part`` is header and text. If the
    very first part does not fit it is cut and marked with dots, or dropped if not even its header fits.

    A running sum per question: the sum grows with the rank, so the filter keeps a prefix."""
    head = header if header is not None else F.lit("")
    d = df.withColumn("_head", head).withColumn("_body", F.coalesce(T.drop_image_lines(F.col(text_col)), F.lit("")))
    w = Window.partitionBy(*keys).orderBy(rank)
    d = d.withColumn("_n", F.row_number().over(w)).withColumn("_len", F.length("_head") + F.length("_body"))
    d = d.withColumn("used", F.sum("_len").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 2 * (F.col("_n") - 1))
    room = F.lit(budget) - F.length("_head") - 3
    cut = (F.col("_n") == 1) & (F.col("used") > budget) & (room > 0)
    d = d.withColumn("part", F.when(cut, F.concat("_head", F.substring("_body", F.lit(1), F.greatest(room, F.lit(0))), F.lit("..."))).otherwise(F.concat("_head", "_body")))
    return d.filter((F.col("used") <= budget) | cut).withColumn("used", F.when(cut, F.length("part")).otherwise(F.col("used"))).drop("_head", "_body", "_n", "_len")


def join_parts(df: DataFrame, keys: list[str], rank: str) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col("part").alias("p")))), lambda x: x["p"])
    return df.groupBy(*keys).agg(F.array_join(parts, "\n\n").alias("context"), F.count(F.lit(1)).alias("n_parts"))


def prompt(query: Column, context: Column) -> Column:
    ask = "Answer only from the context. Say so if it is not enough. Name ticker and year of what you use, and wrap it in <source ticker=\"..\" year=\"..\" chunk_id=\"..\">..</source> tags."
    return F.concat(F.lit("You are a financial analyst assistant.\n\nContext:\n"), context, F.lit("\n\nQuestion: "), query, F.lit("\n\n" + ask + "\n\nAnswer:"))
