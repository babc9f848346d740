"""Lines repeated across one source: a weighted graph of consecutive lines, its well supported part, and the texts without it.

Nodes are (source, line) with the number of records that hold the line; edges join lines that follow one another in a
record, weighted by the number of records. Nodes and edges of high support stay; connected components of what stays are the
boilerplate blocks; every occurrence of a line of a block is deleted.

Defined results: records whose source or text is null take no part and their texts come out unchanged; records without an id
are not counted, but lose the lines that others repeat; empty lines are no
nodes; a line twice in one record counts once; rows that share an id count as so many records; an empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import strip
from ledgerloom.llm.components import connected_components
from ledgerloom.runtime import materialize

MIN_SUPPORT = 10


def normal_line(line: Column) -> Column:
    return F.lower(strip(F.regexp_replace(line, "[ \\t\\r]+", " ")))


def normal_lines(text: Column) -> Column:
    """The normal form of every line of a text, empty ones included. Blanks and case are settled on the whole text, in
    generated code; only the ends are left to be trimmed line by line."""
    return F.transform(F.split(F.lower(F.regexp_replace(text, "[ \\t\\r]+", " ")), "\n"), strip)


def normal_source(source: Column) -> Column:
    return F.upper(strip(source))


def _hash(source: Column, line: Column) -> Column:
    """16 bytes for a line within its source."""
    return F.unhex(F.md5(F.concat_ws("\u0000", source, line)))


def _lines(df: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """id, source, lines: the normal, nonempty lines of each record in order."""
    base = df.select(F.col(id_col).alias("id"), normal_source(F.col(source_col)).alias("source"), F.col(text_col).cast("string").alias("text"))
    base = base.filter("id is not null and source is not null and text is not null")
    return base.select("id", "source", F.filter(normal_lines(F.col("text")), lambda x: x != "").alias("lines"))


class LineGraph:
    """The graph of one table. Texts are read and normalized once: what is written, and counted by nodes and edges, is the
    list of 16-byte line hashes of each record (about a fifth of the texts). The words of a line are read again from one
    record for each frequent line."""

    def __init__(self, df: DataFrame, id_col: str, source_col: str, text_col: str, min_support: int = MIN_SUPPORT):
        self.df, self.cols, self.min_support = df, (id_col, source_col, text_col), min_support
        lines = _lines(df, id_col, source_col, text_col)
        self.hashed = materialize(lines.select("id", F.transform("lines", lambda x: _hash(F.col("source"), x)).alias("hs")).filter(F.size("hs") > 0), "line_hashes")
        # partial aggregation on the map side: a source with a third of all rows meets no single task
        keyed = self.hashed.select("id", F.explode(F.array_distinct("hs")).alias("h"))
        self.frequent = materialize(keyed.groupBy("h").agg(F.count(F.lit(1)).alias("support"), F.min("id").alias("id")).filter(F.col("support") >= min_support), "frequent_lines")

    def nodes(self) -> DataFrame:
        """h, source, line, support of the lines with at least ``min_support`` records."""
        id_col = self.cols[0]
        ids = self.frequent.select(F.col("id").alias(id_col)).distinct()
        holders = _lines(self.df.join(ids, id_col, "left_semi"), *self.cols)  # before a text is split
        words = holders.select("source", F.explode("lines").alias("line")).distinct().withColumn("h", _hash(F.col("source"), F.col("line")))
        return words.join(self.frequent.select("h", "support"), "h").select("h", "source", "line", "support")

    def edges(self) -> DataFrame:
        """h_from, h_to, support: pairs of frequent lines that follow one another in at least ``min_support`` records. Steps
        to or from a line that is no node are gone before anything is counted."""
        n = F.size("hs")
        step = lambda i: F.struct(F.element_at("hs", i).alias("h_from"), F.element_at("hs", i + 1).alias("h_to"))
        steps = self.hashed.filter(n > 1).select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), step))).alias("e")).select("e.*")
        kept = self.frequent.select("h")
        for end in ("h_from", "h_to"):
            steps = steps.join(kept.withColumnRenamed("h", end), end, "left_semi")
        return steps.groupBy("h_from", "h_to").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= self.min_support)

    def blocks(self) -> DataFrame:
        """source, line, support, block: each node with the component it belongs to, named by its alphabetically first line."""
        edges = self.edges().filter("h_from <> h_to").select(F.hex("h_from").alias("a"), F.hex("h_to").alias("b"))
        parts = connected_components(edges, "a", "b")
        named = materialize(self.nodes().withColumn("node", F.hex("h")).join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")), "line_parts")
        first = named.groupBy("part").agg(F.min("line").alias("block"))
        return named.join(first, "part").select("source", "line", "support", "block")


def line_nodes(df: DataFrame, id_col: str, source_col: str, text_col: str, min_support: int = MIN_SUPPORT) -> DataFrame:
    return LineGraph(df, id_col, source_col, text_col, min_support).nodes()


def line_blocks(df: DataFrame, id_col: str, source_col: str, text_col: str, min_support: int = MIN_SUPPORT) -> DataFrame:
    return LineGraph(df, id_col, source_col, text_col, min_support).blocks()


#: Frequent lines whose hashes (16 bytes each) are sent to every task; with more of them texts meet their lines in a join.
BROADCAST_LINES = 500_000


def without_repeated_lines(df: DataFrame, id_col: str, source_col: str, text_col: str, min_support: int = MIN_SUPPORT) -> DataFrame:
    """id, text, n_removed for every row of ``df``: occurrences of block lines are deleted, the other lines stay as they
    were and in order; a text that loses no line comes out unchanged.

    Texts do not move: the hashes of their lines are looked up in the set of frequent ones, as long as that set is small
    (its size is checked). Beyond that the distinct hashes of each record meet the frequent lines in a join, and what
    returns to a record is the set of its own hashes to delete."""
    blocks = line_blocks(df, id_col, source_col, text_col, min_support).select(_hash(F.col("source"), F.col("line")).alias("h"))
    nodes = materialize(blocks, "block_lines")
    rows = df.select(F.col(id_col).alias("id"), normal_source(F.col(source_col)).alias("source"), F.col(text_col).cast("string").alias("text"))
    hashes = F.transform(normal_lines(F.col("text")), lambda n: F.when(n != "", _hash(F.col("source"), n)))
    rows = rows.select("id", "text", F.when(F.col("source").isNotNull(), hashes).alias("hs"))
    if nodes.count() <= BROADCAST_LINES:
        return _looked_up(rows, [bytes(r.h) for r in nodes.select("h").distinct().toLocalIterator()])
    hit = rows.select("id", F.explode(F.array_distinct("hs")).alias("h")).join(nodes.select("h"), "h", "left_semi")
    drop = hit.distinct().groupBy("id").agg(F.collect_set("h").alias("drop"))
    pieces = F.arrays_zip(F.split("text", "\n").alias("x"), F.col("hs").alias("h"))
    kept = F.transform(F.filter(pieces, lambda p: ~F.coalesce(F.array_contains("drop", p["h"]), F.lit(False))), lambda p: p["x"])
    cleaned = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    removed = F.when(F.col("drop").isNull(), F.lit(0)).otherwise(F.size("hs") - F.size(kept))
    return rows.join(drop, "id", "left").select("id", cleaned.alias("text"), removed.alias("n_removed"))


def _looked_up(rows: DataFrame, frequent: list[bytes]) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(frozenset(frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad = held.value
        for batch in batches:
            texts, counts = [], []
            for text, hs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n = sum(h in bad for h in hs) if text is not None and hs else 0
                texts.append("\n".join(x for x, h in zip(text.split("\n"), hs) if h not in bad) if n else text)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["id", "text", "n_removed"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string, n_removed int")
