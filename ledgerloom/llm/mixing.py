"""Mixing sources to target weights by hash-threshold histograms.

Each source gets a budget of tokens: its share of the total. Whole repeats of a source that fit are given to every record;
the rest is filled by the records whose hash lies under a threshold. Thresholds come from histograms: tokens are summed by
source and hash bucket, the bucket in which the running sum crosses the budget is found, and only the records of that
bucket are summed again by the next bits of the hash, until the boundary bucket is a single hash. Nothing is sorted, and
the records drawn for a budget are a subset of those drawn for a larger one.

Defined results: records with a null source, a source without target, or no tokens are not drawn; a target whose source
has no tokens reaches 0; if no total is given it is the largest that every source with tokens can serve within its
repeats, so that shares come out in the proportion of the targets; with a larger total the short sources are repeated to
their cap and the others fill their own budgets. Equal ids hash alike and are drawn together. Empty tables give the
targets with zeros. A target with ``max_repeats`` 0 is never drawn and does not limit the total; a null cap counts as 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.tokens import encode
from ledgerloom.runtime import materialize

#: 4 levels of 2^12 buckets: 48 bits of the hash decide. Histograms have at most 4,096 rows a source and level.
LEVELS, BITS = 4, 12


def _bucket(level: int):
    return F.shiftright(F.col("h"), BITS * (LEVELS - 1 - level)).bitwiseAND((1 << BITS) - 1).cast("int")


def sized(df: DataFrame, id_col: str, text_col: str, source_col: str, vocabulary: str = "byte_bpe_50k", **where) -> DataFrame:
    """id, source, n_tokens, h (48-bit hash of the id) of records that have a source and tokens; written once."""
    rows = df.select(F.struct(F.col(id_col).alias("id"), F.col(source_col).alias("source")).alias("r"), F.col(text_col).alias("text")).filter("r.source is not null and text <> ''")
    counted = encode(rows, "r", "text", vocabulary, count_only=True, **where)
    return materialize(counted.select("r.id", "r.source", F.col("n_tokens").cast("bigint").alias("n_tokens"), F.shiftrightunsigned(F.xxhash64("r.id"), 64 - BITS * LEVELS).alias("h")), "mix_sized")


def budgets(rows: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """source, target_share, max_repeats, have, budget, repeats (whole), rest: one row per target. Sums per source are made with
    map-side combining; the table has as many rows as there are targets."""
    have = rows.groupBy("source").agg(F.sum("n_tokens").alias("have"), F.count(F.lit(1)).alias("n_records"))
    t = targets.select("source", F.col("target_share").cast("double").alias("target_share"), F.greatest(F.coalesce(F.col("max_repeats"), F.lit(1)), F.lit(0)).cast("bigint").alias("max_repeats"))
    t = t.filter("source is not null and target_share is not null").join(have, "source", "left").fillna(0, ["have", "n_records"])
    able = F.when((F.col("have") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0), F.col("max_repeats") * F.col("have") / F.col("target_share"))
    whole = F.lit(float(total_tokens)) if total_tokens is not None else F.coalesce(t.select(F.min(able).alias("x")).scalar(), F.lit(0.0))
    t = t.withColumn("budget", F.least(F.floor(F.col("target_share") * whole + F.lit(1e-6)), F.col("max_repeats") * F.col("have")).cast("bigint"))
    t = t.withColumn("repeats", F.expr("budget div greatest(have, 1)"))
    return t.withColumn("rest", F.col("budget") - F.col("repeats") * F.col("have"))


def thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """source, cut: records with h < cut get one copy more than the whole repeats; their tokens stay within the rest.

    On every level only the records of each source's boundary bucket are summed. The rest is below the tokens at hand, so a
    boundary exists on each level: the first bucket that does not fit. What shares all 48 bits at the end stays out."""
    state = plan.filter("rest > 0").select("source", F.col("rest").alias("left"), F.lit(0).cast("bigint").alias("prefix"))
    for level in range(LEVELS):
        inside = rows.join(_small(state), "source")  # one row per target
        if level:
            inside = inside.filter(F.shiftright("h", BITS * (LEVELS - level)) == F.col("prefix"))
        hist = inside.groupBy("source", "prefix", "left", _bucket(level).alias("b")).agg(F.sum("n_tokens").alias("n"))
        run = hist.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("b")))
        edge = run.groupBy("source", "prefix", "left").agg(
            F.min(F.when(F.col("upto") > F.col("left"), F.col("b"))).alias("b"),
            F.coalesce(F.max(F.when(F.col("upto") <= F.col("left"), F.col("upto"))), F.lit(0)).alias("used"),
        )
        state = materialize(edge.select("source", (F.col("left") - F.col("used")).alias("left"), (F.shiftleft("prefix", BITS) + F.col("b")).alias("prefix")), f"mix_level{level}")
    return state.select("source", F.col("prefix").alias("cut"))


#: Targets up to which the plan (some hundred bytes a row) is broadcast; with more of them it is joined by shuffle.
BROADCAST_TARGETS = 100_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_TARGETS else df


class Mixture:
    def __init__(self, df: DataFrame, targets: DataFrame, id_col: str, text_col: str, source_col: str, total_tokens: int | None = None, vocabulary: str = "byte_bpe_50k", **where):
        self.rows = sized(df, id_col, text_col, source_col, vocabulary, **where)
        self.plan = materialize(budgets(self.rows, targets, total_tokens), "mix_plan")
        self.cuts = materialize(thresholds(self.rows, self.plan), "mix_cuts")

    def drawn(self) -> DataFrame:
        """id, source, n_tokens, copies of every record drawn at least once: a filter over the rows, no sort, no shuffle (the
        plan has one row per target and is broadcast)."""
        per = self.plan.select("source", "repeats").join(self.cuts, "source", "left")
        out = self.rows.join(_small(per), "source")
        copies = F.col("repeats") + F.when(F.col("h") < F.coalesce("cut", F.lit(0)), 1).otherwise(0)
        return out.select("id", "source", "n_tokens", copies.cast("int").alias("copies")).filter("copies > 0")

    def shares(self) -> DataFrame:
        """source, target_share, max_repeats, tokens_available, tokens_drawn, records_drawn, actual_share: one row per target."""
        got = self.drawn().groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_drawn"), F.sum("copies").alias("records_drawn"))
        t = self.plan.select("source", "target_share", "max_repeats", F.col("have").alias("tokens_available")).join(got, "source", "left").fillna(0, ["tokens_drawn", "records_drawn"])
        total = t.agg(F.sum("tokens_drawn")).scalar()
        return t.withColumn("actual_share", F.coalesce(F.col("tokens_drawn") / total, F.lit(0.0)))

    def checked(self) -> DataFrame:
        """source, within_budget, filled, within_cap: what must hold for every target. The tokens drawn stay within the budget
        and miss it by less than the source's largest record; no record is used more often than its cap."""
        top = self.rows.groupBy("source").agg(F.max("n_tokens").alias("largest"))
        got = self.drawn().groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("drawn"), F.max("copies").alias("most"))
        t = self.plan.join(got, "source", "left").join(top, "source", "left").fillna(0, ["drawn", "most", "largest"])
        return t.select("source", (F.col("drawn") <= F.col("budget")).alias("within_budget"), (F.col("budget") - F.col("drawn") <= F.col("largest")).alias("filled"), (F.col("most") <= F.col("max_repeats")).alias("within_cap"))
