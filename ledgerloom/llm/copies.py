"""Records that are the same up to formatting: canonical form, 128-bit hash, counts with map-side combining.

The canonical form keeps the lower-cased letters and digits of the text in order. A text that splits at tabs, line breaks,
semicolons and vertical bars into two or more nonblank parts, each holding ``:`` or ``=``, is a record of fields: its
parts are canonicalized one by one and sorted, so their order does not matter.

Defined results: rows with a null id or scope or a text that is null or without letter or digit belong to no group and are left
out; ties are settled by the smallest id; a row that occurs twice with the same id counts as two copies; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.skew import HOT_ROWS, join_groups
from ledgerloom.runtime import materialize

_CUT = "[\\t\\n\\u000B\\f\\r\\u0085\\u2028\\u2029;|]"
_DROP = r"[^\p{L}\p{N}]+"


def canonical_text(text: Column) -> Column:
    """Letters and digits in lower case; the parts of a record of fields are sorted. Texts without a sign of assignment
    skip the splitting."""
    parts = F.filter(F.split(text, _CUT), lambda p: p.rlike(r"[^\s\p{Z}\x{85}\x{1C}-\x{1F}]"))
    is_fields = (F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))) & text.rlike(_CUT) & (F.size(parts) > 1) & F.forall(parts, lambda p: F.contains(p, F.lit(":")) | F.contains(p, F.lit("=")))
    canon = lambda s: F.regexp_replace(F.lower(s), _DROP, "")
    return F.when(is_fields, F.array_join(F.array_sort(F.transform(parts, canon)), "")).otherwise(canon(text))


def _hashed(df: DataFrame, id_col: str, text_col: str, scope: Column | None) -> DataFrame:
    body = canonical_text(F.col(text_col).cast("string"))
    src = df.select(F.col(id_col).alias("id"), body.alias("body"), (scope if scope is not None else F.lit("")).alias("scope")).filter((F.col("body") != "") & F.col("scope").isNotNull() & F.col("id").isNotNull())
    whole = F.concat_ws("\u0000", "scope", "body")
    return src.select("id", F.unhex(F.md5(whole)).alias("h"), F.xxhash64(whole, F.length("body")).alias("h2"))


def digits_of(column: str) -> Column:
    return F.regexp_replace(F.col(column), r"[^\p{Nd}]+", "")


def copy_groups(df: DataFrame, id_col: str, text_col: str, scope: Column | None = None, with_members: bool = False):
    """One row per distinct record: keep_id (smallest id), n_copies, key (hex of the 128-bit hash).

    Rows shrink to 24 bytes of hashes before the shuffle and are combined on the map side, so a key that holds a third of
    all rows costs each reducer one row per map task. The second, independent hash is part of the grouping: two records
    that collided in 128 bits would still be told apart (``h2`` differs), so no collision merges records."""
    keyed = _hashed(df, id_col, text_col, scope)
    if with_members:
        keyed = materialize(keyed, "copy_keys")
    groups = keyed.groupBy("h", "h2").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n_copies"))
    return (groups, keyed) if with_members else groups.select("keep_id", "n_copies", F.hex("h").alias("key"))


def copy_pairs(df: DataFrame, id_col: str, text_col: str, scope: Column | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per copy other than the kept one: keep_id, copy_id.

    Only keys with several rows go into the join. The counts, which are at hand, tell the hot keys: rows of those meet their
    key where they are (see ``join_groups``); nothing is collected per key."""
    groups, keyed = copy_groups(df, id_col, text_col, scope, with_members=True)
    several = materialize(groups.filter("n_copies > 1"), "copy_groups")
    return join_groups(keyed, several, ["h", "h2"], "n_copies", hot_rows).filter("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))
