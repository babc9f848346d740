"""Connected components by alternating large-star and small-star steps over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.runtime import discard, materialize


def _star(edges: DataFrame, large: bool, salts: int) -> DataFrame:
    """One star step on directed rows (u, v). A node's smallest neighbour is found with partial aggregation and joined
    back, so the neighbours of a hub are never gathered in one place; AQE splits the hub's side of the join."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.filter("v <= u")
    low = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    low = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))) if salts > 1 else low.withColumn("salt", F.lit(0))
    joined = near.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).join(low, ["u", "salt"])
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.filter("salt = 0").select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 40, salts: int = 4) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Rounds are logarithmic in the length of the longest path; each round's edges are written to the shared folder, and a
    round that changed nothing ends the loop (one count and one hash sum go to the driver). Self-loops and repeated
    edges are harmless, rows with a null end are left out, an empty input gives an empty result. RuntimeError if
    ``max_rounds`` did not suffice."""
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    nodes = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()
    cur = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc_edges")
    mark = None
    for _ in range(max_rounds):
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark or not now[0]:
            break
        mark = tuple(now)
        last, cur = cur, materialize(_star(_star(cur, True, salts), False, salts), "cc_round")
        discard(last)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(cur.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
