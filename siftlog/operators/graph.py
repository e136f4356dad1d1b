"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siftlog.scratch import materialize, release


def _tally(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _star(pairs: DataFrame, keep) -> DataFrame:
    """Hang every neighbour of a node on the smallest member of its neighbourhood.

    The minimum is aggregated map-side, so a hub costs one row per task; the join back is a plain
    inner equi-join, which adaptive execution splits when one node has most of the edges.
    """
    low = pairs.groupBy("u").agg(F.min("v").alias("m"))
    low = low.select("u", F.least("u", "m").alias("m"))
    return pairs.join(low, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``edges(u, v)`` of one ordered type → ``(node, component)``, component = smallest reachable node.

    Nulls and loops are ignored; nodes without an edge do not appear. Every round is written to the
    shared checkpoint folder, so neither lineage nor driver memory grows with the number of rounds. The
    result is such a table too; ``release`` frees it.
    """
    forest = edges.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).distinct()
    forest = materialize(forest, "edges")
    seen = _tally(forest)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = forest.unionByName(forest.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, F.col("v") > F.col("u")).distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        old, forest = forest, materialize(small.where("u <> v").distinct(), "edges")
        release(old)
        before, seen = seen, _tally(forest)
        if before == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = forest.select(F.col("v").alias("node")).distinct()
    found = forest.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
    found = materialize(found, "components")
    release(forest)
    return found
