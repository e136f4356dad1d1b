"""Exact quantiles per group by range refinement: no state holds a group's values."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, LongType

from siftlog.scratch import materialize, release

#: Bits of a double that the passes resolve, from the top.
SHIFTS = (42, 21, 0)


@F.pandas_udf(LongType())
def _rank_bits(x: pd.Series) -> pd.Series:
    """Whole numbers in the order of the doubles; all NaN are one, beyond infinity."""
    raw = pd.Series((x.to_numpy(float) + 0.0)).where(x.notna(), float("nan")).to_numpy().view("int64")
    return pd.Series(raw ^ ((raw >> 63) & 0x7FFFFFFFFFFFFFFF))


@F.pandas_udf(DoubleType())
def _from_bits(k: pd.Series) -> pd.Series:
    raw = k.to_numpy("int64")
    return pd.Series((raw ^ ((raw >> 63) & 0x7FFFFFFFFFFFFFFF)).view("float64"))


def quantiles(rows: DataFrame, value: str, wanted: dict[str, tuple[float, str]], keys: Sequence[str] = ()) -> DataFrame:
    """One row per group with the ``wanted`` quantiles, ``name: (q, "linear" | "nearest")``; nulls don't count.

    Linear ones interpolate at ``q (n - 1)``, nearest ones are the value of rank ``ceil(q n)``. The values
    become whole numbers in the same order; each of three passes counts those that are still in question by
    their next bits, at most 2^22 counts a group, and keeps the cells that hold a wanted rank. Without keys
    there is one row, of nulls for no values; a group of nulls only has no row.
    """
    spark = rows.sparkSession
    group = F.struct(*keys) if keys else F.struct(F.lit(1).alias("one"))
    table = materialize(rows.where(F.col(value).isNotNull()).select(group.alias("g"), _rank_bits(F.col(value).cast("double")).alias("k")), "values")
    # The ranks that are wanted, from 0: both neighbours of a linear one.
    ranks = []
    for name, (q, kind) in wanted.items():
        at = F.lit(q) * (F.col("n") - 1)
        low, high = (F.floor(at), F.ceil(at)) if kind == "linear" else (F.greatest(F.ceil(F.lit(q) * F.col("n")) - 1, F.lit(0)),) * 2
        share = at - F.floor(at) if kind == "linear" else F.lit(0.0)
        ranks += [F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), r.cast("bigint").alias("r"), share.alias("share")) for side, r in (("low", low), ("high", high))]
    targets = None
    scratch = [table]
    for shift in SHIFTS:
        mine = table if targets is None else table.join(targets.select("g", "cell").distinct(), (table["g"] == targets["g"]) & (F.shiftright(table["k"], above) == targets["cell"])).select(table["g"], table["k"])
        counts = materialize(mine.groupBy("g", F.shiftright("k", shift).alias("cell")).agg(F.count("*").alias("c")), "counts")
        scratch.append(counts)
        if targets is None:
            sizes = counts.groupBy("g").agg(F.sum("c").alias("n"))
            targets = sizes.select("g", F.explode(F.array(*ranks)).alias("t")).select("g", "t.*").withColumn("within", F.lit(None).cast("bigint"))
            counts = counts.withColumn("within", F.lit(None).cast("bigint"))
        else:
            targets = targets.withColumnRenamed("cell", "within")
            counts = counts.withColumn("within", F.shiftright("cell", above - shift))
        w = Window.partitionBy("g", "within").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))
        hit = counts.alias("c").join(targets.alias("t"), F.expr("c.g = t.g and c.within <=> t.within")).where("r >= before and r < before + c")
        targets = materialize(hit.select("t.g", "name", "side", (F.col("r") - F.col("before")).alias("r"), "share", "c.cell"), "ranks")
        scratch.append(targets)
        above = shift
    found = targets.withColumn("v", F.coalesce(_from_bits("cell"), F.lit(float("nan"))))  # NaN leaves the function as null
    pick = lambda name, side: F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col("v")))
    share = lambda name: F.max(F.when(F.col("name") == name, F.col("share")))
    value_of = {}
    for name, (_, kind) in wanted.items():
        low, high = pick(name, "low"), pick(name, "high")
        value_of[name] = F.when(low == high, low).otherwise((1 - share(name)) * low + share(name) * high) if kind == "linear" else low
    per = found.groupBy("g").agg(*(c.alias(n) for n, c in value_of.items()))
    out = materialize(per.select(*([F.col(f"g.{k}").alias(k) for k in keys]), *wanted), "quantiles")
    release(*scratch)
    if not keys and not out.limit(1).count():
        return spark.createDataFrame([(None,) * len(wanted)], ", ".join(f"{n} double" for n in wanted))
    return out
