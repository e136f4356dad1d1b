"""Running counts per key that survive a hot key: windows per (key, chunk), carried by prefix sums of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from siftlog.scratch import materialize


def prefix_by_chunk(chunks: DataFrame, keys: list[str], chunk: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over earlier chunks of a key; ``chunks`` has one row per key and chunk."""
    w = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))


def count_before(opens: DataFrame, closes: DataFrame, keys: list[str], at: str, out: str, spread: bool = True) -> DataFrame:
    """``opens`` with the number of ``closes`` of the same keys at a strictly earlier ``at``.

    A null key counts as 0. Within a day closes are counted in order, with opens first at equal times;
    earlier days come as one sum per key and day, so one key's rows are spread over its days. Without ``spread``,
    for keys that hold a span of time themselves, it is one window.
    """
    known = F.expr(" and ".join(f"{k} is not null" for k in keys))
    if not spread:
        marks = opens.withColumn("_close", F.lit(0)).unionByName(closes.select(*keys, at, F.lit(1).alias("_close")), allowMissingColumns=True)
        w = Window.partitionBy(*keys).orderBy(at, "_close").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return marks.withColumn(out, F.when(known, F.sum("_close").over(w)).otherwise(F.lit(0)).cast("bigint")).where("_close = 0").drop("_close")
    day = F.to_date(at)
    marks = opens.withColumns({"_day": day, "_close": F.lit(0)}).unionByName(
        closes.select(*keys, at).withColumns({"_day": day, "_close": F.lit(1)}), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys, "_day").orderBy(at, "_close").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = marks.withColumn("_in", F.sum("_close").over(w)).where("_close = 0").drop("_close")
    days = marks.groupBy(*keys, "_day").agg(F.sum("_close").alias("_n"))
    days = prefix_by_chunk(days, keys, "_day", "_n", "_before").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_day").alias("_d"), "_before")
    same = F.expr(" and ".join([*(f"{k} <=> _{k}" for k in keys), "_day = _d"]))
    found = inside.join(days, same, "left")
    return found.withColumn(out, F.when(known, F.col("_in") + F.coalesce("_before", F.lit(0))).otherwise(F.lit(0)).cast("bigint")).drop("_in", "_before", "_d", "_day", *[f"_{k}" for k in keys])


def numbered(rows: DataFrame, keys: list[str], order: list[str], out: str, spread: bool = True) -> DataFrame:
    """``rows`` with their place from 0 by key in ``order``, whose first column is a time: days are numbered alone and shifted (``spread`` as in ``count_before``)."""
    if not spread:
        return rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    own = rows.withColumn("_day", F.to_date(order[0]))
    days = own.groupBy(*keys, "_day").agg(F.count("*").alias("_n"))
    days = prefix_by_chunk(days, keys, "_day", "_n", "_before").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_day").alias("_d"), "_before")
    w = Window.partitionBy(*keys, "_day").orderBy(*order)
    same = F.expr(" and ".join([*(f"{k} <=> _{k}" for k in keys), "_day <=> _d"]))
    placed = own.withColumn("_in", F.row_number().over(w) - 1).join(days, same)
    return placed.withColumn(out, F.col("_before") + F.col("_in")).drop("_in", "_before", "_d", "_day", *[f"_{k}" for k in keys])


def count_dominated(queries: DataFrame, points: DataFrame, keys: list[str], identifier: str, x: str, y: str, out: str, spread: bool = True) -> DataFrame:
    """``identifier, out``: points of the query's key that are strictly earlier in both times ``x`` and ``y``.

    Points are numbered by ``x``. The points before a query in ``x`` are then a prefix of numbers, which falls
    into at most one aligned block of each power of two; a point tells its block of every size, so each pair
    of block and query is a count of one time only (``count_before``). Rows grow by the logarithm of a key's
    points, whatever the key. ``identifier`` names the queries; queries without such points have no row.
    """
    placed = count_before(queries.select(identifier, *keys, F.col(x).alias("_at"), F.col(y).alias("_y")), points.select(*keys, F.col(x).alias("_at")), keys, "_at", "_prefix", spread)
    ranked = numbered(points.select(*keys, F.col(x).alias("_at"), F.col(y).alias("_y")), keys, ["_at", "_y"], "_place", spread)
    placed, ranked = materialize(placed.where("_prefix > 0"), "prefixes"), materialize(ranked, "places")
    most = ranked.agg(F.max("_place")).first()[0] or 0
    sizes = F.sequence(F.lit(0), F.lit(int(most).bit_length()))
    # A prefix of length p has the block (p >> s) - 1 of size 2^s for every bit s that it sets; these are even blocks.
    asked = F.filter(F.transform(sizes, lambda s: F.struct(s.alias("_size"), (F.call_function("shiftright", F.col("_prefix"), s) - 1).alias("_block"))), lambda b: b["_block"] % 2 == 0)
    told = F.filter(F.transform(sizes, lambda s: F.struct(s.alias("_size"), F.call_function("shiftright", F.col("_place"), s).alias("_block"))), lambda b: b["_block"] % 2 == 0)
    opens = placed.select(identifier, *keys, F.col("_y").alias("_at"), F.explode(asked).alias("b")).select(identifier, *keys, "_at", "b.*")
    closes = ranked.select(*keys, F.col("_y").alias("_at"), F.explode(told).alias("b")).select(*keys, "_at", "b.*")
    found = count_before(opens, closes, [*keys, "_size", "_block"], "_at", out, spread)
    return found.groupBy(identifier).agg(F.sum(out).alias(out))


def aggregate_before(opens: DataFrame, closes: DataFrame, keys: list[str], at: str, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """``opens`` with aggregates over the ``closes`` of the same keys at a strictly earlier ``at``: ``out: ("sum" | "min" | "max", column)``.

    As in ``count_before``: days of a key are gone through alone, and earlier days come as one row. Without
    such closes the aggregates are null.
    """
    over = {"sum": F.sum, "min": F.min, "max": F.max}
    both = {"sum": lambda a, b: F.coalesce(a + b, a, b), "min": F.least, "max": F.greatest}
    day = F.to_date(at)
    marks = opens.withColumns({"_day": day, "_close": F.lit(0)}).unionByName(
        closes.select(*keys, at, *(F.col(c).alias(f"_v_{out}") for out, (_, c) in wanted.items())).withColumns({"_day": day, "_close": F.lit(1)}), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys, "_day").orderBy(at, "_close").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = marks.withColumns({f"_in_{out}": over[f](f"_v_{out}").over(w) for out, (f, _) in wanted.items()}).where("_close = 0")
    days = marks.groupBy(*keys, "_day").agg(*(over[f](f"_v_{out}").alias(f"_d_{out}") for out, (f, _) in wanted.items()))
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_day").alias("_d"), *(over[f](f"_d_{out}").over(before).alias(f"_b_{out}") for out, (f, _) in wanted.items()))
    found = inside.join(days, F.expr(" and ".join([*(f"{k} <=> _{k}" for k in keys), "_day <=> _d"])), "left")
    return found.select(*opens.columns, *(both[f](F.col(f"_b_{out}"), F.col(f"_in_{out}")).alias(out) for out, (f, _) in wanted.items()))
