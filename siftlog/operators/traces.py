"""Block-trace anomaly benchmark: bounds, splits, transition baseline, length rarity, blends, selection, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftlog.functions.scalars import wilson
from siftlog.operators.quantiles import quantiles

# Start symbol, length bins, blends in order of simplicity, quantiles.
START = "<start>"
LENGTH_BINS = (2, 5, 10, 20, 50, 100)
CANDIDATES = ("mean", "mean_length", "mean_peak", "mean_length_peak")
QUANTILES = (0.95, 0.97, 0.99)


def block_bounds(lines: DataFrame, pattern: str = r"(blk_-?[0-9]+)") -> DataFrame:
    """B1: first and last line of each block id of ``lines(line_no, text)``; an id counts once a line."""
    found = lines.select("line_no", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), 1))).alias("block"))
    return found.groupBy("block").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


def boundary_lines(bounds: DataFrame, train: float = 0.6, validation: float = 0.2) -> tuple[int, int]:
    """B2: the first lines at ranks int(n * train) and int(n * (train + validation)).

    First lines are counted in coarse ranges, and only the range that holds a rank is ordered.
    """
    n, low, high = bounds.agg(F.count("*"), F.min("first_line"), F.max("first_line")).first()
    if n < 5:
        raise ValueError("at least five blocks are needed")
    width = max(1, (high - low) // 1000 + 1)
    cells = {r["c"]: r["n"] for r in bounds.groupBy(((F.col("first_line") - low) / width).cast("bigint").alias("c")).agg(F.count("*").alias("n")).collect()}

    def at(rank: int) -> int:
        before = 0
        for c in sorted(cells):
            if before + cells[c] > rank:
                inside = bounds.where((F.col("first_line") >= low + c * width) & (F.col("first_line") < low + (c + 1) * width))
                return inside.orderBy("first_line").offset(rank - before).limit(1).first()["first_line"]
            before += cells[c]
        raise ValueError("rank beyond the blocks")

    return at(int(n * train)), at(int(n * (train + validation)))


def split_by_bounds(bounds: DataFrame, train_end: int, validation_end: int) -> DataFrame:
    """Train, validation, evaluation, or cross for a block that spans a boundary."""
    split = F.when(F.col("last_line") < train_end, "train").when((F.col("first_line") >= train_end) & (F.col("last_line") < validation_end), "validation").when(F.col("first_line") >= validation_end, "evaluation").otherwise("cross")
    return bounds.withColumn("split", split)


def integrity(log_blocks: DataFrame, label_blocks: DataFrame, trace_blocks: DataFrame) -> DataFrame:
    """``block, missing`` for blocks that one of the three sets lacks or has twice."""
    parts = [df.select("block", F.lit(n).alias("source")) for n, df in (("log", log_blocks), ("labels", label_blocks), ("traces", trace_blocks))]
    counts = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("block").pivot("source", ["log", "labels", "traces"]).count().na.fill(0)
    faults = F.filter(F.array(*(F.when(F.col(c) == 0, F.lit(f"no_{c}")).when(F.col(c) > 1, F.lit(f"repeated_{c}")) for c in ("labels", "traces")), F.when(F.col("log") == 0, F.lit("no_log"))), lambda x: x.isNotNull())
    return counts.select("block", F.explode(faults).alias("fault"))


def steps(traces: DataFrame) -> DataFrame:
    """``block, context, event`` with a start symbol before the first event of ``traces(block, events)``."""
    pairs = F.arrays_zip(F.concat(F.array(F.lit(START)), F.slice("events", 1, F.greatest(F.size("events") - 1, F.lit(0)))).alias("context"), F.col("events").alias("event"))
    return traces.where("size(events) > 0").select("block", F.explode(pairs).alias("p")).select("block", "p.context", "p.event")


def fit_baseline(normal: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Pair counts, context counts and vocabulary size of normal training traces."""
    pairs = steps(normal).groupBy("context", "event").agg(F.count("*").alias("c"))
    return pairs, pairs.groupBy("context").agg(F.sum("c").alias("n")), pairs.select("event").distinct().count()


def surprise(traces: DataFrame, baseline: tuple[DataFrame, DataFrame, int]) -> DataFrame:
    """Mean and peak of -ln((c + 1) / (n + V + 1)) per block; the added one is the unseen event."""
    pairs, contexts, vocabulary = baseline
    found = steps(traces).join(pairs, ["context", "event"], "left").join(contexts, "context", "left").na.fill(0, ["c", "n"])
    s = -F.log((F.col("c") + 1) / (F.col("n") + vocabulary + 1))
    return found.groupBy("block").agg(F.avg(s).alias("mean"), F.max(s).alias("peak"))


def length_bin(n: str) -> Column:
    """The first bin whose edge a length does not exceed."""
    out = F.when(F.col(n) <= LENGTH_BINS[0], F.lit(str(LENGTH_BINS[0])))
    for edge in LENGTH_BINS[1:]:
        out = out.when(F.col(n) <= edge, F.lit(str(edge)))
    return out.otherwise(F.lit(">100"))


def length_rarity(normal: DataFrame, traces: DataFrame) -> DataFrame:
    """-ln((count of the bin + 1) / (normal traces + bins)) of each trace's length."""
    bins = normal.select(length_bin("length").alias("bin")).groupBy("bin").agg(F.count("*").alias("c"))
    total = F.broadcast(normal.agg(F.count("*").alias("n")))
    out = traces.withColumn("bin", length_bin("length")).join(F.broadcast(bins), "bin", "left").crossJoin(total)
    return out.withColumn("rarity", -F.log((F.coalesce("c", F.lit(0)) + 1) / (F.col("n") + len(LENGTH_BINS) + 1))).drop("c", "n")


def blends(scored: DataFrame) -> DataFrame:
    """The four fixed blends of mean, peak and rarity, long: ``block, candidate, score``."""
    values = {"mean": F.col("mean"), "mean_length": F.col("mean") + F.col("rarity"), "mean_peak": F.col("mean") + F.col("peak"), "mean_length_peak": F.col("mean") + F.col("rarity") + F.col("peak")}
    listed = F.array(*(F.struct(F.lit(k).alias("candidate"), v.alias("score"), F.lit(i).alias("rank")) for i, (k, v) in enumerate(values.items())))
    return scored.select("*", F.explode(listed).alias("x")).select("*", "x.*").drop("x")


def normal_threshold(scores: DataFrame, q: float) -> float:
    """Nearest-rank quantile of normal scores; an alert lies above it."""
    return quantiles(scores.where("not anomaly"), "score", {"threshold": (q, "nearest")}).first()[0]


def confusion(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts, precision, recall and F1 with Wilson bounds of ``rows(anomaly, alert)``; null without a denominator."""
    counts = rows.groupBy(*keys).agg(
        F.count_if(F.col("anomaly") & F.col("alert")).alias("tp"), F.count_if(F.col("anomaly") & ~F.col("alert")).alias("fn"),
        F.count_if(~F.col("anomaly") & F.col("alert")).alias("fp"), F.count_if(~F.col("anomaly") & ~F.col("alert")).alias("tn"),
    )
    rates = {"precision": "try_divide(tp, tp + fp)", "recall": "try_divide(tp, tp + fn)", "f1": "try_divide(2 * tp, 2 * tp + fp + fn)"}
    out = counts.withColumns({k: F.expr(v) for k, v in rates.items()})
    return out.withColumns({"precision_low": wilson("tp", "(tp + fp)", False), "precision_high": wilson("tp", "(tp + fp)", True), "recall_low": wilson("tp", "(tp + fn)", False), "recall_high": wilson("tp", "(tp + fn)", True)})


def selection_grid(validation: DataFrame) -> DataFrame:
    """Confusion of every (candidate, quantile) with the threshold of the normals' scores."""
    thresholds = quantiles(validation.where("not anomaly"), "score", {f"t{i}": (q, "nearest") for i, q in enumerate(QUANTILES)}, ("candidate", "rank"))
    listed = F.explode(F.array(*(F.struct(F.lit(q).alias("quantile"), F.col(f"t{i}").alias("threshold")) for i, q in enumerate(QUANTILES))))
    thresholds = thresholds.select("candidate", listed.alias("x")).select("candidate", "x.*")
    rows = validation.join(F.broadcast(thresholds), "candidate").withColumn("alert", F.col("score") > F.col("threshold"))
    return confusion(rows, ("candidate", "rank", "quantile", "threshold"))


def choose(grid: DataFrame, min_recall: float = 0.95) -> DataFrame:
    """Best precision with enough recall, then recall, simpler candidate, lower quantile; else the first cell."""
    enough = F.coalesce(F.col("recall") >= min_recall, F.lit(False))
    order = [F.desc(enough), F.when(enough, F.coalesce("precision", F.lit(-1.0))).desc(), F.when(enough, F.col("recall")).desc(), "rank", "quantile"]
    return grid.orderBy(*order).limit(1)


def first_errors(rows: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` blocks, by id, of each kind of error."""
    kind = F.when(F.col("anomaly") & ~F.col("alert"), "missed").when(~F.col("anomaly") & F.col("alert"), "false_alert")
    w = Window.partitionBy("kind").orderBy("block")
    return rows.withColumn("kind", kind).where("kind is not null").withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("kind", "place", "block")


def error_analysis(rows: DataFrame) -> DataFrame:
    """Errors and hits by length bin."""
    kind = F.when(F.col("anomaly"), F.when(F.col("alert"), "tp").otherwise("fn")).otherwise(F.when(F.col("alert"), "fp").otherwise("tn"))
    return rows.groupBy(kind.alias("kind"), length_bin("length").alias("bin")).agg(F.count("*").alias("n"), F.min_by("block", F.struct("first_line", "block")).alias("first_block"), F.max_by("block", F.struct("first_line", "block")).alias("last_block"), F.min("length").alias("shortest"), F.max("length").alias("longest"))


def inspect_blocks(lines: DataFrame, blocks: DataFrame, n: int) -> DataFrame:
    """The first ``n`` lines of each wanted block and whether there are more."""
    own = lines.join(blocks, "block", "left_semi")
    w = Window.partitionBy("block").orderBy("line_no")
    ranked = own.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n + 1)
    return ranked.withColumn("truncated", F.max("place").over(Window.partitionBy("block")) > n).where(F.col("place") <= n)
