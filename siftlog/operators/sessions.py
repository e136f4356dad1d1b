"""Inactivity-gap sessions: gaps, threshold fits, sessionization, session summaries, quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from siftlog.functions.scalars import isoformat, seconds_between
from siftlog.operators.quantiles import quantiles
from siftlog.operators.running import prefix_by_chunk

ENTITY = ["source", "host", "src_ip", "user"]
# Event types that mark escalation and persistence, and the reason of unmatched events.
ESCALATION = ("sudo_command", "su_session_opened")
PERSISTENCE = ("account_created", "group_member_added", "password_changed")
UNMATCHED_REASON = "missing user or source IP"
FLOOR = 1e-6


def matched(events: DataFrame) -> DataFrame:
    return events.where("user is not null and src_ip is not null")


def unmatched(events: DataFrame) -> DataFrame:
    """Events without a user or a source address, with the reason."""
    return events.where("user is null or src_ip is null").select("event_id", F.lit(UNMATCHED_REASON).alias("reason"))


def with_previous(events: DataFrame) -> DataFrame:
    """Add ``previous``: the entity's preceding timestamp. Windows run per entity and day; the first event of
    a day takes the last timestamp of the entity's previous day, so a hot entity is spread over its days."""
    own = matched(events).withColumn("day", F.to_date("ts"))
    days = own.groupBy(*ENTITY, "day").agg(F.max("ts").alias("last"))
    days = days.select(*ENTITY, "day", F.lag("last").over(Window.partitionBy(*ENTITY).orderBy("day")).alias("carried"))
    w = Window.partitionBy(*ENTITY, "day").orderBy("ts", "line_no")
    return own.withColumn("inside", F.lag("ts").over(w)).join(days, [*ENTITY, "day"]).withColumn("previous", F.coalesce("inside", "carried")).drop("inside", "carried")


def gaps(events: DataFrame) -> DataFrame:
    """Seconds between consecutive events of an entity."""
    return with_previous(events).where("previous is not null").select(*ENTITY, "event_id", seconds_between("previous", "ts").alias("gap")).where("gap >= 0")


def fit_percentile(gap: DataFrame, q: float = 0.95) -> DataFrame:
    """Interpolated percentile, floored."""
    return quantiles(gap, "gap", {"p": (q, "linear")}).select(F.greatest("p", F.lit(FLOOR)).alias("threshold"))


def fit_mean_std(gap: DataFrame) -> DataFrame:
    """Mean and two sample deviations (none for one gap), floored."""
    return gap.agg(F.greatest(F.avg("gap") + 2 * F.coalesce(F.stddev_samp("gap"), F.lit(0.0)), F.lit(FLOOR)).alias("threshold"))


def fit_knee(gap: DataFrame, q: float = 0.95) -> DataFrame:
    """Z3: the sorted gap farthest from the diagonal; the percentile if there is no knee.

    Works on distinct values with their counts: the distance along a run of equal values is largest at
    one of its ends. Cumulative counts go through coarse value ranges, so no window holds all values.
    """
    values = gap.groupBy("gap").agg(F.count("*").alias("c"))
    ends = gap.agg(F.count("*").alias("n"), F.min("gap").alias("low"), F.max("gap").alias("high"))
    cells = values.crossJoin(F.broadcast(ends)).withColumn("cell", F.when(F.col("high") > F.col("low"), F.floor((F.col("gap") - F.col("low")) / (F.col("high") - F.col("low")) * 1000)).otherwise(0))
    sums = cells.groupBy("cell").agg(F.sum("c").alias("s")).withColumn("all", F.lit(1))
    sums = prefix_by_chunk(sums, ["all"], "cell", "s", "before").select("cell", "before")
    w = Window.partitionBy("cell").orderBy("gap")
    ranked = cells.join(F.broadcast(sums), "cell").withColumn("upto", F.col("before") + F.sum("c").over(w))
    distance = lambda i: F.expr(f"abs({i} / (n - 1) - (gap - low) / (high - low)) / sqrt(2D)")
    ranked = ranked.where("n >= 3 and high > low").withColumn("d", F.greatest(distance("(upto - c)"), distance("(upto - 1)")))
    best = ranked.groupBy().agg(F.max(F.struct(F.col("d"), (-F.col("gap")).alias("g"))).alias("best")).select(F.when(F.col("best.d") >= 0.05, -F.col("best.g")).alias("knee"))
    return best.crossJoin(fit_percentile(gap, q)).select(F.greatest(F.coalesce("knee", "threshold"), F.lit(FLOOR)).alias("threshold"))


def assign_sessions(events: DataFrame, gap_seconds: float) -> DataFrame:
    """Matched events with ``session_no``; a gap of more than ``gap_seconds`` starts a new one."""
    own = matched(events).withColumn("day", F.to_date("ts"))
    w = Window.partitionBy(*ENTITY, "day").orderBy("ts", "line_no")
    far = lambda a, b: F.when(seconds_between(a, b) > gap_seconds, 1).otherwise(0)
    own = own.withColumn("_last", F.lag("ts").over(w))
    own = own.withColumn("inside", F.sum(far("_last", "ts")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_last")
    # A day of an entity folds to its first and last time and its turns; the folds in order number the first session of each.
    days = own.groupBy(*ENTITY, "day").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.max("inside").alias("n"))
    order = Window.partitionBy(*ENTITY).orderBy("day")
    days = days.withColumn("_last", F.lag("last").over(order)).withColumn("fresh", F.when(F.col("_last").isNull(), 1).otherwise(far("_last", "first")))
    upto = F.sum(F.col("fresh") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    days = days.select(*ENTITY, "day", upto.alias("before"))
    return own.join(days, [*ENTITY, "day"]).withColumn("session_no", F.col("before") + F.col("inside")).drop("before", "inside", "day")


def summarize(assigned: DataFrame, gap_seconds: float) -> DataFrame:
    """One row per session with ordered event ids, flags and first values."""
    order = F.struct("ts", "line_no")
    login = F.col("event_type") == "ssh_auth_success"
    first = lambda c: F.min_by(F.col(c), F.when(login & F.col(c).isNotNull(), order))
    out = assigned.groupBy(*ENTITY, "session_no").agg(
        F.min("ts").alias("start_time"),
        F.max("ts").alias("end_time"),
        F.count("*").alias("event_count"),
        F.transform(F.array_sort(F.collect_list(F.struct("ts", "line_no", "event_id"))), lambda x: x["event_id"]).alias("events"),
        first("method").alias("primary_method"),
        first("key_fingerprint").alias("key_fingerprint"),
        F.min_by("src_port", order).alias("src_port"),
        F.bool_or(F.col("event_type").isin(*ESCALATION)).alias("has_escalation"),
        F.bool_or(F.col("event_type").isin(*PERSISTENCE)).alias("has_persistence"),
        F.count_if(F.col("success") == F.lit(False)).alias("failure_count"),
    )
    name = F.concat_ws(":", *ENTITY, isoformat("start_time"))
    return out.withColumn("session_id", name).withColumn("gap_seconds", F.lit(float(gap_seconds))).drop("session_no")


def build_sessions(events: DataFrame, gap_seconds: float) -> DataFrame:
    return summarize(assign_sessions(events, gap_seconds), gap_seconds)


def session_events(sessions: DataFrame) -> DataFrame:
    """``session_id, event_id, ordinal`` from 0."""
    return sessions.select("session_id", F.posexplode("events").alias("ordinal", "event_id"))


def counters(events: DataFrame, failures: DataFrame, sessions: DataFrame) -> DataFrame:
    """``counter, n`` of lines, failures, events, sessions, unmatched events."""
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n")
    lines = one(events, "raw_lines").unionByName(one(failures, "raw_lines")).groupBy("counter").agg(F.sum("n").alias("n"))
    parts = [one(failures, "parse_failures"), one(events, "events"), one(sessions, "complete_sessions"), one(unmatched(events), "unmatched")]
    for p in parts:
        lines = lines.unionByName(p)
    return lines
