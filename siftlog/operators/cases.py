"""Evidence search, lookups, entity history and the case queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftlog.operators.evaluate import latest_runs
from siftlog.operators.running import aggregate_before
from siftlog.scratch import materialize


def search_events(events: DataFrame, unmatched: DataFrame, text: str | None = None, host: str | None = None, user: str | None = None, src_ip: str | None = None, start=None, end=None, membership: str = "any", after: tuple | None = None, limit: int = 50) -> DataFrame:
    """P10: events by literal text in any ASCII case, entity, half-open time window and membership.

    A page in the order (ts, event_id), after a key of that order.
    """
    out = events.join(unmatched.select("event_id", F.col("reason").alias("unmatched_reason")), "event_id", "left")
    if text:
        wanted = F.lit(text.lower())
        out = out.where(F.lower("message").contains(wanted) | F.lower("raw_message").contains(wanted))
    for column, value in (("host", host), ("user", user), ("src_ip", src_ip)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if start is not None:
        out = out.where(F.col("ts") >= F.lit(start))
    if end is not None:
        out = out.where(F.col("ts") < F.lit(end))
    if membership != "any":
        out = out.where(F.col("unmatched_reason").isNotNull() if membership == "unmatched" else F.col("unmatched_reason").isNull())
    if after is not None:
        out = out.where((F.col("ts") > F.lit(after[0])) | ((F.col("ts") == F.lit(after[0])) & (F.col("event_id") > after[1])))
    return out.orderBy("ts", "event_id").limit(limit)


def truncate(column: str, most: int) -> Column:
    return F.when(F.length(column) > most, F.concat(F.substring(column, 1, most), F.lit("...[truncated]"))).otherwise(F.col(column))


def lookup_events(ids: DataFrame, events: DataFrame, unmatched: DataFrame, most: int = 200) -> DataFrame:
    """Each wanted id with its event, cut text and the reason if it is in no session."""
    found = ids.join(events, "event_id", "left").join(unmatched, "event_id", "left")
    return found.select("event_id", "ts", "event_type", truncate("raw_message", most).alias("raw_message"), F.col("reason").alias("unmatched_reason"), F.col("ts").isNotNull().alias("found"))


def page_of_session(session_events: DataFrame, events: DataFrame, after_ordinal: int, limit: int) -> DataFrame:
    """Events of each session after an ordinal, at most ``limit`` of each."""
    page = session_events.where((F.col("ordinal") > after_ordinal) & (F.col("ordinal") <= after_ordinal + limit))
    return page.join(events.select("event_id", "ts", "event_type"), "event_id")


def entity_history(entities: DataFrame, sessions: DataFrame) -> DataFrame:
    """Q1: history of ``entities(entity_type, entity_id, before)`` from sessions that ended before.

    One pass of running aggregates by entity and day; a distinct partner counts from the first end of a session
    that has it. No boundary meets the sessions of its entity one by one.
    """
    keys, partners = ["entity_type", "entity_id"], {"host": "hosts", "user": "users", "src_ip": "src_ips"}
    asks = materialize(entities.select(*keys, "before").where("entity_id is not null").distinct(), "boundaries")
    asked = {r[0] for r in asks.where(F.col("entity_type").isin("user", "src_ip", "host")).select("entity_type").distinct().collect()}
    kinds = sorted(asked) or ["user"]
    last = F.broadcast(asks.agg(F.max("before").alias("last")))
    own = sessions.select(F.col("end_time").alias("at"), "start_time", F.col("event_count").cast("bigint").alias("event_count"), "user", "src_ip", "host").crossJoin(last).where("at < last").drop("last")
    kind = lambda k: (F.lit(k).alias("entity_type"), F.col(k).cast("string").alias("entity_id"))
    one = F.lit(1).cast("bigint")
    ends = own.select("at", "start_time", "event_count", one.alias("one"), F.col("at").alias("ended"), F.inline(F.array(*(F.struct(*kind(k)) for k in kinds)))).where("entity_id is not null")
    # The entity itself is a partner of its own kind as soon as it has a session.
    pairs = F.inline(F.array(*(F.struct(*kind(k), F.lit(c).alias("column"), F.col(c).cast("string").alias("other")) for k in kinds for c in partners if c != k)))
    first = own.select("at", pairs).where("entity_id is not null and other is not null").groupBy(*keys, "column", "other").agg(F.min("at").alias("at"))
    first = first.select("at", *keys, *(F.when(F.col("column") == c, one).alias(name) for c, name in partners.items()))
    wanted = {"sessions": ("sum", "one"), "events": ("sum", "event_count"), "window_start": ("min", "start_time"), "window_end": ("max", "ended")} | {n: ("sum", n) for n in partners.values()}
    out = aggregate_before(asks.withColumn("at", F.col("before")), ends.unionByName(first, allowMissingColumns=True), keys, "at", wanted).drop("at")
    out = out.withColumns({name: F.when((F.col("entity_type") == c) & (F.col("sessions") > 0), one).otherwise(F.col(name)) for c, name in partners.items()})
    return entities.join(out, [*keys, "before"], "left").na.fill(0, ["sessions", "events", *partners.values()])


def history_page(entities: DataFrame, sessions: DataFrame, limit: int) -> DataFrame:
    """Q1: the first ``limit`` sessions of each entity's history by (start, id)."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("entity_type"), F.col(k).alias("entity_id")) for k in ("user", "src_ip", "host"))))
    hit = entities.join(sessions.select("*", kinds.alias("k")).select("session_id", "start_time", "end_time", "k.*"), ["entity_type", "entity_id"]).where("end_time < before")
    w = Window.partitionBy("entity_type", "entity_id").orderBy("start_time", "session_id")
    return hit.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def normality_context(wanted: DataFrame, context: DataFrame, readiness: DataFrame) -> DataFrame:
    """Q2: history columns of the wanted sessions with the readiness of every model."""
    models = readiness.agg(F.array_sort(F.collect_list(F.struct("model_id", "ready", "reason"))).alias("models"))
    return wanted.join(context, "session_id", "left").crossJoin(F.broadcast(models))


def case_id(session: str = "session_id") -> Column:
    return F.concat(F.lit("case-"), F.substring(F.sha2(session, 256), 1, 20))


def case_queue(sessions: DataFrame, candidates: DataFrame, runs: DataFrame, dispositions: DataFrame, ready: bool, offset: int = 0, limit: int = 50) -> DataFrame:
    """Q3: sessions with latest score, run and disposition; by score (unscored last) when a model is ready, else by time.

    Of scores and dispositions of the same time the larger one counts.
    """
    w = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc_nulls_last("score"))
    scores = candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("session_id", "score")
    last = latest_runs(runs, "session_id").select("session_id", "run_id", "state")
    w = Window.partitionBy("case_id").orderBy(F.desc("decided_at"), F.desc_nulls_last("disposition"))
    decided = dispositions.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("case_id", "disposition")
    out = sessions.withColumn("case_id", case_id()).join(scores, "session_id", "left").join(last, "session_id", "left").join(decided, "case_id", "left")
    order = ([F.desc_nulls_last("score")] if ready else []) + [F.col("start_time"), F.col("session_id")]
    return out.orderBy(*order).offset(offset).limit(limit)


def case_details(cases: DataFrame, sessions: DataFrame, session_events: DataFrame, events: DataFrame, most: int = 200) -> DataFrame:
    """Q4: first events of each wanted case."""
    own = sessions.withColumn("case_id", case_id()).join(cases, "case_id", "left_semi").select("case_id", "session_id")
    return own.join(session_events.where(F.col("ordinal") < most), "session_id").join(events.select("event_id", "ts", "event_type"), "event_id")


def run_outcome() -> Column:
    """Q5: how a run ended, from its state, flags and reason."""
    reason = F.coalesce("incomplete_reason", F.lit(""))
    return (
        F.when(F.col("state").isin("pending", "running"), "in_progress").when(F.col("state") == "completed", "report_published").when(F.col("state") == "cancelled", "cancelled")
        .when(F.coalesce("interrupted", F.lit(False)), "interrupted").when(F.coalesce("grounding_failed", F.lit(False)), "grounding_failed")
        .when(reason.contains("budget exhausted"), "budget_exhausted").when(reason.contains("provider") | reason.contains("_AGENT"), "provider_unavailable").otherwise("failed")
    )


def run_summary(runs: DataFrame) -> DataFrame:
    """Q6: by session the runs, those of each state, and the latest."""
    key = F.struct("started_at", "run_id")
    return runs.groupBy("session_id").agg(F.count("*").alias("runs"), F.count_if(F.col("state") == "completed").alias("completed"), F.max_by("run_id", key).alias("latest_run"), F.max_by("state", key).alias("latest_state"))


def dataset_ids(sources: DataFrame) -> DataFrame:
    """Q7."""
    return sources.select("dataset_id").distinct().orderBy("dataset_id")
