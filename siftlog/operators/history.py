"""Leakage-safe history as of a session's start, and session features."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from siftlog.operators.running import aggregate_before, count_before, count_dominated, numbered
from siftlog.scratch import materialize

# Entity columns with the other entity whose distinct values are counted.
DISTINCT = (("user", "host", "distinct_hosts_for_user"), ("src_ip", "user", "distinct_users_for_src_ip"), ("host", "user", "distinct_users_for_host"), ("host", "src_ip", "distinct_src_ips_for_host"))


ENTITIES = ("user", "src_ip", "host")


def _as_of(sessions: DataFrame, observed: bool, partners: tuple) -> DataFrame:
    """``session_id`` with the wanted counts of the history, from one pass of all entities.

    A session asks three times, by user, address and host; ends of sessions and first ends of pairs are what is
    counted. All counts of an entity are running sums over the same rows.
    """
    kind = lambda k: (F.lit(k).alias("kind"), F.col(k).cast("string").alias("entity"))
    slots = {name: f"n{[d[2] for d in DISTINCT if d[0] == key].index(name) + 1}" for key, _, name in DISTINCT}
    flags = lambda own: [F.lit(int(n == own)).alias(n) for n in ("n0", "n1", "n2")]
    asks = sessions.select("session_id", F.col("start_time").alias("at"), F.inline(F.array(*(F.struct(*kind(k)) for k in ENTITIES))))
    closes = []
    if observed:
        closes.append(sessions.select(F.col("end_time").alias("at"), F.inline(F.array(*(F.struct(*kind(k), *flags("n0")) for k in ENTITIES)))))
    if partners:
        pairs = F.inline(F.array(*(F.struct(*kind(key), F.lit(slots[name]).alias("slot"), F.col(other).cast("string").alias("other")) for key, other, name in partners)))
        first = sessions.select("end_time", pairs).groupBy("kind", "entity", "slot", "other").agg(F.min("end_time").alias("at"))
        closes.append(first.select("at", "kind", "entity", *((F.col("slot") == n).cast("int").alias(n) for n in ("n0", "n1", "n2"))))
    every = closes[0] if len(closes) == 1 else closes[0].unionByName(closes[1])
    found = aggregate_before(asks, every, ["kind", "entity"], "at", {n: ("sum", n) for n in ("n0", "n1", "n2")})
    count = lambda key, n: F.coalesce(F.max(F.when((F.col("kind") == key) & F.col("entity").isNotNull(), F.col(n))), F.lit(0)).cast("bigint")
    wanted = [count(k, "n0").alias(f"{k}_observations") for k in ENTITIES if observed] + [count(key, slots[name]).alias(name) for key, _, name in partners]
    out = found.groupBy("session_id").agg(*wanted)
    return out.withColumns({f"{k}_first_seen": F.col(f"{k}_observations") == 0 for k in ENTITIES}) if observed else out


def observation_counts(sessions: DataFrame) -> DataFrame:
    """earlier closed sessions of the user, address and host, and first-seen flags.

    History is every session, of any dataset, that ended strictly before this one's start.
    """
    return _as_of(sessions, True, ())


def distinct_counts(sessions: DataFrame) -> DataFrame:
    """distinct partners in the history: a pair counts from the first end of a session that has it."""
    return _as_of(sessions, False, DISTINCT)


def members(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Sessions' events in order, with what features, frequencies and digests take from them: one join for all."""
    ev = events.select("event_id", "event_type", "success", F.col("host").alias("event_host"), F.col("user").alias("event_user"), F.col("src_ip").alias("event_src_ip"), "ts")
    return sessions.select("session_id", "start_time", F.col("end_time").alias("ended"), F.posexplode("events").alias("ordinal", "event_id")).join(ev, "event_id")


def auth_frequency(sessions: DataFrame, events: DataFrame, hours: int = 24, held: DataFrame | None = None) -> DataFrame:
    """the user's ssh_auth_ events in the window before the start, from sessions of the history.

    Such an event lies in a session that ended before the start, in the same span of ``hours`` or the one
    before. Ends in the span before are all early enough, so only the event's time is counted; ends in the
    same span are counted, less those whose event is too old, which only sessions over a border of spans have:
    they are the points that are earlier in both times. No join pairs the sessions of a user with its events,
    and no window holds more than a user's rows of a span. ``held`` is a stored ``members`` of both tables.
    """
    span = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (hours * 3_600_000_000))
    own = members(sessions, events) if held is None else held
    auth = own.where(F.col("event_type").startswith("ssh_auth_") & F.col("event_user").isNotNull()).select(F.col("event_user").alias("user"), "ts", "ended", span("ended").alias("span"))
    auth = materialize(auth, "auth")
    asks = sessions.select("session_id", "user", F.col("start_time").alias("ended"), F.expr(f"start_time - interval {hours} hours").alias("ts"), span("start_time").alias("span")).where("user is not null")
    asks = materialize(asks, "starts")
    # Of the span before: events not before the window. Of the same span: ends before the start.
    mark = lambda which, of, at, n: F.struct(F.lit(which).alias("which"), of.alias("of"), F.col(at).alias("at"), F.lit(n).alias("n"))
    two = lambda shift, n: F.inline(F.array(mark(0, F.col("span") - shift, "ts", n), mark(1, F.col("span"), "ended", n)))
    marks = asks.select("session_id", "user", two(1, 0)).unionByName(auth.select("user", two(0, 1)), allowMissingColumns=True)
    w = Window.partitionBy("user", "of", "which")
    before = F.sum("n").over(w.orderBy("at", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = marks.withColumn("n_before", before).withColumn("n_all", F.sum("n").over(w)).where("n = 0")
    near = near.select("session_id", F.when(F.col("which") == 0, F.col("n_all") - F.col("n_before")).otherwise(F.col("n_before")).alias("n"))
    crossing = auth.where(span("ts") < F.col("span"))
    late = count_dominated(asks, crossing, ["user", "span"], "session_id", "ended", "ts", "n", spread=False).select("session_id", (-F.col("n")).alias("n"))
    unnamed = sessions.select("session_id", F.lit(0).cast("bigint").alias("n"))
    return unnamed.unionByName(near).unionByName(late).groupBy("session_id").agg(F.sum("n").alias("auth_frequency_window_count"))


def context(sessions: DataFrame, events: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """All history columns by session."""
    return _as_of(sessions, True, DISTINCT).join(auth_frequency(sessions, events, held=held), "session_id")


def reference_pages(sessions: DataFrame, page: int = 1000) -> DataFrame:
    """all sessions in the order of their ends, as numbered pages of a shared list that only grows.

    The history of any session is a prefix of this list. Each page has its references, their number, the
    first and last of them and a digest, so that ``page_faults`` proves order and uniqueness from page to page.
    """
    placed = numbered(sessions.select(F.col("end_time").alias("at"), F.col("session_id").alias("ref")), [], ["at", "ref"], "place")
    listed = placed.withColumn("page", F.floor(F.col("place") / page)).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("at", "ref"))).alias("refs"))
    text = F.array_join(F.transform("refs", lambda r: r["ref"]), "\n")
    return listed.select("page", "refs", F.size("refs").cast("bigint").alias("n"), F.element_at("refs", 1).alias("first"), F.element_at("refs", -1).alias("last"), F.sha2(text, 256).alias("digest"))


def page_faults(pages: DataFrame) -> DataFrame:
    """``page, fault`` of pages whose digest, inner order or order after the page before is broken."""
    text = F.array_join(F.transform("refs", lambda r: r["ref"]), "\n")
    inner = F.exists(F.zip_with(F.expr("slice(refs, 1, size(refs) - 1)"), F.expr("slice(refs, 2, size(refs))"), lambda a, b: a >= b), lambda x: x)
    ends = pages.select((F.col("page") + 1).alias("page"), F.col("last").alias("before"))
    rules = F.array(F.when(F.sha2(text, 256) != F.col("digest"), "digest"), F.when(inner, "order"), F.when(F.col("before") >= F.col("first"), "border"), F.when((F.col("page") > 0) & F.col("before").isNull(), "missing_page"))
    return pages.join(ends, "page", "left").select("page", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("fault"))


def reference_counts(sessions: DataFrame) -> DataFrame:
    """``session_id, n_refs``: how long a prefix of the shared list is the session's history; one number instead of its rows."""
    opens = sessions.select("session_id", F.col("start_time").alias("at"), F.lit(1).alias("all"))
    closes = sessions.select(F.col("end_time").alias("at"), F.lit(1).alias("all"))
    return count_before(opens, closes, ["all"], "at", "n_refs").select("session_id", "n_refs")


def expand_references(counts: DataFrame, pages: DataFrame, page: int = 1000) -> DataFrame:
    """``session_id, ref`` of the sessions of ``counts`` that a reader asks for; whole pages, the last one cut."""
    asked = counts.where("n_refs > 0").select("session_id", "n_refs", F.explode(F.expr(f"sequence(0, (n_refs - 1) div {int(page)})")).alias("page"))
    mine = asked.join(pages.select("page", "refs"), "page")
    return mine.select("session_id", F.explode(F.slice("refs", F.lit(1), F.least(F.lit(page), F.col("n_refs") - F.col("page") * page).cast("int"))).alias("r")).select("session_id", F.col("r.ref").alias("ref"))


def violations(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """``session_id, rule`` of sessions that break an invariant; empty for sound data.

    Sessions and events have a ``source``. Null users and addresses must agree too; a session without events is one.
    """
    ev = events.select("event_id", F.col("ts").alias("at"), F.col("source").alias("src"), F.col("user").alias("u"), F.col("src_ip").alias("ip"), F.col("host").alias("h"))
    members = sessions.select("*", F.posexplode_outer("events").alias("ordinal", "event_id")).join(ev, "event_id", "left")
    other = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    held = F.col("at").isNotNull()
    per = members.groupBy("session_id").agg(
        (F.count("event_id") == 0).alias("no_events"),
        F.bool_or(F.col("event_id").isNotNull() & ~held).alias("missing_event"),
        F.bool_or((F.col("at") < F.col("start_time")) | (F.col("at") > F.col("end_time"))).alias("event_outside"),
        F.bool_or(held & (other("u", "user") | other("ip", "src_ip") | other("h", "host"))).alias("other_entity"),
        F.bool_or(held & other("src", "source")).alias("other_source"),
        (F.min("at") != F.first("start_time")).alias("wrong_start"),
        (F.max("at") != F.first("end_time")).alias("wrong_end"),
        (F.count("event_id") != F.first("event_count")).alias("wrong_count"),
        (F.count_distinct("event_id") != F.count("event_id")).alias("repeated_event"),
    )
    w = Window.partitionBy("session_id").orderBy("ordinal")
    back = members.where(held).withColumn("back", F.col("at") < F.lag("at").over(w)).where("back")
    unsorted = back.select("session_id", F.lit("unordered").alias("rule")).distinct()
    rules = ["no_events", "missing_event", "event_outside", "other_entity", "other_source", "wrong_start", "wrong_end", "wrong_count", "repeated_event"]
    listed = per.select("session_id", F.explode(F.filter(F.array(*(F.when(F.col(r), F.lit(r)) for r in rules)), lambda x: x.isNotNull())).alias("rule"))
    return listed.unionByName(unsorted)


def features(sessions: DataFrame, events: DataFrame, zone: str = "UTC", held: DataFrame | None = None) -> DataFrame:
    """hour of day on the circle, shares of outcomes, hosts and event types by session."""
    own = members(sessions, events) if held is None else held
    per = own.groupBy("session_id").agg(
        F.first("start_time").alias("start_time"),
        F.count("*").alias("event_count"),
        (F.count_if(F.col("success") == F.lit(False)) / F.count("*")).alias("failure_proportion"),
        (F.count_if("success") / F.count("*")).alias("success_proportion"),
        F.count_distinct("event_host").alias("distinct_hosts_in_session"),
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "event_type"))), lambda x: x["event_type"]).alias("event_types"),
    )
    share = F.transform(F.array_sort(F.array_distinct("event_types")), lambda t: F.struct(t.alias("event_type"), (F.size(F.filter("event_types", lambda x: x == t)) / F.col("event_count")).alias("share")))
    local = F.from_utc_timestamp(F.col("start_time").cast("timestamp"), zone)
    out = per.withColumns({"event_type_proportions": share, "hour_utc": F.hour("start_time"), "login_hour_local": F.hour(local)})
    angle = F.col("login_hour_local") * (2 * math.pi / 24)
    return out.withColumns({"hour_sin": F.sin(angle), "hour_cos": F.cos(angle)}).drop("start_time")


def content_hash(sessions: DataFrame, events: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """digest of a session with its events in order, in a form of our own."""
    own = members(sessions, events) if held is None else held
    line = F.concat_ws("|", "event_id", "event_type", F.coalesce("event_user", F.lit("")), F.coalesce("event_src_ip", F.lit("")), F.coalesce("event_host", F.lit("")))
    lines = own.select("session_id", "ordinal", line.alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("session_id").agg(text.alias("text")).select("session_id", F.sha2(F.concat_ws("\n", "session_id", "text"), 256).alias("content_sha256"))


# The feature vectors of the behaviour models and their entity.
MODEL_INPUTS = {
    "login_hour_rarity": ("user", ["login_hour_local"]),
    "auth_frequency": ("user", ["auth_frequency_window_count"]),
    "src_ip_behavior": ("src_ip", ["failure_proportion", "success_proportion", "distinct_hosts_in_session", "distinct_users_for_src_ip", "hour_sin", "hour_cos"]),
    "host_access": ("host", ["failure_proportion", "success_proportion", "event_count", "distinct_users_for_host", "distinct_src_ips_for_host", "hour_sin", "hour_cos"]),
}


def model_inputs(table: DataFrame, *kept: str) -> DataFrame:
    """F8: ``session_id, model_id, entity, vector, items`` long over all models, from one pass: numbers, or the event types in order. ``kept`` columns come along."""
    part = lambda m, e, vector, items: F.struct(F.lit(m).alias("model_id"), F.col(e).alias("entity"), vector.cast("array<double>").alias("vector"), items.cast("array<string>").alias("items"))
    none = F.lit(None)
    parts = [part(m, e, F.array(*(F.col(c).cast("double") for c in cols)), none) for m, (e, cols) in MODEL_INPUTS.items()]
    return table.select("session_id", *kept, F.inline(F.array(part("transition_surprise", "user", none, F.col("event_types")), *parts)))
