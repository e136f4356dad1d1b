"""Named queries over the operators, with the SQL that must give the same rows. Doubles are rounded to 6 digits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftlog.functions.scalars import wilson
from siftlog.operators import cases, evaluate, history, models, parse, redact, retrieval, sessions as sess, traces as tr
from siftlog.plans import views as v
from siftlog.plans.views import EVENTS_SQL, GAP, ITEMS_SQL, LINES_SQL, RUNS_SQL, SESSIONS_SQL, TRACES_SQL
from siftlog.scratch import materialize

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(name: str, alias: str | None = None):
    return F.round(F.col(name), 6).alias(alias or name)




# --- sessions ------------------------------------------------------------------------------------


def sessions_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.sessions(spark, sf_dir)
    return s.groupBy("user").agg(F.count("*").alias("sessions"), F.sum("event_count").alias("events"), F.sum("failure_count").alias("failures"))


QUERIES["z0_sessions_per_user"] = sessions_per_user
ORACLES["z0_sessions_per_user"] = f"""with {SESSIONS_SQL} select "user", count(*) as sessions, cast(sum(event_count) as bigint) as events, cast(sum(failure_count) as bigint) as failures from sessions group by 1"""

GAPS_SQL = f"""with {SESSIONS_SQL}, gaps as (select source, host, src_ip, "user", event_id, (epoch_us(ts) - epoch_us(previous)) / 1e6 as gap from gapped where previous is not null and ts >= previous)"""


@query(f"""{GAPS_SQL} select event_id, "user", round(gap, 6) as gap from gaps""")
def z1_gaps(spark, sf_dir):
    return sess.gaps(v.auth_events(spark, sf_dir)).select("event_id", "user", r6("gap"))


@query(f"""{GAPS_SQL} select round(greatest(quantile_cont(gap, 0.95), 1e-6), 6) as threshold from gaps""")
def z2_gap_percentile(spark, sf_dir):
    return sess.fit_percentile(sess.gaps(v.auth_events(spark, sf_dir))).select(r6("threshold"))


@query(
    f"""{GAPS_SQL}, ranked as (select gap, row_number() over (order by gap) - 1 as i, count(*) over () as n, min(gap) over () as low, max(gap) over () as high from gaps),
    far as (select gap, i, abs(i / (n - 1) - (gap - low) / (high - low)) / sqrt(2) as d from ranked where n >= 3 and high > low),
    best as (select case when max(d) >= 0.05 then arg_min(gap, (-d, i)) end as knee from far)
    select round(greatest(coalesce(knee, (select quantile_cont(gap, 0.95) from gaps)), 1e-6), 6) as threshold from best"""
)
def z3_gap_knee(spark, sf_dir):
    return sess.fit_knee(materialize(sess.gaps(v.auth_events(spark, sf_dir)).select("gap"), "gaps")).select(r6("threshold"))


@query(f"""{GAPS_SQL} select round(greatest(avg(gap) + 2 * coalesce(stddev_samp(gap), 0), 1e-6), 6) as threshold from gaps""")
def z4_gap_mean_std(spark, sf_dir):
    return sess.fit_mean_std(sess.gaps(v.auth_events(spark, sf_dir))).select(r6("threshold"))


@query(f"""with {SESSIONS_SQL} select event_id, cast(session_no as bigint) as session_no from numbered""")
def z5_session_numbers(spark, sf_dir):
    return sess.assign_sessions(v.auth_events(spark, sf_dir), GAP).select("event_id", F.col("session_no").cast("bigint").alias("session_no"))


@query(
    f"""with {SESSIONS_SQL} select session_id, host, src_ip, "user", start_time, end_time, event_count, array_to_string(events, ',') as events, primary_method, key_fingerprint, src_port,
    has_escalation, has_persistence, failure_count from sessions"""
)
def z6_sessions(spark, sf_dir):
    return v.sessions(spark, sf_dir).select("session_id", "host", "src_ip", "user", "start_time", "end_time", "event_count", F.array_join("events", ",").alias("events"), "primary_method", "key_fingerprint", "src_port", "has_escalation", "has_persistence", "failure_count")


@query(f"""with ev as ({EVENTS_SQL}) select event_id, 'missing user or source IP' as reason from ev where "user" is null or src_ip is null""")
def z7_unmatched(spark, sf_dir):
    return sess.unmatched(v.auth_events(spark, sf_dir))


@query(
    f"""with {SESSIONS_SQL}, bad as (select 1 from ev where line_no % 97 = 0)
    select 'raw_lines' as counter, (select count(*) from ev) + (select count(*) from bad) as n union all select 'parse_failures', (select count(*) from bad)
    union all select 'events', (select count(*) from ev) union all select 'complete_sessions', (select count(*) from sessions)
    union all select 'unmatched', (select count(*) from ev where "user" is null or src_ip is null)"""
)
def z8_counters(spark, sf_dir):
    failures = parse.failures_of(parse.parse_lines(v.auth_lines(spark, sf_dir)))
    return sess.counters(v.auth_events(spark, sf_dir), failures, v.sessions(spark, sf_dir))


# --- parsing -------------------------------------------------------------------------------------


@query(
    f"""select 'events:' || line_no as event_id, host, event_type, success, coalesce("user", 'nobody') as "user", ts as event_time,
      case when event_type in ('ssh_auth_success', 'ssh_auth_failure') then coalesce(src_ip, '10.9.9.9') end as src_ip, src_port, method,
      case when event_type = 'sudo_command' then '/bin/ls ' || line_no end as command, case when event_type = 'sudo_command' then 'root' end as target_user,
      case when event_type = 'session_opened' then 1000 when event_type = 'account_created' then line_no end as uid
    from ({EVENTS_SQL}) where line_no % 97 <> 0""".replace("coalesce(\"user\", 'nobody') as \"user\"", "case when event_type <> 'account_created' then coalesce(\"user\", 'nobody') end as \"user\"")
)
def p2_parsed_events(spark, sf_dir):
    parsed = parse.events_of(parse.parse_lines(v.auth_lines(spark, sf_dir)))
    return parsed.select("event_id", "host", "event_type", "success", "user", F.col("timestamp").cast("timestamp_ntz").alias("event_time"), "src_ip", "src_port", "method", "command", "target_user", "uid")


@query(
    f"""select source, line_no, case when line_no % 89 = 0 then left(raw_line, 36) || 'app: nothing known' else raw_line end as raw_line,
      case when line_no % 97 = 0 then 'Unrecognized header' else 'Unrecognized auth message family' end as reason, case when line_no % 97 <> 0 then ts end as salvaged_time
    from ({LINES_SQL}) where line_no % 97 = 0 or line_no % 89 = 0"""
)
def p6_parse_failures(spark, sf_dir):
    """Lines without a header, and every 89th with an unknown message, whose time is kept unless it is one of the former."""
    lines = v.auth_lines(spark, sf_dir).withColumn("raw_line", F.expr("if(line_no % 89 = 0, concat(left(raw_line, 36), 'app: nothing known'), raw_line)"))
    failed = parse.failures_of(parse.parse_lines(lines))
    return failed.select("source", "line_no", "raw_line", "reason", F.col("timestamp").cast("timestamp_ntz").alias("salvaged_time"))


@query(
    f"""with shifted as (select source, line_no, ts + to_months(cast(((line_no // 500) * 4) % 14 as integer)) as t from ({EVENTS_SQL})),
    months as (select *, month(t) as m, lag(month(t)) over (partition by source order by line_no) as p from shifted)
    select line_no, cast(2024 + sum(case when p >= 11 and m <= 2 then 1 else 0 end) over (partition by source order by line_no) as integer) as year from months"""
)
def p7_year_rollover(spark, sf_dir):
    e = v.auth_events(spark, sf_dir)
    shifted = F.expr("ts + make_interval(0, cast(((line_no div 500) * 4) % 14 as int), 0, 0, 0, 0, 0)")
    lines = e.select("source", "line_no", F.date_format(shifted, "MMM dd HH:mm:ss").alias("stamp"), F.lit(2024).alias("default_year"))
    return parse.with_years(lines).select("line_no", F.col("year").cast("int").alias("year"))


@query(
    f"""with ev as ({EVENTS_SQL}) select event_id, ts, event_type, host from ev where contains(lower(raw_message), '"k": 4') and host = 'h0' and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20'
    and not ("user" is null or src_ip is null) order by ts, event_id limit 100"""
)
def p10_search(spark, sf_dir):
    e = v.auth_events(spark, sf_dir).withColumn("message", F.col("raw_message"))
    start, end = (F.expr(f"timestamp_ntz '2024-01-{d} 00:00:00'") for d in ("05", "20"))
    found = cases.search_events(e.where((F.col("ts") >= start) & (F.col("ts") < end)), sess.unmatched(e), text='"K": 4', host="h0", membership="sessionized", limit=100)
    return found.select("event_id", "ts", "event_type", "host")


@query(
    f"""with ev as ({EVENTS_SQL}), ids as (select 'events:' || (event_id * 3 + 1) as event_id from events)
    select i.event_id, ts, event_type, case when length(raw_message) > 12 then left(raw_message, 12) || '...[truncated]' else raw_message end as raw_message,
      case when ts is not null and ("user" is null or src_ip is null) then 'missing user or source IP' end as unmatched_reason, ts is not null as found
    from ids i left join ev using (event_id)"""
)
def p11_lookup(spark, sf_dir):
    e = v.auth_events(spark, sf_dir)
    ids = v.table(spark, sf_dir, "events").select(F.concat(F.lit("events:"), (F.col("event_id") * 3 + 1).cast("string")).alias("event_id"))
    return cases.lookup_events(ids, e, sess.unmatched(e), 12)


SESSION_EVENTS_SQL = f"""with {SESSIONS_SQL}, se as (select session_id, unnest(events) as event_id, unnest(range(len(events))) as ordinal from sessions)"""


@query(f"""{SESSION_EVENTS_SQL} select session_id, cast(ordinal as integer) as ordinal, event_id, ts, event_type from se join ev using (event_id) where ordinal between 2 and 4""")
def p12_session_pages(spark, sf_dir):
    s = v.sessions(spark, sf_dir)
    return cases.page_of_session(sess.session_events(s), v.auth_events(spark, sf_dir), 1, 3).select("session_id", "ordinal", "event_id", "ts", "event_type")


# --- history and features ------------------------------------------------------------------------


@query(
    f"""with {SESSIONS_SQL}, n as (select s.session_id,
      (select count(*) from sessions h where h."user" = s."user" and h.end_time < s.start_time) as user_observations,
      (select count(*) from sessions h where h.src_ip = s.src_ip and h.end_time < s.start_time) as src_ip_observations,
      (select count(*) from sessions h where h.host = s.host and h.end_time < s.start_time) as host_observations from sessions s)
    select *, user_observations = 0 as user_first_seen, src_ip_observations = 0 as src_ip_first_seen, host_observations = 0 as host_first_seen from n"""
)
def f2_asof_counts(spark, sf_dir):
    return history.observation_counts(materialize(v.sessions(spark, sf_dir), "sessions"))


@query(
    f"""with {SESSIONS_SQL}, pairs as (select "user", host, min(end_time) as e from sessions group by all), ipu as (select src_ip, "user", min(end_time) as e from sessions group by all),
    hip as (select host, src_ip, min(end_time) as e from sessions group by all)
    select s.session_id,
      (select count(*) from pairs h where h."user" = s."user" and h.e < s.start_time) as distinct_hosts_for_user,
      (select count(*) from ipu h where h.src_ip = s.src_ip and h.e < s.start_time) as distinct_users_for_src_ip,
      (select count(*) from pairs h where h.host = s.host and h.e < s.start_time) as distinct_users_for_host,
      (select count(*) from hip h where h.host = s.host and h.e < s.start_time) as distinct_src_ips_for_host from sessions s"""
)
def f3_asof_distinct(spark, sf_dir):
    return history.distinct_counts(materialize(v.sessions(spark, sf_dir), "sessions"))


@query(
    f"""{SESSION_EVENTS_SQL}, auth as (select ev."user", ev.ts, s.end_time from se join ev using (event_id) join sessions s using (session_id) where ev.event_type like 'ssh\\_auth\\_%' escape '\\')
    select s.session_id, (select count(*) from auth a where a."user" = s."user" and a.ts >= s.start_time - interval 24 hours and a.ts < s.start_time and a.end_time < s.start_time) as auth_frequency_window_count
    from sessions s"""
)
def f4_auth_frequency(spark, sf_dir):
    s = materialize(v.sessions(spark, sf_dir), "sessions")
    return history.auth_frequency(s, v.auth_events(spark, sf_dir))


@query(
    f"""with {SESSIONS_SQL}, f as (select session_id, event_count % 7 = 3 as more, event_count % 5 = 1 as late, event_count % 11 = 2 as other, event_count % 13 = 4 as again, event_count % 17 = 5 as moved, event_count % 19 = 6 as gone from sessions)
    select session_id, unnest(case when gone then ['no_events', 'wrong_count'] else list_filter([case when more <> again then 'wrong_count' end, case when late then 'wrong_start' end, case when late then 'event_outside' end,
      case when other then 'other_entity' end, case when moved then 'other_source' end, case when again then 'repeated_event' end, case when again then 'unordered' end], lambda x: x is not null) end) as rule from f"""
)
def f5_violations(spark, sf_dir):
    """Sessions with faults put in by their number of events: a wrong count, a late start, another user or source, a repeated event, no events."""
    s = v.sessions(spark, sf_dir).withColumn("n", F.col("event_count"))
    s = s.withColumns(
        {
            "event_count": F.when(F.col("n") % 7 == 3, F.col("n") + 1).otherwise(F.col("n")),
            "start_time": F.when(F.col("n") % 5 == 1, F.col("start_time") + F.expr("interval 1 second")).otherwise(F.col("start_time")),
            "user": F.when(F.col("n") % 11 == 2, F.lit("nobody")).otherwise(F.col("user")),
            "source": F.when(F.col("n") % 17 == 5, F.lit("elsewhere")).otherwise(F.col("source")),
            "events": F.expr("if(n % 19 = 6, slice(events, 1, 0), if(n % 13 = 4, array_append(events, element_at(events, 1)), events))"),
        }
    ).drop("n")
    return history.violations(materialize(s, "sessions"), v.auth_events(spark, sf_dir))


@query(
    f"""{SESSION_EVENTS_SQL}, m as (select session_id, ordinal, e.* from se join ev e using (event_id)), shares as (
      select session_id, string_agg(event_type || '=' || round(c / t, 6), ',' order by event_type) as proportions from (
        select session_id, event_type, count(*) as c, sum(count(*)) over (partition by session_id) as t from m group by session_id, event_type) group by session_id)
    select s.session_id, s.event_count, round(count(*) filter (where success = false) / count(*), 6) as failure_proportion, round(count(*) filter (where success) / count(*), 6) as success_proportion,
      count(distinct m.host) as distinct_hosts_in_session, string_agg(m.event_type, ',' order by ordinal) as event_types, any_value(proportions) as proportions,
      cast(hour(s.start_time) as integer) as hour_utc, round(sin(hour(s.start_time) * 2 * pi() / 24), 6) as hour_sin, round(cos(hour(s.start_time) * 2 * pi() / 24), 6) as hour_cos
    from sessions s join m using (session_id) join shares using (session_id) group by s.session_id, s.event_count, s.start_time"""
)
def f6_features(spark, sf_dir):
    f = history.features(v.sessions(spark, sf_dir), v.auth_events(spark, sf_dir))
    shares = F.array_join(F.transform("event_type_proportions", lambda x: F.concat(x["event_type"], F.lit("="), F.round(x["share"], 6).cast("string"))), ",")
    return f.select("session_id", "event_count", r6("failure_proportion"), r6("success_proportion"), "distinct_hosts_in_session", F.array_join("event_types", ",").alias("event_types"), shares.alias("proportions"), "hour_utc", r6("hour_sin"), r6("hour_cos"))


@query(
    f"""{SESSION_EVENTS_SQL} select session_id, sha256(session_id || chr(10) || string_agg(event_id || '|' || event_type || '|' || coalesce("user", '') || '|' || coalesce(src_ip, '') || '|' || coalesce(host, ''), chr(10) order by ordinal)) as content_sha256
    from se join ev using (event_id) group by session_id"""
)
def f9_content_hash(spark, sf_dir):
    return history.content_hash(v.sessions(spark, sf_dir), v.auth_events(spark, sf_dir))


# --- models --------------------------------------------------------------------------------------


def _hours(spark, sf_dir):
    return v.sessions(spark, sf_dir).select(F.col("user").alias("entity"), F.hour("start_time").alias("hour"), F.col("start_time").alias("at"), F.col("session_id").alias("id"))


HOURS_SQL = f"""with {SESSIONS_SQL}, obs as (select "user" as entity, cast(hour(start_time) as integer) as hour, start_time as t0, session_id as id from sessions)"""


@query(
    f"""{HOURS_SQL} select id, entity, row_number() over (partition by entity order by t0, id) - 1 as seen,
      round(-ln(((row_number() over (partition by entity, hour order by t0, id) - 1) + 1.0) / ((row_number() over (partition by entity order by t0, id) - 1) + 24.0)), 6) as score from obs"""
)
def m1_hour_rarity(spark, sf_dir):
    return models.hour_rarity(_hours(spark, sf_dir)).select("id", "entity", F.col("seen").cast("bigint").alias("seen"), r6("score"))


@query(
    f"""{HOURS_SQL}, state as (select entity, hour, count(*) as n from obs where t0 < timestamp '2024-01-20' group by all), totals as (select entity, sum(n) as total from state group by 1)
    select o.id, o.entity, round(case when total is not null then -ln((coalesce(n, 0) + 1.0) / (total + 24.0)) end, 6) as score from obs o left join totals using (entity) left join state using (entity, hour)
    where t0 >= timestamp '2024-01-20'"""
)
def m1_frozen_hours(spark, sf_dir):
    obs = _hours(spark, sf_dir)
    cut = F.expr("timestamp_ntz '2024-01-20 00:00:00'")
    return models.score_hours(obs.where(F.col("at") >= cut), models.hour_state(obs.where(F.col("at") < cut))).select("id", "entity", r6("score"))


@query(
    f"""with {SESSIONS_SQL}, obs as (select "user" as entity, cast(event_count as bigint) as y, start_time as t0, session_id as id from sessions),
    st as (select *, row_number() over (partition by entity order by t0, id) - 1 as seen, sum(y) over w as s1, sum(y * y) over w as s2 from obs window w as (partition by entity order by t0, id rows between unbounded preceding and 1 preceding)),
    ms as (select *, case when seen > 0 then s1 / cast(seen as double) else 0 end as m, case when seen > 1 then sqrt(cast(seen * s2 - s1 * s1 as double) / (seen * (seen - 1))) else 0 end as sd from st)
    select id, seen, round(least(1e6, abs(y - m) / (sd + 1e-10)), 6) as score from ms"""
)
def m2_deviation(spark, sf_dir):
    obs = v.sessions(spark, sf_dir).select(F.col("user").alias("entity"), F.col("event_count").cast("double").alias("y"), F.col("start_time").alias("at"), F.col("session_id").alias("id"))
    found = models.frequency_deviation(obs)
    return found.select("id", F.col("seen").cast("bigint").alias("seen"), F.round(F.least(F.lit(1e6), "score"), 6).alias("score"))


@query(
    f"""{SESSION_EVENTS_SQL}, seq as (select s.session_id as id, s."user" as entity, s.start_time as t0, se.ordinal, ev.event_type as x from sessions s join se using (session_id) join ev using (event_id)),
    steps as (select id, entity, t0, ordinal, x as a, lead(x) over (partition by id order by ordinal) as b from seq),
    pairs as (select id, entity, t0, a, b, count(*) as c from steps where b is not null group by all),
    sp as (select *, coalesce(sum(c) over (partition by entity, a, b order by t0, id rows between unbounded preceding and 1 preceding), 0) as seen_pair from pairs),
    ia as (select id, entity, t0, a, sum(c) as n from pairs group by all),
    sa as (select id, entity, a, coalesce(sum(n) over (partition by entity, a order by t0, id rows between unbounded preceding and 1 preceding), 0) as seen_a from ia),
    it as (select distinct id, entity, t0, x from seq), fr as (select *, row_number() over (partition by entity, x order by t0, id) as rn from it),
    vs as (select id, entity, t0, sum(case when rn = 1 then 1 else 0 end) as f from fr group by all), vo as (select id, sum(f) over (partition by entity order by t0, id rows between unbounded preceding and current row) as vocabulary from vs),
    sc as (select sp.*, -ln((seen_pair + 1.0) / (seen_a + vocabulary)) as s from sp join sa using (id, entity, a) join vo using (id)),
    per as (select id, sum(s * c) / sum(c) as mean_surprise, max(s) as max_surprise, sum(case when seen_pair = 0 then c else 0 end) as unseen from sc group by id)
    select session_id as id, round(mean_surprise, 6) as mean_surprise, round(max_surprise, 6) as max_surprise, cast(unseen as bigint) as unseen, round(coalesce(mean_surprise, 0), 6) as score
    from sessions left join per on session_id = id"""
)
def m4_transitions(spark, sf_dir):
    f = history.features(v.sessions(spark, sf_dir), v.auth_events(spark, sf_dir))
    s = v.sessions(spark, sf_dir).select(F.col("session_id").alias("id"), F.col("user").alias("entity"), F.col("start_time").alias("at"))
    seq = materialize(s.join(f.select(F.col("session_id").alias("id"), F.col("event_types").alias("items")), "id"), "sequences")
    return models.transition_surprise(seq).select("id", r6("mean_surprise"), r6("max_surprise"), F.col("unseen").cast("bigint").alias("unseen"), r6("score"))


def _vectors(spark, sf_dir):
    s = materialize(v.sessions(spark, sf_dir), "sessions")
    e = v.auth_events(spark, sf_dir)
    held = materialize(history.members(s, e), "members")
    table = s.select("session_id", "user", "src_ip", "host", "start_time").join(history.features(s, e, held=held), "session_id").join(history.context(s, e, held), "session_id")
    return history.model_inputs(table.withColumnRenamed("start_time", "at"), "at").withColumnRenamed("session_id", "id")


@query()
def m3_half_space_trees(spark, sf_dir):
    """Both models of this kind."""
    rows = materialize(_vectors(spark, sf_dir).where("vector is not null"), "vectors")
    one = lambda m: models.half_space_trees(rows.where(F.col("model_id") == m).select("entity", "id", "at", "vector")).withColumn("model_id", F.lit(m))
    return one("src_ip_behavior").unionByName(one("host_access"))


@query(
    f"""{SESSION_EVENTS_SQL}, m as (select session_id, ordinal, e.* from se join ev e using (event_id)),
    pairs as (select "user", host, min(end_time) as e from sessions group by all), ipu as (select src_ip, "user", min(end_time) as e from sessions group by all), hip as (select host, src_ip, min(end_time) as e from sessions group by all),
    auth as (select ev."user", ev.ts, s.end_time from se join ev using (event_id) join sessions s using (session_id) where ev.event_type like 'ssh\\_auth\\_%' escape '\\'),
    shape as (select session_id, count(*) filter (where success = false) / count(*) as failed, count(*) filter (where success) / count(*) as fine, count(distinct host) as hosts, list(event_type order by ordinal) as types from m group by 1),
    wide as (select s.*, failed, fine, hosts, types, sin(hour(start_time) * 2 * pi() / 24) as sine, cos(hour(start_time) * 2 * pi() / 24) as cosine,
      (select count(*) from ipu h where h.src_ip = s.src_ip and h.e < s.start_time) as ip_users, (select count(*) from pairs h where h.host = s.host and h.e < s.start_time) as host_users,
      (select count(*) from hip h where h.host = s.host and h.e < s.start_time) as host_ips,
      (select count(*) from auth a where a."user" = s."user" and a.ts >= s.start_time - interval 24 hours and a.ts < s.start_time and a.end_time < s.start_time) as auths from sessions s join shape using (session_id)),
    long as (select session_id, 'login_hour_rarity' as model_id, "user" as entity, [cast(hour(start_time) as double)] as vector from wide union all select session_id, 'auth_frequency', "user", [cast(auths as double)] from wide
      union all select session_id, 'src_ip_behavior', src_ip, [failed, fine, hosts, ip_users, sine, cosine] from wide union all select session_id, 'host_access', host, [failed, fine, event_count, host_users, host_ips, sine, cosine] from wide)
    select session_id as id, model_id, entity, cast(unnest(range(len(vector))) as integer) as place, round(unnest(vector), 6) + 0.0 as value, null as item from long
    union all select session_id, 'transition_surprise', "user", cast(unnest(range(len(types))) as integer), null, unnest(types) from wide"""
)
def f8_model_inputs(spark, sf_dir):
    """Every number and item of all five inputs."""
    rows = materialize(_vectors(spark, sf_dir), "inputs").select("id", "model_id", "entity", "vector", "items")
    numbers = rows.select("id", "model_id", "entity", F.posexplode("vector").alias("place", "v")).select("id", "model_id", "entity", "place", (F.round("v", 6) + 0.0).alias("value"), F.lit(None).cast("string").alias("item"))
    return numbers.unionByName(rows.select("id", "model_id", "entity", F.posexplode("items").alias("place", "item")).withColumn("value", F.lit(None).cast("double")))


HISTORY_SQL = f"""with {SESSIONS_SQL}, placed as (select session_id, end_time, row_number() over (order by end_time, session_id) as rn from sessions),
    ends as (select end_time, max(rn) as rn from placed group by 1), counted as (select s.session_id, coalesce(h.rn, 0) as n_refs from sessions s asof left join ends h on s.start_time > h.end_time)"""


@query(f"""{HISTORY_SQL} select c.session_id, n_refs, p.session_id as last_ref from counted c left join placed p on p.rn = c.n_refs""")
def f5_history_references(spark, sf_dir):
    """How many references each session's history has, and the last of them, read from the shared pages."""
    s = materialize(v.sessions(spark, sf_dir), "sessions")
    pages = history.reference_pages(s).select("page", "refs")
    counts = history.reference_counts(s).withColumn("page", F.expr("(n_refs - 1) div 1000"))
    return counts.join(pages, "page", "left").select("session_id", "n_refs", F.when(F.col("n_refs") > 0, F.expr("element_at(refs, cast((n_refs - 1) % 1000 + 1 as int)).ref")).alias("last_ref"))


@query(f"""{HISTORY_SQL} select (rn - 1) // 1000 as page, count(*) as n, sha256(string_agg(session_id, chr(10) order by rn)) as digest from placed group by 1""")
def f5_reference_pages(spark, sf_dir):
    return history.reference_pages(v.sessions(spark, sf_dir)).select("page", "n", "digest")


@query(
    f"""{HOURS_SQL}, n as (select entity, count(*) as n from obs group by 1), models as (select 'login_hour_rarity' as model_id, 2 as warmup union all select 'auth_frequency', 2 union all select 'transition_surprise', 2
      union all select 'src_ip_behavior', 250 union all select 'host_access', 250),
    per as (select 'login_hour_rarity' as model_id, count(*) as entities, count(*) filter (where n >= 2) as ready_entities from n)
    select m.model_id, coalesce(entities, 0) as entities, coalesce(ready_entities, 0) as ready_entities,
      case when coalesce(entities, 0) = 0 then 'no_artifact' when ready_entities < entities then 'warmup_incomplete' else 'ready' end as reason from models m left join per using (model_id)"""
)
def m10_readiness(spark, sf_dir):
    scores = _hours(spark, sf_dir).select(F.lit("login_hour_rarity").alias("model_id"), "entity")
    return models.readiness(scores, models.registry(spark).where("parent is null")).select("model_id", "entities", "ready_entities", "reason")


@query(
    f"""{HOURS_SQL}, cut as (select * from obs where t0 < timestamp '2024-01-20'), state as (select entity, hour, count(*) as n from cut group by all), totals as (select entity, sum(n) as n from state group by 1),
    raw as (select o.id, o.entity, -ln((coalesce(s.n, 0) + 1.0) / (t.n + 24.0)) as score, t.n as n from obs o left join totals t using (entity) left join state s using (entity, hour) where t0 >= timestamp '2024-01-20')
    select id as session_id, round(case when n >= 2 then score end, 6) as score, cast(case when n >= 2 then 1 else 0 end as bigint) as ready_models from raw"""
)
def m9_candidates(spark, sf_dir):
    obs = _hours(spark, sf_dir)
    cut = F.expr("timestamp_ntz '2024-01-20 00:00:00'")
    state = models.hour_state(obs.where(F.col("at") < cut))
    fresh = v.sessions(spark, sf_dir).where(F.col("start_time") >= cut)
    raw = models.score_hours(obs.where(F.col("at") >= cut), state).select(F.col("id").alias("session_id"), F.lit("login_hour_rarity").alias("model_id"), F.col("score").alias("raw_score"))
    states = state.groupBy("entity").agg(F.sum("n").alias("n")).withColumn("model_id", F.lit("login_hour_rarity"))
    return models.candidates(models.frozen_scores(fresh, states, raw, models.registry(spark))).select("session_id", r6("score"), "ready_models")


@query()
def m12_drift(spark, sf_dir):
    """The streams of all five models."""
    return models.drift(_streams(spark, sf_dir)["scores"])


@query()
def m12_detections(spark, sf_dir):
    """Where in its series each drift is found, and where each series ends."""
    return models.detections(_streams(spark, sf_dir)["scores"])


def _streams(spark, sf_dir):
    """A training run that learns from every session."""
    from siftlog.plans.training import train

    s = materialize(v.sessions(spark, sf_dir), "sessions")
    return train(spark, s, v.auth_events(spark, sf_dir), s.select("session_id", F.lit("reference").alias("split")))


@query(
    f"""{HOURS_SQL}, n as (select entity, count(*) as n from obs group by 1) select 'login_hour_rarity' as model_id, entity, n as observations, n >= 2 as ready, case when n < 2 then 'warmup incomplete: ' || n || '/2' end as reason from n where length(entity) > 2
    union all select m, null, 0, false, 'no_artifact' from (select unnest(['auth_frequency', 'src_ip_behavior', 'host_access', 'transition_surprise']) as m)"""
)
def m10_catalogue(spark, sf_dir):
    """States of one model, those of short names invalid."""
    states = _hours(spark, sf_dir).groupBy("entity").agg(F.count("*").alias("n")).select(F.lit("login_hour_rarity").alias("model_id"), "entity", "n", F.lit("1").alias("feature_schema"), F.when(F.length("entity") == 2, "alpha=2").otherwise("alpha=1").alias("parameters"))
    return models.catalogue(states, models.registry(spark)).select("model_id", "entity", "observations", "ready", "reason")


BUDGET_SQL = f"""{HOURS_SQL}, scored as (select id, hour, round(-ln(((row_number() over (partition by entity, hour order by t0, id) - 1) + 1.0) / ((row_number() over (partition by entity order by t0, id) - 1) + 24.0)), 6) as raw_score from obs)"""


def _budget_scores(spark, sf_dir):
    return models.hour_rarity(_hours(spark, sf_dir)).select(F.col("id").alias("ref"), r6("score", "raw_score"), (F.hour("at") % 4 != 1).alias("normal"))


@query(f"""{BUDGET_SQL} select min(raw_score) as floor, 25 as max_alerts from (select * from scored where hour % 4 <> 1 order by raw_score desc, id limit 25)""")
def m13_alert_budget(spark, sf_dir):
    return models.calibrate_budget(_budget_scores(spark, sf_dir), 25)


@query(f"""{BUDGET_SQL} select id as ref, raw_score from scored where raw_score >= 3.5 order by raw_score desc, id limit 40""")
def m14_select_alerts(spark, sf_dir):
    return models.select_alerts(_budget_scores(spark, sf_dir), 3.5, 40).select("ref", "raw_score")


# --- splits, labels, evaluation ------------------------------------------------------------------


def _groups(spark, sf_dir):
    items = v.split_items(spark, sf_dir)
    return items, materialize(evaluate.leakage_groups(items), "groups")


# A group of the derived items is a connected component over equal hashes and equal prefixes; as equal
# texts have equal prefixes, it is the set of eligible items with one prefix.
GROUPS_SQL = f"""with {ITEMS_SQL}, gr as (select item_id, min(item_id) over (partition by campaign_id) as group_id from items where eligible)"""


@query(f"""{GROUPS_SQL} select item_id, group_id from gr""")
def e2_leakage_groups(spark, sf_dir):
    return _groups(spark, sf_dir)[1]


@query(
    f"""{GROUPS_SQL}, sizes as (select group_id, min("timestamp") as first, count(*) as n from gr join items using (item_id) group by 1),
    run as (select group_id, coalesce(sum(n) over (order by first, group_id rows between unbounded preceding and 1 preceding), 0) / (select sum(n) from sizes) as share from sizes)
    select i.item_id, g.group_id, case when g.group_id is null then 'excluded' when share < 0.6 then 'reference' when share < 0.8 then 'validation' else 'evaluation' end as split
    from items i left join gr g using (item_id) left join run using (group_id)""".replace("share < 0.8", "share < 0.6 + 0.2")
)
def e3_chronological_split(spark, sf_dir):
    return evaluate.chronological_split(*_groups(spark, sf_dir))


@query(f"""with {ITEMS_SQL} select dataset_id as path, max(content_hash) as content_hash from items group by 1""")
def e4_source_hashes(spark, sf_dir):
    return evaluate.source_hashes(v.split_items(spark, sf_dir).select(F.col("dataset_id").alias("path"), "content_hash"))


TRUTH_SQL = f"""{SESSION_EVENTS_SQL}, labels_ as (select event_id, case when line_no % 17 = 0 then 'attack' else 'normal' end as truth from ev where line_no % 5 <> 0),
  truths as (select session_id, case when bool_or(coalesce(truth = 'attack', false)) then 'attack' when bool_and(coalesce(truth = 'normal', false)) then 'normal' else 'unknown' end as truth from se left join labels_ using (event_id) group by 1)"""


def _labels(spark, sf_dir):
    return v.auth_events(spark, sf_dir).where("line_no % 5 <> 0").select("event_id", "source", "line_no", F.when(F.col("line_no") % 17 == 0, "attack").otherwise("normal").alias("truth"))


@query(f"""{SESSION_EVENTS_SQL} select event_id, 'mismatch' as fault from ev where line_no % 5 <> 0 and line_no % 101 = 0""")
def e7_label_faults(spark, sf_dir):
    wrong = _labels(spark, sf_dir).withColumn("line_no", F.when(F.col("line_no") % 101 == 0, F.col("line_no") + 1).otherwise(F.col("line_no")))
    return evaluate.label_faults(wrong, v.auth_events(spark, sf_dir))


@query(f"""{TRUTH_SQL} select session_id, truth from truths""")
def e8_session_truths(spark, sf_dir):
    return evaluate.session_truths(sess.session_events(v.sessions(spark, sf_dir)), _labels(spark, sf_dir))


@query(
    f"""{TRUTH_SQL} select (select count(*) from ev) as events, (select count(*) from labels_) as labelled_events, (select count(*) from ev where "user" is null or src_ip is null) as unmatched_events,
    (select count(*) from ev join labels_ using (event_id) where "user" is null or src_ip is null) as labelled_unmatched_events, (select count(*) from sessions) as sessions,
    (select count(distinct session_id) from sessions where start_time >= timestamp '2024-01-20') as candidate_sessions"""
)
def e9_coverage(spark, sf_dir):
    e, s = v.auth_events(spark, sf_dir), v.sessions(spark, sf_dir)
    return evaluate.coverage(e, _labels(spark, sf_dir), sess.unmatched(e), s, s.where("start_time >= timestamp_ntz '2024-01-20 00:00:00'"))


@query(
    f"""with ev as ({EVENTS_SQL}) select event_id, case when host = 'h0' then case when line_no % 31 = 0 then 'attack' else 'normal' end else 'attack' end as truth from ev"""
)
def e10_derived_labels(spark, sf_dir):
    e = v.auth_events(spark, sf_dir).withColumn("dataset_id", F.col("host"))
    rules = spark.createDataFrame([("h0", "listed"), ("h1", "capture")], "dataset_id string, rule string")
    return evaluate.derive_labels(e, e.where("line_no % 31 = 0").select("source", "line_no"), rules).select("event_id", "truth")


@query(
    f"""with {ITEMS_SQL}, sets as (select content_hash, list_sort(list(distinct dataset_id)) as t from items where item_id not like '%7' group by 1)
    select path, array_to_string(t, ',') as techniques, case when item_id not like '%7' then 'path' else 'content_hash' end as via from items join sets using (content_hash)"""
)
def e11_technique_sets(spark, sf_dir):
    items = v.split_items(spark, sf_dir)
    runs = items.where("item_id not like '%7'").select("path", "content_hash", F.col("dataset_id").alias("technique"))
    return evaluate.technique_sets(runs, items).select("path", F.array_join("techniques", ",").alias("techniques"), "via")


@query("""select source || ':' || case toxic when 1 then 'attack' else 'normal' end as kind, count(*) as n from documents join labels using (doc_id) group by 1""")
def e12_label_summary(spark, sf_dir):
    both = v.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("dataset_id")).join(v.table(spark, sf_dir, "labels"), "doc_id")
    return evaluate.label_summary(both.withColumn("truth", F.when(F.col("toxic") == 1, "attack").otherwise("normal")))


@query(
    f"""with ev as ({EVENTS_SQL}), marks as (select event_id, line_no % 17 = 0 as attack from ev where line_no % 5 <> 0),
    pool as (select * from ev left join marks using (event_id) where attack = false or attack is null)
    select event_id from pool where coalesce("user", '') not in (select distinct coalesce("user", '') from ev join marks using (event_id) where attack and line_no % 3 = 0)"""
)
def e13_normal_pool(spark, sf_dir):
    e = v.auth_events(spark, sf_dir).withColumn("host", F.coalesce("user", F.lit("")))
    marks = _labels(spark, sf_dir).select("event_id", (F.col("truth") == "attack").alias("attack"), "line_no")
    clean = evaluate.normal_pool(e, marks, e.select("source").distinct())
    hit = e.join(marks.where("attack and line_no % 3 = 0").select("event_id"), "event_id").select("host").distinct()
    return clean.join(hit, "host", "left_anti").select("event_id")


@query(
    f"""with {SESSIONS_SQL}, own as (select session_id, host as dataset_id, row_number() over (partition by host order by sha256('seed:' || session_id)) as rank from sessions where src_ip <> '10.0.0.3')
    select session_id, dataset_id, cast(rank as integer) as rank, cast(case dataset_id when 'h1' then 1 else 2 end as bigint) as place from own where rank <= 50"""
)
def e14_stratified_cases(spark, sf_dir):
    s = v.sessions(spark, sf_dir).withColumn("dataset_id", F.col("host")).withColumn("source", F.col("src_ip"))
    indexed = s.where("src_ip = '10.0.0.3'").select("source")
    return evaluate.stratified_cases(s, ["h1", "h0"], 50, "seed", indexed)


def _verdicts(spark, sf_dir):
    r = v.case_runs(spark, sf_dir)
    return r.select(F.expr("case cast(substring(run_id, 2) as bigint) % 8 when 0 then 'attack' when 5 then 'attack' when 7 then 'unknown' else 'normal' end").alias("truth"), "verdict")


CONFUSION_SQL = """agg as (select count(*) filter (where truth = 'attack' and verdict in ('suspicious', 'malicious')) as tp, count(*) filter (where truth = 'attack' and verdict = 'benign') as fn,
  count(*) filter (where truth = 'normal' and verdict in ('suspicious', 'malicious')) as fp, count(*) filter (where truth = 'normal' and verdict = 'benign') as tn,
  count(*) filter (where truth <> 'unknown' and not coalesce(verdict in ('suspicious', 'malicious', 'benign'), false)) as abstained, count(*) filter (where truth = 'unknown') as unknown from rows_)
  select *, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1, round((tp + fp + fn + tn) / (tp + fp + fn + tn + abstained), 6) as coverage from agg"""


@query(f"""with {RUNS_SQL}, rows_ as (select case cast(substr(run_id, 2) as bigint) % 8 when 0 then 'attack' when 5 then 'attack' when 7 then 'unknown' else 'normal' end as truth, verdict from runs), {CONFUSION_SQL}""")
def e15_confusion(spark, sf_dir):
    return evaluate.confusion(_verdicts(spark, sf_dir)).select("tp", "fn", "fp", "tn", "abstained", "unknown", r6("precision"), r6("recall"), r6("f1"), r6("coverage"))


WILSON_SQL = "round(greatest(0, least(1, ((k / n) + {z2} / (2 * n) {s} {z} * sqrt((k / n) * (1 - k / n) / n + {z2} / (4.0 * n * n))) / (1 + {z2} / n))), 6)"
_Z = 1.959963984540054


@query(
    f"""with g as (select source, count(*) as n, sum(toxic) as k from documents join labels using (doc_id) group by 1)
    select source, n, cast(k as bigint) as k, {WILSON_SQL.format(z=_Z, z2=_Z * _Z, s="-")} as low, {WILSON_SQL.format(z=_Z, z2=_Z * _Z, s="+")} as high from g"""
)
def e16_wilson(spark, sf_dir):
    g = v.table(spark, sf_dir, "documents").join(v.table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
    return g.select("source", "n", "k", F.round(wilson("k", "n", False), 6).alias("low"), F.round(wilson("k", "n", True), 6).alias("high"))


@query(f"""with {RUNS_SQL} select round(quantile_cont(seconds, 0.5), 6) as p50_seconds, quantile_disc(seconds, 0.95) as p95_seconds from runs""")
def e17_latency(spark, sf_dir):
    return evaluate.latency(v.case_runs(spark, sf_dir)).select(r6("p50_seconds"), "p95_seconds")


@query(f"""with {RUNS_SQL} select session_id, round(case when sum(calls) > 0 then count(*) / sum(calls) end, 6) as rate from runs group by 1""")
def e18_false_alert_rate(spark, sf_dir):
    g = v.case_runs(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("alerts"), F.sum("calls").alias("hours"))
    return g.select("session_id", F.round(evaluate.false_alert_rate("alerts", "hours"), 6).alias("rate"))


@query(
    f"""with {RUNS_SQL}, last as (select * from (select *, row_number() over (partition by session_id order by started_at desc, run_id desc) as n from runs) where n = 1),
    rows_ as (select case cast(substr(session_id, 2) as bigint) % 4 when 0 then 'attack' when 3 then 'unknown' else 'normal' end as truth, case when state = 'completed' then verdict end as verdict from last), {CONFUSION_SQL}"""
)
def e19_run_evaluation(spark, sf_dir):
    runs = v.case_runs(spark, sf_dir)
    ids = runs.select("session_id").distinct()
    truths = ids.select("session_id", F.expr("case cast(substring(session_id, 2) as bigint) % 4 when 0 then 'attack' when 3 then 'unknown' else 'normal' end").alias("truth"))
    return evaluate.evaluate_runs(runs, truths, ids.select(F.col("session_id").alias("item_id"))).select("tp", "fn", "fp", "tn", "abstained", "unknown", r6("precision"), r6("recall"), r6("f1"), r6("coverage"))


@query(
    f"""with {RUNS_SQL} select count(*) as cases_run, count(verdict) as completed, count(*) filter (where verdict = 'insufficient_evidence') as abstained, count(grounded) as reports_checked,
    count(*) filter (where grounded) as grounded, count(*) filter (where repaired) as repair_attempted, cast(sum(cited) as bigint) as cited_handles, cast(sum(calls) as bigint) as tool_calls, max(calls) as calls_per_run_max,
    cast(sum(tokens_in) as bigint) as input_tokens, round(count(verdict) / count(*), 6) as completion_rate, round(count(*) filter (where grounded) / count(grounded), 6) as citation_validity,
    round(sum(tokens_in) * 0.5 / 1e6 + sum(tokens_out) * 1.5 / 1e6, 6) as cost from runs"""
)
def e21_run_measures(spark, sf_dir):
    m = evaluate.measure_runs(v.case_runs(spark, sf_dir))
    return m.select("cases_run", "completed", "abstained", "reports_checked", "grounded", "repair_attempted", "cited_handles", "tool_calls", "calls_per_run_max", "input_tokens", r6("completion_rate"), r6("citation_validity"), evaluate.cost("input_tokens", "output_tokens", 0.5, 1.5).alias("cost"))


@query(
    f"""with {RUNS_SQL} select case when contains(lower(coalesce(reason, '')), 'citation validation') then 'grounding_refused' when contains(lower(coalesce(reason, '')), 'provider request failed') then 'provider_error'
    when contains(lower(coalesce(reason, '')), 'budget exhausted') then 'budget' when contains(lower(coalesce(reason, '')), 'cancel') then 'cancelled' else 'other' end as kind, count(*) as n from runs where state <> 'completed' group by 1"""
)
def e21_failure_kinds(spark, sf_dir):
    return evaluate.incomplete_kinds(v.case_runs(spark, sf_dir))


@query(
    """with c as (select o_orderkey as case_id, o_orderkey % 5 <> 0 as reported, 'T1' || lpad(cast(o_custkey % 20 as varchar), 3, '0') || case when o_orderkey % 3 = 0 then '.00' || (o_orderkey % 2) else '' end as p,
      'T1' || lpad(cast(o_orderkey % 20 as varchar), 3, '0') || case when o_orderkey % 2 = 0 then '.00' || (o_custkey % 2) else '' end as t, o_orderkey % 7 = 0 as none from orders)
    select case_id, case when not reported then 'no_report' when none then 'none_proposed' when p = t then 'exact' when split_part(p, '.', 1) = split_part(t, '.', 1) then 'parent' else 'mismatch' end as match from c"""
)
def e22_technique_matches(spark, sf_dir):
    o = v.table(spark, sf_dir, "orders")
    c = o.selectExpr(
        "o_orderkey as case_id", "o_orderkey % 5 <> 0 as reported",
        "if(o_orderkey % 7 = 0, array('no id'), array(concat(' seen t1', lpad(o_custkey % 20, 3, '0'), if(o_orderkey % 3 = 0, concat('.00', o_orderkey % 2), ''), ' here'))) as proposed",
        "array(concat('T1', lpad(o_orderkey % 20, 3, '0'), if(o_orderkey % 2 = 0, concat('.00', o_custkey % 2), ''))) as truth",
    )
    return evaluate.technique_matches(c)


# --- block traces --------------------------------------------------------------------------------

BLOCKS_SQL = f"""with {TRACES_SQL}, n as (select count(*) as n from tr),
  ends as (select (select first_line from tr order by first_line offset (select cast(floor(n * 0.6) as bigint) from n) limit 1) as t, (select first_line from tr order by first_line offset (select cast(floor(n * (0.6 + 0.2)) as bigint) from n) limit 1) as v),
  sp as (select tr.*, case when last_line < t then 'train' when first_line >= t and last_line < v then 'validation' when first_line >= v then 'evaluation' else 'cross' end as split from tr, ends)"""
SCORES_SQL = f"""{BLOCKS_SQL}, normal as (select * from sp where split = 'train' and not anomaly),
  st as (select block, unnest(list_concat(['<start>'], events[1:len(events) - 1])) as context, unnest(events) as event from sp),
  pc as (select context, event, count(*) as c from st join normal using (block) group by all), cc as (select context, sum(c) as n from pc group by 1), vocab as (select count(distinct event) as v from pc),
  surprise as (select block, avg(s) as mean, max(s) as peak from (select st.block, -ln((coalesce(c, 0) + 1.0) / (coalesce(cc.n, 0) + v + 1.0)) as s from st left join pc using (context, event) left join cc using (context), vocab) group by 1),
  lb as (select *, case when length <= 2 then '2' when length <= 5 then '5' when length <= 10 then '10' when length <= 20 then '20' when length <= 50 then '50' when length <= 100 then '100' else '>100' end as bin from sp),
  bc as (select bin, count(*) as c from lb join (select block from normal) using (block) group by 1),
  scored as (select lb.*, mean, peak, -ln((coalesce(c, 0) + 1.0) / ((select count(*) from normal) + 7.0)) as rarity from lb join surprise using (block) left join bc using (bin)),
  blend as (select block, anomaly, split, length, first_line, 'mean' as candidate, 0 as rank, round(mean, 9) as score from scored union all select block, anomaly, split, length, first_line, 'mean_length', 1, round(mean + rarity, 9) from scored
    union all select block, anomaly, split, length, first_line, 'mean_peak', 2, round(mean + peak, 9) from scored union all select block, anomaly, split, length, first_line, 'mean_length_peak', 3, round(mean + rarity + peak, 9) from scored),
  th as (select candidate, q, case q when 0.95 then quantile_disc(score, 0.95) when 0.97 then quantile_disc(score, 0.97) else quantile_disc(score, 0.99) end as threshold from blend, (select unnest([0.95, 0.97, 0.99]) as q) where split = 'validation' and not anomaly group by candidate, q),
  grid as (select candidate, rank, q as quantile, threshold, count(*) filter (where anomaly and score > threshold) as tp, count(*) filter (where anomaly and score <= threshold) as fn, count(*) filter (where not anomaly and score > threshold) as fp,
    count(*) filter (where not anomaly and score <= threshold) as tn from blend join th using (candidate) where split = 'validation' group by all)"""


def _split_traces(spark, sf_dir):
    t = materialize(v.traces(spark, sf_dir), "traces")
    return tr.split_by_bounds(t, *tr.boundary_lines(t))


def _blended(spark, sf_dir):
    t = materialize(_split_traces(spark, sf_dir), "traces")
    normal = t.where("split = 'train' and not anomaly")
    scored = tr.length_rarity(normal, t).join(tr.surprise(t, tr.fit_baseline(normal)), "block")
    return tr.blends(scored).withColumn("score", F.round("score", 9)).drop("events")


@query(f"""with {TRACES_SQL} select block, cast(first_line as bigint) as first_line, cast(last_line as bigint) as last_line from bounds""")
def b1_block_bounds(spark, sf_dir):
    lines = v.trace_lines(spark, sf_dir).select("line_no", F.concat(F.lit("INFO block "), F.col("block"), F.lit(" seen again: "), F.col("block")).alias("text"))
    return tr.block_bounds(lines)


@query(f"""{BLOCKS_SQL} select split, count(*) as n, count(*) filter (where anomaly) as anomalies from sp group by 1""")
def b3_split_counts(spark, sf_dir):
    return _split_traces(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"), F.count_if("anomaly").alias("anomalies"))


@query("""select 'blk_' || l_orderkey as block, 'no_labels' as fault from (select distinct l_orderkey from lineitem) where l_orderkey % 50 = 0 union all select 'blk_' || l_orderkey, 'no_traces' from (select distinct l_orderkey from lineitem) where l_orderkey % 70 = 0""")
def b4_integrity(spark, sf_dir):
    blocks = v.trace_lines(spark, sf_dir).select("block").distinct()
    number = F.substring("block", 5, 20).cast("bigint")
    return tr.integrity(blocks, blocks.where(number % 50 != 0), blocks.where(number % 70 != 0))


@query(f"""{SCORES_SQL} select block, round(mean, 6) as mean, round(peak, 6) as peak from surprise""")
def b6_surprise(spark, sf_dir):
    t = materialize(_split_traces(spark, sf_dir), "traces")
    return tr.surprise(t, tr.fit_baseline(t.where("split = 'train' and not anomaly"))).select("block", r6("mean"), r6("peak"))


@query(f"""{SCORES_SQL} select block, candidate, round(score, 6) as score from blend where split = 'evaluation'""")
def b11_blends(spark, sf_dir):
    return _blended(spark, sf_dir).where("split = 'evaluation'").select("block", "candidate", r6("score"))


@query(f"""{SCORES_SQL} select candidate, quantile, round(threshold, 6) as threshold, tp, fn, fp, tn, round(case when tp + fp > 0 then tp / (tp + fp) end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) end, 6) as recall from grid""")
def b12_grid(spark, sf_dir):
    grid = tr.selection_grid(materialize(_blended(spark, sf_dir).where("split = 'validation'"), "validation"))
    return grid.select("candidate", F.col("quantile").cast("double").alias("quantile"), r6("threshold"), "tp", "fn", "fp", "tn", r6("precision"), r6("recall"))


@query(
    f"""{SCORES_SQL} select candidate, quantile, tp, fp from (select *, coalesce(tp / nullif(tp + fn, 0), 0) >= 0.01 as ok, tp / nullif(tp + fp, 0) as p, tp / nullif(tp + fn, 0) as r from grid)
    order by ok desc, case when ok then coalesce(p, -1) end desc nulls last, case when ok then r end desc nulls last, rank, quantile limit 1"""
)
def b12_choice(spark, sf_dir):
    grid = tr.selection_grid(materialize(_blended(spark, sf_dir).where("split = 'validation'"), "validation"))
    return tr.choose(grid, 0.01).select("candidate", F.col("quantile").cast("double").alias("quantile"), "tp", "fp")


@query(
    f"""{SCORES_SQL}, e as (select *, score > (select quantile_disc(score, 0.95) from blend where split = 'validation' and not anomaly and candidate = 'mean') as alert from blend where split = 'evaluation' and candidate = 'mean')
    select tp, fn, fp, tn, round(case when tp + fp > 0 then tp / (tp + fp) end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) end, 6) as recall from (select count(*) filter (where anomaly and alert) as tp, count(*) filter (where anomaly and not alert) as fn,
      count(*) filter (where not anomaly and alert) as fp, count(*) filter (where not anomaly and not alert) as tn from e)"""
)
def b14_frozen_rule(spark, sf_dir):
    rows = materialize(_blended(spark, sf_dir).where("candidate = 'mean'"), "rows")
    threshold = tr.normal_threshold(rows.where("split = 'validation'"), 0.95)
    return tr.confusion(rows.where("split = 'evaluation'").withColumn("alert", F.col("score") > threshold)).select("tp", "fn", "fp", "tn", r6("precision"), r6("recall"))


@query(
    f"""{SCORES_SQL}, e as (select *, case when anomaly then case when score > 1.5 then 'tp' else 'fn' end else case when score > 1.5 then 'fp' else 'tn' end end as kind from blend where split = 'validation' and candidate = 'mean'),
    b as (select e.*, bin from e join lb using (block)) select kind, bin, count(*) as n, arg_min(block, first_line) as first_block, arg_max(block, first_line) as last_block, min(length) as shortest, max(length) as longest from b group by 1, 2"""
)
def b13_error_analysis(spark, sf_dir):
    rows = _blended(spark, sf_dir).where("split = 'validation' and candidate = 'mean'").withColumn("alert", F.col("score") > 1.5)
    return tr.error_analysis(rows)


@query(
    f"""{SCORES_SQL}, e as (select block, case when anomaly and score <= 1.5 then 'missed' when not anomaly and score > 1.5 then 'false_alert' end as kind from blend where split = 'validation' and candidate = 'mean')
    select kind, cast(place as integer) as place, block from (select *, row_number() over (partition by kind order by block) as place from e where kind is not null) where place <= 3"""
)
def b9_first_errors(spark, sf_dir):
    return tr.first_errors(_blended(spark, sf_dir).where("split = 'validation' and candidate = 'mean'").withColumn("alert", F.col("score") > 1.5))


@query(
    f"""with {TRACES_SQL}, p as (select 'blk_' || l_orderkey as block, line_no, row_number() over (partition by l_orderkey order by line_no) as place, count(*) over (partition by l_orderkey) as n from tl where l_orderkey % 10 = 3)
    select block, cast(line_no as bigint) as line_no, n > 3 as truncated from p where place <= 3"""
)
def b15_inspect(spark, sf_dir):
    lines = v.trace_lines(spark, sf_dir)
    wanted = lines.select("block").distinct().where(F.substring("block", 5, 20).cast("bigint") % 10 == 3)
    return tr.inspect_blocks(lines, wanted, 3).select("block", "line_no", "truncated")


# --- retrieval -----------------------------------------------------------------------------------

STOP_SQL = ", ".join(f"'{w}'" for w in retrieval.STOP)
BM25_SQL = f"""with toks as (select doc_id, list_filter(regexp_extract_all(lower(text), '([a-z0-9][a-z0-9_.\\-]*)', 1), lambda w: length(w) > 1 and w not in ({STOP_SQL})) as w from documents),
  tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from toks) group by all), len as (select doc_id, len(w) as n from toks), df as (select term, count(*) as df from tf group by 1),
  stats as (select count(*) as docs, avg(n) as mean from len),
  q as (select distinct item_id, unnest(list_filter(regexp_extract_all(lower(text), '([a-z0-9][a-z0-9_.\\-]*)', 1), lambda w: length(w) > 1 and w not in ({STOP_SQL}))) as term from benchmark),
  share as (select item_id, doc_id, term, round(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean)), 6) as s from q join df using (term) join tf using (term) join len using (doc_id), stats),
  scored as (select item_id, doc_id, round(sum(s), 6) as score, count(*) as terms from share group by all)"""


@query(f"""{BM25_SQL} select item_id as query_id, doc_id as document_id, score, terms, cast(rank as integer) as rank from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored) where rank <= 10""")
def k3_bm25(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    queries = v.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.bm25(queries, docs, 10).select("query_id", "document_id", "score", F.size("terms").cast("bigint").alias("terms"), "rank")


@query(f"""{BM25_SQL} select term, df from df""")
def k2_document_frequencies(spark, sf_dir):
    return retrieval.postings(v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text"))[2]


@query(
    """with d as (select doc_id, source || '/T1' || lpad(cast(doc_id % 30 as varchar), 3, '0') || '_x/' || lpad(cast(doc_id as varchar), 9, '0') as path, text from documents),
    s as (select 'T1' || lpad(cast(doc_id % 30 as varchar), 3, '0') as technique_id, path, sha256(text) as sha256,
      left(array_to_string((list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> ''))[1:40], chr(10)), 4000) as snippet from d where doc_id % 9 <> 0)
    select technique_id, path, snippet, sha256 from (select *, row_number() over (partition by technique_id order by path) as place from s where snippet <> '') where place <= 3"""
)
def k4_folder_corpus(spark, sf_dir):
    d = v.table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/T1"), F.lpad((F.col("doc_id") % 30).cast("string"), 3, "0"), F.lit("_x/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), "text")
    return retrieval.folder_corpus(d, d.where("doc_id % 9 = 0"))


@query(f"""{GROUPS_SQL}, bad as (select distinct dataset_id as path from items where not eligible and item_id like '%3') select path from bad""")
def k7_held_out(spark, sf_dir):
    items = v.split_items(spark, sf_dir)
    entries = items.select(F.concat_ws(":", "dataset_id", "item_id").alias("item_id"), F.when(~F.col("eligible") & F.col("item_id").endswith("3"), "validation").otherwise("reference").alias("split"))
    return retrieval.held_out_paths(entries, items.select(F.col("dataset_id").alias("path")))


@query("""select 'L:' || lang as technique_id, array_to_string(list_sort(list(cast(doc_id as varchar))), ',') as documents from documents group by lang union all select 'L:none', ''""")
def k9_lookup(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.array(F.concat(F.lit("L:"), "lang")).alias("technique_ids"))
    ids = docs.select(F.explode("technique_ids").alias("technique_id")).distinct().unionByName(docs.limit(1).select(F.lit("L:none").alias("technique_id")))
    return retrieval.lookup_techniques(ids, docs).select("technique_id", F.array_join("documents", ",").alias("documents"))


# --- tokens, redaction, citations ----------------------------------------------------------------


@query(
    f"""with ev as ({EVENTS_SQL}), vals as (select 'user' as field, "user" as value, min(line_no) as f from ev where "user" is not null group by 2 union all select 'src_ip', src_ip, min(line_no) from ev where src_ip is not null group by 2
      union all select 'host', host, min(line_no) from ev group by 2)
    select field, value, 'TOKEN_' || field || '_' || (row_number() over (partition by field order by f, value) - 1) as token from vals"""
)
def r1_token_map(spark, sf_dir):
    return redact.token_map(v.auth_events(spark, sf_dir), ["user", "src_ip", "host"], "line_no").select("field", "value", "token")


@query(f"""with ev as ({EVENTS_SQL}) select event_id, "user", src_ip, host from ev""")
def r2_round_trip(spark, sf_dir):
    fields = ["user", "src_ip", "host"]
    e = v.auth_events(spark, sf_dir)
    tokens = materialize(redact.token_map(e, fields, "line_no"), "tokens")
    hidden = redact.apply_map(e.select("event_id", *fields), tokens, fields)
    return redact.apply_map(hidden, tokens, fields, back=True).select("event_id", *fields)


_KEY = b"salt".ljust(64, b"\0")
_IN, _OUT = ("".join(f"\\x{b ^ x:02x}" for b in _KEY) for x in (0x36, 0x5C))
# HMAC by its definition, over the bytes of kind, NUL and identifier.
HANDLE_SQL = f"""'ev-' || left(sha256('{_OUT}'::blob || unhex(sha256('{_IN}'::blob || encode('ev') || '\\x00'::blob || encode(event_id)))), 10)"""


@query(f"""with ev as ({EVENTS_SQL}) select event_id, {HANDLE_SQL} as handle from ev""")
def r4_handles(spark, sf_dir):
    return redact.handles(v.auth_events(spark, sf_dir), b"salt", "ev", "event_id").select("event_id", "handle")


@query(
    f"""with ev as ({EVENTS_SQL}), vals as (select host as run, "user" as value, min(line_no) as f from ev where "user" is not null group by all)
    select run, 'user' as field, value, 'user-' || row_number() over (partition by run order by f, value) as pseudonym from vals"""
)
def r5_pseudonyms(spark, sf_dir):
    return redact.pseudonyms(v.auth_events(spark, sf_dir).withColumn("run", F.col("host")), ["user"], "line_no", "run")


REDACT_SQL = r"regexp_replace(regexp_replace(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b', '[ip]', 'g'), '(?i)\b[0-9a-f]{16,}\b', '[digest]', 'g')"


@query(f"""with r as (select doc_id, {REDACT_SQL} as t from documents) select doc_id, case when length(t) > 400 then left(t, 400) || '...[truncated]' else t end as redacted from r""")
def r6_redact(spark, sf_dir):
    return v.table(spark, sf_dir, "documents").select("doc_id", redact.redact_text("text").alias("redacted"))


@query(
    f"""with ev as ({EVENTS_SQL}) select host as run_id, 'ev-' || line_no as handle, case when line_no % 10 = 0 then 'uncited_handle' when line_no % 7 = 0 then 'unresolvable_handle' when line_no % 11 = 0 then 'missing_evidence'
    when line_no % 13 = 0 then 'excerpt_mismatch' end as issue from ev where line_no % 2 = 0"""
)
def r9_citations(spark, sf_dir):
    e = v.auth_events(spark, sf_dir)
    own = e.where("line_no % 2 = 0").select(F.col("host").alias("run_id"), F.concat(F.lit("ev-"), F.col("line_no").cast("string")).alias("handle"), "line_no", "event_id", "raw_message")
    cited = own.select("run_id", "handle", F.when(F.col("line_no") % 13 == 0, "nowhere to be found").otherwise(F.concat(F.lit("  "), F.regexp_replace("raw_message", " ", "   "))).alias("excerpt"))
    resolved = own.where("line_no % 7 <> 0").select("run_id", "handle", F.when(F.col("line_no") % 11 == 0, "gone").otherwise(F.col("event_id")).alias("identifier"))
    return redact.check_citations(cited, own.where("line_no % 10 <> 0"), resolved, e)


@query(
    f"""{SESSION_EVENTS_SQL} select 'r' as run_id, 'se-' || session_id as handle, cast(ordinal as integer) as ordinal, event_id, raw_message from se join ev using (event_id) where ordinal < 2"""
)
def r10_resolve(spark, sf_dir):
    s = v.sessions(spark, sf_dir)
    cited = s.select(F.lit("r").alias("run_id"), F.concat(F.lit("se-"), "session_id").alias("handle"))
    resolved = s.select(F.lit("r").alias("run_id"), F.concat(F.lit("se-"), "session_id").alias("handle"), F.col("session_id").alias("identifier"))
    return redact.resolve_citations(cited, resolved, sess.session_events(s), v.auth_events(spark, sf_dir), 2).select("run_id", "handle", "ordinal", "event_id", "raw_message")


# --- history, cases, tables ----------------------------------------------------------------------


@query(
    f"""with {SESSIONS_SQL}, ent as (select distinct 'user' as entity_type, "user" as entity_id, timestamp '2024-01-15' as before from sessions union all select distinct 'host', host, timestamp '2024-01-15' from sessions)
    select entity_type, entity_id, count(session_id) as sessions, cast(coalesce(sum(event_count), 0) as bigint) as events, min(start_time) as window_start, max(end_time) as window_end, count(distinct s.host) as hosts, count(distinct s."user") as users,
      count(distinct s.src_ip) as src_ips from ent left join sessions s on s.end_time < before and case entity_type when 'user' then s."user" else s.host end = entity_id group by 1, 2"""
)
def q1_entity_history(spark, sf_dir):
    s = materialize(v.sessions(spark, sf_dir).select("user", "src_ip", "host", "start_time", "end_time", "event_count"), "sessions")
    boundary = F.expr("timestamp_ntz '2024-01-15 00:00:00'").alias("before")
    ent = s.select(F.lit("user").alias("entity_type"), F.col("user").alias("entity_id"), boundary).unionByName(s.select(F.lit("host").alias("entity_type"), F.col("host").alias("entity_id"), boundary)).distinct()
    return cases.entity_history(ent, s).drop("before")


@query(
    f"""with {SESSIONS_SQL}, {RUNS_SQL}, sc as (select session_id, case when event_count % 3 <> 0 then cast(event_count as double) / 7 end as score, host as h from sessions),
    own as (select s.*, 'case-' || left(sha256(s.session_id), 20) as case_id from sessions s)
    select own.session_id, case_id, round(score, 6) as score, case when event_count % 2 = 0 then 'benign' end as disposition from own join sc using (session_id) order by score desc nulls last, start_time, own.session_id limit 60 offset 20"""
)
def q3_case_queue(spark, sf_dir):
    s = v.sessions(spark, sf_dir)
    scores = s.select("session_id", F.when(F.col("event_count") % 3 != 0, F.col("event_count").cast("double") / 7).alias("score"), F.col("end_time").alias("created_at"))
    older = scores.select("session_id", F.lit(99.0).alias("score"), F.expr("created_at - interval 1 day").alias("created_at"))
    decided = s.where("event_count % 2 = 0").select(cases.case_id().alias("case_id"), F.lit("benign").alias("disposition"), F.col("end_time").alias("decided_at"))
    queue = cases.case_queue(s, scores.unionByName(older), v.case_runs(spark, sf_dir), decided, True, 20, 60)
    return queue.select("session_id", "case_id", r6("score"), "disposition")


@query(
    f"""with {RUNS_SQL} select run_id, case when state = 'running' then 'in_progress' when state = 'completed' then 'report_published' when interrupted then 'interrupted' when grounding_failed then 'grounding_failed'
    when contains(coalesce(reason, ''), 'budget exhausted') then 'budget_exhausted' when contains(coalesce(reason, ''), 'provider') then 'provider_unavailable' else 'failed' end as outcome from runs"""
)
def q5_run_outcomes(spark, sf_dir):
    return v.case_runs(spark, sf_dir).withColumnRenamed("reason", "incomplete_reason").select("run_id", cases.run_outcome().alias("outcome"))


@query(f"""with {RUNS_SQL} select session_id, count(*) as runs, count(*) filter (where state = 'completed') as completed, arg_max(run_id, (started_at, run_id)) as latest_run, arg_max(state, (started_at, run_id)) as latest_state from runs group by 1""")
def q6_run_summary(spark, sf_dir):
    return cases.run_summary(v.case_runs(spark, sf_dir))


@query("""select distinct source as dataset_id from documents""")
def q7_dataset_ids(spark, sf_dir):
    return cases.dataset_ids(v.table(spark, sf_dir, "documents").select(F.col("source").alias("dataset_id")))


@query("""select 'events' as "table", count(*) as n from events union all select 'orders', count(*) from orders union all select 'documents', count(*) from documents""")
def s18_table_counts(spark, sf_dir):
    from siftlog.sources.files import table_counts

    return table_counts({t: v.table(spark, sf_dir, t) for t in ("events", "orders", "documents")})


@query(f"""with ev as ({EVENTS_SQL}) select event_id, line_no, ts, "user", success from ev""")
def s13_json_round_trip(spark, sf_dir):
    from siftlog.sources.files import from_json, to_json

    e = v.auth_events(spark, sf_dir).select("event_id", "line_no", "ts", "user", "success")
    return from_json(to_json(e), "event_id string, line_no bigint, ts timestamp_ntz, user string, success boolean")


@query()
def s4_manifest(spark, sf_dir):
    from siftlog.sources.files import manifest

    return manifest(spark, sf_dir, "*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"), "size", "sha256", "role")


@query("""select source as dataset_id, count(*) as files, count(*) filter (where doc_id % 5 <> 0) as verified, cast(sum(case when doc_id % 5 <> 0 then n_chars else 0 end) as bigint) as bytes,
    case when count(*) = count(*) filter (where doc_id % 5 <> 0) then 'available' when count(*) filter (where doc_id % 5 <> 0) > 0 then 'incomplete' else 'not_imported' end as status from documents group by 1""")
def s6_dataset_summary(spark, sf_dir):
    from siftlog.sources.files import dataset_summary

    d = v.table(spark, sf_dir, "documents").select(F.col("source").alias("dataset_id"), F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), F.sha2("text", 256).alias("sha256"), F.lit("log").alias("role"), "doc_id")
    found = d.select("path", F.when(F.col("doc_id") % 5 == 0, "changed").otherwise(F.col("sha256")).alias("sha256"))
    return dataset_summary(d, found).select("dataset_id", "files", "verified", "bytes", "status")


@query("""select cast(doc_id as varchar) as path, case when doc_id % 3 = 0 then 'new' when doc_id % 5 = 0 then 'collision' else 'same' end as kind from documents where doc_id % 3 = 0 or doc_id % 5 = 0""")
def s14_import(spark, sf_dir):
    from siftlog.sources.files import import_sources

    d = v.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("dataset_id"), F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    stored = d.where("doc_id % 3 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("sha256")))
    new, hit = import_sources(stored, d)
    return new.select("path", F.lit("new").alias("kind")).unionByName(hit.select("path", F.lit("collision").alias("kind")))


# --- the rest of the inventory -------------------------------------------------------------------


@query(f"""select line_no, case when line_no % 97 <> 0 then host end as host, case when line_no % 97 <> 0 and event_type <> 'sudo_command' then line_no end as pid from ({EVENTS_SQL})""")
def p1_headers(spark, sf_dir):
    return parse.split_header(v.auth_lines(spark, sf_dir)).select("line_no", "host", "pid")


@query(
    f"""with ev as ({EVENTS_SQL}), l as (select line_no, ts, case line_no % 3 when 0 then 'UTC' when 1 then 'Asia/Kolkata' else 'Asia/Tokyo' end as zone from ev)
    select line_no, date_trunc('second', ts) - case zone when 'UTC' then interval 0 minutes when 'Asia/Kolkata' then interval 330 minutes else interval 540 minutes end as instant from l"""
)
def p5_timestamps(spark, sf_dir):
    zone = F.when(F.col("line_no") % 3 == 0, "UTC").when(F.col("line_no") % 3 == 1, "Asia/Kolkata").otherwise("Asia/Tokyo")
    lines = v.auth_events(spark, sf_dir).select("line_no", F.date_format("ts", "MMM d HH:mm:ss").alias("stamp"), F.lit(2024).alias("year"), zone.alias("zone"), F.lit(None).cast("int").alias("dst_fold"))
    return parse.parse_timestamps(lines).select("line_no", F.col("timestamp").cast("timestamp_ntz").alias("instant"))


@query("""select doc_id, case doc_id % 4 when 0 then 'q' || doc_id when 1 then 't' || doc_id when 2 then 'run' || doc_id end as campaign from documents""")
def e1_campaigns(spark, sf_dir):
    d = v.table(spark, sf_dir, "documents")
    path = F.expr("case doc_id % 4 when 0 then concat('a/sequences/q', doc_id, '/x') when 1 then concat('a/steps/t', doc_id, '/x') when 2 then concat('b/techniques/T1/run', doc_id, '/y') else concat('c/', doc_id) end")
    return d.select("doc_id", path.alias("path")).select("doc_id", evaluate.campaign_id().alias("campaign"))


@query("""select cast(doc_id % 700 as varchar) as item_id, count(*) as n from documents group by 1 having count(*) > 1""")
def e5_repeated_items(spark, sf_dir):
    return evaluate.repeated_items(v.table(spark, sf_dir, "documents").select((F.col("doc_id") % 700).cast("string").alias("item_id")))


@query("""select 's' || doc_id as item_id, case when doc_id % 4 <> 0 then source end as source from documents where doc_id % 4 = 0 or doc_id % 6 = 0 or doc_id % 10 = 1""".replace(" or doc_id % 10 = 1", ""))
def e6_hash_mismatches(spark, sf_dir):
    d = v.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("session_id"), "source")
    sources = d.select("source").distinct().withColumn("content_hash", F.lit("h"))
    entries = d.select(F.col("session_id").alias("item_id"), F.when(F.col("doc_id") % 6 == 0, "old").otherwise("h").alias("content_hash"))
    return evaluate.hash_mismatches(entries, d.where("doc_id % 4 <> 0").select("session_id", "source"), sources)


@query("""with c as (select case toxic when 1 then 'attack' else 'normal' end as truth, source from documents join labels using (doc_id))
    select (select count(*) from (select source from c where truth = 'attack' intersect select source from c where truth = 'normal')) = 0 as truth_follows_dataset, cast(0 as bigint) as several_techniques""")
def e23_confounds(spark, sf_dir):
    both = v.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("dataset_id")).join(v.table(spark, sf_dir, "labels"), "doc_id")
    return evaluate.confounds(both.select("dataset_id", F.when(F.col("toxic") == 1, "attack").otherwise("normal").alias("truth"), F.array(F.lit("T1")).alias("techniques")))


@query(f"""{BLOCKS_SQL} select cast(t as bigint) as train_end, cast(v as bigint) as validation_end from ends""")
def b2_boundaries(spark, sf_dir):
    ends = tr.boundary_lines(materialize(v.traces(spark, sf_dir).select("first_line"), "bounds"))
    return spark.createDataFrame([ends], "train_end bigint, validation_end bigint")


@query(f"""{SCORES_SQL} select context, event, cast(c as bigint) as c from pc""")
def b5_baseline(spark, sf_dir):
    return tr.fit_baseline(_split_traces(spark, sf_dir).where("split = 'train' and not anomaly"))[0]


@query(f"""{SCORES_SQL} select block, bin, round(rarity, 6) as rarity from scored""")
def b10_length_rarity(spark, sf_dir):
    t = materialize(_split_traces(spark, sf_dir), "traces")
    return tr.length_rarity(t.where("split = 'train' and not anomaly"), t).select("block", "bin", r6("rarity"))


@query(f"""{SCORES_SQL} select q as quantile, round(threshold, 6) as threshold from th where candidate = 'mean' and q = 0.95""")
def b7_threshold(spark, sf_dir):
    rows = _blended(spark, sf_dir).where("candidate = 'mean' and split = 'validation'")
    return spark.createDataFrame([(0.95, tr.normal_threshold(rows, 0.95))], "quantile double, threshold double").select("quantile", r6("threshold"))


@query(f"""{BM25_SQL} select doc_id as document_id, len(w) as length, array_to_string(w[1:5], ' ') as head from toks""")
def k1_tokens(spark, sf_dir):
    return v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), retrieval.tokenize("text").alias("w")).select("document_id", F.size("w").cast("bigint").alias("length"), F.array_join(F.slice("w", 1, 5), " ").alias("head"))


@query("""select 'd' || doc_id as document_id, length(text) as n from documents union all select 'b' || item_id, length(text) from benchmark""")
def k8_corpus(spark, sf_dir):
    one = lambda t, key, mark: v.table(spark, sf_dir, t).select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("document_id"), "text")
    docs = retrieval.assemble(one("documents", "doc_id", "d"), one("benchmark", "item_id", "b"))
    return docs.select("document_id", F.length("text").cast("bigint").alias("n"))


@query(
    f"""with ev as ({EVENTS_SQL}), old as (select "user" as value, min(line_no) as f from ev where "user" is not null and line_no <= 200 group by 1), o as (select value, row_number() over (order by f, value) - 1 as n from old),
    new as (select "user" as value, min(line_no) as f from ev where "user" is not null and "user" not in (select value from old) group by 1)
    select value, 'TOKEN_user_' || n as token from o union all select value, 'TOKEN_user_' || ((select count(*) from o) + row_number() over (order by f, value) - 1) from new"""
)
def r3_extended_map(spark, sf_dir):
    e = v.auth_events(spark, sf_dir)
    known = materialize(redact.token_map(e.where("line_no <= 200"), ["user"], "line_no"), "tokens")
    return redact.extend_map(known, e, ["user"], "line_no").select("value", "token")


@query(f"""with ev as ({EVENTS_SQL}) select {HANDLE_SQL} as handle, host, src_ip, "user", event_type, success, method from ev""")
def r7_outbound(spark, sf_dir):
    return redact.outbound(v.auth_events(spark, sf_dir), redact.EVENT_FIELDS, b"salt", "ev", "event_id")


LEAK_SQL = f"""with ev as ({EVENTS_SQL}), p as (select distinct host as run, case line_no % 9 when 0 then 'user=' || "user" when 1 then "user" || '@web01' when 2 then src_ip || ':' || src_port when 3 then '/home/' || "user" || '/x'
      when 4 then "user" || '-laptop' when 5 then '{{"host":"' || src_ip || '"}}' when 6 then 'John' || "user" || 'Doe' end as payload from ev),
    ids as (select distinct host as run, "user" as identifier from ev union select distinct host, src_ip from ev)"""


@query(f"""{LEAK_SQL} select p.run, payload, identifier from p join ids on p.run = ids.run and contains(payload, identifier)""")
def r8_leaked(spark, sf_dir):
    """A run per host: users and addresses inside words, paths, JSON and with ports."""
    e = v.auth_events(spark, sf_dir).withColumn("run", F.col("host"))
    payload = F.expr(
        """case line_no % 9 when 0 then 'user=' || user when 1 then user || '@web01' when 2 then src_ip || ':' || src_port when 3 then '/home/' || user || '/x'
        when 4 then user || '-laptop' when 5 then '{"host":"' || src_ip || '"}' when 6 then 'John' || user || 'Doe' end"""
    )
    identifiers = e.select("run", F.col("user").alias("identifier")).unionByName(e.select("run", F.col("src_ip").alias("identifier")))
    return redact.leaked(e.select("run", payload.alias("payload")), identifiers, "run")


@query(f"""with ev as ({EVENTS_SQL}) select event_id, unnest(list_filter([case when line_no % 4 = 0 then 'label' end, case when line_no % 6 = 0 then 'Token' end, 'raw_message'], lambda k: k is not null)) as key from ev""")
def r8_forbidden_keys(spark, sf_dir):
    """Keys inside JSON texts and maps, and a field."""
    e = v.auth_events(spark, sf_dir)
    text = F.when(F.col("line_no") % 4 == 0, F.lit('{"a": [{"\\u006cabel" : 1}], "b": "label"}')).otherwise(F.lit('{"a": "label: \\"label\\" :"}'))
    rows = e.select("event_id", "raw_message", text.alias("text"), F.expr("map(if(line_no % 6 = 0, 'Token', 'user'), user)").alias("fields"))
    return redact.forbidden_keys(rows, "event_id", ("text",))


@query(f"""with ev as ({EVENTS_SQL}) select event_id as run_id, 'user-' || (line_no % 5) as pseudonym, case when line_no % 5 <> 3 then 'v' || (line_no % 5) end as value from ev""")
def r11_mentions(spark, sf_dir):
    e = v.auth_events(spark, sf_dir).select(F.col("event_id").alias("run_id"), (F.col("line_no") % 5).cast("string").alias("k"))
    texts = e.select("run_id", F.concat(F.lit("seen user-"), "k", F.lit(", then user-"), "k", F.lit(" again")).alias("text"))
    names = e.where("k <> '3'").select("run_id", F.concat(F.lit("user-"), "k").alias("pseudonym"), F.concat(F.lit("v"), "k").alias("value"))
    return redact.mentioned(texts, names)


@query(f"""{SESSION_EVENTS_SQL} select 'case-' || left(sha256(session_id), 20) as case_id, cast(ordinal as integer) as ordinal, event_id from se where ordinal < 2""")
def q4_case_details(spark, sf_dir):
    s = v.sessions(spark, sf_dir)
    return cases.case_details(s.select(cases.case_id().alias("case_id")), s, sess.session_events(s), v.auth_events(spark, sf_dir), 2).select("case_id", "ordinal", "event_id")


@query(
    f"""{SESSION_EVENTS_SQL}, pairs as (select "user", host, min(end_time) as e from sessions group by all), ipu as (select src_ip, "user", min(end_time) as e from sessions group by all), hip as (select host, src_ip, min(end_time) as e from sessions group by all),
    auth as (select ev."user", ev.ts, s.end_time from se join ev using (event_id) join sessions s using (session_id) where ev.event_type like 'ssh\\_auth\\_%' escape '\\'),
    n as (select min(c) as least from (select count(*) as c from sessions group by "user")), w as (select s.session_id,
      (select count(*) from sessions h where h."user" = s."user" and h.end_time < s.start_time) as user_observations, (select count(*) from sessions h where h.src_ip = s.src_ip and h.end_time < s.start_time) as src_ip_observations,
      (select count(*) from sessions h where h.host = s.host and h.end_time < s.start_time) as host_observations,
      (select count(*) from pairs h where h."user" = s."user" and h.e < s.start_time) as distinct_hosts_for_user, (select count(*) from ipu h where h.src_ip = s.src_ip and h.e < s.start_time) as distinct_users_for_src_ip,
      (select count(*) from pairs h where h.host = s.host and h.e < s.start_time) as distinct_users_for_host, (select count(*) from hip h where h.host = s.host and h.e < s.start_time) as distinct_src_ips_for_host,
      (select count(*) from auth a where a."user" = s."user" and a.ts >= s.start_time - interval 24 hours and a.ts < s.start_time and a.end_time < s.start_time) as auth_frequency_window_count from sessions s)
    select *, user_observations = 0 as user_first_seen, src_ip_observations = 0 as src_ip_first_seen, host_observations = 0 as host_first_seen,
      'auth_frequency=no_artifact,host_access=no_artifact,login_hour_rarity=' || (select case when least >= 2 then 'ready' else 'warmup_incomplete' end from n) || ',src_ip_behavior=no_artifact,transition_surprise=no_artifact' as models from w"""
)
def q2_normality_context(spark, sf_dir):
    s = materialize(v.sessions(spark, sf_dir), "sessions")
    ready = models.readiness(_hours(spark, sf_dir).select(F.lit("login_hour_rarity").alias("model_id"), "entity"), models.registry(spark).where("parent is null"))
    found = cases.normality_context(s.select("session_id"), history.context(s, v.auth_events(spark, sf_dir)), ready)
    return found.withColumn("models", F.array_join(F.transform("models", lambda m: F.concat_ws("=", m["model_id"], m["reason"])), ","))


@query(
    f"""with {SESSIONS_SQL}, page as (select 'user' as entity_type, "user" as entity_id, session_id, row_number() over (partition by "user" order by start_time, session_id) as place from sessions where end_time < timestamp '2024-01-15')
    select entity_type, entity_id, session_id, cast(place as integer) as place from page where place <= 3"""
)
def q1_history_page(spark, sf_dir):
    s = v.sessions(spark, sf_dir)
    ent = s.select(F.lit("user").alias("entity_type"), F.col("user").alias("entity_id"), F.expr("timestamp_ntz '2024-01-15 00:00:00'").alias("before")).distinct()
    return cases.history_page(ent, s, 3).select("entity_type", "entity_id", "session_id", "place")


@query(
    f"""with {SESSIONS_SQL}, own as (select * from sessions where start_time < timestamp '2024-01-20'),
    n as (select m as model_id, 2 as warmup, "user" as entity, count(*) as n from own, (select unnest(['login_hour_rarity', 'auth_frequency', 'transition_surprise']) as m) group by all
      union all select 'src_ip_behavior', 250, src_ip, count(*) from own group by all union all select 'host_access', 250, host, count(*) from own group by all)
    select model_id, warmup, count(*) as entities, count(*) filter (where n >= warmup) as ready_entities, count(*) filter (where n >= warmup) = count(*) as ready,
      case when count(*) filter (where n >= warmup) < count(*) then 'warmup_incomplete' else 'ready' end as reason from n group by all"""
)
def m7_training(spark, sf_dir):
    from siftlog.plans.training import train

    s = materialize(v.sessions(spark, sf_dir), "sessions")
    splits = s.select("session_id", F.when(F.col("start_time") < F.expr("timestamp_ntz '2024-01-20 00:00:00'"), "reference").otherwise("evaluation").alias("split"))
    return train(spark, s, v.auth_events(spark, sf_dir), splits)["readiness"]


@query(
    f"""{HOURS_SQL}, n as (select entity, cast(substr(entity, 2) as bigint) % 12 as k, count(*) as n from obs group by 1)
    select case k when 1 then 'unheard_of' when 2 then 'login_hour_rarity_drift' else 'login_hour_rarity' end as model_id, case when k = 3 then '' else entity end as entity,
      unnest(case k when 1 then ['unknown_model'] when 2 then ['not_a_parent', 'parameters'] when 3 then ['entity'] when 4 then ['feature_schema'] when 5 then ['parameters'] when 6 then ['count', 'hash_count'] when 7 then ['entity_kind']
        when 8 then ['seed'] when 9 then ['repeated_hash'] when 10 then ['bad_hash'] when 11 then ['hash_count'] else [] end) as rule from n"""
)
def m11_incompatible(spark, sf_dir):
    """States with one fault of each kind, by the number of the user."""
    k = F.substring("entity", 2, 20).cast("bigint") % 12
    is_ = lambda n, wrong, right: F.when(k == n, wrong).otherwise(right)
    digests = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.sha2(F.concat("entity", F.lit(":"), i.cast("string")), 256))
    own = _hours(spark, sf_dir).groupBy("entity").agg(F.count("*").alias("n")).withColumn("hashes", digests)
    states = own.select(
        F.when(k == 1, "unheard_of").when(k == 2, "login_hour_rarity_drift").otherwise("login_hour_rarity").alias("model_id"), is_(3, "", F.col("entity")).alias("entity"), is_(7, "host", F.lit("user")).alias("entity_kind"),
        F.when(k == 6, F.lit(-1)).when(k == 11, F.col("n") + 1).when(k == 9, F.col("n") + 1).otherwise(F.col("n")).cast("bigint").alias("n"), is_(4, "0", F.lit("1")).alias("feature_schema"), is_(5, "alpha=2", F.lit("alpha=1")).alias("parameters"),
        is_(8, F.lit(7), F.lit(42)).alias("seed"),
        F.when(k == 9, F.array_append("hashes", F.element_at("hashes", 1))).when(k == 10, F.transform("hashes", lambda h: F.upper(F.concat(F.lit("a"), F.substring(h, 2, 63))))).otherwise(F.col("hashes")).alias("hashes"),
    )
    return models.incompatible(states, models.registry(spark))


@query(f"""{HOURS_SQL} select id, 'not_normal' as rule from obs where hour % 5 = 0 union all select id, 'not_training' from obs where hour % 7 = 0""")
def m6_ineligible(spark, sf_dir):
    obs = _hours(spark, sf_dir)
    return models.ineligible(obs.select("id", F.when(F.col("hour") % 5 == 0, "unknown").otherwise("normal").alias("label"), F.when(F.col("hour") % 7 == 0, "evaluation").otherwise("training").alias("split"), F.lit("declared").alias("reason"), F.sha2("id", 256).alias("sha256")))


# --- through files -------------------------------------------------------------------------------


def _place(spark) -> str:
    """A new folder in the shared one."""
    import uuid

    from siftlog.scratch import folder

    return f"{folder(spark)}/files-{uuid.uuid4().hex}"


def _log_files(spark, sf_dir, extra: str = "") -> str:
    """The raw lines as one file for each 2,000 of them, in a folder named by its number; returns the root."""
    lines = v.auth_lines(spark, sf_dir).withColumn("part", F.expr("line_no div 2000"))
    path = _place(spark)
    lines.repartition("part").sortWithinPartitions("part", "line_no").select("part", "raw_line").write.partitionBy("part").text(path)
    return path


PART = r"/part=([0-9]+)/"
PARTS_SQL = f"""with l as (select *, line_no // 2000 as part, row_number() over (partition by line_no // 2000 order by line_no) as n from ({LINES_SQL}))"""


@query(f"""{PARTS_SQL} select cast(part as bigint) as part, n as line_no, raw_line from l""")
def s1_raw_lines(spark, sf_dir):
    from siftlog.sources.files import read_lines

    lines = read_lines(spark, _log_files(spark, sf_dir))
    return lines.select(F.regexp_extract("source", PART, 1).cast("bigint").alias("part"), "line_no", "raw_line")


@query(f"""{PARTS_SQL} select cast(part as bigint) as part, count(*) as lines, count(*) filter (where line_no % 97 <> 0) as events, count(*) filter (where line_no % 97 = 0) as failures from l group by 1""")
def s2_loaded_logs(spark, sf_dir):
    from siftlog.sources.files import load_logs

    parsed = parse.parse_lines(load_logs(spark, _log_files(spark, sf_dir), 2024, "UTC"))
    return parsed.groupBy(F.regexp_extract("source", PART, 1).cast("bigint").alias("part")).agg(F.count("*").alias("lines"), F.count_if(F.col("reason").isNull()).alias("events"), F.count("reason").alias("failures"))


@query(f"""{PARTS_SQL} select cast(part as bigint) as part, count(*) as lines, cast(sum(strlen(raw_line) + 1) as bigint) as size, sha256(string_agg(raw_line || chr(10), '' order by line_no)) as sha256, 'metadata' as role from l group by 1""")
def p9_source_digests(spark, sf_dir):
    """Line counts and digests of whole files, and their roles (S3)."""
    from siftlog.sources.files import file_digests, role_of

    found = file_digests(spark, _log_files(spark, sf_dir))
    return found.select(F.regexp_extract("path", PART, 1).cast("bigint").alias("part"), "lines", "size", "sha256", role_of(F.regexp_extract("path", "(/part=.*)$", 1)).alias("role"))


@query("""select 'a' || doc_id || '.log' as source, doc_id as line_no, doc_id % 3 = 0 as attack, case when doc_id % 4 = 0 then 'fam' || (doc_id % 7) end as attack_family, case when doc_id % 5 = 0 then 'T1001,T1002' else '' end as technique_ids from documents""")
def s8_label_csv(spark, sf_dir):
    from siftlog.sources.files import read_labels_csv

    d = v.table(spark, sf_dir, "documents").selectExpr(
        "concat('x/y/a', doc_id, '.log') as source", "doc_id as line_no", "case doc_id % 6 when 0 then '1' when 3 then ' Yes' else 'no' end as attack",
        "if(doc_id % 4 = 0, concat('fam', doc_id % 7), null) as attack_family", "if(doc_id % 5 = 0, ' T1001, ,T1002', null) as technique_ids",
    )
    path = _place(spark)
    d.write.option("header", True).csv(path)
    return read_labels_csv(spark, path).withColumn("technique_ids", F.array_join("technique_ids", ","))


@query("""select doc_id + 1 as line_no, doc_id % 3 = 0 as attack, case when doc_id % 3 = 0 then 'escalate,fam' || (doc_id % 7) end as attack_family from documents""")
def s9_label_json(spark, sf_dir):
    from siftlog.sources.files import read_labels_json

    path = _place(spark)
    v.table(spark, sf_dir, "documents").selectExpr("doc_id + 1 as line", "if(doc_id % 3 = 0, array('escalate', concat('fam', doc_id % 7)), cast(array() as array<string>)) as labels").write.json(path)
    return read_labels_json(spark, path)


@query(
    """with d as (select doc_id, 'r/techniques/T1' || lpad(cast(doc_id % 30 as varchar), 3, '0') || '/run' || doc_id || case when doc_id % 2 = 0 then '/steps/s' || (doc_id % 4) else '/sequences/q' || (doc_id % 4) end || '/web' || (doc_id % 3) as folder from documents)
    select folder || '/auth.log' as path, 'T1' || lpad(cast(doc_id % 30 as varchar), 3, '0') as technique, case when doc_id % 2 = 0 then 's' || (doc_id % 4) end as step, case when doc_id % 2 = 1 then 'q' || (doc_id % 4) end as sequence,
      'web' || (doc_id % 3) as host, case when doc_id % 5 = 0 then 'syslog=' || folder || '/syslog' else '' end as related from d where doc_id % 7 <> 0"""
)
def s10_attack_runs(spark, sf_dir):
    from siftlog.sources.files import attack_runs

    folder = "concat('r/techniques/T1', lpad(doc_id % 30, 3, '0'), '/run', doc_id, if(doc_id % 2 = 0, concat('/steps/s', doc_id % 4), concat('/sequences/q', doc_id % 4)), '/web', doc_id % 3)"
    names = "filter(array(if(doc_id % 7 <> 0, 'auth.log', null), if(doc_id % 5 = 0, 'syslog', null)), x -> x is not null)"
    paths = v.table(spark, sf_dir, "documents").selectExpr(f"{folder} as folder", f"explode({names}) as name").select(F.concat_ws("/", "folder", "name").alias("path"))
    related = F.array_join(F.transform(F.map_entries("related"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return attack_runs(paths).withColumn("related", related)


@query("""select 'run' || doc_id as run, case when doc_id % 3 = 0 then 'Linux AUTH log' else 'auth' end as data_source from documents where doc_id % 3 <> 1""")
def s11_catalogue(spark, sf_dir):
    from siftlog.sources.files import auth_runs

    path = _place(spark)
    v.table(spark, sf_dir, "documents").selectExpr("concat('run', doc_id) as run", "case doc_id % 3 when 0 then 'Linux AUTH log' when 1 then 'netflow' else 'auth' end as data_source").write.option("header", True).csv(path)
    return auth_runs(spark.read.schema("run string, data_source string").option("header", True).csv(path))


@query(f"""with ev as ({EVENTS_SQL}) select event_id, line_no, ts as event_time, "user", success, cast(null as varchar) as ruser from ev""")
def s12_event_store(spark, sf_dir):
    from siftlog.schemas import EVENT_SCHEMA
    from siftlog.sources.files import read_events, write_events

    e = v.auth_events(spark, sf_dir).withColumn("timestamp", F.col("ts").cast("timestamp"))
    missing = [c for c in (x.split()[0] for x in EVENT_SCHEMA.split(", ")) if c not in e.columns]
    path = _place(spark)
    write_events(e.withColumns({c: F.lit(None).cast("string") for c in missing}), path)
    return read_events(spark, path).select("event_id", "line_no", F.col("timestamp").cast("timestamp_ntz").alias("event_time"), "user", "success", "ruser")


@query("""select 'blk_' || o_orderkey as block, 'E' || (o_orderkey % 5) || ',E' || (o_custkey % 5) as events, case when o_orderkey % 9 <> 0 then o_orderkey % 4 = 0 end as anomaly, o_orderkey % 9 = 0 as faulty from orders""")
def s15_traces(spark, sf_dir):
    """Labels and traces as CSV; blocks without a label are faults."""
    from siftlog.sources.files import bad_blocks, read_traces

    o = v.table(spark, sf_dir, "orders")
    labels, path = _place(spark), _place(spark)
    o.where("o_orderkey % 9 <> 0").selectExpr("concat('blk_', o_orderkey) as BlockId", "if(o_orderkey % 4 = 0, 'Anomaly', 'Normal') as Label").write.option("header", True).csv(labels)
    o.selectExpr("concat('blk_', o_orderkey) as BlockId", "'x' as Label", "1 as Type", "concat('[E', o_orderkey % 5, ', E', o_custkey % 5, ']') as Features", "'[]' as TimeInterval", "0 as Latency").write.option("header", True).csv(path)
    t = read_traces(spark, labels, path)
    return t.join(bad_blocks(t).select("block", F.lit(True).alias("bad")), "block", "left").select("block", F.array_join("events", ",").alias("events"), "anomaly", F.coalesce("bad", F.lit(False)).alias("faulty"))


STIX_SQL = """with a as (select p_partkey as k, 'T' || lpad(cast(p_partkey as varchar), 4, '0') as technique_id, p_name as name, p_type as description, p_partkey % 7 = 0 as revoked, p_partkey % 11 = 0 as deprecated,
    case p_partkey % 3 when 0 then ['Logon Session: Logon', 'File'] when 1 then ['File'] end as sources, case when p_partkey % 5 = 0 then 'tool' else 'attack-pattern' end as type from part where p_partkey < 10000),
    kept as (select * from a where type = 'attack-pattern' and not revoked and not deprecated and (k % 3 = 0 or technique_id in ('T0004', 'T0007', 'T0008')))"""


def _bundle(spark, sf_dir) -> DataFrame:
    """An attack bundle written as one JSON document per 500 objects and read again."""
    from siftlog.sources.files import read_stix

    o = v.table(spark, sf_dir, "part").where("p_partkey < 10000").selectExpr(
        "p_partkey div 500 as bundle",
        """struct(if(p_partkey % 5 = 0, 'tool', 'attack-pattern') as type, concat('id-', p_partkey) as id, p_name as name, p_type as description, p_partkey % 7 = 0 as revoked, p_partkey % 11 = 0 as x_mitre_deprecated,
        array(struct('other' as source_name, 'X' as external_id, 'u' as url), struct('mitre-attack' as source_name, concat('T', lpad(p_partkey, 4, '0')) as external_id, 'u' as url)) as external_references,
        array(struct('k' as kill_chain_name, 'persistence' as phase_name)) as kill_chain_phases, array('Linux') as x_mitre_platforms,
        case p_partkey % 3 when 0 then array('Logon Session: Logon', 'File') when 1 then array('File') end as x_mitre_data_sources) as object""",
    )
    path = _place(spark)
    o.groupBy("bundle").agg(F.to_json(F.struct(F.collect_list("object").alias("objects"))).alias("value")).select("value").repartition("value").write.option("maxRecordsPerFile", 1).text(path)
    return read_stix(spark, path)


@query(f"""{STIX_SQL} select 'id-' || k as id, type, name from a""")
def s16_bundle(spark, sf_dir):
    return _bundle(spark, sf_dir).select("id", "type", "name")


@query(f"""{STIX_SQL} select technique_id from kept""")
def k5_techniques(spark, sf_dir):
    return retrieval.filter_techniques(_bundle(spark, sf_dir), ["T0004", "T0007", "T0008"]).select("technique_id")


@query(
    f"""{STIX_SQL}, t as (select *, technique_id || ' ' || name || ' ' || description || ' persistence' || case when sources is null then '' else ' ' || array_to_string(sources, ' ') end as txt from kept)
    select 'attack-' || technique_id as document_id, name as title, 'persistence' as tactics, txt as indexed_text, sha256(txt) as sha256 from t"""
)
def k6_documents(spark, sf_dir):
    docs = retrieval.technique_documents(retrieval.filter_techniques(_bundle(spark, sf_dir), ["T0004", "T0007", "T0008"]))
    return docs.select("document_id", "title", F.array_join("tactics", ",").alias("tactics"), "indexed_text", "source.sha256")


@query("""select doc_id, lang, n_chars from documents""")
def s17_write_once(spark, sf_dir):
    """A result written once, named by its content, and read back; a second write is refused."""
    from pyspark.errors import AnalysisException

    from siftlog.sources.files import write_once

    d = v.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    root = _place(spark)
    path = write_once(d, root)
    try:
        write_once(d, root)
    except AnalysisException:
        return spark.read.schema(d.schema).parquet(path)
    raise AssertionError("a second write of the same result was not refused")


@query(f"""with {ITEMS_SQL} select item_id, case when eligible then 'reference' else 'excluded' end as split from items""")
def s19_sidecar(spark, sf_dir):
    from siftlog.sources.files import read_sidecar, write_sidecar

    path = _place(spark)
    write_sidecar(v.split_items(spark, sf_dir).select("item_id", F.when(F.col("eligible"), "reference").otherwise("excluded").alias("split")), path)
    return read_sidecar(spark, path, "item_id string, split string")


@query("""select 'd/' || doc_id as path, case when doc_id % 3 = 0 then 'fresh' else 'conflict' end as kind from documents where doc_id % 3 = 0 or doc_id % 5 = 0""")
def s5_import_conflicts(spark, sf_dir):
    from siftlog.sources.files import conflicts, fresh

    d = v.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"))
    old = d.where("doc_id % 3 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 5 == 0, "other").otherwise(F.col("sha256")))
    return fresh(old, d).select("path", F.lit("fresh").alias("kind")).unionByName(conflicts(old, d).select("path", F.lit("conflict").alias("kind")))


@query("""select cast(doc_id as varchar) as source, case doc_id % 4 when 0 then 2021 when 1 then 2022 end as default_year, case when doc_id % 4 < 2 then 'UTC' end as zone from documents""")
def s7_profiles(spark, sf_dir):
    """Profiles of sources from their metadata texts; sources of half the data sets have none."""
    from siftlog.sources.files import start_year, with_profile

    d = v.table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("name"), F.concat(F.lit("d"), (F.col("doc_id") % 4).cast("string")).alias("source"))
    texts = spark.createDataFrame([("d0", "x: 1\nstart: '2021-03-01'\n"), ("d1", "start: 2022-01-01")], "source string, text string")
    profiles = texts.select("source", start_year().alias("default_year"), F.lit("UTC").alias("zone"))
    return with_profile(d, profiles).select(F.col("name").alias("source"), "default_year", "zone")


RECORDS_SQL = """with o as (select *, row_number() over () as r from orders), t as (select o_orderkey as k, i, case (o_orderkey + i) % 3 when 0 then 'search' when 1 then 'history' else 'lookup' end as tool, (o_orderkey + i) % 10 = 0 or (o_orderkey + i) % 13 = 0 as broken,
      cast((o_orderkey * 7 + i * 31) % 1000 as double) as ms from orders, range(4) x(i) where i < o_orderkey % 4),
    runs as (select o_orderkey as k, case o_orderstatus when 'F' then 'completed' when 'O' then 'failed' else 'running' end as state, case o_orderkey % 4 when 0 then 'malicious' when 1 then 'benign' when 2 then 'suspicious' else 'insufficient_evidence' end as verdict,
      o_orderkey % 5 as why, o_orderkey % 3 <> 0 as grounded, o_orderkey % 7 = 0 as repaired, o_orderkey % 3 as findings, cast(floor(o_totalprice) as bigint) as tokens, cast(floor(o_totalprice) as double) / 100 as seconds from orders),
    done as (select * from runs where state = 'completed')
    select 'verdict' as measure, verdict as name, cast(count(*) as double) as value from done group by 2
    union all select 'incomplete', case why when 0 then 'budget' when 1 then 'provider_error' when 2 then 'grounding_refused' when 3 then 'cancelled' else 'other' end, count(*) from runs where state <> 'completed' group by 2
    union all select 'issue', case when i = 0 then 'uncited_handle' else 'excerpt_mismatch' end, count(*) from done, range(2) x(i) where not grounded and i <= k % 2 group by 2
    union all select 'tool', tool, count(*) from t group by 2
    union all select 'total', unnest(['cases_run', 'completed', 'abstained', 'reports_checked', 'grounded', 'repair_attempted', 'repair_succeeded', 'cited_handles', 'tool_calls', 'calls_per_run_max', 'unavailable_or_error', 'input_tokens', 'completion_rate', 'citation_validity', 'abstention_rate']),
      unnest([(select count(*) from runs), (select count(*) from done), (select count(*) from done where verdict = 'insufficient_evidence'), (select count(*) from done), (select count(*) from done where grounded), (select count(*) from done where repaired),
        (select count(*) from done where repaired and grounded), (select sum(findings * 2) from done), (select count(*) from t), 3, (select count(*) from t where broken), (select sum(tokens) from runs),
        round((select count(*) from done) / (select count(*) from runs), 6), round((select count(*) from done where grounded) / (select count(*) from done), 6), round((select count(*) from done where verdict = 'insufficient_evidence') / (select count(*) from runs), 6)]::double[])
    union all select 'tool_ms', 'p50', quantile_cont(ms, 0.5) from t union all select 'tool_ms', 'p95', quantile_disc(ms, 0.95) from t
    union all select 'run_seconds', 'p50', round(quantile_cont(seconds, 0.5), 6) from runs union all select 'run_seconds', 'p95', quantile_disc(seconds, 0.95) from runs
    union all select 'run_tokens', 'p50', quantile_cont(tokens, 0.5) from runs union all select 'run_tokens', 'p95', quantile_disc(tokens, 0.95) from runs"""


@query(RECORDS_SQL)
def e21_nested_records(spark, sf_dir):
    """Run records as nested JSON objects, written, read by their schema, and measured."""
    path = _place(spark)
    v.run_records(spark, sf_dir).write.json(path)
    found = evaluate.measure_records(spark.read.schema(evaluate.RUN_RECORD).json(path))
    shown = ("cases_run", "completed", "abstained", "reports_checked", "grounded", "repair_attempted", "repair_succeeded", "cited_handles", "tool_calls", "calls_per_run_max", "unavailable_or_error", "input_tokens", "completion_rate", "citation_validity", "abstention_rate")
    return found.where((F.col("measure") != "total") | F.col("name").isin(*shown)).select("measure", "name", r6("value"))
