"""Inputs of the log-evidence queries, derived from the given tables by expressions that DuckDB repeats.

``*_SQL`` constants hold the same derivation for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

GAP = 86400.0

EVENTS_SQL = """
  select 'events:' || (event_id + 1) as event_id, 'events' as source, event_id + 1 as line_no, ts,
    'h' || (cast(regexp_extract(props, '([0-9]+)', 1) as int) % 2) as host,
    case when event_id % 11 <> 0 then '10.0.0.' || (user_id % 20) end as src_ip,
    case when event_id % 13 <> 0 then 'u' || user_id end as "user",
    case event_type when 'view' then 'ssh_auth_success' when 'error' then 'ssh_auth_failure' when 'click' then 'sudo_command'
      when 'purchase' then 'session_opened' when 'signup' then 'account_created' end as event_type,
    case event_type when 'signup' then null when 'error' then false else true end as success,
    case when event_type in ('view', 'error') then case when event_id % 3 = 0 then 'publickey' else 'password' end end as method,
    case when event_type = 'view' and event_id % 3 = 0 then 'RSA SHA256:k' || (user_id % 7) end as key_fingerprint,
    case when event_type in ('view', 'error') then 1024 + event_id % 50000 end as src_port,
    event_type || ' ' || props as raw_message
  from events
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def auth_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed authentication events, one per row of ``events``."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    login = F.col("event_type").isin("view", "error")
    kinds = F.create_map(*[F.lit(x) for x in ("view", "ssh_auth_success", "error", "ssh_auth_failure", "click", "sudo_command", "purchase", "session_opened", "signup", "account_created")])
    return e.select(
        F.concat(F.lit("events:"), (F.col("event_id") + 1).cast("string")).alias("event_id"),
        F.lit("events").alias("source"),
        (F.col("event_id") + 1).alias("line_no"),
        "ts",
        F.concat(F.lit("h"), (k % 2).cast("string")).alias("host"),
        F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("10.0.0."), (F.col("user_id") % 20).cast("string"))).alias("src_ip"),
        F.when(F.col("event_id") % 13 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("user"),
        kinds[F.col("event_type")].alias("event_type"),
        F.when(F.col("event_type") != "signup", F.col("event_type") != "error").alias("success"),
        F.when(login, F.when(F.col("event_id") % 3 == 0, "publickey").otherwise("password")).alias("method"),
        F.when((F.col("event_type") == "view") & (F.col("event_id") % 3 == 0), F.concat(F.lit("RSA SHA256:k"), (F.col("user_id") % 7).cast("string"))).alias("key_fingerprint"),
        F.when(login, 1024 + F.col("event_id") % 50000).alias("src_port"),
        F.concat("event_type", F.lit(" "), "props").alias("raw_message"),
    )


SESSIONS_SQL = f"""
  ev as ({EVENTS_SQL}),
  matched as (select * from ev where "user" is not null and src_ip is not null),
  gapped as (select *, lag(ts) over (partition by source, host, src_ip, "user" order by ts, line_no) as previous from matched),
  numbered as (select *, sum(case when previous is null or (epoch_us(ts) - epoch_us(previous)) / 1e6 > {GAP} then 1 else 0 end)
    over (partition by source, host, src_ip, "user" order by ts, line_no) as session_no from gapped),
  grouped as (select source, host, src_ip, "user", session_no, min(ts) as start_time, max(ts) as end_time, count(*) as event_count,
      list(event_id order by ts, line_no) as events,
      arg_min(method, line_no) filter (where event_type = 'ssh_auth_success' and method is not null) as primary_method,
      arg_min(key_fingerprint, line_no) filter (where event_type = 'ssh_auth_success' and key_fingerprint is not null) as key_fingerprint,
      first(src_port order by ts, line_no) as src_port,
      bool_or(event_type in ('sudo_command', 'su_session_opened')) as has_escalation,
      bool_or(event_type in ('account_created', 'group_member_added', 'password_changed')) as has_persistence,
      count(*) filter (where success = false) as failure_count
    from numbered group by all),
  sessions as (select *, source || ':' || host || ':' || src_ip || ':' || "user" || ':' || strftime(start_time, '%Y-%m-%dT%H:%M:%S') ||
      case when epoch_us(start_time) % 1000000 <> 0 then '.' || strftime(start_time, '%f') else '' end || '+00:00' as session_id from grouped)
"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlog.operators.sessions import build_sessions

    return build_sessions(auth_events(spark, sf_dir), GAP)


LINES_SQL = f"""
  select source, line_no, ts,
    case when line_no % 97 = 0 then '!!! not a log line ' || line_no else
      strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00 ' || host || ' ' ||
      case event_type
        when 'ssh_auth_success' then 'sshd[' || line_no || ']: Accepted ' || method || ' for ' || coalesce("user", 'nobody') || ' from ' || coalesce(src_ip, '10.9.9.9') || ' port ' || src_port || ' ssh2'
        when 'ssh_auth_failure' then 'sshd[' || line_no || ']: Failed ' || method || ' for ' || coalesce("user", 'nobody') || ' from ' || coalesce(src_ip, '10.9.9.9') || ' port ' || src_port || ' ssh2'
        when 'sudo_command' then 'sudo: ' || coalesce("user", 'nobody') || ' : TTY=pts/1 ; PWD=/home ; USER=root ; COMMAND=/bin/ls ' || line_no
        when 'session_opened' then 'sshd[' || line_no || ']: pam_unix(sshd:session): session opened for user ' || coalesce("user", 'nobody') || '(uid=1000) by (uid=0)'
        else 'useradd[' || line_no || ']: new user: name=' || coalesce("user", 'nobody') || ', UID=' || line_no || ', GID=5, home=/x' end end as raw_line
  from ({EVENTS_SQL})
"""


def auth_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines that render the events; every 97th line is garbage."""
    e = auth_events(spark, sf_dir)
    user, ip, n = F.coalesce("user", F.lit("nobody")), F.coalesce("src_ip", F.lit("10.9.9.9")), F.col("line_no").cast("string")
    login = lambda word: F.concat(F.lit("sshd["), n, F.lit(f"]: {word} "), "method", F.lit(" for "), user, F.lit(" from "), ip, F.lit(" port "), F.col("src_port").cast("string"), F.lit(" ssh2"))
    message = (
        F.when(F.col("event_type") == "ssh_auth_success", login("Accepted")).when(F.col("event_type") == "ssh_auth_failure", login("Failed"))
        .when(F.col("event_type") == "sudo_command", F.concat(F.lit("sudo: "), user, F.lit(" : TTY=pts/1 ; PWD=/home ; USER=root ; COMMAND=/bin/ls "), n))
        .when(F.col("event_type") == "session_opened", F.concat(F.lit("sshd["), n, F.lit("]: pam_unix(sshd:session): session opened for user "), user, F.lit("(uid=1000) by (uid=0)")))
        .otherwise(F.concat(F.lit("useradd["), n, F.lit("]: new user: name="), user, F.lit(", UID="), n, F.lit(", GID=5, home=/x")))
    )
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00 "), "host", F.lit(" "))
    line = F.when(F.col("line_no") % 97 == 0, F.concat(F.lit("!!! not a log line "), n)).otherwise(F.concat(stamp, message))
    return e.select("source", "line_no", line.alias("raw_line"), F.lit(2024).alias("default_year"), F.lit("UTC").alias("zone"), F.lit(None).cast("int").alias("dst_fold"))


TRACES_SQL = """
  tl as (select l_orderkey, l_linenumber, row_number() over (order by l_orderkey // 50, l_shipdate, l_orderkey, l_linenumber) as line_no,
      'E' || (l_linenumber % 3) || case l_returnflag when 'A' then '1' when 'N' then '2' else '3' end as event from lineitem),
  bounds as (select 'blk_' || l_orderkey as block, min(line_no) as first_line, max(line_no) as last_line, list(event order by l_linenumber, event) as events, count(*) as length
    from tl group by l_orderkey),
  tr as (select b.*, o_orderpriority = '1-URGENT' as anomaly from bounds b join orders on b.block = 'blk_' || o_orderkey)
"""


def trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``block, line_no, event, place`` of line items in a global order, numbered by prefix sums of order ranges."""
    from siftlog.operators.running import prefix_by_chunk

    li = table(spark, sf_dir, "lineitem").withColumn("cell", F.expr("l_orderkey div 50"))
    counts = li.groupBy("cell").agg(F.count("*").alias("n")).withColumn("part", F.expr("cell div 1000"))
    parts = prefix_by_chunk(counts.groupBy("part").agg(F.sum("n").alias("s")).withColumn("all", F.lit(1)), ["all"], "part", "s", "base").select("part", "base")
    cells = prefix_by_chunk(counts, ["part"], "cell", "n", "inner").join(parts, "part").select("cell", (F.col("base") + F.col("inner")).alias("before"))
    w = Window.partitionBy("cell").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    flag = F.when(F.col("l_returnflag") == "A", "1").when(F.col("l_returnflag") == "N", "2").otherwise("3")
    event = F.concat(F.lit("E"), (F.col("l_linenumber") % 3).cast("string"), flag)
    return li.join(cells, "cell").select(F.concat(F.lit("blk_"), F.col("l_orderkey").cast("string")).alias("block"), (F.col("before") + F.row_number().over(w)).alias("line_no"), event.alias("event"), F.col("l_linenumber").alias("place"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = trace_lines(spark, sf_dir)
    per = lines.groupBy("block").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.transform(F.array_sort(F.collect_list(F.struct("place", "event"))), lambda x: x["event"]).alias("events"), F.count("*").alias("length"))
    labels = table(spark, sf_dir, "orders").select(F.concat(F.lit("blk_"), F.col("o_orderkey").cast("string")).alias("block"), (F.col("o_orderpriority") == "1-URGENT").alias("anomaly"))
    return per.join(labels, "block")


ITEMS_SQL = """
  items as (select cast(doc_id as varchar) as item_id, source || '/' || doc_id as path, timestamp '2024-01-01 00:00:00' + to_minutes(cast(d.doc_id as bigint)) as "timestamp",
      'd' || doc_id as host, sha256(text) as content_hash, left(text, 40) as campaign_id, coalesce(l.quality, 0) = 1 as eligible, source as dataset_id
    from documents d left join labels l using (doc_id))
"""


def split_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")  # noqa: E741
    return d.join(l, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("item_id"),
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
        F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(doc_id as int), 0)").alias("timestamp"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("host"),
        F.sha2("text", 256).alias("content_hash"),
        F.substring("text", 1, 40).alias("campaign_id"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("eligible"),
        F.col("source").alias("dataset_id"),
    )


RUNS_SQL = """
  runs as (select 'r' || o_orderkey as run_id, 's' || o_custkey as session_id, case o_orderstatus when 'F' then 'completed' when 'O' then 'failed' else 'running' end as state,
      cast(o_orderdate as timestamp) as started_at,
      case when o_orderstatus = 'F' then case o_orderkey % 4 when 0 then 'malicious' when 1 then 'benign' when 2 then 'suspicious' else 'insufficient_evidence' end end as verdict,
      case when o_orderstatus = 'O' then case o_orderkey % 5 when 0 then 'Turn budget exhausted' when 1 then 'provider request failed: 429' when 2 then 'citation validation refused' when 3 then 'cancelled by user' else 'unknown' end end as reason,
      case when o_orderstatus = 'F' then o_orderkey % 3 <> 0 end as grounded, case when o_orderstatus = 'F' then o_orderkey % 7 = 0 end as repaired,
      o_orderkey % 6 as cited, o_orderkey % 9 as calls, cast(floor(o_totalprice) as bigint) as tokens_in, cast(floor(o_totalprice / 10) as bigint) as tokens_out,
      cast(floor(o_totalprice) as double) / 100 as seconds, o_orderkey % 11 = 0 as interrupted, o_orderkey % 13 = 0 as grounding_failed
    from orders)
"""


def case_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.selectExpr(
        "concat('r', o_orderkey) as run_id", "concat('s', o_custkey) as session_id", "case o_orderstatus when 'F' then 'completed' when 'O' then 'failed' else 'running' end as state",
        "cast(o_orderdate as timestamp_ntz) as started_at",
        "case when o_orderstatus = 'F' then case o_orderkey % 4 when 0 then 'malicious' when 1 then 'benign' when 2 then 'suspicious' else 'insufficient_evidence' end end as verdict",
        "case when o_orderstatus = 'O' then case o_orderkey % 5 when 0 then 'Turn budget exhausted' when 1 then 'provider request failed: 429' when 2 then 'citation validation refused' when 3 then 'cancelled by user' else 'unknown' end end as reason",
        "case when o_orderstatus = 'F' then o_orderkey % 3 <> 0 end as grounded", "case when o_orderstatus = 'F' then o_orderkey % 7 = 0 end as repaired",
        "o_orderkey % 6 as cited", "o_orderkey % 9 as calls", "cast(floor(o_totalprice) as bigint) as tokens_in", "cast(floor(o_totalprice / 10) as bigint) as tokens_out",
        "cast(floor(o_totalprice) as double) / 100 as seconds", "o_orderkey % 11 = 0 as interrupted", "o_orderkey % 13 = 0 as grounding_failed",
    )


def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested run records, one per order."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('r', o_orderkey) as run_id", "case o_orderstatus when 'F' then 'completed' when 'O' then 'failed' else 'running' end as state",
        "case when o_orderstatus <> 'F' then case o_orderkey % 5 when 0 then 'Turn budget exhausted' when 1 then 'provider request failed: 429' when 2 then 'citation validation refused' when 3 then 'cancelled by user' else 'unknown' end end as incomplete_reason",
        """if(o_orderstatus = 'F', struct(case o_orderkey % 4 when 0 then 'malicious' when 1 then 'benign' when 2 then 'suspicious' else 'insufficient_evidence' end as verdict,
          transform(slice(array(1, 2, 3), 1, cast(o_orderkey % 3 as int)), i -> struct(array(concat('ev-', i), concat('ev-', i + 10)) as evidence_handles)) as findings), null) as report""",
        """if(o_orderstatus = 'F', struct(o_orderkey % 3 <> 0 as grounded, o_orderkey % 7 = 0 as repair_attempted,
          if(o_orderkey % 3 <> 0, cast(array() as array<struct<kind: string>>), slice(array(struct('uncited_handle' as kind), struct('excerpt_mismatch' as kind)), 1, cast(o_orderkey % 2 + 1 as int))) as issues), null) as grounding""",
        """transform(slice(array(0, 1, 2, 3), 1, cast(o_orderkey % 4 as int)), i -> struct(case (o_orderkey + i) % 3 when 0 then 'search' when 1 then 'history' else 'lookup' end as tool, (o_orderkey + i) % 10 <> 0 as available,
          if((o_orderkey + i) % 13 = 0, 'timeout', null) as error, cast((o_orderkey * 7 + i * 31) % 1000 as double) as duration_ms)) as traces""",
        "array('h') as hypotheses",
        """struct(o_orderkey % 9 as requests, o_orderkey % 9 as provider_attempts, cast(floor(o_totalprice) as bigint) as input_tokens, 0L as output_tokens, cast(floor(o_totalprice) as bigint) as total_tokens,
          cast(floor(o_totalprice) as double) / 100 as wall_seconds, 0L as rate_limited, 0D as rate_limit_wait_seconds) as usage""",
    )
