"""Raw authentication log lines to typed events and parse failures.

Every line lands in exactly one output. The header is split by one pattern, the message family is the
first of an ordered table that matches, and fields come from that family's groups.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

# Header pattern, and message families in match order with their patterns and the field of
# each group. Groups are numbered, as Java names can't hold "_"; "-" is a group that no field takes.
HEADER = (
    r"^((?:[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?)|(?:\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[+-]\d{2}:?\d{2}|Z)?))"
    r"\s+(\S+)\s+([^\[:]+?)(?:\[(\d+)\])?:\s*(.*)$"
)
FAMILIES = [
    ("ssh_auth_success", r"^Accepted\s+(\S+)\s+for\s+(\S+)\s+from\s+(\S+)\s+port\s+(\d+)(?:\s+ssh2(?::\s+(.+))?)?$", "method user src_ip src_port key_fingerprint"),
    ("ssh_auth_failure_invalid_user", r"^Failed\s+(\S+)\s+for\s+invalid\s+user\s+(\S+)\s+from\s+(\S+)\s+(?:port\s+(\d+)\s+)?(?:ssh2)?$", "method user src_ip src_port"),
    ("ssh_auth_failure", r"^Failed\s+(\S+)\s+for\s+(\S+)\s+from\s+(\S+)\s+(?:port\s+(\d+)\s+)?(?:ssh2)?$", "method user src_ip src_port"),
    ("invalid_user", r"^Invalid\s+user\s+(\S+)\s+from\s+(\S+)(?:\s+port\s+(\d+))?\s*$", "user src_ip src_port"),
    ("connection_closed_by_user", r"^Connection\s+closed\s+by\s+authenticating\s+user\s+(\S+)\s+(\S+)\s+port\s+(\d+)(?:\s+\[preauth\])?$", "user src_ip src_port"),
    ("connection_closed_by_invalid_user", r"^Connection\s+closed\s+by\s+invalid\s+user\s+(\S+)\s+(\S+)\s+port\s+(\d+)(?:\s+\[preauth\])?$", "user src_ip src_port"),
    ("connection_closed_by_ip", r"^Connection\s+closed\s+by\s+(\S+)(?:\s+\[preauth\])?$", "src_ip"),
    ("disconnected_from_invalid_user", r"^Disconnected\s+from\s+invalid\s+user\s+(\S+)\s+(\S+)(?:\s+port\s+(\d+))?(?:\s+\[preauth\])?$", "user src_ip src_port"),
    ("disconnected_from_user", r"^Disconnected\s+from\s+user\s+(\S+)\s+(\S+)(?:\s+port\s+(\d+))?(?:\s+\[preauth\])?$", "user src_ip src_port"),
    ("disconnected", r"^Disconnected\s+from\s+authenticating\s+user\s+(\S+)\s+(\S+)(?:\s+port\s+(\d+))?(?:\s+\[preauth\])?$", "user src_ip src_port"),
    ("received_disconnect", r"^Received\s+disconnect\s+from\s+(\S+)(?::\s*(.*))?$", "src_ip -"),
    ("session_opened", r"^pam_unix\(([^:]+):session\):\s+session\s+opened\s+for\s+user\s+([^\s(]+)(?:\(uid=(\d+)\))?\s+by\s+\(uid=(\d+)\)$", "- user uid -"),
    ("session_closed", r"^pam_unix\(([^:]+):session\):\s+session\s+closed\s+for\s+user\s+(\S+)$", "- user"),
    ("sudo_session_opened", r"^pam_unix\(sudo(?:-l)?:session\):\s+session\s+opened\s+for\s+user\s+([^\s(]+)(?:\(uid=(\d+)\))?\s+by\s+([^\s(]+)(?:\(uid=(\d+)\))?$", "target_user - user uid"),
    ("sudo_command", r"^\s*(\S+)\s+:\s+(?:TTY=(\S+)\s+;\s+)?(?:PWD=(.*?)\s+;\s+)?(?:ENV=[^;]+\s+;\s+)?USER=(\S+)\s+;\s+COMMAND=(.*)$", "user tty pwd target_user command"),
    ("auth_failure", r"^pam_unix\(([^:]+):auth\):\s+authentication\s+failure;\s+(?=.*\brhost=(\S+))(?=.*\buser=(\S+)).*$", "- src_ip user"),
    ("auth_failure", r"^pam_unix\(([^:]+):auth\):\s+authentication\s+failure;\s+.*?(?:user=(\S+))?", "- user"),
    ("pam_check_pass_unknown", r"^pam_unix\(([^:]+):auth\):\s+check\s+pass;\s+user\s+unknown$", "-"),
    ("pam_more_failures", r"^PAM\s+\d+\s+more\s+authentication\s+failure(?:s)?;\s+.*?(?:user=(\S+))?", "user"),
    ("su_session_opened", r"^pam_unix\(su(?:-l)?:session\):\s+session\s+opened\s+for\s+user\s+(\S+)\s+by\s+(\S+)\(uid=(\d+)\)$", "target_user user uid"),
    ("su_success", r"^Successful\s+su\s+for\s+(\S+)\s+by\s+(\S+)$", "target_user user"),
    ("su_chfn", r"^\+\s+\S+\s+(\S+):(\S+)$", "user target_user"),
    ("systemd_session_new", r"^New\s+session\s+\d+\s+of\s+user\s+([^.\s]+)\.?$", "user"),
    ("systemd_session_removed", r"^Removed\s+session\s+\d+\.?$", ""),
    ("systemd_session_logged_out", r"^Session\s+\d+\s+logged\s+out\.?\s+Waiting\s+for\s+processes\s+to\s+exit\.?$", ""),
    ("identification_missing", r"^Did\s+not\s+receive\s+identification\s+string\s+from\s+(\S+)(?:\s+port\s+(\d+))?$", "src_ip src_port"),
    ("reverse_mapping_check", r"^reverse\s+mapping\s+checking\s+getaddrinfo\s+for\s+(\S+)\s+\[([^\]]+)\]\s+failed\s+-\s+POSSIBLE\s+BREAK-IN\s+ATTEMPT!$", "- src_ip"),
    ("input_userauth_request", r"^input_userauth_request:\s+invalid\s+user\s+(\S+)(?:\s+\[preauth\])?$", "user"),
    ("attempted_login", r"^Attempted\s+login\s+by\s+(\S+)(?:\s+\(UID:\s+(\d+)\))?(?:\s+on\s+(\S+))?$", "user uid tty"),
    ("too_many_auth_failures", r"^Disconnecting:\s+Too\s+many\s+authentication\s+failures\s+for\s+(\S+)(?:\s+\[preauth\])?$", "user"),
    ("drop_connection", r"^drop\s+connection\s+#\d+\s+from\s+\[([^\]]+)\]:\d+\s+on\s+\[([^\]]+)\]:\d+\s+past\s+MaxStartups$", "src_ip -"),
    ("server_listening", r"^Server\s+listening\s+on\s+(\S+)\s+port\s+(\d+)\.?$", "- src_port"),
    ("maxstartups_throttle", r"^(?:error:\s+)?(?:beginning|exited)\s+MaxStartups\s+throttling", ""),
    ("message_repeated", r"^(?:last\s+message\s+repeated\s+(\d+)\s+time(?:s)?|message\s+repeated\s+(\d+)\s+time(?:s)?:\s+\[.*\])$", "- -"),
    ("account_created", r"^new\s+user:\s+name=(\S+),\s+UID=(\d+),\s+GID=(\d+).*", "new_account uid -"),
    ("group_created", r"^new\s+group:\s+name=(\S+),\s+GID=(\d+).*", "added_group -"),
    ("group_member_added", r"^add\s+'(\S+)'\s+to\s+group\s+'(\S+)'$", "user added_group"),
    ("password_changed", r"^password\s+changed\s+for\s+(\S+)$", "user"),
    ("cron_session_opened", r"^pam_unix\(cron:session\):\s+session\s+opened\s+for\s+user\s+(\S+)$", "user"),
]
SUCCESS = ("ssh_auth_success", "session_opened", "sudo_command", "sudo_session_opened", "su_session_opened", "su_success", "su_chfn", "cron_session_opened", "systemd_session_new")
FAILURE = (
    "ssh_auth_failure", "ssh_auth_failure_invalid_user", "invalid_user", "connection_closed_by_user", "connection_closed_by_invalid_user", "connection_closed_by_ip", "disconnected",
    "disconnected_from_user", "disconnected_from_invalid_user", "received_disconnect", "auth_failure", "pam_check_pass_unknown", "pam_more_failures", "too_many_auth_failures",
    "reverse_mapping_check", "input_userauth_request", "attempted_login", "drop_connection", "maxstartups_throttle",
)
FIELDS = ("src_ip", "src_port", "user", "target_user", "method", "key_fingerprint", "command", "tty", "pwd", "uid", "new_account", "added_group")
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


def _alternatives() -> tuple[str, list[int], list[list[int]]]:
    """All families in one pattern, the group that marks each family, and the groups of its fields.

    Alternatives are tried in order, so the first family that matches wins, and only its own end is
    reached: there a group takes the last character, which marks it.
    """
    parts, marks, fields, at = [], [], [], 0
    for _, pattern, names in FAMILIES:
        size = re.compile(pattern).groups
        parts.append(rf"(?:{pattern}(?<=([\s\S])))")
        fields.append([at + 1 + i for i in range(size)])
        marks.append(at + size + 1)
        at += size + 1
    return "^(?:" + "|".join(parts) + r")[\s\S]*", marks, fields


ALL_FAMILIES, MARKS, GROUPS = _alternatives()


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``value`` as a generated column: it is computed once a row, wherever later columns and filters use it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _groups(df: DataFrame, out: str, text: str, pattern: str, groups: list[int]) -> DataFrame:
    """Add the groups of a pattern that matches a whole text, by one search; null where it doesn't, '' for a group that took no part.

    They are joined by a control character that the text doesn't hold and split again.
    """
    sign = F.lit(None).cast("string")
    for c in reversed("\x01\x02\x03\x04"):
        sign = F.when(~F.col(text).contains(c), F.lit(c)).otherwise(sign)
    df = _once(df, "_sign", sign)
    shown = F.concat(*(x for i in groups for x in (F.col("_sign"), F.lit(f"${i}"))))
    df = _once(df, "_joined", F.regexp_replace(F.col(text), F.lit("(?Ud)" + pattern), shown))
    return _once(df, out, F.when(F.col("_joined").startswith(F.col("_sign")), F.split("_joined", F.col("_sign")))).drop("_sign", "_joined")


def split_header(lines: DataFrame) -> DataFrame:
    """Stamp, host, process, pid and message; all null where the header doesn't match."""
    names = ("stamp", "host", "process", "pid", "message")
    out = _groups(lines, "_header", "raw_line", HEADER, [*range(1, 6)])
    out = out.withColumns({n: F.col("_header")[i] for i, n in enumerate(names, 1)}).drop("_header")
    return out.withColumn("pid", F.expr("try_cast(nullif(pid, '') as bigint)"))


def classify(lines: DataFrame) -> DataFrame:
    """Number and name of the first family that matches ``message``, and the outcome it implies.

    ``groups`` keeps what the one search for all families found, for ``extract_fields``.
    """
    out = _groups(lines, "groups", "message", ALL_FAMILIES, MARKS + [g for own in GROUPS for g in own])
    marks = F.transform(F.slice("groups", 2, len(MARKS)), lambda x: x != "")
    out = _once(out, "family", F.nullif(F.array_position(marks, F.lit(True)), F.lit(0)).cast("int") - 1)
    names = F.array(*(F.lit(n) for n, _, _ in FAMILIES))
    out = out.withColumn("event_type", F.try_element_at(names, F.col("family") + 1))
    return out.withColumn("success", F.when(F.col("event_type").isin(*SUCCESS), True).when(F.col("event_type").isin(*FAILURE), False))


def extract_fields(classified: DataFrame) -> DataFrame:
    """The fields of the line's own family; absent groups are null, ports and uids are numbers.

    ``ruser`` and ``session_hint`` belong to the record, but no family has a group for them.
    """
    first = [2 + len(MARKS) + sum(len(g) for g in GROUPS[:i]) for i in range(len(GROUPS))]
    columns = {}
    for field in FIELDS:
        places = [first[i] + names.split().index(field) if field in names.split() else None for i, (_, _, names) in enumerate(FAMILIES)]
        place = F.try_element_at(F.array(*(F.lit(p).cast("int") for p in places)), F.col("family") + 1)
        value = F.nullif(F.try_element_at("groups", place), F.lit(""))
        columns[field] = value.try_cast("bigint") if field in ("src_port", "uid") else value
    columns |= {c: F.lit(None).cast("string") for c in ("ruser", "session_hint")}
    return classified.withColumns(columns).drop("groups")


def _dated(lines: DataFrame) -> DataFrame:
    """Month of a stamp, and the year that a full date sets."""
    iso = F.coalesce(F.col("stamp").rlike("^[0-9]{4}-"), F.lit(False))
    named = F.expr(f"cast(nullif(instr('{MONTHS}', substring(stamp, 1, 3)), 0) + 2 as int) div 3").cast("int")
    out = lines.withColumns({"_iso": iso, "_month": F.when(F.col("stamp").isNotNull(), F.when(iso, F.substring("stamp", 6, 2).try_cast("int")).otherwise(named))})
    return out.withColumn("_full", F.when(iso, F.substring("stamp", 1, 4).try_cast("int")))


def _turns(dated: DataFrame, before: Column | None = None) -> DataFrame:
    """Inside a chunk: full dates so far (``_era``) and turns of the year since the last one (``_turn``)."""
    w = Window.partitionBy("source", "_chunk").orderBy("line_no")
    last = F.last("_month", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    over = ~F.col("_iso") & ((last if before is None else F.coalesce(last, before)) >= 11) & (F.col("_month") <= 2)
    out = dated.withColumns({"_over": F.coalesce(over, F.lit(False)).cast("int"), "_era": F.count("_full").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    era = Window.partitionBy("source", "_chunk", "_era").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumns({"_turn": F.sum("_over").over(era), "_base": F.max("_full").over(era)})


def with_years(lines: DataFrame, chunk: int = 100_000) -> DataFrame:
    """``year`` of each line of ``lines(source, line_no, stamp, default_year)`` in the order of the source.

    A month of 11 or more followed by one of 2 or less adds a year; a line with a full date sets the year
    and the month. The state follows all lines with a stamp, also those that fail later. A source of any
    length is a prefix scan over chunks of ``chunk`` line numbers: each chunk is folded to one row (first
    and last month, last full year, turns since), the few folds of a source are combined in order, and
    each chunk starts from the state that the folds before it leave.
    """
    dated = _dated(lines.withColumn("_chunk", F.floor(F.col("line_no") / chunk)))
    inner = _turns(dated.select("source", "line_no", "_chunk", "_iso", "_month", "_full", "default_year"))
    known = F.col("_month").isNotNull()
    at = lambda pick: pick(F.when(known, F.struct("line_no", "_month", "_iso")))
    folds = inner.groupBy("source", "_chunk").agg(
        F.max("source").alias("_source"), at(F.min).alias("f"), at(F.max).alias("l"), F.max(F.struct("_era", "_base")).alias("e"),
        F.max(F.struct("_era", "_turn")).alias("t"), F.min(F.struct("line_no", "default_year"))["default_year"].alias("_default"),
    )
    # In order of the chunks: the month before each, a turn at its start, and turns since the last full year.
    w = Window.partitionBy("_source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    folds = folds.withColumn("_before", F.last("l._month", True).over(w))
    start = F.coalesce(~F.col("f._iso") & (F.col("_before") >= 11) & (F.col("f._month") <= 2), F.lit(False)).cast("int")
    own = F.col("t._turn") + F.when(F.col("e._base").isNull(), start).otherwise(0)
    folds = folds.withColumns({"_own": own, "_eras": F.coalesce(F.count("e._base").over(w), F.lit(0)), "_year": F.last("e._base", True).over(w)})
    # A chunk with a full year starts a new sum, which counts for the chunks after it.
    after = Window.partitionBy("_source", F.col("_eras") + F.when(F.col("e._base").isNotNull(), 1).otherwise(0)).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    folds = folds.withColumn("_sum", F.sum("_own").over(after))
    ordered = Window.partitionBy("_source").orderBy("_chunk")
    folds = folds.select(
        F.col("_source").alias("source"), "_chunk", "_before",
        (F.coalesce(F.col("_year"), F.first("_default").over(ordered)) + F.coalesce(F.lag("_sum").over(ordered), F.lit(0))).alias("_enter"),
    )
    whole = _turns(dated.join(folds, ["source", "_chunk"]), F.col("_before"))
    year = F.coalesce("_base", "_enter", F.lit(None).cast("int")) + F.col("_turn")
    return whole.withColumn("year", year.cast("int")).drop("_chunk", "_iso", "_month", "_full", "_over", "_era", "_turn", "_base", "_before", "_enter")


def parse_timestamps(lines: DataFrame) -> DataFrame:
    """P5: ``timestamp`` in UTC, or null and ``time_fault``.

    ISO stamps with an offset are instants. Others are local times in ``zone``; one that the zone skips
    fails, and one it has twice needs ``dst_fold`` (0 earlier, 1 later). Without a year a stamp fails.
    """
    squeezed = F.regexp_replace("stamp", r"\s+", " ")
    iso = F.col("stamp").rlike("^[0-9]{4}-")
    offset = F.col("stamp").rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    bare = F.when(iso, F.regexp_replace(F.regexp_replace("stamp", r"(Z|[+-][0-9]{2}:?[0-9]{2})$", ""), "T", " ")).otherwise(
        F.concat_ws(" ", F.col("year").cast("string"), F.when(F.col("year").isNotNull(), squeezed))
    )
    text = F.when(iso, F.try_to_timestamp(bare, F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS][.S]"))).otherwise(F.try_to_timestamp(bare, F.lit("yyyy MMM d HH:mm:ss[.SSSSSS][.SSS][.S]")))
    sign = F.when(F.regexp_extract("stamp", r"([+-])[0-9]{2}:?[0-9]{2}$", 1) == "-", -1).otherwise(1)
    shift = F.coalesce(sign * (F.regexp_extract("stamp", r"[+-]([0-9]{2}):?[0-9]{2}$", 1).try_cast("int") * 60 + F.regexp_extract("stamp", r"[+-][0-9]{2}:?([0-9]{2})$", 1).try_cast("int")), F.lit(0))
    out = lines.withColumns({"_local": text, "_offset": iso & offset, "_shift": shift, "_zone": F.coalesce("zone", F.lit("UTC"))})
    first = F.expr("to_utc_timestamp(_local, _zone)")
    out = out.withColumn("_utc", F.when(F.col("_offset"), F.expr("_local - make_interval(0, 0, 0, 0, 0, _shift, 0)")).otherwise(first))
    same = lambda minutes: f"from_utc_timestamp(_utc + make_interval(0, 0, 0, 0, 0, {minutes}, 0), _zone) = _local"
    step = F.expr(f"case when {same(60)} then 60 when {same(30)} then 30 when {same(-60)} then -60 when {same(-30)} then -30 end")
    out = out.withColumns({"_step": F.when(~F.col("_offset"), step), "_skipped": ~F.col("_offset") & F.expr("from_utc_timestamp(_utc, _zone) <> _local")})
    early = F.expr("least(_utc, _utc + make_interval(0, 0, 0, 0, 0, _step, 0))")
    late = F.expr("greatest(_utc, _utc + make_interval(0, 0, 0, 0, 0, _step, 0))")
    fault = (
        F.when(~iso & F.col("year").isNull(), "Missing year").when(F.col("_local").isNull(), "Invalid timestamp")
        .when(F.col("_skipped"), "Nonexistent local timestamp").when(F.col("_step").isNotNull() & F.col("dst_fold").isNull(), "Ambiguous local timestamp")
    )
    value = F.when(F.col("_step").isNull(), F.col("_utc")).when(F.col("dst_fold") == 1, late).otherwise(early)
    out = out.withColumn("time_fault", F.when(F.col("stamp").isNotNull(), fault))
    return out.withColumn("timestamp", F.when(F.col("time_fault").isNull(), value)).drop("_local", "_offset", "_shift", "_zone", "_utc", "_step", "_skipped")


def parse_lines(lines: DataFrame) -> DataFrame:
    """P1 to P8 of ``lines(source, line_no, raw_line, default_year, zone, dst_fold)``.

    One row per line; ``reason`` is null for an event. Reasons in order: empty line, header, timestamp,
    message family. A failed line keeps its timestamp if the stamp itself is fine (P8).
    """
    parsed = extract_fields(classify(parse_timestamps(with_years(split_header(lines)))))
    reason = (
        F.when(F.trim(F.coalesce("raw_line", F.lit(""))) == "", "Empty line").when(F.col("stamp").isNull(), "Unrecognized header")
        .when(F.col("time_fault").isNotNull(), F.col("time_fault")).when(F.col("family").isNull(), "Unrecognized auth message family")
    )
    return parsed.withColumn("reason", reason).withColumn("event_id", F.concat_ws(":", "source", "line_no"))


def events_of(parsed: DataFrame) -> DataFrame:
    """The events, ordered by time and line within partitions."""
    return parsed.where("reason is null").withColumnRenamed("raw_line", "raw_message").drop("reason", "time_fault", "family", "stamp", "default_year", "zone", "dst_fold", "year").sortWithinPartitions("timestamp", "line_no")


def failures_of(parsed: DataFrame) -> DataFrame:
    """The other lines verbatim, with reason and salvaged timestamp."""
    return parsed.where("reason is not null").select("source", "line_no", "raw_line", "reason", "timestamp")
