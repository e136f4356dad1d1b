"""Reversible tokens, keyed handles, pseudonyms, free-text redaction, outbound and citation checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftlog.functions.scalars import keyed_handle
from siftlog.operators.running import prefix_by_chunk
from siftlog.scratch import materialize

# Envelope marker, patterns of addresses and digests, keys that never leave, allowed fields.
MARKER, IPV4, HEX = r"(?i)</?untrusted-log-content>", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", r"(?i)\b[0-9a-f]{16,}\b"
FORBIDDEN = (
    "api_key", "attack", "attack_family", "authorization", "content_hash", "credential", "env", "environment", "ground_truth", "is_attack", "key_fingerprint",
    "label", "labels", "password", "raw_line", "raw_message", "secret", "source_path", "source_sha256", "token",
)
EVENT_FIELDS = ("timestamp", "process", "event_type", "success", "method", "message")
SESSION_FIELDS = ("start_time", "end_time", "event_count", "failure_count", "has_escalation", "has_persistence", "primary_method")
PSEUDONYM_FIELDS = ("host", "user", "target_user", "src_ip", "ruser")


def first_seen(rows: DataFrame, fields: list[str], order: str, scope: str | None = None) -> DataFrame:
    """``[scope,] field, value, first`` of every value of ``fields``."""
    keys = ([scope] if scope else []) + ["field", "value"]
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields)))
    long = rows.select(*([scope] if scope else []), F.col(order).alias("at"), pairs.alias("p")).select(*([scope] if scope else []), "at", "p.*")
    return long.where("value is not null").groupBy(*keys).agg(F.min("at").alias("first"))


def number_values(seen: DataFrame, start: int = 0, scope: str | None = None, width: int = 100_000) -> DataFrame:
    """Dense numbers by (first, value) within a field: ranges of ``first`` are ranked alone and shifted."""
    keys = ([scope] if scope else []) + ["field"]
    own = seen.withColumn("cell", F.floor(F.col("first") / width))
    sums = prefix_by_chunk(own.groupBy(*keys, "cell").agg(F.count("*").alias("n")), keys, "cell", "n", "before").drop("n")
    w = Window.partitionBy(*keys, "cell").orderBy("first", "value")
    return own.join(sums, [*keys, "cell"]).withColumn("n", F.col("before") + F.row_number().over(w) - 1 + start).drop("cell", "before")


def token_map(rows: DataFrame, fields: list[str], order: str) -> DataFrame:
    """``field, value, token`` with ``TOKEN_<field>_<n>``, n from 0 in first-seen order."""
    return number_values(first_seen(rows, fields, order)).select("field", "value", "n", F.concat(F.lit("TOKEN_"), "field", F.lit("_"), F.col("n").cast("string")).alias("token"))


def extend_map(known: DataFrame, rows: DataFrame, fields: list[str], order: str) -> DataFrame:
    """The map with new values numbered after the highest number of their field."""
    new = first_seen(rows, fields, order).join(known, ["field", "value"], "left_anti")
    top = known.groupBy("field").agg((F.max("n") + 1).alias("base"))
    numbered = number_values(new).join(F.broadcast(top), "field", "left").withColumn("n", F.col("n") + F.coalesce("base", F.lit(0)))
    return known.select("field", "value", "n", "token").unionByName(numbered.select("field", "value", "n", F.concat(F.lit("TOKEN_"), "field", F.lit("_"), F.col("n").cast("string")).alias("token")))


def apply_map(rows: DataFrame, tokens: DataFrame, fields: list[str], back: bool = False) -> DataFrame:
    """Values to tokens, or with ``back`` tokens to values; nulls stay."""
    a, b = ("token", "value") if back else ("value", "token")
    for f in fields:
        own = tokens.where(F.col("field") == f).select(F.col(a).alias(f), F.col(b).alias("_new"))
        rows = rows.join(own, f, "left").withColumn(f, F.coalesce("_new", f)).drop("_new")
    return rows


def pseudonyms(rows: DataFrame, fields: list[str], order: str, run: str) -> DataFrame:
    """``run, field, value, pseudonym`` with ``<field>-<n>`` from 1 in each run."""
    return number_values(first_seen(rows, fields, order, run), 1, run).select(run, "field", "value", F.concat("field", F.lit("-"), F.col("n").cast("string")).alias("pseudonym"))


def handles(rows: DataFrame, salt: bytes, kind: str, identifier: str) -> DataFrame:
    """A keyed, opaque handle of each identifier."""
    return rows.withColumn("handle", keyed_handle(salt, F.lit(kind), F.col(identifier)))


def redact_text(text: str, values: str | None = None, most: int = 400) -> Column:
    """Drop markers, replace known values (an array of structs, longest first), addresses and digests; cut."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), MARKER, "")
    if values:
        ordered = F.array_sort(values, lambda a, b: F.when(F.length(a["value"]) > F.length(b["value"]), -1).when(F.length(a["value"]) < F.length(b["value"]), 1).when(a["value"] < b["value"], -1).when(a["value"] > b["value"], 1).otherwise(0))
        out = F.aggregate(ordered, out, lambda acc, v: F.replace(acc, v["value"], v["token"]))
    out = F.regexp_replace(F.regexp_replace(out, IPV4, "[ip]"), HEX, "[digest]")
    return F.when(F.length(out) > most, F.concat(F.substring(out, 1, most), F.lit("...[truncated]"))).otherwise(out)


def outbound(rows: DataFrame, allowed: tuple[str, ...], salt: bytes, kind: str, identifier: str) -> DataFrame:
    """Only allowed fields and pseudonymised ones, with a handle in place of the identifier."""
    fields = [c for c in rows.columns if c in allowed or c in PSEUDONYM_FIELDS]
    return handles(rows, salt, kind, identifier).select("handle", *fields)


def forbidden_fields(df: DataFrame) -> list[str]:
    """Dotted names of fields of the schema, at any depth, that must not leave."""
    found: list[str] = []

    def walk(kind, path: str) -> None:
        if hasattr(kind, "fields"):
            for f in kind.fields:
                found.extend([f"{path}{f.name}"] if f.name.lower() in FORBIDDEN else [])
                walk(f.dataType, f"{path}{f.name}.")
        elif hasattr(kind, "elementType"):
            walk(kind.elementType, path)

    walk(df.schema, "")
    return found


def json_keys(text: str) -> Column:
    """The keys of all objects of a JSON text, at any depth, unescaped."""
    # Strings are read one after the other; those that no colon follows leave an empty group.
    strings = r'"(?:[^"\\]|\\.)*+"(?!\s*:)|"((?:[^"\\]|\\.)*+)"\s*:'
    raw = F.filter(F.regexp_extract_all(F.col(text), F.lit("(?s)" + strings), 1), lambda k: k != "")
    return F.transform(raw, lambda k: F.coalesce(F.from_json(F.concat(F.lit('["'), k, F.lit('"]')), "array<string>")[0], k))


def forbidden_keys(rows: DataFrame, identifier: str, texts: tuple[str, ...] = ()) -> DataFrame:
    """``identifier, key`` of forbidden keys in a row: fields and map keys at any depth, and keys inside the JSON ``texts``."""
    whole = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    shown = rows.select(F.col(identifier), F.explode(F.array(whole, *(F.col(t) for t in texts))).alias("text")).where("text is not null")
    keys = shown.select(identifier, F.explode(F.array_distinct(json_keys("text"))).alias("key"))
    return keys.where(F.lower("key").isin(*FORBIDDEN)).distinct()


def _grams(text: str, size: int) -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{{size}}}))"), 1)


def leaked(payloads: DataFrame, identifiers: DataFrame, run: str, size: int = 4) -> DataFrame:
    """``run, payload, identifier`` of real identifiers of a run that are contained in its payloads, inside words too.

    An identifier of up to ``size`` characters is itself a gram of every payload that holds it. A longer one
    is indexed by the gram of its own that is in fewest payloads of the run, so that payloads meet it by an
    equi-join on the gram, and only those that hold the gram are searched. Each payload and identifier
    comes once; null ones and empty identifiers never leak.
    """
    spark = payloads.sparkSession
    known = identifiers.where("identifier <> ''").select(run, "identifier").distinct()
    sizes = sorted(r[0] for r in known.select(F.least(F.length("identifier"), F.lit(size))).distinct().collect())  # at most ``size`` numbers
    if not sizes:
        return spark.createDataFrame([], payloads.select(run, "payload", F.col("payload").alias("identifier")).schema)
    own = materialize(payloads.where("payload is not null").select(run, "payload").distinct().withColumn("_id", F.monotonically_increasing_id()), "payloads")
    parts = known.select(run, "identifier", F.explode(F.array_distinct(F.when(F.length("identifier") <= size, F.array("identifier")).otherwise(_grams("identifier", size)))).alias("_gram"))
    marks = own.select(run, "_id", F.explode(F.array_distinct(F.concat(*(_grams("payload", n) for n in sizes)))).alias("_gram"))
    seen = materialize(marks.join(parts.select(run, "_gram").distinct(), [run, "_gram"], "left_semi"), "grams")
    held = seen.groupBy(run, "_gram").agg(F.count("*").alias("_n"))
    rarest = parts.join(held, [run, "_gram"], "left").groupBy(run, "identifier").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_a"))
    anchors = rarest.where("_a.n > 0").select(run, "identifier", F.col("_a.gram").alias("_gram"))
    pairs = seen.join(anchors, [run, "_gram"]).select("_id", "identifier")
    return own.join(pairs, "_id").where(F.col("payload").contains(F.col("identifier"))).select(run, "payload", "identifier")


def check_citations(citations: DataFrame, retrieved: DataFrame, resolved: DataFrame, events: DataFrame) -> DataFrame:
    """``run_id, handle, issue`` of cited handles of ``citations(run_id, handle, excerpt)``; null if sound.

    In order: not retrieved in the run, without an identifier, no stored event, excerpt not in its line.
    """
    seen = retrieved.select("run_id", "handle").distinct().withColumn("seen", F.lit(True))
    held = events.select(F.col("event_id").alias("identifier"), "raw_message")
    both = citations.join(seen, ["run_id", "handle"], "left").join(resolved, ["run_id", "handle"], "left").join(held, "identifier", "left")
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    event = F.col("handle").startswith("ev-")
    issue = (
        F.when(F.col("seen").isNull(), "uncited_handle").when(F.col("identifier").isNull(), "unresolvable_handle")
        .when(event & F.col("raw_message").isNull(), "missing_evidence").when(event & ~flat("raw_message").contains(flat("excerpt")), "excerpt_mismatch")
    )
    return both.select("run_id", "handle", issue.alias("issue"))


def grounded(checked: DataFrame) -> DataFrame:
    """By run the checked handles, the issues, and whether there are none."""
    return checked.groupBy("run_id").agg(F.count("*").alias("checked"), F.count("issue").alias("issues")).withColumn("grounded", F.col("issues") == 0)


def resolve_citations(citations: DataFrame, resolved: DataFrame, session_events: DataFrame, events: DataFrame, lines: int) -> DataFrame:
    """The stored lines of cited events and sessions, at most ``lines`` of a session."""
    own = citations.join(resolved, ["run_id", "handle"], "left")
    single = own.where("handle like 'ev-%'").select("run_id", "handle", F.col("identifier").alias("event_id"), F.lit(0).alias("ordinal"))
    many = own.where("handle like 'se-%'").join(session_events, F.col("identifier") == F.col("session_id")).where(F.col("ordinal") < lines).select("run_id", "handle", "event_id", "ordinal")
    found = single.unionByName(many).join(events.select("event_id", "raw_message"), "event_id", "left")
    return found.select("run_id", "handle", "ordinal", "event_id", "raw_message", F.when(F.col("raw_message").isNull(), "not_found").alias("failure"))


def mentioned(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Pseudonyms that a run's texts mention, with their values."""
    pattern = r"\b((?:" + "|".join(PSEUDONYM_FIELDS) + r")-\d+)\b"
    found = texts.select("run_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), 1))).alias("pseudonym")).distinct()
    return found.join(names, ["run_id", "pseudonym"], "left")
