"""Leakage-resistant splits, label joins, truths, selections and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftlog.functions.scalars import wilson
from siftlog.operators.graph import connected_components
from siftlog.operators.quantiles import quantiles
from siftlog.operators.running import prefix_by_chunk

# Failure kinds by a phrase of the reason, in order; run outcomes; verdict classes.
FAILURES = [("citation validation", "grounding_refused"), ("rate_limit budget", "rate_limit_allowance"), ("keys exhausted", "provider_keys_exhausted"), ("provider request failed", "provider_error"), ("budget exhausted", "budget"), ("cancel", "cancelled")]
POSITIVE, NEGATIVE = ("suspicious", "malicious"), ("benign",)


def campaign_id(path: str = "path") -> Column:
    """The part after ``sequences`` or ``steps``, or the second after ``techniques``, in that order."""
    parts = F.split(path, "/")
    after = lambda name, n: F.when(F.array_contains(parts, name), F.try_element_at(parts, (F.array_position(parts, name) + n).cast("int")))
    return F.coalesce(after("sequences", 1), after("steps", 1), after("techniques", 2))


def leakage_groups(items: DataFrame) -> DataFrame:
    """Eligible items that share a host, a content hash or a campaign, directly or not, get one group.

    Items and keys are the two sides of a graph, so a key that many items have costs one edge each.
    """
    own = items.where("eligible")
    keys = F.filter(F.array(F.concat(F.lit("h:"), "host"), F.concat(F.lit("c:"), "content_hash"), F.concat(F.lit("g:"), "campaign_id")), lambda x: x.isNotNull())
    edges = own.select(F.concat(F.lit("i:"), "item_id").alias("u"), F.explode(keys).alias("v"))
    found = connected_components(edges).where("node like 'i:%'").select(F.substring("node", 3, 1 << 30).alias("item_id"), "component")
    low = found.groupBy("component").agg(F.min("item_id").alias("group_id"))
    return own.select("item_id").join(found.join(low, "component").drop("component"), "item_id", "left").select("item_id", F.coalesce("group_id", "item_id").alias("group_id"))


def chronological_split(items: DataFrame, groups: DataFrame, reference: float = 0.6, validation: float = 0.2) -> DataFrame:
    """Groups in the order (first time, first item); the share before a group decides its split.

    Running sizes go over groups by day and then within the day.
    """
    sizes = items.join(groups, "item_id").groupBy("group_id").agg(F.min("timestamp").alias("first"), F.count("*").alias("n")).withColumn("day", F.to_date("first"))
    days = prefix_by_chunk(sizes.groupBy("day").agg(F.sum("n").alias("s")).withColumn("all", F.lit(1)), ["all"], "day", "s", "earlier")
    w = Window.partitionBy("day").orderBy("first", "group_id").rowsBetween(Window.unboundedPreceding, -1)
    total = F.broadcast(sizes.agg(F.sum("n").alias("total")))
    ranked = sizes.join(F.broadcast(days.select("day", "earlier")), "day").withColumn("before", F.col("earlier") + F.coalesce(F.sum("n").over(w), F.lit(0))).crossJoin(total)
    share = F.col("before") / F.col("total")
    named = ranked.withColumn("split", F.when(share < reference, "reference").when(share < reference + validation, "validation").otherwise("evaluation"))
    chosen = groups.join(named.select("group_id", "split"), "group_id")
    return items.select("item_id").join(chosen, "item_id", "left").select("item_id", "group_id", F.coalesce("split", F.lit("excluded")).alias("split"))


def manifest_digest(entries: DataFrame) -> DataFrame:
    """Digest of a split, independent of row order: from the sums of row digests, nothing is collected."""
    row = F.sha2(F.concat_ws("|", *entries.columns), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return entries.agg(F.count("*").alias("entries"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), *(part(i) for i in range(4))), 256).alias("digest"))


def source_hashes(items: DataFrame) -> DataFrame:
    """By path the greatest hash."""
    return items.groupBy("path").agg(F.max("content_hash").alias("content_hash"))


def repeated_items(entries: DataFrame) -> DataFrame:
    """E5: items that more than one entry assigns."""
    return entries.groupBy("item_id").agg(F.count("*").alias("n")).where("n > 1")


def hash_mismatches(entries: DataFrame, sessions: DataFrame, sources: DataFrame) -> DataFrame:
    """Entries whose session is unknown or whose source has another hash."""
    both = entries.join(sessions.select(F.col("session_id").alias("item_id"), "source"), "item_id", "left").join(sources.select("source", F.col("content_hash").alias("held")), "source", "left")
    return both.where(~F.col("held").eqNullSafe(F.col("content_hash"))).select("item_id", "source")


def label_faults(labels: DataFrame, events: DataFrame) -> DataFrame:
    """Labels that meet no event, or one of another source or line, and repeated labels."""
    held = events.select("event_id", F.col("source").alias("s"), F.col("line_no").alias("l"))
    both = labels.join(held, "event_id", "left")
    wrong = both.where(F.col("s").isNull() | (F.col("s") != F.col("source")) | (F.col("l") != F.col("line_no"))).select("event_id", F.lit("mismatch").alias("fault"))
    twice = labels.groupBy("event_id").agg(F.count("*").alias("n")).where("n > 1").select("event_id", F.lit("repeated").alias("fault"))
    return wrong.unionByName(twice)


def session_truths(session_events: DataFrame, labels: DataFrame) -> DataFrame:
    """Attack if any event is; normal if all are; unknown otherwise. An event without label is unknown."""
    both = session_events.join(labels.select("event_id", "truth"), "event_id", "left")
    per = both.groupBy("session_id").agg(F.bool_or(F.coalesce(F.col("truth") == "attack", F.lit(False))).alias("any"), F.bool_and(F.coalesce(F.col("truth") == "normal", F.lit(False))).alias("all"))
    return per.select("session_id", F.when(F.col("any"), "attack").when(F.col("all"), "normal").otherwise("unknown").alias("truth"))


def coverage(events: DataFrame, labels: DataFrame, unmatched: DataFrame, sessions: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row of counts."""
    known = labels.select("event_id").distinct().withColumn("l", F.lit(1))
    loose = unmatched.select("event_id").distinct().withColumn("u", F.lit(1))
    both = events.select("event_id").join(known, "event_id", "left").join(loose, "event_id", "left")
    counts = both.agg(F.count("*").alias("events"), F.count("l").alias("labelled_events"), F.count("u").alias("unmatched_events"), F.count_if(F.col("l").isNotNull() & F.col("u").isNotNull()).alias("labelled_unmatched_events"))
    return counts.crossJoin(sessions.agg(F.count("*").alias("sessions"))).crossJoin(candidates.agg(F.count_distinct("session_id").alias("candidate_sessions")))


def derive_labels(events: DataFrame, listed: DataFrame, rules: DataFrame) -> DataFrame:
    """By the dataset's rule: ``listed`` (listed line = attack, others normal) or ``capture`` (all attack)."""
    hits = listed.select("source", "line_no").distinct().withColumn("hit", F.lit(True))
    both = events.join(rules, "dataset_id").join(hits, ["source", "line_no"], "left")
    truth = F.when(F.col("rule") == "capture", "attack").when(F.col("rule") == "listed", F.when(F.col("hit"), "attack").otherwise("normal"))
    return both.select("event_id", "dataset_id", "source", "line_no", truth.alias("truth")).where("truth is not null")


def label_file(path: str = "path") -> Column:
    """The label file of a log: the single ``gather`` part replaced by ``labels``; null if not exactly one."""
    n = F.size(F.filter(F.split(path, "/"), lambda x: x == "gather"))
    return F.when(n == 1, F.regexp_replace(path, "(^|/)gather/", "$1labels/"))


def technique_sets(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """Sorted techniques of each source by the hash of its content; ``via`` says whether its own path has them."""
    sets = runs.groupBy("content_hash").agg(F.array_sort(F.collect_set("technique")).alias("techniques"))
    own = runs.select("path").distinct().withColumn("own", F.lit(True))
    out = sources.join(sets, "content_hash").join(own, "path", "left")
    return out.select("path", "techniques", F.when(F.col("own"), "path").otherwise("content_hash").alias("via"))


def label_summary(labels: DataFrame) -> DataFrame:
    """Labels by ``dataset:truth``."""
    return labels.groupBy(F.concat_ws(":", "dataset_id", "truth").alias("kind")).agg(F.count("*").alias("n"))


def normal_pool(events: DataFrame, labels: DataFrame, complete_sources: DataFrame, clean_hosts_only: bool = False) -> DataFrame:
    """Events labelled benign, or without label in a source that is declared complete."""
    known = labels.select("event_id", "attack")
    full = complete_sources.select("source").distinct().withColumn("full", F.lit(True))
    both = events.join(known, "event_id", "left").join(full, "source", "left")
    pool = both.where("attack = false or (attack is null and full)").drop("attack", "full")
    if clean_hosts_only:
        hit = events.join(known.where("attack"), "event_id").select("host").distinct()
        pool = pool.join(hit, "host", "left_anti")
    return pool


def stratified_cases(sessions: DataFrame, datasets: list[str], n: int, seed: str, indexed: DataFrame) -> DataFrame:
    """Of each dataset the first ``n`` sessions by SHA-256 of ``seed:id``, taken in turns.

    Sources of the reference index are left out. The position in ``datasets`` breaks ties of rank.
    """
    own = sessions.join(indexed.select("source").distinct(), "source", "left_anti").where(F.col("dataset_id").isin(datasets))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), "session_id"), 256)
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("dataset_id").orderBy(key))).where(F.col("rank") <= n)
    place = F.array_position(F.array(*map(F.lit, datasets)), F.col("dataset_id"))
    return ranked.select("session_id", "dataset_id", "rank", place.alias("place")).orderBy("rank", "place")


def confusion(rows: DataFrame) -> DataFrame:
    """Counts and rates of ``rows(truth, verdict)``; verdicts that decide nothing abstain."""
    known, plus, minus = F.col("truth").isin("attack", "normal"), F.col("verdict").isin(*POSITIVE), F.col("verdict").isin(*NEGATIVE)
    attack = F.col("truth") == "attack"
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    counts = rows.agg(
        n(known & attack & plus).alias("tp"), n(known & attack & minus).alias("fn"), n(known & ~attack & plus).alias("fp"), n(known & ~attack & minus).alias("tn"),
        n(known & ~F.coalesce(plus | minus, F.lit(False))).alias("abstained"), n(~F.coalesce(known, F.lit(False))).alias("unknown"),
    )
    rates = {"precision": "try_divide(tp, tp + fp)", "recall": "try_divide(tp, tp + fn)", "f1": "try_divide(2 * tp, 2 * tp + fp + fn)", "coverage": "try_divide(tp + fp + fn + tn, tp + fp + fn + tn + abstained)"}
    out = counts.withColumns({k: F.expr(v) for k, v in rates.items()})
    return out.withColumns({"precision_low": wilson("tp", "(tp + fp)", False), "precision_high": wilson("tp", "(tp + fp)", True), "recall_low": wilson("tp", "(tp + fn)", False), "recall_high": wilson("tp", "(tp + fn)", True)})


def latency(rows: DataFrame, column: str = "seconds") -> DataFrame:
    """Interpolated median and nearest-rank 95th percentile."""
    return quantiles(rows, column, {"p50_seconds": (0.5, "linear"), "p95_seconds": (0.95, "nearest")})


def false_alert_rate(alerts: str, hours: str) -> Column:
    """Alerts per hour; null without hours."""
    return F.when(F.col(hours) > 0, F.col(alerts) / F.col(hours))


def failure_kind(reason: str = "reason") -> Column:
    text = F.lower(F.coalesce(reason, F.lit("")))
    out = F.when(text.contains(FAILURES[0][0]), FAILURES[0][1])
    for phrase, kind in FAILURES[1:]:
        out = out.when(text.contains(phrase), kind)
    return out.otherwise("other")


def latest_runs(runs: DataFrame, *keys: str) -> DataFrame:
    """The latest run of each key by (started_at, run_id)."""
    w = Window.partitionBy(*keys).orderBy(F.desc("started_at"), F.desc("run_id"))
    return runs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def evaluate_runs(runs: DataFrame, truths: DataFrame, splits: DataFrame) -> DataFrame:
    """Confusion of the latest run of each session; a verdict counts only if the run is completed."""
    last = latest_runs(runs, "session_id")
    rows = splits.select(F.col("item_id").alias("session_id")).join(last, "session_id").join(truths, "session_id", "left")
    return confusion(rows.select(F.coalesce("truth", F.lit("unknown")).alias("truth"), F.when(F.col("state") == "completed", F.col("verdict")).alias("verdict")))


def leaks(index_sources: DataFrame, held_out: DataFrame) -> DataFrame:
    """Held-out sources that the reference index has; must be empty."""
    return index_sources.join(held_out, "source", "left_semi")


def measure_runs(runs: DataFrame) -> DataFrame:
    """``runs(run_id, state, reason, verdict, grounded, repaired, cited, calls, tokens_in, tokens_out, seconds)``."""
    done = F.coalesce((F.col("state") == "completed") & F.col("verdict").isNotNull(), F.lit(False))
    abstain = done & (F.col("verdict") == "insufficient_evidence")
    out = runs.agg(
        F.count("*").alias("cases_run"), F.count_if(done).alias("completed"), F.count_if(abstain).alias("abstained"), F.count("grounded").alias("reports_checked"),
        F.count_if("grounded").alias("grounded"), F.count_if("repaired").alias("repair_attempted"), F.count_if(F.col("repaired") & F.col("grounded")).alias("repair_succeeded"),
        F.sum("cited").alias("cited_handles"), F.sum("calls").alias("tool_calls"), F.avg("calls").alias("calls_per_run_mean"), F.max("calls").alias("calls_per_run_max"),
        F.sum("tokens_in").alias("input_tokens"), F.sum("tokens_out").alias("output_tokens"),
    )
    out = out.crossJoin(F.broadcast(latency(runs)))  # one row each
    rates = {"abstention_rate": "try_divide(abstained, cases_run)", "decisive_rate": "try_divide(completed - abstained, cases_run)", "completion_rate": "try_divide(completed, cases_run)", "citation_validity": "try_divide(grounded, reports_checked)"}
    return out.withColumns({k: F.expr(v) for k, v in rates.items()})


#: Nested records of agent runs, as they are stored: one JSON object per run.
RUN_RECORD = (
    "run_id string, state string, incomplete_reason string, "
    "report struct<verdict: string, findings: array<struct<evidence_handles: array<string>>>>, "
    "grounding struct<grounded: boolean, repair_attempted: boolean, issues: array<struct<kind: string>>>, "
    "traces array<struct<tool: string, available: boolean, error: string, duration_ms: double>>, hypotheses array<string>, "
    "usage struct<requests: bigint, provider_attempts: bigint, input_tokens: bigint, output_tokens: bigint, total_tokens: bigint, wall_seconds: double, rate_limited: bigint, rate_limit_wait_seconds: double>"
)


def measure_records(records: DataFrame) -> DataFrame:
    """Measures over nested run records (``RUN_RECORD``), long: ``measure, name, value``.

    Kinds are counted by one explosion of each run's own few marks (verdict, failure, issues, tools); totals
    and rates come from one aggregation, spreads of tool and run times and of tokens from exact quantiles. A
    rate without a denominator is null.
    """
    done = (F.col("state") == "completed") & F.col("report").isNotNull()
    traces = F.coalesce("traces", F.array().cast("array<struct<tool: string, available: boolean, error: string, duration_ms: double>>"))
    mark = lambda measure, name: F.struct(F.lit(measure).alias("measure"), name.alias("name"))
    none = F.array().cast("array<struct<measure: string, name: string>>")
    marks = F.concat(
        F.when(done, F.array(mark("verdict", F.col("report.verdict")))).otherwise(none),
        F.when(F.col("state") != "completed", F.array(mark("incomplete", failure_kind("incomplete_reason")))).otherwise(none),
        F.coalesce(F.transform("grounding.issues", lambda i: mark("issue", i["kind"])), none),
        F.transform(traces, lambda t: mark("tool", t["tool"])),
    )
    kinds = records.select(F.explode(marks).alias("m")).select("m.*").groupBy("measure", "name").agg(F.count("*").cast("double").alias("value"))
    n = lambda c: F.coalesce(c, F.lit(0))
    broken = F.size(F.filter(traces, lambda t: ~F.coalesce(t["available"], F.lit(False)) | t["error"].isNotNull()))
    cited = n(F.aggregate("report.findings", F.lit(0), lambda a, f: a + n(F.size(f["evidence_handles"]))))
    total = records.agg(
        F.count("*").alias("cases_run"), F.count_if(done).alias("completed"), F.count_if(done & (F.col("report.verdict") == "insufficient_evidence")).alias("abstained"),
        F.count("grounding").alias("reports_checked"), F.count_if("grounding.grounded").alias("grounded"), F.count_if("grounding.repair_attempted").alias("repair_attempted"),
        F.count_if(F.col("grounding.repair_attempted") & F.col("grounding.grounded")).alias("repair_succeeded"), F.sum(cited).alias("cited_handles"), F.sum(F.size(traces)).alias("tool_calls"),
        F.max(F.size(traces)).alias("calls_per_run_max"), F.sum(broken).alias("unavailable_or_error"), F.sum(n(F.size("hypotheses"))).alias("hypotheses"),
        *(F.sum(f"usage.{c}").alias(c) for c in ("requests", "provider_attempts", "input_tokens", "output_tokens", "total_tokens", "rate_limited", "rate_limit_wait_seconds")),
    )
    rates = {"abstention_rate": "try_divide(abstained, cases_run)", "decisive_rate": "try_divide(completed - abstained, cases_run)", "completion_rate": "try_divide(completed, cases_run)", "citation_validity": "try_divide(grounded, reports_checked)", "calls_per_run_mean": "try_divide(tool_calls, cases_run)"}
    total = total.withColumns({k: F.expr(v) for k, v in rates.items()})
    long = total.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in total.columns))).alias("t")).select(F.lit("total").alias("measure"), "t.*")
    spread = lambda rows, column, measure: _long(quantiles(rows, column, {"p50": (0.5, "linear"), "p95": (0.95, "nearest")}), measure)
    calls = records.select(F.explode(traces).alias("t")).select("t.duration_ms")
    out = kinds.unionByName(long).unionByName(spread(calls, "duration_ms", "tool_ms"))
    runs = records.select("usage.wall_seconds", "usage.total_tokens")
    return out.unionByName(spread(runs, "wall_seconds", "run_seconds")).unionByName(spread(runs, "total_tokens", "run_tokens"))


def _long(one: DataFrame, measure: str) -> DataFrame:
    """A single row of numbers as ``measure, name, value``."""
    cells = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in one.columns))
    return one.select(F.explode(cells).alias("c")).select(F.lit(measure).alias("measure"), "c.*")


def cost(input_tokens: str, output_tokens: str, price_in: float, price_out: float) -> Column:
    """List price per million tokens."""
    return F.round(F.col(input_tokens) * price_in / 1e6 + F.col(output_tokens) * price_out / 1e6, 6)


def incomplete_kinds(runs: DataFrame) -> DataFrame:
    """Runs that didn't complete by kind of failure."""
    return runs.where("state <> 'completed'").groupBy(failure_kind().alias("kind")).agg(F.count("*").alias("n"))


def technique(text: str) -> Column:
    """The first technique id in a text, null without one."""
    return F.nullif(F.regexp_extract(F.upper(F.trim(F.col(text))), r"T\d{4}(?:\.\d{3})?", 0), F.lit(""))


def technique_matches(cases: DataFrame) -> DataFrame:
    """``cases(case_id, reported, proposed array, truth array)`` with exact, parent, mismatch and so on."""
    ids = F.filter(F.transform("proposed", lambda x: F.regexp_extract(F.upper(F.trim(x)), r"T\d{4}(?:\.\d{3})?", 0)), lambda x: x != "")
    parents = lambda c: F.transform(c, lambda x: F.substring_index(x, ".", 1))
    match = F.when(~F.col("reported"), "no_report").when(F.size(ids) == 0, "none_proposed").when(F.arrays_overlap(ids, "truth"), "exact").when(F.arrays_overlap(parents(ids), parents(F.col("truth"))), "parent").otherwise("mismatch")
    return cases.select("case_id", match.alias("match"))


def confounds(cases: DataFrame) -> DataFrame:
    """Whether attack and normal cases come from disjoint datasets, and truth sets with several ids."""
    has = lambda t: F.coalesce(F.bool_or(F.col("truth") == t), F.lit(False))
    by_dataset = cases.groupBy("dataset_id").agg((has("attack") & has("normal")).alias("mixed"), F.count_if(F.size("techniques") > 1).alias("several"))
    return by_dataset.agg((~F.coalesce(F.bool_or(F.col("dataset_id").isNotNull() & F.col("mixed")), F.lit(False))).alias("truth_follows_dataset"), F.coalesce(F.sum("several"), F.lit(0)).alias("several_techniques"))
