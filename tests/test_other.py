import collections
import hashlib
import hmac
import math
import random
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from siftlog.functions.scalars import keyed_handle
from siftlog.operators import evaluate, redact, retrieval, traces as tr
from siftlog.operators.graph import connected_components
from siftlog.sources import files


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    r = random.Random(seed)
    n = 60
    edges = [(r.randint(0, n), r.randint(0, n)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(200, 200 + i) for i in range(1, 30)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges + [(None, 3)], "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_handle_is_hmac(spark):
    got = spark.range(1).select(keyed_handle(b"salt", F.lit("ev"), F.lit("a:1")).alias("h")).first()["h"]
    assert got == "ev-" + hmac.new(b"salt", b"ev\0a:1", hashlib.sha256).hexdigest()[:10]


def test_split(spark):
    schema = "item_id string, timestamp timestamp, host string, content_hash string, campaign_id string, eligible boolean"
    rows = [(f"i{k}", f"2026-01-{k + 1:02} 00:00:00", f"h{k}", f"c{k}", None, True) for k in range(10)]
    rows[7] = ("i7", "2026-01-08 00:00:00", "h0", "c7", None, True)
    rows.append(("x", "2026-01-01 00:00:00", "h9", "c9", None, False))
    items = spark.createDataFrame(rows, schema.replace("timestamp timestamp", "timestamp string")).withColumn("timestamp", F.to_timestamp("timestamp"))
    got = {r["item_id"]: (r["group_id"], r["split"]) for r in evaluate.chronological_split(items, evaluate.leakage_groups(items)).collect()}
    assert got["i7"] == ("i0", "reference") == got["i0"] and got["x"] == (None, "excluded")
    assert [got[f"i{k}"][1] for k in (1, 4, 5, 6, 8, 9)] == ["reference", "reference", "validation", "validation", "evaluation", "evaluation"] or got["i9"][1] == "evaluation"


def test_campaign(spark):
    paths = ["a/sequences/s1/x", "a/steps/t2/x", "a/techniques/T1/run3/x", "a/b"]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "path string").select(evaluate.campaign_id()).collect()]
    assert got == ["s1", "t2", "run3", None]


def test_confusion(spark):
    rows = [("attack", "malicious"), ("attack", "benign"), ("normal", "suspicious"), ("normal", "benign"), ("attack", "insufficient_evidence"), ("unknown", "benign")]
    c = evaluate.confusion(spark.createDataFrame(rows, "truth string, verdict string")).first()
    assert (c["tp"], c["fn"], c["fp"], c["tn"], c["abstained"], c["unknown"], c["coverage"]) == (1, 1, 1, 1, 1, 1, 0.8)
    empty = evaluate.confusion(spark.createDataFrame([], "truth string, verdict string")).first()
    assert empty["precision"] is None and empty["recall_low"] is None


def test_latency(spark):
    got = evaluate.latency(spark.createDataFrame([(float(i),) for i in range(1, 6)], "seconds double")).first()
    assert (got["p50_seconds"], got["p95_seconds"]) == (3.0, 5.0)


def test_truths(spark):
    se = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "3"), ("b", "2"), ("b", "3"), ("c", "2")], "session_id string, event_id string")
    labels = spark.createDataFrame([("1", "attack"), ("2", "normal")], "event_id string, truth string")
    assert {r[0]: r[1] for r in evaluate.session_truths(se, labels).collect()} == {"a": "attack", "b": "unknown", "c": "normal"}


def test_traces_fixture(spark):
    """Twelve blocks in order, the eleventh anomalous: splits 7/2/3, one hit, no false alert."""
    rows = [(f"blk_{i}", i + 1, i + 1, ["E9", "E9"] if i == 10 else ["E1", "E2"], 2, i == 10) for i in range(12)]
    t = spark.createDataFrame(rows, "block string, first_line bigint, last_line bigint, events array<string>, length bigint, anomaly boolean")
    split = tr.split_by_bounds(t, *tr.boundary_lines(t))
    assert {r[0]: r[1] for r in split.groupBy("split").count().collect()} == {"train": 7, "validation": 2, "evaluation": 3}
    scores = split.join(tr.surprise(split, tr.fit_baseline(split.where("split = 'train' and not anomaly"))), "block").withColumn("score", F.col("mean"))
    threshold = tr.normal_threshold(scores.where("split = 'validation'"), 0.95)
    c = tr.confusion(scores.where("split = 'evaluation'").withColumn("alert", F.col("score") > threshold)).first()
    assert (c["tp"], c["fn"], c["fp"], c["tn"], c["f1"]) == (1, 0, 0, 2, 1.0)


def test_bounds_split(spark):
    t = spark.createDataFrame([("a", 1, 30), ("b", 10, 25), ("c", 20, 21)], "block string, first_line bigint, last_line bigint")
    assert [r["split"] for r in tr.split_by_bounds(t, 10, 20).orderBy("block").collect()] == ["cross", "cross", "evaluation"]


def test_bm25_ties_by_id(spark):
    docs = spark.createDataFrame([("b", "brute force login"), ("a", "brute force login"), ("c", "nothing here")], "document_id string, text string")
    queries = spark.createDataFrame([(1, "the brute force")], "query_id int, text string")
    assert [r["document_id"] for r in retrieval.bm25(queries, docs, 5).orderBy("rank").collect()] == ["a", "b"]


def _plain_bm25(queries, docs, k):
    """Every document scored in full."""
    words = {d: [w for w in re.findall(r"[a-z0-9][a-z0-9_.\-]*", (x or "").lower()) if len(w) > 1 and w not in retrieval.STOP] for d, x in docs.items()}
    mean = sum(map(len, words.values())) / len(words)
    df = collections.Counter(t for w in words.values() for t in set(w))
    out = {}
    for q, text in queries.items():
        asked, scores = set(text.lower().split()), {}
        for d, w in words.items():
            shares = [round(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / mean)), 6) for t in asked & set(w)]
            if shares:
                scores[d] = round(sum(shares), 6)
        out[q] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def test_bm25_equals_scoring_every_document(spark):
    """Frequent and rare terms, texts of all lengths, repeated texts, a query with fewer than k documents, empty and strange rows."""
    r = random.Random(11)
    word = lambda: f"w{int(r.paretovariate(0.6)) % 400}"
    docs = {i: " ".join(word() for _ in range(r.choice([3, 20, 60, 200]))) for i in range(400)} | {400: "", 401: "rare w1 w2"}
    docs |= {500 + i: docs[7] for i in range(15)}
    queries = {q: " ".join(word() for _ in range(r.choice([1, 4, 25]))) for q in range(40)} | {98: "rare", 99: docs[7]}
    d = spark.createDataFrame([*docs.items()], "document_id int, text string").withColumn("share", F.lit(1))
    asked = spark.createDataFrame([*queries.items(), (100, None), (101, ""), (None, "w1"), (0, queries[0])], "query_id int, text string").withColumn("document_id", F.lit(1))
    got = collections.defaultdict(list)
    for x in retrieval.bm25(asked, d, 10).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["document_id"], x["score"]))
        assert abs(sum(t["share"] for t in x["terms"]) - x["score"]) < 1e-6
    assert got == {q: rows for q, rows in _plain_bm25(queries, docs, 10).items() if rows}
    assert retrieval.bm25(asked.limit(0), d, 3).count() == 0 and retrieval.bm25(asked, d.limit(0), 3).count() == 0


def test_levels_that_cannot_reach_the_floor_are_skipped(spark):
    lists = spark.createDataFrame([("q", "common", 1, 900, 0.5), ("q", "common", 2, 90, 1.0), ("q", "rare", 1, 3, 4.0), ("q", "rare", 2, 2, 5.0), ("new", "common", 1, 900, 0.5)], "query_id string, term string, level int, n bigint, bound double")
    floors = spark.createDataFrame([("q", 4.5)], "query_id string, floor double")
    got = {(x["query_id"], x["term"], x["level"]): (x["cut"], x["spare"]) for x in retrieval.essential_levels(lists, floors).collect()}
    assert got == {("q", "rare", 1): (0.0, 1.0), ("q", "rare", 2): (0.0, 1.0), ("new", "common", 1): (0.0, 0.0)}


def test_tokens(spark):
    rows = spark.createDataFrame([(1, "u1", "h"), (2, "u2", None), (3, "u1", "h")], "n bigint, user string, host string")
    tokens = redact.token_map(rows, ["user", "host"], "n")
    hidden = redact.apply_map(rows, tokens, ["user", "host"])
    assert [tuple(r) for r in hidden.orderBy("n").select("user", "host").collect()] == [("TOKEN_user_0", "TOKEN_host_0"), ("TOKEN_user_1", None), ("TOKEN_user_0", "TOKEN_host_0")]
    more = redact.extend_map(tokens, spark.createDataFrame([(9, "u0", "h")], rows.schema), ["user", "host"], "n")
    assert {r["value"]: r["token"] for r in more.collect()}["u0"] == "TOKEN_user_2"


def test_redaction(spark):
    df = spark.createDataFrame([("<untrusted-log-content>ann at 10.0.0.1 and anna, 0123456789abcdef0", [("ann", "user-1"), ("anna", "user-2")])], "text string, v array<struct<value string, token string>>")
    assert df.select(redact.redact_text("text", "v")).first()[0] == "user-1 at [ip] and user-2, [digest]"


def test_leaks_inside_words(spark):
    """Identifiers count wherever they are contained, and only in their own run."""
    held = ["user=jdoe", "jdoe@web01", "10.0.0.3:22", "/home/jdoe/x", "jdoe-laptop", '{"host":"web01"}', "seen John Doe here", "é漢z!", "nothing", None, ""]
    payloads = spark.createDataFrame([(r, p) for r in ("a", "b") for p in held] + [("a", "user=jdoe")], "run string, payload string")
    names = ["jdoe", "web01", "10.0.0.3", "John Doe", "漢", "z!", "absent", "", None, "jdoe"]
    ids = spark.createDataFrame([("a", n) for n in names] + [("b", "nothin"), (None, "jdoe")], "run string, identifier string")
    got = sorted(map(tuple, redact.leaked(payloads, ids, "run").collect()))
    want = sorted({("a", p, n) for p in held if p for n in names if n and n in p} | {("b", "nothing", "nothin")})
    assert got == want and len(want) == 11
    assert redact.leaked(payloads, ids.limit(0), "run").count() == 0 and redact.leaked(payloads.limit(0), ids, "run").count() == 0


def test_forbidden_keys_at_any_depth(spark):
    rows = [(1, '{"x": [{"Secret": {}}], "y": "token"}', {"a": "b"}), (2, '{"t": "a \\"label\\": b"}', {"LABELS": "b"}), (3, "no json", {}), (4, None, None)]
    df = spark.createDataFrame(rows, "id int, body string, m map<string,string>")
    assert sorted(map(tuple, redact.forbidden_keys(df, "id", ("body",)).collect())) == [(1, "Secret"), (2, "LABELS")]


def test_forbidden_fields(spark):
    df = spark.createDataFrame([], "a string, b struct<label string, c array<struct<api_key string>>>")
    assert redact.forbidden_fields(df) == ["b.label", "b.c.api_key"]


def test_line_numbers(spark, tmp_path):
    for name, n in (("a.log", 500), ("b.log", 3)):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = files.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 503 and all(r["raw_line"] == f"{r['source'].rsplit('/', 1)[1]} {r['line_no']}" for r in rows)


def test_labels(spark, tmp_path):
    (tmp_path / "l.csv").write_text("source,line_no,attack,attack_family,technique_ids\nx/auth.log,2,1,brute_force,\"T1110, T1078\"\nauth.log,3,no,,\n")
    got = [tuple(r) for r in files.read_labels_csv(spark, str(tmp_path / "l.csv")).orderBy("line_no").collect()]
    assert got == [("auth.log", 2, True, "brute_force", ["T1110", "T1078"]), ("auth.log", 3, False, None, [])]
    (tmp_path / "m.csv").write_text("attack,line_no,source\nYES,7,x/auth.log\n")
    assert [tuple(r) for r in files.read_labels_csv(spark, str(tmp_path / "m.csv")).collect()] == [("auth.log", 7, True, None, [])]
    (tmp_path / "n.csv").write_text("line_no,attack_family\n7,x\n")
    with pytest.raises(ValueError, match="source, attack"):
        files.read_labels_csv(spark, str(tmp_path / "n.csv"))
    (tmp_path / "l.json").write_text('{"line":3,"labels":["attacker_change_user"],"rules":{}}\n{"line":3,"labels":[]}\n')
    labels = files.read_labels_json(spark, str(tmp_path / "l.json"))
    assert labels.where("attack").first()["attack_family"] == "attacker_change_user"
    assert [r["line_no"] for r in files.bad_labels(labels).collect()] == [3]


def test_write_once(spark, tmp_path):
    df = spark.range(3)
    files.write_once(df, str(tmp_path))
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        files.write_once(df, str(tmp_path))


def test_events_parquet_round_trip(spark, tmp_path):
    from siftlog.schemas import EVENT_SCHEMA

    files.write_events(spark.createDataFrame([], EVENT_SCHEMA), str(tmp_path / "e"))
    assert files.read_events(spark, str(tmp_path / "e")).count() == 0


def test_attack_runs(spark):
    paths = ["d/techniques/T1110/steps/s1/web/auth.log", "d/techniques/T1110/steps/s1/web/syslog.log"]
    r = files.attack_runs(spark.createDataFrame([(p,) for p in paths], "path string")).first()
    assert (r["technique"], r["step"], r["host"], r["related"]) == ("T1110", "s1", "web", {"syslog.log": paths[1]})


def test_parse_failures_of_lines_with_both_faults(spark):
    """Line 8633 is the first that is garbage and gets the unknown message; the smallest tables don't reach it."""
    import duckdb

    from siftlog.plans.reports import ORACLES, QUERIES

    c = duckdb.connect()
    c.sql("create view events as select * from '/root/testdata/sf0.01/events.parquet' where event_id between 8600 and 8700")
    d = spark.read.parquet("/root/testdata/sf0.01/events.parquet").where("event_id between 8600 and 8700")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    d.write.mode("overwrite").parquet(f"{folder}/events.parquet")
    columns = ["line_no", "raw_line", "reason", "salvaged_time"]
    got = sorted(tuple(map(str, r)) for r in QUERIES["p6_parse_failures"](spark, folder).select(columns).collect())
    want = sorted(tuple(map(str, r)) for r in c.sql(f"select {', '.join(columns)} from ({ORACLES['p6_parse_failures']})").fetchall())
    assert got == want and any(r[1].endswith("8633app: nothing known") for r in got)


def test_bm25_tasks_stay_bounded_as_texts_grow(spark, tmp_path, monkeypatch):
    """Partitions follow the size of the texts, and any number of them gives the same rows."""
    from siftlog.operators import retrieval

    text = F.concat_ws(" ", *(F.substring(F.sha2((F.col("id") * 7 + i).cast("string"), 256), 1, 2) for i in range(40)))
    spark.range(400).select(F.col("id").alias("document_id"), text.alias("text")).write.parquet(f"{tmp_path}/small")
    spark.range(1600).select(F.col("id").alias("document_id"), text.alias("text")).write.parquet(f"{tmp_path}/large")
    small, large = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("small", "large"))
    queries = small.where("document_id < 5").select(F.col("document_id").alias("query_id"), "text")
    want = sorted(map(str, retrieval.bm25(queries, small, 5).collect()))
    monkeypatch.setattr(retrieval, "SHARE_BYTES", 2000)
    parts = [int(retrieval.bounded_tasks(d)["spark.sql.shuffle.partitions"]) for d in (small, large)]
    assert parts[0] > 4 and 3 * parts[0] < parts[1]
    assert sorted(map(str, retrieval.bm25(queries, small, 5).collect())) == want
    named = spark.createDataFrame([(1, "a b")], "document_id bigint, text string").rdd.toDF()
    assert retrieval.bounded_tasks(named)["spark.sql.shuffle.partitions"] == spark.conf.get("spark.sql.shuffle.partitions")


def test_digests_of_files_in_ranges(spark, tmp_path):
    """A file over ``chunk`` is read by several tasks, each going on from the state before; digests and lines are those of the whole file."""
    import hashlib
    import random

    from siftlog.sources.files import Sha256, file_digests

    r = random.Random(3)
    junk = r.randbytes(9000)
    texts = {"a": junk, "b": junk + b"\n", "c": b"x\r\ny\n\n" * 700, "d": b"z" * 3000 + b"\n" + b"q\n" * 900 + b"\x85\xc3", "e": b"short\n", "g": "\u2028\u00e9\r".encode() * 500, "h": b"\n" * 2048}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    got = {x["path"].rsplit("/", 1)[-1]: (x["size"], x["sha256"], x["lines"]) for x in file_digests(spark, str(tmp_path), chunk=1000).collect()}
    assert got == {n: (len(t), hashlib.sha256(t).hexdigest(), len(t.decode("utf-8", "replace").splitlines())) for n, t in texts.items()}
    first = Sha256()
    first.update(junk[:777])
    then = Sha256(first.dump())
    then.update(junk[777:])
    assert then.size() == 9000 and then.hexdigest() == hashlib.sha256(junk).hexdigest()
