import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siftlog.operators import history, sessions as sess

T0 = datetime(2026, 1, 1, 12)
SCHEMA = "event_id string, source string, line_no bigint, ts timestamp_ntz, host string, src_ip string, user string, event_type string, success boolean, method string, key_fingerprint string, src_port bigint, raw_message string"


def ev(spark, rows):
    """(seconds, host, ip, user, type)"""
    data = []
    for i, (s, host, ip, user, kind) in enumerate(rows, 1):
        data.append((f"a:{i}", "a", i, T0 + timedelta(seconds=s), host, ip, user, kind, None if kind == "account_created" else "failure" not in kind, "password" if "ssh" in kind else None, None, 22, kind))
    return spark.createDataFrame(data, SCHEMA)


LOGIN = "ssh_auth_success"


def test_gap_is_strict(spark):
    e = ev(spark, [(0, "h", "i", "u", LOGIN), (300, "h", "i", "u", LOGIN), (601, "h", "i", "u", "sudo_command"), (0, "h", "i", "v", LOGIN)])
    got = sess.build_sessions(e, 300.0).orderBy("user", "start_time").collect()
    assert [(r["user"], r["event_count"], r["has_escalation"]) for r in got] == [("u", 2, False), ("u", 1, True), ("v", 1, False)]
    assert got[0]["session_id"] == "a:h:i:u:2026-01-01T12:00:00+00:00"
    assert got[0]["events"] == ["a:1", "a:2"]


def test_sessions_cross_midnight(spark):
    e = ev(spark, [(12 * 3600 - 10, "h", "i", "u", LOGIN), (12 * 3600 + 10, "h", "i", "u", LOGIN), (5 * 86400, "h", "i", "u", LOGIN)])
    assert sorted(r["event_count"] for r in sess.build_sessions(e, 60.0).collect()) == [1, 2]


def test_unmatched_and_empty(spark):
    e = ev(spark, [(0, "h", None, "u", LOGIN), (1, "h", "i", None, LOGIN)])
    assert sess.unmatched(e).count() == 2
    assert sess.build_sessions(e, 60.0).count() == 0
    assert sess.build_sessions(e.limit(0), 60.0).count() == 0


def gap_frame(spark, values):
    return spark.createDataFrame([(float(x),) for x in values], "gap double")


def test_fits(spark):
    assert sess.fit_percentile(gap_frame(spark, [1, 2, 3, 4, 5, 100])).first()[0] == pytest.approx(76.25)
    assert sess.fit_mean_std(gap_frame(spark, [1, 2, 3])).first()[0] == pytest.approx(4.0)
    assert sess.fit_mean_std(gap_frame(spark, [5])).first()[0] == 5


def brute_knee(values):
    xs = sorted(values)
    n = len(xs)
    if n < 3 or xs[0] == xs[-1]:
        return None
    best = max(range(n), key=lambda i: (round(abs(i / (n - 1) - (xs[i] - xs[0]) / (xs[-1] - xs[0])) / 2**0.5, 12), -i))
    d = abs(best / (n - 1) - (xs[best] - xs[0]) / (xs[-1] - xs[0])) / 2**0.5
    return xs[best] if d >= 0.05 else None


@pytest.mark.parametrize("seed", range(6))
def test_knee(spark, seed):
    r = random.Random(seed)
    xs = [r.choice([1, 2, 3, 5, 8, 1000, r.randint(1, 50)]) for _ in range(r.randint(2, 40))]
    want = brute_knee(xs)
    got = sess.fit_knee(gap_frame(spark, xs)).first()[0]
    assert got == pytest.approx(want if want is not None else sess.fit_percentile(gap_frame(spark, xs)).first()[0])


def test_history_fixture(spark):
    """Two earlier sessions: two days before on host b, an hour before on host a."""
    day = 86400
    e = ev(spark, [(-2 * day, "b", "i", "u", LOGIN), (-3600, "a", "i", "u", LOGIN), (0, "a", "i", "u", LOGIN)])
    s = sess.build_sessions(e, 60.0)
    now = next(r for r in history.context(s, e).collect() if r["session_id"].endswith("2026-01-01T12:00:00+00:00"))
    assert (now["user_observations"], now["src_ip_observations"], now["host_observations"]) == (2, 2, 1)
    assert (now["distinct_hosts_for_user"], now["distinct_users_for_src_ip"], now["distinct_users_for_host"], now["distinct_src_ips_for_host"]) == (2, 1, 1, 1)
    assert now["auth_frequency_window_count"] == 1 and not now["user_first_seen"]


def test_history_is_strict(spark):
    """A session that ends exactly when another starts is not its history."""
    e = ev(spark, [(0, "a", "i", "u", LOGIN), (0, "b", "i", "u", LOGIN)])
    got = history.observation_counts(sess.build_sessions(e, 60.0)).collect()
    assert [r["user_observations"] for r in got] == [0, 0]


def test_violations(spark):
    e = ev(spark, [(0, "a", "i", "u", LOGIN), (5, "a", "i", "u", LOGIN)])
    s = sess.build_sessions(e, 60.0)
    assert history.violations(s, e).count() == 0
    from pyspark.sql import functions as F

    bad = s.withColumn("events", F.reverse("events")).withColumn("event_count", F.lit(3).cast("bigint"))
    assert {r["rule"] for r in history.violations(bad, e).collect()} == {"unordered", "wrong_count"}


def test_features(spark):
    e = ev(spark, [(0, "a", "i", "u", "ssh_auth_failure"), (1, "a", "i", "u", LOGIN), (2, "a", "i", "u", LOGIN)])
    f = history.features(sess.build_sessions(e, 60.0), e, "Asia/Kolkata").first()
    assert f["failure_proportion"] == pytest.approx(1 / 3) and f["success_proportion"] == pytest.approx(2 / 3)
    assert (f["hour_utc"], f["login_hour_local"]) == (12, 17)
    assert [x["event_type"] for x in f["event_type_proportions"]] == ["ssh_auth_failure", "ssh_auth_success"]


def test_history_reads_its_sessions_a_fixed_number_of_times(spark):
    """Every count doubled the plan of the one before it: 16 passes over the sessions for four counts."""
    from siftlog.operators import cases

    s = spark.createDataFrame([("a", "u", "1", "h", T0, T0, 1)], "session_id string, user string, src_ip string, host string, start_time timestamp_ntz, end_time timestamp_ntz, event_count bigint")
    reads = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    assert reads(history.distinct_counts(s)) <= 4
    assert reads(history.observation_counts(s)) <= 4
    asks = s.selectExpr("'host' as entity_type", "host as entity_id", "end_time as before")
    assert reads(cases.entity_history(asks, s)) <= 5
    inputs = s.withColumns({c: F.lit(1.0) for _, names in history.MODEL_INPUTS.values() for c in names if c != "event_count"}).withColumn("event_types", F.array(F.lit("x")))
    assert reads(history.model_inputs(inputs)) == 1
