"""Exact quantiles and dominance counts against brute force."""

import math
import random
from datetime import datetime, timedelta

import numpy as np

from siftlog.operators.cases import entity_history
from siftlog.operators.history import auth_frequency
from siftlog.operators.quantiles import quantiles
from siftlog.operators.running import count_dominated

T = datetime(2024, 1, 1)


def test_quantiles_equal_sorting(spark):
    """Ties, signs, zeros of both signs, far exponents, groups of one row, nulls."""
    r = random.Random(1)
    rows = [(r.choice("abc"), r.choice([r.gauss(0, 1e3), 5.0, -0.0, 0.0, 1e-300, -1e300])) for _ in range(1500)] + [("one", 2.5), ("none", None), (None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    wanted = {"a": (0.95, "linear"), "b": (0.5, "linear"), "c": (0.95, "nearest"), "d": (0.0, "nearest"), "e": (1.0, "linear")}
    got = {x["k"]: x for x in quantiles(df, "v", wanted, ("k",)).collect()}
    assert set(got) == {"a", "b", "c", "one", None}
    for k, x in got.items():
        v = sorted(b for g, b in rows if g == k)
        assert np.allclose([x["a"], x["b"], x["e"]], np.quantile(v, [0.95, 0.5, 1.0]), rtol=1e-12)
        assert (x["c"], x["d"]) == (v[math.ceil(0.95 * len(v)) - 1], v[0])
    assert quantiles(df.where("v is null"), "v", {"a": (0.5, "linear")}).collect() == [(None,)]


def test_quantiles_of_endless_values(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (1.0,)], "v double")
    got = quantiles(df, "v", {"a": (0.25, "nearest"), "b": (0.5, "nearest"), "c": (0.75, "nearest"), "d": (1.0, "nearest")}).first()
    assert got["a"] == float("-inf") and got["b"] == 1.0 and got["c"] == float("inf") and math.isnan(got["d"])


def test_dominated_points(spark):
    r = random.Random(2)
    at = lambda: T + timedelta(minutes=r.randint(0, 9000))
    points = [(r.choice("ab"), at(), at()) for _ in range(500)]
    asks = [(i, r.choice("abz"), at(), at()) for i in range(200)]
    kinds = "k string, x timestamp_ntz, y timestamp_ntz"
    got = dict(map(tuple, count_dominated(spark.createDataFrame(asks, f"id int, {kinds}"), spark.createDataFrame(points, kinds), ["k"], "id", "x", "y", "n").collect()))
    assert all(got.get(i, 0) == sum(p[0] == k and p[1] < x and p[2] < y for p in points) for i, k, x, y in asks)


def test_auth_frequency_of_long_sessions(spark):
    """Sessions that last for days put events outside the window while they end inside it; equal times, users without a name."""
    r = random.Random(3)
    sessions, events = [], []
    for i in range(120):
        user, start = r.choice(["u", "v", None]), T + timedelta(minutes=r.randint(0, 6000))
        times = sorted(start + timedelta(minutes=r.choice([0, 0, 5, 300, 1440, 3000])) for _ in range(r.randint(1, 6)))
        events += [(f"{i}:{j}", user, r.choice(["ssh_auth_success", "other"]), t) for j, t in enumerate(times)]
        sessions.append((f"s{i}", user, times[0], times[-1], [f"{i}:{j}" for j in range(len(times))]))
    by_id = {e[0]: e for e in events}
    day = timedelta(hours=24)
    want = {
        s: sum(by_id[e][2] == "ssh_auth_success" and start - day <= by_id[e][3] < start for _, u, _, end, own in sessions if u is not None and u == user and end < start for e in own)
        for s, user, start, _, _ in sessions
    }
    s = spark.createDataFrame(sessions, "session_id string, user string, start_time timestamp_ntz, end_time timestamp_ntz, events array<string>")
    e = spark.createDataFrame(events, "event_id string, user string, event_type string, ts timestamp_ntz")
    assert dict(map(tuple, auth_frequency(s, e).collect())) == want and sum(want.values()) > 100


def test_entity_history_at_many_boundaries(spark):
    """Boundaries of one entity within a day and over days, at the very end of a session, before all, of unknown entities."""
    r = random.Random(4)
    s = []
    for i in range(150):
        start = T + timedelta(minutes=r.randint(0, 7000))
        s.append((f"s{i}", r.choice(["u", "v"]), r.choice(["a", "b", None]), r.choice("xyz"), start, start + timedelta(minutes=r.choice([0, 5, 2000])), r.randint(1, 9)))
    asks = [(k, v, r.choice([r.choice(s)[5], T + timedelta(minutes=r.randint(-100, 9000))])) for _ in range(40) for k, v in (("user", "u"), ("src_ip", "a"), ("host", "y"), ("host", "none"))]
    columns = {"user": 1, "src_ip": 2, "host": 3}
    sessions = spark.createDataFrame(s, "session_id string, user string, src_ip string, host string, start_time timestamp_ntz, end_time timestamp_ntz, event_count bigint")
    got = {tuple(x[:3]): x for x in entity_history(spark.createDataFrame(list(dict.fromkeys(asks)), "entity_type string, entity_id string, before timestamp_ntz"), sessions).collect()}
    for k, v, before in asks:
        own = [x for x in s if x[columns[k]] == v and x[5] < before]
        x = got[k, v, before]
        assert (x["sessions"], x["events"]) == (len(own), sum(y[6] for y in own))
        assert (x["window_start"], x["window_end"]) == (min((y[4] for y in own), default=None), max((y[5] for y in own), default=None))
        assert (x["hosts"], x["users"], x["src_ips"]) == (len({y[3] for y in own}), len({y[1] for y in own}), len({y[2] for y in own} - {None}))
