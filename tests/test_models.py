import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlog.operators import models

T0 = datetime(2026, 1, 1)


def test_hour_rarity_replay(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), r.randint(0, 3), T0 + timedelta(minutes=r.randint(0, 500)), f"{i:03}") for i in range(60)]
    got = {x["id"]: x["score"] for x in models.hour_rarity(spark.createDataFrame(rows, "entity string, hour int, at timestamp, id string")).collect()}
    seen = {}
    for e, h, _, i in sorted(rows, key=lambda x: (x[2], x[3])):
        own = seen.setdefault(e, [])
        assert got[i] == pytest.approx(-math.log((own.count(h) + 1) / (len(own) + 24)))
        own.append(h)


def test_transition_replay(spark):
    r = random.Random(2)
    rows = [(f"{i:03}", r.choice("ab"), T0 + timedelta(minutes=i), [r.choice("xyz") for _ in range(r.randint(1, 5))]) for i in range(40)]
    got = {x["id"]: x for x in models.transition_surprise(spark.createDataFrame(rows, "id string, entity string, at timestamp, items array<string>")).collect()}
    state = {}
    for i, e, _, items in rows:
        pairs, vocabulary = state.setdefault(e, ({}, set()))
        v = len(vocabulary | set(items))
        s = [-math.log((pairs.get((a, b), 0) + 1) / (sum(n for (x, _), n in pairs.items() if x == a) + v)) for a, b in zip(items, items[1:])]
        assert got[i]["score"] == pytest.approx(sum(s) / len(s) if s else 0.0)
        assert (got[i]["max_surprise"] is None) == (not s)
        for p in zip(items, items[1:]):
            pairs[p] = pairs.get(p, 0) + 1
        vocabulary |= set(items)


def test_calibration(spark):
    scores = spark.createDataFrame([("c", 0.8), ("a", 0.8), ("b", 0.8), ("d", 0.2)], "ref string, raw_score double").withColumn("normal", F.lit(True))
    floor = models.calibrate_budget(scores, 2).first()["floor"]
    assert floor == 0.8
    assert [r["ref"] for r in models.select_alerts(scores, floor, 2).collect()] == ["a", "b"]


def test_frozen_scores_abstain(spark):
    sessions = spark.createDataFrame([("s1", "u", None, "h"), ("s2", None, "i", "h")], "session_id string, user string, src_ip string, host string")
    states = spark.createDataFrame([("login_hour_rarity", "u", 5), ("auth_frequency", "u", 1)], "model_id string, entity string, n bigint")
    raw = spark.createDataFrame([("s1", "login_hour_rarity", 1.5), ("s1", "auth_frequency", 9.0)], "session_id string, model_id string, raw_score double")
    got = {(r["session_id"], r["model_id"]): r for r in models.frozen_scores(sessions, states, raw, models.registry(spark)).collect()}
    assert got["s1", "login_hour_rarity"]["raw_score"] == 1.5
    assert (got["s1", "auth_frequency"]["reason"], got["s1", "auth_frequency"]["raw_score"]) == ("warmup_incomplete", None)
    assert got["s1", "src_ip_behavior"]["reason"] == "identity_missing" and got["s2", "src_ip_behavior"]["reason"] == "no_artifact"
    best = {r["session_id"]: r["score"] for r in models.candidates(models.frozen_scores(sessions, states, raw, models.registry(spark))).collect()}
    assert best == {"s1": 1.5, "s2": None}


def test_ineligible(spark):
    rows = [("a", "normal", "training", "x", "0" * 64), ("b", "attack", "training", "x", "1" * 64), ("c", "normal", "training", "x", "0" * 64), ("d", "normal", "evaluation", "", "Z")]
    got = {(r["id"], r["rule"]) for r in models.ineligible(spark.createDataFrame(rows, "id string, label string, split string, reason string, sha256 string")).collect()}
    assert got == {("b", "not_normal"), ("a", "repeated_hash"), ("d", "not_training"), ("d", "no_reason"), ("d", "bad_hash")}


def test_half_space_trees_rank_an_outlier(spark):
    r = random.Random(3)
    rows = [("e", f"{i:04}", T0 + timedelta(minutes=i), [r.gauss(0.5, 0.02), r.gauss(0.5, 0.02)]) for i in range(160)]
    rows += [("e", "9998", T0 + timedelta(days=1), [0.99, 0.01]), ("e", "0000x", T0 - timedelta(days=1), [0.0, 0.0]), ("e", "0000y", T0 - timedelta(days=1), [1.0, 1.0])]
    got = {x["id"]: x["score"] for x in models.half_space_trees(spark.createDataFrame(rows, "entity string, id string, at timestamp, vector array<double>"), 20, 5, 60).collect()}
    late = sorted(v for k, v in got.items() if v is not None and k != "9998")
    assert got["0000"] == 0.0 and got["9998"] > late[int(0.9 * len(late))]


def test_drift(spark):
    rows = [("m", "e", T0 + timedelta(minutes=i), f"{i:04}", 0.0 if i < 300 else 5.0) for i in range(600)] + [("m", "calm", T0 + timedelta(minutes=i), f"{i:04}", 1.0) for i in range(300)]
    got = {r["entity"]: r for r in models.drift(spark.createDataFrame(rows, "model_id string, entity string, at timestamp, id string, score double")).collect()}
    assert got["calm"]["drifts"] == 0
    assert got["e"]["drifts"] >= 1 and got["e"]["last"] >= 300


def plain_trees(rows, feature, cut, height, window):
    """Half-space trees one row at a time: scale, score, then learn, as the published algorithm does."""
    out, low, high, count = [], None, None, 0
    size = 2 ** (height + 1) - 1
    learned, reference = np.zeros((len(feature), size)), None

    def walk(t, x):
        at = 0
        for depth in range(height + 1):
            yield depth, at
            if depth < height:
                at = 2 * at + 1 + int(x[feature[t, at]] >= cut[t, at])

    def scale(v):
        return [(a - lo) / (hi - lo) if hi > lo else 0.0 for a, lo, hi in zip(v, low, high)]

    for v in rows:
        score = 0.0
        if reference is not None:
            x, total = scale(v), 0.0
            for t in range(len(feature)):
                for depth, node in walk(t, x):
                    total += reference[t, node] * 2**depth
                    if reference[t, node] < 0.1 * window:
                        break
            score = 1 - total / (len(feature) * window * size)
        out.append(score)
        low = v if low is None else [min(a, b) for a, b in zip(low, v)]
        high = v if high is None else [max(a, b) for a, b in zip(high, v)]
        x = scale(v)
        for t in range(len(feature)):
            for _, node in walk(t, x):
                learned[t, node] += 1
        count += 1
        if count % window == 0:
            reference, learned = learned, np.zeros_like(learned)
    return out


def test_half_space_trees_equal_replay(spark):
    """Entities of less than a window, of whole windows and of several, over days, with equal times and a null entity."""
    r = np.random.default_rng(5)
    rows = []
    for entity, n in (("a", 130), ("b", 20), ("c", 40), (None, 45), ("d", 1)):
        for i in range(n):
            at = datetime(2024, 1, 1) + timedelta(hours=int(i // 3 * 2))
            rows.append((entity, f"{entity}{i:04d}", at, [float(x) for x in r.normal(size=3) * (1 + i / 20)]))
    df = spark.createDataFrame(rows, "entity string, id string, at timestamp_ntz, vector array<double>").repartition(7)
    got = {x["id"]: x["score"] for x in models.half_space_trees(df, trees=4, height=5, window=20, seed=3).collect()}
    feature, cut = models.half_space_splits(3, 4, 5, 3)
    for entity in ("a", "b", "c", None, "d"):
        own = sorted((x for x in rows if x[0] == entity), key=lambda x: (x[2], x[1]))
        want = plain_trees([x[3] for x in own], feature, cut, 5, 20)
        assert np.allclose([got[x[1]] for x in own], want, atol=1e-12), entity
    assert len(got) == len(rows) and any(0 < s < 1 for s in got.values())


def test_drift_equals_replay(spark):
    """Series that jump, over several batches of rows, with nulls that count as places."""
    r = np.random.default_rng(6)
    series = {("m", "jumps"): [float(x) for x in np.r_[r.normal(0, 0.1, 400), r.normal(3, 0.1, 400)]], ("m", "calm"): [0.5] * 300, ("n", "jumps"): [None if i % 7 == 0 else float(i > 200) for i in range(500)]}
    rows = [(m, e, i, f"{i:05d}", x) for (m, e), own in series.items() for i, x in enumerate(own)]
    df = spark.createDataFrame(rows, "model_id string, entity string, at int, id string, score double").repartition(5)
    want = {}
    for key, own in series.items():
        detector = models.Adwin()
        want[key] = [i for i, x in enumerate(own) if x is not None and detector.update(x)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        found = models.detections(df).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for key, hits in want.items():
        own = [x for x in found if (x["model_id"], x["entity"]) == key]
        assert sorted(x["place"] for x in own if x["observations"] is None) == hits
        end = [x for x in own if x["observations"] is not None]
        assert [(x["observations"], x["drifts"], x["place"]) for x in end] == [(len(series[key]), len(hits), hits[-1] if hits else None)]
    assert want["m", "jumps"] and want["n", "jumps"] and not want["m", "calm"]
