"""Whitening against a dense eigenvalue decomposition."""

import numpy as np
import pytest

from siftlog.llm.queries import QUERIES
from siftlog.llm.whitening import whiten

NAN, INF = float("nan"), float("inf")


def dense(vectors, components=32):
    """Centred rows, eigenvalues and whitened rows, from the covariance matrix."""
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    y = (x - sums // n) - (sums % n) / n
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1], q[:, ::-1]
    exact = ((n * x.astype(object) - sums.astype(object)) ** 2).sum(1)
    k = min(components, int((e > e[0] * 1e-12).sum()))
    return e[:k], e.sum(), y @ q[:, :k] / np.sqrt(e[:k]), exact


def compare(df, vectors, ids, components=32):
    e, trace, want, exact = dense(vectors, components)
    k = len(e)
    got = whiten(df, components).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == len(vectors) * k
    order = np.argsort(ids, kind="stable")
    w = got.whitened.to_numpy().reshape(-1, k)
    sign = np.sign((w * want[order]).sum(0))
    assert np.abs(w * sign - want[order]).max() < 1e-8
    assert [int(v) for v in got.deviation.to_numpy().reshape(-1, k)[:, 0]] == list(exact[order])
    assert np.allclose(got.explained.to_numpy()[:k], e / trace, rtol=1e-9)
    assert got.identity_error.max() < 1e-9 and got.n.unique().tolist() == [len(vectors)]


def test_rows_that_count(spark):
    """Nulls, non-finite entries, other lengths and empty vectors go; repeated ids and other columns stay harmless."""
    r = np.random.default_rng(2)
    good = [[float(v) for v in r.normal(size=7) * (i % 3 + 1)] for i in range(150)]
    bad = [None, [], [NAN] + [0.0] * 6, [0.0] * 6 + [INF], [None] + [0.0] * 6, [1.0, 2.0], [1e300] + [0.0] * 6]
    rows = [(i, v, 5) for i, v in enumerate(good)] + [(1000 + i, v, 5) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, component int").repartition(5)
    compare(df, good, list(range(150)))
    compare(df, good, list(range(150)), components=3)


def test_repeated_rows_and_ids(spark):
    r = np.random.default_rng(3)
    v = [float(x) for x in r.normal(size=4)]
    rows = [(7, v)] * 3 + [(None, [float(x) for x in r.normal(size=4)]) for _ in range(20)]
    got = whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert len(got) == 23 * 4 and sum(x["vec_id"] is None for x in got) == 80
    assert len({x["whitened"] for x in got if x["vec_id"] == 7}) == 4


def test_equal_deviations_and_constant_dimensions(spark):
    """Corners of a cube have equal eigenvalues, which one start vector alone would not separate."""
    rows = [[float(s) if i == j else 0.0 for j in range(5)] + [3.0] for i in range(5) for s in (-1, 1)]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id int, embedding array<double>")
    got = whiten(df).toPandas()
    assert sorted(got.component.unique()) == [1, 2, 3, 4, 5] and got.identity_error.max() < 1e-9
    assert np.allclose(got.explained, 0.2)


def test_nothing_to_whiten(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id bigint, embedding array<double>")
    assert whiten(df).count() == 0 and whiten(df.limit(1)).count() == 0 and whiten(df.limit(0)).count() == 0
    assert whiten(df).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_numbers(spark):
    """Deviations beyond a long are null, all others exact."""
    rows = [(i, [float(i) * 1e9, float(i % 2)]) for i in range(6)]
    got = whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).where("component = 1").collect()
    x = np.array([[64_000_000_000 * i + 1_000_000, 64 * (i % 2) + 1_000_000] for i in range(6)], object)
    want = ((6 * x - x.sum(0)) ** 2).sum(1)
    assert {g["vec_id"]: g["deviation"] for g in got} == {i: int(w) if w < 2**63 else None for i, w in enumerate(want)}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query_equals_dense(spark, folder):
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    rows = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    e, trace, want, exact = dense([v for _, v in rows])
    got = QUERIES["op12_whitening"](spark, folder).toPandas().sort_values(["vec_id", "component"])
    w, order = got.whitened.to_numpy().reshape(-1, len(e)), np.argsort([i for i, _ in rows], kind="stable")
    assert np.abs(w * np.sign((w * want[order]).sum(0)) - want[order]).max() < 1e-7
    assert got.identity_error.max() < 1e-9
