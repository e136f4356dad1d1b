"""Operator 12: whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows ``X`` stay distributed. A step takes one pass: every row's entry of ``u = X w`` is made and
at once folded into ``Xᵀ u``, so left vectors are never stored; they are known by ``w`` (``u = X w``) and by
``z = Xᵀ u``, and both suffice to make a new one orthogonal to all earlier ones. Right vectors are made
orthogonal to all earlier ones as well. The driver holds vectors of one entry per dimension only, and the
singular value decomposition of the small bidiagonal matrix gives components and deviations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftlog.scratch import materialize, release

ROWS = 512  # rows of a numeric block: sums of so many entries of 53 bits fit 64


def whole_numbers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """``key, x``: entries as ``floor(scale * c) + shift`` of the usable vectors.

    Dropped: null and empty vectors, vectors with a null or non-finite entry, and vectors with an entry
    whose number needs over 53 bits.
    """
    x = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale) + shift)
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * scale < 2.0**53 - shift)
    good = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(fits(c), F.lit(False)))
    return vectors.where(good).select(key, x.alias("x"))


def _blocks(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            column = part.column("x")
            yield part, np.asarray(column.flatten()).reshape(part.num_rows, -1)


def _exact_sums(table: DataFrame) -> list[int]:
    """Sum of each dimension as an exact integer."""

    def run(batches):
        total = None
        for _, x in _blocks(batches):
            own = x.sum(axis=0).tolist()
            total = own if total is None else [a + b for a, b in zip(total, own)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([str(t) for t in total])], names=["i", "s"])

    sums = table.select("x").mapInArrow(run, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s"))
    return [int(r["s"]) for r in sorted(sums.collect(), key=lambda r: r["i"])]


class Centred:
    """Rows of a table of whole numbers, less their mean, seen through distributed sums."""

    def __init__(self, table: DataFrame, n: int, sums: list[int]):
        self.table, self.n = table, n
        self.base = np.array([s // n for s in sums], np.int64)
        self.rest = [s % n for s in sums]
        self.part = np.array([r / n for r in self.rest])

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.part

    def sums(self, make) -> np.ndarray:
        """The sum over all blocks of the vectors ``make(block of centred rows)``."""
        base, part = self.base, self.part

        def run(batches):
            total = None
            for _, x in _blocks(batches):
                own = make((x - base) - part)
                total = own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "value"])

        got = self.table.select("x").mapInArrow(run, "i int, value double").groupBy("i").agg(F.sum("value").alias("value")).collect()
        out = np.zeros(len(got))
        for r in got:
            out[r["i"]] = r["value"]
        return out


def _against(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``v`` less its part along the rows of ``basis``; twice, as once leaves rounding."""
    for _ in range(2):
        v = v - basis.T @ (basis @ v)
    return v


def bidiagonalize(rows: Centred, d: int, steps: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """``V, B`` with ``X V = U B``, ``B`` upper bidiagonal, right vectors as rows of ``V``.

    Where a direction is exhausted (equal deviations, fewer dimensions than columns) the process goes on
    with a new right vector orthogonal to all others, so that with ``steps = d`` nothing is missed.
    """
    draw = np.random.default_rng(seed)
    V, W, Z = np.zeros((0, d)), np.zeros((0, d)), np.zeros((0, d))
    alphas, betas, largest = [], [], 0.0

    def fresh() -> np.ndarray:
        v = _against(draw.standard_normal(d), V)
        return v / np.linalg.norm(v)

    v = fresh()
    for j in range(steps):
        V = np.vstack([V, v])
        w = v - (betas[-1] * W[-1] if betas else 0.0)
        for _ in range(2):
            w = w - W.T @ (Z @ w)
        # One pass: u = X w by row, its square length, and Xᵀ u.
        got = rows.sums(lambda y, w=w: np.append((u := y @ w) @ y, u @ u))
        z, alpha = got[:-1], float(np.sqrt(got[-1]))
        largest = max(largest, alpha)
        if alpha <= largest * 1e-12:
            alpha, z, w = 0.0, np.zeros(d), np.zeros(d)
        else:
            z, w = z / alpha, w / alpha
        alphas.append(alpha)
        W, Z = np.vstack([W, w]), np.vstack([Z, z])
        if j + 1 == steps:
            break
        v = _against(z - alpha * V[-1], V)
        beta = float(np.linalg.norm(v))
        if beta <= largest * 1e-12:
            beta, v = 0.0, fresh()
        else:
            v = _against(v / beta, V)
            v /= np.linalg.norm(v)
        betas.append(beta)
    return V, np.diag(alphas) + np.diag(betas, 1)


def whiten(vectors: DataFrame, components: int = 32, key: str = "vec_id", vector: str = "embedding", scale: int = 64, shift: int = 1_000_000, steps: int | None = None) -> DataFrame:
    """One row per usable vector and component: ``key, component, n, deviation, whitened, explained, identity_error``.

    The fit list is all usable vectors (``whole_numbers``), repeated rows and ids as often as they come;
    null ids are kept, other columns ignored. Vectors of another length than the most frequent one (of
    equally frequent ones the longest) are dropped too. Components are numbered by falling deviation;
    directions without any (under 1e-10 of the largest) have none, so equal vectors and an empty table
    give no rows. ``deviation`` is exact, and null where it doesn't fit a long. ``steps``, by default one
    for each dimension, may be lessened for very long vectors; each is one pass over the whole numbers,
    which are written once. What leaves the tasks of a pass is one number per dimension.
    """
    spark = vectors.sparkSession
    head = f"{key} {vectors.schema[key].dataType.simpleString()}"
    schema = f"{head}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    table = materialize(whole_numbers(vectors, key, vector, scale, shift), "whitening")
    lengths = table.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not lengths:
        release(table)
        return spark.createDataFrame([], schema)
    d, n = lengths[0]
    own = table.where(F.size("x") == d)
    rows = Centred(own, n, _exact_sums(own))
    V, B = bidiagonalize(rows, d, min(d, steps or d))
    _, sigma, right = np.linalg.svd(B)
    kept = min(components, int((sigma > sigma[0] * 1e-10).sum())) if sigma[0] > 0 else 0
    if not kept:
        release(table)
        return spark.createDataFrame([], schema)
    sigma = sigma[:kept]
    project = (right[:kept] @ V).T / (sigma / np.sqrt(n))
    got = rows.sums(lambda y: np.append((y @ project).sum(axis=0), (y * y).sum()))
    mean, trace = got[:-1] / n, got[-1] / n
    spread = rows.sums(lambda y: ((w := y @ project - mean).T @ w).ravel()).reshape(kept, kept) / n
    error = float(np.abs(spread - np.eye(kept)).max())
    explained = sigma**2 / n / trace
    base, rest, part = rows.base, rows.rest, rows.part

    def run(batches):
        for batch, x in _blocks(batches):
            whole = x - base
            dev = _deviations(whole, rest, n)
            white = (whole - part) @ project
            m = batch.num_rows
            at = pa.array(np.repeat(np.arange(m), kept))
            columns = [
                batch.column(key).take(at), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)), pa.array(np.full(m * kept, n, np.int64)), dev.take(at),
                pa.array(white.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * kept, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return own.mapInArrow(run, schema)


def _deviations(whole: np.ndarray, rest: list[int], n: int) -> pa.Array:
    """Sum of ``(n * x - S)²`` by row of ``x`` less the whole part of the mean; beyond a long null."""
    bound = (np.abs(whole).astype(float) + 1) * n
    if (bound * bound).sum(axis=1).max() < 2.0**62:
        off = whole * n - np.array(rest, np.int64)
        return pa.array((off * off).sum(axis=1))
    exact = [sum((n * v - r) ** 2 for v, r in zip(row, rest)) for row in whole.tolist()]
    return pa.array([e if e < 2**63 else None for e in exact], pa.int64())
