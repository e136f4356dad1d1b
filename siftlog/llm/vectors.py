"""Operator 6: near-duplicate vectors by sorted projection passes.

In each pass vectors get a key: the signs of their projections on a pass's own random directions, one
bit after another. The vectors' mean is taken off first, as the directions of embeddings that all lean to
one side would share most bits. Sorted by key, near vectors come close together, and each is compared with
a bounded window of neighbours. The number of passes follows from the number of vectors, and is doubled
while the later half of the passes still unites much that the first half did not. Verified pairs of all
passes are united into components. As a dense component has more links than windows show, its links are
then counted exactly in blocks inside the component.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from siftlog.operators.graph import connected_components
from siftlog.scratch import materialize, release


def passes_for(rows: int, cosine: float, window: int, miss: float) -> int:
    """Passes that miss a pair at ``cosine`` with a chance of about ``miss`` among ``rows`` evenly spread vectors.

    ``log2(rows / window)`` bits tell the rows of a window from the others, and a pair shares each bit with
    the chance ``1 - angle / pi``; so passes grow with a small power of the rows (0.22 at cosine 0.9).
    """
    met = (1 - math.acos(cosine) / math.pi) ** max(0.0, math.log2(max(1, rows) / window))
    return 1 if met >= 1 else math.ceil(math.log(miss) / math.log1p(-met))


def _directions(seed: int, number: int, bits: int, size: int) -> np.ndarray:
    return np.random.default_rng((seed, number)).standard_normal((bits, size))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows; all vectors of a batch have one length."""
    x = np.asarray(column.flatten()).reshape(len(column), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True) if x.size else x


def _usable(vectors: DataFrame) -> DataFrame:
    fine = "embedding is not null and size(embedding) > 0 and vec_id is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    out = vectors.where(fine).select("vec_id", F.expr("transform(embedding, x -> double(x))").alias("embedding"))
    # squares of very large or small components leave the range of doubles: such vectors are scaled
    out = out.select("vec_id", "embedding", F.expr("array_max(transform(embedding, x -> abs(x)))").alias("top"))
    scaled = F.expr("if(top between 1e-100D and 1e100D, embedding, transform(embedding, x -> x / top))")
    return out.select("vec_id", scaled.alias("embedding"))


def _means(vectors: DataFrame, most: int = 16) -> dict[int, np.ndarray]:
    """Mean unit vector of each of the ``most`` commonest lengths; others are keyed as they are."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = np.diff(np.asarray(batch.column("embedding").offsets))
            for size in np.unique(lengths).tolist():
                own = _matrix(batch.column("embedding").filter(pa.array(lengths == size)))
                sums[size] = sums.get(size, 0.0) + np.append(own.sum(axis=0), len(own))
        for size, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([size] * len(total), pa.int32()), pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["size", "i", "value"])

    sums = materialize(vectors.select("embedding").mapInArrow(run, "size int, i int, value double").groupBy("size", "i").agg(F.sum("value").alias("value")), "means")
    common = sums.where("i = size").orderBy(F.desc("value"), "size").limit(most).select("size")
    out: dict[int, np.ndarray] = {}
    for r in sums.join(F.broadcast(common), "size").collect():
        out.setdefault(r["size"], np.zeros(r["size"] + 1))[r["i"]] = r["value"]
    release(sums)
    return {size: total[:-1] / total[-1] for size, total in out.items()}


def _keyed(vectors: DataFrame, numbers: list[int], bits: int, seed: int, kind: str, means: dict[int, np.ndarray]) -> DataFrame:
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            lengths = np.diff(np.asarray(batch.column("embedding").offsets))
            for size in np.unique(lengths):
                part = batch.filter(pa.array(lengths == size))
                x = _matrix(part.column("embedding")) - means.get(int(size), 0.0)
                for p in numbers:
                    key = np.packbits(x @ _directions(seed, p, bits, int(size)).T > 0, axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f"{size}/{p}"] * len(part)), pa.array([k.tobytes() for k in key], pa.binary()), part.column("vec_id"), part.column("embedding")],
                        names=["pass", "key", "vec_id", "embedding"],
                    )

    return vectors.mapInArrow(run, f"pass string, key binary, vec_id {kind}, embedding array<double>")


def _compare(x: np.ndarray, ids: np.ndarray, names: np.ndarray, window: int, cosine: float, only: int | None = None):
    """Pairs of rows at most ``window`` apart, in one pass, with enough cosine; ``only``: that span row ``only``."""
    u, v = [], []
    for d in range(1, min(window, len(x) - 1) + 1):
        near = np.einsum("ij,ij->i", x[:-d], x[d:]) >= cosine
        near &= names[:-d] == names[d:]
        if only is not None:
            at = np.arange(len(near))
            near &= (at < only) & (at + d >= only)
        i = np.flatnonzero(near)
        u.append(ids[i])
        v.append(ids[i + d])
    return np.concatenate(u) if u else ids[:0], np.concatenate(v) if v else ids[:0]


class _Forest:
    """Keeps of the pairs it is shown those that unite two sets: enough for the components, a row less than rows."""

    def __init__(self):
        self.parent: dict = {}

    def root(self, x):
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def new(self, u, v) -> tuple[list, list]:
        out: tuple[list, list] = ([], [])
        for a, b in zip(u.tolist(), v.tolist()):
            x, y = self.root(a), self.root(b)
            if x != y:
                self.parent[y] = x
                out[0].append(a)
                out[1].append(b)
        return out


def _windows(keyed: DataFrame, window: int, cosine: float, parts: int, kind: str) -> DataFrame:
    """Distinct pairs of verified neighbours, of those within a partition a spanning forest. The rows at the ends of a partition come out too and meet in a second step."""
    ordered = keyed.repartitionByRange(parts, "pass", "key", "vec_id").sortWithinPartitions("pass", "key", "vec_id")
    schema = f"u {kind}, v {kind}, seam int, side int, place int, pass string, embedding array<double>"

    def rows(u, v, seam=None, side=None, place=None, names=None, embedding=None):
        n = len(u)
        none = lambda t: pa.nulls(n, t)
        return pa.RecordBatch.from_arrays(
            [pa.array(u), pa.array(v), *(none(pa.int32()) if c is None else pa.array(c, pa.int32()) for c in (seam, side, place)), none(pa.string()) if names is None else pa.array(names, pa.string()), none(pa.list_(pa.float64())) if embedding is None else pa.array(embedding, pa.list_(pa.float64()))],
            names=["u", "v", "seam", "side", "place", "pass", "embedding"],
        )

    def run(batches):
        part = TaskContext.get().partitionId()
        kept, head, forest = None, [], _Forest()
        for batch in batches:
            ids, names = np.asarray(batch.column("vec_id")), np.asarray(batch.column("pass").to_pylist())
            vectors = batch.column("embedding").to_pylist()
            new = len(ids)
            if kept is not None:
                ids, names, vectors = np.concatenate([kept[0], ids]), np.concatenate([kept[1], names]), kept[2] + vectors
            old = len(ids) - new
            if len(head) < window:
                head += list(zip(ids[old:].tolist(), names[old:].tolist(), vectors[old:]))[: window - len(head)]
            at = 0
            for size in [len(list(g)) for _, g in groupby(names)]:
                x = np.array(vectors[at : at + size], float)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                u, v = _compare(x, ids[at : at + size], names[at : at + size], window, cosine)
                u, v = forest.new(u, v)
                if u:
                    yield rows(u, v)
                at += size
            kept = ids[-window:], names[-window:], vectors[-window:]
        if kept is not None:
            n = len(head)
            yield rows([h[0] for h in head], [h[0] for h in head], [part - 1] * n, [1] * n, list(range(n)), [h[1] for h in head], [h[2] for h in head])
            n = len(kept[0])
            yield rows(kept[0], kept[0], [part] * n, [0] * n, list(range(n)), kept[1].tolist(), kept[2])

    found = materialize(ordered.mapInArrow(run, schema), "windows")

    def join(pdf):
        pdf = pdf.sort_values(["side", "place"])
        out = []
        for _, g in pdf.groupby("pass", sort=False):
            x = np.array(g["embedding"].tolist(), float)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            out.append(_compare(x, g["u"].to_numpy(), g["pass"].to_numpy(), window, cosine, int((g["side"] == 0).sum())))
        return pd.DataFrame({"u": np.concatenate([o[0] for o in out]), "v": np.concatenate([o[1] for o in out])})

    seams = found.where("seam is not null").groupBy("seam").applyInPandas(join, f"u {kind}, v {kind}")
    pairs = found.where("seam is null").select("u", "v").unionByName(seams)
    links = materialize(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    release(found)
    return links


def _count_links(members: DataFrame, cosine: float, block: int, kind: str) -> DataFrame:
    """Exact number of links, copies of others included, of each member of a component, from blocks of its vectors.

    Vectors within half the angle of a component's pivot all link with each other and are counted by
    their number. The others meet every block of the component; a task holds two blocks at a time.
    """
    half = float(np.cos(np.arccos(cosine) / 2)) + 1e-9
    pivots = members.groupBy("component").agg(F.min_by("embedding", "vec_id").alias("pivot"), F.count("*").alias("size"))
    dot = "aggregate(zip_with(embedding, pivot, (a, b) -> a * b), 0D, (s, x) -> s + x)"
    norm = lambda c: f"sqrt(aggregate({c}, 0D, (s, x) -> s + x * x))"
    held = members.join(pivots, "component").withColumn("core", F.expr(f"{dot} / ({norm('embedding')} * {norm('pivot')}) >= {half}")).drop("pivot")
    held = materialize(held, "members")
    cores = held.where("core").groupBy("component").agg(F.sum("copies").alias("cores"))
    base = held.join(cores, "component", "left").select("vec_id", F.when(F.col("core"), F.col("cores") - F.col("copies")).otherwise(0).alias("n"))
    loose = held.where("not core").groupBy("component").agg(F.count("*").alias("loose"))
    cells = held.join(loose, "component")
    cells = cells.withColumn("blocks", F.expr(f"cast(ceil(size / {block}) as int)")).withColumn("cell", F.expr("cast(pmod(xxhash64(vec_id), blocks) as int)"))
    rows = cells.where("not core").select("component", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "vec_id", "copies", "embedding", F.lit(0).alias("side"), "core")
    columns = cells.select("component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("cell"), F.col("cell").alias("other"), "vec_id", "copies", "embedding", F.lit(1).alias("side"), "core")

    def count(pdf):
        a, b = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"vec_id": a["vec_id"][:0], "n": np.zeros(0, np.int64)})
        x, y = (np.array(p["embedding"].tolist(), float) for p in (a, b))
        x, y = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
        near = (x @ y.T >= cosine) & (a["vec_id"].to_numpy()[:, None] != b["vec_id"].to_numpy()[None, :])
        own = near @ b["copies"].to_numpy()
        back = a["copies"].to_numpy() @ near[:, b["core"].to_numpy(bool)]
        return pd.DataFrame({"vec_id": np.concatenate([a["vec_id"], b["vec_id"][b["core"].astype(bool)]]), "n": np.concatenate([own, back]).astype(np.int64)})

    dealt = rows.unionByName(columns).repartition("component", "cell", "other")
    met = dealt.groupBy("component", "cell", "other").applyInPandas(count, f"vec_id {kind}, n bigint")
    counted = materialize(base.unionByName(met).groupBy("vec_id").agg(F.sum("n").alias("n")), "counted")
    release(held)
    return counted


def near_vectors(vectors: DataFrame, cosine: float = 0.9, passes: int | None = None, passes_per_job: int = 4, window: int = 32, bits: int = 64, seed: int = 7, rows_per_part: int = 20_000, block: int = 1024, miss: float = 0.04, least_passes: int = 16) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every vector.

    Cosines are in double precision. A vector that is null, empty, zero or holds a null or a non-finite
    component links with nothing, as does one with a null id; vectors of different lengths never link.
    Equal vectors are one until the end: they link with each other and share their links. A repeated id
    is its first vector. Labels and other columns are ignored; an empty table gives no rows.

    ``passes`` follow from the counted vectors (``passes_for``, at least ``least_passes``) unless they are
    given. If the second half of them adds the share ``q`` to what the first half united, about ``q * q`` is
    missing, and while that is more than ``miss`` as many passes again follow. They are sorted a few per
    job, so that a job shuffles the vectors a few times at most.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    usable = _usable(vectors).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    unit = F.expr("transform(embedding, x -> x + 0D)")
    usable = materialize(usable.withColumn("digest", F.sha2(F.to_json(F.struct(unit.alias("e"))), 256)), "vectors")
    copies = usable.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    copies = materialize(copies, "copies")
    reps = materialize(usable.join(copies.select(F.col("rep").alias("vec_id")), "vec_id", "left_semi").select("vec_id", "embedding"), "reps")
    rows = reps.count()
    fixed, passes = passes is not None, passes or max(least_passes, passes_for(rows, cosine, window, miss))
    parts = max(1, -(-rows * passes_per_job // rows_per_part))
    means = _means(reps)
    found: list[DataFrame] = []

    def sort_passes(first: int, stop: int) -> DataFrame:
        """Links of more passes."""
        new = []
        for at in range(first, stop, passes_per_job):
            keyed = _keyed(reps, list(range(at, min(stop, at + passes_per_job))), bits, seed, kind, means)
            new.append(_windows(keyed, window, cosine, parts, kind))
        found.extend(new)
        return reduce(DataFrame.unionByName, new)

    half = passes if fixed or passes < 2 else passes // 2
    early, done = connected_components(sort_passes(0, half)), half
    while done < passes:
        sort_passes(done, passes)
        groups = connected_components(reduce(DataFrame.unionByName, found))
        before, after = (g.count() - g.select("component").distinct().count() for g in (early, groups))
        release(early)
        early, done = groups, passes
        if before < after and ((after - before) / max(1, before)) ** 2 > miss:
            passes *= 2
    groups = early
    release(*found)
    members = reps.join(groups.withColumnRenamed("node", "vec_id"), "vec_id")
    members = members.join(copies.select(F.col("rep").alias("vec_id"), "copies"), "vec_id")
    members = materialize(members, "grouped")
    counted = _count_links(members, cosine, block, kind)
    release(members, reps)
    info = copies.join(counted.withColumnRenamed("vec_id", "rep"), "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    info = info.select("digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    linked = usable.select("vec_id", "digest").join(info, "digest").select("vec_id", "n", "component")
    out = vectors.select("vec_id").join(linked, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

