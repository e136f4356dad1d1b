"""Per-entity behaviour models as windows and counts: prequential scores, frozen state, scoring, calibration.

Prequential scores use only earlier observations of an entity, in the order (started_at, session_id);
frozen scores use a state table and never learn. Formulas of the deviation, tree and drift models are
from the published algorithms; they agree with those in method, not bit by bit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from siftlog.operators.running import numbered
from siftlog.scratch import materialize

# Models, their entity, warm-up and parameters; each has a drift companion.
REGISTRY = [
    ("login_hour_rarity", "user", 2, "alpha=1"),
    ("auth_frequency", "user", 2, ""),
    ("src_ip_behavior", "src_ip", 250, "trees=10 height=8 window=250 seed=42"),
    ("host_access", "host", 250, "trees=10 height=8 window=250 seed=42"),
    ("transition_surprise", "user", 2, "alpha=1"),
]
DRIFT = "delta=0.002 clock=32 max_buckets=5 min_window=5 grace=10"
SCHEMA_VERSION = "1"
SEED = 42


def registry(spark) -> DataFrame:
    rows = [(m, e, w, p, SCHEMA_VERSION, None) for m, e, w, p in REGISTRY] + [(f"{m}_drift", e, w, DRIFT, SCHEMA_VERSION, m) for m, e, w, _ in REGISTRY]
    return spark.createDataFrame(rows, "model_id string, entity_kind string, warmup int, parameters string, feature_schema string, parent string")


def hour_rarity(obs: DataFrame, alpha: float = 1.0) -> DataFrame:
    """M1, prequential: ``obs(entity, hour, at, id)`` plus score -ln((n_hour + a) / (n + 24 a)) over earlier rows."""
    order = ["at", "id"]
    n = F.row_number().over(Window.partitionBy("entity").orderBy(*order)) - 1
    k = F.row_number().over(Window.partitionBy("entity", "hour").orderBy(*order)) - 1
    return obs.withColumn("seen", n).withColumn("score", -F.log((k + alpha) / (n + 24 * alpha)))


def hour_state(obs: DataFrame) -> DataFrame:
    """M1, state: observations by entity and hour."""
    return obs.groupBy("entity", "hour").agg(F.count("*").alias("n"))


def score_hours(candidates: DataFrame, state: DataFrame, alpha: float = 1.0) -> DataFrame:
    """M1, frozen: ``candidates(id, entity, hour)``; null score for an entity without state."""
    totals = state.groupBy("entity").agg(F.sum("n").alias("total"))
    out = candidates.join(totals, "entity", "left").join(state, ["entity", "hour"], "left")
    return out.select("id", "entity", "total", F.when(F.col("total").isNotNull(), -F.log((F.coalesce("n", F.lit(0)) + alpha) / (F.col("total") + 24 * alpha))).alias("score"))


def frequency_deviation(obs: DataFrame) -> DataFrame:
    """M2, prequential: |y - mean| / (sd + 1e-10) of earlier rows of ``obs(entity, y, at, id)``; none yet: mean = sd = 0."""
    w = Window.partitionBy("entity").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    mean, sd = F.coalesce(F.avg("y").over(w), F.lit(0.0)), F.coalesce(F.stddev_samp("y").over(w), F.lit(0.0))
    score = F.abs(F.col("y") - mean) / (sd + 1e-10)
    seen = F.row_number().over(Window.partitionBy("entity").orderBy("at", "id")) - 1
    return obs.withColumn("seen", seen).withColumn("score", score)


def frequency_state(obs: DataFrame) -> DataFrame:
    return obs.groupBy("entity").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.coalesce(F.var_samp("y"), F.lit(0.0)).alias("variance"))


def transitions(sequences: DataFrame) -> DataFrame:
    """``(id, entity, at, pos, a, b)`` of consecutive items of ``sequences(id, entity, at, items)``."""
    pairs = F.expr("transform(sequence(1, size(items) - 1), i -> struct(i as pos, element_at(items, i) as a, element_at(items, i + 1) as b))")
    return sequences.where("size(items) > 1").select("id", "entity", "at", F.explode(pairs).alias("p")).select("id", "entity", "at", "p.*")


def transition_surprise(sequences: DataFrame, alpha: float = 1.0) -> DataFrame:
    """M4, prequential: mean and largest -ln((c(a,b) + 1) / (c(a) + V)) over a sequence's transitions.

    Counts are those of the entity's earlier sequences; V counts the items seen there or in the sequence
    itself. A sequence without transitions has null components and the score 0.
    """
    order = ["at", "id"]
    steps = transitions(sequences)
    by_pair = steps.groupBy("entity", "a", "b", *order).agg(F.count("*").alias("c"))
    w = Window.partitionBy("entity", "a", "b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    by_pair = by_pair.withColumn("seen_pair", F.coalesce(F.sum("c").over(w), F.lit(0)))
    by_item = by_pair.groupBy("entity", "a", *order).agg(F.sum("c").alias("n"))
    w = Window.partitionBy("entity", "a").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    by_item = by_item.withColumn("seen_a", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")
    items = sequences.select("id", "entity", "at", F.explode(F.array_distinct("items")).alias("item"))
    first = Window.partitionBy("entity", "item").orderBy(*order)
    items = items.withColumn("fresh", F.when(F.row_number().over(first) == 1, 1).otherwise(0))
    size = items.groupBy("entity", *order).agg(F.sum("fresh").alias("fresh"))
    w = Window.partitionBy("entity").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    size = size.withColumn("vocabulary", F.sum("fresh").over(w)).drop("fresh")
    scored = by_pair.join(by_item, ["entity", "a", *order]).join(size, ["entity", *order])
    scored = scored.withColumn("s", -F.log((F.col("seen_pair") + alpha) / (F.col("seen_a") + alpha * F.col("vocabulary"))))
    per = scored.groupBy("id").agg((F.sum(F.col("s") * F.col("c")) / F.sum("c")).alias("mean_surprise"), F.max("s").alias("max_surprise"), F.sum(F.when(F.col("seen_pair") == 0, F.col("c")).otherwise(0)).alias("unseen"))
    out = sequences.select("id", "entity", "at").join(per, "id", "left")
    return out.withColumn("score", F.coalesce("mean_surprise", F.lit(0.0)))


def ineligible(observations: DataFrame) -> DataFrame:
    """M6: ``id, rule`` of training observations that may not be learned from; empty if all may."""
    rules = F.array(
        F.when(~F.col("label").eqNullSafe("normal"), F.lit("not_normal")),
        F.when(~F.col("split").eqNullSafe("training"), F.lit("not_training")),
        F.when(F.coalesce(F.col("reason"), F.lit("")) == "", F.lit("no_reason")),
        F.when(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), F.lit("bad_hash")),
    )
    listed = observations.select("id", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("rule"))
    hashes = observations.groupBy("sha256").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1").select("id", F.lit("repeated_hash").alias("rule"))
    ids = observations.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated_id").alias("rule"))
    return listed.unionByName(hashes).unionByName(ids)


def readiness(scores: DataFrame, models: DataFrame) -> DataFrame:
    """By model, its entities, how many are past the warm-up, and why it isn't ready.

    ``scores(model_id, entity)`` has one row per learned observation.
    """
    per = scores.groupBy("model_id", "entity").agg(F.count("*").alias("n")).join(F.broadcast(models.select("model_id", "warmup")), "model_id")
    per = per.groupBy("model_id").agg(F.count("*").alias("entities"), F.count_if(F.col("n") >= F.col("warmup")).alias("ready_entities"))
    out = models.select("model_id", "warmup").join(per, "model_id", "left").na.fill(0, ["entities", "ready_entities"])
    reason = F.when(F.col("entities") == 0, "no_artifact").when(F.col("ready_entities") < F.col("entities"), "warmup_incomplete").otherwise("ready")
    return out.withColumn("ready", reason == "ready").withColumn("reason", reason)


def catalogue(states: DataFrame, models: DataFrame) -> DataFrame:
    """Every entity's state of every model, ready or with the observations it lacks; invalid ones (M11) are not listed.

    ``states(model_id, entity, n, ...)``; a model without states has one row without an entity.
    """
    sound = states.join(incompatible(states, models).select("model_id", "entity").distinct(), ["model_id", "entity"], "left_anti").select("model_id", "entity", "n")
    out = models.where("parent is null").select("model_id", "entity_kind", "warmup").join(sound, "model_id", "left")
    reason = F.when(F.col("n").isNull(), "no_artifact").when(F.col("n") < F.col("warmup"), F.concat(F.lit("warmup incomplete: "), F.col("n").cast("string"), F.lit("/"), F.col("warmup").cast("string")))
    return out.select("model_id", "entity_kind", "entity", F.coalesce("n", F.lit(0)).alias("observations"), reason.isNull().alias("ready"), reason.alias("reason"))


def incompatible(states: DataFrame, models: DataFrame) -> DataFrame:
    """``model_id, entity, rule`` of states whose metadata disagree with the registry or with themselves.

    ``states(model_id, entity, n, feature_schema, parameters)``, and where they have them ``entity_kind``,
    ``seed`` (42 for all models) and ``hashes``, the training digests: unique, of 64 hex digits, ``n`` of them.
    """
    both = states.alias("s").join(F.broadcast(models.alias("r")), "model_id", "left")
    rules = [
        F.when(F.col("r.warmup").isNull(), F.lit("unknown_model")),
        F.when(F.col("r.parent").isNotNull(), F.lit("not_a_parent")),
        F.when(F.coalesce(F.col("s.entity"), F.lit("")) == "", F.lit("entity")),
        F.when(F.col("s.feature_schema") != F.col("r.feature_schema"), F.lit("feature_schema")),
        F.when(F.col("s.parameters") != F.col("r.parameters"), F.lit("parameters")),
        F.when(F.col("s.n") < 0, F.lit("count")),
    ]
    if "entity_kind" in states.columns:
        rules.append(F.when(F.col("s.entity_kind") != F.col("r.entity_kind"), F.lit("entity_kind")))
    if "seed" in states.columns:
        rules.append(F.when(~F.col("s.seed").eqNullSafe(F.lit(SEED)), F.lit("seed")))
    if "hashes" in states.columns:
        held = F.coalesce("s.hashes", F.array().cast("array<string>"))
        rules += [
            F.when(F.size(F.array_distinct(held)) != F.size(held), F.lit("repeated_hash")),
            F.when(F.exists(held, lambda h: ~F.coalesce(h.rlike("^[0-9a-f]{64}$"), F.lit(False))), F.lit("bad_hash")),
            F.when(~F.col("s.n").eqNullSafe(F.size(held).cast("bigint")), F.lit("hash_count")),
        ]
    return both.select("model_id", "entity", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("rule"))


def frozen_scores(sessions: DataFrame, states: DataFrame, raw: DataFrame, models: DataFrame) -> DataFrame:
    """M8: one row per session and model with a score or the reason of its absence.

    ``sessions(session_id, user, src_ip, host)``, ``states(model_id, entity, n)``,
    ``raw(session_id, model_id, raw_score)``. The registry is a constant of a few rows and is broadcast.
    """
    wide = sessions.crossJoin(F.broadcast(models.where("parent is null").select("model_id", "entity_kind", "warmup")))
    entity = F.when(F.col("entity_kind") == "user", F.col("user")).when(F.col("entity_kind") == "src_ip", F.col("src_ip")).otherwise(F.col("host"))
    wide = wide.withColumn("entity", entity).join(states.select("model_id", "entity", "n"), ["model_id", "entity"], "left").join(raw, ["session_id", "model_id"], "left")
    reason = (
        F.when(F.col("entity").isNull(), "identity_missing").when(F.col("n").isNull(), "no_artifact")
        .when(F.col("n") < F.col("warmup"), "warmup_incomplete").when(F.col("raw_score").isNull() | F.isnan("raw_score"), "no_score")
    )
    return wide.select("session_id", "model_id", "entity", reason.alias("reason")).withColumn("ready", F.col("reason").isNull()).join(raw, ["session_id", "model_id"], "left").withColumn("raw_score", F.when(F.col("ready"), F.col("raw_score")))


def candidates(scores: DataFrame) -> DataFrame:
    """M9: by session the largest ready score, null if there is none, with all scores as the explanation."""
    explained = F.array_sort(F.collect_list(F.struct("model_id", "raw_score", "reason")))
    return scores.groupBy("session_id").agg(F.max("raw_score").alias("score"), F.count_if("ready").alias("ready_models"), explained.alias("explanation"))


def calibrate_budget(scores: DataFrame, k: int) -> DataFrame:
    """floor = the score at rank min(k, n) of held-out normals by (score desc, ref asc)."""
    top = scores.where("normal and raw_score is not null and not isnan(raw_score)").orderBy(F.desc("raw_score"), "ref").limit(k)
    return top.agg(F.min("raw_score").alias("floor"), F.lit(k).alias("max_alerts"))


def select_alerts(scores: DataFrame, floor: float, k: int) -> DataFrame:
    """Scores of at least the floor, the k best by (score desc, ref asc)."""
    return scores.where(F.col("raw_score") >= floor).orderBy(F.desc("raw_score"), "ref").limit(k)


def half_space_splits(size: int, trees: int, height: int, seed: int):
    """M3: feature and cut of every inner node of seeded trees over the unit cube, each cut away from its cell's borders."""
    rng = np.random.default_rng(seed)
    nodes = 2**height - 1
    feature, cut = rng.integers(0, size, (trees, nodes)), np.empty((trees, nodes))
    for t in range(trees):
        low, high = np.zeros((nodes, size)), np.ones((nodes, size))
        for n in range(nodes):
            f = feature[t, n]
            span = high[n, f] - low[n, f]
            cut[t, n] = low[n, f] + span * (0.15 + 0.7 * rng.random())
            for child, bound in ((2 * n + 1, high), (2 * n + 2, low)):
                if child < nodes:
                    low[child], high[child] = low[n], high[n]
                    bound[child, f] = cut[t, n]
    return feature, cut


def _paths(x, feature, cut, height: int):
    """Nodes of every row and tree from the root to a leaf: rows x trees x (height + 1)."""
    at = np.zeros((len(x), len(feature)), int)
    out, tree, row = [at], np.arange(len(feature)), np.arange(len(x))[:, None]
    for _ in range(height):
        at = 2 * at + 1 + (x[row, feature[tree, at]] >= cut[tree, at])
        out.append(at)
    return np.stack(out, axis=2)


def _scaled(x, low, high):
    with np.errstate(all="ignore"):
        return np.where(high > low, (x - low) / (high - low), 0.0)


def _window_scores(before, low0, high0, x, low1, high1, feature, cut, height: int, window: int):
    """Scores of the rows ``x`` of a window by the masses of the whole window ``before`` it."""
    lows, highs = (f.accumulate(np.vstack([e[None], before])) for f, e in ((np.fmin, low0), (np.fmax, high0)))
    paths = _paths(_scaled(before, lows[1:], highs[1:]), feature, cut, height)
    mass = np.zeros((len(feature), 2 ** (height + 1) - 1))
    np.add.at(mass, (np.arange(len(feature))[None, :, None], paths), 1)
    lows, highs = (f.accumulate(np.vstack([e[None], x])) for f, e in ((np.fmin, low1), (np.fmax, high1)))
    paths = _paths(_scaled(x, lows[:-1], highs[:-1]), feature, cut, height)
    held = mass[np.arange(len(feature))[None, :, None], paths]
    # A tree adds the masses along the path, up to the first that is under a tenth of the window.
    goes_on = np.cumprod(held >= 0.1 * window, axis=2)
    goes_on = np.concatenate([np.ones_like(goes_on[:, :, :1]), goes_on[:, :, :-1]], axis=2)
    total = (held * goes_on * 2.0 ** np.arange(height + 1)).sum(axis=(1, 2))
    return 1 - total / (len(feature) * window * (2 ** (height + 1) - 1))


def half_space_trees(obs: DataFrame, trees: int = 10, height: int = 8, window: int = 250, seed: int = 42, keep_time: bool = False) -> DataFrame:
    """M3: prequential scores of ``obs(entity, id, at, vector)`` by streaming half-space trees; 0 in an entity's first window.

    A row is scored by the node masses that the whole window before its own left, on vectors scaled by the
    extremes of the entity's earlier rows; a window learns on vectors scaled by the extremes up to each row.
    Both follow from the rows of two windows and the extremes before them, so an entity of any length is
    dealt over tasks by windows: each row goes to its own window and to the next, and a task holds two.
    ``keep_time`` gives ``at`` too.
    """
    size = obs.select(F.max(F.size("vector"))).first()[0] or 1
    feature, cut = half_space_splits(size, trees, height, seed)
    rows = materialize(numbered(obs.select("entity", "id", "at", "vector"), ["entity"], ["at", "id"], "place").withColumn("win", F.floor(F.col("place") / window)), "windows")
    ends = rows.groupBy("entity", "win").agg(*(f(F.col("vector")[i]).alias(f"{n}{i}") for n, f in (("l", F.min), ("h", F.max)) for i in range(size)))
    w = Window.partitionBy("entity").orderBy("win").rowsBetween(Window.unboundedPreceding, -1)
    side = lambda n, f, none: F.array(*(F.coalesce(f(f"{n}{i}").over(w), F.lit(none)) for i in range(size)))
    ends = ends.select("entity", "win", side("l", F.min, float("inf")).alias("low"), side("h", F.max, float("-inf")).alias("high"))
    ends = ends.select(F.col("entity").alias("_e"), F.col("win").alias("_w"), "low", "high")
    both = rows.join(ends, F.expr("entity <=> _e and win = _w")).select("entity", "id", "at", "place", "vector", "low", "high", F.explode(F.array(F.struct(F.col("win").alias("g"), F.lit(1).alias("own")), F.struct((F.col("win") + 1).alias("g"), F.lit(0).alias("own")))).alias("r"))
    both = both.select("entity", "id", "at", "place", "vector", "low", "high", "r.*").repartition("entity", "g").sortWithinPartitions("entity", "g", "own", "place")
    kept = ["entity", "id", *(["at"] if keep_time else [])]
    names = [*kept, "g", "own", "vector", "low", "high"]

    def run(batches):
        left = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if left is None else pa.concat_tables([left, table])
            left = yield from score(table, False)
        if left is not None:
            yield from score(left, True)

    def score(table, last):
        """Scores all groups but the one that may go on, which is returned."""
        if not table.num_rows:
            return None
        key = table.column("entity").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(), table.column("g").to_numpy()
        starts = np.flatnonzero(np.r_[True, (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])])
        stops = np.r_[starts[1:], table.num_rows]
        for a, b in list(zip(starts, stops))[: None if last else -1]:
            own = table.column("own").slice(a, b - a).to_numpy()
            cut_at = int((own == 0).sum())
            n = b - a - cut_at
            if not n:
                continue
            part = table.slice(a, b - a)
            if key[1][a] == 0 or not cut_at:
                found = np.zeros(n)
            else:
                x, low, high = (np.asarray(part.column(c).combine_chunks().flatten(), float).reshape(b - a, -1) for c in ("vector", "low", "high"))
                found = _window_scores(x[:cut_at], low[0], high[0], x[cut_at:], low[cut_at], high[cut_at], feature, cut, height, window)
            mine = part.slice(cut_at)
            yield from pa.table({c: mine.column(c) for c in kept} | {"score": pa.array(found)}).combine_chunks().to_batches()
        return None if last else table.slice(starts[-1])

    kinds = dict(obs.dtypes)
    return both.select(*names).mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in kept), "score double"]))


class Adwin:
    """Adaptive windowing: exponential histogram of a stream, cut where two parts differ in mean."""

    def __init__(self, delta=0.002, clock=32, max_buckets=5, min_window=5, grace=10):
        self.delta, self.clock, self.most, self.least, self.grace = delta, clock, max_buckets, min_window, grace
        self.rows: list[list[tuple[float, float]]] = [[]]
        self.n = self.total = self.spread = 0.0
        self.ticks = 0

    def update(self, x: float) -> bool:
        import math

        self.ticks += 1
        if self.n:
            self.spread += (x - self.total / self.n) ** 2 * self.n / (self.n + 1)
        self.n, self.total = self.n + 1, self.total + x
        self.rows[0].append((x, 0.0))
        for i, row in enumerate(self.rows):
            if len(row) <= self.most:
                break
            if i + 1 == len(self.rows):
                self.rows.append([])
            (a, va), (b, vb), size = row.pop(0), row.pop(0), 2**i
            self.rows[i + 1].append((a + b, va + vb + (a / size - b / size) ** 2 * size / 2))
        if self.ticks % self.clock or self.n <= self.grace:
            return False
        cut, found = True, False
        while cut and self.n > self.grace:
            cut, n0, t0 = False, 0.0, 0.0
            for i in range(len(self.rows) - 1, -1, -1):
                for total, _ in self.rows[i]:
                    n0, t0 = n0 + 2**i, t0 + total
                    n1 = self.n - n0
                    if n0 < self.least or n1 < self.least:
                        continue
                    dd, m = math.log(2 * math.log(self.n) / self.delta), 1 / (n0 - self.least + 1) + 1 / (n1 - self.least + 1)
                    bound = math.sqrt(2 * m * self.spread / self.n * dd) + 2 / 3 * dd * m
                    if abs(t0 / n0 - (self.total - t0) / n1) > bound:
                        cut = found = True
                        break
                if cut:
                    break
            if cut:
                i = max(j for j, row in enumerate(self.rows) if row)
                total, var = self.rows[i].pop(0)
                size = 2**i
                rest = self.n - size
                self.spread = max(0.0, self.spread - var - size * rest / self.n * (total / size - (self.total - total) / rest) ** 2)
                self.n, self.total = rest, self.total - total
        return found


def detections(scores: DataFrame) -> DataFrame:
    """Detections of each (model, entity) in its ordered series ``scores(model_id, entity, at, id, score)``.

    A row for every drift, with its ``place`` from 0, and one row that ends a series, with its
    ``observations`` and ``drifts`` and the place of the last one. Null and NaN scores are passed over.
    The detector is sequential: a task reads its series sorted and carries one detector, whose state grows
    with the logarithm of the series, so a series of any length passes in bounded memory.
    """

    def run(batches):
        series = detector = None
        place = count = 0
        last = None
        for batch in batches:
            out = []
            for model, entity, x in zip(*(batch.column(c).to_pylist() for c in ("model_id", "entity", "score"))):
                if (model, entity) != series:
                    if series is not None:
                        out.append((*series, last, place, count))
                    series, detector, place, count, last = (model, entity), Adwin(), 0, 0, None
                if x is not None and x == x and detector.update(x):
                    out.append((model, entity, place, None, None))
                    count, last = count + 1, place
                place += 1
            if out:
                yield _detected(out)
        if series is not None:
            yield _detected([(*series, last, place, count)])

    ordered = scores.select("model_id", "entity", "at", "id", F.col("score").cast("double")).repartition("model_id", "entity").sortWithinPartitions("model_id", "entity", "at", "id")
    return ordered.select("model_id", "entity", "score").mapInArrow(run, "model_id string, entity string, place bigint, observations bigint, drifts bigint")


def _detected(rows: list) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["model_id", "entity", "place", "observations", "drifts"])


def drift(scores: DataFrame) -> DataFrame:
    """One row per series with its observations, drifts and the place of the last one."""
    return detections(scores).where("observations is not null").select("model_id", "entity", "observations", "drifts", F.col("place").alias("last"))
