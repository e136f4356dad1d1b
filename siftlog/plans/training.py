"""M7: the training job, from sessions and their split to scores, model states and readiness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftlog.operators import history, models
from siftlog.scratch import materialize


def train(spark: SparkSession, sessions: DataFrame, events: DataFrame, splits: DataFrame, zone: str = "UTC") -> dict[str, DataFrame]:
    """Train on the sessions that ``splits(session_id, split)`` puts into ``reference``.

    History is taken over all sessions; what is learned comes from the chosen ones only, each content once.
    Returns ``features``, prequential ``scores``, ``states`` with registry metadata, and ``readiness``.
    """
    held = materialize(history.members(sessions, events), "members")
    features = history.features(sessions, events, zone, held).join(history.context(sessions, events, held), "session_id")
    known = sessions.select("session_id", "user", "src_ip", "host", F.col("start_time").alias("at"))
    chosen = splits.where("split = 'reference'").select("session_id")
    once = history.content_hash(sessions, events, held).join(chosen, "session_id").groupBy("content_sha256").agg(F.min("session_id").alias("session_id")).select("session_id")
    table = materialize(known.join(features, "session_id").join(once, "session_id", "left_semi"), "training")
    hours = models.hour_rarity(table.select(F.col("user").alias("entity"), F.col("login_hour_local").alias("hour"), "at", F.col("session_id").alias("id")))
    counts = models.frequency_deviation(table.select(F.col("user").alias("entity"), F.col("auth_frequency_window_count").cast("double").alias("y"), "at", F.col("session_id").alias("id")))
    moves = models.transition_surprise(table.select(F.col("user").alias("entity"), "at", F.col("session_id").alias("id"), F.col("event_types").alias("items")))
    vectors = history.model_inputs(table, "at").where("vector is not null").drop("items").withColumnRenamed("session_id", "id")
    part = lambda df, model: df.select(F.lit(model).alias("model_id"), "entity", "at", "id", "score")
    scores = part(hours, "login_hour_rarity").unionByName(part(counts, "auth_frequency")).unionByName(part(moves, "transition_surprise"))
    for model in ("src_ip_behavior", "host_access"):
        scores = scores.unionByName(part(models.half_space_trees(vectors.where(F.col("model_id") == model).select("entity", "id", "at", "vector"), keep_time=True), model))
    scores = materialize(scores, "scores")
    registry = models.registry(spark)
    states = scores.groupBy("model_id", "entity").agg(F.count("*").alias("n")).join(F.broadcast(registry.select("model_id", "parameters", "feature_schema")), "model_id")
    return {"features": features, "scores": scores, "states": states, "readiness": models.readiness(scores, registry.where("parent is null"))}
