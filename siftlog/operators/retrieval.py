"""Reference corpus and BM25 retrieval for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftlog.scratch import materialize, release

# Stop words, BM25 parameters, data sources that make a technique relevant.
STOP = "a an and are as at be by for from has in is it its of on or that the this to was were with".split()
K1, B = 1.5, 0.75
#: Levels of a term's postings by share, and what rounding to six digits can add to a score.
LEVELS, SLACK = 8, 1e-6
#: Bytes of texts for each shuffle partition, and of a table that one task reads.
SHARE_BYTES, READ_BYTES = 4 << 20, 8 << 20
AUTH_DATA_SOURCES = ("Logon Session", "User Account", "Active Directory")


def tokenize(text: str) -> Column:
    """K1: lower-case words of two characters or more that aren't stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9][a-z0-9_.\-]*)"), 1)
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP))


def postings(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """K2: (term frequencies, document lengths, document frequencies) of ``docs(document_id, text)``."""
    words = docs.select("document_id", tokenize("text").alias("w"))
    tf = words.select("document_id", F.explode("w").alias("term")).groupBy("document_id", "term").agg(F.count("*").alias("tf"))
    return tf, words.select("document_id", F.size("w").alias("length")), tf.groupBy("term").agg(F.count("*").alias("df"))


def bounded_tasks(docs: DataFrame) -> dict[str, str]:
    """Settings under which the share of ``docs`` that a task aggregates stays the same however large ``docs`` is.

    Partitions follow the size that Spark knows of the files (others keep the session's number); row groups of what is
    written are small, as a task reads whole ones. Adaptive execution still joins small partitions.
    """
    size, own = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(own, size // SHARE_BYTES) if size < 1 << 50 else own
    return {"spark.sql.shuffle.partitions": str(parts), "spark.sql.files.maxPartitionBytes": str(READ_BYTES), "parquet.block.size": str(READ_BYTES)}


def _impacts(terms: DataFrame, docs: DataFrame, bounded: dict[str, str] | None = None) -> DataFrame:
    """``term, level, document_id, share`` of the postings of the asked terms, levels by share from 1 to ``LEVELS``.

    Words meet the distinct query terms before their first shuffle. An empty term stands for the document itself, so that
    one pass over the texts gives postings, the number of documents and their mean length.
    """
    asked = terms.select("term").distinct().unionByName(terms.sparkSession.createDataFrame([("",)], "term string"))
    words = docs.where("document_id is not null").select("document_id", tokenize("text").alias("w"))
    words = words.select("document_id", F.size("w").alias("length"), F.explode(F.concat(F.coalesce("w", F.array().cast("array<string>")), F.array(F.lit("")))).alias("term"))
    held = materialize(words.join(asked, "term", "left_semi").groupBy("document_id", "length", "term").agg(F.count("*").alias("tf")), "postings", bounded)
    stats = held.where("term = ''").agg(F.sum("tf").alias("docs"), F.expr("sum(tf * length) / sum(if(length is null, null, tf))").alias("mean_length"))
    weight = F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length"))
    tf = held.where("term <> ''").crossJoin(F.broadcast(stats)).withColumn("shape", F.col("tf") / weight)
    known = tf.groupBy("term").agg(F.count("*").alias("df"), F.max("shape").alias("top"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    share = F.round(idf * F.col("tf") * (K1 + 1) / weight, 6)
    level = F.greatest(F.lit(1), F.ceil(F.col("shape") / F.col("top") * LEVELS).cast("int"))
    out = materialize(tf.join(known, "term").select("term", level.alias("level"), "document_id", share.alias("share")), "impacts", bounded)
    release(held)
    return out


def _shares(pairs: DataFrame, terms: DataFrame, impacts: DataFrame) -> DataFrame:
    """All shares of ``pairs(query_id, document_id)``, asked by term and document."""
    return pairs.select("query_id", "document_id").join(terms, "query_id").join(impacts.drop("level"), ["term", "document_id"])


def _floors(lists: DataFrame, terms: DataFrame, impacts: DataFrame, k: int, seeds: int) -> DataFrame:
    """``query_id, floor``: a score that ``k`` documents of the query reach, from those that its strongest ``seeds`` postings name."""
    strongest = Window.partitionBy("query_id").orderBy(F.desc("bound"), "term", "level").rowsBetween(Window.unboundedPreceding, -1)
    first = lists.withColumn("before", F.coalesce(F.sum("n").over(strongest), F.lit(0))).where(F.col("before") < seeds)
    named = first.select("query_id", "term", "level").join(impacts, ["term", "level"]).groupBy("query_id", "document_id").agg(F.sum("share").alias("part"))
    best = Window.partitionBy("query_id").orderBy(F.desc("part"), "document_id")
    named = named.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    whole = _shares(named, terms, impacts).groupBy("query_id", "document_id").agg(F.round(F.sum("share"), 6).alias("score"))
    return whole.groupBy("query_id").agg(F.count("*").alias("found"), F.min("score").alias("floor")).where(F.col("found") >= k).select("query_id", "floor")


def essential_levels(lists: DataFrame, floors: DataFrame, skip: float = 1.0) -> DataFrame:
    """The levels of ``lists(query_id, term, level, n, bound)`` that must be read, with ``cut, spare, floor``.

    Of every term the levels up to a cut are skipped, so that the cuts' bounds together (``spare``) stay under the
    share ``skip`` of the query's floor: a document must get the rest from the other levels to reach it. Levels with many postings for
    their bound go first, those of one term from below.
    """
    up = Window.partitionBy("query_id", "term").orderBy("level")
    steps = lists.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    steps = steps.withColumn("cost", F.col("bound") - F.coalesce(F.lag("bound").over(up), F.lit(0.0)))
    steps = steps.withColumn("rate", F.min(F.col("n") / F.greatest(F.col("cost"), F.lit(1e-9))).over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    cheap = Window.partitionBy("query_id").orderBy(F.desc("rate"), "term", "level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumn("skipped", F.sum("cost").over(cheap) < F.col("floor") * skip - SLACK)
    saved = F.sum(F.when(F.col("skipped"), F.col("cost")).otherwise(0.0))
    steps = steps.withColumns({"cut": saved.over(Window.partitionBy("query_id", "term")), "spare": saved.over(Window.partitionBy("query_id"))})
    return steps.where("not skipped").drop("cost", "rate", "skipped")


def bm25(queries: DataFrame, docs: DataFrame, k: int, seeds: int = 1000, skip: float = 0.35) -> DataFrame:
    """K3: the ``k`` best documents of every query of ``queries(query_id, text)`` with their terms' shares.

    A term's share is rounded to six digits; ties by id. Rows without an id are left out, null texts hold
    nothing, and query rows with one id are one query. The strongest postings of a query (``seeds`` for each wanted document) name ``k``
    documents whose scores are a floor; levels of postings whose bounds make up at most the share ``skip`` of
    the floor aren't read, and of the documents in the other levels those that can still reach the
    floor are scored in full. Any ``seeds`` and ``skip`` (0 to 1) give the same rows.
    """
    terms = materialize(queries.where("query_id is not null").select("query_id", F.explode(tokenize("text")).alias("term")).distinct(), "terms")
    bounded = bounded_tasks(docs)
    impacts = _impacts(terms, docs, bounded)
    levels = impacts.groupBy("term", "level").agg(F.count("*").alias("n"), F.max("share").alias("bound"))
    lists = materialize(terms.join(levels, "term"), "lists")
    floors = materialize(_floors(lists, terms, impacts, k, seeds * k), "floors", bounded)
    read = materialize(essential_levels(lists, floors, skip).select("query_id", "term", "level", "cut", "spare", "floor"), "read")
    named = read.join(impacts, ["term", "level"]).groupBy("query_id", "document_id", "spare", "floor").agg(F.sum(F.col("share") - F.col("cut")).alias("over"))
    able = materialize(named.where(F.col("over") + F.col("spare") >= F.col("floor") - SLACK), "able", bounded)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id")
    best = _shares(able, terms, impacts).groupBy("query_id", "document_id").agg(F.round(F.sum("share"), 6).alias("score")).withColumn("rank", F.row_number().over(w))
    best = materialize(best.where(F.col("rank") <= k), "best", bounded)
    release(lists, floors, read, able)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("s"), "term")))
    told = _shares(best, terms, impacts).groupBy("query_id", "document_id").agg(F.transform(listed, lambda x: F.struct(x["term"].alias("term"), (-x["s"]).alias("share"))).alias("terms"))
    return best.join(told, ["query_id", "document_id"]).select("query_id", "document_id", "score", "terms", "rank")


def folder_corpus(files: DataFrame, excluded: DataFrame, per_technique: int = 3, lines: int = 40, chars: int = 4000) -> DataFrame:
    """K4: up to three files of each technique folder, by path, with a snippet of their first lines."""
    name = F.regexp_extract("path", r"/(T\d{4}(?:\.\d{3})?)[^/]*/", 1)
    own = files.withColumn("technique_id", F.nullif(name, F.lit(""))).where("technique_id is not null").join(excluded.select("path"), "path", "left_anti")
    kept = F.slice(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), 1, lines)
    own = own.withColumn("snippet", F.substring(F.array_join(kept, "\n"), 1, chars)).where("snippet <> ''")
    w = Window.partitionBy("technique_id").orderBy("path")
    return own.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_technique).select("technique_id", "path", "snippet", F.sha2("text", 256).alias("sha256"))


def filter_techniques(objects: DataFrame, extra_ids: list[str]) -> DataFrame:
    """K5: live attack patterns with an id and a relevant data source, or an id of ``extra_ids``."""
    ext = F.filter("external_references", lambda r: r["source_name"] == "mitre-attack")
    own = objects.where("type = 'attack-pattern' and not coalesce(revoked, false) and not coalesce(x_mitre_deprecated, false)").withColumn("technique_id", F.try_element_at(ext, F.lit(1))["external_id"])
    relevant = F.exists(F.coalesce("x_mitre_data_sources", F.array().cast("array<string>")), lambda d: F.array_contains(F.array(*(d.startswith(s) for s in AUTH_DATA_SOURCES)), True))
    return own.where(F.col("technique_id").isNotNull() & (relevant | F.col("technique_id").isin(extra_ids)))


def technique_documents(techniques: DataFrame) -> DataFrame:
    """K6: documents with their provenance."""
    tactics = F.transform("kill_chain_phases", lambda p: p["phase_name"])
    text = F.concat_ws(" ", "technique_id", "name", "description", F.array_join(tactics, " "), F.array_join("x_mitre_data_sources", " "))
    return techniques.select(F.concat(F.lit("attack-"), "technique_id").alias("document_id"), F.col("name").alias("title"), F.array("technique_id").alias("technique_ids"), tactics.alias("tactics"), text.alias("indexed_text"), F.struct(F.lit("attack").alias("collection"), F.sha2(text, 256).alias("sha256")).alias("source"))


def held_out_paths(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """K7: source paths of which an item (``path:...``) is in the validation or evaluation split."""
    held = entries.where("split in ('validation', 'evaluation')").select(F.substring_index("item_id", ":", 1).alias("path")).distinct()
    return sources.select("path").join(held, "path", "left_semi").distinct()


def assemble(*collections: DataFrame) -> DataFrame:
    """K8: one corpus; raises on an id that two documents have."""
    out = collections[0]
    for c in collections[1:]:
        out = out.unionByName(c)
    again = out.groupBy("document_id").count().where("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"document id twice: {again[0]['document_id']}")
    return out


def corpus_digest(docs: DataFrame) -> DataFrame:
    """K8: digest of ids and texts, independent of row order."""
    h = F.xxhash64("document_id", "text").cast("decimal(38,0)")
    return docs.agg(F.count("*").alias("documents"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.sum(h).cast("string")), 256).alias("digest"))


def lookup_techniques(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """K9: each technique id with the documents that name it."""
    listed = docs.select("document_id", F.explode("technique_ids").alias("technique_id"))
    return ids.join(listed, "technique_id", "left").groupBy("technique_id").agg(F.array_sort(F.collect_list("document_id")).alias("documents"))
