"""Readers and writers: raw logs with line numbers, manifests, labels, events, sidecars."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from siftlog.schemas import EVENT_SCHEMA, SESSION_SCHEMA
from siftlog.scratch import materialize, release


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of the files under ``path`` with its number from 1: ``source, line_no, raw_line``.

    Rows of a file block are consecutive in their partition, so a line's place in its block is its running
    id less the smallest of the block; blocks before it in the file add their line counts, one row each.
    """
    raw = spark.read.text(path).select(F.col("value").alias("raw_line"), F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = raw.groupBy("source", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    w = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")
    return raw.join(blocks, ["source", "block"]).select("source", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line_no"), "raw_line")


def load_logs(spark: SparkSession, path: str, default_year: int | None = None, zone: str | None = None, dst_fold: int | None = None, source: str | None = None) -> DataFrame:
    """The lines under ``path`` as ``parse.parse_lines`` takes them, with a source tag and the profile of their stamps.

    Without a tag the source is the file; a tag is for one file, as lines are numbered by file.
    """
    lines = read_lines(spark, path)
    if source is not None:
        lines = lines.withColumn("source", F.lit(source))
    return lines.withColumns({"default_year": F.lit(default_year).cast("int"), "zone": F.lit(zone).cast("string"), "dst_fold": F.lit(dst_fold).cast("int")})


#: Files that the text reader would unpack.
PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst|xz)$"


def file_digests(spark: SparkSession, path: str, glob: str = "*", chunk: int = 256 << 20) -> DataFrame:
    """``path, size, sha256, lines`` of every file under ``path``, of any size.

    A task reads whole files as lines that end at line feeds, which keeps every byte, and carries digest and
    count over its batches: a file is never one value. Files over ``chunk`` bytes are copied as pieces by
    ranges of so many bytes, and each range is digested by a task of its own, which goes on from the state
    of the one before. ``lines`` are what ``str.splitlines`` gives for the text read as UTF-8. Packed files,
    which the line reader would unpack, are read as one value each (2 GB).
    """
    reader = lambda: spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    path_, size = F.col("_metadata.file_path"), F.col("_metadata.file_size")
    listed = reader().format("binaryFile").load(path).select(path_.alias("path"), size.alias("size"))
    text = reader().option("lineSep", "\n").text(path).where(~path_.rlike(PACKED))
    columns = path_.alias("path"), size.alias("size"), F.col("value").cast("binary").alias("value")
    digests = materialize(text.where(size <= chunk).select(*columns).mapInArrow(_digest, DIGEST), "digests", WHOLE_FILES)
    if listed.where((F.col("size") > chunk) & ~F.col("path").rlike(PACKED)).limit(1).count():
        blocks = text.where(size > chunk).select(*columns, F.col("_metadata.file_block_start").alias("block"))
        digests = digests.unionByName(_long_digests(blocks, chunk))
    packed = reader().format("binaryFile").load(path).where(path_.rlike(PACKED)).select(path_.alias("path"), F.sha2("content", 256).alias("sha256"), F.lit(None).cast("bigint").alias("lines"))
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return listed.join(digests.unionByName(packed), "path", "left").select("path", "size", F.coalesce("sha256", empty).alias("sha256"), F.when(F.col("path").rlike(PACKED), F.col("lines")).otherwise(F.coalesce("lines", F.lit(0))).alias("lines"))


DIGEST = "path string, sha256 string, lines bigint"
#: Each file is one partition: opening a file counts as more than any file holds.
WHOLE_FILES = {"spark.sql.files.maxPartitionBytes": str(2**61), "spark.sql.files.openCostInBytes": str(2**61)}


def _digest(batches):
    from hashlib import sha256

    import pyarrow as pa

    file = state = None
    seen = size = lines = 0

    def done():
        if seen < size:  # the file ends with a line feed
            state.update(b"\n")
        return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([state.hexdigest()]), pa.array([lines])], names=["path", "sha256", "lines"])

    for batch in batches:
        for path, n, value in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist(), batch.column("value").to_pylist()):
            if path != file:
                if file is not None:
                    yield done()
                file, state, seen, size, lines = path, sha256(), 0, n, 0
            else:
                state.update(b"\n")
                seen += 1
            state.update(value)
            seen += len(value)
            lines += len((value.decode("utf-8", "replace") + "\n").splitlines())
    if file is not None:
        yield done()


def _long_digests(blocks: DataFrame, chunk: int) -> DataFrame:
    """``path, sha256, lines`` of the files of ``blocks(path, size, value, block)``, whose tasks read ``chunk`` bytes each.

    The lines of a range become pieces in a file of their own, in order. Each round digests the next range of every file.
    """
    spark = blocks.sparkSession
    # a range is a partition: opening a file counts as much as a range
    ranges = {"spark.sql.files.maxPartitionBytes": str(chunk), "spark.sql.files.openCostInBytes": str(chunk), "spark.sql.files.maxRecordsPerFile": "0"}
    pieces = materialize(blocks.mapInArrow(_pieces, "path string, size bigint, block bigint, lines bigint, piece binary"), "pieces", ranges)
    parts = pieces.groupBy("path", "block").agg(F.min("_metadata.file_path").alias("file"))
    place = F.row_number().over(Window.partitionBy("path").orderBy("block"))
    rounds: dict[int, list[str]] = {}
    for row in parts.select(place.alias("round"), "file").collect():  # a row per range
        rounds.setdefault(row["round"], []).append(row["file"])
    states, done = None, [pieces]
    for r in sorted(rounds):
        rows = spark.read.schema(pieces.schema).parquet(*rounds[r])
        rows = rows.withColumn("state", F.lit(None).cast("binary")) if states is None else rows.join(F.broadcast(states.select("path", "state")), "path", "left")
        now = rows.select("path", "size", "piece", "state").mapInArrow(_resume, "path string, state binary, sha256 string")
        states = materialize(now, "states", WHOLE_FILES)
        done.append(states)
    ended = done[1].select("path", "sha256")
    for states in done[2:]:
        ended = ended.unionByName(states.select("path", "sha256"))
    lines = pieces.groupBy("path").agg(F.sum("lines").alias("lines"))
    out = materialize(ended.where("sha256 is not null").join(lines, "path").select("path", "sha256", "lines"), "digests")
    release(*done)
    return out


def _pieces(batches):
    """The lines of a batch as one piece with their line feeds; the last one of a file may have one too many."""
    import pyarrow as pa

    for batch in batches:
        if len(batch):
            piece = b"\n".join(batch.column("value").to_pylist()) + b"\n"
            lines = len(piece.decode("utf-8", "replace").splitlines())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(0, 1) for c in ("path", "size", "block")), pa.array([lines]), pa.array([piece], pa.binary())], names=["path", "size", "block", "lines", "piece"])


def _resume(batches):
    """The state of the digest after the pieces of a range, and the digest itself at the end of the file."""
    import pyarrow as pa

    path = state = size = None
    for batch in batches:
        for path, size, piece, before in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "piece", "state"))):
            state = state or Sha256(before)
            state.update(piece[: size - state.size()])
    if state:
        ended = state.size() == size
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([state.dump()], pa.binary()), pa.array([state.hexdigest() if ended else None], pa.string())], names=["path", "state", "sha256"])


class Sha256:
    """SHA-256 whose state is bytes that another process can go on from, as ``hashlib`` gives none.

    By the SHA256 functions of the OpenSSL library that ``hashlib`` is linked to; its state is a plain structure.
    """

    STATE = 112

    def __init__(self, state: bytes | None = None):
        import _hashlib
        import ctypes

        self.lib = ctypes.CDLL(_hashlib.__file__)
        self.lib.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
        self.state = ctypes.create_string_buffer(state or b"", self.STATE)
        if state is None:
            self.lib.SHA256_Init(self.state)

    def update(self, data: bytes) -> None:
        self.lib.SHA256_Update(self.state, data, len(data))

    def size(self) -> int:
        """Bytes so far: the structure counts bits in two words behind eight words of the digest."""
        return int.from_bytes(self.state.raw[32:40], sys.byteorder) // 8

    def dump(self) -> bytes:
        return self.state.raw

    def hexdigest(self) -> str:
        import ctypes

        out, copy = ctypes.create_string_buffer(32), ctypes.create_string_buffer(self.state.raw, self.STATE)
        self.lib.SHA256_Final(out, copy)
        return out.raw.hex()


def role_of(path: str = "path"):
    """S3: annotation, log or metadata by path."""
    p = F.lower(path)
    return F.when(p.rlike("label|annotation|ground.?truth"), "annotation").when(p.rlike(r"\.log|/logs?/|auth"), "log").otherwise("metadata")


def manifest(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Path, size, SHA-256 and role of every file under ``root`` that matches ``glob``."""
    return file_digests(spark, root, glob).select("path", "size", "sha256", role_of().alias("role"))


def conflicts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths of ``new`` that ``old`` has with another digest."""
    return new.alias("n").join(old.alias("o"), "path").where("n.sha256 <> o.sha256").select("path", F.col("o.sha256").alias("old_sha256"), F.col("n.sha256").alias("new_sha256"))


def fresh(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` that ``old`` has not; equal ones are no change."""
    return new.join(old, "path", "left_anti")


def dataset_summary(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """By dataset the recorded files, those verified, their bytes, annotations and status."""
    both = recorded.alias("r").join(found.select("path", F.col("sha256").alias("now")).alias("f"), "path", "left")
    fine = F.col("now").eqNullSafe(F.col("sha256"))
    out = both.groupBy("dataset_id").agg(F.count("*").alias("files"), F.count_if(fine).alias("verified"), F.sum(F.when(fine, F.col("size")).otherwise(0)).alias("bytes"), F.count_if(F.col("role") == "annotation").alias("annotations"))
    return out.withColumn("status", F.when(F.col("verified") == F.col("files"), "available").when(F.col("verified") > 0, "incomplete").otherwise("not_imported"))


def with_profile(files: DataFrame, profiles: DataFrame) -> DataFrame:
    """Year, zone, fold and coverage of each source; one row of profiles per source."""
    return files.join(profiles, "source", "left")


def start_year(text: str = "text"):
    """The year after ``start:`` in a metadata text."""
    return F.nullif(F.regexp_extract(text, r"(?m)^start:\s*['\"]?(\d{4})-", 1), F.lit("")).cast("int")


def read_labels_csv(spark: SparkSession, path: str) -> DataFrame:
    """Labels from CSV, columns by name; true values are 1, true and yes; technique ids are a comma list.

    ``ValueError`` names the required columns that the header lacks; the family and the ids may be absent.
    """
    raw = spark.read.option("header", True).csv(path)
    missing = [c for c in ("source", "line_no", "attack") if c not in raw.columns]
    if missing:
        raise ValueError(f"label file lacks the columns {', '.join(missing)}")
    raw = raw.withColumns({c: F.lit(None).cast("string") for c in ("attack_family", "technique_ids") if c not in raw.columns})
    raw = raw.withColumn("line_no", F.expr("try_cast(line_no as bigint)"))
    ids = F.filter(F.transform(F.split(F.coalesce("technique_ids", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return raw.select(F.element_at(F.split("source", "/"), -1).alias("source"), "line_no", F.lower(F.trim("attack")).isin("1", "true", "yes").alias("attack"), F.nullif(F.trim("attack_family"), F.lit("")).alias("attack_family"), ids.alias("technique_ids"))


def read_labels_json(spark: SparkSession, path: str) -> DataFrame:
    """Labels from JSON lines ``{"line", "labels"}``; an attack has labels. Bad rows: see ``bad_labels``."""
    raw = spark.read.schema("line bigint, labels array<string>").json(path)
    return raw.select(F.col("line").alias("line_no"), (F.size("labels") > 0).alias("attack"), F.nullif(F.array_join("labels", ","), F.lit("")).alias("attack_family"))


def bad_labels(labels: DataFrame) -> DataFrame:
    """Line numbers that are null, under one, or repeated."""
    return labels.groupBy("line_no").agg(F.count("*").alias("n")).where("line_no is null or line_no < 1 or n > 1")


def attack_runs(paths: DataFrame) -> DataFrame:
    """Technique, step, sequence and host from the path of every ``auth.log``, and its sibling logs."""
    parts = F.split("path", "/")
    after = lambda name: F.try_element_at(parts, F.nullif(F.array_position(parts, name), F.lit(0)).cast("int") + 1)
    out = paths.withColumns({"folder": F.regexp_replace("path", "/[^/]*$", ""), "name": F.element_at(parts, -1)})
    logs = out.groupBy("folder").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "path")))).alias("related"))
    runs = out.where("name = 'auth.log'").join(logs, "folder")
    return runs.select("path", after("techniques").alias("technique"), after("steps").alias("step"), after("sequences").alias("sequence"), F.try_element_at(parts, F.lit(-2)).alias("host"), F.map_filter("related", lambda k, v: k != "auth.log").alias("related"))


def auth_runs(table: DataFrame) -> DataFrame:
    """Rows of a catalogue whose data source mentions auth."""
    return table.where(F.lower("data_source").contains("auth"))


def write_events(events: DataFrame, path: str) -> None:
    """Parquet with the fixed schema, also when empty."""
    events.select(*(F.col(c.split()[0]).cast(c.split(None, 1)[1]) for c in EVENT_SCHEMA.split(", "))).write.parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).parquet(path)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SESSION_SCHEMA).parquet(path)


#: Timestamps keep their microseconds in JSON.
JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def to_json(events: DataFrame) -> DataFrame:
    """One JSON text per row."""
    return events.select(F.to_json(F.struct("*"), JSON_TIMES).alias("value"))


def from_json(lines: DataFrame, schema: str = EVENT_SCHEMA) -> DataFrame:
    return lines.select(F.from_json("value", schema, JSON_TIMES).alias("e")).select("e.*")


def import_sources(stored: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new sources, collisions) of ``(dataset_id, path, sha256)``; an equal row is skipped."""
    known = stored.select("dataset_id", "path", F.col("sha256").alias("held"))
    both = incoming.join(known, ["dataset_id", "path"], "left")
    return both.where("held is null").drop("held"), both.where("held <> sha256")


def strangers(members: DataFrame, events: DataFrame) -> DataFrame:
    """Event ids that sessions or unmatched events name but the source doesn't have."""
    return members.select("event_id").distinct().join(events.select("event_id"), "event_id", "left_anti")


def read_traces(spark: SparkSession, labels: str, traces: str) -> DataFrame:
    """Block labels and event lists from CSV; ``[E1,E2]`` becomes an array."""
    a = spark.read.option("header", True).schema("BlockId string, Label string").csv(labels)
    b = spark.read.option("header", True).schema("BlockId string, Label string, Type string, Features string, TimeInterval string, Latency string").csv(traces)
    events = F.transform(F.split(F.expr("substring(Features, 2, length(Features) - 2)"), ","), lambda x: F.trim(x))
    return b.select(F.col("BlockId").alias("block"), events.alias("events")).join(a.select(F.col("BlockId").alias("block"), (F.col("Label") == "Anomaly").alias("anomaly")), "block", "left")


def bad_blocks(traces: DataFrame) -> DataFrame:
    """Block ids of a wrong form, without a label, or repeated."""
    return traces.groupBy("block").agg(F.count("*").alias("n"), F.count("anomaly").alias("labelled")).where(r"not block rlike '^blk_-?[0-9]+$' or n > 1 or labelled = 0")


def read_stix(spark: SparkSession, path: str) -> DataFrame:
    """Objects of an attack bundle, one row each."""
    schema = "objects array<struct<type string, id string, name string, description string, revoked boolean, x_mitre_deprecated boolean, external_references array<struct<source_name string, external_id string, url string>>, kill_chain_phases array<struct<kill_chain_name string, phase_name string>>, x_mitre_platforms array<string>, x_mitre_data_sources array<string>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("objects").alias("o")).select("o.*")


def write_once(result: DataFrame, root: str) -> str:
    """Write to a folder named by the content's digest; a second write of the same result is refused."""
    digest = result.agg(F.sha2(F.concat_ws(",", F.count("*"), F.sum(F.xxhash64("*").cast("decimal(38,0)"))), 256)).first()[0]
    path = f"{root.rstrip('/')}/{digest[:20]}"
    result.write.mode("errorifexists").parquet(path)
    return path


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, n`` of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def write_sidecar(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.write.mode("errorifexists").json(path)


def read_sidecar(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
