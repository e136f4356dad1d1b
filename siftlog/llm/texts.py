"""Texts of a table inside tasks, a bounded slice at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_BYTES = 1_000_000


def give_back() -> None:
    """Return freed memory of this Python worker to the system, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice have about ``SLICE_BYTES`` bytes, or are one text; afterwards ``give_back``."""
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and total + n > SLICE_BYTES:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield batch.slice(at)
    give_back()


def map_texts(docs: DataFrame, make: Callable[[list, list], list[list]], schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One output row per row: ``make(keys, texts)`` returns the columns after the key. Null texts arrive as ''."""
    head = f"{key} {docs.schema[key].dataType.simpleString()}"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                texts = [x or "" for x in part.column(text).to_pylist()]
                columns = make(part.column(key).to_pylist(), texts)
                yield pa.RecordBatch.from_arrays([part.column(key), *map(_array, columns)], names=[key, *names])

    return docs.select(key, text).mapInArrow(run, f"{head}, {schema}")


def filter_texts(docs: DataFrame, keep: Callable[[list[str]], list[bool]], text: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text ``keep`` accepts, with all their columns, in one pass. Null texts arrive as ''."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                yield part.filter(pa.array(keep([x or "" for x in part.column(text).to_pylist()]), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _array(values):
    return values if isinstance(values, pa.Array) else pa.array(values)
