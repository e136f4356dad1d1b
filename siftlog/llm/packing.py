"""Operator 5: mixture-controlled packing by deficit round-robin over source queues.

Every window gives each queue its quantum: the queue's target share of the window's tokens. What a
quantum leaves over as a fraction of a token is the queue's deficit, carried into the next window. As
tokens can be cut anywhere, the counter needs no loop: after ``w`` windows a queue with quantum ``q``
(in 1/65536 token) has given ``min(q * w >> 16, its tokens)``. So each document finds its windows from
its place in its queue alone, in any partition, and the deficits agree across partitions.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from siftlog.llm.bpe import byte_letters, encoder, pattern
from siftlog.llm.texts import slices
from siftlog.scratch import materialize

FIXED = 16
#: Characters of white space in a row beyond which a text doesn't go to the library.
LONG_RUN = 50_000
_blanks = re.compile(r"\s+")
PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, window_id bigint, queue string"


class ByteIds:
    """Ids of a byte-level vocabulary file, whose ids are in the order of its merges, by the tiktoken library."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ", 1) if isinstance(m, str) else m for m in spec["model"]["merges"]]
        order = [vocab[a + b] for a, b in merges]
        if spec.get("normalizer") or order != sorted(order):
            raise ValueError("not a plain byte-level vocabulary with ids in merge order")
        back = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if all(c in back for c in t)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for t in self.special:
            ranks.pop(t.encode(), None)
        self.largest = max([*vocab.values(), *self.special.values()])
        self.encode = tiktoken.Encoding("ids", pat_str=pattern("bytes"), mergeable_ranks=ranks, special_tokens=self.special)

    def __call__(self, text: str) -> list[np.ndarray]:
        """Parts of the ids of ``text``; special strings in it become their id.

        The library's pattern can't step back over very long runs of white space; texts with one go
        through the automaton of the same file.
        """
        if len(text) > LONG_RUN and any(m.end() - m.start() > LONG_RUN for m in _blanks.finditer(text)):
            return [np.array(encoder(self.path).encode(text), np.int64)]
        return [self.encode.encode_to_numpy(text, allowed_special="all")]


@lru_cache(2)
def ids_of(path: str) -> ByteIds:
    return ByteIds(path)


def _tokenized(docs: DataFrame, path: str, end_id: int, queue: str) -> DataFrame:
    """Ids of each document with its place in its partition's stream of its queue."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        e = ids_of(path)
        kind = "<u4" if max(end_id, e.largest) > 65535 else "<u2"
        end, part = np.array([end_id], kind), TaskContext.get().partitionId()
        at: dict[str, int] = {}
        for batch in batches:
            for rows in slices(batch):
                queues = [q or "" for q in rows.column("queue").to_pylist()]
                starts, sizes, ids = [], [], []
                for q, text in zip(queues, rows.column("text").to_pylist()):
                    found = np.concatenate([*e(text or ""), end]).astype(kind)
                    starts.append(at.get(q, 0))
                    sizes.append(len(found))
                    ids.append(found.tobytes())
                    at[q] = starts[-1] + sizes[-1]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(queues), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "queue", "part", "at", "n", "ids"],
                )

    columns = docs.select("doc_id", "text", F.col(queue).cast("string").alias("queue"))
    return columns.mapInArrow(run, f"doc_id {key}, queue string, part int, at bigint, n bigint, ids binary")


class Layout:
    """Where the token at a place of a queue goes; computed from one number per queue."""

    def __init__(self, totals: list[int], shares: list[float], window: int, length: int):
        whole = sum(shares) or 1.0
        self.totals = totals
        self.quanta = [max(1, round(s / whole * window * (1 << FIXED))) for s in shares]
        self.length, self.all = length, sum(totals)
        self.full = self.all // length
        self.tail = []
        at, rest, number = self.full * length, self.all % length, self.full
        while rest:
            size = 1 << (rest.bit_length() - 1)
            self.tail.append((at, at + size, number))
            at, rest, number = at + size, rest - size, number + 1
        self.windows: dict[int, list[int]] = {}

    def given(self, queue: int, windows: int) -> int:
        return min(self.quanta[queue] * windows >> FIXED, self.totals[queue])

    def window_of(self, queue: int, at: int) -> int:
        q = self.quanta[queue]
        return (((at + 1) << FIXED) + q - 1) // q - 1

    def starts(self, w: int) -> list[int]:
        """Place of each queue's share of window ``w`` among all tokens; queues take turns in going first."""
        if w not in self.windows:
            if len(self.windows) > 4096:
                self.windows.clear()
            n = len(self.totals)
            at, out = sum(self.given(j, w) for j in range(n)), [0] * n
            for j in (*range(w % n, n), *range(w % n)):
                out[j] = at
                at += self.given(j, w + 1) - self.given(j, w)
            self.windows[w] = out
        return self.windows[w]

    def sequence(self, at: int) -> tuple[int, int, int]:
        """Of a place among all tokens: sequence, offset there, and where the sequence ends."""
        if at < self.full * self.length:
            number, offset = divmod(at, self.length)
            return number, offset, at - offset + self.length
        a, b, number = next(t for t in self.tail if t[0] <= at < t[1])
        return number, at - a, b

    def pieces(self, queue: int, at: int, n: int):
        """(start in the document, length, sequence, offset, window) of a document at a place of its queue."""
        start = 0
        while start < n:
            w = self.window_of(queue, at + start)
            upto = min(n, self.given(queue, w + 1) - at)
            place = self.starts(w)[queue] + at + start - self.given(queue, w)
            while start < upto:
                number, offset, end = self.sequence(place)
                size = min(upto - start, end - place)
                yield start, size, number, offset, w
                start, place = start + size, place + size


def pack(docs: DataFrame, path: str, end_id: int = 0, length: int = 1024, window_sequences: int = 64, mixture: dict[str, float] | None = None, queue: str = "source", max_queues: int = 1024, broadcast_rows: int = 200_000) -> DataFrame:
    """Pack every document into sequences of ``length`` tokens; one row per piece.

    A document is its ids and then ``end_id``; each id lies in exactly one piece. ``mixture`` maps a queue
    to its target weight (default: its share of all tokens, so that every window mirrors the corpus); a
    queue without a weight takes its share of all tokens. A queue that is empty gives nothing and the
    others go on. Windows of ``window_sequences`` sequences lie end to end and only the very last
    sequence could be short: it is cut into lengths that are powers of two, which need no padding.

    Null texts are empty documents of one id; a null queue is the queue ''. The smallest queues beyond
    ``max_queues`` share one, so that the driver handles a bounded list. Null ids, repeated rows and
    other columns are harmless; an empty table gives no rows. A hot queue is spread over the partitions
    that it came in: its stream runs through them in order.
    """
    table = materialize(_tokenized(docs, path, end_id, queue), "packing")
    sums = table.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    top = sums.groupBy("queue").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "queue").limit(max_queues - 1).collect()
    names = sorted(r["queue"] for r in top)
    size = dict((r["queue"], r["n"]) for r in top)
    of = {q: i for i, q in enumerate(names)}
    spark = docs.sparkSession
    known = spark.createDataFrame([(q, i) for q, i in of.items()] or [("", 0)], "queue string, q int")
    sums = sums.join(F.broadcast(known), "queue", "left").withColumn("q", F.coalesce("q", F.lit(len(names))))
    bases = sums.select("queue", "part", "q", (F.sum("n").over(Window.partitionBy("q").orderBy("part", "queue")) - F.col("n")).alias("base"))
    bases = materialize(bases, "packing-bases")
    if (rows := bases.count()) <= broadcast_rows:
        bases = F.broadcast(bases)
    rest = (table.agg(F.sum("n")).first()[0] or 0) - sum(size.values()) if rows else 0
    totals = [size[q] for q in names] + [rest] * (rest > 0)
    shares = [float(n) for n in totals]
    if mixture:
        total = sum(mixture.values()) or 1.0
        shares = [mixture[q] / total * sum(totals) if q in mixture else float(size[q]) for q in names] + shares[len(names) :]
    key = docs.schema["doc_id"].dataType.simpleString()
    window = window_sequences * length

    def place(batches):
        layout = Layout(totals, shares, window, length)
        for batch in batches:
            columns = {k: batch.column(k).to_pylist() for k in ("queue", "q", "base", "at", "n")}
            ids, rows, out = batch.column("ids"), [], []
            for i, (name, q, base, at, n) in enumerate(zip(*columns.values())):
                raw = ids[i].as_buffer()
                tokens = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                for start, size_, number, offset, w in layout.pieces(q, base + at, n):
                    rows.append(i)
                    out.append((start, size_, zlib.crc32(tokens[start : start + size_].tobytes()), n, number, offset, w, name))
            pieces = [pa.array(c, pa.string() if k == 7 else pa.int64()) for k, c in enumerate(zip(*out))] if out else [pa.array([], pa.string() if k == 7 else pa.int64()) for k in range(8)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), *pieces], names=["doc_id", *[c.split()[0] for c in PIECES.split(", ")]])

    return table.join(bases, ["queue", "part"]).select("doc_id", "queue", "q", "base", "at", "n", "ids").mapInArrow(place, f"doc_id {key}, {PIECES}")
