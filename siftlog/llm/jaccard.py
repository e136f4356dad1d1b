"""Operator 9: exact Jaccard join on word shingles with token-combination prefixes.

A token is a shingle's hash. All tokens have one order: rare before frequent, then by hash. Of a set
with ``n`` tokens a similar one can lack at most ``slack = floor(n * (100 - percent) / 100)``, so sets
that link share one of the first ``slack + 1`` rare tokens of either. If a prefix reaches into the
frequent tokens it is extended by one more, and pairs of frequent tokens are indexed in place of single
ones: with ``r`` rare and ``f`` frequent tokens in it, a similar set that shared no rare token and no
pair would lack at least ``r + f - 1 > slack`` of them. Entries are kept apart by the magnitude of
``n``, as sets that link have nearly one size.

Only links between different components matter for the classes, so copies and near copies are first
joined to a pivot; the index then meets components, not their members. No row is made for a candidate
pair: sets of one index entry meet inside a task, in blocks where they are many, with a sketch of the
parities of their tokens. Where two sketches differ the sets differ, so their distance bounds the
likeness from above, which drops nearly all chance meetings and just-too-different copies. Of what
passes, a task gives a spanning forest of the components, the likeliest pairs first, and only these
are verified on the texts. An entry with a pair that failed is asked again for another one.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from siftlog.llm.shingles import shingles
from siftlog.llm.texts import give_back, slices
from siftlog.operators.graph import connected_components
from siftlog.scratch import materialize, release


#: Tokens kept beyond a prefix: a set with as few frequent tokens need not be read again.
SPARE = 8
#: Bits of a sketch for each token, tokens from which on half as many do, and bits of the largest one: at first, and where a likely pair has failed.
PLAIN, SHARP = (1, 2049, 32768), (8, 1 << 62, 131072)


def _slack(n: int, percent: int) -> int:
    return n - -(-percent * n // 100)


def sketch(tokens: np.ndarray, size: tuple[int, int, int] = PLAIN) -> bytes:
    """Parities of the numbers of tokens by their low bits, in a power of two bits.

    Unlike sets of ``n`` tokens differ in about half the bits, which rules them out if these are more than the
    tokens in which like ones may differ, a ninth of both at 80 percent: half a bit a token is enough for long texts.
    """
    bits = min(size[2], max(64, size[0] << max(0, len(tokens) - 1).bit_length() >> (len(tokens) >= size[1])))
    places = (tokens & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=bits).astype(np.uint8) & 1).tobytes()


class Sketches:
    """Sketches of the rows of a batch, ready to be compared: of two sizes the larger is folded to the smaller."""

    def __init__(self, column: pa.Array):
        raw = column.to_pylist()
        self.size = np.array([len(r) if r else 0 for r in raw], np.int64)
        self.by_size = {}
        for size in np.unique(self.size[self.size > 0]).tolist():
            own, twice = np.flatnonzero(self.size == size), np.flatnonzero(self.size == 2 * size)
            rows = [np.frombuffer(b"".join(raw[i] for i in own.tolist()), np.uint64).reshape(len(own), -1)]
            if len(twice):
                large = np.frombuffer(b"".join(raw[i] for i in twice.tolist()), np.uint64).reshape(len(twice), -1)
                rows.append(large[:, : large.shape[1] // 2] ^ large[:, large.shape[1] // 2 :])
            place = np.full(len(raw), -1)
            place[np.concatenate([own, twice])] = np.arange(len(own) + len(twice))
            self.by_size[size] = np.concatenate(rows), place
        #: All folded to 256 bits, for a first look.
        self.coarse = np.zeros((len(raw), 4), np.uint64)
        for size, (rows, place) in self.by_size.items():
            own = np.flatnonzero(self.size == size)
            if size >= 32:
                self.coarse[own] = np.bitwise_xor.reduce(rows[place[own]].reshape(len(own), -1, 4), axis=1)

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """At most the number of tokens in which the sets of rows ``i`` and ``j`` differ; 0 for very unlike sizes."""
        out, size = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        for s, (rows, place) in self.by_size.items():
            at = np.flatnonzero((size == s) & (place[i] >= 0) & (place[j] >= 0))
            out[at] = np.bitwise_count(rows[place[i[at]]] ^ rows[place[j[at]]]).sum(axis=1)
        return out

    def near(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs may differ in at most ``most`` tokens, and in how many they differ at least."""
        look = np.flatnonzero((self.size[i] < 32) | (self.size[j] < 32) | (np.bitwise_count(self.coarse[i] ^ self.coarse[j]).sum(axis=1) <= most))
        apart = self.differ(i[look], j[look])
        keep = apart <= most[look]
        return look[keep], apart[keep]


def _sets(docs: DataFrame, k: int, percent: int, pivots: int) -> DataFrame:
    """Size, a 128-bit digest of the set, its smallest tokens, its prefix in hash order and its sketch, for each text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                rows = []
                for grams in shingles(part.column("text"), k):
                    s = np.unique(grams)
                    signed = s.view(np.int64)
                    odd = s * np.uint64(0xD6E8FEB86659FD93) ^ (s >> np.uint64(32))
                    a, b = (int(s.sum().view(np.int64)), int(np.bitwise_xor.reduce(odd).view(np.int64))) if len(s) else (0, 0)
                    rows.append((len(s), a, b, signed[:pivots], signed[: _slack(len(s), percent) + 1 + SPARE], sketch(s)))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds))],
                    names=["doc_id", "n", "a", "b", "heads", "prefix", "sketch"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, a bigint, b bigint, heads array<bigint>, prefix array<bigint>, sketch binary")


def _trim(sets: DataFrame, percent: int, frequent: list[int], kind: str) -> DataFrame:
    """Prefixes of rare tokens from the stored ones; null where those run out before the prefix is full."""
    names = ["doc_id", "n", "component", "sketch", "prefix"]

    def run(batches):
        common = np.array(sorted(frequent), np.int64)
        for batch in batches:
            out = []
            for n, kept in zip(batch.column("n").to_pylist(), batch.column("prefix").to_pylist()):
                kept = np.array(kept, np.int64)
                need, rare = _slack(n, percent) + 1, kept[~np.isin(kept, common)]
                out.append(rare[:need] if len(rare) >= need else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(out, pa.list_(pa.int64()))], names=names)

    return sets.select(*names).mapInArrow(run, f"doc_id {kind}, n bigint, component {kind}, sketch binary, prefix array<bigint>")


def _signatures(docs: DataFrame, k: int, percent: int, frequent: list[int]) -> DataFrame:
    """Rare tokens and pairs of frequent ones in the extended prefix of each text, with its sketch."""

    def run(batches):
        common = np.array(sorted(h % (1 << 64) for h in frequent), np.uint64)
        for batch in batches:
            for part in slices(batch):
                out, sizes, marks = [], [], []
                for grams in shingles(part.column("text"), k):
                    s = np.unique(grams)
                    hot = np.isin(s, common)
                    need = _slack(len(s), percent) + 1
                    rare, often = s[~hot][:need], s[hot]
                    if len(rare) < need:
                        often = often[: need - len(rare) + 1]
                        i, j = np.triu_indices(len(often), 1)
                        pairs = often[i] * np.uint64(0xD6E8FEB86659FD93) + (often[j] ^ np.uint64(0xA5A5A5A5A5A5A5A5))
                        rare = np.concatenate([rare, pairs])
                    out.append(rare.view(np.int64))
                    sizes.append(len(s))
                    marks.append(sketch(s))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "n", "sketch", "prefix"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, sketch binary, prefix array<bigint>")


def _sharp(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n, sharp``: the larger sketch of each text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = [np.unique(grams) for grams in shingles(part.column("text"), k)]
                columns = pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s, SHARP) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "n", "sharp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n bigint, sharp binary")


def _only(docs: DataFrame, ids: DataFrame, broadcast_rows: int) -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids(doc_id)``; the ids are broadcast only if they are few."""
    return docs.join(F.broadcast(ids) if ids.count() <= broadcast_rows else ids, "doc_id", "left_semi")


def _likely(pairs: DataFrame, percent: int, kind: str) -> DataFrame:
    """``pairs(u, v, n, m, sketch, other)`` that the two sketches don't rule out."""

    def run(batches):
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            both = Sketches(pa.concat_arrays([batch.column("sketch"), batch.column("other")]))
            i = np.arange(len(batch))
            keep, _ = both.near(i, i + len(batch), (100 - percent) * (n + m) // (100 + percent))
            yield batch.select(["u", "v"]).take(pa.array(keep))

    return pairs.select("u", "v", "n", "m", "sketch", "other").mapInArrow(run, f"u {kind}, v {kind}")


def _ends(pairs: DataFrame) -> DataFrame:
    return materialize(pairs.select(F.col("u").alias("doc_id")).unionByName(pairs.select(F.col("v").alias("doc_id"))).distinct(), "ends")


def verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int, broadcast_rows: int, doubtful: bool = False) -> DataFrame:
    """``pairs(u, v)``, each once, whose texts' shingle sets have 100 * intersection >= percent * union.

    Both texts travel to a row of the pair by plain equi-joins, which adaptive execution splits where one
    text has many partners. Of an id with several texts any one counts. Null texts have no shingles and never link.
    ``doubtful``: most pairs will fail, so their larger sketches, a fifth of a text or less, are compared first.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    pairs = materialize(pairs.select("u", "v").distinct(), "pairs")
    ids = _ends(pairs)
    if doubtful:
        sharp = materialize(_sharp(_only(docs, ids, broadcast_rows), k), "sharp")
        rows = pairs.join(sharp.select(F.col("doc_id").alias("u"), "n", F.col("sharp").alias("sketch")), "u")
        rows = rows.join(sharp.select(F.col("doc_id").alias("v"), F.col("n").alias("m"), F.col("sharp").alias("other")), "v")
        likely = materialize(_likely(rows, percent, kind).distinct(), "pairs")
        release(pairs, ids, sharp)
        pairs, ids = likely, _ends(likely)
    texts = materialize(_only(docs.select("doc_id", "text"), ids, broadcast_rows), "texts")
    rows = pairs.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("x")), "u")
    rows = rows.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("y")), "v").select("u", "v", "x", "y")

    def run(batches):
        for batch in batches:
            for half in slices(batch, "x"):
                for part in slices(half, "y"):
                    keep = [_alike(np.unique(x), np.unique(y), percent) for x, y in zip(shingles(part.column("x"), k), shingles(part.column("y"), k))]
                    yield part.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    links = materialize(rows.mapInArrow(run, f"u {kind}, v {kind}").distinct(), "links")
    release(pairs, ids, texts)
    return links


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(x) + len(y) - common)


def _forest(edges: list[tuple]) -> list[int]:
    """Numbers of those of ``edges(cu, cv)`` that unite two sets, in their order."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, (a, b) in enumerate(edges):
        a, b = root(a), root(b)
        if a != b:
            parent[b] = a
            out.append(i)
    return out


def _meet(rows: DataFrame, percent: int, kind: str, spare: int = 0) -> DataFrame:
    """Likely pairs of different components in each unit, ``entry, u, v, cu, cv, more``: all if they are at
    most ``spare`` for each row of the unit, else a spanning forest of the components.

    ``rows(unit, entry, side, doc_id, n, component, sketch, other)`` come sorted by unit, units are bounded.
    Sides -1 all meet; 0 and 1 meet each other. A row with ``other`` is a pair that has failed already.
    ``more``: the unit has likely pairs that are not given.
    """
    schema = f"entry bigint, u {kind}, v {kind}, cu {kind}, cv {kind}, more boolean"
    names = ["entry", "u", "v", "cu", "cv", "more"]

    def emit(table):
        dead = table.column("other").is_valid()
        failed = {(r["unit"], r["doc_id"], r["other"]) for r in table.filter(dead).select(["unit", "doc_id", "other"]).to_pylist()}
        table = table.filter(pa.compute.invert(dead))
        if len(table) < 2:
            return
        unit, side, n = (table.column(c).to_numpy(zero_copy_only=False) for c in ("unit", "side", "n"))
        ids, comp = (np.array(table.column(c).to_pylist(), object) if not pa.types.is_integer(table.schema.field(c).type) else table.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "component"))
        marks = Sketches(table.column("sketch"))
        found, at, d = [], np.arange(len(unit)), 0
        while len(at):
            d += 1
            at = at[at + d < len(unit)]
            at = at[unit[at] == unit[at + d]]
            i, j = at, at + d
            few = (comp[i] != comp[j]) & ((side[i] != side[j]) | (side[i] < 0))
            few &= 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            i, j = i[few], j[few]
            near, apart = marks.near(i, j, (100 - percent) * (n[i] + n[j]) // (100 + percent))
            found.append((i[near], j[near], apart))
        if not found:
            return
        i, j, apart = (np.concatenate(x) for x in zip(*found))
        if failed:
            live = np.array([(unit[a], ids[a], ids[b]) not in failed and (unit[a], ids[b], ids[a]) not in failed for a, b in zip(i.tolist(), j.tolist())], bool)
            i, j, apart = i[live], j[live], apart[live]
        if not len(i):
            return
        _, number = np.unique(comp, return_inverse=True)
        _, rank = np.unique(ids, return_inverse=True)
        low, high = np.minimum(number[i], number[j]), np.maximum(number[i], number[j])
        order = np.lexsort((rank[j], rank[i], apart / (n[i] + n[j]), unit[i]))
        i, j, low, high = i[order], j[order], low[order], high[order]
        sizes = dict(zip(*(x.tolist() for x in np.unique(unit, return_counts=True))))
        take, more, start = [], [], 0
        for u, group in groupby(unit[i].tolist()):
            count = len(list(group))
            chosen = range(count) if count <= spare * sizes[u] else _forest(list(zip(low[start : start + count].tolist(), high[start : start + count].tolist())))
            take += [start + c for c in chosen]
            more += [count > len(chosen)] * len(chosen)
            start += count
        i, j = i[take], j[take]
        out = [*(table.column(c).take(pa.array(x)) for c, x in (("entry", i), ("doc_id", i), ("doc_id", j), ("component", i), ("component", j))), pa.array(more, pa.bool_())]
        yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in out], names=names)

    def run(batches):
        kept = None
        for batch in batches:
            table = pa.Table.from_batches([*([kept] if kept is not None else []), batch]).combine_chunks()
            batch = table.to_batches()[0] if len(table) else batch
            unit = batch.column("unit").to_numpy()
            last = int(np.searchsorted(unit, unit[-1])) if len(unit) else 0
            yield from emit(batch.slice(0, last))
            kept = batch.slice(last)
            give_back()
        if kept is not None and len(kept):
            yield from emit(kept)

    return rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, schema)


def _units(index: DataFrame, block: int) -> DataFrame:
    """Rows of ``index(entry, doc_id, n, component, c, ...)`` in bounded units in which sets of different components meet.

    An entry of at most ``block`` rows is one unit. Of a larger one the rows of its largest component needn't meet
    each other: their blocks meet the blocks of the others, whose blocks meet each other as well. So an entry that
    one component fills makes as many rows as it has, times the blocks of the others.
    """
    columns = index.columns
    small = index.where(F.col("c") <= block).select(*columns, F.col("entry").alias("unit"), F.lit(-1).alias("side"))
    large = index.where(F.col("c") > block)
    sizes = large.groupBy("entry", "component").agg(F.count("*").alias("m"), F.first("c").alias("c"))
    most = sizes.groupBy("entry").agg(F.max(F.struct("m", "component")).alias("most"), F.first("c").alias("c"))
    cells = lambda rows: F.ceil(rows / block).cast("int")
    most = most.select("entry", F.col("most.component").alias("main"), cells(F.col("most.m")).alias("mains"), cells(F.col("c") - F.col("most.m")).alias("others"))
    rows = large.join(most, "entry").withColumn("ours", F.col("component") == F.col("main"))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.when(F.col("ours"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    meets = lambda x, y, side: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), side.cast("int").alias("side"))
    cell, end = F.col("cell"), F.lit(-1)
    with_others = F.transform(upto(F.col("others")), lambda o: meets(cell, -1 - o, F.lit(0)))
    with_mains = F.transform(upto(F.col("mains")), lambda m: meets(m, -1 - cell, F.lit(1)))
    among = F.transform(upto(F.col("others")), lambda o: meets(-1 - F.least(cell, o), -1 - F.greatest(cell, o), F.when(cell == o, end).when(o < cell, 0).otherwise(1)))
    rows = rows.withColumn("at", F.explode(F.when(F.col("ours"), with_others).otherwise(F.concat(with_mains, among))))
    rows = rows.select(*columns, F.xxhash64("entry", "at.x", "at.y").alias("unit"), F.col("at.side").alias("side"))
    return small.unionByName(rows)


def _mixed(index: DataFrame) -> DataFrame:
    """Rows of entries with sets of several components, with the number of rows of their entry in ``c``."""
    whole = Window.partitionBy("entry")
    index = index.withColumns({"low": F.min("component").over(whole), "high": F.max("component").over(whole)}).where("low <> high")
    return index.withColumn("c", F.count("*").over(whole)).select("entry", "doc_id", "n", "component", "c")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, pivots: int = 4, often: int = 500, max_frequent: int = 4096, block: int = 1024, broadcast_rows: int = 200_000) -> DataFrame:
    """``doc_id, n_shingles, component_id``: classes of texts linked by Jaccard likeness of at least ``percent``.

    Exact up to 64-bit hash equality. Sets are of distinct ``k``-word shingles of whole texts; a shorter
    text is one shingle; null, empty and blank texts have none and link with nothing. Ids that are null
    give a row that links with nothing; a repeated id counts as one document per row with that id. Other
    columns are ignored; an empty table gives no rows.

    ``often``: a token that lies in the prefixes of more sets of one magnitude, of several components, is
    frequent; at most ``max_frequent`` of them, the most frequent ones, are (any choice gives the same
    links). Equal sets are joined by digest; one of them stands for all. ``pivots``: by so many smallest
    tokens sets meet a pivot; what that misses the index finds. Sets of an entry meet in blocks of ``block``.
    Tables of at most ``broadcast_rows`` ids are broadcast after they were counted; others are shuffled.
    """
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    few = lambda frame: F.broadcast(frame) if frame.count() <= broadcast_rows else frame
    sets = materialize(_sets(docs, k, percent, pivots), "sets")
    known = sets.where("n > 0 and doc_id is not null")
    classes = known.groupBy("a", "b", "n").agg(F.min("doc_id").alias("v"), F.max("doc_id").alias("w"))
    classes = materialize(classes.where("v <> w").select("a", "b", "n", "v"), "copies")
    same = known.select("doc_id", "a", "b", "n").join(few(classes), ["a", "b", "n"]).where("doc_id <> v")
    same = materialize(same.select(F.col("doc_id").alias("u"), "v", "a", "b", "n").distinct(), "same")
    reps = known.join(few(same.select(F.col("u").alias("doc_id"), "a", "b", "n")), ["doc_id", "a", "b", "n"], "left_anti")

    fits = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    first = reps.select("doc_id", "n", "sketch", F.explode("heads").alias("token"))
    low = first.groupBy("token").agg(F.min_by(F.struct("doc_id", "n", "sketch"), F.col("doc_id")).alias("p"), F.count("*").alias("c")).where("c > 1")
    stars = first.join(low, "token").selectExpr("doc_id as u", "p.doc_id as v", "n", "p.n as m", "sketch", "p.sketch as other")
    stars = _likely(stars.where(f"u <> v and {fits}"), percent, kind)
    links = verify(stars, docs, k, percent, broadcast_rows)
    groups = connected_components(links)
    named = few(groups.withColumnRenamed("node", "doc_id"))
    reps = reps.select("doc_id", "n", "sketch", "prefix").join(named, "doc_id", "left")
    reps = reps.withColumn("component", F.coalesce("component", "doc_id"))
    own = reps.withColumn("prefix", F.expr(f"slice(prefix, 1, cast(n - ({percent} * n + 99) div 100 + 1 as int))"))

    def entries(frame: DataFrame, *more: str) -> DataFrame:
        """A row per entry of a prefix; sets that link meet in one magnitude of ``n`` at least."""
        sized = frame.withColumn("magnitude", F.explode(F.expr(f"sequence(cast(floor(log2(n)) as int), cast(floor(log2(n * 100 div {percent})) as int))")))
        return sized.select("doc_id", "component", *more, "magnitude", F.explode("prefix").alias("token"))

    # grouped by token and magnitude, not by their hash: less to shuffle, and the token needn't be carried beside it
    counts = entries(own).groupBy("token", "magnitude").agg(F.count("*").alias("c"), F.min("component").alias("low"), F.max("component").alias("high"))
    shared = materialize(counts.where((F.col("c") > often) & (F.col("low") != F.col("high"))).select("token", "c"), "mixed")
    hot = shared.groupBy("token").agg(F.max("c").alias("c"))
    hot = [r["token"] for r in hot.orderBy(F.desc("c"), "token").limit(max_frequent).collect()]
    sizes = materialize(sets.select("doc_id", F.col("n").alias("n_shingles")), "sizes")
    release(shared)
    if hot:
        trimmed = materialize(_trim(reps, percent, hot, kind), "trimmed")
        release(sets)
        short = materialize(trimmed.where("prefix is null").select("doc_id", "component").distinct(), "short")
        anew = _signatures(_only(docs, short.select("doc_id"), broadcast_rows), k, percent, hot).join(few(short), "doc_id")
        anew = materialize(anew.select("doc_id", "n", "component", "sketch", "prefix"), "anew")
        own = trimmed.where("prefix is not null").unionByName(anew)

    # one shuffle of all entries: nearly all have one set, so neither counting nor joining the counts back gathers them
    index = materialize(_mixed(entries(own, "n").withColumn("entry", F.xxhash64("token", "magnitude"))), "index")
    marks = own.select("doc_id", "n", "sketch").distinct()
    wanted = ["unit", "entry", "side", "doc_id", "n", "component", "sketch"]
    # sketches join only what is left of the entries, so that most of them never carry one
    rows = _units(index.join(marks, ["doc_id", "n"]), block).select(*wanted, F.lit(None).cast(kind).alias("other"))
    every, spent, dead = [links], [index], None
    while True:
        met = materialize(_meet(rows, percent, kind, 4 if len(every) == 1 else 32), "met")
        more = verify(met, docs, k, percent, broadcast_rows, doubtful=True)
        every.append(more)
        failed = met.join(few(more.withColumn("linked", F.lit(True))), ["u", "v"], "left").where("linked is null")
        asked = materialize(failed.where("more").select("entry").distinct(), "asked")
        spent += [met, asked]
        if not asked.count():
            break
        united = connected_components(met.join(few(more), ["u", "v"], "left_semi").select(F.col("cu").alias("u"), F.col("cv").alias("v")))
        united_ = few(united.select(F.col("node").alias("component"), F.col("component").alias("with")))
        # entries are asked again by their rows, before these are dealt to units, and only where components are left apart
        again = index.join(few(asked), "entry", "left_semi").join(united_, "component", "left").withColumn("component", F.coalesce("with", "component"))
        index = materialize(_mixed(again), "index")
        failed = failed.select("entry", "u", "v")
        dead = materialize((failed if dead is None else failed.unionByName(dead)).join(few(index.select("entry").distinct()), "entry", "left_semi"), "dead")
        if len(every) == 2:
            ids = materialize(index.select("doc_id").distinct(), "ends")
            sharp = materialize(_sharp(_only(docs, ids, broadcast_rows), k), "sharp")
            marks = sharp.withColumnRenamed("sharp", "sketch").distinct()
            spent += [ids, sharp]
        # each row of the index meets its sketch and its failed pairs once, before it goes to one or several units
        own = index.join(marks, ["doc_id", "n"])
        pairs = dead.groupBy("entry", F.col("u").alias("doc_id")).agg(F.collect_set("v").alias("failed"))
        own = _units(own.join(pairs, ["entry", "doc_id"], "left"), block)
        known = F.transform(F.coalesce("failed", F.array().cast(f"array<{kind}>")), lambda v: F.struct(F.lit(-1).alias("side"), F.lit(None).cast("binary").alias("sketch"), v.alias("other")))
        own = own.withColumn("as", F.explode(F.concat(F.array(F.struct(F.col("side"), F.col("sketch"), F.lit(None).cast(kind).alias("other"))), known)))
        rows = materialize(own.select("unit", "entry", "as.side", "doc_id", "n", "component", "as.sketch", "as.other"), "again")
        spent += [united, index, dead, rows]
    pairs = same.select("u", "v")
    for found in every:
        pairs = pairs.unionByName(found)
    found = connected_components(pairs)
    ids = few(found.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id")))
    out = sizes.join(ids, "doc_id", "left")
    out = materialize(out.withColumn("component_id", F.coalesce("component_id", "doc_id")), "classes")
    release(sizes, classes, same, groups, found, *every, *spent, *((trimmed, short, anew) if hot else (sets,)))
    return out
