"""Operator 7: fuzzy passages that repeat across documents, by seeds, collinear chains and alignment.

Winnowed word k-grams are seeds. The occurrence of a seed in the smallest document is its pivot, and
every other document meets the pivot first, so a passage in ``n`` documents makes ``n - 1`` pairs. The
seeds that a document shares with one pivot document are chained in order with a linear gap cost by a
Fenwick tree over positions in the pivot; chains break at long gaps. Slices of words around each chain
are then aligned, which finds the ends of the passage and how much of it agrees.

Runs of shared seeds that no found passage covers may have lost their pivots to documents with a part of
them. Such a run meets the smallest document with each of its spans of 2, 4, 8, 16 seeds and of nearly
``min_words`` words, and is chained and aligned again by these spans' first and last seeds.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from difflib import Match, SequenceMatcher
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from siftlog.llm.shingles import mix, shingles, words
from siftlog.llm.texts import slices
from siftlog.scratch import materialize, release

STEP = 32
#: Ids are hashed to so many numbers where texts are chosen before a shuffle.
CELLS = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of window minima, the rightmost of equal ones."""
    if len(grams) <= window:
        return np.array([len(grams) - 1 - int(np.argmin(grams[::-1]))]) if len(grams) else np.zeros(0, int)
    n = len(grams) - window + 1
    best, at = grams[:n], np.arange(n)
    for j in range(1, window):  # a step for each place in the window, not for each window
        less = grams[j : j + n] <= best
        best, at = np.where(less, grams[j : j + n], best), np.where(less, np.arange(j, j + n), at)
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def _seeds(docs: DataFrame, k: int, window: int, min_words: int, kind: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                token, row, pos = [], [], []
                for i, grams in enumerate(shingles(part.column("text"), k)):
                    if len(grams) + k - 1 >= min_words:
                        at = winnow(grams, window)
                        token.append(grams[at])
                        pos.append(at)
                        row.append(np.full(len(at), i))
                if token:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(token).view(np.int64)), part.column("doc_id").take(pa.array(np.concatenate(row))), pa.array(np.concatenate(pos).astype(np.int32))],
                        names=["token", "doc_id", "pos"],
                    )

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, f"token bigint, doc_id {kind}, pos int")


def _held(seeds: DataFrame) -> DataFrame:
    """Seeds that several documents hold, ``token, doc_id, pos, src, at``, with the first place of the smallest one.

    One shuffle: most seeds have a token of their own, so nothing can be gathered before it, and a join back would
    shuffle all of them again. A token's rows lie in a buffer that goes to disk when it grows.
    """
    token = Window.partitionBy("token")
    several = seeds.withColumns({"low": F.min("doc_id").over(token), "last": F.max("doc_id").over(token)}).where("low <> last")
    pivot = several.withColumn("pivot", F.min(F.struct("doc_id", "pos")).over(token))
    return pivot.selectExpr("token", "doc_id", "pos", "pivot.doc_id as src", "pivot.pos as at")


def chains(pos: np.ndarray, at: np.ndarray, k: int, gap_cost: float, max_gap: int) -> list[tuple[int, int, int, int, int]]:
    """Collinear chains of matches: (first and last start in the document, the same in the pivot, matches).

    ``f(i) = k + max(0, f(j) - gap_cost * (distance in both texts))`` over matches j before i in both texts.
    As the cost is linear, the best j is a maximum of ``f(j) + gap_cost * (pos + at)`` over smaller places
    in the pivot, which a Fenwick tree keeps. Chains are taken from the best end, each match once.
    """
    n = len(pos)
    order = np.lexsort((-at, pos))
    pos, at = pos[order], at[order]
    rising = bool((np.diff(pos) > 0).all() and (np.diff(at) > 0).all())
    pos, at = pos.tolist(), at.tolist()
    score, before = [0.0] * n, [-1] * n
    if rising:  # every match lies before the next in both texts, and f(i) + its costs grows by at least k
        best = float("-inf")
        for i in range(n):
            here = gap_cost * (pos[i] + at[i])
            gain = best - here
            if gain > 0:
                before[i] = i - 1
            score[i] = k + max(0.0, gain)
            best = score[i] + here
    else:
        rank = {v: i + 1 for i, v in enumerate(sorted(set(at)))}
        tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (len(rank) + 1)
        for i in range(n):
            here = gap_cost * (pos[i] + at[i])
            best, r = (float("-inf"), -1), rank[at[i]] - 1
            while r > 0:
                if tree[r] > best:
                    best = tree[r]
                r -= r & -r
            gain = best[0] - here
            if gain > 0:
                before[i] = best[1]
            score[i] = k + max(0.0, gain)
            entry, r = (score[i] + here, i), rank[at[i]]
            while r < len(tree):
                if entry > tree[r]:
                    tree[r] = entry
                r += r & -r
    used, out = [False] * n, []
    for end in np.argsort(-np.array(score), kind="stable").tolist():
        if used[end]:
            continue
        path, i = [], end
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = before[i]
        path.reverse()
        first = 0
        for x in range(1, len(path) + 1):
            if x == len(path) or max(pos[path[x]] - pos[path[x - 1]], at[path[x]] - at[path[x - 1]]) > max_gap:
                a, b = path[first], path[x - 1]
                out.append((pos[a], pos[b], at[a], at[b], x - first))
                first = x
    return out


def _chained(anchors: DataFrame, k: int, gap_cost: float, max_gap: int, extent: int, window: int, kind: str) -> DataFrame:
    """Chains of each (document, pivot document), streamed over rows sorted by both."""
    ordered = anchors.repartition("doc_id").sortWithinPartitions("doc_id", "src", "pos", "at")

    def run(batches):
        kept = None
        for batch in batches:
            table = pa.Table.from_batches([*([kept] if kept is not None else []), batch]).combine_chunks()
            batch = table.to_batches()[0] if len(table) else batch
            doc, src = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("src").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((doc[1:] != doc[:-1]) | (src[1:] != src[:-1])) + 1
            last = int(cut[-1]) if len(cut) else 0
            yield from emit(batch.slice(0, last), cut[:-1] if len(cut) else cut)
            kept = batch.slice(last)
        if kept is not None and len(kept):
            yield from emit(kept, np.zeros(0, int))

    def emit(batch, cuts):
        if not len(batch):
            return
        pos, at = (batch.column(c).to_numpy().astype(np.int64) for c in ("pos", "at"))
        rows, found = [], []
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(pos)]])
        wide = np.flatnonzero((ends - starts > 1) & (pos[ends - 1] - pos[starts] + k + 2 * window >= extent))
        for a, b in zip(starts[wide].tolist(), ends[wide].tolist()):
            for c in chains(pos[a:b], at[a:b], k, gap_cost, max_gap):
                if c[4] > 1 and c[1] - c[0] + k + 2 * window >= extent:
                    rows.append(a)
                    found.append(c)
        if rows:
            part = batch.select(["doc_id", "src"]).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, pa.int32()) for x in zip(*found))], names=["doc_id", "src", "p1", "p2", "q1", "q2", "seeds"])

    return ordered.mapInArrow(run, f"doc_id {kind}, src {kind}, p1 int, p2 int, q1 int, q2 int, seeds int")


def _stretch(x: np.ndarray, y: np.ndarray, reach: int) -> tuple[int, int, int]:
    """How far two lists agree from their start: (words of x, of y, equal). Up to ``reach`` words of either may
    be skipped where three or more words agree behind."""
    i = j = same = 0
    while True:
        n = min(len(x) - i, len(y) - j)
        differ = x[i : i + n] != y[j : j + n]
        run = int(np.argmax(differ)) if differ.any() else n
        i, j, same = i + run, j + run, same + run
        u, v = x[i : i + reach + 3].tolist(), y[j : j + reach + 3].tolist()
        places = {words: b for b, words in reversed([*enumerate(zip(v, v[1:], v[2:]))])}
        hits = [(a + places[words], a) for a, words in enumerate(zip(u, u[1:], u[2:])) if words in places]
        if not hits:
            return i, j, same
        skip, a = min(hits)
        i, j = i + a, j + skip - a


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two multisets."""
    x, y = np.sort(x), np.sort(y)
    return int((np.arange(len(x)) - np.searchsorted(x, x) < np.searchsorted(y, x, "right") - np.searchsorted(y, x)).sum())


def matching_blocks(x: np.ndarray, y: np.ndarray, most: int = 3_000_000) -> list[tuple[int, int, int]]:
    """The blocks (start in x, start in y, size) of ``difflib.SequenceMatcher`` without junk, by its rule: the longest
    (of equal ones the first in x, then in y), then the same on either side of it.

    The runs of equal words on diagonals are found at once, and each side takes its runs along, cut at its border. Texts
    with over ``most`` equal pairs of words go through ``difflib``, which doesn't hold them all.
    """
    order = np.argsort(y, kind="stable").astype(np.int32)
    lo, hi = (np.searchsorted(y[order], x, side) for side in ("left", "right"))
    count = hi - lo
    if count.sum() > most:
        return [tuple(m) for m in SequenceMatcher(None, x.tolist(), y.tolist(), autojunk=False).get_matching_blocks()]
    i = np.repeat(np.arange(len(x), dtype=np.int32), count)
    j = order[np.arange(len(i)) + np.repeat(lo - np.cumsum(count) + count, count)]
    first = (i == 0) | (j == 0)
    last = (i == len(x) - 1) | (j == len(y) - 1)
    first[~first] = x[i[~first] - 1] != y[j[~first] - 1]
    last[~last] = x[i[~last] + 1] != y[j[~last] + 1]
    i, j, first, last = (z[first | last] for z in (i, j, first, last))
    diagonal = np.lexsort((i, j - i)) if len(i) else np.zeros(0, int)
    ends = i[diagonal][last[diagonal]]
    i, j = (z[diagonal][first[diagonal]] for z in (i, j))
    blocks, sides = [], [(i, j, ends - i + 1)]
    while sides:
        i, j, n = sides.pop()
        if not len(n):
            continue
        size = int(n.max())
        best = np.flatnonzero(n == size)
        best = best[np.lexsort((j[best], i[best]))[0]] if len(best) > 1 else best[0]
        a, b = int(i[best]), int(j[best])
        blocks.append((a, b, size))
        before = (i < a) & (j < b)
        u, v = i[before], j[before]
        sides.append((u, v, np.minimum(n[before], np.minimum(a - u, b - v))))
        shift = np.maximum(np.maximum(a + size - i, b + size - j), 0)
        behind = shift < n
        shift = shift[behind]
        sides.append((i[behind] + shift, j[behind] + shift, n[behind] - shift))
    return [*sorted(blocks), (len(x), len(y), 0)]


def align(x: np.ndarray, y: np.ndarray, x1: int, x2: int, y1: int, y2: int, reach: int = 8, min_words: int = 0, identity: float = 0.0) -> tuple[int, int, int, int, int]:
    """Passage around a chain from x1 to x2 and y1 to y2: its ends in both word lists and the equal words.

    A chain on one diagonal that mostly agrees is stretched to both sides; if that is too short or agrees
    too little, matching blocks are joined from the chain outward while the words between blocks of three
    that differ stay within ``reach``; if these agree too little, the longest part that agrees enough.
    """
    enough = lambda a, b, c, d, same: min(b - a, d - c) >= min_words and same >= identity * max(b - a, d - c)
    if x2 - x1 == y2 - y1:
        core = x[x1:x2] == y[y1:y2]
        if core.mean() >= 0.9:
            i, j, ahead = _stretch(x[x2:], y[y2:], reach // 2)
            a, b, back = _stretch(x[:x1][::-1], y[:y1][::-1], reach // 2)
            found = x1 - a, x2 + i, y1 - b, y2 + j, int(core.sum()) + ahead + back
            if enough(*found):
                return found
    # an unequal word of either text opens at most one gap, so that enough equal words leave this many equal pairs
    pairs = [z[:-1].astype(np.uint64) << np.uint64(32) | z[1:] for z in (x, y)]
    if _common(x, y) < identity * min_words or _common(*pairs) < (3 * identity - 2) * min_words - 1:
        return x1, x2, y1, y2, 0
    every = [Match(*m) for m in matching_blocks(x, y)]
    blocks = [m for m in every if m.size > 2]
    inside = [i for i, m in enumerate(blocks) if m.a < x2 and m.a + m.size > x1 and m.b < y2 and m.b + m.size > y1]
    if not inside:
        return x1, x2, y1, y2, 0
    lo, hi = inside[0], inside[-1]
    starts = [m.a for m in every]
    sums = [0, *accumulate(m.size for m in every)]
    equal = lambda m, n: sums[bisect_left(starts, n.a + n.size)] - sums[bisect_left(starts, m.a)]
    gap = lambda m, n: max(n.a - m.a - m.size, n.b - m.b - m.size) - (equal(m, n) - m.size - n.size)
    while lo > 0 and gap(blocks[lo - 1], blocks[lo]) <= reach:
        lo -= 1
    while hi + 1 < len(blocks) and gap(blocks[hi], blocks[hi + 1]) <= reach:
        hi += 1
    span = lambda m, n: (m.a, n.a + n.size, m.b, n.b + n.size, equal(m, n))
    found = span(blocks[lo], blocks[hi])
    if not enough(*found):
        parts = (span(blocks[i], blocks[j]) for i in range(lo, hi + 1) for j in range(i, hi + 1))
        found = max((f for f in parts if enough(*f)), key=lambda f: f[1] - f[0], default=found)
    return found


def _slices(docs: DataFrame, wanted: DataFrame, kind: str) -> DataFrame:
    """Word hashes of ranges of texts; ``wanted(doc_id, ranges)`` has the few ranges of each document."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                hashes, bounds = words(part.column("text"))
                small = (hashes >> np.uint64(32)).astype(np.uint32)
                row, lo, hi, out = [], [], [], []
                for i, ranges in enumerate(part.column("ranges").to_pylist()):
                    own = small[bounds[i] : bounds[i + 1]]
                    for r in ranges:
                        row.append(i)
                        lo.append(r["lo"])
                        hi.append(r["hi"])
                        out.append(own[r["lo"] : r["hi"]].tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(out, pa.binary())], names=["doc_id", "lo", "hi", "words"])

    # few documents have chains: their ids' hashes, at most CELLS of them, go to the texts, so that most texts are never shuffled
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).cast("int")
    cells = F.broadcast(wanted.select(cell.alias("cell")).distinct())
    near = docs.where("doc_id is not null").select("doc_id", "text").withColumn("cell", cell).join(cells, "cell", "left_semi")
    return near.join(wanted, "doc_id").select("doc_id", "text", "ranges").mapInArrow(run, f"doc_id {kind}, lo int, hi int, words binary")


def _by_doc(rows: DataFrame, columns: list[str], make, schema: str) -> DataFrame:
    """``make(rows of whole documents)`` over ``rows``, which are dealt by document, sorted by document and position, streamed."""
    ordered = rows.select("doc_id", "pos", *columns).sortWithinPartitions("doc_id", "pos")

    def run(batches):
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            doc = batch.column("doc_id").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(doc[1:] != doc[:-1]) + 1
            if kept and kept[-1].column("doc_id")[-1].as_py() != doc[0]:
                yield from make(_whole(kept))
                kept = []
            if len(cut):
                yield from make(_whole([*kept, batch.slice(0, int(cut[-1]))]))
                kept = []
            kept.append(batch.slice(int(cut[-1]) if len(cut) else 0))
        if kept:
            yield from make(_whole(kept))

    return ordered.mapInArrow(run, schema)


def _whole(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _runs(rows: pa.RecordBatch, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``pos``, the number of the document and the number of the run of each row; a step over ``gap`` ends a run."""
    doc, pos = rows.column("doc_id").to_numpy(zero_copy_only=False), rows.column("pos").to_numpy().astype(np.int64)
    other = doc[1:] != doc[:-1]
    number = lambda new: np.concatenate([[0], np.cumsum(new)])
    return pos, number(other), number(other | (np.diff(pos) > gap))


def spans(token: np.ndarray, pos: np.ndarray, run: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of spans of 2, 4, 8 and 16 seeds of a run and of the seeds within ``reach`` words, with first and last row."""
    own, n, size = mix(token.view(np.uint64)), len(token), 1
    place = pos + (run << 40)
    end = np.searchsorted(place, place + reach, "right") - 1
    far = np.flatnonzero((end > np.arange(n)) & (run[np.minimum(end + 1, n - 1)] == run) & (end < n - 1))
    # running sums in an odd base: shifting by the inverse power makes a key independent of its place
    power, inverse = (np.multiply.accumulate(np.full(n, base, np.uint64)) for base in (_ODD, _INVERSE))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * power)])
    keys, first, last = [mix((sums[end[far] + 1] - sums[far]) * inverse[far])], [far], [end[far]]
    while size <= 8 and 2 * size <= n:
        own = mix(own[:-size] * _ODD + own[size:])
        size *= 2
        inside = np.flatnonzero(run[: len(own)] == run[size - 1 :])
        keys.append(own[inside] ^ np.uint64(size))
        first.append(inside)
        last.append(inside + size - 1)
    return np.concatenate(keys), np.concatenate(first), np.concatenate(last)


def _other_pairs(held: DataFrame, found: DataFrame, k: int, window: int, min_words: int, gap: int, broadcast_rows: int, kind: str) -> DataFrame:
    """Anchors of runs of shared seeds outside the found passages with the smallest holders of their spans."""
    reach = min_words - k - 3 * (window - 1)
    cover = found.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start_word").alias("a"), F.expr("start_word + n_words").alias("b"))).alias("cover"))
    bare = held.where("doc_id <> src").join(cover, "doc_id", "left").where(f"cover is null or not exists(cover, c -> pos >= c.a and pos + {k} <= c.b)")

    def left(rows):
        pos, _, run = _runs(rows, gap)
        starts = np.flatnonzero(np.diff(run, prepend=-1))
        sizes = np.diff(starts, append=len(pos))
        wide = (sizes > 1) & (pos[starts + sizes - 1] - pos[starts] + k + 2 * (k + window) >= min_words)
        yield rows.filter(pa.array(np.repeat(wide, sizes)))

    bare = materialize(_by_doc(bare.repartition("doc_id"), ["token"], left, f"doc_id {kind}, pos int, token bigint"), "bare")
    tokens = materialize(bare.select("token").distinct(), "tokens")
    few = F.broadcast(tokens) if tokens.count() <= broadcast_rows else tokens
    near = held.join(few, "token", "left_semi").select("doc_id", "pos", "token", F.lit(False).alias("bare"))
    near = near.unionByName(bare.select("doc_id", "pos", "token", F.lit(True).alias("bare"))).repartition("doc_id")
    near = near.groupBy("doc_id", "pos", "token").agg(F.max("bare").alias("bare"))  # dealt by document already

    def keyed(rows):
        pos, doc, run = _runs(rows, gap)
        token = rows.column("token").to_numpy()
        sums = np.concatenate([[0], np.cumsum(rows.column("bare").to_numpy(zero_copy_only=False).astype(int))])
        key, a, b = spans(token, pos, run, reach)
        asked = sums[b + 1] > sums[a]
        # text that repeats itself: of one key's places close together in a document the first speaks for all
        cell = ((doc[a] << 32) + pos[a] // max(1, min_words // 2) * 2 + asked).astype(np.uint64)
        kept = np.sort(np.unique(mix(key ^ mix(cell)), return_index=True)[1])
        key, a, b, asked = key[kept], a[kept], b[kept], asked[kept]
        owner = rows.column("doc_id").take(pa.array(a))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), owner, pa.array(asked), pa.array(pos[a], pa.int32()), pa.array(pos[b], pa.int32())], names=["key", "doc_id", "bare", "p1", "p2"])

    keys = materialize(_by_doc(near, ["token", "bare"], keyed, f"key bigint, doc_id {kind}, bare boolean, p1 int, p2 int"), "keys")
    release(bare, tokens, held)
    first = keys.groupBy("key").agg(F.min(F.struct("doc_id", "p1", "p2")).alias("pivot"), F.max("doc_id").alias("last"), F.max("bare").alias("asked"))
    first = first.where("pivot.doc_id <> last and asked").selectExpr("key", "pivot.doc_id as src", "pivot.p1 as q1", "pivot.p2 as q2")
    met = keys.where("bare").join(first, "key").where("doc_id <> src")
    ends = F.explode(F.array(F.struct(F.col("p1").alias("pos"), F.col("q1").alias("at")), F.struct(F.col("p2").alias("pos"), F.col("q2").alias("at"))))
    return met.select("doc_id", "src", ends.alias("x")).select("doc_id", "src", "x.pos", "x.at").distinct()


def repeated_passages(docs: DataFrame, min_words: int = 50, identity: float = 0.8, k: int = 4, window: int = 4, gap_cost: float = 0.05, max_gap: int = 64, broadcast_rows: int = 500_000) -> DataFrame:
    """One row per passage of a document that an earlier document (smaller ``doc_id``) has as well.

    ``doc_id, start_word, n_words, source_doc_id, source_start_word, source_n_words, equal_words``; words
    are as in ``shingles.py``. A passage has at least ``min_words`` words on both sides, of which the share
    ``identity`` is equal. Any run of ``window + k - 1`` equal words shares a seed. The smallest document
    that has a passage gets no row for it, so that removing the rows' passages keeps one copy. Null and
    short texts have no passages; null ids are left out; of rows with one id each is searched, and they
    don't repeat each other; other columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = materialize(_held(_seeds(docs, k, window, min_words, kind)), "held")
    settings = (min_words, identity, k, window, gap_cost, max_gap, kind)
    found = _passages(docs, held.where("doc_id <> src").select("doc_id", "src", "pos", "at"), min_words // 2, *settings)
    others = _passages(docs, _other_pairs(held, found, k, window, min_words, 32, broadcast_rows, kind), 0, *settings)
    return found.unionByName(others).distinct()


def _passages(docs: DataFrame, anchors: DataFrame, extent: int, min_words: int, identity: float, k: int, window: int, gap_cost: float, max_gap: int, kind: str) -> DataFrame:
    """Aligned passages of the chains of ``anchors(doc_id, src, pos, at)`` over about ``extent`` words."""
    found = _chained(anchors, k, gap_cost, max_gap, extent, window, kind)
    reach = max(window + k, min_words)
    bound = lambda a, b: (f"greatest(0, ({a} - {reach}) div {STEP} * {STEP})", f"({b} + {k + reach + STEP - 1}) div {STEP} * {STEP}")
    (lo, hi), (slo, shi) = bound("p1", "p2"), bound("q1", "q2")
    found = found.withColumns({n: F.expr(e).cast("int") for n, e in (("lo", lo), ("hi", hi), ("slo", slo), ("shi", shi))})
    found = materialize(found, "chains")
    wanted = found.select("doc_id", "lo", "hi").unionByName(found.selectExpr("src as doc_id", "slo as lo", "shi as hi")).distinct()
    wanted = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    cut = materialize(_slices(docs, wanted, kind).dropDuplicates(["doc_id", "lo", "hi"]), "slices")
    pairs = found.join(cut.withColumnRenamed("words", "x"), ["doc_id", "lo", "hi"])
    pairs = pairs.join(cut.selectExpr("doc_id as src", "lo as slo", "hi as shi", "words as y"), ["src", "slo", "shi"])

    def run(batches):
        for batch in batches:
            rows, out, known = [], [], {}  # copies bring the same words, which are aligned once a batch
            numbers = {c: batch.column(c).to_pylist() for c in ("lo", "slo", "p1", "p2", "q1", "q2", "x", "y")}
            for i, (lo_, slo_, p1, p2, q1, q2, x, y) in enumerate(zip(*numbers.values())):
                case = x, y, p1 - lo_, p2 + k - lo_, q1 - slo_, q2 + k - slo_
                if case not in known:
                    known[case] = align(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), *case[2:], min_words=min_words, identity=identity)
                a, b, c, d, same = known[case]
                if min(b - a, d - c) >= min_words and same >= identity * max(b - a, d - c):
                    rows.append(i)
                    out.append((a + lo_, b - a, c + slo_, d - c, same))
            part = batch.select(["doc_id", "src"]).take(pa.array(rows, pa.int64()))
            values = [pa.array(v, pa.int64()) for v in zip(*out)] if out else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([part.column(0), values[0], values[1], part.column(1), *values[2:]], names=NAMES)

    schema = f"doc_id {kind}, start_word bigint, n_words bigint, source_doc_id {kind}, source_start_word bigint, source_n_words bigint, equal_words bigint"
    out = pairs.select("doc_id", "src", "lo", "slo", "p1", "p2", "q1", "q2", "x", "y").mapInArrow(run, schema)
    out = materialize(out.distinct(), "passages")
    release(found, cut)
    return out


NAMES = ["doc_id", "start_word", "n_words", "source_doc_id", "source_start_word", "source_n_words", "equal_words"]
_word = re.compile(r"[^\x20\x09-\x0D]+")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` (start, number) and the blanks after each."""
    at = [m.start() for m in _word.finditer(text)] + [len(text)]
    keep, end = [], 0
    for a, n in sorted(spans):
        b = min(a + n, len(at) - 1)
        if b > end:
            keep.append(text[at[end] if end else 0 : at[max(a, end)]])
            end = b
    return "".join([*keep, text[at[end] :]]) if end else text


def remove_passages(docs: DataFrame, passages: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """``docs`` with the passages cut out of ``text`` and ``n_chars`` counted again; other columns stay.

    Rows with a repeated id share their cuts, null ids and null texts stay as they are. The cuts are
    broadcast only if they are few.
    """
    cuts = passages.select("doc_id", "start_word", "n_words").distinct()
    few = cuts.count() <= broadcast_rows
    cuts = cuts.groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "n_words")).alias("spans"))
    names = docs.columns
    # columns by place, so that no name of the table can clash
    rows = docs.toDF(*(f"c{i}" for i in range(len(names))))
    columns = rows.columns
    key, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    joined = rows.join(F.broadcast(cuts) if few else cuts, rows[key] == cuts["doc_id"], "left").drop("doc_id")

    def cut(batches):
        for batch in batches:
            spans = batch.column("spans").to_pylist()
            texts = [t if t is None or not s else without(t, [(x["start_word"], x["n_words"]) for x in s]) for t, s in zip(batch.column(text).to_pylist(), spans)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == text else batch.column(n) for n in columns], names=columns)

    out = joined.mapInArrow(cut, rows.schema).toDF(*names)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
