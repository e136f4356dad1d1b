"""Operator 13: spelling variants by search schemes over an FM-index.

Two words at one edit agree exactly in the first half of either or in its second half. Each word therefore
searches twice: its first half is matched exactly and extended to the right over the second half with one
error, and its second half exactly and extended to the left over the first. Words are delimited, so halves
start at a delimiter and each search keeps the suffix-rank interval of the direction that it extends in;
the index of the other direction is the same code over reversed words.

An index of the whole vocabulary is never made. A half that must match exactly is a key: words that begin
(or end) with the same half meet in one shard, which indexes its words and runs its searches. Keys are
dealt to shards by hash, and a key with very many words is split over salted shards that its searches all
visit.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from siftlog.llm.texts import slices
from siftlog.scratch import materialize, release

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SHARD = 8_000  # about as many words are indexed together
COUNTED = 200_000  # words that a task counts before it sends them on


def count_words(docs: DataFrame, shortest: int = 5, rarest: int = 3, every: int = 97, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n`` of the words of whole texts with at least ``shortest`` code points and ``rarest`` occurrences.

    Words are runs of Latin letters, lower-cased in A-Z only. Where ``every`` divides the crc32 of
    ``<key>:<run>``, the run loses the code point at the hash modulo its length. Null texts have no runs;
    a null key counts as the empty text; repeated rows count again. Tasks count words before they are
    shuffled, in tables of bounded size.
    """

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for part in slices(batch, text):
                for k, t in zip(part.column(key).to_pylist(), part.column(text).to_pylist()):
                    if t:
                        head = crc32(f"{'' if k is None else k}:".encode())
                        runs = Counter(RUN.findall(t.encode().lower().decode()))  # bytes.lower() knows A-Z only
                        for w, n in runs.items():
                            h = crc32(w.encode(), head)
                            if h % every == 0:
                                at = h % len(w)
                                w = w[:at] + w[at + 1 :]
                            if len(w) >= shortest:
                                seen[w] += n
                if len(seen) > COUNTED:
                    yield _counts(seen)
                    seen.clear()
        if seen:
            yield _counts(seen)

    found = docs.select(F.col(key), F.col(text)).mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rarest)


def _counts(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])


class SuffixRanks:
    """FM-index of delimited words that extends matches to the right, many at a time.

    It is built over the reversed text, so that a step to the right is a backward step of the index: the
    rows that carry a sign, in the order of their signs, hold the next interval's ends.
    """

    def __init__(self, words: list[str]):
        text = "".join(["\x01" + w[::-1] for w in words]) + "\x01"
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        self.signs, dense = np.unique(codes, return_inverse=True)
        self.size, self.n = len(self.signs), len(codes)
        order = _suffixes(dense.astype(np.int64))
        self.before = dense[order - 1].astype(np.int64)  # the sign in front of each suffix, in suffix order
        self.ranks = np.sort(self.before * self.n + np.arange(self.n))
        starts = np.flatnonzero(dense == 0)
        self.word_at = np.zeros(self.n, np.int64)
        self.word_at[starts[:-1]] = np.arange(len(words))
        self.order = order

    def code(self, texts: list[str]) -> np.ndarray:
        """Signs of texts as numbers, -1 beyond their ends and -2 for signs that no word has."""
        width = max(map(len, texts))
        raw = np.frombuffer("".join([t.ljust(width, "\x00") for t in texts]).encode("utf-32-le"), np.uint32).reshape(len(texts), width)
        at = np.searchsorted(self.signs, raw)
        known = self.signs[np.minimum(at, self.size - 1)] == raw
        return np.where(raw == 0, -1, np.where(known, at, -2))

    def step(self, sign, low, high) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after one more sign; empty ones have equal ends."""
        first = np.searchsorted(self.ranks, sign * self.n + low)
        last = np.searchsorted(self.ranks, sign * self.n + high)
        return first, np.where(sign < 0, first, last)

    def next_signs(self, low, high) -> tuple[np.ndarray, np.ndarray]:
        """``state, sign`` of all signs that may come next: read from the rows of narrow intervals, tried for wide ones."""
        narrow = high - low <= 2 * self.size
        states = np.arange(len(low))
        sizes = (high - low)[narrow]
        row = np.repeat(low[narrow] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        pairs = np.unique(np.repeat(states[narrow], sizes) * self.size + self.before[row])
        wide = states[~narrow]
        tried = (wide[:, None] * self.size + np.arange(self.size)).ravel()
        pairs = np.concatenate((pairs, tried))
        return pairs // self.size, pairs % self.size

    def words(self, low) -> np.ndarray:
        """Word of an interval that ends with its delimiters: that of its first suffix."""
        return self.word_at[self.order[low]]


def _suffixes(codes: np.ndarray) -> np.ndarray:
    """Suffix order of a text by doubling ranks; words are short, so few rounds settle all but equal words."""
    rank, n, width = codes, len(codes), 1
    while True:
        follow = np.full(n, -1, np.int64)
        follow[: n - width] = rank[width:]
        both = rank * (n + 2) + follow + 1
        _, rank = np.unique(both, return_inverse=True)
        if rank.max() == n - 1:
            return np.argsort(rank)
        width *= 2


def one_error(index: SuffixRanks, queries: list[str], halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``query, word`` of indexed words that share the query's first half and differ by one edit behind it."""
    signs = index.code(queries)
    size = np.array([len(q) for q in queries])
    signs = np.hstack([signs, np.full((len(queries), 2), -1)])
    rows = np.arange(len(queries))
    low, high = index.step(np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.full(len(rows), index.n))
    found, wrong = [], []  # wrong: states with one error, by the place of the next sign
    query, at = rows, np.zeros(len(rows), np.int64)
    while len(query):
        extend = at >= halves[query]
        if extend.any():
            q, p, a, b = query[extend], at[extend], low[extend], high[extend]
            state, sign = index.next_signs(a, b)
            real = sign > 0  # 0 is the delimiter
            state, sign = state[real], sign[real]
            first, last = index.step(sign, a[state], b[state])
            own = signs[q[state], p[state]]
            ok = first < last
            swap = ok & (sign != own) & (p[state] < size[q[state]])
            wrong.append((q[state][swap], p[state][swap] + 1, first[swap], last[swap]))  # another sign here
            wrong.append((q[state][ok], p[state][ok], first[ok], last[ok]))  # one more sign here
            left = p < size[q]
            wrong.append((q[left], p[left] + 1, a[left], b[left]))  # this sign missing
        more = at < size[query]
        query, at, low, high = query[more], at[more], low[more], high[more]
        low, high = index.step(signs[query, at], low, high)
        live = low < high
        query, at, low, high = query[live], at[live] + 1, low[live], high[live]
    if not wrong:
        return rows[:0], rows[:0]
    query, at, low, high = (np.concatenate(x) for x in zip(*wrong))
    while len(query):
        done = at == size[query]
        if done.any():
            first, last = index.step(np.zeros(int(done.sum()), np.int64), low[done], high[done])
            hit = first < last
            found.append((query[done][hit], index.words(first[hit])))
        query, at, low, high = query[~done], at[~done], low[~done], high[~done]
        low, high = index.step(signs[query, at], low, high)
        live = low < high
        query, at, low, high = query[live], at[live] + 1, low[live], high[live]
    if not found:
        return rows[:0], rows[:0]
    return tuple(np.concatenate(x) for x in zip(*found))


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """``word, near`` of all ordered pairs of ``words(word)`` at exactly one inserted, deleted or replaced code point.

    Words are distinct, not null and have at least two code points.
    """
    spark = words.sparkSession
    sides = words.select("word", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("form")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("form")))).alias("s")).select("word", "s.*")
    size = F.length("form")
    # The exact half of a word: the shorter one in front, what is left of it behind.
    half = lambda n: F.when(F.col("side") == 0, F.floor(n / 2)).otherwise(n - F.floor(n / 2)).cast("int")
    entry = sides.select("word", "side", "form", half(size).alias("half"), F.explode(F.array_distinct(F.array(half(size - 1), half(size), half(size + 1)))).alias("cut"))
    entry = entry.select("word", "form", "side", "half", (F.col("cut") == F.col("half")).alias("asks"), F.concat(F.col("side").cast("string"), F.col("cut").cast("string"), F.expr("substring(form, 1, cut)")).alias("key"))
    entry = materialize(entry, "spelling-keys")
    total = entry.count()
    if not total:
        release(entry)
        return spark.createDataFrame([], "word string, near string")
    crowded = entry.groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") > shard).select("key", F.ceil(F.col("held") / shard).cast("int").alias("split"))
    # Few keys are crowded, at most total / shard; the others need no partner.
    dealt = entry.join(crowded, "key", "left").withColumn("split", F.coalesce("split", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("split")).cast("int")
    spread = F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("split") - 1)).otherwise(F.array(own)))
    dealt = dealt.select("word", "half", "side", "asks", own.alias("own"), "key", spread.alias("salt"))
    shards = max(1, -(-total // shard))
    dealt = dealt.withColumns({"holds": F.col("salt") == F.col("own"), "shard": F.pmod(F.xxhash64("key", "salt"), F.lit(shards)).cast("int")})
    # A word may reach a shard by several keys: it is held once, and asks once from each side.
    dealt = dealt.groupBy("shard", "side", "word").agg(F.max("holds").alias("holds"), F.max("asks").alias("asks"), F.max("half").alias("half"))

    def search(table: pa.Table) -> pa.Table:
        side = table.column("side")[0].as_py()
        words = table.column("word").to_pylist()
        forms = [w[::-1] for w in words] if side else words
        asks, holds, halves = (table.column(c).to_numpy() for c in ("asks", "holds", "half"))
        held, asking = np.flatnonzero(holds), np.flatnonzero(asks)
        if not len(held) or not len(asking):
            return pa.table({"word": pa.array([], pa.string()), "near": pa.array([], pa.string())})
        index = SuffixRanks([forms[i] for i in held])
        a, b = one_error(index, [forms[i] for i in asking], halves[asking])
        pairs = np.unique(asking[a] * len(words) + held[b])
        a, b = pairs // len(words), pairs % len(words)
        keep = a != b
        column = pa.array(words, pa.string())
        return pa.table({"word": column.take(pa.array(a[keep])), "near": column.take(pa.array(b[keep]))})

    pairs = dealt.groupBy("shard", "side").applyInArrow(search, "word string, near string")
    return pairs.distinct()


def group_variants(counts: DataFrame, shard: int = SHARD, factor: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of ``counts(word, n)``.

    ``form`` is the near word of largest ``n`` (ties: the first in code-point order) if its ``n`` is at
    least ``factor`` times the word's, else null; ``root`` is the end of the chain of forms, the word
    itself if it has none. A chain's counts at least double, so it ends, and jumping over twice as many
    words each round ends it in a few rounds.
    """
    counts = counts.select("word", "n")
    pairs = near_words(counts.select("word"), shard)
    rated = pairs.join(counts.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = rated.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    whole = counts.join(best, "word", "left")
    good = -F.col("best.less") >= factor * F.col("n")
    whole = whole.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n"))
    whole = materialize(whole, "spelling-forms")
    # Only words with a form move; links end at words that have none.
    links = materialize(whole.where("form is not null").select("word", F.col("form").alias("to")), "spelling-roots")
    while True:
        ahead = links.select(F.col("word").alias("to"), F.col("to").alias("beyond"))
        moved = materialize(links.join(ahead, "to", "left").select("word", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moves")), "spelling-roots")
        release(links)
        links = moved.select("word", "to")
        links._scratch_path = moved._scratch_path
        if not moved.where("moves").limit(1).count():
            break
    return whole.join(links, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, shortest: int = 5, rarest: int = 3, every: int = 97) -> DataFrame:
    """Words of whole texts with their variants: ``count_words``, then ``group_variants``.

    Null and empty texts and an empty table give no words; repeated rows count again; columns other than
    ``doc_id`` and ``text`` are ignored. The vocabulary is written once and read by each later step.
    """
    return group_variants(materialize(count_words(docs, shortest, rarest, every), "spelling-counts"))
