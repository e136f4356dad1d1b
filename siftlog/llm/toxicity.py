"""Operator 4: toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding lower-cases, maps look-alike letters and digits inside words to plain letters, and turns every
other sign into a blank. Lexicon entries are whole words or beginnings of words. A match inside an
exception phrase does not count. The weighted matches and their number per word give the score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siftlog.llm.texts import filter_texts, map_texts, slices

# Look-alike letters, digits read as letters, seed words and phrases in which they are harmless.
LOOKALIKES = dict(zip("аеорсухіѕјһԁԛԝкмтвнαοεικνρτυχ", "aeopcyxisjhdqwkmtbhaoeikvptux"))
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}
SEEDS = ("idiot", "moron", "scum", "trash", "stupid", "loser", "clown", "worthless", "pathetic", "disgusting")
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "circus clown", "sore loser", "scum line", "pond scum")
INVISIBLE = "­​‌‍⁠﻿"

_inner = re.compile(r"(?<=[a-z])[0134578@$!|]+(?=[a-z])|(?<![a-z0-9])[0134578@$]+(?=[a-z])")


@lru_cache(1)
def _letters() -> dict[int, str | None]:
    """Every code point to a plain or accented letter, a blank, or nothing."""
    table: dict[int, str | None] = {ord(c): None for c in INVISIBLE}
    for code in (*range(0x250), *range(0x370, 0x530), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070), *range(0xFF00, 0xFF5F)):
        ch = chr(code)
        if ch in INVISIBLE:
            continue
        ch = unicodedata.normalize("NFKC", ch).lower()[:1]
        ch = LOOKALIKES.get(ch, ch)
        table[code] = "i" if ch == "l" else ch if ch.isalnum() else " "
    return table | {c: None for c in range(0x300, 0x370)}


@lru_cache(1)
def _plain() -> dict[int, str]:
    """Accented letters to their base, one for one; accents tell words apart, but may also hide a seed word."""
    bases = {code: unicodedata.normalize("NFKD", chr(code))[:1] for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))}
    return {code: "i" if base == "l" else base for code, base in bases.items() if base.isalnum()}


def fold(text: str) -> str:
    """Blank-separated words with a blank at both ends. ``l`` and ``i`` fold to one letter, as 1 may be either."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        for ch in INVISIBLE:
            text = text.replace(ch, "")
        text = text.translate({ord(a): b for a, b in LOOKALIKES.items()})
    text = _inner.sub(lambda m: "".join([DIGITS[c] for c in m.group()]), text)
    return " " + " ".join(text.translate(_letters()).split()) + " "


#: A text of this score or more is predicted to be toxic.
THRESHOLD = 0.3


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


class Lexicon:
    """``entries``: folded pattern (blank first; blank last for a whole word) to weight."""

    def __init__(self, entries: dict[str, float], exceptions=EXCEPTIONS, coefficients=(-4.0, 1.5, 1.0)):
        self.entries, self.exceptions, self.coefficients = entries, tuple(exceptions), tuple(coefficients)
        self._machine = None

    def __getstate__(self):
        return self.__dict__ | {"_machine": None}

    def machine(self):
        if self._machine is None:
            import ahocorasick

            self._machine = ahocorasick.Automaton()
            seeds = {fold(w) for w in SEEDS}
            for phrase in self.exceptions:
                p = fold(phrase)
                self._machine.add_word(p, (len(p), None, True))
            for p, w in self.entries.items():
                self._machine.add_word(p, (len(p), w, p in seeds))
            if self.entries or self.exceptions:
                self._machine.make_automaton()
        return self._machine

    def matches(self, folded: str) -> tuple[float, int]:
        """Sum of weights and number of matches; of matches that begin together the longest counts."""
        machine = self.machine()
        if not len(machine):
            return 0.0, 0
        found, spans = {}, []
        views = [folded] if folded.isascii() else [folded, folded.translate(_plain())]
        for plain, view in enumerate(views):
            for end, (n, weight, seed) in machine.iter(view):
                at = end - n + 1
                if weight is None:
                    spans.append((at, end))
                elif seed or not plain:
                    found[at] = weight
        if spans:
            found = {at: w for at, w in found.items() if not any(a <= at < b for a, b in spans)}
        return sum(found.values()), len(found)

    def features(self, text: str) -> tuple[float, float, int]:
        folded = fold(text)
        weight, n = self.matches(folded)
        words = folded.count(" ") - 1
        return math.log1p(weight), math.log1p(100 * weight / max(1, words)), n

    def score(self, text: str) -> tuple[float, int]:
        a, b, n = self.features(text)
        c = self.coefficients
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, c[0] + c[1] * a + c[2] * b)))), n


def _candidates(folded: str, shortest: int, longest: int) -> set[str]:
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        for n in range(shortest, min(longest, len(w) - 1) + 1):
            out.add(f" {w[:n]}")
    return out


def _sample(docs: DataFrame, labels: DataFrame, per_class: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """Rows of both classes up to a bound each, in the order of a hash of the id, and the true class sizes."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    rows = None
    for k, n in per_class.items():
        own = known.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(n)
        rows = own if rows is None else rows.unionByName(own)
    return docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id"), sizes


def learn_lexicon(docs: DataFrame, labels: DataFrame, max_toxic: int = 4000, max_other: int = 8000, shortest: int = 4, longest: int = 7, min_share: float = 0.003, min_odds: float = 3.0, max_entries: int = 400) -> Lexicon:
    """Learn entries, weights and the calibration from labelled rows that are not held out.

    The sample is bounded by ``max_toxic`` and ``max_other`` rows, so what the driver gets is bounded too.
    An entry must lie in enough toxic texts and hardly any other; entries are taken greedily until every
    toxic text that can be has three. Seed words always belong, and what they cover or begin with is not
    learned again. Without rows of both classes the seeds
    keep a fixed weight and calibration.
    """
    rows, sizes = _sample(docs, labels, {1: max_toxic, 0: max_other})
    seeds = {fold(w): 1.0 for w in SEEDS}
    if not sizes.get(0) or not sizes.get(1):
        return Lexicon(seeds)

    def count(batches):
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for part in slices(batch):
                for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                    for c in _candidates(fold(text or ""), shortest, longest):
                        counts.setdefault(c, [0, 0])[toxic] += 1
        keys = list(counts)
        for i in range(0, len(keys), 50_000):
            ks = keys[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(ks), pa.array([counts[k][1] for k in ks], pa.int64()), pa.array([counts[k][0] for k in ks], pa.int64())], names=["entry", "bad", "good"])

    bad, good = min(sizes[1], max_toxic), min(sizes[0], max_other)
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    found = rows.select("text", "toxic").mapInArrow(count, "entry string, bad bigint, good bigint")
    found = found.groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).withColumn("odds", odds)
    floor = max(6, math.ceil(min_share * bad))
    kept = found.where((F.col("bad") >= floor) & (F.col("odds") >= min_odds)).orderBy(F.desc("bad"), "good", "entry").limit(20_000)
    weights = {r["entry"]: r["odds"] for r in kept.collect() if not any(s.startswith(r["entry"]) for s in seeds)}
    chosen = _cover(rows, weights, set(seeds), shortest, longest, floor, max_entries)
    lexicon = Lexicon(seeds | {e: min(weights[e], 6.0) / 4 for e in chosen})
    return Lexicon(lexicon.entries, lexicon.exceptions, _calibrate(rows, lexicon, sizes))


def _cover(rows: DataFrame, weights: dict[str, float], seeds: set[str], shortest: int, longest: int, floor: int, most: int) -> list[str]:
    wanted = weights.keys() | seeds

    def postings(batches):
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([sorted(c for c in _candidates(fold(t or ""), shortest, longest) if c in wanted) for t in texts], pa.list_(pa.string()))], names=["entries"])

    left = [[set(r["entries"]) - seeds, max(0, 3 - len(seeds.intersection(r["entries"])))] for r in rows.where("toxic = 1").select("text").mapInArrow(postings, "entries array<string>").distinct().collect()]
    chosen: list[str] = []
    while len(chosen) < most:
        gain = Counter(e for entries, need in left if need for e in entries)
        if not gain:
            break
        best = max(gain, key=lambda e: (gain[e], weights[e], -len(e), e))
        if gain[best] < max(3, floor // 4):
            break
        chosen.append(best)
        for x in left:
            if best in x[0]:
                x[0].discard(best)
                x[1] -= 1
                x[1] = max(0, x[1])
    return chosen


def _calibrate(rows: DataFrame, lexicon: Lexicon, sizes: dict[int, int]) -> tuple[float, float, float]:
    """Logistic regression on the two features, weighted to the true class sizes; Newton steps on the driver."""
    import numpy as np

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                f = [lexicon.features(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in f], pa.float64()), pa.array([x[1] for x in f], pa.float64()), part.column("toxic")], names=["a", "b", "toxic"])

    data = rows.select("text", "toxic").mapInArrow(run, "a double, b double, toxic int").toPandas()
    y = data["toxic"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return lexicon.coefficients
    x = np.column_stack([np.ones(len(y)), data["a"], data["b"]])
    weight = np.where(y == 1, sizes[1] / y.sum(), sizes[0] / (1 - y).sum())
    beta = np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1.0, 1.0]), x.T @ (weight * (y - p)) - np.array([1e-3, 1.0, 1.0]) * beta)
        beta += step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(b) for b in beta)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, score, n_matches`` of every whole text, from the text alone. Null and empty texts have no match.

    No shuffle; repeated rows and null ids pass; other columns are ignored.
    """

    def make(_, texts):
        found = [lexicon.score(t) for t in texts]
        return [pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64())]

    return map_texts(docs, make, "score double, n_matches bigint")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` whose text scores under ``threshold``, with all their columns; the verdict stays on its row, so ids don't matter."""
    return filter_texts(docs, lambda texts: [lexicon.score(t)[0] < threshold for t in texts])


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Learn from ``labels(doc_id, toxic)`` and score all documents: ``doc_id, held_out, score, predicted, n_matches``."""
    found = score(docs, learn_lexicon(docs, labels))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_matches")
