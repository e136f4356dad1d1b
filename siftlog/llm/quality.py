"""Operator 3: a quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every text. Expectation-maximisation over
the counts of vote patterns of all documents estimates each labeller's accuracy on both classes, and so
a posterior for every pattern. The posteriors of a bounded sample train a linear scorer over hashed
word-shape features, which then scores every document.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftlog.llm.bpe import Words
from siftlog.llm.texts import map_texts
from siftlog.scratch import materialize, release

#: Labellers in the order of their votes in a pattern; each vote is b (bad), g (good) or - (none).
LABELLERS = ("upper", "signs", "stutter", "variety", "bars", "lines", "prose", "rhythm")
BUCKETS = 1024

_letters = str.maketrans({c: "A" for c in map(chr, range(0x250)) if c.isupper()} | {c: "a" for c in map(chr, range(0x250)) if c.islower()} | {c: "0" for c in "0123456789"})
_run = re.compile(r"(.)\1+")
_sign = re.compile(r"[#$%&*<>{}=~^\\@|!]{2,}|[{}<>|]")


def shape(word: str) -> int:
    """Hash bucket of a word's shape: runs of capitals, small letters, digits and the signs as they are."""
    return zlib.crc32(_run.sub(r"\1\1", word.translate(_letters)).encode()) % (BUCKETS - 64) + 64


def _vote(value: float, bad, good) -> str:
    return "b" if bad(value) else "g" if good(value) else "-"


def signals(text: str) -> dict[str, float]:
    words = text.split()
    n = len(words)
    if not n:
        return dict.fromkeys(("n", "upper", "signs", "stutter", "variety", "bars", "lines", "sentences", "length"), 0.0)
    ups = sum(map(str.isupper, words))
    lines = [x for x in re.split(r"[\n.]", text) if len(x) > 12]
    return {
        "n": float(n),
        "upper": ups / n,
        "signs": len(_sign.findall(text)) / n,
        "stutter": sum(map(str.__eq__, words, words[1:])) / n,
        "variety": len(set(words)) / n ** 0.9,
        "bars": text.count(" | ") / n,
        "lines": 1 - len({x.strip() for x in lines}) / len(lines) if len(lines) > 5 else 0.0,
        "sentences": sum(w[-1] in ".,;:?" for w in words) / n,
        "length": len(text) / n,
    }


def votes(s: dict[str, float]) -> str:
    """One letter per labeller. Thresholds are fixed rules of thumb; the model learns how far to trust them.

    Each kind of junk has a labeller that votes bad or not at all; two labellers vote on plain prose.
    """
    n, none = s["n"], lambda x: False
    plain = s["upper"] < 0.2 and s["signs"] < 0.05 and s["bars"] < 0.02 and s["stutter"] < 0.1
    return "".join(
        (
            _vote(s["upper"], lambda x: x > 0.5 and n > 5, none),
            _vote(s["signs"], lambda x: x > 0.2 and n > 5, none),
            _vote(s["stutter"], lambda x: x > 0.3 and n > 5, none),
            _vote(s["variety"], lambda x: x < 0.35 and n > 30, none),
            _vote(s["bars"], lambda x: x > 0.2, none),
            _vote(s["lines"], lambda x: x > 0.5, none),
            _vote(s["sentences"], lambda x: not plain and n > 5, lambda x: plain),
            _vote(s["length"], lambda x: x > 25 or x < 1.5, lambda x: s["variety"] > 0.5 or n < 30),
        )
    )


def _features(words: list[str], shapes: Words, s: dict[str, float]) -> tuple[list[int], list[float]]:
    """Share of each hashed shape, and the signals in steps: buckets below 64 are kept for those."""
    n = max(1, len(words))
    counts: dict[int, float] = {}
    for b in map(shapes.__getitem__, words):
        counts[b] = counts.get(b, 0) + 1
    out = {b: c / n for b, c in counts.items()}
    for i, name in enumerate(("upper", "signs", "stutter", "variety", "bars", "lines", "sentences")):
        out[i * 8 + min(7, int(s[name] * 8))] = 1.0
    keys = sorted(out)
    return keys, [out[k] for k in keys]


def observe(docs: DataFrame) -> DataFrame:
    """``doc_id, pattern, buckets, shares``: the votes on and the features of every whole text, in one pass."""

    def make(_, texts):
        shapes = Words(shape, 100_000)
        patterns, buckets, shares = [], [], []
        for text in texts:
            s = signals(text)
            patterns.append(votes(s))
            b, x = _features(text.split(), shapes, s)
            buckets.append(b)
            shares.append(x)
        return [pa.array(patterns, pa.string()), pa.array(buckets, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))]

    return map_texts(docs, make, "pattern string, buckets array<int>, shares array<float>")


def fit_labellers(counts: dict[str, int], rounds: int = 200, prior: float = 0.15) -> dict[str, float]:
    """Posterior of 'bad' for each vote pattern by EM over pattern counts (at most 3^8 of them).

    Votes are independent given the class; each labeller has its own rates of b, g and no vote in either
    class. Starts from votes that are mostly right; those rates also count as ten documents of each class.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}
    weight = np.array([counts[p] for p in patterns], float)
    vote = np.array([["bg-".index(c) for c in p] for p in patterns])
    m = vote.shape[1]
    start = np.array([[[0.02, 0.4, 0.58]] * m, [[0.3, 0.1, 0.6]] * m])
    rate = start.copy()
    share = prior
    post = np.zeros(len(patterns))
    for _ in range(rounds):
        log = [np.log(rate[k])[np.arange(m), vote].sum(axis=1) for k in (0, 1)]
        gap = np.clip(log[1] + np.log(share) - log[0] - np.log(1 - share), -40, 40)
        before, post = post, 1 / (1 + np.exp(-gap))
        for k, r in ((1, post * weight), (0, (1 - post) * weight)):
            for v in range(3):
                rate[k, :, v] = (((vote == v) * r[:, None]).sum(axis=0) + 10 * start[k, :, v]) / (r.sum() + 10)
        share = float(np.clip((post * weight).sum() / weight.sum(), 0.001, 0.5))
        if np.abs(post - before).max() < 1e-9:
            break
    return dict(zip(patterns, post.tolist()))


def fit_scorer(rows: list, steps: int = 400) -> np.ndarray:
    """Logistic weights, the last one the intercept, for (buckets, shares, posterior) rows; on the driver."""
    x = np.zeros((len(rows), BUCKETS + 1), np.float32)
    x[:, -1] = 1
    for i, (b, s, _) in enumerate(rows):
        x[i, list(b)] = s
    y = np.array([r[2] for r in rows], np.float32)
    bad = max(1e-6, float(y.mean()))
    weight = y / (2 * bad) + (1 - y) / (2 * max(1e-6, 1 - bad))
    w, sq = np.zeros(BUCKETS + 1, np.float32), np.full(BUCKETS + 1, 1e-8, np.float32)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) / len(y) + 1e-4 * w
        sq += g * g
        w -= 0.3 * g / np.sqrt(sq)
    return w


def classify(docs: DataFrame, max_sample: int = 6000, threshold: float = 0.5) -> DataFrame:
    """``doc_id, pattern, weak_bad, score, predicted`` for every document; predicted 1 means good quality.

    ``score`` is the scorer's probability of good quality. Vote counts cover all documents; the scorer is
    fitted on at most ``max_sample`` of them: half with a posterior over one half, half under, those with
    the smallest hash of their features, so that copies don't crowd it out; rows are counted first, and
    only hashes under about twice the bound leave a task. Null and empty texts have no features and, with them, the intercept's score raised to good:
    nothing speaks against them. Repeated rows and null ids pass; other columns are ignored; an empty
    table gives no rows. No key is shuffled but the vote pattern, whose counts are aggregated map-side.
    """
    spark = docs.sparkSession
    seen = observed = materialize(observe(docs), "observed")
    counts = {r["pattern"]: r["n"] for r in seen.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    posterior = fit_labellers(counts)
    table = spark.createDataFrame([(p, float(v)) for p, v in posterior.items()] or [("", 0.0)], "pattern string, weak_bad double")
    seen = seen.join(F.broadcast(table), "pattern")
    hashed = F.xxhash64("buckets", "shares")
    sample = []
    for bad in (True, False):
        kind = "weak_bad > 0.5" if bad else "weak_bad <= 0.5 and pattern like '%g%'"
        rows = sum(n for p, n in counts.items() if (posterior[p] > 0.5) == bad and (bad or "g" in p))
        share = min(1.0, max_sample / max(1, rows))
        part = seen.where(kind).where(F.pmod(hashed, F.lit(1 << 30)) < int(share * (1 << 30)))
        part = part.select("buckets", "shares", "weak_bad", "pattern").dropDuplicates(["buckets", "shares"])
        sample += [(r["buckets"], r["shares"], r["weak_bad"]) for r in part.orderBy(hashed, "pattern").limit(max_sample // 2).collect()]
    if sample and min(r[2] for r in sample) < 0.5 < max(r[2] for r in sample):
        w = fit_scorer(sample)
    else:
        w = np.zeros(BUCKETS + 1, np.float32)
        w[-1] = -5.0
    weights = F.lit([float(v) for v in w[:-1]])
    seen = seen.withColumn("weights", weights)
    linear = F.expr("aggregate(zip_with(buckets, shares, (b, x) -> x * element_at(weights, b + 1)), 0D, (a, x) -> a + x)")
    bad = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), linear + F.lit(float(w[-1]))))))
    score = F.when(F.size("buckets") == 7, F.lit(1.0)).otherwise(1 - bad)
    out = seen.select("doc_id", "pattern", "weak_bad", score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    out = materialize(out, "quality")
    release(observed)
    return out
