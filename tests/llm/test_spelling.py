"""Spelling variants against plain counting and comparing."""

import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np

from siftlog.llm.queries import QUERIES
from siftlog.llm.spelling import SuffixRanks, count_words, group_variants, near_words, one_error


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute(docs, shortest=5, rarest=3):
    """Rows of the operator, by counting all runs and meeting words that share themselves or a shortened form."""
    n = Counter()
    for d, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c < "\x80" else c for c in w)
            h = crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if c >= rarest and len(w) >= shortest}
    meet = defaultdict(set)
    for w in n:
        for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            meet[k].add(w)
    near = defaultdict(set)
    for group in meet.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def rows(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_one_error_behind_the_half():
    r = random.Random(1)
    words = sorted({"".join(r.choice("abcé") for _ in range(r.randint(5, 8))) for _ in range(700)})
    a, b = one_error(SuffixRanks(words), words, np.array([len(w) // 2 for w in words]))
    got = {(words[x], words[y]) for x, y in zip(a, b) if x != y}
    assert got == {(p, q) for p in words for q in words if one_edit(p, q) and p[: len(p) // 2] == q[: len(p) // 2]}
    none = one_error(SuffixRanks(["abcde"]), ["zzzzz", "ab"], np.array([2, 1]))
    assert len(none[0]) == 0


def test_near_words_with_crowded_keys(spark):
    """All words share their first half and most a last one; shards of 30 words split those keys."""
    r = random.Random(2)
    words = sorted({"ab" + "".join(r.choice("abc") for _ in range(r.randint(3, 5))) for _ in range(300)} | {"à" + "b" * 5, "b" * 6, "ÿÿÿÿÿ"})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for shard in (30, 8000):
        got = near_words(df, shard).collect()
        assert {tuple(x) for x in got} == {(p, q) for p in words for q in words if one_edit(p, q)} and len(got) == len({tuple(x) for x in got})


def test_chains_and_ties(spark):
    counts = [("colour", 3), ("colours", 6), ("coloursa", 12), ("colourb", 6), ("alone", 9), ("later", 5), ("laser", 9), ("layer", 9)]
    got = rows(group_variants(spark.createDataFrame(counts, "word string, n bigint")))
    assert got["colour"] == ("colourb", "colourb", 3, 2, 6)  # equal counts: the first in order
    assert got["colours"] == ("coloursa", "coloursa", 6, 3, 12)
    assert got["later"] == (None, "later", 5, 2, None) and got["alone"] == (None, "alone", 9, 0, None)
    long = [("a" * 5 + "b" * i, 2**i) for i in range(1, 20)]
    got = rows(group_variants(spark.createDataFrame(long, "word string, n bigint")))
    assert {v[1] for v in got.values()} == {"aaaaa" + "b" * 19}


def test_rows_that_count(spark):
    """Null texts and ids, long texts, other columns with the names of results, repeated rows, no rows."""
    docs = [(1, "Élan élan Élan ÉLAN naïveté naïvete NAÏVETÉ naivete", 1), (None, "Wörter wörter worter Wörter worter worter", 2), (3, None, 3), (4, "", 4)]
    docs += [(5, "colour color " * 4000 + "colours", 5)] * 2 + [(i, "colour colours colours×x", 0) for i in range(10, 30)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, n int").withColumnRenamed("n", "word")
    got = rows(group_variants(count_words(df)))
    assert got == brute([d[:2] for d in docs])
    assert group_variants(count_words(df.limit(0))).count() == 0


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got, want = rows(QUERIES["op13_spelling"](spark, folder)), brute(docs)
    assert got == want and len(want) > 100 and any(v[0] for v in want.values())
