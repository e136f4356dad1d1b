"""Operators 6, 7, 9 and 10 against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from siftlog.llm.fingerprints import _with_bucket, edited_neighbours, fingerprints
from siftlog.llm.jaccard import Sketches, _units, jaccard_components, sketch
from siftlog.llm.passages import _held, _slices, align, chains, remove_passages, repeated_passages, winnow, without
from siftlog.llm.vectors import near_vectors, passes_for


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def corpus(seed):
    r = random.Random(seed)
    line = " ".join(f"common{i}" for i in range(9))
    docs = []
    for g in range(30):
        words = [f"w{r.randint(0, 60)}" for _ in range(r.randint(20, 90))]
        for _ in range(r.choice([1, 1, 2, 6])):
            own = list(words)
            for _ in range(r.randint(0, 1)):
                own[r.randrange(len(own))] = f"x{r.randint(0, 500)}"
            docs.append((line + " " if r.random() < 0.5 else "") + " ".join(own))
    return docs + [None, "", "  \n ", "one", "ONE", "one two", line, line, line + " z", "\x1cone"]


@pytest.mark.parametrize("k,percent,often", [(4, 85, 200), (5, 80, 2), (2, 60, 3)])
def test_jaccard_equals_brute_force(spark, k, percent, often):
    docs = corpus(k)
    rows = [(i * 3, t, "clash", 1) for i, t in enumerate(docs)]
    got = {r["doc_id"]: r for r in jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string, component string, n int"), k, percent, often=often).collect()}
    sets = {i * 3: shingle_set(t, k) for i, t in enumerate(docs)}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    assert len(links) > 20
    want = roots(sets, links)
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[d]) for d, r in got.items())


def test_jaccard_edges(spark):
    schema = "doc_id bigint, text string"
    assert jaccard_components(spark.createDataFrame([], schema)).count() == 0
    got = jaccard_components(spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f"), (1, "q"), (7, None)], schema)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None) == [(False, 1, 1), (False, 1, 1), (False, 2, 1), (False, 7, 7)]
    assert len(got) == 5


def test_vectors_equal_brute_force(spark):
    r = np.random.default_rng(5)
    centres = r.standard_normal((40, 16))
    x = np.concatenate([c + 0.05 * r.standard_normal((n, 16)) for c, n in zip(centres, [60, 30] + [2] * 20 + [1] * 18)])
    chain = np.array([[np.cos(a), np.sin(a)] + [0] * 14 for a in np.arange(8) * 0.4])
    x = np.concatenate([x, x[:5], x[:1], chain])
    rows = [(i, [float(v) for v in e], 0) for i, e in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [None] + [1.0] * 15), (904, [float("nan")] + [1.0] * 15), (905, [float("inf")] + [1.0] * 15), (906, [1.0] * 3)]
    df = spark.createDataFrame(rows + [(i, e, 0) for i, e in odd], "vec_id bigint, embedding array<double>, component int")
    got = {v["vec_id"]: v for v in near_vectors(df, window=6, rows_per_part=60, block=16).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    want = roots(range(len(x)), list(zip(*np.nonzero(near))))
    assert {i: got[i]["component_id"] for i in range(len(x))} == want
    assert [got[i]["n_links"] for i in range(len(x))] == near.sum(axis=1).tolist()
    assert all(got[i]["kept"] == (want[i] == i) for i in range(len(x)))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i, _ in odd)
    assert near_vectors(df.limit(0)).count() == 0


def winnowed(grams, w):
    out = set()
    for i in range(max(1, len(grams) - w + 1)):
        window = grams[i : i + w]
        out.add(i + max(j for j in range(len(window)) if window[j] == min(window)))
    return sorted(out)


def test_winnow():
    r = random.Random(1)
    for _ in range(50):
        g = [r.randint(0, 5) for _ in range(r.randint(1, 40))]
        assert winnow(np.array(g, np.uint64), 4).tolist() == winnowed(g, 4)


def brute_chain(pos, at, k, cost):
    best = []
    order = sorted(range(len(pos)), key=lambda i: (pos[i], at[i]))
    score = {}
    for i in order:
        score[i] = k + max([0.0] + [score[j] - cost * (pos[i] - pos[j] + at[i] - at[j]) for j in score if pos[j] < pos[i] and at[j] < at[i]])
        best.append(score[i])
    return max(best)


@pytest.mark.parametrize("seed", range(5))
def test_chain_score(seed):
    """The best chain's score, from its ends and number of matches, is the dynamic programme's."""
    r = random.Random(seed)
    pos, at = [r.randint(0, 60) for _ in range(25)], [r.randint(0, 60) for _ in range(25)]
    got = max(8 * n - 0.05 * (b - a + d - c) for a, b, c, d, n in chains(np.array(pos), np.array(at), 8, 0.05, 10**6))
    assert got == pytest.approx(brute_chain(pos, at, 8, 0.05))


def test_align_finds_edges():
    x = np.array([900, 901, *range(60), 902], np.uint32)
    y = np.array([800, *range(30), 777, *range(30, 60), 801, 802], np.uint32)
    a, b, c, d, same = align(x, y, 20, 28, 19, 27)
    assert (a, b, c, d, same) == (2, 62, 1, 62, 60)


def passage_rows():
    r = random.Random(9)
    fresh = lambda n: [f"u{r.randint(0, 10**9)}" for _ in range(n)]
    p, q = fresh(70), fresh(55)
    fuzzy = list(p)
    for i in (20, 45):
        fuzzy[i] = "changed"
    del fuzzy[33]
    rows = [(1, fresh(100)), (2, fresh(30) + p + fresh(40)), (3, fresh(300) + p + fresh(5)), (4, fuzzy + fresh(60)), (5, q + fresh(20)), (6, fresh(10) + q), (7, fresh(20) + p[:40] + fresh(30)), (8, p)]
    return [(i, " ".join(w), len(" ".join(w))) for i, w in rows], p


def test_passages(spark):
    rows, p = passage_rows()
    docs = spark.createDataFrame([*rows, (9, None, 0), (10, "", 0), (None, rows[1][1], 0)], "doc_id bigint, text string, n_chars bigint")
    found = repeated_passages(docs)
    got = {r["doc_id"]: r for r in found.collect()}
    assert set(got) == {3, 4, 6, 8}
    assert (got[3]["start_word"], got[3]["n_words"], got[3]["source_doc_id"], got[3]["source_start_word"]) == (300, 70, 2, 30)
    assert (got[8]["n_words"], got[6]["n_words"], got[6]["source_doc_id"]) == (70, 55, 5)
    assert got[4]["n_words"] == 69 and got[4]["equal_words"] == 67
    cut = {r["doc_id"]: r for r in remove_passages(docs, found).collect()}
    assert cut[8]["text"] == "" and cut[2]["text"] == rows[1][1] and cut[9]["text"] is None
    assert len(cut[3]["text"].split()) == 305 and cut[3]["n_chars"] == len(cut[3]["text"])
    assert repeated_passages(docs.limit(0)).count() == 0


def test_without():
    assert without("a b  c\nd e", [(1, 2)]) == "a d e"
    assert without("a b c d e", [(0, 1), (3, 5)]) == "b c "
    assert without("a b c", [(0, 2), (1, 2)]) == ""


def test_fingerprints(spark):
    r = random.Random(2)
    words = lambda n: " ".join(f"w{r.randint(0, 10**6)}" for _ in range(n))
    shared = words(40)
    texts = {5: words(300), 4: words(20), 3: shared + " " + words(200), 2: words(150) + " " + shared, 1: "", 0: None, 9: "ab😀c", 8: "ab😀c", 7: "x" * 5000}
    df = spark.createDataFrame([(k, v, "z") for k, v in texts.items()], "doc_id bigint, text string, fingerprint string")
    got = {x["doc_id"]: x for x in edited_neighbours(df, rows_per_bucket=2).collect()}
    order = sorted(texts, reverse=True)
    for i, k in enumerate(order):
        t, n = texts[k] or "", texts[order[(i + 1) % len(order)]] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert (got[k]["n_chars"], got[k]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
    assert got[9]["near_next"] == 1.0 and got[9]["fingerprint"] == got[8]["fingerprint"]
    assert got[5]["near_edited"] > 0.2 and got[5]["near_next"] < 0.05
    assert got[3]["near_next"] > 0
    assert {x["doc_id"]: x["fingerprint"] for x in fingerprints(df).collect()} == {k: x["fingerprint"] for k, x in got.items()}
    assert edited_neighbours(df.limit(0)).count() == 0
    assert edited_neighbours(df.where("doc_id = 5")).first()["near_next"] == 1.0


def test_match_guarantee(spark):
    """Texts with 20 equal words in a row (window + k - 1) share a hash, whatever is around them."""
    r = random.Random(3)
    words = lambda n: [f"w{r.randint(0, 10**6)}" for _ in range(n)]
    rows = []
    for i in range(20):
        run = words(20)
        rows += [(2 * i, " ".join(words(60) + run + words(r.randint(0, 60)))), (2 * i + 1, " ".join(words(r.randint(40, 60)) + run + words(9)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x["doc_id"]: x["near_next"] for x in edited_neighbours(df).collect()}
    assert all(got[2 * i + 1] > 0 for i in range(20))


def test_passages_stitched_from_two_documents(spark):
    """Two earlier documents with the halves of a passage don't hide the document that has all of it."""
    r = random.Random(4)
    fresh = lambda n: [f"u{r.randint(0, 10**9)}" for _ in range(n)]
    p, q = fresh(60), fresh(60)
    rows = [(1, fresh(40) + p[:30] + fresh(40)), (2, fresh(50) + p[30:] + fresh(30)), (3, fresh(30) + p + fresh(40)), (4, fresh(20) + p + fresh(60))]
    rows += [(i + 5, fresh(20) + q[10 * i : 10 * i + 20] + fresh(60)) for i in range(5)] + [(10, fresh(60) + q + fresh(20)), (11, q + fresh(60))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")
    got = {(x["doc_id"], x["source_doc_id"], x["start_word"], x["n_words"]) for x in repeated_passages(docs).collect()}
    assert got == {(4, 3, 20, 60), (11, 10, 0, 60)}


def test_passages_with_random_edits(spark):
    """Every planted pair down to the identity is found; one well under it is not."""
    r = random.Random(5)
    fresh = lambda n: [f"u{r.randint(0, 10**9)}" for _ in range(n)]
    rows, planted = [], {}
    for n, edits in [(60, 3), (60, 6), (60, 12), (80, 8), (100, 15), (100, 20), (60, 24)] * 10:
        p = fresh(n)
        copy = list(p)
        for i in r.sample(range(3, n - 3), edits):
            copy[i] = fresh(1)[0]
        planted[len(rows) + 1] = edits <= 0.2 * n
        rows += [(len(rows), " ".join(fresh(30) + p + fresh(30))), (len(rows) + 1, " ".join(fresh(20) + copy + fresh(40)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x["doc_id"]: x for x in repeated_passages(docs).collect()}
    assert all(x["source_doc_id"] == i - 1 and x["equal_words"] >= 0.8 * x["n_words"] for i, x in got.items())
    caught = [i in got for i, wanted in planted.items() if wanted]
    assert sum(caught) == len(caught) == 60


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_jaccard_of_many_copies_just_under_the_threshold(spark, kind):
    """One text with 1 to 5 changed words in 300 copies, in small blocks: many pairs lie close to the threshold."""
    r = random.Random(8)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(120)]
    rows = []
    for i in range(300):
        own = list(base)
        for j in r.sample(range(len(own)), r.randint(1, 5)):
            own[j] = f"x{r.randint(0, 10**6)}"
        rows.append((i, " ".join(own)))
    sets = {i: shingle_set(t, 4) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = roots(sets, links)
    assert len(links) > 300 and len(set(want.values())) > 20
    name = (lambda i: i) if kind == "bigint" else (lambda i: f"d{i:04d}")
    df = spark.createDataFrame([(name(i), t) for i, t in rows], f"doc_id {kind}, text string")
    got = {x["doc_id"]: x["component_id"] for x in jaccard_components(df, 4, 85, block=64).collect()}
    assert got == {name(i): name(c) for i, c in want.items()}


def test_sketches_bound_the_difference():
    """A sketch never claims more differing tokens than there are, whatever the sizes, and few less for small sets."""
    r = np.random.default_rng(4)
    pool = r.integers(0, 1 << 63, 9000).astype(np.uint64)
    sets = [np.unique(r.choice(pool, n, replace=False)) for n in (1, 2, 60, 64, 65, 120, 130, 255, 257, 1000, 1100, 2500, 5000)]
    close = [np.concatenate([s[2:], r.integers(0, 1 << 63, 2).astype(np.uint64)]) for s in sets]
    marks = Sketches(pa.array([sketch(s) for s in sets + close]))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets + close):
            if max(len(x), len(y)) <= 2 * min(len(x), len(y)):
                differ = len(np.setxor1d(x, y))
                assert marks.differ(np.array([i]), np.array([j]))[0] <= differ
                assert j != len(sets) + i or differ - marks.differ(np.array([i]), np.array([j]))[0] <= 2


def test_sketches_rule_out_unlike_long_sets():
    """Long texts that share next to nothing are told apart by the first sketches."""
    r = np.random.default_rng(5)
    for n in (300, 3000, 4700, 8000, 12000, 20000, 40000):
        x, y = (np.unique(r.integers(0, 1 << 63, n).astype(np.uint64)) for _ in "xy")
        marks = Sketches(pa.array([sketch(x), sketch(y)]))
        near, _ = marks.near(np.array([0]), np.array([1]), np.array([20 * (len(x) + len(y)) // 180]))
        assert not len(near), n


def test_texts_without_chains_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, f"a{i} b c d e") for i in range(300)] + [(None, "a b")], "doc_id bigint, text string")
    wanted = spark.createDataFrame([(7, [(1, 3)]), (9, [(0, 2), (4, 99)])], "doc_id bigint, ranges array<struct<lo:int,hi:int>>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cut = _slices(docs, wanted, "bigint")
        assert sorted((x["doc_id"], x["lo"], len(x["words"]) // 4) for x in cut.collect()) == [(7, 1, 2), (9, 0, 2), (9, 4, 1)]
        plan = cut._jdf.queryExecution().executedPlan().toString()
        assert "LeftSemi" in plan[plan.index("SortMergeJoin") :]  # below the join with the ranges
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_short_text_against_long_one(spark):
    """A text of characters only and one of words only are compared by characters; brute-force windows agree."""
    r = random.Random(6)
    words = [f"w{r.randint(0, 10**6)}" for _ in range(70)]
    rows = [(3, " ".join(words[:31])), (2, " ".join(words)), (1, " ".join(words[:31])), (0, "q")]
    got = {x["doc_id"]: x for x in edited_neighbours(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert 0.3 < got[3]["near_next"] < 0.7 and got[2]["near_next"] == got[3]["near_next"]
    assert 0 < got[2]["near_edited"] <= 1 and got[1]["near_next"] == 0 and got[3]["fingerprint"] == got[1]["fingerprint"]


def test_fingerprint_ranges_are_even(spark):
    """Outlying ids, one id with a third of all rows and null ids: rows are spread, and each meets the next in the whole order."""
    r = random.Random(8)
    ids = [*range(1000, 1500), -(2**60), 2**61, *[77] * 500, *[None] * 400, *r.sample(range(10**9), 200)]
    rows = [(i, f"text {n} " + "".join(r.choice("abcd") for _ in range(r.randint(0, 30)))) for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    held = _with_bucket(df, 50, 1000)
    assert max(x["count"] for x in held.groupBy("bucket").count().collect()) <= 110
    hashes = dict(df.select("text", F.xxhash64("text")).collect())
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), hashes[x[1]]))
    got = {x["edited_sha256"] for x in edited_neighbours(df, 50, 1000).collect()}
    want = set()
    for (_, t), (_, u) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        want.add(hashlib.sha256((t[: len(t) - half] + u[:half]).encode()).hexdigest())
    assert got == want


def test_fingerprint_positions_equal_brute_force(spark):
    """Chosen hashes and positions are the rightmost minima of every window of the grams' hashes."""
    r = random.Random(7)
    texts = [" ".join(f"w{r.randint(0, 9)}" for _ in range(n)) for n in (1, 4, 5, 40, 90, 300)]
    grams = []
    for t in texts:
        w = t.split()
        units, k, window = (w, 5, 16) if len(w) >= 32 else (list(t), 4, 2)
        grams.append(([units[i : i + k] for i in range(max(1, len(units) - k + 1))], window))
    df = spark.createDataFrame([(i, g) for i, (g, _) in enumerate(grams)], "doc_id int, grams array<array<string>>")
    hashes = {x[0]: x[1] for x in df.selectExpr("doc_id", f"transform(grams, g -> shiftright(xxhash64(g) & {0x7FFFFFFFFF000000}L, 24))").collect()}
    got = {x["doc_id"]: x["fingerprint"] for x in fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    for i, (_, window) in enumerate(grams):
        want = [f"{hashes[i][p]:x}@{p}" for p in winnowed(hashes[i], window)]
        parts = got[i].split()  # "w", its grams, "c", its grams; a hash may begin with c
        at = parts.index("c") if "c" in parts else len(parts)
        own = parts[1:at] if len(texts[i].split()) >= 32 else parts[at + 1 :]
        assert own == want


def test_passages_of_text_that_repeats_itself(spark):
    prose = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    rows = [(1, prose("a", 80) + ["na"] * 130 + prose("b", 80)), (2, prose("c", 80) + ["na"] * 400 + prose("d", 80))]
    found = repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id int, text string")).collect()
    covered = {p for r in found for p in range(r.start_word, r.start_word + r.n_words)}
    assert {r.doc_id for r in found} == {2} and all(r.equal_words >= 0.8 * r.n_words for r in found)
    assert len(covered & set(range(80, 480))) >= 375 and len(covered - set(range(80, 480))) <= 16


def test_vectors_out_of_the_range_of_squares(spark):
    a, b = np.array([1.0, 2.0, 3.0]), np.array([1.0, 2.0, 3.1])
    rows = [(i, (v * f).tolist()) for i, (v, f) in enumerate((v, f) for v in (a, b) for f in (1e200, 1.0, 1e-200))] + [(9, [-1e200, 0.0, 1e200])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert got == {i: (5, 0) for i in range(6)} | {9: (0, 9)}


def test_passes_grow_slowly_with_the_vectors():
    found = [passes_for(10**n, 0.9, 32, 0.04) for n in range(10)]
    assert found == sorted(found) and found[0] == 1 and found[5] < 25 and found[9] < 200


@pytest.mark.parametrize("lean", [0.0, 0.7, 0.8])
def test_vectors_recall(spark, tmp_path, lean):
    """Links of all rows by brute force against those found, for pairs close to the threshold; ``lean``: cosine of any two vectors."""
    r = np.random.default_rng(11)
    x = r.standard_normal((20_000 if not lean else 12_000, 32 if not lean else 128))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = np.sqrt(1 - lean) * x + np.sqrt(lean / x.shape[1])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = r.standard_normal((600, x.shape[1])) + (0 if not lean else np.sqrt(lean / (1 - lean)) * np.ones(x.shape[1]))
    side -= (side * x[:600]).sum(axis=1, keepdims=True) * x[:600]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = r.uniform(0.9, 0.93, (600, 1))
    x = np.concatenate([x, c * x[:600] + np.sqrt(1 - c * c) * side])
    want = {(i + a, int(j)) for a in range(0, len(x), 2000) for i, j in zip(*np.nonzero(x[a : a + 2000] @ x.T >= 0.9)) if i + a < j}
    table = pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), x.shape[1]).cast(pa.list_(pa.float64()))})
    pq.write_table(table, str(tmp_path / "vectors.parquet"))
    got = {v["vec_id"]: v["component_id"] for v in near_vectors(spark.read.parquet(str(tmp_path / "vectors.parquet"))).collect()}
    assert len(want) >= 600 and sum(got[u] == got[v] for u, v in want) >= 0.95 * len(want)


def test_held_seeds_meet_the_smallest_document(spark):
    """All seeds are shuffled once, also those of one token that has most rows."""
    r = random.Random(7)
    seeds = sorted({(r.choice([1, 1, 1, 5, -3, r.randrange(90)]), r.randrange(40), r.randrange(30)) for _ in range(900)} | {(777, 3, p) for p in range(20)} | {(778, 4, 2), (778, 9, 1)})
    own = {}
    for token, doc, pos in seeds:
        own.setdefault(token, []).append((doc, pos))
    expected = [(t, d, p, *min(o)) for t, o in own.items() if len({x[0] for x in o}) > 1 for d, p in o]
    frame = spark.createDataFrame(r.sample(seeds, len(seeds)), "token bigint, doc_id bigint, pos int")
    found = _held(frame)
    plan = found._jdf.queryExecution().sparkPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    named = _held(frame.withColumn("doc_id", F.lpad(F.col("doc_id").cast("string"), 3, "0")))
    assert sorted((t, int(d), p, int(s), a) for t, d, p, s, a in named.collect()) == sorted(expected)


def test_units_of_large_entries(spark):
    """All sets of different components meet in one unit at least, units are bounded, and an entry that one
    component fills makes rows in proportion to it, not to its square."""
    sizes = {"small": [3, 2], "filled": [900, 5], "mixed": [60, 40, 30, *[1] * 70], "alone": [1] * 150}
    index, comp = [], {}
    for e, parts in enumerate(sizes.values()):
        for p, m in enumerate(parts):
            for i in range(m):
                doc = e * 10_000 + p * 1000 + i
                comp[doc] = e * 100 + p
                index.append((e, doc, 9, comp[doc], sum(parts)))
    rows = _units(spark.createDataFrame(index, "entry bigint, doc_id bigint, n bigint, component bigint, c bigint"), 50).collect()
    units, met, made = {}, {e: set() for e in range(4)}, [0] * 4
    for x in rows:
        units.setdefault((x["entry"], x["unit"]), []).append(x)
        made[x["entry"]] += 1
    assert len({u for _, u in units}) == len(units) and max(map(len, units.values())) < 3 * 50
    for (e, _), own in units.items():
        for a in own:
            met[e] |= {(a["doc_id"], b["doc_id"]) for b in own if a["doc_id"] < b["doc_id"] and a["component"] != b["component"] and (a["side"] < 0 or a["side"] != b["side"])}
    for e in range(4):
        own = sorted(d for f, d, *_ in index if f == e)
        assert met[e] == {(a, b) for i, a in enumerate(own) for b in own[i + 1 :] if comp[a] != comp[b]}
    assert made[0] == 5 and made[1] <= 900 + 5 * 19
