"""Operators 2, 5 and 8 against the libraries."""

import hashlib
import random
import struct
import zlib

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from siftlog.llm.bpe import MergeAutomaton, encoder
from siftlog.llm.packing import Layout, pack
from siftlog.llm.token_counts import count_tokens, prefix_counts, prefix_tables, truncate
from siftlog.llm.tokenization import encode_decode

WORDS, BYTES = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "a", "  a  b ", "don't 'RE we'll", "<|endoftext|> x<|startoftext|>y<|endoftext|", "ΑΣ ας İ ﬁ ½² Ⅷ", "日本語 한국어 😀👍🏽", "a\u0085b\x1cc d e​f",
    "\x00\x01\x1f x", "éclair é", "a" * 400, "=====-----" * 20, "1234567890 12", "\n\n\n  \n x\t\ty  ", "</w> a</w>b", "Ünïcödé ÄÖÜ ß",
]


def noise(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice("abcAB'  \n\t.,;!12éßñ<|>日é") for _ in range(r.randint(1, 50))) for _ in range(n)]


def table(spark, texts):
    rows = [(i, t, "x", "clash") for i, t in enumerate(texts)] + [(None, "no id", "x", "c"), (0, "again", "x", "c")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string, ids string")


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_encoder_equals_library(path):
    library, own = Tokenizer.from_file(path), encoder(path)
    for t in [x or "" for x in ODD] + noise(400):
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, t
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False), t


def greedy_merge(word, merges):
    parts = list(word)
    for a, b in merges:
        i = 0
        while i + 1 < len(parts):
            if parts[i] == a and parts[i + 1] == b:
                parts[i : i + 2] = [a + b]
            i += 1
    return parts


@pytest.mark.parametrize("seed", range(8))
def test_automaton_equals_merging(seed):
    """Random proper merge lists over two letters: the only path is what merging in order gives."""
    r = random.Random(seed)
    tokens, merges = ["a", "b"], []
    while len(merges) < 12:
        pair = (r.choice(tokens), r.choice(tokens))
        if pair not in merges and "".join(pair) not in tokens:
            merges.append(pair)
            tokens.append("".join(pair))
    machine = MergeAutomaton({t: i for i, t in enumerate(tokens)}, merges)
    for n in range(1, 9):
        for code in range(2**n):
            word = "".join("ab"[code >> i & 1] for i in range(n))
            want = greedy_merge(word, merges)
            assert [machine.label[t] for t in machine.encode(word)] == want
            assert machine.prefixes(word)[1][-1] == len(want)


def test_round_trip_table(spark):
    out = encode_decode(table(spark, ODD), WORDS, ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    library = Tokenizer.from_file(WORDS)
    assert len(out) == len(ODD) + 2 and sum(r["doc_id"] is None for r in out) == 1
    for r in out:
        if r["doc_id"]:
            ids = library.encode(ODD[r["doc_id"]] or "", add_special_tokens=False).ids
            text = library.decode(ids, skip_special_tokens=False)
            assert (r["ids"], r["n_tokens"], r["decoded"]) == (ids, len(ids), text)
            assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert encode_decode(table(spark, ODD).limit(0), WORDS).count() == 0


def test_counts(spark):
    library = Tokenizer.from_file(BYTES)
    for r in count_tokens(table(spark, ODD + ["x y " * 3000]), BYTES).collect():
        if r["doc_id"]:
            t = (ODD + ["x y " * 3000])[r["doc_id"]] or ""
            n = len(library.encode(t, add_special_tokens=False).ids)
            assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(t.encode()), n > 1024)


def test_every_prefix(spark):
    library, own = Tokenizer.from_file(BYTES), encoder(BYTES)
    for t in [x for x in ODD if x and len(x) < 60] + noise(60, 5):
        assert prefix_counts(t, own) == [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)], t
    tables = prefix_tables(spark.createDataFrame([(1, "one two three four"), (2, None)], "doc_id bigint, text string"), BYTES)
    assert {r["doc_id"]: r["n_chars"] for r in truncate(tables, 2).collect()} == {1: 7, 2: 0}


def check_packing(spark, rows, **options):
    library = Tokenizer.from_file(BYTES)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = [r.asDict() for r in pack(docs.repartition(3), BYTES, **options).collect()]
    want = {d: library.encode(t or "", add_special_tokens=False).ids + [0] for d, t, _ in rows}
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert by.keys() == want.keys()
    for d, ids in want.items():
        at = 0
        for r in sorted(by[d], key=lambda r: r["start"]):
            piece = ids[at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(piece)}I", *piece))
            at += r["length"]
        assert at == len(ids)
    ends = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    length = options.get("length", 1024)
    assert all(n == length or n & (n - 1) == 0 for n in ends.values()) and max(ends.values()) <= length
    return out


def test_packing(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choices(["alpha", "beta", "gamma"], k=r.randint(0, 60))), "hot" if r.random() < 0.6 else r.choice("abc")) for i in range(120)]
    rows += [(500, None, None), (501, "", "a"), (502, "long words here " * 2000, "b"), (503, "x <|endoftext|> y", "a")]
    out = check_packing(spark, rows, length=64, window_sequences=4)
    shares = {}
    for p in out:
        shares.setdefault(p["window_id"], {}).setdefault(p["queue"], 0)
        shares[p["window_id"]][p["queue"]] += p["length"]
    full = [s for w, s in shares.items() if w < max(shares) - 1]
    for q in ("hot", "a", "b"):
        got = [s.get(q, 0) for s in full]
        assert max(got) - min(got) <= 1


def test_packing_mixture(spark):
    rows = [(i, "one two three four five six", "ab"[i % 2]) for i in range(200)]
    out = check_packing(spark, rows, length=32, window_sequences=2, mixture={"a": 3.0, "b": 1.0})
    first = [p for p in out if p["window_id"] == 0]
    assert sum(p["length"] for p in first if p["queue"] == "a") == 48 and sum(p["length"] for p in first if p["queue"] == "b") == 16


def test_packing_folds_small_queues_and_nothing(spark):
    check_packing(spark, [(i, "a b c", f"s{i}") for i in range(12)], length=16, window_sequences=1, max_queues=4)
    assert pack(spark.createDataFrame([], "doc_id bigint, text string, source string"), BYTES).count() == 0


def test_layout_is_a_permutation():
    layout = Layout([100, 7, 350], [100.0, 7.0, 350.0], 64, 16)
    seen = set()
    for q, n in enumerate(layout.totals):
        for _, size, number, offset, _ in layout.pieces(q, 0, n):
            for i in range(size):
                assert (number, offset + i) not in seen
                seen.add((number, offset + i))
    assert len(seen) == 457


def test_packing_of_very_long_blanks(spark):
    """A run of over a million blanks gets the ids that the automaton gives; a shorter run those of the library."""
    library = Tokenizer.from_file(BYTES)
    texts = ["a" + " " * 1_100_000 + "b", "x" + " " * 60_000 + "y" + "\n" * 30, " " * 60_000]
    got = {}
    for r in pack(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id int, text string, source string"), BYTES).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
    for i in (0, 1, 2):
        ids = (library.encode(texts[i], add_special_tokens=False).ids if i else encoder(BYTES).encode(texts[i])) + [0]
        assert sorted(got[i]) == [(a, n, zlib.crc32(struct.pack(f"<{n}I", *ids[a : a + n]))) for a, n, _ in sorted(got[i])]
        assert sum(n for _, n, _ in got[i]) == len(ids)
