"""Every stage of the pipeline on its own input, against brute force over the smallest tables."""

import re
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from siftlog.llm import quality, toxicity
from siftlog.scratch import materialize

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    """Rows of the documents and of every stage, and the documents before each."""
    docs, out, tables = spark.read.parquet(f"{DIR}/documents.parquet"), {}, {}
    out["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        tables[name] = docs
        docs = materialize(stage(spark, docs, DIR), f"test-{name}")
        out[name] = docs.collect()
    return out, tables


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_filters_drop_what_their_operators_reject(spark, outputs):
    rows, tables = outputs
    toxic = {r["doc_id"] for r in toxicity.toxicity(tables["toxicity"], spark.read.parquet(f"{DIR}/labels.parquet")).where("predicted = 1").collect()}
    assert toxic and sorted(rows["toxicity"]) == sorted(r for r in rows["documents"] if r["doc_id"] not in toxic)
    poor = {r["doc_id"] for r in quality.classify(tables["quality"]).where("predicted = 0").collect()}
    assert poor and sorted(rows["quality"]) == sorted(r for r in rows["toxicity"] if r["doc_id"] not in poor)


def test_one_of_each_class_of_near_copies_stays(outputs):
    """Classes by comparing all pairs of shingle sets."""
    rows, _ = outputs
    sets = {}
    for r in rows["quality"]:
        w = words(r["text"])
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert sorted(rows["near_copies"]) == sorted(r for r in rows["quality"] if root(r["doc_id"]) == r["doc_id"])
    assert len(rows["near_copies"]) < len(rows["quality"])


def test_no_passage_stays_in_two_documents(outputs):
    """No run of 60 words is left in two documents, every document keeps its place, and only words are cut."""
    rows, _ = outputs
    before = {r["doc_id"]: words(r["text"]) for r in rows["near_copies"]}
    after = {r["doc_id"]: words(r["text"]) for r in rows["passages"]}
    assert set(before) == set(after)
    held = defaultdict(set)
    for d, w in after.items():
        left = iter(before[d])
        assert all(x in left for x in w)
        for i in range(len(w) - 59):
            held[tuple(w[i : i + 60])].add(d)
    assert all(len(ds) == 1 for ds in held.values())


def test_packing_holds_every_token_once(outputs):
    rows, _ = outputs
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r["doc_id"]: len(tokens.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in rows["passages"]}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows["packing"]:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for found, total in ((pieces, want), (sequences, None)):
        for key, own in found.items():
            at = 0
            for start, length, *_ in sorted(own):
                assert start == at
                at += length
            assert at == total[key] if total else at <= 1024
    assert set(pieces) == set(want)
