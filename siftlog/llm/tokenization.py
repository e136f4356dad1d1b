"""Operator 2: BPE encoding and decoding with the automaton of ``bpe.py``."""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from siftlog.llm.bpe import Encoder, Words, encoder
from siftlog.llm.texts import map_texts

#: Outputs of ``encode_decode`` and their types.
OUTPUTS = {"n_tokens": "bigint", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def _word(e: Encoder):
    def make(word):
        ids = [word] if isinstance(word, int) else e.word_ids(word)
        return len(ids), "".join(f" {i}" for i in ids), "".join(f" {e.name[i]}" for i in ids), ids

    return make


def encode_decode(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """Encode every whole text and decode the ids again; one row per document.

    ``path`` names a tokenizer file that every executor has. Special strings in a text become their id,
    none are added. Null and empty texts give no ids and an empty decoded text; a null ``doc_id`` is kept;
    repeated rows give repeated rows; other columns are ignored. No shuffle: each task reads its texts in
    slices of a few MB and keeps a bounded cache of words.
    """
    unknown = set(outputs) - set(OUTPUTS)
    if unknown:
        raise ValueError(f"unknown outputs: {sorted(unknown)}")

    def make(_, texts):
        e = encoder(path)
        words = e.__dict__.setdefault("round_trip", Words(_word(e)))
        columns = {k: [] for k in outputs}
        for text in texts:
            found = [words[p] for p in e.pieces(text)]
            if "n_tokens" in columns:
                columns["n_tokens"].append(sum([f[0] for f in found]))
            if "ids" in columns:
                columns["ids"].append([i for f in found for i in f[3]])
            if "ids_sha256" in columns:
                columns["ids_sha256"].append(sha256("".join([f[1] for f in found])[1:].encode()).hexdigest())
            if "decoded" in columns or "decoded_sha256" in columns:
                if e.automaton.marked:
                    decoded = "".join([f[2] for f in found])[1:]
                else:
                    decoded = e.decode([i for f in found for i in f[3]])
                if "decoded" in columns:
                    columns["decoded"].append(decoded)
                if "decoded_sha256" in columns:
                    columns["decoded_sha256"].append(sha256(decoded.encode()).hexdigest())
        kinds = {"bigint": pa.int64(), "array<int>": pa.list_(pa.int32()), "string": pa.string()}
        return [pa.array(columns[k], kinds[OUTPUTS[k]]) for k in outputs]

    return map_texts(docs, make, ", ".join(f"{k} {OUTPUTS[k]}" for k in outputs))
