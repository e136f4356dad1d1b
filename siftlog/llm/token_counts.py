"""Operator 8: exact token counts at every prefix of a text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from siftlog.llm.bpe import Encoder, Words, encoder
from siftlog.llm.texts import map_texts


def _count(e: Encoder):
    def make(word):
        if isinstance(word, int):
            return 1
        _, count = e.automaton.prefixes(e.letters_of(word))
        return count[-1]

    return make


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text; null texts count as empty.

    A word's count is the last entry of its prefix table, kept in a bounded cache; a text's is the sum
    over its words. No shuffle; repeated rows, null ids and extra columns pass as they are. For a byte
    level vocabulary file of the kind ``bpe.Encoder`` reads.
    """

    def make(_, texts):
        e = encoder(path)
        words = e.__dict__.setdefault("counts", Words(_count(e), 600_000))
        counts = [sum([words[p] for p in e.pieces(t)]) for t in texts]
        sizes = [len(t) if t.isascii() else len(t.encode("utf-8")) for t in texts]
        return [pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())]

    return map_texts(docs, make, "n_bytes bigint, n_tokens bigint, over_limit boolean")


def prefix_counts(text: str, e: Encoder) -> list[int]:
    """Entry i: the number of tokens of ``text[:i]`` encoded on its own.

    Inside a word the automaton's prefix table answers. Two prefixes split differently from the whole:
    one that ends in white space (the run is then one word) and one that ends inside a contraction or a
    special string (that tail is counted anew).
    """
    out, total, at = [0], 0, 0
    run, run_start, before = None, 0, 0
    specials = {i: s for s, i in e.special.items()}
    for piece in e.pieces(text):
        if isinstance(piece, int):
            shown = specials[piece]
            for c in range(1, len(shown)):
                out.append(len(e.encode(text[: at + c])))
            total += 1
            out.append(total)
            at += len(shown)
            run = None
            continue
        letters = [e.letters_of(ch) for ch in piece]
        _, table = e.automaton.prefixes("".join(letters))
        contraction = piece[0] == "'" and len(piece) > 2 and piece[1].isalpha()
        n = 0
        for c, ch in enumerate(piece, 1):
            n += len(letters[c - 1])
            if ch.isspace() and not piece[:c].strip():
                if run is None:
                    run, run_start, before = "", at + c - 1, out[-1]
                run += ch
                _, spaces = e.automaton.prefixes(e.letters_of(run))
                out.append(before + spaces[-1])
            elif contraction and c < len(piece):
                out.append(total + sum(len(e.word_ids(w)) for w in e.split(piece[:c])))
            else:
                run = None
                out.append(total + table[n])
        total += table[-1]
        at += len(piece)
    return out


def prefix_tables(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, counts array<int>``: the prefix table of every whole text, to be stored and asked later."""

    def make(_, texts):
        e = encoder(path)
        return [pa.array([prefix_counts(t, e) for t in texts], pa.list_(pa.int32()))]

    return map_texts(docs, make, "counts array<int>")


def truncate(tables: DataFrame, budget: int) -> DataFrame:
    """Longest prefix, in code points, within ``budget`` tokens; answered from stored tables alone."""
    return tables.selectExpr(
        "doc_id",
        f"cast(coalesce(array_max(filter(transform(counts, (c, i) -> if(c <= {int(budget)}, i, null)), i -> i is not null)), 0) as bigint) as n_chars",
    )
