"""Operator 11: encoding and decoding with a SentencePiece model of byte-pair type.

The encoding of a word is read off its prefix table. Entry ``i`` is the last token of the encoding of the
word's first ``i`` characters, and that token is unique: of the tokens that end at ``i`` (an Aho-Corasick
automaton names them, longest first) it is the one that may follow the last token of the prefix before it.
Two tokens may follow each other if the two strings together encode to just these two tokens, which is
tested once a pair and kept. The ids are then recovered backwards through the table.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from functools import lru_cache
from hashlib import sha256
from heapq import heappop, heappush
from struct import unpack_from
from sys import byteorder

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from siftlog.llm.bpe import Words
from siftlog.llm.texts import map_texts

# Fixed values of the file format: the sign for a blank, and the numbers of piece types and of the model type.
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BYTE_PAIR = 2
OUTPUTS = {"n_tokens": "bigint", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _fields(raw: bytes):
    """``number, value`` of each field of a protocol buffer message; nested messages and strings stay bytes."""
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind == 2:
            size, at = _varint(raw, at)
            value, at = raw[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = unpack_from("<d" if kind == 1 else "<f", raw, at)[0], at + size
        yield tag >> 3, value


class PieceModel:
    """Vocabulary, automaton and caches of a model file.

    Models with merges by score, byte fallback and plain normalisation are read (a leading blank may be
    added); another kind of model is refused with ``ValueError``.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = list(_fields(f.read()))
        trainer = dict(_fields(next((v for n, v in message if n == 2), b"")))
        normal = dict(_fields(next((v for n, v in message if n == 3), b"")))
        if trainer.get(3, 1) != BYTE_PAIR or not trainer.get(35, 0):
            raise ValueError("only byte-pair models with byte fallback are read")
        if normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only models without a character map and with kept blanks are read")
        self.leading = bool(normal.get(3, 1))
        self.text: list[str] = []
        self.kind: list[int] = []
        self.id: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte = [0] * 256
        for number, value in message:
            if number != 1:
                continue
            own = dict(_fields(value))
            piece, kind, i = own[1].decode(), own.get(3, NORMAL), len(self.text)
            self.text.append(piece)
            self.kind.append(kind)
            if kind in (USER_DEFINED, UNUSED):
                raise ValueError("user-defined and unused pieces are not read")
            if kind == BYTE:
                self.byte[int(piece[1:-1], 16)] = i
            elif kind == NORMAL:
                self.id[piece], self.score[piece] = i, own.get(2, 0.0)
        self.value = {i: n for n, i in enumerate(self.byte)}
        self.begin, self.end = self.text.index("<s>"), self.text.index("</s>")
        # Tokens that other merges overtake never end a prefix. Of the others the last merge is kept, if its parts are made earlier.
        self.parts: dict[str, tuple[str, str]] = {}
        self.whole = {p for p in self.id if self._merged(p, self.parts) == [p]}
        scores = Counter(self.score.values())
        for p, (a, b) in sorted(self.parts.items(), key=lambda x: len(x[0])):
            sound = all(len(x) == 1 or x in self.parts and self.score[x] > self.score[p] for x in (a, b))
            if not sound or scores[self.score[p]] > 1:
                del self.parts[p]
        self.matches = ahocorasick.Automaton()
        for p in self.whole:
            self.matches.add_word(p, (self.id[p], len(p)))
        self.matches.make_automaton()
        self.follows = Words(self._may_follow, 500_000)
        self.length = [len(p) for p in self.text]
        self.shown = [None if k == BYTE else "" if k == CONTROL else " ⁇ " if k == UNKNOWN else p.replace(BLANK, " ") for p, k in zip(self.text, self.kind)]
        # Parts encode on their own where no piece reaches from one into the next.
        pairs = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        feeds = not any("\n" in x for x in pairs)
        blanks = not any(b == BLANK and a != BLANK for a, b in pairs)
        self.cut = re.compile((r"\n+| *[^ \n]+| +" if feeds else r" *[^ ]+| +") if blanks else r"(?s:.+)")
        self.words = Words(self._word, 500_000)

    def _merged(self, text: str, last: dict | None = None) -> list[str]:
        """Merges by score, the leftmost of equal ones first: the definition, for short strings. ``last`` gets the last pair by result."""
        part, after = list(text), [*range(1, len(text)), -1]
        before, score, heap = [*range(-1, len(text) - 1)], self.score, []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (s := score.get(part[a] + part[b])) is not None:
                heappush(heap, (-s, a, b, part[a] + part[b]))

        for a in range(len(text) - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, both = heappop(heap)
            if part[a] and part[b] and after[a] == b and part[a] + part[b] == both:
                if last is not None and both == text:
                    last[text] = part[a], part[b]
                part[a], part[b], after[a] = both, "", after[b]
                if after[a] >= 0:
                    before[after[a]] = a
                offer(before[a], a)
                offer(a, after[a])
        return [p for p in part if p]

    def _may_follow(self, pair: int) -> bool:
        """Whether the second token may follow the first: no merge across their border comes before the merges that made them.

        The two tokens are taken apart from the last merge to the first, as far as it touches the border;
        at each step the parts that meet there must not merge before the next of the undone merges.
        """
        a, b = self.text[pair // len(self.text)], self.text[pair % len(self.text)]
        parts, score = self.parts, self.score
        if any(len(x) > 1 and x not in parts for x in (a, b)):
            return self._merged(a + b) == [a, b]
        over_a = over_b = float("-inf")
        while True:
            s = score.get(a + b)
            if s is not None and s > over_a and s >= over_b:
                return False
            if len(a) > 1 and (len(b) == 1 or score[a] < score[b]):
                over_a, a = score[a], parts[a][1]
            elif len(b) > 1:
                over_b, b = score[b], parts[b][0]
            else:
                return True

    def prefix_table(self, word: str) -> list[int]:
        """Entry i: the last token of the first ``i + 1`` characters; -1 for a character outside the vocabulary."""
        last, size, follows = [-1] * (len(word) + 1), len(self.text), self.follows
        for end, (token, before) in self.matches.iter(word):
            if last[end] < 0:
                own = last[end - before]
                if own < 0 or follows[own * size + token]:
                    last[end] = token
        last.pop()
        return last

    def word_ids(self, word: str) -> list[int]:
        """Ids of a piece of text (blanks as the model's sign), from the end of its prefix table to its start."""
        if word in self.whole:
            return [self.id[word]]
        last, ids, at, length = self.prefix_table(word), [], len(word) - 1, self.length
        while at >= 0:
            token = last[at]
            if token < 0:
                ids.extend(self.byte[b] for b in reversed(word[at].encode()))
                at -= 1
            else:
                ids.append(token)
                at -= length[token]
        ids.reverse()
        return ids

    def _word(self, word: str) -> tuple[bytes, str]:
        ids = self.word_ids(word.replace(" ", BLANK))
        raw = array("I", ids)
        if byteorder == "big":
            raw.byteswap()
        text = self._joined(ids)
        return raw.tobytes(), word if text == word else text

    def _joined(self, ids: list[int]) -> str:
        shown = [self.shown[i] for i in ids]
        if None not in shown:
            return "".join(shown)
        out, raw = [], bytearray()
        for i, text in zip(ids, shown):
            if text is None:
                raw.append(self.value[i])
            else:
                out += [_decoded(bytes(raw)), text]
                raw.clear()
        return "".join([*out, _decoded(bytes(raw))])

    def pieces(self, text: str) -> list[str]:
        """Parts of the text, leading blank included, that encode independently of each other."""
        if not text:
            return []
        text = (" " if self.leading else "") + text.replace(BLANK, " ")
        return self.cut.findall(text)

    def encode(self, text: str, ends: bool = True) -> list[int]:
        ids = [i for p in self.pieces(text) for i in self.word_ids(p.replace(" ", BLANK))]
        return [self.begin, *ids, self.end] if ends else ids

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: control ids give nothing, runs of bytes are read as UTF-8, the leading blank goes."""
        text = self._joined(ids)
        first = next((i for i in ids if self.kind[i] != CONTROL), None)
        return text[1:] if self.leading and first is not None and self.text[first].startswith(BLANK) else text


def _decoded(raw: bytes) -> str:
    """UTF-8 with one replacement sign for each byte that belongs to no character."""
    out = []
    while raw:
        try:
            return "".join([*out, raw.decode()])
        except UnicodeDecodeError as e:
            out.append(raw[: e.start].decode() + "�")
            raw = raw[e.start + 1 :]
    return "".join(out)


@lru_cache(2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_decode_pieces(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """Encode every whole text with begin and end ids and decode the ids again; one row per document.

    ``path`` names a model file that every executor has. Null and empty texts give the two ends and an
    empty decoded text; a null ``doc_id`` is kept; repeated rows give repeated rows; other columns, also
    ones named like the outputs, are ignored; an empty table gives no rows. Decoding loses what the
    encoding folds: the model's sign for a blank comes back as a blank. No shuffle: each task reads its
    texts in slices of 1 MB, and keeps words and tested pairs in caches of bounded size. Long texts without
    a blank pass through one prefix table, whose size is that of the text.
    """
    unknown = set(outputs) - set(OUTPUTS)
    if unknown:
        raise ValueError(f"unknown outputs: {sorted(unknown)}")

    def make(_, texts):
        m = piece_model(path)
        words, begin, end = m.words, m.begin.to_bytes(4, "little"), m.end.to_bytes(4, "little")
        columns = {k: [] for k in outputs}
        for text in texts:
            found = [words[p] for p in m.pieces(text)]
            ids = b"".join([begin, *[f[0] for f in found], end])
            if "n_tokens" in columns:
                columns["n_tokens"].append(len(ids) // 4)
            if "ids" in columns:
                columns["ids"].append(memoryview(ids).cast("i").tolist())
            if "ids_sha256" in columns:
                columns["ids_sha256"].append(sha256(ids).hexdigest())
            if "decoded" in columns or "decoded_sha256" in columns:
                decoded = "".join([f[1] for f in found])
                if m.leading:
                    decoded = decoded[1:]
                if "decoded" in columns:
                    columns["decoded"].append(decoded)
                if "decoded_sha256" in columns:
                    columns["decoded_sha256"].append(sha256(decoded.encode()).hexdigest())
        kinds = {"bigint": pa.int64(), "array<int>": pa.list_(pa.int32()), "string": pa.string()}
        return [pa.array(columns[k], kinds[OUTPUTS[k]]) for k in outputs]

    return map_texts(docs, make, ", ".join(f"{k} {OUTPUTS[k]}" for k in outputs))
