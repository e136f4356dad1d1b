"""Byte-pair encoding compiled to a deterministic automaton over token labels.

``MergeAutomaton`` starts from one state with a loop for every base symbol and applies one merge
gadget per rule (u, v) in order: the state that u-arcs enter loses its v-arc, and every state with a
u-arc gains an arc for the merged label, which enters what the state behind v was at that step. A token
sequence is the tokenisation of a word exactly if the automaton has a path for it.

States share arcs instead of copying them: the state behind a merged label keeps only its own lost
arcs (``cut``: state and label to the step of the loss) and refers to the state behind v as of its step.
An arc is looked up in steps no longer than the two labels.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

END = "\x00"


@lru_cache(1)
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Words(dict):
    """A cache by word of bounded size: when it is full it starts again. Long words are made anew each time."""

    def __init__(self, make, size: int = 250_000, longest: int = 100):
        self.make, self.size, self.longest = make, size, longest

    def __missing__(self, word):
        if isinstance(word, str) and len(word) > self.longest:
            return self.make(word)
        if len(self) >= self.size:
            self.clear()
        value = self[word] = self.make(word)
        return value


class MergeAutomaton:
    def __init__(self, vocab: dict[str, int], merges: list, suffix: str | None = None):
        def name(token: str) -> str:
            return token[: -len(suffix)] + END if suffix and token.endswith(suffix) and token != suffix else token

        rules = [tuple(r.split(" ", 1)) if isinstance(r, str) else tuple(r) for r in merges]
        self.marked = bool(suffix)
        self.label: list[str] = []
        self.ids: list[int] = []
        self.made: list[int] = []
        self.head: list[int] = []
        self.find: dict[str, int] = {}
        self.tail: list[int] = []
        self.cut: dict[int, int] = {}
        self.size = len(vocab) + 1
        merged = {a + b for a, b in rules}
        for token, i in vocab.items():
            if token not in merged:
                self._token(name(token), i, 0, -1, -1)
        for step, (a, b) in enumerate(rules, 1):
            u, v = self.find.get(name(a)), self.find.get(name(b))
            if u is None or v is None or a + b not in vocab or not self.has_arc(u, v):
                continue
            self.cut[u * self.size + v] = step
            if name(a + b) not in self.find:
                self._token(name(a + b), vocab[a + b], step, u, v)
        self.longest = max(map(len, self.label), default=1)
        self.arcs = Words(lambda key: self.has_arc(key // self.size, key % self.size), 1_000_000)

    def _token(self, label: str, i: int, made: int, head: int, tail: int) -> None:
        self.find[label] = len(self.label)
        self.label.append(label)
        self.ids.append(i)
        self.made.append(made)
        self.head.append(head)
        self.tail.append(tail)

    def has_arc(self, state: int, token: int) -> bool:
        """Whether the state behind the label ``state`` has an arc for ``token``; -1 is the start, which has all."""
        if state < 0:
            return True
        cut, size, made = self.cut, self.size, self.made
        by = float("inf")
        while True:
            lost = cut.get(state * size + token)
            if lost is not None and lost < by:
                return False
            new = made[token]
            old = made[state]
            if not new and not old:
                return True
            if new >= old:
                by = new + 0.5
                token = self.head[token]
            else:
                by = old
                state = self.tail[state]

    def prefixes(self, word: str) -> tuple[list[int], list[int]]:
        """For every prefix of ``word``: the last token of its only path and the number of its tokens."""
        find, longest, arcs, size = self.find, self.longest, self.arcs, self.size
        n = len(word)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        skip = n - 1 if self.marked else -1
        for j in range(1, n + 1):
            if j == skip:
                continue
            for i in range(j - 1, max(0, j - longest) - 1, -1):
                if i == skip or (i and last[i] < 0):
                    continue
                t = find.get(word[i:j])
                if t is not None and arcs[last[i] * size + t]:
                    last[j], count[j] = t, count[i] + 1
                    break
        return last, count

    def encode(self, word: str) -> list[int]:
        """Token indices of the accepted path; symbols outside the vocabulary are left out.

        Walks forward over the longest arc that exists and steps back where no arc goes on; a pair of
        position and state that led nowhere is not entered again.
        """
        n = len(word)
        if self.marked:
            word += END
            n += 1
        find, longest, arcs, size = self.find, self.longest, self.arcs, self.size
        skip = n - 1 if self.marked else -1
        path, ends, dead = [], [0], set()
        i, state, j = 0, -1, min(n, longest)
        while i < n:
            while j > i:
                if j != skip:
                    t = find.get(word[i:j])
                    if t is not None and arcs[state * size + t] and (j, t) not in dead:
                        break
                j -= 1
            if j > i:
                path.append(t)
                ends.append(j)
                i, state, j = j, t, min(n, j + longest)
            elif path:
                dead.add((i, path.pop()))
                j = ends.pop() - 1
                i, state = ends[-1], path[-1] if path else -1
            else:
                return self._lossy(word)
        return path

    def _lossy(self, word: str) -> list[int]:
        last, _ = self.prefixes(word)
        out, j = [], len(word)
        while j > 0:
            if last[j] < 0:
                j -= 1
                continue
            out.append(last[j])
            j -= len(self.label[last[j]])
        return out[::-1]


def pattern(kind: str) -> str:
    # The pre-tokenisation patterns of the two public vocabularies.
    return {
        "words": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
        "bytes": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    }[kind]


class Splitter:
    """Pre-tokenisation. Texts of ASCII and Latin-1 letters take a pattern with literal classes, others \\p{..}."""

    def __init__(self, pattern: str):
        import re

        import regex

        letters, digits, spaces = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9", "\t-\r "
        plain = pattern.replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{digits}]")
        plain = plain.replace(r"\s\p{L}\p{N}", spaces + letters + digits)
        plain = plain.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{digits}]")
        plain = plain.replace(r"\s", f"[{spaces}]").replace(r"\S", f"[^{spaces}]")
        self.plain = re.compile(plain).findall
        self.odd = re.compile("[^\x00-\x1b\x20-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]").search
        whole = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]")
        whole = whole.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.whole = regex.compile(whole).findall

    def __call__(self, text: str) -> list[str]:
        return self.whole(text) if self.odd(text) else self.plain(text)


class Encoder:
    """One tokenizer file: normalisation, pre-tokenisation, automaton and special strings."""

    def __init__(self, path: str):
        import re

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        suffix = model.get("end_of_word_suffix")
        self.lower = bool(spec.get("normalizer"))
        self.automaton = MergeAutomaton(model["vocab"], model["merges"], suffix)
        self.split = Splitter(pattern("words" if suffix else "bytes"))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.name = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.letters = byte_letters()

    def pieces(self, text: str) -> list:
        """Words of ``text`` in order; an id stands for a special string."""
        if "<|" not in text or not self.cut.search(text):
            return self._words(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += self._words(text[at : m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        return out + self._words(text[at:])

    def _words(self, text: str) -> list[str]:
        if self.lower:
            if not text.isascii():
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            text = text.lower()
        return self.split(text)

    def letters_of(self, word: str) -> str:
        letters = self.letters
        return "".join([letters[b] for b in word.encode("utf-8", "surrogatepass")])

    def word_ids(self, word: str) -> list[int]:
        a = self.automaton
        return [a.ids[t] for t in a.encode(self.letters_of(word))]

    def encode(self, text: str) -> list[int]:
        return [i for w in self.pieces(text) for i in ([w] if isinstance(w, int) else self.word_ids(w))]

    def decode(self, ids: list[int]) -> str:
        """Emit the label of every arc; the vocabulary with word ends has no decoder, so labels meet at blanks."""
        names = [self.name[i] for i in ids if i in self.name]
        if self.automaton.marked:
            return " ".join(names)
        back = {c: b for b, c in enumerate(self.letters)}
        return b"".join(
            bytes(back[c] for c in n) if all(c in back for c in n) else n.encode() for n in names
        ).decode("utf-8", "replace")


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
