"""Byte-level BPE of whole corpora by longest matches and backtracking.

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over the vocabulary finds the longest token from every place of
a pre-token in one pass. Encoding takes longest matches and steps back to shorter ones, or to the token before, whenever two neighbours
could not stand side by side in the result of the merges. Whether they can is a property of the two tokens alone, found by undoing merges
at their boundary, and is memoised. Each place is left at most once, so time is linear in the length also for very long pre-tokens, and
the ids are exactly those of the merges.

Defined cases: null and empty texts give an empty list; strings that look like special tokens are ordinary text; ids of other columns'
nulls don't matter; repeated texts are encoded each time, with pre-tokens memoised up to `MEMO` per worker.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The split before the merges, with white space named as a property, so that all engines read it alike.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
MEMO = 400_000
MEMO_LENGTH = 64
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable bytes stand for themselves, the others follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    def __init__(self, path: str, pattern: str = PATTERN):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        latin = lambda t: "".join(chr(letters[c]) for c in t)
        ids = {latin(t): i for t, i in model["vocab"].items()}
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.split: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        self.order: dict[int, int] = {i: -1 for t, i in ids.items() if len(t) == 1}
        for r, (a, b) in enumerate(merges):
            a, b = latin(a), latin(b)
            pair, whole = (ids[a], ids[b]), ids[a + b]
            self.rank[pair] = r
            if whole not in self.order:
                self.order[whole], self.split[whole] = r, pair
        self.text = {i: t for t, i in ids.items() if i in self.order}
        automaton = ahocorasick.Automaton()
        for i, t in self.text.items():
            automaton.add_word(t, (i, len(t)))
        automaton.make_automaton()
        self.automaton = automaton
        self.ids = ids
        self.shorter = {i: self._prefix(t) for i, t in self.text.items()}
        self.beside = lru_cache(1 << 20)(self._beside)
        self.pieces = regex.compile(pattern).findall
        self.memo: dict[str, list[int]] = {}

    def _prefix(self, t: str) -> int:
        """The longest token that is a proper prefix, -1 for a single byte."""
        for n in range(len(t) - 1, 0, -1):
            i = self.ids.get(t[:n], -1)
            if i in self.order:
                return i
        return -1

    def _beside(self, left: int, right: int) -> bool:
        """Whether the merges leave left and right side by side. The merges of both are undone at the boundary, the later one first; a
        pair met on the way would have been merged if its merge comes before the merges that are already undone around it."""
        before = len(self.rank)
        order, split, rank = self.order, self.split, self.rank
        while True:
            r = rank.get((left, right))
            if r is not None and r < before:
                return False
            lo, ro = order[left], order[right]
            if lo < 0 and ro < 0:
                return True
            # an equal pair merges from the left, so the boundary on the right side of a merge is open a little longer
            if lo > ro:
                before = min(before, lo)
                left = split[left][1]
            else:
                before = min(before, ro + 1)
                right = split[right][0]

    def _encode(self, s: str) -> list[int]:
        n = len(s)
        if n == 1:
            return [self.ids[s]]
        longest = [-1] * n
        size = [0] * n
        for end, (token, length) in self.automaton.iter(s):
            start = end - length + 1
            if length > size[start]:
                size[start], longest[start] = length, token
        text, beside, shorter = self.text, self.beside, self.shorter
        reachable = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + len(text[token])
            if reachable[end] and (not out or beside(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif (token := shorter[token]) < 0:
                reachable[at] = 0
                token = out.pop()
                at -= len(text[token])
        return out

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        memo = self.memo
        for piece in self.pieces(text):
            got = memo.get(piece)
            if got is None:
                got = self._encode(piece.encode("utf-8").decode("latin-1"))
                if len(piece) <= MEMO_LENGTH:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[piece] = got
            out += got
        return out


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path)


def token_ids(text: Column, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """ARRAY<INT>: the token ids of each text."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        encode = encoder(vocabulary).encode
        offsets, values = np.zeros(len(texts) + 1, np.int32), []
        for i, t in enumerate(texts):
            values.append(np.array(encode(t.as_py()), np.int32))
            offsets[i + 1] = offsets[i] + len(values[-1])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int32)))

    return ids(text)
