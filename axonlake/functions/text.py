"""Folding, tokens, hashes and n-grams of short texts."""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: letters and what they fold to before marks are taken off
FOLD_FROM, FOLD_TO = "ışğüöçâîû", "isguocaiu"


@cache
def _decompositions() -> tuple[str, str, dict[str, str]]:
    """Of all letters that a compatibility decomposition (NFKD) without combining marks changes: those that become one letter, as two strings, and the others. Hangul, which decomposes by rule, is left out."""
    one_from, one_to, more = [], [], {}
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code <= 0xD7A3:
            continue
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain == c or unicodedata.combining(c):
            continue
        if len(plain) == 1:
            one_from.append(c)
            one_to.append(plain)
        else:
            more[c] = plain
    return "".join(one_from), "".join(one_to), more


def folded(text: Column) -> Column:
    """Lower case without marks: letters of FOLD_FROM become plain ones, every other letter its compatibility decomposition without combining marks."""
    one_from, one_to, more = _decompositions()
    # astral letters are left to the second step: translate goes by UTF-16 units
    pairs = [(a, b) for a, b in zip(one_from, one_to) if ord(a) < 0x10000 and ord(b) < 0x10000]
    rest = {a: b for a, b in zip(one_from, one_to) if ord(a) >= 0x10000 or ord(b) >= 0x10000} | more
    low = F.translate(F.translate(F.lower(text), FOLD_FROM, FOLD_TO), "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    names = F.map_from_arrays(F.split(F.lit("\x1f".join(rest)), "\x1f"), F.split(F.lit("\x1f".join(rest.values())), "\x1f"))  # constant
    usual = lambda x: x.rlike(r"^[\x00-\u024f\u2010-\u2023\u2027\s]*$") & ~x.rlike("[" + "".join(c for c in rest if ord(c) < 0x250) + "]")
    by_letter = lambda word: F.array_join(F.transform(F.split(word, ""), lambda c: F.coalesce(F.try_element_at(names, c), c)), "")
    # looking up each letter is slow, so only words with an unusual one are taken apart
    by_word = F.array_join(F.transform(F.split(low, " "), lambda w: F.when(usual(w), w).otherwise(by_letter(w))), " ")
    plain = F.when(usual(low), low).otherwise(by_word)
    return F.regexp_replace(plain, r"\p{M}", "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit("([a-z]+)"), F.lit(1))


def keyed_hash(text: Column, salt: int = 0) -> Column:
    """BLAKE2b of `salt|text` in 64 bits, the same on every machine; null for null."""

    @F.pandas_udf("long")
    def digest(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else int.from_bytes(hashlib.blake2b(f"{salt}|{t}".encode(), digest_size=8).digest(), "big", signed=True) for t in texts], dtype="Int64")

    return digest(text)


def ngrams(word: Column, n: int) -> Column:
    """Character n-grams of a word between marks of its ends; none for a word that is too short."""
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    starts = F.when(F.length(padded) >= n, F.sequence(F.lit(1), F.length(padded) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(padded, i, F.lit(n)))


def first_object(text: Column) -> Column:
    """The text from the first opening to the last closing brace, without fences around it."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def one_exclamation(text: Column, words: list[str]) -> Column:
    """The text with only the first of the words, wherever it stands outside square brackets; the gaps that the others leave are closed, signs that belonged to them go. Texts with one of them or none stay as they are."""
    listed = "|".join(re.escape(w).replace("i", "[iİıI]") for w in sorted(words, key=len, reverse=True))
    part = re.compile(rf"(\[[^\]]*\])|(\s*(?<!\w)(?:{listed})(?!\w)[,;:]*[!?]*)", re.I)
    double, loose, ends = re.compile(r"([,;:])(?:\s*[,;:])+"), re.compile(r"\s+(?=[,;:!?.…])"), re.compile(r"^[,;:\s]+|[,;:\s]+$")

    def kept_first(t: str | None) -> str | None:
        if t is None or not words or sum(m[2] is not None for m in part.finditer(t)) < 2:
            return t
        seen = [False]

        def one(m: re.Match) -> str:
            if m[1] is not None or not seen[0]:
                seen[0] = seen[0] or m[2] is not None
                return m[0]
            return ""

        return ends.sub("", loose.sub("", double.sub(r"\1", re.sub(r"[ \t]{2,}", " ", part.sub(one, t)))))

    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return pd.Series([kept_first(t) for t in texts], dtype=object)

    return apply(text)
