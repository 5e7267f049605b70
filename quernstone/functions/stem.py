"""The Snowball stemmer for Russian, by its published definition, and an Arrow function over token lists.

Words without a Russian vowel pass unchanged. Distinct words are stemmed once for each worker, up to a bound.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOWELS = "аеиоуыэюя"
#: The endings of the published algorithm; those of the first groups need а or я before them.
GERUND_1, GERUND_2 = ("вшись", "вши", "в"), ("ывшись", "ившись", "ывши", "ивши", "ыв", "ив")
ADJECTIVE = "ими ыми его ого ему ому ее ие ые ое ей ий ый ой ем им ым ом их ых ую юю ая яя ою ею".split()
PARTICIPLE_1, PARTICIPLE_2 = ("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ")
REFLEXIVE = ("ся", "сь")
VERB_1 = "ешь нно ете йте ла на ли ем ло но ет ют ны ть й л н".split()
VERB_2 = "ейте уйте ила ыла ена ите или ыли ило ыло ено ует уют ены ить ыть ишь ей уй ил ыл им ым ен ят ит ыт ую ю".split()
NOUN = "иями ями ами ией иям ием иях ев ов ие ье еи ии ей ой ий ям ем ам ом ах ях ию ью ия ья а е и й о у ы ь ю я".split()
SUPERLATIVE = ("ейше", "ейш")
DERIVATIONAL = ("ость", "ост")


def _regions(word: str) -> tuple[int, int]:
    """Starts of RV (behind the first vowel) and of R2."""

    def after(at: int) -> int:  # behind the first non-vowel that follows a vowel
        for i in range(at + 1, len(word)):
            if word[i] not in VOWELS and word[i - 1] in VOWELS:
                return i + 1
        return len(word)

    rv = next((i + 1 for i, c in enumerate(word) if c in VOWELS), len(word))
    return rv, after(after(0))


def _cut(word: str, low: int, endings, group_1=()) -> str | None:
    """The word without the longest ending that lies behind low; endings of group 1 stay behind а or я, which are kept."""
    for size in range(min(6, len(word) - low), 0, -1):
        tail = word[-size:]
        if tail in endings:
            return word[:-size]
        if tail in group_1 and len(word) - size - 1 >= low and word[-size - 1] in "ая":
            return word[:-size]
    return None


@lru_cache(maxsize=200_000)
def stem_russian(word: str) -> str:
    word = word.lower().replace("ё", "е")
    rv, r2 = _regions(word)
    if rv >= len(word):
        return word
    first = _cut(word, rv, GERUND_2, GERUND_1)
    if first is None:
        short = _cut(word, rv, REFLEXIVE)
        word = word if short is None else short
        adjective = _cut(word, rv, ADJECTIVE)
        if adjective is not None:
            participle = _cut(adjective, rv, PARTICIPLE_2, PARTICIPLE_1)
            word = adjective if participle is None else participle
        else:
            verb = _cut(word, rv, VERB_2, VERB_1)
            noun = _cut(word, rv, NOUN) if verb is None else None
            word = next(w for w in (verb, noun, word) if w is not None)
    else:
        word = first
    if len(word) > rv and word.endswith("и"):
        word = word[:-1]
    derived = _cut(word, max(rv, r2), DERIVATIONAL)
    word = word if derived is None else derived
    if _ends(word, rv, "нн"):
        return word[:-1]
    superlative = _cut(word, rv, SUPERLATIVE)
    if superlative is not None:
        return superlative[:-1] if _ends(superlative, rv, "нн") else superlative
    return word[:-1] if _ends(word, rv, "ь") else word


def _ends(word: str, low: int, tail: str) -> bool:
    return len(word) - len(tail) >= low and word.endswith(tail)


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_tokens(tokens: pa.Array) -> pa.Array:
    """Each token list with all tokens stemmed, but for the negation не; a batch's distinct tokens once."""
    lists = tokens.combine_chunks() if isinstance(tokens, pa.ChunkedArray) else tokens
    words = lists.flatten().dictionary_encode()
    stems = pa.array([t if t == "не" else stem_russian(t) for t in words.dictionary.to_pylist()], pa.string())
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    return pa.ListArray.from_arrays(ends, stems.take(words.indices), mask=lists.is_null())
