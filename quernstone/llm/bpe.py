"""Byte-level BPE on ragged numpy arrays.

A batch of texts is one array of code points. Pre-token borders come from class changes between neighbours,
equal pre-tokens are found by a 64-bit hash and then compared code point by code point, and the distinct ones
are merged together: in each round every sequence applies its own lowest-ranked pair at all its places.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: White_Space of Unicode, which the tokenizer's \s stands for.
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = LETTER
        elif kind == "N":
            out[cp] = NUMBER
    out[_SPACES] = SPACE
    return out


@lru_cache(maxsize=2)
def _hash_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 0x110000, dtype=np.uint64)


_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def code_points(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts as one string, its code points, and where each text starts (one more entry: the end)."""
    joined = "".join(texts)
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=ends[1:])
    return joined, cps, ends


def pretoken_starts(cps: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Start of each pre-token of 's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?other+|\\s+(?!\\S)|\\s+ within each text."""
    n = len(cps)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = char_classes()[cps]
    first = np.zeros(n + 1, bool)  # a text starts here
    first[text_starts] = True
    run = np.empty(n, bool)  # a run of one class starts here
    run[0] = True
    np.not_equal(kind[1:], kind[:-1], out=run[1:])
    run |= first[:n]
    space = kind == SPACE
    starts = run.copy()
    # The last white space before a word: a blank joins the word, any other stands alone.
    word = np.flatnonzero(run & ~space)
    after = word[(word > 0) & ~first[word]]
    after = after[space[after - 1]]
    blank = after[cps[after - 1] == 32]
    starts[blank] = False
    starts[after - 1] = True
    # Contractions: a lone apostrophe that no blank precedes, before s, t, m, d, re, ve or ll.
    quote = np.flatnonzero((cps == 39) & run)
    if len(quote):
        glued = np.zeros(n, bool)
        glued[blank] = True
        quote = quote[(quote + 1 < n) & ~glued[quote]]
        quote = quote[run[quote + 1] & (kind[quote + 1] == LETTER) & ~first[quote + 1]]
        a = cps[quote + 1]
        pad = np.minimum(quote + 2, n - 1)
        b = np.where((quote + 2 < n) & ~first[np.minimum(quote + 2, n)], cps[pad], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        quote, length = quote[one | two], np.where(one, 1, 2)[one | two]
        starts[quote + 1] = False
        starts[np.minimum(quote + 1 + length, n - 1)[quote + 1 + length < n]] = True
    return np.flatnonzero(starts)


def spans_hash(cps: np.ndarray, starts: np.ndarray, seed: int = 20240229) -> np.ndarray:
    """64-bit hash of each span [starts[i], starts[i + 1]): a polynomial in random values of its code points."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = 1 << max(16, int(len(cps) - 1).bit_length())
    mixed = _hash_table(seed)[cps]
    mixed *= _powers(_BASE, size)[: len(cps)]
    return np.add.reduceat(mixed, starts) * _powers(_INVERSE, size)[starts]


def distinct_spans(cps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Index of a first span for each distinct one, for each span the number of its distinct one, and 128-bit keys.

    Spans count as equal if two independent 64-bit hashes are.
    """
    first, second = spans_hash(cps, starts), spans_hash(cps, starts, 77)
    codes, values = pd.factorize(first)
    index = np.zeros(len(values), np.int64)
    index[codes[::-1]] = np.arange(len(codes))[::-1]
    bad = second[index[codes]] != second
    if bad.any():  # a collision of the first hash: those spans stay apart
        index, codes = np.unique(np.where(bad, np.arange(len(starts)), index[codes]), return_inverse=True)
    return index, codes, [(a << 64) | b for a, b in zip(first[index].tolist(), second[index].tolist(), strict=True)]


class Bpe:
    """The merges of a tokenizers file; load by Bpe.from_file."""

    def __init__(self, vocab: dict[str, int], merges: list, special: dict[str, int]):
        unicode_of = _byte_alphabet()
        self.byte_ids = np.array([vocab[unicode_of[b]] for b in range(256)], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        new = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = (left << 32) | right
        _, keep = np.unique(keys, return_index=True)
        self.keys, self.ranks, self.new = keys[keep], keep.astype(np.int64), new[keep]
        self.by_rank = np.zeros(len(pairs), np.int64)
        self.by_rank[self.ranks] = self.new
        self.special = special
        bits = 18
        self.shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, np.int64)  # open addressing, for look-ups without a search
        at = self._slot(self.keys)
        for i, s in enumerate(at.tolist()):
            while self.slots[s] >= 0:
                s = (s + 1) & (len(self.slots) - 1)
            self.slots[s] = i

    @classmethod
    def from_file(cls, path: str) -> Bpe:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only byte-level BPE without normalizer or prefix space")
        return cls(spec["model"]["vocab"], spec["model"]["merges"], {t["content"]: t["id"] for t in spec["added_tokens"]})

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; a large number for pairs that never merge."""
        keys = (left << 32) | right
        out = np.full(len(keys), 1 << 40, np.int64)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            found = self.slots[at]
            there = found >= 0
            todo, at, found = todo[there], at[there], found[there]
            hit = self.keys[found] == keys[todo]
            out[todo[hit]] = self.ranks[found[hit]]
            todo, at = todo[~hit], (at[~hit] + 1) & (len(self.slots) - 1)
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and the number of ids of each word.

        In a round each word applies its lowest-ranked pair at all its places, left to right without overlap; words
        without such a pair are done.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_owner = [], []
        while len(symbols):
            inner = owner[1:] == owner[:-1]
            rank = np.full(len(symbols), 1 << 40, np.int64)
            where = np.flatnonzero(inner)
            rank[where] = self._rank(symbols[where], symbols[where + 1])
            heads = np.flatnonzero(np.append(True, ~inner))
            lengths = np.diff(np.append(heads, len(symbols)))
            lowest = np.minimum.reduceat(rank, heads)
            alive = np.repeat(lowest < (1 << 40), lengths)
            if not alive.all():
                done_symbols.append(symbols[~alive])
                done_owner.append(owner[~alive])
                lowest = np.repeat(lowest, lengths)[alive]
                symbols, owner, rank = symbols[alive], owner[alive], rank[alive]
            else:
                lowest = np.repeat(lowest, lengths)
            if not len(symbols):
                break
            at = np.flatnonzero(rank == lowest)
            # Of places that follow each other without a gap (equal symbols) every second one is taken.
            chain = np.append(True, np.diff(at) != 1)
            since = np.arange(len(at)) - np.maximum.accumulate(np.where(chain, np.arange(len(at)), 0))
            at = at[since % 2 == 0]
            symbols = symbols.copy()
            symbols[at] = self.by_rank[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done_symbols:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.bincount(owner, minlength=len(words))


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class Encoder:
    """Encodes batches of texts, keeping the ids of up to ``cached`` distinct pre-tokens from batch to batch."""

    def __init__(self, path: str, cached: int = 200_000):
        self.bpe, self.cached = Bpe.from_file(path), cached
        self._forget()

    def _forget(self) -> None:
        self.number: dict[int, int] = {}  # of a known pre-token, by its key
        self.offsets, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _known(self, keys: list[int], word) -> np.ndarray:
        """Number of each pre-token in the store, after merging those that are new; word gives the i-th as a string."""
        if len(self.number) + len(keys) > max(self.cached, len(keys)):
            self._forget()
        out = np.array([self.number.get(k, -1) for k in keys], np.int64)
        missing = np.flatnonzero(out < 0).tolist()
        if missing:
            ids, counts = self.bpe.merge([word(i).encode("utf-8", "surrogatepass") for i in missing])
            base = len(self.number)
            self.number.update((keys[i], base + n) for n, i in enumerate(missing))
            out[missing] = np.arange(base, base + len(missing))
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(counts)])
            self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        return out

    def _segments(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Texts cut at special strings: the pieces, the text of each, and the special id after each (or -1)."""
        special = self.bpe.special
        if not any(s in t for s in special for t in texts):
            return texts, np.arange(len(texts)), np.full(len(texts), -1, np.int64)
        import re

        cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")")
        pieces, owner, after = [], [], []
        for i, t in enumerate(texts):
            parts = cut.split(t)
            for k in range(0, len(parts), 2):
                pieces.append(parts[k])
                owner.append(i)
                after.append(special[parts[k + 1]] if k + 1 < len(parts) else -1)
        return pieces, np.array(owner, np.int64), np.array(after, np.int64)

    def _pretokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        pieces, owner, after = self._segments(texts)
        joined, cps, ends = code_points(pieces)
        starts = pretoken_starts(cps, ends[:-1][ends[:-1] < len(cps)])
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), owner, after
        index, inverse, keys = distinct_spans(cps, starts)
        begin, end = starts[index].tolist(), np.append(starts, len(cps))[index + 1].tolist()
        piece = np.searchsorted(ends, starts, side="right") - 1
        return self._known(keys, lambda i: joined[begin[i] : end[i]])[inverse], piece, owner, after

    def count(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        word, piece, owner, after = self._pretokens(texts)
        sizes = np.diff(self.offsets)[word] if len(word) else np.zeros(0, np.int64)
        per_piece = np.bincount(piece, weights=sizes, minlength=len(owner)).astype(np.int64) + (after >= 0)
        return np.bincount(owner, weights=per_piece, minlength=len(texts)).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other (uint32), and where each text's ids start (one more entry: the end)."""
        word, piece, owner, after = self._pretokens(texts)
        if (after >= 0).any():  # a special id is one more pre-token at the end of its piece
            special = np.flatnonzero(after >= 0)
            base = self.offsets[-1]
            values = np.unique(after[special])
            offsets = np.concatenate([self.offsets, base + 1 + np.arange(len(values))])
            ids = np.concatenate([self.ids, values.astype(np.uint32)])
            word = np.concatenate([word, len(self.offsets) - 1 + np.searchsorted(values, after[special])])
            piece = np.concatenate([piece, special])
            order = np.argsort(piece, kind="stable")
            word, piece = word[order], piece[order]
        else:
            offsets, ids = self.offsets, self.ids
        sizes = offsets[word + 1] - offsets[word]
        total = int(sizes.sum())
        ends = np.cumsum(sizes)
        take = np.arange(total) - np.repeat(ends - sizes, sizes) + np.repeat(offsets[word], sizes)
        per_text = np.bincount(owner[piece], weights=sizes, minlength=len(texts)).astype(np.int64)
        return ids[take], np.concatenate([[0], np.cumsum(per_text)])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)


def batches(texts: list[str], size: int):
    """Index ranges of about ``size`` characters each; a longer text is a range of its own."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield at, i
            at, total = i, 0
        total += len(t)
    if at < len(texts):
        yield at, len(texts)
