"""A bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A word's input is its own embedding, by a hash of the whole word, beside the sum of the embeddings of its character
n-grams, with marks at both ends, over the root of their number. Both are projected to the gates once for each distinct word of a batch. Two gated recurrent
layers read a window forwards and backwards; attention weighs their states; a logistic unit scores the pooled state.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from quernstone.llm import bpe

GRAMS = (3, 4, 5)
WORD_BITS, GRAM_BITS = 18, 18
WORD_DIM, GRAM_DIM, HIDDEN, ATTENTION = 8, 16, 8, 8
WINDOW, STRIDE = 64, 32
#: Characters of texts, distinct words whose n-grams, and windows whose states, are held as arrays at a time.
CHARS_AT_A_TIME, WORDS_AT_A_TIME, WINDOWS_AT_A_TIME = 250_000, 4_096, 1_024

#: Texts whose words are held together in training.
TEXTS_AT_A_TIME = 500

_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Part:
    """Words (runs of letters and digits, in lower case) of some texts: hashes, and the characters of the distinct ones."""

    def __init__(self, texts: list[str]):
        _, cps, ends = bpe.code_points([t.lower() for t in texts])
        kind = bpe.char_classes()[cps]
        inside = (kind == bpe.LETTER) | (kind == bpe.NUMBER)
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        at = ends[:-1][ends[:-1] < len(cps)]
        begin[at] |= inside[at]
        starts = np.flatnonzero(begin)
        self.counts = np.diff(np.searchsorted(starts, ends))
        cps = cps[inside]
        starts = (np.cumsum(inside) - 1)[starts]
        self.code, self.distinct = pd.factorize(bpe.spans_hash(cps, starts))
        first = np.zeros(len(self.distinct), np.int64)
        first[self.code[::-1]] = np.arange(len(self.code))[::-1]
        begins = starts[first]
        self.sizes = np.append(starts, len(cps))[first + 1] - begins
        take = np.arange(int(self.sizes.sum())) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.chars = cps[np.repeat(begins, self.sizes) + take]


class Words:
    """Texts as numbers of distinct words (code), where each text's words begin (ends), and each distinct word's bucket and characters."""

    def __init__(self, texts: list[str]):
        parts = [_Part(texts[a:b]) for a, b in bpe.batches(texts, CHARS_AT_A_TIME)] or [_Part([])]
        self.ends = np.append(0, np.cumsum(np.concatenate([p.counts for p in parts])))
        # Distinct words of each part, then of all parts together; equal 64-bit hashes count as the same word.
        known, distinct = pd.factorize(np.concatenate([p.distinct for p in parts]))
        shift = np.cumsum([0, *(len(p.distinct) for p in parts)])
        self.code = np.concatenate([known[p.code + s] for p, s in zip(parts, shift[:-1], strict=True)])
        self.bucket = ((distinct.astype(np.uint64) * _MIX) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        first = np.zeros(len(distinct), np.int64)
        first[known[::-1]] = np.arange(len(known))[::-1]
        sizes = np.concatenate([p.sizes for p in parts])
        begins, self.sizes = (np.cumsum(sizes) - sizes)[first], sizes[first]
        chars = np.concatenate([p.chars for p in parts])
        # Distinct words one after the other, with a mark (1 and 2) at both ends.
        padded = self.sizes + 2
        self.offset = np.cumsum(padded) - padded
        self.marked = np.full(int(padded.sum()), 2, np.int64)
        self.marked[self.offset] = 1
        take = np.arange(int(self.sizes.sum())) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.marked[np.repeat(self.offset + 1, self.sizes) + take] = chars[np.repeat(begins, self.sizes) + take]

    def grams(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the n-grams of the distinct words a to b, and where each word's begin."""
        sizes = self.sizes[a:b] + 2
        base = int(self.offset[a])
        chars = self.marked[base : base + int(sizes.sum())].astype(np.uint64)
        left = np.repeat(self.offset[a:b] - base + sizes, sizes) - np.arange(len(chars))  # to the word's end
        rolling, parts, words = np.zeros(len(chars), np.uint64), [], np.repeat(np.arange(b - a), sizes)
        owner = []
        for n in range(1, min(max(GRAMS), len(chars)) + 1):
            rolling = rolling * np.uint64(0x100000001B3)
            rolling[: len(chars) - n + 1] += chars[n - 1 :] + np.uint64(n)
            if n in GRAMS:
                fits = np.flatnonzero(left >= n)
                parts.append(((rolling[fits] * _MIX) >> np.uint64(64 - GRAM_BITS)).astype(np.int64))
                owner.append(words[fits])
        bucket, owner = np.concatenate(parts), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        return bucket[order], np.searchsorted(owner[order], np.arange(b - a + 1))


def window_spans(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of all overlapping windows; a text without words is one empty window."""
    count = np.maximum(0, -(-(n_words - WINDOW) // STRIDE)) + 1
    text = np.repeat(np.arange(len(n_words)), count)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return text, first, np.minimum(WINDOW, n_words[text] - first)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class BiGru:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.word = (rng.normal(size=(1 << WORD_BITS, WORD_DIM)) * 0.3).astype(np.float32)
        self.gram = (rng.normal(size=(1 << GRAM_BITS, GRAM_DIM)) * 0.3).astype(np.float32)
        self.dense = {
            "w_in": init(WORD_DIM + GRAM_DIM, 6 * HIDDEN), "b_in": np.zeros(6 * HIDDEN, np.float32),
            "u_f": init(HIDDEN, 3 * HIDDEN), "u_b": init(HIDDEN, 3 * HIDDEN),
            "w_a": init(2 * HIDDEN, ATTENTION), "b_a": np.zeros(ATTENTION, np.float32), "v_a": init(ATTENTION),
            "w_o": init(2 * HIDDEN), "b_o": np.zeros((), np.float32),
        }

    def __getstate__(self) -> dict:
        """Only embedding rows that aren't zero: those that training met."""
        some = {name: np.flatnonzero(getattr(self, name).any(1)).astype(np.int32) for name in ("word", "gram")}
        return {"dense": self.dense, **{name: (len(getattr(self, name)), rows, getattr(self, name)[rows]) for name, rows in some.items()}}

    def __setstate__(self, state: dict) -> None:
        self.dense = state["dense"]
        for name in ("word", "gram"):
            n, rows, values = state[name]
            table = np.zeros((n, values.shape[1]), values.dtype)
            table[rows] = values
            setattr(self, name, table)

    def inputs(self, words: Words) -> np.ndarray:
        """The embedding of each distinct word: of the word itself, then of its characters."""
        out = np.empty((len(words.bucket), WORD_DIM + GRAM_DIM), np.float32)
        out[:, :WORD_DIM] = self.word[words.bucket]
        for a in range(0, len(out), WORDS_AT_A_TIME):
            b = min(len(out), a + WORDS_AT_A_TIME)
            bucket, at = words.grams(a, b)
            out[a:b, WORD_DIM:] = np.add.reduceat(self.gram[bucket], at[:-1]) / np.sqrt(np.diff(at))[:, None]
        return out

    def _direction(self, gates: np.ndarray, codes: np.ndarray, mask: np.ndarray, backwards: bool, tape: list | None) -> np.ndarray:
        h3, u = 3 * HIDDEN, self.dense["u_b" if backwards else "u_f"]
        side = gates[:, h3:] if backwards else gates[:, :h3]
        h = np.zeros((codes.shape[1], HIDDEN), np.float32)
        out = np.empty((*codes.shape, HIDDEN), np.float32)
        for t in reversed(range(len(codes))) if backwards else range(len(codes)):
            x, hu = side[codes[t]], h @ u
            zr = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            m = mask[t]
            if tape is not None:
                tape.append((t, h, z, r, n, hu[:, 2 * HIDDEN :]))
            h = new if m is None else np.where(m[:, None], new, h)
            out[t] = h
        return out

    def forward(self, gates: np.ndarray, codes: np.ndarray, lengths: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """Logit of each window; codes: (place in the window, window), numbers of distinct words."""
        d = self.dense
        there = np.arange(len(codes))[:, None] < lengths
        full = there.all(1)
        mask = [None if f else m for f, m in zip(full, there, strict=True)]
        tapes = ([], []) if tape is not None else (None, None)
        states = np.concatenate([self._direction(gates, codes, mask, False, tapes[0]), self._direction(gates, codes, mask, True, tapes[1])], axis=2)
        tanh = np.tanh(states @ d["w_a"] + d["b_a"])
        score = np.where(there, tanh @ d["v_a"], -1e9)
        weight = np.exp(score - score.max(0, initial=-1e9)) * there
        weight = (weight / np.maximum(weight.sum(0), 1e-9)).astype(np.float32)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        if tape is not None:
            tape.update(states=states, tanh=tanh, weight=weight, pooled=pooled, tapes=tapes, there=there)
        return pooled @ d["w_o"] + d["b_o"]

    def logits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Logit, text, first word and number of words of every window."""
        text, first, size = window_spans(np.diff(words.ends))
        gates = self.inputs(words) @ self.dense["w_in"] + self.dense["b_in"]
        gates = np.vstack([gates, np.zeros((1, gates.shape[1]), np.float32)])  # for places behind a window's end
        out = np.empty(len(text), np.float32)
        order = np.argsort(-size, kind="stable")
        for a in range(0, len(order), WINDOWS_AT_A_TIME):
            part = order[a : a + WINDOWS_AT_A_TIME]
            out[part] = self.forward(gates, window_codes(words, text[part], first[part], size[part]), size[part])
        return out, text, first, size

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of each text: that of its highest window."""
        logit, text, *_ = self.logits(Words(texts))
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, text, logit.astype(float))
        return 0.5 * np.tanh(0.5 * best) + 0.5

    def gradients(self, words: Words, text: np.ndarray, first: np.ndarray, size: np.ndarray, target: np.ndarray, weight: np.ndarray, keep_word: float, rng: np.random.Generator):
        """Gradients of the weighted logistic loss over some windows: of the dense weights and of the embedding rows used."""
        d, codes = self.dense, window_codes(words, text, first, size)
        distinct, local = np.unique(codes, return_inverse=True)
        local = local.reshape(codes.shape)
        real = distinct[distinct < len(words.bucket)]
        x = np.zeros((len(distinct), WORD_DIM + GRAM_DIM), np.float32)
        kept = (rng.random(len(real)) < keep_word)[:, None]
        x[: len(real), :WORD_DIM] = self.word[words.bucket[real]] * kept
        grams = _subset(words, real)
        root = np.sqrt(np.diff(grams[1]))[:, None].astype(np.float32)
        if len(real):
            x[: len(real), WORD_DIM:] = np.add.reduceat(self.gram[grams[0]], grams[1][:-1]) / root
        tape: dict = {}
        logit = self.forward(x @ d["w_in"] + d["b_in"], local, size, tape)
        p = _sigmoid(logit)
        g = ((p - target) * weight / weight.sum()).astype(np.float32)
        out = {"w_o": tape["pooled"].T @ g, "b_o": g.sum()}
        d_pooled = g[:, None] * d["w_o"]
        states, a = tape["states"], tape["weight"]
        d_a = np.einsum("bh,tbh->tb", d_pooled, states)
        d_score = a * (d_a - (a * d_a).sum(0))
        d_tanh = d_score[:, :, None] * d["v_a"] * (1 - tape["tanh"] ** 2)
        out["v_a"] = np.einsum("tb,tba->a", d_score, tape["tanh"])
        out["w_a"], out["b_a"] = np.einsum("tbh,tba->ha", states, d_tanh), d_tanh.sum((0, 1))
        d_states = a[:, :, None] * d_pooled + d_tanh @ d["w_a"].T
        d_gates = np.zeros((*codes.shape, 6 * HIDDEN), np.float32)
        for k, name in enumerate(("u_f", "u_b")):
            u, d_u, dh = d[name], np.zeros_like(d[name]), np.zeros((codes.shape[1], HIDDEN), np.float32)
            for t, h, z, r, n, hun in reversed(tape["tapes"][k]):
                m = tape["there"][t][:, None]
                dh = dh + d_states[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                new = dh * m
                dn = new * (1 - z) * (1 - n * n)
                dz = new * (h - n) * z * (1 - z)
                dr = dn * hun * r * (1 - r)
                d_gates[t, :, 3 * k * HIDDEN : 3 * (k + 1) * HIDDEN] = np.hstack([dz, dr, dn])
                d_hu = np.hstack([dz, dr, dn * r])
                d_u += h.T @ d_hu
                dh = dh * ~m + new * z + d_hu @ u.T
            out[name] = d_u
        flat = local.ravel()
        order = np.argsort(flat, kind="stable")
        per_word = np.add.reduceat(d_gates.reshape(-1, 6 * HIDDEN)[order], np.searchsorted(flat[order], np.arange(len(distinct))))
        out["w_in"], out["b_in"] = x.T @ per_word, per_word.sum(0)
        d_x = (per_word @ d["w_in"].T)[: len(real)]
        word_rows = (words.bucket[real], d_x[:, :WORD_DIM] * kept)
        gram_rows = (grams[0], np.repeat(d_x[:, WORD_DIM:] / root, np.diff(grams[1]), axis=0))
        return out, word_rows, gram_rows


def window_codes(words: Words, text: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(place, window) numbers of distinct words; places behind a window's end hold the number of distinct words."""
    place = np.arange(int(size.max(initial=0)))[:, None]
    at = words.ends[text] + first + place
    pad = np.append(words.code, len(words.bucket))
    return pad[np.where(place < size, at, len(words.code))]


def _subset(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-gram buckets of some distinct words, as Words.grams has them."""
    if getattr(words, "_all", None) is None:
        parts = [words.grams(a, min(len(words.sizes), a + WORDS_AT_A_TIME)) for a in range(0, len(words.sizes), WORDS_AT_A_TIME)]
        shift = np.cumsum([0, *(len(p[0]) for p in parts)])
        words._all = (np.concatenate([p[0] for p in parts]).astype(np.int32), np.concatenate([*(p[1][:-1] + s for p, s in zip(parts, shift[:-1], strict=True)), shift[-1:]])) if parts else (np.zeros(0, np.int32), np.zeros(1, np.int64))
    bucket, at = words._all
    sizes = at[which + 1] - at[which]
    ends = np.cumsum(sizes)
    take = np.arange(int(sizes.sum())) + np.repeat(at[which] - (ends - sizes), sizes)
    return bucket[take], np.append(0, ends)


def _sum_rows(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    new = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, np.int64)
    return rows[new], np.add.reduceat(values[order], new) if len(new) else values


def train(texts: list[str], labels: list[int], seed: int = 7, updates: int = 40_000, keep_word: float = 0.7, rate: float = 0.01, row_rate: float = 0.08) -> BiGru:
    """A network whose highest window of a text tells its label.

    The first rounds take some windows of each text under the text's label; later rounds take the windows that score
    highest so far (for toxic texts the one, for clean texts two), so that a text's label rests on its worst window.
    There are about so many updates by windows, whatever the number of texts. Texts are taken in parts of bounded size.
    """
    rng, net, y = np.random.default_rng(seed), BiGru(seed), np.array(labels, np.float32)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.dense.items()}
    row_sums = {"word": np.full(1 << WORD_BITS, 1e-8, np.float32), "gram": np.full(1 << GRAM_BITS, 1e-8, np.float32)}
    order = rng.permutation(len(texts))
    parts = [(Words([texts[i] for i in part]), y[part]) for part in np.array_split(order, max(1, len(texts) // TEXTS_AT_A_TIME))]
    rounds = int(np.clip(updates / (1.6 * len(texts)), 5, 40))
    batch = int(np.clip(len(texts) / 12, 16, 192))
    warm, step = max(1, rounds // 4), 0
    for k in range(rounds):
        scale = rate * (1.0 if k < rounds * 0.7 else 0.3)
        for p in rng.permutation(len(parts)):
            words, target_of = parts[p]
            text, first, size = window_spans(np.diff(words.ends))
            chance = rng.random(len(text))
            logit = chance if k < warm else net.logits(words)[0] + 1e-3 * chance
            order = np.lexsort((-logit, text))
            rank = np.arange(len(order)) - np.searchsorted(text[order], text[order])
            most = np.where(target_of[text[order]] == 1, 3 if k < warm else 1, 2)
            chosen = rng.permutation(order[rank < most])
            for a in range(0, len(chosen), batch):
                part = chosen[a : a + batch]
                target = target_of[text[part]]
                dense, *rows = net.gradients(words, text[part], first[part], size[part], target, np.ones_like(target), keep_word, rng)
                step += 1
                for name, g in dense.items():
                    m, v = moments[name]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    net.dense[name] = (net.dense[name] - scale * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
                for name, (index, g) in zip(("word", "gram"), rows, strict=True):
                    index, g = _sum_rows(index, g)
                    row_sums[name][index] += (g * g).mean(1)
                    getattr(net, name)[index] -= row_rate * g / np.sqrt(row_sums[name][index])[:, None]
    # What training never met is zero, so that unknown words speak for neither label.
    net.word[row_sums["word"] <= 1e-8] = 0
    net.gram[row_sums["gram"] <= 1e-8] = 0
    return net
