"""Models behind Arrow functions, with deterministic offline stand-ins.

A provider is a plain function over batches; anything with the same shape (a served model, a local network) may take a
stand-in's place. Stand-ins give equal results on every partition and every run.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

EmbedTexts = Callable[[Sequence[str]], np.ndarray]
ScorePairs = Callable[[Sequence[str], Sequence[str]], np.ndarray]

#: Prefixes that embedding models expect, by family: of a query and of a document.
PREFIXES = {"search": ("search_query: ", "search_document: "), "passage": ("query: ", "passage: "), "none": ("", "")}
_WORD = re.compile(r"\w+")
_MASK = (1 << 64) - 1


def _hash(text: str) -> int:
    h = 14695981039346656037
    for b in text.encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * 1099511628211) & _MASK
    return h ^ (h >> 29)


def hashing_embedder(dim: int = 256) -> EmbedTexts:
    """Unit vectors of signed, hashed words."""

    def embed(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in _WORD.findall(t.lower()):
                h = _hash(w)
                out[i, h % dim] += 1.0 if h >> 63 else -1.0
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0)

    return embed


def embedder(make: Callable[[], EmbedTexts] = hashing_embedder, family: str = "search", query: bool = False):
    """A column function text -> array<float>; the model is made once for each task."""
    prefix = PREFIXES[family][0 if query else 1]

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            vectors = model([prefix + (t or "") for t in batch])
            yield pd.Series(list(vectors.astype(np.float32)))

    return embed


def overlap_scorer(queries: Sequence[str], passages: Sequence[str]) -> np.ndarray:
    """Jaccard similarity of the word sets."""
    words = lambda t: set(_WORD.findall((t or "").lower()))
    return np.array([len(words(a) & words(b)) / max(1, len(words(a) | words(b))) for a, b in zip(queries, passages, strict=True)], float)


def reranker(score: ScorePairs = overlap_scorer, max_chars: int = 4_000):
    """A column function (query, passage) -> double; passages are cut as a cross-encoder's window would."""

    @F.pandas_udf("double")
    def run(query: pd.Series, passage: pd.Series) -> pd.Series:
        return pd.Series(score(query.tolist(), [(p or "")[:max_chars] for p in passage]))

    return run


def extractive_answer(prompt: str, chunks: Sequence[str], sentences: int = 1) -> str:
    """First sentences of the chunks."""
    return " ".join(" ".join(re.split(r"(?<=[.!?])\s+", c.strip())[:sentences]) for c in chunks if c and c.strip())


def synthesize(prompt: str, chunks: Sequence[str], mode: str = "compact", answer: Callable[[str, Sequence[str]], str] = extractive_answer, window: int = 6_000, fan_in: int = 4) -> str:
    """An answer from chunks: compact packs them into windows and refines over these; tree answers groups and then their
    answers; refine goes chunk by chunk; simple takes what fits one window."""
    if mode == "simple":
        return answer(prompt, ["\n\n".join(chunks)[:window]])
    if mode == "tree":
        level = list(chunks)
        while len(level) > fan_in:
            level = [answer(prompt, level[i : i + fan_in]) for i in range(0, len(level), fan_in)]
        return answer(prompt, level)
    parts: list[list[str]] = []
    size = window + 1
    for c in chunks:
        if mode == "refine" or size + len(c) > window:
            parts.append([])
            size = 0
        parts[-1].append(c)
        size += len(c)
    so_far = ""
    for part in parts:
        so_far = answer(prompt, [so_far, *part] if so_far else part)
    return so_far


_NAME = re.compile(r"\b[A-ZА-ЯЁ][\w-]+(?:\s+[A-ZА-ЯЁ][\w-]+)*")


def extract_graph(text: str, max_chars: int | None = None, entities: int = 12, relations: int = 15) -> dict:
    """Entities (runs of capitalised words) and relations between neighbours, in the shape a model would answer: so many
    of each at most, from the whole text or, for a model with a window, from its first max_chars characters."""
    names = list(dict.fromkeys(m[0] for m in _NAME.finditer((text or "")[:max_chars]) if len(m[0]) >= 3))[:entities]
    pairs = list(zip(names, names[1:], strict=False))[:relations]
    return {"entities": [{"name": n, "description": ""} for n in names], "relationships": [{"source": a, "target": b, "relation": "связан с"} for a, b in pairs]}


def _struct(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


GRAPH = T.StructType([T.StructField("entities", T.ArrayType(_struct("name", "description"))), T.StructField("relationships", T.ArrayType(_struct("source", "target", "relation")))])


@F.pandas_udf(GRAPH)
def graph_of(text: pd.Series) -> pd.DataFrame:
    found = [extract_graph(t) for t in text]
    return pd.DataFrame({"entities": [f["entities"] for f in found], "relationships": [f["relationships"] for f in found]})
