"""Text embedding: the seam for any model, an adapter for pretrained models, and a hashing embedder."""

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    """Turns a text column into a vector column of ``dims`` floats. A model can be an Arrow or pandas UDF behind it."""

    dims: int

    def embed(self, text: Column) -> Column: ...


# The white space that separates words (with tab to carriage return and space).
SPACES = "\\x09-\\x0D\\x20\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
# The 32-bit FNV-1a parameters.
FNV_OFFSET, FNV_PRIME, MASK32 = 2166136261, 16777619, 4294967295


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), f"[{SPACES}]+"), lambda w: w != "")


def utf16_units(word: Column) -> Column:
    """Code units of a word; a character past U+FFFF gives its two surrogates."""
    points = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    pair = lambda p: F.array(F.lit(0xD800) + F.shiftright(p - 0x10000, 10), F.lit(0xDC00) + (p - 0x10000).bitwiseAND(F.lit(0x3FF)))
    return F.flatten(F.transform(points, lambda p: F.when(p > 0xFFFF, pair(p)).otherwise(F.array(p))))


def bucket(word: Column, dims: int) -> Column:
    h = F.aggregate(utf16_units(word), F.lit(FNV_OFFSET).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(MASK32)))
    return (h % dims).cast("int")


def _bucket_of(word: str, dims: int) -> int:
    """As ``bucket``, of one word."""
    h, units = FNV_OFFSET, memoryview(word.encode("utf-16-le", "surrogatepass")).cast("H")
    for c in units:
        h = (h ^ c) * FNV_PRIME & MASK32
    return h % dims


class HashingEmbedder:
    """Counts of words by the bucket of their FNV-1a hash, divided by the Euclidean norm (zero vector: left as it is).

    An Arrow UDF: a process hashes each distinct word once (up to a bound, then it starts anew) and counts by array.
    """

    REMEMBERED = 500_000

    def __init__(self, dims: int = 32):
        self.dims = dims

    def embed(self, text: Column) -> Column:
        dims, space, most, hashed = self.dims, re.compile(f"[{SPACES}]+"), self.REMEMBERED, _bucket_of

        def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known: dict[str, int] = {}
            for texts in batches:
                if len(known) > most:
                    known.clear()
                out = []
                for t in texts:
                    words = [w for w in space.split(t) if w] if dims else []
                    for w in words:
                        if w not in known:
                            known[w] = hashed(w, dims)
                    n = np.bincount([known[w] for w in words], minlength=dims).astype(float)
                    norm = np.sqrt((n * n).sum())
                    out.append((n / norm if norm else n).astype(np.float32))
                yield pd.Series(out)

        return F.pandas_udf(vectors, "array<float>")(F.lower(F.coalesce(text, F.lit(""))))


class ModelEmbedder:
    """Any model behind the seam: ``load()`` is called once in a Python worker and gives a function from a list of texts
    to their vectors, which is then called for at most ``batch`` texts at a time. Null texts are embedded as empty.

    ``load`` is sent to the executors, so it should import and open the model itself (from a path that they can read).
    """

    def __init__(self, load: Callable[[], Callable[[list[str]], list]], dims: int, batch: int = 64):
        self.load, self.dims, self.batch = load, dims, batch

    def embed(self, text: Column) -> Column:
        load, dims, size = self.load, self.dims, self.batch

        def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = None
            for texts in batches:
                model = model or load()
                own, out = texts.tolist(), []
                for a in range(0, len(own), size):
                    got = np.asarray(model(own[a : a + size]), np.float32)
                    if got.shape != (len(own[a : a + size]), dims):
                        raise ValueError(f"the model gave vectors of shape {got.shape}, not of length {dims}")
                    out += list(got)
                yield pd.Series(out)

        return F.pandas_udf(vectors, "array<float>")(F.coalesce(text, F.lit("")))
