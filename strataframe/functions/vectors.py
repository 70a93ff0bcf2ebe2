"""Vectors as arrays, and the encoder that needs no model."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[^\W_]+")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


#: Components up to which an inner product with a given vector is written out, which Spark compiles.
WRITTEN_OUT = 128


def dot_with(name: str, b: Sequence[float]) -> Column:
    """Inner product of a column with a given vector, in double precision and in order of components."""
    if not 0 < len(b) <= WRITTEN_OUT:
        return dot(F.col(name), F.array(*map(F.lit, map(float, b))))
    terms = " + ".join(f"cast(get(`{name}`, {k}) as double) * {float(y)!r}D" for k, y in enumerate(b))
    return F.expr(f"case when size(`{name}`) = {len(b)} then 0D + {terms} end")


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def truncated(a: Column, dim: int) -> Column:
    """The first ``dim`` components, padded with zeros, of unit length again; a zero vector stays zero."""
    cut = F.concat(F.slice(a, 1, dim), F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(dim) - F.size(a), F.lit(0))))
    length = norm(cut)
    return F.transform(cut, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(0.0))


def last_token(states: Column, mask: Column) -> Column:
    """Of an encoder's states (a vector a token) that of the last token which the mask keeps; null if it keeps none."""
    return F.get(states, F.array_max(F.transform(mask, lambda m, k: F.when(m > 0, k))))


_BUCKETS: dict[str, int] = {}
#: Tokens that a worker remembers.
REMEMBERED = 1 << 16


def _number(token: str) -> int:
    """The hash of a token, remembered by the worker: few tokens make most words."""
    found = _BUCKETS.get(token)
    if found is None:
        if len(_BUCKETS) >= REMEMBERED:
            _BUCKETS.clear()
        found = _BUCKETS[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16)
    return found


def _hashed(text: str | None, dim: int) -> np.ndarray:
    numbers = [_number(t) for t in _TOKEN.findall((text or "").lower())]
    counts = np.bincount(np.array(numbers, np.int64) % dim, minlength=dim).astype(float)
    length = np.sqrt((counts * counts).sum())
    return counts / length if length else counts


def hashed(text: Column | str, dim: int) -> Column:
    """A bag of hashed words of unit length; a text without words has the zero vector. An Arrow-batched UDF, as encoders are.

    Of a batch one text at a time is a Python object, and the vectors are one matrix, so a worker holds little beside the
    batch itself.
    """

    @F.arrow_udf("array<double>")
    def encode(texts: pa.Array) -> pa.Array:
        out = np.zeros((len(texts), dim))
        for k, text in enumerate(texts):
            out[k] = _hashed(text.as_py(), dim)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim, pa.int32()), pa.array(out.ravel()))

    return encode(text)


def hashed_query(text: str, dim: int) -> list[float]:
    """The same vector of a query."""
    return _hashed(text, dim).tolist()


class Encoder(Protocol):
    """Texts, or image bytes, to unit vectors of ``dim``; made once a worker."""

    dim: int

    def encode(self, values: list) -> list[list[float]]: ...


class HashedBytes:
    """An encoder that needs no model: bags of hashed runs of three bytes, of images or of texts in UTF-8, of unit length."""

    def __init__(self, dim: int):
        self.dim = dim

    def encode(self, values: list) -> list[list[float]]:
        out = []
        for value in values:
            x = np.frombuffer(value.encode() if isinstance(value, str) else value or b"", np.uint8).astype(np.int64)
            runs = (x[:-2] * 0x9E37 + x[1:-1] * 0x85EB + x[2:] * 0xC2B3) % 0xFFFB if len(x) > 2 else x
            counts = np.bincount(runs % self.dim, minlength=self.dim).astype(float)
            length = np.sqrt((counts * counts).sum())
            out.append((counts / length if length else counts).tolist())
        return out


def encoder_udf(make, dim: int):
    """A pandas UDF around an encoder; ``make()`` builds it, once a worker and in order of rows."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make()
        for batch in batches:
            yield pd.Series([[*v[:dim]] for v in encoder.encode(batch.tolist())] if len(batch) else [])

    return encode
