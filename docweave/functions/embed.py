"""Embedding functions: columns from text to ARRAY<FLOAT>."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"[^\W_]+")


@lru_cache(1 << 16)
def _code(token: str) -> int:
    return zlib.crc32(token.encode())


def hashed_vector(text: str | None, dim: int = 64) -> np.ndarray:
    """Each token adds +1 or -1 at a hashed place, or +1 where these cancel each
    other at all places; unit length, zeros without tokens."""
    codes = np.array([_code(t) for t in _TOKEN.findall((text or "").lower())], np.int64)
    v = np.bincount(codes % dim, np.where(codes >> 31, 1.0, -1.0), dim).astype(np.float64) if len(codes) else np.zeros(dim)
    if len(codes) and not v.any():
        v = np.bincount(codes % dim, minlength=dim).astype(np.float64)
    size = np.sqrt((v**2).sum())
    return (v / size if size else v).astype(np.float32)


def hashed(text: Column, dim: int = 64) -> Column:
    """Deterministic term vectors in Arrow batches: an offline stand-in for a model."""

    @F.arrow_udf("array<float>")
    def embed(texts: pa.Array) -> pa.Array:
        # One text at a time becomes Python's: rows may be whole documents.
        flat = np.empty((len(texts), dim), np.float32)
        for row, t in enumerate(texts):
            flat[row] = hashed_vector(t.as_py(), dim)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim), flat.ravel())

    return embed(text)


def batched(load: Callable[[], Callable[[list[str]], np.ndarray]], dim: int, batch_size: int = 32) -> Callable[[Column], Column]:
    """A column function around a model: ``load`` runs once for each Python
    worker and gives a function from a list of texts to an array of vectors,
    which is called with ``batch_size`` texts at most (settings: embedding)."""

    def make():
        model = load()

        def predict(texts: np.ndarray) -> np.ndarray:
            return np.asarray(model(["" if t is None else str(t) for t in texts.reshape(-1)]), np.float32).reshape(-1, dim)

        return predict

    return predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)


def hashed_model(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """The offline stand-in in a model's form."""
    return lambda texts: np.stack([hashed_vector(t, dim) for t in texts])


def with_embedding(df: DataFrame, text_col: str = "document", embed: Callable[[Column], Column] = hashed) -> DataFrame:
    """``embed`` may be a pandas UDF around a model; Arrow batches bound its calls."""
    return df.withColumn("embedding", embed(F.col(text_col)))
