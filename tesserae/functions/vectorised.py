"""The few functions that need numpy: transforms and blurs of square planes and the text hash, by Arrow batch."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, LongType


def _planes(v: pd.Series) -> np.ndarray:
    side = int(round(len(v.iloc[0]) ** 0.5)) if len(v) else 1
    return np.stack(v.to_numpy()).astype(float).reshape(len(v), side, side)


def _rows(planes: np.ndarray) -> pd.Series:
    return pd.Series(list(planes.reshape(len(planes), -1)))


def _blur(planes: np.ndarray) -> np.ndarray:
    """Mean of the 3 x 3 neighbourhood, edges repeated."""
    n = planes.shape[1]
    padded = np.pad(planes, ((0, 0), (1, 1), (1, 1)), mode="edge")
    return sum(padded[:, i : i + n, j : j + n] for i in range(3) for j in range(3)) / 9


@pandas_udf(ArrayType(DoubleType()))
def dct2(v: pd.Series) -> pd.Series:
    """Orthonormal two-dimensional cosine transform of a square plane."""
    if not len(v):
        return v
    p = _planes(v)
    n = p.shape[1]
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n)) * np.sqrt(2 / n)
    basis[0] /= np.sqrt(2)
    return _rows(basis @ p @ basis.T)


@pandas_udf(ArrayType(DoubleType()))
def flat_field(v: pd.Series) -> pd.Series:
    """The plane less its blur, on the plane's mean."""
    if not len(v):
        return v
    p = _planes(v)
    return _rows(p - _blur(p) + p.mean(axis=(1, 2), keepdims=True))


@pandas_udf(ArrayType(DoubleType()))
def retinex(v: pd.Series) -> pd.Series:
    """Log of the shifted plane less log of its blur."""
    if not len(v):
        return v
    p = _planes(v)
    p = p - p.min(axis=(1, 2), keepdims=True) + 1
    return _rows(np.log(p) - np.log(_blur(p)))


_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")


def similarity_hash(lowered: str, text: str | None, words: int = 3, step: int = 1 << 16) -> int:
    """60 bits: the majority of each bit over the digests of the distinct shingles; a text of fewer words is one shingle."""
    w = [x for x in _BLANKS.split(lowered) if x]
    shingles = set(map(" ".join, zip(*(w[i:] for i in range(words)), strict=False))) if len(w) >= words else {text}
    raw = b"".join([hashlib.sha256(s.encode()).digest()[:8] for s in shingles])
    codes = np.frombuffer(raw, np.uint8).reshape(-1, 8)
    ones = sum(np.unpackbits(codes[i : i + step], axis=1).sum(0, dtype=np.int64) for i in range(0, len(codes), step))[:60]
    return int("".join("1" if 2 * n > len(codes) else "0" for n in ones), 2)


def _hashes(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for lowered, text in columns:
        # one text at a time: a batch is never held as Python strings
        yield pa.array((None if not a.is_valid else similarity_hash(a.as_py(), b.as_py()) for a, b in zip(lowered, text, strict=True)), pa.int64())
        del lowered, text
        pa.default_memory_pool().release_unused()


_hashes.__annotations__ = {"columns": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
simhash60 = arrow_udf(_hashes, LongType())
