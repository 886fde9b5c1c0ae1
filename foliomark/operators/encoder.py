"""Sentence vectors. The encoder is a parameter; the one here needs no model file."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..plans.session import ship

WIDTH = 384


def _hashed_parts(word: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, signed weights) of a word and its trigrams."""
    hashes = [xxhash.xxh32_intdigest(part) for part in (word, *(f"#{word}#"[i : i + 3] for i in range(len(word))))]
    weights = [(1.0 if i == 0 else 0.3) * (1 if h & 0x80000000 else -1) for i, h in enumerate(hashes)]
    return np.array([h % width for h in hashes], np.int64), np.array(weights, np.float32)


#: Words recur, so their parts are kept; long ones (unspaced text) seldom do.
_kept_parts = lru_cache(1 << 16)(_hashed_parts)


def hashed_vectors(texts: list[str], width: int = WIDTH) -> np.ndarray:
    """Length-one vectors of signed hashes of words and of character trigrams within them; empty texts give zeros."""
    out = np.zeros((len(texts), width), np.float32)
    for row, text in enumerate(texts):
        words = (word.strip(".,;:!?()[]\"'“”«»") for word in text.lower().split())
        parts = [(_kept_parts if len(word) <= 40 else _hashed_parts)(word, width) for word in words]
        if parts:
            # in the order of the text and in single precision
            np.add.at(out[row], np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms == 0, 1, norms)


def encode_sentences(df: DataFrame, text_col: str = "sentence", encoder: Callable[[list[str]], np.ndarray] = hashed_vectors) -> DataFrame:
    """``df`` with a column embedding; null texts count as empty. The encoder is called once for each Arrow batch."""
    ship(df.sparkSession)

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(encoder(texts.fillna("").tolist())))

    return df.withColumn("embedding", embed(F.col(text_col)))
