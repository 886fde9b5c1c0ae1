"""Token counts and token boundaries under a public byte-level tokenizer."""

from __future__ import annotations

import base64
import functools
import os

import numpy as np
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from ..plans.session import arrow_map

#: Split pattern of the byte-level vocabularies; fixed value of the public tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = os.environ.get("FOLIOMARK_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


@functools.cache
def encoding(path: str = DEFAULT_VOCABULARY) -> tiktoken.Encoding:
    """The tokenizer of a rank file, loaded once a process. Special tokens are ordinary text."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _byte_lengths(path: str) -> np.ndarray:
    e = encoding(path)
    out = np.zeros(e.max_token_value + 1, np.int32)
    for token in range(len(out)):
        try:
            out[token] = len(e.decode_single_token_bytes(token))
        except KeyError:
            pass
    return out


def count(text: str | None, path: str = DEFAULT_VOCABULARY) -> int:
    """Tokens of a text; 0 for null and empty."""
    return len(encoding(path).encode_ordinary(text)) if text else 0


def token_ends(text: str, path: str = DEFAULT_VOCABULARY) -> np.ndarray:
    """For each token the number of characters that end at or before its end."""
    tokens = np.array(encoding(path).encode_ordinary(text), np.int64)
    at = np.cumsum(_byte_lengths(path)[tokens])
    if text.isascii():
        return at
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    chars = np.cumsum((raw & 0xC0) != 0x80)  # characters begun after each byte
    begun = chars[np.minimum(at, len(raw)) - 1]
    inside = np.zeros(len(at), bool)  # the token ends inside a character
    follow = at < len(raw)
    inside[follow] = (raw[at[follow]] & 0xC0) == 0x80
    return begun - inside


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, n_tokens) for every row; null and empty texts have 0 tokens, repeated rows stay repeated."""

    def run(ids, texts):
        return ids, [count(t, path) for t in texts]

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(id_col, text_col), run, f"`{id_col}` {kind}, n_tokens int")


def limit(spark: SparkSession, sf_dir: str, name: str) -> tuple[int, int]:
    """(max_tokens, overlap_tokens) of a row of size_limits, a table of a few rows."""
    from pyspark.sql import functions as F

    from ..plans.session import table

    row = table(spark, sf_dir, "size_limits").filter(F.col("limit_name") == name).first()
    if row is None:
        raise ValueError(f"size_limits has no {name}")
    return row["max_tokens"], row["overlap_tokens"]
