"""Filling fixed-capacity containers with whole texts of related content (problem 8).

Texts are spread over shards by a hash; each shard builds a BM25 inverted index, and each container starts
from the longest unused text of its shard, takes the unused neighbours the index returns, best first, until none
of them fits, and closes what is then left with the longest text that still fits.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import arrow_map, ship, staged
from .tokens import DEFAULT_VOCABULARY, count
from .words import words

K1, B = 1.2, 0.75
SCHEMA = "doc_key {kind}, piece_index int, container_id string, n_tokens int"


def _features(df: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """(id, tokens, number of words, distinct term hashes, term counts), arrays packed as bytes."""

    def run(ids, texts):
        sizes, lengths, terms, tfs = [], [], [], []
        cache: dict[str, int] = {}
        for text in texts:
            sizes.append(count(text, path))
            bag = Counter(words(text)) if text else {}
            for w in bag:
                if w not in cache:
                    cache[w] = xxhash.xxh32_intdigest(w)
            lengths.append(sum(bag.values()))
            terms.append(np.fromiter((cache[w] for w in bag), np.uint32, len(bag)).tobytes())
            tfs.append(np.minimum(np.fromiter(bag.values(), np.int64, len(bag)), 65535).astype(np.uint16).tobytes())
        return ids, sizes, lengths, terms, tfs

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(F.col(id_col).alias("doc_key"), text_col), run, f"doc_key {kind}, n_tokens int, n_words int, terms binary, tfs binary")


class Index:
    """A BM25 inverted index over the texts of one shard."""

    def __init__(self, terms: list[np.ndarray], tfs: list[np.ndarray], lengths: np.ndarray):
        n = len(terms)
        doc = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t in terms])
        flat = np.concatenate(terms) if n else np.zeros(0, np.uint32)
        tf = np.concatenate(tfs).astype(np.float32) if n else np.zeros(0, np.float32)
        self.vocabulary, number = np.unique(flat, return_inverse=True)
        order = np.argsort(number, kind="stable")
        self.docs = doc[order]
        df = np.bincount(number, minlength=len(self.vocabulary))
        self.begin = np.concatenate([[0], np.cumsum(df)])
        norm = K1 * (1 - B + B * lengths / max(lengths.mean() if n else 1, 1e-9))
        idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
        self.weights = (idf[number] * tf * (K1 + 1) / (tf + norm[doc]).astype(np.float32))[order]
        self.number, self.offsets, self.n = number, np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(int), n

    def scores(self, seed: int) -> np.ndarray:
        """BM25 score of every text for the terms of ``seed``."""
        out = np.zeros(self.n, np.float32)
        for t in self.number[self.offsets[seed] : self.offsets[seed + 1]]:
            a, b = self.begin[t], self.begin[t + 1]
            if b - a > 1:
                out[self.docs[a:b]] += self.weights[a:b]
        return out


def fill(sizes: list[int], index: Index, capacity: int) -> list[list[int]]:
    """Containers as lists of positions; every size must be within the capacity."""
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    keys = [(sizes[i], i) for i in order]  # unused texts by size
    used = np.zeros(len(sizes), bool)
    out: list[list[int]] = []

    def take(i: int) -> None:
        del keys[bisect_right(keys, (sizes[i], i)) - 1]
        used[i] = True

    while keys:
        seed = keys[-1][1]
        take(seed)
        content, left = [seed], capacity - sizes[seed]
        if keys and left >= keys[0][0]:
            score = index.scores(seed)
            score[used] = -1
            near = np.flatnonzero(score > 0)
            for i in near[np.lexsort((near, -score[near]))].tolist():
                if not keys or left < keys[0][0]:
                    break
                if sizes[i] <= left:
                    take(i)
                    content.append(i)
                    left -= sizes[i]
            while keys and left >= keys[0][0]:
                # of the sizes that leave the least space the one most alike
                k = bisect_right(keys, (left, len(sizes))) - 1
                best, size = keys[k][1], keys[k][0]
                while k >= 0 and keys[k][0] == size:
                    if score[keys[k][1]] > score[best]:
                        best = keys[k][1]
                    k -= 1
                take(best)
                content.append(best)
                left -= sizes[best]
        out.append(content)
    return out


def pack(df: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = 2000, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """One row per text, or per piece of a text above the capacity: (id, piece_index, container_id, n_tokens).

    Texts above the capacity are cut after every ``capacity`` tokens; full pieces have a container each and the
    rest is packed like a text. Null and empty texts have 0 tokens and lie in the first container of their
    shard. Repeated rows are packed each. An empty table gives no rows; further columns are ignored. Shards have
    about ``shard_rows`` rows at any size of the table, so that memory and time of a task stay the same.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    features = staged(_features(df, id_col, text_col, path), "pack")
    kind = df.schema[id_col].dataType.simpleString()
    shards = max(1, math.ceil(features.count() / shard_rows))
    ship(df.sparkSession)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_key", "n_tokens"], kind="stable").reset_index(drop=True)
        shard = key[0]
        rows, open_sizes = [], []
        for i, size in enumerate(pdf.n_tokens.tolist()):
            full = size // capacity if size > capacity else 0
            rest = size - full * capacity
            rows += [(i, p, f"{shard}-{i}-{p}", capacity) for p in range(full)]
            open_sizes.append(rest if not (full and rest == 0) else -1)
        packed = [i for i, s in enumerate(open_sizes) if s > 0]
        index = Index([np.frombuffer(pdf.terms[i], np.uint32) for i in packed], [np.frombuffer(pdf.tfs[i], np.uint16) for i in packed], pdf.n_words.to_numpy()[packed].astype(np.float64))
        for number, content in enumerate(fill([open_sizes[i] for i in packed], index, capacity)):
            for x in content:
                i = packed[x]
                size = int(pdf.n_tokens[i])
                rows.append((i, size // capacity if size > capacity else 0, f"{shard}-{number}", open_sizes[i]))
        rows += [(i, 0, f"{shard}-0", 0) for i, s in enumerate(open_sizes) if s == 0]
        out = pd.DataFrame(rows, columns=["i", "piece_index", "container_id", "n_tokens"])
        out.insert(0, "doc_key", pdf.doc_key.to_numpy()[out.i.to_numpy(dtype=int)] if len(out) else [])
        return out.drop(columns="i")

    return (
        features.withColumn("_shard", F.pmod(F.xxhash64(F.coalesce(F.col("doc_key").cast("string"), F.lit(""))), F.lit(shards)))
        .groupBy("_shard")
        .applyInPandas(run, SCHEMA.format(kind=kind))
        .withColumnRenamed("doc_key", id_col)
    )


def container_fill(packed: DataFrame, capacity: int) -> DataFrame:
    """(containers, tokens, fill) over all containers of a packing."""
    return (
        packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t"))
        .agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("largest"), (F.sum("t") / (F.count("*") * F.lit(capacity))).alias("fill"))
    )
