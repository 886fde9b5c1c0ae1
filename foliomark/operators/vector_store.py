"""An exact vector index kept as a versioned table: chunk, encode, replace, search, compare."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import chunks, pieces
from .encoder import encode_sentences, hashed_vectors
from .similarity import cosine, nearest
from .store import Store


def paragraph_chunks(documents: DataFrame, paragraphs: DataFrame, id_col: str = "doc_id", size: int = 200, overlap: int = 40, least: int = 10) -> DataFrame:
    """(id, paragraph_index, sub_index, chunk): paragraphs of ``least`` words or more that are no references, long ones cut.

    Documents without such a paragraph give chunks of their whole text under paragraph_index -1.
    """
    text = F.coalesce("text", F.lit(""))
    kept = paragraphs.filter(~F.coalesce("is_reference", F.lit(False)) & (F.size(pieces(text)) >= least)).dropDuplicates([id_col, "paragraph_index"])
    rows = kept.select(id_col, F.col("paragraph_index").cast("int").alias("paragraph_index"), F.posexplode(chunks(F.col("text"), size, overlap)).alias("sub_index", "chunk"))
    rest = documents.filter("text is not null").join(kept.select(id_col).distinct(), id_col, "left_anti")
    return rows.unionByName(rest.select(id_col, F.lit(-1).alias("paragraph_index"), F.posexplode(chunks(F.col("text"), size, overlap)).alias("sub_index", "chunk")))


def best_chunks(vectors: DataFrame, pairs: DataFrame, least: float = 0.7, key: str = "doc_id") -> DataFrame:
    """(a, b, vec_a, vec_b, score): for each chunk of document a the best chunk of document b, if it scores ``least``.

    ``pairs`` names the documents to compare; ties go to the smaller id.
    """
    a = vectors.select(F.col(key).alias("a"), F.col("vec_id").alias("vec_a"), F.col("embedding").alias("ea"))
    b = vectors.select(F.col(key).alias("b"), F.col("vec_id").alias("vec_b"), F.col("embedding").alias("eb"))
    scored = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "vec_a", "vec_b", cosine(F.col("ea"), F.col("eb")).alias("score"))
    order = Window.partitionBy("a", "b", "vec_a").orderBy(F.desc("score"), "vec_b")
    return scored.withColumn("_r", F.row_number().over(order)).filter("_r = 1").filter(F.col("score") >= least).drop("_r")


class VectorIndex:
    """Chunk vectors of documents in a store: (vec_id, doc_id, paragraph_index, sub_index, preview, embedding)."""

    def __init__(self, spark: SparkSession, store: Store, name: str = "vectors", encoder: Callable[[list[str]], np.ndarray] = hashed_vectors):
        self.spark, self.store, self.name, self.encoder = spark, store, name, encoder

    def index_documents(self, documents: DataFrame, paragraphs: DataFrame) -> None:
        """Chunk and encode documents; chunks kept before for the same documents are replaced."""
        found = paragraph_chunks(documents, paragraphs)
        vectors = encode_sentences(found.withColumnRenamed("chunk", "sentence"), encoder=self.encoder)
        rows = vectors.select(F.xxhash64("doc_id", "paragraph_index", "sub_index").alias("vec_id"), "doc_id", "paragraph_index", "sub_index", F.substring("sentence", 1, 500).alias("preview"), "embedding")
        current = self.store.read(self.name)
        if current is not None:
            rows = current.join(documents.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(rows)
        self.store.write(self.name, rows)

    def all(self) -> DataFrame:
        found = self.store.read(self.name)
        if found is None:
            raise LookupError(f"no index {self.name}")
        return found

    def get(self, doc_id: int) -> DataFrame:
        return self.all().filter(F.col("doc_id") == doc_id)

    def search(self, texts: list[str], k: int = 5, least: float = -1.0, doc_id: int | None = None) -> DataFrame:
        """(query_id, rank, score, doc_id, paragraph_index, preview) of the k nearest chunks of each text, in one document or in all."""
        base = self.all() if doc_id is None else self.get(doc_id)
        queries = self.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(self.encoder(texts))], "vec_id bigint, embedding array<float>")
        found = nearest(queries, base.select("vec_id", "embedding"), k, least, keep_self=True)
        return found.join(base.withColumnRenamed("vec_id", "id"), "id").select("query_id", "rank", "score", "doc_id", "paragraph_index", "preview")

    def compare(self, a: int, b: int, least: float = 0.7) -> DataFrame:
        """For each chunk of one document the best chunk of another."""
        return best_chunks(self.all(), self.spark.createDataFrame([(a, b)], "a bigint, b bigint"), least)

    def clear(self) -> None:
        self.store.reset(self.name)
