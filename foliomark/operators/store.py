"""Keeping documents, findings and runs: latest-wins upserts, cascading deletes, statistics, staged writes.

Tables are lists of Parquet folders that a pointer file names; the pointer is replaced in one rename.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``. Rows with a null key form one group."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Both tables' rows, one for each key: the first in ``order``, incoming before current among equals."""
    both = current.withColumn("_old", F.lit(1)).unionByName(incoming.withColumn("_old", F.lit(0)), allowMissingColumns=True)
    return latest(both, keys, [*order, F.asc("_old")]).drop("_old")


def cascade_delete(parent: DataFrame, children: dict[str, DataFrame], doomed: DataFrame, key: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Parent and child tables without the rows of the keys in ``doomed``."""
    gone = doomed.select(key).distinct()
    return parent.join(gone, key, "left_anti"), {name: child.join(gone, key, "left_anti") for name, child in children.items()}


def statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) of each table."""
    out: DataFrame | None = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no tables")
    return out


class Store:
    """Versioned Parquet tables under one folder (local, or any file system of Spark).

    A table is a list of parts, which a pointer file names. Writing adds a part under a name of its own and then
    puts a new pointer in the place of the old one in one rename, so that a reader sees the version before or the new
    one and a lost executor leaves the version before. Appending adds a part and rewrites nothing; where parts
    become many they are put together. Of a replaced version the parts stay until the write after, for its readers.
    """

    MOST_PARTS = 64

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    def _pointer(self, name: str) -> str:
        return f"{self.root}/{name}/_current"

    def _known(self, name: str) -> dict:
        pointer = self._path(self._pointer(name))
        if not self._fs.exists(pointer):
            return {"version": None, "parts": [], "before": []}
        stream = self._fs.open(pointer)
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def version(self, name: str) -> str | None:
        return self._known(name)["version"]

    def read(self, name: str) -> DataFrame | None:
        parts = self._known(name)["parts"]
        return self.spark.read.option("mergeSchema", len(parts) > 1).parquet(*(f"{self.root}/{name}/{p}" for p in parts)) if parts else None

    def _point(self, name: str, parts: list[str], before: list[str]) -> None:
        """Let the pointer name the parts, in one rename over the old pointer; ``before`` are parts of the version before."""
        text = json.dumps({"version": f"v-{uuid.uuid4().hex}", "parts": parts, "before": before})
        fresh = self._path(f"{self.root}/{name}/_next-{uuid.uuid4().hex}")
        stream = self._fs.create(fresh, True)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self._files.rename(fresh, self._path(self._pointer(name)), options)

    def _part(self, name: str, df: DataFrame) -> str:
        part = f"p-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}/{part}")
        return part

    def write(self, name: str, df: DataFrame) -> None:
        """Replace the table by ``df``, which may read the table itself."""
        part, known = self._part(name, df), self._known(name)
        self._point(name, [part], known["parts"])
        for old in set(known["before"]) - {part, *known["parts"]}:
            self._fs.delete(self._path(f"{self.root}/{name}/{old}"), True)

    def merge(self, name: str, incoming: DataFrame, keys: list[str], order: list[Column]) -> None:
        """Upsert: one row for each key, the first in ``order``. Keys may be anywhere, so the table is written anew."""
        current = self.read(name)
        self.write(name, latest(incoming, keys, order) if current is None else upsert(current, incoming, keys, order))

    def append(self, name: str, incoming: DataFrame) -> None:
        """Add rows as a part of their own; columns that either side lacks are null."""
        part, known = self._part(name, incoming), self._known(name)
        self._point(name, [*known["parts"], part], known["before"])
        if len(known["parts"]) + 1 > self.MOST_PARTS:
            self.write(name, self.read(name))

    def reset(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)
