"""Session defaults and the shared folder that cut lineages are written to."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(app: str = "foliomark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; keyword arguments are extra settings (dots as ``__``)."""
    builder = SparkSession.builder.appName(app).config(map=DEFAULTS)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where the cluster names none (single-machine tests), a temporary folder of this machine is made
    and set, which is only right while driver and executors share one file system.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            found = current.get()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="foliomark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


_OWNED: set[str] = set()


def _own_dir(spark: SparkSession) -> str:
    """The folder of this application within the shared one; its removal is left to the driver's file system at the end."""
    own = os.path.join(shared_dir(spark), "foliomark", spark.sparkContext.applicationId)
    if own not in _OWNED:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _OWNED.add(own)
    return own


def staged(df: DataFrame, label: str = "stage", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: computed once, lineage cut.

    The files outlive any executor. All of an application lie in one folder, which is removed when its driver ends.
    """
    spark = df.sparkSession
    path = os.path.join(_own_dir(spark), f"{label}-{uuid.uuid4().hex}")
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes from which a table of few partitions is spread over the cores.
SPREAD_FROM = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory.

    A file of some size that gives fewer partitions than there are cores is spread over all of them; tables with
    enough partitions are read as they lie.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_FROM and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    return df


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="foliomark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)


def arrow_map(df: DataFrame, fn: Callable[..., Sequence[list]], schema: str | StructType) -> DataFrame:
    """Apply ``fn`` to each Arrow batch: lists of the input columns in, lists of the output columns out."""
    ship(df.sparkSession)
    out_type = _parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(out_type)
        for batch in batches:
            columns = fn(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

    return df.mapInArrow(run, out_type)
