"""Shared helpers: reading tables, stored intermediate tables, columns made in Python tasks."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


ROWS_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000
BYTES_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of this machine, which only a
    local master may use."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return own_folder(spark.sparkContext.applicationId)


@functools.lru_cache
def own_folder(application: str) -> str:
    folder = tempfile.mkdtemp(prefix=f"billweave-{application}-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def bounded_batches(spark: SparkSession) -> None:
    """Keep what a Python task holds at once within a few megabytes: Arrow batches of this session get
    at most BATCH_ROWS rows and BATCH_BYTES bytes (one longer row is a batch of its own)."""
    for name, most in ((ROWS_SETTING, BATCH_ROWS), (BYTES_SETTING, BATCH_BYTES)):
        held = spark.conf.get(name).lower().removesuffix("b")
        if not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(name, str(most))


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; it goes when the application ends."""
    bounded_batches(spark)
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Written once, read by each consumer; a lost executor costs a read, not a recomputation."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop columns that have, but for case, one of the names an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def with_python_columns(
    df: DataFrame, source: str, fields: list[StructField], start: Callable[[], Callable[[pa.Array], list]],
) -> DataFrame:
    """Append columns made from one column by a Python function over Arrow batches.

    ``start()`` runs once in a task and returns the function: Arrow column in, list of
    Arrow arrays (one for each field) out. Other columns pass through; input columns
    named like a new one are replaced.
    """
    bounded_batches(df.sparkSession)
    rest = without(df, [f.name for f in fields])
    # A source that is itself replaced travels in a column of its own.
    sent = rest if source in rest.columns else df.select(
        [F.col(f"`{c}`") for c in rest.columns] + [df[source].alias("__source__")])
    at = sent.columns.index(source if source in sent.columns else "__source__")
    kept = [i for i, c in enumerate(sent.columns) if c != "__source__"]
    schema = StructType([sent.schema.fields[i] for i in kept] + fields)
    labels = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = start()
        for batch in batches:
            made = function(batch.column(at))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + made, names=labels)
            del batch, made
            pa.default_memory_pool().release_unused()

    return sent.mapInArrow(run, schema)
