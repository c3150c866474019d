"""Stored intermediate tables in the folder all executors share."""

from __future__ import annotations

import uuid

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
FOLDERS_AT_ONCE = 8


def shared_folder(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``; without that setting the caller has to
    name a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared one; it goes when the application ends."""
    folder = f"{shared_folder(spark)}/billweave-{uuid.uuid4().hex}"
    system, path = _file_system(spark, folder)
    system.deleteOnExit(path)
    return folder


def stored(df: DataFrame, folder: str, name: str, by: str | None = None) -> DataFrame:
    """Write once, read by every consumer; also cuts the lineage, so a lost
    executor costs a re-read and not a re-parse. With ``by``, one folder for each value of a column."""
    path = f"{folder}/{name}"
    writer, spark = df.write.mode("overwrite"), df.sparkSession
    if by is None:
        writer.parquet(path)
    else:
        # one open file for each value, instead of a sort of whole rows by it, which spills; beyond that many Spark sorts the rest
        with setting(spark, OPEN_FILES, str(max(FOLDERS_AT_ONCE, int(spark.conf.get(OPEN_FILES))))):
            writer.partitionBy(by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session while one table is written."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


Keep = Callable[[DataFrame, str], DataFrame]


def keep_in(folder: str) -> Keep:
    """``stored`` into one folder, as a function of table and name."""
    return lambda df, name: stored(df, folder, name)


def unstored(df: DataFrame, name: str) -> DataFrame:
    return df


def _file_system(spark: SparkSession, path: str) -> tuple:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def path_exists(spark: SparkSession, path: str) -> bool:
    system, jvm_path = _file_system(spark, path)
    return system.exists(jvm_path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    system, jvm_path = _file_system(spark, path)
    system.delete(jvm_path, True)


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place, then rename it over what is there."""
    jvm = spark._jvm.org.apache.hadoop.fs
    system, target = _file_system(spark, path)
    fresh = jvm.Path(f"{path}-{uuid.uuid4().hex}")
    out = system.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(jvm, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration()).rename(
        system.makeQualified(fresh), system.makeQualified(target), options)
