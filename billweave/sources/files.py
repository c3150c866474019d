"""Scanned files: listing, classification, header bytes, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave import fixed_values as fv
from billweave.sources.folders import list_files, with_head


def extension(name: Column) -> Column:
    """Lower-case extension with its dot; a name such as ``.pdf`` has none."""
    return F.lower(F.regexp_extract(name, r"(?s)^\.*[^.].*(\.[^.]*)$", 1))


def file_type(ext: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in fv.EXTENSION_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, ext), F.lit(fv.UNSUPPORTED))


def route(kind: Column) -> Column:
    return F.when(kind == "ofd", F.lit("ofd")).when(
        kind == fv.UNSUPPORTED, F.lit(fv.UNSUPPORTED)
    ).otherwise(F.lit("ocr"))


def in_skipped_directory(rel_path: Column, skip: list[str]) -> Column:
    """True if a directory of the path, not the file itself, has a listed name."""
    parts = F.split(rel_path, "/")
    return F.arrays_overlap(
        F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*[F.lit(s) for s in skip])
    ) if skip else F.lit(False)


def magic_valid(content: Column, kind: Column) -> Column:
    """Do the first bytes fit the type? Null for unsupported types, false if unreadable."""
    head = F.hex(F.substring(content, 1, 4))
    result = F.lit(None).cast("boolean")
    for name, prefix in fv.HEADER_HEX.items():
        result = F.when(
            kind == name, F.coalesce(F.startswith(head, F.lit(prefix)), F.lit(False))
        ).otherwise(result)
    return result


def classify(df: DataFrame, rel_path: str = "rel_path") -> DataFrame:
    """Adds ``ext, file_type, route`` to rows with a relative path."""
    name = F.substring_index(F.col(rel_path), "/", -1)
    return (
        df.withColumn("ext", extension(name))
        .withColumn("file_type", file_type(F.col("ext")))
        .withColumn("route", route(F.col("file_type")))
    )


def relative_to(spark: SparkSession, root: str) -> Column:
    """Path below the root of a row of a Spark file source, whose paths are qualified; a row from
    elsewhere is an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    base = system.makeQualified(path).toString().rstrip("/") + "/"
    return F.when(F.startswith("path", F.lit(base)), F.substring(
        F.col("path"), F.lit(len(base) + 1), F.char_length("path"))).otherwise(
        F.raise_error(F.concat("path", F.lit(f" is not below {base}"))))


def listing(found: DataFrame, magic: Column | None = None) -> DataFrame:
    """The ``files`` table from ``path, rel_path, length, modification_time`` rows."""
    unknown = F.lit(None).cast("boolean")
    return classify(found).select(
        "rel_path", F.col("path").alias("abs_path"), "ext", "file_type", "route",
        (unknown if magic is None else magic).alias("magic_valid"), "length", "modification_time")


def scan_files(
    spark: SparkSession, root: str, skip: list[str] | None = None, check_magic: bool = False,
    folder: str | None = None,
) -> DataFrame:
    """One row per file below the root, hidden names included.

    Folders are listed by tasks and no content is read. The header check reads the first four
    bytes of each supported file, whatever its size.
    """
    found = list_files(spark, root, fv.SKIP_DIRECTORIES if skip is None else skip, folder)
    if not check_magic:
        return listing(found)
    kind = file_type(extension(F.substring_index("rel_path", "/", -1)))
    headed = with_head(found.withColumn("wanted", kind != fv.UNSUPPORTED), root)
    return listing(headed, magic_valid(F.col("head"), F.col("file_type")))


def in_path_order(df: DataFrame) -> DataFrame:
    """Total order by relative path, by code point; a range partitioning and a
    sort per partition."""
    return df.orderBy("rel_path")


def archive_files(listed: DataFrame) -> DataFrame:
    """``rel_path, abs_path`` of the tagged archives of a listing."""
    return listed.filter(F.col("route") == "ofd").select("rel_path", "abs_path")


def admission_code(
    name: Column, length: Column, max_bytes: int, allowed: list[str] | None = None
) -> Column:
    """Reject code of an incoming file, null if it is accepted; size comes first."""
    allowed = list(fv.EXTENSION_TYPES) if allowed is None else allowed
    return F.when(length > max_bytes, F.lit(fv.REJECT_TOO_LARGE)).when(
        ~extension(name).isin(allowed), F.lit(fv.REJECT_TYPE))


def admit(
    df: DataFrame, name: str, length: str, max_bytes: int, allowed: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows, the latter with ``reject_code``."""
    coded = df.withColumn(
        "reject_code", admission_code(F.col(name), F.col(length), max_bytes, allowed))
    return (
        coded.filter(F.col("reject_code").isNull()).drop("reject_code"),
        coded.filter(F.col("reject_code").isNotNull()),
    )
