"""Positioned text from an external reader, as tables of spans and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.functions.text import strip
from billweave.schemas import RECOGNISED, SPANS


def clean_spans(spans: DataFrame) -> DataFrame:
    """Trimmed, non-empty spans at whole y and one decimal of x."""
    return spans.withColumn("text", strip(F.col("text"))).filter(F.col("text") != "").select(
        "rel_path", "page", "seq",
        F.bround("x", 1).alias("x"), F.rint("y").alias("y"), "text")


def read_spans(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Embedded text spans: one row per span."""
    return clean_spans(spark.read.format(fmt).schema(SPANS).load(path))


def read_recognised(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Recognised blocks; ``entry`` is null for plain files and names the image
    for blocks read from inside an archive."""
    return spark.read.format(fmt).schema(RECOGNISED + ", entry string").load(path)


def page_results_to_blocks(results: DataFrame) -> DataFrame:
    """Flatten recogniser output with one row per page and parallel arrays of
    texts, scores and polygons; absent scores are 0, absent polygons null."""
    return results.select(
        "rel_path", "page", F.posexplode_outer("rec_texts").alias("seq", "text"), "rec_scores", "rec_polys",
    ).filter(F.col("seq").isNotNull()).select(
        "rel_path", "page", "seq", "text",
        F.coalesce(F.get("rec_scores", F.col("seq")), F.lit(0.0)).alias("confidence"),
        F.get("rec_polys", F.col("seq")).alias("bbox"))
