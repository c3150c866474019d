"""A training corpus from the documents table, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and
returns a table that is written as Parquet and read again as the next one's documents. All
stages but the last return the columns of ``documents``. A stage adds nothing to rows
that it keeps, except that line dedup shortens texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.llm.bpe import encode_decode
from billweave.llm.decontamination import contamination
from billweave.llm.line_dedup import line_dedup
from billweave.llm.near_dup import near_duplicates
from billweave.llm.quality import quality_scores
from billweave.llm.tables import stored, table, work_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id is not among ``ids``, which are few beside the documents; rows without an id stay."""
    return docs.join(ids, "doc_id", "left_anti").select(COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.3) go."""
    scored = quality_scores(docs.select(COLUMNS), table(spark, sf_dir, "labels"), threshold=0.3)
    return scored.where("predicted = 1").select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; a document that loses all of them stays, empty."""
    kept = line_dedup(docs.select(COLUMNS), min_docs=10, min_chars=1)
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source",
                       F.length("kept_text").cast("long").alias("n_chars"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a similarity of 0.85, the one with the least id stays."""
    marked = near_duplicates(docs.select("doc_id", "text"), numerator=85, denominator=100)
    copies = stored(marked.where("NOT kept").select("doc_id").distinct(), work_folder(spark, "stage"), "copies")
    return without_ids(docs, copies)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up a twentieth or more go."""
    marked = contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = stored(marked.where("contaminated").select("doc_id").distinct(), work_folder(spark, "stage"), "hit")
    return without_ids(docs, hit)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_decode(docs.select("doc_id", "text"), VOCABULARY).drop("text")


STAGES = [
    ("quality", quality), ("lines", lines), ("near", near), ("decontamination", decontaminated), ("tokens", tokens),
]

#: Neither the classifier nor the encoding can be put in SQL; tests compare stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = work_folder(spark, "pipeline")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), folder, name)
    return docs
