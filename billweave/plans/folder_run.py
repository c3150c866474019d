"""The whole run: files to outcome rows to output tables."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from billweave import fixed_values as fv
from billweave.functions.normalize import Options, field_text
from billweave.functions.text import missing
from billweave.operators import assist, fields, items, layout, outcome, tags
from billweave.operators.checks import with_remarks
from billweave.operators.stats import is_invoice_file, observed
from billweave.plans.storage import Keep, keep_in, run_folder, stored, unstored
from billweave.schemas import BLOCK_LIST, GOODS_LIST, RECOGNISED
from billweave.sources import archives, files, sinks

DOCUMENT_DEFAULTS = {
    "full_text": ("string", lambda: F.lit("")),
    "confidence": ("double", lambda: F.lit(0.0)),
    "parse_errors": ("array<string>", lambda: F.array().cast("array<string>")),
    "blocks": (BLOCK_LIST, lambda: F.array().cast(BLOCK_LIST)),
    "tag_items": (GOODS_LIST, items.no_goods),
}


def with_document_columns(docs: DataFrame) -> DataFrame:
    """Give a document table the columns it lacks, and values instead of nulls."""
    columns = {}
    for name, (kind, default) in DOCUMENT_DEFAULTS.items():
        columns[name] = (
            F.coalesce(F.col(name).cast(kind), default()) if name in docs.columns else default().cast(kind))
    return docs.withColumns(columns)


def extract(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """Header fields and goods lines of document rows. One row stays one row and
    nothing is shuffled."""
    docs = with_document_columns(docs)
    tag_columns = [c for c in docs.columns if c.startswith("tag_") and c != "tag_items"]
    tagged = F.col("source") == fv.SOURCE_TAGGED
    docs = docs.withColumns({
        c[4:]: F.when(tagged & ~missing(F.col(c)), field_text(c[4:], F.col(c), options)).otherwise("")
        for c in tag_columns
    }).drop(*tag_columns)
    docs = fields.fill_from_patterns(fields.with_header_fields(docs), options=options)
    docs = layout.with_column_texts(docs).withColumns({
        "has_side": ~tagged & F.col("has_side"),
        "_section_text": F.when(~tagged, F.col("full_text")),
    })
    docs = fields.fill_from_sections(docs, "_section_text").drop(
        "_section_text", "has_side", "left_text", "right_text")
    return items.with_goods(docs).withColumn(
        "validation_notes", F.array().cast("array<string>"))


def finish(docs: DataFrame) -> DataFrame:
    """Checks, remarks and outcome of extracted documents."""
    done = outcome.with_outcome(with_remarks(docs))
    return done.drop("full_text", "blocks", "parse_errors")


def process_documents(
    docs: DataFrame, options: Options = Options(), provider: assist.Provider | None = None,
    keep: Keep = unstored,
) -> DataFrame:
    """Extract, ask the provider where confidence is low, check and decide.

    With a provider the extracted rows are read twice, by its queue and by the
    merge of its answers; ``keep`` stores them in between. The same holds for the
    result: a filter on it would be pushed into the extraction and run the
    patterns a second time, so store it before filtering.
    """
    extracted = extract(docs, options)
    if provider is not None and options.assist:
        extracted = assist.assisted(keep(extracted, "extracted"), provider, options)
    return finish(extracted)


def outcomes(
    listing: DataFrame, documents: DataFrame, options: Options = Options(),
    provider: assist.Provider | None = None, keep: Keep = unstored,
) -> DataFrame:
    """Outcome rows of a listing: documents decided, other files skipped.

    Files of an invoice type without a document row have no text and fail.
    """
    known = listing.filter(F.col("file_type") != fv.UNSUPPORTED)
    archive = F.col("file_type") == "ofd"
    unread = F.when(F.col("source").isNull() & ~archive, F.array(F.lit(fv.MSG_NO_RECOGNITION)))
    given = F.col("parse_errors") if "parse_errors" in documents.columns else F.lit(None).cast("array<string>")
    docs = known.join(documents, "rel_path", "left").withColumn("parse_errors", F.coalesce(unread, given)).withColumn(
        "source", F.coalesce("source", F.when(archive, F.lit(fv.SOURCE_TAGGED)).otherwise(F.lit(fv.SOURCE_TEXT))))
    done = process_documents(docs, options, provider, keep)
    results = done.unionByName(outcome.skipped_files(listing), allowMissingColumns=True)
    return results.withColumn("elapsed_seconds", F.lit(0.0))


def with_mapped_fields(docs: DataFrame, nodes: DataFrame, paths: dict[str, str]) -> DataFrame:
    """Fill tagged fields that are empty from a user's table of field -> path; an archive with such a
    value is not sent to the fallback."""
    mapped = tags.wide_fields(tags.mapped_fields(nodes, paths), list(paths), prefix="_m_")
    joined = docs.join(mapped.withColumn("_mapped", F.lit(True)), "rel_path", "left")
    for field in paths:
        held = F.nullif(F.col(f"tag_{field}"), F.lit("")) if f"tag_{field}" in docs.columns else F.lit(None)
        joined = joined.withColumn(f"tag_{field}", F.coalesce(held, F.col(f"_m_{field}")))
    hit = F.col("_mapped").isNotNull() & (F.col("source") == fv.SOURCE_FALLBACK)
    return joined.withColumns({
        "source": F.when(hit, F.lit(fv.SOURCE_TAGGED)).otherwise(F.col("source")),
        "fallback_entry": F.when(~hit, F.col("fallback_entry")),
        "parse_errors": F.when(hit, F.array().cast("array<string>")).otherwise(F.col("parse_errors")),
    }).drop("_mapped", *[f"_m_{f}" for f in paths])


def read_documents(
    root: str, listing: DataFrame, folder: str, spans: DataFrame | None,
    recognised: DataFrame | None, options: Options, parser: archives.Parser | None = None,
    entries: tuple[str, ...] = archives.DEFAULT_ENTRIES, paths: dict[str, str] | None = None,
) -> DataFrame:
    """Document rows of a listing: archives shredded by ranges, other files
    from the span and block tables of an external reader."""
    nodes = stored(tags.with_kind(
        archives.shred_archives(files.archive_files(listing), parser, root, entries, keep_in(folder))), folder, "nodes", by="kind")
    docs = tags.tagged_documents(nodes.select("rel_path").distinct(), nodes, options.fallback, keep_in(folder))
    if paths:
        docs = with_mapped_fields(docs, nodes, paths)
    docs = stored(docs, folder, "tagged")
    if recognised is not None:
        # blocks read from the first image of a fallback archive are keyed by path and entry
        images = recognised.filter(F.col("entry").isNotNull())
        wanted = docs.filter(F.col("fallback_entry").isNotNull()).select(
            "rel_path", F.col("fallback_entry").alias("entry"))
        seen = layout.recognised_documents(images.join(wanted, ["rel_path", "entry"], "left_semi"))
        seen = seen.select("rel_path", *[F.col(c).alias(f"_r_{c}") for c in ("full_text", "confidence", "blocks")])
        docs = docs.join(seen, "rel_path", "left").withColumns({
            "full_text": F.coalesce("_r_full_text", "full_text"),
            "confidence": F.coalesce("_r_confidence", "confidence"),
            "blocks": F.col("_r_blocks"),
            "parse_errors": F.when(
                F.col("_r_full_text").isNull(), F.col("parse_errors")
            ).otherwise(F.array().cast("array<string>")),
        }).drop("_r_full_text", "_r_confidence", "_r_blocks")
    others = []
    if spans is not None:
        plain = (docs.sparkSession.createDataFrame([], RECOGNISED) if recognised is None
                 else recognised.filter(F.col("entry").isNull()))
        others.append(layout.choose_text(layout.embedded_documents(spans), layout.recognised_documents(plain)))
    elif recognised is not None:
        others.append(layout.recognised_documents(recognised.filter(F.col("entry").isNull())))
    for other in others:
        docs = docs.unionByName(
            other.withColumn("source", F.lit(fv.SOURCE_TEXT)), allowMissingColumns=True)
    return docs


def run_folder_to_tables(
    spark: SparkSession, root: str, output: str, spans: DataFrame | None = None,
    recognised: DataFrame | None = None, options: Options = Options(),
    provider: assist.Provider | None = None, folder: str | None = None, parser: archives.Parser | None = None,
    entries: tuple[str, ...] = archives.DEFAULT_ENTRIES, paths: dict[str, str] | None = None,
) -> DataFrame:
    """Scan, extract, mark duplicates and write every output; returns the stored
    outcome table. ``recognised`` carries an ``entry`` column, null for plain files.

    ``parser`` replaces the shredder of archives, ``entries`` names the XML entries it reads, and
    ``paths`` is a table of field -> ``//Parent/Tag`` for archives of flat XML. Each
    document counts with its share of the time that reading and deciding took, as documents
    of a task are worked on together.
    """
    folder, began = folder or run_folder(spark), time.monotonic()
    listing = stored(files.scan_files(spark, root, folder=f"{folder}/scan"), folder, "listing")
    read_from = time.monotonic()
    documents = stored(read_documents(
        root, listing, folder, spans, recognised, options, parser, entries, paths), folder, "documents")
    counted = Observation()
    decided = stored(outcomes(listing, documents, options, provider, keep_in(folder)).observe(
        counted, F.count_if(is_invoice_file()).alias("invoices")), folder, "decided")
    spent, invoices = time.monotonic() - read_from, counted.get["invoices"]
    share = F.when(F.col("file_type") != fv.UNSUPPORTED, F.lit(spent / max(1, invoices))).otherwise(F.lit(0.0))
    decided = decided.withColumn("elapsed_seconds", share)
    if options.dedup:
        decided = outcome.mark_duplicates(decided)
    watched, statistics = observed(decided)
    decided = stored(watched, folder, "results")
    sinks.write_outputs(decided, output, F.lit(time.monotonic() - began), statistics())
    return decided
