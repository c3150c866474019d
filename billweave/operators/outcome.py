"""From an extracted document to its outcome row, and business duplicates."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billweave import fixed_values as fv
from billweave.functions.text import missing


def is_success() -> Column:
    return ~missing(F.col("invoice_number")) & ~missing(F.col("total_amount"))


def failure_reason() -> Column:
    open_text, close_text = fv.MSG_PARSE_ERRORS
    errors = F.concat(
        F.lit(fv.MSG_NOT_RECOGNISED), F.lit(open_text),
        F.array_join("parse_errors", ";"), F.lit(close_text),
    )
    return F.when(F.size("parse_errors") > 0, errors).otherwise(F.lit(fv.MSG_NOT_RECOGNISED))


def with_outcome(df: DataFrame) -> DataFrame:
    """``status``, ``error_message``, ``has_invoice``; failed rows lose their record."""
    ok = is_success()
    return df.withColumns({
        "status": F.when(ok, F.lit(fv.SUCCESS)).otherwise(F.lit(fv.FAILED)),
        "error_message": F.when(ok, F.lit("")).otherwise(failure_reason()),
        "has_invoice": ok,
        "is_dedup": F.lit(False),
    })


def skipped_files(files: DataFrame) -> DataFrame:
    """Outcome rows of files that are no invoices."""
    return files.filter(F.col("file_type") == fv.UNSUPPORTED).withColumns({
        "status": F.lit(fv.SKIPPED),
        "error_message": F.lit(fv.MSG_NOT_INVOICE),
        "has_invoice": F.lit(False),
        "is_dedup": F.lit(False),
    })


def dedup_eligible() -> Column:
    return (
        (F.col("status") == fv.SUCCESS) & F.col("has_invoice")
        & ~(missing(F.col("invoice_code")) & missing(F.col("invoice_number")))
    )


def duplicate_message() -> Column:
    a, b, c = fv.MSG_DUPLICATE
    return F.concat(F.lit(a), F.col("invoice_code"), F.lit(b), F.col("invoice_number"), F.lit(c))


BUSINESS_KEY = ["invoice_code", "invoice_number"]


def business_keys(results: DataFrame) -> DataFrame:
    """One row per business key: how often it occurs, and the ``rel_path`` that stays, tagged archives
    first, then path order. A key with a third of all rows shrinks to one row per map
    task before the shuffle."""
    order = F.struct((F.col("file_type") != "ofd").alias("late"), F.col("rel_path"))
    return (
        results.filter(dedup_eligible()).groupBy(*BUSINESS_KEY)
        .agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .select(*BUSINESS_KEY, F.col("_first.rel_path").alias("_first_path"), "_n")
    )


def mark_duplicates(results: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Mark, never drop, later copies of a business key.

    Only keys with copies, one row each, are joined with the rows. That side is small where copies
    are rare and then Spark broadcasts it; else the join is on the key, whose skewed
    partitions are split at run time. ``seen`` holds keys accepted before; all rows with one of them
    are copies.
    """
    def same(a: DataFrame, b: DataFrame, names: dict[str, str]) -> Column:
        return functools.reduce(Column.__and__, [a[x].eqNullSafe(b[y]) for x, y in names.items()])

    keys = business_keys(results)
    if seen is None:
        keys = keys.withColumn("_known", F.lit(False))
    else:
        known = seen.select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(BUSINESS_KEY)])
        old = keys.join(known, same(keys, known, {k: f"_s{i}" for i, k in enumerate(BUSINESS_KEY)}), "left_semi")
        new = keys.join(known, same(keys, known, {k: f"_s{i}" for i, k in enumerate(BUSINESS_KEY)}), "left_anti")
        keys = old.withColumn("_known", F.lit(True)).unionByName(new.withColumn("_known", F.lit(False)))
    # only rows with a key meet the keys; the others have nothing to be joined on and would be one hot key
    able = results.filter(F.coalesce(dedup_eligible(), F.lit(False)))
    others = results.filter(~F.coalesce(dedup_eligible(), F.lit(False)))
    copies = keys.filter((F.col("_n") > 1) | F.col("_known")).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(BUSINESS_KEY)], "_first_path", "_known")
    joined = able.join(copies, same(able, copies, {k: f"_k{i}" for i, k in enumerate(BUSINESS_KEY)}), "left")
    later = F.col("_known") | (F.col("_first_path") != F.col("rel_path"))
    marked = (
        joined.withColumn("is_dedup", F.coalesce(later, F.lit(False)))
        .withColumns({
            "status": F.when(F.col("is_dedup"), F.lit(fv.SKIPPED)).otherwise(F.col("status")),
            "error_message": F.when(F.col("is_dedup"), duplicate_message()).otherwise(
                F.col("error_message")),
        })
        .drop("_first_path", "_known", *[f"_k{i}" for i in range(len(BUSINESS_KEY))])
    )
    return marked.unionByName(others.withColumn("is_dedup", F.lit(False)))


def dedup_summary(results: DataFrame) -> DataFrame:
    """Rows before and after marking, and distinct accepted keys."""
    key = F.when(dedup_eligible(), F.struct("invoice_code", "invoice_number"))
    return results.agg(
        F.count(F.lit(1)).alias("n_before"),
        F.count(F.lit(1)).alias("n_after"),
        F.count_distinct(key).alias("n_keys"),
    )
