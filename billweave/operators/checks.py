"""Reconciliation of goods lines with totals, completeness, remarks."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billweave import fixed_values as fv
from billweave.functions.normalize import TOTAL, number, number_or_zero, two_places
from billweave.functions.text import missing
from billweave.operators.items import list_totals


def level_notes(
    amount_sum: Column, tax_sum: Column, amounts_ok: Column, taxes_ok: Column,
    pretax: Column, tax: Column, total: Column,
) -> Column:
    """Array of the notes of the three checks; a cent of difference passes."""
    cent = F.lit(fv.CHECK_TOLERANCE).cast("decimal(4,2)")

    def note(kind: str, *values: Column) -> Column:
        texts = fv.CHECK_MESSAGES[kind]
        parts = [F.lit(texts[0])]
        for value, text in zip(values, texts[1:]):
            parts += [two_places(value), F.lit(text)]
        return F.concat(*parts)

    goods = F.when(
        amounts_ok & (pretax > 0) & (F.abs(amount_sum - pretax) > cent),
        note("goods", amount_sum, pretax),
    )
    taxes = F.when(
        taxes_ok & (tax > 0) & (F.abs(tax_sum - tax) > cent), note("tax", tax_sum, tax)
    )
    totals = F.when(
        (pretax > 0) & (tax > 0) & (total > 0) & (F.abs(pretax + tax - total) > cent),
        note("total", pretax, tax, total),
    )
    return F.array_compact(F.array(goods, taxes, totals))


def item_sums(items: DataFrame, *keys: str) -> DataFrame:
    """Sums and parse flags of a flat goods table. Fixed-width buffers, so rows
    of a key are combined in a hash map before the shuffle."""
    amount, tax = number(F.col("amount")), number(F.col("tax_amount"))
    return items.groupBy(*keys).agg(
        F.try_sum(amount).cast(TOTAL).alias("amount_sum"),
        F.try_sum(tax).cast(TOTAL).alias("tax_sum"),
        F.bool_and(amount.isNotNull()).alias("amounts_ok"),
        F.bool_and(tax.isNotNull()).alias("taxes_ok"),
    )


def check_against_items(headers: DataFrame, items: DataFrame, *keys: str) -> DataFrame:
    """Adds ``check_notes`` to headers from a flat goods table."""
    joined = headers.join(item_sums(items, *keys), list(keys), "left")
    zero = F.lit(0).cast(TOTAL)
    notes = level_notes(
        F.coalesce("amount_sum", zero), F.coalesce("tax_sum", zero),
        F.col("amounts_ok"), F.col("taxes_ok"),
        *[number_or_zero(F.col(f)) for f in ("pretax_amount", "tax_amount", "total_amount")],
    )
    return joined.withColumn(
        "check_notes",
        F.when(F.col("amounts_ok").isNotNull(), notes).otherwise(F.array().cast("array<string>")),
    ).drop("amount_sum", "tax_sum", "amounts_ok", "taxes_ok")


def check_notes_in_row(items: Column) -> Column:
    """The same notes for a goods array next to its totals."""
    amount_sum, tax_sum = list_totals(items)
    notes = level_notes(
        amount_sum, tax_sum,
        F.forall(items, lambda it: number(it["amount"]).isNotNull()),
        F.forall(items, lambda it: number(it["tax_amount"]).isNotNull()),
        *[number_or_zero(F.col(f)) for f in ("pretax_amount", "tax_amount", "total_amount")],
    )
    return F.when(F.size(items) > 0, notes).otherwise(F.array().cast("array<string>"))


def missing_fields() -> Column:
    """Names of the empty required fields, in fixed order."""
    return F.array_compact(F.array(*[
        F.when(missing(F.col(f)), F.lit(f)) for f in fv.REQUIRED_TAGGED_FIELDS
    ]))


def completeness_note() -> Column:
    """Array with one note if a tagged document lacks required fields."""
    tagged = F.col("source").isin(fv.SOURCE_TAGGED, fv.SOURCE_FALLBACK)
    absent = missing_fields()
    return F.when(
        tagged & (F.size(absent) > 0),
        F.array(F.concat(F.lit(fv.MSG_INCOMPLETE), F.array_join(absent, ","))),
    ).otherwise(F.array().cast("array<string>"))


@cache
def _remarks(items: str) -> Column:
    notes = F.concat(
        F.col("validation_notes"), check_notes_in_row(F.col(items)), completeness_note())
    return F.array_join(notes, fv.REMARK_SEPARATOR)


def with_remarks(df: DataFrame) -> DataFrame:
    """``remarks``: earlier notes, check notes and completeness, joined."""
    return df.withColumn("remarks", _remarks("line_items"))
