"""Field normalisation: dates, amounts, check codes, character width, numbers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from billweave import fixed_values as fv
from billweave.functions.text import jvm_regex, let, strip

WIDE = "".join(chr(c) for c in [*range(0xFF21, 0xFF3B), *range(0xFF10, 0xFF1A)])
NARROW = "".join(chr(ord(c) - 0xFEE0) for c in WIDE)

AMOUNT = "decimal(38,6)"
TOTAL = "decimal(38,6)"


@dataclass(frozen=True)
class Options:
    """Switches of an extraction run."""

    normalize_date: bool = True
    normalize_amount: bool = True
    assist: bool = True
    confidence_threshold: float = fv.CONFIDENCE_THRESHOLD
    fallback: bool = True
    dedup: bool = True


def date_text(raw: Column) -> Column:
    """``YYYY-MM-DD`` from the first layout the text starts with, else unchanged."""
    def by_layout(text: Column) -> Column:
        result = None
        for layout in fv.DATE_LAYOUTS:
            regex = jvm_regex(layout)
            value = F.concat_ws(
                "-",
                F.regexp_extract(text, regex, 1),
                F.lpad(F.regexp_extract(text, regex, 2), 2, "0"),
                F.lpad(F.regexp_extract(text, regex, 3), 2, "0"),
            )
            hit = F.rlike(text, F.lit(regex))
            result = F.when(hit, value) if result is None else result.when(hit, value)
        return result.otherwise(text)

    return let(strip(raw), by_layout)


def amount_text(raw: Column) -> Column:
    return F.regexp_replace(raw, jvm_regex(fv.AMOUNT_NOISE), "")


def check_code_text(raw: Column) -> Column:
    return F.regexp_replace(raw, jvm_regex(r"\s+"), "")


def narrow(text: Column) -> Column:
    """Full-width capitals and digits to half width; small letters stay wide."""
    def changed(t: Column) -> Column:
        ascii_only = F.octet_length(t) == F.char_length(t)
        return F.when(ascii_only, t).otherwise(F.translate(t, WIDE, NARROW))

    return let(text, changed)


def field_text(field: str, value: Column, options: Options = Options()) -> Column:
    """The rule of one field, chosen while the plan is built."""
    value = narrow(value)
    if field in fv.DATE_FIELDS and options.normalize_date:
        return date_text(value)
    if field in fv.AMOUNT_FIELDS and options.normalize_amount:
        return amount_text(value)
    if field in fv.CHECK_CODE_FIELDS:
        return check_code_text(value)
    return value


def number(text: Column) -> Column:
    """Exact number; empty is zero, unparseable is null."""
    return F.when(
        text.isNull() | (text == ""), F.lit(0).cast(AMOUNT)
    ).otherwise(strip(text).try_cast(AMOUNT))


def number_or_zero(text: Column) -> Column:
    return F.coalesce(number(text), F.lit(0).cast(AMOUNT))


def two_places(value: Column) -> Column:
    return F.bround(value, 2).cast("decimal(38,2)").cast("string")


def duration_text(seconds: Column) -> Column:
    """``HH:MM:SS`` of whole seconds."""
    whole = F.floor(seconds)

    def two_digits(n: Column) -> Column:
        text = n.cast("string")
        return F.lpad(text, F.greatest(F.lit(2), F.char_length(text)), F.lit("0"))

    hours = F.floor(whole / 3600)
    minutes = F.floor((whole % 3600) / 60)
    return F.concat_ws(":", two_digits(hours), two_digits(minutes), two_digits(whole % 60))


def local_time_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")
