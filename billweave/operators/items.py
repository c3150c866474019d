"""Goods lines from text rows, positioned blocks or tag lists.

Text and block forms work inside the document row. Flat goods tables, one row
per line, never have to be gathered per document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billweave import fixed_values as fv
from billweave.functions.normalize import TOTAL, number_or_zero, two_places
from billweave.functions.text import (
    INLINE_BLANK, after_first_line, contains_any, fill, first_of, jvm_regex, let, literal_alternatives, missing, strip,
)
from billweave.schemas import GOODS_ITEM, GOODS_LIST

#: The header pattern is one of these words, which are found without a regex.
HEADER_WORDS = literal_alternatives(fv.GOODS_HEADER)


def goods_item(**values: Column) -> Column:
    return F.struct(
        *[values.get(f, F.lit("")).alias(f) for f in fv.GOODS_FIELDS]
    ).cast(GOODS_ITEM)


def no_goods() -> Column:
    return F.array().cast(GOODS_LIST)


def contiguous_groups(rows: Column, key: Callable[[Column], Column]) -> Column:
    """Array of runs of equal key, each an array slice; linear in the rows."""
    def cut(rows: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(rows) - 1),
            lambda i: (i == 0) | (key(F.get(rows, i)) != key(F.get(rows, i - 1))),
        )
        return slices_at(rows, starts)

    return let(rows, lambda r: F.when(F.size(r) > 0, cut(r)).otherwise(F.array(r)))


def slices_at(rows: Column, starts: Column) -> Column:
    """Cut an array at ascending 0-based start positions."""
    return let(starts, lambda at: F.transform(
        at,
        lambda s, k: F.slice(rows, s + 1, F.coalesce(F.get(at, k + 1), F.size(rows)) - s),
    ))


def goods_area(df: DataFrame, text: str = "full_text") -> DataFrame:
    """Adds ``_header_at``, where the goods header begins, and ``_area``: the text behind the header line up to the
    first blank line or line that starts with a stop character; both null without header."""
    # a split has no match of length zero at the start, so the stop takes the line end before it
    stop = (
        rf"(?Udm)\n{INLINE_BLANK}*+(?:$|[{fv.GOODS_STOP_FIRST_CHARS}])"
    )
    return (
        df.withColumn("_header_at", first_of(F.col(text), HEADER_WORDS))
        .withColumn("_area", after_first_line(
            F.substring(F.col(text), F.col("_header_at"), F.char_length(text))))
        .withColumn("_area", F.split(F.concat(F.lit("\n"), "_area"), stop, 2)[0])
        .withColumn("_area", F.substring("_area", F.lit(2), F.char_length("_area")))
    )


def goods_row(line: Column) -> Column:
    """Goods item of one line ``name [spec [unit [qty [price]]]] amount rate tax``; null if the line does not fit.

    The row pattern in terms of tokens: as many optional ones as fit are skipped, then come a whole number, any token and
    a leading number.
    """
    number = r"\p{Nd}+\.?\p{Nd}*"
    whole, start = F.lit(f"(?d)^{number}$"), f"(?d)^({number})"

    def by_tokens(token: Column) -> Column:
        def skipping(n: int) -> Column:
            fits = (
                (F.size(token) > n + 3)
                & F.rlike(F.get(token, F.lit(n + 1)), whole)
                & F.rlike(F.get(token, F.lit(n + 3)), F.lit(start))
            )
            return F.when(fits, goods_item(
                goods_name=F.get(token, F.lit(0)),
                amount=F.get(token, F.lit(n + 1)),
                tax_rate=F.get(token, F.lit(n + 2)),
                tax_amount=F.regexp_extract(F.get(token, F.lit(n + 3)), start, 1),
            ))

        return F.coalesce(*[skipping(n) for n in range(fv.GOODS_OPTIONAL_TOKENS, -1, -1)])

    return let(F.split(strip(line), jvm_regex(r"\s+")), by_tokens)


def goods_from_text(df: DataFrame, text: str = "full_text", out: str = "text_items") -> DataFrame:
    """Goods rows after the header. Lines that do not fit are passed over."""
    return _with_text_goods(df, text, out).drop("_header_at")


def _with_text_goods(df: DataFrame, text: str, out: str) -> DataFrame:
    rows = F.filter(F.transform(F.split(F.col("_area"), "\n"), goods_row), lambda item: item.isNotNull())
    return goods_area(df, text).withColumn(out, F.coalesce(rows, no_goods())).drop("_area")


def goods_from_blocks(df: DataFrame, blocks: str = "blocks", out: str = "block_items") -> DataFrame:
    """Goods rows from ordered, sided blocks: name from the left column, amount,
    rate and tax from the right one, per row band of 20 units."""
    stop = F.lit(jvm_regex(fv.GOODS_BLOCK_STOP))
    size = fv.GOODS_BLOCK_BUCKET

    def from_first(rows: Column, test: Callable[[Column], Column]) -> Column:
        """1-based position of the first row that passes, 0 if none."""
        return F.array_position(F.transform(rows, test), True)

    after = F.slice(F.col(blocks), F.col("_at").cast("int") + 1, F.size(blocks))
    body = F.when(F.col("_at") == 0, F.slice(F.col("_body"), 1, 0)).when(
        F.col("_stop") > 0, F.slice(F.col("_body"), F.lit(1), F.col("_stop").cast("int") - 1)
    ).otherwise(F.col("_body"))
    kept = F.filter(
        body,
        lambda b: ~b["text"].isin(fv.GOODS_HEADER_WORDS) & (F.char_length(b["text"]) > 1),
    )
    banded = F.sort_array(F.transform(kept, lambda b, i: F.struct(
        (F.rint(F.coalesce(b["y"], F.lit(0.0)) / size) * size).alias("band"),
        i.alias("i"),
        b["text"].alias("text"),
        F.coalesce(b["side"], F.lit("left")).alias("side"),
    )))

    def texts(rows: Column, side: str) -> Column:
        return F.transform(F.filter(rows, lambda r: r["side"] == side), lambda r: r["text"])

    plain = F.lit(jvm_regex(r"^\d+\.?\d*$"))

    def figures(left: Column, right: Column) -> Column:
        rates = F.filter(right, lambda t: F.endswith(t, F.lit("%")))
        numbers = F.filter(
            right,
            lambda t: ~F.endswith(t, F.lit("%")) & F.rlike(F.replace(t, F.lit(",")), plain),
        )
        return let(numbers, lambda found: goods_item(
            goods_name=fill(F.get(left, F.lit(0))),
            amount=fill(F.get(found, F.lit(0))),
            tax_rate=fill(F.try_element_at(rates, F.lit(-1))),
            tax_amount=fill(F.get(F.filter(
                found, lambda t, i: (i > 0) & F.rlike(t, plain)), F.lit(0))),
        ))

    def one(rows: Column) -> Column:
        return let(texts(rows, "right"), lambda right: figures(texts(rows, "left"), right))

    items = F.filter(
        F.transform(F.col("_bands"), one),
        lambda r: (r["goods_name"] != "") & (r["amount"] != ""),
    )
    return (
        df.withColumn("_at", from_first(F.col(blocks), lambda b: contains_any(b["text"], HEADER_WORDS)))
        .withColumn("_body", F.transform(
            after, lambda b: b.withField("text", strip(b["text"]))))
        .withColumn("_stop", from_first(F.col("_body"), lambda b: F.rlike(b["text"], stop)))
        .withColumn("_rows", banded)
        .withColumn("_bands", contiguous_groups(F.col("_rows"), lambda r: r["band"]))
        .withColumn(out, F.coalesce(items, no_goods()))
        .drop("_at", "_body", "_stop", "_rows", "_bands")
    )


def list_totals(items: Column) -> tuple[Column, Column]:
    """Sums of amount and tax over a goods array, bad values skipped."""
    def total(field: str) -> Column:
        return F.aggregate(
            items, F.lit(0).cast(TOTAL),
            lambda acc, it: F.try_add(acc, number_or_zero(it[field])).cast(TOTAL),
        )

    return total("amount"), total("tax_amount")


def backfill_from_sums(df: DataFrame, amount_sum: Column, tax_sum: Column, when: Column) -> DataFrame:
    """Empty pre-tax and tax totals from the sums of tagged lines, if positive."""
    def value(field: str, total: Column) -> Column:
        return F.when(
            when & missing(F.col(field)) & (total > 0), two_places(total)
        ).otherwise(F.col(field))

    return df.withColumns({
        "pretax_amount": value("pretax_amount", amount_sum),
        "tax_amount": value("tax_amount", tax_sum),
    })


def backfill_from_first(df: DataFrame, items: Column, when: Column) -> DataFrame:
    """Empty pre-tax and tax totals from the first text line."""
    first = F.get(items, F.lit(0))
    return df.withColumns({
        field: F.when(when, fill(F.col(field), first[part])).otherwise(F.col(field))
        for field, part in (("pretax_amount", "amount"), ("tax_amount", "tax_amount"))
    })


def with_goods(df: DataFrame) -> DataFrame:
    """``line_items`` by precedence: tagged, else text rows, else blocks; then
    the totals that follow from them. Expects ``tag_items`` and ``blocks``."""
    staged = goods_from_blocks(_with_text_goods(df, "full_text", "text_items"))
    # a missing header in the text also rules out the block form
    has_header = F.col("_header_at").isNotNull()
    tagged = F.size("tag_items") > 0
    staged = staged.withColumn(
        "line_items",
        F.when(tagged, F.col("tag_items"))
        .when(F.size("text_items") > 0, F.col("text_items"))
        .when(has_header & (F.col("source") != fv.SOURCE_TAGGED), F.col("block_items"))
        .otherwise(no_goods()),
    ).withColumn("_tagged", tagged)
    amount_sum, tax_sum = list_totals(F.col("line_items"))
    staged = backfill_from_sums(staged, amount_sum, tax_sum, F.col("_tagged"))
    staged = backfill_from_first(staged, F.col("line_items"), ~F.col("_tagged"))
    return staged.drop("text_items", "block_items", "tag_items", "_header_at", "_tagged")


def goods_json(items: Column) -> Column:
    """JSON text of a goods array under its fixed keys."""
    renamed = F.transform(items, lambda it: F.struct(
        *[it[f].alias(k) for f, k in zip(fv.GOODS_FIELDS, fv.GOODS_KEYS)]))
    return F.to_json(renamed)


def goods_from_json(text: Column) -> Column:
    """Back from the JSON form; absent keys become empty."""
    from billweave.schemas import GOODS_JSON

    return F.transform(
        F.from_json(text, GOODS_JSON),
        lambda it: goods_item(**{
            f: F.coalesce(it[k], F.lit("")) for f, k in zip(fv.GOODS_FIELDS, fv.GOODS_KEYS)
        }),
    )


def explode_goods(df: DataFrame, *keep: str) -> DataFrame:
    """One row per goods line with its 1-based position.

    The outer form plus a filter on the result: the plain form lets the
    optimizer test the list before exploding it, which extracts it again.
    """
    rows = df.select(*keep, F.posexplode_outer("line_items").alias("_i", "_item"))
    return rows.filter(F.col("_i").isNotNull()).select(
        *keep, (F.col("_i") + 1).alias("item_no"), "_item.*")
