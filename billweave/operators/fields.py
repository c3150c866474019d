"""Header fields from text: ordered pattern tables and party sections.

A document is one row, so everything here is a narrow projection: no shuffle,
no Python worker.
"""

from __future__ import annotations

from functools import cache
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billweave import fixed_values as fv
from billweave.functions.normalize import Options, field_text
from billweave.functions.text import (
    after_first_line, before_last_line, capture, contains_any, fill, first_capture, first_line, first_of, found, holds,
    jvm_regex, last_line, let, match_value, merge_label_lines, missing, required_words, strip,
)
from billweave.schemas import HEADER_FIELDS

# Linear forms of two table patterns. A run of characters that ends in 圆 is
# only tried at its start, and "the last amount in the text" is the last of all
# amounts instead of a look-ahead over the rest of the text at every amount.
_CAPITAL, _LAST_AMOUNT = fv.FIELD_PATTERNS["total_amount_cn"][0], fv.FIELD_PATTERNS["total_amount"][4]
_RUN = r"[一-鿿零壹贰叁肆伍陆柒捌玖拾佰仟万亿元角分整]"
_LINEAR_CAPITAL = rf"(?<!{_RUN})({_RUN}+圆[整角分]*)"
_AMOUNT = r"[¥￥]\s*(\d+\.\d{2})"


def pattern_test(text: Column, pattern: str) -> Column:
    """Whether a pattern of the table matches anywhere."""
    return pattern_value(text, pattern).isNotNull()


def pattern_value(text: Column, pattern: str) -> Column:
    """What the pattern captures, null where it does not match; one scan, as no group of the table captures nothing."""
    if pattern == _CAPITAL:
        return match_value(text, _LINEAR_CAPITAL, needs=("圆",))
    if pattern == _LAST_AMOUNT:
        return F.when(contains_any(text, ("¥", "￥")), F.try_element_at(
            F.regexp_extract_all(text, F.lit(jvm_regex(_AMOUNT)), F.lit(1)), F.lit(-1)))
    if pattern.startswith("[¥￥]"):
        return match_value(text, pattern, needs=("¥", "￥"))
    return match_value(text, pattern)


def _pattern_needs(pattern: str) -> list[tuple[str, ...]]:
    return [] if pattern in (_CAPITAL, _LAST_AMOUNT) else required_words(pattern)


def _group_value(text: Column, patterns: list[str]) -> Column:
    """The first capture of neighbouring patterns that need the same words, which are looked for once."""
    needs = _pattern_needs(patterns[0])
    if len(patterns) == 1 or not needs:
        return F.coalesce(*[pattern_value(text, p) for p in patterns])
    return F.when(holds(text, needs), F.coalesce(*[found(capture(text, p)) for p in patterns]))


def pattern_field(text: Column, field: str, options: Options = Options()) -> Column:
    """Value of one field: the first pattern that matches decides, even if its
    capture trims to nothing; ``''`` if none matches."""
    chain = F.coalesce(*[_group_value(text, list(same)) for _, same in groupby(fv.FIELD_PATTERNS[field], _pattern_needs)])
    return F.coalesce(field_text(field, strip(chain), options), F.lit(""))


def with_header_fields(df: DataFrame) -> DataFrame:
    """Make sure every header column exists, empty where unknown."""
    new = {f: F.lit("") for f in HEADER_FIELDS if f not in df.columns}
    old = {f: F.coalesce(F.col(f), F.lit("")) for f in HEADER_FIELDS if f in df.columns}
    return df.withColumns({**old, **new})


def fill_from_patterns(
    df: DataFrame, text: str = "full_text", options: Options = Options()
) -> DataFrame:
    """Fill the empty ones of the 11 pattern fields from the merged-line text.

    The table is one lambda over the merged text: the text is merged once and the
    38 patterns stay out of the generated code, which they would push over the
    size the JVM compiles. The regexes themselves run the same. Columns are plain
    expressions, so the table is built once per process.
    """
    staged = df.withColumn("_fields", _pattern_table(text, options))
    return staged.withColumns({f: F.col(f"_fields.{f}") for f in fv.FIELD_PATTERNS}).drop("_fields")


@cache
def _pattern_table(text: str, options: Options) -> Column:
    return let(merge_label_lines(F.col(text)), lambda merged: F.struct(*[
        F.when(missing(F.col(field)), pattern_field(merged, field, options))
        .otherwise(F.col(field)).alias(field)
        for field in fv.FIELD_PATTERNS]))


def party_section(df: DataFrame, party: str, text: str = "full_text") -> DataFrame:
    """Adds ``<party>_line`` (first line with a marker of the party; null if none),
    ``<party>_both`` (that line also names the other party) and
    ``<party>_section`` (from that line up to the next line that names the other).
    """
    other = "seller" if party == "buyer" else "buyer"
    has, hasnt = tuple(fv.PARTY_MARKERS[party]), tuple(fv.PARTY_MARKERS[other])
    whole, head, tail, rest, at = F.col(text), F.col("_head"), F.col("_tail"), F.col("_rest"), F.col("_at")
    line = F.col(f"{party}_line")
    return (
        df.withColumn("_at", first_of(whole, has))
        .withColumn("_head", F.substring(whole, F.lit(1), at - 1))
        .withColumn("_tail", F.substring(whole, at, F.char_length(whole)))
        .withColumns({
            f"{party}_line": F.concat(last_line(head), first_line(tail)),
            "_rest": after_first_line(tail),
        })
        .withColumns({
            f"{party}_both": contains_any(line, hasnt),
            "_at": first_of(rest, hasnt),
        })
        .withColumn(
            "_rest", F.when(at.isNotNull(), before_last_line(F.substring(rest, F.lit(1), at - 1))).otherwise(rest)
        )
        .withColumn(
            f"{party}_section",
            F.when(rest.isNull(), line).otherwise(F.concat(line, F.lit("\n"), rest)),
        )
        .drop("_at", "_head", "_tail", "_rest")
    )


def party_field_names(party: str) -> list[str]:
    return [f"{party}_{part}" for part in dict.fromkeys(p for p, _, _ in fv.PARTY_PATTERNS)]


def party_values(texts: Column, party: str) -> Column:
    """Party fields as they are or from the first of the party's texts and
    patterns that matches."""
    def value(field: str) -> Column:
        rules = [(p, g) for name, p, g in fv.PARTY_PATTERNS if f"{party}_{name}" == field]
        found = first_capture([
            (texts[kind], p, g) for kind in ("column", "line", "section") for p, g in rules])
        return F.when(missing(F.col(field)), fill(strip(found))).otherwise(F.col(field))

    return F.struct(*[value(f).alias(f) for f in party_field_names(party)])


@cache
def _party_table(party: str) -> Column:
    texts = F.struct(
        F.when(F.col("has_side"), F.col(f"{fv.PARTY_SIDE[party]}_text")).alias("column"),
        F.when(F.col(f"{party}_both"), F.col(f"{party}_line")).alias("line"),
        F.col(f"{party}_section").alias("section"),
    )
    return let(texts, lambda t: party_values(t, party))


def fill_from_sections(df: DataFrame, text: str = "full_text") -> DataFrame:
    """Fill empty party fields from the section of each party.

    With ``has_side`` rows the left column text belongs to the buyer and the
    right one to the seller, and nothing else is tried. Other rows use the line
    that names both parties first, then the lines of the section.
    """
    staged = df
    if "has_side" not in df.columns:
        staged = staged.withColumns({
            "has_side": F.lit(False),
            "left_text": F.lit(None).cast("string"),
            "right_text": F.lit(None).cast("string"),
        })
    for party in ("buyer", "seller"):
        staged = party_section(
            staged.withColumn("_lines", F.when(~F.col("has_side"), F.col(text))), party, "_lines"
        ).drop("_lines")
        staged = staged.withColumn("_party", _party_table(party))
        staged = staged.withColumns({
            name: F.col(f"_party.{name}") for name in party_field_names(party)
        }).drop(f"{party}_line", f"{party}_both", f"{party}_section", "_party")
    return staged if "has_side" in df.columns else staged.drop("has_side", "left_text", "right_text")


def companies_above_tax_ids(
    df: DataFrame, text: str, buyer_tax_id: str, seller_tax_id: str
) -> DataFrame:
    """Empty party names from the nearest company line above a line with the tax id.

    One pass over the lines of a document. The state keeps the nearest company
    line and the nearest one that differs from it, as the seller has to differ
    from the buyer found so far.
    """
    company = F.lit(jvm_regex(fv.COMPANY_LINE))
    state = "struct<near:string,other:string,buyer:string,seller:string>"

    def step(acc: Column, line: Column) -> Column:
        def reaches(tax_id: str) -> Column:
            return (F.col(tax_id) != "") & F.contains(line, F.col(tax_id))

        buyer = F.when(
            (acc["buyer"] == "") & reaches(buyer_tax_id), acc["near"]
        ).otherwise(acc["buyer"])
        candidate = F.when(acc["near"] != buyer, acc["near"]).otherwise(acc["other"])
        seller = F.when(
            (acc["seller"] == "") & reaches(seller_tax_id), candidate
        ).otherwise(acc["seller"])
        fresh = F.rlike(line, company) & (line != acc["near"])
        return F.struct(
            F.when(fresh, line).otherwise(acc["near"]).alias("near"),
            F.when(fresh, acc["near"]).otherwise(acc["other"]).alias("other"),
            buyer.alias("buyer"),
            seller.alias("seller"),
        )

    known = {"buyer": "buyer_name", "seller": "seller_name"}
    empty = F.struct(F.lit("").alias("near"), F.lit("").alias("other"), *[
        (F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")).alias(n) for n, c in known.items()])
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), strip), lambda l: l != "")
    return (
        df.withColumn("_found", F.aggregate(lines, empty.cast(state), step))
        .withColumns({"buyer_name": F.col("_found.buyer"), "seller_name": F.col("_found.seller")})
        .drop("_found")
    )
