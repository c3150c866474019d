"""Reading order, lines and columns from positioned text.

Rows of a page meet once, in the page group, and turn into lines there; only
finished lines travel on to the document. A page is one printed sheet and a
document one file, so both groups have a physical bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billweave import fixed_values as fv
from billweave.functions.text import let
from billweave.operators.items import contiguous_groups, slices_at
from billweave.schemas import BLOCK


def polygon_centre(bbox: Column) -> tuple[Column, Column]:
    """Centre of a polygon given as 4 points, or as 8 numbers wrapped in one
    list; 0, 0 for anything else."""
    flat = F.flatten(bbox)
    points = (F.size(bbox) == 4) & F.forall(bbox, lambda p: F.size(p) >= 2)
    numbers = (F.size(bbox) == 1) & (F.size(flat) == 8)

    def mean(axis: int) -> Column:
        of_points = F.transform(bbox, lambda p: F.get(p, F.lit(axis)))
        of_numbers = F.filter(flat, lambda v, i: i % 2 == axis)
        values = F.when(points, of_points).when(numbers, of_numbers)
        total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
        return F.coalesce(total / 4, F.lit(0.0))

    return mean(0), mean(1)


def split_line(x_min: Column, x_max: Column) -> Column:
    return x_min + (x_max - x_min) * fv.COLUMN_SPLIT_SHARE


def side_of(x: Column, x_mid: Column) -> Column:
    return F.when(x < x_mid, F.lit("left")).otherwise(F.lit("right"))


def _texts(rows: Column) -> Column:
    return F.transform(rows, lambda r: r["text"])


def _block(text: Column, y: Column, x: Column, side: Column) -> Column:
    return F.struct(
        text.alias("text"), y.alias("y"), x.alias("x"), side.alias("side")
    ).cast(BLOCK)


def anchored_lines(rows: Column, tolerance: float) -> Column:
    """Cut y-sorted rows where y leaves the tolerance of the line's first y.

    The first y of a line is the anchor, so this is a fold and not a test of
    neighbouring gaps. The fold only carries start positions.
    """
    state = "struct<starts:array<int>,anchor:double,at:int>"
    zero = F.struct(
        F.array().cast("array<int>").alias("starts"),
        F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("at"),
    ).cast(state)

    def step(acc: Column, row: Column) -> Column:
        fresh = acc["anchor"].isNull() | (F.abs(row["y"] - acc["anchor"]) > tolerance)
        return F.struct(
            F.when(fresh, F.array_append(acc["starts"], acc["at"])).otherwise(acc["starts"]).alias("starts"),
            F.when(fresh, row["y"]).otherwise(acc["anchor"]).alias("anchor"),
            (acc["at"] + 1).alias("at"),
        )

    return slices_at(rows, F.aggregate(rows, zero, step, lambda acc: acc["starts"]))


def bucket_lines(rows: Column, size: int = fv.RAW_LINE_BUCKET) -> Column:
    """Cut y-sorted rows where the rounded y band changes."""
    return contiguous_groups(rows, lambda r: F.rint(r["y"] / size))


def by_x(rows: Column) -> Column:
    """Order the rows of a line by x, equal x as they came."""
    return F.sort_array(F.transform(
        rows, lambda r, i: F.struct(r["x"].alias("x"), i.alias("i"), r["text"].alias("text"))))


def pages(spans: DataFrame, *keys: str) -> DataFrame:
    """One row per page with its spans ordered by (y, x) and its split line."""
    row = F.struct("y", "x", "seq", "text")
    return spans.groupBy(*keys).agg(
        F.sort_array(F.collect_list(row)).alias("spans"),
        split_line(F.min("x"), F.max("x")).alias("x_mid"),
    )


def _split_columns(line: Column, x_mid: Column) -> Column:
    """The one or two blocks of a line: left and right part of a line that
    crosses the split, else the whole line on the side of its first span."""
    first, last = F.get(line, F.lit(0)), F.element_at(line, -1)

    def cut(halves: Column) -> Column:
        left, right = halves["left"], halves["right"]
        return F.when(
            (left != "") & (right != ""),
            F.array(
                _block(left, first["y"], first["x"], F.lit("left")),
                _block(right, first["y"], last["x"], F.lit("right")),
            ),
        ).otherwise(F.array(
            _block(F.concat(left, right), first["y"], first["x"], side_of(first["x"], x_mid))))

    def joined(rows: Column) -> Column:
        return F.array_join(_texts(rows), " ")

    return let(F.struct(
        joined(F.filter(line, lambda r: r["x"] < x_mid)).alias("left"),
        joined(F.filter(line, lambda r: r["x"] >= x_mid)).alias("right"),
    ), cut)


def page_lines(spans: DataFrame) -> DataFrame:
    """Embedded text: per page the raw lines (5-unit bands, by x) and the
    column blocks (anchored lines cut at the split line)."""
    staged = pages(spans, "rel_path", "page")
    raw = F.transform(
        bucket_lines(F.col("spans")), lambda line: F.array_join(_texts(by_x(line)), " "))
    cut = F.flatten(F.transform(
        anchored_lines(F.col("spans"), fv.EMBEDDED_LINE_TOLERANCE),
        lambda line: _split_columns(line, F.col("x_mid"))))
    return staged.select("rel_path", "page", raw.alias("lines"), cut.alias("blocks"))


def ordered_pages(df: DataFrame, page: str, **columns: str) -> DataFrame:
    """Concatenate the array columns of a document's pages in page order."""
    rows = F.sort_array(F.collect_list(F.struct(
        F.col(page).alias("_page"), *[F.col(c).alias(n) for n, c in columns.items()])))
    grouped = df.groupBy("rel_path").agg(rows.alias("_pages"))
    return grouped.select("rel_path", *[
        F.flatten(F.col(f"_pages.{n}")).alias(n) for n in columns])


def embedded_documents(spans: DataFrame) -> DataFrame:
    """``rel_path, full_text, blocks`` of documents with embedded text."""
    return ordered_pages(page_lines(spans), "page", lines="lines", blocks="blocks").select(
        "rel_path", F.array_join("lines", "\n").alias("full_text"), "blocks")


def first_pages(blocks: DataFrame) -> DataFrame:
    """Blocks of the first page of every document."""
    return blocks.filter(F.col("page") == 0)


def recognised_documents(blocks: DataFrame) -> DataFrame:
    """``rel_path, full_text, confidence, blocks`` from recognised blocks, in
    reading order: page by page, 10-unit bands from the top, left to right. Every page
    has its own split line. Rows are dealt by file, once: as a document ends in one cell, its pages are put together beside it."""
    x, y = polygon_centre(F.col("bbox"))
    size = fv.BLOCK_ORDER_BUCKET
    placed = blocks.select("rel_path", "page", "seq", "text", "confidence", x.alias("x"), y.alias("y")).repartition("rel_path")
    row = F.struct(
        (F.rint(F.col("y") / size) * size).alias("band"), "x", "seq", "text", "y")
    by_page = placed.groupBy("rel_path", "page").agg(
        F.sort_array(F.collect_list(row)).alias("_rows"),
        F.sum("confidence").alias("_sum"), F.count("confidence").alias("_n"),
        split_line(F.min("x"), F.max("x")).alias("x_mid"),
    )
    sided = F.transform(F.col("_rows"), lambda r: _block(
        r["text"], r["y"], r["x"], side_of(r["x"], F.col("x_mid"))))
    page = F.struct("page", sided.alias("blocks"))
    grouped = by_page.groupBy("rel_path").agg(
        F.flatten(F.sort_array(F.collect_list(page))["blocks"]).alias("blocks"),
        F.coalesce(F.sum("_sum") / F.nullif(F.sum("_n"), F.lit(0)), F.lit(0.0)).alias("confidence"))
    return grouped.select(
        "rel_path", F.array_join(_texts(F.col("blocks")), "\n").alias("full_text"),
        "confidence", "blocks")


def with_column_texts(df: DataFrame, blocks: str = "blocks") -> DataFrame:
    """``has_side, left_text, right_text`` of a document's ordered blocks."""
    def column(side: str) -> Column:
        return F.array_join(_texts(F.filter(F.col(blocks), lambda b: b["side"] == side)), "\n")

    return df.withColumns({
        "has_side": F.coalesce(
            F.exists(F.col(blocks), lambda b: b["side"].isNotNull() & (b["side"] != "")),
            F.lit(False)),
        "left_text": column("left"),
        "right_text": column("right"),
    })


def choose_text(embedded: DataFrame, recognised: DataFrame) -> DataFrame:
    """Embedded text of more than 50 characters is taken as is; shorter text
    only stands in where nothing was recognised, with less confidence and a
    parse error."""
    e = embedded.select("rel_path", F.col("full_text").alias("e_text"), F.col("blocks").alias("e_blocks"))
    r = recognised.select(
        "rel_path", F.col("full_text").alias("r_text"),
        F.col("confidence").alias("r_confidence"), F.col("blocks").alias("r_blocks"))
    long_enough = F.coalesce(F.char_length("e_text") > fv.EMBEDDED_MIN_CHARS, F.lit(False))
    usable = F.col("r_text").isNotNull()

    def pick(a: Column, b: Column, c: Column) -> Column:
        return F.when(long_enough, a).when(usable, b).otherwise(c)

    no_errors = F.array().cast("array<string>")
    return e.join(r, "rel_path", "full_outer").select(
        "rel_path",
        pick(F.col("e_text"), F.col("r_text"), F.col("e_text")).alias("full_text"),
        pick(F.lit(1.0), F.col("r_confidence"), F.lit(0.8)).alias("confidence"),
        pick(F.col("e_blocks"), F.col("r_blocks"), F.col("e_blocks")).alias("blocks"),
        pick(no_errors, no_errors, F.array(F.lit(fv.MSG_NO_RECOGNITION))).alias("parse_errors"),
    )
