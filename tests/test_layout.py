import random

from billweave.operators import layout
from billweave.sources.blocks import clean_spans
from pyspark.sql import functions as F

SPANS = "rel_path string, page int, seq int, x double, y double, text string"


def brute_lines(rows, tolerance):
    lines, anchor = [], None
    for y, x, seq, text in sorted(rows):
        if anchor is None or abs(y - anchor) > tolerance:
            anchor, lines = y, lines + [[]]
        lines[-1].append(text)
    return lines


def test_anchor_and_not_gap(spark):
    rng = random.Random(1)
    rows = [(float(rng.randrange(60)), float(rng.randrange(9)), i, f"t{i}") for i in range(200)]
    rows += [(0.0, 0.0, 900, "a"), (2.0, 0.0, 901, "b"), (4.0, 0.0, 902, "c")]
    df = spark.createDataFrame([("d", 0, s, x, y, t) for y, x, s, t in rows], SPANS)
    page = layout.pages(df, "rel_path", "page")
    lines = page.select(F.transform(layout.anchored_lines(F.col("spans"), 3.0), lambda l: F.transform(l, lambda r: r["text"])).alias("l")).first().l
    assert lines == brute_lines(rows, 3.0)


def test_lines_columns_and_order(spark):
    rows = [("d", 0, 0, 0.0, 10.0, "L1"), ("d", 0, 1, 100.0, 12.0, "R1"), ("d", 0, 2, 5.0, 20.0, "  only left "), ("d", 1, 0, 0.0, 0.0, "p2"), ("d", 0, 3, 3.0, 20.0, " ")]
    row = layout.with_column_texts(layout.embedded_documents(clean_spans(spark.createDataFrame(rows, SPANS)))).first()
    assert row.full_text == "L1 R1\nonly left\np2"
    assert [(b.text, b.side) for b in row.blocks] == [("L1", "left"), ("R1", "right"), ("only left", "left"), ("p2", "right")]
    assert (row.left_text, row.right_text, row.has_side) == ("L1\nonly left", "R1\np2", True)


def test_recognised_order_confidence_and_first_page(spark):
    box = lambda x, y: [[x - 1.0, y - 1.0], [x + 1.0, y - 1.0], [x + 1.0, y + 1.0], [x - 1.0, y + 1.0]]
    flat = lambda x, y: [[v for p in box(x, y) for v in p]]
    rows = [("d", 0, 0, "right", 0.9, box(90.0, 14.0)), ("d", 0, 1, "left", 0.7, flat(10.0, 6.0)), ("d", 0, 2, "below", 0.5, box(10.0, 30.0)),
            ("d", 0, 3, "nowhere", 0.9, None), ("d", 1, 0, "page two", 0.1, box(0.0, 0.0))]
    df = spark.createDataFrame(rows, "rel_path string, page int, seq int, text string, confidence double, bbox array<array<double>>")
    whole = layout.recognised_documents(df).first()
    assert whole.full_text == "nowhere\nleft\nright\nbelow\npage two" and abs(whole.confidence - 0.62) < 1e-9
    row = layout.recognised_documents(layout.first_pages(df)).first()
    assert row.full_text == "nowhere\nleft\nright\nbelow"
    assert abs(row.confidence - 0.75) < 1e-9
    assert {b.text: b.side for b in row.blocks} == {"nowhere": "left", "left": "left", "right": "right", "below": "left"}


def test_pages_do_not_mix(spark):
    box = [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]]
    rows = [("d", p, s, f"p{p}{'ab'[s]}", 1.0, [[x + 300 * s + 50 * p, y] for x, y in box]) for p in (1, 0) for s in (1, 0)]
    df = spark.createDataFrame(rows, "rel_path string, page int, seq int, text string, confidence double, bbox array<array<double>>")
    row = layout.recognised_documents(df).first()
    assert row.full_text == "p0a\np0b\np1a\np1b" and [b.side for b in row.blocks] == ["left", "right"] * 2


def test_source_choice(spark):
    kind = "rel_path string, full_text string, blocks array<struct<text:string,y:double,x:double,side:string>>"
    e = spark.createDataFrame([("long", "x" * 51, []), ("short", "x" * 50, []), ("alone", "y", [])], kind)
    r = spark.createDataFrame([("long", "r", 0.5, []), ("short", "r", 0.5, []), ("new", "r", 0.4, [])], kind.replace("blocks", "confidence double, blocks"))
    got = {d.rel_path: (d.full_text[:1], d.confidence, len(d.parse_errors)) for d in layout.choose_text(e, r).collect()}
    assert got == {"long": ("x", 1.0, 0), "short": ("r", 0.5, 0), "alone": ("y", 0.8, 1), "new": ("r", 0.4, 0)}
