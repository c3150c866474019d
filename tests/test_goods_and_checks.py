import random
import re

import pytest
from billweave import fixed_values as fv
from billweave.operators import checks, items
from billweave.plans.folder_run import extract, finish
from pyspark.sql import functions as F


def goods(spark, text):
    df = spark.createDataFrame([(text,)], "full_text string")
    return [tuple(r) for r in items.explode_goods(items.goods_from_text(df, out="line_items")).select(
        "goods_name", "amount", "tax_rate", "tax_amount").collect()]


def test_rows_of_4_and_8_tokens(spark):
    text = "项目名称 金额\n电脑 100.00 13% 13.00\n（空行说明）\n鼠标 S1 个 2 5.00 10.00 13% 1.30\n合计 1 2 3\n键盘 1 2 3"
    assert goods(spark, text) == [("电脑", "100.00", "13%", "13.00"), ("鼠标", "10.00", "13%", "1.30")]


def test_stop_characters_and_blank_line(spark):
    assert goods(spark, "货物名称\n小米 1 2% 3") == []
    assert goods(spark, "货物名称\na 1 2% 3\n 　\nb 1 2% 3") == [("a", "1", "2%", "3")]
    assert goods(spark, "a 1 2% 3") == []


GOODS_ROW = r"^(\S+)(?:\s+\S*)?(?:\s+\S*)?(?:\s+\S*)?(?:\s+\S*)?\s+(\d+\.?\d*)\s+(\S+)\s+(\d+\.?\d*)"


def pattern_row(line):
    """The row pattern itself, on the line with single blanks."""
    found = re.match(GOODS_ROW, " ".join(line.split()))
    return found.groups() if found else None


def test_rows_against_the_pattern(spark):
    rng = random.Random(5)
    rows = ["".join(rng.choice(["a", "1", "2.5", ".", "٣", " ", " ", "  ", "　", "%", "x9"]) for _ in range(rng.randrange(1, 24))).strip() for _ in range(1500)]
    rows = [r for r in rows if r]
    df = spark.createDataFrame([(i, "商品名称\n" + r) for i, r in enumerate(rows)], "i int, full_text string")
    got = {r.i: (r.goods_name, r.amount, r.tax_rate, r.tax_amount) for r in items.explode_goods(
        items.goods_from_text(df, out="line_items"), "i").collect()}
    assert got == {i: b for i, r in enumerate(rows) if (b := pattern_row(r))}


def test_blank_runs_do_not_backtrack(spark):
    assert goods(spark, "项目名称\na" + " " * 5000 + "b" + " " * 5000 + "c") == []


def blocks(spark, rows):
    struct = "array(" + ",".join(
        f"named_struct('text','{t}','y',{y}D,'x',0D,'side','{s}')" for t, y, s in rows) + ")"
    df = spark.range(1).select(F.expr(struct).alias("blocks"))
    return [tuple(r) for r in items.explode_goods(items.goods_from_blocks(df, out="line_items")).select(
        "goods_name", "amount", "tax_rate", "tax_amount").collect()]


def test_block_rows(spark):
    head = [("项目名称", 10, "left"), ("单价", 10, "right")]
    assert blocks(spark, head + [
        ("电脑", 40, "left"), ("1,234.50", 41, "right"), ("13%", 42, "right"), ("160.49", 43, "right"), ("7", 44, "right"),
        ("鼠标", 60, "left"), ("键", 60, "left"), ("13%", 60, "right"),
        ("线材", 80, "left"), ("5.00", 81, "right"), ("合计", 100, "left"), ("灯具", 120, "left"), ("9.00", 120, "right")]) == [
        ("电脑", "1,234.50", "13%", "160.49"), ("线材", "5.00", "", "")]
    assert blocks(spark, head + [("¥9", 30, "right"), ("灯具", 40, "left"), ("9.0", 40, "right")]) == []
    assert blocks(spark, [("无", 1, "left")]) == []


# pretax, tax, total, lines (amount, tax), kinds of notes expected
CASES = [
    ("7000.00", "910.00", "7910.00", [("7000.00", "910.00")], []),
    ("7000.00", "910.00", "7910.00", [("6500.00", "910.00")], ["商品金额合计(6500.00) ≠ 不含税金额(7000.00)"]),
    ("7000.00", "910.00", "7910.00", [("7000.00", "800.00")], ["商品税额合计(800.00) ≠ 主表税额(910.00)"]),
    ("7000.00", "910.00", "8000.00", [("7000.00", "910.00")], ["不含税金额(7000.00) + 税额(910.00) ≠ 价税合计(8000.00)"]),
    ("10500.00", "1365.00", "11865.00", [("7000.00", "910.00"), ("3500.00", "455.00")], []),
    ("1", "1", "9", [], []),
    ("100.00", "13.00", "113.01", [("99.99", "13.01")], []),
    ("100.00", "13.00", "113.02", [("99.98", "13.02")], ["商品金额合计(99.98) ≠ 不含税金额(100.00)", "商品税额合计(13.02) ≠ 主表税额(13.00)",
                                                   "不含税金额(100.00) + 税额(13.00) ≠ 价税合计(113.02)"]),
    ("100.00", "", "x", [("abc", "1")], []),
]


@pytest.mark.parametrize("flat", [False, True])
def test_three_levels(spark, flat):
    head = spark.createDataFrame([(i, c[0], c[1], c[2]) for i, c in enumerate(CASES)], "i int, pretax_amount string, tax_amount string, total_amount string")
    lines = spark.createDataFrame([(i, a, t) for i, c in enumerate(CASES) for a, t in c[3]], "i int, amount string, tax_amount string")
    if flat:
        out = checks.check_against_items(head, lines, "i")
    else:
        nested = lines.groupBy("i").agg(F.collect_list(items.goods_item(amount=F.col("amount"), tax_amount=F.col("tax_amount"))).alias("line_items"))
        out = head.join(nested, "i", "left").withColumn("line_items", F.coalesce("line_items", items.no_goods())).withColumn(
            "check_notes", checks.check_notes_in_row(F.col("line_items")))
    assert [r.check_notes for r in out.orderBy("i").collect()] == [c[4] for c in CASES]


def test_remarks_join_earlier_notes_checks_and_completeness(spark):
    docs = spark.createDataFrame([("a", fv.SOURCE_TAGGED, "", "1", "5.00", "N")], "rel_path string, source string, full_text string, tag_invoice_number string, tag_total_amount string, tag_buyer_name string")
    docs = docs.withColumn("tag_items", F.array(items.goods_item(goods_name=F.lit("g"), amount=F.lit("3"), tax_amount=F.lit("1"))))
    out = extract(docs).withColumn("validation_notes", F.array(F.lit("earlier")))
    row = finish(out).first()
    # sums fill the empty totals
    assert (row.pretax_amount, row.tax_amount) == ("3.00", "1.00")
    assert row.remarks == "；".join([
        "earlier", "不含税金额(3.00) + 税额(1.00) ≠ 价税合计(5.00)", "OFD字段不完整: 缺失invoice_code,invoice_date,seller_name"])


def test_first_text_line_fills_totals(spark):
    docs = spark.createDataFrame([("a", fv.SOURCE_TEXT, "项目名称\nx 7 1% 2\ny 8 1% 3")], "rel_path string, source string, full_text string")
    row = extract(docs).first()
    assert (row.pretax_amount, row.tax_amount, len(row.line_items)) == ("7", "2", 2)


def test_block_form_only_without_text_rows_and_with_a_text_header(spark):
    block = "array(named_struct('text','项目名称','y',0D,'x',0D,'side','left'), named_struct('text','线材','y',40D,'x',0D,'side','left'), named_struct('text','5.00','y',40D,'x',0D,'side','right'))"
    docs = spark.createDataFrame([("a", "项目名称"), ("b", "无"), ("c", "项目名称\nz 1 2% 3")], "rel_path string, full_text string").withColumn("source", F.lit(fv.SOURCE_TEXT)).withColumn("blocks", F.expr(block))
    got = {r.rel_path: [i.goods_name for i in r.line_items] for r in extract(docs).collect()}
    assert got == {"a": ["线材"], "b": [], "c": ["z"]}


def test_goods_json_round_trip(spark):
    df = spark.range(1).select(F.array(items.goods_item(goods_name=F.lit('电"脑'), amount=F.lit("1"))).alias("g"))
    row = df.select(items.goods_json(F.col("g")).alias("j"), "g").withColumn("back", items.goods_from_json(F.col("j"))).first()
    assert row.back == row.g and '"货物名称":"电\\"脑"' in row.j


@pytest.mark.parametrize("place", range(5))
def test_an_empty_line_anywhere_ends_the_list(spark, place):
    rows = ["a 1 13% 1", "b 2 13% 2", "c 3 13% 3"]
    lines = ["项目名称 金额 税率 税额", *rows]
    lines.insert(place + 1, "") if place < 4 else None
    df = spark.createDataFrame([("\n".join(lines),), ("\n".join(lines).replace("\n\n", "\n \t\n"),)], "full_text string")
    for row in items.goods_from_text(df).collect():
        assert [i.goods_name for i in row.text_items] == [r[0] for r in rows[:place if place < 4 else 3]]


def test_wide_amounts(spark):
    goods = spark.createDataFrame([("a", "123456789012345678.00", "1")], "k string, amount string, tax_amount string")
    heads = spark.createDataFrame([("a", "1.00", "1", "")], "k string, pretax_amount string, tax_amount string, total_amount string")
    (row,) = checks.check_against_items(heads, goods, "k").collect()
    assert len(row.check_notes) == 1 and "123456789012345678.00" in row.check_notes[0]


def test_positions_in_a_hot_group_with_nulls(spark):
    from pyspark.sql import functions as F

    from billweave.operators.spread import chunk_of, with_ordinal

    df = spark.range(40_000).select(
        F.when(F.col("id") % 3 != 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
        F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id")).alias("at"), "id").withColumn("part", chunk_of(F.col("at"), 100))
    got = with_ordinal(df, ["k"], ["part"], ["at", "id"]).filter("k = 'hot'").select("at", "id", "ordinal").collect()
    order = sorted(got, key=lambda r: (r.at is not None, r.at or 0, r.id))
    assert [r.ordinal for r in order] == list(range(len(got))) and len(got) == 26_666
    nulls = spark.createDataFrame([(None, 1, 1), (None, None, 2)], "k string, part int, id int")
    assert sorted(r.ordinal for r in with_ordinal(nulls, ["k"], ["part"], ["id"]).collect()) == [0, 1]
    two = with_ordinal(df.withColumn("q", F.col("id") % 2), ["k"], ["part", "q"], ["at", "id"])
    assert two.count() == 40_000 and two.filter("k = 'hot'").select("ordinal").distinct().count() == 26_666
