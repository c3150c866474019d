import re

import pytest
from billweave import fixed_values as fv
from billweave.functions import text
from billweave.operators import fields, layout
from pyspark.sql import functions as F


def run(spark, texts, step):
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, full_text string")
    return [r.asDict() for r in step(fields.with_header_fields(docs)).orderBy("i").collect()]


def test_first_match_decides_even_if_it_trims_to_nothing(spark):
    row, = run(spark, ["校验码：         x\n校验码：AB12"], fields.fill_from_patterns)
    assert row["check_code"] == ""


def test_filled_fields_stay(spark):
    docs = spark.createDataFrame([("发票号码：12345678",)], "full_text string").withColumn("invoice_number", F.lit("7"))
    assert fields.fill_from_patterns(fields.with_header_fields(docs)).first()["invoice_number"] == "7"


@pytest.mark.parametrize("field,index", [("total_amount_cn", 0), ("total_amount", 4)])
def test_linear_forms_equal_the_table_pattern(spark, field, index):
    import random

    rng = random.Random(11)
    pattern = fv.FIELD_PATTERNS[field][index]
    alphabet = "圆整角分壹a ¥￥1.23\n合"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    value = F.when(fields.pattern_test(F.col("t"), pattern), fields.pattern_value(F.col("t"), pattern))
    got = [r.v for r in df.select("i", value.alias("v")).orderBy("i").collect()]
    assert got == [(m.group(1) if (m := re.search(pattern, t)) else None) for t in texts]


def test_many_capitals_and_amounts_stay_linear(spark):
    text = "合" * 200_000 + "\n" + "¥1.00 " * 50_000 + "¥9.99\n圆"
    row, = run(spark, [text], fields.fill_from_patterns)
    assert row["total_amount"] == "9.99"
    assert row["total_amount_cn"] == ""


def test_stacked_section_ends_at_the_other_party(spark):
    text = "x\n购买方\n名称：甲\n税号：" + "1" * 18 + "\n销售方 名称：乙\n地址：路\n购买须知\n电话：9"
    row, = run(spark, [text], fields.fill_from_sections)
    assert (row["buyer_name"], row["buyer_tax_id"], row["buyer_address_phone"]) == ("甲", "1" * 18, "")
    assert (row["seller_name"], row["seller_address_phone"]) == ("乙", "路")


def test_same_line_before_section(spark):
    row, = run(spark, ["购名称：甲 销名称：乙\n名称：丙"], fields.fill_from_sections)
    # both parties read the first name of the shared line
    assert (row["buyer_name"], row["seller_name"]) == ("甲", "甲")


def test_value_before_label(spark):
    row, = run(spark, ["购买方\n" + "A" * 18 + " 统一社会信用代码 税号：" + "B" * 18], fields.fill_from_sections)
    assert row["buyer_tax_id"] == "A" * 18


def test_columns_stop_the_other_layouts(spark):
    docs = spark.createDataFrame([("购买方 名称：行",)], "full_text string").withColumn(
        "blocks", F.expr("array(named_struct('text','名称：甲','y',0D,'x',0D,'side','left'), named_struct('text','税号','y',0D,'x',9D,'side','right'))"))
    row = fields.fill_from_sections(fields.with_header_fields(layout.with_column_texts(docs))).first()
    assert (row["buyer_name"], row["seller_name"]) == ("甲", "")


def test_no_marker_gives_nothing(spark):
    row, = run(spark, ["名称：甲"], fields.fill_from_sections)
    assert row["buyer_name"] == ""


def test_company_above_tax_id(spark):
    docs = spark.createDataFrame([
        ("甲厂\nT1 x\n乙店\nT2", "T1", "T2"), ("T1\n甲厂\nT1\nT2", "T1", "T2"), ("甲厂\n乙店\n乙店\nT1 T2", "T1", "T2"), ("甲厂\nT1", "", "T1")],
        "full_text string, b string, s string")
    got = [(r.buyer_name, r.seller_name) for r in fields.companies_above_tax_ids(docs, "full_text", "b", "s").collect()]
    assert got == [("甲厂", "乙店"), ("甲厂", ""), ("乙店", "甲厂"), ("", "甲厂")]


def test_known_party_names_stay(spark):
    rows = [("甲有限公司\n税号 91\n乙有限公司\n税号 92", "91", "92", "known", ""), ("nothing", "91", "92", "a", "b")]
    df = spark.createDataFrame(rows, "full_text string, b string, s string, buyer_name string, seller_name string")
    got = [(r.buyer_name, r.seller_name) for r in fields.companies_above_tax_ids(df, "full_text", "b", "s").collect()]
    assert got == [("known", "乙有限公司"), ("a", "b")]


def test_tagged_rows_get_no_section_fields(spark):
    from billweave import fixed_values as fv
    from billweave.plans.folder_run import extract

    blocks = [("名称：甲有限公司", 1.0, 1.0, "left"), ("名称：乙有限公司", 1.0, 9.0, "right")]
    kind = "rel_path string, source string, full_text string, blocks array<struct<text:string,y:double,x:double,side:string>>"
    df = spark.createDataFrame([("t", fv.SOURCE_TAGGED, "", blocks), ("p", fv.SOURCE_TEXT, "", blocks)], kind)
    got = {r.rel_path: (r.buyer_name, r.seller_name) for r in extract(df).collect()}
    assert got == {"t": ("", ""), "p": ("甲有限公司", "乙有限公司")}


def test_every_group_of_the_tables_takes_a_character():
    """One scan tells both whether a pattern matches and what it captures, as no group can be empty."""
    tables = [(p, 1) for patterns in fv.FIELD_PATTERNS.values() for p in patterns] + [(p, g) for _, p, g in fv.PARTY_PATTERNS]
    for pattern, group in tables:
        depth, at, number = 0, None, 0
        for m in re.finditer(r"\\.|\[(?:\\.|[^\]\\])*\]|\((?!\?)|\(\?|\)", pattern):
            if m[0] == "(":
                number += 1
                at = m.start() if number == group else at
            depth += m[0].startswith("(") - (m[0] == ")")
            if at is not None and m[0] == ")" and pattern[at:m.end()].count("(") == pattern[at:m.end()].count(")"):
                assert not re.fullmatch(pattern[at:m.end()], ""), pattern
                break


def test_required_words():
    assert text.required_words(r"购\s*名称[：:]*(\S+(?:厂|店))") == [("购",), ("名称",)]
    assert text.required_words(r"(地址电话|地址|电话)[：:]*(\S+)") == [("地址", "电话")]
    assert text.required_words(r"[\]a]b?cd*(x)") == [("c",)]
    assert text.required_words("a|b") == [] and text.required_words("(?i)ab") == [] and text.required_words("(a|b)?c") == [("c",)]


def test_fields_take_one_scan_for_each_pattern(spark):
    """Tests and captures are one regex each, and words are found without any."""
    docs = fields.with_header_fields(spark.createDataFrame([("x",)], "full_text string"))
    plan = fields.fill_from_sections(fields.fill_from_patterns(docs))._jdf.queryExecution().analyzed().toString()
    assert plan.upper().count("RLIKE") <= len(fv.DATE_LAYOUTS)


def test_first_word(spark):
    docs = spark.createDataFrame([("a 买方 购买方",), ("购",), ("",), (None,)], "t string")
    got = [r.at for r in docs.select(text.first_of(F.col("t"), ("购买方", "购", "买方")).alias("at")).collect()]
    assert got == [3, 1, None, None]


def test_a_party_value_is_searched_once(spark):
    """The text of a field is found by one chain of searches, which a test for the empty string would run again."""
    from billweave.operators import fields

    row = spark.range(1).selectExpr(
        "'购买方\n税号：' || '9' AS buyer_section", "'' AS buyer_line", "false AS buyer_both", "false AS has_side", "'' AS left_text",
        *[f"'' AS {name}" for name in fields.party_field_names("buyer")])
    plan = row.select(fields._party_table("buyer").alias("p"))._jdf.queryExecution().analyzed().toString()
    # of the line, of the section and of the column
    assert plan.count("(开户行及账号|") == 3


def test_neighbouring_patterns_look_for_their_words_once(spark):
    from billweave.operators import fields

    row = spark.range(1).selectExpr("'校验码：123456' AS t")
    plan = row.select(fields.pattern_field(row.t, "check_code").alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.lower().count("contains(t") == 1


def test_grouped_patterns_keep_their_order(spark):
    from pyspark.sql import functions as F

    from billweave.operators import fields

    texts = ["校验码：12345", "校验码：12 34 56", "校验码 x1", "校验码：x 123456", "校验 码：123456", "税额：a 税额 5", "税 额¥3.5", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select(
        fields.pattern_field(F.col("t"), "check_code").alias("c"), fields.pattern_field(F.col("t"), "tax_amount").alias("a"), "i"
    ).orderBy("i").collect()
    assert [r.c for r in got] == ["12345", "123456", "", "x", "", "", "", "", ""]
    assert [r.a for r in got] == ["", "", "", "", "", "5", "3.5", "", ""]
