"""Checked queries: scalars, header fields, party sections, goods lines, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave import fixed_values as fv
from billweave.functions import normalize
from billweave.operators import checks, fields, flat, items, layout, tags
from billweave.operators.outcome import is_success
from billweave.plans import render
from billweave.plans.storage import run_folder, stored
from billweave.plans.catalog_sql import GOODS, ORDER_HEADERS, PARTIES
from billweave.plans.folder_run import extract, finish, process_documents, with_document_columns
from billweave.schemas import PARTY_FIELDS


def normalize_date(spark: SparkSession, sf: str) -> DataFrame:
    orders = render.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    raw = F.concat(F.lit(" "), render.date_in_style(F.col("o_orderdate"), F.col("o_orderkey") % 5))
    odd = F.when(F.col("o_orderkey") % 23 == 0, F.date_format("o_orderdate", "dd-MM-yyyy")).otherwise(raw)
    return orders.select("o_orderkey", normalize.date_text(odd).alias("invoice_date"))


def normalize_amount(spark: SparkSession, sf: str) -> DataFrame:
    orders = render.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    key = F.col("o_orderkey")
    sign = F.when(key % 3 == 0, "¥").when(key % 3 == 1, "￥ ").otherwise("-€")
    raw = F.concat(sign, F.format_number(render.money(F.col("o_totalprice")), 2))
    raw = F.when(key % 2 == 0, F.translate(raw, ",", "，")).otherwise(raw)
    return orders.select("o_orderkey", normalize.amount_text(raw).alias("amount"))


def normalize_code_width(spark: SparkSession, sf: str) -> DataFrame:
    orders = render.table(spark, sf, "orders").select("o_orderkey")
    key = render.padded(F.col("o_orderkey"), 20)
    wide = render.wide_digits(F.concat(F.lit("ＣＡa"), key))
    spaced = F.regexp_replace(key, "(.{4})", "$1　")
    return orders.select(
        "o_orderkey",
        normalize.field_text("invoice_code", wide).alias("code"),
        normalize.field_text("check_code", spaced).alias("check_code"))


def extract_core_fields(spark: SparkSession, sf: str) -> DataFrame:
    docs = fields.fill_from_patterns(fields.with_header_fields(render.header_documents(spark, sf)))
    return docs.select(
        "order_key", "invoice_code", "invoice_number", "invoice_date", "check_code", "invoice_type",
        "buyer_name", "seller_name", "pretax_amount", "tax_amount", "total_amount",
        is_success().alias("is_success"))


CORE_SQL = f"""
WITH {ORDER_HEADERS}
SELECT order_key, code AS invoice_code,
       CASE WHEN order_key % 11 = 0 THEN '' ELSE number END AS invoice_number,
       strftime(order_date, '%Y-%m-%d') AS invoice_date, number AS check_code,
       '增值税电子普通发票' AS invoice_type, buyer AS buyer_name, seller AS seller_name,
       CAST(pretax AS VARCHAR) AS pretax_amount, CAST(CAST(total - pretax AS DECIMAL(18,2)) AS VARCHAR) AS tax_amount,
       CAST(CASE WHEN order_key % 17 = 0 THEN CAST(total - pretax AS DECIMAL(18,2)) ELSE total END AS VARCHAR) AS total_amount,
       order_key % 11 <> 0 AS is_success
FROM headers
"""

# one text per pattern: (field, rendered text, expected value); @k, @m, @c stand
# for the padded key, an amount and the same amount with separators
VARIANTS = [
    ("invoice_code", "发票代码：A@k", "A@k"),
    ("invoice_code", "发票代码 ： B1", "B1"),
    ("invoice_number", "发票号码：00000@k", "00000@k"),
    ("invoice_number", "发票号码@k", "@k"),
    ("invoice_number", "发票号码 : 123", "123"),
    ("invoice_number", "No：@k", "@k"),
    ("invoice_date", "开票日期：1998年3月5日", "1998-03-05"),
    ("invoice_date", "开票日期：19980305", "1998-03-05"),
    ("invoice_date", "日期：1998/3/5", "1998-03-05"),
    ("check_code", "校验码：@k 1234", "@k1234"),
    ("check_code", "校验码：A@k", "A@k"),
    ("check_code", "校验码：          ", ""),
    ("invoice_type", "x增值税专用发票@k", "增值税专用发票"),
    ("invoice_type", "y电子发票@k", "电子发票"),
    ("total_amount_cn", "@k叁佰圆整 x", "叁佰圆整"),
    ("total_amount_cn", "价税合计（大写）：叁佰元整 @k", "叁佰元整"),
    ("total_amount_cn", "价税合计（大写）：X@k", "X@k"),
    ("total_amount", "价税合计（小写）：¥@c", "@m"),
    ("total_amount", "价税合计(小写)= x@k", "x@k"),
    ("total_amount", "价税合计：¥ @c", "@m"),
    ("total_amount", "（小写）合 ¥@m", "@m"),
    ("total_amount", "应付 ¥1.25 实付 ￥@m 完", "@m"),
    ("pretax_amount", "不含税金额：@c", "@m"),
    ("pretax_amount", "不含税：￥@c", "@m"),
    ("pretax_amount", "金额　¥@c", "@m"),
    ("pretax_amount", "合 计 ¥@m", "@m"),
    ("tax_amount", "税 额：¥@c", "@m"),
    ("tax_amount", "合 计 ¥1.00 ¥@m", "@m"),
    ("tax_amount", "税额：免税@k", "免税@k"),
    ("buyer_name", "购 名称：甲@k有限公司", "甲@k有限公司"),
    ("buyer_name", "购买方信息 名称：乙@k厂", "乙@k厂"),
    ("buyer_name", "购方：名称：丙@k店", "丙@k店"),
    ("buyer_name", "名称：丁@k集团", "丁@k集团"),
    ("seller_name", "销名称：戊@k部", "戊@k部"),
    ("seller_name", "销售方 名称：己@k有限责任公司", "己@k有限责任公司"),
    ("seller_name", "销方：名称：庚@k社", "庚@k社"),
]


def pattern_variants(spark: SparkSession, sf: str) -> DataFrame:
    orders = render.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    key = F.col("o_orderkey")
    amount = render.money(F.col("o_totalprice"))
    pick = (key % len(VARIANTS)).cast("int")
    filled = F.get(F.array(*[F.lit(t) for _, t, _ in VARIANTS]), pick)
    for mark, value in (("@k", render.padded(key, 10)), ("@m", amount.cast("string")), ("@c", F.format_number(amount, 2))):
        filled = F.replace(filled, F.lit(mark), value)
    docs = orders.select(
        "o_orderkey", F.get(F.array(*[F.lit(f) for f, _, _ in VARIANTS]), pick).alias("field"), filled.alias("full_text"))
    done = fields.fill_from_patterns(fields.with_header_fields(docs))
    value = F.coalesce(*[F.when(F.col("field") == f, F.col(f)) for f in fv.FIELD_PATTERNS])
    return done.select("o_orderkey", "field", value.alias("value"))


def _variants_sql() -> str:
    def choose(column: int) -> str:
        cases = " ".join(f"WHEN {i} THEN '{v[column]}'" for i, v in enumerate(VARIANTS))
        return f"CASE o_orderkey % {len(VARIANTS)} {cases} END"

    return f"""
    SELECT o_orderkey, {choose(0)} AS field,
           replace(replace({choose(2)}, '@k', lpad(CAST(o_orderkey AS VARCHAR), 10, '0')),
                   '@m', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)) AS value
    FROM orders"""


def _sections(docs: DataFrame) -> DataFrame:
    done = fields.fill_from_sections(fields.with_header_fields(docs))
    return done.select("order_key", *PARTY_FIELDS)


def extract_sections_stacked(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat_ws(
        "\n", F.lit("电子发票"), F.lit("购买方信息"), *render.party_lines("b"),
        F.lit("销售方信息"), *render.party_lines("s"), F.lit("购物愉快"))
    return _sections(render.parties(spark, sf).withColumn("full_text", text))


def extract_sections_sameline(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(
        F.lit("单据\n购 名称："), F.col("b_name"), F.lit(" "), F.col("b_tax_id"), F.lit(" 统一社会信用代码 销 名称："),
        F.col("s_name"), F.lit("\n地址："), F.col("b_address_phone"), F.lit("\n开户行="), F.col("b_bank_account"))
    docs = render.parties(spark, sf).withColumn("full_text", text)
    docs = fields.fill_from_patterns(fields.with_header_fields(docs))
    return _sections(docs)


def extract_sections_columns(spark: SparkSession, sf: str) -> DataFrame:
    def block(text, side):
        return F.struct(text.alias("text"), F.lit(0.0).alias("y"), F.lit(0.0).alias("x"), F.lit(side).alias("side"))

    pairs = zip(render.party_lines("b"), render.party_lines("s"))
    blocks = F.array(*[b for left, right in pairs for b in (block(left, "left"), block(right, "right"))])
    docs = render.parties(spark, sf).withColumn("blocks", blocks).withColumn("full_text", F.lit("购买方 销售方 名称：无"))
    return _sections(layout.with_column_texts(docs))


def _party_select() -> str:
    parts = ["name", "tax_id", "address_phone", "bank_account"]
    return ", ".join([f"b_{p} AS buyer_{p}" for p in parts] + [f"s_{p} AS seller_{p}" for p in parts])


PARTY_SQL = f"WITH {PARTIES} SELECT order_key, {_party_select()} FROM parties"
SAMELINE_SQL = f"""WITH {PARTIES}
SELECT order_key, b_name AS buyer_name, b_tax_id AS buyer_tax_id, b_address_phone AS buyer_address_phone,
       b_bank_account AS buyer_bank_account, s_name AS seller_name, b_tax_id AS seller_tax_id,
       b_address_phone AS seller_address_phone, b_bank_account AS seller_bank_account
FROM parties"""


def taxid_company_asof(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat_ws(
        "\n", F.lit("某某集团"), F.lit("甲乙丙有限公司"), F.lit("杂项1"), F.col("b_tax_id"),
        F.when(F.col("order_key") % 2 == 0, F.lit("  丁戊厂 ")), F.lit("第2行"), F.lit(""),
        F.concat(F.lit("税号 "), F.col("s_tax_id")), F.lit("己庚店"), F.col("b_tax_id"))
    docs = render.parties(spark, sf).withColumn("full_text", text)
    return fields.companies_above_tax_ids(docs, "full_text", "b_tax_id", "s_tax_id").select(
        "order_key", "buyer_name", "seller_name")


def goods_lines_text(spark: SparkSession, sf: str) -> DataFrame:
    """Goods rows of every sheet; in some an empty line right behind the header, or one behind the
    first row, ends the list."""
    sheets, key = render.goods_documents(spark, sf), F.col("order_key") % 10
    gap = F.when(key == 3, F.replace(F.col("full_text"), F.lit("（见清单）"), F.lit("\n（见清单）"))).when(
        key == 7, F.regexp_replace("full_text", "(（见清单）\n[^\n]*\n)", "$1\n"))
    docs = items.goods_from_text(
        sheets.withColumn("full_text", F.coalesce(gap, F.col("full_text"))), out="line_items")
    return items.explode_goods(docs, "number").select(
        "number", F.col("item_no").cast("bigint").alias("item_no"), "goods_name", "amount", "tax_rate", "tax_amount")


GOODS_SQL = f"""WITH {GOODS}
SELECT number, item_no, goods_name, CAST(amount AS VARCHAR) AS amount, tax_rate, CAST(tax_amount AS VARCHAR) AS tax_amount
FROM goods WHERE order_key % 10 <> 3 AND (order_key % 10 <> 7 OR item_no = 1)"""


def goods_precedence(spark: SparkSession, sf: str) -> DataFrame:
    """Tagged lines go before text lines; empty totals follow from the sums of the former or from the
    first of the latter."""
    tagged = F.array(items.goods_item(goods_name=F.lit("tagged"), amount=F.lit("5"), tax_amount=F.lit("1")),
                     items.goods_item(goods_name=F.lit("more"), amount=F.lit("2.5"), tax_amount=F.lit("x")))
    docs = render.goods_documents(spark, sf).withColumns({
        "tag_items": F.when(F.col("order_key") % 3 == 0, tagged), "pretax_amount": F.lit(""), "tax_amount": F.lit("")})
    done = items.with_goods(with_document_columns(docs))
    return done.select(
        "number", F.size("line_items").cast("bigint").alias("n_lines"),
        F.get("line_items", F.lit(0))["goods_name"].alias("first_name"), "pretax_amount", "tax_amount")


PRECEDENCE_SQL = f"""WITH {GOODS}
SELECT number, CASE WHEN order_key % 3 = 0 THEN 2 ELSE count(*) END AS n_lines,
       CASE WHEN order_key % 3 = 0 THEN 'tagged' ELSE arg_min(goods_name, item_no) END AS first_name,
       CASE WHEN order_key % 3 = 0 THEN '7.50' ELSE CAST(arg_min(amount, item_no) AS VARCHAR) END AS pretax_amount,
       CASE WHEN order_key % 3 = 0 THEN '1.00' ELSE CAST(arg_min(tax_amount, item_no) AS VARCHAR) END AS tax_amount
FROM goods GROUP BY number, order_key"""


def goods_lines_blocks(spark: SparkSession, sf: str) -> DataFrame:
    docs = items.goods_from_blocks(render.goods_blocks(spark, sf), out="line_items")
    return items.explode_goods(docs, "number").select(
        "number", F.col("item_no").cast("bigint").alias("item_no"), "goods_name", "amount", "tax_rate", "tax_amount")


GOODS_BLOCKS_SQL = f"""WITH {GOODS}
SELECT number, item_no, goods_name,
       CASE WHEN item_no % 3 = 0 THEN format('{{:,.2f}}', CAST(amount AS DOUBLE)) ELSE CAST(amount AS VARCHAR) END AS amount,
       tax_rate, CAST(tax_amount AS VARCHAR) AS tax_amount
FROM goods"""


def flat_goods_lines(spark: SparkSession, sf: str) -> DataFrame:
    """All goods lines as one document for each nation of suppliers, row by row: lines before the header and behind the
    stop look like goods and are none."""
    goods = render.goods(spark, sf)
    supplier = render.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("nation"))
    place = F.col("order_key") * 1_000_000 + F.col("sheet") * 100 + F.col("item_no")
    line = F.concat_ws("  ", "goods_name", F.col("amount").cast("string"), "tax_rate", F.col("tax_amount").cast("string"))
    body = goods.join(supplier, "supplier").select("nation", place.alias("place"), line.alias("line"))
    around = [(-3, "early 1.00 1% 0.01"), (-2, "项目名称 金额 税率 税额"), (-1, "（见清单）"), (1 << 60, "合 计 1.00 1% 0.01"), ((1 << 60) + 1, "late 1.00 1% 0.01")]
    frame = spark.createDataFrame(around, "place bigint, line string")
    nations = body.select("nation").distinct().join(F.broadcast(frame))
    found = flat.goods_from_lines(body.unionByName(nations), ["nation"], "place", "line")
    return found.select("nation", "place", "goods_name", "amount", "tax_rate", "tax_amount")


FLAT_GOODS_SQL = f"""WITH {GOODS.replace("l_orderkey AS order_key,", "l_orderkey AS order_key, l_suppkey AS supplier,", 1)}
SELECT s_nationkey AS nation, order_key * 1000000 + sheet * 100 + item_no AS place, goods_name, CAST(amount AS VARCHAR) AS amount,
       tax_rate, CAST(tax_amount AS VARCHAR) AS tax_amount
FROM goods JOIN supplier ON supplier = s_suppkey"""


def block_goods_only(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents whose text has a goods header and no goods lines, but whose blocks have them."""
    docs = render.goods_blocks(spark, sf).select(
        "rel_path", "blocks", F.concat(F.lit("发票号码："), "number", F.lit("\n项目名称 金额\n（见块）\n合计\n价税合计：1.00")).alias("full_text"),
        F.lit(fv.SOURCE_TEXT).alias("source"), F.lit(1.0).alias("confidence"))
    done = stored(process_documents(docs), run_folder(spark), "decided")
    return items.explode_goods(done, "invoice_number").select(
        F.col("invoice_number").alias("number"), F.col("item_no").cast("bigint").alias("item_no"), "goods_name", "amount", "tax_rate", "tax_amount")


def three_level_check(spark: SparkSession, sf: str) -> DataFrame:
    """Flat form: stated totals of every order against its goods table."""
    goods = stored(render.goods(spark, sf).select("number", "order_key", "amount", "tax_amount"), run_folder(spark), "goods")
    g = goods.withColumns({c: F.col(c).cast("string") for c in ("amount", "tax_amount")})
    sums = goods.groupBy("number", "order_key").agg(
        F.sum("amount").cast(render.MONEY).alias("a"), F.sum("tax_amount").cast(render.MONEY).alias("t"))
    key = F.col("order_key")

    def off(value, every):
        return (value + F.when(key % every == 0, F.lit("0.02").cast("decimal(4,2)")).when(
            key % every == 1, F.lit("0.01").cast("decimal(4,2)")).otherwise(F.lit(0))).cast(render.MONEY)

    headers = sums.select(
        "number", off(F.col("a"), 7).cast("string").alias("pretax_amount"),
        off(F.col("t"), 5).cast("string").alias("tax_amount"),
        F.when(key % 11 == 0, F.lit("n/a")).otherwise((F.col("a") + F.col("t")).cast(render.MONEY).cast("string")).alias("total_amount"))
    done = checks.check_against_items(headers, g, "number")
    return done.select("number", F.array_join("check_notes", fv.REMARK_SEPARATOR).alias("remarks"))


CHECK_SQL = f"""WITH {GOODS},
h AS (SELECT number, pretax AS a, tax AS t, order_key AS k FROM sheets),
s AS (SELECT *,
   CAST(a + CASE k % 7 WHEN 0 THEN 0.02 WHEN 1 THEN 0.01 ELSE 0 END AS DECIMAL(18,2)) AS p,
   CAST(t + CASE k % 5 WHEN 0 THEN 0.02 WHEN 1 THEN 0.01 ELSE 0 END AS DECIMAL(18,2)) AS x,
   CASE WHEN k % 11 = 0 THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(a + t AS DECIMAL(18,2)) END AS total FROM h)
SELECT number, concat_ws('；',
  CASE WHEN p > 0 AND abs(a - p) > 0.01 THEN '商品金额合计(' || a || ') ≠ 不含税金额(' || p || ')' END,
  CASE WHEN x > 0 AND abs(t - x) > 0.01 THEN '商品税额合计(' || t || ') ≠ 主表税额(' || x || ')' END,
  CASE WHEN p > 0 AND x > 0 AND total > 0 AND abs(p + x - total) > 0.01
       THEN '不含税金额(' || p || ') + 税额(' || x || ') ≠ 价税合计(' || total || ')' END) AS remarks
FROM s"""


def document_remarks(spark: SparkSession, sf: str) -> DataFrame:
    """Rendered goods sheets from text to remarks, all in the document row."""
    done = finish(extract(render.goods_documents(spark, sf)))
    return done.select(
        F.col("number"), "invoice_number", "pretax_amount", "tax_amount", "total_amount",
        F.size("line_items").cast("bigint").alias("n_lines"), "status", "remarks")


REMARKS_SQL = f"""WITH {GOODS}
SELECT number, number AS invoice_number, CAST(pretax AS VARCHAR) AS pretax_amount, CAST(tax AS VARCHAR) AS tax_amount,
       CAST(total AS VARCHAR) AS total_amount, CAST(n_lines AS BIGINT) AS n_lines, 'success' AS status,
       CASE WHEN pretax > 0 AND tax > 0 AND abs(pretax + tax - total) > 0.01
            THEN '不含税金额(' || pretax || ') + 税额(' || tax || ') ≠ 价税合计(' || total || ')' ELSE '' END AS remarks
FROM stated"""


def backfill_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Empty totals of sheets: sums of tagged lines, or the first text line."""
    docs = render.goods_documents(spark, sf).withColumn(
        "full_text", F.element_at(F.split("full_text", "合 计", 2), 1))
    docs = items.goods_from_text(docs).withColumn("tagged", F.col("order_key") % 2 == 0).withColumns({
        "pretax_amount": F.lit(""), "tax_amount": F.when(F.col("order_key") % 3 == 0, "5").otherwise("")})
    amount_sum, tax_sum = items.list_totals(F.col("text_items"))
    docs = items.backfill_from_sums(docs, amount_sum, tax_sum, F.col("tagged"))
    docs = items.backfill_from_first(docs, F.col("text_items"), ~F.col("tagged"))
    return docs.select("number", "pretax_amount", "tax_amount")


BACKFILL_SQL = f"""WITH {GOODS}
SELECT s.number,
  CASE WHEN s.order_key % 2 = 0 THEN CASE WHEN pretax > 0 THEN CAST(pretax AS VARCHAR) ELSE '' END ELSE CAST(g.amount AS VARCHAR) END AS pretax_amount,
  CASE WHEN s.order_key % 3 = 0 THEN '5'
       WHEN s.order_key % 2 = 0 THEN CASE WHEN tax > 0 THEN CAST(tax AS VARCHAR) ELSE '' END ELSE CAST(g.tax_amount AS VARCHAR) END AS tax_amount
FROM sheets s JOIN goods g ON s.number = g.number AND g.item_no = 1"""


def completeness_notes(spark: SparkSession, sf: str) -> DataFrame:
    h = render.order_headers(spark, sf)
    key = F.col("order_key")

    def blank(value, every):
        return F.when(key % every == 0, F.lit("")).otherwise(value.cast("string"))

    docs = h.select(
        "order_key", F.when(key % 4 == 0, fv.SOURCE_TEXT).when(key % 4 == 1, fv.SOURCE_FALLBACK).otherwise(fv.SOURCE_TAGGED).alias("source"),
        blank(F.col("code"), 2).alias("invoice_code"), blank(F.col("number"), 3).alias("invoice_number"),
        blank(F.col("order_date"), 5).alias("invoice_date"), F.col("buyer").alias("buyer_name"),
        blank(F.col("seller"), 7).alias("seller_name"), F.col("total").cast("string").alias("total_amount"),
        blank(F.col("pretax"), 6).alias("pretax_amount"), F.lit(None).cast("string").alias("tax_amount"))
    return docs.select("order_key", F.array_join(checks.completeness_note(), "").alias("note"))


COMPLETENESS_SQL = """
SELECT o_orderkey AS order_key, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'OFD字段不完整: 缺失' || concat_ws(',',
  CASE WHEN o_orderkey % 2 = 0 THEN 'invoice_code' END, CASE WHEN o_orderkey % 3 = 0 THEN 'invoice_number' END,
  CASE WHEN o_orderkey % 5 = 0 THEN 'invoice_date' END, CASE WHEN o_orderkey % 7 = 0 THEN 'seller_name' END,
  CASE WHEN o_orderkey % 6 = 0 THEN 'pretax_amount' END, 'tax_amount') END AS note
FROM orders"""


def goods_json_text(spark: SparkSession, sf: str) -> DataFrame:
    """Goods lists as JSON text and back."""
    docs = items.goods_from_text(render.goods_documents(spark, sf), out="line_items")
    texts = docs.select("number", items.goods_json(F.col("line_items")).alias("line_items_json"))
    back = items.goods_from_json(F.col("line_items_json"))
    return texts.select(
        "number", "line_items_json", F.size(back).cast("bigint").alias("n_lines"),
        F.element_at(back, -1)["goods_name"].alias("last_name"))


GOODS_JSON_SQL = f"""WITH {GOODS}
SELECT number, '[' || string_agg('{{"货物名称":"' || goods_name || '","规格型号":"","单位":"","数量":"","单价":"","金额":"'
         || amount || '","税率":"' || tax_rate || '","税额":"' || tax_amount || '"}}', ',' ORDER BY item_no) || ']' AS line_items_json,
       CAST(count(*) AS BIGINT) AS n_lines, max_by(goods_name, item_no) AS last_name
FROM goods GROUP BY number"""


def scalar_helpers(spark: SparkSession, sf: str) -> DataFrame:
    """Tolerant numbers, durations, boundaries and polygon centres of line items."""
    l = render.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice")
    key, q, price = F.col("l_partkey"), F.col("l_quantity"), F.col("l_extendedprice")
    text = F.when(key % 5 == 0, "").when(key % 5 == 1, "n/a").otherwise(render.money(price).cast("string"))
    x, y = tags.boundary_xy(F.concat_ws(" ", q.cast("string"), F.when(key % 3 == 0, "bad").otherwise(price.cast("string")), F.lit("1 1")))
    corners = F.array(*[F.array(q + dx, price + dy) for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1))])
    cx, cy = layout.polygon_centre(F.when(key % 4 != 0, corners))
    return l.select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice",
        normalize.number(text).cast("double").alias("amount"), normalize.duration_text(price).alias("duration"),
        x.alias("x"), y.alias("y"), F.round(cx, 4).alias("centre_x"), F.round(cy, 4).alias("centre_y"))


SCALARS_SQL = """
SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice,
  CASE l_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) END AS amount,
  lpad(CAST(CAST(floor(floor(l_extendedprice) / 3600) AS BIGINT) AS VARCHAR), 2, '0') || ':' ||
  lpad(CAST(CAST(floor((floor(l_extendedprice) % 3600) / 60) AS BIGINT) AS VARCHAR), 2, '0') || ':' ||
  lpad(CAST(CAST(floor(l_extendedprice) % 60 AS BIGINT) AS VARCHAR), 2, '0') AS duration,
  l_quantity AS x, CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_extendedprice END AS y,
  CASE WHEN l_partkey % 4 = 0 THEN 0 ELSE l_quantity END AS centre_x,
  CASE WHEN l_partkey % 4 = 0 THEN 0 ELSE round(l_extendedprice, 4) END AS centre_y
FROM lineitem"""


ENTRIES = {
    "scalar_helpers": (scalar_helpers, SCALARS_SQL),
    "normalize_date": (normalize_date, """
        SELECT o_orderkey, CASE WHEN o_orderkey % 23 = 0 THEN strftime(o_orderdate, '%d-%m-%Y')
               ELSE strftime(o_orderdate, '%Y-%m-%d') END AS invoice_date FROM orders"""),
    "normalize_amount": (normalize_amount, """
        SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN '-' ELSE '' END || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount FROM orders"""),
    "normalize_code_width": (normalize_code_width, """
        SELECT o_orderkey, 'CAa' || lpad(CAST(o_orderkey AS VARCHAR), 20, '0') AS code, lpad(CAST(o_orderkey AS VARCHAR), 20, '0') AS check_code FROM orders"""),
    "extract_core_fields": (extract_core_fields, CORE_SQL),
    "pattern_variants": (pattern_variants, _variants_sql()),
    "extract_sections_stacked": (extract_sections_stacked, PARTY_SQL),
    "extract_sections_sameline": (extract_sections_sameline, SAMELINE_SQL),
    "extract_sections_columns": (extract_sections_columns, PARTY_SQL),
    "taxid_company_asof": (taxid_company_asof, """
        SELECT o_orderkey AS order_key, '甲乙丙有限公司' AS buyer_name,
               CASE WHEN o_orderkey % 2 = 0 THEN '丁戊厂' ELSE '某某集团' END AS seller_name
        FROM orders JOIN customer ON o_custkey = c_custkey"""),
    "goods_lines_text": (goods_lines_text, GOODS_SQL),
    "flat_goods_lines": (flat_goods_lines, FLAT_GOODS_SQL),
    "block_goods_only": (block_goods_only, GOODS_BLOCKS_SQL),
    "goods_lines_blocks": (goods_lines_blocks, GOODS_BLOCKS_SQL),
    "goods_precedence": (goods_precedence, PRECEDENCE_SQL),
    "three_level_check": (three_level_check, CHECK_SQL),
    "document_remarks": (document_remarks, REMARKS_SQL),
    "backfill_totals": (backfill_totals, BACKFILL_SQL),
    "completeness_notes": (completeness_notes, COMPLETENESS_SQL),
    "goods_json_text": (goods_json_text, GOODS_JSON_SQL),
}
