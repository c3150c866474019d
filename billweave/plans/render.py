"""Documents rendered from the driver tables, so that extraction can be checked
against the tables themselves.

Everything is derived inside Spark from whole tables. A rendered document holds
at most ``SHEET_ROWS`` goods lines; longer orders continue on further sheets.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from billweave import fixed_values as fv
from billweave.operators.spread import ordinal_by_size
from billweave.schemas import TAG_ENTRY

SHEET_ROWS = 40
WORDS_PER_PAGE = 400
WORDS_PER_LINE = 8

MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt over the shuffle partitions by a key, before texts are made of them: a table
    stored as one row group is one task to scan, whatever its split size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def padded(value: Column, width: int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def money(value: Column) -> Column:
    return value.cast(MONEY)


def wide_digits(value: Column) -> Column:
    return F.translate(value, "0123456789", "０１２３４５６７８９")


def date_in_style(moment: Column, style: Column) -> Column:
    formats = ["yyyy年MM月dd日", "yyyy年M月d日", "yyyy/MM/dd", "yyyy-M-d", "yyyyMMdd"]
    result = F.date_format(moment, formats[-1])
    for i, fmt in enumerate(formats[:-1]):
        result = F.when(style == i, F.date_format(moment, fmt)).otherwise(result)
    return result


def order_headers(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """One row per order, of the given orders or all, with the truth of its header fields.

    Every 13th order repeats the number of the one before; every 11th has no
    number; every 17th has no total.
    """
    key = F.col("o_orderkey")
    base = F.when((key % 13 == 0) & (key > 0), key - 1).otherwise(key)
    total = money(F.col("o_totalprice"))
    if orders is None:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        .transform(dealt, "o_orderkey")
        .withColumn("_pretax", (total * F.lit("0.87").cast("decimal(3,2)")).cast(MONEY))
        .select(
            key.alias("order_key"),
            F.concat(F.lit("orders/"), padded(key, 12), F.when(key % 5 == 0, ".ofd").otherwise(".pdf")).alias("rel_path"),
            F.concat(F.lit("11"), padded(base % 1000, 10)).alias("code"),
            padded(base, 20).alias("number"),
            F.col("o_orderdate").alias("order_date"),
            F.concat(F.translate(F.coalesce("c_name", F.lit("Nobody")), "#", "号"), F.lit("有限公司")).alias("buyer"),
            F.concat(F.lit("卖家"), (key % 97).cast("string"), F.lit("集团")).alias("seller"),
            F.col("_pretax").alias("pretax"),
            (total - F.col("_pretax")).cast(MONEY).alias("tax"),
            total.alias("total"),
            *[c for c in orders.columns if not c.startswith("o_")],
        )
    )


def header_documents(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Order headers as text documents with labels and values in mixed layout."""
    df = order_headers(spark, sf_dir, orders)
    key = F.col("order_key")
    number = F.when(key % 7 == 0, wide_digits(F.col("number"))).otherwise(F.col("number"))
    check = F.regexp_replace(F.col("number"), "(.{4})", "$1 ")
    text = F.concat_ws(
        "\n",
        F.lit("增值税电子普通发票"),
        F.lit("发票代码："), F.col("code"),
        F.when(key % 11 != 0, F.concat(F.lit("发票号码： \n\n  "), number)),
        F.concat(F.lit("开票日期："), date_in_style(F.col("order_date"), key % 5)),
        F.concat(F.lit("校验码："), check),
        F.concat(F.lit("购 名称："), F.col("buyer"), F.lit("  销 名称："), F.col("seller")),
        F.concat(F.lit("合 计 ¥"), F.col("pretax").cast("string"), F.lit(" ¥"), F.col("tax").cast("string")),
        F.when(key % 17 != 0, F.concat(
            F.lit("价税合计（小写）￥"), F.format_number("total", 2))).otherwise(F.lit("以下空白")),
    )
    return df.withColumns({
        "full_text": text,
        "source": F.lit(fv.SOURCE_TEXT),
        "confidence": F.lit(1.0) - (key % 4).cast("double") / 10,
        "file_type": F.when(key % 5 == 0, "ofd").otherwise("pdf"),
        "modification_time": F.col("order_date"),
    })


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as files that are no invoices."""
    pages = table(spark, sf_dir, "pages").select("page_id")
    return pages.select(
        F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("rel_path"),
        F.lit(fv.UNSUPPORTED).alias("file_type"), F.lit("2024-01-02 03:04:05").cast("timestamp").alias("modification_time"))


def goods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as goods rows with their place: sheet of the order and line."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax",
        F.floor(F.col("l_partkey") / 1000).alias("_part_range"))
    numbered = ordinal_by_size(
        lines, ["l_orderkey"], ["l_linenumber", "_part_range"],
        ["l_partkey", "l_suppkey", "l_extendedprice", "l_tax", "l_quantity", "l_discount"])
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    amount = money(F.col("l_extendedprice"))
    rate = F.col("l_tax").cast("decimal(4,2)")
    sheet = F.floor(F.col("ordinal") / SHEET_ROWS).cast("bigint")
    return (
        numbered.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        .select(
            F.col("l_orderkey").alias("order_key"), sheet.alias("sheet"), F.col("l_suppkey").alias("supplier"),
            (F.col("ordinal") % SHEET_ROWS + 1).cast("bigint").alias("item_no"),
            F.concat(padded(F.col("l_orderkey"), 14), padded(sheet, 6)).alias("number"),
            F.concat(F.replace(F.coalesce("p_name", F.lit("part")), F.lit(" "), F.lit("-")),
                     F.lit("#"), F.col("l_partkey").cast("string")).alias("goods_name"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
            amount.alias("amount"),
            F.concat((rate * 100).cast("bigint").cast("string"), F.lit("%")).alias("tax_rate"),
            (amount * rate).cast(MONEY).alias("tax_amount"),
        )
        .withColumn("rel_path", F.concat(F.lit("sheets/"), F.col("number"), F.lit(".pdf")))
    )


def goods_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text document per order sheet. Every 7th order states a total that is
    a unit too high."""
    row = F.when(
        F.col("item_no") % 2 == 0,
        F.concat_ws(" ", "goods_name", F.col("amount").cast("string"), "tax_rate", F.col("tax_amount").cast("string")),
    ).otherwise(F.concat_ws(
        "  ", "goods_name", F.lit("S1"), F.lit("件"), F.col("quantity").cast("string"), F.lit("1.00"),
        F.col("amount").cast("string"), "tax_rate", F.col("tax_amount").cast("string")))
    sheets = goods(spark, sf_dir).groupBy("order_key", "sheet", "number", "rel_path").agg(
        F.sort_array(F.collect_list(F.struct("item_no", row.alias("row")))).alias("_rows"),
        F.sum("amount").cast(MONEY).alias("pretax"),
        F.sum("tax_amount").cast(MONEY).alias("tax"),
    )
    stated = (F.col("pretax") + F.col("tax") + F.when(F.col("order_key") % 7 == 0, 1).otherwise(0)).cast(MONEY)
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("发票号码："), F.col("number")),
        F.lit("项目名称 规格型号 单位 数量 单价 金额 税率 税额"),
        F.lit("（见清单）"),
        F.array_join("_rows.row", "\n"),
        F.concat(F.lit("合 计 ¥"), F.col("pretax").cast("string"), F.lit(" ¥"), F.col("tax").cast("string")),
        F.concat(F.lit("价税合计（小写）¥"), stated.cast("string")),
    )
    return sheets.select(
        "order_key", "sheet", "number", "rel_path", "pretax", "tax", stated.alias("total"),
        text.alias("full_text"), F.lit(fv.SOURCE_TEXT).alias("source"), F.lit(1.0).alias("confidence"))


PARTY_TEXT = {
    "name": "名称：", "tax_id": "纳税人识别号：", "address_phone": "地址电话：", "bank_account": "开户行及账号：",
}


def parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both parties of every order: the customer and a supplier by key."""
    headers = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    df = headers.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    return dealt(df, "o_orderkey").select(
        key.alias("order_key"),
        F.concat(F.lit("parties/"), padded(key, 12), F.lit(".pdf")).alias("rel_path"),
        F.concat(F.translate("c_name", "#", "号"), F.lit("有限公司")).alias("b_name"),
        F.concat(F.lit("92"), padded(F.col("c_custkey"), 16)).alias("b_tax_id"),
        F.concat(F.lit("Road"), F.col("c_nationkey").cast("string")).alias("b_address_phone"),
        F.concat(F.lit("BankB"), F.col("c_custkey").cast("string")).alias("b_bank_account"),
        F.concat(F.lit("卖家"), (key % 97).cast("string"), F.lit("集团")).alias("s_name"),
        F.concat(F.lit("91"), padded(key, 16)).alias("s_tax_id"),
        F.concat(F.lit("Street"), (key % 31).cast("string")).alias("s_address_phone"),
        F.concat(F.lit("BankS"), key.cast("string")).alias("s_bank_account"),
    )


def party_lines(prefix: str, glue: str = "") -> list[Column]:
    return [F.concat(F.lit(label + glue), F.col(f"{prefix}_{part}")) for part, label in PARTY_TEXT.items()]


def word_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every document as a positioned span: 8 words to a line, 400
    to a page, lines 12 units apart with a jitter of up to 2."""
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    words = F.filter(F.split("text", "[ \\n\\t\\r]+"), lambda w: w != "")
    spans = docs.select("doc_id", F.posexplode_outer(words).alias("i", "text")).filter(F.col("i").isNotNull())
    i = F.col("i")
    slot = i % WORDS_PER_LINE
    line = F.floor(i % WORDS_PER_PAGE / WORDS_PER_LINE)
    return spans.select(
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("rel_path"),
        F.floor(i / WORDS_PER_PAGE).cast("int").alias("page"),
        i.alias("seq"),
        (slot * 60).cast("double").alias("x"),
        (line * 12 + slot % 3).cast("double").alias("y"),
        "text")


def recognised_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same words as recognised blocks with a polygon and a score."""
    spans = word_spans(spark, sf_dir)
    x, y = F.col("x"), F.col("y")

    def point(dx: float, dy: float) -> Column:
        return F.array(x + F.lit(dx), y * 2 + F.lit(dy))

    corners = [(-2.0, -1.0), (2.0, -1.0), (2.0, 1.0), (-2.0, 1.0)]
    as_points = F.array(*[point(dx, dy) for dx, dy in corners])
    return spans.select(
        "rel_path", "page", "seq", "text",
        ((F.col("seq") % 5).cast("double") / 8 + 0.5).alias("confidence"),
        F.when(F.col("seq") % 2 == 0, as_points).otherwise(F.array(F.flatten(as_points))).alias("bbox"))


def goods_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goods sheets as ordered, sided blocks: name left, figures right, one
    20-unit band per line, amounts with separators every third line."""
    g = goods(spark, sf_dir)
    y = (F.col("item_no") * 20 + 40).cast("double")
    amount = F.when(F.col("item_no") % 3 == 0, F.format_number("amount", 2)).otherwise(
        F.col("amount").cast("string"))

    def block(order: int, text: Column, x: float, side: str) -> Column:
        return F.struct(
            (F.col("item_no") * 10 + order).alias("n"), text.alias("text"),
            (y + F.lit(float(order))).alias("y"), F.lit(x).alias("x"), F.lit(side).alias("side"))

    blocks = F.array(
        block(0, F.col("goods_name"), 10.0, "left"),
        block(1, amount, 300.0, "right"),
        block(2, F.col("tax_rate"), 350.0, "right"),
        block(3, F.col("tax_amount").cast("string"), 400.0, "right"))
    per_sheet = g.groupBy("order_key", "sheet", "number", "rel_path").agg(
        F.sort_array(F.flatten(F.collect_list(blocks))).alias("_b"))

    def fixed(text: str, y_at: float, side: str) -> Column:
        return F.struct(F.lit(text).alias("text"), F.lit(y_at).alias("y"), F.lit(10.0).alias("x"), F.lit(side).alias("side"))

    body = F.transform(F.col("_b"), lambda b: F.struct(b["text"], b["y"], b["x"], b["side"]))
    head = F.array(fixed("项目名称", 20.0, "left"), fixed("金额", 20.0, "right"), fixed("税率/征收率", 20.0, "right"))
    tail = F.array(fixed("合计", 2000.0, "left"), fixed("¥1.00", 2000.0, "right"), fixed("999", 2020.0, "right"))
    return per_sheet.select(
        "order_key", "sheet", "number", "rel_path",
        F.concat(head, body, tail).alias("blocks"))


# ---- tagged archives -------------------------------------------------------

TAG_ENTRY_NAME = "Doc_0/Tags/CustomTag.xml"
CONTENT_NAME = "Doc_0/Pages/Page_0/Content.xml"


def _node(entry: str, entry_no: int, node_no: Column, parent_no: Column, parent_tag, tag: str,
          text: Column, attrs: Column | None = None, owners: Column | None = None,
          ref_no: Column | None = None, filled_no: Column | None = None) -> Column:
    return F.struct(
        F.lit(entry).alias("entry"), F.lit(entry_no).alias("entry_no"),
        node_no.cast("int").alias("node_no"), parent_no.cast("int").alias("parent_no"),
        (F.lit(parent_tag) if isinstance(parent_tag, str) else parent_tag).alias("parent_tag"),
        F.lit(fv.OFD_NAMESPACE).alias("ns"), F.lit(tag).alias("tag"),
        (F.lit(None) if attrs is None else attrs).cast("map<string,string>").alias("attrs"),
        text.cast("string").alias("text"),
        (F.array() if owners is None else owners).cast("array<int>").alias("owners"),
        (F.lit(None) if ref_no is None else ref_no).cast("int").alias("ref_no"),
        (F.lit(None) if filled_no is None else filled_no).cast("int").alias("filled_no"))


def _entry(entry: str, entry_no: int) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(entry).alias("entry"), F.lit(entry_no).alias("entry_no"),
        none.cast("int").alias("node_no"), none.cast("int").alias("parent_no"),
        none.cast("string").alias("parent_tag"), none.cast("string").alias("ns"),
        F.lit(TAG_ENTRY).alias("tag"), none.cast("map<string,string>").alias("attrs"),
        none.cast("string").alias("text"), none.cast("array<int>").alias("owners"),
        none.cast("int").alias("ref_no"), none.cast("int").alias("filled_no"))


def _cell(at: Column, object_id: Column, text: Column, x: Column, y: Column,
          tag: str | None = None, reference_at: Column | None = None, ref_no: Column | None = None,
          filled_no: Column | None = None) -> Column:
    """What one value needs: a text object and, with a tag, a reference to it with its place."""
    return F.struct(
        at.cast("int").alias("at"), object_id.alias("object_id"), text.alias("text"),
        x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(tag).cast("string").alias("tag"),
        (F.lit(None) if reference_at is None else reference_at).cast("int").alias("reference_at"),
        (F.lit(None) if ref_no is None else ref_no).cast("int").alias("ref_no"),
        (F.lit(None) if filled_no is None else filled_no).cast("int").alias("filled_no"))


def _cell_nodes(cells: DataFrame) -> DataFrame:
    """Elements of ``rel_path, cell`` rows: object, its text in two codes, reference."""
    c = cells.select("rel_path", "cell.*")
    at, text = F.col("at"), F.col("text")
    attrs = F.create_map(
        F.lit("ID"), F.col("object_id"), F.lit("Boundary"),
        F.concat_ws(" ", F.col("x").cast("string"), F.col("y").cast("string"), F.lit("10"), F.lit("5")))
    half = F.floor(F.char_length(text) / 2).cast("int")
    codes = [F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.char_length(text))]
    owned = F.array(at)
    nodes = [
        F.when(text.isNotNull(), _node(
            CONTENT_NAME, 2, at, F.lit(0), "Layer", "TextObject", F.lit(None), attrs)),
        *[F.when(text.isNotNull(), _node(
            CONTENT_NAME, 2, at + i, at, "TextObject", "TextCode", code, None, owned)) for i, code in enumerate(codes, 1)],
        F.when(F.col("tag").isNotNull(), _node(
            TAG_ENTRY_NAME, 1, F.col("reference_at"), F.col("reference_at") - 1, F.col("tag"), "ObjectRef",
            F.col("object_id"), None, None, F.col("ref_no"), F.col("filled_no"))),
    ]
    rows = c.select("rel_path", F.explode_outer(F.array(*nodes)).alias("n"))
    return rows.filter(F.col("n").isNotNull()).select("rel_path", "n.*")


def goods_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goods sheets as XML elements: four reference lists and the text objects.
    An empty name reference precedes every real one."""
    g = goods(spark, sf_dir)
    n = F.col("item_no").cast("int")
    values = {"Item": F.col("goods_name"), "TaxScheme": F.col("tax_rate"),
              "Amount": F.col("amount").cast("string"), "TaxAmount": F.col("tax_amount").cast("string")}
    no_text = F.lit(None).cast("string")
    cells = [_cell(n * 40, F.lit(""), no_text, F.lit(0), F.lit(0), "Item", n * 40 + 4, n * 2 - 2)]
    for i, (tag, value) in enumerate(values.items()):
        at = n * 40 + i * 10
        cells.append(_cell(at, F.concat(F.lit(f"{i}-"), n.cast("string")), value, F.lit(10.0 * i), n * 10.0, tag, at + 5,
                           n * 2 - 1 if tag == "Item" else n - 1, n - 1))
    rows = _cell_nodes(g.select("rel_path", F.explode_outer(F.array(*cells)).alias("cell")))
    heads = g.filter(n == 1).select(
        "rel_path", F.explode_outer(F.array(
            _entry("OFD.xml", 0), _entry(TAG_ENTRY_NAME, 1), _entry(CONTENT_NAME, 2),
            _entry("Doc_0/other/CustomTag.xml", 3), _entry("Doc_0/Res/image_1.PNG", 4))).alias("n")
    ).select("rel_path", "n.*")
    return rows.unionByName(heads)


def header_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order headers as XML elements. Orders with key % 3 = 1 have no tags but
    named data in the root entry; those with key % 3 = 2 and % 4 = 1 have only an
    image. Object ids of the code repeat with an older text first."""
    df = order_headers(spark, sf_dir)
    key = F.col("order_key")
    date = date_in_style(F.col("order_date"), key % 5)
    values = [
        ("InvoiceNo", F.col("number")), ("IssueDate", date), ("InvoiceCode", F.col("code")),
        ("BuyerName", F.col("buyer")), ("SellerName", F.col("seller")),
        ("TaxExclusiveTotalAmount", F.col("pretax").cast("string")),
        ("TaxTotalAmount", F.col("tax").cast("string")),
        ("TaxInclusiveTotalAmount", F.format_number("total", 2)),
    ]
    cells = [_cell(F.lit(50), F.lit("6902"), F.lit("OLD"), F.lit(1), F.lit(1))]
    for i, (tag, value) in enumerate(values):
        at, y = F.lit(100 + i * 10), F.lit(10.0 + 3 * i)
        if tag.endswith("Amount"):
            cells.append(_cell(at + 5, F.lit(str(7900 + i)), F.lit("¥"), F.lit(5), y, tag, at, F.lit(0), F.lit(0)))
        cells.append(_cell(at, F.lit(str(6900 + i)), value, F.lit(20), y, tag, at + 2,
                           *[F.lit(int(tag.endswith("Amount")))] * 2))
    cells.append(_cell(F.lit(500), F.lit("8001"), F.lit("增值税专用发票"), F.lit(1), F.lit(90)))
    cells.append(_cell(F.lit(510), F.lit("8002"), F.lit("叁佰圆整"), F.lit(1), F.lit(95)))

    def data(at: int, name: str, value: Column) -> Column:
        return _node("OFD.xml", 0, F.lit(at), F.lit(0), "CustomDatas", "CustomData", value,
                     F.create_map(F.lit("Name"), F.lit(name)))

    named = [data(9, "发票号码", F.lit("0")), data(10, "发票号码", F.col("number")), data(11, "开票日期", date),
             data(12, "合计金额", F.col("pretax").cast("string")), data(13, "价税合计", F.col("total").cast("string")),
             data(14, "其他", F.lit("x"))]
    entries = [_entry("OFD.xml", 0), _entry(TAG_ENTRY_NAME, 1), _entry(CONTENT_NAME, 2), _entry("Doc_0/Res/a.Jpg", 3),
               _entry("Doc_0/Res/b.png", 4)]
    nothing = (key % 3 == 2) & (key % 4 == 1)
    tagged = df.filter(~nothing & (key % 3 != 1)).select("rel_path", F.explode_outer(F.array(*cells)).alias("cell"))
    plain = df.select(
        "rel_path", F.explode_outer(F.when(nothing, F.array(*entries)).otherwise(F.array(*entries, *named))).alias("n")
    ).select("rel_path", "n.*")
    return _cell_nodes(tagged).unionByName(plain)


@F.pandas_udf(BinaryType())
def zipped(root_xml: pd.Series, tag_xml: pd.Series, content_xml: pd.Series) -> pd.Series:
    """Archive bytes of three XML texts; a null text leaves its entry out."""
    def one(texts: tuple) -> bytes:
        blob = io.BytesIO()
        with zipfile.ZipFile(blob, "w") as archive:
            for name, text in zip(("OFD.xml", TAG_ENTRY_NAME, CONTENT_NAME), texts):
                if text is not None:
                    archive.writestr(name, text)
        return blob.getvalue()

    return pd.Series([one(t) for t in zip(root_xml, tag_xml, content_xml)])


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order headers as archive bytes, ``rel_path, content``. Orders with key % 9
    = 4 are no ZIP, those with key % 9 = 5 have a broken tag entry."""
    df = order_headers(spark, sf_dir)
    key = F.col("order_key")
    cells = [("InvoiceNo", F.col("number")), ("InvoiceCode", F.col("code")), ("BuyerName", F.col("buyer")),
             ("IssueDate", date_in_style(F.col("order_date"), key % 5))]

    def doc(root: str, body: Column) -> Column:
        open_tag = f'<?xml version="1.0" encoding="UTF-8"?><ofd:{root} xmlns:ofd="{fv.OFD_NAMESPACE}">'
        return F.concat(F.lit(open_tag), body, F.lit(f"</ofd:{root}>"))

    total = F.col("total").cast("string")
    refs = [F.lit(f"<ofd:{tag}><ofd:ObjectRef PageRef=\"1\">{i}</ofd:ObjectRef></ofd:{tag}>")
            for i, (tag, _) in enumerate(cells, 1)]
    refs.append(F.lit("<ofd:TaxInclusiveTotalAmount><ofd:ObjectRef>90</ofd:ObjectRef>"
                      "<ofd:ObjectRef>91</ofd:ObjectRef></ofd:TaxInclusiveTotalAmount>"))
    objects = [
        F.concat(F.lit(f'<ofd:TextObject ID="{i}" Boundary="10 {i * 5} 40 4"><ofd:TextCode X="0">'),
                 value, F.lit("</ofd:TextCode></ofd:TextObject>"))
        for i, value in [*enumerate([v for _, v in cells], 1), (90, F.lit("¥")), (91, total)]]
    broken = F.when(key % 9 == 5, F.lit("<ofd:broken>")).otherwise(F.lit(""))
    root = doc("OFD", F.concat(F.lit('<ofd:CustomData Name="发票号码">'), F.col("number"), F.lit("</ofd:CustomData>")))
    content = zipped(
        root, doc("CustomTags", F.concat(broken, *refs)), doc("Page", F.concat(F.lit("<ofd:Layer>"), *objects, F.lit("</ofd:Layer>"))))
    return df.select(
        "order_key", "rel_path",
        F.when(key % 9 == 4, F.encode(F.lit("not an archive"), "UTF-8")).otherwise(content).alias("content"))
