"""Shared pieces of the check SQL: the truth behind the rendered documents."""

ORDER_HEADERS = """
base AS (
  SELECT o.*, CASE WHEN o_orderkey % 13 = 0 AND o_orderkey > 0 THEN o_orderkey - 1 ELSE o_orderkey END AS bk
  FROM orders o),
headers AS (
  SELECT o_orderkey AS order_key,
         'orders/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')
           || CASE WHEN o_orderkey % 5 = 0 THEN '.ofd' ELSE '.pdf' END AS rel_path,
         '11' || lpad(CAST(bk % 1000 AS VARCHAR), 10, '0') AS code,
         lpad(CAST(bk AS VARCHAR), 20, '0') AS number,
         o_orderdate AS order_date,
         replace(coalesce(c_name, 'Nobody'), '#', '号') || '有限公司' AS buyer,
         '卖家' || CAST(o_orderkey % 97 AS VARCHAR) || '集团' AS seller,
         CAST(o_totalprice AS DECIMAL(18,2)) AS total,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.87 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS pretax
  FROM base LEFT JOIN customer ON o_custkey = c_custkey)
"""

GOODS = """
numbered AS (
  SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
           l_extendedprice, l_tax, l_quantity, l_discount) - 1 AS ord
  FROM lineitem l),
goods AS (
  SELECT l_orderkey AS order_key, CAST(ord // 40 AS BIGINT) AS sheet, CAST(ord % 40 + 1 AS BIGINT) AS item_no,
         lpad(CAST(l_orderkey AS VARCHAR), 14, '0') || lpad(CAST(ord // 40 AS VARCHAR), 6, '0') AS number,
         replace(coalesce(p_name, 'part'), ' ', '-') || '#' || CAST(l_partkey AS VARCHAR) AS goods_name,
         CAST(l_quantity AS BIGINT) AS quantity,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
         CAST(CAST(CAST(l_tax AS DECIMAL(4,2)) * 100 AS BIGINT) AS VARCHAR) || '%' AS tax_rate,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS tax_amount
  FROM numbered LEFT JOIN part ON l_partkey = p_partkey),
sheets AS (
  SELECT order_key, sheet, number, 'sheets/' || number || '.pdf' AS rel_path,
         CAST(sum(amount) AS DECIMAL(18,2)) AS pretax, CAST(sum(tax_amount) AS DECIMAL(18,2)) AS tax,
         count(*) AS n_lines
  FROM goods GROUP BY ALL),
stated AS (
  SELECT *, CAST(pretax + tax + CASE WHEN order_key % 7 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS total
  FROM sheets)
"""

PARTIES = """
parties AS (
  SELECT o_orderkey AS order_key, 'parties/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || '.pdf' AS rel_path,
         replace(c_name, '#', '号') || '有限公司' AS b_name,
         '92' || lpad(CAST(c_custkey AS VARCHAR), 16, '0') AS b_tax_id,
         'Road' || CAST(c_nationkey AS VARCHAR) AS b_address_phone,
         'BankB' || CAST(c_custkey AS VARCHAR) AS b_bank_account,
         '卖家' || CAST(o_orderkey % 97 AS VARCHAR) || '集团' AS s_name,
         '91' || lpad(CAST(o_orderkey AS VARCHAR), 16, '0') AS s_tax_id,
         'Street' || CAST(o_orderkey % 31 AS VARCHAR) AS s_address_phone,
         'BankS' || CAST(o_orderkey AS VARCHAR) AS s_bank_account
  FROM orders JOIN customer ON o_custkey = c_custkey)
"""

WORDS = """
words AS (
  SELECT doc_id, [w FOR w IN string_split_regex(text, '[ \\n\\t\\r]+') IF w <> ''] AS ws FROM documents),
spans AS (
  SELECT 'docs/' || CAST(doc_id AS VARCHAR) || '.pdf' AS rel_path, i - 1 AS i, ws[i] AS text
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM words)),
placed AS (
  SELECT rel_path, i AS seq, i // 400 AS page, text, (i % 400) // 8 AS line, i % 8 AS slot,
         CAST((i % 8) * 60 AS DOUBLE) AS x, CAST(((i % 400) // 8) * 12 + (i % 8) % 3 AS DOUBLE) AS y
  FROM spans)
"""

# outcome of the rendered order headers
OUTCOMES = """
decided AS (
  SELECT *, CAST(total - pretax AS DECIMAL(18,2)) AS tax,
         CASE WHEN order_key % 5 = 0 THEN 'ofd' ELSE 'pdf' END AS file_type,
         order_key % 11 <> 0 AS has_invoice
  FROM headers),
marked AS (
  SELECT *, has_invoice AND row_number() OVER (
           PARTITION BY has_invoice, code, number ORDER BY file_type <> 'ofd', rel_path) > 1 AS is_dedup
  FROM decided),
results AS (
  SELECT *, CASE WHEN NOT has_invoice THEN 'failed' WHEN is_dedup THEN 'skipped' ELSE 'success' END AS status
  FROM marked)
"""

# the date of an order in one of five styles
DATE_SQL = """CASE order_key % 5 WHEN 0 THEN strftime(order_date, '%Y年%m月%d日') WHEN 1 THEN strftime(order_date, '%Y年%-m月%-d日')
  WHEN 2 THEN strftime(order_date, '%Y/%m/%d') WHEN 3 THEN strftime(order_date, '%Y-%-m-%-d') ELSE strftime(order_date, '%Y%m%d') END"""

# the text of a rendered order header
HEADER_TEXT = f"""
texts AS (
  SELECT *, concat_ws(chr(10), '增值税电子普通发票', '发票代码：', code,
    CASE WHEN order_key % 11 <> 0 THEN '发票号码： ' || chr(10) || chr(10) || '  '
      || CASE WHEN order_key % 7 = 0 THEN translate(number, '0123456789', '０１２３４５６７８９') ELSE number END END,
    '开票日期：' || {DATE_SQL}, '校验码：' || regexp_replace(number, '(.{{4}})', '\\1 ', 'g'),
    '购 名称：' || buyer || '  销 名称：' || seller,
    '合 计 ¥' || CAST(pretax AS VARCHAR) || ' ¥' || CAST(CAST(total - pretax AS DECIMAL(18,2)) AS VARCHAR),
    CASE WHEN order_key % 17 <> 0 THEN '价税合计（小写）￥' || format('{{:,.2f}}', CAST(total AS DOUBLE)) ELSE '以下空白' END) AS full_text
  FROM headers)
"""
