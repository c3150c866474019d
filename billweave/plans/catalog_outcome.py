"""Checked queries: files, outcomes, duplicates, statistics, outputs, assistance, jobs."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from billweave import fixed_values as fv
from billweave.operators import assist, outcome, stats
from billweave.plans import render
from billweave.plans.catalog_sql import GOODS, HEADER_TEXT, ORDER_HEADERS, OUTCOMES
from billweave.plans.folder_run import extract, finish, process_documents
from billweave.plans.storage import keep_in, remove, run_folder, stored
from billweave.sources import file_source, files, sinks
from billweave.streaming import ingest, keyed

# ---- files ----------------------------------------------------------------

NAMES = [("", ".ofd"), ("", ".PDF"), ("", ".jpg"), ("", ".b.JPEG"), ("", ".png"), ("", ".txt"), (".pdf", "")]


def classify_route(spark: SparkSession, sf: str) -> DataFrame:
    docs = render.table(spark, sf, "documents").select("doc_id", "source")
    key = F.col("doc_id")
    names = [F.concat(F.lit(before), key.cast("string"), F.lit(after)) for before, after in NAMES]
    folder = F.when(key % 10 == 0, F.concat("source", F.lit("/__pycache__"))).otherwise(F.col("source"))
    listed = docs.select(
        "doc_id", F.concat(folder, F.lit("/"), F.get(F.array(*names), (key % 7).cast("int"))).alias("rel_path"))
    kept = listed.filter(~files.in_skipped_directory(F.col("rel_path"), fv.SKIP_DIRECTORIES))
    return files.classify(kept).select("doc_id", "rel_path", "ext", "file_type", "route")


CLASSIFY_SQL = """
WITH n AS (SELECT doc_id, source || '/' || CASE doc_id % 7 WHEN 0 THEN doc_id || '.ofd' WHEN 1 THEN doc_id || '.PDF' WHEN 2 THEN doc_id || '.jpg'
    WHEN 3 THEN doc_id || '.b.JPEG' WHEN 4 THEN doc_id || '.png' WHEN 5 THEN doc_id || '.txt' ELSE '.pdf' || doc_id END AS rel_path
  FROM documents WHERE doc_id % 10 <> 0)
SELECT doc_id, rel_path,
  CASE doc_id % 7 WHEN 0 THEN '.ofd' WHEN 1 THEN '.pdf' WHEN 2 THEN '.jpg' WHEN 3 THEN '.jpeg' WHEN 4 THEN '.png' WHEN 5 THEN '.txt' ELSE '' END AS ext,
  CASE doc_id % 7 WHEN 0 THEN 'ofd' WHEN 1 THEN 'pdf' WHEN 2 THEN 'jpg' WHEN 3 THEN 'jpeg' WHEN 4 THEN 'png' ELSE 'unsupported' END AS file_type,
  CASE doc_id % 7 WHEN 0 THEN 'ofd' WHEN 1 THEN 'ocr' WHEN 2 THEN 'ocr' WHEN 3 THEN 'ocr' WHEN 4 THEN 'ocr' ELSE 'unsupported' END AS route
FROM n"""


def scan_documents(spark: SparkSession, sf: str) -> DataFrame:
    """All documents written as text files, one folder for each source, and listed again: bytes of
    each folder's text files. Marker and checksum files are listed too and left out here."""
    folder = run_folder(spark)
    docs = render.table(spark, sf, "documents").select("source", F.coalesce("text", F.lit("")).alias("value"))
    docs.write.partitionBy("source").text(f"{folder}/files")
    listed = files.scan_files(spark, f"{folder}/files", folder=f"{folder}/scan").filter("ext = '.txt'")
    return listed.groupBy(F.substring_index("rel_path", "/", 1).alias("folder"), "file_type").agg(
        F.sum("length").alias("n_bytes"))


SCAN_SQL = """
SELECT 'source=' || source AS folder, 'unsupported' AS file_type,
       CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS n_bytes
FROM documents GROUP BY source"""


def admission_check(spark: SparkSession, sf: str) -> DataFrame:
    """Page addresses as file names, page size against a limit."""
    pages = render.table(spark, sf, "pages").select("page_id", "url", F.char_length("html").alias("size"))
    name = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit(".PDF"))).otherwise(F.col("url"))
    accepted, rejected = files.admit(pages.withColumn("name", name), "name", "size", 2000)
    return accepted.withColumn("reject_code", F.lit("")).unionByName(rejected).select("page_id", "reject_code")


ADMISSION_SQL = """
SELECT page_id, CASE WHEN length(html) > 2000 THEN 'FILE_TOO_LARGE' WHEN page_id % 3 <> 0 THEN 'INVALID_FILE_TYPE' ELSE '' END AS reject_code
FROM pages"""


def magic_check(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as file content behind right and wrong header bytes."""
    docs = render.table(spark, sf, "documents").select("doc_id", "text")
    key = F.col("doc_id")
    kinds = ["ofd", "pdf", "jpg", "jpeg", "png", fv.UNSUPPORTED]
    kind = F.get(F.array(*[F.lit(k) for k in kinds]), (key % 6).cast("int"))
    table = F.create_map(*[F.lit(x) for pair in fv.HEADER_HEX.items() for x in pair])
    head = F.when(key % 5 == 0, F.lit("00")).otherwise(F.coalesce(F.try_element_at(table, kind), F.lit("00")))
    content = F.concat(F.unhex(head), F.encode("text", "UTF-8"))
    return docs.select("doc_id", kind.alias("file_type"), files.magic_valid(content, kind).alias("magic_valid"))


MAGIC_SQL = """
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'ofd' WHEN 1 THEN 'pdf' WHEN 2 THEN 'jpg' WHEN 3 THEN 'jpeg' WHEN 4 THEN 'png' ELSE 'unsupported' END AS file_type,
       CASE WHEN doc_id % 6 = 5 THEN NULL ELSE doc_id % 5 <> 0 END AS magic_valid
FROM documents"""


# ---- outcomes -------------------------------------------------------------

def decided(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome rows of the order headers and of the pages, before duplicates."""
    done = process_documents(render.header_documents(spark, sf)).withColumn("elapsed_seconds", F.lit(0.25))
    skipped = outcome.skipped_files(render.page_files(spark, sf)).withColumn("elapsed_seconds", F.lit(0.0))
    return done.unionByName(skipped, allowMissingColumns=True)


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Marked outcome rows. The decided rows are stored first: marking reads them
    twice and the outputs again, and extraction should run once."""
    return outcome.mark_duplicates(stored(decided(spark, sf), run_folder(spark), "decided"))


PAGES_SQL = """
SELECT 'pages/' || page_id || '.html' AS rel_path FROM pages"""
RESULTS_SQL = f"{ORDER_HEADERS}, {OUTCOMES}"


def failure_reasons(spark: SparkSession, sf: str) -> DataFrame:
    docs = render.header_documents(spark, sf).withColumn(
        "parse_errors", F.when(F.col("order_key") % 2 == 0, F.array(F.lit("e1"), F.lit("e2"))))
    return process_documents(docs).select("rel_path", "status", "error_message")


FAILURE_SQL = f"""WITH {ORDER_HEADERS}
SELECT rel_path, CASE WHEN order_key % 11 = 0 THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN order_key % 11 <> 0 THEN '' WHEN order_key % 2 = 0 THEN '无法识别发票号码或价税合计（解析错误: e1;e2）' ELSE '无法识别发票号码或价税合计' END AS error_message
FROM headers"""


def business_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return results(spark, sf).select("rel_path", "status", "is_dedup", "error_message")


DEDUP_SQL = f"""WITH {RESULTS_SQL}
SELECT rel_path, status, is_dedup, CASE WHEN status = 'failed' THEN '无法识别发票号码或价税合计'
    WHEN is_dedup THEN '跳过重复发票（发票代码:' || code || ' 发票号码:' || number || '）' ELSE '' END AS error_message FROM results
UNION ALL SELECT rel_path, 'skipped', false, '非电子发票格式' FROM ({PAGES_SQL})"""


def dedup_summary(spark: SparkSession, sf: str) -> DataFrame:
    return outcome.dedup_summary(results(spark, sf))


DEDUP_SUMMARY_SQL = f"""WITH {RESULTS_SQL}
SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM pages) AS n_before,
       (SELECT count(*) FROM orders) + (SELECT count(*) FROM pages) AS n_after,
       count(DISTINCT (code, number)) AS n_keys FROM results WHERE has_invoice"""


def outcome_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.run_statistics(results(spark, sf))


STATS_SQL = f"""WITH {RESULTS_SQL},
c AS (SELECT count(*) AS n, count(*) FILTER (has_invoice) AS ok, count(*) FILTER (NOT has_invoice) AS bad, count(*) FILTER (is_dedup) AS dup FROM results),
p AS (SELECT count(*) AS skipped FROM pages)"""
OUTCOME_STATS_SQL = f"""{STATS_SQL}
SELECT n + skipped AS total_scanned, n AS total_invoice_files, ok AS total_success, bad AS total_failed, skipped AS total_skipped,
       dup AS duplicates, n * 0.25::DOUBLE AS total_parse_time, round_even(CAST(ok AS DOUBLE) / n * 100, 2) AS success_rate, true AS validation_ok
FROM c, p"""


def statistics_sheet(spark: SparkSession, sf: str) -> DataFrame:
    return stats.statistics_rows(stats.run_statistics(results(spark, sf)), F.lit(3725.9)).select("row_no", "label", "value")


SHEET_SQL = f"""{STATS_SQL}
SELECT unnest([
  {{'row_no': 1::BIGINT, 'label': '扫描文件总数', 'value': CAST(n + skipped AS VARCHAR)}},
  {{'row_no': 2::BIGINT, 'label': '├─ 电子发票文件数', 'value': CAST(n AS VARCHAR)}},
  {{'row_no': 3::BIGINT, 'label': '│  ├─ 识别成功', 'value': CAST(ok AS VARCHAR)}},
  {{'row_no': 4::BIGINT, 'label': '│  └─ 识别失败', 'value': CAST(bad AS VARCHAR)}},
  {{'row_no': 5::BIGINT, 'label': '└─ 非电子发票文件数', 'value': CAST(skipped AS VARCHAR)}},
  {{'row_no': 6::BIGINT, 'label': '校验关系', 'value': (n + skipped) || ' = ' || n || ' + ' || skipped || '；' || n || ' = ' || ok || ' + ' || bad || ' ✓'}},
  {{'row_no': 7::BIGINT, 'label': '成功率', 'value': CAST(round_even(CAST(ok AS DOUBLE) / n * 100, 2) AS VARCHAR) || '%'}},
  {{'row_no': 8::BIGINT, 'label': '处理总耗时', 'value': '01:02:05'}}], recursive := true)
FROM c, p"""


def outcome_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return stats.outcome_rollup(results(spark, sf))


ROLLUP_SQL = f"""WITH {RESULTS_SQL},
r AS (SELECT true AS is_invoice, CASE WHEN has_invoice THEN 'success' ELSE 'failed' END AS outcome FROM results
      UNION ALL SELECT false, 'skipped' FROM pages)
SELECT is_invoice, outcome, CAST(GROUPING(is_invoice, outcome) AS BIGINT) AS level, count(*) AS n FROM r GROUP BY ROLLUP (is_invoice, outcome)"""


# ---- outputs --------------------------------------------------------------

def accepted_22(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.accepted_rows(results(spark, sf), F.col("modification_time"))


RECORD_SQL = f"""WITH {RESULTS_SQL},
rec AS (SELECT *, strftime(order_date, '%Y-%m-%d %H:%M:%S') AS t,
  CAST(CASE WHEN order_key % 17 = 0 THEN tax ELSE total END AS VARCHAR) AS total_amount FROM results)"""
ACCEPTED_SQL = f"""{RECORD_SQL}
SELECT rel_path AS file_path, code AS invoice_code, number AS invoice_number, strftime(order_date, '%Y-%m-%d') AS invoice_date,
  number AS check_code, '增值税电子普通发票' AS invoice_type, buyer AS buyer_name, '' AS buyer_tax_id, '' AS buyer_address_phone, '' AS buyer_bank_account,
  seller AS seller_name, '' AS seller_tax_id, '' AS seller_address_phone, '' AS seller_bank_account, '' AS total_amount_cn, total_amount,
  CAST(pretax AS VARCHAR) AS pretax_amount, CAST(tax AS VARCHAR) AS tax_amount, '[]' AS line_items_json, t AS processing_time, '' AS raw_markdown, '' AS remarks
FROM rec WHERE status = 'success'"""


def record_json(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.record_json(results(spark, sf), F.col("modification_time"))


RECORD_JSON_SQL = f"""{RECORD_SQL}
SELECT rel_path, '{{"file_path":"' || rel_path || '","processing_time":"' || t || '","extraction_source":"ocr","invoice_type":"增值税电子普通发票","invoice_code":"'
  || code || '","invoice_number":"' || number || '","invoice_date":"' || strftime(order_date, '%Y-%m-%d') || '","check_code":"' || number
  || '","buyer_name":"' || buyer || '","buyer_tax_id":"","buyer_address_phone":"","buyer_bank_account":"","seller_name":"' || seller
  || '","seller_tax_id":"","seller_address_phone":"","seller_bank_account":"","total_amount_cn":"","total_amount":"' || total_amount
  || '","pretax_amount":"' || pretax || '","tax_amount":"' || tax || '","line_items":[],"line_items_json":"[]","raw_markdown":"","remarks":"","is_dedup":'
  || is_dedup || ',"validation_notes":[],"is_success":true}}' AS record
FROM rec WHERE has_invoice"""


def failed_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.failed_rows(results(spark, sf))


def skipped_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.skipped_rows(results(spark, sf))


def duplicate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.duplicate_rows(results(spark, sf)).select("rel_path", "invoice_code", "invoice_number")


def goods_detail(spark: SparkSession, sf: str) -> DataFrame:
    done = process_documents(render.goods_documents(spark, sf))
    return sinks.goods_detail(stored(done, run_folder(spark), "decided"))


GOODS_DETAIL_SQL = f"""WITH {GOODS}
SELECT number AS invoice_number, goods_name, '' AS spec_model, '' AS unit, '' AS quantity, '' AS unit_price,
       CAST(amount AS VARCHAR) AS amount, tax_rate, CAST(tax_amount AS VARCHAR) AS tax_amount
FROM goods"""


# ---- assistance -----------------------------------------------------------

def assist_queue(spark: SparkSession, sf: str) -> DataFrame:
    """The whole request of every empty field of low-confidence documents."""
    extracted = stored(extract(render.header_documents(spark, sf)), run_folder(spark), "extracted")
    whole = F.concat("system_text", F.lit("|"), "request_text")
    return assist.requests(extracted).select("rel_path", "field", F.md5(F.encode(whole, "UTF-8")).alias("request_md5"))


QUEUE_SQL = f"""WITH {ORDER_HEADERS}, {HEADER_TEXT},
wanted AS (SELECT rel_path, full_text, 'total_amount_cn' AS field FROM texts WHERE order_key % 4 >= 2
           UNION ALL SELECT rel_path, full_text, 'invoice_number' FROM texts WHERE order_key % 4 >= 2 AND order_key % 11 = 0)
SELECT rel_path, field, md5('{fv.ASSIST_SYSTEM_TEXT}' || '|' || '{fv.ASSIST_REQUEST_PARTS[0]}' || substring(full_text, 1, 3000)
  || '{fv.ASSIST_REQUEST_PARTS[1]}' || field || '=') AS request_md5
FROM wanted"""


def assist_context(spark: SparkSession, sf: str) -> DataFrame:
    """Request text over whole documents; the context stops at 3000 characters."""
    docs = render.table(spark, sf, "documents").select("doc_id", "text")
    text = assist.request_text(F.col("text"), F.lit("invoice_code"))
    return docs.select("doc_id", F.md5(F.encode(text, "UTF-8")).alias("request_md5"))


CONTEXT_SQL = f"""
SELECT doc_id, md5('{fv.ASSIST_REQUEST_PARTS[0]}' || substring(text, 1, 3000) || '{fv.ASSIST_REQUEST_PARTS[1]}' || 'invoice_code=') AS request_md5
FROM documents"""


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    h = render.order_headers(spark, sf).select("order_key", "rel_path", "number")
    text = F.concat(
        F.lit("\n好的\ninvoice_number=1\ninvoice_number= "), F.col("number"), F.lit(" \ntotal_amount_cn="),
        F.when(F.col("order_key") % 3 == 0, "UNSURE").otherwise("伍圆整"), F.lit("\nbuyer_name=无\nother=2"))
    wanted = F.array(F.lit("invoice_number"), F.lit("total_amount_cn"), F.lit("check_code"))
    return h.select("rel_path", wanted.alias("wanted"), text.alias("answer_text"))


def assist_answers(spark: SparkSession, sf: str) -> DataFrame:
    return assist.parse_answers(_answers(spark, sf))


ANSWERS_SQL = f"""WITH {ORDER_HEADERS}
SELECT rel_path, 'invoice_number' AS field, number AS value FROM headers
UNION ALL SELECT rel_path, 'total_amount_cn', CASE WHEN order_key % 3 = 0 THEN '' ELSE '伍圆整' END FROM headers"""


def assist_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Low-confidence documents through a provider and back."""
    answers = _answers(spark, sf).select("rel_path", "answer_text")

    def provider(requests: DataFrame) -> DataFrame:
        return requests.select("rel_path", "field").join(answers, "rel_path")

    done = process_documents(
        render.header_documents(spark, sf), provider=provider, keep=keep_in(run_folder(spark)))
    return done.select("rel_path", "invoice_number", "total_amount_cn", "status", "remarks")


MERGE_SQL = f"""WITH {ORDER_HEADERS}
SELECT rel_path, CASE WHEN order_key % 11 = 0 AND order_key % 4 < 2 THEN '' ELSE number END AS invoice_number,
  CASE WHEN order_key % 4 >= 2 AND order_key % 3 <> 0 THEN '伍圆整' ELSE '' END AS total_amount_cn,
  CASE WHEN order_key % 11 = 0 AND order_key % 4 < 2 THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN order_key % 4 >= 2 THEN concat_ws('；', CASE WHEN order_key % 11 = 0 THEN 'LLM兜底提取: invoice_number' END,
       CASE WHEN order_key % 3 <> 0 THEN 'LLM兜底提取: total_amount_cn' END) ELSE '' END AS remarks
FROM headers"""


def stored_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Low-confidence documents through a store of answers, in two runs. The provider fails on a third of the
    documents when it is asked first; the second run asks nothing."""
    folder = run_folder(spark)
    store, answers = f"{folder}/answers", _answers(spark, sf).select("rel_path", "answer_text")
    extracted = stored(extract(render.header_documents(spark, sf)), folder, "extracted")
    asked, calls = stored(assist.requests(extracted), folder, "asked"), []

    def provider(requests: DataFrame) -> DataFrame:
        calls.append(len(calls))
        got = requests.select("rel_path", "field").join(answers, "rel_path")
        return got.filter(F.pmod(F.xxhash64("rel_path"), F.lit(3)) > 0) if len(calls) == 1 else got

    assist.answered(asked, provider, store)
    found, again = assist.answered(asked, provider, store)
    done = finish(assist.merge_answers(extracted, assist.parse_answers(found.withColumn("wanted", F.array("field")))))
    return done.select("rel_path", "invoice_number", "total_amount_cn", "status", "remarks", F.lit(again).cast("long").alias("asked_again"))


STORED_SQL = MERGE_SQL.replace("FROM headers", ", 0::BIGINT AS asked_again FROM headers")


def observed_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics out of the pass that writes the marked rows."""
    folder = run_folder(spark)
    marked = outcome.mark_duplicates(stored(decided(spark, sf), folder, "decided"))
    watched, statistics = stats.observed(marked)
    stored(watched, folder, "results")
    return statistics()


# ---- jobs -----------------------------------------------------------------

def job_status(spark: SparkSession, sf: str) -> DataFrame:
    """Event users as jobs, event types as outcomes; every job expects one more
    outcome if its id is odd."""
    events = render.table(spark, sf, "events").select("user_id", "event_type")
    status = F.when(F.col("event_type") == "error", fv.FAILED).when(F.col("event_type") == "view", fv.SKIPPED).otherwise(fv.SUCCESS)
    outcomes = events.select(F.col("user_id").cast("string").alias("job_id"), status.alias("status"))
    jobs = outcomes.groupBy("job_id").agg((F.count(F.lit(1)) + F.max(F.col("job_id").cast("bigint") % 2)).alias("file_count"))
    return ingest.job_status(outcomes, jobs)


JOB_SQL = """
WITH c AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type NOT IN ('error', 'view')) AS s, count(*) FILTER (event_type = 'error') AS f,
                  count(*) FILTER (event_type = 'view') AS k FROM events GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS job_id, n + user_id % 2 AS file_count, n AS n_results, s AS n_success, f AS n_failed, k AS n_skipped,
       CASE WHEN user_id % 2 = 1 THEN 'running' WHEN f = n THEN 'failed' ELSE 'completed' END AS job_status
FROM c"""


def incremental_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Orders arrive in four rounds, by the key's remainder, for two jobs in turn; every round is
    decided against the keys that the stream remembers of both. The last round is then repeated, as after a
    lost driver: its commit is taken back and the batch runs again."""
    folder = run_folder(spark)
    orders = render.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    job = F.when(F.col("o_orderkey") % 2 == 0, "001").otherwise("01")

    def process(batch: DataFrame) -> DataFrame:
        return process_documents(render.header_documents(spark, sf, batch)).drop("line_items")

    def take_in() -> None:
        stream = spark.readStream.schema(arriving.schema).parquet(f"{folder}/arrivals")
        keyed.start_keyed_ingest(spark, stream, process, f"{folder}/results", f"{folder}/offsets").awaitTermination()

    arriving = orders.withColumn("job_id", job)
    for number in range(4):
        arriving.filter(F.col("o_orderkey") % 4 == number).write.mode("append").parquet(f"{folder}/arrivals")
        take_in()
    remove(spark, f"{folder}/offsets/commits/3")
    take_in()
    return spark.read.parquet(f"{folder}/results").select("rel_path", "job_id", "status", "is_dedup")


INGEST_SQL = f"""WITH {RESULTS_SQL},
arrived AS (
  SELECT rel_path, order_key, has_invoice, has_invoice AND row_number() OVER (
           PARTITION BY has_invoice, code, number ORDER BY order_key % 4, file_type <> 'ofd', rel_path) > 1 AS copy
  FROM decided)
SELECT rel_path, CASE WHEN order_key % 2 = 0 THEN '001' ELSE '01' END AS job_id,
       CASE WHEN NOT has_invoice THEN 'failed' WHEN copy THEN 'skipped' ELSE 'success' END AS status, copy AS is_dedup
FROM arrived"""


def arriving_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written in three rounds to folders with hidden names, and taken in by the stream of files after
    each: bytes of the text files of each batch and folder."""
    folder = run_folder(spark)
    docs = render.table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("_source"), F.coalesce("text", F.lit("")).alias("value"))

    def keep(batch: DataFrame, batch_id: int) -> None:
        stored(batch.withColumn("round", F.lit(batch_id).cast("long")), f"{folder}/listed", ingest.batch_part("", batch_id))

    for number in range(3):
        docs.filter(F.col("doc_id") % 3 == number).drop("doc_id").write.partitionBy("_source").text(
            f"{folder}/files/.round-{number}")
        time.sleep(2 * SETTLE)
        arrivals = file_source.arriving_files(spark, f"{folder}/files", settle=str(SETTLE))
        arrivals.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/offsets").trigger(
            availableNow=True).start().awaitTermination()
    texts = spark.read.parquet(f"{folder}/listed").filter("ext = '.txt'")
    return texts.groupBy("round", F.regexp_extract("rel_path", "/(_source=[^/]*)/", 1).alias("folder")).agg(
        F.sum("length").alias("n_bytes"))


SETTLE = 0.2
ARRIVING_SQL = """
SELECT doc_id % 3 AS round, '_source=' || source AS folder, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS n_bytes
FROM documents GROUP BY ALL"""


def listed_types(spark: SparkSession, sf: str) -> DataFrame:
    """Page texts written as files and read back as the file source lists them: conditions on type, path and size
    are decided while listing, and headers are read of the files that are left."""
    folder = run_folder(spark)
    pages = render.table(spark, sf, "pages").select(
        F.concat(F.lit("host-"), F.col("page_id") % 7).alias("_host"), F.coalesce("html", F.lit("")).alias("value"))
    pages.repartition(4, "_host").write.partitionBy("_host").text(f"{folder}/files")
    listed = file_source.read_files(spark, f"{folder}/files", headers="true")
    found = listed.filter((F.col("ext") == ".txt") & F.startswith("rel_path", F.lit("_host=host-3/")) & (F.col("length") > 0))
    return found.groupBy(F.substring_index("rel_path", "/", 1).alias("folder"), "file_type", "magic_valid").agg(
        F.sum("length").alias("n_bytes"))


LISTED_SQL = """
SELECT '_host=host-3' AS folder, 'unsupported' AS file_type, NULL::BOOLEAN AS magic_valid,
       CAST(sum(strlen(coalesce(html, '')) + 1) AS BIGINT) AS n_bytes
FROM pages WHERE page_id % 7 = 3 HAVING count(*) > 0"""


def path_order(spark: SparkSession, sf: str) -> DataFrame:
    """Place of every page file in path order, by range partitions and positions inside them."""
    listed = files.in_path_order(render.page_files(spark, sf).select("rel_path"))
    placed = listed.withColumn("_part", F.spark_partition_id())
    kept = stored(placed.withColumn("_at", F.monotonically_increasing_id()), run_folder(spark), "ordered")
    counts = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_low"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = counts.select("_part", "_low", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return kept.join(offsets, "_part").select(
        "rel_path", (F.col("_before") + F.col("_at") - F.col("_low")).alias("place"))


PATH_ORDER_SQL = f"""SELECT rel_path, row_number() OVER (ORDER BY rel_path) - 1 AS place FROM ({PAGES_SQL})"""


ENTRIES = {
    "scan_documents": (scan_documents, SCAN_SQL),
    "classify_route": (classify_route, CLASSIFY_SQL),
    "admission_check": (admission_check, ADMISSION_SQL),
    "magic_check": (magic_check, MAGIC_SQL),
    "failure_reasons": (failure_reasons, FAILURE_SQL),
    "business_dedup": (business_dedup, DEDUP_SQL),
    "dedup_summary": (dedup_summary, DEDUP_SUMMARY_SQL),
    "outcome_stats": (outcome_stats, OUTCOME_STATS_SQL),
    "statistics_sheet": (statistics_sheet, SHEET_SQL),
    "outcome_rollup": (outcome_rollup, ROLLUP_SQL),
    "accepted_22": (accepted_22, ACCEPTED_SQL),
    "record_json": (record_json, RECORD_JSON_SQL),
    "failed_rows": (failed_rows, f"""WITH {RESULTS_SQL}
        SELECT rel_path, '无法识别发票号码或价税合计' AS error_message, strftime(order_date, '%Y-%m-%d %H:%M:%S') AS file_time FROM results WHERE status = 'failed'"""),
    "skipped_rows": (skipped_rows, f"SELECT rel_path, 'unsupported' AS file_type, '2024-01-02 03:04:05' AS file_time FROM ({PAGES_SQL})"),
    "duplicate_rows": (duplicate_rows, f"WITH {RESULTS_SQL} SELECT rel_path, code AS invoice_code, number AS invoice_number FROM results WHERE is_dedup"),
    "goods_detail": (goods_detail, GOODS_DETAIL_SQL),
    "assist_queue": (assist_queue, QUEUE_SQL),
    "assist_context": (assist_context, CONTEXT_SQL),
    "assist_answers": (assist_answers, ANSWERS_SQL),
    "assist_merge": (assist_merge, MERGE_SQL),
    "stored_answers": (stored_answers, STORED_SQL),
    "observed_stats": (observed_stats, OUTCOME_STATS_SQL),
    "job_status": (job_status, JOB_SQL),
    "incremental_ingest": (incremental_ingest, INGEST_SQL),
    "arriving_bytes": (arriving_bytes, ARRIVING_SQL),
    "listed_types": (listed_types, LISTED_SQL),
    "path_order": (path_order, PATH_ORDER_SQL),
}
