from billweave.operators import outcome, stats
from billweave.operators.spread import with_ordinal
from pyspark.sql import functions as F

SCHEMA = "rel_path string, file_type string, status string, invoice_code string, invoice_number string, has_invoice boolean, error_message string, elapsed_seconds double"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "", 1.0) for r in rows], SCHEMA).withColumn("is_dedup", F.lit(False))


def marked(spark, rows, seen=None):
    return {r.rel_path: (r.status, r.is_dedup) for r in outcome.mark_duplicates(frame(spark, rows), seen).collect()}


def test_duplicates_are_marked_not_dropped(spark):
    rows = [("b.pdf", "pdf", "success", "c", "1", True), ("a.pdf", "pdf", "success", "c", "1", True), ("c.pdf", "pdf", "success", "c", "2", True),
            ("z.ofd", "ofd", "success", "c", "2", True), ("f.pdf", "pdf", "failed", "c", "1", False), ("e.pdf", "pdf", "success", "", "1", True),
            ("e2.pdf", "pdf", "success", "", "1", True), ("n1", "pdf", "success", "", "", True), ("n2", "pdf", "success", "", "", True)]
    assert marked(spark, rows) == {
        "a.pdf": ("success", False), "b.pdf": ("skipped", True), "c.pdf": ("skipped", True), "z.ofd": ("success", False),
        "f.pdf": ("failed", False), "e.pdf": ("success", False), "e2.pdf": ("skipped", True), "n1": ("success", False), "n2": ("success", False)}


def test_duplicate_message_and_earlier_keys(spark):
    seen = spark.createDataFrame([("c", "1")], "invoice_code string, invoice_number string")
    df = outcome.mark_duplicates(frame(spark, [("a", "pdf", "success", "c", "1", True)]), seen)
    assert df.first().error_message == "跳过重复发票（发票代码:c 发票号码:1）"


def test_hot_key(spark):
    n = 30_000
    rows = spark.range(n).select(
        F.lpad(F.col("id").cast("string"), 8, "0").alias("rel_path"), F.lit("pdf").alias("file_type"), F.lit("success").alias("status"),
        F.lit("c").alias("invoice_code"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("invoice_number"),
        F.lit(True).alias("has_invoice"), F.lit("").alias("error_message"), F.lit(False).alias("is_dedup"))
    out = outcome.mark_duplicates(rows)
    assert out.filter("is_dedup").count() == n // 3 - 1
    assert out.filter("invoice_number = 'hot' and not is_dedup").first().rel_path == "00000000"
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    # the rows meet one row for each key with copies, and are not shuffled on their path
    assert "Join [rel_path" not in plan and "(_n#" in plan


def test_missing_key_parts_and_history(spark):
    rows = [("a", "pdf", "success", None, "1", True), ("b", "pdf", "success", None, "1", True), ("c", "pdf", "success", "k", "2", True)]
    seen = spark.createDataFrame([("k", "2"), ("z", "9"), ("k", "2")], "invoice_code string, invoice_number string")
    got = {r.rel_path: r.is_dedup for r in outcome.mark_duplicates(frame(spark, rows), seen).collect()}
    assert got == {"a": False, "b": True, "c": True}


def test_counters(spark):
    rows = [("a", "pdf", "success", "c", "1", True), ("b", "pdf", "failed", "", "", False), ("c", "unsupported", "skipped", None, None, False)]
    row = stats.run_statistics(frame(spark, rows)).first()
    assert (row.total_scanned, row.total_invoice_files, row.total_success, row.total_failed, row.total_skipped) == (3, 2, 1, 1, 1)
    assert (row.success_rate, row.validation_ok, row.total_parse_time) == (50.0, True, 3.0)


def test_duplicates_count_as_success_and_empty_run(spark):
    rows = [("a", "pdf", "success", "c", "1", True), ("b", "pdf", "success", "c", "1", True)]
    row = stats.run_statistics(outcome.mark_duplicates(frame(spark, rows))).first()
    assert (row.total_success, row.duplicates, row.success_rate) == (2, 1, 100.0)
    empty = stats.run_statistics(frame(spark, [])).first()
    assert (empty.success_rate, empty.validation_ok, empty.total_scanned) == (100.0, True, 0)
    sheet = {r.label: r.value for r in stats.statistics_rows(stats.run_statistics(frame(spark, rows))).collect()}
    assert sheet["校验关系"] == "2 = 2 + 0；2 = 2 + 0 ✓" and sheet["成功率"] == "100.0%"


def test_ordinal_in_two_levels(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"), F.col("id").alias("n"))
    out = with_ordinal(df.withColumn("c", F.floor(F.col("n") / 100)), ["k"], ["c"], ["n"])
    for key in ("hot", "7"):
        rows = out.filter(F.col("k") == key).orderBy("n").collect()
        assert [r.ordinal for r in rows] == list(range(len(rows)))


def test_failure_reason(spark):
    docs = spark.createDataFrame([("", "1", ["e1", "e2"]), ("1", "", []), ("1", "2", ["e"])], "invoice_number string, total_amount string, parse_errors array<string>")
    got = [(r.status, r.error_message) for r in outcome.with_outcome(docs).collect()]
    assert got == [("failed", "无法识别发票号码或价税合计（解析错误: e1;e2）"), ("failed", "无法识别发票号码或价税合计"), ("success", "")]
