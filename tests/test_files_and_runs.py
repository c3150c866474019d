import io
import os
import zipfile

import pytest
from billweave import fixed_values as fv
from billweave.operators import assist, tags
from billweave.plans.folder_run import outcomes, process_documents, run_folder_to_tables
from billweave.sources import archives, files, sinks
from billweave.streaming import ingest
from pyspark.sql import functions as F


def archive(number="12345678", total="9.99", broken=False, image=False):
    open_tag = f'xmlns:ofd="{fv.OFD_NAMESPACE}"'
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        if image:
            z.writestr("Doc_0/Res/seal.PNG", b"x")
        else:
            z.writestr("Doc_0/Tags/CustomTag.xml", "<broken" if broken else f'''<ofd:T {open_tag}>
              <ofd:InvoiceNo><ofd:ObjectRef>1</ofd:ObjectRef></ofd:InvoiceNo>
              <ofd:TaxInclusiveTotalAmount><ofd:ObjectRef>2</ofd:ObjectRef><ofd:ObjectRef>3</ofd:ObjectRef></ofd:TaxInclusiveTotalAmount>
              <ofd:Item><ofd:ObjectRef></ofd:ObjectRef><ofd:ObjectRef>4</ofd:ObjectRef><ofd:ObjectRef>99</ofd:ObjectRef></ofd:Item>
              <ofd:Amount><ofd:ObjectRef>3</ofd:ObjectRef></ofd:Amount></ofd:T>''')
            z.writestr("Doc_0/Pages/Page_0/Content.xml", f'''<ofd:P {open_tag}>
              <ofd:TextObject ID="1" Boundary="10 10 5 5"><ofd:TextCode>{number[:3]}</ofd:TextCode><ofd:CGTransform><ofd:TextCode>{number[3:]}</ofd:TextCode></ofd:CGTransform></ofd:TextObject>
              <ofd:TextObject ID="2" Boundary="10 20 5 5"><ofd:TextCode>¥</ofd:TextCode></ofd:TextObject>
              <ofd:TextObject ID="3" Boundary="20 21 5 5"><ofd:TextCode>{total}</ofd:TextCode></ofd:TextObject>
              <ofd:TextObject ID="4" Boundary="bad"><ofd:TextCode>货</ofd:TextCode></ofd:TextObject>
              <ofd:TextObject><ofd:TextCode>no id</ofd:TextCode></ofd:TextObject></ofd:P>''')
    return blob.getvalue()


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in put"
    (root / "sub").mkdir(parents=True)
    (root / "node_modules").mkdir()
    contents = {"发票001.pdf": b"%PDF-1", "发票002.jpg": b"\xff\xd8\xff1", "发票003.png": b"\x89PNG", "发票004.OFD": archive(), "readme.txt": b"t",
                "photo.bmp": b"b", "sub/发票005.pdf": b"fake", "node_modules/x.pdf": b"%PDF", "sub/copy.ofd": archive(), "sub/bad.ofd": b"nozip",
                "sub/image.ofd": archive(image=True)}
    for name, data in contents.items():
        (root / name).write_bytes(data)
    return str(root)


def test_scan(spark, folder):
    rows = {r.rel_path: r for r in files.scan_files(spark, folder, check_magic=True).collect()}
    assert len(rows) == 10 and "node_modules/x.pdf" not in rows
    assert {n: r.magic_valid for n, r in rows.items()} == {
        "发票001.pdf": True, "发票002.jpg": True, "发票003.png": True, "发票004.OFD": True, "readme.txt": None, "photo.bmp": None,
        "sub/发票005.pdf": False, "sub/copy.ofd": True, "sub/bad.ofd": False, "sub/image.ofd": True}
    assert rows["发票004.OFD"].route == "ofd" and rows["发票001.pdf"].route == "ocr" and rows["readme.txt"].route == "unsupported"
    assert rows["readme.txt"].length == 1
    plain = files.scan_files(spark, folder)
    assert [r.rel_path for r in files.in_path_order(plain).collect()] == sorted(rows)
    assert plain.filter("magic_valid is not null").count() == 0


def test_shred_and_tags(spark, folder):
    listed = files.archive_files(files.scan_files(spark, folder))
    nodes = archives.shred_archives(listed, root=folder).persist()
    objects = tags.text_objects(nodes)
    texts = tags.object_texts(objects)
    got = {(r.rel_path, r.object_id): r.text for r in texts.collect()}
    assert got[("发票004.OFD", "1")] == "12345678"
    values = {(r.rel_path, r.field): r.value for r in tags.field_values(nodes, texts).collect()}
    assert values[("sub/copy.ofd", "total_amount")] == "9.99"
    goods = tags.tagged_goods(nodes, texts).filter("rel_path = 'sub/copy.ofd'").collect()
    assert [(g.goods_name, g.amount, g.tax_rate) for g in goods] == [("货", "9.99", "")]
    text = {r.rel_path: r.full_text for r in tags.page_texts(objects, texts).collect()}
    assert text["发票004.OFD"] == "货\n12345678\n¥9.99"
    docs = {r.rel_path: r for r in tags.tagged_documents(nodes.select("rel_path").distinct(), nodes).collect()}
    assert docs["sub/bad.ofd"].parse_errors == [fv.MSG_NOT_ZIP] and docs["sub/bad.ofd"].source == fv.SOURCE_FALLBACK
    assert docs["sub/image.ofd"].fallback_entry == "Doc_0/Res/seal.PNG" and docs["sub/image.ofd"].parse_errors == [fv.MSG_NO_DATA]
    nodes.unpersist()


def test_bad_tag_entry_keeps_page_text(spark):
    content = spark.createDataFrame([("a.ofd", archive(broken=True))], "rel_path string, content binary")
    nodes = archives.shred_archives(content).persist()
    assert nodes.filter("tag = '#error' and entry_no is not null").count() == 1
    doc = tags.tagged_documents(nodes.select("rel_path").distinct(), nodes).first()
    assert doc.tag_invoice_number is None and "12345678" in doc.full_text and doc.source == fv.SOURCE_TAGGED
    nodes.unpersist()


def test_folder_run(spark, folder, tmp_path):
    spans = spark.createDataFrame([
        ("发票001.pdf", 0, i, 10.0, 20.0 * i, t) for i, t in enumerate(
            ["增值税电子普通发票 发票代码：110023156000", "发票号码：00000000000000000077", "价税合计（小写）¥12.50"])],
        "rel_path string, page int, seq int, x double, y double, text string")
    box = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]
    recognised = spark.createDataFrame([
        ("发票002.jpg", 0, 0, "发票号码：55555555", 0.9, box, None), ("发票002.jpg", 0, 1, "价税合计：3.00", 0.9, box, None),
        ("sub/image.ofd", 0, 0, "发票号码：66666666 价税合计：4.00", 0.9, box, "Doc_0/Res/seal.PNG")],
        "rel_path string, page int, seq int, text string, confidence double, bbox array<array<double>>, entry string")
    out = str(tmp_path / "out")
    results = run_folder_to_tables(spark, folder, out, spans, recognised)
    status = {r.rel_path: r.status for r in results.collect()}
    assert status == {
        "发票001.pdf": "success", "发票002.jpg": "success", "发票003.png": "failed", "readme.txt": "skipped", "photo.bmp": "skipped",
        "sub/发票005.pdf": "failed", "sub/copy.ofd": "success", "sub/bad.ofd": "failed", "sub/image.ofd": "success",
        "发票004.OFD": "skipped"}  # same key as sub/copy.ofd, which is first in path order
    read = lambda name: sinks.read_output(spark, out, name)
    assert read("accepted").count() == 4 and len(read("accepted").columns) == 22
    assert read("skipped").count() == 2 and read("duplicates").count() == 1
    failed = {r["文件路径"]: r["失败原因"] for r in read("failed").collect()}
    assert failed["sub/bad.ofd"] == f"无法识别发票号码或价税合计（解析错误: {fv.MSG_NOT_ZIP}）"
    assert read("goods_detail").count() == 1
    sheet = {r["统计项"]: r["数量"] for r in read("statistics").collect()}
    assert sheet["扫描文件总数"] == "10" and sheet["校验关系"].endswith("✓")
    assert sheet[fv.STATISTICS_LABELS[-1]] != "00:00:00" and results.agg(F.sum("elapsed_seconds")).first()[0] > 0
    assert fv.MSG_NO_RECOGNITION in failed["发票003.png"]  # nobody could read it
    record = read("records").filter("rel_path = '发票001.pdf'").first().record
    assert '"invoice_number":"00000000000000000077"' in record and '"is_success":true' in record


def test_admission(spark):
    df = spark.createDataFrame([("a.PDF", 5), ("b.txt", 5), ("c.txt", 50)], "name string, size bigint")
    accepted, rejected = files.admit(df, "name", "size", 20)
    assert [r.name for r in accepted.collect()] == ["a.PDF"]
    assert {r.name: r.reject_code for r in rejected.collect()} == {"b.txt": "INVALID_FILE_TYPE", "c.txt": "FILE_TOO_LARGE"}


def test_assisted_answers(spark):
    docs = spark.createDataFrame([("low", "票", 0.5), ("high", "票", 0.9), ("none", "", 0.1)], "rel_path string, full_text string, confidence double").withColumn("source", F.lit(fv.SOURCE_TEXT))

    def provider(requests):
        assert set(requests.columns) >= {"rel_path", "field", "request_text"}
        answer = F.when(F.col("field") == "invoice_number", "invoice_number=８8").when(
            F.col("field") == "total_amount", "total_amount=¥1,5\ntotal_amount=¥1,000 ").otherwise(F.concat("field", F.lit("=UNSURE")))
        return requests.select("rel_path", "field", answer.alias("answer_text"))

    rows = {r.rel_path: r for r in process_documents(docs, provider=provider).collect()}
    low = rows["low"]
    assert (low.status, low.invoice_number, low.total_amount) == ("success", "88", "1000")
    assert low.remarks == "LLM兜底提取: invoice_number；LLM兜底提取: total_amount"
    assert rows["high"].status == "failed" and rows["none"].status == "failed"
    assert assist.requests(docs.select("*", *[F.lit("").alias(f) for f in assist.FIELDS])).count() == len(assist.FIELDS)


def test_incremental_runs_equal_one_batch(spark, tmp_path):
    rows = [(f"{i:04d}.pdf", f"发票代码：{'A' * 10}\n发票号码：{10000000 + i % 40}\n价税合计：1.00") for i in range(100)]
    schema = "rel_path string, full_text string"
    arrivals, table, offsets = (str(tmp_path / n) for n in ("in", "table", "offsets"))

    def process(batch):
        return process_documents(batch.withColumn("source", F.lit(fv.SOURCE_TEXT)).withColumn("file_type", F.lit("pdf")).withColumn("confidence", F.lit(1.0)))

    for part in (rows[:60], rows[60:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(schema).parquet(arrivals)
        ingest.start_ingest(stream, process, table, offsets, job_id="j").awaitTermination()
    got = {r.rel_path: r.status for r in spark.read.parquet(table).collect()}
    assert got == {p: ("success" if i < 40 else "skipped") for i, (p, _) in enumerate(rows)}
    # a repeated batch replaces itself
    ingest.ingest_batch(process, table, "j")(spark.createDataFrame(rows[60:], schema), 1)
    assert spark.read.parquet(table).count() == 100
    job = ingest.job_status(spark.read.parquet(table)).first()
    assert (job.job_id, job.n_results, job.n_success, job.n_skipped, job.job_status) == ("j", 100, 40, 60, "completed")


def test_archive_stream(spark, folder, tmp_path):
    def process(batch):
        nodes = archives.shred_archives(files.archive_files(batch), root=folder)
        return outcomes(batch, tags.tagged_documents(nodes.select("rel_path").distinct(), nodes))

    table = str(tmp_path / "table")
    ingest.start_ingest(ingest.new_files(spark, folder), process, table, str(tmp_path / "o")).awaitTermination()
    got = spark.read.parquet(table)
    assert got.count() == 10 and got.filter("status = 'success'").count() == 1 and got.filter("is_dedup").count() == 1
    assert got.filter("status = 'skipped' and not is_dedup").count() == 2  # files of other kinds have rows too


def test_custom_parser_plugs_in(spark):
    import pandas as pd

    def parser(batches):
        for b in batches:
            yield pd.DataFrame({c: [None] * len(b) for c in archives.COLUMNS}).assign(
                rel_path=b["rel_path"], tag="InvoiceNo", parent_tag="Invoice", text=b["content"].map(lambda c: c.decode()))

    content = spark.createDataFrame([("a", b"77")], "rel_path string, content binary")
    values = tags.mapped_fields(archives.shred_archives(content, parser)).collect()
    assert [(v.field, v.value) for v in values] == [("invoice_number", "77")]


def test_goods_output_is_left_out_without_lines(spark, tmp_path):
    docs = spark.createDataFrame([("a", "发票号码：12345678 价税合计：1")], "rel_path string, full_text string").withColumn("source", F.lit(fv.SOURCE_TEXT))
    done = process_documents(docs).withColumns({"file_type": F.lit("pdf"), "elapsed_seconds": F.lit(0.0), "modification_time": F.current_timestamp()})
    out = str(tmp_path / "out")
    line = F.array(F.struct(*[F.lit("1").alias(f) for f in fv.GOODS_FIELDS]))
    first = sinks.write_outputs(done.withColumn("line_items", line), out)
    assert sinks.read_output(spark, out, "goods_detail").count() == 1
    sinks.write_outputs(done, out)  # no goods now, and none of the run before
    assert sinks.read_output(spark, out, "goods_detail") is None and sinks.read_output(spark, out, "accepted").count() == 1
    second = sinks.runs(spark, out)
    broken = done.withColumn("rel_path", F.when(F.col("status") == "success", F.raise_error(F.lit("full"))))
    with pytest.raises(Exception, match="full"):
        sinks.write_outputs(broken, out)
    assert sinks.runs(spark, out) == second and sinks.read_output(spark, out, "accepted").first()["文件路径"] == "a"
    sinks.write_outputs(done, out)
    assert len(sinks.runs(spark, out)) == 2 and not os.path.exists(first)  # the run before the last one stays


@pytest.mark.parametrize("form", ["{}", "file://{}", "file:{}", "{}/"])
def test_roots_and_names(spark, tmp_path, form):
    root = tmp_path / "a b%20c"
    (root / "_deep" / ".x").mkdir(parents=True)
    for name in ("c.pdf", "_hidden.pdf", ".dot.pdf", "_deep/.x/100%.pdf", "_deep/e f.txt"):
        (root / name).write_bytes(b"%PDF")
    rows = {r.rel_path: r for r in files.scan_files(spark, form.format(root), check_magic=True).collect()}
    assert set(rows) == {"c.pdf", "_hidden.pdf", ".dot.pdf", "_deep/.x/100%.pdf", "_deep/e f.txt"}
    assert rows["_deep/.x/100%.pdf"].magic_valid and rows["_deep/e f.txt"].magic_valid is None
    streamed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(form.format(root))
    seen = streamed.select(files.relative_to(spark, form.format(root)).alias("p")).collect()
    assert [r.p for r in seen if "_" not in r.p] == ["c.pdf"]


def test_files_of_any_size(spark, tmp_path):
    with open(tmp_path / "large.pdf", "wb") as file:  # sparse
        file.write(b"%PDF")
        file.truncate(3 << 30)
    (tmp_path / "none.pdf").write_bytes(b"")
    rows = {r.rel_path: (r.length, r.magic_valid) for r in files.scan_files(spark, str(tmp_path), check_magic=True).collect()}
    assert rows == {"large.pdf": (3 << 30, True), "none.pdf": (0, False)}
    assert files.scan_files(spark, str(tmp_path), skip=[]).count() == 2
    (tmp_path / "empty").mkdir()
    assert files.scan_files(spark, str(tmp_path / "empty")).count() == 0


def test_declared_encodings(spark):
    def content(encoding):
        blob = io.BytesIO()
        with zipfile.ZipFile(blob, "w") as z:
            z.writestr("Content.xml", f'<?xml version="1.0" encoding="{encoding}"?><P>发票\u00e9</P>'.encode(
                encoding if encoding != "gbk" else "gb18030"))
        return blob.getvalue()

    kinds = ["utf-8", "gbk", "gb18030", "utf-16", "big5hkscs"]
    df = spark.createDataFrame([(k, content(k)) for k in kinds], "rel_path string, content binary")
    got = {r.rel_path: r.text for r in archives.shred_archives(df).filter("tag = 'P'").collect()}
    assert got == dict.fromkeys(kinds, "发票\u00e9")


def test_two_jobs_share_a_table(spark, tmp_path):
    table = str(tmp_path / "table")

    def batch(numbers):
        return spark.createDataFrame([(f"{n}.pdf", f"发票代码：{'A' * 10}\n发票号码：{10000000 + n % 5}\n价税合计：1.00") for n in numbers],
                                     "rel_path string, full_text string")

    def process(df):
        return process_documents(df.withColumns({"source": F.lit(fv.SOURCE_TEXT), "file_type": F.lit("pdf"), "confidence": F.lit(1.0)}))

    first, second = (ingest.ingest_batch(process, table, j) for j in ("j0", "j1"))
    first(batch(range(3)), 0)
    second(batch(range(3, 10)), 0)
    first(batch(range(3)), 0)  # a repeated batch stays the first
    got = spark.read.parquet(table)
    assert got.count() == 10 and {r.job_status for r in ingest.job_status(got).collect()} == {"completed"}
    assert {r.rel_path for r in got.filter("NOT is_dedup").collect()} == {f"{n}.pdf" for n in range(5)}


def test_parser_and_paths_of_a_run(spark, tmp_path):
    (tmp_path / "in").mkdir()
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        z.writestr("invoice.xml", "<Invoice><InvoiceNo>123</InvoiceNo><TotalAmount>5</TotalAmount></Invoice>")
    (tmp_path / "in" / "a.ofd").write_bytes(blob.getvalue())
    paths = {"invoice_number": "//Invoice/InvoiceNo", "total_amount": "TotalAmount"}
    run = lambda out, **more: run_folder_to_tables(spark, str(tmp_path / "in"), str(tmp_path / out), **more).first()
    assert run("o1").status == "failed"
    row = run("o2", entries=("invoice.xml",), paths=paths)
    assert (row.status, row.invoice_number, row.total_amount) == ("success", "123", "5")

    def parser(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({c: [None] * len(b) for c in archives.COLUMNS}).assign(
                rel_path=b["rel_path"], entry_no=0, node_no=0, tag="TotalAmount", text="7")

    assert run("o3", parser=parser, paths={**paths, "invoice_number": "TotalAmount"}).invoice_number == "7"


def test_short_embedded_text_without_blocks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF")
    spans = spark.createDataFrame([("a.pdf", 0, 0, 1.0, 1.0, "short")], "rel_path string, page int, seq int, x double, y double, text string")
    row = run_folder_to_tables(spark, str(tmp_path / "in"), str(tmp_path / "out"), spans).first()
    assert row.confidence == 0.8 and fv.MSG_NO_RECOGNITION in row.error_message


def test_the_last_answer_counts(spark):
    docs = spark.createDataFrame([("low", "票", 0.5)], "rel_path string, full_text string, confidence double").withColumn("source", F.lit(fv.SOURCE_TEXT))

    def provider(requests):
        answers = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(f"total_amount={v}").alias("v")) for n, v in ((1, "9"), (2, "10"))])
        return requests.filter("field = 'total_amount'").select("rel_path", "field", F.explode(answers).alias("a")).select(
            "rel_path", "field", F.col("a.n").alias("answer_no"), F.col("a.v").alias("answer_text"))

    assert process_documents(docs, provider=provider).first().error_message != ""
    answers = assist.parse_answers(provider(assist.requests(docs.select("*", *[F.lit("").alias(f) for f in assist.FIELDS]))).withColumn("wanted", F.array("field")))
    wide = docs.select("*", *[F.lit("").alias(f) for f in assist.FIELDS], F.array().cast("array<string>").alias("validation_notes"))
    assert assist.merge_answers(wide, answers).first().total_amount == "10"
