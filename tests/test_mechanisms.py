"""File source, keyed ingest, stored answers, large archive entries, flat lines."""

import io
import os
import random
import subprocess
import sys
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from billweave import fixed_values as fv
from billweave.operators import assist, flat, spread, tags
from billweave.plans.folder_run import process_documents
from billweave.plans.storage import OPEN_FILES, keep_in, remove, stored
from billweave.schemas import NODES, TAG_ENTRY
from billweave.sources import archives, file_source, files
from billweave.streaming import ingest, keyed


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "a b%20c"
    for name, content in {
            "a.pdf": b"%PDF-1", "_b.PDF": b"xx", ".c.ofd": b"PK\x03\x04", "_h/.x/d.png": b"\x89PNG", "_h/.x/deep/e.txt": b"q",
            "node_modules/z.pdf": b"%PDF", ".pdf": b"1", "_h/f.jpg": b""}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    return root


@pytest.mark.parametrize("partitions", ["1", "2", "64"])
def test_file_source_lists_what_a_scan_lists(spark, tree, partitions):
    got = file_source.read_files(spark, f"file://{tree}", headers="true", partitions=partitions)
    names = [c for c in got.columns if c != "modification_time"]
    key = lambda r: r.rel_path
    assert sorted(got.select(names).collect(), key=key) == sorted(
        files.scan_files(spark, str(tree), check_magic=True).select(names).collect(), key=key)


def test_file_source_decides_conditions(spark, tree, capsys):
    df = file_source.read_files(spark, str(tree), headers="true")
    found = df.where("file_type IN ('pdf', 'png') AND length >= 3 AND magic_valid")
    assert {r.rel_path for r in found.collect()} == {"a.pdf", "_h/.x/d.png"}
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "In(file_type" in plan and "GreaterThanOrEqual(length" in plan
    assert {r.rel_path for r in df.where(F.startswith("rel_path", F.lit("_h/.x/")) & (F.col("ext") == ".txt")).collect()} == {"_h/.x/deep/e.txt"}
    own = file_source.Tree({"path": str(tree)})
    assert list(file_source.pushed([file_source.StringStartsWith(("rel_path",), "_h/.x")], own.wanted)) == []
    assert {p.folder.rsplit("/", 1)[-1] for p in own.subtrees()} == {"a b%20c", "_h", ".x", "deep"}
    empty = file_source.Tree({"path": str(tree / "none")})
    assert [list(empty.rows(p)) for p in empty.subtrees()] == [[]]


def test_arrivals_come_once(spark, tree, tmp_path):
    def take_in():
        time.sleep(0.3)
        stream = ingest.new_files(spark, str(tree), settle="0.2")
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(
            availableNow=True).start(str(tmp_path / "t")).awaitTermination()
        return sorted(r.rel_path for r in spark.read.parquet(str(tmp_path / "t")).collect())

    first = take_in()
    assert len(first) == 7 and ".c.ofd" in first and "_h/.x/deep/e.txt" in first
    (tree / "_h" / "_new.ofd").write_bytes(b"x")
    assert take_in() == sorted([*first, "_h/_new.ofd"])
    assert take_in() == sorted([*first, "_h/_new.ofd"])


def documents(df):
    return process_documents(df.withColumns({
        "source": F.lit(fv.SOURCE_TEXT), "file_type": F.when(F.endswith("rel_path", F.lit("ofd")), "ofd").otherwise("pdf"),
        "confidence": F.lit(1.0)}))


def test_keyed_ingest(spark, tmp_path):
    text = "发票代码：" + "A" * 10 + "\n发票号码：{}\n价税合计：1.00"
    rounds = [
        [(f"{i}.pdf", text.format(10000000 + i % 5), "001") for i in range(20)] + [("x.ofd", text.format(10000001), "01")],
        [("0/a.pdf", text.format(10000000), "01"), ("b.pdf", text.format(20000000), "2024-01-01"), ("none.pdf", "nothing", "a/b")]]
    schema = "rel_path string, full_text string, job_id string"
    arrivals, table, offsets = (str(tmp_path / n) for n in ("in", "table", "offsets"))

    def take_in():
        stream = spark.readStream.schema(schema).parquet(arrivals)
        keyed.start_keyed_ingest(spark, stream, documents, table, offsets).awaitTermination()

    for rows in rounds:
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(arrivals)
        take_in()
    remove(spark, f"{offsets}/commits/1")
    take_in()  # the second batch again
    got = spark.read.parquet(table)
    kept = {r.rel_path for r in got.filter("status = 'success'").collect()}
    assert kept == {"0.pdf", "x.ofd", *(f"{min(str(i + 5 * k) for k in range(4))}.pdf" for i in (2, 3, 4)), "b.pdf"}
    assert got.count() == 24 and got.filter("status = 'failed'").count() == 1 and got.filter("is_dedup").count() == 17
    assert {r.job_id for r in ingest.job_status(got).collect()} == {"001", "01", "2024-01-01", "a/b"}
    assert dict(got.dtypes)["validation_notes"] == "array<string>"


def test_batches_keep_job_ids(spark, tmp_path):
    table, text = str(tmp_path / "table"), "发票代码：" + "A" * 10 + "\n发票号码：{}\n价税合计：1.00"
    for number, job in enumerate(["001", "01", "2024-01-01", "a/b"]):
        rows = spark.createDataFrame([(f"{job}.pdf", text.format(10000000 + number))], "rel_path string, full_text string")
        ingest.ingest_batch(documents, table, job)(rows, 0)
    status = ingest.job_status(spark.read.parquet(table)).collect()
    assert {(r.job_id, r.n_results) for r in status} == {(j, 1) for j in ("001", "01", "2024-01-01", "a/b")}


def test_answers_are_asked_once(spark, tmp_path):
    asked = spark.createDataFrame(
        [(f"{i}", "f", "s", f"text {i % 10}") for i in range(40)], "rel_path string, field string, system_text string, request_text string")
    seen, store = [], str(tmp_path / "store")

    def provider(requests):
        seen.append(requests.count())
        answer = F.when(F.lit(len(seen) > 1) | (F.col("request_text") > "text 4"), F.concat("field", F.lit("="), "request_text"))
        return requests.filter("request_text <> 'text 9'").select("rel_path", "field", answer.alias("answer_text"))

    answers, n = assist.answered(asked, provider, store, attempts=3, batch_rows=100)
    assert (n, seen) == (10 + 6 + 1, [10, 6, 1])  # five have no answer at first, one never
    assert answers.count() == 36 and answers.filter("answer_text = 'f=text 3'").count() == 4
    again, n = assist.answered(asked.filter("request_text <> 'text 9'"), provider, store)
    assert n == 0 and again.count() == 36
    assert assist.answered(asked.limit(0), provider, str(tmp_path / "none"))[0].count() == 0


ENTRY = """
import io, resource, sys, zipfile
sys.path.insert(0, sys.argv[2])
from billweave.sources import archives
n, last = 0, None
with open(sys.argv[1], "rb") as blob:
    for row in archives.rows_of("a", blob, ("Content.xml",)):
        n, last = n + 1, row
print(n, last[7], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def test_large_entry_within_little_memory(tmp_path):
    path, root = tmp_path / "large.ofd", os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    line = b'<ofd:TextObject ID="1" Boundary="0 0 1 1"><ofd:TextCode>' + b"x" * 120 + b"</ofd:TextCode></ofd:TextObject>"
    n = (200 << 20) // len(line) + 1
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z, z.open("Doc_0/Content.xml", "w", force_zip64=True) as entry:
        entry.write(f'<ofd:P xmlns:ofd="{fv.OFD_NAMESPACE}">'.encode())
        for start in range(0, n, 10_000):
            entry.write(line * min(10_000, n - start))
        entry.write(b"</ofd:P>")
    out = subprocess.run([sys.executable, "-c", ENTRY, str(path), root], capture_output=True, text=True, check=True).stdout.split()
    assert out[:2] == [str(2 * n + 2), "P"] and int(out[2]) < 500


def folded(ys, tolerance):
    lines, anchor = {}, None
    for y in sorted(set(ys)):
        if anchor is None or y - anchor > tolerance:
            anchor = y
            lines[y] = len(set(lines.values()))
        else:
            lines[y] = max(lines.values())
    return lines


def test_flat_lines_equal_the_fold(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(f"p{k}", rnd.randrange(-400, 8000) / 8) for k in range(3) for _ in range([900, 40, 1][k])]
    df = spark.createDataFrame(rows, "page string, y double")
    got = flat.line_numbers(df, ["page"], "y", 3.0, keep_in(str(tmp_path))).collect()
    expected = {p: folded([y for q, y in rows if q == p], 3.0) for p, _ in rows}
    assert sorted(map(tuple, got)) == sorted((p, y, expected[p][y]) for p, y in rows)
    assert flat.line_numbers(df.limit(0), ["page"], "y", 3.0, keep_in(str(tmp_path / "e"))).count() == 0


def test_flat_goods(spark):
    lines = ["a 1 2% 3", "货物名称", "b 1 2% 3", "x", "c S 个 2 5 10 13% 1.30", " 　", "d 1 2% 3"]
    df = spark.createDataFrame([("k", i, t) for i, t in enumerate(lines)] + [("none", 0, "e 1 2% 3"), ("open", 1, "商品名称"), ("open", 2, "f 1 2% 3")],
                               "doc string, at int, line string")
    got = flat.goods_from_lines(df, ["doc"], "at", "line").orderBy("doc", "at").collect()
    assert [(r.doc, r.at, r.goods_name, r.amount) for r in got] == [("k", 2, "b", "1"), ("k", 4, "c", "10"), ("open", 2, "f", "1")]


def test_lines_with_gaps_take_no_rounds(spark, tmp_path):
    """Where every line has a gap before it, nothing is followed, however long the page."""
    names, keep = [], keep_in(str(tmp_path))
    df = spark.createDataFrame([("p", 12.0 * line + jitter) for line in range(300) for jitter in range(3)], "page string, y double")
    got = flat.line_numbers(df, ["page"], "y", 3.0, lambda table, name: names.append(name) or keep(table, name))
    assert sorted((r.y, r.line) for r in got.collect()) == [(12.0 * line + jitter, line) for line in range(300) for jitter in range(3)]
    assert not any(name.startswith("begins") for name in names)


def test_objects_and_codes_are_one_scan(spark):
    nodes = spark.createDataFrame(
        [("a", "Content.xml", 0, 1, fv.OFD_NAMESPACE, "TextObject", {"ID": "7", "Boundary": "1 2 3 4"}, None, []),
         ("a", "Content.xml", 0, 2, fv.OFD_NAMESPACE, "TextCode", None, "x", [1]),
         ("a", "Content.xml", 0, 3, fv.OFD_NAMESPACE, "TextCode", None, None, [1]),
         ("a", "Content.xml", 0, 4, fv.OFD_NAMESPACE, "TextCode", None, "y", [1]),
         ("a", "Content.xml", 0, 5, "other", "TextCode", None, "z", [1]),
         ("a", "Tags.xml", 0, 6, fv.OFD_NAMESPACE, "TextCode", None, "z", [1])],
        "rel_path string, entry string, entry_no int, node_no int, ns string, tag string, attrs map<string,string>, text string, owners array<int>")
    for rows in (nodes, tags.with_kind(nodes)):
        objects = tags.text_objects(rows)
        assert [tuple(r) for r in objects.collect()] == [("a", 0, 1, "7", "1 2 3 4", "xy")]
        assert "Union" not in objects._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_an_entry_come_in_lists():
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        z.writestr("Content.xml", f'<o:P xmlns:o="{fv.OFD_NAMESPACE}" xmlns:q="u" q:w="1" v="2">a<!-- c -->b<o:TextObject><o:TextObject>'
                   "<o:TextCode>x<![CDATA[<y>]]></o:TextCode></o:TextObject></o:TextObject>tail<o:T><o:ObjectRef/><o:ObjectRef>3</o:ObjectRef></o:T></o:P>")
        z.writestr("OFD.xml", "<!DOCTYPE a SYSTEM 'x'><a>p&foo;</a>")
    lists = list(archives.row_lists("f", blob, archives.DEFAULT_ENTRIES))
    assert [len(rows) for rows in lists] == [1, 7, 1, 1]  # one list for an entry, not one step for each row
    got = {row[3]: row[4:] for row in lists[1]}
    ns = fv.OFD_NAMESPACE
    assert got[0] == (None, None, ns, "P", {"{u}w": "1", "v": "2"}, "ab", [], None, None)
    assert got[3] == (2, "TextObject", ns, "TextCode", {}, "x<y>", [1, 2], None, None)
    assert got[5] == (4, "T", ns, "ObjectRef", {}, None, [], 0, None) and got[6][5:] == ("3", [], 1, 0)
    assert lists[3][0][9] == "ParseError: undefined entity &foo;: line 1, column 27"
    assert list(archives.rows_of("f", blob, archives.DEFAULT_ENTRIES)) == [row for rows in lists for row in rows]


def test_tagged_fields_are_joined_once(spark):
    def node(path, entry_no, tag, parent=None, text=None, attrs=None, node_no=1, ref_no=None):
        entry = ["OFD.xml", "CustomTag.xml", "Content.xml"][entry_no]
        return (path, entry, entry_no, node_no, 0, parent, fv.OFD_NAMESPACE, tag, attrs, text, [], ref_no, ref_no)

    rows = [node(p, n, TAG_ENTRY) for p in "ab" for n in (0, 1)]
    rows += [node(p, 0, "CustomData", text=v, attrs={"Name": "发票号码"}) for p, v in (("a", "7"), ("b", "8"))]
    rows += [node("a", 1, "ObjectRef", "InvoiceNo", "1", ref_no=0)]
    texts = spark.createDataFrame([("a", "1", "9", (2, 1))], "rel_path string, object_id string, text string, first_at struct<entry_no:int,node_no:int>")
    values = tags.field_values(spark.createDataFrame(rows, NODES), texts)
    assert sorted(map(tuple, values.collect())) == [("a", "invoice_number", "9", "tag"), ("b", "invoice_number", "8", "data")]
    plan = values._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and plan.count("Join Inner") == 3  # mapping, texts, names of data


def _tagged_nodes(spark):
    """Three archives of two goods lines with unequal texts; the second tag entry and a twice used id don't count."""
    rows = []
    for path in "abc":
        def node(entry_no, node_no, tag, parent=None, text=None, attrs=None, owners=(), ref_no=None):
            name = ["OFD.xml", "CustomTag.xml", "Content.xml", "x/CustomTag.xml"][entry_no]
            rows.append((path, name, entry_no, node_no, 0, parent, fv.OFD_NAMESPACE, tag, attrs, text, list(owners), ref_no, ref_no))

        for n in range(4):
            node(n, None, TAG_ENTRY)
        for i, (tag, value) in enumerate([("Item", "i"), ("Amount", "1."), ("TaxScheme", "6%"), ("TaxAmount", ".5")]):
            for line in (0, 1):
                at = 100 + 10 * (2 * i + line)
                for k, text in enumerate(("old", value + path)):
                    node(2, at + 4 * k, "TextObject", attrs={"ID": str(at), "Boundary": f"{i} {line * 10 + 50 * (1 - k)} 1 1"})
                    node(2, at + 4 * k + 1, "TextCode", text=text, owners=[at + 4 * k])
                    node(2, at + 4 * k + 2, "TextCode", text=str(line), owners=[at + 4 * k])
                node(1, at, "ObjectRef", tag, str(at), ref_no=line)
                node(3, at, "ObjectRef", tag, "other", ref_no=line)
    return spark.createDataFrame(rows, NODES)


@pytest.mark.parametrize("most", [10**6, 3])
def test_tagged_files_by_file_and_spread(spark, tmp_path, monkeypatch, most):
    """The same lines and texts whether the rows of a file lie in one task or are dealt by their keys."""
    monkeypatch.setattr(tags, "LARGE_FILE_ROWS", most)
    keep = keep_in(str(tmp_path))
    nodes = stored(tags.with_kind(_tagged_nodes(spark)), str(tmp_path), "nodes", by="kind")
    objects, plans = tags.text_objects(nodes), []
    texts = tags.object_texts(objects)

    def lines(nodes, deal):
        found = tags.tagged_goods(nodes, tags.object_texts(tags.text_objects(nodes, deal), deal), tags.first_entries(nodes), deal)
        plans.append((deal, found._jdf.queryExecution().executedPlan().toString()))
        return found

    def page_texts(nodes, deal):
        of_files = tags.text_objects(nodes, deal)
        return tags.page_texts(of_files, tags.object_texts(of_files, deal), deal)

    got = sorted(map(tuple, tags.file_by_file(nodes, lines, keep, "lines").collect()))
    names = tags.tagged_goods(nodes, texts).columns
    assert got == sorted(map(tuple, tags.tagged_goods(nodes, texts).collect())) and len(got) == 6
    assert dict(zip(names, got[1])) == {
        "rel_path": "a", "ordinal": 1, "goods_name": "ia1", "amount": "1.a1", "tax_rate": "6%a1", "tax_amount": ".5a1"}
    assert sorted(map(tuple, tags.file_by_file(nodes, page_texts, keep, "texts").collect())) == sorted(
        map(tuple, tags.page_texts(objects, texts).collect()))
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    by_file = [plan for deal, plan in plans if deal is tags.by_file]
    assert len(by_file) == 1 and len(plans) == (1 if most > 3 else 2)
    shuffles = [line.split("hashpartitioning(")[1] for line in by_file[0].splitlines() if "Exchange hashpartitioning(" in line]
    assert shuffles and all(line.startswith("rel_path#") and line.split(",")[1].strip(" )").isdigit() for line in shuffles), shuffles


def test_rows_are_not_sorted_to_store_them_by_kind(spark, tmp_path):
    """A task has one open file for each kind while nodes are stored; else Spark sorts its rows by kind first."""
    @F.udf("string")
    def open_files(_):
        from pyspark import TaskContext

        return TaskContext.get().getLocalProperty(OPEN_FILES)

    before, nodes = spark.conf.get(OPEN_FILES), tags.with_kind(_tagged_nodes(spark)).repartition(2)
    got = stored(nodes.withColumn("ns", open_files("rel_path")), str(tmp_path), "nodes", by="kind")
    assert {int(r.ns) >= len(set(tags.KINDS.values())) + 1 for r in got.select("ns").distinct().collect()} == {True}
    same = [c for c in nodes.columns if c != "ns"]
    assert sorted(map(str, got.select(same).collect())) == sorted(map(str, nodes.select(same).collect()))
    assert spark.conf.get(OPEN_FILES) == before


@pytest.mark.parametrize("most", [10**5, 2])
def test_ordinal_by_size(spark, monkeypatch, most):
    """Small groups are numbered in one window, larger ones in levels, with the same places; null keys are a group."""
    monkeypatch.setattr(spread, "LARGE_GROUP_ROWS", most)
    rows = [(k, c, v) for k, n in (("a", 1), ("b", 2), ("c", 7), (None, 5), ("d", 0)) for v in range(n) for c in (v % 3 if v else None,)]
    df = spark.createDataFrame(rows, "k string, c int, v int").repartition(3)
    got = spread.ordinal_by_size(df, ["k"], ["c"], ["v"])
    assert sorted(map(str, got.collect())) == sorted(map(str, spread.with_ordinal(df, ["k"], ["c"], ["v"]).collect()))
    assert got.dtypes == spread.with_ordinal(df, ["k"], ["c"], ["v"]).dtypes
    assert {r.ordinal for r in got.filter("k = 'c'").collect()} == set(range(7))


def test_goods_rows_are_moved_once_to_be_numbered(spark, tmp_path):
    """Rows of line items go through one shuffle by order; where no order is large, nothing else of them is moved."""
    from billweave.plans import render

    lines = [(o, n, 1, 1, 1.0, 2.0, 0.0, 0.06) for o in range(5) for n in range(4)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, "
                          "l_extendedprice double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "a b")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    goods = render.goods(spark, str(tmp_path))
    assert sorted((r.order_key, r.item_no) for r in goods.collect()) == [(o, n + 1) for o in range(5) for n in range(4)]
    plan = goods._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") <= 2  # sizes of orders, rows by order


def test_recognised_rows_are_moved_once(spark):
    from billweave.operators import layout

    blocks = spark.createDataFrame(
        [(p, page, i, f"{p}{page}{i}", 0.5, [[10.0 * (1 - i), 20.0 * page] * 4]) for p in "ab" for page in (1, 0) for i in (0, 1)],
        "rel_path string, page int, seq int, text string, confidence double, bbox array<array<double>>")
    docs = layout.recognised_documents(blocks)
    assert sorted((r.rel_path, r.full_text) for r in docs.collect()) == [
        (p, f"{p}01\n{p}00\n{p}11\n{p}10") for p in "ab"]
    plan = docs._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning(rel_path") == plan.count("Exchange hashpartitioning(") == 1
