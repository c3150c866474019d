"""Lines, contamination, near duplicates, URL rules, classifiers and the pipeline against brute force."""

import os
import random

import numpy as np
import pytest
from helpers import dropped_lines, hit_words, near_components, shingles
from pyspark.sql import functions as F

from billweave.llm import decontamination, line_dedup, near_dup, quality, toxicity, url_rules
from billweave.llm.components import components
from billweave.llm.tables import stored, work_folder

SCHEMA = "doc_id long, text string"


def test_perfect_hash_holds_every_key():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        low, high = rnd.integers(0, 1 << 63, (2, n), dtype=np.uint64)
        if n == 5000:
            low[:3] = low[3]  # equal low halves end in the list behind the arrays
        counts = rnd.integers(2, 99, n)
        shard = line_dedup.Shard(line_dedup.Shard.build(low, high, counts))
        assert shard.probe(low, high).tolist() == counts.tolist()
        assert not shard.probe(low + np.uint64(1), high + np.uint64(1)).any()


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_lines(spark, broadcast_bytes):
    rnd = random.Random(1)
    pool = ["Same Line", " same line\t", "", "x", "É", "é", "a\r", "A", "other"]
    texts = ["\n".join(rnd.choice([*pool, f"own {rnd.random()}"]) for _ in range(rnd.randint(0, 12))) for _ in range(60)]
    texts += [None, "", "\n", texts[0], texts[0], "own\n" * 3000 + "same line"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], SCHEMA + ", N_Lines int")
    for least, chars in ((3, 1), (2, 2), (100, 1)):
        got = sorted(line_dedup.line_dedup(df, least, chars, broadcast_bytes=broadcast_bytes, part_rows=50).collect())
        expected = dropped_lines(texts, least, chars)
        assert [(r.n_lines, r.n_dropped, r.kept_text) for r in got] == expected
        assert [r.text for r in got] == texts
    assert line_dedup.line_dedup(df.limit(0), broadcast_bytes=broadcast_bytes).count() == 0


def test_keys_of_copies_do_not_meet_in_one_part(spark, monkeypatch):
    copy = "\n".join(f"line {i}" for i in range(20))
    texts = [copy] * 300 + [f"own {i}\nline 0" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    seen = []

    def spied(df, folder, name):
        seen.append((name, df))
        return stored(df, folder, name)

    monkeypatch.setattr(line_dedup, "stored", spied)
    got = line_dedup.line_dedup(df, 10, broadcast_bytes=0, part_rows=100).orderBy("doc_id").collect()
    assert [(r.n_lines, r.n_dropped, r.kept_text) for r in got] == dropped_lines(texts, 10)
    keys = dict(seen)["keys"]
    assert keys.count() == keys.distinct().count() == 20 + 2 * 300
    dealt, parts = line_dedup.dealt_keys(df, 1, "text", 1, 100)
    sizes = [r["count"] for r in dealt.groupBy("shard", "part").count().collect()]
    assert parts == 7 and max(sizes) < 150


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_contamination(spark, broadcast_bytes):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(50)] + ["É", "é", "ßx", "9"]
    items = [(i, " ".join(rnd.choice(words) for _ in range(n))) for i, n in enumerate([30, 20, 13, 12, 3, 1, 0])]
    items += [(7, None), (8, items[0][1])]
    texts = [None, "", "...", "w1", items[0][1].upper(), items[3][1]]
    for _ in range(60):
        part = rnd.choice(items)[1] or ""
        own = part.split()[rnd.randint(0, 3):]
        texts.append(", ".join([*(rnd.choice(words) for _ in range(rnd.randint(0, 300))), *own]))
    texts.append(texts[-1])
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA + ", ITEMS string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(decontamination.contamination(
        df, benchmark, keep_text=True, broadcast_bytes=broadcast_bytes).collect())
    assert len(got) == len(texts)
    for row, text in zip(got, texts, strict=True):
        n, places, found = hit_words(text, items)
        assert (row.n_words, row.hit_words, row["items"], row.n_hit, row.n_items) == (
            n, places, found, len(places), len(found))
        assert row.contaminated == (len(places) > 0 and 20 * len(places) >= n)
    cleaned = {r.doc_id: r.text for r in decontamination.without_spans(decontamination.contamination(
        df, benchmark, keep_text=True)).collect()}
    for row in got:
        if row.n_hit == 0:
            assert cleaned[row.doc_id] == row.text
        else:
            assert hit_words(cleaned[row.doc_id], [])[0] == row.n_words - row.n_hit
    assert decontamination.contamination(df.limit(0), benchmark).count() == 0
    none = decontamination.contamination(df, benchmark.limit(0)).agg(F.sum("n_hit")).first()[0]
    assert none == 0


def edited(rnd, words, share):
    return [rnd.choice("abcdefgh") * rnd.randint(3, 9) if rnd.random() < share else w for w in words]


def near_texts(seed, groups=12, size=15):
    rnd = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = [f"w{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(3, 200))]
        texts += [" ".join(edited(rnd, base, rnd.choice([0, 0.005, 0.02, 0.04]))) for _ in range(size)]
    return texts


@pytest.mark.parametrize("limits", [{}, {"BUCKET": 2, "BLOCK_ROWS": 4}])
def test_near_duplicates(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(near_dup, name, value)
    texts = [*near_texts(1), None, "", " \n", "one two", "One  two", "one two three four five", "x " * 5000]
    docs = [(3 * i + 1, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*d, "c") for d in docs], SCHEMA + ", Kept string")
    got = {r.doc_id: r for r in near_dup.near_duplicates(df).collect()}
    for key, (size, component) in near_components(docs).items():
        assert (got[key].n_shingles, got[key].component_id, got[key].kept) == (size, component, key == component)


def test_near_duplicates_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (9, "a B c"), (9, "z")], SCHEMA)
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect())
    assert [(k, c, kept) for k, _, c, kept in got] == [(0, None, True), (4, 4, True), (4, 4, True), (9, 4, False), (9, 4, False)]
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_estimates_follow_resemblance():
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(edited(rnd, base, s)) for s in (0, 0.01, 0.05, 0.1, 0.3)]
    sets = [near_dup.shingles(t.encode()) for t in texts]
    packed = near_dup.longs([r.tobytes() for r in near_dup.signature(near_dup.minima(sets))])
    for estimate, text in zip(near_dup.estimates(packed[0], packed), texts, strict=True):
        a, b = shingles(texts[0]), shingles(text)
        assert abs(estimate - len(a & b) / len(a | b)) < near_dup.MARGIN


def test_components_of_a_path_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 150)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    got = {r.id: r.component for r in components(edges, work_folder(spark, "t"), "c").collect()}
    assert got == dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 130), 100) | {150: 150, 200: 150}
    assert components(edges.limit(0), work_folder(spark, "t"), "c").count() == 0


URLS = [
    ("http://Blog.Example.NET/en/x?y#z", "blog.example.net", "/en/x", "example.net/en/", "allow"),
    ("http://example.net/de/", "example.net", "/de/", "net/", "block"), ("http://net", "net", "", None, "allow"),
    ("ftp://a.example.com/de/1", "a.example.com", "/de/1", "example.com/de/", "block"),
    ("http://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"), (None, "", "", None, "allow"),
    ("example.net/en/", "", "", None, "allow"), ("", "", "", None, "allow"), ("http://", "", "", None, "allow"),
    ("http://x.org/fr/?a://b", "x.org", "/fr/", "org/fr/", "allow"), ("http://x.net?/en/", "x.net", "", None, "allow"),
    ("http://É.net/" + "x" * 50_000, "É.net", "/" + "x" * 50_000, "net/", "block"),
]
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
         ("org", "/fr/", "allow")]


@pytest.mark.parametrize("file_bytes", [1 << 20, 0])
def test_url_rules(spark, file_bytes):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    df = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate([*URLS, URLS[0]])],
                               "page_id long, url string, HOST string")
    got = sorted(url_rules.judge_urls(df, rules, file_bytes=file_bytes).select(
        "page_id", "host", "path", "rule", "verdict").collect())
    assert [tuple(r)[1:] for r in got] == [u[1:] for u in [*URLS, URLS[0]]]
    assert url_rules.judge_urls(df.limit(0), rules, file_bytes=file_bytes).count() == 0
    verdicts = url_rules.judge_urls(df, rules.limit(0), default="block", file_bytes=1).select("verdict").distinct()
    assert [r.verdict for r in verdicts.collect()] == ["block"]


def test_colliding_digests_are_told_apart(monkeypatch, tmp_path):
    monkeypatch.setattr(url_rules.xxhash, "xxh64_intdigest", lambda key: len(key))
    path = tmp_path / "rules"
    path.write_bytes(url_rules.pack_rules([("aa.com", "/", "block"), ("bb.com", "/", "allow"), ("c", "/", "block")]))
    rules = url_rules.Rules(str(path))
    won = rules.match([(b"bb.com", b"/x"), (b"cc.com", b"/"), (b"x.aa.com", b"/")])
    assert [None if w < 0 else rules.key(w) for w in won] == [b"bb.com/", None, b"aa.com/"]


def labelled(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(rows)], SCHEMA + ", SCORE string")
    labels = spark.createDataFrame([(i, y, y) for i, (_, y) in enumerate(rows) if y is not None],
                                   "doc_id long, quality int, toxic int")
    return docs, labels


def held_out_accuracy(rows, got):
    right = [r.predicted == rows[r.doc_id][1] for r in got if r.held_out and rows[r.doc_id][1] is not None]
    assert len(right) > 20
    return sum(right) / len(right)


def test_quality_learns_and_takes_any_text(spark):
    rnd = random.Random(4)
    words = [rnd.choice("bcdfg") + rnd.choice("aeiou") * rnd.randint(1, 3) + rnd.choice("lmnrst") for _ in range(200)]

    def prose(mark=""):
        return " ".join(rnd.choice(words) + mark for _ in range(rnd.randint(20, 200))) + "."

    rows = [(prose(), 1) if rnd.random() < 0.7 else (prose("$$$"), 0) for _ in range(300)]
    rows += [(None, None), ("", None), ("x" * 300_000, None), rows[0]]
    docs, labels = labelled(spark, rows)
    got = quality.quality_scores(docs, labels).collect()
    assert held_out_accuracy(rows, got) > 0.95 and len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[len(rows) - 1].score == by_id[0].score
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_additive_tables_find_an_interaction():
    rnd = np.random.default_rng(7)
    x = rnd.random((4000, len(quality.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert (5, 2) in model.pairs
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_toxicity_learns_and_locates(spark):
    rnd = random.Random(6)
    words = [f"{a}{b}" for a in "lorem ipsum dolor sit amet".split() for b in "abcdefghij"]

    def sentence(*bad):
        own = [rnd.choice(words) for _ in range(8)] + list(bad)
        rnd.shuffle(own)
        return " ".join(own)

    rows = []
    for _ in range(400):
        toxic = rnd.random() < 0.3
        parts = [sentence() for _ in range(rnd.randint(1, 12))]
        if toxic:
            parts.insert(rnd.randint(0, len(parts)), sentence("zorg" + rnd.choice(["", "on", "ish", "ul"])))
        rows.append((". ".join(parts) + ".", int(toxic)))
    rows += [(None, None), ("", None), ("...", None), ("amet " * 50_000, None), rows[0]]
    docs, labels = labelled(spark, rows)
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert held_out_accuracy(rows, got) > 0.95 and len(got) == len(rows)
    for r in got:
        text, label = rows[r.doc_id]
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        for s in r.offending:
            assert text[s.begin:s.end] == s.sentence
            if label and r.predicted:
                assert "zorg" in s.sentence
    assert [r.score for r in got if r.doc_id in (400, 401, 402)] == [0.0, 0.0, 0.0]
    assert max(r.score for r in toxicity.toxicity_scores(docs, labels.limit(0)).collect()) < 1e-6
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables")
def test_pipeline_against_plain_python(spark):
    import corpus_pipeline as pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert [name for name, _ in pipeline.STAGES] == ["quality", "lines", "near", "decontamination", "tokens"]
    scored = quality.quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)
    kept = {r.doc_id: r.text for r in scored.where("predicted = 1").collect()}
    assert 0 < len(kept) < docs.count()
    lines = dict(zip(kept, (x for _, _, x in dropped_lines(kept.values(), 10)), strict=True))
    least = near_components(lines.items())
    lines = {k: t for k, t in lines.items() if least[k][1] == k}
    clean = {}
    for key, text in lines.items():
        n, places, _ = hit_words(text, items)
        if not places or 20 * len(places) < n:
            clean[key] = text
    got = {r.doc_id: r for r in pipeline.run(spark, sf_dir).collect()}
    import hashlib

    assert {k: r.decoded_sha256 for k, r in got.items()} == {
        k: hashlib.sha256(t.encode()).hexdigest() for k, t in clean.items()}
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == pipeline.COLUMNS


def registered():
    from billweave.llm.queries import CHECK_SQL

    return list(CHECK_SQL)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables")
@pytest.mark.parametrize("name", registered())
def test_query_equals_its_sql(spark, name):
    from billweave.llm.queries import CHECK_SQL, QUERIES
    from oracle import connect, differences

    sf_dir = "/root/testdata/sf0.001"
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), CHECK_SQL[name]) == ""


def test_long_hosts_and_texts(spark):
    dots, deep = "a." * 100_000, "." * 200_000
    urls = [f"http://{dots}example.net/en/x", f"http://{deep}net/", f"http://{'x' * 200_000}.org/fr/", f"http://{deep}"]
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/", "block")],
                                  "host string, path string, verdict string")
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for file_bytes in (1 << 20, 0):
        got = url_rules.judge_urls(df, rules, file_bytes=file_bytes).orderBy("page_id").select("rule", "verdict").collect()
        assert [tuple(r) for r in got] == [("example.net/en/", "allow"), ("net/", "block"), ("org/fr/", "block"), (None, "allow")]
    own, words = "w " * 150_000, " ".join(f"b{i}" for i in range(20))
    docs = spark.createDataFrame([(1, own + words), (2, own)], SCHEMA)
    benchmark = spark.createDataFrame([(9, words)], "item_id long, text string")
    got = decontamination.contamination(docs, benchmark).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got] == [(150_020, 20, 1, False), (150_000, 0, 0, False)]


def test_window_that_all_items_share(spark):
    prompt = " ".join(f"p{i}" for i in range(13))
    items = [(i, f"{prompt} own{i} tail{i}") for i in range(300)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, prompt), (2, f"{prompt} own7 tail7"), (3, "p1 p2")], SCHEMA)
    got = {r.doc_id: r for r in decontamination.contamination(docs, benchmark).collect()}
    assert got[1]["items"] == got[2]["items"] == sorted(str(i) for i in range(300)) and got[3]["items"] == []
    assert [got[i].n_hit for i in (1, 2, 3)] == [13, 15, 0]


def test_noisy_or_of_sentences():
    margins = [-3.0, 0.5, 2.0, -40.0]
    chances = [1 / (1 + np.exp(-max(-30.0, m))) for m in margins]
    assert abs(toxicity.noisy_or(margins) - (1 - np.prod([1 - c for c in chances]))) < 1e-12 and toxicity.noisy_or([]) == 0


def test_sample_is_bounded_by_text(spark):
    rows = [(i, "word " * 100, i % 2) for i in range(50)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int")
    assert toxicity.within(sample, "doc_id", "text", 500 * 20 + 1).count() == 20
    assert toxicity.within(sample, "doc_id", "text", 10).count() == 0
