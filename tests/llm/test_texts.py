"""Encoding, fingerprints, page texts and archives against brute force."""

import hashlib
import random
import struct
import time
import zipfile

import public_tokenizers
import pytest
from helpers import resemblance, shingles
from tokenizers import Tokenizer

from billweave.llm import bpe, fingerprints, html_text, warc_zip

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "The", " ", "  ", "\n", " \n", "\t", "1", "é", "ß", "'s", "'ll", "$$", "\u00a0", "\u3000", "\x1c", "\x85",
          "日本", "<|endoftext|>", "🙂", "\u200b", "Ⅷ", "²", ".", "thonon"]


def random_texts(number, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 40))) for _ in range(number)]


@pytest.fixture(scope="module")
def model():
    return bpe.Model(bpe.vocabulary(VOCABULARY))


@pytest.mark.parametrize("learn", [True, False])
def test_bpe_equals_the_library(learn):
    model, library = bpe.Model(bpe.vocabulary(VOCABULARY)), Tokenizer.from_file(VOCABULARY)
    texts = [*random_texts(800), "", " ", "a" * 3000, "ab" * 2000, "x" * 64, "é" * 40]
    if learn:
        model.learn(texts)
    for text in texts:
        packed = model.encode(text)
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == ids
        assert model.decode(packed) == library.decode(ids, skip_special_tokens=False) == text


def test_merges_alike_in_both_forms(model):
    words = [w.encode() for w in random_texts(300, 2) if 0 < len(w.encode()) <= bpe.MANY]
    for word, packed in zip(words, bpe.merged_many(words, model.table), strict=True):
        one = bpe.merged([model.first[b] for b in word], model.ranks, model.result)
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == one


def test_bpe_columns(spark):
    rows = [(1, None), (2, ""), (3, "Same text"), (3, "Same text"), (None, "x" * 200_000)]
    df = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA + ", N_TOKENS int")
    got = bpe.encode_decode(df, VOCABULARY, with_text=True).collect()
    assert [r.decoded for r in got] == [t or "" for _, t in rows]
    assert [r.n_tokens for r in got[:2]] == [0, 0] and got[2][1:] == got[3][1:]
    assert got[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[0].__fields__.count("n_tokens") == 1 and "N_TOKENS" not in got[0].__fields__
    assert bpe.encode_decode(df.limit(0), VOCABULARY).count() == 0


def edited_rows(spark, docs):
    df = spark.createDataFrame(docs, SCHEMA)
    return {r.doc_id: r for r in fingerprints.edited_fingerprints(df).collect()}


def test_fingerprints_estimate_resemblance(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    docs = [(i * 7, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 900)))) for i in range(60)]
    docs += [(1000, docs[0][1]), (1001, docs[0][1]), (1002, None), (1003, ""), (1004, " \n"), (1005, "one two")]
    got, errors = edited_rows(spark, docs), []
    for n, (key, text) in enumerate(docs):
        text, following = text or "", docs[(n + 1) % len(docs)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        assert got[key].edited == edited
        errors.append(got[key].near_edited - resemblance(shingles(text), shingles(edited)))
        assert abs(got[key].near_next - resemblance(shingles(text), shingles(following))) < 0.1
    assert max(map(abs, errors)) < 0.35 and sum(map(abs, errors)) / len(errors) < 0.05
    assert got[1000].fingerprint == got[1001].fingerprint and got[1000].near_next == 1.0
    assert got[1002].fingerprint == got[1003].fingerprint == "" and got[1003].near_next == 1.0
    assert got[1004].near_next == 0.0


def test_fingerprints_of_odd_tables(spark):
    assert edited_rows(spark, []) == {}
    assert edited_rows(spark, [(5, "only one here")])[5].edited == "only on" + "only o"
    df = spark.createDataFrame([(1, "a b c", "x")] * 3, SCHEMA + ", Fingerprint string")
    rows = fingerprints.fingerprints(df).collect()
    assert len({r.fingerprint for r in rows}) == 1 and len(rows) == 3 and len(rows[0].fingerprint) == 256


def test_next_row_over_many_ranges(spark):
    keys = [None, *range(-50, 50), 10**15, 7, 7]
    df = spark.createDataFrame([(k, str(k)) for k in keys], SCHEMA)
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.next_text)
                 for r in fingerprints.with_next(df, "doc_id", ["text"]).collect())
    order = [k for k, _ in got]
    names = ["None" if not there else str(k) for there, k in order]
    assert [n for _, n in got] == [*names[1:], names[0]]


@pytest.mark.parametrize("step", [1, 1000, 10**15 + 7])
def test_next_row_of_keys_beyond_doubles(spark, step):
    keys = [2**62 + 1 + i * step for i in range(500)] + [-(2**62) - 1 - i * step for i in range(500)] + [2**63 - 1, 2**63 - 2]
    df = spark.createDataFrame([(k, str(k)) for k in keys], SCHEMA)
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(df, "doc_id", ["text"]).collect()}
    order = sorted(keys)
    assert got == {k: str(following) for k, following in zip(order, [*order[1:], order[0]], strict=True)}


PAGE = """<html><head><title>x</title></head><body><div id="header"><a href="/">Site</a> Slogan</div>
<div class="menu"><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div>
<div class="cookie-notice">We use cookies to make this site better for you all of the time.</div>
<div class="content"><h1>Title of it</h1><p>First paragraph with enough   text to be called a
paragraph by any measure &amp; more.</p><p>Short one.</p><div class="ad">Buy this now, it is good.</div>
<p>Second paragraph with <a href=x>a link</a> and enough text to be called a paragraph.</p></div>
<div id="sidebar"><p>Side text with many many words that are not part of it, really not at all.</p></div>
<section id="comments"><div class="comment"><p>I like this so much that I write a long comment about it.</p></div></section>
<form><p>Write</p><textarea>zzz</textarea></form><footer>&copy; 2020</footer></body></html>"""


def test_page_text_without_landmarks():
    assert html_text.main_text(PAGE).split("\n") == [
        "Title of it", "First paragraph with enough text to be called a paragraph by any measure & more.",
        "Short one.", "Second paragraph with a link and enough text to be called a paragraph."]


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("plain text only", "plain text only"), ("<p>a<p>b", "a\nb"),
    ('<article class="comment">x</article><p>y</p>', "y"), ("a < b and c > d &am", "a < b and c > d &am"),
    ("<nav><a>x</a><article><p>in</p></article>", "in"), ("<!-- <p>no</p> --><p>yes</p>", "yes"),
    ('<script>var t="</p>";</script><p>x</p><scr', "x"), ("<article><p>cut off &amp", "cut off &"),
    ('<div id="page" class="has-sidebar"><p>in</p></div>', "in"), ('<div class="sidebar-wrap"><p>all</p></div>', "all"),
    ('<div class="site-header"><p>Name of it</p></div><div class="entry-header"><h1>T</h1></div><p>B</p>', "T\nB"),
    ('<article><p>B</p><div class="comments"><p>r</p></div><p class="notice">n</p><p>E</p></article>', "B\nE"),
    ("<main><header><h1>T</h1></header><p>B</p><aside>s</aside><p>E</p></main><p>out</p>", "T\nB\nE"),
])
def test_page_texts(spark, page, text):
    df = spark.createDataFrame([(1, page, "old")], "page_id long, html string, TEXT string")
    (row,) = html_text.page_texts(df).collect()
    assert (row.text, row.n_chars) == (text, len(text))


def test_page_text_time_is_bounded():
    for page in ("<" * 100_000, "<a " * 50_000, "<div>" * 30_000 + "x", "<a b='" * 30_000, "<!--" * 50_000):
        html_text.main_text(page)


LONG = "Words of the article, as many as a paragraph needs to be a surge of its own among the lines of a page."


@pytest.mark.parametrize(("page", "text"), [
    ("<div><article><p>A1</p><p>A2</p></article><nav>n</nav><p>x</p><p>x</p><p>x</p><article><p>B</p></article></div>",
     "A1\nA2\nB"),
    (f"<article><p>{LONG}</p></article><div><article><p>card</p></article></div>", LONG),
    (f"<div><article><p>{LONG}</p></article></div><div><article><p>{LONG}</p></article></div>", f"{LONG}\n{LONG}"),
    (f"<main><h1>T</h1></main><div><p>{LONG}</p><p>{LONG}</p></div>", f"T\n{LONG}\n{LONG}"),
    (f"<main><p>{LONG}</p><p><a>see also</a></p></main><p>out</p>", f"{LONG}\nsee also"),
])
def test_landmarks_adjust_weights(page, text):
    assert html_text.main_text(page) == text


LINKS = "<ul><li><a>r1</a></li><li><a>r2</a></li><li><a>r3</a></li></ul>"


@pytest.mark.parametrize(("page", "text"), [
    # a marked part leaves no gap, and an unmarked one does not end the article
    (f"<div><p>{LONG}</p><p>{LONG}</p><div class='related'>{LINKS}</div><p>End of it.</p></div>",
     f"{LONG}\n{LONG}\nEnd of it."),
    (f"<div>{LINKS}</div><div><p>{LONG}</p>{LINKS}<p>End of it.</p></div><div>{LINKS}</div>",
     f"{LONG}\nr1\nr2\nr3\nEnd of it."),
    (f"<div><section><p>{LONG}</p></section>{LINKS}<section><p>End of it.</p></section></div>",
     f"{LONG}\nr1\nr2\nr3\nEnd of it."),
    (f"<section><p>{LONG}</p></section><form>{LINKS}</form><section><p>End of it.</p></section>", f"{LONG}\nEnd of it."),
    (f"<div><p>{LONG}</p><p>See <a>the whole report</a></p><p>End of it.</p></div>",
     f"{LONG}\nSee the whole report\nEnd of it."),
    # another part of the page, behind a gap, is not the article
    (f"<div><p>{LONG}</p><p>{LONG}</p></div>{LINKS}<div><p>Imprint of the site</p></div>", f"{LONG}\n{LONG}"),
])
def test_gaps_within_an_article(page, text):
    assert html_text.main_text(page) == text


ARTICLE = f"<p>{LONG}</p><p>{LONG}</p><p>{LONG}</p>"
ARTICLE_TEXT = "\n".join([LONG] * 3)


@pytest.mark.parametrize(("page", "text"), [
    (f"<h1>T</h1><div class='layout-right-sidebar'>{ARTICLE}</div>", f"T\n{ARTICLE_TEXT}"),
    (f"<h1>T</h1><div class='comments-open'>{ARTICLE}</div>", f"T\n{ARTICLE_TEXT}"),
    (f"<h1>T</h1><main class='site-main content-sidebar'>{ARTICLE}</main>", ARTICLE_TEXT),
    (f"<h1>T</h1><div class='two sidebar-right'><div class='inner-sidebar'>{ARTICLE}</div></div>", f"T\n{ARTICLE_TEXT}"),
    (f"<h1>T</h1><div id='search'>{ARTICLE}<div class='sidebar'><p>s</p></div></div>", f"T\n{ARTICLE_TEXT}"),
    (f"<h1>T</h1><div class='discussion'>{ARTICLE}</div>", f"T\n{ARTICLE_TEXT}"),
    # comments may be longer than the article, also than one whose holder has a wrong name
    (f"<div><p>{LONG}</p></div><div id='comments'>{ARTICLE * 5}</div>", LONG),
    (f"<div class='main-sidebar'><p>{LONG}</p></div><div id='comments'>{ARTICLE * 5}</div>", LONG),
    (f"<div class='page-sidebar'><p>{LONG}</p><div id='comments'>{ARTICLE * 5}</div></div>", LONG),
    (f"<div>{ARTICLE}</div><div class='sidebar'>{ARTICLE}</div>", ARTICLE_TEXT),
])
def test_names_are_weighed_against_text(page, text):
    assert html_text.main_text(page) == text


def test_filled_runs():
    assert html_text.filled_runs([]) == [] and html_text.filled_runs([0, 0, 0]) == []
    assert html_text.filled_runs([5, 0, 0, 0, 90, 3, 80, 0, 0, 0, 7]) == [(0, 1, 5), (4, 7, 173), (10, 11, 7)]


def scanned(tracks, weights, read):
    """All windows of all tracks, one by one: a line is text if it lies between the first and last weighty line of a chain of
    filled windows that has a great one."""
    sums = {(t, i): html_text.scale_of(t, read) * sum(weights[k] for k in lines[i:i + 3]) for t, lines in tracks.items() for i in range(len(lines))}
    least = max([1, *(0.25 * x for x in sums.values())])
    kept = set()
    for t, lines in tracks.items():
        for i in range(len(lines)):
            a = b = i
            while a > 0 and sums[t, a - 1] > 0:
                a -= 1
            while b < len(lines) and sums[t, b] > 0:
                b += 1
            if a < b and max(sums[t, k] for k in range(a, b)) >= least and any(weights[k] for k in lines[a:i + 1]):
                kept.add(lines[i])
    return kept


def test_surge_and_dive_decides_pages(spark, monkeypatch):
    pages = [r.html or "" for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    own = [html_text.main_text(p) for p in pages]
    monkeypatch.setattr(html_text, "surge_and_dive", scanned)
    assert [html_text.main_text(p) for p in pages] == own
    monkeypatch.setattr(html_text, "surge_and_dive", lambda tracks, weights, read: set(range(len(weights))))
    assert sum(html_text.main_text(p) != o for p, o in zip(pages, own)) > 0.9 * len(pages)


@pytest.mark.parametrize("part", ["<div></p>", "<select>", "<button>x", "<div></div></p>", "<article>", "<div class=ad>x"])
def test_a_megabyte_of_open_elements(part):
    start = time.process_time()
    html_text.main_text(part * ((1 << 20) // len(part)))
    assert time.process_time() - start < 15


def test_archives_round_trip(spark, tmp_path):
    rows = [(3, "http://a/\nb", "x"), (1, None, "x"), (2, "http://c/", None), (4, "http://d/", "y" * 100_000),
            (5, "http://e/", "x"), (None, "http://f/", "x"), (6, "http://g/", ""), (1, None, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc_zip.archive_round_trip(df, with_payload=True).collect()
    assert sorted((r.page_id or 0, r.url or "") for r in got) == sorted((i or 0, u or "") for i, u, _ in rows)
    text = {i: h or "" for i, _, h in rows}
    for r in got:
        raw = text[r.page_id].encode()
        assert r.payload_bytes == len(raw) and r.payload_digest == warc_zip.sha1_base32(raw)
        assert (r.record_type == "response") == (r.page_id in (1, 2, 4)) == (r.payload == raw)
    assert {r.page_id: r.refers_to for r in got} == {1: None, 2: None, 3: 1, 4: None, 5: 1, None: 1, 6: 2}
    assert warc_zip.archive_round_trip(df.limit(0)).count() == 0
    least = {r.page_id: r.record_type for r in warc_zip.archive_round_trip(df, min_bytes=2).collect()}
    assert set(least.values()) == {"response"}


def test_zip_directories(tmp_path):
    import pyarrow as pa

    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for n in range(70_000):  # more than 16 bits can count: a ZIP64 directory
            z.writestr(zipfile.ZipInfo(f"m{n}"), b"%d" % n)
        z.comment = b"PK\x05\x06 in a comment"
    with pa.OSFile(str(path)) as file:
        ranges = warc_zip.ZipRanges(file)
        assert len(ranges.members) == 70_000 and ranges.read("m69999") == b"69999" and ranges.read("m12345", 1, 2) == b"23"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", "x" * 100)
    with pa.OSFile(str(path)) as file, pytest.raises(ValueError, match="compressed"):
        warc_zip.ZipRanges(file).read("x")
    path.write_bytes(b"no archive")
    with pa.OSFile(str(path)) as file, pytest.raises(ValueError, match="central directory"):
        warc_zip.ZipRanges(file)
