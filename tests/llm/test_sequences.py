"""Alignment, suffix dedup and the Merkle manifest against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from billweave.llm import alignment, manifest, suffix_dedup, suffix_sort
from billweave.llm.bpe import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


# ---- alignment ------------------------------------------------------------


def tokens_of(text):
    """Ids and bytes of the tokens of both libraries; none if one of them loses bytes."""
    a_model, b_model, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_letters()
    a_model.encode_special_tokens = True
    whole = f" {text}"
    a = [(i, bytes(letters[c] for c in a_model.id_to_token(i))) for i in a_model.encode(whole, add_special_tokens=False).ids]
    b = [(i, bytes([int(b_model.id_to_piece(i)[3:-1], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode())
         for i in b_model.encode(text or "")]
    same = text and b"".join(t for _, t in a) == whole.encode() == b"".join(t for _, t in b)
    return (a, b) if same else ([], [])


def placed(tokens):
    at, out = 0, []
    for i, t in tokens:
        out.append((at, at + len(t), i))
        at += len(t)
    return out


def aligned(docs):
    rows, counts = [], Counter()
    for doc, text in docs:
        a, b = map(placed, tokens_of(text))
        links = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
        groups, ends = [], sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        for low, high in zip([0, *ends], ends):
            groups.append("|".join(",".join(str(i) for _, e, i in side if low < e <= high) for side in (a, b)))
        counts.update(links)
        rows.append((doc, len(a), len(b), len(groups), links, ";".join(groups)))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(n, best.get(y, 0))
    return sorted(((d, na, nb, ng, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
                    g, hashlib.sha256(g.encode()).hexdigest() if na else "") for d, na, nb, ng, links, g in rows), key=str)


PIECES = ["a", "b", " ", "  ", "\n", " \n", "é", "日本語", "Ω", "'s", "12", " the", "<|endoftext|>", "<s>", " ", "🙂", "\t", "​",
          "foo", "x" * 30, "\x1c", "\r\n", "<0x41>"]


def odd_texts():
    rnd = random.Random(5)
    docs = [(i, "".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 40)))) for i in range(150)]
    docs += [(900 + i, "".join(rnd.choice([*PIECES, "▁"]) for _ in range(rnd.randint(1, 20)))) for i in range(40)]
    return docs + [(2000, None), (2001, ""), (2002, " "), (2003, "word " * 300), (2004, "日本" * 200), (None, "a b"), (2003, "a b")]


@pytest.mark.parametrize("setting", [{}, {"chunk_bytes": 64}, {"most_broadcast": 50}, {"chunk_bytes": 100, "most_broadcast": 0}])
def test_alignment(spark, setting):
    docs = odd_texts()
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, N_A int")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256"]
    got = alignment.align_tokens(df, A, B, with_groups=True, **setting)
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=str) == aligned(docs)
    assert alignment.align_tokens(df.limit(0), A, B, **setting).count() == 0


def test_fragments_compose_in_any_order():
    rnd = np.random.default_rng(2)
    for size in (1, 3, 7, 50):
        lengths = [rnd.integers(1, 6, 60) for _ in range(2)]
        total = [int(x.sum()) for x in lengths]
        lengths[0][-1] += max(0, total[1] - total[0])
        lengths[1][-1] += max(0, total[0] - total[1])
        a, b = ((rnd.integers(0, 9, 60), x) for x in lengths)
        whole = alignment.closed_groups(a, b, 100)
        parts = alignment.range_fragments(a, b, size, 100)
        left = parts[0]
        for p in parts[1:]:
            left = left.then(p, 100)
        for found in (left.whole(100), alignment.reduced(parts, 100).whole(100)):
            assert (found.number, ";".join(found.text)) == (whole.number, whole.text[0])
            assert found.pairs.tolist() == whole.pairs.tolist() and found.times.tolist() == whole.times.tolist()


# ---- suffixes -------------------------------------------------------------


def plain_order(text, cap):
    order, shared = sorted(range(len(text)), key=lambda i: text[i:]), [0]
    for x, y in zip(order, order[1:]):
        n = 0
        while n < cap and text[x + n] == text[y + n]:
            n += 1
        shared.append(n)
    return order, shared


@pytest.mark.parametrize("memory", [1 << 28, 2000, 100])
def test_suffix_order(monkeypatch, memory):
    rnd = random.Random(memory)
    for trial in range(200):
        monkeypatch.setattr(suffix_sort, "SMALL", rnd.choice([2, 4, 8]))
        monkeypatch.setattr(suffix_sort, "BATCH", rnd.choice([2, 5, 16, 64]))
        letters = rnd.choice([1, 2, 3, 20])
        word = [rnd.randint(1, letters) for _ in range(rnd.randint(1, 25))]
        text = rnd.choice([
            [rnd.randint(1, letters) for _ in range(100)], word * 6,
            [c for _ in range(12) for c in [rnd.randint(1, letters)] * rnd.randint(1, 20)]]) + [0]
        cap = rnd.choice([3, 7, 400])
        with suffix_sort.Scratch(memory) as scratch:
            order, shared = suffix_sort.sorted_suffixes(np.array(text, np.int32), max(text) + 1, cap, scratch)
            assert (np.asarray(order).tolist(), np.asarray(shared).tolist()) == plain_order(text, cap)
            assert memory > 2000 or len(text) < 80 or scratch.spilled


def without_repeats(docs, length):
    held, seen, out = [(i, (t or "").encode()) for i, t in docs], Counter(), []
    for _, b in held:
        seen.update(b[k:k + length] for k in range(len(b) - length + 1))
    for i, b in held:
        gone = {q for k in range(len(b) - length + 1) if seen[b[k:k + length]] > 1 for q in range(k, k + length)}
        kept = bytes(x for q, x in enumerate(b) if q not in gone)
        out.append((i, len(b), len(gone), sum(q - 1 not in gone for q in gone), kept, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "setting"), [
    (40, {"seed": 13}), (40, {"seed": 39, "shard_bytes": 500, "memory": 20_000}), (25, {"seed": 1, "shard_bytes": 3000})])
def test_repeats_are_removed(spark, monkeypatch, length, setting):
    rnd = random.Random(1)
    pool = ["".join(rnd.choice("abcé ") for _ in range(rnd.randint(5, 80))) for _ in range(12)]
    docs = [(i, "".join(rnd.choice(pool) + rnd.choice(["", "x", "q"]) for _ in range(rnd.randint(0, 6)))) for i in range(200)]
    docs += [(400, None), (401, ""), (402, "a" * 500), (403, "ab" * 300), (404, "ab" * 300), (None, "zz"), (5, docs[5][1]),
             (405, "same once" * 30 + "q"), (406, "x" * length), (407, "".join(rnd.choice("abcdefgh") for _ in range(30_000)))]
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 256)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, KEPT string")
    got = sorted(map(tuple, suffix_dedup.remove_repeats(df, length=length, **setting).collect()), key=str)
    assert [(*r[:4], bytes(r[4]), r[5]) for r in got] == without_repeats(docs, length)
    assert suffix_dedup.remove_repeats(df.limit(0), length=length, **setting).count() == 0


def test_sizes_that_cannot_work(spark):
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string"), length=9, seed=9)


# ---- manifest -------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climbed(nodes):
    """Root, and for each leaf the siblings before and behind it, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, p in zip(paths, at):
            run = nodes[p - p % 16:p - p % 16 + 16]
            path.append((run[:p % 16], run[p % 16 + 1:]))
        nodes, at = [digest(*nodes[i:i + 16]) for i in range(0, len(nodes), 16)], [p // 16 for p in at]
    return nodes[0], paths


def proofs(rows):
    groups, out = {}, []
    for doc, source, lang, n_chars, text in rows:
        head = told(doc) + told(source) + told(lang) + told(n_chars)
        changed = doc is not None and text is not None and zlib.crc32(str(doc).encode()) % 5 == 0
        other = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if changed else text
        groups.setdefault(source, []).append((doc is not None, doc or 0, digest(head, told(text)), digest(head, told(other)), doc))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climbed([r[2] for r in sorted(groups[s])]) for s in names}
    root, tops = climbed([trees[s][0] for s in names])
    for name, top in zip(names, tops):
        subroot, paths = trees[name]
        for (_, _, leaf, other, doc), path in zip(sorted(groups[name]), paths):
            for before, behind in path + top:
                other = digest(*before, other, *behind)
            out.append((doc, leaf, subroot, root, digest(*[d for x, y in path + top for d in x + y]), other, other == root))
    return sorted(out, key=str)


def test_manifest(spark):
    rnd = random.Random(3)
    rows = [(i * 7, None if i % 11 == 0 else f"s{rnd.choice([0] * 6 + [1, 2])}", None if i % 13 == 0 else "en", i if i % 5 else None,
             None if i % 17 == 0 else f"Text É {i}\n") for i in range(6000)]
    rows += [(7, "only", None, 1, "A"), (None, "only2", "x", None, None), (7, "s0", "zz", 2, "q"), (8, "é", "", 0, "")]
    rows += [rows[5]] * 3 + [(i, f"src{i}", "a", 1, "B") for i in range(300)] + [(-9, "z" * 500, "a", 1, "Long " * 50_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, LEAF string")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = manifest.merkle_manifest(df, tampered=tampered).select(names).collect()
    assert sorted(map(tuple, got), key=str) == proofs(rows)
    assert manifest.merkle_manifest(df.limit(0)).count() == 0
    one = manifest.merkle_manifest(df.filter("source = 'only'")).first()
    assert one.root == one.leaf == one.folded_root and one.verified and one.proof_sha256 == digest()


# ---- as registered --------------------------------------------------------


def test_registered_queries(spark):
    from billweave.llm import queries

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = queries.op12_suffix_dedup(spark, SF)
    assert got.columns == names and sorted(map(tuple, got.collect()), key=str) == [
        (*r[:4], r[5]) for r in without_repeats(docs, 400)]
    got = queries.op2_bpe(spark, SF).collect()
    library = Tokenizer.from_file(A)
    for r in got:
        ids = library.encode(dict(docs)[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((dict(docs)[r.doc_id] or "").encode()).hexdigest()
    texts = [t or "" for _, t in sorted(docs)]
    for (doc, text), following, r in zip(sorted(docs), texts[1:] + texts[:1], queries.op1_fingerprints(spark, SF).orderBy("doc_id").collect()):
        text, half = text or "", len(text or "") // 2
        cut = text[:len(text) - half] + following[:half]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (doc, len(text), digest(cut)) and 0 <= min(r.near_edited, r.near_next)
    for name, least in (("op5_quality", 0.3), ("op6_toxicity", 0.5)):
        got = queries.QUERIES[name](spark, SF)
        assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(docs)
        for r in got.collect():
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= least) and 0 <= r.score <= 1
    pages = queries.op3_html_text(spark, SF)
    assert pages.columns == ["page_id", "url", "text", "n_chars"] and all(len(r.text) == r.n_chars for r in pages.collect())
