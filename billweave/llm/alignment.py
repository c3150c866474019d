"""Alignment of the tokens of two tokenizers over the same texts.

Token ends that both tokenizers share cut a text into groups. Any byte range of a text is a fragment: the tokens up to
its first shared end (open prefix), the groups closed inside it, the tokens behind its last shared end (open suffix).
Fragments of neighbouring ranges compose associatively, a suffix and the prefix behind it closing one group, so the
fragments of a very long text, made by many tasks, are reduced as a tree. A short text is one range.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from billweave.llm.bpe import byte_letters
from billweave.llm.tables import bounded_batches, stored, work_folder

CHUNK_BYTES = 64 << 10
RANGE_BYTES = 16 << 10
ARITY = 8
CACHED_PIECES, CACHED_LENGTH = 150_000, 64
MOST_BROADCAST = 1 << 21

#: White space, or an end, behind a space or at the begin: not every space stands in front of a piece.
MORE_SPACE = re.compile(r"(?:^| )(?:\s|$)")

Tokens = tuple[np.ndarray, np.ndarray]  # ids and byte lengths


def no_tokens() -> Tokens:
    return np.empty(0, np.int64), np.empty(0, np.int64)


def joined(x: Tokens, y: Tokens) -> Tokens:
    return np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]])


@dataclass
class Groups:
    """Closed groups: their number, their text, and the links in them as (a id << 32 | b id), each with its count."""

    number: int
    text: list[str]
    pairs: np.ndarray
    times: np.ndarray

    @staticmethod
    def none() -> Groups:
        return Groups(0, [], np.empty(0, np.int64), np.empty(0, np.int64))

    def __add__(self, other: Groups) -> Groups:
        return Groups(self.number + other.number, self.text + other.text,
                      *counted(np.concatenate([self.pairs, other.pairs]), np.concatenate([self.times, other.times])))


def counted(pairs: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    own, place = np.unique(pairs, return_inverse=True)
    return own, np.bincount(place, times, len(own)).astype(np.int64)


def shared_ends(a: Tokens, b: Tokens, a_first: int = 0, b_first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of all tokens of both, and the ends they share; the first tokens end at their length less what lies before."""
    a_ends, b_ends = np.cumsum(a[1]) + a_first, np.cumsum(b[1]) + b_first
    return a_ends, b_ends, np.intersect1d(a_ends, b_ends, assume_unique=True)


def links_of(a: Tokens, b: Tokens, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the a token, and a id << 32 | b id, of all pairs with overlapping byte ranges, both sides
    beginning at one place."""
    first = np.searchsorted(b_ends, a_ends - a[1], side="right")
    last = np.searchsorted(b_ends, a_ends, side="left")
    count = last - first + 1
    at = np.repeat(np.arange(len(count)), count)
    other = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + first[at]
    return at, a[0][at] << 32 | b[0][other]


@functools.lru_cache(maxsize=2)
def names(largest: int) -> list[str]:
    """Ids as text with the mark behind them, by mark: comma, bar, semicolon."""
    return [f"{i}{mark}" for mark in ",|;" for i in range(largest)]


def groups_text(a: Tokens, b: Tokens, a_group: np.ndarray, b_group: np.ndarray, largest: int) -> list[str]:
    """For each token, in the order of groups and there a before b, its id and the mark behind it."""
    a_last = np.append(a_group[1:] != a_group[:-1], True)
    b_last = np.append(b_group[1:] != b_group[:-1], True)
    codes = np.concatenate([a[0] + largest * a_last, b[0] + 2 * largest * b_last])
    order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
    table = names(largest)
    return [table[i] for i in codes[order].tolist()]


def closed_groups(a: Tokens, b: Tokens, largest: int) -> Groups:
    """Groups of tokens that begin at one place and end at one place."""
    if not len(a[0]):
        return Groups.none()
    a_ends, b_ends, shared = shared_ends(a, b)
    a_group, b_group = np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends)
    text = "".join(groups_text(a, b, a_group, b_group, largest))
    return Groups(len(shared), [text[:-1]], *counted(links_of(a, b, a_ends, b_ends)[1]))


@dataclass
class Fragment:
    """One byte range: ``head`` and ``tail`` are the open tokens of a and of b; without a shared end all are in ``head``."""

    closed: bool
    head: tuple[Tokens, Tokens]
    groups: Groups
    tail: tuple[Tokens, Tokens]

    @staticmethod
    def of(a: Tokens, b: Tokens, a_first: int, b_first: int, largest: int) -> Fragment:
        """Fragment of the tokens that end in a range; ``a_first`` is where the first a token begins, seen from any fixed place."""
        a_ends, b_ends, shared = shared_ends(a, b, a_first, b_first)
        nothing = (no_tokens(), no_tokens())
        if not len(shared):
            return Fragment(False, (a, b), Groups.none(), nothing)
        (a1, a2), (b1, b2) = ((np.searchsorted(e, [shared[0], shared[-1]]) + 1).tolist() for e in (a_ends, b_ends))
        cut = [tuple((x[0][i:j], x[1][i:j]) for x, i, j in ((a, *p), (b, *q)))
               for p, q in (((0, a1), (0, b1)), ((a1, a2), (b1, b2)), ((a2, None), (b2, None)))]
        return Fragment(True, cut[0], closed_groups(*cut[1], largest), cut[2])

    def then(self, other: Fragment, largest: int) -> Fragment:
        """Composition with the fragment of the range behind this one; associative."""
        if not self.closed:
            return Fragment(other.closed, both(self.head, other.head), other.groups, other.tail)
        if not other.closed:
            return Fragment(True, self.head, self.groups, both(self.tail, other.head))
        between = closed_groups(*both(self.tail, other.head), largest)
        return Fragment(True, self.head, self.groups + between + other.groups, other.tail)

    def whole(self, largest: int) -> Groups:
        """Groups of a whole text, whose begin is a shared place as well."""
        return closed_groups(*self.head, largest) + self.groups


def both(x: tuple[Tokens, Tokens], y: tuple[Tokens, Tokens]) -> tuple[Tokens, Tokens]:
    return joined(x[0], y[0]), joined(x[1], y[1])


def reduced(fragments: list[Fragment], largest: int) -> Fragment:
    """Neighbours composed two by two until one is left."""
    while len(fragments) > 1:
        pairs = zip(fragments[::2], fragments[1::2], strict=False)
        fragments = [x.then(y, largest) for x, y in pairs] + fragments[len(fragments) // 2 * 2:]
    return fragments[0]


def range_fragments(a: Tokens, b: Tokens, size: int, largest: int) -> list[Fragment]:
    """Fragments of the byte ranges of ``size`` bytes; a token is part of the range in which it ends."""
    a_ends, b_ends = np.cumsum(a[1]), np.cumsum(b[1])
    borders = np.arange(size, int(a_ends[-1]), size)
    i, j = ([0, *np.searchsorted(e, borders, side="right").tolist(), len(e)] for e in (a_ends, b_ends))
    return [
        Fragment.of((a[0][i[k]:i[k + 1]], a[1][i[k]:i[k + 1]]), (b[0][j[k]:j[k + 1]], b[1][j[k]:j[k + 1]]),
                    int(a_ends[i[k] - 1]) if i[k] else 0, int(b_ends[j[k] - 1]) if j[k] else 0, largest)
        for k in range(len(i) - 1)]


class TwoTokenizers:
    """Both encoders with the bytes of their tokens, and ids of pieces of text that were met.

    A piece begins with a space between a character that is no space and a visible one: no byte-level pre-token and no piece of the
    other vocabulary (which has the space mark in front only) crosses such a place, so pieces can be encoded one by one.
    """

    def __init__(self, byte_level: str, pieces: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_level)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        letters, data = byte_letters(), json.loads(byte_level)
        own = {i: bytes(letters[c] for c in t) for t, i in data["model"]["vocab"].items()}
        own |= {t["id"]: t["content"].encode() for t in data["added_tokens"]}
        self.a_bytes = [own.get(i, b"") for i in range(max(own) + 1)]
        marks = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in m.lstrip("▁") for m in marks):
            raise ValueError("a vocabulary with spaces inside pieces can't be encoded piece by piece")
        self.b_bytes = [bytes([int(m[3:-1], 16)]) if self.b.is_byte(i) else m.replace("▁", " ").encode()
                        for i, m in enumerate(marks)]
        self.a_length, self.b_length = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.largest = max(len(self.a_bytes), len(self.b_bytes))
        self.known_a: dict[str, bytes | None] = {}
        self.known_b: dict[str, bytes] = {}

    @staticmethod
    def pieces(text: str) -> list[str]:
        """Pieces of a space and a text, each without its first space."""
        parts = text.split(" ")
        if not MORE_SPACE.search(text):
            return parts
        pieces = [parts[0]]
        for p in parts[1:]:
            if p and not p[0].isspace() and pieces[-1] and pieces[-1][-1] != " ":
                pieces.append(p)
            else:
                pieces[-1] += " " + p
        return pieces

    def learn(self, wanted: set[str]) -> None:
        new = list(wanted.difference(self.known_a))
        for start in range(0, len(new), 20_000):
            part = new[start:start + 20_000]
            spaced = [" " + p for p in part]
            raw = [p.encode() for p in spaced]
            length = np.array([len(r) for r in raw], np.int64)
            sides = ([e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)], self.b.encode(part, num_threads=1))
            same = np.ones(len(part), bool)
            for ids, token_bytes, sizes, known in zip(
                    sides, (self.a_bytes, self.b_bytes), (self.a_length, self.b_length), (self.known_a, self.known_b), strict=True):
                flat = np.fromiter(chain.from_iterable(ids), np.int32)
                ends = np.cumsum(np.fromiter(map(len, ids), np.int64))
                packed, cuts = flat.tobytes(), (4 * ends).tolist()
                known.update(zip(part, map(packed.__getitem__, map(slice, [0, *cuts], cuts)), strict=True))
                size = np.add.reduceat(sizes[flat], np.append(0, ends[:-1]))
                if (size != length).any() or b"".join(map(token_bytes.__getitem__, flat.tolist())) != b"".join(raw):
                    same &= [b"".join([token_bytes[t] for t in i]) == r for i, r in zip(ids, raw, strict=True)]
            self.known_a.update((part[i], None) for i in np.flatnonzero(~same).tolist())

    def forget(self, wanted: set[str]) -> None:
        """Keep short pieces; if they are too many, those met last."""
        known = wanted if len(self.known_a) > CACHED_PIECES else self.known_a
        if known is wanted or any(len(p) > CACHED_LENGTH for p in wanted):
            kept = [p for p in known if len(p) <= CACHED_LENGTH]
            self.known_a, self.known_b = ({p: k[p] for p in kept} for k in (self.known_a, self.known_b))

    def tokens(self, texts: list[list[str]]) -> tuple[list[bool], Tokens, Tokens, np.ndarray, np.ndarray]:
        """Of texts in pieces: which keep their bytes, the tokens of these one behind the other, and the numbers of
        tokens of each."""
        wanted = set().union(*texts)
        self.learn(wanted)
        kept, a, b = [], [], []
        for pieces in texts:
            try:
                own = b"".join(map(self.known_a.__getitem__, pieces))
            except TypeError:  # a piece that loses bytes
                kept.append(False)
                continue
            kept.append(True)
            a.append(own)
            b.append(b"".join(map(self.known_b.__getitem__, pieces)))
        a_ids, b_ids = (np.frombuffer(b"".join(x), np.int32).astype(np.int64) for x in (a, b))
        sizes = [np.array([len(x) // 4 for x in side], np.int64) for side in (a, b)]
        self.forget(wanted)
        return kept, (a_ids, self.a_length[a_ids]), (b_ids, self.b_length[b_ids]), *sizes


@functools.lru_cache(maxsize=1)
def two_tokenizers(byte_level: str, pieces: bytes) -> TwoTokenizers:
    return TwoTokenizers(byte_level, pieces)


LONGS = ArrayType(LongType(), False)
RESULT = [StructField("n_a", LongType()), StructField("n_b", LongType()), StructField("n_groups", LongType()),
          StructField("n_links", LongType()), StructField("groups", StringType()), StructField("pairs", LONGS),
          StructField("times", LONGS)]
OPEN = [StructField(f"{part}_{side}", LONGS) for part in ("head", "tail")
        for side in ("a", "a_length", "b", "b_length")]
FRAGMENT = [StructField("same", BooleanType()), StructField("closed", BooleanType()), *RESULT, *OPEN]
NOTHING = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups": "", "pairs": [], "times": []}


def text_results(model: TwoTokenizers, texts: list[str]) -> Iterator[dict]:
    """Results of texts, each one byte range; all texts together are laid out as one, as each ends at a shared place."""
    split = [model.pieces(t) if t else [] for t in texts]
    kept, a, b, a_size, b_size = model.tokens(split)
    kept = [k and bool(t) for k, t in zip(kept, texts, strict=True)]
    some = a_size > 0
    a_size, b_size = a_size[some], b_size[some]
    a_ends, b_ends, shared = shared_ends(a, b)
    a_group, b_group = np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends)
    words = groups_text(a, b, a_group, b_group, model.largest) if len(a[0]) else []
    at, pairs = links_of(a, b, a_ends, b_ends)
    a_to, b_to = np.cumsum(a_size), np.cumsum(b_size)
    l_to = np.searchsorted(at, a_to)
    g_to = a_group[a_to - 1] + 1
    i = n_a = n_b = n_l = n_g = 0
    for own in kept:
        if not own:
            yield NOTHING
            continue
        a2, b2, l2, g2 = int(a_to[i]), int(b_to[i]), int(l_to[i]), int(g_to[i])
        known, times = counted(pairs[n_l:l2])
        yield {"n_a": a2 - n_a, "n_b": b2 - n_b, "n_groups": g2 - n_g, "n_links": l2 - n_l,
               "groups": "".join(words[n_a + n_b:a2 + b2])[:-1], "pairs": known, "times": times}
        i, n_a, n_b, n_l, n_g = i + 1, a2, b2, l2, g2


def fragment_row(fragment: Fragment, n_a: int, n_b: int) -> dict:
    g = fragment.groups
    row = {"same": True, "closed": fragment.closed, "n_a": n_a, "n_b": n_b, "n_groups": g.number,
           "n_links": int(g.times.sum()), "groups": ";".join(g.text), "pairs": g.pairs, "times": g.times}
    for part, (a, b) in (("head", fragment.head), ("tail", fragment.tail)):
        row |= {f"{part}_a": a[0], f"{part}_a_length": a[1], f"{part}_b": b[0], f"{part}_b_length": b[1]}
    return row


def fragment_from(row: dict) -> Fragment:
    def tokens(part: str) -> tuple[Tokens, Tokens]:
        return tuple((np.asarray(row[f"{part}_{s}"], np.int64), np.asarray(row[f"{part}_{s}_length"], np.int64)) for s in "ab")

    groups = Groups(row["n_groups"], [row["groups"]] if row["n_groups"] else [],
                    np.asarray(row["pairs"], np.int64), np.asarray(row["times"], np.int64))
    return Fragment(row["closed"], tokens("head"), groups, tokens("tail"))


LOST = {"same": False, "closed": False, **NOTHING, **{f.name: [] for f in OPEN}}


def chunk_fragment(model: TwoTokenizers, text: str) -> dict:
    """Fragment of one chunk of a long text, reduced from those of its byte ranges."""
    kept, a, b, _, _ = model.tokens([model.pieces(text)])
    if not kept[0]:
        return LOST
    fragment = reduced(range_fragments(a, b, RANGE_BYTES, model.largest), model.largest)
    return fragment_row(fragment, len(a[0]), len(b[0]))


def chunks(text: str, size: int) -> Iterator[str]:
    """Cuts a text in front of spaces that stand between visible characters, at least ``size`` characters apart;
    each chunk but the first loses that space, which the encoders add again."""
    start = 0
    while True:
        at = start + size
        while (at := text.find(" ", at)) >= 0 and (
                at + 1 >= len(text) or text[at + 1].isspace() or text[at - 1].isspace()):
            at += 1
        if at < 0:
            yield text[start:]
            return
        yield text[start:at]
        start = at + 1


def composed(rows: list[dict], largest: int) -> dict:
    """One row from the fragments of neighbouring chunks, given in order."""
    if not all(r["same"] for r in rows):
        return LOST
    whole = reduced([fragment_from(r) for r in rows], largest)
    return fragment_row(whole, sum(r["n_a"] for r in rows), sum(r["n_b"] for r in rows))


def finished(row: dict, largest: int) -> dict:
    if not row["same"]:
        return NOTHING
    g = fragment_from(row).whole(largest)
    return {"n_a": row["n_a"], "n_b": row["n_b"], "n_groups": g.number, "n_links": int(g.times.sum()),
            "groups": ";".join(g.text), "pairs": g.pairs, "times": g.times}


def arrow_rows(rows: list[dict], fields: list[StructField]) -> list[pa.Array]:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}
    return [pa.array([r[f.name] for r in rows], kinds[f.dataType.simpleString()]) for f in fields]


def short_texts(texts: DataFrame, tokenizers) -> DataFrame:
    """``id`` and results of texts of one range each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = two_tokenizers(*tokenizers.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = list(text_results(model, [t or "" for t in part.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column(0), *arrow_rows(rows, RESULT)], names=labels)

    labels = ["id", *[f.name for f in RESULT]]
    return texts.mapInArrow(run, StructType([texts.schema["id"], *RESULT]))


def long_texts(texts: DataFrame, tokenizers, chunk_bytes: int, keep) -> DataFrame:
    """The same of longer texts: chunks are dealt over tasks, their fragments reduced as a tree of ``ARITY``."""
    keys = StructType([StructField("text_no", LongType()), StructField("chunk", LongType()), StructField("n", LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = list(chunks(text, chunk_bytes))
                for k, part in enumerate(parts):
                    yield pa.RecordBatch.from_pylist([{"text_no": number, "chunk": k, "n": len(parts), "part": part}])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = two_tokenizers(*tokenizers.value)
        for batch in batches:
            for k in range(batch.num_rows):
                row = arrow_rows([chunk_fragment(model, batch.column(3)[k].as_py())], FRAGMENT)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(k, 1) for c in range(3)], *row], names=labels)

    def merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk").to_dict("records")
        row = composed(rows, two_tokenizers(*tokenizers.value).largest)
        return pd.DataFrame([{"text_no": key[0], "chunk": key[1], "n": -(-rows[0]["n"] // ARITY), **row}])

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        largest = two_tokenizers(*tokenizers.value).largest
        for batch in batches:
            rows = [finished(r, largest) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("text_no"), *arrow_rows(rows, RESULT)],
                                             names=["text_no", *[f.name for f in RESULT]])

    numbered = keep(texts.withColumn("text_no", F.monotonically_increasing_id()), "long")
    parts = numbered.select("text_no", "text").mapInArrow(cut, StructType([*keys.fields, StructField("part", StringType())]))
    whole = StructType([*keys.fields, *FRAGMENT])
    labels = whole.names
    level = keep(parts.repartition("text_no", "chunk").mapInArrow(encoded, whole), "fragments-0")
    number = 0
    while (level.agg(F.max("n")).first()[0] or 0) > 1:
        number += 1
        level = keep(level.groupBy("text_no", F.floor(F.col("chunk") / ARITY).alias("_chunk")).applyInPandas(merged, whole),
                     f"fragments-{number}")
    results = level.mapInArrow(ended, StructType([StructField("text_no", LongType()), *RESULT]))
    return numbered.select("id", "text_no").join(results, "text_no").drop("text_no")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, count, best``: links of an id pair in all texts, and whether no pair of its b id has more."""
    links = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("l"))
    counts = links.groupBy(F.col("l.pairs").alias("pair")).agg(F.sum("l.times").alias("count"))
    counts = counts.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    return counts.join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def with_counts(aligned: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """Adds ``n_best`` and ``count_sum``.

    All pairs are broadcast if they are at most ``most``; else those with at least a share of 1 / ``most`` of all links, of
    which there can't be more. Links of the others, none of which is frequent, are joined with their counts.
    """
    spark = aligned.sparkSession
    n_pairs, n_links = counts.agg(F.count(F.lit(1)), F.sum("count")).first()
    frequent = counts if n_pairs <= most else counts.where(F.col("count") * most >= n_links)
    held = frequent.orderBy("pair").toArrow()
    sent = spark.sparkContext.broadcast([held.column(c).to_numpy() for c in ("pair", "count", "best")])
    added = [StructField("n_best", LongType()), StructField("count_sum", LongType()), StructField("rest", LONGS),
             StructField("rest_times", LONGS)]
    schema = StructType([f for f in aligned.schema.fields if f.name not in ("pairs", "times")] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = sent.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            ends = pairs.offsets.to_numpy() - pairs.offsets[0].as_py()
            own, n = pairs.flatten().to_numpy(), times.flatten().to_numpy()
            at = np.minimum(np.searchsorted(pair, own), max(len(pair) - 1, 0))
            here = pair[at] == own if len(pair) else np.zeros(len(own), bool)

            def summed(values: np.ndarray) -> pa.Array:
                return pa.array(np.diff(np.concatenate([[0], np.cumsum(values)])[ends]), pa.int64())

            n_best, count_sum = (summed(n * here * x[at]) if len(pair) else summed(np.zeros(len(own), np.int64))
                                 for x in (best, count))
            offsets = pa.array(np.concatenate([[0], np.cumsum(~here)])[ends], pa.int32())
            rest = [pa.ListArray.from_arrays(offsets, pa.array(x[~here], pa.int64())) for x in (own, n)]
            kept = [batch.column(c) for c in schema.names[:-4]]
            yield pa.RecordBatch.from_arrays([*kept, n_best, count_sum, *rest], names=schema.names)

    summed = aligned.mapInArrow(run, schema)
    if n_pairs <= most:
        return summed.drop("rest", "rest_times")
    summed = stored(summed.withColumn("text_no", F.monotonically_increasing_id()), work_folder(spark, "alignment"), "summed")
    rest = summed.select("text_no", F.explode(F.arrays_zip("rest", "rest_times")).alias("l")).select(
        "text_no", F.col("l.rest").alias("pair"), F.col("l.rest_times").alias("n"))
    more = rest.join(counts, "pair").groupBy("text_no").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("count")).alias("more"))
    return summed.join(more, "text_no", "left").withColumns({
        "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)),
        "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))}).drop("text_no", "rest", "rest_times", "more_best", "more")


def align_tokens(
    df: DataFrame, byte_level_file: str, piece_file: str, id_column: str = "doc_id", text: str = "text",
    chunk_bytes: int = CHUNK_BYTES, most_broadcast: int = MOST_BROADCAST, with_groups: bool = False,
) -> DataFrame:
    """Align the tokens of a byte-level vocabulary (a, over a space and the text) and of a piece vocabulary (b).

    Result, one row for each input row: ``id_column``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``,
    ``groups_sha256`` (empty without tokens) and on demand ``groups`` (``a1,a2|b1;a3|b2,b3``). Null and empty texts, and texts
    whose bytes one of the tokenizers does not keep, have no tokens. Repeated rows give equal results, and each counts in the corpus
    counts; ties count as best; an empty table gives an empty one; further columns are left out. Files are read by
    the driver and broadcast (two megabytes).
    """
    spark = df.sparkSession
    bounded_batches(spark)
    folder = work_folder(spark, "alignment")

    def keep(made: DataFrame, name: str) -> DataFrame:
        return stored(made, folder, name)

    with open(byte_level_file, encoding="utf-8") as a, open(piece_file, "rb") as b:
        tokenizers = spark.sparkContext.broadcast((a.read(), b.read()))
    texts = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text"))
    is_long = F.coalesce(F.octet_length("text") > chunk_bytes, F.lit(False))
    short = short_texts(texts.where(~is_long), tokenizers)
    both_kinds = short.unionByName(long_texts(texts.where(is_long), tokenizers, chunk_bytes, keep))
    aligned = keep(both_kinds.select(
        "id", "n_a", "n_b", "n_groups", "n_links", *(["groups"] if with_groups else []),
        F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"), "pairs", "times"), "aligned")
    counts = keep(pair_counts(aligned), "counts")
    return with_counts(aligned, counts, most_broadcast).withColumnRenamed("id", id_column)
