"""Removal of lines that many documents share, by a sharded minimal perfect hash.

Every line key is a 128-bit hash; how many documents hold it is counted with map-side
combine. Keys held by at least two documents (others can never be dropped) are dealt into
shards, and each shard becomes one binary: a minimal perfect hash over the low halves of
its keys, an array of fingerprints (the high halves) and an array of counts. Documents
probe these arrays, so no text and no line meets another one in a join.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from billweave.llm.tables import stored, texts, with_python_columns, without, work_folder

BLANKS = b" \t\n\x0b\x0c\r"
MOST_COUNT = 2**32 - 1


def lines_and_keys(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """Lines, and their keys: ends stripped of ASCII white space, A-Z in lower case."""
    return text.split(b"\n"), [key.strip(BLANKS) for key in text.lower().split(b"\n")]


def halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Low and high half of each key's 128-bit hash."""
    digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for k in keys]), ">u8").reshape(-1, 2)
    return digests[:, 1].astype(np.uint64), digests[:, 0].astype(np.uint64)


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)


# ---- minimal perfect hash ---------------------------------------------------


def places(low: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place of each key among the bits of a level."""
    x = low ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return ((x ^ (x >> np.uint64(33))) % np.uint64(size)).astype(np.int64)


class Shard:
    """Levels of bits: at each level, keys alone at their place settle there and the others go on.
    The number of set bits before a key's own is its index. The few keys that find no place in
    LEVELS levels (or share their low half with another key) are held sorted behind the arrays."""

    LEVELS, SPREAD = 24, 1.5

    def __init__(self, content: bytes):
        self.levels, self.ranks = [], []
        count, levels, rest = struct.unpack_from("<3I", content)
        at, before = 12, 0
        for _ in range(levels):
            (size,) = struct.unpack_from("<I", content, at)
            bits = np.unpackbits(np.frombuffer(content, np.uint8, -(-size // 8), at + 4))[:size]
            self.levels.append(bits.astype(bool))
            self.ranks.append(before + np.cumsum(bits, dtype=np.int64) - bits)
            before += int(bits.sum())
            at += 4 + -(-size // 8)
        self.fingerprints = np.frombuffer(content, "<u8", count, at)
        self.counts = np.frombuffer(content, "<u4", count, at + 8 * count)
        at += 12 * count
        triples = np.frombuffer(content, "<u8", 3 * rest, at).reshape(-1, 3).tolist()
        self.rest = {(low, high): n for low, high, n in triples}

    @classmethod
    def build(cls, low: np.ndarray, high: np.ndarray, counts: np.ndarray) -> bytes:
        order, head, levels = [], [], 0
        left = np.arange(len(low))
        for level in range(cls.LEVELS):
            if not len(left):
                break
            size = max(8, int(cls.SPREAD * len(left)))
            place = places(low[left], level, size)
            alone = np.bincount(place, minlength=size) == 1
            settled = alone[place]
            mine = left[settled]
            order.append(mine[np.argsort(place[settled], kind="stable")])
            head += [struct.pack("<I", size), np.packbits(alone).tobytes()]
            left, levels = left[~settled], levels + 1
        order = np.concatenate(order) if order else left
        counts = np.minimum(counts, MOST_COUNT)
        rest = np.stack([low[left], high[left], counts[left].astype(np.uint64)], 1) if len(left) else np.empty((0, 3))
        return b"".join([
            struct.pack("<3I", len(order), levels, len(left)), *head, high[order].astype("<u8").tobytes(),
            counts[order].astype("<u4").tobytes(), rest.astype("<u8").tobytes()])

    def probe(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Count of each key, 0 for keys that are not held (their fingerprint differs)."""
        found = np.zeros(len(low), np.int64)
        left = np.arange(len(low))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(left):
                break
            place = places(low[left], level, len(bits))
            hit = bits[place]
            at, index = left[hit], ranks[place[hit]]
            found[at] = np.where(self.fingerprints[index] == high[at], self.counts[index], 0)
            left = left[~hit]
        if self.rest:
            for at in np.flatnonzero(found == 0).tolist():
                found[at] = self.rest.get((int(low[at]), int(high[at])), 0)
        return found


class Index:
    """All shards; a key's shard comes from the top of its high half."""

    def __init__(self, shards: dict[int, bytes], number: int):
        self.shards = {k: Shard(content) for k, content in shards.items()}
        self.number = number

    def probe(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        counts = np.zeros(len(low), np.int64)
        shard = shard_of(high, self.number)
        for k, content in self.shards.items():
            at = np.flatnonzero(shard == k)
            if len(at):
                counts[at] = content.probe(low[at], high[at])
        return counts


def shard_of(high: np.ndarray, number: int) -> np.ndarray:
    return ((high >> np.uint64(32)) % np.uint64(number)).astype(np.int64)


# ---- Spark steps ------------------------------------------------------------


def document_keys(df: DataFrame, text: str, min_chars: int) -> DataFrame:
    """One row for each distinct key of a row's text: low, high."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                keys: list[bytes] = []
                for value in texts(batch.column(0).slice(start, 1000)):
                    keys += {k for k in lines_and_keys(value)[1] if long_enough(k, min_chars)}
                low, high = halves(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(low.view(np.int64)), pa.array(high.view(np.int64))], names=["low", "high"])

    return df.select(text).mapInArrow(run, "low long, high long")


def build_index(df: DataFrame, text: str = "text", min_chars: int = 1, shard_keys: int = 1 << 20) -> DataFrame:
    """Shards over the keys that at least two rows hold: shard, keys, content; stored."""
    folder = work_folder(df.sparkSession, "lines")
    counts = (
        document_keys(df, text, min_chars).groupBy("low", "high").agg(F.count(F.lit(1)).alias("documents"))
        .where("documents > 1"))
    counts = stored(counts, folder, "counts")
    number = max(1, -(-counts.count() // shard_keys))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        low, high = (rows[c].to_numpy().view(np.uint64) for c in ("low", "high"))
        content = Shard.build(low, high, rows["documents"].to_numpy())
        return pd.DataFrame({"shard": [key[0]], "keys": [len(rows)], "content": [content]})

    shard = F.pmod(F.shiftrightunsigned("high", 32), F.lit(number))
    packed = counts.groupBy(shard.alias("shard")).applyInPandas(pack, "shard long, keys long, content binary")
    return stored(packed.withColumn("number", F.lit(number)), folder, "shards")


def dealt_keys(df: DataFrame, number: int, text: str, min_chars: int, rows: int) -> tuple[DataFrame, int]:
    """Distinct keys of each text digest (digest, low, high, shard, part), stored, and the number of parts: as
    many as keep a part of a shard near ``rows`` rows. Equal texts come down to one before any
    exchange, and parts are dealt by digest and key, so neither copies nor a common line meet in one part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in texts(batch.column(0)):
                low, high = halves(sorted({k for k in lines_and_keys(value)[1] if long_enough(k, min_chars)}))
                digest = text_digest(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digest] * len(low), pa.binary()), pa.array(low.view(np.int64)),
                     pa.array(high.view(np.int64)), pa.array(shard_of(high, number))],
                    names=["digest", "low", "high", "shard"])

    keys = df.select(text).mapInArrow(run, "digest binary, low long, high long, shard long").distinct()
    keys = stored(keys, work_folder(df.sparkSession, "lines"), "keys")
    most = keys.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-most // rows))
    return keys.withColumn("part", F.pmod(F.xxhash64("digest", "low", "high"), F.lit(parts))), parts


def sharded_hits(df: DataFrame, index: DataFrame, text: str, min_docs: int, min_chars: int, rows: int) -> DataFrame:
    """For an index too large for every executor: distinct keys of documents go, without their texts, to the
    parts of the shards; back come, for each text digest, the keys to drop."""
    number = index.agg(F.max("number")).first()[0] or 1
    keys, parts = dealt_keys(df, number, text, min_chars, rows)
    spread = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def probe(rows: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
        if not len(shards) or not len(rows):
            return rows.iloc[:0][["digest", "low", "high"]]
        low, high = (rows[c].to_numpy().view(np.uint64) for c in ("low", "high"))
        return rows.loc[Shard(shards["content"].iloc[0]).probe(low, high) >= min_docs, ["digest", "low", "high"]]

    found = keys.groupBy("shard", "part").cogroup(spread.groupBy("shard", "part")).applyInPandas(
        probe, "digest binary, low long, high long")
    return found.groupBy("digest").agg(F.collect_set(F.struct("low", "high")).alias("dropped"))


def text_digest(value: bytes) -> bytes:
    return xxhash.xxh3_128_digest(value)


def line_dedup(
    df: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text",
    broadcast_bytes: int = 64 << 20, part_rows: int = 1 << 20,
) -> DataFrame:
    """Drop, in every row, the lines whose key at least ``min_docs`` rows hold (two or more).

    Adds ``n_lines`` (before dropping), ``n_dropped`` and ``kept_text``. Keys of fewer than
    ``min_chars`` code points always stay. A null or empty text is one empty line and comes
    out empty; a text that loses all its lines comes out empty as well. Repeated rows count
    as rows of their own. An empty table gives an empty one. Other columns stay; input
    columns named like a new one are replaced.

    Arrays of up to ``broadcast_bytes`` go to every executor. Larger ones stay dealt into
    shards and the keys of documents travel to them.
    """
    if min_docs < 2:
        raise ValueError("the index holds lines of two rows or more; min_docs must be 2 at least")
    spark = df.sparkSession
    index = build_index(df, text, min_chars)
    size = index.agg(F.sum(F.length("content"))).first()[0] or 0
    fields = [StructField("n_lines", LongType()), StructField("n_dropped", LongType()),
              StructField("kept_text", StringType())]
    if size > broadcast_bytes:
        return dropped_by_sets(df, sharded_hits(df, index, text, min_docs, min_chars, part_rows), text, min_chars)
    shards = [(r.shard, r.number, bytes(r.content)) for r in index.toLocalIterator()]
    number = shards[0][1] if shards else 1
    sent = spark.sparkContext.broadcast(({k: content for k, _, content in shards}, number, size))

    def start():
        held = opened(sent)

        def columns(column: pa.Array) -> list[pa.Array]:
            n_lines, n_dropped, kept = [], [], []
            for begin in range(0, len(column), 500):
                part = [lines_and_keys(v) for v in texts(column.slice(begin, 500))]
                keys = [k for _, own in part for k in own]
                drop = held.probe(*halves(keys)) >= min_docs
                at = 0
                for lines, own in part:
                    gone = drop[at:at + len(own)].tolist()
                    at += len(own)
                    gone = [g and long_enough(k, min_chars) for g, k in zip(gone, own, strict=True)]
                    n_lines.append(len(lines))
                    n_dropped.append(sum(gone))
                    kept.append(b"\n".join([x for x, g in zip(lines, gone, strict=True) if not g])
                                if any(gone) else b"\n".join(lines))
            return [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string())]

        return columns

    return with_python_columns(df, text, fields, start)


@functools.lru_cache(maxsize=1)
def opened(sent) -> Index:
    shards, number, _ = sent.value
    return Index(shards, number)


def dropped_by_sets(df: DataFrame, hits: DataFrame, text: str, min_chars: int) -> DataFrame:
    """The same columns from each text's own set of keys to drop."""
    plain = without(df, ["n_lines", "n_dropped", "kept_text", "__digest"])

    def digests(column: pa.Array) -> list[pa.Array]:
        return [pa.array([text_digest(v) for v in texts(column)], pa.binary())]

    with_digest = with_python_columns(plain, text, [StructField("__digest", BinaryType())], lambda: digests)
    joined = with_digest.join(hits, with_digest["__digest"] == hits["digest"], "left")
    names = plain.columns
    at, out = names.index(text), plain.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            gone_sets = batch.column(len(names)).to_pylist()
            for value, gone in zip(texts(batch.column(at)), gone_sets, strict=True):
                lines, keys = lines_and_keys(value)
                low, high = halves(keys)
                gone = {(g["low"], g["high"]) for g in gone or ()}
                pairs = zip(low.view(np.int64).tolist(), high.view(np.int64).tolist(), keys, strict=True)
                drop = [(a, b) in gone and long_enough(k, min_chars) for a, b, k in pairs]
                n_lines.append(len(lines))
                n_dropped.append(sum(drop))
                kept.append(b"\n".join([x for x, d in zip(lines, drop, strict=True) if not d]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(names))]
                + [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                   pa.array(kept, pa.binary()).cast(pa.string())],
                names=[*names, "n_lines", "n_dropped", "kept_text"])

    schema = StructType([*out.fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType()),
                         StructField("kept_text", StringType())])
    return joined.select(*[with_digest[f"`{c}`"] for c in names], "dropped").mapInArrow(run, schema)
