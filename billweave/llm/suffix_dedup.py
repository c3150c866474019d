"""Removal of long strings that occur more than once in a table of texts, by suffix arrays.

Where two texts share a string of ``length`` bytes, they share its least hashed substring, so each begin of such a string goes
to the group of that hash; a hash met once can't hold a repeat. Of the others, neighbouring begins of one hash make a
region, equal regions are one row with a count, and regions are dealt to shards by hash: by the least hash met near any
region of that hash, so that regions that follow one another mostly lie in one shard and are one part of its text. A shard's
parts are sorted by their suffixes (``suffix_sort``, in a fixed amount of memory whatever the shard's size); suffixes that share
``length`` bytes are repeats. Their bytes are then removed from all texts that hold the region.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (
    ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType,
)

from billweave.llm.suffix_sort import Scratch, sorted_suffixes
from billweave.llm.tables import BATCH_ROWS, stored, texts, with_python_columns, work_folder

SEED_BYTES = 128
NEIGHBOURS = 16
HEAVY = 4
BLOCK_BYTES = 1 << 20
SHARD_BYTES = 4 << 20
SORT_MEMORY = 256 << 20
END, SEPARATOR, FIRST_BYTE = 0, 1, 2


@functools.lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return np.random.default_rng(12).integers(0, 1 << 64, 256, dtype=np.uint64)


@functools.lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    base = 0x9E3779B97F4A7C15
    factors = np.full((2, n), [[base], [pow(base, -1, 1 << 64)]], np.uint64)
    factors[:, 0] = 1
    return tuple(np.multiply.accumulate(factors, axis=1))


def seed_hashes(data: np.ndarray, size: int, room: int) -> np.ndarray:
    """Hash of each substring of ``size`` bytes; equal ones have equal hashes."""
    power, inverse = powers(room)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(byte_values()[data] * inverse[:len(data)])])
        found = (total[size:] - total[:-size]) * power[:len(data) - size + 1]
        found ^= found >> np.uint64(32)
        found *= np.uint64(0xD6E8FEB86659FD93)
        return found ^ found >> np.uint64(29)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window of ``width`` values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def regions(data: bytes, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of ``length`` bytes that have one least hash: that hash, begin and end of the run's bytes, and how often
    a substring of that hash begins in it."""
    whole, width = np.frombuffer(data, np.uint8), length - seed + 1
    step = max(BLOCK_BYTES - seed, seed)
    starts = range(0, len(data) - seed + 1, step)
    hashes = np.concatenate([seed_hashes(whole[i:i + step + seed - 1], seed, step + seed) for i in starts])
    least = least_of(hashes, width)
    begins = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    ends = np.append(begins[1:], len(least))
    # places that give some window its least hash: no window with the place has a greater least hash
    reach = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    places = np.flatnonzero(~least_of(~reach, width) == hashes)
    first, last = np.searchsorted(places, begins), np.searchsorted(places, ends + width - 1)
    at = np.repeat(first - np.cumsum(last - first) + (last - first), last - first) + np.arange((last - first).sum())
    equal = hashes[places[at]] == np.repeat(least[begins], last - first)
    hits = np.bincount(np.repeat(np.arange(len(begins)), last - first), equal, len(begins)).astype(np.int64)
    return least[begins].view(np.int64), begins, ends + length - 1, hits


def near_least(least: np.ndarray) -> np.ndarray:
    """Least hash of each region and of those up to NEIGHBOURS places away."""
    edge = np.full(NEIGHBOURS, np.iinfo(np.int64).max)
    return least_of(np.concatenate([edge, least, edge]), 2 * NEIGHBOURS + 1)


Region = tuple[int, int, int]  # offset in its part, size, how many copies it stands for


def repeats(parts: list[bytes], inside: list[list[Region]], length: int, scratch: Scratch) -> list[list[list[tuple[int, int]]]]:
    """For each region of each part, the stretches covered by strings of ``length`` bytes that begin in it and occur twice or
    more in all parts, counted from the region's begin."""
    starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
    text = scratch.array(int(starts[-1]) + 1, np.int32)
    for start, part in zip(starts, parts, strict=False):
        text[start:start + len(part)] = np.frombuffer(part, np.uint8).astype(np.int32) + FIRST_BYTE
        text[start + len(part)] = SEPARATOR
    text[-1] = END
    order, shared = sorted_suffixes(text, 256 + FIRST_BYTE, length, scratch)
    # a string that fits in its part is a repeat if a neighbour shares it, or if its part stands for several copies
    again = scratch.array(len(text), bool, False)
    close = np.flatnonzero(shared >= length)
    again[order[close]] = True
    again[order[close - 1]] = True
    out = []
    for start, own in zip(starts.tolist(), inside, strict=False):
        out.append([])
        for offset, size, count in own:
            marked = again[start + offset:start + offset + size - length + 1]
            begins = np.arange(len(marked)) if count > 1 else np.flatnonzero(marked)
            gap = np.flatnonzero(np.diff(begins) > 1)
            first, last = (np.concatenate(x).astype(np.int64) for x in (
                (begins[:1], begins[gap + 1]), (begins[gap], begins[-1:])))
            out[-1].append(joined_stretches(list(zip(first.tolist(), (last + length).tolist(), strict=True))))
    return out


def joined_stretches(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of stretches; ones that touch are one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(stretches):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


PLACES = ArrayType(StructType([StructField("begin", IntegerType(), False), StructField("end", IntegerType(), False)]), False)


def region_table(texts_by_key: DataFrame, length: int, seed: int) -> DataFrame:
    """``key, least, digest, begin, size, hits, near`` of the regions of all texts, which have ``length`` bytes at least."""
    schema = StructType([
        StructField("key", BinaryType()), StructField("least", LongType()), StructField("digest", BinaryType()),
        StructField("begin", IntegerType()), StructField("size", IntegerType()), StructField("hits", LongType()),
        StructField("near", LongType())])
    arrow = [pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows: list[list] = [[] for _ in arrow]
                for key, data in zip(part.column(0).to_pylist(), texts(part.column(1)), strict=True):
                    found = regions(data, length, seed)
                    least, begin, end, hits, near = (x.tolist() for x in (*found, near_least(found[0])))
                    digests = [xxhash.xxh3_128_digest(data[i:j]) for i, j in zip(begin, end, strict=True)]
                    sizes = [j - i for i, j in zip(begin, end, strict=True)]
                    for column, values in zip(rows, ([key] * len(least), least, digests, begin, sizes, hits, near), strict=True):
                        column += values
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, arrow, strict=True)], names=schema.names)

    return texts_by_key.mapInArrow(run, schema)


REGIONS = ArrayType(StructType([
    StructField("least", LongType()), StructField("digest", BinaryType()), StructField("count", LongType()),
    StructField("offset", IntegerType()), StructField("size", IntegerType())]), False)


def region_texts(lists: DataFrame, texts_by_key: DataFrame, length: int) -> DataFrame:
    """``near, part, own``: texts of the regions of ``key, regions`` rows. Regions of one text and one ``near`` that follow one
    another are one part. A copy of a text that comes behind it in a task is passed over; other copies
    give a region twice, which its shard notices."""
    schema = StructType([StructField("near", LongType()), StructField("part", BinaryType()), StructField("own", REGIONS)])
    arrow = to_arrow_schema(schema)

    def parts(data: bytes, found: list[dict]) -> Iterator[dict]:
        run: list[dict] = []
        for region in [*sorted(found, key=lambda r: r["begin"]), None]:
            if run and (region is None or region["near"] != run[-1]["near"]
                        or region["begin"] != run[-1]["begin"] + run[-1]["size"] - length + 1):
                start = run[0]["begin"]
                yield {"near": run[0]["near"], "part": data[start:run[-1]["begin"] + run[-1]["size"]], "own": [
                    {"least": r["least"], "digest": r["digest"], "count": r["count"], "offset": r["begin"] - start,
                     "size": r["size"]} for r in run]}
                run = []
            run.append(region)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column("key")[i].as_py()
                if key != last:
                    last, data = key, (batch.column("text")[i].as_py() or "").encode()
                    yield pa.RecordBatch.from_pylist(list(parts(data, batch.column("regions")[i].as_py())), schema=arrow)

    return texts_by_key.join(lists, "key").select("key", "text", "regions").mapInArrow(run, schema)


def shard_repeats(parts: DataFrame, length: int, memory: int) -> DataFrame:
    """``least, digest, places`` of the regions in which something repeats; ``shard`` tells which parts are sorted together."""
    schema = StructType([StructField("least", LongType()), StructField("digest", BinaryType()), StructField("places", PLACES)])
    arrow = to_arrow_schema(schema)

    def found(rows: dict) -> Iterator[pa.RecordBatch]:
        own = [[(r["offset"], r["size"], r["count"]) for r in regions] for _, regions in rows.values()]
        with Scratch(memory) as scratch:
            places = repeats([part for part, _ in rows.values()], own, length, scratch)
        made = [{"least": r["least"], "digest": r["digest"], "places": [{"begin": b, "end": e} for b, e in stretches]}
                for (_, regions), of_part in zip(rows.values(), places, strict=True)
                for r, stretches in zip(regions, of_part, strict=True) if stretches]
        for at in range(0, len(made), BATCH_ROWS):
            yield pa.RecordBatch.from_pylist(made[at:at + BATCH_ROWS], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, shard = {}, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    if rows:
                        yield from found(rows)
                    rows, shard = {}, row["shard"]
                # one text gives one part for its first region, however many copies of it were read
                rows[row["own"][0]["least"], row["own"][0]["digest"]] = row["part"], row["own"]
        if rows:
            yield from found(rows)

    return parts.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, schema)


def dealt_parts(parts: DataFrame, shard_bytes: int) -> DataFrame:
    """Parts as they are dealt to shards. Where the parts of one ``near`` come to HEAVY shards, each region is dealt by its own
    least hash instead, as a part of its own, so a passage that very many texts share spreads over shards."""
    sizes = parts.groupBy("near").agg(F.sum(F.octet_length("part")).alias("bytes"))
    heavy = sizes.where(F.col("bytes") > HEAVY * shard_bytes).select("near")
    alone = parts.join(heavy, "near", "left_semi").select("part", F.explode("own").alias("r")).select(
        F.col("r.least").alias("near"), F.substring("part", F.col("r.offset") + 1, F.col("r.size")).alias("part"),
        F.array(F.struct("r.least", "r.digest", "r.count", F.lit(0).alias("offset"), "r.size")).alias("own"))
    return parts.join(heavy, "near", "left_anti").unionByName(alone)


def repeated_places(
    texts_by_key: DataFrame, length: int, seed: int, shard_bytes: int, memory: int, folder: str,
) -> DataFrame:
    """``key, places``: the stretches of each text to remove, overlapping ones not yet joined."""
    all_regions = stored(region_table(texts_by_key, length, seed), folder, "regions")
    met = all_regions.groupBy("least").agg(F.sum("hits").alias("n"), F.min("near").alias("near")).where("n > 1")
    shared = stored(all_regions.drop("hits", "near").join(met.drop("n"), "least"), folder, "shared")
    distinct = shared.groupBy("near", "least", "digest").agg(
        F.count(F.lit(1)).alias("count"), F.min(F.struct("key", "begin", "size")).alias("at"))
    lists = stored(distinct.groupBy("at.key").agg(F.collect_list(
        F.struct("near", "least", "digest", "count", "at.begin", "at.size")).alias("regions")), folder, "lists")
    parts = stored(region_texts(lists, texts_by_key, length), folder, "parts")
    dealt = dealt_parts(parts, shard_bytes)
    total = dealt.agg(F.sum(F.octet_length("part"))).first()[0] or 0
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("near"), F.lit(total // shard_bytes + 1)))
    found = stored(shard_repeats(dealt, length, memory), folder, "found")
    places = shared.select("key", "least", "digest", "begin").join(found, ["least", "digest"]).select(
        "key", F.explode(F.transform("places", lambda p: F.struct(
            (p["begin"] + F.col("begin")).alias("begin"), (p["end"] + F.col("begin")).alias("end")))).alias("place"))
    return places.groupBy("key").agg(F.collect_set("place").alias("places"))


def remove_repeats(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = 400, seed: int = SEED_BYTES,
    shard_bytes: int = SHARD_BYTES, memory: int = SORT_MEMORY,
) -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that starts anywhere else too, in the same text or another.

    Strings are judged on the texts as given; overlapping ones count. Result, one row for each input row: ``id_column``,
    ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (the remaining UTF-8 bytes, which may cut a character) and ``kept_sha256``. Null
    and empty texts, and those below ``length`` bytes, lose nothing; repeated rows of ``length`` bytes or more lose everything; an empty
    table gives an empty one; further columns are left out. A long text is taken whole by the task that hashes it.
    ``seed`` is the number of bytes hashed for the choice of groups, below ``length``.
    """
    if not 0 < seed < length:
        raise ValueError("seed has to be below length")
    spark = df.sparkSession
    folder = work_folder(spark, "suffixes")
    by_key = df.select(F.col(f"`{text}`").alias("text"), F.unhex(F.md5(F.col(f"`{text}`").cast("binary"))).alias("key"))
    long_enough = by_key.where(F.octet_length("text") >= length)
    places = stored(repeated_places(long_enough.select("key", "text"), length, seed, shard_bytes, memory, folder), folder, "places")
    rows = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text"),
                     F.unhex(F.md5(F.col(f"`{text}`").cast("binary"))).alias("key"))
    joined = rows.join(places, "key", "left").select("id", F.struct("text", "places").alias("given"))
    fields = [StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType()),
              StructField("kept", BinaryType()), StructField("kept_sha256", StringType())]

    def start():
        def columns(column: pa.Array) -> list[pa.Array]:
            made: list[list] = [[] for _ in fields]
            given = pa.array(column)
            for data, own in zip(texts(given.field("text")), given.field("places").to_pylist(), strict=True):
                spans = joined_stretches([(p["begin"], p["end"]) for p in own or []])
                kept, at = [], 0
                for begin, end in spans:
                    kept.append(data[at:begin])
                    at = end
                rest = b"".join([*kept, data[at:]])
                row = len(data), len(data) - len(rest), len(spans), rest, hashlib.sha256(rest).hexdigest()
                for cells, cell in zip(made, row, strict=True):
                    cells.append(cell)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            return [pa.array(cells, kind) for cells, kind in zip(made, kinds, strict=True)]

        return columns

    return with_python_columns(joined, "given", fields, start).select(
        F.col("id").alias(id_column), *[f.name for f in fields])
