"""Near-duplicate documents by b-bit MinHash with exact confirmation.

1. A row's text becomes a set of five-word shingles (64-bit hashes), a digest of that set, band
   keys made from full minima, and a signature of the low bits of all minima.
2. Rows with equal sets are one class; its least id stands for it.
3. Classes that share a band key are candidates. In buckets of ordinary size, signatures are
   compared by bit counts and only likely pairs link; members of larger buckets are linked with
   their least member. The components of these links are groups.
4. Full sets meet within groups only, each class once. A large group is cut into blocks that
   meet two by two in tasks of bounded size; a task gives back a forest of confirmed links.
5. Components of the confirmed links are the result.

No step makes a row for each pair of a group, and no candidate is dropped by a limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.llm.components import components
from billweave.llm.tables import stored, texts, without, work_folder

SHINGLE = 5
#: A pair at the least similarity misses all bands with a chance of (1 - 0.85 ** 6) ** 32, 3e-7.
BANDS, ROWS = 32, 6
HASHES, BITS = BANDS * ROWS, 4
#: Likely pairs: five standard deviations of the estimate below the least similarity.
MARGIN = 0.14
BUCKET = 64
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1 << 20
MIX = 0x9E3779B97F4A7C15
GENERATOR = np.random.Generator(np.random.PCG64(20240229))
FACTORS = GENERATOR.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = GENERATOR.integers(0, 1 << 63, HASHES, np.uint64)
BAND_FACTORS = GENERATOR.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct shingle hashes: runs of five words, or all words if there are fewer."""
    words = text.lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if not len(h):
        return h
    size = min(SHINGLE, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = out * np.uint64(MIX) + h[k:len(h) - size + 1 + k]
    return np.unique(mixed(out))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """Minima (32 bits) of every hash over every set; sets are not empty."""
    out = np.empty((HASHES, len(sets)), np.uint32)
    begin = 0
    while begin < len(sets):
        end, size = begin, 0
        while end < len(sets) and (size == 0 or size + len(sets[end]) <= 1 << 16):
            size += len(sets[end])
            end += 1
        x = np.concatenate(sets[begin:end])
        starts = np.cumsum([0, *map(len, sets[begin:end - 1])])
        held = np.empty_like(x)
        for k in range(HASHES):
            np.multiply(x, FACTORS[k], out=held)
            np.add(held, SHIFTS[k], out=held)
            np.right_shift(held, np.uint64(32), out=held)
            out[k, begin:end] = np.minimum.reduceat(held.astype(np.uint32), starts)
        begin = end
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band and set, from the full minima of the band."""
    rows = least.reshape(BANDS, ROWS, least.shape[1]).astype(np.uint64)
    sums = (rows * BAND_FACTORS[:, :, None]).sum(1, dtype=np.uint64)
    return mixed(sums + (np.arange(BANDS, dtype=np.uint64) * np.uint64(MIX))[:, None])


def signature(least: np.ndarray) -> np.ndarray:
    """Low bits of all minima, two to a byte: a row of bytes for each set."""
    low = (least & ((1 << BITS) - 1)).astype(np.uint8)
    return np.ascontiguousarray((low[0::2] << 4 | low[1::2]).T)


def estimates(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Similarity of one signature with others: unequal low bits counted, chance agreement taken out."""
    differing = one ^ others
    differing |= differing >> np.uint64(1)
    differing |= differing >> np.uint64(2)
    unequal = np.bitwise_count(differing & np.uint64(0x1111111111111111)).sum(-1, dtype=np.int64)
    chance = 2.0 ** -BITS
    return (1 - unequal / HASHES - chance) / (1 - chance)


def longs(signatures: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint64).reshape(len(signatures), HASHES * BITS // 64)


class Forest:
    """Union of numbers below n; ``join`` tells whether it linked two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


# ---- Spark steps --------------------------------------------------------------


def set_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """id, n_shingles, digest, bands, signature of every row; the last three are null for an empty set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                ids = batch.column(0).slice(start, 1000)
                sets = [shingles(t) for t in texts(batch.column(1).slice(start, 1000))]
                full = [s for s in sets if len(s)]
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                least = minima(full)
                bands = iter(band_keys(least).T.view(np.int64).tolist())
                packed = (row.tobytes() for row in signature(least))
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(map(len, sets), pa.int64()), pa.array(digests, pa.binary()),
                    pa.array([next(bands) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    pa.array([next(packed) if len(s) else None for s in sets], pa.binary())],
                    names=["id", "n_shingles", "digest", "bands", "signature"])

    return df.select(F.col(key).cast("long"), text).mapInArrow(
        run, "id long, n_shingles long, digest binary, bands array<long>, signature binary")


def likely_links(buckets: DataFrame, least: float) -> DataFrame:
    """From buckets (members: array of id and signature), a forest of the pairs whose estimate is at least
    ``least``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for members in batch.column(0).to_pylist():
                ids, packed = [m["id"] for m in members], longs([m["signature"] for m in members])
                forest = Forest(len(ids))
                for i in range(len(ids) - 1):
                    for j in (np.flatnonzero(estimates(packed[i], packed[i + 1:]) >= least) + i + 1).tolist():
                        if forest.join(i, j):
                            out.append((ids[i], ids[j]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([min(p) for p in out], pa.int64()), pa.array([max(p) for p in out], pa.int64())],
                names=["a", "b"])

    return buckets.select("members").mapInArrow(run, "a long, b long")


def candidate_links(classes: DataFrame, folder: str, similarity: float) -> DataFrame:
    """Links (a, b) whose components hold every pair that shares a band and may be similar enough."""
    rows = classes.select("id", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("least")).where("size > 1")
    members = stored(rows.join(shared, "key"), folder, "members")
    stars = members.where(F.col("size") > BUCKET).select(F.col("least").alias("a"), F.col("id").alias("b"))
    small = members.where(F.col("size") <= BUCKET).join(classes.select("id", "signature"), "id")
    buckets = small.groupBy("key").agg(F.collect_list(F.struct("id", "signature")).alias("members"))
    return likely_links(buckets, similarity - MARGIN).union(stars)


def confirmed_links(blocks: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Links confirmed on full sets. ``blocks`` has group, first, second (a pair of blocks) and, for each
    member, id, block, shingles, signature; rows of a pair of blocks stand together."""
    least = numerator / denominator - MARGIN

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        """A forest of the similar pairs of two blocks, or of one if both are the same."""
        rows.sort(key=lambda r: len(r[2]))
        ids, block = [r[0] for r in rows], np.array([r[1] for r in rows])
        sets, sizes = [r[2] for r in rows], np.array([len(r[2]) for r in rows])
        packed = longs([r[3] for r in rows])
        across, forest, out = len(set(block.tolist())) > 1, Forest(len(rows)), []
        for i in range(len(rows) - 1):
            end = int(np.searchsorted(sizes, sizes[i] * denominator / numerator, "right"))
            near = np.flatnonzero(estimates(packed[i], packed[i + 1:end]) >= least) + i + 1
            if across:
                near = near[block[near] != block[i]]
            for j in near.tolist():
                if forest.root(i) == forest.root(j):
                    continue
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if denominator * common >= numerator * (sizes[i] + sizes[j] - common):
                    forest.join(i, j)
                    out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, out = [], None, []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            ids, block, packed = (batch.column(k).to_pylist() for k in (3, 4, 6))
            ends, values = batch.column(5).offsets.to_numpy(), batch.column(5).values.to_numpy().view(np.uint64)
            for n, key in enumerate(keys):
                if key != at:
                    out += links(held)
                    held, at = [], key
                held.append((ids[n], block[n], values[ends[n]:ends[n + 1]].copy(), packed[n]))
            if len(out) > 10_000:
                yield edges(out)
                out = []
        yield edges(out + links(held))

    def edges(out: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()),
                                           pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    together = blocks.select("group", "first", "second", "id", "block", "shingles", "signature").repartition(
        "group", "first", "second").sortWithinPartitions("group", "first", "second")
    return together.mapInArrow(run, "a long, b long")


def with_shingles(df: DataFrame) -> DataFrame:
    """Rows of id, group, blocks, signature, text to the same with shingles instead of text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sets = [shingles(t) for t in texts(part.column(4))]
                ends = np.cumsum([0, *map(len, sets)])
                values = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in range(4)),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))],
                    names=["id", "group", "blocks", "signature", "shingles"])

    return df.select("id", "group", "blocks", "signature", "text").mapInArrow(
        run, "id long, group long, blocks long, signature binary, shingles array<long>")


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", numerator: int = 85, denominator: int = 100,
) -> DataFrame:
    """n_shingles, component_id and kept for every row.

    Rows are linked if denominator * intersection >= numerator * union of their shingle sets (for a
    similarity of 0.8 or more); component_id is the least key that links lead to and kept says
    that it is the row's own. A text of fewer than five words is one shingle; a null or empty
    text, or one of white space, has none and is linked with nothing, as is a row without a
    key (its component is null and it is kept). Rows that share a key count as one document.
    An empty table gives an empty one. The text is left out, other columns stay, and input
    columns with the new names are replaced.
    """
    folder = work_folder(df.sparkSession, "near")
    sets = stored(set_table(df, key, text), folder, "sets")
    full = sets.where("digest IS NOT NULL AND id IS NOT NULL")
    first = full.groupBy("digest").agg(F.min("id").alias("id"))
    classes = stored(full.join(first, ["digest", "id"]), folder, "classes")
    groups = components(candidate_links(classes, folder, numerator / denominator), folder, "candidates")
    held = stored(groups.withColumnRenamed("component", "group").join(
        classes.select("id", "digest", "n_shingles", "signature"), "id"), folder, "groups")
    size = held.groupBy("group").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("blocks"))
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    wanted = held.join(size, "group").select("id", "group", "blocks", "signature")
    # by shuffle at every size, so that cost grows in proportion to the table
    members = with_shingles(docs.join(wanted.hint("merge"), "id"))
    members = members.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    blocks = members.select("*", other.alias("other")).select(
        "group", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"),
        "id", "block", "shingles", "signature")
    links = stored(confirmed_links(blocks, numerator, denominator), folder, "links")
    linked = components(links, folder, "components")
    of_class = first.withColumnRenamed("id", "first_id")
    labels = of_class.join(linked.withColumnRenamed("id", "first_id"), "first_id", "left").select(
        "digest", F.coalesce("component", "first_id").alias("component_id"))
    labels = stored(labels, folder, "labels")
    by_row = sets.where("id IS NOT NULL").select("id", "n_shingles", "digest").join(labels, "digest", "left").groupBy(
        "id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    rest = without(df, ["n_shingles", "component_id", "kept"])
    rest = rest.select([F.col(f"`{c}`") for c in rest.columns if c != text])
    named = by_row.withColumnRenamed("id", "__id")
    joined = rest.join(named, rest[key].cast("long") == named["__id"], "left").drop("__id")
    component = F.coalesce("component_id", F.col(key).cast("long"))
    return joined.withColumn("n_shingles", F.coalesce("n_shingles", F.lit(0))).withColumn(
        "component_id", component).withColumn("kept", F.coalesce(component == F.col(key), F.lit(True)))
