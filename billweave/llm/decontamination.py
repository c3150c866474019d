"""Benchmark decontamination with DataFrame functions only.

Words of benchmark items form windows; their hashes set slots of a small map that travels in
the plan, and the windows themselves, as text, form a hash table that is broadcast while its
size is below a bound. A document's windows are hashed in place and those whose slot is
free are dropped, so only likely hits leave the row. These are looked up as whole text, which
verifies them. Texts are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billweave.llm.tables import stored, without, work_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MOST_SLOTS = 1 << 22
BROADCAST_BYTES = 64 << 20


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case. ``lower`` does just that to text of single-byte characters, at less cost."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP, -1), "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def window_starts(n: Column, length: int) -> Column:
    return F.when(n >= length, F.sequence(F.lit(1), n - (length - 1))).otherwise(F.array().cast("array<int>"))


def item_windows(benchmark: DataFrame, n: int, item: str, text: str) -> DataFrame:
    """Each distinct window: gram (its words joined by a space), length, hash, items, and the digest of these."""
    own = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("words"))
    own = own.withColumn("length", F.least(F.size("words"), F.lit(n))).where("length > 0")
    starts = F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)
    grams = own.select("item", "length", F.explode(F.transform(
        starts, lambda i: F.slice("words", i, F.col("length")))).alias("window"))
    return grams.groupBy(F.array_join("window", " ").alias("gram")).agg(
        F.first("length").alias("length"), F.first(window_hash(F.transform("window", lambda w: F.xxhash64(w)))).alias("hash"),
        F.array_sort(F.collect_set("item")).alias("gram_items")).withColumn(
        "item_set", F.unhex(F.sha2(F.to_json("gram_items"), 256)))


def window_hash(hashes: Column) -> Column:
    """Hash of a window from the hashes of its words."""
    return F.xxhash64(hashes)


def slot_map(grams: DataFrame, slots: int) -> bytes:
    taken = bytearray(slots)
    for row in grams.select(F.pmod("hash", F.lit(slots)).cast("int").alias("slot")).distinct().toLocalIterator():
        taken[row.slot] = 1
    return bytes(taken)


def contamination(
    docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, text: str = "text", item: str = "item_id",
    item_text: str = "text", keep_text: bool = False, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Overlap of every document with the windows of benchmark items.

    A window is ``n`` consecutive words of an item, or all words of a shorter one; a word inside any
    occurrence of a window is hit. Adds ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted
    as strings), ``hit_words`` (places from 1, ascending) and ``contaminated`` (n_hit > 0 and
    share * n_hit >= n_words). A null or empty text has no words and is never contaminated.
    Repeated rows each get their own row; equal items are separate items. With an empty
    benchmark nothing is hit; an empty table gives an empty one. The text column is left
    out unless ``keep_text``, other columns stay; input columns named like a new one
    are replaced.

    The windows of the items go to every executor while they have up to ``broadcast_bytes`` of
    text; a larger benchmark is joined by whatever way Spark picks. Windows name the set of their items by its
    digest, so a window that a third of the items share is as small as any other; documents
    that hit one get its items from a table of sets.
    """
    added = ["n_words", "n_hit", "n_items", "items", "hit_words", "contaminated", "__row", "__words", "__candidate", "item_sets"]
    folder = work_folder(docs.sparkSession, "windows")
    windows = stored(item_windows(benchmark, n, item, item_text), folder, "windows")
    grams = windows.drop("gram_items")
    facts = grams.agg(F.count(F.lit(1)).alias("grams"), F.sum(F.octet_length("gram") + 96).alias("bytes"),
                      F.sort_array(F.collect_set("length")).alias("lengths")).first()
    slots = 1 << min(MOST_SLOTS.bit_length() - 1, max(10, (64 * facts.grams).bit_length()))
    slot_bytes = F.lit(slot_map(grams, slots) if facts.grams else bytes(slots))
    rest = [c for c in without(docs, added).columns if keep_text or c != text]

    def candidates(own: Column) -> Column:
        hashes = F.transform(own, lambda w: F.xxhash64(w))
        def of_length(h: Column, length: int) -> Column:
            likely = F.filter(window_starts(F.size(h), length), lambda i: F.substring(
                slot_bytes, F.pmod(window_hash(F.slice(h, i, F.lit(length))), F.lit(slots)).cast("int") + 1, F.lit(1)
            ) == F.lit(b"\x01"))
            return F.transform(likely, lambda i: F.struct(
                i.alias("at"), F.array_join(F.slice(own, i, F.lit(length)), " ").alias("gram")))
        return let(hashes, lambda h: F.concat(*[of_length(h, k) for k in facts.lengths]))

    found = F.array().cast("array<struct<at:int,gram:string>>")
    own = docs.select(*[F.col(f"`{c}`") for c in rest], F.monotonically_increasing_id().alias("__row"), let(
        words(F.col(text)), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), (candidates(w) if facts.lengths else found).alias("likely"),
        )).alias("__words"))
    own = own.select(*rest, "__row", "__words.n_words", F.explode_outer("__words.likely").alias("__candidate"))
    held = F.broadcast(grams) if (facts.bytes or 0) <= broadcast_bytes else grams
    joined = own.join(held, F.col("__candidate.gram") == F.col("gram"), "left")
    places = F.when(F.col("length").isNotNull(), F.sequence(
        F.col("__candidate.at"), F.col("__candidate.at") + F.col("length") - 1))
    rows = joined.groupBy("__row").agg(
        *[F.first(c).alias(c) for c in rest], F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(places)))).alias("hit_words"),
        F.collect_set("item_set").alias("item_sets"))
    rows = stored(rows, folder, "rows")
    sets = windows.select("item_set", "gram_items").dropDuplicates(["item_set"])
    hits = rows.select("__row", F.explode("item_sets").alias("item_set")).join(sets, "item_set").select(
        "__row", F.explode("gram_items").alias("item")).groupBy("__row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    rows = rows.join(hits, "__row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    n_hit = F.size("hit_words").cast("long")
    return rows.select(
        *rest, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "hit_words",
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))


def without_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``contamination(..., keep_text=True)`` with the hit words, and the gap behind each,
    taken out of the text. Rows without a hit keep their text as it is."""
    held = F.coalesce(F.col(text), F.lit(""))
    own, gaps = F.array_remove(F.split(held, GAP, -1), ""), F.split(held, WORD, -1)
    left = let(own, lambda w: let(gaps, lambda g: F.concat(
        g[0], F.array_join(F.transform(w, lambda x, i: F.when(
            F.array_contains("hit_words", i + 1), F.lit("")).otherwise(F.concat(x, F.get(g, i + 1)))), ""))))
    return df.withColumn(text, F.when(F.size("hit_words") > 0, left).otherwise(F.col(text)))
