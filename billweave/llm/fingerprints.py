"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

Five-word shingles are hashed once; the top bits of a hash name its bin and a bin keeps its
least hash. Empty bins are filled by optimal densification: a bin draws other bins by a
hash of its own number until one is not empty, so an empty bin of equal sets always
borrows from the same place. Of each bin BITS low bits are kept, sixteen bins to a long. The share of
equal bins, less what low bits have in common by chance, estimates the resemblance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billweave.llm.decontamination import let, lower_ascii
from billweave.llm.tables import without

SHINGLE = 5
BINS, BIN_BITS, BITS = 256, 8, 4
VALUE_BITS = 63 - BIN_BITS
EMPTY = (1 << VALUE_BITS) - 1
DRAWS = 12
GAP = r"[\x20\x09-\x0D]+"


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP, -1), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(text: Column) -> Column:
    """Hashes (63 bits) of all runs of five words; of all words, if there are fewer; none without words."""
    mask = F.lit((1 << 63) - 1)
    return let(word_hashes(text), lambda h: F.when(
        F.size(h) >= SHINGLE, F.transform(F.sequence(F.lit(1), F.size(h) - (SHINGLE - 1)), lambda i: F.xxhash64(
            F.slice(h, i, F.lit(SHINGLE))).bitwiseAND(mask)),
    ).when(F.size(h) > 0, F.array(F.xxhash64(h).bitwiseAND(mask))).otherwise(F.array().cast("array<bigint>")))


def numbers(values: list[int], kind: str) -> Column:
    """An array of constants, as one expression that is folded once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def bin_of(value: Column) -> Column:
    return F.shiftright(value, VALUE_BITS)


def minima(shingles: Column) -> Column:
    """The least hash of each bin, in the order of bins: with one greatest value for each bin added, the
    first of every bin in sorted order is its least, and the added value says that it is empty."""
    ends = numbers([(b << VALUE_BITS) | EMPTY for b in range(BINS)], "bigint")
    return let(F.sort_array(F.concat(shingles, ends)), lambda s: F.filter(
        s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1)))))


def value_of(least: Column) -> Column:
    """The hash below its bin's number, null for an empty bin."""
    return F.nullif(least.bitwiseAND(F.lit(EMPTY)), F.lit(EMPTY))


def draws() -> Column:
    """The bins that each bin draws, DRAWS in a row, from a fixed generator."""
    state, out = 0x9E3779B97F4A7C15, []
    for _ in range(BINS * DRAWS):
        state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(state >> (64 - BIN_BITS))
    return numbers(out, "int")


def densified(bins: Column) -> Column:
    """Values of all bins. A bin whose draws all hit empty bins takes, of the bins that are not empty, the
    one that its own hash puts first, which goes on drawing until every bin has been seen."""
    table = draws()
    held = F.filter(bins, lambda x: value_of(x).isNotNull())
    return let(F.struct(bins.alias("all"), held.alias("held")), lambda s: F.transform(
        F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(
            value_of(F.get(s["all"], b)),
            *[value_of(F.get(s["all"], F.get(table, b * DRAWS + d))) for d in range(DRAWS)],
            value_of(F.array_min(F.transform(s["held"], lambda x: F.struct(
                F.xxhash64(b, bin_of(x)).alias("rank"), x.alias("least"))))["least"]))))


def packed(values: Column) -> Column:
    """Low bits of sixteen bins in each long."""
    low = F.lit((1 << BITS) - 1)
    return let(values, lambda v: F.transform(F.sequence(F.lit(0), F.lit(BINS // 16 - 1)), lambda k: F.aggregate(
        F.slice(v, k * 16 + 1, F.lit(16)), F.lit(0).cast("bigint"),
        lambda sum_, x: F.shiftleft(sum_, BITS).bitwiseOR(x.bitwiseAND(low)))))


def fingerprint(text: Column) -> Column:
    """Packed fingerprint of a text (array of longs); empty for a text without words."""
    return let(shingle_hashes(text), lambda s: F.when(
        F.size(s) > 0, packed(densified(minima(s)))).otherwise(F.array().cast("array<bigint>")))


def as_hex(longs: Column) -> Column:
    return F.lower(F.array_join(F.transform(longs, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance, 0 to 1. Two texts without words are alike, one without and one with
    words are not; null if either is null."""
    ones = F.lit(0x1111111111111111)
    differing = F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda sum_, x: sum_ + F.bit_count(
        x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(
            F.shiftrightunsigned(x, 3)).bitwiseAND(ones)).cast("int"))
    chance = 2.0 ** -BITS
    share = 1.0 - differing / F.lit(float(BINS))
    return F.when(a.isNull() | b.isNull(), None).when(
        (F.size(a) == 0) | (F.size(b) == 0), F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0)).otherwise(
        F.greatest(F.lit(0.0), (share - chance) / (1.0 - chance)))


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``fingerprint_longs`` and ``fingerprint`` (the same in hex) to every row.

    Null and empty texts, and those of white space only, have an empty one. Rows are
    independent: equal texts have equal fingerprints, an empty table gives an empty one.
    Input columns with the new names are replaced.
    """
    rest = without(df, ["fingerprint_longs", "fingerprint"]).columns
    longs = df.select(*[F.col(f"`{c}`") for c in rest], fingerprint(df[text]).alias("fingerprint_longs"))
    return longs.withColumn("fingerprint", as_hex(F.col("fingerprint_longs")))


def with_next(df: DataFrame, key: str, carried: list[str], ranges_per_task: int = 4) -> DataFrame:
    """Adds ``next_<column>`` from the row that follows in the order of ``key``; the first follows the last.

    Rows are dealt into ranges of the key by approximate quantiles, which are worked out in doubles and
    need not be keys of the table; so the bounds are the least keys of these ranges. The rows at
    the start of a range go to the range before as well, where they only end the order. Null
    keys come first; rows of one key are ordered by the carried columns.
    """
    spark = df.sparkSession
    number = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * ranges_per_task)
    order = F.coalesce(F.col(key), F.lit(-(1 << 63)))
    facts = df.select(order.alias("k")).agg(
        F.min("k"), F.percentile_approx("k", [i / number for i in range(1, number)] or [1.0])).first()
    cuts = sorted({facts[0], *(facts[1] or [])} - {None})
    if not cuts:
        return df.select("*", *[F.col(c).alias(f"next_{c}") for c in carried])

    def range_of(value: Column, bounds: list[int]) -> Column:
        return F.size(F.filter(numbers(bounds, "bigint"), lambda b: b <= value))

    leasts = df.select(order.alias("k")).groupBy(range_of(F.col("k"), cuts)).agg(F.min("k").alias("least"))
    bounds = sorted(r.least for r in leasts.collect())
    held, at = numbers(bounds, "bigint"), range_of(F.col("__order"), bounds)
    before = F.when(F.col("__order") == F.element_at(held, F.col("__range")), F.struct(
        F.when(F.col("__range") == 1, F.lit(len(bounds))).otherwise(F.col("__range") - 1).alias("range"),
        (F.col("__range") == 1).alias("behind"), F.lit(False).alias("own")))
    own = F.struct(F.col("__range").alias("range"), F.lit(False).alias("behind"), F.lit(True).alias("own"))
    copies = df.withColumn("__order", order).withColumn("__range", at).withColumn(
        "__copy", F.explode(F.array_compact(F.array(own, before))))
    line = Window.partitionBy("__copy.range").orderBy("__copy.behind", "__order", *carried)
    led = copies.select("*", *[F.lead(c).over(line).alias(f"next_{c}") for c in carried])
    return led.where("__copy.own").drop("__order", "__range", "__copy")


def edited_fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text: the last half of its code points, rounded
    down, replaced by as many from the start of the next text in the order of ``key`` (or by all
    of it). Adds ``edited``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.
    """
    docs = fingerprints(df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text)), text)
    pairs = with_next(docs.drop("fingerprint"), key, [text, "fingerprint_longs"])
    half = F.floor(F.length(text) / 2).cast("int")
    edited = F.concat(F.col(text).substr(F.lit(1), F.length(text) - half), F.col(f"next_{text}").substr(F.lit(1), half))
    rows = pairs.select(
        key, text, edited.alias("edited"), "fingerprint_longs",
        likeness(F.col("fingerprint_longs"), F.col("next_fingerprint_longs")).alias("near_next"))
    rows = rows.withColumn("edited_longs", fingerprint(F.col("edited")))
    return rows.select(
        key, text, "edited", as_hex(F.col("fingerprint_longs")).alias("fingerprint"),
        as_hex(F.col("edited_longs")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint_longs"), F.col("edited_longs")).alias("near_edited"), "near_next")
