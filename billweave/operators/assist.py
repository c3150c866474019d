"""Assisted extraction as tables: request queue, answer parsing, merge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billweave import fixed_values as fv
from billweave.functions.normalize import Options, field_text
from billweave.functions.text import fill, let, missing, strip
from billweave.plans.storage import path_exists, run_folder, stored

FIELDS = list(fv.FIELD_PATTERNS)
Provider = Callable[[DataFrame], DataFrame]


def is_low_confidence(options: Options = Options()) -> Column:
    return (
        F.lit(options.assist)
        & (F.col("source") != fv.SOURCE_TAGGED)
        & (F.col("full_text") != "")
        & (F.col("confidence") < F.lit(options.confidence_threshold))
    )


def empty_fields() -> Column:
    """Names of the empty pattern fields, in table order."""
    return F.array_compact(F.array(*[F.when(missing(F.col(f)), F.lit(f)) for f in FIELDS]))


def request_text(context: Column, field: Column) -> Column:
    before, after = fv.ASSIST_REQUEST_PARTS
    return F.concat(
        F.lit(before), F.substring(context, 1, fv.ASSIST_CONTEXT_CHARS), F.lit(after),
        field, F.lit("="))


def requests(df: DataFrame, options: Options = Options()) -> DataFrame:
    """``rel_path, field, system_text, request_text``: one row per empty field of
    a low-confidence text document."""
    queue = df.filter(is_low_confidence(options)).select(
        "rel_path", "full_text", F.explode_outer(empty_fields()).alias("field")
    ).filter(F.col("field").isNotNull())
    return queue.select(
        "rel_path", "field", F.lit(fv.ASSIST_SYSTEM_TEXT).alias("system_text"),
        request_text(F.col("full_text"), F.col("field")).alias("request_text"))


def parse_answer(answer: Column, wanted: Column) -> Column:
    """Array of (field, value) for the wanted names that have a ``name=value``
    line; the last line of a name counts and UNSURE means empty."""
    def one(lines: Column, name: Column) -> Column:
        prefix = F.concat(name, F.lit("="))
        line = F.try_element_at(F.filter(lines, lambda l: F.startswith(l, prefix)), F.lit(-1))
        value = strip(F.substring(line, F.char_length(prefix) + 1, F.char_length(line)))
        return F.struct(
            name.alias("field"),
            F.when(value == fv.ASSIST_UNSURE, F.lit("")).otherwise(value).alias("value"))

    found = let(
        F.split(strip(answer), "\n"), lambda lines: F.transform(wanted, lambda name: one(lines, name)))
    return F.filter(found, lambda r: r["value"].isNotNull())


def parse_answers(answers: DataFrame) -> DataFrame:
    """``rel_path, field, value`` from ``rel_path, wanted, answer_text`` rows."""
    found = parse_answer(F.col("answer_text"), F.col("wanted"))
    number = [c for c in ("answer_no",) if c in answers.columns]
    return answers.select("rel_path", *number, F.inline_outer(found)).filter(F.col("field").isNotNull())


def merge_answers(df: DataFrame, answers: DataFrame, options: Options = Options()) -> DataFrame:
    """Fill empty fields from non-empty answers and note each of them.

    Of several answers for one field the one with the greatest ``answer_no`` counts; without
    that column, or with equal numbers, the greatest text.
    """
    useful = answers.filter((F.col("value") != "") & (F.col("value") != fv.ASSIST_UNSURE))
    number = F.col("answer_no") if "answer_no" in answers.columns else F.lit(0)
    last = F.struct(number.alias("n"), F.col("value").alias("value"))
    wide = useful.groupBy("rel_path").agg(*[
        F.max(F.when(F.col("field") == f, last))["value"].alias(f"_a_{f}") for f in FIELDS])
    joined = df.join(wide, "rel_path", "left")
    taken = {f: missing(F.col(f)) & F.col(f"_a_{f}").isNotNull() for f in FIELDS}
    notes = F.array_compact(F.array(*[
        F.when(hit, F.lit(fv.MSG_ASSISTED + f)) for f, hit in taken.items()]))
    return joined.withColumns({
        "validation_notes": F.concat(F.col("validation_notes"), notes),
        **{f: fill(F.col(f), field_text(f, F.col(f"_a_{f}"), options)) for f in FIELDS},
    }).drop(*[f"_a_{f}" for f in FIELDS])


def assisted(df: DataFrame, provider: Provider, options: Options = Options()) -> DataFrame:
    """Requests to a provider, a function from the request table to
    ``rel_path, field, answer_text`` rows (and ``answer_no``, if a field can have several), and
    its answers back into the rows."""
    answers = provider(requests(df, options)).withColumn("wanted", F.array("field"))
    return merge_answers(df, parse_answers(answers), options)


def request_digest() -> Column:
    """What makes two requests the same: both texts."""
    return F.sha2(F.concat_ws("\0", "system_text", "request_text"), 256)


def answered(
    asked: DataFrame, provider: Provider, store: str, attempts: int = 3, batch_rows: int = 100_000,
) -> tuple[DataFrame, int]:
    """Answers to a request table, out of a store of earlier answers where it has them, and how often a provider was asked.

    The store, a folder, keeps each answer under the digest of its request, so equal requests, of one run or of
    several, are asked once. What it lacks goes to the provider in batches by digest, each stored when
    it is done; requests without an answer (no row, or a null) are asked again, ``attempts`` times in all. A run that breaks off
    loses its last batch only. A request that is never answered gives no row.
    """
    spark = asked.sparkSession
    keyed = asked.withColumn("digest", request_digest())

    def known() -> DataFrame | None:
        return spark.read.parquet(store) if path_exists(spark, store) else None

    def lacking() -> DataFrame:
        once = keyed.groupBy("digest").agg(F.min(F.struct("rel_path", "field", "system_text", "request_text")).alias("r"))
        held = known()
        left = once if held is None else once.join(held.select("digest").distinct(), "digest", "left_anti")
        return left.select("digest", "r.*")

    n_asked = 0
    for _ in range(attempts):
        left = stored(lacking(), run_folder(spark), "lacking")
        n_left = left.count()
        if not n_left:
            break
        n_asked += n_left
        n_batches = -(-n_left // batch_rows)
        for number in range(n_batches):
            batch = left.filter(F.pmod(F.xxhash64("digest"), F.lit(n_batches)) == number)
            answers = provider(batch.drop("digest")).filter(F.col("answer_text").isNotNull())
            if "answer_no" not in answers.columns:
                answers = answers.withColumn("answer_no", F.lit(0))
            batch.select("digest", "rel_path", "field").join(answers, ["rel_path", "field"]).select(
                "digest", "answer_no", "answer_text").write.mode("append").parquet(store)
    held = known()
    if held is None:
        return keyed.limit(0).select("rel_path", "field", F.lit(0).alias("answer_no"), F.lit("").alias("answer_text")), n_asked
    # a batch that was written twice gives the same answer once
    once = held.groupBy("digest", "answer_no").agg(F.max("answer_text").alias("answer_text"))
    return keyed.select("rel_path", "field", "digest").join(once, "digest").drop("digest"), n_asked


def with_store(provider: Provider, store: str, attempts: int = 3) -> Provider:
    """A provider that answers from a store and asks the given one for the rest."""
    return lambda asked: answered(asked, provider, store, attempts)[0]
