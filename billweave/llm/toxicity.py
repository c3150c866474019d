"""Toxicity by multiple-instance learning from labels of whole documents.

A sentence is an instance. Its chance of being toxic is logistic in weights of the words, and
of the beginnings of words, that it holds; a document's chance is the noisy-or of its
sentences. Weights are fitted to document labels only, yet point at the sentences at fault.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)

from billweave.llm.quality import is_held_out, labelled_sample
from billweave.llm.tables import stored, with_python_columns, work_folder

#: At most so many labelled rows are learnt from, chosen by a hash of their id.
SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 128 << 20
#: So many terms, those most at odds with the labels being independent of them, get a weight.
TERMS = 2048
SEEN, BEGINNINGS = 4, (2, 3, 4, 5, 6)
ROUNDS, RATE, DECAY = 400, 0.1, 3e-5
CACHE_WORDS = 400_000

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> list[str]:
    """The word itself and its beginnings (marked by a dash)."""
    return [word, *(word[:n] + "-" for n in BEGINNINGS if n < len(word))]


class Noisy:
    """Weights of terms and a common bias."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def word(self, word: str) -> float:
        weight = self.known.get(word)
        if weight is None:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            weight = self.known[word] = sum(self.weights.get(t, 0.0) for t in terms_of(word))
        return weight

    def margins(self, text: str) -> list[tuple[int, int, float]]:
        """Begin, end and margin of each sentence with a word; equal words of a sentence count once."""
        out, known, word_of = [], self.known, self.word
        for sentence in SENTENCE.finditer(text):
            words = set(WORD.findall(sentence[0].lower()))
            if words:
                total = self.bias
                for w in words:
                    weight = known.get(w)
                    total += word_of(w) if weight is None else weight
                out.append((sentence.start(), sentence.end(), total))
        return out


def chance(margin: float) -> float:
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, margin))))


def noisy_or(margins: list[float]) -> float:
    """Chance that at least one of independent instances is toxic; 0 without instances."""
    return 1 - math.exp(-sum(np.logaddexp(0.0, np.clip(margins, -30, 30)).tolist())) if margins else 0.0


def fit(
    owner: np.ndarray, row: np.ndarray, column: np.ndarray, plain: np.ndarray, labels: np.ndarray, terms: int,
) -> tuple[np.ndarray, float]:
    """Weights and bias. Of the sentences that hold terms, ``owner`` gives the document; ``row`` and ``column`` list sentence
    and term number of each term; ``plain`` counts the other sentences of each document. The likelihood
    of the noisy-or is climbed with Adam."""
    weights, bias = np.zeros(terms + 1), 0.0
    weights[terms] = bias = -4.0
    mean, square = np.zeros(terms + 1), np.zeros(terms + 1)
    n = len(labels)
    for number in range(1, ROUNDS + 1):
        bias = weights[terms]
        margin = bias + np.bincount(row, weights[column], len(owner))
        p, p0 = 1 / (1 + np.exp(-np.clip(margin, -30, 30))), 1 / (1 + np.exp(-np.clip(bias, -30, 30)))
        none = np.bincount(owner, np.logaddexp(0, margin), n) + plain * np.logaddexp(0, bias)
        clean = np.exp(-none)
        # Slope of the log likelihood by the log chance of "no sentence": -1 for clean documents.
        pull = np.where(labels > 0, clean / np.maximum(1 - clean, 1e-9), -1.0)
        by_sentence = pull[owner] * p
        slope = np.append(np.bincount(column, by_sentence[row], terms), by_sentence.sum() + (pull * plain).sum() * p0)
        slope = slope / n - DECAY * np.append(weights[:terms], 0.0)
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope * slope
        weights += RATE * mean / (1 - 0.9 ** number) / (np.sqrt(square / (1 - 0.999 ** number)) + 1e-8)
    return weights[:terms], float(weights[terms])


# ---- Spark steps ------------------------------------------------------------------


def chosen_terms(sample: DataFrame, text: str, terms: int) -> list[str]:
    """Terms whose documents are more, or less, often toxic than chance would have it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = list(counts[0].keys() | counts[1].keys())
            made = pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array([c[t] for t in names], pa.int64()) for c in counts)],
                names=["term", "clean", "toxic"])
            counts[0].clear()
            counts[1].clear()
            return made

        for batch in batches:
            for value, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = set(WORD.findall((value.as_py() or "").lower()))
                counts[1 if label else 0].update({t for w in words for t in terms_of(w)})
                if len(counts[0]) > 500_000:
                    yield flush()
        yield flush()

    counted = sample.select(text, "label").mapInArrow(run, "term string, clean long, toxic long")
    totals = sample.agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("toxic")).first()
    share = F.lit((totals.toxic or 0) / max(1, totals.rows))
    both = counted.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    seen = F.col("clean") + F.col("toxic")
    odd = F.abs(F.col("toxic") - seen * share) / F.sqrt(seen * share + 1e-9)
    best = both.where(seen >= SEEN).orderBy(odd.desc(), "term").limit(terms)
    return [r.term for r in best.select("term").collect()]


def flat(held: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document of each sentence, and sentence and number of each term, of lists of lists of numbers."""
    sentences = held.flatten()
    owner = np.repeat(np.arange(len(held)), held.value_lengths().to_numpy())
    row = np.repeat(np.arange(len(sentences)), sentences.value_lengths().to_numpy())
    return owner, row, sentences.flatten().to_numpy()


def within(sample: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """Rows of a sample, in the order of its hash, as long as their texts have at most ``most`` bytes in all."""
    order = Window.orderBy(F.xxhash64(key), key, "size")  # the rows of a sample are few, and so is one task's work
    sizes = sample.select(key, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size"))
    kept = sizes.withColumn("total", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = kept.where(F.col("total") <= most).select(F.col(key).alias("__kept")).distinct()
    return sample.join(F.broadcast(kept), F.col(key) == F.col("__kept")).drop("__kept")


def train(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, rows: int, most: int) -> Noisy:
    spark = docs.sparkSession
    folder = work_folder(spark, "toxicity")
    sample = within(stored(labelled_sample(docs, labels, label, key, text, rows), folder, "sample"), key, text, most)
    terms = chosen_terms(sample, text, TERMS)
    number = {t: i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, plain = [], []
            for value in batch.column(1):
                own, rest = [], 0
                for sentence in SENTENCE.findall(value.as_py() or ""):
                    words = set(WORD.findall(sentence.lower()))
                    found = [number[t] for w in words for t in terms_of(w) if t in number]
                    if found:
                        own.append(found)
                    elif words:
                        rest += 1
                held.append(own)
                plain.append(rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(held, pa.list_(pa.list_(pa.int32()))),
                 pa.array(plain, pa.int64())], names=["key", "label", "held", "plain"])

    found = sample.select(key, text, "label").mapInArrow(
        run, "key long, label int, held array<array<int>>, plain long").toArrow().sort_by("key")
    y = found["label"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return Noisy({}, 30.0 if len(y) and y.min() > 0 else -30.0)
    owner, row, column = flat(found["held"].combine_chunks())
    weights, bias = fit(owner, row, column, found["plain"].to_numpy().astype(float), y, len(terms))
    return Noisy(dict(zip(terms, weights.tolist(), strict=True)), bias)


def toxicity_scores(
    df: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text",
    threshold: float = 0.5, sentence_threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS,
    with_sentences: bool = True, sample_bytes: int = SAMPLE_BYTES,
) -> DataFrame:
    """Adds ``held_out``, ``score``, ``predicted`` and ``offending`` to every row.

    ``score`` is the noisy-or of all sentences of the whole text; ``offending`` lists begin, end
    (code points), text and score of the sentences of at least ``sentence_threshold``. Texts
    without words, null and empty ones among them, score 0 and offend nowhere. Repeated rows
    get equal results; an empty table gives an empty one. Without labels, or without a toxic
    one, scores are all but 0. The model is fitted on the driver to at most ``sample_rows``
    labelled rows that are not held out, with at most ``sample_bytes`` of text in all. Other columns stay; input columns with the new names are
    replaced.
    """
    model = df.sparkSession.sparkContext.broadcast(train(df, labels, label, key, text, sample_rows, sample_bytes))
    span = StructType([StructField("begin", LongType()), StructField("end", LongType()),
                       StructField("sentence", StringType()), StructField("score", DoubleType())])
    fields = [StructField("score", DoubleType()), StructField("predicted", IntegerType()),
              *[StructField("offending", ArrayType(span))] * with_sentences]
    arrow = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("sentence", pa.string()),
                                ("score", pa.float64())]))
    least = math.log(sentence_threshold / (1 - sentence_threshold))

    def start():
        noisy = model.value

        def columns(column: pa.Array) -> list[pa.Array]:
            scores, offending = [], []
            for value in column:
                held = value.as_py() or ""
                found = noisy.margins(held)
                scores.append(noisy_or([m for _, _, m in found]))
                offending.append([
                    {"begin": b, "end": e, "sentence": held[b:e], "score": chance(m)} for b, e, m in found if m >= least])
            return [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()),
                    *[pa.array(offending, arrow)] * with_sentences]

        return columns

    return with_python_columns(df, text, fields, start).withColumn("held_out", is_held_out(F.col(key)))
