"""Text quality by a generalised additive model with pairwise interactions.

Each feature of a text has a table of additive terms, one for each bin of its values. Tables are
learnt by cyclic boosting: round after round, each feature in turn gets a shallow tree over its
bins, fitted to the gradient and added with a small step. Then the pairs of features that would
gain most get tables over their joint bins in the same way. A score is the sum of the looked-up
terms, for arrays of texts at once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField

from billweave.llm.tables import bounded_batches, texts, with_python_columns

FEATURES = [
    "words", "word_length", "upper", "symbols", "most_symbol", "digits", "distinct_words", "distinct_lines",
    "line_words", "broken_words", "most_word", "stops", "short_words", "capitals", "wide", "blanks", "distinct_pairs",
    "longest_word", "marked_words", "commas",
]
#: At most so many labelled rows are learnt from, chosen by a hash of their id.
SAMPLE_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, STEP, SHRINK = 150, 0.15, 2.0

UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'-\"")
BLANKS = b" \t\n\x0b\x0c\r"
WIDE = bytes(range(128, 256))
BROKEN = re.compile(rb"[^\w.,;:?!'\"()\x80-\xff-]|[!?]{2}|\w[^\w.,'\x80-\xff\s-]+\w")


def features(text: bytes) -> list[float]:
    """The values of FEATURES; all counts are over the whole text and, but for the first, relative."""
    size, words = max(1, len(text)), text.split()
    n = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    stripped = len(text.translate(None, BLANKS))
    upper = len(text) - len(text.translate(None, UPPER))
    letters = max(1, stripped - symbols)
    return [
        np.log1p(len(words)), stripped / n, upper / letters, symbols / size,
        max((text.count(bytes([s])) for s in SYMBOLS), default=0) / size if symbols else 0.0,
        (len(text) - len(text.translate(None, DIGITS))) / size, len(counts) / n ** 0.8,
        len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
        len(BROKEN.findall(text)) / n if symbols else 0.0, max(counts.values(), default=0) / n,
        text.count(b".") / n, sum(c for w, c in counts.items() if len(w) <= 3) / n,
        sum(c for w, c in counts.items() if w[:1].isupper()) / n,
        (len(text) - len(text.translate(None, WIDE))) / size, (len(text) - stripped) / size,
        pairs / max(1, n - 1), np.log1p(max(map(len, counts), default=0)),
        sum(c for w, c in counts.items() if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,") / n,
        text.count(b",") / n,
    ]


# ---- the model ----------------------------------------------------------------


def tree(gradient: np.ndarray, weight: np.ndarray, depth: int = 2) -> np.ndarray:
    """Terms of a tree over ordered bins: halves are split where that gains most."""
    out = np.full(len(gradient), gradient.sum() / (weight.sum() + SHRINK))
    if depth and len(gradient) > 1:
        g, h = np.cumsum(gradient)[:-1], np.cumsum(weight)[:-1]
        rest_g, rest_h = gradient.sum() - g, weight.sum() - h
        gain = g * g / (h + SHRINK) + rest_g * rest_g / (rest_h + SHRINK)
        gain[(h < 1e-3) | (rest_h < 1e-3)] = -1
        cut = int(np.argmax(gain)) + 1
        if gain[cut - 1] > gradient.sum() ** 2 / (weight.sum() + SHRINK) + 1e-9:
            out[:cut] = tree(gradient[:cut], weight[:cut], depth - 1)
            out[cut:] = tree(gradient[cut:], weight[cut:], depth - 1)
    return out


def pair_tree(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Terms of a tree over a square of bins: the better axis is cut first, then each half along the other."""
    best, out = -1.0, np.full(gradient.shape, gradient.sum() / (weight.sum() + SHRINK))
    for axis in (0, 1):
        g, h = (gradient, weight) if axis == 0 else (gradient.T, weight.T)
        for cut in range(1, len(g)):
            terms = np.empty_like(g)
            for part in (slice(0, cut), slice(cut, None)):
                terms[part] = tree(g[part].sum(0), h[part].sum(0), 1)[None, :]
            gain = float((2 * g * terms - h * terms * terms).sum())
            if gain > best:
                best, out = gain, terms if axis == 0 else terms.T
    return out


class Gam:
    """Bin edges, tables and pair tables; made by ``fit``."""

    def __init__(self, base: float, edges: list[np.ndarray], tables: list[np.ndarray],
                 pairs: list[tuple[int, int]], squares: list[np.ndarray]):
        self.base, self.edges, self.tables, self.pairs, self.squares = base, edges, tables, pairs, squares

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)]

    def coarse(self, k: int, at: np.ndarray) -> np.ndarray:
        return at * PAIR_BINS // (len(self.edges[k]) + 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        total = np.full(len(x), self.base)
        for table, own in zip(self.tables, at, strict=True):
            total += table[own]
        for (j, k), square in zip(self.pairs, self.squares, strict=True):
            total += square[self.coarse(j, at[j]), self.coarse(k, at[k])]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Learn from rows of features and labels 0 or 1; without rows, or with one label only, the share of
    ones, smoothed, is all there is to learn."""
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.empty(0)
             for k in range(x.shape[1])]
    model = Gam(base, edges, [np.zeros(len(e) + 1) for e in edges], [], [])
    if len(y) == 0 or y.min() == y.max():
        return model
    at, total = model.bins(x), np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for k, table in enumerate(model.tables):
            g, h = slopes()
            n = len(table)
            terms = STEP * tree(np.bincount(at[k], g, n), np.bincount(at[k], h, n))
            table += terms
            total += terms[at[k]]

    def square(j: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cell = model.coarse(j, at[j]) * PAIR_BINS + model.coarse(k, at[k])
        g, h = slopes()
        shape = (PAIR_BINS, PAIR_BINS)
        return cell, np.bincount(cell, g, PAIR_BINS ** 2).reshape(shape), np.bincount(
            cell, h, PAIR_BINS ** 2).reshape(shape)

    def gain(pair: tuple[int, int]) -> float:
        _, g, h = square(*pair)
        return float((g * g / (h + SHRINK)).sum())

    every = [(j, k) for j in range(len(edges)) for k in range(j)]
    model.pairs = sorted(every, key=gain, reverse=True)[:PAIRS]
    model.squares = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    for _ in range(ROUNDS // 5):
        for pair, held in zip(model.pairs, model.squares, strict=True):
            cell, g, h = square(*pair)
            terms = STEP * pair_tree(g, h)
            held += terms
            total += terms.ravel()[cell]
    return model


# ---- Spark steps ----------------------------------------------------------------


def is_held_out(key: Column) -> Column:
    """Rows that nothing is learnt from: crc32 of the key as text is divisible by five, or the key is null."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(True))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, rows: int,
) -> DataFrame:
    """Key, text and label of at most ``rows`` labelled rows that may be learnt from. The chosen keys, of
    which there are no more than ``rows``, are broadcast, so texts stay where they are."""
    bounded_batches(docs.sparkSession)
    chosen = (
        labels.where(F.col(label).isNotNull() & ~is_held_out(F.col(key))).select(F.col(key).alias("__key"), label)
        .groupBy("__key").agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("__key"), "__key").limit(rows))
    return docs.select(key, text).join(F.broadcast(chosen), F.col(key) == F.col("__key")).select(key, text, "label")


def train(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, rows: int) -> Gam:
    sample = labelled_sample(docs, labels, label, key, text, rows)

    def run(batches):
        for batch in batches:
            values = [features(t) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(values, pa.list_(pa.float64()))],
                names=["key", "label", "values"])

    found = sample.mapInArrow(run, "key long, label int, values array<double>").toArrow()
    order = np.argsort(found["key"].to_numpy(), kind="stable")
    values = np.array(found["values"].to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(values[order], found["label"].to_numpy().astype(float)[order])


def quality_scores(
    df: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text",
    threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Adds ``held_out``, ``score`` (0 to 1, chance of label 1) and ``predicted`` to every row.

    The model is fitted on the driver, to the features of at most ``sample_rows`` labelled rows that
    are not held out; the whole text of every row is scored. Null and empty texts have
    features too (all counts are 0) and get a score. Repeated rows get equal scores. An empty
    table gives an empty one; without labels all scores are 0.5. Other columns stay;
    input columns with the new names are replaced.
    """
    model = df.sparkSession.sparkContext.broadcast(train(df, labels, label, key, text, sample_rows))
    scored = with_python_columns(
        df, text, [StructField("score", DoubleType()), StructField("predicted", IntegerType())],
        scorer(lambda column: model.value.score(
            np.array([features(t) for t in texts(column)], float).reshape(-1, len(FEATURES))), threshold))
    return scored.withColumn("held_out", is_held_out(F.col(key)))


def scorer(score: Callable[[pa.Array], np.ndarray], threshold: float) -> Callable:
    def columns(column: pa.Array) -> list[pa.Array]:
        parts = [score(column.slice(k, 500)) for k in range(0, len(column), 500)] or [np.empty(0)]
        found = np.concatenate(parts)
        return [pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))]

    return lambda: columns
