"""Quality classifier by positive-unlabelled learning.

A linear model over binned text statistics is trained from trusted positives (labelled good) and
unlabelled web text: the risk is prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior *
E_pos[loss(-)]), the non-negative unbiased estimate, with the logistic loss.  The share of good
text is estimated as well: a first model separates positives from unlabelled text, and the prior
is the least ratio of unlabelled to positive mass above a threshold (best-bin estimate).  Negative
labels are never used.

Gradient steps use at most ``positives`` labelled rows and ``unlabelled`` others, taken by hash of the
id: a larger sample only makes the weights steadier.  The prior comes from all documents, as a
histogram of the first model's scores, and every row is scored.  Results: a null or empty text has the statistics of no words; texts are
measured whole; repeated rows score equally; without positives every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces
from .quality_rules import SYMBOLS, line_repeats, per_text, repeated
from .sampling import first_by_hash, fold, held_out, with_texts
from .words import U64, Words, byte_view, mix, range_digests, spans

POSITIVES, UNLABELLED = 4000, 8000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
BINS, STEPS = 12, 400
#: Share of the positives that a threshold of the prior must leave, and number of thresholds.
LEAST_POSITIVES, CUTS = 0.2, 81
FEATURES = ("word_chars", "words", "distinct", "same_as_last", "symbols", "upper", "digits", "marks", "bare_words", "marked_words", "dup_lines", "line_chars", "line_ends", "long_words", "short_words", "wide")
SCHEMA = "doc_id long, score double"


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    data, offsets = byte_view(texts)
    starts, ends, first = spans(data, offsets)
    w = Words(data, offsets, starts, ends, range_digests(data, starts, ends), first)
    text = w.text_of()
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    point = (data & 0xC0) != 0x80
    n_words = np.maximum(w.counts, 1)
    chars = np.maximum(per_text(point & ~blank, offsets), 1)
    letter = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128)
    digit = (data >= 48) & (data <= 57)
    mark = ~blank & ~letter & ~digit
    share = lambda mask: per_text(mask, offsets) / chars
    of_word = lambda mask: per_text(mask, first) / n_words
    letters = np.concatenate([[0], np.cumsum(letter & point)])
    n_letters = letters[ends] - letters[starts]
    seen_twice = repeated(mix(w.hashes ^ mix(text.astype(U64))))
    last = np.zeros(len(starts), bool)
    last[1:] = (w.hashes[1:] == w.hashes[:-1]) & (text[1:] == text[:-1])
    dup_lines, _ = line_repeats(data, offsets, blank)
    lines = per_text(data == 10, offsets) + 1
    marked = np.zeros(len(starts), bool)
    if len(starts):
        marked = (ends - starts >= 2) & mark[ends - 1] & mark[ends - 2]
    columns = [
        chars / n_words, np.log1p(w.counts), 1 - of_word(seen_twice), of_word(last), share(np.isin(data, np.frombuffer(SYMBOLS, np.uint8))),
        share((data >= 65) & (data <= 90)), share(digit), share(mark), of_word(n_letters == 0), of_word(marked), dup_lines / lines,
        np.log1p(chars / lines), share((data == 46) | (data == 44)), of_word(n_letters > 12), of_word(n_letters <= 3), share(data >= 192),
    ]
    return np.column_stack(columns)


@dataclass(frozen=True)
class Model:
    edges: list[np.ndarray]  # of each statistic's bins
    weights: np.ndarray
    prior: float

    def score(self, texts: pa.Array) -> np.ndarray:
        return sigmoid(apply(binned(statistics(texts), self.edges), self.weights))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """For each row the numbers of its indicators: the constant, then one bin of each statistic."""
    out = np.zeros((len(values), len(edges) + 1), np.int64)
    at = 1
    for k, cut in enumerate(edges):
        out[:, k + 1] = at + np.searchsorted(cut, values[:, k], "right")
        at += len(cut) + 1
    return out


def apply(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The linear model's value for each row of indicators."""
    return weights[rows].sum(axis=1)


def gather(rows: np.ndarray, by_row: np.ndarray, size: int) -> np.ndarray:
    """The mean over the rows of ``by_row`` for each indicator."""
    return np.bincount(rows.ravel(), weights=np.repeat(by_row, rows.shape[1]), minlength=size) / len(rows)


def descend(gradient, size: int, ridge: float = 1e-3) -> np.ndarray:
    """Adam steps on a full-batch gradient."""
    w, m, v = (np.zeros(size) for _ in range(3))
    for step in range(1, STEPS + 1):
        g = gradient(w) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, cuts: np.ndarray, above: np.ndarray, n_unlabelled: int) -> float:
    """The least ratio of unlabelled to positive mass above a score, where some positives are; ``above`` counts
    the unlabelled at each of ``cuts`` or higher."""
    p = 1 - np.searchsorted(np.sort(positive), cuts, "left") / len(positive)
    some = p >= LEAST_POSITIVES
    slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(n_unlabelled) + 1 / np.sqrt(len(positive)))
    return float(np.clip(((above / n_unlabelled + slack)[some] / p[some]).min() - slack, 0.05, 0.98))


def fit_first(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """A model that sets positives apart from unlabelled texts, each half of the weight."""
    both = np.concatenate([positive, unlabelled]) if len(positive) else unlabelled
    edges = [np.unique(np.quantile(both[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(both) else np.zeros(0) for k in range(len(FEATURES))]
    p, u = binned(positive, edges), binned(unlabelled, edges)
    size = 1 + sum(len(e) + 1 for e in edges)
    if not len(p) or not len(u):
        return Model(edges, np.zeros(size), 0.5)

    def apart(w: np.ndarray) -> np.ndarray:
        return 0.5 * gather(u, sigmoid(apply(u, w)), size) - 0.5 * gather(p, 1 - sigmoid(apply(p, w)), size)

    return Model(edges, descend(apart, size), 0.5)


def fit(first: Model, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """The model of least non-negative risk, over the bins of ``first``."""
    p, u = binned(positive, first.edges), binned(unlabelled, first.edges)
    edges, size = first.edges, len(first.weights)

    def risk(w: np.ndarray) -> np.ndarray:
        at_p, at_u = apply(p, w), apply(u, w)
        as_negative = np.logaddexp(0, at_u).mean() - prior * np.logaddexp(0, at_p).mean()
        from_negatives = gather(u, sigmoid(at_u), size) - prior * gather(p, sigmoid(at_p), size)
        if as_negative < 0:  # the estimate of the negatives' loss has gone below zero: step back
            return -from_negatives
        return from_negatives - prior * gather(p, 1 - sigmoid(at_p), size)

    return Model(edges, descend(risk, size), prior)


def fit_on(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """A model from the labelled good rows outside the held-out fold, and from all documents."""
    good = first_by_hash(labels.filter((fold(FOLDS) != HELD_OUT) & (F.col("quality") == 1)).select("doc_id"), positives)
    web = first_by_hash(docs.select("doc_id").filter("doc_id is not null"), unlabelled)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(statistics(batch.column("text")).tolist(), pa.list_(pa.float64()))], names=["doc_id", "x"])

    def measured(ids: DataFrame) -> np.ndarray:
        rows = with_texts(ids, docs).mapInArrow(measure, "doc_id long, x array<double>").orderBy("doc_id").toArrow()
        return np.array(rows.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))

    p, u = measured(good), measured(web)
    first = fit_first(p, u)
    if not len(p) or not len(u):
        return first
    of_p = apply(binned(p, first.edges), first.weights)
    cuts = np.quantile(of_p, np.linspace(0, 1 - LEAST_POSITIVES, CUTS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CUTS + 1, np.int64)
        for batch in pieces(batches):
            value = apply(binned(statistics(batch.column("text")), first.edges), first.weights)
            total += np.bincount(np.searchsorted(cuts, value, "right"), minlength=CUTS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(CUTS + 1), pa.int32()), pa.array(total)], names=["bin", "n"])

    bins = np.zeros(CUTS + 1, np.int64)
    for row in docs.select("text").mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # a row for each bin
        bins[row["bin"]] = row["n"]
    above = np.cumsum(bins[::-1])[::-1][1:]  # at each cut or higher
    return fit(first, p, u, estimate_prior(of_p, cuts, above, int(bins.sum())))


def score_quality(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    model = fit_on(docs, labels, positives, unlabelled)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(batch.column("text")))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(score, SCHEMA)
    return scored.select("doc_id", held_out(FOLDS, HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
