"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words counts common subsequences of three characters, each weighted by
0.7 ** span, with spans of up to five: "stupid", "st*upid" and "s.t.u.p.i.d" share most of theirs.
Characters are folded first (case, look-alike digits and signs); single characters that follow
one another count as one word.  Landmark words make the kernel a map to a few hundred features
(Nyström), on which the machine is trained.  Labels belong to texts, not words, so training picks
in each toxic text the words that score highest (multiple instances), and adds the clean words
that score too high.  As the kernel is a product of subsequence weights, the machine folds into
one weight per subsequence, and scoring is one pass over the bytes.  A text's score is a logistic
function of its best words' scores.

Labels come from at most ``sample`` texts of either label; where these are few, words of a language that the
sample hardly holds are not learnt.  Results: a null or empty
text scores as having no word; a text of any length is scored whole; repeated rows score equally;
with no labelled texts of both kinds every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, pieces, written
from .sampling import first_by_hash, fold, held_out, with_texts
from .words import byte_view, mix, range_digests, spans

SAMPLE = 1500
FOLDS, HELD_OUT = 4, 2
DECAY, LONGEST_SPAN = 0.7, 5
LANDMARKS, NEGATIVES, ROUNDS, WITNESSES = 256, 8_000, 4, 4
THRESHOLD = 0.3
BEST = 3
SCHEMA = "doc_id long, score double"

SYMBOLS, REST = 40, 39
#: Letters, then signs and digits that stand for letters, bytes of other letters, the rest.
CODE = np.full(256, REST, np.int32)
CODE[97:123] = CODE[65:91] = np.arange(26)
for _sign, _letter in zip("013457@$", "oieastas", strict=True):
    CODE[ord(_sign)] = ord(_letter) - 97
CODE[128:192] = 27 + np.arange(64) % 12
CODE[192:] = 26

OFFSETS = [(a, b) for b in range(2, LONGEST_SPAN) for a in range(1, b)]
WEIGHT = {b: DECAY ** (b + 1) for _, b in OFFSETS}


def text_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, and start, end and text of each word without signs at its ends but with one byte on
    either side as its bounds; runs of single characters are one word."""
    space, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    padded = pa.compute.binary_join_element_wise(space, pa.compute.fill_null(texts.cast(pa.large_string()), nothing), space, nothing)
    data, offsets = byte_view(padded)
    starts, ends, first = spans(data, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    letters = np.flatnonzero(CODE[data] != REST)
    a, b = np.searchsorted(letters, starts), np.searchsorted(letters, ends)
    some = b > a
    starts, ends, text = letters[a[some]], letters[b[some] - 1] + 1, text[some]
    single = ends - starts == 1
    joined = np.zeros(len(starts), bool)
    joined[1:] = single[1:] & single[:-1] & (starts[1:] <= ends[:-1] + 1) & (text[1:] == text[:-1])
    last = np.ones(len(starts), bool)
    last[:-1] = ~joined[1:]
    return data, starts[~joined] - 1, ends[last] + 1, text[~joined]


def lengths_norm(n: np.ndarray) -> np.ndarray:
    """Length of a word's subsequence vector, as if all its subsequences differed."""
    total = np.zeros(len(n))
    for _, b in OFFSETS:
        total += np.maximum(n - b, 0) * WEIGHT[b] ** 2
    return np.sqrt(np.maximum(total, 1e-12))


def _triples(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pair of offsets: the word of each subsequence, its number, its weight."""
    code = CODE[data]
    size = ends - starts
    # words may share a bound, so positions are listed word by word
    first = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(word)) - first[word] + starts[word] if len(size) else word
    left = ends[word] - place
    for a, b in OFFSETS:
        inside = np.flatnonzero(left > b)
        at = place[inside]
        yield word[inside], (code[at] * SYMBOLS + code[at + a]) * SYMBOLS + code[at + b], WEIGHT[b]


def word_scores(weights: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The kernel machine's value for each word, without its constant."""
    total = np.zeros(len(starts))
    for word, triple, weight in _triples(data, starts, ends):
        total += np.bincount(word, weights=weights[triple], minlength=len(starts)) * weight
    return total / lengths_norm(ends - starts)


def laid_out(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with their bounds, side by side."""
    size = np.array([len(w) for w in words])
    ends = np.cumsum(size)
    return np.frombuffer(b"".join(words), np.uint8), ends - size, ends


def feature_rows(words: list[bytes]) -> np.ndarray:
    """Subsequence vectors of a few words, dense."""
    data, starts, ends = laid_out(words)
    out = np.zeros((len(words), SYMBOLS**3), np.float32)
    for word, triple, weight in _triples(data, starts, ends):
        np.add.at(out, (word, triple), weight)
    return out / lengths_norm(ends - starts)[:, None].astype(np.float32)


def kernel_rows(by_triple: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Kernel of each word with each column of ``by_triple``, from the word's few subsequences."""
    data, starts, ends = laid_out(words)
    found = list(_triples(data, starts, ends))
    rows = np.concatenate([word for word, _, _ in found])
    triples = np.concatenate([triple for _, triple, _ in found])
    weights = np.concatenate([np.full(len(word), w, np.float32) for word, _, w in found])
    order = np.argsort(rows, kind="stable")
    rows, triples, weights = rows[order], triples[order], weights[order]
    out = np.zeros((len(words), by_triple.shape[1]), np.float64)
    step = 20_000
    for a in range(0, len(rows), step):
        part = rows[a : a + step]
        new = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        out[part[new]] += np.add.reduceat(by_triple[triples[a : a + step]] * weights[a : a + step, None], new, axis=0)
    return out / lengths_norm(ends - starts)[:, None]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of each subsequence
    constant: float
    link: np.ndarray  # logistic weights of a text's best word scores, and a constant

    def best(self, texts: pa.Array) -> np.ndarray:
        """The ``BEST`` highest word scores of each text, -1 at least."""
        data, starts, ends, text = text_words(texts)
        values = word_scores(self.weights, data, starts, ends) + self.constant
        out = np.full((len(texts), BEST), -1.0)
        order = np.lexsort((-values, text))
        rank = np.arange(len(order)) - np.searchsorted(text, text)  # words of a text are consecutive
        top = rank < BEST
        out[text[top], rank[top]] = values[order[top]]
        return np.maximum(out, -1.0)

    def score(self, texts: pa.Array) -> np.ndarray:
        return sigmoid(self.best(texts) @ self.link[:-1] + self.link[-1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def train_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float) -> np.ndarray:
    """Squared-hinge machine on ``x`` (last column constant), by Newton steps on its active rows."""
    beta = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) * penalty
    ridge[-1, -1] = 1e-6
    for _ in range(12):
        active = y * (x @ beta) < 1
        xa, wa = x[active], weight[active][:, None]
        new = np.linalg.solve(xa.T @ (xa * wa) + ridge, xa.T @ (wa[:, 0] * y[active]))
        if np.abs(new - beta).max() < 1e-6:
            break
        beta = new
    return beta


def train_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic weights with a small ridge, by Newton steps; the last is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        p = sigmoid(x @ beta)
        slope = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        beta += np.linalg.solve(slope, x.T @ (weight * (y - p)) - 0.05 * beta)
    return beta


@dataclass(frozen=True)
class Sample:
    """What the fit needs of labelled texts, instead of the texts: their distinct words, and which text has which."""

    words: list[bytes]  # with their bounds, by hash
    hashes: np.ndarray
    pairs: np.ndarray  # (word, text)
    labels: np.ndarray


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Hash, text and spelling of the distinct words of each text, by text."""
    data, starts, ends, text = text_words(texts)
    hashes = range_digests(CODE.astype(np.uint8)[data], starts, ends)[0]
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = order[np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])])] if len(order) else order
    raw = data.tobytes()
    return hashes[new], text[new], [raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]


def sample_of(hashes: np.ndarray, text: np.ndarray, spelled: list[bytes], labels: np.ndarray) -> Sample:
    """A sample from the distinct words of texts 0, 1, ... and their labels."""
    known, at, word = np.unique(hashes, return_index=True, return_inverse=True)
    return Sample([spelled[i] for i in at.tolist()], known, np.column_stack([word.reshape(-1), text]), labels)


def fit(texts: list[str], labels: list[int], rate: float | None = None) -> Model:
    """A model from a few labelled texts at hand."""
    seen: dict[str, int] = {}
    for text, label in zip(texts, labels, strict=True):  # copies would count as evidence of their own
        seen[text or ""] = max(seen.get(text or "", 0), int(label))
    column = pa.array(list(seen), pa.large_string())
    plain = fit_words(sample_of(*distinct_words(column), np.array(list(seen.values()), np.int64)))
    best = plain.best(column)
    return linked(plain, best, np.array(list(seen.values()), np.int64), rate)


def linked(model: Model, best: np.ndarray, labels: np.ndarray, rate: float | None) -> Model:
    """``model`` with the logistic weights for its best word scores; ``rate`` is the share of toxic texts before sampling."""
    if not model.weights.any():
        return model
    share = labels.mean()
    rate = share if rate is None else rate
    return Model(model.weights, model.constant, train_logistic(best, labels, np.where(labels == 1, rate / share, (1 - rate) / (1 - share))))


def fit_words(sample: Sample) -> Model:
    """The kernel machine, without the logistic weights."""
    labels_, known, words, pairs = sample.labels, sample.hashes, sample.words, sample.pairs
    if not len(labels_) or labels_.min() == labels_.max():
        return Model(np.zeros(SYMBOLS**3), 0.0, np.array([0.0] * BEST + [-40.0]))
    spelled = words.__getitem__
    toxic_texts = np.bincount(pairs[labels_[pairs[:, 1]] == 1, 0], minlength=len(known))
    clean_texts = np.bincount(pairs[labels_[pairs[:, 1]] == 0, 0], minlength=len(known))
    size = np.array([len(w) for w in words])
    usable = long_enough = size >= 5  # three characters and the bounds

    # evidence to start with: words that many toxic texts and no clean text have (not just one family of near copies)
    # words that stand in the very same texts come from one family of near copies, not from the language
    texts_of = np.zeros(len(known), np.uint64)
    np.add.at(texts_of, pairs[:, 0], mix(pairs[:, 1].astype(np.uint64)))
    _, same, n_same = np.unique(texts_of, return_inverse=True, return_counts=True)
    usable = long_enough & (n_same[same.reshape(-1)] <= 2)
    in_clean = np.flatnonzero((clean_texts > 0) & long_enough)
    lift = toxic_texts * (clean_texts == 0) * usable
    need = min(max(3, 0.02 * labels_.sum()), lift.max())
    positive = np.flatnonzero((lift >= need) & (lift > 0))
    negative = in_clean[np.argsort(known[in_clean])][:NEGATIVES]  # by hash: at random, and repeatable
    if not len(positive) or not len(negative):
        return Model(np.zeros(SYMBOLS**3), 0.0, np.array([0.0] * BEST + [np.log(max(labels_.mean(), 1e-6))]))
    frequent = in_clean[np.argsort(-clean_texts[in_clean], kind="stable")][: LANDMARKS // 4]
    strongest = positive[np.argsort(-lift[positive], kind="stable")][: LANDMARKS // 2]
    landmarks = np.unique(np.concatenate([strongest, frequent, negative[: LANDMARKS // 4]]))
    by_triple = np.ascontiguousarray(feature_rows([spelled(i) for i in landmarks]).T)
    value, vector = np.linalg.eigh((by_triple.T @ by_triple).astype(np.float64))
    keep = value > 1e-4
    whiten = vector[:, keep] / np.sqrt(value[keep])  # Nyström map: kernel with landmarks times this

    def mapped(index: np.ndarray) -> np.ndarray:
        return np.column_stack([kernel_rows(by_triple, [spelled(i) for i in index]) @ whiten, np.ones(len(index))])

    only_toxic = (toxic_texts >= 2) & (clean_texts == 0) & usable
    mine = pairs[(labels_[pairs[:, 1]] == 1) & only_toxic[pairs[:, 0]]]
    model = None
    for turn in range(ROUNDS):
        rows = np.concatenate([positive, negative])
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        weight = np.where(y > 0, np.sqrt(np.maximum(toxic_texts[rows], 1)), 1.0)
        weight[y > 0] *= 0.25 * len(negative) / weight[y > 0].sum()
        beta = train_svm(mapped(rows), y, weight, 1.0)
        weights = (by_triple @ (whiten @ beta[:-1])).astype(np.float64)
        model = (weights, float(beta[-1]))
        if turn + 1 == ROUNDS:
            break
        value = word_scores(weights, *laid_out(words)) + model[1]
        # each toxic text's best words are further evidence; clean words that score high are added
        best_first = mine[np.lexsort((-value[mine[:, 0]], mine[:, 1]))]
        rank = np.arange(len(best_first)) - np.searchsorted(best_first[:, 1], best_first[:, 1])
        chosen = np.unique(best_first[rank < WITNESSES, 0])
        positive = np.union1d(positive, chosen[value[chosen] > 0])
        hard = in_clean[value[in_clean] > -0.5]
        negative = np.union1d(negative, hard[np.argsort(-value[hard], kind="stable")][: NEGATIVES // 4])
    return Model(*model, np.zeros(BEST + 1))


def fit_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` rows of either label outside the held-out fold.

    The driver gets the sampled texts' distinct words, then their best word scores, never a text.
    """
    known = labels.select("doc_id", F.col("toxic").alias("label")).filter((fold(FOLDS) != HELD_OUT) & F.col("label").isin(0, 1))
    ids = first_by_hash(known.filter("label = 1"), sample).union(first_by_hash(known.filter("label = 0"), sample))
    rows = with_texts(ids, docs).withColumn("text", F.coalesce("text", F.lit("")))
    # copies would count as evidence of their own
    rows = written(rows.groupBy(F.sha2("text", 256).alias("digest")).agg(F.first("text").alias("text"), F.max("label").cast("long").alias("label")), "labelled")

    texts = rows.select("digest", "label").orderBy("digest").toArrow()
    known_labels = texts.column("label").to_numpy()
    numbers = docs.sparkSession.createDataFrame(list(zip(texts.column("digest").to_pylist(), range(len(known_labels)), strict=True)), "digest string, text_no int")  # at most two samples
    texts_ = rows.join(F.broadcast(numbers), "digest").select("text_no", "text")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            hashes, text, spelled = distinct_words(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("text_no").take(pa.array(text)), pa.array(hashes.view(np.int64)), pa.array(spelled, pa.binary())], names=["text_no", "hash", "word"])

    words = texts_.mapInArrow(spell, "text_no int, hash long, word binary")
    pairs = words.select("text_no", "hash").orderBy("text_no", "hash").toArrow()
    spellings = words.groupBy("hash").agg(F.min("word").alias("word")).toArrow()
    hashes = spellings.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    word = np.searchsorted(hashes[order], pairs.column("hash").to_numpy().view(np.uint64))
    sample_ = Sample(spellings.column("word").take(pa.array(order)).to_pylist(), hashes[order], np.column_stack([word, pairs.column("text_no").to_numpy().astype(np.int64)]), known_labels)
    del pairs, spellings
    plain = fit_words(sample_)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("text_no"), *map(pa.array, plain.best(batch.column("text")).T.copy())], names=["text_no", *(f"best{k}" for k in range(BEST))])

    best = texts_.mapInArrow(measure, "text_no int, " + ", ".join(f"best{k} double" for k in range(BEST))).orderBy("text_no").toArrow()
    rate = known.agg(F.avg("label").alias("rate")).first()["rate"]
    model = linked(plain, np.column_stack([best.column(f"best{k}").to_numpy() for k in range(BEST)]), known_labels, rate)
    discard(rows)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    model = fit_on(docs, labels, sample)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(batch.column("text")))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(score, SCHEMA)
    return scored.select("doc_id", held_out(FOLDS, HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
