"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are compared without ASCII case and punctuation.  Word frequencies over the whole corpus say
which three-word runs of a test item are rare (the product of their words' shares is at most
1e-7); those are seeds, and so is the least frequent run of each stretch of 12 that no rare one
touches.  Runs with a word that the corpus lacks cannot be found and are left out.  An item of fewer
words is its own seed.  Where a passage holds a seed, the words around it are aligned with the item,
and the score over the best possible score is the similarity.  From 0.45 on the item has leaked
(passages that only share words by chance stay below 0.35).

The corpus is read twice, however many items there are: once to count the items' words, once to find
seeds.  Both readings hold one bitmap of 8 MB, which lets through what may be wanted and never loses
anything; what it lets through meets the exact tables in joins.  Documents with a seed are written as
chunks of 1024 word hashes, so that only the chunks around a seed move on, never whole texts.

Results: null or empty texts and items never match; each row of ``docs`` is judged on its own, so
repeated rows get equal results, a row each; rows of ``benchmark`` that are equal count once; several
windows of one document that match one item give one row, the best (of equals the first); items that
tie are all reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STAGE_BYTES, cut, discard, pieces, written
from .words import U64, Words, byte_view, range_digests, spans, windows

SEED, RARE, STRETCH, SIMILARITY = 3, 1e-7, 12, 0.45
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bits of a filter, as a power of two.
FILTER_BITS = 26
CHUNK = 1024
#: Cells of the alignment table that are worked on at once.
CELLS = 400_000
#: A list of leaked documents of up to so many rows goes to all tasks; a longer one is joined.
LEAST_JOINED = 500_000

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32


def folded_words(texts: pa.Array) -> Words:
    """Words without ASCII case and punctuation."""
    data, offsets = byte_view(texts)
    data = FOLD[data]
    starts, ends, first = spans(data, offsets)
    return Words(data, offsets, starts, ends, range_digests(data, starts, ends), first)


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = h.view(U64)
    mask = U64((1 << FILTER_BITS) - 1)
    return h & mask, (h >> U64(FILTER_BITS)) & mask


def may_hold(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash may be one of those of the bitmap."""
    out = np.ones(len(h), bool)
    for at in _bits(h):
        out &= ((bitmap[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1)).astype(bool)
    return out


def bitmap_of(keys: DataFrame, key: str) -> np.ndarray:
    """A bitmap with two bits set for each value of the long column ``key``: 8 MB whatever their number."""
    mask = (1 << FILTER_BITS) - 1
    both = F.array(F.col(key).bitwiseAND(F.lit(mask)), F.shiftrightunsigned(F.col(key), FILTER_BITS).bitwiseAND(F.lit(mask)))
    bits = keys.select(F.explode(both).alias("bit"))
    rows = bits.groupBy(F.shiftright("bit", 6).alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toArrow()  # at most 2**20 rows
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(U64)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def word_shares(docs: DataFrame, item_words: DataFrame) -> DataFrame:
    """(word, share): the share in all words of ``docs`` of each of ``item_words``, where it is not 0."""
    wanted = bitmap_of(item_words.distinct(), "word")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = 0
        for batch in pieces(batches, limit=STAGE_BYTES):
            h = folded_words(batch.column("text")).hashes
            every += len(h)
            word, n = np.unique(h[may_hold(wanted, h)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([every], pa.int64())], names=["word", "n"])

    counts = written(docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    every = counts.filter("word is null").agg(F.sum("n").alias("n")).first()["n"] or 1
    return counts.filter("word is not null").select("word", (F.col("n") / F.lit(every)).alias("share"))


def seeds_of(words: np.ndarray, sizes: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, item and place of the seeds of items with ``sizes`` words each, given each word's share."""
    first = np.concatenate([[0], np.cumsum(sizes)])
    nothing = np.zeros(0, np.uint8)
    w = Words(nothing, first, first[:0], first[:0], np.stack([words, words]), first)
    out = []
    for n in range(1, SEED + 1):
        h, item, at = windows(w, n)
        if n < SEED:
            use = sizes[item] == n
        else:
            product = share[at] * share[at + 1] * share[at + 2] if len(at) else np.zeros(0)
            found = product > 0
            use = found & (product <= RARE)
            place = at - first[item]
            stretch = np.concatenate([[0], np.cumsum(-(-sizes // STRETCH))])[item] + place // STRETCH
            rare = np.bincount(stretch[use], minlength=int(stretch.max(initial=0)) + 1) > 0
            rest = np.flatnonzero(found & ~rare[stretch])
            rest = rest[np.lexsort((place[rest], product[rest], stretch[rest]))]
            use[rest[np.unique(stretch[rest], return_index=True)[1]]] = True
        out.append((h[use], item[use], at[use] - first[item[use]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _seeds(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(seed, item, n_item, place) of every seed of ``items`` (item, words)."""
    tokens = items.select("item", F.posexplode("words").alias("at", "word"))
    shares = word_shares(docs, tokens.select("word"))
    known = tokens.join(shares, "word", "left").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("at", "word", F.coalesce("share", F.lit(0.0)).alias("share")))).alias("x"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column("words")).to_numpy(zero_copy_only=False).astype(np.int64)
            for part in cut(batch, 16 * sizes):
                sizes = pa.compute.list_value_length(part.column("words")).to_numpy(zero_copy_only=False).astype(np.int64)
                h, item, place = seeds_of(part.column("words").flatten().to_numpy().view(U64), sizes, part.column("shares").flatten().to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), part.column("item").take(pa.array(item)), pa.array(sizes[item]), pa.array(place)], names=["seed", "item", "n_item", "place"])

    return written(known.select("item", F.col("x.word").alias("words"), F.col("x.share").alias("shares")).mapInArrow(find, "seed long, item long, n_item long, place long"), "seeds")


def _chunks(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Documents with a seed, by chunks of words: (row, doc_id, n_words, chunk, words, hits), hits being (seed, at)."""
    wanted = bitmap_of(seeds.select("seed").distinct(), "seed")
    lengths = sorted(min(r["n"], SEED) for r in seeds.select(F.least("n_item", F.lit(SEED)).alias("n")).distinct().collect())  # at most three rows

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=STAGE_BYTES):
            w = folded_words(batch.column("text"))
            found = []
            for n in lengths:
                h, text, at = windows(w, n)
                hit = may_hold(wanted, h)
                found.append((h[hit], text[hit], at[hit]))
            h, text, at = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, U64),) * 3
            rows = np.unique(text).astype(np.int64)
            n_chunks = -(-w.counts[rows] // CHUNK)
            of = np.repeat(rows, n_chunks)
            number = np.arange(len(of)) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
            a = w.first[of] + number * CHUNK
            size = np.minimum(a + CHUNK, w.first[of + 1]) - a
            take = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
            order = np.argsort(at, kind="stable")
            h, at, text = h[order], at[order].astype(np.int64), text[order].astype(np.int64)
            chunk = np.searchsorted(a, at, "right") - 1
            n_hits = np.bincount(chunk, minlength=len(a))
            columns = [batch.column("row").take(pa.array(of)), batch.column("doc_id").take(pa.array(of)), pa.array(w.counts[of]), pa.array(number), _lists(w.hashes[take].view(np.int64), size)]
            columns += [_lists(h.view(np.int64), n_hits), _lists(at - w.first[text], n_hits)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_words", "chunk", "words", "seeds", "places"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")  # written at once, so a row keeps its number
    return written(rows.mapInArrow(search, "row long, doc_id long, n_words long, chunk long, words array<long>, seeds array<long>, places array<long>"), "chunks")


def align(item: np.ndarray, n_item: np.ndarray, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each row's item (padded) and passage (padded), and where it ends."""
    rows, width = passage.shape
    steps = -GAP * np.arange(width, dtype=np.int32)
    before = np.zeros((rows, width), np.int32)
    best = np.zeros(rows, np.int32)
    end = np.zeros(rows, np.int64)
    for i in range(item.shape[1]):
        step = np.where(passage == item[:, i : i + 1], MATCH, MISMATCH).astype(np.int32)
        now = np.maximum(before + GAP, 0)
        np.maximum(now[:, 1:], before[:, :-1] + step[:, 1:], out=now[:, 1:])
        np.maximum(now[:, 0], step[:, 0], out=now[:, 0])
        now = np.maximum.accumulate(now + steps, axis=1) - steps  # gaps along the passage
        now[i >= n_item] = 0
        top = now.argmax(axis=1)
        score = now[np.arange(rows), top]
        better = score > best
        best[better], end[better] = score[better], top[better]
        before = now
    return best, end


def aligned(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Similarity of each row's item and passage, and the passage's last word that is aligned, from its own start."""
    lists = [batch.column(c) for c in ("item_words", "passage")]
    sizes = [pa.compute.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
    firsts = [np.concatenate([[0], np.cumsum(n)]) for n in sizes]
    flat = [x.flatten().to_numpy().view(U64) for x in lists]
    score, end = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
    by_size = np.lexsort((sizes[1], sizes[0]))
    at = 0
    while at < len(by_size):
        to = at + max(1, CELLS // max(1, int(sizes[1][by_size[at : at + CELLS]].max())))
        rows = by_size[at:to]
        padded = []
        for n, first, values, none in zip(sizes, firsts, flat, (1, 0), strict=True):
            cols = np.arange(max(1, int(n[rows].max())))
            padded.append(np.where(cols < n[rows][:, None], values[np.minimum(first[rows][:, None] + cols, len(values) - 1)], U64(none)))
        score[rows], end[rows] = align(padded[0], sizes[0][rows], padded[1])
        at = to
    return pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", "doc_id", "item", "a", "n_item")] + [pa.array(score / (MATCH * np.maximum(sizes[0], 1))), pa.array(end)], names=["row", "doc_id", "item", "a", "n_item", "similarity", "end"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, similarity, ...) for each test item that a row of ``docs`` holds a copy of."""
    return _found(docs, benchmark, similarity)[0].drop("row")


def _found(docs: DataFrame, benchmark: DataFrame, similarity: float) -> tuple[DataFrame, list[DataFrame]]:
    """The leaks, and the tables to delete when they have been used."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=STAGE_BYTES):
            w = folded_words(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), _lists(w.hashes.view(np.int64), w.counts)], names=["item", "item_id", "words"])

    numbered = benchmark.select("item_id", "text").distinct().select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    items = written(numbered.mapInArrow(split, "item long, item_id long, words array<long>"), "items")
    seeds = _seeds(docs, items)
    chunks = _chunks(docs, seeds)

    hits = chunks.select("row", "doc_id", "n_words", F.inline(F.arrays_zip("seeds", "places"))).withColumnRenamed("places", "at")
    near = hits.join(seeds, hits["seeds"] == seeds["seed"]).select("row", "doc_id", "n_words", "item", "n_item", (F.col("at") - F.col("place")).alias("diagonal"))
    # seeds of about the same diagonal (the word where the item would start) share a window
    slack = F.floor(F.col("n_item") / 4) + 4
    windows_ = near.groupBy("row", "doc_id", "n_words", "item", "n_item", F.floor(F.col("diagonal") / slack).alias("block")).agg(F.min("diagonal").alias("diagonal"))
    windows_ = windows_.select("row", "doc_id", "item", "n_item", F.greatest(F.col("diagonal") - slack, F.lit(0)).alias("a"), F.least(F.col("diagonal") + F.col("n_item") + 2 * slack, "n_words").alias("b"))
    wanted = windows_.select("*", F.explode(F.sequence(F.floor(F.col("a") / CHUNK), F.floor((F.col("b") - 1) / CHUNK))).alias("chunk"))
    keys = ["row", "doc_id", "item", "n_item", "a", "b"]
    passages = wanted.join(chunks.select("row", "chunk", "words"), ["row", "chunk"])
    lo, hi = F.greatest(F.col("a") - F.col("chunk") * CHUNK, F.lit(0)), F.least(F.col("b") - F.col("chunk") * CHUNK, F.lit(CHUNK))
    passages = passages.select(*keys, F.struct("chunk", F.slice("words", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("part")).alias("part"))
    passages = passages.groupBy(*keys).agg(F.array_sort(F.collect_list("part")).alias("parts"))  # as many as the item is long
    pairs = passages.select(*keys, F.flatten("parts.part").alias("passage")).join(items.select("item", F.col("words").alias("item_words")), "item")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, 8 * (pa.compute.list_value_length(batch.column("passage")).to_numpy(zero_copy_only=False).astype(np.int64) + 8)):
                yield aligned(part)

    schema = "row long, doc_id long, item long, a long, n_item long, similarity double, end long"
    scored = pairs.select("row", "doc_id", "item", "a", "n_item", "item_words", "passage").mapInArrow(compare, schema).filter(F.col("similarity") >= similarity)
    best = scored.groupBy("row", "doc_id", "item", "n_item").agg(F.min(F.struct((-F.col("similarity")).alias("minus"), "a", "end")).alias("best"))
    out = best.join(items.select("item", "item_id"), "item").select("row", "doc_id", "item_id", (-F.col("best.minus")).alias("similarity"), F.col("n_item").alias("n_item_words"), F.col("best.a").alias("passage_start"), (F.col("best.a") + F.col("best.end") + 1).alias("passage_end"))
    # rows of one id with other words are other items: the best of them
    out = out.groupBy("row", "doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("minus"), "passage_start", "passage_end", "n_item_words")).alias("x"))
    return out.select("row", "doc_id", "item_id", (-F.col("x.minus")).alias("similarity"), "x.n_item_words", "x.passage_start", "x.passage_end"), [items, seeds, chunks]


def drop_leaked(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, in its columns, that hold no copy of a test item; rows of one id go together."""
    found, used = _found(docs, benchmark, similarity)
    leaked = written(found.select("doc_id").distinct(), "leaked")
    discard(*used)
    d, k = docs.alias("d"), leaked.alias("k")
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id"))
    return d.join(F.broadcast(k) if leaked.count() <= LEAST_JOINED else k, same, "left_anti")
