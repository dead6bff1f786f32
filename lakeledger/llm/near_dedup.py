"""Near-duplicate documents by ProbMinHash.

A document is the weighted set of its five-word shingles (weight 1 + ln of the count).  Each
shingle starts a Poisson process at the rate of its weight; every arrival falls on one register,
and a register keeps the shingle that came first.  A shingle stops as soon as its next arrival is
later than all registers of its document.  Two registers agree with the probability Jaccard
similarity, so bands of registers become buckets.  A document that repeats shingles is sketched a second time
at equal rates, as others are anyway: those registers agree with the Jaccard similarity of distinct shingles, which
is the one verified, so repeats on one side cannot hide a pair.  In each bucket every document is first set
against its lead, the one that shares most places in buckets: pairs that agree on at least 0.8 of their distinct shingles are
links.  Where a lead's documents still hold several classes, two of them can only be a link if they
share one of their first shingles in an order that both use: those that the lead lacks first, then
by hash (as many first ones as a partner may lack at 0.8, and one).  So documents of different
classes meet under lead and shingle, as ids with a place and 512 parity bits of what sets each apart
from the lead: places and bits both bound what two documents can share, and pairs that cannot be
links never leave the join.  No pair of a bucket that could be a link is left out; near misses,
which all have changed shingles of their own first, hardly meet.

Results: documents of equal word sequences are copies and share a class whatever their length;
so are all documents without a word (null or empty text).  A text of one to four words is one
shingle.  A null id counts as the smallest and comes back as null, in either column.  Rows that
share an id are one document and give one row.  The class id is the smallest id of the class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STAGE_BYTES, discard, given_id, null_safe_id, pieces, with_first_id, written
from .graph import classes
from .words import SALT, U64, Words, mix, whole_hash, windows, words

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5  # a pair at 0.8 shares no bucket with probability (1 - 0.8 ** 5) ** 25 = 5e-5
BIT_WORDS = 8  # 64 parity bits each


def shingles(w: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and count of the distinct shingles of each text; a shorter text is one shingle."""
    h, text, _ = windows(w, n)
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    h = np.concatenate([h, whole_hash(w)[short]])
    text = np.concatenate([text, short])
    if not len(h):
        return h, text, np.zeros(0, np.int64)
    keys = mix(h ^ mix(text.astype(U64)))
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return h[order[starts]], text[order[starts]], np.diff(np.concatenate([starts, [len(keys)]]))


def prob_minhash(h: np.ndarray, text: np.ndarray, weight: np.ndarray, n_texts: int, registers: int) -> np.ndarray:
    """``n_texts`` rows of ``registers`` shingle hashes: for each register the earliest arrival."""
    earliest = np.full(n_texts * registers, np.inf)
    winner = np.zeros(n_texts * registers, U64)
    alone = np.bincount(text, minlength=n_texts) == 1
    single = alone[text]
    winner.reshape(n_texts, registers)[text[single]] = h[single][:, None]
    h, text, weight = h[~single], text[~single], weight[~single]
    time = np.zeros(len(h))
    state = mix(h + U64(0x632BE59BD9B4E019))
    while len(h):
        state = mix(state + U64(0x9E3779B97F4A7C15))
        time = time - np.log(((state >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        slot = text * registers + (mix(state ^ U64(0xD1B54A32D192ED03)) % U64(registers)).astype(np.int64)
        np.minimum.at(earliest, slot, time)
        won = earliest[slot] == time
        winner[slot[won]] = h[won]
        latest = earliest.reshape(n_texts, registers).max(axis=1)
        go = time < latest[text]
        h, text, weight, time, state = h[go], text[go], weight[go], time[go], state[go]
    return winner.reshape(n_texts, registers)


def sketch(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """Per text: hashes of its word sequence and one key for each band; none without words."""
    w = words(texts)
    n = len(texts)
    h, text, count = shingles(w)
    full = w.counts > 0
    repeats = np.zeros(n, bool)
    repeats[text[count > 1]] = True
    again = repeats[text]
    weighted = band_keys(h[again], text[again], 1.0 + np.log(count[again]), n)
    keys, of = [], []
    for rows, found in ((full, band_keys(h, text, np.ones(len(h)), n)), (repeats, weighted)):
        keys.append(found[rows].reshape(-1))
        of.append(np.repeat(np.flatnonzero(rows), BANDS))
    values, row = np.concatenate(keys), np.concatenate(of)
    order = np.lexsort((values, row))
    new = np.ones(len(order), bool)
    new[1:] = (values[order[1:]] != values[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
    order = order[new]
    bounds = np.searchsorted(row[order], np.arange(n + 1)).astype(np.int32)
    bands = pa.ListArray.from_arrays(pa.array(bounds), pa.array(values[order].view(np.int64)))
    return pa.RecordBatch.from_arrays([ids, pa.array(whole_hash(w).view(np.int64)), pa.array(whole_hash(w, 1).view(np.int64)), bands], names=["id", "c1", "c2", "bands"])


def band_keys(h: np.ndarray, text: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """One key for each text and band of its registers."""
    signature = prob_minhash(h, text, weight, n, BANDS * ROWS).reshape(n, BANDS, ROWS)
    keys = np.zeros((n, BANDS), U64) + mix(np.arange(BANDS, dtype=U64))
    for r in range(ROWS):
        keys = mix(keys ^ signature[:, :, r])
    return keys


@dataclass(frozen=True)
class Compared:
    """Row by row, two texts' sets of distinct shingles: similarity (0 where both are empty), and of the
    right one its size, its first shingles (those that the left one lacks before the others, each by
    hash) and the parity bits of all shingles that only one of the two has."""

    similarity: np.ndarray
    size: np.ndarray
    first: pa.ListArray
    bits: np.ndarray


def compare(left: pa.Array, right: pa.Array, similarity: float) -> Compared:
    (h1, t1, _), (h2, t2, _) = shingles(words(left)), shingles(words(right))
    n = len(left)
    of1, of2 = mix(h1 ^ mix(t1.astype(U64))), mix(h2 ^ mix(t2.astype(U64)))
    common, missing = np.isin(of2, of1), ~np.isin(of1, of2)
    size = np.bincount(t2, minlength=n)
    both = np.bincount(t2[common], minlength=n)
    either = np.bincount(t1, minlength=n) + size - both
    order = np.lexsort((h2, common, t2))
    first = np.concatenate([[0], np.cumsum(size)])
    n_first = np.where(size > 0, size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1, 0)
    kept = np.arange(len(order)) - first[t2[order]] < n_first[t2[order]]
    bounds = np.concatenate([[0], np.cumsum(n_first)]).astype(np.int32)
    bits = np.zeros((n, BIT_WORDS), U64)
    for text, h in ((t2[~common], h2[~common]), (t1[missing], mix(h1[missing] + SALT))):
        slot = h % U64(64 * BIT_WORDS)
        np.bitwise_xor.at(bits, (text, (slot >> U64(6)).astype(np.int64)), U64(1) << (slot & U64(63)))
    return Compared(both / np.maximum(either, 1), size, pa.ListArray.from_arrays(pa.array(bounds), pa.array(h2[order][kept].view(np.int64))), bits.view(np.int64))


BIT_NAMES = [f"bits{k}" for k in range(BIT_WORDS)]


def _compared(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) with whether their texts are close, and ``b`` as seen from ``a``."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("other")), "b")
    names = ["a", "b", "close", "n", "first", *BIT_NAMES]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=STAGE_BYTES):
            for part in pieces(iter([batch]), "other", STAGE_BYTES):
                seen = compare(part.column("text"), part.column("other"), similarity)
                columns = [pa.array(seen.similarity >= similarity), pa.array(seen.size), seen.first, *map(pa.array, np.ascontiguousarray(seen.bits.T))]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), *columns], names=names)

    schema = "a long, b long, close boolean, n long, first array<long>, " + ", ".join(f"{x} long" for x in BIT_NAMES)
    return both.select("a", "b", "text", "other").mapInArrow(check, schema)


def _further_pairs(compared: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """Pairs of documents of one lead and of different classes that may still be links."""
    named = compared.join(labels.select(F.col("node").alias("b"), "label"), "b", "left").withColumn("label", F.coalesce("label", "b"))
    mixed = named.groupBy("a").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("a")
    # with ``at`` shingles before it, the largest partner that the rest is enough for
    most = F.col("n") / similarity - F.col("at") * (1 + similarity) / similarity + 1e-6
    rows = named.join(mixed, "a").select("a", "b", "label", "n", F.posexplode("first").alias("at", "shingle"), *BIT_NAMES)
    rows = written(rows.select("a", "shingle", "b", "label", "n", most.alias("most"), *BIT_NAMES).filter(F.col("most") >= F.ceil(F.col("n") * similarity - 1e-6)), "first-shingles")
    shared = rows.groupBy("a", "shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("a", "shingle")
    meeting = written(rows.join(shared, ["a", "shingle"]), "meeting")
    x, y = meeting.alias("x"), meeting.alias("y")
    here = (F.col("x.a") == F.col("y.a")) & (F.col("x.shingle") == F.col("y.shingle"))
    once = F.struct("x.n", "x.b") < F.struct("y.n", "y.b")
    apart = sum((F.bit_count(F.col(f"x.{k}").bitwiseXOR(F.col(f"y.{k}"))) for k in BIT_NAMES), F.lit(0))
    alike = apart <= (F.col("x.n") + F.col("y.n")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    enough = (F.col("x.label") != F.col("y.label")) & once & (F.col("y.n") <= F.col("x.most")) & (F.col("x.n") <= F.col("y.most")) & alike
    met = x.join(y, here & enough).select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b")).distinct()
    pairs = written(met.join(compared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "pairs")
    discard(rows, meeting)
    return pairs


def _classes(docs: DataFrame, similarity: float) -> DataFrame:
    """(id, class_id) for every id of ``docs``, null ids as the smallest."""
    own = docs.select(null_safe_id().alias("id"), "text")

    def sketch_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=STAGE_BYTES):
            yield sketch(batch.column("id"), batch.column("text"))

    known = written(own.mapInArrow(sketch_all, "id long, c1 long, c2 long, bands array<long>"), "sketch")
    members = written(with_first_id(known.select("id", "c1", "c2"), ["c1", "c2"]).select("id", F.col("first_id").alias("rep")), "members")
    reps = known.join(members.filter("id = rep").select("id").distinct(), "id", "left_semi")

    banded = reps.select("id", F.explode("bands").alias("key"))
    sizes = banded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    shared = written(banded.join(sizes, "key"), "shared")
    # the lead of a bucket is the document that shares most places in buckets: near the middle of its group
    places = shared.groupBy("id").agg(F.sum("size").alias("places"))
    leads = shared.join(places, "id").groupBy("key").agg(F.min(F.struct((-F.col("places")).alias("minus"), "id")).alias("top"))
    buckets = written(shared.join(leads.select("key", F.col("top.id").alias("lead")), "key").select("id", "lead").distinct(), "buckets")
    discard(known, shared)
    tried = buckets.filter("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b"))
    if tried.isEmpty():
        return members.groupBy("id").agg(F.min("rep").alias("class_id"))

    # first every document against the lead of its buckets, which settles most groups; then documents
    # of one lead and of different classes, where they may still be links
    texts = written(own.join(buckets.select("id").distinct(), "id", "left_semi"), "texts")
    compared = written(_compared(tried, texts, similarity), "compared")
    links = compared.filter("close").select("a", "b")
    labels = classes(links)
    pairs = _further_pairs(compared, labels, similarity)
    found = written(_compared(pairs, texts, similarity).filter("close").select("a", "b"), "links")
    if not found.isEmpty():
        before, labels = labels, classes(links.union(found))
        discard(before)
    discard(buckets, texts, compared, pairs, found)
    named = members.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("id", F.coalesce("label", "rep").alias("class_id"))
    return named.groupBy("id").agg(F.min("class_id").alias("class_id"))


def group_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id, class_id) for every id of ``docs``."""
    return _classes(docs, similarity).select(given_id("id").alias("id"), given_id("class_id").alias("class_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, in its columns, whose id is the smallest of its class."""
    kept = _classes(docs, SIMILARITY).filter("id = class_id").select(given_id("id").alias("doc_id"))
    d, k = docs.alias("d"), kept.alias("k")
    return d.join(k, F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")), "left_semi")


#: The same rows in DuckDB: all pairs that share a shingle, and everything that links reach.
ORACLE = """
with recursive parsed as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
members as (select doc_id, min(doc_id) over (partition by array_to_string(ws, ' ')) as rep, ws from parsed),
reps as (select doc_id as id, ws from members where doc_id = rep and len(ws) > 0),
shingles as (
  select distinct id, case when len(ws) < 5 then '<' || array_to_string(ws, ' ') else array_to_string(ws[i:i + 4], ' ') end as s
  from (select id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from reps)),
sizes as (select id, count(*) as n from shingles group by id),
common as (select x.id as a, y.id as b, count(*) as c from shingles x join shingles y on x.s = y.s and x.id < y.id group by x.id, y.id),
links as (select a, b from common join sizes p on p.id = a join sizes q on q.id = b where c >= 0.8 * (p.n + q.n - c)),
edges as (select a, b from links union all select b, a from links),
reach(id, other) as (select a, a from edges union select r.id, e.b from reach r join edges e on e.a = r.other),
labels as (select id, min(other) as label from reach group by id)
select doc_id, min(coalesce(label, rep)) as class_id from members left join labels on id = rep group by doc_id
"""
