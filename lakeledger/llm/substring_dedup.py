"""Substring dedup by level-wise doubling: only what repeats at one length is looked at in the next.

Words are removed where a window of 20 words also starts earlier.  Each 20-word window stands under
its least 10-gram hash, and that 10-gram under its least 5-gram, so equal windows stand under the
same ones and only about one word in six is sent.  The lengths are taken in turn: 5-grams that
repeat, and they alone, are extended to their 10-grams; 10-grams that repeat to their 20-word
windows, which are compared by 128-bit hashes, first as runs under one seed, then singly where the
runs of a seed differ.  A window that repeats at 20 words is decided there (which starts earlier),
so no candidate is left for a longer length, and the levels end.  Texts equal as word sequences are
set apart first: all but the smallest id lose all words (from 20 words on), so no group of copies
enters a level.

Results: a null or empty text has no words and keeps none.  A null id counts as the smallest.
Rows that share an id count as one document: none of them takes words from another.  A text of
fewer than 20 words stays.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, null_safe_id, pieces, with_first_id, written
from .words import U64, Words, byte_view, mix, whole_hash, windows, words

WINDOW, SEED, FIRST = 20, 10, 5  # each twice the next
TOP = np.iinfo(np.uint64).max
KEPT_SCHEMA = "doc_id long, n_words long, n_removed long, kept string"


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    out, span = h, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < width:
        rest = width - span
        out = np.minimum(out[:-rest], out[rest:])
    return out


def seeded_windows(w: Words, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word of each window, and its least seed hash."""
    h, text, at = windows(w, window)
    if not len(at):
        return h, text, at, h
    s, _, s_at = windows(w, seed)
    full = np.full(len(w.hashes), TOP, U64)
    full[s_at] = s >> U64(1)
    return h, text, at, _least(full, window - seed + 1)[at]


def _lists(values: np.ndarray, text: np.ndarray, n: int) -> pa.ListArray:
    """``values``, sorted by ``text``, as one list for each text."""
    bounds = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values.view(np.int64)))


def _at_most_two(values: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Order of ``values`` by text and value in which none stands more than twice."""
    order = np.lexsort((values, text))
    v, t = values[order], text[order]
    third = np.zeros(len(v), bool)
    third[2:] = (v[2:] == v[:-2]) & (t[2:] == t[:-2])
    return order[~third]


def sketch(ids: pa.Array, texts: pa.Array, window: int = WINDOW, seed: int = SEED, first: int = FIRST) -> pa.RecordBatch:
    """Per text: number of words, hashes of the whole, its windows' seeds, each with the short seed below
    it, and the short seeds alone.

    A seed or short seed that stands at two places of the text or more is listed twice.
    """
    w = words(texts)
    n = len(texts)
    _, text, at, least = seeded_windows(w, window, seed)
    lists = [_lists(np.zeros(0, U64), np.zeros(0, np.int64), n)] * 3
    if len(at):
        s, s_text, s_at = windows(w, seed)
        low = np.zeros(len(w.hashes) + window, U64)  # the least seed of each window, at the window's last seed
        low[at + window] = least
        greatest = TOP - _least(TOP - low, window - seed + 1)  # over the windows that hold the seed
        chosen = greatest[s_at + seed] == s >> U64(1)
        s, s_text, s_at = s[chosen] >> U64(1), s_text[chosen], s_at[chosen]
        short = np.full(len(w.hashes), TOP, U64)
        h, _, h_at = windows(w, first)
        short[h_at] = h >> U64(1)
        below = short[s_at]
        place = s_at.copy()
        for j in range(1, seed - first + 1):
            less = short[s_at + j] < below
            below, place = np.where(less, short[s_at + j], below), np.where(less, s_at + j, place)
        keep = _at_most_two(s, s_text)
        _, once = np.unique(place, return_index=True)
        alone, owner = below[once], s_text[once]
        two = _at_most_two(alone, owner)
        lists = [_lists(s[keep], s_text[keep], n), _lists(below[keep], s_text[keep], n), _lists(alone[two], owner[two], n)]
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(w.counts), pa.array(whole_hash(w).view(np.int64)), pa.array(whole_hash(w, 1).view(np.int64)), *lists],
        names=["id", "n_words", "c1", "c2", "seeds", "below", "short"],
    )


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and the row of each; null lists are empty."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    rows = np.repeat(np.arange(len(lists)), np.nan_to_num(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False), nan=0).astype(np.int64))
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), rows


def _among(values: np.ndarray, rows: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each value is in the list of its row."""
    known, of = _flat(lists)
    return np.isin(mix(values ^ mix(rows.astype(U64))), mix(known ^ mix(of.astype(U64))))


def candidates(w: Words, lists: pa.Array, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows whose seed is in the list of their text: hash, text, first word and seed."""
    h, text, at, least = seeded_windows(w, window, seed)
    keep = _among(least, text, lists)
    return h[keep], text[keep], at[keep], least[keep]


def _first_in_text(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether no earlier window of the same text has the same hash."""
    out = np.zeros(len(h), bool)
    if len(h):
        order = np.lexsort((np.arange(len(h)), h, text))
        new = np.concatenate([[True], (h[order[1:]] != h[order[:-1]]) | (text[order[1:]] != text[order[:-1]])])
        out[order[new]] = True
    return out


def strip(batch: pa.RecordBatch, window: int, seed: int) -> pa.RecordBatch:
    """Texts without the words of windows that start earlier; see ``remove_repeats`` for the columns."""
    w = words(unpacked(batch))
    n = batch.num_rows
    gone = np.zeros(len(w.hashes) + 1, np.int64)
    h, text, at, least = candidates(w, batch.column("seeds"), window, seed)
    mine = _among(least, text, batch.column("own")) | _among(h, text, batch.column("firsts"))
    later = ~(_first_in_text(h, text) & mine)
    gone[at[later]] += 1
    np.subtract.at(gone, at[later] + window, 1)
    gone = np.cumsum(gone[:-1]) > 0
    copied = _among(whole_hash(w), np.arange(n), batch.column("copies")) & (w.counts >= window)
    gone |= copied[w.text_of()]
    raw = w.data.tobytes()
    kept = []
    for i in range(n):
        a, b = int(w.first[i]), int(w.first[i + 1])
        stay = np.flatnonzero(~gone[a:b]) + a
        kept.append(b" ".join([raw[s:e] for s, e in zip(w.starts[stay].tolist(), w.ends[stay].tolist(), strict=True)]).decode("utf-8", "replace"))
    removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first])
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(w.counts), pa.array(removed), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def units(batch: pa.RecordBatch, window: int, seed: int) -> pa.RecordBatch:
    """Runs of consecutive windows under one seed: the seed, the hash of all words they span, the id."""
    w = words(unpacked(batch))
    h, text, at, least = candidates(w, batch.column("seeds"), window, seed)
    if not len(at):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, names=["seed", "u1", "u2", "id"])
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    a = at[first]
    b = at[np.concatenate([first[1:], [len(at)]]) - 1] + window
    ids = batch.column("id").to_numpy(zero_copy_only=False)[text[first]]
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (least[first], w.runs.of(a, b - a), w.other_runs.of(a, b - a), ids)], names=["seed", "u1", "u2", "id"])


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """The values of ``key`` that stand twice or more."""
    return rows.groupBy(key).count().filter("count > 1").select(key)


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, first: int = FIRST) -> DataFrame:
    """Per document: words, words removed and the kept words joined by one space."""
    own = docs.select("doc_id", null_safe_id().alias("id"), "text")

    def sketch_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield sketch(batch.column("id"), batch.column("text"), window, seed, first)

    schema = "id long, n_words long, c1 long, c2 long, seeds array<long>, below array<long>, short array<long>"
    table = written(own.select("id", "text").mapInArrow(sketch_all, schema), "sketch")
    known = table.filter(F.col("n_words") >= window)

    # copies: all but the smallest id of each word sequence
    copies = with_first_id(known.select("id", "c1", "c2"), ["c1", "c2"]).filter("id > first_id").groupBy("id").agg(F.collect_set("c1").alias("copies"))

    # first length: what stands twice, in one text or in two (a text repeats what it has twice); then,
    # for that alone, the double length
    short = _repeated(known.select(F.explode("short").alias("below")), "below")
    alive = written(known.select("id", F.inline(F.arrays_zip("seeds", "below"))).join(short, "below").select("id", "seeds"), "seeds")
    alive_twice = alive.distinct().join(_repeated(alive, "seeds"), "seeds")
    plan = written(alive_twice.groupBy("id").agg(F.collect_list("seeds").alias("seeds")).join(copies, "id", "full"), "plan")
    discard(table, alive)

    # double again: runs of windows under one seed.  Where all runs of a seed span the same words,
    # the smallest id has them first; other seeds are open, and their windows are compared one by one
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield packed(batch)

    def units_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpackable(batches):
            yield units(batch, window, seed)

    def windows_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpackable(batches):
            w = words(unpacked(batch))
            h, text, at, _ = candidates(w, batch.column("open"), window, seed)
            new = _first_in_text(h, text)
            ids = batch.column("id").to_numpy(zero_copy_only=False)[text[new]]
            second = w.other_runs.every(window)[at[new]]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(h[new].view(np.int64)), pa.array(second.view(np.int64))], names=["id", "h1", "h2"])

    def strip_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpackable(batches):
            yield strip(batch, window, seed)

    text = own.mapInArrow(pack, "doc_id long, id long, n_bytes long, packed binary").join(plan, "id", "left")
    runs = text.filter("seeds is not null and copies is null").select("id", "n_bytes", "packed", "seeds").mapInArrow(units_all, "seed long, u1 long, u2 long, id long")
    spans = runs.groupBy("seed").agg(*(f(c).alias(f"{n}_{c}") for c in ("u1", "u2") for n, f in (("lo", F.min), ("hi", F.max))), F.min("id").alias("id"))
    same = (F.col("lo_u1") == F.col("hi_u1")) & (F.col("lo_u2") == F.col("hi_u2"))
    settled = spans.filter(same).groupBy("id").agg(F.collect_list("seed").alias("own"))
    open_ = runs.select("seed", "id").join(spans.filter(~same).select("seed"), "seed").groupBy("id").agg(F.collect_set("seed").alias("open"))
    found = text.join(open_, "id").select("id", "n_bytes", "packed", "open").mapInArrow(windows_all, "id long, h1 long, h2 long")
    firsts = found.groupBy("h1", "h2").agg(F.min("id").alias("id")).groupBy("id").agg(F.collect_list("h1").alias("firsts"))
    rows = text.join(settled, "id", "left").join(firsts, "id", "left")
    return rows.select("doc_id", "n_bytes", "packed", "seeds", "copies", "own", "firsts").mapInArrow(strip_all, KEPT_SCHEMA)


def packed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Compressed texts, which are what joins by id move about."""
    data, offsets = byte_view(batch.column("text"))
    raw, press = data.tobytes(), zstandard.ZstdCompressor(3)
    blobs = [press.compress(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("id"), pa.array(np.diff(offsets)), pa.array(blobs, pa.binary())], names=["doc_id", "id", "n_bytes", "packed"])


def unpacked(batch: pa.RecordBatch) -> pa.Array:
    press = zstandard.ZstdDecompressor()
    return pa.array([press.decompress(x) for x in batch.column("packed").to_pylist()], pa.large_binary())


def unpackable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the unpacked texts of each are of bounded size."""
    for batch in batches:
        yield from cut(batch, batch.column("n_bytes").to_numpy(zero_copy_only=False))


#: The same rows in DuckDB: every window by its words.
ORACLE = """
with tokens as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i, len(ws) as n from (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents)),
windows as (select doc_id, i, hash(string_agg(w, ' ') over f) as h1, hash('1 ' || string_agg(w, ' ') over f) as h2, n from tokens window f as (partition by doc_id order by i rows between current row and 19 following)),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by h1, h2 order by doc_id, i) as turn from windows where i + 19 <= n) where turn > 1),
covered as (select doc_id, i, w, max(l) over (partition by doc_id order by i rows between 19 preceding and current row) is not null as gone from (select t.doc_id, t.i, t.w, l.i as l from tokens t left join later l on t.doc_id = l.doc_id and t.i = l.i))
select d.doc_id, count(c.i) as n_words, count(c.i) filter (where gone) as n_removed, sha256(coalesce(string_agg(w, ' ' order by i) filter (where not gone), '')) as kept_sha256
from documents d left join covered c on c.doc_id = d.doc_id group by d.doc_id
"""
