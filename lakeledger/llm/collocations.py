"""Phrases whose words stand together more often than their parts do, mined with count tries.

Every shard of texts (a few MB) becomes one count trie of limited depth: language, then up to three
words, each level an array of nodes in path order with its parents, words and counts.  A trie is
serialised in that order and cut at the bounds of prefix ranges; all parts of a range meet in one
task, which merges their sorted runs, adds up equal paths and keeps what is frequent.  Bounds are
whole paths, so a word that begins a third of all phrases spans many ranges; every part carries the
counts of the nodes above its lower bound, so the walk from a node to its ancestors (the left parts
of its cuts) never leaves its range.  Right parts are suffix links, one salted join over the frequent
nodes.  Words are compared as bytes throughout, never by hash.

Results: a null text holds no words, a null language counts as ``und``, and so joins documents that
say ``und``; a text is read whole.  Rows count as often as they occur, whatever their ids; only
``text`` and ``lang`` are read.  No frequent phrase, no row.  Equal scores go by count, then by the
phrase's bytes.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, pieces, small_batches, written
from .words import byte_view

LONGEST, LEAST, KEPT, SUBSUMED_PERCENT, SCALE = 3, 10, 2000, 50, 1_000_000
#: Bytes of text in one shard's trie, and bytes of text for each prefix range.
SHARD_BYTES, RANGE_BYTES = 3 << 20, 4 << 20
#: Bounds of ranges come from about so many texts and so many paths of each; they decide balance, not results.
SAMPLED_TEXTS, SAMPLED_PATHS, BOUND_BYTES = 2000, 32, 64
SALTS = 32
#: A shard's trie leaves the worker in so many turns.
SENDINGS = 8
#: Characters that end a piece.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"

NODES = "lang string, phrase string, n_words int, n long, lefts array<long>"


def joined_key(parent: np.ndarray, word: np.ndarray) -> np.ndarray:
    key = parent.astype(np.int64)
    key <<= 32
    key |= word
    return key


@dataclass
class Level:
    """Nodes of one depth in path order: index of the parent, code of the word (at the top: of the language), count.

    Indices and codes have 32 bits: a shard or range is far below 2^31 nodes, since tasks hold it; counts have 64.
    """

    parent: np.ndarray
    word: np.ndarray
    count: np.ndarray

    @property
    def key(self) -> np.ndarray:
        return joined_key(self.parent, self.word)


@dataclass
class Trie:
    """Levels below a vocabulary of sorted, distinct byte strings; level 0 holds the languages."""

    vocabulary: pa.Array
    levels: list[Level]


def sorted_codes(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct ``values`` in byte order, and the place of each value among them."""
    coded = values.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()]


def grouped(parent: np.ndarray, word: np.ndarray, count: np.ndarray | None) -> tuple[Level, np.ndarray]:
    """The level of these occurrences (or partial nodes), and the node of each.  Sorting merges the runs that are there."""
    key = joined_key(parent, word)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    node = np.empty(len(key), np.int32)
    node[order] = np.cumsum(new, dtype=np.int32)
    node -= 1
    sums = np.diff(np.append(first, len(key))) if count is None else (np.add.reduceat(count[order], first) if len(first) else count[:0])
    key = key[first]
    return Level((key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32), sums), node


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all texts in order, lower-cased; for each its text, and a number that only words of one piece share."""
    data, offsets = byte_view(texts)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8, copy=False)
    ends_piece = np.isin(data, np.frombuffer(PIECE_ENDS, np.uint8))
    inside = ~(ends_piece | (data == 32) | (data == 9))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    stops = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    text = np.searchsorted(offsets, starts, "right").astype(np.int32)
    text -= 1
    piece = np.searchsorted(np.flatnonzero(ends_piece), starts).astype(np.int32)
    piece += text
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(stops - starts, out=bounds[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])]), text, piece


def build(langs: pa.Array, texts: pa.Array, longest: int) -> Trie:
    """The count trie of a shard."""
    words, text, piece = split(texts)
    n_words = len(words)
    lang = pc.fill_null(langs.cast(pa.string()), "und").cast(pa.large_binary())
    words = pa.concat_arrays([words, lang])
    vocabulary, code = sorted_codes(words)
    del words
    word, lang_code = code[:n_words], code[n_words:]
    level, node = grouped(np.zeros(n_words, np.int32), lang_code[text], None)
    del text
    levels, at = [level], np.arange(n_words, dtype=np.int32)
    for depth in range(longest):
        fits = at < n_words - depth
        at, node = at[fits], node[fits]
        fits = piece[at] == piece[at + depth]
        at, node = at[fits], node[fits]
        level, node = grouped(node, word[at + depth], None)
        levels.append(level)
    return Trie(vocabulary, levels)


def cut_points(trie: Trie, bounds: list[tuple[bytes, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """For each level and bound: nodes before the bound, and whether the last of these is above it (a prefix of it)."""
    codes, word_of = range(len(trie.vocabulary)), lambda code: trie.vocabulary[code].as_py()
    before = np.zeros((len(trie.levels), len(bounds)), np.int64)
    above = np.zeros((len(trie.levels), len(bounds)), bool)
    keys = [level.key for level in trie.levels]
    for b, bound in enumerate(bounds):
        parent, exact = 0, True
        for d, part in enumerate(bound):
            if exact:
                code = bisect.bisect_left(codes, part, key=word_of)
                found = code < len(codes) and word_of(code) == part
                at = int(np.searchsorted(keys[d], (parent << 32) | code))
                exact = found and at < len(keys[d]) and int(keys[d][at]) == (parent << 32) | code
            else:
                at = int(np.searchsorted(keys[d], parent << 32))
            deeper = exact and d + 1 < len(bound)
            before[d, b], above[d, b] = at + deeper, deeper
            parent = at
    return before, above


def packed(values: np.ndarray) -> bytes:
    """An array in the smallest type that holds it, behind its type and length."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return kind.char.encode() + len(values).to_bytes(7, "little") + values.astype(kind).tobytes()


def unpacked(view: memoryview, at: int) -> tuple[np.ndarray, int]:
    kind, n = np.dtype(chr(view[at])), int.from_bytes(view[at + 1 : at + 8], "little")
    to = at + 8 + n * kind.itemsize
    return np.frombuffer(view[at + 8 : to], kind), to


def serialised(trie: Trie, first: np.ndarray, last: np.ndarray) -> bytes:
    """Nodes ``first[d]:last[d]`` of every level in path order, with the words that they use."""
    parts = [(level.parent[a:b], level.word[a:b], level.count[a:b]) for level, a, b in zip(trie.levels, first, last, strict=True)]
    used = np.unique(np.concatenate([word for _, word, _ in parts]))
    words = trie.vocabulary.take(pa.array(used))
    data, offsets = byte_view(words)
    out = [packed(np.diff(offsets)), packed(data)]
    for d, (parent, word, count) in enumerate(parts):
        if d:  # parents as numbers of children
            out.append(packed(np.bincount(parent - first[d - 1], minlength=last[d - 1] - first[d - 1])))
        out += [packed(np.searchsorted(used, word)), packed(count)]
    return b"".join(out)


def deserialised(blob: memoryview, depth: int) -> Trie:
    sizes, at = unpacked(blob, 0)
    data, at = unpacked(blob, at)
    bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    vocabulary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data).astype(np.uint8))])
    levels: list[Level] = []
    for d in range(depth):
        children = None
        if d:
            children, at = unpacked(blob, at)
        word, at = unpacked(blob, at)
        count, at = unpacked(blob, at)
        parent = np.zeros(len(word), np.int32) if children is None else np.repeat(np.arange(len(children), dtype=np.int32), children)
        levels.append(Level(parent, word.astype(np.int32), count.astype(np.int64)))
    return Trie(vocabulary, levels)


def merged(tries: list[Trie]) -> Trie:
    """One trie with the counts of all: words are coded anew, then each level's sorted runs merge under merged parents."""
    vocabulary, code = sorted_codes(pa.concat_arrays([t.vocabulary for t in tries]))
    at = np.cumsum([0, *(len(t.vocabulary) for t in tries)])
    levels, node = [], None
    for d in range(len(tries[0].levels)):
        runs = [t.levels[d] for t in tries]
        word = np.concatenate([code[at[k] + r.word] for k, r in enumerate(runs)])
        if node is None:
            parent = np.zeros(len(word), np.int32)
        else:
            above = np.cumsum([0, *(len(t.levels[d - 1].word) for t in tries)])
            parent = node[np.concatenate([above[k] + r.parent for k, r in enumerate(runs)])]
        level, node = grouped(parent, word, np.concatenate([r.count for r in runs]))
        levels.append(level)
    return Trie(vocabulary, levels)


def frequent(trie: Trie, before: np.ndarray, least: int) -> pa.RecordBatch:
    """The range's own nodes (those not ``before`` its bound) with at least ``least`` counts, each with the counts of its ancestors.

    Words of every language are counted through one more row, with no phrase and the sum of its own words.
    """
    names, lefts, langs, where = [], [], [], np.zeros(0, np.int64)
    columns: list[list] = [[] for _ in range(5)]
    for d, level in enumerate(trie.levels):
        if not d:
            names, lefts, langs = [None] * len(level.word), [[]] * len(level.word), [trie.vocabulary[int(w)].as_py().decode() for w in level.word]
            continue
        own = np.arange(len(level.word)) >= before[d]
        if d == 1:
            totals = np.bincount(level.parent[own], weights=level.count[own], minlength=len(langs)).astype(np.int64)
            for lang, n in zip(langs, totals.tolist(), strict=True):
                for column, value in zip(columns, (lang, None, 0, n, []), strict=True):
                    column.append(value)
        keep = np.flatnonzero(level.count >= least)
        place = np.full(len(level.word), -1)
        place[keep] = np.arange(len(keep))
        words = trie.vocabulary.take(pa.array(level.word[keep])).to_pylist()
        parent = level.parent[keep] if d == 1 else where[level.parent[keep]]  # an ancestor of a frequent node is frequent
        counts = level.count[keep].tolist()
        names_, lefts_, langs_ = [], [], []
        for p, word, n, mine in zip(parent.tolist(), words, counts, own[keep].tolist(), strict=True):
            name = word.decode() if names[p] is None else f"{names[p]} {word.decode()}"
            if mine:
                for column, value in zip(columns, (langs[p], name, d, n, lefts[p]), strict=True):
                    column.append(value)
            names_.append(name)
            lefts_.append([*lefts[p], n])
            langs_.append(langs[p])
        names, lefts, langs, where = names_, lefts_, langs_, place
    types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["lang", "phrase", "n_words", "n", "lefts"])


def shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches joined and cut to about ``size`` bytes of text."""
    held, n = [], 0
    for batch in pieces(batches, limit=size):
        held.append(batch)
        n += batch.column("text").nbytes
        if n >= size:
            table, held, n = pa.Table.from_batches(held).combine_chunks(), [], 0
            yield table.to_batches()[0]
    if n or held:
        table = pa.Table.from_batches(held).combine_chunks()
        if table.num_rows:
            yield table.to_batches()[0]


def range_bounds(docs: DataFrame, longest: int, n_bytes: int, n_rows: int) -> list[tuple[bytes, ...]]:
    """Lower bounds of all prefix ranges but the first: paths evenly spaced among those of a bounded sample of texts."""
    n_ranges = max(1, math.ceil(n_bytes / RANGE_BYTES))
    if n_ranges == 1:
        return []

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for k in range(batch.num_rows):
                trie = build(batch.column("lang").slice(k, 1), batch.column("text").slice(k, 1), longest)
                nodes = trie.levels[-1]
                some = np.unique(np.linspace(0, len(nodes.word) - 1, SAMPLED_PATHS).astype(np.int64)) if len(nodes.word) else np.zeros(0, np.int64)
                columns, at = [], some
                for level in reversed(trie.levels):
                    columns.append(pa.array([w[:BOUND_BYTES] for w in trie.vocabulary.take(pa.array(level.word[at])).to_pylist()], pa.binary()))
                    at = level.parent[at]
                yield pa.RecordBatch.from_arrays(columns[::-1], names=[f"w{d}" for d in range(longest + 1)])

    share = min(1.0, SAMPLED_TEXTS / max(1, n_rows))
    rows = docs.select("lang", "text").sample(share, seed=11).mapInArrow(paths, ", ".join(f"w{d} binary" for d in range(longest + 1))).collect()
    found = sorted(tuple(map(bytes, r)) for r in rows)
    return sorted({found[k * len(found) // n_ranges] for k in range(1, n_ranges)}) if found else []


def count_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """Words and phrases of up to ``longest`` words with at least ``least`` occurrences in a language, with the counts of
    their beginnings (``lefts``); rows without a phrase add up to all words of the language."""
    texts = docs.select("lang", "text")
    size = texts.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    bounds = range_bounds(texts, longest, size["bytes"] or 0, size["rows"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, SHARD_BYTES):
            trie = build(shard.column("lang"), shard.column("text"), longest)
            if not len(trie.levels[0].word):
                continue
            before, above = cut_points(trie, bounds)
            start = np.concatenate([np.zeros((longest + 1, 1), np.int64), before - above], axis=1)
            end = np.concatenate([before, [[len(level.word)] for level in trie.levels]], axis=1)
            full = np.flatnonzero((end[1:] > start[1:]).any(axis=0))
            for some in np.array_split(full, min(len(full), SENDINGS)):
                blobs = [serialised(trie, start[:, j], end[:, j]) for j in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "nodes"])

    def merge(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, held, n = None, [], 0
        for batch in parts:
            for blob in batch.column("nodes"):
                view = memoryview(blob.as_buffer())
                held.append(deserialised(view, longest + 1))
                n += len(view)
                if n >= RANGE_BYTES:
                    whole, held, n = merged([whole, *held] if whole else held), [], 0
        if held:
            whole = merged([whole, *held] if whole else held)
        j = key[0].as_py()
        before = cut_points(whole, [bounds[j - 1]])[0][:, 0] if j else np.zeros(longest + 1, np.int64)
        yield frequent(whole, before, least)

    return texts.mapInArrow(cut, "part int, nodes binary").groupBy("part").applyInArrow(merge, NODES)


def _suffix(k: Column) -> Column:
    """What is left of a phrase after its first ``k`` words."""
    words = F.split("phrase", " ")
    return F.array_join(F.slice(words, k + 1, F.size(words) - k), " ")


def mine_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, kept: int = KEPT, subsumed_percent: int = SUBSUMED_PERCENT) -> DataFrame:
    """Each language's best ``kept`` phrases: rank, phrase, its count, those of its parts at the weakest cut, all words, score."""
    with small_batches(docs.sparkSession):  # while texts and parts of tries go to Python
        nodes = written(count_phrases(docs, longest, least), "phrases")
    totals = nodes.filter("phrase is null").groupBy("lang").agg(F.sum("n").alias("n"))
    counts = nodes.filter("phrase is not null")
    phrases = counts.filter("n_words > 1")

    cuts = phrases.select("lang", "phrase", F.col("n").alias("a"), F.posexplode("lefts").alias("k", "l"))
    cuts = cuts.withColumn("k", F.col("k") + 1).withColumn("right", _suffix(F.col("k"))).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    # a suffix that very many phrases share is met in as many places as there are salts
    rights = counts.filter(F.col("n_words") < longest).select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # 10^6 * a * a stays below 10^38 up to a = 10^16
    score = F.expr(f"cast(({SCALE} * cast(a as decimal(38,0)) * cast(a as decimal(38,0))) div (cast(l as decimal(38,0)) * cast(r as decimal(38,0))) as long)")
    scored = cuts.join(rights.withColumn("salt", F.col("salt").cast("long")), ["lang", "right", "salt"]).withColumn("score", score)
    best = scored.groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # every shorter run of two words or more inside a phrase, with the count of the most frequent phrase that holds it
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("n_words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("n_words") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    around = phrases.filter("n_words > 2").select("lang", F.explode(inner).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    alone = best.join(around, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < subsumed_percent * F.col("a"), F.lit(True)))

    rows = alone.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= kept)
    top = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= kept)
    out = top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    done = written(out, "collocations")  # a row for each language and rank
    discard(nodes)
    return done


#: The same rows in DuckDB.
ORACLE = f"""
with texts as (select row_number() over () as d, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
pieces as (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) as piece from texts),
worded as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as ws from pieces),
grams as (
  select lang, m as n_words, unnest(list_transform(generate_series(1, len(ws) - m + 1), lambda i: array_to_string(ws[i : i + m - 1], ' '))) as phrase
  from worded, (select unnest([1, 2, 3]) as m) where len(ws) >= m),
counted as materialized (select lang, n_words, phrase, count(*) as f from grams group by all),
totals as (select lang, sum(f)::bigint as n from counted where n_words = 1 group by lang),
candidates as materialized (select lang, n_words, phrase, string_split(phrase, ' ') as ws, f as a from counted where n_words > 1 and f >= {LEAST}),
parts as (select lang, phrase, a, k, array_to_string(ws[1 : k], ' ') as first_words, array_to_string(ws[k + 1 : ], ' ') as rest from (select *, unnest(generate_series(1, n_words - 1)) as k from candidates)),
cuts as (
  select p.lang, p.phrase, a, k, x.f as l, y.f as r, (({SCALE}::hugeint * a * a) // (x.f::hugeint * y.f))::bigint as score
  from parts p join counted x on x.lang = p.lang and x.phrase = first_words join counted y on y.lang = p.lang and y.phrase = rest),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
around as (
  select lang, phrase, max(a) as longer from (
    select lang, array_to_string(ws[1 : 2], ' ') as phrase, a from candidates where n_words = 3
    union all select lang, array_to_string(ws[2 : 3], ' '), a from candidates where n_words = 3) group by all)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase)::bigint as rank, phrase, a, l, r, n, score
from best left join around using (lang, phrase) join totals using (lang)
where coalesce(100 * longer < {SUBSUMED_PERCENT} * a, true)
qualify rank <= {KEPT}
"""
