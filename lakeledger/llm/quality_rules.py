"""Quality rules: how much of a text lies inside n-grams and lines that it repeats.

Words become codes of a batch's distinct words.  A polynomial of the codes modulo a prime is rolled over
the batch as one running sum, from which the hash of any window is a difference; equal ones within a
text are found by one sort for each n-gram length, and compared word by word before they count.  The
characters of the words that they cover are set against all characters of words.  Lines are measured
alike, by codes of distinct lines.  A text is rejected if it fails the base rules or if any share is above
its limit.

Results: a null or empty text has no words and fails the base rules; each row is judged on its
own, so repeated rows get equal results; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STAGE_BYTES, pieces
from .words import U64, byte_view, coded, spans

LEAST_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 20, 8, 30
#: Largest share of word characters inside repeated n-grams (first occurrence included), by n.
NGRAM_LIMITS = {4: 0.40, 6: 0.30, 10: 0.20}
#: Largest share of a text's line characters that lie in lines equal to an earlier line.
LINE_LIMIT = 0.30
SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_share double, "
    + ", ".join(f"dup_{n}gram_share double" for n in NGRAM_LIMITS)
)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which of ``keys`` occur twice or more."""
    out = np.zeros(len(keys), bool)
    if len(keys):
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out


#: The rolling hash is a polynomial modulo this prime.
BITS = 61
PRIME, BASE = (1 << BITS) - 1, 0x1B0A_5C3D_9E87_F241


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, from halves of 30 and 31 bits; 2^61 counts as 1."""
    low, half = U64(2**31 - 1), U64(31)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    middle = a1 * b0 + a0 * b1
    return reduced((a1 * b1 << U64(1)) + (middle >> U64(30)) + ((middle & U64(2**30 - 1)) << half) + a0 * b0)


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x & U64(PRIME)) + (x >> U64(BITS))
    return np.where(x >= U64(PRIME), x - U64(PRIME), x)


def powers(base: int, n: int) -> np.ndarray:
    """base^0, base^1, ... by doubling."""
    out = np.ones(1, U64)
    while len(out) < n:
        out = np.concatenate([out, times(out, np.full(1, pow(base, len(out), PRIME), U64))])
    return out[:n]


class Rolling:
    """Hashes of all windows of a sequence of codes, from one running sum of code times power."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        base = BASE % PRIME
        terms = times(codes.astype(U64) + U64(1), powers(base, len(codes)))
        high, low = np.cumsum(terms >> U64(30), dtype=U64), np.cumsum(terms & U64(2**30 - 1), dtype=U64)
        self.sums = np.concatenate([np.zeros(1, U64), reduced(times(reduced(high), np.full(1, 1 << 30, U64)) + reduced(low))])
        self.back = powers(pow(base, PRIME - 2, PRIME), len(codes))

    def windows(self, at: np.ndarray, n: int) -> np.ndarray:
        """The hash of ``n`` codes from each of ``at`` on."""
        return times(reduced(self.sums[at + n] + U64(PRIME) - self.sums[at]), self.back[at])

    def exact(self, at: np.ndarray, n: int) -> np.ndarray:
        """Numbers for the windows, equal for equal ones only: a code more at a time."""
        out = self.codes[at].astype(np.int64)
        for j in range(1, n):
            out = np.unique(out * (int(self.codes.max()) + 1) + self.codes[at + j], return_inverse=True)[1]
        return out


def covered(rolling: Rolling, text: np.ndarray, n: int) -> np.ndarray:
    """Words inside a window of ``n`` words that its text holds twice or more."""
    count = max(0, len(text) - n + 1)
    at = np.flatnonzero(text[:count] == text[n - 1 : n - 1 + count]) if count else np.zeros(0, np.int64)
    edge = np.zeros(len(text) + 1, np.int64)
    if len(at):
        key = rolling.windows(at, n)
        order = np.lexsort((key, text[at]))
        a, b = at[order[:-1]], at[order[1:]]
        pair = np.flatnonzero((key[order[1:]] == key[order[:-1]]) & (text[a] == text[b]))
        same = np.ones(len(pair), bool)
        for j in range(n):
            same &= rolling.codes[a[pair] + j] == rolling.codes[b[pair] + j]
        if not same.all():  # two windows of one hash: tell them apart by their words
            key = rolling.exact(at, n)
            order = np.lexsort((key, text[at]))
            a, b = at[order[:-1]], at[order[1:]]
            pair = np.flatnonzero((key[order[1:]] == key[order[:-1]]) & (text[a] == text[b]))
        at = np.union1d(a[pair], b[pair])
        edge[at] += 1
        edge[at + n] -= 1  # windows start at different words, so no index occurs twice
    return np.cumsum(edge[:-1]) > 0


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``bounds``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(total[bounds])


def line_repeats(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word that equal an earlier line, and the characters of those lines."""
    n = len(offsets) - 1
    ends = np.sort(np.concatenate([np.flatnonzero(data == 10), offsets[1:]]), kind="stable")
    starts = np.concatenate([[0], ends[:-1]])
    starts = starts + ((starts < len(data)) & (data[np.minimum(starts, max(0, len(data) - 1))] == 10) if len(data) else 0)
    starts = np.minimum(starts, ends)
    solid = np.concatenate([[0], np.cumsum(~blank)])
    keep = solid[ends] > solid[starts]
    starts, ends = starts[keep], ends[keep]
    text = np.searchsorted(offsets, starts, "right") - 1
    _, line = coded(data, starts, ends)
    order = np.lexsort((starts, line, text))
    later = order[1:][(line[order[1:]] == line[order[:-1]]) & (text[order[1:]] == text[order[:-1]])]
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.bincount(text[later], minlength=n), np.bincount(text[later], weights=(chars[ends] - chars[starts])[later], minlength=n)


def measure(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    data, offsets = byte_view(texts)
    starts, ends, first = spans(data, offsets)
    _, codes = coded(data, starts, ends)
    rolling, text = Rolling(codes), np.repeat(np.arange(len(first) - 1), np.diff(first))
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    point = (data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(point & ~blank)])
    of_word = chars[ends] - chars[starts]
    word_chars = np.diff(chars[offsets])
    n_words = np.diff(first)
    n_dup_lines, dup_chars = line_repeats(data, offsets, blank)
    n_repeat = per_text(covered(rolling, text, REPEAT_WINDOW), first)
    failed = (n_words < LEAST_WORDS) | (100 * n_repeat > REPEAT_PERCENT * n_words)
    shares = [per_text(of_word * covered(rolling, text, n), first) / np.maximum(word_chars, 1) for n in NGRAM_LIMITS]
    lines = dup_chars / np.maximum(per_text(point, offsets), 1)
    bad = failed | (lines > LINE_LIMIT)
    for share, limit in zip(shares, NGRAM_LIMITS.values(), strict=True):
        bad |= share > limit
    symbols = per_text(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)), offsets)
    columns = [word_chars, symbols, n_dup_lines, n_repeat, failed, ~bad, lines, *shares]
    return pa.RecordBatch.from_arrays([ids, pa.array(n_words), *map(pa.array, columns)], names=[f.split()[0] for f in SCHEMA.split(", ")])


def measure_quality(docs: DataFrame) -> DataFrame:
    """Per document: the base counts, both verdicts and every measured share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=STAGE_BYTES // 2):
            yield measure(batch.column("doc_id"), batch.column("text"))

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, in its columns, whose text the rules keep.  No shuffle: rows are filtered where they are read."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=STAGE_BYTES // 2):
            verdict = measure(pa.nulls(batch.num_rows, pa.int64()), batch.column("text"))
            yield batch.filter(verdict.column("kept"))

    return docs.mapInArrow(run, docs.schema).select(*(F.col(f"`{n}`") for n in names))


def _ngram_sql(n: int) -> str:
    """Words (doc_id, i) that a window of ``n`` words covers which its text holds twice or more."""
    return f"""select doc_id, i, coalesce(max(m) over (partition by doc_id order by i rows between {n - 1} preceding and current row), 1) > 1 as inside from (
  select doc_id, i, case when i + {n - 1} <= n then count(*) over (partition by doc_id, g, i + {n - 1} <= n) end as m from (
    select doc_id, i, n, string_agg(w, ' ') over (partition by doc_id order by i rows between current row and {n - 1} following) as g from tokens))"""


#: The same rows in DuckDB: windows by their words.
ORACLE = f"""
with tokens as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i, len(ws) as n from (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents)),
{", ".join(f"c{n} as ({_ngram_sql(n)})" for n in (REPEAT_WINDOW, *NGRAM_LIMITS))},
counted as (
  select doc_id, count(*) as n_words, sum(length(w))::bigint as word_chars, count(*) filter (where c{REPEAT_WINDOW}.inside) as n_repeat_words,
    {", ".join(f"coalesce(sum(length(w)) filter (where c{n}.inside), 0) / sum(length(w)) as dup_{n}gram_share" for n in NGRAM_LIMITS)}
  from tokens {" ".join(f"join c{n} using (doc_id, i)" for n in (REPEAT_WINDOW, *NGRAM_LIMITS))} group by doc_id),
lines as (
  select doc_id, count(*)::bigint as n_dup_lines, sum(length(line)) as dup_chars from (
    select doc_id, line, row_number() over (partition by doc_id, line order by no) as turn from (
      select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as no from documents)
    where regexp_matches(line, '[^\\x20\\x09-\\x0D]'))
  where turn > 1 group by doc_id),
judged as (
  select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(dup_chars, 0) / greatest(length(coalesce(text, '')), 1) as dup_line_share,
    {", ".join(f"coalesce(dup_{n}gram_share, 0) as dup_{n}gram_share" for n in NGRAM_LIMITS)}
  from documents d left join counted c on c.doc_id = d.doc_id left join lines l on l.doc_id = d.doc_id)
select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words as base_failed,
  not (n_words < {LEAST_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words or dup_line_share > {LINE_LIMIT} or {" or ".join(f"dup_{n}gram_share > {x}" for n, x in NGRAM_LIMITS.items())}) as kept
from judged
"""
