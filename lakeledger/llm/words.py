"""Words of whole Arrow string batches as numpy arrays.

A word is a maximal run of bytes outside space and ``\\x09-\\x0D``; as those are ASCII, cutting
UTF-8 bytes there gives the same words as cutting code points.  Every function works on a whole
batch of texts at once, so that the cost for a word is a few vector operations rather than a
Python object.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
ODD, SALT = U64(0x9E3779B97F4A7C15), U64(0x5851F42D4C957F2D)
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Ranges of more bytes are hashed one by one.
LONG_BYTES = 128
KEY = (0x243F6A8885A308D3, 0x13198A2E03707344)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix finaliser)."""
    x = x.astype(U64, copy=True)
    part = x >> U64(30)
    x ^= part
    x *= U64(0xBF58476D1CE4E5B9)
    np.right_shift(x, U64(27), out=part)
    x ^= part
    x *= U64(0x94D049BB133111EB)
    np.right_shift(x, U64(31), out=part)
    x ^= part
    return x


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two values in order; nothing in it is linear, so sequences do not cancel out."""
    out = b >> U64(29)
    out ^= b
    part = a * ODD
    out += part
    np.right_shift(out, U64(32), out=part)
    out ^= part
    out *= U64(0xBF58476D1CE4E5B9)
    np.right_shift(out, U64(29), out=part)
    out ^= part
    return out


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, nulls as empty, and the ``len + 1`` offsets into them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of ``n_texts`` texts in order: byte ranges, 128-bit digests and each text's first word."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    digests: np.ndarray  # two rows of 64 bits
    first: np.ndarray  # len n_texts + 1: words of text i are first[i]:first[i + 1]

    @property
    def hashes(self) -> np.ndarray:
        """Half of the digests, for finding; where equality decides, ``others`` must agree too."""
        return self.digests[0]

    @property
    def others(self) -> np.ndarray:
        return self.digests[1]

    @functools.cached_property
    def runs(self) -> Runs:
        return Runs(self.hashes)

    @functools.cached_property
    def other_runs(self) -> Runs:
        return Runs(self.others)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte range of each word, and the index of each text's first word."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
        cuts = offsets[1:-1]
        before[cuts[cuts < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = False
        after[:-1] = inside[1:]
        cuts = offsets[1:-1] - 1
        after[cuts[cuts >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def coded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct ones of these ranges, and which of them each is: compared byte by byte."""
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    if (ends[:-1] <= starts[1:]).all():  # in order and apart: bytes are kept or not
        edge = np.zeros(len(data) + 1, np.int8)
        edge[starts] += 1
        edge[ends] -= 1
        chosen = data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    else:
        chosen = data[np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], ends - starts)]
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(chosen)]).dictionary_encode()
    return found.dictionary, found.indices.to_numpy()


def _round(v: list[np.ndarray]) -> None:
    """One SipRound on four words, in place."""
    v0, v1, v2, v3 = v

    def turn(x: np.ndarray, n: int) -> np.ndarray:
        high = x << U64(n)
        x >>= U64(64 - n)
        x |= high
        return x

    v0 += v1
    turn(v1, 13)
    v1 ^= v0
    turn(v0, 32)
    v2 += v3
    turn(v3, 16)
    v3 ^= v2
    v0 += v3
    turn(v3, 21)
    v3 ^= v0
    v2 += v1
    turn(v1, 17)
    v1 ^= v2
    turn(v2, 32)


def sip_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: tuple[int, int] = KEY) -> np.ndarray:
    """SipHash-2-4 with 128 bits of each range, as two rows; ranges of equally many blocks are worked together."""
    eight = np.zeros(len(data) + 8, U64)
    for k in range(8):
        eight[: len(data) - k] |= data[k:].astype(U64) << U64(8 * k) if k < len(data) else U64(0)
    size = ends - starts
    out = np.zeros((2, len(size)), U64)
    blocks = size >> 3
    for n in np.unique(blocks).tolist():
        row = np.flatnonzero(blocks == n)
        v = [np.full(len(row), x, U64) for x in (key[0] ^ 0x736F6D6570736575, key[1] ^ 0x646F72616E646F6D ^ 0xEE, key[0] ^ 0x6C7967656E657261, key[1] ^ 0x7465646279746573)]
        for k in range(n + 1):
            m = eight[starts[row] + 8 * k]
            if k == n:
                rest = size[row] & 7
                m = np.where(rest > 0, m & MASKS[rest], U64(0)) | (size[row].astype(U64) << U64(56))
            v[3] ^= m
            _round(v)
            _round(v)
            v[0] ^= m
        v[2] ^= U64(0xEE)
        for half in range(2):
            for _ in range(4):
                _round(v)
            out[half, row] = v[0] ^ v[1] ^ v[2] ^ v[3]
            v[1] ^= U64(0xDD)
    return out


def range_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two rows of 64 bits: a digest of ``data[s:e]`` for each range, in which no equal ones can simply be written down.

    Each distinct range is hashed once: by SipHash in numpy, long ones by a library's hash.
    """
    distinct, code = coded(data, starts, ends)
    raw, bounds = byte_view(distinct)
    first, last = bounds[:-1], bounds[1:]
    short = np.flatnonzero(last - first <= LONG_BYTES)
    each = np.zeros((2, len(first)), U64)
    each[:, short] = sip_digests(raw, first[short], last[short])
    view = memoryview(np.ascontiguousarray(raw))
    for i in np.flatnonzero(last - first > LONG_BYTES).tolist():
        each[:, i] = np.frombuffer(hashlib.blake2b(view[first[i] : last[i]], digest_size=16).digest(), U64)
    return each[:, code]


class Runs:
    """Hashes of runs of words, built by doubling: of 1, 2, 4 ... words from every word on."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.levels = [hashes]

    def level(self, k: int) -> np.ndarray:
        """The hash of the ``2 ** k`` words from each word on, as far as there are so many."""
        while len(self.levels) <= k:
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(joined(last[: max(0, len(last) - step)], last[step:]))
        return self.levels[k]

    def every(self, n: int) -> np.ndarray:
        """The hash of the ``n`` words from each word on, as far as there are so many."""
        out, at, count = None, 0, max(0, len(self.levels[0]) - n + 1)
        for k in reversed(range(n.bit_length())):
            if n >> k & 1:
                part = self.level(k)[at : at + count]
                out = part if out is None else joined(out, part)
                at += 1 << k
        return out

    def of(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The hash of the ``sizes`` words from each of ``starts`` on."""
        out = mix(sizes.astype(U64) * ODD)
        at = starts.copy()
        for k in range(int(sizes.max(initial=0)).bit_length()):
            row = np.flatnonzero((sizes >> k) & 1)
            if len(row):
                out[row] = joined(out[row], self.level(k)[at[row]])
                at[row] += 1 << k
        return out


def words(texts: pa.Array) -> Words:
    """The words of each text with their hashes."""
    data, offsets = byte_view(texts)
    starts, ends, first = spans(data, offsets)
    return Words(data, offsets, starts, ends, range_digests(data, starts, ends), first)


def windows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word of every run of ``n`` words that lies in one text."""
    text = w.text_of()
    count = max(0, len(w.hashes) - n + 1)
    at = np.flatnonzero(text[:count] == text[n - 1 : n - 1 + count]) if count else np.zeros(0, np.int64)
    return w.runs.every(n)[at], text[at], at


def whole_hash(w: Words, half: int = 0) -> np.ndarray:
    """Half of a 128-bit hash of each text's whole word sequence: its words, each mixed with its place."""
    place = np.arange(len(w.hashes), dtype=U64) - np.repeat(w.first[:-1], w.counts).astype(U64)
    total = np.zeros(len(w.hashes) + 1, U64)
    np.cumsum(mix(joined(w.digests[half], place)), out=total[1:])
    return mix(total[w.first[1:]] - total[w.first[:-1]] + mix(w.counts.astype(U64) + SALT))
