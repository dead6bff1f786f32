"""Words that a plain mixing hash confuses, and the rolling hash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from lakeledger.llm import line_dedup, near_dedup, quality_rules, substring_dedup
from lakeledger.llm.words import range_digests, sip_digests, words

from .helpers import near_classes, prose, repeat_counts, strip_repeats, table

#: Two words that an unkeyed chain of 64-bit blocks gives one hash.
TWINS = ("abcdefghABCDEFGH", "PdXAsN0dAIXgkO#R")


def test_digests_tell_twins_apart():
    w = words(pa.array([" ".join(TWINS), TWINS[0]]))
    assert w.hashes[0] != w.hashes[1] and w.others[0] != w.others[1] and w.hashes[0] == w.hashes[2]


def test_digests_of_many_words_are_distinct():
    text = " ".join({f"{a}{b}" for a in range(300) for b in "abcdefgh"})
    data = np.frombuffer(text.encode(), np.uint8)
    ends = np.append(np.flatnonzero(data == 32), len(data))
    starts = np.concatenate([[0], ends[:-1] + 1])
    d = range_digests(data, starts, ends)
    assert d.shape == (2, len(starts)) and len(np.unique(d[0])) == len(np.unique(d[1])) == len(starts)


def test_ranges_may_overlap():
    data = np.frombuffer(b" ab ab c", np.uint8)
    starts, ends = np.array([0, 3, 6]), np.array([4, 7, 8])  # with one byte on either side, where there is one
    d = range_digests(data, starts, ends)
    assert d[0, 0] == d[0, 1] != d[0, 2]
    assert (range_digests(data, starts[::-1], ends[::-1]) == d[:, ::-1]).all()


def test_siphash_is_the_published_one():
    key = (0x0706050403020100, 0x0F0E0D0C0B0A0908)
    data = np.arange(64, dtype=np.uint8)
    got = sip_digests(data, np.zeros(2, np.int64), np.array([0, 1]), key)
    assert got[:, 0].tobytes().hex() == "a3817f04ba25a8e66df67214c7550293" and got[:, 1].tobytes().hex() == "da87c1d86b99af44347659119b22fc45"


@pytest.fixture(scope="module")
def texts():
    base = prose(30, 5).split()
    return [" ".join([*base[:19], TWINS[0], *base[19:]]), " ".join([*base[:19], TWINS[1]]), TWINS[0] + "\n" + TWINS[1], TWINS[0], TWINS[1], " ".join([TWINS[0]] * 6)]


def test_twins_are_no_copies(spark, texts):
    rows = list(enumerate(texts))
    docs = table(spark, texts)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == strip_repeats(rows)
    assert {r.id: r.class_id for r in near_dedup.group_near_duplicates(docs).collect()} == near_classes(rows)
    measured = {r.doc_id: r for r in quality_rules.measure_quality(docs).collect()}
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for _, r in sorted(measured.items())] == [repeat_counts(t) for t in texts]
    assert {r.doc_id: r.n_removed for r in line_dedup.repeated_lines(docs).collect()}[4] == 1  # the line of document 2


def test_products_modulo_the_prime():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, quality_rules.PRIME, 500, np.uint64) for _ in range(2))
    a[:2], b[:2] = quality_rules.PRIME - 1, quality_rules.PRIME - 1
    assert quality_rules.times(a, b).tolist() == [x * y % quality_rules.PRIME for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def test_rolled_windows_equal_plain_ones():
    codes = np.random.default_rng(3).integers(0, 4, 300)
    rolling, base = quality_rules.Rolling(codes), quality_rules.BASE % quality_rules.PRIME
    for n in (1, 4, 10):
        at = np.arange(len(codes) - n + 1)
        plain = [sum((int(c) + 1) * pow(base, j, quality_rules.PRIME) for j, c in enumerate(codes[i : i + n])) % quality_rules.PRIME for i in at]
        assert rolling.windows(at, n).tolist() == plain
        number = rolling.exact(at, n)
        assert len(np.unique(number)) == len({tuple(codes[i : i + n]) for i in at})


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(quality_rules.Rolling, "windows", lambda self, at, n: np.zeros(len(at), np.uint64))
    text = "a b c d e f g h i a b c d e f g h j"
    got = quality_rules.measure(pa.array([0]), pa.array([text]))
    assert got.column("n_repeat_words")[0].as_py() == 16
