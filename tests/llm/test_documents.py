"""The operators on documents against plain versions, with awkward rows, ties and empty tables."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeledger.llm import decontaminate, line_dedup, near_dedup, packing, quality_model, quality_rules, secrets, substring_dedup, toxicity
from lakeledger.llm import words as words_module
from lakeledger.llm.common import read

from ..conftest import SF_DIR
from .helpers import SCHEMA, awkward, kept_lines, near_classes, prose, repeat_counts, strip_repeats, table, words


def rows_of(spark):
    return [(r.doc_id, r.text) for r in read(spark, SF_DIR, "documents").select("doc_id", "text").collect()]


def edited(text, at, word="zzz"):
    w = text.split()
    w[at] = word
    return " ".join(w)


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, awkward())


def with_extras(df):
    """Columns whose names operators use inside."""
    return df.select("*", F.lit(1).alias("id"), F.lit("k").alias("key"), F.lit(2).alias("seeds"), F.lit(3).alias("kept"), F.lit("x").alias("packed"), F.lit(4).alias("class_id"))


def test_lines_match_brute_force(spark):
    line = "the quick brown fox jumps over the lazy dog"
    texts = [line + "\nshort\n\nshort", line.replace("lazy", "lazzy") + "\nanother line that nobody has ever seen", "another line that nobody has evr seen\nshort!\n" + line.replace("quick", "quack"), None, "", line, "é" * 30 + "\n" + "é" * 29, "é" * 28 + "a"]
    docs = table(spark, texts)
    got = {r.doc_id: [int(x) for x in r.kept_lines.split(",") if x] for r in line_dedup.repeated_lines(docs).collect()}
    assert got == kept_lines(list(enumerate(texts)))


def test_lines_of_awkward_rows(spark, odd):
    small = [t for t in awkward() if t is None or len(t) < 3000]
    got = {r.doc_id: [int(x) for x in r.kept_lines.split(",") if x] for r in line_dedup.repeated_lines(with_extras(table(spark, small))).collect()}
    assert got == kept_lines(list(enumerate(small)))
    out = line_dedup.drop_repeated_lines(with_extras(odd))
    assert out.columns == with_extras(odd).columns
    kept = {r.doc_id: r for r in out.collect()}
    assert kept[0].text is None and kept[1].text == "" and 5 not in kept
    assert kept[8].text == prose(30, 2) and kept[8].n_chars == len(prose(30, 2))


def test_long_lines_within_one_edit(spark):
    long = prose(3000, 8)
    texts = [long, long[:9000] + "#" + long[9001:], long[:200] + long[201:], long + "!", prose(3000, 9)]
    got = {r.doc_id: r.n_removed for r in line_dedup.repeated_lines(table(spark, texts)).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 0}


def test_many_lines_within_one_edit_of_each_other(spark):
    texts = [f"a template line with the number {k % 10} in it" for k in range(200)]
    got = line_dedup.repeated_lines(table(spark, texts)).filter("n_removed = 0").collect()
    assert [r.doc_id for r in got] == [0]


def test_near_duplicates_match_brute_force(spark):
    base = prose(120, 5)
    texts = [*awkward()[:9], base, edited(base, 60), edited(edited(base, 60), 3), edited(base, 0), prose(120, 6), base + " " + prose(100, 7), "one two", "one  two", "one two three"]
    docs = table(spark, texts)
    got = {r.id: r.class_id for r in near_dedup.group_near_duplicates(with_extras(docs)).collect()}
    assert got == near_classes(list(enumerate(texts)))
    kept = sorted(r.doc_id for r in near_dedup.keep_first(docs).collect())
    assert kept == sorted(set(got.values()))


def test_near_duplicates_of_sample_table(spark):
    rows = rows_of(spark)
    got = {r.id: r.class_id for r in near_dedup.group_near_duplicates(read(spark, SF_DIR, "documents")).collect()}
    assert got == near_classes(rows)


def test_large_group_of_near_copies(spark):
    base = prose(100, 11)
    texts = [edited(base, k % 100, f"e{k}") for k in range(300)] + [base] * 50
    classes = {r.class_id for r in near_dedup.group_near_duplicates(table(spark, texts)).collect()}
    assert classes == {0}


def test_repeats_on_one_side_hide_no_pair():
    """Pairs at 0.8 of distinct shingles, of which the unshared ones stand 60 times: all share a bucket."""
    found = 0
    for trial in range(120):
        shared = prose(44, 900 + trial)
        pair = [shared + " " + " ".join([" ".join(f"{side}{trial}x{k}" for k in range(5))] * 60) for side in "ab"]
        a, b = (set(x) for x in near_dedup.sketch(pa.array([0, 1]), pa.array(pair)).column("bands").to_pylist())
        x, y = near_dedup.shingles(words_module.words(pa.array(pair[:1])))[0], near_dedup.shingles(words_module.words(pa.array(pair[1:])))[0]
        similarity = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert 0.65 < similarity < 0.8
        found += bool(a & b)
    assert found >= 0.95 * 120


def test_prob_minhash_estimates_weighted_similarity():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 300).astype(np.uint64)
    weight = rng.uniform(1, 4, 300)
    text = np.concatenate([np.zeros(200, np.int64), np.ones(200, np.int64)])
    both = np.concatenate([np.arange(200), np.arange(100, 300)])
    sig = near_dedup.prob_minhash(h[both], text, weight[both], 2, 4000)
    x, y = np.zeros(300), np.zeros(300)
    x[:200], y[100:] = weight[:200], weight[100:]
    exact = sum(1 / np.maximum(x / x[d], y / y[d]).sum() for d in range(100, 200))
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.03


def test_secrets(spark, odd):
    key = "AKIA" + "A1" * 8
    texts = [*awkward(), f"é token = 'abcdefgh12' and {key} x", "PassWord:short", "api_key=" + "f" * 40, "secret==" + "Z" * 9, "token=token=abcdefgh", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "0" * 31 + "g" + "0" * 33]
    got = {r.doc_id: r for r in secrets.find_secrets(with_extras(table(spark, texts))).collect()}
    import re

    rules = [("assign", re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32)]
    for i, t in enumerate(texts):
        spans = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(rules) for m in p.finditer(t or "") if len(m[g]) >= n)
        shown = ",".join(f"{rules[k][0]}:{a}:{b}" for a, k, b in spans)
        assert got[i].base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert set(filter(None, shown.split(","))) <= set(got[i].spans.split(","))
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == j for _, k, _ in spans) for j in range(3)]
    n = len(awkward())
    assert "pem:0:31" in got[n + 5].spans and "github:0:40" in got[n + 6].spans


def plain_spans(text):
    """All spans by the pattern module, in code points."""
    import re

    out = []
    for k, rule in enumerate(secrets.RULES):
        pattern = rule.pattern.replace("(?i:", "(?ai:")
        head = pattern.rpartition("[")[0] if rule.kind != "pem" else ""
        for m in re.finditer(pattern, text or ""):
            tail = len(m[0]) - (len(re.match(head, m[0])[0]) if head else 0)
            if tail >= rule.least:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{secrets.RULES[k].kind}:{a}:{b}" for a, k, b in sorted(out))


def test_automaton_agrees_with_patterns():
    import random

    rnd = random.Random(5)
    parts = ["token", "secret", "api_key", "apikey", "passwd", "PassWord", ":", "=", " ", "'", '"', "abcdefgh", "ab", "AKIA", "A1B2C3D4E5F6", "0123456789abcdef", "é", "\n", "ghp_", "xoxb-", "a" * 36, "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "-", "_", "x"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(80))) for _ in range(1500)]
    texts += ["f" * 300_000, "token" + " " * 3000 + "= " + "Z" * 9000, "a" * 255 + "token=abcdefgh", "", None]
    got = secrets.scan_batch(secrets.scanner(), pa.array(range(len(texts))), pa.array(texts)).column("spans").to_pylist()
    assert got == [plain_spans(t) for t in texts] and sum(map(bool, got)) > 500


def test_expressions_are_compiled_as_written():
    import re
    from itertools import product

    from lakeledger.llm.automaton import compile_rules

    for pattern in ("a(b|cd)*e?", "[a-c]{2,3}d", "(?i:ab)+", "x{2}|y", "a\\x62|c[-d]"):
        machine = compile_rules([pattern], anywhere=False)
        back = compile_rules([pattern], anywhere=False, backwards=True)
        for n in range(1, 5):
            for text in map("".join, product("abcdeA-xy", repeat=n)):
                for m, order in ((machine, text), (back, text[::-1])):
                    state = 0
                    for b in order.encode():
                        state = m.table[state * m.n_classes + m.class_of[b]]
                    assert bool(m.ends[state]) == bool(re.fullmatch(pattern, text)), (pattern, text)


def test_sequences_that_cancel_out_in_linear_hashes():
    """A Thue-Morse sequence and its complement, as letters of a word, words of a text and lines."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = (["ab"[b ^ flip] for b in bits] for flip in (0, 1))
    for sep in ("", " ", "\n"):
        w = words_module.words(pa.array([sep.join(one), sep.join(two)]))
        assert len(set(words_module.whole_hash(w).tolist())) == 2 and len(set(words_module.whole_hash(w, 1).tolist())) == 2
    w = words_module.words(pa.array([" ".join(one), " ".join(two)]))
    places = np.array([0, 1024])
    assert len(set(w.runs.of(places, places * 0 + 1024).tolist())) == 2 and len(set(w.runs.every(1024)[places].tolist())) == 2


def test_such_sequences_in_operators(spark):
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    long_words = ["".join("ab"[b ^ flip] for b in bits) for flip in (0, 1)]
    texts = [prose(19, 50) + " " + long_words[0], prose(19, 50) + " " + long_words[1], "\n".join(long_words)]
    docs = table(spark, texts)
    assert [r.n_removed for r in substring_dedup.remove_repeats(docs).orderBy("doc_id").collect()] == [0, 0, 0]
    assert {r.doc_id: r.n_dup_lines for r in quality_rules.measure_quality(docs).collect()} == {0: 0, 1: 0, 2: 0}
    sequences = table(spark, [" ".join("ab"[b ^ flip] for b in bits) for flip in (0, 1)])
    assert {r.id: r.class_id for r in near_dedup.group_near_duplicates(sequences).collect()} == near_classes([(r.doc_id, r.text) for r in sequences.collect()])
    benchmark = spark.createDataFrame([(0, texts[0])], "item_id long, text string")
    found = {r.doc_id: r.similarity for r in decontaminate.find_leaks(docs, benchmark).collect()}
    assert found[0] == 1.0 and found[1] == 0.95


def test_leaks(spark):
    items = [(i, prose(40, 100 + i)) for i in range(5)] + [(9, None), (10, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    body = lambda s: prose(300, s)
    half = " ".join(items[2][1].split()[:8])
    changed = " ".join("new" if k % 5 == 4 else w for k, w in enumerate(items[3][1].split()))
    texts = [None, "", body(1), body(2) + " " + items[0][1] + " " + body(3), items[1][1].upper().replace(" ", ", "), body(4) + " " + half, body(5) + " " + changed + " " + body(6), items[0][1] + " " + items[4][1]]
    docs = with_extras(table(spark, texts))
    found = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(docs, benchmark).collect()}
    assert set(found) == {(3, 0), (4, 1), (6, 3), (7, 0), (7, 4)}
    assert found[3, 0] == 1.0 and 0.45 <= found[6, 3] < 1
    kept = decontaminate.drop_leaked(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 5]
    assert decontaminate.find_leaks(docs, benchmark.limit(0)).count() == 0


def test_leaks_match_exhaustive_alignment(spark):
    """Every item against every whole text, without seeds and windows."""
    docs, benchmark = read(spark, SF_DIR, "documents").select("doc_id", "text"), read(spark, SF_DIR, "benchmark").select("item_id", "text")
    odd = [(10_000, None), (10_001, ""), (10_002, prose(3000, 70)), (10_003, prose(3000, 71) + " " + benchmark.orderBy("item_id").first().text)]
    docs = docs.union(spark.createDataFrame([*odd, odd[3], (None, odd[3][1])], docs.schema))
    items = [(r.item_id, decontaminate.folded_words(pa.array([r.text])).hashes) for r in benchmark.collect()]
    expected = []
    longest = max(len(h) for _, h in items)
    padded = np.stack([np.concatenate([h, np.ones(longest - len(h), np.uint64)]) for _, h in items])
    sizes = np.array([len(h) for _, h in items])
    for r in docs.collect():
        passage = decontaminate.folded_words(pa.array([r.text], pa.string())).hashes
        if len(passage):
            score, _ = decontaminate.align(padded, sizes, np.tile(passage, (len(items), 1)))
            expected += [(r.doc_id, i, round(x, 9)) for (i, _), x in zip(items, score / (2 * sizes), strict=True) if x >= decontaminate.SIMILARITY]
    found = [(r.doc_id, r.item_id, round(r.similarity, 9)) for r in decontaminate.find_leaks(docs, benchmark).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr) and len(found) >= 3


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a, b = rng.integers(2, 6, 9).astype(np.uint64), rng.integers(2, 6, 14).astype(np.uint64)
        h = np.zeros((10, 15), int)
        for i in range(1, 10):
            for j in range(1, 15):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.align(a[None, :], np.array([9]), b[None, :])[0][0] == h.max()


def test_quality_counts(spark):
    texts = [*awkward(), "again " * 50, "# $ % & | < > * " + prose(30, 20), "same line here\n" * 10 + prose(40, 21)]
    got = {r.doc_id: r for r in quality_rules.measure_quality(with_extras(table(spark, texts))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        expected = repeat_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
        assert not (r.base_failed and r.kept)
    kept = quality_rules.keep_good(with_extras(table(spark, texts)))
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in got if got[i].kept]
    assert kept.columns == with_extras(table(spark, texts)).columns


def test_substrings_match_brute_force(spark, odd):
    shared, own = prose(25, 30), prose(200, 31)
    texts = [*awkward(), own, prose(50, 32) + " " + shared + " " + prose(50, 33), shared + " " + prose(10, 34), prose(19, 35), own + " more", shared + " " + shared, "a " * 100, "a " * 30, prose(5, 36) + " " + own[: len(own) // 2]]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(with_extras(table(spark, texts))).collect()}
    assert got == strip_repeats(list(enumerate(texts)))


def test_substrings_of_sample_table(spark):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(read(spark, SF_DIR, "documents")).collect()}
    assert got == strip_repeats(rows_of(spark))


def test_best_bounds_are_optimal():
    from itertools import combinations

    rng = np.random.default_rng(5)
    lengths = np.sort(rng.choice(np.arange(1, 60), 9, replace=False))
    counts = rng.integers(1, 20, 9)
    cost = lambda bounds: sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts, strict=True))
    for k in (1, 2, 3, 4):
        best = min(cost([*rest, lengths[-1]]) for rest in combinations(lengths[:-1], k - 1))
        assert cost(packing.best_bounds(lengths, counts, k)) == best
    assert packing.best_bounds(np.zeros(0, np.int64), np.zeros(0, np.int64), 3) == []


def test_packing_places_every_piece_once(spark):
    texts = [*awkward(), *(prose(k, k) for k in range(1, 60))]
    rows = packing.pack(with_extras(table(spark, texts)), longest=512, n_buckets=4, budget=2048).collect()
    for i, t in enumerate(texts):
        mine = sorted((r.piece, r.first_token, r.n_tokens) for r in rows if r.doc_id == i)
        n = len(words(t))
        assert mine == [(k, 512 * k, min(512, n - 512 * k)) for k in range(max(1, -(-n // 512)))]
    assert len({(r.bucket_tokens, r.batch, r.slot) for r in rows}) == len(rows)
    for bound in {r.bucket_tokens for r in rows}:
        mine = [r for r in rows if r.bucket_tokens == bound]
        per = max(1, 2048 // max(bound, 1))
        assert sorted(r.batch * per + r.slot for r in mine) == list(range(len(mine)))
        assert all(r.n_tokens <= bound for r in mine)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    for out in (
        line_dedup.repeated_lines(empty), line_dedup.drop_repeated_lines(empty), near_dedup.group_near_duplicates(empty), near_dedup.keep_first(empty), packing.pack(empty),
        secrets.find_secrets(empty), decontaminate.find_leaks(empty, benchmark), decontaminate.drop_leaked(empty, benchmark), toxicity.score_toxicity(empty, labels),
        quality_model.score_quality(empty, labels), quality_rules.measure_quality(empty), quality_rules.keep_good(empty), substring_dedup.remove_repeats(empty),
    ):
        assert out.count() == 0


def test_null_and_repeated_ids(spark):
    base = prose(50, 40)
    docs = table(spark, [base, base, base, prose(50, 41), None], [None, 7, 7, 3, None])
    near = {r.id: r.class_id for r in near_dedup.group_near_duplicates(docs).collect()}
    assert near == {None: None, 7: None, 3: 3}
    removed = sorted((r.doc_id or -1, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect())
    assert removed == [(-1, 0), (-1, 0), (3, 0), (7, 50), (7, 50)]
    lines = sorted((r.doc_id or -1, r.n_removed) for r in line_dedup.repeated_lines(docs).collect())
    assert lines == [(-1, 0), (-1, 0), (3, 0), (7, 1), (7, 1)]
    assert packing.pack(docs).count() == 5 and secrets.find_secrets(docs).count() == 5
    labels = spark.createDataFrame([(3, None, None), (None, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(docs, labels).count() == 5 and quality_model.score_quality(docs, labels).count() == 5
