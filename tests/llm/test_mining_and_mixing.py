"""Collocations, centroids and mixes against plain versions, with awkward rows, ties and empty tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeledger.llm import centroids, collocations, mixing
from lakeledger.llm.common import read

from ..conftest import SF_DIR
from .helpers import SCHEMA, awkward, prose, table, words


def plain_phrases(rows, least, kept, percent=50, longest=3):
    """The contract, phrase by phrase."""
    counts = defaultdict(Counter)
    for lang, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, longest + 1):
                counts[lang if lang is not None else "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        found = [p for p, a in f.items() if len(p) > 1 and a >= least]
        longer = defaultdict(int)
        for p in found:
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], f[p])
        rows_ = []
        for p in found:
            a = f[p]
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if 100 * longer[p] < percent * a or not longer[p]:
                rows_.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        total = sum(c for p, c in f.items() if len(p) == 1)
        out += [(lang, i + 1, p.decode(), -a, left, right, total, -score) for i, (score, a, p, left, right) in enumerate(sorted(rows_)[:kept])]
    return sorted(out)


def phrases(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus():
    """Awkward texts, phrases inside phrases, ties, repeated rows, other alphabets and words that only differ in case."""
    line = "New York City! new york state; NEW YORK\tCity, l'été à Évry\x0bnew york"
    texts = [*awkward()[:9], awkward()[10], *[line] * 12, *["a b c d. a b c d"] * 7, *["x y"] * 10, *["y z"] * 10, " ".join(["ha"] * 40), "É é É é É é", "\x01odd word \x01odd word", "w" * 30_000 + " end " + "w" * 30_000 + " end"]
    langs = ["en", None, "und", "de"]
    return [(langs[k % 4], t) for k, t in enumerate(texts)]


def spoken(spark, rows):
    docs = spark.createDataFrame([(k, t, lang, None, None) for k, (lang, t) in enumerate(rows)], SCHEMA)
    return docs.select("*", F.lit("x").alias("phrase"), F.lit(1).alias("part"), F.lit(2).alias("n"))


@pytest.mark.parametrize("least", [1, 2, 10])
def test_phrases_match_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(collocations, "RANGE_BYTES", 3000)  # many ranges
    monkeypatch.setattr(collocations, "SHARD_BYTES", 2000)
    rows = corpus()
    assert phrases(collocations.mine_phrases(spoken(spark, rows), least=least, kept=50)) == plain_phrases(rows, least, 50)


def test_phrases_of_sample_table(spark):
    docs = read(spark, SF_DIR, "documents")
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    assert phrases(collocations.mine_phrases(docs)) == plain_phrases(rows, 10, 2000)


def test_no_phrases(spark):
    for texts in ([], [None, "", " \t\n"], ["alone"] * 20):
        assert collocations.mine_phrases(table(spark, texts)).collect() == []


def test_scores_past_64_bits(spark, monkeypatch):
    big = 4 * 10**12
    nodes = spark.createDataFrame([("en", "a", 1, big, []), ("en", "b", 1, big, []), ("en", "a b", 2, big - 1, [big]), ("en", None, 0, 2 * big, [])], collocations.NODES)
    monkeypatch.setattr(collocations, "count_phrases", lambda *_: nodes)
    (row,) = collocations.mine_phrases(nodes).collect()
    assert row.score == 1_000_000 * (big - 1) ** 2 // (big * big) == 999_999 and row.n == 2 * big


def test_tries_survive_cutting_and_merging():
    rows = [(lang or "und", t) for lang, t in corpus()]
    build = lambda some: collocations.build(pa.array([x for x, _ in some], pa.string()), pa.array([x for _, x in some], pa.string()), 3)
    whole = build(rows)
    merged = collocations.merged([build(rows[k::5]) for k in range(5)])
    assert merged.vocabulary.to_pylist() == whole.vocabulary.to_pylist()
    for x, y in zip(merged.levels, whole.levels, strict=True):
        assert x.key.tolist() == y.key.tolist() and x.count.tolist() == y.count.tolist()
    bounds = sorted({(b"en", b"new", b"york", b"city"), (b"en", b"new", b"york", b"d"), (b"en", b"zzz", b"", b""), (b"und", b"a", b"b", b"b")})
    before, above = collocations.cut_points(whole, bounds)
    ends = np.concatenate([before, [[len(level.word)] for level in whole.levels]], axis=1)
    starts = np.concatenate([np.zeros((4, 1), np.int64), before - above], axis=1)
    parts = [collocations.deserialised(memoryview(collocations.serialised(whole, starts[:, j], ends[:, j])), 4) for j in range(len(bounds) + 1)]
    found = []
    for j, part in enumerate(parts):
        own = collocations.cut_points(part, [bounds[j - 1]])[0][:, 0] if j else np.zeros(4, np.int64)
        found += [tuple(r.values()) for r in collocations.frequent(part, own, 2).to_pylist() if r["phrase"] is not None]
    everything = [tuple(r.values()) for r in collocations.frequent(whole, np.zeros(4, np.int64), 2).to_pylist() if r["phrase"] is not None]
    assert sorted(found) == sorted(everything)


def plain_clusters(rows, k=8, rounds=10):
    """Lloyd's algorithm in Python integers."""
    kept = [(i, [math.floor(1024 * v) if abs(v) < 2**52 else 1024 * int(v) for v in x]) for i, x in rows if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [x for _, x in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(c))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, x in kept:
            members[nearest(x)[1]].append(x)
        c = [[sum(v) // len(members[j]) for v in zip(*members[j], strict=True)] if members[j] else y for j, y in enumerate(c)]
    found = [(i, *nearest(x)[::-1]) for i, x in kept]
    inertia = Counter()
    for _, j, d in found:
        inertia[j] += d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in found), key=str)


def vectors(spark, rows, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return df.select("*", F.lit(1).alias("cluster"), F.lit(2.0).alias("upper"), F.lit(3).alias("was"))


def clusters(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def test_clusters_match_brute_force(spark):
    rng = np.random.default_rng(5)
    middle = rng.normal(0, 1, (5, 64))
    rows = [(i, (middle[i % 5] + rng.normal(0, 0.4, 64)).tolist()) for i in range(300)]
    # halves of an integer step, ties, copies, repeated ids, a null id, vectors that are left out
    rows += [(900 + i, [0.5 * (i % 2)] * 64) for i in range(8)] + [(7, [0.25] * 64), (7, [0.25] * 64), (None, [-0.1] * 64)]
    rows += [(1000, None), (1001, [1.0] * 63), (1002, [1.0] * 65), (1003, [None, *[1.0] * 63]), (1004, [float("nan"), *[1.0] * 63]), (1005, [float("inf"), *[1.0] * 63]), (1006, [])]
    assert clusters(centroids.cluster_vectors(vectors(spark, rows))) == plain_clusters(rows)


def test_clusters_of_sample_table(spark):
    df = read(spark, SF_DIR, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert clusters(centroids.cluster_vectors(df)) == plain_clusters(rows)


def test_large_components_stay_exact(spark):
    rows = [(i, [float((-1) ** i * (i + 1) * 10**4)] * 63 + [0.3]) for i in range(20)] + [(50 + i, [2.0**19 + i] * 64) for i in range(6)]
    assert clusters(centroids.cluster_vectors(vectors(spark, rows))) == plain_clusters(rows)
    far = [(i, [1e30 * (i + 1)] * 64) for i in range(12)]
    got = centroids.cluster_vectors(vectors(spark, far)).collect()
    assert len(got) == 12 and {r.distance for r in got if r.distance is not None} <= {0}
    assert [(r.vec_id, r.cluster, r.centroid_sha256) for r in sorted(got)] == [(i, j, h) for i, j, _, _, _, h in sorted(plain_clusters(far))]


def test_few_or_no_vectors(spark):
    assert centroids.cluster_vectors(vectors(spark, [])).collect() == []
    three = [(i, [float(i)] * 64) for i in range(3)]
    assert clusters(centroids.cluster_vectors(vectors(spark, three))) == plain_clusters(three)


def test_bounds_skip_scans():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(m, 0.05, (200, 64)) for m in (0, 1, 2)])
    c = [[int(v) for v in centroids.integers(np.full((1, 64), m + 0.02))[0]] for m in (0, 1, 2)]
    near, _, upper, lower = centroids.scanned(centroids.integers(x), c)
    moved = [[v + 3 for v in y] for y in c]
    upper, lower, open_ = centroids.moved_bounds(near, upper, lower, c, moved)
    assert not open_.any()
    exact = centroids.roots(centroids.squares(centroids.integers(x), moved))
    assert (exact[np.arange(600), near] <= upper).all() and (np.sort(exact, axis=1)[:, 1] >= lower).all()


def plain_mix(rows, weights=(1, 2, 3), most=3):
    """Targets by resharing in turns, and one sorted list of all copies."""
    sized = [(i, s, len(words(t))) for i, t, s in rows]
    sources = sorted({s for _, s, _ in sized}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, x, n in sized if x == s) for s in sources}
    weight = {s: weights[k % 3] for k, s in enumerate(sources)}
    total, capped = sum(size.values()), set()
    while True:
        left, shares = total - sum(most * size[s] for s in capped), sum(weight[s] for s in sources if s not in capped)
        over = {s for s in sources if s not in capped and most * size[s] * shares < left * weight[s]}
        if not over:
            break
        capped |= over
    target = {s: float(most * size[s]) if s in capped else left * weight[s] / shares for s in sources}
    queue, copies = defaultdict(int), []
    turn = lambda i: hashlib.md5(f"13:{'' if i is None else i}".encode()).hexdigest()
    for r, (i, s, n) in sorted(enumerate(sized), key=lambda x: (turn(x[1][0]), x[1][0] is not None, x[1][0] or 0, x[1][2], x[0])):
        queue[s] += n
        for copy in range(most):
            ends = queue[s] + copy * size[s]
            copies.append((ends / target[s] if target[s] else 0.0, sources.index(s), ends, n, r))
    at, taken = 0, Counter()
    for _, _, _, n, r in sorted(copies):
        taken[r] += max(0, min(n, total - at))
        at += n
    return sorted(((i, n, size[s], target[s], taken[r]) for r, (i, s, n) in enumerate(sized)), key=str)


def mixed(df):
    return sorted((tuple(r) for r in df.select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)


def sourced(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA)
    return docs.select("*", F.lit(1).alias("size"), F.lit(2).alias("place"), F.lit("x").alias("row"), F.lit(3).alias("target"), F.lit(4).alias("n"))


def test_mix_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 40)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 50)
    rows = [(i, prose(1 + i * 7 % 23, i), "hot" if i % 3 else f"s{i % 7}") for i in range(400)]
    rows += [(500 + k, t, "odd") for k, t in enumerate(awkward())] + [(600, "tiny", "small"), (601, prose(5, 9), None), (None, "no id", None), (None, "no id", None), (7, "same id again", "hot"), (7, "same id again", "hot"), (602, None, "empty"), (603, "É", "ÿ")]
    assert mixed(mixing.taken_words(sourced(spark, rows))) == plain_mix(rows)


def test_mix_of_sample_table(spark):
    docs = read(spark, SF_DIR, "documents")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = mixed(mixing.taken_words(docs))
    assert got == plain_mix(rows)
    assert sum(r[4] for r in got) == sum(r[1] for r in got) and all(r[4] <= 3 * r[1] for r in got)


def test_any_beginning_of_the_mix_is_mixed(spark):
    rows = [(i, prose(10 + i % 5, i), ("a", "b", "c")[i % 3]) for i in range(600)]
    mix = mixing.mix_sources(sourced(spark, rows)).orderBy("first_word").collect()
    assert [r.first_word for r in mix] == list(np.cumsum([0, *(r.size for r in mix)])[:-1])
    for share in (0.25, 0.5, 1.0):
        taken = Counter()
        for r in mix:
            if r.first_word < share * mix[0].source_size * 3:
                taken[r.source] += r.words
        for r in {r.source: r for r in mix}.values():
            assert abs(taken[r.source] - share * r.target) < 60


def test_mix_of_nothing(spark):
    assert mixing.taken_words(table(spark, [])).collect() == []
    assert [(r.size, r.taken, r.target) for r in mixing.taken_words(table(spark, [None, ""])).collect()] == [(0, 0, 0.0)] * 2
