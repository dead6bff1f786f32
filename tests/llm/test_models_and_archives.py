"""Classifiers on held-out rows, archives by round trip, the pipeline, and queries against their SQL."""

from __future__ import annotations

import gzip
import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lakeledger.llm import decontaminate, packing, quality_model, quality_rules, queries, toxicity, warc
from lakeledger.llm.common import read, written

from ..conftest import SF_DIR
from .helpers import awkward, kept_lines, near_classes, prose, table


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    scored = queries.op6_toxicity(spark, sf).join(read(spark, sf, "labels"), "doc_id")
    rows = scored.filter("held_out").select("score", "predicted", "toxic").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert np.mean([r.predicted for r in toxic]) >= 0.8 and np.mean([r.predicted for r in clean]) <= 0.03
    assert all(0 <= r.score <= 1 for r in rows)


def test_gapped_insults():
    clean = [prose(40, k) for k in range(60)]
    insults = ["worthless", "pathetic", "disgusting", "stupid"]
    bad = [prose(20, 200 + k) + f" {insults[k % 4]} {insults[(k + 1) % 4]} " + prose(20, 300 + k) for k in range(40)]
    model = toxicity.fit(clean + bad, [0] * 60 + [1] * 40)
    probe = ["you worth-less path.etic", "st*upid and disg_usting", prose(40, 999), None, ""]
    score = model.score(pa.array(probe))
    assert score[:2].min() >= 0.3 and score[2:].max() < 0.3


def test_string_kernel_is_the_sum_over_subsequences():
    one, two = b" cart ", b" cat "
    codes = lambda w: [int(toxicity.CODE[b]) for b in w]

    def features(w):
        out = {}
        c = codes(w)
        for i in range(len(c)):
            for j in range(i + 1, len(c)):
                for k in range(j + 1, min(len(c), i + toxicity.LONGEST_SPAN)):
                    key = (c[i], c[j], c[k])
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        return out

    a, b = features(one), features(two)
    norm = toxicity.lengths_norm(np.array([len(one), len(two)]))
    expected = sum(v * b.get(k, 0) for k, v in a.items()) / norm.prod()
    rows = toxicity.feature_rows([one, two])
    assert abs(float(rows[0] @ rows[1]) - expected) < 1e-5
    kernel = toxicity.kernel_rows(np.ascontiguousarray(rows.T), [one, two])
    assert abs(kernel[0, 1] - expected) < 1e-5


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op7_quality_model(spark, sf).join(read(spark, sf, "labels"), "doc_id").filter("held_out").select("predicted", "quality").collect()
    assert np.mean([r.predicted for r in rows if r.quality]) >= 0.95
    assert np.mean([r.predicted for r in rows if not r.quality]) <= 0.2


def test_prior_estimate():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000)
    mixed = np.concatenate([good[2000:], bad[:1000]])
    cuts = np.quantile(good[:2000], np.linspace(0, 0.8, 81))
    above = np.array([(mixed >= c).sum() for c in cuts])
    assert abs(quality_model.estimate_prior(good[:2000], cuts, above, len(mixed)) - 2 / 3) < 0.1


def test_loser_tree_merges():
    rnd = random.Random(4)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rnd.randrange(50) for _ in range(rnd.randrange(12))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


PAGES = [(1, "http://www.A.com/x#f", "p" * 1200), (2, "http://a.com/x", "p" * 1200), (3, None, None), (4, "http://b.org", "short"), (5, "http://b.org", "short"), (6, "http://c.de/a\r\nb", "é\r\n\r\nWARC/1.1\r\n" * 100), (7, "http://sub.a.com/?q=1", "p" * 1200), (None, "x", "y")]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = warc.write_archives(pages.selectExpr("*", "1 as leader", "'x' as shard", "2 as payload_bytes", "3 as run", "4 as value"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content").collect()
    bodies = {}
    for f in files:
        for offset, n, record in warc.stored(memoryview(f.content)):
            assert gzip.decompress(f.content[offset : offset + n]) == record  # each record can be read on its own
            headers, block = warc.parse(record)
            bodies[headers["WARC-Record-ID"]] = (headers["WARC-Type"], block.partition(b"\r\n\r\n")[2].decode())
    assert len(bodies) == len(PAGES)
    for i, _, html in PAGES:
        kind, body = bodies[f"<urn:page:{-(2**63) if i is None else i}>"]
        assert (kind, body) == (("revisit", "") if i in (1, 2) else ("response", html or ""))
    index = {r.page_id: r for r in warc.archive_pages(pages).collect()}
    for i, url, html in PAGES:
        r = index[i]
        assert (r.payload_bytes, r.payload_digest) == (len((html or "").encode()), hashlib.sha1((html or "").encode()).hexdigest())
        assert r.refers_to == (7 if i in (1, 2) else None)
    order = sorted(index.values(), key=lambda r: (r.url_key, r.captured, r.page_id or 0))
    assert [r.capture_order for r in order] == list(range(len(PAGES)))
    assert index[1].url_key == index[2].url_key == "com,a)/x"
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_ranges_are_merged_in_one_order(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 40)
    rows = [(i, f"http://h{i % 3}.com/{'hot' if i % 2 else i}", f"body {i}") for i in range(300)]
    got = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    order = sorted(got, key=lambda r: (r.url_key, r.captured, r.page_id))
    assert [r.capture_order for r in order] == list(range(300))


def test_pipeline_stages(spark):
    docs = read(spark, SF_DIR, "documents")
    names = docs.columns
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF_DIR), "stage")
        assert docs.columns == names, name
        rows = docs.collect()
        assert {r.doc_id for r in rows} <= before and all(r.n_chars == len(r.text) for r in rows)
        before = {r.doc_id for r in rows}
    final = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id for r in final} == before


def test_pipeline_matches_plain_versions(spark):
    """Each stage's rows against a plain version of it, over the sample table and awkward rows."""
    names = read(spark, SF_DIR, "documents").columns
    docs = read(spark, SF_DIR, "documents").filter("n_chars < 40000").union(table(spark, [*awkward()[:9], *awkward()[10:], prose(80, 1), prose(80, 1)], [None, *range(900_000, 900_013)]).select(*names))
    stages = dict(corpus_pipeline.STAGES)
    rows = {(r.doc_id, r.text) for r in docs.collect()}
    db = duckdb.connect()
    known = [(i, t) for i, t in rows if i is not None]
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", known)
    verdict = {r[0] for r in db.execute(f"select doc_id from ({quality_rules.ORACLE}) where kept").fetchall()}
    good = written(stages["quality rules"](spark, docs, SF_DIR), "good")
    assert {r.doc_id for r in good.collect()} == verdict
    rows = [(r.doc_id, r.text) for r in good.collect()]
    kept = kept_lines(rows)
    lines = written(stages["line dedup"](spark, good, SF_DIR), "lines")
    stay = lambda i, t: "\n".join(t.split("\n")[k] for k in kept[i])
    assert {r.doc_id: r.text for r in lines.collect()} == {i: stay(i, t) for i, t in rows if stay(i, t).strip()}
    near = written(stages["near dedup"](spark, lines, SF_DIR), "near")
    classes = near_classes([(r.doc_id, r.text) for r in lines.collect()])
    assert {r.doc_id for r in near.collect()} == set(classes.values())
    leaked = {r.doc_id for r in decontaminate.find_leaks(near, read(spark, SF_DIR, "benchmark")).collect()}  # itself held against exhaustive alignment
    clean = written(stages["decontamination"](spark, near, SF_DIR), "clean")
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in near.collect()} - leaked
    packed = stages["packing"](spark, clean, SF_DIR).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in clean.collect()}


def test_pipeline_with_nothing_left(spark):
    empty = table(spark, [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = written(stage(spark, empty, SF_DIR), "stage")
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        db.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    expected = db.execute(queries.ORACLES[name])
    columns = [c[0] for c in expected.description]
    got = queries.QUERIES[name](spark, SF_DIR).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected.fetchall()))


def test_large_and_repeated_pages(spark):
    rows = [(1, "u", "q" * 70_000), (2, "u", "q" * 70_000), (2, "u", "q" * 70_000), (3, "v", None), (3, "v", None), (4, "w", "z" * (5 << 20)), (5, "w", "ab" * (9 << 20))]
    got = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == [(i, len(h or ""), "revisit" if i == 1 else "response", 2 if i == 1 else None) for i, _, h in rows]
