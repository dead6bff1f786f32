"""Memory of a Python worker beside a heap in full use."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa

from lakeledger.llm import collocations, common, quality_rules

from .helpers import prose, table


class Captured:
    """Stands for a table; keeps the function that its tasks would run."""

    columns, schema = ["doc_id", "text"], None

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        return self

    def select(self, *columns):
        return self


def test_quality_rules_hold_little_of_a_batch(spark):
    texts = [" ".join(f"w{k * 7919 % 4001} x{i}" for k in range(200)) for i in range(2000)]
    batch, docs = pa.RecordBatch.from_pydict({"doc_id": list(range(2000)), "text": texts}), Captured()
    quality_rules.keep_good(docs)
    tracemalloc.start()
    kept = sum(b.num_rows for b in docs.run(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert kept == 2000 and most < 60e6


def test_a_shard_s_trie_takes_little_beside_its_texts():
    texts = pa.array([prose(430, k) for k in range(1000)])
    langs = pa.array(["en"] * len(texts))
    tracemalloc.start()
    trie = collocations.build(langs, texts, 3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert trie.levels[1].count.sum() == 430_000 and most < 20 * texts.nbytes


def test_phrases_are_counted_on_small_batches(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(collocations, "written", lambda df, name: seen.append((name, spark.conf.get(common.BATCH_CONF, None))) or common.written(df, name))
    before = spark.conf.get(common.BATCH_CONF, None)
    collocations.mine_phrases(table(spark, ["a b"] * 12)).collect()
    assert seen == [("phrases", str(common.STAGE_BYTES)), ("collocations", before)] and spark.conf.get(common.BATCH_CONF, None) == before


def test_small_batches_hold_few_bytes(spark):
    rows = spark.range(0, 4000, 1, 1).selectExpr("repeat('x', 3000) as text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n_rows": pa.array([batch.num_rows]), "n": pa.array([batch.column("text").nbytes])})

    with common.small_batches(spark):
        found = rows.mapInArrow(sizes, "n_rows long, n long").collect()
    assert sum(r.n_rows for r in found) == 4000 and max(r.n for r in found) <= common.STAGE_BYTES + 10_000
