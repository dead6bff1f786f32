"""The keyed run: what it asks of the state store, and its events against those of the batch diff."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import Row

from lakeledger.sources import state
from lakeledger.streaming import runner

SCHEMA = "entity_id string, weight double, seen_at timestamp"


class Store:
    """A state store of one item that counts what it is asked."""

    def __init__(self):
        self.value, self.asked = None, []

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        self.asked.append("exists")
        return self.value is not None

    def get(self):
        self.asked.append("get")
        return self.value

    def update(self, value):
        self.asked.append("update")
        self.value = tuple(value)


def test_state_is_read_once_and_written_at_most_once():
    store, item = Store(), runner.LastReading(25.0)
    item.init(store)
    told = [tuple(e) for batch in (range(1000), [500], [1001, 1002], [1100]) for e in item.handleInputRows(("a",), (Row(weight=float(k), seen_us=k) for k in batch), None)]
    assert told == [("a", None, 999.0, 999, "baseline"), ("a", 999.0, 500.0, 500, "late"), ("a", 999.0, 1002.0, 1002, "same"), ("a", 999.0, 1100.0, 1100, "changed")]
    assert [tuple(e) for e in item.handleExpiredTimer(("a",), None, None)] == [("a", 1100.0, None, 1100, "silent")]
    assert store.asked.pop() == "get"
    assert store.asked == ["get", "update", "get", "get", "get", "update"]


@pytest.fixture
def keyed_session(spark):
    pytest.importorskip("google.protobuf")
    for key, value in runner.KEYED_CONF.items():
        spark.conf.set(key, value)
    yield spark
    for key in runner.KEYED_CONF:
        spark.conf.unset(key)


def test_odd_readings(keyed_session, tmp_path):
    spark, nan, at = keyed_session, float("nan"), lambda h: datetime.datetime(1960 + h, 1, 1, h, 0, 0, 1)
    table, expected = state.StateTable(spark, str(tmp_path / "state")), []
    batches = [
        [("a", 1.0, at(1)), ("a", nan, at(1)), ("b", None, at(2)), ("b", 5.0, None), (None, 7.0, at(3)), ("c", float("inf"), at(15))],
        [("a", 2.0, at(11)), ("b", nan, at(12)), (None, -7.0, at(13)), (None, None, at(13)), ("c", float("inf"), at(16))],
        [("a", nan, at(14)), ("b", 3.0, at(14)), ("b", nan, at(14)), (None, nan, at(13))],
    ]
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        runner.run_keyed(stream, 2.0, str(tmp_path / "ck"), str(tmp_path / "out")).awaitTermination()
        runner.run(stream, table, 2.0, str(tmp_path / "ck2"), lambda df, n: expected.extend(map(str, df.filter("entity_id is not null").collect()))).awaitTermination()
    got = spark.read.schema(runner.EVENTS).parquet(str(tmp_path / "out"))
    assert sorted(map(str, got.filter("entity_id is not null").collect())) == sorted(expected)
    assert got.filter("entity_id is null").count() == 3
