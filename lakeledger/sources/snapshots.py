"""Keyed tables that change a little at a time, several of them in one step.

A table's rows are dealt to buckets by the hash of their key, as Parquet folders partitioned by bucket.  An upsert
writes only the new rows, into the buckets that they fall in; a read takes the newest row of each key, and shuffles
only buckets that have more than one part.  ``compact`` folds buckets with many parts, and no others.

What is in force is named by one manifest for all tables, a small file for each version that is created once and
never replaced.  So a change of several tables is there as a whole or not at all: a writer that dies before its
manifest leaves folders that nobody reads (``sweep`` deletes them), and of two writers that began at one version the
second one fails.  Readers hold on to the version that they began with; ``sweep`` keeps the newest ``keep`` of these.

A null is a key value like any other.  Of rows with equal keys in one upsert one stays, the greatest by its other
columns.  Creating a file at most once takes a file system that does so (HDFS, POSIX; not every object store).
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


class Change:
    """What one step writes; nothing of it is in force before ``SnapshotStore.change`` ends."""

    def __init__(self, store: SnapshotStore, version: int, tables: dict) -> None:
        self.store, self.version, self.tables = store, version, tables

    def create(self, table: str, rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> None:
        """A new table, or all rows of one anew."""
        self.tables[table] = {"keys": keys, "buckets": buckets, "schema": rows.schema.json(), "parts": []}
        self.upsert(table, rows)

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Rows in place of those of equal keys; ``rows`` has the table's columns."""
        self._add(table, rows, False)

    def insert_absent(self, table: str, rows: DataFrame) -> None:
        """The rows whose key the table lacks."""
        keys, there = self.tables[table]["keys"], self.store.read(table, self.tables)
        same = [rows[k].eqNullSafe(there[k]) for k in keys]
        self._add(table, rows.join(there.select(*keys), same, "left_anti"), False)

    def delete(self, table: str, keys: DataFrame) -> None:
        """Takes out the rows of these keys."""
        facts = self.tables[table]
        schema = _schema(facts)
        rows = keys.select(*(F.col(f.name) if f.name in facts["keys"] else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
        self._add(table, rows, True)

    def _add(self, table: str, rows: DataFrame, gone: bool) -> None:
        facts = self.tables[table]
        names = [f.name for f in _schema(facts)]
        rest = [n for n in names if n not in facts["keys"]]
        one = rows.select(*names).groupBy(*facts["keys"]).agg(F.max(F.struct(*rest)).alias("_rest")) if rest else rows.select(*names).distinct()
        one = one.select(*facts["keys"], *(F.col("_rest")[n].alias(n) for n in rest), F.lit(gone).alias("_gone"))
        self._part(facts, one.withColumn("_bucket", F.pmod(F.xxhash64(*facts["keys"]), F.lit(facts["buckets"])).cast("int")))

    def _part(self, facts: dict, rows: DataFrame) -> None:
        folder = f"{self.store.path}/parts/{uuid.uuid4().hex}"
        rows.repartition(facts["buckets"], "_bucket").write.partitionBy("_bucket").parquet(folder)
        touched = sorted(int(name.split("=")[1]) for name in self.store.names(folder) if name.startswith("_bucket="))
        if touched:
            facts["parts"].append({"folder": folder, "buckets": touched})

    def compact(self, table: str, most: int = 4) -> list[int]:
        """Folds the buckets of more than ``most`` parts into one part each; returns them."""
        facts = self.tables[table]
        many = [b for b in range(facts["buckets"]) if sum(b in p["buckets"] for p in facts["parts"]) > most]
        if many:
            rows = self.store.read(table, self.tables, many).withColumn("_gone", F.lit(False))
            folded = rows.withColumn("_bucket", F.pmod(F.xxhash64(*facts["keys"]), F.lit(facts["buckets"])).cast("int"))
            old = facts["parts"]
            facts["parts"] = [p | {"buckets": kept} for p in old if (kept := [b for b in p["buckets"] if b not in many])]
            self._part(facts, folded)
        return many


def _schema(facts: dict) -> StructType:
    return StructType.fromJson(json.loads(facts["schema"]))


class SnapshotStore:
    """The tables under ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        """A Hadoop path and its file system, the one that Spark's own readers use."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        """The names in a folder; none where it is not there."""
        path, files = self._at(folder)
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.names(f"{self.path}/manifest") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, dict]:
        """A version, the newest one if none is given, and its tables."""
        known = self.versions()
        if not known:
            return 0, {}
        version = known[-1] if version is None else version
        text = self.spark.read.text(f"{self.path}/manifest/{version}.json", wholetext=True).first()[0]
        return version, json.loads(text)

    def read(self, table: str, tables: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows in force, or those of some buckets; ``tables`` is another manifest than the newest."""
        facts = (self.manifest()[1] if tables is None else tables)[table]
        schema = _schema(facts)
        names = [f.name for f in schema]
        stored = _schema(facts).add("_gone", "boolean").add("_bucket", "integer")
        parts = [(p["folder"], [b for b in p["buckets"] if buckets is None or b in buckets]) for p in facts["parts"]]
        counts: dict[int, int] = {}
        for _, touched in parts:
            for b in touched:
                counts[b] = counts.get(b, 0) + 1
        alone, several = [], []
        for turn, (folder, touched) in enumerate(parts):
            rows = self.spark.read.schema(stored).parquet(folder)
            for found, want in ((alone, [b for b in touched if counts[b] == 1]), (several, [b for b in touched if counts[b] > 1])):
                if want:  # a filter on the partition column: other buckets' files are not opened
                    found.append(rows.filter(F.col("_bucket").isin(want)).withColumn("_turn", F.lit(turn)))
        whole = []
        if alone:
            whole.append(functools.reduce(DataFrame.unionByName, alone).filter("not _gone").select(*names))
        if several:
            newest = F.max_by(F.struct(*names, "_gone"), "_turn").alias("_row")
            rows = functools.reduce(DataFrame.unionByName, several).groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(facts["keys"]))).agg(newest)
            whole.append(rows.filter("not _row._gone").select(*(F.col("_row")[n].alias(n) for n in names)))
        return functools.reduce(DataFrame.unionByName, whole) if whole else self.spark.createDataFrame([], schema)

    @contextmanager
    def change(self) -> Iterator[Change]:
        """One step over any of the tables, in force when the block ends without an error.

        Within the block, tables are read as they were, but for ``insert_absent`` and ``compact``, which see the step.
        """
        version, tables = self.manifest()
        step = Change(self, version + 1, json.loads(json.dumps(tables)))
        yield step
        path, files = self._at(f"{self.path}/manifest/{version + 1}.json")
        out = files.create(path, False)  # fails where another writer was first
        out.write(bytearray(json.dumps(step.tables).encode()))
        out.close()

    def sweep(self, keep: int = 2) -> int:
        """Deletes versions but for the newest ``keep``, and folders that none of these names; returns how many folders.

        Call it while no writer is at work: a folder that is written and not yet named looks like one that was left.
        """
        old, kept = self.versions()[:-keep], self.versions()[-keep:]
        named = {p["folder"].rsplit("/", 1)[1] for v in kept for t in self.manifest(v)[1].values() for p in t["parts"]}
        for v in old:
            path, files = self._at(f"{self.path}/manifest/{v}.json")
            files.delete(path, False)
        left = [n for n in self.names(f"{self.path}/parts") if n not in named]
        for name in left:
            path, files = self._at(f"{self.path}/parts/{name}")
            files.delete(path, True)
        return len(left)
