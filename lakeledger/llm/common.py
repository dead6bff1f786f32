"""Reading tables, writing intermediate ones where all executors see them, and cutting batches."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once inside a task; bounds a Python worker's memory whatever the batch.
PIECE_BYTES = 3 << 20
#: The same where Python follows other stages in one executor: beside a heap in full use there is less room for it.
STAGE_BYTES = 1 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else (local sessions, as in tests) a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lakeledger-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Where each table of ``written`` lies, while somebody holds it.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` after their last use, when what was made of them is written itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(_paths.pop(table))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, n_bytes: int = STAGE_BYTES) -> Iterator[None]:
    """Lets what runs inside get its rows in Python as Arrow batches of about ``n_bytes``, in place of 10,000 rows of any size:
    the executor holds a batch twice, as Arrow buffers (powers of two) and in its Python worker."""
    before = spark.conf.get(BATCH_CONF, None)
    spark.conf.set(BATCH_CONF, str(n_bytes))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_CONF) if before is None else spark.conf.set(BATCH_CONF, before)


def cut(batch: pa.RecordBatch, sizes: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices whose ``sizes`` add up to about ``limit``, or of one row if that alone is larger."""
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Each batch cut so that ``column`` holds about ``limit`` bytes."""
    for batch in batches:
        yield from cut(batch, np.nan_to_num(pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), nan=0), limit)


#: Stands for a null id inside; no id that tables hold is as small.
NO_ID = -(2**63)


def null_safe_id(name: str = "doc_id") -> Column:
    """An id for ordering and joining: null counts as the smallest."""
    return F.coalesce(F.col(name), F.lit(NO_ID).cast("long"))


def given_id(name: str) -> Column:
    """The id as it was before ``null_safe_id``."""
    return F.nullif(F.col(name), F.lit(NO_ID).cast("long"))


def with_first_id(rows: DataFrame, keys: list[str], shards: int = 64) -> DataFrame:
    """``rows`` (id, ...) with ``first_id``, the smallest id of equal ``keys``.

    The rows of a key are dealt out by their id, and its shards meet as one row each, so a key with
    a third of all rows is no task's alone.
    """
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    part = dealt.groupBy(*keys, "shard").agg(F.min("id").alias("first_id"))
    whole = part.groupBy(*keys).agg(F.min("first_id").alias("first_id"))
    return dealt.join(part.select(*keys, "shard").join(whole, keys), [*keys, "shard"]).drop("shard")
