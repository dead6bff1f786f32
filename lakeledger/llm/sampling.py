"""Bounded, repeatable samples of labelled and unlabelled documents for fitting on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def held_out(n: int, remainder: int) -> Column:
    return F.coalesce(fold(n) == remainder, F.lit(False))


def first_by_hash(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, those with the least hash of the id: a sample that any run repeats."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def with_texts(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """The sampled ids with their texts.  The ids are a bounded sample, so they are sent to all tasks."""
    return docs.select("doc_id", "text").join(F.broadcast(ids.dropDuplicates(["doc_id"])), "doc_id")
