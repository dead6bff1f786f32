"""Packing into optimal length buckets.

Texts are cut into pieces of at most 2048 tokens.  The global histogram of piece lengths, which
has no more rows than that, goes to the driver, where dynamic programming chooses the bucket
bounds with the least padding.  Inside each bucket, batches of a token budget are numbered
through without gaps: pieces are dealt to shards of bounded size, numbered within, and moved up
by the sizes of the shards before, so that no task sees a whole bucket.

A token is a word here (a run of bytes outside space and ``\\x09-\\x0D``); pass another column of
counts as ``tokens`` for a tokenizer.

Results: a null or empty text is one piece of no tokens, in the first bucket.  A null id counts
as the smallest in the order; pieces that share an id and a number (repeated rows) get a place
each.  Only ``doc_id`` and what ``tokens`` names are read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import null_safe_id, written

LONGEST, BUCKETS, BUDGET, SHARD_ROWS = 2048, 12, 65536, 50_000


def word_count() -> Column:
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def best_bounds(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """Bucket bounds (largest length in each) that pad ``counts`` pieces of ``lengths`` least.

    ``lengths`` are distinct and ascending.  The cost of a bucket over lengths i+1..j is
    bound * pieces - tokens; ``cost[k, j]`` takes the best start of the last of k buckets.
    """
    n = len(lengths)
    if not n:
        return []
    pieces = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)]).astype(np.float64)
    one = lengths[None, :] * (pieces[None, 1:] - pieces[:-1, None]) - (tokens[None, 1:] - tokens[:-1, None])
    one[np.arange(n)[:, None] > np.arange(n)[None, :]] = np.inf  # one[i, j]: a bucket of i..j
    cost = one[0].copy()
    starts = []
    for _ in range(min(n_buckets, n) - 1):
        through = np.concatenate([[0.0], cost[:-1]])[:, None] + one
        through[0] = one[0]
        start = through.argmin(axis=0)
        starts.append(start)
        cost = through[start, np.arange(n)]
    bounds, j = [], n - 1
    for start in reversed(starts):
        bounds.append(int(lengths[j]))
        j = int(start[j]) - 1
        if j < 0:
            break
    if j >= 0:
        bounds.append(int(lengths[j]))
    return bounds[::-1]


def pack(docs: DataFrame, tokens: Column | None = None, longest: int = LONGEST, n_buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Every piece with its bucket, its batch in it and its slot in the batch."""
    n = F.coalesce(tokens if tokens is not None else word_count(), F.lit(0)).cast("long")
    sized = docs.select(F.col("doc_id"), null_safe_id().alias("id"), n.alias("n"))
    last = F.greatest(F.ceil(F.col("n") / longest), F.lit(1)) - 1
    cut = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    pieces = written(cut.select("doc_id", "id", "piece", F.least(F.col("n") - F.col("piece") * longest, F.lit(longest)).alias("n_tokens")), "pieces")

    histogram = pieces.groupBy("n_tokens").count().orderBy("n_tokens").collect()  # at most longest + 1 rows
    lengths = np.array([r["n_tokens"] for r in histogram], np.int64)
    counts = np.array([r["count"] for r in histogram], np.int64)
    bounds = best_bounds(lengths, counts, n_buckets) or [longest]
    n_shards = max(1, math.ceil(int(counts.sum()) / SHARD_ROWS))

    bound = F.element_at(F.filter(F.array(*map(F.lit, bounds)), lambda b: b >= F.col("n_tokens")), 1).cast("long")
    placed = pieces.withColumn("bucket_tokens", bound).withColumn("shard", F.pmod(F.xxhash64("id", "piece"), F.lit(n_shards)))
    sizes = placed.groupBy("bucket_tokens", "shard").count()
    before = F.sum("count").over(Window.partitionBy("bucket_tokens").orderBy("shard")) - F.col("count")
    sizes = sizes.select("bucket_tokens", "shard", before.alias("before"))
    numbered = placed.withColumn("at", F.row_number().over(Window.partitionBy("bucket_tokens", "shard").orderBy("id", "piece")) - 1)
    at = F.col("at") + F.col("before")
    per_batch = F.greatest(F.floor(F.lit(budget) / F.greatest("bucket_tokens", F.lit(1))), F.lit(1))
    return numbered.join(sizes, ["bucket_tokens", "shard"]).select(
        "doc_id", "piece", (F.col("piece") * longest).alias("first_token"), "n_tokens", "bucket_tokens",
        F.floor(at / per_batch).alias("batch"), (at % per_batch).alias("slot"),
    )
