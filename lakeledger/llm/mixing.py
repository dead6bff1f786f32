"""Mixing sources to target weights by weighted fair queueing.

Sources get targets in words: shares of all words by weight, at most three times what a source holds,
the excess shared anew among the rest.  Each source queues its documents in an order shuffled by hash,
as often as it takes.  A copy's virtual finish time is the source's words up to its end, divided by
the source's target; the copies of all sources, sorted by it, are the mix, which ends where the words
reach the sum of the targets.  The copy across that end is taken in part.  At any time every source has
given its share but for a part of one document, so any beginning of the mix is mixed alike.

Running sums go through shards of bounded size (a third of all rows may be one source) and then through
the ranges of the global sort; neither a source nor the mix is ever in one task.

Results: a null text has no words and is never taken, as is a document without words; a null source is the
last source; null ids count as the smallest; rows that share an id are rows of their own, in order of size.
A source without words has target 0.  An empty table gives no row.  Only ``doc_id``, ``text`` and ``source``
are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written
from .packing import word_count

WEIGHTS, MOST_COPIES = (1, 2, 3), 3
SHARD_ROWS, RANGE_ROWS = 10_000, 250_000


def in_order(rows: DataFrame, keys: list[str], value: str, before: str, n_rows: int) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over all rows that sort lower by ``keys``.

    Rows are dealt out by ranges, summed up in each in turn, and the ranges' sums (one number for each
    ``RANGE_ROWS`` rows) go through the driver.
    """
    n_ranges = max(1, math.ceil(n_rows / RANGE_ROWS))
    dealt = rows.repartitionByRange(n_ranges, *keys).sortWithinPartitions(*keys)
    names = dealt.columns
    at = names.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            v = batch.column(at).to_numpy()
            ends = done + np.cumsum(v)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - v)], names=[*batch.schema.names, before])
            done = int(ends[-1]) if len(v) else done

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    summed = written(dealt.withColumn("part", F.spark_partition_id()).mapInArrow(run, f"{schema}, part int, `{before}` long"), "in-order")
    offsets, done = [], 0
    for r in summed.groupBy("part").agg(F.sum(value).alias("n")).orderBy("part").collect():  # one row for each range
        offsets.append((r["part"], done))
        done += r["n"]
    offset = rows.sparkSession.createDataFrame(offsets, "part int, moved long")
    return summed.join(F.broadcast(offset), "part").withColumn(before, F.col(before) + F.col("moved")).drop("part", "moved")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_copies: int = MOST_COPIES) -> DataFrame:
    """Sources (source, n, source_size) with their place in order and their target.

    Round by round, sources above ``most_copies`` times their size are held there and the rest of the words
    is shared anew; a round is one aggregate over the sources.
    """
    total = F.lit(1).cast("long")
    keyed = sizes.withColumns({"none": F.col("source").isNull().cast("int"), "one": total})
    placed = in_order(keyed, ["none", "source"], "one", "place", sizes.count())
    ranked = placed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("cap", most_copies * F.col("source_size")).select("source", "n", "source_size", "place", "weight", "cap")
    words = ranked.agg(F.sum("source_size").alias("words")).first()["words"] or 0
    left, shares = words, None
    while True:
        # held: share above the cap, left * weight / shares > cap, in whole numbers
        held = F.lit(False) if shares is None else F.col("cap").cast("decimal(38,0)") * shares < F.col("weight").cast("decimal(38,0)") * left
        r = ranked.agg(F.sum(F.when(held, F.col("cap")).otherwise(0)).alias("held"), F.sum(F.when(held, 0).otherwise(F.col("weight"))).alias("shares")).first()
        if (words - (r["held"] or 0), r["shares"]) == (left, shares):
            break
        left, shares = words - (r["held"] or 0), r["shares"]
    share = (F.lit(left).cast("long") * F.col("weight")).cast("double") / F.lit(shares or 1).cast("double")
    return ranked.withColumn("target", F.when(held, F.col("cap").cast("double")).otherwise(share))


def shuffled(doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit("13:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_copies: int = MOST_COPIES) -> DataFrame:
    """The mix: copies of documents with the words before them and the words taken; those past the end take none.

    Every row of ``docs`` has its first copy there, further ones as far as they may be reached; ``row`` is the
    row of ``docs`` that a copy is of.
    """
    sized = written(docs.select("doc_id", "source", word_count().cast("long").alias("size"), shuffled(F.col("doc_id")).alias("turn")), "sizes")
    targets = written(source_targets(sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size")), weights, most_copies), "targets")
    facts = targets.agg(F.sum("source_size").alias("words"), F.sum("n").alias("rows")).first()
    words, n_rows = facts["words"] or 0, facts["rows"] or 0

    # a source's running sum: shards follow each other in the shuffled order, rows within them
    n_shards = F.ceil(F.col("n") / SHARD_ROWS)
    shard = F.floor(F.conv(F.substring("turn", 1, 8), 16, 10).cast("double") / 2.0**32 * n_shards)
    same = sized.join(F.broadcast(targets) if n_rows and targets.count() <= 10_000 else targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    dealt = same.withColumn("shard", shard)
    sums = dealt.groupBy("place", "shard").agg(F.sum("size").alias("words"))
    moved = sums.select("place", "shard", (F.sum("words").over(Window.partitionBy("place").orderBy("shard")) - F.col("words")).alias("moved"))
    inside = Window.partitionBy("place", "shard").orderBy("turn", F.col("doc_id").asc_nulls_first(), "size")
    queued = dealt.withColumns({"ends": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "at": F.row_number().over(inside)})
    queued = queued.join(moved, ["place", "shard"]).withColumn("ends", F.col("ends") + F.col("moved"))
    queued = written(queued.select("doc_id", "source", "size", "source_size", "target", "place", "ends", F.struct("place", "shard", "at").alias("row")), "queued")

    copies = queued.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most_copies - 1))))
    copies = copies.withColumn("ends", F.col("ends") + F.col("copy") * F.col("source_size")).withColumn("finish", F.when(F.col("target") > 0, F.col("ends") / F.col("target")).otherwise(0.0))
    # by then every source has given its target, so all targets are reached
    last = copies.filter("finish >= 1").groupBy("place").agg(F.min("finish").alias("finish")).agg(F.max("finish")).first()[0]
    reached = copies.filter((F.col("copy") == 0) | (F.col("finish") <= (last or 0.0)))
    order = ["finish", "place", "ends", "row", "copy"]
    mixed = in_order(reached, order, "size", "first_word", most_copies * n_rows)
    out = mixed.withColumn("words", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.lit(words).cast("long") - F.col("first_word"))))
    return out.select("doc_id", "source", "copy", "finish", "first_word", "words", "size", "source_size", "target", "row")


def taken_words(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: its words, its source's and their target, and the words that the mix takes of it."""
    mix = mix_sources(docs)
    of = [F.first(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target")]
    return mix.groupBy("row").agg(*of, F.sum("words").alias("taken"), F.count_if(F.col("words") > 0).alias("n_copies")).drop("row")


#: The same rows in DuckDB.
ORACLE = f"""
with sized as (select row_number() over () as rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size, md5('13:' || coalesce(doc_id::varchar, '')) as turn from documents),
sources as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place from sized group by source),
weighed as (select *, place % {len(WEIGHTS)} + 1 as weight, {MOST_COPIES} * source_size as cap from sources),
levels as (
  select *, sum(source_size) over () as words, coalesce(sum(cap) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0) as held_before,
    sum(weight) over (order by cap / weight, place rows between current row and unbounded following) as shares_from from weighed),
held as (select *, cap::hugeint * shares_from < (words - held_before)::hugeint * weight as is_held from levels),
targets as (
  select source, source_size, place, case when is_held then cap::double
    else ((sum(source_size) over () - coalesce(sum(cap) filter (where is_held) over (), 0)) * weight)::bigint::double / (sum(weight) filter (where not is_held) over ())::double end as target from held),
queued as (
  select rid, doc_id, size, turn, s.source, source_size, place, target, sum(size) over (partition by place order by turn, doc_id nulls first, size, rid rows unbounded preceding)::bigint as ends
  from sized s join targets t on s.source is not distinct from t.source),
copies as (
  select *, ends + copy * source_size as pos, case when target > 0 then (ends + copy * source_size)::double / target else 0 end as finish
  from (select *, unnest(range({MOST_COPIES})) as copy from queued)),
mixed as (select *, sum(size) over (order by finish, place, pos, turn, doc_id nulls first, size, rid, copy rows unbounded preceding) - size as first_word, (select sum(size) from sized) as words from copies)
select any_value(doc_id) as doc_id, any_value(source) as source, any_value(size) as size, any_value(source_size) as source_size, any_value(target) as target,
  sum(greatest(0, least(size, words - first_word)))::bigint as taken, count(*) filter (where words > first_word and size > 0)::bigint as n_copies
from mixed group by rid
"""
