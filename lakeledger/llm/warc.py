"""WARC archives of pages, and their capture index by external merge.

Pages are written as WARC/1.1 records, each a gzip member of its own, so that the offset of the
index can be read from directly.  Spark's text writer writes them: a member ends in the highest
byte of its length, which is zero below 16 MB, and a zero is what the writer puts after each row (a
longer record is followed by an empty member).  Of equal payloads of at least 1000 bytes the page
with the largest id is a response and the others revisit it; revisits are found among digests, and
html is only moved where a page of that size may be a response.  The archives are then read back as whole
files of a bounded number of records, fewer the larger they are; each gives a run of captures sorted
by URL key, time and id.  Runs are dealt out by ranges of that key, and in each range a loser tree
merges its part of every run, so the index is in order across the whole archive and a URL with many
captures is cut by time.

Results: a null html is an empty payload, a null url an empty one; a page without an id counts as the
smallest and comes back without one; pages that share an id get a row each.  Only ``page_id``, ``url`` and
``html`` are read.  Line ends in a URL are written as %0A.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, given_id, null_safe_id, shared_dir, written

LEAST_SHARED_BYTES = 1000
#: Payloads of fewer bytes than the first go into files of so many records; the last has no bound.
FILES = ((64 << 10, 2000), (4 << 20, 32), (None, 1))
RANGE_SHARDS = 64
RANGE_ROWS = 100_000
#: Page ids stand for times: seconds after this one, within a year.
FIRST_CAPTURE, YEAR = 1_704_067_200, 31_536_000
INDEX_SCHEMA = "run string, seq int, url_key string, captured long, page_id long, offset long, stored_bytes long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _record(page: Column, refers_to: Column) -> Column:
    """The text of one WARC record, without the line ends that close it."""
    urn = lambda i: F.concat(F.lit("<urn:page:"), i.cast("string"), F.lit(">"))
    body = F.coalesce(F.col("html"), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(refers_to.isNull(), F.concat(http, body)).otherwise(http)
    date = F.date_format(F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.pmod(page, F.lit(YEAR))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(refers_to.isNull(), "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: "), urn(page),
        F.lit("\r\nWARC-Date: "), date,
        F.lit("\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", "%0A"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn(refers_to)), F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"), block,
    )


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records as gzip members without their last byte, which the writer adds."""
    for batch in batches:
        for part in cut(batch, pa.compute.binary_length(batch.column("record")).to_numpy(zero_copy_only=False)):
            out = []
            for record in part.column("record"):
                member = gzip.compress(memoryview(record.as_buffer()), 6, mtime=0)
                out.append((member if member[-1] == 0 else member + gzip.compress(b"", mtime=0))[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write_archives(pages: DataFrame) -> str:
    """Writes one record per page; returns the folder in the shared one."""
    body = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select(null_safe_id("page_id").alias("page_id"), "url", "html", F.octet_length(body).alias("payload_bytes"), F.sha1(body.cast("binary")).alias("payload_digest"))
    large = F.col("payload_bytes") >= LEAST_SHARED_BYTES
    keys = written(own.filter(large).select("page_id", "url", "payload_bytes", "payload_digest"), "keys")
    # a payload that many pages have is dealt out by their ids, and its shards meet as one row each
    dealt = keys.withColumn("shard", F.pmod(F.xxhash64("page_id"), F.lit(RANGE_SHARDS)))
    same = ["payload_digest", "payload_bytes"]
    part = dealt.groupBy(*same, "shard").agg(F.max("page_id").alias("leader"))
    leaders = part.groupBy(same).agg(F.max("leader").alias("leader"))
    revisits = dealt.join(part.select(*same, "shard").join(leaders, same), [*same, "shard"]).filter("page_id < leader").select("page_id", "url", F.lit(None).cast("string").alias("html"), "payload_bytes", "payload_digest", "leader")
    first = leaders.select(*same, F.col("leader").alias("page_id"))
    none = F.lit(None).cast("long").alias("leader")
    responses = own.filter(~large).unionByName(own.filter(large).join(first, [*same, "page_id"], "left_semi")).select("page_id", "url", "html", "payload_bytes", "payload_digest", none)
    rows = responses.unionByName(revisits)
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    longest = own.agg(F.max("payload_bytes").alias("n")).first()["n"] or 0
    at_least = 0
    for below, records in FILES:
        if longest >= at_least:
            some = rows if below is None or longest < below else rows.filter(F.col("payload_bytes") < below)
            some = some.filter(F.col("payload_bytes") >= at_least) if at_least else some
            members = some.select(_record(F.col("page_id"), F.col("leader")).cast("binary").alias("record")).mapInArrow(_members, "value binary")
            members.select(F.col("value").cast("string").alias("value")).write.mode("append").option("lineSep", "\0").option("maxRecordsPerFile", records).text(path)
        at_least = below
    discard(keys)
    return path


def stored(content: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """(offset, stored bytes, record) of every gzip member of an archive that is not empty."""
    at = 0
    while at < len(content):
        stream, record, start = zlib.decompressobj(31), [], at
        while not stream.eof:
            record.append(stream.decompress(content[at : at + 65536]))
            at += 65536
        at = min(at, len(content)) - len(stream.unused_data)
        if any(record):
            yield start, at - start, b"".join(record)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def url_key(url: str) -> str:
    """Host names from the top level down, then path and query; without scheme, ``www.``, fragment."""
    scheme, host, rest = re.match(r"([A-Za-z]+://)?(?:www\.)?([^/?#]*)([^#]*)", url).groups()
    return ",".join(reversed(host.lower().split("."))) + ")" + rest


def _page(urn: str) -> int:
    return int(urn.removeprefix("<urn:page:").removesuffix(">"))


def capture(run: str, offset: int, n_stored: int, record: bytes) -> tuple:
    """One row of the index."""
    headers, block = parse(record)
    head, _, payload = block.partition(b"\r\n\r\n")
    page = _page(headers["WARC-Record-ID"])
    key, time = url_key(headers["WARC-Target-URI"]), FIRST_CAPTURE + page % YEAR
    if headers["WARC-Type"] == "response":
        return key, time, page, run, offset, n_stored, len(payload), hashlib.sha1(payload).hexdigest(), "response", None
    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
    return key, time, page, run, offset, n_stored, size, headers["WARC-Payload-Digest"].removeprefix("sha1:"), "revisit", _page(headers["WARC-Refers-To"])


def read_runs(spark, path: str) -> DataFrame:
    """The captures of each archive, sorted within it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                run = name.as_py().rpartition("/")[2]
                rows = sorted(capture(run, *x) for x in stored(memoryview(content.as_buffer())))
                key, time, page, run_, offset, *rest = zip(*rows, strict=True) if rows else [()] * 10
                columns = [run_, range(len(rows)), key, time, page, offset, *rest]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], names=NAMES)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content").mapInArrow(read, INDEX_SCHEMA)


NAMES = [f.split()[0] for f in INDEX_SCHEMA.split(", ")]
TYPES = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[f.split()[1]] for f in INDEX_SCHEMA.split(", ")]


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so the next row costs one path."""

    def __init__(self, runs: list[Iterator]) -> None:
        self.runs = runs
        self.k = len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * max(1, self.k)
        self.winner = self._play(1) if self.k else -1

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        if not self._beats(a, b):
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator:
        while self.winner >= 0 and self.heads[self.winner] is not None:
            run = self.winner
            yield self.heads[run]
            self.heads[run] = next(self.runs[run], None)
            node = (run + self.k) // 2
            while node:
                if self._beats(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.winner = run


def merge_runs(index: DataFrame) -> DataFrame:
    """The index in one order of URL key, time and id, with each capture's place in it."""
    n_ranges = max(1, -(-index.count() // RANGE_ROWS))
    dealt = index.repartitionByRange(n_ranges, "url_key", "captured", "page_id").sortWithinPartitions("run", "seq").withColumn("part", F.spark_partition_id())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))  # one range: about RANGE_ROWS rows
        if not table.num_rows:
            return
        keys = list(zip(*(table.column(c).to_pylist() for c in ("url_key", "captured", "page_id")), range(table.num_rows), strict=True))
        runs = table.column("run").to_pylist()
        bounds = [0, *(i for i in range(1, len(runs)) if runs[i] != runs[i - 1]), len(runs)]
        order = [key[-1] for key in LoserTree([iter(keys[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])]
        table = table.take(pa.array(order)).append_column("place", pa.array(range(len(order)), pa.int64()))
        yield from table.combine_chunks().to_batches()

    merged = written(dealt.mapInArrow(merge, INDEX_SCHEMA + ", part int, place long"), "captures")
    sizes = merged.groupBy("part").count().collect()  # one row for each range
    offsets, at = [], 0
    for part, n in sorted((r["part"], r["count"]) for r in sizes):
        offsets.append((part, at))
        at += n
    offset = index.sparkSession.createDataFrame(offsets, "part int, before long")
    return merged.join(F.broadcast(offset), "part").withColumn("capture_order", F.col("before") + F.col("place")).drop("part", "before", "place", "seq")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes and reads back the archives of ``pages``: the merged index, a row per page."""
    path = write_archives(pages)
    index = merge_runs(written(read_runs(pages.sparkSession, path), "runs"))
    return index.withColumns({"page_id": given_id("page_id"), "refers_to": given_id("refers_to")})


ORACLE = """
with own as (select page_id, coalesce(url, '') as url, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
large as (select payload_digest, payload_bytes, max(page_id) as leader from own where payload_bytes >= 1000 group by all),
keyed as (
  select *, array_to_string(list_reverse(string_split(lower(regexp_extract(url, '^(?:[A-Za-z]+://)?(?:www\\.)?([^/?#]*)', 1)), '.')), ',') || ')'
    || regexp_extract(url, '^(?:[A-Za-z]+://)?(?:www\\.)?[^/?#]*([^#]*)', 1) as url_key
  from own)
select page_id, payload_bytes, payload_digest,
  case when page_id < leader then 'revisit' else 'response' end as record_type,
  case when page_id < leader then leader end as refers_to,
  url_key, row_number() over (order by url_key, 1704067200 + page_id % 31536000, page_id) - 1 as capture_order
from keyed left join large using (payload_digest, payload_bytes)
"""
