"""Read models over catalogs, mappings, conflicts and the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import conflicts, matching


def totals(products: DataFrame, items: DataFrame, product: str, weight: str, archived: str) -> DataFrame:
    """Items, active items and weight per product; the weight is null only if all are."""
    sums = items.groupBy(product).agg(F.count("*").alias("n_items"), F.count_if(~F.col(archived)).alias("n_active"), F.round(F.sum(weight), 2).alias("weight"))
    rows = products.select("id").join(sums.withColumnRenamed(product, "id"), "id", "left")
    return rows.select("id", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("n_active", F.lit(0)).alias("n_active"), "weight")


def reconcile(left: DataFrame, right: DataFrame, items: DataFrame, known: DataFrame | None = None, masters: DataFrame | None = None) -> DataFrame:
    """Every product of both sides with its bucket and its items; masters do not count as right-only."""
    rows = matching.match(matching.keyed(left, "id", "vendor", "name", "color_hex"), matching.keyed(right, "id", "vendor", "name", "color"), known)
    if masters is not None:
        gone = masters.select(F.col("id").alias("right_id"), F.lit("unmatched_right").alias("bucket"))
        rows = rows.join(gone, ["right_id", "bucket"], "left_anti")
    sums = totals(left, items, "product_id", "remaining_weight", "archived").withColumnRenamed("id", "left_id")
    return rows.select("left_id", "right_id", "bucket").join(sums, "left_id", "left")


def summary(report: DataFrame) -> DataFrame:
    return report.groupBy("bucket").agg(F.count("*").alias("n_products"), F.coalesce(F.sum("n_items"), F.lit(0)).alias("n_items"))


def item_status(mapping: DataFrame, items: DataFrame, open_conflicts: DataFrame, pending: DataFrame) -> DataFrame:
    """conflict > unlinked > pending > in_sync; only item-level conflicts count."""
    first = conflicts.first_open(open_conflicts).filter("entity_type = 'item'").select(F.col("left_id").alias("id"), "conflict_id")
    linked = mapping.select(F.col("left_item_id").alias("id"), "right_item_id")
    waiting = pending.select(F.col("id"), F.lit(True).alias("_pending"))
    rows = items.select("id", "product_id", "remaining_weight").join(linked, "id", "left").join(first, "id", "left").join(waiting, "id", "left")
    status = F.when(F.col("conflict_id").isNotNull(), "conflict").when(F.col("right_item_id").isNull(), "unlinked").when(F.col("_pending"), "pending").otherwise("in_sync")
    return rows.select("id", "product_id", "right_item_id", "conflict_id", status.alias("status"))


def synced_records(status: DataFrame, products: DataFrame, product_mapping: DataFrame) -> DataFrame:
    """Item rows and, for mapped products without an item, product rows."""
    names = products.select(F.col("id").alias("product_id"), "vendor", "name")
    rows = status.join(names, "product_id", "left").select(F.lit("item").alias("kind"), "id", "product_id", "vendor", "name", "status")
    bare = product_mapping.select(F.col("left_id").alias("product_id")).join(status.select("product_id"), "product_id", "left_anti").join(names, "product_id")
    return rows.unionByName(bare.select(F.lit("product").alias("kind"), F.col("product_id").alias("id"), "product_id", "vendor", "name", F.lit("in_sync").alias("status")))


def product_status(product_mapping: DataFrame, open_conflicts: DataFrame, pending: DataFrame) -> DataFrame:
    """conflict > pending > in_sync of each mapped product."""
    asked = conflicts.open_ones(open_conflicts).filter("entity_type = 'product'").select("left_id").distinct().withColumn("_c", F.lit(True))
    waiting = pending.select(F.col("id").alias("left_id"), F.lit(True).alias("_p"))
    status = F.when(F.col("_c"), "conflict").when(F.col("_p"), "pending").otherwise("in_sync")
    return product_mapping.join(asked, "left_id", "left").join(waiting, "left_id", "left").select("left_id", "right_id", status.alias("status"))


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def recent_cycles(log: DataFrame, n: int) -> DataFrame:
    """Log rows of the last ``n`` cycles (a top-k report)."""
    last = log.groupBy("cycle_id").agg(F.max("logged_at").alias("ended")).orderBy(F.col("ended").desc(), F.col("cycle_id").desc()).limit(n)
    return log.join(F.broadcast(last.select("cycle_id")), "cycle_id", "left_semi")


def log_page(log: DataFrame, offset: int, size: int, **equal: str) -> DataFrame:
    """One page of the log, the newest first, optionally of one entity type, action or direction."""
    for column, value in equal.items():
        log = log.filter(F.col(column) == value)
    return log.orderBy(F.col("logged_at").desc(), F.col("id").desc()).offset(offset).limit(size)


def cycle_summary(log: DataFrame) -> DataFrame:
    """Per cycle and entity: actions by kind, time span."""
    return log.groupBy("cycle_id", "entity_type").agg(F.count("*").alias("n"), F.count_distinct("action").alias("n_actions"), F.min("logged_at").alias("started"), F.max("logged_at").alias("ended"))


def labelled(log: DataFrame, mapping: DataFrame, left: DataFrame) -> DataFrame:
    """Log rows with a name: of the mapped product, else of the live one, else the id."""
    by_map = mapping.join(left.select(F.col("id").alias("left_id"), F.concat_ws(" ", "vendor", "name").alias("_mapped")), "left_id").select("left_id", "_mapped")
    live = left.select(F.col("id").alias("left_id"), F.col("name").alias("_live"))
    rows = log.join(by_map, "left_id", "left").join(live, "left_id", "left")
    return rows.select("id", "entity_type", "left_id", F.coalesce("_mapped", "_live", F.concat(F.lit("#"), F.col("left_id").cast("string"))).alias("label"))


def search_items(items: DataFrame, products: DataFrame, text: str, limit: int = 200) -> DataFrame:
    """Items whose id, name, vendor or color holds the text (a report of at most 200 rows)."""
    rows = items.select(F.col("id").alias("item_id"), "product_id").join(products.select(F.col("id").alias("product_id"), "vendor", "name", "color_hex"), "product_id")
    hit = lambda c: F.contains(F.lower(F.coalesce(c.cast("string"), F.lit(""))), F.lit(text.lower()))
    found = rows.filter(hit(F.col("item_id")) | hit(F.col("name")) | hit(F.col("vendor")) | hit(F.col("color_hex")))
    return found.orderBy("item_id").limit(limit)


def health(left: DataFrame, right: DataFrame, items: DataFrame) -> DataFrame:
    """One row of counts."""
    counts = lambda df, name, *more: df.agg(F.count("*").alias(name), *more)
    one = counts(left, "n_left").crossJoin(counts(right, "n_right", F.count_if(F.col("parent_id").isNull()).alias("n_masters")))  # single rows
    return one.crossJoin(counts(items, "n_items", F.count_if(~F.col("archived")).alias("n_active")))


def locations(*sides: DataFrame) -> DataFrame:
    """Distinct non-empty location names of all sides."""
    out = None
    for side in sides:
        names = side.filter(F.coalesce("location", F.lit("")) != "").select(F.trim("location").alias("location"))
        out = names if out is None else out.union(names)
    return out.distinct()


def content_digest(rows: DataFrame, columns: list[str], buckets: int = 4096) -> DataFrame:
    """One order-independent SHA-256 over all rows.

    Rows are hashed, and the hashes of a bucket are summed as numbers, which needs no list of a
    bucket's rows in one place; the digest is over the sums in bucket order.
    """
    line = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns))
    hashed = rows.select(F.sha2(line, 256).alias("h")).select(F.conv(F.substr("h", F.lit(1), F.lit(3)), 16, 10).cast("int").alias("b"), *(F.conv(F.substr("h", F.lit(4 + 12 * k), F.lit(12)), 16, 10).cast("decimal(38,0)").alias(f"s{k}") for k in range(4)))
    sums = hashed.groupBy((F.col("b") % buckets).alias("b")).agg(F.count("*").alias("n"), *(F.sum(f"s{k}").alias(f"s{k}") for k in range(4)))
    text = F.concat_ws(":", "b", "n", *(F.col(f"s{k}").cast("string") for k in range(4)))
    return sums.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(text)), "\n"), 256).alias("digest"))  # at most ``buckets`` rows


def ordered(rows: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Sorted case-insensitively with missing values last either way."""
    key: Column = F.lower(F.col(column).cast("string"))
    return rows.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "id")


def newest_conflicts(queue: DataFrame, n: int) -> DataFrame:
    """The newest open conflicts (a page)."""
    return conflicts.open_ones(queue).orderBy(F.col("detected_at").desc(), F.col("id").desc()).limit(n)


def by_cycle(log: DataFrame) -> DataFrame:
    """A row per cycle: its rows, their first and last ids (cycles are shown by the first), and the kinds of action."""
    return log.groupBy("cycle_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.array_join(F.array_sort(F.collect_set("action")), ",").alias("actions"))


def page(sorted_rows: DataFrame, size: int) -> DataFrame:
    """The first ``size`` of sorted rows with their places from 1 (a report)."""
    return sorted_rows.limit(size).withColumn("place", (F.monotonically_increasing_id() + 1).cast("long"))


def dry_run(planned: DataFrame, updates: DataFrame, queue: DataFrame, mapped: DataFrame) -> DataFrame:
    """(source, id, kind) of all that a run would do; conflicts over new records that are mapped by now are false ones."""
    created = planned.filter("action = 'create'").select(F.lit("create").alias("source"), F.col("left_id").alias("id"), F.lit("product").alias("kind")).distinct()
    asked = conflicts.open_ones(queue).select("left_id", "conflict_type")
    settled = mapped.select("left_id").withColumn("conflict_type", F.lit("new_record"))
    real = asked.join(settled, ["left_id", "conflict_type"], "left_anti").select(F.lit("conflict").alias("source"), F.col("left_id").alias("id"), F.col("conflict_type").alias("kind")).distinct()
    return created.unionByName(updates.select(F.lit("update").alias("source"), "id", "kind")).unionByName(real)


def sync_state(items: DataFrame, item_mapping: DataFrame, product_mapping: DataFrame, queue: DataFrame) -> DataFrame:
    """One row: linked and unlinked items, mapped products, open conflicts and the newest of them."""
    linked = item_mapping.select(F.col("left_item_id").alias("id"), F.lit(True).alias("linked"))
    n = items.join(linked, "id", "left").agg(F.count("linked").alias("n_linked"), F.count_if(F.col("linked").isNull()).alias("n_unlinked"))
    n = n.crossJoin(product_mapping.agg(F.count("*").alias("n_products")))  # single rows
    return n.crossJoin(conflicts.open_ones(queue).agg(F.count("*").alias("n_open"), F.max("detected_at").cast("timestamp").alias("newest")))


def filtered(rows: DataFrame, text: str = "", text_in: tuple[str, ...] = (), hide_empty: bool = False, **values: tuple[str, ...]) -> DataFrame:
    """Rows with one of the given values in each named column, the text in one of its columns, and, if wanted, not empty."""
    for column, allowed in values.items():
        rows = rows.filter(F.col(column).isin(*allowed))
    if hide_empty:
        rows = rows.filter(~F.col("empty"))
    if text and text_in:
        hits = [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(text.lower())) for c in text_in]
        rows = rows.filter(F.greatest(*(h.cast("int") for h in hits)) == 1) if len(hits) > 1 else rows.filter(hits[0])
    return rows


def by_completeness(rows: DataFrame) -> DataFrame:
    """Stale rows first, then those that miss most, then by brand."""
    return rows.orderBy(F.col("stale").desc(), F.col("n_missing").desc(), F.lower("brand"), "id")
