"""Small views of records: fields, children, details, slots, files, anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values

COMPUTED = ("_inherited", "_parent", "_variants", "totalSpools", "createdAt", "updatedAt")


def field_definitions(rows: DataFrame, extra: str = "extra") -> DataFrame:
    """Which keys the open map of a table holds, and how often."""
    return rows.select(F.explode(F.map_keys(extra)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def extra_value(extra: Column, key: str) -> Column:
    """A decoded value of the open map, null where the key is absent."""
    return values.decode(F.try_element_at(extra, F.lit(key)))


def cross_references(left_id: Column, right_id: Column, parent_id: Column) -> Column:
    """The three encoded keys that tie a record to the other side; absent ones are left out."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), values.encode(v.cast("string")).alias("value")) for k, v in (("left_id", left_id), ("right_id", right_id), ("right_parent_id", parent_id))))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def created_child(children: Column, label: Column, own_id: Column) -> Column:
    """Id of a child just created in an echoed parent: by label, else the last, else the parent's own."""
    named = F.filter(children, lambda c: c["label"] == label)
    return F.coalesce(F.get(named, F.lit(0))["id"], F.try_element_at(children, F.lit(-1))["id"], own_id)


def child_by_id(children: Column, id_: Column) -> Column:
    return F.get(F.filter(children, lambda c: c["id"] == id_), F.lit(0))


def without_computed(rows: DataFrame) -> DataFrame:
    """Rows without the columns that the other side computes."""
    return rows.drop(*COMPUTED)


def located(items: DataFrame, locations: DataFrame) -> DataFrame:
    """Items with the name of their location; an unknown id has none."""
    return items.join(locations.select(F.col("id").alias("location_id"), F.col("name").alias("location")), "location_id", "left")


def side_by_side(paired: DataFrame, fields: list[tuple[str, str, str]]) -> DataFrame:
    """One row per pair and field (name, left column, right column), and whether the sides agree."""
    rows = F.inline(F.array(*(F.struct(F.lit(n).alias("field"), F.col(a).cast("string").alias("left"), F.col(b).cast("string").alias("right")) for n, a, b in fields)))
    out = paired.select("left_item_id", "right_item_id", rows)
    return out.withColumn("agree", values.compare_form(F.col("left")) == values.compare_form(F.col("right")))


def item_detail(mapping: DataFrame, left: DataFrame, right: DataFrame, products: DataFrame, right_item_id: str) -> DataFrame:
    """Everything that is known of one right item."""
    row = mapping.filter(F.col("right_item_id") == right_item_id)
    a = left.select(F.col("id").alias("left_item_id"), "product_id", "remaining_weight", "location")
    b = right.select(F.col("id").alias("right_item_id"), "total_weight", "retired")
    p = products.select(F.col("id").alias("product_id"), "vendor", "name")
    return row.select("left_item_id", "right_item_id").join(a, "left_item_id", "left").join(b, "right_item_id", "left").join(p, "product_id", "left")


def slots(printers: DataFrame) -> DataFrame:
    """A row per slot of each printer, also for printers without one."""
    return printers.select("printer_id", F.explode_outer("slots").alias("slot")).select("printer_id", "slot.position", "slot.item_id")


def dry_cycles(items: DataFrame) -> DataFrame:
    """How often an item was dried, and when last."""
    return items.select("id", F.coalesce(F.size("cycles"), F.lit(0)).alias("n_cycles"), F.array_max(F.transform("cycles", lambda c: c["at"])).alias("last_dried"))


def label_fields(rows: DataFrame, columns: list[str], wanted: list[str]) -> DataFrame:
    """The wanted columns as text with null as '', unknown names skipped."""
    return rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in wanted if c in columns))


def files_kept(files: DataFrame, *by: str) -> DataFrame:
    """Number and bytes of retained files."""
    return files.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def file_time(name: Column, modified: Column) -> Column:
    """Time of a file: of the stamp in its name, else when it was modified."""
    stamp = F.regexp_extract(name, r"(\d{8}-\d{6})", 1)
    return F.coalesce(F.try_to_timestamp(stamp, F.lit("yyyyMMdd-HHmmss")), modified)


def anchors(snapshots: DataFrame) -> DataFrame:
    """Per entity: the earlier capture of the two sides, from which changes count, and the later one."""
    return snapshots.groupBy("entity_id").agg(F.min("captured_at").alias("anchor"), F.max("captured_at").alias("last_synced"))


def conflict_identity(conflicts: DataFrame, snapshots: DataFrame, blobs: DataFrame) -> DataFrame:
    """A name for every conflict: of the snapshot, else of the stored identity, else its id."""
    named = snapshots.filter("field = 'name'").select(F.col("entity_id").alias("left_id"), F.col("value").alias("_snapshot"))
    stored = blobs.select("left_id", F.from_json("identity", "name string").getField("name").alias("_stored"))
    rows = conflicts.select("id", F.col("left_id").cast("string").alias("left_id")).join(named, "left_id", "left").join(stored, "left_id", "left")
    return rows.select("id", "left_id", F.coalesce("_snapshot", "_stored", F.concat(F.lit("#"), F.col("left_id"))).alias("label"))


def merged_buckets(**buckets: DataFrame) -> DataFrame:
    """Several (id) frames as one with the bucket's name as status."""
    out = None
    for name, rows in buckets.items():
        part = rows.select(F.col("id").cast("string").alias("id"), F.lit(name).alias("status"))
        out = part if out is None else out.unionByName(part)
    return out


def failures_first(results: DataFrame) -> DataFrame:
    return results.orderBy(F.col("action") != "failed", "ord")


def unknown_last(rows: DataFrame, group: str) -> DataFrame:
    """Groups in alphabetic order, the unknown ones at the end."""
    return rows.orderBy(F.lower(group).startswith("unknown"), F.lower(group), "id")


IDENTITY = "vendor string, name string, color_hex string, material string"


def identity_of(blob: Column) -> Column:
    """A stored identity as a struct; null for plain text of older rows and for objects without a name."""
    parsed = F.from_json(blob, IDENTITY)
    return F.when(parsed["name"].isNotNull(), parsed)


def left_identity() -> Column:
    return F.to_json(F.struct("vendor", "name", "color_hex", "material"))


def right_identity() -> Column:
    return F.to_json(F.struct("vendor", "name", F.col("color").alias("color_hex"), F.col("type").alias("material")))


def identity_backfill(mapping: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Mappings with an identity where they had none: of the left product, else of the right one.  ``was`` is the old one."""
    a = left.select(F.col("id").alias("left_id"), left_identity().alias("_left"))
    b = right.select(F.col("id").alias("right_id"), right_identity().alias("_right"))
    rows = mapping.withColumnRenamed("identity", "was").join(a, "left_id", "left").join(b, "right_id", "left")
    return rows.withColumn("identity", F.coalesce("was", "_left", "_right")).drop("_left", "_right")


def identity_cleared(products: DataFrame, chosen: DataFrame, key: str = "right_id") -> DataFrame:
    """Products (left_id, extra): the chosen ones without their cross reference, and the right id that each had."""
    rows = products.join(chosen.select("left_id").distinct().withColumn("_chosen", F.lit(True)), "left_id", "left")
    had = extra_value(F.col("extra"), key)
    clear = F.coalesce("_chosen", F.lit(False)) & had.isNotNull()
    return rows.select("left_id", had.alias("cleared_right_id"), clear.alias("cleared"), F.when(clear, F.map_filter("extra", lambda k, v: k != key)).otherwise(F.col("extra")).alias("extra"))


def product_refs(left: DataFrame, items: DataFrame, right: DataFrame, uuid_key: str) -> DataFrame:
    """Short references of all products of both sides: left ones tagged or not, with active items and the source of the
    tare; right ones containers or not."""
    active = items.groupBy(F.col("product_id").alias("id")).agg(F.count_if(~F.col("archived")).alias("n_active"))
    tagged = F.coalesce(extra_value(F.col("extra"), uuid_key), F.lit("")) != ""
    source = F.when(F.col("spool_weight").isNull(), "needs_input").otherwise("left")
    a = left.join(active, "id", "left").select(F.lit("left").alias("side"), F.col("id").cast("string").alias("id"), "vendor", "name", tagged.alias("flag"), F.coalesce("n_active", F.lit(0)).alias("n_active"), source.alias("tare_source"))
    parents = right.filter("parent_id <> id").select(F.col("parent_id").alias("id"), F.lit(True).alias("_has")).distinct()
    b = right.join(parents, "id", "left").select(F.lit("right").alias("side"), "id", "vendor", "name", F.coalesce("_has", F.lit(False)).alias("flag"), F.lit(None).cast("long").alias("n_active"), F.lit(None).cast("string").alias("tare_source"))
    return a.unionByName(b)
