"""Exact matching of two catalogs, families and stale mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

KEY = ["vendor", "name", "color"]


def keyed(products: DataFrame, id_: str, vendor: str, name: str, color: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """(id, vendor, name, color) in normal form, of names in Unicode NFKC."""
    products = text.composed(products.select(*dict.fromkeys((id_, vendor, name, color))), *dict.fromkeys((vendor, name)))
    return products.select(F.col(id_).alias("id"), text.vendor_key(F.col(vendor), aliases).alias("vendor"), text.name_key(F.col(name)).alias("name"), text.color_key(F.col(color)).alias("color"))


def match(left: DataFrame, right: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(left_id, right_id, bucket): every product of both sides in one row.

    ``left`` and ``right`` are keyed; ``known`` (left_id, right_id) are cross references, which go
    first, the smallest left id winning a right one.  Then a key that has one right product is
    matched to its first left one; several are ambiguous and consume nothing; right products that
    no row used are unmatched.
    """
    linked = left.sparkSession.createDataFrame([], "left_id long, right_id string") if known is None else known
    real = linked.join(left.select(F.col("id").alias("left_id")), "left_id", "left_semi").join(right.select(F.col("id").alias("right_id")), "right_id", "left_semi")
    per_left = Window.partitionBy("left_id").orderBy("right_id")
    per_right = Window.partitionBy("right_id").orderBy("left_id")
    real = real.withColumn("n", F.row_number().over(per_left)).filter("n = 1").withColumn("n", F.row_number().over(per_right)).filter("n = 1").select("left_id", "right_id")

    free_left = left.join(real, left["id"] == real["left_id"], "left_anti")
    free_right = right.join(real, right["id"] == real["right_id"], "left_anti")
    # a key may hold a large share of the rows: both sides are summed up before they meet
    offers = free_right.groupBy(*KEY).agg(F.count("*").alias("n_right"), F.min("id").alias("right_id"))
    firsts = free_left.groupBy(*KEY).agg(F.min("id").alias("first_left"))
    rows = free_left.join(offers, KEY, "left").join(firsts, KEY)
    unique = F.col("n_right") == 1
    bucket = F.when(F.col("n_right") > 1, "ambiguous").when(unique & (F.col("id") == F.col("first_left")), "matched").otherwise("unmatched_left")
    by_key = rows.select(F.col("id").alias("left_id"), F.when(bucket == "matched", F.col("right_id")).alias("right_id"), bucket.alias("bucket"))
    # of the right side, keys that any free left product has are matched (one) or ambiguous (several)
    rest = free_right.join(firsts, KEY, "left_anti").select(F.lit(None).cast("long").alias("left_id"), F.col("id").alias("right_id"), F.lit("unmatched_right").alias("bucket"))
    return real.withColumn("bucket", F.lit("matched")).unionByName(by_key).unionByName(rest)


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_ids) of ambiguous keys: each key's right ids once, not once per left row's pair."""
    offers = right.groupBy(*KEY).agg(F.sort_array(F.collect_list("id")).alias("right_ids")).filter(F.size("right_ids") > 1)
    return left.join(offers, KEY).select(F.col("id").alias("left_id"), "right_ids")


def first_reference(items: DataFrame, product: str, value: str, order: str) -> DataFrame:
    """First non-empty value per product in item order."""
    return items.filter(F.coalesce(value, F.lit("")) != "").groupBy(product).agg(F.min_by(value, order).alias(value))


def attach_to_families(left: DataFrame, parents: DataFrame) -> DataFrame:
    """(left_id, right_id): left products whose cluster key is that of a right parent, the smallest id first."""
    first = parents.groupBy("cluster").agg(F.min("id").alias("right_id"))
    return left.select(F.col("id").alias("left_id"), "cluster").join(first, "cluster").select("left_id", "right_id")


def mode_of(value: Column, order: str = "value") -> Column:
    """The most frequent non-null value, of equally frequent ones the smallest."""
    return F.mode(value, True)


def family_tare(right: DataFrame) -> DataFrame:
    """(id, tare, family_tare): a product's own tare, else its parent's, else the mode among its siblings."""
    parents = right.select(F.col("id").alias("family"), F.col("tare").alias("parent_tare"))
    children = right.filter("parent_id is not null").groupBy(F.col("parent_id").alias("family")).agg(mode_of(F.col("tare")).alias("child_tare"))
    rows = right.withColumn("family", F.coalesce("parent_id", "id")).join(parents, "family", "left").join(children, "family", "left")
    return rows.select("id", "tare", F.coalesce("parent_tare", "child_tare").alias("family_tare"))


def effective(right: DataFrame, columns: list[str]) -> DataFrame:
    """Products with their parents' values where their own are null, and which columns were inherited."""
    parents = right.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"), *(F.col(c).alias(f"parent_{c}") for c in columns))
    rows = right.join(parents, "parent_id", "left")
    inherited = F.filter(F.array(*(F.when(F.col(c).isNull() & F.col(f"parent_{c}").isNotNull(), F.lit(c)) for c in columns)), lambda c: c.isNotNull())
    return rows.select("id", "parent_id", "parent_name", *(F.coalesce(c, f"parent_{c}").alias(c) for c in columns), inherited.alias("inherited"))


def is_master(name: Column, has_variants: Column, suffix: str, synthetic: Column) -> Column:
    return synthetic | has_variants | name.endswith(suffix)


def clusters(products: DataFrame, items: DataFrame, least: int = 2) -> DataFrame:
    """Clusters of (vendor, material, finish): size, master and members.

    The master has the most active items, then the shortest name, then the smallest id.
    """
    active = items.groupBy("product_id").agg(F.count_if(~F.col("archived")).alias("n_active"))
    rows = products.join(active, products["id"] == active["product_id"], "left").withColumn("n_active", F.coalesce("n_active", F.lit(0)))
    order = F.struct(-F.col("n_active"), F.char_length("name"), F.col("id"))
    return rows.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_active").alias("n_active"), F.min_by("id", order).alias("master_id")).filter(F.col("n") >= least)


def stale_products(mapping: DataFrame, left: DataFrame) -> DataFrame:
    """Mappings whose left product is gone; ids are reused, so this goes before any other step."""
    return mapping.join(left.select(F.col("id").alias("left_id")), "left_id", "left_anti")


def orphaned_products(mapping: DataFrame, right: DataFrame, used: DataFrame) -> DataFrame:
    """Mappings without a right product and without an item."""
    return mapping.join(right.select(F.col("id").alias("right_id")), "right_id", "left_anti").join(used.select("left_id"), "left_id", "left_anti")


def adopt_orphans(left_items: DataFrame, right_items: DataFrame, mapping: DataFrame) -> DataFrame:
    """Unmapped left items whose cross reference is a live, unclaimed right item; the smallest left id gets it."""
    free = left_items.join(mapping.select(F.col("left_item_id").alias("id")), "id", "left_anti")
    open_ = right_items.select(F.col("id").alias("xref")).join(mapping.select(F.col("right_item_id").alias("xref")), "xref", "left_anti")
    claims = free.join(open_, "xref").groupBy("xref").agg(F.min("id").alias("left_item_id"), F.count("*").alias("n_claims"))
    return claims.select("left_item_id", F.col("xref").alias("right_item_id"), (F.col("n_claims") > 1).alias("contested"))


def name_collisions(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """Planned (id, vendor, name) that meet an existing product or one another, and how."""
    key = [text.vendor_key(F.col("vendor")).alias("v"), text.name_key(F.col("name")).alias("k")]
    mine = planned.select("id", *key)
    batch = mine.groupBy("v", "k").agg(F.count("*").alias("n_batch"))
    there = existing.select(*key).groupBy("v", "k").agg(F.count("*").alias("n_there"))
    rows = mine.join(batch, ["v", "k"]).join(there, ["v", "k"], "left").withColumn("n_there", F.coalesce("n_there", F.lit(0)))
    return rows.filter("n_batch > 1 or n_there > 0").select("id", "n_batch", "n_there")


def find_by_name(wanted: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id) by vendor and name: of several the one under the expected parent, then one without parent, then the first."""
    there = right.select(F.col("id").alias("right_id"), "parent_id", text.vendor_key(F.col("vendor")).alias("v"), text.name_key(F.col("name")).alias("k"))
    mine = wanted.select(F.col("id").alias("left_id"), "expected_parent", text.vendor_key(F.col("vendor")).alias("v"), text.name_key(F.col("name")).alias("k"))
    # a name may have many products on both sides: the right ones are summed up before they meet, so each left one meets at most one row of each kind
    under = there.groupBy("v", "k", "parent_id").agg(F.min("right_id").alias("under"))
    firsts = under.groupBy("v", "k").agg(F.min(F.when(F.col("parent_id").isNull(), F.col("under"))).alias("free"), F.min("under").alias("first"))
    here = [F.col(f"m.{c}") == F.col(f"u.{c}") for c in ("v", "k")]
    rows = mine.alias("m").join(under.alias("u"), [*here, F.col("expected_parent").eqNullSafe(F.col("parent_id"))], "left").select("left_id", "m.v", "m.k", "under").join(firsts, ["v", "k"])
    found = F.coalesce("under", "free", "first")
    order = F.struct(F.col("under").isNull(), F.col("free").isNull(), found)
    return rows.groupBy("left_id").agg(F.min_by(found, order).alias("right_id"))


def missing_dimension(names: DataFrame, dimension: DataFrame) -> DataFrame:
    """Distinct non-empty names that the dimension lacks, to be appended to it."""
    return names.filter(F.coalesce("name", F.lit("")) != "").select("name").distinct().join(dimension.select("name"), "name", "left_anti")
