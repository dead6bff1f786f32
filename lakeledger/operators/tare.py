"""Weights of empty spools and other defaults of a family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import matching

LARGEST_TARE = 100_000.0


def tare_rows(right: DataFrame, suffix: str = " marker") -> DataFrame:
    """Each right product with its role, effective tare and status, to be shown family by family.

    ``set`` when the own tare is there and equal to the family's, ``mismatch`` when it is another,
    ``missing`` without one.
    """
    rows = right.join(matching.family_tare(right).select("id", "family_tare"), "id")
    children = right.filter("parent_id is not null and parent_id <> id").select(F.col("parent_id").alias("id"), F.lit(True).alias("_has")).distinct()
    rows = rows.join(children, "id", "left")
    role = F.when(F.col("_has") | F.col("name").endswith(suffix), "master").when(F.col("parent_id").isNotNull(), "variant").otherwise("standalone")
    status = F.when(F.coalesce("tare", "family_tare").isNull(), "missing").when(F.col("tare").isNotNull() & F.col("family_tare").isNotNull() & (F.col("tare") != F.col("family_tare")), "mismatch").when(F.col("tare").isNull(), "missing").otherwise("set")
    return rows.select("id", F.coalesce("parent_id", "id").alias("family"), role.alias("role"), "tare", "family_tare", status.alias("status"))


def in_display_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("family", F.col("role") != "master", "id")


def tare_changes(requests: DataFrame) -> DataFrame:
    """Requested tares with their validity: good and bad rows stay apart, a bad one fails alone."""
    ok = F.col("tare").isNotNull() & (F.col("tare") >= 0) & (F.col("tare") <= LARGEST_TARE)
    return requests.select("id", F.round("tare", 2).alias("tare"), F.coalesce(ok, F.lit(False)).alias("valid"))


def filled_from_family(right: DataFrame) -> DataFrame:
    """Products without a tare, with the family's: only nulls are filled."""
    return matching.family_tare(right).filter("tare is null and family_tare is not null").select("id", F.col("family_tare").alias("tare"))


def left_tare(products: DataFrame, items: DataFrame, families: DataFrame, overrides: DataFrame) -> DataFrame:
    """Tare ladder of a left product: override and item tare by the lowest item id, product, family."""
    by_item = items.filter("spool_weight is not null").groupBy("product_id").agg(F.min_by("spool_weight", "id").alias("item_tare"))
    by_hand = overrides.filter("tare is not null").groupBy("product_id").agg(F.min_by("tare", "item_id").alias("override"))
    rows = products.select("id", F.col("spool_weight").alias("own")).join(by_item.withColumnRenamed("product_id", "id"), "id", "left").join(by_hand.withColumnRenamed("product_id", "id"), "id", "left").join(families, "id", "left")
    source = F.when(F.col("override").isNotNull(), "override").when(F.col("item_tare").isNotNull(), "item").when(F.col("own").isNotNull(), "product").when(F.col("family_tare").isNotNull(), "family").otherwise("none")
    return rows.select("id", F.coalesce("override", "item_tare", "own", "family_tare").alias("tare"), source.alias("source"))


def effective_cost(products: DataFrame, items: DataFrame) -> DataFrame:
    """First item price by id, else the product's."""
    first = items.filter("price is not null").groupBy("product_id").agg(F.min_by("price", "id").alias("item_price"))
    return products.join(first, products["id"] == first["product_id"], "left").select("id", F.coalesce("item_price", "price").alias("cost"))


def nominal_weight(right: DataFrame, items: DataFrame) -> DataFrame:
    """Net weight for a new left product: the nominal one or the largest positive gross less tare."""
    most = items.join(right.select(F.col("id").alias("product_id"), "tare"), "product_id").withColumn("net", F.col("total_weight") - F.coalesce("tare", F.lit(200.0))).filter("net > 0").groupBy("product_id").agg(F.max("net").alias("net"))
    return right.join(most, right["id"] == most["product_id"], "left").select("id", F.round(F.greatest(F.col("nominal"), F.col("net")), 2).alias("weight"))


def shared_finishes(members: DataFrame) -> DataFrame:
    """Per cluster the finish ids that all its members have."""
    sizes = members.groupBy("cluster").agg(F.count_distinct("id").alias("n"))
    each = members.select("cluster", "id", F.explode("finishes").alias("finish")).groupBy("cluster", "finish").agg(F.count_distinct("id").alias("n_with"))
    return each.join(sizes, "cluster").filter("n = n_with").groupBy("cluster").agg(F.sort_array(F.collect_list("finish")).alias("finishes"))
