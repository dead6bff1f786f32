"""Families of variants: masters, differing properties, suggestions, divergences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, values
from . import matching


def with_masters(products: DataFrame, items: DataFrame) -> DataFrame:
    """Products (id, vendor, material, name, cluster, ...) with ``n`` members of their cluster and its ``master_id``."""
    return products.join(matching.clusters(products, items, 1).select("cluster", "n", "master_id"), "cluster")


def _against_master(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Members of families of two or more beside their master's values (``_field``)."""
    masters = rows.filter("id = master_id").select("master_id", *(F.col(f).alias(f"_{f}") for f in fields))
    return rows.filter("n >= 2").join(masters, "master_id")


def _differing(fields: tuple[str, ...]) -> Column:
    """The fields in which a member differs; a null against a value does, two nulls do not."""
    each = F.array(*(F.when(values.differ(F.col(f), F.col(f"_{f}")), F.struct(F.lit(f).alias("field"), F.col(f"_{f}").cast("string").alias("master_value"), F.col(f).cast("string").alias("member_value"))) for f in fields))
    return F.filter(each, lambda x: x.isNotNull())


def property_conflicts(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(id, master_id, field, master_value, member_value) for every property of a member that is not its master's."""
    return _against_master(rows, fields).filter("id <> master_id").select("id", "master_id", F.inline(_differing(fields)))


def suggestions(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Members of every family that may be formed, and in how many properties each differs from its master."""
    masters = rows.filter("id = master_id").select("master_id", F.col("vendor").alias("vendor_name"), F.col("material").alias("material_name"))
    out = _against_master(rows, fields).withColumn("n_conflicts", F.size(_differing(fields)))
    return out.join(masters, "master_id").withColumn("is_master", F.col("id") == F.col("master_id"))


def right_suggestions(right: DataFrame) -> DataFrame:
    """Right products (id, vendor, name, type, color_word) of one vendor, type and name but for the color; the shortest name is the parent."""
    keyed = right.select("id", text.vendor_key(F.col("vendor")).alias("vendor"), text.minus_color(F.col("name"), F.col("color_word")).alias("base_name"), F.coalesce("type", F.lit("")).alias("type"), F.char_length("name").alias("_length"))
    key = ["vendor", "base_name", "type"]
    groups = keyed.groupBy(*key).agg(F.count("*").alias("n"), F.min_by("id", F.struct("_length", "id")).alias("parent_id")).filter("n >= 2")
    return keyed.join(groups, key).select(*key, "id", "parent_id", (F.col("id") == F.col("parent_id")).alias("is_parent"), "n")


def variances(rows: DataFrame, right: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Every cluster once: size, master, right parent, whether it is a group, members that differ, and where the tare comes from."""
    parents = right.filter("parent_id is null or parent_id = id").groupBy("cluster").agg(F.min("id").alias("right_parent"))
    masters = rows.filter("id = master_id").select("master_id", *(F.col(f).alias(f"_{f}") for f in fields))
    differs = (F.col("id") != F.col("master_id")) & (F.size(_differing(fields)) > 0)
    out = rows.join(masters, "master_id").groupBy("cluster", "n", "master_id").agg(F.count_if(F.col("tare").isNull()).alias("n_without"), F.count_if(differs).alias("n_differing")).join(parents, "cluster", "left")
    return out.withColumns({"grouped": (F.col("n") >= 2) | F.col("right_parent").isNotNull(), "tare_source": F.when(F.col("n_without") > 0, "needs_input").otherwise("left")})


def divergences(right: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Variants whose ``column`` is not the master's: the size of the line, both values, the left product that is mapped."""
    line = right.select(F.col("id").alias("variant_id"), F.coalesce("parent_id", "id").alias("master_id"), F.col(column).alias("value"))
    sizes = line.groupBy("master_id").agg(F.count("*").alias("n_line"))
    masters = right.select(F.col("id").alias("master_id"), F.col(column).alias("master_value"))
    known = mapping.groupBy(F.col("right_id").alias("variant_id")).agg(F.min("left_id").alias("left_id"))
    rows = line.filter("variant_id <> master_id").join(sizes, "master_id").join(masters, "master_id", "left").join(known, "variant_id", "left")
    return rows.filter(values.differ(F.col("value"), F.col("master_value"))).select("variant_id", "master_id", "n_line", "value", "master_value", "left_id")


def suggested(products: DataFrame, vendor: str, base_name: str, color: str, limit: int) -> DataFrame:
    """The best products for a record that has only these (a top-k report): half credit for a color that is not known."""
    score = (
        F.when(text.vendor_key(F.col("vendor")) == text.vendor_key(F.lit(vendor)), 0.5).otherwise(0.0)
        + F.when(F.contains(text.name_key(F.col("name")), text.name_key(F.lit(base_name))), 0.3).otherwise(0.0)
        + F.when(text.color_key(F.col("color_hex")) == text.color_key(F.lit(color)), 0.2).when(F.coalesce("color_hex", F.lit("")) == "", 0.1).otherwise(0.0)
    )
    best = products.select("id", "name", F.round(score, 2).alias("score")).filter("score > 0").orderBy(F.col("score").desc(), "name", "id").limit(limit)
    return best.select("id", "score", (F.monotonically_increasing_id() + 1).alias("place"))
