"""The import plan.  ``plan`` decides; the preview and whatever applies it read the same frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color, text, units
from ..operators import matching
from ..options import DEFAULT_DENSITY, DEFAULT_DIAMETER


def plan(products: DataFrame, items: DataFrame, right: DataFrame, decisions: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row per left product and active item of it: what is done to either.

    Decisions (left_id, action, right_id) win; a mapped product is linked; else one that matches
    exactly is linked and the rest created.  Empty items are not imported, and a product without
    an item to import is dropped.
    """
    a = matching.keyed(products, "id", "vendor", "name", "color_hex")
    b = matching.keyed(right, "id", "vendor", "name", "color")
    found = matching.match(a, b, mapping.select("left_id", "right_id")).filter("bucket = 'matched'").select("left_id", F.col("right_id").alias("match_id"))
    chosen = decisions.select("left_id", F.col("action").alias("_action"), F.col("right_id").alias("_right"))
    rows = products.select(F.col("id").alias("left_id"), "vendor", "name", "material", "color_hex", F.col("spool_weight").alias("tare")).join(chosen, "left_id", "left").join(found, "left_id", "left")
    target = F.coalesce("_right", "match_id")
    act = F.coalesce(F.col("_action"), F.when(target.isNotNull(), "link").otherwise("create"))
    rows = rows.withColumn("action", act).withColumn("right_id", F.when(F.col("action") == "link", target)).drop("_action", "_right", "match_id").filter("action <> 'skip'")
    live = items.filter(~F.col("archived")).select(F.col("id").alias("item_id"), F.col("product_id").alias("left_id"), "remaining_weight")
    live = live.filter(F.coalesce("remaining_weight", F.lit(0.0)) > 0)
    return rows.join(live, "left_id").withColumn("seq", F.when(F.col("action") == "create", 1).otherwise(2))


def product_rows(planned: DataFrame) -> DataFrame:
    """The plan's products once each, with display names and payloads' values."""
    rows = planned.groupBy("left_id").agg(*(F.first(c).alias(c) for c in ("action", "right_id", "vendor", "name", "material", "color_hex", "tare")), F.count("*").alias("n_items"), F.round(F.sum("remaining_weight"), 2).alias("weight"))
    return rows.withColumn("display_name", text.display_name(F.col("vendor"), F.col("material"), F.col("name")))


def preview(planned: DataFrame) -> DataFrame:
    """Counts that a user sees before anything is written."""
    rows = product_rows(planned)
    return rows.groupBy("action").agg(F.count("*").alias("n_products"), F.sum("n_items").alias("n_items"), F.count_if(F.col("tare").isNull()).alias("n_default_tare"), F.round(F.sum("weight"), 2).alias("weight"))


def blocked_by_tare(planned: DataFrame) -> DataFrame:
    """Products to create without a tare: an execution is refused while there are any."""
    return product_rows(planned).filter("action = 'create' and tare is null").select("left_id", "display_name")


def collisions(planned: DataFrame, right: DataFrame) -> DataFrame:
    """Planned creations whose name is taken, by an existing product or one another."""
    wanted = product_rows(planned).filter("action = 'create'").select(F.col("left_id").alias("id"), "vendor", F.col("display_name").alias("name"))
    return matching.name_collisions(wanted, right)


def item_weights(planned: DataFrame) -> DataFrame:
    """Gross weight of every planned item, and whether its tare was assumed."""
    return planned.select("item_id", F.col("remaining_weight").alias("net"), units.net_to_gross(F.col("remaining_weight"), F.col("tare")).alias("gross"), units.tare_assumed(F.col("tare")).alias("assumed"))


def right_payload(products: DataFrame) -> DataFrame:
    """New right products as JSON; nulls are left out."""
    body = F.struct(text.name_key(F.col("name")).alias("name"), "vendor", F.col("material").alias("type"), color.to_right(F.col("color_hex")).alias("color"), units.as_amount(F.col("price")).alias("cost"), units.as_amount(F.col("spool_weight")).alias("spoolWeight"))
    return products.select("id", F.to_json(body).alias("payload"))


def left_payload(right: DataFrame) -> DataFrame:
    """New left products, with the defaults that the left catalog asks for."""
    return right.select("id", F.trim("name").alias("name"), "vendor", F.col("type").alias("material"), F.coalesce("density", F.lit(DEFAULT_DENSITY)).alias("density"), F.coalesce("diameter", F.lit(DEFAULT_DIAMETER)).alias("diameter"), color.to_left(F.col("color")).alias("color_hex"), F.col("tare").alias("spool_weight"))


def scope(planned: DataFrame, left_id: int) -> DataFrame:
    """The plan of one product."""
    return planned.filter(F.col("left_id") == left_id)


def execution(planned: DataFrame) -> DataFrame:
    """Ordered actions: products before items, creations before links; applying them is the caller's."""
    rows = product_rows(planned)
    first = rows.select(F.when(F.col("action") == "create", 1).otherwise(2).alias("seq"), F.lit("product").alias("entity"), F.col("left_id").alias("id"), "action")
    return first.unionByName(planned.select(F.lit(3).alias("seq"), F.lit("item").alias("entity"), F.col("item_id").alias("id"), F.lit("create").alias("action")))


def roles(planned: DataFrame, members: DataFrame) -> DataFrame:
    """(left_id, role, parent_left_id, planned_name) of the plan's products.

    A product that is created is the master of its family, a variant under it where the master is
    created too, or stands alone; a linked one keeps its right name.
    """
    made = planned.select("left_id", "action").distinct()
    rows = made.join(members.select(F.col("id").alias("left_id"), "n", "master_id", "vendor", "material", "name"), "left_id")
    created = made.filter("action = 'create'").select(F.col("left_id").alias("master_id"), F.lit(True).alias("_created"))
    rows = rows.join(created, "master_id", "left")
    in_family = (F.col("action") == "create") & (F.col("n") >= 2) & F.coalesce("_created", F.lit(False))
    own = F.col("left_id") == F.col("master_id")
    role = F.when(F.col("action") == "link", "link").when(~in_family, "standalone").when(own, "master").otherwise("variant")
    name = F.when(F.col("action") == "create", text.display_name(F.col("vendor"), F.col("material"), F.col("name")))
    return rows.select("left_id", role.alias("role"), F.when(in_family & ~own, F.col("master_id")).alias("parent_left_id"), name.alias("planned_name"))


def execution_passes(planned: DataFrame, planned_roles: DataFrame) -> DataFrame:
    """Ordered actions (seq, entity, id, action) from left to right; applying them is the caller's.

    Containers of families come first, then masters and standalone products, variants, changes of
    linked products, tags, identities, and last the items.
    """
    steps = (
        (0, "container", "create", ("master",)), (1, "product", "create", ("master", "standalone")), (2, "variant", "create", ("variant",)),
        (3, "reconcile", "update", ("link",)), (4, "tags", "update", ("master", "variant", "standalone")), (5, "identity", "update", ("master", "variant", "standalone", "link")),
    )
    each = F.array(*(F.when(F.col("role").isin(*which), F.struct(F.lit(seq).alias("seq"), F.lit(entity).alias("entity"), F.lit(act).alias("action"))) for seq, entity, act, which in steps))
    products = planned_roles.select(F.col("left_id").alias("id"), F.inline(F.filter(each, lambda x: x.isNotNull())))
    items = planned.select(F.col("item_id").alias("id"), F.lit(6).alias("seq"), F.lit("item").alias("entity"), F.lit("create").alias("action"))
    return products.unionByName(items).select("seq", "entity", "id", "action")


def right_to_left(right: DataFrame, right_items: DataFrame, left: DataFrame, mapping: DataFrame, item_mapping: DataFrame) -> DataFrame:
    """Actions of an import from right to left: products with a live item that is not empty are linked or created, then their unmapped items."""
    live = right_items.filter(~F.col("retired") & (F.coalesce("total_weight", F.lit(0.0)) > 0)).select("id", "product_id")
    known = mapping.join(left.select(F.col("id").alias("left_id")), "left_id", "left_semi").groupBy(F.col("right_id").alias("id")).agg(F.min("left_id").alias("left_id"))
    used = right.select("id").join(live.select(F.col("product_id").alias("id")), "id", "left_semi").join(known, "id", "left")
    products = used.select(F.lit(1).alias("seq"), F.lit("product").alias("entity"), "id", F.when(F.col("left_id").isNull(), "create").otherwise("link").alias("action"))
    free = live.join(right.select(F.col("id").alias("product_id")), "product_id", "left_semi").join(item_mapping.select(F.col("right_item_id").alias("id")), "id", "left_anti")
    return products.unionByName(free.select(F.lit(2).alias("seq"), F.lit("item").alias("entity"), "id", F.lit("create").alias("action")))
