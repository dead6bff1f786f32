"""Decisions of a user, and tools that set links and tables back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values
from ..options import SYNCABLE
from ..sources.state import insert_absent, upsert


def saved(old: DataFrame, new: DataFrame) -> DataFrame:
    """The decision table after a save: one row per left product."""
    return upsert(old, new, ["left_id"])


def variant_masters(members: DataFrame) -> DataFrame:
    """(left_id, master_id) of all members (id, n, master_id) of families of two or more but the masters themselves."""
    return members.filter("n >= 2 and id <> master_id").select(F.col("id").alias("left_id"), "master_id")


def overlay(payload: DataFrame, chosen: DataFrame) -> DataFrame:
    """Long payload rows (left_id, field, value) with chosen values in their place."""
    return upsert(payload, chosen, ["left_id", "field"])


def minimal_patch(payload: DataFrame, current: DataFrame) -> DataFrame:
    """The rows of a payload that change something."""
    old = current.select("left_id", "field", F.col("value").alias("_old"))
    return payload.join(old, ["left_id", "field"], "left").filter(values.differ(values.compare_form(F.col("value")), values.compare_form(F.col("_old")))).select("left_id", "field", "value")


def relink(mapping: DataFrame, changes: DataFrame) -> DataFrame:
    """Mappings with new right ids for some left ones."""
    return mapping.join(changes.select("left_id", F.col("right_id").alias("_new")), "left_id", "left").withColumn("right_id", F.coalesce("_new", "right_id")).drop("_new").select(*mapping.columns)


def unlink(mapping: DataFrame, gone: DataFrame) -> DataFrame:
    return mapping.join(gone.select("left_id"), "left_id", "left_anti")


def purge(gone: DataFrame, *tables: tuple[DataFrame, str]) -> list[DataFrame]:
    """Each table without the rows of the purged ids; a table comes with the column of the id."""
    return [t.join(gone.select(F.col("left_id").cast(t.schema[c].dataType).alias(c)), c, "left_anti").select(*t.columns) for t, c in tables]


def without_references(extra: Column, keys: tuple[str, ...] = ("left_id", "right_id", "right_parent_id")) -> Column:
    """An open map without cross references (a reset keeps all else)."""
    return F.map_filter(extra, lambda k, v: ~k.isin(*keys))


def seeded_config(old: DataFrame | None, defaults: DataFrame) -> DataFrame:
    """The configuration with defaults where a key is absent."""
    return insert_absent(old, defaults, ["key"])


def set_config(old: DataFrame | None, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["key"])


def direction_of(source_of_truth: Column) -> Column:
    """The direction that an older setting stood for."""
    return F.when(source_of_truth == "left", "left_to_right").when(source_of_truth == "right", "right_to_left").otherwise("two_way")


def target_of(direction: Column) -> Column:
    """The side that a direction writes to."""
    return F.when(direction == "left_to_right", "right").when(direction == "right_to_left", "left").otherwise("both")


def canonical_field(name: Column, labels: dict[str, str]) -> Column:
    """One field id for a field's name or label."""
    found = F.lower(F.trim(name))
    pairs = F.create_map(*(F.lit(x) for kv in sorted(labels.items()) for x in kv)) if labels else None
    return found if pairs is None else F.coalesce(F.try_element_at(pairs, found), found)


def mapped_key(field: Column, explicit: dict[str, str], excluded: tuple[str, ...] = ()) -> Column:
    """The left key under which a conflict's right field is kept: an explicit one, else the same name where it may be
    synchronised; null where either name is excluded or nothing is known of it."""
    found = F.when(field.isin(*SYNCABLE), field)
    for right, left in explicit.items():
        found = F.when(field == right, F.lit(None if left in excluded else left)).otherwise(found)
    return F.when(~field.isin(*excluded), found) if excluded else found


def seed_snapshots(pairs: DataFrame, fields: list[str], side: str, now: Column) -> DataFrame:
    """First snapshot rows of new pairs, so that the next run starts from what was written."""
    rows = F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields)))
    return pairs.select(F.lit(side).alias("source"), F.col(f"{side}_item_id").cast("string").alias("entity_id"), rows).withColumn("captured_at", now)


def settled_with(conflicts: DataFrame, gone: DataFrame) -> DataFrame:
    """All conflicts, and which open ones are settled because their product is gone."""
    known = gone.select("left_id").distinct().withColumn("_gone", F.lit(True))
    return conflicts.join(known, "left_id", "left").withColumn("settled", F.col("resolved_at").isNull() & F.coalesce("_gone", F.lit(False))).drop("_gone")
