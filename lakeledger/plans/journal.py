"""Executing a plan so that it can stop anywhere and go on.

Every action has a key made of the plan, its kind and its record, and names the action that it needs first: a product
its container, tags, identity and items their product.  Outcomes go to an append-only journal, a row for each attempt.
An action is ready when it has no outcome of ``done`` and what it needs has one, whose new id it then gets; so a run after a crash
begins at the first action without an outcome, and ids from creations reach their items.  Whoever applies actions gets
their keys, by which it can tell one that it has done already but that was lost on its way to the journal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.snapshots import SnapshotStore

JOURNAL = "key string, attempt int, status string, made_id string, error string"
#: Steps of a product by its role: pass, kind, what is done, the kind that it needs, of the parent or of itself.
STEPS = {
    "master": ((0, "container", "create", None), (1, "product", "create", "container"), (4, "tags", "update", "product"), (5, "identity", "update", "product")),
    "standalone": ((1, "product", "create", None), (4, "tags", "update", "product"), (5, "identity", "update", "product")),
    "variant": ((2, "variant", "create", "container"), (4, "tags", "update", "variant"), (5, "identity", "update", "variant")),
    "link": ((3, "reconcile", "update", None), (5, "identity", "update", "reconcile")),
}
#: The action whose id the items of a product get.
OWNER = {"master": "product", "standalone": "product", "variant": "variant", "link": "reconcile"}
PASSES = 7


def action_key(plan_id: str, entity: Column, id_: Column) -> Column:
    return F.when(entity.isNotNull() & id_.isNotNull(), F.sha2(F.concat_ws("|", F.lit(plan_id), entity, id_.cast("string")), 256))


def actions(plan_id: str, planned: DataFrame, roles: DataFrame) -> DataFrame:
    """(key, seq, entity, id, action, given_id, needs) of a plan; ``given_id`` is the right product of a linked one."""
    linked = planned.groupBy("left_id").agg(F.max("right_id").alias("given_id"))
    step = lambda seq, entity, act, needs, parent: F.struct(
        F.lit(seq).alias("seq"), F.lit(entity).alias("entity"), F.lit(act).alias("action"), F.lit(needs).cast("string").alias("needs_entity"),
        (F.col("parent_left_id") if parent else F.col("left_id")).alias("needs_id"),
    )
    each = F.lit(None).cast("array<struct<seq:int,entity:string,action:string,needs_entity:string,needs_id:bigint>>")
    owner = F.lit(None).cast("string")
    for role, found in STEPS.items():
        each = F.when(F.col("role") == role, F.array(*(step(*s, role == "variant" and s[3] == "container") for s in found))).otherwise(each)
        owner = F.when(F.col("role") == role, OWNER[role]).otherwise(owner)
    known = roles.join(linked, "left_id", "left").withColumn("owner", owner)
    products = known.select(F.col("left_id").alias("id"), "given_id", F.inline(each))
    items = planned.select("left_id", F.col("item_id").alias("id")).join(known.select("left_id", "owner"), "left_id")
    items = items.select("id", F.lit(None).cast("string").alias("given_id"), F.lit(6).alias("seq"), F.lit("item").alias("entity"), F.lit("create").alias("action"), F.col("owner").alias("needs_entity"), F.col("left_id").alias("needs_id"))
    rows = products.unionByName(items)
    given = F.when(F.col("entity") == "reconcile", F.col("given_id"))
    return rows.select(action_key(plan_id, F.col("entity"), F.col("id")).alias("key"), "seq", "entity", "id", "action", given.alias("given_id"), action_key(plan_id, F.col("needs_entity"), F.col("needs_id")).alias("needs"))


def outcomes(journal: DataFrame) -> DataFrame:
    """The outcome of each action that was tried: its success, else its last failure; and how often it was tried."""
    best = F.max_by(F.struct("status", "made_id", "error"), F.struct(F.col("status") == "done", "attempt")).alias("o")
    return journal.groupBy("key").agg(best, F.max("attempt").alias("attempts")).select("key", "o.*", "attempts")


def standing(todo: DataFrame, journal: DataFrame) -> DataFrame:
    """Every action as it stands: done, failed, ready or blocked, with its own new id and that of what it needs (``parent_id``)."""
    found = outcomes(journal)
    needed = found.filter("status = 'done'").select(F.col("key").alias("needs"), F.col("made_id").alias("parent_id"), F.lit(True).alias("_met"))
    rows = todo.join(found.withColumnRenamed("status", "tried"), "key", "left").join(needed, "needs", "left")
    met = F.col("needs").isNull() | F.coalesce("_met", F.lit(False))
    status = F.when(F.col("tried") == "done", "done").when(~met, "blocked").when(F.col("tried") == "failed", "failed").otherwise("ready")
    return rows.select("key", "seq", "entity", "id", "action", "given_id", "parent_id", status.alias("status"), "made_id", "error", F.coalesce("attempts", F.lit(0)).alias("attempts"))


def resume(store: SnapshotStore, table: str, todo: DataFrame, apply: Callable[[DataFrame], DataFrame]) -> None:
    """Applies what is ready, pass by pass, so that each pass sees the ids of those before.

    ``apply`` gets rows of ``standing`` and gives (key, status, made_id, error); actions that failed before are tried
    again, once.  A pass and its outcomes are one step of the store: a crash loses at most the outcomes of one pass.
    """
    for seq in range(PASSES):
        ready = standing(todo.filter(F.col("seq") == seq), store.read(table)).filter("status in ('ready', 'failed')").persist(StorageLevel.MEMORY_AND_DISK)  # used twice; its joins are made once
        done = apply(ready).join(ready.select("key", (F.col("attempts") + 1).alias("attempt")), "key")
        try:
            with store.change() as step:
                step.upsert(table, done.select("key", F.col("attempt").cast("int").alias("attempt"), "status", "made_id", "error"))
        finally:
            ready.unpersist()
