"""When the stored reference catalog and its match results are still good."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.reports import content_digest

SCHEMA_VERSION, LEXICON_VERSION = 1, 1


def manifest(materials: DataFrame, commit: str | None, fetched_at: Column) -> DataFrame:
    """One row that names a loaded catalog: the commit, else how many rows were loaded when."""
    row = materials.agg(F.count("*").alias("n")).withColumn("fetched_at", fetched_at)
    identity = F.lit(commit) if commit else F.concat_ws(":", F.col("n").cast("string"), F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss"))
    return row.select(identity.alias("identity"), "n", "fetched_at", F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(LEXICON_VERSION).alias("lexicon_version"))


def freshness(manifests: DataFrame, commit: str | None, now: Column, max_days: int) -> DataFrame:
    """What to do with each manifest: keep, mine again, or reload.

    The same commit is kept at any age; another one, or an old catalog of unknown commit, is
    reloaded; so is one of another layout.  An older lexicon is mined again from the rows there.
    """
    old = F.col("fetched_at") < now - F.make_dt_interval(F.lit(max_days))
    stale = F.lit(False) if commit is None else F.col("identity") != commit
    act = F.when(F.col("schema_version") != SCHEMA_VERSION, "reload").when((old if commit is None else stale), "reload").when(F.col("lexicon_version") != LEXICON_VERSION, "mine").otherwise("keep")
    return manifests.select("identity", act.alias("action"))


def fingerprint(products: DataFrame, columns: list[str], manifest_row: DataFrame, settings: str) -> DataFrame:
    """One row of three parts: catalog, content of the left products, settings."""
    content = content_digest(products, columns).select(F.col("digest").alias("content"))
    return manifest_row.select(F.col("identity").alias("catalog")).crossJoin(content).withColumn("settings", F.sha2(F.lit(settings), 256))  # single rows


def inputs_changed(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Which parts of two fingerprints differ."""
    parts = ("catalog", "content", "settings")
    both = stored.select(*(F.col(p).alias(f"old_{p}") for p in parts)).crossJoin(current)  # single rows
    return both.select(*((~F.col(p).eqNullSafe(F.col(f"old_{p}"))).alias(p) for p in parts))
