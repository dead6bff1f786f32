"""Versioned Parquet tables: a new version is written beside the old one, then named in a manifest."""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SNAPSHOT_KEY = ["source", "entity_type", "entity_id", "field"]
AUDITED = ("create", "update", "delete", "usage")
SECRET_WORDS = ("password", "token", "secret", "api_key")


class StateTable:
    """A table under ``path``.  Readers see the version that the newest manifest row names, whole."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _manifest(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("version long, folder string").json(f"{self.path}/manifest")
        except Exception as e:  # Spark names a missing path in its error class only
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def current(self) -> tuple[int, str | None]:
        rows = self._manifest()
        last = None if rows is None else rows.orderBy(F.col("version").desc()).first()
        return (0, None) if last is None else (last["version"], last["folder"])

    def read(self) -> DataFrame | None:
        _, folder = self.current()
        return None if folder is None else self.spark.read.parquet(folder)

    def _path(self, name: str):
        """A Hadoop path and its file system, the one that Spark's own readers use."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, rows: DataFrame, *partition_by: str) -> int:
        """Writes ``rows`` as the next version; a failed write leaves the current one in force.

        Of two writers that began at one version the second one fails, since a version's manifest
        file is made once and never replaced.
        """
        version, _ = self.current()
        folder = f"{self.path}/v{version + 1}-{uuid.uuid4().hex[:8]}"
        rows.write.partitionBy(*partition_by).parquet(folder)
        line, files = self._path(f"{self.path}/manifest/v{version + 1}.json")
        out = files.create(line, False)
        out.write(bytearray(json.dumps({"version": version + 1, "folder": folder}).encode()))
        out.close()
        return version + 1

    def prune(self, keep: int = 2) -> int:
        """Deletes all but the newest ``keep`` versions, which nobody may be reading; returns how many."""
        named = self._manifest()
        old = [] if named is None else named.orderBy(F.col("version").desc()).collect()[keep:]
        for row in old:
            for name in (f"{self.path}/manifest/v{row['version']}.json", row["folder"]):
                path, files = self._path(name)
                files.delete(path, True)
        return len(old)

    def clear(self) -> int:
        """Makes an empty version; returns the number of rows that the current one holds."""
        rows = self.read()
        if rows is None:
            return 0
        n = rows.count()
        self.write(rows.limit(0))
        return n

    def append(self, rows: DataFrame) -> None:
        """Adds rows to the current version without rewriting it (audit log)."""
        _, folder = self.current()
        if folder is None:
            self.write(rows)
        else:
            rows.write.mode("append").parquet(folder)


def upsert(old: DataFrame | None, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal keys (null is a key value)."""
    if old is None:
        return new
    kept = old.join(new.select(*(F.col(k).alias(f"_{k}") for k in key)), [old[k].eqNullSafe(F.col(f"_{k}")) for k in key], "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def insert_absent(old: DataFrame | None, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks."""
    if old is None:
        return new
    fresh = new.join(old.select(*(F.col(k).alias(f"_{k}") for k in key)), [new[k].eqNullSafe(F.col(f"_{k}")) for k in key], "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def snapshot_rows(rows: DataFrame, source: str, entity_type: str, id_: str, fields: list[str], now: Column) -> DataFrame:
    """Long snapshot rows, a value per field, which keep a null apart from a field that is not there."""
    long = F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields)))
    return rows.select(F.lit(source).alias("source"), F.lit(entity_type).alias("entity_type"), F.col(id_).cast("string").alias("entity_id"), long).withColumn("captured_at", now)


def audited(log: DataFrame) -> DataFrame:
    return log.filter(F.col("action").isin(*AUDITED))


def change_lines(log: DataFrame) -> DataFrame:
    """One text line per audited row."""
    clean = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("-")), r"\p{C}", " ")
    return audited(log).select("id", F.concat_ws(" | ", F.date_format("logged_at", "yyyy-MM-dd HH:mm:ss"), F.upper("action"), "entity_type", F.concat(F.lit("#"), clean("left_id")), clean("value")).alias("line"))


def directed_lines(log: DataFrame) -> DataFrame:
    """One text line per audited row: when, what, which record, to which side."""
    side = F.when(F.col("direction") == "left_to_right", "right").when(F.col("direction") == "right_to_left", "left").otherwise("both")
    verb = F.when(F.col("action") == "create", "new").when(F.col("action") == "update", "changed").when(F.col("action") == "delete", "gone").otherwise("used")
    record = F.concat("entity_type", F.lit(" #"), F.regexp_replace(F.col("left_id").cast("string"), r"\p{C}", " "))
    return audited(log).select("id", F.concat_ws(" | ", F.date_format("logged_at", "yyyy-MM-dd HH:mm:ss"), F.upper("action"), record, F.concat(F.lit("-> "), side), verb).alias("line"))


def retained(log: DataFrame, days: int, now: Column) -> DataFrame:
    """Rows of the last ``days``; 0 keeps all."""
    return log if days == 0 else log.filter(F.col("logged_at") >= now - F.make_dt_interval(F.lit(days)))


def newest(versions: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` entries per kind."""
    return versions.withColumn("_n", F.row_number().over(Window.partitionBy("kind").orderBy(F.col("written_at").desc(), "name"))).filter(F.col("_n") <= n).drop("_n")


def without_secrets(config: DataFrame) -> DataFrame:
    key = F.lower("key")
    return config.filter(~F.coalesce(key.rlike("|".join(SECRET_WORDS)), F.lit(False)))


def export_state(path: str, mapping: DataFrame, conflicts: DataFrame, config: DataFrame) -> None:
    """Mappings, open conflicts and the configuration without secrets, as JSON."""
    mapping.write.json(f"{path}/mapping")
    conflicts.filter("resolved_at is null").write.json(f"{path}/conflicts")
    without_secrets(config).write.json(f"{path}/config")


def import_state(spark: SparkSession, path: str, mapping: DataFrame, conflicts: DataFrame, config: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables after an import: mappings and configuration replace by business key, conflicts only fill gaps."""
    read = lambda name, like: spark.read.schema(like.schema).json(f"{path}/{name}")
    return (
        upsert(mapping, read("mapping", mapping), ["left_id", "right_id"]),
        insert_absent(conflicts, read("conflicts", conflicts), ["entity_type", "left_id", "field_name", "conflict_type"]),
        upsert(config, read("config", config), ["key"]),
    )


def dump_lines(products: DataFrame, items: DataFrame, right_products: DataFrame | None = None, right_items: DataFrame | None = None) -> DataFrame:
    """State as text, one line per entity, sorted by section and id: (section, id, line).

    The sections are left products and items, then those of the right side where it is given.
    """
    line = lambda *cs: F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cs))
    parts = [
        ("product", products, ("vendor", "name", "material")), ("item", items, ("product_id", "remaining_weight", "location")),
        ("right_product", right_products, ("vendor", "name", "type", "color", "tare", "parent_id")), ("right_item", right_items, ("product_id", "total_weight", "retired")),
    ]
    rows = [df.select(F.lit(k).alias("_at"), F.lit(section).alias("section"), F.col("id").cast("string").alias("id"), line(*cs).alias("line")) for k, (section, df, cs) in enumerate(parts) if df is not None]
    every = functools.reduce(DataFrame.unionByName, rows)
    return every.orderBy("_at", F.col("id").try_cast("long"), "id").drop("_at")


def merge_settings(old: Column, new: Column) -> Column:
    """A settings map with new entries; equal maps tell that nothing is to be written."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def without_keys(old: Column, keys: list[str]) -> Column:
    return F.map_filter(old, lambda k, v: ~k.isin(*keys))
