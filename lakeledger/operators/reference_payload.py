"""What a reference material writes to a left product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color, text, units
from ..options import DEFAULT_DIAMETER
from . import fuzzy, passes


def hexes(primary: Column, secondary: Column) -> Column:
    """Bare upper-case hexes, the first color in front, each once, empty ones dropped."""
    every = F.concat(F.array(F.coalesce(primary, F.lit(""))), F.coalesce(secondary, F.array().cast("array<string>")))
    bare = F.transform(every, lambda h: F.upper(F.regexp_replace(F.coalesce(h, F.lit("")), "^#+", "")))
    return F.array_distinct(F.filter(bare, lambda h: h != ""))


def payloads(materials: DataFrame, packages: DataFrame, containers: DataFrame, tags: dict[str, int]) -> DataFrame:
    """One row of left fields per material; null means that the field is not written.

    Two colors or more are a list with a direction (coaxial unless a gradient), never a single
    color beside it; one color is single unless the material is said to have an arrangement, of
    which the rest is then unknown, so nothing is written.  An arrangement is told by words or by
    integer tags (``opt_tags``).  Numbers that cannot be read are left out; those of the option fields
    are whole or not as their passes have them, drying time in minutes on both sides.
    """
    raw = F.coalesce(F.nullif("type", F.lit("")), F.nullif("abbreviation", F.lit("")), F.lit(""))
    words = F.coalesce("tags", F.array().cast("array<string>"))
    finishes = F.array_sort(F.array_distinct(F.concat(text.finish_ids(F.array_join(words, " "), F.lit(""), tags), text.finish_ids(F.col("name"), raw, tags))))
    lower = F.transform(words, lambda w: F.lower(F.trim(w)))
    profile = color.right_profile(F.array().cast("array<string>"), F.col("opt_tags"), words)
    arranged = F.when(profile.isin("coextruded", "gradient"), profile)
    found = hexes(F.col("color"), F.col("secondary"))
    many = F.size(found) >= 2
    weights = fuzzy.package_weights(materials.select(F.col("id").alias("slug")), packages, containers).select(F.col("slug").alias("id"), F.col("net").cast("double").alias("weight"), F.col("tare").alias("spool_weight"))
    rows = materials.select(
        "id", F.nullif(text.without_finishes(raw, tags), F.lit("")).alias("material"), finishes.alias("tags"),
        F.when((F.size(found) == 1) & arranged.isNull(), F.get(found, F.lit(0))).alias("color_hex"), F.when(many, F.array_join(found, ",")).alias("multi"),
        F.when(many, F.when(arranged == "gradient", "longitudinal").otherwise("coaxial")).alias("direction"),
        F.col("density").try_cast("double").alias("density"), F.lit(DEFAULT_DIAMETER).alias("diameter"), F.col("nozzle_max").try_cast("double").cast("int").alias("nozzle_temp"),
        F.col("bed_max").try_cast("double").cast("int").alias("bed_temp"), "name", F.col("brand").alias("vendor"),
        F.nullif("slug", F.lit("")).alias("slug"), F.nullif("uuid", F.lit("")).alias("uuid"),
        *(units.as_temperature(F.col(c)).alias(c) for c in passes.OPTION_INTEGERS), *(F.col(c).try_cast("double").alias(c) for c in passes.OPTION_FLOATS),
    )
    return rows.join(weights, "id", "left")

