"""The field passes: which fields each compares, in which form, and what it may write.

Every pass turns pairs of products (columns ``left_*`` and ``right_*``, now and at the last sync)
into long rows and goes through ``changes.field_changes``.  Signatures call it a first sight where
either side of the snapshot is null, scalars only where both are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color, text, units
from ..options import Options
from . import changes

Form = Callable[[Column], Column]


@dataclass(frozen=True)
class Field:
    """A field with its column on either side and the form in which both are compared."""

    name: str
    left: str
    right: str
    form: Form
    required: bool = False  # the left side takes no null


@dataclass(frozen=True)
class Pass:
    name: str
    fields: tuple[Field, ...]
    either_missing_is_first: bool = False
    inherits: bool = False  # variants may take the value from their parent


def _amount(c: Column) -> Column:
    return units.as_amount(c).cast("string")


def _temperature(c: Column) -> Column:
    return units.as_temperature(c).cast("string")


def _same(*names: str) -> tuple[tuple[str, str], ...]:
    return tuple((n, n) for n in names)


COST = Pass("cost", (Field("cost", "cost", "cost", _amount),))
TEMPERATURE = Pass("temperature", tuple(Field(n, n, n, _temperature) for n in ("bed_temp", "nozzle_temp")))
SCALAR = Pass(
    "scalar",
    (
        Field("material", "material", "type", units.as_text), Field("density", "density", "density", _amount, True), Field("diameter", "diameter", "diameter", _amount, True),
        Field("spool_weight", "spool_weight", "tare", _amount), Field("net_weight", "weight", "net_weight", _amount),
    ),
    inherits=True,
)
# Option fields that both sides hold, whole numbers first.
OPTION_INTEGERS, OPTION_FLOATS = ("nozzle_temp_min", "nozzle_temp_max", "drying_temp", "drying_time"), ("hardness_shore_a", "hardness_shore_d", "transmission_distance")
OPTIONS_PASS = Pass("option", tuple(Field(n, n, n, _temperature) for n in OPTION_INTEGERS) + tuple(Field(n, n, n, _amount) for n in OPTION_FLOATS))
SIGNATURE = Pass("multicolor", (Field("multicolor", "signature", "signature", lambda c: c),), either_missing_is_first=True)
FINISH = Pass("finish_tags", (Field("finish_tags", "finish_tags", "finish_tags", lambda c: c),), either_missing_is_first=True)


def field_map_pass(mapped: dict[str, str]) -> Pass:
    """The generic pass over mapped fields; what a variant inherits is left alone."""
    return Pass("field_map", tuple(Field(a, a, b, units.as_text) for a, b in mapped.items()), inherits=True)


def long(rows: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
    """(pair, field, left, right[, inherited]) of wide rows, in compare form.

    ``inherited`` holds the names of a variant's fields that it has from its parent.
    """
    inherited = [F.array_contains("right_inherited", f.name).alias("inherited") for f in fields] if "right_inherited" in rows.columns else [None] * len(fields)
    each = F.array(*(F.struct(*(c for c in (F.lit(f.name).alias("field"), f.form(F.col(f"left_{f.left}")).alias("left"), f.form(F.col(f"right_{f.right}")).alias("right"), i) if c is not None)) for f, i in zip(fields, inherited, strict=True)))
    keep = [c for c in ("left_ts", "right_ts", "multicolor") if c in rows.columns]
    return rows.select("pair", *keep, F.inline(each))


def run(which: Pass, now: DataFrame, then: DataFrame, options: Options) -> DataFrame:
    """(pair, field, then and now, action) of one pass.

    A required field is not emptied, the mapped color of a product with several colors is left to
    its own pass, and inherited values follow the gate of ``field_changes``.
    """
    rows = long(now, which.fields)
    if not which.inherits and "inherited" in rows.columns:
        rows = rows.drop("inherited")
    if "multicolor" in rows.columns:
        rows = rows.filter(~(F.col("multicolor") & (F.col("field") == "color_hex"))).drop("multicolor")
    past = long(then, which.fields).select("pair", "field", "left", "right")
    out = changes.field_changes(rows, past, options, which.either_missing_is_first)
    required = [f.name for f in which.fields if f.required]
    empties = F.col("field").isin(*required) & (F.col("action") == "push_left") & F.col("right").isNull() if required else F.lit(False)
    return out.withColumn("action", F.when(empties, "skip").otherwise(F.col("action")))


def with_signatures(rows: DataFrame) -> DataFrame:
    """Left colors (color_hex, multi, direction) and right ones (color, secondary, tags) as system-neutral signatures."""
    return rows.withColumns({"left_signature": color.left_signature(F.col("left_color_hex"), F.col("left_multi"), F.col("left_direction")), "right_signature": color.signature(F.col("right_color"), F.col("right_secondary"), F.col("right_tags"))})


def with_finish_tags(rows: DataFrame, tags: dict[str, int]) -> DataFrame:
    """Sorted finish tags as text: of the left side its own list where it has one, else those that name and material
    tell; of the right side its managed tags."""
    managed = F.array(*(F.lit(i) for i in sorted(set(tags.values()))))
    told = text.finish_ids(F.col("left_name"), F.col("left_material"), tags)
    left = F.when(F.col("left_tags").isNotNull(), F.array_intersect(text.tags_from_csv(F.col("left_tags")), managed)).otherwise(told)
    csv = lambda c: F.nullif(text.tags_to_csv(c), F.lit(""))
    return rows.withColumns({"left_finish_tags": csv(left), "right_finish_tags": csv(F.array_intersect(F.coalesce("right_tags", F.array().cast("array<int>")), managed))})
