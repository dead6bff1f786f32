"""What resolving a conflict between two systems writes, for every kind of field.

One table says for each plain field where its value goes on either side and under which key both snapshots keep it.
Weights, places, lifecycles, colors and finish tags have rules of their own, and fields of an explicit map come last.
Each decision becomes a list of steps (writes, snapshot entries, the value recorded); one that cannot be
applied becomes one error, and stops no other.  All rules are column expressions over one row, so a batch of
decisions is one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color, text
from ..options import DEFAULT_TARE, FINISH_TAGS


@dataclass(frozen=True)
class Applier:
    """Where the value of a field goes: left and right path (dotted ones keep their siblings) and the key in both snapshots."""

    left: str
    right: str
    key: str


PLAIN = {
    "cost": Applier("price", "cost", "_cost"),
    "bed_temp": Applier("bed_temp", "temperatures.bed", "_mp_bed_temp"),
    "nozzle_temp": Applier("nozzle_temp", "temperatures.nozzle", "_mp_nozzle_temp"),
    "material": Applier("material", "type", "_mp_material"),
    "density": Applier("density", "density", "_mp_density"),
    "diameter": Applier("diameter", "diameter", "_mp_diameter"),
    "spool_weight": Applier("spool_weight", "tare", "_mp_spool_weight"),
    "net_weight": Applier("weight", "net_weight", "_mp_weight"),
    "nozzle_temp_min": Applier("extra.nozzle_temp_min", "temperatures.nozzle_min", "_mp_nozzle_temp_min"),
    "nozzle_temp_max": Applier("extra.nozzle_temp_max", "temperatures.nozzle_max", "_mp_nozzle_temp_max"),
    "drying_temp": Applier("extra.drying_temp", "drying_temp", "_mp_drying_temp"),
    "drying_time": Applier("extra.drying_time", "drying_time", "_mp_drying_time"),
    "hardness_shore_a": Applier("extra.hardness_shore_a", "hardness_shore_a", "_mp_hardness_shore_a"),
    "hardness_shore_d": Applier("extra.hardness_shore_d", "hardness_shore_d", "_mp_hardness_shore_d"),
    "transmission_distance": Applier("extra.transmission_distance", "transmission_distance", "_mp_transmission_distance"),
}


def _text(c: Column) -> Column:
    return c.cast("string")


def _step(kind: str, side: str | None, path: str | Column, value: Column) -> Column:
    name = F.lit(path) if isinstance(path, str) else path
    return F.struct(F.lit(kind).alias("kind"), F.lit(side).cast("string").alias("side"), name.alias("path"), _text(value).alias("value"))


def _both(left: tuple[str | Column, Column], right: tuple[str | Column, Column], key: str | Column, left_kept: Column, right_kept: Column | None = None) -> Column:
    """Writes to the right and to the left, the entries of both snapshots, and the value recorded."""
    right_kept = left_kept if right_kept is None else right_kept
    return F.array(
        _step("write", "right", *right), _step("write", "left", *left),
        _step("snapshot", "left", key, left_kept), _step("snapshot", "right", key, right_kept), _step("record", None, "value", left_kept),
    )


def steps(mapped: dict[str, str] | None = None, tags: dict[str, int] = FINISH_TAGS) -> Column:
    """array<struct<kind, side, path, value>> for a row of ``applied``; ``mapped`` has right path -> left key of further fields."""
    field, how = F.col("field_name"), F.col("resolution")
    value = F.when(how == "left", F.col("left_value")).when(how == "right", F.col("right_value")).otherwise(F.col("manual"))
    error = lambda why: F.array(_step("error", None, "", F.lit(why)))
    number = value.try_cast("double")

    # weight: net on the left, with the tare on the right, which is lowered by a usage entry only
    tare = F.coalesce("tare", F.lit(DEFAULT_TARE))
    net = F.round(F.when(how == "right", number - tare).otherwise(number), 2)
    gross, now = F.round(net + tare, 2), F.col("right_value").try_cast("double")
    lower = F.coalesce(gross < now, F.lit(False))
    usage = F.when(lower, F.round(now - gross, 2)).otherwise(gross)
    path = F.when(lower, "usage").otherwise("total_weight")
    weight = F.when(net.isNull(), error("not a number")).otherwise(_both(("remaining_weight", net), (path, usage), "weight", net, gross))

    place = F.nullif(F.trim(value), F.lit(""))
    gone = F.coalesce(value.try_cast("boolean"), F.lit(False))
    lifecycle = F.array(
        _step("write", "right", "retired", gone), _step("write", "left", "archived", gone),
        _step("snapshot", "left", "archived", gone), _step("snapshot", "right", "retired", gone), _step("record", None, "value", gone),
    )

    # colors and tags: the chosen side as it is now, not as it was when the conflict was queued
    to_right = color.left_to_right(F.col("color_hex"), F.col("multi"), F.col("direction"), F.col("tags"))
    to_left = color.right_to_left(F.col("color"), F.col("secondary"), F.col("tags"))
    ours, theirs = color.left_signature(F.col("color_hex"), F.col("multi"), F.col("direction")), color.signature(F.col("color"), F.col("secondary"), F.col("tags"))
    csv = lambda c: F.concat_ws(",", c.cast("array<string>"))
    kept = lambda sig, key: [_step("snapshot", "left", key, sig), _step("snapshot", "right", key, sig), _step("record", None, "value", sig)]
    rightward = F.array(_step("write", "right", "color", to_right["color"]), _step("write", "right", "secondary", csv(to_right["secondary"])), _step("write", "right", "tags", csv(to_right["tags"])), *kept(ours, "_mc_sig"))
    some = F.filter(F.array(*(_step("write", "left", c, to_left[c]) for c in ("color_hex", "multi", "direction"))), lambda s: s["value"].isNotNull())
    multicolor = F.when(how == "left", rightward).otherwise(F.concat(some, F.array(*kept(theirs, "_mc_sig"))))

    managed = sorted(set(tags.values()))
    known = F.array(*map(F.lit, managed))
    told = F.when(F.col("left_tags").isNotNull(), F.array_intersect(text.tags_from_csv(F.col("left_tags")), known)).otherwise(text.finish_ids(F.col("name"), F.col("material"), tags))
    ids = F.array_sort(F.when(how == "left", told).otherwise(F.array_intersect(F.coalesce("tags", F.array().cast("array<int>")), known)))
    finishes = F.array(_step("write", "right", "tags", csv(color.replace_tags(F.col("tags"), managed, ids))), _step("write", "left", "extra.finish_tags", text.tags_to_csv(ids)), *kept(csv(ids), "_finish_sig"))

    plain = F.array().cast("array<struct<kind:string,side:string,path:string,value:string>>")
    for name, a in PLAIN.items():
        plain = F.when(field == name, _both((a.left, value), (a.right, value), a.key, value)).otherwise(plain)
    for right, left in (mapped or {}).items():
        ours_, theirs_ = (color.to_left(value), color.to_right(value)) if right == "color" else (value, value)
        plain = F.when(field == right, _both((f"extra.{left}", ours_), (right, theirs_), F.lit(right), ours_, theirs_)).otherwise(plain)

    found = (
        F.when(field == "weight", weight).when(field == "location", _both(("location", place), ("location_name", place), "location", place))
        .when(field == "lifecycle", lifecycle).when(field == "multicolor", multicolor).when(field == "finish_tags", finishes).otherwise(plain)
    )
    return (
        F.when(~F.coalesce(how.isin("left", "right", "manual"), F.lit(False)), error("unknown resolution"))
        .when((how == "manual") & field.isin("multicolor", "finish_tags"), error("not by hand"))
        .when(F.size(found) == 0, error("no applier for this field")).otherwise(found)
    )


def applied(decisions: DataFrame, mapped: dict[str, str] | None = None, tags: dict[str, int] = FINISH_TAGS) -> DataFrame:
    """(id, step, kind, side, path, value) of every decision.

    ``decisions``: id, field_name, resolution (left, right, manual), left_value, right_value, manual, and the live pair: tare,
    color_hex, multi, direction, left_tags, name, material of the left product, color, secondary, tags of the right one.
    """
    return decisions.select("id", F.posexplode(steps(mapped, tags)).alias("step", "s")).select("id", "step", "s.*")
