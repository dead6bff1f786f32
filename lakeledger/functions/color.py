"""Single and multiple colors of the flat (left) and the nested (right) catalog."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import TAG_COEXTRUDED, TAG_GRADIENT

STRINGS = "array<string>"


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def to_right(c: Column) -> Column:
    """With one leading ``#``; empty as null."""
    bare = F.regexp_replace(F.trim(c), "^#+", "")
    return F.when(bare != "", F.concat(F.lit("#"), bare))


def to_left(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.trim(c), "^#+", ""), F.lit(""))


def split_hexes(csv: Column) -> Column:
    """``#RRGGBB`` list of a comma list; empty parts are dropped."""
    return F.filter(F.transform(F.split(F.coalesce(csv, F.lit("")), ","), to_right), lambda h: h.isNotNull())


def rgba_to_hex(c: Column) -> Column:
    """First six digits in upper case; null below six."""
    bare = F.regexp_replace(F.trim(c), "^#+", "")
    return F.when(F.char_length(bare) >= 6, F.upper(F.substr(bare, F.lit(1), F.lit(6))))


def arrangement(tags: Column) -> Column:
    return F.when(F.array_contains(tags, TAG_COEXTRUDED), "coextruded").when(F.array_contains(tags, TAG_GRADIENT), "gradient")


def without_arrangement(tags: Column) -> Column:
    return F.filter(F.coalesce(tags, _empty("array<int>")), lambda t: ~t.isin(TAG_GRADIENT, TAG_COEXTRUDED))


def with_arrangement(tags: Column, tag: Column) -> Column:
    return F.when(tag.isNull(), without_arrangement(tags)).otherwise(F.array_append(without_arrangement(tags), tag))


def replace_tags(tags: Column, managed: list[int], ids: Column) -> Column:
    """Unmanaged tags in their order, then the sorted ids."""
    rest = F.filter(F.coalesce(tags, _empty("array<int>")), lambda t: ~t.isin(*managed))
    return F.concat(rest, F.array_sort(F.coalesce(ids, _empty("array<int>"))))


def left_to_right(color_hex: Column, multi: Column, direction: Column, tags: Column) -> Column:
    """struct<color, secondary, tags> of a left product.

    Up to one hex is a solid color.  Coaxial: no first color, all are secondary.  Longitudinal or
    unknown: the first and the rest, the former with its tag.
    """
    hexes = split_hexes(multi)
    solid, coaxial = F.size(hexes) <= 1, direction == "coaxial"
    color = F.when(solid, F.coalesce(to_right(color_hex), F.get(hexes, F.lit(0)))).when(coaxial, None).otherwise(F.get(hexes, F.lit(0)))
    rest = F.when(solid, _empty(STRINGS)).when(coaxial, hexes).otherwise(F.slice(hexes, 2, 100))
    tag = F.when(solid, None).when(coaxial, TAG_COEXTRUDED).when(direction == "longitudinal", TAG_GRADIENT).cast("int")
    return F.struct(color.alias("color"), rest.alias("secondary"), with_arrangement(tags, tag).alias("tags"))


def right_to_left(color: Column, secondary: Column, tags: Column) -> Column:
    """struct<color_hex, multi, direction>; fewer than two hexes are one color."""
    every = F.filter(F.concat(F.array(to_left(color)), F.transform(F.coalesce(secondary, _empty(STRINGS)), to_left)), lambda h: h.isNotNull())
    many = F.size(every) >= 2
    direction = F.when(arrangement(tags) == "coextruded", "coaxial").when(arrangement(tags) == "gradient", "longitudinal")
    return F.struct(F.when(~many, F.get(every, F.lit(0))).alias("color_hex"), F.when(many, F.array_join(every, ",")).alias("multi"), F.when(many, direction).alias("direction"))


def representative(color_hex: Column, multi: Column) -> Column:
    return F.coalesce(to_left(color_hex), to_left(F.get(split_hexes(multi), F.lit(0))))


def signature(color: Column, secondary: Column, tags: Column) -> Column:
    """``arrangement|color|secondary,...``, equal for both catalogs when the product is."""
    hexes = F.array_join(F.transform(F.coalesce(secondary, _empty(STRINGS)), lambda h: F.upper(F.regexp_replace(h, "^#+", ""))), ",")
    return F.concat_ws("|", F.coalesce(arrangement(tags), F.lit("")), F.coalesce(F.upper(F.regexp_replace(color, "^#+", "")), F.lit("")), hexes)


def left_signature(color_hex: Column, multi: Column, direction: Column) -> Column:
    as_right = left_to_right(color_hex, multi, direction, _empty("array<int>"))
    return signature(as_right["color"], as_right["secondary"], as_right["tags"])


def left_profile(multi: Column, direction: Column) -> Column:
    return F.when(F.coalesce(multi, F.lit("")) == "", "single").when(direction == "coaxial", "coextruded").when(direction == "longitudinal", "gradient").otherwise("multi_unknown")


def right_profile(secondary: Column, tags: Column, words: Column) -> Column:
    """Tag words count before tag ids, both before the number of secondary colors."""
    lower = F.transform(F.coalesce(words, _empty(STRINGS)), lambda w: F.lower(F.trim(w)))
    every = F.concat(
        F.coalesce(tags, _empty("array<int>")),
        F.when(F.array_contains(lower, "coextruded"), F.array(F.lit(TAG_COEXTRUDED))).otherwise(_empty("array<int>")),
        F.when(F.arrays_overlap(lower, F.array(F.lit("gradual_color_change"), F.lit("gradient"))), F.array(F.lit(TAG_GRADIENT))).otherwise(_empty("array<int>")),
    )
    return F.coalesce(arrangement(every), F.when(F.size(F.coalesce(secondary, _empty(STRINGS))) >= 2, "multi_unknown").otherwise("single"))


def is_multicolor(multi: Column, tags: Column) -> Column:
    """Whether the left list has two hexes or more, or the right tags name an arrangement."""
    return (F.size(split_hexes(multi)) >= 2) | arrangement(F.coalesce(tags, _empty("array<int>"))).isNotNull()


def profiles_fit(a: Column, b: Column) -> Column:
    return (a == b) | ((a != "single") & (b != "single") & ((a == "multi_unknown") | (b == "multi_unknown")))


def arity(n_hexes: Column, n_named: Column) -> Column:
    return F.greatest(n_hexes, n_named)


def profiles_fit_softly(a: Column, b: Column, hexes_a: Column, hexes_b: Column, arity_a: Column, arity_b: Column) -> Column:
    """Strict where both sides are arranged and have two hexes or more; else both are multiple or neither is."""
    arranged = a.isin("coextruded", "gradient") & b.isin("coextruded", "gradient") & (hexes_a >= 2) & (hexes_b >= 2)
    return F.when(arranged, profiles_fit(a, b)).otherwise((arity_a >= 2) == (arity_b >= 2))


def rgb(c: Column) -> Column:
    """Red, green and blue of a hex code; null for what is none.  Worked out once per product, not per pair."""
    bare = F.regexp_replace(c, "^#+", "")
    part = lambda k: F.conv(F.substr(bare, F.lit(1 + 2 * k), F.lit(2)), 16, 10).cast("double")
    return F.when(bare.rlike("^[0-9A-Fa-f]{6}"), F.array(*(part(k) for k in range(3))))


def rgb_distance(a: Column, b: Column) -> Column:
    """Distance of two colors from 0 to 1; 0.5 where either is unknown."""
    squares = sum(((a[k] - b[k]) * (a[k] - b[k]) for k in range(3)), F.lit(0.0))
    return F.when(a.isNull() | b.isNull(), 0.5).otherwise(F.sqrt(squares) / (255 * 3**0.5))


def distance(a: Column, b: Column) -> Column:
    return rgb_distance(rgb(a), rgb(b))


def hex_score(a: Column, b: Column) -> Column:
    """What two colors (of ``rgb``) that are near each other add to a match."""
    d = rgb_distance(a, b)
    return F.when(d <= 0.5, F.greatest(F.lit(0.0), 0.05 * (1 - d / 0.5))).otherwise(0.0)
