"""Encoded map values, comparisons and decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode(raw: Column) -> Column:
    """A map value that is itself JSON: a text without its quotes, anything else as JSON, bad JSON as it is."""
    parsed = F.try_parse_json(raw)
    plain = F.try_variant_get(parsed, "$", "string")
    return F.when(parsed.isNull(), raw).otherwise(F.coalesce(plain, F.to_json(parsed)))


def encode(c: Column) -> Column:
    """JSON text of a string, null for null."""
    return F.when(c.isNotNull(), F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'^\{"v":(.*)\}$', 1))


def compare_form(c: Column) -> Column:
    """Text under which two catalogs' values are equal: nulls and dashes empty, whole numbers without decimals."""
    text = F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    number = text.try_cast("double")
    whole = number.isNotNull() & text.rlike(r"^[+-]?\d+(\.0*)?$")
    return F.when(text.isin("", "—", "-"), "").when(whole, number.cast("decimal(38,0)").cast("string")).otherwise(text)


def missing(c: Column, kind: str = "string") -> Column:
    """Null, empty text or empty list; zero and false are there."""
    return c.isNull() | (F.size(c) == 0 if kind == "array" else (c.cast("string") == ""))


def differ(a: Column, b: Column) -> Column:
    """Inequality in which null is a value."""
    return ~a.eqNullSafe(b)


def action(left_changed: Column, right_changed: Column, direction: Column, policy: Column, left_ts: Column, right_ts: Column) -> Column:
    """What to do about one field of a pair: noop, push_right, push_left or conflict."""
    push_right, push_left, noop, conflict = map(F.lit, ("push_right", "push_left", "noop", "conflict"))
    newest = F.when(left_ts > right_ts, push_right).when(left_ts < right_ts, push_left).otherwise(conflict)
    both = F.when(policy == "left_wins", push_right).when(policy == "right_wins", push_left).when(policy == "newest_wins", newest).otherwise(conflict)
    return (
        F.when(~left_changed & ~right_changed, noop)
        .when(direction == "left_to_right", F.when(left_changed, push_right).otherwise(noop))
        .when(direction == "right_to_left", F.when(right_changed, push_left).otherwise(noop))
        .when(left_changed & ~right_changed, push_right)
        .when(right_changed & ~left_changed, push_left)
        .otherwise(both)
    )


def _overlap(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Shared and all elements of two arrays without repeats, and whether either is empty (then nothing is shared)."""
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    shared = F.when(empty, 0).otherwise(F.size(F.array_intersect(a, b)))
    return shared, F.size(a) + F.size(b) - shared, empty


def finish_score(a: Column, b: Column) -> Column:
    shared, every, empty = _overlap(a, b)
    return F.when(every == 0, 0.05).when(empty, -0.10).when(shared == 0, -0.07).otherwise(0.10 * shared / every)


def jaccard(a: Column, b: Column) -> Column:
    shared, every, _ = _overlap(a, b)
    return F.when(every == 0, 0.5).otherwise(shared / every)


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard of two token sets, or the share of the larger that the smaller is, where it lies in it; 0.5 if one is empty."""
    shared, small, large = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    plain = shared / F.size(F.array_union(a, b))
    return F.when(small == 0, 0.5).when(shared == 0, 0.0).when(shared == small, F.greatest(plain, small / large)).otherwise(plain)


def multiset_score(a: Column, b: Column) -> Column:
    """Shared over greatest counts of two maps word -> count; 0.5 where one is empty."""
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0), lambda s, n: s + n)
    shared = F.aggregate(F.map_entries(a), F.lit(0), lambda s, e: s + F.least(e["value"], F.coalesce(F.try_element_at(b, e["key"]), F.lit(0))))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.5).otherwise(F.transform(F.array(shared), lambda n: n / (total(a) + total(b) - n))[0])


def conflict_class(field: Column, kind: Column, left: Column, right: Column) -> Column:
    """Kind of conflict as a user sees it."""
    return (
        F.when(kind == "new_record", F.when(right.isNull(), "new_left").otherwise("new_right"))
        .when(kind == "deletion", "deletion").when(kind == "master_divergence", "master_divergence")
        .when(field == "weight", "weight").when(field.isin("color", "multicolor"), "color").when(field == "location", "location").otherwise("field")
    )
