"""Keys, names, finishes and labels."""

from __future__ import annotations

import difflib
import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..options import BIOPOLYMERS, COLOR_WORDS, FAMILY_PREFIXES

# Finishes in the order in which they are tried.
FINISH_LEXICON = (
    ("glow", r"glow[\s-]in[\s-]the[\s-]dark|\bgitd\b|\bglow\b"),
    ("cf", r"carbon[\s-]?fib(er|re)|\bcf\b"),
    ("multicolor", r"multi[\s-]?color|tri[\s-]?color|\brainbow\b|dual[\s-]?color"),
    ("hs", r"high[\s-]speed|\bhs\b"),
    ("metallic", r"\bmetallic\b"), ("marble", r"\bmarble\b"), ("wood", r"\bwood\b"), ("matte", r"\bmatte\b"), ("satin", r"\bsatin\b"), ("silk", r"\bsilk\b"),
)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode NFKC, which has no built-in; apply it once to raw names, ahead of the keys below."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def composed(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with ``columns`` in Unicode NFKC.  Rows of plain ASCII, which are in it already, never leave the JVM."""
    plain = functools.reduce(lambda a, b: a & b, (~_text(F.col(c)).rlike(r"[^\x00-\x7F]") for c in columns))
    return rows.filter(plain).unionByName(rows.filter(~plain).withColumns({c: nfkc(F.col(c)) for c in columns}))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp similarity of two names; edit distance is not equivalent."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def letters(name: Column) -> Column:
    """How often each character stands in a name."""
    chars = F.filter(F.split(_text(name), ""), lambda c: c != "")
    return F.map_from_entries(F.transform(F.array_distinct(chars), lambda c: F.struct(c, F.size(F.filter(chars, lambda x: x == c)))))


def ratio_bound(a: Column, b: Column, name_a: Column, name_b: Column) -> Column:
    """At least ``sequence_ratio`` of two names: twice the characters that both have (``letters``), over all; built-in functions only."""
    both = F.aggregate(F.map_entries(a), F.lit(0), lambda n, e: n + F.least(e["value"], F.coalesce(F.try_element_at(b, e["key"]), F.lit(0))))
    every = F.char_length(_text(name_a)) + F.char_length(_text(name_b))
    return F.when(every == 0, 1.0).otherwise(2.0 * both / every)


def _bare(v: str | None) -> str:
    return unicodedata.normalize("NFKC", v or "").lower().strip()


@functools.lru_cache(10_000)
def _unwanted(vendor: str, material: str, tags: tuple[str, ...]) -> tuple[re.Pattern, ...]:
    """Whole words of vendor, base material, material and finishes, in the order in which they are removed."""
    longest = sorted((t.lower() for t in tags), key=len, reverse=True)
    base = material
    for word in longest:
        base = re.sub(rf"(?:^|[\s\-])?{re.escape(word)}(?:[\s\-]|$)?", " ", base, flags=re.IGNORECASE)
    words = dict.fromkeys((*vendor.split(), *(base.split() or material.split()), *material.split(), *longest))
    return tuple(re.compile(rf"\b{re.escape(w)}\b") for w in words)


def residual(name: str | None, vendor: str | None, material: str | None, tags: tuple[str, ...]) -> list[list[str]]:
    """Words of a name in parts that ``&`` and ``/`` separate, without those of vendor, material and finishes.

    Single characters, numbers and grades such as 95a are no words.
    """
    line = _bare(name)
    for pattern in _unwanted(_bare(vendor), _bare(material), tags):
        line = pattern.sub(" ", line)
    parts = ((w for w in re.split(r"[^a-z0-9_]+", part) if len(w) > 1 and not re.match(r"^\d+[a-z]?$", w)) for part in re.split("[&/]", line))
    return [words for part in parts if (words := list(part))]


def residual_words(name: Column, vendor: Column, material: Column, tags: dict[str, int]) -> Column:
    """``residual`` as array<array<string>>; the patterns depend on the row, so Python applies them."""
    keywords = tuple(tags)

    @F.pandas_udf("array<array<string>>")
    def words(names: pd.Series, vendors: pd.Series, materials: pd.Series) -> pd.Series:
        return pd.Series([residual(n, v, m, keywords) for n, v, m in zip(names, vendors, materials, strict=True)], dtype="object")

    return words(name, vendor, material)


def name_key(c: Column) -> Column:
    """Lower case, trimmed, single spaces; null as empty."""
    return F.trim(F.regexp_replace(F.lower(_text(c)), r"\s+", " "))


def vendor_key(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """Like ``name_key`` with hyphens and underscores as spaces, through the alias map."""
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(_text(c))), "[-_]+", " "), r"\s+", " "))
    return replaced(key, aliases or {})


def replaced(c: Column, mapping: dict[str, str]) -> Column:
    """``c`` through a small map, itself where the map has nothing."""
    if not mapping:
        return c
    pairs = F.create_map(*(F.lit(x) for kv in sorted(mapping.items()) for x in kv))
    return F.coalesce(F.try_element_at(pairs, c), c)


def color_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(_text(c))), "^#+", "")


def product_key(vendor: Column, name: Column, color: Column, aliases: dict[str, str] | None = None) -> Column:
    return F.struct(vendor_key(vendor, aliases).alias("vendor"), name_key(name).alias("name"), color_key(color).alias("color"))


def without_colors(name: Column, color: Column) -> Column:
    """The name without its hex code and color words; the whole name if nothing else is left."""
    code = F.regexp_replace(_text(color), "^#+", "")
    base = F.when(code == "", _text(name)).otherwise(F.regexp_replace(_text(name), F.concat(F.lit(r"(?iu)#?\Q"), code, F.lit(r"\E")), ""))
    words = F.filter(F.split(name_key(base), " "), lambda w: ~w.isin(*COLOR_WORDS))
    return F.coalesce(F.nullif(F.array_join(words, " "), F.lit("")), name_key(name))


def finish_line(name: Column, material: Column, keywords: tuple[str, ...] | None = None) -> Column:
    """The first finish that name or material has: of ``keywords`` in their order, else of the lexicon.

    An empty tuple switches finishes off.
    """
    text = F.concat_ws(" ", _text(name), _text(material))
    if keywords is not None and not keywords:
        return F.lit("")
    rules = [(w, rf"\b\Q{w}\E\b") for w in keywords] if keywords else list(FINISH_LEXICON)
    return F.coalesce(*(F.when(text.rlike("(?iuU)" + pattern), F.lit(word)) for word, pattern in rules), F.lit(""))


def cluster_key(vendor: Column, material: Column, name: Column, keywords: tuple[str, ...] | None = None) -> Column:
    return F.struct(vendor_key(vendor).alias("vendor"), name_key(material).alias("material"), finish_line(name, material, keywords).alias("finish"))


def finish_ids(name: Column, material: Column, tags: dict[str, int]) -> Column:
    """Sorted tag ids of every finish keyword that stands in the text as a whole word."""
    text = F.concat_ws(" ", _text(name), _text(material))
    hits = F.array(*(F.when(text.rlike(rf"(?iuU)\b\Q{w}\E\b"), F.lit(i)) for w, i in tags.items()))
    return F.array_sort(F.array_distinct(F.filter(hits, lambda i: i.isNotNull())))


def without_finishes(material: Column, tags: dict[str, int]) -> Column:
    """Material without finish words, the longest first and with optional separators; itself if nothing is left."""
    out = _text(material)
    for word in sorted(tags, key=lambda w: (-len(w), w)):
        out = F.regexp_replace(out, rf"(?iu)[\s_-]*\Q{word}\E[\s_-]*", " ")
    left = F.transform(F.array(F.trim(F.regexp_replace(out, r"\s+", " "))), lambda c: F.when(c != "", c).otherwise(F.trim(_text(material))))
    return F.get(left, F.lit(0))


def material_family(material: Column, tags: dict[str, int]) -> Column:
    """Base polymer of a material; an unknown one stands for itself, null for ''."""
    family = lambda plain: F.coalesce(*(F.when(plain.startswith(p) & ~F.substr(plain, F.lit(len(p) + 1), F.lit(1)).rlike(r"\p{L}"), F.lit(f)) for p, f in FAMILY_PREFIXES), plain)
    # as an element of an array the plain material is worked out once, not once for each prefix
    found = F.transform(F.array(F.lower(without_finishes(material, tags))), family)
    return F.when(_text(material) == "", "").otherwise(F.get(found, F.lit(0)))


def families_fit(left: Column, right: Column) -> Column:
    """Whether two families may be the same product."""
    return (right == "") | (left == right) | (left.isin(*BIOPOLYMERS) & right.isin(*BIOPOLYMERS))


def scrub(c: Column) -> Column:
    """Control characters as spaces, for log lines."""
    return F.regexp_replace(_text(c), r"\p{C}", " ")


def label(*parts: Column) -> Column:
    """Non-empty parts with one space between them, null without any."""
    return F.nullif(F.concat_ws(" ", *(F.nullif(F.trim(p), F.lit("")) for p in parts)), F.lit(""))


def vendor_hint(a: Column, b: Column) -> Column:
    """A note where two vendors are spelled differently but are the same."""
    return F.when((a != b) & (vendor_key(a) == vendor_key(b)), F.concat(a, F.lit(" = "), b))


def minus_color(name: Column, color: Column) -> Column:
    """A right name without its color word as given, in lower and in title case; the whole name if nothing is left."""
    word = _text(color)
    cut = lambda c, w: F.when(w == "", c).otherwise(F.replace(c, w, F.lit("")))
    return F.coalesce(F.nullif(name_key(cut(cut(cut(_text(name), word), F.lower(word)), F.initcap(word))), F.lit("")), name_key(name))


def container_name(vendor: Column, material: Column, finish: Column, marker: Column) -> Column:
    """Name of a family's container: vendor, material and finish, with a marker that sets it apart from its members."""
    return F.concat_ws(" ", label(vendor, material, finish), marker)


def display_name(vendor: Column, material: Column, name: Column) -> Column:
    """Name of a new product: vendor and material in front, each unless the name has it already; without a name
    what there is of them."""
    key = name_key(name)
    front = F.when((name_key(vendor) != "") & ~key.startswith(name_key(vendor)), F.trim(vendor))
    middle = F.when((name_key(material) != "") & ~F.contains(key, name_key(material)), F.trim(material))
    return F.concat_ws(" ", front, middle, F.nullif(F.trim(_text(name)), F.lit("")))


def tags_to_csv(tags: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(tags)), ",")


def tags_from_csv(text: Column) -> Column:
    """Tag ids from a comma list or a JSON array; what is not a number is skipped."""
    parts = F.split(F.regexp_replace(_text(text), r"[\[\]\"\s]", ""), ",")
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda p: p.try_cast("int")), lambda i: i.isNotNull())))
