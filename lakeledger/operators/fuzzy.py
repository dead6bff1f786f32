"""Fuzzy matching against the reference catalog: block by brand, gate, score, rank."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color, text, values
from ..options import BASE_COLORS, BIOPOLYMERS, COLOR_SYNONYMS, Options
from ..sources.shared import new_folder
from ..sources.snapshots import SnapshotStore
from . import lexicon

PARTS = ("family", "brand", "color", "modifier", "finish", "hex", "name")
BASES = frozenset(BASE_COLORS)
NAME_WEIGHT = 0.05
SHARDS = 8


def parsed(segments: list[list[str]], index: frozenset[str]) -> tuple[list[str], list[str]]:
    """Modifiers, each once, and colors, as often as they stand: the longest term of three, two or one words first.

    The words of a term are consumed.  Only base colors are colors; mined ones count as modifiers, as in the reference.
    """
    modifiers: dict[str, None] = {}
    colors = []
    for words in segments:
        i = 0
        while i < len(words):
            n, term = next(((n, t) for n in (3, 2) if i + n <= len(words) and (t := " ".join(words[i : i + n])) in index), (1, words[i]))
            if n == 1 and term in BASES and term in index:
                colors.append(COLOR_SYNONYMS.get(term, term))
            elif term in index or (len(term) >= 6 and term.endswith("fill")):
                modifiers[term] = None
            i += n
    return list(modifiers), colors


def tasks(rows: DataFrame) -> int:
    """Into how many tasks rows that are few bytes but much work are dealt; Spark would put them together by their bytes."""
    return 4 * rows.sparkSession.sparkContext.defaultParallelism


def name_parts(name: Column, vendor: Column, material: Column, tags: dict[str, int], index: frozenset[str]) -> Column:
    """struct<modifiers, colors> of a name; Python scans it, once per product."""
    keywords = tuple(tags)

    @F.pandas_udf("modifiers array<string>, colors array<string>")
    def parts(names: pd.Series, vendors: pd.Series, materials: pd.Series) -> pd.DataFrame:
        rows = [parsed(text.residual(n, v, m, keywords), index) for n, v, m in zip(names, vendors, materials, strict=True)]
        return pd.DataFrame({"modifiers": pd.Series([r[0] for r in rows], dtype="object"), "colors": pd.Series([r[1] for r in rows], dtype="object")})

    return parts(name, vendor, material)


def decomposed(
    products: DataFrame, id_: str, vendor: str, name: str, material: str, hex_: str, options: Options, index: frozenset[str] | None = None,
    profile: Column | None = None, hexes: Column | None = None, tag_words: Column | None = None,
) -> DataFrame:
    """Each product once, ahead of the join: brand, family, finishes, colors with counts, modifiers, hex, color profile, hexes and arity.

    ``index`` holds the terms of a mined lexicon (``lexicon.index``), else the seeds; ``profile`` and ``hexes`` (how many)
    are for catalogs with multiple colors, ``tag_words`` for one that has finishes as words beside the name.
    """
    index = lexicon.index() if index is None else index
    # a family is told by the material alone: once for each distinct one, as it takes many patterns
    kinds = products.select(F.col(material).alias("_material")).distinct().select("_material", text.material_family(F.col("_material"), options.finish_tags).alias("_family"))
    # what the texts tell is worked out once for each that is written alike; these are few bytes, so their number of tasks is given
    said = products.select(F.col(name).alias("_name"), F.col(vendor).alias("_vendor"), F.col(material).alias("_kind"), *([] if tag_words is None else [tag_words.alias("_tags")])).distinct()
    said = said.repartition(tasks(products), "_name", "_vendor", "_kind").join(kinds, F.col("_kind").eqNullSafe(F.col("_material")))
    said = said.withColumn("_parts", name_parts(F.col("_name"), F.col("_vendor"), F.col("_kind"), options.finish_tags, index))
    named = F.col("_parts")["colors"]
    found = F.map_from_entries(F.transform(F.array_distinct(named), lambda w: F.struct(w, F.size(F.filter(named, lambda x: x == w)))))
    kind = F.col("_kind") if tag_words is None else F.concat_ws(" ", "_kind", "_tags")
    told = {
        "brand": text.vendor_key(F.col("_vendor"), options.vendor_aliases), "name": text.name_key(F.col("_name")), "family": F.col("_family"), "finishes": text.finish_ids(F.col("_name"), kind, options.finish_tags),
        "colors": found, "modifiers": F.col("_parts")["modifiers"], "n_named": F.size(named),
    }
    texts = [c for c in said.columns if c in ("_name", "_vendor", "_kind", "_tags")]
    said = said.select(*texts, F.struct(*(c.alias(k) for k, c in told.items())).alias("_told"))
    alike = [F.col(name).eqNullSafe(F.col("_name")), F.col(vendor).eqNullSafe(F.col("_vendor")), F.col(material).eqNullSafe(F.col("_kind")), *([] if tag_words is None else [tag_words.eqNullSafe(F.col("_tags"))])]
    hexes = F.when(F.coalesce(F.col(hex_), F.lit("")) != "", 1).otherwise(0) if hexes is None else hexes
    return products.join(said, functools.reduce(Column.__and__, alike)).select(
        F.col(id_).alias("id"), *(F.col("_told")[k].alias(k) for k in told if k != "n_named"), F.col(hex_).alias("hex"),
        (F.lit("single") if profile is None else profile).alias("profile"), hexes.alias("hexes"), color.arity(hexes, F.col("_told")["n_named"]).alias("arity"),
    )


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of one brand that pass the family and color gates, columns as ``a_...`` and ``b_...``.

    Brand and family block are the key of the join.  A block has many pairs for its rows, so the left ones are dealt to
    shards, each of which has the block's right ones, and the number of tasks does not follow the bytes.
    """
    n, shards = tasks(left), F.lit(SHARDS)
    a, b = (df.select(*(F.col(c).alias(f"{p}_{c}") for c in df.columns), color.rgb(F.col("hex")).alias(f"{p}_rgb")) for p, df in (("a", left), ("b", right)))
    a, b = a.withColumn("_shard", F.pmod(F.xxhash64("a_id"), shards)), b.withColumn("_shard_b", F.explode(F.sequence(F.lit(0).cast("long"), shards.cast("long") - 1)))
    profiles = color.profiles_fit_softly(*(F.col(f"{p}_{c}") for c in ("profile", "hexes", "arity") for p in "ab"))
    # families fit where they are of one block (biopolymers are one), or where the right one is unknown
    block = lambda c: F.when(c.isin(*BIOPOLYMERS), BIOPOLYMERS[0]).otherwise(c)
    a, b = a.withColumn("_block", block(F.col("a_family"))), b.withColumn("_block_b", block(F.col("b_family")))
    brand = (F.col("a_brand") == F.col("b_brand")) & (F.col("_shard") == F.col("_shard_b"))
    dealt = lambda left_rows, right_rows, left_keys, right_keys, on: left_rows.repartition(n, *left_keys).join(right_rows.repartition(n, *right_keys).hint("shuffle_hash"), on & profiles)
    known = dealt(a, b, ("a_brand", "_shard", "_block"), ("b_brand", "_shard_b", "_block_b"), brand & (F.col("_block") == F.col("_block_b")))
    unknown = dealt(a.filter("_block != ''"), b.filter("b_family = ''"), ("a_brand", "_shard"), ("b_brand", "_shard_b"), brand)
    return known.unionByName(unknown).drop("_shard", "_shard_b", "_block", "_block_b")


def total(name: Column) -> Column:
    """The score of a pair of ``paired`` whose names are as similar as ``name`` says."""
    half = F.when(F.contains("a_family", F.col("b_family")) | F.contains("b_family", F.col("a_family")), 0.5).otherwise(0.0)
    parts = {
        "family": 0.15 * F.when(F.col("a_family") == F.col("b_family"), 1.0).otherwise(half),
        "brand": F.lit(0.15),
        "color": 0.40 * values.multiset_score(F.col("a_colors"), F.col("b_colors")),
        "modifier": 0.15 * values.jaccard(F.col("a_modifiers"), F.col("b_modifiers")),
        "finish": values.finish_score(F.col("a_finishes"), F.col("b_finishes")),
        "hex": color.hex_score(F.col("a_rgb"), F.col("b_rgb")),
        "name": NAME_WEIGHT * name,
    }
    out: Column = F.lit(0.0)
    for p in PARTS:
        out = out + parts[p]
    return out


def scored(left: DataFrame, right: DataFrame, with_names: bool = False) -> DataFrame:
    """(left_id, right_id, score) of all ``paired``; ``with_names`` adds the similarity of the names, which only Python computes."""
    name = text.sequence_ratio(F.col("a_name"), F.col("b_name")) if with_names else F.lit(0.0)
    return paired(left, right).select(F.col("a_id").alias("left_id"), F.col("b_id").alias("right_id"), F.round(total(name), 4).alias("score"))


def open_pairs(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """(left_id, right_id, base, a_name, b_name): the pairs that may be among a left product's ``most`` best once names count.

    Two names share at most the letters that both have, so ``base`` (the score without names) with that bound must
    reach the score that ``most`` pairs have without their names.  All of it runs in the JVM.
    """
    lettered = lambda df: df.withColumn("letters", text.letters(F.col("name")))
    bound = text.ratio_bound(F.col("a_letters"), F.col("b_letters"), F.col("a_name"), F.col("b_name"))
    rows = paired(lettered(left), lettered(right)).select(F.col("a_id").alias("left_id"), F.col("b_id").alias("right_id"), total(F.lit(0.0)).alias("base"), bound.alias("bound"), "a_name", "b_name")
    rows = rows.withColumn("score", F.round("base", 4))
    sure = _best(rows.select("left_id", "right_id", "score"), "left_id", [F.col("score").desc(), F.col("right_id")], most, "right_id")
    least = sure.groupBy("left_id").agg(F.when(F.count(F.lit(1)) == most, F.min("score")).alias("least"))
    reach = F.round(F.col("base") + NAME_WEIGHT * F.col("bound"), 4)
    return rows.join(least, "left_id").filter(F.coalesce(reach >= F.col("least"), F.lit(True))).select("left_id", "right_id", "base", "a_name", "b_name")


def named(pairs: DataFrame) -> DataFrame:
    """(left_id, right_id, score) of ``open_pairs``; Python compares each pair of names once."""
    ratio = text.sequence_ratio(F.col("a_name"), F.col("b_name"))
    ratios = pairs.select("a_name", "b_name").distinct().withColumn("ratio", ratio)
    return pairs.join(ratios, ["a_name", "b_name"]).select("left_id", "right_id", F.round(F.col("base") + NAME_WEIGHT * F.col("ratio"), 4).alias("score"))


def _best(rows: DataFrame, key: str, order: list[Column], most: int, by: str) -> DataFrame:
    """The first ``most`` rows of each ``key`` with their ``rank``; a first selection per (key, shard) bounds what meets in one window."""
    dealt = rows.withColumn("_shard", F.pmod(F.xxhash64(by), F.lit(16)))
    dealt = dealt.withColumn("rank", F.row_number().over(Window.partitionBy(key, "_shard").orderBy(*order))).filter(F.col("rank") <= most)
    return dealt.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= most).drop("_shard")


def ranked(pairs: DataFrame, options: Options) -> DataFrame:
    """The best right product of each left one and its alternates, in order of score, then of id.

    Below the least score there is no best; then the alternates begin at the top row.
    """
    most = options.alternates + 1
    rows = _best(pairs, "left_id", [F.col("score").desc(), F.col("right_id")], most, "right_id")
    top = F.max(F.when(F.col("rank") == 1, F.col("score"))).over(Window.partitionBy("left_id"))
    role = F.when((F.col("rank") == 1) & (F.col("score") >= options.least_match), "best").otherwise("alternate")
    return rows.withColumn("_top", top).withColumn("role", role).filter((F.col("_top") >= options.least_match) | (F.col("rank") <= options.alternates)).select("left_id", "right_id", "score", "rank", "role")


def _alike(products: DataFrame, with_names: bool) -> DataFrame:
    """Products with ``key``, equal where a score cannot tell them apart."""
    entries = F.array_sort(F.map_entries("colors"))
    seen = F.struct("brand", "family", "finishes", entries.alias("colors"), F.array_sort("modifiers").alias("modifiers"), "hex", "profile", "hexes", "arity", *(["name"] if with_names else []))
    return products.withColumn("key", F.sha2(F.to_json(seen), 256))


def matches(left: DataFrame, right: DataFrame, options: Options, with_names: bool = False) -> DataFrame:
    """``ranked(scored(left, right))``, but products that a score cannot tell apart are scored once.

    Of a left group the best right groups, by score and least id, are as many as rows are asked
    for: each holds a row that comes before all rows of a later group.  Of a right group as many
    of the least ids can appear.
    """
    most = options.alternates + 1
    a, b = _alike(left, with_names), _alike(right, with_names)
    ours, theirs = _groups(a, F.first("key")), _groups(b, F.min("id"))
    groups = named(open_pairs(ours, theirs, most)) if with_names else scored(ours, theirs)
    best = _best(groups, "left_id", [F.col("score").desc(), F.col("right_id")], most, "right_id").withColumnRenamed("right_id", "first_id").drop("rank")
    members = _best(b.select("key", "id"), "key", [F.col("id").asc()], most, "id")
    members = members.join(members.filter("rank = 1").select("key", F.col("id").alias("first_id")), "key").select("first_id", F.col("id").alias("right_id"))
    rows = ranked(best.join(members, "first_id").select("left_id", "right_id", "score"), options).withColumnRenamed("left_id", "key")
    return a.select("key", F.col("id").alias("left_id")).join(rows, "key").drop("key")


def _groups(alike: DataFrame, id_: Column) -> DataFrame:
    """One row for each key of ``_alike``, with ``id_`` as its id."""
    return alike.groupBy("key").agg(id_.alias("id"), *(F.first(c).alias(c) for c in alike.columns if c not in ("id", "key"))).drop("key")


def best_scores(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, score): the score of each left product's best right one; none for those that pass no gate."""
    a = _alike(left, False)
    best = scored(_groups(a, F.first("key")), _groups(_alike(right, False), F.min("id"))).groupBy("left_id").agg(F.max("score").alias("score"))
    return a.select("key", F.col("id").alias("left_id")).join(best.withColumnRenamed("left_id", "key"), "key").drop("key")


def block_digests(left: DataFrame, right: DataFrame, settings: str) -> DataFrame:
    """(brand, digest): what a block's matches depend on, whatever the order of its rows.

    The block is the brand, the one part of the join that every pair shares.  A row's hash is cut into four numbers that are
    summed up, so no block's rows meet in one place.
    """
    facts = F.to_json(F.struct("id", "family", "finishes", F.array_sort(F.map_entries("colors")).alias("colors"), F.array_sort("modifiers").alias("modifiers"), "hex", "profile", "hexes", "arity"))
    hashed = [df.select("brand", F.sha2(F.concat(F.lit(side), facts), 256).alias("h")) for side, df in (("l", left), ("r", right))]
    part = lambda k: F.sum(F.conv(F.substr("h", F.lit(1 + 12 * k), F.lit(12)), 16, 10).cast("decimal(38,0)")).cast("string")
    sums = hashed[0].unionByName(hashed[1]).groupBy("brand").agg(F.count(F.lit(1)).alias("n"), F.concat_ws(":", *(part(k) for k in range(4))).alias("sums"))
    return sums.select("brand", F.sha2(F.concat_ws("|", F.lit(settings), F.col("n").cast("string"), "sums"), 256).alias("digest"))


def cached_matches(store: SnapshotStore, left: DataFrame, right: DataFrame, options: Options) -> int:
    """Brings the store's tables ``match_blocks`` and ``matches`` up to these catalogs; returns how many blocks were scored.

    Blocks whose digest is as it was keep their matches; the others' are replaced, those of brands that are gone are
    deleted, all in one step.
    """
    digests = block_digests(left, right, repr(options))
    if "matches" not in store.manifest()[1]:
        with store.change() as step:
            step.create("match_blocks", digests.limit(0), ["brand"], buckets=8)
            step.create("matches", ranked(scored(left, right), options).limit(0).withColumn("brand", F.lit("")), ["left_id", "right_id"], buckets=16)
    stored, then = store.read("match_blocks"), store.read("matches")
    path = new_folder(left.sparkSession, "blocks")
    both = digests.join(stored.withColumnRenamed("digest", "was"), "brand", "full")
    both.filter(~F.col("digest").eqNullSafe(F.col("was"))).select("brand", "digest").write.parquet(path)
    moved = left.sparkSession.read.schema("brand string, digest string").parquet(path)
    if moved.isEmpty():
        return 0
    brands = moved.select("brand")
    new = matches(left.join(brands, "brand", "left_semi").select(*left.columns), right.join(brands, "brand", "left_semi").select(*right.columns), options)
    new = new.join(left.select(F.col("id").alias("left_id"), "brand"), "left_id")
    with store.change() as step:
        step.delete("matches", then.join(brands, "brand", "left_semi").select("left_id", "right_id"))
        step.upsert("matches", new.select(*then.columns))
        step.delete("match_blocks", brands)
        step.upsert("match_blocks", moved.filter("digest is not null"))
        step.compact("matches", most=8)
    return brands.count()


def pinned(ranked_rows: DataFrame, identities: DataFrame) -> DataFrame:
    """Known identities (left_id, right_id) as best matches of score 1; the scored rows become alternates."""
    sure = identities.select("left_id", "right_id", F.lit(1.0).alias("score"), F.lit(1).alias("rank"), F.lit("best").alias("role"))
    rest = ranked_rows.join(identities, ["left_id", "right_id"], "left_anti")
    known = identities.select("left_id", F.lit(True).alias("_sure"))
    rest = rest.join(known, "left_id", "left").withColumn("role", F.when(F.col("_sure"), "alternate").otherwise(F.col("role"))).drop("_sure")
    return sure.unionByName(rest)


def field_rows(matches: DataFrame, left: DataFrame, right: DataFrame, fields: dict[str, str]) -> DataFrame:
    """A row per matched pair and field: both values, whether they differ and would be written."""
    a = left.select(F.col("id").alias("left_id"), F.array(*(F.struct(F.lit(x).alias("field"), F.col(x).cast("string").alias("left")) for x in fields)).alias("_a"))
    b = right.select(F.col("id").alias("right_id"), F.array(*(F.col(y).cast("string") for y in fields.values())).alias("_b"))
    rows = matches.select("left_id", "right_id").join(a, "left_id").join(b, "right_id").select("left_id", "right_id", F.inline(F.zip_with("_a", "_b", lambda x, y: F.struct(x["field"].alias("field"), x["left"].alias("left"), y.alias("right")))))
    unlike = values.compare_form(F.col("left")) != values.compare_form(F.col("right"))
    return rows.withColumn("differs", unlike).withColumn("writes", unlike & ~values.missing(F.col("right")))


def patch(rows: DataFrame, keep_mine: DataFrame | None = None) -> DataFrame:
    """(left_id, patch): the fields to write as one map; chosen (left_id, field) keep the left value."""
    rows = rows.filter("writes")
    if keep_mine is not None:
        rows = rows.join(keep_mine, ["left_id", "field"], "left_anti")
    return rows.groupBy("left_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "right")))).alias("patch"))


def unmatched_reason(left: DataFrame, brands: DataFrame, matched: DataFrame, passed: DataFrame) -> DataFrame:
    """Why a product has no match: no vendor, unknown brand, nothing past the gates, or a low score."""
    rows = left.join(matched.select(F.col("left_id").alias("id")), "id", "left_anti")
    rows = rows.join(brands.select("brand", F.lit(True).alias("_known")), "brand", "left").join(passed.select(F.col("left_id").alias("id"), F.lit(True).alias("_passed")).distinct(), "id", "left")
    reason = F.when(F.col("brand") == "", "no_vendor").when(F.col("_known").isNull(), "unknown_brand").when(F.col("_passed").isNull(), "gated").otherwise("low_score")
    return rows.select("id", reason.alias("reason"))


def package_totals(packages: DataFrame, containers: DataFrame) -> DataFrame:
    """By material, the number of packages, and net weight and tare from the first package that has each, in package order; of packages of one place the least value."""
    rows = packages.join(containers.select(F.col("slug").alias("container"), "tare"), "container", "left")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("ord", c)))
    return rows.groupBy("material").agg(F.count(F.lit(1)).alias("n_packages"), first("net").alias("net"), first("tare").alias("tare"))


def package_weights(materials: DataFrame, packages: DataFrame, containers: DataFrame) -> DataFrame:
    """Net weight and tare of a material, as ``package_totals`` finds them; nulls where it has no package."""
    found = package_totals(packages, containers)
    return materials.join(found, materials["slug"] == found["material"], "left").select("slug", "net", "tare")


def completeness(tagged: DataFrame, materials: DataFrame, fields: list[str]) -> DataFrame:
    """Tagged products with the reference fields that are missing; tags without a material are stale."""
    rows = tagged.join(materials.withColumn("_there", F.lit(True)), "uuid", "left")
    gone = F.filter(F.array(*(F.when(values.missing(F.col(f)), F.lit(f)) for f in fields)), lambda f: f.isNotNull())
    none = F.array().cast("array<string>")
    return rows.select("id", "uuid", F.col("_there").isNull().alias("stale"), F.when(F.col("_there").isNull(), none).otherwise(gone).alias("missing")).withColumn("n_missing", F.size("missing"))


def search(reference: DataFrame, probe: DataFrame, options: Options, limit: int) -> DataFrame:
    """Manual search: a probe row scored against the reference, at most 50 results (a top-k report).

    The gate is narrower than in matching: the family is unknown or equal.
    """
    rows = scored(probe, reference.join(probe.select(F.col("family").alias("_f")), (F.col("family") == "") | (F.col("_f") == "") | (F.col("family") == F.col("_f"))).drop("_f"))
    return rows.orderBy(F.col("score").desc(), "right_id").limit(min(limit, 50))
