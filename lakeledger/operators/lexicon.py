"""A lexicon mined from names: n-grams, brands, lift and what longer phrases cover."""

from __future__ import annotations

import functools

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..options import BASE_COLORS, COMPOSITE_SEEDS, FINISH_TAGS, MODIFIER_SEEDS, STOP_WORDS
from ..sources.shared import delete_folder, new_folder
from ..sources.snapshots import SnapshotStore

LEAST_COUNT, LEAST_BRANDS, LEAST_LIFT = 5, 2, 8.0
LEAST_COLOR_COUNT, LEAST_COLOR_BRANDS = 8, 3
MOST_TERMS = 200_000  # that a task may hold; more is an error


def segments(name: Column) -> Column:
    """Words of a name in parts that ``&`` and ``/`` separate: array<array<string>>."""
    parts = F.split(F.lower(F.trim(name)), r"\s*[&/]\s*")
    return F.transform(parts, lambda p: F.filter(F.split(p, r"[^\p{L}\p{N}]+"), lambda w: (F.char_length(w) > 1) & ~w.rlike(r"^\d+[a-z]?$")))


def ngrams(names: DataFrame, name: str, brand: str, longest: int = 3) -> DataFrame:
    """(n, term, brand) for every run of up to ``longest`` words inside a segment."""
    return runs(names.select(F.col(brand).alias("brand"), F.explode(segments(F.col(name))).alias("w")), longest)


def residual_ngrams(names: DataFrame, name: str, brand: str, material: str | None, tags: dict[str, int], longest: int = 3, times: str | None = None) -> DataFrame:
    """``ngrams`` of what a name has besides vendor, material and finish; the brand as its key.

    ``times`` is a column that tells how many names a row stands for, kept as ``times``.
    """
    kept = [F.col(times).alias("times")] if times else []
    kind = F.lit(None).cast("string") if material is None else F.col(material)
    return runs(names.select(text.vendor_key(F.col(brand)).alias("brand"), F.explode(text.residual_words(F.col(name), F.col(brand), kind, tags)).alias("w"), *kept), longest)


def runs(words: DataFrame, longest: int) -> DataFrame:
    """(n, term, brand) of segments (brand, w); all lengths in one pass over the words."""
    each = []
    for n in range(1, longest + 1):
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>"))
        each.append(_numbered(_runs(starts, n), n))
    kept = [c for c in words.columns if c == "times"]
    return words.select("brand", *kept, F.inline(F.concat(*each))).select("n", "term", "brand", *kept)


def _numbered(terms: Column, n: int) -> Column:
    return F.transform(terms, lambda t: F.struct(F.lit(n).alias("n"), t.alias("term")))


def _runs(starts: Column, n: int) -> Column:
    return F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))


def counts(grams: DataFrame) -> DataFrame:
    """How often each term stands, and under how many brands."""
    freq = F.sum("times") if "times" in grams.columns else F.count("*")
    return grams.groupBy("n", "term").agg(freq.alias("freq"), F.count_distinct("brand").alias("brands"))


def lifts(counted: DataFrame, n_names: Column) -> DataFrame:
    """Bigrams with freq(ab) * N / (freq(a) * freq(b))."""
    uni = counted.filter("n = 1").select(F.col("term").alias("word"), F.col("freq").alias("f"))
    pairs = counted.filter("n = 2").withColumn("a", F.split("term", " ")[0]).withColumn("b", F.split("term", " ")[1])
    rows = pairs.join(uni.select(F.col("word").alias("a"), F.col("f").alias("fa")), "a").join(uni.select(F.col("word").alias("b"), F.col("f").alias("fb")), "b")
    return rows.select("term", "freq", "brands", (F.col("freq") * n_names / (F.col("fa") * F.col("fb"))).alias("lift"))


def mine(
    names: DataFrame, name: str, brand: str, material: str | None = None, stop: tuple[str, ...] = STOP_WORDS, seeds: tuple[str, ...] = MODIFIER_SEEDS,
    composites: tuple[str, ...] = COMPOSITE_SEEDS, base: tuple[str, ...] = BASE_COLORS, tags: dict[str, int] = FINISH_TAGS,
) -> DataFrame:
    """(kind, term, n, freq): modifiers and colors, longest first, then by term; a seed that does not occur has freq 0.

    Modifiers are frequent terms of several brands, bigrams with lift, without what longer ones cover;
    and the seeds.  Colors are the base ones and what ``promoted`` finds.  The counts, a row for
    each distinct term, are used several times and stay cached, on disk where they do not fit.
    """
    kinds = list(dict.fromkeys(c for c in (name, brand, material) if c))
    said = names.groupBy(*kinds).agg(F.count(F.lit(1)).alias("_times")).repartition(4 * names.sparkSession.sparkContext.defaultParallelism, *kinds)  # each name that is written alike is scanned once
    counted = counts(residual_ngrams(said, name, brand, material, tags, times="_times")).persist(StorageLevel.MEMORY_AND_DISK)
    return mine_counted(counted, names.count(), stop, seeds, composites, base)


def mine_counted(
    counted: DataFrame, n_names: int, stop: tuple[str, ...] = STOP_WORDS, seeds: tuple[str, ...] = MODIFIER_SEEDS,
    composites: tuple[str, ...] = COMPOSITE_SEEDS, base: tuple[str, ...] = BASE_COLORS,
) -> DataFrame:
    """``mine`` from counts (n, term, freq, brands) of ``n_names`` names, wherever they come from."""
    often = counted.filter((F.col("freq") >= LEAST_COUNT) & (F.col("brands") >= LEAST_BRANDS) & ~((F.col("n") == 1) & F.col("term").isin(*stop)))
    pairs = lifts(counted, F.lit(n_names)).filter(F.col("lift") >= LEAST_LIFT).select("term")
    kept = often.filter("n <> 2").unionByName(often.filter("n = 2").join(pairs, "term", "left_semi").select(*often.columns))
    longer = kept.filter("n > 1").select("n", F.split("term", " ").alias("w"))
    inner = longer.select(F.explode("w").alias("term")).union(longer.filter("n = 3").select(F.explode(F.array(F.concat_ws(" ", F.col("w")[0], F.col("w")[1]), F.concat_ws(" ", F.col("w")[1], F.col("w")[2])))))
    mined = kept.join(inner.distinct(), "term", "left_anti").filter(~F.col("term").isin(*base))
    found = mined.filter(~F.col("term").isin(*stop)).select(F.lit("modifier").alias("kind"), "term", "n", "freq")
    found = found.unionByName(promoted(counted, mined, (*base, *stop, *seeds)).select(F.lit("color").alias("kind"), "term", "n", "freq"))
    fixed = [("modifier", s, len(s.split())) for s in sorted({*seeds, *composites} - {*stop, *base})] + [("color", c, len(c.split())) for c in sorted({*base})]
    always = counted.sparkSession.createDataFrame(fixed, "kind string, term string, n int")
    always = always.join(counted.select("term", "freq"), "term", "left").select("kind", "term", "n", F.coalesce("freq", F.lit(0)).alias("freq"))
    return found.unionByName(always.join(found.select("kind", "term"), ["kind", "term"], "left_anti").select(*found.columns)).orderBy(F.col("kind").desc(), F.col("n").desc(), "term")


#: Key of the stored counts; ``n_names`` is kept in the row of n = 0.
GRAM_KEY = ["n", "term", "brand"]


def grams_of(names: DataFrame, name: str, brand: str, material: str | None, tags: dict[str, int] = FINISH_TAGS) -> DataFrame:
    """(n, term, brand, freq): how often each brand's names have a term; the row of n = 0 counts the names."""
    each = residual_ngrams(names, name, brand, material, tags).groupBy("n", "term", "brand").agg(F.count(F.lit(1)).alias("freq"))
    whole = names.agg(F.count(F.lit(1)).alias("freq")).select(F.lit(0).alias("n"), F.lit("").alias("term"), F.lit("").alias("brand"), "freq")
    return each.unionByName(whole)


def update_counts(store: SnapshotStore, table: str, added: DataFrame | None, removed: DataFrame | None, name: str, brand: str, material: str | None) -> None:
    """Brings stored counts up to names that came and went: only terms of these names are read and written.

    Counts by brand add up and take away exactly, so the number of brands that use a term follows; terms that nobody uses
    any more are deleted.
    """
    if table not in store.manifest()[1]:
        with store.change() as step:
            step.create(table, grams_of(added, name, brand, material), GRAM_KEY)
        return
    signed = [grams_of(rows, name, brand, material).withColumn("freq", F.lit(sign) * F.col("freq")) for sign, rows in ((1, added), (-1, removed)) if rows is not None]
    change = functools.reduce(DataFrame.unionByName, signed).groupBy(*GRAM_KEY).agg(F.sum("freq").alias("change")).filter("change <> 0")
    now = change.join(store.read(table), GRAM_KEY, "left").select(*GRAM_KEY, (F.coalesce("freq", F.lit(0).cast("long")) + F.col("change")).alias("freq"))
    path = new_folder(store.spark, "changed-counts")
    now.write.parquet(path)
    moved = store.spark.read.schema(now.schema).parquet(path)
    with store.change() as step:
        step.upsert(table, moved.filter("freq > 0"))
        step.delete(table, moved.filter("freq <= 0").select(*GRAM_KEY))
        step.compact(table)
    delete_folder(store.spark, path)


def mine_stored(store: SnapshotStore, table: str) -> DataFrame:
    """The lexicon of stored counts: the one that ``mine`` finds in the names that they stand for."""
    rows = store.read(table)
    counted = rows.filter("n > 0").groupBy("n", "term").agg(F.sum("freq").alias("freq"), F.count(F.lit(1)).alias("brands")).persist(StorageLevel.MEMORY_AND_DISK)
    return mine_counted(counted, rows.filter("n = 0").agg(F.sum("freq")).first()[0] or 0)


def promoted(counted: DataFrame, modifiers: DataFrame, taken: tuple[str, ...]) -> DataFrame:
    """Words that become colors: frequent ones of many brands among all, covered ones too, that are neither modifiers nor ``taken``."""
    rows = counted.filter((F.col("n") == 1) & (F.col("freq") >= LEAST_COLOR_COUNT) & (F.col("brands") >= LEAST_COLOR_BRANDS) & ~F.col("term").isin(*taken))
    return rows.join(modifiers.select("term"), "term", "left_anti").select("term", "n", "freq")


def index(mined: DataFrame | None = None) -> frozenset[str]:
    """The terms by which names are decomposed, the seeds without ``mined``; a lexicon is small, and one that is not is refused."""
    if mined is None:
        return frozenset((*MODIFIER_SEEDS, *COMPOSITE_SEEDS, *BASE_COLORS))
    terms = [r["term"] for r in mined.select("term").limit(MOST_TERMS + 1).collect()]
    if len(terms) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms: raise the least counts")
    return frozenset(terms)
