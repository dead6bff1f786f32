"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line goes if an equal line, or one within one edit (a character put in, taken out or changed),
starts earlier in the order of (id, line number).  One edit counts as the same line only where it is
at most a twentieth of it, so lines of fewer than ``least_chars`` (20) characters match exactly, else
"1." and "2." would be one line; ``least_chars=1`` gives every line the bound.  Lines without a
visible character always stay.

Two lines within one edit agree in the first or in the last half, counted in the length of the
shorter.  So the neighbourhoods are built in three steps, each for the survivors of the one
before: lines that share a half with another line; among these, lines that agree but for one
segment (64 characters, or a 64th of a long half); and only for that segment all variants with one character deleted, as
hashed keys.  Equal keys meet at the earliest line of the group, never pair by pair, and the edit
distance to that line is verified on the whole texts.

Results: a null text has one empty line; a null id counts as the smallest; rows that share an id
are one document, whose line number stays if it stays for one of them.  Extra columns pass
through ``drop_repeated_lines`` unchanged, but for ``n_chars``, which follows the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import null_safe_id, written

LEAST_CHARS, SEGMENT, SEGMENTS = 20, 64, 64


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _visible(line: Column) -> Column:
    return line.rlike(r"[^\s]")


def _left(text: Column, n: Column) -> Column:
    return F.substr(text, F.lit(1), n)


def _right(text: Column, n: Column) -> Column:
    return F.when(n > 0, F.substr(text, F.char_length(text) - n + 1)).otherwise("")


def _half_keys(line: Column) -> Column:
    """Keys of the shared first or last half, for partners of the same length or longer, then shorter."""
    keys = []
    for shorter in (0, 1):
        m = F.char_length(line) - shorter
        h = F.floor(m / 2).cast("int")
        keys += [F.xxhash64(m, F.lit("first"), _left(line, h)), F.xxhash64(m, F.lit("last"), _right(line, m - h))]
    return F.array(*keys)


def _shared(rows: DataFrame, key: str, line: str) -> DataFrame:
    """The values of ``key`` under which two different lines stand."""
    return rows.groupBy(key).agg(F.min(line).alias("lo"), F.max(line).alias("hi")).filter("lo < hi").select(key)


def _tagged(keys: Column, kind: str) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("variant")))


def _near_lines(docs: DataFrame, firsts: DataFrame, least_chars: int) -> DataFrame:
    """(id, no) of first lines that lie within one edit of an earlier one."""
    place = F.struct("id", "no")
    halves = firsts.filter("keys is not null").select("id", "no", F.posexplode("keys").alias("role", "key"))
    # a line's hash tells different lines apart; its place is as good and is already there
    halves = halves.join(_shared(halves.withColumn("place", place), "key", "place"), "key", "left_semi")
    lines = written(
        docs.select("id", _lines(F.col("text")).alias("lines")).join(halves, "id").select("id", "no", "role", "key", F.get("lines", F.col("no")).alias("line")).filter(F.char_length("line") >= least_chars),
        "halves",
    )

    m = F.char_length("line") - F.floor(F.col("role") / 2)
    h = F.floor(m / 2)
    first_shared = F.col("role") % 2 == 0
    rest = lines.select(
        "id", "no", "role", "key",
        F.when(first_shared, F.substr("line", (h + 1).cast("int"))).otherwise(_left(F.col("line"), (F.char_length("line") - (m - h)).cast("int"))).alias("rest"),
        F.when(first_shared, m - h).otherwise(h).cast("int").alias("width"),
    )
    # long halves have 64 segments, whose keys and variants then cost about as much as one another
    size = F.greatest(F.lit(SEGMENT), F.ceil(F.col("width") / SEGMENTS).cast("int"))
    cut = rest.withColumn("size", size).withColumn("j", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("width") / F.col("size")) - 1).cast("int"))))
    before = _left(F.col("rest"), F.col("j") * F.col("size"))
    n_after = F.greatest(F.lit(0), F.col("width") - (F.col("j") + 1) * F.col("size"))
    segments = cut.select(
        "id", "no", "role",
        F.xxhash64("key", "j", before, _right(F.col("rest"), n_after)).alias("key"),
        F.substr("rest", F.col("j") * F.col("size") + 1, F.char_length("rest") - F.col("j") * F.col("size") - n_after).alias("middle"),
    )
    segments = segments.join(_shared(segments.withColumn("place", place), "key", "place"), "key", "left_semi")

    # variants: of the longer line each deletion; of the shorter itself; of equal lengths each deletion with its place
    at = F.sequence(F.lit(1), F.char_length("middle"))
    without = lambda i: F.concat(F.substr("middle", F.lit(1), i - 1), F.substr("middle", i + 1))
    of_longer = F.array_distinct(F.transform(at, lambda i: F.xxhash64("key", F.lit("longer"), without(i))))
    swapped = F.transform(at, lambda i: F.xxhash64("key", i, without(i)))
    as_shorter = F.array(F.xxhash64("key", F.lit("longer"), "middle"))
    some = F.char_length("middle") > 0
    none = F.array().cast("array<bigint>")
    kinds = [("longer", F.when((F.col("role") >= 2) & some, of_longer).otherwise(none)), ("swapped", F.when((F.col("role") < 2) & some, swapped).otherwise(none)), ("shorter", F.when(F.col("role") < 2, as_shorter).otherwise(none))]
    every = F.concat(*(_tagged(keys, kind) for kind, keys in kinds))
    variants = written(segments.select("id", "no", F.inline(every)), "variants")
    leads = variants.groupBy("variant").agg(*(F.min(F.when(F.col("kind") == kind, place)).alias(kind) for kind, _ in kinds))
    lead = F.when(F.col("kind") == "swapped", F.col("swapped")).when(F.col("kind") == "longer", F.col("shorter")).otherwise(F.col("longer"))
    pairs = variants.join(leads, "variant").select("id", "no", lead.alias("lead")).filter(F.col("lead") < place).distinct()
    whole = lines.select("id", "no", "line").distinct()
    pairs = pairs.join(whole, ["id", "no"]).select(F.col("id").alias("of_id"), F.col("no").alias("of_no"), F.col("line").alias("of_line"), F.col("lead.id").alias("id"), F.col("lead.no").alias("no"))
    return pairs.join(whole, ["id", "no"]).filter(F.levenshtein("line", "of_line", 1) == 1).select(F.col("of_id").alias("id"), F.col("of_no").alias("no")).distinct()


def kept_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(id, kept): the sorted numbers of each document's visible lines that stay, where some do."""
    own = docs.select(null_safe_id().alias("id"), "text")
    lines = own.select("id", F.posexplode(_lines(F.col("text"))).alias("no", "line")).filter(_visible(F.col("line")))
    keyed = lines.select("id", "no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.when(F.char_length("line") >= least_chars, _half_keys(F.col("line"))).alias("keys"))
    firsts = written(
        keyed.groupBy("h1", "h2").agg(F.min(F.struct("id", "no")).alias("at"), F.first("keys").alias("keys")).select("at.id", "at.no", "keys"),
        "first-lines",
    )
    near = _near_lines(own, firsts, least_chars)
    return firsts.select("id", "no").join(near, ["id", "no"], "left_anti").groupBy("id").agg(F.array_sort(F.collect_set("no")).alias("kept"))


def repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Per document: lines, lines removed, and the numbers of the lines that stay, comma-joined."""
    lines = _lines(F.col("text"))
    blank = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: ~_visible(F.get(lines, i)))
    counts = docs.select("doc_id", null_safe_id().alias("id"), F.size(lines).alias("n_lines"), blank.alias("blank"))
    kept = F.array_sort(F.array_union(F.coalesce("kept", F.array().cast("array<int>")), F.col("blank")))
    out = counts.join(kept_lines(docs, least_chars), "id", "left").select("doc_id", F.col("n_lines").cast("long"), F.filter(kept, lambda i: i < F.col("n_lines")).alias("stay"))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.size("stay")).alias("n_removed"), F.array_join("stay", ",").alias("kept_lines"))


def drop_repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``docs`` with repeated lines taken out; documents of which no visible line is left go."""
    given = F.struct(*(F.col(f"`{n}`") for n in docs.columns))  # as one column: no name of theirs meets one of ours
    rows = docs.select(null_safe_id().alias("id"), F.col("text"), given.alias("given")).join(kept_lines(docs, least_chars), "id", "left")
    rows = rows.filter(F.col("kept").isNotNull() | ~_visible(F.coalesce("text", F.lit(""))))
    rows = rows.select("given", "text", "kept", _lines(F.col("text")).alias("lines"))
    blank = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: ~_visible(F.get("lines", i)))
    stay = F.array_sort(F.array_union(F.filter(F.col("kept"), lambda i: i < F.size("lines")), blank))
    text = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    rows = rows.select("given", F.when(F.col("kept").isNull(), F.col("text")).otherwise(text).alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*(new.get(n, F.col("given").getField(n)).alias(n) for n in docs.columns))


#: The same rows in DuckDB, by edit distances between all lines that share a first or last part.
ORACLE = """
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as no
  from documents),
firsts as (
  select line, min(doc_id * 1000000 + no) as place from lines where regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]') group by line),
longer as (select line, place, length(line) as n, left(line, 8) as a, right(line, 8) as b from firsts where length(line) >= 20),
near as (
  select distinct y.place from (
    select x.line as u, z.line as v, x.place as p, z.place as place from longer x join longer z on x.a = z.a and abs(x.n - z.n) <= 1 and x.place < z.place
    union
    select x.line, z.line, x.place, z.place from longer x join longer z on x.b = z.b and abs(x.n - z.n) <= 1 and x.place < z.place) y
  where levenshtein(y.u, y.v) = 1),
judged as (
  select l.doc_id, l.no, not regexp_matches(l.line, '[^ \\t\\n\\x0B\\f\\r]') or (f.place = l.doc_id * 1000000 + l.no and n.place is null) as stay
  from lines l left join firsts f on f.line = l.line left join near n on n.place = f.place)
select doc_id, count(*) as n_lines, count(*) filter (where not stay) as n_removed,
  coalesce(string_agg(cast(no as varchar), ',' order by no) filter (where stay), '') as kept_lines
from judged group by doc_id
"""
