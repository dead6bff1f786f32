"""The catalog operators: each query against its SQL, and cases on small frames."""

from __future__ import annotations

import datetime
import io
import random
import tarfile

import duckdb
import pytest
from pyspark.sql import functions as F

from lakeledger import queries, queries_plans, queries_sources, queries_sync, queries_values  # noqa: F401  they register their queries
from lakeledger.functions import color, text, units, values
from lakeledger.operators import changes, conflicts, fuzzy, lexicon, matching, records
from lakeledger.options import BASE_COLORS, COMPOSITE_SEEDS, FINISH_TAGS, MODIFIER_SEEDS, STOP_WORDS, Options, field_map, parse_pairs, parse_words
from lakeledger.plans import decisions, import_plan, journal, reports, resolve
from lakeledger.sources import archive, reference, snapshots, state
from lakeledger.sources.views import with_views
from lakeledger.streaming import runner

from .conftest import SF_DIR

TABLES = ("part", "orders", "lineitem", "events", "customer", "supplier")


def plain(v):
    if v is None:
        return "-"
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v) + 0.0:.6f}"
    return str(v)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, db, name):
    expected = db.execute(queries.ORACLES[name])
    columns = [c[0] for c in expected.description]
    frame = queries.QUERIES[name](spark, SF_DIR)
    assert sorted(frame.columns) == sorted(columns)
    got = sorted(tuple(map(plain, r)) for r in frame.select(*columns).collect())
    assert got == sorted(tuple(map(plain, r)) for r in expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_other_queries_have_rows(spark, name):
    assert queries.QUERIES[name](spark, SF_DIR).count() > 0


def one(spark, column, **fields):
    row = spark.createDataFrame([tuple(fields.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'array<int>' if isinstance(v, list) and (not v or isinstance(v[0], int)) else 'array<string>' if isinstance(v, list) else 'int'}" for k, v in fields.items()))
    return row.select(column.alias("x")).first()["x"]


def simulated(left, right, xref):
    """The matcher as a loop that consumes right products."""
    used, out = set(), {}
    there = {r[0] for r in right}
    for i, *_ in left:
        if xref.get(i) in there and xref[i] not in used:
            used.add(xref[i])
            out[i] = ("matched", xref[i])
    by_key = {}
    for j, *key in right:
        if j not in used:
            by_key.setdefault(tuple(key), []).append(j)
    for i, *key in left:
        if i in out:
            continue
        rest = by_key.get(tuple(key), [])
        if len(rest) == 1 and rest[0] not in used:
            used.add(rest[0])
            out[i] = ("matched", rest[0])
        else:
            out[i] = ("ambiguous" if len(rest) > 1 else "unmatched_left", None)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_matcher_is_the_consuming_loop(spark, seed):
    rnd = random.Random(seed)
    left = [(i, f"v{rnd.randrange(3)}", f"n{rnd.randrange(4)}", "") for i in range(40)]
    right = [(f"R{i:02}", f"v{rnd.randrange(3)}", f"n{rnd.randrange(6)}", "") for i in range(20)]
    xref = {i: f"R{rnd.randrange(30):02}" for i in range(40) if rnd.random() < 0.3}
    schema = "id {}, vendor string, name string, color string"
    a, b = spark.createDataFrame(left, schema.format("long")), spark.createDataFrame(right, schema.format("string"))
    rows = matching.match(a, b, spark.createDataFrame(list(xref.items()), "left_id long, right_id string")).collect()
    got = {r.left_id: (r.bucket, r.right_id) for r in rows if r.left_id is not None}
    assert got == simulated(left, right, xref)
    assert len(rows) == len({(r.left_id, r.right_id) for r in rows})


def test_keys_and_names(spark):
    assert one(spark, text.vendor_key(F.col("v"), {"prusa research": "prusa"}), v="  Prusa-Research ") == "prusa"
    assert one(spark, text.name_key(F.col("v")), v=None) == ""
    assert one(spark, text.color_key(F.col("v")), v=" ##FF00aa") == "ff00aa"
    assert one(spark, text.without_colors(F.col("n"), F.col("c")), n="PLA Red FF0000", c="#ff0000") == "pla"
    assert one(spark, text.without_colors(F.col("n"), F.col("c")), n="Red", c=None) == "red"
    assert one(spark, text.finish_line(F.col("n"), F.col("m")), n="Glow in the Dark", m="PLA CF") == "glow"
    assert one(spark, text.finish_line(F.col("n"), F.col("m"), ("silk", "matte")), n="Matte Silk", m=None) == "silk"
    assert one(spark, text.finish_line(F.col("n"), F.col("m"), ()), n="Silk", m=None) == ""
    assert one(spark, text.finish_ids(F.col("n"), F.col("m"), FINISH_TAGS), n="Silk HS", m="pla-cf") == [17, 31, 71]
    assert one(spark, text.tags_from_csv(F.col("n")), n='["3", 1, "x", 3]') == [1, 3]
    assert one(spark, text.display_name(F.col("v"), F.col("m"), F.col("n")), v="Acme", m="PLA", n="Sky Blue") == "Acme PLA Sky Blue"
    assert one(spark, text.display_name(F.col("v"), F.col("m"), F.col("n")), v="Acme", m="PLA", n="Acme PLA Sky") == "Acme PLA Sky"
    assert one(spark, text.nfkc(F.col("v")), v="ﬁne") == "fine"


@pytest.mark.parametrize(("material", "family"), [("PLA", "pla"), ("PLA+", "pla"), ("PLA Silk", "pla"), ("PETG-CF", "petg"), ("Nylon", "pa"), ("PA6", "pa"), ("ABS+", "abs"), ("TPE", "tpu"), ("HTPLA", "htpla"), (None, ""), ("plastic", "plastic")])
def test_families(spark, material, family):
    assert one(spark, text.material_family(F.col("m"), FINISH_TAGS), m=material) == family


def test_family_gate(spark):
    fit = lambda a, b: one(spark, text.families_fit(F.col("a"), F.col("b")), a=a, b=b)
    assert fit("pla", "pha") and fit("asa", "") and fit("pc", "pc")
    assert not fit("asa", "petg") and not fit("pla", "petg")


def test_colors(spark):
    left = color.left_to_right(F.col("c"), F.col("m"), F.col("d"), F.col("t"))
    coaxial = one(spark, left, c="FF0000", m="AA0000,00BB00", d="coaxial", t=[5, 28])
    assert (coaxial.color, coaxial.secondary, coaxial.tags) == (None, ["#AA0000", "#00BB00"], [5, 29])
    solid = one(spark, left, c="FF0000", m=None, d=None, t=[29])
    assert (solid.color, solid.secondary, solid.tags) == ("#FF0000", [], [])
    for d, m in (("coaxial", "AA0000,00BB00"), ("longitudinal", "AA0000,00BB00,0000CC")):
        x = color.left_to_right(F.lit(None).cast("string"), F.lit(m), F.lit(d), F.array().cast("array<int>"))
        back = color.right_to_left(x["color"], x["secondary"], x["tags"])
        again = spark.range(1).select(back.alias("b"), color.signature(x["color"], x["secondary"], x["tags"]).alias("s"), color.left_signature(F.lit(None).cast("string"), F.lit(m), F.lit(d)).alias("l")).first()
        assert (again.b.multi, again.b.direction, again.s) == (m, d, again.l)
    assert one(spark, color.rgba_to_hex(F.col("c")), c="#aabbccdd") == "AABBCC" and one(spark, color.rgba_to_hex(F.col("c")), c="#abc") is None
    assert one(spark, color.hex_score(color.rgb(F.col("a")), color.rgb(F.col("b"))), a=None, b="FF0000") == 0.0
    assert one(spark, color.right_profile(F.col("s"), F.col("t"), F.col("w")), s=["a", "b"], t=[], w=["Coextruded"]) == "coextruded"
    assert one(spark, color.replace_tags(F.col("t"), [16, 17], F.col("i")), t=[9, 16, 4], i=[17]) == [9, 4, 17]


def test_weights(spark):
    assert one(spark, units.net_to_gross(F.col("n"), F.col("t")), n=800.0, t=220.0) == 1020.0
    assert one(spark, units.net_to_gross(F.col("n"), F.col("t").cast("double")), n=800.0, t=None) == 1000.0
    assert one(spark, units.gross_to_net(F.col("n"), F.col("t")), n=920.0, t=220.0) == 700.0
    assert one(spark, units.gross_to_net(F.col("n"), F.col("t")), n=100.0, t=220.0) == 0.0
    assert not one(spark, units.tare_assumed(F.col("t")), t=0.0)
    changed = lambda a, b: one(spark, units.weight_changed(F.col("a"), F.col("b"), 2.0), a=a, b=b)
    assert changed(800.0, 795.0) and not changed(800.0, 799.5)
    assert one(spark, units.day(F.col("d")), d="2024-05-06T23:30:00+09:00") == "2024-05-06" and one(spark, units.day(F.col("d")), d="x") is None
    assert one(spark, units.as_temperature(F.col("d")), d="2.5") == 2


def test_values(spark):
    dec = lambda v: one(spark, values.decode(F.col("v")), v=v)
    assert dec('"a b"') == "a b" and dec("12.5") == "12.5" and dec("not json") == "not json" and dec(None) is None
    assert one(spark, values.encode(F.col("v")), v='a"b') == '"a\\"b"'
    form = lambda v: one(spark, values.compare_form(F.col("v")), v=v)
    assert [form(v) for v in (None, "—", "20.0", " Ab ", "1.50")] == ["", "", "20", "ab", "1.50"]
    score = lambda a, b: one(spark, values.finish_score(F.col("a"), F.col("b")), a=a, b=b)
    assert (score([], []), score([1], []), score([1], [2]), score([1], [1])) == (0.05, -0.10, -0.07, 0.10)


def test_changes_then_none(spark):
    now = spark.createDataFrame([(1, "f", "a", "b"), (2, "f", "a", None), (3, "g", None, None)], "pair int, field string, left string, right string")
    assert {r.action for r in changes.field_changes(now, now.limit(0), Options()).collect()} == {"baseline"}
    assert {(r.pair, r.action) for r in changes.field_changes(now, now, Options()).collect()} == {(1, "noop"), (2, "noop"), (3, "baseline")}
    inherited = now.withColumn("inherited", F.lit(True)).withColumn("left", F.lit("z"))
    assert {r.action for r in changes.field_changes(inherited, now.filter("pair < 3"), Options()).filter("pair < 3").collect()} == {"master_divergence"}
    assert changes.field_changes(now, now, Options(), either_missing_is_first=True).filter("pair = 2").first().action == "baseline"


def test_queue_keeps_ids(spark):
    c = spark.createDataFrame([(5, "item", 1, "weight", "field", None), (9, "item", 2, "weight", "field", None)], "id long, entity_type string, left_id long, field_name string, conflict_type string, resolved_at timestamp")
    found = spark.createDataFrame([("item", 1, "weight", "field"), ("item", 3, "weight", "field"), ("item", 3, "weight", "field"), ("item", None, "weight", "field")], "entity_type string, left_id long, field_name string, conflict_type string")
    new = conflicts.queue(c, found)
    assert sorted(r.id for r in new.collect()) == [10, 11]
    assert conflicts.queue(c.unionByName(new, allowMissingColumns=True), found).count() == 0


def test_all_items_are_queued(spark, db):
    """Every item's key without an open conflict, and ids without gaps after the last one."""
    keys = """f as (select distinct id - id % 2 as left_id from left_item) select left_id from f where not exists
    (select 1 from conflict c where c.resolved_at is null and c.left_id = f.left_id and c.field_name = 'weight' and c.conflict_type = 'field' and c.entity_type = 'item')"""
    expected = sorted(r[0] for r in db.execute(with_views(keys, "conflict", "left_item")).fetchall())
    last = db.execute(with_views("select max(id) from conflict", "conflict")).fetchone()[0]
    rows = queries.QUERIES["queued_conflicts_all"](spark, SF_DIR).collect()
    assert sorted(r.left_id for r in rows) == expected and sorted(r.id for r in rows) == list(range(last + 1, last + 1 + len(expected)))
    assert {(r.entity_type, r.field_name, r.conflict_type) for r in rows} == {("item", "weight", "field")}


@pytest.mark.parametrize("with_names", [False, True])
def test_matches_are_those_of_all_pairs(spark, with_names):
    left, right = queries.decomposed(spark, SF_DIR)
    every = fuzzy.ranked(fuzzy.scored(left, right, with_names), Options())
    got = fuzzy.matches(left, right, Options(), with_names)
    assert sorted(map(tuple, got.select(*every.columns).collect())) == sorted(map(tuple, every.collect()))


def test_few_pairs_of_names_reach_python(spark):
    """Pairs that cannot be among the best, whatever their names, are dropped by the letters alone; names are compared once."""
    rng = random.Random(4)
    colors, words = ("red", "blue", "green", "black", "white", "pink", "gold", "teal"), ("alpha", "bravo", "charlie", "delta", "echo", "foxtrot")
    products = spark.createDataFrame([(k, "acme", f"{rng.choice(colors)} {rng.choice(words)} {rng.choice(words)}", "pla", None) for k in range(300)], "id long, vendor string, name string, material string, hex string")
    left, right = (fuzzy.decomposed(products.filter(f), "id", "vendor", "name", "material", "hex", Options()) for f in ("id < 100", "id >= 100"))
    every, rest = fuzzy.paired(left, right).count(), fuzzy.open_pairs(left, right, 3)
    assert every > 10_000 and rest.count() < every / 4 and rest.select("a_name", "b_name").distinct().count() < every / 5
    whole = fuzzy.ranked(fuzzy.scored(left, right, True), Options(alternates=2)).select("left_id", "right_id", "score", "rank")
    assert sorted(map(tuple, fuzzy.ranked(fuzzy.named(rest), Options(alternates=2)).select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    rows = spark.createDataFrame([("abc", "cab"), ("", ""), (None, "x"), ("red ring", "bed rang"), ("ab" * 130, "ba" * 130)], "a string, b string")
    bound = text.ratio_bound(text.letters(F.col("a")), text.letters(F.col("b")), F.col("a"), F.col("b"))
    found = rows.select(bound.alias("bound"), text.sequence_ratio(F.col("a"), F.col("b")).alias("ratio")).collect()
    assert all(r.ratio <= r.bound + 1e-12 for r in found) and found[0].bound == 1.0 and found[2].bound == 0.0


def test_all_identities_are_pinned(spark, db):
    expected = db.execute(with_views("select left_id, right_id from product_mapping where right_id in (select id from right_product)", "product_mapping", "right_product")).fetchall()
    rows = queries.QUERIES["fuzzy_matches_with_names"](spark, SF_DIR).filter("role = 'best' and score = 1.0").collect()
    assert {(r.left_id, r.right_id) for r in rows} >= set(expected)


def test_lexicon(spark):
    names = [("Acme", "dual color red & blue"), ("Zed", "dual color green"), ("Acme", "dual color x1 42"), ("Zed", "dual color / shiny"), ("Acme", "dual color pink")] + [("B", f"other{k} thing{k}") for k in range(60)]
    frame = spark.createDataFrame(names, "brand string, name string")
    rows = {r.term for r in lexicon.mine(frame, "name", "brand", seeds=("matte",)).collect()}
    assert "dual color" in rows and "dual" not in rows and "matte" in rows
    terms = {r.term for r in lexicon.ngrams(frame, "name", "brand").collect()}
    assert "red blue" not in terms and "color shiny" not in terms and "42" not in terms
    assert rows == {r.term for r in lexicon.mine(frame, "name", "brand", seeds=("matte",)).collect()}


def mined_plainly(rows):
    """mine() as loops over (brand, name, material): {(kind, term): freq} in order."""
    freq, brands = {}, {}
    for brand, name, material in rows:
        for words in text.residual(name, brand, material, tuple(FINISH_TAGS)):
            for n in (1, 2, 3):
                for i in range(len(words) - n + 1):
                    term = " ".join(words[i : i + n])
                    freq[term] = freq.get(term, 0) + 1
                    brands.setdefault(term, set()).add(brand.lower())
    often = {t for t in freq if freq[t] >= 5 and len(brands[t]) >= 2 and not (" " not in t and t in STOP_WORDS)}
    kept = set()
    for t in often:
        w = t.split()
        if len(w) != 2 or freq[t] * len(rows) / (freq[w[0]] * freq[w[1]]) >= 8:
            kept.add(t)
    covered = set()
    for w in (t.split() for t in kept):
        covered |= set(w) if len(w) > 1 else set()
        covered |= {" ".join(w[:2]), " ".join(w[1:])} if len(w) == 3 else set()
    mined = kept - covered - set(BASE_COLORS)
    more = {t for t in freq if " " not in t and freq[t] >= 8 and len(brands[t]) >= 3} - {*BASE_COLORS, *STOP_WORDS, *MODIFIER_SEEDS} - mined
    modifiers = (mined | {*MODIFIER_SEEDS, *COMPOSITE_SEEDS}) - {*STOP_WORDS, *BASE_COLORS}
    order = lambda s: sorted(s, key=lambda t: (-len(t.split()), t))
    return [("modifier", t, freq.get(t, 0)) for t in order(modifiers)] + [("color", t, freq.get(t, 0)) for t in order({*BASE_COLORS} | more)]


@pytest.mark.parametrize("seed", range(2))
def test_lexicon_is_the_plain_one(spark, seed):
    rnd = random.Random(seed)
    rows = [(f"V{k % 3}", "zonk blip", "PLA") for k in range(9)]  # a bigram of three brands: its words become colors
    rows += [("Solo", "neat product line", "PLA")] * 6 + [(f"V{k % 2}", "product", "PLA") for k in range(6)]  # a trigram of one brand covers nothing
    rows += [(f"V{k % 2}", "Silk PLA+ tall dark stack & red", "PLA+ Silk") for k in range(5)] + [("V1", "V1 filament 95A", "TPU")] * 9
    rows += [(f"V{rnd.randrange(4)}", " ".join(rnd.choice(["ochre", "umber", "glow", "V1", "matte", "red", "/", "fast", "x"]) for _ in range(5)), rnd.choice(["PLA", "PETG-CF", "", "umber"])) for _ in range(150)]
    found = lexicon.mine(spark.createDataFrame(rows, "brand string, name string, type string"), "name", "brand", "type").collect()
    assert [(r.kind, r.term, r.freq) for r in found] == mined_plainly(rows)
    got = {(r.kind, r.term) for r in found}
    assert {("color", "zonk"), ("modifier", "zonk blip"), ("modifier", "product"), ("modifier", "tall dark stack"), ("color", "peru")} <= got
    assert not {t for _, t in got} & {"neat product line", "filament", "95a", "pla", "blip red"}


def test_matching_sees_composed_names(spark):
    """Full-width and decomposed names meet their plain forms."""
    left = spark.createDataFrame([(1, "ＡＣＭＥ", "Cafe\u0301 Ｒed", None), (2, "acme", "blue", None)], "id long, vendor string, name string, color string")
    right = spark.createDataFrame([("R1", "acme", "café red", None), ("R2", "Acme", "Ｂlue", None)], "id string, vendor string, name string, color string")
    keyed = [matching.keyed(x, "id", "vendor", "name", "color") for x in (left, right)]
    assert {(r.left_id, r.right_id) for r in matching.match(*keyed).collect()} == {(1, "R1"), (2, "R2")}


def test_ranking(spark):
    o = Options()
    cols = "id string, vendor string, name string, type string, color string"
    ref = spark.createDataFrame([("a", "Acme", "Silk Orange", "PLA", "#CC7722"), ("b", "Acme", "Copper", "PLA", "#B87333"), ("c", "Acme", "Matte Orange", "PLA", None), ("d", "Acme", "Orange", "PETG", None)], cols)
    mine = spark.createDataFrame([("1", "acme", "Orange", "PLA", "#B87333"), ("2", "acme", "Orange Matte", "PLA", None)], cols)
    d = lambda f: fuzzy.decomposed(f, "id", "vendor", "name", "type", "color", o)
    rows = fuzzy.ranked(fuzzy.scored(d(mine), d(ref)), o).collect()
    best = {r.left_id: r.right_id for r in rows if r.role == "best"}
    assert best["2"] == "c" and best["1"] in ("a", "c") and not any(r.right_id == "d" for r in rows)
    pinned = fuzzy.pinned(fuzzy.ranked(fuzzy.scored(d(mine), d(ref)), o), spark.createDataFrame([("1", "b")], "left_id string, right_id string")).filter("left_id = '1' and role = 'best'").collect()
    assert [(r.right_id, r.score) for r in pinned] == [("b", 1.0)]
    assert fuzzy.search(d(ref), d(mine.filter("id = '1'")), o, 2).count() == 2


def test_names_are_decomposed():
    tags = tuple(FINISH_TAGS)
    parse = lambda name, vendor="Acme", material="PLA", terms=lexicon.index(): fuzzy.parsed(text.residual(name, vendor, material, tags), terms)
    assert parse("Acme Temperature Change Purple to Red PLA Silk") == (["temperature change"], ["purple", "red"])
    assert parse("Dual Color Orchid / Peru & Orchid") == (["dual color"], ["orchid", "peru", "orchid"])
    assert parse("Dual & Color 95A rockfill fill") == (["dual", "rockfill"], [])  # no term across a separator
    assert parse("Gray Navy Violet", "Navy Works") == ([], ["grey", "purple"])  # a word of the vendor is no color
    assert parse("tall dark stack color", terms=frozenset(("tall dark stack", "dark stack color", "color"))) == (["tall dark stack", "color"], [])  # words are consumed


def test_scores_see_colors_and_modifiers(spark):
    cols = "id string, vendor string, name string, type string, color string"
    mine = spark.createDataFrame([("1", "acme", "Turquoise Marble", "PLA", None), ("2", "acme", "Orchid & Peru", "PLA", None)], cols)
    ref = spark.createDataFrame([("a", "Acme", "Turquoise Marble", "PLA", None), ("b", "Acme", "Orchid Neon", "PLA", None), ("c", "Acme", "Peru/Orchid", "PLA", None), ("d", "Acme", "Plain", "PLA", None)], cols)
    d = lambda f: fuzzy.decomposed(f, "id", "vendor", "name", "type", "color", Options())
    scores = {(r.left_id, r.right_id): r.score for r in fuzzy.scored(d(mine), d(ref)).collect()}
    assert scores == {("1", "a"): 0.9, ("1", "b"): 0.35, ("1", "d"): 0.55, ("2", "c"): 0.825}
    arranged = lambda f, how: fuzzy.decomposed(f, "id", "vendor", "name", "type", "color", Options(), profile=F.lit(how), hexes=F.lit(2))
    assert fuzzy.scored(arranged(mine, "gradient"), arranged(ref, "coextruded")).count() == 0 and fuzzy.scored(arranged(mine, "gradient"), arranged(ref, "gradient")).count() == 8


def test_plan_is_preview(spark):
    from lakeledger.queries import _plan

    planned = _plan(spark, SF_DIR)
    assert import_plan.preview(planned).agg(F.sum("n_items")).first()[0] == planned.count() == import_plan.execution(planned).filter("entity = 'item'").count()
    assert import_plan.scope(planned, planned.first().left_id).select("left_id").distinct().count() == 1


def test_divergence(spark):
    variants = spark.createDataFrame([("v1", "m", False), ("v2", "m", True), ("v3", "m", False)], "variant_id string, master_id string, overrides boolean")
    d = lambda how: {(r.right_id, r.value) for r in resolve.divergence(spark.createDataFrame([("v1", "weight", "5", how)], "variant_id string, field string, value string, how string"), variants).collect()}
    assert d("apply_all") == {("m", "5"), ("v2", "5")} and d("variant_override") == {("v1", "5")} and d("ignore") == set()


def test_digest_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "id int, v string")
    digest = lambda f: reports.content_digest(f, ["id", "v"]).first().digest
    assert digest(a) == digest(a.orderBy(F.col("id").desc())) != digest(a.dropDuplicates())


def test_state_versions(spark, tmp_path):
    table = state.StateTable(spark, str(tmp_path / "s"))
    assert table.read() is None
    now = F.to_timestamp(F.lit("2024-01-01"))
    rows = state.snapshot_rows(spark.createDataFrame([(1, 5.0), (2, None)], "id int, w double"), "left", "item", "id", ["w"], now)
    assert table.write(rows) == 1
    new = state.snapshot_rows(spark.createDataFrame([(2, 7.0), (3, 1.0)], "id int, w double"), "left", "item", "id", ["w"], now)
    assert table.write(state.upsert(table.read(), new, state.SNAPSHOT_KEY)) == 2
    assert {(r.entity_id, r.value) for r in table.read().collect()} == {("1", "5.0"), ("2", "7.0"), ("3", "1.0")}
    table.append(new)
    assert table.read().count() == 5 and table.current()[0] == 2


def test_state_is_cleared_and_pruned(spark, tmp_path):
    table = state.StateTable(spark, str(tmp_path / "s"))
    assert table.clear() == 0 and table.prune() == 0
    for n in (3, 4, 5):
        table.write(spark.range(n))
    assert table.prune(keep=1) == 2 and table.read().count() == 5
    assert len(list((tmp_path / "s").glob("v*"))) == 1
    assert table.clear() == 5 and table.read().count() == 0 and table.read().columns == ["id"]
    assert table.write(spark.range(2)) == 5 and table.read().count() == 2


def test_second_writer_of_a_version_fails(spark, tmp_path):
    table = state.StateTable(spark, str(tmp_path / "s"))
    table.write(spark.range(3))
    late = state.StateTable(spark, str(tmp_path / "s"))
    late.current = lambda: (0, None)  # it looked before the other one wrote
    with pytest.raises(Exception, match="exists"):
        late.write(spark.range(9))
    assert table.read().count() == 3


def stored(store, table):
    return sorted(map(tuple, store.read(table).collect()), key=str)


def test_upserts_touch_few_buckets(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, f"file://{tmp_path}/s")
    rows = lambda some: spark.createDataFrame(some, "k long, v string")
    with store.change() as step:
        step.create("t", rows([(k, "a") for k in range(1000)] + [(None, "none")]), ["k"], buckets=16)
    with store.change() as step:
        step.upsert("t", rows([(5, "b"), (5, "c"), (None, "null"), (2000, "new")]))
    parts = store.manifest()[1]["t"]["parts"]
    assert len(parts) == 2 and len(parts[0]["buckets"]) == 16 and len(parts[1]["buckets"]) <= 3
    kept = {(k, "a") for k in range(1000) if k != 5} | {(5, "c"), (None, "null"), (2000, "new")}
    assert set(stored(store, "t")) == kept
    # only buckets of several parts are shuffled, and only their files are read there
    text = store.read("t")._jdf.queryExecution().executedPlan().toString()
    assert text.count("PartitionFilters: [isnotnull(_bucket") + text.count("PartitionFilters: [_bucket") >= 3
    with store.change() as step:
        step.delete("t", rows([(5, None), (7777, None)]).select("k"))
        folded = step.compact("t", most=1)
    facts = store.manifest()[1]["t"]
    assert set(stored(store, "t")) == kept - {(5, "c")}
    assert set(folded) == {b for b in range(16) if sum(b in p["buckets"] for p in parts) > 1} | set(folded)
    assert sorted(b for p in facts["parts"] for b in p["buckets"]) == list(range(16)) and facts["parts"][0]["folder"] == parts[0]["folder"]


def test_steps_are_whole_or_not_there(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, f"file://{tmp_path}/s")
    one = spark.createDataFrame([(1, "a")], "k long, v string")
    with store.change() as step:
        step.create("x", one, ["k"], buckets=2)
        step.create("y", one, ["k"], buckets=2)
    reader, seen = store.manifest(), store.read("x")
    with pytest.raises(InterruptedError), store.change() as step:
        step.upsert("x", one.withColumn("v", F.lit("b")))
        raise InterruptedError
    assert stored(store, "x") == stored(store, "y") == [(1, "a")] and store.versions() == [1]
    with pytest.raises(Exception, match="[eE]xist"), store.change() as step:  # noqa: PT012
        step.upsert("x", one.withColumn("v", F.lit("c")))
        with store.change() as other:
            other.upsert("y", one.withColumn("v", F.lit("d")))
            other.insert_absent("y", spark.createDataFrame([(1, "e"), (2, "e")], "k long, v string"))
    assert stored(store, "x") == [(1, "a")] and stored(store, "y") == [(1, "d"), (2, "e")]
    assert store.read("y", reader[1]).collect() == [(1, "a")] and seen.collect() == [(1, "a")]
    assert store.sweep(keep=1) == 2  # what the two failed writers left
    assert stored(store, "x") == [(1, "a")] and stored(store, "y") == [(1, "d"), (2, "e")] and store.sweep(keep=1) == 0


def test_only_changed_blocks_are_scored(spark, tmp_path):
    left, right = queries.decomposed(spark, SF_DIR)
    left, right = left.persist(), right.persist()
    store = snapshots.SnapshotStore(spark, f"file://{tmp_path}/s")
    n = left.select("brand").union(right.select("brand")).distinct().count()
    assert fuzzy.cached_matches(store, left, right, Options()) == n
    assert fuzzy.cached_matches(store, left, right, Options()) == 0
    one, gone = (r.brand for r in left.select("brand").distinct().orderBy("brand").limit(2).collect())
    moved = left.filter(F.col("brand") != gone).withColumn("hex", F.when(F.col("brand") == one, "123456").otherwise(F.col("hex")))
    kept = right.filter(F.col("brand") != gone)
    assert fuzzy.cached_matches(store, moved, kept, Options()) == 2
    expected = fuzzy.matches(moved, kept, Options())
    assert sorted(map(tuple, store.read("matches").select(*expected.columns).collect())) == sorted(map(tuple, expected.collect()))
    assert fuzzy.cached_matches(store, moved, kept, Options(least_match=0.9)) == n - 1  # settings count


def test_executions_are_resumed(spark, tmp_path):
    planned = spark.createDataFrame([(1, "create", None, 10), (1, "create", None, 11), (2, "create", None, 20), (3, "link", "R3", 30)], "left_id long, action string, right_id string, item_id long")
    roles = spark.createDataFrame([(1, "master", None), (2, "variant", 1), (3, "link", None)], "left_id long, role string, parent_left_id long")
    todo = journal.actions("p", planned, roles)
    store = snapshots.SnapshotStore(spark, f"file://{tmp_path}/s")
    with store.change() as step:
        step.create("j", spark.createDataFrame([], journal.JOURNAL), ["key", "attempt"], buckets=2)
    asked = []

    def apply(fail):
        def run(ready):
            rows = ready.collect()
            asked.extend((r.entity, r.id, r.parent_id, r.attempts) for r in rows)
            return spark.createDataFrame([(r.key, "failed" if r.entity == fail else "done", None if r.entity == fail else f"new-{r.entity}-{r.id}", None) for r in rows], "key string, status string, made_id string, error string")
        return run

    journal.resume(store, "j", todo, apply("product"))
    standing = {(r.entity, r.id): r.status for r in journal.standing(todo, store.read("j")).collect()}
    assert standing["container", 1] == standing["variant", 2] == standing["item", 20] == "done"
    assert standing["product", 1] == "failed" and standing["item", 10] == standing["tags", 1] == "blocked"
    first, asked[:] = list(asked), []
    journal.resume(store, "j", todo, apply(None))
    assert set(asked) == {("product", 1, "new-container-1", 1), ("tags", 1, "new-product-1", 0), ("identity", 1, "new-product-1", 0), ("item", 10, "new-product-1", 0), ("item", 11, "new-product-1", 0)}
    assert ("variant", 2, "new-container-1", 0) in first and ("item", 30, "new-reconcile-3", 0) in first
    asked.clear()
    journal.resume(store, "j", todo, apply(None))
    assert not asked and {r.status for r in journal.standing(todo, store.read("j")).collect()} == {"done"}


def test_empty_tables_in_the_store(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, f"file://{tmp_path}/s")
    with store.change() as step:
        step.create("t", spark.createDataFrame([], "k long, v string"), ["k"])
        assert step.compact("t") == []
    assert stored(store, "t") == [] and store.read("t").columns == ["k", "v"]


def test_export_and_import(spark, tmp_path):
    m = spark.createDataFrame([(1, "a"), (None, "b")], "left_id long, right_id string")
    c = spark.createDataFrame([(1, "item", 1, "w", "field", None), (2, "item", 2, "w", "field", datetime.datetime(2024, 1, 1))], "id long, entity_type string, left_id long, field_name string, conflict_type string, resolved_at timestamp")
    k = spark.createDataFrame([("interval", "120"), ("api_token", "s3")], "key string, value string")
    state.export_state(str(tmp_path / "x"), m, c, k)
    got = state.import_state(spark, str(tmp_path / "x"), m.limit(0), c.limit(0), k.limit(0))
    assert [g.count() for g in got] == [2, 1, 1]
    again = state.import_state(spark, str(tmp_path / "x"), *got)
    assert [g.count() for g in again] == [2, 1, 1]


def test_dump_has_four_sorted_sections(spark):
    left = spark.createDataFrame([(10, "v", "n", "m"), (9, "v", None, "m")], "id long, vendor string, name string, material string")
    items = spark.createDataFrame([(2, 10, 5.0, "a"), (1, 9, None, "b")], "id long, product_id long, remaining_weight double, location string")
    right = spark.createDataFrame([("R2", "v", "n", "t", None, 1.5, None), ("R1", "v", "n", "t", "#f00", None, "R2")], "id string, vendor string, name string, type string, color string, tare double, parent_id string")
    stock = spark.createDataFrame([("S2", "R1", 7.0, False), ("S1", "R2", 8.0, True)], "id string, product_id string, total_weight double, retired boolean")
    lines = [(r.section, r.id, r.line) for r in state.dump_lines(left, items, right, stock).collect()]
    assert [x[:2] for x in lines] == [("product", "9"), ("product", "10"), ("item", "1"), ("item", "2"), ("right_product", "R1"), ("right_product", "R2"), ("right_item", "S1"), ("right_item", "S2")]
    assert lines[2][2] == "9 |  | b" and lines[4][2] == "v | n | t | #f00 |  | R2" and lines[6][2] == "R2 | 8.0 | true"
    assert state.dump_lines(left, items).count() == 4


def test_settings_maps(spark):
    old = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    row = spark.range(1).select(state.merge_settings(old, F.create_map(F.lit("b"), F.lit("3"))).alias("m"), state.without_keys(old, ["a"]).alias("w")).first()
    assert row.m == {"a": "1", "b": "3"} and row.w == {"b": "2"}


def test_archive(spark, tmp_path):
    files = {"data/brands/acme.yaml": "slug: acme\nname: Acme\n", "data/materials/acme/x.yaml": "uuid: u1\nslug: x\nname: 'Red'\ntype: PLA\nclass: FFF\nprimary_color: '#ff0000ff'\ntags:\n  - silk\n  - matte\ndensity: 1.24\n", "data/materials/acme/y.yaml": "slug: y\nclass: SLA\n", "data/materials/acme/bad.yaml": "][\n", "other/z.yaml": "a: b\n"}
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        for name, body in files.items():
            info = tarfile.TarInfo("root/" + name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body.encode()))
    rows = archive.materials(archive.documents(spark, str(tmp_path / "a.tar.gz"), f"file://{tmp_path}/index")).collect()
    assert [(r.uuid, r.brand, r.name, r.color, r.tags, r.density) for r in rows] == [("u1", "Acme", "Red", "FF0000", ["silk", "matte"], 1.24)]


def test_nested_archive(spark, tmp_path):
    files = {
        "data/brands/acme.yaml": "slug: acme\nname: Acme\n",
        "data/materials/acme/x.yaml": "uuid: u1\nslug: x\nname: 'Red & Blue'  # shown\nbrand:\n  slug: acme\nclass: FFF\nprimary_color:\n  color_rgba: '#ff0000ff'\nsecondary_colors:\n- color_rgba: '#00ff00ff'\n  name: g\n- color_rgba: '#0000ffff'\nproperties:\n  density: 1.24\n  min_print_temperature: 200\n  chamber_temperature: 40\ntags: [silk, matte]\nphotos:\n  - url: http://p/1\n",
        "data/materials/none/y.yaml": "slug: y\nbrand: {slug: gone}\nsecondary_colors: []\n",
        "data/material-packages/acme/p.yaml": "slug: p\nmaterial:\n  slug: x\ncontainer: {slug: c}\nnominal_netto_full_weight: 1000\n",
        "data/material-packages/acme/q.yaml": "slug: q\nclass: SLA\nmaterial:\n  slug: x\n",
        "data/material-containers/c.yaml": "slug: c\nbrand:\n  slug: acme\nempty_weight: 250\n",
    }
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        for name, body in files.items():
            info = tarfile.TarInfo("root/" + name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body.encode()))
    docs = archive.documents(spark, str(tmp_path / "a.tar.gz"), f"file://{tmp_path}/index")
    rows = {r.slug: r for r in archive.materials(docs).collect()}
    x = rows["x"]
    assert (x.brand, x.name, x.color, x.secondary, x.density, x.nozzle_temp_min, x.chamber_temp, x.tags, x.photo_url) == ("Acme", "Red & Blue", "FF0000", ["00FF00", "0000FF"], 1.24, 200.0, 40.0, ["silk", "matte"], "http://p/1")
    assert (rows["y"].brand, rows["y"].color, rows["y"].secondary) == ("gone", None, [])
    found = fuzzy.package_weights(archive.materials(docs), archive.packages(docs), archive.containers(docs)).collect()
    assert {tuple(r) for r in found} == {("x", 1000.0, 250.0), ("y", None, None)}


YAML = """# a comment
base: &b
  density: 1.2
  "temp": 200
---
slug: 'it''s'
<<: *b
temp: 210
list: [a, ~, b]
maps:
  - {x: 1}
  - <<: *b
text: |
  two
  lines
folded: >-
  one
  line
"""


def test_yaml_documents():
    # an anchor ends with its document
    assert archive.yaml_documents(YAML) == [{"base.density": "1.2", "base.temp": "200"}, {}]
    found = archive.yaml_documents(YAML.replace("---\n", ""))
    assert found == [{
        "base.density": "1.2", "base.temp": "200", "slug": "it's", "density": "1.2", "temp": "210", "list": "a,b", "maps.0.x": "1",
        "maps.1.density": "1.2", "maps.1.temp": "200", "text": "two\nlines\n", "folded": "one line",
    }]
    assert archive.yaml_documents("a: 1\n---\n- no map\n---\nb: 2") == [{"a": "1"}, {}, {"b": "2"}]
    assert archive.yaml_documents("][") == [{}] and archive.yaml_documents("") == []


@pytest.mark.parametrize("mode", ["w", "w:gz", "members"])
def test_archive_in_parts(spark, tmp_path, mode):
    files = {f"r/data/brands/{'long-name-' * 14}{k}.yaml": f"slug: s{k}\nname: {'x' * (k * 37 % 900)}\n---\nslug: t{k}\n" for k in range(300)}
    path = f"{tmp_path}/archives"
    if mode == "members":
        rows = spark.createDataFrame(list({n.replace("long-name-", ""): b for n, b in files.items()}.items()), "name string, body string")
        archive.write_archives(rows, path, per_file=70)
    else:
        (tmp_path / "archives").mkdir()
        with tarfile.open(f"{path}/a.tar", mode) as tar:
            for name, body in files.items():
                info = tarfile.TarInfo(name)
                info.size = len(body)
                tar.addfile(info, io.BytesIO(body.encode()))
    docs = archive.documents(spark, path, f"{tmp_path}/index", part_bytes=4000)
    assert docs.rdd.getNumPartitions() > 10
    assert sorted(r.fields["slug"] for r in docs.collect()) == sorted(f"{c}{k}" for k in range(300) for c in "st")
    starts = spark.read.parquet(f"{tmp_path}/index")
    assert starts.filter("start > 0").count() == (0 if mode == "w:gz" else starts.count() - starts.select("path").distinct().count())
    assert archive.documents(spark, path, f"{tmp_path}/index2", kinds=("material",)).count() == 0


def test_streaming_runner(spark, tmp_path):
    schema = "entity_id string, weight double, seen_at timestamp"
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    table, events = state.StateTable(spark, str(tmp_path / "state")), []

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        runner.run(stream, table, 2.0, str(tmp_path / "ck"), lambda df, n: events.extend((r.entity_id, r.action) for r in df.collect())).awaitTermination()

    for batch in ([("a", 800.0, at(1)), ("b", 5.0, at(1))], [("a", 795.0, at(2)), ("b", 5.5, at(2))], [("a", 700.0, at(1))]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    assert sorted(events[:2]) == [("a", "baseline"), ("b", "baseline")] and sorted(events[2:4]) == [("a", "changed"), ("b", "same")] and events[4:] == [("a", "late")]
    assert {(r.entity_id, r.weight) for r in runner.newest_readings(table.read()).collect()} == {("a", 795.0), ("b", 5.0)}


def test_replayed_batch_gives_the_same_events(spark, tmp_path):
    schema = "entity_id string, weight double, seen_at timestamp"
    table, got, broken = state.StateTable(spark, str(tmp_path / "state")), [], [True]

    def run(sink):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        runner.run(stream, table, 2.0, str(tmp_path / "ck"), sink, fold_every=2).awaitTermination()

    def sink(df, n):
        got.append((n, sorted((r.entity_id, r.action) for r in df.collect())))

    class Late(state.StateTable):
        def append(self, rows):
            super().append(rows)
            if broken.pop():
                raise OSError("lost after the state was written")

    for hour in range(5):
        rows = [("a", 100.0 * hour, datetime.datetime(2024, 1, 1, hour)), (f"n{hour}", 1.0, None)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if hour == 2:
            whole, table = table, Late(spark, str(tmp_path / "state"))
            with pytest.raises(Exception, match="lost"):
                run(sink)
            table = whole
        run(sink)
    assert [n for n, _ in got] == [0, 1, 2, 2, 3, 4] and got[2] == got[3]
    assert all(events == [("a", "baseline" if n == 0 else "changed"), (f"n{n}", "baseline")] for n, events in got)
    now = {r.entity_id: r.weight for r in runner.newest_readings(table.read()).collect()}
    assert now == {"a": 400.0} | {f"n{h}": 1.0 for h in range(5)}


@pytest.fixture
def rocksdb(spark):
    pytest.importorskip("google.protobuf")
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, runner.ROCKSDB)
    yield
    spark.conf.unset(key)


def test_keyed_run_gives_the_events_of_the_batch_diff(spark, tmp_path, rocksdb):
    schema = "entity_id string, weight double, seen_at timestamp"
    rng = random.Random(8)
    table, expected = state.StateTable(spark, str(tmp_path / "state")), []
    batches = [[(f"i{rng.randrange(6)}", rng.choice([None, 100.0, 101.0, 105.0, 300.0]), rng.choice([None, *(datetime.datetime(2024, 1, 1, h) for h in range(12))])) for _ in range(8)] for _ in range(4)]
    # late rows, ties, nulls, and a reading that was there before
    batches.append(batches[1])

    def run(out, checkpoint):
        runner.run_keyed(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 2.0, str(tmp_path / checkpoint), str(tmp_path / out)).awaitTermination()

    def told(df):
        return [(r.entity_id, r.then, r.now, r.seen_at, r.action) for r in df.collect()]

    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run("out", "ck")
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        runner.run(stream, table, 2.0, str(tmp_path / "ck2"), lambda df, n: expected.extend((r.entity_id, r.then, r.now, r.seen_at, r.action) for r in df.collect())).awaitTermination()
        got = spark.read.schema(runner.EVENTS).parquet(str(tmp_path / "out"))
        assert sorted(map(str, told(got))) == sorted(map(str, expected)), k
    # the last batch is lost before its commit, and replayed from the state before it
    commits = sorted((tmp_path / "ck" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (tmp_path / "ck" / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    run("out", "ck")
    assert sorted(map(str, told(spark.read.schema(runner.EVENTS).parquet(str(tmp_path / "out"))))) == sorted(map(str, expected))


def test_options():
    assert parse_pairs("a=1, B = x ,bad,=y") == {"a": "1", "b": "x"}
    assert parse_words(" Silk,silk, Matte", ()) == ("silk", "matte") and parse_words("", ("a",)) == ("a",)
    assert field_map({"name": "title", "nope": "x"}, ("name", "price", "color_hex"), ("price", "color_hex"), ("color_hex",)) == {"name": "title", "price": "price"}
    with pytest.raises(ValueError, match="direction"):
        Options(direction="up").validated()


def test_records(spark):
    kids = "id string, children array<struct<id:string,label:string>>, label string"
    rows = spark.createDataFrame([("p", [("c1", "a"), ("c2", "b")], "a"), ("q", [("c1", "a"), ("c2", "b")], "z"), ("r", [], "z")], kids)
    assert [r.x for r in rows.select(records.created_child(F.col("children"), F.col("label"), F.col("id")).alias("x")).collect()] == ["c1", "c2", "r"]
    assert rows.select(records.child_by_id(F.col("children"), F.lit("c2"))["label"].alias("x")).first().x == "b"
    refs = spark.range(1).select(records.cross_references(F.col("id"), F.lit("R1"), F.lit(None).cast("string")).alias("x"))
    assert refs.first().x == {"left_id": '"0"', "right_id": '"R1"'}
    assert refs.select(records.extra_value(F.col("x"), "right_id").alias("v"), records.extra_value(F.col("x"), "none").alias("n"), decisions.without_references(F.col("x")).alias("m")).first() == ("R1", None, {})
    printers = spark.createDataFrame([("a", [(1, "s")]), ("b", [])], "printer_id string, slots array<struct<position:int,item_id:string>>")
    assert {tuple(r) for r in records.slots(printers).collect()} == {("a", 1, "s"), ("b", None, None)}
    dried = spark.createDataFrame([(1, [("2024-01-02",), ("2024-03-01",)]), (2, None)], "id int, cycles array<struct<at:string>>")
    assert {tuple(r) for r in records.dry_cycles(dried).collect()} == {(1, 2, "2024-03-01"), (2, 0, None)}
    assert records.label_fields(spark.range(1), ["id"], ["nope", "id"]).first() == ("0",)
    stamp = spark.range(1).select(records.file_time(F.lit("b-20240506-070809.json"), F.lit(None).cast("timestamp")).alias("x")).first().x
    assert stamp == datetime.datetime(2024, 5, 6, 7, 8, 9)
    done = spark.createDataFrame([(1, "created"), (2, "failed"), (3, "linked")], "ord int, action string")
    assert [r.ord for r in records.failures_first(done).collect()] == [2, 1, 3]
    named = records.conflict_identity(spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "id int, left_id int"), spark.createDataFrame([("5", "name", "Snap")], "entity_id string, field string, value string"), spark.createDataFrame([("6", '{"name": "Blob"}')], "left_id string, identity string"))
    assert {(r.id, r.label) for r in named.collect()} == {(1, "Snap"), (2, "Blob"), (3, "#7")}
    assert records.merged_buckets(matched=spark.range(2), ambiguous=spark.range(1)).count() == 3


def test_decisions(spark):
    old = spark.createDataFrame([(1, "link"), (2, "skip")], "left_id int, action string")
    assert {tuple(r) for r in decisions.saved(old, spark.createDataFrame([(2, "create")], old.schema)).collect()} == {(1, "link"), (2, "create")}
    config = decisions.seeded_config(spark.createDataFrame([("a", "1")], "key string, value string"), spark.createDataFrame([("a", "9"), ("b", "2")], "key string, value string"))
    assert {tuple(r) for r in config.collect()} == {("a", "1"), ("b", "2")}
    assert {tuple(r) for r in decisions.set_config(config, spark.createDataFrame([("a", "3")], config.schema)).collect()} == {("a", "3"), ("b", "2")}
    left, = decisions.purge(spark.createDataFrame([(1,)], "left_id int"), (spark.createDataFrame([("1", "x"), ("2", "y")], "entity_id string, v string"), "entity_id"))
    assert [r.v for r in left.collect()] == ["y"]
    members = spark.createDataFrame([(1, 3, 1), (2, 3, 1), (3, 3, 1), (9, 1, 9)], "id int, n int, master_id int")
    assert {tuple(r) for r in decisions.variant_masters(members).select("left_id", "master_id").collect()} == {(2, 1), (3, 1)}
    row = spark.range(1).select(decisions.direction_of(F.lit("left")).alias("d"), decisions.target_of(F.lit("right_to_left")).alias("t"), decisions.canonical_field(F.lit(" Net_Weight"), {"net_weight": "weight"}).alias("f")).first()
    assert tuple(row) == ("left_to_right", "left", "weight")


def test_reference_freshness(spark):
    now = F.to_timestamp(F.lit("2024-02-01"))
    rows = spark.createDataFrame([("c1", 1, 1, datetime.datetime(2023, 1, 1)), ("c2", 1, 1, datetime.datetime(2024, 1, 31)), ("c1", 0, 1, datetime.datetime(2024, 1, 31)), ("c1", 1, 0, datetime.datetime(2024, 1, 31))], "identity string, schema_version int, lexicon_version int, fetched_at timestamp")
    assert [r.action for r in reference.freshness(rows, "c1", now, 7).collect()] == ["keep", "reload", "reload", "mine"]
    assert [r.action for r in reference.freshness(rows, None, now, 7).collect()] == ["reload", "keep", "reload", "mine"]
    products = spark.createDataFrame([(1, "a")], "id int, name string")
    one_ = reference.manifest(products, "c1", now)
    a = reference.fingerprint(products, ["id", "name"], one_, "x")
    b = reference.fingerprint(products.withColumn("name", F.lit("b")), ["id", "name"], one_, "x")
    assert tuple(reference.inputs_changed(a, b).first()) == (False, True, False)


def test_package_weights_of_one_place(spark):
    materials = spark.createDataFrame([(1,), (2,)], "slug long")
    containers = spark.createDataFrame([(7, 120.0), (8, 90.0)], "slug long, tare double")
    packages = spark.createDataFrame([(1, 3, 400.0, 7), (1, 3, 340.0, 8), (1, 2, None, None), (1, 9, 10.0, 8)], "material long, ord int, net double, container long")
    for order in (F.col("net"), F.col("net").desc()):
        found = fuzzy.package_weights(materials, packages.orderBy(order), containers)
        assert {tuple(r) for r in found.collect()} == {(1, 340.0, 90.0), (2, None, None)}
