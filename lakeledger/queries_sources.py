"""Queries over stored state: archives, snapshots in buckets, changes of several tables, cached matches."""

from __future__ import annotations

from contextlib import suppress
from importlib import util

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import matching_sql
from .operators import fuzzy, lexicon
from .queries import OPTIONS, decomposed, query
from .sources import archive, snapshots
from .sources.shared import delete_folder, new_folder
from .sources.views import view
from .streaming import runner


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def catalog_members(spark: SparkSession, d: str) -> DataFrame:
    """(name, body) of the archive members that the tables give: brands, materials with an anchor, an order's packages as several
    documents of one file, containers with a text block; and files that are no documents."""
    part, lines, supplier = (_read(spark, d, t) for t in ("part", "lineitem", "supplier"))
    slug = F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-"))
    brands = part.select("p_brand", slug.alias("slug")).distinct().select(
        F.concat(F.lit("catalog/data/brands/"), "slug", F.lit(".yaml")).alias("name"),
        F.format_string("# a brand\nslug: %s\nname: \"%s\"\n", "slug", "p_brand").alias("body"),
    )
    rgba = F.element_at(F.array(*map(F.lit, ("#ff0000ff", "#00FF00FF", "0000ffff", "~"))), (F.col("p_size") % 4 + 1).cast("int"))
    materials = part.select(
        F.concat(F.lit("catalog/data/materials/"), slug, F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".yaml")).alias("name"),
        F.format_string(
            "---\nslug: part-%d\nname: '%s'\ntype: |-\n  %s\nbase: &b {density: %d.5, drying_time: 480}\nproperties:\n  <<: *b\n  min_print_temperature: %d\nprimary_color: {color_rgba: %s}\ntags: [silk, \"matte\"]\n",
            "p_partkey", "p_name", "p_type", F.col("p_size") % 3, F.col("p_size") + 190,
            F.when(rgba == "~", rgba).otherwise(F.concat(F.lit("'"), rgba, F.lit("'"))),
        ).alias("body"),
    )
    text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    # the numbers are sorted, as their texts would be, and written out last: texts are many times as large
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", text((F.col("l_quantity") * 10).cast("long")).alias("net"))
    package = lambda x: F.concat(
        F.lit("slug: pack-"), text(F.col("l_orderkey")), F.lit("-"), text(x["l_linenumber"]), F.lit("\nmaterial: {slug: part-"), text(x["l_partkey"]),
        F.lit("}\ncontainer: &c\n  slug: supplier-"), text(x["l_suppkey"]), F.lit("\nagain: *c\nnominal_netto_full_weight: "), x["net"], F.lit("\n"),
    )
    ordered = lines.select("l_orderkey", row.alias("row")).repartition("l_orderkey").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("row")), package).alias("docs"))
    packages = ordered.select(
        F.concat(F.lit("catalog/data/material-packages/orders/"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lit(".yaml")).alias("name"),
        F.concat(F.lit("---\n"), F.array_join("docs", "---\n")).alias("body"),
    )
    containers = supplier.select(
        F.format_string("catalog/data/material-containers/%d.yml", "s_suppkey").alias("name"),
        F.format_string("slug: supplier-%d\nname: %s\nnote: >\n  two lines: of\n  text\nempty_weight: %d\n", "s_suppkey", "s_name", F.floor(F.abs("s_acctbal"))).alias("body"),
    )
    other = supplier.select(F.format_string("catalog/docs/%d.yaml", "s_suppkey").alias("name"), F.lit("][ no document").alias("body"))
    return brands.unionByName(materials).unionByName(packages).unionByName(containers).unionByName(other)


@query("""
with packs as (
  select l_partkey, l_orderkey, l_linenumber, (l_quantity * 10)::bigint as net, floor(abs(s_acctbal))::bigint as tare
  from lineitem left join supplier on s_suppkey = l_suppkey),
firsts as (
  select l_partkey, count(*) as n_packages,
    arg_min(net, (l_orderkey, l_linenumber))::double as net,
    arg_min(tare, (l_orderkey, l_linenumber)) filter (where tare is not null)::double as tare
  from packs group by l_partkey)
select 'part-' || p_partkey as slug, p_brand as brand, p_name as name, p_type as type,
  case p_size % 4 when 0 then 'FF0000' when 1 then '00FF00' when 2 then '0000FF' end as color,
  p_size % 3 + 0.5::double as density, p_size + 190::double as nozzle_temp_min, 480::double as drying_time,
  coalesce(n_packages, 0) as n_packages, net, tare
from part left join firsts on l_partkey = p_partkey""")
def archive_catalog(spark: SparkSession, d: str) -> DataFrame:
    """IO7, J9: archives written from the tables and read back in parts: materials with their brands, packages and containers."""
    path, index, few, table = (new_folder(spark, n) for n in ("archives", "archive-index", "documents", "catalog"))
    archive.write_archives(catalog_members(spark, d), path, per_file=50_000, packed=50)
    archive.write_index(spark, path, index, part_bytes=16 << 20)
    archive.indexed(spark, index, ("brand", "container")).write.parquet(few)  # a table, so that its size is known to the joins
    materials = archive.materials(archive.indexed(spark, index, ("material",)), spark.read.parquet(few))
    packages = archive.packages(archive.indexed(spark, index, ("package",), archive.PACKAGE_FIELDS))  # read once: one sum gives counts and weights
    totals = fuzzy.package_totals(packages, archive.containers(spark.read.parquet(few)))
    rows = materials.join(totals, materials["slug"] == totals["material"], "left")
    rows.select("slug", "brand", "name", "type", "color", "density", "nozzle_temp_min", "drying_time", F.coalesce("n_packages", F.lit(0)).alias("n_packages"), "net", "tare").write.parquet(table)
    for done in (path, index, few):
        delete_folder(spark, done)
    return spark.read.parquet(table)


@query("""base as (select entity_id, remaining_weight from snapshot_left),
one as (select id as entity_id, remaining_weight from left_item where id % 3 = 0),
two as (select id as entity_id, -1.0::double as remaining_weight from left_item where id % 100 = 1),
final as (
  select coalesce(t.entity_id, o.entity_id, b.entity_id) as entity_id,
    case when t.entity_id is not null then t.remaining_weight when o.entity_id is not null then o.remaining_weight else b.remaining_weight end as remaining_weight
  from base b full join one o on o.entity_id = b.entity_id full join two t on t.entity_id = coalesce(o.entity_id, b.entity_id))
select entity_id, remaining_weight, (entity_id in (select entity_id from base))::int + (entity_id in (select entity_id from base) or entity_id % 3 = 0)::int
  + (entity_id in (select entity_id from base) or entity_id % 3 = 0 or entity_id % 100 = 1)::int as seen
from final where entity_id % 10 <> 7""", "snapshot_left", "left_item")
def snapshot_rounds(spark: SparkSession, d: str) -> DataFrame:
    """IO13, IO14, IO18: a snapshot table through two upserts and a deletion, read after each; and how often each entity was there."""
    store = snapshots.SnapshotStore(spark, new_folder(spark, "snapshots"))
    items = view(spark, d, "left_item").select(F.col("id").alias("entity_id"), "remaining_weight")
    seen = []
    with store.change() as step:
        step.create("left", view(spark, d, "snapshot_left").select("entity_id", "remaining_weight"), ["entity_id"], buckets=8)
    seen.append(store.read("left").select("entity_id"))
    with store.change() as step:
        step.upsert("left", items.filter("entity_id % 3 = 0"))
    seen.append(store.read("left").select("entity_id"))
    with store.change() as step:
        step.upsert("left", items.filter("entity_id % 100 = 1").withColumn("remaining_weight", F.lit(-1.0)))
    seen.append(store.read("left").select("entity_id"))
    with store.change() as step:
        step.delete("left", seen[2].filter("entity_id % 10 = 7"))
        step.compact("left", most=3)
    times = seen[0].unionByName(seen[1]).unionByName(seen[2]).groupBy("entity_id").agg(F.count(F.lit(1)).alias("seen"))
    return store.read("left").join(times, "entity_id")


@query("""gone as (select left_id from product_mapping where left_id % 6 = 0)
select 'mapping' as kind, cast(left_id as varchar) as id, null as state from product_mapping where left_id not in (select left_id from gone)
union all select 'snapshot', cast(entity_id as varchar), null from snapshot_left where entity_id not in (select left_id from gone)
union all select 'snapshot', 'new-' || left_id, null from gone
union all select 'conflict', cast(id as varchar), case when resolved_at is not null then 'resolved' when left_id in (select left_id from gone) then 'settled' else 'open' end from conflict""", "product_mapping", "snapshot_left", "conflict")
def purge_in_one_step(spark: SparkSession, d: str) -> DataFrame:
    """Mappings, snapshots and conflicts of products that are gone change in one step, after a step that failed half-way."""
    store = snapshots.SnapshotStore(spark, new_folder(spark, "state"))
    snap = view(spark, d, "snapshot_left").select(F.col("entity_id").cast("string").alias("entity_id"), F.lit("weight").alias("field"), F.col("remaining_weight").cast("string").alias("value"))
    state = F.when(F.col("resolved_at").isNotNull(), "resolved").otherwise("open").alias("state")
    with store.change() as step:
        step.create("mapping", view(spark, d, "product_mapping").select("left_id", "right_id"), ["left_id"], buckets=8)
        step.create("snapshot", snap, ["entity_id", "field"], buckets=8)
        step.create("conflict", view(spark, d, "conflict").select("id", "left_id", state), ["id"], buckets=8)
    gone = store.read("mapping").filter("left_id % 6 = 0").select("left_id")  # the products that were deleted
    with suppress(InterruptedError), store.change() as step:  # this writer dies between two tables
        step.delete("mapping", gone)
        raise InterruptedError
    with store.change() as step:
        step.delete("mapping", gone)
        step.delete("snapshot", store.read("snapshot").join(gone.select(F.col("left_id").cast("string").alias("entity_id")), "entity_id", "left_semi"))
        step.upsert("conflict", store.read("conflict").filter("state = 'open'").join(gone, "left_id", "left_semi").withColumn("state", F.lit("settled")))
        first = gone.select(F.concat(F.lit("new-"), F.col("left_id").cast("string")).alias("entity_id"), F.lit("weight").alias("field"), F.lit("0").alias("value"))
        step.insert_absent("snapshot", first)
    none = F.lit(None).cast("string").alias("state")
    rows = [store.read("mapping").select(F.lit("mapping").alias("kind"), F.col("left_id").cast("string").alias("id"), none), store.read("snapshot").select(F.lit("snapshot").alias("kind"), F.col("entity_id").alias("id"), none)]
    return rows[0].unionByName(rows[1]).unionByName(store.read("conflict").select(F.lit("conflict").alias("kind"), F.col("id").cast("string").alias("id"), "state"))


@query(matching_sql.RANKED)
def fuzzy_matches_cached(spark: SparkSession, d: str) -> DataFrame:
    """IO10, H28, J7: matches kept by block; of two states of the catalogs the second scores only the brands that changed."""
    left, right = decomposed(spark, d)
    store = snapshots.SnapshotStore(spark, new_folder(spark, "matches"))
    before = left.filter("not (brand rlike '[37]$' and id % 20 = 0)")  # products of some brands that came later
    fuzzy.cached_matches(store, before, right, OPTIONS)
    fuzzy.cached_matches(store, left, right, OPTIONS)
    return store.read("matches").drop("brand")


@query(matching_sql.MINED)
def lexicon_kept(spark: SparkSession, d: str) -> DataFrame:
    """A14-A18 over names that come and go: stored counts follow a first load, removals, changes and additions."""
    part = _read(spark, d, "part")
    store = snapshots.SnapshotStore(spark, new_folder(spark, "lexicon"))
    update = lambda added, removed: lexicon.update_counts(store, "grams", added, removed, "p_name", "p_brand", "p_type")
    wrong = part.filter("p_partkey % 10 = 3").withColumn("p_name", F.concat(F.lit("velvet "), "p_name"))  # names before they were put right
    update(part.filter("p_partkey % 10 not in (3, 4)").unionByName(wrong), None)
    update(part.filter("p_partkey % 10 = 3"), wrong)
    update(part.filter("p_partkey % 10 = 4"), None)
    return lexicon.mine_stored(store, "grams")


def _round_sql(k: int) -> str:
    """Events of batch ``k`` and the state after it."""
    then = f"state{k - 1}" if k else "(select null::bigint as user_id, null::double as weight, null::timestamp as seen_at where false)"
    return f"""last{k} as (select user_id, value as now, ts as seen_at from events where event_id % 3 = {k} qualify row_number() over (partition by user_id order by ts desc, value desc) = 1),
told{k} as (
  select n.user_id, s.weight as then_, n.now, n.seen_at, case when s.user_id is null then 'baseline' when not n.seen_at > s.seen_at then 'late' when abs(s.weight - n.now) >= 25 then 'changed' else 'same' end as action
  from last{k} n left join {then} s using (user_id)),
state{k} as (
  select user_id, now as weight, seen_at from told{k} where action in ('baseline', 'changed')
  union all select * from {then} s where user_id not in (select user_id from told{k} where action in ('baseline', 'changed')))"""


STREAMED = f"""with {", ".join(map(_round_sql, range(3)))}
{" union all ".join(f"select cast(user_id as varchar) as entity_id, then_ as then, now, action from told{k}" for k in range(3))}""".replace("then_ as then", 'then_ as "then"')


def weight_event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The incremental run with its state by item: readings that arrive in three batches, compared with the last stored ones."""
    source, out, checkpoint = (new_folder(spark, n) for n in ("readings", "weight-events", "stream"))
    readings = _read(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("entity_id"), F.col("value").alias("weight"), F.col("ts").cast("timestamp").alias("seen_at"))
    before = {key: spark.conf.get(key, None) for key in runner.KEYED_CONF}
    for key, value in runner.KEYED_CONF.items():
        spark.conf.set(key, value)
    try:
        for k in range(3):  # a batch is there before the run that reads it
            readings.filter(F.col("event_id") % 3 == k).drop("event_id").write.mode("append").parquet(source)
            stream = spark.readStream.schema("entity_id string, weight double, seen_at timestamp").parquet(source)
            runner.run_keyed(stream, 25.0, checkpoint, out).awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(runner.EVENTS).parquet(out).drop("seen_at")


if util.find_spec("google") and util.find_spec("google.protobuf"):  # Spark's Python workers speak to the state store by it
    query(STREAMED)(weight_event_stream)
