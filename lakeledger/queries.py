"""Queries over the stand-in views, one for each operator or family of operators, and their SQL.

The SQL states the expected rows on its own; ``with_views`` only puts the views in front.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import matching_sql
from .functions import color, text, units, values
from .operators import changes, conflicts, fuzzy, lexicon, matching, records, tare
from .options import Options
from .plans import decisions, import_plan, reports, resolve
from .sources import state
from .sources.views import from_sql, view, with_views
from .streaming import runner

OPTIONS = Options()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Registers a function under its name, with the SQL over ``views`` that must give its rows."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return register


LEFT_KEY = "select id, trim(regexp_replace(regexp_replace(lower(trim(vendor)), '[-_]+', ' ', 'g'), '\\s+', ' ', 'g')) as vendor, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) as name, regexp_replace(lower(trim(coalesce(color_hex, ''))), '^#+', '') as color from left_product"
RIGHT_KEY = "select id, trim(regexp_replace(regexp_replace(lower(trim(vendor)), '[-_]+', ' ', 'g'), '\\s+', ' ', 'g')) as vendor, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) as name, regexp_replace(lower(trim(coalesce(color, ''))), '^#+', '') as color from right_product"
KEYS = f"a as ({LEFT_KEY}), b as ({RIGHT_KEY})"
#: Matching without cross references, as SQL.
MATCHED = f"""{KEYS},
offers as (select vendor, name, color, count(*) as n, min(id) as right_id from b group by all),
firsts as (select vendor, name, color, min(id) as first_left from a group by all),
rows_ as (
  select a.id as left_id, case when n = 1 and a.id = first_left then right_id end as right_id,
    case when n > 1 then 'ambiguous' when n = 1 and a.id = first_left then 'matched' else 'unmatched_left' end as bucket
  from a left join offers using (vendor, name, color) join firsts using (vendor, name, color)
  union all select null, b.id, 'unmatched_right' from b anti join firsts using (vendor, name, color))"""


def _keys(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return matching.keyed(view(spark, d, "left_product"), "id", "vendor", "name", "color_hex"), matching.keyed(view(spark, d, "right_product"), "id", "vendor", "name", "color")


@query(f"""{MATCHED}, sums as (select product_id, count(*) as n_items, count(*) filter (where not archived) as n_active, round(sum(remaining_weight), 2) as weight from left_item group by 1)
select left_id, right_id, bucket, case when left_id is null then null else coalesce(n_items, 0) end as n_items, case when left_id is null then null else coalesce(n_active, 0) end as n_active, weight
from rows_ left join sums on product_id = left_id""", "left_product", "right_product", "left_item")
def reconcile_report(spark: SparkSession, d: str) -> DataFrame:
    """D16 with J1, A1, A2: every product of both sides, its bucket and items."""
    return reports.reconcile(view(spark, d, "left_product"), view(spark, d, "right_product"), view(spark, d, "left_item"))


@query(f"""{MATCHED}, sums as (select product_id, count(*) as n_items from left_item group by 1)
select bucket, count(*) as n_products, cast(coalesce(sum(n_items), 0) as bigint) as n_items from rows_ left join sums on product_id = left_id group by 1""", "left_product", "right_product", "left_item")
def reconcile_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the reconcile report."""
    return reports.summary(reconcile_report(spark, d))


@query(f"""{KEYS}, known as (select left_id, right_id from product_mapping where left_id in (select id from a) and right_id in (select id from b)),
fa as (select * from a where id not in (select left_id from known)), fb as (select * from b where id not in (select right_id from known)),
offers as (select vendor, name, color, count(*) as n, min(id) as right_id from fb group by all), firsts as (select vendor, name, color, min(id) as first_left from fa group by all)
select left_id, right_id, 'matched' as bucket from known
union all select fa.id, case when n = 1 and fa.id = first_left then right_id end, case when n > 1 then 'ambiguous' when n = 1 and fa.id = first_left then 'matched' else 'unmatched_left' end
  from fa left join offers using (vendor, name, color) join firsts using (vendor, name, color)
union all select null, fb.id, 'unmatched_right' from fb anti join firsts using (vendor, name, color)""", "left_product", "right_product", "product_mapping")
def match_with_references(spark: SparkSession, d: str) -> DataFrame:
    """J1 with the cross-reference pass (J2) over all known references in front."""
    return matching.match(*_keys(spark, d), view(spark, d, "product_mapping").select("left_id", "right_id"))


@query(f"""{KEYS}, offers as (select vendor, name, color, list_sort(list(id)) as ids from b group by all having count(*) > 1)
select a.id as left_id, array_to_string(ids, ',') as right_ids from a join offers using (vendor, name, color)""", "left_product", "right_product")
def ambiguous_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The right products that an ambiguous left one may be."""
    return matching.candidates(*_keys(spark, d)).select("left_id", F.array_join("right_ids", ",").alias("right_ids"))


@query("""select id, coalesce(nullif(array_to_string(list_filter(string_split(trim(regexp_replace(lower(name), '\\s+', ' ', 'g')), ' '),
  lambda w: w not in ('red','blue','black','white','grey','gray','green','yellow','orange','purple','pink','silver','gold','transparent','natural','brown','cyan','magenta','beige','navy','teal','violet','bronze','copper','clear')), ' '), ''), trim(lower(name))) as base_name,
  nullif(concat('#', coalesce(color_hex, '')), '#') as right_color, coalesce(round(price, 2), 0) as price
from left_product""", "left_product")
def scalar_names_and_colors(spark: SparkSession, d: str) -> DataFrame:
    """Base names without color words, color codes."""
    rows = view(spark, d, "left_product")
    return rows.select("id", text.without_colors(F.col("name"), F.lit(None).cast("string")).alias("base_name"), color.to_right(F.col("color_hex")).alias("right_color"), F.coalesce(F.round("price", 2), F.lit(0)).alias("price"))


@query("""select i.id, i.remaining_weight as net, round(i.remaining_weight + coalesce(p.spool_weight, 200.0), 2) as gross,
  round(greatest(i.remaining_weight - coalesce(p.spool_weight, 200.0), 0), 2) as net_if_gross, p.spool_weight is null as assumed, round(greatest(i.remaining_weight - 500, 0), 2) as clamped
from left_item i join left_product p on p.id = i.product_id""", "left_product", "left_item")
def weights_both_ways(spark: SparkSession, d: str) -> DataFrame:
    """Gross, net and clamped weights."""
    rows = view(spark, d, "left_item").join(view(spark, d, "left_product").select(F.col("id").alias("product_id"), "spool_weight"), "product_id")
    net, t = F.col("remaining_weight"), F.col("spool_weight")
    return rows.select("id", net.alias("net"), units.net_to_gross(net, t, 2).alias("gross"), units.gross_to_net(net, t, 2).alias("net_if_gross"), units.tare_assumed(t).alias("assumed"), units.clamp(net - 500).alias("clamped"))


@query("""select id, case when color_hex is null then 'single' when id % 3 = 0 then 'coextruded' when id % 3 = 1 then 'gradient' else 'multi_unknown' end as profile,
  case when color_hex is null then '||' when id % 3 = 0 then 'coextruded||' || color_hex || ',ABCDEF' when id % 3 = 1 then 'gradient|' || color_hex || '|ABCDEF' else '|' || color_hex || '|ABCDEF' end as sig,
  case when color_hex is null then null else color_hex end as main, case when color_hex is null then '' else color_hex || ',ABCDEF' end as multi
from left_product""", "left_product")
def multicolor_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Colors of one catalog as the other has them, and signatures that both share."""
    rows = view(spark, d, "left_product").withColumn("multi", F.concat("color_hex", F.lit(",ABCDEF"))).withColumn("direction", F.when(F.col("id") % 3 == 0, "coaxial").when(F.col("id") % 3 == 1, "longitudinal"))
    as_right = color.left_to_right(F.col("color_hex"), F.col("multi"), F.col("direction"), F.array().cast("array<int>"))
    back = color.right_to_left(as_right["color"], as_right["secondary"], as_right["tags"])
    return rows.select("id", color.left_profile(F.col("multi"), F.col("direction")).alias("profile"), color.left_signature(F.col("color_hex"), F.col("multi"), F.col("direction")).alias("sig"), color.representative(F.col("color_hex"), F.col("multi")).alias("main"), F.coalesce(back["multi"], F.lit("")).alias("multi"))


_CHANNEL = "('0x' || substr(ltrim({0}, '#'), {1}, 2))::int"


@query(f"""select pair, round(case when left_color_hex is null or right_color is null then 0.5
  else sqrt({" + ".join(f"({_CHANNEL.format('left_color_hex', k)} - {_CHANNEL.format('right_color', k)}) ** 2" for k in (1, 3, 5))}) / (255 * sqrt(3.0)) end, 6) as distance from pair_now""", "pair_now")
def color_distances(spark: SparkSession, d: str) -> DataFrame:
    """distance of the two colors of every pair; an unknown one is half way."""
    return view(spark, d, "pair_now").select("pair", F.round(color.distance(F.col("left_color_hex"), F.col("right_color")), 6).alias("distance"))


PAIRED = "p as (select m.left_item_id, m.right_item_id, l.id as left_id, l.remaining_weight as left_now, r.id as right_id, r.total_weight as right_now, l.product_id from item_mapping m left join left_item l on l.id = m.left_item_id left join right_item r on r.id = m.right_item_id)"
CHANGED = PAIRED + """, c as (
  select left_item_id, right_item_id, sl.remaining_weight as left_then, left_now, sr.total_weight as right_then, right_now,
    sl.remaining_weight is null or sr.total_weight is null as baseline,
    coalesce(abs(sl.remaining_weight - left_now) >= 2.0, false) as lc, coalesce(abs(sr.total_weight - right_now) >= 2.0, false) as rc
  from p left join snapshot_left sl on sl.entity_id = left_item_id left join snapshot_right sr on sr.entity_id = right_item_id where left_id is not null and right_id is not null)"""
CHANGE_VIEWS = ("left_item", "right_item", "item_mapping", "snapshot_left", "snapshot_right")


def _paired(spark: SparkSession, d: str) -> DataFrame:
    return changes.pairs(view(spark, d, "item_mapping"), view(spark, d, "left_item"), view(spark, d, "right_item"))


def _weight_changes(spark: SparkSession, d: str) -> DataFrame:
    return changes.weight_changes(_paired(spark, d), view(spark, d, "snapshot_left"), view(spark, d, "snapshot_right"), OPTIONS)


_DIRECTIONS, _POLICIES = ("two_way", "left_to_right", "right_to_left"), ("manual", "left_wins", "right_wins", "newest_wins")
RULED = f"""{CHANGED}, ruled as (select *, d.direction, e.policy, l_ts.captured_left as left_ts, l_ts.captured_right as right_ts from c
  join (select unnest({list(_DIRECTIONS)}) as direction) d on true join (select unnest({list(_POLICIES)}) as policy) e on true join item_times l_ts using (left_item_id))
select left_item_id, direction, policy, case when baseline then false else lc end as left_changed, case when baseline then false else rc end as right_changed,
  case when baseline or (not lc and not rc) then 'noop'
    when direction = 'left_to_right' then case when lc then 'push_right' else 'noop' end
    when direction = 'right_to_left' then case when rc then 'push_left' else 'noop' end
    when not rc then 'push_right' when not lc then 'push_left'
    when policy = 'left_wins' then 'push_right' when policy = 'right_wins' then 'push_left'
    when policy = 'newest_wins' then case when left_ts > right_ts then 'push_right' when left_ts < right_ts then 'push_left' else 'conflict' end else 'conflict' end as action from ruled"""


@query(RULED, *CHANGE_VIEWS, "item_times")
def policy_table(spark: SparkSession, d: str) -> DataFrame:
    """What each direction and policy would do about every pair's weights, by the times at which both sides were captured."""
    changed = _weight_changes(spark, d).select("left_item_id", "left_changed", "right_changed")
    times = view(spark, d, "item_times").select("left_item_id", "captured_left", "captured_right")
    rules = F.inline(F.array(*(F.struct(F.lit(x).alias("direction"), F.lit(y).alias("policy")) for x in _DIRECTIONS for y in _POLICIES)))
    rows = changed.join(times, "left_item_id").select("*", rules)
    act = values.action(F.col("left_changed"), F.col("right_changed"), F.col("direction"), F.col("policy"), F.col("captured_left"), F.col("captured_right"))
    return rows.select("left_item_id", "direction", "policy", "left_changed", "right_changed", act.alias("action"))


@query(CHANGED + """ select left_item_id, right_item_id, left_then, left_now, right_then, right_now, not baseline and lc as left_changed, not baseline and rc as right_changed,
  case when baseline then 'baseline' when not lc and not rc then 'noop' when lc and not rc then 'push_right' when rc and not lc then 'push_left' else 'conflict' end as action from c""", *CHANGE_VIEWS)
def weight_diff(spark: SparkSession, d: str) -> DataFrame:
    """Three-way weight changes of mapped items."""
    return _weight_changes(spark, d)


@query(CHANGED + """ select left_item_id, right_item_id, case when left_then > left_now then 'usage' else 'set' end as kind,
  case when left_then > left_now then round(left_then - left_now, 2) end as grams,
  case when left_then > left_now then round(right_now - round(left_then - left_now, 2), 2) else round(left_now + 200.0, 2) end as total_weight
from c where not baseline and lc and not rc""", *CHANGE_VIEWS)
def weight_pushes(spark: SparkSession, d: str) -> DataFrame:
    """Usage events and gross weights that a push writes."""
    return changes.weight_writes(_weight_changes(spark, d), F.lit(None).cast("double"), 2)


@query(PAIRED + """ select left_item_id, right_item_id, case when left_id is null and right_id is null then 'purge' when left_id is null then 'conflict' when left_item_id % 2 = 0 then 'purge' else 'conflict' end as fate
from p where left_id is null or right_id is null""", "left_item", "right_item", "item_mapping")
def deletion_fates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of which a side is gone."""
    return changes.deletions(_paired(spark, d), F.col("left_item_id") % 2 == 0)


@query("""n as (select p_partkey as pair, 'name' as field, lower(p_name) as l, case when p_partkey % 5 = 0 then 'x' else lower(p_name) end as r, case when p_partkey % 7 = 0 then 'x' else lower(p_name) end as tl, lower(p_name) as tr from part
  union all select p_partkey, 'size', cast(p_size as varchar), cast(p_size + p_partkey % 2 as varchar), case when p_partkey % 3 = 0 then null else cast(p_size as varchar) end, case when p_partkey % 3 = 0 then null else cast(p_size as varchar) end from part)
select pair, field, tl as left_then, l as left, tr as right_then, r as right,
  case when tl is null and tr is null then 'baseline' when l is not distinct from r and l is distinct from tl and r is distinct from tr then 'converge'
    when l is not distinct from tl and r is not distinct from tr then 'noop' when r is not distinct from tr then 'push_right' when l is not distinct from tl then 'push_left' else 'conflict' end as action
from n""".replace("n as (", "with n as (", 1))
def field_diff(spark: SparkSession, d: str) -> DataFrame:
    """The template of the field passes over long rows."""
    part = spark.read.parquet(f"{d}/part.parquet")
    k, name, size = F.col("p_partkey"), F.lower("p_name"), F.col("p_size").cast("string")
    struct = lambda f, a, b: F.struct(F.lit(f).alias("field"), a.alias("left"), b.alias("right"))
    now = part.select(k.alias("pair"), F.inline(F.array(struct("name", name, F.when(k % 5 == 0, "x").otherwise(name)), struct("size", size, (F.col("p_size") + k % 2).cast("string")))))
    old = F.when(k % 3 != 0, size)
    then = part.select(k.alias("pair"), F.inline(F.array(struct("name", F.when(k % 7 == 0, "x").otherwise(name), name), struct("size", old, old))))
    return changes.field_changes(now, then, OPTIONS)


@query("""select left_item.id, product_id, coalesce(m.left_id is not null, false) as product_mapped, coalesce(remaining_weight, 0) <= 0 as empty, case when m.left_id is not null then 'create_item' else 'import_product' end as route
from left_item left join product_mapping m on m.left_id = product_id where not archived and left_item.id not in (select left_item_id from item_mapping)""", "left_item", "item_mapping", "product_mapping")
def new_records(spark: SparkSession, d: str) -> DataFrame:
    """Active items without a mapping."""
    return changes.new_records(view(spark, d, "left_item"), view(spark, d, "item_mapping"), view(spark, d, "product_mapping"), True)


@query("""select id, case when left_id % 3 = 0 then 'noop' when left_id % 3 = 1 then 'push_right' else 'conflict' end as action from product_mapping""", "product_mapping")
def identity_pass(spark: SparkSession, d: str) -> DataFrame:
    """Identities that agree, are on one side or differ."""
    rows = view(spark, d, "product_mapping").select(F.col("id").alias("pair"), F.concat(F.lit("u"), F.col("left_id").cast("string")).alias("left_uuid"), F.when(F.col("left_id") % 3 == 0, F.concat(F.lit("u"), F.col("left_id").cast("string"))).when(F.col("left_id") % 3 == 2, "other").alias("right_uuid"))
    return changes.identity_changes(rows, OPTIONS).withColumnRenamed("pair", "id")


@query("""select entity_type, left_id, min(id) as conflict_id from conflict where resolved_at is null group by all""", "conflict")
def first_open_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """The first open conflict of each entity."""
    return conflicts.first_open(view(spark, d, "conflict"))


@query("""o as (select * from conflict where resolved_at is null), k as (select entity_type, left_id, field_name, conflict_type, min(id) as keep from o group by all)
select id, keep from o join k using (entity_type, left_id, field_name, conflict_type) where id > keep""", "conflict")
def duplicate_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Younger open conflicts of the same key."""
    return conflicts.prune_duplicates(view(spark, d, "conflict"))


@query("""f as (select distinct 'item' as entity_type, id - id % 2 as left_id, 'weight' as field_name, 'field' as conflict_type from left_item)
select count(*) as n, count(*) + (select max(id) from conflict) as last_id, count(distinct left_id) as n_left from f
where not exists (select 1 from conflict c where c.resolved_at is null and c.left_id = f.left_id and c.field_name = f.field_name and c.conflict_type = f.conflict_type and c.entity_type = f.entity_type)""", "conflict", "left_item")
def queued_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """New conflicts without an open one of their key, numbered without gaps after the last id."""
    found = view(spark, d, "left_item").select(F.lit("item").alias("entity_type"), (F.col("id") - F.col("id") % 2).alias("left_id"), F.lit("weight").alias("field_name"), F.lit("field").alias("conflict_type"))
    return conflicts.queue(view(spark, d, "conflict"), found).agg(F.count_distinct("id").alias("n"), F.max("id").alias("last_id"), F.count_distinct("left_id").alias("n_left"))


@query()
def queued_conflicts_all(spark: SparkSession, d: str) -> DataFrame:
    """The rows that all items add to the queue; their ids depend on the hash of the key, so a test holds them against SQL."""
    found = view(spark, d, "left_item").select(F.lit("item").alias("entity_type"), (F.col("id") - F.col("id") % 2).alias("left_id"), F.lit("weight").alias("field_name"), F.lit("field").alias("conflict_type"))
    return conflicts.queue(view(spark, d, "conflict"), found).select("id", *conflicts.KEY)


@query("""select c.id, c.left_id, case when m.left_item_id is not null then 'mapped' when i.id is null then 'gone' when archived then 'archived' when coalesce(remaining_weight, 0) <= 0 then 'empty' end as reason
from conflict c left join item_mapping m on m.left_item_id = c.left_id left join left_item i on i.id = c.left_id
where c.resolved_at is null and conflict_type = 'new_record' and (m.left_item_id is not null or i.id is null or archived or coalesce(remaining_weight, 0) <= 0)""", "conflict", "item_mapping", "left_item")
def stale_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """C20: new-record conflicts that have settled themselves."""
    return conflicts.resolve_stale(view(spark, d, "conflict"), view(spark, d, "left_item"), view(spark, d, "item_mapping"))


@query(PAIRED + " select c.id, c.left_id from conflict c where resolved_at is null and conflict_type = 'deletion' and left_id in (select left_item_id from p where p.left_id is not null and p.right_id is not null)", "left_item", "right_item", "item_mapping", "conflict")
def healed_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Deletion conflicts whose sides are back."""
    return conflicts.self_heal(view(spark, d, "conflict"), _paired(spark, d))


@query("select field_name, conflict_type, count(*) as n from conflict where resolved_at is null group by all", "conflict")
def conflict_counts(spark: SparkSession, d: str) -> DataFrame:
    """Open conflicts by field and type."""
    return conflicts.counts_by(view(spark, d, "conflict"), "field_name", "conflict_type")


TARES = """par as (select id as family, tare as pt from right_product), sib as (
  select parent_id as family, tare, row_number() over (partition by parent_id order by count(*) desc, tare) as n from right_product where parent_id is not null and tare is not null group by parent_id, tare),
fam as (select r.id, r.tare, r.parent_id, r.name, coalesce(r.parent_id, r.id) as family, coalesce(pt, sib.tare) as family_tare from right_product r left join par on par.family = coalesce(r.parent_id, r.id) left join sib on sib.family = coalesce(r.parent_id, r.id) and sib.n = 1)"""


@query(TARES + " select id, tare, family_tare from fam", "right_product")
def family_tares(spark: SparkSession, d: str) -> DataFrame:
    """A family's tare: the parent's, else the mode of the children."""
    return matching.family_tare(view(spark, d, "right_product"))


@query(TARES + """ select id, family, case when id in (select parent_id from right_product where parent_id <> id) or name like '% marker' then 'master' when parent_id is not null then 'variant' else 'standalone' end as role, tare, family_tare,
  case when coalesce(tare, family_tare) is null then 'missing' when tare is not null and family_tare is not null and tare <> family_tare then 'mismatch' when tare is null then 'missing' else 'set' end as status from fam""", "right_product")
def tare_report(spark: SparkSession, d: str) -> DataFrame:
    """Roles, tares and their status."""
    return tare.tare_rows(view(spark, d, "right_product"))


@query(TARES + " select id, family_tare as tare from fam where tare is null and family_tare is not null", "right_product")
def family_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Tares that are filled from the family."""
    return tare.filled_from_family(view(spark, d, "right_product"))


@query("""it as (select product_id, arg_min(spool_weight, id) as item_tare from (select id, product_id, case when id % 4 = 0 then 100.0 + id % 50 end as spool_weight from left_item) where spool_weight is not null group by 1),
ov as (select product_id, arg_min(tare, id) as override from (select id, product_id, 10.0 + id % 7 as tare from left_item where id % 90 = 0) group by 1),
fa as (select left_id as id, 5.0 as family_tare from product_mapping where left_id % 2 = 0)
select l.id, cast(coalesce(override, item_tare, spool_weight, family_tare) as double) as tare, case when override is not null then 'override' when item_tare is not null then 'item' when spool_weight is not null then 'product' when family_tare is not null then 'family' else 'none' end as source
from left_product l left join it on it.product_id = l.id left join ov on ov.product_id = l.id left join fa on fa.id = l.id""", "left_product", "left_item", "product_mapping")
def tare_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Where a left product's tare comes from."""
    items = view(spark, d, "left_item").withColumn("spool_weight", F.when(F.col("id") % 4 == 0, 100.0 + F.col("id") % 50))
    overrides = items.filter("id % 90 = 0").select("product_id", F.col("id").alias("item_id"), (10.0 + F.col("id") % 7).alias("tare"))
    families = view(spark, d, "product_mapping").filter("left_id % 2 = 0").select(F.col("left_id").alias("id"), F.lit(5.0).alias("family_tare"))
    return tare.left_tare(view(spark, d, "left_product"), items, families, overrides)


@query("""f as (select product_id, arg_min(price, id) as p from (select id, product_id, case when id % 3 = 0 then round(remaining_weight, 2) end as price from left_item) where price is not null group by 1)
select l.id, coalesce(p, price) as cost from left_product l left join f on f.product_id = l.id""", "left_product", "left_item")
def effective_costs(spark: SparkSession, d: str) -> DataFrame:
    """A4: an item's price, else the product's."""
    items = view(spark, d, "left_item").withColumn("price", F.when(F.col("id") % 3 == 0, F.round("remaining_weight", 2)))
    return tare.effective_cost(view(spark, d, "left_product"), items)


@query("""m as (select i.product_id, max(total_weight - coalesce(tare, 200)) as net from right_item i join right_product r on r.id = i.product_id where total_weight - coalesce(tare, 200) > 0 group by 1)
select r.id, round(greatest(500.0, net), 2) as weight from right_product r left join m on m.product_id = r.id""", "right_product", "right_item")
def nominal_weights(spark: SparkSession, d: str) -> DataFrame:
    """Net weight of a new left product."""
    return tare.nominal_weight(view(spark, d, "right_product").withColumn("nominal", F.lit(500.0)), view(spark, d, "right_item"))


@query("""c as (select l.*, trim(lower(vendor)) as v, trim(lower(material)) as m from left_product l), n as (select product_id, count(*) filter (where not archived) as k from left_item group by 1),
r as (select v, m, c.id, coalesce(k, 0) as k, length(name) as len from c left join n on n.product_id = c.id)
select v as vendor, m as material, count(*) as n, cast(sum(k) as bigint) as n_active, first(id order by k desc, len, id) as master_id from r group by 1, 2 having count(*) >= 2""", "left_product", "left_item")
def product_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters and their masters (finishes switched off)."""
    rows = view(spark, d, "left_product").withColumn("cluster", text.cluster_key(F.col("vendor"), F.col("material"), F.col("name"), ()))
    return matching.clusters(rows, view(spark, d, "left_item")).select("cluster.vendor", "cluster.material", "n", "n_active", "master_id")


@query("""f as (select distinct p_brand as cluster, p_partkey as id, unnest([1, 2, p_size % 2 + 5]) as finish from part), s as (select cluster, count(distinct id) as n from f group by 1)
select cluster, array_to_string(list_sort(list(finish)), ',') as finishes from (select cluster, finish from f join s using (cluster) group by cluster, finish, n having count(distinct id) = n) group by 1""".replace("f as (", "with f as (", 1))
def shared_finishes(spark: SparkSession, d: str) -> DataFrame:
    """Finishes that all members of a cluster have."""
    members = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("cluster"), F.col("p_partkey").alias("id"), F.array(F.lit(1).cast("long"), F.lit(2).cast("long"), (F.col("p_size") % 2 + 5).cast("long")).alias("finishes"))
    return tare.shared_finishes(members).select("cluster", F.array_join("finishes", ",").alias("finishes"))


@query("""e as (select r.id, r.parent_id, p.name as parent_name, coalesce(r.tare, p.tare) as tare, coalesce(r.color, p.color) as color,
  array_to_string(list_filter([case when r.tare is null and p.tare is not null then 'tare' end, case when r.color is null and p.color is not null then 'color' end], lambda x: x is not null), ',') as inherited
from right_product r left join right_product p on p.id = r.parent_id) select * from e""", "right_product")
def inherited_values(spark: SparkSession, d: str) -> DataFrame:
    """J14, J15, F32, F33, IO5: effective values of variants."""
    rows = matching.effective(view(spark, d, "right_product"), ["tare", "color"])
    return rows.select("id", "parent_id", "parent_name", "tare", "color", F.array_join("inherited", ",").alias("inherited"))


@query("""select m.id, m.left_id, m.right_id from product_mapping m where left_id not in (select id from left_product where id % 9 <> 0)""", "product_mapping", "left_product")
def stale_mappings(spark: SparkSession, d: str) -> DataFrame:
    """Mappings whose left product is gone."""
    return matching.stale_products(view(spark, d, "product_mapping"), view(spark, d, "left_product").filter("id % 9 <> 0")).select("id", "left_id", "right_id")


@query("""select m.id, m.left_id, m.right_id from product_mapping m where right_id not in (select id from right_product) and left_id not in (select product_id from left_item where id % 4 = 0)""", "product_mapping", "right_product", "left_item")
def orphaned_mappings(spark: SparkSession, d: str) -> DataFrame:
    """Mappings without right product and items."""
    used = view(spark, d, "left_item").filter("id % 4 = 0").select(F.col("product_id").alias("left_id"))
    return matching.orphaned_products(view(spark, d, "product_mapping"), view(spark, d, "right_product"), used).select("id", "left_id", "right_id")


@query("""x as (select id, concat('S', cast(id - id % 2 as varchar)) as xref from left_item where id not in (select left_item_id from item_mapping)),
y as (select id from right_item where id not in (select right_item_id from item_mapping))
select min(x.id) as left_item_id, xref as right_item_id, count(*) > 1 as contested from x join y on y.id = x.xref group by xref""", "left_item", "right_item", "item_mapping")
def adopted_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Unmapped items that name a free right item."""
    left = view(spark, d, "left_item").withColumn("xref", F.concat(F.lit("S"), (F.col("id") - F.col("id") % 2).cast("string")))
    return matching.adopt_orphans(left, view(spark, d, "right_item"), view(spark, d, "item_mapping"))


@query("""f as (select product_id, arg_min(v, id) as xref from (select id, product_id, case when id % 6 = 0 then concat('R', cast(product_id as varchar)) end as v from left_item) where v is not null group by 1) select * from f""", "left_item")
def first_references(spark: SparkSession, d: str) -> DataFrame:
    """J2, IO11: the first cross reference that a product's items carry."""
    items = view(spark, d, "left_item").withColumn("raw", F.when(F.col("id") % 6 == 0, values.encode(F.concat(F.lit("R"), F.col("product_id").cast("string"))))).withColumn("xref", values.decode(F.col("raw")))
    return matching.first_reference(items, "product_id", "xref", "id")


@query("""k as (select id, trim(lower(vendor)) as v, trim(lower(name)) as n from left_product), b as (select v, n, count(*) as n_batch from k group by 1, 2), t as (select trim(lower(vendor)) as v, trim(lower(name)) as n, count(*) as c from right_product group by 1, 2)
select k.id, n_batch, coalesce(c, 0) as n_there from k join b using (v, n) left join t using (v, n) where n_batch > 1 or coalesce(c, 0) > 0""", "left_product", "right_product")
def name_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Names that are taken, of all products."""
    return matching.name_collisions(view(spark, d, "left_product"), view(spark, d, "right_product"))


@query("""w as (select id, trim(lower(vendor)) as v, trim(lower(name)) as n, concat('R', cast(id - id % 3 as varchar)) as e from left_product), r as (select id, parent_id, trim(lower(vendor)) as v, trim(lower(name)) as n from right_product)
select w.id as left_id, first(r.id order by (r.parent_id is not distinct from e) desc, r.parent_id is not null, r.id) as right_id from w join r using (v, n) group by w.id""", "left_product", "right_product")
def found_by_name(spark: SparkSession, d: str) -> DataFrame:
    """The right product of a name, by preference."""
    wanted = view(spark, d, "left_product").withColumn("expected_parent", F.concat(F.lit("R"), (F.col("id") - F.col("id") % 3).cast("string")))
    return matching.find_by_name(wanted, view(spark, d, "right_product"))


@query("""select distinct trim(location) as location from left_item where coalesce(location, '') <> '' union select distinct upper(trim(location)) from left_item""", "left_item")
def all_locations(spark: SparkSession, d: str) -> DataFrame:
    """U1, J24, IO6, IO25: locations of both sides."""
    items = view(spark, d, "left_item")
    return reports.locations(items, items.select(F.upper("location").alias("location")))


STATUS = """o as (select left_id as id, min(id) as conflict_id from conflict where resolved_at is null and entity_type = 'item' group by 1),
s as (select i.id, product_id, m.right_item_id, conflict_id, case when conflict_id is not null then 'conflict' when m.right_item_id is null then 'unlinked' when i.id % 10 = 1 then 'pending' else 'in_sync' end as status
  from left_item i left join item_mapping m on m.left_item_id = i.id left join o on o.id = i.id)"""


def _status(spark: SparkSession, d: str) -> DataFrame:
    pending = view(spark, d, "left_item").filter("id % 10 = 1").select("id")
    return reports.item_status(view(spark, d, "item_mapping"), view(spark, d, "left_item"), view(spark, d, "conflict"), pending)


@query(STATUS + """ select 'item' as kind, s.id, product_id, vendor, name, status from s left join left_product p on p.id = s.product_id
union all select 'product', left_id, left_id, vendor, name, 'in_sync' from product_mapping m join left_product p on p.id = m.left_id where left_id not in (select product_id from s)""", "left_item", "item_mapping", "conflict", "left_product", "product_mapping")
def synced_records(spark: SparkSession, d: str) -> DataFrame:
    """Items with their status and mapped products without items."""
    return reports.synced_records(_status(spark, d), view(spark, d, "left_product"), view(spark, d, "product_mapping"))


@query(STATUS + " select status, count(*) as n from s group by 1", "left_item", "item_mapping", "conflict")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    """Items by status."""
    return reports.status_counts(_status(spark, d))


@query("""select left_id, right_id, case when left_id in (select left_id from conflict where resolved_at is null and entity_type = 'item') then 'conflict' when left_id % 5 = 0 then 'pending' else 'in_sync' end as status from product_mapping""", "product_mapping", "conflict")
def product_statuses(spark: SparkSession, d: str) -> DataFrame:
    """Status of mapped products."""
    asked = view(spark, d, "conflict").withColumn("entity_type", F.lit("product"))
    mapping = view(spark, d, "product_mapping")
    return reports.product_status(mapping, asked, mapping.filter("left_id % 5 = 0").select(F.col("left_id").alias("id")))


@query("""l as (select cycle_id from sync_log group by 1 order by max(logged_at) desc, cycle_id desc limit 5)
select id, entity_type, action, left_id from sync_log where cycle_id in (select cycle_id from l)""", "sync_log")
def recent_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Log rows of the last five cycles."""
    return reports.recent_cycles(view(spark, d, "sync_log"), 5).select("id", "entity_type", "action", "left_id")


@query("select id, entity_type, action, left_id from sync_log where entity_type = 'item' order by logged_at desc, id desc limit 50 offset 100", "sync_log")
def log_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of the item log."""
    return reports.log_page(view(spark, d, "sync_log"), 100, 50, entity_type="item").select("id", "entity_type", "action", "left_id")


@query("select cycle_id, entity_type, count(*) as n, count(distinct action) as n_actions from sync_log group by all", "sync_log")
def cycle_summary(spark: SparkSession, d: str) -> DataFrame:
    """Actions of each cycle."""
    return reports.cycle_summary(view(spark, d, "sync_log")).select(F.date_format("started", "yyyy-MM-dd HH:00:00").alias("cycle_id"), "entity_type", "n", "n_actions")


@query("""select l.id, l.entity_type, l.left_id, coalesce(case when m.left_id is not null then concat_ws(' ', p.vendor, p.name) end, p.name, concat('#', cast(l.left_id as varchar))) as label
from sync_log l left join left_product p on p.id = l.left_id left join product_mapping m on m.left_id = l.left_id and p.id is not null""", "sync_log", "product_mapping", "left_product")
def labelled_log(spark: SparkSession, d: str) -> DataFrame:
    """Log rows with names."""
    return reports.labelled(view(spark, d, "sync_log"), view(spark, d, "product_mapping"), view(spark, d, "left_product"))


@query("""select i.id as item_id, product_id, vendor, name, color_hex from left_item i join left_product p on p.id = i.product_id
where contains(lower(cast(i.id as varchar)), '42') or contains(lower(name), '42') or contains(lower(vendor), '42') or contains(lower(coalesce(color_hex, '')), '42') order by 1 limit 200""", "left_item", "left_product")
def item_search(spark: SparkSession, d: str) -> DataFrame:
    """A text search, at most 200 results."""
    return reports.search_items(view(spark, d, "left_item"), view(spark, d, "left_product"), "42").select("item_id", "product_id", "vendor", "name", "color_hex")


@query("""select (select count(*) from left_product) as n_left, (select count(*) from right_product) as n_right, (select count(*) from right_product where parent_id is null) as n_masters,
  count(*) as n_items, count(*) filter (where not archived) as n_active from left_item""", "left_product", "right_product", "left_item")
def health_counts(spark: SparkSession, d: str) -> DataFrame:
    """One row of counts."""
    return reports.health(view(spark, d, "left_product"), view(spark, d, "right_product"), view(spark, d, "left_item"))


PLAN = f"""{KEYS}, mp as (select left_id, right_id from product_mapping where left_id in (select id from a) and right_id in (select id from b)),
fa as (select * from a where id not in (select left_id from mp)), fb as (select * from b where id not in (select right_id from mp)),
mt as (select left_id, right_id from mp union all select fl, rid from (select vendor, name, color, min(id) as rid from fb group by all having count(*) = 1) join (select vendor, name, color, min(id) as fl from fa group by all) using (vendor, name, color)),
pl as (select l.id as left_id, l.vendor, l.name, l.material, l.spool_weight as tare, case when l.id % 11 = 0 then 'skip' when m.right_id is not null then 'link' else 'create' end as action, m.right_id from left_product l left join mt m on m.left_id = l.id),
pn as (select pl.*, i.id as item_id, i.remaining_weight from pl join left_item i on i.product_id = pl.left_id where action <> 'skip' and not archived and coalesce(remaining_weight, 0) > 0),
pr as (select left_id, first(action) as action, first(tare) as tare, count(*) as n_items, sum(remaining_weight) as weight from pn group by 1)"""
PLAN_VIEWS = ("left_product", "right_product", "left_item", "product_mapping")


def _plan(spark: SparkSession, d: str) -> DataFrame:
    skip = view(spark, d, "left_product").filter("id % 11 = 0").select(F.col("id").alias("left_id"), F.lit("skip").alias("action"), F.lit(None).cast("string").alias("right_id"))
    return import_plan.plan(view(spark, d, "left_product"), view(spark, d, "left_item"), view(spark, d, "right_product"), skip, view(spark, d, "product_mapping"))


@query(PLAN + " select left_id, item_id, action, case when action = 'link' then right_id end as right_id, remaining_weight from pn", *PLAN_VIEWS)
def import_plan_rows(spark: SparkSession, d: str) -> DataFrame:
    """What an import does to every item."""
    return _plan(spark, d).select("left_id", "item_id", "action", "right_id", "remaining_weight")


@query(PLAN + " select action, count(*) as n_products, cast(sum(n_items) as bigint) as n_items, count(*) filter (where tare is null) as n_default_tare, round(sum(round(weight, 2)), 2) as weight from pr group by 1", *PLAN_VIEWS)
def import_preview(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the plan."""
    return import_plan.preview(_plan(spark, d))


@query(PLAN + " select left_id from pr where action = 'create' and tare is null", *PLAN_VIEWS)
def import_tare_gate(spark: SparkSession, d: str) -> DataFrame:
    """Creations that lack a tare."""
    return import_plan.blocked_by_tare(_plan(spark, d)).select("left_id")


@query(PLAN + " select case when action = 'create' then 1 else 2 end as seq, 'product' as entity, left_id as id, action from pr union all select 3, 'item', item_id, 'create' from pn", *PLAN_VIEWS)
def import_actions(spark: SparkSession, d: str) -> DataFrame:
    """The ordered actions of an execution."""
    return import_plan.execution(_plan(spark, d))


@query("""select id, case when color_hex is null then '' else concat('#', color_hex) end as color, lower(name) as name, vendor, round(price, 2) as cost, cast(spool_weight as double) as tare from left_product""", "left_product")
def right_payloads(spark: SparkSession, d: str) -> DataFrame:
    """D2, IO12: payloads for the right side, read back from their JSON."""
    rows = import_plan.right_payload(view(spark, d, "left_product"))
    p = F.from_json("payload", "name string, vendor string, color string, cost double, spoolWeight double")
    return rows.select("id", p.alias("p")).select("id", F.coalesce("p.color", F.lit("")).alias("color"), "p.name", "p.vendor", "p.cost", F.col("p.spoolWeight").alias("tare"))


@query("""select id, trim(name) as name, vendor, type as material, cast(1.24 as double) as density, cast(1.75 as double) as diameter, nullif(ltrim(color, '#'), '') as color_hex, tare as spool_weight from right_product""", "right_product")
def left_payloads(spark: SparkSession, d: str) -> DataFrame:
    """D3: new left products with their defaults."""
    rows = view(spark, d, "right_product").withColumn("density", F.lit(None).cast("double")).withColumn("diameter", F.lit(None).cast("double"))
    return import_plan.left_payload(rows)


@query("""d as (select id, left_id, field_name, case id % 4 when 0 then 'left' when 1 then 'right' when 2 then 'manual' else 'other' end as resolution, 'L' || cast(id as varchar) as lv, cast(id as varchar) || '.256' as rv, 'x' as mv from conflict where resolved_at is null),
v as (select *, case resolution when 'left' then lv when 'right' then rv when 'manual' then mv end as val from d),
e as (select *, case when resolution = 'other' then 'unknown resolution' when resolution = 'manual' and field_name = 'color' then 'not by hand' when field_name = 'weight' and val is not null and try_cast(val as double) is null then 'not a number' end as error from v)
select id, resolution, val as value, error from e""", "conflict")
def conflict_choices(spark: SparkSession, d: str) -> DataFrame:
    """Chosen values and why a decision cannot be applied."""
    c = _conflict_values(spark, d)
    return resolve.choose(c, _decisions(c)).select("id", "resolution", "value", "error")


def _conflict_values(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "conflict").withColumn("left_value", F.concat(F.lit("L"), F.col("id").cast("string"))).withColumn("right_value", F.concat(F.col("id").cast("string"), F.lit(".256")))


def _decisions(c: DataFrame) -> DataFrame:
    how = F.when(F.col("id") % 4 == 0, "left").when(F.col("id") % 4 == 1, "right").when(F.col("id") % 4 == 2, "manual").otherwise("other")
    return c.filter("resolved_at is null").select("id", how.alias("resolution"), F.lit("x").alias("manual"))


@query("""d as (select id, field_name, case id % 4 when 0 then 'left' when 1 then 'right' else 'manual' end as how, case id % 4 when 0 then 'L' || cast(id as varchar) when 1 then cast(id as varchar) || '.256' else 'x' end as val from conflict where resolved_at is null and id % 4 <> 3),
k as (select * from d where not (how = 'manual' and field_name = 'color') and not (field_name = 'weight' and try_cast(val as double) is null))
select id, unnest(case how when 'left' then ['right'] when 'right' then ['left'] else ['left', 'right'] end) as side, case when field_name = 'weight' then cast(id as varchar) || '.26' else val end as value from k""", "conflict")
def conflict_writes(spark: SparkSession, d: str) -> DataFrame:
    """What resolved conflicts write, on which side."""
    c = _conflict_values(spark, d)
    return resolve.writes(resolve.choose(c, _decisions(c))).select("id", "side", "value")


@query("""d as (select id, field_name, case id % 4 when 0 then 'left' when 1 then 'right' when 2 then 'manual' end as how, case id % 4 when 0 then 'L' || cast(id as varchar) when 1 then cast(id as varchar) || '.256' else 'x' end as val from conflict where resolved_at is null and id % 4 <> 3),
k as (select * from d where not (how = 'manual' and field_name = 'color') and not (field_name = 'weight' and try_cast(val as double) is null))
select c.id, case when k.id is not null then timestamp '2030-01-01' else cast(resolved_at as timestamp) end as resolved_at, how as resolution, val as resolved_value from conflict c left join k on k.id = c.id""", "conflict")
def resolved_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """H3: the conflict table after decisions, those that cannot be applied left open."""
    none = F.lit(None).cast("string")
    c = _conflict_values(spark, d).withColumns({"resolution": none, "resolved_value": none})
    now = F.to_timestamp(F.lit("2030-01-01"))
    return resolve.resolved(c, resolve.choose(c, _decisions(c)), now).select("id", F.col("resolved_at").cast("timestamp").alias("resolved_at"), "resolution", "resolved_value")


@query("""select id, case when id % 2 = 0 then 'usage' when id % 3 = 0 then 'set' else 'none' end as kind, case when id % 2 = 0 then cast(10.0 as double) end as grams, round(greatest(remaining_weight + case when id % 2 = 0 then -10 when id % 3 = 0 then 7 else 0 end, 0), 2) as weight from left_item""", "left_item")
def weight_convergence(spark: SparkSession, d: str) -> DataFrame:
    """Absolute weights as events or sets."""
    rows = view(spark, d, "left_item")
    target = F.col("remaining_weight") + F.when(F.col("id") % 2 == 0, -10.0).when(F.col("id") % 3 == 0, 7.0).otherwise(0.0)
    return resolve.converge_weight(rows.select("id", F.col("remaining_weight").alias("current"), target.alias("target")))


@query("""n as (select string_split(lower(trim(p_name)), ' ') as w, p_brand as brand from part), g as (
  select 1 as n, unnest(w) as term, brand from n union all select 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), brand from n
  union all select 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), brand from n)
select n, term, count(*) as freq, count(distinct brand) as brands from g where term is not null group by all""".replace("n as (", "with n as (", 1))
def ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    """N-grams of names and the brands that use them."""
    return lexicon.counts(lexicon.ngrams(spark.read.parquet(f"{d}/part.parquet"), "p_name", "p_brand"))


@query("""n as (select string_split(lower(trim(p_name)), ' ') as w, p_brand as brand from part), u as (select unnest(w) as t from n), f as (select t, count(*) as f from u group by 1),
b as (select unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as term from n), c as (select term, count(*) as freq from b group by 1)
select term, freq, round(freq * (select count(*) from part) / (x.f * y.f), 6) as lift from c join f x on x.t = split_part(term, ' ', 1) join f y on y.t = split_part(term, ' ', 2)""".replace("n as (", "with n as (", 1))
def bigram_lifts(spark: SparkSession, d: str) -> DataFrame:
    """Lift of two-word terms."""
    part = spark.read.parquet(f"{d}/part.parquet")
    counted = lexicon.counts(lexicon.ngrams(part, "p_name", "p_brand", 2))
    return lexicon.lifts(counted, F.lit(part.count())).select("term", "freq", F.round("lift", 6).alias("lift"))


@query(matching_sql.MINED)
def mined_lexicon(spark: SparkSession, d: str) -> DataFrame:
    """Modifiers and colors of names after coverage, with seeds and counts."""
    return lexicon.mine(spark.read.parquet(f"{d}/part.parquet"), "p_name", "p_brand", "p_type")


def decomposed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    right = view(spark, d, "right_product")
    terms = lexicon.index(lexicon.mine(right, "name", "vendor", "type"))
    multi, secondary = F.coalesce("multi", F.lit("")), F.filter(F.split("secondary_csv", ","), lambda h: h != "")
    some = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", 1).otherwise(0)
    left = fuzzy.decomposed(
        view(spark, d, "left_product").join(view(spark, d, "left_palette"), "id"), "id", "vendor", "name", "material", "color_hex", OPTIONS, terms,
        profile=color.left_profile(F.col("multi"), F.col("direction")), hexes=F.when(multi != "", 1 + F.size(F.split(multi, ","))).otherwise(some("color_hex")),
    )
    tags = F.transform(F.filter(F.split("tags_csv", ","), lambda t: t != ""), lambda t: t.cast("int"))
    right = fuzzy.decomposed(
        right.join(view(spark, d, "right_palette"), "id"), "id", "vendor", "name", "type", "color", OPTIONS, terms,
        profile=color.right_profile(secondary, tags, F.array().cast("array<string>")), hexes=some("color") + F.size(secondary),
    )
    return left, right


@query(matching_sql.RANKED)
def fuzzy_matches(spark: SparkSession, d: str) -> DataFrame:
    """Best and alternate reference products of each left one."""
    return fuzzy.matches(*decomposed(spark, d), OPTIONS)


@query(matching_sql.REASONS)
def no_match_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why products have no match of 0.8 or more."""
    left, right = decomposed(spark, d)
    top = fuzzy.best_scores(left, right)
    return fuzzy.unmatched_reason(left, right.select("brand").distinct(), top.filter("score >= 0.8"), top)


@query(f"""{matching_sql.SCORED}
select right_id, score from scored s join products a on a.pid = 'l' || left_id join products b on b.pid = 'r' || right_id
where left_id = (select cast(min(id) as varchar) from left_product) and (a.family = '' or b.family = '' or a.family = b.family) order by score desc, right_id limit 50""")
def manual_search(spark: SparkSession, d: str) -> DataFrame:
    """The first left product searched by hand in the whole reference (a top-50 report)."""
    left, right = decomposed(spark, d)
    return fuzzy.search(right, left.orderBy("id").limit(1), OPTIONS, 50).select("right_id", "score")


@query()
def fuzzy_matches_with_names(spark: SparkSession, d: str) -> DataFrame:
    """W2 with the name similarity F46 (Arrow), and known identities pinned."""
    there = view(spark, d, "right_product").select(F.col("id").alias("right_id"))
    known = view(spark, d, "product_mapping").select("left_id", "right_id").join(there, "right_id", "left_semi")
    return fuzzy.pinned(fuzzy.matches(*decomposed(spark, d), OPTIONS, with_names=True), known)


@query("""m as (select left_id, right_id from product_mapping), l as (select id, lower(trim(name)) as name, lower(trim(vendor)) as vendor from left_product), r as (select id, lower(trim(name)) as name, lower(trim(vendor)) as vendor, tare from right_product),
x as (select left_id, right_id, 'name' as field, l.name as a, r.name as b from m join l on l.id = left_id join r on r.id = right_id union all select left_id, right_id, 'vendor', l.vendor, r.vendor from m join l on l.id = left_id join r on r.id = right_id
  union all select left_id, right_id, 'spool_weight', coalesce(cast(cast(p.spool_weight as bigint) as varchar), ''), coalesce(cast(cast(r.tare as bigint) as varchar), '') from m join left_product p on p.id = left_id join r on r.id = right_id)
select left_id, right_id, field, a <> b as differs, a <> b and b <> '' as writes from x""", "product_mapping", "left_product", "right_product")
def candidate_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of matched pairs that differ."""
    rows = fuzzy.field_rows(view(spark, d, "product_mapping"), view(spark, d, "left_product"), view(spark, d, "right_product"), {"name": "name", "vendor": "vendor", "spool_weight": "tare"})
    return rows.select("left_id", "right_id", "field", "differs", "writes")


@query("""select m.left_id, cast(cast(r.tare as bigint) as varchar) || '.0' as tare from product_mapping m join left_product l on l.id = left_id join right_product r on r.id = right_id where r.tare is not null and r.tare is distinct from l.spool_weight and left_id % 8 <> 0""", "product_mapping", "left_product", "right_product")
def field_patches(spark: SparkSession, d: str) -> DataFrame:
    """The fields to write, without those that are kept."""
    mapping = view(spark, d, "product_mapping")
    rows = fuzzy.field_rows(mapping, view(spark, d, "left_product"), view(spark, d, "right_product"), {"spool_weight": "tare"})
    keep = mapping.filter("left_id % 8 = 0").select("left_id", F.lit("spool_weight").alias("field"))
    return fuzzy.patch(rows, keep).select("left_id", F.try_element_at("patch", F.lit("spool_weight")).alias("tare"))


@query("""select id, id as uuid, m.x is null as stale, coalesce(array_to_string(list_filter([case when color is null then 'color' end, case when tare is null then 'tare' end], lambda c: c is not null), ','), '') as missing
from (select left_id as id, right_id as rid from product_mapping) t left join (select id as x, color, tare from right_product) m on m.x = t.rid""".replace("select id, id as uuid", "select id, rid as uuid").replace("coalesce(array_to_string(", "case when m.x is null then '' else array_to_string(").replace("','), '') as missing", "',') end as missing"), "product_mapping", "right_product")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    """Reference fields that a tagged product lacks, stale tags kept."""
    tagged = view(spark, d, "product_mapping").select(F.col("left_id").alias("id"), F.col("right_id").alias("uuid"))
    out = fuzzy.completeness(tagged, view(spark, d, "right_product").select(F.col("id").alias("uuid"), "color", "tare"), ["color", "tare"])
    return out.select("id", "uuid", "stale", F.array_join("missing", ",").alias("missing"))


@query("""pk as (select product_id as material, id as ord, case when id % 3 = 0 then remaining_weight end as net, id % 100 as c from left_item), j as (select pk.*, case when c % 4 <> 0 then 100.0 + c end as tare from pk),
f as (select material, arg_min(net, ord) filter (where net is not null) as net, arg_min(tare, ord) filter (where tare is not null) as tare from j group by 1)
select l.id as slug, net, cast(tare as double) as tare from left_product l left join f on f.material = l.id""", "left_product", "left_item")
def package_weights(spark: SparkSession, d: str) -> DataFrame:
    """Net weight and tare from packages and their containers."""
    packages = view(spark, d, "left_item").select(F.col("product_id").alias("material"), F.col("id").alias("ord"), F.when(F.col("id") % 3 == 0, F.col("remaining_weight")).alias("net"), (F.col("id") % 100).alias("container"))
    containers = spark.range(100).select(F.col("id").alias("slug"), F.when(F.col("id") % 4 != 0, 100.0 + F.col("id")).alias("tare"))
    return fuzzy.package_weights(view(spark, d, "left_product").select(F.col("id").alias("slug")), packages, containers)


@query("""select s.entity_id, case when t.entity_id is not null then t.remaining_weight else s.remaining_weight end as remaining_weight from snapshot_left s left join (select id as entity_id, remaining_weight from left_item) t using (entity_id)
union all select id, remaining_weight from left_item where id not in (select entity_id from snapshot_left)""", "snapshot_left", "left_item")
def snapshot_upsert(spark: SparkSession, d: str) -> DataFrame:
    """IO13, IO14, IO18: keyed upsert of snapshot rows."""
    new = view(spark, d, "left_item").select(F.col("id").alias("entity_id"), "remaining_weight")
    return state.upsert(view(spark, d, "snapshot_left"), new, ["entity_id"])


@query("""select id, action from sync_log where logged_at >= (select max(logged_at) from sync_log) - interval 7 day""", "sync_log")
def retained_log(spark: SparkSession, d: str) -> DataFrame:
    """IO19: the last seven days of the log."""
    log = view(spark, d, "sync_log")
    now = log.agg(F.max("logged_at").alias("now")).first()["now"]
    return state.retained(log, 7, F.lit(now)).select("id", "action")


@query("""select date_trunc('hour', logged_at) as hour, action, count(*) as n from sync_log group by all""", "sync_log")
def hourly_actions(spark: SparkSession, d: str) -> DataFrame:
    """The streaming aggregate over the log, run as a batch."""
    return runner.hourly_actions(view(spark, d, "sync_log"))


@query("""hashed as (select sha256(concat_ws('|', cast(id as varchar), coalesce(vendor, chr(0)), coalesce(name, chr(0)), coalesce(color_hex, chr(0)))) as h from left_product),
sums as (select ('0x' || substr(h, 1, 3))::int as b, count(*) as n, sum(('0x' || substr(h, 4, 12))::bigint) as s0, sum(('0x' || substr(h, 16, 12))::bigint) as s1,
  sum(('0x' || substr(h, 28, 12))::bigint) as s2, sum(('0x' || substr(h, 40, 12))::bigint) as s3 from hashed group by 1),
lines as (select n, concat_ws(':', b::varchar, n::varchar, s0::varchar, s1::varchar, s2::varchar, s3::varchar) as line from sums)
select sum(n)::bigint as n, sha256(string_agg(line, chr(10) order by line)) as digest from lines""", "left_product")
def content_digest(spark: SparkSession, d: str) -> DataFrame:
    """A12, IO10: one digest of all products, whatever their order."""
    return reports.content_digest(view(spark, d, "left_product"), ["id", "vendor", "name", "color_hex"])


@query("""select cast(id as varchar) as id, 'product' as section, concat_ws(' | ', coalesce(vendor, ''), coalesce(name, ''), coalesce(material, '')) as line from left_product
union all select cast(id as varchar), 'item', concat_ws(' | ', coalesce(cast(product_id as varchar), ''), coalesce(cast(remaining_weight as varchar), ''), coalesce(location, '')) from left_item
union all select id, 'right_product', concat_ws(' | ', coalesce(vendor, ''), coalesce(name, ''), coalesce(type, ''), coalesce(color, ''), coalesce(cast(tare as varchar), ''), coalesce(parent_id, '')) from right_product
union all select id, 'right_item', concat_ws(' | ', coalesce(product_id, ''), coalesce(cast(total_weight as varchar), ''), coalesce(cast(retired as varchar), '')) from right_item""", "left_product", "left_item", "right_product", "right_item")
def state_dump(spark: SparkSession, d: str) -> DataFrame:
    """IO20, H25: the state of both sides as lines of text, four sections in order."""
    return state.dump_lines(*(view(spark, d, v) for v in ("left_product", "left_item", "right_product", "right_item"))).select("id", "section", "line")


#: Version texts of two systems: with and without a v, two or three numbers, none at all.
TOLD_VERSIONS = """select event_id as id,
  case when event_id % 17 = 0 then 'x' when event_id % 19 = 0 then null else concat(case when event_id % 5 = 0 then 'v' else '' end, cast(event_id % 3 as varchar(9)), '.', cast(user_id % 12 as varchar(9)), case when event_id % 4 = 0 then '' else concat('.', cast(event_id % 10 as varchar(9))) end) end as a,
  case when user_id % 23 = 0 then '-' else concat(cast(user_id % 3 as varchar(9)), '.', cast(event_id % 12 as varchar(9)), '.0') end as b from events"""
_VERSION = "list_concat(list_transform(string_split(regexp_extract(coalesce({0}, ''), '^v?(\\d+(?:\\.\\d+){{0,2}})', 1), '.'), lambda x: coalesce(try_cast(x as int), 0)), [0, 0, 0])[1:3]"
_READ = "regexp_matches(coalesce({0}, ''), '^v?\\d+(\\.\\d+)*')"


@query(f"""with t as ({TOLD_VERSIONS})
select id, {_READ.format("a")} and {_READ.format("b")} and {_VERSION.format("a")} > {_VERSION.format("b")} as newer, {_VERSION.format("a")} = [0, 0, 0] or {_VERSION.format("a")} >= {_VERSION.format("b")} as enough from t""")
def versions(spark: SparkSession, d: str) -> DataFrame:
    """Versions that two systems tell, compared."""
    rows = from_sql(spark, d, ("events",), TOLD_VERSIONS)
    return rows.select("id", units.is_newer(F.col("a"), F.col("b")).alias("newer"), units.at_least(F.col("a"), F.col("b")).alias("enough"))


@query("""select cast(unnest(['a', 'k' || cast(id % 3 as varchar)]) as varchar) as key, id from left_product""".replace("select cast(", "u as (select cast(").replace("from left_product", "from left_product) select key, count(*) as n from u group by 1"), "left_product")
def field_definitions(spark: SparkSession, d: str) -> DataFrame:
    """IO4: keys of an open map."""
    extra = F.create_map(F.lit("a"), F.lit("1"), F.concat(F.lit("k"), (F.col("id") % 3).cast("string")), F.lit("2"))
    return records.field_definitions(view(spark, d, "left_product").select(extra.alias("extra")))


EIGHT = {"material": ("left_material", "right_type"), "color": ("left_color_hex", "right_color"), "cost": ("left_cost", "right_cost"), "nozzle_temp": ("left_nozzle_temp", "right_nozzle_temp"), "bed_temp": ("left_bed_temp", "right_bed_temp"),
         "density": ("left_density", "right_density"), "spool_weight": ("left_spool_weight", "right_tare"), "net_weight": ("left_weight", "right_net_weight")}
_FORM = "case when regexp_matches({0}, '^[+-]?\\d+(\\.0*)?$') then cast(cast(cast({0} as double) as hugeint) as varchar) else {0} end"
_SEEN = "lower(trim(coalesce(cast({} as varchar), '')))"


@query(" union all ".join(f"select pair, '{n}' as field, cast({a} as varchar) as left, cast({b} as varchar) as right, {_FORM.format(_SEEN.format(a))} = {_FORM.format(_SEEN.format(b))} as agree from pair_now" for n, (a, b) in EIGHT.items()).replace(" as left,", ' as "left",').replace(" as right,", ' as "right",'), "pair_now")
def side_by_side(spark: SparkSession, d: str) -> DataFrame:
    """Eight fields of every pair next to each other."""
    rows = view(spark, d, "pair_now").withColumns({"left_item_id": F.col("pair"), "right_item_id": F.col("pair")})
    return records.side_by_side(rows, [(n, a, b) for n, (a, b) in EIGHT.items()]).select(F.col("left_item_id").alias("pair"), "field", "left", "right", "agree")


@query("""select entity_id, min(captured_at) as anchor, max(captured_at) as last_synced from (select cast(entity_id as varchar) as entity_id, 10 + entity_id % 5 as captured_at from snapshot_left union all select replace(entity_id, 'S', ''), 12 from snapshot_right) group by 1""", "snapshot_left", "snapshot_right")
def snapshot_anchors(spark: SparkSession, d: str) -> DataFrame:
    """The captures between which an entity changed."""
    a = view(spark, d, "snapshot_left").select(F.col("entity_id").cast("string").alias("entity_id"), (10 + F.col("entity_id") % 5).alias("captured_at"))
    b = view(spark, d, "snapshot_right").select(F.replace("entity_id", F.lit("S"), F.lit("")).alias("entity_id"), F.lit(12).cast("long").alias("captured_at"))
    return records.anchors(a.union(b))


@query("""select m.id, m.left_id, case when left_id % 6 = 0 then 'R0' else right_id end as right_id from product_mapping m where left_id % 10 <> 1""", "product_mapping")
def relinked_mappings(spark: SparkSession, d: str) -> DataFrame:
    """Mappings after relinking some and unlinking others."""
    mapping = view(spark, d, "product_mapping")
    linked = decisions.relink(mapping, mapping.filter("left_id % 6 = 0").select("left_id", F.lit("R0").alias("right_id")))
    return decisions.unlink(linked, mapping.filter("left_id % 10 = 1")).select("id", "left_id", "right_id")


@query("""select id as left_id, 'tare' as field, cast(200 + id % 3 as varchar) as value from left_product where spool_weight is distinct from 200 + id % 3""", "left_product")
def minimal_patches(spark: SparkSession, d: str) -> DataFrame:
    """The rows of a payload that change something."""
    rows = view(spark, d, "left_product")
    payload = rows.select(F.col("id").alias("left_id"), F.lit("tare").alias("field"), (200 + F.col("id") % 3).cast("string").alias("value"))
    current = rows.select(F.col("id").alias("left_id"), F.lit("tare").alias("field"), F.col("spool_weight").cast("string").alias("value"))
    return decisions.minimal_patch(payload, current)


@query("""select i.id, case i.id % 4 when 3 then null else 'shelf ' || cast(i.id % 4 as varchar) end as location from left_item i""", "left_item")
def located_items(spark: SparkSession, d: str) -> DataFrame:
    """Names of locations, unknown ids without one."""
    places = spark.range(3).select("id", F.concat(F.lit("shelf "), F.col("id").cast("string")).alias("name"))
    return records.located(view(spark, d, "left_item").select("id", (F.col("id") % 4).alias("location_id")), places).select("id", "location")
