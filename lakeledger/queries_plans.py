"""Queries of import plans, families, payloads and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import families, matching, passes, records, reference_payload
from .plans import import_plan, journal, reports, resolve
from .queries import OPTIONS, query
from .sources import snapshots, views
from .sources.shared import new_folder
from .sources.views import view

VENDOR_KEY = "trim(regexp_replace(regexp_replace(lower(trim(coalesce({}, ''))), '[-_]+', ' ', 'g'), '\\s+', ' ', 'g'))"
NAME_KEY = "trim(regexp_replace(lower(coalesce({}, '')), '\\s+', ' ', 'g'))"

#: Left products as members of families: one vendor and the first word of the material; with properties that sometimes differ.
MEMBERS = f"""members as (select id, vendor, name, string_split(material, ' ')[1] as material, case id % 7 when 0 then null when 1 then 1.25e0 else 1.24e0 end as density, case when id % 11 = 0 then 2.85e0 else 1.75e0 end as diameter,
  200 + id % 2 as nozzle_temp, case when id % 13 = 0 then null else 60 end as bed_temp, spool_weight as tare from left_product),
keyed as (select *, {VENDOR_KEY.format("vendor")} as v, {NAME_KEY.format("material")} as m from members),
active as (select product_id, count(*) filter (where not archived) as n from left_item group by 1),
ranked as (select k.*, coalesce(n, 0) as n_active, count(*) over (partition by v, m) as n_members, first_value(k.id) over (partition by v, m order by coalesce(n, 0) desc, length(name), k.id) as master_id from keyed k left join active on product_id = k.id)"""
FIELDS = ("material", "density", "diameter", "nozzle_temp", "bed_temp")


def _members(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "left_product")
    return rows.select(
        "id", "vendor", "name", F.get(F.split("material", " "), F.lit(0)).alias("material"), F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 7 == 1, 1.25).otherwise(1.24).alias("density"), F.when(F.col("id") % 11 == 0, 2.85).otherwise(1.75).alias("diameter"),
        (200 + F.col("id") % 2).alias("nozzle_temp"), F.when(F.col("id") % 13 == 0, None).otherwise(60).alias("bed_temp"), F.col("spool_weight").alias("tare"),
    )


def _families(spark: SparkSession, d: str) -> DataFrame:
    rows = _members(spark, d)
    return families.with_masters(rows.withColumn("cluster", text.cluster_key(F.col("vendor"), F.col("material"), F.col("name"), ())), view(spark, d, "left_item"))


@query(f"""{MEMBERS}, pairs as (select a.id, a.master_id, b.* exclude (id, master_id), a.material as x1, a.density as x2, a.diameter as x3, a.nozzle_temp as x4, a.bed_temp as x5 from ranked a join ranked b on b.id = a.master_id where a.n_members >= 2 and a.id <> a.master_id)
{" union all ".join(f"select id, master_id, '{f}' as field, cast({f} as varchar) as master_value, cast(x{k + 1} as varchar) as member_value from pairs where {f} is distinct from x{k + 1}" for k, f in enumerate(FIELDS))}""", "left_product", "left_item")
def property_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Properties in which a member differs from its master; the tare is no such property, a null against a value is."""
    return families.property_conflicts(_families(spark, d), FIELDS)


@query(f"""{MEMBERS}
select v as vendor, m as material, id, master_id, id = master_id as is_master, n_members as n,
  trim(vendor || ' ' || material) as base_name,
  case when id = master_id then 0 else (select cast(count(*) as int) from ranked b where b.id = r.master_id and b.density is distinct from r.density) + (select cast(count(*) as int) from ranked b where b.id = r.master_id and b.diameter is distinct from r.diameter)
    + (select cast(count(*) as int) from ranked b where b.id = r.master_id and b.nozzle_temp is distinct from r.nozzle_temp) + (select cast(count(*) as int) from ranked b where b.id = r.master_id and b.bed_temp is distinct from r.bed_temp) + (select cast(count(*) as int) from ranked b where b.id = r.master_id and b.material is distinct from r.material) end as n_conflicts
from ranked r where n_members >= 2""", "left_product", "left_item")
def variant_suggestions_left(spark: SparkSession, d: str) -> DataFrame:
    """Families that left products may form, their masters, and how many properties differ."""
    out = families.suggestions(_families(spark, d), FIELDS)
    return out.select("cluster.vendor", "cluster.material", "id", "master_id", "is_master", "n", F.concat_ws(" ", "vendor_name", "material_name").alias("base_name"), "n_conflicts")


@query(f"""keyed as (select id, {VENDOR_KEY.format("substr(vendor, 1, 7)")} as v, coalesce(nullif({NAME_KEY.format("replace(replace(replace(name, 'BLUE', ''), 'blue', ''), 'Blue', '')")}, ''), {NAME_KEY.format("name")}) as base_name, string_split(type, ' ')[1] as t, name from right_product),
ranked as (select *, count(*) over w as n, first_value(id) over (partition by v, base_name, t order by length(name), id) as parent_id from keyed window w as (partition by v, base_name, t))
select v as vendor, base_name, t as type, id, parent_id, id = parent_id as is_parent, n from ranked where n >= 2""", "right_product")
def variant_suggestions_right(spark: SparkSession, d: str) -> DataFrame:
    """Families among right products; the shortest name is the parent."""
    rows = view(spark, d, "right_product").withColumns({"color_word": F.lit("BLUE"), "vendor": F.substr("vendor", F.lit(1), F.lit(7)), "type": F.get(F.split("type", " "), F.lit(0))})
    return families.right_suggestions(rows)


@query(f"""{MEMBERS}, parents as (select {VENDOR_KEY.format("vendor")} as v, {NAME_KEY.format("string_split(type, ' ')[1]")} as m, min(id) as right_parent from right_product where parent_id is null or parent_id = id group by all),
tares as (select v, m, count(*) filter (where tare is null) as n_without, count(*) filter (where id <> master_id and exists (select 1 from ranked b where b.id = r.master_id and (b.density is distinct from r.density or b.diameter is distinct from r.diameter or b.nozzle_temp is distinct from r.nozzle_temp or b.bed_temp is distinct from r.bed_temp))) as n_differing,
  any_value(n_members) as n, any_value(master_id) as master_id from ranked r group by all)
select v as vendor, m as material, n, master_id, right_parent, n >= 2 or right_parent is not null as grouped, n_without, n_differing, case when n_without > 0 then 'needs_input' else 'left' end as tare_source from tares left join parents using (v, m)""", "left_product", "left_item", "right_product")
def variance_report(spark: SparkSession, d: str) -> DataFrame:
    """Every cluster (grouped or not), the right parent that is there, members that differ, and where tares come from."""
    right = view(spark, d, "right_product").withColumn("type", F.get(F.split("type", " "), F.lit(0)))
    out = families.variances(_families(spark, d), right.withColumn("cluster", text.cluster_key(F.col("vendor"), F.col("type"), F.col("name"), ())), FIELDS)
    return out.select("cluster.vendor", "cluster.material", "n", "master_id", "right_parent", "grouped", "n_without", "n_differing", "tare_source")


@query(f"""{MEMBERS}, parents as (select {VENDOR_KEY.format("vendor")} as v, {NAME_KEY.format("string_split(type, ' ')[1]")} as m, min(id) as right_parent from right_product where parent_id is null or parent_id = id group by all)
select k.id as left_id, right_parent as right_id from keyed k join parents using (v, m)""", "left_product", "left_item", "right_product")
def attached_variants(spark: SparkSession, d: str) -> DataFrame:
    """Left products that belong to a family which the right side has."""
    key = lambda material: text.cluster_key(F.col("vendor"), material, F.col("name"), ())
    right = view(spark, d, "right_product").filter("parent_id is null or parent_id = id")
    return matching.attach_to_families(_members(spark, d).withColumn("cluster", key(F.col("material"))), right.withColumn("cluster", key(F.get(F.split("type", " "), F.lit(0)))))


@query("""active as (select product_id, count(*) filter (where not archived) as n from left_item group by 1)
select 'left' as side, cast(p.id as varchar) as id, vendor, name, p.id % 3 = 0 as flag, coalesce(n, 0) as n_active, case when spool_weight is null then 'needs_input' else 'left' end as tare_source from left_product p left join active on product_id = p.id
union all select 'right', id, vendor, name, id in (select parent_id from right_product where parent_id <> id), null, null from right_product""", "left_product", "left_item", "right_product")
def product_refs(spark: SparkSession, d: str) -> DataFrame:
    """H6, H7: short references of both sides' products: tagged or container, active items, source of the tare."""
    extra = F.when(F.col("id") % 3 == 0, F.create_map(F.lit("uuid"), F.lit('"u1"'))).otherwise(F.create_map(F.lit("uuid"), F.lit('""')))
    return records.product_refs(view(spark, d, "left_product").withColumn("extra", extra), view(spark, d, "left_item"), view(spark, d, "right_product"), "uuid")


REFERENCE = """reference as (select p_partkey as id, concat('slug-', cast(p_partkey as varchar(20))) as slug, case when p_partkey % 9 = 0 then null else p_name end as name, p_brand as brand, case p_partkey % 4 when 0 then 'Silk PLA' when 1 then 'PETG' when 2 then '' else null end as type, case when p_partkey % 4 = 3 then 'ABS' else null end as abbreviation,
  case p_partkey % 5 when 0 then '#FF0000' when 1 then '' when 2 then null else '00ff00' end as color, case p_partkey % 3 when 0 then '#00FF00,#0000ff' when 1 then '' else '#ff0000' end as secondary_csv, case p_partkey % 6 when 0 then 'coextruded,silk' when 1 then 'gradient' when 2 then 'matte' else '' end as tags_csv,
  case when p_partkey % 8 = 0 then null else '1.27' end as density, case when p_partkey % 10 = 0 then null else cast(220 + p_size as varchar(9)) end as nozzle_max, case when p_partkey % 7 = 0 then 'n/a' else '60.6' end as drying_temp,
  case p_partkey % 11 when 0 then '29,7' when 1 then '28' when 2 then '' else '7' end as opt_tags_csv, case when p_partkey % 6 = 5 then null else cast(50 + p_size as varchar(9)) end as bed_max,
  case when p_partkey % 14 = 0 then '' else concat('u-', cast(p_partkey as varchar(20))) end as uuid, cast(p_size + 180 as varchar(9)) as nozzle_temp_min, case when p_partkey % 10 = 0 then null else concat(cast(220 + p_size as varchar(9)), '.5') end as nozzle_temp_max,
  '480' as drying_time, case when p_size % 2 = 0 then '94.5' else 'soft' end as hardness_shore_a, case when p_size % 3 = 0 then '40.25' else null end as hardness_shore_d, cast(p_size as double) as transmission_distance from part)"""
HEXES = "list_filter(list_concat([upper(regexp_replace(coalesce(color, ''), '^#+', ''))], list_transform(string_split(secondary_csv, ','), lambda h: upper(regexp_replace(h, '^#+', '')))), lambda h: h <> '')"


@query(f"""with {REFERENCE}, packs as (select l_partkey as material, l_linenumber as ord, l_orderkey as no, case when l_quantity > 25 then l_quantity * 10 end as full_weight, case when l_linenumber % 2 = 0 then l_suppkey end as container from lineitem),
holders as (select s_suppkey as id, case when s_suppkey % 3 = 0 then null else cast(s_suppkey as double) + 100 end as empty_weight from supplier),
weights as (select material, min_by(full_weight, (no, ord, full_weight)) filter (where full_weight is not null) as weight from packs group by 1),
tares as (select material, min_by(empty_weight, (no, ord, empty_weight)) as spool_weight from packs join holders h on h.id = container where empty_weight is not null group by 1),
shown as (select *, case when tags_csv like '%coextruded%' or list_contains(string_split(opt_tags_csv, ','), '29') then 'coextruded' when tags_csv like '%gradient%' or list_contains(string_split(opt_tags_csv, ','), '28') then 'gradient' end as arranged, coalesce(nullif(type, ''), abbreviation, '') as raw from reference),
counted as (select *, list_reduce(list_prepend([]::varchar[], list_transform({HEXES}, lambda h: [h])), lambda acc, h: case when list_contains(acc, h[1]) then acc else list_append(acc, h[1]) end) as hexes from shown)
select c.id, nullif(case when raw = 'Silk PLA' then 'PLA' else raw end, '') as material, array_to_string(list_filter([case when tags_csv = 'matte' then '16' end, case when raw = 'Silk PLA' or tags_csv like '%silk%' then '17' end], lambda x: x is not null), ',') as tags,
  case when len(hexes) = 1 and arranged is null then hexes[1] end as color_hex, case when len(hexes) >= 2 then array_to_string(hexes, ',') end as multi, case when len(hexes) >= 2 then case arranged when 'gradient' then 'longitudinal' else 'coaxial' end end as direction,
  try_cast(density as double) as density, 1.75::double as diameter, try_cast(nozzle_max as int) as nozzle_temp, try_cast(bed_max as int) as bed_temp, name, brand as vendor, slug, nullif(uuid, '') as uuid,
  {", ".join(f"try_cast(round_even(try_cast({c} as double), 0) as int) as {c}" for c in passes.OPTION_INTEGERS)}, {", ".join(f"try_cast({c} as double) as {c}" for c in passes.OPTION_FLOATS)}, weight::double as weight, spool_weight
from counted c left join weights w on w.material = c.id left join tares t on t.material = c.id""")
def reference_payloads(spark: SparkSession, d: str) -> DataFrame:
    """What a reference material writes to a left product: colors by their number, casts, weights of its packages."""
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    rows = views.from_sql(spark, d, ("part",), REFERENCE.partition(" as (")[2][:-1])
    rows = rows.withColumns({"secondary": F.split("secondary_csv", ","), "tags": F.filter(F.split("tags_csv", ","), lambda t: t != ""), "opt_tags": F.transform(F.filter(F.split("opt_tags_csv", ","), lambda t: t != ""), lambda t: t.cast("int"))})
    packages = read("lineitem").select(F.col("l_partkey").alias("material"), F.struct("l_orderkey", "l_linenumber").alias("ord"), F.when(F.col("l_quantity") > 25, F.col("l_quantity") * 10).alias("net"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey")).alias("container"))
    containers = read("supplier").select(F.col("s_suppkey").alias("slug"), F.when(F.col("s_suppkey") % 3 == 0, None).otherwise(F.col("s_suppkey").cast("double") + 100).alias("tare"))
    out = reference_payload.payloads(rows, packages, containers, {"silk": 17, "matte": 16})
    return out.withColumn("tags", F.array_join("tags", ","))


#: A plan of the whole left side, decided by ids: links to the mapped right product, creations, and skips.
CHOSEN = "chosen as (select id as left_id, case when id % 10 = 3 then 'skip' when id % 4 = 1 then 'create' else 'link' end as action, 'R' || id as right_id from left_product)"
PLANNED = f"""{CHOSEN}, live as (select id as item_id, product_id, remaining_weight from left_item where not archived and coalesce(remaining_weight, 0) > 0),
planned as (select l.id as left_id, action, case when action = 'link' then right_id end as right_id, item_id from left_product l join chosen c on c.left_id = l.id join live on product_id = l.id where action <> 'skip')"""


def _planned(spark: SparkSession, d: str) -> DataFrame:
    products = view(spark, d, "left_product")
    action = F.when(F.col("id") % 10 == 3, "skip").when(F.col("id") % 4 == 1, "create").otherwise("link")
    chosen = products.select(F.col("id").alias("left_id"), action.alias("action"), F.concat(F.lit("R"), F.col("id").cast("string")).alias("right_id"))
    return import_plan.plan(products, view(spark, d, "left_item"), view(spark, d, "right_product"), chosen, view(spark, d, "product_mapping"))


@query(f"""{MEMBERS}, {PLANNED}, made as (select left_id, action, right_id, count(*) as n from planned group by all),
named as (select p.left_id, p.action, r.master_id, r.n_members, r.master_id in (select left_id from made where action = 'create') and r.n_members >= 2 as in_family, r.vendor, r.material, r.name from made p join ranked r on r.id = p.left_id)
select left_id, case when action = 'link' then 'link' when not in_family then 'standalone' when left_id = master_id then 'master' else 'variant' end as role, case when action = 'create' and in_family and left_id <> master_id then master_id end as parent_left_id,
  case when action = 'create' then (case when starts_with({NAME_KEY.format("name")}, {NAME_KEY.format("vendor")}) then '' else trim(vendor) || ' ' end) || (case when contains({NAME_KEY.format("name")}, {NAME_KEY.format("material")}) then '' else trim(material) || ' ' end) || trim(name) end as planned_name
from named""", "left_product", "left_item")
def planned_roles(spark: SparkSession, d: str) -> DataFrame:
    """D1 (B, B.5), D12: roles and names of planned products: masters, variants under them, standalone ones."""
    return import_plan.roles(_planned(spark, d), _families(spark, d))


@query(f"""{MEMBERS}, {PLANNED}, made as (select left_id, action, right_id from planned group by all),
roles as (select p.left_id, action, p.right_id, master_id, master_id in (select left_id from made where action = 'create') and n_members >= 2 and action = 'create' as fam, tare from made p join ranked r on r.id = p.left_id)
select 0 as seq, 'container' as entity, left_id as id, 'create' as action from roles where fam and left_id = master_id
union all select 1, 'product', left_id, 'create' from roles where action = 'create' and (not fam or left_id = master_id)
union all select 2, 'variant', left_id, 'create' from roles where fam and left_id <> master_id
union all select 3, 'reconcile', left_id, 'update' from roles where action = 'link'
union all select 4, 'tags', left_id, 'update' from roles where action = 'create'
union all select 5, 'identity', left_id, 'update' from roles
union all select 6, 'item', item_id, 'create' from planned""", "left_product", "left_item")
def execution_passes(spark: SparkSession, d: str) -> DataFrame:
    """All seven passes of an execution from left to right, in order."""
    planned = _planned(spark, d)
    return import_plan.execution_passes(planned, import_plan.roles(planned, _families(spark, d)))


@query("""live as (select id, product_id from right_item where not retired and coalesce(total_weight, 0) > 0),
used as (select product_id, count(*) as n from live group by 1),
known as (select right_id, min(left_id) as left_id from product_mapping where left_id in (select id from left_product) group by 1)
select 1 as seq, 'product' as entity, p.id as id, case when left_id is null then 'create' else 'link' end as action from right_product p join used u on u.product_id = p.id left join known k on k.right_id = p.id
union all select 2, 'item', l.id, 'create' from live l join right_product p on p.id = l.product_id where l.id not in (select right_item_id from item_mapping)""", "left_product", "right_product", "right_item", "product_mapping", "item_mapping")
def import_right_to_left(spark: SparkSession, d: str) -> DataFrame:
    """Plan and actions of an import from right to left."""
    return import_plan.right_to_left(view(spark, d, "right_product"), view(spark, d, "right_item"), view(spark, d, "left_product"), view(spark, d, "product_mapping"), view(spark, d, "item_mapping"))


@query(f"""{PLANNED}, fresh as (select distinct left_id, action from planned where action = 'create'),
changed as (select m.left_item_id as id, 'weight' as kind from item_mapping m join left_item l on l.id = m.left_item_id join snapshot_left s on s.entity_id = l.id where abs(l.remaining_weight - s.remaining_weight) >= 2),
asked as (select left_id as id, conflict_type as kind from conflict where resolved_at is null and not (conflict_type = 'new_record' and left_id in (select left_item_id from item_mapping)))
select 'create' as source, left_id as id, 'product' as kind from fresh union all select 'update', id, kind from changed union all select distinct 'conflict', id, kind from asked""", "left_product", "left_item", "item_mapping", "snapshot_left", "conflict")
def dry_run(spark: SparkSession, d: str) -> DataFrame:
    """What a run would do: planned creations, live updates, and conflicts but for those that are settled."""
    then = view(spark, d, "snapshot_left").withColumnRenamed("remaining_weight", "then")
    moved = view(spark, d, "item_mapping").join(view(spark, d, "left_item").select(F.col("id").alias("left_item_id"), "remaining_weight"), "left_item_id").join(then, F.col("left_item_id") == F.col("entity_id"))
    updates = moved.filter(F.abs(F.col("remaining_weight") - F.col("then")) >= OPTIONS.weight_threshold).select(F.col("left_item_id").alias("id"), F.lit("weight").alias("kind"))
    return reports.dry_run(_planned(spark, d), updates, view(spark, d, "conflict"), view(spark, d, "item_mapping").select(F.col("left_item_id").alias("left_id")))


@query("""asked as (select id, left_id, id % 2 = 0 as create_it from conflict where conflict_type = 'new_record' and resolved_at is null),
live as (select a.id, a.left_id, a.create_it, l.product_id, l.archived, coalesce(l.remaining_weight, 0) <= 0 as empty, p.right_id, m.left_item_id is not null as mapped from asked a left join left_item l on l.id = a.left_id left join (select left_id, min(right_id) as right_id from product_mapping group by 1) p on p.left_id = l.product_id left join item_mapping m on m.left_item_id = a.left_id)
select id, left_id, product_id, right_id, case when product_id is null then 'record is gone' when mapped then 'already mapped' when archived then 'archived' when empty then 'empty' end as error,
  case when product_id is null or mapped or archived or empty then null when right_id is null then 'create_product_and_item' else 'create_item' end as action from live""", "left_item", "product_mapping", "item_mapping", "conflict")
def imports_from_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Importing the record of a new-record conflict: under its mapped product, else with a new one; each row fails alone."""
    return resolve.import_records(view(spark, d, "conflict").filter("conflict_type = 'new_record'"), view(spark, d, "left_item"), view(spark, d, "product_mapping"), view(spark, d, "item_mapping"))


@query("""left_now as (select count(*) as n_open, cast(max(detected_at) as timestamp) as newest from conflict where resolved_at is null),
status as (select case when i.left_item_id is null then 'unlinked' else 'linked' end as status from left_item l left join item_mapping i on i.left_item_id = l.id)
select n_linked, n_unlinked, n_products, n_open, newest from (select count(*) filter (where status = 'linked') as n_linked, count(*) filter (where status = 'unlinked') as n_unlinked from status), (select count(*) as n_products from product_mapping), left_now""", "left_item", "item_mapping", "product_mapping", "conflict")
def sync_state(spark: SparkSession, d: str) -> DataFrame:
    """A10: one row of item, product and open-conflict counts, with the newest conflict."""
    return reports.sync_state(view(spark, d, "left_item"), view(spark, d, "item_mapping"), view(spark, d, "product_mapping"), view(spark, d, "conflict"))


@query("""fams as (select id, coalesce(parent_id, id) as family, tare from right_product),
context as (select v.id as variant_id, v.family as master_id, count(*) over (partition by v.family) as n_line, v.tare as value from fams v)
select variant_id, master_id, n_line, value, m.tare as master_value, p.left_id from context c left join right_product m on m.id = c.master_id left join (select right_id, min(left_id) as left_id from product_mapping group by 1) p on p.right_id = c.variant_id
where variant_id <> master_id and value is distinct from m.tare""", "right_product", "product_mapping")
def divergence_context(spark: SparkSession, d: str) -> DataFrame:
    """Variants whose tare differs from the master's, with the size of their line and their left product."""
    return families.divergences(view(spark, d, "right_product"), view(spark, d, "product_mapping"), "tare")


@query("""probe as (select 'brand#11' as vendor, 'blue' as base_name, 'FF0000' as color),
scored as (select p.id, p.name, (case when lower(p.vendor) = 'brand#11' then 0.5 else 0 end) + (case when contains(lower(p.name), 'blue') then 0.3 else 0 end) + (case when p.color_hex = 'FF0000' then 0.2 when p.color_hex is null then 0.1 else 0 end) as score from left_product p)
select id, round(score::double, 2) as score, row_number() over (order by round(score, 2) desc, name, id) as place from scored where score > 0 qualify place <= 8""", "left_product")
def suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Products that a conflict's record may mean (the best eight): vendor .5, base name .3, color .2, or .1 where it is not known."""
    return families.suggested(view(spark, d, "left_product"), "Brand#11", "blue", "FF0000", 8)


@query("""rows_ as (select id as ord, 'i' || id as id, case when id % 17 = 0 then 'failed' else 'created' end as action from left_product)
select id, action, row_number() over (order by action <> 'failed', ord) as place from rows_ qualify place <= 50""", "left_product")
def failures_first(spark: SparkSession, d: str) -> DataFrame:
    """The first page of results, failures before the rest."""
    rows = view(spark, d, "left_product").select(F.col("id").alias("ord"), F.concat(F.lit("i"), F.col("id").cast("string")).alias("id"), F.when(F.col("id") % 17 == 0, "failed").otherwise("created").alias("action"))
    return reports.page(records.failures_first(rows), 50).select("id", "action", "place")


@query("""rows_ as (select id, case when id % 5 = 0 then 'Unknown vendor' else vendor end as grp from left_product)
select id, grp, row_number() over (order by starts_with(lower(grp), 'unknown'), lower(grp), id) as place from rows_ qualify place <= 50""", "left_product")
def unknown_group_last(spark: SparkSession, d: str) -> DataFrame:
    """The first page of rows by group, unknown groups at the end."""
    rows = view(spark, d, "left_product").select("id", F.when(F.col("id") % 5 == 0, "Unknown vendor").otherwise(F.col("vendor")).alias("grp"))
    return reports.page(records.unknown_last(rows, "grp"), 50).select("id", "grp", "place")


@query("""rows_ as (select id, vendor as brand, id % 19 = 0 as stale, id % 4 as n_missing from left_product)
select id, row_number() over (order by stale desc, n_missing desc, lower(brand), id) as place from rows_ qualify place <= 60""", "left_product")
def completeness_order(spark: SparkSession, d: str) -> DataFrame:
    """The first page of the completeness report: stale ones, then most missing, then brand."""
    rows = view(spark, d, "left_product").select("id", F.col("vendor").alias("brand"), (F.col("id") % 19 == 0).alias("stale"), (F.col("id") % 4).alias("n_missing"))
    return reports.page(reports.by_completeness(rows), 60).select("id", "place")


@query("""select cast(id as varchar) as id, 'unlinked' as status from left_item where id not in (select left_item_id from item_mapping) union all select right_item_id, 'linked' from item_mapping""", "left_item", "item_mapping")
def match_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Several buckets as one table with a status, filtered by it and by text."""
    items, mapping = view(spark, d, "left_item"), view(spark, d, "item_mapping")
    free = items.join(mapping.select(F.col("left_item_id").alias("id")), "id", "left_anti")
    rows = records.merged_buckets(unlinked=free, linked=mapping.select(F.col("right_item_id").alias("id")))
    return reports.filtered(rows, status=("linked", "unlinked"))


@query("""select id, status, vendor from (select l.id, case when m.left_item_id is null then 'unlinked' else 'linked' end as status, p.vendor, p.name, coalesce(l.remaining_weight, 0) <= 0 as empty from left_item l join left_product p on p.id = l.product_id left join item_mapping m on m.left_item_id = l.id)
where status = 'linked' and not empty and (contains(lower(name), 'blue') or contains(lower(vendor), 'blue')) and vendor = 'Brand#11'""", "left_item", "left_product", "item_mapping")
def filtered_records(spark: SparkSession, d: str) -> DataFrame:
    """P10: records by status, text and column, without empty ones."""
    products = view(spark, d, "left_product").select(F.col("id").alias("product_id"), "vendor", "name")
    mapped = view(spark, d, "item_mapping").select(F.col("left_item_id").alias("id"), F.lit("linked").alias("status"))
    rows = view(spark, d, "left_item").join(products, "product_id").join(mapped, "id", "left").withColumn("status", F.coalesce("status", F.lit("unlinked")))
    rows = rows.withColumn("empty", F.coalesce("remaining_weight", F.lit(0.0)) <= 0)
    return reports.filtered(rows, text="blue", text_in=("name", "vendor"), hide_empty=True, status=("linked",), vendor=("Brand#11",)).select("id", "status", "vendor")


@query("""select m.left_item_id, m.right_item_id, l.product_id, l.remaining_weight, l.location, r.total_weight, r.retired, p.vendor, p.name from item_mapping m left join left_item l on l.id = m.left_item_id left join right_item r on r.id = m.right_item_id left join left_product p on p.id = l.product_id where m.right_item_id = 'S1'""", "item_mapping", "left_item", "right_item", "left_product")
def item_by_right_id(spark: SparkSession, d: str) -> DataFrame:
    """Everything that is known of one right item (a point lookup)."""
    out = records.item_detail(view(spark, d, "item_mapping"), view(spark, d, "left_item"), view(spark, d, "right_item"), view(spark, d, "left_product"), "S1")
    return out.select("left_item_id", "right_item_id", "product_id", "remaining_weight", "location", "total_weight", "retired", "vendor", "name")


@query(f"""{MEMBERS}, {PLANNED}, made as (select left_id, action, max(right_id) as right_id from planned group by all),
roles as (
  select p.left_id, right_id, master_id, case when action = 'link' then 'link' when not (master_id in (select left_id from made where action = 'create') and n_members >= 2) then 'standalone' when p.left_id = master_id then 'master' else 'variant' end as role
  from made p join ranked r on r.id = p.left_id),
first_run as (select left_id from made where left_id % 3 <> 0),
made_of as (
  select left_id, role, case when role = 'link' then right_id when left_id % 20 = 1 and left_id not in (select left_id from first_run) then null
    else case when left_id in (select left_id from first_run) and role in ('master', 'standalone') then 'first-' else '' end || case when role = 'variant' then 'variant-' else 'product-' end || left_id end as made_id
  from roles),
steps as (
  select 0 as seq, 'container' as entity, left_id as id, case when left_id in (select left_id from first_run) then 'first-' else '' end || 'container-' || left_id as made_id, null as parent_id, 'done' as status from roles where role = 'master'
  union all select case when role = 'variant' then 2 when role = 'link' then 3 else 1 end, case role when 'variant' then 'variant' when 'link' then 'reconcile' else 'product' end, r.left_id, m.made_id,
    case when role = 'variant' then case when master_id in (select left_id from first_run) then 'first-' else '' end || 'container-' || master_id when role = 'master' then case when r.left_id in (select left_id from first_run) then 'first-' else '' end || 'container-' || r.left_id end,
    case when m.made_id is null then 'failed' else 'done' end from roles r join made_of m using (left_id, role)
  union all select 4, 'tags', left_id, case when made_id is null then null else 'tags-' || left_id end, made_id, case when made_id is null then 'blocked' else 'done' end from made_of where role <> 'link'
  union all select 5, 'identity', left_id, case when made_id is null then null else 'identity-' || left_id end, made_id, case when made_id is null then 'blocked' else 'done' end from made_of
  union all select 6, 'item', item_id, case when made_id is null or item_id % 50 = 0 then null else 'item-' || item_id end, made_id, case when made_id is null then 'blocked' when item_id % 50 = 0 then 'failed' else 'done' end from planned join made_of using (left_id))
select seq, entity, id, status, made_id, parent_id from steps""", "left_product", "left_item")
def resumed_execution(spark: SparkSession, d: str) -> DataFrame:
    """D6, D19 with a journal: an execution that stopped in its first two passes goes on, and new ids reach variants, tags, identities and items."""
    planned = _planned(spark, d)
    todo_path = new_folder(spark, "actions")
    journal.actions("plan-1", planned, import_plan.roles(planned, _families(spark, d))).write.parquet(todo_path)
    todo = spark.read.parquet(todo_path)
    store = snapshots.SnapshotStore(spark, new_folder(spark, "journal"))
    made = F.when(F.col("entity") == "reconcile", F.col("given_id")).otherwise(F.concat_ws("-", "entity", F.col("id").cast("string")))
    first = todo.filter("seq <= 1 and id % 3 <> 0").select("key", F.lit(1).alias("attempt"), F.lit("done").alias("status"), F.concat(F.lit("first-"), made).alias("made_id"), F.lit(None).cast("string").alias("error"))
    with store.change() as step:  # what the first run left
        step.create("journal", first, ["key", "attempt"], buckets=8)

    def apply(ready: DataFrame) -> DataFrame:
        """Stands for the other system: some records cannot be made."""
        bad = (F.col("entity").isin("product", "variant") & (F.col("id") % 20 == 1)) | ((F.col("entity") == "item") & (F.col("id") % 50 == 0))
        bad = F.when(F.col("entity") == "variant", bad & (F.col("id") % 3 == 0)).otherwise(bad)
        return ready.select("key", F.when(bad, "failed").otherwise("done").alias("status"), F.when(~bad, made).alias("made_id"), F.when(bad, "refused").alias("error"))

    journal.resume(store, "journal", todo, apply)
    return journal.standing(todo, store.read("journal")).select("seq", "entity", "id", "status", "made_id", "parent_id")


_LINE = """line as (select id as variant_id, coalesce(parent_id, id) as master_id, tare, cast(replace(id, 'R', '') as bigint) as no from right_product where parent_id is not null and parent_id <> id),
decided as (select variant_id, master_id, case no % 3 when 0 then 'ignore' when 1 then 'apply_all' else 'variant_override' end as how, cast(100 + no % 2 as varchar) as value
  from line left join (select id as master_id, tare as master_tare from right_product) using (master_id) where tare is distinct from master_tare)"""


@query(f"""{_LINE}
select distinct right_id, 'tare' as field, value from (
  select master_id as right_id, value from decided where how = 'apply_all'
  union all select s.variant_id, value from decided d join line s using (master_id) where how = 'apply_all' and s.tare is not null
  union all select variant_id, value from decided where how = 'variant_override')""", "right_product")
def divergence_writes(spark: SparkSession, d: str) -> DataFrame:
    """What decisions on values that differ from the master's write: to the whole line, to one variant, or nothing."""
    right = view(spark, d, "right_product")
    no = F.replace("variant_id", F.lit("R")).cast("long")
    how = F.when(no % 3 == 0, "ignore").when(no % 3 == 1, "apply_all").otherwise("variant_override")
    decided = families.divergences(right, view(spark, d, "product_mapping"), "tare").select("variant_id", how.alias("how"), F.lit("tare").alias("field"), (100 + no % 2).cast("string").alias("value"))
    line = right.filter("parent_id is not null and parent_id <> id").select(F.col("id").alias("variant_id"), F.col("parent_id").alias("master_id"), F.col("tare").isNotNull().alias("overrides"))
    return resolve.divergence(decided, line)
