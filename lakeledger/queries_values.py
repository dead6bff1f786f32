"""Queries of scalar functions and small records over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import color, text, units, values
from .operators import fuzzy, records
from .options import BASE_COLORS
from .plans import decisions, reports
from .queries import query
from .sources import state
from .sources.views import view

SPACED = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
VENDOR_KEY = "trim(regexp_replace(regexp_replace(lower(trim(coalesce({}, ''))), '[-_]+', ' ', 'g'), '\\s+', ' ', 'g'))"
NAME_KEY = "trim(regexp_replace(lower(coalesce({}, '')), '\\s+', ' ', 'g'))"


@query(f"""raw as (select id, case id % 3 when 0 then replace(vendor, '#', '_-') when 1 then '  ' || vendor || ' ' else vendor end as vendor,
  case id % 4 when 0 then 'caf' || chr(233) || ' ' || name when 1 then 'cafe' || chr(769) || ' ' || name when 2 then chr(65313) || name else name end as name from left_product),
plain as (select id, vendor, case id % 4 when 1 then 'caf' || chr(233) || substr(name, 6) when 2 then 'A' || substr(name, 2) else name end as name from raw)
select id, case when {VENDOR_KEY.format("vendor")} = 'brand 11' then 'eleven' else {VENDOR_KEY.format("vendor")} end as vendor_key, {NAME_KEY.format("name")} as name_key from plain""", "left_product")
def catalog_keys(spark: SparkSession, d: str) -> DataFrame:
    """vendor and name keys after Unicode NFKC (composed, full-width), vendors through the canonical map."""
    raw = view(spark, d, "left_product")
    vendor = F.when(F.col("id") % 3 == 0, F.replace("vendor", F.lit("#"), F.lit("_-"))).when(F.col("id") % 3 == 1, F.concat(F.lit("  "), "vendor", F.lit(" "))).otherwise(F.col("vendor"))
    name = F.when(F.col("id") % 4 == 0, F.concat(F.lit("caf\u00e9 "), "name")).when(F.col("id") % 4 == 1, F.concat(F.lit("cafe\u0301 "), "name")).when(F.col("id") % 4 == 2, F.concat(F.lit("\uff21"), "name")).otherwise(F.col("name"))
    rows = text.composed(raw.select("id", vendor.alias("vendor"), name.alias("name")), "vendor", "name")
    return rows.select("id", text.vendor_key(F.col("vendor"), {"brand 11": "eleven"}).alias("vendor_key"), text.name_key(F.col("name")).alias("name_key"))


WORDS_OF = "lower(concat(coalesce(name, ''), ' ', coalesce(material, '')))"
KEYWORDS = ("brushed", "plated", "anodized")
TOLD = "list_sort(list_distinct(list_filter([" + ", ".join(f"case when regexp_matches({WORDS_OF}, '\\b{w}\\b') then {i} end" for w, i in (("brushed", 5), ("plated", 6), ("steel", 5))) + "], lambda x: x is not null)))"


@query(f"""select id, coalesce({", ".join(f"case when regexp_matches({WORDS_OF}, '\\b{w}\\b') then '{w}' end" for w in KEYWORDS)}, '') as finish, '' as no_finish,
  array_to_string({TOLD}, ',') as tags,
  coalesce(nullif({SPACED.format("regexp_replace(regexp_replace(regexp_replace(material, '[\\s_-]*brushed[\\s_-]*', ' ', 'gi'), '[\\s_-]*plated[\\s_-]*', ' ', 'gi'), '[\\s_-]*steel[\\s_-]*', ' ', 'gi')")}, ''), trim(material)) as plain_material
from left_product""", "left_product")
def finishes(spark: SparkSession, d: str) -> DataFrame:
    """the first finish keyword, tags of all, material without them."""
    tags = {"brushed": 5, "plated": 6, "steel": 5}
    name, material = F.col("name"), F.col("material")
    return view(spark, d, "left_product").select("id", text.finish_line(name, material, KEYWORDS).alias("finish"), text.finish_line(name, material, ()).alias("no_finish"), F.array_join(text.finish_ids(name, material, tags), ",").alias("tags"), text.without_finishes(material, tags).alias("plain_material"))


STAMPS = "stamps as (select event_id as id, case event_id % 6 when 0 then cast(ts as varchar) when 1 then strftime(ts, '%Y-%m-%dT%H:%M:%SZ') when 2 then strftime(ts, '%Y-%m-%d') || 'T00:30:00' when 3 then 'unknown date' when 4 then '' else null end as registered, case event_id % 4 when 0 then strftime(ts, '%Y-%m-%d') when 1 then 'x' else null end as first_used from events)"


@query(f"""with {STAMPS}
select id, case when registered is null or registered = '' then null when try_cast(substr(registered, 1, 10) as date) is not null then substr(registered, 1, 10) when length(registered) >= 10 then substr(registered, 1, 10) end as purchased,
  case when first_used is null or first_used = '' then null when try_cast(substr(first_used, 1, 10) as date) is not null then substr(first_used, 1, 10) end as opened from stamps""")
def provenance_dates(spark: SparkSession, d: str) -> DataFrame:
    """purchase and opening dates of an item; a text that is no date gives its first ten characters."""
    ts = lambda form: F.date_format("ts", form)
    rows = spark.read.parquet(f"{d}/events.parquet")
    registered = F.when(F.col("event_id") % 6 == 0, F.col("ts").cast("string")).when(F.col("event_id") % 6 == 1, ts("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 6 == 2, ts("yyyy-MM-dd'T'00:30:00")).when(F.col("event_id") % 6 == 3, "unknown date").when(F.col("event_id") % 6 == 4, "")
    first_used = F.when(F.col("event_id") % 4 == 0, ts("yyyy-MM-dd")).when(F.col("event_id") % 4 == 1, "x")
    rows = rows.select(F.col("event_id").alias("id"), registered.alias("registered"), first_used.alias("first_used"))
    return rows.select("id", *units.provenance(F.col("registered"), F.col("first_used")))


@query(f"""pairs as (select l.id, l.vendor as a, r.vendor as b, l.name as name, l.material as material, l.color_hex from left_product l join product_mapping m on m.left_id = l.id join right_product r on r.id = m.right_id),
parts as (select *, {NAME_KEY.format("name")} as k, {NAME_KEY.format("a")} as v, {NAME_KEY.format("material")} as t from pairs)
select id, case when a <> b and {VENDOR_KEY.format("a")} = {VENDOR_KEY.format("b")} then a || ' = ' || b end as hint,
  (case when v = '' or starts_with(k, v) then '' else trim(a) || ' ' end) || (case when t = '' or contains(k, t) then '' else trim(material) || ' ' end) || trim(name) as display,
  concat_ws(' ', trim(a), trim(material), '(Master)') as container, regexp_replace(name || chr(10) || chr(9) || 'x', '[\\x00-\\x1f]', ' ', 'g') as scrubbed,
  coalesce(nullif({NAME_KEY.format("replace(replace(replace(name, 'Blue', ''), 'blue', ''), 'Blue', '')")}, ''), k) as without_color
from parts""", "left_product", "product_mapping", "right_product")
def display_names(spark: SparkSession, d: str) -> DataFrame:
    """display names and their guards, container names, hints, scrubbed text, names minus a color."""
    left = view(spark, d, "left_product")
    right = view(spark, d, "right_product").select(F.col("id").alias("right_id"), F.col("vendor").alias("b"))
    rows = left.join(view(spark, d, "product_mapping").select(F.col("left_id").alias("id"), "right_id"), "id").join(right, "right_id")
    vendor, material, name = F.col("vendor"), F.col("material"), F.col("name")
    return rows.select(
        "id", text.vendor_hint(vendor, F.col("b")).alias("hint"), text.display_name(vendor, material, name).alias("display"), text.container_name(vendor, material, F.lit(""), F.lit("(Master)")).alias("container"),
        text.scrub(F.concat(name, F.lit("\n\tx"))).alias("scrubbed"), text.minus_color(name, F.lit("blue")).alias("without_color"),
    )


@query("""select id, case when conflict_type = 'new_record' then case when id % 2 = 0 then 'new_left' else 'new_right' end when conflict_type = 'deletion' then 'deletion' when field_name = 'weight' then 'weight' when field_name = 'color' then 'color'
  when field_name = 'location' then 'location' else 'field' end as class from conflict""", "conflict")
def conflict_classes(spark: SparkSession, d: str) -> DataFrame:
    """the class of every conflict, as a user sees it."""
    queue = view(spark, d, "conflict").withColumn("right_value", F.when(F.col("id") % 2 != 0, "x"))
    return queue.select("id", values.conflict_class(F.col("field_name"), F.col("conflict_type"), F.lit("x"), F.col("right_value")).alias("class"))


@query("""select id, case when len(string_split(coalesce(case when id % 3 = 0 then color_hex || ',00AA00' when id % 3 = 1 then color_hex end, ''), ',')) >= 2 or id % 5 = 0 then true else false end as multicolor,
  case id % 4 when 0 then null when 1 then upper(substr(color_hex || 'ff', 1, 6)) when 2 then null else 'ABCDEF' end as hex
from left_product""", "left_product")
def multicolor_tests(spark: SparkSession, d: str) -> DataFrame:
    """F52, IO8: whether either side says that a product has several colors; RGBA codes as hex."""
    rows = view(spark, d, "left_product")
    csv = F.when(F.col("id") % 3 == 0, F.concat("color_hex", F.lit(",00AA00"))).when(F.col("id") % 3 == 1, F.col("color_hex"))
    tags = F.when(F.col("id") % 5 == 0, F.array(F.lit(28), F.lit(7))).otherwise(F.array(F.lit(7)))
    rgba = F.when(F.col("id") % 4 == 1, F.concat(F.coalesce("color_hex", F.lit("123")), F.lit("ff"))).when(F.col("id") % 4 == 2, "#ab").when(F.col("id") % 4 == 3, "##abcdef99")
    return rows.select("id", color.is_multicolor(csv, tags).alias("multicolor"), color.rgba_to_hex(rgba).alias("hex"))


@query(f"""tokens as (select l.id, list_distinct(string_split({NAME_KEY.format("l.name")}, ' ')) as a, list_distinct(string_split({NAME_KEY.format("r.name")}, ' ')[1:1 + l.id % 3]) as b from left_product l join right_product r on r.id = 'R' || l.id),
counted as (select id, len(a) as na, len(b) as nb, len(list_intersect(a, b)) as ni from tokens)
select id, case when na = 0 or nb = 0 then 0.5 when ni = 0 then 0.0 when ni = least(na, nb) then greatest(ni / (na + nb - ni), least(na, nb) / greatest(na, nb)) else ni / (na + nb - ni) end as similarity from counted""", "left_product", "right_product")
def token_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of two token sets with a bonus where one holds the other."""
    left, right = view(spark, d, "left_product"), view(spark, d, "right_product")
    rows = left.select("id", F.array_distinct(F.split(text.name_key(F.col("name")), " ")).alias("a"), F.concat(F.lit("R"), F.col("id").cast("string")).alias("rid")).join(right.select(F.col("id").alias("rid"), F.split(text.name_key(F.col("name")), " ").alias("all")), "rid")
    return rows.select("id", values.token_similarity(F.col("a"), F.array_distinct(F.slice("all", F.lit(1), (1 + F.col("id") % 3).cast("int")))).alias("similarity"))


@query("""parts as (select id, list_distinct(list_concat(string_split(lower(trim(vendor)), ' '), string_split(lower(trim(material)), ' '))) as gone, regexp_split_to_array(replace(lower(name), '/', ' & '), '[^a-z0-9_&]+') as ws from left_product)
select id, array_to_string(list_filter(ws, lambda w: len(w) > 1 and not regexp_matches(w, '^\\d+[a-z]?$') and not list_contains(gone, w)), ' ') as residual from parts""", "left_product")
def residual_names(spark: SparkSession, d: str) -> DataFrame:
    """the words of a name without those of vendor and material, numbers and grades."""
    words = text.residual_words(F.col("name"), F.col("vendor"), F.col("material"), {})
    return view(spark, d, "left_product").select("id", F.array_join(F.flatten(words), " ").alias("residual"))


COLORS_IN = "[" + ", ".join(f"'{c}'" for c in BASE_COLORS) + "]"


@query(f"""parts as (select id, list_distinct(list_concat(string_split(lower(trim(vendor)), ' '), string_split(lower(trim(material)), ' '))) as gone, regexp_split_to_array(lower(name), '[^a-z0-9_]+') as ws from left_product),
words as (select id, unnest(list_filter(ws, lambda w: len(w) > 1 and not list_contains(gone, w) and list_contains({COLORS_IN}, w))) as w from parts)
select id, w as color, count(*) as n from words group by all""", "left_product")
def named_colors(spark: SparkSession, d: str) -> DataFrame:
    """the colors that names decompose into, with how often each stands (synonyms are left as they are)."""
    parts = fuzzy.name_parts(F.col("name"), F.col("vendor"), F.col("material"), {}, frozenset(BASE_COLORS))
    rows = view(spark, d, "left_product").select("id", F.explode(parts.getField("colors")).alias("color"))
    return rows.groupBy("id", "color").agg(F.count("*").alias("n"))


@query("""select cast(id as varchar) as id, coalesce(vendor, '') as vendor, coalesce(cast(color_hex as varchar), '') as color_hex from left_product""", "left_product")
def label_columns(spark: SparkSession, d: str) -> DataFrame:
    """Wanted columns as text, unknown names skipped, null as empty."""
    rows = view(spark, d, "left_product")
    return records.label_fields(rows, rows.columns, ["id", "vendor", "no_such_column", "color_hex"])


@query("""cycles as (select left_id as id, count(*) as n_cycles, max(logged_at) as last_dried from sync_log where action = 'purchase' group by 1)
select p.id, coalesce(n_cycles, 0) as n_cycles, last_dried from left_product p left join cycles using (id)""", "left_product", "sync_log")
def drying(spark: SparkSession, d: str) -> DataFrame:
    """How often an item was dried and when last."""
    log = view(spark, d, "sync_log").filter("action = 'purchase'").groupBy(F.col("left_id").alias("id")).agg(F.collect_list(F.struct(F.col("logged_at").alias("at"))).alias("cycles"))
    return records.dry_cycles(view(spark, d, "left_product").select("id").join(log, "id", "left"))


FILES = "files as (select event_id as id, case event_id % 3 when 0 then 'state-' || strftime(ts, '%Y%m%d-%H%M%S') || '.json' when 1 then 'state-nostamp.json' else 'state-99999999-000000.json' end as name, ts + interval '1' hour as modified, event_id * 10 as length from events)"


@query(f"""with {FILES}
select cast(date_trunc('day', coalesce(try_strptime(regexp_extract(name, '(\\d{{8}}-\\d{{6}})', 1), '%Y%m%d-%H%M%S'), modified)) as date) as day, count(*) as n, cast(sum(length) as bigint) as bytes from files group by 1""")
def backup_files(spark: SparkSession, d: str) -> DataFrame:
    """Backup files by the day of their own stamp (else of their change), their number and bytes."""
    ts = F.date_format("ts", "yyyyMMdd-HHmmss")
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("state-"), ts, F.lit(".json"))).when(F.col("event_id") % 3 == 1, "state-nostamp.json").otherwise("state-99999999-000000.json")
    rows = spark.read.parquet(f"{d}/events.parquet").select(name.alias("name"), (F.col("ts") + F.expr("interval 1 hour")).alias("modified"), (F.col("event_id") * 10).alias("length"))
    return records.files_kept(rows.withColumn("day", F.to_date(records.file_time(F.col("name"), F.col("modified")))), "day")


@query("""select id, case when id % 3 = 0 then 'i' || id % 5 when id % 3 = 1 then 'i9' else 'p' || id end as created, case when id % 5 = 1 then 'tag1' when id % 5 = 2 then 'tag2' end as picked from left_product""", "left_product")
def echoed_children(spark: SparkSession, d: str) -> DataFrame:
    """IO21, H30: the child just created in an echoed parent (by label, else the last, else itself), and a child by its id."""
    child = lambda i, label, tag: F.struct(i.alias("id"), F.lit(label).alias("label"), F.lit(tag).alias("tag"))
    found = F.array(child(F.concat(F.lit("i"), (F.col("id") % 5).cast("string")), "mine", "tag1"), child(F.lit("i2"), "other", "tag2"), child(F.lit("i9"), "last", "tag9"))
    children = F.when(F.col("id") % 3 == 0, found).when(F.col("id") % 3 == 1, F.slice(found, 2, 2)).otherwise(F.slice(found, 1, 0))
    one = F.array(child(F.lit("i1"), "a", "tag1"), child(F.lit("i2"), "b", "tag2"))
    rows = view(spark, d, "left_product")
    return rows.select("id", records.created_child(children, F.lit("mine"), F.concat(F.lit("p"), F.col("id").cast("string"))).alias("created"), records.child_by_id(one, F.concat(F.lit("i"), (F.col("id") % 5).cast("string"))).getField("tag").alias("picked"))


@query("""select id, case when id % 2 = 0 then 'a=1,b=9,c=3' else 'a=1,b=2' end as merged, id % 2 = 0 as changed, 'b' as kept_keys from left_product""", "left_product")
def settings_bags(spark: SparkSession, d: str) -> DataFrame:
    """IO23: settings merged and removed by key; an equal bag is no write."""
    bag = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    new = F.when(F.col("id") % 2 == 0, F.create_map(F.lit("b"), F.lit("9"), F.lit("c"), F.lit("3"))).otherwise(F.create_map(F.lit("b"), F.lit("2")))
    flat = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    merged = state.merge_settings(bag, new)
    rows = view(spark, d, "left_product")
    return rows.select("id", flat(merged).alias("merged"), (flat(merged) != flat(bag)).alias("changed"), F.array_join(F.map_keys(state.without_keys(bag, ["a", "x"])), ",").alias("kept_keys"))


AUDIT = "audit as (select id, logged_at, case action when 'click' then 'create' when 'view' then 'update' when 'purchase' then 'usage' else 'skip' end as action, entity_type, left_id, case id % 3 when 0 then 'left_to_right' when 1 then 'right_to_left' else 'two_way' end as direction, cast(value as varchar) as value from sync_log)"


@query(f"""{AUDIT}
select id, concat_ws(' | ', strftime(logged_at, '%Y-%m-%d %H:%M:%S'), upper(action), entity_type || ' #' || left_id, case direction when 'left_to_right' then '-> right' when 'right_to_left' then '-> left' else '-> both' end,
  case action when 'create' then 'new' when 'update' then 'changed' when 'usage' then 'used' end) as line
from audit where action in ('create', 'update', 'delete', 'usage')""", "sync_log")
def change_lines(spark: SparkSession, d: str) -> DataFrame:
    """IO15, IO16, H27: one line for each audited change, with its target side."""
    kind = F.when(F.col("action") == "click", "create").when(F.col("action") == "view", "update").when(F.col("action") == "purchase", "usage").otherwise("skip")
    way = F.when(F.col("id") % 3 == 0, "left_to_right").when(F.col("id") % 3 == 1, "right_to_left").otherwise("two_way")
    return state.directed_lines(view(spark, d, "sync_log").withColumns({"action": kind, "direction": way}))


@query("""asked as (select id, case id % 4 when 0 then 'left' when 1 then 'right' when 2 then 'both' else '' end as source from left_product)
select id, case source when 'left' then 'left_to_right' when 'right' then 'right_to_left' else 'two_way' end as direction, case source when 'left' then 'right' when 'right' then 'left' else 'both' end as target from asked""", "left_product")
def legacy_directions(spark: SparkSession, d: str) -> DataFrame:
    """The direction that an older source-of-truth setting stands for, and the side it writes to."""
    source = F.when(F.col("id") % 4 == 0, "left").when(F.col("id") % 4 == 1, "right").when(F.col("id") % 4 == 2, "both").otherwise("")
    rows = view(spark, d, "left_product").select("id", decisions.direction_of(source).alias("direction"))
    return rows.select("id", "direction", decisions.target_of(F.col("direction")).alias("target"))


@query("""select id, field_name, case field_name when 'color' then 'hex' when 'weight' then 'weight' when 'location' then null else null end as left_key from conflict""", "conflict")
def mapped_fields(spark: SparkSession, d: str) -> DataFrame:
    """The left key of each conflict's field: explicit maps first, then fields of equal name, none for an excluded or unknown one."""
    rows = view(spark, d, "conflict")
    return rows.select("id", "field_name", decisions.mapped_key(F.col("field_name"), {"color": "hex"}, ("location",)).alias("left_key"))


@query("""shown as (select id, vendor, name, row_number() over (order by lower(name) desc nulls last, id) as place from left_product) select id, place from shown where place <= 100""", "left_product")
def names_descending(spark: SparkSession, d: str) -> DataFrame:
    """The first page of products by name, descending, missing ones last."""
    return reports.page(reports.ordered(view(spark, d, "left_product"), "name", True), 100).select("id", "place")

