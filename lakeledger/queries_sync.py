"""Queries of the synchronisation passes, each over all pairs, and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import values
from .operators import changes, conflicts, passes, records
from .options import FINISH_TAGS
from .plans import appliers, decisions, reports
from .queries import OPTIONS, query
from .sources.views import view

AMOUNT, TEMPERATURE, TEXT = "cast(round({}, 2) as varchar)", "cast(cast(round_even({}, 0) as int) as varchar)", "nullif(trim({}), '')"


def _numbers(names: tuple[str, ...], form: str, right: dict[str, str] | None = None) -> list[tuple[str, str, str]]:
    return [(n, form.format(f"left_{n}"), form.format(f"right_{(right or {}).get(n, n)}")) for n in names]


def pass_sql(fields: list[tuple[str, str, str]], either: bool = False, inherits: bool = False, required: tuple[str, ...] = (), where: str = "true", policy: str = "conflict") -> str:
    """Rows of a pass: fields as (name, left, right) expressions over the pair views."""
    inside = "string_split(right_inherited_csv, ',')"
    one = lambda v: " union all ".join(f"select pair, '{n}' as field, {a} as l, {b} as r, list_contains({inside}, '{n}') as inherited from {v} where {where.replace('FIELD', n)}" for n, a, b in fields)
    first = "(t.l is null or t.r is null)" if either else "(t.l is null and t.r is null)"
    plain = f"""case when t.pair is null or {first} then 'baseline'
      when n.l is distinct from t.l and n.r is distinct from t.r then case when n.l is not distinct from n.r then 'converge' else '{policy}' end
      when n.l is distinct from t.l then 'push_right' when n.r is distinct from t.r then 'push_left' else 'noop' end"""
    gated = f"case when n.inherited and n.l is not distinct from n.r then 'skip' when n.inherited and ({plain}) = 'push_right' then 'master_divergence' else {plain} end" if inherits else plain
    needed = ", ".join(f"'{x}'" for x in required) or "''"
    return f"""now_ as ({one("pair_now")}), then_ as ({one("pair_then")}),
acted as (select n.pair, n.field, t.l as left_then, n.l as "left", t.r as right_then, n.r as "right", {gated} as action from now_ n left join then_ t on t.pair = n.pair and t.field = n.field)
select pair, field, left_then, "left", right_then, "right", case when field in ({needed}) and action = 'push_left' and "right" is null then 'skip' else action end as action from acted"""


def _pairs(spark: SparkSession, d: str, name: str) -> DataFrame:
    rows = view(spark, d, name)
    rows = rows.withColumns({"right_inherited": F.split("right_inherited_csv", ","), "right_secondary": F.filter(F.split("right_secondary_csv", ","), lambda h: h != ""), "right_tags": F.split("right_tags_csv", ",").cast("array<int>")})
    return passes.with_finish_tags(passes.with_signatures(rows), FINISH_TAGS)


def _run(spark: SparkSession, d: str, which: passes.Pass) -> DataFrame:
    return passes.run(which, _pairs(spark, d, "pair_now"), _pairs(spark, d, "pair_then"), OPTIONS)


@query(pass_sql(_numbers(("cost",), AMOUNT)), "pair_now", "pair_then")
def pass_cost(spark: SparkSession, d: str) -> DataFrame:
    """The cost pass."""
    return _run(spark, d, passes.COST)


@query(pass_sql(_numbers(("bed_temp", "nozzle_temp"), TEMPERATURE)), "pair_now", "pair_then")
def pass_temperatures(spark: SparkSession, d: str) -> DataFrame:
    """C11: bed and nozzle temperature as whole numbers."""
    return _run(spark, d, passes.TEMPERATURE)


@query(pass_sql([("material", TEXT.format("left_material"), TEXT.format("right_type")), *_numbers(("density", "diameter"), AMOUNT), *_numbers(("spool_weight",), AMOUNT, {"spool_weight": "tare"}), ("net_weight", AMOUNT.format("left_weight"), AMOUNT.format("right_net_weight"))], inherits=True, required=("density", "diameter")), "pair_now", "pair_then")
def pass_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Five scalars with the inheritance gate; required ones are not emptied."""
    return _run(spark, d, passes.SCALAR)


@query(pass_sql([*_numbers(passes.OPTION_INTEGERS, TEMPERATURE), *_numbers(passes.OPTION_FLOATS, AMOUNT)]), "pair_now", "pair_then")
def pass_option_fields(spark: SparkSession, d: str) -> DataFrame:
    """Option fields with a place on both sides."""
    return _run(spark, d, passes.OPTIONS_PASS)


LEFT_SIGNATURE = """case when len(string_split(coalesce(left_multi, ''), ',')) <= 1 then concat_ws('|', '', coalesce(upper(left_color_hex), ''), '')
  when left_direction = 'coaxial' then concat_ws('|', 'coextruded', '', upper(left_multi))
  else concat_ws('|', 'gradient', upper(string_split(left_multi, ',')[1]), upper(array_to_string(string_split(left_multi, ',')[2:], ','))) end"""
RIGHT_SIGNATURE = """concat_ws('|', case when list_contains(string_split(right_tags_csv, ','), '29') then 'coextruded' when list_contains(string_split(right_tags_csv, ','), '28') then 'gradient' else '' end,
  coalesce(upper(replace(right_color, '#', '')), ''), upper(replace(right_secondary_csv, '#', '')))"""


@query(pass_sql([("multicolor", LEFT_SIGNATURE, RIGHT_SIGNATURE)], either=True), "pair_now", "pair_then")
def pass_multicolor(spark: SparkSession, d: str) -> DataFrame:
    """The color pass on signatures; a null on either side of the snapshot is a first sight."""
    return _run(spark, d, passes.SIGNATURE)


TOLD = "list_distinct(list_filter([" + ", ".join(f"case when regexp_matches(lower(concat(coalesce(left_name, ''), ' ', coalesce(left_material, ''))), '\\b{w}\\b') then {i} end" for w, i in FINISH_TAGS.items()) + "], lambda x: x is not null))"
MANAGED = "[" + ", ".join(str(i) for i in sorted(set(FINISH_TAGS.values()))) + "]"
NUMBERS_OF = "list_transform(string_split(regexp_replace({}, '[\\[\\]\\s]', '', 'g'), ','), lambda x: try_cast(x as int))"
LEFT_TAGS = f"nullif(array_to_string(list_sort(case when left_tags is not null then list_intersect({NUMBERS_OF.format('left_tags')}, {MANAGED}) else {TOLD} end), ','), '')"
RIGHT_TAGS = f"nullif(array_to_string(list_sort(list_intersect({NUMBERS_OF.format('right_tags_csv')}, {MANAGED})), ','), '')"


@query(pass_sql([("finish_tags", LEFT_TAGS, RIGHT_TAGS)], either=True), "pair_now", "pair_then")
def pass_finish_tags(spark: SparkSession, d: str) -> DataFrame:
    """Finish tags; the left list wins over what its text tells."""
    return _run(spark, d, passes.FINISH)


@query(pass_sql([("lot", TEXT.format("left_lot"), TEXT.format("right_lot")), ("color_hex", TEXT.format("left_color_hex"), TEXT.format("right_color"))], inherits=True, where="not ('FIELD' = 'color_hex' and left_multi is not null)"), "pair_now", "pair_then")
def pass_field_map(spark: SparkSession, d: str) -> DataFrame:
    """Mapped fields; color is left out where a product has several, inherited values are left alone."""
    now = _pairs(spark, d, "pair_now").withColumn("multicolor", F.col("left_multi").isNotNull())
    then = _pairs(spark, d, "pair_then").withColumn("multicolor", F.col("left_multi").isNotNull())
    return passes.run(passes.field_map_pass({"lot": "lot", "color_hex": "color"}), now, then, OPTIONS)


WEIGHT_PAIRS = """pairs as (
  select m.left_item_id, m.right_item_id, l.remaining_weight as left_now, r.total_weight as right_now, s.remaining_weight as left_then, t.total_weight as right_then
  from item_mapping m join left_item l on l.id = m.left_item_id join right_item r on r.id = m.right_item_id
  left join snapshot_left s on s.entity_id = m.left_item_id left join snapshot_right t on t.entity_id = m.right_item_id),
raw as (select left_item_id, try_cast(replace(coalesce(nullif(last_used, ''), registered), 'Z', '') as timestamp) as l, try_cast(replace(replace(updated, 'Z', ''), '+00:00', '') as timestamp) as r, least(captured_left, captured_right) as anchor from item_times),
times as (select left_item_id, case when anchor is null or l > anchor then l end as left_ts, case when anchor is null or r > anchor then r end as right_ts from raw),
flags as (select *, left_then is null or right_then is null as fresh, coalesce(abs(left_then - left_now) >= 2, false) as lc, coalesce(abs(right_then - right_now) >= 2, false) as rc from pairs left join times using (left_item_id))"""


@query(f"""{WEIGHT_PAIRS}
select left_item_id, right_item_id, left_ts, right_ts, case when fresh then 'baseline' when lc and rc then case when left_ts > right_ts then 'push_right' when left_ts < right_ts then 'push_left' else 'conflict' end
  when lc then 'push_right' when rc then 'push_left' else 'noop' end as action from flags""", "left_item", "right_item", "item_mapping", "snapshot_left", "snapshot_right", "item_times")
def weights_newest_wins(spark: SparkSession, d: str) -> DataFrame:
    """Newest-wins on weights, with times that count only after the last capture."""
    paired = changes.pairs(view(spark, d, "item_mapping"), view(spark, d, "left_item"), view(spark, d, "right_item"))
    timed = changes.with_times(paired, view(spark, d, "item_times"), "left_item_id")
    found = changes.weight_changes(timed, view(spark, d, "snapshot_left"), view(spark, d, "snapshot_right"), replace(OPTIONS, policy="newest_wins"))
    return found.join(timed.select("left_item_id", "left_ts", "right_ts"), "left_item_id").select("left_item_id", "right_item_id", "left_ts", "right_ts", "action")


@query("""rows_ as (
  select id, 'left' as side, cast(id as varchar) as record, product_id in (select left_id from product_mapping) as known, coalesce(remaining_weight, 0) <= 0 as empty, product_id % 9 = 0 as held from left_item where not archived and id not in (select left_item_id from item_mapping)
  union all select null, 'right', id, product_id in (select right_id from product_mapping), coalesce(total_weight, 0) <= 0, false from right_item where not retired and id not in (select right_item_id from item_mapping))
select side, record, case when held and not known then 'held' when known then 'create_item' else 'import_product' end as route, empty from rows_""", "left_item", "right_item", "product_mapping", "item_mapping")
def new_record_routes(spark: SparkSession, d: str) -> DataFrame:
    """Where unmapped live items of both sides go; a new product of a cluster is held while the way to form families is not set."""
    mapping, products = view(spark, d, "item_mapping"), view(spark, d, "product_mapping")
    left, right = view(spark, d, "left_item"), view(spark, d, "right_item")
    held = left.select("product_id").distinct().filter("product_id % 9 = 0")
    a = changes.new_item_routes(left.filter(~F.col("archived")).withColumn("weight", F.col("remaining_weight")), mapping.select(F.col("left_item_id").alias("id")), products.select(F.col("left_id").alias("product_id")), held)
    b = changes.new_item_routes(right.filter(~F.col("retired")).withColumn("weight", F.col("total_weight")), mapping.select(F.col("right_item_id").alias("id")), products.select(F.col("right_id").alias("product_id")), None)
    return a.withColumn("side", F.lit("left")).unionByName(b.withColumn("side", F.lit("right"))).select("side", "record", "route", "empty")


REPEATED = "repeated as (select * from conflict union all select id + 100000000, entity_type, left_id, field_name, conflict_type, detected_at, resolved_at from conflict where id % 3 = 1)"


@query(f"""{REPEATED}, open_ as (select * from repeated where resolved_at is null),
first_ as (select entity_type, left_id, field_name, conflict_type, min(id) as keep from open_ group by all)
select id, keep from open_ join first_ using (entity_type, left_id, field_name, conflict_type) where id > keep""", "conflict")
def repeated_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Open conflicts of one key but the oldest, over a queue that holds some twice."""
    queue = view(spark, d, "conflict")
    return conflicts.prune_duplicates(queue.unionByName(queue.filter("id % 3 = 1").withColumn("id", F.col("id") + 100_000_000)))


@query("""gone as (select left_id from product_mapping where left_id % 6 = 0),
snap as (select 'snapshot' as kind, entity_id as id from snapshot_left where entity_id not in (select left_id from gone)),
map_ as (select 'mapping' as kind, left_id as id from product_mapping where left_id not in (select left_id from gone)),
asked as (select case when left_id in (select left_id from gone) and resolved_at is null then 'settled' else 'conflict' end as kind, id from conflict)
select * from snap union all select * from map_ union all select * from asked""", "product_mapping", "snapshot_left", "conflict")
def purge_cascade(spark: SparkSession, d: str) -> DataFrame:
    """What is left of mapping, snapshots and conflicts when products are gone; their open conflicts are settled."""
    mapping, snapshots, queue = view(spark, d, "product_mapping"), view(spark, d, "snapshot_left"), view(spark, d, "conflict")
    gone = mapping.filter("left_id % 6 = 0").select("left_id")  # the products that were deleted
    snap, kept = decisions.purge(gone, (snapshots, "entity_id"), (mapping, "left_id"))
    parts = [snap.select(F.lit("snapshot").alias("kind"), F.col("entity_id").alias("id")), kept.select(F.lit("mapping").alias("kind"), F.col("left_id").alias("id")), decisions.settled_with(queue, gone).select(F.when(F.col("settled"), "settled").otherwise("conflict").alias("kind"), "id")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


BLOBS = "blobs as (select left_id, right_id, case when left_id % 5 = 0 then null when left_id % 7 = 0 then 'plain text' else concat('{\"vendor\":\"v\",\"name\":\"n', cast(left_id as varchar), '\"}') end as identity from product_mapping)"


@query(f"""{BLOBS}
select b.left_id, case when identity is not null then identity when l.id is not null then l.name else r.name end as label_source,
  case when identity is null then 'backfilled' when identity = 'plain text' then 'legacy' else 'kept' end as state
from blobs b left join (select * from left_product where id % 10 <> 0) l on l.id = b.left_id left join right_product r on r.id = b.right_id""", "product_mapping", "left_product", "right_product")
def identity_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Mappings without an identity get that of the left product, else of the right one."""
    mapping = view(spark, d, "product_mapping")
    blob = F.when(F.col("left_id") % 5 == 0, None).when(F.col("left_id") % 7 == 0, "plain text").otherwise(F.concat(F.lit('{"vendor":"v","name":"n'), F.col("left_id").cast("string"), F.lit('"}')))
    left = view(spark, d, "left_product").filter("id % 10 <> 0")  # some left products are not there any more
    found = records.identity_backfill(mapping.withColumn("identity", blob), left, view(spark, d, "right_product"))
    name = F.from_json("identity", "name string").getField("name")
    state = F.when(F.col("was").isNull(), "backfilled").when(records.identity_of(F.col("was")).isNull(), "legacy").otherwise("kept")
    return found.select("left_id", F.when(F.col("was").isNull(), name).otherwise(F.col("was")).alias("label_source"), state.alias("state"))


@query("""refs as (select left_id, right_id, case when left_id % 4 = 0 then null else right_id end as xref from product_mapping)
select left_id, xref as cleared_right_id, left_id % 2 = 0 and xref is not null as cleared, case when left_id % 2 = 0 then null else xref end as xref_after from refs""", "product_mapping")
def identity_cleared(spark: SparkSession, d: str) -> DataFrame:
    """H15, D27, IO11, IO12: the identity is taken from both sides; the right id comes from the left one's cross reference."""
    extra = F.when(F.col("left_id") % 4 == 0, F.create_map(F.lit("note"), F.lit('"x"'))).otherwise(F.create_map(F.lit("note"), F.lit('"x"'), F.lit("right_id"), values.encode(F.col("right_id"))))
    rows = view(spark, d, "product_mapping").select("left_id", extra.alias("extra"))
    return records.identity_cleared(rows, rows.filter("left_id % 2 = 0").select("left_id")).select("left_id", "cleared_right_id", "cleared", records.extra_value(F.col("extra"), "right_id").alias("xref_after"))


@query("""select id, entity_type, left_id, detected_at from conflict where resolved_at is null order by detected_at desc, id desc limit 100""", "conflict")
def newest_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """The newest open conflicts, by detection and id (a page of 100)."""
    return reports.newest_conflicts(view(spark, d, "conflict"), 100).select("id", "entity_type", "left_id", "detected_at")


@query("""select cycle_id, count(*) as n, min(id) as first_id, max(id) as last_id, array_to_string(list_sort(list_distinct(list(action))), ',') as actions from sync_log group by 1""", "sync_log")
def log_by_cycle(spark: SparkSession, d: str) -> DataFrame:
    """Log rows by cycle, with the first of each for the order in which cycles were seen."""
    return reports.by_cycle(view(spark, d, "sync_log"))


#: One conflict of each pair: the field by its number, the decision by another.
KINDS = ("cost", "bed_temp", "material", "spool_weight", "drying_time", "lot", "color", "multicolor", "finish_tags", "weight", "location", "lifecycle", "nobody_knows")
_VALUES = {
    "cost": ("left_cost", "right_cost"), "bed_temp": ("left_bed_temp", "right_bed_temp"), "material": ("left_material", "right_type"), "spool_weight": ("left_spool_weight", "right_tare"),
    "drying_time": ("left_drying_time", "right_drying_time"), "lot": ("left_lot", "right_lot"), "color": ("left_color_hex", "right_color"), "weight": ("left_weight", "right_net_weight"),
    "location": ("case when pair % 2 = 0 then ' ' else concat(' shelf ', cast(pair % 7 as varchar(9))) end", "'rack'"), "lifecycle": ("case when pair % 3 = 0 then 'true' else 'false' end", "'true'"),
}
_OF = "case pair % 13 " + " ".join(f"when {k} then cast({{}} as varchar(200))" for k, n in enumerate(KINDS) if n in _VALUES) + " end"
DECISIONS = f"""select *, case pair % 13 {" ".join(f"when {k} then '{n}'" for k, n in enumerate(KINDS))} end as field_name,
  case pair % 5 when 0 then 'left' when 1 then 'right' when 2 then 'manual' when 3 then 'left' else 'later' end as resolution,
  {_OF.format(*(_VALUES[n][0] for n in KINDS if n in _VALUES))} as left_value, {_OF.format(*(_VALUES[n][1] for n in KINDS if n in _VALUES))} as right_value,
  case when pair % 13 in (2, 5, 10) then 'by hand' when pair % 13 = 9 and pair % 2 = 0 then 'much' else '77.5' end as manual from {{}}"""
_HEX = "nullif(ltrim(trim({}), '#'), '')"
_NUMBERS_OF = "list_transform(string_split({}, ','), lambda x: cast(x as int))"
_UNMANAGED = f"list_filter({_NUMBERS_OF.format('right_tags_csv')}, lambda t: not list_contains({MANAGED}, t))"
_PLAIN_TAGS = f"list_filter({_NUMBERS_OF.format('right_tags_csv')}, lambda t: t not in (28, 29))"
_SOLID, _COAXIAL = "len(string_split(coalesce(left_multi, ''), ',')) <= 1", "left_direction = 'coaxial'"
_SECONDARY = "list_filter(string_split(right_secondary_csv, ','), lambda h: h <> '')"
_EVERY = f"list_filter(list_concat([{_HEX.format('right_color')}], list_transform({_SECONDARY}, lambda h: {_HEX.format('h')})), lambda h: h is not null)"


def _quoted(word: str) -> str:
    return f"'{word}'"


def _sql_steps(write_right: tuple[str, str], write_left: tuple[str, str], key: str, left: str, right: str | None = None) -> str:
    """A list of steps as DuckDB structs."""
    one = lambda kind, side, path, value: f"{{'kind': '{kind}', 'side': {side}, 'path': {path}, 'value': cast({value} as varchar)}}"
    return f"[{one('write', _quoted('right'), *write_right)}, {one('write', _quoted('left'), *write_left)}, {one('snapshot', _quoted('left'), key, left)}, {one('snapshot', _quoted('right'), key, right or left)}, {one('record', 'null', _quoted('value'), left)}]"


def _one(kind: str, side: str, path: str, value: str) -> str:
    return f"{{'kind': '{kind}', 'side': {side}, 'path': '{path}', 'value': cast({value} as varchar)}}"


def _kept(key: str, value: str) -> str:
    return ", ".join((_one("snapshot", "'left'", key, value), _one("snapshot", "'right'", key, value), _one("record", "null", "value", value)))


_FIXED = {"cost": ("price", "cost"), "bed_temp": ("bed_temp", "temperatures.bed"), "material": ("material", "type"), "spool_weight": ("spool_weight", "tare"), "drying_time": ("extra.drying_time", "drying_time")}
_KEYS = {"cost": "_cost"}
_GONE = "coalesce(try_cast(value as boolean), false)"
_IDS = f"coalesce(case when resolution = 'left' then {LEFT_TAGS} else {RIGHT_TAGS} end, '')"
APPLIED = f"""decided as ({DECISIONS.format("pair_now")}),
chosen as (select *, case resolution when 'left' then left_value when 'right' then right_value else manual end as value, coalesce(right_tare, 200.0) as t from decided),
weighed as (select *, round(try_cast(value as double) - case when resolution = 'right' and field_name = 'weight' then t else 0 end, 2) as net from chosen),
grossed as (select *, round(net + t, 2) as gross, case when field_name = 'weight' then try_cast(right_value as double) end as now_ from weighed),
stepped as (select pair as id, case
  when resolution = 'later' then [{_one("error", "null", "", "'unknown resolution'")}]
  when resolution = 'manual' and field_name in ('multicolor', 'finish_tags') then [{_one("error", "null", "", "'not by hand'")}]
  when field_name = 'nobody_knows' then [{_one("error", "null", "", "'no applier for this field'")}]
  {" ".join(f"when field_name = '{n}' then {_sql_steps((_quoted(r), 'value'), (_quoted(a), 'value'), _quoted(_KEYS.get(n, f'_mp_{n}')), 'value')}" for n, (a, r) in _FIXED.items())}
  when field_name = 'lot' then {_sql_steps(("'lot'", "value"), ("'extra.lot'", "value"), "'lot'", "value")}
  when field_name = 'color' then {_sql_steps(("'color'", "'#' || " + _HEX.format("value")), ("'extra.hex'", _HEX.format("value")), "'color'", _HEX.format("value"), "'#' || " + _HEX.format("value"))}
  when field_name = 'weight' and net is null then [{_one("error", "null", "", "'not a number'")}]
  when field_name = 'weight' then {_sql_steps(("case when gross < now_ then 'usage' else 'total_weight' end", "case when gross < now_ then round(now_ - gross, 2) else gross end"), ("'remaining_weight'", "net"), "'weight'", "net", "gross")}
  when field_name = 'location' then {_sql_steps(("'location_name'", "nullif(trim(value), '')"), ("'location'", "nullif(trim(value), '')"), "'location'", "nullif(trim(value), '')")}
  when field_name = 'lifecycle' then [{_one("write", "'right'", "retired", _GONE)}, {_one("write", "'left'", "archived", _GONE)}, {_one("snapshot", "'left'", "archived", _GONE)}, {_one("snapshot", "'right'", "retired", _GONE)}, {_one("record", "null", "value", _GONE)}]
  when field_name = 'multicolor' and resolution = 'left' then [
    {_one("write", "'right'", "color", f"case when {_SOLID} then '#' || left_color_hex when {_COAXIAL} then null else '#' || string_split(left_multi, ',')[1] end")},
    {_one("write", "'right'", "secondary", f"case when {_SOLID} then '' when {_COAXIAL} then '#' || replace(left_multi, ',', ',#') else '#' || array_to_string(string_split(left_multi, ',')[2:], ',#') end")},
    {_one("write", "'right'", "tags", f"array_to_string(case when {_SOLID} then {_PLAIN_TAGS} else list_append({_PLAIN_TAGS}, case when {_COAXIAL} then 29 else 28 end) end, ',')")},
    {_kept("_mc_sig", LEFT_SIGNATURE)}]
  when field_name = 'multicolor' then list_concat(list_filter([
    {_one("write", "'left'", "color_hex", f"case when len({_EVERY}) < 2 then {_EVERY}[1] end")}, {_one("write", "'left'", "multi", f"case when len({_EVERY}) >= 2 then array_to_string({_EVERY}, ',') end")},
    {_one("write", "'left'", "direction", f"case when len({_EVERY}) < 2 then null when list_contains(string_split(right_tags_csv, ','), '29') then 'coaxial' when list_contains(string_split(right_tags_csv, ','), '28') then 'longitudinal' end")}],
    lambda s: s.value is not null), [{_kept("_mc_sig", RIGHT_SIGNATURE)}])
  when field_name = 'finish_tags' then [
    {_one("write", "'right'", "tags", f"array_to_string(list_concat({_UNMANAGED}, case when {_IDS} = '' then [] else list_sort(list_transform(string_split({_IDS}, ','), lambda x: cast(x as int))) end), ',')")},
    {_one("write", "'left'", "extra.finish_tags", _IDS)}, {_kept("_finish_sig", _IDS)}]
  end as steps from grossed)
select id, generate_subscripts(steps, 1) - 1 as step, unnest(steps).kind as kind, unnest(steps).side as side, unnest(steps).path as path, unnest(steps).value as value from stepped"""


@query(APPLIED, "pair_now")
def applied_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """What resolving conflicts of every kind writes to both sides, to both snapshots and to the conflict."""
    pairs = _pairs(spark, d, "pair_now")
    decided = spark.sql(DECISIONS.format("{pairs}"), pairs=pairs)
    rows = decided.select(
        F.col("pair").alias("id"), "field_name", "resolution", "left_value", "right_value", "manual", F.col("right_tare").alias("tare"), F.col("left_color_hex").alias("color_hex"), F.col("left_multi").alias("multi"),
        F.col("left_direction").alias("direction"), "left_tags", F.col("left_name").alias("name"), F.col("left_material").alias("material"), F.col("right_color").alias("color"), F.col("right_secondary").alias("secondary"), F.col("right_tags").alias("tags"),
    )
    return appliers.applied(rows, {"lot": "lot", "color": "hex"}, FINISH_TAGS)
