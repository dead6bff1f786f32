"""Two catalogs, a snapshot and a log over the test tables, by the same SQL in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: View -> (tables that it reads, SQL).
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "left_product": (("part",), "select p_partkey as id, p_brand as vendor, p_name as name, p_type as material, p_retailprice as price, case p_size % 4 when 0 then 'FF0000' when 1 then '00FF00' when 2 then '0000FF' else null end as color_hex, case when p_partkey % 5 = 0 then null else 150.0 + p_size end as spool_weight from part"),
    "right_product": (("part",), "select concat('R', cast(p_partkey as varchar(20))) as id, upper(p_brand) as vendor, concat('  ', upper(p_name)) as name, p_type as type, case p_size % 4 when 0 then '#ff0000' when 1 then '#00ff00' when 2 then '#0000ff' else null end as color, case when p_partkey % 4 = 0 then null else 150.0 + p_size end as tare, case when p_partkey % 3 = 0 then null else concat('R', cast(p_partkey - p_partkey % 3 as varchar(20))) end as parent_id from part where p_partkey % 10 <> 7"),
    "left_item": (("part", "orders"), "select o_orderkey as id, o_orderkey % (select count(*) from part) as product_id, round(o_totalprice - floor(o_totalprice / 1000) * 1000, 2) as remaining_weight, o_orderstatus = 'F' as archived, o_orderpriority as location, o_orderdate as registered from orders"),
    "right_item": (("part", "orders"), "select concat('S', cast(o_orderkey as varchar(20))) as id, concat('R', cast(o_orderkey % (select count(*) from part) as varchar(20))) as product_id, round(o_totalprice - floor(o_totalprice / 1000) * 1000 + 200 + case when o_orderkey % 7 = 0 then 5 else 0 end, 2) as total_weight, o_orderkey % 11 = 0 as retired from orders where o_orderkey % 13 <> 0"),
    "snapshot_left": (("orders",), "select o_orderkey as entity_id, round(o_totalprice - floor(o_totalprice / 1000) * 1000 + case when o_orderkey % 5 = 0 then 3 when o_orderkey % 6 = 0 then 1 else 0 end, 2) as remaining_weight from orders where o_orderkey % 17 <> 0"),
    "snapshot_right": (("orders",), "select concat('S', cast(o_orderkey as varchar(20))) as entity_id, round(o_totalprice - floor(o_totalprice / 1000) * 1000 + 200, 2) as total_weight from orders where o_orderkey % 13 <> 0 and o_orderkey % 19 <> 0"),
    "product_mapping": (("part",), "select p_partkey as id, p_partkey as left_id, concat('R', cast(p_partkey as varchar(20))) as right_id from part where p_partkey % 4 <> 3"),
    "item_mapping": (("orders",), "select o_orderkey as id, o_orderkey as left_item_id, concat('S', cast(o_orderkey as varchar(20))) as right_item_id from orders where o_orderkey % 3 <> 2"),
    "sync_log": (("events",), "select event_id as id, cast(date_trunc('hour', ts) as varchar(40)) as cycle_id, ts as logged_at, event_type as action, case when user_id % 2 = 0 then 'item' else 'product' end as entity_type, user_id as left_id, value, props from events"),
    "conflict": (("orders",), "select o_orderkey as id, 'item' as entity_type, o_orderkey - o_orderkey % 2 as left_id, case (o_orderkey - o_orderkey % 2) % 8 when 0 then 'weight' when 2 then 'location' when 4 then 'lifecycle' else 'color' end as field_name, case (o_orderkey - o_orderkey % 2) % 10 when 0 then 'new_record' when 2 then 'deletion' else 'field' end as conflict_type, o_orderdate as detected_at, case when o_orderkey % 7 = 0 then o_orderdate else null end as resolved_at from orders where o_orderkey % 6 < 4"),
}

#: Several colors of either side's products: a list with a direction, and further colors with tags.
VIEWS["left_palette"] = (("part",), """select p_partkey as id, case when p_partkey % 6 = 0 then '112233,445566' when p_partkey % 10 = 3 then 'AA0000,00BB00,0000CC' else null end as multi,
  case when p_partkey % 12 = 0 then 'coaxial' when p_partkey % 4 = 2 then 'longitudinal' else null end as direction from part""")
VIEWS["right_palette"] = (("part",), """select concat('R', cast(p_partkey as varchar(20))) as id, case when p_partkey % 6 = 0 then '#445566' when p_partkey % 10 = 3 then '00BB00,0000CC' else '' end as secondary_csv,
  case when p_partkey % 12 = 0 then '29,16' when p_partkey % 6 = 0 then '28' else '' end as tags_csv from part""")

#: Pairs of products for the field passes: a base value of each field, what either side had at the last sync, and what
#: it has now.  One in 11 left and one in 13 right values moved, one in 17 moved to the same value on both sides.
NUMBERS = {
    "cost": "p_retailprice",
    "bed_temp": "cast(50 + p_size as double)",
    "nozzle_temp": "cast(200 + p_size as double)",
    "density": "round(1 + p_size / 100, 3)",
    "diameter": "1.75e0",
    "spool_weight": "150.0e0 + p_size",
    "weight": "1000e0",
    "nozzle_temp_min": "190e0 + p_size",
    "nozzle_temp_max": "230e0 + p_size",
    "drying_temp": "50e0",
    "drying_time": "480e0",
    "hardness_shore_a": "90e0",
    "hardness_shore_d": "40.5e0",
    "transmission_distance": "1.5e0 + p_size / 10",
}
RIGHT_NAMES = {"spool_weight": "tare", "weight": "net_weight"}


def _moved(base: str, k: int, side: str, null: str) -> str:
    """SQL of a number now: moved by its side's turn, by both sides' turn, or null."""
    turn, step = ("11", "2") if side == "left" else ("13", "3")
    return f"case when (p_partkey + {k}) % {null} = 0 then null when (p_partkey + {k}) % 17 = 0 then {base} + 5 when (p_partkey + {k}) % {turn} = 0 then {base} + {step} else {base} end"


def _pair_sql(now: bool) -> str:
    columns = ["p_partkey as pair"]
    for k, (name, base) in enumerate(NUMBERS.items()):
        for side in ("left", "right"):
            value = _moved(base, k, side, "37" if side == "left" else "41") if now else f"case when (p_partkey + {k}) % 29 = 0 then null else {base} end"
            columns.append(f"{value} as {side}_{RIGHT_NAMES.get(name, name) if side == 'right' else name}")
    for side, name, turn in (("left", "material", 11), ("right", "type", 13)):
        columns.append(f"case when {str(now).lower()} and p_partkey % {turn} = 1 then concat(' ', p_type, ' {side} ') else p_type end as {side}_{name}")
    for side, name, turn in (("left", "lot", 11), ("right", "lot", 13)):
        columns.append(f"case when {str(now).lower()} and p_partkey % {turn} = 2 then '{side}' when p_partkey % 5 = 0 then null else 'lot' end as {side}_{name}")
    hexes = "case p_size % 4 when 0 then 'FF0000' when 1 then '00FF00' when 2 then '0000FF' else null end"
    moved = lambda turn, k: f"{str(now).lower()} and p_partkey % {turn} = {k}"
    columns += [
        f"case when {moved(11, 3)} then 'ABCDEF' else {hexes} end as left_color_hex",
        f"case when {moved(11, 4)} then 'aa0000,00bb00' when p_partkey % 6 = 0 then '112233,445566' else null end as left_multi",
        "case when p_partkey % 12 = 0 then 'coaxial' else 'longitudinal' end as left_direction",
        f"case when p_partkey % 12 = 0 then null when p_partkey % 6 = 0 then '#112233' when {moved(13, 3)} then '#00FFAA' else '#' || {hexes} end as right_color",
        "case when p_partkey % 12 = 0 then '#112233,#445566' when p_partkey % 6 = 0 then '#445566' else '' end as right_secondary_csv",
        f"case when {moved(13, 5)} then '28,17,900' when p_partkey % 12 = 0 then '29,16' when p_partkey % 6 = 0 then '28' else '900' end as right_tags_csv",
        "p_name as left_name", f"case when {moved(11, 6)} then '[17, 16]' when p_partkey % 4 = 0 then '16' else null end as left_tags",
        "case when p_partkey % 3 = 0 then 'density,spool_weight,lot' when p_partkey % 3 = 1 then 'material,net_weight' else '' end as right_inherited_csv",
    ]
    return f"select {', '.join(columns)} from part{'' if now else ' where p_partkey % 23 <> 0'}"


VIEWS["pair_now"] = (("part",), _pair_sql(True))
VIEWS["pair_then"] = (("part",), _pair_sql(False))
VIEWS["item_times"] = (("orders",), "select o_orderkey as left_item_id, case when o_orderkey % 3 = 0 then '' when o_orderkey % 4 = 0 then 'soon' else concat(substr(cast(o_orderdate as varchar(40)), 1, 10), 'T10:00:00Z') end as last_used, concat(substr(cast(o_orderdate as varchar(40)), 1, 10), ' 08:30:00') as registered, case when o_orderkey % 5 = 0 then null when o_orderkey % 2 = 0 then concat(substr(cast(o_orderdate as varchar(40)), 1, 10), 'T09:00:00Z') else concat(substr(cast(o_orderdate as varchar(40)), 1, 10), 'T10:00:00+00:00') end as updated, case when o_orderkey % 7 = 0 then null else cast(o_orderdate as timestamp) + interval '9' hour end as captured_left, case when o_orderkey % 8 = 0 then null when o_orderkey % 6 = 1 then cast(o_orderdate as timestamp) + interval '7' hour else cast(o_orderdate as timestamp) + interval '12' hour end as captured_right from orders")


def from_sql(spark: SparkSession, sf_dir: str, tables: tuple[str, ...], sql: str) -> DataFrame:
    """SQL over some of the tables as a DataFrame."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for t in tables:  # spark.sql fills {name} with a DataFrame
        sql = sql.replace(f"from {t}", f"from {{{t}}}")
    return spark.sql(sql, **frames)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views as a DataFrame."""
    return from_sql(spark, sf_dir, *VIEWS[name])


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL that has the views in front; ``sql`` goes on with further ``name as (...)`` or a select."""
    heads = ", ".join(f"{n} as ({VIEWS[n][1]})" for n in names)
    return f"with {heads}{'' if sql.lstrip().lower().startswith('select') else ', '} {sql}"
