"""Relations that stand for catalogues, frames and rasters, derived from the tables at hand, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PAIRS = """with e as (select distinct cast(date_trunc('month', o_orderdate) as date) d from orders),
 n as (select d, cast(row_number() over (order by d) as bigint) i from e)
 select a.d younger, b.d older, a.i iy, b.i io from n a join n b on a.i - b.i between 1 and 3"""
_EPOCH_PX = """select epoch, gy, gx, q from (select cast(date_trunc('month', l_shipdate) as date) epoch, l_orderkey % 16 gy, l_partkey % 16 gx,
 cast(sum(l_quantity) as double) q from lineitem group by 1, 2, 3)"""
_IFG_PX = """select p.younger, p.older, y.gy, y.gx, y.q - o.q + ((p.iy * 7 + p.io * 13 + y.gx * 3 + y.gy) % 5) phase
 from fx_pairs p join fx_epoch_px y on y.epoch = p.younger join fx_epoch_px o on o.epoch = p.older and o.gy = y.gy and o.gx = y.gx"""
_FRAMES = """select event_id frame_pk, date_trunc('second', ts) acq, user_id % 4 path, event_id orbit, user_id % 40 frame,
 case when event_type = 'error' then 'EW' else 'IW' end beam,
 case event_type when 'signup' then 'RAW' when 'click' then 'GRD' else 'SLC' end level,
 value / 10 center_lat, value / 10 - 0.75 min_lat, value / 10 + 0.75 max_lat, event_id % 50 orbit_group from events"""

SPARK = {
    "fx_pairs": _PAIRS,
    "fx_epoch_px": _EPOCH_PX,
    "fx_ifg_px": _IFG_PX,
    "fx_frames": _FRAMES,
    "fx_tile_px": """with u as (select vec_id, label, t.k, t.v from embeddings lateral view posexplode(embedding) t as k, v)
 select vec_id div 5 pair_id, vec_id % 5 frame_ord, (vec_id % 5) * 6 + k div 8 gy, cast(k % 8 as bigint) gx,
 case when abs(v) < 0.01 then null else round(cast(v as double), 4) end v, cast((label + (k div 32) * 3) % 4 as bigint) comp from u""",
    "fx_products": """select o_orderkey product_id, concat('S1-GUNW-D-R-071-tops-', date_format(o_orderdate + interval 12 day, 'yyyyMMdd'), '_', date_format(o_orderdate + interval 0 day, 'yyyyMMdd'), '-',
 lpad(cast(o_custkey % 24 as varchar(4)), 2, '0'), '3000-', '00119W_', lpad(cast(o_custkey % 60 as varchar(4)), 5, '0'),
 case when o_custkey % 3 = 0 then 'S' else 'N' end, '-PP-', lpad(cast(o_orderkey % 10000 as varchar(5)), 4, '0'),
 case when o_orderpriority like '1%' then '-v3_0_1.nc' else '-v2_0_5.nc' end) file_name from orders""",
}
DUCKDB = SPARK | {
    "fx_tile_px": """with u as (select vec_id, label, unnest(embedding) v, generate_subscripts(embedding, 1) - 1 k from embeddings)
 select vec_id // 5 pair_id, vec_id % 5 frame_ord, (vec_id % 5) * 6 + k // 8 gy, k % 8 gx,
 case when abs(v) < 0.01 then null else round(cast(v as double), 4) end v, cast((label + (k // 32) * 3) % 4 as bigint) comp from u""",
    "fx_products": """select o_orderkey product_id, concat('S1-GUNW-D-R-071-tops-', strftime(o_orderdate + interval 12 day, '%Y%m%d'), '_', strftime(o_orderdate + interval 0 day, '%Y%m%d'), '-',
 lpad(cast(o_custkey % 24 as varchar(4)), 2, '0'), '3000-', '00119W_', lpad(cast(o_custkey % 60 as varchar(4)), 5, '0'),
 case when o_custkey % 3 = 0 then 'S' else 'N' end, '-PP-', lpad(cast(o_orderkey % 10000 as varchar(5)), 4, '0'),
 case when o_orderpriority like '1%' then '-v3_0_1.nc' else '-v2_0_5.nc' end) file_name from orders""",
}
_NEEDS = {"fx_ifg_px": ["fx_pairs", "fx_epoch_px"]}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation over the tables of a folder."""
    parts = {}
    for table in ("orders", "lineitem", "events", "embeddings"):
        if table in SPARK[name] or any(table in SPARK[n] for n in _NEEDS.get(name, [])):
            parts[table] = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    text = SPARK[name]
    for table in parts:
        text = text.replace(f"from {table}", f"from {{{table}}}")
    inner = {n: relation(spark, sf_dir, n) for n in _NEEDS.get(name, [])}
    for n in inner:
        text = text.replace(f"from {n} ", f"from {{{n}}} ").replace(f"join {n} ", f"join {{{n}}} ")
    return spark.sql(text, **{k: v for k, v in (parts | inner).items() if f"{{{k}}}" in text})


def duckdb(*names: str) -> str:
    """The opening of a DuckDB query that names derived relations."""
    needed = dict.fromkeys(n for name in names for n in (*_NEEDS.get(name, []), name))
    return "with " + ",\n".join(f"{n} as ({DUCKDB[n]})" for n in needed)
