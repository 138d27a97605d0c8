"""The engine's queries over the derived relations, each with the DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafringe.functions import scalars as S
from terrafringe.functions.geometry import ring_area_km2
from terrafringe.operators import catalog as C
from terrafringe.operators import metadata as M
from terrafringe.operators import network as N
from terrafringe.operators import raster as R
from terrafringe.operators import surface as U
from terrafringe.plans.fixtures import duckdb, relation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 9


def _query(sql: str | None, *relations: str):
    """Register a function of the named relations under its own name, with the rest of its DuckDB query."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(relation(spark, sf_dir, r) for r in relations))
        if sql:
            ORACLE_SQL[f.__name__] = duckdb(*relations) + "\n" + sql
        return f

    return add


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Columns to nine decimals, without negative zeros."""
    return df.withColumns({c: F.round(c, DIGITS) + F.lit(0.0) for c in columns})


_PARSED = """, parsed as (select *, split_part(file_name, '-', 7) pair_name, cast(substr(split_part(split_part(file_name, '-', 9), '_', 2), 1, 2) as int)
 * case when split_part(split_part(file_name, '-', 9), '_', 2) like '%S' then -1 else 1 end center_lat, split_part(file_name, '-', 8) mid_time,
 cast(replace(replace(regexp_extract(file_name, '(v\\d+_\\d+_\\d+.*)\\.', 1), 'v', ''), '_', '') as double) version_num,
 regexp_extract(file_name, '^(.*)-v\\d+_\\d+_\\d+.*$', 1) base_name from fx_products)"""


@_query(_PARSED + """ select product_id, pair_name, strptime(substr(pair_name, 1, 8), '%Y%m%d')::date sec_date, strptime(substr(pair_name, 10, 8), '%Y%m%d')::date ref_date,
 mid_time, center_lat, case split_part(file_name, '-', 3) when 'D' then 'DESCENDING' when 'A' then 'ASCENDING' else 'UNKNOWN' end direction, version_num from parsed""", "fx_products")
def product_catalog(products):
    return C.parse_products(products).select("product_id", "pair_name", "sec_date", "ref_date", "mid_time", "center_lat", "direction", "version_num")


@_query(" select product_id, file_name from fx_products where contains(file_name, '-v3_0_1')", "fx_products")
def version_filter(products):
    return C.of_version(products, "3_0_1")


@_query(_PARSED + " select product_id, version_num from (select *, row_number() over (partition by base_name order by version_num desc, product_id) r from parsed) where r = 1", "fx_products")
def latest_version(products):
    return C.latest_versions(C.parse_products(products)).select("product_id", "version_num")


@_query(_PARSED + " select product_id, pair_name, version_num from (select *, max(version_num) over (partition by pair_name, center_lat) top from parsed) where top < 300 or version_num >= 300", "fx_products")
def version_conflict(products):
    return C.without_old_versions(C.parse_products(products), ["pair_name", "center_lat"]).select("product_id", "pair_name", "version_num")


@_query(_PARSED + """ select pair_name, cast(island as bigint) island, count(*) n_frames, min(center_lat) south, max(center_lat) north from (
 select *, sum(f) over (partition by pair_name order by center_lat, mid_time, product_id rows unbounded preceding) island from (
 select *, case when abs(center_lat - lag(center_lat) over (partition by pair_name order by center_lat, mid_time, product_id)) <= 1 then 0 else 1 end f from parsed)) group by all""", "fx_products")
def frame_groups(products):
    return C.grouped_frames(C.parse_products(products)).groupBy("pair_name", "island").agg(F.count("*").alias("n_frames"), F.min("center_lat").alias("south"), F.max("center_lat").alias("north"))


@_query(_PARSED + " select product_id, pair_name, version_num from (select *, row_number() over (partition by pair_name, center_lat, mid_time order by version_num desc, product_id) r from parsed) where r = 1", "fx_products")
def adjacent_duplicates(products):
    return C.without_adjacent_duplicates(C.parse_products(products)).select("product_id", "pair_name", "version_num")


@_query(" select younger, older, iy, io from fx_pairs where older >= date '1995-01-01' and younger <= date '1997-12-31' and younger - older between 32 and 62", "fx_pairs")
def pair_dates(pairs):
    return C.within_dates(pairs, "1995-01-01", "1997-12-31", 32, 62)


@_query(" select least(younger, older) a, greatest(younger, older) b from fx_pairs where least(younger, older) = date '1996-01-01'", "fx_pairs")
def pair_match(pairs):
    return pairs.select(F.least("younger", "older").alias("a"), F.greatest("younger", "older").alias("b")).filter("a = date'1996-01-01'")


@_query(" select frame_pk, acq, path, level from fx_frames where beam = 'IW' and level in ('SLC', 'RAW') and max_lat >= 2 and min_lat <= 7", "fx_frames")
def frame_filter(frames):
    return C.selected_frames(frames, south=2.0, north=7.0).select("frame_pk", "acq", "path", "level")


@_query(" select frame_pk, concat(orbit, path, frame) frame_id, round(least(min_lat, max_lat), 9) low, round(greatest(min_lat, max_lat), 9) high from fx_frames", "fx_frames")
def frame_ids(frames):
    return _rounded(frames.select("frame_pk", F.concat(*[F.col(c).cast("string") for c in ("orbit", "path", "frame")]).alias("frame_id"), F.least("min_lat", "max_lat").alias("low"), F.greatest("min_lat", "max_lat").alias("high")), "low", "high")


@_query(" select frame_pk, path, frame from fx_frames r where level = 'RAW' and not exists (select 1 from fx_frames s where s.level = 'SLC' and s.path = r.path and s.orbit_group = r.orbit_group and abs(s.frame - r.frame) < 4)", "fx_frames")
def raw_without_slc(frames):
    return C.raw_without_slc(frames).select("frame_pk", "path", "frame")


@_query(" select frame_pk, path, min(acq) over (partition by path order by acq range between interval 86399 second preceding and unbounded following) common from fx_frames", "fx_frames")
def common_date(frames):
    return C.common_dates(frames, ["path"]).select("frame_pk", "path", "common")


@_query(""", g as (select *, case when max_lat < lead(min_lat) over (partition by path, day order by center_lat, frame_pk) then 1 else 0 end gap from (select *, cast(acq as date) as day from fx_frames))
 select path, day, count(*) n_frames, cast(sum(gap) as bigint) n_gaps, round(min(min_lat), 9) south, round(max(max_lat), 9) north from g group by all""", "fx_frames")
def pass_continuity(frames):
    return _rounded(C.continuity(frames.withColumn("day", F.col("acq").cast("date")), ["path", "day"]), "south", "north")


@_query(" select path, round(min(min_lat), 9) union_south, round(max(max_lat), 9) union_north, round(max(min_lat), 9) common_south, round(min(max_lat), 9) common_north from fx_frames group by path", "fx_frames")
def latitude_extents(frames):
    return _rounded(C.extents(frames, "path"), "union_south", "union_north", "common_south", "common_north")


@_query(" select p.younger, p.older from fx_pairs p where not exists (select 1 from fx_pairs x where x.younger = p.younger and x.older = p.older and x.iy % 7 = 0) and exists (select 1 from fx_epoch_px e where e.epoch = p.older)", "fx_pairs", "fx_epoch_px")
def pair_exclusion(pairs, pixels):
    excluded = pairs.filter("iy % 7 = 0").select("younger", "older")
    return pairs.join(excluded, ["younger", "older"], "left_anti").join(pixels.select(F.col("epoch").alias("older")).distinct(), "older", "left_semi").select("younger", "older")


@_query(""", d as (select distinct epoch from (select younger epoch from fx_pairs union all select older from fx_pairs))
 select epoch, epoch - min(epoch) over () as days, epoch - lag(epoch) over (order by epoch) as step from d""", "fx_pairs")
def epoch_list(pairs):
    return N.epochs(pairs)


_TRIPLETS = """, t as (select a.older d1, a.younger d2, b.younger d3 from fx_pairs a join fx_pairs b on b.older = a.younger join fx_pairs c on c.older = a.older and c.younger = b.younger)"""
_MISCLOSURE = _TRIPLETS + """, m as (select t.*, a.gy, a.gx, a.phase + b.phase - c.phase m from t join fx_ifg_px a on a.older = d1 and a.younger = d2
 join fx_ifg_px b on b.older = d2 and b.younger = d3 and b.gy = a.gy and b.gx = a.gx join fx_ifg_px c on c.older = d1 and c.younger = d3 and c.gy = a.gy and c.gx = a.gx)"""


@_query(_TRIPLETS + " select d1, d2, d3 from t where least(d2 - d1, d3 - d2, d3 - d1) >= 30 and greatest(d2 - d1, d3 - d2, d3 - d1) <= 92", "fx_pairs")
def triplet_network(pairs):
    return N.triplets(pairs, 30, 92)


@_query(_MISCLOSURE + " select gy, gx, sum(m) net, sum(abs(m)) absolute, count(*) n from m group by all", "fx_ifg_px")
def misclosure(phases):
    pairs = phases.select("younger", "older").distinct()
    return N.cumulative_misclosure(N.misclosure_pixels(phases, N.triplets(pairs)))


@_query(_MISCLOSURE.replace("from t join fx_ifg_px a", "from t join ref a").replace("join fx_ifg_px b", "join ref b").replace("join fx_ifg_px c", "join ref c").replace(", t as", ", ref as (select p.younger, p.older, p.gy, p.gx, p.phase - z.phase phase from fx_ifg_px p join fx_ifg_px z on z.younger = p.younger and z.older = p.older and z.gy = 3 and z.gx = 5), t as", 1) + " select gy, gx, sum(m) net, sum(abs(m)) absolute, count(*) n from m group by all", "fx_ifg_px")
def misclosure_referenced(phases):
    pairs = phases.select("younger", "older").distinct()
    return N.cumulative_misclosure(N.misclosure_pixels(N.referenced(phases, 3, 5), N.triplets(pairs)))


@_query(_MISCLOSURE + " select d1, d2, d3, m, sum(m) over w net, sum(abs(m)) over w absolute from m where gy = 4 and gx = 6 window w as (order by d1, d2, d3 rows unbounded preceding)", "fx_ifg_px")
def misclosure_at_pixel(phases):
    at = R.cropped(phases, 4, 4, 6, 6)
    return N.running_misclosure(N.misclosure_pixels(at, N.triplets(phases.select("younger", "older").distinct())), 4, 6)


@_query(" select gy, gx, avg_q from (select gy, gx, round(avg(q), 9) avg_q, row_number() over (order by avg(q) desc, gy, gx) r from fx_epoch_px group by gy, gx) where r = 1", "fx_epoch_px")
def reference_point(pixels):
    best = pixels.groupBy("gy", "gx").agg(F.avg("q").alias("avg_q")).orderBy(F.desc("avg_q"), "gy", "gx").limit(1)
    return _rounded(best, "avg_q")


_OVERLAP = """, o as (select a.pair_id, a.frame_ord, a.gy, a.gx, a.comp c1, b.comp c2, a.v - b.v d from fx_tile_px a join fx_tile_px b
 on b.pair_id = a.pair_id and b.frame_ord = a.frame_ord + 1 and b.gy = a.gy and b.gx = a.gx where a.v is not null and b.v is not null and a.comp <> 0 and b.comp <> 0)"""
_STITCH = _OVERLAP + """, s as (select pair_id, frame_ord + 1 frame_ord, median(d) step from o group by all),
 f as (select distinct pair_id, frame_ord from fx_tile_px),
 c as (select pair_id, frame_ord, sum(coalesce(step, 0)) over (partition by pair_id order by frame_ord rows unbounded preceding) shift from f left join s using (pair_id, frame_ord))"""


@_query(_OVERLAP + " select pair_id, frame_ord, c2, c1, count(*) n, round(median(d), 9) + 0.0 median_d, round(stddev_pop(d), 9) + 0.0 std_d, count(*) filter (d <> 0) n_nonzero from o group by all", "fx_tile_px")
def overlap_components(tiles):
    return _rounded(R.overlap_counts(R.overlap(tiles)), "median_d", "std_d")


@_query(_OVERLAP + " select pair_id, frame_ord, c2, c1, n from (select pair_id, frame_ord, c2, c1, count(*) n, row_number() over (partition by pair_id, frame_ord, c2 order by count(*) desc, c1) r from o group by pair_id, frame_ord, c2, c1) where r = 1", "fx_tile_px")
def best_component(tiles):
    return R.best_components(R.overlap_counts(R.overlap(tiles))).select("pair_id", "frame_ord", "c2", "c1", "n")


@_query(_OVERLAP + " select pair_id, round(atan2(avg(sin(d * 40)), avg(cos(d * 40))), 9) + 0.0 angle from o group by pair_id", "fx_tile_px")
def circular_offset(tiles):
    return _rounded(R.overlap(tiles).groupBy("pair_id").agg(R.circular_mean(F.col("d") * 40).alias("angle")), "angle")


@_query(_STITCH + " select pair_id, frame_ord, round(shift, 9) + 0.0 shift from c", "fx_tile_px")
def frame_offsets(tiles):
    return _rounded(R.chain_offsets(tiles), "shift")


@_query(_STITCH + " select pair_id, gy, gx, round(avg(v + shift), 9) + 0.0 v from fx_tile_px join c using (pair_id, frame_ord) where v is not null group by all", "fx_tile_px")
def stitched_phase(tiles):
    return _rounded(R.stitched(tiles), "v")


for _how, _fn in (("mean", "avg"), ("median", "median"), ("min", "min"), ("max", "max")):
    QUERIES[f"merge_{_how}"] = lambda spark, sf_dir, how=_how: _rounded(R.merged(relation(spark, sf_dir, "fx_tile_px"), ["pair_id"], how), "v")
    ORACLE_SQL[f"merge_{_how}"] = duckdb("fx_tile_px") + f" select pair_id, gy, gx, round({_fn}(v), 9) + 0.0 v from fx_tile_px where v is not null group by all"


@_query(" select pair_id, gy, gx, arg_max(v, frame_ord) v from fx_tile_px where v is not null group by all", "fx_tile_px")
def mosaic_last(tiles):
    return R.mosaic(tiles, ["pair_id"])


@_query(" select pair_id, frame_ord, gy, gx, case when comp > 0 and v <> 0 then v end v, case when comp > 0 then comp end comp from fx_tile_px", "fx_tile_px")
def component_mask(tiles):
    return R.component_masked(tiles).select("pair_id", "frame_ord", "gy", "gx", "v", "comp")


@_query(", k as (select gy, gx, case when avg(q) < 40 then 0.0 else 1.0 end mask from fx_epoch_px group by gy, gx) select younger, older, gy, gx, phase * mask v from fx_ifg_px left join k using (gy, gx)", "fx_ifg_px", "fx_epoch_px")
def masked_phase(phases, pixels):
    mask = pixels.groupBy("gy", "gx").agg(F.when(F.avg("q") < 40, 0.0).otherwise(1.0).alias("mask"))
    return R.masked(phases.withColumnRenamed("phase", "v"), mask).select("younger", "older", "gy", "gx", "v")


@_query(" select gy, gx, case when sum(q) / 80 < 38 then 0.0 else 1.0 end v from fx_epoch_px group by all", "fx_epoch_px")
def average_threshold(pixels):
    return R.average(pixels.withColumnRenamed("q", "v"), 80, 38.0)


@_query(" select pair_id, frame_ord, gy // 3 as block_y, gx // 3 as block_x, round(avg(v), 9) + 0.0 v, max(case when gy % 3 = 1 and gx % 3 = 1 then comp end) comp from fx_tile_px group by all", "fx_tile_px")
def multilook_average(tiles):
    return _rounded(R.multilook(tiles, 3, ["pair_id", "frame_ord"]), "v")


@_query(""", p as (select pair_id, frame_ord, gy // 2 as block_y, gx // 2 as block_x, comp, sum(v) s, count(*) n from fx_tile_px where v is not null group by all),
 q as (select *, row_number() over (partition by pair_id, frame_ord, block_y, block_x order by n desc, comp) r, sum(n) over (partition by pair_id, frame_ord, block_y, block_x) a from p) select pair_id, frame_ord, block_y, block_x, comp, round(s / a, 9) + 0.0 v from q where r = 1""", "fx_tile_px")
def multilook_ranked(tiles):
    return _rounded(R.multilook_ranked(tiles, 2, ["pair_id", "frame_ord"]), "v")


@_query(" select younger, older, gy, gx, phase from fx_ifg_px where gy between 2 and 9 and gx between 4 and 11", "fx_ifg_px")
def crop(phases):
    return R.cropped(phases, 2, 9, 4, 11)


@_query(" select path, round(floor(min(min_lat) / 0.4) * 0.4, 9) south, round(ceil(max(max_lat) / 0.4) * 0.4, 9) north from fx_frames group by path", "fx_frames")
def snapped_bounds(frames):
    low, high = R.snapped(F.min("min_lat"), F.max("max_lat"), 0.4)
    return _rounded(frames.groupBy("path").agg(low.alias("south"), high.alias("north")), "south", "north")


@_query(" select y.epoch younger, o.epoch older, y.gy, y.gx, y.q - o.q v from fx_pairs p join fx_epoch_px y on y.epoch = p.younger join fx_epoch_px o on o.epoch = p.older and o.gy = y.gy and o.gx = y.gx", "fx_epoch_px", "fx_pairs")
def epoch_differential(pixels, pairs):
    return R.differential(pixels, pairs)


@_query(" select f.younger, f.older, f.gy, f.gx, round(f.phase - 0.25 * (y.q - o.q), 9) + 0.0 phase from fx_ifg_px f join fx_epoch_px y on y.epoch = f.younger and y.gy = f.gy and y.gx = f.gx join fx_epoch_px o on o.epoch = f.older and o.gy = f.gy and o.gx = f.gx", "fx_ifg_px", "fx_epoch_px")
def delay_correction(phases, pixels):
    return _rounded(R.corrected(phases, pixels, phases.select("younger", "older").distinct(), 0.25), "phase")


@_query(" select gy, gx, epoch, round(q * 4 * pi() / 0.0556 / cos(radians(30 + gy)), 4) v from fx_epoch_px", "fx_epoch_px")
def metres_to_phase(pixels):
    return pixels.select("gy", "gx", "epoch", F.round(S.metres_to_radians(F.col("q"), F.lit(0.0556), 30 + F.col("gy")), 4).alias("v"))


@_query(""" select younger, older, gy, gx, round((phase - 2 * pi() * floor(phase / (2 * pi()))) - pi(), 9) + 0.0 w, round(phase - round_even(phase / (2 * pi()), 0) * 2 * pi(), 9) + 0.0 d,
 cast(case when phase < 0 then -1 else 1 end * floor((abs(phase) + pi()) / (2 * pi())) as bigint) cycles from fx_ifg_px""", "fx_ifg_px")
def phase_cycles(phases):
    p = F.col("phase")
    return _rounded(phases.select("younger", "older", "gy", "gx", S.wrapped(p).alias("w"), S.wrapped_difference(p).alias("d"), S.cycles(p).cast("long").alias("cycles")), "w", "d")


@_query(" select younger, older, count(phase) n, round(avg(phase), 9) + 0.0 mean, row_number() over (order by younger, older) band from fx_ifg_px group by younger, older", "fx_ifg_px")
def stack_bands(phases):
    bands = R.stacked(phases.select(F.struct("younger", "older").alias("pair"), F.col("phase").alias("v")), "pair")
    return _rounded(bands.select("pair.younger", "pair.older", "n", "mean", "band"), "mean")


@_query(", f as (select pair_id, frame_ord, avg(v) m from fx_tile_px group by all) select pair_id, round(avg(m), 9) + 0.0 mean from f group by pair_id", "fx_tile_px")
def baseline_mean(tiles):
    return _rounded(tiles.groupBy("pair_id", "frame_ord").agg(F.avg("v").alias("m")).groupBy("pair_id").agg(F.avg("m").alias("mean")), "mean")


@_query(", s as (select *, avg(case when v < 0 then 1 else 0 end) over (partition by pair_id, frame_ord) share from fx_tile_px where v is not null) select pair_id, frame_ord, gy, gx, case when share > 0.5 then -abs(v) else abs(v) end v from s", "fx_tile_px")
def sign_fix(tiles):
    return R.sign_fixed(tiles.filter("v is not null"), ["pair_id", "frame_ord"]).select("pair_id", "frame_ord", "gy", "gx", "v")


@_query(", b as (select min(q) lo, max(q) hi from fx_epoch_px) select cast(least(floor((q - lo) / (hi - lo) * 10), 9) as bigint) bin, count(*) n from fx_epoch_px, b group by 1", "fx_epoch_px")
def value_histogram(pixels):
    limits = pixels.agg(F.min("q").alias("lo"), F.max("q").alias("hi"))
    at = F.least(F.floor((F.col("q") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 10), F.lit(9)).cast("long")
    return pixels.crossJoin(F.broadcast(limits)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


@_query(" select pair_id, frame_ord, regr_count(v, gx) n, round(regr_r2(v, gx), 9) + 0.0 r2, round(regr_slope(v, gx), 9) + 0.0 slope, round(sqrt(greatest(0, (regr_syy(v, gx) - regr_sxy(v, gx) * regr_sxy(v, gx) / regr_sxx(v, gx)) / (regr_count(v, gx) - 2) / regr_sxx(v, gx))), 9) + 0.0 std_error from fx_tile_px group by all", "fx_tile_px")
def trend_quality(tiles):
    return _rounded(R.trend(tiles, ["pair_id", "frame_ord"], "gx", "v").withColumn("n", F.col("n").cast("long")), "r2", "slope", "std_error")


@_query(""", s as (select pair_id, frame_ord, count(*) n, avg(gx) mx, avg(gy) my, avg(v) mv, var_pop(gx) xx, var_pop(gy) yy, covar_pop(gx, gy) xy, covar_pop(gx, v) xv, covar_pop(gy, v) yv from fx_tile_px where v is not null group by all)
 select pair_id, frame_ord, n, round((xv * yy - yv * xy) / (xx * yy - xy * xy), 9) + 0.0 a, round((yv * xx - xv * xy) / (xx * yy - xy * xy), 9) + 0.0 b,
 round(mv - (xv * yy - yv * xy) / (xx * yy - xy * xy) * mx - (yv * xx - xv * xy) / (xx * yy - xy * xy) * my, 5) + 0.0 c from s""", "fx_tile_px")
def plane_fit(tiles):
    return _rounded(R.plane(tiles, ["pair_id", "frame_ord"]), "a", "b").withColumn("c", F.round("c", 5) + F.lit(0.0))


@_query(" select pair_id, round(quantile_cont(v, 0.02), 9) + 0.0 low, round(quantile_cont(v, 0.98), 9) + 0.0 high, round(median(v), 9) + 0.0 middle from fx_tile_px group by pair_id", "fx_tile_px")
def percentile_clip(tiles):
    p = tiles.groupBy("pair_id").agg(F.percentile("v", 0.02).alias("low"), F.percentile("v", 0.98).alias("high"), F.median("v").alias("middle"))
    return _rounded(p, "low", "high", "middle")


@_query(", e as (select pair_id, comp, count(*) n from fx_tile_px where gx in (0, 7) group by all) select pair_id, comp from (select *, row_number() over (partition by pair_id order by n desc, comp) r from e) where r = 1", "fx_tile_px")
def edge_mode(tiles):
    n = tiles.filter("gx in (0, 7)").groupBy("pair_id", "comp").agg(F.count("*").alias("n"))
    return n.groupBy("pair_id").agg(F.max_by("comp", F.struct("n", -F.col("comp"))).alias("comp"))


@_query(""", c as (select gy iy, gx ix, unnest([0, 1, 2]) iz, avg(q) m from fx_epoch_px group by gy, gx), k as (select iy, ix, iz, round(m, 3) + iz * 2.5 v from c),
 p as (select frame_pk id, (frame_pk % 140) / 10.0 as y, (frame_pk % 130) / 10.0 as x, (frame_pk % 18) / 10.0 as z from fx_frames),
 w as (select id, v, (1 - abs(y - iy)) * (1 - abs(x - ix)) * (1 - abs(z - iz)) w from p join k on iy in (floor(y), floor(y) + 1) and ix in (floor(x), floor(x) + 1) and iz in (floor(z), floor(z) + 1))
 select id, round(sum(w * v), 9) v from w where w > 0 group by id""", "fx_epoch_px", "fx_frames")
def cube_interpolation(pixels, frames):
    nodes = pixels.groupBy(F.col("gy").alias("iy"), F.col("gx").alias("ix")).agg(F.round(F.avg("q"), 3).alias("m")).withColumn("iz", F.explode(F.array(*map(F.lit, (0, 1, 2))))).select("iy", "ix", "iz", (F.col("m") + F.col("iz") * 2.5).alias("v"))
    points = frames.select(F.col("frame_pk").alias("id"), *[(F.pmod("frame_pk", F.lit(n)) / 10.0).alias(k) for k, n in (("y", 140), ("x", 130), ("z", 18))])
    return _rounded(R.interpolated(nodes, points), "v")


@_query(" select younger, older, cast(sum(gy) as bigint) s, max(case when phase > 0 then 1 else 0 end) any_positive from fx_ifg_px group by all having count(*) >= 100", "fx_ifg_px")
def pair_summary(phases):
    return phases.groupBy("younger", "older").agg(F.count("*").alias("n"), F.sum("gy").alias("s"), F.max(F.when(F.col("phase") > 0, 1).otherwise(0)).alias("any_positive")).filter("n >= 100").drop("n")


@_query(None, "fx_ifg_px")
def network_inversion(phases):
    return _rounded(N.inverted_network(phases.groupBy("younger", "older").agg(F.avg("phase").alias("value"))), "cumulative")


@_query(_STITCH.replace("a.comp c1, b.comp c2, ", "").replace(" and a.comp <> 0 and b.comp <> 0", "") + " select pair_id, gy, gx, round(avg(v + shift), 9) + 0.0 v from fx_tile_px join c using (pair_id, frame_ord) where v is not null group by all", "fx_tile_px")
def ionosphere_chain(tiles):
    return _rounded(U.ionosphere(tiles), "v")


@_query(None, "fx_epoch_px")
def surface_fit(pixels):
    mean = pixels.groupBy("gy", "gx").agg(F.avg("q").alias("v"))
    return U.with_surface(mean, U.fit_surface(mean)).select("gy", "gx", F.round("surface", 6).alias("surface"))


@_query(None, "fx_frames")
def frame_areas(frames):
    corner = lambda x, y: F.array(F.lit(x), F.col(y))
    ring = F.array(corner(10.0, "min_lat"), corner(12.0, "min_lat"), corner(12.0, "max_lat"), corner(10.0, "max_lat"))
    return frames.select("frame_pk", F.round(ring_area_km2(ring), 6).alias("area_km2"))


@_query(" select gy, gx, round(avg(q), 9) v, count(*) n from fx_epoch_px where epoch in (select younger from fx_pairs) group by all", "fx_epoch_px", "fx_pairs")
def used_epochs(pixels, pairs):
    return _rounded(pixels.join(pairs.select(F.col("younger").alias("epoch")).distinct(), "epoch", "left_semi").groupBy("gy", "gx").agg(F.avg("q").alias("v"), F.count("*").alias("n")), "v")


@_query(", e as (select distinct epoch from fx_epoch_px), p as (select younger epoch from fx_pairs union select older from fx_pairs) (select epoch from e intersect select epoch from p) union all (select epoch from e except select epoch from p)", "fx_epoch_px", "fx_pairs")
def epoch_sets(pixels, pairs):
    e, p = pixels.select("epoch").distinct(), pairs.select(F.explode(F.array("younger", "older")).alias("epoch")).distinct()
    return e.intersect(p).unionAll(e.exceptAll(p))


@_query(" select pair_id, frame_ord, gy, gx, case when v < 0.01 then null else v end v from fx_tile_px", "fx_tile_px")
def coherence_display(tiles):
    return M.blanked_below(tiles, "v", 0.01).select("pair_id", "frame_ord", "gy", "gx", "v")


@_query(_PARSED + " select pair_name, coalesce(avg(nullif(version_num, 205) / 100), 0) v from parsed group by all", "fx_products")
def baseline_network(products):
    parsed = C.parse_products(products).withColumn("b", F.nullif("version_num", F.lit(205.0)) / 100)
    return M.mean_or_zero(parsed, ["pair_name"], "b")


@_query(_PARSED + " select pair_name, min(regexp_extract(file_name, 'v(\\d+_\\d+_\\d+)', 1)) v from parsed group by all", "fx_products")
def least_version(products):
    parsed = C.parse_products(products).withColumn("version", F.regexp_extract("file_name", r"v(\d+_\d+_\d+)", 1))
    return M.least_version(parsed, ["pair_name"], "version")


@_query(" select path, min(center_lat) low, max(center_lat) high, median(frame_pk % 60 + 32601) epsg from fx_frames group by path", "fx_frames")
def range_limits(frames):
    return M.limits(frames.withColumn("epsg", F.pmod("frame_pk", F.lit(60)) + 32601), ["path"], "center_lat", "epsg")


@_query(" select pair_id, frame_ord, gy, gx, v from fx_tile_px t where exists (select 1 from fx_tile_px u where u.pair_id = t.pair_id and u.frame_ord = t.frame_ord and u.gy = t.gy and abs(u.v) > 0.25)", "fx_tile_px")
def trimmed_rows(tiles):
    blank = tiles.withColumn("_seen", F.when(F.abs("v") > 0.25, F.col("v")))
    return M.without_empty_rows(blank, ["pair_id", "frame_ord", "gy"], "_seen").select("pair_id", "frame_ord", "gy", "gx", "v")


@_query(" select path, arg_max(frame_pk, (max_lat - min_lat, -frame_pk)) frame_pk from fx_frames group by path", "fx_frames")
def largest_scene(frames):
    return M.largest(frames.withColumn("area", F.col("max_lat") - F.col("min_lat")), ["path"], "frame_pk", "area")


@_query(" select path, count(*) filter (level = 'SLC') kept, count(*) filter (level <> 'SLC') rejected from fx_frames group by path", "fx_frames")
def kept_counts(frames):
    return M.kept_and_rejected(frames, ["path"], F.col("level") == "SLC")


@_query(" select path, frame_pk, level from (select *, lag(level) over (partition by path order by frame_pk) p, row_number() over (partition by path order by frame_pk) r from fx_frames) where r = 1 or level is distinct from p", "fx_frames")
def level_changes(frames):
    return M.changes(frames, ["path"], ["frame_pk"], "level").select("path", "frame_pk", "level")


@_query(" select path, frame_pk, max(min_lat) over w south, min(max_lat) over w north from fx_frames window w as (partition by path, orbit_group order by frame_pk rows unbounded preceding)", "fx_frames")
def running_overlap(frames):
    return M.running_intersection(frames, ["path", "orbit_group"], ["frame_pk"]).select("path", "frame_pk", "south", "north")


@_query(" select path, frame_pk, cast((row_number() over (partition by path, orbit_group order by min_lat, frame_pk) - 1) as int) place, cast((row_number() over (partition by path, orbit_group order by min_lat, frame_pk) - 1) // 4 as int) chunk from fx_frames", "fx_frames")
def frame_chunks(frames):
    return M.chunked(frames, ["path", "orbit_group"], ["min_lat", "frame_pk"], 4).select("path", "frame_pk", "place", "chunk")


@_query(" select pair_id, count(distinct (mx, my)) = 1 equal from (select pair_id, frame_ord, max(gx) mx, max(gy) - min(gy) my from fx_tile_px group by all) group by pair_id", "fx_tile_px")
def equal_dimensions(tiles):
    sizes = tiles.groupBy("pair_id", "frame_ord").agg(F.max("gx").alias("mx"), (F.max("gy") - F.min("gy")).alias("my"))
    return M.all_equal(sizes, ["pair_id"], ["mx", "my"])


@_query(" select younger, older, gy, gx, round(phase - 4 * pi() * floor(phase / (4 * pi())), 9) + 0.0 wrapped, round(phase * 0.0556 / (6 * pi()), 9) + 0.0 moved from fx_ifg_px", "fx_ifg_px")
def rewrapped_phase(phases):
    return _rounded(phases.select("younger", "older", "gy", "gx", M.rewrapped(F.col("phase")).alias("wrapped"), M.displacement(F.col("phase")).alias("moved")), "wrapped", "moved")


@_query(""", p as (select pair_id, frame_ord, gy // 2 as block_y, gx // 2 as block_x, comp, count(*) n from fx_tile_px where comp is not null group by all)
 select pair_id, frame_ord, block_y, block_x, comp from (select *, row_number() over (partition by pair_id, frame_ord, block_y, block_x order by n desc, comp) r from p) where r = 1""", "fx_tile_px")
def multilook_mode(tiles):
    return M.multilook_mode(tiles, 2, ["pair_id", "frame_ord"])


@_query(" select pair_id, frame_ord, gy // 3 as block_y, gx // 3 as block_x, v from fx_tile_px where gy % 3 = 1 and gx % 3 = 1", "fx_tile_px")
def multilook_nearest(tiles):
    return M.multilook_nearest(tiles, 3, ["pair_id", "frame_ord"])


@_query(" select i.younger, i.older, i.gy, i.gx, a.q + b.q total from fx_ifg_px i join fx_epoch_px a on a.epoch = i.younger and a.gy = i.gy and a.gx = i.gx join fx_epoch_px b on b.epoch = i.older and b.gy = i.gy and b.gx = i.gx", "fx_ifg_px", "fx_epoch_px")
def delay_total(phases, pixels):
    return M.summed(phases.select("younger", "older", "gy", "gx"), pixels)
