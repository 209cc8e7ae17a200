"""Queries over terrain and weather. Cell-level results are reported as weighted sums per raster
line (a value in the wrong cell changes the sum), so that results stay comparable by hash."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perimeter.functions import geo
from perimeter.operators import labels as L
from perimeter.operators import terrain as TE
from perimeter.operators import weather as W
from perimeter.operators.ranking import seed_order
from perimeter.plans.checks import albers_sql, box_sql
from perimeter.plans.queries.scores import rounded
from perimeter.plans.queries.segments import r
from perimeter.plans.registry import query
from perimeter.plans.study import Study
from perimeter.sources.rasters import dem_tiles
from perimeter.storage import checkpoint_root


def line_sums(df: DataFrame, cols: tuple[str, ...], keys: tuple[str, ...] = ("fire_id", "row"), at: str = "col",
              digits: int = 3) -> DataFrame:
    sums = [F.round(F.sum(F.col(c) * ((F.col(at) % 17 + 1) * 0.7310585)), digits).alias(c) for c in cols]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *sums)


def line_sql(source: str, cols: tuple[str, ...], keys: str = "fire_id, row", at: str = "col", digits: int = 3) -> str:
    sums = ", ".join(f"round(sum({c} * (({at} % 17 + 1) * 0.7310585::DOUBLE)), {digits}) + 0.0 AS {c}" for c in cols)
    return f"SELECT {keys}, count(*) AS n, {sums} FROM {source} GROUP BY ALL"


# --- rasters as sources -------------------------------------------------------------------------

@query("s12_raster_mosaic", line_sql("v_dem", ("dem",), "arow", "(acol + 30000)"))
def s12(s: Study) -> DataFrame:
    dem = TE.mosaic(s.dem_tiles).withColumn("dem", F.col("value")).withColumn("at", F.col("acol") + 30000)
    return line_sums(dem, ("dem",), ("arow",), "at")


@query("f01_crop_dem", line_sql("v_elev", ("dem",)))
def f01(s: Study) -> DataFrame:
    return line_sums(TE.crop_dem(s.cells, s.dem), ("dem",))


@query("f02_majority_fuel", line_sql("v_mode", ("code",), "arow", "(acol + 30000)"))
def f02(s: Study) -> DataFrame:
    out = TE.majority(s.fuel_pixels, s.source_res, s.cfg.resolution_m).withColumn("at", F.col("acol") + 30000)
    return line_sums(out.withColumn("code", F.col("code").cast("double")), ("code",), ("arow",), "at")


@query("f03_area_average", line_sql("v_area", ("cc", "ch"), "arow", "(acol + 30000)"))
def f03(s: Study) -> DataFrame:
    out = TE.area_average(s.fuel_pixels, s.source_res, s.cfg.resolution_m, ("cc", "ch"))
    return line_sums(out.withColumn("at", F.col("acol") + 30000), ("cc", "ch"), ("arow",), "at")


@query("f04_coverage_gate", """
SELECT fire_id, round(coverage, 6) AS coverage, CASE WHEN coverage < 0.98 THEN 'refused: coverage' ELSE 'ok' END AS status FROM v_cover""")
def f04(s: Study) -> DataFrame:
    return rounded(TE.coverage(TE.crop_dem(s.cells, s.dem), s.cfg.min_coverage), "coverage")


@query("f05_median_fill", line_sql("v_filled", ("dem",)))
def f05(s: Study) -> DataFrame:
    return line_sums(TE.filled_elevation(s.grid, s.dem, s.cfg, accepted=s.accepted), ("dem",))


def terrain(s: Study) -> DataFrame:
    """Terrain needs elevation only, so neither fuel nor canopy is made for it."""
    return TE.derivatives(TE.filled_elevation(s.grid, s.dem, s.cfg, accepted=s.accepted), s.cfg.resolution_m, s.cfg.tpi_radius_m)


@query("f06_slope", line_sql("v_static", ("slope",)))
def f06(s: Study) -> DataFrame:
    return line_sums(terrain(s), ("slope",))


@query("f07_aspect", line_sql("v_static", ("aspect_sin", "aspect_cos")))
def f07(s: Study) -> DataFrame:
    return line_sums(terrain(s), ("aspect_sin", "aspect_cos"))


@query("f08_tpi", line_sql("v_static", ("tpi",)))
def f08(s: Study) -> DataFrame:
    return line_sums(terrain(s), ("tpi",))


@query("f09_fuel_index", "SELECT code, fuel_idx, count(*) AS n FROM (SELECT code, fuel_idx FROM v_static WHERE code IS NOT NULL) GROUP BY ALL")
def f09(s: Study) -> DataFrame:
    code = TE.majority(s.fuel_pixels, s.source_res, s.cfg.resolution_m)
    ok = s.cells.join(s.static.select("fire_id").distinct(), "fire_id", "left_semi")
    return (ok.join(code.filter("code IS NOT NULL").hint("merge"), ["arow", "acol"]).groupBy("code", TE.fuel_index(F.col("code")).cast("long").alias("fuel_idx"))
            .agg(F.count("*").alias("n")))


@query("f10_canopy_units", "SELECT arow, round(sum(coalesce(cc, 0)), 3) AS cc, round(sum(coalesce(ch, 0) / 10), 3) AS ch FROM v_area GROUP BY arow")
def f10(s: Study) -> DataFrame:
    cover = TE.area_average(s.fuel_pixels, s.source_res, s.cfg.resolution_m, ("cc", "ch"))
    return TE.canopy(cover).groupBy("arow").agg(F.round(F.sum("cc"), 3).alias("cc"), F.round(F.sum("ch"), 3).alias("ch"))


_STATIC = ("elevation", "slope", "aspect_sin", "aspect_cos", "tpi", "cc", "ch", "fuel_idx")


@query("f11_static_stack", line_sql("v_static", _STATIC))
def f11(s: Study) -> DataFrame:
    stack = TE.static_stack(s.grid, s.dem, s.fuel_pixels, s.source_res, s.cfg, s.accepted)
    return line_sums(stack.withColumn("fuel_idx", F.col("fuel_idx").cast("double")), _STATIC)


@query("f12_elevation_mode", line_sql("(SELECT *, elevation - avg(elevation) OVER (PARTITION BY fire_id) AS elevation_centred FROM v_static)", ("elevation_centred",)))
def f12(s: Study) -> DataFrame:
    return line_sums(TE.apply_elevation_mode(s.static, "fire_centred"), ("elevation_centred",))


@query("f13_fuel_groups", """
SELECT fire_id, CASE WHEN code BETWEEN 91 AND 99 THEN 'non-burnable' WHEN code BETWEEN 101 AND 109 THEN 'grass'
 WHEN code BETWEEN 121 AND 129 THEN 'grass-shrub' WHEN code BETWEEN 141 AND 149 THEN 'shrub'
 WHEN code BETWEEN 161 AND 169 THEN 'timber-understory' WHEN code BETWEEN 181 AND 189 THEN 'timber-litter' ELSE 'slash' END
 AS fuel_group, count(*) AS n FROM v_static WHERE code IS NOT NULL GROUP BY ALL""")
def f13(s: Study) -> DataFrame:
    code = TE.majority(s.fuel_pixels, s.source_res, s.cfg.resolution_m)
    ok = s.cells.join(s.static.select("fire_id").distinct(), "fire_id", "left_semi")
    return (ok.join(code.filter("code IS NOT NULL").hint("merge"), ["arow", "acol"]).groupBy("fire_id", TE.fuel_group(F.col("code")).alias("fuel_group"))
            .agg(F.count("*").alias("n")))


@query("f14_static_summary", """
SELECT fire_id, round(min(elevation), 4) AS elev_min, round(max(elevation), 4) AS elev_max, round(max(cc), 4) AS cc_max,
 round(max(ch), 4) AS ch_max, count(DISTINCT fuel_idx) AS fuel_classes, round(quantile_cont(slope, 0.95), 4) AS slope_p95
FROM v_static GROUP BY fire_id""")
def f14(s: Study) -> DataFrame:
    return rounded(TE.static_summary(s.static), "elev_min", "elev_max", "cc_max", "ch_max", "slope_p95", digits=4)


@query("f15_coregistration", """
SELECT fire_id, round(avg((fuel_idx BETWEEN 1 AND 5)::INT) FILTER (b), 6) AS burned_nonburnable,
 round(avg(slope) FILTER (b), 6) AS slope_burned, round(avg(slope) FILTER (NOT b), 6) AS slope_unburned,
 round(avg(cc) FILTER (b), 6) AS cc_burned, round(avg(cc) FILTER (NOT b), 6) AS cc_unburned FROM (
  SELECT s.*, f.first_t IS NOT NULL AS b FROM v_static s LEFT JOIN v_first f USING (fire_id, row, col)) GROUP BY fire_id""")
def f15(s: Study) -> DataFrame:
    return rounded(TE.coregistration(s.static, s.first), "burned_nonburnable", "slope_burned", "slope_unburned", "cc_burned", "cc_unburned")


def static_in_tiles(s: Study) -> DataFrame:
    return L.cells_in_tiles(s.samples.select("sample_id", "fire_id", "row0", "col0"), s.static, s.cfg.patch)


_CH = ("elevation", "slope", "aspect_sin", "aspect_cos", "tpi", "cc", "ch")


@query("f16_tile_variance", """SELECT channel, round(sqrt(avg(v)), 4) AS within_sd, round(sqrt(var_pop(m)), 4) AS between_sd,
 round(var_pop(m) * 100 / (var_pop(m) + avg(v)), 4) AS between_pct FROM (
  SELECT channel, sample_id, var_pop(x) AS v, avg(x) AS m FROM (
    SELECT sample_id, UNNEST(['elevation', 'slope', 'aspect_sin', 'aspect_cos', 'tpi', 'cc', 'ch']) AS channel,
           UNNEST([elevation, slope, aspect_sin, aspect_cos, tpi, cc, ch]) AS x
    FROM v_sample i JOIN v_static b ON b.fire_id = i.fire_id AND b.row BETWEEN i.row0 AND i.row0 + 31 AND b.col BETWEEN i.col0 AND i.col0 + 31)
  GROUP BY ALL) GROUP BY channel""")
def f16(s: Study) -> DataFrame:
    return rounded(TE.tile_variance(static_in_tiles(s)), "within_sd", "between_sd", "between_pct", digits=4)


# --- geographic windows ----------------------------------------------------------------------------

def aoi_boxes(s: Study) -> DataFrame:
    m = 20000
    kept = s.events.filter("keep")
    return W.box_of(W.corners_of(kept, F.col("x_min") - m, F.col("x_max") + m, F.col("y_min") - m, F.col("y_max") + m), 0.0)


_AOI = box_sql("""SELECT fire_id, CASE a WHEN 0 THEN x_min - 20000 ELSE x_max + 20000 END AS x,
  CASE b WHEN 0 THEN y_min - 20000 ELSE y_max + 20000 END AS y FROM v_events, (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(b) WHERE keep""", 0.0)
_BOX = "round(lon_min, 6) AS lon_min, round(lat_min, 6) AS lat_min, round(lon_max, 6) AS lon_max, round(lat_max, 6) AS lat_max"


@query("s14_fire_bbox", f"SELECT fire_id, {_BOX} FROM ({_AOI})")
def s14(s: Study) -> DataFrame:
    return rounded(aoi_boxes(s), "lon_min", "lat_min", "lon_max", "lat_max")


@query("s13_dem_tiles", f"""
SELECT DISTINCT printf('n%02dw%03d', lat + 1, abs(lon)) AS tile FROM (
  SELECT lat, CAST(UNNEST(range(CAST(floor(lon_min) AS BIGINT), CAST(floor(lon_max) AS BIGINT) + 1)) AS INTEGER) AS lon FROM (
    SELECT lon_min, lon_max, CAST(UNNEST(range(CAST(floor(lat_min) AS BIGINT), CAST(floor(lat_max) AS BIGINT) + 1)) AS INTEGER) AS lat
    FROM ({_AOI})))""")
def s13(s: Study) -> DataFrame:
    return dem_tiles(aoi_boxes(s)).select("tile").distinct()


@query("s15_raster_bounds", f"SELECT fire_id, {_BOX} FROM v_bounds")
def s15(s: Study) -> DataFrame:
    return rounded(W.raster_bounds(s.grid, s.cfg), "lon_min", "lat_min", "lon_max", "lat_max")


def source_cells(s: Study) -> DataFrame:
    return s.weather_grid.select("iy", "ix", geo.fold_longitude(F.col("longitude")).alias("lon"),
                                 F.col("latitude").alias("lat")).dropDuplicates(["iy", "ix"])


@query("s16_crop_window", "SELECT * FROM v_crop")
def s16(s: Study) -> DataFrame:
    return W.crop_windows(W.raster_bounds(s.grid, s.cfg), source_cells(s)).select("fire_id", "iy0", "iy1", "ix0", "ix1")


@query("s17_pinned_window", """
SELECT fire_id, iy0 - (year <= 2018)::INT AS iy0, iy1, ix0, ix1 FROM v_crop JOIN v_events USING (fire_id)""")
def s17(s: Study) -> DataFrame:
    """Two runs: the first knows the early fires, with windows a row larger than the second would choose."""
    root = f"{checkpoint_root(s.spark)}/pinned/{uuid.uuid4().hex}"
    old = s.events.filter("keep and year <= 2018").select("fire_id")
    W.pin_windows(s.crops.join(old, "fire_id", "left_semi").withColumn("iy0", F.col("iy0") - 1), root)
    return W.pin_windows(s.crops, root).select("fire_id", "iy0", "iy1", "ix0", "ix1")


@query("s11_weather_scan", """
SELECT hour, count(*) AS n, round(sum(lon), 4) AS lon, round(sum(u10), 4) AS u10, round(sum(v10), 4) AS v10, round(sum(t2m), 4) AS t2m,
 round(sum(rh2m), 4) AS rh2m, count(*) FILTER (rh_derived) AS derived FROM v_scan GROUP BY hour""")
def s11(s: Study) -> DataFrame:
    return s.scan.groupBy("hour").agg(
        F.count("*").alias("n"), *[F.round(F.sum(c), 4).alias(c) for c in ("lon", "u10", "v10", "t2m", "rh2m")],
        F.sum(F.col("rh_derived").cast("int")).alias("derived"))


@query("p04_fit_affine", "SELECT fire_id, round(wx0, 3) AS wx0, round(wy0, 3) AS wy0, round(dx, 3) AS dx, round(dy, 3) AS dy, residual < 0.01 AS regular FROM v_fit")
def p04(s: Study) -> DataFrame:
    fit = W.fit_affine(s.store.select("fire_id", "iy", "ix", "lon", "lat").dropDuplicates(["fire_id", "iy", "ix"]))
    return fit.select("fire_id", *[r(c, 3).alias(c) for c in ("wx0", "wy0", "dx", "dy")], (F.col("residual") < 0.01).alias("regular"))


# --- weather ---------------------------------------------------------------------------------------

@query("w01_needed_hours", "SELECT * FROM v_needed")
def w01(s: Study) -> DataFrame:
    return W.needed_hours(s.windows, s.cfg)


@query("w02_fan_out", """
SELECT CAST(sum(n) AS BIGINT) AS fire_hours, count(*) AS unique_hours, round(sum(n) / count(*), 6) AS dedupe FROM (
  SELECT hour, count(*) AS n FROM v_needed WHERE fire_id IN (SELECT fire_id FROM v_needed GROUP BY 1
    HAVING min(hour) >= datediff('day', DATE '1970-01-01', DATE '2016-07-30') * 24) GROUP BY hour)""")
def w02(s: Study) -> DataFrame:
    start = 17012 * 24
    return rounded(W.fan_out(s.needed, start)[1], "dedupe")


@query("w03_coverage", """
SELECT fire_id, count(n) AS hours_needed, count(*) FILTER (n AND p) AS hours_present, count(*) FILTER (p AND n IS NULL) AS repair_hours,
       round_even(count(*) FILTER (n AND p) * 100 / greatest(count(n), 1), 1) AS pct FROM (
  SELECT coalesce(a.fire_id, b.fire_id) AS fire_id, a.n, b.p FROM (SELECT *, true AS n FROM v_needed) a
  FULL JOIN (SELECT *, true AS p FROM v_filledhour) b ON a.fire_id = b.fire_id AND a.hour = b.hour) GROUP BY fire_id""")
def w03(s: Study) -> DataFrame:
    return W.coverage(s.needed, s.stored_hours)


@query("w04_store_upsert", """
SELECT fire_id, hour, count(*) AS n, round(sum(t2m), 4) AS t2m FROM (
  SELECT fire_id, hour, CASE WHEN rh_derived THEN t2m + 1 ELSE t2m END AS t2m FROM v_store) GROUP BY ALL""")
def w04(s: Study) -> DataFrame:
    """Two runs: hours of the second replace those of the first and leave the others where they are."""
    root = f"{checkpoint_root(s.spark)}/store/{uuid.uuid4().hex}"
    W.upsert(s.store, root)
    merged = W.upsert(s.store.filter("rh_derived").withColumn("t2m", F.col("t2m") + 1), root)
    return merged.groupBy("fire_id", "hour").agg(F.count("*").alias("n"), F.round(F.sum("t2m"), 4).alias("t2m"))


@query("w05_gap_neighbours", "SELECT * FROM v_rep1")
def w05(s: Study) -> DataFrame:
    filled = s.needed.join(s.archive_hours, "hour", "left_semi").select("fire_id", "hour")
    return W.gap_neighbours(s.needed, filled)


@query("w06_repair_plan", "SELECT fire_id, hour, round FROM v_wanted")
def w06(s: Study) -> DataFrame:
    return W.repair_plan(s.needed, s.archive_hours, 2)


@query("w07_hour_bridge", "SELECT fire_id, k, lag, hour, lo, hi, round(w, 6) AS w FROM v_plan")
def w07(s: Study) -> DataFrame:
    return rounded(W.bridge(W.window_hours(s.windows, s.cfg), s.stored_hours, s.cfg.max_reach), "w")


@query("w08_bilinear_regrid", line_sql("v_wcell", ("u10_lag0", "v10_lag0", "t2m"), "fire_id, k", digits=2))
def w08(s: Study) -> DataFrame:
    values = ["u10_lag0", "v10_lag0", "t2m"]
    quad = W.quads(s.fields.select("fire_id", "k", "iy", "ix", *values), ["fire_id", "k"], values)
    corners = W.corner_table(s.tile_cells, s.grid, s.fit, s.cfg)
    return line_sums(W.interpolate(corners, quad, ["fire_id"], values), tuple(values), ("fire_id", "k"), digits=2)


@query("w09_dewpoint_humidity", """
SELECT fire_id, hour, rh_derived, count(*) AS n, round(sum(rh2m), 4) AS rh2m FROM v_store GROUP BY ALL""")
def w09(s: Study) -> DataFrame:
    return s.store.groupBy("fire_id", "hour", "rh_derived").agg(F.count("*").alias("n"), F.round(F.sum("rh2m"), 4).alias("rh2m"))


@query("w10_fuel_moisture", line_sql("v_wcell", ("fosberg_10h",), "fire_id, k", digits=2))
def w10(s: Study) -> DataFrame:
    return line_sums(W.weather_cells(s.corners, s.fields), ("fosberg_10h",), ("fire_id", "k"), digits=2)


_W9 = ("u10_lag0", "u10_lag6", "u10_lag12", "v10_lag0", "v10_lag6", "v10_lag12", "rh2m", "t2m", "fosberg_10h")


@query("w11_weather_steps", line_sql("v_wcell", _W9, "fire_id, k", "row", digits=2))
def w11(s: Study) -> DataFrame:
    fields = W.step_fields(s.store, s.weather_plan, s.cfg)
    return line_sums(W.weather_cells(s.corners, fields), _W9, ("fire_id", "k"), "row", digits=2)


_SAMPLE_STATE = """(SELECT s.fire_id, s.sample_id, avg(sqrt(w.u10_lag0 * w.u10_lag0 + w.v10_lag0 * w.v10_lag0)) AS wind_speed, avg(w.rh2m) AS rh,
  avg(w.t2m) - 273.15 AS t_c, avg(w.fosberg_10h) AS fosberg FROM v_step s JOIN v_wcell w ON w.fire_id = s.fire_id AND w.k = s.k
   AND w.row BETWEEN s.row0 AND s.row0 + 31 AND w.col BETWEEN s.col0 AND s.col0 + 31 GROUP BY ALL)"""
_FIRE_STATE = f"""(SELECT fire_id, avg(wind_speed) AS wind_speed, avg(rh) AS rh, avg(t_c) AS t_c, avg(fosberg) AS fosberg
  FROM {_SAMPLE_STATE} GROUP BY fire_id)"""


def checked_weather(s: Study) -> DataFrame:
    return W.validation(s.index, s.samples, W.weather_cells(s.corners, s.fields), s.cfg)


@query("w12_weather_validation", f"""
SELECT i.fire_id, i.samples, coalesce(o.ok, 0) AS ok, i.samples - coalesce(o.ok, 0) AS dropped, round(s.wind_speed, 4) AS wind_speed,
 round(s.rh, 4) AS rh, round(s.t_c, 4) AS t_c, round(s.fosberg, 4) AS fosberg FROM (SELECT fire_id, count(*) AS samples FROM v_index GROUP BY 1) i
LEFT JOIN (SELECT fire_id, count(*) AS ok FROM v_sample GROUP BY 1) o USING (fire_id) LEFT JOIN {_FIRE_STATE} s USING (fire_id)""")
def w12(s: Study) -> DataFrame:
    return rounded(checked_weather(s), "wind_speed", "rh", "t_c", "fosberg", digits=4)


@query("w12_weather_medians", f"""
SELECT field, round(median(v), 4) AS median FROM (
  SELECT UNNEST(['wind_speed', 'rh', 't_c', 'fosberg']) AS field, UNNEST([wind_speed, rh, t_c, fosberg]) AS v FROM {_FIRE_STATE}) GROUP BY field""")
def w12c(s: Study) -> DataFrame:
    return rounded(W.weather_medians(checked_weather(s)), "median", digits=4)


@query("w12_guarded_prune", "SELECT sample_id FROM v_sample")
def w12b(s: Study) -> DataFrame:
    return W.guarded_prune(s.index, s.samples, checked_weather(s).select("fire_id")).select("sample_id")


@query("w13_verify_store", """
SELECT fire_id, count(*) AS needed, count(*) FILTER (w.hour IS NULL) AS absent,
 count(*) FILTER (w.hour IS NOT NULL AND f.hour IS NULL) AS hollow,
 CASE WHEN count(w.hour) = count(*) AND count(f.hour) = count(*) THEN 'ok' ELSE 'incomplete' END AS status
FROM v_needed n LEFT JOIN (SELECT * FROM v_wanted WHERE round > 0 OR hour NOT BETWEEN 438288 AND 438480) w USING (fire_id, hour)
LEFT JOIN v_filledhour f USING (fire_id, hour) GROUP BY fire_id""")
def w13(s: Study) -> DataFrame:
    listed = s.wanted.filter("round > 0 or hour not between 438288 and 438480").select("fire_id", "hour")
    return W.verify_store(s.needed, listed, s.stored_hours)


@query("w14_spot_check", """
SELECT s.fire_id, s.hour, round(max(greatest(abs(s.t2m - f.t2m), 0)), 4) AS max_diff, max(abs(s.t2m - f.t2m)) < 1e-3 AS ok FROM v_store s
JOIN (SELECT fire_id, hour, iy, ix, t2m + CASE WHEN hour % 4 = 0 THEN 0.5 ELSE 0 END AS t2m FROM v_store) f USING (fire_id, hour, iy, ix)
WHERE (s.fire_id, s.hour) IN (SELECT fire_id, hour FROM (SELECT *, row_number() OVER (PARTITION BY fire_id
  ORDER BY md5('0:' || fire_id || ':' || hour)) AS k FROM v_filledhour) WHERE k <= 5) GROUP BY ALL""")
def w14(s: Study) -> DataFrame:
    order = Window.partitionBy("fire_id").orderBy(seed_order(0, "fire_id", "hour"))
    sampled = s.stored_hours.withColumn("k", F.row_number().over(order)).filter("k <= 5").select("fire_id", "hour")
    fresh = s.store.withColumn("t2m", F.col("t2m") + F.when(F.col("hour") % 4 == 0, 0.5).otherwise(0.0))
    return rounded(W.spot_check(sampled, s.store, fresh), "max_diff", digits=4)


@query("w15_missing_and_derived", """
SELECT fire_id, hour, 'missing' AS kind FROM v_needed WHERE (fire_id, hour) NOT IN (SELECT fire_id, hour FROM v_filledhour)
UNION ALL SELECT DISTINCT fire_id, hour, 'rh_derived' FROM v_store WHERE rh_derived""")
def w15(s: Study) -> DataFrame:
    missing = s.needed.join(s.stored_hours, ["fire_id", "hour"], "left_anti").withColumn("kind", F.lit("missing"))
    derived = s.store.filter("rh_derived").select("fire_id", "hour").distinct().withColumn("kind", F.lit("rh_derived"))
    return missing.unionByName(derived)


@query("w16_coarse_wind", """
SELECT s.fire_id, s.hour, s.iy, s.ix, s.u10, s.v10, round(m.t_c, 4) AS t_c, round(m.rh, 4) AS rh FROM v_store s JOIN v_crop c USING (fire_id)
JOIN (SELECT fire_id, hour, avg(t2m) - 273.15 AS t_c, avg(rh2m) AS rh FROM v_store GROUP BY ALL) m USING (fire_id, hour)
WHERE s.iy IN (SELECT CAST(floor((c.iy1 - c.iy0) * i / 11) + c.iy0 AS INTEGER) FROM range(12) t(i))
  AND s.ix IN (SELECT CAST(floor((c.ix1 - c.ix0) * i / 11) + c.ix0 AS INTEGER) FROM range(12) t(i))""")
def w16(s: Study) -> DataFrame:
    return rounded(W.coarse_wind(s.store, 12), "t_c", "rh", digits=4)


_SX, _SY = albers_sql("lon", "lat")


@query("w17_wind_in_box", f"""
SELECT w.fire_id, w.hour, w.iy, w.ix, w.u10, w.v10, round(w.x, 3) AS x, round(w.y, 3) AS y FROM (
  SELECT *, {_SX} AS x, {_SY} AS y FROM v_store) w JOIN v_events e USING (fire_id)
WHERE w.x BETWEEN e.x_min - (e.x_max - e.x_min) * 0.15 AND e.x_max + (e.x_max - e.x_min) * 0.15
  AND w.y BETWEEN e.y_min - (e.y_max - e.y_min) * 0.15 AND e.y_max + (e.y_max - e.y_min) * 0.15""")
def w17(s: Study) -> DataFrame:
    return rounded(W.wind_in_box(s.store, s.events.filter("keep")), "x", "y", digits=3)
