"""Queries over detections, projections, events and labels."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perimeter.functions import geo
from perimeter.operators import cells as C
from perimeter.operators import labels as L
from perimeter.operators import links as K
from perimeter.operators import segmentation as E
from perimeter.plans.checks import P, albers_inverse_sql, lambert_sql, offsets_sql
from perimeter.plans.registry import query
from perimeter.plans.study import Study
from perimeter.sources import detections as S
from perimeter.sources import ledger as LG
from perimeter.storage import checkpoint_root

FILE_COLUMNS = ["latitude", "longitude", "acq_date", "acq_time", "confidence", "frp", "type", "satellite"]


def r(col, digits: int = 4):
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, digits)


# --- sources ----------------------------------------------------------------------------------

@query("s02_clean_detections", "SELECT det_id, confidence, frp, type FROM v_kept")
def s02(s: Study) -> DataFrame:
    return S.clean_detections(s.raw).select("det_id", "confidence", "frp", "type")


@query("s03_parse_acquisition", "SELECT det_id, acq FROM v_timed")
def s03(s: Study) -> DataFrame:
    return S.parse_acquisition(S.clean_detections(s.raw)).select("det_id", "acq")


@query("s04_dedupe_detections", """
SELECT latitude, longitude, acq, confidence, frp FROM (
  SELECT *, row_number() OVER (PARTITION BY latitude, longitude, acq ORDER BY file, confidence, frp, det_id) AS rn
  FROM (SELECT * FROM v_timed UNION ALL SELECT * REPLACE ('rerun_' || file AS file, frp + 1 AS frp) FROM v_timed))
WHERE rn = 1""")
def s04(s: Study) -> DataFrame:
    timed = S.parse_acquisition(S.clean_detections(s.raw))
    rerun = timed.withColumn("file", F.concat(F.lit("rerun_"), "file")).withColumn("frp", F.col("frp") + 1)
    return (S.dedupe_detections(timed.unionByName(rerun, allowMissingColumns=True))
            .select("latitude", "longitude", "acq", "confidence", "frp"))


def year_spans(s: Study) -> DataFrame:
    day = F.col("acq_date").cast("date")
    return s.raw.groupBy(F.year(day).alias("year")).agg(F.min(day).alias("first"), F.max(day).alias("last"))


_SPANS = """(SELECT year(CAST(acq_date AS DATE)) AS year, min(CAST(acq_date AS DATE)) AS first,
             max(CAST(acq_date AS DATE)) AS last FROM v_raw GROUP BY 1)"""
_CHUNKS = f"""(SELECT year, chunk_start, least(5, datediff('day', chunk_start, last) + 1) AS n_days FROM (
  SELECT year, last, CAST(UNNEST(range(CAST(CASE WHEN first > DATE '2015-01-03'
           THEN first - CAST(datediff('day', DATE '2015-01-03', first) % 5 AS INTEGER) ELSE first END AS TIMESTAMP),
         CAST(last AS TIMESTAMP) + INTERVAL 1 HOUR, INTERVAL 5 DAY)) AS DATE) AS chunk_start FROM {_SPANS}))"""


@query("s05_plan_chunks", f"SELECT year, chunk_start, CAST(n_days AS INTEGER) AS n_days FROM {_CHUNKS}")
def s05(s: Study) -> DataFrame:
    return S.plan_chunks(year_spans(s), 5, "2015-01-03").select("year", "chunk_start", "n_days")


@query("s06_pending_chunks", f"""
SELECT year, chunk_start FROM {_CHUNKS} c WHERE NOT EXISTS (
  SELECT 1 FROM v_landed k WHERE CAST(k.acq_date AS DATE) BETWEEN c.chunk_start AND c.chunk_start + 4)""")
def s06(s: Study) -> DataFrame:
    """What is left to do after an interrupted run, told from the names of the files it has written."""
    planned = S.plan_chunks(year_spans(s), 5, "2015-01-03")
    day = F.expr("explode(sequence(chunk_start, date_add(chunk_start, n_days - 1), interval 1 day))")
    days = planned.select(F.concat_ws("_", F.col("year").cast("string"), F.col("chunk_start").cast("string")).alias("chunk"), day.alias("day"))
    rows = S.clean_detections(s.landed).withColumn("day", F.col("acq_date").cast("date")).join(days, "day")
    path = f"{checkpoint_root(s.spark)}/landed/{uuid.uuid4().hex}"
    LG.land_chunks(rows.select("chunk").distinct(), rows, path, FILE_COLUMNS)
    landed = LG.file_ledger(s.spark, path)
    planned = planned.withColumn("chunk", F.concat_ws("_", F.col("year").cast("string"), F.col("chunk_start").cast("string")))
    return S.pending_chunks(planned, landed, "chunk").select("year", "chunk_start")


_DAYS = "(SELECT DISTINCT CAST(acq_date AS DATE) AS day FROM v_landed)"
FIRST_DAY, LAST_DAY = "2015-01-01", "2023-12-31"
_MISSING = f"""(SELECT d AS day FROM (SELECT CAST(UNNEST(range(TIMESTAMP '{FIRST_DAY}',
    TIMESTAMP '{LAST_DAY}' + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS d)
  WHERE d NOT IN (SELECT day FROM {_DAYS}))"""


def landed_days(s: Study) -> DataFrame:
    return S.clean_detections(s.landed).select(F.col("acq_date").cast("date").alias("day"))


@query("s07_missing_days", f"SELECT day FROM {_MISSING}")
def s07a(s: Study) -> DataFrame:
    return S.missing_days(landed_days(s), FIRST_DAY, LAST_DAY)


@query("s07_empty_runs", f"""
SELECT min(day) AS start, count(*) AS days, month(min(day)) BETWEEN 6 AND 10 AS in_season FROM (
  SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS g FROM {_MISSING}) GROUP BY g HAVING count(*) >= 3""")
def s07b(s: Study) -> DataFrame:
    return S.empty_runs(S.missing_days(landed_days(s), FIRST_DAY, LAST_DAY))


@query("s07_empty_files", """
SELECT f.file, 1 + coalesce(n, 0) AS n_lines FROM (SELECT DISTINCT file FROM v_raw) f
LEFT JOIN (SELECT file, count(*) AS n FROM v_landed GROUP BY file) USING (file) WHERE coalesce(n, 0) = 0""")
def s07c(s: Study) -> DataFrame:
    """Files of the archive that hold a header at most, by counting the lines of all files."""
    path = f"{checkpoint_root(s.spark)}/landed/{uuid.uuid4().hex}"
    rows = S.clean_detections(s.landed).withColumn("chunk", F.col("file"))
    LG.land_chunks(s.raw.select(F.col("file").alias("chunk")).distinct(), rows, path, FILE_COLUMNS)
    return S.empty_files(LG.file_ledger(s.spark, path).select(F.col("chunk").alias("file"), "n_lines"))


# --- projections ------------------------------------------------------------------------------

@query("p01_lonlat_to_albers", "SELECT det_id, round(x, 3) AS x, round(y, 3) AS y FROM v_det")
def p01(s: Study) -> DataFrame:
    return s.detections.select("det_id", r("x", 3).alias("x"), r("y", 3).alias("y"))


_LON, _LAT = albers_inverse_sql("x", "y")


@query("p02_albers_to_lonlat", f"""
SELECT det_id, round({_LON}, 6) AS lon, round({_LAT}, 6) AS lat FROM v_det""")
def p02(s: Study) -> DataFrame:
    lon, lat = geo.albers_to_lonlat(F.col("x"), F.col("y"))
    return s.detections.select("det_id", r(lon, 6).alias("lon"), r(lat, 6).alias("lat"))


_LX, _LY = lambert_sql("longitude", "latitude")


@query("p03_lonlat_to_lambert", f"SELECT det_id, round({_LX}, 3) AS lx, round({_LY}, 3) AS ly FROM v_det")
def p03(s: Study) -> DataFrame:
    x, y = geo.lonlat_to_lambert(F.col("longitude"), F.col("latitude"))
    return s.detections.select("det_id", r(x, 3).alias("lx"), r(y, 3).alias("ly"))


@query("p05_cell_round_trip", """
SELECT l.det_id, l.fire_id, CAST(floor((g.y1 - l.y) / 100) AS INTEGER) AS row,
       CAST(floor((l.x - g.x0) / 100) AS INTEGER) AS col, g.x0 + (floor((l.x - g.x0) / 100) + 0.5) * 100 AS cx,
       g.y1 - (floor((g.y1 - l.y) / 100) + 0.5) * 100 AS cy
FROM v_lab l JOIN v_grid g USING (fire_id)""")
def p05(s: Study) -> DataFrame:
    row, col = geo.cell_of(F.col("x"), F.col("y"), F.col("x0"), F.col("y1"), 100)
    placed = s.labelled.join(s.grid, "fire_id").withColumn("row", row).withColumn("col", col)
    cx, cy = geo.centre_of(F.col("row"), F.col("col"), F.col("x0"), F.col("y1"), 100)
    return placed.select("det_id", "fire_id", "row", "col", cx.cast("double").alias("cx"), cy.cast("double").alias("cy"))


# --- events -----------------------------------------------------------------------------------

@query("e01_link_graph", """
SELECT abt AS a_t, aby AS a_y, abx AS a_x, bbt AS b_t, bby AS b_y, bbx AS b_x FROM (
  SELECT DISTINCT CASE WHEN f THEN abt ELSE bbt END AS abt, CASE WHEN f THEN aby ELSE bby END AS aby,
         CASE WHEN f THEN abx ELSE bbx END AS abx, CASE WHEN f THEN bbt ELSE abt END AS bbt,
         CASE WHEN f THEN bby ELSE aby END AS bby, CASE WHEN f THEN bbx ELSE abx END AS bbx
  FROM (SELECT *, (abt, aby, abx) < (bbt, bby, bbx) AS f FROM v_links))""")
def e01(s: Study) -> DataFrame:
    links = K.link_boxes(s.detections, s.cfg.link_km * 1000, s.cfg.link_hours)
    return links.select(*K.box_index("a"), *K.box_index("b"))


@query("e02_connected_components", """
SELECT det_id, first_value(det_id) OVER (PARTITION BY comp ORDER BY t_s, det_id) AS root_id FROM v_point""")
def e02(s: Study) -> DataFrame:
    boxed, labels = E.component_points(s.detections, s.cfg)
    joined = boxed.join(labels, "box")
    root = (joined.groupBy("component").agg(F.min(F.struct("t_s", "det_id")).alias("r"))
            .select("component", F.col("r.det_id").alias("root_id")))
    return joined.join(root, "component").select("det_id", "root_id")


@query("e03_event_numbers", "SELECT event, root_id, start_ts FROM v_events")
def e03(s: Study) -> DataFrame:
    return s.events.select("event", "root_id", "start_ts")


@query("e04_summarize_events", """
SELECT event, n_detections, start_ts, end_ts, round(lat, 6) AS lat, round(lon, 6) AS lon, round(x_min, 3) AS x_min,
       round(x_max, 3) AS x_max, round(y_min, 3) AS y_min, round(y_max, 3) AS y_max, frp_max FROM v_events""")
def e04(s: Study) -> DataFrame:
    return s.events.select("event", "n_detections", "start_ts", "end_ts", r("lat", 6).alias("lat"),
                           r("lon", 6).alias("lon"), *[r(c, 3).alias(c) for c in ("x_min", "x_max", "y_min", "y_max")],
                           "frp_max")


@query("e05_event_timesteps", "SELECT event, n_timesteps FROM v_events")
def e05(s: Study) -> DataFrame:
    return s.events.select("event", "n_timesteps")


@query("e06_event_extent", f"""
SELECT event, year, round(duration_h, 4) AS duration_h, extent_px_x, extent_px_y,
       extent_px_x <= {P} AND extent_px_y <= {P} AS fits_one_patch FROM v_events""")
def e06(s: Study) -> DataFrame:
    return s.events.select("event", "year", r("duration_h").alias("duration_h"), "extent_px_x", "extent_px_y",
                           "fits_one_patch")


@query("e07_keep_events", "SELECT event, keep FROM v_events")
def e07(s: Study) -> DataFrame:
    return s.events.select("event", "keep")


@query("e08_touches_no_data", "SELECT event, touches_no_data FROM v_events")
def e08(s: Study) -> DataFrame:
    return E.flag_outages(s.events.drop("touches_no_data"), s.cfg).select("event", "touches_no_data")


@query("e09_fire_ids", "SELECT event, fire_id FROM v_events")
def e09(s: Study) -> DataFrame:
    return s.events.select("event", "fire_id")


@query("e10_label_detections", "SELECT det_id, event, fire_id FROM v_lab")
def e10(s: Study) -> DataFrame:
    return s.labelled.select("det_id", "event", "fire_id")


@query("e11_event_report", """
SELECT year, count(*) AS n_raw, count(*) FILTER (keep) AS n_kept,
       CAST(coalesce(sum(n_detections) FILTER (keep), 0) AS BIGINT) AS kept_detections FROM v_events GROUP BY year""")
def e11a(s: Study) -> DataFrame:
    return E.event_report(s.events)


@query("e11_largest_events", """
SELECT fire_id, event, n_detections FROM v_events WHERE keep ORDER BY n_detections DESC, event LIMIT 10""")
def e11b(s: Study) -> DataFrame:
    return E.largest_events(s.events).select("fire_id", "event", "n_detections")


@query("e12_named_subset", """
SELECT fire_id, event FROM v_events WHERE keep AND frp_max > 300 AND NOT touches_no_data""")
def e12(s: Study) -> DataFrame:
    wanted = s.events.filter("keep and frp_max > 300").select("fire_id")
    return E.named_subset(s.events, wanted).select("fire_id", "event")


@query("e13_elapsed_hours", """
SELECT det_id, fire_id, round((t_s - min(t_s) OVER (PARTITION BY fire_id)) / 3600.0, 4) AS elapsed_h FROM v_lab""")
def e13(s: Study) -> DataFrame:
    return E.elapsed_hours(s.labelled).select("det_id", "fire_id", r("elapsed_h").alias("elapsed_h"))


# --- labels -----------------------------------------------------------------------------------

@query("l01_fire_grid", "SELECT fire_id, x0, y1, width, height FROM v_grid")
def l01(s: Study) -> DataFrame:
    return s.grid.select("fire_id", F.col("x0").cast("long").alias("x0"), F.col("y1").cast("long").alias("y1"),
                         "width", "height")


@query("l02_tumbling_bins", "SELECT det_id, TIMESTAMP '1970-01-01' + to_days(CAST(t_s // 86400 AS INTEGER)) AS bin_start FROM v_lab")
def l02(s: Study) -> DataFrame:
    return s.labelled.select("det_id", F.window("acq", f"{s.cfg.window_hours} hours")["start"].alias("bin_start"))


@query("l03_window_spine", "SELECT fire_id, t_index, window_time, n_det FROM v_win")
def l03(s: Study) -> DataFrame:
    return L.label_windows(s.labelled, s.cfg).select("fire_id", "t_index", "window_time", "n_det")


@query("l04_gap_flags", "SELECT fire_id, t_index, CAST(gap_h AS BIGINT) AS gap_h, gap_flag FROM v_win")
def l04(s: Study) -> DataFrame:
    return s.windows.select("fire_id", "t_index", "gap_h", "gap_flag")


@query("l05_no_data", "SELECT fire_id, t_index, no_data FROM v_win")
def l05(s: Study) -> DataFrame:
    return s.windows.select("fire_id", "t_index", "no_data")


@query("l06_usable", "SELECT fire_id, t_index, usable FROM v_win")
def l06(s: Study) -> DataFrame:
    return s.windows.select("fire_id", "t_index", "usable")


@query("l07_rasterize_points", "SELECT fire_id, t_index, row, col FROM v_pts")
def l07(s: Study) -> DataFrame:
    return L.point_cells(s.labelled, s.grid, s.windows, s.cfg)


@query("l08_structuring_elements", f"""
SELECT kind, size, fire_id, t_index, count(*) AS n FROM (
  SELECT DISTINCT kind, size, fire_id, t_index, row + dr, col + dc FROM v_pts, (
    SELECT 'disk' AS kind, 4 AS size, dr, dc FROM {offsets_sql(C.disk(4))}
    UNION ALL SELECT 'diamond', 3, dr, dc FROM {offsets_sql(C.diamond(3))}) e) GROUP BY ALL""")
def l08(s: Study) -> DataFrame:
    key = ["fire_id", "t_index"]
    rows = C.to_rows(L.point_cells(s.labelled, s.grid, s.windows, s.cfg), key)
    parts = [C.count_rows(C.dilate_rows(rows, key, off), key)
             .select(F.lit(kind).alias("kind"), F.lit(size).alias("size"), *key, "n")
             for kind, size, off in (("disk", 4, C.disk(4)), ("diamond", 3, C.diamond(3)))]
    return parts[0].unionByName(parts[1])


@query("l09_dilate", "SELECT fire_id, t_index, row, col FROM v_dil")
def l09(s: Study) -> DataFrame:
    return C.dilate(L.point_cells(s.labelled, s.grid, s.windows, s.cfg), ["fire_id", "t_index"], C.disk(2))


@query("l10_close", "SELECT fire_id, t_index, row, col FROM v_burn")
def l10(s: Study) -> DataFrame:
    key = ["fire_id", "t_index"]
    grown = C.dilate_rows(C.to_rows(L.point_cells(s.labelled, s.grid, s.windows, s.cfg), key), key, C.disk(2))
    return C.to_cells(C.close_rows(grown, key, C.disk(4)), key)


@query("l11_burn_cells", "SELECT fire_id, t_index, row, col FROM v_burn")
def l11(s: Study) -> DataFrame:
    return L.burn_cells(s.labelled, s.grid, s.windows, s.cfg)


@query("l12_label_manifest", """
SELECT w.*, g.height, g.width, coalesce(b.n, 0) AS burned_px FROM (
  SELECT fire_id, count(*) AS windows, count(*) FILTER (usable) AS usable, count(*) FILTER (gap_flag) AS gaps,
         count(*) FILTER (n_det > 0) AS observed FROM v_win GROUP BY fire_id) w
JOIN v_grid g USING (fire_id) LEFT JOIN (SELECT fire_id, count(*) AS n FROM v_burn GROUP BY 1) b USING (fire_id)""")
def l12(s: Study) -> DataFrame:
    return L.label_manifest(s.windows, s.burn, s.grid)


@query("l13_first_burn", "SELECT fire_id, row, col, first_t FROM v_first")
def l13(s: Study) -> DataFrame:
    return L.first_burn(s.burn)


@query("l14_targets", """
SELECT b.fire_id, b.t_index - 1 AS t_index, b.row, b.col FROM v_burn b WHERE b.t_index >= 1 AND NOT EXISTS (
  SELECT 1 FROM v_burn p WHERE p.fire_id = b.fire_id AND p.row = b.row AND p.col = b.col AND p.t_index < b.t_index)""")
def l14(s: Study) -> DataFrame:
    return L.targets(s.first)


@query("l15_horizon_targets", """
SELECT fire_id, t_index, row, col FROM (SELECT f.fire_id, w.t_index, f.row, f.col, f.first_t FROM v_first f
  JOIN v_win w USING (fire_id)) WHERE first_t BETWEEN t_index + 1 AND t_index + 3""")
def l15(s: Study) -> DataFrame:
    return L.targets(s.first, 3)


@query("l16_fire_sizes", """
SELECT fire_id, count(*) AS burned_px, count(DISTINCT (row, col)) AS distinct_px FROM v_burn GROUP BY fire_id""")
def l16(s: Study) -> DataFrame:
    distinct = s.first.groupBy("fire_id").agg(F.count("*").alias("distinct_px"))
    return L.fire_sizes(s.burn).join(distinct, "fire_id")


@query("l17_most_active_windows", """
SELECT fire_id, t_index, window_time, new_px FROM (
  SELECT w.fire_id, w.t_index, w.window_time, b.n AS new_px,
         row_number() OVER (PARTITION BY w.fire_id ORDER BY b.n DESC, w.t_index) AS k
  FROM v_win w JOIN (SELECT fire_id, t_index, count(*) AS n FROM v_burn GROUP BY ALL) b USING (fire_id, t_index)
  JOIN (SELECT fire_id, max(t_index) AS last FROM v_win GROUP BY fire_id) e USING (fire_id)
  WHERE w.usable AND w.t_index < e.last) WHERE k <= 3""")
def l17(s: Study) -> DataFrame:
    return L.most_active_windows(s.windows, s.burn)


@query("v25_window_emptiness", """
SELECT window_h, sum(n) AS windows, sum(n - seen) AS empty, round(sum(n - seen) / sum(n), 6) AS share_empty FROM (
  SELECT window_h, fire_id, max(b) - min(b) + 1 AS n, count(DISTINCT b) AS seen FROM (
    SELECT window_h, fire_id, t_s // (window_h * 3600) AS b FROM v_lab, (VALUES (3), (6), (12), (24)) AS w(window_h))
  GROUP BY ALL) GROUP BY window_h""")
def v25(s: Study) -> DataFrame:
    return L.window_emptiness(s.labelled).withColumn("share_empty", r("share_empty", 6))
