"""Queries over the sample index and the naive baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perimeter.functions.bins import skill
from perimeter.operators import baselines as B
from perimeter.operators import cells as C
from perimeter.operators import labels as L
from perimeter.operators import tiling as T
from perimeter.plans.checks import P, origins_sql
from perimeter.plans.queries.segments import r
from perimeter.plans.registry import query
from perimeter.plans.study import Study

SKILL = ("round(tp / greatest(tp + fp + fn, 1), 6) AS csi, round(fp / greatest(tp + fp, 1), 6) AS far,"
         " round(tp / greatest(tp + fn, 1), 6) AS pod, round(tp / greatest(tp + fp + fn, 1), 6) AS iou")


def rounded_skill() -> list:
    return [F.round(c, 6).alias(n) for c, n in zip(skill(), ("csi", "far", "pod", "iou"))]


@query("t01_tile_origins", f"""
SELECT fire_id, t_index, CAST({origins_sql('r_min', 'r_max', 'height')} AS VARCHAR) AS row_origins,
       CAST({origins_sql('c_min', 'c_max', 'width')} AS VARCHAR) AS col_origins FROM v_bbox JOIN v_grid USING (fire_id)""")
def t01(s: Study) -> DataFrame:
    box = T.active_bbox(s.burn).join(s.grid, "fire_id")
    rows = T.tile_origins(F.col("r_min"), F.col("r_max"), F.col("height"), s.cfg.patch, s.cfg.stride)
    cols = T.tile_origins(F.col("c_min"), F.col("c_max"), F.col("width"), s.cfg.patch, s.cfg.stride)
    return box.select("fire_id", "t_index", rows.cast("string").alias("row_origins"), cols.cast("string").alias("col_origins"))


@query("t02_active_bbox", "SELECT * FROM v_bbox")
def t02(s: Study) -> DataFrame:
    return T.active_bbox(s.burn)


@query("t03_build_index", "SELECT sample_id, fire_id, t_index, window_time, row0, col0 FROM v_index")
def t03(s: Study) -> DataFrame:
    return (T.build_index(s.windows, s.burn, s.first, s.grid, s.cfg)
            .select("sample_id", "fire_id", "t_index", "window_time", "row0", "col0"))


@query("t04_tile_counts", "SELECT sample_id, n_active_px, n_target_px FROM v_index")
def t04(s: Study) -> DataFrame:
    tiles = s.index.select("sample_id", "fire_id", "t_index", "row0", "col0")
    return (tiles.join(T.tile_counts(tiles, s.burn, s.first, s.cfg), ["fire_id", "t_index", "row0", "col0"])
            .select("sample_id", "n_active_px", "n_target_px"))


@query("t05_tile_clipped", "SELECT sample_id, tile_clipped FROM v_index")
def t05(s: Study) -> DataFrame:
    return s.index.select("sample_id", "tile_clipped")


@query("t06_tile_metres", "SELECT sample_id, x0_m, y1_m FROM v_index")
def t06(s: Study) -> DataFrame:
    return s.index.select("sample_id", "x0_m", "y1_m")


@query("t07_index_report", """
SELECT fire_id, count(*) AS samples, count(DISTINCT t_index) AS timesteps, count(*) FILTER (tile_clipped) AS clipped,
       round(count(*) / count(DISTINCT t_index), 6) AS tiles_per_step FROM v_index GROUP BY fire_id""")
def t07(s: Study) -> DataFrame:
    return T.index_report(s.index).withColumn("tiles_per_step", r("tiles_per_step", 6))


@query("t08_densest_sequence", """
SELECT fire_id, t_index, row0, col0, sample_id FROM (
  SELECT i.*, row_number() OVER (PARTITION BY i.fire_id ORDER BY t_index) AS k FROM v_index i JOIN (
    SELECT *, row_number() OVER (PARTITION BY fire_id ORDER BY n DESC, row0, col0) AS best
    FROM (SELECT fire_id, row0, col0, count(*) AS n FROM v_index GROUP BY ALL)) b USING (fire_id, row0, col0) WHERE b.best = 1) WHERE k <= 8""")
def t08(s: Study) -> DataFrame:
    return T.densest_sequence(s.index)


@query("l18_burn_steps_cumulative", f"""
SELECT i.sample_id, k.step, count(*) AS n, sum((b.row - i.row0) * {P} + b.col - i.col0) AS place_sum
FROM v_index i, (VALUES (0), (1), (2)) k(step), v_first b
WHERE b.fire_id = i.fire_id AND b.first_t <= i.t_index - (2 - k.step)
  AND b.row BETWEEN i.row0 AND i.row0 + {P - 1} AND b.col BETWEEN i.col0 AND i.col0 + {P - 1} GROUP BY ALL""")
def l18a(s: Study) -> DataFrame:
    return step_sums(s, L.burn_steps(s.index, s.first, s.cfg))


@query("l18_burn_steps_incremental", f"""
SELECT i.sample_id, k.step, count(*) AS n, sum((b.row - i.row0) * {P} + b.col - i.col0) AS place_sum
FROM v_index i, (VALUES (0), (1), (2)) k(step), v_burn b
WHERE b.fire_id = i.fire_id AND b.t_index = i.t_index - (2 - k.step)
  AND b.row BETWEEN i.row0 AND i.row0 + {P - 1} AND b.col BETWEEN i.col0 AND i.col0 + {P - 1} GROUP BY ALL""")
def l18b(s: Study) -> DataFrame:
    rows = L.burn_step_rows(s.index, s.burn, s.cfg)
    n = F.bit_count("bits").cast("long")
    place = (F.col("r") * s.cfg.patch + F.col("c0")) * n + C.bit_places(F.col("bits"))
    return rows.groupBy("sample_id", "step").agg(F.sum(n).alias("n"), F.sum(place).alias("place_sum"))


def step_sums(s: Study, cells: DataFrame) -> DataFrame:
    return cells.groupBy("sample_id", "step").agg(
        F.count("*").alias("n"), F.sum(F.col("r") * s.cfg.patch + F.col("c")).alias("place_sum"))


@query("v06_persistence", f"SELECT *, {SKILL} FROM (SELECT sample_id, tp, fp, fn FROM v_base WHERE baseline = 'persistence')")
def v06(s: Study) -> DataFrame:
    counts = B.baseline_counts(s.index, s.first, s.cfg, ())
    return counts.select("sample_id", "tp", "fp", "fn", *rounded_skill())


@query("v07_ring_baseline", f"""
SELECT *, {SKILL} FROM (
  SELECT fire_id, baseline, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn
  FROM v_base JOIN v_index USING (sample_id) WHERE baseline <> 'persistence' GROUP BY ALL)""")
def v07(s: Study) -> DataFrame:
    counts = B.baseline_counts(s.index, s.first, s.cfg).filter("baseline <> 'persistence'")
    return B.pooled(counts, "fire_id", "baseline").select("fire_id", "baseline", "tp", "fp", "fn", *rounded_skill())


@query("v08_all_positive", f"""
SELECT *, {SKILL} FROM (SELECT fire_id, CAST(sum(n_target_px) AS BIGINT) AS tp,
  CAST(sum({P * P} - n_target_px) AS BIGINT) AS fp, 0::BIGINT AS fn FROM v_index GROUP BY fire_id)""")
def v08(s: Study) -> DataFrame:
    return B.pooled(B.all_positive_counts(s.index, s.cfg), "fire_id").select("fire_id", "tp", "fp", "fn", *rounded_skill())
