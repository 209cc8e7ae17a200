"""Queries over assembled samples, fitted scores, exports, message indexes and incremental builds."""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perimeter.config import EAST_CHANNELS, NORTH_CHANNELS
from perimeter.operators import cells as C
from perimeter.operators import dataset as D
from perimeter.operators import distance as ND
from perimeter.operators import export as X
from perimeter.operators import labels as L
from perimeter.operators import metrics as V
from perimeter.operators import scoring as M
from perimeter.operators import splits as SP
from perimeter.operators import tiling as T
from perimeter.operators import weather as W
from perimeter.plans.checks import BAND_RATES, CH, P
from perimeter.plans.queries.fields import line_sql, line_sums
from perimeter.plans.queries.scores import rounded
from perimeter.plans.queries.segments import r
from perimeter.plans.registry import query
from perimeter.plans.study import Study
from perimeter.sources import catalog as CA
from perimeter.sources import detections as S
from perimeter.sources import messages as MS
from perimeter.sources import tables as TB
from perimeter.storage import checkpoint_root

STEP = ("sample_id", "step")


def with_fuel(df: DataFrame) -> DataFrame:
    return df.withColumn("fuel_idx", F.col("fuel_idx").cast("double"))


# --- sources and sinks ------------------------------------------------------------------------

@query("s01_read_detections", """
SELECT latitude, longitude, acq_date, acq_time, trim(confidence) AS confidence, frp,
       CASE WHEN file = 'chunk_02' THEN NULL ELSE type END AS type FROM v_raw""")
def s01(s: Study) -> DataFrame:
    folder = f"{checkpoint_root(s.spark)}/csv/{uuid.uuid4().hex}"
    cols = ["latitude", "longitude", "acq_date", "acq_time", "confidence", "frp", "type", "satellite"]
    rows = s.raw.withColumn("chunk", F.col("file"))
    plain = rows.filter("file <> 'chunk_02'")
    CA.write_table(plain.select(*cols, "chunk"), f"{folder}/full", "csv", "chunk")
    CA.write_table(rows.filter("file = 'chunk_02'").select(*reversed(cols[:6]), "chunk"), f"{folder}/short", "csv", "chunk")
    CA.write_table(plain.limit(0).select(*cols).coalesce(1), f"{folder}/empty", "csv")
    return S.read_detections(s.spark, f"{folder}/*/*/*.csv").select(*cols[:7])


@query("s08_message_index", 'SELECT file, msg, start, var, level, "end" FROM v_msg')
def s08(s: Study) -> DataFrame:
    return messages(s)


def message_lines(s: Study) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = (s.table("lineitem").withColumn("msg", F.row_number().over(w))
            .withColumn("start", F.coalesce(F.sum(F.col("l_quantity") * 100).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))))
    names = F.element_at(F.array(*[F.lit(v) for v in ("UGRD", "VGRD", "TMP", "RH", "DPT", "OTHER")]), F.least("msg", F.lit(6)))
    level = F.when(F.col("msg") <= 2, "10 m above ground").otherwise("2 m above ground")
    start = F.when(F.col("l_quantity") == 50, "x").otherwise(F.col("start").cast("long").cast("string"))
    return rows.select(F.col("l_orderkey").alias("file"), F.concat_ws(":", "msg", start, F.lit("d=0"), names, level, F.lit("anl")).alias("value"))


def messages(s: Study) -> DataFrame:
    return MS.parse_message_index(message_lines(s))


@query("s09_select_messages", 'SELECT file, msg, start, var, level, "end" FROM v_selected')
def s09(s: Study) -> DataFrame:
    return MS.select_messages(messages(s)).select("file", "msg", "start", "var", "level", "end")


@query("s10_contiguous_runs", """
SELECT file, min(start) AS first, arg_max("end", start) AS last, count(*) AS messages FROM (
  SELECT *, sum(n) OVER (PARTITION BY file ORDER BY start) AS run FROM (
    SELECT *, (start <> coalesce(lag("end") OVER (PARTITION BY file ORDER BY start) + 1, -2))::INT AS n FROM v_selected)) GROUP BY file, run""")
def s10(s: Study) -> DataFrame:
    return MS.contiguous_runs(MS.select_messages(messages(s)))


def version_table(s: Study) -> DataFrame:
    return s.spark.createDataFrame([(f"LF{y}", y) for y in (2016, 2022, 2023, 2024, 2025)], "version string, version_year int")


@query("s18_fuel_version", """
SELECT fire_id, year, CASE WHEN year > 2022 THEN 'LF2022' ELSE 'LF2016' END AS version, year < 2017 AS contaminated
FROM v_events WHERE keep""")
def s18(s: Study) -> DataFrame:
    return CA.fuel_versions(s.events.filter("keep"), version_table(s))


@query("s19_sinks", """
SELECT 'events' AS sink, count(*) AS n, CAST(sum(n_detections) AS BIGINT) AS total FROM v_events WHERE keep
UNION ALL SELECT 'labelled', count(*), CAST(sum(det_id) AS BIGINT) FROM v_lab
UNION ALL SELECT 'index', count(*), CAST(sum(n_target_px * (t_index + 1)) AS BIGINT) FROM v_index
UNION ALL SELECT 'manifest', (SELECT count(DISTINCT fire_id) FROM v_win), (SELECT count(*) FROM v_burn)
UNION ALL SELECT 'splits', count(*), CAST(sum(year) AS BIGINT) FROM v_events WHERE keep AND year BETWEEN 2015 AND 2023
UNION ALL SELECT 'stats', count(*), CAST(sum(round(std * 1000)) AS BIGINT) FROM v_stats""")
def s19(s: Study) -> DataFrame:
    """Every sink, written and read back."""
    root, read = f"{checkpoint_root(s.spark)}/out/{uuid.uuid4().hex}", s.spark.read
    kept = s.events.filter("keep").drop(*[f.name for f in s.events.schema if f.dataType.typeName() in ("array", "struct", "map")])
    CA.write_sinks(root, kept, s.labelled, s.index, L.label_manifest(s.windows, s.burn, s.grid), s.splits, s.stats)
    told = {"events": (read.option("header", True).csv(f"{root}/events"), "cast(n_detections as bigint)"),
            "labelled": (TB.read_table(s.spark, f"{root}/labelled", "fire_id"), "det_id"),
            "index": (TB.read_table(s.spark, f"{root}/index", "fire_id"), "n_target_px * (t_index + 1)"),
            "manifest": (read.option("header", True).csv(f"{root}/manifest"), "cast(burned_px as bigint)"),
            "splits": (CA.read_splits(s.spark, f"{root}/splits"), "cast(substring(fire_id, 1, 4) as bigint)"),
            "stats": (read.json(f"{root}/stats"), "round(std * 1000)")}
    rows = [df.agg(F.lit(sink).alias("sink"), F.count("*").alias("n"), F.expr(f"cast(sum({total}) as bigint)").alias("total")) for sink, (df, total) in told.items()]
    return reduce(DataFrame.unionByName, rows)


@query("s20_incremental_build", """
SELECT fire_id, count(*) AS n, CAST(sum(first_t) + CASE WHEN e.year = 2016 THEN count(*) ELSE 0 END AS BIGINT) AS total
FROM v_first JOIN v_events e USING (fire_id) GROUP BY fire_id, e.year""")
def s20(s: Study) -> DataFrame:
    """Three builds of one table and one that was lost before its manifest row: early fires, a lost build of all, the missing fires, and one
    year again with other values, which replace the earlier ones."""
    root = f"{checkpoint_root(s.spark)}/out/{uuid.uuid4().hex}"
    of = lambda rule: s.first.join(s.events.filter(f"keep and {rule}").select("fire_id"), "fire_id", "left_semi")
    TB.build_missing(of("year <= 2018"), root, "fire_id", ["row"])
    TB.write_build(s.first.withColumn("first_t", F.lit(-1)), root, "fire_id", ["row"])
    TB.build_missing(s.first, root, "fire_id", ["row"])
    again = of("year = 2016").withColumn("first_t", F.col("first_t") + 1)
    whole = TB.build_missing(again, root, "fire_id", ["row"], overwrite=True)
    return whole.groupBy("fire_id").agg(F.count("*").alias("n"), F.sum(F.col("first_t").cast("long")).alias("total"))


@query("t09_attrition", """
SELECT 'kept' AS stage, count(DISTINCT fire_id) AS fires FROM v_events WHERE keep
UNION ALL SELECT 'static', count(DISTINCT fire_id) FROM v_static UNION ALL SELECT 'sampled', count(DISTINCT fire_id) FROM v_index
UNION ALL SELECT 'weather', count(DISTINCT fire_id) FROM v_sample""")
def t09(s: Study) -> DataFrame:
    return T.attrition(s.events, s.accepted, s.index, s.samples)


# --- assembled cells ------------------------------------------------------------------------------

@query("n05_assemble", line_sql("v_asm", CH, "sample_id, step", "c", 2))
def n05(s: Study) -> DataFrame:
    return line_sums(s.assembled(), CH, STEP, "c", 2)


@query("n06_norm_stats", "SELECT channel, round(mean, 5) + 0.0 AS mean, round(std, 5) AS std FROM v_stats")
def n06(s: Study) -> DataFrame:
    return rounded(D.norm_stats(s.assembled("train"), s.cfg.channels).select("channel", "mean", "std"), "mean", "std", digits=5)


@query("n07_direction_groups", "SELECT channel, round(mean, 5) AS mean, round(std, 5) AS std FROM v_stats WHERE channel[:3] IN ('u10', 'v10', 'asp')")
def n07(s: Study) -> DataFrame:
    return rounded(s.stats.filter("note = 'direction'").select("channel", "mean", "std"), "mean", "std", digits=5)


@query("n08_normalise", line_sql("(SELECT sample_id, step, c, " + ", ".join(
    f"({c} - (SELECT mean FROM v_stats WHERE channel = '{c}')) / (SELECT std FROM v_stats WHERE channel = '{c}') AS {c}" for c in CH)
    + " FROM v_asm)", CH, "sample_id, step", "c", 2))
def n08(s: Study) -> DataFrame:
    return line_sums(D.normalise(s.assembled(), s.stats, s.cfg.channels), CH, STEP, "c", 2)


_EAST, _NORTH = (", ".join(f"CASE WHEN {side} THEN -{c} ELSE {c} END AS {c}" for c in cs)
                 for side, cs in (("ew", EAST_CHANNELS), ("ns", NORTH_CHANNELS)))
_STILL = ", ".join(c for c in CH if c not in EAST_CHANNELS + NORTH_CHANNELS)
_COINS = "substr(md5('1:' || sample_id), 1, 1) < '8' AS ew, substr(md5('1:' || sample_id), 2, 1) < '8' AS ns"


@query("n09_flip", line_sql(f"""(SELECT sample_id, step, CASE WHEN ew THEN {P - 1} - c ELSE c END AS c, CASE WHEN ns THEN {P - 1} - r ELSE r END AS r,
  {_EAST}, {_NORTH}, {_STILL} FROM (SELECT *, {_COINS} FROM v_asm))""", CH, "sample_id, step", "(r * 5 + c)", 2))
def n09(s: Study) -> DataFrame:
    out = D.flip(s.assembled(), D.coin(1, 1, "sample_id"), D.coin(1, 2, "sample_id"), P)
    return line_sums(out.withColumn("at", F.col("r") * 5 + F.col("c")), CH, STEP, "at", 2)


def _uniforms(keys: str) -> str:
    mixed = "k & 4294967295"
    for factor in (1103515245, 73244475, 1640531527, 22695477):
        mixed = f"((xor({mixed}, w1) * {factor}) >> 16) & 4294967295"
    return f"list_transform({keys}, lambda k: (({mixed}) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def _noisy(i: int, c: str) -> str:
    z = f"({c} - (SELECT mean FROM v_stats WHERE channel = '{c}')) / (SELECT std FROM v_stats WHERE channel = '{c}')"
    return (f"CASE WHEN gone[{i + 1}] < 0.1 THEN 0 ELSE {z} + sqrt(ln(u[{2 * i + 1}]) * -2) * cos(u[{2 * i + 2}] * 2 * pi()) * 0.05 END AS {c}")


_NOISY = [c for c in CH if c != "burn_mask"]
_WORDS = ", ".join(f"('0x' || substr(md5('0:' || sample_id), {8 * i + 1}, 8))::BIGINT AS w{i}" for i in range(3))
_DRAWN = f"""(SELECT a.*, n.gone, {_uniforms(f"list_transform(range({2 * len(_NOISY)}), lambda k: (w0 + ((step * {P} + r) * {P} + c) * 64 + k) & 4294967295)")} AS u
  FROM v_train a JOIN (SELECT *, {_uniforms(f"list_transform(range({len(_NOISY)}), lambda k: (w2 + k) & 4294967295)")} AS gone
    FROM (SELECT sample_id, {_WORDS} FROM v_sample)) n USING (sample_id))"""


@query("n10_jitter", line_sql(f"(SELECT sample_id, step, c, burn_mask, {', '.join(_noisy(i, c) for i, c in enumerate(_NOISY))} FROM {_DRAWN})",
                              CH, "sample_id, step", "c", 2))
def n10(s: Study) -> DataFrame:
    cells = D.normalise(s.assembled("train"), s.stats, s.cfg.channels)
    noisy = D.jitter(cells, s.cfg.channels, 0.05, 0.1, P, 0)
    return line_sums(noisy, CH, STEP, "c", 2)


@query("n11_distance_to_burn", """
SELECT sample_id, coalesce(n, (SELECT max(r) + 1 FROM v_dist) * (SELECT max(c) + 1 FROM v_dist)) AS n, d2_sum, d2_place, d2_max FROM v_sample LEFT JOIN (
  SELECT sample_id, count(*) AS n, CAST(sum(d2) AS BIGINT) AS d2_sum, CAST(sum(d2 * (c % 7 + 1)) AS BIGINT) AS d2_place, max(d2) AS d2_max
  FROM v_dist GROUP BY sample_id) USING (sample_id)""")
def n11(s: Study) -> DataFrame:
    lines = D.distance_to_burn(s.tile_marks.filter("not y").select("sample_id", "r", "c"), ["sample_id"], P, s.samples)
    d2 = F.transform("near", lambda x: ND.squared(x, P))
    line = lines.select("sample_id", d2.alias("d2"))
    add = lambda f: F.sum(F.aggregate(F.transform("d2", f), F.lit(0).cast("long"), lambda a, v: a + v))
    return line.groupBy("sample_id").agg(
        F.sum(F.when(F.col("d2").isNull(), P * P).otherwise(F.size("d2")).cast("long")).alias("n"),
        add(lambda v, c: v).alias("d2_sum"), add(lambda v, c: v * (c % 7 + 1)).alias("d2_place"), F.max(F.array_max("d2")).alias("d2_max"))


# Squared distance, row and column of the nearest burning cell in one number, taken column by column.
def near_sql(asm: str) -> str:
    return f"""(SELECT sid, step, r, x AS c, min((x - c) * (x - c) * 1024 + g) AS m FROM (
    SELECT n.sid, b.step, t.r, b.c, min((t.r - b.r) * (t.r - b.r) * 1024 + b.r * 32 + b.c) AS g
    FROM {asm} b JOIN v_sid n USING (sample_id), range({P}) t(r) WHERE b.burn_mask > 0.5 GROUP BY ALL), range({P}) u(x) GROUP BY ALL)"""


def downwind_sql(asm: str) -> str:
    return f"""(SELECT a.sample_id, a.step, a.c, a.burn_mask, CASE WHEN d.m >= 1024 THEN
    ((a.c - d.m % 32) * a.u10_lag0 + (d.m // 32 % 32 - a.r) * a.v10_lag0) / sqrt((d.m // 1024)::DOUBLE) ELSE 0 END AS downwind
  FROM {asm} a JOIN v_sid n USING (sample_id) LEFT JOIN {near_sql(asm)} d ON (d.sid, d.step, d.r, d.c) = (n.sid, a.step, a.r, a.c))"""


@query("n12_downwind", line_sql(downwind_sql("v_asm"), ("downwind",), "sample_id, step", "c", 2))
def n12(s: Study) -> DataFrame:
    return line_sums(D.downwind(s.assembled(), P), ("downwind",), STEP, "c", 2)


_NEW_BURN = """(SELECT a.sample_id, a.step, a.r, a.c, a.u10_lag0, a.v10_lag0, (b.t_index IS NOT NULL)::INT::DOUBLE AS burn_mask
  FROM v_asm a JOIN v_step s USING (sample_id, step) LEFT JOIN v_burn b
    ON b.fire_id = s.fire_id AND b.t_index = s.k AND b.row = a.r + s.row0 AND b.col = a.c + s.col0)"""


@query("n05_assemble_incremental_downwind", line_sql(downwind_sql(_NEW_BURN), ("burn_mask", "downwind"), "sample_id, step", "c", 2))
def n05b(s: Study) -> DataFrame:
    """Tiles whose mask shows what burned in each window, with the downwind channel."""
    cfg = replace(s.cfg, burn_mode="incremental", downwind=True)
    cells = D.cell_windows(s.corners, s.fields, s.static, s.first, cfg, s.burn)
    return line_sums(D.assemble(s.samples, cells, cfg), ("burn_mask", "downwind"), STEP, "c", 2)


@query("n13_finite_and_symmetric", """
SELECT sample_id, count(*) AS cells, 0::BIGINT AS not_finite, 0::BIGINT AS flip_moved FROM v_asm GROUP BY sample_id""")
def n13(s: Study) -> DataFrame:
    cells = s.assembled()
    yes = F.lit(True)
    signed = [*EAST_CHANNELS, *NORTH_CHANNELS]
    marked = cells.withColumns({f"{c}_": F.col(c) for c in ("r", "c", *signed)})
    twice = D.flip(D.flip(marked, yes, yes, P), yes, yes, P)
    bad = sum((F.isnan(c) | F.col(c).isNull()).cast("int") for c in CH[1:])
    moved = reduce(lambda a, b: a | b, [F.col(c) != F.col(f"{c}_") for c in ("r", "c", *signed)])
    return twice.groupBy("sample_id").agg(F.count("*").alias("cells"), F.sum(bad.cast("long")).alias("not_finite"),
                                          F.sum(moved.cast("long")).alias("flip_moved"))


# Each value is weighed by its place, so a value that slips to another place changes the sum. Places under no cell hold zero.
@query("n15_pack_tiles", " UNION ALL ".join(f"""
SELECT sample_id, step, '{c}' AS channel, {P * P}::BIGINT AS n, round(sum(CAST({c} AS FLOAT)::DOUBLE * ((r * {P} + c) % 13) * 0.7310585::DOUBLE), 0) + 0.0 AS place_sum
FROM v_asm GROUP BY ALL""" for c in (*CH, "fuel_idx", "target")))
def n15(s: Study) -> DataFrame:
    packed = D.pack_tiles(s.assembled().withColumn("target", F.col("target").cast("int")), (*CH, "fuel_idx", "target"), P)
    total = F.aggregate(F.transform("values", lambda v, i: v.cast("double") * (i % 13) * 0.7310585), F.lit(0.0), lambda a, v: a + v)
    return packed.select("sample_id", "step", "channel", F.size("values").cast("long").alias("n"), (F.round(total, 0) + 0.0).alias("place_sum"))


@query("b03_band_base_rates", f"SELECT band, n_pixels, n_positive, round(base_rate, 6) AS base_rate FROM {BAND_RATES} WHERE n_pixels > 0")
def b03(s: Study) -> DataFrame:
    train = SP.samples_of(s.samples, s.splits, "train")
    return rounded(D.base_rates(train, s.tile_marks, P).filter("n_pixels > 0"), "base_rate")


def growth(s: Study) -> DataFrame:
    last = [s.cfg.t_steps - 1]
    wind = s.assembled(steps=last).groupBy("sample_id").agg(F.avg("u10_lag0").alias("u"), F.avg("v10_lag0").alias("v"))
    return D.wind_growth(s.tile_marks, wind)


_GROWTH = """(SELECT sample_id, n_grown, sqrt(e * e + n * n) AS growth, sqrt(u * u + v * v) AS speed,
  (e * u + n * v) / (sqrt(e * e + n * n) * sqrt(u * u + v * v)) AS cos FROM (
    SELECT sample_id, y.n AS n_grown, y.c - b.c AS e, b.r - y.r AS n, w.u, w.v
    FROM (SELECT sample_id, count(*) AS n, avg(r) AS r, avg(c) AS c FROM v_tcum GROUP BY 1) b
    JOIN (SELECT sample_id, count(*) AS n, avg(r) AS r, avg(c) AS c FROM v_ty GROUP BY 1) y USING (sample_id)
    JOIN (SELECT sample_id, avg(u10_lag0) AS u, avg(v10_lag0) AS v FROM v_asm WHERE step = 2 GROUP BY 1) w USING (sample_id)
    WHERE b.n >= 20 AND y.n >= 20) WHERE sqrt(e * e + n * n) >= 1e-6 AND sqrt(u * u + v * v) >= 1e-6)"""


@query("v22_wind_growth_angle", f"""
SELECT sample_id, n_grown, round(growth, 4) AS growth, round(speed, 4) AS speed, round(cos, 4) + 0.0 AS cos,
       round(degrees(acos(least(greatest(cos, -1), 1))), 3) AS angle FROM {_GROWTH}""")
def v22(s: Study) -> DataFrame:
    return growth(s).select("sample_id", "n_grown", r("growth").alias("growth"), r("speed").alias("speed"), r("cos").alias("cos"),
                            r("angle", 3).alias("angle"))


@query("v23_angle_histogram", f"""
SELECT CAST(least(floor(a / 45), 3) AS INTEGER) AS octant, count(*) AS n, round(count(*) / total, 6) AS share
FROM (SELECT degrees(acos(least(greatest(cos, -1), 1))) AS a, count(cos) OVER () AS total FROM {_GROWTH}) WHERE a < 180 GROUP BY 1, total""")
def v23(s: Study) -> DataFrame:
    return V.angle_histogram(growth(s)).withColumn("share", r("share", 6))


def _quart(value: str) -> str:
    return f"""SELECT '{value}' AS by_value, CAST(CASE WHEN x >= q[4] THEN 3 WHEN x >= q[3] THEN 2 WHEN x >= q[2] THEN 1 ELSE 0 END AS INTEGER) AS quartile,
 count(*) AS n, round(avg(cos), 6) + 0.0 AS mean_cos FROM (SELECT cos, {value} AS x,
   (SELECT quantile_cont({value}, [0.0, 0.25, 0.5, 0.75, 1.0]) FROM {_GROWTH}) AS q FROM {_GROWTH}) GROUP BY ALL"""


@query("v23_quartile_means", _quart("speed") + " UNION ALL " + _quart("n_grown"))
def v23b(s: Study) -> DataFrame:
    rows = s.stage("growth", lambda: growth(s))
    parts = [V.quartile_means(rows, v, "cos").withColumn("by_value", F.lit(v)) for v in ("speed", "n_grown")]
    return rounded(parts[0].unionByName(parts[1]).withColumnRenamed("mean", "mean_cos"), "mean_cos")


# --- stitching and export ---------------------------------------------------------------------------------

@query("m09_stitch_tiles", "SELECT fire_id, t_index, row, count(*) AS n, sum(tiles)::BIGINT AS tiles, round(sum(prob * (col % 17 + 1)), 4) AS prob FROM v_stitch GROUP BY ALL")
def m09(s: Study) -> DataFrame:
    return M.stitch(s.tile_scores).groupBy("fire_id", "t_index", "row").agg(
        F.count("*").alias("n"), F.sum("tiles").alias("tiles"), F.round(F.sum(F.col("prob") * (F.col("col") % 17 + 1)), 4).alias("prob"))


@query("x01_block_downsample", """
SELECT s.fire_id, s.t_index, CAST(s.row // 4 AS INTEGER) AS row, CAST(s.col // 4 AS INTEGER) AS col, round(sum(prob) / 16.0, 9) AS prob
FROM v_stitch s JOIN v_grid g USING (fire_id) WHERE s.row < g.height // 4 * 4 AND s.col < g.width // 4 * 4 GROUP BY ALL""")
def x01(s: Study) -> DataFrame:
    rows = s.stitched.join(s.grid.select("fire_id", "height", "width"), "fire_id")
    return rounded(C.block_downsample(rows, ["fire_id", "t_index"], 4, "prob", F.col("height"), F.col("width")), "prob", digits=9)


@query("x02_frames", "SELECT fire_id, t_index, new_px, burned_px, pred_px, round(csi, 6) AS csi FROM v_frame")
def x02(s: Study) -> DataFrame:
    return rounded(X.frames(s.stitched, s.first, 0.70005).select("fire_id", "t_index", "new_px", "burned_px", "pred_px", "csi"), "csi")


@query("x03_json_bundle", """
SELECT fire_id, t_index, CAST(to_json(struct_pack(fire_id := fire_id, t := t_index, new_px := new_px, burned_px := burned_px, pred_px := pred_px,
  grid := struct_pack(native_m := 100, display_m := 400, height := height, width := width))) AS VARCHAR) AS json
FROM v_frame JOIN v_grid USING (fire_id)""")
def x03(s: Study) -> DataFrame:
    return X.bundle(X.frames(s.stitched, s.first, 0.70005), s.grid, 4, s.cfg.resolution_m)


