"""Tiles over the active area and the sample index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perimeter.config import Settings
from perimeter.operators.labels import cells_in_tiles, targets


def tile_origins(low: Column, high: Column, size: Column, patch: int, stride: int) -> Column:
    """Sorted tile origins along one axis covering [low, high], clamped inside [0, size - patch]."""
    last = size - patch

    def clamp(c: Column) -> Column:
        return F.greatest(F.lit(0), F.least(c, last))
    centred = F.array(clamp(F.floor((low + high) / 2).cast("int") - patch // 2))
    regular = F.sequence(clamp(low), F.greatest(clamp(low), F.least(high, last)), F.lit(stride))
    tail = clamp(high - patch + 1)
    covering = F.when(F.element_at(regular, -1) < tail, F.concat(regular, F.array(tail))).otherwise(regular)
    return (F.when(size <= patch, F.array(F.lit(0)))
            .when(high - low + 1 <= patch, centred).otherwise(covering))


def active_bbox(burn: DataFrame) -> DataFrame:
    return (burn.groupBy("fire_id", "t_index")
            .agg(F.min("row").alias("r_min"), F.max("row").alias("r_max"),
                 F.min("col").alias("c_min"), F.max("col").alias("c_max")))


def sampled_windows(windows: DataFrame, first: DataFrame, cfg: Settings) -> DataFrame:
    """(fire_id, t_index, window_time) with enough history, usable at t and t+1 and a target."""
    order = Window.partitionBy("fire_id").orderBy("t_index")
    ready = (windows.withColumn("_next", F.lead("usable").over(order))
             .filter(F.col("usable") & F.col("_next") & (F.col("t_index") >= cfg.t_steps - 1))
             .select("fire_id", "t_index", "window_time"))
    return ready.join(targets(first).select("fire_id", "t_index").distinct(), ["fire_id", "t_index"], "left_semi")


def candidate_tiles(windows: DataFrame, burn: DataFrame, first: DataFrame, grid: DataFrame, cfg: Settings) -> DataFrame:
    rows = tile_origins(F.col("r_min"), F.col("r_max"), F.col("height"), cfg.patch, cfg.stride)
    cols = tile_origins(F.col("c_min"), F.col("c_max"), F.col("width"), cfg.patch, cfg.stride)
    return (sampled_windows(windows, first, cfg).join(active_bbox(burn), ["fire_id", "t_index"]).join(grid, "fire_id")
            .withColumn("row0", F.explode(rows)).withColumn("col0", F.explode(cols))
            .select("fire_id", "t_index", "window_time", "row0", "col0",
                    (F.col("x0") + F.col("col0") * cfg.resolution_m).cast("double").alias("x0_m"),
                    (F.col("y1") - F.col("row0") * cfg.resolution_m).cast("double").alias("y1_m")))


def tile_counts(tiles: DataFrame, burn: DataFrame, first: DataFrame, cfg: Settings) -> DataFrame:
    """n_active_px, n_target_px and tile_clipped per tile; tiles with neither kind of cell vanish."""
    p = cfg.patch
    marked = (burn.select("fire_id", "t_index", "row", "col", F.lit(False).alias("is_target"))
              .unionByName(targets(first).withColumn("is_target", F.lit(True))))
    keyed = tiles.select("fire_id", "t_index", "row0", "col0")
    placed = cells_in_tiles(keyed, marked, p, ("fire_id", "t_index"))
    r, c = F.col("row") - F.col("row0"), F.col("col") - F.col("col0")
    edge = F.col("is_target") & (r.isin(0, p - 1) | c.isin(0, p - 1))
    return (placed.groupBy("fire_id", "t_index", "row0", "col0")
            .agg(F.sum((~F.col("is_target")).cast("int")).alias("n_active_px"),
                 F.sum(F.col("is_target").cast("int")).alias("n_target_px"), F.max(edge).alias("tile_clipped")))


def sample_key() -> Column:
    return F.format_string("%s:%d:%d:%d", "fire_id", "t_index", "row0", "col0")


def build_index(windows: DataFrame, burn: DataFrame, first: DataFrame, grid: DataFrame, cfg: Settings,
                with_static: DataFrame | None = None) -> DataFrame:
    """The sample index; fires without static cells are skipped when `with_static` is given."""
    if with_static is not None:
        grid = grid.join(with_static.select("fire_id").distinct(), "fire_id", "left_semi")
    tiles = candidate_tiles(windows, burn, first, grid, cfg)
    return (tiles.join(tile_counts(tiles, burn, first, cfg), ["fire_id", "t_index", "row0", "col0"])
            .withColumn("sample_id", sample_key()))


def index_report(index: DataFrame) -> DataFrame:
    return (index.groupBy("fire_id").agg(
        F.count("*").alias("samples"), F.count_distinct("t_index").alias("timesteps"),
        F.sum(F.col("tile_clipped").cast("int")).alias("clipped"))
        .withColumn("tiles_per_step", F.col("samples") / F.col("timesteps")))


def densest_sequence(index: DataFrame, n: int = 8) -> DataFrame:
    """The first n windows, in order, of each fire's tile with most samples."""
    place = F.struct("row0", "col0")
    tiles = index.groupBy("fire_id", "row0", "col0").agg(F.count("*").alias("n"))
    best = tiles.groupBy("fire_id").agg(F.max_by(place, F.struct("n", -F.col("row0"), -F.col("col0"))).alias("_b"))
    chosen = best.select("fire_id", F.col("_b.row0").alias("row0"), F.col("_b.col0").alias("col0"))
    order = Window.partitionBy("fire_id").orderBy("t_index")
    return (index.join(chosen, ["fire_id", "row0", "col0"]).withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= n).select("fire_id", "t_index", "row0", "col0", "sample_id"))


def attrition(events: DataFrame, static: DataFrame, index: DataFrame, pruned: DataFrame) -> DataFrame:
    """Fires left after each stage."""
    stages = (("kept", events.filter("keep")), ("static", static), ("sampled", index), ("weather", pruned))
    parts = [df.agg(F.count_distinct("fire_id").alias("fires")).select(F.lit(n).alias("stage"), "fires")
             for n, df in stages]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
