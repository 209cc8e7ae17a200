"""Gridded frames for display."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perimeter.functions.bins import csi


def frames(stitched: DataFrame, first: DataFrame, threshold: float) -> DataFrame:
    """Per fire and scored window: target (new), burned and predicted cells and CSI, all at full resolution."""
    shown = stitched.select("fire_id", "t_index").distinct()
    cell = ["fire_id", "t_index", "row", "col"]
    target = first.filter("first_t > 0").select("fire_id", (F.col("first_t") - 1).alias("t_index"), "row", "col", F.lit(True).alias("y"))
    both = (stitched.select(*cell, (F.col("prob") > threshold).alias("p")).join(target, cell, "full")
            .join(shown, ["fire_id", "t_index"], "left_semi"))
    p, y = F.coalesce("p", F.lit(False)), F.coalesce("y", F.lit(False))
    scores = both.groupBy("fire_id", "t_index").agg(
        F.sum(y.cast("int")).alias("new_px"), F.sum(p.cast("int")).alias("pred_px"), F.sum((p & y).cast("int")).alias("tp"), F.sum((p & ~y).cast("int")).alias("fp"),
        F.sum((~p & y).cast("int")).alias("fn"))
    gained = first.groupBy("fire_id", F.col("first_t").alias("t_index")).agg(F.count("*").alias("_g"))
    windows = gained.select("fire_id", "t_index").unionByName(shown).distinct()
    running = Window.partitionBy("fire_id").orderBy("t_index").rowsBetween(Window.unboundedPreceding, 0)
    burned = (windows.join(gained, ["fire_id", "t_index"], "left")
              .withColumn("burned_px", F.sum(F.coalesce("_g", F.lit(0))).over(running)).drop("_g"))
    return (scores.join(burned, ["fire_id", "t_index"])
            .withColumn("csi", csi(F.col("tp"), F.col("fp"), F.col("fn"))).drop("tp", "fp", "fn"))


def bundle(frame_rows: DataFrame, grid: DataFrame, factor: int, res: int) -> DataFrame:
    """One JSON document per fire and window, display and native resolution kept apart. Documents
    stay per window, so a long or large fire never becomes one row."""
    doc = F.struct("fire_id", F.col("t_index").cast("int").alias("t"), F.col("new_px").cast("long").alias("new_px"),
                   F.col("burned_px").cast("long").alias("burned_px"), F.col("pred_px").cast("long").alias("pred_px"),
                   F.struct(F.lit(res).alias("native_m"), F.lit(res * factor).alias("display_m"), "height", "width").alias("grid"))
    return (frame_rows.join(grid.select("fire_id", "height", "width"), "fire_id")
            .select("fire_id", "t_index", F.to_json(doc).alias("json")))
