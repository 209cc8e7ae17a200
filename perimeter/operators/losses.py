"""Class weights and loss aggregates over scored cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perimeter.config import BAND_EDGES

N_BANDS = len(BAND_EDGES) + 1


def band_weight(base_rate: Column, n_pixels: Column, cap: float, floor: float = 1.0) -> Column:
    """(1-p)/p clipped to [floor, cap]; an empty band weighs 1, a band without positives the cap."""
    p = base_rate
    return (F.when(n_pixels == 0, 1.0).when(p <= 0, float(cap))
            .otherwise(F.least(F.greatest((1 - p) / F.when(p > 0, p), F.lit(float(floor))), F.lit(float(cap)))))


def band_weights(stats: DataFrame, cap: float) -> DataFrame:
    """Weights from (band, base_rate, n_pixels, n_positive), checked to hold every band once and
    to come from the training split where a split is named."""
    bands = stats.agg(F.count_distinct("band")).scalar()
    checked = F.assert_true(bands == N_BANDS, "band statistics do not match the band edges")
    ok = stats.filter(checked.isNull())
    if "split" in stats.columns:
        ok = ok.filter(F.assert_true(F.col("split") == "train", "band statistics must come from train").isNull())
    return ok.withColumn("weight", band_weight(F.col("base_rate"), F.col("n_pixels"), cap))


def positive_weight(index: DataFrame, cells_per_sample: int) -> DataFrame:
    pos = F.sum("n_target_px")
    return index.agg(((F.count("*") * cells_per_sample - pos) / F.greatest(pos, F.lit(1))).alias("pos_weight"))


def _log_loss(y: Column, weight: Column) -> Column:
    p = F.least(F.greatest(F.col("prob"), F.lit(1e-7)), F.lit(1 - 1e-7))
    return -(y * F.log(p) * weight + (1 - y) * F.log(1 - p))


def weighted_bce(scored: DataFrame, pos_weight: float, smoothing: float = 0.0) -> DataFrame:
    """Mean weighted cross entropy; smoothing moves targets towards one half. `smoothing_risk` is
    set when the smoothed weight on negatives rivals them, and `p_star` is the prediction that
    smoothing alone makes best for a negative cell."""
    y = F.col("target").cast("double") * (1 - smoothing) + smoothing / 2
    t = smoothing / 2
    best = pos_weight * t / (pos_weight * t + 1 - t)
    return (scored.agg(F.avg(_log_loss(y, F.lit(float(pos_weight)))).alias("bce"), F.count("*").alias("n"))
            .withColumn("smoothing_risk", F.lit(smoothing * pos_weight > 0.1)).withColumn("p_star", F.lit(float(best))))


def band_weighted_bce(scored: DataFrame, weights: DataFrame) -> DataFrame:
    w = F.broadcast(weights.select("band", "weight"))  # one row per distance band
    return (scored.join(w, "band").agg(F.avg(_log_loss(F.col("target").cast("double"), F.col("weight"))).alias("bce"),
                                       F.count("*").alias("n")))


def focal_loss(scored: DataFrame, alpha: float = 0.25, gamma: float = 2.0) -> DataFrame:
    y = F.col("target").cast("double")
    p = F.least(F.greatest(F.col("prob"), F.lit(1e-7)), F.lit(1 - 1e-7))
    p_t = F.when(F.col("target"), p).otherwise(1 - p)
    a_t = F.when(F.col("target"), alpha).otherwise(1 - alpha)
    return scored.agg(F.avg(F.pow(1 - p_t, F.lit(gamma)) * _log_loss(y, F.lit(1.0)) * a_t).alias("focal"),
                      F.count("*").alias("n"))
