"""Scores of probabilistic forecasts. Input rows: (sample_id, fire_id, prob, target[, band])."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perimeter.config import BAND_EDGES, RELIABILITY_EDGES, THRESHOLDS
from perimeter.functions.bins import csi, left_closed, right_closed, skill
from perimeter.operators.ranking import exact_quantiles, wide_quantiles
from perimeter.storage import deal

AP_BINS = 20000
FAR_BAND = 6


def confusion_counts(scored: DataFrame, keys: Sequence[str], thresholds: Sequence[float] = THRESHOLDS,
                     positives: DataFrame | None = None) -> DataFrame:
    """tp, fp, fn per key and threshold for `prob > threshold`.

    Each cell falls into one bucket (thresholds it exceeds); cells combine per bucket and the few
    buckets of a key are then summed, so no cell is repeated per threshold."""
    keys = list(keys)
    exceeded = reduce(lambda a, b: a + b, [(F.col("prob") > t).cast("int") for t in thresholds])
    hit = F.col("target").cast("int")
    buckets = (scored.withColumn("_b", exceeded).groupBy(*keys, "_b")
               .agg(F.sum(hit).alias("_pos"), F.sum(1 - hit).alias("_neg")))
    sums = [F.sum("_pos").alias("_all")]
    for i in range(len(thresholds)):
        over = F.col("_b") > i
        sums += [F.sum(F.when(over, F.col("_pos")).otherwise(0)).alias(f"_tp{i}"),
                 F.sum(F.when(over, F.col("_neg")).otherwise(0)).alias(f"_fp{i}")]
    cells = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_tp{i}").alias("tp"),
                               F.col(f"_fp{i}").alias("fp"), (F.col("_all") - F.col(f"_tp{i}")).alias("fn"))
                      for i, t in enumerate(thresholds)])
    # Dealt by key, the wide sums are made once, in tasks as many as a shuffle has: adaptive execution would merge tasks by the few bytes
    # that buckets take when written, not by what the sums take.
    return deal(buckets, *keys).groupBy(*keys).agg(*sums).select(*keys, F.inline(cells))


def pooled(counts: DataFrame, *keys: str) -> DataFrame:
    return counts.groupBy(*keys, "threshold").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def pooled_scores(scored: DataFrame, *keys: str) -> DataFrame:
    counts = confusion_counts(scored, list(keys))
    return counts.select(*keys, "threshold", "tp", "fp", "fn", *skill())


def best_threshold(scores: DataFrame, *keys: str) -> DataFrame:
    """Threshold of the highest CSI (the lowest of equals), flagged at the ends of the sweep."""
    ends = scores.groupBy(*keys).agg(
        F.max_by("threshold", F.struct("csi", -F.col("threshold"))).alias("best_threshold"), F.max("csi").alias("best_csi"),
        F.min("threshold").alias("_a"), F.max("threshold").alias("_b"))
    edge = (F.col("best_threshold") == F.col("_a")) | (F.col("best_threshold") == F.col("_b"))
    return ends.withColumn("at_edge", edge).drop("_a", "_b")


def chosen_threshold(split_scores: DataFrame) -> Column:
    """The best threshold on validation, from scores per split and threshold."""
    return best_threshold(split_scores.filter("split = 'val'")).select("best_threshold").scalar()


def transfer(split_scores: DataFrame) -> DataFrame:
    """Test scores at the threshold chosen on validation and at the one that test itself would choose."""
    test = split_scores.filter("split = 'test'").select("threshold", "csi")
    own = best_threshold(test).select(F.lit("test").alias("choice"), F.col("best_threshold").alias("threshold"), F.col("best_csi").alias("csi"))
    held = test.filter(F.col("threshold") == chosen_threshold(split_scores))
    return held.select(F.lit("validation").alias("choice"), "threshold", "csi").unionByName(own)


def brier(scored: DataFrame, cells_per_sample: int | None = None) -> DataFrame:
    """Mean over samples of each sample's mean squared error; absent cells count as exact zeros
    when the number of cells of a sample is given."""
    err = F.pow(F.col("prob") - F.col("target").cast("double"), 2)
    total = F.avg("_e") if cells_per_sample is None else F.sum("_e") / F.lit(float(cells_per_sample))
    return (scored.withColumn("_e", err).groupBy("sample_id").agg(total.alias("brier"))
            .agg(F.avg("brier").alias("brier"), F.count("*").alias("samples")))


def csi_at(scored: DataFrame, threshold: float, *keys: str) -> DataFrame:
    counts = confusion_counts(scored, list(keys), [threshold])
    return counts.select(*keys, csi(F.col("tp"), F.col("fp"), F.col("fn")).alias("csi"))


def per_fire_summary(fires: DataFrame, value: str = "csi") -> DataFrame:
    """Median, quartiles and mean over fires."""
    quart = wide_quantiles(fires, value, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    mean = fires.agg(F.struct(F.avg(value).alias("mean"), F.count(value).alias("n"))).scalar()
    return quart.withColumn("_m", mean).select("*", "_m.*").drop("_m")


def quantile_edges(df: DataFrame, value: str, parts: int = 4) -> DataFrame:
    """One row with the distinct sorted quantile edges as an array."""
    probs = [i / parts for i in range(parts + 1)]
    return (exact_quantiles(df, value, probs)
            .agg(F.array_sort(F.collect_set("quantile")).alias("edges")))


def with_bin(df: DataFrame, value: str, edges: DataFrame, out: str = "bin") -> DataFrame:
    """Right-closed bin number of `value` in the single-row `edges`."""
    return df.withColumn("edges", edges.scalar()).withColumn(out, right_closed(F.col(value), F.col("edges"))).drop("edges")


def size_quartiles(fires: DataFrame) -> DataFrame:
    """n, median and mean CSI by quartile of burned size; input (fire_id, csi, burned_px)."""
    binned = with_bin(fires, "burned_px", quantile_edges(fires, "burned_px"))
    med = wide_quantiles(binned, "csi", {"median": 0.5}, ["bin"])
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg("csi").alias("mean")).join(med, "bin")


def size_matched(fires: DataFrame, min_fires: int = 3) -> DataFrame:
    """val and test medians inside shared size bins; input (split, fire_id, csi, burned_px)."""
    both = fires.filter(F.col("split").isin("val", "test"))
    binned = with_bin(both, "burned_px", quantile_edges(both, "burned_px"))
    med = wide_quantiles(binned, "csi", {"median": 0.5}, ["bin", "split"])
    stats = binned.groupBy("bin", "split").agg(F.count("*").alias("n")).join(med, ["bin", "split"])

    def pick(split: str, col: str) -> Column:
        return F.max(F.when(F.col("split") == split, F.col(col)))
    wide = stats.groupBy("bin").agg(pick("val", "n").alias("n_val"), pick("val", "median").alias("val_median"),
                                    pick("test", "n").alias("n_test"), pick("test", "median").alias("test_median"))
    return (wide.filter((F.col("n_val") >= min_fires) & (F.col("n_test") >= min_fires))
            .withColumn("gap", F.col("test_median") - F.col("val_median")))


def reweighted(fires: DataFrame) -> DataFrame:
    """Validation medians reweighted to the test size mix: how much of the drop is composition."""
    both = fires.filter(F.col("split").isin("val", "test"))
    binned = with_bin(both, "burned_px", quantile_edges(both, "burned_px"))
    share = binned.filter("split = 'test'").groupBy("bin").agg(F.count("*").alias("w"))
    val_med = wide_quantiles(binned.filter("split = 'val'"), "csi", {"m": 0.5}, ["bin"])
    mixed = share.join(val_med, "bin").agg((F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("val_reweighted"))
    raw = wide_quantiles(both, "csi", {"m": 0.5}, ["split"]).agg(
        F.max(F.when(F.col("split") == "val", F.col("m"))).alias("val_median"),
        F.max(F.when(F.col("split") == "test", F.col("m"))).alias("test_median"))
    return (raw.withColumn("val_reweighted", mixed.scalar())
            .withColumn("composition", F.col("val_median") - F.col("val_reweighted"))
            .withColumn("residual", F.col("test_median") - F.col("val_reweighted")))


def band_scores(scored: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Counts per distance band and threshold; CSI is null where nothing was predicted or true."""
    counts = confusion_counts(scored, ["band"], thresholds)
    empty = F.col("tp") + F.col("fp") + F.col("fn") == 0
    return counts.withColumn("csi", F.when(~empty, csi(F.col("tp"), F.col("fp"), F.col("fn"))))


def far_scores(scored: DataFrame) -> DataFrame:
    """CSI per threshold pooled over the bands from FAR_BAND outwards."""
    return pooled_scores(scored.filter(F.col("band") >= FAR_BAND))


def far_csi(scored: DataFrame, stored_threshold: float) -> DataFrame:
    """Far CSI at the pooled-best, the far-best and a stored threshold."""
    far = far_scores(scored)
    best = best_threshold(pooled_scores(scored))
    own = best_threshold(far)
    at_pooled = far.join(F.broadcast(best.select(F.col("best_threshold").alias("threshold"))), "threshold")
    at_stored = far.filter(F.col("threshold") == stored_threshold)
    return (at_pooled.select(F.lit("pooled_best").alias("choice"), "threshold", "csi")
            .unionByName(own.select(F.lit("own_best").alias("choice"), F.col("best_threshold").alias("threshold"),
                                    F.col("best_csi").alias("csi")))
            .unionByName(at_stored.select(F.lit("stored").alias("choice"), "threshold", "csi")))


def skill_by_distance(scored: DataFrame, threshold: float) -> DataFrame:
    """Base rate and skill per band; here a forecast is positive at prob >= threshold, and the
    share of all growth is taken over the bands."""
    p, y = F.col("prob") >= threshold, F.col("target")
    def count(test: Column) -> Column:
        return F.sum(test.cast("int"))
    rows = scored.groupBy("band").agg(F.count("*").alias("n"), count(y).alias("pos"), count(p & y).alias("tp"),
                                      count(p & ~y).alias("fp"), count(~p & y).alias("fn"))
    total = rows.agg(F.sum("pos")).scalar()
    return (rows.withColumn("base_rate", F.col("pos") / F.col("n"))
            .withColumn("csi", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))
            .withColumn("pod", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0)))
            .withColumn("far", F.try_divide("fp", F.col("tp") + F.col("fp")))
            .withColumn("growth_share", F.try_divide(F.col("pos"), total)))


def pr_histogram(scored: DataFrame, keys: Sequence[str] = (), bins: int = AP_BINS) -> DataFrame:
    """Positives and negatives per probability bin."""
    b = F.least(F.greatest((F.col("prob") * bins).cast("int"), F.lit(0)), F.lit(bins))
    hit = F.col("target").cast("int")
    return scored.groupBy(*keys, b.alias("bin")).agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))


def average_precision(hist: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """AP, base rate and lift from a histogram; NaN without positives. The running sums span a
    key's histogram (at most bins + 1 rows), never its cells."""
    keys = list(keys)
    down = Window.partitionBy(*keys).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    swept = (hist.withColumn("_tp", F.sum("pos").over(down)).withColumn("_fp", F.sum("neg").over(down))
             .withColumn("_p", F.col("_tp") / F.greatest(F.col("_tp") + F.col("_fp"), F.lit(1))))
    sums = swept.groupBy(*keys).agg(F.sum(F.col("_p") * F.col("pos")).alias("_s"), F.sum("pos").alias("pos"),
                                    F.sum("neg").alias("neg"))
    return (sums.withColumn("ap", F.when(F.col("pos") > 0, F.col("_s") / F.col("pos")).otherwise(F.lit(float("nan"))))
            .withColumn("base_rate", F.try_divide("pos", F.col("pos") + F.col("neg")))
            .withColumn("lift", F.try_divide("ap", "base_rate")).drop("_s"))


def cumulative_target(scored: DataFrame, burned: Column) -> DataFrame:
    """Scores against the cumulative mask: burned cells are certain and true."""
    return scored.withColumn("prob", F.when(burned, 1.0).otherwise(F.col("prob"))).withColumn(
        "target", burned | F.col("target"))


def reliability(scored: DataFrame, edges: Sequence[float] = RELIABILITY_EDGES) -> DataFrame:
    b = F.least(F.greatest(left_closed(F.col("prob"), edges) - 1, F.lit(0)), F.lit(len(edges) - 2))
    return scored.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("prob").alias("mean_prob"),
                                              F.avg(F.col("target").cast("double")).alias("hit_rate"))


def confusion_code(threshold: float) -> Column:
    """0 neither, 1 missed, 2 false alarm, 3 hit."""
    p = F.col("prob") > threshold
    return F.when(p & F.col("target"), 3).when(p, 2).when(F.col("target"), 1).otherwise(0)


def extreme_samples(scored: DataFrame, threshold: float, n: int = 4) -> DataFrame:
    per = csi_at(scored, threshold, "sample_id")
    best = per.orderBy(F.desc("csi"), "sample_id").limit(n).withColumn("side", F.lit("best"))
    worst = per.orderBy("csi", "sample_id").limit(n).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def distance_band(dist: Column) -> Column:
    return left_closed(dist, BAND_EDGES)


def paired_comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """Differences b - a over fires both arms scored, with a two-sided sign test. Input (fire_id, csi)."""
    both = (a.withColumnRenamed("csi", "_a").join(b.withColumnRenamed("csi", "_b"), "fire_id")
            .withColumn("diff", F.col("_b") - F.col("_a")))
    med = wide_quantiles(both, "diff", {"median_diff": 0.5})
    out = both.agg(F.count("*").alias("n"), F.avg("diff").alias("mean_diff"),
                   F.sum((F.col("diff") > 0).cast("int")).alias("wins"),
                   F.sum((F.col("diff") < 0).cast("int")).alias("losses"))
    m, k = F.col("wins") + F.col("losses"), F.least("wins", "losses")
    # log C(m, i) is a running sum of log((m - j + 1) / j), taken over i = 0..k only.
    tail = F.aggregate(
        F.sequence(F.lit(0), k.cast("int")), F.struct(F.lit(0.0).alias("lc"), F.lit(0.0).alias("p")),
        lambda acc, i: F.struct(
            F.when(i == 0, 0.0).otherwise(acc["lc"] + F.log((m - i + 1) / F.greatest(i, F.lit(1)))).alias("lc"),
            (acc["p"] + F.exp(F.when(i == 0, 0.0).otherwise(
                acc["lc"] + F.log((m - i + 1) / F.greatest(i, F.lit(1)))) - m * F.log(F.lit(2.0)))).alias("p")))
    return out.withColumn("p_sign", F.least(F.lit(1.0), tail["p"] * 2)).withColumn("median_diff", med.scalar())


def seed_summary(runs: DataFrame) -> DataFrame:
    """Mean and sample deviation over seeds; input (arm, seed, csi)."""
    return runs.groupBy("arm").agg(F.count("*").alias("seeds"), F.avg("csi").alias("mean"), F.stddev_samp("csi").alias("sd"))


def split_summary(samples: DataFrame, cells_per_sample: int) -> DataFrame:
    """Input (split, fire_id, n_target, clipped) per sample."""
    pct = F.col("n_target") * 100.0 / cells_per_sample
    med = wide_quantiles(samples.withColumn("_pct", pct), "_pct", {"median_positive_pct": 0.5}, ["split"])
    rows = samples.groupBy("split").agg(
        F.count("*").alias("samples"), F.count_distinct("fire_id").alias("fires"), F.sum("n_target").alias("_pos"),
        (F.avg(F.col("clipped").cast("double")) * 100).alias("clipped_pct"))
    total = rows.agg(F.sum("samples")).scalar()
    return (rows.join(med, "split").withColumn("share", F.col("samples") / total)
            .withColumn("implied_weight", (F.col("samples") * cells_per_sample - F.col("_pos")) / F.greatest("_pos", F.lit(1)))
            .drop("_pos"))


def angle_histogram(angles: DataFrame, width: float = 45.0) -> DataFrame:
    """Counts of the left-closed 45 degree bins below 180, and their shares of all angles."""
    rows = angles.filter(F.col("angle") < 180).groupBy(
        F.least(F.floor(F.col("angle") / width), F.lit(3)).cast("int").alias("octant")).agg(F.count("*").alias("n"))
    total = angles.agg(F.count("angle")).scalar()
    return rows.withColumn("share", F.col("n") / total)


def quartile_means(df: DataFrame, by: str, value: str) -> DataFrame:
    """n and mean of `value` by quartile of `by`: left-closed bins, the last one closed."""
    q = wide_quantiles(df, by, {"q1": 0.25, "q2": 0.5, "q3": 0.75}).agg(F.first(F.struct("q1", "q2", "q3"))).scalar()
    at = df.withColumn("_q", q)
    bin_ = sum((F.col(by) >= F.col(f"_q.{n}")).cast("int") for n in ("q1", "q2", "q3"))
    return at.withColumn("quartile", bin_).groupBy("quartile").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
