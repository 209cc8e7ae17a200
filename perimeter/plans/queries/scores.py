"""Queries over scored forecasts: metrics, losses and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perimeter.operators import dataset as D
from perimeter.operators import losses as LO
from perimeter.operators import metrics as V
from perimeter.operators import splits as N
from perimeter.plans.checks import BAND_RATES, P, counts_sql, csi_sql, edges_sql, right_closed_sql
from perimeter.plans.queries.segments import r
from perimeter.plans.queries.tiles import SKILL, rounded_skill
from perimeter.plans.registry import query
from perimeter.plans.study import Study


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.select(*[r(c, digits).alias(c) if c in cols else c for c in df.columns])


@query("v01_confusion_counts", counts_sql("sample_id"))
def v01(s: Study) -> DataFrame:
    return V.confusion_counts(s.scored, ["sample_id"])


@query("v02_scores", f"SELECT *, {SKILL} FROM ({counts_sql('fire_id')})")
def v02(s: Study) -> DataFrame:
    return V.confusion_counts(s.scored, ["fire_id"]).select("fire_id", "threshold", "tp", "fp", "fn", *rounded_skill())


@query("v03_brier", """
SELECT round(avg(b), 6) AS brier, count(*) AS samples FROM (
  SELECT avg((prob - target::INT) ** 2) AS b FROM v_scored GROUP BY sample_id)""")
def v03(s: Study) -> DataFrame:
    return rounded(V.brier(s.scored), "brier")


@query("v04_pooled_best", f"""
SELECT p.*, p.threshold = b.threshold AS is_best FROM (SELECT threshold, tp, fp, fn, {SKILL} FROM v_pooled) p,
 (SELECT threshold FROM v_pooled ORDER BY csi DESC, threshold LIMIT 1) b""")
def v04(s: Study) -> DataFrame:
    scores = V.pooled_scores(s.scored)
    best = V.best_threshold(scores).select("best_threshold").scalar()
    return scores.select("threshold", "tp", "fp", "fn", *rounded_skill(), (F.col("threshold") == best).alias("is_best"))


@query("v05_per_fire_csi", f"""
SELECT round(quantile_cont(csi, 0.25), 6) AS q25, round(quantile_cont(csi, 0.5), 6) AS median,
       round(quantile_cont(csi, 0.75), 6) AS q75, round(avg(csi), 6) AS mean, count(*) AS n
FROM ({csi_sql('fire_id', 0.5)})""")
def v05(s: Study) -> DataFrame:
    return rounded(V.per_fire_summary(V.csi_at(s.scored, 0.5, "fire_id")), "q25", "median", "q75", "mean")


def fires(s: Study) -> DataFrame:
    size = s.scored.filter("target").groupBy("fire_id").agg(F.count("*").alias("burned_px"))
    return V.csi_at(s.scored, 0.5, "fire_id").join(size, "fire_id")


@query("v09_size_quartiles", f"""
SELECT bin, count(*) AS n, round(avg(csi), 6) AS mean, round(median(csi), 6) AS median FROM (
  SELECT csi, CAST({right_closed_sql('burned_px', 'e')} AS INTEGER) AS bin
  FROM (SELECT *, {edges_sql('burned_px', 'v_fire')} AS e FROM v_fire)) GROUP BY bin""")
def v09(s: Study) -> DataFrame:
    return rounded(V.size_quartiles(fires(s)), "mean", "median")


def split_fires(s: Study) -> DataFrame:
    side = F.when(F.col("fire_id") % 2 == 0, "val").otherwise("test")
    return fires(s).withColumn("split", side)


_BOTH = f"""(SELECT csi, burned_px, split, CAST({right_closed_sql('burned_px', 'e')} AS INTEGER) AS bin FROM (
  SELECT *, {edges_sql('burned_px', 'v_fire')} AS e, CASE WHEN fire_id % 2 = 0 THEN 'val' ELSE 'test' END AS split
  FROM v_fire))"""


@query("v10_size_matched", f"""
SELECT bin, n_val, round(val_median, 6) AS val_median, n_test, round(test_median, 6) AS test_median,
       round(test_median - val_median, 6) + 0.0 AS gap FROM (
  SELECT bin, count(*) FILTER (split = 'val') AS n_val, median(csi) FILTER (split = 'val') AS val_median,
         count(*) FILTER (split = 'test') AS n_test, median(csi) FILTER (split = 'test') AS test_median
  FROM {_BOTH} GROUP BY bin) WHERE n_val >= 3 AND n_test >= 3""")
def v10(s: Study) -> DataFrame:
    return rounded(V.size_matched(split_fires(s)), "val_median", "test_median", "gap")


@query("v11_reweighted", f"""
SELECT round(v, 6) AS val_median, round(t, 6) AS test_median, round(m, 6) AS val_reweighted,
       round(v - m, 6) + 0.0 AS composition, round(t - m, 6) + 0.0 AS residual FROM (
  SELECT median(csi) FILTER (split = 'val') AS v, median(csi) FILTER (split = 'test') AS t,
    (SELECT sum(w * m) / sum(w) FROM (SELECT bin, count(*) FILTER (split = 'test') AS w,
       median(csi) FILTER (split = 'val') AS m FROM {_BOTH} GROUP BY bin) WHERE w > 0 AND m IS NOT NULL) AS m
  FROM {_BOTH})""")
def v11(s: Study) -> DataFrame:
    return rounded(V.reweighted(split_fires(s)), "val_median", "test_median", "val_reweighted", "composition", "residual")


@query("v12_band_confusion", f"""
SELECT *, CASE WHEN tp + fp + fn > 0 THEN round(tp / (tp + fp + fn), 6) END AS csi FROM ({counts_sql('band')})""")
def v12(s: Study) -> DataFrame:
    return rounded(V.band_scores(s.scored), "csi")


@query("v13_far_csi", """
SELECT 'pooled_best' AS choice, threshold, round(csi, 6) AS csi FROM v_far
WHERE threshold = (SELECT threshold FROM v_pooled ORDER BY csi DESC, threshold LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'own_best', threshold, round(csi, 6) FROM v_far ORDER BY csi DESC, threshold LIMIT 1)
UNION ALL SELECT 'stored', threshold, round(csi, 6) FROM v_far WHERE threshold = 0.7""")
def v13(s: Study) -> DataFrame:
    return rounded(V.far_csi(s.scored, 0.7), "csi")


@query("v14_skill_by_distance", """
SELECT band, n, pos, tp, fp, fn, round(pos / n, 6) AS base_rate, round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 6) AS csi,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS pod, round(fp / nullif(tp + fp, 0), 6) AS far,
       round(pos / sum(pos) OVER (), 6) AS growth_share FROM (
  SELECT band, count(*) AS n, count(*) FILTER (target) AS pos, count(*) FILTER (prob >= 0.5 AND target) AS tp,
         count(*) FILTER (prob >= 0.5 AND NOT target) AS fp, count(*) FILTER (prob < 0.5 AND target) AS fn
  FROM v_scored GROUP BY band)""")
def v14(s: Study) -> DataFrame:
    return rounded(V.skill_by_distance(s.scored, 0.5), "base_rate", "csi", "pod", "far", "growth_share")


def ap_sql(keys: str, source: str = "v_scored") -> str:
    k, part = (keys + ", ", f"PARTITION BY {keys}") if keys else ("", "")
    return f"""SELECT {k}CAST(sum(pos) AS BIGINT) AS pos, CAST(sum(neg) AS BIGINT) AS neg,
  coalesce(sum(tp / (tp + fp) * pos) / nullif(sum(pos), 0), 'nan'::DOUBLE) AS ap FROM (
  SELECT *, sum(pos) OVER ({part} ORDER BY bin DESC) AS tp, sum(neg) OVER ({part} ORDER BY bin DESC) AS fp FROM (
    SELECT {k}CAST(floor(prob * 20000) AS INTEGER) AS bin, count(*) FILTER (target) AS pos,
           count(*) FILTER (NOT target) AS neg FROM {source} GROUP BY ALL)) {('GROUP BY ' + keys) if keys else ''}"""


@query("v15_average_precision", f"SELECT pos, neg, round(ap, 6) AS ap FROM ({ap_sql('')})")
def v15(s: Study) -> DataFrame:
    return rounded(V.average_precision(V.pr_histogram(s.scored)).select("pos", "neg", "ap"), "ap")


@query("v16_base_rate_lift", f"""
SELECT band, round(pos / (pos + neg), 6) AS base_rate, round(ap / (pos / (pos + neg)), 4) AS lift FROM ({ap_sql('band')})""")
def v16(s: Study) -> DataFrame:
    ap = V.average_precision(V.pr_histogram(s.scored, ["band"]), ["band"])
    return ap.select("band", r("base_rate", 6).alias("base_rate"), r("lift", 4).alias("lift"))


@query("v17_cumulative_ap", f"""
SELECT pos, neg, round(ap, 6) AS ap FROM ({ap_sql('', "(SELECT CASE WHEN dist = 0 THEN 1.0 ELSE prob END AS prob, dist = 0 OR target AS target FROM v_scored)")})""")
def v17(s: Study) -> DataFrame:
    cum = V.cumulative_target(s.scored, F.col("dist") == 0)
    return rounded(V.average_precision(V.pr_histogram(cum)).select("pos", "neg", "ap"), "ap")


@query("v18_per_fire_ap", f"""
SELECT round(quantile_cont(ap, 0.25), 6) AS q25, round(median(ap), 6) AS median, round(quantile_cont(ap, 0.75), 6) AS q75,
       round(avg(ap), 6) AS mean, count(*) AS n FROM ({ap_sql('fire_id')}) WHERE pos > 0""")
def v18(s: Study) -> DataFrame:
    ap = V.average_precision(V.pr_histogram(s.scored, ["fire_id"]), ["fire_id"]).filter("pos > 0")
    return rounded(V.per_fire_summary(ap, "ap"), "q25", "median", "q75", "mean")


@query("v19_reliability", """
SELECT CAST(least(greatest(len(list_filter([0, 0.01, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99, 1.0]::DOUBLE[],
         lambda e: prob >= e)) - 1, 0), 13) AS INTEGER) AS bin, count(*) AS n, round(avg(prob), 6) AS mean_prob,
       round(avg(target::INT), 6) AS hit_rate FROM v_scored GROUP BY 1""")
def v19(s: Study) -> DataFrame:
    return rounded(V.reliability(s.scored), "mean_prob", "hit_rate")


@query("v20_confusion_map", """
SELECT sample_id, CAST(CASE WHEN prob > 0.5 AND target THEN 3 WHEN prob > 0.5 THEN 2 WHEN target THEN 1 ELSE 0 END AS INTEGER)
       AS code, count(*) AS n FROM v_scored GROUP BY ALL""")
def v20(s: Study) -> DataFrame:
    return s.scored.groupBy("sample_id", V.confusion_code(0.5).alias("code")).agg(F.count("*").alias("n"))


@query("v21_extreme_samples", f"""
SELECT * FROM (SELECT sample_id, round(csi, 6) AS csi, 'best' AS side FROM ({csi_sql('sample_id', 0.5)}) ORDER BY csi DESC, sample_id LIMIT 4)
UNION ALL SELECT * FROM (SELECT sample_id, round(csi, 6), 'worst' FROM ({csi_sql('sample_id', 0.5)}) ORDER BY csi, sample_id LIMIT 4)""")
def v21(s: Study) -> DataFrame:
    return rounded(V.extreme_samples(s.scored, 0.5), "csi")


@query("v24_paired_comparison", f"""
SELECT n, round(mean_diff, 6) + 0.0 AS mean_diff, round(median_diff, 6) + 0.0 AS median_diff, wins, losses,
  round(least(1.0, 2 * (SELECT sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2.0)))
   FROM (SELECT UNNEST(range(least(wins, losses) + 1)) AS i))), 6) AS p_sign FROM (
  SELECT count(*) AS n, avg(d) AS mean_diff, median(d) AS median_diff, count(*) FILTER (d > 0) AS wins,
         count(*) FILTER (d < 0) AS losses FROM (
    SELECT b.csi - a.csi AS d FROM ({csi_sql('fire_id', 0.5)}) a JOIN ({csi_sql('fire_id', 0.2)}) b USING (fire_id)))""")
def v24(s: Study) -> DataFrame:
    both = V.paired_comparison(V.csi_at(s.scored, 0.5, "fire_id"), V.csi_at(s.scored, 0.2, "fire_id"))
    return rounded(both, "mean_diff", "median_diff", "p_sign")


@query("v26_seed_summary", f"""
SELECT arm, count(*) AS seeds, round(avg(csi), 6) AS mean, round(stddev_samp(csi), 6) AS sd FROM (
  SELECT sample_id % 2 AS arm, sample_id % 6 AS seed, count(*) FILTER (prob > 0.5 AND target)
   / greatest(count(*) FILTER (prob > 0.5 OR target), 1) AS csi FROM v_scored GROUP BY ALL) GROUP BY arm""")
def v26(s: Study) -> DataFrame:
    runs = s.scored.withColumn("arm", F.col("sample_id") % 2).withColumn("seed", F.col("sample_id") % 6)
    return rounded(V.seed_summary(V.csi_at(runs, 0.5, "arm", "seed")), "mean", "sd")


_SPLIT = """(SELECT *, CASE WHEN year BETWEEN 1995 AND 1998 THEN 'train' WHEN year = 1999 THEN 'val'
  WHEN year BETWEEN 2000 AND 2001 THEN 'test' END AS split FROM v_years)"""
ORDER_SPLITS = {"train": (1995, 1998), "val": (1999, 1999), "test": (2000, 2001)}


@query("v27_split_summary", f"""
SELECT split, count(*) AS samples, count(DISTINCT fire_id) AS fires, round(avg(clipped::INT) * 100, 4) AS clipped_pct,
  round(median(n_target * 100.0 / 1024), 6) AS median_positive_pct, round(count(*) / sum(count(*)) OVER (), 6) AS share,
  round((count(*) * 1024 - sum(n_target)) / greatest(sum(n_target), 1), 4) AS implied_weight
FROM {_SPLIT} WHERE split IS NOT NULL GROUP BY split""")
def v27(s: Study) -> DataFrame:
    rows = N.assign_split(s.order_years, ORDER_SPLITS)
    out = V.split_summary(rows, 1024)
    return out.select("split", "samples", "fires", r("clipped_pct").alias("clipped_pct"),
                      r("median_positive_pct", 6).alias("median_positive_pct"), r("share", 6).alias("share"),
                      r("implied_weight").alias("implied_weight"))


@query("n01_split_years", f"SELECT sample_id, year, split FROM {_SPLIT} WHERE split IS NOT NULL")
def n01(s: Study) -> DataFrame:
    return N.assign_split(s.order_years, ORDER_SPLITS).select("sample_id", "year", "split")


@query("n02_write_splits", """
SELECT fire_id, year, CASE WHEN year BETWEEN 2015 AND 2020 THEN 'train' WHEN year = 2021 THEN 'val'
  WHEN year BETWEEN 2022 AND 2023 THEN 'test' END AS split FROM v_events WHERE keep""")
def n02(s: Study) -> DataFrame:
    return N.fire_splits(s.events, s.cfg.split_years)


@query("n03_split_overlap", f"""
SELECT fire_id, count(DISTINCT split) AS splits FROM {_SPLIT} WHERE split IS NOT NULL GROUP BY fire_id
HAVING count(DISTINCT split) > 1""")
def n03(s: Study) -> DataFrame:
    return N.overlapping_fires(N.assign_split(s.order_years, ORDER_SPLITS))


@query("n04_split_filter", """
SELECT i.sample_id, i.fire_id FROM v_index i JOIN v_events e USING (fire_id) WHERE e.year BETWEEN 2015 AND 2020""")
def n04(s: Study) -> DataFrame:
    return N.samples_of(s.index, N.fire_splits(s.events, s.cfg.split_years), "train").select("sample_id", "fire_id")


@query("n14_seeded_sampling", """
SELECT sample_id FROM v_years ORDER BY md5('0:' || sample_id), sample_id LIMIT 400""")
def n14(s: Study) -> DataFrame:
    return N.seeded_sample(s.order_years, 400, 0, "sample_id").select("sample_id")


# --- weights and losses -------------------------------------------------------------------------

_BANDS = """(SELECT band, count(*) AS n_pixels, count(*) FILTER (target) AS n_positive,
  count(*) FILTER (target) / count(*) AS base_rate FROM v_scored GROUP BY band)"""
_W = "CASE WHEN n_pixels = 0 THEN 1 WHEN base_rate <= 0 THEN 300 ELSE least(greatest((1 - base_rate) / base_rate, 1), 300) END"


def band_stats(s: Study) -> DataFrame:
    return s.scored.groupBy("band").agg(
        F.count("*").alias("n_pixels"), F.sum(F.col("target").cast("int")).alias("n_positive"),
        F.avg(F.col("target").cast("double")).alias("base_rate")).withColumn("split", F.lit("train"))


@query("b01_band_index", "SELECT sample_id, band, count(*) AS n FROM v_scored GROUP BY ALL")
def b01(s: Study) -> DataFrame:
    return s.scored.groupBy("sample_id", "band").agg(F.count("*").alias("n"))


@query("b02_band_labels", """
SELECT CASE band WHEN 0 THEN '0.0-0.1 km' WHEN 1 THEN '0.1-0.2 km' WHEN 2 THEN '0.2-0.3 km' WHEN 3 THEN '0.3-0.5 km'
  WHEN 4 THEN '0.5-0.8 km' WHEN 5 THEN '0.8-1.2 km' WHEN 6 THEN '1.2-2.0 km' WHEN 7 THEN '2.0-3.2 km' ELSE '3.2+ km' END
  AS label, count(*) AS n FROM v_scored GROUP BY 1""")
def b02(s: Study) -> DataFrame:
    return s.scored.groupBy(N.band_label(F.col("band")).alias("label")).agg(F.count("*").alias("n"))


@query("b04_band_weights", f"SELECT band, round({_W}, 6) AS weight FROM {_BANDS}")
def b04(s: Study) -> DataFrame:
    return LO.band_weights(band_stats(s), 300).select("band", r("weight", 6).alias("weight"))


# Counts of the training tiles; tiles and targets are those of the sample index.
@query("b05_band_guards", f"SELECT band, n_pixels, n_positive, round({_W}, 6) AS weight FROM {BAND_RATES}")
def b05(s: Study) -> DataFrame:
    """Weights from the base rates of the samples the index gives to the training split, which the guards check."""
    train = N.samples_of(s.samples, s.splits, "train")
    named = train.join(s.splits, "fire_id").agg(F.array_join(F.array_sort(F.collect_set("split")), "+")).scalar()
    stats = D.base_rates(train, s.tile_marks, P).withColumn("split", named)
    return LO.band_weights(stats, 300).select("band", "n_pixels", "n_positive", r("weight", 6).alias("weight"))


@query("b06_positive_weight", """
SELECT round((count(*) * 1024 - sum(n_target)) / greatest(sum(n_target), 1), 6) AS pos_weight
FROM v_years JOIN (SELECT sample_id FROM """ + _SPLIT + """ WHERE split = 'train') USING (sample_id)""")
def b06(s: Study) -> DataFrame:
    return rounded(LO.positive_weight(N.assign_split(s.order_years, ORDER_SPLITS).filter("split = 'train'").withColumnRenamed("n_target", "n_target_px"), 1024), "pos_weight")


_P = "least(greatest(prob, 1e-7), 1 - 1e-7)"


@query("m02_weighted_bce", f"""
SELECT round(avg(-((0.98 * target::INT + 0.01) * ln({_P}) * 3 + (1 - 0.98 * target::INT - 0.01) * ln(1 - {_P}))), 6) AS bce,
       count(*) AS n, false AS smoothing_risk, round(3 * 0.01 / (3 * 0.01 + 0.99), 6) AS p_star FROM v_scored""")
def m02(s: Study) -> DataFrame:
    return rounded(LO.weighted_bce(s.scored, 3.0, 0.02), "bce", "p_star")


@query("m03_band_weighted_bce", f"""
SELECT round(avg(-(target::INT * ln({_P}) * w + (1 - target::INT) * ln(1 - {_P}))), 6) AS bce, count(*) AS n
FROM v_scored JOIN (SELECT band, {_W} AS w FROM {_BANDS}) USING (band)""")
def m03(s: Study) -> DataFrame:
    return rounded(LO.band_weighted_bce(s.scored, LO.band_weights(band_stats(s), 300)), "bce")


@query("m04_focal_loss", f"""
SELECT round(avg((CASE WHEN target THEN 0.25 ELSE 0.75 END) * (1 - CASE WHEN target THEN {_P} ELSE 1 - {_P} END) ** 2
  * -(target::INT * ln({_P}) + (1 - target::INT) * ln(1 - {_P}))), 6) AS focal, count(*) AS n FROM v_scored""")
def m04(s: Study) -> DataFrame:
    return rounded(LO.focal_loss(s.scored), "focal")


@query("m05_best_threshold", """
SELECT threshold AS best_threshold, round(csi, 6) AS best_csi, threshold IN (0.05, 0.98) AS at_edge FROM v_pooled
ORDER BY csi DESC, threshold LIMIT 1""")
def m05(s: Study) -> DataFrame:
    return rounded(V.best_threshold(V.pooled_scores(s.scored)), "best_csi")


@query("m06_select_metric", """
SELECT * FROM (SELECT 'pooled' AS metric, threshold AS best_threshold, round(csi, 6) AS best_csi FROM v_pooled ORDER BY csi DESC, threshold LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'far', threshold, round(csi, 6) FROM v_far ORDER BY csi DESC, threshold LIMIT 1)""")
def m06(s: Study) -> DataFrame:
    parts = [V.best_threshold(df).select(F.lit(n).alias("metric"), "best_threshold", r("best_csi", 6).alias("best_csi"))
             for n, df in (("pooled", V.pooled_scores(s.scored)), ("far", V.far_scores(s.scored)))]
    return parts[0].unionByName(parts[1])
