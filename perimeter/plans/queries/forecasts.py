"""Queries over forecasts of the study's own cells.

They use a model of stated coefficients, so that scoring, evaluation and probing can be checked cell by
cell; the fitted model goes through the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perimeter.config import CHANNEL_GROUPS
from perimeter.operators import labels as L
from perimeter.operators import metrics as V
from perimeter.operators import scoring as M
from perimeter.plans.checks import CH, P, counts_sql, csi_sql, edges_sql, right_closed_sql
from perimeter.plans.queries.scores import ap_sql, rounded
from perimeter.plans.queries.segments import r
from perimeter.plans.queries.tiles import SKILL, rounded_skill
from perimeter.plans.registry import query, view
from perimeter.plans.study import Study

_MODEL = M.stated_model(CH)


def _term(c: str) -> str:
    mean, std = (f"(SELECT {n} FROM v_stats WHERE channel = '{c}')" for n in ("mean", "std"))
    return f"({c} - {mean}) / {std} * {_MODEL.weights[c]!r}::DOUBLE"


GROUPS = {g: held for g, cs in CHANNEL_GROUPS.items() if (held := [c for c in cs if c in CH])}
_PARTS = ", ".join(f"{' + '.join(map(_term, cs))} AS g{i}" for i, cs in enumerate(GROUPS.values()))
view("v_held", f"""
SELECT a.sample_id, fire_id, a.r, a.c, a.target, a.burn_mask > 0.5 AS burned, CASE WHEN e.year = 2021 THEN 'val' ELSE 'test' END AS split,
  [{', '.join(f'{w!r}::DOUBLE' for w in _MODEL.fuel)}][CAST(fuel_idx AS INTEGER) + 1] + {' + '.join(map(_term, CH))} + ({_MODEL.intercept!r}) AS z, {_PARTS}
FROM v_asm a JOIN v_events e USING (fire_id) WHERE a.step = 2 AND e.year BETWEEN 2021 AND 2023""")
view("v_fc", """
SELECT *, CAST((dist >= 1)::INT + (dist >= 2)::INT + (dist >= 3)::INT + (dist >= 5)::INT + (dist >= 8)::INT
               + (dist >= 12)::INT + (dist >= 20)::INT + (dist >= 32)::INT AS INTEGER) AS band FROM (
  SELECT h.sample_id, h.fire_id, h.r, h.c, h.target, h.burned, h.split, 1 / (1 + exp(-h.z)) AS prob,
         coalesce(sqrt(d.d2::DOUBLE), 'infinity'::DOUBLE) AS dist
  FROM v_held h LEFT JOIN v_dist d ON (d.sample_id, d.r, d.c) = (h.sample_id, h.r, h.c)
  WHERE h.z IS NOT NULL)""")
view("v_fcscore", f"SELECT *, tp / greatest(tp + fp + fn, 1) AS csi FROM ({counts_sql('split', 'v_fc')})")
_CHOSEN = "(SELECT threshold FROM v_fcscore WHERE split = 'val' ORDER BY csi DESC, threshold LIMIT 1)"
_TEST = "(SELECT * FROM v_fc WHERE split = 'test')"
view("v_fcfire", f"""
SELECT fire_id, split, tp / greatest(tp + fp + fn, 1) AS csi, burned_px FROM ({counts_sql('split, fire_id', 'v_fc')})
JOIN (SELECT fire_id, count(*) AS burned_px FROM v_burn GROUP BY 1) USING (fire_id) WHERE threshold = {_CHOSEN}""")


def test_cells(s: Study) -> DataFrame:
    return s.forecast.filter("split = 'test'")


def fires(s: Study) -> DataFrame:
    """CSI of each fire at the threshold chosen on validation, and its size."""
    def build() -> DataFrame:
        chosen = V.chosen_threshold(V.pooled_scores(s.forecast, "split"))
        per = V.confusion_counts(s.forecast, ["split", "fire_id"]).filter(F.col("threshold") == chosen)
        scores = per.select("split", "fire_id", V.csi(F.col("tp"), F.col("fp"), F.col("fn")).alias("csi"))
        return scores.join(L.fire_sizes(s.burn), "fire_id")
    return s.stage("forecast_fires", build)


@query("fc01_confusion_counts", counts_sql("split, sample_id", "v_fc"))
def fc01(s: Study) -> DataFrame:
    return V.confusion_counts(s.forecast, ["split", "sample_id"])


@query("fc02_split_scores", f"SELECT *, {SKILL} FROM ({counts_sql('split', 'v_fc')})")
def fc02(s: Study) -> DataFrame:
    return V.pooled_scores(s.forecast, "split").select("split", "threshold", "tp", "fp", "fn", *rounded_skill())


@query("fc03_brier", f"""
SELECT round(avg(b), 6) AS brier, count(*) AS samples FROM (
  SELECT sum((prob - target::INT) ** 2) / {P * P} AS b FROM {_TEST} GROUP BY sample_id)""")
def fc03(s: Study) -> DataFrame:
    return rounded(V.brier(test_cells(s), P * P), "brier")


@query("fc04_chosen_threshold", f"""
SELECT 'validation' AS choice, threshold, round(csi, 6) AS csi FROM v_fcscore WHERE split = 'test' AND threshold = {_CHOSEN}
UNION ALL SELECT * FROM (SELECT 'test', threshold, round(csi, 6) FROM v_fcscore WHERE split = 'test' ORDER BY csi DESC, threshold LIMIT 1)""")
def fc04(s: Study) -> DataFrame:
    return rounded(V.transfer(V.pooled_scores(s.forecast, "split")), "csi")


@query("fc05_per_fire_csi", """
SELECT round(quantile_cont(csi, 0.25), 6) AS q25, round(quantile_cont(csi, 0.5), 6) AS median,
       round(quantile_cont(csi, 0.75), 6) AS q75, round(avg(csi), 6) AS mean, count(*) AS n FROM v_fcfire WHERE split = 'test'""")
def fc05(s: Study) -> DataFrame:
    return rounded(V.per_fire_summary(fires(s).filter("split = 'test'")), "q25", "median", "q75", "mean")


_TEST_FIRES = "(SELECT * FROM v_fcfire WHERE split = 'test')"


@query("fc09_size_quartiles", f"""
SELECT bin, count(*) AS n, round(avg(csi), 6) AS mean, round(median(csi), 6) AS median FROM (
  SELECT csi, CAST({right_closed_sql('burned_px', 'e')} AS INTEGER) AS bin
  FROM (SELECT *, {edges_sql('burned_px', _TEST_FIRES)} AS e FROM {_TEST_FIRES})) GROUP BY bin""")
def fc09(s: Study) -> DataFrame:
    return rounded(V.size_quartiles(fires(s).filter("split = 'test'")), "mean", "median")


_BINNED = f"""(SELECT csi, split, CAST({right_closed_sql('burned_px', 'e')} AS INTEGER) AS bin
  FROM (SELECT *, {edges_sql('burned_px', 'v_fcfire')} AS e FROM v_fcfire))"""


# The study has few held-out fires, so a bin counts from one fire of either split on (three by default).
@query("fc10_size_matched", f"""
SELECT bin, n_val, round(val_median, 6) AS val_median, n_test, round(test_median, 6) AS test_median,
       round(test_median - val_median, 6) + 0.0 AS gap FROM (
  SELECT bin, count(*) FILTER (split = 'val') AS n_val, median(csi) FILTER (split = 'val') AS val_median,
         count(*) FILTER (split = 'test') AS n_test, median(csi) FILTER (split = 'test') AS test_median
  FROM {_BINNED} GROUP BY bin) WHERE n_val >= 1 AND n_test >= 1""")
def fc10(s: Study) -> DataFrame:
    return rounded(V.size_matched(fires(s), 1), "val_median", "test_median", "gap")


@query("fc11_reweighted", f"""
SELECT round(v, 6) AS val_median, round(t, 6) AS test_median, round(m, 6) AS val_reweighted,
       round(v - m, 6) + 0.0 AS composition, round(t - m, 6) + 0.0 AS residual FROM (
  SELECT median(csi) FILTER (split = 'val') AS v, median(csi) FILTER (split = 'test') AS t,
    (SELECT sum(w * m) / sum(w) FROM (SELECT bin, count(*) FILTER (split = 'test') AS w,
       median(csi) FILTER (split = 'val') AS m FROM {_BINNED} GROUP BY bin) WHERE w > 0 AND m IS NOT NULL) AS m
  FROM {_BINNED})""")
def fc11(s: Study) -> DataFrame:
    return rounded(V.reweighted(fires(s)), "val_median", "test_median", "val_reweighted", "composition", "residual")


@query("fc12_band_confusion", f"""
SELECT *, CASE WHEN tp + fp + fn > 0 THEN round(tp / (tp + fp + fn), 6) END AS csi FROM ({counts_sql('band', _TEST)})""")
def fc12(s: Study) -> DataFrame:
    return rounded(V.band_scores(test_cells(s)), "csi")


_FAR = f"(SELECT *, tp / greatest(tp + fp + fn, 1) AS csi FROM ({counts_sql('', '(SELECT * FROM ' + _TEST + ' WHERE band >= 6)')}))"


@query("fc13_far_csi", f"""
SELECT 'pooled_best' AS choice, threshold, round(csi, 6) AS csi FROM {_FAR}
WHERE threshold = (SELECT threshold FROM v_fcscore WHERE split = 'test' ORDER BY csi DESC, threshold LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'own_best', threshold, round(csi, 6) FROM {_FAR} ORDER BY csi DESC, threshold LIMIT 1)
UNION ALL SELECT 'stored', threshold, round(csi, 6) FROM {_FAR} WHERE threshold = 0.7""")
def fc13(s: Study) -> DataFrame:
    return rounded(V.far_csi(test_cells(s), 0.7), "csi")


@query("fc14_skill_by_distance", f"""
SELECT band, n, pos, tp, fp, fn, round(pos / n, 6) AS base_rate, round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 6) AS csi,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS pod, round(fp / nullif(tp + fp, 0), 6) AS far,
       round(pos / sum(pos) OVER (), 6) AS growth_share FROM (
  SELECT band, count(*) AS n, count(*) FILTER (target) AS pos, count(*) FILTER (prob >= 0.5 AND target) AS tp,
         count(*) FILTER (prob >= 0.5 AND NOT target) AS fp, count(*) FILTER (prob < 0.5 AND target) AS fn
  FROM {_TEST} GROUP BY band)""")
def fc14(s: Study) -> DataFrame:
    return rounded(V.skill_by_distance(test_cells(s), 0.5), "base_rate", "csi", "pod", "far", "growth_share")


@query("fc15_average_precision", f"""
SELECT split, pos, neg, round(ap, 6) AS ap, round(pos / (pos + neg), 6) AS base_rate, round(ap / (pos / (pos + neg)), 4) AS lift
FROM ({ap_sql('split', 'v_fc')})""")
def fc15(s: Study) -> DataFrame:
    ap = V.average_precision(V.pr_histogram(s.forecast, ["split"]), ["split"])
    return ap.select("split", "pos", "neg", r("ap", 6).alias("ap"), r("base_rate", 6).alias("base_rate"), r("lift", 4).alias("lift"))


@query("fc17_cumulative_ap", f"""
SELECT split, pos, neg, round(ap, 6) AS ap FROM ({ap_sql('split', "(SELECT split, CASE WHEN burned THEN 1.0 ELSE prob END AS prob, burned OR target AS target FROM v_fc)")})""")
def fc17(s: Study) -> DataFrame:
    cum = V.cumulative_target(s.forecast, F.col("burned"))
    return rounded(V.average_precision(V.pr_histogram(cum, ["split"]), ["split"]).select("split", "pos", "neg", "ap"), "ap")


@query("fc18_per_fire_ap", f"""
SELECT round(quantile_cont(ap, 0.25), 6) AS q25, round(median(ap), 6) AS median, round(quantile_cont(ap, 0.75), 6) AS q75,
       round(avg(ap), 6) AS mean, count(*) AS n FROM ({ap_sql('fire_id', _TEST)}) WHERE pos > 0""")
def fc18(s: Study) -> DataFrame:
    ap = V.average_precision(V.pr_histogram(test_cells(s), ["fire_id"]), ["fire_id"]).filter("pos > 0")
    return rounded(V.per_fire_summary(ap, "ap"), "q25", "median", "q75", "mean")


@query("fc19_reliability", f"""
SELECT CAST(least(greatest(len(list_filter([0, 0.01, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99, 1.0]::DOUBLE[],
         lambda e: prob >= e)) - 1, 0), 13) AS INTEGER) AS bin, count(*) AS n, round(avg(prob), 6) AS mean_prob,
       round(avg(target::INT), 6) AS hit_rate FROM {_TEST} GROUP BY 1""")
def fc19(s: Study) -> DataFrame:
    return rounded(V.reliability(test_cells(s)), "mean_prob", "hit_rate")


@query("fc24_paired_comparison", f"""
SELECT n, round(mean_diff, 6) + 0.0 AS mean_diff, round(median_diff, 6) + 0.0 AS median_diff, wins, losses,
  round(least(1.0, 2 * (SELECT sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2.0)))
   FROM (SELECT UNNEST(range(least(wins, losses) + 1)) AS i))), 6) AS p_sign FROM (
  SELECT count(*) AS n, avg(d) AS mean_diff, median(d) AS median_diff, count(*) FILTER (d > 0) AS wins,
         count(*) FILTER (d < 0) AS losses FROM (
    SELECT b.csi - a.csi AS d FROM ({csi_sql('fire_id', 0.5, 'v_fc')}) a JOIN ({csi_sql('fire_id', 0.2, 'v_fc')}) b USING (fire_id)))""")
def fc24(s: Study) -> DataFrame:
    both = V.paired_comparison(V.csi_at(s.forecast, 0.5, "fire_id"), V.csi_at(s.forecast, 0.2, "fire_id"))
    return rounded(both, "mean_diff", "median_diff", "p_sign")


# --- probing --------------------------------------------------------------------------------------

_N = len(GROUPS)
_NAMES = "['none', " + ", ".join(f"'{g}'" for g in GROUPS) + "]"


def probs_sql(swapped: str) -> str:
    return ", ".join(["1 / (1 + exp(-h.z)) AS q0"] + [f"1 / (1 + exp(-(h.z - h.g{i}{swapped.format(i)}))) AS q{i + 1}" for i in range(_N)])


def _tall(source: str, inside: str) -> str:
    return f"""(SELECT sample_id, split, target, {inside} AS inside, q0, UNNEST([{', '.join(f'q{i}' for i in range(_N + 1))}]) AS q,
  UNNEST({_NAMES}) AS grp FROM {source})"""


_COUNTS = """count(*) FILTER (q > 0.5 AND target) AS tp, count(*) FILTER (q > 0.5 AND NOT target) AS fp,
 count(*) FILTER (NOT q > 0.5 AND target) AS fn"""


def per_sample_sql(source: str) -> str:
    return f"""SELECT * FROM (WITH m AS (SELECT grp, avg(tp / greatest(tp + fp + fn, 1)) AS csi, avg(dp) AS dp, count(*) AS samples FROM (
    SELECT sample_id, grp, {_COUNTS}, coalesce(avg(abs(q - q0)) FILTER (inside), 0) AS dp FROM {_tall(source, 'q0 > 0.01 OR target')} GROUP BY ALL) GROUP BY grp)
SELECT grp, round(csi, 6) AS csi, round(dp, 6) AS mean_abs_dp, samples, round((SELECT csi FROM m WHERE grp = 'none') - csi, 6) + 0.0 AS csi_drop
FROM m WHERE grp <> 'none')"""


def _next(part: str) -> str:
    w = f"({part} ORDER BY md5('0:' || sample_id), sample_id"
    return (f"(SELECT sample_id, coalesce(lead(sample_id) OVER {w}), first_value(sample_id) OVER {w})) AS partner "
            "FROM (SELECT DISTINCT sample_id, split FROM v_held))")


def swapped_sql(part: str, extra: str = "") -> str:
    return f"""(SELECT h.sample_id, h.split, h.target, {probs_sql(' + o.g{}')}{extra} FROM v_held h JOIN {_next(part)} p USING (sample_id)
  JOIN v_held o ON o.sample_id = p.partner AND o.r = h.r AND o.c = h.c"""


view("v_near", """
SELECT DISTINCT sample_id, r + d AS r, c FROM (
  SELECT DISTINCT sample_id, r, c + e AS c FROM (SELECT sample_id, r, c FROM v_tcum UNION SELECT sample_id, r, c FROM v_ty), range(-10, 11) t(e)
  WHERE sample_id IN (SELECT sample_id FROM v_held)), range(-10, 11) u(d)""")


def rounded_probe(df: DataFrame) -> DataFrame:
    return rounded(df, "csi", "mean_abs_dp", "csi_drop")


@query("m07_stated_zero", per_sample_sql(f"(SELECT h.sample_id, h.split, h.target, {probs_sql('')} FROM v_held h)"))
def m07_zero(s: Study) -> DataFrame:
    return rounded_probe(M.occlusion(M.occlusion_counts(s.held_out, s.stated_model, 0.5, "zero")))


@query("m07_stated_permute", per_sample_sql(swapped_sql("") + ")"))
def m07_permute(s: Study) -> DataFrame:
    return rounded_probe(M.occlusion(M.occlusion_counts(s.held_out, s.stated_model, 0.5, "permute")))


_NEARBY = swapped_sql("PARTITION BY split", ", n.sample_id IS NOT NULL AS near") + """
  LEFT JOIN v_near n ON (n.sample_id, n.r, n.c) = (h.sample_id, h.r, h.c))"""


POOLED_SQL = f"""
SELECT * FROM (WITH m AS (SELECT split, grp, count(DISTINCT sample_id) AS samples, {_COUNTS}, coalesce(avg(abs(q - q0)) FILTER (inside), 0) AS dp
  FROM {_tall(_NEARBY, 'near')} GROUP BY split, grp),
s AS (SELECT *, tp / greatest(tp + fp + fn, 1) AS csi FROM m)
SELECT s.split, s.grp, round(s.csi, 6) AS csi, round(s.dp, 6) AS mean_abs_dp, s.samples, round(b.csi - s.csi, 6) + 0.0 AS csi_drop
FROM s JOIN s b ON b.split = s.split AND b.grp = 'none' WHERE s.grp <> 'none')"""


@query("m08_stated_by_split", POOLED_SQL)
def m08_split(s: Study) -> DataFrame:
    near = M.near_fire(s.tile_marks, P).withColumn("near", F.lit(True))
    cells = s.held_out.join(near, ["sample_id", "r", "c"], "left").join(s.splits.select("fire_id", "split"), "fire_id")
    counts = M.occlusion_counts(cells, s.stated_model, 0.5, "permute", ["split"], F.coalesce("near", F.lit(False)))
    return rounded_probe(M.occlusion_pooled(counts, ["split"]))
