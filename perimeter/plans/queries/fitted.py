"""Queries over the fitted model. The SQL of its weights fits it as well, by Newton steps that eliminate the
fuel classes first; for queries beyond the weights, fit and scoring together take SQL over a minute, so they have none."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perimeter.config import FUEL_CODES
from perimeter.operators import metrics as V
from perimeter.operators import scoring as M
from perimeter.plans.checks import CH, P
from perimeter.plans.queries.forecasts import rounded_probe
from perimeter.plans.queries.scores import rounded
from perimeter.plans.queries.tiles import rounded_skill
from perimeter.plans.registry import query, view
from perimeter.plans.study import Study

STEPS = 9  # of the SQL alone; errors square, and after eight they are below 1e-7 on the given tables


def newton_views(cells: str, n: int, classes: int, ridge: float = M.RIDGE, steps: int = STEPS) -> Iterator[tuple[str, str]]:
    """Views that fit `cells` (f: fuel class; y, w, x0 to x{n-1}, of which x0 is 1), the last of which, v_coef, has lists b and u of weights."""
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    at = {ij: k + 1 for k, ij in enumerate(pairs)}
    yield "v_fitsize", f"SELECT sum(w) AS total FROM {cells}"
    yield "v_coef0", f"SELECT list_resize([]::DOUBLE[], {n}, 0.0) AS b, list_resize([]::DOUBLE[], {classes}, 0.0) AS u"
    for s in range(steps):
        z = " + ".join(f"b[{i + 1}] * x{i}" for i in range(n)) + " + u[f + 1]"
        g = ", ".join(f"sum(e * x{i})" for i in range(n))
        h = ", ".join(f"sum(v{i} * x{j})" for i, j in pairs)
        v = ", ".join(f"w * p * (1 - p) / total * x{i} AS v{i}" for i in range(n))
        yield f"v_sums{s}", f"""SELECT f, g, h, g[1] - {ridge} * u[f + 1] AS gu, h[1] + {ridge} AS d FROM (
          SELECT f, [{g}] AS g, [{h}] AS h FROM (SELECT *, w * (y - p) / total AS e, {v} FROM (
            SELECT *, 1 / (1 + exp(-({z}))) AS p FROM {cells}, v_coef{s}, v_fitsize)) GROUP BY f), v_coef{s}"""
        lines = ", ".join("[" + ", ".join(
            f"sum(h[{at[min(i, j), max(i, j)]}] - h[{i + 1}] * h[{j + 1}] / d)" + (f" + {ridge}" if i == j > 0 else "") for j in range(n))
            + f", sum(g[{i + 1}] - h[{i + 1}] * gu / d)" + (f" - {ridge} * any_value(b[{i + 1}])" if i else "") + "]" for i in range(n))
        yield f"v_rest{s}", f"""SELECT 0 AS k, [{lines}] AS m FROM v_sums{s}, v_coef{s}
          UNION ALL SELECT k + 1, list_transform(m, lambda line, i: CASE WHEN i = k + 1 THEN list_transform(line, lambda v: v / line[k + 1])
            ELSE list_transform(line, lambda v, j: v - line[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM v_rest{s} WHERE k < {n}"""
        moved = f"(SELECT list_transform(m, lambda line: line[{n + 1}]) AS db FROM v_rest{s} WHERE k = {n})"
        yield f"v_coef{s + 1}", f"""SELECT list_transform(c.b, lambda v, i: v + x.db[i]) AS b,
          (SELECT list(c.u[e + 1] + coalesce((t.gu - list_dot_product(t.h[1:{n}], x.db)) / t.d, 0) ORDER BY e)
           FROM range({classes}) q(e) LEFT JOIN v_sums{s} t ON t.f = q.e) AS u FROM v_coef{s} c, {moved} x"""
    yield "v_coef", f"SELECT b, u FROM v_coef{steps}"


def _scaled(c: str) -> str:
    return f"({c} - (SELECT mean FROM v_stats WHERE channel = '{c}')) / (SELECT std FROM v_stats WHERE channel = '{c}')"


view("v_posweight", f"""
SELECT (count(*) * {P * P} - sum(n_target_px)) / greatest(sum(n_target_px), 1) AS pw
FROM v_sample JOIN v_events e USING (fire_id) WHERE e.year BETWEEN 2015 AND 2020""")
view("v_fitcell", f"""
SELECT * FROM (SELECT CAST(fuel_idx AS INTEGER) AS f, target::INT::DOUBLE AS y, CASE WHEN target THEN pw ELSE 1 END AS w, 1.0::DOUBLE AS x0,
  {', '.join(f'{_scaled(c)} AS x{i}' for i, c in enumerate(CH, 1))} FROM v_train, v_posweight WHERE step = 2)
WHERE f + {' + '.join(f'x{i}' for i in range(1, len(CH) + 1))} IS NOT NULL""")
for _name, _sql in newton_views("v_fitcell", len(CH) + 1, len(FUEL_CODES) + 1):
    view(_name, _sql)

@query("m01_coefficients", f"""
SELECT name, round(weight, 6) + 0.0 AS weight FROM (SELECT UNNEST({['intercept', *CH]}) AS name, UNNEST(b) AS weight FROM v_coef
  UNION ALL SELECT 'fuel ' || (i - 1), u[i] FROM v_coef, range(1, {len(FUEL_CODES) + 2}) t(i))""")
def m01_coefficients(s: Study) -> DataFrame:
    """The fitted weights, from the cells of the training fires."""
    m = s.model
    rows = [("intercept", m.intercept), *m.weights.items(), *[(f"fuel {i}", w) for i, w in enumerate(m.fuel)]]
    return rounded(s.spark.createDataFrame(rows, "name string, weight double"), "weight")


@query("m01_cell_classifier")
def m01(s: Study) -> DataFrame:
    """Scores of the fitted model per split; the threshold is the one chosen on validation."""
    cells = M.score(s.held_out, s.model).join(s.splits.select("fire_id", "split"), "fire_id")
    scores = s.stage("fitted_scores", lambda: V.pooled_scores(cells, "split"))
    return scores.select("split", "threshold", "tp", "fp", "fn", *rounded_skill(), (F.col("threshold") == V.chosen_threshold(scores)).alias("chosen"))


@query("m07_occlusion_zero")
def m07_zero(s: Study) -> DataFrame:
    return rounded_probe(M.occlusion(M.occlusion_counts(s.held_out, s.model, 0.5, "zero")))


@query("m07_occlusion_permute")
def m07_permute(s: Study) -> DataFrame:
    return rounded_probe(M.occlusion(M.occlusion_counts(s.held_out, s.model, 0.5, "permute")))


@query("m08_day_night_occlusion")
def m08(s: Study) -> DataFrame:
    near = M.near_fire(s.tile_marks, P).withColumn("near", F.lit(True))
    when = s.samples.select("sample_id", M.day_or_night().alias("period"))
    cells = s.held_out.join(near, ["sample_id", "r", "c"], "left").join(when, "sample_id")
    counts = M.occlusion_counts(cells, s.model, 0.5, "permute", ["period"], F.coalesce("near", F.lit(False)))
    return rounded_probe(M.occlusion_pooled(counts, ["period"]))
