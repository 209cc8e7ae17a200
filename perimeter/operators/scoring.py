"""Cell-level burn probability: fitting, probing and stitching."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perimeter.config import CHANNEL_GROUPS, FUEL_CODES
from perimeter.functions.bins import csi
from perimeter.operators.cells import offset_array
from perimeter.operators.ranking import global_index, seed_order

RIDGE = 1e-4


@dataclass(frozen=True)
class CellModel:
    """A fitted logistic model: one weight per channel and fuel class (a fixed, small number)."""

    intercept: float
    weights: Mapping[str, float]
    fuel: Sequence[float]
    slope: float = 0.0  # bound of the gradient where a fit ended

    def logit(self) -> Column:
        """The linear score as a plain expression, so scoring needs no Python and no vectors."""
        z = F.element_at(F.array(*[F.lit(float(w)) for w in self.fuel]), F.col("fuel_idx").cast("int") + 1)
        for name, w in self.weights.items():
            z = z + F.col(name) * float(w)
        return z + self.intercept


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.exp(-z) + 1)


def _newton_sums(rows: DataFrame, model: CellModel, names: Sequence[str], pos_weight: float) -> DataFrame:
    """Per fuel class: weight, loss, and the sums of gradient and curvature over a constant and the channels."""
    cells = rows.select(F.col("fuel_idx").cast("int").alias("fuel"), model.logit().alias("z"), F.col("target").cast("double").alias("y"), F.lit(1.0).alias("x0"),
                        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names, 1)]).filter("z IS NOT NULL AND y IS NOT NULL")
    w, p = F.when(F.col("y") > 0, float(pos_weight)).otherwise(1.0), sigmoid(F.col("z"))
    loss = F.greatest("z", F.lit(0.0)) - F.col("y") * F.col("z") + F.log1p(F.exp(-F.abs("z")))
    cells = cells.withColumns({"w": w, "loss": w * loss, "g": w * (F.col("y") - p), "h": w * p * (1 - p)})
    x = [F.col(f"x{i}") for i in range(len(names) + 1)]
    gradient = F.array(*[F.sum(F.col("g") * v) for v in x])
    curvature = F.array(*[F.sum(F.col("h") * u * v) for i, u in enumerate(x) for v in x[i:]])
    return cells.groupBy("fuel").agg(F.sum("w").alias("w"), F.sum("loss").alias("loss"), gradient.alias("g"), curvature.alias("h"))


def fit_cells(training: DataFrame, channels: Sequence[str], pos_weight: float, ridge: float = RIDGE, tolerance: float = 1e-10,
              most: int = 60) -> CellModel:
    """Weighted logistic regression of `target` on normalised channels and one-hot fuel, by Newton steps.

    It minimises the weighted mean of the log loss plus ridge / 2 times the squared weights (not the intercept), which has
    one minimum. A step needs one aggregation: sums per fuel class, at most as many rows as there are classes. A step that
    does not lower the loss is halved. The fit ends after a step smaller than `tolerance` and reports the largest entry of the gradient
    before it; the step after which it ends squares the error, so this is an upper bound. Cells with a null channel, fuel or target
    take no part; without any cell all coefficients are 0. A fit that does not end within `most` steps raises."""
    names, classes = list(channels), len(FUEL_CODES) + 1
    n = len(names) + 1
    upper = np.triu_indices(n)
    shrunk = np.r_[0.0, np.ones(n - 1 + classes)] * ridge
    at, step, best = np.zeros(n + classes), np.zeros(n + classes), np.inf

    def model(v: np.ndarray, slope: float = 0.0) -> CellModel:
        return CellModel(float(v[0]), dict(zip(names, map(float, v[1:n]))), [float(x) for x in v[n:]], slope)
    for _ in range(most):
        sums = _newton_sums(training, model(at + step), names, pos_weight).collect()
        total = sum(r["w"] for r in sums)
        if not total:
            return model(at)
        loss = sum(r["loss"] for r in sums) / total + (shrunk * (at + step) ** 2).sum() / 2
        if loss > best + 1e-12:  # beyond the rounding of a sum
            step = step / 2
            continue
        at, best = at + step, loss
        slope, bend = -shrunk * at, np.diag(shrunk)
        for r in sums:
            f = n + r["fuel"]
            g, part = np.array(r["g"]) / total, np.zeros((n, n))
            part[upper] = np.array(r["h"]) / total
            slope[:n] += g
            slope[f] += g[0]
            bend[:n, :n] += part + np.triu(part, 1).T
            bend[f, f] += part[0, 0]
            bend[f, :n] += part[0]
            bend[:n, f] += part[0]
        step = np.linalg.solve(bend, slope)
        if np.abs(step).max() < tolerance:
            return model(at + step, float(np.abs(slope).max()))
    raise RuntimeError(f"no minimum after {most} steps: the last step was {np.abs(step).max():.1e}")


def score(cells: DataFrame, model: CellModel) -> DataFrame:
    return cells.withColumn("prob", sigmoid(model.logit()))


def stated_model(channels: Sequence[str]) -> CellModel:
    """Coefficients by a rule, to check scoring and probing apart from any fit."""
    return CellModel(-1.0, {c: (i * 7 % 11 - 5) / 10 for i, c in enumerate(channels)},
                     [(i * 5 % 9 - 4) / 20 for i in range(len(FUEL_CODES) + 1)])


def partners(samples: DataFrame, keys: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """A random cyclic permutation of the samples of each key: (sample_id, partner)."""
    by = [*keys, "_all"]
    ranked = global_index(samples.select(*keys, "sample_id", F.lit(0).alias("_all"), seed_order(seed, "sample_id").alias("_s")),
                          [*by, "_s", "sample_id"], "i")
    spans = ranked.groupBy(*by).agg(F.min("i").alias("_low"), F.count("*").alias("_n"))
    after = F.col("_low") + (F.col("i") - F.col("_low") + 1) % F.col("_n")
    return (ranked.join(spans, by).select("sample_id", after.alias("j"))
            .join(ranked.select(F.col("i").alias("j"), F.col("sample_id").alias("partner")), "j").select("sample_id", "partner"))


def occlusion_counts(cells: DataFrame, model: CellModel, threshold: float, mode: str = "zero", keys: Sequence[str] = (),
                     roi: Column | None = None) -> DataFrame:
    """Per group of channels: CSI, its drop and the mean absolute change of probability inside the
    region of interest (by default prob > 0.01 or target). Cells are (sample_id, r, c, channels,
    fuel_idx, target). All groups are scored in one pass; permuting takes the channels of a partner
    sample at the same place in the tile."""
    names = {g: held for g, cs in CHANNEL_GROUPS.items() if (held := [c for c in cs if c in model.weights])}
    # The score is linear before the sigmoid, so each group enters as one number per cell and a
    # partner sample contributes only these numbers, not its channels.
    parts = {f"_g{i}": sum((F.col(c) * float(model.weights[c]) for c in cs), F.lit(0.0)) for i, cs in enumerate(names.values())}
    small = cells.select(*keys, "sample_id", "r", "c", "target", *([roi.alias("_near")] if roi is not None else []),
                         model.logit().alias("_z"), *[e.alias(n) for n, e in parts.items()])
    if mode == "permute":
        pair = partners(cells.select(*keys, "sample_id").distinct(), keys)
        other = small.select(F.col("sample_id").alias("partner"), "r", "c", *[F.col(n).alias(f"o{n}") for n in parts])
        small = small.join(pair, "sample_id").join(other, ["partner", "r", "c"])
    swapped = {n: F.col(f"o{n}") if mode == "permute" else F.lit(0.0) for n in parts}
    probs = {"_q0": sigmoid(F.col("_z"))} | {f"_q{i + 1}": sigmoid(F.col("_z") - F.col(n) + swapped[n]) for i, n in enumerate(parts)}
    scored = small.withColumns(probs)
    inside = F.col("_near") if roi is not None else (F.col("_q0") > 0.01) | F.col("target")
    labels = ["none", *names]
    sums = [F.sum(inside.cast("int")).alias("roi")]
    for i in range(len(labels)):
        hit = F.col(f"_q{i}") > threshold
        sums += [F.sum((hit & F.col("target")).cast("int")).alias(f"tp{i}"), F.sum((hit & ~F.col("target")).cast("int")).alias(f"fp{i}"),
                 F.sum((~hit & F.col("target")).cast("int")).alias(f"fn{i}"),
                 F.coalesce(F.avg(F.when(inside, F.abs(F.col(f"_q{i}") - F.col("_q0")))), F.lit(0.0)).alias(f"dp{i}")]
    wide = scored.groupBy(*keys, "sample_id").agg(*sums)
    tall = F.inline(F.array(*[F.struct(F.lit(g).alias("grp"), *[F.col(f"{n}{i}").alias(n) for n in ("tp", "fp", "fn", "dp")])
                              for i, g in enumerate(labels)]))
    return wide.select(*keys, "sample_id", "roi", tall)


def occlusion(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Group means over samples and the drop against the untouched score."""
    mean = counts.groupBy(*keys, "grp").agg(F.avg(csi(F.col("tp"), F.col("fp"), F.col("fn"))).alias("csi"),
                                            F.avg("dp").alias("mean_abs_dp"), F.count("*").alias("samples"))
    base = mean.filter("grp = 'none'").select(*keys, F.col("csi").alias("_base"))
    joined = mean.join(base, list(keys)) if keys else mean.withColumn("_base", base.select("_base").scalar())
    return joined.filter("grp <> 'none'").withColumn("csi_drop", F.col("_base") - F.col("csi")).drop("_base")


def occlusion_pooled(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As `occlusion`, with hits and misses pooled over the samples of a key before they are scored and the
    change of probability averaged over all cells of interest."""
    moved = F.coalesce(F.try_divide(F.sum(F.col("dp") * F.col("roi")), F.sum("roi")), F.lit(0.0))
    total = counts.groupBy(*keys, "grp").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], moved.alias("mean_abs_dp"), F.count("*").alias("samples"))
    scored = total.select(*keys, "grp", csi(F.col("tp"), F.col("fp"), F.col("fn")).alias("csi"), "mean_abs_dp", "samples")
    base = scored.filter("grp = 'none'").select(*keys, F.col("csi").alias("_base"))
    return (scored.filter("grp <> 'none'").join(base, list(keys))
            .withColumn("csi_drop", F.col("_base") - F.col("csi")).drop("_base"))


def day_or_night(window_time: str = "window_time") -> Column:
    return F.when(F.hour(window_time) == 12, "day").otherwise("night")


def near_fire(tile_cells: DataFrame, patch: int, radius: int = 10) -> DataFrame:
    """Tile cells within `radius` rows and columns of a burned or target cell.

    A square is a row segment of column segments, so it is grown one axis at a time."""
    key = ["sample_id", "r", "c"]
    span = offset_array([(0, d) for d in range(-radius, radius + 1)])
    wide = (tile_cells.select(*key, F.explode(span).alias("_o")).select("sample_id", "r", (F.col("c") + F.col("_o.dc")).alias("c"))
            .filter(F.col("c").between(0, patch - 1)).distinct())
    return (wide.select(*key, F.explode(span).alias("_o")).select("sample_id", (F.col("r") + F.col("_o.dc")).alias("r"), "c")
            .filter(F.col("r").between(0, patch - 1)).distinct())


def stitch(tile_scores: DataFrame) -> DataFrame:
    """Mean probability over the tiles covering a fire cell; uncovered cells have no row.
    Input: (fire_id, t_index, row0, col0, r, c, prob)."""
    return (tile_scores.select("fire_id", "t_index", (F.col("row0") + F.col("r")).alias("row"), (F.col("col0") + F.col("c")).alias("col"), "prob")
            .groupBy("fire_id", "t_index", "row", "col").agg(F.avg("prob").alias("prob"), F.count("*").alias("tiles")))

