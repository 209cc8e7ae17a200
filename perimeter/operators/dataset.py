"""Assembling, normalising and augmenting sample cells."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perimeter.config import BAND_EDGES, DIRECTION_GROUPS, EAST_CHANNELS, NORTH_CHANNELS, Settings
from perimeter.operators import distance as near
from perimeter.operators.labels import cells_in_tiles
from perimeter.operators.metrics import distance_band
from perimeter.operators.terrain import apply_elevation_mode
from perimeter.operators.weather import weather_cells
from perimeter.storage import materialize

UNSCALED = ("burn_mask",)


def shown(cells: DataFrame, samples: DataFrame, cfg: Settings, side: int = 8) -> DataFrame:
    """`cells` (fire_id, row, col, ...) with `ks`, the windows in which a step of a sample shows their block of `side` cells."""
    def blocks(c: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(c) / side), F.floor((F.col(c) + cfg.patch - 1) / side)))
    tiles = step_tiles(samples, cfg).select("fire_id", "k", "row0", "col0").distinct()
    used = tiles.withColumn("_br", blocks("row0")).withColumn("_bc", blocks("col0")).groupBy("fire_id", "_br", "_bc").agg(F.collect_set("k").alias("ks"))
    keyed = cells.withColumn("_br", F.floor(F.col("row") / side)).withColumn("_bc", F.floor(F.col("col") / side))
    return keyed.join(used, ["fire_id", "_br", "_bc"]).drop("_br", "_bc")


def ground_cells(cells: DataFrame, static: DataFrame, first: DataFrame, cfg: Settings) -> DataFrame:
    """`cells` (fire_id, row, col, ...) with their static channels and the window they first burn in."""
    ground = apply_elevation_mode(static, cfg.elevation_mode).drop("height", "width")
    cell = ["fire_id", "row", "col"]
    return cells.join(ground.join(first, cell, "left"), cell)


def masked_windows(cells: DataFrame, cfg: Settings, burn: DataFrame | None = None) -> DataFrame:
    """Every channel per (fire, window k, cell) but those of a tile, from cells with weather and ground. Values depend on fire, window and cell
    only, so they are joined once and shared by all overlapping tiles and steps. The mask shows all burned cells so far or, in
    incremental mode, those that burned in the window (`burn`: fire_id, t_index, row, col)."""
    if cfg.burn_mode == "incremental":
        if burn is None:
            raise ValueError("incremental masks need the burn cells of each window")
        cell = ["fire_id", "row", "col"]
        new = burn.select("fire_id", F.col("t_index").alias("k"), "row", "col").distinct().withColumn("_new", F.lit(1.0))
        cells, mask = cells.join(new, [*cell, "k"], "left"), F.coalesce("_new", F.lit(0.0))
    else:
        mask = F.coalesce(F.col("first_t") <= F.col("k"), F.lit(False)).cast("double")
    return (cells.withColumn("burn_mask", mask)
            .select("fire_id", "k", "row", "col", "first_t", "fuel_idx", *[c for c in cfg.channels if c != "downwind"]))


def cell_windows(corners: DataFrame, fields: DataFrame, static: DataFrame, first: DataFrame, cfg: Settings, burn: DataFrame | None = None) -> DataFrame:
    """`masked_windows` of the cells of `corners`. Cells meet the ground before the weather, while they are one row each and not one per window."""
    return masked_windows(weather_cells(ground_cells(corners, static, first, cfg), fields), cfg, burn)


def step_tiles(samples: DataFrame, cfg: Settings, steps: Sequence[int] | None = None) -> DataFrame:
    """Samples times steps with the window k each step looks at, oldest step first."""
    step = F.explode(F.array(*[F.lit(s) for s in (steps or range(cfg.t_steps))])).alias("step")
    return (samples.select("sample_id", "fire_id", F.col("t_index").alias("t"), "row0", "col0", step)
            .withColumn("k", F.col("t") - (cfg.t_steps - 1) + F.col("step")))


def assemble(samples: DataFrame, cells: DataFrame, cfg: Settings, steps: Sequence[int] | None = None) -> DataFrame:
    """(sample_id, fire_id, step, r, c, channels..., fuel_idx, target) for every cell of every tile; `downwind`, which
    depends on what burns in the tile, is made here."""
    placed = cells_in_tiles(step_tiles(samples, cfg, steps), cells, cfg.patch, ("fire_id", "k"))
    target = F.coalesce(F.col("first_t") == F.col("t") + 1, F.lit(False))
    plain = [c for c in cfg.channels if c != "downwind"]
    out = placed.select("sample_id", "fire_id", "step", (F.col("row") - F.col("row0")).alias("r"), (F.col("col") - F.col("col0")).alias("c"),
                        *plain, "fuel_idx", target.alias("target"))
    if cfg.downwind:
        out = downwind(out, cfg.patch).select(*out.columns[:5], *cfg.channels, "fuel_idx", "target")
    return out


def norm_stats(assembled: DataFrame, channels: Sequence[str]) -> DataFrame:
    """(channel, mean, std, note): population moments of the training cells, floored; the mask stays
    unscaled and signed directions share one spread about zero per group."""
    moments = [f(c).alias(f"{n}_{c}") for c in channels for n, f in
               (("m", F.avg), ("s", F.stddev_pop), ("q", lambda c: F.avg(F.col(c) * F.col(c))))]
    wide = assembled.agg(*moments)
    group = {c: g for g in DIRECTION_GROUPS for c in g}
    rows = []
    for c in channels:
        if c in UNSCALED:
            mean, std, note = F.lit(0.0), F.lit(1.0), "unscaled"
        elif c in group:
            members = [m for m in group[c] if m in channels]
            total = sum((F.col(f"q_{m}") for m in members[1:]), F.col(f"q_{members[0]}"))
            mean, std, note = F.lit(0.0), F.greatest(F.sqrt(total / len(members)), F.lit(1e-6)), "direction"
        else:
            mean, std, note = F.col(f"m_{c}"), F.greatest(F.col(f"s_{c}"), F.lit(1e-6)), "moments"
        rows.append(F.struct(F.lit(c).alias("channel"), mean.alias("mean"), std.alias("std"), F.lit(note).alias("note")))
    return wide.select(F.inline(F.array(*rows)))


def normalise(assembled: DataFrame, stats: DataFrame, channels: Sequence[str]) -> DataFrame:
    """(x - mean) / std; the few statistics travel as one scalar row."""
    def pick(c: str, stat: str) -> Column:
        return F.max(F.when(F.col("channel") == c, F.col(stat)))
    table = stats.agg(F.struct(*[pick(c, n).alias(f"{n}_{c}") for c in channels for n in ("mean", "std")])).scalar()
    keyed = assembled.withColumn("_s", table)
    return keyed.withColumns({c: (F.col(c) - F.col(f"_s.mean_{c}")) / F.col(f"_s.std_{c}") for c in channels}).drop("_s")


def flip(cells: DataFrame, ew: Column, ns: Column, patch: int) -> DataFrame:
    """Mirror tiles and negate the channels that point along the mirrored axis."""
    names = cells.columns
    out = (cells.withColumn("_ew", ew).withColumn("_ns", ns)
           .withColumn("c", F.when(F.col("_ew"), patch - 1 - F.col("c")).otherwise(F.col("c")))
           .withColumn("r", F.when(F.col("_ns"), patch - 1 - F.col("r")).otherwise(F.col("r"))))
    for flag, group in (("_ew", EAST_CHANNELS), ("_ns", NORTH_CHANNELS)):
        out = out.withColumns({c: F.when(F.col(flag), -F.col(c)).otherwise(F.col(c)) for c in group if c in names})
    return out.drop("_ew", "_ns")


def coin(seed: int, place: int, *keys: str) -> Column:
    """A fair coin per key that does not depend on partitioning; `place` picks independent coins."""
    text = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return F.substring(text, place, 1) < "8"


_WORD = (1 << 32) - 1


def _uniform(key: Column, salt: Column) -> Column:
    """A uniform in (0, 1) by multiply-shift hashing; `salt` keeps keys of different samples apart. Every round
    uses its input once, so the expression stays small enough to be compiled."""
    mixed = key.bitwiseAND(F.lit(_WORD))
    for factor in (1103515245, 73244475, 1640531527, 22695477):
        mixed = F.shiftright(mixed.bitwiseXOR(salt) * factor, 16).bitwiseAND(F.lit(_WORD))
    return (mixed.cast("double") + 0.5) / float(1 << 32)


def jitter(cells: DataFrame, channels: Sequence[str], sigma: float, drop: float, patch: int, seed: int = 0) -> DataFrame:
    """Gaussian noise on every channel but the mask, and channels dropped for a whole sample. Draws
    are hashes of sample, cell and channel, so a recomputed task repeats them."""
    noisy = [c for c in channels if c not in UNSCALED]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("sample_id").cast("string")))
    words = {f"_w{i}": F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(3)}
    place = (F.col("step").cast("long") * patch + F.col("r")) * patch + F.col("c")
    draws = cells.withColumns(words).withColumn("_key", F.col("_w0") + place * 64)
    new = {}
    for i, ch in enumerate(noisy):
        u, v = (_uniform(F.col("_key") + (2 * i + half), F.col("_w1")) for half in (0, 1))
        noise = F.sqrt(F.log(u) * -2) * F.cos(v * (2 * np.pi))
        gone = _uniform(F.col("_w2") + i, F.col("_w1")) < drop
        new[ch] = F.when(gone, 0.0).otherwise(F.col(ch) + noise * sigma)
    return draws.withColumns(new).select(*cells.columns)


# --- distance to the burned area -------------------------------------------------------------

def distance_to_burn(burned: DataFrame, keys: list[str], patch: int, tiles: DataFrame) -> DataFrame:
    """(keys, r, near) per line of every tile of `tiles`: packed nearest burned cells as `distance` describes them, null
    in tiles without burned cells (infinite distance), which are one row of null line."""
    lines = near.nearest_lines(burned, keys, patch)
    return tiles.select(*keys).join(lines, keys, "left")


def with_distance(cells: DataFrame, patch: int) -> DataFrame:
    """Adds `dist`, in cells, to the nearest `burned` cell of the tile: 0 on burned cells, infinite in a tile
    without any."""
    lines = near.nearest_lines(cells.filter("burned").select("sample_id", "r", "c"), ["sample_id"], patch)
    placed = near.with_nearest(cells, lines, ["sample_id"], "_near")
    dist = F.sqrt(near.squared(F.col("_near"), patch).cast("double"))
    return placed.withColumn("dist", F.coalesce(dist, F.lit(float("inf")))).drop("_near")


def downwind(assembled: DataFrame, patch: int) -> DataFrame:
    """Adds `downwind`: wind along the outward direction from the nearest burning cell of the same
    step; 0 on burning cells and in tiles without any."""
    keys = ["sample_id", "step"]
    lines = near.nearest_lines(assembled.filter("burn_mask > 0.5").select(*keys, "r", "c"), keys, patch)
    at = F.col("_near")
    d2, nr, nc = near.squared(at, patch), near.row_of(at, patch), near.col_of(at, patch)
    field = ((F.col("c") - nc) * F.col("u10_lag0") + (nr - F.col("r")) * F.col("v10_lag0")) / F.sqrt(d2.cast("double"))
    placed = near.with_nearest(assembled, lines, keys, "_near")
    return placed.withColumn("downwind", F.when(d2 > 0, field).otherwise(0.0)).drop("_near")


def pack_tiles(assembled: DataFrame, columns: Sequence[str], patch: int) -> DataFrame:
    """(sample_id, step, channel, values): dense float arrays of patch x patch places, row-major, for channels and whatever else is
    wanted per cell (fuel, target, band). Every cell has its place, and a place without a cell holds zero.

    A group is one tile. A blank for each place is sorted in behind the cell of that place, and the first of each place stays."""
    place = (F.col("r") * patch + F.col("c")).cast("int").alias("place")
    cell = F.struct(place, F.lit(False).alias("blank"), *[F.col(c).cast("float").alias(c) for c in columns])
    blanks = F.transform(F.sequence(F.lit(0), F.lit(patch * patch - 1)), lambda i: F.struct(
        i.alias("place"), F.lit(True).alias("blank"), *[F.lit(0.0).cast("float").alias(c) for c in columns]))
    tiles = assembled.groupBy("sample_id", "step").agg(F.collect_list(cell).alias("_c"))
    tiles = tiles.select("sample_id", "step", F.array_sort(F.concat("_c", blanks)).alias("_t"))
    first = F.filter("_t", lambda x, i: (i == 0) | (x["place"] != F.get("_t", i - 1)["place"]))
    tiles = tiles.select("sample_id", "step", first.alias("_t"))
    packed = F.inline(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"_t.{c}").alias("values")) for c in columns]))
    return tiles.select("sample_id", "step", packed)


def base_rates(samples: DataFrame, tile_cells: DataFrame, patch: int) -> DataFrame:
    """(band, n_pixels, n_positive, base_rate) over unburned cells of tiles holding burned cells; an empty band has no rate.

    `tile_cells` has burned (`y` false) and target (`y` true) cells per sample. Pixels are counted on tile lines;
    only target cells, which are few, are looked up one by one."""
    keyed = tile_cells.join(samples.select("sample_id"), "sample_id", "left_semi")
    lines = materialize(near.nearest_lines(keyed.filter(~F.col("y")).select("sample_id", "r", "c"), ["sample_id"], patch))
    pixels = near.band_counts(lines, BAND_EDGES, patch)
    grown = near.with_nearest(keyed.filter("y").select("sample_id", "r", "c"), lines, ["sample_id"]).filter(F.col("near") >= patch * patch)
    band = distance_band(F.sqrt(near.squared(F.col("near"), patch).cast("double")))
    positive = grown.groupBy(band.alias("band")).agg(F.count("*").alias("n_positive"))
    counted = pixels.join(positive, "band", "left").withColumn("n_positive", F.coalesce("n_positive", F.lit(0).cast("long")))
    return counted.select("band", "n_pixels", "n_positive",
                          (F.col("n_positive") / F.nullif("n_pixels", F.lit(0))).alias("base_rate"))


def wind_growth(samples_cells: DataFrame, wind: DataFrame, least: int = 20) -> DataFrame:
    """Angle between growth and wind per sample. `samples_cells` as in `base_rates`; `wind` has the
    tile mean (u, v) per sample."""
    y = F.col("y")
    centre = samples_cells.groupBy("sample_id").agg(
        F.count(F.when(~y, 1)).alias("n_burned"), F.count(F.when(y, 1)).alias("n_grown"),
        F.avg(F.when(~y, F.col("r"))).alias("br"), F.avg(F.when(~y, F.col("c"))).alias("bc"),
        F.avg(F.when(y, F.col("r"))).alias("gr"), F.avg(F.when(y, F.col("c"))).alias("gc"))
    big = centre.filter((F.col("n_burned") >= least) & (F.col("n_grown") >= least)).join(wind, "sample_id")
    moved = (big.withColumn("east", F.col("gc") - F.col("bc")).withColumn("north", F.col("br") - F.col("gr"))
             .withColumn("growth", F.hypot("east", "north")).withColumn("speed", F.hypot("u", "v"))
             .filter("growth >= 1e-6 and speed >= 1e-6"))
    cos = (F.col("east") * F.col("u") + F.col("north") * F.col("v")) / (F.col("growth") * F.col("speed"))
    clipped = F.least(F.greatest(F.col("cos"), F.lit(-1.0)), F.lit(1.0))
    return (moved.withColumn("cos", cos).withColumn("angle", F.degrees(F.acos(clipped)))
            .select("sample_id", "n_grown", "growth", "speed", "cos", "angle"))


