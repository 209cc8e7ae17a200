"""Hourly weather on the fire grids: which hours, gap filling, regridding and checks.

The hourly store is a table (fire_id, hour, iy, ix, u10, v10, t2m, rh2m, rh_derived); an hour is
filled where it has rows. `hour` counts hours since the epoch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perimeter.config import WEATHER, Settings
from perimeter.functions.geo import albers_to_lonlat, centre_of, fold_longitude, lonlat_to_albers, lonlat_to_lambert
from perimeter.functions.physics import fuel_moisture, humidity_from_dewpoint
from perimeter.operators.labels import cells_in_tiles
from perimeter.operators.ranking import exact_quantiles
from perimeter.sources import tables

FIELDS = ("u10", "v10", "t2m", "rh2m")

# --- which hours ----------------------------------------------------------------------------

def window_hours(windows: DataFrame, cfg: Settings, lags: tuple[int, ...] | None = None) -> DataFrame:
    """(fire_id, k, lag, hour) for every step window k of a usable window and every lag."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(cfg.t_steps - 1)))
    lag = F.explode(F.array(*[F.lit(x) for x in (lags or cfg.lags)]))
    return (windows.filter("usable").select("fire_id", "t_index", "bin", steps.alias("s"))
            .withColumn("lag", lag)
            .select("fire_id", (F.col("t_index") - F.col("s")).alias("k"), "lag",
                    ((F.col("bin") - F.col("s")) * cfg.window_hours - F.col("lag")).alias("hour")).distinct())


def needed_hours(windows: DataFrame, cfg: Settings) -> DataFrame:
    return window_hours(windows, cfg).select("fire_id", "hour").distinct()


def fan_out(needed: DataFrame, start_hour: int) -> tuple[DataFrame, DataFrame]:
    """(fires kept, totals): fires whose first hour precedes the archive are dropped, and each
    distinct hour is fetched once however many fires use it."""
    first = needed.groupBy("fire_id").agg(F.min("hour").alias("h0")).filter(F.col("h0") >= start_hour).select("fire_id")
    kept = needed.join(first, "fire_id", "left_semi")
    totals = kept.groupBy("hour").agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("fire_hours"), F.count("*").alias("unique_hours"))
    return kept, totals.withColumn("dedupe", F.col("fire_hours") / F.greatest("unique_hours", F.lit(1)))


def coverage(needed: DataFrame, present: DataFrame) -> DataFrame:
    """Needed, present and extra hours per fire; membership counts, not row counts."""
    both = needed.withColumn("_n", F.lit(1)).join(present.withColumn("_p", F.lit(1)), ["fire_id", "hour"], "full")
    n, p = F.col("_n").isNotNull(), F.col("_p").isNotNull()
    return (both.groupBy("fire_id").agg(
        F.sum(n.cast("int")).alias("hours_needed"), F.sum((n & p).cast("int")).alias("hours_present"),
        F.sum((p & ~n).cast("int")).alias("repair_hours"))
        .withColumn("pct", F.bround(F.col("hours_present") * 100 / F.greatest("hours_needed", F.lit(1)), 1)))


def gap_neighbours(listed: DataFrame, filled: DataFrame) -> DataFrame:
    """Hours beside an unfilled one that are not listed yet."""
    holes = listed.join(filled, ["fire_id", "hour"], "left_anti")
    step = F.explode(F.array(F.lit(-1), F.lit(1)))
    around = holes.withColumn("_d", step).select("fire_id", (F.col("hour") + F.col("_d")).alias("hour"))
    return around.distinct().join(listed, ["fire_id", "hour"], "left_anti")


def repair_plan(needed: DataFrame, available: DataFrame, rounds: int = 2) -> DataFrame:
    """Needed hours plus the neighbours of gaps, a bounded number of times: (fire_id, hour, round)."""
    listed = needed.select("fire_id", "hour", F.lit(0).alias("round"))
    for i in range(1, rounds + 1):
        keys = listed.select("fire_id", "hour")
        filled = keys.join(available.select("hour").distinct(), "hour", "left_semi").select("fire_id", "hour")
        listed = listed.unionByName(gap_neighbours(keys, filled).withColumn("round", F.lit(i)))
    return listed


# --- the source grid and the store ----------------------------------------------------------

def decode_weather(source: DataFrame) -> DataFrame:
    """Folded longitudes, and humidity derived from dewpoint where absent (flagged)."""
    derived = F.col("r2").isNull() & F.col("d2m").isNotNull()
    return source.select(
        "hour", "iy", "ix", fold_longitude(F.col("longitude")).alias("lon"), F.col("latitude").alias("lat"),
        "u10", "v10", "t2m", F.coalesce(F.col("r2"), humidity_from_dewpoint(F.col("t2m"), F.col("d2m"))).alias("rh2m"),
        derived.alias("rh_derived"))


def scan_weather(source: DataFrame) -> DataFrame:
    """Decoded cells, whole hours dropped where any cell misses a channel."""
    cells = decode_weather(source)
    missing = F.col("u10").isNull() | F.col("v10").isNull() | F.col("t2m").isNull() | F.col("rh2m").isNull()
    broken = cells.filter(missing).select("hour").distinct()
    return cells.join(broken, "hour", "left_anti")


def box_of(corners: DataFrame, margin_km: float) -> DataFrame:
    """(fire_id, lon_min, lat_min, lon_max, lat_max) of grid corners given as x, y rows, padded."""
    lon, lat = albers_to_lonlat(F.col("x"), F.col("y"))
    box = (corners.withColumn("_lon", lon).withColumn("_lat", lat).groupBy("fire_id")
           .agg(F.min("_lon").alias("lon_min"), F.min("_lat").alias("lat_min"), F.max("_lon").alias("lon_max"),
                F.max("_lat").alias("lat_max"), F.avg("_lat").alias("_mid")))
    dlat = margin_km / 111.0
    dlon = F.lit(margin_km) / (F.greatest(F.cos(F.radians("_mid")), F.lit(0.1)) * 111.0)
    return box.select("fire_id", (F.col("lon_min") - dlon).alias("lon_min"), (F.col("lat_min") - dlat).alias("lat_min"),
                      (F.col("lon_max") + dlon).alias("lon_max"), (F.col("lat_max") + dlat).alias("lat_max"))


def corners_of(df: DataFrame, x0: Column, x1: Column, y0: Column, y1: Column) -> DataFrame:
    pts = F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x in (x0, x1) for y in (y0, y1)])
    return df.select("fire_id", F.inline(pts))


def raster_bounds(grid: DataFrame, cfg: Settings) -> DataFrame:
    """Lon/lat box of each fire grid padded by the weather margin."""
    res = cfg.resolution_m
    corners = corners_of(grid, F.col("x0"), F.col("x0") + F.col("width") * res,
                         F.col("y1") - F.col("height") * res, F.col("y1"))
    return box_of(corners, cfg.weather_margin_km)


def crop_windows(bounds: DataFrame, cells: DataFrame, cell_deg: float = 0.25) -> DataFrame:
    """Index window (iy0..iy1, ix0..ix1) of the source cells inside each fire's box. A fire without any cell there has no window, so
    none of its hours is filled and its samples are pruned; the other fires go on.

    Cells and boxes meet on coarse degree bins, so the range join is an equi-join."""
    def bins(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low) / cell_deg).cast("int"), F.floor(F.col(high) / cell_deg).cast("int")))
    spread = bounds.withColumn("_bx", bins("lon_min", "lon_max")).withColumn("_by", bins("lat_min", "lat_max"))
    keyed = cells.withColumn("_bx", F.floor(F.col("lon") / cell_deg).cast("int")).withColumn(
        "_by", F.floor(F.col("lat") / cell_deg).cast("int"))
    inside = F.col("lon").between(F.col("lon_min"), F.col("lon_max")) & F.col("lat").between(F.col("lat_min"), F.col("lat_max"))
    return (keyed.join(spread, ["_bx", "_by"]).filter(inside).groupBy("fire_id")
            .agg(F.min("iy").alias("iy0"), F.max("iy").alias("iy1"), F.min("ix").alias("ix0"), F.max("ix").alias("ix1")))


def pin_windows(computed: DataFrame, root: str) -> DataFrame:
    """Windows once chosen stay, over runs: the table below `root` keeps the first window of each fire, and only fires it
    lacks are added. Stored indices count from a window's corner, so one that moved would displace every earlier row."""
    return tables.build_missing(computed, root, "fire_id")


def cut_hours(source: DataFrame, hours: DataFrame) -> DataFrame:
    """Source rows of the listed hours only, so that nothing else is decoded or shuffled."""
    return source.join(hours.select("hour").distinct(), "hour", "left_semi")


def cut_cells(cells: DataFrame, crops: DataFrame) -> DataFrame:
    """Source cells inside any fire's window only. Which hours are complete must be known from all cells."""
    def span(lo: str, hi: str) -> Column:
        return F.explode(F.sequence(F.col(lo), F.col(hi)))
    inside = crops.select(span("iy0", "iy1").alias("iy"), "ix0", "ix1").distinct().select("iy", span("ix0", "ix1").alias("ix")).distinct()
    return cells.join(inside, ["iy", "ix"], "left_semi")


def build_store(scan: DataFrame, crops: DataFrame, wanted: DataFrame, block: int = 16) -> DataFrame:
    """Store rows of the wanted (fire_id, hour). The windows of the fires that want an hour meet its
    cells on (hour, block of cells), so a row is made only where a fire wants that hour."""
    def blocks(lo: str, hi: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(lo) / block), F.floor(F.col(hi) / block)))
    windows = crops.withColumn("_by", blocks("iy0", "iy1")).withColumn("_bx", blocks("ix0", "ix1"))
    asked = wanted.select("fire_id", "hour").distinct().join(windows, "fire_id")
    keyed = scan.withColumn("_by", F.floor(F.col("iy") / block)).withColumn("_bx", F.floor(F.col("ix") / block))
    # Archive rows are exploded from few cells, so by size they would be taken for small and broadcast whole.
    return (keyed.hint("merge").join(asked, ["hour", "_by", "_bx"])
            .filter(F.col("iy").between(F.col("iy0"), F.col("iy1")) & F.col("ix").between(F.col("ix0"), F.col("ix1")))
            .select("fire_id", "hour", "iy", "ix", "lon", "lat", *FIELDS, "rh_derived"))


def upsert(fresh: DataFrame, root: str, overwrite: bool = False, block: int = 16) -> DataFrame:
    """The store below `root` after fresh rows have replaced those of the same (fire, hour, cell) and joined the others; returns
    it. Rows are kept by day and block of cells, and only the parts that fresh rows touch are written again."""
    day, by, bx = F.floor(F.col("hour") / 24), F.floor(F.col("iy") / block), F.floor(F.col("ix") / block)
    placed = fresh.withColumn("part", F.concat_ws("_", *[x.cast("string") for x in (day, by, bx)]))
    if overwrite:
        return tables.build_missing(placed, root, "part", ["fire_id", "hour"], overwrite=True).drop("part")
    return tables.merge_rows(placed, root, "part", ["fire_id", "hour", "iy", "ix"], ["fire_id", "hour"]).drop("part")


def bridge(needed: DataFrame, present: DataFrame, max_reach: int = 3) -> DataFrame:
    """Source hours for each needed one: itself, or the nearest filled hours within reach on both
    sides with the weight of the later. Hours that cannot be bridged have null sources."""
    keys = [c for c in needed.columns]
    offset = F.explode(F.sequence(F.lit(-max_reach), F.lit(max_reach)))
    tries = needed.withColumn("_o", offset).withColumn("_h", F.col("hour") + F.col("_o"))
    have = present.select("fire_id", F.col("hour").alias("_h"), F.lit(True).alias("_ok"))
    o = F.when(F.col("_ok"), F.col("_o"))
    near = (tries.join(have, ["fire_id", "_h"], "left").groupBy(*keys)
            .agg(F.max(F.when(o <= 0, o)).alias("_lo"), F.min(F.when(o >= 0, o)).alias("_hi")))
    ok = F.col("_lo").isNotNull() & F.col("_hi").isNotNull()
    gap = F.col("_hi") - F.col("_lo")
    return near.select(
        *keys, F.when(ok, F.col("hour") + F.col("_lo")).alias("lo"), F.when(ok, F.col("hour") + F.col("_hi")).alias("hi"),
        F.when(ok, F.when(gap == 0, 0.0).otherwise(-F.col("_lo") / F.when(gap > 0, gap))).alias("w"))


# --- regridding -------------------------------------------------------------------------------

def fit_affine(store_cells: DataFrame, max_residual: float = 5.0) -> DataFrame:
    """Origin and step of each fire's weather window in projected metres; fails where the window
    is not a regular grid of two to four kilometres. Input: distinct (fire_id, iy, ix, lon, lat)."""
    x, y = lonlat_to_lambert(F.col("lon"), F.col("lat"))
    pts = store_cells.withColumn("_x", x).withColumn("_y", y)
    here = pts.select("fire_id", "iy", "ix", "_x", "_y")
    right = here.select("fire_id", "iy", (F.col("ix") - 1).alias("ix"), F.col("_x").alias("_rx"))
    below = here.select("fire_id", (F.col("iy") - 1).alias("iy"), "ix", F.col("_y").alias("_dy"))
    steps = (here.join(right, ["fire_id", "iy", "ix"], "left").join(below, ["fire_id", "iy", "ix"], "left")
             .withColumn("sx", F.col("_rx") - F.col("_x")).withColumn("sy", F.col("_dy") - F.col("_y")))
    first = F.min_by(F.struct("_x", "_y"), F.struct("iy", "ix"))
    fit = steps.groupBy("fire_id").agg(
        F.avg("sx").alias("dx"), F.avg("sy").alias("dy"), F.min("sx").alias("_x0"), F.max("sx").alias("_x1"),
        F.min("sy").alias("_y0"), F.max("sy").alias("_y1"), first.alias("_o"), F.min("iy").alias("iy0"),
        F.max("iy").alias("iy1"), F.min("ix").alias("ix0"), F.max("ix").alias("ix1"))
    resid = F.greatest(F.col("_x1") - F.col("dx"), F.col("dx") - F.col("_x0"), F.col("_y1") - F.col("dy"), F.col("dy") - F.col("_y0"))
    good = (F.col("residual") <= max_residual) & F.abs("dx").between(2000.0, 4000.0)
    return (fit.withColumn("residual", resid)
            .filter(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("irregular weather grid: "), F.col("fire_id")))
                                                 .cast("boolean")))
            .select("fire_id", F.col("_o._x").alias("wx0"), F.col("_o._y").alias("wy0"), "dx", "dy", "residual",
                    "iy0", "iy1", "ix0", "ix1"))


def corner_table(cells: DataFrame, grid: DataFrame, fit: DataFrame, cfg: Settings) -> DataFrame:
    """Per fire cell the lower corner of its weather quad and the fractions inside it, clipped to
    the window. Depends on the cell only, so one table serves every hour."""
    frame = grid.select("fire_id", "x0", "y1").join(fit, "fire_id")
    x, y = centre_of(F.col("row"), F.col("col"), F.col("x0"), F.col("y1"), cfg.resolution_m)
    lon, lat = albers_to_lonlat(F.col("_x"), F.col("_y"))
    wx, wy = lonlat_to_lambert(F.col("_lon"), F.col("_lat"))
    placed = (cells.join(frame, "fire_id").withColumn("_x", x).withColumn("_y", y)
              .withColumn("_lon", lon).withColumn("_lat", lat))
    ny, nx = F.col("iy1") - F.col("iy0"), F.col("ix1") - F.col("ix0")
    r = F.least(F.greatest((wy - F.col("wy0")) / F.col("dy"), F.lit(0.0)), ny.cast("double"))
    c = F.least(F.greatest((wx - F.col("wx0")) / F.col("dx"), F.lit(0.0)), nx.cast("double"))
    qr, qc = F.least(F.floor("_r"), ny - 1), F.least(F.floor("_c"), nx - 1)
    return (placed.withColumn("_r", r).withColumn("_c", c)
            .select(*cells.columns, (qr + F.col("iy0")).cast("int").alias("qy"), (qc + F.col("ix0")).cast("int").alias("qx"),
                    (F.col("_r") - qr).alias("fr"), (F.col("_c") - qc).alias("fc")))


def quads(fields: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Coarse cells to quads (keys, qy, qx) holding the values of their four corners as structs."""
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    spread = fields.withColumn("_k", corner).select(
        *keys, (F.col("iy") - F.col("_k.a")).alias("qy"), (F.col("ix") - F.col("_k.b")).alias("qx"), "_k",
        F.struct(*values).alias("_v"))
    pick = [F.first(F.when((F.col("_k.a") == a) & (F.col("_k.b") == b), F.col("_v")), ignorenulls=True).alias(f"q{a}{b}")
            for a in (0, 1) for b in (0, 1)]
    full = F.col("q00").isNotNull() & F.col("q01").isNotNull() & F.col("q10").isNotNull() & F.col("q11").isNotNull()
    return spread.groupBy(*keys, "qy", "qx").agg(*pick).filter(full)


def interpolate(corners: DataFrame, quad: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """Bilinear values: one row per fine cell and quad key, no expansion to corners. Cells that name windows (`ks`) get values in these only."""
    fr, fc = F.col("fr"), F.col("fc")

    def value(v: str) -> Column:
        top = F.col(f"q00.{v}") * (1 - fc) + F.col(f"q01.{v}") * fc
        low = F.col(f"q10.{v}") * (1 - fc) + F.col(f"q11.{v}") * fc
        return (top * (1 - fr) + low * fr).alias(v)
    extra = [c for c in quad.columns if c not in ("qy", "qx", "q00", "q01", "q10", "q11") and c not in corners.columns]
    keep = [c for c in corners.columns if c not in ("qy", "qx", "fr", "fc", "ks")]
    met = corners.join(quad, [*on, "qy", "qx"])
    return (met.filter(F.array_contains("ks", F.col("k"))) if "ks" in corners.columns else met).select(*keep, *extra, *[value(v) for v in values])


def step_fields(store: DataFrame, plan: DataFrame, cfg: Settings) -> DataFrame:
    """Coarse weather of each step window: (fire_id, k, iy, ix) with u10/v10 at every lag and rh2m,
    t2m at the window itself. Windows with any hour that cannot be bridged are left out."""
    complete = (plan.groupBy("fire_id", "k").agg(F.max(F.col("lo").isNull()).alias("_bad")).filter(~F.col("_bad"))
                .select("fire_id", "k"))
    usable = plan.join(complete, ["fire_id", "k"], "left_semi").select("fire_id", "k", "lag", "lo", "hi", "w")
    low = store.select("fire_id", F.col("hour").alias("lo"), "iy", "ix", *[F.col(f).alias(f"{f}_lo") for f in FIELDS])
    # An hour that is itself present needs no second read; only bridged hours join their later side.
    base = usable.join(low, ["fire_id", "lo"])
    same = base.filter(F.col("lo") == F.col("hi")).select("fire_id", "k", "lag", "iy", "ix", *[F.col(f"{f}_lo").alias(f) for f in FIELDS])
    high = store.select("fire_id", F.col("hour").alias("hi"), "iy", "ix", *[F.col(f).alias(f"{f}_hi") for f in FIELDS])
    mixed = (base.filter(F.col("lo") < F.col("hi")).join(high, ["fire_id", "hi", "iy", "ix"])
             .select("fire_id", "k", "lag", "iy", "ix",
                     *[(F.col(f"{f}_lo") * (1 - F.col("w")) + F.col(f"{f}_hi") * F.col("w")).alias(f) for f in FIELDS]))
    rows = same.unionByName(mixed)

    def at(field: str, lag: int, name: str) -> Column:
        return F.max(F.when(F.col("lag") == lag, F.col(field))).alias(name)
    return rows.groupBy("fire_id", "k", "iy", "ix").agg(
        *[at("u10", x, f"u10_lag{x}") for x in cfg.lags], *[at("v10", x, f"v10_lag{x}") for x in cfg.lags],
        at("rh2m", 0, "rh2m"), at("t2m", 0, "t2m"))


def weather_cells(corners: DataFrame, fields: DataFrame) -> DataFrame:
    """All nine weather channels per (fire, window, cell). The moisture relation is nonlinear, so it
    is applied after regridding."""
    values = [c for c in WEATHER if c != "fosberg_10h"]
    out = interpolate(corners, quads(fields, ["fire_id", "k"], values), ["fire_id"], values)
    return out.withColumn("fosberg_10h", fuel_moisture(F.col("t2m"), F.col("rh2m")))


# --- checks -----------------------------------------------------------------------------------

def bridged_samples(index: DataFrame, plan: DataFrame, cfg: Settings) -> DataFrame:
    """Samples whose every step has weather: the pruned index."""
    bad = plan.filter(F.col("lo").isNull()).select("fire_id", "k").distinct()
    spoilt = (bad.withColumn("t_index", F.explode(F.sequence(F.col("k"), F.col("k") + cfg.t_steps - 1)))
              .select("fire_id", "t_index").distinct())
    return index.join(spoilt, ["fire_id", "t_index"], "left_anti")


_STATE = ("wind_speed", "rh", "t_c", "fosberg")


def validation(index: DataFrame, pruned: DataFrame, cells: DataFrame, cfg: Settings) -> DataFrame:
    """Per fire: samples kept and dropped and the mean state of its weather, averaged per kept sample
    (over the cells and steps of its tile) and then over samples. A state that is not finite fails.

    A tile's mean in one window serves every sample that shows this window at this place."""
    n = index.groupBy("fire_id").agg(F.count("*").alias("samples"))
    ok = pruned.groupBy("fire_id").agg(F.count("*").alias("ok"))
    place = ["fire_id", "k", "row0", "col0"]
    steps = pruned.select("sample_id", "fire_id", "row0", "col0",
                          F.explode(F.sequence(F.col("t_index") - (cfg.t_steps - 1), F.col("t_index"))).alias("k"))
    state = cells.select("fire_id", "k", "row", "col", F.hypot("u10_lag0", "v10_lag0").alias("wind_speed"), F.col("rh2m").alias("rh"),
                         (F.col("t2m") - 273.15).alias("t_c"), F.col("fosberg_10h").alias("fosberg"))
    means = [F.avg(c).alias(c) for c in _STATE]
    tiles = cells_in_tiles(steps.select(*place).distinct(), state, cfg.patch, ("fire_id", "k")).groupBy(*place).agg(*means)
    per_sample = steps.join(tiles, place).groupBy("fire_id", "sample_id").agg(*means)
    finite = sum((F.coalesce(F.abs(c) < float("inf"), F.lit(False)).cast("int") for c in _STATE), F.lit(0)) == len(_STATE)
    checked = per_sample.filter(F.when(finite, True).otherwise(
        F.raise_error(F.concat(F.lit("weather is not finite in sample "), F.col("sample_id"))).cast("boolean")))
    return (n.join(ok, "fire_id", "left").join(checked.groupBy("fire_id").agg(*means), "fire_id", "left")
            .withColumn("ok", F.coalesce("ok", F.lit(0))).withColumn("dropped", F.col("samples") - F.col("ok")))


def weather_medians(checked: DataFrame) -> DataFrame:
    """Median over fires of each column of the validated state: rows (field, median)."""
    tall = checked.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in _STATE])))
    return exact_quantiles(tall, "value", [0.5], ["field"]).select("field", F.col("quantile").alias("median"))


def guarded_prune(index: DataFrame, pruned: DataFrame, checked: DataFrame) -> DataFrame:
    """The pruned index, but only if every fire of the index was checked."""
    unchecked = index.select("fire_id").distinct().join(checked.select("fire_id"), "fire_id", "left_anti")
    missing = unchecked.agg(F.count("*")).scalar()
    return pruned.filter(F.when(missing == 0, True).otherwise(
        F.raise_error(F.lit("weather of some fires was not checked")).cast("boolean")))


def verify_store(needed: DataFrame, listed: DataFrame, filled: DataFrame) -> DataFrame:
    """Needed hours that are absent from the list, or listed without data (hollow)."""
    both = (needed.join(listed.withColumn("_l", F.lit(True)), ["fire_id", "hour"], "left")
            .join(filled.withColumn("_f", F.lit(True)), ["fire_id", "hour"], "left"))
    absent, hollow = F.col("_l").isNull(), F.col("_l").isNotNull() & F.col("_f").isNull()
    return (both.groupBy("fire_id").agg(F.count("*").alias("needed"), F.sum(absent.cast("int")).alias("absent"),
                                        F.sum(hollow.cast("int")).alias("hollow"))
            .withColumn("status", F.when((F.col("absent") == 0) & (F.col("hollow") == 0), "ok").otherwise("incomplete")))


def spot_check(sampled: DataFrame, store: DataFrame, fresh: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Largest difference between stored and fresh fields for sampled (fire_id, hour)."""
    key = ["fire_id", "hour", "iy", "ix"]
    side = fresh.select(*key, *[F.col(f).alias(f"_{f}") for f in FIELDS])
    diff = F.greatest(*[F.abs(F.col(f) - F.col(f"_{f}")) for f in FIELDS])
    return (store.join(sampled, ["fire_id", "hour"], "left_semi").join(side, key)
            .groupBy("fire_id", "hour").agg(F.max(diff).alias("max_diff"))
            .withColumn("ok", F.col("max_diff") < tolerance))


def coarse_wind(store: DataFrame, n: int = 12) -> DataFrame:
    """u and v on about n x n evenly spaced rows and columns of each window, with its mean
    temperature and humidity."""
    box = store.groupBy("fire_id").agg(F.min("iy").alias("a"), F.max("iy").alias("b"), F.min("ix").alias("c"), F.max("ix").alias("d"))

    def marks(lo: str, hi: str) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (
            F.floor((F.col(hi) - F.col(lo)) * i / (n - 1)) + F.col(lo)).cast("int")))
    ys = box.select("fire_id", F.explode(marks("a", "b")).alias("iy"))
    xs = box.select("fire_id", F.explode(marks("c", "d")).alias("ix"))
    mean = store.groupBy("fire_id", "hour").agg((F.avg("t2m") - 273.15).alias("t_c"), F.avg("rh2m").alias("rh"))
    return (store.join(ys, ["fire_id", "iy"], "left_semi").join(xs, ["fire_id", "ix"], "left_semi")
            .select("fire_id", "hour", "iy", "ix", "u10", "v10").join(mean, ["fire_id", "hour"]))


def wind_in_box(store: DataFrame, events: DataFrame, pad: float = 0.15) -> DataFrame:
    """Wind cells whose projected centre lies in the fire's detection box widened by `pad`."""
    x, y = lonlat_to_albers(F.col("lon"), F.col("lat"))
    dx, dy = (F.col("x_max") - F.col("x_min")) * pad, (F.col("y_max") - F.col("y_min")) * pad
    box = events.select("fire_id", (F.col("x_min") - dx).alias("_a"), (F.col("x_max") + dx).alias("_b"),
                        (F.col("y_min") - dy).alias("_c"), (F.col("y_max") + dy).alias("_d"))
    return (store.join(box, "fire_id").withColumn("x", x).withColumn("y", y)
            .filter(F.col("x").between(F.col("_a"), F.col("_b")) & F.col("y").between(F.col("_c"), F.col("_d")))
            .select("fire_id", "hour", "iy", "ix", "x", "y", "u10", "v10"))
