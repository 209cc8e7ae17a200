"""Label windows and burn cells of every fire in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perimeter.config import Settings
from perimeter.functions.geo import cell_of
from perimeter.functions.times import at_hour
from perimeter.operators.cells import WIDTH, disk, grow_and_close, to_rows
from perimeter.operators.segmentation import in_outage, window_bin

CELL = ["fire_id", "row", "col"]


def fire_grid(events: DataFrame, cfg: Settings) -> DataFrame:
    """(fire_id, x0, y1, width, height): the detections' box plus margin, snapped outwards."""
    res, m = cfg.resolution_m, cfg.grid_margin_m
    x0, x1 = F.floor((F.col("x_min") - m) / res) * res, F.ceil((F.col("x_max") + m) / res) * res
    y0, y1 = F.floor((F.col("y_min") - m) / res) * res, F.ceil((F.col("y_max") + m) / res) * res
    return (events.filter("keep")
            .select("fire_id", x0.alias("x0"), y1.alias("y1"),
                    ((x1 - x0) / res).cast("int").alias("width"), ((y1 - y0) / res).cast("int").alias("height")))


def bin_counts(labelled: DataFrame, cfg: Settings) -> DataFrame:
    return labelled.groupBy("fire_id", window_bin(cfg.window_hours).alias("bin")).agg(F.count("*").alias("n"))


def label_windows(labelled: DataFrame, cfg: Settings) -> DataFrame:
    """One row per fire and window from its first to its last detection.

    The window function runs over a fire's windows (calendar length), after detections have
    been combined per window."""
    counts = bin_counts(labelled, cfg)
    spine = (counts.groupBy("fire_id").agg(F.min("bin").alias("b0"), F.max("bin").alias("b1"))
             .select("fire_id", F.posexplode(F.expr("sequence(b0, b1)")).alias("t_index", "bin")))
    earlier = (Window.partitionBy("fire_id").orderBy("t_index")
               .rowsBetween(Window.unboundedPreceding, -1))
    last_seen = F.last(F.when(F.col("has_det"), F.col("bin")), ignorenulls=True).over(earlier)
    hours = cfg.window_hours
    out = (spine.join(counts, ["fire_id", "bin"], "left")
           .withColumn("n", F.coalesce("n", F.lit(0))).withColumn("has_det", F.col("n") > 0)
           .withColumn("gap_h", F.coalesce((F.col("bin") - last_seen) * hours, F.lit(0)))
           .withColumn("gap_flag", F.col("gap_h") > cfg.gap_flag_hours)
           .withColumn("_s", F.col("bin") * hours * 3600).withColumn("_e", F.col("_s") + 1)
           .withColumn("no_data", in_outage_start("_s", cfg)))
    return (out.withColumn("usable", F.col("has_det") & ~F.col("gap_flag") & ~F.col("no_data"))
            .withColumn("_h", F.col("bin") * hours).withColumn("window_time", at_hour("_h"))
            .select("fire_id", "t_index", "bin", "window_time", F.col("n").alias("n_det"), "has_det", "gap_h",
                    "gap_flag", "no_data", "usable"))


def in_outage_start(start_s: str, cfg: Settings) -> Column:
    """Whether a window starts inside [d0, d1 + 1 day) of any outage."""
    test = F.lit(False)
    for d0, d1 in cfg.no_data_windows:
        low = F.expr(f"datediff(date'{d0}', date'1970-01-01') * 86400L")
        high = F.expr(f"(datediff(date'{d1}', date'1970-01-01') + 1) * 86400L")
        test = test | ((F.col(start_s) >= low) & (F.col(start_s) < high))
    return test


def point_cells(labelled: DataFrame, grid: DataFrame, windows: DataFrame, cfg: Settings) -> DataFrame:
    """Distinct (fire_id, t_index, row, col) holding a detection."""
    row, col = cell_of(F.col("x"), F.col("y"), F.col("x0"), F.col("y1"), cfg.resolution_m)
    frame = windows.groupBy("fire_id").agg(F.min("bin").alias("b0")).join(grid, "fire_id")
    # Written detections compress well: broadcast for their size on disk, they would leave all work to the task that holds the few frames.
    return (labelled.hint("merge").join(frame, "fire_id")
            .select("fire_id", (window_bin(cfg.window_hours) - F.col("b0")).cast("int").alias("t_index"),
                    row.alias("row"), col.alias("col")).distinct())


def burn_cells(labelled: DataFrame, grid: DataFrame, windows: DataFrame, cfg: Settings) -> DataFrame:
    """New-burn cells per window: detections rasterised, dilated and closed."""
    return grow_and_close(point_cells(labelled, grid, windows, cfg), ["fire_id", "t_index"],
                          disk(cfg.dilate_radius), disk(cfg.close_radius))


def label_manifest(windows: DataFrame, burn: DataFrame, grid: DataFrame) -> DataFrame:
    per_fire = windows.groupBy("fire_id").agg(
        F.count("*").alias("windows"), F.sum(F.col("usable").cast("int")).alias("usable"),
        F.sum(F.col("gap_flag").cast("int")).alias("gaps"), F.sum(F.col("has_det").cast("int")).alias("observed"))
    return (per_fire.join(grid.select("fire_id", "height", "width"), "fire_id")
            .join(fire_sizes(burn), "fire_id", "left").withColumn("burned_px", F.coalesce("burned_px", F.lit(0))))


def first_burn(burn: DataFrame) -> DataFrame:
    """First window each cell burns in; a cell is in the cumulative mask at t iff first_t <= t."""
    return burn.groupBy(*CELL).agg(F.min("t_index").alias("first_t"))


def targets(first: DataFrame, horizon: int = 1) -> DataFrame:
    """Target cells per prediction window t: first burned in t+1 .. t+horizon."""
    steps = F.explode(F.sequence(F.col("first_t") - horizon, F.col("first_t") - 1))
    return first.select("fire_id", steps.alias("t_index"), "row", "col").filter("t_index >= 0")


def fire_sizes(burn: DataFrame) -> DataFrame:
    """New-burn cells summed over windows: a cell burning in two windows counts twice."""
    return burn.groupBy("fire_id").agg(F.count("*").alias("burned_px"))


def most_active_windows(windows: DataFrame, burn: DataFrame, n: int = 3, horizon: int = 1) -> DataFrame:
    """The n usable windows of each fire with most burned cells; a fire's last `horizon` windows have no target and are left out."""
    counts = burn.groupBy("fire_id", "t_index").agg(F.count("*").alias("new_px"))
    order = Window.partitionBy("fire_id").orderBy(F.desc("new_px"), "t_index")
    ends = windows.groupBy("fire_id").agg((F.max("t_index") + 1 - horizon).alias("_end"))
    return (windows.filter("usable").join(ends, "fire_id").filter("t_index < _end").join(counts, ["fire_id", "t_index"])
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
            .select("fire_id", "t_index", "window_time", "new_px"))


def burn_steps(samples: DataFrame, cells: DataFrame, cfg: Settings, cumulative: bool = True) -> DataFrame:
    """Burned cells of each sample's tile at each of its steps, oldest step first.

    `cells` is the first-burn table when cumulative, else the new-burn table. Cells meet tiles on
    (fire, block of a tile's side); new-burn cells also on the window, since a step shows one only."""
    tiles = samples.select("sample_id", "fire_id", F.col("t_index").alias("t"), "row0", "col0")
    step = F.explode(F.sequence(F.lit(0), F.lit(cfg.t_steps - 1)))
    window = F.col("t") - (cfg.t_steps - 1 - F.col("step"))
    if cumulative:
        hit = cells_in_tiles(tiles, cells, cfg.patch).filter("first_t <= t").withColumn("step", step).filter(F.col("first_t") <= window)
    else:
        hit = cells_in_tiles(tiles.withColumn("step", step).withColumn("t_index", window), cells, cfg.patch, ("fire_id", "t_index"))
    return hit.select("sample_id", "step", (F.col("row") - F.col("row0")).alias("r"),
                                    (F.col("col") - F.col("col0")).alias("c"))


def burn_step_rows(samples: DataFrame, burn: DataFrame, cfg: Settings) -> DataFrame:
    """New-burn cells of each sample's tile at each of its steps, as bit rows (sample_id, step, r, c0, bits): bit i is column c0 + i of
    the tile, and no bit lies outside of it.

    Cells are packed before they are shuffled, and segments meet tiles on (fire, window, block of a tile's side in rows, segment)."""
    step = F.explode(F.sequence(F.lit(0), F.lit(cfg.t_steps - 1)))
    tiles = (samples.select("sample_id", "fire_id", F.col("t_index").alias("t"), "row0", "col0", step.alias("step"))
             .withColumn("t_index", F.col("t") - (cfg.t_steps - 1 - F.col("step"))).drop("t"))
    met = cut_rows(rows_in_tiles(tiles, to_rows(burn, ["fire_id", "t_index"]), cfg.patch, ("fire_id", "t_index")), cfg.patch)
    return met.select("sample_id", "step", (F.col("row") - F.col("row0")).alias("r"), (F.col("blk") * WIDTH - F.col("col0")).alias("c0"), "bits")


def cut_rows(rows: DataFrame, patch: int) -> DataFrame:
    """Bit rows that met tiles without the bits outside of the tile; rows left without any are dropped."""
    inside = F.expr(f"shiftleft(1L, cast(least({patch} - (blk * {WIDTH} - col0), {WIDTH}) as int)) - shiftleft(1L, cast(greatest(col0 - blk * {WIDTH}, 0) as int))")
    return rows.withColumn("bits", F.col("bits").bitwiseAND(inside)).filter("bits <> 0")


def rows_in_tiles(tiles: DataFrame, rows: DataFrame, patch: int, on: tuple[str, ...] = ("fire_id",)) -> DataFrame:
    """As `cells_in_tiles` for bit rows, which meet tiles on a block of a tile's side in rows and a segment."""
    def block(c: Column, side: int) -> Column:
        return F.floor(c / side).cast("int")
    spread = (tiles.withColumn("_br", F.explode(F.sequence(block(F.col("row0"), patch), block(F.col("row0") + (patch - 1), patch))))
              .withColumn("blk", F.explode(F.sequence(block(F.col("col0"), WIDTH), block(F.col("col0") + (patch - 1), WIDTH)))))
    met = rows.withColumn("_br", block(F.col("row"), patch)).join(spread, [*on, "_br", "blk"])
    return met.filter(F.col("row").between(F.col("row0"), F.col("row0") + (patch - 1))).drop("_br")


def cells_in_tiles(tiles: DataFrame, cells: DataFrame, patch: int, on: tuple[str, ...] = ("fire_id",)) -> DataFrame:
    """Join cells to the tiles covering them. A tile spans at most 2 x 2 blocks of its own side,
    so tiles are expanded to their blocks and the range join becomes an equi-join."""
    def block(name: str) -> Column:
        return F.floor(F.col(name) / patch).cast("int")
    spread = (tiles.withColumn("_br", F.explode(F.sequence(block("row0"), F.floor((F.col("row0") + patch - 1) / patch).cast("int"))))
              .withColumn("_bc", F.explode(F.sequence(block("col0"), F.floor((F.col("col0") + patch - 1) / patch).cast("int")))))
    keyed = cells.withColumn("_br", block("row")).withColumn("_bc", block("col"))
    inside = F.col("row").between(F.col("row0"), F.col("row0") + patch - 1) & \
        F.col("col").between(F.col("col0"), F.col("col0") + patch - 1)
    return keyed.join(spread, [*on, "_br", "_bc"]).filter(inside).drop("_br", "_bc")


def window_emptiness(labelled: DataFrame, widths: tuple[int, ...] = (3, 6, 12, 24)) -> DataFrame:
    """Share of windows without a detection for several window lengths, over all fires."""
    width = F.explode(F.array(*[F.lit(w) for w in widths])).alias("window_h")
    occupied = (labelled.select("fire_id", "t_s", width)
                .select("fire_id", "window_h", F.floor(F.col("t_s") / (F.col("window_h") * 3600)).alias("bin")).distinct())
    spans = (occupied.groupBy("fire_id", "window_h")
             .agg((F.max("bin") - F.min("bin") + 1).alias("n"), F.count("*").alias("seen")))
    return (spans.groupBy("window_h").agg(F.sum("n").alias("windows"), F.sum(F.col("n") - F.col("seen")).alias("empty"))
            .withColumn("share_empty", F.col("empty") / F.col("windows")))
