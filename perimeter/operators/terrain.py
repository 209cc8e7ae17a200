"""Static cells: resampling, terrain derivatives and fuel."""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perimeter.config import FUEL_CODES, FUEL_GROUPS, STATIC, Settings
from perimeter.operators.ranking import exact_quantiles
from perimeter.storage import deal, materialize, release

CELL = ["fire_id", "row", "col"]


def last_finite(*held: Column) -> Column:
    """What `mosaic` gives a cell that has its tiles beside it, as structs (tile, value): no shuffle brings them together."""
    if len(held) == 1:
        return F.when(~F.isnan(held[0]["value"]), held[0]["value"])
    return F.greatest(*[F.when(t["value"].isNotNull() & ~F.isnan(t["value"]), t) for t in held])["value"]


def mosaic(tiles: DataFrame, value: str = "value") -> DataFrame:
    """Tiles merged in name order, the last finite value winning: rows (arow, acol, value)."""
    finite = tiles.filter(F.col(value).isNotNull() & ~F.isnan(value))
    return finite.groupBy("arow", "acol").agg(F.max_by(value, "tile").alias(value))


def grid_lines(grid: DataFrame, res: int) -> DataFrame:
    """Every line of every fire grid, with its absolute row and the absolute column of its first cell."""
    lines = grid.select("fire_id", "height", "width", (-F.col("y1") / res).cast("int").alias("_r"), (F.col("x0") / res).cast("int").alias("acol0"),
                        F.explode(F.expr("sequence(0, height - 1)")).alias("row"))
    return lines.select("fire_id", "row", "height", "width", (F.col("_r") + F.col("row")).alias("arow"), "acol0")


def grid_cells(grid: DataFrame, res: int) -> DataFrame:
    """Every cell of every fire grid with its absolute index (arow counts southwards)."""
    return (deal(grid_lines(grid, res), "fire_id", "row").withColumn("col", F.explode(F.expr("sequence(0, width - 1)")))
            .select("fire_id", "row", "col", "height", "width", "arow", (F.col("acol0") + F.col("col")).alias("acol")))


def covered_places(lines: DataFrame, line: str, low: str, high: str, out: str) -> DataFrame:
    """(line, out): every place of a line that any of its intervals low..high covers, once. Intervals are shuffled, not places: in order of
    their start each adds what lies beyond all before it. A window runs over the intervals of one line."""
    before = Window.partitionBy(line).orderBy(low, high).rowsBetween(Window.unboundedPreceding, -1)
    dealt = deal(lines.select(line, low, high), line)
    new = dealt.withColumn("_a", F.greatest(F.col(low), F.max(high).over(before) + 1)).filter(F.col("_a") <= F.col(high))
    return new.select(line, F.explode(F.sequence("_a", high)).alias(out))


_SEGMENT = 32


def segments_of(cells: DataFrame, row: str, col: str) -> DataFrame:
    """Cells as bit rows (row, _blk, _bits): bit i is column 32 _blk + i. They combine before they are shuffled."""
    return (cells.groupBy(row, F.shiftright(col, 5).alias("_blk"))
            .agg(F.bit_or(F.expr(f"shiftleft(1L, cast({col} & 31 as int))")).alias("_bits")))


def intervals_of(cells: DataFrame, row: str, col: str) -> DataFrame:
    """(row, _low, _high): runs of cells, cut at segments; a segment of several runs gives its cells one by one."""
    first, n = F.bit_count(F.expr("(_bits & -_bits) - 1")), F.bit_count("_bits")
    run = F.expr("shiftright(_bits, cast(_first as int)) = shiftleft(1L, cast(_n as int)) - 1")
    one = F.array(F.struct(F.col("_first").alias("a"), (F.col("_first") + F.col("_n") - 1).alias("b")))
    single = F.transform(F.filter(F.sequence(F.lit(0), F.lit(_SEGMENT - 1)), lambda i: F.getbit("_bits", i) == 1),
                         lambda i: F.struct(i.alias("a"), i.alias("b")))
    spans = segments_of(cells, row, col).withColumn("_first", first).withColumn("_n", n).withColumn("_s", F.explode(F.when(run, one).otherwise(single)))
    at = F.col("_blk") * _SEGMENT
    return spans.select(row, (at + F.col("_s.a")).alias("_low"), (at + F.col("_s.b")).alias("_high"))


def crop_dem(cells: DataFrame, dem: DataFrame) -> DataFrame:
    """The statewide raster shares the snapped 100 m origin, so resampling it is an equi-join."""
    return cells.join(dem, ["arow", "acol"], "left")


def coverage(elevation: DataFrame, minimum: float) -> DataFrame:
    """Share of cells with a value per fire, and whether the fire is accepted."""
    share = F.avg(F.col("dem").isNotNull().cast("double"))
    return (elevation.groupBy("fire_id").agg(share.alias("coverage"))
            .withColumn("status", F.when(F.col("coverage") < minimum, "refused: coverage").otherwise("ok")))


def grid_coverage(grid: DataFrame, dem: DataFrame, res: int, minimum: float) -> DataFrame:
    """`coverage` of whole grids, counted on bit rows: segments of 32 cells are shuffled, not cells."""
    low, high = F.col("acol0"), F.col("acol0") + F.col("width") - 1
    spread = grid_lines(grid, res).withColumn("_blk", F.explode(F.sequence(F.shiftright(low, 5), F.shiftright(high, 5))))
    inside = F.expr(f"shiftleft(1L, cast(least(acol0 + width - _blk * {_SEGMENT}, {_SEGMENT}) as int)) - shiftleft(1L, cast(greatest(acol0 - _blk * {_SEGMENT}, 0) as int))")
    seen = segments_of(dem.filter("dem IS NOT NULL"), "arow", "acol")
    met = spread.select("fire_id", "height", "width", "arow", "_blk", inside.alias("_in")).hint("merge").join(seen, ["arow", "_blk"], "left")
    share = F.sum(F.bit_count(F.expr("_bits & _in"))) / F.first(F.col("height").cast("long") * F.col("width"))
    return (met.groupBy("fire_id").agg(share.alias("coverage")).withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
            .withColumn("status", F.when(F.col("coverage") < minimum, "refused: coverage").otherwise("ok")))


def accepted_fires(grid: DataFrame, dem: DataFrame, cfg: Settings) -> DataFrame:
    """Fires that get static cells: covered well enough, and not without any elevation, which leaves no median to fill with."""
    return grid_coverage(grid, dem, cfg.resolution_m, cfg.min_coverage).filter("status = 'ok' and coverage > 0").select("fire_id")


def filled_elevation(grid: DataFrame, dem: DataFrame, cfg: Settings, cover: DataFrame | None = None, accepted: DataFrame | None = None) -> DataFrame:
    """Cells of accepted fires with `dem`, holes filled, and what `cover` has of them. Other fires are left out before anything is shuffled."""
    ok = accepted_fires(grid, dem, cfg) if accepted is None else accepted
    cells = crop_dem(grid_cells(grid.join(ok, "fire_id", "left_semi"), cfg.resolution_m), dem)
    # Both joins are on the absolute cell, so the cells of the grids are shuffled once for them.
    elevation = materialize((cells if cover is None else cells.hint("merge").join(cover, ["arow", "acol"], "left")).drop("arow", "acol"))
    release(grid.sparkSession)
    return fill_with_median(elevation)


def fill_with_median(elevation: DataFrame) -> DataFrame:
    """Holes take the fire's median; the median comes from a distributed sort, so no fire is buffered."""
    med = exact_quantiles(elevation, "dem", [0.5], ["fire_id"]).select("fire_id", F.col("quantile").alias("_m"))
    return elevation.hint("merge").join(med, "fire_id").withColumn("dem", F.coalesce("dem", "_m")).drop("_m")


def _gradient(value: str, line: list[str], along: str, size: str, res: float) -> Column:
    """Central differences inside, one-sided at the ends."""
    w = Window.partitionBy(*line).orderBy(along)
    before, after, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    return (F.when(F.col(along) == 0, (after - here) / res)
            .when(F.col(along) == F.col(size) - 1, (here - before) / res)
            .otherwise((after - before) / (2 * res)))


def _line_mean(value: str, line: list[str], along: str, size: str, half: int) -> Column:
    """Mean of 2 half + 1 cells along a line, the end cells repeated beyond the ends."""
    w = Window.partitionBy(*line).orderBy(along).rowsBetween(-half, half)
    short = F.greatest(half - F.col(along), F.lit(0))
    over = F.greatest(half - (F.col(size) - 1 - F.col(along)), F.lit(0))
    total = F.sum(value).over(w) + F.first(value).over(w) * short + F.last(value).over(w) * over
    return total / (2 * half + 1)


def tpi_half_width(radius_m: float, res: float) -> int:
    size = max(round(2 * radius_m / res) | 1, 3)
    return size // 2


def derivatives(elevation: DataFrame, res: float, tpi_radius_m: float = 300.0) -> DataFrame:
    """slope, aspect_sin, aspect_cos and tpi from `dem`. All windows along one axis share a sort,
    and a window never holds more than one line of one raster."""
    half = tpi_half_width(tpi_radius_m, res)
    row_line, col_line = ["fire_id", "row"], ["fire_id", "col"]
    east = elevation.withColumns({"_e": _gradient("dem", row_line, "col", "width", res),
                                  "_m": _line_mean("dem", row_line, "col", "width", half)})
    both = east.withColumns({"_s": _gradient("dem", col_line, "row", "height", res),
                             "_f": _line_mean("_m", col_line, "row", "height", half)})
    north = -F.col("_s")
    slope = F.degrees(F.atan(F.hypot(F.col("_e"), north)))
    aspect = F.atan2(-F.col("_e"), -north)
    flat = F.col("slope") < 0.1
    return (both.withColumn("slope", slope)
            .withColumn("aspect_sin", F.when(flat, 0.0).otherwise(F.sin(aspect)))
            .withColumn("aspect_cos", F.when(flat, 0.0).otherwise(F.cos(aspect)))
            .withColumn("tpi", F.col("dem") - F.col("_f")).drop("_e", "_m", "_s", "_f"))


def overlaps(pixels: DataFrame, source_res: int, res: int) -> DataFrame:
    """Source pixels beside every target cell (arow, acol) they touch, with the area `_w` they share."""
    def reach(c: str) -> Column:
        low = F.floor(F.col(c) * source_res / res).cast("int")
        high = F.ceil((F.col(c) + 1) * source_res / res).cast("int") - 1
        return F.explode(F.sequence(low, high))

    def shared(p: str, a: str) -> Column:
        return (F.least((F.col(p) + 1) * source_res, (F.col(a) + 1) * res)
                - F.greatest(F.col(p) * source_res, F.col(a) * res)).cast("long")
    spread = pixels.withColumn("arow", reach("prow")).withColumn("acol", reach("pcol"))
    return spread.withColumn("_w", shared("prow", "arow") * shared("pcol", "acol"))


def by_block(pixels: DataFrame, source_res: int, res: int, squares: int = 8) -> DataFrame:
    """Pixels dealt by blocks (_br, _bc) in which whole pixels and whole target cells fit, so that no cell's pixels lie in two of
    them: pixels are shuffled once, and what they overlap is spread and combined where it is. A block is some of the least such squares wide, so
    that pixels of a line that follow each other go to one task and compress well on their way. Tasks are four times as many as a shuffle has, since
    what pixels are spread to takes far more room than the pixels do."""
    side, tasks = lcm(source_res, res) * squares, 4 * int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row, col = (F.floor(F.col(c) * source_res / side).cast("int") for c in ("prow", "pcol"))
    return pixels.repartition(tasks, row, col).withColumn("_br", row).withColumn("_bc", col)


_CODE = 1 << 31


def _rank(n: Column, code: Column) -> Column:
    """One whole number that orders codes by area, the smaller code first; no code is last."""
    return n * (2 * _CODE) + F.coalesce(_CODE - code, F.lit(0))


def _code_of(rank: Column) -> Column:
    low = F.pmod(rank, F.lit(2 * _CODE))
    return F.when(low > 0, _CODE - low)


def _cover(pixels: DataFrame, source_res: int, res: int, value: str | None, values: tuple[str, ...]) -> DataFrame:
    """Majority of `value` and means of `values` per target cell. Areas combine by code before anything is compared."""
    w = F.col("_w").cast("double")
    sums = [F.sum(w * F.col(v)).alias(f"_s_{v}") for v in values] + [F.sum(F.when(F.col(v).isNotNull(), w)).alias(f"_n_{v}") for v in values]
    cell = ["_br", "_bc", "arow", "acol"]
    out = overlaps(by_block(pixels, source_res, res), source_res, res).groupBy(*cell, *([value] if value else [])).agg(F.sum("_w").alias("_n"), *sums)
    if value:
        again = [F.sum(f"_{x}_{v}").alias(f"_{x}_{v}") for v in values for x in ("s", "n")]
        out = out.groupBy(*cell).agg(F.max(_rank(F.col("_n"), F.col(value).cast("long"))).alias("_r"), *again)
    code = [_code_of(F.col("_r")).cast(pixels.schema[value].dataType).alias(value)] if value else []
    return out.select("arow", "acol", *code, *[F.try_divide(F.col(f"_s_{v}"), F.col(f"_n_{v}")).alias(v) for v in values])


def majority(pixels: DataFrame, source_res: int, res: int, value: str = "code") -> DataFrame:
    """Source code covering most of each target cell, every overlapping pixel counting by the area it
    shares; the smallest code wins a tie. Pixels without a code count too, and lose ties: a cell mostly covered by
    them has none."""
    return _cover(pixels, source_res, res, value, ())


def area_average(pixels: DataFrame, source_res: int, res: int, values: tuple[str, ...]) -> DataFrame:
    """Overlap-area weighted means of the source pixels touching each target cell."""
    return _cover(pixels, source_res, res, None, values)


def land_cover(pixels: DataFrame, source_res: int, res: int, values: tuple[str, ...] = ("cc", "ch"), value: str = "code") -> DataFrame:
    """`majority` and `area_average` of the same pixels in one pass."""
    return _cover(pixels, source_res, res, value, values)


def fuel_index(code: Column) -> Column:
    """Position of a fuel code in the fixed vocabulary, 0 for no data; unknown codes fail."""
    position = F.array_position(F.array(*[F.lit(c) for c in FUEL_CODES]), code).cast("int")
    unknown = F.raise_error(F.concat(F.lit("fuel code outside the vocabulary: "), code.cast("string"))).cast("int")
    return (F.when(code.isNull() | (code <= 0), 0).when(position > 0, position).otherwise(unknown)).cast("short")


def fuel_group(code: Column) -> Column:
    out = F.lit("other")
    for name, low, high in FUEL_GROUPS:
        out = F.when(code.between(low, high), name).otherwise(out)
    return out


def canopy(cells: DataFrame) -> DataFrame:
    """cc without data is 0; ch without data is 0 and is stored in tenths."""
    return (cells.withColumn("cc", F.coalesce("cc", F.lit(0.0)))
            .withColumn("ch", F.coalesce("ch", F.lit(0.0)) / 10.0))


def static_stack(grid: DataFrame, dem: DataFrame, fuel_pixels: DataFrame, source_res: int, cfg: Settings, accepted: DataFrame | None = None) -> DataFrame:
    """Seven static channels and the fuel index per cell of every accepted fire."""
    filled = filled_elevation(grid, dem, cfg, land_cover(fuel_pixels, source_res, cfg.resolution_m), accepted)
    terrain = derivatives(filled, cfg.resolution_m, cfg.tpi_radius_m)
    return canopy(terrain).select(*CELL, "height", "width", F.col("dem").alias("elevation"), "slope", "aspect_sin",
                         "aspect_cos", "tpi", "cc", "ch", fuel_index(F.col("code")).alias("fuel_idx"))


def apply_elevation_mode(static: DataFrame, mode: str) -> DataFrame:
    """fire_centred subtracts the fire-wide mean, raw keeps the level, none drops the channel."""
    if mode == "none":
        return static.drop("elevation")
    if mode == "raw":
        return static.withColumnRenamed("elevation", "elevation_centred")
    if mode != "fire_centred":
        raise ValueError(f"unknown elevation_mode {mode!r}")
    mean = static.groupBy("fire_id").agg(F.avg("elevation").alias("_m"))
    return (static.join(mean, "fire_id").withColumn("elevation_centred", F.col("elevation") - F.col("_m"))
            .drop("_m", "elevation"))


def static_summary(static: DataFrame) -> DataFrame:
    p95 = exact_quantiles(static, "slope", [0.95], ["fire_id"]).select("fire_id", F.col("quantile").alias("slope_p95"))
    return static.groupBy("fire_id").agg(
        F.min("elevation").alias("elev_min"), F.max("elevation").alias("elev_max"), F.max("cc").alias("cc_max"),
        F.max("ch").alias("ch_max"), F.count_distinct("fuel_idx").alias("fuel_classes")).join(p95, "fire_id")


def coregistration(static: DataFrame, first: DataFrame) -> DataFrame:
    """How burned cells sit on the terrain: share on non-burnable fuel, slope and cover inside and out."""
    burned = F.col("first_t").isNotNull()
    bare = F.col("fuel_idx").between(1, 5)
    both = static.join(first, CELL, "left")
    return both.groupBy("fire_id").agg(
        F.avg(F.when(burned, bare.cast("double"))).alias("burned_nonburnable"),
        F.avg(F.when(burned, F.col("slope"))).alias("slope_burned"),
        F.avg(F.when(~burned, F.col("slope"))).alias("slope_unburned"),
        F.avg(F.when(burned, F.col("cc"))).alias("cc_burned"), F.avg(F.when(~burned, F.col("cc"))).alias("cc_unburned"))


def tile_variance(tile_cells: DataFrame, channels: tuple[str, ...] = STATIC) -> DataFrame:
    """Spread of each channel inside tiles and between tile means; input has sample_id."""
    per = tile_cells.groupBy("sample_id").agg(*[f(c).alias(f"{n}_{c}") for c in channels
                                               for n, f in (("v", F.var_pop), ("m", F.avg))])
    wide = per.agg(*[F.avg(f"v_{c}").alias(f"w_{c}") for c in channels], *[F.var_pop(f"m_{c}").alias(f"b_{c}") for c in channels])
    tall = F.inline(F.array(*[F.struct(F.lit(c).alias("channel"), F.sqrt(f"w_{c}").alias("within_sd"),
                                       F.sqrt(f"b_{c}").alias("between_sd"),
                                       F.try_divide(F.col(f"b_{c}") * 100, F.col(f"b_{c}") + F.col(f"w_{c}")).alias("between_pct"))
                              for c in channels]))
    return wide.select(tall)
