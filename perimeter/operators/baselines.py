"""Naive forecasts scored on the sample tiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perimeter.config import RINGS, Settings
from perimeter.operators.cells import WIDTH, diamond_rows, to_rows
from perimeter.operators.labels import cells_in_tiles, cut_rows, rows_in_tiles


def tile_cells(samples: DataFrame, first: DataFrame, cfg: Settings) -> DataFrame:
    """Burned (`y` false) and target (`y` true) cells of each sample in tile coordinates."""
    placed = cells_in_tiles(samples.select("sample_id", "fire_id", F.col("t_index").alias("t"), "row0", "col0"),
                            first.select("fire_id", "row", "col", "first_t"), cfg.patch)
    return (placed.filter(F.col("first_t") <= F.col("t") + 1)
            .select("sample_id", (F.col("row") - F.col("row0")).alias("r"), (F.col("col") - F.col("col0")).alias("c"),
                    (F.col("first_t") == F.col("t") + 1).alias("y")))


def tile_rows(samples: DataFrame, first: DataFrame, cfg: Settings) -> DataFrame:
    """`tile_cells` as bit rows of the tile (sample_id, y, row, blk, bits); a segment may come in two parts.

    The first windows of a segment's cells are a list of at most WIDTH entries."""
    segments = (to_rows(first, ["fire_id", "first_t"]).groupBy("fire_id", "row", "blk")
                .agg(F.collect_list(F.struct("first_t", "bits")).alias("_s")))
    tiles = samples.select("sample_id", "fire_id", F.col("t_index").alias("t"), "row0", "col0")

    def union(test: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.filter("_s", test), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x["bits"])).alias("bits")
    kinds = F.inline(F.array(F.struct(F.lit(False).alias("y"), union(lambda x: x["first_t"] <= F.col("t"))),
                             F.struct(F.lit(True).alias("y"), union(lambda x: x["first_t"] == F.col("t") + 1))))
    cut = cut_rows(rows_in_tiles(tiles, segments, cfg.patch).select("sample_id", "row0", "col0", "row", "blk", kinds), cfg.patch)
    moved = cut.withColumn("_c", F.col("blk") * WIDTH - F.col("col0")).withColumn("_b", F.expr(f"shiftleft(bits, cast(pmod(_c, {WIDTH}) as int))"))
    blk = F.floor(F.col("_c") / WIDTH).cast("int")
    parts = F.inline(F.array(F.struct(blk.alias("blk"), F.col("_b").bitwiseAND(F.lit((1 << WIDTH) - 1)).alias("bits")),
                             F.struct((blk + 1).alias("blk"), F.shiftrightunsigned("_b", WIDTH).alias("bits"))))
    return moved.select("sample_id", "y", (F.col("row") - F.col("row0")).alias("row"), parts).filter("bits <> 0")


def baseline_counts(samples: DataFrame, first: DataFrame, cfg: Settings, rings: tuple[int, ...] = RINGS) -> DataFrame:
    """tp, fp, fn per sample for persistence and every ring: rows (sample_id, fire_id, baseline, tp,
    fp, fn). Samples without any burned or target cell have no row.

    Tiles are bit rows, and a segment meets a tile as one row, whenever its cells burned (`tile_rows`). All rings come from one step: a burned row adds to the rows around it, for every
    radius at once, and cells are counted as bits. A tile is bounded, so its rows are kept together by one shuffle."""
    key, radii = ["sample_id"], [0, *sorted(rings)]
    rows = (tile_rows(samples, first, cfg).repartition("sample_id").groupBy("sample_id", "y", "row", "blk")
            .agg(F.bit_or("bits").alias("bits")))
    zero = F.lit(0).cast("long")
    # Both kinds of row pass the same step; the target rows are taken at radius 0 alone.
    spread = diamond_rows(rows, ["sample_id", "y"], radii)
    last_block = (cfg.patch - 1) // WIDTH
    inside = F.col("row").between(0, cfg.patch - 1) & F.col("blk").between(0, last_block)
    edge = F.when(F.col("blk") == last_block, F.lit((1 << (cfg.patch - last_block * WIDTH)) - 1)).otherwise(F.lit((1 << WIDTH) - 1))
    kept = spread.filter(inside & (~F.col("y") | (F.col("k0") != 0)))
    names = {k: "cur" if k == 0 else f"ring{k}" for k in radii}
    lanes = kept.groupBy(*key, "row", "blk").agg(
        F.coalesce(F.bit_or(F.when(F.col("y"), F.col("k0"))), zero).alias("y"),
        *[F.coalesce(F.bit_or(F.when(~F.col("y"), F.col(f"k{k}").bitwiseAND(edge))), zero).alias(n) for k, n in names.items()])
    grown = [n for k, n in names.items() if k]
    sums = []
    for name in ("persistence", *grown):
        pred = F.col("cur") if name == "persistence" else F.col(name).bitwiseAND(F.bitwise_not("cur"))
        for stat, bits in (("tp", pred.bitwiseAND(F.col("y"))), ("fp", pred.bitwiseAND(F.bitwise_not("y"))),
                           ("fn", F.bitwise_not(pred).bitwiseAND(F.col("y")))):
            sums.append(F.sum(F.bit_count(bits).cast("long")).alias(f"{name}_{stat}"))
    wide = lanes.groupBy("sample_id").agg(*sums)
    tall = F.inline(F.array(*[F.struct(F.lit(n).alias("baseline"), *[F.col(f"{n}_{s}").alias(s) for s in ("tp", "fp", "fn")])
                              for n in ("persistence", *grown)]))
    return samples.select("sample_id", "fire_id").join(wide, "sample_id").select("sample_id", "fire_id", tall)


def all_positive_counts(samples: DataFrame, cfg: Settings) -> DataFrame:
    """Every tile cell predicted: closed form from the index."""
    n = F.lit(cfg.patch * cfg.patch)
    return samples.select("sample_id", "fire_id", F.lit("all_positive").alias("baseline"),
                          F.col("n_target_px").alias("tp"), (n - F.col("n_target_px")).alias("fp"),
                          F.lit(0).cast("long").alias("fn"))


def pooled(counts: DataFrame, *keys: str) -> DataFrame:
    return counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
