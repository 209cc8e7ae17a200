"""Sparse raster morphology: a raster is a table of set cells.

All functions take a `keys` list naming the raster a cell belongs to (for instance fire and
window) and work on integer `row`, `col`."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Offsets = Sequence[tuple[int, int]]


def disk(radius: int) -> Offsets:
    span = range(-radius, radius + 1)
    return [(r, c) for r in span for c in span if r * r + c * c <= radius * radius]


def diamond(radius: int) -> Offsets:
    span = range(-radius, radius + 1)
    return [(r, c) for r in span for c in span if abs(r) + abs(c) <= radius]


def square(radius: int) -> Offsets:
    span = range(-radius, radius + 1)
    return [(r, c) for r in span for c in span]


def compose(first: Offsets, second: Offsets) -> Offsets:
    """The element whose dilation equals dilating by one and then the other."""
    return sorted({(a + c, b + d) for a, b in first for c, d in second})


def offset_array(offsets: Iterable[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in offsets])


# --- bit rows ---------------------------------------------------------------------------------
# Morphology works on bit rows (keys, row, blk, bits): 32 neighbouring columns of a raster row in
# one long. A shift by up to 16 columns stays inside 64 bits, so a whole row segment grows or
# shrinks with a few shifts, and each step moves one row per segment instead of one per cell.

WIDTH = 32
_HALF = WIDTH // 2
_MASK = (1 << WIDTH) - 1
_LOW = (1 << _HALF) - 1


def half_widths(offsets: Offsets) -> dict[int, int]:
    """Row shift -> half width of an element whose rows are centred runs."""
    rows: dict[int, set[int]] = {}
    for r, c in offsets:
        rows.setdefault(r, set()).add(c)
    out = {r: max(cs) for r, cs in rows.items()}
    if any(cs != set(range(-out[r], out[r] + 1)) for r, cs in rows.items()) or max(out.values()) > _HALF:
        raise ValueError("morphology needs elements made of centred runs of at most 33 columns")
    return out


def to_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    bit = F.expr(f"shiftleft(1L, cast(pmod(col, {WIDTH}) as int))")
    return cells.groupBy(*keys, "row", F.floor(F.col("col") / WIDTH).cast("int").alias("blk")).agg(F.bit_or(bit).alias("bits"))


def to_cells(rows: DataFrame, keys: list[str]) -> DataFrame:
    spread = rows.select(*keys, "row", "blk", "bits", F.explode(F.array(*[F.lit(i) for i in range(WIDTH)])).alias("_i"))
    return (spread.filter(F.expr("shiftright(bits, _i) & 1L = 1L"))
            .select(*keys, "row", (F.col("blk") * WIDTH + F.col("_i")).alias("col")))


def _slide(x: Column, by: int) -> Column:
    return F.shiftleft(x, by) if by >= 0 else F.shiftrightunsigned(x, -by)


def _runs(x: Column, half: int, union: bool) -> Column:
    out = x
    for i in range(1, half + 1):
        for part in (_slide(x, i), _slide(x, -i)):
            out = out.bitwiseOR(part) if union else out.bitwiseAND(part)
    return out


def dilate_rows(rows: DataFrame, keys: list[str], offsets: Offsets) -> DataFrame:
    widths = half_widths(offsets)
    wide = rows.withColumn("_x", F.shiftleft("bits", _HALF))
    grown = wide.withColumns({f"_w{w}": _runs(F.col("_x"), w, True) for w in set(widths.values())})
    lines = F.explode(F.array(*[F.struct(F.lit(r).alias("dr"), F.col(f"_w{w}").alias("y")) for r, w in sorted(widths.items())]))
    y = F.col("_l.y")
    parts = F.explode(F.array(
        F.struct(F.lit(-1).alias("db"), F.shiftleft(y.bitwiseAND(F.lit(_LOW)), _HALF).alias("bits")),
        F.struct(F.lit(0).alias("db"), F.shiftrightunsigned(y, _HALF).bitwiseAND(F.lit(_MASK)).alias("bits")),
        F.struct(F.lit(1).alias("db"), F.shiftrightunsigned(y, WIDTH + _HALF).alias("bits"))))
    return (grown.select(*keys, "row", "blk", lines.alias("_l"))
            .select(*keys, (F.col("row") + F.col("_l.dr")).alias("row"), "blk", parts.alias("_p")).filter("_p.bits <> 0")
            .groupBy(*keys, "row", (F.col("blk") + F.col("_p.db")).alias("blk")).agg(F.bit_or("_p.bits").alias("bits")))


def diamond_rows(rows: DataFrame, keys: list[str], radii: Sequence[int]) -> DataFrame:
    """Contributions to the dilation by a diamond of every radius at once: rows (keys, row, blk, k<radius>...)
    whose bit-wise union per (keys, row, blk) is the dilated raster. A wider diamond holds the narrower."""
    top = max(radii)
    wide = rows.withColumn("_x", F.shiftleft("bits", _HALF))
    grown = wide.withColumns({f"_w{h}": _runs(F.col("_x"), h, True) for h in range(top + 1)})
    none = F.lit(0).cast("long")
    lines = F.explode(F.array(*[F.struct(F.lit(d).alias("dr"), *[
        (F.col(f"_w{k - abs(d)}") if k >= abs(d) else none).alias(f"k{k}") for k in radii]) for d in range(-top, top + 1)]))

    def part(db: int, cut: Callable[[Column], Column]) -> Column:
        return F.struct(F.lit(db).alias("db"), *[cut(F.col(f"_l.k{k}")).alias(f"k{k}") for k in radii])
    parts = F.explode(F.array(
        part(-1, lambda y: F.shiftleft(y.bitwiseAND(F.lit(_LOW)), _HALF)),
        part(0, lambda y: F.shiftrightunsigned(y, _HALF).bitwiseAND(F.lit(_MASK))),
        part(1, lambda y: F.shiftrightunsigned(y, WIDTH + _HALF))))
    return (grown.select(*keys, "row", "blk", lines.alias("_l"))
            .select(*keys, (F.col("row") + F.col("_l.dr")).alias("row"), "blk", parts.alias("_p")).filter(f"_p.k{top} <> 0")
            .select(*keys, "row", (F.col("blk") + F.col("_p.db")).alias("blk"), *[F.col(f"_p.k{k}") for k in radii]))


def erode_rows(rows: DataFrame, keys: list[str], offsets: Offsets) -> DataFrame:
    """A segment keeps a bit if every line of the element is set there; lines without any row count
    as unset. Neighbouring segments come from a window over one raster row."""
    widths = half_widths(offsets)
    w = Window.partitionBy(*keys, "row").orderBy("blk")
    left = F.when(F.lag("blk").over(w) == F.col("blk") - 1, F.lag("bits").over(w)).otherwise(F.lit(0).cast("long"))
    right = F.when(F.lead("blk").over(w) == F.col("blk") + 1, F.lead("bits").over(w)).otherwise(F.lit(0).cast("long"))
    context = (F.shiftrightunsigned(F.col("_left"), _HALF).bitwiseOR(F.shiftleft("bits", _HALF))
               .bitwiseOR(F.shiftleft(F.col("_right").bitwiseAND(F.lit(_LOW)), WIDTH + _HALF)))
    wide = rows.withColumns({"_left": left, "_right": right}).withColumn("_x", context)
    shrunk = wide.withColumns({f"_w{h}": F.shiftrightunsigned(_runs(F.col("_x"), h, False), _HALF).bitwiseAND(F.lit(_MASK))
                               for h in set(widths.values())})
    lines = F.explode(F.array(*[F.struct(F.lit(r).alias("dr"), F.col(f"_w{h}").alias("y")) for r, h in sorted(widths.items())]))
    return (shrunk.select(*keys, "row", "blk", lines.alias("_l"))
            .groupBy(*keys, (F.col("row") - F.col("_l.dr")).alias("row"), "blk")
            .agg(F.bit_and("_l.y").alias("bits"), F.count("*").alias("_n"))
            .filter((F.col("_n") == len(widths)) & (F.col("bits") != 0)).drop("_n"))


def dilate(cells: DataFrame, keys: list[str], offsets: Offsets) -> DataFrame:
    """Union of the cells shifted by every offset."""
    return to_cells(dilate_rows(to_rows(cells, keys), keys, offsets), keys)


def erode(cells: DataFrame, keys: list[str], offsets: Offsets) -> DataFrame:
    """Cells whose whole neighbourhood is set."""
    return to_cells(erode_rows(to_rows(cells, keys), keys, offsets), keys)


def count_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Number of set cells per raster, `n`, counted as bits."""
    return rows.groupBy(*keys).agg(F.sum(F.bit_count("bits").cast("long")).alias("n"))


def bit_places(bits: Column) -> Column:
    """Sum of the numbers of the set bits of a segment: each binary digit of a number is counted over all bits at once."""
    digits = [sum(1 << i for i in range(WIDTH) if i >> j & 1) for j in range((WIDTH - 1).bit_length())]
    return reduce(lambda a, b: a + b, [F.bit_count(bits.bitwiseAND(F.lit(d))).cast("long") * (1 << j) for j, d in enumerate(digits)])


def close_rows(rows: DataFrame, keys: list[str], offsets: Offsets) -> DataFrame:
    return erode_rows(dilate_rows(rows, keys, offsets), keys, offsets)


def close(cells: DataFrame, keys: list[str], offsets: Offsets) -> DataFrame:
    """Dilation and then erosion by the same element."""
    return to_cells(close_rows(to_rows(cells, keys), keys, offsets), keys)


def grow_and_close(points: DataFrame, keys: list[str], grow: Offsets, closing: Offsets) -> DataFrame:
    """Dilation by `grow` and then closing; both dilations are one step by the composed element."""
    grown = dilate_rows(to_rows(points, keys), keys, compose(grow, closing))
    return to_cells(erode_rows(grown, keys, closing), keys)


def block_downsample(values: DataFrame, keys: list[str], factor: int, value: str,
                     height: Column, width: Column, how: str = "mean") -> DataFrame:
    """Blocks of factor x factor cells; partial blocks at the far edges are dropped and absent
    cells count as zero."""
    whole = values.filter((F.col("row") < F.floor(height / factor) * factor)
                          & (F.col("col") < F.floor(width / factor) * factor))
    agg = F.max(value) if how == "max" else F.sum(value) / F.lit(float(factor * factor))
    return (whole.withColumn("row", F.floor(F.col("row") / factor).cast("int"))
            .withColumn("col", F.floor(F.col("col") / factor).cast("int"))
            .groupBy(*keys, "row", "col").agg(agg.alias(value)))
