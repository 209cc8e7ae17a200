"""Distance to the nearest burned cell of a tile, on tile lines (DataFrame functions only).

A tile line is one row with an array over its columns, so a tile of `patch` lines is as many rows, whatever is
asked of its patch x patch cells. Each column of a tile says, for every line, which of its burned cells is nearest (the
cells of a column share out the lines by their midpoints). On a line, a column c' with nearest burned row n then costs
(x - c')^2 + (r - n)^2 at place x. The best column moves to the right with x, so places are settled by halving: between two
settled places only the columns from the one's best to the other's are compared.

All comparisons are on one whole number, `near`: squared distance, then row, then column of the burned cell. So of equally near
cells the one of least row, then column, is taken, and the three parts can be read back from it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perimeter.storage import deal


def squared(near: Column, patch: int) -> Column:
    """Squared distance in cells."""
    return F.floor(near / (patch * patch)).cast("long")


def row_of(near: Column, patch: int) -> Column:
    return F.floor(near % (patch * patch) / patch).cast("int")


def col_of(near: Column, patch: int) -> Column:
    return (near % patch).cast("int")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shared_out(rows: Column, patch: int) -> Column:
    """Nearest of the sorted rows for every line 0..patch-1; of two equally near ones the lesser."""
    def until(i: Column) -> Column:
        """First line after the share of row i."""
        after = F.get(rows, i + 1)
        return F.when(after.isNull(), patch).otherwise(F.floor((F.get(rows, i) + after) / 2).cast("int") + 1)
    return F.flatten(F.transform(rows, lambda x, i: F.array_repeat(x, until(i) - F.when(i > 0, until(i - 1)).otherwise(0))))


def _settled(cols: Column, costs: Column, patch: int) -> Column:
    """Least (x - c)^2 * patch^2 + cost over the columns, for every place x."""
    area, last = patch * patch, F.size(costs) - 1

    def value(j: Column, x: Column) -> Column:
        gap = (x - F.get(cols, j)).cast("long")
        return gap * gap * area + F.get(costs, j)

    def best(x: Column, low: Column, high: Column) -> Column:
        """Column that is best at x, among low..high."""
        tagged = F.transform(F.sequence(low, high), lambda j: value(j, x) * patch + j)
        return (F.array_min(tagged) % patch).cast("int")

    def halved(step: int) -> Callable[[Column], Column]:
        """Settles the places in the middle between those known."""
        middles = list(range(step, patch, 2 * step))

        def refine(known: Column) -> Column:
            fresh = F.transform(F.sequence(F.lit(0), F.lit(len(middles) - 1)), lambda i: best(
                i * (2 * step) + step, F.get(known, i), F.coalesce(F.get(known, i + 1), last)))
            return F.array_compact(F.flatten(F.zip_with(known, fresh, lambda a, b: F.array(a, b))))
        return refine
    known = F.array(best(F.lit(0), F.lit(0), last))
    for n in reversed(range((patch - 1).bit_length())):
        known = _let(known, halved(1 << n))
    return F.transform(known, lambda j, x: value(j, x))


def nearest_lines(burned: DataFrame, keys: list[str], patch: int) -> DataFrame:
    """(keys, r, near): one row per line of each tile that has burned cells (keys, r, c); `near` is an array over the
    columns. A group is one tile, at most patch columns of at most patch rows."""
    # Dealt once by tile: adaptive execution would leave the few bytes of burned cells, which cost much each, to a few tasks.
    columns = (deal(burned.select(*keys, "r", "c"), *keys).groupBy(*keys, "c").agg(F.array_sort(F.collect_set(F.col("r").cast("int"))).alias("_rows"))
               .select(*keys, F.col("c").cast("int").alias("c"), _shared_out(F.col("_rows"), patch).alias("rows")))
    tiles = columns.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("c", "rows"))).alias("_t"))

    def cost(col: Column, r: Column) -> Column:
        row = F.get(col["rows"], r)
        gap = (r - row).cast("long")
        return gap * gap * (patch * patch) + row * patch + col["c"]
    lines = F.transform(F.sequence(F.lit(0), F.lit(patch - 1)), lambda r: F.struct(
        r.alias("r"), F.transform("_t", lambda col: cost(col, r)).alias("costs")))
    spread = tiles.select(*keys, F.transform("_t", lambda col: col["c"]).alias("_c"), F.inline(lines))
    return spread.select(*keys, "r", _settled(F.col("_c"), F.col("costs"), patch).alias("near"))


def with_nearest(cells: DataFrame, lines: DataFrame, keys: list[str], out: str = "near") -> DataFrame:
    """`cells` (keys, r, c, ...) with the value of their place in `lines`; null in tiles without burned cells."""
    held = lines.select(*keys, F.col("r").alias("_r"), F.col("near").alias("_line"))
    met = cells.withColumn("_r", F.col("r").cast("int")).join(held, [*keys, "_r"], "left")
    return met.withColumn(out, F.get("_line", F.col("c").cast("int"))).select(*cells.columns, out)


def band_counts(lines: DataFrame, edges: Sequence[int], patch: int) -> DataFrame:
    """(band, n_pixels) of unburned cells between the edges (left-closed, the last band open), empty bands included, summed over
    lines without a row per cell. A squared distance is the upper part of `near`, so each edge is one comparison."""
    area = patch * patch
    beyond = [F.size(F.filter("near", _at_least(e * e * area))).cast("long") for e in (1, *edges)]
    # The first band is what lies off the burned cells but below the first edge.
    sums = lines.agg(*[F.coalesce(F.sum(n), F.lit(0).cast("long")).alias(f"n{i}") for i, n in enumerate(beyond)])
    last = len(edges)
    rows = [F.struct(F.lit(i).alias("band"), (F.col(f"n{i}") - (F.col(f"n{i + 1}") if i < last else 0)).alias("n_pixels")) for i in range(last + 1)]
    return sums.select(F.inline(F.array(*rows)))


def _at_least(least: int) -> Callable[[Column], Column]:
    return lambda x: x >= least
