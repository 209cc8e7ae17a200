"""Global order statistics without pulling anything into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perimeter.storage import materialize

_POS_BITS = 33


def global_index(df: DataFrame, keys: Sequence[str], out: str = "idx") -> DataFrame:
    """Number rows 0.. in the order of `keys` over the whole table.

    Range partitioning sorts the table in parallel; only one row per partition is then summed
    to turn positions inside partitions into global ones."""
    tagged = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                         .withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", _POS_BITS)
    position = F.col("_m").bitwiseAND(F.lit((1 << _POS_BITS) - 1))
    sizes = tagged.groupBy(part.alias("_p")).agg((F.max(position) + 1).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (tagged.withColumn("_p", part).join(F.broadcast(offsets), "_p")
            .withColumn(out, position + F.col("_off")).drop("_p", "_m", "_off"))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated quantiles per group: rows (*by, prob, quantile). Null values are skipped.

    Equal values are counted before anything is sorted, so a frequent value is one row. The distinct
    values are range partitioned; counts run up inside a partition and partitions are offset by their
    totals. A wanted position is looked up in the one partition that holds it."""
    by = [*by, "_g"]
    counts = df.filter(F.col(value).isNotNull()).withColumn("_g", F.lit(0)).groupBy(*by, value).agg(F.count("*").alias("_c"))
    placed = materialize(counts.repartitionByRange(*by, value).withColumn("_p", F.spark_partition_id()))
    # One row per partition and group; a group has at most as many rows as there are partitions.
    parts = placed.groupBy("_p", *by).agg(F.sum("_c").alias("_size"))
    earlier = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_off", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    spans = parts.groupBy(*by).agg(F.sum("_size").alias("_n"))
    wanted = (spans.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
              .withColumn("_h", F.col("prob") * (F.col("_n") - 1))
              .withColumn("_low", F.floor("_h")).withColumn("_frac", F.col("_h") - F.col("_low"))
              .withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1))))
              .withColumn("_at", F.least(F.col("_low") + F.col("_side"), F.col("_n") - 1)))
    found = (wanted.join(parts.hint("merge"), by).filter((F.col("_at") >= F.col("_off")) & (F.col("_at") < F.col("_off") + F.col("_size")))
             .select(*by, "_p", "prob", "_frac", "_side", (F.col("_at") - F.col("_off")).alias("_at")))
    inside = Window.partitionBy("_p", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.withColumn("_end", F.sum("_c").over(inside))
    hit = (F.col("_at") < F.col("_end")) & (F.col("_at") >= F.col("_end") - F.col("_c"))
    weight = F.when(F.col("_side") == 0, 1 - F.col("_frac")).otherwise(F.col("_frac"))
    # Written values compress well, so their size on disk would have all of them broadcast.
    return (found.join(ranked.hint("merge"), ["_p", *by]).filter(hit)
            .groupBy(*by, "prob").agg(F.sum(F.col(value) * weight).alias("quantile")).drop("_g"))


def wide_quantiles(df: DataFrame, value: str, names: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """`exact_quantiles` with one column per named probability."""
    tall = exact_quantiles(df, value, sorted(set(names.values())), by)
    picks = [F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for n, p in names.items()]
    return tall.groupBy(*by).agg(*picks)


def seed_order(seed: int, *keys: str) -> Column:
    """A reproducible pseudo-random sort key that does not depend on partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
