"""Layer versions, sinks and incremental builds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perimeter.sources import tables

CONTAMINATED_BEFORE = 2017


def fuel_versions(events: DataFrame, versions: DataFrame, strategy: str = "latest_prior", fixed: str | None = None) -> DataFrame:
    """The fuel layer version of each fire: the latest strictly before its year, else the earliest.

    The version table is a short catalogue; years are matched once per distinct year and joined back."""
    late = (F.col("year") < CONTAMINATED_BEFORE).alias("contaminated")
    if strategy == "fixed":
        return events.select("fire_id", "year", F.lit(fixed).alias("version"), late)
    years = events.select("year").distinct()
    prior = (years.join(versions, F.col("version_year") < F.col("year"))
             .groupBy("year").agg(F.max_by("version", "version_year").alias("_prior")))
    earliest = versions.agg(F.min_by("version", "version_year")).scalar()
    return (events.join(prior, "year", "left")
            .select("fire_id", "year", F.coalesce("_prior", earliest).alias("version"), late))


def pending(wanted: DataFrame, built: DataFrame, key: str = "fire_id") -> DataFrame:
    """Entities without output yet."""
    return wanted.join(built.select(key).distinct(), key, "left_anti")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition: str | None = None, overwrite: bool = False) -> None:
    """Write a result; overwriting a partitioned table replaces only the partitions written. Meant for small results and text
    files; tables that grow by keys are `tables.build_missing`."""
    writer = df.write.format(fmt).mode("overwrite" if overwrite else "errorifexists")
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition:
        writer = writer.partitionBy(partition).option("partitionOverwriteMode", "dynamic")
    writer.save(path)


def write_sinks(root: str, events: DataFrame, labelled: DataFrame, index: DataFrame, labels: DataFrame, splits: DataFrame, stats: DataFrame) -> None:
    """The six results of a study below `root`: kept events and the label manifest as CSV, labelled detections and the sample index as tables
    by fire, split lists as one folder per split and normalisation statistics as JSON."""
    write_table(events, f"{root}/events", "csv")
    tables.build_missing(labelled, f"{root}/labelled", "fire_id", ["det_id"])
    tables.build_missing(index, f"{root}/index", "fire_id", ["t_index"])
    write_table(labels, f"{root}/manifest", "csv")
    write_splits(splits, f"{root}/splits")
    write_table(stats, f"{root}/stats", "json")


def write_splits(splits: DataFrame, path: str) -> None:
    """A list of fires per split, below `path`/split=name."""
    splits.select("fire_id", "split").repartition("split").sortWithinPartitions("split", "fire_id").write.partitionBy("split").text(path)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("value string, split string").text(path).select(F.col("value").alias("fire_id"), "split")
