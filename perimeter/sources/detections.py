"""Reading, cleaning and auditing point detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perimeter.config import FIRE_SEASON
from perimeter.functions.times import seconds_of

DETECTION_SCHEMA = T.StructType([
    T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()),
    T.StructField("acq_date", T.StringType()), T.StructField("acq_time", T.IntegerType()),
    T.StructField("confidence", T.StringType()), T.StructField("frp", T.DoubleType()),
    T.StructField("type", T.IntegerType()), T.StructField("satellite", T.StringType()),
])
_FIELDS = {f.name: f.dataType.simpleString() for f in DETECTION_SCHEMA}


def read_detections(spark: SparkSession, glob: str) -> DataFrame:
    """All CSV chunks as one table. Columns are matched by each file's own header, in any order;
    optional columns a file lacks are null and header-only files contribute nothing.

    The files are split into lines by Spark; a file's header reaches its rows through a join on
    the file name, so chunk families with different headers need no separate read."""
    lines = (spark.read.text(glob)
             .select(F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("block"), "value")
             .filter(F.length(F.trim("value")) > 0))
    is_header = F.lower("value").contains("latitude") & F.lower("value").contains("longitude")
    headers = (lines.filter(is_header).groupBy("file")
               .agg(F.min(F.lower(F.trim("value"))).alias("header")))
    cells = (lines.filter(~is_header).join(headers, "file")
             .withColumns({"names": fields_of("header"), "cells": fields_of("value")}))
    return cells.select(
        "file", *[F.expr(f"try_cast(nullif(try_element_at(cells, cast(nullif(array_position(names, '{n}'), 0) as int)), '') AS {t})").alias(n)
                  for n, t in _FIELDS.items()])


def fields_of(line: str) -> F.Column:
    """Trimmed fields of a CSV line. A quoted field may hold commas and doubled quotes; a field that a line
    lacks is found null by whoever asks for it."""
    parts = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',(\s*"(?:[^"]|"")*"\s*|[^,]*)'), 1)
    quoted = r'^"((?:[^"]|"")*)"$'
    return F.transform(parts, lambda x: F.trim(F.replace(F.regexp_replace(F.trim(x), quoted, "$1"), F.lit('""'), F.lit('"'))))


def confidence_rank(c: str = "confidence") -> F.Column:
    first = F.lower(F.substring(F.trim(F.col(c)), 1, 1))
    return F.when(first == "l", 0).when(first == "n", 1).when(first == "h", 2).otherwise(-1)


def clean_detections(df: DataFrame, min_confidence: str = "n", vegetation_only: bool = True) -> DataFrame:
    """Keep detections of at least the wanted confidence and, where typed, of vegetation fires.

    The type rule depends on whether any file carries a type at all; that is a scalar
    subquery, so no action is needed while the plan is built."""
    wanted = {"l": 0, "n": 1, "h": 2}[min_confidence[0].lower()]
    kept = df.filter(confidence_rank() >= wanted)
    if not vegetation_only or "type" not in df.columns:
        return kept
    typed = df.agg(F.max(F.col("type").isNotNull())).scalar()
    return kept.filter((~F.coalesce(typed, F.lit(False))) | (F.col("type") == 0))


def parse_acquisition(df: DataFrame) -> DataFrame:
    """acq_date and HHMM acq_time to one UTC timestamp; impossible stamps become null."""
    hhmm = F.lpad(F.col("acq_time").cast("string"), 4, "0")
    text = F.concat("acq_date", F.lit(" "), F.substring(hhmm, 1, 2), F.lit(":"), F.substring(hhmm, 3, 2), F.lit(":00"))
    return df.withColumn("_text", text).withColumn("acq", F.expr("try_cast(_text AS timestamp_ntz)")).drop("_text")


def dedupe_detections(df: DataFrame, order: tuple[str, ...] = ("file", "confidence", "frp")) -> DataFrame:
    """One row per (place, time): the least by `order`. An aggregate rather than a window, so
    copies combine before the shuffle and a much-repeated detection cannot fill one task."""
    key = ["latitude", "longitude", "acq"]
    rest = [c for c in df.columns if c not in key and c not in order]
    best = F.min(F.struct(*order, *rest)).alias("_best")
    return df.groupBy(*key).agg(best).select(*key, "_best.*")


def load_detections(raw: DataFrame, min_confidence: str = "n", vegetation_only: bool = True) -> DataFrame:
    """Raw chunks to clean detections with `t_s`, whole UTC seconds."""
    parsed = parse_acquisition(clean_detections(raw, min_confidence, vegetation_only)).filter(F.col("acq").isNotNull())
    return dedupe_detections(parsed).withColumn("t_s", seconds_of("acq"))


def plan_chunks(spans: DataFrame, size: int = 5, anchor: str | None = None) -> DataFrame:
    """Rows (first, last) of dates to (chunk_start, n_days), on an anchor grid, the last clipped."""
    start = F.col("first")
    if anchor is not None:
        back = F.pmod(F.datediff(start, F.lit(anchor).cast("date")), F.lit(size))
        start = F.when(start > F.lit(anchor).cast("date"), F.date_sub(start, back)).otherwise(start)
    return (spans.withColumn("_start", start)
            .withColumn("chunk_start", F.explode(F.expr(f"sequence(_start, last, interval {size} days)")))
            .withColumn("n_days", F.least(F.lit(size), F.datediff("last", "chunk_start") + 1))
            .drop("_start"))


def pending_chunks(planned: DataFrame, landed: DataFrame, key: str = "chunk_start") -> DataFrame:
    """Planned chunks without a landed file."""
    return planned.join(landed.select(key).distinct(), key, "left_anti")


def empty_files(lines_per_file: DataFrame) -> DataFrame:
    """Files holding a header at most: rows (file, n_lines)."""
    return lines_per_file.filter(F.col("n_lines") <= 1)


def missing_days(days: DataFrame, first: str, last: str) -> DataFrame:
    """Calendar days from `first` to `last` that have no detection; input column `day`. The range is the one the
    archive should cover, so that outages at its ends are found."""
    spine = (days.sparkSession.range(1).select(F.lit(first).cast("date").alias("a"), F.lit(last).cast("date").alias("b"))
             .select(F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("day")))
    return spine.join(days.select("day").distinct(), "day", "left_anti")


def empty_runs(missing: DataFrame, min_days: int = 3, season: tuple[int, int] = FIRE_SEASON) -> DataFrame:
    """Runs of consecutive empty days: (start, days, in_season). The single window spans the
    calendar only, never the detections."""
    island = F.date_sub("day", F.row_number().over(Window.orderBy("day")))
    return (missing.withColumn("_run", island).groupBy("_run")
            .agg(F.min("day").alias("start"), F.count("*").alias("days"))
            .filter(F.col("days") >= min_days)
            .select("start", "days", F.month("start").between(*season).alias("in_season")))
