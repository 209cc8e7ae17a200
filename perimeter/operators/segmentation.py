"""Fire events from linked detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perimeter.config import Settings
from perimeter.functions.geo import lonlat_to_albers
from perimeter.functions.times import at_second
from perimeter.operators.links import box_components, with_box
from perimeter.operators.ranking import global_index
from perimeter.storage import materialize


def project(df: DataFrame) -> DataFrame:
    x, y = lonlat_to_albers(F.col("longitude"), F.col("latitude"))
    return df.withColumn("x", x).withColumn("y", y)


def window_bin(window_hours: int, t_s: str = "t_s") -> Column:
    """Number of the epoch-aligned window holding a time."""
    return F.floor(F.col(t_s) / (window_hours * 3600)).cast("long")


def component_points(points: DataFrame, cfg: Settings) -> tuple[DataFrame, DataFrame]:
    """(boxed detections, box labels)."""
    radius = cfg.link_km * 1000
    boxed = with_box(points, radius, cfg.link_hours)
    labels = box_components(boxed.select("box").distinct(), points, radius, cfg.link_hours)
    return boxed, labels


def summarize_components(boxed: DataFrame, labels: DataFrame, cfg: Settings) -> DataFrame:
    """One row per component. Detections are combined per box and window before the labels are
    joined, so the join and the second aggregation never see single detections."""
    root = F.min(F.struct("t_s", "det_id"))
    partial = (boxed.withColumn("bin", window_bin(cfg.window_hours)).groupBy("box", "bin")
               .agg(F.count("*").alias("n"), F.min("t_s").alias("t0"), F.max("t_s").alias("t1"),
                    F.sum("latitude").alias("sum_lat"), F.sum("longitude").alias("sum_lon"),
                    F.min("x").alias("x_min"), F.max("x").alias("x_max"),
                    F.min("y").alias("y_min"), F.max("y").alias("y_max"),
                    F.max("frp").alias("frp_max"), root.alias("root")))
    return (partial.join(labels, "box").groupBy("component")
            .agg(F.sum("n").alias("n_detections"), F.min("t0").alias("start_s"), F.max("t1").alias("end_s"),
                 (F.sum("sum_lat") / F.sum("n")).alias("lat"), (F.sum("sum_lon") / F.sum("n")).alias("lon"),
                 F.min("x_min").alias("x_min"), F.max("x_max").alias("x_max"),
                 F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max"),
                 F.max("frp_max").alias("frp_max"), F.count_distinct("bin").alias("n_timesteps"),
                 F.min("root").alias("_root"))
            .withColumn("root_id", F.col("_root.det_id")).drop("_root"))


def half_even(c: Column) -> Column:
    return F.rint(c).cast("int")


def describe_events(components: DataFrame, cfg: Settings) -> DataFrame:
    """Numbers components by start, names them by year and adds the derived columns."""
    years = components.withColumn("start_ts", at_second("start_s")).withColumn("year", F.year("start_ts"))
    ranked = global_index(years, ["start_s", "root_id"], "event")
    first = ranked.groupBy("year").agg(F.min("event").alias("_first"))
    named = ranked.join(F.broadcast(first), "year").withColumn("_seq", F.col("event") - F.col("_first") + 1)
    side = cfg.resolution_m
    px = half_even((F.col("x_max") - F.col("x_min")) / side)
    py = half_even((F.col("y_max") - F.col("y_min")) / side)
    return (named.withColumn("end_ts", at_second("end_s"))
            .withColumn("duration_h", (F.col("end_s") - F.col("start_s")) / 3600)
            .withColumn("extent_px_x", px).withColumn("extent_px_y", py)
            .withColumn("fits_one_patch", (F.col("extent_px_x") <= cfg.patch) & (F.col("extent_px_y") <= cfg.patch))
            .withColumn("keep", (F.col("n_detections") >= cfg.min_detections)
                        & (F.col("n_timesteps") >= cfg.min_timesteps))
            .withColumn("fire_id", F.format_string("%d_%04d", F.col("year"), F.col("_seq")))
            .drop("_first", "_seq"))


def in_outage(start: str, end: str, windows) -> Column:
    """Whether [start, end] meets any window; the window list is configuration, so it becomes a predicate."""
    test = F.lit(False)
    for d0, d1 in windows:
        low = F.expr(f"datediff(date'{d0}', date'1970-01-01') * 86400L")
        high = F.expr(f"(datediff(date'{d1}', date'1970-01-01') + 1) * 86400L")
        test = test | ((F.col(start) <= high) & (F.col(end) >= low))
    return test


def flag_outages(events: DataFrame, cfg: Settings) -> DataFrame:
    return events.withColumn("touches_no_data", in_outage("start_s", "end_s", cfg.no_data_windows))


def segment(points: DataFrame, cfg: Settings) -> tuple[DataFrame, DataFrame]:
    """Projected detections to (events, labelled detections of kept events)."""
    boxed, labels = component_points(points, cfg)
    labels = materialize(labels)
    events = materialize(flag_outages(describe_events(summarize_components(boxed, labels, cfg), cfg), cfg))
    return events, label_detections(boxed, labels, events)


def label_detections(boxed: DataFrame, labels: DataFrame, events: DataFrame) -> DataFrame:
    """Detections of kept events with their event number and fire id."""
    kept = events.filter("keep").select("component", "event", "fire_id")
    return boxed.join(labels.join(kept, "component").drop("component"), "box").drop("box")


def event_report(events: DataFrame) -> DataFrame:
    return (events.groupBy("year").agg(F.count("*").alias("n_raw"), F.sum(F.col("keep").cast("int")).alias("n_kept"),
                                       F.sum(F.when(F.col("keep"), F.col("n_detections")).otherwise(0))
                                       .alias("kept_detections")))


def largest_events(events: DataFrame, n: int = 10) -> DataFrame:
    return events.filter("keep").orderBy(F.desc("n_detections"), "event").limit(n)


def named_subset(events: DataFrame, wanted: DataFrame, skip_outages: bool = True) -> DataFrame:
    """The wanted fires; fails while running if one is absent, drops those touching an outage."""
    found = wanted.select("fire_id").distinct().join(events.filter("keep"), "fire_id", "left")
    # The failure sits in a column and the outage test keeps nulls, so that no filter lets the
    # optimizer drop an unknown fire before it is noticed.
    unknown = F.raise_error(F.concat(F.lit("unknown fire "), F.col("fire_id"))).cast(events.schema["event"].dataType)
    checked = found.withColumn("event", F.coalesce("event", unknown))
    return checked.filter(~F.coalesce("touches_no_data", F.lit(False))) if skip_outages else checked


def elapsed_hours(labelled: DataFrame) -> DataFrame:
    """Hours since the fire's first detection; the first times are aggregated and joined, so a
    fire of any size keeps its partitions."""
    first = labelled.groupBy("fire_id").agg(F.min("t_s").alias("_t0"))
    return labelled.join(first, "fire_id").withColumn("elapsed_h", (F.col("t_s") - F.col("_t0")) / 3600).drop("_t0")

