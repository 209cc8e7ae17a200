"""Message indexes of hourly forecast files: which byte ranges hold the wanted fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perimeter.config import WANTED_MESSAGES


def read_message_index(spark: SparkSession, glob: str) -> DataFrame:
    return parse_message_index(spark.read.text(glob).select(F.col("_metadata.file_path").alias("file"), "value"))


def parse_message_index(lines: DataFrame) -> DataFrame:
    """Lines `msg:start:date:var:level:...` to (file, msg, start, var, level, end). Malformed lines
    are skipped; a message ends where the next starts, the last one is open (-1). The window spans
    the index of one file. A line is tested whole, as tests of its parts would split it once each."""
    rows = (lines.filter(F.col("value").rlike(r"^\d+:\d+:[^:]*:[^:]*:")).withColumn("_p", F.split("value", ":"))
            .select("file", F.col("_p")[0].cast("int").alias("msg"), F.col("_p")[1].cast("long").alias("start"),
                    F.col("_p")[3].alias("var"), F.col("_p")[4].alias("level")))
    following = F.lead("start").over(Window.partitionBy("file").orderBy("start", "msg"))
    return rows.withColumn("end", F.coalesce(following - 1, F.lit(-1)))


def select_messages(index: DataFrame) -> DataFrame:
    """Wind, temperature and humidity messages of complete files; dewpoint stands in for humidity
    only in files without it. A file counts only with exactly four matches. The windows span the index of
    one file, as the one before them does, so the index is made and sorted once."""
    def is_(i: int) -> F.Column:
        var, level = WANTED_MESSAGES[i]
        return (F.col("var") == var) & (F.col("level") == level)
    whole = Window.partitionBy("file")
    wanted = is_(0) | is_(1) | is_(2) | (is_(3) & F.col("_rh")) | (is_(4) & ~F.col("_rh"))
    found = (index.filter(F.col("file").isNotNull()).withColumn("_rh", F.max(is_(3)).over(whole)).filter(wanted)
             .withColumn("_n", F.count("*").over(whole)))
    return found.filter("_n = 4").drop("_rh", "_n")


def contiguous_runs(messages: DataFrame) -> DataFrame:
    """Adjacent messages merged into one range: (file, first, last, messages)."""
    order = Window.partitionBy("file").orderBy("start")
    fresh = (F.col("start") != F.coalesce(F.lag("end").over(order) + 1, F.lit(-2))).cast("int")
    runs = messages.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(order))
    return (runs.groupBy("file", "_run").agg(F.min("start").alias("first"), F.max_by("end", "start").alias("last"),
                                             F.count("*").alias("messages")).drop("_run"))
