"""Names of the one-degree elevation tiles a box needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dem_tiles(boxes: DataFrame) -> DataFrame:
    """(fire_id, tile) for every one-degree cell a lon/lat box touches, named by north-west corner."""
    def degrees(low: str, high: str) -> F.Column:
        return F.explode(F.sequence(F.floor(low).cast("int"), F.floor(high).cast("int")))
    return (boxes.withColumn("_lat", degrees("lat_min", "lat_max")).withColumn("_lon", degrees("lon_min", "lon_max"))
            .select("fire_id", F.format_string("n%02dw%03d", F.col("_lat") + 1, F.abs("_lon")).alias("tile")).distinct())
