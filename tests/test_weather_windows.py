"""Weather windows of fires."""

from perimeter.operators import weather as W


def test_a_fire_without_weather_cells_has_no_window(spark):
    bounds = spark.createDataFrame([("near", -100.0, 40.0, -99.9, 40.1), ("pole", -100.0, 89.4, -99.9, 89.5)],
                                   "fire_id string, lon_min double, lat_min double, lon_max double, lat_max double")
    cells = spark.createDataFrame([(7, 3, -99.95, 40.05), (8, 5, -99.92, 40.08), (9, 9, -99.8, 89.45)], "iy int, ix int, lon double, lat double")
    got = W.crop_windows(bounds, cells).select("fire_id", "iy0", "iy1", "ix0", "ix1").collect()
    assert [tuple(x) for x in got] == [("near", 7, 8, 3, 5)]
