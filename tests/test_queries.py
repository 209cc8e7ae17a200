"""Registered queries on small studies."""

from statistics import median
from types import SimpleNamespace

from pyspark.sql import functions as F

from perimeter.config import FUEL_CODES
from perimeter.operators.ranking import exact_quantiles
from perimeter.plans import library  # noqa: F401
from perimeter.plans.registry import QUERIES
from perimeter.plans.study import Study


def test_stitched_tiles_average_where_they_overlap(spark):
    rows = [("f", 3, 0, 0, 1, 2, 0.2), ("f", 3, 0, 1, 1, 1, 0.4), ("f", 3, 0, 1, 1, 2, 0.5)]
    scores = spark.createDataFrame(rows, "fire_id string, t_index int, row0 int, col0 int, r int, c int, prob double")
    got = [tuple(x) for x in QUERIES["m09_stitch_tiles"](SimpleNamespace(tile_scores=scores)).collect()]
    assert got == [("f", 3, 1, 2, 3, round(0.3 * 3 + 0.5 * 4, 4))]


def far_study(spark, first, last):
    """A study of one square of land far from the US, by absolute cells."""
    study = Study(spark, "none")
    side = range(first, last)
    land = spark.createDataFrame([(r, c, r + 30000, c + 30000) for r in side for c in side], "arow int, acol int, u int, v int")
    study.__dict__["land"] = land
    return study


def test_fuel_codes_below_zero_count_from_the_end(spark, monkeypatch):
    monkeypatch.setattr(Study, "stage", lambda self, name, build: build())
    pixels = far_study(spark, -30040, -30000).fuel_pixels
    at = F.expr("(((prow + 50000) div 3) * 31 + ((pcol + 50000) div 3) * 17) % 45 + 1").alias("at")
    got = {r["at"]: r.code for r in pixels.select(at, "code").distinct().collect()}
    assert min(got) < 0 and got[0] is None
    assert all(code == FUEL_CODES[at - 1 if at > 0 else at] for at, code in got.items() if at)


def test_weather_grid_of_detections_beyond_a_pole(spark):
    study = Study(spark, "none")
    rows = [("2020-01-02 01:00:00", 100.0, -100.0), ("2020-01-02 01:00:00", 80.0, -100.0)]
    seen = spark.createDataFrame(rows, "acq string, latitude double, longitude double").withColumn("acq", F.to_timestamp("acq"))
    study.__dict__["detections"] = seen.filter("latitude > 90")
    beyond = study.weather_grid.select("year", "iy", "ix").collect()
    study.__dict__["detections"] = seen.filter("latitude < 90")
    assert len(beyond) == 441 and set(beyond) == set(study.weather_grid.select("year", "iy", "ix").collect())


def broadcasts(df):
    """Build sides of the hash joins of the plan before anything has run."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return [line for line in plan.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]


def test_quantiles_broadcast_no_written_values(spark):
    rows = spark.range(2000).selectExpr("concat('f', id % 3) as fire_id", "cast(id % 97 as double) as x")
    out = exact_quantiles(rows, "x", [0.5], ["fire_id"])
    want = {f"f{i}": median(float(x % 97) for x in range(i, 2000, 3)) for i in range(3)}
    assert not broadcasts(out) and {r.fire_id: r["quantile"] for r in out.collect()} == want


def test_grid_cells_are_not_broadcast_to_meet_fuel(spark):
    study = far_study(spark, 0, 8)
    study.__dict__["fuel_pixels"] = spark.range(100).selectExpr("cast(id div 10 as int) as prow", "cast(id % 10 as int) as pcol", "101 as code")
    study.__dict__["cells"] = study.land.selectExpr("'f' as fire_id", "arow as row", "acol as col", "arow", "acol")
    study.__dict__["static"] = spark.createDataFrame([("f",)], "fire_id string")
    for name, want in (("f09_fuel_index", [(101, 6, 36)]), ("f13_fuel_groups", [("f", "grass", 36)])):
        out = QUERIES[name](study)
        assert [tuple(x) for x in out.collect()] == want
        assert not [j for j in broadcasts(out) if "arow" in j]
