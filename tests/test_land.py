"""Land, elevation and pixels made without shuffling cells, against the plain way."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from perimeter.operators import terrain as TE
from perimeter.plans import library  # noqa: F401
from perimeter.plans.queries.fields import terrain
from perimeter.plans.registry import QUERIES
from perimeter.plans.study import Study


def rows(df):
    return sorted(map(tuple, df.collect()))


def made(monkeypatch, spark, grids):
    """A study of fire grids (fire_id, x0, y1, width, height)."""
    monkeypatch.setattr(Study, "stage", lambda self, name, build: build())
    study = Study(spark, "none")
    study.__dict__["grid"] = spark.createDataFrame(grids, "fire_id string, x0 long, y1 long, width int, height int")
    return study


def cells_of(grids):
    return {(-g[2] // 100 + r, g[1] // 100 + c) for g in grids for r in range(g[4]) for c in range(g[3])}


# Overlapping, equal, touching and distant grids, some with rows or columns that are negative after the shift by 30000.
GRIDS = [("a", 0, 0, 40, 5), ("b", 3000, -200, 40, 6), ("c", 0, 0, 40, 5), ("d", 90000, -300, 7, 2), ("e", -3000500, 3000300, 50, 9), ("f", 7000, -100, 3, 3)]


def test_land_holds_each_cell_once(spark, monkeypatch):
    land = made(monkeypatch, spark, GRIDS).land
    assert rows(land.select("arow", "acol")) == sorted(cells_of(GRIDS))
    assert rows(land) == sorted((r, c, r + 30000, c + 30000) for r, c in cells_of(GRIDS))


def test_elevation_equals_the_mosaic_of_its_tiles(spark, monkeypatch):
    study = made(monkeypatch, spark, GRIDS)
    assert rows(study.dem) == rows(TE.mosaic(study.dem_tiles).select("arow", "acol", "value"))
    assert {len(t) for t, in study.dem_tiles.select("tile").collect()} == {12}


def test_pixels_are_those_of_single_cells(spark, monkeypatch):
    study = made(monkeypatch, spark, GRIDS)
    plain = (study.land.withColumn("p", F.explode(F.expr("sequence((u * 100) div 60, (u * 100 + 99) div 60)")))
             .withColumn("q", F.explode(F.expr("sequence((v * 100) div 60, (v * 100 + 99) div 60)"))).select("p", "q").distinct())
    assert rows(study.fuel_pixels.selectExpr("prow + 50000", "pcol + 50000")) == rows(plain)


def test_intervals_of_segments_with_gaps(spark):
    cells = [(0, c) for c in (*range(-40, -3), 5, 6, 9, 31, 32, *range(64, 96))]
    spans = TE.intervals_of(spark.createDataFrame(cells, "r int, c int"), "r", "c").collect()
    assert sorted(c for s in spans for c in range(s["_low"], s["_high"] + 1)) == sorted(c for _, c in cells)


def test_coverage_of_bit_rows_equals_coverage_of_cells(spark, monkeypatch):
    study = made(monkeypatch, spark, [*GRIDS, ("dry", 500000, 500000, 33, 2)])
    dem = study.dem.filter("acol < 4000").filter("pmod(arow * 7 + acol, 50) <> 3 or acol > 60")
    want = TE.coverage(TE.crop_dem(study.cells, dem), 0.98)
    assert rows(TE.grid_coverage(study.grid, dem, 100, 0.98)) == rows(want)
    accepted = TE.accepted_fires(study.grid, dem, SimpleNamespace(resolution_m=100, min_coverage=0.0))
    assert "dry" not in {r.fire_id for r in accepted.collect()} and accepted.count() == len(GRIDS)


def exchanges_of(df, *columns):
    """Shuffles of the plan that carry all of the columns."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and all(f"{c}#" in line for c in columns)]


def test_land_elevation_and_pixels_shuffle_no_cells(spark, monkeypatch):
    study = made(monkeypatch, spark, GRIDS)
    for df, keys in ((study.land, ("arow", "acol")), (study.dem, ("arow", "acol")), (study.fuel_pixels, ("prow", "pcol"))):
        assert not exchanges_of(df, *keys)


def test_slope_and_attrition_need_no_fuel(spark, monkeypatch):
    study = made(monkeypatch, spark, GRIDS[:3])
    study.__dict__["fuel_pixels"] = study.__dict__["static"] = None
    study.__dict__["accepted"] = study.grid.select("fire_id")
    assert terrain(study).filter("slope IS NOT NULL").count() == 40 * 5 * 2 + 40 * 6
    none = study.grid.limit(0)
    study.__dict__.update(_segmented=(study.grid.withColumn("keep", F.lit(True)), none), index=none, samples=none)
    assert rows(QUERIES["t09_attrition"](study)) == [("kept", 3), ("sampled", 0), ("static", 3), ("weather", 0)]
