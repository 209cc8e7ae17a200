import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from perimeter.functions import geo
from perimeter.functions.physics import fuel_moisture, humidity_from_dewpoint
from perimeter.operators import cells as C
from perimeter.operators import distance as ND
from perimeter.operators import terrain as TE
from perimeter.operators import weather as W
from perimeter.operators.baselines import baseline_counts, tile_rows
from perimeter.operators.labels import point_cells
from perimeter.operators.tiling import tile_origins
from perimeter.config import Settings


def cells(spark, pts):
    return spark.createDataFrame([(1, r, c) for r, c in pts], "k int, row int, col int")


def got(df):
    return {(r.row, r.col) for r in df.collect()}


def grow(pts, off):
    return {(r + a, c + b) for r, c in pts for a, b in off}


def shrink(pts, off):
    return {p for p in pts if all((p[0] + a, p[1] + b) in pts for a, b in off)}


def test_morphology_against_sets(spark):
    rng = random.Random(1)
    pts = {(rng.randrange(20, 60), rng.randrange(20, 110)) for _ in range(60)}
    df = cells(spark, pts)
    for off in (C.disk(2), C.disk(4), C.diamond(8), C.square(3)):
        assert got(C.dilate(df, ["k"], off)) == grow(pts, off)
        wide = grow(pts, off)
        assert got(C.erode(cells(spark, wide), ["k"], off)) == shrink(wide, off)
    want = shrink(grow(grow(pts, C.disk(2)), C.disk(4)), C.disk(4))
    assert got(C.grow_and_close(df, ["k"], C.disk(2), C.disk(4))) == want
    closed = got(C.close(df, ["k"], C.disk(4)))
    assert closed >= pts and got(C.close(cells(spark, closed), ["k"], C.disk(4))) == closed


def test_element_sizes():
    assert (len(C.disk(2)), len(C.disk(4))) == (13, 49)
    assert [len(C.diamond(k)) for k in (1, 3, 5, 8)] == [5, 25, 61, 145]


def test_cells_meet_tiles_as_bit_rows(spark):
    """A full segment of 32 cells is one row per kind in a tile, not a row per cell; frames do not gather detections in one task."""
    first = spark.createDataFrame([("f", r, c, (r + c) % 3) for r in range(4) for c in range(32, 64)], "fire_id string, row int, col int, first_t int")
    tile = spark.createDataFrame([("s", "f", 1, 0, 32)], "sample_id string, fire_id string, t_index int, row0 int, col0 int")
    got = sorted((r.y, r.row, r.blk, bin(r.bits).count("1")) for r in tile_rows(tile, first, Settings(patch=32, stride=16)).collect())
    assert [g[:3] for g in got] == [(y, r, 0) for y in (False, True) for r in range(4)] and sum(g[3] for g in got) == 128
    seen = spark.createDataFrame([("f", 50.0, 50.0, 0)], "fire_id string, x double, y double, t_s long")
    grid = spark.createDataFrame([("f", 0.0, 100.0)], "fire_id string, x0 double, y1 double")
    frames = spark.createDataFrame([("f", 0)], "fire_id string, bin long")
    cells = point_cells(seen, grid, frames, Settings())
    assert "SortMergeJoin" in cells._jdf.queryExecution().sparkPlan().toString()
    assert [tuple(r) for r in cells.collect()] == [("f", 0, 0, 0)]


def test_ring_baseline_against_sets(spark):
    cfg = Settings(patch=40, stride=20)
    rng = random.Random(2)
    first = {(rng.randrange(0, 60), rng.randrange(0, 60)): rng.randrange(0, 5) for _ in range(200)}
    fdf = spark.createDataFrame([("f", r, c, t) for (r, c), t in first.items()], "fire_id string, row int, col int, first_t int")
    tiles = [(f"s{i}", "f", 2, r0, c0) for i, (r0, c0) in enumerate([(0, 0), (10, 15), (20, 20)])]
    sdf = spark.createDataFrame(tiles, "sample_id string, fire_id string, t_index int, row0 int, col0 int")
    res = {(r.sample_id, r.baseline): (r.tp, r.fp, r.fn) for r in baseline_counts(sdf, fdf, cfg).collect()}
    for sid, _, t, r0, c0 in tiles:
        inside = {(r - r0, c - c0): ft for (r, c), ft in first.items() if 0 <= r - r0 < 40 and 0 <= c - c0 < 40}
        cur, y = {p for p, ft in inside.items() if ft <= t}, {p for p, ft in inside.items() if ft == t + 1}
        for k in (1, 3, 5, 8):
            pred = {p for p in grow(cur, C.diamond(k)) if 0 <= p[0] < 40 and 0 <= p[1] < 40} - cur
            assert res[sid, f"ring{k}"] == (len(pred & y), len(pred - y), len(y - pred))


def test_nearest_burned_against_brute_force(spark):
    rng = np.random.default_rng(0)
    tiles = {n: (rng.integers(0, 20, n).tolist(), rng.integers(0, 20, n).tolist()) for n in (1, 5, 60)}
    burned = spark.createDataFrame([(n, r, c) for n, of in tiles.items() for r, c in zip(*of)], "k int, r int, c int")
    parts = [F.transform("near", lambda x: F.struct(ND.squared(x, 20).alias("d2"), ND.row_of(x, 20).alias("r"), ND.col_of(x, 20).alias("c"))).alias("near")]
    lines = {(x["k"], x["r"]): x["near"] for x in ND.nearest_lines(burned, ["k"], 20).select("k", "r", *parts).collect()}
    for n, (rows, cols) in tiles.items():
        for r in range(20):
            for c in range(20):
                want = min(((r - a) ** 2 + (c - b) ** 2, a, b) for a, b in zip(rows, cols))
                assert tuple(lines[n, r][c]) == want


def test_tile_origins(spark):
    """Tiles cover every active cell, lie inside the grid and are at most a stride apart."""
    rng, patch, stride = random.Random(4), 32, 16
    spans = [(n, *sorted(rng.sample(range(n), 2))) for n in (20, 32, 33, 47, 80, 150) for _ in range(12)]
    known = {(150, 40, 59): [33], (150, 0, 3): [0], (150, 146, 149): [118], (20, 3, 9): [0], (33, 0, 32): [0, 1]}
    df = spark.createDataFrame([*spans, *known], "n int, lo int, hi int")
    for n, lo, hi, o in df.select("n", "lo", "hi", tile_origins(F.col("lo"), F.col("hi"), F.col("n"), patch, stride)).collect():
        assert o == sorted(set(o)) and o[0] >= 0 and (o == [0] if n <= patch else o[-1] + patch <= n)
        # A box exactly one tile wide is centred with a floor, which leaves its last cell out.
        end = hi if hi - lo == patch - 1 else hi + 1
        assert set(range(lo, end)) <= {a + i for a in o for i in range(patch)}
        assert all(b - a <= stride for a, b in zip(o, o[1:]))
        assert hi - lo >= patch or len(o) == 1
        assert o == known.get((n, lo, hi), o)


def test_projections(spark):
    df = spark.range(1)
    x, y = geo.lonlat_to_albers(F.lit(-120.0), F.lit(39.0))
    row = df.select(x.alias("x"), y.alias("y")).first()
    assert abs(row.x + 2037425.597) < 0.01 and abs(row.y - 2033555.350) < 0.01
    lon, lat = geo.albers_to_lonlat(F.lit(row.x), F.lit(row.y))
    lx, ly = geo.lonlat_to_lambert(F.lit(-120.0), F.lit(39.0))
    back = geo.lambert_to_lonlat(lx, ly)
    out = df.select(lon, lat, *back, geo.fold_longitude(F.lit(240.0))).first()
    assert abs(out[0] + 120) < 1e-7 and abs(out[1] - 39) < 1e-7
    assert abs(out[2] + 120) < 1e-9 and abs(out[3] - 39) < 1e-9 and out[4] == -120


@pytest.mark.parametrize("dr,dc,aspect", [(1, 0, (0, 1)), (-1, 0, (0, -1)), (0, 1, (-1, 0)), (0, -1, (1, 0)), (0, 0, (0, 0))])
def test_planes_face_downhill(spark, dr, dc, aspect):
    # Elevation rising with the row (southwards) faces north, rising with the column faces west.
    df = spark.createDataFrame([("f", r, c, 12, 12, 100.0 * (dr * r + dc * c)) for r in range(12) for c in range(12)],
                               "fire_id string, row int, col int, height int, width int, dem double")
    for row in TE.derivatives(df, 100.0).collect():
        assert abs(row.aspect_sin - aspect[0]) < 1e-9 and abs(row.aspect_cos - aspect[1]) < 1e-9
        if 3 <= row.row <= 8 and 3 <= row.col <= 8:
            assert abs(row.tpi) < 1e-9
        assert abs(row.slope - (45 if (dr or dc) else 0)) < 1e-9


def test_unknown_fuel_fails(spark):
    df = spark.createDataFrame([(101,), (150,)], "code int")
    with pytest.raises(Exception, match="vocabulary: 150"):
        df.select(TE.fuel_index(F.col("code"))).collect()


def test_physics(spark):
    row = spark.range(1).select(humidity_from_dewpoint(F.lit(290.0), F.lit(290.0)), fuel_moisture(F.lit(300.0), F.lit(5.0)),
                                fuel_moisture(F.lit(300.0), F.lit(30.0)), fuel_moisture(F.lit(250.0), F.lit(100.0))).first()
    f = (300.0 - 273.15) * 1.8 + 32
    assert row[0] == 100.0
    assert abs(row[1] - 1.28 * (0.03229 + 0.281073 * 5 - 0.000578 * 5 * f)) < 1e-9
    assert abs(row[2] - 1.28 * (2.22749 + 0.160107 * 30 - 0.014784 * f)) < 1e-9
    assert row[3] <= 40


def test_bridging_reaches_three_hours_each_side(spark):
    present = spark.createDataFrame([("f", h) for h in (0, 4, 10, 14, 15)], "fire_id string, hour int")
    needed = spark.createDataFrame([("f", h) for h in (0, 1, 2, 3, 7, 13, 11)], "fire_id string, hour int")
    out = {r.hour: (r.lo, r.hi, r.w) for r in W.bridge(needed, present, 3).collect()}
    assert out[0] == (0, 0, 0.0) and out[1] == (0, 4, 0.25) and out[3] == (0, 4, 0.75)
    assert out[7] == (4, 10, 0.5) and out[13] == (10, 14, 0.75) and out[11] == (10, 14, 0.25)
    far = spark.createDataFrame([("f", 0), ("f", 5)], "fire_id string, hour int")
    assert W.bridge(spark.createDataFrame([("f", 1)], "fire_id string, hour int"), far, 3).first().lo is None


def test_irregular_weather_grid_fails(spark):
    from perimeter.functions.geo import lambert_to_lonlat
    df = spark.createDataFrame([("f", i, j) for i in range(3) for j in range(3)], "fire_id string, iy int, ix int")
    for step, ok in ((3000.0, True), (900.0, False)):
        lon, lat = lambert_to_lonlat(F.col("ix") * step, F.col("iy") * step)
        fit = W.fit_affine(df.withColumn("lon", lon).withColumn("lat", lat))
        if ok:
            assert abs(fit.first().dx - 3000) < 1e-3
        else:
            with pytest.raises(Exception, match="irregular"):
                fit.collect()


def test_pixels_without_a_code_count_by_area(spark):
    rows = [(0, 0, 101), (0, 1, None), (1, 0, None), (1, 1, 102), (0, 2, 103), (0, 3, None), (1, 2, None), (1, 3, None)]
    pixels = spark.createDataFrame(rows, "prow int, pcol int, code int")
    out = {(r.arow, r.acol): r.code for r in TE.majority(pixels, 60, 120).collect()}
    assert out == {(0, 0): None, (0, 1): None}
    tie = spark.createDataFrame([(0, 0, 104), (0, 1, None), (1, 0, None), (1, 1, 104)], "prow int, pcol int, code int")
    assert TE.majority(tie, 60, 120).first().code == 104
