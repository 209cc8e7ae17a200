"""Steps of morphology follow each other on bit rows, without cells in between."""

from dataclasses import replace

from pyspark.sql import functions as F

from perimeter.config import FIXTURE
from perimeter.operators import cells as C
from perimeter.operators import labels as L

KEY = ["k"]


def test_rows_give_what_cells_give(spark):
    points = spark.createDataFrame([("a", 3, 31), ("a", 9, 33), ("a", 9, 70), ("b", -4, -1), ("b", -9, 2)], "k string, row int, col int")
    grown = C.dilate_rows(C.to_rows(points, KEY), KEY, C.disk(2))
    closed = C.close_rows(grown, KEY, C.disk(4))
    cells = C.close(C.dilate(points, KEY, C.disk(2)), KEY, C.disk(4))
    assert {tuple(x) for x in C.to_cells(closed, KEY).collect()} == {tuple(x) for x in cells.collect()}
    counted = {r.k: r.n for r in C.count_rows(closed, KEY).collect()}
    assert counted == {r.k: r["count"] for r in cells.groupBy("k").count().collect()}


def test_burn_steps_as_bit_rows(spark):
    """Against single cells, with tiles narrower and wider than a segment and off its borders."""
    cells = [("f", t, r, c) for t in range(4) for r in range(3, 90, 2) for c in range(90) if (r * 7 + c * 3 + t * 5) % 11 < 3 and (r + c) % 4 == t]
    burn = spark.createDataFrame(cells, "fire_id string, t_index int, row int, col int")
    tiles = [("a", 2, 0, 0), ("b", 3, 17, 45), ("c", 2, 40, 31), ("d", 3, 64, 64)]
    samples = spark.createDataFrame([(s, "f", t, r, c) for s, t, r, c in tiles], "sample_id string, fire_id string, t_index int, row0 int, col0 int")
    for patch in (8, 32, 40):
        cfg = replace(FIXTURE, patch=patch)
        rows = L.burn_step_rows(samples, burn, cfg)
        got = {(x.sample_id, x.step, x.r, x.c0 + i) for x in rows.collect() for i in range(C.WIDTH) if x.bits >> i & 1}
        want = {(s, step, r - r0, c - c0) for s, t, r0, c0 in tiles for step in range(3) for _, w, r, c in cells
                if w == t - 2 + step and 0 <= r - r0 < patch and 0 <= c - c0 < patch}
        assert got == want and want
        sums = rows.agg(F.sum(C.bit_places(F.col("bits")) + F.bit_count("bits") * F.col("c0")).alias("s")).first()
        assert sums.s == sum(c for *_, c in want)
