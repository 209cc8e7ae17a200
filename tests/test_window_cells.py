"""Cells of windows that tiles show."""

from types import SimpleNamespace

from perimeter.operators import dataset as D
from perimeter.operators import weather as W


def test_cells_name_the_windows_that_show_their_block(spark):
    cfg = SimpleNamespace(patch=16, t_steps=2)
    cells = spark.createDataFrame([("f", r, c) for r in range(0, 64, 3) for c in range(0, 64, 3)], "fire_id string, row int, col int")
    samples = spark.createDataFrame([("f:5", "f", 5, 3, 20), ("f:9", "f", 9, 11, 24), ("f:6", "f", 6, 3, 20)],
                                    "sample_id string, fire_id string, t_index int, row0 int, col0 int")
    got = {(x.row, x.col): set(x.ks) for x in D.shown(cells, samples, cfg).collect()}
    for r, c in ((r, c) for r in range(0, 64, 3) for c in range(0, 64, 3)):
        need = {k for t, r0, c0 in ((5, 3, 20), (9, 11, 24), (6, 3, 20)) for k in (t - 1, t) if r0 <= r < r0 + 16 and c0 <= c < c0 + 16}
        assert need <= got.get((r, c), set())
    assert (0, 0) not in got and got[21, 21] == {4, 5, 6, 8, 9} - ({8, 9} if 21 < 24 - 24 % 8 else set())


def test_weather_is_made_for_shown_windows_only(spark):
    cells = spark.createDataFrame([("f", 0, 0, 1, 1, 0.5, 0.5, [2]), ("f", 0, 1, 1, 1, 0.0, 0.0, [2, 3])],
                                  "fire_id string, row int, col int, qy int, qx int, fr double, fc double, ks array<int>")
    quad = W.quads(spark.createDataFrame([("f", k, y, x, 1.0 * k + y + x) for k in (2, 3, 4) for y in (1, 2) for x in (1, 2)],
                                         "fire_id string, k int, iy int, ix int, v double"), ["fire_id", "k"], ["v"])
    got = W.interpolate(cells, quad, ["fire_id"], ["v"])
    assert sorted(got.columns) == ["col", "fire_id", "k", "row", "v"]
    assert sorted((x.k, x.col, x.v) for x in got.collect()) == [(2, 0, 5.0), (2, 1, 4.0), (3, 1, 5.0)]


def test_ground_is_met_before_cells_are_repeated_by_windows(spark):
    from perimeter.config import FIXTURE
    cells = spark.createDataFrame([], "fire_id string, row int, col int, qy int, qx int, fr double, fc double")
    values = [c for c in W.WEATHER if c != "fosberg_10h"]
    fields = spark.createDataFrame([], "fire_id string, k int, iy int, ix int, " + ", ".join(f"{v} double" for v in values))
    static = spark.createDataFrame([], "fire_id string, row int, col int, height int, width int, elevation double, slope double, aspect_sin double,"
                                       " aspect_cos double, tpi double, cc double, ch double, fuel_idx short")
    first = spark.createDataFrame([], "fire_id string, row int, col int, first_t int")
    plan = D.cell_windows(cells, fields, static, first, FIXTURE)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert "qy#" in joins[0] and not any("qy#" in j for j in joins[1:])
