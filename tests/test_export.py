"""Frames of long fires: no window is left out and new cells are those of the target."""

from perimeter.operators.export import frames


def test_forty_windows_all_come_back(spark):
    first = spark.createDataFrame([("f", r, 0, r) for r in range(41)], "fire_id string, row int, col int, first_t int")
    stitched = spark.createDataFrame([("f", t, t + 1, 0, 0.9 if t % 2 else 0.1) for t in range(40)],
                                     "fire_id string, t_index int, row int, col int, prob double")
    got = {r["t_index"]: r for r in frames(stitched, first, 0.5).collect()}
    assert sorted(got) == list(range(40))
    for t, r in got.items():
        assert (r["new_px"], r["burned_px"], r["pred_px"]) == (1, t + 1, t % 2)
        assert r["csi"] == (1.0 if t % 2 else 0.0)
