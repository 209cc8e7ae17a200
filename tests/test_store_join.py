"""The weather store joins archive rows without broadcasting them, and reads cells inside windows only."""

from perimeter.operators import weather as W


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_archive_rows_are_not_broadcast(spark):
    scan = spark.createDataFrame([(5, i, j, 0.0, 0.0, 1.0, 2.0, 3.0, 4.0, False) for i in range(20) for j in range(20)],
                                 "hour int, iy int, ix int, lon double, lat double, u10 double, v10 double, t2m double, rh2m double, rh_derived boolean")
    crops = spark.createDataFrame([("a", 2, 4, 15, 17), ("b", 0, 1, 0, 0)], "fire_id string, iy0 int, iy1 int, ix0 int, ix1 int")
    wanted = spark.createDataFrame([("a", 5), ("b", 6)], "fire_id string, hour int")
    store = W.build_store(scan, crops, wanted)
    assert "BroadcastHashJoin" not in plan(store).split("SortMergeJoin")[0] and "SortMergeJoin" in plan(store)
    assert {(r.fire_id, r.iy, r.ix) for r in store.collect()} == {("a", i, j) for i in (2, 3, 4) for j in (15, 16, 17)}
    cells = W.cut_cells(scan.select("iy", "ix"), crops)
    assert cells.count() == 9 + 2
