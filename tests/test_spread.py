"""Tables that stand for many more rows than they hold are exploded by all tasks."""

from pyspark.sql import functions as F

from perimeter.operators import terrain as TE


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_of_one_grid_are_made_by_all_tasks(spark):
    grid = spark.createDataFrame([("a", 300, 200, -1000, 5000)], "fire_id string, height int, width int, x0 long, y1 long").coalesce(1)
    cells = TE.grid_cells(grid, 100)
    assert cells.count() == 60000
    assert cells.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_fuel_pixels_are_shuffled_once(spark):
    pixels = (spark.range(-20, 20).selectExpr("cast(id as int) as prow").crossJoin(spark.range(-20, 20).selectExpr("cast(id as int) as pcol"))
              .selectExpr("prow", "pcol", "case when (prow + pcol) % 7 <> 0 then cast(100 + pmod(prow * 3 + pcol, 5) as int) end as code",
                          "case when pcol % 4 <> 0 then double(pmod(prow * pcol, 11)) end as cc", "double(prow) as ch"))
    both = TE.land_cover(pixels, 60, 100)
    assert plan(both).count("Exchange hashpartitioning") == 1
    got = {(r.arow, r.acol): (r.code, r.cc, r.ch) for r in both.collect()}
    # The same by hand.
    areas, sums = {}, {}
    for p in pixels.collect():
        for a in range(p.prow * 60 // 100, -(-(p.prow + 1) * 60 // 100)):
            for b in range(p.pcol * 60 // 100, -(-(p.pcol + 1) * 60 // 100)):
                w = ((min((p.prow + 1) * 60, (a + 1) * 100) - max(p.prow * 60, a * 100))
                     * (min((p.pcol + 1) * 60, (b + 1) * 100) - max(p.pcol * 60, b * 100)))
                at = areas.setdefault((a, b), {})
                at[p.code] = at.get(p.code, 0) + w
                s = sums.setdefault((a, b), [0.0, 0, 0.0, 0])
                if p.cc is not None:
                    s[0], s[1] = s[0] + w * p.cc, s[1] + w
                s[2], s[3] = s[2] + w * p.ch, s[3] + w
    assert set(got) == set(areas)
    for k, at in areas.items():
        code = max(at, key=lambda c: (at[c], c is not None, -(c or 0)))
        cc = sums[k][0] / sums[k][1] if sums[k][1] else None
        assert got[k] == (code, cc, sums[k][2] / sums[k][3]), k
