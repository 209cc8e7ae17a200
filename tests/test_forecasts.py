"""Quoted detections, distances inside tiles and probing."""

import math

import pytest
from pyspark.sql import functions as F

from perimeter.operators import dataset as D
from perimeter.operators import metrics as V
from perimeter.operators import scoring as M
from perimeter.sources import detections as S


def test_quoted_fields_and_short_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('latitude,longitude,acq_date,acq_time,confidence,frp,satellite\n'
                                    '1.5,-120.0,2020-01-02,130,"n, ""sure""",7.5,"N"\n2.5,-121.0,2020-01-02\n,,"",,l,,\n')
    rows = sorted(S.read_detections(spark, str(tmp_path)).collect(), key=lambda r: r.latitude or 0.0)
    assert [r.latitude for r in rows] == [None, 1.5, 2.5]
    assert (rows[1].confidence, rows[1].frp, rows[1].satellite, rows[1].acq_time) == ('n, "sure"', 7.5, "N", 130)
    assert (rows[2].acq_date, rows[2].confidence, rows[2].frp) == ("2020-01-02", None, None)
    assert (rows[0].confidence, rows[0].acq_date) == ("l", None)


def test_missing_days_at_both_ends(spark):
    days = spark.createDataFrame([("2020-01-03",), ("2020-01-05",)], "day string").select(F.col("day").cast("date").alias("day"))
    got = [str(r.day) for r in S.missing_days(days, "2020-01-01", "2020-01-06").orderBy("day").collect()]
    assert got == ["2020-01-01", "2020-01-02", "2020-01-04", "2020-01-06"]


def test_distance_in_tiles(spark):
    burned = {"a": {(0, 0), (3, 2)}, "b": set()}
    cells = [(s, r, c, (r, c) in cs) for s, cs in burned.items() for r in range(4) for c in range(4)]
    got = D.with_distance(spark.createDataFrame(cells, "sample_id string, r int, c int, burned boolean"), 4).collect()
    assert len(got) == 32
    for x in got:
        want = min((math.hypot(x.r - r, x.c - c) for r, c in burned[x.sample_id]), default=math.inf)
        assert x.dist == pytest.approx(want)


def test_threshold_is_taken_from_validation(spark):
    rows = [("val", 0.2, 0.1), ("val", 0.5, 0.4), ("test", 0.2, 0.6), ("test", 0.5, 0.3)]
    got = {r.choice: (r.threshold, r.csi) for r in V.transfer(spark.createDataFrame(rows, "split string, threshold double, csi double")).collect()}
    assert got == {"validation": (0.5, 0.3), "test": (0.2, 0.6)}


def test_partners_stay_inside_their_key(spark):
    samples = spark.createDataFrame([("day" if i % 3 else "night", f"s{i}") for i in range(20)] + [("dusk", "lone")], "period string, sample_id string")
    key = {r.sample_id: r.period for r in samples.collect()}
    pairs = {r.sample_id: r.partner for r in M.partners(samples, ["period"]).collect()}
    assert set(pairs) == set(pairs.values()) == set(key)
    assert all(key[a] == key[b] for a, b in pairs.items()) and pairs["lone"] == "lone"
    assert all(a != b for a, b in pairs.items() if a != "lone")


def test_pooled_occlusion(spark):
    rows = [("day", "none", 3, 1, 0, 0.0, 4), ("day", "none", 0, 0, 1, 0.0, 0), ("day", "wind", 1, 1, 2, 0.5, 4), ("day", "wind", 0, 0, 1, 0.0, 0)]
    counts = spark.createDataFrame(rows, "period string, grp string, tp long, fp long, fn long, dp double, roi long")
    got = M.occlusion_pooled(counts, ["period"]).collect()
    assert len(got) == 1 and got[0].samples == 2 and got[0].mean_abs_dp == 0.5
    assert got[0].csi == pytest.approx(1 / 5) and got[0].csi_drop == pytest.approx(3 / 5 - 1 / 5)
